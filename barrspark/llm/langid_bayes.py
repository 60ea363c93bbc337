"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from all labelled training rows; each task sums its own count vectors, which Spark adds
up by (language, bin). The matrix of log-probabilities has a bounded size and is broadcast; a text's
scores are a sparse product: the distinct bins of a batch's texts with their counts, as one sparse matrix in rows, times the rows of
the table, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barrspark.llm.common import crc_bucket, give_back, small_batches

ORDERS = (1, 2, 3)
BINS = 1 << 15
#: Bound on the broadcast matrix: languages beyond ``MATRIX_BYTES / (4 * BINS)`` are an error, as other bins would be another model.
MATRIX_BYTES = 256 << 20
SMOOTHING = 0.5
UNKNOWN = "und"
_SEGMENT = 1 << 20
#: Entries of the sparse matrix that are multiplied together, and n-grams from which they are counted by bins.
_ENTRIES, _DENSE = 1 << 17, 1 << 9
#: Texts that are scored together.
_TEXTS = 256
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@cache
def _fold_table() -> np.ndarray:
    """Code point to its lower-case letter, or to a space where it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def _gram_bins(text: str, bins: int) -> Iterator[np.ndarray]:
    """Bins of all n-grams of a text, from a bounded stretch of it at a time."""
    shift, tail = np.uint32(32 - (bins.bit_length() - 1)), np.array([32], np.uint32)
    for at in range(0, len(text), _SEGMENT):
        raw = text[at : at + _SEGMENT].encode("utf-32-le", "surrogatepass")
        c = np.concatenate([tail, _fold_table()[np.frombuffer(raw, np.uint32)]])
        keep = np.ones(len(c), bool)
        keep[len(tail) :] = (c[len(tail) :] != 32) | (c[len(tail) - 1 : -1] != 32)
        c, known = c[keep], len(tail)
        for n in ORDERS:
            first = max(0, known - n + 1)
            if len(c) - n + 1 <= first:
                continue
            h = np.full(len(c) - n + 1 - first, n, np.uint32)
            for k in range(n):
                h = (h ^ c[first + k : len(c) - n + 1 + k]) * _MULTIPLIERS[k]
                h ^= h >> np.uint32(15)
            h = (h * _MULTIPLIERS[0]) >> shift
            letters = c[first : len(c) - n + 1] != 32
            yield h[letters] if n == 1 else h
        tail = c[-2:]


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(docs: DataFrame, text: str, lang: str, bins: int = BINS) -> DataFrame:
    """``lang, bin, n`` over all rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for b in batches:
            for t, g in zip(b.column(0), b.column(1), strict=True):
                name, body = g.as_py(), t.as_py()
                if not _has_letter(body):
                    continue
                if name not in sums:
                    sums[name] = np.zeros(bins, np.int64)
                docs_of[name] = docs_of.get(name, 0) + 1
                for idx in _gram_bins(body, bins):
                    sums[name] += np.bincount(idx, minlength=bins)
        for name, x in sums.items():
            at = np.flatnonzero(x)
            # bin -1 holds the number of documents
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (len(at) + 1), pa.string()),
                    pa.array(np.concatenate([[-1], at]), pa.int32()),
                    pa.array(np.concatenate([[docs_of[name]], x[at]]), pa.int64()),
                ],
                ["lang", "bin", "n"],
            )

    read = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    return read.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


class NaiveBayes:
    """``langs`` in sorted order, log-probabilities ``table[bin, lang]`` and log priors."""

    def __init__(self, langs: list[str], table: np.ndarray, prior: np.ndarray):
        self.langs, self.table, self.prior = langs, table, prior

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The likeliest language and its posterior of each text; ``und`` and 0 without letters or languages."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if self.langs and _has_letter(t)]
        if not known:
            return out
        total = np.tile(self.prior, (len(known), 1))
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0
        for row, i in enumerate(known):
            for idx in _gram_bins(texts[i], len(self.table)):
                n = np.bincount(idx) if len(idx) > _DENSE else None
                at, n = np.unique(idx, return_counts=True) if n is None else (np.flatnonzero(n), n[n > 0])
                held.append((row, at, n))
                size += len(at)
                if size >= _ENTRIES:
                    self._add(total, held)
                    held, size = [], 0
        self._add(total, held)
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        for i, k, x in zip(known, best.tolist(), score, strict=True):
            out[i] = (self.langs[k], float(x))
        return out

    def _add(self, total: np.ndarray, held: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Adds the product of a sparse matrix (row, bins, counts) and the table."""
        if held:
            edges = np.cumsum([0] + [len(at) for _, at, _ in held[:-1]])
            bins, n = np.concatenate([at for _, at, _ in held]), np.concatenate([n for _, _, n in held])
            products = np.add.reduceat(self.table[bins] * n[:, None].astype(np.float64), edges, axis=0)
            np.add.at(total, [row for row, _, _ in held], products)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", training: Column | None = None) -> NaiveBayes:
    """The model from all rows of ``docs`` that ``training`` allows and that have a language and a letter."""
    small_batches(docs.sparkSession)
    rows = docs if training is None else docs.where(training)
    most = MATRIX_BYTES // (4 * BINS)
    langs = sorted(r[0] for r in rows.where(F.col(lang).isNotNull()).select(lang).distinct().limit(most + 1).collect())
    bins = BINS
    if bins * len(langs) * 4 > MATRIX_BYTES:
        raise ValueError(f"{len(langs)} languages take a matrix of over {MATRIX_BYTES} bytes")
    counts = np.zeros((bins, len(langs)), np.float64)
    n_docs = np.zeros(len(langs))
    at = {name: i for i, name in enumerate(langs)}
    found = gram_counts(rows, text, lang, bins).groupBy("bin").agg(F.collect_list(F.struct("lang", "n")).alias("by"))
    for r in found.toLocalIterator():
        for name, n in r["by"]:
            if r["bin"] < 0:
                n_docs[at[name]] = n
            else:
                counts[r["bin"], at[name]] = n
    seen = n_docs > 0
    langs, counts, n_docs = [x for x, s in zip(langs, seen, strict=True) if s], counts[:, seen], n_docs[seen]
    table = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * bins)
    return NaiveBayes(langs, table.astype(np.float32), np.log(n_docs / max(1.0, n_docs.sum())))


def _predictions(nb: NaiveBayes, texts: pa.Array) -> Iterator[tuple[str, float]]:
    """Predictions of a column, so many texts at a time that few are Python strings at once."""
    for at in range(0, len(texts), _TEXTS):
        yield from nb.predict(texts.slice(at, _TEXTS).to_pylist())


def _predict_with(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nb = model.value
        for b in batches:
            got = list(_predictions(nb, b.column(b.schema.get_field_index("__text"))))
            keep = [i for i, n in enumerate(b.schema.names) if n != "__text"]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in keep] + [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())],
                [b.schema.names[i] for i in keep] + ["lang_pred", "score"],
            )
            give_back()

    return run


def identify(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", folds: int = 4, held: int = 2
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    Rows whose crc32(id as text) mod ``folds`` is ``held`` are held out of training, and so are
    rows without an id (``held_out`` is then null). ``score`` is the posterior of ``lang_pred``. Null texts
    and texts without a letter are ``und`` with score 0, and so is everything where nothing is labelled.
    Equal posteriors give the language first in sorted order. Repeated rows count and return as often as
    they occur; other columns are not read.
    """
    bucket = crc_bucket(F.col(doc_id), folds)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, text, lang, bucket != held))
    read = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (bucket == held).alias("held_out"), F.col(text).alias("__text")
    )
    return read.mapInArrow(_predict_with(model), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose language is identified with a posterior of ``least`` or more.

    Training is that of :func:`identify`; the prediction reads the text alone.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, text, lang, crc_bucket(F.col(doc_id), 4) != 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _predictions(model.value, b.column(b.schema.get_field_index(text)))
            keep = pa.array([name != UNKNOWN and score >= least for name, score in got], pa.bool_())
            # slices, so that the kept rows are not copied all at once
            for at in range(0, b.num_rows, _TEXTS):
                yield b.slice(at, _TEXTS).filter(keep.slice(at, _TEXTS))
            del b
            give_back()

    return docs.mapInArrow(run, docs.schema)
