"""Language-model scoring with a log-bilinear model trained in numpy by noise-contrastive estimation.

Counts of all training tokens come first. The most frequent words are outputs of their own, all others
share classes by their last two bytes, which tell languages and endings apart; a word of a class has its smoothed share of the
class. The model predicts the output from the two before it: their vectors, each times a matrix of its place, add up to the
predicted vector, whose products with the outputs' vectors, plus biases, are the logits. Biases start at the logarithm of the
outputs' shares, so that training starts from the unigram model. It is trained on every training text, in rounds over slices of growing size:
each task goes over its texts with steps scaled by the squares of past gradients, and parameters and these sums are averaged by
tokens. Matrix products, dealt over tasks, give the normaliser of every context, so all token probabilities sum to one.

Words outside a bounded broadcast table of frequent words meet their counts in a join; these are rare by
construction, so none of them is hot.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barrspark.llm.common import crc_bucket, materialize, word_chunks

#: Outputs of their own, classes for the other words, and the size of vectors.
OWN, CLASSES, DIM = 1024, 512, 16
#: Bounds on the broadcast table of frequent words; the most frequent longer ones are in it too, so that none of them is a hot key.
MAX_WORDS, MAX_WORD_BYTES, MAX_LONG, MAX_LONG_BYTES = 1 << 18, 48, 256, 1 << 16
#: Sixteenths of the training texts that each round learns from.
ROUNDS = ((0, 1), (1, 6), (6, 16))
#: Targets of a step, noise outputs that they share, noise outputs that each counts for, and the step size.
_BATCH, _NOISE, _K, _RATE = 1024, 128, 25, 0.1
_FLUSH = 400_000
END = b""


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (binary; the end is empty) and ``c`` over all rows of the binary column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return out

        for b in batches:
            for x in b.column(0):
                for words in word_chunks(x.as_py() or b""):
                    seen.update(words)
                seen[END] += 1
                if len(seen) > _FLUSH:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _class_of(word: bytes, own: int) -> int:
    return own + zlib.crc32(word[-2:]) % CLASSES


def _class_column(word: Column) -> Column:
    """The class of the word, by its last two bytes, counted from 0."""
    return F.pmod(F.crc32(F.substring(word, -2, 2)), F.lit(CLASSES)).cast("int")


@dataclass
class Vocabulary:
    """Frequent words with their counts; the first ``own`` are outputs of their own."""

    words: dict[bytes, int]
    counts: np.ndarray
    output: np.ndarray
    own: int
    class_mass: np.ndarray
    tokens: int
    distinct: int

    @property
    def outputs(self) -> int:
        return self.own + CLASSES


def vocabulary(counts: DataFrame) -> Vocabulary:
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    short = counts.where(F.length("word") <= MAX_WORD_BYTES)
    level = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    total, least = 0, None
    for bar in short.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        total += bar["n"]
        if total > MAX_WORDS:
            break
        least = bar["level"]
    kept = short.where(level >= least) if least is not None else short.limit(0)
    long = counts.where(F.length("word").between(MAX_WORD_BYTES + 1, MAX_LONG_BYTES))
    kept = kept.select("word", "c").union(long.orderBy(F.desc("c"), "word").limit(MAX_LONG).select("word", "c"))
    found = kept.repartition(max(1, counts.sparkSession.sparkContext.defaultParallelism)).toArrow()
    pairs = sorted(zip(found["word"].to_pylist(), found["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    own = min(OWN, len(pairs))
    words = {w: i for i, (w, _) in enumerate(pairs)}
    output = np.array([i if i < own else _class_of(w, own) for i, (w, _) in enumerate(pairs)], np.int64)
    mine = np.array([c for _, c in pairs], np.int64)
    # each class: counts plus one of its words, and one for all words that training lacks
    sums = counts.groupBy(_class_column(F.col("word")).alias("k")).agg(F.sum(F.col("c") + 1).alias("m"))
    mass = np.ones(CLASSES)
    for r in sums.collect():
        mass[r["k"]] += r["m"]
    for i in range(own):
        mass[_class_of(pairs[i][0], 0)] -= mine[i] + 1
    return Vocabulary(words, mine, output, own, mass, int(tokens), int(distinct))


def _tokenised(vocab) -> object:
    """Per text: outputs (with the end), sums over its frequent words, and its other words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        look, outs = v.words.get, np.append(v.output, 0)
        logc = np.append(np.log10(v.counts + 1.0), 0.0)
        inside = np.zeros(len(v.counts) + 1)
        rest = v.output >= v.own
        inside[:-1][rest] = logc[:-1][rest] - np.log10(v.class_mass[v.output[rest] - v.own])
        end = look(END, -1)
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for x in b.column(b.schema.get_field_index("text")):
                n, known, base, within, parts, tail = 0, 0, 0.0, 0.0, [], Counter()
                for words in _with_end(x.as_py() or b""):
                    idx = np.fromiter((look(w, -1) for w in words), np.int64, len(words)) if words is not None else np.array([end])
                    o = outs[idx]
                    for at in np.flatnonzero(idx < 0).tolist():
                        w = words[at] if words is not None else END
                        o[at] = _class_of(w, v.own)
                        tail[w] += 1
                    n, known = n + len(idx), known + int((idx >= 0).sum())
                    base, within = base + float(logc[idx].sum()), within + float(inside[idx].sum())
                    parts.append(o.astype("<u2").tobytes())
                for c, val in zip(cols, (n, known, base, within, b"".join(parts), list(tail), list(tail.values())), strict=True):
                    c.append(val)
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", "within", "outputs", "tail", "times"],
            )

    return run


def _with_end(text: bytes) -> Iterator[list[bytes] | None]:
    """Lists of words, then one None for the end."""
    for words in word_chunks(text):
        if words:
            yield words
    yield None


@dataclass
class Model:
    """Vectors of contexts ``r`` and outputs ``q``, the places' matrices ``c`` and the biases ``b``."""

    r: np.ndarray
    q: np.ndarray
    c: np.ndarray
    b: np.ndarray

    @staticmethod
    def start(prior: np.ndarray, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        n = len(prior)
        return Model(rng.normal(0, 0.1, (n, DIM)), rng.normal(0, 0.1, (n, DIM)), np.stack([np.eye(DIM), np.eye(DIM) * 0.5]), np.log(prior))

    @property
    def parts(self) -> tuple[np.ndarray, ...]:
        return self.r, self.q, self.c, self.b

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts])

    @staticmethod
    def of(flat: np.ndarray, n: int) -> Model:
        cuts = np.cumsum([n * DIM, n * DIM, 2 * DIM * DIM])
        r, q, c, b = np.split(flat.astype(np.float32), cuts)
        return Model(r.reshape(n, DIM), q.reshape(n, DIM), c.reshape(2, DIM, DIM), b)

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """Logit shares of both places, ``[context, output]``; that of the nearer holds the biases."""
        near, far = (self.r @ m.T @ self.q.T for m in self.c)
        return near + self.b, far


def normalisers(spark: SparkSession, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Log normaliser of every context, ``[nearer, farther]``; each task takes some of the nearer outputs."""
    n, shared = len(near), spark.sparkContext.broadcast((near, far))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far = shared.value
        for b in batches:
            out = []
            for i in b.column(0).to_pylist():
                s = near[i] + far  # all contexts whose nearer word is i
                top = s.max(axis=1)
                s -= top[:, None]
                out.append((top + np.log(np.exp(s, out=s).sum(axis=1))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["i", "z"])

    tasks = max(1, min(n, spark.sparkContext.defaultParallelism))
    rows = spark.range(0, n, 1, tasks).mapInArrow(run, "i long, z binary").toArrow()
    out = np.empty((n, n), np.float32)
    for i, z in zip(rows["i"].to_pylist(), rows["z"].to_pylist(), strict=True):
        out[i] = np.frombuffer(z, np.float32)
    return out


def _scatter(n: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    flat = (at[:, None] * DIM + np.arange(DIM)).ravel()
    return np.bincount(flat, rows.ravel(), n * DIM).reshape(n, DIM)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def nce_step(m: Model, past: Model, w1: np.ndarray, w2: np.ndarray, w: np.ndarray, noise: np.ndarray, logq: np.ndarray) -> None:
    """One step on a batch: nearer and farther context, targets, and shared noise outputs; ``past`` sums squares of gradients."""
    n = len(m.b)
    r1, r2 = m.r[w1], m.r[w2]
    h = r1 @ m.c[0].T + r2 @ m.c[1].T
    q, qn = m.q[w], m.q[noise]
    gd = _sigmoid((h * q).sum(1) + m.b[w] - logq[w]) - 1
    gn = _sigmoid(h @ qn.T + m.b[noise] - logq[noise]) * np.float32(_K / len(noise))
    dh = gd[:, None] * q + gn @ qn
    grads = (
        _scatter(n, np.concatenate([w1, w2]), np.concatenate([dh @ m.c[0], dh @ m.c[1]])),
        _scatter(n, np.concatenate([w, noise]), np.concatenate([gd[:, None] * h, gn.T @ h])),
        np.stack([dh.T @ r1, dh.T @ r2]),
        np.bincount(np.concatenate([w, noise]), np.concatenate([gd, gn.sum(0)]), n),
    )
    for x, s, g, rate in zip(m.parts, past.parts, grads, (_RATE, _RATE, _RATE / 10, _RATE), strict=True):
        s += g * g
        x -= rate * g / np.sqrt(s)


def _contexts(seq: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    pad = np.concatenate([[end, end], seq])
    return pad[1:-1], pad[:-2]


def _train_round(start: np.ndarray, prior: np.ndarray, end: int):
    """``start``: parameters, then sums of squares of gradients."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(prior)
        (m, past), logq = (Model.of(x, n) for x in np.split(start, 2)), np.log(_K * prior).astype(np.float32)
        cum, rng, tokens = np.cumsum(prior), np.random.default_rng(11), 0
        held: list[list[np.ndarray]] = [[], [], []]
        waiting = 0

        def learn(last: bool) -> None:
            nonlocal waiting, held
            w, w1, w2 = (np.concatenate(x) if x else np.empty(0, np.int64) for x in held)
            at = 0
            while at < len(w) and (last or len(w) - at >= _BATCH):
                s = slice(at, at + _BATCH)
                noise = np.minimum(np.searchsorted(cum, rng.random(_NOISE)), n - 1)
                nce_step(m, past, w1[s], w2[s], w[s], noise, logq)
                at += _BATCH
            held = [[w[at:]], [w1[at:]], [w2[at:]]]
            waiting = len(w[at:])

        for b in batches:
            for x in b.column(0):
                seq = np.frombuffer(x.as_py(), "<u2").astype(np.int64)
                w1, w2 = _contexts(seq, end)
                for h, v in zip(held, (seq, w1, w2), strict=True):
                    h.append(v)
                tokens, waiting = tokens + len(seq), waiting + len(seq)
                if waiting >= 32 * _BATCH:
                    learn(False)
        learn(True)
        if tokens:
            flat = np.concatenate([m.flat(), past.flat()]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([flat], pa.list_(pa.float64()))], ["tokens", "params"])

    return run


def _end_output(vocab: Vocabulary) -> int:
    return int(vocab.output[vocab.words[END]]) if END in vocab.words else _class_of(END, vocab.own)


def train(tokenised: DataFrame, vocab: Vocabulary) -> Model:
    """The model, from the ``outputs`` of all rows that are known not to be held out."""
    prior = np.full(vocab.outputs, 1.0)
    np.add.at(prior, vocab.output[: vocab.own], vocab.counts[: vocab.own])
    prior[vocab.own :] += vocab.class_mass
    prior /= prior.sum()
    first = Model.start(prior).flat()
    flat = np.concatenate([first, np.full(len(first), 1e-3)])
    slot = F.pmod(F.xxhash64("outputs"), F.lit(ROUNDS[-1][1]))
    for low, high in ROUNDS:
        mine = tokenised.where("not held_out").where((slot >= low) & (slot < high)).select("outputs")
        parts = mine.mapInArrow(_train_round(flat, prior, _end_output(vocab)), "tokens long, params array<double>")
        each = parts.select("tokens", F.posexplode("params").alias("i", "x"))
        mean = each.groupBy("i").agg((F.sum(F.col("x") * F.col("tokens")) / F.sum("tokens")).alias("x"))
        got = mean.toArrow()
        if got.num_rows:
            flat = flat.copy()
            flat[got["i"].to_numpy()] = got["x"].to_numpy()
    return Model.of(flat[: len(first)], vocab.outputs)


def _log_probabilities(tables, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far, z = tables.value
        for b in batches:
            out = []
            for x in b.column(b.schema.get_field_index("outputs")):
                total, before = 0.0, np.array([end, end])
                raw = np.frombuffer(x.as_py(), "<u2")
                for at in range(0, len(raw), 1 << 16):
                    seq = np.concatenate([before, raw[at : at + (1 << 16)].astype(np.int64)])
                    w, w1, w2 = seq[2:], seq[1:-1], seq[:-2]
                    total += float((near[w1, w] + far[w2, w] - z[w1, w2]).sum(dtype=np.float64))
                    before = seq[-2:]
                out.append(total / np.log(10))
            keep = [i for i, name in enumerate(b.schema.names) if name != "outputs"]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(out, pa.float64())], [*[b.schema.names[i] for i in keep], "model"])

    return run


def score_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = 7, held: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Rows whose crc32(id as text) mod ``folds`` is ``held``, and rows without an id (``held_out`` null), are not learnt
    from. Null texts are empty: one token, the end. Scores are log10 probabilities of the whole text.
    Words that training lacks share one word's place in their class. Repeated rows count and return as often as they
    occur; other columns are not read; where nothing is learnt, all counts are zero.
    """
    sc = docs.sparkSession.sparkContext
    bucket = crc_bucket(F.col(doc_id), folds)
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (bucket == held).alias("held_out"), F.col(text).cast("binary").alias("text"))
    counts = materialize(word_counts(read.where("not held_out")), "wordcounts")
    vocab = vocabulary(counts)
    shared = sc.broadcast(vocab)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, within double, outputs binary, tail array<binary>, times array<long>"
    tokenised = materialize(read.mapInArrow(_tokenised(shared), schema).withColumn("rid", F.monotonically_increasing_id()), "tokenised")
    model = train(tokenised.select("held_out", "outputs"), vocab)
    near, far = model.shares()
    # the nearer share is read by [nearer, output], the normaliser by [nearer, farther]
    tables = sc.broadcast((near, far, normalisers(docs.sparkSession, near, far)))
    scored = tokenised.drop("tail", "times").mapInArrow(
        _log_probabilities(tables, _end_output(vocab)), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, within double, rid long, model double"
    )
    log_mass = F.array(*[F.lit(float(x)) for x in np.log10(vocab.class_mass)])
    rare = tokenised.select("rid", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("rid", F.col("t.tail").alias("word"), "t.times")
    rare = rare.join(counts, "word", "left").withColumn("logc", F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0)))
    rare = rare.withColumn("inside", F.col("logc") - F.get(log_mass, _class_column(F.col("word"))))
    sums = rare.groupBy("rid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("k"),
        F.sum(F.col("times") * F.col("logc")).alias("b"),
        F.sum(F.col("times") * F.col("inside")).alias("w"),
    )
    log_n = float(np.log10(vocab.tokens + vocab.distinct + 1))
    return scored.join(sums, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0)) - F.col("n_tokens") * log_n).alias("base_score"),
        (F.col("model") + F.col("within") + F.coalesce("w", F.lit(0.0))).alias("score"),
    )
