"""SimHash near-deduplication by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at three or fewer differing bits meet at a variant that lies within half
the radius of each. As a pair at odd distance has one fingerprint of even and one of odd parity:

* every fingerprint emits its 64 variants at one bit (two of the same parity at distance two meet);
* one of even parity also emits itself (distance one) and its variants at two bits of one 32-bit
  half (distance three: of three differing bits, two lie in one half, and the odd one flips the
  third).

Variants are dealt to buckets by a hash of the variant. All fingerprints in one variant's group that
holds an odd one differ from that one by at most three bits, so verified edges to it keep every
group connected without emitting its pairs. A variant has at most 64 + 993 emitters, as equal
fingerprints are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barrspark.llm.common import give_back, materialize, numbered_rows, small_batches, word_chunks
from barrspark.llm.components import connected_components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Variants that one bucket should hold, a bound on the memory of a task.
BUCKET_VARIANTS = 400_000
_ONE = np.uint64(1) << np.arange(64, dtype=np.uint64)
_HALF = [(i, j) for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)]
_TWO = np.array([(1 << i) | (1 << j) for i, j in _HALF], dtype=np.uint64)
#: Masks by code: 64 single bits, none, then pairs of bits of one half.
MASKS = np.concatenate([_ONE, np.zeros(1, np.uint64), _TWO])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _shingle_hashes(text: bytes, width: int, seed: int) -> Iterator[np.ndarray]:
    digest, carry, any_yet = xxhash.xxh64_intdigest, [], False
    for words in word_chunks(text):
        words = carry + words
        if len(words) >= width:
            any_yet = True
            grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            yield np.fromiter((digest(g, seed) for g in grams), np.uint64, len(words) - width + 1)
            carry = words[len(words) - width + 1 :] if width > 1 else []
        else:
            carry = words
    if carry and not any_yet:
        yield np.array([digest(b" ".join(carry), seed)], np.uint64)


def simhash(text: bytes | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of a UTF-8 text as an unsigned number; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in _shingle_hashes(text or b"", width, seed):
        n += len(hashes)
        for at in range(0, len(hashes), 1 << 15):
            part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.bitwise_or.reduce(_ONE[2 * ones > n], initial=np.uint64(0))) if n else 0


def fingerprints(docs: DataFrame, text: str, doc_id: str, width: int = SHINGLE, seed: int = SEED, row: str | None = None) -> DataFrame:
    """``doc_id, fp`` (a signed long) of every row; with ``row``, a column of row numbers, also ``row``."""
    small_batches(docs.sparkSession)
    more = [F.col(row).alias("row")] if row else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty(b.num_rows, np.uint64)
            for i, x in enumerate(b.column(1)):
                out[i] = simhash(x.as_py(), width, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", "row"][: b.num_columns])
            del b
            give_back()

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), *more)
    return read.mapInArrow(run, "doc_id long, fp long" + ", row long" * len(more))


def _deal(n_buckets: int, step: int = 512):
    """Emits every variant: rows of a bucket with packed fingerprints and mask codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(fps), step):
                part = fps[at : at + step]
                even = np.bitwise_count(part) % 2 == 0
                fp = np.concatenate([np.repeat(part[even], len(MASKS)), np.repeat(part[~even], 64)])
                code = np.concatenate(
                    [np.tile(np.arange(len(MASKS), dtype=np.uint16), even.sum()), np.tile(np.arange(64, dtype=np.uint16), (~even).sum())]
                )
                bucket = (((fp ^ MASKS[code]) * _MIX) >> np.uint64(33)) % np.uint64(n_buckets)
                order = np.argsort(bucket, kind="stable")
                fp, code, bucket = fp[order], code[order], bucket[order]
                ends = np.flatnonzero(np.diff(bucket, append=np.uint64(n_buckets)) != 0) + 1
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                rows = [(int(bucket[s]), fp[s:e].tobytes(), code[s:e].tobytes()) for s, e in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32())]
                    + [pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2)],
                    ["bucket", "fps", "codes"],
                )

    return run


def _edges_of(fp: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified edges, without repeats, that keep each variant's group connected."""
    variant = fp ^ MASKS[code]
    odd = np.bitwise_count(fp) % 2 == 1
    order = np.lexsort((~odd, variant))  # in each group the odd ones come first
    variant, fp, odd = variant[order], fp[order], odd[order]
    first = np.concatenate([[True], variant[1:] != variant[:-1]])
    head = np.maximum.accumulate(np.where(first, np.arange(len(fp)), 0))
    # a group of an odd variant has only even fingerprints at one bit, two bits apart
    linked = ~first & (odd[head] | (np.bitwise_count(variant) % 2 == 1))
    a, b = fp[head[linked]], fp[linked]
    near = np.bitwise_count(a ^ b) <= RADIUS
    pairs = np.unique(np.stack([np.minimum(a[near], b[near]), np.maximum(a[near], b[near])], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _meet(table: pa.Table) -> pa.Table:
    join = lambda name, kind: np.frombuffer(b"".join(chain(x.as_py() for x in table[name])), kind)
    fp, code = join("fps", np.uint64), join("codes", np.uint16)
    u, v = _edges_of(fp, code) if len(fp) else (fp, fp)
    del fp, code
    give_back()
    return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})


def near_edges(distinct: DataFrame, bucket_variants: int = BUCKET_VARIANTS) -> DataFrame:
    """Edges (``u``, ``v``) between the distinct fingerprints ``fp`` that keep all links connected."""
    n = distinct.count()
    n_buckets = max(1, min(2**30, -(-n * (64 + len(MASKS)) // 2 // bucket_variants)))
    # fingerprints are small and their variants are not: as many tasks emit as there are buckets
    dealt = distinct.select("fp").repartition(n_buckets, "fp").mapInArrow(_deal(n_buckets), "bucket int, fps binary, codes binary")
    return dealt.groupBy("bucket").applyInArrow(_meet, "u long, v long")


def _least_of_components(marked: DataFrame, least: Column, bucket_variants: int) -> DataFrame:
    """``fp, first, n``: for each fingerprint the least of its component by the aggregate ``least``, and the component's rows."""
    distinct = materialize(marked.groupBy("fp").agg(least.alias("least"), F.count("*").alias("m")), "distinctfps")
    linked = connected_components(near_edges(distinct, bucket_variants))
    labelled = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    labelled = materialize(labelled.withColumn("component", F.coalesce("component", "fp")), "labelledfps")
    firsts = labelled.groupBy("component").agg(F.min("least").alias("first"), F.sum("m").alias("n"))
    return materialize(labelled.join(firsts, "component").select("fp", "first", "n"), "fpcomponents")


def simhash_components(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_variants: int = BUCKET_VARIANTS
) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per input row.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` is the smallest id of the
    documents reachable by links of fingerprints at three or fewer differing bits. Null texts count
    as empty; texts without words have fingerprint zero and link like any other. A null id keeps its row
    and is no component id (null where a whole component has no id). Repeated rows are repeated in
    the result; other columns are not read; an empty table gives an empty table.
    """
    marked = materialize(fingerprints(docs, text, doc_id), "fingerprints")
    by_fp = _least_of_components(marked, F.min("doc_id"), bucket_variants)
    return marked.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component, with all its columns: one with the smallest id, a null id last.

    Rows are told apart by number, so that a row goes only for its own text; of rows that share an id one stays.
    """
    docs = numbered_rows(docs, "nearrows")
    marked = materialize(fingerprints(docs, text, doc_id, row="__row"), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    by_fp = _least_of_components(marked, least, BUCKET_VARIANTS).where("n > 1")
    gone = marked.join(by_fp, "fp").where("row <> first.row").select(F.col("row").alias("__row"))
    return docs.join(materialize(gone, "gone"), "__row", "left_anti").drop("__row")
