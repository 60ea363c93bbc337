"""Near-duplicate embeddings by collision-counting projections.

Vectors are scaled to length one and projected on many random (Gaussian) directions. A pair collides
in a projection if one lies in the window of fixed half-width around the other, the query. For a pair at the
threshold cosine the difference is normal with a known deviation, so that the number of collisions
is binomial, and the least count that loses fewer than ``MISSES`` of such pairs is computed exactly. Pairs
that reach it are verified by their cosine in double precision.

The vectors of one label are sorted by their first projection (on a unit vector) into blocks of
bounded size. Two blocks meet only if their ranges come within the distance that no linked pair can
exceed. Within a pair of blocks, counts are taken in bytes; what leaves it is each vector's number of
links and a spanning forest, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrspark.llm.common import materialize
from barrspark.llm.components import connected_components

COSINE = 0.93
PROJECTIONS = 48
#: Half-width of the window, in deviations of a pair at the threshold.
WINDOW = 1.5
#: Share of pairs at the threshold that the count may lose.
MISSES = 1e-9
BLOCK_ROWS = 1024
_STEPS, _CLIP, _SEED = 254, 4.0, 20240229


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng([_SEED, dim]).standard_normal((dim, PROJECTIONS))


def calibration(cosine: float) -> tuple[int, int]:
    """Half-width of the window in steps, and the least count of collisions."""
    far, step = math.sqrt(2 - 2 * cosine), 2 * _CLIP / _STEPS
    width = math.ceil(WINDOW * far / step) + 1  # one step more, as both ends are rounded
    p = math.erf((width - 1) * step / far / math.sqrt(2)) if far else 1.0
    below, count = 0.0, 0
    while count < PROJECTIONS:
        below += math.comb(PROJECTIONS, count) * p**count * (1 - p) ** (PROJECTIONS - count)
        if below > MISSES:
            break
        count += 1
    return width, count


def _quantised(unit: np.ndarray) -> np.ndarray:
    """Projections in steps, one row a direction; clipping only brings two of them nearer."""
    p = np.clip(unit @ directions(unit.shape[1]), -_CLIP, _CLIP)
    return np.ascontiguousarray(np.rint((p + _CLIP) * (_STEPS / (2 * _CLIP))).astype(np.uint8).T)


def links(a: np.ndarray, b: np.ndarray, cosine: float = COSINE) -> np.ndarray:
    """Boolean matrix of linked rows of two blocks of unit vectors."""
    width, least = calibration(cosine)
    qa, qb, out = _quantised(a), _quantised(b), np.zeros((len(a), len(b)), bool)
    for at in range(0, len(a), 64):
        part = slice(at, at + 64)
        count = np.zeros((len(a[part]), len(b)), np.uint8)
        for x, y in zip(qa, qb, strict=True):
            count += (x[part, None] - y[None, :] + np.uint8(width)) <= np.uint8(2 * width)
        i, j = np.nonzero(count >= least)
        if len(i) * 8 > count.size:
            out[part] = (count >= least) & (a[part] @ b.T >= cosine)
        else:
            for s in range(0, len(i), 1 << 14):
                k, m = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
                near = np.einsum("ij,ij->i", a[at + k], b[m]) >= cosine
                out[at + k[near], m[near]] = True
    return out


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    v = np.frombuffer(raw, np.float64).reshape(-1, dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # keeps squares finite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _packed(embedding: pa.Array, labels: pa.Array) -> list[bytes | None]:
    """A vector's doubles as bytes; none if it can't be compared."""
    out: list[bytes | None] = []
    for e, label in zip(embedding, labels, strict=True):
        x = e.as_py() if label.is_valid and e.is_valid else None
        if not x or None in x:
            out.append(None)
            continue
        v = np.array(x, np.float64)
        out.append(v.tobytes() if np.isfinite(v).all() and v.any() else None)
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        vec = _packed(b.column(2), b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vec, pa.binary())], ["vec_id", "label", "vec"])


def _first_projection(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dims, place = [], []
        for x in b.column(b.schema.get_field_index("vec")):
            v = _matrix(x.as_py(), len(x.as_py()) // 8)
            g = directions(v.shape[1])[:, 0]
            dims.append(v.shape[1])
            place.append(float(v[0] @ (g / np.linalg.norm(g))))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims, pa.int32()), pa.array(place, pa.float64())], [*b.schema.names, "dim", "place"])


_BLOCK = "label string, dim int, lo double, hi double, cls binary, sizes binary, vecs binary"


def _blocks(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            label, dim = held[0][:2]
            place = [r[2] for r in held]
            values = [label, dim, min(place), max(place), np.array([r[3] for r in held], np.int64).tobytes(), np.array([r[4] for r in held], np.int64).tobytes(), b"".join(r[5] for r in held)]
            types = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [x.split()[0] for x in _BLOCK.split(", ")])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (len(held) >= rows or held[0][:2] != r[:2]):
                    yield block()
                held.append(r)
        if held:
            yield block()

    return run


def _meet(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, same, ca, sa, va, cb, sb, vb in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = [np.frombuffer(x, np.int64) for x in (ca, cb)]
                sizes = [np.frombuffer(x, np.int64) for x in (sa, sb)]
                hit = links(_matrix(va, dim), _matrix(vb, dim), cosine)
                if same:
                    np.fill_diagonal(hit, False)
                    hit |= hit.T
                    cls, n = ids[0], hit @ sizes[0]
                    i, j = np.nonzero(hit)
                else:
                    cls, n = np.concatenate(ids), np.concatenate([hit @ sizes[1], hit.T @ sizes[0]])
                    i, j = np.nonzero(hit)
                    j = j + len(ids[0])
                root = cls[_forest(len(cls), i, j)]
                some = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.array(root[some]), pa.array(n[some])], ["cls", "root", "n"])

    return run


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per input row.

    Vectors are linked if their labels and lengths are equal and their cosine is ``cosine`` or more. Null labels,
    and null, empty or zero vectors or such with null or non-finite components, link with nothing and are
    their own component. Equal vectors of a label are one class, compared once and counted by its size.
    A null id keeps its row and is nobody's component unless no id is reachable. Other columns are not read.
    """
    spark = vectors.sparkSession
    read = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("e")
    )
    packed = materialize(read.mapInArrow(_pack, "vec_id long, label string, vec binary"), "vectors")
    classes = packed.where("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    placed = classes.select("label", "cls", "size", "vec").mapInArrow(_first_projection, "label string, cls long, size long, vec binary, dim int, place double")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = materialize(placed, "placed").repartitionByRange(parts, "label", "dim", "place").sortWithinPartitions("label", "dim", "place")
    blocks = ordered.select("label", "dim", "place", "cls", "size", "vec").mapInArrow(_blocks(block_rows), _BLOCK)
    blocks = materialize(blocks.withColumn("block", F.monotonically_increasing_id()), "vectorblocks")
    meta = blocks.select("label", "dim", "lo", "hi", "block")
    reach = math.sqrt(2 - 2 * cosine) * (1 + 1e-9)
    other = meta.select(*[F.col(c).alias(f"{c}_b") for c in meta.columns])
    near = (F.col("lo_b") <= F.col("hi") + reach) & (F.col("lo") <= F.col("hi_b") + reach)
    pairs = meta.join(other, (F.col("label") == F.col("label_b")) & (F.col("dim") == F.col("dim_b")) & (F.col("block") <= F.col("block_b")) & near)
    data = blocks.select("block", "cls", "sizes", "vecs")
    pairs = materialize(pairs.select("dim", "block", "block_b"), "blockpairs").join(data, "block")
    pairs = pairs.join(data.select(*[F.col(c).alias(f"{c}_b") for c in data.columns]), "block_b")
    # few rows of large binaries: short Arrow batches by spreading them
    pairs = pairs.repartition(parts, "block", "block_b")
    met = pairs.select("dim", (F.col("block") == F.col("block_b")).alias("same"), "cls", "sizes", "vecs", "cls_b", "sizes_b", "vecs_b")
    found = materialize(met.mapInArrow(_meet(cosine), "cls long, root long, n long"), "links")
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    joined = connected_components(found.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    known = classes.join(counts, "cls", "left").join(joined.withColumnRenamed("node", "cls"), "cls", "left")
    known = materialize(known.withColumn("component", F.coalesce("component", "cls")), "classlinks")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("label", "vec", "component_id", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    linked = packed.where("vec is not null").join(materialize(known, "classresult"), ["label", "vec"])
    alone = packed.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
