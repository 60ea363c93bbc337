"""Two-way spectral partition of the allele graph and the iterative removal of SNPs that it does not part.

The split maximises modularity by the sign of the leading eigenvector of B = A - k k' / 2m, found by power
iteration from a fixed start on B shifted to be positive. A step is one product of the edge table with a vector. As
the steps are many and small, a cluster (SNPs joined by shared cells) goes to one task by default, which makes its edges and
multiplies COO arrays in numpy; :func:`distributed_split` takes the same steps as joins for graphs that no task can hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrspark.operators.components import components
from barrspark.operators.concordance import both_ways, concordance

TOLERANCE, MAX_STEPS = 1e-10, 5000


def start_value(pos: int, allele: str) -> float:
    h = hashlib.md5(f"{pos}_{allele}".encode()).digest()
    return int.from_bytes(h[:6], "big") / 2**48 - 0.5


def leading_sides(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Side of each vertex, the first on side 0; all on side 0 where no split raises modularity."""
    k = np.bincount(src, w, n) + np.bincount(dst, w, n)
    two_m = k.sum()
    times = lambda x: np.bincount(src, w * x[dst], n) + np.bincount(dst, w * x[src], n) - k * (k @ x) / two_m
    shift = k.max() + (k * k).sum() / two_m
    x = start / np.linalg.norm(start)
    for _ in range(MAX_STEPS):
        y = times(x) + shift * x
        y /= np.linalg.norm(y)
        if np.abs(y - x).max() < TOLERANCE:
            x = y
            break
        x = y
    if x @ times(x) <= 1e-9 * shift:
        return np.zeros(n, int)
    side = (x > 0).astype(int)
    return side ^ side[0]


def graph_components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, src, low[dst])
        np.minimum.at(new, dst, low[src])
        new = np.minimum(new, new[new])
        if (new == low).all():
            return low
        low = new


def split_sides(names: pd.DataFrame, edges: pd.DataFrame, weighted: bool = True) -> np.ndarray:
    """Sides of ``names`` (``pos, allele`` in order). Without edges, references are on one side and alternatives on the other.

    Two components are the two sides.
    """
    n = len(names)
    if not n:
        return np.zeros(0, int)
    if not len(edges):
        return (names["allele"] != "ref").to_numpy().astype(int)
    at = {v: i for i, v in enumerate(zip(names["pos"], names["allele"], strict=True))}
    src = np.array([at[v] for v in zip(edges["src_pos"], edges["src_allele"], strict=True)])
    dst = np.array([at[v] for v in zip(edges["dst_pos"], edges["dst_allele"], strict=True)])
    w = edges["weight"].to_numpy(float) if weighted else np.ones(len(edges))
    comps = graph_components(n, src, dst)
    if len(set(comps)) == 2:
        return (comps != comps[0]).astype(int)
    start = np.array([start_value(p, a) for p, a in zip(names["pos"], names["allele"], strict=True)])
    return leading_sides(n, src, dst, w, start)


def split(names: DataFrame, edges: DataFrame, weighted: bool = True) -> DataFrame:
    """``pos, allele, side`` of one graph, computed in one task from its edge table."""
    v = names.select(F.lit(0).alias("g"), "pos", "allele")
    e = edges.select(F.lit(0).alias("g"), "src_pos", "src_allele", "dst_pos", "dst_allele", "weight")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["pos", "allele"], ascending=[True, False]).reset_index(drop=True)
        right = right.sort_values(["src_pos", "src_allele", "dst_pos", "dst_allele"])
        return pd.DataFrame({"pos": left["pos"], "allele": left["allele"], "side": split_sides(left, right, weighted)})

    return v.groupBy("g").cogroup(e.groupBy("g")).applyInPandas(run, "pos long, allele string, side int")


def distributed_split(names: DataFrame, edges: DataFrame, weighted: bool = True, steps: int = 200, tolerance: float = 1e-8) -> DataFrame:
    """The same split with every product as a join and a sum, for graphs beyond one task."""
    ways = both_ways(edges).withColumn("weight", F.col("weight") if weighted else F.lit(1.0)).cache()
    k = ways.groupBy(F.col("src_pos").alias("pos"), F.col("src_allele").alias("allele")).agg(F.sum("weight").alias("k"))
    value = F.udf(start_value, "double")
    x = names.select("pos", "allele").join(k, ["pos", "allele"], "left").withColumn("k", F.coalesce("k", F.lit(0.0))).withColumn("x", value("pos", "allele")).checkpoint()
    two_m, squares, top = x.agg(F.sum("k"), F.sum(F.col("k") * F.col("k")), F.max("k")).first()
    if not two_m:
        return names.select("pos", "allele", (F.col("allele") != "ref").cast("int").alias("side"))
    shift = top + squares / two_m
    value_at = 0.0
    for _ in range(steps):
        kx = x.agg(F.sum(F.col("k") * F.col("x"))).first()[0]
        to = x.select(F.col("pos").alias("dst_pos"), F.col("allele").alias("dst_allele"), F.col("x").alias("xd"))
        ax = ways.join(to, ["dst_pos", "dst_allele"]).groupBy(F.col("src_pos").alias("pos"), F.col("src_allele").alias("allele")).agg(F.sum(F.col("weight") * F.col("xd")).alias("ax"))
        y = x.join(ax, ["pos", "allele"], "left").withColumn("bx", F.coalesce("ax", F.lit(0.0)) - F.col("k") * F.lit(kx / two_m)).drop("ax")
        y = y.withColumn("y", F.col("bx") + F.lit(shift) * F.col("x")).checkpoint()
        norm, xx, xbx = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))), F.sum(F.col("x") * F.col("x")), F.sum(F.col("x") * F.col("bx"))).first()
        value_at = xbx / xx
        moved = y.agg(F.max(F.abs(F.col("y") / F.lit(norm) - F.col("x") / F.lit(xx**0.5)))).first()[0]
        x = y.select("pos", "allele", "k", (F.col("y") / F.lit(norm)).alias("x"))
        if moved < tolerance:
            break
    ways.unpersist()
    if value_at <= 1e-9 * shift:
        return x.select("pos", "allele", F.lit(0).alias("side"))
    first = x.orderBy("pos", F.desc("allele")).select("x").first()[0]
    return x.select("pos", "allele", ((F.col("x") > 0) != F.lit(first > 0)).cast("int").alias("side"))


def cell_edges(cell: np.ndarray, v: np.ndarray, n: np.ndarray, pos: np.ndarray, mode: str, at_once: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges of :func:`concordance` from rows of cell, vertex and count over 0; ``pos`` is that of each vertex, in order."""
    count = len(pos)
    order = np.lexsort((v, cell))
    cell, v, n = cell[order], v[order], n[order]
    later = np.searchsorted(cell, cell, side="right") - np.arange(len(cell)) - 1
    upto = np.cumsum(later)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([x for _, x in parts]), len(keys))

    a = 0
    while a < len(cell):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + at_once, side="right")))
        left = np.repeat(np.arange(a, b), later[a:b])
        right = left + 1 + np.arange(len(left)) - np.repeat(upto[a:b] - later[a:b] - (upto[a - 1] if a else 0), later[a:b])
        apart = pos[v[left]] != pos[v[right]]
        left, right = left[apart], right[apart]
        shared = {"binary": lambda: np.ones(len(left)), "cosine": lambda: n[left] * n[right], "overlap": lambda: np.minimum(n[left], n[right])}[mode]()  # noqa: B023
        found.append(merged([(v[left] * count + v[right], shared)]))
        if sum(len(k) for k, _ in found[1:]) > max(4 * at_once, len(found[0][0])):
            found = [merged(found)]
        a = b
    keys, shared = merged(found) if found else (np.zeros(0, np.int64), np.zeros(0))
    src, dst = keys // count, keys % count
    of = np.bincount(v, None if mode == "binary" else n if mode == "overlap" else n * n, count)
    by = np.sqrt(of[src]) * np.sqrt(of[dst]) if mode == "cosine" else np.minimum(of[src], of[dst])
    return src, dst, shared / by


def cluster_sides(pos: np.ndarray, alt: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sides of vertices in the order of position, the reference first; each cluster is split by itself.

    Alleles are in one cluster if edges, or being of one SNP, join them: nothing tells how two clusters lie to one another,
    and the best split of both together would be that into the two, which parts no SNP. The first of a cluster is on side 0.
    """
    n = len(pos)
    twin = np.flatnonzero(pos[1:] == pos[:-1])
    comps = graph_components(n, src, dst)
    cluster = graph_components(n, np.concatenate([src, twin]), np.concatenate([dst, twin + 1]))
    sides = alt.astype(int)  # of SNPs without edges
    order, edge_order = np.argsort(cluster, kind="stable"), np.argsort(cluster[src], kind="stable")
    at = np.empty(n, np.int64)
    src, dst, w = src[edge_order], dst[edge_order], w[edge_order]
    of_edge, sorted_clusters = cluster[src], cluster[order]
    for c in np.unique(of_edge):
        own = order[np.searchsorted(sorted_clusters, c) : np.searchsorted(sorted_clusters, c, side="right")]
        e = slice(np.searchsorted(of_edge, c), np.searchsorted(of_edge, c, side="right"))
        at[own] = np.arange(len(own))
        if len(np.unique(comps[own])) == 2:
            sides[own] = comps[own] != comps[own[0]]
            continue
        start = np.array([start_value(p, "alt" if a else "ref") for p, a in zip(pos[own].tolist(), alt[own].tolist(), strict=True)])
        sides[own] = leading_sides(len(own), at[src[e]], at[dst[e]], w[e], start)
    return sides


def settled(pos: np.ndarray, alt: np.ndarray, cell: np.ndarray, n: np.ndarray, mode: str, weighted: bool, max_rounds: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Position, alternative or not, side, and whether its SNP goes, of all vertices round by round until no SNP goes."""
    for _ in range(max_rounds):
        if not len(pos):
            return
        names, v = np.unique(np.column_stack([pos, alt]), axis=0, return_inverse=True)
        v, p, a = v.reshape(-1), names[:, 0], names[:, 1].astype(bool)
        seen = n > 0
        src, dst, w = cell_edges(cell[seen], v[seen], n[seen].astype(float), p, mode)
        side = cluster_sides(p, a, src, dst, w if weighted else np.ones(len(w)))
        gone = np.zeros(len(p), bool)
        twin = np.flatnonzero((p[1:] == p[:-1]) & (side[1:] == side[:-1]))
        gone[twin] = gone[twin + 1] = True
        yield p, a, side, gone
        if not gone.any():
            return
        keep = ~gone[v]
        pos, alt, cell, n = pos[keep], alt[keep], cell[keep], n[keep]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each position of a task with the least one that its cells join it to."""
    table = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.record_batch([pa.array([], pa.string()), pa.array([], pa.int64())], ["cell_barcode", "pos"])])
    if not table.num_rows:
        return
    cell = table.column("cell_barcode").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names, v = np.unique(table.column("pos").to_numpy(), return_inverse=True)
    low = graph_components(len(names) + int(cell.max()) + 1, v, len(names) + cell)[: len(names)]
    for i in range(0, len(names), 1 << 16):
        yield pa.record_batch([pa.array(names[i : i + (1 << 16)]), pa.array(names[low[i : i + (1 << 16)]])], ["pos", "root"])


def clusters(alleles: DataFrame) -> DataFrame:
    """``pos, cluster`` of the positions that are in a cell: those that a chain of shared cells joins have one cluster."""
    seen = alleles.where("n > 0 and cell_barcode is not null").select("cell_barcode", F.col("pos").cast("long").alias("pos"))
    spark = alleles.sparkSession
    # few tasks, as the positions of a task that its own cells don't join go on as rows
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    joined = seen.repartition(parts, "cell_barcode").mapInArrow(_forest, "pos long, root long").distinct().checkpoint()
    names = joined.select("pos", F.lit("").alias("allele")).distinct()
    edges = joined.where("pos <> root").select(F.col("root").alias("src_pos"), F.lit("").alias("src_allele"), F.col("pos").alias("dst_pos"), F.lit("").alias("dst_allele"), F.lit(1.0).alias("weight"))
    return components(names, edges).select("pos", F.col("component").alias("cluster"))


def unparted(sides: DataFrame) -> DataFrame:
    """Positions of which both alleles are on one side."""
    return sides.groupBy("pos").agg(F.count_distinct("side").alias("s"), F.count("*").alias("n")).where("s < 2 and n = 2").select("pos")


def _log_row(k: int, total: int, p: dict, removed: int, gone: dict) -> dict:
    return {
        "iteration": k, "snps_total": total, "p0_snps": p.get(0, 0), "p1_snps": p.get(1, 0), "repaired_total": 0, "repaired_to_p0": 0, "repaired_to_p1": 0,
        "removed_total": removed, "removed_p0": gone.get(0, 0), "removed_p1": gone.get(1, 0), "remaining_total": total - removed,
        "cross_pairs": total - removed, "removed_frac": removed / total if total else 0.0,
    }


def remove_unparted(alleles: DataFrame, mode: str = "binary", weighted: bool = True, max_rounds: int = 50, splitter=None) -> tuple[DataFrame, list[dict]]:
    """Splits the graph and drops the SNPs it does not part, until none is left to drop.

    Returns ``pos, allele, side`` of the last round, and a log row a round. Each cluster takes its rounds in one task, and
    one that has settled stays as it is; with a ``splitter`` the whole graph is split by it, and each round's result is a checkpoint.
    """
    if alleles.sparkSession.sparkContext.getCheckpointDir() is None:
        import tempfile

        alleles.sparkSession.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barrspark-"))
    if splitter is not None:
        return _remove_by(splitter, alleles, mode, weighted, max_rounds)
    rows = alleles.select(F.col("pos").cast("long").alias("pos"), (F.col("allele") != "ref").alias("alt"), "cell_barcode", F.col("n").cast("long").alias("n"))
    keyed = rows.join(clusters(alleles), "pos", "left").withColumn("cluster", F.coalesce("cluster", F.concat(F.col("pos").cast("string"), F.lit("_"))))

    def run(table: pa.Table) -> pa.Table:
        cell = table.column("cell_barcode").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.where(cell < 0, 0, table.column("n").fill_null(0).to_numpy())
        out = []
        for k, (pos, alt, side, gone) in enumerate(settled(table.column("pos").to_numpy(), table.column("alt").to_numpy(), cell, n, mode, weighted, max_rounds), 1):
            first = np.concatenate([[True], pos[1:] != pos[:-1]])
            last = np.full(len(pos), not gone.any())
            columns = {"round": np.full(len(pos), k, np.int32), "last": last, "first": first, "pos": pos, "allele": pa.array(np.where(alt, "alt", "ref"), pa.string()), "side": side.astype(np.int32), "gone": gone}
            out.append(pa.table(columns))
        return pa.concat_tables(out)

    rounds = keyed.select("cluster", "pos", "alt", "cell_barcode", "n").groupBy("cluster").applyInArrow(run, "round int, last boolean, first boolean, pos long, allele string, side int, gone boolean").checkpoint()
    top = rounds.agg(F.max(F.col("round") + F.col("gone").cast("int"))).first()[0] or 1
    if top > max_rounds:
        raise RuntimeError("the partition did not settle")
    ref, gone = F.col("allele") == "ref", F.col("gone")
    every = rounds.withColumn("k", F.explode(F.sequence("round", F.when(F.col("last"), top).otherwise(F.col("round")))))
    sums = every.groupBy("k").agg(
        F.count_if("first").alias("total"), F.count_if(F.col("first") & gone).alias("removed"),
        *[F.count_if(ref & (F.col("side") == i)).alias(f"p{i}") for i in (0, 1)], *[F.count_if(ref & gone & (F.col("side") == i)).alias(f"gone{i}") for i in (0, 1)],
    )
    by = {r["k"]: r for r in sums.collect()}
    log = [_log_row(k, r["total"], {0: r["p0"], 1: r["p1"]}, r["removed"], {0: r["gone0"], 1: r["gone1"]}) if (r := by.get(k)) else _log_row(k, 0, {}, 0, {}) for k in range(1, top + 1)]
    return rounds.where("last").select("pos", "allele", "side"), log


def _remove_by(splitter, alleles: DataFrame, mode: str, weighted: bool, max_rounds: int) -> tuple[DataFrame, list[dict]]:
    log: list[dict] = []
    now = alleles.checkpoint()
    for k in range(1, max_rounds + 1):
        names = now.select("pos", "allele").distinct()
        sides = splitter(names, concordance(now, mode), weighted).checkpoint()
        bad = unparted(sides).checkpoint()
        total, removed = names.select("pos").distinct().count(), bad.count()
        p = {r["side"]: r["n"] for r in sides.where("allele = 'ref'").groupBy("side").agg(F.count("*").alias("n")).collect()}
        gone = sides.where("allele = 'ref'").join(bad, "pos", "left_semi").groupBy("side").agg(F.count("*").alias("n")).collect()
        gone = {r["side"]: r["n"] for r in gone}
        log.append(_log_row(k, total, p, removed, gone))
        if not removed:
            return sides, log
        now = now.join(bad, "pos", "left_anti").checkpoint()
    raise RuntimeError("the partition did not settle")


def haplotypes(sides: DataFrame) -> DataFrame:
    """``pos, h1_allele``: side 0 is haplotype 1."""
    return sides.where("side = 0").select("pos", F.col("allele").alias("h1_allele"))
