"""Operators on hand-written rows."""

import gzip
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barrspark.functions import scalars as S
from barrspark.operators import activity, alleles, concordance, counting, downstream, filters, intervals, layers, matrices, partition, tagging, validation
from barrspark.schema import READS_DDL, VARIANTS_DDL
from barrspark.sources import bam, sinks, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    assert [one(spark, S.norm_gene(F.lit(g))) for g in (None, " . ", "-", "nan", "None", " Xist ")] == ["", "", "", "", "", "Xist"]
    assert one(spark, S.candidate_contigs(F.lit("MT"))) == ["MT", "chrMT", "chrM", "M"]
    assert one(spark, S.candidate_contigs(F.lit("chrX"))) == ["chrX", "X"]
    lo, hi = S.wilson(F.lit(8), F.lit(10))
    assert (one(spark, lo), one(spark, hi)) == (pytest.approx(0.49016, abs=1e-4), pytest.approx(0.94331, abs=1e-4))
    assert one(spark, S.wilson(F.lit(0), F.lit(0))[0]) is None
    assert one(spark, S.mean_of_known(F.lit(None).cast("double"), F.lit(1.0), F.lit(0.5))) == 0.75
    assert S.parse_region("chrX:1,000-2,000") == ("chrX", 1000, 2000) and S.parse_region("chrX") == ("chrX", 1, None)
    assert S.windows(12, 5) == [(1, 5), (6, 10), (11, 12)] and S.flag_mask() == 0xD04
    assert S.normalise_species(" GRCh38 ") == "human" and S.escape_params("strict") == ("strict", 0.2, 2)
    with pytest.raises(ValueError):
        S.normalise_species("newt")


@pytest.mark.parametrize(
    "gene, listed, kind, want",
    [
        (".", ["A"], "exact_overlap", "tsv_gene_blank"),
        ("", [], "none", "both_unannotated"),
        ("A", [], "none", "no_gtf_gene_near_position"),
        ("A", ["A", "B"], "nearest_within_max", "tsv_gene_matches_gtf"),
        ("a", ["A"], "within_slop", "tsv_gene_not_in_overlapping_or_slop_gtf_genes"),
        ("A", ["B"], "nearest_within_max", "tsv_gene_differs_from_nearest_gtf_gene"),
        ("A", ["B"], "none", "unclassified_conflict"),
    ],
)
def test_conflict_reason(spark, gene, listed, kind, want):
    names = F.array(*map(F.lit, listed)).cast("array<string>")
    assert one(spark, S.conflict_reason(F.lit(gene), names, F.lit(kind))) == want


def read(i, aligned, seq="ACGT", cb="c1", gn="G", flags=0, mapq=60, quals=(30, 30, 30, 30)):
    return (f"r{i}", "chrX", 9, flags, mapq, seq, list(quals) if quals else None, aligned, cb, gn, None, None, i)


def test_evidence_and_counts(spark):
    rows = [
        read(0, [(0, 9, "base")]), read(1, [(2, 9, "base")]), read(2, [(1, 9, "base")]), read(3, [(None, 9, "del")]), read(4, [(0, 9, "indel_anchor")]), read(5, [(None, 9, "refskip")]),
        read(6, [(0, 9, "base")], cb=None), read(7, [(0, 9, "base")], gn=None), read(8, [(0, 9, "base")], flags=0x400), read(9, [(0, 9, "base")], mapq=3), read(10, [(0, 9, "base")], quals=(3, 3, 3, 3)),
        read(11, [(0, 9, "base")], flags=0x200), read(12, [(0, 8, "base")]),
    ]
    variants = spark.createDataFrame([("chrX", 10, "A", ["g"], "s", [0, 1], True, 0), ("chrX", 10, "AT", ["G"], "s", [0, 1], True, 1), ("chrX", 9, "C", ["T"], "s", [1, 1], True, 2)], VARIANTS_DDL)
    sites = counting.snp_sites(variants, het_only=True)
    ev = counting.read_evidence(spark.createDataFrame(rows, READS_DDL), sites)
    assert {r.read_id: r.allele_class for r in ev.collect()} == {"r0": "ref", "r1": "alt", "r2": "other", "r3": "other", "r4": "other", "r7": "ref", "r11": "ref"}
    c = {r.gene: r for r in counting.allele_counts(ev).collect()}
    assert (c["G"].refCount, c["G"].altCount, c["G"].otherCount, c["G"].totalCount) == (2, 1, 3, 6) and c["."].refCount == 1
    assert counting.read_evidence(spark.createDataFrame(rows, READS_DDL), sites, skip_indels=True).count() == 5
    assert counting.read_evidence(spark.createDataFrame(rows, READS_DDL), sites, max_depth=3).count() == 3


def test_intervals(spark):
    genes = spark.createDataFrame(
        [("chrX", 90, 110, "in", "g1", "+"), ("chrX", 1099, 1200, "near", "g2", "+"), ("chrX", 10_000, 10_010, "tie1", "g3", "+"), ("chrX", 20_000, 20_010, "tie2", "g4", "+"), ("chrX", 90, 300, "in", "g1", "+")],
        "contig string, start long, end long, gene_name string, gene_id string, strand string",
    )
    pos = spark.createDataFrame([("X", 100), ("chrX", 15_005), ("chrX", 500), ("chrX", 40_000), ("chr1", 100), ("chrX", 2200)], "contig string, position long")
    got = {(r.contig, r.position): r for r in intervals.annotate_positions(pos, genes).collect()}
    assert (got["X", 100].gtf_gene, got["X", 100].gtf_match_type, got["X", 100].gtf_gene_n) == ("in", "exact_overlap", 1)
    assert (got["chrX", 500].gtf_gene, got["chrX", 500].gtf_match_type, got["chrX", 500].gtf_min_distance) == ("in;near", "within_slop", 200)
    assert (got["chrX", 15_005].gtf_gene, got["chrX", 15_005].gtf_match_type) == ("tie1;tie2", "nearest_within_max")
    assert got["chrX", 40_000].gtf_match_type == "none" and got["chr1", 100].gtf_gene_n == 0 and got["chrX", 40_000].gtf_min_distance is None
    assert "BroadcastNestedLoopJoin" not in intervals.annotate_positions(pos, genes)._jdf.queryExecution().toString()


def test_filters(spark):
    rows = [("c1", "chrX", 1, g, "A", "G", 1, 1, 2, 0, "x;y", "1;2", 2, True, "exact_overlap", 0, bad, r, not bad) for g, bad, r in (("x", False, "m"), ("y", False, "m"), ("z", True, "k"))]
    rows += [("c1", "chrX", 2, None, "A", "G", 1, 1, 2, 0, "x", "1", 1, False, "exact_overlap", 0, True, "k", False)]
    names = [*counting.COUNT_COLUMNS, *intervals.ANNOTATION_COLUMNS, "gtf_gene_conflict", "gtf_conflict_reason", "tsv_gene_in_gtf_list"]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=names))
    kept, dropped = filters.filter_counts(df)
    assert kept.count() == 0 and sorted(r.drop_reason for r in dropped.collect()) == ["gtf_gene_conflict"] * 2 + ["multi_tsv_gene_and_multi_gtf_gene"] * 2
    ev = spark.createDataFrame([("r1", "c1", "chrX", 2, None, "A", "G", "ref"), ("r2", "c2", "chrX", 2, None, "A", "G", "ref")], "read_id string, cell_barcode string, contig string, position long, gene string, refAllele string, altAllele string, allele_class string")
    assert [r.read_id for r in filters.dropped_evidence(ev, dropped).collect()] == ["r1"]
    assert {r.metric: r.value for r in filters.filter_summary(df, kept, dropped).collect()}["rows_removed"] == "4"
    assert filters.filter_counts(df, False, False)[1].count() == 0


def planted(seed=0, snps=60, cells=120, error=0.02):
    """Two haplotypes; each cell shows one of them, with errors."""
    rng = np.random.default_rng(seed)
    orient = rng.integers(0, 2, snps)
    rows = []
    for c in range(cells):
        active = rng.integers(0, 2)
        for s in np.flatnonzero(rng.random(snps) < 0.4):
            ref = (orient[s] == active) ^ (rng.random() < error)
            n = int(rng.integers(1, 4))
            rows.append((f"c{c}", "chrX", int(s) * 10, f"g{s % 20}", "A", "G", n * int(ref), n * int(not ref), n, 0))
    return rows, orient


def test_phasing_recovers_planted_haplotypes(spark):
    rows, orient = planted()
    std = alleles.standardise(spark.createDataFrame(rows, list(counting.COUNT_COLUMNS)))
    long = alleles.allele_cells(std)
    sides, log = partition.remove_unparted(long, "binary")
    got = {r.pos // 10: r.side for r in sides.where("allele = 'ref'").collect()}
    agree = np.mean([got[s] == orient[s] for s in got])
    assert len(got) >= 55 and max(agree, 1 - agree) >= 0.97
    assert log[-1]["removed_total"] == 0 and log[-1]["remaining_total"] == len(got)
    sums = alleles.cell_sums(std)
    counts = activity.haplotype_counts(sums, partition.haplotypes(sides))
    calls = activity.active_x(counts, alleles.best_gene(std), sums)
    assert calls.where("active_X in ('X1', 'X2')").count() >= 115
    scores = activity.orientation_scores(sums, calls)
    right = [r for r in scores.collect() if r.POS // 10 in got]
    assert np.mean([(r.best_orientation == "ref_h1") == (got[r.POS // 10] == 0) for r in right]) >= 0.97
    both = activity.xa_xi_reads(counts, calls).agg(F.sum("Xa_reads"), F.sum("Xi_reads")).first()
    assert both[0] > 10 * both[1]
    table = validation.haplotype_table(std, partition.haplotypes(sides).withColumns({"stage": F.lit("stage1"), "method": F.lit(None).cast("string")}), alleles.best_gene(std), alleles.snp_totals(std))
    assert {(r.H1, r.H2) for r in table.collect()} == {("A", "G"), ("G", "A")}


def test_distributed_split_agrees(spark):
    rows, _ = planted(1, 14, 40)
    long = alleles.allele_cells(alleles.standardise(spark.createDataFrame(rows, list(counting.COUNT_COLUMNS))))
    names, edges = long.select("pos", "allele").distinct(), concordance.concordance(long)
    a = {(r.pos, r.allele): r.side for r in partition.split(names, edges).collect()}
    b = {(r.pos, r.allele): r.side for r in partition.distributed_split(names, edges, steps=40).collect()}
    assert a == b


def test_each_cluster_is_split(spark):
    """Copies of a graph that share no cell keep the sides of the one, but for where a copy has its first reference."""
    rows, _ = planted(2, 12, 40, 0.0)
    noisy, _ = planted(3, 14, 60)
    long = lambda rows, shift: [(r[2] + shift, a, f"{r[0]}-{shift}", n) for r in rows for a, n in (("ref", r[6]), ("alt", r[7]))]
    frame = lambda x: spark.createDataFrame(x, "pos long, allele string, cell_barcode string, n long")
    one, other = partition.remove_unparted(frame(long(rows, 0)))[0], partition.remove_unparted(frame(long(noisy, 0)))
    a, b = ({(r.pos, r.allele): r.side for r in x.collect()} for x in (one, other[0]))
    assert len(a) == 24 and len(b) >= 24
    sides, log = partition.remove_unparted(frame([x for k in range(3) for x in long(rows, 1000 * k)] + long(noisy, 5000)))
    got = {(r.pos, r.allele): r.side for r in sides.collect()}
    assert got == {(p + 1000 * k, x): s for k in range(3) for (p, x), s in a.items()} | {(p + 5000, x): s for (p, x), s in b.items()}
    assert [r["remaining_total"] for r in log] == [36 + r["remaining_total"] for r in other[1]]
    by, whole = partition.remove_unparted(frame(long(noisy, 0)), splitter=partition.split)
    assert {(r.pos, r.allele): r.side for r in by.collect()} == b and whole == other[1]


@pytest.mark.parametrize("mode", concordance.MODES)
def test_cell_edges(spark, mode):
    rng = np.random.default_rng(5)
    rows = [(int(p), a, f"c{c}", int(rng.integers(1, 5))) for c in range(9) for p in rng.choice(20, 8, replace=False) for a in ("alt", "ref") if rng.random() < 0.7]
    names = sorted({(p, a) for p, a, *_ in rows}, key=lambda x: (x[0], x[1] == "alt"))
    v, pos = np.array([names.index((p, a)) for p, a, *_ in rows]), np.array([p for p, _ in names])
    cell, n = np.array([int(c[1:]) for *_, c, _ in rows]), np.array([float(x[3]) for x in rows])
    want = {((r.src_pos, r.src_allele), (r.dst_pos, r.dst_allele)): pytest.approx(r.weight) for r in concordance.concordance(spark.createDataFrame(rows, "pos long, allele string, cell_barcode string, n long"), mode).collect()}
    for at_once in (1, 20, 1 << 22):
        src, dst, w = partition.cell_edges(cell, v, n, pos, mode, at_once)
        assert {(names[a], names[b]): x for a, b, x in zip(src, dst, w, strict=True)} == want


def test_partition_metrics_without_pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(int(p), a, f"c{c}", 1) for c in range(9) for p in rng.choice(20, 8, replace=False) for a in ("alt", "ref") if rng.random() < 0.7]
    long = spark.createDataFrame(rows, "pos long, allele string, cell_barcode string, n long")
    sides = {(p, a): int(rng.integers(0, 2)) for p, a, *_ in rows}
    want = {p: [0.0, 0.0, 0, 0] for p, _ in sides}
    for r in concordance.both_ways(concordance.concordance(long)).collect():
        cross = int(sides[r.src_pos, r.src_allele] != sides[r.dst_pos, r.dst_allele])
        want[r.src_pos][cross] += r.weight
        want[r.src_pos][2 + cross] += 1
    out = validation.partition_metrics(long, spark.createDataFrame([(p, a, s) for (p, a), s in sides.items()], "pos long, allele string, side int"))
    assert "src_pos" not in out._jdf.queryExecution().toString()
    got = {r.POS: [r.within_weight, r.cross_weight, r.within_degree, r.cross_degree] for r in out.collect()}
    assert got == {p: pytest.approx(m) for p, m in want.items()}


@pytest.mark.parametrize("mode", concordance.MODES)
def test_concordance(spark, mode):
    m = {(1, "ref"): [2, 0, 3], (1, "alt"): [1, 1, 0], (2, "ref"): [0, 4, 1], (2, "alt"): [5, 0, 0]}
    rows = [(p, a, f"c{i}", n) for (p, a), v in m.items() for i, n in enumerate(v)]
    got = {(r.src_pos, r.src_allele, r.dst_pos, r.dst_allele): r.weight for r in concordance.concordance(spark.createDataFrame(rows, "pos long, allele string, cell_barcode string, n long"), mode).collect()}
    want = {}
    for a in ("ref", "alt"):
        for b in ("ref", "alt"):
            x, y = np.array(m[1, a]), np.array(m[2, b])
            w = {"binary": ((x > 0) & (y > 0)).sum() / min((x > 0).sum(), (y > 0).sum()), "cosine": x @ y / np.sqrt((x @ x) * (y @ y)), "overlap": np.minimum(x, y).sum() / min(x.sum(), y.sum())}[mode]
            if w > 0:
                want[1, a, 2, b] = pytest.approx(w)
    assert got == want


def test_votes_and_reads_by_one_shuffle(spark):
    rows = [(1, "a", 3, 0), (1, "b", 0, 2), (2, "a", 1, 4), (2, "b", 5, 1), (3, "a", 0, 9), (3, "c", 2, 0), (4, "c", 1, 3), (4, "d", 2, 2), (5, "e", 7, 1)]
    counts = spark.createDataFrame(rows, "POS long, cell_barcode string, h1 long, h2 long")
    genes = spark.createDataFrame([(1, "g"), (2, "g"), (4, "h"), (5, None)], "POS long, Gene string")  # 3 has no gene, 5 a null one: no votes
    out = activity.xa_xi_by_votes(counts, genes)
    assert out._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(cell_barcode") == 1
    want = activity.xa_xi_reads(counts, activity.active_x(counts, genes, counts))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and out.count() == 4


def test_counts_stay_dealt_by_position(spark, tmp_path):
    from barrspark.plans import proxies

    spark.createDataFrame([(7, 1, "A"), (7, 2, "N"), (7, 1, "R"), (8, 2, "A")], "l_partkey long, l_suppkey long, l_returnflag string").selectExpr("1L l_orderkey", "1 l_linenumber", "*").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, "x"), (8, "y")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sums = alleles.cell_sums(proxies.standard(spark, str(tmp_path)))
        plan = sums._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange ") == 2, "the join's two shuffles are the only ones"
    assert sorted(map(tuple, sums.collect())) == [(7, "C1", 1, 0), (7, "C2", 0, 1), (8, "C2", 1, 0)]


@pytest.mark.parametrize("mode", ["overlap", "cosine"])
def test_degrees_by_five_shuffles(spark, mode):
    """Both sides of the join of reads, positions by range, cells, blocks; counts aren't shuffled again by position and cell."""
    from barrspark.plans import queries

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.QUERIES[f"concordance_{mode}_degrees"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange ") == 5


@pytest.mark.parametrize("mode", concordance.MODES)
def test_degrees_without_pairs(spark, mode):
    rng = np.random.default_rng(3)
    rows = [(int(p) - 5, a, f"c{c}", int(rng.integers(0, 4))) for c in range(12) for p in rng.choice(40, 15, replace=False) for a in ("ref", "alt") if rng.random() < 0.7]
    long = spark.createDataFrame([*rows, (1, "ref", None, 5)], "pos long, allele string, cell_barcode string, n long").where("cell_barcode is not null")
    sides = {(p, a): int(rng.integers(0, 2)) for p, a in {(p, a) for p, a, *_ in rows if p != 3}}
    whole, parted = {}, {}
    for r in concordance.both_ways(concordance.concordance(long, mode)).collect():
        u, v = (r.src_pos, r.src_allele), (r.dst_pos, r.dst_allele)
        n, w = whole.get(u, (0, 0.0))
        whole[u] = n + 1, w + r.weight
        if u in sides and v in sides:
            m = parted.setdefault(u, [sides[u], 0, 0, 0.0, 0.0])
            m[1 + sides[v]] += 1
            m[3 + sides[v]] += r.weight
    out = concordance.degrees(long, mode)
    assert "Join" not in out._jdf.queryExecution().toString()  # no row is made for a pair
    assert {(r.pos, r.allele): (r.degree, r.strength) for r in out.collect()} == {u: (n, pytest.approx(w)) for u, (n, w) in whole.items()}
    named = spark.createDataFrame([(p, a, s) for (p, a), s in sides.items()], "pos long, allele string, side int")
    got = concordance.neighbours(long, mode, named).where("n_0 + n_1 > 0").collect()
    assert {(r.pos, r.allele): list(r)[2:] for r in got} == {u: pytest.approx(m) for u, m in parted.items()}


@pytest.mark.parametrize("mode", ["overlap", "cosine"])
def test_cells_of_all_blocks_in_few_bytes(spark, mode):
    """Cells spread over all positions go to all blocks; only the names of their alleles may go there more than once."""
    rng = np.random.default_rng(11)
    rows = [(int(p), a, f"c{c}", int(rng.integers(1, 4))) for c in range(60) for p in rng.choice(2000, 200, replace=False) for a in ("ref", "alt") if rng.random() < 0.7]
    out = concordance.degrees(spark.createDataFrame(rows, "pos long, allele string, cell_barcode string, n long"), mode)
    assert len(out.collect()) == len({x[:2] for x in rows})

    def sent(node):
        """Bytes of each shuffle, the last first."""
        name = node.nodeName()
        below = [node.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [node.plan()] if "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
        return [*([node.metrics().apply("dataSize").value()] if name == "Exchange" else []), *[x for b in below for x in sent(b)]]

    assert sent(out._jdf.queryExecution().executedPlan())[0] < 30 * len(rows)


@pytest.mark.parametrize("mode", ["overlap", "cosine"])
def test_degrees_by_small_shuffles(spark, mode, tmp_path):
    """Reads of neither allele aren't shuffled, positions go by their codes, and entries to their cells in packed pieces."""
    from barrspark.plans import queries

    rng = np.random.default_rng(5)
    rows = [(int(p), c, "ANR"[int(rng.integers(0, 3))]) for c in range(60) for p in rng.choice(500, 200, replace=False)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_returnflag string").selectExpr("1L l_orderkey", "1 l_linenumber", "*").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(500).selectExpr("id p_partkey", "'x' p_brand").write.parquet(f"{tmp_path}/part.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = queries.QUERIES[f"concordance_{mode}_degrees"](spark, str(tmp_path))
        got = out.count(), out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    some = [r for r in rows if r[2] != "R"]
    assert got[0] == len({(p, f) for p, _, f in some}) and all(r.degree > 0 for r in got[1])

    def sent(node):
        """Rows and bytes of each shuffle, the last first."""
        name, of = node.nodeName(), node.metrics()
        below = [node.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [node.plan()] if "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
        return [*([tuple(of.apply(m).value() for m in ("shuffleRecordsWritten", "dataSize"))] if name == "Exchange" else []), *[x for b in below for x in sent(b)]]

    _, cells, positions, reads, _ = sent(out._jdf.queryExecution().executedPlan())
    assert reads[0] == len(some)
    assert positions[1] <= 40 * len(some) and cells[1] < 16 * len(some)


def test_pieces_of_cells():
    """Entries come back as they were, whatever the width of their numbers and however few are unpacked at once."""
    cell = pa.array(["a", "b", "a", "c", "b", "a"])
    code, n, by, block = np.array([-3, -3, 0, 5, 1 << 40, 1 << 56]), np.array([1, 2, 300, 4, 5, 1 << 40]), np.array([7, 7, 1, 1, 1, 1 << 50]), 3
    for side in (np.zeros(6, np.int8), np.array([0, 1, 0, 0, 1, 1], np.int8)):
        rows = [concordance.pieces_of_cells(cell[i:j], *(x[i:j] for x in (code, n, by, side)), block) for i, j in ((0, 3), (3, 6))]
        pieces = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        for at_once in (1, 2, 100):
            got = [(c, *map(int, row)) for cells, starts, columns in concordance.entries_of_pieces(pieces.slice(0), at_once) for c, a, b in zip(cells.to_pylist(), starts, starts[1:], strict=False) for row in zip(*(x[a:b] for x in columns), strict=True)]
            assert sorted(got) == sorted((c, *map(int, row), block) for c, *row in zip(cell.to_pylist(), code, n, by, side, strict=True))
    assert list(concordance.entries_of_pieces(pieces.slice(0, 0))) == []


def test_messages_of_cells():
    """Gaps of any width, sides, and cells of one allele or one block come out as block_sums has them from the counts."""
    rng = np.random.default_rng(2)
    few = [rng.choice(30, m, replace=False) * far for m, far in ((1, 1), (9, 1), (20, 300), (12, 1 << 33), (30, 70_000), (2, 1 << 55))]
    cells = [np.sort(np.concatenate([2 * x, (2 * x + 1)[::2]])) for x in few]
    code, starts = np.concatenate(cells), np.cumsum([0, *map(len, cells)])
    block = np.searchsorted([50, 1 << 34], code).astype(np.int16)
    n = rng.integers(1, 4, len(code))
    for sides in (False, True):
        side = (code % 7 == 1).astype(np.int8) * sides
        for mode in concordance.MODES:
            parts = [[x[a:b] for x in (code, n, n + 2, side, block)] for a, b in zip(starts, starts[1:], strict=False)]
            sent = [m for p in parts for m in concordance.cell_messages(mode, *p)]
            for to in (0, 1, 2):
                mine = [m for m in sent if m[0] == to]
                own = [i for i, p in enumerate(parts) if to in p[4]]
                met = [np.concatenate([parts[i][k] for i in own]) for k in range(5)]
                want = concordance.block_sums(mode, to, np.cumsum([0, *(len(parts[i][0]) for i in own)]), *met)
                got = concordance.block_of_messages(pa.table([pa.array(x, t) for x, t in zip(zip(*mine, strict=True), concordance.SENT.types, strict=True)], schema=concordance.SENT))
                for x, y in zip(got, want, strict=True):
                    np.testing.assert_allclose(x, y, rtol=1e-12)


def test_block_sums_of_few_neighbours():
    code = np.array([0, 4, 2, 5, *range(100, 400, 2)])
    starts, one = np.array([0, 2, 4, len(code)]), np.ones(len(code), np.int64)
    blocks = np.array([0, 0, 0, 0, *[1] * 150])
    got = concordance.block_sums("binary", 0, starts, code, one, one, np.array([0, 1, 0, 1, *[0] * 150]), blocks)
    assert [x.tolist() for x in got] == [[0, 2, 4, 5], [0, 0, 1, 1], [0, 0, 1, 1], [1, 1, 0, 0], [0.0, 0.0, 1.0, 1.0], [1.0, 1.0, 0.0, 0.0]]


def test_tags_and_routes(spark):
    cases = [(1, "c1", 0, 0, 0), (2, "c1", 5, 1, 1), (3, "c1", 20, 12, 2), (4, "c1", 40, 1, 2), (5, "c2", 40, 1, 2), (6, "c3", 40, 1, 2), (7, None, 40, 1, 2), (8, "c9", 40, 1, 2), (9, None, 0, 0, 0), (10, "c9", 0, 0, 0), (11, "c1", 1, 50, 2)]
    reads = spark.createDataFrame([(i, cb) for i, cb, *_ in cases], "ordinal long, cb string")
    scores = spark.createDataFrame([(i, a, b, int(a > 0), int(b > 0), m) for i, _, a, b, m in cases], "ordinal long, MS long, NS long, MC long, NC long, MI long")
    calls = spark.createDataFrame([("c1", "X1", 0), ("c2", "X1", 0), ("c2", "X2", 1), ("c3", "X1/X2", 0)], "cell_barcode string, active_X string, ordinal long")
    got = {r.ordinal: (r.MA, r.XX) for r in tagging.tag(reads, scores, calls).collect()}
    assert got == {1: ("none", "none"), 2: ("low", "low"), 3: ("amb", "amb"), 4: ("H1", "Xa"), 5: ("H1", "Xi"), 6: ("H1", "unknown"), 7: ("H1", "no_CB"), 8: ("H1", "no_active_X"), 9: ("none", "no_CB"), 10: ("none", "no_active_X"), 11: ("H2", "Xi")}
    labels = {}
    for r in tagging.route(tagging.tag(reads, scores, calls)).collect():
        labels.setdefault(r.ordinal, []).append(r.label)
    assert labels[4] == ["X1", "Xa"] and labels[11] == ["X2", "Xi"] and labels[1] == ["unknown"] and labels[3] == ["amb"] and labels[7] == ["X1", "unknown"]
    assert len(tagging.route_counts(tagging.route(tagging.tag(reads, scores, calls))).collect()) == 7


def test_matrix_scaffold(spark):
    counts = spark.createDataFrame([("g1", "a", 2), ("g1", "a-1", 3), ("zz", "b-1", 1), ("g2", "x", 9)], "feature string, cell_barcode string, n long")
    order = spark.createDataFrame([("g2", 0), ("g1", 1)], "feature string, ordinal long")
    cells = spark.createDataFrame([("a-1", 0), ("b-1", 1)], "cell_barcode string, ordinal long")
    rows = matrices.wide(matrices.on_scaffold(counts, order, cells), order, ["a-1", "b-1"]).collect()
    assert [tuple(r) for r in rows] == [("g2", 0, 0), ("g1", 5, 0), ("zz", 0, 1)]
    assert matrices.matrix_name("split_Xa") == "Xa" and matrices.matrix_name("other", True) == "transcript_other"


def test_layers(spark):
    v = "gene string, cell string, value double"
    raw, xa, xi = (spark.createDataFrame(r, v) for r in ([("g", "c1", 4.0), ("h", "c1", 6.0)], [("g", "c1", 3.0)], [("g", "c1", 1.0)]))
    cells = spark.createDataFrame([("c1",), ("c2",)], "cell string")
    values, metrics = layers.x_layers(raw, xa, xi, cells, 100)
    m = {r.cell: r for r in metrics.collect()}
    assert (m["c1"].raw_total, m["c1"].Xai_total, m["c1"].allelic_imbalance_chrX) == (10, 40, 0.5) and m["c2"].allelic_imbalance_chrX is None
    assert {(r.layer, r.value) for r in values.collect()} >= {("Xa_Normalized", 30.0), ("Xai", 4.0)}
    assert layers.x_layers(raw, xa, None, cells)[1].columns == ["cell", "raw_total"]
    assert layers.matrix_specs(("/a/b", "n")) == [("/a/b", "n")] and layers.matrix_specs(["/a", ("/b", "x")]) == [("/a", "batch1"), ("/b", "x")]


def test_prior_and_patterns(spark):
    prior = lambda xs: downstream.beta_prior(spark.createDataFrame([(x,) for x in xs], "xi_raw double")).first()
    assert tuple(prior([])) == (2, 18, 0.1, None, "fallback_empty")
    assert prior([0.3]).method == "fallback_strength" and prior([0.3]).alpha == pytest.approx(6) and prior([0.3]).variance == 0
    assert prior([0.0, 1.0]).method == "fallback_strength" and prior([0.2, 0.2]).method == "fallback_strength"
    m, v = np.mean([0.1, 0.2, 0.4]), np.var([0.1, 0.2, 0.4], ddof=1)
    assert prior([0.1, 0.2, 0.4, 7.0]).alpha == pytest.approx(m * (m * (1 - m) / v - 1))
    kinds = [one(spark, downstream.pattern(F.lit(e), F.lit(e), F.lit(0))) for e in (0, 1, 2, 3, 5, 6)]
    assert kinds == ["does_not_pass_strict", "selective_strict", "selective_strict", "intermediate_strict", "intermediate_strict", "shared_constitutive"]
    assert one(spark, downstream.pattern(F.lit(3), F.lit(3), F.lit(0), require_non_escape=True, min_non_escape=1)) == "does_not_pass_strict"


def test_null_groups_stay(spark):
    cells = spark.createDataFrame([("a", "d", "t", None, None, "x"), ("b", "d", "t", None, None, "x")], "cell string, donor_id string, cell_type string, sample_group string, disease_group string, age_group string")
    values = spark.createDataFrame([("a", "g", 2, 3)], "cell string, gene_name string, xi long, xa long")
    r = downstream.atlas(values, cells, min_cells=1).first()
    assert (r.n_cells_total_group, r.total_allelic_reads, r.sample_group, r.informative_firstpass) == (2, 5, None, True)
    rows = downstream.row_filter(downstream.atlas(values, cells, min_cells=1), 3, 1)
    assert downstream.pooled(downstream.shrink(rows, downstream.beta_prior(rows))).count() == 1
    assert downstream.atlas(values, cells, values.select("gene_name"), keep_zero_rows=True).count() == 1


def write_bam(path, records):
    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chrX\0" + struct.pack("<i", 1000)
    for name, flags, pos, cigar, seq, quals, tags in records:
        raw = name.encode() + b"\0"
        packed = bytes(("=ACMGRSVTWYHKDBN".index(seq[i]) << 4) | ("=ACMGRSVTWYHKDBN".index(seq[i + 1]) if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
        core = struct.pack("<iiBBHHHiiii", 0, pos, len(raw), 60, 0, len(cigar), flags, len(seq), -1, -1, 0)
        core += raw + b"".join(struct.pack("<I", n << 4 | op) for op, n in cigar) + packed + bytes(quals) + b"".join(t.encode() + b"Z" + v.encode() + b"\0" for t, v in tags) + b"NMC\1"
        body += struct.pack("<i", len(core)) + core
    path.write_bytes(b"".join(gzip.compress(body[i : i + 50]) for i in range(0, len(body), 50)))


def test_bam(spark, tmp_path):
    write_bam(tmp_path / "a.bam", [("r1", 0, 9, [(0, 2), (1, 1), (0, 1), (2, 1), (3, 5), (0, 1)], "ACGTA", [30] * 5, [("CB", "c1"), ("GN", "G")])])
    r = bam.read_bam(spark, str(tmp_path)).first()
    assert (r.read_id, r.contig, r.pos, r.seq, r.cb, r.gn, r.ub, r.quals) == ("r1", "chrX", 9, "ACGTA", "c1", "G", None, [30] * 5)
    assert [(a.qpos, a.rpos, a.kind) for a in r.aligned][:5] == [(0, 9, "base"), (1, 10, "indel_anchor"), (3, 11, "indel_anchor"), (None, 12, "del"), (None, 13, "refskip")]
    assert list(bam.inflated(gzip.compress(b"x") + gzip.compress(b"y"))) == [b"x", b"y"] and zlib


def test_text_sources_and_sinks(spark, tmp_path):
    gtf = tmp_path / "a.gtf"
    gtf.write_text('#c\nchrX\ts\tgene\t5\t9\t.\t+\t.\tgene_id "i1"; gene_name "n1"; gene_name "n2";\nchrX\ts\tgene\tx\t9\t.\t+\t.\tgene_id "i"\nchrX\ts\texon\t5\t9\t.\t+\t.\tgene_id "i1"; transcript_id "t1"\nshort\n')
    g = text.read_gtf(spark, str(gtf))
    assert [(r.start, r.end, r.gene_name, r.gene_id) for r in g.collect()] == [(5, 9, "n2", "i1")]
    assert [r.feature for r in text.chrx_features(text.read_gtf(spark, str(gtf), None))[1].collect()] == ["t1"]
    vcf = tmp_path / "a.vcf"
    vcf.write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nchrX\t7\t.\tA\tG,T\t.\t.\t.\tDP:GT\t3:0|1\t1:./.\n")
    v = text.read_vcf(spark, str(vcf)).first()
    assert (v.pos, v.alts, v.gt, v.phased, v["sample"]) == (7, ["G", "T"], [0, 1], True, "s1")
    assert text.read_vcf(spark, str(vcf), "s2").first().gt == [None, None] and text.read_vcf(spark, str(vcf), contig="chrX", start=8).count() == 0
    with pytest.raises(ValueError):
        text.read_vcf(spark, str(vcf), "s3")
    for name, body in (("h.txt", "read_id\nr1\n"), ("n.txt", "r1\nr2\n"), ("e.txt", "")):
        (tmp_path / name).write_text(body)
    assert [sorted(r.read_id for r in text.read_excluded_ids(spark, str(tmp_path / n)).collect()) for n in ("h.txt", "n.txt", "e.txt")] == [["r1"], ["r1", "r2"], []]
    folder = tmp_path / "m"
    folder.mkdir()
    for name, body in (("barcodes.tsv.gz", "c1-1\nc2-1\n"), ("features.tsv.gz", "i1\tg1\ni2\tg2\ni3\tg1\n"), ("matrix.mtx.gz", "%%MatrixMarket\n%x\n3 2 3\n1 1 2\n3 1 5\n2 2 1\n")):
        (folder / name).write_bytes(gzip.compress(body.encode()))
    assert {tuple(r) for r in text.read_10x(spark, str(folder))[0].collect()} == {("g1", "c1-1", 7.0), ("g2", "c2-1", 1.0)}
    table = spark.createDataFrame([("chrX", 10, "A", "G", "Xist", "G", "A", "stage1", None, 5)], "CONTIG string, POS long, REF string, ALT string, Gene string, H1 string, H2 string, Stage string, Stage2_method string, Total_coverage long")
    sinks.write_vcf(table, str(tmp_path / "out.vcf"))
    back = text.read_vcf(spark, str(tmp_path / "out.vcf")).first()
    assert (back.pos, back.gt, back.phased) == (10, [1, 0], True)
    sinks.write_table(table.limit(0), str(tmp_path / "empty"))
    (tmp_path / "c.csv").write_text("gene_symbol,chrom\nA,chrX\n")
    assert text.read_table(spark, str(tmp_path / "c.csv")).columns == ["gene_symbol", "chrom"]


def test_full_run(spark, tmp_path):
    from barrspark.plans.pipeline import Options, Run

    rows, _ = planted(3, 20, 40)
    counts = spark.createDataFrame(rows, list(counting.COUNT_COLUMNS))
    run = Run(spark, str(tmp_path / "o"), Options(stage2_tie_action="skip"))
    out = run.phase(counts)
    assert out["haplotypes"].count() >= 18 and out["validation"].where("confidence_basic is not null").count() >= 18
    again = Run(spark, str(tmp_path / "o"))
    again.phase(counts)
    assert not again.commands
    with pytest.raises(FileNotFoundError):
        Run(spark, str(tmp_path / "none"), Options(skip={"phase"})).phase(counts)
