"""Active haplotype of cells, and what cells say about SNPs: reads, consistency, coverage, orientation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barrspark.functions.scalars import ratio, wilson


def haplotype_counts(sums: DataFrame, phased: DataFrame) -> DataFrame:
    """``POS, cell_barcode, h1, h2`` from sums (``r``, ``a``) by cell and phased positions (``pos, h1_allele``)."""
    both = sums.join(phased, sums["POS"] == phased["pos"])
    is_ref = F.col("h1_allele") == "ref"
    return both.select(sums["POS"].alias("POS"), "cell_barcode", F.when(is_ref, F.col("r")).otherwise(F.col("a")).alias("h1"), F.when(is_ref, F.col("a")).otherwise(F.col("r")).alias("h2"))


def active_x(counts: DataFrame, genes: DataFrame, cells: DataFrame) -> DataFrame:
    """Votes of cells: by haplotype the largest count of a gene's SNPs, summed over genes; SNPs without a gene do not vote.

    Every cell of ``cells`` has a row; without reads it is ``X1/X2``.
    """
    per_gene = counts.join(genes, "POS").where("Gene is not null").groupBy("cell_barcode", "Gene").agg(F.max("h1").alias("h1"), F.max("h2").alias("h2"))
    sums = per_gene.groupBy("cell_barcode").agg(F.sum("h1").alias("s1"), F.sum("h2").alias("s2"))
    out = cells.select("cell_barcode").distinct().join(sums, "cell_barcode", "left")
    s1, s2 = F.coalesce("s1", F.lit(0)), F.coalesce("s2", F.lit(0))
    call = F.when(s1 > s2, "X1").when(s1 < s2, "X2").otherwise("X1/X2")
    return out.select("cell_barcode", s1.alias("Haplotype_1_Sum"), s2.alias("Haplotype_2_Sum"), call.alias("active_X"))


def xa_xi_reads(counts: DataFrame, calls: DataFrame) -> DataFrame:
    """Reads of the active and the inactive haplotype by SNP, over cells that have a call."""
    return _xa_xi(counts.join(calls.where(F.col("active_X").isin("X1", "X2")).select("cell_barcode", "active_X"), "cell_barcode"))


def _xa_xi(both: DataFrame) -> DataFrame:
    one = F.col("active_X") == "X1"
    xa, xi = F.sum(F.when(one, F.col("h1")).otherwise(F.col("h2"))), F.sum(F.when(one, F.col("h2")).otherwise(F.col("h1")))
    return both.groupBy("POS").agg(xa.alias("Xa_reads"), xi.alias("Xi_reads")).withColumn("xa_xi_margin", ratio(F.col("Xa_reads") - F.col("Xi_reads"), F.col("Xa_reads") + F.col("Xi_reads")))


def xa_xi_by_votes(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """:func:`xa_xi_reads` under the calls of :func:`active_x` on the same counts: rows go to their cells once for both."""
    rows = counts.join(genes, "POS", "left").repartition("cell_barcode")  # serves all windows
    gene = W.partitionBy("cell_barcode", "Gene").orderBy("POS")
    first = (F.row_number().over(gene) == 1) & F.col("Gene").isNotNull()
    top = lambda h: F.max(h).over(gene.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    votes = rows.withColumns({"v1": F.when(first, top("h1")), "v2": F.when(first, top("h2"))})
    total = lambda v: F.sum(v).over(W.partitionBy("cell_barcode"))
    call = votes.withColumns({"s1": total("v1"), "s2": total("v2")})
    call = call.withColumn("active_X", F.when(F.col("s1") > F.col("s2"), "X1").when(F.col("s1") < F.col("s2"), "X2"))
    return _xa_xi(call.where("active_X is not null"))


def consistency(counts: DataFrame) -> DataFrame:
    """Share of cells in which haplotype 1 has more reads, among those that have a winner, with its interval."""
    n = F.count_if((F.col("h1") + F.col("h2") > 0) & (F.col("h1") != F.col("h2")))
    out = counts.groupBy("POS").agg(F.count_if(F.col("h1") > F.col("h2")).alias("k"), n.alias("n_informative_cells_phase"))
    lo, hi = wilson(F.col("k"), F.col("n_informative_cells_phase"))
    return out.select("POS", ratio(F.col("k"), F.col("n_informative_cells_phase")).alias("H1_wins_frac"), "n_informative_cells_phase", lo.alias("H1_wins_frac_ci_lo"), hi.alias("H1_wins_frac_ci_hi"))


def coverage_features(sums: DataFrame, n_cells: int) -> DataFrame:
    """Sums, covered cells and the spread of the reference's share over covered cells, by SNP.

    Percentiles are exact and interpolated; the deviation is that of the population.
    """
    share = F.when(F.col("r") + F.col("a") > 0, ratio(F.col("r"), F.col("r") + F.col("a")))
    out = sums.withColumn("f", share).groupBy("POS").agg(
        F.sum("r").alias("total_ref_sum"),
        F.sum("a").alias("total_alt_sum"),
        F.sum(F.col("r") + F.col("a")).alias("total_coverage"),
        F.count("f").alias("n_cells_nonzero"),
        F.percentile("f", F.lit(0.5)).alias("cell_ref_fraction_median"),
        (F.percentile("f", F.lit(0.75)) - F.percentile("f", F.lit(0.25))).alias("cell_ref_fraction_iqr"),
        F.stddev_pop("f").alias("cell_ref_fraction_std"),
    )
    return out.withColumn("frac_cells_nonzero", ratio(F.col("n_cells_nonzero"), F.lit(n_cells)))


def orientation_scores(sums: DataFrame, calls: DataFrame, mode: str = "cell") -> DataFrame:
    """How cells with a call would orient a SNP: votes (``cell``) or differences of counts (``expression``) for either way."""
    if mode not in ("cell", "expression"):
        raise ValueError(f"no mode {mode!r}")
    both = sums.join(calls.select("cell_barcode", "active_X"), "cell_barcode", "left")
    told = F.coalesce(F.col("active_X").isin("X1", "X2"), F.lit(False)) & (F.col("r") != F.col("a"))
    weight = F.lit(1.0) if mode == "cell" else F.abs(F.col("r") - F.col("a")).cast("double")
    alt_h1 = ((F.col("active_X") == "X1") & (F.col("a") > F.col("r"))) | ((F.col("active_X") == "X2") & (F.col("r") > F.col("a")))
    out = both.groupBy("POS").agg(
        F.coalesce(F.sum(F.when(told & alt_h1, weight)), F.lit(0.0)).alias("score_alt_h1"),
        F.coalesce(F.sum(F.when(told & ~alt_h1, weight)), F.lit(0.0)).alias("score_ref_h1"),
        F.count_if(told).alias("n_informative_cells_stage2"),
    )
    a, r = F.col("score_alt_h1"), F.col("score_ref_h1")
    best = F.when(a + r <= 0, "unresolved").when(a > r, "alt_h1").when(r > a, "ref_h1").otherwise("tie")
    return out.select("POS", best.alias("best_orientation"), a, r, (a + r).alias("evidence"), F.coalesce(ratio(F.abs(a - r), a + r), F.lit(0.0)).alias("margin"), "n_informative_cells_stage2", F.lit(mode).alias("stage2_mode"))


def assign_stage2(scores: DataFrame, min_evidence: float = 1.0, tie_action: str = "random", seed: int = 1) -> DataFrame:
    """``POS, h1_allele, method``: positions without an orientation have a null allele. Ties are told by a seeded hash."""
    if tie_action not in ("random", "skip"):
        raise ValueError(f"no action {tie_action!r} on ties")
    mode, best = F.col("stage2_mode"), F.col("best_orientation")
    coin = F.when(F.pmod(F.xxhash64("POS", F.lit(seed)), F.lit(2)) == 0, "alt_h1").otherwise("ref_h1")
    low = F.col("evidence") < min_evidence
    to = F.when(low, None).when(best.isin("alt_h1", "ref_h1"), best).when((best == "tie") & F.lit(tie_action == "random"), coin)
    method = (
        F.when(low, F.concat(F.lit("unresolved_low_evidence_"), mode))
        .when(best.isin("alt_h1", "ref_h1"), F.concat_ws("_", F.lit("calculated"), mode, best))
        .when((best == "tie") & F.lit(tie_action == "skip"), F.concat(F.lit("unresolved_tie_"), mode))
        .when(best == "tie", F.concat_ws("_", F.lit("random"), mode, coin))
        .otherwise(F.concat(F.lit("unresolved_"), mode))
    )
    return scores.select("POS", F.when(to == "alt_h1", "alt").when(to == "ref_h1", "ref").alias("h1_allele"), method.alias("method"))
