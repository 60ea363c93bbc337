"""Validation metrics of a partition, the table of haplotypes, and the phased variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrspark.functions.scalars import center01, mean_of_known, ratio
from barrspark.operators.concordance import neighbours


def partition_metrics(alleles: DataFrame, sides: DataFrame, mode: str = "binary") -> DataFrame:
    """By SNP: degree, strength and mean weight of both alleles, weights and neighbours within and across sides, separations."""
    near, first = neighbours(alleles, mode, sides).where("n_0 + n_1 > 0"), F.col("side") == 0
    within_n, cross_n = F.when(first, F.col("n_0")).otherwise(F.col("n_1")), F.when(first, F.col("n_1")).otherwise(F.col("n_0"))
    within_w, cross_w = F.when(first, F.col("w_0")).otherwise(F.col("w_1")), F.when(first, F.col("w_1")).otherwise(F.col("w_0"))
    degree, strength = F.col("n_0") + F.col("n_1"), F.col("w_0") + F.col("w_1")
    per = near.select(
        "pos", "allele", degree.alias("degree"), strength.alias("strength"), (strength / degree).alias("mean_w"),
        within_w.alias("within_w"), cross_w.alias("cross_w"), within_n.alias("within_n"), cross_n.alias("cross_n"),
    )
    # per has only alleles of sides, so a union serves as the join and needs one shuffle, by position
    all_alleles = sides.select("pos", "allele").unionByName(per, allowMissingColumns=True)
    pick = lambda a, c: F.max(F.when(F.col("allele") == a, F.col(c)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = all_alleles.groupBy(F.col("pos").alias("POS")).agg(
        *[F.coalesce(pick(a, c), F.lit(0)).alias(f"graph_{c}_{a}") for c in ("degree", "strength") for a in ("ref", "alt")],
        *[pick(a, "mean_w").alias(f"mean_edge_weight_{a}") for a in ("ref", "alt")],
        F.avg("mean_w").alias("mean_edge_weight_mean"),
        total("within_w").alias("within_weight"), total("cross_w").alias("cross_weight"), total("within_n").alias("within_degree"), total("cross_n").alias("cross_degree"),
    )
    part = lambda a, b: ratio(F.col(a) - F.col(b), F.col(a) + F.col(b))
    return out.withColumn("partition_separation_w", part("within_weight", "cross_weight")).withColumn("partition_separation_n", part("within_degree", "cross_degree"))


def validation_matrix(graph: DataFrame, consistent: DataFrame, coverage: DataFrame, reads: DataFrame) -> DataFrame:
    """All metrics by position, with a confidence that is the mean of what is known."""
    out = graph.join(consistent, "POS", "full_outer").join(coverage, "POS", "full_outer").join(reads, "POS", "full_outer")
    parts = center01(F.col("partition_separation_w")), 2 * F.abs(F.col("H1_wins_frac") - 0.5), F.abs(F.col("xa_xi_margin"))
    return out.withColumn("confidence_basic", mean_of_known(*parts))


def haplotype_table(std: DataFrame, phased: DataFrame, genes: DataFrame, totals: DataFrame) -> DataFrame:
    """Positions with their haplotypes, ordered by the caller: ``CONTIG, POS, REF, ALT, Gene, H1, H2, Stage, Stage2_method, Total_coverage``.

    ``phased`` has ``pos, h1_allele, stage, method``. Of several records at a position the least is taken. Haplotypes are
    turned at the gene XIST, which the inactive chromosome expresses.
    """
    first = std.groupBy("POS").agg(F.min(F.struct("CONTIG", "REF", "ALT")).alias("v")).select("POS", "v.*")
    rows = phased.withColumnRenamed("pos", "POS").where("h1_allele is not null").join(first, "POS").join(genes, "POS", "left").join(totals.select("POS", F.col("total").alias("Total_coverage")), "POS", "left")
    is_ref = F.col("h1_allele") == "ref"
    is_ref = F.when(F.lower(F.coalesce("Gene", F.lit(""))) == "xist", ~is_ref).otherwise(is_ref)
    h1, h2 = F.when(is_ref, F.col("REF")).otherwise(F.col("ALT")), F.when(is_ref, F.col("ALT")).otherwise(F.col("REF"))
    return rows.select("CONTIG", "POS", "REF", "ALT", "Gene", h1.alias("H1"), h2.alias("H2"), F.col("stage").alias("Stage"), F.col("method").alias("Stage2_method"), "Total_coverage")


def vcf_lines(table: DataFrame) -> DataFrame:
    """``CONTIG, POS, line``: records of a phased VCF."""
    gt = F.when((F.col("H1") == F.col("REF")) & (F.col("H2") == F.col("ALT")), "0|1").when((F.col("H1") == F.col("ALT")) & (F.col("H2") == F.col("REF")), "1|0").otherwise(".|.")
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    info = F.concat(F.lit("GENE="), dot("Gene"), F.lit(";STAGE="), dot("Stage"), F.lit(";STAGE2_METHOD="), dot("Stage2_method"), F.lit(";TOTAL_COVERAGE="), F.coalesce("Total_coverage", F.lit(0)).cast("string"))
    line = F.concat_ws("\t", "CONTIG", F.col("POS").cast("string"), F.lit("."), "REF", "ALT", F.lit("."), F.lit("PASS"), info, F.lit("GT:PS"), F.concat(gt, F.lit(":0")))
    return table.select("CONTIG", "POS", line.alias("line"))
