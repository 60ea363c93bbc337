"""Filters on annotated counts, their summary, and the reads behind dropped counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrspark.functions.scalars import joined_distinct, norm_gene

POSITION = ["contig", "position", "refAllele", "altAllele"]
EVIDENCE_KEYS = ["cell_barcode", "contig", "position", "gene", "refAllele", "altAllele"]
GENE_CONFLICT, MULTI_GENE = "gtf_gene_conflict", "multi_tsv_gene_and_multi_gtf_gene"


def filter_counts(annotated: DataFrame, drop_conflicts: bool = True, drop_multi: bool = True) -> tuple[DataFrame, DataFrame]:
    """Kept and dropped rows, these with ``drop_reason``: conflicts first, then positions of many genes in both lists."""
    kept, dropped = annotated, []
    if drop_conflicts:
        bad = F.coalesce("gtf_gene_conflict", F.lit(False))
        dropped.append(kept.where(bad).withColumn("drop_reason", F.lit(GENE_CONFLICT)))
        kept = kept.where(~bad)
    if drop_multi:
        gene = norm_gene(F.col("gene"))
        genes = F.count_distinct(F.when(gene != "", gene))
        multi = kept.groupBy(*POSITION).agg(genes.alias("n"), F.max("gtf_gene_n").alias("m")).where("n >= 2 and m >= 2").select(*POSITION)
        dropped.append(kept.join(multi, POSITION, "left_semi").withColumn("drop_reason", F.lit(MULTI_GENE)))
        kept = kept.join(multi, POSITION, "left_anti")
    if not dropped:
        return kept, annotated.limit(0).withColumn("drop_reason", F.lit(None).cast("string"))
    out = dropped[0]
    for d in dropped[1:]:
        out = out.unionByName(d)
    return kept, out


def filter_summary(before: DataFrame, kept: DataFrame, dropped: DataFrame) -> DataFrame:
    """``metric, value`` (both text): rows and positions before and after, flags, and counts by reason."""
    place = F.struct("contig", "position")
    text = lambda c: c.cast("string")
    flag = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    a = before.agg(F.count("*").alias("rows_before"), F.count_distinct(place).alias("positions_before"), flag("gtf_gene_conflict").alias("rows_gtf_gene_conflict"), flag("gtf_multi_gene").alias("rows_gtf_multi_gene"))
    b = kept.agg(F.count("*").alias("rows_after"), F.count_distinct(place).alias("positions_after"))
    c = dropped.agg(F.count("*").alias("rows_removed"), F.count_distinct(place).alias("positions_removed"))
    one = None
    for part in (a, b, c):
        names = part.columns
        long = part.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), text(F.col(n)).alias("value")) for n in names])).alias("x")).select("x.*")
        one = long if one is None else one.unionByName(long)
    reasons = before.groupBy(F.concat(F.lit("reason__"), F.coalesce("gtf_conflict_reason", F.lit("none"))).alias("metric")).agg(text(F.count("*")).alias("value"))
    removed = dropped.groupBy(F.concat(F.lit("removed__"), F.col("drop_reason")).alias("metric")).agg(text(F.count("*")).alias("value"))
    return one.unionByName(reasons).unionByName(removed)


def dropped_evidence(evidence: DataFrame, dropped: DataFrame) -> DataFrame:
    """The evidence of dropped counts, with the reason; missing genes match each other."""
    keys = dropped.select(*EVIDENCE_KEYS, "drop_reason").distinct()
    renamed = keys.select(*[F.col(k).alias(f"k_{k}") for k in EVIDENCE_KEYS], "drop_reason")
    on = None
    for k in EVIDENCE_KEYS:
        same = F.col(k).eqNullSafe(F.col(f"k_{k}")) if k == "gene" else F.col(k) == F.col(f"k_{k}")
        on = same if on is None else on & same
    return evidence.join(renamed, on).select(*evidence.columns, "drop_reason")


def dropped_read_summary(dropped: DataFrame) -> DataFrame:
    """By read: rows, positions and the joined values of what was dropped."""
    return dropped.groupBy("read_id").agg(
        F.count("*").alias("n_dropped_snp_rows"),
        F.count_distinct("position").alias("n_dropped_snps"),
        joined_distinct(F.col("cell_barcode"), ";").alias("cells"),
        joined_distinct(F.col("gene"), ";").alias("genes"),
        joined_distinct(F.col("drop_reason"), ";").alias("drop_reasons"),
        joined_distinct(F.col("allele_class"), ";").alias("allele_classes"),
    )


def dropped_read_ids(dropped: DataFrame) -> DataFrame:
    return dropped.select("read_id").distinct()
