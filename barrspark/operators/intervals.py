"""Positions and gene intervals: overlap, slop and nearest joins, and what they say about a count's gene.

A range join is an equi-join on bins of the genome: an interval, widened by the reach, is put into every bin it
touches, a position into its own. The bins' width follows the reach, so an interval of usual length has a
few bins, and no nested-loop join is planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barrspark.functions.scalars import CONFLICTS, candidate_contigs, conflict_reason, distance_to_interval, norm_gene

ANNOTATION_COLUMNS = ("gtf_gene", "gtf_gene_ids", "gtf_gene_n", "gtf_multi_gene", "gtf_match_type", "gtf_min_distance")


def near_genes(positions: DataFrame, genes: DataFrame, reach: int, bin_width: int | None = None) -> DataFrame:
    """``contig, position`` with every gene within ``reach``, and its ``distance``."""
    width = bin_width or max(1 << 14, reach)
    spread = F.sequence(F.floor((F.col("start") - reach) / width), F.floor((F.col("end") + reach) / width))
    binned = genes.select(F.col("contig").alias("g_contig"), "start", "end", "gene_name", "gene_id", F.explode(spread).alias("bin"))
    named = positions.select("contig", "position", F.posexplode(candidate_contigs(F.col("contig"))).alias("priority", "g_contig"))
    known = genes.select(F.col("contig").alias("g_contig")).distinct()
    alias = named.join(known, "g_contig", "left_semi").groupBy("contig", "position").agg(F.min_by("g_contig", "priority").alias("g_contig"))
    alias = alias.withColumn("bin", F.floor(F.col("position") / width))
    d = distance_to_interval(F.col("position"), F.col("start"), F.col("end"))
    return alias.join(binned, ["g_contig", "bin"]).withColumn("distance", d).where(F.col("distance") <= reach).drop("bin", "g_contig")


def annotate_positions(positions: DataFrame, genes: DataFrame, slop: int = 1000, max_nearest: int = 10_000) -> DataFrame:
    """Genes of each distinct position.

    Genes over the position, else those within ``slop``, else the nearest within ``max_nearest`` with ties; names and
    identifiers are joined in the order of distance, start, end and name, each pair once.
    """
    distinct = positions.select("contig", "position").distinct()
    hits = near_genes(distinct, genes, max(slop, max_nearest))
    least = F.min("distance").over(W.partitionBy("contig", "position"))
    keep = F.when(F.col("least") == 0, F.col("distance") == 0).when(F.col("least") <= slop, F.col("distance") <= slop)
    hits = hits.withColumn("least", least).where(keep.otherwise((F.col("distance") == F.col("least")) & (F.col("least") <= max_nearest)))
    once = hits.groupBy("contig", "position", "least", "gene_name", "gene_id").agg(F.min(F.struct("distance", "start", "end")).alias("o"))
    ordered = F.array_sort(F.collect_list(F.struct("o.distance", "o.start", "o.end", "gene_name", "gene_id")))
    found = once.groupBy("contig", "position", "least").agg(ordered.alias("g"))
    kind = F.when(F.col("least") == 0, "exact_overlap").when(F.col("least") <= slop, "within_slop").otherwise("nearest_within_max")
    found = found.select(
        "contig",
        "position",
        F.array_join(F.transform("g", lambda x: x["gene_name"]), ";").alias("gtf_gene"),
        F.array_join(F.transform("g", lambda x: x["gene_id"]), ";").alias("gtf_gene_ids"),
        F.size("g").cast("long").alias("gtf_gene_n"),
        kind.alias("gtf_match_type"),
        F.col("least").cast("long").alias("gtf_min_distance"),
    )
    out = distinct.join(found, ["contig", "position"], "left")
    return out.select(
        "contig",
        "position",
        F.coalesce("gtf_gene", F.lit("")).alias("gtf_gene"),
        F.coalesce("gtf_gene_ids", F.lit("")).alias("gtf_gene_ids"),
        F.coalesce("gtf_gene_n", F.lit(0)).alias("gtf_gene_n"),
        (F.coalesce("gtf_gene_n", F.lit(0)) > 1).alias("gtf_multi_gene"),
        F.coalesce("gtf_match_type", F.lit("none")).alias("gtf_match_type"),
        "gtf_min_distance",
    )


def annotate_counts(counts: DataFrame, genes: DataFrame, slop: int = 1000, max_nearest: int = 10_000) -> DataFrame:
    """Counts with the genes of their position, each distinct position looked up once, and the conflict rule."""
    found = counts.join(annotate_positions(counts, genes, slop, max_nearest), ["contig", "position"], "left")
    listed = F.filter(F.split("gtf_gene", ";"), lambda g: g != "")
    reason = conflict_reason(F.col("gene"), listed, F.col("gtf_match_type"))
    return found.select(
        *counts.columns,
        *ANNOTATION_COLUMNS,
        reason.isin(*CONFLICTS).alias("gtf_gene_conflict"),
        reason.alias("gtf_conflict_reason"),
        ((norm_gene(F.col("gene")) != "") & F.array_contains(listed, norm_gene(F.col("gene")))).alias("tsv_gene_in_gtf_list"),
    )
