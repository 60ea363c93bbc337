"""Reads and variants to per-cell allele counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrspark.functions.scalars import flag_mask, is_het_01, is_snp
from barrspark.schema import COUNT_COLUMNS, EVIDENCE_COLUMNS

_KEYS = ["cell_barcode", "contig", "position", "gene", "refAllele", "altAllele"]


def snp_sites(variants: DataFrame, het_only: bool = False) -> DataFrame:
    """``contig, position, refAllele, altAllele`` of variants that change one base; each record is a site."""
    kept = variants.where(is_snp(F.col("ref"), F.col("alts")))
    if het_only:
        kept = kept.where(is_het_01(F.col("gt")))
    return kept.select("contig", F.col("pos").alias("position"), F.upper("ref").alias("refAllele"), F.upper(F.get("alts", 0)).alias("altAllele"))


def counted_reads(reads: DataFrame, min_mapq: int = 20, allow_secondary: bool = False, count_duplicates: bool = False) -> DataFrame:
    """Reads that are mapped well, of an allowed kind, and from a cell; a missing gene is ``.``."""
    mask = flag_mask(allow_secondary, count_duplicates)
    kept = reads.where((F.col("flags").bitwiseAND(mask) == 0) & (F.col("mapq") >= min_mapq) & (F.col("cb") != ""))
    return kept.withColumn("gene", F.coalesce("gn", F.lit(".")))


def read_evidence(
    reads: DataFrame,
    sites: DataFrame,
    min_bq: int = 10,
    skip_indels: bool = False,
    max_depth: int | None = 100_000,
    broadcast_sites: bool | None = None,
    **filters,
) -> DataFrame:
    """One row for each read and site it covers, with the class of its base: ref, alt or other.

    Deletions and bases next to an indel are other, or left out with ``skip_indels``. Spark broadcasts the sites by
    their size unless ``broadcast_sites`` is set.
    """
    kept = counted_reads(reads, **filters).select("read_id", "cb", "gene", "contig", "seq", "quals", F.explode("aligned").alias("a"))
    base = F.upper(F.substring("seq", F.col("a.qpos") + 1, F.lit(1)))
    seen = (F.col("a.kind") == "del") | (F.col("a.qpos").isNotNull() & F.col("seq").isNotNull())
    quality = F.col("a.qpos").isNull() | (F.coalesce(F.get("quals", F.col("a.qpos")), F.lit(255)) >= min_bq)
    kept = kept.where((F.col("a.kind") != "refskip") & seen & quality)
    if skip_indels:
        kept = kept.where("a.kind = 'base'")
    kept = kept.select("read_id", F.col("cb").alias("cell_barcode"), "gene", "contig", (F.col("a.rpos") + 1).alias("position"), F.col("a.kind").alias("kind"), base.alias("base"))
    joined = kept.join(F.broadcast(sites) if broadcast_sites else sites, ["contig", "position"])
    klass = (
        F.when(F.col("kind") != "base", "other")
        .when(F.col("base") == F.col("refAllele"), "ref")
        .when(F.col("base") == F.col("altAllele"), "alt")
        .otherwise("other")
    )
    out = joined.withColumn("allele_class", klass)
    if max_depth is not None:
        deep = joined.groupBy("contig", "position").agg(F.count("*").alias("n")).where(F.col("n") > max_depth)
        out = _capped(out, deep, max_depth)
    return out.select(*EVIDENCE_COLUMNS)


def _capped(evidence: DataFrame, deep: DataFrame, most: int) -> DataFrame:
    """At sites over the depth limit, which is part of counting, the reads first by identifier; a read met more than once there is ordered by its cell, gene and class."""
    from pyspark.sql import Window as W

    order = W.partitionBy("contig", "position", "refAllele", "altAllele").orderBy("read_id", "cell_barcode", "gene", "allele_class")
    over = evidence.join(deep.drop("n"), ["contig", "position"], "left_semi")
    under = evidence.join(deep.drop("n"), ["contig", "position"], "left_anti")
    return under.unionByName(over.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k"))


def allele_counts(evidence: DataFrame) -> DataFrame:
    """Counts by cell, site and gene: a partial sum before one shuffle."""
    n = lambda k: F.count_if(F.col("allele_class") == k)
    return (
        evidence.groupBy(*_KEYS)
        .agg(n("ref").alias("refCount"), n("alt").alias("altCount"), F.count("*").alias("totalCount"), n("other").alias("otherCount"))
        .select(*COUNT_COLUMNS)
    )
