"""Reads to feature-by-cell counts. Counts stay long; a wide table is made only where it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrspark.functions.scalars import with_suffix


def matrix_reads(reads: DataFrame, feature: str = "gn", exclude_ids: DataFrame | None = None, exclude_duplicates: bool = False, keep_secondary: bool = False, keep_supplementary: bool = False) -> DataFrame:
    """Mapped reads of a cell with the feature tag, but for excluded identifiers: ``cell_barcode, feature``."""
    mask = 0x4 | (0 if keep_secondary else 0x100) | (0 if keep_supplementary else 0x800) | (0x400 if exclude_duplicates else 0)
    f = F.col(feature)
    kept = reads.where((F.col("flags").bitwiseAND(mask) == 0) & F.col("cb").isNotNull() & (F.trim(f) != "") & (F.lower(F.trim(f)) != "nan"))
    if exclude_ids is not None:
        kept = kept.join(exclude_ids.select("read_id").distinct(), "read_id", "left_anti")
    return kept.select(F.col("cb").alias("cell_barcode"), f.alias("feature"))


def feature_counts(rows: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Reads by feature and cell, of allowed features only where these are given."""
    if allowed is not None:
        rows = rows.join(allowed.select("feature").distinct(), "feature", "left_semi")
    return rows.groupBy("feature", "cell_barcode").agg(F.count("*").alias("n"))


def on_scaffold(counts: DataFrame, row_order: DataFrame, barcodes: DataFrame, suffix: str | None = "-1") -> DataFrame:
    """Counts with their row and column: ``row_ordinal`` of listed features (null for others, which come after, sorted) and ``cell_ordinal``.

    Barcodes that are equal once suffixed are summed; unknown cells are dropped. Zeros are left out; the list of rows and
    columns says where they are.
    """
    sums = counts.withColumn("cell_barcode", with_suffix(F.col("cell_barcode"), suffix)).groupBy("feature", "cell_barcode").agg(F.sum("n").alias("n"))
    rows = row_order.groupBy("feature").agg(F.min("ordinal").alias("row_ordinal"))
    cells = barcodes.groupBy("cell_barcode").agg(F.min("ordinal").alias("cell_ordinal"))
    return sums.join(cells, "cell_barcode").join(rows, "feature", "left")


def wide(scaffolded: DataFrame, row_order: DataFrame, barcodes: list[str]) -> DataFrame:
    """The table as it is written: a row a feature, in order, a column a barcode, zeros filled in."""
    extra = scaffolded.where("row_ordinal is null").select("feature").distinct()
    rows = row_order.groupBy("feature").agg(F.min("ordinal").alias("row_ordinal")).unionByName(extra.withColumn("row_ordinal", F.lit(None).cast("long")))
    columns = list(dict.fromkeys(barcodes))
    filled = scaffolded.groupBy("feature").pivot("cell_barcode", columns).agg(F.sum("n"))
    out = rows.join(filled, "feature", "left").orderBy(F.col("row_ordinal").asc_nulls_last(), "feature")
    return out.select("feature", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in columns])


def transcript_rows(reads: DataFrame, ids: DataFrame, names: DataFrame, mode: str = "auto", max_reads: int = 250_000) -> tuple[str, DataFrame]:
    """Which rows transcripts have: identifiers or names of the annotation, by which of them tags hit, else what is observed.

    ``auto`` looks at the first ``max_reads`` tagged reads by ordinal, as sampling is what it asks for.
    """
    if mode == "id":
        return mode, ids
    if mode == "name":
        return mode, names
    sample = reads.where("tr is not null and trim(tr) <> ''").orderBy("ordinal").limit(max_reads).select(F.col("tr").alias("feature")).distinct()
    hits = [sample.join(x.select("feature").distinct(), "feature", "left_semi").count() for x in (ids, names)]
    if hits[0] and hits[0] >= hits[1]:
        return "id", ids
    if hits[1]:
        return "name", names
    seen = reads.where("tr is not null and trim(tr) <> ''").select(F.col("tr").alias("feature")).distinct()
    return "observed", seen.withColumn("ordinal", F.lit(0).cast("long"))


def matrix_name(stem: str, transcript: bool = False) -> str:
    """Name of a matrix: the label at the end of the file's stem, or else the whole stem."""
    from barrspark.operators.tagging import LABELS

    label = stem.rsplit("_", 1)[-1].rsplit(".", 1)[-1]
    return ("transcript_" if transcript else "") + (label if label in LABELS else stem)
