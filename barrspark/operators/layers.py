"""Layers of cells and genes, their normalisation, and per-cell metrics; sparse, one row a value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrspark.functions.scalars import imbalance, with_suffix


def align(table: DataFrame, cells: DataFrame, genes: DataFrame, suffix: str | None = None) -> DataFrame:
    """Values (``gene, cell, value``) of known genes and cells; missing and NaN are zero, which is not stored."""
    value = F.nanvl(F.coalesce(F.col("value").cast("double"), F.lit(0.0)), F.lit(0.0))
    kept = table.select("gene", with_suffix(F.col("cell"), suffix).alias("cell"), value.alias("value")).where("value <> 0")
    return kept.join(cells.select("cell"), "cell", "left_semi").join(genes.select("gene"), "gene", "left_semi")


def scaled(layer: DataFrame, totals: DataFrame, target: float = 10_000.0) -> DataFrame:
    """Each cell's values times target / total; zero where the total is not positive."""
    scale = F.when(F.col("raw_total") > 0, F.lit(target) / F.col("raw_total")).otherwise(0.0)
    return layer.join(totals, "cell").select("gene", "cell", (F.col("value") * scale).alias("value"))


def x_layers(raw: DataFrame, xa: DataFrame | None, xi: DataFrame | None, cells: DataFrame, target: float = 10_000.0) -> tuple[DataFrame, DataFrame]:
    """Layers (``layer, gene, cell, value``) and cells with metrics.

    With both layers: Xa, Xi and Xai, each raw and normalised by the cell's raw total over all genes. With one of
    them only the raw counts and it are given, and the metrics stop at the raw total.
    """
    layers = {"raw_counts": raw} | {k: v for k, v in (("Xa", xa), ("Xi", xi)) if v is not None}
    totals = raw.groupBy("cell").agg(F.sum("value").alias("raw_total"))
    totals = cells.join(totals, "cell", "left").withColumn("raw_total", F.coalesce("raw_total", F.lit(0.0)))
    if xa is not None and xi is not None:
        both = xa.unionByName(xi).groupBy("gene", "cell").agg(F.sum("value").alias("value"))
        layers["Xai"] = both
        layers |= {f"{k}_Normalized": scaled(layers[k], totals.select("cell", "raw_total"), target) for k in ("Xa", "Xi", "Xai")}
        sums = (
            layers["Xai_Normalized"].groupBy("cell").agg(F.sum("value").alias("Xai_total"))
            .join(xa.groupBy("cell").agg(F.sum("value").alias("xa_sum")), "cell", "full_outer")
            .join(xi.groupBy("cell").agg(F.sum("value").alias("xi_sum")), "cell", "full_outer")
        )
        totals = totals.join(sums, "cell", "left").fillna(0.0, ["Xai_total", "xa_sum", "xi_sum"])
        totals = totals.withColumn("allelic_imbalance_chrX", imbalance(F.col("xa_sum"), F.col("xi_sum"))).drop("xa_sum", "xi_sum")
    long = [v.select(F.lit(k).alias("layer"), "gene", "cell", "value") for k, v in layers.items()]
    return reduce(DataFrame.unionByName, long), totals


def haplotype_metrics(cells: DataFrame, sums: DataFrame, suffix: str | None = "-1") -> DataFrame:
    """Cells with their call, sum and imbalance of haplotypes; of repeated barcodes the least row is taken."""
    missing = [c for c in ("cell_barcode", "Haplotype_1_Sum", "Haplotype_2_Sum", "active_X") if c not in sums.columns]
    if missing:
        raise ValueError(f"the table of haplotype sums lacks {', '.join(missing)}")
    order = "ordinal" if "ordinal" in sums.columns else "active_X"
    named = sums.withColumn("cell", with_suffix(F.col("cell_barcode"), suffix))
    once = named.groupBy("cell").agg(F.min_by(F.struct("Haplotype_1_Sum", "Haplotype_2_Sum", "active_X"), order).alias("h"))
    a, b = F.col("h.Haplotype_1_Sum").cast("double"), F.col("h.Haplotype_2_Sum").cast("double")
    out = cells.join(once, "cell", "left")
    return out.withColumns({"active_X": F.col("h.active_X"), "haplotype_sum": a + b, "allelic_imbalance_HC": imbalance(a, b)}).drop("h")


def concat_batches(batches: list[tuple[str, DataFrame, DataFrame]], join: str = "outer", sep: str | None = "-") -> tuple[DataFrame, DataFrame]:
    """Layers and cells of (name, layers, cells), with ``batch``; several batches have it in the cell's name.

    ``inner`` keeps the genes that every batch has.
    """
    if join not in ("outer", "inner"):
        raise ValueError(f"no join {join!r}")
    several = len(batches) > 1 and sep is not None
    name = lambda b: F.concat(F.col("cell"), F.lit(f"{sep}{b}")) if several else F.col("cell")
    layers = [x.withColumn("cell", name(b)).withColumn("batch", F.lit(b)) for b, x, _ in batches]
    cells = [x.withColumn("cell", name(b)).withColumn("batch", F.lit(b)) for b, _, x in batches]
    values = reduce(DataFrame.unionByName, layers)
    if join == "inner":
        shared = values.groupBy("gene").agg(F.count_distinct("batch").alias("n")).where(F.col("n") == len(batches))
        values = values.join(shared.select("gene"), "gene", "left_semi")
    return values, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cells)


def matrix_specs(spec) -> list[tuple[str, str]]:
    """(path, name) of a path, a (path, name) pair, or a list of either; unnamed ones are batch1, batch2, …

    A pair whose second part does not look like a path is a named path.
    """
    import os

    is_path = lambda x: isinstance(x, (str, os.PathLike))
    if is_path(spec) or (isinstance(spec, tuple) and len(spec) == 2 and all(map(is_path, spec)) and os.sep not in str(spec[1])):
        spec = [spec]
    out = []
    for i, s in enumerate(spec, 1):
        out.append((str(s), f"batch{i}") if is_path(s) else (str(s[0]), str(s[1])))
    if len({n for _, n in out}) < len(out):
        raise ValueError("batches must have different names")
    return out
