"""Haplotype and activity tags of reads, and the routing of tagged reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Defaults by mode of the least total and the least difference.
LEAST = {"quality": (10, 10), "count": (1, 1)}
LABELS = ("X1", "X2", "Xa", "Xi", "low", "amb", "unknown")


def phased_snps(variants: DataFrame) -> DataFrame:
    """``contig, pos, h1, h2`` of phased diploid genotypes of biallelic SNPs; of several at a position the last stays."""
    one = (F.size("alts") == 1) & (F.length("ref") == 1) & (F.length(F.get("alts", 0)) == 1)
    called = F.coalesce(F.col("phased"), F.lit(False)) & (F.size("gt") == 2) & ~F.exists("gt", lambda g: g.isNull() | (g < 0) | (g > 1))
    base = lambda i: F.upper(F.get(F.concat(F.array("ref"), "alts"), F.get("gt", i)))
    rows = variants.where(one & called).select("contig", "pos", base(0).alias("h1"), base(1).alias("h2"), "ordinal")
    return rows.groupBy("contig", "pos").agg(F.max_by(F.struct("h1", "h2"), "ordinal").alias("h")).select("contig", "pos", "h.*")


def read_scores(reads: DataFrame, snps: DataFrame, min_base_qual: int = 5) -> DataFrame:
    """By read (``ordinal``): sums of qualities MS and NS, counts MC and NC, and informative bases MI."""
    bases = reads.select("ordinal", "contig", "seq", "quals", F.explode("aligned").alias("a")).where("a.qpos is not null and a.rpos is not null and seq is not null")
    q = F.coalesce(F.get("quals", F.col("a.qpos")), F.lit(0))
    bases = bases.select("ordinal", "contig", (F.col("a.rpos") + 1).alias("pos"), F.upper(F.substring("seq", F.col("a.qpos") + 1, F.lit(1))).alias("base"), q.alias("q"))
    return score_bases(bases.where(F.col("q") >= min_base_qual).join(snps, ["contig", "pos"]))


def score_bases(bases: DataFrame) -> DataFrame:
    """Sums by read over bases (``ordinal, base, q, h1, h2``); haplotype 1 is asked first."""
    one, two = F.col("base") == F.col("h1"), (F.col("base") != F.col("h1")) & (F.col("base") == F.col("h2"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("q").cast("long"))), F.lit(0))
    return bases.groupBy("ordinal").agg(total(one).alias("MS"), total(two).alias("NS"), F.count_if(one).alias("MC"), F.count_if(two).alias("NC"), F.count_if(one | two).alias("MI"))


def assignment(mode: str = "quality", min_total: int | None = None, min_diff: int | None = None) -> Column:
    """MA: none, low, amb, H1 or H2."""
    total, diff = LEAST[mode]
    total, diff = total if min_total is None else min_total, diff if min_diff is None else min_diff
    a, b = (F.col("MS"), F.col("NS")) if mode == "quality" else (F.col("MC"), F.col("NC"))
    return F.when(F.col("MI") == 0, "none").when(a + b < total, "low").when(F.abs(a - b) < diff, "amb").when(a > b, "H1").otherwise("H2")


def activity(ma: Column, cb: Column, active: Column) -> Column:
    """XX: active or inactive copy by the cell's call, else why not."""
    known = F.coalesce(cb != "", F.lit(False)) & active.isNotNull()
    phased = ma.isin("H1", "H2")
    same = ((active == "X1") & (ma == "H1")) | ((active == "X2") & (ma == "H2"))
    return (
        F.when(phased & known, F.when(active.isin("X1", "X2"), F.when(same, "Xa").otherwise("Xi")).otherwise("unknown"))
        .when(ma.isin("low", "amb"), ma)
        .when(~F.coalesce(cb != "", F.lit(False)), "no_CB")
        .when(active.isNull(), "no_active_X")
        .otherwise("none")
    )


def tag(reads: DataFrame, scores: DataFrame, calls: DataFrame, mode: str = "quality", min_total: int | None = None, min_diff: int | None = None) -> DataFrame:
    """All reads with MS, NS, MC, NC, MI, MA, HP and XX. Of several calls of a cell the last stays, where ``calls`` has an ordinal."""
    order = F.col("ordinal") if "ordinal" in calls.columns else F.col("active_X")
    last = calls.groupBy(F.col("cell_barcode").alias("cb")).agg(F.max_by("active_X", order).alias("active"))
    out = reads.join(scores, "ordinal", "left").fillna(0, ["MS", "NS", "MC", "NC", "MI"]).join(last, "cb", "left")
    out = out.withColumn("MA", assignment(mode, min_total, min_diff)).withColumn("HP", F.when(F.col("MA") == "H1", 1).when(F.col("MA") == "H2", 2))
    return out.withColumn("XX", activity(F.col("MA"), F.col("cb"), F.col("active"))).drop("active")


def route(tagged: DataFrame) -> DataFrame:
    """A row for each output a read goes to, by ``label``: X1 or X2 by haplotype, and exactly one by activity."""
    side = F.when(F.col("MA") == "H1", "X1").when(F.col("MA") == "H2", "X2")
    other = F.when(F.col("XX").isin("Xa", "Xi", "low", "amb"), F.col("XX")).otherwise("unknown")
    return tagged.withColumn("label", F.explode(F.array_compact(F.array(side, other))))


def route_counts(routed: DataFrame) -> DataFrame:
    spark = routed.sparkSession
    names = spark.createDataFrame([(x,) for x in LABELS], "label string")
    return names.join(routed.groupBy("label").agg(F.count("*").alias("reads")), "label", "left").fillna(0, ["reads"])
