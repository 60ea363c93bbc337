"""Connectivity of the allele graph: components by the smallest vertex, and what they say about a SNP."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrspark.operators.concordance import both_ways


def vertex(pos: str = "pos", allele: str = "allele"):
    return F.concat(F.col(pos).cast("string"), F.lit("_"), F.col(allele))


def components(alleles: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``pos, allele, component``: every allele of the table, labelled by its component's smallest vertex name.

    Each round takes the least label of the neighbours, then the label of the label. Rounds are cut by
    ``checkpoint`` in the session's checkpoint folder, so a lost executor costs no recomputation from the start.
    """
    spark = alleles.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barrspark-"))
    ways = both_ways(edges).select(vertex("src_pos", "src_allele").alias("src"), vertex("dst_pos", "dst_allele").alias("dst")).checkpoint()
    names = alleles.select("pos", "allele", vertex().alias("v")).distinct()
    labels = names.select("v", F.col("v").alias("label")).checkpoint()
    for _ in range(max_rounds):
        seen = ways.join(labels, ways["dst"] == labels["v"]).groupBy("src").agg(F.min("label").alias("near"))
        step = labels.join(seen, labels["v"] == seen["src"], "left").select("v", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        up = step.select(F.col("v").alias("w"), F.col("new").alias("higher"))
        after = step.join(up, step["new"] == up["w"], "left").select("v", "label", F.least("new", F.coalesce("higher", "new")).alias("new")).checkpoint()
        done = after.where("label <> new").isEmpty()
        labels = after.select("v", F.col("new").alias("label"))
        if done:
            break
    else:
        raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
    return names.join(labels, "v").select("pos", "allele", F.col("label").alias("component"))


def connectivity(comps: DataFrame) -> DataFrame:
    """``POS, comp_ref, comp_alt, status``: lcc if both alleles are in the largest component, split if they part, else non_lcc."""
    sizes = comps.groupBy("component").agg(F.count("*").alias("size"))
    largest = sizes.agg(F.min(F.struct(-F.col("size"), F.col("component"))).alias("b")).select(F.col("b.component").alias("largest"))
    of = lambda a: F.max(F.when(F.col("allele") == a, F.col("component")))
    snps = comps.groupBy(F.col("pos").alias("POS")).agg(of("ref").alias("comp_ref"), of("alt").alias("comp_alt"))
    status = F.when(F.coalesce(F.col("comp_ref") != F.col("comp_alt"), F.lit(True)), "split").when(F.col("comp_ref") == F.col("largest"), "lcc").otherwise("non_lcc")
    # the largest component is one row
    return snps.join(F.broadcast(largest)).select("POS", "comp_ref", "comp_alt", status.alias("status"))
