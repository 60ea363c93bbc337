"""The roles of the standard tables: order lines stand for reads on SNPs, parts for SNPs and genes, suppliers for cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read evidence, with base quality, mapping quality and haplotype-group columns."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("read_id"),
        F.concat(F.lit("C"), "l_suppkey").alias("cell_barcode"),
        F.lit("chrX").alias("contig"),
        F.col("l_partkey").alias("position"),
        F.col("p_brand").alias("gene"),
        F.lit("A").alias("refAllele"),
        F.lit("G").alias("altAllele"),
        F.when(F.col("l_returnflag") == "A", "ref").when(F.col("l_returnflag") == "N", "alt").otherwise("other").alias("allele_class"),
    )


def standard(spark: SparkSession, sf_dir: str, alleles_only: bool = False) -> DataFrame:
    """The standard table of the reads; ``alleles_only`` drops those of neither allele before they are joined, for what only counts alleles."""
    from barrspark.operators.alleles import standardise
    from barrspark.operators.counting import allele_counts

    reads = evidence(spark, sf_dir)
    return standardise(allele_counts(reads.where("allele_class <> 'other'") if alleles_only else reads), counted=True)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as cells: donor, cell type, groups; a group is missing where a nation's number is divisible by five."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(
        F.concat(F.lit("C"), "s_suppkey").alias("cell"),
        F.col("n_name").alias("donor_id"),
        F.concat(F.lit("T"), F.pmod("s_suppkey", F.lit(6)).cast("string")).alias("cell_type"),
        F.when(F.pmod("s_nationkey", F.lit(5)) != 0, F.concat(F.lit("S"), (F.col("n_regionkey")).cast("string"))).alias("sample_group"),
        F.when(F.col("s_acctbal") > 0, "Healthy").otherwise("Disease").alias("disease_group"),
        F.when(F.col("s_nationkey") % 5 != 0, "adult").alias("age_group"),
    )


def cell_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell, gene_name, xi, xa``: inactive reads are alternatives of high quality, active ones references."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.concat(F.lit("C"), "l_suppkey").alias("cell"), F.concat_ws("/", "p_brand", "p_size").alias("gene_name")).agg(
        F.count_if((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 40)).alias("xi"), F.count_if(F.col("l_returnflag") == "A").alias("xa")
    )


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes (brand and size) with chromosome, published status and region; some genes have none."""
    genes = table(spark, sf_dir, "part").select("p_brand", "p_size").distinct()
    status = F.when(F.col("p_size") % 6 == 0, "Escape").when(F.col("p_size") % 6 == 1, "Variable").when(F.col("p_size") % 6 == 2, "Inactive").when(F.col("p_size") % 6 == 3, "Unknown")
    return genes.select(
        F.concat_ws("/", "p_brand", "p_size").alias("gene_symbol"),
        F.when(F.col("p_size") % 10 == 9, "chr8").otherwise("chrX").alias("chrom"),
        status.alias("xci_status"),
        F.when(F.col("p_size") % 6 >= 3, F.when(F.col("p_size") % 4 == 0, "PAR1")).alias("PAR_region"),
        F.lit("note").alias("donor_id"),
    )


def interval_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions around the genes of :func:`interval_genes`, with both spellings of the contig and a gene each."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        F.concat(F.lit("C"), "l_suppkey").alias("cell_barcode"),
        F.when(F.col("l_linestatus") == "F", "X").otherwise("chrX").alias("contig"),
        (F.col("l_partkey") * 7000 + (F.col("l_suppkey") * 131) % 7000).alias("position"),
        F.when(F.col("l_linenumber") == 3, ".").when(F.col("l_linenumber") == 4, "Brand#11").otherwise(F.col("p_brand")).alias("gene"),
        F.lit("A").alias("refAllele"),
        F.lit("G").alias("altAllele"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("read_id"),
        F.when(F.col("l_returnflag") == "A", "ref").when(F.col("l_returnflag") == "N", "alt").otherwise("other").alias("allele_class"),
    )


def interval_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a gene; one of each customer's nation's size overlaps its neighbour."""
    start = F.col("p_partkey") * 7000
    return table(spark, sf_dir, "part").select(
        F.lit("chrX").alias("contig"),
        (start - F.when(F.col("p_size") > 40, 6500).otherwise(0)).alias("start"),
        (start + F.col("p_size") * 20).alias("end"),
        F.col("p_brand").alias("gene_name"),
        F.col("p_partkey").cast("string").alias("gene_id"),
    )


def phased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given orientation: the reference is on haplotype 1 at even positions."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 2 == 0, "ref").otherwise("alt").alias("h1_allele"))
