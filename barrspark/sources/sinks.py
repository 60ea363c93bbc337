"""Sinks: delimited tables, phased variants, routed reads and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Header of the phased variants.
VCF_HEADER = (
    "##fileformat=VCFv4.2",
    '##INFO=<ID=GENE,Number=1,Type=String,Description="Gene">',
    '##INFO=<ID=STAGE,Number=1,Type=String,Description="Phasing stage">',
    '##INFO=<ID=STAGE2_METHOD,Number=1,Type=String,Description="Method of the second stage">',
    '##INFO=<ID=TOTAL_COVERAGE,Number=1,Type=Integer,Description="Reads of both alleles over all cells">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Phased genotype">',
    '##FORMAT=<ID=PS,Number=1,Type=Integer,Description="Phase set">',
)


def write_table(df: DataFrame, path: str, separator: str = "\t", header: bool = True, order: list[str] | None = None) -> None:
    """One file, in order where asked; an empty table has its header."""
    df = df.orderBy(*order) if order else df
    df.coalesce(1).write.mode("overwrite").option("sep", separator).option("header", header).option("emptyValue", "").option("nullValue", "").csv(path)


def write_vcf(table: DataFrame, path: str, sample: str = "sample") -> None:
    """Phased variants of a table of haplotypes, by contig and position."""
    from barrspark.operators.validation import vcf_lines

    if table.isEmpty():
        raise ValueError("no phased variant to write")
    spark = table.sparkSession
    head = [*VCF_HEADER, "\t".join(("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample))]
    top = spark.createDataFrame([("", i - len(head), x) for i, x in enumerate(head)], "CONTIG string, POS long, line string")
    top.unionByName(vcf_lines(table)).coalesce(1).sortWithinPartitions("CONTIG", "POS").select("line").write.mode("overwrite").text(path)


def write_routed(routed: DataFrame, path: str) -> None:
    """Reads by label, a folder each."""
    routed.write.mode("overwrite").partitionBy("label").parquet(path)


def write_matrix(wide: DataFrame, path: str) -> None:
    first, *rest = wide.columns
    wide.select(F.col(first).alias(" "), *[F.col(f"`{c}`") for c in rest]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
