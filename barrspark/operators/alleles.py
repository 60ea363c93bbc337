"""Count tables to alleles by cell, SNP filters and the forensics of duplicates. Cells stay rows, never columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barrspark.functions.scalars import ratio
from barrspark.schema import COUNT_COLUMNS

#: Columns of the standard table by the names of the count table.
STANDARD = {"position": "POS", "refAllele": "REF", "altAllele": "ALT", "refCount": "REFcount", "altCount": "ALTcount", "gene": "Gene", "contig": "CONTIG", "totalCount": "TOTALcount", "otherCount": "OTHcount", "cell_barcode": "cell_barcode"}


def standardise(counts: DataFrame, counted: bool = False) -> DataFrame:
    """The standard columns, of whatever case, with whole numbers; rows of a blank gene are left out.

    A gene named ``.`` is no blank here. ``SNP_ID`` is contig, position and both alleles. ``counted``: the counts come straight
    from reads at known positions, so numbers are whole and never null; kept as they are, rows stay dealt by position.
    """
    by_lower = {c.lower(): c for c in counts.columns}
    if all(c.lower() in by_lower for c in COUNT_COLUMNS):
        counts = counts.select(*[F.col(by_lower[k.lower()]).alias(v) for k, v in STANDARD.items()])
    missing = [c for c in ("cell_barcode", "POS", "REF", "ALT", "REFcount", "ALTcount", "Gene") if c not in counts.columns]
    if missing:
        raise ValueError(f"the count table lacks {', '.join(missing)}")
    for c in ("POS", "REFcount", "ALTcount", "TOTALcount", "OTHcount"):
        if c in counts.columns and not counted:
            counts = counts.withColumn(c, F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)).cast("long"))
    blank = F.upper(F.trim("Gene")).isin("", "NA", "-")
    if "CONTIG" in counts.columns:
        counts = counts.withColumn("SNP_ID", F.concat_ws(":", "CONTIG", "POS", "REF", "ALT"))
    return counts.where(F.col("Gene").isNotNull() & ~blank)


def allele_cells(std: DataFrame) -> DataFrame:
    """``pos, allele, cell_barcode, n`` with both alleles of each pair, summed over repeats."""
    both = F.explode(F.array(F.struct(F.lit("ref").alias("allele"), F.col("r").alias("n")), F.struct(F.lit("alt").alias("allele"), F.col("a").alias("n"))))
    sums = cell_sums(std)
    return sums.select(F.col("POS").alias("pos"), "cell_barcode", both.alias("x")).select("pos", "x.allele", "cell_barcode", "x.n")


def cell_sums(std: DataFrame) -> DataFrame:
    return std.groupBy("POS", "cell_barcode").agg(F.sum("REFcount").alias("r"), F.sum("ALTcount").alias("a"))


def snp_totals(std: DataFrame) -> DataFrame:
    out = std.groupBy("POS").agg(F.sum("REFcount").alias("ref_total"), F.sum("ALTcount").alias("alt_total"))
    out = out.withColumn("total", F.col("ref_total") + F.col("alt_total"))
    return out.withColumn("ref_fraction", ratio(F.col("ref_total"), F.col("total")))


def cutoffs(lower: float, upper: float | None = None) -> tuple[float, float]:
    upper = 1 - lower if upper is None else upper
    if not 0 <= lower <= upper <= 1:
        raise ValueError(f"cutoffs must satisfy 0 <= {lower} <= {upper} <= 1")
    return lower, upper


def filter_snps(std: DataFrame, min_reads: int = 10, lower: float = 0.01, upper: float | None = None) -> DataFrame:
    """Totals of the positions with enough reads and a share of the reference between the cutoffs, ends included."""
    lower, upper = cutoffs(lower, upper)
    return snp_totals(std).where((F.col("total") >= min_reads) & F.col("ref_fraction").between(lower, upper))


def best_gene(std: DataFrame) -> DataFrame:
    """``POS, Gene``: the gene with most reads at a position, of equals the first by name; blanks are left out."""
    support = std.where(~F.trim("Gene").isin("", ".", "-") & (F.upper(F.trim("Gene")) != "NA")).groupBy("POS", "Gene")
    support = support.agg(F.sum(F.col("REFcount") + F.col("ALTcount")).alias("support"))
    return support.groupBy("POS").agg(F.min(F.struct(-F.col("support"), F.col("Gene"))).alias("b")).select("POS", F.col("b.Gene").alias("Gene"))


def duplicate_groups(std: DataFrame) -> DataFrame:
    """Cells and positions in several rows, and why."""
    pair = F.concat_ws(">", "REF", "ALT")
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in std.columns])
    out = std.groupBy("cell_barcode", "POS").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("CONTIG").alias("contigs_n"),
        F.count_distinct("Gene").alias("genes_n"),
        F.count_distinct(pair).alias("allele_pairs_n"),
        F.count_distinct(row).alias("distinct_n"),
    )
    cause = (
        F.when(F.col("allele_pairs_n") > 1, "multi-allelic")
        .when(F.col("genes_n") > 1, "different-gene")
        .when(F.col("contigs_n") > 1, "different-contig")
        .when(F.col("distinct_n") == 1, "exact-duplicate-row")
        .otherwise("same-allele_repeated")
    )
    return out.where("n_rows > 1").withColumn("cause", cause).drop("distinct_n")


def duplicate_examples(groups: DataFrame, per_cause: int = 10) -> DataFrame:
    """The first groups of each cause, by cell and position; the number of groups is the report's limit."""
    order = W.partitionBy("cause").orderBy("cell_barcode", "POS")
    return groups.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_cause).drop("k")
