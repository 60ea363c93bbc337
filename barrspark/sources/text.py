"""Sources in text: count tables, calls, lists of identifiers, GTF, VCF, 10x matrices and annotations.

Compressed text is read by Spark; no file is opened on the driver but through Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barrspark.functions.scalars import normalise_species


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id())


def sniff_separator(spark: SparkSession, path: str) -> str:
    """Tab, comma or semicolon, by the header line; a file of one column counts as separated by tabs."""
    head = spark.read.text(path).head()
    line = head[0] if head else ""
    return max("\t,;", key=line.count) if any(c in line for c in "\t,;") else "\t"


def read_table(spark: SparkSession, path: str, separator: str | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """A table with a header, every column a string; the separator is found on the header line unless given."""
    out = spark.read.csv(path, sep=separator or sniff_separator(spark, path), header=True, inferSchema=False)
    missing = [c for c in required if c not in out.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return out


def read_active_x(spark: SparkSession, path: str) -> DataFrame:
    """``cell_barcode, active_X, ordinal``; of several rows of a cell the last counts where it is used."""
    return read_table(spark, path, required=("cell_barcode", "active_X")).select("cell_barcode", "active_X").withColumn("ordinal", F.monotonically_increasing_id())


def read_excluded_ids(spark: SparkSession, path: str) -> DataFrame:
    """``read_id`` from a list, with or without a header: the column of that name, else the first one."""
    head = spark.read.text(path).head()
    columns = head[0].split("\t") if head else []
    at = columns.index("read_id") if "read_id" in columns else 0
    ids = spark.read.text(path).select(F.get(F.split("value", "\t"), at).alias("read_id"))
    return ids.where("read_id is not null and trim(read_id) <> '' and read_id <> 'read_id'").distinct()


def _attribute(attributes: Column, name: str) -> Column:
    """The last value of a GTF attribute; null if it is not there."""
    found = F.regexp_extract_all(attributes, F.lit(f'(?:^|[;\\s]){name}\\s+"([^"]*)"'), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def read_gtf(spark: SparkSession, path: str, feature: str | None = "gene", name_attribute: str = "gene_name", id_attribute: str = "gene_id") -> DataFrame:
    """Intervals of a feature: 1-based, closed. Comments, short lines and lines without whole coordinates are left out.

    A missing name is the identifier, and the other way round.
    """
    f = F.split("value", "\t")
    rows = _lines(spark, path).where(~F.col("value").startswith("#") & (F.size(f) >= 9))
    rows = rows.select(
        F.get(f, 0).alias("contig"), F.get(f, 2).alias("feature"), F.get(f, 3).try_cast("long").alias("start"), F.get(f, 4).try_cast("long").alias("end"), F.get(f, 6).alias("strand"),
        F.get(f, 8).alias("attributes"), "ordinal",
    ).where("start is not null and end is not null")
    if feature is not None:
        rows = rows.where(F.col("feature") == feature)
    a = F.col("attributes")
    name, ident = _attribute(a, name_attribute), _attribute(a, id_attribute)
    return rows.select(
        "contig", "feature", "start", "end", F.coalesce(name, ident).alias("gene_name"), F.coalesce(ident, name).alias("gene_id"), "strand",
        _attribute(a, "transcript_id").alias("transcript_id"), _attribute(a, "transcript_name").alias("transcript_name"), "ordinal",
    )


def chrx_features(gtf: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Genes, transcript identifiers and transcript names of the X chromosome, each once with its first ordinal."""
    x = gtf.where(F.col("contig").isin("chrX", "X"))
    first = lambda rows, c: rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("feature")).agg(F.min("ordinal").alias("ordinal"))
    transcripts = x.where(F.col("feature").isin("transcript", "exon"))
    return first(x.where("feature = 'gene'"), "gene_name"), first(transcripts, "transcript_id"), first(transcripts, "transcript_name")


def read_vcf(spark: SparkSession, path: str, sample: str | None = None, contig: str | None = None, start: int = 1, end: int | None = None) -> DataFrame:
    """Variants with one sample's genotype: the asked one, which must be there, or else the first.

    ``gt`` has null for a missing allele and is null without a genotype. A region limits contig and positions.
    """
    header = spark.read.text(path).where(F.col("value").startswith("#CHROM")).head()
    columns = header[0].split("\t") if header else []
    samples = columns[9:]
    if sample is not None and sample not in samples:
        raise ValueError(f"sample {sample!r} is not in {path}")
    at = 9 + (samples.index(sample) if sample else 0)
    f = F.split("value", "\t")
    rows = _lines(spark, path).where(~F.col("value").startswith("#"))
    rows = rows.select(F.get(f, 0).alias("contig"), F.get(f, 1).try_cast("long").alias("pos"), F.get(f, 3).alias("ref"), F.get(f, 4).alias("alt"), F.get(f, 8).alias("format"), F.get(f, at).alias("call"), "ordinal")
    if contig is not None:
        rows = rows.where((F.col("contig") == contig) & (F.col("pos") >= start) & (F.lit(True) if end is None else F.col("pos") <= end))
    place = F.array_position(F.split("format", ":"), "GT")
    gt = F.when(place > 0, F.get(F.split("call", ":"), (place - 1).cast("int")))
    alts = F.filter(F.split("alt", ","), lambda a: ~a.isin(".", ""))
    return rows.select(
        "contig", "pos", "ref", alts.alias("alts"), F.lit(columns[at] if len(columns) > at else None).cast("string").alias("sample"),
        F.transform(F.split(gt, "[|/]"), lambda g: g.try_cast("int")).alias("gt"), F.contains(gt, F.lit("|")).alias("phased"), "ordinal",
    )


def read_barcodes(spark: SparkSession, folder: str) -> DataFrame:
    """``cell_barcode, ordinal`` of a 10x matrix folder; one file, so its lines are in order."""
    return _lines(spark, f"{folder}/barcodes.tsv*").select(F.get(F.split("value", "\t"), 0).alias("cell_barcode"), "ordinal")


def read_features(spark: SparkSession, folder: str) -> DataFrame:
    """``feature_id, feature`` (the symbol) and ``ordinal``."""
    f = F.split("value", "\t")
    return _lines(spark, f"{folder}/features.tsv*").select(F.get(f, 0).alias("feature_id"), F.coalesce(F.get(f, 1), F.get(f, 0)).alias("feature"), "ordinal")


def read_10x(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Values (``gene, cell, value``; repeated symbols are summed), cells and genes of a 10x matrix folder.

    A file's ordinals count up from the first of its only partition, as compressed text is not split and other text is
    small; they are compared with the matrix's numbers.
    """
    cells, genes = read_barcodes(spark, folder), read_features(spark, folder)
    f = F.split(F.trim("value"), "\\s+")
    entries = _lines(spark, f"{folder}/matrix.mtx*").where(~F.col("value").startswith("%"))
    size_line = entries.agg(F.min("ordinal").alias("o"))
    entries = entries.join(F.broadcast(size_line), F.col("ordinal") != F.col("o")).select(F.get(f, 0).cast("long").alias("i"), F.get(f, 1).cast("long").alias("j"), F.get(f, 2).cast("double").alias("value"))
    rows = entries.join(genes.select((F.col("ordinal") + 1).alias("i"), F.col("feature").alias("gene")), "i").join(cells.select((F.col("ordinal") + 1).alias("j"), F.col("cell_barcode").alias("cell")), "j")
    return rows.groupBy("gene", "cell").agg(F.sum("value").alias("value")), cells.select(F.col("cell_barcode").alias("cell")), genes.select(F.col("feature").alias("gene")).distinct()


def read_matrix_csv(spark: SparkSession, path: str) -> DataFrame:
    """A written matrix (features by barcodes) as ``gene, cell, value``, without its zeros."""
    wide = spark.read.csv(path, header=True, inferSchema=False)
    first, *barcodes = wide.columns
    pairs = F.map_from_arrays(F.array(*map(F.lit, barcodes)), F.array(*[F.col(f"`{b}`").cast("double") for b in barcodes])) if barcodes else F.lit(None).cast("map<string,double>")
    return wide.select(F.col(f"`{first}`").alias("gene"), F.explode(pairs).alias("cell", "value")).where("value <> 0")


def load_annotation(spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    """An annotation by path, or by a species' name where a folder holds ``<species>.tsv``; every column is a string."""
    try:
        species = normalise_species(name)
    except ValueError:
        return read_table(spark, name)
    if folder is None:
        raise ValueError(f"annotations of {species} are not packaged; give their folder or a path")
    return read_table(spark, f"{folder.rstrip('/')}/{species}.tsv")
