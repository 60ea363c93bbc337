"""From cells with active and inactive reads to escape: atlas, master table, shrinkage, pooling, calls and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barrspark.functions.scalars import STATUS_CLASSES, as_bool, clean_chr, escape_display, joined_distinct, ratio

GROUP = ("donor_id", "cell_type", "sample_group", "disease_group", "age_group")
#: Parameters of the prior.
FALLBACK_STRENGTH, LEAST_PARAMETER = 20.0, 0.001


def _same(a: DataFrame, b: DataFrame, keys) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def atlas(values: DataFrame, cells: DataFrame, genes: DataFrame | None = None, min_total_reads: int = 3, min_cells: int = 2, keep_zero_rows: bool = False) -> DataFrame:
    """Reads of both copies by gene and group of cells; groups with missing parts are groups too.

    ``values`` has ``cell, gene_name, xi, xa``, ``cells`` the group's columns. The number of cells is that of the whole
    group. With ``keep_zero_rows`` every gene of ``genes`` has a row in every group.
    """
    seen = values.join(cells.select("cell", *GROUP), "cell").groupBy("gene_name", *GROUP)
    sums = seen.agg(F.sum("xi").alias("xi_reads"), F.sum("xa").alias("xa_reads"), F.count_if(F.col("xi") + F.col("xa") != 0).alias("n_cells_with_signal"))
    sizes = cells.groupBy(*GROUP).agg(F.count("*").alias("n_cells_total_group"))
    if keep_zero_rows:
        # each group and gene: the result itself has these rows
        scaffold = sizes.select(*GROUP).withColumn("one", F.lit(1)).join(genes.select("gene_name").withColumn("one", F.lit(1)), "one").drop("one")
        sums = scaffold.join(sums, _same(scaffold, sums, ("gene_name", *GROUP)), "left").select(scaffold["gene_name"], *[scaffold[g] for g in GROUP], *[F.coalesce(sums[c], F.lit(0)).alias(c) for c in ("xi_reads", "xa_reads", "n_cells_with_signal")])
    out = sums.join(sizes, _same(sums, sizes, GROUP)).select(sums["gene_name"], *[sums[g] for g in GROUP], "n_cells_total_group", "xi_reads", "xa_reads", (F.col("xi_reads") + F.col("xa_reads")).alias("total_allelic_reads"), "n_cells_with_signal")
    if not keep_zero_rows:
        out = out.where("total_allelic_reads > 0")
    enough = (F.col("total_allelic_reads") >= min_total_reads) & (F.col("n_cells_with_signal") >= min_cells)
    return out.withColumn("informative_firstpass", enough).withColumn("xi_raw_firstpass", ratio(F.col("xi_reads"), F.col("total_allelic_reads")))


def standard_annotation(table: DataFrame) -> DataFrame:
    """Annotation by ``gene_name`` with chromosome, class and group; of repeated genes the least row is taken.

    A published status sets the class, and overrides a mark of the pseudoautosomal region.
    """
    if "gene_name" not in table.columns:
        if "gene_symbol" not in table.columns:
            raise ValueError("an annotation must have gene_name or gene_symbol")
        table = table.withColumnRenamed("gene_symbol", "gene_name")
    if "chrom" in table.columns and "chromosome_clean" not in table.columns:
        table = table.withColumn("chromosome_clean", clean_chr(F.col("chrom")))
    if "is_chrX" not in table.columns and "chromosome_clean" in table.columns:
        table = table.withColumn("is_chrX", F.coalesce(F.upper("chromosome_clean") == "X", F.lit(False)).cast("string"))
    status = next((c for c in ("xci_status", "category") if c in table.columns), None)
    if "preferred_escape_class" not in table.columns and status:
        par = F.lit(False)
        for c, names in (("PAR_status", ("PAR", "PAR1", "PAR2")), ("PAR_region", ("PAR1", "PAR2"))):
            if c in table.columns:
                par = par | F.coalesce(F.col(c).isin(*names), F.lit(False))
        known = F.create_map(*[F.lit(x) for kv in STATUS_CLASSES.items() for x in kv])
        table = table.withColumn("preferred_escape_class", F.coalesce(F.try_element_at(known, F.col(status)), F.when(par, "PAR")))
    if "atlas_gene_group" not in table.columns and "preferred_escape_class" in table.columns:
        table = table.withColumn("atlas_gene_group", F.col("preferred_escape_class"))
    rest = [c for c in table.columns if c not in ("gene_name", "ordinal")]
    row = F.struct(*([F.col("ordinal")] if "ordinal" in table.columns else []), *[F.col(c) for c in rest])
    return table.groupBy("gene_name").agg(F.min(row).alias("r")).select("gene_name", *[F.col(f"r.{c}").alias(c) for c in rest])


def master(rows: DataFrame, annotation: DataFrame, healthy_only: bool = False, chrx_only: bool = True) -> DataFrame:
    """Atlas rows with their gene's annotation; annotation columns whose name is taken end in ``.ann``."""
    taken = set(rows.columns)
    renamed = annotation.select("gene_name", *[F.col(c).alias(f"{c}.ann" if c in taken else c) for c in annotation.columns if c != "gene_name"])
    out = rows.join(renamed, "gene_name", "left")
    if "atlas_gene_group" in out.columns:
        out = out.withColumn("atlas_gene_group_display", escape_display(F.col("atlas_gene_group")))
    if healthy_only:
        out = out.where("disease_group = 'Healthy'")
    if chrx_only and "is_chrX" in out.columns:
        out = out.where(F.lower(F.trim(F.col("is_chrX").cast("string"))).isin("true", "1", "x", "chrx"))
    elif chrx_only and "chromosome_clean" in out.columns:
        out = out.where(F.col("chromosome_clean").isin("X", "x", "chrX"))
    return out


def merge_qc(rows: DataFrame, annotation: DataFrame) -> DataFrame:
    repeated = annotation.groupBy("gene_name").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_duplicate_annotation_genes"))
    klass = F.col("preferred_escape_class") if "preferred_escape_class" in rows.columns else F.lit(None)
    one = rows.agg(
        F.count("*").alias("n_rows"), F.count_distinct("gene_name").alias("n_genes"), F.count_distinct("donor_id").alias("n_donors"),
        joined_distinct(F.col("donor_id")).alias("donors"), joined_distinct(F.col("disease_group")).alias("disease_groups"), F.count_if(klass.isNull()).alias("n_missing_class"),
    )
    return one.join(F.broadcast(repeated))  # one row each


def sample_qc(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sample_group", "disease_group").agg(F.count("*").alias("n_rows"), F.count_distinct("donor_id").alias("n_donors"), joined_distinct(F.col("donor_id")).alias("donors"))


def row_filter(rows: DataFrame, min_total_reads: int = 3, min_cells: int = 2) -> DataFrame:
    kept = as_bool(F.col("informative_firstpass")) & (F.col("total_allelic_reads") >= min_total_reads) & (F.col("n_cells_with_signal") >= min_cells)
    return rows.where(kept).withColumn("xi_raw", ratio(F.col("xi_reads"), F.col("total_allelic_reads")))


def row_filter_qc(rows: DataFrame, min_total_reads: int = 3, min_cells: int = 2) -> DataFrame:
    return rows.agg(
        F.lit(min_total_reads).alias("min_total_reads"), F.lit(min_cells).alias("min_cells_with_signal"), F.count("*").alias("n_rows"), F.count_distinct("gene_name").alias("n_genes"),
        F.count_distinct("donor_id").alias("n_donors"), F.count_distinct("cell_type").alias("n_cell_types"), joined_distinct(F.col("disease_group")).alias("disease_groups"),
    )


def beta_prior(rows: DataFrame) -> DataFrame:
    """One row: ``alpha, beta, mean, variance, method`` by the moments of ``xi_raw`` in [0, 1]."""
    x = F.when(F.col("xi_raw").between(0, 1), F.col("xi_raw"))
    d = rows.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v"))
    m = F.greatest(F.least(F.col("m"), F.lit(0.999)), F.lit(0.001))
    v = F.when(F.col("n") == 1, 0.0).otherwise(F.col("v"))
    d = d.select("n", m.alias("m"), v.alias("v"))
    spread = F.col("m") * (1 - F.col("m"))
    c = F.when(F.col("v").isNotNull() & (F.col("v") > 0) & (F.col("v") < spread), F.try_divide(spread, F.col("v")) - 1)
    method = F.when(F.col("n") == 0, "fallback_empty").when(c.isNull(), "fallback_strength").otherwise("method_of_moments")
    strength = F.coalesce(c, F.lit(FALLBACK_STRENGTH))
    floor = lambda x: F.greatest(x, F.lit(LEAST_PARAMETER))
    alpha = F.when(F.col("n") == 0, 2.0).otherwise(floor(F.col("m") * strength))
    beta = F.when(F.col("n") == 0, 18.0).otherwise(floor((1 - F.col("m")) * strength))
    d = d.select(alpha.alias("alpha"), beta.alias("beta"), F.when(F.col("n") > 0, F.col("v")).alias("variance"), method.alias("method"))
    return d.select("alpha", "beta", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("mean"), "variance", "method")


def shrink(rows: DataFrame, prior: DataFrame) -> DataFrame:
    """Adds ``xi_shrunk``; the prior is one row."""
    p = F.broadcast(prior.select(F.col("alpha").alias("_a"), F.col("beta").alias("_b")))
    value = (F.col("xi_reads") + F.col("_a")) / (F.col("total_allelic_reads") + F.col("_a") + F.col("_b"))
    return rows.join(p).withColumn("xi_shrunk", value).drop("_a", "_b")


def backbone(rows: DataFrame) -> DataFrame:
    return rows.groupBy("disease_group", "cell_type").agg(F.avg("xi_shrunk").alias("xi_shrunk_celltype_mean"), F.sum("total_allelic_reads").alias("celltype_total_reads"))


def pooled(rows: DataFrame) -> DataFrame:
    """Donors' cell types, each drawn to its backbone by how its reads compare with the median; missing groups match each other."""
    keys = ("donor_id", "sample_group", "disease_group", "age_group", "cell_type")
    d = rows.groupBy(*keys).agg(F.avg("xi_shrunk").alias("xi_shrunk_mean"), F.count_distinct("gene_name").alias("n_informative_genes"), F.sum("total_allelic_reads").alias("total_reads"))
    b = backbone(rows)
    median = d.agg(F.median("total_reads").alias("_m")).select(F.when(F.col("_m") > 0, F.col("_m")).otherwise(1.0).alias("_m"))
    out = d.join(b, _same(d, b, ("disease_group", "cell_type")), "left").drop(b["disease_group"]).drop(b["cell_type"]).join(F.broadcast(median))
    out = out.withColumn("pool_weight", F.col("total_reads") / (F.col("total_reads") + F.col("_m"))).drop("_m")
    w = F.col("pool_weight")
    return out.withColumn("xi_pooled", w * F.col("xi_shrunk_mean") + (1 - w) * F.col("xi_shrunk_celltype_mean"))


def escape_summary(rows: DataFrame, mode: str = "recovery", cutoff: float = 0.10, min_donors: int = 1, by_disease: bool = True, annotation: tuple[str, ...] = ()) -> DataFrame:
    """Genes by cell type: mean shares, donors, and whether the gene escapes.

    ``n_escape_donors`` counts rows at or over the cutoff, as a donor may have several.
    """
    keys = (["disease_group"] if by_disease else []) + ["gene_name", "cell_type"]
    out = rows.groupBy(*keys).agg(
        F.avg("xi_shrunk").alias("mean_xi"), F.avg("xi_raw").alias("mean_xi_raw"), F.count_distinct("donor_id").alias("n_donors"),
        F.count_if(F.col("xi_shrunk") >= cutoff).alias("n_escape_donors"), F.sum("total_allelic_reads").alias("total_allelic_reads"), F.count("*").alias("n_rows"),
        *[F.first(c, ignorenulls=True).alias(c) for c in annotation],
    )
    informative = F.col("n_donors") >= min_donors
    call = (F.col("n_escape_donors") >= min_donors) if mode in ("recovery", "strict") else informative & (F.col("mean_xi") >= cutoff)
    return out.withColumn("informative", informative).withColumn("escape_call", call)


def pattern(e: Column, i: Column, n: Column, shared: int = 6, low: int = 3, high: int = 5, selective: int = 2, require_non_escape: bool = False, min_informative: int = 0, min_non_escape: int = 0) -> Column:
    """Class of a gene by its numbers of escaping, informative, and informative but not escaping cell types."""
    if require_non_escape:
        enough = (i >= min_informative) & (n >= min_non_escape)
        middle, few = e.between(low, high) & enough, e.between(1, selective) & enough
    else:
        middle, few = (e >= low) & (e < shared), (e >= 1) & (e < low)
    return F.when(e >= shared, "shared_constitutive").when(middle, "intermediate_strict").when(few, "selective_strict").otherwise("does_not_pass_strict")


def pattern_summary(summary: DataFrame, by_disease: bool = True, annotation: tuple[str, ...] = (), **bounds) -> DataFrame:
    keys = (["disease_group"] if by_disease else []) + ["gene_name"]
    out_of = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("cell_type")))), ",")
    both = F.col("informative") & F.col("escape_call")
    out = summary.groupBy(*keys).agg(
        F.count_if(both).alias("n_escape_celltypes"), F.count_if("informative").alias("n_informative_celltypes"),
        F.count_if(F.col("informative") & ~F.col("escape_call")).alias("n_non_escape_informative_celltypes"),
        out_of(both).alias("escaping_celltypes"), out_of(F.col("informative")).alias("informative_celltypes"), *[F.first(c, ignorenulls=True).alias(c) for c in annotation],
    )
    kind = pattern(F.col("n_escape_celltypes"), F.col("n_informative_celltypes"), F.col("n_non_escape_informative_celltypes"), **bounds)
    return out.withColumn("escape_pattern", kind)


def call_qc(summary: DataFrame, patterns: DataFrame, mode: str, cutoff: float, min_donors: int) -> DataFrame:
    one = summary.agg(F.lit(mode).alias("escape_mode"), F.lit(cutoff).alias("xi_cutoff"), F.lit(min_donors).alias("min_donors"), F.count("*").alias("n_rows"), F.count_if("escape_call").alias("n_escape_calls"))
    return one.join(F.broadcast(patterns.agg(F.count("*").alias("n_pattern_rows"))))
