"""The whole analysis: count, phase, tag, split and matrices in one lineage, and escape from cells with layers.

A stage whose tables exist in the output folder is read rather than computed, unless forced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barrspark.functions.scalars import escape_params
from barrspark.operators import activity, alleles, concordance, counting, downstream, filters, intervals, matrices, partition, tagging, validation


@dataclass
class Options:
    """Parameters of a run, with their defaults."""

    slop: int = 1000
    max_nearest: int = 10_000
    drop_conflicts: bool = False
    drop_multi: bool = False
    min_mapq: int = 20
    min_bq: int = 10
    max_depth: int = 100_000
    allow_secondary: bool = False
    count_duplicates: bool = False
    skip_indels: bool = False
    het_only: bool = False
    min_reads: int = 10
    lower: float = 0.01
    upper: float | None = None
    partition_mode: str = "weighted"
    edge_weight_mode: str | None = None
    stage2_mode: str = "cell"
    stage2_min_evidence: float = 1.0
    stage2_tie_action: str = "random"
    tag_mode: str = "quality"
    min_base_qual: int = 5
    skip: set[str] = field(default_factory=set)


class Run:
    """Stages over a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, out: str, options: Options | None = None, force: bool = False, dry_run: bool = False):
        self.spark, self.out, self.o, self.force, self.dry_run = spark, out.rstrip("/"), options or Options(), force, dry_run
        self.commands: list[str] = []

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def step(self, name: str, make) -> DataFrame | None:
        """The table ``name``: read if it is there, else made and written."""
        path, stage = f"{self.out}/{name}", name.split("/")[0]
        have = self._there(path)
        if stage in self.o.skip and not have:
            raise FileNotFoundError(f"stage {stage} is skipped, but {path} is not there")
        if not have or (self.force and stage not in self.o.skip):
            self.commands.append(f"write {path}")
            if self.dry_run:
                return None
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def count(self, reads: DataFrame, variants: DataFrame, genes: DataFrame | None = None) -> dict[str, DataFrame]:
        o = self.o
        evidence = self.step(
            "count/evidence",
            lambda: counting.read_evidence(reads, counting.snp_sites(variants, o.het_only), o.min_bq, o.skip_indels, o.max_depth, min_mapq=o.min_mapq, allow_secondary=o.allow_secondary, count_duplicates=o.count_duplicates),
        )
        counts = self.step("count/counts", lambda: counting.allele_counts(evidence))
        if genes is None:
            return {"evidence": evidence, "counts": counts}
        annotated = self.step("count/annotated", lambda: intervals.annotate_counts(counts, genes, o.slop, o.max_nearest))
        kept, dropped = filters.filter_counts(annotated, o.drop_conflicts, o.drop_multi)
        kept, dropped = self.step("count/kept", lambda: kept), self.step("count/dropped", lambda: dropped)
        lost = self.step("count/dropped_evidence", lambda: filters.dropped_evidence(evidence, dropped))
        return {
            "evidence": evidence, "counts": kept, "dropped": dropped, "dropped_evidence": lost,
            "dropped_read_ids": self.step("count/dropped_read_ids", lambda: filters.dropped_read_ids(lost)),
            "dropped_read_summary": self.step("count/dropped_read_summary", lambda: filters.dropped_read_summary(lost)),
            "summary": self.step("count/summary", lambda: filters.filter_summary(annotated, kept, dropped)),
        }

    def phase(self, counts: DataFrame) -> dict[str, DataFrame]:
        o = self.o
        mode, weighted = concordance.edge_mode(o.partition_mode, o.edge_weight_mode)
        std = self.step("phase/standard", lambda: alleles.standardise(counts))
        genes = self.step("phase/genes", lambda: alleles.best_gene(std))
        totals = alleles.snp_totals(std)
        kept = self.step("phase/snps", lambda: alleles.filter_snps(std, o.min_reads, o.lower, o.upper))
        long = alleles.allele_cells(std).join(kept.select(F.col("POS").alias("pos")), "pos", "left_semi")
        sides = self.step("phase/sides", lambda: partition.remove_unparted(long, mode, weighted)[0])
        first = partition.haplotypes(sides)
        sums = alleles.cell_sums(std)
        calls = self.step("phase/haplotype_sums", lambda: activity.active_x(activity.haplotype_counts(sums, first), genes, sums))
        rest = sums.join(kept.select("POS"), "POS", "left_semi").join(first.select(F.col("pos").alias("POS")), "POS", "left_anti")
        scores = self.step("phase/stage2_scores", lambda: activity.orientation_scores(rest, calls, o.stage2_mode))
        second = activity.assign_stage2(scores, o.stage2_min_evidence, o.stage2_tie_action).where("h1_allele is not null")
        one = first.select("pos", "h1_allele", F.lit("stage1").alias("stage"), F.lit(None).cast("string").alias("method"))
        two = second.select(F.col("POS").alias("pos"), "h1_allele", F.lit("stage2").alias("stage"), "method")
        phased = self.step("phase/phased", lambda: one.unionByName(two))
        table = self.step("phase/haplotypes", lambda: validation.haplotype_table(std, phased, genes, totals))
        both = activity.haplotype_counts(sums, phased)
        n_cells = std.select("cell_barcode").distinct().count()
        stage1 = long.join(first.select("pos"), "pos", "left_semi")

        def metrics() -> DataFrame:
            graph = validation.partition_metrics(stage1, sides, mode)
            covered = activity.coverage_features(sums.join(phased.select(F.col("pos").alias("POS")), "POS", "left_semi"), n_cells)
            return validation.validation_matrix(graph, activity.consistency(both), covered, activity.xa_xi_reads(both, calls))

        return {"haplotype_sums": calls, "haplotypes": table, "phased": phased, "sides": sides, "stage2_scores": scores, "validation": self.step("phase/validation", metrics)}

    def tag(self, reads: DataFrame, haplotypes: DataFrame, calls: DataFrame) -> DataFrame:
        snps = haplotypes.select(F.col("CONTIG").alias("contig"), F.col("POS").alias("pos"), F.col("H1").alias("h1"), F.col("H2").alias("h2"))
        return self.step("tag/reads", lambda: tagging.tag(reads, tagging.read_scores(reads, snps, self.o.min_base_qual), calls, self.o.tag_mode))

    def split(self, tagged: DataFrame) -> DataFrame:
        return self.step("split/reads", lambda: tagging.route(tagged))

    def matrices(self, routed: DataFrame, features: DataFrame, barcodes: DataFrame, exclude_ids: DataFrame | None = None, feature: str = "gn") -> dict[str, DataFrame]:
        """Long counts by label on the scaffold of features and barcodes."""
        out = {}
        for label in tagging.LABELS:
            reads = matrices.matrix_reads(routed.where(F.col("label") == label), feature, exclude_ids)
            out[label] = self.step(f"matrices/{label}", lambda r=reads: matrices.on_scaffold(matrices.feature_counts(r, features), features, barcodes))
        return out

    def escape(self, values: DataFrame, cells: DataFrame, annotation: DataFrame, mode: str = "recovery", cutoff: float | None = None, min_donors: int | None = None, min_total_reads: int = 3, min_cells: int = 2, by_disease: bool = True, healthy_only: bool = False, chrx_only: bool = True, **bounds) -> dict[str, DataFrame]:
        """Tables 00 to 03 of the downstream layer."""
        mode, cutoff, min_donors = escape_params(mode, cutoff, min_donors)
        rows = self.step("escape/00_atlas", lambda: downstream.atlas(values, cells, min_total_reads=min_total_reads, min_cells=min_cells))
        master = self.step("escape/01_master", lambda: downstream.master(rows, downstream.standard_annotation(annotation), healthy_only, chrx_only))
        kept = downstream.row_filter(master, min_total_reads, min_cells)
        prior = self.step("escape/02_prior", lambda: downstream.beta_prior(kept))
        shrunk = self.step("escape/02_row_level", lambda: downstream.shrink(kept, prior))
        extra = tuple(c for c in ("preferred_escape_class", "atlas_gene_group", "atlas_gene_group_display", "PAR_status", "chromosome_clean", "is_chrX") if c in shrunk.columns)
        summary = self.step("escape/03_summary", lambda: downstream.escape_summary(shrunk, mode, cutoff, min_donors, by_disease, extra))
        return {
            "atlas": rows, "master": master, "prior": prior, "row_level": shrunk, "pooled": self.step("escape/02_pooled", lambda: downstream.pooled(shrunk)), "summary": summary,
            "patterns": self.step("escape/03_patterns", lambda: downstream.pattern_summary(summary, by_disease, extra, **bounds)),
        }
