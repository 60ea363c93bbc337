"""Command line: ``python -m barrspark.cli <stage> …``; ``run`` goes from reads to matrices, ``downstream`` from cells to escape."""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barrspark.plans.pipeline import Options, Run
from barrspark.sources import bam, text


def _reads(spark: SparkSession, path: str) -> DataFrame:
    """Alignments: BAM (a file or a folder), or a Parquet table of the schema of reads."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else bam.read_bam(spark, path)


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else text.read_table(spark, path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="barrspark", description=__doc__)
    sub = p.add_subparsers(dest="stage")
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--out", required=True, help="folder of the tables that stages write and read")
    common.add_argument("--force", action="store_true")
    common.add_argument("--dry-run", action="store_true")
    common.add_argument("--skip", action="append", default=[], choices=["count", "phase", "tag", "split", "matrices"])
    for f in dataclasses.fields(Options):
        name = "--" + f.name.replace("_", "-")
        if f.name == "skip":
            continue
        if f.type == "bool":
            common.add_argument(name, action="store_true")
        else:
            kind = {"int": int, "float": float}.get(str(f.type).split(" ")[0], str)
            common.add_argument(name, type=kind, default=f.default)
    for stage in ("count", "phase", "tag", "split", "matrices", "run"):
        s = sub.add_parser(stage, parents=[common])
        if stage in ("count", "tag", "run"):
            s.add_argument("--bam", required=True)
        if stage in ("count", "run"):
            s.add_argument("--vcf", required=True)
            s.add_argument("--gtf")
            s.add_argument("--sample")
            s.add_argument("--region")
        if stage == "phase":
            s.add_argument("--counts", required=True)
        if stage in ("matrices", "run"):
            s.add_argument("--matrix-folder", required=stage == "matrices", help="10x folder with barcodes and features")
            s.add_argument("--exclude-read-ids")
    d = sub.add_parser("downstream")
    for name in ("values", "cells", "annotation", "out"):
        d.add_argument(f"--{name}", required=True)
    d.add_argument("--annotation-folder")
    d.add_argument("--escape-mode", default="recovery")
    d.add_argument("--xi-cutoff", type=float)
    d.add_argument("--min-donors", type=int)
    d.add_argument("--min-total-reads", type=int, default=3)
    d.add_argument("--min-cells-with-signal", type=int, default=2)
    d.add_argument("--healthy-only", action="store_true")
    d.add_argument("--all-chromosomes", action="store_true")
    d.add_argument("--ignore-disease", action="store_true")
    d.add_argument("--force", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.stage is None:
        p.print_help()
        return 0
    spark = SparkSession.builder.appName(f"barrspark {a.stage}").getOrCreate()
    if a.stage == "downstream":
        run = Run(spark, a.out, force=a.force)
        values = _table(spark, a.values).select("cell", "gene_name", F.col("xi").cast("long").alias("xi"), F.col("xa").cast("long").alias("xa"))
        run.escape(
            values, _table(spark, a.cells), text.load_annotation(spark, a.annotation, a.annotation_folder), a.escape_mode, a.xi_cutoff, a.min_donors, a.min_total_reads,
            a.min_cells_with_signal, not a.ignore_disease, a.healthy_only, not a.all_chromosomes,
        )
        return 0
    known = {f.name for f in dataclasses.fields(Options)}
    run = Run(spark, a.out, Options(**{k: v for k, v in vars(a).items() if k in known and k != "skip"} | {"skip": set(a.skip)}), a.force, a.dry_run)
    there = lambda name: spark.read.parquet(f"{run.out}/{name}")
    whole = a.stage == "run"
    if whole or a.stage == "count":
        contig, start, end = text_region(a.region)
        variants = text.read_vcf(spark, a.vcf, a.sample, contig, start, end)
        run.count(_reads(spark, a.bam), variants, text.read_gtf(spark, a.gtf) if a.gtf else None)
    if whole or a.stage == "phase":
        counts = _table(spark, a.counts) if a.stage == "phase" else there("count/kept" if a.gtf else "count/counts")
        run.phase(counts)
    if whole or a.stage == "tag":
        run.tag(_reads(spark, a.bam), there("phase/haplotypes"), there("phase/haplotype_sums"))
    if whole or a.stage == "split":
        run.split(there("tag/reads"))
    if (whole or a.stage == "matrices") and a.matrix_folder:
        ids = text.read_excluded_ids(spark, a.exclude_read_ids) if a.exclude_read_ids else None
        if ids is None and whole and a.gtf:
            ids = there("count/dropped_read_ids")
        run.matrices(there("split/reads"), text.read_features(spark, a.matrix_folder), text.read_barcodes(spark, a.matrix_folder), ids)
    return 0


def text_region(region: str | None) -> tuple[str | None, int, int | None]:
    from barrspark.functions.scalars import parse_region

    return parse_region(region) if region else (None, 1, None)


if __name__ == "__main__":
    raise SystemExit(main())
