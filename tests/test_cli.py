"""The command line: help, and a run from alignments to routed reads."""

import gzip

from barrspark import cli
from tests.test_operators import write_bam


def test_help(capsys):
    assert cli.main([]) == 0 and "downstream" in capsys.readouterr().out


def test_run_from_bam(spark, tmp_path):
    (tmp_path / "bam").mkdir()
    reads = []
    for i in range(240):
        cell, site = i % 12, (i // 12) % 4
        first = cell % 2 == 0
        base = "A" if first == (site % 2 == 0) else "G"
        reads.append((f"r{i}", 0, 99 + 10 * site, [(0, 1)], base, [40], [("CB", f"c{cell}-1"), ("GN", f"g{site}")]))
    write_bam(tmp_path / "bam" / "a.bam", reads)
    vcf = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n" + "".join(f"chrX\t{100 + 10 * s}\t.\tA\tG\t.\t.\t.\tGT\t0/1\n" for s in range(4))
    (tmp_path / "v.vcf").write_text(vcf)
    m = tmp_path / "m"
    m.mkdir()
    (m / "barcodes.tsv.gz").write_bytes(gzip.compress("".join(f"c{i}-1\n" for i in range(12)).encode()))
    (m / "features.tsv.gz").write_bytes(gzip.compress("".join(f"i{i}\tg{i}\n" for i in range(4)).encode()))
    out = str(tmp_path / "o")
    assert cli.main(["run", "--bam", str(tmp_path / "bam"), "--vcf", str(tmp_path / "v.vcf"), "--matrix-folder", str(m), "--out", out, "--tag-mode", "count", "--stage2-tie-action", "skip"]) == 0
    xx = {r.XX: r["count"] for r in spark.read.parquet(f"{out}/tag/reads").groupBy("XX").count().collect()}
    assert xx == {"Xa": 240}
    assert sum(spark.read.parquet(f"{out}/matrices/{x}").agg({"n": "sum"}).first()[0] or 0 for x in ("X1", "X2")) == 240
