"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


ALIGNED = "array<struct<qpos:int,rpos:bigint,kind:string>>"
#: ``aligned.rpos`` is 0-based; ``kind`` is one of base, del, indel_anchor, refskip.
READS_DDL = (
    f"read_id string, contig string, pos bigint, flags int, mapq int, seq string, quals array<int>, aligned {ALIGNED}, "
    "cb string, gn string, ub string, tr string, ordinal bigint"
)
VARIANTS_DDL = "contig string, pos bigint, ref string, alts array<string>, sample string, gt array<int>, phased boolean, ordinal bigint"
GENES_DDL = "contig string, start bigint, end bigint, gene_name string, gene_id string, strand string"
COUNT_COLUMNS = (
    "cell_barcode",
    "contig",
    "position",
    "gene",
    "refAllele",
    "altAllele",
    "refCount",
    "altCount",
    "totalCount",
    "otherCount",
)
EVIDENCE_COLUMNS = ("read_id", "cell_barcode", "contig", "position", "gene", "refAllele", "altAllele", "allele_class")
