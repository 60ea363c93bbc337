"""Scalar functions on columns, and the small functions of parameters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mean no gene.
BLANK_GENES = ("", ".", "-", "NA", "NAN", "NONE")
#: A gene's published status and its class here; a class is shown as its status.
STATUS_CLASSES = {
    "Escape": "nonPAR_escape",
    "Inactive": "nonPAR_subject",
    "PAR": "PAR",
    "Unknown": "nonPAR_uncertain",
    "Variable": "nonPAR_variable_escape",
}
#: Names of species.
SPECIES = {
    "human": ("human", "homo_sapiens", "hsapiens", "hg38", "grch38"),
    "mouse": ("mouse", "mus_musculus", "mmusculus", "mm39", "grcm39"),
}
#: Cutoff and least number of donors by escape mode.
ESCAPE_MODES = {"recovery": (0.10, 1), "strict": (0.20, 2), "mean_strict": (0.20, 2)}


def norm_gene(gene: Column) -> Column:
    """The trimmed gene; words for none, in any case, and null give the empty text."""
    t = F.trim(F.coalesce(gene, F.lit("")))
    return F.when(F.upper(t).isin(*BLANK_GENES), F.lit("")).otherwise(t)


def is_snp(ref: Column, alts: Column) -> Column:
    """One base for another; of several alternatives only the first counts."""
    return (F.size(alts) > 0) & (F.length(ref) == 1) & (F.length(F.get(alts, 0)) == 1)


def is_het_01(gt: Column) -> Column:
    return F.coalesce(F.array_sort(F.array_distinct(gt)) == F.array(F.lit(0), F.lit(1)), F.lit(False))


def flag_mask(allow_secondary: bool = False, count_duplicates: bool = False) -> int:
    """Alignment flags that drop a read: unmapped, and secondary, supplementary and duplicates unless allowed."""
    return 0x4 | (0 if allow_secondary else 0x100 | 0x800) | (0 if count_duplicates else 0x400)


def distance_to_interval(pos: Column, start: Column, end: Column) -> Column:
    return F.greatest(start - pos, pos - end, F.lit(0))


def candidate_contigs(contig: Column) -> Column:
    """The name, then with the prefix ``chr`` toggled, then the other names of the mitochondrion."""
    toggled = F.when(contig.startswith("chr"), F.regexp_replace(contig, "^chr", "")).otherwise(F.concat(F.lit("chr"), contig))
    other = F.when(contig == "MT", "chrM").when(contig == "chrM", "MT")
    return F.array_distinct(F.array_compact(F.array(contig, toggled, other, F.when(other.isNotNull(), "M"))))


def conflict_reason(tsv_gene: Column, gtf_genes: Column, match_type: Column) -> Column:
    """How a count's gene and the list of genes at its position agree (``gtf_genes``: array, may be empty)."""
    gene, some = norm_gene(tsv_gene), F.size(gtf_genes) > 0
    return (
        F.when(gene == "", F.when(some, "tsv_gene_blank").otherwise("both_unannotated"))
        .when(~some, "no_gtf_gene_near_position")
        .when(F.array_contains(gtf_genes, gene), "tsv_gene_matches_gtf")
        .when(match_type.isin("exact_overlap", "within_slop"), "tsv_gene_not_in_overlapping_or_slop_gtf_genes")
        .when(match_type == "nearest_within_max", "tsv_gene_differs_from_nearest_gtf_gene")
        .otherwise("unclassified_conflict")
    )


#: Reasons that are conflicts.
CONFLICTS = (
    "no_gtf_gene_near_position",
    "tsv_gene_not_in_overlapping_or_slop_gtf_genes",
    "tsv_gene_differs_from_nearest_gtf_gene",
    "unclassified_conflict",
)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share; null where ``n`` is not positive."""
    m = F.when(n > 0, n.cast("double"))
    p, scale = k / m, 1 + z * z / m
    centre = (p + z * z / (2 * m)) / scale
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * m)) / m) / scale
    return centre - half, centre + half


def ratio(a: Column, b: Column) -> Column:
    """The quotient in doubles; null where the divisor is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def mean_of_known(*xs: Column) -> Column:
    """Mean over those that are not null; null if all are."""
    n = sum((x.isNotNull().cast("int") for x in xs), F.lit(0))
    return F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0)), n.cast("double"))


def center01(x: Column) -> Column:
    return 0.5 * (x + 1)


def imbalance(a: Column, b: Column) -> Column:
    """2 |1/2 - a / (a + b)|; null without reads."""
    return 2 * F.abs(0.5 - F.when(a + b > 0, ratio(a, a + b)))


def with_suffix(barcode: Column, suffix: str | None) -> Column:
    if not suffix:
        return barcode
    return F.when(barcode.endswith(suffix), barcode).otherwise(F.concat(barcode, F.lit(suffix)))


def clean_chr(x: Column) -> Column:
    return F.regexp_replace(x, "^chr", "")


def as_bool(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "t", "yes"), F.lit(False))


def joined_distinct(x: Column, sep: str = ",") -> Column:
    """Aggregate: distinct values in sorted order, joined."""
    return F.array_join(F.array_sort(F.collect_set(x.cast("string"))), sep)


def escape_display(x: Column) -> Column:
    known = F.create_map(*[F.lit(v) for status, kind in STATUS_CLASSES.items() for v in (kind, status)])
    return F.coalesce(F.try_element_at(known, x), x)


def parse_region(region: str) -> tuple[str, int, int | None]:
    """``chr``, ``chr:start`` or ``chr:start-end``; commas in numbers are left out."""
    m = re.fullmatch(r"([^:]+)(?::([\d,]+)(?:-([\d,]+))?)?", region.strip())
    if not m:
        raise ValueError(f"not a region: {region}")
    number = lambda s, d: int(s.replace(",", "")) if s else d
    return m[1], number(m[2], 1), number(m[3], None)


def windows(length: int, width: int, start: int = 1, end: int | None = None) -> list[tuple[int, int]]:
    """Tiles of a contig, 1-based and inclusive."""
    last = min(length, end or length)
    return [(s, min(s + width - 1, last)) for s in range(start, last + 1, width)]


def lc_tag(min_reads: int, lower: float) -> str:
    return f"min{min_reads}_lc{lower:.2f}"


def normalise_species(name: str) -> str:
    low = name.strip().lower()
    for species, names in SPECIES.items():
        if low in names:
            return species
    raise ValueError(f"no annotation for species {name!r}; known: {', '.join(sorted(SPECIES))}")


def escape_params(mode: str = "recovery", cutoff: float | None = None, min_donors: int | None = None) -> tuple[str, float, int]:
    if mode not in ESCAPE_MODES:
        raise ValueError(f"escape mode {mode!r} is none of {', '.join(ESCAPE_MODES)}")
    c, d = ESCAPE_MODES[mode]
    return mode, c if cutoff is None else float(cutoff), d if min_donors is None else int(min_donors)
