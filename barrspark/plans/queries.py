"""Queries over the standard tables, one or more for each group of operators, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barrspark.operators import activity, alleles, concordance, counting, downstream, filters, intervals, layers, matrices, tagging, validation
from barrspark.plans import proxies as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SLOP, NEAREST = 1000, 2000
MIN_READS, LOWER = 10, 0.01


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to six places, as sums of them depend on their order."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- counting -----------------------------------------------------------------------------------------------------

EV = """ev AS (
  SELECT l_orderkey || '-' || l_linenumber AS read_id, 'C' || l_suppkey AS cell_barcode, 'chrX' AS contig, l_partkey AS position, p_brand AS gene,
         'A' AS refAllele, 'G' AS altAllele, CASE l_returnflag WHEN 'A' THEN 'ref' WHEN 'N' THEN 'alt' ELSE 'other' END AS allele_class
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
COUNTS = f"""{EV}, counts AS (
  SELECT cell_barcode, contig, position, gene, refAllele, altAllele, count(*) FILTER (allele_class = 'ref') AS refCount, count(*) FILTER (allele_class = 'alt') AS altCount,
         count(*) AS totalCount, count(*) FILTER (allele_class = 'other') AS otherCount FROM ev GROUP BY ALL)"""
SUMS = f"{COUNTS}, sums AS (SELECT position AS pos, cell_barcode AS cell, CAST(sum(refCount) AS BIGINT) AS r, CAST(sum(altCount) AS BIGINT) AS a FROM counts GROUP BY ALL)"


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS read_id, 'C' || o_custkey AS cell_barcode, 'chrX' AS contig, l_partkey AS position, CASE WHEN o_custkey % 3 = 0 THEN '.' ELSE o_orderpriority END AS gene,
  'A' AS refAllele, 'G' AS altAllele, CASE WHEN l_linenumber IN (4, 5) THEN 'other' WHEN l_returnflag = 'A' THEN 'ref' WHEN l_returnflag = 'N' THEN 'alt' ELSE 'other' END AS allele_class
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE o_orderstatus <> 'P' AND o_custkey % 7 <> 0 AND p_size > 10 AND l_linenumber <> 6 AND (l_linenumber = 4 OR CAST(l_quantity AS INT) >= 10)""")
def read_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reads that cover a site with each line: lines 4 are deleted, 5 next to an indel, 6 skip the reference."""
    line = F.struct("l_linenumber", "l_partkey", "l_returnflag", F.col("l_quantity").cast("int").alias("q"))
    lines = P.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    base = lambda x: F.when(x["l_returnflag"] == "A", "a").when(x["l_returnflag"] == "N", "G").otherwise("T")
    kind = lambda x: F.when(x["l_linenumber"] == 4, "del").when(x["l_linenumber"] == 5, "indel_anchor").when(x["l_linenumber"] == 6, "refskip").otherwise("base")
    aligned = lambda x, i: F.struct(F.when(x["l_linenumber"] != 4, i).alias("qpos"), (x["l_partkey"] - 1).alias("rpos"), kind(x).alias("kind"))
    reads = P.table(spark, sf_dir, "orders").join(lines, "o_orderkey").select(
        F.col("o_orderkey").cast("string").alias("read_id"), F.lit("chrX").alias("contig"), F.when(F.col("o_custkey") % 7 == 0, 0x100).otherwise(0).alias("flags"),
        F.when(F.col("o_orderstatus") == "P", 10).otherwise(60).alias("mapq"), F.array_join(F.transform("lines", base), "").alias("seq"), F.transform("lines", lambda x: x["q"]).alias("quals"),
        F.transform("lines", aligned).alias("aligned"), F.concat(F.lit("C"), "o_custkey").alias("cb"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority")).alias("gn"),
    )
    sites = P.table(spark, sf_dir, "part").where("p_size > 10").select(F.lit("chrX").alias("contig"), F.col("p_partkey").alias("position"), F.lit("A").alias("refAllele"), F.lit("G").alias("altAllele"))
    return counting.read_evidence(reads, sites)


@query(f"WITH {COUNTS} SELECT * FROM counts")
def allele_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.allele_counts(P.evidence(spark, sf_dir))


_BASES = """
SELECT l_orderkey || '-' || l_linenumber AS read_id, 'C' || l_suppkey AS cell_barcode, 'chrX' AS contig, l_partkey AS position, '.' AS gene, 'A' AS refAllele, 'G' AS altAllele,
       CASE WHEN l_linenumber = 5 THEN 'other' WHEN l_returnflag = 'A' THEN 'ref' WHEN l_returnflag = 'N' THEN 'alt' ELSE 'other' END AS allele_class
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE CAST(round(l_discount * 600) AS INT) >= 20 AND CAST(l_quantity AS INT) >= 10 AND l_linenumber <> 6"""


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as one-base alignments; lines 5 are next to an indel, lines 6 skip the reference."""
    kind = F.when(F.col("l_linenumber") == 5, "indel_anchor").when(F.col("l_linenumber") == 6, "refskip").otherwise("base")
    aligned = F.array(F.struct(F.lit(0).alias("qpos"), (F.col("l_partkey") - 1).alias("rpos"), kind.alias("kind")))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return P.table(spark, sf_dir, "lineitem").select(
        key.alias("read_id"), F.lit("chrX").alias("contig"), F.col("l_partkey").alias("pos"), F.lit(0).alias("flags"), F.round(F.col("l_discount") * 600).cast("int").alias("mapq"),
        F.when(F.col("l_returnflag") == "A", "a").when(F.col("l_returnflag") == "N", "G").otherwise("T").alias("seq"), F.array(F.col("l_quantity").cast("int")).alias("quals"),
        aligned.alias("aligned"), F.concat(F.lit("C"), "l_suppkey").alias("cb"), F.lit(None).cast("string").alias("gn"), F.lit(None).cast("string").alias("tr"), key.alias("ordinal"),
    )


@query(_BASES)
def pileup_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = P.table(spark, sf_dir, "part").select(F.lit("chrX").alias("contig"), F.col("p_partkey").alias("pos"), F.lit("A").alias("ref"), F.array(F.lit("G")).alias("alts"), F.array(F.lit(0), F.lit(1)).alias("gt"))
    return counting.read_evidence(_reads(spark, sf_dir), counting.snp_sites(variants, het_only=True))


@query(f"{_BASES} QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY read_id, cell_barcode, gene, allele_class) <= 12")
def pileup_depth_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads first by identifier, up to 12 at a site, as the depth limit is part of counting."""
    sites = P.table(spark, sf_dir, "part").select(F.lit("chrX").alias("contig"), F.col("p_partkey").alias("position"), F.lit("A").alias("refAllele"), F.lit("G").alias("altAllele"))
    return counting.read_evidence(_reads(spark, sf_dir), sites, max_depth=12)


# ---- genes of positions, conflicts, filters ---------------------------------------------------------------------------

_POS = """pos AS (
  SELECT 'C' || l_suppkey AS cell_barcode, CASE WHEN l_linestatus = 'F' THEN 'X' ELSE 'chrX' END AS contig, l_partkey * 7000 + (l_suppkey * 131) % 7000 AS position,
         CASE l_linenumber WHEN 3 THEN '.' WHEN 4 THEN 'Brand#11' ELSE p_brand END AS gene, 'A' AS refAllele, 'G' AS altAllele, l_orderkey || '-' || l_linenumber AS read_id,
         CASE l_returnflag WHEN 'A' THEN 'ref' WHEN 'N' THEN 'alt' ELSE 'other' END AS allele_class
  FROM lineitem JOIN part ON l_partkey = p_partkey),
genes AS (
  SELECT p_partkey * 7000 - CASE WHEN p_size > 40 THEN 6500 ELSE 0 END AS s, p_partkey * 7000 + p_size * 20 AS e, p_brand AS gene_name, CAST(p_partkey AS VARCHAR) AS gene_id FROM part)"""
ANN = f"""{_POS},
d AS (
  SELECT contig, position, s, e, gene_name, gene_id, greatest(s - position, position - e, 0) AS d FROM (SELECT DISTINCT contig, position FROM pos) p
  JOIN genes ON p.position >= s - {NEAREST} AND p.position <= e + {NEAREST}),
m AS (SELECT *, min(d) OVER (PARTITION BY contig, position) AS least FROM d),
k AS (
  SELECT contig, position, least, gene_name, gene_id, min({{'d': d, 's': s, 'e': e}}) AS o FROM m
  WHERE CASE WHEN least = 0 THEN d = 0 WHEN least <= {SLOP} THEN d <= {SLOP} ELSE d = least END GROUP BY ALL),
hit AS (
  SELECT contig, position, string_agg(gene_name, ';' ORDER BY o, gene_name, gene_id) AS gtf_gene, string_agg(gene_id, ';' ORDER BY o, gene_name, gene_id) AS gtf_gene_ids,
         count(*) AS gtf_gene_n, CASE WHEN least = 0 THEN 'exact_overlap' WHEN least <= {SLOP} THEN 'within_slop' ELSE 'nearest_within_max' END AS gtf_match_type, CAST(least AS BIGINT) AS gtf_min_distance
  FROM k GROUP BY contig, position, least),
ann AS (
  SELECT p.contig, p.position, coalesce(gtf_gene, '') AS gtf_gene, coalesce(gtf_gene_ids, '') AS gtf_gene_ids, coalesce(gtf_gene_n, 0) AS gtf_gene_n, coalesce(gtf_gene_n, 0) > 1 AS gtf_multi_gene,
         coalesce(gtf_match_type, 'none') AS gtf_match_type, gtf_min_distance
  FROM (SELECT DISTINCT contig, position FROM pos) p LEFT JOIN hit USING (contig, position))"""


@query(f"WITH {ANN} SELECT * FROM ann")
def interval_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.annotate_positions(P.interval_positions(spark, sf_dir), P.interval_genes(spark, sf_dir), SLOP, NEAREST)


@query(f"WITH {ANN} SELECT gtf_match_type, count(*) AS positions, CAST(sum(gtf_gene_n) AS BIGINT) AS genes, CAST(max(gtf_min_distance) AS BIGINT) AS farthest FROM ann GROUP BY ALL")
def interval_match_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = intervals.annotate_positions(P.interval_positions(spark, sf_dir), P.interval_genes(spark, sf_dir), SLOP, NEAREST)
    return a.groupBy("gtf_match_type").agg(F.count("*").alias("positions"), F.sum("gtf_gene_n").alias("genes"), F.max("gtf_min_distance").alias("farthest"))


CNT = f"""{ANN},
icounts AS (
  SELECT cell_barcode, contig, position, gene, refAllele, altAllele, count(*) FILTER (allele_class = 'ref') AS refCount, count(*) FILTER (allele_class = 'alt') AS altCount,
         count(*) AS totalCount, count(*) FILTER (allele_class = 'other') AS otherCount FROM pos GROUP BY ALL),
anc AS (
  SELECT *, reason NOT IN ('tsv_gene_blank', 'both_unannotated', 'tsv_gene_matches_gtf') AS gtf_gene_conflict, reason = 'tsv_gene_matches_gtf' AS tsv_gene_in_gtf_list FROM (
    SELECT icounts.*, ann.* EXCLUDE (contig, position), CASE WHEN gene = '.' THEN CASE WHEN gtf_gene_n > 0 THEN 'tsv_gene_blank' ELSE 'both_unannotated' END
      WHEN gtf_gene_n = 0 THEN 'no_gtf_gene_near_position' WHEN list_contains(string_split(gtf_gene, ';'), gene) THEN 'tsv_gene_matches_gtf'
      WHEN gtf_match_type IN ('exact_overlap', 'within_slop') THEN 'tsv_gene_not_in_overlapping_or_slop_gtf_genes' ELSE 'tsv_gene_differs_from_nearest_gtf_gene' END AS reason
    FROM icounts JOIN ann USING (contig, position)))"""
FLT = f"""{CNT},
f1 AS (SELECT * FROM anc WHERE NOT gtf_gene_conflict),
multi AS (SELECT contig, position, refAllele, altAllele FROM f1 GROUP BY ALL HAVING count(DISTINCT CASE WHEN gene <> '.' THEN gene END) >= 2 AND max(gtf_gene_n) >= 2),
kept AS (SELECT * FROM f1 ANTI JOIN multi USING (contig, position, refAllele, altAllele)),
dropped AS (
  SELECT *, 'gtf_gene_conflict' AS drop_reason FROM anc WHERE gtf_gene_conflict
  UNION ALL SELECT *, 'multi_tsv_gene_and_multi_gtf_gene' FROM f1 SEMI JOIN multi USING (contig, position, refAllele, altAllele))"""


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.annotate_counts(counting.allele_counts(P.interval_positions(spark, sf_dir)), P.interval_genes(spark, sf_dir), SLOP, NEAREST)


@query(f"WITH {CNT} SELECT * EXCLUDE (reason), reason AS gtf_conflict_reason FROM anc")
def conflict_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotated(spark, sf_dir)


@query(f"WITH {FLT} SELECT * EXCLUDE (reason), reason AS gtf_conflict_reason FROM kept")
def filter_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_counts(_annotated(spark, sf_dir))[0]


@query(f"WITH {FLT} SELECT drop_reason, count(*) AS n_rows, count(DISTINCT position) AS n_positions, CAST(sum(totalCount) AS BIGINT) AS n_reads FROM dropped GROUP BY ALL")
def filter_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = filters.filter_counts(_annotated(spark, sf_dir))[1]
    return d.groupBy("drop_reason").agg(F.count("*").alias("n_rows"), F.count_distinct("position").alias("n_positions"), F.sum("totalCount").alias("n_reads"))


@query(f"""WITH {FLT}, s AS (
  SELECT 'rows_before' AS metric, count(*) AS v FROM anc UNION ALL SELECT 'positions_before', count(DISTINCT (contig, position)) FROM anc
  UNION ALL SELECT 'rows_gtf_gene_conflict', count(*) FROM anc WHERE gtf_gene_conflict UNION ALL SELECT 'rows_gtf_multi_gene', count(*) FROM anc WHERE gtf_multi_gene
  UNION ALL SELECT 'rows_after', count(*) FROM kept UNION ALL SELECT 'positions_after', count(DISTINCT (contig, position)) FROM kept
  UNION ALL SELECT 'rows_removed', count(*) FROM dropped UNION ALL SELECT 'positions_removed', count(DISTINCT (contig, position)) FROM dropped
  UNION ALL SELECT 'reason__' || reason, count(*) FROM anc GROUP BY ALL UNION ALL SELECT 'removed__' || drop_reason, count(*) FROM dropped GROUP BY ALL)
SELECT metric, CAST(v AS VARCHAR) AS value FROM s""")
def filter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _annotated(spark, sf_dir).persist()  # the summary reads it once for each of its parts
    return filters.filter_summary(a, *filters.filter_counts(a))


@query(f"""WITH {FLT}, keys AS (SELECT DISTINCT cell_barcode, contig, position, gene, refAllele, altAllele, drop_reason FROM dropped),
de AS (SELECT pos.*, keys.drop_reason FROM pos JOIN keys USING (cell_barcode, contig, position, gene, refAllele, altAllele))
SELECT read_id, count(*) AS n_dropped_snp_rows, count(DISTINCT position) AS n_dropped_snps, string_agg(DISTINCT cell_barcode, ';' ORDER BY cell_barcode) AS cells,
       string_agg(DISTINCT gene, ';' ORDER BY gene) AS genes, string_agg(DISTINCT drop_reason, ';' ORDER BY drop_reason) AS drop_reasons,
       string_agg(DISTINCT allele_class, ';' ORDER BY allele_class) AS allele_classes FROM de GROUP BY read_id""")
def dropped_read_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = filters.filter_counts(_annotated(spark, sf_dir))[1]
    return filters.dropped_read_summary(filters.dropped_evidence(P.interval_positions(spark, sf_dir), dropped))


# ---- alleles and the graph ------------------------------------------------------------------------------------------------


@query(f"""WITH {SUMS}, t AS (SELECT pos AS POS, CAST(sum(r) AS BIGINT) AS ref_total, CAST(sum(a) AS BIGINT) AS alt_total FROM sums GROUP BY ALL)
SELECT POS, ref_total, alt_total, ref_total + alt_total AS total, round(ref_total / (ref_total + alt_total), 6) AS ref_fraction FROM t
WHERE ref_total + alt_total >= {MIN_READS} AND ref_total / (ref_total + alt_total) BETWEEN {LOWER} AND {1 - LOWER}""")
def snp_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(alleles.filter_snps(P.standard(spark, sf_dir), MIN_READS, LOWER))


@query("""WITH s AS (SELECT l_suppkey AS POS, p_brand AS Gene, count(*) FILTER (l_returnflag IN ('A', 'N')) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT POS, first(Gene ORDER BY n DESC, Gene) AS Gene FROM s GROUP BY POS""")
def best_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as positions, so that one position has reads of many genes."""
    rows = P.table(spark, sf_dir, "lineitem").join(P.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    one = lambda flag: F.when(F.col("l_returnflag") == flag, 1).otherwise(0)
    return alleles.best_gene(rows.select(F.col("l_suppkey").alias("POS"), F.col("p_brand").alias("Gene"), one("A").alias("REFcount"), one("N").alias("ALTcount")))


_DUP = """WITH rows AS (
  SELECT 'C' || l_suppkey AS cell_barcode, l_partkey AS POS, CASE WHEN l_tax > 0.06 THEN 'chrX' ELSE 'X' END AS CONTIG, CASE WHEN l_linenumber = 2 THEN 'g2' ELSE 'g1' END AS Gene,
         CASE WHEN l_returnflag = 'R' THEN 'C' ELSE 'A' END AS REF, 'G' AS ALT, CAST(l_linenumber AS BIGINT) AS REFcount, CAST(1 AS BIGINT) AS ALTcount FROM lineitem)
SELECT cell_barcode, POS, count(*) AS n_rows, count(DISTINCT CONTIG) AS contigs_n, count(DISTINCT Gene) AS genes_n, count(DISTINCT REF || '>' || ALT) AS allele_pairs_n,
       CASE WHEN count(DISTINCT REF || '>' || ALT) > 1 THEN 'multi-allelic' WHEN count(DISTINCT Gene) > 1 THEN 'different-gene' WHEN count(DISTINCT CONTIG) > 1 THEN 'different-contig'
            WHEN count(DISTINCT (CONTIG, Gene, REF, ALT, REFcount, ALTcount)) = 1 THEN 'exact-duplicate-row' ELSE 'same-allele_repeated' END AS cause
FROM rows GROUP BY cell_barcode, POS HAVING count(*) > 1"""


def _repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("C"), "l_suppkey").alias("cell_barcode"), F.col("l_partkey").alias("POS"), F.when(F.col("l_tax") > 0.06, "chrX").otherwise("X").alias("CONTIG"),
        F.when(F.col("l_linenumber") == 2, "g2").otherwise("g1").alias("Gene"), F.when(F.col("l_returnflag") == "R", "C").otherwise("A").alias("REF"), F.lit("G").alias("ALT"),
        F.col("l_linenumber").cast("long").alias("REFcount"), F.lit(1).cast("long").alias("ALTcount"),
    )


@query(_DUP)
def duplicate_forensics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alleles.duplicate_groups(_repeats(spark, sf_dir))


@query(f"WITH g AS ({_DUP}) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY cause ORDER BY cell_barcode, POS) <= 10")
def duplicate_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alleles.duplicate_examples(alleles.duplicate_groups(_repeats(spark, sf_dir)))


_ALLELES = f"{SUMS}, al AS (SELECT pos, 'ref' AS allele, cell, r AS n FROM sums WHERE r > 0 UNION ALL SELECT pos, 'alt', cell, a FROM sums WHERE a > 0), v AS (SELECT pos, allele, count(*) AS cells, sum(n) AS total, sum(n * n) AS square FROM al GROUP BY ALL)"


def _edges_sql(shared: str, by: str) -> str:
    return f"""{_ALLELES}, pr AS (
  SELECT x.pos AS src_pos, x.allele AS src_allele, y.pos AS dst_pos, y.allele AS dst_allele, {shared} AS sh FROM al x JOIN al y ON x.cell = y.cell AND x.pos < y.pos GROUP BY ALL),
edges AS (
  SELECT src_pos, src_allele, dst_pos, dst_allele, CAST(sh AS DOUBLE) / {by} AS weight FROM pr JOIN v s ON s.pos = src_pos AND s.allele = src_allele JOIN v d ON d.pos = dst_pos AND d.allele = dst_allele)"""


_EDGE_SQL = {
    "binary": _edges_sql("count(*)", "least(s.cells, d.cells)"),
    "cosine": _edges_sql("sum(x.n * y.n)", "(sqrt(s.square) * sqrt(d.square))"),
    "overlap": _edges_sql("sum(least(x.n, y.n))", "least(s.total, d.total)"),
}
_GRAPH = """, ways AS (SELECT src_pos AS pos, src_allele AS allele, weight FROM edges UNION ALL SELECT dst_pos, dst_allele, weight FROM edges)
SELECT pos, allele, count(*) AS degree, round(sum(weight), 6) AS strength, round(avg(weight), 6) AS mean_weight FROM ways GROUP BY ALL"""


def _graph(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(concordance.degrees(alleles.allele_cells(P.standard(spark, sf_dir, alleles_only=True)), mode))

    run.__name__ = f"concordance_{mode}_degrees"
    return run


for _mode, _sql in _EDGE_SQL.items():
    query(f"WITH {_sql}{_GRAPH}")(_graph(_mode))


@query("""WITH RECURSIVE n AS (SELECT DISTINCT s_nationkey AS pos FROM supplier), e AS (
  SELECT DISTINCT n_nationkey AS a, n_nationkey + 5 AS b FROM nation WHERE n_nationkey + 5 < 25 AND n_regionkey <> 2),
w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), names AS (SELECT DISTINCT n_nationkey AS pos FROM nation),
r AS (SELECT pos AS v, pos AS c FROM names UNION SELECT w.b, r.c FROM r JOIN w ON w.a = r.v)
SELECT CAST(v AS BIGINT) AS pos, 'ref' AS allele, CAST((SELECT min(CAST(c AS VARCHAR) || '_ref') FROM r q WHERE q.v = r.v) AS VARCHAR) AS component FROM r GROUP BY v""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations five apart are linked, outside one region."""
    from barrspark.operators.components import components

    nation = P.table(spark, sf_dir, "nation")
    names = nation.select(F.col("n_nationkey").cast("long").alias("pos"), F.lit("ref").alias("allele"))
    edges = nation.where("n_nationkey + 5 < 25 and n_regionkey <> 2").select(
        F.col("n_nationkey").cast("long").alias("src_pos"), F.lit("ref").alias("src_allele"), (F.col("n_nationkey") + 5).cast("long").alias("dst_pos"), F.lit("ref").alias("dst_allele"), F.lit(1.0).alias("weight")
    )
    return components(names, edges)


_STARS = """al AS (SELECT p_partkey AS pos, p_size, unnest(['ref', 'alt']) AS allele FROM part),
k AS (SELECT pos, allele, pos || '_' || allele AS name, CASE WHEN allele = 'alt' AND pos % 3 = 0 THEN pos || '_' || allele WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_size || allele END AS grp FROM al),
comp AS (SELECT pos, allele, min(name) OVER (PARTITION BY grp) AS component FROM k)"""


def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of parts as SNPs: alleles hang on the first part of their size, even sizes are whole, every third alternative is alone."""
    from barrspark.operators.components import components

    allele = F.explode(F.array(F.lit("ref"), F.lit("alt"))).alias("allele")
    names = P.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("pos"), "p_size", allele)
    tied = names.where("allele = 'ref' or pos % 3 <> 0")
    hubs = tied.groupBy("p_size", "allele").agg(F.min("pos").alias("hub"))
    edge = lambda a, b, c, d: [F.col(a).alias("src_pos"), F.col(b).alias("src_allele"), F.col(c).alias("dst_pos"), F.col(d).alias("dst_allele"), F.lit(1.0).alias("weight")]
    spokes = tied.join(hubs, ["p_size", "allele"]).where("pos <> hub").select(edge("hub", "allele", "pos", "allele"))
    both = hubs.where("p_size % 2 = 0").groupBy("p_size").agg(F.min_by("hub", F.col("allele") == "alt").alias("r"), F.max_by("hub", F.col("allele") == "alt").alias("a"), F.count("*").alias("n"))
    joints = both.where("n = 2").withColumn("ref", F.lit("ref")).withColumn("alt", F.lit("alt")).select(edge("r", "ref", "a", "alt"))
    return components(names.select("pos", "allele"), spokes.unionByName(joints))


@query(f"WITH {_STARS} SELECT * FROM comp")
def allele_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stars(spark, sf_dir)


@query(f"""WITH {_STARS}, big AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1),
s AS (SELECT pos AS POS, max(component) FILTER (allele = 'ref') AS comp_ref, max(component) FILTER (allele = 'alt') AS comp_alt FROM comp GROUP BY pos)
SELECT *, CASE WHEN comp_ref <> comp_alt THEN 'split' WHEN comp_ref = (SELECT component FROM big) THEN 'lcc' ELSE 'non_lcc' END AS status FROM s""")
def graph_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barrspark.operators.components import connectivity

    return connectivity(_stars(spark, sf_dir))


@query("""WITH v AS (SELECT DISTINCT l_partkey AS pos, unnest(['ref', 'alt']) AS allele FROM lineitem WHERE l_partkey % 50 <> 7)
SELECT pos, allele, CAST((pos % 2 <> (SELECT min(l_partkey) % 2 FROM lineitem)) <> (allele = 'alt') AS INT) AS side FROM v""")
def partition_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two planted sides: even and odd orders as cells see opposite alleles but for a few lines; SNPs of which one side sees both alleles go."""
    from barrspark.operators.partition import remove_unparted

    lines = P.table(spark, sf_dir, "lineitem").where("l_partkey % 50 <> 7 or l_orderkey % 2 = 1")
    flipped = (F.col("l_linenumber") == 1) & (F.col("l_quantity") >= 49)
    planted = ((F.col("l_partkey") + F.col("l_orderkey")) % 2 == 0) != flipped
    is_ref = F.when(F.col("l_partkey") % 50 == 7, F.col("l_linenumber") % 2 == 0).otherwise(planted)
    seen = lines.select(F.col("l_orderkey").cast("string").alias("cell_barcode"), F.col("l_partkey").cast("long").alias("pos"), F.when(is_ref, "ref").otherwise("alt").alias("allele"))
    return remove_unparted(seen.groupBy("cell_barcode", "pos", "allele").agg(F.count("*").alias("n")))[0]


# ---- activity of haplotypes -------------------------------------------------------------------------------------------------

ACTIVE = f"""{SUMS},
h AS (SELECT pos, cell, CASE WHEN pos % 2 = 0 THEN r ELSE a END AS h1, CASE WHEN pos % 2 = 0 THEN a ELSE r END AS h2 FROM sums),
g AS (SELECT cell, p_brand, max(h1) AS h1, max(h2) AS h2 FROM h JOIN part ON pos = p_partkey GROUP BY ALL),
act AS (SELECT cell, CAST(sum(h1) AS BIGINT) AS s1, CAST(sum(h2) AS BIGINT) AS s2, CASE WHEN sum(h1) > sum(h2) THEN 'X1' WHEN sum(h1) < sum(h2) THEN 'X2' ELSE 'X1/X2' END AS x FROM g GROUP BY cell)"""


def _haplotypes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    std = P.standard(spark, sf_dir)
    sums = alleles.cell_sums(std)
    counts = activity.haplotype_counts(sums, P.phased(spark, sf_dir))
    return sums, counts, activity.active_x(counts, alleles.best_gene(std), sums)


@query(f"WITH {ACTIVE} SELECT cell AS cell_barcode, s1 AS Haplotype_1_Sum, s2 AS Haplotype_2_Sum, x AS active_X FROM act")
def active_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _haplotypes(spark, sf_dir)[2]


@query(f"""WITH {ACTIVE}, w AS (SELECT pos AS POS, CAST(sum(CASE x WHEN 'X1' THEN h1 ELSE h2 END) AS BIGINT) AS Xa_reads, CAST(sum(CASE x WHEN 'X1' THEN h2 ELSE h1 END) AS BIGINT) AS Xi_reads
  FROM h JOIN act USING (cell) WHERE x <> 'X1/X2' GROUP BY pos)
SELECT *, round((Xa_reads - Xi_reads) / nullif(Xa_reads + Xi_reads, 0), 6) AS xa_xi_margin FROM w""")
def xa_xi_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    std = P.standard(spark, sf_dir)
    return rounded(activity.xa_xi_by_votes(activity.haplotype_counts(alleles.cell_sums(std), P.phased(spark, sf_dir)), alleles.best_gene(std)))


@query(f"""WITH {ACTIVE}, w AS (SELECT pos AS POS, count(*) FILTER (h1 > h2) AS k, count(*) FILTER (h1 <> h2) AS n FROM h GROUP BY pos), p AS (SELECT *, k / nullif(n, 0) AS p FROM w)
SELECT POS, round(p, 6) AS H1_wins_frac, n AS n_informative_cells_phase,
  round((p + 3.8416 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) + 0.0 AS H1_wins_frac_ci_lo,
  round((p + 3.8416 / (2 * n) + 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS H1_wins_frac_ci_hi FROM p""")
def haplotype_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(activity.consistency(_haplotypes(spark, sf_dir)[1]))
    return out.withColumn("H1_wins_frac_ci_lo", F.col("H1_wins_frac_ci_lo") + 0.0)


@query(f"""WITH {SUMS}, n AS (SELECT count(*) AS n FROM supplier), f AS (SELECT *, r / nullif(r + a, 0) AS f FROM sums)
SELECT pos AS POS, CAST(sum(r) AS BIGINT) AS total_ref_sum, CAST(sum(a) AS BIGINT) AS total_alt_sum, CAST(sum(r + a) AS BIGINT) AS total_coverage, count(f) AS n_cells_nonzero,
  round(quantile_cont(f, 0.5), 6) AS cell_ref_fraction_median, round(quantile_cont(f, 0.75) - quantile_cont(f, 0.25), 6) AS cell_ref_fraction_iqr,
  round(stddev_pop(f), 6) AS cell_ref_fraction_std, round(count(f) / any_value(n), 6) AS frac_cells_nonzero FROM f, n GROUP BY pos""")
def coverage_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.table(spark, sf_dir, "supplier").count()
    return rounded(activity.coverage_features(alleles.cell_sums(P.standard(spark, sf_dir)), n))


def _stage2_sql(mode: str, weight: str) -> str:
    return f"""WITH {ACTIVE}, t AS (
  SELECT pos, coalesce(x IN ('X1', 'X2') AND r <> a, false) AS told, (x = 'X1' AND a > r) OR (x = 'X2' AND r > a) AS alt, {weight} AS w FROM sums LEFT JOIN act USING (cell)),
s AS (SELECT pos AS POS, CAST(coalesce(sum(w) FILTER (told AND alt), 0) AS DOUBLE) AS p, CAST(coalesce(sum(w) FILTER (told AND NOT alt), 0) AS DOUBLE) AS q, count(*) FILTER (told) AS n FROM t GROUP BY pos)
SELECT POS, CASE WHEN p + q <= 0 THEN 'unresolved' WHEN p > q THEN 'alt_h1' WHEN q > p THEN 'ref_h1' ELSE 'tie' END AS best_orientation, p AS score_alt_h1, q AS score_ref_h1, p + q AS evidence,
  round(coalesce(abs(p - q) / nullif(p + q, 0), 0), 6) AS margin, n AS n_informative_cells_stage2, '{mode}' AS stage2_mode FROM s"""


def _stage2(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sums, _, calls = _haplotypes(spark, sf_dir)
        return rounded(activity.orientation_scores(sums, calls, mode))

    run.__name__ = f"stage2_scores_{mode}"
    return run


query(_stage2_sql("cell", "1"))(_stage2("cell"))
query(_stage2_sql("expression", "abs(r - a)"))(_stage2("expression"))


@query(f"""WITH s AS ({_stage2_sql('cell', '1')})
SELECT POS, CASE WHEN evidence < 2 THEN NULL WHEN best_orientation = 'alt_h1' THEN 'alt' WHEN best_orientation = 'ref_h1' THEN 'ref' END AS h1_allele,
  CASE WHEN evidence < 2 THEN 'unresolved_low_evidence_cell' WHEN best_orientation IN ('alt_h1', 'ref_h1') THEN 'calculated_cell_' || best_orientation WHEN best_orientation = 'tie' THEN 'unresolved_tie_cell' ELSE 'unresolved_cell' END AS method FROM s""")
def stage2_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums, _, calls = _haplotypes(spark, sf_dir)
    return activity.assign_stage2(activity.orientation_scores(sums, calls), min_evidence=2.0, tie_action="skip")


@query(f"""WITH {_EDGE_SQL['binary']}, sd AS (SELECT pos, allele, CASE WHEN (pos % 2 = 0) = (allele = 'ref') THEN 0 ELSE 1 END AS side FROM v),
w AS (SELECT src_pos AS pos, src_allele AS allele, dst_pos AS q, dst_allele AS qa, weight FROM edges UNION ALL SELECT dst_pos, dst_allele, src_pos, src_allele, weight FROM edges),
x AS (SELECT w.pos, w.weight, s.side = d.side AS same FROM w JOIN sd s ON s.pos = w.pos AND s.allele = w.allele JOIN sd d ON d.pos = w.q AND d.allele = w.qa),
m AS (SELECT pos AS POS, coalesce(sum(weight) FILTER (same), 0) AS ww, coalesce(sum(weight) FILTER (NOT same), 0) AS cw, count(*) FILTER (same) AS wn, count(*) FILTER (NOT same) AS cn FROM x GROUP BY pos)
SELECT POS, round(ww, 6) AS within_weight, round(cw, 6) AS cross_weight, wn AS within_degree, cn AS cross_degree, round((ww - cw) / nullif(ww + cw, 0), 6) AS partition_separation_w,
  round((wn - cn) / nullif(wn + cn, 0), 6) AS partition_separation_n FROM m""")
def partition_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.explode(F.array(F.lit("ref"), F.lit("alt"))).alias("allele")
    named = P.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("pos"), both)
    sides = named.withColumn("side", F.when((F.col("pos") % 2 == 0) == (F.col("allele") == "ref"), 0).otherwise(1))
    out = validation.partition_metrics(alleles.allele_cells(P.standard(spark, sf_dir)), sides).where("within_degree + cross_degree > 0")
    return rounded(out.select("POS", "within_weight", "cross_weight", "within_degree", "cross_degree", "partition_separation_w", "partition_separation_n"))


@query(f"""WITH {SUMS}, t AS (SELECT pos, CAST(sum(r + a) AS BIGINT) AS n FROM sums GROUP BY pos)
SELECT 'chrX' AS CONTIG, p_partkey AS POS, 'A' AS REF, 'G' AS ALT, p_brand AS Gene, CASE WHEN (p_partkey % 2 = 0) THEN 'A' ELSE 'G' END AS H1, CASE WHEN (p_partkey % 2 = 0) THEN 'G' ELSE 'A' END AS H2,
  'stage1' AS Stage, '.' AS Stage2_method, n AS Total_coverage FROM part JOIN t ON pos = p_partkey""")
def haplotype_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    std = P.standard(spark, sf_dir)
    phased = P.phased(spark, sf_dir).withColumn("stage", F.lit("stage1")).withColumn("method", F.lit("."))
    return validation.haplotype_table(std, phased, alleles.best_gene(std), alleles.snp_totals(std))


@query(f"""WITH t AS ({ORACLE_SQL['haplotype_table']})
SELECT CONTIG, POS, concat_ws(chr(9), CONTIG, POS, '.', REF, ALT, '.', 'PASS', 'GENE=' || Gene || ';STAGE=' || Stage || ';STAGE2_METHOD=' || Stage2_method || ';TOTAL_COVERAGE=' || Total_coverage,
  'GT:PS', CASE WHEN H1 = REF THEN '0|1:0' ELSE '1|0:0' END) AS line FROM t""")
def phased_vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.vcf_lines(haplotype_table(spark, sf_dir))


_KNOWN = ["(partition_separation_w + 1) / 2", "2 * abs(H1_wins_frac - 0.5)", "abs(xa_xi_margin)"]


@query(f"""WITH g AS ({ORACLE_SQL['partition_metrics']}), c AS ({ORACLE_SQL['haplotype_consistency']}), f AS ({ORACLE_SQL['coverage_features']}), x AS ({ORACLE_SQL['xa_xi_reads']})
SELECT *, round(list_avg(list_filter([{', '.join(_KNOWN)}], lambda v: v IS NOT NULL)), 9) AS confidence_basic
FROM g FULL JOIN c USING (POS) FULL JOIN f USING (POS) FULL JOIN x USING (POS)""")
def validation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [f(spark, sf_dir) for f in (partition_metrics, haplotype_consistency, coverage_features, xa_xi_reads)]
    return validation.validation_matrix(*parts).withColumn("confidence_basic", F.round("confidence_basic", 9))


# ---- tags, routes, matrices -----------------------------------------------------------------------------------------------------

_TAGS = """calls AS (SELECT 'C' || s_suppkey AS cb, CASE s_suppkey % 4 WHEN 0 THEN 'X1' WHEN 1 THEN 'X2' ELSE 'X1/X2' END AS active FROM supplier WHERE s_acctbal > 0),
sc AS (
  SELECT l_orderkey AS ordinal, CAST(coalesce(sum(q) FILTER (b = h1), 0) AS BIGINT) AS MS, CAST(coalesce(sum(q) FILTER (b <> h1 AND b = h2), 0) AS BIGINT) AS NS,
         count(*) FILTER (b = h1) AS MC, count(*) FILTER (b <> h1 AND b = h2) AS NC, count(*) FILTER (b = h1 OR b = h2) AS MI
  FROM (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'G' ELSE 'T' END AS b,
        CASE WHEN l_partkey % 2 = 0 THEN 'A' ELSE 'G' END AS h1, CASE WHEN l_partkey % 2 = 0 THEN 'G' ELSE 'A' END AS h2 FROM lineitem WHERE l_quantity >= 5) GROUP BY l_orderkey),
rd AS (SELECT o_orderkey AS ordinal, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE 'C' || (o_custkey % 150) END AS cb FROM orders),
tg AS (
  SELECT *, CASE MA WHEN 'H1' THEN 1 WHEN 'H2' THEN 2 END AS HP,
    CASE WHEN MA IN ('H1', 'H2') AND cb IS NOT NULL AND active IS NOT NULL THEN
        CASE WHEN active NOT IN ('X1', 'X2') THEN 'unknown' WHEN (active = 'X1') = (MA = 'H1') THEN 'Xa' ELSE 'Xi' END
      WHEN MA IN ('low', 'amb') THEN MA WHEN cb IS NULL THEN 'no_CB' WHEN active IS NULL THEN 'no_active_X' ELSE 'none' END AS XX
  FROM (SELECT rd.ordinal, rd.cb, active, coalesce(MS, 0) AS MS, coalesce(NS, 0) AS NS, coalesce(MC, 0) AS MC, coalesce(NC, 0) AS NC, coalesce(MI, 0) AS MI,
          CASE WHEN coalesce(MI, 0) = 0 THEN 'none' WHEN {a} + {b} < {t} THEN 'low' WHEN abs({a} - {b}) < {d} THEN 'amb' WHEN {a} > {b} THEN 'H1' ELSE 'H2' END AS MA
        FROM rd LEFT JOIN sc USING (ordinal) LEFT JOIN calls USING (cb)))"""
_QUALITY, _COUNT = _TAGS.format(a="MS", b="NS", t=10, d=10), _TAGS.format(a="MC", b="NC", t=1, d=1)
_TAG_ROWS = "SELECT ordinal, cb, MS, NS, MC, NC, MI, MA, CAST(HP AS INT) AS HP, XX FROM tg"


def _tagged(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """Orders as reads, their lines as bases."""
    even = F.col("l_partkey") % 2 == 0
    bases = P.table(spark, sf_dir, "lineitem").where("l_quantity >= 5").select(
        F.col("l_orderkey").alias("ordinal"), F.col("l_quantity").cast("long").alias("q"), F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "G").otherwise("T").alias("base"),
        F.when(even, "A").otherwise("G").alias("h1"), F.when(even, "G").otherwise("A").alias("h2"),
    )
    cb = F.when(F.col("o_custkey") % 11 != 0, F.concat(F.lit("C"), (F.col("o_custkey") % 150).cast("string")))
    reads = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), cb.alias("cb"))
    k = F.col("s_suppkey") % 4
    calls = P.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("C"), "s_suppkey").alias("cell_barcode"), F.when(k == 0, "X1").when(k == 1, "X2").otherwise("X1/X2").alias("active_X"))
    return tagging.tag(reads, tagging.score_bases(bases), calls, mode)


@query(f"WITH {_QUALITY} {_TAG_ROWS}")
def read_tags_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir, "quality")


@query(f"WITH {_COUNT} {_TAG_ROWS}")
def read_tags_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir, "count")


_ROUTE = f"""WITH {_QUALITY}, rt AS (SELECT ordinal, CASE MA WHEN 'H1' THEN 'X1' WHEN 'H2' THEN 'X2' END AS label FROM tg WHERE MA IN ('H1', 'H2')
  UNION ALL SELECT ordinal, CASE WHEN XX IN ('Xa', 'Xi', 'low', 'amb') THEN XX ELSE 'unknown' END FROM tg)"""


@query(f"{_ROUTE} SELECT * FROM rt")
def split_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.route(_tagged(spark, sf_dir, "quality")).select("ordinal", "label")


@query(f"{_ROUTE} SELECT label, count(ordinal) AS reads FROM (SELECT unnest(['X1', 'X2', 'Xa', 'Xi', 'low', 'amb', 'unknown']) AS label) LEFT JOIN rt USING (label) GROUP BY label")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.route_counts(tagging.route(_tagged(spark, sf_dir, "quality")))


@query("""WITH c AS (SELECT p_brand AS feature, 'C' || l_suppkey || '-1' AS cell_barcode, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  WHERE o_orderstatus <> 'P' AND p_size > 5 GROUP BY ALL)
SELECT feature, cell_barcode, n, s_suppkey AS cell_ordinal, o AS row_ordinal FROM c JOIN supplier ON cell_barcode = 'C' || s_suppkey || '-1' LEFT JOIN (SELECT p_brand AS feature, min(p_partkey) AS o FROM part WHERE p_size > 25 GROUP BY 1) USING (feature)""")
def matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as reads of brands; pending orders' reads are excluded by identifier, and a brand's small parts are not allowed."""
    lines = P.table(spark, sf_dir, "lineitem").join(P.table(spark, sf_dir, "part").where("p_size > 5"), F.col("l_partkey") == F.col("p_partkey"))
    reads = lines.select(F.col("l_orderkey").alias("read_id"), F.lit(0).alias("flags"), F.concat(F.lit("C"), "l_suppkey").alias("cb"), F.col("p_brand").alias("gn"))
    out = P.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("read_id"))
    part = P.table(spark, sf_dir, "part")
    counts = matrices.feature_counts(matrices.matrix_reads(reads, exclude_ids=out), part.select(F.col("p_brand").alias("feature")))
    order = part.where("p_size > 25").select(F.col("p_brand").alias("feature"), F.col("p_partkey").alias("ordinal"))
    barcodes = P.table(spark, sf_dir, "supplier").select(F.concat(F.lit("C"), "s_suppkey", F.lit("-1")).alias("cell_barcode"), F.col("s_suppkey").alias("ordinal"))
    return matrices.on_scaffold(counts, order, barcodes)


@query("""SELECT p_brand AS feature, 'C' || l_suppkey AS cell_barcode, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 48) GROUP BY ALL""")
def transcript_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as transcript tags, which are names of the annotation and none of its identifiers."""
    part = P.table(spark, sf_dir, "part")
    lines = P.table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    reads = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("read_id"), F.col("l_orderkey").alias("ordinal"), F.lit(0).alias("flags"), F.concat(F.lit("C"), "l_suppkey").alias("cb"), F.col("p_brand").alias("tr"))
    ids = part.select(F.concat(F.lit("T"), "p_partkey").alias("feature"), F.col("p_partkey").cast("long").alias("ordinal"))
    names = part.where("p_size > 48").select(F.col("p_brand").alias("feature"), F.col("p_partkey").cast("long").alias("ordinal"))
    _, rows = matrices.transcript_rows(reads, ids, names)
    return matrices.feature_counts(matrices.matrix_reads(reads, feature="tr"), rows)


_VALUES = """vals AS (SELECT 'C' || l_suppkey AS cell, p_brand || '/' || p_size AS gene_name, count(*) FILTER (l_returnflag = 'N' AND l_quantity > 40) AS xi, count(*) FILTER (l_returnflag = 'A') AS xa,
  count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def _layer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = P.cell_values(spark, sf_dir)
    raw = P.table(spark, sf_dir, "lineitem").join(P.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    raw = raw.groupBy(F.concat_ws("/", "p_brand", "p_size").alias("gene"), F.concat(F.lit("C"), "l_suppkey").alias("cell")).agg(F.count("*").cast("double").alias("value"))
    of = lambda c: v.where(F.col(c) > 0).select(F.col("gene_name").alias("gene"), "cell", F.col(c).cast("double").alias("value"))
    return layers.x_layers(raw, of("xa"), of("xi"), P.cells(spark, sf_dir).select("cell"))


@query(f"""WITH {_VALUES}, t AS (SELECT cell, CAST(sum(n) AS DOUBLE) AS raw_total, CAST(sum(xa) AS DOUBLE) AS a, CAST(sum(xi) AS DOUBLE) AS i FROM vals GROUP BY cell)
SELECT 'C' || s_suppkey AS cell, coalesce(raw_total, 0) AS raw_total, round(coalesce((a + i) * 10000 / raw_total, 0), 6) AS Xai_total, round(2 * abs(0.5 - a / nullif(a + i, 0)), 6) AS "allelic_imbalance_chrX"
FROM supplier LEFT JOIN t ON cell = 'C' || s_suppkey""")
def cell_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_layer(spark, sf_dir)[1])


@query(f"""WITH {_VALUES}, t AS (SELECT cell, sum(n) AS tot FROM vals GROUP BY cell), l AS (
  SELECT 'raw_counts' AS layer, gene_name AS gene, cell, n AS value FROM vals UNION ALL SELECT 'Xa', gene_name, cell, xa FROM vals WHERE xa > 0 UNION ALL SELECT 'Xi', gene_name, cell, xi FROM vals WHERE xi > 0
  UNION ALL SELECT 'Xai', gene_name, cell, xa + xi FROM vals WHERE xa + xi > 0)
SELECT layer, gene, cell, CAST(value AS DOUBLE) AS value FROM l UNION ALL SELECT layer || '_Normalized', gene, l.cell, round(value * 10000 / tot, 6) FROM l JOIN t USING (cell) WHERE layer <> 'raw_counts'""")
def layer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_layer(spark, sf_dir)[0])


@query(f"""WITH {ACTIVE}
SELECT 'C' || s_suppkey AS cell, x AS active_X, CAST(s1 + s2 AS DOUBLE) AS haplotype_sum, round(2 * abs(0.5 - s1 / nullif(s1 + s2, 0)), 6) AS "allelic_imbalance_HC" FROM supplier LEFT JOIN act ON cell = 'C' || s_suppkey""")
def haplotype_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _haplotypes(spark, sf_dir)[2]
    return rounded(layers.haplotype_metrics(P.cells(spark, sf_dir).select("cell"), calls, suffix=None))


_BATCH = "SELECT 'A' AS batch, 'C' || l_suppkey || '-A' AS cell, p_brand AS gene, CAST(count(*) AS DOUBLE) AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F' GROUP BY ALL UNION ALL SELECT 'B', 'C' || l_suppkey || '-B', p_brand, CAST(count(*) AS DOUBLE) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O' AND p_size > 10 GROUP BY ALL"


def _batches(spark: SparkSession, sf_dir: str, join: str) -> DataFrame:
    rows = P.table(spark, sf_dir, "lineitem").join(P.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    count = lambda w: rows.where(w).groupBy(F.col("p_brand").alias("gene"), F.concat(F.lit("C"), "l_suppkey").alias("cell")).agg(F.count("*").cast("double").alias("value"))
    a, b = count("l_linestatus = 'F'"), count("l_linestatus = 'O' and p_size > 10")
    return layers.concat_batches([("A", a, a.select("cell").distinct()), ("B", b, b.select("cell").distinct())], join)[0]


@query(_BATCH)
def batch_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir, "outer")


@query(f"WITH b AS ({_BATCH}) SELECT * FROM b WHERE gene IN (SELECT gene FROM b GROUP BY gene HAVING count(DISTINCT batch) = 2)")
def batch_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir, "inner")


# ---- escape ---------------------------------------------------------------------------------------------------------------------

ATLAS = f"""{_VALUES}, cells AS (
  SELECT 'C' || s_suppkey AS cell, n_name AS donor_id, 'T' || (s_suppkey % 6) AS cell_type, CASE WHEN s_nationkey % 5 <> 0 THEN 'S' || n_regionkey END AS sample_group,
    CASE WHEN s_acctbal > 0 THEN 'Healthy' ELSE 'Disease' END AS disease_group, CASE WHEN s_nationkey % 5 <> 0 THEN 'adult' END AS age_group FROM supplier JOIN nation ON s_nationkey = n_nationkey),
sz AS (SELECT donor_id, cell_type, sample_group, disease_group, age_group, count(*) AS n_cells_total_group FROM cells GROUP BY ALL),
ag AS (SELECT gene_name, donor_id, cell_type, sample_group, disease_group, age_group, CAST(sum(xi) AS BIGINT) AS xi_reads, CAST(sum(xa) AS BIGINT) AS xa_reads, count(*) FILTER (xi + xa <> 0) AS n_cells_with_signal FROM vals JOIN cells USING (cell) GROUP BY ALL),
atlas AS (
  SELECT ag.*, n_cells_total_group, xi_reads + xa_reads AS total_allelic_reads, xi_reads + xa_reads >= 3 AND n_cells_with_signal >= 1 AS informative_firstpass, xi_reads / (xi_reads + xa_reads) AS xi_raw_firstpass
  FROM ag JOIN sz ON ag.donor_id = sz.donor_id AND ag.cell_type = sz.cell_type AND ag.sample_group IS NOT DISTINCT FROM sz.sample_group AND ag.disease_group = sz.disease_group AND ag.age_group IS NOT DISTINCT FROM sz.age_group
  WHERE xi_reads + xa_reads > 0)"""
ANNOT = """an AS (
  SELECT DISTINCT p_brand || '/' || p_size AS gene_name, CASE WHEN p_size % 10 = 9 THEN 'chr8' ELSE 'chrX' END AS chrom, CASE p_size % 6 WHEN 0 THEN 'Escape' WHEN 1 THEN 'Variable' WHEN 2 THEN 'Inactive' WHEN 3 THEN 'Unknown' END AS xci_status,
    CASE WHEN p_size % 6 >= 3 AND p_size % 4 = 0 THEN 'PAR1' END AS PAR_region, 'note' AS "donor_id.ann" FROM part),
an2 AS (
  SELECT *, replace(chrom, 'chr', '') AS chromosome_clean, CASE WHEN chrom = 'chrX' THEN 'true' ELSE 'false' END AS "is_chrX", CASE xci_status WHEN 'Escape' THEN 'nonPAR_escape' WHEN 'Variable' THEN 'nonPAR_variable_escape'
    WHEN 'Inactive' THEN 'nonPAR_subject' WHEN 'Unknown' THEN 'nonPAR_uncertain' ELSE CASE WHEN PAR_region IS NOT NULL THEN 'PAR' END END AS k FROM an)"""
MASTER = f"""{ATLAS}, {ANNOT}, mst AS (
  SELECT atlas.*, an2.* EXCLUDE (gene_name, k), k AS preferred_escape_class, k AS atlas_gene_group,
    CASE k WHEN 'nonPAR_escape' THEN 'Escape' WHEN 'nonPAR_variable_escape' THEN 'Variable' WHEN 'nonPAR_subject' THEN 'Inactive' WHEN 'nonPAR_uncertain' THEN 'Unknown' ELSE k END AS atlas_gene_group_display
  FROM atlas LEFT JOIN an2 USING (gene_name) WHERE "is_chrX" = 'true')"""
ROWS = f"""{MASTER}, rw AS (SELECT *, xi_reads / total_allelic_reads AS xi_raw FROM mst WHERE informative_firstpass),
mom AS (SELECT least(greatest(avg(xi_raw), 0.001), 0.999) AS m, var_samp(xi_raw) AS v FROM rw),
prior AS (SELECT m * (m * (1 - m) / v - 1) AS alpha, (1 - m) * (m * (1 - m) / v - 1) AS beta, v FROM mom),
sh AS (SELECT rw.*, (xi_reads + alpha) / (total_allelic_reads + alpha + beta) AS xi_shrunk FROM rw, prior)"""


def _atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return downstream.atlas(P.cell_values(spark, sf_dir), P.cells(spark, sf_dir), min_cells=1)


def _master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return downstream.master(_atlas(spark, sf_dir), downstream.standard_annotation(P.annotation(spark, sf_dir)))


def _shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = downstream.row_filter(_master(spark, sf_dir), min_cells=1)
    return downstream.shrink(rows, downstream.beta_prior(rows))


@query(f"WITH {ATLAS} SELECT * REPLACE (round(xi_raw_firstpass, 6) AS xi_raw_firstpass) FROM atlas")
def atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_atlas(spark, sf_dir))


@query(f"""WITH {ATLAS}, full_grid AS (SELECT gene_name, sz.* FROM (SELECT DISTINCT gene_name FROM vals) g, sz)
SELECT f.gene_name, f.disease_group, count(*) AS n_rows, count(a.gene_name) AS n_seen, CAST(sum(coalesce(a.xi_reads, 0)) AS BIGINT) AS xi_reads
FROM full_grid f LEFT JOIN ag a ON f.gene_name = a.gene_name AND f.donor_id = a.donor_id AND f.cell_type = a.cell_type AND f.sample_group IS NOT DISTINCT FROM a.sample_group AND f.disease_group = a.disease_group
  AND f.age_group IS NOT DISTINCT FROM a.age_group AND a.xi_reads + a.xa_reads > 0 GROUP BY ALL""")
def atlas_zero_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = P.cell_values(spark, sf_dir)
    a = downstream.atlas(v, P.cells(spark, sf_dir), v.select("gene_name").distinct(), min_cells=1, keep_zero_rows=True)
    return a.groupBy("gene_name", "disease_group").agg(F.count("*").alias("n_rows"), F.count_if(F.col("total_allelic_reads") > 0).alias("n_seen"), F.sum("xi_reads").alias("xi_reads"))


@query(f"WITH {MASTER} SELECT * REPLACE (round(xi_raw_firstpass, 6) AS xi_raw_firstpass) FROM mst")
def master_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _master(spark, sf_dir)
    return m.withColumn("xi_raw_firstpass", F.round("xi_raw_firstpass", 6))


@query(f"WITH {MASTER} SELECT sample_group, disease_group, count(*) AS n_rows, count(DISTINCT donor_id) AS n_donors, string_agg(DISTINCT donor_id, ',' ORDER BY donor_id) AS donors FROM mst GROUP BY ALL")
def sample_group_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return downstream.sample_qc(_master(spark, sf_dir))


@query(f"""WITH {MASTER} SELECT count(*) AS n_rows, count(DISTINCT gene_name) AS n_genes, count(DISTINCT donor_id) AS n_donors, string_agg(DISTINCT donor_id, ',' ORDER BY donor_id) AS donors,
  string_agg(DISTINCT disease_group, ',' ORDER BY disease_group) AS disease_groups, count(*) FILTER (preferred_escape_class IS NULL) AS n_missing_class, CAST(0 AS BIGINT) AS n_duplicate_annotation_genes FROM mst""")
def merge_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return downstream.merge_qc(_master(spark, sf_dir), downstream.standard_annotation(P.annotation(spark, sf_dir)))


@query(f"""WITH {ROWS} SELECT CAST(3 AS INT) AS min_total_reads, CAST(1 AS INT) AS min_cells_with_signal, count(*) AS n_rows, count(DISTINCT gene_name) AS n_genes, count(DISTINCT donor_id) AS n_donors,
  count(DISTINCT cell_type) AS n_cell_types, string_agg(DISTINCT disease_group, ',' ORDER BY disease_group) AS disease_groups FROM rw""")
def row_filter_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return downstream.row_filter_qc(downstream.row_filter(_master(spark, sf_dir), min_cells=1), min_cells=1)


@query(f"WITH {ROWS} SELECT round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(alpha / (alpha + beta), 6) AS mean, round(v, 6) AS variance, 'method_of_moments' AS method FROM prior")
def beta_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(downstream.beta_prior(downstream.row_filter(_master(spark, sf_dir), min_cells=1)))


@query(f"WITH {ROWS} SELECT gene_name, donor_id, cell_type, sample_group, disease_group, age_group, total_allelic_reads, round(xi_raw, 6) AS xi_raw, round(xi_shrunk, 6) AS xi_shrunk FROM sh")
def shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_shrunk(spark, sf_dir).select("gene_name", *downstream.GROUP, "total_allelic_reads", "xi_raw", "xi_shrunk"))


@query(f"WITH {ROWS} SELECT disease_group, cell_type, round(avg(xi_shrunk), 6) AS xi_shrunk_celltype_mean, CAST(sum(total_allelic_reads) AS BIGINT) AS celltype_total_reads FROM sh GROUP BY ALL")
def backbone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(downstream.backbone(_shrunk(spark, sf_dir)))


@query(f"""WITH {ROWS}, dn AS (SELECT donor_id, sample_group, disease_group, age_group, cell_type, avg(xi_shrunk) AS mean, count(DISTINCT gene_name) AS n_informative_genes, CAST(sum(total_allelic_reads) AS BIGINT) AS total_reads FROM sh GROUP BY ALL),
bb AS (SELECT disease_group, cell_type, avg(xi_shrunk) AS bm, CAST(sum(total_allelic_reads) AS BIGINT) AS celltype_total_reads FROM sh GROUP BY ALL), md AS (SELECT median(total_reads) AS md FROM dn)
SELECT dn.donor_id, sample_group, dn.disease_group, age_group, dn.cell_type, round(mean, 6) AS xi_shrunk_mean, n_informative_genes, total_reads, round(bm, 6) AS xi_shrunk_celltype_mean, celltype_total_reads,
  round(total_reads / (total_reads + md), 6) AS pool_weight, round(total_reads / (total_reads + md) * mean + (1 - total_reads / (total_reads + md)) * bm, 6) AS xi_pooled FROM dn JOIN bb USING (disease_group, cell_type), md""")
def donor_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(downstream.pooled(_shrunk(spark, sf_dir)))


def _summary_sql(cutoff: float, donors: int, strict: bool, by: str = "disease_group, ") -> str:
    call = f"n_escape_donors >= {donors}" if strict else f"n_donors >= {donors} AND mean_xi >= {cutoff}"
    return f"""{ROWS}, es AS (SELECT *, n_donors >= {donors} AS informative, {call} AS escape_call FROM (
  SELECT {by}gene_name, cell_type, avg(xi_shrunk) AS mean_xi, avg(xi_raw) AS mean_xi_raw, count(DISTINCT donor_id) AS n_donors, count(*) FILTER (xi_shrunk >= {cutoff}) AS n_escape_donors,
    CAST(sum(total_allelic_reads) AS BIGINT) AS total_allelic_reads, count(*) AS n_rows, max(preferred_escape_class) AS preferred_escape_class FROM sh GROUP BY ALL))"""


def _pattern_sql(by: str = "disease_group, ", bands: str = "e >= 3 THEN 'intermediate_strict' WHEN e >= 1 THEN 'selective_strict'") -> str:
    return f"""SELECT *, CASE WHEN e >= 6 THEN 'shared_constitutive' WHEN {bands} ELSE 'does_not_pass_strict' END AS escape_pattern FROM (
  SELECT {by}gene_name, count(*) FILTER (informative AND escape_call) AS e, count(*) FILTER (informative) AS i, count(*) FILTER (informative AND NOT escape_call) AS n,
    coalesce(string_agg(cell_type, ',' ORDER BY cell_type) FILTER (informative AND escape_call), '') AS escaping_celltypes, coalesce(string_agg(cell_type, ',' ORDER BY cell_type) FILTER (informative), '') AS informative_celltypes FROM es GROUP BY ALL)"""


_PATTERN_COLUMNS = "EXCLUDE (e, i, n), e AS n_escape_celltypes, i AS n_informative_celltypes, n AS n_non_escape_informative_celltypes"


def _escape(mode: str, cutoff: float, donors: int) -> None:
    def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(downstream.escape_summary(_shrunk(spark, sf_dir), mode, cutoff, donors, annotation=("preferred_escape_class",)))

    def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
        return downstream.pattern_summary(downstream.escape_summary(_shrunk(spark, sf_dir), mode, cutoff, donors))

    summary.__name__, patterns.__name__ = f"escape_summary_{mode}", f"escape_pattern_{mode}"
    sql = _summary_sql(cutoff, donors, mode != "mean_strict")
    query(f"WITH {sql} SELECT * REPLACE (round(mean_xi, 6) AS mean_xi, round(mean_xi_raw, 6) AS mean_xi_raw) FROM es")(summary)
    query(f"WITH {sql}, pt AS ({_pattern_sql()}) SELECT * {_PATTERN_COLUMNS} FROM pt")(patterns)


for _args in (("recovery", 0.10, 1), ("strict", 0.20, 2), ("mean_strict", 0.20, 2)):
    _escape(*_args)


@query(f"WITH {_summary_sql(0.2, 2, True, '')}, pt AS ({_pattern_sql('', 'e BETWEEN 3 AND 5 AND n >= 1 THEN ' + chr(39) + 'intermediate_strict' + chr(39) + ' WHEN e BETWEEN 1 AND 2 AND n >= 1 THEN ' + chr(39) + 'selective_strict' + chr(39))}) SELECT * {_PATTERN_COLUMNS} FROM pt")
def escape_pattern_non_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = downstream.escape_summary(_shrunk(spark, sf_dir), "strict", 0.20, 2, by_disease=False)
    return downstream.pattern_summary(s, by_disease=False, require_non_escape=True, min_non_escape=1)


@query(f"WITH {_summary_sql(0.2, 2, True)}, pt AS ({_pattern_sql()}) SELECT 'strict' AS escape_mode, CAST(0.2 AS DOUBLE) AS xi_cutoff, CAST(2 AS INT) AS min_donors, count(*) AS n_rows, count(*) FILTER (escape_call) AS n_escape_calls, (SELECT count(*) FROM pt) AS n_pattern_rows FROM es")
def escape_call_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = downstream.escape_summary(_shrunk(spark, sf_dir), "strict", 0.20, 2)
    return downstream.call_qc(s, downstream.pattern_summary(s), "strict", 0.20, 2)
