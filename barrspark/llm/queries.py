"""Queries of this subpackage over the standard tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barrspark.llm import (
    arc_warc,
    block_naming,
    byte_bpe,
    collision_counting,
    langid_bayes,
    log_bilinear,
    quote_linking,
    simhash_ball,
    skip_chain_crf,
    temperature_mix,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_linking.conversations(_table(spark, sf_dir, "conversations"))


def op2_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_counting.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_simhash_ball_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_ball.simhash_components(_table(spark, sf_dir, "documents"))


def op4_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skip_chain_crf.personal_data(_table(spark, sf_dir, "documents"))


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temperature_mix.mix(_table(spark, sf_dir, "documents"))


def op6_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.score_texts(_table(spark, sf_dir, "documents"))


def bpe_vocabulary() -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of the public vocabulary that the queries use."""
    import public_tokenizers

    return byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op7_byte_bpe_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = bpe_vocabulary()
    return byte_bpe.encode_and_check(_table(spark, sf_dir, "documents"), ranks, pattern)


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of the pages, read back; the record's key is the page."""
    return arc_warc.archive_pages(_table(spark, sf_dir, "pages")).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_naive_bayes_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_bayes.identify(_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS mid, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations),
l AS (SELECT mid, conv_id, turn, unnest(generate_series(1, len(lines))) AS i, unnest(lines) AS line FROM m),
p AS (SELECT *, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS lev, regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') AS said FROM l),
q AS (SELECT *, lag(lev) OVER w AS prev, coalesce(lead(lev) OVER w, 0) AS nxt FROM p WINDOW w AS (PARTITION BY mid ORDER BY i)),
g AS (SELECT *, sum(CASE WHEN prev IS DISTINCT FROM lev THEN 1 ELSE 0 END) OVER (PARTITION BY mid ORDER BY i) AS run FROM q),
passage AS (
  SELECT * FROM (SELECT mid, conv_id, turn, run, lev, lower(trim(regexp_replace(string_agg(said, ' ' ORDER BY i), '\s+', ' ', 'g'))) AS unit FROM g WHERE lev > 0 GROUP BY ALL) WHERE unit <> ''),
own AS (
  SELECT mid, string_agg(line, chr(10) ORDER BY i) AS body FROM g
  WHERE lev = 0 AND NOT (nxt > 0 AND regexp_matches(line, '^.{0,300}(?:wrote|writes|schrieb|écrit|escribió)[ \t]*:[ \t]*$')) GROUP BY mid),
np AS (SELECT mid, count(*) AS n, max(lev) AS top FROM passage GROUP BY mid),
b AS (
  SELECT m.mid, conv_id, turn, role, coalesce(n, 0) AS n, coalesce(top, 0) AS top,
         CASE WHEN n > 0 THEN trim(regexp_replace(coalesce(body, ''), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) ELSE coalesce(body, '') END AS text
  FROM m LEFT JOIN own USING (mid) LEFT JOIN np USING (mid)),
u AS (
  SELECT conv_id, turn, unit FROM (
    SELECT conv_id, turn, lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS unit
    FROM (SELECT conv_id, turn, unnest(list_concat([text], string_split(text, chr(10)), regexp_split_to_array(text, '\n\s*\n'))) AS x FROM b))
  WHERE unit <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
s AS (SELECT unit, conv_id, min(turn) AS t FROM u SEMI JOIN passage USING (unit) GROUP BY ALL),
f AS (SELECT unit, first(conv_id ORDER BY conv_id, t) AS c, first(t ORDER BY conv_id, t) AS t FROM s GROUP BY unit),
k AS (
  SELECT mid, CASE WHEN s.t < passage.turn THEN s.t END AS here, CASE WHEN f.c IS DISTINCT FROM passage.conv_id THEN f.t END AS there
  FROM passage LEFT JOIN s ON s.unit = passage.unit AND s.conv_id = passage.conv_id LEFT JOIN f ON f.unit = passage.unit),
r AS (SELECT mid, count(coalesce(here, there)) AS n_linked, max(here) AS reply_to FROM k GROUP BY mid),
up AS (SELECT conv_id, turn, max(reply_to) AS up FROM b JOIN r USING (mid) WHERE reply_to IS NOT NULL GROUP BY ALL),
way AS (
  SELECT conv_id, turn, up AS high FROM up
  UNION ALL SELECT way.conv_id, way.turn, up.up FROM way JOIN up ON up.conv_id = way.conv_id AND up.turn = way.high),
root AS (SELECT conv_id, turn, min(high) AS root FROM way GROUP BY ALL)
SELECT b.conv_id, b.turn, role, text, CAST(top AS BIGINT) AS n_levels, CAST(n AS BIGINT) AS n_passages, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, reply_to, coalesce(root, b.turn) AS root_turn
FROM b LEFT JOIN r USING (mid) LEFT JOIN root ON root.conv_id = b.conv_id AND root.turn = b.turn
"""

OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (
  SELECT norm, count(*) AS group_size, first(doc_id ORDER BY length(t) DESC, doc_id NULLS LAST) AS keep_id FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""

OP8_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN keep IS NULL OR keep IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keep IS NULL OR keep IS NOT DISTINCT FROM page_id THEN NULL ELSE keep END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quotation_linking,
        op2_collision_counting,
        op3_simhash_ball_hashing,
        op4_skip_chain_crf,
        op5_temperature_mixing,
        op6_log_bilinear,
        op7_byte_bpe_fold,
        op8_arc_to_warc,
        op9_block_naming,
        op10_naive_bayes_langid,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_quotation_linking": OP1_SQL,
    "op5_temperature_mixing": temperature_mix.ORACLE_SQL,
    "op8_arc_to_warc": OP8_SQL,
    "op9_block_naming": OP9_SQL,
}
