"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

A source's share of all tokens (words) is raised to an exponent and normalised. The exponent is
bisected: the largest in [0, 1] whose weights reach a target entropy, or, where that repeats some
source more than allowed, the smallest whose weights keep the repetition limit. A source's budget is its
weight of the token budget. Its documents are dealt to blocks by a hash; each epoch is a new permutation
of the blocks, whole epochs are repeated, and the last one ends with the budget, in the order of a
document's hash within its block. Only DataFrame functions are used.

Sums are taken per block before they are ordered, and the prefix over a source's blocks in two levels,
so no source's documents or blocks meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barrspark.llm.common import WORD_PATTERN, materialize

ENTROPY_SHARE = 0.97
MAX_REPEATS = 4.0
BLOCK_TOKENS = 100_000
SEED = "mix1"
_BITS, _SUPER_BITS, _SECTION_BITS, _ROUNDS = 60, 10, 5, 8


def _hash60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _doc_hash(doc_id: Column, seed: str) -> Column:
    return _hash60(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _block_key(seed: str, epoch: Column, source: Column, block: Column) -> Column:
    parts = [F.lit(seed), epoch.cast("string"), F.coalesce(source, F.lit("")), block.cast("string")]
    return _hash60(F.concat_ws(":", *parts))


def _bisected(shares: DataFrame, goes_right, at_end: str) -> float:
    """Bisects [0, 1], five halvings to a pass over the shares; ``goes_right`` takes exponent, entropy, repeats."""
    lo, width, parts = 0.0, 1.0, 1 << _SECTION_BITS
    for _ in range(_ROUNDS):
        steps = [lo + width * k / parts for k in range(1, parts)]
        p, a = F.col("p"), F.col("a")
        z = F.sum(F.pow(p, a))
        entropy = F.log(z) - F.sum(a * F.pow(p, a) * F.log(p)) / z
        rows = (
            shares.select("p", F.explode(F.array(*map(F.lit, steps))).alias("a"))
            .groupBy("a")
            .agg(entropy.alias("entropy"), (F.max(F.pow(p, a - 1)) / z).alias("repeats"))
            .collect()
        )
        right = {r["a"] for r in rows if goes_right(r["entropy"], r["repeats"])}
        passed = next((k for k, s in enumerate(steps) if s not in right), len(steps))
        lo, width = lo + width * passed / parts, width / parts
    return lo if at_end == "lo" else lo + width


def exponent(stats: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS) -> float:
    """The exponent for a table of ``tokens`` by source; 1 where no source has tokens."""
    stats = stats.where("tokens > 0")
    total, n = stats.agg(F.sum("tokens"), F.count("*")).first()
    if not n:
        return 1.0
    shares = materialize(stats.select((F.col("tokens") / float(total)).alias("p")), "shares")
    target = entropy_share * math.log(n)
    natural = -(shares.agg(F.sum(F.col("p") * F.log("p"))).first()[0])
    flat = 1.0 if natural >= target else _bisected(shares, lambda e, _: e >= target, "lo")
    most = shares.agg(F.max(1 / F.col("p")) / F.lit(n)).first()[0]
    held = 0.0 if most <= max_repeats else _bisected(shares, lambda _, r: r > max_repeats, "hi")
    return max(flat, held)


def mixing_plan(
    docs: DataFrame,
    budget_tokens: int | None = None,
    entropy_share: float = ENTROPY_SHARE,
    max_repeats: float = MAX_REPEATS,
    block_tokens: int = BLOCK_TOKENS,
    seed: str = SEED,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """Marked documents (``doc_id, source, n_tokens, h``) and, by source, what realises its weight.

    The second table has ``weight``, ``budget``, ``epochs`` (whole ones), ``per_block`` (width of a block in
    hash space), and where the last epoch ends: ``cut_key`` and ``cut_h`` (null: it has no documents).
    """
    marked = materialize(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_PATTERN)).cast("long").alias("n_tokens"),
            _doc_hash(F.col(doc_id), seed).alias("h"),
        ),
        "marked",
    )
    stats = materialize(marked.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "stats")
    total = stats.agg(F.sum("tokens")).first()[0] or 0
    alpha = exponent(stats, entropy_share, max_repeats)
    live = stats.where("tokens > 0")
    power = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(alpha))
    z = live.agg(F.sum(power)).first()[0] or 1.0
    budget = float(total if budget_tokens is None else budget_tokens)
    plan = (
        live.withColumn("weight", power / F.lit(z))
        .withColumn("budget", F.floor(F.col("weight") * F.lit(budget) + 0.5).cast("long"))
        .withColumn("epochs", F.expr("budget div tokens"))
        .withColumn("rest", F.expr("budget - epochs * tokens"))
        .withColumn("n_blocks", F.ceil(F.col("tokens") / F.lit(float(block_tokens))).cast("long"))
        .withColumn("per_block", F.expr(f"{1 << _BITS} div n_blocks + 1"))
    )
    plan = materialize(plan, "weights")
    blocks = (
        marked.join(plan.select("source", "epochs", "rest", "per_block"), _same("source", marked, plan))
        .select(marked["source"], "epochs", "rest", F.expr("h div per_block").alias("block"), "n_tokens")
        .groupBy("source", "epochs", "rest", "block")
        .agg(F.sum("n_tokens").alias("n"))
        .withColumn("key", _block_key(seed, F.col("epochs"), F.col("source"), F.col("block")))
        .withColumn("super", F.shiftright("key", _BITS - _SUPER_BITS))
    )
    blocks = materialize(blocks, "mixblocks")
    over = W.partitionBy("source").orderBy("super")
    above = blocks.groupBy("source", "super").agg(F.sum("n").alias("sn"))
    above = above.select(F.col("source").alias("s"), F.col("super").alias("u"), (F.sum("sn").over(over) - F.col("sn")).alias("base"))
    within = W.partitionBy("source", "super").orderBy("key")
    before = blocks.join(above, F.col("source").eqNullSafe(F.col("s")) & (F.col("super") == F.col("u")))
    before = before.withColumn("before", F.col("base") + F.sum("n").over(within) - F.col("n"))
    ends = before.where("before <= rest and rest < before + n")
    ends = materialize(ends.select("source", "block", "key", (F.col("rest") - F.col("before")).alias("left")), "ends")
    # the documents of each source's last, partly taken block
    widths = plan.select("source", "per_block")
    last = marked.join(widths, _same("source", marked, widths)).select(marked["source"], "h", "n_tokens", F.expr("h div per_block").alias("block"))
    last = last.join(ends, _same("source", last, ends) & (last["block"] == ends["block"])).select(last["source"], "h", "n_tokens", "key", "left")
    run = last.withColumn("upto", F.sum("n_tokens").over(W.partitionBy("source").orderBy("h")))
    cuts = run.groupBy("source").agg(
        F.first("key").alias("cut_key"), F.coalesce(F.max(F.when(F.col("upto") <= F.col("left"), F.col("h"))), F.lit(-1)).alias("cut_h")
    )
    out = plan.join(cuts, _same("source", plan, cuts), "left").drop(cuts["source"])
    return marked, materialize(out, "mixplan")


def _same(name: str, a: DataFrame, b: DataFrame) -> Column:
    return a[name].eqNullSafe(b[name])


def _copies(rows: DataFrame, seed: str) -> DataFrame:
    """Rows with ``source, h`` and their plan's columns, once for each epoch that takes them."""
    key = lambda e: _block_key(seed, e, F.col("source"), F.col("block"))
    rows = rows.withColumn("block", F.expr("h div per_block"))
    mine = key(F.col("epochs"))
    taken = (mine < F.col("cut_key")) | ((mine == F.col("cut_key")) & (F.col("h") <= F.col("cut_h")))
    n = F.col("epochs") + F.coalesce(taken, F.lit(False)).cast("long")
    out = rows.where(n > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return out.withColumn("block_key", key(F.col("epoch")))


_PLAN = ("epochs", "per_block", "cut_key", "cut_h")


def mix(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """``doc_id, source, epoch, block, block_key, n_tokens``: one row for each copy of a document.

    Within a source the training order is (``epoch``, ``block_key``, the document's hash). Null sources are
    one source, null texts have no tokens, and a source without tokens has no weight and no rows. Documents
    without an id share one hash and are taken together, as are repeated rows. Other columns are not read.
    """
    marked, plan = mixing_plan(docs, seed=seed, **options)
    rows = marked.join(plan.select(F.col("source").alias("s"), *_PLAN), F.col("source").eqNullSafe(F.col("s")))
    return _copies(rows, seed).select("doc_id", "source", "epoch", "block", "block_key", "n_tokens")


def mixed_documents(docs: DataFrame, seed: str = SEED, source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it, with all their columns."""
    _, plan = mixing_plan(docs, seed=seed, source=source, doc_id=doc_id, **options)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("__row")
    rows = docs.select(row, docs[source].cast("string").alias("source"), _doc_hash(docs[doc_id], seed).alias("h"))
    rows = rows.join(plan.select(F.col("source").alias("s"), *_PLAN), F.col("source").eqNullSafe(F.col("s")))
    return _copies(rows, seed).select("__row.*")


#: The same mixture in DuckDB's SQL, with the parameters above.
ORACLE_SQL = f"""
WITH RECURSIVE marked AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
stats AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM marked GROUP BY source HAVING sum(n_tokens) > 0),
tot AS (SELECT CAST(sum(tokens) AS DOUBLE) AS t, count(*) AS n FROM stats),
ps AS (SELECT list(tokens / t) AS p, any_value({ENTROPY_SHARE} * ln(n)) AS target FROM stats, tot),
flat AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS w FROM ps
  UNION ALL
  SELECT i + 1, CASE WHEN ln(list_sum([pow(x, lo + w / 2) for x in p]))
      - list_sum([(lo + w / 2) * pow(x, lo + w / 2) * ln(x) for x in p]) / list_sum([pow(x, lo + w / 2) for x in p]) >= target
    THEN lo + w / 2 ELSE lo END, w / 2 FROM flat, ps WHERE i < {_SECTION_BITS * _ROUNDS}),
held AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS w FROM ps
  UNION ALL
  SELECT i + 1, CASE WHEN list_max([pow(x, lo + w / 2 - 1) for x in p]) / list_sum([pow(x, lo + w / 2) for x in p]) > {MAX_REPEATS}
    THEN lo + w / 2 ELSE lo END, w / 2 FROM held, ps WHERE i < {_SECTION_BITS * _ROUNDS}),
expo AS (
  SELECT greatest(
    CASE WHEN -list_sum([x * ln(x) for x in p]) >= target THEN 1.0 ELSE (SELECT max_by(lo, i) FROM flat) END,
    CASE WHEN list_max([1 / x for x in p]) / len(p) <= {MAX_REPEATS} THEN 0.0 ELSE (SELECT max_by(lo + w, i) FROM held) END) AS a
  FROM ps),
plan AS (
  SELECT *, budget // tokens AS epochs, budget - (budget // tokens) * tokens AS rest,
         {1 << _BITS} // CAST(ceil(tokens / {float(BLOCK_TOKENS)}) AS BIGINT) + 1 AS per_block
  FROM (SELECT source, tokens, CAST(floor(pow(tokens / t, a) / (SELECT sum(pow(tokens / t, a)) FROM stats, tot, expo) * t + 0.5) AS BIGINT) AS budget
        FROM stats, tot, expo)),
docs AS (
  SELECT m.doc_id, m.source, m.n_tokens, m.h, p.epochs, p.rest, m.h // p.per_block AS block
  FROM marked m JOIN plan p ON m.source IS NOT DISTINCT FROM p.source),
keyed AS (
  SELECT *, CAST('0x' || substr(md5('{SEED}:' || epochs || ':' || coalesce(source, '') || ':' || block), 1, 15) AS BIGINT) AS k FROM docs),
upto AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY k, h) AS taken FROM keyed),
copies AS (SELECT *, epochs + CASE WHEN taken <= rest THEN 1 ELSE 0 END AS n FROM upto),
-- the last epoch's rows in order end at the first that would pass the budget
ends AS (SELECT source, min(k) FILTER (taken > rest) AS k0, min_by(h, (k, h)) FILTER (taken > rest) AS h0 FROM upto GROUP BY source)
SELECT c.doc_id, c.source, CAST(e.epoch AS BIGINT) AS epoch, CAST(c.block AS BIGINT) AS block,
       CAST('0x' || substr(md5('{SEED}:' || e.epoch || ':' || coalesce(c.source, '') || ':' || c.block), 1, 15) AS BIGINT) AS block_key,
       c.n_tokens
FROM copies c, LATERAL (SELECT unnest(generate_series(0, c.n - 1)) AS epoch) e
"""
