"""Exact deduplication by deterministic naming of text blocks.

A text without its space characters is cut into blocks of a fixed number of UTF-8 bytes. The
distinct blocks are sorted and numbered; then adjacent names are paired, the distinct pairs sorted
and numbered, and so on until one name stands for each whole text. Two texts of the same number of
blocks have the same name exactly if they are equal.

To move each block only once, it is named through a 64-bit key: blocks are grouped by (key, block),
so equal names always rest on compared bytes. Should a key belong to several blocks, all blocks are
joined on their bytes instead. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barrspark.llm.common import discard, materialize, numbered_rows

BLOCK_BYTES = 4096
_SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    """The text without the characters ``[\\x20\\x09-\\x0D]``; null gives the empty text."""
    out = F.coalesce(text, F.lit(""))
    for c in _SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _blocks(norm: Column, size: int) -> Column:
    """All blocks of a text, in order; an empty text has one empty block.

    The bytes are bound once, as a lambda's outer expressions are evaluated for every element.
    """

    def cut(raw: Column) -> Column:
        last = F.greatest(F.floor((F.length(raw) - 1) / F.lit(size)), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))

    return F.element_at(F.transform(F.array(norm.cast("binary")), cut), 1)


def _numbered(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Integer names for distinct keys: partitions sorted, rows numbered within and across them."""
    return materialize(
        distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), name
    )


def name_texts(
    docs: DataFrame, text: str, carry: dict[str, Column], block_bytes: int = BLOCK_BYTES, key=F.xxhash64
) -> DataFrame:
    """One row per input row: the ``carry`` columns, ``n_blocks`` and ``name``.

    (``n_blocks``, ``name``) is the same for two rows exactly if their normalised texts are equal.
    ``key`` maps a block to the number through which it is named.
    """
    norm = normalised(F.col(text))
    distinct = (
        docs.select(F.explode(_blocks(norm, block_bytes)).alias("block"))
        .withColumn("key", key(F.col("block")))
        .groupBy("key", "block")
        .agg(F.lit(1).alias("one"))
        .select("key", "block")
    )
    number = F.monotonically_increasing_id().alias("name")
    named = materialize(distinct.sortWithinPartitions("key", "block").select("key", number), "names")
    names = materialize(named.groupBy("key").agg(F.min("name").alias("name"), F.count("*").alias("n")), "keys")
    by_bytes = not names.where("n > 1").isEmpty()  # some key stands for several blocks
    held = _blocks(norm, block_bytes) if by_bytes else F.transform(_blocks(norm, block_bytes), lambda b: key(b))
    base = materialize(
        docs.select(
            held.alias("__held"), F.monotonically_increasing_id().alias("__rid"), *[c.alias(k) for k, c in carry.items()]
        ),
        "blocks",
    ).withColumn("n_blocks", F.size("__held"))
    on = "block" if by_bytes else "key"
    rows = base.select("__rid", "n_blocks", F.posexplode("__held").alias("pos", on))
    if by_bytes:
        names = _numbered(distinct.select("block"), ["block"], "blocknames")
    rows = materialize(rows.join(names, on).select("__rid", "n_blocks", "pos", "name"), "level")
    done = [rows.where("n_blocks = 1").select("__rid", "name")]
    longest, width = rows.agg(F.max("n_blocks")).first()[0] or 1, 1
    while width < longest:
        pairs = materialize(
            rows.where(f"n_blocks > {width}")
            .groupBy("__rid", "n_blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            ),
            "pairs",
        )
        both = _numbered(pairs.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"), ["a", "b"], "pairnames")
        width *= 2
        rows = materialize(pairs.join(both, ["a", "b"]).select("__rid", "n_blocks", "pos", "name"), "level")
        done.append(rows.where(f"n_blocks <= {width}").select("__rid", "name"))
        discard(pairs)
        discard(both)
    whole = done[0]
    for more in done[1:]:
        whole = whole.union(more)
    return base.drop("__held").join(whole, "__rid").drop("__rid")


def exact_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Groups of equal texts: ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row.

    Null texts count as empty. Of a group the row with the most code points in its original text
    stays, then that with the smallest id; a null id comes last and is kept only where its whole
    group has none. Rows that share an id are one document, so all of them carry the same ``kept``.
    Other columns, whatever their names, are not read. An empty table gives an empty table.
    """
    carry = {
        "doc_id": F.col(doc_id).cast("long"),
        "__chars": F.length(F.coalesce(F.col(text), F.lit(""))),
        "text_sha256": F.sha2(normalised(F.col(text)).cast("binary"), 256),
    }
    named = materialize(name_texts(docs, text, carry, block_bytes), "named")
    best = F.min(F.struct(-F.col("__chars"), F.col("doc_id").isNull(), F.col("doc_id")))
    groups = materialize(
        named.groupBy("n_blocks", "name").agg(F.count("*").alias("group_size"), best.alias("best")), "groups"
    )
    out = named.join(groups, ["n_blocks", "name"])
    keep = F.col("best.doc_id")
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of equal texts, with all its columns.

    It is a row with the most code points and, of these, the smallest id, as in :func:`exact_duplicates`; of rows
    that share both, and of rows without an id, one stays. Rows are told apart by number, so that a row
    goes only for its own text.
    """
    docs = numbered_rows(docs, "exactrows")
    carry = {"row": F.col("__row"), "id": F.col(doc_id).cast("long"), "chars": F.length(F.coalesce(F.col(text), F.lit("")))}
    named = materialize(name_texts(docs, text, carry), "named")
    best = F.min(F.struct(-F.col("chars"), F.col("id").isNull(), F.col("id"), F.col("row"))).alias("best")
    copied = named.groupBy("n_blocks", "name").agg(best, F.count("*").alias("n")).where("n > 1")
    gone = named.join(copied, ["n_blocks", "name"]).where("row <> best.row").select(F.col("row").alias("__row"))
    gone = materialize(gone, "gone")
    discard(named)
    return docs.join(gone, "__row", "left_anti").drop("__row")
