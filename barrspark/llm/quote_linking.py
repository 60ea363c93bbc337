"""Chat formatting by quotation linking.

Each message's quote levels are parsed (``>`` marks, nested); its own text is what stands at level
zero. Quoted passages, which are runs of lines of one level, are normalised and hashed; so are the paragraphs and the
whole of every message's own text. Passages are joined to the messages that first said them: in the same conversation,
before the quoting message, and else anywhere. Where nobody said the whole passage, its paragraphs are looked up instead, and
the lines of each paragraph that nobody said; the passage has the links of these parts. A message replies to the nearest such message of its
conversation, and a conversation is ordered by thread and turn.

Originals are grouped by hash before the join, so that a passage that everybody quotes or says is one row there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barrspark.llm.common import discard, materialize

_MARKS = re.compile(r"(?:[ \t]*>)+[ \t]?")
_SAID = re.compile(r"[^\n]{0,300}(?:wrote|writes|schrieb|écrit|escribió)[ \t]*:[ \t]*$")
_SPACE = re.compile(r"\s+")


def quote_levels(text: str) -> list[tuple[int, str]]:
    """Level and text of each line."""
    out = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        out.append((m.group().count(">"), line[m.end() :]) if m else (0, line))
    return out


def normalise(passage: str) -> str:
    """Case and white space do not tell passages apart."""
    return _SPACE.sub(" ", passage).strip().lower()


def _digest(passage: str) -> bytes:
    return hashlib.sha256(passage.encode("utf-8", "surrogatepass")).digest()


def quoted_parts(run: list[str]) -> list[tuple[int, int, str]]:
    """Paragraph, line and text (normalised) of a passage and its parts.

    The whole passage has paragraph and line -1, a paragraph of several has line -1. What equals the whole is not repeated.
    """
    paragraphs: list[list[str]] = [[]]
    for said in map(normalise, run):
        if said:
            paragraphs[-1].append(said)
        elif paragraphs[-1]:
            paragraphs.append([])
    paragraphs = [x for x in paragraphs if x]
    out = [(-1, -1, " ".join(map(" ".join, paragraphs)))]
    for k, lines in enumerate(paragraphs):
        if len(paragraphs) > 1:
            out.append((k, -1, " ".join(lines)))
        if len(lines) > 1:
            out += [(k, i, x) for i, x in enumerate(lines)]
    return out


def parse_message(text: str | None) -> tuple[str, list[tuple[int, str]], list[str]]:
    """Own text, quoted passages (level, normalised), and what of its own can be quoted (normalised).

    A line that only announces a quotation ("X wrote:") before a quoted line is no own text.
    """
    body, passages, units, _ = _parse_with_runs(text)
    return body, passages, units


def _parse_with_runs(text: str | None) -> tuple[str, list[tuple[int, str]], list[str], list[list[str]]]:
    """What :func:`parse_message` gives, and the lines of each passage."""
    lines = quote_levels(text or "")
    own, passages, runs, run, level = [], [], [], [], 0

    def close() -> None:
        if level and (said := normalise(" ".join(run))):
            passages.append((level, said))
            runs.append(run)

    for i, (depth, line) in enumerate(lines):
        if depth != level:
            close()
            run, level = [], depth
        run.append(line)
        announces = depth == 0 and i + 1 < len(lines) and lines[i + 1][0] > 0 and _SAID.match(line)
        if depth == 0 and not announces:
            own.append(line)
    close()
    body = "\n".join(own)
    if passages:
        body = re.sub(r"\n{3,}", "\n\n", body).strip("\n")
    units = [normalise(body), *map(normalise, body.split("\n")), *map(normalise, re.split(r"\n\s*\n", body))]
    return body, passages, [u for u in dict.fromkeys(units) if u], runs


_PARSED = "conv_id long, turn long, role string, text string, n_levels long, levels array<int>, passages array<binary>, units array<binary>, \
part_of array<int>, paragraphs array<int>, lines array<int>, parts array<binary>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: tuple[list, ...] = ([], [], [], [], [], [], [], [], [])
        for x in b.column(3):
            body, passages, units, runs = _parse_with_runs(x.as_py())
            parts = [(k, *part) for k, run in enumerate(runs) for part in quoted_parts(run)]
            row = (body, max((d for d, _ in passages), default=0), [d for d, _ in passages], [_digest(p) for _, p in passages], [_digest(u) for u in units])
            row += (*([part[i] for part in parts] for i in range(3)), [_digest(part[3]) for part in parts])
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        types = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()), *[pa.list_(pa.int32())] * 3, pa.list_(pa.binary())]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [c.split()[0] for c in _PARSED.split(", ")])


def parse_messages(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    read = messages.select(F.col(conv_id).cast("long"), F.col(turn).cast("long"), F.col(role).cast("string"), F.col(text).cast("string"))
    return read.mapInArrow(_parse, _PARSED)


def _joined_parts(found: DataFrame, keys: list[str], whole: str) -> DataFrame:
    """``own`` and ``there`` for each group: those of the row that stands for the whole, where it has any, else those of its parts."""
    head = F.expr(whole)
    both = found.groupBy(*keys).agg(
        *[F.max(F.when(is_, F.col("own"))).alias(f"own{k}") for k, is_ in enumerate((head, ~head))],
        *[F.min(F.when(is_, F.col("there"))).alias(f"there{k}") for k, is_ in enumerate((head, ~head))],
    )
    found_whole = F.col("own0").isNotNull() | F.col("there0").isNotNull()
    return both.select(*keys, *[F.when(found_whole, F.col(f"{c}0")).otherwise(F.col(f"{c}1")).alias(c) for c in ("own", "there")])


def link_quotes(parsed: DataFrame) -> DataFrame:
    """``mid, level, passage, from_conv, from_turn, own_turn``: each quoted passage of each message with its original, if found.

    ``parsed`` has a message number ``mid``. Only passages and parts that are quoted somewhere are looked up. Of several parts'
    originals the latest of the own conversation counts, and without one the first elsewhere.
    """
    quoted = parsed.select("mid", "conv_id", "turn", F.explode(F.arrays_zip("part_of", "paragraphs", "lines", "parts")).alias("q"))
    quoted = quoted.select("mid", "conv_id", "turn", F.col("q.part_of").alias("k"), F.col("q.paragraphs").alias("p"), F.col("q.lines").alias("l"), F.col("q.parts").alias("passage"))
    quoted = materialize(quoted, "quoted")
    wanted = materialize(quoted.select("passage").distinct(), "wanted")
    said = parsed.select("conv_id", "turn", F.explode("units").alias("passage")).where("conv_id is not null and turn is not null")
    said = said.join(wanted, "passage", "left_semi").groupBy("passage", "conv_id").agg(F.min("turn").alias("t"))
    said = materialize(said, "said")
    here = quoted.join(said, ["passage", "conv_id"], "left").withColumn("own", F.when(F.col("t") < F.col("turn"), F.col("t")))
    # the two smallest conversations: one of them is not the quoting one
    ranked = said.withColumn("r", F.row_number().over(Window.partitionBy("passage").orderBy("conv_id"))).where("r <= 2")
    at = F.struct("conv_id", "t")
    two = materialize(ranked.groupBy("passage").agg(F.min(at).alias("first"), F.max(at).alias("second")), "firstsaid")
    both = here.join(two, "passage", "left")
    elsewhere = F.coalesce(*[F.when(~F.col(f"{c}.conv_id").eqNullSafe(F.col("conv_id")), F.col(c)) for c in ("first", "second")])
    found = both.select("mid", "k", "p", "l", "own", F.when(F.col("own").isNull(), elsewhere).alias("there"))
    linked = _joined_parts(_joined_parts(found, ["mid", "k", "p"], "l = -1"), ["mid", "k"], "p = -1")
    passages = parsed.select("mid", "conv_id", F.posexplode(F.arrays_zip("levels", "passages")).alias("k", "q"))
    return passages.join(linked, ["mid", "k"]).select(
        "mid",
        F.col("q.levels").alias("level"),
        F.col("q.passages").alias("passage"),
        F.when(F.col("own").isNotNull(), F.col("conv_id")).otherwise(F.col("there.conv_id")).alias("from_conv"),
        F.coalesce("own", "there.t").alias("from_turn"),
        F.col("own").alias("own_turn"),
    )


def conversations(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages without quotes, with what they reply to; one row per input row.

    ``conv_id, turn, role, text, n_levels, n_passages, n_linked, reply_to, root_turn``: ``reply_to`` is the latest
    turn of the conversation that a passage of this message comes from (null: none), ``root_turn`` the turn at which its
    thread starts. (``conv_id``, ``root_turn``, ``turn``) is the reply order: no message comes before what it answers.

    A null text is empty. Rows without conversation or turn link to nothing and nothing links to them. Rows that repeat a
    conversation and turn share one place. Empty lines quote nothing; other columns are not read.
    """
    parsed = materialize(parse_messages(messages, conv_id, turn, role, text).withColumn("mid", F.monotonically_increasing_id()), "parsed")
    links = materialize(link_quotes(parsed), "quotelinks")
    by_message = links.groupBy("mid").agg(F.count("from_turn").alias("n_linked"), F.max("own_turn").alias("reply_to"))
    replies = materialize(parsed.select("mid", "conv_id", "turn").join(by_message, "mid").where("reply_to is not null"), "replies")
    roots = thread_roots(replies.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("up")))
    rows = parsed.join(by_message, "mid", "left").join(roots, ["conv_id", "turn"], "left")
    return rows.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "n_levels",
        F.size("passages").cast("long").alias("n_passages"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_to",
        F.coalesce("root_turn", "turn").alias("root_turn"),
    )


def thread_roots(up: DataFrame) -> DataFrame:
    """``conv_id, turn, root_turn`` from parents (``up`` < ``turn``), by doubling the way up each round."""
    now = materialize(up.select("conv_id", "turn", "up"), "up")
    while True:
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("higher"))
        after = materialize(now.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("higher", "up").alias("up"), "higher"), "up")
        discard(now)
        now = after.select("conv_id", "turn", "up")
        now._barrspark_path = after._barrspark_path
        if after.where("higher is not null").isEmpty():
            return now.withColumnRenamed("up", "root_turn")
