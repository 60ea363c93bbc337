"""Byte-level BPE encoding and decoding with given ranks.

Distinct words (pre-token pieces) are encoded by a Spark higher-order function that folds ranked
merges over the ids of their bytes, with the ranks in a literal map. Spark searches a map from end to
end, so the literal is an array of small maps, chosen by both ids. The fold's state holds each id with its place and the
rank of its pair with the next, so that a step looks two pairs up and goes through the ids by lambda once. A word comes as its first state.

The most frequent pieces of the corpus, counted over all of it, are folded once and broadcast as a
dictionary of flat sorted arrays, made in one task, whose number and length of pieces are bounded. Every other piece goes through the
same fold once for each group of documents (``GROUP_BYTES`` of text in one task): documents stay where they are, and only the counted
stretches are shuffled, each distinct one of a task once. Only pieces over ``FOLD_BYTES``, for which a fold would take quadratic
time, are merged with a heap. Decoding concatenates the binary pieces of ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barrspark.llm.common import discard, give_back, materialize, small_batches
from barrspark.llm.stretches import BLOCK_BYTES, Numbers, blocks, distinct, texts_of

#: Bounds on the broadcast dictionary.
MAX_PIECES, MAX_PIECE_BYTES = 400_000, 32
#: Pieces above this many bytes are merged with a heap.
FOLD_BYTES = 256
#: Ids and places take so many bits; the literal rank map has ``_BUCKETS`` maps, a prime.
_BITS, _BUCKETS = 20, 32749
_ID = (1 << _BITS) - 1
#: Bytes of the documents whose distinct pieces are folded together; a longer document is a group of its own.
GROUP_BYTES = 3_000_000
#: Words of a row that is folded, a bound on its size.
_ROW_WORDS = 10_000
#: Stretches that a task counts at most before it passes the counts on.
_COUNTED = 200_000
#: A single mark after letters is a piece of its own.
_MARKS = frozenset(".,;:!?")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 tokens and ranks, one a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pieces_of(stretch: str, find) -> list[str]:
    """Pieces of a stretch, which mostly is letters, or letters and a mark."""
    body = stretch[1:] if stretch[:1] == " " else stretch
    if body.isalpha():
        return [stretch]
    if body[-1:] in _MARKS and body[:-1].isalpha():
        return [stretch[:-1], stretch[-1]]
    return find(stretch)


def rank_literal(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The literal rank map: a pair of token ids, as one number, to the id (and rank) of both joined.

    It is the constant of a scalar subquery over a table of one row: a literal written out in the plan would be printed
    with every plan, in strings of many megabytes on the driver.
    """
    if max(ranks.values(), default=0) >= _ID:
        raise ValueError(f"ids must be below {_ID}")

    def maps(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict[int, int]] = [{} for _ in range(_BUCKETS)]
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    out[(a << _BITS | b) % _BUCKETS][a << _BITS | b] = rank
        kind = pa.list_(pa.map_(pa.int64(), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([[list(x.items()) for x in out]], kind)], ["ranks"])

    return materialize(spark.range(0, 1, 1, 1).mapInArrow(maps, "ranks array<map<bigint,bigint>>"), "ranks").scalar()


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def first_states(words: list[bytes], single: np.ndarray, pairs: np.ndarray) -> pa.ListArray:
    """What the fold starts with: for each byte of a word its id, above it its place, on top the rank of its pair with the next."""
    edges, letters = _offsets([len(x) for x in words]), np.frombuffer(b"".join(words), np.uint8)
    ranks = np.full(len(letters), _ID, np.int64)
    ranks[:-1] = pairs[letters[:-1].astype(np.int64) << 8 | letters[1:]]
    ranks[edges[1:][np.diff(edges) > 0] - 1] = _ID  # the last of a word has no pair
    places = np.arange(len(letters)) - np.repeat(edges[:-1], np.diff(edges))
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ranks << 2 * _BITS | places << _BITS | single[letters], pa.int64()))


def fold_merges(words: Column, ranks: Column) -> Column:
    """Last states of each of an array of words, which are :func:`first_states`; their low bits are the ids.

    Each step joins the adjacent pair of lowest rank, leftmost first; a state without a known pair stays as it is.
    """
    return _let(ranks, lambda table: F.transform(words, lambda word: _fold(word, table)))


def _fold(word: Column, table: Column) -> Column:
    """The least number of a state is the leftmost pair of lowest rank, and no two are equal, so array functions find them.

    Spark interprets lambdas, and bit operations are its quickest arithmetic there.
    """
    none = _ID << 2 * _BITS

    def rank_of(pair: Column) -> Column:
        """The rank of two ids, as one number, where a state has it."""
        found = F.try_element_at(F.get(table, F.pmod(pair, _long(_BUCKETS))), pair)
        return F.coalesce(F.shiftleft(found, 2 * _BITS), _long(none))

    def joined(p: Column, best: Column, i: Column) -> Column:
        """``best``, the ``i``-th from 1 on, with the next as one id; the one before gets the rank of its new pair."""
        both = F.shiftright(best, 2 * _BITS)
        after = F.shiftright(best, _BITS).bitwiseAND(_long(_ID << _BITS)).bitwiseOR(F.get(p, i + 1).bitwiseAND(_long(_ID)))
        new = rank_of(after).bitwiseOR(best.bitwiseAND(_long(_ID << _BITS))).bitwiseOR(both)

        def turned(x: Column) -> Column:
            return rank_of(F.shiftleft(x.bitwiseAND(_long(_ID)), _BITS).bitwiseOR(both)).bitwiseOR(x.bitwiseAND(_long((1 << 2 * _BITS) - 1)))

        rest, none_before = F.array_remove(p, F.get(p, i)), _long(-1)

        def put(now: Column, x: Column, then: Column) -> Column:
            return F.transform(rest, lambda e: F.when(e == best, now).otherwise(F.when(e == x, then).otherwise(e)))

        before = F.when(i == 1, none_before).otherwise(F.get(p, i - 2))
        return _let(new, lambda now: _let(before, lambda x: _let(turned(x), lambda then: put(now, x, then))))

    def step(p: Column, _: Column) -> Column:
        at = lambda best: _let(F.array_position(p, best).cast("int"), lambda i: joined(p, best, i))
        return F.when(F.array_min(p) >= _long(none), p).otherwise(_let(F.array_min(p), at))

    # a word has fewer pairs than bytes
    return F.aggregate(word, word, step)


def merge_with_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long piece, in O(n log n)."""
    n = len(piece)
    end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or end[nxt[i]] != stop:
            continue
        j = nxt[i]
        alive[j], end[i], nxt[i] = False, end[j], nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prv[i] >= 0 and (r := ranks.get(piece[prv[i] : end[i]])) is not None:
            heapq.heappush(heap, (r, prv[i], end[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


def piece_counts(texts: DataFrame, pattern: str) -> DataFrame:
    """``piece`` (binary) and ``n`` over the whole column ``text``.

    Stretches are counted first, so that each distinct one is cut into pieces once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["stretch", "n"])
            seen.clear()
            return out

        for b in batches:
            for block, starts, lengths, _ in blocks(b.column(0)):
                first, kind = distinct(block, starts, lengths)
                times = np.bincount(kind, minlength=len(first)).tolist()
                for x, n in zip(texts_of(block, starts[first], lengths[first]), times, strict=True):
                    seen[x] = seen.get(x, 0) + n
                if len(seen) > _COUNTED:
                    yield flush()
        yield flush()
        give_back()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        for b in batches:
            pieces: dict[str, int] = {}
            for stretch, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for p in pieces_of(stretch.decode(), find):
                    pieces[p] = pieces.get(p, 0) + n
            columns = [pa.array([p.encode() for p in pieces], pa.binary()), pa.array(list(pieces.values()), pa.int64())]
            del pieces
            yield pa.RecordBatch.from_arrays(columns, ["piece", "n"])
            give_back()

    stretches = texts.mapInArrow(count, "stretch binary, n long").groupBy("stretch").agg(F.sum("n").alias("n"))
    return stretches.mapInArrow(cut, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """Pieces above a count that at most ``most`` pieces reach, found on a bounded histogram."""
    short = counts.where(F.length("piece") <= MAX_PIECE_BYTES)
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    bars = short.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for bar in bars:
        total += bar["n"]
        if total > most:
            break
        least = bar["level"]
    return short.where(level >= least) if least is not None else short.limit(0)


def _single_bytes(ranks: dict[bytes, int]) -> np.ndarray:
    return np.array([ranks[bytes([x])] for x in range(256)], np.int32)


def _byte_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """The rank of each pair of bytes, at 256 times the first and the second."""
    out = np.full(1 << 16, _ID, np.int64)
    for token, rank in ranks.items():
        if len(token) == 2:
            out[token[0] << 8 | token[1]] = rank
    return out


def _byte_ids(single: np.ndarray, pairs: np.ndarray):
    """Rows of many pieces, with the first state of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = first_states(b.column(0).to_pylist(), single, pairs)
            rows = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), x) for x in (b.column(0), words)]
            yield pa.RecordBatch.from_arrays(rows, ["pieces", "words"])

    return run


def _with_ids(rows: DataFrame, ranks: Column) -> DataFrame:
    """The column ``words`` folded. Lambdas take no subquery, so the ranks are a column first."""
    folded = rows.withColumn("__ranks", ranks).withColumn("words", fold_merges(F.col("words"), F.col("__ranks")))
    return folded.drop("__ranks")


def _offsets(lengths) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all elements of stretches of an array, one after the other."""
    return np.repeat(starts - _offsets(lengths)[:-1], lengths) + np.arange(int(lengths.sum()))


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: hashes of all words in order, bytes and edges of the words, ids and edges of these."""
    words, ids, sizes = [], [], []
    for b in batches:
        words += b.column(0).flatten().to_pylist()
        folded = b.column(1).flatten()
        sizes.append(folded.value_lengths().to_numpy(zero_copy_only=False))
        ids.append((folded.flatten().to_numpy(zero_copy_only=False) & _ID).astype(np.int32))
    keys = _hashes(words)
    order = np.argsort(keys, kind="stable")
    sizes, ids = np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0, np.int32), *ids])
    ids = ids[_ragged(_offsets(sizes)[order], sizes[order])]
    words = [words[i] for i in order.tolist()]
    row = [keys[order], b"".join(words), _offsets([len(x) for x in words]).astype(np.int32), ids, _offsets(sizes[order]).astype(np.int32)]
    yield pa.RecordBatch.from_arrays([pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in row], _FLAT)


_FLAT = ["hashes", "words", "edges", "ids", "id_edges"]


class Dictionary:
    """Words and their ids as flat arrays, in the order of the words' hashes; of words of equal hash only the first is found."""

    def __init__(self, hashes: bytes, words: bytes, edges: bytes, ids: bytes, id_edges: bytes):
        self.keys, self.text = np.frombuffer(hashes, np.uint64), bytes(words)
        self.edges, self.ids, self.id_edges = (np.frombuffer(x, np.int32) for x in (edges, ids, id_edges))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's place, or -1; equal hashes count only if the bytes are equal."""
        keys = _hashes(words)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return out
        hits = np.flatnonzero(self.keys[at] == keys)
        starts, ends = self.edges[at[hits]].tolist(), self.edges[at[hits] + 1].tolist()
        same = np.fromiter((self.text[i:j] == words[k] for i, j, k in zip(starts, ends, hits.tolist(), strict=True)), bool, len(hits))
        out[hits[same]] = at[hits[same]]
        return out


#: Rows of a group of documents: words to fold, and in its last row: ids, numbers of stretches, pieces by stretch and in all,
#: the place of each piece among first the given, then the folded words, lengths and ids of the given words. The last two
#: columns are the group's number and the row's number in it.
_GROUP = "docs array<bigint>, numbers array<binary>, per binary, pieces binary, slots binary, sizes binary, given binary, words array<array<bigint>>, grp long, part long"


def _group(pattern: str, known, ranks, size: int, row_words: int):
    """Groups of documents with the ids of their known pieces and the first states of the distinct other pieces."""
    names = [x.split()[0] for x in _GROUP.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, by_rank = regex.compile(pattern).findall, ranks.value
        single, pairs, table = _single_bytes(by_rank), _byte_pairs(by_rank), known.value
        group = itertools.count(TaskContext.get().partitionId() << 33)

        def rows(others: list[bytes], last: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            mine = next(group)
            for at in range(0, max(1, len(others)), row_words):
                part = others[at : at + row_words]
                words = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), first_states(part, single, pairs))
                ends = at + row_words >= len(others)
                place = [pa.array([x], pa.int64()) for x in (mine, at)]
                yield pa.RecordBatch.from_arrays([*(x if ends else pa.nulls(1, x.type) for x in last), words, *place], names)

        def flush(docs: list, numbers: list[bytes], stretches: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
            pieces: dict[str, int] = {}
            of, per = [], []
            for x in stretches:
                mine = pieces_of(x.decode(), find)
                per.append(len(mine))
                of += [pieces.setdefault(p, len(pieces)) for p in mine]
            words = [p.encode() for p in pieces]
            at = table.find(words)
            hits, long = np.flatnonzero(at >= 0), [i for i, w in enumerate(words) if len(w) > FOLD_BYTES]
            merged = [np.array(merge_with_heap(words[i], by_rank), np.int32) for i in long]
            starts = table.id_edges[at[hits]].astype(np.int64)
            sizes = table.id_edges[at[hits] + 1] - starts
            given = np.concatenate([table.ids[_ragged(starts, sizes)], *merged])
            sizes = np.concatenate([sizes, [len(m) for m in merged]])
            rest = np.ones(len(words), bool)
            rest[hits] = rest[long] = False
            rest = np.flatnonzero(rest)
            slots = np.empty(len(words), np.uint32)
            slots[np.concatenate([hits, np.array(long, np.int64), rest])] = np.arange(len(words))
            flat = [np.array(x, np.uint32) for x in (per, of, slots, sizes)] + [given.astype(np.int32)]
            last = [pa.array([docs], pa.list_(pa.int64())), pa.array([numbers], pa.list_(pa.binary())), *(pa.array([x.tobytes()], pa.binary()) for x in flat)]
            return rows([words[i] for i in rest.tolist()], last)

        docs, numbers, held, seen = [], [], 0, Numbers()
        for b in batches:
            ids, i = b.column(0).to_pylist(), 0
            for block, starts, lengths, per in blocks(b.column(1), min(size, BLOCK_BYTES)):
                mine, ends = seen.of(block, starts, lengths), np.cumsum(per).tolist()
                numbers += [mine[s:e].tobytes() for s, e in zip([0, *ends], ends, strict=False)]
                docs += ids[i : i + len(per)]
                i, held = i + len(per), held + len(block)
                if held >= size:
                    yield from flush(docs, numbers, seen.known)
                    docs, numbers, held, seen = [], [], 0, Numbers()
                    give_back()
        if docs:
            yield from flush(docs, numbers, seen.known)
        del docs, numbers, seen
        give_back()

    return run


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each document and the ids of its text, from a group's given and folded words."""
    sizes_, ids_ = [], []
    for b in batches:
        for k in range(b.num_rows):
            words = b.column(7)[k].values
            sizes_.append(words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            ids_.append((words.flatten().to_numpy(zero_copy_only=False) & _ID).astype("<u4"))
            if not b.column(0)[k].is_valid:
                continue
            per, of, slots, sizes, given = (np.frombuffer(b.column(i)[k].as_py(), "<u4") for i in range(2, 7))
            lengths, ids = np.concatenate([sizes.astype(np.int64), *sizes_]), np.concatenate([given, *ids_])
            sizes_, ids_ = [], []
            starts = _offsets(lengths)[:-1]
            lengths, starts = lengths[slots[of]], starts[slots[of]]
            ids, ends = ids[_ragged(starts, lengths)], _offsets(lengths)  # the ids of all stretches, one after the other
            edges = ends[_offsets(per)]
            starts, lengths = edges[:-1], np.diff(edges)
            for doc, numbers in zip(b.column(0)[k].as_py(), b.column(1)[k].values, strict=True):
                at = np.frombuffer(numbers.as_buffer(), "<u4")
                yield doc, ids[_ragged(starts[at], lengths[at])]
        del b
        give_back()


def _folded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str, doc_id: str, max_pieces: int, apart: bool) -> DataFrame:
    """Groups of documents, with the ids that the fold gives their other pieces.

    Rows of a group follow each other. ``apart`` shuffles the groups, so that the step after this one runs in a stage, and in
    Python workers, of its own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    table = rank_literal(spark, ranks)
    counts = materialize(piece_counts(texts.select("text"), pattern), "pieces")
    frequent = _frequent(counts, max_pieces).select("piece").repartition(max(1, spark.sparkContext.defaultParallelism))
    words = frequent.mapInArrow(_byte_ids(_single_bytes(ranks), _byte_pairs(ranks)), "pieces array<binary>, words array<array<bigint>>")
    found = materialize(_with_ids(words, table), "dictionary")
    # the dictionary's size is bounded, so one task lays it out
    row = found.coalesce(1).mapInArrow(_flat, ", ".join(f"{c} binary" for c in _FLAT)).first()
    known = spark.sparkContext.broadcast(Dictionary(*row))
    del row
    discard(counts)
    discard(found)
    give_back()
    by_rank = spark.sparkContext.broadcast(ranks)
    groups = _with_ids(texts.mapInArrow(_group(pattern, known, by_rank, GROUP_BYTES, _ROW_WORDS), _GROUP), table)
    return groups.repartition("grp").sortWithinPartitions("grp", "part") if apart else groups


def _some(items: Iterator, most: int = 256) -> Iterator[list]:
    while some := list(itertools.islice(items, most)):
        yield some


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    text: str = "text",
    doc_id: str = "doc_id",
    max_pieces: int = MAX_PIECES,
    apart: bool = False,
) -> DataFrame:
    """``doc_id`` and ``ids``: little-endian unsigned 32-bit ids as one binary, for every row.

    Null and empty texts have no ids. Repeated rows are repeated in the result; ids may be null; other columns are
    not read. ``ranks`` must hold all single bytes, as byte-level vocabularies do. With ``apart``, texts are cut and put
    together in two stages with a shuffle of about the input's size between them, which takes half as many Python workers at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _some(_put_together(batches)):
            columns = [pa.array([i for i, _ in rows], pa.int64()), pa.array([x.tobytes() for _, x in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids"])

    return _folded(docs, ranks, pattern, text, doc_id, max_pieces, apart).mapInArrow(run, "doc_id long, ids binary")


def decode_bytes(ids: bytes, pieces: list[bytes]) -> bytes:
    """The bytes of packed ids: their pieces, concatenated."""
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def piece_table(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``doc_id, ids, decoded`` (binary) from the result of :func:`encode`; null ids decode to nothing."""
    pieces = encoded.sparkSession.sparkContext.broadcast(piece_table(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [decode_bytes(x.as_py() or b"", pieces.value) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def encode_and_check(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    text: str = "text",
    doc_id: str = "doc_id",
    keep_ids: bool = False,
    max_pieces: int = MAX_PIECES,
    apart: bool = False,
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, and ``ids`` if kept: :func:`encode` and :func:`decode` in one pass.

    The digests are those of the packed ids and of the bytes that these decode to.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(piece_table(ranks))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _some(_put_together(batches)):
            ids = [x.tobytes() for _, x in rows]
            sha = [hashlib.sha256(x).hexdigest() for x in ids]
            back = [hashlib.sha256(decode_bytes(x, pieces.value)).hexdigest() for x in ids]
            columns = [pa.array([i for i, _ in rows], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            columns += [pa.array(ids, pa.binary())] * keep_ids
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return _folded(docs, ranks, pattern, text, doc_id, max_pieces, apart).mapInArrow(run, schema)
