"""Personal data by a skip-chain conditional random field.

Patterns find the base spans of four kinds. The field then labels the tokens of every document that hold a digit
or ``@`` with a kind, a secret (a key or pass phrase), or none: neighbours share chain potentials, and distant tokens that repeat or resemble one
another (same lower-cased address or local part, same last seven digits) share skip potentials. Tokens of base spans are
observed, and so are secrets to which a name such as ``token`` or ``password`` is assigned; the others get their label from loopy
message passing over the document's whole graph. A token whose belief in a label is high is one more span, so that an entity found
once is found in all of its places, and one that looks like a secret without such a name is found by its form.

The potentials are trained by pieces (each kind of factor by its own likelihood, which counts solve) on all documents.
Consecutive repeats of one key train the skip factor. A token that is like an observed one but was not matched
itself is hidden, not none: it trains nothing, so that the field does not learn that patterns miss nothing. In a document, a repeat that is not observed is linked to
the nearest observed ones of its key on both sides, so that it is one link away however many repeats lie between; where no
repeat of a key is observed, all are linked to one hub of the key. Edges grow with the tokens either way.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Belief from which a token is a span.
BELIEF = 0.9
#: Bound on the message steps for each link of a graph's longest path; they stop as soon as messages stand still.
STEPS = 12
#: Messages that are computed together, a bound on memory.
_EDGES_AT_ONCE = 20_000
#: What is observed through its name, and the names, with a sign of assignment before the value.
SECRET, LABELS = len(KINDS), (*KINDS, "secret", "none")
_LABELS, _NONE = len(LABELS), len(LABELS) - 1
_NAMED = re.compile(
    r"""(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?[\x20\t]{0,3}[=:][\x20\t]{0,3}["']?([A-Za-z0-9_+/.-]{12,})""", re.IGNORECASE
)
_NAME_CHARS = 32
_HEX = re.compile(r"[0-9a-fA-F]+")
_WORDLIKE = re.compile(r"[A-Za-z0-9_+/.-]+")
_SHAPES = 512

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = "\"'`.,;:!?()[]{}<>"

Span = tuple[int, int, int]  # kind, start, end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the address pattern, from each ``@`` outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        # what stands left of a failed @ can't be part of a local part again
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind and start."""
    if not _ANY.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def _shape(token: str) -> int:
    """A bin for a token's form: digits, letters and marks in runs of bounded length; of many runs, only the alphabet and the length."""
    runs, last, n = [], "", 0
    if len(token) > 15 and not token.isdigit() and _WORDLIKE.fullmatch(token):
        runs.append(f"{'hex' if _HEX.fullmatch(token) else 'mixed'}{min(len(token) // 8, 12)}")
        token = ""
    for c in token[:64]:
        kind = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if kind == last:
            n += 1
            continue
        runs.append(f"{last}{min(n, 4)}")
        last, n = kind, 1
    runs.append(f"{last}{min(n, 4)}")
    return int.from_bytes(hashlib.blake2b("".join(runs).encode(), digest_size=4).digest(), "little") % _SHAPES


def _keys(token: str) -> list[str]:
    """What a token shares with others like it."""
    out, low = [], token.lower()
    d = _digits(token)
    if "@" in low:
        out.append(low)
        local = low.partition("@")[0]
        if len(local) >= 5:
            out.append(local)
    elif len(low) >= 5:
        out.append(low)
    if len(d) >= 7:
        out.append("#" + d[-7:])
    return out


class Graph:
    """Nodes (tokens with a digit or ``@``), their observed labels, chain and skip edges of a document."""

    def __init__(self, text: str, base: list[Span]):
        self.spans: list[tuple[int, int]] = []
        self.words: list[str] = []
        order = []
        secrets = []
        for m in _WORD.finditer(text):
            word, a = m.group(), m.start()
            if not _ANY.search(word):
                continue
            found = len(word) > 11 and _NAMED.search(text, max(0, a - _NAME_CHARS), m.end())
            if found and found.end(1) > a and _ANY.search(found.group(1)):
                secrets.append(len(self.words))
                word, a, left = found.group(1), found.start(1), 0
            else:
                left = len(word) - len(word.lstrip(_EDGES))
                word = word.strip(_EDGES)
            if word:
                self.spans.append((a + left, a + left + len(word)))
                self.words.append(word)
                order.append(a)
        self.seen = np.full(len(self.words), -1)
        self.seen[secrets] = SECRET
        starts = [a for a, _ in self.spans]
        for kind, a, b in sorted(base, key=lambda s: s[1]):
            i = bisect_right(starts, a) - 1
            for k in range(max(i, 0), len(starts)):
                if starts[k] >= b:
                    break
                if self.spans[k][1] > a:
                    self.seen[k] = kind
        ends = [s[1] for s in self.spans]
        # neighbours with at most two characters between them
        self.chain = [(i - 1, i) for i in range(1, len(order)) if starts[i] - ends[i - 1] <= 3]
        places: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            for key in dict.fromkeys(_keys(w)):
                places.setdefault(key, []).append(i)
        repeats, skip, self.hubs = set(), set(), []
        #: Tokens that are not observed but like one that is.
        self.hidden = np.zeros(len(self.words), bool)
        for at in places.values():
            if len(at) > 1 and (self.seen[at] >= 0).any():
                self.hidden[at] |= self.seen[at] < 0
            repeats.update(zip(at, at[1:]))
            if len(at) > 1:
                self._link(at, skip)
        self.repeats = sorted(repeats - set(self.chain))
        self.skip = sorted(skip)
        self.shapes = np.array([_shape(w) for w in self.words], np.int64)

    def _link(self, at: list[int], skip: set[tuple[int, int]]) -> None:
        """Links of one key's tokens: to observed ones, else of two to each other, of more to a hub (``hubs``)."""
        known = [i for i in at if self.seen[i] >= 0]
        if not known:
            if len(at) == 2:
                skip.add((at[0], at[1]))
            elif at not in self.hubs[-1:]:  # a token's keys often have the same places
                self.hubs.append(at)
            return
        before = 0
        for i in at:
            while before < len(known) and known[before] <= i:
                before += 1
            if self.seen[i] < 0:
                skip.update((min(i, j), max(i, j)) for j in known[max(before - 1, 0) : before + 1])


_UNARY, _CHAIN, _SKIP = 0, 1, 2


def factor_counts(docs: DataFrame, text: str) -> DataFrame:
    """``kind, a, b, n``: shape with label, and labels at both ends of chain and skip edges, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[int, int, int]] = Counter()
        for b in batches:
            for x in b.column(0):
                body = x.as_py() or ""
                if not _ANY.search(body):
                    continue
                g = Graph(body, base_spans(body))
                label, hidden = np.where(g.seen < 0, _NONE, g.seen).tolist(), g.hidden.tolist()
                seen.update((_UNARY, s, y) for s, y, h in zip(g.shapes.tolist(), label, hidden, strict=True) if not h)
                for kind, edges in ((_CHAIN, g.chain), (_SKIP, g.repeats)):
                    pairs = ((label[i], label[j]) for i, j in edges if not (hidden[i] or hidden[j]))
                    seen.update((kind, *(sorted(p) if kind == _SKIP else p)) for p in pairs)
        rows = [(*k, n) for k, n in seen.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32()] * 3 + [pa.int64()], strict=True)], ["kind", "a", "b", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "kind int, a int, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


class Potentials:
    """Log potentials of the pieces: ``unary[shape, label]``, ``chain[left, right]``, ``skip`` (symmetric)."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        unary, pair = np.zeros((_SHAPES, _LABELS)), np.zeros((2, _LABELS, _LABELS))
        for kind, a, b, n in rows:
            if kind == _UNARY:
                unary[a, b] = n
            else:
                pair[kind - 1, a, b] += n
        prior = unary.sum(0) + 1
        prior /= prior.sum()
        self.unary = np.log((unary + prior) / (unary.sum(1, keepdims=True) + 1))
        pair[1] = pair[1] + pair[1].T
        # skip edges favour equal labels before any is seen
        joint = pair + np.array([np.full((_LABELS, _LABELS), 0.2), np.eye(_LABELS) * 4 + 0.2])
        joint /= joint.sum((1, 2), keepdims=True)
        logs = np.log(joint) - np.log(joint.sum(2))[:, :, None] - np.log(joint.sum(1))[:, None, :]
        self.chain, self.skip = logs
        #: A hub's own labels: two skip links over a hub are then again a step between repeats.
        self.hub = np.log(joint[1].sum(1))


def train(docs: DataFrame, text: str = "text") -> Potentials:
    """Potentials from all rows; their table has a fixed size."""
    return Potentials([tuple(r) for r in factor_counts(docs, text).collect()])


def _longest_path(n: int, edges: list[tuple[int, int]]) -> int:
    """A bound on the links between any two connected nodes: twice the depth from one node of each component."""
    near: list[list[int]] = [[] for _ in range(n)]
    for i, j in edges:
        near[i].append(j)
        near[j].append(i)
    seen, most = [False] * n, 0
    for first in range(n):
        if seen[first]:
            continue
        seen[first], level, depth = True, [first], 0
        while level:
            after = []
            for i in level:
                for j in near[i]:
                    if not seen[j]:
                        seen[j] = True
                        after.append(j)
            level, depth = after, depth + bool(after)
        most = max(most, 2 * depth)
    return most


def beliefs(g: Graph, p: Potentials) -> np.ndarray:
    """Label probabilities of all nodes, by loopy sum-product message passing with damping.

    Messages pass until they stand still. The bound on the steps, for loops that never do, grows with the longest path.
    """
    n = len(g.words)
    unary = np.concatenate([p.unary[g.shapes], np.tile(p.hub, (len(g.hubs), 1))])
    known = np.flatnonzero(g.seen >= 0)
    unary[known] = -50.0
    unary[known, g.seen[known]] = 0.0
    kinds = dict.fromkeys(g.chain, 0)  # chain, skip or both
    for e in g.skip + [(i, n + h) for h, at in enumerate(g.hubs) for i in at]:
        kinds[e] = 2 if e in kinds else 1
    if kinds:
        edges, both = list(kinds), (p.chain, p.skip, p.chain + p.skip)
        tables = np.stack([*both, *[t.T for t in both]])
        src = np.array([i for i, _ in edges] + [j for _, j in edges])
        dst = np.array([j for _, j in edges] + [i for i, _ in edges])
        table = np.array(list(kinds.values()))
        table = np.concatenate([table, table + len(both)])
        m, half = np.zeros((len(src), _LABELS)), len(edges)
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        done, step, bound = False, 0, 2 * STEPS
        while not done and step < bound:
            into = np.zeros((len(unary), _LABELS))
            np.add.at(into, dst, m)
            s = (unary + into)[src] - m[back]
            new = np.empty_like(s)
            for at in range(0, len(s), _EDGES_AT_ONCE):
                c = slice(at, at + _EDGES_AT_ONCE)
                x = s[c, :, None] + tables[table[c]]
                top = x.max(1)
                new[c] = top + np.log(np.exp(x - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            done = np.abs(new - m).max() < 1e-4
            m = 0.5 * m + 0.5 * new
            step += 1
            if step == 2 * STEPS and not done:
                bound = STEPS * (1 + _longest_path(len(unary), edges))
        np.add.at(unary, dst, m)
    out = np.exp(unary - unary.max(1, keepdims=True))[:n]
    return out / out.sum(1, keepdims=True)


def find_spans(text: str, p: Potentials) -> tuple[list[Span], list[Span]]:
    """Base spans, and the spans that the field adds, none of which overlaps a base one."""
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    g = Graph(text, base)
    got = beliefs(g, p)
    got[(g.seen >= 0) & (g.seen < SECRET)] = 0
    best = got[:, :-1].argmax(1)
    more = [(int(best[i]), *g.spans[i]) for i in np.flatnonzero(got[np.arange(len(got)), best] >= BELIEF)]
    return base, more


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{LABELS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans``, one row per input row.

    ``n_added`` counts the spans beside the base ones, ``n_spans`` all. Null texts are empty; a document without spans has empty ``spans``. Positions count code points, ends are
    exclusive. Repeated rows are repeated in the result; ids may be null; other columns are not read.
    """
    spark = docs.sparkSession
    potentials = spark.sparkContext.broadcast(train(docs, text))
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long, n_spans long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1):
                base, more = find_spans(x.as_py() or "", potentials.value)
                n = Counter(k for k, _, _ in base)
                sha = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*(n[k] for k in range(len(KINDS))), sha, _joined(base + more), len(more), len(base) + len(more)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets, e.g. ``[email]``."""
    potentials = docs.sparkSession.sparkContext.broadcast(train(docs, text))

    def clean(body: str | None) -> str | None:
        if body is None:
            return None
        base, more = find_spans(body, potentials.value)
        out, at = [], 0
        for k, a, e in sorted(base + more, key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += (body[at:a], f"[{LABELS[k]}]")
            at = max(at, e)
        return "".join([*out, body[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text)
            yield b.set_column(i, b.schema.field(i), pa.array([clean(x.as_py()) for x in b.column(i)], b.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
