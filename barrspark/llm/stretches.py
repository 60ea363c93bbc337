"""Stretches of texts, cut and told apart in numpy on their UTF-8 bytes.

A stretch starts at a text's start and at every space between two characters that certainly are no white space, where
a piece of byte-level BPE starts too. It holds that space, so that equal stretches have equal pieces wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of texts that are cut at a time; a longer text is cut alone.
BLOCK_BYTES = 2 << 20
#: Stretches up to so many bytes are compared as three numbers.
_SHORT, _WORD = 24, 8
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(_WORD + 1)], np.uint64)
_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes that start a character other than white space (that of several bytes starts with C2 or E1 to E3).
_STARTS = _bytes_in((0x21, 0x7E), (0xC3, 0xE0), (0xE4, 0xFF))
_GRAPHIC, _TWO, _TAIL, _MAYBE = _bytes_in((0x21, 0x7E)), _bytes_in((0xC3, 0xDF)), _bytes_in((0x80, 0xBF)), _bytes_in((0xE1, 0xE3))


def _cuts(block: np.ndarray) -> np.ndarray:
    """Places of the spaces at which a stretch starts."""
    at = np.flatnonzero(block[1:-1] == 0x20) + 1
    at = at[_STARTS[block[at + 1]]]
    before = [block[np.maximum(at - k, 0)] for k in (1, 2, 3)]
    ends = _GRAPHIC[before[0]] | _TWO[before[1]] | (_TAIL[before[0]] & _TAIL[before[1]] & ~_MAYBE[before[2]])
    return at[ends & (before[0] > 0x20)]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of a column's texts: their bytes (with ``_SHORT`` more), starts and lengths of stretches, stretches by text.

    Null texts are empty and have no stretch.
    """
    column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + size, "right")) - 1)
        block = np.concatenate([data[edges[i] : edges[j]], np.zeros(_SHORT, np.uint8)])
        ends = edges[i : j + 1] - edges[i]
        is_start = np.zeros(int(ends[-1]) + 1, bool)
        is_start[_cuts(block[: ends[-1]])] = True
        is_start[ends] = True  # an empty text starts where the next does
        starts = np.flatnonzero(is_start[:-1])
        lengths = np.diff(starts, append=ends[-1])
        yield block, starts, lengths, np.diff(np.searchsorted(starts, ends))
        i = j


def _keys(numbers: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
    key = lengths.astype(np.uint64)
    for x, k in zip(numbers, _MIX, strict=True):
        key = (key ^ x) * k
        key ^= key >> np.uint64(31)
    return key


def distinct(block: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One stretch of each kind, and for each stretch the place of its kind among these.

    Stretches of equal key are compared in full, and told apart one by one if they differ.
    """
    view = np.ndarray((len(block) - _WORD + 1,), "<u8", np.ascontiguousarray(block), strides=(1,))
    numbers = [view[starts] & _MASKS[np.minimum(lengths, _WORD)]]
    for at in range(_WORD, _SHORT, _WORD):
        more, x = np.flatnonzero(lengths > at), np.zeros(len(starts), np.uint64)
        x[more] = view[starts[more] + at] & _MASKS[np.minimum(lengths[more] - at, _WORD)]
        numbers.append(x)
    key, long = _keys(numbers, lengths), np.flatnonzero(lengths > _SHORT)
    whole = {i: block[starts[i] : starts[i] + lengths[i]].tobytes() for i in long.tolist()}
    key[long] = np.fromiter(map(xxhash.xxh64_intdigest, whole.values()), np.uint64, len(long))
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    first = order[new]
    like = first[kind]
    same = lengths == lengths[like]
    for x in numbers:
        same &= x == x[like]
    same[long] &= np.fromiter((b == whole.get(j) for b, j in zip(whole.values(), like[long].tolist(), strict=True)), bool, len(long))
    if same.all():
        return first, kind
    others: dict[bytes, int] = {}
    more = []
    for i in np.flatnonzero(~same).tolist():
        b = block[starts[i] : starts[i] + lengths[i]].tobytes()
        if b not in others:
            others[b] = len(first) + len(more)
            more.append(i)
        kind[i] = others[b]
    return np.concatenate([first, more]), kind


def texts_of(block: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[bytes]:
    raw = block.tobytes()
    return (raw[s:e] for s, e in zip(starts.tolist(), (starts + lengths).tolist(), strict=True))


class Numbers:
    """The distinct stretches of several blocks, numbered as they come."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, block: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        first, kind = distinct(block, starts, lengths)
        known = self.known
        mine = (known.setdefault(x, len(known)) for x in texts_of(block, starts[first], lengths[first]))
        return np.fromiter(mine, np.uint32, len(first))[kind]
