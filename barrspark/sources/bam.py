"""Alignments in BAM files, as a Python data source, from the public layout of the SAM specification.

A file is one partition, since the blocks of an unindexed file cannot be entered in the middle; a folder of files is read
in parallel. Blocks are inflated one at a time, so that memory is bounded by a block and a batch of rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barrspark.schema import READS_DDL

_BASES = "=ACMGRSVTWYHKDBN"
_SIZES = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def inflated(data: bytes) -> Iterator[bytes]:
    """Contents of the gzip members of a blocked file."""
    at = 0
    while at < len(data):
        d = zlib.decompressobj(31)
        yield d.decompress(data[at:])
        at = len(data) - len(d.unused_data)


class _Stream:
    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held = parts, b""

    def take(self, n: int) -> bytes | None:
        while len(self.held) < n:
            more = next(self.parts, None)
            if more is None:
                return None
            self.held += more
        out, self.held = self.held[:n], self.held[n:]
        return out


def tags_of(raw: bytes) -> dict[str, str]:
    """Text and numbers by tag; arrays are left out."""
    out, at = {}, 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            out[name] = raw[at:end].decode("utf-8", "replace")
            at = end + 1
        elif kind == "B":
            width = struct.calcsize(_SIZES[chr(raw[at])])
            at += 5 + width * struct.unpack_from("<I", raw, at + 1)[0]
        else:
            value = struct.unpack_from("<" + _SIZES[kind], raw, at)[0]
            out[name] = value.decode() if isinstance(value, bytes) else str(value)
            at += struct.calcsize(_SIZES[kind])
    return out


def aligned_pairs(pos: int, cigar: list[tuple[int, int]]) -> list[tuple[int | None, int, str]]:
    """(query position, reference position, kind) of each reference base covered; a base before an indel is its anchor."""
    out, q, r = [], 0, pos
    for op, n in cigar:
        if op in (0, 7, 8):
            out += [(q + i, r + i, "base") for i in range(n)]
            q, r = q + n, r + n
        elif op in (1, 2):
            if out and out[-1][2] == "base":
                out[-1] = (*out[-1][:2], "indel_anchor")
            if op == 1:
                q += n
            else:
                out += [(None, r + i, "del") for i in range(n)]
                r += n
        elif op == 3:
            out += [(None, r + i, "refskip") for i in range(n)]
            r += n
        elif op == 4:
            q += n
    return out


def records(data: bytes, tags: tuple[str, str, str, str] = ("CB", "GN", "UB", "TR")) -> Iterator[tuple]:
    """Rows of the schema of reads, but for the ordinal, which counts from 0."""
    s = _Stream(inflated(data))
    if s.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    s.take(struct.unpack("<i", s.take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", s.take(4))[0]):
        names.append(s.take(struct.unpack("<i", s.take(4))[0])[:-1].decode())
        s.take(4)
    k = 0
    while (head := s.take(4)) is not None:
        b = s.take(struct.unpack("<i", head)[0])
        ref, pos, l_name, mapq, _, n_cigar, flags, l_seq = struct.unpack_from("<iiBBHHHi", b)
        at = 32
        name = b[at : at + l_name - 1].decode()
        at += l_name
        cigar = [(c & 15, c >> 4) for c in struct.unpack_from(f"<{n_cigar}I", b, at)]
        at += 4 * n_cigar
        packed = b[at : at + (l_seq + 1) // 2]
        seq = "".join(_BASES[x >> 4] + _BASES[x & 15] for x in packed)[:l_seq]
        at += len(packed)
        quals = list(b[at : at + l_seq])
        found = tags_of(b[at + l_seq :])
        yield (
            name, names[ref] if ref >= 0 else None, pos if pos >= 0 else None, flags, mapq, seq or None, None if quals and quals[0] == 255 else quals,
            aligned_pairs(pos, cigar) if ref >= 0 and not flags & 4 else [], *(found.get(t) for t in tags), k,
        )
        k += 1


def read_bam(spark: SparkSession, path: str, tags: tuple[str, str, str, str] = ("CB", "GN", "UB", "TR")) -> DataFrame:
    """All reads of one file or a folder of ``*.bam``, in the schema of reads; ordinals count within a file in its upper bits' order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bam").load(path)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for number, content in zip(pdf["number"], pdf["content"], strict=True):
                rows = []
                for r in records(content, tags):
                    rows.append((*r[:7], [{"qpos": q, "rpos": p, "kind": k} for q, p, k in r[7]], *r[8:12], (int(number) << 40) + r[12]))
                    if len(rows) == 2000:
                        yield pd.DataFrame(rows, columns=names).astype(object)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype(object)

    names = ["read_id", "contig", "pos", "flags", "mapq", "seq", "quals", "aligned", "cb", "gn", "ub", "tr", "ordinal"]
    return files.select(F.monotonically_increasing_id().alias("number"), "content").mapInPandas(run, READS_DDL)
