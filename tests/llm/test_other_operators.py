"""Operators on embeddings, pages and conversations, and the pipeline, against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from barrspark.llm import arc_warc, collision_counting, quote_linking


def brute_components(links, n):
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in links:
            m = min(low[i], low[j])
            if low[i] != m or low[j] != m:
                low[i] = low[j] = m
                changed = True
    return low


def test_collision_counting_finds_every_link(spark):
    rng = np.random.default_rng(0)
    data = []
    for k in range(150):
        v = rng.normal(size=16)
        data.append((len(data), v, k % 3))
        if k % 4 == 0:
            for scale in (0.02, 0.09, 0.095, 0.1):
                data.append((len(data), v + rng.normal(size=16) * scale * np.linalg.norm(v), k % 3))
        if k % 25 == 0:
            data += [(len(data) + i, v.copy(), k % 3) for i in range(3)]
            data.append((len(data), v * 5, k % 3))
    rows = [(i, [float(x) for x in v], la) for i, v, la in data]
    bad = [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None] * 8, 1), (903, [float("nan")] * 16, 1), (904, rows[0][1], None), (905, [], 1), (906, [1e200] * 16, 1), (907, [2e200] * 16, 1), (908, [1.0] * 4, 1)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows + bad], "vec_id long, embedding array<double>, label int, cls int, size string")
    for block in (1024, 13):
        got = {r.vec_id: r for r in collision_counting.near_duplicates(df, block_rows=block).collect()}
        x = np.array([v for _, v, _ in rows])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        lab = np.array([la for _, _, la in rows])
        hit = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])
        np.fill_diagonal(hit, False)
        low = brute_components(list(zip(*np.nonzero(hit))), len(x))
        assert [got[i].n_links for i in range(len(x))] == hit.sum(1).tolist()
        assert [got[i].component_id for i in range(len(x))] == low
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
        assert [(got[i].n_links, got[i].component_id) for i in (900, 901, 902, 903, 904, 905, 908)] == [(0, i) for i in (900, 901, 902, 903, 904, 905, 908)]
        assert got[906].n_links == got[907].n_links == 1 and got[907].component_id == 906
    assert collision_counting.near_duplicates(df.limit(0)).count() == 0


def test_calibrated_count_loses_fewer_than_stated():
    width, least = collision_counting.calibration(0.93)
    rng = np.random.default_rng(4)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.normal(size=a.shape)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.9301 * a + np.sqrt(1 - 0.9301**2) * o
    qa, qb = collision_counting._quantised(a).astype(int), collision_counting._quantised(b).astype(int)
    assert ((np.abs(qa - qb) <= width).sum(0) >= least).all()
    assert (np.abs(qa - np.roll(qa, 1, axis=1)) <= width).sum(0).mean() < least


def test_arc_versions_and_damage():
    body = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\n<p>\r\n\r\n\n x</p>"
    for v in (1, 2):
        arc = arc_warc.arc_version_block(v, "n.arc") + arc_warc.arc_record(v, "http://a/b c", body, date="20240203040506") + arc_warc.arc_record(v, "dns:a", b"1.2.3.4", mime="text/dns", date="2024")
        got = list(arc_warc.parse_arc(arc))
        assert [(r.url, r.content, r.whole) for r in got] == [("http://a/b c", body, True), ("dns:a", b"1.2.3.4", True)]
        assert [arc_warc.warc_date(r.date) for r in got] == ["2024-02-03T04:05:06Z", "2024-01-01T00:00:00Z"]
        assert not list(arc_warc.parse_arc(arc[:-4]))[-1].whole
        assert list(arc_warc.parse_arc(arc + b"broken\nxx"))[-1] == arc_warc.ArcRecord(len(arc), "", "", "", "", b"broken\nxx", False)
        import gzip

        assert list(arc_warc.parse_arc(gzip.compress(arc[:50]) + gzip.compress(arc[50:])))[0].content == body
    assert list(arc_warc.parse_arc(b"")) == []


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_pages_round_trip(spark, tmp_path, compression):
    big, odd = "x" * 1500, "é\r\n\r\nWARC/1.0\r\n\r\n" * 100
    data = [(1, "http://a", big), (2, "http://b", big), (9, None, big), (3, "http://c d", "small"), (4, "http://e", "small"), (5, "u", None), (6, "u\nv", ""), (7, "w", odd), (8, "w2", odd), (8, "w2", odd), (None, "n", odd), (None, "n", "lone"), (10, "y", "y" * 2_000_000)]
    df = spark.createDataFrame([(*r, "z") for r in data], "page_id long, url string, html string, key string")
    records = arc_warc.warc_records(arc_warc.mark_revisits(arc_warc.convert(arc_warc.pages_as_arc(df.drop("key"), most=3000))))
    path = str(tmp_path / "w")
    arc_warc.write_warc(records, path, 3, compression)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    got = sorted(((r.key or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in arc_warc.read_warc(files).collect()), key=str)
    want = []
    for k, _, h in data:
        raw = (h or "").encode()
        same = [q for q, _, x in data if x == h and q is not None] if len(raw) >= 1000 else []
        keep = max(same) if len([1 for _, _, x in data if x == h]) > 1 and same else None
        to = keep if keep is not None and keep != k else None
        want.append((k or -1, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to is not None else "response", to))
    assert got == sorted(want, key=str)
    assert arc_warc.archive_pages(df.limit(0)).count() == 0


def test_parse_message():
    body, passages, units = quote_linking.parse_message("Hi\n\nA. wrote:\n> one  TWO\n> three\n>> deeper\n> > deeper 2\n>back\nmine\n>\n")
    assert body == "Hi\n\nmine"
    assert passages == [(1, "one two three"), (2, "deeper deeper 2"), (1, "back")]
    assert units == ["hi mine", "hi", "mine"]
    assert quote_linking.parse_message(None) == ("", [], [])


def test_reply_order(spark):
    data = [
        (1, 0, "user", "First thing\n\nSecond thing"),
        (1, 1, "assistant", "Another"),
        (1, 2, "user", "> second  THING\nsure"),
        (1, 3, "assistant", "X wrote:\n>> second thing\n> sure\nok then"),
        (1, 4, "user", "> never said\nhm"),
        (1, 5, "user", "> ok then\n"),
        (2, 0, "user", "> Another\nfrom elsewhere"),
        (2, 1, "user", None),
        (2, 2, "user", ""),
        (None, 0, "user", "> another\nlost"),
        (2, None, None, "sure"),
        (1, 1, "assistant", "Another"),
    ]
    df = spark.createDataFrame([(*r, 3) for r in data], "conv_id long, turn long, role string, text string, mid int")
    got = quote_linking.conversations(df).collect()
    assert len(got) == len(data)
    by = {(r.conv_id, r.turn): r for r in got}
    assert [(by[1, t].reply_to, by[1, t].root_turn) for t in range(6)] == [(None, 0), (None, 1), (0, 0), (2, 0), (None, 4), (3, 0)]
    assert by[1, 3].text == "ok then" and by[1, 3].n_passages == 2 and by[1, 3].n_levels == 2 and by[1, 3].n_linked == 2
    assert by[2, 0].n_linked == 1 and by[2, 0].reply_to is None
    assert by[None, 0].n_linked == 1 and by[1, 4].n_linked == 0
    assert quote_linking.conversations(df.limit(0)).count() == 0
    # the SQL gives the same rows
    import duckdb
    import pandas as pd

    from barrspark.llm.queries import OP1_SQL

    con = duckdb.connect()
    con.register("given", pd.DataFrame(data, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE TABLE conversations AS SELECT * FROM given")
    order = ["conv_id", "turn", "role", "text", "n_levels", "n_passages", "n_linked", "reply_to", "root_turn"]
    want = con.execute(f"SELECT {', '.join(order)} FROM ({OP1_SQL})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in order)) for r in got)


def test_parts_of_quotes_are_linked(spark):
    data = [
        (1, 0, "One is here.\n\nTwo has\ntwo lines.\n\nThree is last."),
        (1, 1, "Line a\nline b\nline c\nline d"),
        (1, 2, "> One is here.\n>\n> Two has two lines.\n\ntwo of three"),
        (1, 3, "> line b\n> line c\ntwo of four lines"),
        (1, 4, "> One is here.\n>\n> line c\n> never said this\nparagraph and line"),
        (1, 5, "> unknown\n>\n> not said\n> nor this\nnothing"),
        (2, 0, "> Two has\n> two lines.\n>\n> Three is last.\nfrom elsewhere"),
        (2, 1, "> line b\n> two of three\ntwo originals elsewhere"),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in data], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.n_passages, r.n_linked, r.reply_to, r.root_turn) for r in quote_linking.conversations(df).collect()}
    assert got[1, 2] == (1, 1, 0, 0) and got[1, 3] == (1, 1, 1, 1) and got[1, 4] == (1, 1, 1, 1) and got[1, 5] == (1, 0, None, 5)
    assert got[2, 0] == (1, 1, None, 0) and got[2, 1] == (1, 1, None, 1)


def test_quotes_of_other_conversations_than_the_first(spark):
    data = [(1, 0, "> Common words\nquoted first"), (1, 1, "common words"), (2, 3, "Common words"), (3, 0, "common words"), (4, 0, "> common words\nx"), (2, 0, "> common words\ny")]
    data += [(5, 0, "> only here\nbefore"), (5, 1, "only here")]
    df = spark.createDataFrame([(c, t, "user", x, i) for i, (c, t, x) in enumerate(data)], "conv_id long, turn long, role string, text string, mid long")
    parsed = quote_linking.parse_messages(df).withColumn("mid", quote_linking.F.col("conv_id"))
    got = {r.mid: (r.from_conv, r.from_turn, r.own_turn) for r in quote_linking.link_quotes(parsed.where("size(levels) > 0 or turn > 0 or conv_id = 3")).collect() if r.passage}
    assert got == {1: (2, 3, None), 4: (1, 1, None), 2: (1, 1, None), 5: (None, None, None)}
    rows = {(r.conv_id, r.turn): (r.n_linked, r.reply_to) for r in quote_linking.conversations(df).collect()}
    assert rows[1, 0] == (1, None) and rows[5, 0] == (0, None)


def brute_pipeline(docs):
    """The deterministic stages: exact and near duplicates over the identified documents."""
    import re

    from tests.llm.test_documents_operators import plain_simhash

    best = {}
    for i, t in docs:
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (1, 0)), (-len(t), i))
    kept = sorted((i, t) for i, t in docs if i in {b[1] for b in best.values()})
    fp = [plain_simhash(t) for _, t in kept]
    near = [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3]
    low = brute_components(near, len(fp))
    return {kept[k][0] for k in set(low)}


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), name)
        if name != "byte_bpe":
            assert docs.columns == columns
        seen[name] = docs
    first = [(r.doc_id, r.text) for r in seen["language_id"].collect()]
    assert {r.doc_id for r in seen["simhash_near_dedup"].collect()} == brute_pipeline(first)
    import public_tokenizers as P
    import tiktoken

    from barrspark.llm.queries import bpe_vocabulary

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_vocabulary()[0], special_tokens={})
    text = {r.doc_id: r.text for r in seen["temperature_mixing"].collect()}
    out = docs.collect()
    assert len(out) == seen["temperature_mixing"].count() and out
    for r in out[:60]:
        ids = enc.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert corpus_pipeline.run(spark, sf).count() == len(out)
    assert defaultdict(int) == {}
