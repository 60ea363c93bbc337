"""Operators on documents against brute force, with nulls, ties, repeats, empty and long texts, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barrspark.llm import block_naming, byte_bpe, langid_bayes, log_bilinear, simhash_ball, skip_chain_crf, stretches, temperature_mix

WORDS = "the and of river stone light under morning quiet forest walked along small hidden valley".split()
SCHEMA = "doc_id long, text string, lang string, source string, name string, component_id long, lo int, key string"


def rows(spark, data):
    return spark.createDataFrame([(i, t, la, s, "x", 7, 1, "k") for i, t, la, s in data], SCHEMA)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS) + str(rng.integers(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    out = [(i, prose(i, 30 + 7 * i), "en", f"s{i % 3}") for i in range(40)]
    out += [(100 + i, prose(3, 51), "en", "s0") for i in range(5)]
    out += [(110, "  " + prose(3, 51).replace(" ", "\n ") + "\t", "en", "s1"), (111, None, None, None), (112, "", "fr", "s2"), (113, " \t\r\n", "fr", None)]
    long = prose(9, 40000)
    out += [(120, long, "en", "s0"), (121, long[:-1] + "z", "en", "s0"), (122, long, "en", "s1"), (None, prose(5, 65), "en", "s1"), (3, prose(3, 51), "en", "s0"), (3, prose(3, 51), "en", "s0")]
    return out


def brute_exact(data):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _, _ in data]
    groups = defaultdict(list)
    for (i, t, _, _), n in zip(data, norm):
        groups[n].append((-len(t or ""), i is None, i or 0, i))
    return sorted(
        ((str(i), str(min(groups[n])[3]), len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for (i, _, _, _), n in zip(data, norm))
    )


@pytest.mark.parametrize("size", [16, 4096])
def test_block_naming_is_exact(spark, texts, size):
    got = block_naming.exact_duplicates(rows(spark, texts), block_bytes=size).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute_exact(texts)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_block_naming_survives_key_collisions(spark, texts):
    named = block_naming.name_texts(rows(spark, texts[:50]), "text", {"t": F.coalesce("text", F.lit(""))}, 64, key=lambda b: F.xxhash64(b) % 5).collect()
    same = defaultdict(set)
    for r in named:
        same[(r.n_blocks, r.name)].add(re.sub(r"[\x20\x09-\x0D]", "", r.t))
    assert all(len(x) == 1 for x in same.values())
    assert len(same) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _, _ in texts[:50]})


def test_empty_tables(spark):
    none = rows(spark, [])
    assert block_naming.exact_duplicates(none).count() == 0
    assert simhash_ball.simhash_components(none).count() == 0
    assert langid_bayes.identify(none).count() == 0
    assert temperature_mix.mix(none).count() == 0
    assert skip_chain_crf.personal_data(none).count() == 0
    assert log_bilinear.score_texts(none).count() == 0


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_fingerprints(spark, texts):
    got = {(r.doc_id, r.fp % 2**64) for r in simhash_ball.fingerprints(rows(spark, texts[:45] + texts[45:49]), "text", "doc_id").collect()}
    assert got == {(i, plain_simhash(t)) for i, t, _, _ in texts[:49]}
    assert simhash_ball.simhash(prose(1, 200000).encode()) == plain_simhash(prose(1, 200000))


def test_ball_hashing_finds_every_link(spark):
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(60):
        f = int(rng.integers(0, 2**63))
        fps.add(f)
        for _ in range(3):
            g = f
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                g ^= 1 << int(b)
            fps.add(g)
    fps = sorted(fps)
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
        if all(label[i] == label[j] for i, a in enumerate(fps) for j, b in enumerate(fps) if (a ^ b).bit_count() <= 3):
            break
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    from barrspark.llm.components import connected_components

    got = {r.node: r.component for r in connected_components(simhash_ball.near_edges(df, 20_000)).collect()}
    groups = defaultdict(set)
    for f, la in zip(signed, label):
        groups[la].add(f)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {
        frozenset(n for n, c in got.items() if c == k) for k in set(got.values())
    }


def test_near_copies_keep_one(spark, texts):
    kept = simhash_ball.drop_near_duplicates(rows(spark, texts)).select("doc_id").collect()
    assert 100 not in {r[0] for r in kept} and 3 in {r[0] for r in kept}
    got = simhash_ball.simhash_components(rows(spark, texts)).where("doc_id in (111, 112, 113)").collect()
    assert {r.component_id for r in got} == {111} and {r.fingerprint for r in got} == {"0" * 16}


@pytest.mark.parametrize("drop", [block_naming.drop_exact_duplicates, simhash_ball.drop_near_duplicates])
def test_copies_are_dropped_by_row(spark, drop):
    a, b, c, d, e = (prose(700 + k, 60) for k in range(5))
    data = [(1, a), (None, a), (None, b), (None, c), (None, c), (2, d), (1, d), (7, e), (1, e), (5, a), (5, b + " x"), (8, None), (8, "")]
    data = [(i, t, "en", "s") for i, t in data] + [(9, prose(711, 60), "en", "s")] * 3
    want = [(1, a), (None, c), (1, d), (1, e), (8, ""), (9, prose(711, 60))]
    got = [(r.doc_id, r.text or "") for r in drop(rows(spark, data)).collect()]
    if drop is block_naming.drop_exact_duplicates:
        want += [(None, b), (5, b + " x")]
    else:  # the fingerprints of b and b with a word more may be near
        near = (plain_simhash(b) ^ plain_simhash(b + " x")).bit_count() <= 3
        want += [(5, b + " x")] if near else [(None, b), (5, b + " x")]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_language_identification(spark):
    langs = {"xx": "abcde", "yy": "vwxyz", "zz": "klmno"}
    rng = np.random.default_rng(1)
    data = [(i, " ".join("".join(rng.choice(list(langs[la]), 5)) for _ in range(20)), la, "s") for i, la in enumerate(list(langs) * 40)]
    data += [(500, None, "xx", "s"), (501, "12 34 !", "yy", "s"), (502, "", "zz", None), (None, "abc abc", None, None), (503, "aab " * 400000, "xx", "s")]
    got = {r.doc_id: r for r in langid_bayes.identify(rows(spark, data)).collect()}
    assert all(got[i].lang_pred == la for i, _, la, _ in data[:120])
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[501].score == 0
    assert got[None].lang_pred == "xx" and got[None].held_out is None and got[503].lang_pred == "xx"
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got if i is not None)
    # a prediction does not depend on the row's own columns
    other = [(i, t, None if zlib.crc32(str(i).encode()) % 4 == 2 else la, "q") for i, t, la, _ in data if i is not None]
    again = {r.doc_id: r.lang_pred for r in langid_bayes.identify(rows(spark, other)).collect()}
    assert all(again[i] == got[i].lang_pred for i in again)
    kept = {r.doc_id for r in langid_bayes.keep_identified(rows(spark, data)).collect()}
    assert not kept & {500, 501, 502} and set(range(120)) <= kept


def plain_bins(text):
    """Bins of the n-grams of a short text, one by one."""
    folded, out = [32], []
    for ch in text:
        x = (ord(ch.lower()) if len(ch.lower()) == 1 else ord(ch)) if ch.isalpha() else 32
        if x != 32 or folded[-1] != 32:
            folded.append(x)
    mix = [int(m) for m in langid_bayes._MULTIPLIERS]
    for n in (1, 2, 3):
        for at in range(len(folded) - n + 1):
            h = n
            for k in range(n):
                h = (h ^ folded[at + k]) * mix[k] % 2**32
                h ^= h >> 15
            if n > 1 or folded[at] != 32:
                out.append((h * mix[0] % 2**32) >> 17)
    return out


@pytest.mark.parametrize("entries", [1 << 17, 50])
def test_language_scores_equal_a_plain_multinomial_model(spark, monkeypatch, entries):
    monkeypatch.setattr(langid_bayes, "_ENTRIES", entries)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150)
    data = [(r.doc_id, (r.text or "")[:400], r.lang) for r in docs.collect()]
    train = [(plain_bins(t), la) for i, t, la in data if la is not None and any(map(str.isalpha, t))]
    langs, bins = sorted({la for _, la in train}), langid_bayes.BINS
    seen = {la: Counter(b for x, g in train if g == la for b in x) for la in langs}
    prior = np.log([sum(g == la for _, g in train) / len(train) for la in langs])
    logp = lambda b, la: np.log((seen[la][b] + 0.5) / (sum(seen[la].values()) + 0.5 * bins))
    model = langid_bayes.train(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert model.langs == langs
    texts = [t for _, t, _ in data] + [None, "", "12 !"]
    for t, (pred, score) in zip(texts, model.predict(texts), strict=True):
        if not any(map(str.isalpha, t or "")):
            assert (pred, score) == ("und", 0.0)
            continue
        total = prior + [sum(logp(b, la) for b in plain_bins(t)) for la in langs]
        p = np.exp(total - total.max())
        assert pred == langs[int(total.argmax())] and score == pytest.approx(p.max() / p.sum(), abs=1e-3)
    assert langid_bayes.NaiveBayes([], np.zeros((bins, 0), np.float32), np.zeros(0)).predict(["a"]) == [("und", 0.0)]


def test_mixture(spark):
    data = [(i, prose(i % 50, 20 + i % 9), "en", "big") for i in range(300)] + [(1000 + i, prose(i, 30), "en", f"s{i % 4}") for i in range(40)]
    data += [(2000, None, "en", "void"), (2001, "a b c", "en", None), (2001, "a b c", "en", None)]
    df = rows(spark, data)
    got = temperature_mix.mix(df, block_tokens=100)
    _, plan = temperature_mix.mixing_plan(df, block_tokens=100)
    tokens = defaultdict(int)
    for i, t, _, s in data:
        tokens[s] += len((t or "").split())
    total = sum(tokens.values())
    for r in plan.collect():
        mine = [x for x in got.collect() if x.source == r.source]
        taken = sum(x.n_tokens for x in mine)
        assert r.budget - 2 * 40 <= taken <= r.budget
        assert r.budget <= 4.0001 * tokens[r.source] + 1
        counts = Counter((x.doc_id, x.epoch) for x in mine)
        assert set(counts.values()) <= {1, 2}
    assert abs(sum(r.budget for r in plan.collect()) - total) < 10
    assert "void" not in {r.source for r in got.collect()}
    docs = temperature_mix.mixed_documents(df, block_tokens=100)
    assert docs.columns == df.columns and docs.count() == got.count()


def test_mixture_blocks_stay_together(spark):
    df = rows(spark, [(i, prose(i, 25), "en", "a" if i < 400 else "b") for i in range(480)])
    got = temperature_mix.mix(df, block_tokens=500, entropy_share=1.0, max_repeats=3.0).where("source = 'b'").collect()
    last = max(r.epoch for r in got)
    whole = Counter(r.block for r in got if r.epoch == 0)
    part = Counter(r.block for r in got if r.epoch == last)
    assert sum(part[b] != whole[b] for b in part) <= 1


def test_bpe_matches_the_library(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    data = [None, "", " ", "  \n ", "it's  we'll \n\n x", "a b 　 c\x1c d\x85e", "日本語 テスト 1234567 ½ Ⅷ", "aaaaaaaaa" * 200, "ab" * 5000, "<|endoftext|> x", "​ zero﻿", "x" * 300 + " y" * 3]
    data += [prose(i, 80).title() + "  \t" + "é" * i for i in range(20)]
    df = rows(spark, [(i, t, "en", "s") for i, t in enumerate(data)] + [(3, "  \n ", "en", "s")])
    for apart in (False, True):
        assert byte_bpe.encode(df.limit(0), ranks, P.PATTERN, apart=apart).count() == 0
    for most, apart in ((0, False), (40, True), (1 << 18, False)):
        enc_df = byte_bpe.encode(df, ranks, P.PATTERN, max_pieces=most, apart=apart)
        for r in byte_bpe.decode(enc_df, ranks).collect():
            text = data[r.doc_id] or ""
            assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(text), text
            assert bytes(r.decoded) == text.encode()


@pytest.mark.parametrize("apart", [False, True])
def test_bpe_over_several_groups(spark, monkeypatch, apart):
    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    data = [None] * 300 + [prose(i, i % 7).title() + " xq%dz" % i * (i % 3) for i in range(500)]
    monkeypatch.setattr(byte_bpe, "GROUP_BYTES", 2000)
    monkeypatch.setattr(byte_bpe, "_ROW_WORDS", 7)
    df = rows(spark, [(i, t, "en", "s") for i, t in enumerate(data)]).coalesce(1)
    got = byte_bpe.encode_and_check(df, ranks, P.PATTERN, keep_ids=True, max_pieces=20, apart=apart).collect()
    assert len(got) == len(data)
    for r in got:
        text = data[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(text)
        assert r.n_tokens == len(r.ids) // 4 and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_dictionary_tells_equal_hashes_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(byte_bpe, "_hashes", lambda words: np.array([len(w) for w in words], np.uint64))

    def dictionary(words, ids):
        batch = pa.RecordBatch.from_arrays([pa.array([words], pa.list_(pa.binary())), pa.array([ids], pa.list_(pa.list_(pa.int32())))], ["pieces", "words"])
        return byte_bpe.Dictionary(*(x[0].as_py() for x in next(byte_bpe._flat(iter([batch]))).columns))

    table = dictionary([b"xyz", b"ab", b"cd"], [[3, 4], [1], [2]])
    assert table.find([b"ab", b"cd", b"xyz", b"q"]).tolist() == [0, -1, 2, -1]
    assert table.ids.tolist() == [1, 2, 3, 4]
    assert dictionary([], []).find([b"a"]).tolist() == [-1]


@pytest.mark.parametrize("weak", [False, True])
def test_stretches_have_the_pieces_of_their_text(monkeypatch, weak):
    """Pieces of the stretches are those of the whole text, also where all stretches of a length share one key."""
    import public_tokenizers as P
    import pyarrow as pa
    import regex

    if weak:
        monkeypatch.setattr(stretches, "_keys", lambda numbers, lengths: lengths.astype(np.uint64))
        monkeypatch.setattr(stretches.xxhash, "xxh64_intdigest", lambda b: 7)
    rng, find = np.random.default_rng(5), regex.compile(P.PATTERN).findall
    alphabet = list("ab1.,'s  \n\t") + ["é", "à", "\u00a0", "\u3000", "日", "\u2003", "\x85", "\x1c", "𝒳", "ア", "\x00"]
    texts = [None, "", " ", "a", *("".join(rng.choice(alphabet, n)) for n in rng.integers(1, 60, 800)), "x" * 30 + " " + "x" * 31 + " " + "x" * 30]
    texts = [*texts, " ".join(["same long stretch" * 3, "y" * 40] * 3)]
    numbers, got = stretches.Numbers(), []
    for block, starts, lengths, per in stretches.blocks(pa.array(texts, pa.string()).slice(1), 500):
        mine, at = numbers.of(block, starts, lengths), 0
        for n in per.tolist():
            got.append(mine[at : at + n].tolist())
            at += n
    said = [x.decode() for x in numbers.known]
    assert len(got) == len(texts) - 1
    for t, at in zip(texts[1:], got, strict=True):
        assert "".join(said[k] for k in at) == t
        assert [p for k in at for p in byte_bpe.pieces_of(said[k], find)] == find(t), t


def test_heap_equals_fold_order():
    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 1000):
        s = "".join(rng.choice(list("abceinorst "), n))
        assert byte_bpe.merge_with_heap(s.encode(), ranks) == enc.encode_ordinary(s)


def test_fold_goes_through_ids_once_a_step(spark):
    """Also where different pairs make one token, overlap, or come to be of lower rank by another merge."""
    tokens = [bytes([x]) for x in range(256)] + [b"abc", b"aa", b"ab", b"aaa", b"bc", b"ca", b"aaaa", b"cab", b"abcab"]
    ranks = {t: i for i, t in enumerate(tokens)}
    rng = np.random.default_rng(4)
    words = [*ranks, *(bytes(rng.choice(list(b"abc"), n).astype(np.uint8)) for n in (2, 3, 5, 8, 13, 40, 256) for _ in range(9))]
    some = [words[:3], words[3:], []]
    single, pairs = byte_bpe._single_bytes(ranks), byte_bpe._byte_pairs(ranks)
    rows = spark.createDataFrame([(i, byte_bpe.first_states(x, single, pairs).to_pylist()) for i, x in enumerate(some)], "i int, words array<array<bigint>>")
    out = byte_bpe._with_ids(rows, byte_bpe.rank_literal(spark, ranks))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan
    for i, found in out.collect():
        assert [[x & byte_bpe._ID for x in w] for w in found] == [byte_bpe.merge_with_heap(w, ranks) for w in some[i]]


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                x = [int(c) for c in d[::-1]]
                if not 16 <= len(d) <= 19 or (sum(x[::2]) + sum(sum(divmod(2 * y, 10)) for y in x[1::2])) % 10:
                    continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(3)
    alphabet = list("ab1 9@@..+-()%_,é\n0")
    fixed = ["a@b.co@c.de", "x@@y.z", "+1 (988) 555-2485", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "a@b a@b.c-", "0255.1.1.1", "@a.b", "1000.1.1.1.1"]
    for text in fixed + ["".join(rng.choice(alphabet, 60)) for _ in range(3000)]:
        assert skip_chain_crf.base_spans(text) == plain_base(text), text


def test_crf_shares_labels_of_repeats(spark):
    said = "call +1 (988) 555-2485 now, later 988-555-2485 again"
    data = [(i, f"{prose(i, 12)} +1 ({200 + i}) 555-{1000 + i} {prose(i, 9)} {i} x{i % 7}", "en", "s") for i in range(60)]
    data += [(100, said, "en", "s"), (101, "no data 12 here 34", "en", "s"), (102, None, "en", "s"), (103, "", "en", "s"), (104, "mail bob.stone@mail3.example.com or bob.stone x " * 2, "en", "s"), (None, "10.0.0.1", "en", "s")]
    got = {r.doc_id: r for r in skip_chain_crf.personal_data(rows(spark, data)).collect()}
    assert got[101].spans == "" and got[102].base_sha256 == hashlib.sha256(b"").hexdigest() and got[None].n_ip == 1
    for i, t, _, _ in data:
        base = ",".join(f"{BASE[k][0]}:{a}:{b}" for k, a, b in plain_base(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
    at = said.index("988-555")
    assert f"phone:{at}:{at + 12}" in got[100].spans
    clean = skip_chain_crf.redact(rows(spark, data)).where("doc_id = 100").first().text
    assert clean == "call [phone] now, later [phone] again"


def test_loopy_messages_equal_enumeration():
    """On a document whose graph is a tree, beliefs equal those by enumeration."""
    text = "+1 (988) 555-2485 said 9885552485 then 77 and"
    g = skip_chain_crf.Graph(text, skip_chain_crf.base_spans(text))
    p = skip_chain_crf.Potentials([(0, int(s), k % 5, 3) for k, s in enumerate(g.shapes)] + [(1, 3, 4, 5), (2, 3, 3, 9)])
    n, edges = len(g.words), [(i, j, p.chain) for i, j in g.chain] + [(i, j, p.skip) for i, j in g.skip]
    assert len(edges) < n
    total = np.zeros((n, skip_chain_crf._LABELS))
    for state in np.ndindex(*[skip_chain_crf._LABELS] * n):
        if any(s >= 0 and s != y for s, y in zip(g.seen, state)):
            continue
        w = np.exp(sum(p.unary[g.shapes[i], state[i]] for i in range(n) if g.seen[i] < 0) + sum(t[state[i], state[j]] for i, j, t in edges))
        for i in range(n):
            total[i, state[i]] += w
    old, skip_chain_crf.STEPS = skip_chain_crf.STEPS, 200
    try:
        np.testing.assert_allclose(skip_chain_crf.beliefs(g, p), total / total.sum(1, keepdims=True), atol=1e-3)
    finally:
        skip_chain_crf.STEPS = old


def test_crf_reaches_every_repeat():
    """However many repeats lie between, each has the belief of a lone repeat of the observed span; so have both ends of a hub."""
    none = skip_chain_crf._NONE
    p = skip_chain_crf.Potentials([(0, s, none, 2) for s in range(512)] + [(0, s, 3, 1) for s in range(512)] + [(2, 3, 3, 90), (2, 3, none, 5), (2, none, none, 900)])
    found = lambda n: skip_chain_crf.find_spans("+1 (988) 555-2485 is it" + ", or ever so often 9885552485" * n, p)
    assert len(found(1)[1]) == 1
    for n in (5, 40, 400):
        assert len(found(n)[1]) == n
    text = "mail x " + " then 12345678z " * 30
    g = skip_chain_crf.Graph(text, [])
    assert not g.skip and [len(at) for at in g.hubs] == [30]
    even = skip_chain_crf.beliefs(g, p)
    g.shapes = g.shapes.copy()
    p.unary[511, :] = np.log([0.001, 0.001, 0.001, 0.995, 0.001, 0.001])
    g.shapes[0] = 511
    told = skip_chain_crf.beliefs(g, p)
    assert (told[1:, 3] > even[1:, 3]).all() and np.ptp(told[1:, 3]) < 1e-3


def test_crf_messages_stand_still_on_long_chains():
    """A chain that hardly fades needs more steps than a fixed few: its last node equals the exact product of tables."""
    n = 120
    g = skip_chain_crf.Graph("+1 (988) 555-2485" + " 7" * n, [(3, 0, 17)])
    p = skip_chain_crf.Potentials([])
    p.unary[:] = 0.0
    p.chain = np.log(np.eye(skip_chain_crf._LABELS) * 0.99 + 0.002)
    want = np.linalg.matrix_power(np.exp(p.chain), n)[3]
    np.testing.assert_allclose(skip_chain_crf.beliefs(g, p)[-1], want / want.sum(), atol=1e-3)


def test_crf_takes_long_texts_without_spaces_in_linear_time():
    import time

    p = skip_chain_crf.Potentials([])
    for text in ("7" * 1_000_000, "a1@" * 300_000, "1." * 500_000, "+1-" * 300_000, "9" + "x" * 1_000_000):
        began = time.process_time()
        base, _ = skip_chain_crf.find_spans(text, p)
        assert time.process_time() - began < 20
    assert skip_chain_crf.find_spans("x" * 1_000_000 + " a@b.co " + "1" * 1_000_000, p)[0] == [(0, 1_000_001, 1_000_007)]


def test_crf_finds_secrets_by_name_repeat_and_form(spark):
    import random

    rng = random.Random(4)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    keys = [key() for _ in range(42)]
    data = [(i, f'{prose(i, 9)} token = "{keys[i]}" {prose(i, 5)} version {i}.0 of {i}', "en", "s") for i in range(40)]
    data += [(50, f"here {keys[40]} stands alone", "en", "s"), (51, "in 1999 there were 12 of 30", "en", "s")]
    data += [(52, f"password: abc9_{'x' * 12} then abc9_{'x' * 12} again", "en", "s")]
    got = {r.doc_id: r for r in skip_chain_crf.personal_data(rows(spark, data)).collect()}
    for i, t, *_ in data[:40]:
        at = t.index(keys[i])
        assert got[i].spans == f"secret:{at}:{at + 40}" and got[i].n_added == got[i].n_spans == 1
    assert got[50].spans == "secret:5:45" and got[51].spans == ""
    assert got[52].n_added == 2
    clean = {r.doc_id: r.text for r in skip_chain_crf.redact(rows(spark, data)).collect()}
    assert clean[50] == "here [secret] stands alone" and clean[51] == data[41][1]


def test_log_bilinear_counts_and_normalisation(spark, monkeypatch):
    monkeypatch.setattr(log_bilinear, "OWN", 12)
    monkeypatch.setattr(log_bilinear, "MAX_WORDS", 25)
    data = [(i, " ".join(["the quick fox", "sees a Dog"][i % 2] for _ in range(20)) + f" w{i % 30} u{i}", "en", "s") for i in range(140)]
    data += [(500, None, "en", "s"), (501, "", None, None), (None, "the quick fox", "en", "s"), (502, "neverseen " * 3, "en", "s")]
    seen, train = [], log_bilinear.train

    def kept(tokenised, vocab):
        seen.append((vocab, train(tokenised, vocab)))
        return seen[-1][1]

    monkeypatch.setattr(log_bilinear, "train", kept)
    got = log_bilinear.score_texts(rows(spark, data)).collect()
    monkeypatch.undo()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in data if i is not None}
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [""]
    c = Counter(w for i, t, _, _ in data if i is not None and not held[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    by = {i: t for i, t, _, _ in data}
    for r in got:
        w = tokens(by[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), abs=1e-6)
    mine = [r for r in got if r.held_out and r.doc_id < 140]
    assert sum(r.score for r in mine) > sum(r.base_score for r in mine)
    # every score, from the model's own numbers: a softmax over the outputs, and a word's share of its class
    (vocab, model), = seen
    assert vocab.own == 12 and 12 < len(vocab.words) <= 25
    logits = lambda a, b: (model.c[0] @ model.r[a] + model.c[1] @ model.r[b]) @ model.q.T + model.b
    out = lambda w: vocab.words[w] if vocab.words.get(w, 99) < 12 else log_bilinear._class_of(w, 12)
    for r in got[:60] + got[-4:]:
        total, before = 0.0, [out(b"")] * 2
        for w in (x.encode() for x in tokens(by[r.doc_id])):
            s, o = logits(*before).astype(float), out(w)
            total += np.log10(np.exp(s[o]) / np.exp(s).sum())
            total += np.log10((c[w.decode()] + 1) / vocab.class_mass[o - 12]) if o >= 12 else 0.0
            before = [o, before[0]]
        assert r.score == pytest.approx(total, abs=2e-3)
    # the shares of a class's words, and one for a word that training lacks, sum to one
    for k in {log_bilinear._class_of(w.encode(), 0) for w in c}:
        inside = [c[w] + 1 for w in c if log_bilinear._class_of(w.encode(), 0) == k and out(w.encode()) >= 12]
        assert sum(inside) + 1 == vocab.class_mass[k]
    assert log_bilinear.score_texts(rows(spark, data).limit(0)).count() == 0


def test_log_bilinear_beats_its_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = log_bilinear.score_texts(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert held[0] > held[1] + 0.05 * held[2]
