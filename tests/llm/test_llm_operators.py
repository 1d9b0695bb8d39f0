"""Operators on awkward tables, against plain versions."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import odd  # noqa: E402

from redline.llm import (hashed_search, language, line_dedup, line_frequency, mixing, near_dup, pieces,  # noqa: E402
                         sentence_spans, toxicity, url_filter)
from redline.llm.components import components  # noqa: E402


def test_line_dedup(spark):
    got = line_dedup.dedup_lines(odd.documents(spark)).collect()
    want = odd.line_dedup([(r[0], r[1]) for r in odd.rows()])
    assert len(got) == len(odd.rows())
    for r in got:
        original = next(x for x in odd.rows() if x[0] == r.doc_id and x[7] == r["_key"])
        assert (r.n_lines, r.n_dropped, r.text) == want[original[0], original[1]]


def test_line_dedup_with_saturated_filters(spark):
    data = [(i, "\n".join(f"line number {(i * 7 + k) % 300} of many" for k in range(9))) for i in range(120)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    tiny = line_dedup.dedup_lines(df, max_filter_bytes=8)
    want = odd.line_dedup(data)
    assert {r.doc_id: r.text for r in tiny.collect()} == {k[0]: v[2] for k, v in want.items()}


def test_near_dup_on_awkward_rows(spark):
    got = near_dup.near_duplicates(odd.documents(spark)).collect()
    want = odd.near_dup([(r[0], r[1]) for r in odd.rows()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert sum(r.doc_id is None for r in got) == 3


def test_near_dup_chain_and_large_group(spark, monkeypatch):
    """A chain of edits, and a group larger than a block whose members link unevenly."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    data, now = [], list(base)
    for i in range(30):
        data.append((i, " ".join(now)))
        now = now.copy()
        now[rng.randrange(120)] = f"edit{i}"
    for i in range(30, 70):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = f"x{rng.randrange(999)}"
        data.append((i, " ".join(w)))
    got = near_dup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == odd.near_dup(data)


def test_may_reach_with_sets_of_many_megabytes():
    sig = np.zeros((1, near_dup.WIDE), np.uint8)
    for x, y in ((22_000_000, 22_400_000), (64_500_000, 65_000_000), (2**31 - 9, 2**31 - 1)):
        assert near_dup.may_reach(sig[0], sig, np.int32(x), np.array([y], np.int32), 85).tolist() == [0]
        assert near_dup.may_reach(sig[0], sig, x, np.array([y], np.int32), 85).tolist() == [0]
    assert not len(near_dup.may_reach(sig[0], sig, 2**31 // 100, np.array([2**31 - 1], np.int32), 85))


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_mixing_targets(spark):
    data = [(i, "w " * 10, "big" if i < 80 else "mid" if i < 96 else None) for i in range(100)] + [(None, None, "mid")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    turns = mixing.mix(df, mixing.Target(max_repeats=2.0), block_docs=7).collect()
    per = {}
    for t in turns:
        per.setdefault(t["_src"], []).append(t)
    assert len(per["big"]) == 80 and len(per[None]) == 8
    sizes = [800.0, 160.0, 40.0]
    sources = spark.createDataFrame([(x,) for x in sizes], "tokens double")

    def entropy(a):
        w = np.array(sizes) ** a / sum(s**a for s in sizes)
        return float(-(w * np.log(w)).sum())
    a = mixing.temperature(sources, mixing.Target(max_repeats=None, target_entropy=0.9))
    assert abs(entropy(a) - 0.9) < 1e-6
    a = mixing.temperature(sources, mixing.Target(max_repeats=3.0))
    assert abs((800 / 40) ** (1 - a) - 3.0) < 1e-6
    budget = mixing.mix(df, mixing.Target(max_repeats=2.0, token_budget=500), block_docs=7)
    tokens = budget.groupBy("_src").agg(F.sum("_tokens").alias("t")).collect()
    assert 500 <= sum(r.t for r in tokens) <= 500 + 3 * 10
    assert mixing.mixed_rows(odd.documents(spark)).columns == odd.documents(spark).columns


def test_mixed_rows_keep_every_row_and_split_heavy_keys(spark):
    docs = odd.documents(spark)
    turns = sorted((r["_id"] is None, r["_id"] or 0, r["_tokens"]) for r in mixing.mix(docs).collect())
    got = mixing.mixed_rows(docs).collect()
    assert {r["_key"] for r in got} == {r[7] for r in odd.rows()}  # 91 has neither id nor text
    assert turns == sorted((r.doc_id is None, r.doc_id or 0, len(odd.WORDS.findall(r.text or ""))) for r in got)
    # one text without id, neither id nor text, and one repeated id of two sources, far above a block's size
    data = ([(None, "", "a")] * 2500 + [(None, None, "a")] * 2500 + [(7, "x y", "a")] * 2500 + [(7, "x y z", "b")] * 40
            + [(i, f"t {i}", "a") for i in range(100, 2600)])
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    out = mixing.mixed_rows(df).groupBy("doc_id", "text", "source").count().collect()
    n = {(r.doc_id, r.text, r.source): r["count"] for r in out}
    assert n[None, "", "a"] == n[None, None, "a"] == n[7, "x y", "a"] == 2500
    assert 40 <= n[7, "x y z", "b"] <= 80 and len(out) == 2504
    held = df.withColumn("r", F.monotonically_increasing_id()).localCheckpoint()
    sizes = mixing.mix(held, row_col="r").groupBy("_src", "epoch", "block").count().agg(F.max("count")).first()
    assert sizes[0] < 1300


def test_pieces_equal_the_library(spark):
    spm = pytest.importorskip("sentencepiece")
    import public_tokenizers
    sp = spm.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    rng = random.Random(5)
    texts = [r[1] or "" for r in odd.rows()] + ["".join(rng.choice("ab ▁é\n😀<0x>中.,the'i-") for _ in range(40))
                                                for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pieces.decode_pieces(pieces.encode_documents(df, pieces.read_model()), pieces.read_model())
    for r in got.collect():
        want = sp.encode(r.text, return_type="proto")
        ids = [p.id for p in want.pieces]
        assert r.piece_ids == [*ids, sp.eos_id()] and r.decoded == sp.decode(ids)
        raw = r.text.encode()
        assert [raw[b:e] for b, e in zip(r.piece_begins, r.piece_ends)] == [*(p.surface.encode() for p in want.pieces),
                                                                        b""]
    digest = pieces.token_digests(odd.documents(spark), pieces.read_model()).filter("doc_id = 6").first()
    assert digest.n_tokens == 1 and digest.ids_sha256 == hashlib.sha256(b"2").hexdigest()


def test_character_map_takes_the_longest_prefix():
    """A hand-made double array with the keys ``a`` -> ``x`` and ``ab`` -> ``yz``."""
    import struct
    units = [0] * 512
    units[0] = 1 << 10  # root, children from 1 ^ byte
    a = 1 ^ ord("a")
    units[a] = ord("a") | 1 << 8 | (a ^ 256) << 10  # leaf at 256
    units[256] = 0 | 1 << 31
    b = 256 ^ ord("b")
    units[b] = ord("b") | 1 << 8 | (b ^ 400) << 10
    units[400] = 2 | 1 << 31
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"x\0yz\0"
    m = pieces.CharacterMap(blob)
    assert m.longest(b"abc", 0) == (2, b"yz") and m.longest(b"ac", 0) == (1, b"x") and m.longest(b"c", 0) is None
    model = pieces.PieceModel(pieces.read_model())
    model.map = m
    text, align = model.normalize("cabé a".encode())
    assert text == "▁cyzé▁x" and align.tolist() == [0, 0, 1, 1, 3, 5, 6, 7]


def test_line_frequency_on_awkward_rows(spark):
    got = line_frequency.judge(odd.documents(spark)).collect()
    assert len(got) == len(odd.rows())
    cache = line_frequency.WordHashes()
    for r in got:
        assert r.kept == (not r.base_failed)  # too few documents for any limit
    assert line_frequency.repeated_words(b"a b c d e x a b c d e".split(), cache) == 10
    spam = [(i, f"share this page with friends\nown text {' '.join(f'w{i}_{k}' for k in range(20))}", "h")
            for i in range(30)] + [(99, "share this page with friends\nshare this page with friends", "h")]
    df = spark.createDataFrame(spam, "doc_id long, text string, source string")
    kept = line_frequency.clean(df).collect()
    assert {r.doc_id for r in kept} == set(range(30)) and not any("friends" in r.text for r in kept)
    assert line_frequency.judge(df.limit(0)).count() == 0


def test_url_filter(spark):
    data = [(1, "http://WWW.Example.com/en/a?x=1#y"), (2, "https://a.example.com/en/"), (3, "ftp://b.net/es/q"),
            (4, None), (5, "no scheme"), (6, "http://h.org"), (7, "http://h.org/p/?utm_a=1&b=2"), (7, "https://m.h.org/p?b=2"),
            (None, "http://h.org/p?b=3")]
    df = spark.createDataFrame(data, "page_id long, url string")
    listed = spark.createDataFrame([("h.org/p?b=2",), ("h.org/p?b=2",), (None,)], "u string")
    got = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in
                  url_filter.judge(df, listed, "u").collect()), key=str)
    assert got == sorted([
        (0, "h.org", "/p", None, "allow"), (1, "www.example.com", "/en/a", "www.example.com/en/", "allow"),
        (2, "a.example.com", "/en/", "example.com/en/", "block"), (3, "b.net", "/es/q", "net/es/", "block"),
        (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "h.org", "", None, "allow"),
        (7, "h.org", "/p/", None, "block"), (7, "m.h.org", "/p", None, "block")], key=str)
    assert url_filter.judge(df, listed.limit(0), "u").filter("listed").count() == 0


def brute_chance(word, vocab, chance):
    """Sum over every segmentation, by recursion."""
    text = language.SPACE + word

    def rest(i):
        if i == len(text):
            return np.ones(chance.shape[1])
        total = np.zeros(chance.shape[1])
        for j in range(i + 1, len(text) + 1):
            p = vocab.pieces.get(text[i:j])
            if p is not None:
                total = total + chance[p] * rest(j)
        if text[i] not in vocab.pieces:
            total = total + np.prod([chance[len(vocab.pieces) + b] for b in text[i].encode()], axis=0) * rest(i + 1)
        return total
    return np.log(rest(0))


def test_language_sums_all_segmentations(spark):
    vocab = language.Vocabulary({p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "▁ab", "c", "abc"])})
    chance = np.random.default_rng(2).dirichlet(np.ones(vocab.size), 3).T
    words = ["abc", "a", "cab", "bé", "abcabcab"]
    got, _ = language.forward(words, vocab, chance)
    for w, g in zip(words, got):
        assert np.allclose(g, brute_chance(w, vocab, chance))
    long_word, _ = language.forward(["abc" * 400], vocab, chance)
    assert np.isfinite(long_word).all()
    uses = language.expected_counts(["abc"], np.ones((1, 3)), vocab, chance)
    shifted = chance.copy()
    k = vocab.pieces["ab"]
    shifted[k] *= 1 + 1e-6
    slope = (language.forward(["abc"], vocab, shifted)[0] - language.forward(["abc"], vocab, chance)[0]) / 1e-6
    assert np.allclose(uses[k], slope[0], atol=1e-4)  # the expected count is the slope of the log sum
    full = language.Vocabulary.of_model(pieces.read_model())
    docs = odd.documents(spark)
    got = language.predict(docs, language.fit(docs, full), full).collect()
    assert len(got) == len(odd.rows())
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if not r.text or r.text == "12 34 !!")
    assert language.fit(docs.limit(0), full) is None


def test_language_held_out(spark):
    got = language.op2_language(spark, "/root/testdata/sf0.001")
    truth = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    held = got.join(truth, "doc_id").filter("held_out")
    assert held.filter("lang_pred = lang").count() >= 0.95 * held.count()


def test_toxicity(spark):
    bad = ["this is a loser and clown", "what an idiot you are really", "total trash and a loser here"] * 10
    good = [f"plain words about thing number {i} and more of it" for i in range(60)]
    model = toxicity.fit_texts(bad + good, np.array([1] * 30 + [0] * 60))
    texts = ["a losser and clowns here", "plain words here", "", "the " * 500 + "idiot", "x\n" * 9]
    score = toxicity.score_texts(texts, model)
    assert score[0] >= 0.3 and score[3] >= 0.3 and score[1] < 0.3 and score[2] < 0.3
    assert np.allclose(score, [toxicity.score_texts([t], model)[0] for t in texts])
    docs = odd.documents(spark)
    out = toxicity.score(docs, model)
    assert out.count() == len(odd.rows()) and dict(out.dtypes)["score"] == "double"
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs.limit(0), labels).bias == -4.0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    assert got.filter("toxic = 1 and predicted = 1").count() >= 0.6 * got.filter("toxic = 1").count()
    assert got.filter("toxic = 0 and predicted = 1").count() <= 0.05 * got.filter("toxic = 0").count()


def test_hashed_search(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, (600, 1))
    x[100:160] = x[100]  # ties
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (700, None), (701, []), (702, [0.0] * 16),
            (703, [float("nan")] * 16), (704, [None] * 16), (705, [1.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = hashed_search.search(df, F.col("vec_id") % 20 == 0, fit_rows=300).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == set(range(0, 600, 20)) and all(len(v) == 20 for v in found.values())
    hits = 0
    for q, ids in found.items():
        s = hashed_search.exact_scores(x, x[q])
        s[q] = -np.inf
        hits += len(set(ids) & set(hashed_search.best(np.arange(600), s, 20).tolist()))
        assert q not in ids
    assert hits >= 0.9 * 20 * len(found)
    few = hashed_search.search(df.filter("vec_id < 8"), F.col("vec_id") == 0).collect()
    assert len(few) == 7
    assert hashed_search.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_pigeonhole_misses_nothing():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (500, 4), dtype=np.uint16)
    codes[:50] = codes[0] ^ (1 << rng.integers(0, 16, (50, 4)).astype(np.uint16))
    shard = hashed_search.Shard(codes)
    for radius in (0, 1, 3, 6, 20, 31, 64):
        away = np.bitwise_count(codes ^ codes[7]).sum(axis=1)
        assert shard.within(codes[7], radius).tolist() == np.flatnonzero(away <= radius).tolist()


def test_sentence_spans(spark):
    passage = ("The old mill by the river turned slowly in the pale light. Nobody came to grind there any more now. "
               "Only the heron kept its place among the reeds, waiting for evening. Then a cart went over the bridge.")
    data = [(1, f"Intro one here. {passage} End of first."), (2, f"word and then {passage} Different end."),
            (3, "A clean text of its own. Short. It stays."), (4, ""), (5, None), (None, passage), (2, f"word and then {passage} Different end.")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("_from", F.lit(1))
    got = {(r.doc_id, r.text): r for r in sentence_spans.dedup_spans(df).collect()}
    texts = {r.doc_id: r.text for r in got.values()}
    assert texts[1] == data[0][1] and texts[3] == data[2][1] and texts[4] == "" and texts[5] is None
    assert texts[2] == "word and then Different end." and texts[None] == passage
    assert sentence_spans.dedup_spans(df.limit(0)).count() == 0


def test_sentence_spans_equal_a_plain_walk(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    first, cut = {}, {}
    for i, t in sorted((r.doc_id, r.text or "") for r in rows):
        _, words, before = sentence_spans.cut_units(t)
        cut[i] = [(a, b, " ".join(words[before[a]:before[b]])) for a, b in
                  sentence_spans.spans(before, sentence_spans.UNITS, sentence_spans.MIN_WORDS)]
        for a, _b, s in sorted(cut[i]):
            first.setdefault(s, (i, a))
    want = {i: len({k for a, b, s in found if first[s] != (i, a) for k in range(a, b)}) for i, found in cut.items()}
    got = sentence_spans.op8_sentence_spans(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.n_removed for r in got} == want
