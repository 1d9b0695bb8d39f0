"""Cases outside the usual range that once broke a contract."""

import math
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_llm_operators import brute_chance  # noqa: E402

from redline.llm import hashed_search, language, pieces  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_language_of_rare_letters_and_long_words(spark):
    """Runs of letters that no piece holds, alone and beside known text, never leave the range of numbers."""
    vocab = language.Vocabulary({p: i for i, p in enumerate(["▁", "a", "b", "ab", "ba"])})
    chance = np.random.default_rng(2).dirichlet(np.full(vocab.size, 0.01), 3).T + 1e-12
    for word in ("aébab", "ਖ" * 4 + "ab", "abba", "é"):
        assert np.allclose(language.forward([word, "a"], vocab, chance)[0][0], brute_chance(word, vocab, chance))
    full = language.Vocabulary.of_model(pieces.read_model())
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"), full)
    known = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en' and n_chars > 300").first().text
    rare = "".join(chr(0x5000 + 7 * i) for i in range(24))
    inuktitut = "".join(chr(0x1401 + i) for i in range(18))
    texts = [rare, inuktitut + " " + known, known, rare * 400, known + " " + rare * 400, "x" * 100_000, "ß" * 5000]
    got = {r.i: r for r in language.predict(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model,
                                            full).collect()}
    assert all(math.isfinite(r.score) and 0 <= r.score <= 1 for r in got.values())
    assert got[1].lang_pred == got[2].lang_pred == "en"
    every = language.predict(spark.read.parquet(f"{SF}/documents.parquet"), model, full)
    assert every.filter("score is null or isnan(score) or score < 0 or score > 1").count() == 0


def test_language_learns_from_long_texts_only(spark):
    """A language whose labelled texts are all long is learned from whole texts."""
    docs = [(i, ("alpha beta " if i % 2 else "gamma delta ") * 3000, "aa" if i % 2 else "bb") for i in range(40)]
    full = language.Vocabulary.of_model(pieces.read_model())
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = language.predict(df, language.fit(df, full), full).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_hashed_search_of_few_rows(spark):
    schema = "vec_id long, embedding array<double>"
    for n in range(4):
        rows = [(i, [1.0, float(i)]) for i in range(n)]
        got = hashed_search.search(spark.createDataFrame(rows, schema), F.col("vec_id") >= 0).collect()
        assert sorted((r.query_id, r.vec_id) for r in got) == [(a, b) for a in range(n) for b in range(n) if a != b]


def test_hashed_search_of_mixed_lengths_and_repeated_ids(spark):
    """The most frequent length stands, whichever rows a hash puts first; ids with several vectors count once."""
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=8).tolist()) for i in range(100)]
    odd = [(1000 + i, [1.0, 2.0, 3.0]) for i in range(60)]
    twice = [(5, good[5][1]), (6, [9.0] * 8), (7, [1.0, 2.0])]
    df = spark.createDataFrame(odd + good + twice, "vec_id long, embedding array<double>").repartition(3)
    got = hashed_search.search(df, F.col("vec_id") % 20 == 0, k=20).collect()
    vectors = dict(good)
    vectors[6] = min(good[6][1], [9.0] * 8)
    assert {r.query_id for r in got} == {0, 20, 40, 60, 80} and len(got) == 100
    for r in got:
        assert abs(r.score - np.dot(vectors[r.query_id], vectors[r.vec_id])) < 1e-12


def test_url_filter_keeps_columns_of_clashing_names(spark):
    from redline.llm import url_filter
    schema = "u string, _block int, _mask string, _word int, _maybe string, _key int, listed int"
    df = spark.createDataFrame([("a", 1, "m", 2, "n", 3, 9), ("b", 4, "o", 5, "p", 6, 9), (None, 7, None, 8, "q", None, 9)], schema)
    keys = spark.createDataFrame([("b",), ("c",), (None,)], "_key string")
    got = url_filter.mark_listed(df, "u", keys, "_key", "listed")
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("a", 1, "m", 2, "n", 3, False), ("b", 4, "o", 5, "p", 6, True), (None, 7, None, 8, "q", None, False)], key=str)
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, keys, "_key").collect() == []
