"""Hashed vectors from Arrow columns, trimming of paragraphs, and alignment without texts."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from redline.functions.text import WHITE_SPACE, paragraphs
from redline.operators import matching as M
from redline.operators.vectors import hashed_embedder, md5_heads


def test_md5_heads_of_tokens_of_every_length():
    tokens = ["", "a", *("x" * n for n in range(50, 70)), "ü" * 27, "ü" * 28, "日本" * 40, *(str(i) * (i % 9) for i in range(9000))]
    column = pa.array(tokens, pa.large_string())
    for part, want in ((column, tokens), (column.slice(3, 40), tokens[3:43]), (column.slice(0, 0), [])):
        got = md5_heads(part)
        assert [g.tobytes() for g in got] == [hashlib.md5(t.encode()).digest()[:8] for t in want]


@pytest.mark.parametrize("dim", [128, 1000])
def test_hashed_vectors_of_lists_and_columns(dim):
    texts = ["b a  a", "", " ", "long " + "y" * 99, "ä b"]
    want = np.zeros((len(texts), dim))
    for r, text in enumerate(texts):
        for token in filter(None, text.split(" ")):
            want[r, int.from_bytes(hashlib.md5(token.encode()).digest()[:1 if dim <= 256 else 8], "big") % dim] += 1
    norms = np.linalg.norm(want, axis=1, keepdims=True)
    want = np.divide(want, norms, out=np.zeros_like(want), where=norms > 0)
    embed = hashed_embedder(dim)
    for given in (texts, pa.array(texts), pa.array(["dropped", *texts]).slice(1)):
        assert np.allclose(embed(given), want, atol=1e-15)
    assert embed([]).shape == (0, dim)


def test_paragraphs_are_trimmed_of_every_white_end(spark):
    inner = "a" + WHITE_SPACE.replace("\n", "") + "b"
    text = "\n".join(["", inner, " x", "x　", " \x85y z\x1c", *WHITE_SPACE.replace("\n", ""), "é", ""])
    df = spark.createDataFrame([(text,), ("",), (None,), ("one",), ("a.b|c",)], "text string")
    got = [r[0] for r in df.select(paragraphs(F.col("text"), "\n")).collect()]
    assert got == [[inner, "x", "x", "y z", "é"], [], None, ["one"], ["a.b|c"]]
    for sep in (".", "|", "$"):
        assert spark.createDataFrame([(f"a {sep} b{sep}",)], "text string").select(
            paragraphs(F.col("text"), sep)).collect()[0][0] == ["a", "b"]


def test_alignment_without_texts_has_the_same_rows(spark):
    rows = [("k", side, i, f"{'even' if i % 2 else 'odd'} words of paragraph {i % 5}") for side in ("old", "new")
            for i in range(9 if side == "old" else 7)] + [("only", "new", 0, "nothing to pair")]
    sides = spark.createDataFrame(rows, "k string, side string, idx long, text string")
    whole = M.align_bounded(sides, 0.5, ["k"], "hashed")
    bare = M.align_bounded(sides, 0.5, ["k"], "hashed", texts_out=False)
    assert "old_text" not in bare.columns
    columns = ["k", "kind", "old_idx", "new_idx", "similarity"]
    assert sorted(map(tuple, whole.select(*columns).collect())) == sorted(map(tuple, bare.select(*columns).collect()))
    texts = {(s, i): t for k, s, i, t in rows if k == "k"}
    for r in whole.filter("k = 'k'").collect():
        assert r.old_text == texts.get(("old", r.old_idx), "") and r.new_text == texts.get(("new", r.new_idx), "")


def test_vectors_of_unequal_length_are_an_error(spark):
    sides = spark.createDataFrame([("k", "old", 0, [1.0, 0.0]), ("k", "old", 1, [1.0, 0.0, 0.0, 0.0]),
                                   ("k", "new", 0, [1.0, 0.0])], "k string, side string, idx long, vector array<double>")
    with pytest.raises(Exception, match="differ in length"):
        M.align_bounded(sides, 0.5, ["k"]).collect()


def _alignments(df):
    """How often a plan aligns paragraphs."""
    return df._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInArrow")


def test_the_alignment_behind_statistics_and_guards_is_computed_once(spark):
    from redline.operators import stats as S
    from redline.plans.change_report import align_corpus, diff_corpus

    docs = spark.createDataFrame(
        [("T", f"FY{y}", anchor, 0, f"the total was ${y - 2000} for {anchor}\nsame words in every year")
         for y in (2021, 2022, 2023) for anchor in ("business", "income_statement", None)],
        "ticker string, fiscal_year string, anchor string, chunk_no long, text string")
    records = align_corpus(docs, sep="\n")[0].withColumn("classification", F.lit("unchanged"))
    stats = S.section_stats(records)
    assert _alignments(stats) == 0  # the rows per section pair are kept
    assert sorted((r.anchor, r.n_records) for r in stats.collect()) == [
        ("business", 4), ("income_statement", 4), ("unknown", 4)]
    signal = spark.createDataFrame([("T", "FY2021", "FY2022", "income_statement", "Revenues", 1.0, 2.0, 1.0)],
                                   "ticker string, y_old string, y_new string, anchor string, tag string, old double, new double, pct double")
    guarded = diff_corpus(docs, sep="\n", signal=signal, with_words=False)
    assert _alignments(guarded) == 1
    rows = guarded.collect()
    assert len(rows) == 12 and {r.anchor for r in rows} == {"business", "income_statement", "unknown"}
    plain = diff_corpus(docs, sep="\n", with_words=False).collect()
    unguarded = lambda rs: sorted((r.anchor, r.y_old, r.old_idx, r.new_idx, r.similarity) for r in rs)
    assert unguarded(rows) == unguarded(plain)


def test_stored_vectors_are_those_of_the_task(spark):
    from redline.operators.vectors import embed

    texts = ["b a  a", "", None, "ä b", "x" * 80]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    got = {r.i: r.vector for r in embed(df, "text").collect()}
    want = hashed_embedder()([t or "" for t in texts])
    assert len(got) == len(texts) and np.allclose([got[i] for i in range(len(texts))], want, atol=1e-15)


def test_lengths_leave_the_alignment_in_place_of_texts(spark):
    old = ["alpha beta gamma delta", "alpha beta gamma delta é 10", "one two three", "nothing like it"]
    new = ["alpha beta gamma delta", "alpha beta gamma delta é 20", "one two three four", "quite another thing", "日本 😀"]
    sides = spark.createDataFrame([("k", side, i, t) for side, ts in (("old", old), ("new", new)) for i, t in enumerate(ts)],
                                  "sec string, side string, idx long, text string")
    large = spark.createDataFrame([("k",)], "sec string")
    for given in (None, large):
        whole = {(r.kind, r.old_idx, r.new_idx): r for r in M.align_sides(sides, 0.5, ["sec"], "hashed", given).collect()}
        sized = M.align_sides(sides, 0.5, ["sec"], "hashed", given, texts_out=False, chars_out=True)
        assert sized.columns == ["sec", "kind", "old_idx", "new_idx", "similarity", "old_chars", "new_chars"]
        rows = sized.collect()
        assert len(rows) == len(whole)
        for r in rows:
            w = whole[r.kind, r.old_idx, r.new_idx]
            assert (r.similarity, r.old_chars, r.new_chars) == (w.similarity, len(w.old_text), len(w.new_text))


def test_only_like_but_different_pairs_bring_their_texts(spark):
    old = ["alpha beta gamma delta", "kappa mu 10 " + "nu " * 9, "one two three", "nothing like it"]
    new = ["alpha beta gamma delta", "kappa mu 20 " + "nu " * 9, "one two three four", "quite another thing"]
    sides = spark.createDataFrame([("k", side, i, t) for side, ts in (("old", old), ("new", new)) for i, t in enumerate(ts)],
                                  "sec string, side string, idx long, text string")
    for given in (None, spark.createDataFrame([("k",)], "sec string")):
        whole = M.align_sides(sides, 0.5, ["sec"], "hashed", given).collect()
        shown = {(r.kind, r.old_idx, r.new_idx): r for r in M.align_sides(sides, 0.5, ["sec"], "hashed", given, alike=0.95).collect()}
        assert len(shown) == len(whole) and any(r.old_text for r in shown.values())
        for w in whole:
            sent = w.kind == "matched" and w.similarity >= 0.95 and w.old_text != w.new_text
            r = shown[w.kind, w.old_idx, w.new_idx]
            assert (r.similarity, r.old_text, r.new_text) == (w.similarity, *((w.old_text, w.new_text) if sent else ("", "")))


def test_churn_reads_no_texts_behind_the_alignment(spark, sf_dir="/root/testdata/sf0.001"):
    from redline import catalogue
    catalogue.load_all()
    for name in ("section_churn", "section_churn_matrix"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        out = [line for line in plan.split("\n") if "FlatMapGroupsInArrow" in line]
        assert out and all("old_text" not in line for line in out)
