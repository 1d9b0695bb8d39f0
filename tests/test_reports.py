"""Series, guards, statistics, scoring, responses, tuning and incremental ingest on small tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from redline import schemas
from redline.operators import changes as C
from redline.operators import evaluation as E
from redline.operators import evidence as EV
from redline.operators import responses as R
from redline.operators import series as S
from redline.operators import spans as SP
from redline.operators import stats as ST
from redline.operators import tuning as TU
from redline.operators import vectors as V
from redline.operators.ranking import prefix_sums, rank_within
from redline.plans.change_report import diff_corpus
from redline.sources import tables as TB
from redline.streaming import ingest

Y = ["FY2023", "FY2024", "FY2025"]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def facts(spark):
    data = [("A", "Revenues", "2023-09-30", 100.0, "10-K"), ("A", "Revenues", "2023-03-31", 900.0, "10-Q"),
            ("A", "Revenues", "2025-09-30", 489.0, "10-K"), ("A", "Assets", "2023-09-30", 0.0, "10-K"), ("A", "Assets", "2024-09-30", 7.0, "8-K"),
            ("A", "Assets", "2025-09-30", -7.0, "10-K"), ("A", "Revenues", None, 3.0, "10-K"), ("A", "Revenues", "2024-01-01", None, "10-K")]
    return spark.createDataFrame(data, "ticker string, tag string, end string, val double, form string").withColumn("end", F.to_date("end"))


def test_series_with_gap_and_zero(spark, facts):
    annual = S.fiscal_year_value(S.fact_values(facts))
    assert rows(S.metric_series(annual, Y).filter("tag = 'Revenues'"), "fy", "value", "pct") == [
        ("FY2023", 100.0, None), ("FY2024", None, None), ("FY2025", 489.0, None)]
    assert rows(S.yoy_deltas(annual, Y), "tag", "y_old", "old", "new", "abs_change", "pct_change") == [
        ("Assets", "FY2023", 0.0, 7.0, 7.0, None), ("Assets", "FY2024", 7.0, -7.0, -14.0, -200.0),
        ("Revenues", "FY2023", 100.0, None, -100.0, None), ("Revenues", "FY2024", None, 489.0, 489.0, None)]
    sig = S.metric_change_signal(S.yoy_deltas(annual, ["FY2023", "FY2025"])).collect()
    assert [(r.anchor, r.tag, r.pct) for r in sig] == [("income_statement", "Revenues", 3.89)]


def test_generated_questions_and_gold_span(spark):
    d = datetime.date
    f = spark.createDataFrame([("A", "Revenues", "USD", 0, d(2024, 10, 1), d(2025, 9, 30), 391e9, "10-K", "FY"),
                               ("A", "NetIncomeLoss", "USD", 0, d(2024, 10, 1), d(2025, 9, 30), 1e6, "10-K", "FY"),
                               ("A", "NetIncomeLoss", "USD", 1, d(2024, 10, 1), d(2025, 9, 30), 2e6, "10-K", "FY"),
                               ("A", "NetIncomeLoss", "USD", 2, d(2024, 10, 1), d(2024, 9, 30), 3e6, "10-K", "FY")],
                              "ticker string, tag string, unit string, pos int, start date, end date, val double, form string, fp string")
    docs = spark.createDataFrame([("A", d(2025, 9, 30), 0)], "ticker string, period_end date, ticker_order int")
    q = S.generate_questions(f, docs).orderBy("id").collect()
    assert [(r.id, r.answer.value, r.answer.text) for r in q] == [
        ("a-fy2025-netincomeloss-002", 1e6, "$1 million"), ("a-fy2025-revenues-001", 391e9, "$391.0 billion")]
    t = spark.createDataFrame([("xx Consolidated Balance Sheets yy",)], "t string")
    assert t.select(S.gold_span(F.col("t"), F.lit("balance_sheet")).alias("s"), S.gold_span(F.col("t"), F.lit("cash_flow")).alias("n")).first()[:] == ([3, 33], None)


def test_rank_by_levels_equals_plain_rank(spark):
    df = spark.createDataFrame([(random.Random(i).choice("ab"), i, i // 7) for i in range(200)], "k string, i long, g long").repartition(5)
    plain = rows(rank_within(df, ["k"], [F.col("i")], "r"), "k", "i", "r")
    assert rows(rank_within(df, ["k"], [F.col("i")], "r", [F.floor(F.col("i") / 50), F.col("g")]), "k", "i", "r") == plain
    summed = {(r.k, r.i): r.base for r in prefix_sums(df.withColumn("v", F.lit(1)), ["k"], "i", "v", block_size=16).collect()}
    assert all(summed[(k, i)] == r for k, i, r in plain)


ALIGNED = "ticker string, anchor string, y_old string, y_new string, kind string, old_idx long, new_idx long, similarity double, old_text string, new_text string"


def aligned(spark, data, anchor="a"):
    return spark.createDataFrame([("T", anchor, "FY1", "FY2", *d) for d in data], ALIGNED)


def test_text_guard_and_numbering(spark):
    data = [("matched", 0, 0, 0.99, "sales were $100 million", "sales were $489 million"), ("matched", 1, 1, 0.98, "same 5", "same 5"),
            ("matched", 2, 2, 0.85, "one two", "one three"), ("added", -1, 3, 0.0, "", "brand new"), ("removed", 3, -1, 0.0, "old one", "")]
    for bounded in (True, False):
        got = C.diff_records(aligned(spark, data), bounded_sections=bounded).orderBy("change_seq").collect()
        by = {(r.old_idx, r.new_idx): r for r in got}
        assert by[0, 0].classification == "modified_major" and by[0, 0].numeric_guard.pct == 3.89 and by[0, 0].change_id.endswith("-000")
        assert by[1, 1].classification == "unchanged" and by[1, 1].change_id == "T-a-FY1-FY2" and by[1, 1].change_seq is None
        assert by[2, 2].change_id.endswith("-001") and by[2, 2].word_delta.added == ["three"] and by[2, 2].word_delta.removed == ["two"]
        assert by[-1, 3].change_id.endswith("-002") and by[-1, 3].word_delta.added == ["brand", "new"]
        assert by[3, -1].change_id.endswith("-003") and by[3, -1].word_delta.removed == ["old", "one"]


def test_metric_guard_raises_the_densest_row_of_a_quiet_section(spark):
    signal = spark.createDataFrame([("T", "FY1", "FY2", "income_statement", "Revenues", 100.0, 489.0, 3.89), ("T", "FY1", "FY2", "a", "X", 1.0, 2.0, 1.0)],
                                   "ticker string, y_old string, y_new string, anchor string, tag string, old double, new double, pct double")
    quiet = [("matched", 0, 0, 0.99, "no number", "no number"), ("matched", 1, 1, 0.97, "5 and 6", "5 and 6"), ("matched", 2, 2, 0.96, "7 and 8", "7 and 8")]
    got = C.diff_records(aligned(spark, quiet, "income_statement"), signal, bounded_sections=True).filter("classification <> 'unchanged'").collect()
    assert [(r.old_idx, r.classification, r.numeric_guard.source, r.numeric_guard.tag) for r in got] == [(1, "modified_major", "xbrl", "Revenues")]
    assert C.diff_records(aligned(spark, quiet), signal, bounded_sections=True).filter("classification <> 'unchanged'").isEmpty()
    busy = quiet + [("added", -1, 3, 0.0, "", "x")]
    got = C.diff_records(aligned(spark, busy, "income_statement"), signal, bounded_sections=True)
    assert rows(got.filter("classification <> 'unchanged'"), "classification") == [("added",)]


def test_churn_and_stats(spark):
    data = [("matched", 0, 0, 0.99, "aaaa", "aaaa"), ("matched", 1, 1, 0.7, "bb", "bbbb"), ("added", -1, 2, 0.0, "", "cccc")]
    rec = C.diff_records(aligned(spark, data), bounded_sections=True, with_words=False)
    assert ST.churn(rec, ["anchor"]).first().churn == 0.5
    assert ST.churn(rec, ["anchor"], include_unmatched=True).first().churn == pytest.approx(2 / 3)
    assert ST.churn(rec.filter("kind = 'added'"), ["anchor"]).first().churn == 0.0
    st = ST.section_stats(rec)
    assert rows(st, "anchor", "n_records", "max_churn", "avg_churn") == [("a", 3, 0.5, 0.5)]
    assert ST.reported_sections(st).isEmpty() and ST.omitted_sections(st).first().sections_omitted == 1
    assert [tuple(r) for r in ST.breakdown(rec).orderBy("class_order").select("label", "n", "pct").collect()] == [
        ("Unchanged", 1, 33.3), ("Major revision", 1, 33.3), ("Newly added", 1, 33.3)]
    assert ST.change_stats(rec).first()[:] == ("T", 3, 2, 0)
    t = spark.createDataFrame([("k", "w " * 330), ("k", "w " * 220), ("j", "w")], "k string, text string")
    assert rows(ST.read_time(t, ["k"]), "k", "read_time") == [("j", 1), ("k", 2)]


def test_diff_of_a_small_corpus_covers_both_sides_once(spark):
    docs = [("T", "FY1", "a", 0, "alpha beta gamma delta\n\nold words only here"), ("T", "FY2", "a", 0, "alpha beta gamma delta"),
            ("T", "FY2", "a", 1, "entirely fresh sentence"), ("T", "FY2", None, 0, "lost section"), ("T", "FY3", "a", 0, "alpha beta gamma delta"), ("U", "FY1", "a", 0, "alone")]
    df = spark.createDataFrame(docs, "ticker string, fiscal_year string, anchor string, chunk_no int, text string")
    got = diff_corpus(df).orderBy("y_old", "anchor", "change_id").collect()
    assert [(r.y_old, r.anchor, r.classification) for r in got] == [
        ("FY1", "a", "unchanged"), ("FY1", "a", "added"), ("FY1", "a", "removed"), ("FY1", "unknown", "added"),
        ("FY2", "a", "unchanged"), ("FY2", "a", "removed"), ("FY2", "unknown", "removed")]
    # sections beyond the per-task bound take the distributed path and give the same records
    large = diff_corpus(df, limits={"max_cells": 0}).orderBy("y_old", "anchor", "change_id").collect()
    assert [r.asDict(True) for r in large] == [r.asDict(True) for r in got]
    # the result does not depend on how the rows arrive
    again = diff_corpus(df.repartition(7).orderBy(F.rand(3))).orderBy("y_old", "anchor", "change_id").collect()
    assert [(r.change_id, r.old_text, r.new_text) for r in again] == [(r.change_id, r.old_text, r.new_text) for r in got]


def test_retrieval_score(spark):
    hits = spark.createDataFrame([(1, "x", 0, 10), (1, "y", 50, 150), (1, "none", 500, 600), (2, "none", 90, 110), (2, None, 300, 400)],
                                 "q int, anchor string, span_start int, span_end int")
    gold = spark.createDataFrame([(1, ["x", "z", "unknown"], [[100, 200]]), (2, [], [[100, 200], [400, 500]]), (3, ["x"], None)],
                                 "q int, gold_chunks array<string>, gold_spans array<array<int>>")
    got = E.retrieval_score(hits, gold, ["q"])
    assert rows(got, "q", "n_anchor_hits", "n_span_hits", "retrieval_recall", "retrieval_hit") == [
        (1, 1, 1, 0.5, True), (2, 0, 1, 0.5, True), (3, 0, 0, 0.0, False)]
    assert [r.retrieval_precision for r in got.orderBy("q").collect()] == [pytest.approx(2 / 3), 0.5, 0.0]


def test_spans_and_passages(spark):
    a = spark.createDataFrame([("d", 1, 0, 5000), ("d", 2, 5000, 5001)], "d string, i int, start long, end long")
    b = spark.createDataFrame([("d", 9, 4999, 5000), ("d", 8, 5000, 9000), ("e", 7, 0, 1)], "d string, j int, r_start long, r_end long")
    assert rows(SP.span_overlap(a, b, ["d"], 100), "i", "j") == [(1, 9), (2, 8)]
    docs = spark.createDataFrame([(1, "aa the quick brown fox jumps over it zz"), (2, "the quick brown fox jumped over"), (3, "xthe quick brownx")], "doc_id int, text string")
    ps = spark.createDataFrame([(1, "he quick brown fox jumps ov"), (2, "the quick brown")], "item_id int, text string")
    assert rows(SP.find_passages(docs, ps), "doc_id", "item_id", "start") == [(1, 1, 4), (1, 2, 3), (2, 2, 0), (3, 2, 1)]


def test_votes_runs_and_best(spark):
    v = spark.createDataFrame([(1, True), (1, True), (1, False), (2, False), (2, False), (2, False)], "q int, verdict boolean")
    votes = E.majority_vote(v, ["q"])
    assert rows(votes, "q", "faithful", "disagreement") == [(1, True, True), (2, False, False)]
    assert ST and E.vote_report(votes).first()[:] == (2, 1, 1)
    a = spark.createDataFrame([("c", 1, True), ("c", 2, None), ("c", 3, False)], "config string, question_id int, joint_correct boolean")
    b = spark.createDataFrame([("c", 1, True), ("c", 2, False), ("c", 3, False)], "config string, question_id int, joint_correct boolean")
    assert rows(E.diff_runs(a, b), "question_id", "now", "was") == [(2, None, False)]


def test_cited_scale_and_context(spark):
    h = spark.createDataFrame([(1, 1, 0.0, "c1", "t", None, "x"), (1, 2, 1e6, "c2", None, "a", "y"), (1, 3, 1e3, "c3", "t", "a", "z"), (2, 4, 1e3, "c", "t", "a", "w")],
                              "query_id int, rank int, table_scale double, chunk_id string, ticker string, anchor string, text string")
    assert rows(E.cited_scale(h, ["query_id"]), "query_id", "table_scale") == [(1, 1e6), (2, None)]
    assert V.assemble_context(h.filter("rank < 3")).first().context == "[chunk_id=c1 ticker=t anchor=?]\nx\n\n-----\n\n[chunk_id=c2 ticker=? anchor=a]\ny"


def test_embedding_is_unit_and_keyed(spark):
    df = V.embed(spark.createDataFrame([("a b a",), ("",)], "text string"))
    vs = [r.vector for r in df.collect()]
    assert sum(x * x for x in vs[0]) == pytest.approx(1) and sum(vs[1]) == 0 and len(vs[0]) == 128
    with pytest.raises(ValueError):
        V.embed(df, model_key="nope")


def test_inverted_file_finds_the_neighbours_of_clustered_rows(spark, monkeypatch):
    """Recall against the exact scan, exact scores, few probes on clustered rows, crowded lists and popular probes in parts."""
    import numpy as np
    from redline.operators import ivf
    monkeypatch.setattr(ivf, "PART_ROWS", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    x = centres[np.concatenate([np.zeros(600, int), rng.integers(0, 30, 1200)])] + 0.25 * rng.normal(size=(1800, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<double>").repartition(4)
    q = df.filter("chunk_id % 12 = 0").withColumnRenamed("chunk_id", "query_id")
    index = ivf.build_ivf(df, k=10)
    assert index.probes < len(index.centres) / 2 and index.rows.count() == 1800
    got = ivf.search_ivf(q, ivf.read_ivf(spark, index.path), 10)
    near = {(r.query_id, r.chunk_id): r.similarity for r in got.collect()}
    exact = [(r.query_id, r.chunk_id) for r in V.vector_topk(q, df, 10).collect()]
    assert len(near) == len(exact) == 1500
    assert all(abs(s - x[a] @ x[b]) < 1e-8 for (a, b), s in near.items())
    assert sum(p in near for p in exact) >= 0.9 * len(exact)


def test_inverted_file_tops_up_short_answers_and_takes_awkward_rows(spark):
    from redline.operators import ivf
    rows_ = [(i, [1.0, 0.0] if i < 9 else [0.0, 1.0]) for i in range(10)] + [(None, [1.0, 0.0]), (50, None), (51, [None, 1.0]), (52, [])]
    df = spark.createDataFrame(rows_, "chunk_id long, vector array<double>")
    q = df.withColumnRenamed("chunk_id", "query_id")
    index = ivf.build_ivf(df, k=3, n_lists=2)
    got = ivf.search_ivf(q, index, 3, probes=1).orderBy("query_id", "rank").collect()
    assert [r.query_id for r in got] == [i for i in range(10) for _ in range(3)]
    assert [(r.chunk_id, r.similarity) for r in got[-3:]] == [(9, 1.0), (0, 0.0), (1, 0.0)]  # its list holds one row
    assert ivf.build_ivf(df.limit(0)) is None
    assert len(ivf.search_ivf(q, index, 99).collect()) == 100  # the whole corpus where it is smaller than k


def test_responses_parse_and_reconcile(spark):
    ok = '{"change_id": "c-001", "change_type": "added", "materiality": "notable", "old_quote": "", "new_quote": "new"}'
    texts = [f"```json\n[{ok}]\n```", ok, f"Sure: [{ok}] done", "nothing", "[broken", f"```\n{ok}\n```", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in df.select("i", F.size(R.parse_responses(F.col("t"))).alias("n")).orderBy("i").collect()]
    assert got == [1, 1, 1, 0, 0, 1, 0]
    diffs = spark.createDataFrame([("c-001", "old text", "new text"), ("c-002", "o", "n"), ("c-003", "o", "n"), ("c-004", "o", "n")], "change_id string, old_text string, new_text string")
    batches = spark.createDataFrame([("k", 0, "c-001"), ("k", 0, "c-002"), ("k", 0, "c-003"), ("k", 1, "c-004")], "k string, batch_no int, change_id string")
    bad = ok.replace("c-001", "c-002").replace('"new"', '"nope"')
    first = spark.createDataFrame([("k", 0, f"[{ok},{bad}]"), ("k", 1, "[TIMEOUT]")], "k string, batch_no int, text string")
    retry = spark.createDataFrame([("k", 0, f"[{bad.replace('nope', 'n')},{ok.replace('c-001', 'c-003').replace('added', 'odd').replace('new\"}', 'n\"}')}]")], "k string, batch_no int, text string")
    got = rows(R.reconcile(batches, first, diffs, retry, ["k"]), "change_id", "unvalidated", "validated_on_retry", "summary", "validation_error")
    assert got == [("c-001", False, False, None, None), ("c-002", False, True, None, None),
                   ("c-003", True, False, "LLM did not interpret this change", "invalid change_type: odd"),
                   ("c-004", True, False, "LLM call failed: [TIMEOUT]", None)]


def test_evidence_order_cap_and_citations(spark):
    data = [("T", "item1a_risk", "T-x-002", "notable", "FY2", False), ("T", "item1a_risk", "T-x-010", "material", "FY2", False),
            ("T", "item1a_risk", "T-x-009", "material", "FY2", False), ("T", "item1a_risk", "T-x-001", "material", "FY1", True),
            ("T", "item2_properties", "T-y-001", "material", "FY1", False), ("T", "item1a_risk", "T-x-003", "boilerplate", "FY1", False)]
    i = spark.createDataFrame(data, "ticker string, anchor string, change_id string, materiality string, y_new string, unvalidated boolean")
    pool = EV.evidence_pool(i, k=2)
    assert rows(pool, "label", "change_id") == [("E1", "T-x-009"), ("E2", "T-x-010")]
    t = spark.createDataFrame([("T", "risk", "b [E2] a [E1] c [E2] z [E99].")], "ticker string, chapter string, text string")
    notes = EV.resolve_citations(t, pool, ["ticker", "chapter"])
    assert rows(notes, "n", "label") == [(1, "E2"), (2, "E1")]
    assert EV.renumber_citations(t, notes, ["ticker", "chapter"]).first().text == "b [1] a [2] c [1] z ."


def test_threshold_grid_equals_direct_count(spark):
    rng = random.Random(1)
    data = [(f"c{i}", rng.random() * 0.4 + 0.6, rng.choice(TU.CLASSES + ["added"])) for i in range(60)]
    df = spark.createDataFrame(data, "change_id string, similarity double, label string")
    for r in TU.evaluate_grid(df, [(0.95, 0.81), (0.85, 0.65)]).collect():
        def said(s):
            return "unchanged" if s >= r.unchanged else "modified_minor" if s >= r.minor else "modified_major"
        for c in TU.CLASSES:
            assert r[f"{c}_tp"] == sum(said(s) == c == y for _, s, y in data)
            assert r[f"{c}_fp"] == sum(said(s) == c != y for _, s, y in data)
        tp = sum(said(s) == y for _, s, y in data)
        assert r.micro_precision == pytest.approx(tp / 60) and r.micro_recall == pytest.approx(tp / sum(y in TU.CLASSES for _, _, y in data))
    assert TU.reject_unknown_labels(df).count() == sum(y == "added" for _, _, y in data)
    best = TU.grid_search(df)
    assert best["unchanged"] > best["minor"] and 0 <= best["held_out_f1"] <= 1
    assert TU.grid_search(df.limit(5))["unchanged"] == 0.95


def test_store_round_trips(spark, tmp_path):
    rec = C.diff_records(aligned(spark, [("added", -1, 0, 0.0, "", "x")]), bounded_sections=True)
    for _ in range(2):
        TB.write_diffs(rec, str(tmp_path / "d"))
    assert TB.read_diffs(spark, str(tmp_path / "d")).select("ticker", "y_old", "y_new", "change_id").collect()[0][:] == ("T", "FY1", "FY2", "T-a-FY1-FY2-000")
    assert TB.read_interpretations(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "q.jsonl").write_text('{"id": "q1", "type": "x"}\n\n{"id": "q2", "gold_spans": [[1, 2]]}\n')
    assert rows(TB.read_jsonl(spark, str(tmp_path / "q.jsonl"), schemas.QUESTIONS), "id") == [("q1",), ("q2",)]


@pytest.mark.parametrize("arrivals", [("1", "3", "2"), ("1", "4", "23"), ("4", "3", "2", "1")])
def test_streamed_years_equal_one_batch(spark, tmp_path, arrivals):
    schema = "ticker string, fiscal_year string, anchor string, chunk_no int, text string"
    years = sorted("".join(arrivals))
    docs = [("T", f"FY{y}", "a", c, f"common words here {c}\n\nyear {y} only {c} words") for y in years for c in (0, 1)]
    src = str(tmp_path / "in")
    from pyspark.sql.types import _parse_datatype_string

    def land(rows_):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(src)
        stream = ingest.watch_documents(spark, src, _parse_datatype_string(schema))
        ingest.start_diffing(stream, str(tmp_path / "store"), str(tmp_path / "diffs"), str(tmp_path / "cp")).awaitTermination()

    for group in arrivals:
        land([d for d in docs if d[1][2:] in group])
    cols = ["y_old", "y_new", "change_id", "classification", "new_text"]
    whole = diff_corpus(spark.createDataFrame(docs, schema))
    assert rows(TB.read_diffs(spark, str(tmp_path / "diffs")), *cols) == rows(whole, *cols)
    # a filing that comes again, corrected and shorter, replaces the first delivery
    again = ("T", "FY3", "a", 0, "common words here 0\n\none two five corrected")
    land([again])
    whole = diff_corpus(spark.createDataFrame([d for d in docs if d[1] != "FY3"] + [again], schema))
    assert rows(TB.read_diffs(spark, str(tmp_path / "diffs")), *cols) == rows(whole, *cols)


def test_short_passages_are_found_inside_words(spark):
    docs = spark.createDataFrame([(1, "the catalogue of rare birds"), (2, "a cat"), (3, None), (4, "")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "cat"), (2, "e of"), (3, "catalogue of rare birds"), (4, ""), (5, None), (6, "logue of ra")],
                                  "item_id int, text string")
    got = rows(SP.find_passages(docs, asked), "item_id", "doc_id", "start", "end")
    assert got == [(1, 1, 4, 7), (1, 2, 2, 5), (2, 1, 12, 16), (3, 1, 4, 27), (6, 1, 8, 19)]


def test_unseen_documents(spark):
    arrived = spark.createDataFrame([("T", "FY1"), ("T", "FY2")], "ticker string, fiscal_year string")
    assert rows(ingest.unseen(arrived, arrived.limit(1), ["ticker", "fiscal_year"]), "ticker") == [("T",)]


def test_chunks_of_one_number_are_numbered_apart_and_copies_are_an_error(spark):
    from redline.operators.pairing import explode_paragraphs
    schema = "ticker string, fiscal_year string, anchor string, chunk_no int, text string"
    two = [("T", "FY1", "a", 0, "p\n\nq"), ("T", "FY1", "a", 0, "r\n\ns"), ("T", "FY1", "a", 1, "t")]
    got = rows(explode_paragraphs(spark.createDataFrame(two, schema)), "idx", "text")
    assert [i for i, _ in got] == [0, 1, 2, 3, 4] and sorted(t for _, t in got) == list("pqrst") and got[4][1] == "t"
    with pytest.raises(Exception, match="chunk stored twice"):
        explode_paragraphs(spark.createDataFrame([two[0], two[0]], schema)).collect()


def test_word_delta_keeps_a_longest_common_subsequence(spark):
    rnd = random.Random(3)
    pairs = [(i, " ".join(rnd.choices("abcd", k=rnd.randint(1, 12))), " ".join(rnd.choices("abcd", k=rnd.randint(1, 12))))
             for i in range(60)]
    df = spark.createDataFrame(pairs, "i int, old_text string, new_text string")
    got = {r.i: r.word_delta for r in C.word_delta(df).collect()}

    def common(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x in range(len(a)):
            for y in range(len(b)):
                best[x + 1][y + 1] = best[x][y] + 1 if a[x] == b[y] else max(best[x][y + 1], best[x + 1][y])
        return best[-1][-1]

    for i, old, new in pairs:
        o, n = old.split(), new.split()
        size = common(o, n)
        assert len(got[i].removed) == len(o) - size and len(got[i].added) == len(n) - size
        assert common(got[i].added, n) == len(got[i].added) and common(got[i].removed, o) == len(got[i].removed)


def test_a_response_is_one_complete_value(spark):
    from redline.operators.responses import parse_responses
    cases = [('[{"change_id":"a"}] and also [note]', 0), ('So: [{"change_id":"a"}] ok', 1), ('{"change_id":"a"}', 1),
             ('```json\n[{"change_id":"a"},{"change_id":"b"}]\n```', 2), ('[{"change_id":"a"}], [{"change_id":"b"}]', 0),
             ("", 0), ("[]", 0), (None, 0), ('[{"change_id":"a"}', 0)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r.n for r in df.orderBy("i").select(F.size(parse_responses(F.col("t"))).alias("n")).collect()] == [n for _, n in cases]
