"""Column functions against hand-worked cases and small plain-Python restatements."""

import re

import pytest
from pyspark.sql import functions as F

from redline import dims
from redline.functions import answers as A
from redline.functions import headings as H
from redline.functions import money as M
from redline.functions import numbers as N
from redline.functions import text as T


def one(spark, values, fn, kind="string"):
    """Apply a one-column function to a list, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)
    return [r.r for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


NUMBER_CASES = [
    ("Revenue was $391.0 billion", [391e9]), ("(1,234)", [-1234.0]), ("$ (5.5) million", [-5.5e6]), ("-12.5", [-12.5]),
    ("a net loss of $3 million", [-3e6]), ("up 9.2%", [9.2, 0.092]), ("9.2 percent", [9.2, 0.092]), ("in 2025", []),
    ("about 2,025 units", [2025.0]), ("2024.5", [2024.5]), ("$2024", [2024.0]), ("see chunk 0012", []), ("$500M", [5e8]),
    ("20 millions", [2e7]), ("3.5k and 2t", [3500.0, 2e12]), ("", []), (None, []), (", ,", []), ("12x", []),
    ("5 Citations: [doc-1, 77]", [5.0]), ("7\nCitation: doc 12", [7.0]),
    ("loss" + " " * 46 + "5", [-5.0]), ("loss" + "." * 60 + "5", [5.0]),
]


def test_extract_numbers(spark):
    got = one(spark, [t for t, _ in NUMBER_CASES], N.extract_numbers)
    assert [pytest.approx(g) for g in got] == [w for _, w in NUMBER_CASES]


def test_table_scale_applies_to_bare_numbers_only(spark):
    got = one(spark, ["12", "12 million", "3%"], lambda c: N.extract_numbers(c, F.lit(1e3)))
    assert got == [[12000.0], [12e6], [3.0, 0.03]]
    assert one(spark, ["12"], lambda c: N.extract_numbers(c, F.lit(0.0))) == [[12.0]]


def plain_numbers(text):
    """Independent walk over a text with the same rules, unit-free."""
    out = []
    for m in re.finditer(r"(\$\s*\(\s*-?\s*[\d,]+(?:\.\d+)?\s*\)|\(\s*\$?\s*-?\s*[\d,]+(?:\.\d+)?\s*\)|-?\s*[\d,]+(?:\.\d+)?)"
                         r"(?:\s*(percent|percentage|%|billions?|millions?|thousands?|trillions?|[bmkt]))?(?!\w)", text, re.I):
        body = re.sub(r"[$\s]", "", m[1])
        digits = re.sub(r"[(),-]", "", body)
        try:
            value = float(digits)
        except ValueError:
            continue
        unit = (m[2] or "").lower()
        minus = "-" in body and not body.startswith("(")
        if unit in ("%", "percent", "percentage"):
            value = -value if minus else value
            out += [value, value / 100]
            continue
        scale = {"k": 1e3, "m": 1e6, "b": 1e9, "t": 1e12}.get(unit) or {
            "thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}.get(unit.rstrip("s"))
        at = m.start() + (0 if "$" not in text[m.start():m.start(1)] else 0)
        before = text[max(0, at - 50):at].lower()
        dollar = "$" in m[1]
        if scale is None and not dollar and re.fullmatch(r"[(-]*(19|20)\d\d\)?", body):
            continue
        if "chunk" in text[max(0, at - 10):at].lower():
            continue
        negative = body.startswith("(") or minus or any(w in before for w in dims.NEGATIVE_WORDS)
        out.append((-1 if negative else 1) * value * (scale or 1))
    return out


def test_extract_numbers_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    for r in docs.select("text", N.extract_numbers(F.col("text")).alias("n")).collect():
        assert r.n == pytest.approx(plain_numbers(r.text)), r.text[:200]


def test_numeric_move(spark):
    pairs = [("$100 million", "$489 million"), ("100", "105"), ("5 and 6", "6 and 5"), ("in 2020", "in 2021"), ("10 20", "30"),
             ("0.5", "0.9"), ("no", "5")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r.s for r in df.select("i", N.numeric_change_signal(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    assert [g and (g.old, g.new, g.pct) for g in got] == [(1e8, 4.89e8, 3.89), None, None, None, (10.0, 30.0, 2.0), None, None]


def test_numeric_match(spark):
    rows = [([105.0], 100.0), ([120.0], 100.0), ([0.009], 0.01), ([0.05], 0.01), ([], 5.0), ([1.0, 5.2], 5.0)]
    df = spark.createDataFrame([(i, n, g) for i, (n, g) in enumerate(rows)], "i int, n array<double>, g double")
    got = [r.m for r in df.select("i", N.numeric_match(F.col("n"), F.col("g")).alias("m")).orderBy("i").collect()]
    assert got == [True, False, True, False, False, True]


def test_every_item_header_finds_its_anchor(spark):
    lines = [f"Item {a[4:a.index('_')].upper()}. The {w.title()} part" for a, w in dims.ITEM_KEYWORDS.items()]
    assert one(spark, lines, H.item_anchor) == list(dims.ITEM_KEYWORDS)
    assert one(spark, ["Item 99. Foo", "no number", "ITEM 1A: RISK", None], H.item_anchor) == [
        "item99_unknown", "unknown", "item1a_risk", None]


def test_headings(spark):
    cases = {"Item 7. Management's Discussion": "item7_mdna", "Item 1A.": "item1a_unknown", "Risk Factors": "item1a_risk",
             " RISK   FACTORS ": "item1a_risk", "The Risk Factors here": None, "[Reserved]": "item6_reserved",
             "x" * 121 + " Other Information": None, "Management’s Discussion and Analysis of it": "item7_mdna",
             "Item 5 of 1234567890": "item5_unknown", "Item 5 1234567890123": None, "": None}
    assert one(spark, list(cases), H.detect_heading) == list(cases.values())


def test_section_anchor_falls_back(spark):
    got = one(spark, ["Item 8. Stuff", "Item 2. Stuff", None, "Risk Factors"], lambda c: H.section_anchor(c, H.detect_heading(c)))
    assert got == ["item8_financials", "item2_unknown", "item1_business", "item1a_risk"]


def test_table_anchor(spark):
    cases = {"Consolidated Statements of Operations": "income_statement", "operations and other income": "income_statement",
             "Balance Sheets": "balance_sheet", "Assets, liabilities and equity": "balance_sheet", "Cash Flows": "cash_flow",
             "Shareholders' Equity": "stockholders_equity", "Notes to Consolidated Statements": "notes_to_financials",
             "Something else": "here"}
    assert one(spark, list(cases), lambda c: H.table_anchor(c, F.lit("here"))) == list(cases.values())


def test_vocabulary_is_closed():
    words = dims.anchor_vocabulary()
    assert len(dims.ITEM_SECTIONS) == 23 and len(words) == len(set(words))
    assert set(dims.TAG_ANCHORS.values()) <= set(words) and {a for _, _, xs in dims.CHAPTERS for a in xs} <= set(words)
    assert {a for _, a in dims.HEADING_PATTERNS} <= set(words) and len(dims.TAG_ANCHORS) == 29


def test_routes(spark):
    rows = [("Revenue was 5", "corpus", "correct"), ("Not found in corpus", "abstain", "correct"), ("", "corpus", "wrong"),
            (None, "corpus", "wrong"), ("It is 5 [source: web]", "web", "correct"), ("NOT AVAILABLE (web)", "web", "correct"),
            ("It is not mentioned", "corpus", "wrong(abstain->corpus)")]
    rows += [(f"Well, {p}.", "abstain", "correct") for p in dims.ABSTAIN_PHRASES]
    rows += [(f"Yes {t}", "web", "correct") for t in dims.WEB_TAGS]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, e string, w string")
    for r in df.select("w", A.route_result(F.col("a"), F.col("e")).alias("g"), "a").collect():
        assert r.g == r.w, r.a


def test_fallback_answer(spark):
    rows = [("not available", "Five", "web", "Five [source: web]", "web"), ("not available", "x Source: Web", "web", "x Source: Web", "web"),
            ("Five", "Six", "web", "Five", "rag"), ("not available", "Six", "corpus", "not available", "rag")]
    df = spark.createDataFrame(rows, "a string, b string, e string, w string, p string")
    for r in df.select("*", A.choose_answer(F.col("a"), F.col("b"), F.col("e")).alias("c")).collect():
        assert (r.c.answer, r.c.provenance) == (r.w, r.p)
    any_gate = df.filter("e = 'corpus'").select(A.choose_answer(F.col("a"), F.col("b"), F.col("e"), "any").alias("c")).first().c
    assert any_gate.provenance == "web"


def test_joint_and_failures(spark):
    #        expected, type, route, hit, num -> joint, bucket
    rows = [("corpus", "numerical", "correct", True, True, True, ""), ("corpus", "numerical", "correct", True, False, False, "table_mangle"),
            ("corpus", "numerical", "correct", False, True, False, "retrieval_miss"), ("corpus", "factual", "wrong", True, None, True, ""),
            ("corpus", "numerical", "wrong(abstain->corpus)", True, None, False, "wrong_abstention"),
            ("corpus", "numerical", "correct", True, None, False, "generation_error"),
            ("abstain", "unanswerable", "wrong", True, None, False, "false_positive"), ("web", "x", "correct", False, None, True, ""),
            ("web", "x", "wrong", False, None, False, "wrong_routing")]
    df = spark.createDataFrame(rows, "e string, t string, r string, h boolean, n boolean, j boolean, b string")
    got = df.withColumn("gj", A.joint_correct(*[F.col(c) for c in "etrhn"])).withColumn(
        "gb", A.failure_bucket(F.col("gj"), *[F.col(c) for c in ("t", "e", "r", "h", "n")])).collect()
    for r in got:
        assert (r.gj, r.gb) == (r.j, r.b)


def test_money(spark):
    assert one(spark, [391035e6, 1.15e6, -4.3e9, 6.13, None, 2500.0, 1.5e12, 999.0], M.fmt_money, "double") == [
        "$391.0B", "$1.1M", "-$4.3B", "$6", "–", "$2K", "$1.50T", "$999"]
    assert one(spark, [6.125, -1234.5], lambda c: M.fmt_money(c, F.lit("EarningsPerShareBasic")), "double") == ["$6.12", "$-1,234.50"]
    assert one(spark, [2.02, -3.36, None, 0.0], M.fmt_signed_pct, "double") == ["+2.0%", "-3.4%", "", "+0.0%"]
    assert one(spark, [1.0, -1.0, 0.01, None], lambda c: M.direction(c, F.lit("Liabilities")), "double") == ["down", "up", "", ""]


def test_text_helpers(spark):
    assert one(spark, ["aaa bbb ccc", "aaaaaaaaaaaa", "short", " aaaaaaaaaaa"], lambda c: T.truncate_words(c, 9)) == [
        "aaa bbb", "aaaaaaaaa", "short", " aaaaaaaa"]
    assert one(spark, ["a\x00b\tc\nd\x1f"], T.sanitize) == ["ab\tc\nd"]
    assert one(spark, ["A.\n\n\n\nB.", "  \n\n ", "one"], T.paragraphs) == [["A.", "B."], [], ["one"]]
    assert one(spark, ["x\nus-gaap:Assets\n\n0000320193\nFY\nFYI"], T.strip_noise_lines) == ["x\n\nFYI"]
    assert one(spark, ["2025-09-27"], T.fiscal_year_label) == ["FY2025"]


def test_best_rows_of_many_queries_are_found_in_strips():
    """4,000 queries against a batch of 10,000 rows: no task holds all their similarities (320 MB)."""
    import tracemalloc
    import numpy as np
    from redline.operators import vectors as V
    rng = np.random.default_rng(5)
    asks, rows, ids = rng.integers(-3, 4, (4000, 4)) / 4, rng.integers(-3, 4, (10_000, 4)) / 4, rng.permutation(10_000)
    tracemalloc.start()
    got = list(V.partial_topk(np.arange(4000), asks, ids, rows, 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and len(got) == 4000
    for q in (0, 1, 208, 209, 210, 3999):  # on both sides of a strip's end
        want = sorted(zip(-np.round(rows @ asks[q], V.DIGITS), ids))[:3]
        assert [(-s, c) for s, c in zip(got[q][2], got[q][1])] == want and set(got[q][0]) == {q}


def test_short_sequences_are_differed_as_long_ones_and_quickly(monkeypatch):
    """The walk over lists marks what the walk over arrays marks; 60 rewritten paragraphs take well under a second."""
    import time
    import numpy as np
    from redline.operators import edit_script as E
    rng = np.random.default_rng(11)
    pairs = [(rng.integers(0, k, n), rng.integers(0, k, m)) for k, n, m in rng.integers([2, 0, 0], [60, 90, 90], (60, 3))]
    began = time.process_time()
    quick = [E.common_parts(a, b) for a, b in pairs]
    took = time.process_time() - began
    monkeypatch.setattr(E, "SMALL", -1)
    monkeypatch.setattr(E, "BITS", -1)
    began = time.process_time()
    for (a, b), got in zip(pairs, quick):
        assert all(np.array_equal(x, y) for x, y in zip(got, E.common_parts(a, b)))
    assert took < 0.4 * (time.process_time() - began)
