"""Extraction, sectioning and chunking of hand-made pages."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from redline import schemas
from redline.operators import chunking as C
from redline.operators import extract as X
from redline.sources import filings as S
from redline.sources.html import read_page
from redline.sources import tables as TB

PAGE = """<html><head><title>T</title><script>var a = "</p>";</script></head><body>
<ix:header><ix:hidden>secret</ix:hidden></ix:header>
<p>Opening words.</p>
<p>Item 1A. Risk Factors</p><p>We may <b>fail</b>.</p>
<div>Item 7. Management's Discussion</div>
<p>(in millions, except shares)</p><p>The table shows sales &amp; more.</p>
<div><div>CONSOLIDATED STATEMENTS OF OPERATIONS</div><table><tr><td>Sales</td><td> 5 </td></tr><tr><td></td></tr>
<tr><th>Cost<td>3</table></div>
<p>Item 8. Financial Statements</p><p>Done.</p><!-- gone --></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([("A", "FY2024", PAGE)], "ticker string, fiscal_year string, html string")


def test_text_has_no_markup_or_dropped_elements(spark, pages):
    text = X.extract_text(pages).first().text
    assert "secret" not in text and "var a" not in text and "<" not in text and "gone" not in text and "\n\n\n" not in text
    assert "sales & more" in text


def test_segments_keep_tables_whole_with_their_caption(spark, pages):
    rows = X.extract_segments(pages, ["ticker"]).orderBy("seg_no").collect()
    assert [r.kind for r in rows] == ["prose", "table", "prose"]
    assert rows[1].text == ("(in millions, except shares)\nThe table shows sales & more.\n"
                            "CONSOLIDATED STATEMENTS OF OPERATIONS\nSales | 5\nCost | 3")
    assert rows[0].text.split("\n")[:4] == ["Opening words.", "Item 1A. Risk Factors", "We may", "fail"]


def test_captions_skip_ids_and_long_texts():
    def caption(before):
        return read_page(f"<div>{before}<table><tr><td>x</td></tr></table></div>").segments[-1][1]
    assert caption("<p>aapl-20250927</p>") == "x"
    assert caption(f"<p>{'y' * 301}</p>") == "x"
    assert caption("<p>One</p><p>Two</p>") == "One\nTwo\nx"


def test_deep_and_broken_pages_are_read():
    deep = "<b>" * 100_000 + "end" + "</i>" * 100_000 + "<p>x" * 1000
    assert read_page(deep).segments == [("prose", "\n".join(["end"] + ["x"] * 1000))]
    assert read_page(None).segments == [] and read_page("<table><tr><td>a<td>b").segments == [("table", "a | b")]
    nested = "<table><tr><td>a<table><tr><td>b</td></tr></table></td><td>c</td></tr></table>"
    assert read_page(nested).segments == [("table", "a b | b | c\nb")]
    assert read_page("<p>a < b</p><![if x]><p>c</p><![endif]>").segments == [("prose", "a < b\nc")]


def test_sections_and_chunks(spark, pages):
    rows = C.chunk_sectionaware(pages, ["ticker", "fiscal_year"]).orderBy("chunk_no").collect()
    got = [(r.anchor, r.type, r.table_scale) for r in rows]
    assert got == [("item1_business", "prose", None), ("item1a_risk", "prose", None), ("item7_mdna", "prose", None),
                   ("income_statement", "table", 1e6), ("item8_financials", "prose", None)]
    table = rows[3].text.split("\n")
    assert table[0] == "Item 7. Management's Discussion" and table[1] == "(in millions, except shares)"
    assert table[2] == "The table shows sales & more." and table[-1] == "Cost | 3"
    assert rows[0].span_start == 0 and all(a.span_end == b.span_start for a, b in zip(rows, rows[1:]))


def test_missing_required_anchor_raises(spark, pages):
    keys = ["ticker", "fiscal_year"]
    with pytest.raises(Exception, match="lacks cash_flow"):  # raised inside the one pass that computes the chunks
        C.chunk_sectionaware(pages, keys, required=["cash_flow", "item7_mdna"]).collect()
    stored = C.chunk_sectionaware(pages, keys, required=["cash_flow", "item7_mdna"], keep_missing=True)
    last = stored.orderBy(F.desc("chunk_no")).first()
    assert last.missing == ["cash_flow"] and stored.filter("missing is not null").count() == 1
    with pytest.raises(RuntimeError, match="lacks cash_flow"):
        X.assert_anchor_coverage(stored, keys, ["cash_flow"])


def test_chunk_job_parses_pages_once(spark, pages):
    plan = C.chunk_sectionaware(pages, ["ticker", "fiscal_year"], required=[])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_table_can_open_a_section(spark):
    page = "<p>Intro</p><table><tr><td>Item 2. Properties</td></tr><tr><td>Land</td></tr></table><p>After.</p>"
    df = spark.createDataFrame([("A", page)], "ticker string, html string")
    rows = C.chunk_sectionaware(df, ["ticker"], required=[]).orderBy("chunk_no").collect()
    assert [(r.anchor, r.type) for r in rows] == [("item1_business", "prose"), ("item2_properties", "table"), ("item2_properties", "prose")]


def test_scale_line_out_of_reach_is_ignored(spark):
    page = "<p>Item 7. Management</p><p>in thousands</p>" + f"<p>{'w ' * 1600}</p>" + "<table><tr><td>1</td></tr></table>"
    df = spark.createDataFrame([("A", page)], "ticker string, html string")
    t = C.chunk_sectionaware(df, ["ticker"], required=[]).filter("type = 'table'").first()
    assert t.table_scale is None and t.text.split("\n")[1].endswith("...")


def split(spark, text, target, limit):
    return spark.createDataFrame([(text,)], "t string").select(C.split_prose(F.col("t"), target, limit).alias("c")).first().c


def test_prose_packing(spark):
    assert split(spark, "aaaa\n\nbbbb\n\ncccc", 10, 20) == ["aaaa\n\nbbbb", "cccc"]
    assert split(spark, "aaaa\n\nbbbbbbbb", 100, 10) == ["aaaa", "bbbbbbbb"]
    assert split(spark, "l1 x\nl2 y\nl3 z", 100, 9) == ["l1 x\nl2 y", "l3 z"]
    assert split(spark, "aaaaaa bbbb cccc", 100, 10) == ["aaaaaa", "bbbb cccc"]
    assert split(spark, "a" * 25, 100, 10) == ["a" * 10, "a" * 10, "a" * 5]
    assert all(len(c) <= 50 for c in split(spark, "word " * 300, 40, 50))


def test_small_chunks_merge_backward_within_anchor(spark):
    def run(chunks):
        df = spark.createDataFrame([(chunks,)], f"cs {C.CHUNK_TYPE}")
        return [r.text for r in df.select(F.explode(C.merge_small(F.col("cs"), 5, 20)).alias("c")).select("c.*").collect()]
    def p(a, t):
        return (a, None, "prose", None, t)
    assert run([p("x", "aaaaaaaa"), p("x", "bb"), p("y", "cc"), p("y", "dd")]) == ["aaaaaaaa\n\nbb", "cc\n\ndd"]
    assert run([("x", None, "table", None, "t"), p("x", "bb"), p("x", "c" * 19), p("x", "dd")]) == ["t", "bb", "c" * 19, "dd"]


def test_fixed_chunks_snap_overlap_and_stop(spark):
    text = ("a" * 95 + "\n\n") + "b" * 200
    df = spark.createDataFrame([("d", text), ("e", ""), ("f", "short")], "k string, text string")
    rows = C.chunk_fixed(df, ["k"], size=100, overlap=20, window=30).orderBy("k", "chunk_no").collect()
    d = [(r.span_start, r.span_end) for r in rows if r.k == "d"]
    assert d[0] == (0, 95) and d[-1][1] == len(text) and sum(e == len(text) for _, e in d) == 1
    assert all(b[0] == a[1] - 20 for a, b in zip(d, d[1:]))
    assert [r.text for r in rows if r.k == "f"] == ["short"] and not [r for r in rows if r.k == "e"]


def test_windows_cover_the_text(spark):
    df = spark.createDataFrame([("d", "x" * n) for n in (1, 100, 101, 180, 181)], "k string, text string").withColumn("k", F.length("text").cast("string"))
    for k, rows in pd.DataFrame([r.asDict() for r in C.chunk_windows(df, ["k"], 100, 20).collect()]).groupby("k"):
        rows = rows.sort_values("chunk_no")
        assert rows.span_start.iloc[0] == 0 and rows.span_end.iloc[-1] == int(k) and (rows.span_end == int(k)).sum() == 1


def test_filings_facts_and_submissions_from_files(spark, tmp_path):
    base, tmp_path = tmp_path, tmp_path / "landed"
    tmp_path.mkdir()
    for fy in ("FY2023", "FY2024"):
        (tmp_path / f"AAA_{fy}_10k.html").write_text(PAGE)
        (tmp_path / f"AAA_{fy}_10k_meta.json").write_text(json.dumps({"accession_no": "1", "period_end": f"{fy[2:]}-09-30", "entity_name": "A"}))
    rows = S.read_filings(spark, str(tmp_path)).orderBy("fiscal_year").collect()
    assert [(r.ticker, r.fiscal_year, str(r.period_end)) for r in rows] == [("AAA", "FY2023", "2023-09-30"), ("AAA", "FY2024", "2024-09-30")]
    assert S.read_filings(spark, str(tmp_path)).columns == [f.name for f in schemas.FILINGS.fields]
    both = C.chunk_both(S.read_filings(spark, str(tmp_path)))
    ids = {r.chunk_id for r in both.select("chunk_id").collect()}
    assert "aaa-10k-2023-09-30-sectionaware-0000" in ids and "aaa-10k-2024-09-30-fixedsize-0000" in ids
    store = str(base / "chunks")
    TB.write_chunks(both, store)
    latest = TB.load_chunks(TB.read_chunks(spark, store), "sectionaware")
    assert {r.fiscal_year for r in latest.select("fiscal_year").collect()} == {"FY2024"}
    facts = {"facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2024-09-30", "val": 5, "form": "10-K", "fp": "FY", "start": "2023-10-01"}],
                                                          "EUR": [{"end": "2024-09-30", "val": 4}]}}, "Other": {"units": {}}}}}
    (tmp_path / "AAA_companyfacts.json").write_text(json.dumps(facts))
    got = S.read_facts(spark, str(tmp_path), ["Assets"]).orderBy("unit").collect()
    assert [(r.ticker, r.tag, r.unit, r.val, r.fy) for r in got] == [("AAA", "Assets", "EUR", 4.0, "FY2024"), ("AAA", "Assets", "USD", 5.0, "FY2024")]
    sub = {"cik": "1", "name": "A", "filings": {"recent": {"form": ["8-K", "10-K", "10-K", "10-K"], "accessionNumber": ["0", "1-1", "2-2", "3-3"],
           "primaryDocument": list("wxyz"), "reportDate": ["2025-01-01", "2024-09-30", "2023-09-30", "2022-09-30"]}}}
    (tmp_path / "sub.json").write_text(json.dumps(sub))
    recent = S.latest_n(S.read_submissions(spark, str(tmp_path / "sub.json")), 2, offset=1).orderBy("rank").collect()
    assert [(r.accession_no, r.fiscal_year) for r in recent] == [("22", "FY2023"), ("33", "FY2022")]


def test_batches_are_read_in_slices(spark):
    """A batch of many pages or texts is taken apart a slice at a time; nulls and keys keep their places."""
    from redline.operators import chunking, extract
    batch = pd.DataFrame({"k": list(range(150)), "html": [f"<p>{i}</p>" for i in range(150)]})
    parts = list(extract.sliced(iter([batch])))
    assert max(map(len, parts)) <= extract.SLICE and pd.concat(parts)["k"].tolist() == list(range(150))
    texts = [None if i % 7 == 0 else f"a{i}\n\nb{i} " * (i % 5) for i in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1)
    got = {r.k: r.c for r in rows.select("k", chunking.split_prose(F.col("t"), 5, 9).alias("c")).collect()}
    assert got == {i: chunking._prose_chunks(t or "", 5, 9) for i, t in enumerate(texts)}
    pages = rows.select("k", F.when(F.col("k") % 9 != 0, F.concat(F.lit("<p>x"), "k", F.lit("</p><table><tr><td>y</td></tr></table>"))
                                    ).otherwise("").alias("html"))
    found = extract.extract_segments(pages, ["k"]).orderBy("k", "seg_no").collect()
    assert [(r.k, r.seg_no, r.kind) for r in found] == [
        (k, n, kind) for k in range(150) if k % 9 for n, kind in enumerate(("prose", "table"))]
