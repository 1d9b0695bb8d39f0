"""Text and segments of pages, headings, chunks, incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from redline import dims
from redline.catalogue import register
from redline.catalogue.views import DOCS_SQL, documents, table
from redline.functions import headings as H
from redline.functions import text as T
from redline.operators import chunking as CH
from redline.operators import extract as X
from redline.operators.ranking import top_per_key
from redline.operators.series import gold_span
from redline.sources.filings import latest_n
from redline.session import spread


def _pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages"))


@register("extract_text")
def extract_text(spark, sf_dir):
    return X.extract_text(_pages(spark, sf_dir).select("page_id", "html"))


@register("extract_segments")
def extract_segments(spark, sf_dir):
    return X.extract_segments(_pages(spark, sf_dir), ["page_id"])


def _with_sections(pages):
    """The raw pages carry no filing headings: append sections, the first one not to every page, the second with a table."""
    risk = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("<h2>Item 1A. Risk Factors</h2><p>"), "url", F.lit("</p>")))
    return pages.select("page_id", F.concat(
        F.coalesce("html", F.lit("")), F.coalesce(risk, F.lit("")), F.lit("<h2>Item 7. Management's Discussion"
        "</h2><p>Amounts in millions</p><p>Pages and addresses follow.</p><table><tr><td>Page</td><td>"),
        F.col("page_id").cast("string"), F.lit("</td></tr><tr><td></td></tr></table><h2>Item 8. Financial Statements"
        "</h2><p>End.</p>")).alias("html"))


@register("chunk_sectionaware")
def chunk_sectionaware(spark, sf_dir):
    return CH.chunk_sectionaware(_with_sections(_pages(spark, sf_dir)), ["page_id"], required=[])


@register("missing_anchors", """SELECT page_id, unnest(['income_statement', 'cash_flow']) AS anchor FROM pages
UNION ALL SELECT page_id, 'item1a_risk' FROM pages WHERE page_id % 3 = 0""")
def missing_anchors(spark, sf_dir):
    return X.anchor_violations(chunk_sectionaware(spark, sf_dir), ["page_id"],
                               ["item1a_risk", "item7_mdna", "income_statement", "cash_flow"])


@register("chunk_fixed", """WITH win AS (SELECT doc_id, text, length(text) AS n, unnest(generate_series(0,
    CASE WHEN length(text) <= 2400 THEN 0 ELSE CAST(ceil((length(text) - 2400) / 2200.0) AS BIGINT) * 2200 END, 2200)) AS s
  FROM documents)
SELECT doc_id, s // 2200 AS chunk_no, s AS span_start, least(s + 2400, n) AS span_end, substr(text, s + 1, 2400) AS text
FROM win WHERE n > 0""")
def chunk_fixed(spark, sf_dir):
    return CH.chunk_windows(documents(spark, sf_dir), ["doc_id"])


@register("chunk_fixed_snapped")
def chunk_fixed_snapped(spark, sf_dir):
    doubled = documents(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return CH.chunk_fixed(doubled, ["doc_id"])


@register("split_prose")
def split_prose(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(CH.split_prose(F.col("text"))).alias("part", "text"))


_HEADS_SQL = """lines AS (
  SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'Item ' || CAST(doc_id % 17 AS VARCHAR) || '. ' END ||
         list_element(['Business', 'Risk and Properties', 'Management Discussion', 'Other Information', 'Legal Proceedings',
                       'Financial Statements', 'Controls and Procedures'], CAST(doc_id % 7 AS INT) + 1) AS line FROM documents)"""
_KEYWORDS_SQL = "kw(item, word, anchor) AS (VALUES " + ",".join(
    f"('{a[4:a.index('_')]}','{w}','{a}')" for a, w in dims.ITEM_KEYWORDS.items()) + ")"


@register("heading_anchor", f"""WITH {_HEADS_SQL}, {_KEYWORDS_SQL},
num AS (SELECT doc_id, line, regexp_extract(lower(line), '\\bitem\\s+(\\d+[a-z]?)\\b', 1) AS item FROM lines)
SELECT doc_id, line, CASE WHEN num.item <> '' THEN CASE WHEN contains(lower(line), word) THEN anchor ELSE 'item' || num.item || '_unknown' END
  WHEN line = 'Business' THEN 'item1_business' WHEN line = 'Other Information' THEN 'item9b_other'
  WHEN line = 'Legal Proceedings' THEN 'item3_legal' WHEN line = 'Controls and Procedures' THEN 'item9a_controls' END AS anchor,
  coalesce(CASE WHEN num.item IN ('7', '8') AND NOT contains(lower(line), word) THEN
                  CASE num.item WHEN '7' THEN 'item7_mdna' ELSE 'item8_financials' END END,
           CASE WHEN num.item <> '' THEN CASE WHEN contains(lower(line), word) THEN anchor ELSE 'item' || num.item || '_unknown' END
             WHEN line = 'Business' THEN 'item1_business' WHEN line = 'Other Information' THEN 'item9b_other'
             WHEN line = 'Legal Proceedings' THEN 'item3_legal' WHEN line = 'Controls and Procedures' THEN 'item9a_controls'
             ELSE 'unknown' END) AS section
FROM num LEFT JOIN kw ON kw.item = num.item""")
def heading_anchor(spark, sf_dir):
    titles = F.array(*[F.lit(t) for t in ("Business", "Risk and Properties", "Management Discussion", "Other Information",
                                          "Legal Proceedings", "Financial Statements", "Controls and Procedures")])
    i = F.col("doc_id")
    line = F.concat(F.when(i % 4 == 3, "").otherwise(F.concat(F.lit("Item "), (i % 17).cast("string"), F.lit(". "))),
                    F.get(titles, (i % 7).cast("int")))
    return (table(spark, sf_dir, "documents").select("doc_id", line.alias("line"))
            .withColumn("anchor", H.detect_heading(F.col("line")))
            .withColumn("section", H.section_anchor(F.col("line"), F.col("anchor"))))


@register("clean_lines", """SELECT doc_id, array_to_string(list_filter(string_split(text || chr(10) || 'us-gaap:Assets' || chr(10) || 'FY',
    chr(10)), lambda x: NOT regexp_matches(trim(x), '^us-gaap:[A-Z]|^\\d{10}$|^(FY|P1Y|true|false)$|^Copyright 20\\d\\d|^https?://fasb\\.org/')),
    chr(10)) AS text FROM documents""")
def clean_lines(spark, sf_dir):
    noisy = F.concat("text", F.lit("\nus-gaap:Assets\nFY"))
    return documents(spark, sf_dir).select("doc_id", T.strip_noise_lines(noisy).alias("text"))


@register("truncated", """SELECT doc_id, CASE WHEN length(text) <= 500 THEN text
  WHEN strpos(reverse(substr(text, 1, 500)), ' ') BETWEEN 1 AND 499
  THEN substr(text, 1, 500 - strpos(reverse(substr(text, 1, 500)), ' ')) ELSE substr(text, 1, 500) END AS text FROM documents""")
def truncated(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_words(F.col("text")).alias("text"))


@register("sanitized", """SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS text FROM documents""")
def sanitized(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.sanitize(F.col("text")).alias("text"))


@register("latest_n_per_entity", f"""WITH {DOCS_SQL},
r AS (SELECT ticker, fiscal_year, doc_id, row_number() OVER (PARTITION BY ticker ORDER BY doc_id DESC) AS recency
      FROM docs WHERE anchor = 'en')
SELECT * FROM r WHERE recency <= 3""")
def latest_n_per_entity(spark, sf_dir):
    return top_per_key(documents(spark, sf_dir).filter("anchor = 'en'").select("ticker", "fiscal_year", "doc_id"),
                       ["ticker"], [F.col("doc_id").desc()], 3, "recency")


@register("latest_filings", """WITH listed AS (
  SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place
  FROM orders WHERE o_orderstatus = 'F'),
wanted AS (SELECT * FROM listed WHERE place BETWEEN 2 AND 4)
SELECT CAST(o_custkey AS VARCHAR) AS cik, c_name AS entity_name,
       lpad(CAST(o_custkey AS VARCHAR), 10, '0') || strftime(o_orderdate, '%y') || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS accession_no,
       'd' || o_orderkey || '.htm' AS doc_filename, strftime(o_orderdate, '%Y-%m-%d') AS period_end,
       'FY' || strftime(o_orderdate, '%Y') AS fiscal_year, place - 1 AS rank
FROM wanted JOIN customer ON c_custkey = o_custkey""")
def latest_filings(spark, sf_dir):
    """Customers' orders as submission lists (parallel arrays, latest first): three of a form after the most recent one."""
    key, day = F.col("o_orderkey").cast("string"), F.col("o_orderdate").cast("timestamp")
    entry = F.struct((-F.unix_seconds(day)).alias("recency"), F.col("o_orderkey"),
                     F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("10-Q").alias("form"),
                     F.concat_ws("-", F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.date_format(day, "yy"),
                                 F.lpad(key, 6, "0")).alias("accessionNumber"),
                     F.concat(F.lit("d"), key, F.lit(".htm")).alias("primaryDocument"),
                     F.date_format(day, "yyyy-MM-dd").alias("reportDate"))
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(  # the orders of one customer
        F.array_sort(F.collect_list(entry)).alias("e"))
    recent = F.struct(*[F.col(f"e.{n}").alias(n) for n in ("form", "accessionNumber", "primaryDocument", "reportDate")])
    submissions = lists.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").cast("string").alias("cik"), F.col("c_name").alias("name"),
        F.struct(recent.alias("recent")).alias("filings"))
    return latest_n(submissions, 3, offset=1)


@register("latest_year_chunks", f"""WITH {DOCS_SQL}
SELECT ticker, fiscal_year, doc_id FROM docs
WHERE (ticker, fiscal_year) IN (SELECT (ticker, max(fiscal_year)) FROM docs GROUP BY ticker)""")
def latest_year_chunks(spark, sf_dir):
    from redline.sources.tables import load_chunks
    return load_chunks(documents(spark, sf_dir)).select("ticker", "fiscal_year", "doc_id")


@register("new_docs", """SELECT doc_id, source, length(text) AS n FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def new_docs(spark, sf_dir):
    from redline.streaming.ingest import unseen
    docs, seen = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return unseen(docs, seen, ["doc_id"]).select("doc_id", "source", F.length("text").alias("n"))


@register("gold_spans", """WITH t AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' Consolidated Balance Sheet ' WHEN 1 THEN
    ' CONSOLIDATED BALANCE SHEETS and consolidated balance sheet ' ELSE '' END || text AS text FROM documents),
s AS (SELECT doc_id, strpos(upper(text), CASE doc_id % 3 WHEN 0 THEN 'CONSOLIDATED BALANCE SHEET' ELSE 'CONSOLIDATED BALANCE SHEETS' END) - 1 AS a,
             length(text) AS n FROM t WHERE doc_id % 3 < 2)
SELECT doc_id, a AS span_start, least(a + 4000, n) AS span_end FROM s""")
def gold_spans(spark, sf_dir):
    i = F.col("doc_id") % 3
    text = F.concat("text", F.when(i == 0, " Consolidated Balance Sheet ").when(
        i == 1, " CONSOLIDATED BALANCE SHEETS and consolidated balance sheet ").otherwise(""), "text")
    spans = documents(spark, sf_dir).select("doc_id", gold_span(text, F.lit("balance_sheet")).alias("s"))
    return spans.filter("s IS NOT NULL").select("doc_id", F.col("s")[0].alias("span_start"), F.col("s")[1].alias("span_end"))
