"""Metric facts: annual values, series, statements, section signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from redline.catalogue import register
from redline.catalogue.views import ANNUAL_SQL, FACT_YEARS, FACTS_SQL, YEARS_SQL, facts, table
from redline.functions.money import fmt_money
from redline.operators import evaluation as E
from redline.operators import series as S
from redline.operators.ranking import ordered_positions

# The metric tags of the driver tables and the sections they are filed under.
TAG_SECTIONS = {
    "1-URGENT": "income_statement",
    "2-HIGH": "income_statement",
    "3-MEDIUM": "balance_sheet",
    "4-NOT SPECIFIED": "balance_sheet",
    "5-LOW": "cash_flow",
}
GROUPS = [("Income Statement", ["1-URGENT", "2-HIGH"]), ("Balance Sheet", ["3-MEDIUM", "4-NOT SPECIFIED"]),
          ("Cash Flow", ["5-LOW"])]


def _tags(spark):
    rows = [(i, t, a) for i, (t, a) in enumerate(TAG_SECTIONS.items())]
    return spark.createDataFrame(rows, "tag_order int, tag string, anchor string")


_TAGS_SQL = "tags(tag_order, tag, anchor) AS (VALUES " + ",".join(
    f"({i},'{t}','{a}')" for i, (t, a) in enumerate(TAG_SECTIONS.items())) + ")"


def _annual(spark, sf_dir):
    return S.fiscal_year_value(S.fact_values(facts(spark, sf_dir)))


@register("fiscal_year_value", f"WITH {ANNUAL_SQL} SELECT ticker, tag, fy, value FROM annual")
def fiscal_year_value(spark, sf_dir):
    return _annual(spark, sf_dir)


_PAIRS_SQL = """pairs AS (SELECT a.fy AS y_old, b.fy AS y_new FROM years a JOIN years b
  ON CAST(substr(b.fy, 3) AS INT) = CAST(substr(a.fy, 3) AS INT) + 1)"""
_DELTAS_SQL = f"""{ANNUAL_SQL}, {YEARS_SQL}, {_PAIRS_SQL},
keys AS (SELECT DISTINCT ticker, tag FROM annual),
deltas AS (
  SELECT k.ticker, k.tag, p.y_old, p.y_new, o.value AS "old", n.value AS "new",
         coalesce(n.value, 0) - coalesce(o.value, 0) AS abs_change,
         CASE WHEN abs(o.value) > 0 THEN round((n.value - o.value) / abs(o.value) * 100, 2) END AS pct_change
  FROM keys k CROSS JOIN pairs p
  LEFT JOIN annual o ON o.ticker = k.ticker AND o.tag = k.tag AND o.fy = p.y_old
  LEFT JOIN annual n ON n.ticker = k.ticker AND n.tag = k.tag AND n.fy = p.y_new
  WHERE o.value IS NOT NULL OR n.value IS NOT NULL)"""


@register("yoy_deltas", f"WITH {_DELTAS_SQL} SELECT * FROM deltas")
def yoy_deltas(spark, sf_dir):
    return S.yoy_deltas(_annual(spark, sf_dir), FACT_YEARS)


_SERIES_SQL = f"""{ANNUAL_SQL}, {YEARS_SQL},
keys AS (SELECT DISTINCT ticker, tag FROM annual WHERE fy IN (SELECT fy FROM years)),
grid AS (
  SELECT k.ticker, k.tag, y.fy, a.value, lag(a.value) OVER (PARTITION BY k.ticker, k.tag ORDER BY y.fy) AS prev
  FROM keys k CROSS JOIN years y LEFT JOIN annual a ON a.ticker = k.ticker AND a.tag = k.tag AND a.fy = y.fy),
series AS (SELECT ticker, tag, fy, value,
  CASE WHEN abs(prev) > 0 THEN round((value - prev) / abs(prev) * 100, 2) END AS pct FROM grid)"""


@register("metric_series", f"WITH {_SERIES_SQL} SELECT * FROM series")
def metric_series(spark, sf_dir):
    return S.metric_series(_annual(spark, sf_dir), FACT_YEARS)


_MONEY_SQL = """CASE WHEN value IS NULL THEN '–' ELSE (CASE WHEN value < 0 THEN '-' ELSE '' END) || '$' || CASE
  WHEN abs(value) >= 1e12 THEN format('{:.2f}', abs(value) / 1e12) || 'T'
  WHEN abs(value) >= 1e9 THEN format('{:.1f}', abs(value) / 1e9) || 'B'
  WHEN abs(value) >= 1e6 THEN format('{:.1f}', abs(value) / 1e6) || 'M'
  WHEN abs(value) >= 1e3 THEN format('{:.0f}', abs(value) / 1e3) || 'K'
  ELSE format('{:,.0f}', abs(value)) END END"""
_GROUPS_SQL = "groups(group_order, title, tag_order, tag) AS (VALUES " + ",".join(
    f"({g},'{t}',{i},'{tag}')" for g, (t, tags) in enumerate(GROUPS) for i, tag in enumerate(tags)) + ")"
_TABLE_SQL = f"""{_SERIES_SQL}, {_GROUPS_SQL}, cells AS (
  SELECT ticker, title, group_order, tag_order, tag, tag AS label, fy, value, {_MONEY_SQL} AS value_str,
         CASE WHEN pct IS NULL THEN '' ELSE format('{{:+.1f}}%', pct) END AS pct_str,
         CASE WHEN pct IS NULL OR abs(pct) < 0.05 THEN '' WHEN pct > 0 THEN 'up' ELSE 'down' END AS direction
  FROM series JOIN groups USING (tag))"""


@register("statement_table", f"WITH {_TABLE_SQL} SELECT * FROM cells")
def statement_table(spark, sf_dir):
    return S.statement_table(metric_series(spark, sf_dir), GROUPS)


@register("statement_wide", f"""WITH {_TABLE_SQL}
SELECT ticker, title, group_order, tag_order, tag, label, """ + ", ".join(
    f"max(value_str) FILTER (fy = '{y}') AS {y}" for y in FACT_YEARS) + " FROM cells GROUP BY ALL")
def statement_wide(spark, sf_dir):
    return S.statement_wide(statement_table(spark, sf_dir), FACT_YEARS)


_SIGNAL_SQL = f"""{_DELTAS_SQL}, {_TAGS_SQL}, ranked AS (
  SELECT d.*, t.anchor, row_number() OVER (PARTITION BY d.ticker, d.y_old, d.y_new, t.anchor
           ORDER BY abs(pct_change) / 100.0 DESC, t.tag_order) AS rn
  FROM deltas d JOIN tags t USING (tag) WHERE abs(pct_change) / 100.0 >= 0.2),
signals AS (SELECT ticker, y_old, y_new, anchor, tag, "old", "new", round(abs(pct_change) / 100.0, 4) AS pct
  FROM ranked WHERE rn = 1)"""


@register("metric_change_signal", f"WITH {_SIGNAL_SQL} SELECT * FROM signals")
def metric_change_signal(spark, sf_dir):
    return S.metric_change_signal(yoy_deltas(spark, sf_dir), _tags(spark))


@register("format_deltas", f"""WITH {_DELTAS_SQL}, {_TAGS_SQL}
SELECT ticker, anchor, string_agg(tag || ' ' || y_old || '-' || y_new || ': ' ||
         coalesce(format('{{:,.0f}}', "old"), 'N/A') || ' -> ' || coalesce(format('{{:,.0f}}', "new"), 'N/A') ||
         CASE WHEN pct_change IS NULL THEN '' ELSE ' (' || format('{{:+.1f}}%', pct_change) || ')' END,
         chr(10) ORDER BY tag, y_old, y_new) AS text
FROM deltas JOIN tags USING (tag) GROUP BY ticker, anchor""")
def format_deltas(spark, sf_dir):
    return S.format_deltas(yoy_deltas(spark, sf_dir), _tags(spark))


@register("format_series", f"""WITH {_TABLE_SQL}, lines AS (
  SELECT ticker, group_order, tag_order, tag || ': ' || string_agg(fy || ' ' || value_str ||
           CASE WHEN pct_str = '' THEN '' ELSE ' (' || pct_str || ')' END, '; ' ORDER BY fy) AS line
  FROM cells WHERE value IS NOT NULL GROUP BY ticker, group_order, tag_order, tag)
SELECT ticker, string_agg(line, chr(10) ORDER BY group_order, tag_order) AS text FROM lines GROUP BY ticker""")
def format_series(spark, sf_dir):
    return S.format_series(metric_series(spark, sf_dir), GROUPS)


_ASKED = {"1-URGENT": "ResearchAndDevelopmentExpense", "2-HIGH": "Revenues", "3-MEDIUM": "NetIncomeLoss"}


@register("generated_questions", f"""WITH {FACTS_SQL}, periods AS (
  SELECT ticker, max("end") AS period_end FROM facts WHERE form = '10-K' GROUP BY ticker),
tickers AS (SELECT ticker, period_end, row_number() OVER (ORDER BY ticker) AS ticker_order FROM periods),
asked(tag, name, slot, phrase) AS (VALUES
  ('1-URGENT', 'ResearchAndDevelopmentExpense', 0, 'research and development expense'),
  ('2-HIGH', 'Revenues', 1, 'total revenue'), ('3-MEDIUM', 'NetIncomeLoss', 2, 'net income')),
hits AS (SELECT f.ticker, t.ticker_order, a.name, a.slot, a.phrase, t.period_end, f.val,
           row_number() OVER (PARTITION BY f.ticker, a.slot ORDER BY f.pos) AS rn
         FROM facts f JOIN tickers t ON t.ticker = f.ticker AND t.period_end = f."end"
         JOIN asked a ON a.tag = f.tag WHERE f.form = '10-K'),
one AS (SELECT *, row_number() OVER (ORDER BY ticker_order, slot) AS qid FROM hits WHERE rn = 1)
SELECT lower(ticker) || '-fy' || CAST(year(period_end) AS VARCHAR) || '-' || lower(substr(name, 1, 24)) || '-' ||
         lpad(CAST(qid AS VARCHAR), 3, '0') AS id,
       'What was ' || ticker || '''s ' || phrase || ' in FY' || CAST(year(period_end) AS VARCHAR) || '?' AS question,
       'numerical' AS type, 'corpus' AS expected_route, 'income_statement' AS gold_anchor, val AS gold_value
FROM one WHERE qid <= 20""")
def generated_questions(spark, sf_dir):
    base = facts(spark, sf_dir)
    tag = F.create_map(*[F.lit(v) for kv in _ASKED.items() for v in kv])[F.col("tag")]
    renamed = base.withColumns({"tag": tag, "fp": F.lit("FY"), "start": F.add_months("end", -12)})
    periods = base.filter("form = '10-K'").groupBy("ticker").agg(F.max("end").alias("period_end"))
    docs = ordered_positions(periods, ["ticker"], "ticker_order")
    out = S.generate_questions(renamed, docs, limit=20)
    return out.select("id", "question", "type", "expected_route", F.col("gold_chunks")[0].alias("gold_anchor"),
                      F.col("answer.value").alias("gold_value"))


@register("facts_by_end", f"""WITH {FACTS_SQL}
SELECT ticker, tag, "end", pos, val,
       row_number() OVER (ORDER BY "end" DESC, ticker, tag, pos) - 1 AS position FROM facts""")
def facts_by_end(spark, sf_dir):
    return S.facts_by_end(facts(spark, sf_dir)).select("ticker", "tag", "end", "pos", "val", "position")


@register("money_format", f"""WITH v AS (SELECT o_orderkey, (o_totalprice - 200000) * pow(1000, o_orderkey % 4) AS value FROM orders)
SELECT o_orderkey, {_MONEY_SQL} AS shown FROM v""")
def money_format(spark, sf_dir):
    value = (F.col("o_totalprice") - 200000) * F.pow(F.lit(1000.0), F.col("o_orderkey") % 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", fmt_money(value).alias("shown"))


@register("section_deltas", f"""WITH {_DELTAS_SQL}, {_TAGS_SQL}
SELECT ticker, anchor, tag, y_old, y_new, pct_change FROM deltas JOIN tags USING (tag)""")
def section_deltas(spark, sf_dir):
    return S.section_deltas(yoy_deltas(spark, sf_dir), _tags(spark)).select("ticker", "anchor", "tag", "y_old", "y_new", "pct_change")


@register("union_questions", f"""WITH {ANNUAL_SQL}
SELECT ticker || '-' || tag || '-' || fy AS id, 'numerical' AS type, value AS gold FROM annual
UNION ALL SELECT 'item-' || item_id, 'factual', NULL FROM benchmark""")
def union_questions(spark, sf_dir):
    generated = _annual(spark, sf_dir).select(F.concat_ws("-", "ticker", "tag", "fy").alias("id"),
                                              F.lit("numerical").alias("type"), F.col("value").alias("gold"))
    curated = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id")).alias("id"),
                                                       F.lit("factual").alias("type"), F.col("text").alias("_note"))
    return E.union_questions(generated, curated)
