"""Metric facts over fiscal years: annual values, year-over-year moves, statement tables.

A fact table may be dominated by one (ticker, tag). Every aggregation below first reduces to one row
per fiscal year with map-side combine, so only the handful of requested years per (ticker, tag) is
ever brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redline import dims
from redline.functions.money import direction, fmt_amount_words, fmt_money, fmt_signed_pct
from redline.functions.text import display_name, fiscal_year_label
from redline.operators.ranking import ordered_positions

KEY = ["ticker", "tag"]


def fact_values(facts: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Facts with a value and an end date, labelled with the fiscal year they end in."""
    out = facts.filter(F.col("val").isNotNull() & F.col("end").isNotNull())
    if tags is not None:
        out = out.filter(F.col("tag").isin(tags))
    return out.withColumn("fy", fiscal_year_label(F.col("end")))


def facts_by_end(values: DataFrame, out: str = "position") -> DataFrame:
    """All values, latest period first, each with its 0-based place: by ranges of dates, not in one task.

    Values of one date follow their ticker, tag, unit and place in the filing.
    """
    ties = [c for c in ("ticker", "tag", "unit", "pos") if c in values.columns]
    return ordered_positions(values, [F.col("end").desc_nulls_last(), *ties], out)


def fiscal_year_value(values: DataFrame, by_unit: bool = False) -> DataFrame:
    """One value per (ticker, tag, fy): the largest annual-report value, else the largest of any form."""
    keys = KEY + (["unit"] if by_unit else []) + ["fy"]
    return values.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("form") == "10-K", F.col("val"))), F.max("val")).alias("value"))


def _by_year(annual: DataFrame, years: list[str]) -> DataFrame:
    """(ticker, tag, by_year MAP<fy, value>) restricted to the requested years."""
    return (annual.filter(F.col("fy").isin(years))
            .groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("fy", "value"))).alias("by_year")))


def _pct(old: Column, new: Column) -> Column:
    size = F.round(F.abs((new - old) / F.abs(old) * 100), 2)
    # negating the rounded size keeps the sign of moves that round to zero
    return F.when(F.abs(old) > 0, F.when(new < old, -size).otherwise(size))


def yoy_deltas(annual: DataFrame, years: list[str]) -> DataFrame:
    """Old and new value, absolute and percentage change for each consecutive requested pair of years."""
    ordered = sorted(years)
    pairs = F.array(*[F.struct(F.lit(a).alias("y_old"), F.lit(b).alias("y_new"))
                      for a, b in zip(ordered, ordered[1:])])
    grid = (_by_year(annual, ordered).select(*KEY, "by_year", F.explode(pairs).alias("p"))
            .select(*KEY, "p.y_old", "p.y_new", F.col("by_year")[F.col("p.y_old")].alias("old"),
                    F.col("by_year")[F.col("p.y_new")].alias("new")))
    return grid.filter(F.col("old").isNotNull() | F.col("new").isNotNull()).select(
        *KEY, "y_old", "y_new", "old", "new",
        (F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))).alias("abs_change"),
        _pct(F.col("old"), F.col("new")).alias("pct_change"))


def metric_series(annual: DataFrame, years: list[str]) -> DataFrame:
    """Value of every requested year with its move against the year just before it (a gap gives null)."""
    ordered = sorted(years)
    steps = F.array(*[F.struct(F.lit(b).alias("fy"), F.lit(a).cast("string").alias("prev_fy"))
                      for a, b in zip([None] + ordered[:-1], ordered)])
    # element_at on a null key is null, so the first year has no predecessor
    grid = (_by_year(annual.filter(F.col("value").isNotNull()), ordered)
            .select(*KEY, "by_year", F.explode(steps).alias("s"))
            .select(*KEY, "s.fy", F.col("by_year")[F.col("s.fy")].alias("value"),
                    F.col("by_year")[F.coalesce("s.prev_fy", F.lit(""))].alias("prev")))
    return grid.select(*KEY, "fy", "value", _pct(F.col("prev"), F.col("value")).alias("pct"))


def statement_table(series: DataFrame, groups=None) -> DataFrame:
    """Display cells in statement order: one row per (ticker, statement, tag, fiscal year)."""
    dim = dims.statement_dim(series.sparkSession, groups)
    return (series.join(F.broadcast(dim), "tag")  # the dimension holds a fixed few dozen rows
            .select("ticker", "title", "group_order", "tag_order", "tag",
                    display_name(F.col("tag"), dims.TAG_LABELS).alias("label"), "fy", "value",
                    fmt_money(F.col("value"), F.col("tag")).alias("value_str"),
                    fmt_signed_pct(F.col("pct")).alias("pct_str"),
                    direction(F.col("pct"), F.col("tag")).alias("direction")))


def statement_wide(table: DataFrame, years: list[str]) -> DataFrame:
    """One row per tag, one display column per year."""
    return (table.groupBy("ticker", "title", "group_order", "tag_order", "tag", "label")
            .pivot("fy", sorted(years)).agg(F.first("value_str")))


def section_deltas(deltas: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Year-over-year rows with the section anchor their tag belongs to."""
    dim = dims.tag_dim(deltas.sparkSession) if tags is None else tags
    return deltas.join(F.broadcast(dim.select("tag", "anchor", "tag_order")), "tag")


def metric_change_signal(deltas: DataFrame, tags: DataFrame | None = None,
                         threshold: float = dims.GUARD_PCT) -> DataFrame:
    """Largest material move among a section's tags, per (ticker, y_old, y_new, anchor)."""
    moved = (section_deltas(deltas, tags).withColumn("move", F.abs("pct_change") / 100.0)
             .filter(F.col("move") >= threshold))
    best = F.max_by(F.struct("tag", "old", "new", F.round("move", 4).alias("pct")),
                    F.struct(F.col("move"), (-F.col("tag_order")).alias("first")))
    return moved.groupBy("ticker", "y_old", "y_new", "anchor").agg(best.alias("m")).select(
        "ticker", "y_old", "y_new", "anchor", "m.*")


def format_deltas(deltas: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """One text block per (ticker, anchor): a line per tag and year pair, in that order."""
    def amount(c):
        return F.coalesce(F.format_number(c, 0), F.lit("N/A"))

    pct = F.when(F.col("pct_change").isNull(), "").otherwise(
        F.concat(F.lit(" ("), fmt_signed_pct(F.col("pct_change")), F.lit(")")))
    line = F.concat(F.col("tag"), F.lit(" "), F.col("y_old"), F.lit("-"), F.col("y_new"), F.lit(": "),
                    amount(F.col("old")), F.lit(" -> "), amount(F.col("new")), pct)
    # bounded: at most one line per tag of the dimension and pair of requested years
    return (section_deltas(deltas, tags).groupBy("ticker", "anchor")
            .agg(F.array_sort(F.collect_list(F.struct("tag", "y_old", "y_new", line.alias("line")))).alias("rows"))
            .select("ticker", "anchor", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text")))


def format_series(series: DataFrame, groups=None) -> DataFrame:
    """One text block per ticker: a line per tag with its values and moves by year."""
    dim = dims.statement_dim(series.sparkSession, groups)
    cell = F.concat(F.col("fy"), F.lit(" "), fmt_money(F.col("value"), F.col("tag")),
                    F.when(F.col("pct").isNull(), "").otherwise(
                        F.concat(F.lit(" ("), fmt_signed_pct(F.col("pct")), F.lit(")"))))
    lines = (series.filter(F.col("value").isNotNull()).join(F.broadcast(dim), "tag")
             .groupBy("ticker", "group_order", "tag_order", "tag")
             .agg(F.array_sort(F.collect_list(F.struct("fy", cell.alias("cell")))).alias("cells"))
             .withColumn("line", F.concat(display_name(F.col("tag"), dims.TAG_LABELS), F.lit(": "),
                                          F.array_join(F.transform("cells", lambda c: c["cell"]), "; "))))
    return (lines.groupBy("ticker")
            .agg(F.array_sort(F.collect_list(F.struct("group_order", "tag_order", "line"))).alias("rows"))
            .select("ticker", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text")))


def generate_questions(facts: DataFrame, docs: DataFrame, tags: list[str] | None = None,
                       limit: int | None = None) -> DataFrame:
    """Numerical questions from annual facts whose period is exactly the document's period.

    ``docs`` carries (ticker, period_end, ticker_order). Revenue falls back to its alternative tags.
    Numbering follows (ticker_order, tag order); ``limit`` keeps the first questions of that order.
    """
    tags = dims.QUESTION_TAGS if tags is None else tags
    revenue = "RevenueFromContractWithCustomerExcludingAssessedTax"
    wanted = [(i, 0, t, t) for i, t in enumerate(tags)]
    wanted += [(tags.index(revenue), j + 1, revenue, alt)
               for j, alt in enumerate(dims.REVENUE_FALLBACKS) if revenue in tags]
    dim = facts.sparkSession.createDataFrame(wanted, "slot int, preference int, asked string, tag string")
    annual = (facts.filter((F.col("form") == "10-K") & (F.col("fp") == "FY") & F.col("start").isNotNull()
                           & (F.col("unit") == "USD") & F.col("tag").isin([w[3] for w in wanted]))
              .join(F.broadcast(dim), "tag"))
    first = (annual.join(docs, (annual.ticker == docs.ticker) & (annual.end == docs.period_end))
             .drop(docs.ticker)
             .groupBy("ticker", "ticker_order", "slot")
             .agg(F.min_by(F.struct("tag", "val", "end"), F.struct("preference", "pos")).alias("f"))
             .select("ticker", "ticker_order", "slot", "f.*"))
    anchored = first.join(F.broadcast(dims.tag_dim(facts.sparkSession).select("tag", "anchor")), "tag")
    if limit is not None:
        anchored = anchored.orderBy("ticker_order", "slot").limit(limit)
    numbered = ordered_positions(anchored, ["ticker_order", "slot"], "qid").withColumn("qid", F.col("qid") + 1)
    fy = F.substring(F.col("end").cast("string"), 1, 4)
    return numbered.select(
        F.concat(F.lower("ticker"), F.lit("-fy"), fy, F.lit("-"), F.lower(F.substring("tag", 1, 24)), F.lit("-"),
                 F.lpad(F.col("qid").cast("string"), 3, "0")).alias("id"),
        F.concat(F.lit("What was "), F.col("ticker"), F.lit("'s "), display_name(F.col("tag"), dims.QUESTION_PHRASES),
                 F.lit(" in FY"), fy, F.lit("?")).alias("question"),
        F.lit("numerical").alias("type"), F.lit("corpus").alias("expected_route"),
        F.array("anchor").alias("gold_chunks"),
        F.struct(F.col("val").alias("value"), F.lit("USD").alias("unit"),
                 fmt_amount_words(F.col("val")).alias("text")).alias("answer"),
        F.concat(F.lit("xbrl:us-gaap:"), F.col("tag")).alias("source"),
        F.col("end").cast("string").alias("period_end"), "ticker")


def gold_span(text: Column, anchor: Column, size: int = dims.GOLD_SPAN_CHARS) -> Column:
    """0-based half-open span starting at the first statement heading found, tried in order."""
    start = F.lit(None).cast("int")
    for name, headings in dims.STATEMENT_HEADINGS.items():
        # matched in the text itself: changing its case could move positions
        found = F.coalesce(*[F.nullif(F.regexp_instr(text, F.lit(rf"(?i)\Q{h}\E")), F.lit(0)) for h in headings])
        start = F.when(anchor == name, found - 1).otherwise(start)
    return F.when(start.isNotNull(), F.array(start, F.least(start + size, F.length(text))))
