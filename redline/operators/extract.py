"""Pages to text and to ordered prose / table segments.

Only the tag reader runs in Python, Arrow batch by Arrow batch; cleaning, headings and sections are
expressions and windows over the extracted lines. Nothing is gathered beyond one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from redline import dims
from redline.functions.headings import detect_heading, scale_factor, section_anchor, table_anchor
from redline.functions.text import collapse_spaces, squeeze_blank_lines, strip, strip_noise_lines
from redline.operators.once import compute_once
from redline.sources.html import read_page

CONTEXT_CHARS = 3000
SLICE = 64  # pages of an Arrow batch that a task reads at a time


def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages a few at a time: what is read from them exists for one slice only."""
    for pdf in batches:
        for at in range(0, len(pdf), SLICE):
            yield pdf.iloc[at:at + SLICE]


def extract_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Replace the page column by its text, without dropped elements, blank-line runs and metadata lines."""
    keep = [c for c in df.columns if c != html]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[out] = ["\n".join(read_page(page, dims.DROPPED_ELEMENTS).strings) for page in pdf[html]]
            yield pdf[[*keep, out]]

    return df.mapInPandas(run, schema).withColumn(out, strip_noise_lines(squeeze_blank_lines(F.col(out))))


def extract_segments(df: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, seg_no, kind, text): prose runs and atomic tables in document order."""
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("seg_no", T.IntegerType()), T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches):
            rows = [(*key, no, kind, text) for *key, page in pdf[[*keys, html]].itertuples(index=False, name=None)
                    for no, (kind, text) in enumerate(read_page(page, dims.DROPPED_ELEMENTS).segments)]
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return df.select(*keys, html).mapInPandas(run, schema)


def segment_lines(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Prose one row per line, tables one row each, with the heading line (if any) the row brings along."""
    pieces = F.when(F.col("kind") == "table", F.array("text")).otherwise(F.split("text", "\n"))
    lines = segments.select(*keys, "seg_no", "kind", F.posexplode(pieces).alias("line_no", "line"))
    # a table opens a section with the first of its lines that is a heading; prose rows have one line
    candidates = F.transform(F.transform(F.split("line", "\n"), strip),
                             lambda x: F.struct(x.alias("line"), detect_heading(x).alias("anchor")))
    own = F.get(F.filter(candidates, lambda c: c["anchor"].isNotNull()), F.lit(0))
    found = compute_once(lines, _found=own)
    return found.withColumns({"heading": F.col("_found.line"), "heading_anchor": F.col("_found.anchor")}).drop("_found")


def sectionize(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds item (last heading seen), item_anchor and run (consecutive rows under one item)."""
    w = W.partitionBy(*keys).orderBy("seg_no", "line_no")
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    # the anchor of a section is worked out once, on its heading row, and carried along with it
    opened = compute_once(lines, _own_anchor=F.when(
        F.col("heading").isNotNull(), section_anchor(F.col("heading"), F.col("heading_anchor"))))
    out = opened.withColumn("item", F.last("heading", ignorenulls=True).over(upto))
    turned = (~F.col("item").eqNullSafe(F.lag("item").over(w))).cast("int")
    return (out.withColumn("_turn", turned).withColumn("run", F.sum("_turn").over(upto)).drop("_turn")
            .withColumn("item_anchor", F.last("_own_anchor", ignorenulls=True).over(upto))
            .withColumn("item_anchor", F.coalesce("item_anchor", F.lit("item1_business"))).drop("_own_anchor", "heading_anchor"))


def _visible(line, start, end):
    """The part of a line that lies in the last CONTEXT_CHARS before ``end``."""
    hidden = F.greatest(end - CONTEXT_CHARS - start, F.lit(0))
    return F.substring(line, (hidden + 1).cast("int"), F.length(line))


def with_table_context(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For every row: the nearest scale line and introducing line of the prose before it in its run."""
    size = F.when(F.col("kind") == "prose", F.length("line") + 1).otherwise(0)
    w = W.partitionBy(*keys, "run").orderBy("seg_no", "line_no")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    prose = F.col("kind") == "prose"
    rows = (rows.withColumn("_start", F.coalesce(F.sum(size).over(before), F.lit(0)))
            .withColumn("_scale", scale_factor(F.col("line"))))
    mark = F.struct(strip(F.col("line")).alias("line"), F.col("_start").alias("start"))
    # the total ends without the separator of its last line
    end = F.col("_start") - 1
    out = (rows.withColumn("_s", F.last(F.when(prose & F.col("_scale").isNotNull(), mark), True).over(before))
           .withColumn("_i", F.last(F.when(prose & F.col("_scale").isNull() & F.col("heading").isNull()
                                           & (strip(F.col("line")) != ""), mark), True).over(before)))
    return (out.withColumn("scale_line", F.nullif(_visible(F.col("_s.line"), F.col("_s.start"), end), F.lit("")))
            .withColumn("table_scale", scale_factor(F.col("scale_line")))
            .withColumn("scale_line", F.when(F.col("table_scale").isNotNull(), F.col("scale_line")))
            .withColumn("intro_line", F.nullif(_visible(F.col("_i.line"), F.col("_i.start"), end), F.lit("")))
            .withColumn("intro_line", F.when(F.length("intro_line") > 300, F.concat(
                F.substring("intro_line", 1, 300), F.lit("..."))).otherwise(F.col("intro_line")))
            .drop("_s", "_i", "_scale", "_start"))


def with_table_chunk(rows: DataFrame) -> DataFrame:
    """Adds table_anchor and table_text to table rows: context prefix without repetition, statement anchor."""
    norm = F.lower(collapse_spaces(F.col("line")))

    def unless_present(c):
        return F.when(~norm.contains(F.lower(collapse_spaces(F.col(c)))), F.col(c))

    text = F.concat_ws("\n", F.col("item"), unless_present("scale_line"), unless_present("intro_line"), F.col("line"))
    heading = F.concat_ws("\n", F.col("item"), F.substring("line", 1, 500))
    table = F.col("kind") == "table"
    return rows.withColumns({"table_anchor": F.when(table, table_anchor(heading, F.col("item_anchor"))),
                             "table_text": F.when(table, text)})


def table_chunks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Atomic table chunks alone."""
    return with_table_chunk(rows.filter("kind = 'table'")).select(
        *keys, "seg_no", "line_no", F.col("table_anchor").alias("anchor"), "item", F.lit("table").alias("type"),
        "table_scale", F.col("table_text").alias("text"))


def anchor_violations(chunks: DataFrame, keys: list[str], required: list[str] | None = None) -> DataFrame:
    """(keys, anchor) of required anchors a document lacks."""
    need = F.array(*[F.lit(a) for a in (required or dims.REQUIRED_ANCHORS)])
    wanted = chunks.select(*keys).distinct().select(*keys, F.explode(need).alias("anchor"))
    return wanted.join(chunks.select(*keys, "anchor"), [*keys, "anchor"], "left_anti")


def assert_anchor_coverage(chunks: DataFrame, keys: list[str], required: list[str] | None = None) -> DataFrame:
    """Return stored ``chunks`` or raise, naming some of the documents and anchors that are missing."""
    missing = anchor_violations(chunks, keys, required).limit(20).collect()
    if missing:
        raise RuntimeError("Anchor coverage failed: " + "; ".join(
            " ".join(str(r[k]) for k in keys) + f" lacks {r['anchor']}" for r in missing))
    return chunks


def refuse_missing(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """``chunks`` whose evaluation fails, naming document and anchors, where ``missing`` (dropped here) is not empty.

    The check runs inside the pass that computes the texts; there is no second one.
    """
    message = F.concat(F.lit("Anchor coverage failed: "), F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]),
                       F.lit(" lacks "), F.array_join("missing", ", "))
    text = F.when(F.size("missing") > 0, F.raise_error(message)).otherwise(F.col("text"))
    return chunks.withColumn("text", text).drop("missing")
