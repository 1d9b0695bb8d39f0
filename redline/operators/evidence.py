"""Citable evidence per report chapter, its text block, and the citations that use it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from redline import dims
from redline.functions.text import display_name
from redline.operators.ranking import top_per_key


def evidence_pool(interpretations: DataFrame, chapters: list | None = None, k: int = dims.MAX_EVIDENCE) -> DataFrame:
    """Validated material and notable rows per (ticker, chapter), material first, at most ``k``, labelled E1..Ek."""
    dim = dims.chapter_dim(interpretations.sparkSession, chapters).select("chapter", "anchor")
    rows = (interpretations.filter(~F.coalesce("unvalidated", F.lit(False)) & F.col("materiality").isin("material", "notable"))
            .join(F.broadcast(dim), "anchor"))  # a fixed handful of chapters
    stem = F.regexp_replace("change_id", r"-\d+$", "")
    seq = F.regexp_extract("change_id", r"-(\d+)$", 1).try_cast("long")
    order = [F.when(F.col("materiality") == "material", 0).otherwise(1), F.col("y_new"), stem, seq]
    return (top_per_key(rows, ["ticker", "chapter"], order, k)
            .withColumn("label", F.concat(F.lit("E"), F.col("rank").cast("string")))
            .withColumn("section_name", display_name(F.col("anchor"), dims.SECTION_NAMES)))


def evidence_block(pool: DataFrame) -> DataFrame:
    """The numbered text block of each (ticker, chapter); at most k rows each by construction."""
    def line(prefix, c, suffix=""):
        return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(prefix), F.col(c), F.lit(suffix)))

    move = F.lit(None).cast("string")
    if "numeric_guard" in pool.columns:
        pct = F.col("numeric_guard.pct") * 100
        move = F.when(pct.isNotNull(), F.concat(
            F.lit("  numeric move: "), F.format_string("%.2f", "numeric_guard.old"), F.lit(" -> "),
            F.format_string("%.2f", "numeric_guard.new"), F.lit(" ("), F.when(pct < 0, "-").otherwise("+"),
            F.replace(F.format_number(F.abs(pct), 0), F.lit(","), F.lit("")), F.lit("%)")))
    text = F.concat_ws("\n", F.concat(F.lit("["), F.col("label"), F.lit("] "), F.col("section_name"), F.lit(" · "),
                                      F.col("y_old"), F.lit(" -> "), F.col("y_new")),
                       line("  what changed: ", "summary"), line("  why: ", "why_it_matters"),
                       line('  was: "', "old_quote", '"'), line('  now: "', "new_quote", '"'), move)
    return (pool.groupBy("ticker", "chapter").agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))).alias("rows"))
            .select("ticker", "chapter", F.array_join(F.transform("rows", lambda r: r["t"]), "\n\n").alias("text")))


def resolve_citations(texts: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """Footnotes (keys, n, label, change_id): known labels in order of first appearance, unknown ones dropped."""
    cited = texts.select(*keys, F.posexplode(F.regexp_extract_all("text", F.lit(r"\[E(\d+)\]"), F.lit(1))).alias("pos", "no"))
    first = cited.groupBy(*keys, F.concat(F.lit("E"), F.col("no")).alias("label")).agg(F.min("pos").alias("pos"))
    known = first.join(pool.select(*keys, "label", "change_id"), [*keys, "label"])
    turn = F.row_number().over(W.partitionBy(*keys).orderBy("pos"))  # at most the labels of one pool
    return known.withColumn("n", turn).select(*keys, "n", "label", "change_id")


def renumber_citations(texts: DataFrame, footnotes: DataFrame, keys: list[str]) -> DataFrame:
    """Texts with each known marker replaced by its footnote number and unknown markers removed."""
    maps = footnotes.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m"))
    pieces = F.split(F.regexp_replace("text", r"\[E(\d+)\]", "\u0001E$1\u0001"), "\u0001")
    # odd pieces are the labels between markers
    shown = F.transform(pieces, lambda p, i: F.when(i % 2 == 0, p).otherwise(
        F.coalesce(F.concat(F.lit("["), F.col("m")[p].cast("string"), F.lit("]")), F.lit(""))))
    return texts.join(maps, keys, "left").select(*keys, F.array_join(shown, "").alias("text"))
