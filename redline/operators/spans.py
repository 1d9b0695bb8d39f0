"""Character spans: overlap joins and locating passages in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN_BIN = 2048
GRAM = 5
SHORT_CHARS = 8


def span_overlap(left: DataFrame, right: DataFrame, on: list[str], bin_size: int = SPAN_BIN) -> DataFrame:
    """Pairs of half-open spans of the same document that overlap.

    Columns: left has (on, start, end, ...), right has (on, r_start, r_end, ...). Both sides are cut into
    fixed bins, so the join is an equi-join spread over documents *and* positions; a pair is reported only
    in the bin where its overlap begins.
    """
    def binned(df, start, end):
        last = F.greatest(F.col(end) - 1, F.col(start))
        return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(last / bin_size))))

    joined = binned(left, "start", "end").join(binned(right, "r_start", "r_end"), [*on, "_bin"])
    first = F.floor(F.greatest("start", "r_start") / bin_size)
    return joined.filter((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
                         & (F.col("_bin") == first)).drop("_bin")


def find_passages(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", passage_id: str = "item_id",
                  gram: int = GRAM) -> DataFrame:
    """(doc_id, passage_id, start, end) of the first literal occurrence of each passage in each document.

    The words of a passage other than its first and last must occur as whole words in any document that
    contains it, so one run of such words is an exact join key. A passage of fewer than three words may lie
    inside words; its key is its first characters, looked for at every character. Whole texts are then
    checked literally. An empty or null passage occurs nowhere.
    """
    def words(c):
        return F.split(c, r"(?U)\s+")

    def characters(c):
        return F.split(c, "")

    p = passages.filter(F.length("text") > 0).select(passage_id, F.col("text").alias("passage"))
    inner = F.least(F.lit(gram), F.size(words(F.col("passage"))) - 2)
    by_words = inner >= 1
    p = p.withColumns({"unit": F.when(by_words, "word").otherwise("character"),
                       "g": F.when(by_words, inner).otherwise(F.least(F.lit(SHORT_CHARS), F.length("passage")))})
    kinds = [(r.unit, r.g) for r in p.select("unit", "g").distinct().collect()]  # at most gram + SHORT_CHARS of them
    keys = p.select(passage_id, "unit", "g", F.when(
        F.col("unit") == "word", F.xxhash64(F.slice(words(F.col("passage")), F.lit(2), F.col("g"))))
        .otherwise(F.xxhash64(F.slice(characters(F.col("passage")), F.lit(1), F.col("g")))).alias("key"))
    grams = docs.select(doc_id, F.lit("word").alias("unit"), F.lit(0).alias("g"), F.lit(0).cast("long").alias("key")).limit(0)

    def runs(g):
        starts = F.sequence(F.lit(1), F.size("w") - g + 1)
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, F.lit(g)))))

    for unit, g in sorted(kinds):
        split = words if unit == "word" else characters
        w = docs.select(doc_id, split(F.col("text")).alias("w")).filter(F.size("w") >= g)
        grams = grams.unionAll(w.select(doc_id, F.lit(unit).alias("unit"), F.lit(g).alias("g"),
                                        F.explode(runs(g)).alias("key")))
    near = grams.join(keys, ["unit", "g", "key"]).select(doc_id, passage_id).distinct()
    checked = (near.join(docs.select(doc_id, "text"), doc_id).join(p.select(passage_id, "passage"), passage_id)
               .withColumn("start", F.expr("locate(passage, text)") - 1))
    return checked.filter(F.col("start") >= 0).select(
        doc_id, passage_id, "start", (F.col("start") + F.length("passage")).alias("end"))
