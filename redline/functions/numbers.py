"""Numbers in prose: extraction, comparison and the material-move signal.

Everything is an expression over arrays, so the numeric guard never leaves the JVM. One regular
expression finds each number together with its unit; look-behind groups report the words in front of
it, which is what decides sign and suppression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redline import dims

_CITATION_LIST = r"(?is)citations?\s*:\s*\[.*?\]"
_CITATION_TAIL = r"(?is)\n?\s*citations?\s*:.*$"
_LOOK_BACK, _CHUNK_BACK = 50, 10
# A negative word counts when all of it lies in the 50 characters before the number.
_NEGATIVE = "|".join(rf"{w}[\s\S]{{0,{_LOOK_BACK - len(w)}}}" for w in dims.NEGATIVE_WORDS)
_BODY = r"\$\s*\(\s*-?\s*[\d,]+(?:\.\d+)?\s*\)|\(\s*\$?\s*-?\s*[\d,]+(?:\.\d+)?\s*\)|-?\s*[\d,]+(?:\.\d+)?"
_UNIT = r"percent|percentage|%|billions?|millions?|thousands?|trillions?|[bmkt]"
# The look-ahead admits only places where a number can start, so the look-behinds stay rare.
_NUMBER = (rf"(?iU)(?=[$(\-\d,]|\s+[\d,])(?:(?<=({_NEGATIVE})))?(?:(?<=(chunk[\s\S]{{0,{_CHUNK_BACK - len('chunk')}}})))?"
           rf"(\$?)((?:{_BODY}))(?:\s*({_UNIT}))?(?!\w)")


def _scale(unit: Column) -> Column:
    pairs = [F.lit(v) for word, s in dims.WORD_SCALES.items() for v in (word, s, word + "s", s)]
    pairs += [F.lit(v) for letter, s in dims.LETTER_SCALES.items() for v in (letter, s)]
    return F.create_map(*pairs)[unit]


def extract_numbers(text: Column, table_scale: Column | None = None) -> Column:
    """Numbers of an answer or paragraph in base units, in reading order (``ARRAY<DOUBLE>``).

    Inline units win over ``table_scale``; parentheses, a leading minus and a negative word shortly
    before make a number negative; a percentage yields its value and its fraction; bare years and
    numbers right after "chunk" are dropped, as is any citation list.
    """
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _CITATION_LIST, ""), _CITATION_TAIL, "")

    # One scan marks every number with its groups; odd pieces between the marks are the numbers.
    marked = F.regexp_replace(F.translate(clean, "\x01\x02", "  "), _NUMBER, "\x01$1\x02$2\x02$3\x02$4\x02$5\x01")
    pieces = F.filter(F.split(marked, "\x01"), lambda _, i: i % 2 == 1)
    hits = F.transform(F.transform(pieces, lambda p: F.split(p, "\x02")), lambda g: F.struct(
        g[0].alias("neg"), g[1].alias("chunk"), g[2].alias("dollar"), g[3].alias("body"), g[4].alias("unit")))
    bare_scale = F.coalesce(F.nullif(table_scale, F.lit(0.0)), F.lit(1.0)) if table_scale is not None else F.lit(1.0)

    # Staged transforms: each lambda variable holds one intermediate value, so nothing is recomputed.
    cleaned = F.transform(hits, lambda h: F.struct(
        F.regexp_replace(h["body"], r"(?U)[$\s]", "").alias("body"), F.lower(h["unit"]).alias("unit"),
        ((h["dollar"] != "") | h["body"].contains("$")).alias("dollar"),
        (h["neg"] != "").alias("neg"), (h["chunk"] != "").alias("chunk")))
    parsed = F.transform(cleaned, lambda h: F.struct(
        h["body"].alias("body"), h["dollar"].alias("dollar"), h["chunk"].alias("chunk"),
        F.regexp_replace(h["body"], r"[(),-]", "").try_cast("double").alias("value"),
        _scale(h["unit"]).alias("inline"), h["unit"].isin("percent", "percentage", "%").alias("percent"),
        (h["body"].contains("-") & ~h["body"].startswith("(")).alias("minus"),
        (h["body"].startswith("(") | h["body"].contains("-") | h["neg"]).alias("negative")))
    kept = F.filter(parsed, lambda h: h["value"].isNotNull() & (h["percent"] | ~(
        h["chunk"] | (h["inline"].isNull() & ~h["dollar"] & h["body"].rlike(r"^[(-]*(19|20)\d{2}\)?$")))))
    signed = F.transform(kept, lambda h: F.struct(
        h["percent"].alias("percent"),
        F.when(h["percent"], F.when(h["minus"], -h["value"]).otherwise(h["value"]))
        .otherwise(F.when(h["negative"], F.lit(-1.0)).otherwise(F.lit(1.0))
                   * h["value"] * F.coalesce(h["inline"], bare_scale)).alias("value")))
    return F.flatten(F.transform(signed, lambda h: F.when(
        h["percent"], F.array(h["value"], h["value"] / 100)).otherwise(F.array(h["value"]))))


def numbers_equal(a: Column, b: Column) -> Column:
    """True when the two arrays hold the same numbers, to two decimals, in any order."""
    def key(c):
        return F.array_sort(F.transform(c, lambda v: F.round(v, 2)))
    return key(a) == key(b)


def numeric_match(numbers: Column, gold: Column, tol: float = 0.05) -> Column:
    """True when some number is within ``tol`` of ``gold`` (absolute 0.01 near zero)."""
    return F.exists(numbers, lambda n: F.when(F.abs(gold) < 1, F.abs(n - gold) < 0.01)
                    .otherwise(F.abs(n - gold) / F.abs(gold) <= tol))


def move_signal(old_numbers: Column, new_numbers: Column, threshold: float = dims.GUARD_PCT,
                min_value: float = dims.GUARD_MIN_VALUE) -> Column:
    """Largest relative move between two number lists as ``STRUCT<old, new, pct>``, or null.

    Lists of equal length pair by position, others by nearest value; the first of equal moves wins.
    """
    olds = F.filter(old_numbers, lambda v: F.abs(v) >= min_value)
    news = F.filter(new_numbers, lambda v: F.abs(v) >= min_value)

    def nearest(o):
        # (distance, position) makes the first of equally near values win
        ranked = F.transform(news, lambda n, i: F.struct(F.abs(n - o).alias("d"), i.alias("i"), n.alias("n")))
        return F.array_min(ranked)["n"]

    same_size = F.size(olds) == F.size(news)
    pairs = F.transform(olds, lambda o, i: F.struct(
        o.alias("old"), F.when(same_size, F.get(news, i)).otherwise(nearest(o)).alias("new")))
    moves = F.transform(
        F.filter(pairs, lambda p: p["old"] != 0),
        lambda p, i: F.struct((-F.abs(p["new"] - p["old"]) / F.abs(p["old"])).alias("neg_pct"), i.alias("i"),
                              p["old"].alias("old"), p["new"].alias("new")))
    best = F.array_min(moves)
    found = ((F.size(olds) > 0) & (F.size(news) > 0) & ~numbers_equal(olds, news)
             & (-best["neg_pct"] >= threshold))
    return F.when(found, F.struct(best["old"].alias("old"), best["new"].alias("new"),
                                  F.round(-best["neg_pct"], 4).alias("pct")))


def numeric_change_signal(old_text: Column, new_text: Column, threshold: float = dims.GUARD_PCT,
                          min_value: float = dims.GUARD_MIN_VALUE) -> Column:
    """:func:`move_signal` between the numbers of two texts."""
    return move_signal(extract_numbers(old_text), extract_numbers(new_text), threshold, min_value)
