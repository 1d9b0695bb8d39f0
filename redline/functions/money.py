"""Money and percentage rendering. ``format_number`` rounds half-even on the exact value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redline import dims


def _plain(c: Column, decimals: int) -> Column:
    return F.replace(F.format_number(c, decimals), F.lit(","), F.lit(""))


def fmt_money(value: Column, tag: Column | None = None) -> Column:
    """$391.0B, -$4.3M, $12K, $950; per-share tags keep two decimals; null shows as a dash."""
    a = F.abs(value)
    sign = F.when(value < 0, "-").otherwise("")

    def scaled(unit, decimals, suffix):
        return F.concat(sign, F.lit("$"), _plain(a / F.lit(unit), decimals), F.lit(suffix))

    compact = (F.when(a >= 1e12, scaled(1e12, 2, "T")).when(a >= 1e9, scaled(1e9, 1, "B"))
               .when(a >= 1e6, scaled(1e6, 1, "M")).when(a >= 1e3, scaled(1e3, 0, "K"))
               .otherwise(F.concat(sign, F.lit("$"), F.format_number(a, 0))))
    shown = compact
    if tag is not None:
        shown = F.when(tag.isin(dims.PER_SHARE_TAGS), F.concat(F.lit("$"), F.format_number(value, 2))).otherwise(compact)
    return F.when(value.isNull(), F.lit("–")).otherwise(shown)


def fmt_signed_pct(pct: Column, decimals: int = 1) -> Column:
    """+2.0%, -3.4%, -0.0% for a move that rounds to zero from below; empty for null."""
    return F.when(pct.isNull(), "").otherwise(
        F.concat(F.when(pct.cast("string").startswith("-"), "-").otherwise("+"), _plain(F.abs(pct), decimals), F.lit("%")))


def fmt_amount_words(value: Column) -> Column:
    """$391.0 billion / $45 million / the bare amount."""
    a = F.abs(value)
    return (F.when(a >= 1e9, F.concat(F.lit("$"), _plain(value / 1e9, 1), F.lit(" billion")))
            .when(a >= 1e6, F.concat(F.lit("$"), _plain(value / 1e6, 0), F.lit(" million")))
            .otherwise(F.concat(F.lit("$"), F.when(value == F.floor(value), value.cast("long").cast("string"))
                                .otherwise(value.cast("string")))))


def direction(pct: Column, tag: Column) -> Column:
    """up / down as good / bad news (inverted for cost-like tags); empty below 0.05 percent."""
    rising = pct > 0
    good = F.when(tag.isin(dims.COST_TAGS), ~rising).otherwise(rising)
    return F.when(pct.isNull() | (F.abs(pct) < 0.05), "").otherwise(F.when(good, "up").otherwise("down"))
