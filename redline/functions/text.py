"""String helpers as column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redline import dims


# White space as Unicode defines it; trimming by set looks only at the ends of a string.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not blanks only."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_heading(c: Column) -> Column:
    """Lower case, single blanks, no dots or colons at either end."""
    return F.btrim(F.lower(collapse_spaces(c)), F.lit(".:"))


def sanitize(c: Column) -> Column:
    """Drop control characters other than tab, newline and carriage return."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def truncate_words(c: Column, limit: int = 500) -> Column:
    """At most ``limit`` characters, cut at the last blank; a blank-free prefix is cut hard."""
    cut = F.substring(c, 1, limit)
    from_end = F.instr(F.reverse(cut), " ")
    keep = F.length(cut) - from_end
    return (F.when(F.length(c) <= limit, c)
            .when((from_end > 0) & (keep > 0), F.substring(cut, F.lit(1), keep))
            .otherwise(cut))


def fiscal_year_label(c: Column) -> Column:
    """``FY`` plus the year in which the period ends; accepts dates and ISO strings."""
    return F.concat(F.lit("FY"), F.substring(c.cast("string"), 1, 4))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def strip_noise_lines(c: Column) -> Column:
    """Remove leaked metadata lines; blank lines stay."""
    pattern = "|".join(f"(?:{p})" for p in dims.NOISE_LINE_PATTERNS)
    kept = F.filter(F.split(c, "\n"), lambda line: ~strip(line).rlike(pattern))
    return F.array_join(kept, "\n")


def squeeze_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def paragraphs(c: Column, sep: str = "\n\n") -> Column:
    """Trimmed, non-empty pieces between literal separators."""
    def ends_white(p):  # trimming by a set walks over the whole string, so only pieces with white ends are trimmed
        return F.lit(WHITE_SPACE).contains(F.substring(p, 1, 1)) | F.lit(WHITE_SPACE).contains(F.substring(p, -1, 1))

    plain = len(sep) == 1 and sep not in ".$|()[{^?*+\\"  # such a separator needs no regular expression
    pieces = F.split(c, sep if plain else "\\Q" + sep + "\\E")
    trimmed = F.transform(pieces, lambda p: F.when(ends_white(p), strip(p)).otherwise(p))
    return F.filter(trimmed, lambda p: p != "")


def display_name(c: Column, names: dict[str, str]) -> Column:
    """Look a key up in a fixed map; unknown keys show as themselves."""
    pairs = [F.lit(v) for item in names.items() for v in item]
    return F.coalesce(F.create_map(*pairs)[c], c)


def doc_prefix(model_key: Column, role: str) -> Column:
    """The text prefix some embedding models expect (``role`` is passage or query)."""
    return F.when(model_key.startswith("e5"), F.lit(role + ": ")).otherwise("")
