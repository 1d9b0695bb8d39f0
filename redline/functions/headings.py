"""Section headings: which line is one, and which anchor it opens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from redline import dims
from redline.functions.text import normalize_heading, strip

_ITEM_START = r"(?i)^Item\s+\d+[A-Z]?\b"
_ITEM_NUMBER = r"\bitem\s+(\d+[a-z]?)\b"


def item_anchor(header: Column) -> Column:
    """Anchor of an ``Item N`` header: the number must agree and the keyword must occur."""
    norm = normalize_heading(header)
    number = F.regexp_extract(norm, _ITEM_NUMBER, 1)
    table = F.create_map(*[F.lit(v) for anchor, keyword in dims.ITEM_KEYWORDS.items()
                           for v in (anchor[len("item"):anchor.index("_")], anchor + "|" + keyword)])
    entry = table[number]
    return F.when(header.isNotNull(), (
        F.when(number == "", "unknown")
        .when(norm.contains(F.substring_index(entry, "|", -1)), F.substring_index(entry, "|", 1))
        .otherwise(F.concat(F.lit("item"), number, F.lit("_unknown")))))


def resolve_anchor(anchor: Column) -> Column:
    """Replace ``item<N>_unknown`` where the item number alone settles the section."""
    known = {a[len("item"):a.index("_")]: a for a in dims.ITEM_SECTIONS}
    pairs = [F.lit(v) for n in dims.UNAMBIGUOUS_ITEMS for v in (f"item{n}_unknown", known[n])]
    return F.coalesce(F.create_map(*pairs)[anchor], anchor)


def detect_heading(line: Column) -> Column:
    """Anchor the line opens as a heading, else null."""
    line = strip(line)
    rest = F.regexp_replace(strip(F.regexp_replace(line, _ITEM_START, "")), r"^[.:\s]+", "")
    titled = (F.length(rest) > 3) & rest.rlike(r"\p{L}")
    bare = F.length(line) <= 15
    keyword = reduce(lambda chain, pa: chain.when(line.rlike("(?iu)" + pa[0]), pa[1]),
                     dims.HEADING_PATTERNS, F.when(F.length(line) > 120, F.lit(None).cast("string")))
    return (F.when(line.rlike(_ITEM_START), F.when(titled | bare, item_anchor(line)))
            .otherwise(keyword))


def section_anchor(heading: Column, detected: Column) -> Column:
    """Anchor of the section a heading line opens, given what :func:`detect_heading` said about it.

    No heading yet means the opening section.
    """
    return F.when(heading.isNull(), "item1_business").otherwise(
        resolve_anchor(F.coalesce(detected, item_anchor(heading))))


def table_anchor(heading: Column, fallback: Column) -> Column:
    """Statement a table belongs to, by the words around it; else the enclosing section."""
    norm = normalize_heading(heading)

    def has(*words):
        return reduce(lambda a, b: a | b, [norm.contains(w) for w in words])

    return (F.when(has("statement of operations", "income statement", "consolidated statements of operations",
                       "consolidated statements of income", "consolidated statement of income"), "income_statement")
            .when(has("operations") & has("income"), "income_statement")
            .when(has("balance sheet") | (has("assets") & has("liabilities") & has("equity")), "balance_sheet")
            .when(has("cash flow"), "cash_flow")
            .when(has("stockholders' equity", "shareholders' equity", "stockholders equity",
                      "shareholders equity"), "stockholders_equity")
            .when(has("notes to", "note ", "notes —", "notes-") & has("financial", "consolidated"),
                  "notes_to_financials")
            .otherwise(fallback))


def scale_factor(line: Column) -> Column:
    """1e3 / 1e6 / 1e9 when the line says the amounts are in thousands / millions / billions."""
    word = F.lower(F.regexp_extract(line, r"(?i)\(?\s*in\s+(millions|thousands|billions)", 1))
    return (F.when(word == "billions", 1e9).when(word == "millions", 1e6).when(word == "thousands", 1e3))
