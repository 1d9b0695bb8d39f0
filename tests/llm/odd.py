"""Small awkward tables, and plain versions of the operators to hold results against."""

import collections
import re

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, score string, _key int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    base = " ".join(f"word{i}" for i in range(80))
    near = base.replace("word40", "other")
    lines = "A shared line of text\nunique one 1\n  a SHARED line of text\t\nshort"
    long_text = "Ab cd. " * 30_000
    texts = [base, near, base.upper(), lines, lines, "", None, " \n\t ", "\n\n", "x", "one two three", "ONE two three",
             long_text, "é😀 ▁x  y\x00z <s>", "a" * 3000, "loser idiot " * 20, base + " tail " * 3, "12 34 !!"]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, None, "clash", "clash", i)
           for i, t in enumerate(texts)]
    out += [out[0], out[3]]  # repeated rows
    out += [(None, base, "en", "s1", 5, None, None, 90), (None, None, None, None, None, None, None, 91),
            (None, lines, "fr", None, 1, None, None, 92)]
    return out


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOC_SCHEMA)


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def line_dedup(data):
    """{doc_id: (n_lines, n_dropped, text)} by a plain walk."""
    def key(x):
        k = ascii_lower(x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
        return k if len(k) >= 10 else None
    holders = collections.defaultdict(set)
    for i, t in data:
        if i is not None:
            for x in (t or "").split("\n"):
                holders[key(x)].add(i)
    out = {}
    for i, t in data:
        xs = (t or "").split("\n")
        kept = [x for x in xs if i is None or key(x) is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out[i, t] = (len(xs), len(xs) - len(kept), None if t is None else "\n".join(kept))
    return out


def shingles(t):
    w = WORDS.findall(ascii_lower(t or ""))
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def near_dup(data, threshold=85):
    """{doc_id: (n_shingles, component)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in data if i is not None}
    part = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(part[a], part[b])
            if part[a] != low or part[b] != low:
                part[a] = part[b] = low
                changed = True
    return {i: (len(sets[i]), part[i]) for i in sets}
