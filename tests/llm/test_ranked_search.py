"""Ranked search against plain scoring of all documents, and the exactness of the block bounds."""

import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent))

import odd  # noqa: E402

from redline.llm import ranked_search  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(odd.ascii_lower(text or ""))


def plain_search(docs, queries, k=50):
    """{query id: [(score, doc_id)]} by scoring every document."""
    bags = [(i, Counter(plain_terms(t))) for i, t in docs if plain_terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = {}
    for q, text in queries:
        hits = []
        for i, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(plain_terms(text)) if bag[t])
            if s > 0:
                hits.append((s, i))
        out[q] = sorted(hits, key=lambda h: (-h[0], h[1] is None, h[1] or 0))[:k]
    return out


def as_lists(rows, query_id="item_id"):
    out = {}
    for r in sorted(rows, key=lambda r: (r[query_id], r["rank"])):
        assert r["rank"] == len(out.setdefault(r[query_id], [])) + 1
        out[r[query_id]].append((r["score"], r["doc_id"]))
    return out


def test_terms():
    assert ranked_search.terms("Ab_c9 É x-\x7fÄß\x00z".encode()) == [
        t.encode() for t in plain_terms("Ab_c9 É x-\x7fÄß\x00z")]
    assert ranked_search.terms(None) == ranked_search.terms(b" .,;") == []


def test_awkward_rows(spark):
    docs = odd.documents(spark).withColumnRenamed("_key", "rank")
    queries = [(1, "word1 WORD40 other"), (2, ""), (3, None), (4, "ab cd unseen"), (5, "é😀 shared Line"), (6, "nothing here")]
    got = as_lists(ranked_search.search(docs, spark.createDataFrame(queries, "item_id long, text string")).collect())
    want = {q: h for q, h in plain_search([(r[0], r[1]) for r in odd.rows()], queries).items() if h}
    assert got == want and set(got) == {1, 4, 5}


def test_empty_tables(spark):
    queries = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(odd.documents(spark, []), queries).collect() == []
    assert ranked_search.search(odd.documents(spark), queries.limit(0)).collect() == []


def test_many_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "QUERY_BLOCK", 7)
    rng = random.Random(4)

    def text(n):
        return " ".join(f"t{min(rng.randrange(300), rng.randrange(300))}" for _ in range(n))
    docs = [(i // 2, text(rng.randrange(60))) for i in range(500)]
    queries = [(q, text(rng.randrange(1, 12))) for q in range(20)]
    got = as_lists(ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                                        spark.createDataFrame(queries, "item_id long, text string"), k=9).collect())
    assert got == {q: h for q, h in plain_search(docs, queries, 9).items() if h}


def test_blocks_skip_and_lose_nothing():
    """Topical documents: most blocks are skipped, and the best stay as in plain scoring."""
    rng = np.random.default_rng(3)
    terms, per = 300, 200
    topics = [rng.choice(terms, 40, replace=False) for _ in range(20)]
    sizes, cols, impact = [], [], []
    for d in range(len(topics) * per):
        c = np.sort(rng.choice(topics[d % len(topics)], 25, replace=False))
        sizes.append(len(c))
        cols.append(c)
        impact.append(rng.integers(400_000, 900_000, len(c)))
    sizes, cols, impact = np.array(sizes), np.concatenate(cols), np.concatenate(impact)
    weight = np.full(terms, 3000, np.int64)
    shard = ranked_search.Shard(sizes, cols, impact, weight)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for q in range(30):
        query = np.sort(rng.choice(topics[q % len(topics)], 14, replace=False))
        value = np.zeros(len(sizes), np.int64)
        hit = np.isin(cols, query)
        np.add.at(value, owner[hit], impact[hit] * weight[cols[hit]])
        docs, scores = shard.search(query, 10, 1)
        order = np.lexsort((docs, -scores))[:10]
        want = np.lexsort((np.arange(len(sizes)), -value))[:10]
        assert docs[order].tolist() == want.tolist() and scores[order].tolist() == value[want].tolist()
    assert shard.skipped > shard.opened and shard.scored < 30 * len(sizes) / 4
