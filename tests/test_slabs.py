"""Query sets too large to share: slabs as large as a task may hold, so rows are copied few times."""

import numpy as np
import pandas as pd
import pytest

from redline.operators import vectors as V


def frames(spark, n_q, n_c, dim=4):
    rng = np.random.default_rng(7)
    out = []
    for name, n in (("query_id", n_q), ("chunk_id", n_c)):
        m = rng.integers(-2, 3, (n, dim)).astype(float)  # few levels: many ties
        out.append(spark.createDataFrame(pd.DataFrame({name: np.arange(n), "vector": [r.tolist() for r in m]}),
                                         f"{name} long, vector array<float>"))
    return out


def hits(df):
    return sorted(tuple(r) for r in df.select("query_id", "chunk_id", "similarity", "rank").collect())


@pytest.mark.parametrize("cells, n_q, n_c", [(1 << 22, 1, 1), (40, 3, 7)])
def test_slabs_equal_the_shared_scan(spark, monkeypatch, cells, n_q, n_c):
    q, c = frames(spark, 30, 70)
    monkeypatch.setattr(V, "SLAB_CELLS", cells)
    assert V.slab_counts(30, 70, 4, 8) == (n_q, n_c)
    assert hits(V.vector_topk(q, c, 5, max_shared_rows=2)) == hits(V.vector_topk(q, c, 5))


def test_the_corpus_is_not_copied_once_for_every_few_queries(spark, monkeypatch):
    """The limit of what is shared is not the size of a slab: copies of the corpus filled the disk."""
    q, c = frames(spark, 200, 300)
    seen, slab_counts = [], V.slab_counts
    monkeypatch.setattr(V, "slab_counts", lambda *a: seen.append(slab_counts(*a)) or seen[-1])
    V.vector_topk(q, c, 5, max_shared_rows=8)
    assert seen == [(1, 1)]
    for nq, nc in ((2_051, 49_231), (24_616, 590_784)):  # copies: at most one for every 32,768 rows, beside those for cores
        n_q, n_c = V.slab_counts(nq, nc, 128, 6)
        assert n_q == 1 and n_c <= max(6, -(-nc // 32_768))


def test_no_queries_and_no_corpus(spark):
    q, c = frames(spark, 9, 20)
    assert V.vector_topk(q, c.limit(0), 5, max_shared_rows=2).count() == 0
    assert V.vector_topk(q.limit(0), c, 5, max_shared_rows=-1).count() == 0
