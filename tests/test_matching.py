"""One-to-one matching: bounded and distributed paths against a plain greedy walk."""

import numpy as np
import pandas as pd
import pytest

from redline.operators import matching as M

KEYS = ["sec"]


def greedy(old, new, floor):
    sims = np.round(old @ new.T, 9)
    pairs = sorted((-sims[i, j], i, j) for i in range(len(old)) for j in range(len(new)))
    used_o, used_n, out = set(), set(), set()
    for s, i, j in pairs:
        if -s < floor:
            break
        if i not in used_o and j not in used_n:
            used_o.add(i), used_n.add(j), out.add((i, j, -s))
    return out


def unit(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def side(spark, mats):
    rows = [(k, i, [float(x) for x in v]) for k, m in mats.items() for i, v in enumerate(m)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["sec", "idx", "vector"]),
                                 "sec string, idx long, vector array<double>")


def cases(seed):
    rng = np.random.default_rng(seed)
    # few coordinates and few levels: many exact copies and many ties between different vectors
    return {k: unit(rng.integers(0, 3, (n, 3)).astype(float)) for k, n in (("a", 40), ("b", 25), ("c", 1))}


@pytest.mark.parametrize("large", [False, True])
def test_matches_greedy_walk(spark, large):
    old, new = cases(1), cases(2)
    new["d"] = new.pop("c")  # section only in old, section only in new
    limits = {"max_cells": 0, "tile": 3} if large else {}
    got = M.align(side(spark, old), side(spark, new), 0.5, KEYS, **limits).collect()
    for k in "abcd":
        o, n = old.get(k, np.zeros((0, 3))), new.get(k, np.zeros((0, 3)))
        rows = [r for r in got if r.sec == k]
        assert {(r.old_idx, r.new_idx, r.similarity) for r in rows if r.kind == "matched"} == greedy(o, n, 0.5)
        # matched + removed = old, matched + added = new, each once
        assert sorted(r.old_idx for r in rows if r.kind != "added") == list(range(len(o)))
        assert sorted(r.new_idx for r in rows if r.kind != "removed") == list(range(len(n)))


def test_bounded_problem_many_random_cases():
    for seed in range(300):
        rng = np.random.default_rng(seed)
        o = unit(rng.integers(0, 4, (rng.integers(0, 9), 3)).astype(float))
        n = unit(rng.integers(0, 4, (rng.integers(0, 9), 3)).astype(float))
        i, j, s = M.greedy_pairs(o, n, 0.6)
        assert set(zip(i.tolist(), j.tolist(), s.tolist())) == greedy(o, n, 0.6)


def test_candidate_pairs_are_exactly_those_above_the_floor(spark):
    old, new = cases(3), cases(4)
    got = {(r.sec, r.old_idx, r.new_idx) for r in
           M.candidate_pairs(side(spark, old), side(spark, new), 0.9, KEYS, tile=4).collect()}
    want = {(k, i, j) for k in old for i in range(len(old[k])) for j in range(len(new[k]))
            if np.round(old[k][i] @ new[k][j], 9) >= 0.9}
    assert got == want


def test_zero_floor_keeps_orthogonal_pairs(spark):
    o, n = {"a": np.array([[1.0, 0.0]])}, {"a": np.array([[0.0, 1.0]])}
    kinds = [r.kind for r in M.align(side(spark, o), side(spark, n), 0.0, KEYS).collect()]
    assert kinds == ["matched"]
    kinds = sorted(r.kind for r in M.align(side(spark, o), side(spark, n), 0.9, KEYS).collect())
    assert kinds == ["added", "removed"]


def _text_matches(spark, key, old, new, **limits):
    from redline.operators.matching import align
    from redline.operators.pairing import PAIR
    head = {k: "x" for k in PAIR}

    def frame(texts):
        rows = [{**head, "idx": i, "text": t} for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, ", ".join(f"{k} string" for k in PAIR) + ", idx long, text string")
    out = align(frame(old), frame(new), 0.5, model_key=key, **limits).filter("kind = 'matched'").collect()
    return sorted((r.old_idx, r.new_idx, round(r.similarity, 6)) for r in out)


def test_parallel_vectors_match_alike_on_both_paths(spark):
    text = "alpha beta gamma"
    old, new = [text], [" ".join([text] * 3), "gamma beta alpha alpha beta gamma", text]
    want = _text_matches(spark, "hashed", old, new)
    assert want == _text_matches(spark, "hashed", old, new, max_cells=0) == [(0, 0, 1.0)]


def test_registered_model_is_prefixed_and_normalised_on_both_paths(spark):
    import numpy as np
    from redline.operators.vectors import register_embedder

    def make():
        return lambda texts: np.array([[float(t.startswith("passage: ")) * 4 + len(t), float(t.count("a")), 1.0]
                                       for t in texts])
    register_embedder("e5-test", make)
    old, new = ["aab", "b c d"], ["aab c", "d d d d d"]
    assert _text_matches(spark, "e5-test", old, new) == _text_matches(spark, "e5-test", old, new, max_cells=0)


def _near_parallel(seed, n):
    """Vectors 1e-7 to 1e-3 apart around few directions: many similarities that tie only after rounding."""
    rng = np.random.default_rng(seed)
    base = unit(rng.normal(size=(4, 3)))
    return unit(base[rng.integers(0, 4, n)] + rng.normal(size=(n, 3)) * 10.0 ** rng.integers(-7, -2, (n, 1)))


def test_near_parallel_vectors_match_alike_on_both_paths(spark):
    old, new = {"a": _near_parallel(1, 16), "b": _near_parallel(2, 6)}, {"a": _near_parallel(3, 12), "b": _near_parallel(4, 9)}
    for e in (1e-6, 1e-5, 1e-4):  # the smaller position wins although the other vector is the very same
        old[f"e{e}"] = np.array([[1.0, 0, 0]])
        new[f"e{e}"] = np.array([[np.sqrt(1 - e * e), e, 0], [1.0, 0, 0]])
    sides = side(spark, old), side(spark, new)
    for limits in ({}, {"max_cells": 100, "tile": 4}):
        got = M.align(*sides, 0.5, KEYS, **limits).filter("kind = 'matched'").collect()
        for k in old:
            assert {(r.old_idx, r.new_idx, r.similarity) for r in got if r.sec == k} == greedy(old[k], new[k], 0.5), (k, limits)


def test_rounds_compute_fewer_and_fewer_lists(spark):
    """One crowded direction, so that lists run out: they are renewed for the groups concerned only."""
    rng = np.random.default_rng(8)
    old, new = ({"a": unit(np.array([1.0, 0, 0]) + 0.2 * rng.normal(size=(n, 3)))} for n in (40, 30))
    log = []
    got = M._match_large(side(spark, old), side(spark, new), KEYS, 0.5, 16, log)
    assert {(r.old_idx, r.new_idx, r.similarity) for r in got.filter("kind = 'matched'").collect()} == greedy(
        old["a"], new["a"], 0.5)
    assert log[0] == 70 and max(log[1:]) < 30 and len(log) > 2


def test_section_of_a_task_is_matched_in_strips():
    """22,900 paragraphs a side are one task's work, and no task holds the matrix of all pairs."""
    import tracemalloc
    assert 22_900 ** 2 <= M.MAX_CELLS and 22_900 <= M.MAX_SIDE
    rng = np.random.default_rng(3)
    old, new = (unit(1 + 0.3 * rng.normal(size=(n, 16))) for n in (3000, 2500))
    new[:400] = old[:400]
    new[400:600] = old[0]
    tracemalloc.start()
    i, j, s = M.greedy_pairs(old, new, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.9 * 8 * len(old) * len(new) * 2
    sims = np.round(old @ new.T, 9)
    free_o, free_n = np.ones(len(old), bool), np.ones(len(new), bool)
    assert np.all(np.diff(s) <= 0) and len(i) == len(new)
    for a, b, v in zip(i, j, s):  # each pair is the best among those still free, smaller positions first
        assert free_o[a] and free_n[b] and v == sims[a, b]
        row = np.where(free_n, sims[a], -1)
        col = np.where(free_o, sims[:, b], -1)
        assert row.argmax() == b and col.argmax() == a
        free_o[a] = free_n[b] = False


@pytest.mark.parametrize("strip", [1, 50, 10_000])
def test_short_lists_and_strips_change_nothing(monkeypatch, strip):
    for seed in range(60):
        rng = np.random.default_rng(seed)
        monkeypatch.setattr(M, "STRIP_CELLS", strip)
        monkeypatch.setattr(M, "NEAREST", int(rng.integers(1, 4)))
        monkeypatch.setattr(M, "TOGETHER", int(rng.integers(1, 5)))
        o, n = (unit(rng.integers(0, 3, (rng.integers(1, 40), 3)).astype(float)) for _ in range(2))
        i, j, s = M.greedy_pairs(o, n, 0.6)
        assert set(zip(i.tolist(), j.tolist(), s.tolist())) == greedy(o, n, 0.6), seed


@pytest.mark.parametrize("scale", [1.0, 1e-20, 1e20])
def test_products_in_single_precision_only_preselect(scale):
    """Similarities that single precision cannot tell apart, of vectors of any length; doubles are multiplied for few pairs."""
    rng = np.random.default_rng(11)
    rows, cols = (_near_parallel(s, n) for s, n in ((5, 40), (6, 900)))
    sims = np.round((rows * scale) @ (cols / scale).T, 9)
    closed = np.flatnonzero(rng.random(900) < 0.2)
    sims[:, closed] = -np.inf
    for k in (1, 4, 30):
        (i, j, s), cut = M.best_columns(rows * scale, cols / scale, 0.5, k, closed)
        for r in range(len(rows)):
            best = np.sort(sims[r][sims[r] >= 0.5])[::-1]
            assert np.array_equal(s[i == r], best[:k]) and np.array_equal(s[i == r], sims[r, j[i == r]])
            assert cut[r] == (best[k] if len(best) > k else -np.inf)


def test_few_products_of_a_section_are_double(monkeypatch):
    """A section of one task computes double products for the likely pairs only, and 65,536 paragraphs a side are one task's."""
    assert (1 << 16) ** 2 <= M.MAX_CELLS and 1 << 16 <= M.MAX_SIDE
    seen, exact = [], M._exact
    monkeypatch.setattr(M, "_exact", lambda rows, cols, i, j: seen.append(len(i)) or exact(rows, cols, i, j))
    rng = np.random.default_rng(12)
    old, new = (unit(1 + 0.3 * rng.normal(size=(n, 16))) for n in (2000, 1800))
    i, j, s = M.greedy_pairs(old, new, 0.5)
    assert {(a, b, v) for a, b, v in zip(i.tolist(), j.tolist(), s.tolist())} == greedy(old[:], new, 0.5)
    assert 0 < sum(seen) < len(old) * len(new) / 4


def test_rounds_broadcast_nothing(spark):
    """What a round broadcasts goes through the driver, and there are many rounds: their tables meet by sorting."""
    def plans(df):
        return df._jdf.queryExecution().toString()

    old, new = {"a": unit(np.array([[1.0, 0], [0, 1]]))}, {"a": unit(np.array([[1.0, 0.1]]))}
    seen, cut_lineage = [], M.cut_lineage
    try:
        M.cut_lineage = lambda df: seen.append(plans(df)) or cut_lineage(df)
        got = M._match_large(side(spark, old), side(spark, new), KEYS, 0.5, 8)
    finally:
        M.cut_lineage = cut_lineage
    assert len(seen) > 8 and any("SortMergeJoin" in p for p in seen)
    assert not [p for p in [*seen, plans(got)] if "BroadcastHashJoin" in p]


def _headed(spark, mats):
    rows = [(k, f"{i:032d}", i, [float(x) for x in v]) for k, m in mats.items() for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "sec string, gid string, head long, vector array<double>")


@pytest.mark.parametrize("held, batch", [(1 << 17, 10_000), (7, 5)])
def test_lists_of_large_sections_are_exact(spark, held, batch):
    """Blocks held by tasks, partners streaming past in batches: the best by similarity, then position, and a true cutoff."""
    old, new = ({**cases(s), "z": _near_parallel(s, 30), f"only{s}": np.ones((2, 3))} for s in (1, 2))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = M._block_lists(_headed(spark, old), _headed(spark, new), KEYS, "old", 0.5, held).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    n = 0
    for k in old.keys() & new.keys():
        sims = np.round(old[k] @ new[k].T, 9)
        for i, row in enumerate(sims):
            order = [j for j in np.lexsort((np.arange(len(row)), -row)) if row[j] >= 0.5]
            mine = got[(got.sec == k) & (got.gid == f"{i:032d}")].sort_values(["similarity", "partner_head"], ascending=[False, True])
            assert mine.partner_head.tolist() == order[:M.LISTED] and mine.similarity.tolist() == row[order[:M.LISTED]].tolist()
            assert mine.partner.tolist() == [f"{j:032d}" for j in order[:M.LISTED]] and set(mine.side) <= {"old"}
            cutoff = row[order[M.LISTED]] if len(order) > M.LISTED else None
            assert mine.cutoff.isna().all() if cutoff is None else (mine.cutoff == cutoff).all()
            n += len(mine)
    assert n == len(got)


def test_lists_of_large_sections_shuffle_a_vector_once_per_block(spark):
    """Meetings of tiles copied every vector once per tile of the other side, so the disk grew with the square of a section."""
    rows = _headed(spark, {"a": unit(np.random.default_rng(1).normal(size=(300, 4)))})
    plan = M._block_lists(rows, rows, KEYS, "old", 0.5, 100)
    dealt = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence(0, (_blocks" in dealt and "_tile" not in dealt
