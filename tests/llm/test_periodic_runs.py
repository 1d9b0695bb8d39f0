"""Periodic runs against a plain walk over all lags, on awkward rows, and against the words they leave."""

import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import odd  # noqa: E402

from redline.llm import periodic_runs  # noqa: E402


def plain_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i:j + q]
            if j > i and len(stretch) >= max(6, 4 * q) and not any(
                    all(stretch[k] == stretch[k + d] for k in range(len(stretch) - d)) for d in range(1, q)):
                found.append((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_rest(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def random_words(rng):
    words = []
    while rng.random() < 0.9 and len(words) < 400:
        unit = [f"{rng.randrange(rng.choice([2, 5, 50]))}" for _ in range(rng.choice([1, 2, 3, 5, 12, 16, 17, 25, 33, 64]))]
        words += [unit[i % len(unit)] for i in range(rng.randrange(len(unit), 7 * len(unit) + 3))]
        words += [f"{rng.randrange(rng.choice([2, 30]))}" for _ in range(rng.randrange(20))]
    return words


def test_runs_of_random_texts():
    rng = random.Random(5)
    texts = [random_words(rng) for _ in range(600)]
    got = periodic_runs.runs_of_texts([[w.encode() for w in t] for t in texts])
    assert sum(len(runs) for runs, _ in got) > 800 and max(q for runs, _ in got for *_, q in runs) == 64
    for words, (runs, rest) in zip(texts, got):
        assert runs == plain_runs(words)
        assert rest.decode().split() == plain_rest(words, runs)


def test_limits_of_length_and_period():
    def runs(text):
        return periodic_runs.runs_of_texts([text.encode().split()])[0][0]
    assert runs("a a a a a") == [] and runs("a a a a a a") == [(0, 6, 1)]
    assert runs("a b a b a b a") == [] and runs("a b a b a b a b c") == [(0, 8, 2)]
    assert runs("x a a a a a a b a a a a a a b") == [(1, 6, 1), (8, 6, 1)]
    assert runs("a b c " * 4) == [(0, 12, 3)]  # not also period 6


def test_neighbouring_documents_never_join():
    got = periodic_runs.runs_of_texts([[b"a"] * 4, [b"a"] * 4, [], [b"a"] * 7])
    assert [runs for runs, _ in got] == [[], [], [], [(0, 7, 1)]]


def test_long_texts_with_long_periods():
    rng = random.Random(2)
    unit = [b"%d" % min(rng.randrange(400), rng.randrange(400)) for _ in range(7000)]
    runs, rest = periodic_runs.runs_of_texts([unit * 5 + unit[:11]])[0]
    assert (0, 35_011, 7000) in runs and len(rest.split()) <= 7000


def test_awkward_rows(spark):
    got = periodic_runs.find_runs(odd.documents(spark)).collect()
    words = {}
    for r in odd.rows():
        words.setdefault(r[0], []).append(re.findall(odd.WORDS, r[1] or ""))
    assert len(got) == len(odd.rows())
    for r in got:
        runs = [tuple(x) for x in r.runs]
        assert any(runs == plain_runs(ws[:700]) or len(ws) > 700 for ws in words[r._id])
        assert any(r.n_words == len(ws) and r.collapsed.split() == plain_rest(ws, runs) for ws in words[r._id] if len(ws) < 700
                   ) or r.n_words == 60_000
    long = next(r for r in got if r.n_words == 60_000)
    assert [tuple(x) for x in long.runs] == [(0, 60_000, 2)] and long.collapsed == "Ab cd."
    assert periodic_runs.find_runs(odd.documents(spark, [])).collect() == []


def test_planted_repeats_follow_the_checksum():
    words = [b"w%d" % i for i in range(50)]
    changed = [i for i in range(300) if periodic_runs.plant_repeats(i, words) != words]
    assert 10 < len(changed) < 60 and periodic_runs.plant_repeats(None, words) == words
    assert periodic_runs.plant_repeats(changed[0], []) == []
