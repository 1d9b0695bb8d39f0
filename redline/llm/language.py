"""Language identification by unigrams over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary (and for each byte, for characters outside
it). A text's likelihood is the sum over all ways to cut its words into pieces of the product of their probabilities, by
a forward algorithm. No piece of the vocabulary holds a blank behind another character, so a text's sum is the product
of its words' sums, and a task computes each distinct word once. Probabilities are fitted by expectation-maximisation:
Spark sums expected piece counts over the distinct words of the training texts, the driver normalises them (vocabulary
times languages numbers).

Fitting uses at most ``rows_per_language`` rows of each language (chosen by a hash of the id, whole texts); prediction reads every text whole. Words are runs of letters, lowered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redline.llm.common import bytes_of, column, held_out, map_batches, table
from redline.llm.pieces import SPACE, PieceModel, read_model
from redline.session import cut_lineage

UNKNOWN = "und"
MAX_LANGUAGES = 512
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Vocabulary:
    """Pieces that words of lowered letters can contain, then the 256 bytes."""

    pieces: dict[str, int]

    def __post_init__(self):
        self.longest = max(map(len, self.pieces), default=1)
        self.size = len(self.pieces) + 256
        chars = sorted({c for p in self.pieces for c in p})
        self.char = np.full(0x110000, -1, np.int64)
        self.char[[ord(c) for c in chars]] = np.arange(len(chars))
        self.chars = max(len(chars), 1)
        nodes = {"": 0}  # a trie: one node per prefix, one sorted key per step
        for p in self.pieces:
            for i in range(1, len(p) + 1):
                nodes.setdefault(p[:i], len(nodes))
        self.piece = np.full(len(nodes), -1, np.int64)
        self.piece[[nodes[p] for p in self.pieces]] = list(self.pieces.values())
        step = {nodes[p[:-1]] * self.chars + int(self.char[ord(p[-1])]): n for p, n in nodes.items() if p}
        self.keys = np.array(sorted(step), np.int64)
        self.next = np.array([step[k] for k in self.keys.tolist()], np.int64)

    def walk(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next nodes, -1 where there is none."""
        key = node * self.chars + char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((char >= 0) & (self.keys[at] == key), self.next[at], -1)

    @classmethod
    def of_model(cls, blob: bytes) -> Vocabulary:
        names = [p for p in PieceModel(blob).id_of if _WORD.fullmatch(p.removeprefix(SPACE) or "a") and p == p.lower()]
        return cls({p: i for i, p in enumerate(sorted(names))})


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray
    chance: np.ndarray  # piece by language


def letters_words(text: str | None) -> list[str]:
    words = _WORD.findall((text or "").lower())
    return words if any(any(map(str.isalpha, w)) for w in words) else []


def edges(words: list[str], vocab: Vocabulary) -> tuple[np.ndarray, ...]:
    """Every piece occurrence in every word: (word, begin, end, number of steps, first of ``steps``) and the piece of
    each step. A character outside the vocabulary is one edge over its bytes."""
    size = np.array([len(w) + 1 for w in words])
    text = "".join(SPACE + w for w in words)
    char = vocab.char[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    at, node = np.arange(len(text)), np.zeros(len(text), np.int64)
    single = np.zeros(len(text), bool)
    parts: list[tuple[np.ndarray, ...]] = []
    for n in range(1, vocab.longest + 1):
        node = vocab.walk(node, char[at + n - 1])
        at, node = at[node >= 0], node[node >= 0]
        hit = vocab.piece[node] >= 0
        if n == 1:
            single[at[hit]] = True
        parts.append((word[at[hit]], place[at[hit]], place[at[hit]] + n, np.ones(int(hit.sum()), np.int64),
                      vocab.piece[node[hit]]))
        more = place[at] + n < size[word[at]]
        at, node = at[more], node[more]
    bare = np.flatnonzero(~single)
    raw = [text[i].encode("utf-8", "replace") for i in bare]
    parts.append((word[bare], place[bare], place[bare] + 1, np.array([len(r) for r in raw], np.int64),
                  np.frombuffer(b"".join(raw), np.uint8).astype(np.int64) + len(vocab.pieces)))
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(5))


def _log_weights(e: tuple[np.ndarray, ...], chance: np.ndarray) -> np.ndarray:
    """Log probability of each edge."""
    count, steps = e[3:]
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    return np.add.reduceat(np.log(chance)[steps], first, axis=0)


def _log_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of every slice of rows that begins at ``first``."""
    top = np.maximum.reduceat(values, first, axis=0)
    sizes = np.diff(np.append(first, len(values)))
    return top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, sizes, axis=0)), first, axis=0))


def forward(words: list[str], vocab: Vocabulary, chance: np.ndarray):
    """Log of the sum over all segmentations, per word and language; also what the backward pass needs.

    All sums are kept as logarithms, so neither long words nor rare letters leave the range of numbers.
    """
    n = np.array([len(w) + 1 for w in words])
    e = edges(words, vocab)
    p = _log_weights(e, chance)
    reach = np.full((len(words), n.max() + 1, chance.shape[1]), -np.inf)
    reach[:, 0] = 0.0
    order = np.lexsort((e[0], e[2]))
    stop = np.searchsorted(e[2][order], np.arange(n.max() + 2))
    for j in range(1, n.max() + 1):
        at = order[stop[j]:stop[j + 1]]
        if len(at):
            w = e[0][at]
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            reach[w[first], j] = _log_sums(reach[w, e[1][at]] + p[at], first)
    return reach[np.arange(len(words)), n], (n, e, p, reach)


def expected_counts(words: list[str], times: np.ndarray, vocab: Vocabulary, chance: np.ndarray) -> np.ndarray:
    """Expected uses of each piece per language; ``times`` has how often each word was seen in each language."""
    total, (n, e, p, reach) = forward(words, vocab, chance)
    own, begin, end, count, steps = e
    rest = np.full_like(reach, -np.inf)
    rest[np.arange(len(words)), n] = 0.0
    order = np.lexsort((own, begin))
    stop = np.searchsorted(begin[order], np.arange(n.max() + 1))
    for i in range(n.max() - 1, -1, -1):
        at = order[stop[i]:stop[i + 1]]
        if len(at):
            w = own[at]
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            rest[w[first], i] = _log_sums(rest[w, end[at]] + p[at], first)
    use = np.exp(reach[own, begin] + p + rest[own, end] - total[own]) * times[own]
    out = np.zeros((vocab.size, chance.shape[1]))
    spread = np.repeat(use, count, axis=0)
    for lang in range(chance.shape[1]):
        out[:, lang] = np.bincount(steps, weights=spread[:, lang], minlength=vocab.size)
    return out


def like_lengths(words: list[str], languages: int, cells: int = 1_600_000) -> Iterator[tuple[int, int]]:
    """Slices of words sorted by length whose tables of sums have at most ``cells`` numbers (a single word may have more)."""
    start = 0
    while start < len(words):
        stop = min(start + 4000, len(words))
        while stop - start > 1 and (stop - start) * (len(words[stop - 1]) + 2) * languages > cells:
            stop = start + (stop - start) // 2
        yield start, stop
        start = stop


def fit(docs: DataFrame, vocab: Vocabulary, rows_per_language: int = 500, rounds: int = 3,
        smooth: float = 0.02) -> LanguageModel | None:
    """Fit on a bounded sample of rows with a language outside the held-out quarter; None if there are none.

    The sample is made of the rows of smallest hash of each language. A threshold on the hash, set from the language's count
    to let about twice as many rows pass, keeps the ranking small. More than MAX_LANGUAGES languages raise ValueError.
    """
    spark = docs.sparkSession
    usable = docs.select("doc_id", "lang", "text").filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id") & (F.length("text") > 0))
    ids = usable.select("doc_id", "lang").withColumn("_h", F.xxhash64("doc_id"))
    counts = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    pace = F.greatest(F.lit(1), F.floor(F.col("_n") / (2 * rows_per_language + 100)))
    ids = ids.join(counts, "lang").filter(F.pmod(F.shiftrightunsigned("_h", 24), pace) == 0)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))
    ids = ids.withColumn("_r", rank).filter(F.col("_r") <= rows_per_language).select("doc_id", "lang").distinct()
    ids = cut_lineage(ids)
    languages = [r[0] for r in ids.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if not languages:
        return None
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    at = {x: i for i, x in enumerate(languages)}
    sample = usable.join(F.broadcast(ids), ["doc_id", "lang"])  # MAX_LANGUAGES * rows_per_language ids at most

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[tuple[str, int], int] = {}
        for lang, t in zip(column(b, "lang").to_pylist(), column(b, "text").to_pylist(), strict=True):
            for w in letters_words(t):
                seen[w, at[lang]] = seen.get((w, at[lang]), 0) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()),
             pa.array(list(seen.values()), pa.int64())], ["word", "lang", "n"])
    words = cut_lineage(map_batches(sample, count, "word string, lang int, n long")
                        .groupBy("word", "lang").agg(F.sum("n").alias("n")))
    chance = np.full((vocab.size, len(languages)), 1.0 / vocab.size)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((vocab.pieces, chance))

        def expect(batches):
            pieces, now = shared.value
            v, out = Vocabulary(pieces), None
            for b in batches:
                names = column(b, "word").to_pylist()
                order = sorted(range(len(names)), key=lambda i: len(names[i]))
                names = [names[i] for i in order]
                langs, n = column(b, "lang").to_numpy()[order], column(b, "n").to_numpy()[order]
                for s, stop in like_lengths(names, now.shape[1]):
                    part = names[s:stop]
                    times = np.zeros((len(part), now.shape[1]))
                    times[np.arange(len(part)), langs[s:stop]] = n[s:stop]
                    got = expected_counts(part, times, v, now)
                    out = got if out is None else out + got
            if out is not None:
                piece, lang = np.nonzero(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(piece), pa.array(lang), pa.array(out[piece, lang])], ["piece", "lang", "uses"])
        uses = (words.mapInArrow(expect, "piece long, lang long, uses double")
                .groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toArrow())  # pieces times languages at most
        chance = np.full((vocab.size, len(languages)), smooth)
        chance[uses["piece"].to_numpy(), uses["lang"].to_numpy()] += uses["uses"].to_numpy()
        chance /= chance.sum(axis=0)
        shared.unpersist()
    rows = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    prior = np.array([rows[x] for x in languages], float)
    return LanguageModel(languages, np.log(prior / prior.sum()), chance)


class WordScores:
    """Log sums of the distinct words a task has seen, one row each; emptied when it grows past ``limit``."""

    def __init__(self, vocab: Vocabulary, model: LanguageModel, limit: int = 500_000):
        self.vocab, self.model, self.limit = vocab, model, limit
        self.row: dict[str, int] = {}
        self.values = np.empty((1024, len(model.languages)))

    def add(self, words: list[str]) -> None:
        if len(self.row) > self.limit:
            self.row = {}
        new = sorted({w for w in words if w not in self.row}, key=len)
        for start, stop in like_lengths(new, len(self.model.languages)):
            got, _ = forward(new[start:stop], self.vocab, self.model.chance)
            base = len(self.row)
            while base + len(got) > len(self.values):
                self.values = np.concatenate([self.values, np.empty_like(self.values)])
            self.values[base:base + len(got)] = got
            self.row.update((w, base + i) for i, w in enumerate(new[start:stop]))

    def sums(self, docs: list[list[str]]) -> np.ndarray:
        """Log likelihood per document and language; every document has words."""
        self.add([w for d in docs for w in d])
        rows = np.fromiter((self.row[w] for d in docs for w in d), np.int64)
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])[:-1]])
        return np.add.reduceat(self.values[rows], first, axis=0)


def predict(docs: DataFrame, model: LanguageModel | None, vocab: Vocabulary, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, lang_pred and score (posterior of the prediction, ties to the first in order).

    Null texts, texts without a letter and all texts under an empty model are ``und`` with score 0. Columns of these
    names are replaced.
    """
    held = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast((vocab.pieces, model))
    cache: list[WordScores] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        pieces, m = shared.value
        if m is not None and not cache:
            cache.append(WordScores(Vocabulary(pieces), m))
        names, scores = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
        block, own, size = [], [], 0

        def flush() -> None:
            if block:
                z = cache[0].sums(block) + m.prior
                top = z.argmax(axis=1)
                post = 1.0 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)
                for i, t, s in zip(own, top, post, strict=True):
                    names[i], scores[i] = m.languages[t], s
            block.clear()
            own.clear()
        for i, t in enumerate(bytes_of(column(b, text_col)) if m is not None else []):
            words = letters_words(t.decode("utf-8", "replace")) if t else []
            if words:
                block.append(words)
                own.append(i)
                size += len(t)
            if size > 1 << 20:
                flush()
                size = 0
        flush()
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores)],
                                          [*b.schema.names, "lang_pred", "score"])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in held.schema.fields)
    return map_batches(held, run, f"{fields}lang_pred string, score double")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold, predicted language and its posterior for every document."""
    docs = table(spark, sf_dir, "documents")
    vocab = Vocabulary.of_model(read_model())
    model = fit(docs, vocab)
    return (predict(docs.select("doc_id", "text"), model, vocab)
            .select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score"))
