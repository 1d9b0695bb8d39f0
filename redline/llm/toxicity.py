"""Toxicity: subword-bag embeddings, averaged over short word windows into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams (3 to 6 UTF-8 bytes, blanks around the word
included), so an unseen spelling shares most of its vector with the spellings seen. A window's vector is the mean over its
words; a two-class softmax on it gives the window's probability, and a text scores as its most toxic window. (Averaging
over a whole text would drown two insults in a thousand words.) As the softmax has two classes, only the difference
of its rows matters: every n-gram contributes one number.

Fitting uses at most ``toxic_rows`` and ``clean_rows`` labelled rows (chosen by a hash of the id, whole texts of at most
``max_fit_chars`` code points); scoring reads every text whole.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.llm.common import bytes_of, column, held_out, map_batches, table

BUCKETS = 1 << 18
SIZES = (3, 4, 5, 6)
WINDOW = 8
THRESHOLD = 0.3
BLOCK = 1 << 20
#: ASCII marks that end a word, as white space does.
_MARKS = b"\t\n\x0b\x0c\r.,;:!?\"'()[]{}<>|"
_ENDS = bytes.maketrans(_MARKS, b" " * len(_MARKS))


@dataclass
class ToxicityModel:
    """Share of each n-gram bucket in the logit, and the bias; all that scoring needs."""

    gram_logit: np.ndarray
    bias: float


def byte_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts between single spaces; start of each word; text of each word."""
    parts = [t.lower().encode("utf-8", "replace").translate(_ENDS) for t in texts]
    data = np.frombuffer(b" " + b" ".join(parts) + b" " * 8, np.uint8)
    blank = data == 32
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    ends = np.cumsum([len(p) + 1 for p in parts])
    return data, starts, np.searchsorted(ends, starts, "right")


def gram_buckets(data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size, the byte before which an n-gram's second byte stands, and its bucket. A gram may begin or end
    with the blank around its word, never hold one inside."""
    n_blank = np.concatenate([[0], np.cumsum(data == 32, dtype=np.int32)])
    wide, out = data.astype(np.uint32), []
    code = wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))
    for n in SIZES:
        if n > 3:
            code = code[:-1] * np.uint32(0x01000193) + wide[n - 1:] + np.uint32(n)
        at = np.flatnonzero(n_blank[n - 1:n - 1 + len(code)] == n_blank[1:1 + len(code)])
        out.append((at + 1, (code[at] * np.uint32(0x9E3779B1)) >> np.uint32(14)))
    return out


def word_logits(data: np.ndarray, starts: np.ndarray, gram_logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean logit share over the n-grams of every word, and their number."""
    total, count = np.zeros(len(data)), np.zeros(len(data), np.int32)
    for at, bucket in gram_buckets(data):
        total[at] += gram_logit[bucket]
        count[at] += 1
    n = np.add.reduceat(count, starts)
    return np.add.reduceat(total, starts) / np.maximum(n, 1), n


def score_texts(texts: list[str], model: ToxicityModel, window: int = WINDOW) -> np.ndarray:
    """Probability of the most toxic window of every text; a text without words scores as the bias alone.

    A word that repeats the one before it is read once.
    """
    best = np.full(len(texts), -np.inf)
    data, starts, text = byte_words(texts)
    if len(starts):
        value, n = word_logits(data, starts, model.gram_logit)
        size = np.diff(np.append(starts, len(data)))
        again = (value[1:] == value[:-1]) & (n[1:] == n[:-1]) & (text[1:] == text[:-1]) & (size[1:] == size[:-1])
        keep = np.concatenate([[True], ~again])
        value, text = value[keep], text[keep]
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        length = np.diff(np.append(first, len(text)))
        sums = np.concatenate([[0.0], np.cumsum(value)])
        last = np.repeat(first + length, length)
        here = np.arange(len(text))
        stop = np.minimum(here + window, last)
        whole = (stop - here == window) | (here == np.repeat(first, length))
        mean = np.where(whole, (sums[stop] - sums[here]) / (stop - here), -np.inf)
        best[text[first]] = np.maximum.reduceat(mean, first)
    z = np.where(np.isfinite(best), best, 0.0) + model.bias
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def _word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, one word behind the other, and how many each word has."""
    flat, sizes = [], []
    for s in range(0, len(words), 20_000):
        data, starts, _ = byte_words(words[s:s + 20_000])
        pairs = gram_buckets(data)
        owner = np.concatenate([np.searchsorted(starts, at, "right") - 1 for at, _ in pairs])
        flat.append(np.concatenate([b for _, b in pairs])[np.argsort(owner, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(owner, minlength=len(starts)))
    return np.concatenate(flat), np.concatenate(sizes)


def fit_texts(texts: list[str], toxic: np.ndarray, dim: int = 8, rounds: int = 90, warm: int = 15, rate: float = 0.1,
              decay: float = 1e-4, min_texts: int = 5, window: int = WINDOW, seed: int = 1) -> ToxicityModel:
    """Train embeddings and softmax together by full-batch Adam.

    In the first ``warm`` rounds every window carries its text's label; after that a toxic text teaches through its
    highest window only, a clean one through all its windows and once more, three times as strongly, through its
    highest. N-grams of fewer than ``min_texts`` texts share one vector, which unseen ones get too. Without both classes
    the model is neutral at a low score.
    """
    toxic = np.asarray(toxic, bool)
    index: dict[bytes, int] = {}
    words, docs = array("i"), array("i")
    for d, t in enumerate(texts):
        last = None
        for w in t.lower().encode("utf-8", "replace").translate(_ENDS).split():
            if w != last:  # a word that repeats the one before it is read once
                words.append(index.setdefault(w, len(index)))
                docs.append(d)
            last = w
    if not words or not toxic.any() or toxic.all():
        return ToxicityModel(np.zeros(BUCKETS), -4.0)
    words, docs = np.frombuffer(words, np.int32), np.frombuffer(docs, np.int32)
    head = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    places = np.arange(len(docs)) - np.repeat(head, np.diff(np.append(head, len(docs))))
    first = places % window == 0
    win = np.cumsum(first) - 1
    n_win = int(win[-1]) + 1
    size = np.bincount(win, minlength=n_win)
    doc_of = docs[first]
    label = toxic[doc_of].astype(np.float64)
    start = np.flatnonzero(np.concatenate([[True], doc_of[1:] != doc_of[:-1]]))
    flat, per_word = _word_grams([w.decode("utf-8", "replace") for w in index])
    in_texts = np.bincount(np.unique(words.astype(np.int64) * len(texts) + docs) // len(texts), minlength=len(index))
    offsets = np.concatenate([[0], np.cumsum(per_word)])
    cuts = np.unique(np.append(np.searchsorted(offsets, np.arange(0, offsets[-1], 1 << 20)), len(index)))
    chunks = [(slice(x, y), slice(offsets[x], offsets[y])) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def onto_grams(by_word: np.ndarray, rows: int) -> np.ndarray:
        """What the words pass to the rows of their n-grams."""
        out = np.zeros(rows)
        for w, g in chunks:
            out += np.bincount(flat[g], weights=np.repeat(by_word[w], per_word[w]), minlength=rows)
        return out
    used = np.flatnonzero(onto_grams(in_texts, BUCKETS) >= min_texts)
    row = np.zeros(BUCKETS, np.int32)  # row 0 stands for every rare or unseen n-gram
    row[used] = np.arange(1, len(used) + 1)
    flat = row[flat]
    rng = np.random.default_rng(seed)
    emb, out, bias = rng.normal(0, 0.1, (len(used) + 1, dim)), rng.normal(0, 0.1, dim), 0.0
    state = [[np.zeros_like(emb), np.zeros_like(emb)], [np.zeros(dim), np.zeros(dim)], [np.zeros(1), np.zeros(1)]]
    clean = label == 0
    for step in range(1, rounds + 1):
        share = emb @ out  # a word's part is the mean over its n-grams, a window's the mean over its words
        by_word = np.concatenate([np.add.reduceat(share[flat[g]], offsets[w] - offsets[w.start]) for w, g in chunks])
        z = np.bincount(win, weights=(by_word / per_word)[words], minlength=n_win) / size + bias
        weight = clean / clean.sum()
        if step <= warm:
            weight = weight + label / label.sum()
        else:
            highest = z == np.repeat(np.maximum.reduceat(z, start), np.diff(np.append(start, n_win)))
            for side, strength in ((~clean, 1.0), (clean, 3.0)):
                weight = weight + strength * (highest & side) / (highest & side).sum()
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label) * weight
        by_word = np.bincount(words, weights=(err / size)[win], minlength=len(index)) / per_word
        base = onto_grams(by_word, len(emb))
        grads = [base[:, None] * out + decay / len(emb) * emb, emb.T @ base + decay * out, np.array([err.sum()])]
        moves = []
        for (m, v), g in zip(state, grads, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            moves.append(rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10))
        emb, out, bias = emb - moves[0], out - moves[1], bias - float(moves[2][0])
    shares = emb @ out
    logit = np.full(BUCKETS, shares[0])
    logit[used] = shares[1:]
    return ToxicityModel(logit, bias)


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = 2000, clean_rows: int = 4000,
        max_fit_chars: int = 20_000) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows outside the held-out quarter.

    Rows with null id, text or label take no part; of several labels for one id the highest counts.
    """
    known = (labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
             .filter(F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1) & ~held_out("_id"))
             .groupBy("_id").agg(F.max("_toxic").alias("_toxic")))
    slim = docs.select(F.col("doc_id").alias("_id"), F.length("text").alias("_len"))
    usable = known.join(slim.filter(F.col("_len").between(1, max_fit_chars)).select("_id").distinct(), "_id")
    chosen = None
    for c, rows in ((0, clean_rows), (1, toxic_rows)):
        part = usable.filter(F.col("_toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen_rows = chosen.collect()  # at most clean_rows + toxic_rows pairs of numbers
    if not chosen_rows:
        return ToxicityModel(np.zeros(BUCKETS), -4.0)
    mark = {r["_id"]: r["_toxic"] for r in chosen_rows}
    ids = docs.sparkSession.createDataFrame(pa.table({"_id": pa.array(sorted(mark), pa.int64())}).to_pandas())
    texts = (docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(ids), "_id")
             .filter(F.length("text").between(1, max_fit_chars))
             .groupBy("_id").agg(F.min("text").alias("text")).toArrow().sort_by("_id"))
    keys, bodies = texts["_id"].to_pylist(), texts["text"].to_pylist()
    return fit_texts(bodies, np.array([mark[k] for k in keys]))


def score(docs: DataFrame, model: ToxicityModel, name: str = "score", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the toxicity of each whole text; a column of that name is replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.gram_logit.astype(np.float32), model.bias))  # 1 MB
    keep = [c for c in docs.columns if c.lower() != name.lower()]
    held = docs.select(*keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = ToxicityModel(*shared.value)
        values, block, held_bytes = [], [], 0
        for b in bytes_of(column(batch, text)):
            block.append(b.decode("utf-8", "replace") if b else "")
            held_bytes += len(b or b"")
            if held_bytes >= BLOCK:
                values.append(score_texts(block, model))
                block, held_bytes = [], 0
        values.append(score_texts(block, model))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(values), pa.float64())],
                                          [*batch.schema.names, name])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)
    return map_batches(held, run, f"{fields}, `{name}` double")


def reject(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with the columns they had."""
    from redline.llm.common import free_name

    name = free_name(docs, "toxicity")
    return score(docs, model, name).filter(F.col(name) < threshold).drop(name)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, prediction and fold of every document. Null and empty texts score as the model's bias."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return (score(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out("doc_id").alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
