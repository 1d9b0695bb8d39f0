"""Quality rules with cross-document line frequency.

Each text gets a few plain measures. Then the normalised lines of all documents (lower case, single blanks) are hashed,
and the distinct documents that hold a line are counted per host. A line that more documents of its host hold than the
limit (``share`` of the host's documents, ``min_docs`` at least) counts as boilerplate and is removed there. A document
that keeps too few words is depleted and rejected.

Rows of one doc_id are one document in the counts; every row is judged on its own text. Rows without doc_id are judged
but not counted. Null and empty hosts are one host. Null texts have no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.llm.common import WordHashes, bytes_of, column, free_name, map_batches, table, window_hashes
from redline.session import cut_lineage

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 5
MIN_WORDS = 10
MIN_DOCS = 20
SHARE = 0.01
MIN_LEFT = 0.3


def repeated_words(words: list[bytes], hashes: WordHashes, width: int = WINDOW) -> int:
    """Words inside runs of ``width`` words that occur twice or more in the list."""
    runs = window_hashes(hashes.of(words), width)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    hit = np.zeros(len(runs), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:len(runs)] += hit
    edge[width:width + len(runs)] -= hit
    return int((np.cumsum(edge) > 0).sum())


def line_hash(line: bytes) -> int | None:
    """Signed 64-bit hash of the normalised line; None without words."""
    words = line.split()
    if not words:
        return None
    h = xxhash.xxh64_intdigest(b" ".join(words).lower())
    return h - (1 << 64) if h >= 1 << 63 else h


def measures(docs: DataFrame) -> DataFrame:
    """Measures of every row and its lines as hashes and word counts; ``docs`` has _id, _host and _text."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cache = WordHashes()
        cols: list[list] = [[] for _ in range(7)]
        for t in bytes_of(column(b, "_text")):
            t = t or b""
            words, lines = t.split(), t.split(b"\n")
            full = [x for x in lines if x.strip()]
            hashes = [line_hash(x) for x in full]
            for to, v in zip(cols, (
                    len(words), len(t.translate(None, BLANKS).decode("utf-8", "replace")),
                    len(t) - len(t.translate(None, SYMBOLS)), len(full) - len(set(full)),
                    repeated_words(words, cache), hashes, [len(x.split()) for x in full]), strict=True):
                to.append(v)
        longs = [pa.array(c, pa.int64()) for c in cols[:5]]
        return pa.RecordBatch.from_arrays(
            [column(b, "_id"), column(b, "_host"), *longs, pa.array(cols[5], pa.list_(pa.int64())),
             pa.array(cols[6], pa.list_(pa.int32()))],
            ["_id", "_host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_hashes",
             "_sizes"])
    return map_batches(docs, run, f"_id {dict(docs.dtypes)['_id']}, _host string, n_words long, word_chars long, "
                                  "n_symbols long, n_dup_lines long, n_repeat_words long, _hashes array<bigint>, "
                                  "_sizes array<int>")


def frequent_lines(measured: DataFrame, share: float, min_docs: int) -> DataFrame:
    """(_id, _hot): for every document, the hashes of its lines that are boilerplate on one of its hosts."""
    facts = (measured.filter("_id is not null")
             .select("_id", "_host", F.explode(F.array_distinct("_hashes")).alias("_hash")))
    docs = measured.filter("_id is not null").groupBy("_host").agg(F.count_distinct("_id").alias("_docs"))
    counts = facts.groupBy("_host", "_hash").agg(F.count_distinct("_id").alias("_n")).filter(F.col("_n") > min_docs)
    hot = cut_lineage(counts.join(docs, "_host").filter(F.col("_n") > F.col("_docs") * share).select("_host", "_hash"))
    return (facts.join(hot, ["_host", "_hash"]).groupBy("_id", "_host").agg(F.collect_set("_hash").alias("_hot")))


def judge(docs: DataFrame, share: float = SHARE, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT,
          min_words: int = MIN_WORDS, id_col: str = "doc_id", host_col: str = "source",
          text_col: str = "text") -> DataFrame:
    """Per row: _id, _host, the measures, base_failed, words_left, kept, _hot (hashes of the lines to remove)."""
    measured = cut_lineage(measures(docs.select(F.col(id_col).alias("_id"),
                                                F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host"),
                                                F.col(text_col).alias("_text"))))
    hot = frequent_lines(measured, share, min_docs)
    joined = measured.join(hot, ["_id", "_host"], "left")
    sizes = F.zip_with("_hashes", "_sizes", lambda h, s: F.when(F.array_contains("_hot", h), 0).otherwise(s))
    left = F.when(F.col("_hot").isNull(), F.col("n_words")).otherwise(
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, s: a + s))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = F.col("_hot").isNotNull() & ((left < min_words) | (left < F.col("n_words") * min_left))
    return (joined.withColumn("base_failed", failed).withColumn("words_left", left)
            .withColumn("kept", ~failed & ~depleted).drop("_hashes", "_sizes"))


def clean(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text",
          **limits) -> DataFrame:
    """The kept rows of ``docs`` with their boilerplate lines removed, all columns as they were otherwise.

    A row is found again by id, host and text; rows without id keep all lines and are judged by the base rules.
    """
    tag = free_name(docs, "_row")
    tagged = docs.withColumn(tag, F.struct(F.col(id_col).alias("i"), F.coalesce(F.col(host_col).cast("string"),
                                                                              F.lit("")).alias("h")))
    verdict = judge(docs, id_col=id_col, host_col=host_col, text_col=text_col, **limits)
    drops = (verdict.filter("_hot is not null").groupBy("_id", "_host").agg(F.first("_hot").alias("_hot")))
    hot = free_name(tagged, "_hot")
    joined = tagged.join(drops.select(F.struct(F.col("_id").alias("i"), F.col("_host").alias("h")).alias(tag),
                                      F.col("_hot").alias(hot)), tag, "left").drop(tag)
    names = docs.columns

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cache, out, keep = WordHashes(), [], []
        least, share = limits.get("min_words", MIN_WORDS), limits.get("min_left", MIN_LEFT)
        for i, (t, gone) in enumerate(zip(bytes_of(column(b, text_col)), column(b, hot).to_pylist(), strict=True)):
            words = (t or b"").split()
            lost = set(gone or ())
            text = b"\n".join(x for x in (t or b"").split(b"\n") if line_hash(x) not in lost) if lost else t
            left = len((text or b"").split())
            fine = len(words) >= least and 100 * repeated_words(words, cache) <= 20 * len(words)
            if fine and (not lost or (left >= least and left >= share * len(words))):
                keep.append(i)
                out.append(text.decode("utf-8", "replace"))
        at = pa.array(keep, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(out, column(b, n).type) if n == text_col else column(b, n).take(at) for n in names], names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(joined, run, fields)


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; its source is its host."""
    return judge(table(spark, sf_dir, "documents")).select(
        F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.col("words_left").cast("long").alias("words_left"))


OP1_SQL = r"""
with word as (
  select doc_id, unnest(ws) as w, unnest(range(len(ws))) as i from (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents)),
size as (select doc_id, count(*) as n_words, sum(length(w)) as word_chars from word group by doc_id),
run as (
  select doc_id, i, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o || ' ' ||
         lead(w, 4) over o as s from word window o as (partition by doc_id order by i)),
again as (
  select doc_id, i from (select *, count(*) over (partition by doc_id, s) as c from run where s is not null)
  where c > 1),
repeated as (
  select doc_id, count(distinct i + k) as n from again, (select unnest(range(5)) as k) group by doc_id),
line as (
  select doc_id, coalesce(source, '') as host, l,
         len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) as n from (
    select doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) as l from documents)),
full_line as (select *, translate(array_to_string(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), ' '),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from line where n > 0),
dup as (select doc_id, count(*) - count(distinct l) as n from full_line group by doc_id),
host as (select coalesce(source, '') as host, count(distinct doc_id) as docs from documents group by 1),
hot as (
  select host, k from (select host, k, count(distinct doc_id) as c from full_line group by host, k)
  join host using (host) where c > 20 and c > docs * 0.01),
remaining as (
  select doc_id, sum(case when hot.k is null then n else 0 end) as words_left, count(hot.k) as n_hot
  from full_line left join hot using (host, k) group by doc_id),
base as (
  select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as n_symbols,
         coalesce(dup.n, 0) as n_dup_lines, coalesce(repeated.n, 0) as n_repeat_words,
         coalesce(words_left, 0) as words_left, coalesce(n_hot, 0) as n_hot
  from documents d left join size using (doc_id) left join dup using (doc_id) left join repeated using (doc_id)
  left join remaining using (doc_id)),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from base)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
       cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
       cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
       not base_failed and not (n_hot > 0 and (words_left < 10 or words_left < n_words * 0.3)) as kept,
       cast(words_left as bigint) as words_left
from judged"""
