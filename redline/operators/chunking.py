"""Cutting documents into chunks."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from redline import dims
from redline.functions.text import strip
from redline.operators import extract as X

SLICE = 64  # texts of an Arrow batch that a task takes apart at a time


def chunk_windows(df: DataFrame, keys: list[str], size: int = dims.FIXED_CHUNK_CHARS,
                  overlap: int = dims.FIXED_OVERLAP_CHARS) -> DataFrame:
    """Plain overlapping windows, by expressions only; the last window is the first that reaches the end."""
    step = size - overlap
    n = F.length("text")
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step) * step)
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long")))
    return (df.select(*keys, "text", n.cast("long").alias("_n"), F.explode(starts).alias("span_start"))
            .select(*keys, F.floor(F.col("span_start") / step).alias("chunk_no"), "span_start",
                    F.least(F.col("span_start") + size, F.col("_n")).alias("span_end"),
                    F.expr(f"substring(text, int(span_start) + 1, {size})").alias("text"))
            .filter(strip(F.col("text")) != ""))


def chunk_fixed(df: DataFrame, keys: list[str], size: int = dims.FIXED_CHUNK_CHARS,
                overlap: int = dims.FIXED_OVERLAP_CHARS, window: int = dims.SNAP_WINDOW) -> DataFrame:
    """Overlapping windows whose ends move to the nearest blank line within ``window`` characters.

    Each end depends on the one before, so a document is walked in order; documents run in parallel.
    """
    @F.pandas_udf("array<struct<span_start:int,span_end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts.fillna(""):
            found, pos, n = [], 0, len(text)
            while pos < n:
                end = n
                if pos + size < n:
                    target = pos + size
                    near = _nearest_break(text, target, window)
                    end = target if near is None or near <= pos else near
                found.append((pos, end))
                if end == n:
                    break
                pos = max(end - overlap, pos + 1)
            out.append(found)
        return pd.Series(out)

    cut = df.select(*keys, "text", F.explode(spans(F.col("text"))).alias("s"))
    pieces = cut.select(*keys, "s.span_start", "s.span_end", strip(F.expr(
        "substring(text, s.span_start + 1, s.span_end - s.span_start)")).alias("text")).filter("text <> ''")
    w = W.partitionBy(*keys).orderBy("span_start")  # one document per partition
    return pieces.withColumn("chunk_no", (F.row_number().over(w) - 1).cast("long"))


def _nearest_break(text: str, target: int, window: int):
    """Blank line nearest to ``target``, looking ``window`` characters either way; the earlier one on a tie."""
    before = text.rfind("\n\n", max(0, target - window), target + 1)
    after = text.find("\n\n", target, min(len(text), target + window))
    if before < 0 or after < 0:
        found = max(before, after)
        return None if found < 0 else found
    return before if target - before <= after - target else after


def _cut_line(line: str, limit: int):
    """An overlong line in pieces of at most ``limit``, at a blank if one lies in the second half."""
    while line:
        end = limit
        if len(line) > limit:
            blank = line.rfind(" ", 0, limit)
            end = blank + 1 if blank > limit // 2 else limit
        piece = line[:end].strip()
        if piece:
            yield piece
        line = line[end:]


def _pack(pieces, sep: str, limit: int, target: int | None = None):
    """Greedy runs of pieces: close before the limit would be passed, and once the target is reached."""
    held, size = [], 0
    for p in pieces:
        if held and size + len(sep) + len(p) > limit:
            yield sep.join(held)
            held, size = [], 0
        size += len(p) + (len(sep) if held else 0)
        held.append(p)
        if target is not None and size >= target:
            yield sep.join(held)
            held, size = [], 0
    if held:
        yield sep.join(held)


def _prose_chunks(text: str, target: int, limit: int) -> list[str]:
    chunks = []
    for run in _pack([p.strip() for p in text.split("\n\n") if p.strip()], "\n\n", limit, target):
        if len(run) <= limit:
            chunks.append(run)
            continue
        for packed in _pack([ln.strip() for ln in run.split("\n") if ln.strip()], "\n", limit):
            chunks.extend([packed] if len(packed) <= limit else _cut_line(packed, limit))
    return chunks


def split_prose(text: Column, target: int = dims.TARGET_CHUNK_CHARS, limit: int = dims.MAX_CHUNK_CHARS) -> Column:
    """``ARRAY<STRING>`` of prose chunks: whole paragraphs, else whole lines, else cuts inside a line."""
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        # only the texts of one slice and their chunks exist as Python objects
        return pa.concat_arrays([pa.array([], kind)] + [
            pa.array([_prose_chunks(t or "", target, limit) for t in texts.slice(at, SLICE).to_pylist()], kind)
            for at in range(0, len(texts), SLICE)])

    return run(text)


CHUNK_TYPE = "array<struct<anchor:string,item:string,type:string,table_scale:double,text:string>>"


def _joins(prev: tuple, new: tuple, min_chars: int, limit: int) -> bool:
    """Whether a chunk (anchor, item, type, table_scale, text) is short prose that fits behind the prose chunk before it."""
    return (prev[2] == new[2] == "prose" and len(new[4]) < min_chars and prev[0] == new[0]
            and len(prev[4]) + 2 + len(new[4]) <= limit)


def merge_small(chunks: Column, min_chars: int = dims.MIN_CHUNK_CHARS, limit: int = dims.MAX_CHUNK_CHARS) -> Column:
    """Short prose chunks of a document joined to the prose chunk before them, same anchor, within the limit; one pass."""
    names = ["anchor", "item", "type", "table_scale", "text"]

    @F.pandas_udf(CHUNK_TYPE)
    def run(documents: pd.Series) -> pd.Series:
        out = []
        for document in documents:
            kept: list[tuple] = []
            for c in (tuple(c[n] for n in names) for c in document):
                if kept and _joins(kept[-1], c, min_chars, limit):
                    kept[-1] = (*kept[-1][:4], kept[-1][4] + "\n\n" + c[4])
                else:
                    kept.append(c)
            out.append([dict(zip(names, c, strict=True)) for c in kept])
        return pd.Series(out)

    return run(chunks)


def _chunk_folder(keys: list[str], required: list[str], target: int, limit: int, min_chars: int):
    """Table function body: the lines of one document in order go in, its chunks come out.

    It holds the prose since the last table or heading and the chunk before, nothing else of the document. A short prose chunk
    joins the prose chunk before it (same anchor, within the limit). The document's last chunk carries ``missing``, the
    required anchors that no chunk of it has.
    """
    class Fold:
        def __init__(self):
            self.key = self.block = self.held = None
            self.lines: list[str] = []
            self.no = self.at = 0
            self.anchors: set = set()

        def chunks(self):
            if self.lines:
                anchor, item = self.block[1:]
                for text in _prose_chunks("\n".join(self.lines), target, limit):
                    yield anchor, item, "prose", None, text
                self.lines = []

        def emit(self, new):
            for chunk in new:
                if self.held and _joins(self.held, chunk, min_chars, limit):
                    self.held = (*self.held[:4], self.held[4] + "\n\n" + chunk[4])
                    continue
                if self.held:
                    yield self.row(self.held, None)
                self.held = chunk

        def row(self, chunk, missing):
            anchor, item, kind, scale, text = chunk
            self.anchors.add(anchor)
            out = (*self.key, self.no, anchor, item, kind, scale, text, self.at, self.at + len(text), missing)
            self.no, self.at = self.no + 1, self.at + len(text)
            return out

        def eval(self, row):
            if self.key is None:
                self.key = tuple(row[k] for k in keys)
            if row["kind"] == "table":
                yield from self.emit(self.chunks())
                yield from self.emit([(row["table_anchor"], row["item"], "table", row["table_scale"], row["table_text"])])
                self.block = None
            else:
                block = row["run"], row["item_anchor"], row["item"]
                if self.block is not None and block[0] != self.block[0]:
                    yield from self.emit(self.chunks())
                if not self.lines:
                    self.block = block
                self.lines.append(row["line"])

        def terminate(self):
            if self.key is not None:
                yield from self.emit(self.chunks())
                if self.held:
                    self.anchors.add(self.held[0])
                    yield self.row(self.held, [a for a in required if a not in self.anchors])

    return Fold


def chunk_sectionaware(pages: DataFrame, keys: list[str], html: str = "html", required: list[str] | None = None,
                       target: int = dims.TARGET_CHUNK_CHARS, limit: int = dims.MAX_CHUNK_CHARS,
                       min_chars: int = dims.MIN_CHUNK_CHARS, keep_missing: bool = False) -> DataFrame:
    """Section-aware chunks of every document, in order, with spans in the rebuilt text.

    Prose between two tables or headings is packed together; tables stay whole. Pages are parsed once and their lines
    shuffled once, by document; a table function then packs, merges, numbers and checks in one pass over the ordered lines.
    ``required`` anchors (pass an empty list for none): a document that lacks one makes the evaluation fail, or, with
    ``keep_missing``, has them in ``missing`` of its last chunk.
    """
    segments = X.extract_segments(pages, keys, html)
    rows = X.with_table_chunk(X.with_table_context(X.sectionize(X.segment_lines(segments, keys), keys), keys))
    lines = rows.select(*keys, "seg_no", "line_no", "kind", "run", "item", "item_anchor", "table_scale", "table_anchor",
                        "table_text", F.when(F.col("kind") == "prose", F.col("line")).alias("line"))
    required = dims.REQUIRED_ANCHORS if required is None else required
    schema = T.StructType([pages.schema[k] for k in keys] + [
        T.StructField("chunk_no", T.LongType()), T.StructField("anchor", T.StringType()), T.StructField("item", T.StringType()),
        T.StructField("type", T.StringType()), T.StructField("table_scale", T.DoubleType()),
        T.StructField("text", T.StringType()), T.StructField("span_start", T.LongType()),
        T.StructField("span_end", T.LongType()), T.StructField("missing", T.ArrayType(T.StringType()))])
    fold = F.udtf(_chunk_folder(keys, required, target, limit, min_chars), returnType=schema)
    out = fold(lines.asTable().partitionBy(*keys).orderBy("seg_no", "line_no"))
    if keep_missing:
        return out
    return X.refuse_missing(out, keys) if required else out.drop("missing")


def with_chunk_ids(chunks: DataFrame, strategy: str) -> DataFrame:
    """Adds ``strategy`` and the readable chunk id of filings (ticker, period_end, chunk_no)."""
    return chunks.withColumn("strategy", F.lit(strategy)).withColumn("chunk_id", F.concat(
        F.lower("ticker"), F.lit("-10k-"), F.col("period_end").cast("string"), F.lit(f"-{strategy}-"),
        F.format_string("%04d", F.col("chunk_no"))))


def chunk_both(filings: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Chunks of both strategies for filings (ticker, fiscal_year, period_end, html)."""
    keys = ["ticker", "fiscal_year", "period_end"]
    fixed = with_chunk_ids(chunk_fixed(X.extract_text(filings.select(*keys, "html")), keys), "fixedsize").withColumns({
        "anchor": F.lit(None).cast("string"), "item": F.lit(None).cast("string"), "type": F.lit("prose"),
        "table_scale": F.lit(None).cast("double")}).withColumns({
            "span_start": F.col("span_start").cast("long"), "span_end": F.col("span_end").cast("long")})
    aware = with_chunk_ids(chunk_sectionaware(filings, keys, required=required), "sectionaware")
    return fixed.unionByName(aware).withColumn("page", F.lit(None).cast("int"))
