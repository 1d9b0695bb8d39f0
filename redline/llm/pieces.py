"""SentencePiece encoding that keeps source offsets, and decoding.

The model file is read directly (a protocol buffer: pieces, trainer and normaliser settings). A text is normalised by
longest-prefix replacement through the model's compiled character map; the normaliser notes, for every character it
writes, the byte of the original at which it came about. The normalised text is cut where no piece of the vocabulary can
join two neighbours, each part is merged by rank (best piece first, leftmost among equals), and every piece is projected
through the alignment to the original byte span it covers. Byte pieces of one character cover nothing but for the last.

Models of kind BPE with normal, byte and control pieces are understood; others raise ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from redline.llm.common import bytes_of, column, map_tasks, table

SPACE = "▁"
MODEL = "piece_bpe_32k.model"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value
    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at:at + size]
        at += size


class CharacterMap:
    """The compiled map: a double-array trie of keys, and a pool of replacements ended by zero bytes."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.pool = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at``, and its replacement."""
        if not self.units:
            return None
        found = None
        node = self._child(0, self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node = self._child(node, unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.pool[found[1]:self.pool.index(b"\0", found[1])]

    @staticmethod
    def _child(node: int, unit: int) -> int:
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))


class PieceModel:
    """Vocabulary, merge ranks and normaliser of one model; caches the pieces of distinct parts of text."""

    def __init__(self, blob: bytes, cache: int = 250_000):
        self.limit = cache
        trainer, normalizer, entries = {}, {}, []
        for number, value in _fields(blob):
            if number == 1:
                entries.append(dict(_fields(value)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.text_of = [e[1].decode() for e in entries]
        kinds = [e.get(3, 1) for e in entries]
        if trainer.get(3, 1) != 2 or set(kinds) - {1, 2, 3, 6}:
            raise ValueError("only BPE models of normal, unknown, control and byte pieces are understood")
        self.bytes_fallback = bool(trainer.get(35, 0))
        self.map = CharacterMap(normalizer.get(2, b""))
        self.prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        self.escape = bool(normalizer.get(5, 1))
        if trainer.get(24, 0) or not self.escape:
            raise ValueError("white space as suffix or unescaped is not understood")
        self.unknown, self.end = kinds.index(2), self.text_of.index("</s>")
        self.unk_surface = trainer.get(44, " ⁇ ".encode()).decode()
        score = {p: struct.unpack("<f", e[2])[0] if 2 in e else 0.0
                 for p, e, k in zip(self.text_of, entries, kinds, strict=True) if k == 1}
        place = {v: r for r, v in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank, self.no_rank = {p: place[v] for p, v in score.items()}, len(place)
        self.id_of = {p: i for i, (p, k) in enumerate(zip(self.text_of, kinds, strict=True)) if k == 1}
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.text_of, kinds, strict=True)) if k == 6}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.control = {i for i, k in enumerate(kinds) if k == 3}
        self.parts = self._part_pattern({p[i:i + 2] for p in self.id_of for i in range(len(p) - 1)})
        self.known: dict[str, tuple[bytes, bytes, str, str]] = {}

    @staticmethod
    def _part_pattern(joined: set[str]) -> re.Pattern:
        """Parts that no piece reaches across, from the pairs of neighbours found inside pieces."""
        if any(b == SPACE and a != SPACE for a, b in joined):
            return re.compile(".+", re.S)
        inner = {c for pair in joined for c in pair}
        alone = {c for c in "\n\t\r" if c not in inner}
        near_letters = {c for pair in joined if any(x.isalnum() for x in pair) for c in pair}
        marks = {c for c in inner if not c.isalnum() and c != SPACE} - near_letters
        some = "".join(map(re.escape, sorted(alone)))
        mark = "".join(map(re.escape, sorted(marks)))
        choices = [rf"{SPACE}*[^\W_]+(?=[{mark}])|{SPACE}*[{mark}]+(?=[^\W_])" if mark else "",
                   f"{SPACE}*[^{SPACE}{some}]+", f"{SPACE}+", f"[{some}]" if some else ""]
        return re.compile("|".join(c for c in choices if c), re.S)

    def normalize(self, data: bytes) -> tuple[str, np.ndarray]:
        """Normalised text and, for each of its characters and its end, the original byte where it begins."""
        if not data:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            text = data.decode("utf-8", "replace").replace(" ", SPACE)
            raw = np.frombuffer(data, np.uint8)
            starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(data))
            return (SPACE + text, np.append(0, starts)) if self.prefix else (text, starts)
        pieces: list[tuple[str, int, int]] = []
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit:
                size, out = hit[0], hit[1].decode("utf-8", "replace")
            else:
                lead = data[at]
                size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                out = data[at:at + size].decode("utf-8", "replace")
            pieces.extend((c, at, at + size) for c in out)
            at += size
        if self.squeeze:
            kept: list[tuple[str, int, int]] = []
            for c in pieces:
                if c[0] != " " or (kept and kept[-1][0] != " "):
                    kept.append(c)
            if kept and kept[-1][0] == " ":
                kept.pop()
            pieces = kept
        if not pieces:
            return "", np.zeros(1, np.int64)
        text = "".join(c for c, _, _ in pieces).replace(" ", SPACE)
        starts = [s for _, s, _ in pieces]
        align = [*starts, pieces[-1][2]]
        return (SPACE + text, np.array([starts[0], *align])) if self.prefix else (text, np.array(align))

    def _merge(self, part: str) -> list[str]:
        """Symbols of one part after all merges: always the best pair, the leftmost among equals."""
        if len(part) > 120:
            return self._merge_long(part)
        rank, none = self.rank.get, self.no_rank
        sym = list(part)
        ranks = [rank(x + y, none) for x, y in zip(sym, sym[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            sym[i] += sym.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(sym[i - 1] + sym[i], none)
            if i < len(ranks):
                ranks[i] = rank(sym[i] + sym[i + 1], none)
        return sym

    def _merge_long(self, part: str) -> list[str]:
        """The same with a queue, for parts of many characters."""
        sym: list[str | None] = list(part)
        left, right = list(range(-1, len(sym) - 1)), list(range(1, len(sym) + 1))
        heap: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(sym):
                both = sym[i] + sym[j]
                if both in self.rank:
                    heapq.heappush(heap, (self.rank[both], i, both))
        for i in range(len(sym) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if sym[i] is None or right[i] >= len(sym) or sym[i] + sym[right[i]] != both:
                continue
            j = right[i]
            sym[i], sym[j] = both, None
            right[i] = right[j]
            if right[j] < len(sym):
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [s for s in sym if s is not None]

    def part(self, part: str) -> tuple[bytes, bytes, str, str]:
        """Ids and characters covered by each (as 32-bit integers), ids as text, and decoded text of a part."""
        hit = self.known.get(part)
        if hit is None:
            symbols = self._merge(part)
            try:
                ids, covers, surface = [self.id_of[x] for x in symbols], [len(x) for x in symbols], part
            except KeyError:
                ids, covers = self._with_unknown(symbols)
                surface = self._surface(ids)
            if len(self.known) >= self.limit:
                self.known.clear()
            self.known[part] = hit = (array("i", ids).tobytes(), array("i", covers).tobytes(),
                                      " ".join(map(str, ids)), surface)
        return hit

    def _with_unknown(self, symbols: list[str]) -> tuple[list[int], list[int]]:
        ids, covers = [], []
        for s in symbols:
            if s in self.id_of:
                ids.append(self.id_of[s])
                covers.append(len(s))
            elif self.bytes_fallback:
                for c in s:
                    raw = c.encode()
                    ids.extend(self.byte_id[b] for b in raw)
                    covers.extend([0] * (len(raw) - 1) + [1])
            else:
                ids.append(self.unknown)
                covers.append(len(s))
        return ids, covers

    def _surface(self, ids) -> str:
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i == self.unknown:
                out.append(self.unk_surface)
            elif i not in self.control:
                out.append(self.text_of[i])
        return "".join(out) + run.decode("utf-8", "replace")

    def _finish(self, surface: str) -> str:
        if self.prefix or self.squeeze:
            surface = surface.lstrip(SPACE) if self.squeeze else surface.removeprefix(SPACE)
        return surface.replace(SPACE, " ")

    def decode(self, ids) -> str:
        """Text of any sequence of ids."""
        return self._finish(self._surface(ids))

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Ids with the end id, begin and end of each piece as bytes of the original, and the parts."""
        text, align = self.normalize(data)
        parts = [self.part(p) for p in self.parts.findall(text)]
        ids = np.append(np.frombuffer(b"".join([p[0] for p in parts]), np.int32), np.int32(self.end))
        covers = np.append(np.frombuffer(b"".join([p[1] for p in parts]), np.int32), np.int32(0))
        stops = align[np.cumsum(covers, dtype=np.int64)]
        return ids, np.append(align[:1], stops[:-1]), stops, parts


def read_model(path: str | None = None) -> bytes:
    """The model file's bytes; the installed public tokenizer by default."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and piece_ids, piece_begins, piece_ends (spans in UTF-8 bytes of the original).

    Null encodes as the empty text: the end id alone, at byte 0. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # half a megabyte
    new = ["piece_ids", "piece_begins", "piece_ends"]
    held = docs.drop(*new)

    def run(m: PieceModel, b: pa.RecordBatch) -> pa.RecordBatch:
        out = ([], [], [])
        for t in bytes_of(column(b, text_col)):
            for to, values in zip(out, m.encode(t or b"")[:3], strict=True):
                to.append(values)
        cols = [pa.array(out[0], pa.list_(pa.int32())), *[pa.array(x, pa.list_(pa.int64())) for x in out[1:]]]
        return pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *new])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in held.schema.fields)
    return map_tasks(held, lambda: partial(run, PieceModel(shared.value)),
                     f"{fields}piece_ids array<int>, piece_begins array<bigint>, piece_ends array<bigint>")


def decode_pieces(df: DataFrame, model: bytes, ids_col: str = "piece_ids", name: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the text of its ids; null ids give null."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    held = df.drop(name)

    def run(m: PieceModel, b: pa.RecordBatch) -> pa.RecordBatch:
        out = [None if x is None else m.decode(x) for x in column(b, ids_col).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, name])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in held.schema.fields)
    return map_tasks(held, lambda: partial(run, PieceModel(shared.value)), f"{fields}`{name}` string")


def token_digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, n_covered) from the same encoding, without carrying arrays around.

    n_covered counts the original bytes inside the spans of the pieces.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # half a megabyte
    slim = docs.select(id_col, text_col)

    def run(m: PieceModel, b: pa.RecordBatch) -> pa.RecordBatch:
        count, ids_hash, text_hash, covered = [], [], [], []
        for t in bytes_of(column(b, text_col)):
            ids, begins, ends, parts = m.encode(t or b"")
            count.append(len(ids))
            line = " ".join([*[p[2] for p in parts], str(m.end)])
            ids_hash.append(hashlib.sha256(line.encode()).hexdigest())
            body = m._finish("".join([p[3] for p in parts]))
            text_hash.append(hashlib.sha256(body.encode("utf-8", "replace")).hexdigest())
            covered.append(int((ends - begins).sum()))
        return pa.RecordBatch.from_arrays(
            [column(b, id_col), pa.array(count, pa.int64()), pa.array(ids_hash, pa.string()),
             pa.array(text_hash, pa.string()), pa.array(covered, pa.int64())],
            [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "n_covered"])
    kind = dict(docs.dtypes)[id_col]
    return map_tasks(slim, lambda: partial(run, PieceModel(shared.value)),
                     f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_covered long")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digests of the encoding of every document, and the digest of the text it decodes to."""
    return token_digests(table(spark, sf_dir, "documents"), read_model())
