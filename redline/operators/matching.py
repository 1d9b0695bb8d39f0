"""One-to-one alignment of the paragraphs of two versions of a section.

Wanted: walk all (old, new) pairs by similarity downwards, ties by old then new position, and take a
pair when both ends are still free. That sequential rule equals repeatedly taking every pair in which
each end is the other's best free partner, which is what both paths below do:

* ordinary sections (size checked per section pair) run as one task per section, which walks down a heap of
  short partner lists and holds a strip of similarities at a time;
* sections beyond the bound are matched by rounds of distributed work. Equal vectors are one group with a
  count. Blocks of ``HELD`` groups are held by a task each while the groups of the other side stream past them,
  and leave with the ``LISTED`` best partners per group; these lists are kept. A round joins lists only; a group
  is multiplied again only when its list ran out while there are partners beyond it. No list of all pairs is
  ever materialised, a vector is copied once per block of the other side, and no section has to fit in a task.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from redline import dims
from redline.operators.pairing import PAIR
from redline.operators.ranking import BLOCK, rank_within, top_per_key
from redline.operators.vectors import DIGITS, as_matrix, embed, embedder_factory, text_vectors
from redline.session import cut_lineage, discard

MAX_CELLS = 1 << 32     # old x new similarities of one section computed by one task, STRIP_CELLS at a time
MAX_SIDE = 1 << 16      # paragraphs of one side in one task
STRIP_CELLS = 1 << 21   # similarities a task holds at once (16 MB)
SENT = 8192             # rows that leave a task in one Arrow batch
NEAREST = 32            # partners a row knows in a task
TOGETHER = 256          # rows whose partners are looked up again in one go
SPREAD = 4              # partitions of sections for each configured shuffle partition
TILE = 1024
LISTED = 6              # partners kept per group of equal vectors between rounds
HELD = 1 << 17          # groups of a section too large for one task that a task holds at a time


def _equal_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row of each group of equal rows, rows sorted by group then position, where each group starts in them)."""
    raw = np.ascontiguousarray(m + 0.0).view(f"V{m.itemsize * m.shape[1]}").ravel()
    _, first, group = np.unique(raw, return_index=True, return_inverse=True)
    members = np.argsort(group, kind="stable")
    return first, members, np.append(np.searchsorted(group[members], np.arange(len(first))), len(m))


def _single(m: np.ndarray) -> tuple[np.ndarray, float]:
    """A matrix in single precision and the length of its longest row (infinite where single precision will not do)."""
    top = float(np.sqrt(np.einsum("ij,ij->i", m, m).max(initial=0.0)))
    return m.astype(np.float32), top if top < 1e6 else np.inf


def _exact(rows: np.ndarray, cols: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Similarities of the row and column pairs ``i``, ``j``, a bounded number of pairs at a time."""
    step = max(1, STRIP_CELLS // (2 * rows.shape[1]))
    parts = [np.einsum("ij,ij->i", rows[i[at:at + step]], cols[j[at:at + step]]) for at in range(0, len(i), step)]
    return np.round(np.concatenate(parts), DIGITS) if parts else np.zeros(0)


def best_columns(rows: np.ndarray, cols: np.ndarray, floor: float | np.ndarray, k: int, closed: np.ndarray | None = None,
                 single=None):
    """(row, column, similarity) of the ``k`` best columns of every row, best first, and each row's cutoff: columns more
    similar than the cutoff are all there, and with -inf all that reach ``floor`` are. Holds ``STRIP_CELLS`` products at a time.
    ``floor`` is one number, or one for every row.

    Products are taken in single precision first (``single`` is :func:`_single` of ``cols``, if known); all that may be among
    the best by its error bound are then computed in double precision. The columns ``closed`` are left out.
    """
    step, width = max(1, STRIP_CELLS // max(1, len(cols))), len(cols) // (4 * (k + 1))
    (r_mat, r_top), (c_mat, c_top) = _single(rows), single or _single(cols)
    error = (rows.shape[1] + 4) * 2.0 ** -23 * r_top * c_top + 1e-30  # of a product in single precision
    rough = error < 1e-3
    floor = np.broadcast_to(np.asarray(floor, float), (len(rows),))
    cut, parts = np.full(len(rows), -np.inf), []

    def likely(at: int, rough: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sims = r_mat[at:at + step] @ c_mat.T if rough else rows[at:at + step] @ cols.T
        if closed is not None:
            sims[:, closed] = -np.inf
        slack = error if rough else 0.0
        need = floor[at:at + step] - 10.0 ** -DIGITS - slack
        if width:  # k + 1 slices of the row have a value of at least this
            peaks = sims[:, :4 * (k + 1) * width].reshape(len(sims), -1, width).max(axis=2)
            need = np.maximum(need, np.partition(peaks, -k - 1, axis=1)[:, -k - 1] - 2 * slack)
        if rough:
            need = np.nextafter(need.astype(np.float32), np.float32(-np.inf))
        i, j = np.divmod(np.flatnonzero(sims >= need[:, None]), len(cols))
        if not rough:
            return i, j, np.round(sims[i, j], DIGITS)
        if 16 * len(i) > sims.size and sims.size > STRIP_CELLS // 16:  # of very many ties the whole product is cheaper
            return likely(at, False)
        return i, j, _exact(rows[at:at + step], cols, i, j)

    for at in range(0, len(rows), step):
        i, j, s = likely(at, rough)
        enough = s >= floor[at + i]
        i, j, s = i[enough], j[enough], s[enough]
        by = np.lexsort((-s, i))
        i, j, s = i[by], j[by], s[by]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        cut[at + i[place == k]] = s[place == k]
        parts.append((at + i[place < k], j[place < k], s[place < k]))
    return tuple(np.concatenate(p) for p in zip(*parts)), cut


def greedy_pairs(old: np.ndarray, new: np.ndarray, floor: float):
    """(old positions, new positions, similarities) of the one-to-one matching of two matrices held in one task.

    The best free pair is always the best pair of some old row, so a heap of one pair per group of equal old rows gives
    the walk. A group knows its ``NEAREST`` best columns; once they are taken it waits until the walk comes down to its
    cutoff and gets its best free columns then, together with the next that wait. No matrix of all pairs is held.
    """
    nothing = np.array([], int), np.array([], int), np.array([])
    if not len(old) or not len(new):
        return nothing
    o_first, o_rows, o_from = _equal_rows(old)
    n_first, n_rows, n_from = _equal_rows(new)
    o_mat, n_mat = old[o_first], new[n_first]
    o_rows, o_at, o_end = o_rows.tolist(), o_from[:-1].tolist(), o_from[1:].tolist()
    n_rows, n_at, n_end = n_rows.tolist(), n_from[:-1].tolist(), n_from[1:].tolist()
    partners: list = [()] * len(o_mat)
    values: list = [()] * len(o_mat)
    place, cutoff = [0] * len(o_mat), [-np.inf] * len(o_mat)
    heap: list[tuple] = []
    waiting: list[tuple] = []

    def put(g: int) -> None:
        mine, sims, p = partners[g], values[g], place[g]
        while p < len(mine) and n_at[mine[p]] == n_end[mine[p]]:
            p += 1
        place[g] = p
        if p < len(mine) and sims[p] > cutoff[g]:
            s, best = float(sims[p]), int(mine[p])
            head = n_rows[n_at[best]]
            p += 1
            while p < len(mine) and sims[p] == s:  # of equally similar groups the one with the first free row
                if n_at[mine[p]] < n_end[mine[p]] and n_rows[n_at[mine[p]]] < head:
                    best, head = int(mine[p]), n_rows[n_at[mine[p]]]
                p += 1
            heapq.heappush(heap, (-s, o_rows[o_at[g]], head, g, best))
        elif cutoff[g] > -np.inf:
            heapq.heappush(waiting, (-cutoff[g], g))

    free = np.ones(len(n_mat), bool)
    held, h_mat, h_single = np.arange(len(n_mat)), n_mat, _single(n_mat)  # columns looked at; those taken leave now and then

    def look(groups: np.ndarray) -> None:
        nonlocal held, h_mat, h_single
        closed = np.flatnonzero(~free[held])
        if 8 * len(closed) > len(held):
            held, closed = held[free[held]], closed[:0]
            h_mat, h_single = n_mat[held], _single(n_mat[held])
        # a row of many ties at its cutoff knows none above it: it looks further each time
        k = NEAREST * max(1, *(2 * len(partners[g]) // NEAREST if not place[g] else 1 for g in groups.tolist()))
        (i, j, s), cut = best_columns(o_mat[groups], h_mat, floor, k, closed, h_single)
        ends = np.searchsorted(i, np.arange(len(groups) + 1))
        j = held[j]
        for g, a, b, c in zip(groups.tolist(), ends[:-1].tolist(), ends[1:].tolist(), cut.tolist()):
            partners[g], values[g], place[g], cutoff[g] = j[a:b], s[a:b], 0, c
            put(g)

    look(np.arange(len(o_mat)))
    out = []
    while heap or waiting:
        if waiting and (not heap or waiting[0][0] <= heap[0][0]):
            look(np.array([heapq.heappop(waiting)[1] for _ in range(min(TOGETHER, len(waiting)))]))
            continue
        s, i, j, g, h = heapq.heappop(heap)
        if n_at[h] < n_end[h] and n_rows[n_at[h]] == j:
            out.append((i, j, -s))
            o_at[g] += 1
            n_at[h] += 1
            free[h] = n_at[h] < n_end[h]
        if o_at[g] < o_end[g]:
            put(g)
    if not out:
        return nothing
    i, j, s = zip(*out)
    return np.array(i), np.array(j), np.array(s)


def _alignment_schema(keys: list[str], source: DataFrame, with_texts: bool, with_chars: bool = False) -> T.StructType:
    fields = [T.StructField("kind", T.StringType()), T.StructField("old_idx", T.LongType()),
              T.StructField("new_idx", T.LongType()), T.StructField("similarity", T.DoubleType())]
    if with_texts:
        fields += [T.StructField("old_text", T.StringType()), T.StructField("new_text", T.StringType())]
    if with_chars:
        fields += [T.StructField("old_chars", T.IntegerType()), T.StructField("new_chars", T.IntegerType())]
    return T.StructType([source.schema[k] for k in keys] + fields)


def stack_sides(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two frames of paragraphs as one with a ``side`` column."""
    return old.withColumn("side", F.lit("old")).unionByName(new.withColumn("side", F.lit("new")))


def align_bounded(sides: DataFrame, floor: float = dims.SIMILARITY_FLOOR, keys: list[str] = PAIR,
                  model_key: str | None = None, texts_out: bool = True, chars_out: bool = False,
                  alike: float | None = None) -> DataFrame:
    """:func:`align_sides` for callers that know every section pair fits one task; stays lazy.

    Both versions of a section arrive in one group, so the paragraphs are shuffled once and leave with
    their texts attached, as far as wanted. Texts stay in Arrow columns throughout.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    with_texts = "text" in sides.columns and texts_out
    with_chars = "text" in sides.columns and chars_out
    schema = _alignment_schema(keys, sides, with_texts, with_chars)
    names = [f.name for f in schema.fields]
    factory = embedder_factory(model_key) if model_key else None
    prefix = "passage: " if model_key and model_key.startswith("e5") else ""
    cache: dict = {}

    def vectors(column) -> np.ndarray:
        if len(column) == 0:
            return np.zeros((0, 1))
        if factory is None:
            if len(set(pc.list_value_length(column).to_pylist())) > 1:
                raise ValueError("the vectors of a section differ in length")
            return as_matrix(column)
        if "model" not in cache:
            cache["model"] = factory()
        return text_vectors(cache["model"], column, prefix)

    def one(column):
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)

    def run(key, table):
        idx, is_old = table["idx"].to_numpy(), pc.equal(table["side"], "old").to_numpy()
        order = {s: at[np.argsort(idx[at], kind="stable")] for s, at in (
            ("old", np.flatnonzero(is_old)), ("new", np.flatnonzero(~is_old)))}
        held = {c: one(table[c].cast(pa.large_string()) if c == "text" else table[c]) for c in payload}
        table = None
        source = held["vector" if factory is None else "text"]
        i, j, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        if len(order["old"]) and len(order["new"]):
            both = vectors(source.take(pa.array(np.concatenate([order["old"], order["new"]]))))
            i, j, s = greedy_pairs(both[:len(order["old"])], both[len(order["old"]):], floor)
            both = None
        o_free, n_free = np.delete(np.arange(len(order["old"])), i), np.delete(np.arange(len(order["new"])), j)
        none_o, none_n = np.full(len(n_free), -1), np.full(len(o_free), -1)
        # places in the group; the last one, of no row, stands for the absent side
        at = {"old": np.append(order["old"], len(idx))[np.concatenate([i, none_o, o_free]).astype(int)],
              "new": np.append(order["new"], len(idx))[np.concatenate([j, n_free, none_n]).astype(int)]}
        idx = np.append(idx.astype("int64"), -1)
        kinds = pa.array(["matched", "added", "removed"]).take(
            pa.array(np.repeat(np.arange(3), [len(i), len(n_free), len(o_free)])))
        similarity = np.concatenate([s, np.zeros(len(n_free) + len(o_free))])
        if with_texts or with_chars:
            held["text"] = pa.concat_arrays([held["text"], pa.array([""], pa.large_string())])
        if with_chars:
            chars = pc.utf8_length(held["text"]).cast(pa.int32())
        if with_texts and alike is not None:  # the other pairs point to the row without text
            sent = np.zeros(len(similarity), bool)
            near = np.flatnonzero(s >= alike)
            sent[near] = pc.not_equal(*[held["text"].take(pa.array(rows[near])) for rows in at.values()]).fill_null(
                False).to_numpy(zero_copy_only=False)
            shown = {side: np.where(sent, rows, len(held["text"]) - 1) for side, rows in at.items()}
        else:
            shown = at
        parts = []
        for a in range(0, len(similarity), SENT):
            some = slice(a, a + SENT)
            cols = {"kind": kinds[some], "similarity": pa.array(similarity[some])}
            for side, rows in at.items():
                cols[f"{side}_idx"] = pa.array(idx[rows[some]])
                if with_texts:
                    cols[f"{side}_text"] = held["text"].take(pa.array(shown[side][some])).cast(pa.string())
                if with_chars:
                    cols[f"{side}_chars"] = chars.take(pa.array(rows[some]))
            for name, value in zip(keys, key):
                cols[name] = pa.repeat(value, len(cols["kind"]))
            parts.append(pa.table([cols[c] for c in names], names))
        return pa.concat_tables(parts)

    payload = [c for c in ("text", "vector") if c in sides.columns and (c == "text" or factory is None)]
    # the work is in the numbers, not in the bytes, and grows with the square of a section: instead of letting partitions
    # coalesce, there are several for each configured one, so that large sections seldom wait for each other
    width = SPREAD * int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (sides.select(*keys, "side", "idx", *payload).repartition(width, *keys)
            .groupBy(*keys).applyInArrow(run, schema))


def pair_sizes(sides: DataFrame, keys: list[str]) -> DataFrame:
    return sides.groupBy(*keys).agg(F.count_if(F.col("side") == "old").alias("n_old"),
                                    F.count_if(F.col("side") == "new").alias("n_new"))


def is_large(max_cells: int = MAX_CELLS, max_side: int = MAX_SIDE) -> Column:
    return ((F.col("n_old") * F.col("n_new") > max_cells) | (F.col("n_old") > max_side)
            | (F.col("n_new") > max_side))


def align_sides(sides: DataFrame, floor: float = dims.SIMILARITY_FLOOR, keys: list[str] = PAIR,
                model_key: str | None = None, large: DataFrame | None = None, tile: int = HELD,
                texts_out: bool = True, chars_out: bool = False, alike: float | None = None) -> DataFrame:
    """Alignment rows (keys, kind, old_idx, new_idx, similarity); kind is matched, added or removed.

    ``sides`` is (keys, side, idx, vector) or, with a ``model_key``, (keys, side, idx, text); texts, where
    present, come along as old_text / new_text unless ``texts_out`` is off. With ``alike``, only matched pairs of at least
    that similarity whose texts differ bring their texts; the others have empty ones. ``chars_out`` adds the lengths of
    both texts (old_chars, new_chars; 0 for the absent side). ``large`` lists the keys too big for one task, or is None
    when there are none.
    """
    if large is None:
        return align_bounded(sides, floor, keys, model_key, texts_out, chars_out, alike)
    small, big = sides.join(large, keys, "left_anti"), sides.join(large, keys, "left_semi")
    has_texts = "text" in sides.columns
    own = ([F.col("text")] if has_texts and texts_out else []) + (
        [F.length("text").alias("chars")] if has_texts and chars_out else [])
    texts = big.select(*keys, "side", "idx", *own) if own else None
    if model_key:
        big = embed(big, "text", model_key)
    big = big.select(*keys, "side", "idx", "vector")
    matched = _match_large(big.filter("side = 'old'").drop("side"), big.filter("side = 'new'").drop("side"),
                           keys, floor, tile)
    if texts is not None:
        for side in ("old", "new"):
            matched = matched.join(texts.filter(F.col("side") == side).select(
                *keys, F.col("idx").alias(f"{side}_idx"), *[F.col(c).alias(f"{side}_{c}") for c in texts.columns[len(keys) + 2:]]),
                [*keys, f"{side}_idx"], "left")
        if texts_out:
            matched = matched.na.fill("", ["old_text", "new_text"])
        if texts_out and alike is not None:
            sent = (F.col("kind") == "matched") & (F.col("similarity") >= alike) & (F.col("old_text") != F.col("new_text"))
            matched = matched.select(*[F.when(sent, F.col(c)).otherwise("").alias(c) if c in ("old_text", "new_text") else c
                                       for c in matched.columns])
        if chars_out:
            matched = matched.na.fill(0, ["old_chars", "new_chars"])
    return align_bounded(small, floor, keys, model_key, texts_out, chars_out, alike).unionByName(matched)


def large_sections(sizes: DataFrame, keys: list[str] = PAIR, max_cells: int = MAX_CELLS,
                   max_side: int = MAX_SIDE) -> DataFrame | None:
    """Keys of section pairs beyond the per-task bound, or None when the check finds none."""
    large = sizes.filter(is_large(max_cells, max_side)).select(*keys)
    if large.isEmpty():
        return None
    return cut_lineage(large)  # one short row per oversized section


def align(old: DataFrame, new: DataFrame, floor: float = dims.SIMILARITY_FLOOR, keys: list[str] = PAIR,
          model_key: str | None = None, max_cells: int = MAX_CELLS, max_side: int = MAX_SIDE,
          tile: int = HELD) -> DataFrame:
    """:func:`align_sides` for two separate frames, sized by a counting pass."""
    columns = [*keys, "idx"] + [c for c in ("text", "vector") if c in old.columns]
    sides = stack_sides(old.select(*columns), new.select(*columns))
    return align_sides(sides, floor, keys, model_key,
                       large_sections(pair_sizes(sides, keys), keys, max_cells, max_side), tile)


# ---- sections too large for one task ------------------------------------------------------------------

def _copies(side: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gid, idx, copy, vector): equal vectors share gid and are numbered in section order.

    Only exact equality counts: vectors that differ at all may tie with one another, and then positions decide.
    """
    gid = F.md5(F.array_join(F.transform("vector", lambda x: (x.cast("double") + 0.0).cast("string")), ","))
    return rank_within(side.select(*keys, "idx", "vector", gid.alias("gid")), [*keys, "gid"], [F.col("idx")], "copy",
                       levels=[F.floor(F.col("idx") / BLOCK)])


def _groups(copies: DataFrame, keys: list[str]) -> DataFrame:
    return copies.groupBy(*keys, "gid").agg(F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))


def _tiles(groups: DataFrame, keys: list[str], side: str, tile: int) -> DataFrame:
    """Groups packed into rows of about ``tile`` vectors, alike in 1-norm, with the norms that bound them."""
    norm1 = F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.abs(x))
    peak = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    g = groups.withColumns({"_l1": norm1, "_top": peak}).withColumn(
        "_class", F.floor(F.log2(F.greatest("_l1", F.lit(1e-9))) * 4))
    per_class = g.groupBy(*keys, "_class").agg(F.ceil(F.count(F.lit(1)) / tile).alias("_tiles"))
    placed = g.join(per_class.hint("merge"), [*keys, "_class"]).withColumn("_slot", F.pmod(F.xxhash64("gid"), F.col("_tiles")))
    return placed.groupBy(*keys, "_class", "_slot").agg(
        F.collect_list("gid").alias(f"{side}_gid"), F.collect_list("head").alias(f"{side}_head"),
        F.collect_list("vector").alias(f"{side}_vec"), F.max("_l1").alias(f"{side}_l1"),
        F.max("_top").alias(f"{side}_top")).withColumn(
        f"{side}_tile", F.concat_ws("/", "_class", "_slot")).drop("_class", "_slot")


def _tile_meetings(old: DataFrame, new: DataFrame, keys: list[str], floor: float, tile: int) -> DataFrame:
    """Pairs of tiles that can hold a similarity of at least ``floor`` (|a.b| <= |a|_1 max|b|), with payload."""
    o, n = _tiles(old, keys, "old", tile), _tiles(new, keys, "new", tile)
    bound = F.least(F.col("old_l1") * F.col("new_top"), F.col("new_l1") * F.col("old_top"))
    ids = (o.select(*keys, "old_tile", "old_l1", "old_top")
           .join(n.select(*keys, "new_tile", "new_l1", "new_top").hint("merge"), keys)
           .filter(bound >= floor - 1e-6).select(*keys, "old_tile", "new_tile"))
    return (ids.join(o.drop("old_l1", "old_top").hint("merge"), [*keys, "old_tile"])
            .join(n.drop("new_l1", "new_top").hint("merge"), [*keys, "new_tile"]))


def _run_tiles(meetings: DataFrame, keys: list[str], kernel, schema: T.StructType) -> DataFrame:
    """Apply ``kernel(old ids, old heads, old matrix, new ids, new heads, new matrix) -> columns`` per meeting."""
    import pyarrow as pa

    names = [f.name for f in schema.fields]
    sides = ["old_gid", "old_head", "old_vec", "new_gid", "new_head", "new_vec"]

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {c: batch.column(c).slice(r, 1).flatten() for c in sides}
                cols = kernel(*[as_matrix(cell[c]) if c.endswith("_vec") else cell[c].to_numpy(zero_copy_only=False)
                                for c in sides])
                size = len(next(iter(cols.values())))
                if size == 0:
                    continue
                same_key = pa.array([r] * size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(same_key) if c in keys else pa.array(cols[c]) for c in names], names)

    return meetings.select(*keys, *sides).mapInArrow(run, schema)


class _Held:
    """Groups held by a task and the ``LISTED`` + 1 best partners that each has met so far: similarity down, position up."""

    def __init__(self, ids, vectors: np.ndarray, floor: float):
        n, width = len(ids), LISTED + 1
        self.ids, self.vectors, self.least = ids, vectors, floor
        self.floors = np.full(n, floor, float)  # what a partner must reach to be listed
        self.sims, self.heads = np.full((n, width), -np.inf), np.zeros((n, width), np.int64)
        self.partners = np.zeros((n, width), "S32")

    def meet(self, ids: np.ndarray, heads: np.ndarray, vectors: np.ndarray) -> None:
        width, by = self.sims.shape[1], np.argsort(heads, kind="stable")
        ids, heads = ids[by], heads[by]
        (i, j, s), _ = best_columns(self.vectors, vectors[by], self.floors, width)
        rows = np.unique(i)
        i = np.concatenate([np.repeat(rows, width), i])
        s = np.concatenate([self.sims[rows].ravel(), s])
        h = np.concatenate([self.heads[rows].ravel(), heads[j]])
        p = np.concatenate([self.partners[rows].ravel(), ids[j]])
        by = np.lexsort((h, -s, i))
        place = np.arange(len(i)) - np.searchsorted(i[by], i[by])
        by, place = by[place < width], place[place < width]
        self.sims[i[by], place], self.heads[i[by], place], self.partners[i[by], place] = s[by], h[by], p[by]
        self.floors[rows] = np.maximum(self.least, self.sims[rows, -1])

    def lists(self, some: slice) -> dict:
        """Columns of the lists of some of the groups."""
        i, place = np.nonzero(self.sims[some, :LISTED] > -np.inf)
        i += some.start
        last = self.sims[i, LISTED]
        return {"gid": self.ids[i], "partner": self.partners[i, place].astype("U32"), "partner_head": self.heads[i, place],
                "similarity": self.sims[i, place], "cutoff": np.ma.array(last, mask=last == -np.inf)}


def _block_lists(rows: DataFrame, partners: DataFrame, keys: list[str], side: str, floor: float, held: int) -> DataFrame:
    """(keys, side, gid, partner, partner_head, similarity, cutoff): best partners of every row, complete above the cutoff.

    A section's rows are dealt into blocks of ``held``. A task holds a block and the partners of its section stream past it,
    so what is shuffled grows with the number of blocks, not of pairs, and lists leave a task finished.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    blocks = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / held).cast("int").alias("_blocks")).hint("merge")
    own = rows.join(blocks, keys).withColumns({"_part": F.lit(0), "_block": F.pmod(F.xxhash64("gid"), "_blocks").cast("int")})
    met = partners.join(blocks, keys).withColumns({
        "_part": F.lit(1), "_block": F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))})
    place = [*keys, "_block"]
    columns = [*place, "_part", "gid", "head", "vector"]
    width = SPREAD * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (own.select(*columns).unionByName(met.select(*columns))
             .repartition(width, *place).sortWithinPartitions(*place, "_part"))
    schema = T.StructType([rows.schema[k] for k in keys] + [
        T.StructField("side", T.StringType()), T.StructField("gid", T.StringType()), T.StructField("partner", T.StringType()),
        T.StructField("partner_head", T.LongType()), T.StructField("similarity", T.DoubleType()),
        T.StructField("cutoff", T.DoubleType())])
    names, types = [f.name for f in schema.fields], {}

    def run(batches):
        at, waiting, block = None, [], None  # the block a task is at, its groups as they come, and held once they are all there

        def finished():
            for a in range(0, len(block.ids) if block is not None else 0, SENT):
                cols = block.lists(slice(a, a + SENT))
                n = len(cols["gid"])
                if n:
                    cols |= {"side": pa.repeat(side, n)} | {k: pa.repeat(pa.scalar(v, types[k]), n) for k, v in zip(keys, at)}
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in map(cols.get, names)],
                                                     names)

        for batch in batches:
            if not batch.num_rows:
                continue
            types.update({k: batch.schema.field(k).type for k in keys})
            new = np.zeros(batch.num_rows - 1, bool)
            for c in [*place, "_part"]:
                new |= pc.not_equal(batch[c][1:], batch[c][:-1]).to_numpy(zero_copy_only=False)
            ends = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(ends[:-1], ends[1:]):
                here = tuple(batch[c][a].as_py() for c in place)
                if here != at:
                    yield from finished()
                    at, waiting, block = here, [], None
                ids = batch["gid"][a:b].to_numpy(zero_copy_only=False).astype("S32")
                vectors = as_matrix(batch["vector"][a:b])
                if batch["_part"][a].as_py() == 0:
                    waiting.append((ids, vectors))
                    continue
                if block is None:
                    block = _Held(np.concatenate([w[0] for w in waiting]).astype("U32"), np.concatenate([w[1] for w in waiting]),
                                  floor)
                    waiting = []
                block.meet(ids, batch["head"][a:b].to_numpy(), vectors)
        yield from finished()

    return dealt.mapInArrow(run, schema)


def cut(df: DataFrame) -> DataFrame:
    """:func:`cut_lineage` for the tables of the rounds, which meet by sorting: what is broadcast in every round passes
    through the driver and adds up."""
    table = cut_lineage(df)
    out = table.hint("merge")
    out.redline_path = table.redline_path
    return out


def _match_large(old: DataFrame, new: DataFrame, keys: list[str], floor: float, held: int = HELD,
                 log: list | None = None) -> DataFrame:
    """Matching by rounds; ``log`` receives the number of groups whose lists each round computed."""
    copies = {"old": cut(_copies(old, keys)), "new": cut(_copies(new, keys))}
    state = {s: cut(_groups(c, keys).withColumns({"n": F.col("n").cast("long"), "used": F.lit(0).cast("long")}))
             for s, c in copies.items()}
    owner = [*keys, "side", "gid"]

    def lists(rows: dict[str, DataFrame], partners: dict[str, DataFrame]) -> DataFrame:
        """Lists of the rows of both sides among the free groups of the other side; one is complete above its cutoff."""
        parts = [_block_lists(rows[s], partners["new" if s == "old" else "old"], keys, s, floor, held) for s in ("old", "new")]
        return parts[0].unionByName(parts[1])

    def other(side: Column) -> Column:
        return F.when(side == "old", "new").otherwise("old")

    known, runs, done = None, [], []  # known: the lists kept; done: tables no longer needed
    while True:
        headed = {s: cut(state[s].join(
            copies[s].select(*keys, "gid", F.col("copy").alias("used"), F.col("idx").alias("head")), [*keys, "gid", "used"]))
            for s in state}
        free = headed["old"].select(*keys, F.lit("old").alias("side"), "gid", "head").unionByName(
            headed["new"].select(*keys, F.lit("new").alias("side"), "gid", "head"))
        if known is None:
            current = cut(lists(headed, headed))
            if log is not None:
                log.append(free.count())
        else:
            partner = free.select(*keys, other(F.col("side")).alias("side"), F.col("gid").alias("partner"),
                                  F.col("head").alias("partner_head"))
            kept = cut(known.join(free.select(*owner), owner).join(
                partner.hint("merge"), [*keys, "side", "partner"], "left"))
            usable = kept.filter(F.col("partner_head").isNotNull()
                                 & (F.col("cutoff").isNull() | (F.col("similarity") > F.col("cutoff"))))
            stale = cut(kept.filter("cutoff is not null").select(*owner).distinct()
                                .join(usable.select(*owner), owner, "left_anti"))
            done += [known, kept, stale]
            if log is not None:
                log.append(stale.count())
            again = lists({s: headed[s].join(stale.filter(F.col("side") == s).drop("side"), [*keys, "gid"], "left_semi")
                           for s in headed}, headed)
            columns = [*owner, "partner", "partner_head", "similarity", "cutoff"]
            current = cut(usable.select(*columns).unionByName(again.select(*columns)))
        ranked = top_per_key(current, owner, [F.col("similarity").desc(), F.col("partner_head")], 2)
        top = cut(ranked)
        first = top.filter("rank = 1")
        tie = top.filter("rank = 2").select(*owner, F.col("similarity").alias("tie_sim"),
                                            F.col("partner_head").alias("tie_head"))
        first = first.join(tie, owner, "left").withColumn(
            "tie_head", F.when(F.col("tie_sim") == F.col("similarity"), F.col("tie_head")))
        o = first.filter("side = 'old'").select(*keys, F.col("gid").alias("old_gid"), F.col("partner").alias("new_gid"),
                                                "similarity", F.col("tie_head").alias("new_stop"))
        n = first.filter("side = 'new'").select(*keys, F.col("gid").alias("new_gid"), F.col("partner").alias("old_gid"),
                                                F.col("tie_head").alias("old_stop"))
        mutual = (o.join(n.hint("merge"), [*keys, "old_gid", "new_gid"])
                  .join(state["old"].select(*keys, F.col("gid").alias("old_gid"), F.col("n").alias("n_old"),
                                            F.col("used").alias("old_from")), [*keys, "old_gid"])
                  .join(state["new"].select(*keys, F.col("gid").alias("new_gid"), F.col("n").alias("n_new"),
                                            F.col("used").alias("new_from")), [*keys, "new_gid"]))
        # with an equally similar rival, only the copies in front of the rival's first copy are certain
        for side in ("old", "new"):
            ahead = (mutual.filter(F.col(f"{side}_stop").isNotNull())
                     .select(*keys, F.col(f"{side}_gid").alias("gid"), F.col(f"{side}_stop").alias("_stop"))
                     .join(copies[side], [*keys, "gid"]).filter(F.col("idx") < F.col("_stop"))
                     .groupBy(*keys, F.col("gid").alias(f"{side}_gid")).agg(F.count(F.lit(1)).alias(f"{side}_ahead")))
            mutual = mutual.join(ahead.hint("merge"), [*keys, f"{side}_gid"], "left").withColumn(
                f"{side}_room", F.when(F.col(f"{side}_stop").isNull(), F.col(f"n_{side}") - F.col(f"{side}_from"))
                .otherwise(F.col(f"{side}_ahead") - F.col(f"{side}_from")))
        taken = cut(mutual.select(*keys, "old_gid", "new_gid", "similarity", "old_from", "new_from",
                                          F.least("old_room", "new_room").cast("long").alias("k")))
        runs.append(taken)
        done += [*headed.values(), top]
        if taken.isEmpty():
            discard(*done, *state.values(), current)
            break
        before = state
        state = {s: cut(
            state[s].join(taken.select(*keys, F.col(f"{s}_gid").alias("gid"), "k"), [*keys, "gid"], "left")
            .withColumn("used", F.col("used") + F.coalesce("k", F.lit(0))).drop("k")
            .filter(F.col("used") < F.col("n"))) for s in state}
        discard(*done, *before.values())
        known, done = current.select(*owner, "partner", "similarity", "cutoff"), []
        known.redline_path = current.redline_path

    all_runs = runs[0]
    for r in runs[1:]:
        all_runs = all_runs.unionByName(r)
    # runs of copies back to rows, block by block so that a huge run is spread evenly
    spread = all_runs.withColumn("_blk", F.explode(F.sequence(
        F.floor(F.col("old_from") / BLOCK), F.floor((F.col("old_from") + F.col("k") - 1) / BLOCK))))
    oc = copies["old"].select(*keys, F.col("gid").alias("old_gid"), F.col("copy").alias("old_copy"),
                              F.col("idx").alias("old_idx"), F.floor(F.col("copy") / BLOCK).alias("_blk"))
    nc = copies["new"].select(*keys, F.col("gid").alias("new_gid"), F.col("copy").alias("new_copy"),
                              F.col("idx").alias("new_idx"))
    matched = (spread.join(oc, [*keys, "old_gid", "_blk"])
               .filter((F.col("old_copy") >= F.col("old_from")) & (F.col("old_copy") < F.col("old_from") + F.col("k")))
               .withColumn("new_copy", F.col("new_from") + F.col("old_copy") - F.col("old_from"))
               .join(nc, [*keys, "new_gid", "new_copy"])
               .select(*keys, F.lit("matched").alias("kind"), "old_idx", "new_idx", "similarity"))
    return with_unmatched(matched, copies["old"], copies["new"], keys)


def with_unmatched(matched: DataFrame, old: DataFrame, new: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """Matched rows plus the free rows of either side as added / removed."""
    added = new.select(*keys, F.col("idx").alias("new_idx")).join(
        matched.select(*keys, "new_idx"), [*keys, "new_idx"], "left_anti").select(
        *keys, F.lit("added").alias("kind"), F.lit(-1).cast("long").alias("old_idx"),
        F.col("new_idx").cast("long").alias("new_idx"), F.lit(0.0).alias("similarity"))
    removed = old.select(*keys, F.col("idx").alias("old_idx")).join(
        matched.select(*keys, "old_idx"), [*keys, "old_idx"], "left_anti").select(
        *keys, F.lit("removed").alias("kind"), F.col("old_idx").cast("long").alias("old_idx"),
        F.lit(-1).cast("long").alias("new_idx"), F.lit(0.0).alias("similarity"))
    return matched.unionByName(added).unionByName(removed)


def candidate_pairs(old: DataFrame, new: DataFrame, floor: float = dims.SIMILARITY_FLOOR, keys: list[str] = PAIR,
                    tile: int = TILE) -> DataFrame:
    """All (old_idx, new_idx) of a section pair with similarity >= ``floor``: the result itself, nothing more.

    Tiles that cannot reach the floor are skipped; the others are multiplied in place and emit only hits.
    """
    def side(df):
        return df.select(*keys, F.col("idx").cast("string").alias("gid"), F.col("idx").cast("long").alias("head"), "vector")

    schema = T.StructType([old.schema[k] for k in keys] + [
        T.StructField("old_idx", T.LongType()), T.StructField("new_idx", T.LongType()),
        T.StructField("similarity", T.DoubleType())])

    def kernel(_og, oh, ov, _ng, nh, nv):
        sims = np.round(ov @ nv.T, DIGITS)
        i, j = np.nonzero(sims >= floor)
        return {"old_idx": oh[i], "new_idx": nh[j], "similarity": sims[i, j]}

    return _run_tiles(_tile_meetings(side(old), side(new), keys, floor, tile), keys, kernel, schema)
