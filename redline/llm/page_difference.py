"""Main text of web pages by differencing each page against the page of nearest URL on its host.

1. Every page is scanned once into its blocks of text (``page_lines``). Menus, headers, footers, sidebars, notices, adverts,
   forms and comments that the markup names are set apart.
2. Pages are put in one order of host, path and id, by ranges; the two pages on either side of a page are its candidates,
   the longest common beginning of the path first, then the nearer place, then the one before. Pages without lines are none.
3. Blocks of neighbouring pages go to tasks as hashes of their lines. A page is aligned with its nearest candidate by a
   longest common subsequence of all lines, boilerplate included. If more than half of the shorter page's text is shared,
   the two are copies of one article, which tells nothing, and the next candidate is taken; four copies leave the page as it is.
4. Lines that only the page itself has are its main text, and shared lines go. Then the markup is asked: where an article or
   main element holds at least half of the text that the difference left, the main text is what this element holds, and a
   line in it that a neighbour has too (a licence, a quotation) comes back. An element that holds less is no article.

A hot host is cut into blocks of ``BLOCK`` pages like any other. Blocks hold hashes, not texts: a page is read again when
its verdict has come, so texts are shuffled once and stored nowhere.

Null and empty pages have no lines and an empty text. Null urls and urls without "://" have the empty host and path. Rows of
equal id, url and html are one page in the order and share a verdict; other rows are pages of their own, also with a repeated
or null id. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.llm.common import column, map_batches, table
from redline.llm.page_lines import scan
from redline.operators.edit_script import common_parts
from redline.operators.ranking import ordered_positions
from redline.session import spread

BLOCK = 64
REACH = 2
COPY = 0.5
ARTICLE_SHARE = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a url; both empty without "://"."""
    return (F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))),
            F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit("")))


def open_lines(page: str | None) -> tuple[list[str], list[bool], list[int], list[int]]:
    """(lines that may be article text, which of them an article element holds, their places, hashes of all lines)."""
    blocks = scan(page) if page else []
    places = [i for i, (_, muted, _) in enumerate(blocks) if not muted]
    hashes = [xxhash.xxh64_intdigest(t.encode()) >> 1 for t, _, _ in blocks]
    return [blocks[i][0] for i in places], [blocks[i][2] for i in places], places, hashes


def main_lines(sizes: np.ndarray, own: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Which of the lines that may be article text are: those not shared, or those of the element that holds most of these."""
    left = int(sizes[~shared].sum())
    held = int(sizes[own & ~shared].sum())
    return own if held and held >= ARTICLE_SHARE * left else ~shared


def read_lines(page: str | None, keep: list[bool] | None = None) -> tuple[list[str], list[bool]]:
    """The main lines of a page, and which of its :func:`open_lines` they are; without a verdict, as if nothing is shared."""
    lines, own, _, _ = open_lines(page)
    if keep is None:
        keep = main_lines(np.array([len(x) for x in lines], int), np.array(own, bool), np.zeros(len(lines), bool)).tolist()
    return [x for x, k in zip(lines, keep, strict=True) if k], keep


def line_hashes(pages: DataFrame) -> DataFrame:
    """_key, _own, _places, _sizes, _all of every page: what the alignment needs, without texts."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        read = [open_lines(p) for p in column(b, "_html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [column(b, "_key"), pa.array([r[1] for r in read], pa.list_(pa.bool_())),
             pa.array([r[2] for r in read], pa.list_(pa.int32())),
             pa.array([[len(x) for x in r[0]] for r in read], pa.list_(pa.int32())),
             pa.array([r[3] for r in read], pa.list_(pa.int64()))], ["_key", "_own", "_places", "_sizes", "_all"])
    return map_batches(pages.select("_key", "_html"), run, "_key binary, _own array<boolean>, _places array<int>, "
                                                           "_sizes array<int>, _all array<bigint>")


def kept_lines(judged: DataFrame) -> DataFrame:
    """_id, _url, lines, n_shared from pages with their verdicts; reads the pages again rather than storing their texts."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [read_lines(page, keep)[0] for page, keep in zip(column(b, "_html").to_pylist(),
                                                               column(b, "_keep").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([column(b, "_id"), column(b, "_url"), pa.array(out, pa.list_(pa.string())),
                                           column(b, "_shared")], ["_id", "_url", "lines", "n_shared"])
    return map_batches(judged.select("_id", "_url", "_html", "_keep", "_shared"), run,
                       f"_id {dict(judged.dtypes)['_id']}, _url string, lines array<string>, n_shared int")


def common_beginning(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def shared_part(page: dict, mask: np.ndarray) -> float:
    """Share of a page's possible article text that lies in the marked lines."""
    total = int(np.sum(page["_sizes"]))
    return float(np.sum(page["_sizes"][mask[np.asarray(page["_places"], int)]])) / total if total else 0.0


def difference_block(pages: pd.DataFrame, block: int) -> pd.DataFrame:
    """(_key, _shared, _keep) of the block's own pages; ``pages`` also has their neighbours in other blocks."""
    held = pages.sort_values("position").to_dict("records")
    masks: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    rows = []
    for i, me in enumerate(held):
        if me["position"] // BLOCK != block:
            continue
        near = sorted((-common_beginning(me["_path"], held[j]["_path"]), abs(i - j), j)
                      for j in range(max(0, i - REACH), min(len(held), i + REACH + 1))
                      if j != i and held[j]["_host"] == me["_host"] and len(held[j]["_all"]))
        shared = np.zeros(len(me["_all"]), bool)
        for _, _, j in near:
            pair = min(i, j), max(i, j)
            if pair not in masks:
                masks[pair] = common_parts(np.asarray(held[pair[0]]["_all"]), np.asarray(held[pair[1]]["_all"]))
            mine, theirs = masks[pair] if i < j else masks[pair][::-1]
            if max(shared_part(me, mine), shared_part(held[j], theirs)) <= COPY:
                shared = mine
                break
        hit = shared[np.asarray(me["_places"], int)]
        keep = main_lines(np.asarray(me["_sizes"], int), np.asarray(me["_own"], bool), hit) if hit.any() else None
        rows.append((me["_key"], int(hit.sum()), None if keep is None else keep.tolist()))
    return pd.DataFrame(rows, columns=["_key", "_shared", "_keep"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """_id, _url, lines (of the article, in page order), n_shared (candidate lines that the nearest page has too)."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    slim = spread(pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"),
                               host.alias("_host"), path.alias("_path"), F.col(html_col).alias("_html")))
    parts = [x for c in ("_id", "_url", "_html") for x in (F.col(c).isNull().cast("string"), F.col(c).cast("string"))]
    slim = slim.withColumn("_key", F.unhex(F.md5(F.concat_ws("\x01", *parts))))
    order = ordered_positions(slim.select("_key", "_host", "_path", "_id").distinct(), ["_host", "_path", "_id", "_key"])
    at, block = F.col("position") % BLOCK, F.floor(F.col("position") / BLOCK)
    blocks = F.array_compact(F.array(block, F.when(at < REACH, block - 1), F.when(at >= BLOCK - REACH, block + 1)))

    def difference(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return difference_block(group, int(key[0]))
    verdict = (line_hashes(slim).dropDuplicates(["_key"]).join(order.drop("_id"), "_key")
               .withColumn("_block", F.explode(blocks)).groupBy("_block")
               .applyInPandas(difference, "_key binary, _shared int, _keep array<boolean>"))
    return kept_lines(slim.join(verdict, "_key", "left").withColumn("_shared", F.coalesce("_shared", F.lit(0))))


def op12_page_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = main_text(table(spark, sf_dir, "pages"))
    return (found.withColumn("text", F.array_join("lines", "\n"))
            .select(F.col("_id").alias("page_id"), F.col("_url").alias("url"), "text",
                    F.length("text").cast("long").alias("n_chars"), F.col("n_shared").cast("long").alias("n_shared")))
