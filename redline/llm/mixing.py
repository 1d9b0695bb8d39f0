"""Mixing sources to target weights: temperature, budgets, block permutations.

A source of t tokens gets a weight in proportion to t ** alpha. The exponent is searched by repeated section of [0, 1]
until the weights meet a target: the smallest exponent at which no source is repeated more than ``max_repeats`` times,
and the largest at which the weights' entropy (nats) is at least ``target_entropy``; with both, the repetition limit
prevails. Unless a token budget is given, the budget is the one at which the largest source is read exactly once, so
that no source is cut.

A source whose budget is b tokens passes b // t times in whole; a last pass stops at the first document that reaches the
rest. Every pass runs through the source in blocks: documents fall into blocks of about ``block_docs`` by hash, each pass
orders the blocks anew, and the documents inside each block. A last pass needs running sums over blocks and over the one
block where it stops, never over a source.

Tokens are words ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none and stay in every whole pass. A null source is a
source of its own. A row without doc_id is known by its text's digest, and one without text too by an empty key; where
more of them share a key than a block holds, they fall into blocks one by one. A source without tokens passes once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redline.llm.common import free_name, table
from redline.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_DOCS = 1000
MAX_REPEATS = 2.0
SEED = 17


@dataclass
class Target:
    max_repeats: float | None = MAX_REPEATS
    target_entropy: float | None = None
    token_budget: int | None = None


def _shuffle_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(SEED)), *[p.cast("string") for p in parts]))


def temperature(sources: DataFrame, target: Target, sections: int = 16, rounds: int = 14) -> float:
    """The exponent for a table of sources with column ``tokens``; each round is one aggregate over it."""
    t = F.col("tokens").cast("double")
    known = sources.filter("tokens > 0")
    top, low, n = known.agg(F.max(t), F.min(t), F.count("*")).first()
    if n < 2 or top == low:
        return 1.0

    def search(values, good, from_there_on: bool) -> float:
        """The end of the range of good exponents; ``values`` measures a whole grid at once."""
        lo, hi = 0.0, 1.0
        for _ in range(rounds):
            grid = [lo + (hi - lo) * i / sections for i in range(sections + 1)]
            fine = [good(v) for v in values(grid)]
            if from_there_on:
                first = fine.index(True) if True in fine else sections
                lo, hi = grid[max(first - 1, 0)], grid[first]
            else:
                last = max((i for i, g in enumerate(fine) if g), default=0)
                lo, hi = grid[last], grid[min(last + 1, sections)]
        return hi if from_there_on else lo

    def entropies(grid: list[float]) -> list[float]:
        r = t / top
        sums = known.agg(*[F.sum(F.pow(r, F.lit(a))).alias(f"s{i}") for i, a in enumerate(grid)],
                         *[F.sum(F.pow(r, F.lit(a)) * F.log(r)).alias(f"l{i}") for i, a in enumerate(grid)]).first()
        return [math.log(sums[f"s{i}"]) - a * sums[f"l{i}"] / sums[f"s{i}"] for i, a in enumerate(grid)]

    alpha = 0.0 if target.max_repeats is not None or target.target_entropy is not None else 1.0
    if target.target_entropy is not None:
        alpha = search(entropies, lambda h: h >= target.target_entropy, False)
    if target.max_repeats is not None:
        most = max(target.max_repeats, 1.0)
        alpha = max(alpha, search(lambda grid: [(top / low) ** (1 - a) for a in grid], lambda r: r <= most, True))
    return alpha


def source_budgets(slim: DataFrame, target: Target) -> DataFrame:
    """(_src, docs, tokens, weight, budget, passes, rest) per source; ``slim`` has _src and _tokens."""
    sources = cut_lineage(slim.groupBy("_src").agg(F.count("*").alias("docs"), F.sum("_tokens").alias("tokens")))
    alpha = temperature(sources, target)
    top, norm = sources.filter("tokens > 0").agg(
        F.max("tokens"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(alpha)))).first()
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(alpha))).otherwise(0.0)
    weight = raw / F.lit(norm or 1.0)
    if target.token_budget is not None:
        budget = F.round(F.lit(float(target.token_budget)) * weight)
    else:
        budget = F.round(F.col("tokens") * F.pow(F.lit(float(top or 1)) / F.col("tokens"), F.lit(1 - alpha)))
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1)
    return cut_lineage(
        sources.withColumn("weight", weight)
        .withColumn("budget", F.when(F.col("tokens") > 0, budget).otherwise(0).cast("long"))
        .withColumn("passes", full.cast("int"))
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("passes") * F.col("tokens"))
                    .otherwise(0).cast("long")))


def mix(docs: DataFrame, target: Target | None = None, block_docs: int = BLOCK_DOCS, id_col: str = "doc_id",
        source_col: str = "source", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(_id, _key, _row, _src, _tokens, epoch, block, place): every reading of every document.

    ``block`` numbers the source's blocks in the order of that pass, ``place`` the documents inside; both from 0.
    ``row_col`` names a column that numbers the rows; then rows of one id may fall into several blocks too, if they are
    more than a block holds.
    """
    target = target or Target()
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    slim = docs.select(
        F.col(id_col).alias("_id"), row.alias("_row"),
        F.coalesce(F.col(id_col).cast("string"), F.md5(text_col), F.lit("")).alias("_key"),
        F.col(source_col).alias("_src"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("_tokens"))
    slim = cut_lineage(slim)
    budgets = source_budgets(slim, target)
    n_blocks = F.ceil(F.col("docs") / F.lit(block_docs))
    heavy = slim if row_col is not None else slim.filter("_id is null")
    heavy = cut_lineage(heavy.groupBy(F.col("_key").alias("_k")).agg(F.count("*").alias("n"))
                        .filter(F.col("n") > block_docs).select("_k"))
    single = F.col("_k").isNotNull() & (F.lit(row_col is not None) | F.col("_id").isNull())
    slim = (slim.join(heavy, slim["_key"] == heavy["_k"], "left")
            .withColumn("_one", F.when(single, F.col("_row").cast("string"))).drop("_k"))
    # concat_ws leaves a null out: other rows fall by their key alone
    spot = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("block"), "_key", "_one")), 1, 8), 16, 10).cast("long")
    small = budgets.select(F.col("_src").alias("_s"), "docs", "passes", "rest")
    placed = (slim.join(small, slim["_src"].eqNullSafe(small["_s"])).drop("_s")
              .withColumn("_block", F.pmod(spot, n_blocks).cast("long")))
    source_key = F.coalesce(F.col("_src"), F.lit("\0"))
    blocks = placed.groupBy("_src", "_block", "passes", "rest").agg(F.sum("_tokens").alias("tokens"))
    passes = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    turn = _shuffle_key(source_key, F.col("epoch"), F.col("_block"))
    order = Window.partitionBy("_src", "epoch").orderBy(turn)
    ahead = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    passes = (passes.withColumn("block", (F.row_number().over(order) - 1).cast("long"))
              .withColumn("ahead", F.coalesce(ahead, F.lit(0)))
              .filter("epoch < passes or ahead < rest"))
    passes = cut_lineage(passes.select(F.col("_src").alias("_s"), F.col("_block").alias("_b"), "epoch", "block",
                                       "ahead", "passes", "rest"))
    cells = (placed.drop("passes", "rest", "docs")
             .join(passes, F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b"))))
    inside = (Window.partitionBy("_src", "epoch", "_block")
              .orderBy(_shuffle_key(F.col("epoch"), F.col("_key"), F.col("_one")), "_key", "_tokens", "_row"))
    before = F.sum("_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return (cells.withColumn("place", (F.row_number().over(inside) - 1).cast("long"))
            .withColumn("before", F.coalesce(before, F.lit(0)))
            .filter("epoch < passes or ahead + before < rest")
            .select("_id", "_key", "_row", "_src", "_tokens", "epoch", "block", "place"))


def mixed_rows(docs: DataFrame, target: Target | None = None, id_col: str = "doc_id", source_col: str = "source",
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as the mix reads it, dealt out block by block.

    Partitions hold whole blocks; inside a partition, blocks and their documents stand in the order of the permutation.
    """
    key, row = free_name(docs, "_mix"), free_name(docs, "_row")
    held = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))  # written, so that numbers stay
    turns = mix(held, target, id_col=id_col, source_col=source_col, text_col=text_col, row_col=row)
    where = F.struct(_shuffle_key(F.coalesce(F.col("_src"), F.lit("\0")), F.col("epoch"), F.col("block"),
                                  F.lit("all")).alias("b"), F.col("place").alias("p"))
    out = held.join(turns.select(F.col("_row").alias(row), where.alias(key)), row).select(*docs.columns, key)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(n, F.col(f"{key}.b")).sortWithinPartitions(key).drop(key)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of every document under a repetition limit of 2."""
    turns = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return turns.select(F.col("_id").alias("doc_id"), F.col("_src").alias("source"),
                        F.col("_tokens").alias("n_tokens"), "epoch", "block", "place")


OP3_SQL = r"""
with slim as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as t from documents),
src as (select source, count(*) as docs, sum(t) as tokens from slim group by source),
edge as (select max(tokens) as hi, min(tokens) as lo from src where tokens > 0),
budget as (
  select source, docs, tokens, cast(round(tokens * pow(hi / tokens,
         case when hi = lo then 0 else least(1, ln(2) / ln(hi / lo)) end)) as bigint) as b from src, edge),
pass as (select *, cast(b // tokens as integer) as passes, cast(b % tokens as bigint) as rest from budget),
placed as (
  select s.*, p.passes, p.rest,
         ('0x' || substr(md5('block|' || s.doc_id), 1, 8))::bigint % cast(ceil(docs / 1000.0) as bigint) as b
  from slim s join pass p using (source)),
blocks as (select source, b, passes, rest, sum(t) as tokens from placed group by all),
turn as (
  select *, md5('17|' || source || '|' || epoch || '|' || b) as k
  from (select *, unnest(range(passes + 1)) as epoch from blocks)),
ranked as (
  select *, row_number() over w - 1 as block, coalesce(sum(tokens) over (w rows between unbounded preceding and 1
         preceding), 0) as ahead from turn window w as (partition by source, epoch order by k)),
cell as (
  select p.doc_id, p.source, p.t, r.epoch, r.block, r.ahead, p.passes, p.rest, row_number() over w - 1 as place,
         coalesce(sum(t) over (w rows between unbounded preceding and 1 preceding), 0) as before
  from placed p join ranked r on r.source = p.source and r.b = p.b
  window w as (partition by p.source, r.epoch, p.b order by md5('17|' || r.epoch || '|' || p.doc_id)))
select doc_id, source, cast(t as bigint) as n_tokens, cast(epoch as integer) as epoch, cast(block as bigint) as block,
       cast(place as bigint) as place
from cell where epoch < passes or ahead + before < rest"""
