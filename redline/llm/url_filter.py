"""URL filter: host and path rules first; else a blocked Bloom filter of listed URLs in front of an exact join.

A URL is made canonical, hashed to one 64-bit block of the filter and to four bits inside it. A URL whose bits are all set
may be listed and goes on to a hash join with the list, which removes false positives; every other URL skips that join.
The filter is a table of (block, word), at most ``MAX_BLOCKS`` rows (16 MB), which is what makes it safe to broadcast; with
a longer list more URLs go on to the join, and the result stays the same. Only DataFrame functions are used.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.llm.common import free_name, table
from redline.session import cut_lineage

MAX_BLOCKS = 1 << 20
BITS_PER_KEY = 16
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
         ("net/fr/", "block"))
#: Words whose presence in a host puts a page's URL on the list that the query checks against.
LISTED_WORDS = ("casino", "bet", "bets", "pills", "loans", "adult", "poker")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. and m., path without closing slashes, sorted query without tracking fields; null without ://."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    fields = F.array_sort(F.filter(F.split(query, "&"), lambda f: (f != "") & ~f.rlike(r"^(utm_\w+|ref)(=|$)")))
    tail = F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(F.lit(""))
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, tail))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is this host or above it and whose path begins this path."""
    rule = verdict = F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: len(r[0])):
        rule_host, _, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _place(key: Column, blocks: int) -> tuple[Column, Column]:
    """Block of a key and its four bits."""
    h = F.xxhash64(key)
    mask = F.lit(0).cast("long")
    for shift in (0, 6, 12, 18):
        bit = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.shiftrightunsigned(h, 24).bitwiseAND(F.lit(blocks - 1)), mask


def blocked_bloom(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The filter of a list as (_block, _word), and its number of blocks."""
    n = keys.count()
    blocks = min(MAX_BLOCKS, 1 << max(0, (max(n, 1) * BITS_PER_KEY // 64)).bit_length())
    block, mask = _place(F.col(key), blocks)
    return cut_lineage(keys.groupBy(block.alias("_block")).agg(F.bit_or(mask).alias("_word"))), blocks


def mark_listed(df: DataFrame, key: str, listed: DataFrame, listed_key: str, name: str = "_listed") -> DataFrame:
    """``df`` with a boolean: is its key (null: no) in the list? A column ``name`` of ``df`` is replaced."""
    own_block, own_mask, word, maybe, own = (free_name(df, c) for c in ("_block", "_mask", "_word", "_maybe", "_key"))
    keys = cut_lineage(listed.select(F.col(listed_key).alias(own)).filter(F.col(own).isNotNull()).distinct())
    bloom, blocks = blocked_bloom(keys, own)
    bloom = bloom.select(F.col("_block").alias(own_block), F.col("_word").alias(word))
    block, mask = _place(F.col(key), blocks)
    # a null key gets a block below zero, which the filter does not have
    marked = df.withColumn(own_block, F.when(F.col(key).isNotNull(), block).otherwise(-1)).withColumn(own_mask, mask)
    probed = (marked.join(F.broadcast(bloom), own_block, "left")  # at most MAX_BLOCKS rows
              .withColumn(maybe, F.coalesce(F.col(word).bitwiseAND(F.col(own_mask)) == F.col(own_mask), F.lit(False)))
              .drop(own_block, own_mask, word))
    probed = cut_lineage(probed)
    passed = probed.filter(~F.col(maybe)).withColumn(name, F.lit(False))
    hits = (probed.filter(F.col(maybe)).join(keys, F.col(key) == F.col(own), "left")
            .withColumn(name, F.col(own).isNotNull()).drop(own))
    return passed.unionByName(hits).drop(maybe)


def judge(pages: DataFrame, listed: DataFrame, listed_col: str, rules=RULES, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every row. A null URL is not listed and has no rule."""
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
                        canonical(url).alias("_canonical"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    marked = mark_listed(base, "_canonical", listed, listed_col, "listed")
    return marked.select("page_id", "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
                         .alias("verdict"), "listed")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page; listed are the canonical URLs of pages whose host carries a listed word."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    words = "|".join(map(re.escape, LISTED_WORDS))
    listed = (pages.filter(host_of(F.col("url")).rlike(rf"(^|[.-])({words})([.-]|$)"))
              .select(canonical(F.col("url")).alias("_listed_url")))
    return judge(pages, listed, "_listed_url")


OP9_SQL = rf"""
with cut as (
  select page_id, url, strpos(coalesce(url, ''), '://') as pos from pages),
part as (
  select page_id, url, case when pos > 0 then substr(url, pos + 3) else '' end as rest, pos > 0 as ok from cut),
piece as (
  select page_id, ok, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
         regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) as query from part),
canon as (
  select *, list_sort([f for f in string_split(query, '&') if f <> '' and not
         regexp_matches(f, '^(utm_\w+|ref)(=|$)')]) as fields from piece),
named as (
  select *, case when ok then regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') ||
         case when len(fields) > 0 then '?' || array_to_string(fields, '&') else '' end end as c from canon),
listed as (select distinct c from named where c is not null and
           regexp_matches(host, '(^|[.-])({"|".join(LISTED_WORDS)})([.-]|$)')),
ruled as (
  select n.*, l.c is not null as listed, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/')
      then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from named n left join listed l using (c))
select page_id, host, path, rule, case when rule in ('com/', 'www.example.com/en/') then 'allow'
       when rule is not null or listed then 'block' else 'allow' end as verdict, listed from ruled"""
