"""Vector retrieval, spans, and the scored configuration matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from redline import dims
from redline.catalogue import register
from redline.catalogue.views import documents, table
from redline.operators import evaluation as E
from redline.operators import ivf as IVF
from redline.operators import spans as SP
from redline.operators import vectors as V
from redline.operators.chunking import chunk_windows


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("anchor"),
                                                     F.col("embedding").alias("vector"))


def _split(spark, sf_dir):
    """Every 25th vector asks, the others answer."""
    v = _vectors(spark, sf_dir)
    asks = v.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("anchor").alias("gold"), "vector")
    return asks, v.filter("vec_id % 25 <> 0").withColumnRenamed("vec_id", "chunk_id")


def _hits(spark, sf_dir, k=dims.TOP_K_RETRIEVE):
    asks, corpus = _split(spark, sf_dir)
    return V.vector_topk(asks, corpus, k)


_TOPK_SQL = """q AS (SELECT vec_id AS query_id, CAST(label AS VARCHAR) AS gold, CAST(embedding AS DOUBLE[]) AS v
       FROM embeddings WHERE vec_id % 25 = 0),
c AS (SELECT vec_id AS chunk_id, CAST(label AS VARCHAR) AS anchor, CAST(embedding AS DOUBLE[]) AS v
      FROM embeddings WHERE vec_id % 25 <> 0),
sims AS (SELECT query_id, gold, chunk_id, anchor, round(list_dot_product(q.v, c.v), 9) AS similarity FROM q CROSS JOIN c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM sims),
hits AS (SELECT * FROM ranked WHERE rank <= 20)"""


@register("vector_topk", f"WITH {_TOPK_SQL} SELECT query_id, chunk_id, similarity, round(1 - similarity, 9) AS distance, "
                         "rank FROM hits")
def vector_topk(spark, sf_dir):
    return _hits(spark, sf_dir).withColumn("distance", F.round("distance", 9))


@register("vector_topk_slabs", f"WITH {_TOPK_SQL} SELECT query_id, chunk_id, similarity, rank FROM hits")
def vector_topk_slabs(spark, sf_dir):
    """The same result by the path for query sets too large to share with every executor."""
    asks, corpus = _split(spark, sf_dir)
    return V.vector_topk(asks, corpus, dims.TOP_K_RETRIEVE, max_shared_rows=8).drop("distance")


def _ivf_hits(spark, sf_dir, k=dims.TOP_K_RETRIEVE):
    asks, corpus = _split(spark, sf_dir)
    index = IVF.build_ivf(corpus, k=k)
    return IVF.search_ivf(asks, index, k)


@register("vector_topk_ivf")
def vector_topk_ivf(spark, sf_dir):
    """Approximate search through the inverted file; its contents are checked by ``vector_topk_ivf_recall``."""
    return _ivf_hits(spark, sf_dir).withColumn("distance", F.round("distance", 9))


@register("vector_topk_ivf_recall", f"""WITH {_TOPK_SQL}
SELECT query_id, count(*) AS n_hits, true AS all_exact, max(similarity) AS best, min(similarity) AS kth,
       true AS recall_reached FROM hits GROUP BY query_id""")
def vector_topk_ivf_recall(spark, sf_dir):
    """Per query: approximate hits, whether each has its exact similarity, the exact search's limits, and whether all
    queries together find 0.9 of the true neighbours."""
    asks, corpus = _split(spark, sf_dir)
    near = _ivf_hits(spark, sf_dir)
    v = corpus.select("chunk_id", F.col("vector").alias("c"))
    q = asks.select("query_id", F.col("vector").alias("q"))
    again = near.join(v, "chunk_id").join(q, "query_id").groupBy("query_id").agg(
        F.count_distinct("chunk_id").alias("n_hits"),
        F.bool_and(F.abs(V.dot(F.col("c"), F.col("q")) - F.col("similarity")) < 1e-8).alias("all_exact"))
    true = _hits(spark, sf_dir)
    found = true.select("query_id", "chunk_id", F.col("similarity").alias("s")).join(
        near.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    share = found.agg((F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))
    limits = found.groupBy("query_id").agg(F.max("s").alias("best"), F.min("s").alias("kth"))
    return limits.join(again, "query_id", "left").join(F.broadcast(share)).select(  # one row
        "query_id", "n_hits", "all_exact", "best", "kth", "recall_reached")


def _with_anchors(spark, sf_dir, hits):
    asks, corpus = _split(spark, sf_dir)
    return hits.join(corpus.select("chunk_id", "anchor"), "chunk_id").join(asks.select("query_id", "gold"), "query_id")


def _reranked(hits, k=dims.TOP_K_FINAL):
    bonus = F.when(F.col("anchor") == F.col("gold"), 0.1).otherwise(0.0)
    return V.rerank(hits, F.round(F.col("similarity") + bonus, 9), k)


_RERANK_SQL = f"""{_TOPK_SQL},
bonus AS (SELECT query_id, gold, chunk_id, anchor, similarity, rank AS first_rank,
                 round(similarity + CASE WHEN anchor = gold THEN 0.1 ELSE 0.0 END, 9) AS score FROM hits),
top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) AS rank
                        FROM bonus) WHERE rank <= 5)"""


@register("rerank_topk", f"WITH {_RERANK_SQL} SELECT query_id, chunk_id, score, first_rank, rank FROM top5")
def rerank_topk(spark, sf_dir):
    return _reranked(_with_anchors(spark, sf_dir, _hits(spark, sf_dir))).select(
        "query_id", "chunk_id", "score", "first_rank", "rank")


@register("config_matrix", f"""WITH s(strategy) AS (VALUES ('fixedsize'), ('sectionaware')),
m(model_key) AS (VALUES ('bge-small'), ('e5-small')), r(rerank) AS (VALUES ('off'), ('on'))
SELECT strategy, model_key, rerank, strategy || '__' || model_key || '__rerank=' || rerank AS config,
       substr(sha1(strategy || '|' || model_key || '|' || rerank), 1, 10) AS config_hash, vec_id AS question_id
FROM s CROSS JOIN m CROSS JOIN r CROSS JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 25 = 0)""")
def config_matrix(spark, sf_dir):
    return _run_matrix(spark, _split(spark, sf_dir)[0])


def _run_matrix(spark, asks):
    """Every question once per configuration: the fixed list of eight is exploded onto the question row."""
    axes = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(m).alias("model_key"), F.lit(r).alias("rerank"))
                     for s in dims.CHUNK_STRATEGIES for m in dims.EMBEDDING_MODELS for r in ("off", "on")])
    return V.with_config_id(asks.select(F.col("query_id").alias("question_id"), F.explode(axes).alias("a"))
                            .select("question_id", "a.*"))


def _gold(spark, asks):
    return asks.select("query_id", F.array("gold").alias("gold_chunks"),
                       F.array().cast("array<array<int>>").alias("gold_spans"))


def _spanless(hits):
    return hits.withColumns({"span_start": F.lit(None).cast("int"), "span_end": F.lit(None).cast("int")})


@register("retrieval_metrics", f"""WITH {_TOPK_SQL}
SELECT query_id, count(*) AS n_retrieved, count(*) FILTER (anchor = gold) AS n_anchor_hits, 0 AS n_span_hits,
       count(*) FILTER (anchor = gold) AS n_matched, count(*) FILTER (anchor = gold) / count(*) AS retrieval_precision,
       CASE WHEN bool_or(anchor = gold) THEN 1e0 ELSE 0e0 END AS retrieval_recall, bool_or(anchor = gold) AS retrieval_hit
FROM hits WHERE rank <= 5 GROUP BY query_id""")
def retrieval_metrics(spark, sf_dir):
    asks, _ = _split(spark, sf_dir)
    hits = _spanless(_with_anchors(spark, sf_dir, _hits(spark, sf_dir, dims.TOP_K_FINAL)))
    return E.retrieval_score(hits, _gold(spark, asks), ["query_id"])


# ---- spans --------------------------------------------------------------------------------------------

@register("passage_spans", """SELECT doc_id, item_id, strpos(d.text, b.text) - 1 AS start,
       strpos(d.text, b.text) - 1 + length(b.text) AS "end"
FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def passage_spans(spark, sf_dir):
    return SP.find_passages(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_WINDOWS_SQL = """win AS (SELECT doc_id, text, length(text) AS n, unnest(generate_series(0,
    CASE WHEN length(text) <= 2400 THEN 0 ELSE CAST(ceil((length(text) - 2400) / 2200.0) AS BIGINT) * 2200 END, 2200)) AS s
  FROM documents),
chunks AS (SELECT doc_id, s // 2200 AS chunk_no, s AS "start", least(s + 2400, n) AS "end",
                  substr(text, s + 1, 2400) AS text FROM win)"""


@register("span_overlap", f"""WITH {_WINDOWS_SQL},
gold AS (SELECT doc_id, item_id, strpos(d.text, b.text) - 1 AS r_start,
                strpos(d.text, b.text) - 1 + length(b.text) AS r_end
         FROM documents d JOIN benchmark b ON contains(d.text, b.text))
SELECT c.doc_id, chunk_no, "start", "end", item_id, r_start, r_end
FROM chunks c JOIN gold g ON c.doc_id = g.doc_id AND c."start" < g.r_end AND g.r_start < c."end" """)
def span_overlap(spark, sf_dir):
    gold = passage_spans(spark, sf_dir).withColumnsRenamed({"start": "r_start", "end": "r_end"})
    chunks = chunk_windows(documents(spark, sf_dir), ["doc_id"]).select(
        "doc_id", "chunk_no", F.col("span_start").alias("start"), F.col("span_end").alias("end"))
    return SP.span_overlap(chunks, gold, ["doc_id"])


_WORD_SQL = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\pL\\pM\\pN\\p{{{{Pc}}}}]+'), lambda w: w <> ''))"


@register("span_retrieval_metrics", f"""WITH {_WINDOWS_SQL},
ids AS (SELECT doc_id * 100000 + chunk_no AS chunk_id, "start", "end", text FROM chunks),
c_tok AS (SELECT chunk_id, CAST('0x' || substr(md5(t), 1, 2) AS INT) % 128 AS slot, count(*) AS n
          FROM (SELECT chunk_id, unnest(string_split(text, ' ')) AS t FROM ids) WHERE t <> '' GROUP BY ALL),
q_tok AS (SELECT item_id, CAST('0x' || substr(md5(t), 1, 2) AS INT) % 128 AS slot, count(*) AS n
          FROM (SELECT item_id, unnest(string_split(text, ' ')) AS t FROM benchmark) WHERE t <> '' GROUP BY ALL),
c_vec AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)) AS w FROM c_tok),
q_vec AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS w FROM q_tok),
sims AS (SELECT item_id, chunk_id, round(sum(q.w * c.w), 9) AS s FROM q_vec q JOIN c_vec c USING (slot) GROUP BY ALL),
top20 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, chunk_id) AS first_rank FROM sims QUALIFY first_rank <= 20),
scored AS (SELECT t.item_id, t.chunk_id, first_rank, c."start", c."end",
             len(list_intersect({_WORD_SQL.format('b.text')}, {_WORD_SQL.format('c.text')})) / len({_WORD_SQL.format('b.text')}) AS score
           FROM top20 t JOIN ids c USING (chunk_id) JOIN benchmark b ON b.item_id = t.item_id),
top5 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first_rank) AS rank FROM scored QUALIFY rank <= 5),
gold AS (SELECT item_id, doc_id, strpos(d.text, b.text) - 1 AS g0, strpos(d.text, b.text) - 1 + length(b.text) AS g1
         FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
met AS (SELECT t.item_id, count(DISTINCT chunk_id) AS n_hits, count(DISTINCT doc_id) AS n_covered
        FROM top5 t JOIN gold g ON g.item_id = t.item_id AND t."start" < g1 AND g0 < t."end" GROUP BY ALL)
SELECT b.item_id, (SELECT count(*) FROM top5 t WHERE t.item_id = b.item_id) AS n_retrieved, 0 AS n_anchor_hits,
       coalesce(n_hits, 0) AS n_span_hits, coalesce(n_hits, 0) AS n_matched,
       coalesce(n_hits, 0) / (SELECT count(*) FROM top5 t WHERE t.item_id = b.item_id) AS retrieval_precision,
       coalesce(n_covered / (SELECT count(*) FROM gold g WHERE g.item_id = b.item_id), 0) AS retrieval_recall,
       coalesce(n_hits, 0) > 0 AS retrieval_hit
FROM benchmark b LEFT JOIN met USING (item_id)""".replace("{{", "{").replace("}}", "}"))
def span_retrieval_metrics(spark, sf_dir):
    """Benchmark passages put to windows of the documents: top 20 by vector, top 5 by word overlap, scored by the places
    where the passages really stand (a place that several documents share counts for each)."""
    docs, items = documents(spark, sf_dir), table(spark, sf_dir, "benchmark")
    windows = chunk_windows(docs, ["doc_id"]).select(
        (F.col("doc_id") * 100_000 + F.col("chunk_no")).alias("chunk_id"), "span_start", "span_end", "text")
    asks = V.embed(items, "text", role="query").select(F.col("item_id").alias("query_id"), "vector")
    near = V.vector_topk(asks, V.embed(windows).select("chunk_id", "vector"))
    texts = near.join(windows, "chunk_id").join(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("q")), "query_id")
    best = V.rerank(texts, V.token_overlap(F.col("q"), F.col("text")))
    places = SP.find_passages(docs, items).groupBy("item_id").agg(
        F.collect_list(F.array(F.col("start").cast("int"), F.col("end").cast("int"))).alias("gold_spans"))
    gold = items.select("item_id").join(places, "item_id", "left").withColumn("gold_chunks", F.array().cast("array<string>"))
    hits = best.select(F.col("query_id").alias("item_id"), F.lit("none").alias("anchor"), "span_start", "span_end")
    return E.retrieval_score(hits, gold, ["item_id"])


# ---- scored runs -----------------------------------------------------------------------------------------
# Question n is put to every configuration. Its answer is the text of conversation n / 25, reworded by
# n / 25 mod 4 so that every route occurs; numerical questions ask for n or n million.

_QUESTIONS_SQL = """questions AS (
  SELECT vec_id AS question_id, CASE WHEN (vec_id // 25) % 3 = 0 THEN 'numerical' ELSE 'factual' END AS question_type,
         CASE WHEN (vec_id // 25) % 8 = 5 THEN 'web' WHEN (vec_id // 25) % 8 = 6 THEN 'abstain' ELSE 'corpus' END AS expected_route,
         CASE WHEN (vec_id // 25) % 3 = 0 THEN vec_id * CASE WHEN (vec_id // 25) % 2 = 0 THEN 1e6 ELSE 1.0 END END AS gold_value
  FROM embeddings WHERE vec_id % 25 = 0)"""
_ANSWERS_SQL = """said AS (SELECT conv_id % (SELECT count(*) FROM questions) AS n, string_agg(text, ' ' ORDER BY conv_id, turn) AS text
  FROM conversations WHERE role = 'assistant' GROUP BY ALL),
answers AS (
  SELECT question_id, CASE (question_id // 25) % 4 WHEN 1 THEN 'Not found in corpus.' WHEN 2 THEN coalesce(text, '') || ' [web]'
    ELSE 'The amount is ' || CAST(question_id AS VARCHAR) || ' million. ' || coalesce(text, '') END AS answer
  FROM questions LEFT JOIN said ON n = question_id // 25)"""


def _questions(asks):
    n = F.floor(F.col("query_id") / 25)
    return asks.select(F.col("query_id").alias("question_id"),
                       F.when(n % 3 == 0, "numerical").otherwise("factual").alias("question_type"),
                       F.when(n % 8 == 5, "web").when(n % 8 == 6, "abstain").otherwise("corpus").alias("expected_route"),
                       F.when(n % 3 == 0, F.col("query_id") * F.when(n % 2 == 0, 1e6).otherwise(1.0)).alias("gold_value"))


def _answers(spark, sf_dir, asks):
    # every assistant turn goes to one question; a question's answer is all of its turns
    total = asks.agg(F.count(F.lit(1)).alias("total"))  # one row
    turn = F.struct("conv_id", "turn", "text")
    said = (table(spark, sf_dir, "conversations").filter("role = 'assistant'").join(F.broadcast(total))
            .groupBy((F.col("conv_id") % F.col("total")).alias("n"))
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["text"]), " ").alias("text")))
    n = F.floor(F.col("question_id") / 25)
    text = F.coalesce("text", F.lit(""))
    return (asks.select(F.col("query_id").alias("question_id")).withColumn("n", n).join(said, "n", "left")
            .select("question_id", F.when(n % 4 == 1, "Not found in corpus.")
                    .when(n % 4 == 2, F.concat(text, F.lit(" [web]")))
                    .otherwise(F.concat(F.lit("The amount is "), F.col("question_id").cast("string"),
                                        F.lit(" million. "), text)).alias("answer")))


def _results(spark, sf_dir, k=dims.TOP_K_FINAL):
    """Scored rows of the whole matrix: one retrieval serves all configurations, reranked or not."""
    asks, _ = _split(spark, sf_dir)
    hits = _with_anchors(spark, sf_dir, _hits(spark, sf_dir))
    # both orders of the same hits: one scan of the corpus, then one row per order
    orders = F.explode(F.array(F.struct(F.lit("off").alias("rerank"), F.col("first_rank").alias("rank"), F.lit(k).alias("k")),
                               F.struct(F.lit("on").alias("rerank"), F.col("rank").alias("rank"),
                                        F.lit(dims.TOP_K_FINAL).alias("k")))).alias("o")
    kept = (_reranked(hits, dims.TOP_K_RETRIEVE).select("query_id", "anchor", orders).filter("o.rank <= o.k")
            .select("query_id", "anchor", "o.rank", "o.rerank"))
    matrix = _run_matrix(spark, asks).select("config", "rerank", F.col("question_id").alias("query_id"))
    per_config = _spanless(matrix.join(kept, ["query_id", "rerank"]))
    gold = matrix.select("config", "query_id").join(_gold(spark, asks), "query_id")
    scored = E.retrieval_score(per_config, gold, ["config", "query_id"]).withColumnRenamed("query_id", "question_id")
    answers = matrix.select("config", F.col("query_id").alias("question_id")).join(
        _answers(spark, sf_dir, asks), "question_id").withColumn("web_answer", F.lit("Found elsewhere."))
    # every cited table counts in thousands; the unit in the answer has to win over it
    scale = matrix.select("config", F.col("query_id").alias("question_id"), F.lit(1e3).alias("table_scale"))
    return E.score_answers(_questions(asks), scored, answers, scale)


def _results_sql(k=5):
    return f"""{_RERANK_SQL}, {_QUESTIONS_SQL}, {_ANSWERS_SQL},
configs AS (SELECT s || '__' || m || '__rerank=' || r AS config, r AS rerank
  FROM (VALUES ('fixedsize'), ('sectionaware')) a(s) CROSS JOIN (VALUES ('bge-small'), ('e5-small')) b(m)
  CROSS JOIN (VALUES ('off'), ('on')) c(r)),
kept AS (SELECT query_id, anchor, gold, 'off' AS rerank FROM hits WHERE rank <= {k}
         UNION ALL SELECT query_id, anchor, gold, 'on' FROM top5),
scored AS (SELECT config, query_id AS question_id, count(*) FILTER (anchor = gold) AS m, count(*) AS n
           FROM configs JOIN kept USING (rerank) GROUP BY ALL),
routed AS (
  SELECT s.config, s.question_id, question_type, expected_route, gold_value, m, n, m > 0 AS retrieval_hit,
    CASE WHEN expected_route = 'web' AND lower(answer) LIKE '%not found in corpus%' THEN 'Found elsewhere. [source: web]'
         ELSE answer END AS final_answer,
    CASE WHEN expected_route = 'web' AND lower(answer) LIKE '%not found in corpus%' THEN 'web' ELSE 'rag' END AS provenance
  FROM scored s JOIN questions USING (question_id) JOIN answers USING (question_id)),
pred AS (SELECT *, CASE WHEN final_answer LIKE '%source: web%' OR final_answer LIKE '%[web]%' THEN 'web'
    WHEN final_answer = 'Not found in corpus.' THEN 'abstain' ELSE 'corpus' END AS p,
    -- the generated answers hold no other digits: only "The amount is N million" carries a number
    CASE WHEN question_type = 'numerical' AND gold_value IS NOT NULL
         THEN final_answer LIKE 'The amount is%' AND (question_id = 0 OR (question_id // 25) % 2 = 0) END AS numeric_match FROM routed),
verdict AS (SELECT *, CASE WHEN p = expected_route THEN 'correct' ELSE 'wrong(' || p || '->' || expected_route || ')' END AS route_result FROM pred),
joint AS (SELECT *, CASE WHEN expected_route <> 'corpus' THEN route_result = 'correct'
    WHEN question_type = 'numerical' THEN coalesce(numeric_match, false) AND retrieval_hit ELSE retrieval_hit END AS joint_correct FROM verdict),
results AS (SELECT config, question_id, question_type, expected_route, route_result, round(m / n, 3) AS retrieval_precision,
    CASE WHEN m > 0 THEN 1e0 ELSE 0e0 END AS retrieval_recall, retrieval_hit, numeric_match, joint_correct, provenance,
    replace(substr(final_answer, 1, 200), chr(10), ' ') AS answer_preview,
    CASE WHEN joint_correct THEN '' WHEN expected_route = 'abstain' THEN 'false_positive'
      WHEN expected_route = 'web' THEN CASE WHEN route_result = 'correct' THEN 'web_search_miss' ELSE 'wrong_routing' END
      WHEN NOT retrieval_hit THEN 'retrieval_miss'
      WHEN question_type = 'numerical' AND numeric_match IS NOT DISTINCT FROM false THEN 'table_mangle'
      WHEN route_result <> 'correct' THEN 'wrong_abstention' ELSE 'generation_error' END AS failure_bucket FROM joint)"""


@register("config_results", f"WITH {_results_sql()} SELECT * FROM results")
def config_results(spark, sf_dir):
    return _results(spark, sf_dir)


@register("results_summary", f"""WITH {_results_sql()}
SELECT config, count(*) AS n, count(*) FILTER (numeric_match) AS n_numeric_ok, count(numeric_match) AS n_numeric,
       count(*) FILTER (retrieval_hit) AS n_hit, count(*) FILTER (route_result = 'correct') AS n_route_ok,
       count(*) FILTER (joint_correct) AS n_joint, round(count(*) FILTER (joint_correct) / count(*) * 100, 1) AS joint_pct
FROM results GROUP BY config""")
def results_summary(spark, sf_dir):
    return E.summarize(_results(spark, sf_dir))


@register("best_config", f"""WITH {_results_sql()}
SELECT config, count(*) FILTER (joint_correct) AS n_joint FROM results GROUP BY config ORDER BY n_joint DESC, config LIMIT 1""")
def best_config(spark, sf_dir):
    return E.best_config(results_summary(spark, sf_dir)).select("config", "n_joint")


@register("numeric_by_type", f"""WITH {_results_sql()}
SELECT config, question_type, count(*) FILTER (numeric_match) AS n_ok, count(*) AS n
FROM results WHERE numeric_match IS NOT NULL GROUP BY ALL""")
def numeric_by_type(spark, sf_dir):
    return E.numeric_by_type(_results(spark, sf_dir))


@register("crosstab_margins", f"""WITH {_results_sql()}
SELECT coalesce(config, 'Total') AS config, count(*) FILTER (joint_correct AND question_type = 'factual') AS factual,
       count(*) FILTER (joint_correct AND question_type = 'numerical') AS numerical, count(*) FILTER (joint_correct) AS "Total"
FROM results GROUP BY GROUPING SETS ((config), ())""")
def crosstab_margins(spark, sf_dir):
    return E.crosstab_margins(_results(spark, sf_dir), "joint_correct", ["factual", "numerical"])


@register("failure_matrix", f"WITH {_results_sql()} SELECT config, " + ", ".join(
    f"count(*) FILTER (failure_bucket = '{b}') AS {b}" for b in dims.FAILURE_BUCKETS)
          + ", count(*) FILTER (joint_correct) AS joint_ok, count(*) AS total FROM results GROUP BY config")
def failure_matrix(spark, sf_dir):
    return E.failure_matrix(_results(spark, sf_dir))


@register("run_diff", f"""WITH {_results_sql(5)}, a AS (SELECT config, question_id, joint_correct AS now FROM results),
prev_scored AS (SELECT config, query_id AS question_id, count(*) FILTER (anchor = gold) AS m
  FROM configs JOIN (SELECT query_id, anchor, gold, 'off' AS rerank FROM hits WHERE rank <= 3
                     UNION ALL SELECT query_id, anchor, gold, 'on' FROM top5) USING (rerank) GROUP BY ALL),
b AS (SELECT v.config, v.question_id, CASE WHEN v.expected_route <> 'corpus' THEN v.route_result = 'correct'
    WHEN v.question_type = 'numerical' THEN coalesce(v.numeric_match, false) AND s.m > 0 ELSE s.m > 0 END AS was
  FROM verdict v JOIN prev_scored s USING (config, question_id))
SELECT config, question_id, now, was FROM a JOIN b USING (config, question_id) WHERE now IS DISTINCT FROM was""")
def run_diff(spark, sf_dir):
    return E.diff_runs(_results(spark, sf_dir, 5), _results(spark, sf_dir, 3))


@register("question_counts", f"""WITH {_QUESTIONS_SQL}
SELECT 'type' AS dimension, question_type AS value, count(*) AS n FROM questions GROUP BY ALL
UNION ALL SELECT 'expected_route', expected_route, count(*) FROM questions GROUP BY ALL""")
def question_counts(spark, sf_dir):
    return E.question_counts(_questions(_split(spark, sf_dir)[0]).withColumnRenamed("question_type", "type"))


@register("assembled_context", f"""WITH {_TOPK_SQL}
SELECT query_id, string_agg('[chunk_id=' || chunk_id || ' ticker=' || coalesce(source, '?') || ' anchor=' || anchor || ']' ||
         chr(10) || coalesce(d.text, ''), chr(10) || chr(10) || '-----' || chr(10) || chr(10) ORDER BY rank) AS context
FROM hits LEFT JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 5 GROUP BY query_id""")
def assembled_context(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("ticker"), "text")
    hits = _with_anchors(spark, sf_dir, _hits(spark, sf_dir, dims.TOP_K_FINAL)).join(d, "chunk_id", "left")
    return V.assemble_context(hits.withColumn("text", F.coalesce("text", F.lit(""))))
