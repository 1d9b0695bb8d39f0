"""Retrieval and answer scoring over a configuration matrix, and the summaries of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline import dims
from redline.functions import answers as A
from redline.functions.numbers import extract_numbers, numeric_match
from redline.operators.once import compute_once

RUN_KEY = ["config", "question_id"]


def cited_scale(hits: DataFrame, by: list[str], top: int = 3) -> DataFrame:
    """First usable table scale among the top hits (zero counts as missing)."""
    usable = F.when((F.col("rank") <= top) & (F.col("table_scale") != 0), F.col("rank"))
    return hits.groupBy(*by).agg(F.min_by("table_scale", usable).alias("table_scale"))


def retrieval_score(hits: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and hit flag per question.

    ``hits``: (by, anchor, span_start, span_end), at most k rows per question. ``gold``: (by, gold_chunks,
    gold_spans), one row per question. An anchor hit counts once and hides a span hit of the same chunk;
    recall is anchor coverage, or span coverage where no usable gold anchor exists.
    """
    anchors = F.array_distinct(F.filter(F.coalesce("gold_chunks", F.array().cast("array<string>")),
                                        lambda a: a.isNotNull() & ~a.isin("", "unknown")))
    spans = F.filter(F.coalesce("gold_spans", F.array().cast("array<array<int>>")),
                     lambda s: s.isNotNull() & (F.size(s) == 2))
    g = gold.select(*by, anchors.alias("_anchors"), spans.alias("_spans"))
    rows = g.join(hits.select(*by, "anchor", "span_start", "span_end", F.lit(True).alias("_hit")), by, "left")
    # positions in the list of gold spans, so that a span listed twice counts twice
    overlapping = F.filter(F.transform("_spans", lambda s, i: F.when(
        (F.col("span_start") < s[1]) & (s[0] < F.col("span_end")), i)), lambda i: i.isNotNull())
    rows = (rows.withColumn("_anchor_hit", F.coalesce(F.array_contains("_anchors", F.col("anchor")), F.lit(False)))
            .withColumn("_covered", F.when(F.col("span_start").isNotNull() & F.col("span_end").isNotNull(), overlapping))
            .withColumn("_span_hit", ~F.col("_anchor_hit") & (F.coalesce(F.size("_covered"), F.lit(0)) > 0)))
    agg = rows.groupBy(*by).agg(
        F.count_if("_hit").alias("n_retrieved"), F.count_if("_anchor_hit").alias("n_anchor_hits"),
        F.count_if("_span_hit").alias("n_span_hits"), F.first("_anchors").alias("_anchors"),
        F.first("_spans").alias("_spans"), F.collect_set(F.when(~F.col("anchor").isin("none", "unknown"), F.col("anchor"))).alias("_seen"),
        F.array_distinct(F.flatten(F.collect_list("_covered"))).alias("_covered"))
    matched = F.col("n_anchor_hits") + F.col("n_span_hits")
    recall = (F.when(F.size("_anchors") > 0, F.size(F.array_intersect("_seen", "_anchors")) / F.size("_anchors"))
              .when(F.size("_spans") > 0, F.size("_covered") / F.size("_spans")).otherwise(F.lit(0.0)))
    return (agg.withColumn("n_matched", matched)
            .withColumn("retrieval_precision", F.coalesce(matched / F.nullif("n_retrieved", F.lit(0)), F.lit(0.0)))
            .withColumn("retrieval_recall", recall)
            .withColumn("retrieval_hit", (matched > 0) | (F.col("retrieval_recall") > 0))
            .select(*by, "n_retrieved", "n_anchor_hits", "n_span_hits", "n_matched", "retrieval_precision",
                    "retrieval_recall", "retrieval_hit"))


def score_answers(questions: DataFrame, retrieval: DataFrame, answers: DataFrame, scales: DataFrame | None = None,
                  gate: str = "expected_web") -> DataFrame:
    """One result row per (config, question).

    ``questions``: (question_id, question_type, expected_route, gold_value); ``retrieval``: output of
    :func:`retrieval_score` by (config, question_id); ``answers``: (config, question_id, answer, web_answer);
    ``scales``: (config, question_id, table_scale) of the cited tables.
    """
    rows = retrieval.join(questions, "question_id").join(answers, RUN_KEY, "left")
    rows = rows.join(scales, RUN_KEY, "left") if scales is not None else rows.withColumn(
        "table_scale", F.lit(None).cast("double"))
    rows = compute_once(rows, _c=A.choose_answer(F.col("answer"), F.col("web_answer"), F.col("expected_route"), gate))
    rows = rows.withColumns({"final_answer": F.col("_c.answer"), "provenance": F.col("_c.provenance")})
    rows = compute_once(
        rows, route_result=A.route_result(F.col("final_answer"), F.col("expected_route")),
        _numbers=F.when(F.col("question_type") == "numerical", extract_numbers(F.col("final_answer"), F.col("table_scale"))))
    rows = rows.withColumn("numeric_match", F.when(
        (F.col("question_type") == "numerical") & F.col("gold_value").isNotNull(),
        numeric_match(F.col("_numbers"), F.col("gold_value"))))
    args = [F.col(c) for c in ("question_type", "expected_route", "route_result", "retrieval_hit", "numeric_match")]
    qtype, expected, route, hit, num = args
    rows = rows.withColumn("joint_correct", A.joint_correct(expected, qtype, route, hit, num))
    return rows.select(
        *RUN_KEY, "question_type", "expected_route", "route_result",
        F.round("retrieval_precision", 3).alias("retrieval_precision"),
        F.round("retrieval_recall", 3).alias("retrieval_recall"), "retrieval_hit", "numeric_match", "joint_correct",
        "provenance", A.answer_preview(F.col("final_answer")).alias("answer_preview"),
        A.failure_bucket(F.col("joint_correct"), qtype, expected, route, hit, num).alias("failure_bucket"))


def summarize(results: DataFrame) -> DataFrame:
    """Per config: questions, numeric matches over applicable ones, hits, correct routes, joint and its share."""
    return results.groupBy("config").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("numeric_match").alias("n_numeric_ok"),
        F.count("numeric_match").alias("n_numeric"), F.count_if("retrieval_hit").alias("n_hit"),
        F.count_if(F.col("route_result") == "correct").alias("n_route_ok"),
        F.count_if("joint_correct").alias("n_joint"),
        F.round(F.count_if("joint_correct") / F.count(F.lit(1)) * 100, 1).alias("joint_pct"))


def best_config(summary: DataFrame) -> DataFrame:
    """The config with most jointly correct answers; the first by name on a tie."""
    return summary.orderBy(F.col("n_joint").desc(), "config").limit(1)


def numeric_by_type(results: DataFrame) -> DataFrame:
    return (results.filter(F.col("numeric_match").isNotNull()).groupBy("config", "question_type")
            .agg(F.count_if("numeric_match").alias("n_ok"), F.count(F.lit(1)).alias("n")))


def crosstab_margins(results: DataFrame, metric: str, types: list[str] | None = None) -> DataFrame:
    """Sum of a flag by config and question type with a Total row and column."""
    cells = results.cube("config", "question_type").agg(F.count_if(metric).alias("n"), F.grouping("config").alias("gc"),
                                                        F.grouping("question_type").alias("gt"))
    named = cells.select(F.when(F.col("gc") == 1, "Total").otherwise(F.col("config")).alias("config"),
                         F.when(F.col("gt") == 1, "Total").otherwise(F.col("question_type")).alias("question_type"), "n")
    pivot = named.groupBy("config")
    pivot = pivot.pivot("question_type", [*types, "Total"]) if types else pivot.pivot("question_type")
    return pivot.agg(F.first("n"))


def failure_matrix(results: DataFrame) -> DataFrame:
    """Failures per config and bucket (all buckets, zero-filled), with joint_ok and total."""
    return results.groupBy("config").agg(
        *[F.count_if(F.col("failure_bucket") == b).alias(b) for b in dims.FAILURE_BUCKETS],
        F.count_if("joint_correct").alias("joint_ok"), F.count(F.lit(1)).alias("total"))


def diff_runs(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Questions of both runs whose joint correctness changed (typed comparison, nulls equal)."""
    p = previous.select(*RUN_KEY, F.col("joint_correct").alias("was"))
    return (current.select(*RUN_KEY, F.col("joint_correct").alias("now")).join(p, RUN_KEY)
            .filter(~F.col("was").eqNullSafe(F.col("now"))))


def majority_vote(verdicts: DataFrame, by: list[str], verdict: str = "verdict") -> DataFrame:
    """Majority (strictly more than half) and disagreement per judged answer."""
    return verdicts.groupBy(*by).agg(
        (F.count_if(verdict) * 2 > F.count(F.lit(1))).alias("faithful"),
        (F.max(verdict) != F.min(verdict)).alias("disagreement"), F.count(F.lit(1)).alias("n_votes"))


def vote_report(votes: DataFrame) -> DataFrame:
    return votes.agg(F.count(F.lit(1)).alias("judged"), F.count_if("faithful").alias("faithful"),
                     F.count_if("disagreement").alias("disagreed"))


def question_counts(questions: DataFrame) -> DataFrame:
    """Questions by type and by route: (dimension, value, n), one pass over the questions."""
    pairs = F.explode(F.array(
        F.struct(F.lit("type").alias("dimension"), F.col("type").alias("value")),
        F.struct(F.lit("expected_route").alias("dimension"), F.col("expected_route").alias("value"))))
    return questions.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


def union_questions(generated: DataFrame, curated: DataFrame) -> DataFrame:
    """Both question sets without working columns (leading underscore)."""
    def public(df):
        return df.select(*[c for c in df.columns if not c.startswith("_")])
    return public(generated).unionByName(public(curated), allowMissingColumns=True)


def missing_keys(expected: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    """Expected keys that do not occur."""
    return expected.join(actual.select(*on), on, "left_anti")
