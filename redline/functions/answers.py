"""Deterministic answer scoring rules as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from redline import dims


def _any_of(phrases: list[str]) -> str:
    return "|".join(re.escape(p) for p in phrases)


def is_abstention(answer: Column) -> Column:
    """The answer declines to answer; an empty or missing answer does too."""
    text = F.coalesce(answer, F.lit(""))
    return (text == "") | F.lower(text).rlike(_any_of(dims.ABSTAIN_PHRASES))


def predicted_route(answer: Column) -> Column:
    """web (a source tag wins over everything), abstain or corpus."""
    text = F.lower(answer)
    return (F.when(text.rlike(_any_of(dims.WEB_TAGS)), "web")
            .when(text.rlike(_any_of(dims.ABSTAIN_PHRASES)), "abstain")
            .otherwise("corpus"))


def route_result(answer: Column, expected: Column) -> Column:
    """``correct``, ``wrong(<predicted>-><expected>)``, or ``wrong`` for an empty answer."""
    predicted = predicted_route(answer)
    return (F.when(F.coalesce(answer, F.lit("")) == "", "wrong")
            .when(predicted == expected, "correct")
            .otherwise(F.concat(F.lit("wrong("), predicted, F.lit("->"), expected, F.lit(")"))))


def choose_answer(first: Column, second: Column, expected: Column, gate: str = "expected_web") -> Column:
    """``STRUCT<answer, provenance>``: fall back to the web answer when the first one abstains.

    ``gate="expected_web"`` falls back only where the question expects the web, ``gate="any"`` on
    every abstention. A web answer always ends up carrying its source tag.
    """
    falls_back = is_abstention(first)
    if gate == "expected_web":
        falls_back = falls_back & (expected == "web")
    elif gate != "any":
        raise ValueError(f"unknown gate: {gate}")
    second = F.coalesce(second, F.lit(""))
    tagged = F.when(F.lower(second).contains("source: web"), second).otherwise(
        F.concat(F.rtrim(second), F.lit(" [source: web]")))
    return F.struct(F.when(falls_back, tagged).otherwise(first).alias("answer"),
                    F.when(falls_back, "web").otherwise("rag").alias("provenance"))


def joint_correct(expected: Column, qtype: Column, route: Column, hit: Column, num_match: Column) -> Column:
    """Web and abstain questions are judged on routing, numerical ones on number and retrieval, others on retrieval."""
    return (F.when(expected.isin("web", "abstain"), route == "correct")
            .when(qtype == "numerical", F.coalesce(num_match, F.lit(False)) & hit)
            .otherwise(hit))


def failure_bucket(joint: Column, qtype: Column, expected: Column, route: Column, hit: Column,
                   num_match: Column) -> Column:
    """Why an answer failed; empty when it did not."""
    return (F.when(joint, "")
            .when(expected == "abstain", "false_positive")
            .when(expected == "web", F.when(route == "correct", "web_search_miss").otherwise("wrong_routing"))
            .when(~hit, "retrieval_miss")
            .when((qtype == "numerical") & num_match.eqNullSafe(False), "table_mangle")
            .when(route != "correct", "wrong_abstention")
            .otherwise("generation_error"))


def answer_preview(answer: Column, limit: int = 200) -> Column:
    return F.replace(F.substring(answer, 1, limit), F.lit("\n"), F.lit(" "))
