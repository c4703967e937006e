"""Triage of a whole table of messages: classify, retrieve, decide, reply."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.escalation import decide_always_auto, decide_by_factors, decide_by_keywords
from ..operators.neighbours import PackedSearch, classify_blend, nearest, retrieve_cases
from ..operators.replies import canned_reply, nearest_reply, template_reply
from ..operators.textmodel import classify_tfidf, encode
from ..sources.workspace import Workspace
from .configs import Resources, TriageConfig


def classify_majority(df: DataFrame, intents: list[str], majority: str) -> DataFrame:
    """The same intent for every row, with full confidence."""
    scores = F.create_map(*[
        part for i in intents for part in (F.lit(i), F.lit(1.0 if i == majority else 0.0))
    ])
    return (
        df.withColumn("intent", F.lit(majority))
        .withColumn("intent_confidence", F.lit(1.0))
        .withColumn("intent_all_scores", scores)
    )


def vectorise(df: DataFrame, resources: Resources, id_col: str, text_col: str) -> DataFrame:
    """(query_id, customer_text, vec) for :func:`triage`. Stage it when the table is large: both
    searches and the classifier read it."""
    named = df.select(F.col(id_col).cast("string").alias("query_id"), F.col(text_col).alias("customer_text"))
    return encode(named, resources.encoder, "customer_text")


def packed_once(config: TriageConfig, work: Workspace) -> TriageConfig:
    """The configuration with an exact search that packs the vectors of both its searches once."""
    return replace(config, search=PackedSearch(work)) if config.search is nearest else config


def with_cases(queries: DataFrame, resources: Resources, config: TriageConfig) -> DataFrame:
    """(query_id, retrieved_cases) of every query."""
    return retrieve_cases(
        queries, resources.kb, config.top_k, exclude_self=config.exclude_self, search=config.search
    )


def triage(queries: DataFrame, config: TriageConfig, resources: Resources,
           cases: DataFrame | None = None) -> DataFrame:
    """One prediction per query row of (query_id, customer_text, vec).

    ``cases`` may hold retrieved cases computed before, as for several configurations over the
    same messages. Messages without text keep their row with an empty decision and intent.
    """
    config = packed_once(config, Workspace(queries.sparkSession))
    if config.classifier == "majority":
        classified = classify_majority(
            queries, resources.pack.intents, resources.majority or resources.pack.fallback_intent
        )
    elif config.classifier == "tfidf":
        classified = classify_tfidf(queries, resources.tfidf, "customer_text")
    else:
        classified = classify_blend(
            queries, resources.examples, config.vote_k, exclude_self=config.exclude_self,
            search=config.search,
        )
    cases = with_cases(queries, resources, config) if cases is None else cases
    joined = classified.drop("vec").join(cases, "query_id", "left")
    known = F.col("customer_text").isNotNull()
    joined = joined.withColumn("intent", F.when(known, F.col("intent"))).withColumn(
        "intent_confidence", F.when(known, F.col("intent_confidence"))
    )
    decided = _decide(joined, config, resources)
    replied = _reply(decided, config, resources)
    return replied.select(
        "query_id",
        "customer_text",
        "intent",
        "intent_confidence",
        "intent_all_scores",
        F.col("escalation.decision").alias("escalation_decision"),
        F.col("escalation.reason").alias("escalation_reason"),
        F.col("escalation.factors").alias("escalation_factors"),
        F.col("escalation.risk_score").alias("risk_score"),
        "retrieved_cases",
        "response",
        "response_method",
        "grounding_sources",
        F.lit(config.agent_name).alias("agent_name"),
    )


def best_similarity(cases: Column) -> Column:
    return F.coalesce(F.get(cases, F.lit(0))["similarity"], F.lit(0.0))


def _decide(df: DataFrame, config: TriageConfig, resources: Resources) -> DataFrame:
    if config.escalation == "always_auto":
        return decide_always_auto(df, "customer_text")
    if config.escalation == "keywords":
        return decide_by_keywords(df, resources.pack, "customer_text")
    return decide_by_factors(
        df, resources.pack, "customer_text", similarity=best_similarity(F.col("retrieved_cases")),
        threshold=config.threshold,
    )


def _reply(df: DataFrame, config: TriageConfig, resources: Resources) -> DataFrame:
    if config.reply == "canned":
        return canned_reply(df)
    if config.reply == "nearest":
        return nearest_reply(df)
    return template_reply(df, resources.pack, "customer_text", "query_id", method=config.pick)
