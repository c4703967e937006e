"""Scoring predictions against a golden set, and comparing configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import metrics, overlap, rubric
from ..operators.neighbours import pair_similarity
from ..operators.sampling import first_shuffled
from ..operators.textmodel import encode

HEADLINE = ["intent_accuracy", "intent_macro_f1", "escalation_accuracy", "escalation_f1",
            "false_auto_handle_rate", "rouge1", "rougeL"]
RESPONSE = ["rouge1_mean", "rouge2_mean", "rougeL_mean", "bleu_mean", "semantic_similarity_mean"]


def aligned(predictions: DataFrame, golden: DataFrame) -> DataFrame:
    """Predictions of any number of agents next to their golden rows."""
    return predictions.join(golden.withColumnRenamed("id", "query_id").drop("intent_confidence"), "query_id")


def agent_metrics(rows: DataFrame, encoder=None) -> DataFrame:
    """One wide row per agent: intent, escalation and response metrics.

    ``rows`` holds aligned predictions of all agents, so each metric family is one pass over
    the predictions whatever their number.
    """
    by = ["agent_name"]
    intent = metrics.summary(metrics.confusion_counts(rows, "gold_intent", "intent", by), by)
    decided = metrics.escalation_metrics(
        metrics.confusion_counts(rows, "gold_escalation", "escalation_decision", by), by
    )
    response = response_means(rows, encoder)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("num_examples"))
    return (
        sizes.join(intent.select(
            *by, F.col("accuracy").alias("intent_accuracy"),
            F.col("macro_precision").alias("intent_macro_precision"),
            F.col("macro_recall").alias("intent_macro_recall"),
            F.col("macro_f1").alias("intent_macro_f1")), by)
        .join(decided.select(
            *by, F.col("accuracy").alias("escalation_accuracy"),
            F.col("precision").alias("escalation_precision"),
            F.col("recall").alias("escalation_recall"), F.col("f1").alias("escalation_f1"),
            "false_auto_handle_rate", "false_escalation_rate",
            "false_auto_handle_count", "false_escalation_count"), by)
        .join(response, by)
    )


def response_means(rows: DataFrame, encoder=None) -> DataFrame:
    keyed = rows.select(
        F.struct("agent_name", "query_id").alias("pair"), "response", "gold_human_reply"
    )
    scores = overlap.overlap_scores(keyed, "pair", "response", "gold_human_reply")
    if encoder is not None:
        vectors = encode(encode(keyed, encoder, "response", "gen_vec"), encoder, "gold_human_reply", "ref_vec")
        scores = scores.join(
            pair_similarity(vectors, "gen_vec", "ref_vec").select("pair", "similarity"), "pair"
        )
    return overlap.quality_means(scores.withColumn("agent_name", F.col("pair.agent_name")), ["agent_name"])


def benchmark_long(wide: DataFrame) -> DataFrame:
    """(agent, metric, value) of the seven headline metrics."""
    renamed = wide.withColumnRenamed("rouge1_mean", "rouge1").withColumnRenamed("rougeL_mean", "rougeL")
    return metrics.to_long(renamed, "agent_name", HEADLINE)


def agent_documents(rows: DataFrame, wide: DataFrame) -> DataFrame:
    """One nested metrics document per agent, with per-class metrics and the confusion cells."""
    by = ["agent_name"]
    counts = metrics.confusion_counts(rows, "gold_intent", "intent", by)
    classes = metrics.per_class(counts, by).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("label", F.struct("precision", "recall", "f1", "support")))))
        .alias("per_class"))
    labels = counts.select(*by, F.col("truth").alias("pred")).distinct()
    cells = counts.join(labels, [*by, "pred"], "left_semi").groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("truth", "pred", "n"))).alias("confusion")
    )
    return wide.join(classes, by).join(cells, by).select(
        "agent_name",
        "num_examples",
        F.struct(
            F.col("intent_accuracy").alias("accuracy"),
            F.col("intent_macro_precision").alias("macro_precision"),
            F.col("intent_macro_recall").alias("macro_recall"),
            F.col("intent_macro_f1").alias("macro_f1"),
            "per_class",
            "confusion",
        ).alias("intent"),
        F.struct(
            F.col("escalation_accuracy").alias("accuracy"),
            F.col("escalation_precision").alias("precision"),
            F.col("escalation_recall").alias("recall"),
            F.col("escalation_f1").alias("f1"),
            "false_auto_handle_rate", "false_escalation_rate",
            "false_auto_handle_count", "false_escalation_count",
        ).alias("escalation"),
        F.struct(*[c for c in RESPONSE if c in wide.columns]).alias("response"),
    )


def judged(rows: DataFrame, max_samples: int | None = None, content: str | None = None) -> DataFrame:
    """Rubric scores of aligned predictions, of the first ``max_samples`` in seeded order if given."""
    if max_samples is not None:
        rows = first_shuffled(rows, max_samples)
    return rubric.judge(rows, "response", "gold_human_reply", "escalation_decision", content)


def summary_document(long: DataFrame, golden: DataFrame, knowledge_base: DataFrame, seconds: float) -> DataFrame:
    """One nested row: sizes, run time and the headline metrics of every agent."""
    per_agent = long.groupBy("agent").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics")
    )
    return per_agent.agg(
        F.lit(round(seconds, 1)).alias("pipeline_time_seconds"),
        F.map_from_entries(F.collect_list(F.struct("agent", "metrics"))).alias("agents"),
    ).select(
        "pipeline_time_seconds",
        golden.agg(F.count("*")).scalar().alias("golden_set_size"),
        knowledge_base.agg(F.count("*")).scalar().alias("knowledge_base_size"),
        "agents",
    )


def judge_document(scores: DataFrame) -> DataFrame:
    """One nested row: scores per dimension, pass count and rate, and how rows were judged."""
    per_dim = rubric.judge_summary(scores).agg(
        F.map_from_entries(F.collect_list(F.struct("dim", F.struct("mean", "std", "min", "max"))))
    )
    methods = scores.agg(F.array_join(F.array_sort(F.collect_set("judge_method")), "+"))
    return rubric.pass_rate(scores).select(
        "*", per_dim.scalar().alias("aggregate_scores"), methods.scalar().alias("judge_method")
    )
