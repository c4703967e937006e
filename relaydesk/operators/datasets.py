"""Labelled datasets: decoding, label statistics and mapping onto the support intents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..functions.text import tokens


def decode_labels(examples: DataFrame, names: DataFrame) -> DataFrame:
    """(text, label) joined to its (label, label_name) dimension."""
    return examples.join(names, "label")


def class_map_table(spark: SparkSession, pairs=fv.CLASS_MAP) -> DataFrame:
    return spark.createDataFrame(list(pairs), "src_intent string, intent string")


def label_counts(examples: DataFrame, label: str = "label_name") -> DataFrame:
    return examples.groupBy(label).agg(F.count("*").alias("n"))


def label_stats(examples: DataFrame, label: str = "label_name") -> DataFrame:
    """One row: examples, labels, and average, least and most examples per label."""
    return label_counts(examples, label).agg(
        F.sum("n").alias("total_examples"),
        F.count("*").alias("num_intents"),
        F.round(F.avg("n"), 1).alias("avg_examples_per_intent"),
        F.min("n").alias("min_examples_per_intent"),
        F.max("n").alias("max_examples_per_intent"),
    )


def mapped_distribution(counts: DataFrame, class_map: DataFrame, label: str = "label_name") -> DataFrame:
    """Examples per mapped class, largest first."""
    return (
        counts.join(class_map, counts[label] == class_map["src_intent"], "left")
        .where(F.col("intent").isNotNull())
        .groupBy("intent")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "intent")
    )


def unmapped_labels(counts: DataFrame, class_map: DataFrame, label: str = "label_name") -> DataFrame:
    return counts.join(class_map, counts[label] == class_map["src_intent"], "left_anti").select(label)


def map_coverage(counts: DataFrame, class_map: DataFrame, label: str = "label_name") -> DataFrame:
    """Coverage by map size and by labels that really are mapped, in percent."""
    labels = counts.join(class_map, counts[label] == class_map["src_intent"], "left").agg(
        F.count("*").alias("num_intents"), F.count("intent").alias("matched_intents")
    )
    size = class_map.agg(F.count("*").alias("mapped_intents"))
    return labels.withColumn("mapped_intents", size.scalar()).select(
        "num_intents",
        "mapped_intents",
        "matched_intents",
        F.round(F.try_divide(F.col("mapped_intents") * 100.0, F.col("num_intents")), 1).alias("coverage_pct"),
        F.round(F.try_divide(F.col("matched_intents") * 100.0, F.col("num_intents")), 1).alias(
            "matched_coverage_pct"
        ),
    )


def length_by_label(examples: DataFrame, label: str = "label_name", text: str = "text", top: int | None = 10) -> DataFrame:
    """Mean word count per label, longest first."""
    out = examples.groupBy(label).agg(
        F.round(F.avg(F.size(tokens(F.col(text)))), 1).alias("avg_words")
    ).orderBy(F.desc("avg_words"), label)
    return out if top is None else out.limit(top)


def map_examples(examples: DataFrame, class_map: DataFrame, label: str = "label_name") -> DataFrame:
    """Examples whose label is mapped, with the mapped class in ``intent``."""
    return examples.join(class_map, examples[label] == class_map["src_intent"]).drop("src_intent")


def majority_class(examples: DataFrame, label: str) -> DataFrame:
    """The most frequent label, the first by name on a tie."""
    counts = examples.groupBy(label).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), label).limit(1)
