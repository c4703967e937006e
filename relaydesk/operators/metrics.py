"""Classification and decision metrics, all from one table of counted (truth, pred) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def align(predictions: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Predictions joined to gold rows by id."""
    return predictions.join(gold, key)


def unmatched(predictions: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Number of rows on either side without a partner."""
    def lone(a, b, side):
        return a.join(b, key, "left_anti").agg(F.count("*").alias("n")).withColumn("side", F.lit(side))

    return lone(predictions, gold, "prediction").unionByName(lone(gold, predictions, "gold"))


def confusion_counts(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """The only pass over the data: (by..., truth, pred, n)."""
    by = by or []
    return df.groupBy(*by, F.col(truth).cast("string").alias("truth"),
                      F.col(pred).cast("string").alias("pred")).agg(F.count("*").alias("n"))


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_counts(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., label, tp, predicted, support) over the labels seen on either side."""
    by = by or []
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )
    return (
        counts.select(*by, "truth", "pred", F.explode(sides).alias("s"))
        .groupBy(*by, F.col("s.label").alias("label"))
        .agg(
            F.sum(F.when(F.col("truth") == F.col("pred"), F.col("s.support")).otherwise(0)).alias("tp"),
            F.sum("s.predicted").alias("predicted"),
            F.sum("s.support").alias("support"),
        )
    )


def _prf(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("precision", _share(F.col("tp"), F.col("predicted")))
        .withColumn("recall", _share(F.col("tp"), F.col("support")))
        .withColumn("f1", _share(2 * F.col("tp"), F.col("predicted") + F.col("support")))
    )


def per_class(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support of every label that occurs in the truth."""
    by = by or []
    return _prf(class_counts(counts, by)).where(F.col("support") > 0).select(
        *by, "label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


def summary(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy and macro averages (over the labels of both sides) in one row per group."""
    by = by or []
    return _prf(class_counts(counts, by)).groupBy(*by).agg(
        F.round(_share(F.sum("tp"), F.sum("support")), 4).alias("accuracy"),
        F.round(F.avg("precision"), 4).alias("macro_precision"),
        F.round(F.avg("recall"), 4).alias("macro_recall"),
        F.round(F.avg("f1"), 4).alias("macro_f1"),
    )


def confusion_matrix(counts: DataFrame, labels: list[str]) -> DataFrame:
    """Truth by prediction over the given labels; predictions outside them are left out."""
    return (
        counts.where(F.col("truth").isin(labels) & F.col("pred").isin(labels))
        .groupBy("truth").pivot("pred", labels).agg(F.sum("n")).fillna(0)
    )


def truth_labels(counts: DataFrame) -> DataFrame:
    return counts.select(F.col("truth").alias("label")).distinct().orderBy("label")


def confusion_cells(counts: DataFrame) -> DataFrame:
    """The matrix in long form, predictions that are not truth labels left out."""
    labels = counts.select(F.col("truth").alias("pred")).distinct()
    return counts.join(labels, "pred", "left_semi").select("truth", "pred", "n")


def full_report(counts: DataFrame) -> DataFrame:
    """Per-label rows plus accuracy, macro and support-weighted averages."""
    rows = _prf(class_counts(counts))
    metrics = ["precision", "recall", "f1"]
    per_label = rows.select("label", *metrics, "support")
    total = F.sum("support")
    averages = rows.agg(
        _share(F.sum("tp"), total).alias("accuracy"),
        total.alias("support"),
        *[F.avg(m).alias(f"macro_{m}") for m in metrics],
        *[_share(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}") for m in metrics],
    )
    lines = F.array(
        F.struct(F.lit("accuracy").alias("label"), *[F.col("accuracy").alias(m) for m in metrics], F.col("support")),
        F.struct(F.lit("macro avg").alias("label"), *[F.col(f"macro_{m}").alias(m) for m in metrics], F.col("support")),
        F.struct(F.lit("weighted avg").alias("label"), *[F.col(f"weighted_{m}").alias(m) for m in metrics], F.col("support")),
    )
    report = per_label.unionByName(averages.select(F.explode(lines).alias("l")).select("l.*"))
    return report.select("label", *[F.round(m, 4).alias(m) for m in metrics], "support")


def escalation_metrics(counts: DataFrame, by: list[str] | None = None,
                       positive: str = "ESCALATE", negative: str = "AUTO_HANDLE") -> DataFrame:
    """Binary metrics with ``positive`` as the positive class, and the two kinds of error."""
    def n(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    truth, pred = F.col("truth"), F.col("pred")
    tp = n((truth == positive) & (pred == positive))
    predicted, actual = n(pred == positive), n(truth == positive)
    missed = n((truth == positive) & (pred == negative))
    raised = n((truth == negative) & (pred == positive))
    return counts.groupBy(*(by or [])).agg(
        F.round(_share(n(truth == pred), F.sum("n")), 4).alias("accuracy"),
        F.round(_share(tp, predicted), 4).alias("precision"),
        F.round(_share(tp, actual), 4).alias("recall"),
        F.round(_share(2 * tp, predicted + actual), 4).alias("f1"),
        F.round(_share(missed, actual), 4).alias("false_auto_handle_rate"),
        F.round(_share(raised, n(truth == negative)), 4).alias("false_escalation_rate"),
        missed.alias("false_auto_handle_count"),
        raised.alias("false_escalation_count"),
    )


LOWER_IS_BETTER = ("false_auto_handle_rate",)


def to_long(wide: DataFrame, agent: str, metrics: list[str]) -> DataFrame:
    """(agent, metric, value) rows from one wide row per agent."""
    cells = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
    ])
    return wide.select(agent, F.explode(cells).alias("c")).select(
        F.col(agent).alias("agent"), "c.metric", "c.value"
    )


def benchmark_table(long: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per agent, one column per metric."""
    return long.groupBy("agent").pivot("metric", metrics).agg(F.first("value"))


def compare_agents(long: DataFrame, agents: list[str]) -> DataFrame:
    """One row per metric, one column per agent, and the best agent (the earlier one on a tie)."""
    place = F.array_position(F.array(*[F.lit(a) for a in agents]), F.col("agent"))
    good = F.when(F.col("metric").isin(list(LOWER_IS_BETTER)), -F.col("value")).otherwise(F.col("value"))
    return long.groupBy("metric").agg(
        *[F.max(F.when(F.col("agent") == a, F.col("value"))).alias(a) for a in agents],
        F.max_by("agent", F.struct(good, -place)).alias("best_agent"),
    )
