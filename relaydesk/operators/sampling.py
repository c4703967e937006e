"""Stratified samples: golden set, judging subset, train/test split, examples per class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ordering import seeded_key, top_n_per_group

SCORE_PLACEHOLDERS = (
    "struct<factual_grounding:int,actionability:int,tone_empathy:int,"
    "safety_escalation:int,overall_pass:boolean>"
)


def golden_sample(
    records: DataFrame,
    target: int = 200,
    seed: int = 42,
    n_strata: int = 6,
    stratum: str = "gold_intent",
    order_key: str = "id",
    method: str = "xxhash64",
) -> DataFrame:
    """Quota sample over strata, a third of each quota from rows that are not ``standard``.

    Every stratum gets ``target // n_strata`` rows; the remainder goes to the strata that
    appear first by ``order_key``. Missing rows are filled from the rest of the stratum. Only
    the first rows of each (stratum, hard) group in seeded order can be chosen, so the data is
    cut to those before anything is ranked as a whole.
    """
    base, extra = divmod(target, n_strata)
    most = base + (1 if extra else 0)
    strata = records.groupBy(stratum).agg(F.min(order_key).alias("__seen"))
    strata = strata.select(
        stratum, F.row_number().over(Window.orderBy("__seen")).alias("__stratum_no")
    )
    keyed = records.select(
        "*",
        (F.col("difficulty_tag") != "standard").alias("__hard"),
        seeded_key(F.col(order_key), seed, method).alias("__key"),
    )
    cut = top_n_per_group(
        keyed, [stratum, "__hard"], [F.col("__key"), F.col(order_key)], max(most, 1), "__r",
        salt_on=[order_key],
    ).join(strata, stratum)

    quota = F.lit(base) + (F.col("__stratum_no") <= extra).cast("int")
    n_hard = F.greatest(F.lit(3), F.floor(quota / 3).cast("int"))
    own_share = F.when(F.col("__hard"), F.col("__r") <= n_hard).otherwise(
        F.col("__r") <= quota - n_hard
    )
    turn = F.when(own_share & F.col("__hard"), 0).when(own_share, 1).otherwise(2)
    in_stratum = Window.partitionBy(stratum).orderBy("__turn", "__key", order_key)
    picked = (
        cut.withColumn("__quota", quota)
        .withColumn("__turn", turn)
        .withColumn("__pos", F.row_number().over(in_stratum))
        .where(F.col("__pos") <= F.col("__quota"))
    )
    numbered = picked.withColumn(
        "__no", F.row_number().over(Window.orderBy("__stratum_no", "__pos"))
    )
    return (
        numbered.withColumn("golden_id", F.format_string("GS-%03d", "__no"))
        .withColumn("sampling_stratum", F.col(stratum))
        .transform(first_shuffled, target, "golden_id", seed, method)
        .drop("__hard", "__key", "__r", "__stratum_no", "__quota", "__turn", "__pos", "__no")
    )


def first_shuffled(rows: DataFrame, n: int, id_col: str = "golden_id", seed: int = 42,
                   method: str = "xxhash64") -> DataFrame:
    """The first ``n`` rows in the seeded order of the ids: a mix of all strata."""
    return rows.orderBy(seeded_key(F.col(id_col), seed, method), id_col).limit(n)


def judge_subset(
    golden: DataFrame,
    n: int = 50,
    seed: int = 123,
    stratum: str = "gold_intent",
    id_col: str = "golden_id",
    method: str = "xxhash64",
) -> DataFrame:
    """``n // strata`` rows of each stratum, filled up from the rest, with null score fields.

    A row beyond the first ``n`` of its stratum can never be chosen, so ranking the strata
    against each other happens on at most ``n`` rows of each.
    """
    order = [F.col("__key"), F.col(id_col)]
    keyed = golden.withColumn("__key", seeded_key(F.col(id_col), seed, method))
    ranked = top_n_per_group(keyed, [stratum], order, n, "__r", salt_on=[id_col])
    n_strata = F.max("__stratum_no").over(Window.partitionBy())
    return (
        ranked.withColumn("__stratum_no", F.dense_rank().over(Window.orderBy(stratum)))
        .withColumn("__fill", F.col("__r") > F.floor(F.lit(n) / n_strata))
        .orderBy("__fill", *order)
        .limit(n)
        .drop("__key", "__r", "__stratum_no", "__fill")
        .withColumn("human_scores", null_scores())
    )


def null_scores() -> Column:
    """A struct of empty score fields for people to fill in."""
    return F.from_json(F.lit("{}"), SCORE_PLACEHOLDERS)


def stratified_split(
    df: DataFrame,
    label: str,
    id_col: str,
    test_share: float = 0.2,
    seed: int = 42,
    method: str = "xxhash64",
) -> DataFrame:
    """Adds ``split``: an exact per-label share of rows, chosen by seeded hash, is ``test``.

    The label quotas add up to the rounded-up share of all rows, by largest remainder. The
    leading 12 bits of the hash form buckets, bucket counts locate the cut-off, and ranking
    happens inside (label, bucket), so a label with most of the rows is spread over 4,096 groups.
    """
    key = F.col("__key")
    bucket = F.substring(key, 1, 3) if method == "md5" else F.shiftright(key, 52)
    keyed = df.withColumn("__key", seeded_key(F.col(id_col), seed, method)).withColumn(
        "__bucket", bucket
    )
    counts = keyed.groupBy(label, "__bucket").agg(F.count("*").alias("__n"))
    per_label = counts.groupBy(label).agg(F.sum("__n").alias("__total"))
    everything = F.sum("__total").over(Window.partitionBy())
    share = F.col("__total") * F.lit(float(test_share))
    by_remainder = Window.orderBy(F.desc(share - F.floor(share)), label)
    quotas = per_label.select(
        label,
        F.floor(share).alias("__floor"),
        F.row_number().over(by_remainder).alias("__turn"),
        F.sum(F.floor(share)).over(Window.partitionBy()).alias("__floors"),
        F.ceil(everything * F.lit(float(test_share))).alias("__wanted"),
    ).select(
        label,
        (F.col("__floor")
         + (F.col("__turn") <= F.col("__wanted") - F.col("__floors")).cast("int")
         ).alias("__quota"),
    )
    running = Window.partitionBy(label).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        label, "__bucket", F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__before")
    ).join(quotas, label)
    in_bucket = Window.partitionBy(label, "__bucket").orderBy("__key", id_col)
    return (
        keyed.join(starts, [label, "__bucket"])
        .withColumn("__rank", F.col("__before") + F.row_number().over(in_bucket))
        .withColumn("split", F.when(F.col("__rank") <= F.col("__quota"), "test").otherwise("train"))
        .drop("__key", "__bucket", "__before", "__quota", "__rank")
    )


def class_samples(df: DataFrame, cls: str, order: list[str], n: int = 3) -> DataFrame:
    """The first ``n`` rows of every class."""
    return top_n_per_group(df, [cls], [F.col(c) for c in order], n, "sample_no")
