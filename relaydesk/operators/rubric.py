"""Rubric scores: heuristic scoring, parsing of judge replies, summaries and rater agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as fv
from ..functions.text import clamp, contains_any, count_terms, strip, tokens

DIMS = fv.DIMENSIONS


def heuristic_scores(df: DataFrame, response: str, reference: str, decision: str) -> DataFrame:
    """Adds the four rubric scores and a reasoning note from text overlap and phrase checks."""
    reply = F.lower(F.col(response))
    ours = tokens(reply)
    theirs = F.array_distinct(tokens(F.lower(F.col(reference))))
    shared = F.size(F.array_intersect(ours, theirs))
    overlap = shared / F.greatest(F.size(theirs), F.lit(1))
    return (
        df.withColumn("factual_grounding", clamp((F.lit(1) + overlap * 5).cast("int"), 1, 5))
        .withColumn("actionability", clamp(F.lit(2) + count_terms(reply, fv.ACTION_WORDS), 1, 5))
        .withColumn("tone_empathy", clamp(F.lit(2) + count_terms(reply, fv.EMPATHY_WORDS), 2, 5))
        .withColumn(
            "safety_escalation",
            F.when(contains_any(reply, fv.PII_WORDS), 1)
            .when((F.col(decision) == "ESCALATE") & ~contains_any(reply, fv.DM_WORDS), 3)
            .otherwise(5),
        )
        .withColumn("reasoning", F.lit(fv.HEURISTIC_REASONING))
    )


def parse_judge_replies(df: DataFrame, content: str) -> DataFrame:
    """Adds a ``parsed`` struct of four scores in 1..5 and reasoning, null unless all four are numbers.

    A fenced block is read first. Numbers are truncated, then held to 1..5.
    """
    body = strip(F.col(content))
    fenced = (
        F.when(F.contains(body, F.lit("```json")), F.element_at(F.split(body, "```json"), 2))
        .when(F.contains(body, F.lit("```")), F.element_at(F.split(body, "```"), 2))
        .otherwise(body)
    )
    text = strip(F.element_at(F.split(fenced, "```"), 1))
    text = F.when(text.rlike(r"(?s)^\{.*\}$"), text)
    numbers = F.from_json(text, ", ".join(f"{d} DOUBLE" for d in DIMS) + ", reasoning STRING")
    flags = F.from_json(text, ", ".join(f"{d} BOOLEAN" for d in DIMS))
    staged = df.withColumn("__n", numbers).withColumn("__f", flags)
    # a JSON true or false counts as 1 or 0, as it does for a Python number check
    value = {d: F.coalesce(F.col("__n")[d], F.col("__f")[d].cast("int").cast("double")) for d in DIMS}
    valid = F.lit(True)
    for d in DIMS:
        valid = valid & value[d].isNotNull() & ~F.isnan(value[d]) & (F.abs(value[d]) != float("inf"))
    scores = [
        F.when(valid, clamp(value[d], -9.0, 9.0).cast("int")).alias(d) for d in DIMS
    ]
    held = F.struct(*[clamp(s, 1, 5).alias(d) for s, d in zip(scores, DIMS)],
                    F.col("__n")["reasoning"].alias("reasoning"))
    return staged.withColumn("parsed", F.when(valid, held)).drop("__n", "__f")


def judge(df: DataFrame, response: str, reference: str, decision: str, content: str | None = None) -> DataFrame:
    """Rubric scores per row with ``judge_method``: a parsed judge reply where there is a valid one,
    the heuristic otherwise."""
    scored = heuristic_scores(df, response, reference, decision)
    if content is None:
        return scored.withColumn("judge_method", F.lit("heuristic"))
    parsed = parse_judge_replies(scored, content)
    for c in (*DIMS, "reasoning"):
        own = F.when(F.col("parsed").isNotNull(), F.col("parsed")[c]).otherwise(F.col(c))
        parsed = parsed.withColumn(c, own)
    return parsed.withColumn(
        "judge_method", F.when(F.col("parsed").isNotNull(), "llm").otherwise("heuristic")
    ).drop("parsed")


def passes(prefix: str = "") -> Column:
    """Mean of the four scores at least 3.5 and none below 3."""
    cols = [F.col(prefix + d) for d in DIMS]
    return (sum(cols[1:], cols[0]) / 4.0 >= fv.PASS_MEAN) & (F.least(*cols) >= fv.PASS_MIN)


def _long(df: DataFrame, keep: list[str], dims=DIMS) -> DataFrame:
    return df.select(
        *keep,
        F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("score")) for d in dims])).alias("__s"),
    ).select(*keep, "__s.dim", "__s.score")


def judge_summary(scores: DataFrame) -> DataFrame:
    """Mean, population deviation, least and most per dimension, rounded to 3."""
    return _long(scores, []).groupBy("dim").agg(
        F.round(F.avg("score"), 3).alias("mean"),
        F.round(F.stddev_pop("score"), 3).alias("std"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
    )


def pass_rate(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count("*").alias("num_evaluated"),
        F.count_if(passes()).alias("pass_count"),
    ).withColumn(
        "pass_rate",
        F.round(F.coalesce(F.try_divide(F.col("pass_count").cast("double"), F.col("num_evaluated")), F.lit(0.0)), 4),
    )


def _weighted_corr(a: Column, b: Column, n: Column) -> Column:
    """Pearson r of (a, b) pairs counted ``n`` times; 0 where a side is constant."""
    a, b, n = a.cast("double"), b.cast("double"), n.cast("double")
    total = F.sum(n)
    cov = F.sum(n * a * b) * total - F.sum(n * a) * F.sum(n * b)
    va = F.sum(n * a * a) * total - F.sum(n * a) * F.sum(n * a)
    vb = F.sum(n * b * b) * total - F.sum(n * b) * F.sum(n * b)
    return F.coalesce(F.try_divide(cov, F.sqrt(va) * F.sqrt(vb)), F.lit(0.0))


def _rank(value: str) -> Column:
    """Average rank of ``value`` among the counted cells of its group."""
    group = Window.partitionBy("dim", "kind")
    smaller = F.sum("n").over(group.orderBy(value).rangeBetween(Window.unboundedPreceding, -1))
    same = F.sum("n").over(Window.partitionBy("dim", "kind", value))
    return F.coalesce(smaller, F.lit(0)) + (same + 1) / 2.0


def agreement(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Agreement of two raters over the same rows.

    One row per dimension and one named ``overall``: spearman_rho, pearson_r, exact_agreement,
    within_1_agreement, and for ``overall`` cohens_kappa and pass_fail_agreement. The score
    pairs are first counted by (dimension, score, score), a table of at most 125 rows, and
    everything including the rank correlation is computed from the counts.
    """
    left = ours.select(key, *[F.col(d).alias(f"a_{d}") for d in DIMS])
    right = theirs.select(key, *[F.col(d).alias(f"b_{d}") for d in DIMS])
    both = left.join(right, key)
    def cell(dim, kind, a, b):
        return F.struct(F.lit(dim).alias("dim"), F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))

    cells = [cell(d, "score", F.col(f"a_{d}"), F.col(f"b_{d}")) for d in DIMS]
    cells.append(cell("overall", "pass", passes("a_").cast("int"), passes("b_").cast("int")))
    counted = (
        both.select(F.explode(F.array(*cells)).alias("p"))
        .groupBy("p.dim", "p.kind", "p.a", "p.b").agg(F.count("*").alias("n"))
    )
    dims = F.when(F.col("kind") == "score", F.array("dim", F.lit("overall"))).otherwise(F.array("dim"))
    pooled = (
        counted.withColumn("dim", F.explode(dims))
        .groupBy("dim", "kind", "a", "b").agg(F.sum("n").alias("n"))
    )
    ranked = pooled.withColumn("ra", _rank("a")).withColumn("rb", _rank("b"))

    a, b = F.col("a"), F.col("b")
    score = F.when(F.col("kind") == "score", F.col("n")).otherwise(0)
    verdict = F.when(F.col("kind") == "pass", F.col("n")).otherwise(0)

    def share(weight, cond):
        return F.try_divide(F.sum(F.when(cond, weight).otherwise(0)).cast("double"), F.sum(weight))

    same, a_yes, b_yes = share(verdict, a == b), share(verdict, a == 1), share(verdict, b == 1)
    by_chance = a_yes * b_yes + (1 - a_yes) * (1 - b_yes)
    return ranked.groupBy("dim").agg(
        F.round(_weighted_corr(F.col("ra"), F.col("rb"), score), 4).alias("spearman_rho"),
        F.round(_weighted_corr(a, b, score), 4).alias("pearson_r"),
        F.round(share(score, a == b), 4).alias("exact_agreement"),
        F.round(share(score, F.abs(a - b) <= 1), 4).alias("within_1_agreement"),
        F.round(F.try_divide(same - by_chance, 1 - by_chance), 4).alias("cohens_kappa"),
        F.round(same, 4).alias("pass_fail_agreement"),
    )
