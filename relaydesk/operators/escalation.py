"""Escalation decisions from pattern groups, intent, confidence and retrieval similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions.text import folded, matches, matches_any
from ..rules import RulePack, intent_case

DECISION = "struct<decision:string,reason:string,factors:array<string>,risk_score:double>"


def matched_patterns(text: Column, patterns, lowered: Column | None = None) -> Column:
    """The patterns of one group that match, in order.

    ``lowered`` is a column that holds the folded text. Without it, every search folds the text anew.
    """
    lowered = folded(text) if lowered is None else lowered
    return F.array_compact(F.array(*[F.when(matches(lowered, p), p) for p in patterns]))


def decide_by_factors(
    df: DataFrame,
    pack: RulePack,
    text_col: str,
    intent_col: str = "intent",
    confidence_col: str = "intent_confidence",
    similarity: Column | None = None,
    threshold: float = fv.CONFIDENCE_THRESHOLD,
    out: str = "escalation",
) -> DataFrame:
    """Adds a decision struct: the first content factor present decides, weights add to the risk.

    Low confidence and a weak best match escalate only together.
    """
    text, intent, confidence = F.col(text_col), F.col(intent_col), F.col(confidence_col)
    similarity = F.lit(1.0) if similarity is None else similarity
    flags = []
    for f in pack.factors:
        hit = matches_any(F.col("__folded"), f.patterns)
        if f.intent is not None:
            hit = hit | ((intent == f.intent) & (confidence >= threshold))
        flags.append((f.name, f.weight, hit))
    flags.append((*fv.LOW_CONFIDENCE, confidence < threshold))
    flags.append((*fv.LOW_RETRIEVAL, similarity < fv.RETRIEVAL_THRESHOLD))

    flagged = df.withColumn("__folded", folded(text)).withColumn(
        "__flags", F.array(*[F.coalesce(hit, F.lit(False)) for _, _, hit in flags])
    )
    on = [F.col("__flags")[i] for i in range(len(flags))]
    n_content = len(pack.factors)
    uncertain = on[n_content] & on[n_content + 1]
    reason = F.when(uncertain, fv.UNCERTAIN_REASON).otherwise(
        intent_case(intent, pack.auto_reasons, pack.auto_reason_other)
    )
    for i in reversed(range(n_content)):
        reason = F.when(on[i], pack.factors[i].reason).otherwise(reason)
    escalate = uncertain
    for flag in on[:n_content]:
        escalate = escalate | flag
    risk = F.lit(0.0)
    for (_, weight, _), flag in zip(flags, on):
        risk = risk + F.when(flag, weight).otherwise(0.0)
    decision = F.struct(
        F.when(escalate, "ESCALATE").otherwise("AUTO_HANDLE").alias("decision"),
        reason.alias("reason"),
        F.array_compact(F.array(*[F.when(flag, name) for (name, _, _), flag in zip(flags, on)])).alias(
            "factors"
        ),
        F.round(F.least(F.lit(1.0), risk), 3).alias("risk_score"),
    )
    return flagged.withColumn(
        out, F.when(text.isNotNull(), decision).otherwise(F.lit(None).cast(DECISION))
    ).drop("__flags", "__folded")


def decide_by_keywords(df: DataFrame, pack: RulePack, text_col: str, out: str = "escalation") -> DataFrame:
    """Pattern groups alone; the reason names the first group that matches."""
    text = F.col(text_col)
    factors = F.array_compact(
        F.array(*[F.when(matches_any(F.col("__folded"), f.patterns), f.name) for f in pack.factors])
    )
    staged = df.withColumn("__folded", folded(text)).withColumn("__factors", factors)
    hit = F.size("__factors") > 0
    decision = F.struct(
        F.when(hit, "ESCALATE").otherwise("AUTO_HANDLE").alias("decision"),
        F.when(hit, F.format_string(fv.KEYWORD_REASON, F.get("__factors", F.lit(0))))
        .otherwise(fv.KEYWORD_AUTO_REASON).alias("reason"),
        F.col("__factors").alias("factors"),
        F.when(hit, fv.KEYWORD_RISK[0]).otherwise(fv.KEYWORD_RISK[1]).alias("risk_score"),
    )
    return staged.withColumn(
        out, F.when(text.isNotNull(), decision).otherwise(F.lit(None).cast(DECISION))
    ).drop("__factors", "__folded")


def decide_always_auto(df: DataFrame, text_col: str, out: str = "escalation") -> DataFrame:
    decision = F.struct(
        F.lit("AUTO_HANDLE").alias("decision"),
        F.lit(fv.ALWAYS_AUTO_REASON).alias("reason"),
        F.array(F.lit(fv.ALWAYS_AUTO_FACTOR)).alias("factors"),
        F.lit(0.0).alias("risk_score"),
    )
    return df.withColumn(
        out, F.when(F.col(text_col).isNotNull(), decision).otherwise(F.lit(None).cast(DECISION))
    )
