"""Rule packs: the keyword, pattern and template tables the operators take as input.

A pack is small by construction. A pack read from a table is checked against the row bound its
caller states before it becomes literals of the plan; ``operators.intents.keyword_matches_table``
joins a rule table of any size instead.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fixed_values as fv


@dataclass(frozen=True)
class Factor:
    name: str
    weight: float
    intent: str | None
    reason: str
    patterns: tuple[str, ...]


@dataclass(frozen=True)
class RulePack:
    """All tables one triage configuration needs."""

    taxonomy: tuple[tuple[str, tuple[str, ...]], ...]
    fallback_intent: str
    fallback_confidence: float = fv.FALLBACK_CONFIDENCE
    gold_triggers: tuple[tuple[str, tuple[str, ...]], ...] = fv.GOLD_TRIGGERS
    intent_defaults: tuple[tuple[str, str, str], ...] = fv.INTENT_DEFAULTS
    gold_auto_reason: str = fv.GOLD_AUTO_REASON
    sarcasm: tuple[str, ...] = fv.SARCASM
    factors: tuple[Factor, ...] = field(
        default_factory=lambda: tuple(Factor(*row) for row in fv.FACTORS)
    )
    auto_reasons: tuple[tuple[str, str], ...] = fv.AUTO_REASONS
    auto_reason_other: str = fv.AUTO_REASON_OTHER
    templates: tuple[tuple[str, str, tuple[str, ...]], ...] = fv.TEMPLATES
    issue_types: tuple[tuple[str, tuple[str, ...]], ...] = fv.ISSUE_TYPES

    @property
    def intents(self) -> list[str]:
        return [intent for intent, _ in self.taxonomy]

    def with_factors(self, factors) -> "RulePack":
        return replace(self, factors=tuple(factors))

    # -- table forms -----------------------------------------------------------
    def keyword_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (intent, ord_, kw)
            for ord_, (intent, kws) in enumerate(self.taxonomy)
            for kw in kws
        ]
        return spark.createDataFrame(rows, "intent string, ord int, kw string")

    def pattern_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (f.name, priority, f.weight, p)
            for priority, f in enumerate(self.factors, 1)
            for p in f.patterns
        ]
        return spark.createDataFrame(
            rows, "factor string, priority int, weight double, pattern string"
        )

    def default_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            list(self.intent_defaults), "intent string, decision string, reason string"
        )


SUPPORT_PACK = RulePack(
    taxonomy=tuple((intent, kws) for intent, _, kws in fv.TAXONOMY),
    fallback_intent=fv.FALLBACK_INTENT,
)


def bounded_rows(table: DataFrame, max_rows: int) -> list:
    """Rows of a rule table, refusing tables that are not rule-sized."""
    rows = table.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"rule table holds more than {max_rows} rows")
    return rows


def taxonomy_from_table(keywords: DataFrame, max_rows: int):
    """(intent, ord, kw) rows to a taxonomy tuple, in ``ord`` order."""
    grouped: dict[tuple[int, str], list[str]] = defaultdict(list)
    rows = bounded_rows(keywords.select("intent", "ord", "kw"), max_rows)
    for row in sorted(rows, key=lambda r: (r["ord"], r["kw"])):
        grouped[(row["ord"], row["intent"])].append(row["kw"])
    return tuple((intent, tuple(kws)) for (_, intent), kws in grouped.items())


def word_bounded(factors) -> tuple[Factor, ...]:
    """The same factors with every pattern held to whole words."""
    return tuple(replace(f, patterns=tuple(rf"\b(?:{p})\b" for p in f.patterns)) for f in factors)


def intent_case(column, pairs, default):
    """``CASE column WHEN key THEN value ... ELSE default`` from a small table."""
    out = F.lit(default)
    for key, value in reversed(list(pairs)):
        out = F.when(column == F.lit(key), F.lit(value)).otherwise(out)
    return out
