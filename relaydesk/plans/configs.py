"""The three triage configurations and what they read."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from ..fixed_values import CONFIDENCE_THRESHOLD
from ..operators.neighbours import nearest
from ..rules import SUPPORT_PACK, RulePack


@dataclass(frozen=True)
class TriageConfig:
    agent_name: str
    classifier: str  # majority | tfidf | blend
    escalation: str  # always_auto | keywords | factors
    reply: str  # canned | nearest | template
    threshold: float = CONFIDENCE_THRESHOLD
    vote_k: int = 5
    top_k: int = 3
    exclude_self: bool = True
    pick: str = "xxhash64"
    search: Callable = nearest

    def parity(self) -> "TriageConfig":
        """Let a message find itself among the known cases."""
        return replace(self, exclude_self=False)


TRIVIAL = TriageConfig("trivial_baseline", "majority", "always_auto", "canned")
TFIDF = TriageConfig("tfidf_baseline", "tfidf", "keywords", "nearest")
PROPOSED = TriageConfig("proposed_agent", "blend", "factors", "template")
CONFIGS = (TRIVIAL, TFIDF, PROPOSED)


@dataclass(frozen=True)
class Resources:
    """Tables and models a configuration reads.

    ``kb`` is (id, customer_query, support_response, vec), ``examples`` is (id, label, vec);
    ids are strings.
    """

    kb: DataFrame
    encoder: object
    examples: DataFrame | None = None
    tfidf: PipelineModel | None = None
    majority: str | None = None
    pack: RulePack = SUPPORT_PACK
