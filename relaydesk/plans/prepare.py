"""Data preparation: conversations, knowledge base, golden set, judging subset, resources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.intents import golden_records, training_rows
from ..operators.sampling import golden_sample, judge_subset
from ..operators.textmodel import encode, fit_classifier, fit_encoder
from ..operators.transcripts import build_knowledge_base, extract_conversations
from ..rules import SUPPORT_PACK, RulePack
from ..sources.workspace import Workspace
from .configs import Resources


@dataclass(frozen=True)
class Prepared:
    conversations: DataFrame
    knowledge_base: DataFrame
    golden_set: DataFrame
    judge_subset: DataFrame


def prepare(
    transcripts: DataFrame,
    work: Workspace,
    pack: RulePack = SUPPORT_PACK,
    brand: str | None = None,
    max_conversations: int | None = None,
    max_pairs: int | None = None,
    golden_size: int = 200,
    judge_size: int = 50,
) -> Prepared:
    """Tables for one run from raw transcripts."""
    return prepare_pairs(
        extract_conversations(transcripts, brand, max_conversations=max_conversations),
        work, pack, max_pairs, golden_size, judge_size,
    )


def prepare_pairs(
    conversations: DataFrame,
    work: Workspace,
    pack: RulePack = SUPPORT_PACK,
    max_pairs: int | None = None,
    golden_size: int = 200,
    judge_size: int = 50,
) -> Prepared:
    """The same from first question/answer pairs; ids become strings.

    Each table is written once and read back, as all later steps use it more than once.
    """
    conversations = work.stage(
        "conversations",
        conversations.withColumn("conversation_id", F.col("conversation_id").cast("string")),
    )
    kb = work.stage("knowledge_base", build_knowledge_base(conversations, max_pairs))
    golden = work.stage(
        "golden_set",
        golden_sample(golden_records(conversations, pack), golden_size, n_strata=len(pack.taxonomy)),
    )
    return Prepared(conversations, kb, golden, judge_subset(golden, judge_size))


def train(prepared: Prepared, work: Workspace, pack: RulePack = SUPPORT_PACK, dims: int = 256,
          leakage_guard: bool = True, max_iter: int = 1000, tfidf: bool = True) -> Resources:
    """Fit the encoder and, if wanted, the classifier, and write the vector tables.

    With the guard no golden row is trained on or retrieved. Without it golden rows train the
    classifiers and stay in the knowledge base.
    """
    kb, golden = prepared.knowledge_base, prepared.golden_set
    if leakage_guard:
        held_out = golden.select(F.md5("customer_tweet").alias("__md5"))
        kb = (
            kb.withColumn("__md5", F.md5("customer_query"))
            .join(held_out, "__md5", "left_anti").drop("__md5")
        )
        examples = training_rows(kb, golden.limit(0), pack)
    else:
        examples = training_rows(kb, golden, pack)
    encoder = fit_encoder(examples, "text", dims)
    examples = work.stage("examples", encode(examples, encoder, "text"))
    vectors = work.stage("kb_vectors", encode(
        kb.select("id", "customer_query", "support_response"), encoder, "customer_query"))
    return Resources(
        kb=vectors,
        encoder=encoder,
        examples=examples.select("id", "label", "vec"),
        tfidf=fit_classifier(examples.select("text", "label"), max_iter=max_iter, work=work) if tfidf else None,
        pack=pack,
    )
