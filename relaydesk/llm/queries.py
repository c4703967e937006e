"""The operators over whole tables, with production parameters: one query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import forest, language, mixing, pieces, quality_model, quality_rules, ranked, secrets, suffixes, topk, toxicity, trie, warc
from .common import read, workspace

REGISTRY = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def piece_model() -> str:
    """The vocabulary file of the token queries; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op1_suffix_dedup(spark, d):
    return suffixes.digests(read(spark, d, "documents"), workspace(spark))


@query
def op2_pieces(spark, d):
    return pieces.digests(read(spark, d, "documents"), piece_model())


@query
def op3_mixing(spark, d):
    return mixing.mix(read(spark, d, "documents"), workspace(spark))


@query
def op4_topk(spark, d):
    vectors = topk.quantise(read(spark, d, "embeddings"), 64)
    return topk.search(vectors, workspace(spark), 20, F.col("vec_id") % 20 == 0).withColumn("rank", F.col("rank").cast("int"))


@query
def op5_language(spark, d):
    told = language.identify(language.document_rows(read(spark, d, "documents")), workspace(spark))
    return told.select(F.col("id").alias("doc_id"), "declared", "language", "text_language", F.round("posterior", 6).alias("posterior"), "accepted")


@query
def page_languages(spark, d):
    """The same operator on pages, which have a markup language, an address and a host with its domain."""
    told = language.identify(language.page_rows(read(spark, d, "pages")), workspace(spark), levels=("host", "domain"))
    return told.select(F.col("id").alias("page_id"), "declared", "language", "text_language", F.round("posterior", 6).alias("posterior"), "accepted")


@query
def op6_toxicity(spark, d):
    return toxicity.score(read(spark, d, "documents"), read(spark, d, "labels"), workspace(spark))


@query
def op7_jaccard_join(spark, d):
    return forest.join(read(spark, d, "documents"), workspace(spark)).drop("mark")


@query
def op8_warc(spark, d):
    manifest = warc.write(read(spark, d, "pages"), workspace(spark))
    return warc.read_records(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_quality_rules(spark, d):
    return quality_rules.clean(read(spark, d, "documents")).drop("cleaned")


@query
def op10_quality_model(spark, d):
    return quality_model.score(read(spark, d, "documents"), read(spark, d, "labels"), workspace(spark))


@query
def op11_secrets(spark, d):
    return secrets.digests(read(spark, d, "documents"))


@query
def op12_ranked(spark, d):
    return ranked.rank(read(spark, d, "documents"), read(spark, d, "benchmark"), workspace(spark))


@query
def op13_prefix_trie(spark, d):
    return trie.nodes(read(spark, d, "conversations"), workspace(spark))
