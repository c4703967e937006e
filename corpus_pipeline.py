"""Corpus pipeline: language ID, near duplicates, repeated strings, mixing, tokens.

Each stage takes the documents that the one before kept, as written to Parquet, and all but the last return
the columns of ``documents``. Stages bring decisions back by document id and a hash of the text, so rows
with a null or repeated id stay apart and other columns pass through untouched; rows equal in both are
judged alike. Null texts count as empty. Empty tables pass through.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from relaydesk.llm import forest, language, mixing, pieces, suffixes
from relaydesk.llm.common import read, workspace
from relaydesk.llm.queries import piece_model

ORACLE_SQL = None  # hashed sketches and the token vocabulary are beyond SQL


def _mark(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_mark", F.xxhash64(F.coalesce("text", F.lit(""))))


def _decided(docs: DataFrame, decisions: DataFrame, how: str = "inner") -> DataFrame:
    """``docs`` with the decisions ``_id, _key, …``, which have one row per id and text."""
    marked = _mark(docs)
    return marked.join(decisions, marked.doc_id.eqNullSafe(decisions["_id"]) & (marked["_mark"] == decisions["_key"]), how)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; the others go."""
    told = language.identify(language.document_rows(docs), workspace(spark))
    rejected = told.where(~F.col("accepted")).select(F.col("id").alias("_id"), F.col("mark").alias("_key")).distinct()
    return _decided(docs, rejected, "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id."""
    told = forest.join(docs, workspace(spark))
    stay = told.where("first").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_key")).distinct()
    return _decided(docs, stay, "left_semi").dropDuplicates(["doc_id", "_mark"]).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of 200 that also start elsewhere; ``n_chars`` follows, and documents
    of which nothing is left go."""
    told = suffixes.find_repeats(docs, workspace(spark)).where("n_spans > 0").select(
        F.col("doc_id").alias("_id"), F.col("mark").alias("_key"), F.col("starts").alias("_starts"), F.col("ends").alias("_ends")
    ).dropDuplicates(["_id", "_key"])
    joined = _decided(docs, told, "left").select(*docs.columns, "_starts", "_ends")
    at = docs.columns.index("text")
    names = docs.columns

    def kernel(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                text, starts, ends = part.column(at), part.column(len(names)), part.column(len(names) + 1)
                cut = [suffixes.without_spans(t.as_py(), a.as_py(), b.as_py()) if a.is_valid else t.as_py() for t, a, b in zip(text, starts, ends)]
                columns = [pa.array(cut, pa.string()) if k == at else part.column(k) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, starts.is_valid()], [*names, "_cut"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    told = joined.mapInArrow(kernel, f"{schema}, _cut boolean")
    left = told.where(~F.col("_cut") | (F.length(F.trim("text")) > 0))
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, always whole. Documents that are not taken, or have no word, go."""
    keyed = _mark(docs.select("doc_id", "text", "source")).withColumn("doc_id", F.struct("doc_id", "_mark"))
    taken = mixing.mix_whole(keyed, workspace(spark)).where("copies > 0")
    told = taken.groupBy(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id._mark").alias("_key")).agg(F.max("copies").alias("_copies"))
    return _decided(docs, told).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the text they decode to."""
    return pieces.digests(docs, piece_model())


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each result written and read again."""
    work = workspace(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.stage(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
