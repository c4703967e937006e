"""Reading and writing the engine's tables and documents."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TRANSCRIPTS = "company STRING, conversation STRING, conversation_id STRING"
CONVERSATIONS = (
    "conversation_id STRING, full_conversation STRING, "
    "turns ARRAY<STRUCT<role:STRING,text:STRING>>, first_customer_msg STRING, "
    "first_support_reply STRING, num_turns INT"
)
KNOWLEDGE_BASE = "id STRING, customer_query STRING, support_response STRING, num_turns INT"
GOLDEN_SET = (
    "id STRING, customer_tweet STRING, gold_intent STRING, intent_confidence DOUBLE, "
    "gold_escalation STRING, gold_escalation_reason STRING, gold_human_reply STRING, "
    "difficulty_tag STRING, num_turns INT, golden_id STRING, sampling_stratum STRING"
)
NOT_AGENT_RESULTS = ("banking77_results", "judge_results", "benchmark_summary")


def read_transcripts(spark: SparkSession, path: str, brand: str | None = None) -> DataFrame:
    """Transcripts from parquet, three columns, the brand filter left to the scan."""
    df = spark.read.parquet(path).select("company", "conversation", "conversation_id")
    return df if brand is None else df.where(F.col("company") == brand)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Rows over all cores where the scan has fewer splits than there are cores, as with one small
    file. A scan with enough splits is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *key)


def read_labelled(spark: SparkSession, path: str, names: DataFrame, fmt: str = "parquet",
                  fallback: str | None = None) -> DataFrame:
    """(text, label) examples joined to their (label, label_name) dimension.

    ``fallback`` is read where ``path`` does not exist.
    """
    if fallback is not None and not exists(spark, path):
        path = fallback
    reader = spark.read.format(fmt)
    if fmt != "parquet":
        reader = reader.schema("text STRING, label INT")
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path).select("text", "label").join(names, "label")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file holding one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_agent_results(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """All ``*_results.json`` documents of a folder but the three that are not agents."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json", 1)
    return (
        reader.json(f"{folder}/*_results.json")
        .withColumn("document", stem)
        .where(~F.col("document").isin(*NOT_AGENT_RESULTS))
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_agent_results(results: DataFrame, path: str) -> None:
    """One agent's metrics without the bulky prediction rows."""
    write_json(results.drop("predictions"), path)


def write_vectors(kb: DataFrame, path: str) -> None:
    """Knowledge base vectors keyed by id."""
    kb.select("id", "vec").write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, kb: DataFrame, path: str) -> DataFrame:
    """Stored vectors put back next to their knowledge base rows, by id."""
    return kb.join(spark.read.parquet(path), "id")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def document(**parts: Column) -> Column:
    """A nested document column from named parts."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in parts.items()]))


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    files, p = _file_system(spark, path)
    return files.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    files, p = _file_system(spark, path)
    return files.getFileStatus(p).isDirectory()


def params_key(name: str, params: dict) -> str:
    """A folder name that carries the parameters a table was built with."""
    import hashlib

    body = json.dumps(params, sort_keys=True, default=str)
    return f"{name}-{hashlib.md5(body.encode()).hexdigest()[:12]}"
