"""Triage of arriving messages and first-seen deduplication on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.configs import Resources, TriageConfig
from ..plans.triage import packed_once, triage, vectorise
from ..sources.workspace import Workspace


def triage_stream(
    messages: DataFrame,
    config: TriageConfig,
    resources: Resources,
    out: str,
    checkpoint: str,
    id_col: str = "id",
    text_col: str = "text",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run the batch triage on every micro-batch and write it to ``out``.

    Neighbour ranking needs whole batches, so the plan runs inside ``foreachBatch``. Each batch
    overwrites its own folder, which makes a repeated batch harmless; its vectors are stored while
    the searches read them, over those of the batch before. The vectors searched are packed once.
    """
    work = Workspace(messages.sparkSession)
    packed = packed_once(config, work)

    def score(batch: DataFrame, batch_id: int) -> None:
        queries = work.stage("messages", vectorise(batch, resources, id_col, text_col))
        predictions = triage(queries, packed, resources)
        predictions.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        messages.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def first_seen(messages: DataFrame, text_col: str, ts_col: str | None = None,
               delay: str = "1 hour") -> DataFrame:
    """Keep the first arrival of every text (by MD5).

    With an event time the state is bounded and copies further apart than ``delay`` pass again;
    without one every copy is caught and the state holds one hash per distinct text.
    """
    hashed = messages.withColumn("msg_md5", F.md5(text_col))
    if ts_col is None:
        return hashed.dropDuplicates(["msg_md5"])
    return hashed.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(["msg_md5"])


def append_stream(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to parquet files."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", out)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
