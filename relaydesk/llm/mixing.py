"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

A source's target is its share of the wanted size by weight, at most ``max_epochs`` times what it has; what
a cap cuts off goes to the other sources by weight until none is above its cap. The rows of a source are
then all taken ``floor(target / size)`` times, and the rest of the target once more from rows in seeded
order; the row on the edge is taken in part, so every source meets its target to the word. ``mix_whole`` takes
no row in part: which of a few rows are taken, and how often, is chosen so that sources stay near their targets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import Workspace

BUCKET_DIGITS = 3  # leading hex digits of the seeded order that the edge is searched by
CHOICES = 1 << 16  # ways to take the free documents of a source, whose sums are compared
NEAR = 1 / 400  # of a source's target: so near, a choice is left as close to the mix as it can be
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weights(sources: DataFrame, weights: tuple[float, ...], source_col: str = "source") -> DataFrame:
    """``weight`` for each row of a table of distinct sources: ``weights`` in turn by code point, null last."""
    turn = F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int"))
    return sources.withColumn("weight", weight)


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """``sources`` (one row each: ``source_size``, ``weight`` > 0) with ``target``.

    Sources are ordered by cap over weight. Rising water fills them in that order: those before the first
    one whose cap lies above the level are capped, the others get the level times their weight. The table
    has a row per source, so its one window is as small as the list of sources.
    """
    cap = max_epochs * F.col("source_size")
    order = Window.orderBy(F.col("fill"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    told = sources.withColumns({"cap": cap, "fill": cap / F.col("weight")})
    told = told.withColumn("level", (
        share * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(rest))
    # capped as long as the level, with all before them capped, lies at or above their own cap
    open_before = F.max(F.when(F.col("fill") > F.col("level"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    told = told.withColumn("open", open_before)
    level = F.min_by("level", F.struct("fill", F.col("source").isNull(), "source")).over(Window.partitionBy("open"))
    return told.withColumn("target", F.when(F.col("open") == 1, level * F.col("weight")).otherwise(F.col("cap"))).select(
        *sources.columns, "target"
    )


def mix(docs: DataFrame, work: Workspace, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0,
        seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken``: what the mix takes of it, in words.

    A null source is a source of its own, a null text or one without words has size 0 and is taken 0 times.
    Other columns are not read; an empty table gives an empty result. See ``mix_whole`` for whole documents.
    """
    told = _mixed(docs, work, weights, share, max_epochs, seed, id_col, text_col, source_col)
    return told.select("doc_id", "size", "source_size", "target", "taken")


def mix_whole(docs: DataFrame, work: Workspace, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0,
              seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per distinct id and source ``doc_id, source, size, copies``: how often the mix takes its rows, always whole.

    As ``mix``, but no document is taken in part. Of every source, the document on the edge and some others in a
    second seeded order are free (10 for at most 2 copies): they are taken 0 to ``max_epochs`` times so that the
    source comes within ``NEAR`` of its target with the fewest words taken otherwise than ``mix`` does; if that
    cannot be, as near as it can. All others stay as they are. Rows equal in id and source are taken or left
    together, their words added up. Rows without a word have no copies.
    """
    most = int(max_epochs)
    if most < 1:
        raise ValueError("whole documents need max_epochs of 1 or more")
    free = max(int(math.log(CHOICES, most + 1)), 1)
    told = _mixed(docs, work, weights, share, max_epochs, seed, id_col, text_col, source_col)
    units = work.stage("units", told.groupBy("doc_id", "source").agg(
        F.sum("size").alias("size"), F.max("target").alias("target"), F.max("epochs").alias("epochs"), F.sum("again").alias("again")))
    second = F.md5(F.concat(F.lit(f"{seed}:free:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    whole = (F.col("again") == 0) | (F.col("again") == F.col("size"))
    order = Window.partitionBy("source").orderBy(whole, "second", "doc_id")
    few = units.where("size > 0").withColumn("second", second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= free)
    kind = units.schema["doc_id"].dataType

    def choose(batches):
        """Rows are sources with the sizes of their free documents and what the mix takes of them."""
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            copies = []
            for sizes, taken, target in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                sums, moved = np.zeros(1, np.int64), np.zeros(1, np.int64)
                for s, t in zip(sizes, taken):  # the k-th document is taken as often as the k-th digit of the place says
                    sums = np.concatenate([sums + c * s for c in range(most + 1)])
                    moved = np.concatenate([moved + abs(c * s - t) for c in range(most + 1)])
                off = np.abs(sums - sum(taken))
                best = int(np.lexsort((off, moved, np.maximum(off, int(NEAR * target))))[0])
                copies.append([best // (most + 1) ** k % (most + 1) for k in range(len(sizes))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(copies, pa.list_(pa.int32()))], ["source", "ids", "copies"])

    lists = few.groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id", "size", (F.col("epochs") * F.col("size") + F.col("again")).alias("taken")))).alias("x"),
        F.max("target").alias("target"),
    ).select("source", F.col("x.doc_id").alias("ids"), F.col("x.size").alias("sizes"), F.col("x.taken").alias("taken"), "target")
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("copies", T.ArrayType(T.IntegerType()))])
    picked = lists.mapInArrow(choose, schema).select("source", F.explode(F.arrays_zip("ids", "copies")).alias("x")).select(
        F.col("x.ids").alias("free_id"), F.col("source").alias("free_source"), F.col("x.copies").alias("chosen"))
    picked = work.stage("picked", picked)
    joined = units.join(picked, F.col("doc_id").eqNullSafe(F.col("free_id")) & F.col("source").eqNullSafe(F.col("free_source")), "left")
    fixed = F.col("epochs") + (F.col("again") > 0).cast("int")
    return joined.select("doc_id", "source", "size", F.when(F.col("size") > 0, F.coalesce("chosen", fixed)).otherwise(0).cast("int").alias("copies"))


def _mixed(docs: DataFrame, work: Workspace, weights: tuple[float, ...], share: float, max_epochs: float,
           seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The result of ``mix`` with ``source``, the whole repetitions ``epochs``, and ``again``, the words taken beyond them.

    The order of rows is the MD5 of seed and id, then size; rows equal in both share the edge in any order,
    which gives the same rows. Sources without a word have target 0.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = work.stage("sizes", docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"), order.alias("place"),
    ))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = water_fill(cycle_weights(totals, weights), share, max_epochs)
    size, target = F.col("source_size"), F.col("target")
    epochs = F.when(size > 0, F.floor(target / size)).otherwise(F.lit(0))
    targets = targets.withColumn("epochs", epochs).withColumn("extra", F.greatest(F.floor(target) - F.col("epochs") * size, F.lit(0)))

    # the bucket of the seeded order in which a source's extra words run out
    bucket = F.substring("place", 1, BUCKET_DIGITS)
    sums = rows.groupBy("source", bucket.alias("edge")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("edge"))
    edges = sums.withColumn("upto", upto).withColumnRenamed("source", "edge_source")
    ends = targets.join(edges, F.col("source").eqNullSafe(F.col("edge_source")) & (F.col("upto") > F.col("extra")) & (F.col("upto") - F.col("words") <= F.col("extra")), "left")
    plan = work.stage("targets", ends.select(
        F.col("source").alias("plan_source"), "source_size", "target", "epochs", "extra", "edge",
        (F.col("upto") - F.col("words")).alias("before"),
    ))
    told = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("bucket", bucket)
    at_edge = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    whole = F.when(F.col("edge").isNull() | (F.col("bucket") < F.col("edge")), F.col("size")).otherwise(F.lit(0))
    upto_row = F.sum("size").over(Window.partitionBy("source").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, 0))
    left = F.col("extra") - F.col("before") - (F.col("upto_row") - F.col("size"))
    parts = told.where(at_edge).withColumn("upto_row", upto_row).withColumn("again", F.least("size", F.greatest(left, F.lit(0))))
    told = told.where(~at_edge).withColumn("again", whole).unionByName(parts.drop("upto_row"))
    return told.select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("again")).cast("long").alias("taken"), "source", "epochs", "again")
