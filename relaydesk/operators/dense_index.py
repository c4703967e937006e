"""Nearest neighbours through inverted cells of product-quantised vectors, re-ranked exactly.

Vectors are scaled to unit length and dealt to the cell whose centre is nearest; what the centre leaves is coded by
parts, a byte each (Jégou et al., 2011). Cells are stored in blocks of bounded size, one row a block. A query visits
the cells of its nearest centres, adds up one table entry per part of a code, and keeps its best few rows; these are
compared by their whole vectors. Centres and codes are learned from a bounded sample, every row is indexed. The
result is approximate: :func:`relaydesk.operators.neighbours.nearest` is exact, and the caller chooses.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources.workspace import Workspace
from .neighbours import SIM_DIGITS, as_doubles

SAMPLE_ROWS = 20_000  # that centres and codes are learned from
MOST_CELLS = 1024
CODES = 256
BLOCK_ROWS = 4096
CHUNK_QUERIES = 256
ROUNDS = 12


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of a list column as rows of unit length; zero vectors stay."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(n, -1) if n else np.zeros((0, 0))
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def centres(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's means from distinct sampled rows; empty ones take a row of the largest error."""
    distinct = np.unique(rows, axis=0)
    found = distinct[rng.permutation(len(distinct))[: min(k, len(distinct))]].copy()
    for _ in range(ROUNDS):
        near = closest(rows, found)
        sums = np.zeros_like(found)
        np.add.at(sums, near, rows)
        count = np.bincount(near, minlength=len(found))
        empty = np.flatnonzero(count == 0)
        found = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], found)
        if len(empty):
            error = ((rows - found[near]) ** 2).sum(axis=1)
            found[empty] = rows[np.argsort(-error)[: len(empty)]]
    return found


def closest(rows: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row."""
    half = 0.5 * (found * found).sum(axis=1)
    return np.concatenate([np.argmax(rows[a : a + 4096] @ found.T - half, axis=1) for a in range(0, len(rows), 4096)] or [np.zeros(0, np.int64)])


@dataclass(frozen=True)
class DenseIndex:
    """A stored index: the folder, the centres, and the codebooks (parts x codes x width)."""

    spark: SparkSession
    root: str
    cells: np.ndarray
    books: np.ndarray

    @property
    def blocks(self) -> DataFrame:
        """(cell, block, ids, codes): one row a block."""
        return self.spark.read.parquet(f"{self.root}/blocks")

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/vectors")


def build(base: DataFrame, root: str, id_col: str = "id", vec: str = "vec", cells: int | None = None, parts: int = 8,
          sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> DenseIndex:
    """Index all rows of ``base`` in the folder ``root``.

    At most ``sample_rows`` rows, first by seeded hash, are learned from by the driver. ``cells`` is the square root
    of the number of rows unless given, at most ``MOST_CELLS``. Vectors are of one width; null ids or vectors are left out.
    """
    spark = base.sparkSession
    rows = base.select(F.col(id_col).alias("id"), as_doubles(F.col(vec)).alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    total = rows.count()
    key = F.xxhash64("id", F.lit(seed))
    most = -(1 << 63) + (1 << 64) * 2 * sample_rows // max(total, 1)  # about twice the sample, so that ordering sends little
    few = rows if total <= 2 * sample_rows else rows.where(key <= most)
    sample = few.orderBy(key, "id").limit(sample_rows).select("vec").toArrow().column(0).combine_chunks()
    rng = np.random.default_rng(seed)
    learned = unit_rows(sample)
    width = learned.shape[1]
    if width % parts and width:
        raise ValueError(f"{parts} parts do not divide {width} dimensions")
    found = centres(learned, min(cells or max(int(total**0.5), 1), MOST_CELLS), rng) if total else np.zeros((1, parts))
    rest = learned - found[closest(learned, found)] if total else np.zeros((1, parts))
    books = [centres(rest[:, a : a + rest.shape[1] // parts], CODES, rng) for a in range(0, rest.shape[1], rest.shape[1] // parts)]
    padded = np.stack([np.vstack([b, np.full((CODES - len(b), b.shape[1]), np.inf)]) for b in books])
    index = DenseIndex(spark, root, found, np.where(np.isinf(padded), 0.0, padded))
    spark.createDataFrame([(k, v) for k, v in enumerate(found.tolist())], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{root}/centres")
    spark.createDataFrame([(p, c, v) for p, b in enumerate(index.books.tolist()) for c, v in enumerate(b)], "part int, code int, value array<double>").write.mode(
        "overwrite").parquet(f"{root}/books")
    rows.write.mode("overwrite").parquet(f"{root}/vectors")
    wide = found.shape[1] // parts

    def code(batches):
        for batch in batches:
            x = unit_rows(batch.column(1))
            cell = closest(x, found) if len(x) else np.zeros(0, np.int64)
            left = x - found[cell] if len(x) else x
            codes = np.column_stack([closest(left[:, p * wide : (p + 1) * wide], b) for p, b in enumerate(books)]).astype(np.uint8) if len(x) else np.zeros((0, parts), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "cell", "code"])

    id_type = rows.schema["id"].dataType.simpleString()
    coded = index.vectors.mapInArrow(code, f"id {id_type}, cell int, code binary")
    coded.write.mode("overwrite").parquet(f"{root}/coded")
    coded = spark.read.parquet(f"{root}/coded")
    sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))  # MOST_CELLS rows at most
    dealt = coded.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks()
        return pa.table({"cell": table.column("cell").slice(0, 1), "block": table.column("block").slice(0, 1),
                         "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "codes": [b"".join(table.column("code").to_pylist())]})

    dealt.groupBy("cell", "block").applyInArrow(pack, f"cell int, block int, ids array<{id_type}>, codes binary").write.mode("overwrite").parquet(f"{root}/blocks")
    return index


def open_index(spark: SparkSession, root: str) -> DenseIndex:
    found = [r.centre for r in spark.read.parquet(f"{root}/centres").orderBy("cell").collect()]
    books = spark.read.parquet(f"{root}/books").orderBy("part", "code").collect()
    return DenseIndex(spark, root, np.array(found), np.array([r.value for r in books]).reshape(books[-1].part + 1, CODES, -1))


def routed(index: DenseIndex, queries: DataFrame, probes: int, query_id: str = "query_id", vec: str = "vec") -> DataFrame:
    """(qid, cell, qvec): every query with each of its ``probes`` nearest cells."""
    asked = queries.select(F.col(query_id).alias("qid"), as_doubles(F.col(vec)).alias("vec")).where("qid IS NOT NULL AND vec IS NOT NULL")
    cells, kind = index.cells, asked.schema["qid"].dataType.simpleString()

    def route(batches):
        for batch in batches:
            x = unit_rows(batch.column(1))
            if not len(x):
                continue
            far = 0.5 * (cells * cells).sum(axis=1) - x @ cells.T
            near = np.argsort(far, axis=1, kind="stable")[:, :probes]
            row = np.repeat(np.arange(len(x)), near.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(near.ravel().astype(np.int32)), pa.array(list(x[row]), pa.list_(pa.float64()))],
                                             ["qid", "cell", "qvec"])

    return asked.mapInArrow(route, f"qid {kind}, cell int, qvec array<double>")


def search(index: DenseIndex, queries: DataFrame, k: int, probes: int = 16, keep: int = 8, query_id: str = "query_id", vec: str = "vec",
           exclude_self: bool = False) -> DataFrame:
    """(query_id, id, similarity, rank): of the ``probes`` nearest cells the ``keep * k`` rows of the best codes, the best ``k`` by cosine."""
    sent = routed(index, queries, probes, query_id, vec)
    q_type, id_type = sent.schema["qid"].dataType.simpleString(), index.vectors.schema["id"].dataType.simpleString()
    # queries of a cell travel in chunks, so a block is read once for many of them
    per_cell = sent.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK_QUERIES).alias("chunks"))
    chunked = sent.join(F.broadcast(per_cell), "cell").groupBy("cell", F.pmod(F.xxhash64("qid"), F.col("chunks")).alias("chunk")).agg(
        F.collect_list(F.struct("qid", "qvec")).alias("asked"))
    pairs = chunked.select("cell", F.col("asked.qid").alias("qids"), F.col("asked.qvec").alias("qvecs")).join(index.blocks, "cell")
    cells, books, need = index.cells, index.books, keep * k + int(exclude_self)

    def approximate(batches):
        parts, _, wide = books.shape
        for batch in batches:
            for r in range(batch.num_rows):
                ids, codes = batch.column(4)[r].values, np.frombuffer(batch.column(5)[r].as_py(), np.uint8).reshape(-1, parts)
                x = np.array(batch.column(2)[r].as_py())
                scores = np.repeat((x @ cells[batch.column(0)[r].as_py()])[:, None], len(codes), axis=1)
                for p in range(parts):
                    scores += (x[:, p * wide : (p + 1) * wide] @ books[p].T)[:, codes[:, p]]
                take = min(need, len(codes))
                best = np.argpartition(-scores, take - 1, axis=1)[:, :take]
                row = np.repeat(np.arange(len(x)), take)
                yield pa.RecordBatch.from_arrays([batch.column(1)[r].values.take(pa.array(row)), ids.take(pa.array(best.ravel())), pa.array(scores[row, best.ravel()])], ["qid", "id", "near"])

    coarse = pairs.select("cell", "qids", "qvecs", "block", "ids", "codes").mapInArrow(approximate, f"qid {q_type}, id {id_type}, near double")
    best = Window.partitionBy("qid").orderBy(F.desc("near"), "id")
    coarse = coarse.withColumn("place", F.row_number().over(best)).where(F.col("place") <= need)
    asked = queries.select(F.col(query_id).alias("qid"), as_doubles(F.col(vec)).alias("qvec"))
    if exclude_self:
        coarse = coarse.where(F.col("qid").cast("string") != F.col("id").cast("string"))
    full = coarse.join(index.vectors, "id").join(asked, "qid")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(F.col("vec"), F.col("vec"))) * F.sqrt(dot(F.col("qvec"), F.col("qvec")))
    exact = full.select("qid", "id", F.round(F.coalesce(F.try_divide(dot(F.col("vec"), F.col("qvec")), norm), F.lit(0.0)), SIM_DIGITS).alias("similarity"))
    last = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
    return exact.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select(F.col("qid").alias(query_id), "id", "similarity", "rank")


def through_index(work: Workspace, name: str = "cells", **options):
    """A search for ``TriageConfig.search`` and the neighbour operators: indexes the base, then searches it."""

    def find(queries, base, k, query_id="query_id", base_id="id", vec="vec", exclude_self=False):
        index = build(base, work.path(f"{name}-{base_id}-{k}"), base_id, vec)
        return search(index, queries, k, query_id=query_id, vec=vec, exclude_self=exclude_self, **options).withColumnRenamed("id", base_id)

    return find
