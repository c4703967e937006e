"""Exact top-k by integer inner product: tiled matrix products, selection in each tile, merging by tree.

Vectors are dealt to shards and queries to tiles of bounded size; both are packed into one row each. Every
tile meets every shard (the stated query set against all rows, in blocks), a task multiplies one pair of
matrices at a time and keeps each query's best k, and the lists are merged by a tree whose nodes join
``FAN`` lists, so no task ever sees more than ``FAN * k`` rows of a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Workspace

SHARD_BYTES = 4 << 20  # of a packed matrix
TILE_BYTES = 1 << 20
FAN = 16
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def quantise(vectors: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, vector``: every component x as floor(scale * x), a double that holds a whole number.

    Vectors that are null or empty or hold a null, NaN or infinite component take no part.
    """
    x = F.col(vector_col)
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf"))
    )
    # floor() of a double is a long and would clip; what it takes off is taken off the double instead
    def whole(v):
        y = v.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    return vectors.where(usable).select(F.col(id_col).alias("vec_id"), F.transform(x, whole).alias("vector"))


def _pack(rows: DataFrame, group: str, dims: str) -> DataFrame:
    """One row per (dimension, group): its row numbers, ids and the matrix of its vectors."""

    def kernel(table: pa.Table) -> pa.Table:
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({
            "dim": table.column(dims).slice(0, 1), group: table.column(group).slice(0, 1),
            f"{group}_rows": pa.array([table.column("row").to_pylist()], pa.list_(pa.int64())),
            f"{group}_ids": pa.array([table.column("vec_id").to_pylist()], pa.list_(pa.int64())),
            f"{group}_matrix": pa.array([np.ascontiguousarray(flat, np.float64).tobytes()], pa.binary()),
        })

    return rows.groupBy(dims, group).applyInArrow(
        kernel, f"dim int, {group} int, {group}_rows array<bigint>, {group}_ids array<bigint>, {group}_matrix binary"
    )


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows: exact, beyond the range of a long its nearest end."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in a], [[int(v) for v in row] for row in b]
    return np.array([[min(max(sum(map(int.__mul__, p, q)), LONG_MIN), LONG_MAX) for q in whole[1]] for p in whole[0]], np.int64)


def best_of_tile(scores, query_rows, rows, ids, k):
    """Positions (query, candidate) of every query's best k: higher score, smaller id, null ids last."""
    queries, candidates = [], []
    for q in range(len(query_rows)):
        s = scores[q]
        allowed = np.flatnonzero(rows != query_rows[q])
        if len(allowed) > k:
            part = s[allowed]
            least = np.partition(part, len(part) - k)[len(part) - k]
            allowed = allowed[part >= least]  # with all ties at the edge
        order = np.lexsort((rows[allowed], ids[allowed], -s[allowed].astype(np.float64), )) if np.abs(s[allowed]).max(initial=0) < 1 << 53 \
            else np.array(sorted(range(len(allowed)), key=lambda j: (-int(s[allowed[j]]), ids[allowed[j]], rows[allowed[j]])), int)
        kept = allowed[order[:k]]
        queries.append(np.full(len(kept), q))
        candidates.append(kept)
    return np.concatenate(queries or [np.zeros(0, int)]), np.concatenate(candidates or [np.zeros(0, int)])


def search(vectors: DataFrame, work: Workspace, k: int, is_query, shard_bytes: int = SHARD_BYTES, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows with the highest inner product for every row that
    satisfies ``is_query`` (a column over ``vec_id``), its own row left out; fewer if there are fewer.

    ``vectors`` has ``vec_id`` (long) and ``vector`` (see :func:`quantise`). Ties go to the smaller
    ``vec_id``, a null one last. Rows that repeat a ``vec_id`` are rows of their own: each is a candidate
    for the other and, if a query, has its own list. Vectors meet vectors of the same length only. Scores
    beyond a long take its nearest end. An empty table gives an empty result.
    """
    rows = work.stage("vectors", vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), "vector", F.size("vector").alias("dims"),
        F.monotonically_increasing_id().alias("row"), F.coalesce(is_query, F.lit(False)).alias("query"),
    ))
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n"), F.count_if("query").alias("q")).withColumns({
        "shards": F.ceil(F.col("n") * F.col("dims") * 8 / shard_bytes).cast("int"),
        "tiles": F.ceil(F.col("q") * F.col("dims") * 8 / tile_bytes).cast("int"),
    })
    placed = rows.join(sizes, "dims").where("tiles > 0")
    mixed = F.xxhash64("row")
    shards = _pack(placed.withColumn("shard", F.pmod(mixed, "shards").cast("int")), "shard", "dims")
    tiles = _pack(placed.where("query").withColumn("tile", F.pmod(mixed, "tiles").cast("int")), "tile", "dims")
    count = sizes.select(F.col("dims").alias("dim"), "shards", "tiles")
    pairs = (
        shards.join(count, "dim").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("shards", "tiles")
        .join(tiles.join(count, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards", "tiles"),
              ["dim", "shard", "tile"])
    )

    def multiply(batches):
        last = np.iinfo(np.int64).max
        for batch in batches:
            for r in range(batch.num_rows):
                at = {name: batch.column(i)[r] for i, name in enumerate(batch.schema.names)}
                dim = at["dim"].as_py()
                a = np.frombuffer(at["tile_matrix"].as_buffer(), np.float64).reshape(-1, dim)
                b = np.frombuffer(at["shard_matrix"].as_buffer(), np.float64).reshape(-1, dim)
                own = at["tile_rows"].values.to_numpy()
                theirs = at["shard_rows"].values.to_numpy()
                ids = at["shard_ids"].values.fill_null(last).to_numpy()
                real = at["shard_ids"].values
                for first in range(0, len(own), 512):  # a strip of the tile: scores of 512 queries at once
                    s = products(a[first : first + 512], b)
                    q, c = best_of_tile(s, own[first : first + 512], theirs, ids, k)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(q), at["shard"].as_py(), np.int32)), pa.array(own[first + q]),
                        at["tile_ids"].values.take(pa.array(first + q)), pa.array(theirs[c]), real.take(pa.array(c)), pa.array(s[q, c]),
                    ], ["node", "query_row", "query_id", "row", "vec_id", "score"])

    lists = pairs.select("dim", "shard", "tile", "tile_rows", "tile_ids", "tile_matrix", "shard_rows", "shard_ids", "shard_matrix").mapInArrow(
        multiply, "node int, query_row bigint, query_id bigint, row bigint, vec_id bigint, score bigint"
    )
    nodes = sizes.agg(F.max("shards")).first()[0] or 1
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("row")]
    while True:
        nodes = -(-nodes // FAN)
        lists = lists.withColumn("node", F.floor(F.col("node") / FAN).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_row", "node").orderBy(*order))).where(F.col("rank") <= k)
        if nodes <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
