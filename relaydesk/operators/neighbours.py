"""Exact nearest neighbours by cosine, label votes, centroids and their blend.

Vectors are ``array<double>``. The search is a blocked matrix product: base and queries are each
packed once into blocks of unit vectors and stored, every pair of blocks meets in a Cartesian
product that moves no vector, and a task hands out the best ``k`` of every query over all its
blocks. For a large base ``nearest_pruned`` makes the blocks Voronoi cells around sampled
pivots and a query visits only the cells that can still hold one of its ``k`` neighbours
(pivot-based k-NN join, Lu et al., VLDB 2012), which keeps the result exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine
from ..sources.workspace import Workspace

PACK_ROWS = 4096  # of a packed block
PACK_BYTES = 8 << 20  # of its vectors, before they are compressed, if it has several rows
PART_ROWS = 32_768  # of a file of packed blocks
TILE_QUERIES = 256  # whose similarities to a block are held at once
PIECE_PAIRS = 8192  # scored again at once
BLOCK_ROWS = 16_384
CHUNK_ROWS = 16_384
MIN_CHUNK_ROWS = 256
MAX_CENTROIDS = 10_000
SIM_DIGITS = 9  # similarities closer than this count as ties and go to the lower id
EPS = 1e-6


def as_doubles(c: Column) -> Column:
    return c.cast("array<double>")


def _chunk_no(id_col: str, n: Column, at_least: Column) -> Column:
    """Chunk number by hash for ``n`` queries: no chunk above the row bound, and ``at_least`` so
    many chunks while they stay worth a task."""
    chunks = F.greatest(
        F.ceil(n / F.lit(CHUNK_ROWS)),
        F.least(at_least, F.ceil(n / F.lit(MIN_CHUNK_ROWS))),
        F.lit(1).cast("bigint"),
    )
    return F.pmod(F.xxhash64(id_col), chunks)


def _unit_rows(col) -> np.ndarray:
    """Vectors of a pandas column as rows of unit length, zero ones as they are; one matrix of the group's size."""
    return _to_unit(np.vstack(col.to_numpy()).astype(np.float64, copy=False))


def _to_unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length in place, zero ones as they are."""
    for lo in range(0, len(m), 2048):
        part = m[lo:lo + 2048]
        n = np.sqrt((part * part).sum(axis=1, keepdims=True))
        np.divide(part, n, out=part, where=n > 0)
        part[~(n > 0)[:, 0]] = 0.0
    return m


def _search_blocks(routed: DataFrame, blocks: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Best ``k`` of every query within every (chunk, block) pair that was routed together.

    ``routed`` is (chunk, block, qid, qvec), ``blocks`` is (block, bid, bvec).
    """
    q_type, b_type = routed.schema["qid"].dataType, blocks.schema["bid"].dataType
    schema = T.StructType([
        T.StructField("qid", q_type), T.StructField("bid", b_type), T.StructField("sim", T.DoubleType()),
    ])
    wanted = routed.select("chunk", "block").distinct()
    spread = blocks.join(wanted, "block").select(
        F.col("chunk").alias("to_chunk"), F.col("block").alias("to_block"), "bid", "bvec"
    )
    digits, unit_in_last = SIM_DIGITS, 10.0 ** -SIM_DIGITS
    tile_queries, tile_rows = 512, 2048  # one tile of similarities stays in cache

    def search(left, right):
        import numpy as np
        import pandas as pd

        if len(left) == 0 or len(right) == 0:
            none = np.empty(0, dtype=object)
            return pd.DataFrame({"qid": none, "bid": none, "sim": np.zeros(0)})

        right = right.sort_values("bid", kind="stable").reset_index(drop=True)
        base, base_ids = _unit_rows(right["bvec"]), right["bid"].to_numpy()
        query_ids = left["qid"].to_numpy()
        queries = _unit_rows(left["qvec"])
        own = None
        if exclude_self:
            position = {b: i for i, b in enumerate(base_ids)}
            own = np.array([position.get(q, -1) for q in query_ids])
        take = min(k, len(base_ids))
        out_q, out_b, out_s = [], [], []
        for start in range(0, len(query_ids), tile_queries):
            rows = queries[start:start + tile_queries]
            # base rows come in id order, so a later tile has to beat the k-th value outright
            kth = np.full(len(rows), -np.inf)
            row = col = np.empty(0, dtype=np.int64)
            val = np.empty(0)
            for lo in range(0, len(base), tile_rows):
                sims = rows @ base[lo:lo + tile_rows].T
                if own is not None:
                    mine = own[start:start + tile_queries] - lo
                    hit = np.nonzero((mine >= 0) & (mine < sims.shape[1]))[0]
                    sims[hit, mine[hit]] = -np.inf
                bar = kth + 0.499 * unit_in_last
                if lo == 0 and take < sims.shape[1]:
                    bar = np.partition(sims, -take, axis=1)[:, -take] - unit_in_last
                better = np.flatnonzero(sims > bar[:, None])
                if len(better) == 0:
                    continue
                r, c = np.divmod(better, sims.shape[1])
                row = np.concatenate([row, r])
                val = np.concatenate([val, np.round(sims[r, c], digits)])
                col = np.concatenate([col, c + lo])
                order = np.lexsort((col, -val, row))
                row, col, val = row[order], col[order], val[order]
                place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
                last = place == take - 1
                kth[row[last]] = val[last]
                keep = place < take
                row, col, val = row[keep], col[keep], val[keep]
            out_q.append(query_ids[start + row])
            out_b.append(base_ids[col])
            out_s.append(val)
        return pd.DataFrame({"qid": np.concatenate(out_q), "bid": np.concatenate(out_b),
                             "sim": np.concatenate(out_s)})

    return (
        routed.groupBy("chunk", "block")
        .cogroup(spread.groupBy("to_chunk", "to_block"))
        .applyInPandas(search, schema)
    )


def _best(hits: DataFrame, k: int) -> DataFrame:
    """Merge block results: the ``k`` best of every query, ties to the lower id."""
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "bid")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _named(hits: DataFrame, qid: str, bid: str) -> DataFrame:
    return hits.select(
        F.col("qid").alias(qid), F.col("bid").alias(bid), F.col("sim").alias("similarity"), "rank"
    )


def _packed(rows: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Rows (id, vec) as stored blocks (no, ids, own, vecs) of unit vectors in the order of their ids within a block.

    Rows of one id are in one file; ``own`` marks one of them.
    """

    def kernel(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        seen = set()
        for batch in batches:
            ids, vec = batch.columns
            sizes = pc.unique(pc.list_value_length(vec)).to_pylist()
            if len(sizes) > 1 or None in sizes:
                raise ValueError("vectors have to be of one length and not null")
            most = max(1, min(PACK_ROWS, PACK_BYTES // (8 * max([1, *sizes]))))
            for part in np.array_split(np.arange(batch.num_rows), -(-batch.num_rows // most) or 1):
                if len(part) == 0:
                    continue
                some = batch.slice(part[0], len(part))
                some = some.take(pc.sort_indices(some.column(0)))
                own = []
                for x in some.column(0).to_pylist():
                    own.append(x not in seen)
                    seen.add(x)
                m = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), sizes[0])
                ends = pa.array([0, len(part)], pa.int32())
                packed = pa.compress(_to_unit(m).tobytes(), codec="zstd", asbytes=True)
                lists = [pa.ListArray.from_arrays(ends, x) for x in (some.column(0), pa.array(own, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([m.nbytes]), pa.array([packed], pa.binary())], ["ids", "own", "size", "vecs"])

    slots = rows.sparkSession.sparkContext.defaultParallelism
    n = rows.count()
    files = max(-(-n // PART_ROWS), min(-(-n // MIN_CHUNK_ROWS), int(np.ceil(np.sqrt(2 * slots)))), 1)
    kind = rows.schema["id"].dataType.simpleString()
    blocks = rows.repartition(files, "id").mapInArrow(kernel, f"ids array<{kind}>, own array<boolean>, size bigint, vecs binary")
    return work.stage(name, blocks.withColumn("no", F.monotonically_increasing_id()), "zstd")


def _exact_values(q: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Inner products of some rows of ``q`` with rows of ``b``, in whole where they are many."""
    if len(row) * 16 > len(q) * len(b):
        return (q @ b.T)[row, col]
    pieces = [slice(i, i + PIECE_PAIRS) for i in range(0, len(row), PIECE_PAIRS)]
    return np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", q[row[p]], b[col[p]]) for p in pieces]])


class _Chunk:
    """Queries, and the best ``k`` rows of each in the blocks they have met so far."""

    def __init__(self, ids, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.single = vectors.astype(np.float32)
        self.best = np.full((len(vectors), k), -np.inf)  # similarities, the least first
        self.kept: list = []  # of a block: query, similarity, id of the row

    def meet(self, ids, vectors: np.ndarray, own: np.ndarray | None = None) -> None:
        """``ids`` are in order; ``own`` is the row of the block that each query must not find, or -1."""
        n, k = len(vectors), min(self.k, len(vectors))
        single = vectors.astype(np.float32)
        slack = (vectors.shape[1] + 8) * 2.0 ** -22  # more than the single-precision product can be off
        for start in range(0, len(self.vectors), TILE_QUERIES):
            rows = slice(start, start + TILE_QUERIES)
            near = self.single[rows] @ single.T
            if own is not None:
                mine = np.flatnonzero(own[rows] >= 0)
                near[mine, own[rows][mine]] = -np.inf
            kth = self.best[rows, 0]
            bar = kth - slack
            if k < n and not np.isfinite(kth).all():
                bar = np.maximum(bar, np.partition(near, n - k, axis=1)[:, n - k] - 2 * slack)
            row, col = np.divmod(np.flatnonzero(near >= np.maximum(bar, -2.0).astype(np.float32)[:, None]), n)
            if len(row) == 0:
                continue
            value = np.round(_exact_values(self.vectors[rows], vectors, row, col), SIM_DIGITS)
            reached = value >= kth[row]  # ties of blocks are settled by their ids later
            row, col, value = row[reached], col[reached], value[reached]
            order = np.lexsort((col, -value, row))
            row, col, value = row[order], col[order], value[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, col, value, place = (x[place < k] for x in (row, col, value, place))
            more = np.full((len(kth), self.k), -np.inf)
            more[row, place] = value
            self.best[rows] = np.sort(np.concatenate([self.best[rows], more], axis=1), axis=1)[:, self.k:]
            self.kept.append((row + start, value, ids.take(col)))

    def found(self):
        """(query, similarity, row) of the best ``k`` and of rows as good as the last of them, a block after the other."""
        for row, value, ids in self.kept:
            good = value >= self.best[row, 0]
            yield self.ids.take(row[good]), ids.filter(good), value[good]


def _search_packed(chunks: DataFrame, blocks: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """(qid, bid, sim): the best ``k`` of every query among the blocks of a task."""
    schema = T.StructType([
        T.StructField("qid", chunks.schema["ids"].dataType.elementType),
        T.StructField("bid", blocks.schema["ids"].dataType.elementType), T.StructField("sim", T.DoubleType()),
    ])

    def kernel(batches):
        import numpy as np
        import pyarrow as pa

        def vectors(size, packed, n):
            raw = pa.decompress(packed.as_buffer(), decompressed_size=size.as_py(), codec="zstd") if size.as_py() else b""
            return np.frombuffer(raw, np.float64, count=size.as_py() // 8).reshape(n, -1 if size.as_py() else 0)

        def found(chunk):
            for qids, bids, value in chunk.found() if chunk else ():
                yield pa.RecordBatch.from_arrays([qids, bids, pa.array(value)], schema.names)

        at, chunk, names = None, None, []
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            for r in range(batch.num_rows):
                if column["no"][r].as_py() != at:
                    yield from found(chunk)
                    at, qids = column["no"][r].as_py(), column["qids"][r].values
                    chunk = _Chunk(qids, vectors(column["q_size"][r], column["q_vecs"][r], len(qids)), k)
                    names = qids.to_pylist() if exclude_self else []
                bids, own = column["ids"][r].values, None
                if exclude_self:
                    marked = column["own"][r].values.to_pylist()
                    place = {x: i for i, x in enumerate(bids.to_pylist()) if marked[i]}
                    own = np.array([place.get(x, -1) for x in names])
                chunk.meet(bids, vectors(column["size"][r], column["vecs"][r], len(bids)), own)
        yield from found(chunk)

    asked = chunks.select("no", F.col("ids").alias("qids"), F.col("size").alias("q_size"), F.col("vecs").alias("q_vecs"))
    return asked.crossJoin(blocks.select("ids", "own", "size", "vecs")).mapInArrow(kernel, schema)


class PackedSearch:
    """:func:`nearest` for several searches: a base is packed once, and so are the queries of searches in a row.

    The packed queries of other searches are overwritten, so these have to be done.
    """

    def __init__(self, work: Workspace):
        self._work, self._bases, self._asked = work, [], None

    def __call__(self, queries: DataFrame, base: DataFrame, k: int, query_id: str = "query_id",
                 base_id: str = "id", vec: str = "vec", exclude_self: bool = False) -> DataFrame:
        blocks = next((p for b, key, p in self._bases if b is base and key == (base_id, vec)), None)
        if blocks is None:
            rows = base.select(F.col(base_id).alias("id"), as_doubles(F.col(vec)).alias("vec"))
            blocks = _packed(rows, self._work, f"base-{len(self._bases)}")
            self._bases.append((base, (base_id, vec), blocks))
        if self._asked is None or self._asked[0] is not queries or self._asked[1] != (query_id, vec):
            rows = queries.select(F.col(query_id).alias("id"), as_doubles(F.col(vec)).alias("vec"))
            self._asked = (queries, (query_id, vec), _packed(rows, self._work, "queries"))
        hits = _search_packed(self._asked[2], blocks, k, exclude_self)
        return _named(_best(hits, k), query_id, base_id)


def nearest(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    query_id: str = "query_id",
    base_id: str = "id",
    vec: str = "vec",
    exclude_self: bool = False,
) -> DataFrame:
    """(query_id, base_id, similarity, rank) of the ``k`` nearest base rows of every query."""
    return PackedSearch(Workspace(queries.sparkSession))(queries, base, k, query_id, base_id, vec, exclude_self)


def nearest_pruned(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    query_id: str = "query_id",
    base_id: str = "id",
    vec: str = "vec",
    exclude_self: bool = False,
    pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """As :func:`nearest`, visiting only cells that can hold a neighbour. Same result.

    ``pivots`` rows, 512 unless given, are read by the driver; they and the per-cell sizes and radii
    are the only data that leave the executors. A large cell is cut by id into blocks of ``block_rows`` rows; in a base
    with enough rows for all slots blocks grow, up to ``BLOCK_ROWS``, as a query is sent to every block of a cell it
    visits. Zero vectors form their own cell, whose similarity to anything is 0.
    """
    q = queries.select(F.col(query_id).alias("qid"), as_doubles(F.col(vec)).alias("qvec"))
    b = base.select(F.col(base_id).alias("bid"), as_doubles(F.col(vec)).alias("bvec"))
    if pivots is None:
        pivots = 512
    sample = b.orderBy(F.xxhash64("bid", F.lit(7))).limit(pivots).select("bvec").collect()
    sc = queries.sparkSession.sparkContext
    pivot_rows = sc.broadcast([row["bvec"] for row in sample])

    def assign(batches):
        import numpy as np
        import pandas as pd

        p = np.array(pivot_rows.value, dtype=np.float64)
        n = np.sqrt((p * p).sum(axis=1, keepdims=True))
        p = np.divide(p, n, out=np.zeros_like(p), where=n > 0)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            m = np.vstack(pdf["bvec"].to_numpy()).astype(np.float64)
            n = np.sqrt((m * m).sum(axis=1))
            unit = np.divide(m, n[:, None], out=np.zeros_like(m), where=n[:, None] > 0)
            sims = unit @ p.T
            cell = sims.argmax(axis=1)
            angle = np.arccos(np.clip(sims[np.arange(len(cell)), cell], -1.0, 1.0))
            zero = n == 0
            cell[zero], angle[zero] = -1, 0.0
            yield pd.DataFrame({"bid": pdf["bid"].to_numpy(), "bvec": pdf["bvec"].to_numpy(),
                                "cell": cell, "angle": angle})

    cell_schema = T.StructType([*b.schema.fields, T.StructField("cell", T.LongType()),
                                T.StructField("angle", T.DoubleType())])
    placed = b.mapInPandas(assign, cell_schema)
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()
    per_slot = -(-sum(r["n"] for r in stats) // sc.defaultParallelism)
    rows = max(block_rows, min(per_slot, BLOCK_ROWS))
    cells = sc.broadcast(
        [(r["cell"], r["n"], r["radius"], -(-r["n"] // rows)) for r in sorted(stats, key=lambda r: r["cell"])]
    )
    subs = F.lit(1).cast("bigint")
    for cell, _, _, parts in cells.value:
        if parts > 1:
            subs = F.when(F.col("cell") == cell, F.lit(parts).cast("bigint")).otherwise(subs)
    blocks = placed.select(
        (F.shiftleft("cell", 32) + F.pmod(F.xxhash64("bid"), subs)).alias("block"), "bid", "bvec"
    )
    need = k + int(exclude_self)
    eps = EPS

    def route(home_only: bool):
        def send(batches):
            import numpy as np
            import pandas as pd

            p = np.array(pivot_rows.value, dtype=np.float64)
            n = np.sqrt((p * p).sum(axis=1, keepdims=True))
            p = np.divide(p, n, out=np.zeros_like(p), where=n > 0)
            table = cells.value
            size = np.array([t[1] for t in table])
            numbers = [(t[0] << 32) + np.arange(t[3], dtype=np.int64) for t in table]
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                m = np.vstack(pdf["qvec"].to_numpy()).astype(np.float64)
                n = np.sqrt((m * m).sum(axis=1))
                unit = np.divide(m, n[:, None], out=np.zeros_like(m), where=n[:, None] > 0)
                angles = np.arccos(np.clip(unit @ p.T, -1.0, 1.0))
                bound = np.zeros((len(pdf), len(table)))
                for j, (cell, _, radius, _) in enumerate(table):
                    if cell >= 0:
                        bound[:, j] = np.cos(np.maximum(0.0, angles[:, cell] - radius - eps))
                bound[n == 0] = 0.0
                # home: the most promising cells that together hold enough rows
                order = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(size[order], axis=1) - size[order]
                home = np.zeros_like(bound, dtype=bool)
                np.put_along_axis(home, order, before < need, axis=1)
                if home_only:
                    chosen = home
                else:
                    chosen = (bound >= pdf["kth"].fillna(-2.0).to_numpy()[:, None] - eps) & ~home
                lists = [np.concatenate([numbers[j] for j in np.flatnonzero(c)] or [np.empty(0, np.int64)]) for c in chosen]
                yield pd.DataFrame({"blocks": lists, "qid": pdf["qid"].to_numpy(), "qvec": pdf["qvec"].to_numpy()})
        return send

    # a query leaves Python once, with the blocks it is sent to
    routed_schema = T.StructType([T.StructField("blocks", T.ArrayType(T.LongType())), *q.schema.fields])

    def visit(df: DataFrame, home_only: bool) -> DataFrame:
        """Search the blocks the queries are sent to, in chunks sized by each block's own queries."""
        sent = df.mapInPandas(route(home_only), routed_schema).select(F.explode("blocks").alias("block"), "qid", "qvec")
        sizes = sent.groupBy("block").agg(F.count("*").alias("n"))
        chunked = sent.join(sizes, "block").select(
            _chunk_no("qid", F.col("n"), F.lit(1).cast("bigint")).alias("chunk"), "block", "qid", "qvec"
        )
        return _search_blocks(chunked, blocks, k, exclude_self)

    home = _best(visit(q, True), k)
    kth = home.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("sim")).alias("kth"))
    others = visit(q.join(kth, "qid", "left"), False)
    return _named(_best(home.select("qid", "bid", "sim").unionByName(others), k), query_id, base_id)


def one_query_top_k(base: DataFrame, query_vec: list[float], k: int, base_id: str = "id", vec: str = "vec") -> DataFrame:
    """The ``k`` most similar base rows to one query vector."""
    q = F.array(*[F.lit(float(x)) for x in query_vec])
    return (
        base.select(base_id, F.round(cosine(as_doubles(F.col(vec)), q), SIM_DIGITS).alias("similarity"))
        .orderBy(F.desc("similarity"), base_id)
        .limit(k)
    )


def centroids(examples: DataFrame, label: str = "label", vec: str = "vec") -> DataFrame:
    """Element-wise mean vector per label."""
    return examples.groupBy(label).agg(
        vector_to_array(Summarizer.mean(array_to_vector(as_doubles(F.col(vec))))).alias("centroid")
    )


def centroid_scores(df: DataFrame, cents: DataFrame, vec: str = "vec", label: str = "label",
                    out: str = "centroid_scores") -> DataFrame:
    """Adds an array of (label, score) against every class centroid, in label order.

    The class centroids travel as one value, not as a join side. More than ``MAX_CENTROIDS``
    labels are refused: every row gets a score per label, so an output of that width is no
    classification any more.
    """
    kept = F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col("centroid"))))
    refused = F.raise_error(F.lit(f"more than {MAX_CENTROIDS} labels"))
    one_row = cents.limit(MAX_CENTROIDS + 1).agg(
        F.when(F.count("*") <= MAX_CENTROIDS, kept).otherwise(refused).alias("c")
    )
    scored = F.transform(
        F.col("__c"),
        lambda c: F.struct(c["label"].alias("label"),
                           cosine(as_doubles(F.col(vec)), c["centroid"]).alias("score")),
    )
    return df.withColumn("__c", one_row.scalar()).withColumn(out, scored).drop("__c")


def label_votes(neighbours: DataFrame, labels: DataFrame, query_id: str = "query_id", base_id: str = "id",
                label: str = "label") -> DataFrame:
    """Similarity-weighted vote per label among the neighbours of every query."""
    return (
        neighbours.join(labels.select(base_id, label), base_id)
        .groupBy(query_id, label)
        .agg(F.sum("similarity").alias("vote"))
    )


def blend_scores(votes: Column, cents: Column) -> Column:
    """0.6 x vote (scaled by the best vote) + 0.4 x centroid score, normalised to sum 1.

    ``votes`` and ``cents`` are arrays of (label, vote) and (label, score); the centroids cover
    every label. With a best vote of 0 the votes are left out, and a total that is not positive
    is left as it is.
    """
    best = F.array_max(F.transform(votes, lambda v: v["vote"]))

    def combined(c):
        vote = F.aggregate(
            F.filter(votes, lambda v: v["label"] == c["label"]), F.lit(0.0), lambda acc, v: acc + v["vote"]
        )
        return F.struct(
            c["label"].alias("label"),
            (0.6 * F.coalesce(F.try_divide(vote, best), F.lit(0.0)) + 0.4 * c["score"]).alias("score"),
        )

    return F.transform(cents, combined)


def normalised(scores: Column) -> Column:
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s["score"])
    return F.transform(
        scores,
        lambda s: F.struct(
            s["label"].alias("label"),
            F.when(total > 0, F.try_divide(s["score"], total)).otherwise(s["score"]).alias("score"),
        ),
    )


def classify_blend(
    queries: DataFrame,
    examples: DataFrame,
    k: int = 5,
    query_id: str = "query_id",
    base_id: str = "id",
    label: str = "label",
    vec: str = "vec",
    exclude_self: bool = True,
    search=nearest,
) -> DataFrame:
    """Adds intent, intent_confidence and intent_all_scores to ``queries`` from (id, label, vec) examples."""
    near = search(queries, examples, k, query_id, base_id, vec, exclude_self)
    votes = (
        label_votes(near, examples, query_id, base_id, label)
        .groupBy(query_id)
        .agg(F.collect_list(F.struct(F.col(label).alias("label"), "vote")).alias("__votes"))
    )
    scored = centroid_scores(queries, centroids(examples, label, vec), vec, label, "__cents").join(
        votes, query_id, "left"
    )
    no_votes = F.array().cast(votes.schema["__votes"].dataType)
    blended = scored.withColumn("__scores", blend_scores(F.coalesce("__votes", no_votes), F.col("__cents")))
    blended = blended.withColumn("__scores", normalised(F.col("__scores")))
    best = F.array_max(F.transform("__scores", lambda s: s["score"]))
    winner = F.get(F.filter("__scores", lambda s: s["score"] == best), F.lit(0))
    return (
        blended.withColumn("intent", winner["label"])
        .withColumn("intent_confidence", F.round(winner["score"], 4))
        .withColumn(
            "intent_all_scores",
            F.map_from_entries(
                F.transform("__scores", lambda s: F.struct(s["label"], F.round(s["score"], 4)))
            ),
        )
        .drop("__cents", "__votes", "__scores")
    )


def retrieve_cases(
    queries: DataFrame,
    kb: DataFrame,
    top_k: int = 3,
    query_id: str = "query_id",
    vec: str = "vec",
    exclude_self: bool = True,
    search=nearest,
) -> DataFrame:
    """(query_id, retrieved_cases): the ``top_k`` cases, most similar first.

    ``kb`` is (id, customer_query, support_response, vec).
    """
    near = search(queries, kb, top_k, query_id, "id", vec, exclude_self)
    return (
        near.join(kb.select("id", "customer_query", "support_response"), "id")
        .groupBy(query_id)
        .agg(
            F.array_sort(F.collect_list(F.struct(
                "rank", "customer_query", "support_response",
                F.round("similarity", 4).alias("similarity"), "id",
            ))).alias("cases")
        )
        .select(
            query_id,
            F.transform("cases", lambda c: F.struct(
                c["customer_query"].alias("customer_query"),
                c["support_response"].alias("support_response"),
                c["similarity"].alias("similarity"),
                c["id"].alias("id"),
            )).alias("retrieved_cases"),
        )
    )


def pair_similarity(pairs: DataFrame, left: str, right: str, out: str = "similarity") -> DataFrame:
    return pairs.withColumn(out, cosine(as_doubles(F.col(left)), as_doubles(F.col(right))))
