"""Ranked lexical search without a document index: an Aho-Corasick scan counts the items' terms in every text.

The terms of all items stand in one automaton, each between two guards. In a text every byte that is no term
character becomes a guard as well, so a term is found only where it is a whole term of the text, and one run of
the automaton over the text gives the number of times each item term occurs. What it gives (per document its
length and its counted item terms) is written once; document frequencies come from it by one aggregation, and a
second pass over these counts adds up scores and keeps each item's best documents of its task.

The automaton and the weights are sent to all tasks, so items are dealt in blocks of at most ``BLOCK_BYTES``,
and every block scans the documents. All sums are whole numbers below 2**53, so doubles hold them exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Workspace, text_pieces

BLOCK_BYTES = 8 << 20  # of the terms and items that one automaton holds
TERM_COST, ITEM_COST = 64, 2048  # bytes counted for a term of an item beside its text, and for an item
MOST_TERMS = 100_000  # of one item
SCORE_CELLS = 1 << 21  # of the matrix of scores that a task holds
MERGE_SALTS = 32
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GUARD = 0x20
# what a byte of a text becomes: term characters in lower case, guards for all others
FOLDED = np.full(256, GUARD, np.uint8)
for _first, _last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    FOLDED[_first : _last + 1] = np.arange(_first, _last + 1)
FOLDED[0x41:0x5B] = np.arange(0x61, 0x7B)


def terms(text: Column) -> Column:
    """The terms of a text in order; only A-Z are put in lower case."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERMS), F.lit(0))


def _blocks(wanted: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """``wanted`` with the block of every item, and the number of blocks: none is larger than allowed."""
    sizes = wanted.groupBy("item_id").agg((F.sum(F.octet_length("term") + TERM_COST) + ITEM_COST).alias("bytes"), F.count("*").alias("n"))
    total, largest, most = sizes.agg(F.sum("bytes"), F.max("bytes"), F.max("n")).first()
    if most and (most > MOST_TERMS or largest > block_bytes):
        raise ValueError(f"an item of {most} terms and {largest} bytes is too large to search for")
    n = 1 if (total or 0) <= block_bytes else -(-2 * total // block_bytes)
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int")
        fullest = sizes.groupBy(block.alias("block")).agg(F.sum("bytes").alias("bytes")).agg(F.max("bytes")).first()[0]
        if (fullest or 0) <= block_bytes:
            return wanted.withColumn("block", block), n
        n *= 2


class _Block:
    """Terms of some items by number, and for each term its items."""

    def __init__(self, rows):
        rows = sorted(((r.item_id, r.term) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        self.terms = sorted({t for _, t in rows})
        number = {t: k for k, t in enumerate(self.terms)}
        self.items = list(dict.fromkeys(i for i, _ in rows))
        item = {i: k for k, i in enumerate(self.items)}
        pairs = sorted((number[t], item[i]) for i, t in rows)
        self.of = np.array([i for _, i in pairs], np.int64)  # items, term by term
        self.at = np.searchsorted([t for t, _ in pairs], np.arange(len(self.terms) + 1))


def _scan(rows: DataFrame, words: list[str]) -> DataFrame:
    """``doc_id, n, term, tf``: length of each text in terms, and the numbers and counts of the item terms in it."""

    def kernel(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, word in enumerate(words):
            automaton.add_word(f" {word} ", k)
        automaton.make_automaton()
        for batch in batches:
            lengths, sizes, found, counts = [], [], [], []
            for first, last, buffer, at in text_pieces(batch.column(1)):
                folded = FOLDED[buffer]
                inside = folded != GUARD
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                edges = at[:-1][at[:-1] < len(folded)]
                begins[edges] = inside[edges]
                lengths.append(np.diff(np.concatenate([[0], np.cumsum(begins)])[at]))
                data = folded.tobytes()
                hits, per_row = [], []
                for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
                    before = len(hits)
                    hits.extend([k for _, k in automaton.iter(f" {data[a:z].decode(errors='replace')} ")])
                    per_row.append(len(hits) - before)
                keys, tf = np.unique(np.repeat(np.arange(len(per_row)), per_row) * len(words) + np.array(hits, np.int64), return_counts=True)
                sizes.append(np.bincount(keys // len(words), minlength=len(per_row)))
                found.append(keys % len(words))
                counts.append(tf)
            if not lengths:
                continue
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v).astype(kind))) for v, kind in ((found, np.int32), (counts, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(lengths).astype(np.int64)), *lists], ["doc_id", "n", "term", "tf"])

    return rows.mapInArrow(kernel, "doc_id bigint, n bigint, term array<int>, tf array<bigint>")


def _score(counted: DataFrame, block: _Block, weights: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    """``item, doc_id, score``: of every task the best k documents of each item."""
    items, of, starts = len(block.items), block.of, block.at

    def kernel(batches):
        scores, ids, unknown, owner = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        floor = np.zeros(items)  # score that a document must reach to be among the best k so far
        waiting: list[tuple] = []

        def merged(parts):
            s, i, u, o = (np.concatenate([p[j] for p in parts]) for j in range(4))
            order = np.lexsort((i, u, -s, o))
            grouped = o[order]
            kept = order[np.arange(len(o)) - np.searchsorted(grouped, grouped) < k]
            s, i, u, o = s[kept], i[kept], u[kept], o[kept]
            full = np.flatnonzero(np.bincount(o, minlength=items) >= k)
            floor[full] = s[np.searchsorted(o, full) + k - 1]
            return s, i, u, o

        for batch in batches:
            column = batch.column(0)
            doc_null = column.is_null().to_numpy(zero_copy_only=False)
            doc = column.fill_null(0).to_numpy()
            n = batch.column(1).to_numpy()
            sizes = np.diff(batch.column(2).offsets.to_numpy()).astype(np.int64)
            term, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(sizes)])
            m = 100 - 90 + (90 * n * n_docs) // length
            step = max(1, SCORE_CELLS // items)
            for first in range(0, len(n), step):
                last = min(first + step, len(n))
                cut = slice(at[first], at[last])
                t, row = term[cut], np.repeat(np.arange(last - first), sizes[first:last])
                part = weights[t] * ((1_000_000_000 * tf[cut]) // (1000 * tf[cut] + 8 * m[first + row]))
                fan = starts[t + 1] - starts[t]
                which = np.repeat(starts[t] - np.concatenate([[0], np.cumsum(fan)[:-1]]), fan) + np.arange(fan.sum())
                cells = np.bincount(np.repeat(row, fan) * items + of[which], weights=np.repeat(part, fan), minlength=(last - first) * items)
                cells = cells.reshape(last - first, items)
                r, o = np.nonzero((cells >= floor) & (cells > 0))
                waiting.append((cells[r, o], doc[first + r], doc_null[first + r], o))
                if sum(len(w[0]) for w in waiting) > SCORE_CELLS // 4 or floor.min(initial=0) == 0:
                    scores, ids, unknown, owner = merged([(scores, ids, unknown, owner), *waiting])
                    waiting = []
        if waiting:
            scores, ids, unknown, owner = merged([(scores, ids, unknown, owner), *waiting])
        for first in range(0, len(owner), 10_000):
            cut = slice(first, first + 10_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner[cut].astype(np.int32)), pa.array(ids[cut], mask=unknown[cut]), pa.array(scores[cut].astype(np.int64))], ["item", "doc_id", "score"])

    return counted.mapInArrow(kernel, "item int, doc_id bigint, score bigint")


def rank(docs: DataFrame, items: DataFrame, work: Workspace, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above 0.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``; ids are whole numbers and other columns are
    not read. Null and empty texts have no terms: such documents are never found, such items find nothing.
    Rows of one ``item_id``, also a null one, are one item with the terms of all. Repeated or null document
    ids are ranked row by row, null ones last among equals. Empty tables give no rows. An item of more than
    ``MOST_TERMS`` terms or larger than a block is refused.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = items.select(F.col("item_id"), F.explode(terms(F.col("text").cast("string"))).alias("term")).distinct()
    wanted, n_blocks = _blocks(work.stage("item_terms", wanted), block_bytes)
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for b in range(n_blocks):
        block = _Block(wanted.where(F.col("block") == b).select("item_id", "term").collect())  # block_bytes at most
        if not block.terms:
            continue
        counted = work.stage(f"counted-{b}", _scan(rows, block.terms))
        n_docs, length = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not length:
            continue
        weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.count("*") + 1).cast("double"))).cast("double")
        weights = np.zeros(len(block.terms))
        for r in counted.select(F.explode("term").alias("term")).groupBy("term").agg(weight.alias("w")).collect():  # one row per term of the block
            weights[r.term] = r.w
        found = _score(counted.where("n > 0"), block, weights, n_docs, length, k)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGE_SALTS))
        for keys in (["item", "salt"], ["item"]):  # lists of many tasks are merged by a tree of two levels
            found = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        names = work.spark.createDataFrame(list(enumerate(block.items)), f"item int, item_id {kind}")
        # one row per item of the block, so small enough to send everywhere
        told = found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = told if out is None else out.union(told)
    return out if out is not None else work.spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
