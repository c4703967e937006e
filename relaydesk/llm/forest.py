"""Near-duplicate join on word shingles: a MinHash LSH forest, then exact Jaccard similarity.

1. A text is its set of ``words``-word shingles. Equal sets form one class with a count of its documents,
   however many; one document stands for it from here on.
2. The class has a MinHash signature of ``trees`` times ``depth`` values. In every tree the signatures are
   sorted as a trie; two classes are candidates if they share a prefix, that is a node. The matched prefix
   starts at the full depth and is shortened by one value at a time. Each step meets the members of different
   children of a node; those of one child have met at the step before.
3. Two members of a node are linked loosely if so many values of their whole signatures are equal that a pair
   at the threshold falls below with probability ``LOST`` only. The least alike of the pairs found that look
   to be at the threshold or above decides on the next step: shortening ends once a pair of its similarity is
   met with probability ``recall``. Without any it goes on, at most until that holds for every pair at the threshold.
   Components of the loose links hold all pairs that can be above the threshold, and almost only those.
4. Per component all pairs are verified exactly. A component is dealt into blocks of bounded size; a task
   takes a pair of blocks and returns per member a count of links and the smallest member it hangs on.

No pairs are ever rows: a class has as many rows as it has trie nodes with company, and blocks.
"""

from __future__ import annotations

from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Workspace, text_pieces
from .components import connected
from .hashing import mix, shingles, unique_per_row

WORDS = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 5
RECALL = 0.9999
LOST = 1e-9  # probability that the signatures hide a pair at the threshold
NODE_ROWS = 1024  # members of a trie node in one block
BLOCK_SHINGLES = 1 << 20  # of the sets in one block
_LOW = np.uint64(0xFFFFFFFF)


def met_share(similarity: float, trees: int, match: int) -> float:
    """Probability that a pair of this similarity shares a prefix of ``match`` values in some tree."""
    return 1 - (1 - similarity**match) ** trees


def shortest_prefix(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, at most ``depth``, by which any pair at the threshold is met with probability
    ``recall``: the matched prefix is never shortened beyond it. Refused if one value is too long already."""
    for match in range(depth, 0, -1):
        if met_share(threshold, trees, match) >= recall:
            return match
    raise ValueError(f"{trees} trees meet pairs at {threshold} with probability {met_share(threshold, trees, 1):.4f}, not {recall}: ask for more trees")


def loose_bar(threshold: float, size: int, lost: float = LOST) -> int:
    """The greatest number of equal values, of ``size``, that a pair at the threshold falls below with
    probability ``lost`` at most; 1 at least."""
    below = 0.0
    for equal in range(size + 1):
        below += comb(size, equal) * threshold**equal * (1 - threshold) ** (size - equal)
        if below > lost:
            return max(equal, 1)
    return size


def signatures(hashes: np.ndarray, rows: np.ndarray, n: int, size: int) -> np.ndarray:
    """MinHash values (n, size) of sets given as hashes with ascending rows; a row without hashes has zeros."""
    out = np.zeros((n, size), np.uint32)
    if not len(hashes):
        return out
    has = np.unique(rows)
    starts = np.searchsorted(rows, has)
    low, high = (hashes & _LOW).astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    salts = mix(np.arange(1, 2 * size + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    for k in range(size):
        out[has, k] = np.minimum.reduceat((low * salts[2 * k]) ^ (high * salts[2 * k + 1]), starts)
    return out


def _sets(column: pa.Array, words: int):
    """Rows [first, last) of a text column with the distinct shingles of each row."""
    for first, last, buf, at in text_pieces(column):
        yield first, last, *unique_per_row(*shingles(buf, at, words))


def _profile(docs: DataFrame, words: int, size: int) -> DataFrame:
    """Per document: number of shingles, digest of their set, signature."""

    def kernel(batches):
        for batch in batches:
            for first, last, hashes, rows in _sets(batch.column(2), words):
                n = last - first
                counts = np.bincount(rows, minlength=n)
                ends = np.concatenate([[0], np.cumsum(counts)])
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + np.uint64(s)), dtype=np.uint64)]) for s in (1, 2)]
                digest = [(s[ends[1:]] - s[ends[:-1]]).view(np.int64) for s in sums]
                values = signatures(hashes, rows, n, size)
                flat = pa.Array.from_buffers(pa.binary(4 * size), n, [None, pa.py_buffer(np.ascontiguousarray(values))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(counts), *map(pa.array, digest), flat.cast(pa.binary())],
                    ["doc_id", "mark", "n", "g1", "g2", "signature"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(kernel, f"doc_id {kind}, mark bigint, n bigint, g1 bigint, g2 bigint, signature binary")


def _prefixes(classes: DataFrame, trees: int, depth: int, match: int) -> DataFrame:
    """``row, prefix, child`` of every class and tree: a hash of the tree and the matched prefix, that is a trie
    node, and the value after the prefix, that is the child of the node (of whole signatures 0)."""

    def kernel(batches):
        for batch in batches:
            n = batch.num_rows
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, trees, depth)
            key = np.broadcast_to(mix(np.arange(1, trees + 1, dtype=np.uint64)), (n, trees)).copy()
            for k in range(match):
                key = mix(key + values[:, :, k].astype(np.uint64))
            child = values[:, :, match] if match < depth else np.zeros((n, trees), np.uint32)
            rows = np.repeat(batch.column(0).to_numpy(), trees)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(key.ravel().view(np.int64)), pa.array(np.ascontiguousarray(child).ravel().view(np.int32))],
                ["row", "prefix", "child"],
            )

    return classes.select("row", "signature").mapInArrow(kernel, "row bigint, prefix bigint, child int")


def _groups(batches, keys: int):
    """Consecutive rows with equal first ``keys`` columns, as tables, from batches sorted by them."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
            held = None
        n = table.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for k in range(keys):
            v = table.column(k).combine_chunks().to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = np.flatnonzero(change)
        first = 0
        for c in cuts:
            yield table.slice(first, c - first)
            first = c
        held = table.slice(first)
    if held is not None:
        yield held


def _paired_blocks(members: DataFrame, blocks: str, by: list[str], then: tuple[str, ...] = ()) -> DataFrame:
    """Every member once per pair of blocks of its group that has its own: ``left``, ``right`` and ``own``;
    groups are sorted by ``then``."""
    own = F.pmod(F.xxhash64("row"), F.col(blocks)).cast("int")
    told = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    return told.withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other")}).drop("other", blocks).repartition(
        *by, "left", "right"
    ).sortWithinPartitions(*by, "left", "right", *then)


def _spread(near, n: int) -> np.ndarray:
    """Component label (smallest position) of each of n positions; ``near(i)`` gives the neighbours of one."""
    label = np.full(n, -1)
    for start in range(n):
        if label[start] >= 0:
            continue
        label[start] = start
        todo = [start]
        while todo:
            found = near(todo.pop())
            found = found[label[found] < 0]
            label[found] = start
            todo.extend(found.tolist())
    return label


def _node_links(classes: DataFrame, work: Workspace, trees: int, depth: int, match: int, threshold: float, node_rows: int) -> DataFrame:
    """``a, b, least``: members of different children of a trie node, each hung on the smallest one it is loosely
    linked to through them, and the equal values of the node's least alike pair at the threshold or above."""
    size = trees * depth
    bar, wanted = loose_bar(threshold, size), ceil(threshold * size - 1e-9)
    nodes = work.stage(f"nodes-{match}", _prefixes(classes, trees, depth, match))
    met = F.col("n") > 1 if match == depth else F.col("low") < F.col("high")
    # written, so that the join has two plain sides and a node of very many members can be split in it
    shared = work.stage(f"shared-{match}", nodes.groupBy("prefix").agg(
        F.count("*").alias("n"), F.min("child").alias("low"), F.max("child").alias("high")
    ).where(met).select("prefix", F.ceil(F.col("n") / node_rows).cast("int").alias("blocks")))
    members = nodes.join(shared, "prefix").join(classes.select("row", "signature"), "row").select("prefix", "row", "child", "signature", "blocks")

    def kernel(batches):
        out, held = [], 0
        for group in _groups(batches, 3):
            rows = group.column("row").to_numpy()
            if len(rows) < 2:
                continue
            values = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32).reshape(-1, size)
            child = np.arange(len(rows)) if match == depth else group.column("child").to_numpy()
            order = np.argsort(rows)
            rows, values, child = rows[order], values[order], child[order]
            least = size + 1

            def near(i):
                nonlocal least
                equal = (values == values[i]).sum(1)
                equal[child == child[i]] = 0
                least = min(least, int(equal[equal >= wanted].min(initial=size + 1)))
                return np.flatnonzero(equal >= bar)

            label = _spread(near, len(rows))
            linked = np.flatnonzero(label != np.arange(len(rows)))
            out.append((rows[linked], rows[label[linked]], np.full(len(linked), least)))
            held += len(linked)
            if held > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["a", "b", "least"])
                out, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["a", "b", "least"])

    paired = _paired_blocks(members, "blocks", ["prefix"], ("child",)).select("prefix", "left", "right", "child", "signature", "row")
    return paired.mapInArrow(kernel, "a bigint, b bigint, least bigint")


def _loose_links(classes: DataFrame, work: Workspace, trees: int, depth: int, threshold: float, recall: float, node_rows: int) -> DataFrame:
    """``a, b`` of all prefixes from the full depth to the one at which the recall is reached."""
    size, last = trees * depth, shortest_prefix(threshold, trees, depth, recall)
    links = None
    for match in range(depth, last - 1, -1):
        step = work.stage(f"links-{match}", _node_links(classes, work, trees, depth, match, threshold, node_rows))
        links = step if links is None else links.union(step)
        least = links.agg(F.min("least")).first()[0]
        if least is not None and least <= size and met_share(max(threshold, least / size), trees, match) >= recall:
            break
    return links.select("a", "b").distinct()


def _verify(sets: DataFrame, threshold: float) -> DataFrame:
    """``row, links, root`` per member and pair of blocks: documents linked to it, smallest member of its cluster."""

    def kernel(batches):
        for group in _groups(batches, 3):
            n = group.num_rows
            rows, copies, own = (group.column(c).to_numpy() for c in ("row", "copies", "own"))
            left, right = group.column("left")[0].as_py(), group.column("right")[0].as_py()
            lists = group.column("hashes").combine_chunks()
            sizes = lists.value_lengths().to_numpy()
            _, ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            seen = np.zeros(int(ids.max(initial=0)) + 1, bool)
            links = np.zeros(n, np.int64)
            near = [None] * n
            for i in range(n):
                mine = ids[ends[i] : ends[i + 1]]
                seen[mine] = True
                both = np.add.reduceat(seen[ids].astype(np.int32), ends[:-1])
                seen[mine] = False
                # |a & b| / |a | b| >= threshold, in whole numbers where the threshold is one of thousandths
                close = 1000 * both >= round(1000 * threshold) * (sizes + sizes[i] - both)
                close[i] = False
                if left != right:  # pairs inside a block are counted where it meets itself
                    close &= own != own[i]
                near[i] = np.flatnonzero(close)
                links[i] = copies[near[i]].sum()
            order = np.argsort(rows)
            place = np.empty(n, int)
            place[order] = np.arange(n)
            label = _spread(lambda i: place[near[order[i]]], n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[order]), pa.array(links[order]), pa.array(rows[order][label])], ["row", "links", "root"]
            )

    return sets.mapInArrow(kernel, "row bigint, links bigint, root bigint")


def join(docs: DataFrame, work: Workspace, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, depth: int = DEPTH,
         recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", node_rows: int = NODE_ROWS,
         block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Per document ``doc_id, mark, class_id, links, class_size, first``: its class of near duplicates.

    A threshold that ``trees`` cannot meet with probability ``recall`` is refused.
    Two documents are linked if the Jaccard similarity of their shingle sets (words are runs of other than
    ASCII blanks, compared as they are) is ``threshold`` (in thousandths) or more; classes are connected by
    links. ``class_id`` is the smallest ``doc_id`` of the class (null if it has none), ``links`` the number
    of other documents linked, ``first`` marks one row per class, the one with the smallest id, null last.

    A text of fewer words than a shingle has its whole word list as only shingle. A null text or one without
    words links to nothing. Repeated rows are documents of their own. ``mark``, a hash of the text, tells
    rows with one id apart. Other columns are not read; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    shortest_prefix(threshold, trees, depth, recall)  # refuses what cannot be met before any work
    table = work.stage("profiles", _profile(docs, words, trees * depth).withColumn("row", F.monotonically_increasing_id()))
    found = table.where("n > 0").groupBy("g1", "g2").agg(F.count("*").alias("copies"), F.min("row").alias("row"))
    classes = work.stage("classes", found)
    ones = table.join(classes.select("row", "copies"), "row").select("row", "copies", "n", "doc_id", "mark", "signature")
    loose = connected(_loose_links(ones.select("row", "signature"), work, trees, depth, threshold, recall, node_rows), work, "loose")
    inside = work.stage("members", loose.join(ones.drop("signature"), F.col("node") == F.col("row")).drop("node"))
    sizes = work.stage("sizes", inside.groupBy("root").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks")))
    # rows with equal id and text are one key here: any of their texts will do
    # (members grow with the corpus, so the join is one of two shuffled sides at any size)
    texts = docs.join(
        inside.select(F.col("doc_id").alias("key_id"), F.col("mark").alias("key_mark"), "root", "row", "copies").hint("merge"),
        docs.doc_id.eqNullSafe(F.col("key_id")) & (docs.mark == F.col("key_mark")),
    ).select("root", "row", "copies", "text")

    def cut(batches):
        for batch in batches:
            for first, last, hashes, rows in _sets(batch.column(3), words):
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=last - first))]).astype(np.int32)
                kept = [batch.column(k).slice(first, last - first) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))], ["root", "row", "copies", "hashes"]
                )

    sets = texts.mapInArrow(cut, "root bigint, row bigint, copies bigint, hashes array<bigint>").dropDuplicates(["row"])
    dealt = _paired_blocks(sets.join(sizes, "root"), "blocks", ["root"]).select("root", "left", "right", "own", "row", "copies", "hashes")
    verified = work.stage("verified", _verify(dealt, threshold))
    links = verified.groupBy("row").agg(F.sum("links").alias("linked"))
    roots = connected(verified.select(F.col("row").alias("a"), F.col("root").alias("b")), work, "strict")
    told = (
        table.select("row", "doc_id", "mark", "n", "g1", "g2")
        .join(classes.select("g1", "g2", "copies", F.col("row").alias("one")), ["g1", "g2"], "left")
        .join(links.withColumnRenamed("row", "one"), "one", "left")
        .join(roots.select(F.col("node").alias("one"), F.col("root").alias("leader")), "one", "left")
        .select("row", "doc_id", "mark", F.coalesce("leader", F.when(F.col("n") > 0, F.col("one")), "row").alias("leader"),
                F.when(F.col("n") > 0, F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("links"))
    )
    told = work.stage("joined", told)
    heads = work.stage("heads", told.groupBy("leader").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head"),
    ))
    return told.join(heads, "leader").select(
        "doc_id", "mark", "class_id", "links", "class_size", (F.col("row") == F.col("head.row")).alias("first")
    )
