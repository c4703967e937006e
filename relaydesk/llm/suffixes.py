"""Exact repeats of ``length`` bytes by suffix array, built by two-stage sorting, over a corpus of any size.

A suffix array of the whole corpus is cut into bounded ones that need no exchange:

1. Every window of ``length`` bytes is told by its anchor, the leftmost of its ``gram``-byte strings with the
   smallest hash. Equal windows have equal anchors at equal places, so windows whose anchor hash occurs once
   are unique. About one position in ``length / 2`` is an anchor.
2. The windows of an anchor form a region, their anchor hash its group. Equal regions of a group are
   collapsed into one with its count (any number of copies is one region); a group that has only one region
   is settled by that count.
3. The regions of the other groups are dealt to buckets by group. Per bucket, two-stage sorting gives the
   suffix array: suffixes smaller than their successor are sorted, the others are induced from them by bucket
   scans. Adjacent common prefixes of ``length`` bytes or more mark repeats.

A group of more than ``group_bytes`` is dealt anew: its regions are cut into slices of ``SPLIT`` (at last 1)
window starts, dealt by group and the bytes all windows of the slice share, and collapsed again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Workspace, text_buffer, text_pieces
from .hashing import RangeHash

GRAM = 32
BUCKET_BYTES = 2 << 20
GROUP_BYTES = 6 << 20
SPLIT = (32, 1)
SEGMENT = 2 << 20
CODEC = "zstd"  # of the tables with texts, regions and anchors: smaller than with the default one
REGIONS = "h bigint, g bigint, copies bigint, lead bigint, data binary"
_PLACE = np.uint64((1 << 24) - 1)


# -- anchors ---------------------------------------------------------------------

def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` keys, by prefix and suffix minima of blocks."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def anchors(buf: np.ndarray, at: np.ndarray, length: int, gram: int):
    """Of the texts' windows: first window start, number of windows, and place and hash of each anchor."""
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none.astype(np.uint64)
    grams = np.arange(len(buf) - gram + 1)
    hashes = RangeHash(buf).ranges(grams, grams + gram)
    least = _sliding_min((hashes & ~_PLACE) | grams.astype(np.uint64), length - gram + 1)
    edge = np.zeros(len(buf) + 1, np.int32)
    sizes = np.diff(at)
    long = sizes >= length
    np.add.at(edge, at[:-1][long], 1)
    np.add.at(edge, at[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge)[: len(least)])
    place = (least[starts] & _PLACE).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    return starts[first], np.diff(np.append(first, len(starts))), place[first], hashes[place[first]]


def _text_anchors(buf, at, length, gram):
    """First window start, packed size and hash of each anchor, and its row. A text beyond ``SEGMENT`` is
    taken in overlapping segments."""
    if len(at) == 2 and len(buf) > SEGMENT:
        parts = []
        for s in range(0, len(buf) - length + 1, SEGMENT):
            cut = buf[s : s + SEGMENT + length - 1]
            p, n, place, h = anchors(cut, np.array([0, len(cut)]), length, gram)
            parts.append((p + s, (place - p) << 16 | n, h))
        p, size, h = (np.concatenate(x) for x in zip(*parts))
        return p, size, h, np.zeros(len(p), np.int64)
    p, n, place, h = anchors(buf, at, length, gram)
    return p, (place - p) << 16 | n, h, np.searchsorted(at, p, side="right") - 1


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.ListArray:
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(rows, minlength=n), out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _anchor_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def kernel(batches):
        for batch in batches:
            for first, last, buf, at in text_pieces(batch.column(2), SEGMENT):
                p, size, h, rows = _text_anchors(buf, at, length, gram)
                raw = buf.tobytes()
                digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first),
                    pa.array(np.diff(at)), pa.array(digests, pa.string()),
                    _lists(h.view(np.int64), rows, last - first), _lists((p - at[rows]) << 32 | size, rows, last - first),
                ], ["doc_id", "mark", "n_bytes", "digest", "h", "pn"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(kernel, f"doc_id {kind}, mark bigint, n_bytes bigint, digest string, h array<bigint>, pn array<bigint>")


# -- two-stage suffix sorting ----------------------------------------------------

def _words(text: np.ndarray) -> np.ndarray:
    """The big-endian 8-byte word at every byte."""
    return np.ndarray((len(text) - 7,), ">u8", text.data, strides=(1,))


def _direct(pos: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by ``depth`` 8-byte words; only positions still tied are looked at again."""
    pos = pos.copy()
    same = np.ones(len(pos), bool)
    same[:1] = False
    for d in range(depth):
        tied = same.copy()
        tied[:-1] |= same[1:]
        idx = np.flatnonzero(tied)
        if not len(idx):
            break
        word = words[pos[idx] + 8 * d].astype(np.uint64)
        group = np.cumsum(~same[idx])
        order = np.lexsort((word, group)) if group[-1] > group[0] else np.argsort(word, kind="stable")
        pos[idx] = pos[idx[order]]
        word = word[order]
        same[idx[1:]] &= word[1:] == word[:-1]
    return pos


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes of a text (which ends in ``8 * depth + 8`` zero bytes) in order, to ``8 * depth``
    bytes at least.

    A suffix smaller than its successor is sorted directly. One that is larger is induced: scanning the
    buckets of first bytes from the smallest on, each suffix met puts its predecessor at the next free place
    of the predecessor's bucket, if that one is larger than it. Buckets are scanned whole, as arrays.
    """
    n = len(text) - 8 * depth - 8
    if not n:
        return np.zeros(0, np.int64)
    last = text[: n + 1].copy()
    last[n] = 0
    change = np.flatnonzero(last[:-1] != last[1:])
    falls = last[:-1][change] > last[1:][change]
    following = np.searchsorted(change, np.arange(n))
    larger = np.zeros(n + 1, bool)  # than its successor; a run of equal bytes is what its end is
    inside = following < len(change)
    larger[:n][inside] = falls[following[inside]]
    # a larger suffix needs its successors down to the first that is smaller
    smaller = np.flatnonzero(~larger)
    stop = smaller[np.searchsorted(smaller, wanted)]
    edge = np.zeros(n + 2, np.int32)
    np.add.at(edge, wanted, 1)
    np.add.at(edge, stop + 1, -1)
    needed = np.cumsum(edge)[: n + 1] > 0
    induced = needed & larger
    sorted_ = _direct(np.flatnonzero(needed & ~larger), _words(text), depth)
    ends = np.searchsorted(text[sorted_], np.arange(257))
    arrived: list[list[np.ndarray]] = [[] for _ in range(256)]
    done = []
    for c in range(256):
        own = arrived[c]
        scan = np.concatenate(own) if own else np.zeros(0, np.int64)
        while len(scan):  # runs of the byte itself
            done.append(scan)
            before = scan[scan > 0] - 1
            scan_next = before[induced[before] & (text[before] == c)]
            _send(scan, induced, text, c, arrived)
            scan = scan_next
        direct = sorted_[ends[c] : ends[c + 1]]
        if len(direct):
            done.append(direct)
            _send(direct, induced, text, c, arrived)
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def _send(scan, induced, text, c, arrived):
    before = scan[scan > 0] - 1
    before = before[induced[before]]
    first = text[before]
    above = first > c
    before, first = before[above], first[above]
    if not len(before):
        return
    order = np.argsort(first, kind="stable")
    before, first = before[order], first[order]
    cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    for a, b in zip(cuts, np.append(cuts[1:], len(first))):
        arrived[first[a]].append(before[a:b])


def adjacent_equal(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix of an order shares ``length`` bytes with the next one."""
    words = _words(text)
    idx = np.arange(len(order) - 1)
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    for s in steps:
        idx = idx[words[order[idx] + s] == words[order[idx + 1] + s]]
    equal = np.zeros(max(len(order) - 1, 0), bool)
    equal[idx] = True
    return equal


def repeated_starts(regions: list[bytes], copies: np.ndarray, length: int) -> list[np.ndarray]:
    """Of each region (its windows start at every byte but the last ``length - 1``) the starts of windows
    that occur at two places at least; a region with ``copies`` of 2 or more is at two places itself."""
    depth = -(-length // 8)
    sizes = np.array([len(r) for r in regions], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    text = np.frombuffer(b"".join(regions) + bytes(8 * depth + 8), np.uint8)
    edge = np.zeros(len(text) + 1, np.int32)
    full = sizes >= length
    np.add.at(edge, at[:-1][full], 1)
    np.add.at(edge, at[1:][full] - length + 1, -1)
    valid = np.cumsum(edge)[:-1] > 0
    order = suffix_order(text, np.flatnonzero(valid), depth)
    order = order[valid[order]]
    equal = adjacent_equal(text, order, length)
    hit = np.zeros(len(text), bool)
    hit[order[:-1][equal]] = True
    hit[order[1:][equal]] = True
    return [np.flatnonzero(hit[a : b - length + 1]) if c < 2 else np.arange(b - a - length + 1) for a, b, c in zip(at[:-1], at[1:], copies)]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past last of each run of consecutive numbers."""
    if not len(values):
        return values, values
    cut = np.flatnonzero(np.diff(values) != 1) + 1
    first = values[np.concatenate([[0], cut])]
    return first, values[np.concatenate([cut - 1, [len(values) - 1]])] + 1


# -- over a corpus ---------------------------------------------------------------

def _candidates(docs: DataFrame, table: DataFrame, work: Workspace, length: int) -> DataFrame:
    """Texts with an anchor whose hash occurs elsewhere, and those anchors: ``row, doc_id, mark, text, h, pn, g``."""
    seen = table.select("row", F.arrays_zip("h", "pn").alias("x")).select("row", F.explode("x").alias("x")).select("row", "x.h", "x.pn")
    # written, so that the join below deals out both its sides and a hash with very many rows can be split
    again = work.stage("again", seen.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    # identical rows have equal anchors: the first stands for them, and meets each of their texts below
    keys = table.groupBy(F.col("doc_id").alias("key_id"), F.col("mark").alias("key_mark")).agg(F.min("row").alias("row"))
    found = seen.join(again, "h").groupBy("row").agg(F.collect_list(F.struct("pn", "h")).alias("x")).join(keys, "row")
    told = docs.join(found, docs.doc_id.eqNullSafe(found.key_id) & (docs.mark == found.key_mark)).select(
        "row", "doc_id", "mark", F.encode("text", "utf-8").alias("text"), F.col("x.pn").alias("pn"), F.col("x.h").alias("h")
    )

    def kernel(batches):
        for batch in batches:
            for first, last, buf, at in text_pieces(batch.column(3), SEGMENT):
                part = batch.slice(first, last - first)
                pn = part.column(4).flatten().to_numpy()
                counts = part.column(4).value_lengths().to_numpy()
                starts = (pn >> 32) + np.repeat(at[:-1], counts)
                ends = starts + (pn & 0xFFFF) + length - 1
                g = np.zeros(len(pn), np.uint64)
                if len(buf) > SEGMENT:
                    for s in range(0, len(buf), SEGMENT):
                        own = np.flatnonzero((starts >= s) & (starts < s + SEGMENT))
                        g[own] = RangeHash(buf[s : s + SEGMENT + 2 * length]).ranges(starts[own] - s, ends[own] - s)
                else:
                    g = RangeHash(buf).ranges(starts, ends)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(g.view(np.int64)))],
                    ["row", "doc_id", "mark", "text", "pn", "h", "g"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return told.mapInArrow(kernel, f"row bigint, doc_id {kind}, mark bigint, text binary, pn array<bigint>, h array<bigint>, g array<bigint>")


def _cut_regions(texts: DataFrame, length: int) -> DataFrame:
    """The bytes of the regions listed in ``x`` (pn, h, g, copies) of each text."""

    def kernel(batches):
        for batch in batches:
            data, listed = batch.column(0), batch.column(1).to_pylist()
            held, size = [], 0
            for r, row in enumerate(listed):
                raw = memoryview(data[r].as_buffer())
                for x in row:
                    p, lead, n = x["pn"] >> 32, x["pn"] >> 16 & 0xFFFF, x["pn"] & 0xFFFF
                    held.append((x["h"], x["g"], x["copies"], lead, bytes(raw[p : p + n + length - 1])))
                    size += n + length
                    if size > 4 << 20:
                        yield _region_batch(held)
                        held, size = [], 0
            if held:
                yield _region_batch(held)

    return texts.select("text", "x").mapInArrow(kernel, REGIONS)


def _region_batch(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["h", "g", "copies", "lead", "data"])


def _sort_buckets(regions: DataFrame, length: int, buckets: int) -> DataFrame:
    """``h, g, starts, ends``: the runs of repeated window starts of each region, bucket by bucket."""

    def kernel(table: pa.Table) -> pa.Table:
        data = table.column("data").combine_chunks()
        found = repeated_starts([x.as_py() for x in data], table.column("copies").to_numpy(), length)
        runs = [_runs(f) for f in found]
        kind = pa.list_(pa.int32())
        return pa.table({
            "h": table.column("h"), "g": table.column("g"),
            "starts": pa.array([r[0].astype(np.int32) for r in runs], kind), "ends": pa.array([r[1].astype(np.int32) for r in runs], kind),
        })

    dealt = regions.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").applyInArrow(kernel, "h bigint, g bigint, starts array<int>, ends array<int>")


def _slices(regions: DataFrame, length: int, width: int) -> DataFrame:
    """Regions cut into slices of at most ``width`` window starts, at fixed distances from the anchor.

    Windows that are equal start at the same distance, so they are in slices of the same number ``turn``,
    which agree in the bytes that all windows of the slice share (``core``).
    """

    def kernel(batches):
        for batch in batches:
            h, g, copies, lead, data = batch.columns
            for r in range(batch.num_rows):
                buf = np.frombuffer(data[r].as_buffer(), np.uint8)
                n, ahead = len(buf) - length + 1, lead[r].as_py()
                turn = np.arange((ahead - n + 1) // width, ahead // width + 1)
                a, b = np.maximum(ahead - (turn + 1) * width + 1, 0), np.minimum(ahead - turn * width + 1, n)
                hashed, raw = RangeHash(buf), buf.tobytes()
                core = hashed.ranges(ahead - turn * width, ahead - (turn + 1) * width + 1 + length)
                fill = lambda x: pa.array(np.full(len(a), x.as_py()))
                yield pa.RecordBatch.from_arrays([
                    fill(h[r]), fill(g[r]), pa.array(a), pa.array(turn), pa.array(core.view(np.int64)),
                    pa.array(hashed.ranges(a, b + length - 1).view(np.int64)), fill(copies[r]), pa.array(ahead - a),
                    pa.array([raw[x : y + length - 1] for x, y in zip(a, b)], pa.binary()),
                ], [c.split(" ")[0] for c in out.split(", ")])

    out = "up_h bigint, up_g bigint, offset bigint, turn bigint, core bigint, g bigint, copies bigint, lead bigint, data binary"
    return regions.select("h", "g", "copies", "lead", "data").mapInArrow(kernel, out).withColumn("h", F.xxhash64("up_h", "turn", "core")).drop("turn", "core")


def _settle(regions: DataFrame, work: Workspace, length: int, group_bytes: int, bucket_bytes: int, splits: tuple[int, ...], name: str) -> DataFrame:
    """``h, g, starts, ends`` of staged regions: groups of bounded size by suffix array, others slice by slice."""
    sizes = regions.groupBy("h").agg(F.sum(F.octet_length("data")).alias("bytes"))
    total, most = sizes.agg(F.sum("bytes"), F.max("bytes")).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    if (most or 0) <= group_bytes or not splits:
        return _sort_buckets(regions, length, buckets)
    large = sizes.where(F.col("bytes") > group_bytes).select("h")
    slices = work.stage(f"{name}-slices", _slices(regions.join(large, "h", "left_semi"), length, splits[0]), CODEC)
    collapsed = slices.groupBy("h", "g").agg(F.sum("copies").alias("copies"), F.first("lead").alias("lead"), F.first("data").alias("data"))
    inner = _settle(work.stage(f"{name}-collapsed", collapsed, CODEC), work, length, group_bytes, bucket_bytes, splits[1:], f"{name}-{splits[0]}")
    move = lambda c: F.transform(c, lambda x: (x + F.col("offset")).cast("int"))
    back = slices.drop("data").join(inner, ["h", "g"]).groupBy("up_h", "up_g").agg(
        F.flatten(F.collect_list(move("starts"))).alias("starts"), F.flatten(F.collect_list(move("ends"))).alias("ends")
    )
    rest = _sort_buckets(regions.join(large, "h", "left_anti"), length, buckets)
    return rest.unionByName(back.withColumnsRenamed({"up_h": "h", "up_g": "g"}))


def _spans(texts: DataFrame, length: int) -> DataFrame:
    """Per text with ``x`` (pn, starts, ends of its hits): maximal removed runs and digest of what stays."""

    def kernel(batches):
        for batch in batches:
            data, hits = batch.column(2), batch.column(3)
            out = []
            for r in range(batch.num_rows):
                hit = hits[r].values
                place = hit.field("pn").to_numpy() >> 32
                counts = hit.field("starts").value_lengths().to_numpy()
                move = np.repeat(place, counts)
                a = hit.field("starts").flatten().to_numpy() + move
                b = hit.field("ends").flatten().to_numpy() + move + length - 1
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.ones(len(a), bool)
                new[1:] = a[1:] > b[:-1]
                first = np.flatnonzero(new)
                a, b = a[first], b[np.append(first[1:], len(b)) - 1]
                raw, digest, at = memoryview(data[r].as_buffer()), hashlib.sha256(), 0
                for x, y in zip(a.tolist(), b.tolist()):
                    digest.update(raw[at:x])
                    at = y
                digest.update(raw[at:])
                out.append((a, b, int((b - a).sum()), digest.hexdigest()))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], kind),
                pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.string()),
            ], ["hit_id", "hit_mark", "starts", "ends", "n_removed", "kept_digest"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "mark", "text", "x").mapInArrow(
        kernel, f"hit_id {kind}, hit_mark bigint, starts array<bigint>, ends array<bigint>, n_removed bigint, kept_digest string"
    )


def find_repeats(docs: DataFrame, work: Workspace, length: int = 200, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                 group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES, splits: tuple[int, ...] = SPLIT) -> DataFrame:
    """Per document ``doc_id, mark, n_bytes, n_removed, n_spans, starts, ends, kept_sha256``: the maximal runs
    [start, end) of bytes covered by a string of ``length`` bytes that also starts anywhere else.

    Texts are UTF-8 bytes, null is empty, strings end where their document ends; ``length`` is below 65,536.
    Repeated rows are documents like any other, so all of their strings repeat; ``mark`` (a hash of the text)
    tells rows with one id apart. Null ids are kept. Other columns are not read. An empty table gives an
    empty result.
    """
    if not gram + 7 < length < 1 << 16:
        raise ValueError("length must be above gram + 7 and below 65536")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    table = work.stage("anchors", _anchor_table(docs, length, gram).withColumn("row", F.monotonically_increasing_id()), CODEC)
    texts = work.stage("texts", _candidates(docs, table, work, length), CODEC)
    occurrences = texts.select("row", F.explode(F.arrays_zip("pn", "h", "g")).alias("x")).select("row", "x.pn", "x.h", "x.g")
    regions = work.stage("regions", occurrences.groupBy("h", "g").agg(
        F.count("*").alias("copies"), F.min(F.struct("row", "pn")).alias("one")
    ), CODEC)
    lone = work.stage("lone", regions.groupBy("h").agg(
        F.count("*").alias("variants"), F.sum("copies").alias("copies")
    ).where("variants = 1").select("h", "copies"))
    several = regions.join(lone.select("h"), "h", "left_anti")
    listed = several.groupBy(F.col("one.row").alias("row")).agg(
        F.collect_list(F.struct(F.col("one.pn").alias("pn"), "h", "g", "copies")).alias("x")
    )
    cut = work.stage("variants", _cut_regions(texts.select("row", "text").join(listed, "row"), length), CODEC)
    sorted_ = _settle(cut, work, length, group_bytes, bucket_bytes, splits, "groups").where(F.size("starts") > 0)
    windows = (F.col("one.pn").bitwiseAND(F.lit(0xFFFF))).cast("int")
    alone = regions.join(lone.where("copies > 1").select("h"), "h", "left_semi").select(
        "h", "g", F.array(F.lit(0)).alias("starts"), F.array(windows).alias("ends")
    )
    hits = occurrences.join(sorted_.unionByName(alone), ["h", "g"]).groupBy("row").agg(
        F.collect_list(F.struct("pn", "starts", "ends")).alias("x")
    )
    spans = _spans(texts.select("row", "doc_id", "mark", "text").join(hits, "row"), length).dropDuplicates(["hit_id", "hit_mark"])
    told = table.join(spans, table.doc_id.eqNullSafe(spans.hit_id) & (table.mark == spans.hit_mark), "left")
    none = F.array().cast("array<bigint>")
    return told.select(
        "doc_id", "mark", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(F.size("starts").cast("long"), F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"),
        F.coalesce("kept_digest", "digest").alias("kept_sha256"),
    )


def without_spans(text, starts: list[int], ends: list[int]) -> str:
    """A text without the given byte ranges; a character cut by a range goes with it."""
    raw, kept, at = text.encode(), [], 0
    for a, b in zip(starts, ends):
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return "".join(k.decode(errors="ignore") for k in kept)


def digests(docs: DataFrame, work: Workspace, length: int = 200) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs and SHA-256 of the bytes that stay."""
    return find_repeats(docs, work, length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
