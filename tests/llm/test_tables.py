"""Vector search, archives and the pipeline."""

import collections
import hashlib
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from relaydesk.llm import queries, topk, warc
from relaydesk.llm.common import workspace
from relaydesk.llm.components import connected


# -- search

def brute(rows, k):
    usable = [(n, i, [int(64 * x // 1) for x in v]) for n, (i, v) in enumerate(rows)
              if v and all(x is not None and x == x and abs(x) != float("inf") for x in v)]
    out = collections.Counter()
    for n, i, q in usable:
        if i is not None and i % 20 == 0:
            scored = [(-max(min(sum(a * b for a, b in zip(q, c)), 2**63 - 1), -(2**63)), j is None, j) for m, j, c in usable if m != n and len(c) == len(q)]
            for rank, (s, _, j) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
                out[i, rank, j, -s] += 1
    return out


@pytest.mark.parametrize("limits", [{}, {"shard_bytes": 200, "tile_bytes": 100}])
def test_search_equals_brute_force(spark, limits):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 0.26, 1e-3]) for _ in range(3)]) for i in range(150)]
    rows += [(160, None), (180, []), (200, [None, 1.0, 1.0]), (220, [float("nan"), 0.0, 0.0]), (240, [float("inf"), 0.0, 0.0]),
             (20, [1.0, 1.0, 1.0]), (None, [1.0, 0.5, 0.5]), (260, [1.0, 2.0]), (7, [1.0, 3.0]), (280, [1e15, 2.0]), (8, [1e15, -3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"row": F.lit(0), "score": F.lit("x")})
    got = topk.search(topk.quantise(df, 64), workspace(spark), 20, F.col("vec_id") % 20 == 0, **limits)
    assert collections.Counter(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, 20)


def test_search_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(topk.quantise(df, 64), workspace(spark), 20, F.col("vec_id") % 20 == 0).count() == 0


# -- archives

PAGES = [(1, "http://a/", "<p>" + "x" * 300), (2, "http://b/\r\nX: y", "<p>" + "x" * 300), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
         (7, "http://ü/", "é\r\n\r\nWARC/1.1\r\n" * 50), (None, "n", "<p>" + "x" * 300), (8, "u", "y" * 5000), (9, "u", "y" * 5000), (9, "u", "y" * 5000)]


@pytest.mark.parametrize("chunk, file", [(1 << 20, 1 << 28), (64, 2000)])
def test_archives_round_trip(spark, chunk, file):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"payload": F.lit("x"), "data": F.lit(1), "mark": F.lit(2)})
    manifest = warc.write(pages, workspace(spark), chunk_bytes=chunk, file_bytes=file)
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES)
    chunks = warc.read_chunks(manifest, chunk).collect()
    assert all(len(c.data) <= chunk for c in chunks)
    read = warc.read_chunks(manifest, chunk)
    busy = read.select(F.spark_partition_id()).distinct().count()
    assert busy == manifest.count() and (file > 2000 or busy > 1)  # a task per archive
    payloads = collections.Counter()
    for key in {(c.page_id, c.record_type, c.payload_digest) for c in chunks if c.record_type == "response"}:
        own = [c for c in chunks if (c.page_id, c.record_type, c.payload_digest) == key]
        whole = b"".join(c.data for c in sorted(own, key=lambda c: c.chunk_no))
        assert all(c.digest_so_far == hashlib.sha256(whole[: c.bytes_so_far]).hexdigest() for c in own)
        payloads[key[0], whole.decode()] += 1
    first = {}
    for i, _, h in PAGES:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    want = collections.Counter()
    for i, _, h in PAGES:
        raw = (h or "").encode()
        revisit = h in first and first[h] != i
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None] += 1
        assert revisit or payloads[i, h or ""]
    got = warc.read_records(manifest, chunk).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert collections.Counter(tuple(r) for r in got.collect()) == want


def test_damaged_payload_raises():
    row = {"page_id": 1, "url": "u", "record_type": "response", "refers_to": None, "payload_bytes": 3, "payload_digest": hashlib.sha256(b"abc").hexdigest()}
    member = lambda body: (c := zlib.compressobj(2, zlib.DEFLATED, 31)).compress(warc._header(row) + body + b"\r\n\r\n") + c.flush()
    assert [r["data"] for r in warc.records(io.BytesIO(member(b"abc") * 2), 2)] == [b"ab", b"c"] * 2
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(io.BytesIO(member(b"abd")), 2))


def test_archives_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.write(pages, workspace(spark))).count() == 0


# -- components

def test_components(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = connected(spark.createDataFrame(edges, "a long, b long"), workspace(spark), "t").collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in parent}


# -- mixing of whole documents

def test_whole_documents_come_nearest(spark):
    from relaydesk.llm.mixing import mix, mix_whole

    rng = random.Random(3)
    rows = [(k, "w " * rng.randint(1, 300), f"s{rng.choice([0, 0, 0, 1, 2, 3])}") for k in range(400)]
    rows += [(500, "w " * 40, "tiny"), (501, None, "tiny"), (502, "", "void"), (None, "a b c", None), (None, None, None), (7, "r " * 30, "s1"), (7, "r " * 30, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("x")).withColumn("again", F.lit(0))
    wanted = {}
    for r in mix(docs, workspace(spark)).collect():
        wanted.setdefault((r.source_size, r.target), []).append(r)
    told = mix_whole(docs, workspace(spark)).collect()
    assert len(told) == len({(i, s) for i, _, s in rows})
    got = {}
    for r in told:
        assert 0 <= r.copies <= 2 and (r.size > 0 or r.copies == 0)
        n, words = got.get(r.source, (0, 0))
        got[r.source] = (n + r.size, words + r.copies * r.size)
    for size, target in wanted:
        near = [w for n, w in got.values() if n == size]
        least = target / 400 + 1 if size > 1000 else 40  # a source of one document takes it or not
        assert any(abs(w - target) <= least for w in near)
    assert sorted(map(tuple, told), key=str) == sorted(map(tuple, mix_whole(docs.repartition(5), workspace(spark)).collect()), key=str)
    assert mix_whole(docs.limit(0), workspace(spark)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_whole_documents_against_all_choices(spark, seed):
    """One source of few documents, a long one among them: the target is met as it can be, and no choice that is as near takes fewer words otherwise."""
    from itertools import product

    from relaydesk.llm.mixing import NEAR, mix, mix_whole

    rng = random.Random(seed)
    rows = [(k, "w " * rng.choice([rng.randint(5, 90), 9]), "a") for k in range(7)] + [(7, "w " * 900, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = sorted(mix(docs, workspace(spark)).collect())
    taken, sizes, target = [r.taken for r in told], [r.size for r in told], told[0].target
    off = lambda c: abs(sum(n * s for n, s in zip(c, sizes)) - sum(taken))
    rank = lambda c: (max(off(c), int(NEAR * target)), sum(abs(n * s - t) for n, s, t in zip(c, sizes, taken)), off(c))
    got = [r.copies for r in sorted(mix_whole(docs, workspace(spark)).collect())]
    assert rank(got) == min(map(rank, product(range(3), repeat=8)))


# -- pipeline

def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    words = docs.first().text.split()
    near = " ".join(words[:-1] + ["other"])
    odd = spark.createDataFrame([(5000, near, "fr", "src0", 1), (5001, None, None, None, None), (None, " ".join(words), "fr", None, 2), (5002, "", "en", "", 0)], docs.schema)
    docs, work = docs.unionByName(odd), workspace(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, work.stage(name, stage(spark, docs, d))
        kept[name] = docs
        if name != "pieces":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    ids = lambda name: {r.doc_id for r in kept[name].collect()}
    assert not {5001, 5002} & ids("language_id") and {0, 5000, None} <= ids("language_id")
    assert 0 in ids("jaccard_join") and not {5000, None} & ids("jaccard_join")
    n = lambda df: df.agg(F.sum(mixed_words())).first()[0]
    assert abs(n(kept["mixing"]) - 1.5 * n(kept["suffix_dedup"])) < 100
    assert kept["pieces"].count() == kept["mixing"].count()
    assert kept["mixing"].select("doc_id", "text").subtract(kept["suffix_dedup"].select("doc_id", "text")).count() == 0  # whole texts


def mixed_words():
    from relaydesk.llm.mixing import size_of

    return size_of(F.col("text"))


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_every_operator_has_a_query():
    assert {k.split("_")[0] for k in queries.REGISTRY if k.startswith("op")} == {f"op{n}" for n in range(1, 14)}


# -- samples

@pytest.mark.parametrize("n", [10, 200, 5000])
def test_a_few_rows_are_the_first_of_all(spark, n):
    from relaydesk.llm.learning import seeded_few, seeded_first

    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"))
    first = lambda how: sorted(r.doc_id for r in how(rows, n, "doc_id", 42).collect())
    assert first(seeded_few) == first(seeded_first)
    plan = seeded_few(spark.range(100_000), 100, "id", 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (xxhash64" in plan
