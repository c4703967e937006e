"""Secret scans, ranked search and the conversation trie against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from relaydesk.llm import ranked, secrets, trie
from relaydesk.llm.automaton import backwards, compile_patterns, parse
from relaydesk.llm.common import workspace

COMPILED = secrets.compile_rules()


# -- automata

def accepted(automaton, data):
    row = automaton.rows()[0]
    for byte in data:
        row = row[byte]
    return row[256]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["ab", "a*", "(a|bc)+", "[a-c]{2,3}", "[^a]b?", "c{2}", r"\x61|b", "a{1,}c", "(ab?)*c"]), min_size=1, max_size=3), st.text("abcd", max_size=6))
def test_automaton_equals_re(patterns, text):
    trees = [parse(p) for p in patterns]
    data = text.encode()
    want = sum(1 << k for k, p in enumerate(patterns) if re.fullmatch(p, text))
    assert accepted(compile_patterns(trees), data) == want
    assert accepted(compile_patterns([backwards(t) for t in trees]), data[::-1]) == want
    anywhere = sum(1 << k for k, p in enumerate(patterns) if re.search(f"(?:{p})\\Z", text))
    assert accepted(compile_patterns(trees, anywhere=True), data) == anywhere


def test_automaton_is_minimal():
    assert len(compile_patterns([parse("(a|b)*abb")]).accepts) == 5  # with the state of no return
    assert len(compile_patterns([parse("ab|cb")]).accepts) == 4


@pytest.mark.parametrize("pattern", ["(a", "a)", r"\d"])
def test_unknown_patterns_are_refused(pattern):
    with pytest.raises((ValueError, IndexError)):
        parse(pattern)


# -- secrets

def brute_spans(text):
    out = []
    for nth, rule in enumerate(secrets.RULES):
        pattern = re.compile(f"(?:{rule.head})(?P<body>{rule.body})", re.I | re.A if rule.any_case else 0)
        for m in pattern.finditer(text or ""):
            body = m["body"]
            if len(m[0]) >= rule.least and len(body) >= rule.least_body:
                out.append((m.start(), nth, m.end()))
    return [f"{secrets.RULES[r].kind}:{s}:{e}" for s, r, e in sorted(out)]


PIECES = ["password", "PassWd", "secret", "token", "api_key", "apikey", "API", "_", "=", ":", " ", "  ", '"', "'", "é", "ü", "日", "AKIA", "A" * 16, "AKIA" + "Z9" * 8, "deadbeef",
          "0123456789abcdef", "f" * 23, "f", "hunter2", "ghp_", "a1B2" * 9, "xoxb-", "12345-", "sk_live_", "AIza", "eyJ", "eyJhbGciOi.", "Bearer ", "https://", "user:pw@", "\n",
          "-----BEGIN RSA PRIVATE KEY-----", "MIIB\n", "-----END RSA PRIVATE KEY-----", "."]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_scan_equals_regular_expressions(pieces):
    text = "".join(pieces)
    data = text.encode()
    scanner = SCANNER
    found = scanner.spans(data)
    chars = secrets._characters(np.frombuffer(data, np.uint8), [p for s, _, e in found for p in (s, e)])
    assert [f"{scanner.rules[r].kind}:{chars[s]}:{chars[e]}" for s, r, e in found] == brute_spans(text)


SCANNER = secrets.Scanner(COMPILED)


def test_one_match_as_long_as_a_text():
    data = b"a" * 300_000
    assert len(SCANNER.places(data)) < 40
    assert SCANNER.spans(data) == [(0, 2, 300_000)]


SECRET_TEXTS = [(1, "é password = hunter2! AKIA" + "Q" * 16), (2, None), (3, ""), (3, "token: 'abc'"), (None, "x " * 100_000 + "deadbeef" * 4), (5, "secret: token: abcdef1"), (1, "é password = hunter2! AKIA" + "Q" * 16),
                (6, "password==secret=token: abcdefg")]


def test_digests_of_secrets(spark):
    docs = spark.createDataFrame(SECRET_TEXTS, "doc_id long, text string").withColumns({"spans": F.lit("x"), "kind": F.lit(1)})
    got = collections.Counter(tuple(r) for r in secrets.digests(docs, COMPILED).collect())
    want = collections.Counter()
    for i, t in SECRET_TEXTS:
        told = brute_spans(t)
        base = [s for s in told if s.split(":")[0] in ("assign", "access", "hex")]
        n = collections.Counter(s.split(":")[0] for s in base)
        want[i, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(told)] += 1
    assert got == want
    assert secrets.digests(docs.limit(0), COMPILED).count() == 0
    cleaned = {r.text for r in secrets.redact(docs, COMPILED).collect() if r.doc_id == 1}
    assert cleaned == {"é [secret]! [secret]"}
    assert secrets.redact(docs, COMPILED).columns == docs.columns


def test_bad_rules_are_refused():
    with pytest.raises(ValueError):
        secrets.compile_rules((secrets.Rule("a", "", "x*"),))
    with pytest.raises(ValueError):
        secrets.compile_rules((secrets.Rule("a", "", "x"), secrets.Rule("a", "", "y")))


# -- ranked search

def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute_ranks(docs, items, k=10):
    told = [(i, words_of(t)) for i, t in docs]
    n_docs, length = sum(bool(w) for _, w in told), sum(len(w) for _, w in told)
    df = collections.Counter(t for _, w in told for t in set(w))
    terms = collections.defaultdict(set)
    for i, t in items:
        terms[i] |= set(words_of(t))
    out = collections.Counter()
    for item, own in terms.items():
        scored = []
        for i, w in told:
            if w:
                m, tf = 100 - 90 + (90 * len(w) * n_docs) // length, collections.Counter(w)
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in own if tf[t])
                if s > 0:
                    scored.append((-s, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, i, -s] += 1
    return out


def search_rows():
    rng = random.Random(7)
    vocabulary = ["the", "The", "cat", "Été", "été", "ÉTÉ", "x1", "東京", "a b", "dog", "rare", "mat", "İ"]
    docs = [(i, rng.choice([" ", ", ", "\n", "\0"]).join(rng.choices(vocabulary, k=rng.randrange(1, 30)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "..."), (5, docs[5][1]), (None, docs[6][1]), (None, "rare cat"), (203, "cat " * 60_000 + "rare"), (204, docs[7][1]), (-3, docs[7][1])]
    items = [(1, "The cat, the mat"), (2, "été"), (3, None), (4, "!!"), (5, "absent"), (1, "rare"), (None, "東京 x1"), (6, "x1 x1 X1"), (7, "a b İ")]
    return docs, items


@pytest.mark.parametrize("block", [ranked.BLOCK_BYTES, 5000])
def test_ranks_equal_brute_force(spark, block):
    docs, items = search_rows()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "rank": F.lit(1), "item_id": F.lit(3)}).repartition(7)
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(9), "block": F.lit(9)})
    got = ranked.rank(d, i, workspace(spark), block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_ranks(docs, items)


def test_ranks_of_nothing(spark):
    docs, items = search_rows()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ranked.rank(d.limit(0), i, workspace(spark)).count() == 0
    assert ranked.rank(d.where("doc_id = 201"), i, workspace(spark)).count() == 0
    assert ranked.rank(d, i.limit(0), workspace(spark)).count() == 0


def test_items_too_large_are_refused(spark):
    i = spark.createDataFrame([(1, " ".join(map(str, range(3000))))], "item_id long, text string")
    with pytest.raises(ValueError):
        ranked.rank(i.withColumnRenamed("item_id", "doc_id"), i, workspace(spark), block_bytes=10_000)


def test_search_counts_in_the_scan(spark):
    """No text is shuffled, and one row a document leaves the scan."""
    docs = spark.createDataFrame([(k, f"cat {k}") for k in range(50)], "doc_id long, text string")
    counted = ranked._scan(docs, ["cat", "7"])
    assert {(r.doc_id, r.n, tuple(r.term), tuple(r.tf)) for r in counted.collect()} == {(k, 2, (0, 1) if k == 7 else (0,), (1, 1) if k == 7 else (1,)) for k in range(50)}
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


# -- trie

def brute_trie(rows, group=100, heads=6):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(vs)] for c, vs in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(math.fmod(c, group))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = collections.Counter()
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(path))
        out[min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def talk_rows():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice(["hi", "yes", "é", "", "long " * 5])) for c in range(0, 140) for t in range(rng.randrange(1, 7)) if c != 100]
    rows += [(c, t, "user", "same") for c in (310, 311, 312, 399, 355) for t in range(3)]  # no base
    rows += [(500, t, "user", f"turn {t % 7}") for t in range(400)] + [(501, t, "user", f"turn {t % 7}") for t in range(400)]  # long
    rows += [(-5, 1, None, None), (-5, None, "user", "first"), (-5, 2, "bot", None), (None, 1, "user", "nobody"), (7, 3, "user", "again"), (7, 3, "user", "again"), (7, 3, "bot", "other")]
    return rows


@pytest.mark.parametrize("partitions", [1, 8])
def test_trie_equals_brute_force(spark, partitions):
    rows = talk_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit(1), "chunk": F.lit(2), "t0": F.lit(3), "n": F.lit(4)})
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # long conversations in several chunks
    try:
        got = trie.nodes(df, workspace(spark)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert collections.Counter(tuple(r) for r in got) == brute_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.nodes(df, workspace(spark)).count() == 0
    alone = [(c, 0, "user", "x") for c in range(101, 112) if zlib.crc32(str(c).encode()) % 6 > 0]
    df = spark.createDataFrame(alone, "conv_id long, turn long, role string, text string")
    got = trie.nodes(df, workspace(spark)).collect()
    assert len(got) == 1 and collections.Counter(tuple(r) for r in got) == brute_trie(alone)


def test_equal_fingerprints_of_different_prefixes_are_refused(spark, monkeypatch):
    monkeypatch.setattr(trie, "PRIMES", (3, 3, 3, 3))
    monkeypatch.setattr(trie, "BASES", (1, 1, 1, 1))
    monkeypatch.setattr(trie, "ATTEMPTS", 1)
    rows = [(1000 + c, t, "user", f"{c} {t}") for c in range(30) for t in range(8)]
    with pytest.raises(RuntimeError):
        trie.nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), workspace(spark))


def test_ends_in_parts(spark):
    plans = spark.createDataFrame([(c, 2, 5, 6) for c in range(-50, 300)] + [(7, 1, 0, 0)], "conv_id long, length long, k0 long, k1 long")
    got = {(r.depth, r.k0, r.k1): r.ends_sha256 for r in trie._ends(plans, 16).collect()}
    assert got == {(2, 5, 6): hashlib.sha256(",".join(map(str, range(-50, 300))).encode()).hexdigest(), (1, 0, 0): hashlib.sha256(b"7").hexdigest()}
