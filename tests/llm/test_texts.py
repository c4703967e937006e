"""Text operators against brute force, the library they must equal, and held-out labels."""

import base64
import collections
import hashlib
import itertools
import os
import random
import re
from math import ceil

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from relaydesk.llm import forest, language, mixing, pieces, quality_model, quality_rules, queries, suffixes, toxicity
from relaydesk.llm.common import workspace
from relaydesk.llm.hashing import shingles

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "a", "ab " * 300, "x" * 500, "é" * 150, "a b c\n" * 60, "▁ a▁▁b  c ", "\x00\t😀 漢字", "Word " * 2000]


@pytest.fixture(scope="module")
def rows(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    words = docs[7][1].split()
    rng = random.Random(5)
    for k in range(25):  # near copies of one text
        some = list(words)
        for _ in range(rng.randint(1, 6)):
            some[rng.randrange(len(some))] = f"w{rng.randint(0, 9)}"
        docs.append((1000 + k, " ".join(some), "en", "src1", 0))
    docs += [(2000 + k, t, None, None, None) for k, t in enumerate(ODD)]
    return docs + [(2004, ODD[4], "en", "src2", 1), (None, docs[3][1], "en", None, 2), (None, None, None, "", 3)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("row", "mark", "h", "g", "score", "size", "value", "_t")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


# -- repeated byte strings

def test_suffix_order_is_sorted():
    rng = random.Random(3)
    for _ in range(200):
        n, letters = rng.randint(0, 60), rng.choice([b"ab", b"abc", b"a", bytes(range(256)), b"\x00\x01"])
        text = bytes(rng.choice(letters) for _ in range(n))
        wanted = sorted(rng.sample(range(n), rng.randint(0, n)))
        order = suffixes.suffix_order(np.frombuffer(text + bytes(40), np.uint8), np.array(wanted, np.int64), 4)
        order = [int(i) for i in order if int(i) in set(wanted)]
        keys = [(text + bytes(40))[i : i + 32] for i in order]
        assert sorted(order) == wanted and keys == sorted(keys)


def repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        yield len(t), int(hit.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~hit].tobytes()).hexdigest()


@pytest.mark.parametrize("limits", [{}, {"group_bytes": 2000, "bucket_bytes": 20_000}, {"length": 60, "gram": 16}])
def test_repeats_equal_brute_force(spark, docs, rows, limits):
    got = suffixes.find_repeats(docs, workspace(spark), **limits)
    want = repeats([(r[1] or "").encode() for r in rows], limits.get("length", 200))
    assert counted(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == collections.Counter((r[0], *w) for r, w in zip(rows, want))


def test_text_without_spans():
    assert suffixes.without_spans("aébc", [1], [2]) == "abc"  # half a character goes with its other half
    assert suffixes.without_spans("abc", [], []) == "abc"


# -- tokens

def test_pieces_equal_the_library(spark, docs, rows):
    model = queries.piece_model()
    sp = pieces.load(model)
    rng = random.Random(1)
    letters = [" ", "▁", "  ", "a", "the", "é", "\n", " ", "Ａ", "漢", "\x00", "😀", "<s>", "<0x41>", "ing"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    table = pieces.ChunkTable(sp, 50)  # emptied again and again
    ids, at = table.encode(texts)
    assert all(ids[a:b].tolist() == sp.encode(t) for t, a, b in zip(texts, at[:-1], at[1:]))
    want = []
    for r in rows:
        ids = sp.encode(r[1] or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids) if ids else "")))
    assert counted(pieces.digests(docs, model), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == collections.Counter(want)


# -- near duplicates

def similar(rows, least=0.8):
    sets = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    parent, links, holders = list(range(len(rows))), [0] * len(rows), collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    both = collections.Counter(p for own in holders.values() for p in itertools.combinations(own, 2))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in both.items():
        if n >= least * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    members = collections.defaultdict(list)
    for i, r in enumerate(rows):
        members[find(i)].append(r[0])
    return collections.Counter(
        (r[0], min((x for x in members[find(i)] if x is not None), default=None), links[i], len(members[find(i)])) for i, r in enumerate(rows)
    )


@pytest.mark.parametrize("limits", [{}, {"node_rows": 8, "block_shingles": 3000}])
def test_join_equals_all_pairs(spark, docs, rows, limits):
    got = forest.join(docs, workspace(spark), **limits).cache()
    want = similar(rows)
    assert counted(got, "doc_id", "class_id", "links", "class_size") == want
    assert got.where("first").count() == sum(1 / k[3] * n for k, n in want.items()).__round__()


@pytest.mark.parametrize("least", [0.5, 0.6, 0.7])
def test_join_meets_its_recall_at_lower_thresholds(spark, least):
    rng, rows = np.random.default_rng(7), []
    for k in range(60):  # families of one text with more and more words replaced
        words = [f"w{k}x{j}" for j in range(120)]
        for cut in range(0, 30, 2):
            changed = list(words)
            for at in rng.choice(120, cut // 2, replace=False):
                changed[at] = f"n{rng.integers(1 << 40)}"
            rows.append((len(rows), " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.links for r in forest.join(docs, workspace(spark), threshold=least).collect()}
    want = {r[0]: r[2] for r in similar(rows, least)}
    assert all(got[k] <= n for k, n in want.items())
    assert sum(got.values()) >= 0.9999 * sum(want.values()) > 500


def test_prefix_is_shortened_to_the_recall(spark):
    assert forest.shortest_prefix(0.8, 16, 5, 0.9999) == 3
    assert forest.shortest_prefix(0.8, 16, 5, 0.99) == 5
    with pytest.raises(ValueError):
        forest.shortest_prefix(0.1, 2, 5, 0.9999)
    with pytest.raises(ValueError):
        forest.join(spark.createDataFrame([(1, "a")], "doc_id long, text string"), workspace(spark), threshold=0.3)
    assert forest.loose_bar(0.8, 80) == 40 and forest.loose_bar(0.5, 80) < 20


@pytest.mark.parametrize("changed, steps", [(0.5, {5}), (8, {5, 4, 3})])
def test_pairs_found_decide_on_the_prefix(spark, changed, steps):
    """Copies that are hardly changed end the shortening at the full prefix; others need shorter ones."""
    rows = []
    for k in range(40):
        words = [f"w{k}x{j}" for j in range(400)]
        rows.append((2 * k, " ".join(words)))
        words[200 : 200 + ceil(changed)] = [f"n{k}x{j}" for j in range(ceil(changed))]
        rows.append((2 * k + 1, " ".join(words) if changed > 1 else " ".join(words[:-1])))
    if changed > 1:
        rows = [(i, t if i % 2 == 0 else " ".join(w if j % 45 else f"o{i}" for j, w in enumerate(t.split()))) for i, t in rows]
    work = workspace(spark)
    got = forest.join(spark.createDataFrame(rows, "doc_id long, text string"), work)
    assert counted(got, "doc_id", "class_id", "links", "class_size") == similar(rows)
    assert {d for d in range(1, 6) if os.path.exists(f"{work.root}/links-{d}")} == steps


def test_shingles_of_short_texts():
    text = b"a b c" + b"" + b"a b c" + b"a  b\nc d e f"
    hashes, rows = shingles(np.frombuffer(text, np.uint8), np.array([0, 5, 5, 10, 22]), 5)
    assert rows.tolist() == [0, 2, 3, 3] and hashes[0] == hashes[1] and len(set(hashes.tolist())) == 3


# -- rules

def test_rules_equal_brute_force(spark, docs, rows):
    def measures(text):
        words, t = WORD.findall(text), text
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = collections.Counter(windows)
        inside = {j for i, w in enumerate(windows) if twice[w] > 1 for j in (i, i + 1, i + 2)}
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), failed

    got = quality_rules.clean(docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert counted(got, "doc_id", *names) == collections.Counter((r[0], *measures(r[1] or "")) for r in rows)


def test_lines_are_cleaned_first(spark):
    prose = [" ".join(f"word{k}{j}" for j in range(9)) + "." for k in range(10)]
    text = "\n".join(prose + ["Home | News | Sport | About", "All rights reserved.", "Menu", "### $$$ %%% &&&.", "WIN!! BIG!! NOW!! YES!!"])
    junk = "\n".join(["a | b | c | d | e"] * 5 + [f"{k} x | y | z" for k in range(40)])
    got = {r.doc_id: r for r in quality_rules.clean(spark.createDataFrame([(1, text), (2, junk)], "doc_id int, text string")).collect()}
    assert got[1].kept and got[1].n_removed_lines == 5 and got[1].cleaned == "\n".join(text.split("\n")[:10])
    assert not got[2].kept and got[2].cleaned == ""


# -- mixing

def test_mix_meets_targets(spark, docs, rows):
    got = mixing.mix(docs, workspace(spark)).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    source = collections.defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source_size, r.target][0] += r.taken
    total = sum(len(WORD.findall(r[1] or "")) for r in rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    assert sum({(r.source_size, r.target): r.target for r in got}.values()) <= 1.5 * total + 1e-6
    for (size, target), (taken, *_) in by.items():
        same = sum(v == size for v in sizes.values())
        assert size == 0 or abs(taken - same * int(target)) <= same
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, workspace(spark)).collect()))
    assert not source


def test_water_fill_reshares_what_caps_cut_off(spark):
    table = spark.createDataFrame([("a", 100, 1000.0), ("b", 500, 1.0), (None, 400, 1.0)], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.water_fill(table, 1.5, 2.0).collect()}
    assert got == {"a": 200.0, "b": 650.0, None: 650.0}


# -- learned operators

def test_language(spark, docs, rows):
    told = language.identify(language.document_rows(docs), workspace(spark), min_rows=10).collect()
    assert len(told) == len(rows)
    wrong = [r for r in told if r.declared and r.accepted and r.language != r.declared]
    assert len(wrong) <= 2
    texts = {r[0]: r[1] for r in rows}
    assert all(not r.accepted for r in told if r.id is not None and not (texts[r.id] or "").strip())


def test_text_outweighs_a_false_declaration(spark):
    real = [(r.doc_id, r.text, r.lang, None, "h") for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang IN ('en', 'de')").collect()]
    lied = [(k, t, {"en": "de", "de": "en"}[lang] if k % 10 == 0 else lang, None, "h") for k, t, lang, *_ in real]
    told = language.identify(spark.createDataFrame(lied, "id long, text string, declared string, suffix string, host string"), workspace(spark))
    truth = {k: lang for k, _, lang, *_ in real}
    assert sum(r.language == truth[r.id] for r in told.collect()) >= 0.95 * len(real)


@pytest.mark.parametrize("query, table, of", [("op5_language", "documents", "lang"), ("page_languages", "pages", None)])
def test_every_declared_language_is_modelled(spark, query, table, of):
    told = queries.REGISTRY[query](spark, SF).collect()
    declared = collections.Counter(r.declared for r in told if r.declared)
    assert set(declared) == {"en", "de", "fr", "es"} and min(declared.values()) < 20
    assert all(r.language == r.declared for r in told if r.declared)
    assert len(told) == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_languages_without_bound(spark):
    letters = [chr(0x4E00 + k) for k in range(600)]
    rows = [(k, letters[2 * (k % 300)] * 2 + letters[2 * (k % 300) + 1] * 3, f"l{k % 300}", None, "h") for k in range(900)]
    rows += [(1000 + k, rows[k][1], None, None, None) for k in range(300)]
    told = language.identify(spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string"), workspace(spark), temper=1.0)
    assert all(r.language == f"l{r.id % 300 if r.id < 1000 else r.id - 1000}" for r in told.collect())


def strangers():
    rng = random.Random(8)
    return {
        "letters": "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(500)),
        "base64": base64.b64encode(bytes(rng.randrange(256) for _ in range(1500))).decode(),
        "one letter": "x" * 300,
        "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
        "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    }


@pytest.mark.parametrize("size, lang", [("sf0.001", None), ("sf0.01", None), ("sf0.01", "en")])
def test_pipeline_drops_what_fits_no_language(spark, size, lang):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    planted = spark.createDataFrame([(-1 - k, t, lang, "src1", len(t)) for k, t in enumerate(strangers().values())], docs.schema)
    left = [r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(planted), "").collect()]
    assert min(left) >= 0 and len(left) == docs.count()


def test_toxicity_matches_misspelled_words_and_spares_quotations():
    match = toxicity.Matcher(toxicity.Trie([("idiot", False, 5.0), ("scum", False, 5.0), ("disgust", True, 5.0)]))
    words = lambda t: [(h["word"], h["edits"], h["quoted"]) for h in toxicity.hits(t, match)[1]]
    assert words("You idiot, you 1diot and idiott!") == [("idiot", 0, False), ("1diot", 1, False), ("idiott", 1, False)]
    assert words("scam scum disgusting disqusting fine") == [("scum", 0, False), ("disgusting", 0, False), ("disqusting", 1, False)]
    assert words('He wrote "what an idiot" once.') == [("idiot", 0, True)]
    assert words("") == []


@pytest.mark.parametrize("query, label, least", [("op6_toxicity", "toxic", 0.9), ("op10_quality_model", "quality", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    d = "/root/testdata/sf0.1"
    told = queries.REGISTRY[query](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    right, n = told.agg(F.count_if(F.col("predicted") == F.col(label)), F.count("*")).first()
    assert n > 300 and right >= least * n


def test_toxicity_finds_common_misspellings():
    terms = [("idiot", False, 5.0), ("worthless", False, 5.0), ("pathetic", False, 5.0), ("disgusting", False, 5.0), ("moron", True, 5.0), ("馬鹿", True, 5.0)]
    match = toxicity.Matcher(toxicity.Trie(terms))
    found = lambda w: [h["edits"] for h in toxicity.hits(w, match)[1]]
    assert [found(w) for w in ("idoit", "wrothless", "patehtic", "disgutsing", "wrothles", "worhtlses")] == [[1], [1], [1], [1], [2], [2]]
    assert found("moron" + "x" * 100) == [0] and found("あなたは馬鹿です") == [0] and found("素晴らしいです") == []
    assert [found(w) for w in ("diot", "doit", "idtoi", "orthlss", "thetic")] == [[1], [], [], [2], [2]]


def plain_distance(a, b):
    """Edits between two words by the whole table; a swap of neighbours is one."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_equals_plain_edit_distance():
    rng = random.Random(4)
    for _ in range(400):
        terms = [("".join(rng.choice("abcd") for _ in range(rng.randint(3, 11))), rng.random() < 0.4, float(k + 1)) for k in range(rng.randint(1, 6))]
        trie = toxicity.Trie(terms)
        for _ in range(15):
            word = rng.choice(terms)[0]
            for _ in range(rng.randrange(4)):
                i, how = rng.randrange(max(len(word) - 1, 1)), rng.randrange(4)
                word = (word[:i] + ["", rng.choice("abcde"), word[i] + "e", word[i + 1 : i + 2] + word[i]][how] + word[i + (2 if how == 3 else 1) :]) or "a"
            word += rng.choice(["", "bcd"])
            near = []
            for k, (term, stem, weight) in enumerate(terms):
                edits = min(plain_distance(word[:n], term) for n in range(len(word) + 1)) if stem else plain_distance(word, term)
                if edits <= toxicity.edits_allowed(term, stem):
                    near.append((edits, -weight, k))
            want = min(near, default=None)
            assert trie.find(word) == (want and (want[0], want[2])), (terms, word)


def test_edits_of_the_learned_lexicon(spark):
    """On given tables: misspelled insults are found with what was learned, ordinary words are not."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    calm = docs.join(labels.where("toxic = 0 AND quality = 1"), "doc_id").orderBy("doc_id").first().text[:600]
    more = [(-1, calm), (-2, calm + " You idoit."), (-3, calm + " You idiot."), (-4, calm + " what a patehtic wrothless thing you are"), (-5, calm + ' He wrote "idiot" once.')]
    told = toxicity.score(docs.union(spark.createDataFrame(more, docs.schema)), labels, workspace(spark))
    score = {r.doc_id: (r.score, r.hits) for r in told.where("doc_id < 0").collect()}
    assert score[-1][1] == 0 and score[-1][0] < 0.1
    assert score[-2][1] == 1 and score[-2][0] > 0.5 and score[-3][0] > 0.5 and score[-4][1] == 2 and score[-4][0] > 0.5
    assert score[-5][0] < score[-3][0]
    judged = told.join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p"), F.count("*").alias("n")).collect()
    rate = {r.toxic: r.p for r in judged if r.n > 50}
    assert rate[0] <= 0.01 and rate[1] >= 0.85


def test_terms_whose_edited_forms_are_ordinary_take_no_edits(spark):
    texts = [(f"plante{c} planter {k}", 0) for k, c in enumerate("abcdfghijklmno")] + [("grumbler", 0), ("grumbler", 0), ("mistakeanly", 0), ("mistakeably", 0)]
    texts += [(f"plantex grumblen mistakenly {k}", 1) for k in range(300)]
    terms = [("plantex", False, 5.0), ("grumblen", False, 5.0), ("mistakenly", False, 5.0)]
    limits, plain = toxicity.settle_edits(spark.createDataFrame(texts, "text string, toxic int"), terms, workspace(spark))
    assert limits == {0: 0} and plain == {"grumbler", "mistakeanly", "mistakeably"}  # one with one edit, one with two
    trie = toxicity.Trie(terms, limits, plain)
    assert [trie.find(w) for w in ("planter", "plantex", "grumbler", "grumblex", "grumblen")] == [None, (0, 0), None, (1, 1), (0, 1)]
    assert toxicity.Trie(terms, {2: 1}).find("mistakeably") is None and toxicity.Trie(terms).find("mistakeably") == (2, 2)


def test_rare_terms_are_learned(spark):
    texts = [(f"calm words about weather {k}", 0) for k in range(2000)]
    texts += [(f"common{k % 50:02d}x insult number {k}", 1) for k in range(2000)] + [(f"zorkblat {k}", 1) for k in range(30)]
    texts += [("copied verbatim everywhere", 1)] * 500
    terms = toxicity.learn_lexicon(spark.createDataFrame(texts, "text string, toxic int"), workspace(spark))
    match = toxicity.Matcher(toxicity.Trie(terms))
    found = lambda w: len(toxicity.hits(w, match)[1])
    assert found("zorkblat") and found("insult") and not found("verbatim") and not found("weather")


def test_lexicon_has_no_greatest_size(spark):
    words = ["".join("bcdfghjklmnpqrst"[k >> s & 15] for s in (8, 4, 0)) for k in range(3500)]
    texts = [(" ".join(words[j::10]) + f" {k}", 1) for k in range(600) for j in [k % 10]] + [(f"calm {k}", 0) for k in range(600)]
    terms = toxicity.learn_lexicon(spark.createDataFrame(texts, "text string, toxic int"), workspace(spark))
    assert set(words) <= {t for t, _, _ in terms}


def test_prior_of_a_mixture():
    rng = np.random.default_rng(1)
    positive = rng.normal(2, 1, 4000)
    mixed = np.concatenate([rng.normal(2, 1, 2800), rng.normal(-2, 1, 1200)])
    assert abs(quality_model.class_prior(positive, mixed) - 0.7) < 0.06


# -- tables without rows

def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert suffixes.digests(empty, workspace(spark)).count() == 0
    assert pieces.digests(empty, queries.piece_model()).count() == 0
    assert forest.join(empty, workspace(spark)).count() == 0
    assert quality_rules.clean(empty).count() == 0
    assert mixing.mix(empty, workspace(spark)).count() == 0
    assert language.identify(language.document_rows(empty), workspace(spark)).count() == 0
    assert toxicity.score(empty, labels, workspace(spark)).count() == 0
    assert quality_model.score(empty, labels, workspace(spark)).count() == 0


def test_models_without_labels(spark, docs, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, labels, workspace(spark)).collect()} == {0.0}
    assert {r.score for r in quality_model.score(docs, labels, workspace(spark)).collect()} == {0.5}


def test_staged_texts_of_the_repeats_are_small(spark):
    """The tables with texts, regions and anchors are written with a stronger codec than the session's."""
    import glob

    import pyarrow.parquet as pq

    work = workspace(spark)
    passage = "".join(f"{k} " for k in range(1000, 1100))
    docs = spark.createDataFrame([(k, f"{k} begins. {passage} {k * k} ends {k}. {passage[100 * k:]}") for k in range(4)], "doc_id long, text string")
    assert suffixes.find_repeats(docs, work).where("n_removed > 0").count() == 4
    for name in ("anchors", "texts", "regions", "variants"):
        files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{work.path(name).removeprefix('file:')}/*.parquet")]
        codecs = {m.row_group(0).column(0).compression for m in files if m.num_row_groups}
        assert codecs == {"ZSTD"}, name
