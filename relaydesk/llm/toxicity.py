"""Toxicity: misspelled lexicon terms found by a Levenshtein automaton on a trie, weighed by their context.

The lexicon is learned from labelled texts: words, and stems that many words begin with, that stand almost
only in toxic ones. A word of a text is matched if the automaton of the edits that a term's length allows
(none below 5 characters, two from 8; a swap of neighbours is one), intersected with the trie of all terms,
accepts it. The intersection is made deterministic as words need it and its transitions are kept, so a word costs
one look-up per character until no term can follow. What edits may match is learned too: a term whose edited forms
clean texts hold takes none, and words that clean texts hold are no misspellings.
In scripts without blanks terms are found unchanged at every place, one hit for a run of letters. Each match is a
hit whose context window tells abuse from quotation: marks around it and words of report speak for a quotation,
words of address for abuse. A small net turns hits into a score.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Workspace
from .learning import Scaler, held_out, logistic, seeded_first, sigmoid

SAMPLE_ROWS = 10_000  # texts of either label that lexicon and net are learned from
EDITS = 2  # at most
FUZZY_FROM, TWICE_FROM = 5, 8  # characters a word of the lexicon needs to be matched with an edit, or two; a stem one more
STEMS = (4, 5, 6)
UNSPACED = (2, 3, 4)  # characters of a term in a script without blanks, taken from any place
STANDS_FOR = 0.5  # share of a stem's toxic texts that a word needs to be kept beside it, for its edits
CLEAN_EDITS = 2000  # a term takes edits if at most one in so many clean texts has an edited form of it
CLEAN_FORMS = 5  # and if clean texts have at most so many different ones
EDIT_TRUST = 0.8  # weight of a hit per edit
STATES = 200_000  # of the automaton, kept at once
WINDOW = 8  # words on either side
TABLE_ENTRIES = 500_000  # distinct words remembered per task
FEATURES = ("abuse", "quoted", "rate", "terms", "addressed")
REPORT = frozenset("said says called word words quote quoted wrote writes term phrase dit mot sagte wort dijo palabra".split())
ADDRESS = frozenset("you your youre u ur tu du vous sie usted te dich toi".split())
_WORD = re.compile(r"[^\W_]+")
# Thai, Lao, Myanmar, Khmer, kana and Han: words stand without blanks, so a token may be a clause
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_OPEN, _CLOSE = "“«„", "”»"


def edits_allowed(term: str, stem: bool) -> int:
    """Edits that a term is matched with: by its length, a stem one character more."""
    n = len(term) - stem
    return 2 if n >= TWICE_FROM else 1 if n >= FUZZY_FROM else 0


class Trie:
    """Terms, each with a weight; a stem matches every word that begins with it. An edit puts in, takes out or
    changes a character, or swaps two neighbours. ``limits`` says of the number of a term how many edits it takes
    at most; words in ``plain`` are matched only unchanged."""

    def __init__(self, terms: list[tuple[str, bool, float]], limits: dict[int, int] | None = None, plain: frozenset[str] = frozenset()):
        self.terms, self.plain = terms, plain
        self.allowed = [min(edits_allowed(t, s), (limits or {}).get(k, EDITS)) for k, (t, s, _) in enumerate(terms)]
        self.longest = max((len(t) for t, _, _ in terms), default=0)
        self.kids: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]  # edits of the terms below a node
        for k, (term, _, _) in enumerate(terms):
            node = 0
            self.most[0] = max(self.most[0], self.allowed[k])
            for ch in term:
                if ch not in self.kids[node]:
                    self.kids[node][ch] = len(self.kids)
                    self.kids.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.kids[node][ch]
                self.most[node] = max(self.most[node], self.allowed[k])
            self.ends[node].append(k)
        self._restart()

    def _restart(self):
        reached: dict = {}
        self._put(reached, 0, 0)
        self.states: dict = {}
        self.begin = self._state(reached)

    def _put(self, reached: dict, node: int, edits: int):
        """A node reached with so many edits, and by leaving out characters those below it."""
        if edits <= self.most[node] and edits < reached.get((node, ""), EDITS + 1):
            reached[node, ""] = edits
            if edits < self.most[node]:
                for kid in self.kids[node].values():
                    self._put(reached, kid, edits + 1)

    def _state(self, reached: dict) -> list:
        """``[nodes with their edits, moves, best term if the word ends here, best stem]``, one list per set of nodes."""
        key = frozenset(reached.items())
        state = self.states.get(key)
        if state is None:
            whole = [(e, -self.terms[k][2], k) for (node, swap), e in key if not swap for k in self.ends[node] if e <= self.allowed[k]]
            state = self.states[key] = [key, {}, min(whole, default=None), min((w for w in whole if self.terms[w[2]][1]), default=None)]
        return state

    def _step(self, state: list, ch: str) -> list:
        reached: dict = {}
        for (node, swap), edits in state[0]:
            if swap:  # one half of a swap was read
                if swap == ch:
                    self._put(reached, node, edits)
                continue
            kids = self.kids[node]
            if ch in kids:
                self._put(reached, kids[ch], edits)
            if edits < self.most[node]:
                self._put(reached, node, edits + 1)
                for other, kid in kids.items():
                    if other != ch:
                        self._put(reached, kid, edits + 1)
                        after = self.kids[kid].get(ch)
                        if after is not None and edits < self.most[after]:
                            reached[after, other] = min(edits + 1, reached.get((after, other), EDITS + 1))
        state[1][ch] = out = self._state(reached)
        return out

    def find(self, word: str) -> tuple[int, int] | None:
        """``(edits, term)`` of the closest term, the heaviest among equals."""
        if len(self.states) > STATES:
            self._restart()
        state, best = self.begin, None
        for ch in word:
            state = state[1].get(ch) or self._step(state, ch)
            if state[3] is not None and (best is None or state[3] < best):
                best = state[3]
            if not state[0]:
                break
        if state[2] is not None and (best is None or state[2] < best):
            best = state[2]
        if best is None or best[0] and word in self.plain:
            return None
        return best[0], best[2]

    def find_inside(self, word: str) -> tuple[int, int] | None:
        """``(0, term)`` of the heaviest term that stands unchanged at any place of a word."""
        best = None
        for start in range(len(word)):
            node = 0
            for ch in word[start : start + self.longest]:
                node = self.kids[node].get(ch)
                if node is None:
                    break
                for k in self.ends[node]:
                    if best is None or self.terms[k][2] > self.terms[best][2]:
                        best = k
        return None if best is None else (0, best)


class Matcher:
    """Matches of words, remembered."""

    def __init__(self, trie: Trie):
        self.trie, self.seen, self.known = trie, set(), {}

    def learn(self, words: set[str]) -> bool:
        """Look at words not met before; whether any of the words has a match."""
        if len(self.seen) > TABLE_ENTRIES:
            self.seen, self.known = set(), {}
        for w in words - self.seen:
            if _UNSPACED.search(w):
                got = self.trie.find_inside(w)
            else:
                got = self.trie.find(w) if len(w) > 2 else None
            if got is not None:
                self.known[w] = got
        self.seen |= words
        return not self.known.keys().isdisjoint(words)


def _quoted(text: str, start: int, end: int, reach: int = 120) -> bool:
    """Whether a span lies between quotation marks that open and close within ``reach`` characters."""
    line_start = text.rfind("\n", max(0, start - reach), start) + 1 or max(0, start - reach)
    before, after = text[line_start:start], text[end : end + reach].split("\n", 1)[0]
    if before.count('"') % 2 == 1 and '"' in after:
        return True
    opened = max(before.rfind(c) for c in _OPEN)
    return opened >= 0 and opened > max(before.rfind(c) for c in _CLOSE) and any(c in after for c in _CLOSE)


def hits(text: str, match: Matcher) -> tuple[int, list[dict]]:
    """Number of words, and for each match its word, term, edits and what its context says."""
    words = _WORD.findall(text.lower())
    if not match.learn(set(words)):
        return len(words), []
    spans = list(_WORD.finditer(text))
    plain = [m.group().lower() for m in spans]
    match.learn(set(plain))
    found = []
    for k, word in enumerate(plain):
        got = match.known.get(word)
        if got is not None:
            around = plain[max(0, k - WINDOW) : k] + plain[k + 1 : k + 1 + WINDOW]
            near = plain[max(0, k - 3) : k] + plain[k + 1 : k + 4]
            found.append({
                "word": word, "term": got[1], "edits": got[0], "address": any(w in ADDRESS for w in near),
                "quoted": _quoted(text, *spans[k].span()), "report": any(w in REPORT for w in around),
            })
    return len(plain), found


def _row(n_words: int, found: list[dict], weights: np.ndarray) -> list[float]:
    abuse = quoted = addressed = 0.0
    for h in found:
        w = weights[h["term"]] * EDIT_TRUST ** h["edits"]
        if h["quoted"] or h["report"] and not h["address"]:
            quoted += w
        else:
            abuse += w
        addressed += h["address"]
    return [np.log1p(abuse), np.log1p(quoted), np.log1p(100.0 * abuse / max(n_words, 1)), np.log1p(len({h["term"] for h in found})), np.log1p(addressed)]


def learn_lexicon(texts: DataFrame, work: Workspace, share: float = 0.9, stem_share: float = 0.99) -> list[tuple[str, bool, float]]:
    """Terms ``(text, is stem, weight)`` from ``text, toxic``: of the texts they are in (each label weighed
    alike) ``share`` or more are toxic, ``stem_share`` for a stem, and that is no chance: the likelihood
    ratio statistic against the labels' own shares is one that less than one of all counted terms reaches.
    All such terms are taken. Equal texts of a label count once, so a much copied one is no vocabulary."""
    texts = texts.dropDuplicates(["text", "toxic"])

    def kernel(batches):
        for batch in batches:
            terms, marks = [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {w.lower() for w in _WORD.findall(text or "")}
                found = {(w, False) for w in own if len(w) > 2} | {(w[:n], True) for w in own for n in STEMS if len(w) > n}
                found |= {(w[i : i + n], True) for w in own if _UNSPACED.search(w) for n in UNSPACED for i in range(len(w) - n + 1)}
                terms.extend(found)
                marks.extend([toxic] * len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in terms], pa.string()), pa.array([s for _, s in terms], pa.bool_()), pa.array(marks, pa.int64())],
                ["term", "stem", "toxic"],
            )

    sizes = texts.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    counted = work.stage("terms", texts.select("text", F.col("toxic").cast("long")).mapInArrow(kernel, "term string, stem boolean, toxic bigint").groupBy("term", "stem").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
    ))
    surprise = 2 * np.log(max(counted.count(), 2))
    bad, good = F.col("bad") / max(sizes[0], 1), (F.col("good") + 0.5) / max(sizes[1], 1)
    expected = max(sizes[0], 1) / max(sizes[0] + sizes[1], 1)
    both = F.col("bad") + F.col("good")
    part = lambda n, p: F.when(n > 0, n * F.ln(n / (both * p))).otherwise(F.lit(0.0))
    told = counted.withColumns({"share": bad / (bad + good), "surprise": 2 * (part(F.col("bad"), expected) + part(F.col("good"), max(1 - expected, 1e-9)))})
    top = told.where((F.col("surprise") >= float(surprise)) & (F.col("share") >= F.when(F.col("stem"), stem_share).otherwise(share)))
    rows = top.orderBy(F.desc("bad"), F.desc("share"), "term", "stem").collect()
    terms = [(r.term, r.stem, float(np.log(r.share / (1 - r.share) + 1))) for r in rows]
    stems = {r.term: r.bad for r in rows if r.stem}
    words = {r.term: r.bad for r in rows if not r.stem}

    def said(term: str, stem: bool) -> bool:
        """Whether a shorter stem matches all that a term does; not if the word is what its stem stands for."""
        above = [term[:n] for n in STEMS if n <= len(term) and term[:n] in stems and (n < len(term) or not stem)]
        return bool(above) and (stem or words[term] < STANDS_FOR * max(stems[t] for t in above))

    return [(t, s, w) for t, s, w in terms if not said(t, s)]


def settle_edits(texts: DataFrame, terms: list[tuple[str, bool, float]], work: Workspace, share: float = 0.9) -> tuple[dict[int, int], frozenset[str]]:
    """How many edits each term takes where that is less than its length allows, and the words that are no
    misspellings of any.

    Words that match with edits are counted in ``text, toxic``. Those that clean texts hold are ordinary words.
    How many more of them other clean texts will hold is told by those seen in one clean text only: a term takes
    so many edits if such words are in at most one clean text of ``CLEAN_EDITS``, or in so few that ``share`` of
    what it matches is toxic (each label weighed alike), and if the ordinary words around it are few.
    """
    trie = Trie(terms)

    def kernel(batches):
        match = Matcher(trie)
        for batch in batches:
            found: list[tuple] = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set(_WORD.findall((text or "").lower()))
                match.learn(own)
                found.extend((*match.known[w], w, toxic) for w in own & match.known.keys() if match.known[w][0])
            columns = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64()))], ["edits", "term", "word", "toxic"])

    sizes = texts.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    forms = work.stage("forms", texts.select("text", F.col("toxic").cast("long")).mapInArrow(kernel, "edits int, term int, word string, toxic bigint").groupBy("term", "edits", "word").agg(
        F.sum(1 - F.col("toxic")).alias("good"), F.sum("toxic").alias("bad")))
    once = F.count_if(F.col("good") == 1)
    per_good, per_bad = once / max(sizes[1], 1), F.sum("bad") / max(sizes[0], 1)
    loses = (once * CLEAN_EDITS > sizes[1]) & (once > 1) & (per_bad < share * (per_bad + per_good)) | (F.count_if(F.col("good") > 0) > CLEAN_FORMS)
    limits: dict[int, int] = {}
    for r in forms.groupBy("term", "edits").agg(loses.alias("loses")).where("loses").collect():  # two rows per term at most
        limits[r.term] = min(limits.get(r.term, EDITS), r.edits - 1)
    kept = [(k, e) for k, (t, s, _) in enumerate(terms) for e in range(1, min(edits_allowed(t, s), limits.get(k, EDITS)) + 1)]
    if not kept:
        return limits, frozenset()
    # as many words as the bounded sample holds at most
    plain = forms.where("good > 0").join(F.broadcast(work.spark.createDataFrame(kept, "term int, edits int")), ["term", "edits"])
    return limits, frozenset(r.word for r in plain.select("word").distinct().collect())


def score(docs: DataFrame, labels: DataFrame, work: Workspace, folds: int = 5, fold: int = 0, sample_rows: int = SAMPLE_ROWS, seed: int = 42,
          threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted, hits, quoted_hits``: probability that a text is toxic.

    At most ``sample_rows`` labelled texts of either kind outside the held-out fold are learned from; every
    whole text is scored. Null or empty texts have no hits and the score of such texts. An id with several
    labels is toxic if one is. Without labels of both kinds the score is 0. Repeated rows are scored each;
    other columns are not read.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = labels.where(~held_out("doc_id", folds, fold) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")
    )
    sample = seeded_first(known.where("toxic = 1"), sample_rows, "doc_id", seed).union(seeded_first(known.where("toxic = 0"), sample_rows, "doc_id", seed))
    # at most 2 * sample_rows pairs of numbers, so small enough to send everywhere
    texts = work.stage("sample", docs.join(F.broadcast(sample), "doc_id").select("text", "toxic"))
    terms = learn_lexicon(texts, work)
    weights = np.array([w for _, _, w in terms] or [0.0])
    trie = Trie(terms, *settle_edits(texts, terms, work))

    def measure(batches):
        match = Matcher(trie)
        for batch in batches:
            rows, kept = [], batch.column(0).to_pylist()
            for text in kept:
                n, found = hits(text or "", match)
                rows.append(_row(n, found, weights))
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, kind)], ["toxic", "x"])

    seen = texts.select("text", F.col("toxic").cast("int")).mapInArrow(measure, "toxic int, x array<double>").collect()
    x, y = np.array([r.x for r in seen]).reshape(-1, len(FEATURES)), np.array([r.toxic for r in seen], float)
    model = None
    if 0 < y.sum() < len(y):
        scaler = Scaler(x)
        model = scaler, logistic(scaler(x), y, hidden=6, epochs=30, seed=seed)

    def kernel(batches):
        match = Matcher(trie)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                rows, counts, quoted = [], [], []
                for text in part.column(1):
                    n, found = hits(text.as_py() or "", match)
                    rows.append(_row(n, found, weights))
                    counts.append(len(found))
                    quoted.append(sum(h["quoted"] for h in found))
                s = sigmoid(model[1](model[0](np.array(rows)))) if model else np.zeros(len(rows))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array(counts, pa.int64()), pa.array(quoted, pa.int64())],
                                                 ["doc_id", "score", "hits", "quoted_hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    told = docs.mapInArrow(kernel, f"doc_id {kind}, score double, hits bigint, quoted_hits bigint")
    return told.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits", "quoted_hits")
