"""Keyword intent labels, gold escalation labels and difficulty tags."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import contains_any, count_terms
from ..rules import RulePack, intent_case


def keyword_hits(text: Column, pack: RulePack) -> Column:
    """Number of distinct keywords present per intent, as an array in taxonomy order."""
    lowered = F.lower(text)
    return F.array(*[count_terms(lowered, kws) for _, kws in pack.taxonomy])


def keyword_matches(df: DataFrame, text_col: str, pack: RulePack, keep: list[str]) -> DataFrame:
    """Long form: one row per (row, intent, keyword) where the text contains the keyword."""
    rules = F.array(*[
        F.struct(F.lit(intent).alias("intent"), F.lit(ord_).alias("ord"), F.lit(kw).alias("kw"))
        for ord_, (intent, kws) in enumerate(pack.taxonomy)
        for kw in kws
    ])
    lowered = df.select(*keep, F.lower(text_col).alias("__t"))
    hits = F.filter(rules, lambda r: F.contains(F.col("__t"), r["kw"]))
    return lowered.select(*keep, F.explode(hits).alias("__hit")).select(*keep, "__hit.*")


KEY_CHARS = 4  # beginning of a keyword that finds the texts it may be in
SLOTS = 1 << 20  # of the beginnings' hashes, by which a text's own are sifted
PIECE_BYTES = 1 << 20  # of texts whose windows are hashed at once


def _windows(raw: np.ndarray, n: int) -> np.ndarray:
    """Slot of every run of ``n`` bytes."""
    h = np.zeros(max(len(raw) - n + 1, 0), np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + raw[i:i + len(h)]
    return (h ^ (h >> np.uint64(32))) % np.uint64(SLOTS)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and the offsets of its rows."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]], at - at[0]


def _slots(batches):
    """(bytes, slot) of short strings."""
    for batch in batches:
        grams = [g.encode() for g in batch.column(0).to_pylist()]
        slots = [int(_windows(np.frombuffer(g, np.uint8), len(g))[0]) for g in grams]
        yield pa.RecordBatch.from_arrays([pa.array([len(g) for g in grams], pa.int32()), pa.array(slots, pa.int32())], ["n", "slot"])


def keyword_matches_table(df: DataFrame, text_col: str, keywords: DataFrame, key: str) -> DataFrame:
    """As :func:`keyword_matches`, against a table (intent, ord, kw) of any size: (key, intent, ord, kw).

    Texts and keywords meet by an equal join on the first characters of the keyword, on keys alone;
    the text is then fetched by ``key``, which must be unique, and searched for the whole keyword.
    Of a text's runs of characters only those are joined whose hash a keyword's beginning has too.
    An empty or null keyword and a null text or key match nothing; a repeated rule row counts once.
    The driver reads only the hashes, at most ``SLOTS`` for each of the 16 lengths in bytes.
    """
    rules = keywords.select("intent", "ord", "kw").where(F.length("kw") > 0).distinct().withColumn(
        "__gram", F.substring("kw", 1, KEY_CHARS)
    )
    marked = {}
    for n, slot in rules.select("__gram").distinct().mapInArrow(_slots, "n int, slot int").distinct().collect():
        marked.setdefault(n, np.zeros(SLOTS, bool))[slot] = True
    marked = df.sparkSession.sparkContext.broadcast(marked)
    texts = df.select(key, F.lower(text_col).alias("__t"))

    def beginnings(batches):
        for batch in batches:
            raw, at = _bytes_of(batch.column(1))
            first, last = 0, len(at) - 1
            while first < last:
                end = max(first + 1, int(np.searchsorted(at, at[first] + PIECE_BYTES, side="right")) - 1)
                part, ends = raw[at[first]:at[end]], at[first + 1:end + 1] - at[first]
                rows, grams = [], []
                for n, known in marked.value.items():
                    starts = np.flatnonzero(known[_windows(part, n)])
                    row = np.searchsorted(ends, starts, side="right")
                    inside = starts + n <= ends[row]
                    rows.append(row[inside])
                    cut = part[starts[inside][:, None] + np.arange(n)].tobytes()
                    grams.append(pa.Array.from_buffers(pa.binary(n), int(inside.sum()), [None, pa.py_buffer(cut)]).cast(pa.binary()))
                if rows:
                    met = pa.table({"row": np.concatenate(rows), "gram": pa.concat_arrays(grams)}).group_by(["row", "gram"]).aggregate([])
                    met = met.combine_chunks()
                    for hit in met.to_batches():
                        ids = batch.column(0).take(pa.array(hit.column("row").to_numpy() + first))
                        yield pa.RecordBatch.from_arrays([ids, hit.column("gram")], [key, "__gram"])
                first = end

    schema = T.StructType([texts.schema[key], T.StructField("__gram", T.BinaryType())])
    found = texts.where(F.length("__t") > 0).mapInArrow(beginnings, schema)
    met = found.join(rules.withColumn("__gram", F.encode("__gram", "UTF-8")), "__gram").select(key, "intent", "ord", "kw")
    return met.join(texts, key).where(F.contains("__t", "kw")).select(key, "intent", "ord", "kw")


def label_intents(df: DataFrame, text_col: str, pack: RulePack) -> DataFrame:
    """Adds hits, intent, intent_confidence and n_intents.

    The intent with most hits wins, the earlier one on a tie; its share of all hits is the
    confidence. No hit at all gives the fallback intent.
    """
    n = len(pack.taxonomy)
    scored = df.withColumn("hits", keyword_hits(F.col(text_col), pack))
    scores = [F.col("hits")[i] for i in range(n)]
    best = F.greatest(*scores) if n > 1 else scores[0]
    total = sum(scores[1:], scores[0])
    winner = F.lit(pack.fallback_intent)
    for i in reversed(range(n)):
        winner = F.when(scores[i] == best, pack.taxonomy[i][0]).otherwise(winner)
    share = F.round(F.try_divide(best.cast("double"), total.cast("double")), 3)
    return (
        scored.withColumn("intent", F.when(F.col(text_col).isNull(), F.lit(None))
                          .when(best == 0, F.lit(pack.fallback_intent)).otherwise(winner))
        .withColumn("intent_confidence", F.when(F.col(text_col).isNull(), F.lit(None).cast("double"))
                    .when(best == 0, F.lit(pack.fallback_confidence)).otherwise(share))
        .withColumn("n_intents", sum(((s > 0).cast("int") for s in scores[1:]),
                                     (scores[0] > 0).cast("int")))
    )


def gold_escalation(df: DataFrame, text_col: str, pack: RulePack, intent_col: str = "intent") -> DataFrame:
    """Adds gold_escalation and gold_escalation_reason: trigger words first, then the intent default."""
    lowered = F.col("__lowered")
    intent = F.col(intent_col)
    escalating = [(i, reason) for i, decision, reason in pack.intent_defaults if decision == "ESCALATE"]
    by_intent = intent.isin([i for i, _ in escalating]) if escalating else F.lit(False)
    triggered = F.lit(None).cast("string")
    for reason, words in reversed(pack.gold_triggers):
        triggered = F.when(contains_any(lowered, words), reason).otherwise(triggered)
    return (
        df.withColumn("__lowered", F.lower(text_col))
        .withColumn("__trigger", triggered)
        .withColumn(
            "gold_escalation",
            F.when(F.col(text_col).isNull(), F.lit(None))
            .when(F.col("__trigger").isNotNull() | by_intent, "ESCALATE").otherwise("AUTO_HANDLE"),
        )
        .withColumn(
            "gold_escalation_reason",
            F.when(F.col(text_col).isNull(), F.lit(None))
            .otherwise(F.coalesce("__trigger", intent_case(intent, escalating, pack.gold_auto_reason))),
        )
        .drop("__trigger", "__lowered")
    )


def difficulty(text: Column, confidence: Column, n_intents: Column, pack: RulePack) -> Column:
    """multi_intent, ambiguous, adversarial or standard, the first that applies."""
    return (
        F.when(n_intents >= 3, "multi_intent")
        .when((confidence < 0.4) & (F.length(text) < 50), "ambiguous")
        .when(contains_any(F.lower(text), pack.sarcasm), "adversarial")
        .when(confidence < 0.5, "ambiguous")
        .otherwise("standard")
    )


def golden_records(conversations: DataFrame, pack: RulePack) -> DataFrame:
    """Every conversation as a labelled evaluation record, before sampling."""
    text = "first_customer_msg"
    labelled = gold_escalation(label_intents(conversations, text, pack), text, pack)
    return labelled.select(
        F.col("conversation_id").alias("id"),
        F.col(text).alias("customer_tweet"),
        F.col("intent").alias("gold_intent"),
        "intent_confidence",
        "gold_escalation",
        "gold_escalation_reason",
        F.col("first_support_reply").alias("gold_human_reply"),
        difficulty(F.col(text), F.col("intent_confidence"), F.col("n_intents"), pack).alias(
            "difficulty_tag"
        ),
        "num_turns",
    )


def training_rows(knowledge_base: DataFrame, golden: DataFrame, pack: RulePack,
                  min_confidence: float | None = 0.3, text_col: str = "customer_query") -> DataFrame:
    """Auto-labelled knowledge base rows plus the golden rows: (id, text, label).

    Golden ids get a prefix so that the two sources never share an id.
    """
    auto = label_intents(knowledge_base, text_col, pack)
    if min_confidence is not None:
        auto = auto.where(F.col("intent_confidence") >= min_confidence)
    return auto.select(
        F.col("id").cast("string").alias("id"), F.col(text_col).alias("text"), F.col("intent").alias("label")
    ).unionByName(
        golden.select(
            F.concat(F.lit("golden:"), F.col("id").cast("string")).alias("id"),
            F.col("customer_tweet").alias("text"),
            F.col("gold_intent").alias("label"),
        )
    )


def facet_search(golden: DataFrame, search: str = "", intent: str | None = None,
                 difficulty_tag: str | None = None) -> DataFrame:
    """Case-insensitive substring search with optional intent and difficulty filters."""
    out = golden
    if search:
        out = out.where(F.contains(F.lower("customer_tweet"), F.lower(F.lit(search))))
    if intent:
        out = out.where(F.col("gold_intent") == intent)
    if difficulty_tag:
        out = out.where(F.col("difficulty_tag") == difficulty_tag)
    return out


def distributions(golden: DataFrame) -> DataFrame:
    """Counts by intent, by escalation and by difficulty in one pass: (facet, value, n)."""
    facets = ("gold_intent", "gold_escalation", "difficulty_tag")
    grouped = golden.groupingSets([[F.col(c)] for c in facets], *[F.col(c) for c in facets]).agg(
        F.count("*").alias("n"), F.grouping_id(*facets).alias("gid")
    )
    return grouped.select(
        F.when(F.col("gid") == 3, facets[0]).when(F.col("gid") == 5, facets[1]).otherwise(facets[2])
        .alias("facet"),
        F.coalesce(*facets).alias("value"),
        "n",
    )
