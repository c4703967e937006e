"""Parsing, pairs, knowledge base, samples and label statistics."""

import collections

import pytest
from pyspark.sql import functions as F

from relaydesk.functions.ordering import top_n_per_group
from relaydesk.functions.text import clean_message, strip, tokens
from relaydesk.operators import datasets, intents, sampling, transcripts
from relaydesk.rules import SUPPORT_PACK


def parsed(spark, raw):
    df = spark.createDataFrame([("c", raw)], "conversation_id string, conversation string")
    return [(r["role"], r["text"]) for r in transcripts.parse_turns(df).orderBy("pos").collect()]


def test_turns(spark):
    assert parsed(spark, "hello\nCustomer: a\nb\nSupport: c") == [("customer", "a\nb"), ("support", "c")]
    assert parsed(spark, "Customer: x Support: y") == [("customer", "x Support: y")]
    assert parsed(spark, "no tags") == []


@pytest.mark.parametrize("raw, expected", [
    ("@a @b  hello  @c", "hello @c"), ("@a @b", ""), ("  x\t\ny ", "x y"), ("", ""),
    ("@a@b c", "c"), (" @a hi", "@a hi"),
])
def test_clean(spark, raw, expected):
    assert spark.range(1).select(clean_message(F.lit(raw))).first()[0] == expected


def test_many_mentions(spark):
    raw = " ".join(f"@user{i}" for i in range(20000)) + " hi"
    assert spark.range(1).select(clean_message(F.lit(raw))).first()[0] == "hi"


def test_strip_and_tokens(spark):
    row = spark.range(1).select(strip(F.lit(" \x1f a b\n")), tokens(F.lit("")), tokens(F.lit(" a b "))).first()
    assert list(row) == ["a b", [], ["a", "b"]]


RAW = [
    ("b", "1", "Support: p\nCustomer: q first question asked\nSupport: r first answer given"),
    ("b", "2", "Customer: @x @y\nSupport: an answer of some length"),
    ("b", "3", "Customer: a question that is long\nCustomer: more\nSupport: a fitting answer\nSupport: more"),
    ("o", "4", "Customer: a question that is long\nSupport: a fitting answer"),
    ("b", "5", "Customer: only one turn in this conversation"),
    ("b", "6", "Customer: short\nSupport: a fitting answer, long enough"),
]


def test_extract(spark):
    df = spark.createDataFrame(RAW, "company string, conversation_id string, conversation string")
    rows = {r["conversation_id"]: r for r in transcripts.extract_conversations(df, "b").collect()}
    assert set(rows) == {"1", "3"}
    assert rows["1"]["first_customer_msg"] == "q first question asked"
    assert rows["1"]["first_support_reply"] == "r first answer given"
    assert (rows["3"]["first_support_reply"], rows["3"]["num_turns"]) == ("a fitting answer", 4)
    assert transcripts.extract_conversations(df, max_conversations=2).count() == 2


def test_pairs_from_turns_agree(spark):
    df = spark.createDataFrame(RAW, "company string, conversation_id string, conversation string")
    turns = transcripts.parse_turns(df)
    a = transcripts.first_pairs_from_turns(turns).orderBy("conversation_id").collect()
    b = transcripts.extract_conversations(df).select(*a[0].__fields__).orderBy("conversation_id").collect()
    assert a == b


def test_pairs_of_one_huge_conversation(spark):
    turns = spark.range(20000).select(
        F.lit("big").alias("conversation_id"), F.col("id").alias("pos"),
        F.when(F.col("id") < 7, "support").when(F.col("id") == 7, "customer").when(F.col("id") < 9000, "customer")
        .otherwise("support").alias("role"),
        F.format_string("message number %d with enough characters", "id").alias("text"))
    row = transcripts.first_pairs_from_turns(turns).first()
    assert row["first_customer_msg"].startswith("message number 7 ")
    assert row["first_support_reply"].startswith("message number 9000 ")
    assert row["num_turns"] == 20000


def test_knowledge_base(spark):
    rows = [(i, f"question {i % 3}", f"answer {i}", 2) for i in range(9)]
    df = spark.createDataFrame(rows, "conversation_id int, first_customer_msg string, first_support_reply string, num_turns int")
    kb = transcripts.build_knowledge_base(df).orderBy("id").collect()
    assert [(r["id"], r["support_response"]) for r in kb] == [(0, "answer 0"), (1, "answer 1"), (2, "answer 2")]
    assert [r["id"] for r in transcripts.build_knowledge_base(df, 2).orderBy("id").collect()] == [0, 1]


def records(spark, n=3000):
    """One intent holds most rows; one has three."""
    return spark.range(n).select(
        F.col("id"), F.lit("t").alias("customer_tweet"),
        F.when(F.col("id") < 3, "rare").when(F.col("id") % 10 == 0, "some").otherwise("hot").alias("gold_intent"),
        F.when(F.col("id") % 7 == 0, "ambiguous").otherwise("standard").alias("difficulty_tag"))


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_golden_quotas(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = sampling.golden_sample(records(spark), 100, n_strata=3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    by = collections.Counter(r["gold_intent"] for r in rows)
    assert by == {"rare": 3, "hot": 33, "some": 33}  # the extra row goes to the first stratum seen
    hard = collections.Counter(r["gold_intent"] for r in rows if r["difficulty_tag"] != "standard")
    assert hard["hot"] == 11 and hard["some"] == 11
    assert sorted(r["golden_id"] for r in rows) == [f"GS-{i:03d}" for i in range(1, 70)]
    digest = sorted((r["golden_id"], r["id"]) for r in rows)
    assert digest == test_golden_quotas.__dict__.setdefault("first", digest)


def test_judge_subset(spark):
    golden = sampling.golden_sample(records(spark), 100, n_strata=3)
    rows = sampling.judge_subset(golden, 20).collect()
    by = collections.Counter(r["gold_intent"] for r in rows)
    assert len(rows) == 20 and by["rare"] == 3 and by["hot"] >= 6 and by["some"] >= 6
    assert all(r["human_scores"]["overall_pass"] is None for r in rows)


def test_split_is_exact(spark):
    df = spark.range(10007).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(
        F.concat(F.lit("l"), (F.col("id") % 5).cast("string"))).alias("label"))
    out = sampling.stratified_split(df, "label", "id").collect()
    assert len(out) == 10007 and len({r["id"] for r in out}) == 10007
    total, test = collections.Counter(r["label"] for r in out), collections.Counter(
        r["label"] for r in out if r["split"] == "test")
    assert sum(test.values()) == 2002
    assert all(abs(test[x] - 0.2 * total[x]) < 1 for x in total)


def test_top_n_beyond_window_limit(spark):
    df = spark.range(20000).select("id", F.lit("one").alias("g"))
    rows = top_n_per_group(df, ["g"], [F.desc("id")], 1500).collect()
    assert sorted(r["id"] for r in rows) == list(range(18500, 20000))


def test_golden_records_schema(spark):
    conv = spark.createDataFrame([("1", "My iPhone battery drains very fast", "We can help with that, restart it", 2)],
                                 "conversation_id string, first_customer_msg string, first_support_reply string, num_turns int")
    row = intents.golden_records(conv, SUPPORT_PACK).first()
    assert row.__fields__ == ["id", "customer_tweet", "gold_intent", "intent_confidence", "gold_escalation",
                              "gold_escalation_reason", "gold_human_reply", "difficulty_tag", "num_turns"]
    assert row["gold_intent"] in SUPPORT_PACK.intents and row["gold_escalation"] in ("AUTO_HANDLE", "ESCALATE")


def test_training_rows_keep_both_sources(spark):
    kb = spark.createDataFrame([("1", "battery battery drain"), ("2", "screen update wifi refund")], "id string, customer_query string")
    golden = spark.createDataFrame([("1", "x", "connectivity")], "id string, customer_tweet string, gold_intent string")
    rows = {r["id"]: r["label"] for r in intents.training_rows(kb, golden, SUPPORT_PACK).collect()}
    assert rows == {"1": "battery_power", "golden:1": "connectivity"}  # a share of 1/4 is dropped


def test_class_map(spark):
    mapping = datasets.class_map_table(spark)
    counts = spark.createDataFrame(
        [(s, 2) for s, _ in mapping.collect()] + [("atm_support", 5)], "label_name string, n long")
    row = datasets.map_coverage(counts, mapping).first()
    assert (row["num_intents"], row["mapped_intents"], row["coverage_pct"]) == (77, 76, 98.7)
    assert [r[0] for r in datasets.unmapped_labels(counts, mapping).collect()] == ["atm_support"]
    assert datasets.mapped_distribution(counts, mapping).first()["intent"] == "billing_store"


def test_turn_ids_do_not_collide(spark):
    from relaydesk.catalog.inputs import turn_id

    turns = spark.range(3).selectExpr("id AS conv_id").crossJoin(spark.range(150).selectExpr("id AS turn"))
    assert turns.select(turn_id("turn").alias("id")).distinct().count() == 450
