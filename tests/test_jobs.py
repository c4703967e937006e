"""Replies, text models, composite jobs, sources and streams."""

import json
import math
import os
import random
import re
import time
from collections import Counter

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import Row, functions as F

from relaydesk import fixed_values as fv
from relaydesk.operators import replies, textmodel
from relaydesk.operators.transcripts import first_pairs_from_turns
from relaydesk.plans import prepare, run
from relaydesk.plans.configs import CONFIGS, PROPOSED
from relaydesk.plans.triage import triage, vectorise
from relaydesk.rules import SUPPORT_PACK
from relaydesk.sources import tables
from relaydesk.sources.workspace import Workspace
from relaydesk.streaming import live, pairs

CASE = "array<struct<customer_query:string,support_response:string,similarity:double,id:string>>"


def one_reply(spark, text, intent, decision, cases):
    df = spark.createDataFrame([("1", text, intent, decision, cases)],
                               f"id string, text string, intent string, decision string, retrieved_cases {CASE}")
    return replies.template_reply(df, SUPPORT_PACK, "text", "id", decision=F.col("decision")).first()


def test_template_escalates_without_cases(spark):
    row = one_reply(spark, "My Apple ID is locked", "account_security", "ESCALATE", [])
    assert "DM" in row["response"] and fv.DM_LINK in row["response"]
    assert (row["response_method"], row["grounding_sources"]) == ("template", [])


def test_template_uses_the_best_case(spark):
    case = [("q", "@you We'd love to help. Hold {dm_link} the power button. https://t.co/abc", 0.9, "k1"), ("q", "r", 0.5, "k2")]
    row = one_reply(spark, "update broke it", "software_troubleshooting", "AUTO_HANDLE", case)
    assert "Hold {dm_link} the power button." in row["response"]
    assert "@you" not in row["response"] and "t.co/abc" not in row["response"]
    assert row["grounding_sources"] == ["k1", "k2"]
    assert fv.RESOLUTION_TOO_SHORT in one_reply(
        spark, "x", "battery_power", "AUTO_HANDLE", [("q", "@a ok", 0.9, "k")])["response"]
    assert fv.RESOLUTION_NO_CASE in one_reply(spark, "x", "unknown", "AUTO_HANDLE", [])["response"]
    # an intent without automatic replies answers from its escalation list
    assert "billing" in one_reply(spark, "x", "billing_store", "AUTO_HANDLE", case)["response"]


def test_baseline_replies(spark):
    df = spark.createDataFrame([("1", [("q", "verbatim", 0.9, "k")]), ("2", []), ("3", None)], f"id string, retrieved_cases {CASE}")
    rows = {r["id"]: r for r in replies.nearest_reply(df).collect()}
    assert (rows["1"]["response"], rows["1"]["grounding_sources"]) == ("verbatim", ["k"])
    assert rows["2"]["response_method"] == rows["3"]["response_method"] == "canned"
    assert replies.canned_reply(df).first()["response"] == fv.CANNED_REPLY


def test_prompts(spark):
    df = spark.createDataFrame([("m", [("q", "r", 0.5, "k")])], f"text string, cases {CASE}")
    p = df.select(replies.reply_prompt(F.col("text"), F.lit("i"), F.lit("d"), F.lit("why"), F.col("cases"))).first()[0]
    assert "CUSTOMER MESSAGE: m\n" in p and "  Case 1 (similarity: 0.50):\n    Customer: q\n" in p and "%s" not in p
    j = df.select(replies.judge_prompt(*[F.lit(x) for x in "abcdef"])).first()[0]
    assert j.count("    5: ") == 4 and "REFERENCE (actual human agent response): f" in j


TEXTS = [("a", "The battery drains fast and the battery is hot"), ("a", "battery drains over night"),
         ("b", "screen is cracked, cracked badly"), ("b", "cracked screen and broken glass"), ("b", "")]


def test_tfidf_weights(spark):
    df = spark.createDataFrame(TEXTS, "label string, text string")
    model = textmodel.fit_tfidf(df.select("text"), vocab=100, min_df=1, stop_words=False)
    vocab = model.stages[1].vocabulary

    def terms(t):
        w = re.findall(r"\w\w+", t.lower())
        return Counter(w + [" ".join(p) for p in zip(w, w[1:])])

    docs = [terms(t) for _, t in TEXTS]
    df_count = Counter(t for d in docs for t in d)
    assert set(vocab) == set(df_count)
    got = model.transform(df).select("text", "features").collect()
    for (_, text), row in zip(TEXTS, got):
        want = {t: n * (math.log((1 + len(TEXTS)) / (1 + df_count[t])) + 1) for t, n in terms(text).items()}
        norm = math.sqrt(sum(v * v for v in want.values())) or 1.0
        have = {vocab[i]: v for i, v in zip(row["features"].indices, row["features"].values)}
        assert have == pytest.approx({t: v / norm for t, v in want.items()})


def test_vocabulary_limits(spark):
    df = spark.createDataFrame(TEXTS, "label string, text string")
    model = textmodel.fit_tfidf(df.select("text"), vocab=3, min_df=2)
    # tf 3 for battery and cracked, then tf 2 in name order; stop words and single-row terms are out
    assert model.stages[1].vocabulary == ["battery", "cracked", "battery drains"]


def test_classifier(spark, work):
    df = spark.createDataFrame(TEXTS[:4] * 5, "label string, text string")
    model = textmodel.fit_classifier(df, min_df=1, max_iter=50, work=work)
    tables.save_model(model, work.path("clf"))
    out = textmodel.classify_tfidf(df, PipelineModel.load(work.path("clf")), "text").collect()
    assert all(r["intent"] == r["label"] for r in out)
    assert all(abs(sum(r["intent_all_scores"].values()) - 1) < 1e-3 for r in out)
    assert all(r["intent_confidence"] == max(r["intent_all_scores"].values()) for r in out)


def test_encoder_hook(spark):
    df = spark.createDataFrame([("1", "ab")], "id string, text string")
    own = lambda d, text, out: d.withColumn(out, F.array(F.length(text).cast("double")))
    assert textmodel.encode(df, own, "text").first()["vec"] == [2.0]


WORDS = {
    "software_troubleshooting": "update crash freeze", "battery_power": "battery drain overheat",
    "connectivity": "wifi bluetooth signal", "account_security": "icloud login disabled",
    "hardware_damage": "screen cracked camera", "billing_store": "refund subscription invoice",
}


@pytest.fixture(scope="module")
def transcripts(spark):
    rows = []
    for i in range(240):
        intent = list(WORDS)[i % 6]
        words = WORDS[intent].split()
        rows.append(("Brand" if i % 8 else "Other", f"c{i:03d}",
                     f"Customer: @brand my {words[i % 3]} and {words[(i + 1) % 3]} trouble number {i // 4}\n"
                     f"Support: Try to restart, then check {words[0]} settings and DM us, case {i}"))
    return spark.createDataFrame(rows, "company string, conversation_id string, conversation string")


@pytest.fixture(scope="module")
def prepared(spark, transcripts):
    from relaydesk.sources.workspace import Workspace

    work = Workspace(spark)
    return prepare.prepare(transcripts, work, brand="Brand", golden_size=36, judge_size=12), work


def test_prepare(prepared):
    p, _ = prepared
    assert p.conversations.count() == 210
    assert p.golden_set.count() == 36
    assert p.judge_subset.count() == 12
    kb = p.knowledge_base
    assert kb.count() == kb.select("customer_query").distinct().count() <= 210


def test_three_configurations(prepared):
    p, work = prepared
    results = run.run_tables(p, work, judge_n=20, max_iter=40)
    wide = {r["agent_name"]: r for r in results["agent_metrics"].collect()}
    assert set(wide) == {c.agent_name for c in CONFIGS}
    assert all(r["num_examples"] == 36 for r in wide.values())
    assert wide["trivial_baseline"]["false_auto_handle_rate"] == 1.0
    assert wide["tfidf_baseline"]["intent_accuracy"] > 0.9 and wide["proposed_agent"]["intent_accuracy"] > 0.9
    for r in results["predictions"].collect():
        assert 0.0 <= r["risk_score"] <= 1.0 and r["response"] and len(r["retrieved_cases"]) == 3
        assert r["query_id"] not in [c["id"] for c in r["retrieved_cases"]]
    docs = results["agent_documents"].collect()
    assert len(docs) == 3 and all(d["intent"]["per_class"] for d in docs)
    assert results["comparison"].count() == 7
    assert results["pass_rate"].first()["num_evaluated"] == 20
    scores = results["judge_scores"]
    again = run.rubric.agreement(scores, scores, "golden_id").where("dim = 'overall'").first()
    assert again["pass_fail_agreement"] == 1.0


def test_parity_lets_messages_find_themselves(prepared):
    p, work = prepared
    resources = prepare.train(p, work, leakage_guard=False, tfidf=False)
    queries = work.stage("self", vectorise(p.golden_set, resources, "id", "customer_tweet"))
    out = triage(queries, PROPOSED.parity(), resources).collect()
    assert all(abs(r["retrieved_cases"][0]["similarity"] - 1) < 1e-6 for r in out)


def test_triage_keeps_empty_messages(spark, prepared):
    p, work = prepared
    resources = prepare.train(p, work, tfidf=False)
    df = spark.createDataFrame([("x", None), ("y", ""), ("z", "my wifi")], "id string, text string")
    out = {r["query_id"]: r for r in triage(vectorise(df, resources, "id", "text"), PROPOSED, resources).collect()}
    assert set(out) == {"x", "y", "z"}
    assert out["x"]["intent"] is None and out["x"]["escalation_decision"] is None
    assert out["z"]["intent"] == "connectivity"


def test_stream(spark, prepared):
    p, work = prepared
    resources = prepare.train(p, work, tfidf=False)
    for i in range(2):
        spark.createDataFrame([(f"m{i}{j}", f"my wifi signal {j}") for j in range(3)], "id string, text string").coalesce(1) \
            .write.mode("append").parquet(work.path("inbox"))
    arriving = spark.readStream.schema("id string, text string").option("maxFilesPerTrigger", 1).parquet(work.path("inbox"))
    live.triage_stream(arriving, PROPOSED, resources, work.path("scored"), work.path("state")).awaitTermination()
    scored = spark.read.parquet(work.path("scored"))
    assert scored.count() == 6 and scored.select("batch").distinct().count() == 2
    batch = triage(vectorise(spark.read.parquet(work.path("inbox")), resources, "id", "text"), PROPOSED, resources)
    cols = ["query_id", "intent", "intent_confidence", "escalation_decision", "response"]
    assert sorted(map(tuple, scored.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))


def test_stream_packs_its_base_once(spark, prepared, monkeypatch):
    """Every batch stores its messages over those of the batch before; what they are searched in is packed once."""
    p, work = prepared
    resources = prepare.train(p, work, tfidf=False)
    for i in range(2):
        spark.createDataFrame([(f"m{i}", "my wifi signal")], "id string, text string").coalesce(1).write.mode("append").parquet(work.path("two"))
    staged, stage = [], Workspace.stage
    monkeypatch.setattr(Workspace, "stage", lambda self, name, *more: (staged.append(self.path(name)), stage(self, name, *more))[1])
    arriving = spark.readStream.schema("id string, text string").option("maxFilesPerTrigger", 1).parquet(work.path("two"))
    live.triage_stream(arriving, PROPOSED, resources, work.path("two_scored"), work.path("two_state")).awaitTermination()
    assert sorted(x.rsplit("/", 1)[1] for x in staged) == ["base-0", "base-1", "messages", "messages", "queries", "queries"]
    assert len(set(staged)) == 4 and spark.read.parquet(work.path("two_scored")).count() == 2


@pytest.mark.parametrize("timed", [False, True])
def test_first_seen(spark, work, timed):
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-01 00:01:00"), (3, "a", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "id int, text string, t string").select("id", "text", F.to_timestamp("t").alias("ts")) \
        .write.parquet(work.path("in"))
    stream = spark.readStream.schema("id int, text string, ts timestamp").parquet(work.path("in"))
    kept = live.first_seen(stream, "text", "ts" if timed else None)
    live.append_stream(kept, work.path("out"), work.path("state")).awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(work.path("out")).collect()) == ["a", "b"]


def test_sources(spark, work, tmp_path):
    kb = [{"id": "1", "customer_query": "q", "support_response": "r", "num_turns": 2}] * 2
    (tmp_path / "kb.json").write_text(json.dumps(kb))
    assert tables.read_json_array(spark, str(tmp_path / "kb.json"), tables.KNOWLEDGE_BASE).count() == 2
    for name in ("a_results", "b_results", "judge_results", "banking77_results"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"agent_name": name, "n": 1}, indent=2))
    got = tables.read_agent_results(spark, str(tmp_path))
    assert sorted(r["agent_name"] for r in got.collect()) == ["a_results", "b_results"]
    names = spark.createDataFrame([(0, "zero")], "label int, label_name string")
    (tmp_path / "x.csv").write_text("text,label\nhi,0\n")
    assert tables.read_labelled(spark, str(tmp_path / "missing"), names, "csv", str(tmp_path / "x.csv")).first()["label_name"] == "zero"
    spark.createDataFrame([("B", "c", "1"), ("C", "c", "2")], tables.TRANSCRIPTS).write.parquet(work.path("t"))
    assert tables.read_transcripts(spark, work.path("t"), "B").count() == 1


def test_reuse_depends_on_parameters(spark, work):
    built = []

    def build(n):
        built.append(n)
        return spark.range(n)

    assert work.once("t", {"n": 3}, lambda: build(3)).count() == 3
    assert work.once("t", {"n": 3}, lambda: build(3)).count() == 3
    assert work.once("t", {"n": 4}, lambda: build(4)).count() == 4
    assert built == [3, 4]


def test_vector_store(spark, work):
    kb = spark.createDataFrame([("1", "q", [1.0]), ("2", "p", [2.0])], "id string, customer_query string, vec array<double>")
    tables.write_vectors(kb, work.path("v"))
    back = tables.read_vectors(spark, kb.drop("vec"), work.path("v"))
    assert {r["id"]: r["vec"] for r in back.collect()} == {"1": [1.0], "2": [2.0]}


def test_main(spark, work, transcripts):
    transcripts.write.parquet(work.path("transcripts"))
    examples = spark.createDataFrame(
        [(f"where is card {i} of order {i % 7}" if i % 2 else f"pin code {i} is blocked", i % 2) for i in range(80)],
        "text string, label int")
    examples.write.parquet(work.path("labelled"))
    spark.createDataFrame([(0, "pin_blocked"), (1, "card_arrival")], "label int, label_name string").write.parquet(work.path("names"))
    run.main(["--transcripts", work.path("transcripts"), "--out", work.path("results"), "--brand", "Brand", "--quick",
              "--labelled", work.path("labelled"), "--label-names", work.path("names")])
    report = spark.read.json(work.path("results/cross_domain_report"))
    assert report.where("label = 'accuracy'").first()["f1"] == 1.0
    assert spark.read.json(work.path("results/predictions")).count() == 150
    assert spark.read.json(work.path("results/coverage")).first()["matched_intents"] == 2
    summary = spark.read.json(work.path("results/benchmark_summary")).first()
    assert summary["golden_set_size"] > 100 and summary["agents"]["trivial_baseline"]["false_auto_handle_rate"] == 1.0
    judged = spark.read.json(work.path("results/judge_document")).first()
    assert judged["num_evaluated"] == 50 and judged["judge_method"] == "heuristic"
    assert judged["aggregate_scores"]["actionability"]["max"] <= 5


TURNS = "conversation_id long, pos long, role string, text string"


def test_pairs_of_turns_in_any_order(spark, work):
    rng = random.Random(4)
    rows = [(c, p, rng.choice(["customer", "support", "support", "bot"]), f"a text of conversation {c} at turn {p}")
            for c in range(40) for p in range(rng.randrange(9))]
    rows += [(50, None, "customer", "a turn without a place in its conversation"), (50, 3, "customer", None), (50, 4, "support", "an answer to nothing at all"),
             (51, 2, "support", "an answer that came twice"), (51, 2, "support", "an answer that came twice"), (51, 1, "customer", "  a question with blanks around it ")]
    rng.shuffle(rows)
    for k in range(3):
        spark.createDataFrame(rows[k::3], TURNS).coalesce(1).write.mode("append").parquet(work.path("turns"))
    arriving = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(work.path("turns"))
    pairs.pair_stream(arriving, work.path("out"), work.path("state")).awaitTermination()
    got = sorted(map(tuple, pairs.latest_pairs(spark, work.path("out")).collect()))
    want = first_pairs_from_turns(spark.createDataFrame(rows, TURNS)).select("conversation_id", "first_customer_msg", "first_support_reply", "num_turns")
    assert got == sorted(map(tuple, want.collect())) and len(got) > 10
    assert spark.read.parquet(work.path("out")).select("batch").distinct().count() == 3


class Held:
    """State of one conversation, as a value and as a map."""

    def __init__(self):
        self.value, self.entries = None, {}
        self.exists, self.get = lambda: self.value is not None, lambda: self.value
        self.update, self.clear = lambda v: setattr(self, "value", v), lambda: self.__init__()
        self.iterator, self.removeKey = lambda: iter(list(self.entries.items())), lambda k: self.entries.pop(k)
        self.updateValue = lambda k, v: self.entries.update({k: v})
        self.getValueState = self.getMapState = lambda *names: Held()


@pytest.mark.parametrize("most", [1, 3, 10_000])
def test_state_of_a_conversation_takes_rows_one_by_one(monkeypatch, most):
    monkeypatch.setattr(pairs, "MOST_REPLIES", most, raising=False)
    rng = random.Random(most)
    for _ in range(300):
        rows = [Row(conversation_id=7, pos=rng.choice([None, *range(8)]), role=rng.choice(["customer", "support", "support"]),
                    text=rng.choice([None, "", "a", "ab", "é"])) for _ in range(rng.randrange(1, 14))]
        first = pairs.FirstPair(None)
        first.init(Held())
        for k in range(3):
            out = [x for part in [rows[k::3]] if part for x in first.handleInputRows((7,), iter(part), None)] or out
        best = lambda texts: max((t for t in texts if t is not None), default=None)
        asked_at = min((r.pos for r in rows if r.role == "customer" and r.pos is not None), default=None)
        theirs = [r for r in rows if r.role == "support" and r.pos is not None]
        at = min((r.pos for r in theirs if asked_at is not None and r.pos > asked_at), default=None)
        asked = best(r.text for r in rows if r.role == "customer" and r.pos is not None and r.pos == asked_at)
        answer = best(r.text for r in theirs if r.pos == at)
        assert [tuple(r) for r in out] == [(7, min(len(rows), 3), asked_at, asked, at, answer, len(rows), False)]
        assert first.replies.entries == {(r.pos,): (best(x.text for x in theirs if x.pos == r.pos),)
                                         for r in theirs if at is None or r.pos <= at}


def test_idle_conversations_are_closed(spark, work):
    def arrive(*rows):
        spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(work.path("turns"))

    def closed():
        return {(r.conversation_id, r.num_turns) for r in spark.read.schema(out).parquet(work.path("out")).where("closed").collect()}

    out = pairs.PAIR.format(kind="bigint")
    arrive((1, 5, "customer", "where is the parcel I ordered?"), (1, 6, "support", "it is on its way to you"))
    arriving = spark.readStream.schema(TURNS).parquet(work.path("turns"))
    with pytest.raises(ValueError):
        pairs.pair_stream(arriving, work.path("out"), work.path("state"), idle_ms=1, trigger={"availableNow": True})
    stream = pairs.pair_stream(arriving, work.path("out"), work.path("state"), idle_ms=1, trigger={"processingTime": "1 second"})
    try:
        for want, late in ((1, 2), [(1, 1, "customer", "a question that comes too late"), (1, 2, "support", "an answer that comes too late"),
                                    (1, 3, "support", "another that comes too late")]), ((1, 3), []):
            ends = time.time() + 60
            while time.time() < ends and not (os.path.exists(f"{work.path('out')}/batch=0/_SUCCESS") and want in closed()):
                time.sleep(0.5)
            assert want in closed()
            if late:
                arrive(*late)
    finally:
        stream.stop()
    assert [tuple(r) for r in pairs.latest_pairs(spark, work.path("out")).collect()] == [
        (1, "where is the parcel I ordered?", "it is on its way to you", 2)]


def test_streams_read_tables_that_are_folders(spark, work):
    from relaydesk.catalog import queries

    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id long, text string")
    talk = [(c, t, "user" if t % 2 == 0 else "assistant", f"a text of conversation {c} at turn {t}") for c in range(30) for t in range(4)]
    turns = spark.createDataFrame(talk, "conv_id long, turn int, role string, text string")
    for name, table in (("documents", docs), ("conversations", turns)):
        table.repartition(3).write.parquet(work.path(f"in/{name}.parquet"))
    assert queries.stream_first_seen(spark, work.path("in")).count() == 7
    assert queries.stream_pairs(spark, work.path("in")).count() == 30
    assert queries._stream(spark, work.path("in"), "conversations").isStreaming


@pytest.mark.parametrize("vocab, min_df, more", [(5, 1, 4096), (12, 2, 4096), (12, 2, 1), (60, 3, 0), (10_000, 2, 4096)])
def test_vocabulary_counts_pairs_of_frequent_words(spark, monkeypatch, vocab, min_df, more):
    rng = random.Random(vocab)
    rows = [[f"w{min(int(rng.paretovariate(0.8)), 40)}é" for _ in range(rng.randrange(30))] for _ in range(80)] + [["aa"] * 30, ["aa", "bb"] * 20, []]
    counts = [w + [f"{x} {y}" for x, y in zip(w, w[1:])] for w in rows]
    tf, df = Counter(t for r in counts for t in r), Counter(t for r in counts for t in set(r))
    want = sorted((-n, t, df[t]) for t, n in tf.items() if df[t] >= min_df)[:vocab]
    monkeypatch.setattr(textmodel, "MORE_WORDS", more)
    table = spark.createDataFrame([(r, c) for r, c in zip(rows, counts)], "words array<string>, terms array<string>").repartition(3)
    got = textmodel.vocabulary(table.select("words"), table.select("terms"), vocab, min_df)
    assert [(-r["tf"], r["term"], r["df"]) for r in got] == want
