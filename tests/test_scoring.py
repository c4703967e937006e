"""Metrics, rubric, agreement and text overlap against hand-derived answers."""

import json
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relaydesk import fixed_values as fv
from relaydesk.operators import metrics, overlap, rubric

LABELS = ["account_security", "battery_power", "billing_store", "connectivity", "hardware_damage",
          "software_troubleshooting"]
MATRIX = [[26, 1, 1, 0, 0, 5], [0, 28, 0, 0, 2, 3], [0, 0, 28, 0, 0, 5], [0, 0, 0, 26, 1, 7], [0, 0, 0, 0, 25, 8],
          [0, 1, 0, 0, 0, 33]]


def counts(spark, cells):
    return spark.createDataFrame(cells, "truth string, pred string, n long")


def test_known_confusion(spark):
    c = counts(spark, [(LABELS[i], LABELS[j], n) for i, row in enumerate(MATRIX) for j, n in enumerate(row) if n])
    s = metrics.summary(c).first()
    assert (s["accuracy"], s["macro_precision"], s["macro_recall"], s["macro_f1"]) == (0.83, 0.8888, 0.8296, 0.8424)
    rows = {r["label"]: r for r in metrics.per_class(c).collect()}
    assert (rows["software_troubleshooting"]["precision"], rows["software_troubleshooting"]["f1"]) == (0.541, 0.6947)
    assert [rows[x]["support"] for x in LABELS] == [33, 33, 33, 34, 33, 34]
    matrix = {r["truth"]: [r[x] for x in LABELS] for r in metrics.confusion_matrix(c, LABELS).collect()}
    assert [matrix[x] for x in LABELS] == MATRIX
    assert metrics.full_report(c).where("label = 'accuracy'").first()["f1"] == 0.83


def test_label_domains(spark):
    c = counts(spark, [("sw", "sw", 1), ("bat", "bat", 1), ("bat", "conn", 1)])
    assert {r["label"] for r in metrics.per_class(c).collect()} == {"sw", "bat"}
    s = metrics.summary(c).first()
    assert s["accuracy"] == 0.6667 and s["macro_f1"] == round((1 + 2 / 3 + 0) / 3, 4)
    assert metrics.confusion_cells(c).count() == 2


@pytest.mark.parametrize("cells, expected", [
    ([("E", "E", 86), ("E", "A", 23), ("A", "E", 3), ("A", "A", 88)], (0.87, 0.9663, 0.789, 0.8687, 0.211, 0.033, 23, 3)),
    ([("E", "A", 109), ("A", "A", 91)], (0.455, 0.0, 0.0, 0.0, 1.0, 0.0, 109, 0)),
    ([("A", "A", 1), ("E", "E", 1), ("E", "A", 1), ("A", "E", 1)], (0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 1, 1)),
    ([("A", "A", 4)], (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0)),
])
def test_escalation_metrics(spark, cells, expected):
    out = metrics.escalation_metrics(counts(spark, cells), positive="E", negative="A").first()
    assert tuple(out) == expected


def test_unmatched_and_compare(spark):
    a, b = spark.range(5).toDF("k"), spark.range(2, 9).toDF("k")
    assert {r["side"]: r["n"] for r in metrics.unmatched(a, b, "k").collect()} == {"prediction": 2, "gold": 4}
    long = spark.createDataFrame([("x", "f1", 0.5), ("y", "f1", 0.5), ("x", "false_auto_handle_rate", 0.4),
                                  ("y", "false_auto_handle_rate", 0.1)], "agent string, metric string, value double")
    best = {r["metric"]: r["best_agent"] for r in metrics.compare_agents(long, ["y", "x"]).collect()}
    assert best == {"f1": "y", "false_auto_handle_rate": "y"}


def test_heuristic_judge(spark):
    df = spark.createDataFrame([
        (1, "We understand. Try a restart, then check settings. DM us", "try a restart then dm us", "ESCALATE"),
        (2, "send your password", "x", "AUTO_HANDLE"), (3, "no", "", "ESCALATE"), (4, "", "a b", "AUTO_HANDLE")],
        "id int, response string, reference string, decision string")
    rows = {r["id"]: [r[d] for d in rubric.DIMS] for r in
            rubric.heuristic_scores(df, "response", "reference", "decision").collect()}
    assert rows[1] == [5, 5, 3, 5]
    assert rows[2] == [1, 2, 2, 1]
    assert rows[3] == [1, 2, 2, 3]
    assert rows[4] == [1, 2, 2, 5]


def reply(**kw):
    base = dict(factual_grounding=4, actionability=3.9, tone_empathy=9, safety_escalation=-3, reasoning="ok")
    return json.dumps({k: v for k, v in {**base, **kw}.items() if v != "drop"})


@pytest.mark.parametrize("content, expected", [
    (reply(), [4, 3, 5, 1]),
    ("text\n```json\n" + reply() + "\n```\nmore", [4, 3, 5, 1]),
    ("```\n" + reply() + "```", [4, 3, 5, 1]),
    (reply(tone_empathy="drop"), None),
    (reply(tone_empathy="4"), None),
    (reply(tone_empathy=None), None),
    (reply(tone_empathy=True), [4, 3, 1, 1]),
    (reply(tone_empathy=1e20), [4, 3, 5, 1]), (reply(tone_empathy=-1e300), [4, 3, 1, 1]), (reply(tone_empathy=float("nan")), None),
    ("no json", None), ("", None), (None, None), ("[1]", None), (reply(reasoning="drop"), [4, 3, 5, 1]),
])
def test_judge_reply(spark, content, expected):
    df = spark.createDataFrame([(content,)], "content string")
    parsed = rubric.parse_judge_replies(df, "content").first()["parsed"]
    assert (None if parsed is None else [parsed[d] for d in rubric.DIMS]) == expected


def scores(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{d} int" for d in rubric.DIMS))


def test_agreement(spark):
    ours = scores(spark, [(1, 2, 5, 5), (2, 3, 5, 5), (4, 4, 4, 5), (5, 5, 3, 5)])
    theirs = scores(spark, [(1, 3, 4, 4), (2, 2, 5, 5), (4, 4, 4, 5), (5, 3, 3, 5)])
    rows = {r["dim"]: r for r in rubric.agreement(ours, theirs, "id").collect()}
    assert rows["factual_grounding"]["spearman_rho"] == 1.0 and rows["factual_grounding"]["exact_agreement"] == 1.0
    # ranks 1,2,3,4 against 2.5,1,4,2.5
    assert rows["actionability"]["spearman_rho"] == 0.3162
    assert rows["actionability"]["within_1_agreement"] == 0.75
    assert rows["safety_escalation"]["pearson_r"] == 0.0  # constant side
    # pass: ours f,f,t,t theirs f,f,t,t
    assert rows["overall"]["cohens_kappa"] == 1.0 and rows["overall"]["pass_fail_agreement"] == 1.0


def test_kappa_without_variation(spark):
    same = scores(spark, [(5, 5, 5, 5)] * 3)
    row = rubric.agreement(same, same, "id").where("dim = 'overall'").first()
    assert row["cohens_kappa"] is None and row["spearman_rho"] == 0.0


def test_summary_and_pass_rate(spark):
    s = scores(spark, [(3, 3, 4, 4), (2, 5, 5, 5), (5, 5, 5, 5), (1, 1, 1, 1)])
    row = rubric.pass_rate(s).first()
    assert (row["num_evaluated"], row["pass_count"], row["pass_rate"]) == (4, 2, 0.5)
    f = rubric.judge_summary(s).where("dim = 'factual_grounding'").first()
    assert (f["mean"], f["std"], f["min"], f["max"]) == (2.75, 1.479, 1, 5)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_overlap(spark):
    import random

    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("abcdefg") + rng.choice(["", ".", "'"]) for _ in range(rng.randint(0, 90))),
              " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90)))) for i in range(40)]
    texts += [(100, "", ""), (101, "A b", ""), (102, "x", "x")]
    df = spark.createDataFrame(texts, "id int, g string, r string")
    rows = {r["id"]: r for r in overlap.overlap_scores(df, "id", "g", "r").collect()}
    assert len(rows) == len(texts)
    from collections import Counter

    def f1(c, h, r):
        return round(2 * c / (h + r), 4) if c else 0.0

    for i, g, r in texts:
        import re

        h, t = re.findall("[a-z0-9]+", g.lower()), re.findall("[a-z0-9]+", r.lower())
        common = sum((Counter(h) & Counter(t)).values())
        pairs = lambda x: Counter(zip(x, x[1:]))
        common2 = sum((pairs(h) & pairs(t)).values())
        hw, tw = g.lower().split(), r.lower().split()
        bleu = min(1, len(hw) / len(tw)) * sum((Counter(hw) & Counter(tw)).values()) / len(hw) if hw and tw else 0.0
        got = rows[i]
        want = (f1(common, len(h), len(t)), f1(common2, max(len(h) - 1, 0), max(len(t) - 1, 0)), f1(lcs(h, t), len(h), len(t)), bleu)
        assert [got[c] for c in ("rouge1", "rouge2", "rougeL", "unigram_bleu")] == pytest.approx(want, abs=1.1e-4), i


def test_constants():
    assert len(fv.ACTION_WORDS) == 16 and len(fv.EMPATHY_WORDS) == 9


def test_shared_tokens_are_counted_in_pieces(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.choice("abcde") for _ in range(rng.randrange(9))], [rng.choice("abcde") for _ in range(rng.randrange(9))]) for i in range(200)]
    rows.append((200, ["a"] * 500, ["a"] * 300))
    df = spark.createDataFrame(rows, "id long, x array<string>, y array<string>").coalesce(1)
    got = {r.id: (r.n, r.m) for r in df.select("id", overlap.shared_count(F.col("x"), F.col("y")).alias("n"), overlap.lcs_length(F.col("x"), F.col("y")).alias("m")).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: (Counter(x) & Counter(y)).total() for i, x, y in rows}
    assert got[200][1] == 300
    sizes, whole = [], overlap._shared
    monkeypatch.setattr(overlap, "PIECE_TOKENS", 40)
    monkeypatch.setattr(overlap, "_shared", lambda x, y: sizes.append(len(x.flatten()) + len(y.flatten())) or whole(x, y))
    x, y = (pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in (1, 2))
    assert overlap._in_pieces(x, y).to_pylist() == [(Counter(r[1]) & Counter(r[2])).total() for r in rows]
    assert sizes[-1] == 800 and max(sizes[:-1]) <= 40
