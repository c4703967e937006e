"""The whole run: prepare, train, triage with three configurations, evaluate, judge, summarise.

    spark-submit run.py --transcripts IN --out OUT [--brand B] [--quick]
        [--skip-judge] [--labelled PATH --label-names PATH] [--no-labelled] [--human-scores PATH]
"""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import datasets, metrics, rubric
from ..operators.sampling import class_samples, first_shuffled, stratified_split
from ..operators.textmodel import classify_tfidf, fit_classifier
from ..rules import SUPPORT_PACK, RulePack
from ..sources import tables
from ..sources.workspace import Workspace
from .configs import CONFIGS, Resources, TriageConfig
from .evaluate import (
    agent_documents, agent_metrics, aligned, benchmark_long, judge_document, judged, summary_document,
)
from .prepare import Prepared, prepare, prepare_pairs, train
from .triage import triage, vectorise, with_cases


@dataclass(frozen=True)
class Evaluated:
    predictions: DataFrame
    rows: DataFrame
    wide: DataFrame


def evaluate_all(golden: DataFrame, resources: Resources, work: Workspace,
                 configs: tuple[TriageConfig, ...] = CONFIGS, parity: bool = False) -> Evaluated:
    """Every configuration over the golden set. Vectors and retrieved cases are computed once."""
    if parity:
        configs = tuple(c.parity() for c in configs)
    queries = work.stage("query_vectors", vectorise(golden, resources, "id", "customer_tweet"))
    cases, predictions = {}, None
    for config in configs:
        key = (config.top_k, config.exclude_self)
        if key not in cases:
            cases[key] = work.stage(f"retrieved_{len(cases)}", with_cases(queries, resources, config))
        part = triage(queries, config, resources, cases[key])
        predictions = part if predictions is None else predictions.unionByName(part)
    predictions = work.stage("predictions", predictions)
    rows = aligned(predictions, golden)
    return Evaluated(predictions, rows, work.stage("agent_metrics", agent_metrics(rows, resources.encoder)))


def analyse_labelled(examples: DataFrame, class_map: DataFrame) -> dict[str, DataFrame]:
    """Statistics, mapping and samples of a labelled (text, label_name) dataset."""
    counts = datasets.label_counts(examples)
    mapped = datasets.map_examples(examples, class_map)
    return {
        "statistics": datasets.label_stats(examples),
        "label_counts": counts.orderBy(F.desc("n"), "label_name"),
        "mapped_distribution": datasets.mapped_distribution(counts, class_map),
        "unmapped": datasets.unmapped_labels(counts, class_map),
        "coverage": datasets.map_coverage(counts, class_map),
        "longest_labels": datasets.length_by_label(examples),
        "samples": class_samples(mapped, "intent", ["label_name", "text"]),
    }


def cross_domain(examples: DataFrame, class_map: DataFrame, id_col: str, work: Workspace,
                 max_iter: int = 1000) -> DataFrame:
    """Report of a classifier trained on four fifths of the mapped dataset, scored on the rest."""
    mapped = datasets.map_examples(examples, class_map).select(
        F.col(id_col).alias("id"), "text", F.col("intent").alias("label")
    )
    split = work.stage("split", stratified_split(mapped, "label", "id"))
    model = fit_classifier(
        split.where(F.col("split") == "train").select("text", "label"),
        vocab=3000, min_df=1, stop_words=False, max_iter=max_iter, work=work, name="split_vectors",
    )
    predicted = classify_tfidf(split.where(F.col("split") == "test"), model, "text")
    return metrics.full_report(metrics.confusion_counts(predicted, "label", "intent"))


def run_tables(prepared: Prepared, work: Workspace, pack: RulePack = SUPPORT_PACK, quick: bool = False,
               skip_judge: bool = False, judge_n: int | None = None, parity: bool = False,
               human_scores: DataFrame | None = None, max_iter: int = 1000) -> dict[str, DataFrame]:
    """All result tables of a run over prepared data."""
    golden = prepared.golden_set
    if quick:
        golden = work.stage("golden_quick", first_shuffled(golden, 50))
    resources = train(prepared, work, pack, leakage_guard=not parity, max_iter=max_iter)
    done = evaluate_all(golden, resources, work, parity=parity)
    long = work.stage("benchmark_long", benchmark_long(done.wide))
    names = [c.agent_name for c in CONFIGS]
    out = {
        "predictions": done.predictions,
        "agent_metrics": done.wide,
        "agent_documents": agent_documents(done.rows, done.wide),
        "benchmark": long,
        "comparison": metrics.compare_agents(long, names),
    }
    if not skip_judge:
        proposed = done.rows.where(F.col("agent_name") == CONFIGS[2].agent_name)
        scores = work.stage("judge_scores", judged(proposed, judge_n).select(
            "golden_id", *rubric.DIMS, "reasoning", "judge_method"))
        out["judge_scores"] = scores
        out["judge_summary"] = rubric.judge_summary(scores)
        out["pass_rate"] = rubric.pass_rate(scores)
        out["judge_document"] = judge_document(scores)
        if human_scores is not None:
            out["agreement"] = rubric.agreement(scores, human_scores, "golden_id")
    return out


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--transcripts", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--brand", help="only transcripts of this brand")
    parser.add_argument("--max-conversations", type=int, help="no limit unless given")
    parser.add_argument("--max-pairs", type=int, help="no limit unless given")
    parser.add_argument("--judge-rows", type=int, help="golden rows to judge, all unless given")
    parser.add_argument("--quick", action="store_true")
    parser.add_argument("--skip-judge", action="store_true")
    parser.add_argument("--parity", action="store_true", help="train on and retrieve golden rows")
    parser.add_argument("--human-scores")
    parser.add_argument("--labelled")
    parser.add_argument("--label-names")
    parser.add_argument("--no-labelled", action="store_true")
    args = parser.parse_args(argv)

    started = time.time()
    spark = SparkSession.builder.appName("relaydesk").getOrCreate()
    work = Workspace(spark)
    transcripts = tables.read_transcripts(spark, args.transcripts)
    prepared = prepare(transcripts, work, brand=args.brand,
                       max_conversations=args.max_conversations or None,
                       max_pairs=args.max_pairs or None)
    human = spark.read.parquet(args.human_scores) if args.human_scores else None
    results = run_tables(prepared, work, quick=args.quick, skip_judge=args.skip_judge, judge_n=args.judge_rows,
                         parity=args.parity, human_scores=human)
    results |= {"golden_set": prepared.golden_set, "knowledge_base": prepared.knowledge_base,
                "judge_subset": prepared.judge_subset}
    if args.labelled and not args.no_labelled:
        names = spark.read.parquet(args.label_names)
        examples = work.stage("labelled", tables.read_labelled(spark, args.labelled, names).withColumn(
            "example_id", F.md5(F.concat_ws("|", "label_name", "text"))))
        mapping = datasets.class_map_table(spark)
        results |= analyse_labelled(examples, mapping)
        results["cross_domain_report"] = cross_domain(examples, mapping, "example_id", work)
    for name, table in results.items():
        tables.write_json(table, f"{args.out}/{name}")
    tables.write_json(
        summary_document(results["benchmark"], prepared.golden_set, prepared.knowledge_base, time.time() - started),
        f"{args.out}/benchmark_summary",
    )
