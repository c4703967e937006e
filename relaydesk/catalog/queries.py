"""Registered queries: each operator over the given tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..operators import (
    datasets, dense_index, escalation, intents, metrics, neighbours, overlap, replies, rubric, sampling, sparse_index, textmodel,
    transcripts,
)
from ..plans import evaluate, prepare, run
from ..plans.configs import CONFIGS, PROPOSED, Resources
from ..plans.triage import triage, vectorise
from ..rules import SUPPORT_PACK
from ..sources import tables
from ..sources.workspace import Workspace
from ..streaming import live
from ..streaming.pairs import latest_pairs, pair_stream
from .inputs import (
    PACK, SOURCE_MAP, documents, labelled_docs, language_guesses, messages, pairs, read, reply_pairs, turn_id, turns,
    vectors,
)
from .inputs import transcripts as raw_transcripts

REGISTRY = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


# -- sources, parsing, knowledge base --------------------------------------------

@query
def scan_filter(spark, d):
    docs = read(spark, d, "documents").select("lang", "doc_id", "n_chars")
    return docs.where(F.col("lang") == "fr").orderBy("doc_id").limit(100)


@query
def labelled_load(spark, d):
    names = spark.createDataFrame([(0, "poor"), (1, "good")], "label int, label_name string")
    examples = read(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return datasets.decode_labels(examples, names).join(
        read(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id"
    )


@query
def parse_turns(spark, d):
    return transcripts.parse_turns(raw_transcripts(spark, d))


@query
def transcript_first_pair(spark, d):
    return transcripts.extract_conversations(raw_transcripts(spark, d)).select(
        "conversation_id", "first_customer_msg", "first_support_reply", "num_turns"
    )


@query
def brand_conversations(spark, d):
    return transcripts.extract_conversations(
        raw_transcripts(spark, d), brand="de", max_conversations=50
    ).select("conversation_id", "first_customer_msg", "num_turns")


@query
def first_pair(spark, d):
    return transcripts.first_pairs_from_turns(turns(spark, d))


def _docs_as_conversations(spark, d):
    return read(spark, d, "documents").select(
        F.col("doc_id").alias("conversation_id"),
        F.col("text").alias("first_customer_msg"),
        F.col("source").alias("first_support_reply"),
        F.size(F.split("text", "\n")).alias("num_turns"),
    )


@query
def kb_dedup(spark, d):
    kb = transcripts.build_knowledge_base(_docs_as_conversations(spark, d))
    return kb.select("id", F.md5("customer_query").alias("msg_md5"), "support_response", "num_turns")


@query
def kb_capped(spark, d):
    kb = transcripts.build_knowledge_base(_docs_as_conversations(spark, d), max_pairs=300)
    return kb.select("id", F.md5("customer_query").alias("msg_md5"), "support_response", "num_turns")


# -- intent and gold labels --------------------------------------------------------

def _labelled(spark, d, pack=PACK):
    t = read(spark, d, "conversations")
    scored = intents.label_intents(t, "text", pack)
    return scored.withColumn(
        "difficulty_tag",
        intents.difficulty(F.col("text"), F.col("intent_confidence"), F.col("n_intents"), pack),
    )


@query
def keyword_label(spark, d):
    return _labelled(spark, d).select(
        "conv_id", "turn", "intent", "intent_confidence", "n_intents", "difficulty_tag",
        F.array_join("hits", ",").alias("hits"),
    )


@query
def keyword_label_support(spark, d):
    return _labelled(spark, d, SUPPORT_PACK).select(
        "conv_id", "turn", "intent", "intent_confidence", "n_intents", "difficulty_tag"
    )


@query
def keyword_matches(spark, d):
    hits = intents.keyword_matches(documents(spark, d), "text", PACK, ["doc_id"])
    return hits.groupBy("intent", "kw").agg(F.count("*").alias("n_docs"))


@query
def keyword_matches_table(spark, d):
    hits = intents.keyword_matches_table(documents(spark, d), "text", PACK.keyword_table(spark), "doc_id")
    return hits.groupBy("intent", "kw").agg(F.count("*").alias("n_docs"))


@query
def gold_decision(spark, d):
    return intents.gold_escalation(_labelled(spark, d), "text", PACK).select(
        "conv_id", "turn", "gold_escalation", "gold_escalation_reason"
    )


def _golden_records(spark, d):
    return intents.golden_records(pairs(spark, d), PACK)


@query
def golden_records(spark, d):
    return _golden_records(spark, d).select(
        "id", "gold_intent", "intent_confidence", "gold_escalation", "gold_escalation_reason",
        "difficulty_tag", "num_turns",
    )


@query
def distributions(spark, d):
    return intents.distributions(_golden_records(spark, d))


@query
def facet_search(spark, d):
    found = intents.facet_search(_golden_records(spark, d), "ON", intent="software_troubleshooting",
                                 difficulty_tag="multi_intent")
    return found.select("id", "gold_intent", "difficulty_tag")


@query
def train_union(spark, d):
    kb = transcripts.build_knowledge_base(pairs(spark, d))
    rows = intents.training_rows(kb, _golden_records(spark, d), PACK)
    return rows.select("id", "label", F.md5("text").alias("text_md5"))


# -- escalation ------------------------------------------------------------------

def _documents_with_intent(spark, d):
    return intents.label_intents(documents(spark, d), "text", PACK)


def _flat(df, *keys):
    return df.select(
        *keys, "escalation.decision", "escalation.reason",
        F.array_join("escalation.factors", ",").alias("factors"), "escalation.risk_score",
    )


@query
def escalation_factors(spark, d):
    similarity = F.round((F.col("n_chars") % 97) / 97.0, 4)
    return _flat(
        escalation.decide_by_factors(_documents_with_intent(spark, d), PACK, "text", similarity=similarity), "doc_id"
    )


@query
def escalation_support(spark, d):
    docs = intents.label_intents(documents(spark, d), "text", SUPPORT_PACK)
    return _flat(escalation.decide_by_factors(docs, SUPPORT_PACK, "text"), "doc_id")


@query
def matched_patterns(spark, d):
    docs = documents(spark, d)
    folded = docs.withColumn("__folded", tx.folded(F.col("text")))  # once for all searches
    return folded.select("doc_id", *[
        F.array_join(escalation.matched_patterns(F.col("text"), f.patterns, F.col("__folded")), " ; ").alias(f.name.lower())
        for f in PACK.factors
    ])


@query
def keyword_escalation(spark, d):
    return _flat(escalation.decide_by_keywords(documents(spark, d), PACK, "text"), "doc_id")


@query
def always_auto(spark, d):
    return _flat(escalation.decide_always_auto(read(spark, d, "documents"), "text"), "doc_id")


@query
def majority(spark, d):
    return datasets.majority_class(labelled_docs(spark, d), "label_name")


# -- samples -----------------------------------------------------------------------

def _golden_sample(spark, d):
    return sampling.golden_sample(_golden_records(spark, d), target=64, seed=42, method="md5")


@query
def golden_sample(spark, d):
    return _golden_sample(spark, d).select(
        "golden_id", "id", "gold_intent", "difficulty_tag", "sampling_stratum"
    )


@query
def judge_subset(spark, d):
    return sampling.judge_subset(_golden_sample(spark, d), n=20, method="md5").select(
        "golden_id", "gold_intent"
    )


@query
def judge_placeholders(spark, d):
    records = _golden_records(spark, d).withColumn("human_scores", sampling.null_scores())
    return records.select("id", *[F.col(f"human_scores.{x}").alias(x) for x in
                                  (*fv.DIMENSIONS, "overall_pass")])


@query
def stratified_split(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang")
    return sampling.stratified_split(docs, "lang", "doc_id", method="md5")


@query
def class_samples(spark, d):
    mapped = datasets.map_examples(labelled_docs(spark, d), datasets.class_map_table(spark, SOURCE_MAP))
    return sampling.class_samples(mapped, "intent", ["label_name", "doc_id"]).select(
        "intent", "label_name", "doc_id", "sample_no"
    )


# -- second dataset ------------------------------------------------------------------

@query
def label_counts(spark, d):
    return datasets.label_counts(labelled_docs(spark, d)).orderBy(F.desc("n"), "label_name")


@query
def label_stats(spark, d):
    return datasets.label_stats(labelled_docs(spark, d))


@query
def mapped_distribution(spark, d):
    return datasets.mapped_distribution(
        datasets.label_counts(labelled_docs(spark, d)), datasets.class_map_table(spark, SOURCE_MAP))


@query
def map_coverage(spark, d):
    return datasets.map_coverage(
        datasets.label_counts(labelled_docs(spark, d)), datasets.class_map_table(spark, SOURCE_MAP))


@query
def unmapped(spark, d):
    return datasets.unmapped_labels(
        datasets.label_counts(labelled_docs(spark, d)), datasets.class_map_table(spark, SOURCE_MAP))


@query
def len_by_label(spark, d):
    return datasets.length_by_label(labelled_docs(spark, d), top=10)


@query
def label_union(spark, d):
    docs = read(spark, d, "documents")
    seen = docs.select(F.col("source").alias("label")).union(
        datasets.class_map_table(spark, SOURCE_MAP).select("src_intent"))
    return seen.distinct().orderBy("label")


# -- vectors -------------------------------------------------------------------------

@query
def centroids(spark, d):
    c = neighbours.centroids(vectors(spark, d))
    return c.select("label", F.posexplode("centroid").alias("dim", "value")).select(
        "label", "dim", F.round("value", 4).alias("value"))


def _knn(spark, d, search=neighbours.nearest, **kw):
    v = vectors(spark, d)
    return search(v.withColumnRenamed("id", "query_id"), v, 5, exclude_self=True, **kw)


@query
def knn_topk(spark, d):
    return _knn(spark, d).withColumn("similarity", F.round("similarity", 4))


@query
def knn_pruned(spark, d):
    hits = _knn(spark, d, neighbours.nearest_pruned, pivots=16, block_rows=256)
    return hits.withColumn("similarity", F.round("similarity", 4))


@query
def knn_vote(spark, d):
    votes = neighbours.label_votes(_knn(spark, d), vectors(spark, d))
    return votes.select("query_id", "label", F.round("vote", 4).alias("vote"))


@query
def centroid_scores(spark, d):
    v = vectors(spark, d)
    scored = neighbours.centroid_scores(v, neighbours.centroids(v))
    return scored.select("id", F.explode("centroid_scores").alias("s")).select(
        "id", "s.label", F.round("s.score", 4).alias("score"))


@query
def blend(spark, d):
    v = vectors(spark, d)
    out = neighbours.classify_blend(v.select(F.col("id").alias("query_id"), "vec"), v)
    return out.select("query_id", F.col("intent").alias("label"),
                      F.round("intent_confidence", 4).alias("confidence"))


@query
def one_query_topk(spark, d):
    v = vectors(spark, d)
    first = v.where(F.col("id") == 0).select("vec").first()["vec"]
    return neighbours.one_query_top_k(v, first, 10).withColumn("similarity", F.round("similarity", 4))


def _vector_pairs(spark, d):
    v = vectors(spark, d)
    after = v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("ref_vec"))
    return neighbours.pair_similarity(v.join(after, "id"), "vec", "ref_vec")


@query
def pair_similarity(spark, d):
    return _vector_pairs(spark, d).select("id", F.round("similarity", 4).alias("similarity"))


@query
def pair_similarity_mean(spark, d):
    return overlap.quality_means(_vector_pairs(spark, d).select("similarity"))


# -- metrics -------------------------------------------------------------------------

def _guess_counts(spark, d, by=None):
    guesses = language_guesses(spark, d)
    if by is None:
        guesses = guesses.where(F.col("agent_name") == "words")
    return metrics.confusion_counts(guesses, "truth", "pred", by)


@query
def classify_metrics(spark, d):
    return metrics.per_class(_guess_counts(spark, d))


@query
def classify_summary(spark, d):
    return metrics.summary(_guess_counts(spark, d))


@query
def confusion(spark, d):
    return metrics.confusion_cells(_guess_counts(spark, d))


@query
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(_guess_counts(spark, d), ["de", "en", "es", "fr"])


@query
def truth_labels(spark, d):
    return metrics.truth_labels(_guess_counts(spark, d))


@query
def report(spark, d):
    return metrics.full_report(_guess_counts(spark, d))


def _decisions(spark, d):
    docs = documents(spark, d)
    decided = escalation.decide_by_keywords(docs, PACK, "text").select(
        "doc_id", F.col("escalation.decision").alias("pred"))
    truth = read(spark, d, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "ESCALATE").otherwise("AUTO_HANDLE").alias("truth"))
    return decided, truth


@query
def binary_metrics(spark, d):
    decided, truth = _decisions(spark, d)
    return metrics.escalation_metrics(
        metrics.confusion_counts(metrics.align(decided, truth, "doc_id"), "truth", "pred"))


@query
def align_metrics(spark, d):
    decided, truth = _decisions(spark, d)
    return metrics.unmatched(decided, truth, "doc_id")


def _agents_long(spark, d):
    by = ["agent_name"]
    counts = _guess_counts(spark, d, by)
    wide = metrics.summary(counts, by).join(
        metrics.escalation_metrics(counts, by, positive="fr", negative="en").select(
            *by, "false_auto_handle_rate"), by)
    return metrics.to_long(wide, "agent_name", ["accuracy", "macro_f1", "false_auto_handle_rate"])


@query
def benchmark_summary(spark, d):
    return metrics.benchmark_table(_agents_long(spark, d), ["accuracy", "macro_f1", "false_auto_handle_rate"])


@query
def compare_agents(spark, d):
    return metrics.compare_agents(_agents_long(spark, d), ["words", "letters", "constant"])


# -- replies ---------------------------------------------------------------------------

def _messages_with_cases(spark, d):
    asked = intents.label_intents(messages(spark, d), "text", PACK)
    known = pairs(spark, d).select(
        F.col("conversation_id").alias("id"),
        F.array(F.struct(
            F.col("first_customer_msg").alias("customer_query"),
            F.col("first_support_reply").alias("support_response"),
            F.round(F.length("first_customer_msg") / (F.length("first_customer_msg") + F.length("first_support_reply")), 2).alias("similarity"),
            F.col("conversation_id").cast("string").alias("id"),
        )).alias("retrieved_cases"),
    )
    joined = asked.join(known, "id", "left")
    return escalation.decide_by_factors(joined, PACK, "text")


@query
def template_reply(spark, d):
    out = replies.template_reply(_messages_with_cases(spark, d), PACK, "text", "id", method="md5")
    return out.select("id", "response", "response_method", F.array_join("grounding_sources", ",").alias("grounding"))


@query
def nn_reply(spark, d):
    out = replies.nearest_reply(_messages_with_cases(spark, d))
    return out.select("id", "response", "response_method", F.array_join("grounding_sources", ",").alias("grounding"))


@query
def canned(spark, d):
    out = replies.canned_reply(messages(spark, d))
    return out.select("id", "response", "response_method", F.array_join("grounding_sources", ",").alias("grounding"))


@query
def issue_types(spark, d):
    t = replies.issue_type(F.col("text"), PACK_ISSUES)
    return documents(spark, d).select("doc_id", t.alias("issue_type"))


PACK_ISSUES = replace(PACK, issue_types=(
    ("first", ("thble", "schie")), ("second", ("queau", "erwh")), ("third", ("stre",))))


@query
def prompts(spark, d):
    m = _messages_with_cases(spark, d)
    prompt = replies.reply_prompt(F.col("text"), F.col("intent"), F.col("escalation.decision"),
                                  F.col("escalation.reason"), F.col("retrieved_cases"))
    return m.select("id", F.md5(prompt).alias("prompt_md5"), F.length(prompt).alias("prompt_len"))


@query
def judge_prompts(spark, d):
    r = reply_pairs(spark, d)
    prompt = replies.judge_prompt(F.lit("none"), F.col("response"), F.lit("unknown"), F.col("decision"),
                                  F.lit("-"), F.col("reference"))
    return r.select("id", F.md5(prompt).alias("prompt_md5"), F.length(prompt).alias("prompt_len"))


# -- rubric and agreement ----------------------------------------------------------------

def _scores(spark, d, response="response", reference="reference"):
    return rubric.heuristic_scores(reply_pairs(spark, d), response, reference, "decision")


@query
def judge_scores(spark, d):
    return _scores(spark, d).select("id", *rubric.DIMS)


@query
def judge_summary(spark, d):
    return rubric.judge_summary(_scores(spark, d))


@query
def pass_rate(spark, d):
    return rubric.pass_rate(_scores(spark, d))


@query
def agreement(spark, d):
    ours = _scores(spark, d)
    theirs = _scores(spark, d, "reference", "response").withColumn(
        "actionability", F.lit(2) + (F.col("id") % 3).cast("int"))
    return rubric.agreement(ours, theirs, "id")


def _raw_replies(spark, d):
    """Judge replies in the forms a model returns, built from the label table."""
    q, n = F.col("quality"), F.col("doc_id")
    fields = F.concat(
        F.lit('{"factual_grounding": '), (q * 9 - 2).cast("string"),
        F.when(n % 5 == 0, F.lit(', "actionability": "4"')).otherwise(
            F.concat(F.lit(', "actionability": '), ((n % 7) + 0.75).cast("string"))),
        F.when(n % 11 == 0, F.lit("")).otherwise(F.lit(', "tone_empathy": 3')),
        F.lit(', "safety_escalation": '), (F.col("toxic") + 4).cast("string"),
        F.lit(', "reasoning": "ok"}'),
    )
    content = (
        F.when(n % 4 == 0, F.concat(F.lit("Here it is:\n```json\n"), fields, F.lit("\n```\nDone.")))
        .when(n % 4 == 1, F.concat(F.lit("```\n"), fields, F.lit("\n```")))
        .when(n % 13 == 0, F.lit("not json at all"))
        .otherwise(fields)
    )
    return read(spark, d, "labels").select("doc_id", content.alias("content"))


@query
def judge_reply_parse(spark, d):
    parsed = rubric.parse_judge_replies(_raw_replies(spark, d), "content")
    return parsed.select("doc_id", *[F.col(f"parsed.{x}").alias(x) for x in rubric.DIMS])


@query
def judge_batch(spark, d):
    replied = _raw_replies(spark, d).select(F.col("doc_id").alias("id"), "content")
    rows = reply_pairs(spark, d).join(replied, "id", "left")
    return rubric.judge(rows, "response", "reference", "decision", "content").select(
        "id", *rubric.DIMS, "judge_method")


# -- text overlap and text functions ---------------------------------------------------------

@query
def rouge_n(spark, d):
    return overlap.overlap_scores(reply_pairs(spark, d), "id", "response", "reference", rouge_l=False).select(
        "id", "rouge1", "rouge2")


@query
def unigram_bleu(spark, d):
    return overlap.overlap_scores(reply_pairs(spark, d), "id", "response", "reference", rouge_l=False).select(
        "id", "unigram_bleu")


@query
def rouge_l(spark, d):
    return overlap.overlap_scores(reply_pairs(spark, d), "id", "response", "reference").select("id", "rougeL")


@query
def quality_means(spark, d):
    scores = overlap.overlap_scores(reply_pairs(spark, d), "id", "response", "reference", rouge_l=False)
    return overlap.quality_means(scores)


@query
def token_overlap(spark, d):
    a, b = tx.tokens(F.lower("response")), tx.tokens(F.lower("reference"))
    return reply_pairs(spark, d).select(
        "id", F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_union(a, b)).alias("all_tokens"),
        F.size(F.array_except(a, b)).alias("only_response"))


@query
def scalar_text(spark, d):
    t = F.col("text")
    words = tx.tokens(t)
    return documents(spark, d).select(
        "doc_id",
        F.md5(F.lower(t)).alias("lower_md5"),
        F.md5(tx.clean_message(F.concat(F.lit("@a  @b \n"), t, F.lit(" \n")))).alias("clean_md5"),
        F.length(tx.strip(F.concat(F.lit(" \n\t"), t, F.lit("\n ")))).alias("strip_len"),
        F.size(words).alias("n_words"),
        F.length(t).alias("n_points"),
        tx.contains_any(F.lower(t), ("thble", "schie")).alias("has_terms"),
        t.startswith("The").alias("starts_the"),
        F.round(F.length(t) / 7.0, 3).alias("rounded"),
        tx.clamp(F.size(words), 10, 200).alias("clamped"),
        tx.display_name(F.concat("lang", F.lit("_"), "source")).alias("display"),
    )


# -- models, composite jobs ---------------------------------------------------------------------

@query
def tfidf_terms(spark, d):
    """The ten heaviest terms of every language by mean TF-IDF weight."""
    docs = documents(spark, d).select("lang", "text")
    model = textmodel.fit_tfidf(docs.select("text"))
    return textmodel.heaviest_terms(model, docs, "lang", 10)


@query
def knn_index_recall(spark, d):
    """Cells and codes against the exact search, for every twentieth vector."""
    work, base = Workspace(spark), vectors(spark, d).select("id", "vec")
    asked = base.where(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id")
    index = dense_index.build(base, work.path("cells"))
    found = dense_index.search(dense_index.open_index(spark, index.root), asked, 5, probes=30, keep=30, exclude_self=True)
    wanted = neighbours.nearest(asked, base, 5, exclude_self=True)
    both = wanted.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_neighbours"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


@query
def kb_index(spark, d):
    """The stored vectors of the knowledge base, term by term."""
    kb = transcripts.build_knowledge_base(pairs(spark, d))
    index = sparse_index.build(kb, Workspace(spark).path("index"), "id", "customer_query")
    return sparse_index.open_index(spark, index.root).named_vectors().select("id", "term", F.round("weight", 6).alias("weight"))


def _passages(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query
def text_retrieval(spark, d):
    """Benchmark passages against all documents, through a stored index."""
    work = Workspace(spark)
    index = sparse_index.build(documents(spark, d), work.path("index"), "doc_id")
    return sparse_index.search(index, _passages(spark, d), 3, work).withColumn("similarity", F.round("similarity", 6))


@query
def text_retrieval_appended(spark, d):
    """The same from an index that was stored in two batches and opened again, with its own rows as queries."""
    work, docs = Workspace(spark), documents(spark, d)
    early = F.pmod(F.col("doc_id"), F.lit(3)) == 0
    index = sparse_index.build(docs.where(early), work.path("index"), "doc_id", fit_on=docs)
    index.append(docs.where(~early), "doc_id")
    asked = docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text")
    found = sparse_index.search(sparse_index.open_index(spark, index.root), asked, 5, work, exclude_self=True)
    return found.withColumn("similarity", F.round("similarity", 6))


@query
def tfidf_classify(spark, d):
    docs = documents(spark, d).select("doc_id", "text", F.col("lang").alias("label"))
    model = textmodel.fit_classifier(docs.select("text", "label"), work=Workspace(spark))
    return textmodel.classify_tfidf(docs, model, "text").select("doc_id", "label", "intent", "intent_confidence")


@query
def cross_domain(spark, d):
    return run.cross_domain(
        labelled_docs(spark, d), datasets.class_map_table(spark, SOURCE_MAP), "doc_id", Workspace(spark))


def _prepared(spark, d):
    work = Workspace(spark)
    return prepare.prepare_pairs(pairs(spark, d), work, PACK, golden_size=120, judge_size=30), work


@query
def triage_full(spark, d):
    """Every customer message of the conversations through the proposed configuration."""
    prepared, work = _prepared(spark, d)
    resources = prepare.train(prepared, work, PACK, tfidf=False)
    queries = work.stage("messages", vectorise(messages(spark, d), resources, "id", "text"))
    out = triage(queries, PROPOSED, resources)
    return out.select("query_id", "intent", "intent_confidence", "escalation_decision", "risk_score",
                      "response_method", F.size("retrieved_cases").alias("n_cases"))


@query
def triage_records(spark, d):
    """All fields of the prediction record, nested ones as JSON."""
    prepared, work = _prepared(spark, d)
    resources = prepare.train(prepared, work, PACK, tfidf=False)
    queries = work.stage("messages", vectorise(messages(spark, d), resources, "id", "text"))
    out = triage(queries, PROPOSED, resources)
    nested = ("intent_all_scores", "escalation_factors", "retrieved_cases", "grounding_sources")
    return out.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in out.columns])


@query
def three_configs(spark, d):
    prepared, work = _prepared(spark, d)
    resources = prepare.train(prepared, work, PACK)
    return run.evaluate_all(prepared.golden_set, resources, work).wide


@query
def full_run(spark, d):
    prepared, work = _prepared(spark, d)
    results = run.run_tables(prepared, work, PACK)
    for name in ("agent_documents", "judge_summary", "pass_rate"):
        tables.write_json(results[name], work.path(f"out/{name}"))
    return results["comparison"]


@query
def labelled_analysis(spark, d):
    """The second dataset's analysis documents as (section, document) rows."""
    parts = run.analyse_labelled(labelled_docs(spark, d), datasets.class_map_table(spark, SOURCE_MAP))
    out = None
    for section, table in parts.items():
        rows = table.select(F.lit(section).alias("section"), F.to_json(F.struct(*[
            c for c in table.columns if c != "text"])).alias("document"))
        out = rows if out is None else out.unionByName(rows)
    return out


# -- sinks, reuse, streams -------------------------------------------------------------------------

@query
def json_roundtrip(spark, d):
    path = Workspace(spark).path("labels.json")
    tables.write_json(read(spark, d, "labels"), path)
    return spark.read.schema("doc_id BIGINT, quality INT, toxic INT").json(path)


@query
def materialise_once(spark, d):
    work = Workspace(spark)
    build = lambda: read(spark, d, "labels").where(F.col("quality") == 1)
    work.once("labels", {"quality": 1}, build)
    return work.once("labels", {"quality": 1}, build)


@query
def vectors_roundtrip(spark, d):
    work = Workspace(spark)
    v = vectors(spark, d)
    tables.write_vectors(v, work.path("vectors"))
    back = tables.read_vectors(spark, v.select("id", "label"), work.path("vectors"))
    return back.select("id", "label", F.posexplode("vec").alias("place", "value")).withColumn("value", F.round(F.col("value").cast("double"), 5))


@query
def model_roundtrip(spark, d):
    path = Workspace(spark).path("encoder")
    docs = documents(spark, d).select("doc_id", "text")
    tables.save_model(textmodel.fit_encoder(docs), path)
    return textmodel.encode(docs, tables.load_model(path), "text").select("doc_id", F.size("vec").alias("dims"))


@query
def agent_results(spark, d):
    """Metric documents written per agent and read back from one folder of documents."""
    work = Workspace(spark)
    long = work.stage("long", _agents_long(spark, d))
    for agent in ("words", "letters", "constant", "judge"):
        document = long.where(F.col("agent") == ("words" if agent == "judge" else agent)).groupBy("agent").agg(
            F.collect_list(F.struct("metric", "value")).alias("metrics"), F.lit("bulky").alias("predictions"))
        tables.write_agent_results(document, work.path(f"{agent}_results.json"))
    back = tables.read_agent_results(
        spark, work.root, "agent STRING, metrics ARRAY<STRUCT<metric: STRING, value: DOUBLE>>")
    return back.select("agent", F.explode("metrics").alias("m")).select("agent", "m.metric", "m.value")


def _stream(spark, d, name):
    """A table as a stream of its files: those of its folder, or the one file that it is."""
    reader, path = spark.readStream.schema(read(spark, d, name).schema), f"{d}/{name}.parquet"
    if tables.is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query
def stream_first_seen(spark, d):
    work = Workspace(spark)
    docs = _stream(spark, d, "documents").select("doc_id", "text")
    kept = live.first_seen(docs, "text").select("msg_md5")
    live.append_stream(kept, work.path("seen"), work.path("seen_state")).awaitTermination()
    return spark.read.parquet(work.path("seen"))


@query
def stream_first_seen_bounded(spark, d):
    """Repeated event payloads within a watermark, on the event table."""
    work = Workspace(spark)
    events = _stream(spark, d, "events").select(
        "ts", F.concat_ws("|", "user_id", "event_type", "props").alias("text")
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    kept = live.first_seen(events, "text", "ts", "365 days").select("msg_md5")
    live.append_stream(kept, work.path("seen"), work.path("seen_state")).awaitTermination()
    return spark.read.parquet(work.path("seen"))


@query
def stream_triage(spark, d):
    prepared, work = _prepared(spark, d)
    resources = prepare.train(prepared, work, PACK, tfidf=False)
    arriving = _stream(spark, d, "conversations").where(F.col("role") == "user").select(
        turn_id("turn").alias("id"), "text")
    out = work.path("scored")
    live.triage_stream(arriving, PROPOSED, resources, out, work.path("scored_state")).awaitTermination()
    return spark.read.parquet(out).select("query_id", "intent", "escalation_decision", "risk_score")


@query
def stream_pairs(spark, d):
    """First question and answer per conversation, from its turns as a stream."""
    work = Workspace(spark)
    role = F.col("role")
    arriving = _stream(spark, d, "conversations").select(
        F.col("conv_id").alias("conversation_id"), F.col("turn").alias("pos"),
        F.when(role == "user", "customer").when(role == "assistant", "support").otherwise(role).alias("role"), "text")
    pair_stream(arriving, work.path("pairs"), work.path("pairs_state")).awaitTermination()
    return latest_pairs(spark, work.path("pairs"))
