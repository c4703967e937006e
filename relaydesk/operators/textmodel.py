"""TF-IDF vectors, a multinomial logistic regression and a text encoder for retrieval."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.ml.functions as MF
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    HashingTF,
    IDF,
    IndexToString,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StopWordsRemover,
    StringIndexer,
)
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..functions.ordering import top_n_per_group
from ..sources.workspace import Workspace

TEXT = "text"


def term_stages(stop_words: bool) -> list:
    """Lower-cased words of two or more characters, stop words out, unigrams plus bigrams."""
    words = RegexTokenizer(inputCol=TEXT, outputCol="__words", pattern=r"(?U)\w\w+", gaps=False)
    stages, source = [words], "__words"
    if stop_words:
        stages.append(StopWordsRemover(
            inputCol="__words", outputCol="__kept",
            stopWords=StopWordsRemover.loadDefaultStopWords("english")))
        source = "__kept"
    stages.append(NGram(n=2, inputCol=source, outputCol="__pairs"))
    stages.append(SQLTransformer(statement=f"SELECT *, concat({source}, __pairs) AS __terms FROM __THIS__"))
    return stages


PIECE_TERMS = 500_000  # counted at once
MORE_WORDS = 4096  # that the driver reads beyond the vocabulary, for those as frequent as its last


def _pieces(batches):
    """(terms, row of each) of array columns, some rows at a time."""
    for batch in batches:
        column = batch.column(0)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_TERMS, side="right")))
            part = column.slice(at, end - at)
            yield part.flatten(), pc.list_parent_indices(part).to_numpy().astype(np.int64)
            at = end


def _counts(codes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences and rows of every code below ``n``."""
    return np.bincount(codes, minlength=n), np.bincount(np.unique(rows * n + codes) % max(n, 1), minlength=n)


def counted_terms(terms: DataFrame) -> DataFrame:
    """(term, tf, df) of a table of one array column."""

    def count(batches):
        for flat, rows in _pieces(batches):
            encoded = flat.dictionary_encode()
            names = encoded.dictionary
            tf, df = _counts(encoded.indices.to_numpy(), rows, len(names))
            yield pa.RecordBatch.from_arrays([names, pa.array(tf), pa.array(df)], ["term", "tf", "df"])

    parts = terms.mapInArrow(count, "term string, tf bigint, df bigint")
    return parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def counted_pairs(words: DataFrame, known: list[str]) -> DataFrame:
    """(term, tf, df) of neighbouring words of which both are among ``known``."""
    names = words.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        values = pa.array(names.value, pa.string())
        for flat, rows in _pieces(batches):
            code = pc.fill_null(pc.index_in(flat, value_set=values), -1).to_numpy().astype(np.int64)
            both = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (rows[:-1] == rows[1:]))
            found, pair = np.unique(code[both] * len(values) + code[both + 1], return_inverse=True)
            tf, df = _counts(pair, rows[both], len(found))
            left, right = (values.take(pa.array(x)) for x in np.divmod(found, len(values)))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(left, right, " "), pa.array(tf), pa.array(df)], ["term", "tf", "df"])

    parts = words.mapInArrow(count, "term string, tf bigint, df bigint")
    return parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def vocabulary(words: DataFrame, terms: DataFrame, vocab: int, min_df: int) -> list:
    """(term, tf, df) of the ``vocab`` most frequent of ``terms`` in at least ``min_df`` rows, in the driver.

    ``words`` and ``terms`` have one array column each; terms are words and pairs of neighbouring ones. A pair is
    no more frequent than its words, so only pairs of words as frequent as the ``vocab``-th are counted. With
    fewer words than that, or too many as frequent as the last, all terms are.
    """

    def first(counted: DataFrame, n: int) -> list:
        return counted.where(F.col("df") >= min_df).orderBy(F.desc("tf"), "term").limit(n).collect()

    top = first(counted_terms(words), vocab + MORE_WORDS)
    if not 0 < vocab <= len(top) or (len(top) == vocab + MORE_WORDS and top[-1]["tf"] == top[vocab - 1]["tf"]):
        return first(counted_terms(terms), vocab)
    known = [r["term"] for r in top if r["tf"] >= top[vocab - 1]["tf"]]
    return sorted(top + first(counted_pairs(words, known), vocab), key=lambda r: (-r["tf"], r["term"]))[:vocab]


def fit_tfidf(texts: DataFrame, vocab: int = 5000, min_df: int = 2, stop_words: bool = True) -> PipelineModel:
    """Term frequencies x (ln((1 + rows) / (1 + rows with the term)) + 1), scaled to unit length.

    The driver holds the chosen terms and their weights, at most ``vocab`` of each.
    """
    words = Pipeline(stages=term_stages(stop_words)).fit(texts)
    rows = texts.count()
    split = words.transform(texts)
    chosen = vocabulary(split.select("__kept" if stop_words else "__words"), split.select("__terms"), vocab, min_df)
    weights = [math.log((1 + rows) / (1 + r["df"])) + 1.0 for r in chosen]
    return PipelineModel([
        words,
        CountVectorizerModel.from_vocabulary([r["term"] for r in chosen], inputCol="__terms", outputCol="__tf"),
        ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="__tf", outputCol="__weighted"),
        Normalizer(p=2.0, inputCol="__weighted", outputCol="features"),
    ])


def fit_classifier(
    examples: DataFrame, vocab: int = 5000, min_df: int = 2, stop_words: bool = True,
    c: float = 1.0, max_iter: int = 1000, tol: float = 1e-6, work: Workspace | None = None, name: str = "term_vectors",
) -> PipelineModel:
    """TF-IDF and multinomial logistic regression on (text, label).

    ``regParam = 1 / (C x rows)`` is the same penalty as an inverse strength ``C``. With a
    workspace the vectors are written once and the regression reads those instead of the texts.
    """
    tfidf = fit_tfidf(examples.select(TEXT), vocab, min_df, stop_words)
    vectors = tfidf.transform(examples).select("label", "features")
    if work is not None:
        vectors = work.stage(name, vectors)
    index = StringIndexer(inputCol="label", outputCol="__y", stringOrderType="alphabetAsc").fit(vectors)
    regression = LogisticRegression(
        featuresCol="features", labelCol="__y", family="multinomial", maxIter=max_iter, tol=tol,
        regParam=1.0 / (c * vectors.count()), standardization=False,
        probabilityCol="__probability", predictionCol="__prediction", rawPredictionCol="__raw",
    ).fit(index.transform(vectors).select("__y", "features"))
    names = IndexToString(inputCol="__prediction", outputCol="intent", labels=index.labels)
    return PipelineModel([tfidf, regression, names])


def labels_of(model: PipelineModel) -> list[str]:
    return model.stages[-1].getLabels()


def classify_tfidf(df: DataFrame, model: PipelineModel, text_col: str) -> DataFrame:
    """Adds intent, intent_confidence and intent_all_scores, rounded to 4."""
    labels = F.array(*[F.lit(x) for x in labels_of(model)])
    scored = model.transform(df.withColumn(TEXT, F.coalesce(F.col(text_col), F.lit(""))))
    probability = MF.vector_to_array("__probability")
    scores = F.transform(probability, lambda p: F.round(p, 4))
    return scored.select(
        *[c for c in df.columns],
        "intent",
        F.array_max(scores).alias("intent_confidence"),
        F.map_from_arrays(labels, scores).alias("intent_all_scores"),
    )


def heaviest_terms(model: PipelineModel, df: DataFrame, group: str, n: int = 10) -> DataFrame:
    """(group, term, weight): the terms with the largest mean TF-IDF weight per group.

    The mean is taken over sparse vectors, combined on the map side; one dense vector per group
    is left to rank.
    """
    names = df.sparkSession.createDataFrame(
        list(enumerate(model.stages[1].vocabulary)), "pos int, term string"
    )
    means = model.transform(df).groupBy(group).agg(
        MF.vector_to_array(Summarizer.mean(F.col("features"))).alias("mean")
    )
    weights = means.select(group, F.posexplode("mean").alias("pos", "weight")).where("weight > 0")
    ranked = top_n_per_group(weights, [group], [F.desc("weight"), F.col("pos")], n, "rank")
    return ranked.join(names, "pos").select(
        group, "term", F.round("weight", 6).alias("weight"), "rank")


def fit_encoder(texts: DataFrame, text_col: str = TEXT, dims: int = 256) -> PipelineModel:
    """A text encoder: hashed terms, inverse document frequency, unit length."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=TEXT, outputCol="__words", pattern=r"(?U)\w\w+", gaps=False),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=dims),
        IDF(inputCol="__tf", outputCol="__weighted"),
        Normalizer(p=2.0, inputCol="__weighted", outputCol="__unit"),
    ]).fit(texts.select(F.coalesce(F.col(text_col), F.lit("")).alias(TEXT)))


def encode(df: DataFrame, encoder, text_col: str, out: str = "vec") -> DataFrame:
    """Adds a vector column. ``encoder`` is a fitted pipeline or any ``(df, text_col, out) -> df``,
    such as a user's own ``mapInPandas`` model."""
    if not isinstance(encoder, PipelineModel):
        return encoder(df, text_col, out)
    marked = df.withColumn("__original", F.struct(*df.columns)).withColumn(
        TEXT, F.coalesce(F.col(text_col), F.lit(""))
    )
    vectors = encoder.transform(marked)
    return vectors.select("__original.*", MF.vector_to_array("__unit").alias(out))
