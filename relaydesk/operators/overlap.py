"""Text overlap of generated and reference replies: ROUGE-1/2/L and clipped unigram precision."""

from __future__ import annotations

from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType

from ..functions.text import tokens, word_tokens

PIECE_TOKENS = 200_000  # of two sides, counted at once


def ngrams(c: Column, n: int) -> Column:
    """n-grams of a token array; space-joined."""
    if n == 1:
        return c
    count = F.greatest(F.size(c) - (n - 1), F.lit(0))
    parts = F.slice(c, F.lit(1), count)
    for i in range(1, n):
        parts = F.zip_with(parts, F.slice(c, F.lit(i + 1), count), lambda a, b: F.concat_ws(" ", a, b))
    return parts


def f1(common: Column, hyp: Column, ref: Column) -> Column:
    """F1 of common / hyp and common / ref; 0 where nothing is shared."""
    return F.coalesce(F.try_divide(2.0 * common, (hyp + ref).cast("double")), F.lit(0.0))


def _lcs(x, y) -> int:
    """Bit-parallel (Crochemore et al., 2001): one row of the table per machine word run, so long
    replies cost tokens x tokens / 64."""
    masks = {}
    for i, t in enumerate(x):
        masks[t] = masks.get(t, 0) | (1 << i)
    full = (1 << len(x)) - 1
    row = full
    for t in y:
        hit = row & masks.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(x) - row.bit_count()


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two token arrays. Arrow batches, no state between rows."""

    def lcs(left: pa.Array, right: pa.Array) -> pa.Array:
        known = pc.and_(left.is_valid(), right.is_valid()).to_numpy(zero_copy_only=False)
        found = np.zeros(len(left), np.int32)
        for row in np.flatnonzero(known):  # only the tokens of a row are Python values
            found[row] = _lcs(left[row].as_py(), right[row].as_py())
        return pa.array(found, pa.int32(), mask=~known)

    return F.arrow_udf(lcs, IntegerType())(a, b)


def shared_count(a: Column, b: Column) -> Column:
    """How many elements two arrays share, each as often as both have it. Linear in their lengths.

    Tokens are numbered by Arrow and counted as numbers, a piece of a batch at a time, never as Python strings.
    """

    return F.arrow_udf(_in_pieces, IntegerType())(a, b)


def _in_pieces(left: pa.Array, right: pa.Array) -> pa.Array:
    parts, at, n = [], 0, len(left)
    sizes = np.cumsum(sum(pc.fill_null(pc.list_value_length(x), 0).to_numpy().astype(np.int64) for x in (left, right)))
    while at < n:
        held = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, held + PIECE_TOKENS, side="right")))
        parts.append(_shared(left.slice(at, end - at), right.slice(at, end - at)))
        at = end
    return pa.array(np.concatenate(parts or [np.zeros(0, np.int32)]), pa.int32())


def _shared(left: pa.Array, right: pa.Array) -> np.ndarray:
    n, ends = len(left), len(left.flatten())
    tokens = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode(null_encoding="encode")
    rows = np.concatenate([pc.list_parent_indices(x).to_numpy() for x in (left, right)]).astype(np.int64)
    keys = rows * max(len(tokens.dictionary), 1) + tokens.indices.to_numpy()
    found, first = np.unique(keys[:ends], return_counts=True)
    met, second = np.unique(keys[ends:], return_counts=True)
    _, i, j = np.intersect1d(found, met, assume_unique=True, return_indices=True)
    row = found[i] // max(len(tokens.dictionary), 1)
    return np.bincount(row, weights=np.minimum(first[i], second[j]), minlength=n).astype(np.int32)


def overlap_scores(
    pairs: DataFrame,
    id_col: str,
    generated: str,
    reference: str,
    stem: Callable[[Column], Column] | None = None,
    rouge_l: bool = True,
) -> DataFrame:
    """(id, rouge1, rouge2, rougeL, unigram_bleu), each rounded to 4, one row per pair.

    A pair is one row and is scored within it: nothing is shuffled and ids need not be unique.
    Null texts are empty. ``stem`` maps a token array to a stemmed one.
    """
    stem = stem or (lambda c: c)
    g, r = F.coalesce(F.col(generated), F.lit("")), F.coalesce(F.col(reference), F.lit(""))
    sides = pairs.select(
        F.col(id_col).alias("__id"),
        stem(word_tokens(g)).alias("h1"), stem(word_tokens(r)).alias("r1"),
        tokens(F.lower(g)).alias("hw"), tokens(F.lower(r)).alias("rw"),
    ).withColumns({"h2": ngrams(F.col("h1"), 2), "r2": ngrams(F.col("r1"), 2)})
    counted = sides.select(
        "__id",
        *[F.size(c).alias(c) for c in ("h1", "r1", "h2", "r2", "hw", "rw")],
        *[shared_count(F.col(f"h{kind}"), F.col(f"r{kind}")).alias(f"c{kind}") for kind in ("1", "2", "w")],
        *([lcs_length(F.col("h1"), F.col("r1")).alias("longest")] if rouge_l else []),
    )
    precision = F.try_divide(F.col("cw").cast("double"), F.col("hw"))
    brevity = F.least(F.lit(1.0), F.try_divide(F.col("hw").cast("double"), F.col("rw")))
    return counted.select(
        F.col("__id").alias(id_col),
        F.round(f1(F.col("c1"), F.col("h1"), F.col("r1")), 4).alias("rouge1"),
        F.round(f1(F.col("c2"), F.col("h2"), F.col("r2")), 4).alias("rouge2"),
        *([F.round(f1(F.col("longest"), F.col("h1"), F.col("r1")), 4).alias("rougeL")] if rouge_l else []),
        F.round(F.coalesce(precision * brevity, F.lit(0.0)), 4).alias("unigram_bleu"),
    )


def quality_means(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of the overlap scores (and of ``similarity`` where present), rounded to 4."""
    names = {"rouge1": "rouge1_mean", "rouge2": "rouge2_mean", "rougeL": "rougeL_mean",
             "unigram_bleu": "bleu_mean", "similarity": "semantic_similarity_mean"}
    return scores.groupBy(*(by or [])).agg(*[
        F.round(F.avg(c), 4).alias(alias) for c, alias in names.items() if c in scores.columns
    ])
