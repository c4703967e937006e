"""Language of a text from fused evidence: its bytes, the language it declares, its address, its host.

Every source of evidence is a likelihood or prior counted from the table itself:

- text: hashed byte trigrams per declared language, every one of them, counted over all texts, smoothed
  towards those of the whole table, and tempered because overlapping trigrams are not independent;
- declared language and address suffix: how often they stand with each language that the text alone tells;
- host: share of each language on the host, smoothed towards its domain (any number of wider levels), and
  those towards the whole table, by grouped aggregation.

The posterior is their normalised product. It only compares the modelled languages, so a text is accepted if its
best posterior reaches ``min_posterior`` and the text itself fits the language: its mean log likelihood per
trigram reaches what texts that are declared and told as the language have, less an allowance for short ones.
A text without a word character fits nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Workspace, text_pieces

BUCKETS = 1 << 16
TEMPER = 0.2
WIDER = 0.1  # share of the whole table's trigrams in a language, the same for all, so that trigrams new to them weigh alike
EVEN = 0.1  # share of equal counts in the whole table's
PRIOR_ROWS = 20.0  # rows that a wider level counts for
MIN_ROWS = 1  # declared rows that make a language of the model
BINS = 0.01  # width of the bins that log likelihoods are counted in
LOW = 0.01  # share of a language's own texts below the low mark
REACH = 2.0  # distances from median to low mark that a text may lie below the median
SHORT = 18.0  # allowance of a text of one trigram; falls with the root of their number, as keys and numbers fill more of a short text
HELD = 100  # languages that a task counts at once before it passes the counts on
CELLS = 1 << 20  # rows times languages in one batch
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORDLIKE = np.ones(256, bool)
_WORDLIKE[:128] = [chr(b).isalpha() for b in range(128)]


def _trigrams(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each byte trigram that holds a letter."""
    low = _LOWER[buf]
    n = max(len(buf) - 2, 0)
    code = (low[:n] << 16 | low[1 : n + 1] << 8 | low[2 : n + 2]) * np.uint32(2654435761)
    inside = np.ones(n + 2, bool)
    ends = at[1:]
    for back in (1, 2):
        cut = ends - back
        inside[cut[(cut >= 0) & (cut < n + 2)]] = False
    letter = _WORDLIKE[buf]
    keep = np.flatnonzero(inside[:n] & (letter[:n] | letter[1 : n + 1] | letter[2 : n + 2]))
    # a text of under 2 bytes marks bytes of the text before it; trigrams of that one end there anyway
    return (code[keep] >> 16).astype(np.int64), np.searchsorted(at, keep, side="right") - 1


def count_trigrams(texts: DataFrame) -> DataFrame:
    """``declared, bucket, n`` over all texts of (declared, text); rows without a declared language are left out."""

    def kernel(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for first, last, buf, at in text_pieces(batch.column(1)):
                codes, rows = _trigrams(buf, at)
                # a run of one character is one trigram here, or a text of it would vouch for itself
                fresh = np.ones(len(codes), bool)
                fresh[1:] = (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])
                codes, rows = codes[fresh], rows[fresh]
                names = batch.column(0).slice(first, last - first).dictionary_encode()
                own = names.indices.to_numpy(zero_copy_only=False)[rows]
                for k, name in enumerate(names.dictionary.to_pylist()):
                    if name not in counts and len(counts) >= HELD:
                        yield from _counted(counts)
                        counts = {}
                    counts.setdefault(name, np.zeros(BUCKETS, np.int64))
                    counts[name] += np.bincount(codes[own == k], minlength=BUCKETS)
        yield from _counted(counts)

    return texts.where(F.col("declared").isNotNull()).mapInArrow(kernel, "declared string, bucket int, n bigint").groupBy(
        "declared", "bucket"
    ).agg(F.sum("n").alias("n"))


def _counted(counts):
    for name, n in counts.items():
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(has), pa.string()), pa.array(has.astype(np.int32)), pa.array(n[has])], ["declared", "bucket", "n"]
        )


def _model(rows: DataFrame, min_rows: int) -> tuple[list[str], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Languages, log probability of each trigram bucket where a language has none, and per language the
    buckets it has with what they say more. Memory follows the buckets that languages have, not their number."""
    told = rows.where(F.col("declared") != "").groupBy("declared").count().where(F.col("count") >= min_rows)
    languages = sorted(r[0] for r in told.select("declared").collect())
    if not languages:
        return [], np.full(BUCKETS, -np.log(BUCKETS)), []
    place = rows.sparkSession.createDataFrame(list(enumerate(languages)), "k int, declared string")
    counted = count_trigrams(rows.select("declared", "text").where(F.col("declared") != "")).join(place, "declared")
    told = counted.select("k", "bucket", "n").toPandas().sort_values(["k", "bucket"])
    k, bucket, n = (told[c].to_numpy() for c in ("k", "bucket", "n"))
    whole = np.bincount(bucket, weights=n, minlength=BUCKETS)
    whole = (1 - EVEN) * whole / max(whole.sum(), 1) + EVEN / BUCKETS
    at = np.searchsorted(k, np.arange(len(languages) + 1))
    more = []
    for first, last in zip(at[:-1], at[1:]):
        own, has = n[first:last], bucket[first:last].astype(np.int32)
        more.append((has, np.log1p((1 - WIDER) * own / max(own.sum(), 1) / (WIDER * whole[has])).astype(np.float32)))
    return languages, np.log(WIDER * whole), more


def _text_scores(rows: DataFrame, model, columns: list[str]) -> DataFrame:
    """``rows`` without the text but with ``scores`` (log likelihood per language) and ``n_grams``."""
    at_text = rows.columns.index("text")

    def kernel(batches):
        unseen, more = model.value
        width = max(len(more), 1)
        for batch in batches:
            for first, last, buf, at in text_pieces(batch.column(at_text)):
                codes, row = _trigrams(buf, at)
                n = last - first
                sums = np.repeat(np.bincount(row, weights=unseen[codes], minlength=n).astype(np.float64)[:, None], width, 1)  # of no trigrams at all come whole numbers
                for k, (has, gain) in enumerate(more):
                    gains = np.zeros(BUCKETS, np.float32)
                    gains[has] = gain
                    sums[:, k] += np.bincount(row, weights=gains[codes], minlength=n)
                grams = np.bincount(row, minlength=n)
                some = max(CELLS // width, 1)
                for low in range(0, n, some):
                    high = min(low + some, n)
                    part = [batch.column(c).slice(first + low, high - low) for c in columns]
                    scores = pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1, dtype=np.int32) * width), pa.array(sums[low:high].ravel()))
                    best = pa.array(sums[low:high].argmax(1).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*part, scores, best, pa.array(grams[low:high])], [*columns, "scores", "best", "n_grams"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(kernel, f"{kinds}, scores array<double>, best int, n_grams bigint")


def _counts(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``keys, name``: how many rows of the keys the text tells as each language, of those that it tells at all."""
    each = rows.groupBy(*keys, "best").agg(F.count("*").cast("double").alias("n"))
    return each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("best", "n"))).alias(name))


def _least_fits(sure: DataFrame, languages: list[str]) -> np.ndarray:
    """Per language the mean log likelihood per trigram that a long text needs, from the rows that are both
    declared and told as it; few rows are drawn to the marks of all, as ``PRIOR_ROWS`` rows."""
    names = sure.sparkSession.createDataFrame(list(enumerate(languages)), "k int, name string")
    own = sure.join(names, (F.col("declared") == F.col("name")) & (F.col("best") == F.col("k")))
    bins = F.floor(F.get("scores", F.col("best")) / F.col("n_grams") / BINS).cast("int")
    told = own.groupBy("best", bins.alias("bin")).agg(F.count("*").alias("n")).toPandas().sort_values(["best", "bin"])

    def marks(part):
        bin_, upto = part["bin"].to_numpy(), np.cumsum(part["n"].to_numpy())
        median, low = (bin_[np.searchsorted(upto, q * upto[-1])] * BINS for q in (0.5, LOW))
        return np.array([median, low])

    if not len(told):
        return np.full(len(languages), -np.inf)
    every = marks(told.groupby("bin", as_index=False)["n"].sum())
    out = np.repeat(every[None, :], len(languages), 0)
    for k, part in told.groupby("best"):
        n = part["n"].sum()
        out[k] = (n * marks(part) + PRIOR_ROWS * every) / (n + PRIOR_ROWS)
    return out[:, 0] - REACH * (out[:, 0] - out[:, 1])


def _posteriors(told: DataFrame, languages: list[str], shared, depths: int, temper: float, kind: str) -> DataFrame:
    """The product of all evidence of each row: its language, posterior, what its text alone tells, and whether it fits."""
    width = max(len(languages), 1)
    counted = [f"n{d}" for d in range(depths - 1, -1, -1)]  # widest first
    columns = ["id", "mark", "declared", "scores", "best", "n_grams", *counted, "of_declared", "of_suffix"]

    def sparse(column):
        """Per row the languages and numbers of a list of pairs, None where it is null."""
        at, pairs = column.offsets.to_numpy(), column.values
        best, n = (pairs.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        return [(best[a:b], n[a:b]) if ok else None for a, b, ok in zip(at[:-1], at[1:], column.is_valid().to_pylist())]

    def kernel(batches):
        base, totals, least = shared.value
        for batch in batches:
            some = max(CELLS // width, 1)
            for first in range(0, batch.num_rows, some):
                part = batch.slice(first, some)
                n = part.num_rows
                column = lambda name: part.column(columns.index(name))
                scores = column("scores").flatten().to_numpy().reshape(n, width)
                logs = np.repeat(base[None, :], n, 0)
                for name in counted:
                    for i, pair in enumerate(sparse(column(name))):
                        if pair is not None:
                            logs[i] *= PRIOR_ROWS
                            logs[i, pair[0]] += pair[1]
                            logs[i] /= pair[1].sum() + PRIOR_ROWS
                logs = np.log(logs) + temper * scores
                for name in ("declared", "suffix"):
                    for i, pair in enumerate(sparse(column(f"of_{name}"))):
                        if pair is not None:
                            logs[i] -= totals[name]
                            logs[i, pair[0]] += np.log1p(pair[1])
                top = logs.argmax(1)
                posterior = 1.0 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                grams, best = column("n_grams").to_numpy(), column("best").to_numpy()
                many = np.maximum(grams, 1)
                fits = (grams > 0) & (scores[np.arange(n), top] / many >= least[top] - SHORT / np.sqrt(many))
                names = pa.array(languages or [None], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [column("id"), column("mark"), column("declared"), names.take(pa.array(top)), pa.array(posterior),
                     names.take(pa.array(best, mask=grams == 0)), pa.array(fits)],
                    ["id", "mark", "declared", "language", "posterior", "text_language", "fits"],
                )

    return told.select(*columns).mapInArrow(kernel, f"id {kind}, mark bigint, declared string, language string, posterior double, text_language string, fits boolean")


def identify(rows: DataFrame, work: Workspace, levels: tuple[str, ...] = ("host",), min_rows: int = MIN_ROWS, temper: float = TEMPER,
             min_posterior: float = 0.5) -> DataFrame:
    """``id, mark, declared, language, posterior, text_language, accepted`` of rows with ``id, text`` and, each
    possibly null, ``declared``, ``suffix`` and the ``levels`` (host first, wider ones after).

    Null evidence says nothing; a null or empty text or one without letters has only the other evidence and
    is not accepted, nor is one of noise or of a language that is not modelled. Languages are the declared ones with ``min_rows`` rows (all, if not given; an empty one
    is none); if there are none, language is null and nothing is accepted. Equal posteriors go to the first
    language by name. Repeated rows are judged alike and counted each. An empty table gives an empty result.
    ``mark`` is a hash of the text.
    """
    columns = ["id", "mark", "declared", "suffix", *levels]
    languages, unseen, more = _model(rows, min_rows)
    width = max(len(languages), 1)
    send = work.spark.sparkContext.broadcast
    told = rows.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit("")))).select(*columns, "text")
    told = work.stage("scores", _text_scores(told, send((unseen, more)), columns))

    sure = told.where("n_grams > 0")

    def by_language(part: DataFrame) -> np.ndarray:
        out = np.zeros(width)
        for r in part.groupBy("best").count().collect():
            out[r["best"]] = r["count"]
        return out

    overall = by_language(sure) + 1.0
    prior = None
    for depth in range(len(levels) - 1, -1, -1):
        here, wider = levels[depth], levels[depth + 1 :]
        counted = _counts(sure.where(F.col(here).isNotNull()), list(levels[depth:]), f"n{depth}")
        if prior is not None:
            up = prior.select(*[F.col(c).alias(f"up_{c}") for c in wider], *[f"n{d}" for d in range(depth + 1, len(levels))])
            counted = counted.join(up, [F.col(c).eqNullSafe(F.col(f"up_{c}")) for c in wider], "left").drop(*[f"up_{c}" for c in wider])
        prior = counted
    prior = prior.withColumnsRenamed({c: f"of_{c}" for c in levels})
    told = told.join(prior, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in levels], "left").drop(*[f"of_{c}" for c in levels])
    totals = {}
    for name in ("declared", "suffix"):
        having = sure.where(F.col(name).isNotNull())
        values = having.agg(F.countDistinct(name)).first()[0]
        totals[name] = np.log(by_language(having) + float(values or 1))
        evidence = _counts(having, [name], f"of_{name}").withColumnRenamed(name, f"value_{name}")
        told = told.join(evidence, F.col(name) == F.col(f"value_{name}"), "left")
    least = _least_fits(sure, languages) if languages else np.zeros(1)
    shared = send((overall / overall.sum(), totals, least))
    told = _posteriors(told, languages, shared, len(levels), temper, rows.schema["id"].dataType.simpleString())
    return told.withColumn("accepted", F.col("text_language").isNotNull() & F.col("fits") & (F.col("posterior") >= min_posterior)).drop("fits")


def document_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Evidence of documents: their text, declared language and, as host, their source."""
    none = F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("id"), "text", F.lower(F.trim("lang")).alias("declared"), none.alias("suffix"), F.col("source").alias("host"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Evidence of web pages: visible text, markup language, address suffix, host and its domain."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return pages.select(
        F.col("page_id").alias("id"), text.alias("text"), F.when(declared != "", declared).alias("declared"),
        F.when(host.contains("."), F.substring_index(host, ".", -1)).alias("suffix"), host.alias("host"), F.substring_index(host, ".", -2).alias("domain"),
    )
