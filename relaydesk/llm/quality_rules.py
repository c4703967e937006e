"""Line-first cleaning with quality rules, in DataFrame functions only.

Every line is judged by itself (punctuation, symbols, navigation, boilerplate); lines that fail are taken
out, and a document is rejected when that takes more than ``max_removed`` of its characters, or when the
document as a whole is too short or repeats itself too much.

All of it is row-local, nothing is shuffled. Costly counts are guarded by cheap conditions that must hold
for them to be other than zero (a line is searched for symbols only in a document that has one).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SHOUTS = "!?¡¿"
SEPARATORS = "|›»•·"
BLANKS = " \t\n\x0b\f\r"
FEW = 32  # repeated windows that are looked up one by one rather than by sorting


@dataclass(frozen=True)
class Rules:
    """Thresholds of the line and document rules."""

    min_words: int = 50  # of a document
    max_repeat_percent: int = 50  # words in repeated 3-word windows, of all words
    max_removed: float = 0.5  # characters of failing lines, of all characters in lines with a word
    symbols_per_word: float = 0.3  # in a line
    shouts_per_word: float = 0.4  # in a line, besides one
    separators: int = 3  # marks between links that make a line navigation
    terminal: str = ".!?:;,…。！？)]}\"'”’»"  # a line ends in one of these,
    open_words: int = 40  # or has more words than this
    navigation: str = r"(?i)^\W*(home|menu|login|log in|sign in|sign up|search|share|next|previous|back to top|read more)\W*$"
    boilerplate: tuple[str, ...] = (
        "all rights reserved", "copyright (c)", "copyright ©", "licensed under", "licenced under", "privacy policy",
        "terms of use", "terms of service", "use of cookies", "accept cookies", "enable javascript", "lorem ipsum",
    )


def marks(text: Column, chars: str) -> Column:
    """How many of a text's characters are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def has_any(text: Column, parts) -> Column:
    return reduce(or_, [F.contains(text, F.lit(p)) for p in parts])


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def word_list(text: Column) -> Column:
    """The words of a text without nulls."""
    bare = strip(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (whose columns must not be named like the measures) with the document measures.

    3-word windows are compared by 64-bit hash. Words inside windows that occur twice or more are counted
    from the positions of those windows: each adds the words up to the next one, three at most.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    one = docs.withColumn("_t", t).withColumn("_words", word_list(F.col("_t")))
    n = F.size("_words")
    two = one.withColumn("_windows", F.slice(
        F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))), F.lit(1), F.greatest(n - 2, F.lit(0))
    ))
    repeating = F.size(F.array_distinct("_windows")) < F.size("_windows")
    three = two.withColumn("_sorted", F.when(repeating, F.sort_array("_windows")))
    four = three.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda h, i: (i > 0) & (h == F.get("_sorted", i - 1)))))
    listed = F.filter(
        F.transform("_windows", lambda h, i: F.when(F.array_contains("_twice", h), i)), lambda i: i.isNotNull()
    )
    five = four.withColumn("_pairs", F.when(
        F.size("_twice") > FEW, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ))
    at = lambda j: F.get(F.col("_pairs"), j)["h"]
    paired = F.sort_array(F.filter(
        F.transform("_pairs", lambda x, j: F.when((x["h"] == at(j - 1)) | (x["h"] == at(j + 1)), x["i"])), lambda i: i.isNotNull()
    ))
    six = five.withColumn("_marked", F.when(F.size("_twice") > FEW, paired).when(F.size("_twice") > 0, listed))
    covered = F.aggregate(
        F.transform("_marked", lambda i, j: F.least(F.lit(3), F.coalesce(F.get("_marked", j + 1) - i, F.lit(3)))),
        F.lit(0), lambda a, b: a + b,
    )
    symbols = F.when(has_any(F.col("_t"), SYMBOLS), marks(F.col("_t"), SYMBOLS)).otherwise(F.lit(0))
    return six.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": symbols.cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "_lines": F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)),
    }).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop(
        "_words", "_windows", "_sorted", "_twice", "_pairs", "_marked"
    )


def line_fails(line: Column, rules: Rules, symbols: Column, shouts: Column, separators: Column, boilerplate: Column) -> Column:
    """Whether a line (with a word) fails a line rule; the flags tell what its document has at all."""
    bare = strip(line)
    gaps = F.size(F.split(bare, GAP))
    return (
        (~F.endswith(line, F.lit(".")) & ~F.substring(bare, -1, 1).isin(list(rules.terminal)) & (gaps <= rules.open_words))
        | (symbols & (marks(line, SYMBOLS) > gaps * rules.symbols_per_word))
        | (shouts & (marks(line, SHOUTS) > gaps * rules.shouts_per_word + 1))
        | (separators & (marks(line, SEPARATORS) >= rules.separators))
        | (boilerplate & has_any(F.lower(line), rules.boilerplate))
        | line.rlike(rules.navigation)
    )


def clean(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, the measures, ``base_failed``, ``kept``, ``n_lines``, ``n_removed_lines`` and
    ``cleaned``, the text of the lines that passed.

    A null text counts as empty: no words, so it fails. Ties and repeated rows have no influence on each
    other; other columns of the input are not read. An empty table gives an empty result.
    """
    told = measures(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    # one array read in four places: the optimizer leaves it a column of its own, so that it is not worked out per line
    told = told.withColumn("_has", F.array(
        F.col("n_symbols") > 0, has_any(F.col("_t"), SHOUTS), has_any(F.col("_t"), SEPARATORS), has_any(F.lower("_t"), rules.boilerplate)
    ))
    told = told.withColumn("_good", F.filter("_lines", lambda x: ~line_fails(x, rules, *[F.get("_has", F.lit(k)) for k in range(4)])))
    told = told.withColumn(
        "base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    )
    chars = lambda c: F.length(F.array_join(c, ""))
    enough = chars("_lines") - chars("_good") <= rules.max_removed * chars("_lines")
    return told.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ((F.size("_good") == F.size("_lines")) | enough)).alias("kept"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_good")).cast("long").alias("n_removed_lines"),
        F.array_join("_good", "\n").alias("cleaned"),
    )
