"""Text columns. Whitespace is Unicode whitespace plus the four ASCII separators."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

WS = r"[\s\x1c-\x1f]"
NOT_WS = r"[^\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){WS}+", " ")


def clean_message(c: Column) -> Column:
    """Drop leading @mentions, collapse whitespace, strip."""
    unmentioned = F.regexp_replace(c, rf"(?U)^(?:@{NOT_WS}++{WS}*+)++", "")
    return strip(collapse(unmentioned))


def tokens(c: Column) -> Column:
    """Whitespace tokens without empties."""
    return F.filter(F.split(c, rf"(?U){WS}+"), lambda t: t != "")


def word_tokens(c: Column) -> Column:
    """Lower-cased alphanumeric runs, the tokens of the overlap scores."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")


def contains_any(c: Column, terms) -> Column:
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.contains(c, F.lit(term))
    return hit


def count_terms(c: Column, terms) -> Column:
    total = F.lit(0)
    for term in terms:
        total = total + F.contains(c, F.lit(term)).cast("int")
    return total


# The letters beyond ASCII that a case-insensitive search treats as i, s, i
FOLD_FROM, FOLD_TO = "\u0130\u017f\u0131", "isi"


def folded(c: Column) -> Column:
    """Text in the one case a search without regard to case compares in."""
    return F.lower(F.translate(c, FOLD_FROM, FOLD_TO))


def _alternatives(pattern: str) -> list[str]:
    """The pattern cut at its outermost bars."""
    out, depth, i, start = [], 0, 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == "|" and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return out + [pattern[start:]]


def leading_words(pattern: str) -> list[str] | None:
    """Words one of which every match of the pattern starts with, if they can be read off it."""
    words = []
    for part in _alternatives(pattern):
        group = re.match(r"\(((?:[^()\[\]\\?]|\\.)*)\)(?![?*{])", part)
        for option in _alternatives(group.group(1)) if group else [part]:
            plain = re.match(r"[a-z0-9 ]+", option)
            word = plain.group() if plain else ""
            if option[len(word):len(word) + 1] in ("?", "*", "{") and word:
                word = word[:-1]
            if len(word) < 2:
                return None
            words.append(word)
    return words


def matches(folded_text: Column, pattern: str) -> Column:
    """Regular-expression search without regard to case, on folded text.

    A pattern that spells no capital letter is searched as it is, which is several times faster
    than a search that folds at every position, and only in texts that hold one of the words it
    can start with.
    """
    spelled = re.sub(r"\\.", "", pattern)
    if spelled != spelled.lower():
        return folded_text.rlike(f"(?iU){pattern}")
    found = folded_text.rlike(f"(?U){pattern}")
    words = leading_words(pattern)
    return contains_any(folded_text, dict.fromkeys(words)) & found if words else found


def matches_any(folded_text: Column, patterns) -> Column:
    """Whether any pattern of a group matches; separate searches beat one alternation."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | matches(folded_text, pattern)
    return hit


def clamp(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def display_name(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
