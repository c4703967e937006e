"""Secret scans: all rules as one minimal automaton over bytes, run once over every text.

The rules' regular expressions, read backwards, are compiled together (``automaton``). One pass from the last
byte of a text to its first tells at every place which rules have a match that begins there. Of each rule the
leftmost place is taken, its longest match is measured by the rule's own automaton, and the search goes on
after that match; so matches of a rule never overlap and each is followed once. Places are kept as runs, so a
text that is one long match takes no more memory than its bytes.

Of a match the part after the rule's head is its body. Matches whose body or whole is too short are dropped
after they have been passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .automaton import Automaton, backwards, compile_patterns, parse
from .common import text_buffer

SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``head`` then ``body``, with at least ``least_body`` and ``least`` bytes; the body's first
    byte is none that the head could go on with."""

    kind: str
    head: str
    body: str
    least_body: int = 1
    least: int = 1
    any_case: bool = False


# fixed values: the three rules that results are held against
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", least_body=6, any_case=True),
    Rule("access", "AKIA", "[A-Z0-9]+", least=20),
    Rule("hex", "", "[0-9a-f]{24,}", least=24),  # runs are maximal: the same as dropping shorter ones
)
# formats of well-known issuers
MORE_RULES = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]+", least=20),
    Rule("stripe", "[rs]k_(live|test)_", "[A-Za-z0-9]+", least=24),
    Rule("google", "AIza", "[A-Za-z0-9_-]+", least=39),
    Rule("jwt", "", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("bearer", r"bearer\x20+", "[A-Za-z0-9._~+/=-]+", least_body=16, any_case=True),
    Rule("login", "[a-z]+://", r"[A-Za-z0-9._~%+-]+:[A-Za-z0-9._~%+!$=-]+@", least_body=4),
    Rule("private", "", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----([A-Za-z0-9+/=\x0A\x0D\x20]+-----END\x20([A-Z]+\x20)*PRIVATE\x20KEY-----)?"),
)
RULES = BASE_RULES + MORE_RULES


@dataclass(frozen=True)
class Compiled:
    """What a task needs of the rules: the automaton of all, and of each rule that of its match and its head."""

    rules: tuple[Rule, ...]
    begins: Automaton
    matches: tuple[Automaton, ...]
    heads: tuple[Automaton, ...]


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Compiled:
    """Refuses rules that match the empty text, equal kinds, and more than 62 rules."""
    if len({r.kind for r in rules}) < len(rules) or len(rules) > 62:
        raise ValueError("kinds must differ, and at most 62 rules fit one automaton")
    whole = [parse(r.head + r.body, r.any_case) for r in rules]
    begins = compile_patterns([backwards(t) for t in whole], anywhere=True)
    matches = tuple(compile_patterns([t]) for t in whole)
    if any(m.accepts[0] for m in matches):
        raise ValueError("a rule must not match the empty text")
    return Compiled(tuple(rules), begins, matches, tuple(compile_patterns([parse(r.head, r.any_case)]) for r in rules))


class Scanner:
    """Finds the spans of one text after another."""

    def __init__(self, compiled: Compiled):
        self.rules = compiled.rules
        self.start = compiled.begins.rows()[0]
        self.matches = [m.rows()[0] for m in compiled.matches]
        self.heads = [h.rows()[0] for h in compiled.heads]

    def places(self, data: bytes) -> list[tuple[int, int, int]]:
        """Runs ``(first, last, rules)`` of places where matches begin, from left to right."""
        found, row = [], self.start
        at, last, bits = -2, -1, 0
        for k, byte in enumerate(data[::-1]):
            row = row[byte]
            if row[256]:
                if k == at + 1 and row[256] == bits:
                    at = k
                else:
                    if bits:
                        found.append((at, last, bits))
                    at, last, bits = k, k, row[256]
        if bits:
            found.append((at, last, bits))
        end = len(data) - 1
        return [(end - a, end - z, bits) for a, z, bits in reversed(found)]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """``(start, rule, end)`` in bytes of all matches that are long enough, sorted."""
        places, out = self.places(data), []
        passed = [0] * len(self.rules)
        for first, last, bits in places:
            for r, rule in enumerate(self.rules):
                if not bits >> r & 1:
                    continue
                at = max(first, passed[r])
                while at <= last:
                    end = _longest(self.matches[r], data, at)
                    if end - at >= rule.least and end - _longest(self.heads[r], data, at) >= rule.least_body:
                        out.append((at, r, end))
                    passed[r] = at = end
        return sorted(out)


def _longest(row: list, data: bytes, at: int) -> int:
    """End of the longest match that begins at a place; the place itself if the empty text is all."""
    end = at
    for k in range(at, len(data)):
        row = row[data[k]]
        if row[256]:
            end = k + 1
        elif row[257]:
            break
    return end


def _characters(data: np.ndarray, places: list[int]) -> dict[int, int]:
    """Number of characters before each of some byte offsets."""
    out, before, count = {}, 0, 0
    for at in sorted(set(places)):
        count += int(np.count_nonzero((data[before:at] & 0xC0) != 0x80))
        out[at], before = count, at
    return out


def find(docs: DataFrame, compiled: Compiled, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` per row: kind, start and end (exclusive, in code points) of every secret in the whole
    text, by start, then in the order of the rules.

    A null or empty text has no spans. Rows with null or repeated ids are searched each; other columns are not
    read. A match is followed byte by byte, so a very long text costs time in proportion and its own size in
    memory.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def kernel(batches):
        scanner = Scanner(compiled)
        for batch in batches:
            buffer, at = text_buffer(batch.column(1))
            told = []
            for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
                found = scanner.spans(buffer[a:z].tobytes())
                chars = _characters(buffer[a:z], [p for s, _, e in found for p in (s, e)]) if found else {}
                told.append([{"kind": scanner.rules[r].kind, "start": chars[s], "end": chars[e]} for s, r, e in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, kind)], ["doc_id", "spans"])

    return rows.mapInArrow(kernel, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPAN}")


def written(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, compiled: Compiled | None = None) -> DataFrame:
    """Per document the number of matches of the base rules, the hash of their spans, and the spans of all rules."""
    found = find(docs, compiled or compile_rules())
    base = [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *[count(k) for k in base], F.sha2(written(own), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, compiled: Compiled | None = None, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every stretch that spans cover replaced by ``mark``; overlapping spans are one stretch.

    All columns stay; the text column must be named ``text``. A null text stays null.
    """
    at, names = docs.columns.index("text"), docs.columns
    told = compiled or compile_rules()

    def kernel(batches):
        scanner = Scanner(told)
        for batch in batches:
            texts = []
            for text in batch.column(at):
                data = text.as_py()
                raw = (data or "").encode()
                found = scanner.spans(raw)
                if found:
                    stretches: list[list[int]] = []
                    for start, _, end in found:
                        if stretches and start <= stretches[-1][1]:
                            stretches[-1][1] = max(stretches[-1][1], end)
                        else:
                            stretches.append([start, end])
                    edges = [0, *(p for pair in stretches for p in pair), len(raw)]
                    data = mark.encode().join(raw[a:z] for a, z in zip(edges[::2], edges[1::2])).decode()
                texts.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))], names)

    return docs.mapInArrow(kernel, docs.schema)
