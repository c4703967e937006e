"""Reply drafting from templates and retrieved cases, baselines and prompt tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions.ordering import pick_index
from ..functions.text import NOT_WS, WS, contains_any, strip
from ..rules import RulePack


def resolution_of(best_reply: Column, has_case: Column) -> Column:
    """Usable text of the best case: without mentions, links and opening phrases."""
    text = strip(F.regexp_replace(best_reply, rf"(?U)@{NOT_WS}+", ""))
    text = strip(F.regexp_replace(text, rf"(?U)https://t\.co/{NOT_WS}+", ""))
    for prefix in fv.RESOLUTION_PREFIXES:
        text = F.regexp_replace(text, rf"(?U)^{re.escape(prefix)}{WS}*", "")
    return (
        F.when(~has_case, fv.RESOLUTION_NO_CASE)
        .when(F.length(text) < 10, fv.RESOLUTION_TOO_SHORT)
        .otherwise(text)
    )


def issue_type(text: Column, pack: RulePack) -> Column:
    lowered = F.lower(text)
    out = F.lit(fv.ISSUE_TYPE_OTHER)
    for name, words in reversed(pack.issue_types):
        out = F.when(contains_any(lowered, words), name).otherwise(out)
    return out


def template_choices(intent: Column, decision: Column, pack: RulePack) -> Column:
    """Templates of (intent, decision). An intent without automatic replies uses its escalation
    list, an unknown intent the templates of the first intent."""
    auto, escalate = {}, {}
    for name, key, texts in pack.templates:
        (auto if key == "auto_handle" else escalate)[name] = texts
    names = list(dict.fromkeys(name for name, _, _ in pack.templates))

    def literal(texts):
        return F.array(*[F.lit(t) for t in texts or (fv.DM_FALLBACK,)])

    def chosen(name):
        return F.when(
            decision == "AUTO_HANDLE", literal(auto.get(name, escalate.get(name)))
        ).otherwise(literal(escalate.get(name)))

    out = chosen(names[0])
    for name in reversed(names):
        out = F.when(intent == name, chosen(name)).otherwise(out)
    return out


def template_reply(
    df: DataFrame,
    pack: RulePack,
    text_col: str,
    id_col: str,
    intent_col: str = "intent",
    decision: Column | None = None,
    cases_col: str = "retrieved_cases",
    method: str = "xxhash64",
) -> DataFrame:
    """Adds response, response_method and grounding_sources.

    The retrieved text goes in last, so braces inside it are never filled.
    """
    decision = F.col("escalation.decision") if decision is None else decision
    cases = F.col(cases_col)
    has_case = F.coalesce(F.size(cases) > 0, F.lit(False))
    best = F.get(cases, F.lit(0))["support_response"]
    staged = df.withColumn("__choices", template_choices(F.col(intent_col), decision, pack)).withColumn(
        "__resolution", resolution_of(best, has_case)
    )
    template = F.get(
        "__choices", pick_index(F.col(id_col), F.size("__choices"), method).cast("int")
    )
    filled = F.replace(template, F.lit("{issue_type}"), issue_type(F.col(text_col), pack))
    filled = F.replace(filled, F.lit("{dm_link}"), F.lit(fv.DM_LINK))
    filled = F.replace(filled, F.lit("{resolution_steps}"), F.col("__resolution"))
    return (
        staged.withColumn("response", strip(filled))
        .withColumn("response_method", F.lit("template"))
        .withColumn("grounding_sources", grounding(cases))
        .drop("__choices", "__resolution")
    )


def grounding(cases: Column, n: int = 3) -> Column:
    ids = F.transform(F.slice(cases, 1, n), lambda c: c["id"].cast("string"))
    return F.coalesce(ids, F.array().cast("array<string>"))


def canned_reply(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("response", F.lit(fv.CANNED_REPLY))
        .withColumn("response_method", F.lit("canned"))
        .withColumn("grounding_sources", F.array().cast("array<string>"))
    )


def nearest_reply(df: DataFrame, cases_col: str = "retrieved_cases") -> DataFrame:
    """The reply of the nearest case as it stands; the canned reply without a case."""
    best = F.get(F.col(cases_col), F.lit(0))
    found = F.coalesce(F.size(cases_col) > 0, F.lit(False))
    return (
        df.withColumn("response", F.when(found, best["support_response"]).otherwise(fv.CANNED_REPLY))
        .withColumn("response_method", F.when(found, "1nn_verbatim").otherwise("canned"))
        .withColumn("grounding_sources", F.when(found, grounding(F.col(cases_col), 1)).otherwise(
            F.array().cast("array<string>")))
    )


def _fill(template: str, columns: list[Column]) -> Column:
    pieces = template.split("%s")
    parts = [F.lit(pieces[0])]
    for column, piece in zip(columns, pieces[1:]):
        parts += [F.coalesce(column.cast("string"), F.lit("")), F.lit(piece)]
    return F.concat(*parts)


def reply_prompt(text: Column, intent: Column, decision: Column, reason: Column, cases: Column) -> Column:
    """Prompt text for an external batch model, with up to three cases."""
    blocks = F.transform(
        F.slice(cases, 1, 3),
        lambda c, i: _fill(fv.REPLY_PROMPT_CASE, [
            i + 1, F.format_string("%.2f", c["similarity"]), c["customer_query"], c["support_response"]]),
    )
    context = F.coalesce(F.array_join(blocks, ""), F.lit(""))
    return _fill(fv.REPLY_PROMPT, [F.lit(fv.DM_LINK), text, intent, decision, reason, context])


def rubric_text() -> str:
    out = ""
    for name, scale in fv.RUBRIC:
        out += f"\n  {name}:\n" + "".join(f"    {score}: {text}\n" for score, text in scale)
    return out


def judge_prompt(text: Column, response: Column, intent: Column, decision: Column, reason: Column,
                 reference: Column) -> Column:
    return _fill(fv.JUDGE_PROMPT, [text, response, intent, decision, reason, reference, F.lit(rubric_text())])
