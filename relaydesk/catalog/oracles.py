"""DuckDB SQL that states the same results over the same tables."""

from __future__ import annotations

from .. import fixed_values as fv
from ..operators.replies import rubric_text
from ..rules import SUPPORT_PACK
from .inputs import PACK, SOURCE_MAP
from .queries import PACK_ISSUES


def q(text) -> str:
    """A SQL string literal."""
    return "'" + str(text).replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in rows)


def fill(template, columns) -> str:
    pieces = template.split("%s")
    out = q(pieces[0])
    for column, piece in zip(columns, pieces[1:]):
        out += f" || {column} || {q(piece)}"
    return f"({out})"


def hits(pack, text="text") -> list[str]:
    return [
        "(" + " + ".join(f"contains(lower({text}), {q(k)})::INT" for k in kws) + ")"
        for _, kws in pack.taxonomy
    ]


def any_term(terms, text="lower(text)") -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in terms) + ")"


def any_pattern(patterns, text="text") -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {q('(?i)' + p)})" for p in patterns) + ")"


def case(column, pairs, default) -> str:
    body = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs)
    return f"CASE {column} {body} ELSE {q(default)} END"


def labelled(source, pack, text="text") -> str:
    """``source`` plus h (hits), intent, conf, n_intents."""
    n = len(pack.taxonomy)
    names = "[" + ", ".join(q(i) for i in pack.intents) + "]"
    return f"""
      SELECT *, CASE WHEN best = 0 THEN {q(pack.fallback_intent)}
                     ELSE list_extract({names}, list_position(h, best)) END AS intent,
             CASE WHEN best = 0 THEN 0.3::DOUBLE ELSE round(best::DOUBLE / total, 3) END AS conf,
             len(list_filter(h, lambda x: x > 0))::INT AS n_intents
      FROM (SELECT *, list_max(h) AS best, list_sum(h)::INT AS total
            FROM (SELECT *, [{', '.join(hits(pack, text))}] AS h FROM {source}))"""


def difficulty(pack, text="text") -> str:
    return f"""CASE WHEN n_intents >= 3 THEN 'multi_intent'
        WHEN conf < 0.4 AND length({text}) < 50 THEN 'ambiguous'
        WHEN {any_term(pack.sarcasm, f'lower({text})')} THEN 'adversarial'
        WHEN conf < 0.5 THEN 'ambiguous' ELSE 'standard' END"""


def gold(pack, text="text") -> tuple[str, str]:
    escalating = [(i, r) for i, dec, r in pack.intent_defaults if dec == "ESCALATE"]
    trig = " ".join(f"WHEN {any_term(w, f'lower({text})')} THEN {q(r)}" for r, w in pack.gold_triggers)
    reason = f"CASE {trig} ELSE {case('intent', escalating, pack.gold_auto_reason)} END"
    return f"CASE WHEN {reason} = {q(pack.gold_auto_reason)} THEN 'AUTO_HANDLE' ELSE 'ESCALATE' END", reason


def factors(source, pack, keys, text="text", similarity="1.0") -> str:
    flags, names, weights = [], [], []
    for f in pack.factors:
        cond = any_pattern(f.patterns, text)
        if f.intent:
            cond = f"({cond} OR (intent = {q(f.intent)} AND conf >= {fv.CONFIDENCE_THRESHOLD}))"
        flags.append(cond), names.append(f.name), weights.append(round(f.weight * 100))
    flags += [f"conf < {fv.CONFIDENCE_THRESHOLD}", f"{similarity} < {fv.RETRIEVAL_THRESHOLD}"]
    names += [fv.LOW_CONFIDENCE[0], fv.LOW_RETRIEVAL[0]]
    weights += [15, 10]
    cols = ", ".join(f"{c} AS f{i}" for i, c in enumerate(flags))
    n = len(pack.factors)
    reason = " ".join(f"WHEN f{i} THEN {q(f.reason)}" for i, f in enumerate(pack.factors))
    listed = ", ".join(f"CASE WHEN f{i} THEN {q(x)} END" for i, x in enumerate(names))
    risk = " + ".join(f"f{i}::INT * {w}" for i, w in enumerate(weights))
    some = " OR ".join(f"f{i}" for i in range(n))
    return f"""
      SELECT {keys}, CASE WHEN {some} OR (f{n} AND f{n + 1}) THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS decision,
        CASE {reason} WHEN f{n} AND f{n + 1} THEN {q(fv.UNCERTAIN_REASON)}
             ELSE {case('intent', pack.auto_reasons, pack.auto_reason_other)} END AS reason,
        array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL), ',') AS factors,
        round(least(100, {risk}) / 100.0::DOUBLE, 3) AS risk_score
      FROM (SELECT *, {cols} FROM ({source}))"""


def keyword_decision(pack, text="text", keys="doc_id", source="documents") -> str:
    listed = ", ".join(f"CASE WHEN {any_pattern(f.patterns, text)} THEN {q(f.name)} END" for f in pack.factors)
    return f"""
      SELECT {keys}, CASE WHEN len(fs) > 0 THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS decision,
        CASE WHEN len(fs) > 0 THEN {fill(fv.KEYWORD_REASON, ["fs[1]"])}
             ELSE {q(fv.KEYWORD_AUTO_REASON)} END AS reason,
        array_to_string(fs, ',') AS factors,
        CASE WHEN len(fs) > 0 THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END AS risk_score
      FROM (SELECT *, list_filter([{listed}], lambda x: x IS NOT NULL) AS fs FROM {source})"""


TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
LINES = """(SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"""
TURN_TEXT = TRIM.format("CASE WHEN pos = 0 THEN '@help @desk  ' || line ELSE line END")
CLEAN = TRIM.format(r"regexp_replace(regexp_replace({0}, '^(@\S+\s*)+', ''), '\s+', ' ', 'g')")
FIRST_PAIRS = f"""
  SELECT doc_id AS conversation_id, lang,
    {CLEAN.format("max(CASE WHEN pos = 0 THEN t END)")} AS first_customer_msg,
    max(CASE WHEN pos = 1 THEN t END) AS first_support_reply, count(*)::INT AS num_turns
  FROM (SELECT *, {TURN_TEXT} AS t FROM {LINES}) GROUP BY 1, 2"""
PAIRS = """(SELECT a.conv_id * 4294967296 + a.turn AS id, a.text AS msg, b.text AS reply, 2 AS num_turns
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')"""
REPLIES = """(SELECT a.conv_id * 4294967296 + a.turn AS id, a.text AS response, b.text AS reference,
    CASE WHEN a.turn % 4 = 1 THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS decision
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2
  WHERE a.role = 'assistant' AND b.role = 'assistant')"""
MESSAGES = "(SELECT conv_id * 4294967296 + turn AS id, text FROM conversations WHERE role = 'user')"
WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"
ALNUM = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"


def records() -> str:
    decision, reason = gold(PACK, "msg")
    return f"""(SELECT id, msg AS customer_tweet, intent AS gold_intent, conf AS intent_confidence,
      {decision} AS gold_escalation, {reason} AS gold_escalation_reason, reply AS gold_human_reply,
      {difficulty(PACK, 'msg')} AS difficulty_tag, num_turns FROM ({labelled(PAIRS, PACK, 'msg')}))"""


def kb(limit=None) -> str:
    cap = "" if limit is None else f" ORDER BY id LIMIT {limit}"
    return f"""
      SELECT id, msg_md5, support_response, num_turns FROM (
        SELECT doc_id AS id, md5(text) AS msg_md5, source AS support_response,
          len(string_split(text, chr(10)))::INT AS num_turns,
          row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents)
      WHERE r = 1{cap}"""


def golden_sample_cte(target=64, seed=42) -> str:
    base, extra = divmod(target, 6)
    return f"""
      rec AS (SELECT * FROM {records()}),
      strata AS (SELECT gold_intent, row_number() OVER (ORDER BY min(id)) AS sno FROM rec GROUP BY 1),
      k AS (SELECT rec.*, sno, difficulty_tag <> 'standard' AS hard, md5('{seed}:' || id) AS key,
              {base} + (sno <= {extra})::INT AS quota FROM rec JOIN strata USING (gold_intent)),
      s AS (SELECT *, row_number() OVER (PARTITION BY gold_intent, hard ORDER BY key, id) AS r,
              greatest(3, quota // 3) AS n_hard FROM k),
      o AS (SELECT *, CASE WHEN hard AND r <= n_hard THEN 0 WHEN NOT hard AND r <= quota - n_hard THEN 1
              ELSE 2 END AS turn FROM s),
      p AS (SELECT *, row_number() OVER (PARTITION BY gold_intent ORDER BY turn, key, id) AS pos FROM o),
      golden AS (SELECT printf('GS-%03d', row_number() OVER (ORDER BY sno, pos)) AS golden_id, *
              FROM p WHERE pos <= quota)"""


def knn(k=5) -> str:
    return f"""
      e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
      n AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label,
              round(list_cosine_similarity(a.v, b.v), 9) AS sim
            FROM e a JOIN e b ON a.vec_id <> b.vec_id),
      t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id)::INT AS rank FROM n
            QUALIFY rank <= {k})"""


CENTROIDS = """
      d AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
      m AS (SELECT label, dim, avg(x) AS value FROM d GROUP BY 1, 2),
      c AS (SELECT label, list(value ORDER BY dim) AS cv FROM m GROUP BY 1)"""

GUESS_WORDS = """CASE WHEN contains(lower(text), ' the ') THEN 'en' WHEN contains(lower(text), ' die ') THEN 'de'
  WHEN contains(lower(text), ' que ') THEN 'es' WHEN contains(lower(text), ' le ') THEN 'fr' ELSE 'xx' END"""
GUESS_LETTERS = """CASE WHEN contains(lower(text), 'ß') OR contains(lower(text), 'ü') THEN 'de'
  WHEN contains(lower(text), 'ñ') THEN 'es' WHEN contains(lower(text), 'é') THEN 'fr' ELSE 'en' END"""
GUESSES = f"""(SELECT doc_id, lang AS truth, 'words' AS agent, {GUESS_WORDS} AS pred FROM documents
  UNION ALL SELECT doc_id, lang, 'letters', {GUESS_LETTERS} FROM documents
  UNION ALL SELECT doc_id, lang, 'constant', 'en' FROM documents)"""
CLASSES = f"""
      g AS (SELECT * FROM {GUESSES}),
      l AS (SELECT agent, truth AS label FROM g UNION SELECT agent, pred FROM g),
      cl AS (SELECT l.agent, l.label, count(*) FILTER (truth = label AND pred = label) AS tp,
               count(*) FILTER (pred = label) AS predicted, count(*) FILTER (truth = label) AS support
             FROM l JOIN g USING (agent) GROUP BY 1, 2),
      prf AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0)::DOUBLE AS p,
               coalesce(tp / nullif(support, 0), 0)::DOUBLE AS r,
               coalesce(2 * tp / nullif(predicted + support, 0), 0)::DOUBLE AS f FROM cl)"""
AGENT_METRICS = f"""{CLASSES},
      wide AS (SELECT agent, round(sum(tp)::DOUBLE / sum(support), 4) AS accuracy, round(avg(f), 4) AS macro_f1
               FROM prf GROUP BY 1),
      fa AS (SELECT agent, round(coalesce(count(*) FILTER (truth = 'fr' AND pred = 'en')::DOUBLE
               / nullif(count(*) FILTER (truth = 'fr'), 0), 0), 4) AS false_auto_handle_rate FROM g GROUP BY 1),
      w AS (SELECT * FROM wide JOIN fa USING (agent))"""
LABELLED_DOCS = "(SELECT doc_id, text, source AS label_name FROM documents)"
MAP = f"(SELECT * FROM (VALUES {values(SOURCE_MAP)}) AS v(src_intent, intent))"
DECIDED = f"""
      dec AS ({keyword_decision(PACK)}),
      tru AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS truth FROM labels)"""


def count_terms(text, terms) -> str:
    return "(" + " + ".join(f"contains({text}, {q(t)})::INT" for t in terms) + ")"


def heuristic(response, reference, source, suffix="") -> str:
    low = f"lower({response})"
    words = WORDS.format(low)
    ref = WORDS.format(f"lower({reference})")
    return f"""(SELECT id,
      least(5, greatest(1, trunc(1 + 5 * (len(list_intersect(list_distinct({words}), list_distinct({ref})))::DOUBLE
        / greatest(len(list_distinct({ref})), 1)))))::INT AS factual_grounding{suffix},
      least(5, greatest(1, 2 + {count_terms(low, fv.ACTION_WORDS)}))::INT AS actionability{suffix},
      least(5, greatest(2, 2 + {count_terms(low, fv.EMPATHY_WORDS)}))::INT AS tone_empathy{suffix},
      CASE WHEN {any_term(fv.PII_WORDS, low)} THEN 1
           WHEN decision = 'ESCALATE' AND NOT {any_term(fv.DM_WORDS, low)} THEN 3 ELSE 5 END::INT AS safety_escalation{suffix}
      FROM {source})"""


DIM_SUM = "(factual_grounding + actionability + tone_empathy + safety_escalation)"
DIM_MIN = "least(factual_grounding, actionability, tone_empathy, safety_escalation)"
PASSED = f"({DIM_SUM} / 4.0 >= 3.5 AND {DIM_MIN} >= 3)"


def agreement_sql() -> str:
    ours = heuristic("response", "reference", REPLIES)
    theirs = heuristic("reference", "response", REPLIES)
    longs = " UNION ALL ".join(
        f"SELECT {q(d)} AS dim, a.{d} AS a, b.{d} AS b FROM a JOIN b USING (id)" for d in fv.DIMENSIONS)
    return f"""
      WITH a AS (SELECT *, {PASSED} AS ok FROM {ours}),
      b AS (SELECT *, {PASSED} AS ok FROM (SELECT * REPLACE ((2 + id % 3)::INT AS actionability) FROM {theirs})),
      x AS ({longs}),
      y AS (SELECT * FROM x UNION ALL SELECT 'overall', a, b FROM x),
      z AS (SELECT *, rank() OVER (PARTITION BY dim ORDER BY a) + (count(*) OVER (PARTITION BY dim, a) - 1) / 2.0 AS ra,
              rank() OVER (PARTITION BY dim ORDER BY b) + (count(*) OVER (PARTITION BY dim, b) - 1) / 2.0 AS rb FROM y),
      s AS (SELECT dim,
              round(CASE WHEN stddev_pop(ra) * stddev_pop(rb) = 0 THEN 0.0::DOUBLE ELSE covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END, 4) AS spearman_rho,
              round(CASE WHEN stddev_pop(a) * stddev_pop(b) = 0 THEN 0.0::DOUBLE ELSE covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END, 4) AS pearson_r,
              round(avg((a = b)::INT), 4) AS exact_agreement, round(avg((abs(a - b) <= 1)::INT), 4) AS within_1_agreement
            FROM z GROUP BY 1),
      k AS (SELECT 'overall' AS dim, avg((a.ok = b.ok)::INT) AS po, avg(a.ok::INT) AS pa, avg(b.ok::INT) AS pb FROM a JOIN b USING (id))
      SELECT s.*, round((po - (pa * pb + (1 - pa) * (1 - pb))) / nullif(1 - (pa * pb + (1 - pa) * (1 - pb)), 0), 4) AS cohens_kappa,
             round(po, 4) AS pass_fail_agreement
      FROM s LEFT JOIN k USING (dim)"""


def template_sql() -> str:
    auto = {i: t for i, key, t in PACK.templates if key == "auto_handle"}
    esc = {i: t for i, key, t in PACK.templates if key == "escalate"}
    lists = lambda t: "[" + ", ".join(q(x) for x in t) + "]"
    choice = " ".join(
        f"WHEN intent = {q(i)} THEN CASE WHEN decision = 'AUTO_HANDLE' THEN {lists(auto.get(i, esc[i]))} ELSE {lists(esc[i])} END"
        for i in esc)
    issue = " ".join(f"WHEN {any_term(w)} THEN {q(name)}" for name, w in PACK.issue_types)
    cleaned = TRIM.format(r"regexp_replace(reply, '@\S+', '', 'g')")
    cleaned = TRIM.format(rf"regexp_replace({cleaned}, 'https://t\.co/\S+', '', 'g')")
    return f"""
      WITH m AS ({MESSAGES_WITH_CASES}),
      f AS ({factors('SELECT * FROM m', PACK, 'id, text, reply, intent')}),
      c AS (SELECT *, CASE {choice} END AS choices,
              CASE WHEN reply IS NULL THEN {q(fv.RESOLUTION_NO_CASE)} WHEN length({cleaned}) < 10 THEN {q(fv.RESOLUTION_TOO_SHORT)}
                   ELSE {cleaned} END AS steps,
              CASE {issue} ELSE 'this' END AS issue FROM f)
      SELECT id, {TRIM.format(f"replace(replace(replace(choices[1 + ('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT % len(choices)], '{{issue_type}}', issue), '{{dm_link}}', {q(fv.DM_LINK)}), '{{resolution_steps}}', steps)")} AS response,
             'template' AS response_method, CASE WHEN reply IS NULL THEN '' ELSE id::VARCHAR END AS grounding FROM c"""


MESSAGES_WITH_CASES = (
    "SELECT l.*, p.reply, round(length(text) / (length(text) + length(reply)), 2) AS sim FROM ("
    + labelled(MESSAGES, PACK) + f") l LEFT JOIN {PAIRS} p USING (id)"
)


def prompt_sql() -> str:
    one = fill(fv.REPLY_PROMPT_CASE, ["1", "printf('%.2f', sim)", "text", "reply"])
    prompt = fill(fv.REPLY_PROMPT, [q(fv.DM_LINK), "text", "intent", "decision", "reason",
                                    f"CASE WHEN reply IS NULL THEN '' ELSE {one} END"])
    return f"""WITH m AS ({MESSAGES_WITH_CASES}),
      f AS ({factors('SELECT * FROM m', PACK, 'id, text, reply, intent, sim')})
      SELECT id, md5({prompt}) AS prompt_md5, length({prompt})::INT AS prompt_len FROM f"""


RAW_REPLIES = """(SELECT doc_id, '{"factual_grounding": ' || (quality * 9 - 2) ||
    CASE WHEN doc_id % 5 = 0 THEN ', "actionability": "4"' ELSE ', "actionability": ' || (doc_id % 7) || '.75' END ||
    CASE WHEN doc_id % 11 = 0 THEN '' ELSE ', "tone_empathy": 3' END ||
    ', "safety_escalation": ' || (toxic + 4) || ', "reasoning": "ok"}' AS j FROM labels)"""
JUDGE_JSON = f"""(SELECT doc_id, least(5, greatest(1, trunc(json_extract(j, '$.factual_grounding')::DOUBLE)))::INT AS fg,
    least(5, greatest(1, trunc(TRY_CAST(json_extract_string(j, '$.actionability') AS DOUBLE))))::INT AS ac,
    least(5, greatest(1, TRY_CAST(json_extract_string(j, '$.tone_empathy') AS DOUBLE)))::INT AS te,
    least(5, greatest(1, json_extract(j, '$.safety_escalation')::DOUBLE))::INT AS se,
    NOT (doc_id % 5 = 0 OR doc_id % 11 = 0 OR (doc_id % 13 = 0 AND doc_id % 4 > 1)) AS ok FROM {RAW_REPLIES})"""


def term_vectors(source, queries=None) -> str:
    """Unit TF-IDF vectors ``v (side, id, term, w)`` of ``(id, text)`` rows, the terms weighed by the first source."""
    terms = r"regexp_extract_all(lower(coalesce(text, '')), '[\pL\pM\p{Nd}\p{Pc}]{2,}')"
    both = f"SELECT 'base' AS side, id, text FROM {source}" + (f" UNION ALL SELECT 'query', id, text FROM {queries}" if queries else "")
    return f"""
      rows_of AS ({both}),
      n AS (SELECT count(*)::DOUBLE AS n FROM rows_of WHERE side = 'base'),
      tf AS (SELECT side, id, term, count(*) AS tf FROM (SELECT side, id, unnest({terms}) AS term FROM rows_of) GROUP BY ALL),
      df AS (SELECT term, count(*) AS df FROM tf WHERE side = 'base' GROUP BY 1),
      raw AS (SELECT side, id, term, tf * (ln((1 + n) / (1 + coalesce(df, 0))) + 1) AS w FROM tf LEFT JOIN df USING (term), n),
      v AS (SELECT side, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY side, id)) AS w FROM raw)"""


def retrieval(source, queries, k, exclude_self=False) -> str:
    return f"""WITH {term_vectors(source, queries)},
      s AS (SELECT a.id AS query_id, b.id AS id, round(sum(a.w * b.w), 9) AS sim FROM v a JOIN v b ON a.term = b.term AND a.side = 'query' AND b.side = 'base'
            {"AND a.id <> b.id" if exclude_self else ""} GROUP BY 1, 2)
      SELECT query_id, id, round(sim, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id)::INT AS rank FROM s
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) <= {k}"""


def longest_common() -> str:
    """ROUGE-L: the table of longest common subsequences, a row of it per step of the recursion."""
    return f"""WITH RECURSIVE t AS (SELECT id, {ALNUM.format('response')} AS h, {ALNUM.format('reference')} AS r FROM {REPLIES}),
      steps AS (
        SELECT id, h, r, 0 AS i, list_transform(h, lambda x: 0) AS above FROM t
        UNION ALL
        SELECT id, h, r, i + 1, list_transform(range(1, len(h) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k:
          CASE WHEN h[k] = r[i + 1] THEN 1 + CASE WHEN k > 1 THEN above[k - 1] ELSE 0 END ELSE above[k] END)))
        FROM steps WHERE i < len(r))
      SELECT id, round(coalesce(2.0 * above[len(h)] / nullif(len(h) + len(r), 0), 0)::DOUBLE, 4) AS "rougeL" FROM steps WHERE i = len(r)"""


def rouge(kind) -> str:
    toks = {"1": ALNUM, "2": ALNUM, "w": WORDS}[kind]
    def grams(col):
        t = toks.format(f"lower({col})" if kind == "w" else col)
        if kind != "2":
            return t
        return (f"list_transform(range(1, greatest(len({t}), 1)), lambda i: list_extract({t}, i) || ' ' || list_extract({t}, i + 1))")
    return f"""
      t AS (SELECT id, {grams('response')} AS h, {grams('reference')} AS r FROM {REPLIES}),
      hu AS (SELECT id, gram, count(*) AS n FROM (SELECT id, unnest(h) AS gram FROM t) GROUP BY ALL),
      ru AS (SELECT id, gram, count(*) AS n FROM (SELECT id, unnest(r) AS gram FROM t) GROUP BY ALL),
      co AS (SELECT id, sum(least(hu.n, ru.n)) AS c FROM hu JOIN ru USING (id, gram) GROUP BY 1),
      sc AS (SELECT id, coalesce(c, 0)::DOUBLE AS c, len(h)::DOUBLE AS h, len(r)::DOUBLE AS r FROM t LEFT JOIN co USING (id))"""


def rouge_select(kind, name) -> str:
    if kind == "w":
        expr = "round(coalesce(c / nullif(h, 0) * least(1.0, h / nullif(r, 0)), 0), 4)"
    else:
        expr = "round(coalesce(2 * c / nullif(h + r, 0), 0), 4)"
    return f"(WITH {rouge(kind)} SELECT id, {expr} AS {name} FROM sc)"


FIRST_PAIR = f"""
    WITH u AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant')),
    a AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS asked_at, count(*)::INT AS num_turns FROM u GROUP BY 1),
    p AS (SELECT conv_id, num_turns, max(text) FILTER (role = 'user' AND turn = asked_at) AS msg,
            arg_min(text, turn) FILTER (role = 'assistant' AND turn > asked_at) AS first_support_reply
          FROM u JOIN a USING (conv_id) GROUP BY 1, 2),
    c AS (SELECT conv_id AS conversation_id, {CLEAN.format('msg')} AS first_customer_msg, first_support_reply, num_turns FROM p)
    SELECT * FROM c WHERE num_turns >= 2 AND length(first_customer_msg) >= 20 AND length(first_support_reply) >= 15"""


def oracle_sql() -> dict[str, str]:
    label_cols = ("conv_id, turn, intent, conf AS intent_confidence, n_intents, {} AS difficulty_tag")
    decision, reason = gold(PACK)
    docs_intent = labelled("documents", PACK)
    trig = lambda f: "array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN regexp_matches(text, {q('(?i)' + p)}) THEN {q(p)} END" for p in f.patterns
    ) + f"], lambda x: x IS NOT NULL), ' ; ') AS {f.name.lower()}"
    counts = "(SELECT source AS label_name, count(*) AS n FROM documents GROUP BY 1)"
    words_only = f"(SELECT truth, pred, count(*) AS n FROM {GUESSES} WHERE agent = 'words' GROUP BY 1, 2)"
    vec_pairs = """(SELECT a.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
                    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""
    judge = heuristic("response", "reference", REPLIES)
    dims = ", ".join(fv.DIMENSIONS)
    judge_prompt = fill(fv.JUDGE_PROMPT, [q("none"), "response", q("unknown"), "decision", q("-"), "reference", q(rubric_text())])
    issues = " ".join(f"WHEN {any_term(w)} THEN {q(n)}" for n, w in PACK_ISSUES.issue_types)
    nulls = ", ".join(f"NULL::INT AS {d}" for d in fv.DIMENSIONS)
    out = {
        "scan_filter": "SELECT lang, doc_id, n_chars FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 100",
        "labelled_load": """SELECT doc_id, quality AS label, CASE quality WHEN 0 THEN 'poor' ELSE 'good' END AS label_name,
            lang, n_chars FROM labels JOIN documents USING (doc_id)""",
        "parse_turns": f"""SELECT doc_id AS conversation_id, pos::INT AS pos,
            CASE WHEN pos % 2 = 0 THEN 'customer' ELSE 'support' END AS role, {TURN_TEXT} AS text FROM {LINES}""",
        "transcript_first_pair": f"""SELECT * EXCLUDE (lang) FROM ({FIRST_PAIRS}) WHERE num_turns >= 2
            AND length(first_customer_msg) >= 20 AND length(first_support_reply) >= 15""",
        "brand_conversations": f"""SELECT conversation_id, first_customer_msg, num_turns FROM ({FIRST_PAIRS})
            WHERE lang = 'de' AND num_turns >= 2 AND length(first_customer_msg) >= 20
            AND length(first_support_reply) >= 15 ORDER BY conversation_id LIMIT 50""",
        "first_pair": FIRST_PAIR,
        "stream_pairs": FIRST_PAIR,
        "kb_dedup": kb(),
        "kb_capped": kb(300),
        "keyword_label": f"""SELECT {label_cols.format(difficulty(PACK))}, array_to_string(h, ',') AS hits
            FROM ({labelled('conversations', PACK)})""",
        "keyword_label_support": f"""SELECT {label_cols.format(difficulty(SUPPORT_PACK))}
            FROM ({labelled('conversations', SUPPORT_PACK)})""",
        "keyword_matches": f"""SELECT intent, kw, count(*) AS n_docs FROM documents
            JOIN (SELECT * FROM (VALUES {values((i, k) for i, ks in PACK.taxonomy for k in ks)}) AS v(intent, kw))
            ON contains(lower(text), kw) GROUP BY 1, 2""",
        "keyword_matches_table": f"""SELECT intent, kw, count(*) AS n_docs FROM documents
            JOIN (SELECT * FROM (VALUES {values((i, k) for i, ks in PACK.taxonomy for k in ks)}) AS v(intent, kw))
            ON contains(lower(text), kw) GROUP BY 1, 2""",
        "gold_decision": f"""SELECT conv_id, turn, {decision} AS gold_escalation, {reason} AS gold_escalation_reason
            FROM ({labelled('conversations', PACK)})""",
        "golden_records": f"""SELECT id, gold_intent, intent_confidence, gold_escalation, gold_escalation_reason,
            difficulty_tag, num_turns FROM {records()}""",
        "distributions": f"""SELECT CASE WHEN gold_intent IS NOT NULL THEN 'gold_intent'
              WHEN gold_escalation IS NOT NULL THEN 'gold_escalation' ELSE 'difficulty_tag' END AS facet,
            coalesce(gold_intent, gold_escalation, difficulty_tag) AS value, count(*) AS n FROM {records()}
            GROUP BY GROUPING SETS ((gold_intent), (gold_escalation), (difficulty_tag))""",
        "facet_search": f"""SELECT id, gold_intent, difficulty_tag FROM {records()}
            WHERE contains(lower(customer_tweet), 'on') AND gold_intent = 'software_troubleshooting'
            AND difficulty_tag = 'multi_intent'""",
        "train_union": f"""
            WITH kb AS (SELECT * FROM {PAIRS} QUALIFY row_number() OVER (PARTITION BY md5(msg) ORDER BY id) = 1)
            SELECT id::VARCHAR AS id, intent AS label, md5(msg) AS text_md5 FROM ({labelled('kb', PACK, 'msg')}) WHERE conf >= 0.3
            UNION ALL SELECT 'golden:' || id, gold_intent, md5(customer_tweet) FROM {records()}""",
        "escalation_factors": factors(docs_intent, PACK, "doc_id", similarity="round((n_chars % 97) / 97.0::DOUBLE, 4)"),
        "escalation_support": factors(labelled("documents", SUPPORT_PACK), SUPPORT_PACK, "doc_id"),
        "matched_patterns": f"SELECT doc_id, {', '.join(trig(f) for f in PACK.factors)} FROM documents",
        "keyword_escalation": keyword_decision(PACK),
        "always_auto": f"""SELECT doc_id, 'AUTO_HANDLE' AS decision, {q(fv.ALWAYS_AUTO_REASON)} AS reason,
            {q(fv.ALWAYS_AUTO_FACTOR)} AS factors, 0.0::DOUBLE AS risk_score FROM documents""",
        "majority": """SELECT source AS label_name, count(*) AS n FROM documents
            GROUP BY 1 ORDER BY n DESC, label_name LIMIT 1""",
        "golden_sample": f"""WITH {golden_sample_cte()}
            SELECT golden_id, id, gold_intent, difficulty_tag, gold_intent AS sampling_stratum FROM golden""",
        "judge_subset": f"""WITH {golden_sample_cte()},
            j AS (SELECT golden_id, gold_intent, md5('123:' || golden_id) AS jk FROM golden),
            r AS (SELECT *, row_number() OVER (PARTITION BY gold_intent ORDER BY jk, golden_id) AS jr,
                    (SELECT count(DISTINCT gold_intent) FROM j) AS ns FROM j)
            SELECT golden_id, gold_intent FROM r ORDER BY jr > 20 // ns, jk, golden_id LIMIT 20""",
        "judge_placeholders": f"SELECT id, {nulls}, NULL::BOOLEAN AS overall_pass FROM {records()}",
        "stratified_split": """
            WITH t AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1),
            f AS (SELECT lang, floor(n * 0.2::DOUBLE) AS fl, row_number() OVER (ORDER BY n * 0.2::DOUBLE - floor(n * 0.2::DOUBLE) DESC, lang) AS turn,
                    sum(floor(n * 0.2::DOUBLE)) OVER () AS fls, ceil(sum(n) OVER () * 0.2::DOUBLE) AS want FROM t),
            z AS (SELECT lang, fl + (turn <= want - fls)::INT AS quota FROM f)
            SELECT lang, doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= quota
                THEN 'test' ELSE 'train' END AS split FROM documents JOIN z USING (lang)""",
        "class_samples": f"""SELECT intent, label_name, doc_id, row_number() OVER (PARTITION BY intent ORDER BY label_name, doc_id)::INT AS sample_no
            FROM {LABELLED_DOCS} JOIN {MAP} ON src_intent = label_name QUALIFY sample_no <= 3""",
        "label_counts": f"SELECT * FROM {counts} ORDER BY n DESC, label_name",
        "label_stats": f"""SELECT sum(n)::BIGINT AS total_examples, count(*) AS num_intents, round(avg(n), 1) AS avg_examples_per_intent,
            min(n) AS min_examples_per_intent, max(n) AS max_examples_per_intent FROM {counts}""",
        "mapped_distribution": f"SELECT intent, sum(n)::BIGINT AS n FROM {counts} JOIN {MAP} ON src_intent = label_name GROUP BY 1",
        "map_coverage": f"""SELECT count(*) AS num_intents, {len(SOURCE_MAP)}::BIGINT AS mapped_intents, count(src_intent) AS matched_intents,
            round({len(SOURCE_MAP)} * 100.0::DOUBLE / count(*), 1) AS coverage_pct,
            round(count(src_intent) * 100.0::DOUBLE / count(*), 1) AS matched_coverage_pct
            FROM {counts} LEFT JOIN {MAP} ON src_intent = label_name""",
        "unmapped": f"SELECT DISTINCT source AS label_name FROM documents EXCEPT SELECT src_intent FROM {MAP}",
        "len_by_label": f"""SELECT source AS label_name, round(avg(len({WORDS.format('text')})), 1) AS avg_words
            FROM documents GROUP BY 1 ORDER BY avg_words DESC, label_name LIMIT 10""",
        "label_union": f"SELECT source AS label FROM documents UNION SELECT src_intent FROM {MAP}",
        "centroids": f"WITH {CENTROIDS} SELECT label, dim::INT AS dim, round(value, 4) AS value FROM m",
        "knn_topk": f"WITH {knn()} SELECT query_id, id, round(sim, 4) AS similarity, rank FROM t",
        "knn_vote": f"WITH {knn()} SELECT query_id, label, round(sum(sim), 4) AS vote FROM t GROUP BY 1, 2",
        "centroid_scores": f"""WITH {CENTROIDS} SELECT vec_id AS id, c.label,
            round(list_cosine_similarity(embedding::DOUBLE[], cv), 4) AS score FROM embeddings, c""",
        "blend": f"""WITH {knn()}, {CENTROIDS},
            v AS (SELECT query_id, label, sum(sim) AS vote FROM t GROUP BY 1, 2),
            b AS (SELECT query_id, max(vote) AS best FROM v GROUP BY 1),
            s AS (SELECT e.vec_id AS query_id, c.label, 0.6 * coalesce(vote / nullif(best, 0), 0) + 0.4 * list_cosine_similarity(e.v, cv) AS s
                  FROM e CROSS JOIN c LEFT JOIN v ON v.query_id = e.vec_id AND v.label = c.label
                  LEFT JOIN b ON b.query_id = e.vec_id),
            n2 AS (SELECT *, CASE WHEN sum(s) OVER w > 0 THEN s / sum(s) OVER w ELSE s END AS ns FROM s WINDOW w AS (PARTITION BY query_id))
            SELECT query_id, label, round(ns, 4) AS confidence FROM n2
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ns DESC, label) = 1""",
        "one_query_topk": """SELECT b.vec_id AS id, round(list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 4) AS similarity
            FROM embeddings b, (SELECT * FROM embeddings WHERE vec_id = 0) a
            ORDER BY round(list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 9) DESC, b.vec_id LIMIT 10""",
        "pair_similarity": f"SELECT id, round(s, 4) AS similarity FROM {vec_pairs}",
        "pair_similarity_mean": f"SELECT round(avg(s), 4) AS semantic_similarity_mean FROM {vec_pairs}",
        "classify_metrics": f"""WITH {CLASSES} SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, support
            FROM prf WHERE agent = 'words' AND support > 0""",
        "classify_summary": f"""WITH {CLASSES} SELECT round(sum(tp)::DOUBLE / sum(support), 4) AS accuracy, round(avg(p), 4) AS macro_precision,
            round(avg(r), 4) AS macro_recall, round(avg(f), 4) AS macro_f1 FROM prf WHERE agent = 'words'""",
        "confusion": f"SELECT * FROM {words_only} WHERE pred IN (SELECT lang FROM documents)",
        "confusion_matrix": "SELECT truth, " + ", ".join(
            f"coalesce(sum(n) FILTER (pred = '{x}'), 0)::BIGINT AS {x}" for x in ("de", "en", "es", "fr"))
            + f" FROM {words_only} WHERE pred IN ('de', 'en', 'es', 'fr') GROUP BY 1",
        "truth_labels": "SELECT DISTINCT lang AS label FROM documents",
        "report": f"""WITH {CLASSES}, pr AS (SELECT * FROM prf WHERE agent = 'words'),
            a AS (SELECT sum(tp)::DOUBLE / sum(support) AS acc, sum(support)::BIGINT AS n, avg(p) AS mp, avg(r) AS mr, avg(f) AS mf,
                    sum(p * support) / sum(support) AS wp, sum(r * support) / sum(support) AS wr, sum(f * support) / sum(support) AS wf FROM pr)
            SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, support FROM pr
            UNION ALL SELECT 'accuracy', round(acc, 4), round(acc, 4), round(acc, 4), n FROM a
            UNION ALL SELECT 'macro avg', round(mp, 4), round(mr, 4), round(mf, 4), n FROM a
            UNION ALL SELECT 'weighted avg', round(wp, 4), round(wr, 4), round(wf, 4), n FROM a""",
        "binary_metrics": f"""WITH {DECIDED},
            x AS (SELECT truth = 'ESCALATE' AS t, decision = 'ESCALATE' AS p FROM dec JOIN tru USING (doc_id)),
            n AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (p) AS pp, count(*) FILTER (t) AS tt,
                    count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT t) AS tn,
                    count(*) FILTER (t = p) AS ok, count(*) AS c FROM x)
            SELECT round(ok / c, 4) AS accuracy, round(coalesce(tp / nullif(pp, 0), 0), 4) AS precision,
              round(coalesce(tp / nullif(tt, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(pp + tt, 0), 0), 4) AS f1,
              round(coalesce(fn / nullif(tt, 0), 0), 4) AS false_auto_handle_rate,
              round(coalesce(fp / nullif(tn, 0), 0), 4) AS false_escalation_rate,
              fn AS false_auto_handle_count, fp AS false_escalation_count FROM n""",
        "align_metrics": """SELECT count(*) AS n, 'prediction' AS side FROM documents ANTI JOIN labels USING (doc_id)
            UNION ALL SELECT count(*), 'gold' FROM labels ANTI JOIN documents USING (doc_id)""",
        "benchmark_summary": f"WITH {AGENT_METRICS} SELECT agent, accuracy, macro_f1, false_auto_handle_rate FROM w",
        "compare_agents": f"""WITH {AGENT_METRICS},
            lg AS (UNPIVOT w ON accuracy, macro_f1, false_auto_handle_rate INTO NAME metric VALUE value),
            o AS (SELECT *, CASE agent WHEN 'words' THEN 1 WHEN 'letters' THEN 2 ELSE 3 END AS place,
                    CASE WHEN metric = 'false_auto_handle_rate' THEN -value ELSE value END AS good FROM lg)
            SELECT metric, max(value) FILTER (agent = 'words') AS words, max(value) FILTER (agent = 'letters') AS letters,
              max(value) FILTER (agent = 'constant') AS constant, arg_max(agent, (good, -place)) AS best_agent FROM o GROUP BY 1""",
        "template_reply": template_sql(),
        "nn_reply": f"""SELECT id, coalesce(reply, {q(fv.CANNED_REPLY)}) AS response,
            CASE WHEN reply IS NULL THEN 'canned' ELSE '1nn_verbatim' END AS response_method,
            CASE WHEN reply IS NULL THEN '' ELSE id::VARCHAR END AS grounding FROM {MESSAGES} LEFT JOIN {PAIRS} USING (id)""",
        "canned": f"SELECT id, {q(fv.CANNED_REPLY)} AS response, 'canned' AS response_method, '' AS grounding FROM {MESSAGES}",
        "issue_types": f"SELECT doc_id, CASE {issues} ELSE 'this' END AS issue_type FROM documents",
        "prompts": prompt_sql(),
        "judge_prompts": f"SELECT id, md5({judge_prompt}) AS prompt_md5, length({judge_prompt})::INT AS prompt_len FROM {REPLIES}",
        "judge_scores": f"SELECT id, {dims} FROM {judge}",
        "judge_summary": " UNION ALL ".join(
            f"SELECT {q(d)} AS dim, round(avg({d}), 3) AS mean, round(stddev_pop({d}), 3) AS std, min({d}) AS min, max({d}) AS max FROM {judge}"
            for d in fv.DIMENSIONS),
        "pass_rate": f"""SELECT count(*) AS num_evaluated, count(*) FILTER ({PASSED}) AS pass_count,
            round(count(*) FILTER ({PASSED}) / count(*), 4) AS pass_rate FROM {judge}""",
        "agreement": agreement_sql(),
        "judge_reply_parse": "SELECT doc_id, " + ", ".join(
            f"CASE WHEN ok THEN {c} END AS {d}" for c, d in zip(("fg", "ac", "te", "se"), fv.DIMENSIONS)) + f" FROM {JUDGE_JSON}",
        "judge_batch": "SELECT h.id, " + ", ".join(
            f"CASE WHEN ok THEN {c} ELSE {d} END AS {d}" for c, d in zip(("fg", "ac", "te", "se"), fv.DIMENSIONS))
            + f", CASE WHEN ok THEN 'llm' ELSE 'heuristic' END AS judge_method FROM {judge} h LEFT JOIN {JUDGE_JSON} j ON j.doc_id = h.id",
        "rouge_n": f"SELECT id, rouge1, rouge2 FROM {rouge_select('1', 'rouge1')} JOIN {rouge_select('2', 'rouge2')} USING (id)",
        "unigram_bleu": f"SELECT id, unigram_bleu FROM {rouge_select('w', 'unigram_bleu')}",
        "quality_means": f"""SELECT round(avg(rouge1), 4) AS rouge1_mean, round(avg(rouge2), 4) AS rouge2_mean, round(avg(unigram_bleu), 4) AS bleu_mean
            FROM {rouge_select('1', 'rouge1')} JOIN {rouge_select('2', 'rouge2')} USING (id) JOIN {rouge_select('w', 'unigram_bleu')} USING (id)""",
        "token_overlap": f"""WITH t AS (SELECT id, list_distinct({WORDS.format('lower(response)')}) AS a, list_distinct({WORDS.format('lower(reference)')}) AS b FROM {REPLIES})
            SELECT id, len(list_intersect(a, b))::INT AS shared, len(list_distinct(list_concat(a, b)))::INT AS all_tokens,
              (len(a) - len(list_intersect(a, b)))::INT AS only_response FROM t""",
        "scalar_text": f"""SELECT doc_id, md5(lower(text)) AS lower_md5,
            md5({CLEAN.format("('@a  @b ' || chr(10) || text || ' ' || chr(10))")}) AS clean_md5,
            length({TRIM.format("(' ' || chr(10) || chr(9) || text || chr(10) || ' ')")})::INT AS strip_len,
            len({WORDS.format('text')})::INT AS n_words, length(text)::INT AS n_points,
            {any_term(('thble', 'schie'))} AS has_terms, starts_with(text, 'The') AS starts_the,
            round(length(text) / 7.0::DOUBLE, 3) AS rounded, least(200, greatest(10, len({WORDS.format('text')})))::INT AS clamped,
            upper(lang[1]) || lang[2:] || ' ' || upper(source[1]) || source[2:] AS display FROM documents""",
        "json_roundtrip": "SELECT doc_id, quality, toxic FROM labels",
        "materialise_once": "SELECT doc_id, quality, toxic FROM labels WHERE quality = 1",
        "vectors_roundtrip": """SELECT vec_id AS id, label, generate_subscripts(embedding, 1)::INT - 1 AS place,
            round(unnest(embedding)::DOUBLE, 5) AS value FROM embeddings""",
        "kb_index": f"""WITH {term_vectors("kb_texts").replace("rows_of AS", f"kb_texts AS (SELECT min(id) AS id, msg AS text FROM {PAIRS} GROUP BY msg), rows_of AS", 1)}
            SELECT id, term, round(w, 6) AS weight FROM v""",
        "text_retrieval": retrieval("(SELECT doc_id AS id, text FROM documents)", "(SELECT item_id AS id, text FROM benchmark)", 3),
        "text_retrieval_appended": retrieval("(SELECT doc_id AS id, text FROM documents)", "(SELECT doc_id AS id, text FROM documents WHERE doc_id % 20 = 0)", 5, True),
        "rouge_l": longest_common(),
        "knn_index_recall": """SELECT count(*) FILTER (vec_id % 20 = 0) AS n_queries,
            count(*) FILTER (vec_id % 20 = 0) * least(5, count(*) - 1) AS n_neighbours, true AS reached FROM embeddings""",
        "agent_results": f"""WITH {AGENT_METRICS} SELECT agent, metric, value FROM
            (UNPIVOT w ON accuracy, macro_f1, false_auto_handle_rate INTO NAME metric VALUE value)""",
        "stream_first_seen": "SELECT DISTINCT md5(text) AS msg_md5 FROM documents",
        "stream_first_seen_bounded": "SELECT DISTINCT md5(concat_ws('|', user_id, event_type, props)) AS msg_md5 FROM events",
    }
    out["knn_pruned"] = out["knn_topk"]
    return out
