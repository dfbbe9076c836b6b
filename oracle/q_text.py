"""Oracle statements: text and prompt operators (RE2 regexes in DuckDB).

The fixed word lists and regex texts are the shared definitions; the way
they are combined (scores, cleaning, feature formulas) is written here
again in SQL.
"""

from __future__ import annotations

import re

from evalspark.functions import features as FE
from evalspark.functions import text as TX

from .base import _reg


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def re2(p: str, flags: str = "") -> str:
    p = re.sub(r"(?<!\\)([{}])", r"\\\1", p)
    return q((f"(?{flags})" if flags else "") + p)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def any_in(text: str, phrases) -> str:
    return f"(len(list_filter({lst(phrases)}, lambda p: contains({text}, p))) > 0)"


def starts_any(text: str, prefixes) -> str:
    return f"(len(list_filter({lst(prefixes)}, lambda p: starts_with({text}, p))) > 0)"


G = "generations"

_reg("tx6_is_conversational", "SELECT gen_id, " + ", ".join(
    f"coalesce({any_in('lower(raw_text)', ph)}, false) AS conv_{k}" for k, ph in TX.CONVERSATIONAL_PHRASES.items())
     + " FROM generations", G)

_old_keep = (f"NOT ({starts_any(strip('l'), TX.PREFIXES_OLD)} OR (starts_with({strip('l')}, '# ') AND "
             f"{any_in('lower(' + strip('l') + ')', TX.COMMENT_WORDS_OLD)}))")
_new_keep = (f"NOT ({starts_any('lower(' + strip('l') + ')', TX.PREFIXES_NEW)} OR starts_with({strip('l')}, '```') OR "
             f"(starts_with({strip('l')}, '# ') AND {any_in('lower(' + strip('l') + ')', TX.COMMENT_WORDS_NEW)}))")

_reg("tx7_prefix_clean", f"""
WITH a AS (SELECT gen_id, raw_text, string_split(raw_text, chr(10)) AS ls FROM generations),
b AS (SELECT *, {strip(f"array_to_string(list_filter(ls, lambda l: {_old_keep}), chr(10))")} AS clean_old,
             list_filter(ls, lambda l: {_new_keep}) AS kept FROM a),
c AS (SELECT *, list_position(list_transform(kept, lambda l: {strip('l')} <> ''), true) AS pos FROM b),
d AS (SELECT *, {strip("array_to_string(CASE WHEN pos IS NULL OR pos = 0 THEN CAST([] AS VARCHAR[]) ELSE kept[pos:] END, chr(10))")} AS res FROM c),
e AS (SELECT *, string_split(res, chr(10)) AS rl FROM d)
SELECT gen_id, clean_old,
       CASE WHEN raw_text IS NULL OR raw_text = '' THEN raw_text
            WHEN starts_with(res, '```') AND ends_with(res, '```') AND len(rl) >= 2
                 THEN {strip("array_to_string(rl[2:len(rl) - 1], chr(10))")}
            ELSE res END AS clean_new
FROM e""", G)

_reg("tx9_contains_expected", """
WITH a AS (SELECT gen_id, raw_text, [expected, lower(problem_id)] AS exp FROM generations)
SELECT gen_id,
  coalesce(len(list_filter(exp, lambda e: contains(replace(lower(raw_text), ' ', ''), replace(lower(e), ' ', '')))) > 0, false)
    AS contains_nospace,
  coalesce(len(list_filter(exp, lambda e: contains(lower(raw_text), lower(e)))) > 0, false) AS contains_plain
FROM a""", G)

_reg("tx11_heuristic_pass", f"""
SELECT gen_id, coalesce(length({strip('raw_text')}) >= 5 AND length({strip('raw_text')}) > 10
                        AND contains(raw_text, 'return') AND {any_in('raw_text', TX.LOGIC_MARKS)}, false) AS heuristic_pass
FROM generations""", G)


def _lang_score(kws, syn, c: str = "raw_text") -> str:
    kw = " + ".join(f"CAST(regexp_matches({c}, {re2(p, 'mi')}) AS INTEGER)" for p in kws)
    sy = " + ".join(f"CAST(regexp_matches({c}, {re2(p, 'm')}) AS INTEGER)" for p in syn)
    total = float(len(kws) + len(syn))
    return (f"least((({kw}) + 0.5 * ({sy})) * CASE WHEN ({kw}) > 2 THEN 1.5 ELSE 1.0 END / {total}, 1.0)")


def lang_scores(c: str = "raw_text") -> str:
    return ",\n  ".join(f"{_lang_score(k, s, c)} AS s_{name}" for name, k, s in TX.LANGUAGE_PATTERNS)


_scores = lang_scores()
_names = [n for n, _, _ in TX.LANGUAGE_PATTERNS]
_best = f"greatest({', '.join('s_' + n for n in _names)})"
_pick = "CASE " + " ".join(f"WHEN s_{n} = best THEN '{n}'" for n in _names) + " END"

_reg("tx12_detect_language", f"""
WITH a AS (SELECT gen_id, raw_text,
  {_scores}
  FROM generations),
b AS (SELECT *, {_best} AS best FROM a)
SELECT gen_id,
       CASE WHEN raw_text IS NULL OR {strip('raw_text')} = '' OR best < 0.2 THEN 'unknown' ELSE {_pick} END AS language,
       round(CASE WHEN raw_text IS NULL OR {strip('raw_text')} = '' OR best < 0.2 THEN 0.0 ELSE best END, 6) AS confidence
FROM b""", G)

_reg("tx13_prompt_language", "SELECT gen_id, CASE " + " ".join(
    f"WHEN {any_in('lower(prompt)', hints)} THEN '{name}'" for name, hints in TX.PROMPT_LANGUAGE_HINTS)
     + " END AS prompt_language FROM generations", G)

# ---------------------------------------------------------------- prompt features
KW = lst(FE.PY_KEYWORDS)


def _completion(p: str) -> str:
    return f"""CASE WHEN regexp_matches({p}, {re2(r'def\s+\w+\s*\([^)]*\)\s*:\s*$')}) THEN 'function_body'
       WHEN contains({p}, 'def ') AND ends_with({strip(p)}, ':') THEN 'function_definition'
       WHEN regexp_matches({p}, {re2(r'class\s+\w+.*:\s*$')}) THEN 'class_body'
       WHEN contains({p}, 'class ') AND contains({p}, ':') THEN 'class_definition'
       WHEN contains({p}, '\"\"\"') OR contains({p}, '''''''''') THEN 'docstring'
       WHEN starts_with({strip(p)}, '#') THEN 'comment'
       WHEN contains(lower({p}), 'import') THEN 'import'
       WHEN contains({p}, '=') OR contains(lower({p}), 'return') THEN 'statement'
       ELSE 'expression' END"""


_codes = "CASE ct " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in FE.COMPLETION_CODES.items()) + " END"
_dom_sums = ",\n  ".join(
    "(" + " + ".join(f"CASE WHEN contains(lower(prompt), {q(k)}) THEN {w} ELSE 0.0 END" for k, w in kws.items())
    + f") AS d{i}" for i, (_, kws, _) in enumerate(FE.DOMAINS))
_dom_best = f"greatest({', '.join(f'd{i}' for i in range(len(FE.DOMAINS)))})"
_dom_norm = "CASE " + " ".join(f"WHEN d{i} = dbest THEN (dbest - {lo}) / ({hi} - {lo})"
                               for i, (_, _, (lo, hi)) in enumerate(FE.DOMAINS)) + " END"
_pattern_count = " + ".join(f"CAST(regexp_matches(prompt, {re2(rx, 'm')}) AS INTEGER)" for _, rx in FE.CODE_PATTERNS)
_nest_open = ("len(list_filter(" + lst(FE.NESTING_KEYWORDS) + ", lambda k: starts_with(lower(" + strip("l")
              + "), k || ' ') OR starts_with(lower(" + strip("l") + "), k || ':'))) > 0")
_nest_close = "len(list_filter(" + lst(FE.NESTING_CLOSERS) + ", lambda k: starts_with(lower(" + strip("l") + "), k))) > 0"
_pref = ("CASE " + " ".join(f"WHEN m = {q(n)} THEN {p}" for n, p in FE.MODEL_PREFERENCES) + " "
         + " ".join(f"WHEN contains(m, {q(n.split(':')[0])}) THEN {p}" for n, p in FE.MODEL_PREFERENCES)
         + " ELSE 0.5 END")

FEATS = f"""
a AS (SELECT gen_id, prompt, 'phi3.5:' || model AS m, string_split(prompt, chr(10)) AS ls,
             regexp_extract_all(lower(prompt), '\\b\\w+\\b') AS words,
             regexp_extract_all(prompt, '\\b[a-z_][a-z0-9_]*\\b') AS vars,
             {_completion('prompt')} AS ct,
             {_dom_sums},
             ({_pattern_count}) AS npat
      FROM generations),
b AS (SELECT *, {_dom_best} AS dbest,
             list_reduce(ls, lambda acc, l: {{'cur': CASE WHEN {_nest_close}
                                                        THEN greatest(acc.cur + CASE WHEN {_nest_open} THEN 1 ELSE 0 END - 1, 0)
                                                        ELSE acc.cur + CASE WHEN {_nest_open} THEN 1 ELSE 0 END END,
                                              'mx': greatest(acc.mx, acc.cur + CASE WHEN {_nest_open} THEN 1 ELSE 0 END)}},
                         {{'cur': 0, 'mx': 0}}).mx AS nest_max,
             len(list_distinct(list_filter(words, lambda w: list_contains({KW}, w)))) AS nkw,
             len(list_filter(words, lambda w: list_contains({KW}, w))) AS kwc,
             list_max(list_transform(list_filter(ls, lambda l: {strip('l')} <> ''),
                                     lambda l: length(l) - length(regexp_replace(l, '^\\s+', '')))) AS max_indent
      FROM a),
c AS (SELECT *, least(nest_max / 5.0, 1.0) AS nest, {strip('prompt')} = '' OR prompt IS NULL AS blank FROM b),
f AS (SELECT gen_id, blank, {_pref} AS model_preference,
  least(least(length(prompt) / 1000.0, 1.0) * 0.2 + least(len(ls) / 50.0, 1.0) * 0.2 + nest * 0.3
        + least(nkw / 10.0, 1.0) * 0.15 + least(npat / 8.0, 1.0) * 0.15, 1.0) AS prompt_complexity,
  least(1.0 / (1.0 + exp(-(length(prompt) - 500) / 200.0)), 1.0) AS context_length,
  {_codes} AS completion_type,
  CASE WHEN dbest <= 0 THEN 0.0 ELSE greatest(0.0, least({_dom_norm}, 1.0)) END AS code_domain,
  coalesce(least(max_indent / 16.0, 1.0), 0.0) AS indentation_level,
  nest AS nesting_level,
  CASE WHEN regexp_matches(prompt, {re2(r'def\s+\w+\s*\([^)]*\)\s*:')}) THEN 1.0 ELSE 0.0 END AS has_function_def,
  CASE WHEN regexp_matches(prompt, {re2(r'class\s+\w+\s*(?:\([^)]*\))?\s*:')}) THEN 1.0 ELSE 0.0 END AS has_class_def,
  CASE WHEN len(words) = 0 THEN 0.0 ELSE least(kwc / len(words) * 10.0, 1.0) END AS keyword_density,
  CASE WHEN len(vars) = 0 THEN 0.0 ELSE least(
     list_sum(list_transform(vars, lambda x: length(x))) / len(vars) / 20.0 * 0.3
     + len(list_filter(vars, lambda x: contains(x, '_'))) / len(vars) * 0.2
     + 0.0 * 0.2
     + len(list_filter(vars, lambda x: length(x) > 3)) / len(vars) * 0.3, 1.0) END AS variable_complexity
  FROM c)"""

_reg("tx15_prompt_features", f"WITH {FEATS}\nSELECT gen_id, " + ", ".join(
    f"round(CASE WHEN blank THEN 0.0 ELSE CAST({n} AS DOUBLE) END, 6) AS {n}" for n in FE.FEATURE_NAMES[:-1])
     + ", round(model_preference, 6) AS model_preference FROM f", G)

_reg("tx16_prompt_profile", f"""
WITH a AS (SELECT gen_id, prompt,
  {_completion('prompt')} AS completion_type,
  list_filter([{', '.join(f"CASE WHEN {any_in('lower(prompt)', list(kws))} THEN {q(name)} END" for name, kws, _ in FE.DOMAINS)}],
              lambda x: x IS NOT NULL) AS domains,
  list_filter([{', '.join(f"CASE WHEN regexp_matches(prompt, {re2(rx, 'm')}) THEN {q(name)} END" for name, rx in FE.CODE_PATTERNS)}],
              lambda x: x IS NOT NULL) AS patterns,
  list_sort(list_distinct(list_filter(regexp_extract_all(lower(prompt), '\\b\\w+\\b'), lambda w: list_contains({KW}, w)))) AS keywords,
  list_filter(regexp_split_to_array({strip('prompt')}, '\\s+'), lambda w: w <> '') AS ws
  FROM generations)
SELECT gen_id, completion_type, array_to_string(domains, ',') AS domains, array_to_string(patterns, ',') AS patterns,
       array_to_string(keywords, ',') AS keywords, CAST(length(prompt) AS INTEGER) AS chars,
       CAST(len(string_split(prompt, chr(10))) AS INTEGER) AS lines, CAST(len(ws) AS INTEGER) AS words,
       CAST(len(list_distinct(list_transform(ws, lambda w: lower(w)))) AS INTEGER) AS unique_words
FROM a""", G)


def _cnt(ch: str) -> str:
    return f"(length(raw_text) - length(replace(raw_text, {q(ch)}, '')))"


_reg("tx17_structure_checks", f"""
WITH a AS (SELECT gen_id,
  length({strip('raw_text')}) > 10 AS has_content, contains(raw_text, 'def ') AS has_function_def,
  contains(raw_text, 'return') AS has_return, contains(raw_text, '\"\"\"') OR contains(raw_text, '''''''''') AS has_docstring,
  length(raw_text) > 50 AND length(raw_text) < 2000 AS reasonable_length,
  {_cnt('(')} = {_cnt(')')} AND {_cnt('[')} = {_cnt(']')} AND {_cnt('{')} = {_cnt('}')} AS has_python_syntax
  FROM generations)
SELECT *, round((CAST(has_content AS INTEGER) + CAST(has_function_def AS INTEGER) + CAST(has_return AS INTEGER)
       + CAST(has_docstring AS INTEGER) + CAST(reasonable_length AS INTEGER) + CAST(has_python_syntax AS INTEGER)) / 6.0, 6)
       AS score FROM a""", G)

_reg("tx18_reasoning_score", f"""
WITH a AS (SELECT gen_id, raw_text, lower(raw_text) AS low, [expected, 'function', lower(category)] AS terms FROM generations),
b AS (SELECT *, len(list_filter(terms, lambda t: contains(low, lower(t)))) AS found FROM a)
SELECT gen_id, round(
    CASE WHEN length({strip('raw_text')}) > 20 THEN 0.2 ELSE 0.0 END
  + CASE WHEN {any_in('low', TX.REASONING_WORDS)} THEN 0.3 ELSE 0.0 END
  + CASE WHEN length(raw_text) > 50 THEN 0.2 ELSE 0.0 END
  + CASE WHEN found > 0 THEN 0.2 * least(found / len(terms), 1.0) ELSE 0.0 END
  + CASE WHEN {any_in('raw_text', TX.ANSWER_LETTERS)} THEN 0.1 ELSE 0.0 END, 6) AS reasoning_score
FROM b""", G)

_reg("pj7_unsafe_filter", f"""
SELECT gen_id, {any_in('lower(prompt)', TX.UNSAFE_PROMPT)} AS unsafe_prompt,
       {any_in('lower(raw_text)', TX.UNSAFE_TASK)} AS unsafe_task,
       {any_in("model || '|' || problem_id", TX.UNSAFE_MODEL_CHARS)} AS unsafe_model
FROM generations""", G)

_danger = re2("|".join(f"(?:{p})" for p in TX.DANGEROUS_LINE_PATTERNS), "i")
_reg("pj8_redact_dangerous_lines", f"""
SELECT gen_id, array_to_string(list_transform(string_split(raw_text, chr(10)),
         lambda l: CASE WHEN regexp_matches(l, {_danger}) THEN '# REMOVED DANGEROUS LINE: ' || l ELSE l END), chr(10))
       AS redacted
FROM generations""", G)
