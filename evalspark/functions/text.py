"""Text column expressions over generated responses and prompts.

Everything here is a built-in Spark expression (string functions, ``rlike``,
higher-order array functions over ``split`` lines), so it runs inside
whole-stage codegen on the executors; no Python per row.

Regex flavour: the fixed patterns below are written as Python regexes (the
definitions they reproduce); :func:`java_regex` adapts them for the JVM
engine: literal braces are escaped, ``(?d)`` makes ``\\n`` the only line
terminator (Python's rule) and the Python flags become inline flags.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_regex(pattern: str, multiline: bool = False, ignorecase: bool = False) -> str:
    """Python regex text -> Java regex text with equivalent behaviour."""
    p = re.sub(r"(?<!\\)([{}])", r"\\\1", pattern)
    flags = "d" + ("m" if multiline else "") + ("i" if ignorecase else "")
    return f"(?{flags}){p}"


# the ASCII whitespace that Python's str.strip() removes (and Java's \s matches)
_WS = " \t\n\x0b\x0c\r"


def pystrip(c: Column | str) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace (not only spaces)."""
    return F.btrim(col(c), F.lit(_WS))


def pylstrip(c: Column | str) -> Column:
    return F.ltrim(col(c), F.lit(_WS))


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    """Any phrase contained. An OR of ``contains`` (not a lambda over a
    literal array): ``text`` is then evaluated once per row by common
    subexpression elimination instead of once per phrase."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n")


# ----------------------------------------------------------------- TX-6
# fixed values: conversational indicator phrases (four lists of the reference)
CONVERSATIONAL_PHRASES = {
    "full": ["here's", "certainly", "to complete", "this function", "i'll", "let me", "you can", "the code",
             "this code", "sure", "here is", "i can help", "let's", "we can", "explanation", "note that"],
    "basic": ["here's", "certainly", "to complete", "this function", "i'll", "let me", "you can", "the code",
              "this code", "sure"],
    "validation": ["here's", "certainly", "to complete", "this function", "i'll", "let me", "you can",
                   "the code", "this code", "sure", "here is"],
    "short": ["here's", "certainly", "to complete", "this function"],
}


def is_conversational(text: Column | str, variant: str = "full") -> Column:
    """TX-6: any phrase of the list contained, case-insensitive; empty/NULL -> false."""
    t = col(text)
    return F.coalesce(contains_any(F.lower(t), CONVERSATIONAL_PHRASES[variant]), F.lit(False))


# ----------------------------------------------------------------- TX-7
# fixed values: line prefixes dropped by the two cleaners
PREFIXES_OLD = ["Here's", "Here is", "Certainly", "Sure", "I'll", "To complete", "The function", "This function",
                "You can", "Let me", "I can", "```python", "```", "# Explanation", "# This"]
COMMENT_WORDS_OLD = ["this", "the", "here", "explanation", "note", "example"]
PREFIXES_NEW = ["here's", "here is", "certainly", "sure", "i'll", "to complete", "the function", "this function",
                "you can", "let me", "i can", "```python", "```", "# explanation", "# this", "# here"]
COMMENT_WORDS_NEW = ["this", "the", "here", "explanation", "note", "example", "above", "below"]


def _starts_any(s: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(s, F.lit(p))
    return out


def prefix_clean(text: Column | str, variant: str = "new") -> Column:
    """TX-7: drop lines that start (after strip) with a conversational prefix
    or are ``# `` comments with an explanation word; join and strip.

    ``old``: case-sensitive prefixes. ``new``: case-insensitive, also drops
    leading blank lines and fence lines, and unwraps a result that is still
    fenced on its first and last line.
    """
    ls = lines(text)
    if variant == "old":
        def keep(l):
            s = pystrip(l)
            expl = F.startswith(s, F.lit("# ")) & contains_any(F.lower(s), COMMENT_WORDS_OLD)
            return ~(_starts_any(s, PREFIXES_OLD) | expl)
        return pystrip(F.array_join(F.filter(ls, keep), "\n"))

    def keep_new(l):
        s = pystrip(l)
        low = F.lower(s)
        expl = F.startswith(s, F.lit("# ")) & contains_any(low, COMMENT_WORDS_NEW)
        return ~(_starts_any(low, PREFIXES_NEW) | F.startswith(s, F.lit("```")) | expl)

    # index of the first non-blank kept line: blank lines before it are dropped
    kept = F.filter(ls, keep_new)
    first = F.array_position(F.transform(kept, lambda l: pystrip(l) != ""), F.lit(True))
    body = F.when(first == 0, F.array().cast("array<string>")).otherwise(F.slice(kept, first, F.size(kept)))
    res = pystrip(F.array_join(body, "\n"))
    rl = lines(res)
    unwrap = F.startswith(res, F.lit("```")) & F.endswith(res, F.lit("```")) & (F.size(rl) >= 2)
    inner = pystrip(F.array_join(F.slice(rl, 2, F.size(rl) - 2), "\n"))
    return F.when(col(text).isNull() | (col(text) == ""), col(text)).otherwise(
        F.when(unwrap, inner).otherwise(res))


# ----------------------------------------------------------------- TX-9
def contains_expected(text: Column | str, expected: Column, mode: str = "nospace") -> Column:
    """TX-9: any expected string contained, case-insensitive.

    ``nospace``: spaces removed on both sides first; ``plain``: as is.
    ``expected`` is an array<string> column.
    """
    t = F.lower(col(text))
    if mode == "nospace":
        t = F.replace(t, F.lit(" "), F.lit(""))
        return F.coalesce(F.exists(expected, lambda e: F.contains(t, F.replace(F.lower(e), F.lit(" "), F.lit("")))),
                          F.lit(False))
    return F.coalesce(F.exists(expected, lambda e: F.contains(t, F.lower(e))), F.lit(False))


# ----------------------------------------------------------------- TX-11
# fixed values: logic markers of the heuristic check
LOGIC_MARKS = ["for", "if", "while", "range", "len", "abs", "%", "==", "!=", "<", ">"]


def heuristic_pass(code: Column | str) -> Column:
    """TX-11: non-trivial (stripped length >= 5 and > 10), has ``return`` and a logic marker."""
    c = col(code)
    n = F.length(pystrip(c))
    return F.coalesce((n >= 5) & (n > 10) & F.contains(c, F.lit("return")) & contains_any(c, LOGIC_MARKS),
                      F.lit(False))


# ----------------------------------------------------------------- TX-12
# fixed values: language patterns (Python regex text), keywords then syntax, in the listed language order
LANGUAGE_PATTERNS = [
    ("python",
     [r"\bdef\s+\w+\s*\(", r"\bclass\s+\w+\s*[:(\s]", r"\bimport\s+\w+", r"\bfrom\s+\w+\s+import",
      r"\bif\s+__name__\s*==\s*['\"]__main__['\"]", r"\bprint\s*\(", r"\brange\s*\(", r"\blen\s*\("],
     [r":\s*$", r"^\s*#", r"\bself\.", r'""".*?"""', r"'''.*?'''"]),
    ("javascript",
     [r"\bfunction\s+\w+\s*\(", r"\bconst\s+\w+\s*=", r"\blet\s+\w+\s*=", r"\bvar\s+\w+\s*=",
      r"\bconsole\.log\s*\(", r"\breturn\s+", r"\brequire\s*\(", r"\bmodule\.exports\s*="],
     [r";\s*$", r"//.*$", r"/\*.*?\*/", r"{\s*$", r"}\s*$"]),
    ("java",
     [r"\bpublic\s+class\s+\w+", r"\bpublic\s+static\s+void\s+main", r"\bpublic\s+\w+\s+\w+\s*\(",
      r"\bprivate\s+\w+\s+\w+", r"\bSystem\.out\.print", r"\bString\s+\w+\s*=", r"\bint\s+\w+\s*=",
      r"\bnew\s+\w+\s*\("],
     [r";\s*$", r"//.*$", r"{\s*$", r"}\s*$", r"\bpackage\s+[\w.]+;", r"\bimport\s+[\w.]+;"]),
    ("cpp",
     [r"#include\s*<[\w./]+>", r'#include\s*"[\w./]+"', r"\bint\s+main\s*\(", r"\bstd::\w+", r"\bcout\s*<<",
      r"\bcin\s*>>", r"\bnamespace\s+\w+", r"\bclass\s+\w+\s*{", r"\bpublic:\s*$", r"\bprivate:\s*$"],
     [r";\s*$", r"//.*$", r"/\*.*?\*/", r"{\s*$", r"}\s*$", r"::\w+"]),
    ("go",
     [r"\bpackage\s+main", r"\bfunc\s+main\s*\(\s*\)", r"\bfunc\s+\w+\s*\(", r"\bimport\s*\(", r"\bfmt\.Print",
      r"\bvar\s+\w+\s+\w+", r"\b:=\s*", r"\bgo\s+\w+\s*\("],
     [r"{\s*$", r"}\s*$", r"//.*$", r"/\*.*?\*/"]),
    ("rust",
     [r"\bfn\s+main\s*\(\s*\)", r"\bfn\s+\w+\s*\(", r"\blet\s+\w+\s*=", r"\blet\s+mut\s+\w+", r"\bprintln!\s*\(",
      r"\bmatch\s+\w+\s*{", r"\bpub\s+fn\s+\w+", r"\buse\s+\w+"],
     [r";\s*$", r"//.*$", r"/\*.*?\*/", r"{\s*$", r"}\s*$", r"!\s*\("]),
    ("typescript",
     [r"\bfunction\s+\w+\s*\(", r"\bconst\s+\w+:\s*\w+\s*=", r"\blet\s+\w+:\s*\w+\s*=", r"\binterface\s+\w+\s*{",
      r"\btype\s+\w+\s*=", r"\bconsole\.log\s*\(", r"\bexport\s+\w+", r"\bimport\s+.*\bfrom\s+"],
     [r";\s*$", r"//.*$", r"/\*.*?\*/", r":\s*\w+\s*[=;]", r"{\s*$", r"}\s*$"]),
]


_SPECIAL = set("\\[](){}^$.*+?|")


def required_literal(pattern: str) -> str | None:
    """A substring every match of ``pattern`` contains, read off its start:
    the word after a leading ``\\b`` or a leading run of plain characters
    (a character followed by a quantifier is not required). None if unsure."""
    m = re.match(r"\\b([A-Za-z_]+)", pattern)
    if m:
        rest = pattern[m.end():]
        word = m.group(1)
        if rest[:1] in ("*", "?", "{", "+"):
            word = word[:-1]
        return word or None
    run = ""
    for i, ch in enumerate(pattern):
        if ch in _SPECIAL and not (ch in "{}" and i == 0):
            break
        run += ch
    if run and pattern[len(run):len(run) + 1] in ("*", "?", "{", "+"):
        run = run[:-1]
    return run or None


def _hit(code: Column, pattern: str, multiline: bool, ignorecase: bool) -> Column:
    """rlike behind a cheap ``contains`` guard on a literal the match needs
    (And short-circuits, so most rows never reach the regex engine)."""
    lit = required_literal(pattern)
    rx = code.rlike(java_regex(pattern, multiline, ignorecase))
    if not lit:
        return rx
    guard = F.contains(F.lower(code), F.lit(lit.lower())) if ignorecase else F.contains(code, F.lit(lit))
    return guard & rx


def language_score(code: Column, keywords: Sequence[str], syntax: Sequence[str]) -> Column:
    """Score of one language: keyword hits +1 (multiline, ignore case), syntax
    hits +0.5 (multiline), x1.5 when more than two keywords hit, divided by
    the number of patterns, capped at 1."""
    kw = sum((F.when(_hit(code, p, True, True), 1).otherwise(0) for p in keywords), F.lit(0))
    syn = sum((F.when(_hit(code, p, True, False), 1).otherwise(0) for p in syntax), F.lit(0))
    raw = kw + F.lit(0.5) * syn
    boost = F.when(kw > 2, F.lit(1.5)).otherwise(F.lit(1.0))
    return F.least(raw * boost / F.lit(float(len(keywords) + len(syntax))), F.lit(1.0))


def _sql_str(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_hit(c: str, pattern: str, multiline: bool, ignorecase: bool) -> str:
    lit = required_literal(pattern)
    rx = f"{c} RLIKE {_sql_str(java_regex(pattern, multiline, ignorecase))}"
    if not lit:
        return f"({rx})"
    guard = (f"contains(lower({c}), {_sql_str(lit.lower())})" if ignorecase else f"contains({c}, {_sql_str(lit)})")
    return f"({guard} AND {rx})"


def detect_language_sql(c: str) -> str:
    """TX-12 as one SQL expression over column ``c`` (same rule as
    ``detect_language``). Built as text and parsed once by Catalyst, which
    avoids thousands of client calls for a 90-pattern expression."""
    cands = []
    for i, (name, kws, syn) in enumerate(LANGUAGE_PATTERNS):
        kw = " + ".join(f"CASE WHEN {_sql_hit(c, p, True, True)} THEN 1 ELSE 0 END" for p in kws)
        sy = " + ".join(f"CASE WHEN {_sql_hit(c, p, True, False)} THEN 1 ELSE 0 END" for p in syn)
        total = float(len(kws) + len(syn))
        score = (f"least((({kw}) + 0.5D * ({sy})) * CASE WHEN ({kw}) > 2 THEN 1.5D ELSE 1.0D END / {total}D, 1.0D)")
        cands.append(f"named_struct('score', {score}, 'neg_order', {-i}, 'language', '{name}')")
    best = f"greatest({', '.join(cands)})"
    blank = f"({c} IS NULL OR btrim({c}, {_sql_str(_WS)}) = '')"
    return (f"named_struct('language', CASE WHEN {blank} OR b.score < 0.2D THEN 'unknown' ELSE b.language END, "
            f"'confidence', CASE WHEN {blank} OR b.score < 0.2D THEN 0.0D ELSE b.score END)").replace(
        "b.score", f"{best}.score").replace("b.language", f"{best}.language")


def detect_language(code: Column | str) -> Column:
    """TX-12: struct(language, confidence). Best score wins, ties go to the
    language listed first; a best score below 0.2 (or blank code) is
    ``unknown`` with confidence 0."""
    if isinstance(code, str):
        return F.expr(detect_language_sql(f"`{code}`"))
    c = col(code)
    cands = [F.struct(language_score(c, kws, syn).alias("score"), F.lit(-i).alias("neg_order"),
                      F.lit(name).alias("language"))
             for i, (name, kws, syn) in enumerate(LANGUAGE_PATTERNS)]
    best = F.greatest(*cands)
    blank = c.isNull() | (pystrip(c) == "")
    unknown = blank | (best["score"] < 0.2)
    return F.struct(F.when(unknown, F.lit("unknown")).otherwise(best["language"]).alias("language"),
                    F.when(unknown, F.lit(0.0)).otherwise(best["score"]).alias("confidence"))


# ----------------------------------------------------------------- TX-13
# fixed values: language hints in prompts, in the listed order
PROMPT_LANGUAGE_HINTS = [
    ("python", ["python", "py", "def ", "import "]),
    ("javascript", ["javascript", "js", "node", "function "]),
    ("java", ["java", "class ", "public static void main"]),
    ("cpp", ["c++", "cpp", "#include", "std::"]),
    ("go", ["go", "golang", "func main", "package main"]),
    ("rust", ["rust", "fn main", "cargo"]),
    ("typescript", ["typescript", "ts", "interface "]),
]


def prompt_language(prompt: Column | str) -> Column:
    """TX-13: first language whose hint is contained in the lower-cased prompt; else NULL."""
    low = F.lower(col(prompt))
    out = None
    for name, hints in PROMPT_LANGUAGE_HINTS:
        cond = contains_any(low, hints)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


# ----------------------------------------------------------------- TX-17
def structure_checks(code: Column | str) -> Column:
    """TX-17: six yes/no checks and the share passed."""
    c = col(code)
    cnt = lambda ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    balanced = (cnt("(") == cnt(")")) & (cnt("[") == cnt("]")) & (cnt("{") == cnt("}"))
    checks = [
        ("has_content", F.length(pystrip(c)) > 10),
        ("has_function_def", F.contains(c, F.lit("def "))),
        ("has_return", F.contains(c, F.lit("return"))),
        ("has_docstring", F.contains(c, F.lit('"""')) | F.contains(c, F.lit("'''"))),
        ("reasonable_length", (F.length(c) > 50) & (F.length(c) < 2000)),
        ("has_python_syntax", balanced),
    ]
    share = sum((x.cast("int") for _, x in checks), F.lit(0)) / F.lit(float(len(checks)))
    return F.struct(*[x.alias(n) for n, x in checks], share.alias("score"))


# ----------------------------------------------------------------- TX-18
# fixed values: reasoning words and answer letters
REASONING_WORDS = ["because", "since", "therefore", "so", "thus"]
ANSWER_LETTERS = ["A)", "B)", "C)", "D)"]


def reasoning_score(response: Column | str, expected_terms: Column) -> Column:
    """TX-18: 0.2 substantial (stripped > 20) + 0.3 reasoning word + 0.2
    explanation (> 50 chars) + 0.2 x share of expected terms found (capped at
    1) + 0.1 option letter."""
    r = col(response)
    low = F.lower(r)
    found = F.size(F.filter(expected_terms, lambda t: F.contains(low, F.lower(t))))
    n_terms = F.size(expected_terms)
    score = (F.when(F.length(pystrip(r)) > 20, 0.2).otherwise(0.0)
             + F.when(contains_any(low, REASONING_WORDS), 0.3).otherwise(0.0)
             + F.when(F.length(r) > 50, 0.2).otherwise(0.0)
             + F.when(found > 0, F.lit(0.2) * F.least(found / n_terms, F.lit(1.0))).otherwise(0.0)
             + F.when(contains_any(r, ANSWER_LETTERS), 0.1).otherwise(0.0))
    return score


# ----------------------------------------------------------------- PJ-7
# fixed values: unsafe substrings in tasks and prompts, unsafe characters in model names
UNSAFE_TASK = ["__import__", "eval(", "exec(", "subprocess", "os.system", "file:/", "http://", "https://"]
UNSAFE_PROMPT = ["__import__", "eval(", "exec(", "subprocess", "os.system", "rm -rf", "del ", "format(", "file://",
                 "http://", "https://"]
UNSAFE_MODEL_CHARS = ["../", "../../", ";", "&", "|", "`"]


def unsafe(text: Column | str, kind: str = "prompt") -> Column:
    """PJ-7: true when the text contains an unsafe substring (lower-cased for
    tasks and prompts; model names are checked as is)."""
    t = col(text)
    if kind == "model":
        return contains_any(t, UNSAFE_MODEL_CHARS)
    return contains_any(F.lower(t), UNSAFE_TASK if kind == "task" else UNSAFE_PROMPT)


# ----------------------------------------------------------------- PJ-8
# fixed values: dangerous line patterns (Python regex text, matched case-insensitively)
DANGEROUS_LINE_PATTERNS = [r"import\s+os\s*", r"import\s+sys\s*", r"import\s+subprocess\s*",
                           r"from\s+os\s+import\s*", r"from\s+sys\s+import\s*", r"from\s+subprocess\s+import\s*",
                           r"__import__\s*\(", r"eval\s*\(", r"exec\s*\("]


def redact_dangerous_lines(code: Column | str) -> Column:
    """PJ-8: lines matching a dangerous pattern become ``# REMOVED DANGEROUS LINE: <line>``."""
    pat = java_regex("|".join(f"(?:{p})" for p in DANGEROUS_LINE_PATTERNS), ignorecase=True)
    return F.array_join(F.transform(lines(code), lambda l: F.when(l.rlike(pat),
                                                                  F.concat(F.lit("# REMOVED DANGEROUS LINE: "), l))
                                    .otherwise(l)), "\n")
