"""Prompt features (TX-15) and prompt profile (TX-16) as column expressions.

The eleven features are computed per row from ``split`` lines, regex
counts and higher-order array functions; the sequential nesting counter is
an ``aggregate`` over the lines with a struct accumulator. No Python runs
per row.
"""

from __future__ import annotations

import keyword

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, contains_any, java_regex, lines, pylstrip, pystrip

PY_KEYWORDS = list(keyword.kwlist)

FEATURE_NAMES = ["prompt_complexity", "context_length", "completion_type", "code_domain", "indentation_level",
                 "nesting_level", "has_function_def", "has_class_def", "keyword_density", "variable_complexity",
                 "model_preference"]

# fixed values: domain keywords with weights, in the listed domain order, and each domain's score range
DOMAINS = [
    ("general", {"python": 1.0, "function": 1.0, "variable": 1.0, "class": 1.0, "method": 1.0, "code": 1.0,
                 "program": 1.0, "script": 1.0, "programming": 1.0, "syntax": 1.0, "loop": 1.0, "condition": 1.0,
                 "algorithm": 1.0, "logic": 1.0, "simple": 1.0}, (0.5, 3.5)),
    ("web_development", {"flask": 2.0, "django": 2.0, "fastapi": 2.0, "express": 2.0, "react": 2.0, "vue": 2.0,
                         "angular": 2.0, "html": 1.5, "css": 1.5, "javascript": 1.5, "dom": 1.5, "fetch": 1.5,
                         "axios": 1.5, "component": 1.5, "hooks": 1.5, "browser": 1.0, "window": 1.0,
                         "document": 1.0, "jquery": 1.0, "http": 1.0, "url": 1.0, "web": 1.0,
                         "application": 1.0}, (1.5, 6.0)),
    ("data_science", {"pandas": 2.0, "numpy": 2.0, "matplotlib": 2.0, "sklearn": 2.0, "scipy": 2.0,
                      "dataframe": 1.5, "array": 1.5, "plot": 1.5, "chart": 1.5, "seaborn": 1.5, "plotly": 1.5,
                      "csv": 1.0, "json": 1.0, "data": 1.0, "dataset": 1.0, "analysis": 1.0,
                      "statistics": 1.0}, (1.5, 7.0)),
    ("machine_learning", {"tensorflow": 2.0, "pytorch": 2.0, "keras": 2.0, "sklearn": 2.0, "model": 1.5,
                          "train": 1.5, "predict": 1.5, "neural": 1.5, "network": 1.5, "deep": 1.5, "complex": 1.5,
                          "accuracy": 1.0, "loss": 1.0, "learning": 1.0, "classification": 1.0,
                          "regression": 1.0}, (1.5, 7.0)),
    ("system_programming", {"subprocess": 2.0, "threading": 2.0, "multiprocessing": 2.0, "socket": 2.0,
                            "os": 1.5, "sys": 1.5, "process": 1.5, "thread": 1.5, "memory": 1.5, "file": 1.0,
                            "path": 1.0, "directory": 1.0, "cpu": 1.0, "system": 1.0}, (1.5, 6.0)),
    ("algorithms", {"algorithm": 2.0, "complexity": 2.0, "recursive": 2.0, "dynamic": 2.0, "sort": 1.5,
                    "search": 1.5, "binary": 1.5, "tree": 1.5, "graph": 1.5, "hash": 1.0, "queue": 1.0,
                    "stack": 1.0, "heap": 1.0, "optimization": 1.0}, (1.5, 6.0)),
    ("database", {"sql": 2.0, "sqlite": 2.0, "postgres": 2.0, "mysql": 2.0, "mongodb": 2.0, "database": 1.5,
                  "query": 1.5, "table": 1.5, "schema": 1.5, "select": 1.0, "insert": 1.0, "update": 1.0,
                  "delete": 1.0, "join": 1.0, "index": 1.0}, (1.5, 7.0)),
    ("testing", {"pytest": 2.0, "unittest": 2.0, "mock": 2.0, "fixture": 2.0, "test": 1.5, "assert": 1.5,
                 "coverage": 1.5, "setup": 1.0, "teardown": 1.0, "tdd": 1.0, "bdd": 1.0, "spec": 1.0}, (1.5, 6.0)),
]

# fixed values: model preferences (exact name, then base name contained)
MODEL_PREFERENCES = [("phi3.5:latest", 0.8), ("mistral:7b-instruct", 0.6), ("qwen2.5-coder:3b", 0.9),
                     ("codellama:13b-instruct", 0.7), ("tinyllama:1.1b", 0.3)]

# fixed values: code patterns (Python regex text, searched with MULTILINE)
CODE_PATTERNS = [
    ("function_def", r"def\s+\w+\s*\([^)]*\)\s*:"),
    ("class_def", r"class\s+\w+\s*(?:\([^)]*\))?\s*:"),
    ("method_call", r"\w+\.\w+\s*\("),
    ("list_comp", r"\[.*for.*in.*\]"),
    ("dict_comp", r"\{.*for.*in.*\}"),
    ("lambda", r"lambda\s+.*:"),
    ("decorator", r"@\w+"),
    ("import", r"(?:from\s+\w+\s+)?import\s+\w+"),
    ("return", r"return\s+.+"),
    ("yield", r"yield\s+.+"),
    ("except", r"except\s+\w+"),
    ("with", r"with\s+.+:"),
]

# fixed values: completion types and their codes
COMPLETION_CODES = {"expression": 0.1, "statement": 0.2, "function_body": 0.5, "function_definition": 0.6,
                    "class_body": 0.7, "class_definition": 0.8, "docstring": 0.3, "comment": 0.2, "import": 0.4,
                    "unknown": 0.0}
NESTING_KEYWORDS = ["if", "for", "while", "with", "try", "def", "class"]
NESTING_CLOSERS = ["else:", "elif ", "except:", "finally:"]


def completion_type(prompt: Column | str) -> Column:
    p = col(prompt)
    low = F.lower(p)
    st = pystrip(p)
    return (F.when(p.rlike(java_regex(r"def\s+\w+\s*\([^)]*\)\s*:\s*$")), "function_body")
            .when(F.contains(p, F.lit("def ")) & F.endswith(st, F.lit(":")), "function_definition")
            .when(p.rlike(java_regex(r"class\s+\w+.*:\s*$")), "class_body")
            .when(F.contains(p, F.lit("class ")) & F.contains(p, F.lit(":")), "class_definition")
            .when(F.contains(p, F.lit('"""')) | F.contains(p, F.lit("'''")), "docstring")
            .when(F.startswith(st, F.lit("#")), "comment")
            .when(F.contains(low, F.lit("import")), "import")
            .when(F.contains(p, F.lit("=")) | F.contains(low, F.lit("return")), "statement")
            .otherwise("expression"))


def _code(name: Column) -> Column:
    m = F.create_map(*[x for k, v in COMPLETION_CODES.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, name)


def domain_sums(low: Column) -> list[Column]:
    """Weighted keyword sum of every domain over a lower-cased prompt."""
    return [sum((F.when(F.contains(low, F.lit(k)), F.lit(w)).otherwise(F.lit(0.0)) for k, w in kws.items()),
                F.lit(0.0)) for _, kws, _ in DOMAINS]


def domain_from_sums(sums: list[Column]) -> Column:
    """Highest sum, normalised by the winning domain's range; ties go to the
    domain listed first; no keyword -> 0."""
    cands = [F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
             for i, (s, (_, _, (lo, hi))) in enumerate(zip(sums, DOMAINS))]
    best = F.greatest(*cands)
    norm = (best["s"] - best["lo"]) / (best["hi"] - best["lo"])
    return F.when(best["s"] <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(norm, F.lit(1.0))))


def domain_score(prompt: Column | str) -> Column:
    """Highest weighted domain score (substring matches), normalised by the
    winning domain's range; ties go to the domain listed first. (As one
    expression; ``with_prompt_features`` computes the sums as columns.)"""
    return domain_from_sums(domain_sums(F.lower(col(prompt))))


def detected_domains(prompt: Column | str) -> Column:
    low = F.lower(col(prompt))
    return F.filter(F.array(*[F.when(contains_any(low, list(kws)), F.lit(name)) for name, kws, _ in DOMAINS]),
                    lambda x: x.isNotNull())


def nesting_level(prompt: Column | str) -> Column:
    """Sequential counter over lines: +1 for a line opening with a nesting
    keyword (followed by space or colon), -1 (not below 0) for else / elif /
    except / finally; the maximum reached, divided by 5, capped at 1."""
    def step(acc, l):
        s = F.lower(pystrip(l))
        opens = F.exists(F.array(*[F.lit(k) for k in NESTING_KEYWORDS]),
                         lambda k: F.startswith(s, F.concat(k, F.lit(" "))) | F.startswith(s, F.concat(k, F.lit(":"))))
        cur = acc["cur"] + F.when(opens, 1).otherwise(0)
        mx = F.greatest(acc["mx"], cur)
        closes = F.exists(F.array(*[F.lit(k) for k in NESTING_CLOSERS]), lambda k: F.startswith(s, k))
        cur2 = F.when(closes, F.greatest(cur - 1, F.lit(0))).otherwise(cur)
        return F.struct(cur2.alias("cur"), mx.alias("mx"))
    agg = F.aggregate(lines(prompt), F.struct(F.lit(0).alias("cur"), F.lit(0).alias("mx")), step)
    return F.least(agg["mx"] / 5.0, F.lit(1.0))


def indentation_level(prompt: Column | str) -> Column:
    nb = F.filter(lines(prompt), lambda l: pystrip(l) != "")
    ind = F.array_max(F.transform(nb, lambda l: F.length(l) - F.length(pylstrip(l))))
    return F.coalesce(F.least(ind / 16.0, F.lit(1.0)), F.lit(0.0))


def _words(prompt: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(prompt)), F.lit(r"\b\w+\b"), 0)


def python_keywords(prompt: Column | str) -> Column:
    kws = F.array(*[F.lit(k) for k in PY_KEYWORDS])
    return F.array_distinct(F.filter(_words(prompt), lambda w: F.array_contains(kws, w)))


def code_patterns(prompt: Column | str) -> Column:
    p = col(prompt)
    return F.filter(F.array(*[F.when(p.rlike(java_regex(rx, True)), F.lit(name)) for name, rx in CODE_PATTERNS]),
                    lambda x: x.isNotNull())


def keyword_density(prompt: Column | str) -> Column:
    w = _words(prompt)
    kws = F.array(*[F.lit(k) for k in PY_KEYWORDS])
    n = F.size(w)
    k = F.size(F.filter(w, lambda x: F.array_contains(kws, x)))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(k / n * 10.0, F.lit(1.0)))


def variable_complexity(prompt: Column | str) -> Column:
    v = F.regexp_extract_all(col(prompt), F.lit(r"\b[a-z_][a-z0-9_]*\b"), 0)
    n = F.size(v)
    avg_len = F.aggregate(v, F.lit(0), lambda a, x: a + F.length(x)) / n / 20.0
    under = F.size(F.filter(v, lambda x: F.contains(x, F.lit("_")))) / n
    camel = F.size(F.filter(v, lambda x: x.rlike("[A-Z]"))) / n   # always 0: the pattern has no upper case
    desc = F.size(F.filter(v, lambda x: F.length(x) > 3)) / n
    c = avg_len * 0.3 + under * 0.2 + camel * 0.2 + desc * 0.3
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(c, F.lit(1.0)))


def model_preference(model: Column | str) -> Column:
    m = col(model)
    out = None
    for name, pref in MODEL_PREFERENCES:
        cond = m == name
        out = F.when(cond, F.lit(pref)) if out is None else out.when(cond, F.lit(pref))
    for name, pref in MODEL_PREFERENCES:
        out = out.when(F.contains(m, F.lit(name.split(":")[0])), F.lit(pref))
    return out.otherwise(F.lit(0.5))


def prompt_features(prompt: Column | str, model: Column | str, domain: Column | None = None) -> Column:
    """TX-15: struct of the eleven features; a blank prompt gives zeros
    (except the model preference)."""
    p = col(prompt)
    nest = nesting_level(p)
    n_kw = F.size(python_keywords(p))
    n_pat = F.size(code_patterns(p))
    complexity = F.least(F.least(F.length(p) / 1000.0, F.lit(1.0)) * 0.2
                         + F.least(F.size(lines(p)) / 50.0, F.lit(1.0)) * 0.2 + nest * 0.3
                         + F.least(n_kw / 10.0, F.lit(1.0)) * 0.15 + F.least(n_pat / 8.0, F.lit(1.0)) * 0.15,
                         F.lit(1.0))
    length = F.least(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.length(p) - 500) / 200.0)), F.lit(1.0))
    feats = {
        "prompt_complexity": complexity,
        "context_length": length,
        "completion_type": _code(completion_type(p)),
        "code_domain": domain if domain is not None else domain_score(p),
        "indentation_level": indentation_level(p),
        "nesting_level": nest,
        "has_function_def": F.when(p.rlike(java_regex(r"def\s+\w+\s*\([^)]*\)\s*:")), 1.0).otherwise(0.0),
        "has_class_def": F.when(p.rlike(java_regex(r"class\s+\w+\s*(?:\([^)]*\))?\s*:")), 1.0).otherwise(0.0),
        "keyword_density": keyword_density(p),
        "variable_complexity": variable_complexity(p),
    }
    blank = p.isNull() | (pystrip(p) == "")
    fields = [F.when(blank, F.lit(0.0)).otherwise(feats[n].cast("double")).alias(n) for n in FEATURE_NAMES[:-1]]
    fields.append(model_preference(model).alias("model_preference"))
    return F.struct(*fields)


def with_prompt_features(df, prompt: str, model: Column | str, out: str = "features"):
    """TX-15 as DataFrame steps: the lower-cased prompt and the eight domain
    sums become columns first, so every expression stays small enough for
    whole-stage codegen and is evaluated once per row."""
    d = df.withColumn("_low", F.lower(F.col(prompt)))
    names = [f"_dom{i}" for i in range(len(DOMAINS))]
    # the 123 keyword tests are written as SQL text and parsed once (cheap to plan)
    sums = []
    for _, kws, _ in DOMAINS:
        terms = " + ".join(f"CASE WHEN contains(_low, '{k}') THEN {w}D ELSE 0.0D END" for k, w in kws.items())
        sums.append(F.expr(f"(0.0D + {terms})"))
    d = d.select("*", *[s.alias(n) for s, n in zip(sums, names)])
    d = d.withColumn("_domain", domain_from_sums([F.col(n) for n in names]))
    d = d.withColumn(out, prompt_features(prompt, model, domain=F.col("_domain")))
    return d.drop("_low", "_domain", *names)


def feature_vector(features: Column) -> Column:
    """The eleven features as ``array<double>`` in the fixed order."""
    return F.array(*[features[n] for n in FEATURE_NAMES])


def prompt_profile(prompt: Column | str) -> Column:
    """TX-16: completion type, detected domains, code patterns, python
    keywords, and character / line / word / distinct-word counts."""
    p = col(prompt)
    words = F.filter(F.split(pystrip(p), r"\s+"), lambda w: w != "")
    return F.struct(
        completion_type(p).alias("completion_type"),
        detected_domains(p).alias("domains"), code_patterns(p).alias("patterns"),
        F.array_sort(python_keywords(p)).alias("keywords"),
        F.length(p).alias("chars"), F.size(lines(p)).alias("lines"), F.size(words).alias("words"),
        F.size(F.array_distinct(F.transform(words, lambda w: F.lower(w)))).alias("unique_words"))
