"""Generated-response operators (TX-1..5, TX-8, TX-10, TX-14, TX-19, AG-16).

Lines are arrays of a response's column expressions: the fixed patterns are regex
tests, the state of a code fence is the parity of the fences before a line, and
what is kept or counted follows from flags per line. Python is asked only what its
parser alone can tell (``functions.pyparse``): whether a line that no pattern decided
compiles, whether a cleaned text parses, where the functions of a text are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as PT
from ..functions import pyparse
from ..functions import text as TX
from .keys import join_keys

PRESETS = {"default": 0.3, "strict": 0.6, "lenient": 0.1}


def _once(function, result: str):
    """A pandas UDF that the optimiser neither repeats nor moves into other expressions."""
    return F.pandas_udf(function, result).asNondeterministic()


def _any(line: Column, patterns: Sequence[str], flags: str = "") -> Column:
    """Whether one of the (anchored where need be) patterns is found in the line."""
    return line.rlike(TX.java_regex(flags + "|".join(f"(?:{p})" for p in patterns)))


def _looks_like_code(line: Column) -> Column:
    return _any(line, PT.CODE_INDICATORS, "(?i)")


def _conversational(line: Column) -> Column:
    return _any(F.lower(line), PT.CONVERSATIONAL_STARTERS)


# ----------------------------------------------------------------- TX-1 .. TX-5
def with_line_flags(df: DataFrame, raw: str) -> DataFrame:
    """Add ``_f``: one struct per line of the response (line, blank, fence, code,
    talk = conversational). The compile helper gets the distinct lines that no pattern
    decides, as one array a response."""
    text = F.coalesce(F.col(raw), F.lit(""))
    lines = df.withColumn("_f", F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("line"), TX.pystrip(x).alias("s"))))
    lines = lines.withColumn("_f", F.transform("_f", lambda x: F.struct(
        x["line"].alias("line"), x["s"].alias("s"), (x["s"] == "").alias("blank"), F.startswith(x["s"], F.lit("```")).alias("fence"),
        _looks_like_code(x["s"]).alias("hint"), _conversational(x["s"]).alias("talk"))))
    lines = lines.withColumn("_ask", F.array_distinct(F.transform(F.filter("_f", lambda x: ~x["blank"] & ~x["hint"]), lambda x: x["s"])))
    lines = lines.withColumn("_ok", _once(pyparse.compiling_lines, "array<string>")("_ask"))
    return lines.withColumn("_f", F.transform("_f", lambda x: F.struct(
        x["line"].alias("line"), x["blank"].alias("blank"), x["fence"].alias("fence"),
        (~x["blank"] & (x["hint"] | F.array_contains("_ok", x["s"]))).alias("code"), (~x["blank"] & x["talk"]).alias("talk")))).drop("_ask", "_ok")


def with_kept_lines(df: DataFrame) -> DataFrame:
    """TX-1 over ``_f``: ``_k`` are the lines that stay, ``_c`` the counts.

    Inside a fence (an odd number of fence lines before) every line stays. Outside,
    a line stays unless it is conversational and no code; a blank line goes right
    behind a fence and before the first line that stays. Blank lines at the end go.
    """
    def at(i: Column) -> Column:
        return F.get("_f", i)

    d = df.withColumn("_fences", F.filter(F.transform("_f", lambda x, i: F.when(x["fence"], i)), lambda i: i.isNotNull()))
    d = d.withColumn("_g", F.transform("_f", lambda x, i: F.struct(
        x["line"].alias("line"), x["blank"].alias("blank"), x["fence"].alias("fence"), x["code"].alias("code"), x["talk"].alias("talk"),
        (F.size(F.filter("_fences", lambda k: k < i)) % 2 == 1).alias("inside"),
        F.coalesce(at(i - 1)["fence"], F.lit(False)).alias("behind"), i.alias("i"))))
    d = d.withColumn("_g", F.filter("_g", lambda x: ~x["fence"]))
    firm = F.filter("_g", lambda x: x["inside"] | (~x["blank"] & (x["code"] | ~x["talk"])))
    d = d.withColumn("_first", F.get(F.transform(firm, lambda x: x["i"]), F.lit(0)))
    d = d.withColumn("_kept", F.filter("_g", lambda x: x["inside"] | (~x["blank"] & (x["code"] | ~x["talk"])) | (x["blank"] & ~x["behind"] & (x["i"] > F.col("_first")))))
    d = d.withColumn("_last", F.coalesce(F.array_max(F.transform(F.filter(F.transform("_kept", lambda x, i: F.struct(i.alias("i"), x["blank"].alias("blank"))), lambda x: ~x["blank"]), lambda x: x["i"])), F.lit(-1)))
    d = d.withColumn("_k", F.slice("_kept", F.lit(1), F.col("_last") + 1))
    outside = lambda x: ~x["inside"]
    talk = F.size(F.filter("_g", lambda x: outside(x) & x["talk"] & ~x["code"]))
    counts = F.struct(
        (F.size("_g") - F.size("_k")).alias("lines_removed"),
        F.size(F.filter("_g", lambda x: x["inside"] | x["code"])).alias("code_lines_preserved"),
        talk.alias("conversational_lines_removed"), ((F.size("_fences") > 0) | (talk > 0)).alias("cleaning_applied"),
        F.size("_f").alias("original_line_count"), F.size("_k").alias("final_line_count"))
    return d.withColumn("_c", counts).drop("_fences", "_g", "_first", "_kept", "_last")


def process_responses(df: DataFrame, raw: str = "raw_text", http_success: str = "http_success",
                      threshold: float | str = 0.3) -> DataFrame:
    """TX-5: clean (TX-1), score (TX-3), syntax check (TX-4) every response
    and set the success flags: quality ok = score >= threshold and a non-blank
    cleaned text; overall = http success and quality ok. ``threshold`` may be
    a preset name (default 0.3, strict 0.6, lenient 0.1).

    The score is the share of code lines, 0.2 if there are any, up to 0.1 for
    length, less half the share of conversational lines, within [0, 1].
    """
    th = PRESETS[threshold] if isinstance(threshold, str) else float(threshold)
    empty = F.coalesce(TX.pystrip(raw) == "", F.lit(True))
    d = with_kept_lines(with_line_flags(df, raw))
    counts = ("lines_removed", "code_lines_preserved", "conversational_lines_removed", "cleaning_applied", "original_line_count", "final_line_count")
    nothing = lambda c: F.lit(False) if c == "cleaning_applied" else F.lit(0)
    d = d.withColumn("clean_text", F.when(empty, "").otherwise(F.array_join(F.transform("_k", lambda x: x["line"]), "\n")))
    d = d.withColumns({c: F.when(empty, nothing(c)).otherwise(F.col(f"_c.{c}")) for c in counts})
    live = lambda flag: F.when(empty, 0).otherwise(F.size(F.filter("_k", lambda x: ~x["blank"] & flag(x))))
    d = d.withColumns({"total_lines": live(lambda x: F.lit(True)), "code_lines": live(lambda x: x["code"]), "conversational_lines": live(lambda x: x["talk"])})
    n, long = F.col("total_lines"), F.length("clean_text")
    score = (F.col("code_lines") / n + F.when(F.col("code_lines") > 0, 0.2).otherwise(0.0)
             + F.when(long > 20, F.least(F.lit(0.1), long / 1000)).otherwise(0.0) - F.col("conversational_lines") / n * 0.5)
    d = d.withColumn("quality_score", F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(0.0))
    level = F.when(n == 0, "empty")
    for cut, name in PT.QUALITY_LEVELS:
        level = level.when(F.col("quality_score") >= cut, name)
    d = d.withColumn("quality_level", level.otherwise("empty")).withColumn("is_conversational", F.col("conversational_lines") > 0)
    d = d.withColumn("is_executable", _parses("clean_text"))
    d = d.withColumn("has_syntax_errors", ~F.col("is_executable") & (TX.pystrip("clean_text") != ""))
    out = d.select(*df.columns, "clean_text", *counts, "quality_score", "quality_level", "is_conversational", "is_executable",
                   "has_syntax_errors", "total_lines", "code_lines", "conversational_lines")
    ok = (F.col("quality_score") >= th) & (TX.pystrip("clean_text") != "")
    return (out.withColumn("content_quality_success", ok)
               .withColumn("overall_success", F.coalesce(F.col(http_success), F.lit(False)) & ok))


def response_success_rates(processed: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """TX-5 roll-up: per group, http / content / overall success rates and mean quality."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return processed.groupBy(*by).agg(F.count(F.lit(1)).alias("responses"), rate("http_success").alias("http_rate"),
                                      rate("content_quality_success").alias("content_rate"),
                                      rate("overall_success").alias("overall_rate"),
                                      F.avg("quality_score").alias("mean_quality"))


def line_kinds(df: DataFrame, key: str = "gen_id", raw: str = "raw_text") -> DataFrame:
    """TX-2: one row per line (key, line_no, line, kind): ``blank``, ``fence``, ``code``,
    ``conversational``, ``mixed`` or ``text``, the first that holds."""
    lines = with_line_flags(df.where(F.col(raw).isNotNull()).select(key, raw), raw).select(key, F.posexplode("_f").alias("line_no", "x"))
    kind = (F.when(F.col("x.blank"), "blank").when(F.col("x.fence"), "fence").when(F.col("x.code"), "code").when(F.col("x.talk"), "conversational")
            .when(_any(F.lower(TX.pystrip("x.line")), PT.MIXED_CONTENT), "mixed").otherwise("text"))
    return lines.select(key, "line_no", F.col("x.line").alias("line"), kind.alias("kind"))


def _parses(text: str) -> Column:
    return _once(pyparse.parsing_texts, "boolean")(F.col(text))


def python_parses(df: DataFrame, text: str, out: str = "parses") -> DataFrame:
    """TX-4 as a column: compiles as is or wrapped in a function (never executed)."""
    return df.withColumn(out, _parses(text))


# ----------------------------------------------------------------- TX-8
def compare_cleaners(df: DataFrame, raw: str = "raw_text", http_success: str = "http_success",
                     by: Sequence[str] = ("model",)) -> DataFrame:
    """TX-8: old prefix cleaner (TX-7 ``old``) against the smart processor
    (TX-5): per row old/new length and a verdict -- ``rescued`` (old empty,
    new not), ``improved`` (new longer), ``same`` (equal text) or
    ``different`` -- then counts per group, mean quality, success rate and
    extra characters kept."""
    p = process_responses(df.withColumn("_old", TX.prefix_clean(raw, "old")), raw, http_success)
    old_len, new_len = F.length("_old"), F.length("clean_text")
    verdict = (F.when((old_len == 0) & (new_len > 0), "rescued").when(F.col("_old") == F.col("clean_text"), "same")
               .when(new_len > old_len, "improved").otherwise("different"))
    rows = p.withColumn("old_length", old_len).withColumn("new_length", new_len).withColumn("verdict", verdict)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("responses"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("rescued", "improved", "same", "different")],
        F.avg("quality_score").alias("mean_quality"),
        F.avg(F.col("overall_success").cast("double")).alias("success_rate"),
        F.sum(F.col("new_length") - F.col("old_length")).alias("extra_characters"))


# ----------------------------------------------------------------- TX-10
def _acceptable(code: Column) -> Column:
    """Has ``def `` and ``return`` and more code marks than prose marks (on the stripped code)."""
    c = TX.pystrip(code)
    low = F.lower(c)
    code_marks = sum((F.contains(c, F.lit(m)).cast("int") for m in PT.CODE_MARKS), F.lit(0))
    text_marks = sum((F.contains(low, F.lit(m)).cast("int") for m in PT.TEXT_MARKS), F.lit(0))
    return (c != "") & F.contains(c, F.lit("def ")) & F.contains(c, F.lit("return")) & (code_marks > text_marks)


def extract_code(df: DataFrame, text: str = "raw_text", out: str = "code") -> DataFrame:
    """TX-10: code extracted from a mixed text/code response, in Spark.

    Candidates in order -- closed fences, open fences (a trailing fence
    removed), def-blocks (Java regex with the same look-ahead; ``\\z`` is
    Python's ``\\Z``), the indented block after the last ``def`` line that
    precedes the first top-level line -- and the first acceptable one wins;
    else the stripped text. The indented block is index arithmetic over the
    line array (no per-line state), with the lines materialised as a column
    so the lambdas do not re-split the text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    cands = []
    for p in PT.CLOSED_FENCES:
        jp = "(?s)" + p
        cands.append(F.when(t.rlike(jp), TX.pystrip(F.regexp_extract(t, jp, 1))))
    for p in PT.OPEN_FENCES:
        jp = "(?s)" + p
        c = TX.pystrip(F.regexp_extract(t, jp, 1))
        c = F.when(F.endswith(c, F.lit("```")), TX.pystrip(F.left(c, F.length(c) - 3))).otherwise(c)
        cands.append(F.when(t.rlike(jp), c))
    for p in PT.DEF_BLOCKS:
        jp = "(?s)" + p.replace(r"\Z", r"\z")
        cands.append(F.when(t.rlike(jp), TX.pystrip(F.regexp_extract(t, jp, 1))))
    # indented block over the lines without skip markers
    skip = lambda l: TX.contains_any(l, PT.SKIP_LINE_MARKS)
    d = df.withColumn("_ls", F.filter(F.split(t, "\n"), lambda l: ~skip(l)))
    n = F.size("_ls")
    idx = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    is_def = lambda i: F.startswith(TX.pystrip(F.get(F.col("_ls"), i - 1)), F.lit("def "))
    d = d.withColumn("_d0", F.array_min(F.filter(idx, lambda i: (i <= n) & is_def(i))))
    top = lambda i: ((TX.pystrip(F.get(F.col("_ls"), i - 1)) != "") & ~F.startswith(F.get(F.col("_ls"), i - 1), F.lit(" "))
                     & ~is_def(i))
    d = d.withColumn("_b", F.coalesce(F.array_min(F.filter(idx, lambda i: (i <= n) & (i > F.col("_d0")) & top(i))),
                                      n + 1))
    d = d.withColumn("_ds", F.array_max(F.filter(idx, lambda i: (i <= n) & (i < F.col("_b")) & is_def(i))))
    d = d.withColumn("_ind", F.length(F.get(F.col("_ls"), F.col("_ds") - 1)) - F.length(TX.pylstrip(F.get(F.col("_ls"), F.col("_ds") - 1))))
    keep = lambda i: ((TX.pystrip(F.get(F.col("_ls"), i - 1)) == "")
                      | F.startswith(F.get(F.col("_ls"), i - 1), F.repeat(F.lit(" "), F.col("_ind") + 4))
                      | (F.startswith(F.get(F.col("_ls"), i - 1), F.repeat(F.lit(" "), F.col("_ind")))
                         & (TX.pystrip(F.get(F.col("_ls"), i - 1)) != "")))
    body = F.transform(F.filter(F.sequence(F.col("_ds") + 1, F.greatest(F.col("_b") - 1, F.col("_ds") + 1)),
                                lambda i: (i < F.col("_b")) & keep(i)), lambda i: F.get(F.col("_ls"), i - 1))
    block = F.when(F.col("_ds").isNotNull(),
                   F.array_join(F.concat(F.array(F.get(F.col("_ls"), F.col("_ds") - 1)), body), "\n"))
    cands.append(block)
    result = None
    for c in cands:
        result = F.when(_acceptable(c), c) if result is None else result.when(_acceptable(c), c)
    result = result.otherwise(TX.pystrip(t))
    return d.withColumn(out, result).drop("_ls", "_d0", "_b", "_ds", "_ind")


# ----------------------------------------------------------------- TX-14 / AG-16
_DEF = r"^(\s*)def\s+(\w+)\s*\([^)]*\)\s*:"


def extract_functions(df: DataFrame, key: str = "gen_id", code: str = "raw_text") -> DataFrame:
    """TX-14: every function of a text with its name, signature, body and zero-based
    start and end line, as Python's parser has it; for a text with a syntax error
    every ``def`` line that the pattern finds, its body the lines behind it that are
    blank or indented deeper by 4 spaces or a tab. No shuffle."""
    d = df.select(key, F.split(F.col(code), "\n", -1).alias("_ls"), _once(pyparse.parsed_functions, pyparse.FUNCTIONS)(F.col(code)).alias("_p"))
    marks = F.filter(F.transform("_ls", lambda line, i: F.struct((i + 1).alias("i"), line.alias("line"))), lambda s: s["line"].rlike(TX.java_regex(_DEF)))
    none = F.array().cast("array<struct<i:int,line:string>>")
    d = d.withColumn("_m", F.when(F.col("_p.parsed"), none).otherwise(marks))
    parsed = F.transform("_p.functions", lambda f: F.struct(F.lit(None).cast("int").alias("i"), F.lit(None).cast("string").alias("line"), f.alias("f")))
    found = F.transform("_m", lambda m: F.struct(m["i"].alias("i"), m["line"].alias("line"), F.lit(None).cast("struct<name:string,signature:string,body:string,line_start:int,line_end:int>").alias("f")))
    x = d.select(key, "_ls", F.explode(F.concat(parsed, found)).alias("_d"))
    i, line, n = F.col("_d.i"), F.col("_d.line"), F.size("_ls")
    indent = F.regexp_extract(line, TX.java_regex(_DEF), 1)
    breaks = F.filter(F.sequence(i + 1, F.greatest(n, i + 1)),
                      lambda k: (k <= n) & (TX.pystrip(F.get("_ls", k - 1)) != "")
                      & ~F.startswith(F.get("_ls", k - 1), F.concat(indent, F.lit("    ")))
                      & ~F.startswith(F.get("_ls", k - 1), F.concat(indent, F.lit("\t"))))
    end = F.coalesce(F.array_min(breaks), n + 1) - 1   # last body line, 1-based
    own = {"name": F.regexp_extract(line, TX.java_regex(_DEF), 2), "signature": TX.pystrip(line),
           "body": F.array_join(F.slice("_ls", i, end - i + 1), "\n"), "line_start": i - 1, "line_end": end - 1}
    return x.select(key, *(F.when(i.isNull(), F.col(f"_d.f.{c}")).otherwise(e).alias(c) for c, e in own.items()))


def function_analysis(functions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AG-16: total functions, distinct names and signatures, mean body
    length, most common name (ties -> name)."""
    by = list(by)
    g = functions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_functions"), F.count_distinct("name").alias("unique_names"),
        F.count_distinct("signature").alias("unique_signatures"),
        F.avg(F.length("body")).alias("avg_function_length"))
    w = Window.partitionBy(*by).orderBy(F.desc("_n"), F.asc("name")) if by else \
        Window.orderBy(F.desc("_n"), F.asc("name"))
    common = (functions.groupBy(*by, "name").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_r", F.row_number().over(w)).filter("_r = 1")
              .select(*by, F.col("name").alias("most_common_name")))
    return join_keys(g, common, by) if by else g.crossJoin(common)


# ----------------------------------------------------------------- TX-19
def output_match(tests: DataFrame, problem: str = "problem_id", code: str = "code", stdout: str = "stdout",
                 expected: str = "expected_output", success: str = "success") -> DataFrame:
    """TX-19: a test passes iff the run succeeded and the trimmed output
    equals the trimmed expected output; per problem tests, passed, pass rate.
    When the code's language (TX-12) is unknown nothing passes."""
    lang = TX.detect_language(code)["language"]
    ok = (F.coalesce(F.col(success), F.lit(False)) & (TX.pystrip(stdout) == TX.pystrip(expected))
          & (lang != "unknown"))
    t = tests.withColumn("passed", F.coalesce(ok, F.lit(False)))
    return t.groupBy(problem).agg(F.count(F.lit(1)).alias("total_tests"), F.count_if("passed").alias("passed_tests"),
                                  (F.count_if("passed") / F.count(F.lit(1))).alias("pass_rate"))
