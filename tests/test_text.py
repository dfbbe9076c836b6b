"""Goldens for the text and prompt operators (G checks)."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalspark.functions import features as FE
from evalspark.functions import pyparse
from evalspark.functions import text as TX
from evalspark.operators import responses as RS

PY = """
def fibonacci(n):
    if n <= 1:
        return n
    return fibonacci(n-1) + fibonacci(n-2)

print(fibonacci(10))
"""
JS = """
function fibonacci(n) {
    if (n <= 1) {
        return n;
    }
    return fibonacci(n-1) + fibonacci(n-2);
}

console.log(fibonacci(10));
"""
JAVA = """
public class Fibonacci {
    public static int fibonacci(int n) {
        if (n <= 1) {
            return n;
        }
        return fibonacci(n-1) + fibonacci(n-2);
    }

    public static void main(String[] args) {
        System.out.println(fibonacci(10));
    }
}
"""
CPP = """
#include <iostream>
using namespace std;

int fibonacci(int n) {
    if (n <= 1) {
        return n;
    }
    return fibonacci(n-1) + fibonacci(n-2);
}

int main() {
    cout << fibonacci(10) << endl;
    return 0;
}
"""


def test_tx12_four_samples(spark):
    df = spark.createDataFrame([(c,) for c in (PY, JS, JAVA, CPP, "", "   ")], "code string")
    got = [r.d.language for r in df.select(TX.detect_language("code").alias("d")).collect()]
    # The Python sample scores (2 keywords + 0.5) / 13 = 0.19 < 0.2, so the rule itself calls it unknown.
    assert got == ["unknown", "javascript", "java", "cpp", "unknown", "unknown"]


def test_tx12_confidence_values(spark):
    df = spark.createDataFrame([(JS,), (CPP,)], "code string")
    conf = [r.d.confidence for r in df.select(TX.detect_language("code").alias("d")).collect()]
    assert conf[0] == pytest.approx((3 + 1.5) * 1.5 / 13)
    assert conf[1] == pytest.approx((4 + 1.5) * 1.5 / 16)


@pytest.mark.parametrize("prompt,domain,ctype", [
    ("def fibonacci(n):", 0.0, 0.5),
    ("class DataProcessor:", 0.0, 0.7),
    ("const add = (a, b) =>", 0.0, 0.2),
    ("SELECT * FROM users WHERE", 0.0, 0.1),
    ("import pandas as pd\nimport numpy as np\ndf = pd.DataFrame(data)", (2 + 2 + 1.5 + 1.0 - 1.5) / 5.5, 0.4),
])
def test_tx15_goldens(spark, prompt, domain, ctype):
    df = spark.createDataFrame([(prompt,)], "p string")
    f = df.select(FE.prompt_features("p", F.lit("phi3.5:latest")).alias("f")).first().f
    assert f.code_domain == pytest.approx(domain)
    assert f.completion_type == pytest.approx(ctype)
    assert f.model_preference == pytest.approx(0.8)


def test_tx15_blank_prompt_zeros(spark):
    df = spark.createDataFrame([("   ",)], "p string")
    f = df.select(FE.prompt_features("p", F.lit("mistral:7b-instruct")).alias("f")).first().f
    assert all(getattr(f, n) == 0.0 for n in FE.FEATURE_NAMES[:-1])
    assert f.model_preference == pytest.approx(0.6)


def test_tx15_nesting_counter(spark):
    p = "def f(x):\n    if x:\n        for i in x:\n            pass\n    else:\n        while True:\n            pass"
    df = spark.createDataFrame([(p,)], "p string")
    f = df.select(FE.prompt_features("p", F.lit("m")).alias("f")).first().f
    # def +1, if +2, for +3 (max 3), else -1 -> 2, while +3 -> max 3
    assert f.nesting_level == pytest.approx(3 / 5)
    assert f.has_function_def == 1.0


CASES = [
    ("To complete the function, here's the implementation:\n\ndef fibonacci(n):\n    if n <= 1:\n        return n\n"
     "    return fibonacci(n-1) + fibonacci(n-2)\n\nThis function calculates the fibonacci number recursively.", True),
    ('```python\ndef hello_world():\n    print("Hello, World!")\n    return "success"\n```\n\n'
     "Here's the explanation of the code above.", True),
    ("I'll help you complete this function. To solve this problem, you need to think about the algorithm. "
     "Let me explain the approach that would work best for this scenario.", False),
    ("# This function adds two numbers\ndef add(a, b):\n    # We simply return the sum\n    return a + b\n\n"
     "The function above is a simple addition function.", True),
    ("Certainly! Here's the code you need:\n\n    for i in range(len(arr)):\n        if arr[i] == target:\n"
     "            return i\n    return -1", True),
    ("   \n\n   \n  ", False),
]


GOLDEN = [  # clean text, removed, code kept, conversational removed, lines before and after, score, level
    ("def fibonacci(n):\n    if n <= 1:\n        return n\n    return fibonacci(n-1) + fibonacci(n-2)", 4, 4, 2, 8, 4, 1.0, "excellent"),
    ('def hello_world():\n    print("Hello, World!")\n    return "success"', 2, 3, 1, 7, 3, 1.0, "excellent"),
    ("", 1, 0, 1, 1, 0, 0.0, "empty"),
    ("# This function adds two numbers\ndef add(a, b):\n    # We simply return the sum\n    return a + b", 2, 4, 1, 6, 4, 1.0, "excellent"),
    ("    for i in range(len(arr)):\n        if arr[i] == target:\n            return i\n    return -1", 2, 4, 1, 6, 4, 1.0, "excellent"),
    ("", 0, 0, 0, 0, 0, 0.0, "empty"),
]


def test_tx1_tx3_goldens(spark):
    df = spark.createDataFrame([(i, raw, True) for i, (raw, _) in enumerate(CASES)], "gen_id int, raw_text string, http_success boolean")
    for r in RS.process_responses(df).collect():
        assert (r.clean_text, r.lines_removed, r.code_lines_preserved, r.conversational_lines_removed, r.original_line_count,
                r.final_line_count, r.quality_score, r.quality_level) == GOLDEN[r.gen_id]
        assert r.cleaning_applied == (r.gen_id < 5)


def test_tx1_fences_blanks_and_order(spark):
    raws = {
        "```\nx = 1\n\n```\n\nafter this\n\n": "x = 1\n\nafter this",       # the blank behind the fence and at the end go
        "\n\n```python\n\ny\n```\n```\nz\n```": "\ny\nz",                   # blank lines inside a fence stay
        "Sure, here it is\n\nx = 2\n\nplain words here": "x = 2\n\nplain words here",
        "```\nSure, inside": "Sure, inside",                                     # an open fence
    }
    df = spark.createDataFrame([(k, True) for k in raws], "raw_text string, http_success boolean")
    assert {r.raw_text: r.clean_text for r in RS.process_responses(df).collect()} == raws


def test_tx5_process_responses_job(spark):
    df = spark.createDataFrame([(i, raw, True) for i, (raw, _) in enumerate(CASES)],
                               "gen_id int, raw_text string, http_success boolean")
    rows = {r.gen_id: r for r in RS.process_responses(df, threshold="default").collect()}
    for i, (_, preserved) in enumerate(CASES):
        assert bool(rows[i].clean_text.strip()) == preserved
        assert rows[i].overall_success == (preserved and rows[i].quality_score >= 0.3)
    assert rows[5].quality_level == "empty" and rows[2].quality_level == "empty"
    assert rows[1].quality_level == "excellent"


def test_tx4_python_parses(spark, monkeypatch):
    texts = ["def f():\n    return 1", "return x + 1", "def (:", "   ", None]  # the second only as a function body
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.parses for r in RS.python_parses(df, "t").orderBy("i").collect()] == [True, True, False, False, False]
    # a failure of the compiler that is no syntax error says nothing against the text
    monkeypatch.setattr(pyparse, "compile_outcome", lambda source, mode: "other")
    assert pyparse.parsing_texts(pd.Series(["x"])).tolist() == [True]


def test_tx2_line_kinds(spark):
    df = spark.createDataFrame([(1, "```python\nx = 1\nSure, here it is\n\nplain words here")], "gen_id int, raw_text string")
    kinds = [r.kind for r in RS.line_kinds(df).orderBy("line_no").collect()]
    assert kinds[0] == "fence" and kinds[1] == "code" and kinds[2] == "conversational" and kinds[3] == "blank"


def test_tx14_extract_functions(spark):
    code = "def a(x):\n    return x\n\ndef b():\n\tpass\nprint(1)"
    df = spark.createDataFrame([(1, code)], "gen_id int, raw_text string")
    rows = sorted(RS.extract_functions(df).collect(), key=lambda r: r.line_start)
    assert [(r.name, r.line_start, r.line_end) for r in rows] == [("a", 0, 1), ("b", 3, 4)]
    assert rows[0].signature == "def a(x):"


def test_tx14_parser_first_pattern_after_a_syntax_error(spark):
    whole = ("def a(x: int, y=(1, 2), *rest, z=3, **more) -> int:\n    def inner(q=f()):\n        return q\n\n    return x\n"
             "class C:\n    def m(self,\n          w=None):\n        pass\n")
    broken = "def ok(a):\n    return a\n\ndef typed(x) -> int:\n    return x\nprint 1\n"
    df = spark.createDataFrame([(1, whole), (2, broken), (3, None), (4, "")], "gen_id int, raw_text string")
    got = {(r.gen_id, r.name): (r.signature, r.line_start, r.line_end) for r in RS.extract_functions(df).collect()}
    assert got == {(1, "a"): ("def a(x, y=(1, 2), *rest, **more):", 0, 4), (1, "inner"): ("def inner(q=...):", 1, 2),
                   (1, "m"): ("def m(self, w=None):", 6, 8), (2, "ok"): ("def ok(a):", 0, 2)}


def test_tx7_prefix_clean(spark):
    raw = "Here's the code:\n```python\ndef f():\n    return 1\n```\n# This explains it"
    df = spark.createDataFrame([(raw,)], "t string")
    r = df.select(TX.prefix_clean("t", "old").alias("o"), TX.prefix_clean("t", "new").alias("n")).first()
    assert r.o == "def f():\n    return 1"
    assert r.n == "def f():\n    return 1"


EXTRACT_CASES = [
    "Here is the code:\n```python\ndef add(a, b):\n    return a + b\n```\nDone.",
    "```python\ndef f(x):\n    if x == 1:\n        return 2",
    "```\ndef g():\n    return 3\n```",
    "Explanation first.\ndef h(n):\n    total = 0\n    for i in range(n):\n        total += i\n    return total\nprint(h(3))",
    "Steps:\n1. think\ndef k(a):\n    return a * 2\n\n    # trailing\nresult = k(2)",
    "no code at all",
    "def broken(:\n  retur",
    "",
]


EXTRACTED = [
    "def add(a, b):\n    return a + b", "def f(x):\n    if x == 1:\n        return 2", "def g():\n    return 3",
    "def h(n):\n    total = 0\n    for i in range(n):\n        total += i\n    return total\nprint(h(3))",
    "def k(a):\n    return a * 2\n\n    # trailing\nresult = k(2)", "no code at all", "def broken(:\n  retur", "",
]


def test_tx10_goldens(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EXTRACT_CASES)], "id int, raw_text string")
    assert [r.code for r in RS.extract_code(df).orderBy("id").collect()] == EXTRACTED
