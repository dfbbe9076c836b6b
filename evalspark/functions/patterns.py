"""Fixed patterns of the response operators (Python regex syntax)."""

# fixed values: line patterns (conversational starters, mixed content, code indicators)
CONVERSATIONAL_STARTERS = [
    r"^(here's|here is|certainly|sure|i'll|let me|you can|i can)",
    r"^(to complete|the function|this function|this code)",
    r"^(explanation|note that|as you can see|let's|we can)",
    r"^(i would|i will|we need to|you should|you need to)",
]
MIXED_CONTENT = [
    r"^(# explanation|# this|# here|# note)",
    r"(here's the|here is the).*(code|function|implementation)",
    r"(to solve this|to implement this|to complete this)",
]
CODE_INDICATORS = [
    r"^\s*(def |class |import |from |if |for |while |try |with )",
    r"^\s*[a-zA-Z_][a-zA-Z0-9_]*\s*=",
    r"^\s*return\s+",
    r"^\s*print\s*\(",
    r"^\s*[a-zA-Z_][a-zA-Z0-9_]*\s*\(",
    r"^\s*#[^#]",
]
QUALITY_LEVELS = [(0.8, "excellent"), (0.6, "good"), (0.4, "fair"), (0.1, "poor")]

# fixed values: code-block patterns tried in order (Python regex, DOTALL), acceptance markers
CLOSED_FENCES = [r"```python\n(.*?)\n```", r"```\n(.*?)\n```", r"```python(.*?)```", r"```(.*?)```"]
OPEN_FENCES = [r"```python\n(.*)", r"```\n(.*)"]
DEF_BLOCKS = [r"(def\s+\w+.*?(?=\ndef|\nclass|\Z))", r"(def\s+.*?return\s+[^;\n]+)"]
CODE_MARKS = ["def ", "    ", "return", "if ", "for ", "while ", "="]
TEXT_MARKS = ["to solve", "the function", "we need", "here is", "this will"]
SKIP_LINE_MARKS = ["**", "##", "1.", "2.", "3.", "4.", "-"]
