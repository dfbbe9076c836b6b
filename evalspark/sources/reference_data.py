"""Reference data: small, fixed lookup tables (configuration of the runs).

They are joined to the data tables with a broadcast hint; their size is
fixed by the configuration (tens of rows), never by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: task name -> programming language
TASK_LANGUAGE = {
    "humaneval": "python",
    "multiple-js": "javascript",
    "multiple-java": "java",
    "multiple-cpp": "cpp",
    "multiple-go": "go",
    "multiple-rs": "rust",
    "multiple-ts": "typescript",
}

# fixed values: model-type keyword rules, in order (first match wins)
MODEL_TYPE_RULES = {
    "statistical": [
        ("instruct", ["instruct", "chat", "assistant"]),
        ("code", ["code", "codegen", "starcoder", "codellama"]),
        ("chat", ["gpt-3.5", "gpt-4", "claude"]),
        ("base", ["gpt-3", "codeparrot", "base"]),
    ],
    "real": [
        ("code", ["code", "coder", "codellama"]),
        ("chat", ["chat", "instruct", "assistant"]),
    ],
    "harness": [
        ("bigcode", ["codeparrot", "starcoder", "santacoder", "incoder", "codegen", "code-", "coder"]),
        ("general", ["gpt", "claude", "llama", "mistral", "phi", "qwen"]),
    ],
}

# fixed values: task -> harness (unknown tasks fall back to bigcode)
HARNESS_MAP = {
    "livecodebench_v6": "livecodebench", "livecodebench_v6_full": "livecodebench",
    "livecodebench_recent": "livecodebench", "bigcodebench": "bigcodebench",
    "bigcodebench_full": "bigcodebench", "bigcodebench_sample": "bigcodebench",
    "swebench_live_latest": "swebench_live", "swebench_live_month": "swebench_live",
    "humaneval": "bigcode", "mbpp": "bigcode", "apps": "bigcode", "ds1000": "bigcode",
    "humanevalpack": "bigcode", "multiple-py": "bigcode", "multiple-js": "bigcode",
    "multiple-java": "bigcode",
    "hellaswag": "lm_eval", "arc_easy": "lm_eval", "arc_challenge": "lm_eval",
    "winogrande": "lm_eval", "mathqa": "lm_eval", "gsm8k": "lm_eval", "truthfulqa": "lm_eval",
    "mmlu": "lm_eval", "piqa": "lm_eval", "openbookqa": "lm_eval",
}
VALID_HARNESSES = ["bigcode", "lm_eval", "livecodebench", "bigcodebench", "swebench_live", "failed"]

# fixed values: configured models (table, name, type, model id)
MODEL_CONFIGS = [
    ("ollama", "phi3", "general", "phi3:latest"),
    ("ollama", "qwen-coder", "code", "qwen2.5-coder:3b"),
    ("local", "codeparrot-small", "code", "codeparrot/codeparrot-small"),
    ("local", "starcoder", "code", "bigcode/starcoder"),
    ("api", "gpt-4", "general", "gpt-4"),
]

# fixed values: suites (tasks in order; limit, n_samples, temperature)
SUITES = {
    "quick": (["humaneval", "hellaswag"], 10, 1, 0.2),
    "standard": (["humaneval", "mbpp", "hellaswag", "arc_easy", "winogrande"], 50, 5, 0.2),
    "comprehensive": (["humaneval", "mbpp", "apps", "ds1000", "hellaswag", "arc_easy", "arc_challenge",
                       "winogrande", "mathqa", "gsm8k"], None, 10, 0.2),
    "research": (["humaneval", "mbpp", "hellaswag", "arc_challenge", "mathqa", "gsm8k"], None, 100, 0.2),
    "code_only": (["humaneval", "mbpp", "apps", "ds1000"], None, 20, 0.2),
    "language_only": (["hellaswag", "arc_easy", "arc_challenge", "winogrande", "mathqa", "gsm8k"], None, 10, 0.2),
    "contamination_resistant_quick": (["livecodebench_recent", "bigcodebench_sample"], 20, 1, 0.2),
    "contamination_resistant_standard": (["livecodebench_v6", "bigcodebench", "swebench_live_latest"], 50, 5, 0.2),
    "contamination_resistant_comprehensive": (["livecodebench_v6_full", "bigcodebench_full",
                                               "swebench_live_month"], None, 10, 0.2),
    "contamination_resistant_code_only": (["livecodebench_v6", "bigcodebench"], None, 10, 0.2),
    "swebench_live_evaluation": (["swebench_live_latest"], 50, 1, 0.2),
}

# fixed values: task categories (a task may be in several)
CATEGORIES = {
    "contamination_resistant_code": ["livecodebench_v6", "livecodebench_v6_full", "livecodebench_recent",
                                     "bigcodebench", "bigcodebench_full", "bigcodebench_sample",
                                     "swebench_live_latest", "swebench_live_month"],
    "legacy_contaminated_code": ["humaneval", "mbpp", "apps", "ds1000"],
    "language_understanding": ["hellaswag", "arc_easy", "arc_challenge", "winogrande"],
    "mathematical_reasoning": ["mathqa", "gsm8k"],
    "common_sense": ["hellaswag", "winogrande"],
}

# fixed values: task tags (contamination status, deprecated, replacement)
TASK_TAGS = {
    "livecodebench_v6": ("LOW", False, None), "livecodebench_v6_full": ("LOW", False, None),
    "livecodebench_recent": ("LOW", False, None), "bigcodebench": ("MODERATE", False, None),
    "bigcodebench_full": ("MODERATE", False, None), "bigcodebench_sample": ("MODERATE", False, None),
    "swebench_live_latest": ("LOW", False, None), "swebench_live_month": ("LOW", False, None),
    "humaneval": ("HIGH", True, "livecodebench_v6"), "mbpp": ("HIGH", True, "livecodebench_v6"),
}


def harness_map_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(HARNESS_MAP.items()), "task string, harness string")


def model_configs_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODEL_CONFIGS, "source string, model string, model_type string, model_id string")


def suites_df(spark: SparkSession) -> DataFrame:
    rows = [(k, v[0], v[1], v[2], v[3]) for k, v in SUITES.items()]
    return spark.createDataFrame(rows, "suite string, tasks array<string>, `limit` int, n_samples int, "
                                       "temperature double")


def categories_df(spark: SparkSession) -> DataFrame:
    rows = [(k, v) for k, v in CATEGORIES.items()]
    return spark.createDataFrame(rows, "category string, tasks array<string>")


def task_tags_df(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in TASK_TAGS.items()]
    return spark.createDataFrame(rows, "task string, contamination_status string, deprecated boolean, "
                                       "replacement string")
