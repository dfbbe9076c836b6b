"""Catalog entries: text and prompt operators over the generations view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as FE
from ..functions import text as TX
from .catalog import query


@query("tx6_is_conversational")
def _tx6(v):
    g = v.generations
    return g.select("gen_id", *[TX.is_conversational("raw_text", k).alias(f"conv_{k}")
                                for k in ("full", "basic", "validation", "short")])


@query("tx7_prefix_clean")
def _tx7(v):
    g = v.generations
    return g.select("gen_id", TX.prefix_clean("raw_text", "old").alias("clean_old"),
                    TX.prefix_clean("raw_text", "new").alias("clean_new"))


@query("tx9_contains_expected")
def _tx9(v):
    g = v.generations
    exp = F.array(F.col("expected"), F.lower(F.col("problem_id")))
    return g.select("gen_id", TX.contains_expected("raw_text", exp, "nospace").alias("contains_nospace"),
                    TX.contains_expected("raw_text", exp, "plain").alias("contains_plain"))


@query("tx11_heuristic_pass")
def _tx11(v):
    return v.generations.select("gen_id", TX.heuristic_pass("raw_text").alias("heuristic_pass"))


@query("tx12_detect_language")
def _tx12(v):
    g = v.generations.select("gen_id", TX.detect_language("raw_text").alias("d"))
    return g.select("gen_id", F.col("d.language").alias("language"), F.col("d.confidence").alias("confidence"))


@query("tx13_prompt_language")
def _tx13(v):
    return v.generations.select("gen_id", TX.prompt_language("prompt").alias("prompt_language"))


@query("tx15_prompt_features")
def _tx15(v):
    g = v.generations
    model = F.concat(F.lit("phi3.5:"), F.col("model"))
    return FE.with_prompt_features(g.select("gen_id", "prompt", model.alias("m")), "prompt", "m", "f") \
        .select("gen_id", "f.*")


@query("tx16_prompt_profile")
def _tx16(v):
    p = v.generations.select("gen_id", FE.prompt_profile("prompt").alias("p"))
    return p.select("gen_id", F.col("p.completion_type").alias("completion_type"),
                    F.array_join("p.domains", ",").alias("domains"), F.array_join("p.patterns", ",").alias("patterns"),
                    F.array_join("p.keywords", ",").alias("keywords"), F.col("p.chars").alias("chars"),
                    F.col("p.lines").alias("lines"), F.col("p.words").alias("words"),
                    F.col("p.unique_words").alias("unique_words"))


@query("tx17_structure_checks")
def _tx17(v):
    return v.generations.select("gen_id", TX.structure_checks("raw_text").alias("c")).select("gen_id", "c.*")


@query("tx18_reasoning_score")
def _tx18(v):
    g = v.generations
    terms = F.array(F.col("expected"), F.lit("function"), F.lower(F.col("category")))
    return g.select("gen_id", TX.reasoning_score("raw_text", terms).alias("reasoning_score"))


@query("pj7_unsafe_filter")
def _pj7(v):
    g = v.generations
    name = F.concat(F.col("model"), F.lit("|"), F.col("problem_id"))
    return g.select("gen_id", TX.unsafe("prompt", "prompt").alias("unsafe_prompt"),
                    TX.unsafe("raw_text", "task").alias("unsafe_task"),
                    TX.unsafe(name, "model").alias("unsafe_model"))


@query("pj8_redact_dangerous_lines")
def _pj8(v):
    return v.generations.select("gen_id", TX.redact_dangerous_lines("raw_text").alias("redacted"))
