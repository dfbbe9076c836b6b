"""Operators the reference specifies in its documents (DX-*), over the
document, benchmark, label and conversation tables.

DX-1 (n-gram contamination) is the heavy one: the corpus side is tokenised per
row, its n-grams are probed against a Bloom filter of the items' n-grams before they
become rows, and only what may be a hit is joined and grouped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any
from .ranking import top_k_per_group
from .sequence import ROWS_PER_CHUNK, chunked

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column | str) -> Column:
    """Lower-cased word tokens (letters and digits of any script)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN), 0)


def ngrams(words: Column, n: int) -> Column:
    """Word n-grams joined by single spaces (empty when fewer than n words)."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1),
                        lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))


BLOOM_BITS = 16      # a key of the filter, about; two are probed: 1.4 % pass by chance
BLOOM_WORDS = 1 << 20  # of 64 bits, at most (8 MB): with more keys more pass by chance, none is lost


def bloom_words(keys: DataFrame, key: str) -> DataFrame:
    """One row ``_bits``: a Bloom filter over the long ``key``, as an array of 64-bit words
    (a power of two of them), built by an aggregate."""
    sized = keys.agg(F.count(F.lit(1)).alias("_n")).select(
        F.least(F.lit(BLOOM_WORDS), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("_n") * (BLOOM_BITS / 64), F.lit(2.0)))))).cast("long").alias("_size"))
    at = keys.crossJoin(F.broadcast(sized)).select(F.explode(F.array(*(_place(F.col(key), F.col("_size"), k) for k in (0, 1)))).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    # words without a key are zero
    every = sized.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("_size") - 1)).alias("w"))
    dense = every.join(words, "w", "left").select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("_bits"))


def _place(key: Column, words: Column, k: int) -> Column:
    """The ``k``-th bit of a key in a filter of ``words`` words."""
    return (F.shiftrightunsigned(key, 31 * k)).bitwiseAND(words * 64 - 1)


def might_hold(bits: Column, key: Column) -> Column:
    """Whether the filter ``bits`` may hold ``key``; False is certain."""
    size = F.size(bits).cast("long")

    def probe(k: int) -> Column:
        p = _place(key, size, k)
        return F.getbit(F.get(bits, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
    return probe(0) & probe(1)


def ngram_contamination(corpus: DataFrame, items: DataFrame, n: int = 8, doc_id: str = "doc_id",
                        item_id: str = "item_id", text: str = "text") -> DataFrame:
    """DX-1 (specified in the documents): for every (document, item) that
    share at least one word n-gram: shared distinct n-grams, the item's
    distinct n-grams and containment = shared / item n-grams.

    N-grams meet by their 64-bit ``xxhash64``, and a meeting counts only if a second,
    independent hash agrees too (128 bits in all). A Bloom filter over the items' hashes
    (at most 8 MB, broadcast) is probed inside a document's array of hashes, so an
    n-gram becomes a row, and is hashed a second time, only if it may be an item's.
    """
    # tokens and hashes are columns first: a lambda over the expressions would run them for every n-gram
    def hashed(df: DataFrame, key: str) -> DataFrame:
        t = df.select(key, tokens(text).alias("_w")).filter(F.size("_w") >= n)
        return t.select(key, "_w", F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: F.xxhash64(F.slice("_w", i, n))).alias("_h"))

    def rows(df: DataFrame, key: str, places: Column, second: str) -> DataFrame:
        pair = lambda i: F.struct(F.get("_h", i).alias("h"), F.xxhash64(F.lit(n), F.slice("_w", i + 1, n)).alias(second))
        return df.select(key, F.inline(F.transform(places, pair)))

    every = F.sequence(F.lit(0), F.size("_h") - 1)
    it = rows(hashed(items, item_id), item_id, every, "_i").distinct()
    totals = it.groupBy(item_id).agg(F.count(F.lit(1)).alias("item_ngrams"))
    probed = hashed(corpus, doc_id).crossJoin(F.broadcast(bloom_words(it.select("h").distinct(), "h")))
    may = F.filter(every, lambda i: might_hold(F.col("_bits"), F.get("_h", i)))
    hits = (rows(probed, doc_id, may, "_d").join(it, "h").where("_d = _i")
            .groupBy(doc_id, item_id).agg(F.count_distinct("h", "_i").alias("shared_ngrams")))
    return (hits.join(totals, item_id)
            .withColumn("containment", F.col("shared_ngrams") / F.col("item_ngrams")))



def paraphrase_drop(samples: DataFrame, original: str = "direct", paraphrase: str = "instruction",
                    keys: Sequence[str] = ("model", "problem_id"), template: str = "template",
                    passed: str = "passed") -> DataFrame:
    """DX-2 (documents): accuracy on originals minus accuracy on paraphrases,
    over problems that have both (paired on model and problem)."""
    keys = list(keys)
    acc = lambda t: (samples.filter(F.col(template) == t).groupBy(*keys)
                     .agg(F.avg(F.col(passed).cast("double")).alias(f"_{t}")))
    j = acc(original).join(acc(paraphrase), keys)
    return j.groupBy(*keys[:-1]).agg(F.count(F.lit(1)).alias("pairs"),
                                     F.avg(f"_{original}").alias("original_accuracy"),
                                     F.avg(f"_{paraphrase}").alias("paraphrase_accuracy")) \
        .withColumn("accuracy_drop", F.col("original_accuracy") - F.col("paraphrase_accuracy"))


def prompt_sensitivity_report(samples: DataFrame, model: str = "model", problem: str = "problem_id",
                              template: str = "template", passed: str = "passed") -> DataFrame:
    """DX-5 (documents): per model best / mean / worst template success rate
    and the range; the most and least sensitive problem (largest / smallest
    spread of its per-template rates; ties -> smaller id)."""
    t = samples.groupBy(model, template).agg(F.avg(F.col(passed).cast("double")).alias("r"))
    per_model = t.groupBy(model).agg(F.max("r").alias("best_rate"), F.avg("r").alias("mean_rate"),
                                     F.min("r").alias("worst_rate"))
    per_model = per_model.withColumn("rate_range", F.col("best_rate") - F.col("worst_rate"))
    pr = (samples.groupBy(model, problem, template).agg(F.avg(F.col(passed).cast("double")).alias("r"))
          .groupBy(model, problem).agg((F.max("r") - F.min("r")).alias("spread")))
    most = pr.groupBy(model).agg(F.max_by(problem, F.struct(F.col("spread"), -F.col(problem))).alias("most_sensitive_problem"),
                                 F.min_by(problem, F.struct(F.col("spread"), F.col(problem))).alias("least_sensitive_problem"),
                                 F.max("spread").alias("max_spread"))
    return per_model.join(most, model)


def confusion_metrics(truth: Column, predicted: Column, df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """DX-6 (documents): TP/FP/TN/FN, precision, recall, specificity, F1 and
    MCC; a zero denominator gives NULL."""
    g = df.groupBy(*by).agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"),
                            F.count_if(~truth & ~predicted).alias("tn"), F.count_if(truth & ~predicted).alias("fn"))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    prec = F.try_divide(tp, tp + fp)
    rec = F.try_divide(tp, tp + fn)
    return g.select("*", prec.alias("precision"), rec.alias("recall"),
                    F.try_divide(tn, tn + fp).alias("specificity"),
                    F.try_divide(2 * prec * rec, prec + rec).alias("f1"),
                    F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"))


def top_k_accuracy(candidates: DataFrame, group: Sequence[str], order: Sequence[Column], expected: str,
                   ks: Sequence[int] = (1, 3, 5), by: Sequence[str] = ()) -> DataFrame:
    """DX-7 (documents): share of groups whose expected candidate is within
    the first k by ``order``, for each k. Top-k per group is exact."""
    group = list(group)
    kmax = max(ks)
    top = top_k_per_group(candidates, group, order, kmax)
    ranked = top.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    hit = ranked.groupBy(*group).agg(*[F.bool_or((F.col("_r") <= k) & F.col(expected)).alias(f"_h{k}") for k in ks])
    allg = candidates.select(*group).distinct()
    j = allg.join(hit, group, "left")
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("groups"),
                              *[F.avg(F.coalesce(F.col(f"_h{k}"), F.lit(False)).cast("double")).alias(f"top_{k}_accuracy")
                                for k in ks])


def organic_score(df: DataFrame, decision: Column, discovery: Column, selection: Column, execution: Column,
                  by: Sequence[str] = ()) -> DataFrame:
    """DX-8 (documents): 0.4 decision accuracy + 0.2 (discovery efficiency +
    selection accuracy + execution success), each a mean over the rows."""
    g = df.groupBy(*by).agg(F.avg(decision.cast("double")).alias("decision_accuracy"),
                            F.avg(discovery.cast("double")).alias("discovery_efficiency"),
                            F.avg(selection.cast("double")).alias("selection_accuracy"),
                            F.avg(execution.cast("double")).alias("execution_success"))
    return g.withColumn("organic_score", F.col("decision_accuracy") * 0.4 + F.col("discovery_efficiency") * 0.2
                        + F.col("selection_accuracy") * 0.2 + F.col("execution_success") * 0.2)


# fixed values: feedback phrases in the user's next turn
CORRECTION = ["actually, check", "can you actually", "no, i meant", "instead, use", "try using"]
SATISFACTION = ["thanks", "great", "perfect"]
FRUSTRATION = ["i already said", "i told you", "still not", "this doesn't"]


def feedback_signals(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                     text: str = "text", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """DX-9 (documents): for every assistant turn, the next user turn's
    signals -- correction, satisfaction, frustration (phrases, or the user
    repeating their previous message verbatim) -- and a missed opportunity
    (a correction, or the user supplying "here's the ...").

    The signals are read off a user turn before anything moves; a turn goes on with
    these and a SHA-256, no text. Inside a chunk of a conversation windows give the next
    and the previous user turn, the chunk's row carries them over its borders. A NULL
    conversation is a conversation.
    """
    said = F.col(role) == "user"
    low = F.lower(F.col(text))
    corr = contains_any(low, CORRECTION)
    signals = F.struct(corr.alias("user_corrected"), contains_any(low, SATISFACTION).alias("user_satisfied"), contains_any(low, FRUSTRATION).alias("frustrated"),
                       (corr | F.contains(low, F.lit("here's the"))).alias("missed_opportunity"))
    turns = conversations.select(conv, turn, F.col(role).alias("_role"), F.when(said, signals).alias("_signals"), F.when(said, F.coalesce(F.sha2(text, 256), F.lit(""))).alias("_h"))
    ch = chunked(turns.where(F.col("_role").isin("user", "assistant")), [conv], [turn], rows_per_chunk)
    prior, following = ch.window(Window.unboundedPreceding, -1), ch.window(1, Window.unboundedFollowing)
    local = ch.rows.withColumn("_prev", F.last("_h", ignorenulls=True).over(prior))
    # what an assistant turn has to know of the user turn: its signals, its digest and whether one came before it in the chunk
    heard = F.when(F.col("_h").isNotNull(), F.struct("_signals", "_h", "_prev"))
    local = local.withColumn("_next", F.first(heard, ignorenulls=True).over(following))
    ends = ch.totals(F.min_by(F.struct("_signals", "_h"), F.when(F.col("_h").isNotNull(), F.col(turn))).alias("_first"),
                     F.max_by("_h", F.when(F.col("_h").isNotNull(), F.col(turn))).alias("_last"))
    ends = ends.withColumn("_before", F.last("_last", ignorenulls=True).over(ch.chunks_before))
    after = F.struct("_first", "_before")
    ends = ends.select(*ch.part, "_before", F.first(F.when(F.col("_first._h").isNotNull(), after), ignorenulls=True).over(ch.chunks_after).alias("_after"))
    rows = ch.joined(local.where("_role = 'assistant'"), ends)
    here = F.col("_next").isNotNull()
    # the first user turn of a later chunk follows the last one before that chunk
    next_ = F.when(here, F.struct(F.col("_next._signals").alias("s"), F.col("_next._h").alias("h"), F.coalesce("_next._prev", "_before").alias("p"))) \
        .otherwise(F.struct(F.col("_after._first._signals").alias("s"), F.col("_after._first._h").alias("h"), F.col("_after._before").alias("p")))
    out = rows.withColumn("_n", next_).where("_n.h is not null")
    rep = F.coalesce((F.col("_n.h") != "") & (F.col("_n.h") == F.col("_n.p")), F.lit(False))
    return out.select(conv, F.col(turn).alias("assistant_turn"), F.col("_n.s.user_corrected").alias("user_corrected"), F.col("_n.s.user_satisfied").alias("user_satisfied"),
                      (F.col("_n.s.frustrated") | rep).alias("user_frustrated"), F.col("_n.s.missed_opportunity").alias("missed_opportunity"))
