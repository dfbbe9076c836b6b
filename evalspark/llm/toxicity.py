"""Toxicity by weak supervision.

Voters fire on a text or abstain: fixed lexicons, patterns, and prefixes of words that
are mined from labelled rows. A generative label model explains how often voters fire,
alone and in pairs, over all rows: P(class), and of each voter P(fires | class); pairs
whose joint rate it cannot explain are correlated, are left out of its fit and count
less in its posterior. A linear classifier is trained on the posterior labels of a
sample and scores every text.

Fitted on a sample of at most ``FIT_DOCS`` labelled rows of either class (those with
the smallest hash of id), whole texts; class shares and the pair rates cover all rows.
Executors count the sample's features and turn its texts into indices; the driver gets
the features that tell the classes apart and, for each row, the numbers of those it has.
``MINED`` and ``FEATURES`` are the size of the model.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, prepared, stored

FIT_DOCS = 3000
MINED = 64          # mined voters, at most
FEATURES = 4000     # of the classifier, at most
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
PRIOR = 0.1         # share of toxic rows where no row is labelled
# Lexicons of abusive words, one voter each.
LEXICONS = {
    "mind": "idiot idiots idiotic stupid stupidity moron morons moronic dumb dumbass imbecile imbeciles cretin dimwit halfwit brainless fool fools dunce retard retarded",
    "worth": "worthless pathetic loser losers scum trash garbage filth vermin useless disgrace failure nobody parasite scumbag lowlife",
    "disgust": "disgusting revolting repulsive vile nasty sickening gross ugly hideous pig pigs swine rat cockroach",
    "mockery": "clown clowns joke laughable ridiculous crybaby coward cowards wimp weakling",
    "profanity": "damn crap shit bullshit fuck fucking fucker asshole bastard bitch dick piss slut whore cunt prick",
    "hatred": "hate hated hateful despise loathe kill murder die hang exterminate",
    "german": "idiot idioten dumm dummkopf trottel vollidiot abschaum versager arschloch scheisse wertlos ekelhaft",
    "french": "idiot idiote imbécile crétin connard salaud ordure minable dégoûtant stupide débile merde",
    "spanish": "idiota estúpido imbécil basura asqueroso inútil payaso patético mierda cabrón pendejo tonto",
}
# Patterns, one voter each.
PATTERNS = {
    "you_are": r"\byou(?:'re| are)\s+(?:an?\s+|so\s+|such\s+an?\s+)?(?:complete\s+|total\s+)?(?:idiot|stupid|moron|loser|pathetic|worthless|disgusting|clown|dumb)",
    "go_away": r"\b(?:shut up|get lost|go to hell|drop dead|kill yourself)\b",
}
_WORDS = re.compile(r"[^\W\d_]+").findall
_LEXICONS = {name: frozenset(words.split()) for name, words in LEXICONS.items()}
_PATTERNS = {name: re.compile(p, re.IGNORECASE) for name, p in PATTERNS.items()}
SILENT = "silent"  # fires where no other voter does
FIXED = [*LEXICONS, *PATTERNS, SILENT]


def word_set(text: str | None) -> set[str]:
    """The distinct lower-cased letter runs of a text."""
    return set(_WORDS(text.lower())) if text else set()


def features(words: set[str]) -> set[str]:
    """The words, and their prefixes (marked by a star) where they are longer."""
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def fixed_votes(text: str | None, words: set[str]) -> list[int]:
    """1 for every fixed voter that fires, in the order of ``FIXED`` (silence depends on the mined
    voters too and is set by :class:`Votes`)."""
    return [int(not words.isdisjoint(lex)) for lex in _LEXICONS.values()] + [int(bool(text) and p.search(text) is not None) for p in _PATTERNS.values()] + [0]


@dataclass
class LabelModel:
    """P(toxic), P(a voter fires | toxic), P(it fires | clean), and the weight that
    is left to each voter besides those it is correlated with."""

    share: float
    toxic: np.ndarray
    clean: np.ndarray
    weights: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes). A voter that does not fire abstains and says nothing: texts
        of one language never fire the lexicons of another. That no voter fires at
        all is the vote of the silent voter."""
        odds = np.log(self.share / (1 - self.share)) + votes @ (self.weights * np.log(self.toxic / self.clean))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_label_model(pairs: np.ndarray, share: float, toxic: np.ndarray, clean: np.ndarray, rounds: int = 50, correlated: float = 0.3) -> LabelModel:
    """Moment fit from ``pairs``, the rates at which voters i and j fire together (on
    the diagonal: alone) over all rows, and first values of the parameters.

    Under independence given the class, a rate is share * toxic_i * toxic_j +
    (1 - share) * clean_i * clean_j. The clean rates, near zero, stay as labelled rows
    have them; share and toxic rates are fitted in turns. The residual correlation of
    a pair is what that misses, in units of the voters' deviations; pairs beyond
    ``correlated`` drop out of the fit and share their say in the posterior."""
    a, b = np.clip(toxic, 1e-5, 0.999), np.clip(clean, 1e-6, 0.999)
    alone = np.diag(pairs)
    deviation = np.sqrt(np.clip(alone * (1 - alone), 1e-9, None))
    first, start = a.copy(), share
    for _ in range(rounds):
        rest = np.abs(pairs - share * np.outer(a, a) - (1 - share) * np.outer(b, b)) / np.outer(deviation, deviation)
        use = (rest <= correlated) & (a > b)[None, :]
        np.fill_diagonal(use, False)
        gap = np.where(a > b, a - b, 0.0)
        share = float(np.clip(((alone - b) @ gap) / max(gap @ gap, 1e-9), start / 3, min(start * 3, 0.9))) if gap.any() else share
        joint = ((pairs - (1 - share) * np.outer(b, b)) * use) @ a * share / np.maximum((use * (share * a) ** 2).sum(axis=1), 1e-12)
        single = (alone - (1 - share) * b) / share
        fitted = np.where(use.any(axis=1), (joint + single) / 2, single)
        a = np.clip(0.5 * a + 0.25 * fitted + 0.25 * first, 1e-5, 0.999)
    rest = np.abs(pairs - share * np.outer(a, a) - (1 - share) * np.outer(b, b)) / np.outer(deviation, deviation)
    np.fill_diagonal(rest, 0.0)
    weights = 1.0 / (1.0 + np.where(rest > correlated, np.minimum(rest, 1.0), 0.0).sum(axis=1))
    return LabelModel(share, a, b, weights)


@dataclass
class Model:
    """The classifier: log odds are ``bias`` plus the weights of a text's features."""

    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    fixed: list[float] = field(default_factory=lambda: [0.0] * len(FIXED))

    def score(self, text: str | None) -> float:
        words = word_set(text)
        odds = self.bias + sum(w for w, v in zip(self.fixed, fixed_votes(text, words)) if v)
        get = self.weights.get
        odds += sum(get(w, 0.0) for w in words & self._words)
        odds += sum(get(p, 0.0) for p in {w[:n] + "*" for w in words for n in self._sizes if len(w) > n and w[:n] in self._stems})
        return 1 / (1 + np.exp(-max(min(odds, 500.0), -500.0)))

    def ready(self) -> Model:
        self._words = {w for w in self.weights if not w.endswith("*")}
        self._stems = {w[:-1] for w in self.weights if w.endswith("*")}
        self._sizes = sorted({len(s) for s in self._stems})
        return self


def mine(counts: list[tuple[str, int, int]], clean: int, toxic: int) -> list[str]:
    """Features (name, clean rows, toxic rows) that occur in toxic rows and hardly in clean
    ones, the most frequent first."""
    if not clean or not toxic:
        return []
    rows = [(c1, w) for w, c0, c1 in counts if w.endswith("*") and c1 >= max(3, 0.02 * toxic) and c0 / clean <= 0.02 * c1 / toxic]
    rows.sort(key=lambda x: (-x[0], len(x[1]), x[1]))
    chosen: list[str] = []
    for _, w in rows:  # a longer prefix of one that is chosen says nothing new
        if not any(w.startswith(c[:-1]) for c in chosen):
            chosen.append(w)
    return chosen[:MINED]


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, clean, toxic): in how many rows of ``sample`` (toxic, text) of each class."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(), Counter()]
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[y].update(features(word_set(text)))
            names = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[w] for w in names], pa.int64()) for c in found)], ["feature", "clean", "toxic"])

    return sample.select("toxic", "text").mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def telling(counts: DataFrame, clean: int, toxic: int) -> list[str]:
    """The features whose presence differs most between the classes (chi square)."""
    n0, n1 = max(clean, 1), max(toxic, 1)
    share = (F.col("clean") + F.col("toxic")) / float(n0 + n1)
    gap = F.col("toxic") / float(n1) - F.col("clean") / float(n0)
    chi = gap * gap / F.greatest(share * (1 - share) * (1 / n0 + 1 / n1), F.lit(1e-12))
    rows = counts.where("clean + toxic >= 5").select("feature", chi.alias("chi")).where("chi > 15").orderBy(F.desc("chi"), "feature").limit(FEATURES)
    return [r["feature"] for r in rows.collect()]


def indexed(sample: DataFrame, mined: list[str], names: list[str]) -> list[tuple[int, list[int], list[int]]]:
    """(toxic, voters that fire, features of ``names`` that are there) of each row, sorted."""
    index = {w: i for i, w in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = Votes(mined)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            fired = [np.nonzero(vote(t))[0].tolist() for t in texts]
            have = [sorted(index[w] for w in features(word_set(t)) & index.keys()) for t in texts]
            kinds = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fired, kinds), pa.array(have, kinds)], ["toxic", "fired", "have"])

    rows = sample.select("toxic", "text").mapInArrow(run, "toxic int, fired array<int>, have array<int>").collect()  # of the sample
    return sorted((r["toxic"], r["fired"], r["have"]) for r in rows)


def train(rows: list[np.ndarray], dims: int, labels: np.ndarray, importance: np.ndarray, rounds: int = 500, ridge: float = 3e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels: (weights, bias). ``rows`` are the
    indices of each text's features."""
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    total = importance.sum()
    w, bias = np.zeros(dims), 0.0
    mean_w, mean_b, var_w, var_b = np.zeros(dims), 0.0, np.zeros(dims), 0.0
    for step in range(1, rounds + 1):  # Adam on the whole sample
        odds = np.bincount(owner, w[flat], len(rows)) + bias
        error = importance * (1 / (1 + np.exp(-np.clip(odds, -500, 500))) - labels) / total
        gw, gb = np.bincount(flat, error[owner], dims) + ridge * w, error.sum()
        mean_w, mean_b = 0.9 * mean_w + 0.1 * gw, 0.9 * mean_b + 0.1 * gb
        var_w, var_b = 0.999 * var_w + 0.001 * gw ** 2, 0.999 * var_b + 0.001 * gb ** 2
        fix = np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
        w -= 0.1 * fix * mean_w / (np.sqrt(var_w) + 1e-8)
        bias -= 0.1 * fix * mean_b / (np.sqrt(var_b) + 1e-8)
    return w, bias


def _pair_rates(docs: DataFrame, mined: list[str]) -> tuple[np.ndarray, int]:
    """How often voters fire together, over all rows of ``docs`` (text)."""
    n = len(FIXED) + len(mined)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together, rows = np.zeros((n, n), np.int64), 0
        vote = Votes(mined)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                fired = np.nonzero(vote(text))[0]
                together[np.ix_(fired, fired)] += 1
                rows += 1
        if rows:
            i, j = np.nonzero(together)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(together[i, j], rows))], ["i", "j", "n"])

    # a task gives one row a pair of voters; their number is a constant
    counted = docs.select("text").mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    pairs, rows = np.zeros((n, n)), 0
    for r in counted:
        if r["i"] < 0:
            rows = r["n"]
        else:
            pairs[r["i"], r["j"]] = r["n"]
    return pairs / max(rows, 1), rows


class Votes:
    """The votes of all voters on a text."""

    def __init__(self, mined: list[str]):
        self.index = {m[:-1]: len(FIXED) + i for i, m in enumerate(mined)}
        self.sizes = sorted({len(m) for m in self.index})
        self.n = len(FIXED) + len(mined)

    def __call__(self, text: str | None) -> np.ndarray:
        words = word_set(text)
        out = np.zeros(self.n)
        out[:len(FIXED)] = fixed_votes(text, words)
        for size in self.sizes:
            for stem in {w[:size] for w in words if len(w) > size} & self.index.keys():
                out[self.index[stem]] = 1
        out[len(FIXED) - 1] = not out.any()
        return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) where ``learn`` (of
    doc_id) holds. A row labelled more than once is toxic if any label says so; null
    labels and labels without a document are left out."""
    prepared(docs.sparkSession)
    rows = docs.where(learn).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = labels.where(learn).where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)")
    shares = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = hash_sample(marked.select("toxic", F.xxhash64("doc_id").alias("h"), "doc_id"), "toxic", "h", shares, FIT_DOCS).select("doc_id", "toxic")
    # at most 2 * FIT_DOCS rows of two numbers
    sample = stored(rows.join(F.broadcast(picked), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text")), "toxic-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    counts = stored(feature_counts(sample), "toxic-features")
    # each in a fiftieth of the toxic rows and hardly in clean ones
    frequent = counts.where((F.col("toxic") >= max(3, 0.02 * toxic)) & F.endswith("feature", F.lit("*")) & (F.col("clean") / max(clean, 1) <= 0.02 * F.col("toxic") / max(toxic, 1))).collect()
    mined = mine([tuple(r) for r in frequent], clean, toxic)
    names = telling(counts, clean, toxic)
    found = indexed(sample, mined, names)
    votes = np.zeros((len(found), len(FIXED) + len(mined)))
    for row, (_, fired, _) in zip(votes, found):
        row[fired] = 1
    gold = np.array([y for y, _, _ in found], np.int64)
    pairs, _ = _pair_rates(rows, mined)
    total = sum(shares.values())
    share = float(np.clip(shares.get(1, 0) / total, 0.005, 0.995)) if total and len(shares) == 2 else PRIOR

    def rates(k: int) -> np.ndarray:
        if (gold == k).any():
            return (votes[gold == k].sum(axis=0) + (0.5 if k else 0.1)) / ((gold == k).sum() + 1.0)
        unknown = np.full(votes.shape[1], 0.3 if k else 0.002)  # no labelled row: voters are taken at their word
        unknown[len(FIXED) - 1] = 0.05 if k else 0.95
        return unknown

    if not found:  # nothing to fit or train on: every voter has its first say
        yes = np.log(rates(1) / rates(0))
        silent = len(FIXED) - 1  # its part is what the others' silence leaves
        return Model(float(np.log(share / (1 - share)) + yes[silent]), {}, [*(yes[:silent] - yes[silent]), 0.0]).ready()
    labels_of = fit_label_model(pairs, share, rates(1), rates(0)).posterior(votes)
    importance = np.where(gold == 1, share / max((gold == 1).mean(), 1e-9), (1 - share) / max((gold == 0).mean(), 1e-9))
    sparse = [np.array([*(i for i in fired if i < len(FIXED) - 1), *(len(FIXED) + i for i in have)], np.int64) for _, fired, have in found]
    w, bias = train(sparse, len(FIXED) + len(names), labels_of, importance)
    return Model(float(bias), {n: float(x) for n, x in zip(names, w[len(FIXED):])}, w[:len(FIXED)].tolist()).ready()


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a last column score (0 to 1), in place of any of this name. Null and
    empty texts score what a text without any feature does."""
    docs = docs.drop("score")
    shipped = prepared(docs.sparkSession).sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shipped.value
            scores = [float(own.score(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
