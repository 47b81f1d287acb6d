"""Toxicity by weak supervision: many voters, a generative label model over their votes, a linear classifier on its posteriors.

Voters are hand-kept lexicons and patterns, and words and word beginnings that stand out in texts labelled toxic. They fire or
abstain. The label model treats the given label as one more voter: expectation maximization estimates how often each
voter fires on either class, and correlations between voters (given the class) share the weight of voters that say the same
thing, such as a word and its beginning. The classifier, a logistic regression on the voters, learns the
posteriors; scores come from the text alone.

Bounds: voters are mined and the models fitted on at most ``SAMPLE_ROWS`` labelled training rows, taken in hash order, one text
of each doc_id (the one of the smallest hash); counts of
words are aggregated by Spark, and what comes to the driver is ``N_MINED`` features and one short vote list per sampled
row. Every document is scored, whole, in one narrow pass without a shuffle.

Rows whose crc32(doc_id as text) mod 3 is 1 are held out: their labels are never read. Null and empty texts fire no
voter and get the intercept's score; a null doc_id is not held out and has no label; repeated rows are scored each
for itself; labels other than 0 and 1 are ignored and the larger one counts if a doc_id has several; without labels of both classes the hand-kept voters' default
weights score. Other columns are never read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.arrow import batch
from vigil.llm.worker import keep
from vigil.session import materialize

SAMPLE_ROWS = 12_000
N_MINED = 512
MIN_STATISTIC = 12.0  # likelihood ratio statistic of a mined feature, about one chance find in 2,000 features
MIN_PRECISION = 0.5  # share of toxic texts among those with a mined feature
LABEL_NOISE = 0.02
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
PRIOR = 0.1
MAX_LOG_ODDS = 6.0
MAX_CACHED = 300_000  # words whose voters a worker remembers

LEXICONS = {
    "insults_en": "idiot idiots moron morons imbecile stupid dumb loser losers pathetic worthless scum trash clown disgusting filthy vermin scumbag jerk",
    "profanity_en": "fuck fucking shit bitch bastard asshole crap damn",
    "insults_de": "idiot dummkopf trottel arschloch abschaum versager drecksau schwachkopf widerlich",
    "insults_fr": "idiot idiote imbécile connard connasse salaud ordure abruti minable débile",
    "insults_es": "idiota imbécil estúpido estúpida basura cabrón pendejo asqueroso inútil",
}
# name -> (literal that must be in the lower-cased text, pattern over it)
PATTERNS = {
    "you_are_a": ("you", r"\byou(?:'re| are) (?:an? |such an? |nothing but )"),
    "threat": ("you", r"\b(?:kill|hurt|shoot|hang) (?:you|yourself)\b"),
    "silencing": ("shut up", r"\bshut up\b"),
    "hate": ("hate", r"\bhate (?:you|them|these|those|all)\b"),
    "shouting": ("!!!", r"!!!"),
}
_PATTERNS = [(gate, re.compile(p)) for gate, p in PATTERNS.values()]
_WORD = re.compile(r"\w+")


def _features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


class Voters:
    """Voter numbers: lexicons, patterns, then mined features. Remembers which voters a word fires."""

    def __init__(self, mined: list[str]):
        self.names = [*LEXICONS, *PATTERNS, *mined]
        self.by_feature: dict[str, list[int]] = {}
        for k, words in enumerate(LEXICONS.values()):
            for w in words.split():
                self.by_feature.setdefault(w, []).append(k)
        for k, f in enumerate(mined):
            self.by_feature.setdefault(f, []).append(len(LEXICONS) + len(PATTERNS) + k)
        self.cache: dict[str, tuple[int, ...]] = {}

    def _of_word(self, word: str) -> tuple[int, ...]:
        if len(self.cache) > MAX_CACHED:
            self.cache.clear()
        got = self.cache[word] = tuple(sorted({v for f in _features(word) for v in self.by_feature.get(f, ())}))
        return got

    def fired(self, text: str) -> set[int]:
        low = text.lower()
        out: set[int] = set()
        cache = self.cache
        for w in set(_WORD.findall(low)):
            if got := (cache[w] if w in cache else self._of_word(w)):
                out.update(got)
        for k, (gate, pattern) in enumerate(_PATTERNS):
            if gate in low and pattern.search(low):
                out.add(len(LEXICONS) + k)
        return out


@dataclass
class ToxicityModel:
    mined: list[str]
    weights: list[float]
    intercept: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Posterior of class 1 for each row of a 0/1 vote matrix and its given labels.

    All voters vote for class 1 or abstain, so a firing never speaks against it; an abstention is no evidence, except that the
    silence of all is a vote for class 0. The given label is a voter whose error rate is ``LABEL_NOISE``; with the labels' share as the prior it
    keeps the classes from turning into something else that voters correlate with, such as the language.
    """
    x = np.column_stack([votes, votes.sum(1) == 0]).astype(np.float64)
    label_vote = np.where(given == 1, 1.0, -1.0) * np.log((1 - LABEL_NOISE) / LABEL_NOISE)
    prior = np.log(given.mean() / (1 - given.mean()))
    q = given * (1 - 2 * LABEL_NOISE) + LABEL_NOISE
    share = np.ones(x.shape[1])
    for step in range(rounds):
        on1, on0 = x.T @ q, x.T @ (1 - q)
        llr = np.log((on1 + 0.5) / (q.sum() + 1)) - np.log((on0 + 0.5) / ((1 - q).sum() + 1))
        llr = np.clip(llr, 0, MAX_LOG_ODDS)
        llr[-1] = min(0.0, np.log((on1[-1] + 0.5) / (q.sum() + 1)) - np.log((on0[-1] + 0.5) / ((1 - q).sum() + 1)))
        if step in (0, rounds // 2):
            # voters that fire together beyond what the class explains share their weight
            rho = np.zeros((x.shape[1], x.shape[1]))
            for w in (q, 1 - q):
                mean = x.T @ w / w.sum()
                cov = (x * w[:, None]).T @ x / w.sum() - np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                rho += np.clip(cov / np.outer(sd, sd), 0, 1) * w.mean()
            np.fill_diagonal(rho, 0)
            rho[rho < 0.2] = 0
            share = 1 + rho.sum(1)
        z = prior + label_vote + x @ (llr / share)
        q = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-4, 1 - 1e-4)
    return q


def fit_linear(x: np.ndarray, q: np.ndarray, penalty: float = 0.1, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method; the intercept is not penalized."""
    x1 = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    reg = np.append(np.full(x.shape[1], penalty), 1e-6)
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (p - q) + reg * w
        hess = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(reg)
        w = w - np.linalg.solve(hess, grad)
    return w[:-1], float(w[-1])


def _defaults() -> ToxicityModel:
    return ToxicityModel([], [4.0] * len(LEXICONS) + [1.0] * len(PATTERNS), float(np.log(PRIOR / (1 - PRIOR))))


def _mine(sample: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """The features with the largest likelihood ratio statistic among those more frequent in toxic texts."""

    def run(batches):
        schema = pa.schema([("feature", pa.string()), ("toxic", pa.int64())])
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                f = {x for w in set(_WORD.findall((text or "").lower())) for x in _features(w)}
                if f:
                    yield batch(schema, feature=list(f), toxic=[toxic] * len(f))

    counts = sample.mapInArrow(run, "feature string, toxic long").groupBy("feature") \
        .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).filter(F.col("a") >= MIN_PRECISION * (F.col("a") + F.col("b")))
    total = float(n_toxic + n_clean)

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n = F.col("a") + F.col("b")
    g = (term(F.col("a"), n * n_toxic / total) + term(F.col("b"), n * n_clean / total)
         + term(n_toxic - F.col("a"), (total - n) * n_toxic / total) + term(n_clean - F.col("b"), (total - n) * n_clean / total))
    best = counts.filter(F.col("a") * n_clean > F.col("b") * n_toxic).select("feature", g.alias("g")) \
        .filter(F.col("g") >= MIN_STATISTIC).orderBy(F.col("g").desc(), "feature").limit(N_MINED)
    return [r["feature"] for r in best.collect()]


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    train = labels.select(F.col("doc_id"), F.col("toxic").cast("long").alias("toxic")) \
        .filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    # at most SAMPLE_ROWS rows of two numbers
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(train), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"]  # partly aggregated where the rows are read
    sample = materialize(texts.groupBy("doc_id", "toxic").agg(one.alias("text")).select("doc_id", "text", "toxic"), "toxicity_sample")
    n_toxic, n = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    if not n_toxic or n_toxic == n:
        return _defaults()
    mined = _mine(sample, n_toxic, n - n_toxic)

    def run(batches):
        voters, schema = Voters(mined), pa.schema([("doc_id", pa.int64()), ("toxic", pa.int64()), ("fired", pa.list_(pa.int32()))])
        for b in batches:
            yield batch(schema, doc_id=b.column("doc_id"), toxic=b.column("toxic"), fired=[sorted(voters.fired(t or "")) for t in b.column("text").to_pylist()])

    rows = sample.mapInArrow(run, "doc_id long, toxic long, fired array<int>").orderBy("doc_id").collect()  # bounded by SAMPLE_ROWS, one row a doc_id
    votes = np.zeros((len(rows), len(LEXICONS) + len(PATTERNS) + len(mined)), np.float32)
    for k, r in enumerate(rows):
        votes[k, r["fired"]] = 1
    q = label_model(votes, np.array([r["toxic"] for r in rows]))
    weights, intercept = fit_linear(votes, q)
    return ToxicityModel(mined, weights.tolist(), intercept)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(row, score): the caller's row as a struct next to its score."""

    @F.arrow_udf("double")
    def score_text(text: pa.Array) -> pa.Array:
        voters = keep(("voters", *model.mined), lambda: Voters(model.mined))
        w = model.weights
        z = np.array([model.intercept + sum(w[v] for v in sorted(voters.fired(t))) for t in text.to_pylist()])
        return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       score_text(F.coalesce(F.col("text"), F.lit(""))).alias("score"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document."""
    s = score(docs.select("doc_id", "text"), fit(docs, labels))
    return s.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with the same columns."""
    return score(docs, fit(docs, labels)).filter(F.col("score") < threshold).select("row.*")
