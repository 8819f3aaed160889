"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade <= c) = logistic(theta_c - w.x): one weight vector for all thresholds
theta_1 < theta_2 < ...; the output is the expected severity sum_c P(grade > c).

Features are words and word beginnings of 4 to 6 letters (insults share stems
in languages that inflect), with value log(1 + count). The vocabulary is the
`n_features` features of the largest signed log-likelihood ratio with the
toxic label. Grades: 0 for documents
labelled clean; labelled toxic ones get 1, 2 or 3 by the tertile of the share of
their words that the vocabulary holds. The model, vocabulary and weights, is
fitted on at most `sample` labelled documents (those with the smallest hash of
their id), a bound on what is broadcast and gathered; every document is scored.

Defined results: null or empty text scores by the intercepts alone; a null id
gets a row with id null; repeated rows get equal rows. Labels with a null id or
null label are not used, the largest label of a repeated id holds. Without
both kinds of labels nothing can be learnt and every severity is 0.
"""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import CACHED, byte_batches, written

WORDS = re.compile(r"[^\W\d_]+").findall
FEATURES, SAMPLE, GRADES = 4096, 20_000, 4
#: A feature's least part in the log-likelihood ratio: weaker ones are noise at this many candidates.
LEAST = 6.0
#: Expected severity from which a document is rejected.
REJECT = 0.4


def word_features(word: str) -> list[str]:
    return [word] + ["^" + word[:i] for i in (4, 5, 6) if len(word) > i]


def _counted(batches):
    """(feature, label, documents) of a task, flushed before it holds many."""
    held = [Counter(), Counter()]

    def flush():
        for label, c in enumerate(held):
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array([label] * len(c), pa.int64()), pa.array(list(c.values()), pa.int64())], names=["feature", "label", "n"])
                c.clear()

    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            text = text.as_py()
            if text:
                held[label].update({f for w in set(WORDS(text.lower())) for f in word_features(w)})
            if len(held[0]) + len(held[1]) > 400_000:
                yield from flush()
    yield from flush()


class Scorer:
    """Feature counts of a text, by a cache of each word's features."""

    def __init__(self, vocabulary: dict[str, int], weights=None, theta=None):
        self.vocabulary, self.weights, self.theta, self.cache = vocabulary, weights, theta, {}

    def hits(self, text: str | None) -> tuple[dict[int, int], float]:
        """Counts of vocabulary features, and the share of words that have one."""
        counts, words, own = Counter(WORDS((text or "").lower())), 0, 0
        out: dict[int, int] = {}
        cache, vocabulary = self.cache, self.vocabulary
        for word, n in counts.items():
            ids = cache.get(word)
            if ids is None:
                if len(cache) >= CACHED:
                    cache.clear()
                ids = cache[word] = tuple(i for f in word_features(word) if (i := vocabulary.get(f)) is not None)
            words += n
            if ids:
                own += n
                for i in ids:
                    out[i] = out.get(i, 0) + n
        return out, own / words if words else 0.0

    def severity(self, text: str | None) -> float:
        found, _ = self.hits(text)
        z = sum(self.weights[i] * np.log1p(n) for i, n in found.items())
        return float((1 / (1 + np.exp(self.theta - z))).sum())


def fit_ordinal(at: np.ndarray, col: np.ndarray, val: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int, l2: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link model, by Adam on the mean log likelihood.

    The features' values are sparse: row at[i] has val[i] at col[i].
    """
    n, k = len(grades), n_grades - 1
    w, raw = np.zeros(n_features), np.concatenate([[1.0], np.zeros(k - 1)])
    moments = [np.zeros(n_features), np.zeros(n_features), np.zeros(k), np.zeros(k)]
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        theta = raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])
        z = np.bincount(at, val * w[col], n)
        cum = logistic(np.concatenate([np.full((n, 1), -np.inf), theta[None, :] - z[:, None], np.full((n, 1), np.inf)], axis=1))
        slope = cum * (1 - cum)
        rows_at = np.arange(n)
        p = np.maximum(cum[rows_at, grades + 1] - cum[rows_at, grades], 1e-12)
        dz = (slope[rows_at, grades + 1] - slope[rows_at, grades]) / p / n  # gradient of -log p by z
        dtheta = np.zeros(k)
        for c in range(k):
            dtheta[c] = -((slope[:, c + 1] / p)[grades == c].sum() - (slope[:, c + 1] / p)[grades == c + 1].sum()) / n
        draw = np.concatenate([[dtheta.sum()], np.exp(raw[1:]) * np.cumsum(dtheta[::-1])[::-1][1:]])
        dw = np.bincount(col, val * dz[at], n_features) + l2 * w
        for x, g, m, v in ((w, dw, moments[0], moments[1]), (raw, draw, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", n_features: int = FEATURES, sample: int = SAMPLE, n_grades: int = GRADES) -> Scorer | None:
    byte_batches(docs.sparkSession)
    gold = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("long")).alias("label"))
    chosen = gold.orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most `sample` pairs of ids and labels: a bounded broadcast, and no text is shuffled to find them
    have = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").dropDuplicates(["id"])
    have = written(have, "labelled")
    counts = have.select("text", "label").mapInArrow(_counted, "feature string, label long, n long")
    by = counts.groupBy("feature").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("good"))
    sizes = {r["label"]: r["n"] for r in have.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    bad, good = F.col("bad"), F.col("good")
    expected = (bad + good) * F.lit(sizes[1] / (sizes[0] + sizes[1]))
    ratio = (bad * F.log((bad + 0.01) / expected)).alias("ratio")
    top = by.where("bad >= 2").select("feature", ratio).orderBy(F.desc("ratio"), "feature").limit(n_features)
    vocabulary = {r["feature"]: i for i, r in enumerate(top.where(F.col("ratio") >= LEAST).collect())}
    scorer = Scorer(vocabulary)

    def encode(batches):
        for batch in batches:
            rows = [scorer.hits(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(c) for c, _ in rows], pa.list_(pa.int32())), pa.array([list(c.values()) for c, _ in rows], pa.list_(pa.int32())), pa.array([s for _, s in rows], pa.float64()), batch.column(1)],
                names=["features", "counts", "share", "label"],
            )

    got = have.select("text", "label").mapInArrow(encode, "features array<int>, counts array<int>, share double, label long").toArrow().combine_chunks()
    label, share, features = got["label"].to_numpy(), got["share"].to_numpy(), got["features"].combine_chunks()
    cuts = np.quantile(share[label == 1], np.arange(1, n_grades - 1) / (n_grades - 1))
    grades = np.where(label == 1, 1 + np.searchsorted(cuts, share), 0).astype(np.int64)
    at = np.repeat(np.arange(len(label)), features.value_lengths().to_numpy())
    col, val = features.flatten().to_numpy(), np.log1p(got["counts"].combine_chunks().flatten().to_numpy())
    scorer.weights, scorer.theta = fit_ordinal(at, col, val, grades, len(vocabulary), n_grades)
    scorer.cache = {}
    return scorer


def severity(docs: DataFrame, scorer: Scorer | None, text_col: str = "text", name: str = "severity") -> DataFrame:
    """docs and their expected severity, 0 to the number of grades less 1; a column of that name is replaced."""
    if scorer is None:
        return docs.withColumn(name, F.lit(0.0))
    byte_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(scorer.severity).astype("float64")

    return docs.withColumn(name, score(F.col(text_col)))
