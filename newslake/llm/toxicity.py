"""Toxicity by a classifier chain: linear models of the categories in order, each given the earlier ones' probabilities.

While training, an earlier category's probability of a row comes from a model that did not see the row's fold (out of
fold); while scoring, from the model of all folds. The last category is the one that is reported, so every earlier link
reaches it. Features are the presence of the words that tell some category apart best by chi-square over the sample.

The classifier is fitted on a bounded sample: of the labelled ids, those of least hash, at most `sample`, each with one
text (of equal ids, the one of least hash) and one label (of repeated ones, the least). Everything else covers all rows.
Null and empty texts have no words and get the chain's score for none. Very long texts are read whole. Repeated rows and
rows of equal or null ids are scored each for itself; null labels are left out of the sample, ties of words go by the
word. Without labels of both kinds a category's probability is its share, without any label 0.5 or less. An empty table
gives no rows. Extra columns are dropped, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import LOWER, UPPER, private, saved

_GAPS = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode())))


@dataclass(frozen=True)
class Chain:
    """categories: (name, condition on the labels) in the chain's order, the reported one last; known: condition on the
    labels of a row that is learnt from; sample: most labelled ids that are learnt from; words: features by category;
    folds; ridge: of the weights; threshold: of the last category."""

    categories: tuple[tuple[str, str], ...] = (("low_quality", "quality = 0"), ("toxic_low_quality", "toxic = 1 and quality = 0"), ("toxic", "toxic = 1"))
    known: str = "toxic is not null"
    sample: int = 20_000
    words: int = 100
    least_rows: int = 5
    folds: int = 5
    ridge: float = 1.0
    threshold: float = 0.5


def word_set(text: str | None) -> set[bytes]:
    return set((text or "").encode().translate(_GAPS).split())


def _telling_words(sample: DataFrame, names: list[str], rules: Chain) -> list[str]:
    """Of each category the words of the greatest chi-square against it; ties by word."""

    @F.pandas_udf("array<string>")
    def distinct(texts: pd.Series) -> pd.Series:
        return pd.Series([[w.decode(errors="replace") for w in word_set(t)] for t in texts])

    rows = sample.agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in names]).first()
    words = sample.select(F.explode(distinct.asNondeterministic()("text")).alias("word"), *names)
    words = words.groupBy("word").agg(F.count("*").alias("k"), *[F.sum(x).alias(x) for x in names]).where(F.col("k") >= rules.least_rows)

    def chi(name: str) -> Column:
        n, y = max(1.0, float(rows["n"])), float(rows[name] or 0)
        k, a = F.col("k").cast("double"), F.col(name).cast("double")
        expected = k * F.lit(y / n)
        return F.coalesce((a - expected) ** 2 / (expected * F.lit(max(1e-9, 1 - y / n)) * (F.lit(1.0) - k / F.lit(n) + F.lit(1e-9)) + F.lit(1e-9)), F.lit(0.0))

    words = saved(words)
    best = [words.orderBy(F.desc(chi(x)), "word").limit(rules.words).select("word").collect() for x in names]
    return sorted({r["word"] for rows in best for r in rows})


def logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights, intercept last, of a ridge logistic regression by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    share = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    w[-1] = np.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
            w = w + step
            if np.abs(step).max() < 1e-5:
                break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(x: np.ndarray, ys: np.ndarray, fold: np.ndarray, rules: Chain) -> list[np.ndarray]:
    """Weights by category; ys has a column for each."""
    models = []
    for c in range(ys.shape[1]):
        y = ys[:, c].astype(float)
        models.append(logistic(x, y, rules.ridge))
        out = np.zeros(len(x))
        for f in range(rules.folds):
            test = fold == f
            if test.any() and (~test).any():
                out[test] = probability(x[test], logistic(x[~test], y[~test], rules.ridge))
        x = np.c_[x, out]
    return models


def train(docs: DataFrame, labels: DataFrame, rules: Chain, id_col: str, text_col: str) -> tuple[list[str], list[np.ndarray]]:
    names = [private(f"y{i}") for i in range(len(rules.categories))]
    marks = [F.coalesce(F.expr(condition).cast("int"), F.lit(0)).alias(n) for (_, condition), n in zip(rules.categories, names, strict=True)]
    known = labels.where(rules.known).select(F.col(id_col).alias("id"), *marks).groupBy("id").agg(*[F.min(n).alias(n) for n in names])
    known = known.orderBy(F.xxhash64("id"), "id").limit(rules.sample)
    # at most rules.sample rows, so the broadcast is bounded
    sample = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known), "id")
    sample = sample.groupBy("id", *names).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = saved(sample)
    words = _telling_words(sample, names, rules)
    place = {w.encode(): i for i, w in enumerate(words)}

    @F.pandas_udf("array<int>")
    def present(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(place[w] for w in place.keys() & word_set(t)) for t in texts])

    rows = sample.select("id", present.asNondeterministic()("text").alias("at"), *names).orderBy("id").collect()
    x, ys = np.zeros((len(rows), len(words))), np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, r["at"]] = 1
        ys[i] = [r[n] for n in names]
    fold = np.arange(len(rows)) % rules.folds
    return words, fit_chain(x, ys, fold, rules)


def score(docs: DataFrame, words: list[str], models: list[np.ndarray], rules: Chain = Chain(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, p_<category> for each, toxic (the last one's probability at least the threshold)."""
    place, found = {w.encode(): i for i, w in enumerate(words)}, private("p")
    fields = [f"p_{name}" for name, _ in rules.categories]

    @F.pandas_udf(", ".join(f"{f} double" for f in fields))
    def chain(texts: pd.Series) -> pd.DataFrame:
        x = np.zeros((len(texts), len(place)))
        for i, t in enumerate(texts):
            x[i, [place[w] for w in place.keys() & word_set(t)]] = 1
        out = {}
        for f, w in zip(fields, models, strict=True):
            out[f] = probability(x, w)
            x = np.c_[x, out[f]]
        return pd.DataFrame(out)

    rows = docs.select(F.col(id_col).alias("doc_id"), chain.asNondeterministic()(F.col(text_col)).alias(found)).select("doc_id", f"{found}.*")
    return rows.withColumn("toxic", F.col(fields[-1]) >= rules.threshold)


def classify(docs: DataFrame, labels: DataFrame, rules: Chain = Chain(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score(docs, *train(docs, labels, rules, id_col, text_col), rules, id_col, text_col)
