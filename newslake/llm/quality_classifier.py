"""Regularised quadratic discriminant over transformed document statistics.

Class means and covariances come from sums over all labelled training rows; a class covariance is shrunk towards the
pooled one and towards a multiple of the identity. The score is the logistic of the difference of log densities, got
from Mahalanobis distances with the Cholesky factors of both classes, which are cached in the task.

Null and empty texts have all statistics 0 and get a score like any other. Texts are measured whole. Rows that repeat
a doc_id are scored each for itself; a label counts once for each of its document's rows, and null labels count for
none. Without labels of both classes every score is 0.5. An empty table gives no rows, an empty label table scores of
0.5. Equal scores need no rule, as each row is judged by the threshold alone. Extra columns are not touched.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zlib
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import private, saved

FEATURES = (
    "words", "word_length", "distinct_words", "top_word", "equal_neighbours", "symbols", "bars", "marks", "upper", "digits", "stops", "short_words", "repeated_lines", "compression",
)


@dataclass(frozen=True)
class Discriminant:
    """shrink: weight of the pooled covariance; ridge: of the mean variance's multiple of the identity; flatten: divides
    the log density difference, which independent rows of few features overstate."""

    shrink: float = 0.2
    ridge: float = 0.02
    flatten: float = 2.0
    threshold: float = 0.7


def statistics(text: str) -> list[float]:
    """FEATURES of a text, transformed so that clean text is roughly normal in each."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    size = len(text)
    data = text.encode()
    lines = [x for x in text.split("\n") if x.strip()]
    log_share = lambda k, of: float(np.log((k + 0.5) / (of + 1)))
    upper = sum(map(str.isupper, text))
    return [
        float(np.log1p(n)),
        float(np.log(sum(map(len, words)) / n)),
        len(counts) / n ** 0.85,
        log_share(max(counts.values()), n),
        log_share(sum(map(str.__eq__, words, words[1:])), n),
        log_share(sum(map(text.count, "#*$%&<>@^~")), size),
        log_share(text.count("|"), size),
        log_share(text.count("!"), size),
        log_share(upper, size),
        log_share(sum(map(text.count, "0123456789")), size),
        log_share(sum(map(text.count, ".,;:?")), size),
        log_share(sum(len(w) <= 3 for w in words), n),
        log_share(len(lines) - len(set(lines)), len(lines)),
        float(np.log(len(zlib.compress(data, 1)) / len(data) * max(1.0, np.log(len(data)) / 4))),
    ]


def measured(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t if isinstance(t, str) else "") for t in texts])

    return features.asNondeterministic()(text)


def fit(labelled: DataFrame, x: str, label: str) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """label -> (rows, mean, covariance), from sums that Spark adds up; what reaches the driver has a fixed size."""
    k = len(FEATURES)
    sums = [F.sum(F.col(x)[i]).alias(f"s{i}") for i in range(k)]
    products = [F.sum(F.col(x)[i] * F.col(x)[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i + 1)]
    out = {}
    for r in labelled.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("n"), *sums, *products).collect():
        n, mean, cov = r["n"], np.array([r[f"s{i}"] for i in range(k)]) / r["n"], np.empty((k, k))
        for i in range(k):
            for j in range(i + 1):
                cov[i, j] = cov[j, i] = r[f"p{i}_{j}"] / n - mean[i] * mean[j]
        out[int(r[label])] = (n, mean, cov)
    return out


def factors(classes: dict[int, tuple[int, np.ndarray, np.ndarray]], rules: Discriminant) -> list[tuple[np.ndarray, np.ndarray, float]] | None:
    """(mean, inverse Cholesky factor, log determinant and prior) of classes 0 and 1, or None without both."""
    if set(classes) != {0, 1}:
        return None
    total = sum(c[0] for c in classes.values())
    pooled = sum(c[0] * c[2] for c in classes.values()) / total
    scale = np.sqrt(np.diag(pooled) + 1e-9)
    out = []
    for y in (0, 1):
        n, mean, cov = classes[y]
        mixed = ((1 - rules.shrink) * cov + rules.shrink * pooled) / np.outer(scale, scale)
        mixed = (1 - rules.ridge) * mixed + rules.ridge * np.trace(mixed) / len(mean) * np.eye(len(mean)) + 1e-9 * np.eye(len(mean))
        lower = np.linalg.cholesky(mixed)
        out.append((mean, np.linalg.inv(lower) / scale, float(2 * np.log(np.diag(lower)).sum() - 2 * np.log(n / total))))
    return out


def scored(x: Column, model: list | None, rules: Discriminant) -> Column:
    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        if model is None or not len(rows):
            return pd.Series(np.full(len(rows), 0.5))
        m = np.stack(rows.to_list())
        zero, one = (((m - mean) @ inverse.T) ** 2 @ np.ones(m.shape[1]) + log for mean, inverse, log in model)
        return pd.Series(1 / (1 + np.exp(np.clip((one - zero) / 2 / rules.flatten, -60, 60))))

    return score(x)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, rules: Discriminant = Discriminant(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted; learnt from labelled rows that held_out does not mark."""
    x = private("x")
    rows = saved(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), measured(F.col(text_col)).alias(x)))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label is not null")
    model = factors(fit(rows.where("not held_out").join(known, "doc_id"), x, "label"), rules)
    out = rows.select("doc_id", "held_out", scored(F.col(x), model, rules).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= rules.threshold).cast("int"))
