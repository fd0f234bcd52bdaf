"""Quality rules: zstandard compression bands over whole texts and fixed chunks, beside plain text counts.

Empty or null text has no words, so it fails the base rule. Ties, equal and null ids and repeated rows are judged row
by row; a ratio on a band's edge is inside the band. An empty table gives no rows. Very long texts are judged whole.
Extra columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import WordHashes, chunks, hashes_of, mixed, private, windows

METRICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean,"
    " ratio double, chunk_low double, chunk_high double, reason string"
)


@dataclass(frozen=True)
class Bands:
    """bands: (bytes from, least ratio, greatest ratio) by length of text; a text shorter than the first has no band.

    A chunk of chunk_bytes is out of band below chunk_least or above chunk_greatest; a text is rejected when more
    than chunk_share of its full chunks are out of band.
    """

    level: int = 3
    bands: tuple[tuple[int, float, float], ...] = (
        (128, 0.48, 1.05),
        (256, 0.46, 0.95),
        (512, 0.43, 0.88),
        (1024, 0.38, 0.82),
        (2048, 0.34, 0.78),
        (4096, 0.31, 0.75),
        (16384, 0.28, 0.72),
    )
    chunk_bytes: int = 2048
    chunk_least: float = 0.30
    chunk_greatest: float = 0.80
    chunk_share: float = 0.5
    least_words: int = 20
    most_repeat_percent: int = 30


_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_WIDTH = 8


def repeated_words(held: list[list[bytes]], seen: WordHashes) -> np.ndarray:
    """By row: words inside 8-word windows that occur twice or more in that row."""
    sizes = np.array([len(w) for w in held])
    words = [w for row in held for w in row]
    if len(words) < _WIDTH:
        return np.zeros(len(held), np.int64)
    row = np.repeat(np.arange(len(held)), sizes)
    key = windows(hashes_of(words, seen), _WIDTH)
    starts = np.flatnonzero(row[: len(key)] == row[_WIDTH - 1 :])
    key = mixed(key[starts] ^ mixed(row[starts].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(ranked) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    hit = starts[order[same[:-1] | same[1:]]]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + _WIDTH, -1)
    return np.bincount(row, weights=np.cumsum(cover)[:-1] > 0, minlength=len(held)).astype(np.int64)


def duplicate_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    lines = [x for x in lines if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def compression(data: bytes, rules: Bands, press: zstandard.ZstdCompressor) -> tuple[float, float, float, str]:
    """(whole ratio, least chunk ratio, greatest chunk ratio, reason or '')."""
    if not data:
        return 0.0, 0.0, 0.0, ""
    ratio = len(press.compress(data)) / len(data)
    size = rules.chunk_bytes
    parts = [len(press.compress(data[i : i + size])) / size for i in range(0, len(data) - size + 1, size)]
    reason = ""
    for start, least, greatest in reversed(rules.bands):
        if len(data) >= start:
            reason = "repetitive" if ratio < least else "incompressible" if ratio > greatest else ""
            break
    if not reason and parts:
        low, high = sum(p < rules.chunk_least for p in parts), sum(p > rules.chunk_greatest for p in parts)
        if low + high > rules.chunk_share * len(parts):
            reason = "repetitive chunks" if low >= high else "incompressible chunks"
    return ratio, min(parts, default=ratio), max(parts, default=ratio), reason


def measure(text: Column, rules: Bands = Bands()) -> Column:
    """A struct column of METRICS for each text."""

    @F.pandas_udf(METRICS)
    def metrics(texts: pd.Series) -> pd.DataFrame:
        seen, press, out = WordHashes(), zstandard.ZstdCompressor(level=rules.level), []
        texts = [t if isinstance(t, str) else "" for t in texts]
        for first, held in chunks(texts, lower=False):
            for i, (words, repeats) in enumerate(zip(held, repeated_words(held, seen), strict=True), first):
                t, n = texts[i], len(words)
                failed = n < rules.least_words or 100 * int(repeats) > rules.most_repeat_percent * n
                ratio, low, high, reason = compression(t.encode(), rules, press)
                reason = "base" if failed else reason
                out.append((n, len(t) - sum(map(t.count, _SPACES)), sum(map(t.count, _SYMBOLS)), duplicate_lines(t), int(repeats), failed, not reason, ratio, low, high, reason))
        return pd.DataFrame(out, columns=[x.split()[0] for x in METRICS.split(", ")])

    return metrics.asNondeterministic()(text)


def quality_rules(docs: DataFrame, rules: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and METRICS."""
    name = private("rules")
    return docs.select(F.col(id_col), measure(F.col(text_col), rules).alias(name)).select(id_col, f"{name}.*")


def keep_good(docs: DataFrame, rules: Bands = Bands(), text_col: str = "text") -> DataFrame:
    """docs without the rows that the rules reject; columns unchanged."""
    name = private("rules")
    return docs.withColumn(name, measure(F.col(text_col), rules)).where(F.col(f"{name}.kept")).drop(name)
