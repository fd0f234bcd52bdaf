"""Importance resampling towards a target distribution of hashed n-grams.

Features of a text are its runs of 1 to `longest` words; each falls into a bucket by its CRC-32. A bucket's gain is the log
ratio of its share of the target's features to that of the documents', a document's weight the mean gain of its features.
A Gumbel variable of the id is added to the weight, and the documents with the greatest sums are drawn.

Two passes over the texts. Tasks join some texts' words in one buffer and intern its n-grams in an open-addressed table
(xxhash64 keys, verified bytes), so that a CRC is computed once for each different n-gram; the first pass adds the slots'
counts up by bucket, the second gathers gains by the occurrences' slots. The driver holds one number a bucket.
Ranks come from a range-partitioned sort of narrow rows, offset by the partitions before.

Null texts are empty; a text without words has no features and weight 0. A text longer than a batch is taken in several
pieces, the pairs across their borders included. Null ids are hashed as the empty text, and come after others of their
score; rows that repeat an id are drawn each for itself, in any order. An empty target has share 0 in every bucket; an
empty table gives no rows. Extra columns are not touched, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import private, saved, shards, texts_of
from newslake.llm.ngram_table import PADDING, Table

#: Lower-cases A-Z and makes every separator a space.
_PLAIN = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))

@dataclass(frozen=True)
class Resampling:
    """share: of the documents with least_words words, in hundredths; batch_bytes: of text in a table's buffer, about."""

    buckets: int = 10_000
    longest: int = 2
    share: int = 25
    least_words: int = 20
    seed: str = "7"
    batch_bytes: int = 1 << 21


def _pieces(texts, most: int) -> Iterator[tuple[int, bytes, bool]]:
    """(row, plain bytes, at most about `most`, whether the row's text ends there); pieces end between words."""
    for row, text in enumerate(texts):
        data = (text or "").encode().translate(_PLAIN)
        at = 0
        while len(data) - at > most:
            end = data.find(b" ", at + most)
            if end < 0:
                break
            yield row, data[at:end], False
            at = end
        yield row, data[at:] if at else data, True


def _buffers(texts, most: int) -> Iterator[list[tuple[int, bytes]]]:
    """Pieces together up to about `most` bytes. A text cut in two has no two pieces in one buffer."""
    some, size = [], 0
    for row, data, ends in _pieces(texts, most):
        some.append((row, data))
        size += len(data)
        if size >= most or not ends:
            yield some
            some, size = [], 0
    if some:
        yield some


class Words:
    """Words of some pieces in one buffer, a space after each; `before` are words carried from the first piece's text that
    only begin n-grams."""

    def __init__(self, pieces: list[tuple[int, bytes]], before: list[bytes]):
        head = b" ".join([*before, b""])
        raw = np.frombuffer(b" ".join([head + pieces[0][1], *[d for _, d in pieces[1:]], b""]), np.uint8)
        is_gap = raw == 32
        after_gap = np.r_[True, is_gap[:-1]]
        starts = np.flatnonzero(~is_gap & after_gap)
        self.size = np.flatnonzero(is_gap & ~after_gap) - starts
        self.start = np.cumsum(self.size + 1) - self.size - 1
        self.buffer = np.r_[raw[~(is_gap & after_gap)], np.zeros(PADDING, np.uint8)]
        ends = np.cumsum([len(head) + len(pieces[0][1]) + 1, *[len(d) + 1 for _, d in pieces[1:]]])
        #: place in `pieces` of each word
        self.piece = np.searchsorted(ends, starts, "right")
        self.carried = len(before)

    def runs(self, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, piece) of all runs of 1 to `longest` words of a piece that don't lie in the carried words alone."""
        n, out = len(self.start), []
        for k in range(1, longest + 1):
            a = np.arange(max(0, self.carried - k + 1), n - k + 1)
            a = a[self.piece[a] == self.piece[a + k - 1]] if len(a) else a
            out.append((self.start[a], self.start[a + k - 1] + self.size[a + k - 1] - self.start[a], self.piece[a]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def tail(self, most: int) -> list[bytes]:
        """The last words of the last piece, to be carried on."""
        last = len(self.start) - np.arange(min(most, len(self.start)), 0, -1)
        last = last[self.piece[last] == self.piece[-1]] if len(last) else last
        return [self.buffer[self.start[i] : self.start[i] + self.size[i]].tobytes() for i in last.tolist()]


def tables(texts, rules: Resampling) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Table]]:
    """(row of each occurrence, rows of the buffer, words of those rows, table) of each buffer of some texts."""
    before, open_row = [], -1
    for pieces in _buffers(texts, rules.batch_bytes):
        words = Words(pieces, before if pieces[0][0] == open_row else [])
        start, size, piece = words.runs(rules.longest)
        rows = np.array([r for r, _ in pieces])
        counts = np.bincount(words.piece[words.carried :], minlength=len(rows))
        yield rows[piece], rows, counts, Table(words.buffer, start, size, rules.buckets)
        open_row, before = pieces[-1][0], words.tail(rules.longest - 1)


def bucket_counts(docs: DataFrame, text_col: str, rules: Resampling) -> np.ndarray:
    """Features of all texts by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(rules.buckets, np.int64)
        for batch in batches:
            for *_, table in tables(texts_of(batch.column(0)), rules):
                total += table.by_bucket(rules.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": used, "n": total[used]})

    found = docs.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(rules.buckets, np.int64)
    for r in found.toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket, with one added to every bucket's count."""
    n, s, t = len(documents), int(documents.sum()), int(target.sum())
    pairs = zip(documents.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in pairs], np.int64)


def weighed(text: Column, by_bucket: np.ndarray, rules: Resampling) -> Column:
    """struct<n_words long, n_features long, weight long> of each text."""

    @F.arrow_udf("n_words long, n_features long, weight long")
    def weigh(texts: pa.Array) -> pa.Array:
        words, n, total = (np.zeros(len(texts), np.int64) for _ in range(3))
        for occurrence, rows, counts, table in tables(texts_of(texts), rules):
            np.add.at(words, rows, counts)
            # rows of a buffer ascend, so its sums are those between their borders
            here, base = occurrence - rows[0], rows[0]
            size = int(rows[-1] - base) + 1
            n[base : base + size] += np.bincount(here, minlength=size)
            np.add.at(total, occurrence, table.gathered(by_bucket))
        weight = np.floor_divide(total, np.maximum(n, 1))
        return pa.StructArray.from_arrays([pa.array(words), pa.array(n), pa.array(weight)], ["n_words", "n_features", "weight"])

    return weigh(text)


def gumbel(id_col: Column, seed: str) -> Column:
    """floor(-1000 * ln(-ln(u))), u of the first 32 bits of the SHA-256 of seed:id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with rank (1, 2, 3 ...): sorted in ranges; a range's first rank follows from the rows before it. order must
    tell rows apart, as equal ones are not split."""
    part, place = private("part"), private("place")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = rows.repartitionByRange(shards(rows.sparkSession), *order).sortWithinPartitions(*order)
    dealt = saved(dealt.withColumns({part: F.spark_partition_id(), place: inside}))
    sizes = {r[part]: r["count"] for r in dealt.groupBy(part).count().collect()}  # a number a partition
    firsts, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        firsts.append(total)
        total += sizes.get(p, 0)
    base = F.get(F.array(*map(F.lit, firsts or [0])), F.col(part))
    return dealt.withColumn("rank", (base + F.col(place) + 1).cast("long")).drop(part, place)


def resample(docs: DataFrame, target: DataFrame, rules: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_features, weight, score, rank (null where it isn't drawn)."""
    by_bucket = gains(bucket_counts(docs, text_col, rules), bucket_counts(target, target_text_col, rules))
    return _ranked(docs, by_bucket, rules, id_col, text_col)


def _ranked(docs: DataFrame, by_bucket: np.ndarray, rules: Resampling, id_col: str, text_col: str) -> DataFrame:
    cell, row = private("cell"), private("row")
    rows = docs.select(F.col(id_col).alias("doc_id"), weighed(F.col(text_col), by_bucket, rules).alias(cell)).select("doc_id", f"{cell}.*")
    rows = saved(rows.withColumns({"score": F.col("weight") + gumbel(F.col("doc_id"), rules.seed), row: F.monotonically_increasing_id()}))
    able = F.col("n_words") >= rules.least_words
    drawn = rows.where(able).count() * rules.share // 100
    out = ranked(rows.where(able), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc(row))
    out = out.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return out.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long"))).drop(row)


def drawn(docs: DataFrame, target: DataFrame, rules: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """The rows of docs that are drawn, columns unchanged: those not after the last drawn one by score and id, so texts are
    weighed again and not shuffled. Rows that share the last one's score and id are all drawn."""
    by_bucket = gains(bucket_counts(docs, text_col, rules), bucket_counts(target, target_text_col, rules))
    last = _ranked(docs, by_bucket, rules, id_col, text_col).where("rank is not null").orderBy(F.desc("rank")).limit(1).collect()
    if not last:
        return docs.limit(0)
    cell, score = private("cell"), private("score")
    rows = docs.withColumn(cell, weighed(F.col(text_col), by_bucket, rules)).withColumn(score, F.col(f"{cell}.weight") + gumbel(F.col(id_col), rules.seed))
    end, name = F.lit(last[0]["score"]), F.lit(last[0]["doc_id"])
    before = F.coalesce(F.col(id_col) <= name, name.isNull())
    rows = rows.where((F.col(f"{cell}.n_words") >= rules.least_words) & ((F.col(score) > end) | ((F.col(score) == end) & before)))
    return rows.drop(cell, score)


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
