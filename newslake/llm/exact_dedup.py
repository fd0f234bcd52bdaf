"""Exact duplicates by two passes over a Bloom filter: only rows that may be repeated are shuffled.

The first pass writes a narrow row (id, SHA-256 of the normalised text, its 64-bit hash) for every document and sets a
hash's bits in a filter of two planes, "once" and "again"; tasks' planes are merged, a bit that two tasks set once being
set again. A repeated hash has all its bits set again, whatever task its rows are in. The second pass lets every row
with a bit that isn't so pass straight through as its own group; the others, the repeated ones and below 2.5 % of
the rest, are grouped by the whole SHA-256. Beyond `most_bits` the hashes are dealt into slices, each with a filter of its
own, so a task's memory and what is broadcast stay bounded and the filter is never overfull.

Of equal texts the row with the largest id stays. Null text counts as empty, so null and empty texts are one group. Null
ids are smaller than others; of rows that share the largest id exactly one stays, any. Texts are hashed whole. An empty
table gives no rows. Extra columns are not touched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import TO_LOWER, mixed, packed, private, saved, shards, texts_of, unpacked

#: Bits that a hash sets.
_PROBES = 4
#: log2 of a filter's least bits, and of its segments' number; segments are merged apart.
_LEAST, _SEGMENTS = 16, 8


@dataclass(frozen=True)
class Bloom:
    """bits_per_row: of the filter, before rounding up to a power of two; most_bits: log2 of a filter's greatest size (128
    MB), for some 130 million rows; more rows take more slices. hot_groups: at most so many groups are broadcast."""

    bits_per_row: int = 8
    most_bits: int = 30
    hot_groups: int = 4096


def sha_of(text: Column) -> Column:
    """SHA-256 (binary) of the text with A-Z lower-cased."""

    @F.arrow_udf("binary")
    def digest(texts: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256((t or "").encode().translate(TO_LOWER)).digest() for t in texts_of(texts)], pa.binary())

    return digest(text)


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """_PROBES different bit numbers of each hash, by double hashing with an odd step."""
    step = mixed(h) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(_PROBES)]).astype(np.int64)


def _set(plane: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(plane, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _are_set(plane: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (plane[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def planes(hashes: DataFrame, bits: int) -> DataFrame:
    """(segment, once, again): the merged planes of the hashes (one long column), by segment, packed."""
    size = bits // 8 >> _SEGMENTS

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at, n = np.unique(_positions(h, bits), return_counts=True)
            _set(again, at[(n > 1) | _are_set(once, at)])
            _set(once, at)
        used = np.flatnonzero(once.reshape(-1, size).any(1)).tolist()
        for s in used:
            part = slice(s * size, (s + 1) * size)
            yield pa.RecordBatch.from_pydict({"segment": [s], "once": [packed(once[part])], "again": [packed(again[part])]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for s, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                once, again = held.setdefault(s, (np.zeros(size, np.uint8), np.zeros(size, np.uint8)))
                new = unpacked(a, np.uint8)
                again |= unpacked(b, np.uint8) | (once & new)
                once |= new
        for s, (once, again) in held.items():
            yield pa.RecordBatch.from_pydict({"segment": [s], "once": [packed(once)], "again": [packed(again)]})

    kind = "segment long, once binary, again binary"
    ways = min(shards(hashes.sparkSession), 1 << _SEGMENTS)
    return hashes.mapInArrow(fill, kind).repartition(ways, "segment").mapInArrow(merge, kind)


def held(hashes: DataFrame, plane: str, bits: int):
    """A function of a hash column: whether all its bits are set in the plane. The plane is broadcast, bits / 8 bytes."""
    size, whole = bits // 8 >> _SEGMENTS, np.zeros(bits // 8, np.uint8)
    for r in planes(hashes, bits).select("segment", plane).toLocalIterator():
        whole[r["segment"] * size : (r["segment"] + 1) * size] = unpacked(r[plane], np.uint8)
    sent = hashes.sparkSession.sparkContext.broadcast(whole)

    @F.arrow_udf("boolean")
    def found(h: pa.Array) -> pa.Array:
        at = _positions(h.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits)
        return pa.array(_are_set(sent.value, at).all(0))

    return found


def _size(rows: int, rules: Bloom) -> tuple[int, int]:
    """(bits of a filter, slices)."""
    slices = max(1, -(-rows * rules.bits_per_row >> rules.most_bits))
    log = max(_LEAST, (-(-rows // slices) * rules.bits_per_row - 1).bit_length())
    return 1 << min(log, rules.most_bits), slices


def groups(docs: DataFrame, rules: Bloom = Bloom(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).alias("doc_id"), sha_of(F.col(text_col)).alias("sha"))
    rows = saved(rows.select("doc_id", "sha", F.xxhash64("sha").alias("h"), F.monotonically_increasing_id().alias("row")))
    total = rows.count()
    bits, slices = _size(total, rules)
    again, single = [], []
    for s in range(slices):
        part = rows.where(F.pmod(F.xxhash64("h"), F.lit(slices)) == s) if slices > 1 else rows
        maybe = held(part.select("h"), "again", bits)
        again.append(part.where(maybe("h")))
        single.append(part.where(~maybe("h")))
    suspects, singles = again[0], single[0]
    for a, b in zip(again[1:], single[1:], strict=True):
        suspects, singles = suspects.union(a), singles.union(b)
    suspects = saved(suspects.select("doc_id", "sha", "row"))
    # the greatest id's row; counted and chosen before the shuffle, so that a hot group is one row a task
    group = saved(suspects.groupBy("sha").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("best")))
    # groups above this share of the rows are at most so many, and are broadcast; the others are small enough for a task
    hot = group.where(F.col("n") > total // rules.hot_groups)
    cold = suspects.join(F.broadcast(hot.select("sha")), "sha", "left_anti").join(group, "sha")
    found = suspects.join(F.broadcast(hot), "sha").unionByName(cold)
    out = found.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), "sha")
    out = out.union(singles.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long"), F.lit(True), "sha"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, rules: Bloom = Bloom(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, columns unchanged. A filter of the repeated texts alone lets all
    other rows pass straight through, texts included; one that is overfull would let fewer pass, and be right."""
    repeated = groups(docs, rules, id_col, text_col).where("group_size > 1").select(F.xxhash64(F.unhex("text_sha256")).alias("h")).distinct()
    repeated = saved(repeated)
    maybe = held(repeated, "once", _size(2 * repeated.count(), rules)[0])
    sha, row = private("sha"), private("row")
    rows = docs.withColumn(sha, sha_of(F.col(text_col)))
    h = F.xxhash64(sha)
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(id_col)).alias(row)
    return rows.where(~maybe(h)).drop(sha).union(rows.where(maybe(h)).groupBy(sha).agg(best).select(f"{row}.*"))
