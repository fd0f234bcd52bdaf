"""Helpers shared by the corpus operators: reliable checkpoints, batched token hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake.operators.checkpoints import reliable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Anything but a lower-case ASCII letter, a digit or a non-ASCII character separates alphanumeric words.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tokens handled at once by the vectorised helpers; bounds a task's memory whatever the input.
CHUNK_TOKENS = 1 << 19


#: Spark's setting by which an action's shuffle files go once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """While it lasts, each action's shuffle files go once it has ended; a Spark without that setting keeps them until
    they are collected. For plans that are made and run inside; what an action leaves must be saved or on the driver."""
    try:
        before = spark.conf.get(_CLEANUP)  # a default given here would hide Spark's own, and a session seldom sets it
    except Exception:  # no such setting
        yield
        return
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def saved(df: DataFrame) -> DataFrame:
    """df, cut from its lineage by a reliable checkpoint in the folder that spark.checkpoint.dir names.

    The shuffle files that led to it go once it is written, as a lost executor's part is read from the checkpoint.
    """
    with tidy(df.sparkSession):
        return reliable(df.select("*"))  # a plan takes the setting when it is made


def shards(spark: SparkSession) -> int:
    """How many ways exchanged keys are dealt; follows the session's shuffle setting, which is sized to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lower_ascii(text: Column) -> Column:
    """text with A-Z lower-cased and nothing else changed (F.lower would also fold É)."""
    return F.translate(text, UPPER, LOWER)


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once: the transform of one element binds it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


#: Elements that running() takes at a time.
_RUN = 256


def running(values: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """The array of op's running results over an array, each element's own included; op is associative, with this zero.

    An aggregate that appends copies its array at each step, so it is done in runs, and over the runs' totals.
    """

    def grow(xs: Column, of: Callable[[Column], Column]) -> Column:
        start = F.struct(zero.alias("at"), F.slice(F.array(zero), 1, 0).alias("out"))
        return F.aggregate(xs, start, lambda acc, x: F.struct(op(acc["at"], of(x)).alias("at"), F.concat(acc["out"], F.array(op(acc["at"], of(x)))).alias("out")))

    def joined(inside: Column) -> Column:
        bases = F.concat(F.array(zero), grow(inside, lambda x: x["at"])["out"])
        return F.flatten(F.zip_with(inside, F.slice(bases, F.lit(1), F.size(inside)), lambda c, b: F.transform(c["out"], lambda v: op(b, v))))

    def runs(xs: Column) -> Column:
        last = F.greatest(F.ceil(F.size(xs) / _RUN).cast("int") - 1, F.lit(0))
        return bound(F.transform(F.sequence(F.lit(0), last), lambda j: grow(F.slice(xs, j * _RUN + 1, F.lit(_RUN)), lambda x: x)), joined)

    return bound(values, runs)


def private(name: str) -> str:
    """A column name that cannot clash with the caller's."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered; emptied when large so that a worker's memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def hashes_of(words: list[bytes], seen: WordHashes) -> np.ndarray:
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def texts_of(column, rows: np.ndarray | None = None):
    """Texts of an Arrow column (of the given rows), a few at a time, so that one copy of them is not held whole."""
    import pyarrow as pa

    for i in range(0, len(column) if rows is None else len(rows), 256):
        yield from (column.slice(i, 256) if rows is None else column.take(pa.array(rows[i : i + 256]))).to_pylist()


def chunks(texts, lower: bool, split=bytes.split, most: int = CHUNK_TOKENS):
    """Yields (first row, lists of words by row) so that each yield has about `most` words, or a single longer row."""
    first, held, count = 0, [], 0
    for i, text in enumerate(texts):
        data = text.encode() if isinstance(text, str) else b""
        words = split(data.translate(TO_LOWER) if lower else data)
        held.append(words)
        count += len(words)
        if count >= most:
            yield first, held
            first, held, count = i + 1, [], 0
    if held:
        yield first, held


#: Odd multipliers for window hashes: fixed, so that every task hashes alike.
_ODD = np.random.RandomState(20240131).randint(1, 2**62, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift multiply), applied element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` word hashes; one entry per start."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        out += mixed(h[j : j + len(out)] + _ODD[j]) * _ODD[j + 1]
    return mixed(out)


_PACK = zstandard.ZstdCompressor(level=1)


def packed(x: np.ndarray) -> bytes:
    return _PACK.compress(np.ascontiguousarray(x).tobytes())


def unpacked(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)
