"""Vector codes by product quantisation in exact integer arithmetic.

A component x becomes the integer floor(scale * x); a vector is cut into equal consecutive parts, each with a codebook of
its own, which Lloyd's rounds improve from the first entries. Squared distances come from dot products: the integers are
broken into limbs so small that a float64 matrix product of two limbs, sums included, stays below 2^53 and is exact; the
products are recombined by shifts in int64. The entry is the first least distance. Sums by entry are the same product,
of an indicator matrix. A batch whose integers could leave int64 is computed with Python's integers, to the same results.

Every round reads the vectors once and returns one row of counts and sums a task and entry, which Spark adds up; the driver
holds the codebooks alone.

Vectors that are null, or hold a null or non-finite component, are dropped. The first entries are those of the smallest
ids, nulls last, of equal ids those of the smallest vectors; with fewer vectors than entries the codebooks are smaller.
Rows that repeat are coded each for itself. The length of the vectors is that of the smallest id; a vector of another
length has code, error and label_error null, and counts for nothing. A length that the parts don't divide is an error. An
error beyond a long is null, and so is its label's. An empty table gives no rows. Extra columns are not touched, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import private, saved

#: Sums pass Spark in limbs of so many bits (the last one signed): 2^26 tasks' limbs add up in a long.
_SUM_BITS, _SUM_LIMBS = 36, 5
#: Codes a batch: bounds a task's distances.
_ROWS = 8192


@dataclass(frozen=True)
class Quantiser:
    """hot_labels: sums of at most so many labels are broadcast; more are joined by label."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: float = 4096.0
    hot_labels: int = 4096


def _greatest(x: np.ndarray) -> int:
    return int(abs(x).max()) if x.size else 0


def limbs_of(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 limbs of int64 x, lowest first: x = sum of limb << (bits * i); all but the last are in [0, 2^bits)."""
    out = []
    while _greatest(x) >= 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b (last axes, as numpy's matmul) of integers, exactly; int64, or Python integers where those could leave it."""
    inner = a.shape[-1]
    if object in (a.dtype, b.dtype) or _greatest(a) * _greatest(b) * max(inner, 1) >= 1 << 62:
        return np.matmul(a.astype(object), b.astype(object))
    bits = (53 - max(inner, 1).bit_length()) // 2  # inner * 2^(2 bits) < 2^53
    out = np.zeros(np.broadcast_shapes(a.shape[:-2], b.shape[:-2]) + (a.shape[-2], b.shape[-1]), np.int64)
    right = limbs_of(b, bits)
    for i, x in enumerate(limbs_of(a, bits)):
        for j, y in enumerate(right):
            out += np.matmul(x, y).astype(np.int64) << (bits * (i + j))
    return out


def _tidy(x: np.ndarray) -> np.ndarray:
    """Python integers as int64 where all fit with room to spare."""
    return x.astype(np.int64) if x.dtype == object and _greatest(x) < 1 << 62 else x


def integers(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of finite float64 x; int64, or Python integers where one is too great for it."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < 2.0**62:
        return y.astype(np.int64)
    # so great a float is a whole number, and so is its product with a whole scale
    flat = [int(v) if abs(v) < 2.0**62 else int(u) * int(scale) for u, v in zip(x.ravel().tolist(), y.ravel().tolist(), strict=True)]
    return np.array(flat, object).reshape(x.shape)


def nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) by part and row of the first nearest entry; parts (p, n, w), books (p, k, w)."""
    square = lambda x: _tidy((x.astype(object) ** 2).sum(-1)) if x.dtype == object or _greatest(x) ** 2 * max(x.shape[-1], 1) >= 1 << 60 else (x * x).sum(-1)
    dot, a, b = exact_product(parts, books.transpose(0, 2, 1)), square(parts), square(books)
    if object in (dot.dtype, a.dtype, b.dtype):
        dot, a, b = dot.astype(object), a.astype(object), b.astype(object)
    far = a[:, :, None] - 2 * dot + b[:, None, :]
    at = far.argmin(-1)
    return at, np.take_along_axis(far, at[:, :, None], -1)[:, :, 0]


def _vectors(column: pa.Array, length: int, rules: Quantiser) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have that length, integers of those by part: (parts, rows, width))."""
    sizes = np.diff(column.offsets.to_numpy())
    fits = sizes == length
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat[np.repeat(fits, sizes)].reshape(int(fits.sum()), length)
    return fits, integers(rows, rules.scale).reshape(len(rows), rules.parts, length // rules.parts).transpose(1, 0, 2)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            yield batch.slice(i, _ROWS)


def _split(total: int) -> list[int]:
    low = [total >> (_SUM_BITS * i) & ((1 << _SUM_BITS) - 1) for i in range(_SUM_LIMBS - 1)]
    return [*low, total >> (_SUM_BITS * (_SUM_LIMBS - 1))]


def _sums(vectors: DataFrame, books: np.ndarray, length: int, rules: Quantiser) -> DataFrame:
    """(part, entry, place, n, l0, l1, ...): how many parts took the entry, and the limbs of their sum at that place."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(books.shape[:2], np.int64)
        total = np.zeros(books.shape, object)
        for batch in _slices(batches):
            _, parts = _vectors(batch.column(0), length, rules)
            at, _ = nearest(parts, books)
            chosen = (at[:, None, :] == np.arange(books.shape[1])[None, :, None]).astype(np.int64)
            count += chosen.sum(-1)
            total += exact_product(chosen, parts).astype(object)
        if count.any():
            rows = [(p, e, w, int(count[p, e]), *_split(int(total[p, e, w]))) for p, e, w in np.ndindex(*books.shape) if count[p, e]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    names = ["part", "entry", "place", "n", *[f"l{i}" for i in range(_SUM_LIMBS)]]
    found = vectors.mapInArrow(add, ", ".join(f"{c} long" for c in names))
    return found.groupBy("part", "entry", "place").agg(*[F.sum(c).alias(c) for c in names[3:]])


def train(vectors: DataFrame, first: np.ndarray, length: int, rules: Quantiser) -> np.ndarray:
    """The codebooks (parts, entries, width) after the rounds; vectors: one column of arrays; first: the first entries."""
    books = first
    for _ in range(rules.rounds):
        new = books.astype(object)
        for r in _sums(vectors, books, length, rules).toLocalIterator():
            total = sum(r[f"l{i}"] << (_SUM_BITS * i) for i in range(_SUM_LIMBS))
            new[r["part"], r["entry"], r["place"]] = total // r["n"]
        books = _tidy(new)
    return books


def coded(vector: Column, books: np.ndarray, length: int, rules: Quantiser) -> Column:
    """struct<code string, error long, wide boolean> of each vector; code is null for one of another length, and wide says
    that the error leaves a long."""

    @F.arrow_udf("code string, error long, wide boolean")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            fits, codes, errors = [], [], []
            for i in range(0, len(column), _ROWS):
                some, parts = _vectors(column.slice(i, _ROWS), length, rules)
                at, far = nearest(parts, books)
                fits.append(some)
                codes += [bytes(x).hex() for x in at.T.astype(np.uint8)]
                errors += [int(x) for x in far.astype(object).sum(0)] if far.dtype == object or _greatest(far) >= 1 << 59 else far.sum(0).tolist()
            known = iter(zip(codes, errors, strict=True))
            rows = [next(known) if fit else (None, None) for fit in np.concatenate([*fits, np.zeros(0, bool)]).tolist()]
            wide = [e is not None and e >= 1 << 63 for _, e in rows]
            yield pa.StructArray.from_arrays(
                [pa.array([c for c, _ in rows], pa.string()), pa.array([None if w else e for (_, e), w in zip(rows, wide, strict=True)], pa.int64()), pa.array(wide, pa.bool_())], ["code", "error", "wide"]
            )

    return code(vector)


def compress(table: DataFrame, rules: Quantiser = Quantiser(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(one row per kept row of table: vec_id, label, code, error, label_error; the codebooks: part, entry, place)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kept = table.where(F.col(vector_col).isNotNull() & F.forall(vector_col, finite))
    kept = kept.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    order = [F.asc_nulls_last("vec_id"), "vector"]
    start = kept.orderBy(*order).limit(rules.entries).collect()
    length = len(start[0]["vector"]) if start else 0
    if length % rules.parts:
        raise ValueError(f"{rules.parts} parts don't divide {length} components")
    if any(len(r["vector"]) != length for r in start):
        start = kept.where(F.size("vector") == length).orderBy(*order).limit(rules.entries).collect()
    first = integers(np.array([r["vector"] for r in start], np.float64).reshape(len(start), length), rules.scale)
    books = first.reshape(len(start), rules.parts, length // rules.parts).transpose(1, 0, 2)
    if not start:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), books
    books = train(kept.select("vector"), books, length, rules)
    cell = private("cell")
    rows = saved(kept.select("vec_id", "label", coded(F.col("vector"), books, length, rules).alias(cell)).select("vec_id", "label", f"{cell}.*"))
    # decimals hold any sum of longs; one that leaves a long is null
    total = F.expr("try_cast(sum(cast(error as decimal(38, 0))) as bigint)")
    totals = rows.groupBy(F.col("label").alias("_label")).agg(F.count("*").alias("_n"), F.when(~F.coalesce(F.bool_or("wide"), F.lit(False)), total).alias("_total"))
    return _with_totals(rows.drop("wide"), saved(totals), rules), books


def _with_totals(rows: DataFrame, totals: DataFrame, rules: Quantiser) -> DataFrame:
    """rows with label_error. Labels above this share of the rows are at most hot_labels, and broadcast; each of the others
    is small enough for a task."""
    few = totals.count() <= rules.hot_labels
    hot = totals if few else totals.where(F.col("_n") > rows.count() // rules.hot_labels)
    same = lambda df: rows["label"].eqNullSafe(df["_label"])
    out = rows.join(F.broadcast(hot), same(hot), "left" if few else "inner")
    if not few:
        cold = rows.join(F.broadcast(hot.select("_label")), same(hot), "left_anti")
        out = out.unionByName(cold.join(totals, cold["label"].eqNullSafe(totals["_label"])))
    return out.select("vec_id", "label", "code", "error", F.when(F.col("code").isNotNull(), F.col("_total")).alias("label_error"))


def books_sha256(books: np.ndarray) -> str:
    """Of all entries' integers by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def digest(table: DataFrame, rules: Quantiser = Quantiser()) -> DataFrame:
    rows, books = compress(table, rules)
    return rows.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
