"""Benchmark decontamination in DataFrame functions only.

Every window of `width` consecutive words of a benchmark item (an item of fewer words is one window of its own length)
is looked for in every document. A bit table of the windows' hashes, a literal in the plan sized by their number up to
a fixed bound, passes over the windows that cannot match; the few that may are verified word for word by a join with the
windows themselves, which are broadcast only if their number is below `most_broadcast` (else the join shuffles).

Null texts have no words. Very long texts are scanned whole. Rows are told apart by id and text, so equal and null ids
keep their own results, and rows repeated whole have one each. An empty benchmark hits nothing; an empty table gives no
rows. Ties of windows need no rule, as all count. Extra columns are not touched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import ALNUM_GAP, lower_ascii, private

#: log2 of the table's bits: 32 a window, between these; the greatest table is 256 K longs, two megabytes. Beyond half a
#: million windows it lets more candidates through to the join, and is right all the same.
LEAST_BITS, MOST_BITS = 12, 24


@dataclass(frozen=True)
class Decontamination:
    width: int = 10
    most_broadcast: int = 2_000_000


def words_of(text: Column) -> Column:
    """Words in order. The one-element transform binds the split array, so that it is computed once."""

    def trimmed(parts: Column) -> Column:
        first = (F.get(parts, F.lit(0)) == "").cast("int")
        last = F.when(F.size(parts) > 1, (F.element_at(parts, -1) == "").cast("int")).otherwise(0)
        return F.slice(parts, first + 1, F.size(parts) - first - last)

    return F.get(F.transform(F.array(F.split(lower_ascii(F.coalesce(text, F.lit(""))), ALNUM_GAP)), trimmed), F.lit(0))


def _probe(h: Column, i: Column, width: int) -> Column:
    """A hash of some words of the window that starts at i (0-based) from word hashes h: the first, the middle and the
    last; enough to pass over nearly all windows, whatever it lets through is verified."""
    return F.get(h, i).bitwiseXOR(F.shiftleft(F.get(h, i + (width // 2)), 1)).bitwiseXOR(F.shiftright(F.get(h, i + (width - 1)), 1))


def _starts(n: Column, width: int) -> Column:
    """0 .. n - width, or none."""
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.expr("cast(array() as array<int>)"))


def benchmark_windows(items: DataFrame, rules: Decontamination, id_col: str, text_col: str) -> DataFrame:
    """(item_id string, width, window string, probe) of every item with words."""
    words, n = private("w"), private("n")
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias(words))
    rows = rows.withColumn(n, F.size(words)).where(F.col(n) > 0).withColumn("width", F.least(F.col(n), F.lit(rules.width)))
    at = F.explode(F.sequence(F.lit(0), F.col(n) - F.col("width"))).alias("at")
    rows = rows.select("item_id", "width", words, at).withColumn("words", F.slice(F.col(words), F.col("at") + 1, F.col("width")))
    h = F.transform("words", lambda w: F.xxhash64(w))
    probe = F.get(h, F.lit(0)).bitwiseXOR(F.shiftleft(F.get(h, F.floor(F.col("width") / 2).cast("int")), 1)).bitwiseXOR(F.shiftright(F.get(h, F.col("width") - 1), 1))
    return rows.select("item_id", "width", F.array_join("words", " ").alias("window"), probe.alias("probe"))


def _slot(probe: Column, slots: int) -> Column:
    """A probe's low bits choose a long of the table, its six highest bits the bit."""
    return probe.bitwiseAND(F.lit(slots - 1)).cast("int")


def _bit(probe: Column) -> Column:
    return F.shiftrightunsigned(probe, 58).cast("int")


def _bit_table(windows: DataFrame, n: int) -> tuple[Column, int]:
    """(array<bigint> literal with a bit set for each of the n probes, its size)."""
    slots = 1 << (min(MOST_BITS, max(LEAST_BITS, (32 * n - 1).bit_length())) - 6)
    rows = windows.select(_slot(F.col("probe"), slots).alias("i"), F.expr("1L").alias("one"), _bit(F.col("probe")).alias("b"))
    rows = rows.selectExpr("i", "shiftleft(one, b) x").groupBy("i").agg(F.bit_or("x").alias("x")).collect()
    table = [0] * slots
    for r in rows:
        table[r["i"]] = r["x"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>"), slots


def _may_match(table: tuple[Column, int], probe: Column) -> Column:
    return F.call_function("shiftright", F.get(table[0], _slot(probe, table[1])), _bit(probe)).bitwiseAND(F.lit(1)) == 1


def hits(docs: DataFrame, items: DataFrame, rules: Decontamination = Decontamination(), id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, item_ids (sorted strings), spans array<struct<start, end>> of hit
    words (0-based, end exclusive, disjoint)."""
    found = _found(docs, items, rules, id_col, text_col, item_id_col, item_text_col)
    rows = found.select(F.explode(F.sequence(F.lit(1), F.col("copies"))), "doc_id", "n_words", merged("raw").alias("spans"), "item_ids").drop("col")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), "item_ids", "spans")


def _found(docs: DataFrame, items: DataFrame, rules: Decontamination, id_col: str, text_col: str, item_id_col: str, item_text_col: str) -> DataFrame:
    """One row per (doc_id, text_md5): copies (rows that have both), n_words, raw (sorted spans that hit), item_ids."""
    windows = benchmark_windows(items, rules, item_id_col, item_text_col).persist()
    try:
        counts = {r["width"]: r["count"] for r in windows.groupBy("width").count().collect()}
        widths = sorted(counts)
        tables = {w: _bit_table(windows.where(F.col("width") == w), counts[w]) for w in widths}
    finally:
        windows.unpersist()
    known = windows.groupBy("window", "width").agg(F.collect_set("item_id").alias("items"))
    known = F.broadcast(known) if sum(counts.values()) <= rules.most_broadcast else known

    words, h, found = (private(x) for x in ("words", "hashes", "found"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.md5(text).alias("text_md5"), words_of(text).alias(words))
    rows = rows.withColumn(h, F.transform(words, lambda w: F.xxhash64(w)))
    none = F.expr("cast(array() as array<struct<start:int,width:int,window:string>>)")

    def candidates(width: int) -> Column:
        probes = F.transform(_starts(F.size(h), width), lambda i: _probe(F.col(h), i, width))
        at = F.array_compact(F.transform(probes, lambda p, i: F.when(_may_match(tables[width], p), i)))
        return F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(width).alias("width"), F.array_join(F.slice(F.col(words), i + 1, F.lit(width)), " ").alias("window")))

    key = ["doc_id", "text_md5"]
    rows = rows.select(*key, F.size(words).cast("long").alias("n_words"), F.concat(none, *map(candidates, widths)).alias(found))
    rows = rows.select(*key, "n_words", F.posexplode_outer(found).alias("pos", found)).select(*key, "n_words", "pos", f"{found}.*")
    rows = rows.join(known, ["window", "width"], "left")
    hit = F.when(F.col("items").isNotNull(), F.struct("start", (F.col("start") + F.col("width")).alias("end")))
    return rows.groupBy(*key).agg(
        F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("copies"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_set(hit)).alias("raw"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )


def merged(spans: str) -> Column:
    """Sorted spans with touching and overlapping ones made one."""

    def step(acc: Column, x: Column) -> Column:
        joins = x["start"] <= acc["end"]
        return F.struct(
            F.when(joins, acc["start"]).otherwise(x["start"]).alias("start"),
            F.when(joins, F.greatest(acc["end"], x["end"])).otherwise(x["end"]).alias("end"),
            F.when(joins | (acc["end"] < 0), acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).alias("done"),
        )

    start = F.expr("named_struct('start', -1, 'end', -1, 'done', cast(array() as array<struct<start:int,end:int>>))")
    last = lambda acc: F.when(acc["end"] < 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))))
    return F.aggregate(F.col(spans), start, step, last)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, rules: Decontamination = Decontamination(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold any window; columns unchanged. Rows are told apart by id and text."""
    name, md5 = private("id"), private("md5")
    found = _found(docs, items, rules, id_col, text_col, "item_id", "text")
    bad = found.where(F.size("raw") > 0).select(F.col("doc_id").alias(name), F.col("text_md5").alias(md5))
    same = docs[id_col].eqNullSafe(bad[name]) & (F.md5(F.coalesce(docs[text_col], F.lit(""))) == bad[md5])
    return docs.join(bad, same, "left_anti")
