"""Secret scans in DataFrame functions only: three fixed patterns, and two character Markov models.

One model is of random strings, one of ordinary identifiers; both are trained from labelled samples by counting
character pairs. A candidate token is a secret when the log-likelihood ratio of the models, per character pair, is
above a threshold, which is set on a fifth of the identifiers that training does not see. Positions are in code points,
ends exclusive.

The samples are bounded: random strings (label 1) are digests of a range in seven alphabets, and the values of the fixed
patterns in a sample of texts; identifiers (label 0) are the words of these texts in several cases, alone, numbered and
joined. Everything else covers all rows.

Null and empty texts have no spans. Very long texts are scanned whole. Rows are judged one by one, so repeated rows,
equal ids and ties need no rule. An empty table gives no rows. Extra columns are not touched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newslake.llm.common import bound, private, running, saved

#: Kinds in their order, with pattern and least length; group 0 counts, for assign group 2.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy and maximal, these match what the patterns with + and a length test would keep.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
_SIZE = 128  # ASCII


@dataclass(frozen=True)
class Threshold:
    """samples: most strings of each label that are learnt from; texts: about how many texts (those of least hash) give
    them; alarms: the share of held-out identifiers that may pass the threshold; least: its smallest value."""

    samples: int = 20_000
    texts: int = 20_000
    alarms: float = 0.0005
    least: float = 0.25


@dataclass(frozen=True)
class Models:
    """ratios: log-likelihood ratio of random over identifier by character pair; threshold: of a token's mean."""

    ratios: tuple[float, ...]
    threshold: float


def _zipped(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of the leftmost non-overlapping matches: their code point span and text.

    split and regexp_extract_all walk the same matches, so ends are the running sum of gaps and matches.
    """

    def spans(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        lengths = F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m))
        ends = running(lengths, lambda a, b: a + b, F.lit(0))
        return F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m")))

    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    # most texts have no match and skip the rest
    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(none))


def _kind(spans: Column, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), x["m"].alias("m")))


def base_spans(text: Column) -> dict[str, Column]:
    """array<struct<s, k, e, m>> by kind."""
    long_enough = lambda x: F.length(F.regexp_extract(x["m"], "^" + ASSIGN + "$", 2)) >= 12
    found = {"assign": F.filter(_zipped(text, ASSIGN), long_enough), "access": _zipped(text, ACCESS), "hex": _zipped(text, HEX)}
    return {k: _kind(v, k) for k, v in found.items()}


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"], x["e"])), ",")


def _pairs(value: Column) -> Column:
    """Codes of adjacent characters, first * 128 + second; ASCII values only."""
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.size(codes), F.lit(1))), lambda a, b: a * _SIZE + b)


def _mean_ratio(value: Column, ratios: tuple[float, ...]) -> Column:
    """Mean log-likelihood ratio of a value's pairs."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    return F.get(F.transform(F.array(_pairs(value)), lambda p: F.aggregate(p, F.lit(0.0), lambda acc, x: acc + F.get(table, x)) / F.greatest(F.size(p), F.lit(1))), F.lit(0))


def train(samples: DataFrame, rules: Threshold = Threshold()) -> Models:
    """Models from samples (value, label 1 random / 0 identifier).

    Pair counts with add-one smoothing; the table has 128 * 128 entries whatever the input. Identifiers whose hash is a
    multiple of 5 are held out for the threshold.
    """
    import math

    held = (F.col("label") == 0) & (F.pmod(F.xxhash64("value"), F.lit(5)) == 0)
    samples = saved(samples.select("value", "label", held.alias("held")))
    counts = samples.where("not held").select("label", F.explode(_pairs(F.col("value"))).alias("pair")).where(f"pair between 0 and {_SIZE * _SIZE - 1}").groupBy("label", "pair").count()
    rows = {(int(r["label"]), int(r["pair"])): int(r["count"]) for r in counts.collect()}

    def logs(label: int) -> list[float]:
        out = []
        for a in range(_SIZE):
            row = [rows.get((label, a * _SIZE + b), 0) for b in range(_SIZE)]
            total = sum(row) + 66
            out += [math.log((c + 1) / total) for c in row]
        return out

    ratios = tuple(r - i for r, i in zip(logs(1), logs(0), strict=True))
    found = samples.where("held and length(value) >= 16").agg(F.percentile(_mean_ratio(F.col("value"), ratios), 1 - rules.alarms)).first()[0]
    return Models(ratios, max(rules.least, found or 0.0))


def _random_strings(spark: SparkSession, n: int) -> DataFrame:
    """n random strings of 16 to 48 characters: base64, its letters and digits, its file-name form, hex in both cases,
    lower-case letters and digits, and letters."""
    digest = F.sha2(F.col("id").cast("string"), 512)
    base64 = F.base64(F.unhex(digest))
    letters = F.regexp_replace(base64, "[^A-Za-z]", "")
    alphabets = (base64, F.regexp_replace(base64, "[+/=]", ""), F.translate(base64, "+/=", "-_"), digest, F.upper(digest), F.lower(F.regexp_replace(base64, "[+/=]", "")), letters)
    value = F.get(F.array(*alphabets), (F.col("id") % len(alphabets)).cast("int"))
    return spark.range(n).select(F.substring(value, F.lit(1), (F.lit(16) + F.pmod(F.xxhash64("id"), F.lit(33))).cast("int")).alias("value"))


def labelled_samples(docs: DataFrame, text_col: str = "text", rules: Threshold = Threshold()) -> DataFrame:
    """(value, label): at most rules.samples random strings and as many identifiers, from about rules.texts texts of docs.

    Copies of a text share its hash, so they are in the sample together or not at all, and count once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    share = min(1.0, rules.texts / max(1, docs.count()))
    some = docs.select(text.alias("text")).where(F.xxhash64("text").bitwiseAND(F.lit((1 << 53) - 1)) <= int(share * (1 << 53)))
    t = F.col("text")
    values = F.concat(
        F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all(t, F.lit(HEX), F.lit(0)),
        F.filter(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda m: F.length(m) >= 12),
    )
    least = lambda rows, n: rows.orderBy(F.xxhash64("value"), "value").limit(n)
    secret = least(some.select(F.explode(values).alias("value")).distinct(), rules.samples // 2)
    random = _random_strings(docs.sparkSession, rules.samples - rules.samples // 2).union(secret)
    words = some.select(F.explode(F.split("text", r"[^A-Za-z0-9_]+")).alias("value")).where("length(value) between 3 and 40").distinct()
    words = saved(least(words.join(secret, "value", "left_anti"), max(1, rules.samples // 4)))
    # each word is followed by the one of the next hash, for joined identifiers; the sample is bounded
    after = Window.orderBy(F.xxhash64("value"), "value")
    w, x, y = F.col("value"), F.col("x"), F.col("y")
    pairs = words.select("value", F.coalesce(F.lead("value").over(after), w).alias("x"), F.coalesce(F.lead("value", 2).over(after), w).alias("y"))
    number = F.pmod(F.xxhash64("value"), F.lit(1000)).cast("string")
    joined = F.get(
        F.array(F.concat_ws("_", w, x, y), F.concat_ws("-", w, x, y), F.concat(w, F.initcap(x), F.initcap(y)), F.concat_ws("/", w, x, y), F.upper(F.concat_ws("_", w, x)), F.concat(w, x, number)),
        F.pmod(F.xxhash64("value", F.lit(1)), F.lit(6)).cast("int"),
    )
    cased = F.get(F.array(F.upper(w), F.lower(w), F.initcap(w), F.concat(w, number)), F.pmod(F.xxhash64("value", F.lit(2)), F.lit(4)).cast("int"))
    names = pairs.select(F.explode(F.array(w, cased, joined, F.concat(joined, F.lit("_"), number))).alias("value")).distinct()
    return random.select("value", F.lit(1).alias("label")).union(names.select("value", F.lit(0).alias("label")))


def model_spans(text: Column, models: Models) -> Column:
    """array<struct<s, k, e, m>> of candidate tokens that the models call random."""
    return _kind(F.filter(_zipped(text, CANDIDATE), lambda x: _mean_ratio(x["m"], models.ratios) > models.threshold), "random")


def _free(base: Column, extra: Column) -> Column:
    """The spans of extra (kind random) that no span of base overlaps. In order of start, an extra span is free if the
    greatest end of the base spans before it and the least start of those after it leave it so."""

    def kept(spans: Column) -> Column:
        is_base = lambda x: x["k"] < KINDS.index("random")
        ends = running(F.transform(spans, lambda x: F.when(is_base(x), x["e"]).otherwise(F.lit(-1))), F.greatest, F.lit(-1))
        most = F.lit(2**31 - 1)
        starts = F.reverse(running(F.transform(F.reverse(spans), lambda x: F.when(is_base(x), x["s"]).otherwise(most)), F.least, most))
        rows = F.arrays_zip(spans.alias("x"), ends.alias("before"), starts.alias("after"))
        free = F.filter(rows, lambda r: ~is_base(r["x"]) & (r["before"] <= r["x"]["s"]) & (r["after"] >= r["x"]["e"]))
        return F.transform(free, lambda r: r["x"])

    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int,m:string>>)")
    whole = lambda x: F.when(F.size(x) > 0, bound(F.array_sort(F.concat(base, x)), kept)).otherwise(none)
    return bound(extra, whole)


def all_spans(text: Column, models: Models) -> Column:
    """struct of the base spans by kind, and extra: the models' spans that no base span overlaps."""
    kinds = KINDS[:-1]

    def whole(b: Column) -> Column:
        return F.struct(*[b[k].alias(k) for k in kinds], _free(F.concat(*[b[k] for k in kinds]), model_spans(text, models)).alias("extra"))

    return bound(F.struct(*[v.alias(k) for k, v in base_spans(text).items()]), whole)


def scan(docs: DataFrame, models: Models | None = None, rules: Threshold = Threshold(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base_sha256, spans, found array<struct<s, k, e, m>>."""
    models = train(labelled_samples(docs, text_col, rules), rules) if models is None else models
    spans = private("spans")
    rows = docs.select(F.col(id_col), all_spans(F.coalesce(F.col(text_col), F.lit("")), models).alias(spans))
    flat = F.concat(*[F.col(f"{spans}.{k}") for k in KINDS[:-1]])
    every = F.concat(flat, F.col(f"{spans}.extra"))
    return rows.select(
        id_col,
        *[F.size(f"{spans}.{k}").cast("long").alias(f"n_{k}") for k in KINDS[:-1]],
        F.sha2(digest(flat), 256).alias("base_sha256"),
        digest(every).alias("spans"),
        F.array_sort(every).alias("found"),
    )


def redact(docs: DataFrame, models: Models | None = None, rules: Threshold = Threshold(), text_col: str = "text", count_col: str | None = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span's text replaced by mask (overlapping spans by one) and count_col brought up to date."""
    models = train(labelled_samples(docs, text_col, rules), rules) if models is None else models
    name = private("spans")
    text = F.col(text_col)

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(x["s"] > acc["at"], F.concat(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mask)))
        gap = gap.when((x["s"] == acc["at"]) & (F.size(acc["out"]) == 0), F.lit(mask)).otherwise(F.when(x["s"] == acc["at"], F.lit(mask)).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], F.array(gap)).alias("out"))

    start = F.expr("named_struct('at', 0, 'out', cast(array() as array<string>))")
    found = all_spans(F.coalesce(text, F.lit("")), models)
    spans = bound(found, lambda x: F.array_sort(F.concat(*[x[k] for k in (*KINDS[:-1], "extra")])))
    clean = F.aggregate(F.col(name), start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    out = docs.withColumn(name, spans).withColumn(text_col, F.when(F.size(name) > 0, clean).otherwise(text)).drop(name)
    return out.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType)) if count_col in docs.columns else out
