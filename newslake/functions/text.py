"""Text expressions: cleaning, summaries, tags, categories, tokens and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newslake import config
from newslake.functions import keywords

WS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^n + 0.5) / 10^n."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def collapsed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, WS, " "))


def clean_title(x: Column) -> Column:
    return F.substring(collapsed(x), 1, 300)


def strip_html(x: Column) -> Column:
    """The tag-stripping fallback: scripts and styles go, tags become spaces, six entities are decoded."""
    for pattern, to in (
        (r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""), (r"<[^>]+>", " "), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ):
        x = F.regexp_replace(x, pattern, to)
    return collapsed(x)


def remove_boilerplate(x: Column) -> Column:
    for phrase in config.BOILERPLATE:
        x = F.regexp_replace(x, f"(?i){phrase}", "")
    return F.trim(x)


def make_summary(x: Column, most: int = 500) -> Column:
    """Text up to the limit; beyond it, cut at the last sentence end past 60 %, else at the last space with dots."""
    text = collapsed(F.coalesce(x, F.lit("")))
    cut = F.substring(text, 1, most)
    last = lambda c: F.when(F.locate(c, F.reverse(cut)) > 0, F.length(cut) - F.locate(c, F.reverse(cut)) + 1).otherwise(0)
    end = F.greatest(last("."), last("?"), last("!"))
    return F.when(F.length(text) <= most, text).when(end - 1 > most * 0.6, F.trim(F.substring(cut, F.lit(1), end))).otherwise(
        F.concat(F.substring(cut, F.lit(1), F.greatest(last(" ") - 1, F.lit(0))), F.lit("..."))
    )


def bound(x: Column, f) -> Column:
    """f(x) with x computed once: the transform of one element binds it, where a filter would else build it for each use."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def keyword_hits(text: Column, keywords) -> Column:
    """The keywords that text contains, in their order, as substrings; text is computed once."""
    return bound(text, lambda x: F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(x, k)))


def weighted_hits(text: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the keywords that text contains; plain conditionals, so that it stays in generated code."""
    total = F.lit(0.0)
    for k, w in weights.items():
        total = total + F.when(F.contains(text, F.lit(k)), float(w)).otherwise(0.0)
    return total


def extract_tags(categories: Column, title: Column, source_id: Column) -> Column:
    return F.slice(F.array_distinct(F.concat(F.transform(categories, lambda c: F.lower(c)), keyword_hits(F.lower(title), config.TAG_KEYWORDS), F.array(source_id))), 1, 10)


def categorize(terms: Column) -> Column:
    """First category, in their fixed order, of which any term contains a keyword as a substring."""
    slugs = list(config.CATEGORY_KEYWORDS)
    places = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i")) for i, slug in enumerate(slugs) for k in config.CATEGORY_KEYWORDS[slug]])
    hit = bound(F.transform(terms, lambda t: F.lower(t)), lambda low: F.filter(places, lambda p: F.exists(low, lambda t: F.contains(t, p["k"]))))
    return F.coalesce(F.get(F.array(*map(F.lit, slugs)), F.array_min(F.transform(hit, lambda p: p["i"]))), F.lit("technology"))


def read_time(x: Column, cap: int | None = 30) -> Column:
    minutes = F.ceil(F.size(F.split(F.trim(F.coalesce(x, F.lit(""))), r"\s+")) / 200)
    return F.greatest(F.lit(1), F.least(F.lit(cap), minutes) if cap else minutes).cast("int")


def normalize_date(ts: Column, as_of: Column) -> Column:
    return F.when(ts.isNull() | (ts > as_of) | (ts < as_of - F.expr("INTERVAL 365 DAYS")), as_of).otherwise(ts)


def plain(x: Column) -> Column:
    """Lower case, ASCII word characters and spaces only, collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\w\s]", ""), r"\s+", " "))


def content_fingerprint(title: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat(plain(title), F.lit("|"), F.substring(plain(content), 1, 500)), 256), 1, 32)


def title_domain_fingerprint(title: Column, host: Column) -> Column:
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", ""), r"\s+", " "))
    return F.substring(F.sha2(F.concat(t, F.lit("|"), F.regexp_replace(host, r"^(.*?)www\.", "$1")), 256), 1, 32)


def words(x: Column, least: int = 3, stops=()) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(x), r"[^\w\s]", "")), r"\s+"), lambda w: (F.length(w) >= least) & ~w.isin(*stops) if stops else F.length(w) >= least)


def bucket_key(title: Column, stops=config.BUCKET_STOPS) -> Column:
    return F.coalesce(F.get(words(title, 3, stops), F.lit(0)), F.lower(F.substring(title, 1, 5)))


def title_words(title: Column) -> Column:
    return F.array_distinct(words(title, 3))


def tokens(x: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"https?://\S+", ""), r"[^\w\s']", " ")
    return F.filter(
        F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "),
        lambda t: (F.length(t) > 2) & (F.length(t) < 30) & ~t.isin(*config.STOP_WORDS) & ~t.rlike(r"^\d+$"),
    )


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def char_ngrams(x: Column, n: int = 3) -> Column:
    none = F.expr("cast(array() as array<int>)")
    starts = lambda t: F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - (n - 1))).otherwise(none)
    return bound(collapsed(F.lower(x)), lambda t: F.array_distinct(F.transform(starts(t), lambda i: F.substring(t, i, F.lit(n)))))


def prompt_text(x: Column, most: int = 8000) -> Column:
    """Input of a summarising job: bracketed parts, URLs and unusual characters go; cut at a sentence end past 70 %."""
    text = x
    for pattern, to in ((r"\s+", " "), (r"\[.*?\]", ""), (r"https?://\S+", ""), (r"[^\w\s.,!?;:'\"()-]", "")):
        text = F.regexp_replace(text, pattern, to)
    text = F.trim(text)
    cut = F.substring(text, 1, most)
    last = lambda c: F.when(F.locate(c, F.reverse(cut)) > 0, F.length(cut) - F.locate(c, F.reverse(cut)) + 1).otherwise(0)
    end = F.greatest(last("."), last("?"), last("!"))
    return F.when(F.length(text) <= most, text).when(end - 1 > most * 0.7, F.substring(cut, F.lit(1), end)).otherwise(F.concat(F.substring(cut, F.lit(1), F.greatest(last(" ") - 1, F.lit(0))), F.lit("...")))


def token_estimate(x: Column) -> Column:
    return F.ceil(F.length(x) / 4)


def summarizable(content: Column) -> Column:
    """struct(valid, reason)."""
    text = F.trim(F.coalesce(content, F.lit("")))
    n = F.size(F.split(text, r"\s+"))
    out = lambda ok, why: F.struct(F.lit(ok).alias("valid"), F.lit(why).alias("reason"))
    return F.when(F.length(text) < 100, out(False, "too short")).when(F.length(text) < 200, out(True, "brief")).when(n < 30, out(False, "too few words")).otherwise(out(True, "ok"))


def sentences(content: Column) -> Column:
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(content, r"\s+", " "), r"\[.*?\]", ""), r"https?://\S+", ""))
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: (F.length(s) > 20) & (F.length(s) < 200))


def extractive_summary(content: Column) -> Column:
    text = F.substring(F.array_join(F.slice(sentences(content), 1, 3), " "), 1, 300)
    return bound(text, lambda x: F.when(x == "", "Summary not available.").otherwise(x))


def keyword_fingerprint(docs, content: str = "content", id_col: str = "article_id"):
    """(id, keyword_fp) of a DataFrame's rows: its 20 most frequent words over three characters (ties by first place), sorted."""
    words = F.split(F.regexp_replace(F.lower(content), r"[^a-z0-9\s]", ""), r"\s+")
    w = docs.select(id_col, F.posexplode(words).alias("pos", "word")).where((F.length("word") > 3) & ~F.col("word").isin(*config.FINGERPRINT_STOPS))
    c = w.groupBy(id_col, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    top = c.groupBy(id_col).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "word"))), 1, 20).alias("t"))
    joined = F.array_join(F.array_sort(F.transform("t", lambda x: x["word"])), "|")
    return docs.select(id_col).join(top, id_col, "left").select(id_col, F.substring(F.sha2(F.coalesce(joined, F.lit("")), 256), 1, 32).alias("keyword_fp"))


def tech_score(title: Column, summary: Column, content: Column, source: Column, extra_high=()) -> Column:
    """Hits of each keyword class by weight, less those against, 5 more for a tech source; over 30, between 0 and 1."""
    name = F.lower(source)
    trusted = F.lit(False)
    for s in config.TECH_SOURCES:
        trusted = trusted | F.contains(name, F.lit(s))

    # a keyword of two classes counts for both
    weights: dict[str, float] = {}
    for words_, w in (((*config.TECH_HIGH, *extra_high), 3.0), (config.TECH_MEDIUM, 2.0), (config.TECH_LOW, 1.0), (config.NON_TECH, -2.0)):
        for k in dict.fromkeys(words_):
            weights[k] = weights.get(k, 0.0) + w
    hits = keywords.places(F.lower(F.concat_ws(" ", title, summary, content)), tuple(weights))
    points = F.array(*map(F.lit, weights.values()))
    raw = F.aggregate(hits, F.lit(0.0), lambda acc, i: acc + F.get(points, i)) + F.when(trusted, 5.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw / 30))


def is_tech(score: Column) -> Column:
    return score >= 0.15


def tech_keywords(title: Column, summary: Column, content: Column, extra_high=()) -> Column:
    """The first ten distinct keywords that count for tech."""
    names = tuple(dict.fromkeys((*config.TECH_HIGH, *extra_high, *config.TECH_MEDIUM, *config.TECH_LOW)))
    hits = keywords.places(F.lower(F.concat_ws(" ", title, summary, content)), names)
    return F.transform(F.slice(hits, 1, 10), lambda i: F.get(F.array(*map(F.lit, names)), i))


def why_it_matters(content: Column) -> Column:
    def sentence(found: Column) -> Column:
        return F.when(F.size(found) > 0, F.concat(F.lit("This relates to "), F.array_join(found, ", "), F.lit(" in tech."))).otherwise("This is a notable development in the tech industry.")

    return bound(F.slice(keyword_hits(F.lower(content), config.SUMMARY_KEYWORDS), 1, 3), sentence)


def summary_title(title: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(title, r"\s+", " "), r"\|.*$", ""), r"-\s*[^-]*$", "")
    return F.substring(F.trim(x), 1, 100)


def capitalized(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))


def two_sentences(content: Column) -> Column:
    """The shorter fallback: the first two sentences over 20 characters, 500 characters at most."""
    parts = F.filter(F.split(F.regexp_replace(content, r"\s+", " "), r"(?<=[.!?])\s+"), lambda s: F.length(s) > 20)
    return F.substring(F.array_join(F.slice(parts, 1, 2), " "), 1, 500)


def reply_fields(reply: Column) -> Column:
    """struct<title, summary, why_it_matters> of a model's reply: its text from the first to the last brace as JSON, null
    where that is none; blank fields take their defaults."""
    x = F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")), "title string, summary string, why_it_matters string, whyItMatters string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    filled = lambda c, default: F.when(F.trim(c) != "", F.trim(c)).otherwise(default)
    why = F.coalesce(F.when(x["why_it_matters"] != "", x["why_it_matters"]), x["whyItMatters"])
    out = F.struct(filled(x["title"], "Untitled").alias("title"), filled(x["summary"], "").alias("summary"), filled(why, "").alias("why_it_matters"))
    return F.when(x.isNotNull() & x["_bad"].isNull(), out)
