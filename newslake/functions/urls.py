"""URL keys and hosts; URLs that do not parse fall back to their lower-cased text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newslake import config


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)


def _key(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.regexp_replace(F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.when(path == "", "/").otherwise(path)), r"/+$", "")


def url_key(url: Column, params=("id", "p", "article", "story")) -> Column:
    """Host without www, path without trailing slashes, and the named parameters that have a value."""
    pairs = [F.when(v != "", F.concat(F.lit(f"{p}="), v)) for p in params for v in [F.regexp_extract(url, rf"[?&]{p}=([^&#]*)", 1)]]
    query = F.concat_ws("&", *pairs) if pairs else F.lit("")
    key = F.lower(F.concat(_key(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))
    return F.when(host(url) == "", F.lower(url)).otherwise(key)


def image_url(url: Column) -> Column:
    bad = F.lit(False)
    for word in config.PLACEHOLDER_IMAGES:
        bad = bad | F.contains(F.lower(url), F.lit(word))
    return F.when(F.lower(url).rlike("^https?://[^/?#]") & ~bad, url)
