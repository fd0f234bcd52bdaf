"""Many keywords looked for at once: an automaton walks each text once, in Arrow batches, where an expression would scan it
once for every keyword. Keywords count as substrings; a text's length alone decides the time."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=8)
def _automaton(keywords: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for i, k in enumerate(keywords):
        found.add_word(k, i)
    found.make_automaton()
    return found


def places(text: Column, keywords: tuple[str, ...]) -> Column:
    """The places, ascending, of the distinct non-empty keywords that the text contains; none for null."""
    if len(set(keywords)) < len(keywords) or "" in keywords:
        raise ValueError("keywords must be distinct and not empty")

    @F.arrow_udf("array<int>")
    def walk(texts: pa.Array) -> pa.Array:
        machine = _automaton(keywords)
        return pa.array([sorted({i for _, i in machine.iter(t)}) if t else [] for t in texts.to_pylist()], pa.list_(pa.int32()))

    return walk(text)
