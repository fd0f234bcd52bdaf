"""License scans: places of fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line, or a paragraph (lines up to a blank one), or any run of its words of at most `stretch` percent of a
template's length in words. A block meets a template when some such run has at least `percent` of the template's distinct
words. Template words are ordered by their frequency over all documents, rarest first; a block must share a word of the
template's prefix (the length filter and the positional bound then pass over most others), and the rest is counted
exactly. The templates are few and fixed, so their words and frequencies have a fixed size.

Null and empty texts have no words, labels or places; their score is 0. Very long texts are scanned whole and row by row,
so repeated rows and equal ids need no rule; equal frequencies are ordered by the word. An empty table gives no rows.
Extra columns are not touched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import LOWER, UPPER, private

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public notices by label.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)

_GAPS = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode())))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_GAPS).split()


@dataclass(frozen=True)
class Scan:
    """percent: of a template's distinct words that a run must have; stretch: its length in percent of the template's."""

    percent: int = 90
    stretch: int = 150
    templates: tuple[tuple[str, str], ...] = field(default=TEMPLATES)


def word_frequencies(docs: DataFrame, rules: Scan = Scan(), text_col: str = "text") -> dict[bytes, int]:
    """Documents by template word, counted over all docs."""
    wanted = frozenset(w for _, t in rules.templates for w in words_of(t))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = dict.fromkeys(wanted, 0)
        for part in parts:
            for text in part.column(0).to_pylist():
                for w in wanted.intersection(words_of(text or "")):
                    seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen]), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"].encode(): r["n"] for r in rows}


class TemplateIndex:
    """Templates by their prefix words in global order."""

    def __init__(self, rules: Scan, frequencies: dict[bytes, int]):
        order = {w: i for i, w in enumerate(sorted({w for _, t in rules.templates for w in words_of(t)}, key=lambda w: (frequencies.get(w, 0), w)))}
        self.order, self.sets, self.prefix = order, [], {}
        for k, (label, text) in enumerate(rules.templates):
            words = sorted(set(words_of(text)), key=order.__getitem__)
            need = -(-rules.percent * len(words) // 100)
            self.sets.append((label, frozenset(words), need, -(-rules.stretch * len(words_of(text)) // 100)))
            for at, w in enumerate(words[: len(words) - need + 1]):
                self.prefix.setdefault(w, []).append((k, at, len(words)))
        self.known = frozenset(order)

    def matches(self, words: list[bytes]) -> dict[str, float]:
        """Best containment by label of the templates that a run of a block's words meets."""
        block = self.known.intersection(words)
        out: dict[str, float] = {}
        tried = set()
        for w in block.intersection(self.prefix):
            later = None
            for k, at, size in self.prefix[w]:
                label, template, need, length = self.sets[k]
                if k in tried or len(block) < need:
                    continue
                if later is None:
                    later = sum(self.order[x] >= self.order[w] for x in block)
                # words before this one in both may match too, at most as many as the prefix holds there
                if at + min(size - at, later) < need:
                    continue
                tried.add(k)
                if len(block & template) >= need:
                    common = best_run(words, template, length)
                    if common >= need:
                        out[label] = max(out.get(label, 0.0), common / len(template))
        return out


def best_run(words: list[bytes], template: frozenset[bytes], length: int) -> int:
    """The most distinct template words in any run of `length` words."""
    places = [i for i, w in enumerate(words) if w in template]
    held: dict[bytes, int] = {}
    best = first = 0
    for i in places:
        held[words[i]] = held.get(words[i], 0) + 1
        while places[first] <= i - length:
            w = words[places[first]]
            held[w] -= 1
            if not held[w]:
                del held[w]
            first += 1
        best = max(best, len(held))
    return best


_FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scanned(text: Column, rules: Scan, frequencies: dict[bytes, int]) -> Column:
    phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]

    @F.pandas_udf(_FOUND)
    def found(texts: pd.Series) -> pd.DataFrame:
        index, out = TemplateIndex(rules, frequencies), []
        for text in texts:
            text = text if isinstance(text, str) else ""
            words = words_of(text)
            have = set(words)
            places, base = [], set()
            for phrase, label in phrases:
                if have.issuperset(phrase):
                    hits = [i for i, w in enumerate(words) if w == phrase[0] and words[i : i + len(phrase)] == phrase]
                    places += hits
                    base |= {label} if hits else set()
            best: dict[str, float] = {}
            if not have.isdisjoint(index.prefix):
                for block in _blocks(text):
                    for label, share in index.matches(block).items():
                        best[label] = max(best.get(label, 0.0), share)
            score = 1.0 if base else max(best.values(), default=0.0)
            out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(best))), score))
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in _FOUND.split(", ")])
        return frame.astype({"first_word": "Int64", "last_word": "Int64"})

    return found.asNondeterministic()(text)


def _blocks(text: str) -> Iterator[list[bytes]]:
    paragraph: list[bytes] = []
    lines = 0
    for line in text.split("\n"):
        words = words_of(line)
        if words:
            yield words
            paragraph += words
            lines += 1
        else:
            if lines > 1:
                yield paragraph
            paragraph, lines = [], 0
    if lines > 1:
        yield paragraph


def scan(docs: DataFrame, rules: Scan = Scan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and n_words, n_base, first_word, last_word, base_labels, labels, score."""
    name = private("found")
    frequencies = word_frequencies(docs, rules, text_col)
    return docs.select(F.col(id_col), scanned(F.col(text_col), rules, frequencies).alias(name)).select(id_col, f"{name}.*")
