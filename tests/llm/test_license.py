"""License scans: places and labels against plain versions; odd tables."""

import random
import re

from newslake.llm import license_scan as L

TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(TO_LOWER))


def plain_labels(t, rules):
    """Every run of every block, by its start and end."""
    out = {}
    lines = (t or "").split("\n")
    blocks = [split(x) for x in lines if split(x)]
    paragraph = []
    for x in [*lines, ""]:
        if split(x):
            paragraph.append(split(x))
        else:
            blocks += [sum(paragraph, [])] if len(paragraph) > 1 else []
            paragraph = []
    for label, text in rules.templates:
        words = split(text)
        want, length = set(words), -(-rules.stretch * len(words) // 100)
        need = -(-rules.percent * len(want) // 100)
        for b in blocks:
            best = max((len(want & set(b[i : i + length])) for i in range(len(b))), default=0)
            if best >= need:
                out[label] = max(out.get(label, 0), best / len(want))
    return out


def test_labels_and_places_against_plain_versions(spark):
    r = random.Random(2)
    rules = L.Scan(percent=70)
    pool = sorted({w for _, t in rules.templates for w in split(t)}) + ["filler", "é", "x1"]
    rows = [None, "", "MIT license\n\nMIT License.", "mit\nlicense", "general public license" * 2, "the Apache  License; apache license"]
    for _ in range(250):
        parts = []
        for _ in range(r.randint(1, 4)):
            w = split(r.choice(rules.templates)[1])
            w = [x for x in w if r.random() < 0.9]
            for _ in range(r.randint(0, 25)):
                w.insert(r.randrange(len(w) + 1), r.choice(pool))
            parts.append(" ".join(w).title() if r.random() < 0.5 else " ".join(w))
        rows.append(r.choice(["\n", "\n\n", " "]).join(parts))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")
    got = {x.doc_id: x for x in L.scan(df, rules).collect()}
    for k, t in enumerate(rows):
        w = split(t)
        places, base = [], set()
        for phrase, label in L.PHRASES.items():
            p = phrase.split()
            hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += hits
            base |= {label} if hits else set()
        found = plain_labels(t, rules)
        x = got[k]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert x.base_labels == ",".join(sorted(base)) and x.labels == ",".join(sorted(base | set(found)))
        assert abs(x.score - (1.0 if base else max(found.values(), default=0.0))) < 1e-9


def test_words_spread_over_a_long_line_are_no_license(spark):
    far = " filler" * 30 + " licensed a under b the c apache" + " d" * 8 + " license e version f 2 g 0"
    near = " filler" * 30 + " Licensed under the Apache Software License Version 2.0"
    df = spark.createDataFrame([(1, far), (2, near)], "doc_id long, text string")
    assert {x.doc_id: x.labels for x in L.scan(df).collect()} == {1: "", 2: "apache"}


def test_tables(spark):
    df = spark.createDataFrame([(1, "MIT License", "a", 3), (1, "MIT License", "a", 3), (None, "mit license " * 100_000, None, None)], "doc_id long, text string, labels string, n_words int")
    got = sorted(((x.doc_id, x.n_base) for x in L.scan(df).collect()), key=str)
    assert got == [(1, 1), (1, 1), (None, 100_000)] and L.scan(df.limit(0)).count() == 0
