"""Ingest verdicts against a sequential fold over the rows."""

import random
import re

import pytest

from newslake import config
from newslake.operators import dedupe

SCHEMA = "article_id long, title string, content string, source_url string"


def bucket(title):
    w = [x for x in re.sub(r"[^\w\s]", "", title.lower(), flags=re.A).split() if len(x) > 2 and x not in config.BUCKET_STOPS]
    return w[0] if w else title[:5].lower()


def words(title):
    return {x for x in re.sub(r"[^\w\s]", "", title.lower(), flags=re.A).split() if len(x) > 2}


def near(a, b):
    x, y = words(a), words(b)
    return bucket(a) == bucket(b) and bool(x and y) and len(x & y) / len(x | y) >= 0.85


def fold(batch, store):
    """The service's loop: only stored rows shadow later ones."""
    out, held = {}, [(True, *r) for r in sorted(store)]
    for i, title, content, url in sorted(batch):
        body = lambda t, c: (" ".join(re.sub(r"[^\w\s]", "", t.lower()).split()), c[:500])
        hits = {
            "url": [(not s, j) for s, j, _, _, u in held if u == url],
            "content": [(not s, j) for s, j, t, c, _ in held if body(t, c) == body(title, content)],
            "title": [(not s, j) for s, j, t, _, _ in held if near(t, title)],
        }
        kind = next((k for k, v in hits.items() if v), "none")
        if kind == "none":
            held.append((False, i, title, content, url))
            out[i] = ("none", None, None)
        else:
            in_batch, j = min(hits[kind])
            out[i] = (kind, j, in_batch)
    return out


def run(spark, batch, store):
    frame = lambda rows: dedupe.keyed(spark.createDataFrame(rows, SCHEMA))
    return {r.article_id: (r.match_type, r.matched_id, r.in_batch) for r in dedupe.verdicts(frame(batch), frame(store) if store is not None else None).collect()}


A, B = "Alpha beta gamma delta epsilon zeta eta theta", "Alpha beta gamma delta epsilon zeta eta"


def test_a_rejected_row_shadows_nothing(spark):
    batch = [(1, A, "a", "https://s.com/1"), (2, B, "b", "https://s.com/2"), (3, "Another story of other things", "c", "https://s.com/2"), (4, "Another story, of other things!", "c", "https://s.com/4")]
    assert run(spark, batch, None) == {1: ("none", None, None), 2: ("title", 1, True), 3: ("none", None, None), 4: ("content", 3, True)}


def test_match_kind_is_that_of_the_final_store(spark):
    # 3 is rejected for its title in the first round, and matches the URL of 2, which is stored in the second
    batch = [(0, "Zulu one", "z", "https://s.com/z"), (1, "Yankee two", "y", "https://s.com/z"), (2, "Xray three", "x", "https://s.com/x"), (3, A, "q", "https://s.com/x"), (4, B, "q", "https://s.com/4")]
    got = run(spark, batch, [(9, A, "old", "https://old.com")])
    assert got[1] == ("url", 0, True) and got[3] == ("url", 2, True) and got[4] == ("title", 9, False)


@pytest.mark.parametrize("seed", range(4))
def test_verdicts_equal_the_fold(spark, seed):
    r = random.Random(seed)
    heads = ["Alpha", "Beta", "the x"]
    tail = [f"word{i}" for i in range(9)]

    def title():
        if r.random() < 0.1:
            return r.choice(["", "ab", "it"])
        w = list(tail)
        if r.random() < 0.6:
            w[r.randrange(9)] = f"other{r.randrange(3)}"
        if r.random() < 0.5:
            w.pop(r.randrange(9))
        return " ".join([r.choice(heads), *w])

    def rows(n, first):
        return [(first + i, title(), f"text {r.randrange(40)}", f"https://s.com/{r.randrange(n)}") for i in range(n)]

    batch, store = rows(80, 0), rows(6, 30)  # the store's ids lie among the batch's
    assert run(spark, batch, store if seed % 2 else None) == fold(batch, store if seed % 2 else [])


def test_chain(spark):
    """Each row conflicts with the one before alone, by URL and by title in turn: every second one is stored."""
    base = lambda i: [f"s{i + 9}x"] + [f"w{k}of{i + 9}" for k in range(7)]
    batch = [(i, " ".join(base(i) if i % 2 else base(i - 1)[:7]), f"text {i}", f"https://s.com/{i // 2}") for i in range(16)]
    got = run(spark, batch, None)
    assert got == fold(batch, [])
    assert [got[i][:2] for i in range(16)] == [("url", i - 1) if i % 2 else ("none", None) for i in range(16)]


def test_empty(spark):
    assert run(spark, [], None) == {} == run(spark, [], [(1, A, "a", "u")])
