"""The minimum cut of whole pages: against all labellings, on pages without marks, and on odd tables."""

import itertools
import random

import numpy as np
import pytest

from newslake.llm import html_extract as H


def marked_page(r, lengths=(2, 15, 20, 30, 60, 90)):
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n)).capitalize() + "."
    links = "".join(f"<li><a href=/{k}>{prose(1)}</a></li>" for k in range(r.randint(4, 7)))
    body = "".join(f"<p>{prose(r.choice(lengths))}</p>" for _ in range(r.randint(3, 8)))
    return f"<html><head><title>t</title></head><body><nav><ul>{links}</ul></nav><div class=ad>{prose(9)}</div><article><h1>{prose(5)}</h1>{body}</article><footer>&copy; {prose(6)}</footer>"


@pytest.fixture(scope="module")
def odds(spark):
    r = random.Random(1)
    pages = spark.createDataFrame([(k, marked_page(r), "x") for k in range(300)], "page_id long, html string, cell string")
    return H.train(pages)


def test_labels_are_the_least_costly_of_all(odds):
    """Every labelling of small pages is tried; costs are recomputed here from the blocks."""
    r, costs = random.Random(2), H.Costs()
    tags = ("p", "li", "div", "h2", "section")
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 7)):
            tag, words = r.choice(tags), "word " * r.choice((1, 5, 20, 100))
            parts.append(f"<{tag}>{'<a href=x>' + words + '</a>' if r.random() < 0.3 else words}</{tag}>")
            if r.random() < 0.3:
                parts.append("</div>" if r.random() < 0.5 else "<div>")
        blocks = H.blocks_of("".join(parts))
        said = [r.choice((0.0, 0.0, 1.5, 2.5, -3.0, -6.0)) for _ in blocks]

        def cost(labels):
            total, last = 0.0, {}
            for i, ((text, linked, e), mark, label) in enumerate(zip(blocks, said, labels, strict=True)):
                net = mark + np.clip(odds[H.cell_of(text, linked, e)], -costs.most, costs.most)
                total += max(net, 0) if not label else max(-net, 0)
                parent = e.parent.n
                if i:
                    b = blocks[i - 1][2]
                    w = costs.near if b.parent.n == parent else costs.near / 2 if b.n == parent or b.parent.n == e.n else costs.near / 4
                    total += w * (labels[i - 1] != label)
                if parent in last and last[parent] != i - 1:
                    total += costs.sibling * (labels[last[parent]] != label)
                last[parent] = i
            return total

        assert cost(H.labelled(blocks, said, odds)) == pytest.approx(min(cost(x) for x in itertools.product([False, True], repeat=len(blocks))))


def test_cut_mends_the_classifier_where_marks_are_hidden(spark):
    r, lengths = random.Random(1), (2, 30, 60, 90)
    odds = H.train(spark.createDataFrame([(k, marked_page(r, lengths), "x") for k in range(300)], "page_id long, html string, cell string"))
    r = random.Random(3)
    alone = cut = changed = n = 0
    for _ in range(200):
        blocks = H.blocks_of(marked_page(r, lengths))
        truth = [m > 0 for m in H.marks(blocks)]
        own = [odds[H.cell_of(*b)] >= 0 for b in blocks]
        with_cut = H.labelled(blocks, [0] * len(blocks), odds)
        n += len(blocks)
        alone += sum(a == t for a, t in zip(own, truth, strict=True))
        cut += sum(a == t for a, t in zip(with_cut, truth, strict=True))
        changed += sum(a != b for a, b in zip(own, with_cut, strict=True))
    assert changed > 0 and cut > alone and cut / n > 0.95


def test_page_without_marks(odds):
    long_text = "A sentence of some length that goes on and on for the story. " * 4
    page = f"<body><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul><div><p>{long_text}</p><p>Yes.</p><p>{long_text}</p></div>"
    assert H.main_text(page, odds) == f"{long_text.strip()} Yes. {long_text.strip()}"
    side = "<main><div class='side-by-side'><p>Text in two columns.</p></div></main>"
    assert H.main_text(side, odds) == "Text in two columns."


def test_tables(spark, odds):
    names = "page_id long, url string, html string, text string, n_chars string, cell int"
    long_page = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    rows = [(1, "u", "<article><p>a &lt; b</article>", "t", "n", 1)] * 2 + [(1, None, "<article><p>c</article>", None, None, None), (None, "v", None, "t", "n", 2), (5, "l", long_page, "", "", 0)]
    df = spark.createDataFrame(rows, names)
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in H.extract(df).collect()), key=str)
    assert [x for x in got if x[0] != 5] == sorted([(1, "u", "a < b", 5)] * 2 + [(1, None, "c", 1), (None, "v", "", 0)], key=str)
    assert next(x for x in got if x[0] == 5)[2] == " ".join(["word"] * 20_000)
    assert H.extract(df.limit(0)).count() == 0 and H.extract(df).columns == ["page_id", "url", "text", "n_chars"]
    assert (H.train(df.limit(0)) == 0).all()


STORY = "The council met on Tuesday evening and spoke at length about the bridge, its cost and the years that it will take. "
LINKS = "<ul>" + "".join(f"<li><a href=/{k}>More about {k}</a></li>" for k in ("roads", "rivers", "towns", "trade", "trains")) + "</ul>"
#: (page, its main text), labelled by hand.
BY_HAND = [
    (f"<body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Bridge</h1><p>{STORY}</p>{LINKS}<p>{STORY}</p></article></body>", f"Bridge {STORY}{STORY}"),
    (f"<body><article><div class='entry-header'><h1>Bridge</h1></div><p>{STORY}</p></article></body>", f"Bridge {STORY}"),
    (f"<body><main><h1>Bridge</h1><p>{STORY}</p><p>Yes.</p><p>{STORY}</p><section class='more-stories'><article>{LINKS}</article></section></main></body>", f"Bridge {STORY}Yes. {STORY}"),
    (f"<body><main><div class='tabs'>{LINKS}</div><h1>Bridge</h1><p>{STORY}</p></main></body>", f"Bridge {STORY}"),
    (f"<body><div class='post'><p>{STORY}</p>{LINKS}</div></body>", STORY),
    (f"<body><div><h1>Bridge</h1><p>{STORY}</p></div>{LINKS}<p>&copy; The paper</p></body>", f"Bridge {STORY}"),
    (f"<body><article><p>{STORY}</p><ul><li>the cost</li><li>the years it takes.</li></ul><p class='ad'>{STORY}</p><p>{STORY}</p></article></body>", f"{STORY}the cost the years it takes. {STORY}"),
]


def test_the_cut_overrules_marks_of_pages_labelled_by_hand(odds):
    flat = lambda x: " ".join(x.split())
    by_marks = changed = 0
    for page, truth in BY_HAND:
        assert H.main_text(page, odds) == flat(truth)
        blocks = H.blocks_of(page)
        said = H.evidence_of(blocks, H.Costs())
        by_marks += flat(" ".join(b[0] for b, x in zip(blocks, said, strict=True) if x >= 0)) == flat(truth)
        changed += sum((x >= 0) != y for x, y in zip(said, H.labelled(blocks, said, odds), strict=True))
    assert changed >= 20 and by_marks <= 2  # of seven pages


def test_pages_without_marks_or_training(spark):
    bare = "<body><div><h1>Title</h1><p>Some text of the page.</p></div></body>"
    assert H.main_text(bare) == "Title Some text of the page."
    df = spark.createDataFrame([(1, "u", bare)], "page_id long, url string, html string")
    assert H.extract(df).first().text == "Title Some text of the page."
    head = "<article><div class=\"entry-header\"><h1>Title</h1></div><p>Text.</p></article>"
    assert H.main_text(head) == "Title Text."


def test_ties_of_a_cut_are_content():
    assert H.min_cut([0.0, 0.0], [(0, 1, 1.0)]) == [True, True]
    # both labels of the middle cost the same
    assert H.min_cut([5.0, 0.0, -5.0], [(0, 1, 1.0), (1, 2, 1.0)]) == [True, True, False]
    assert H.min_cut([0.5, -0.5, 0.5, -0.5], [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)]) == [True] * 4
