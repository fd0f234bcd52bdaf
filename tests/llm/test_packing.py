"""Ids of packed texts against the tokenizer's own, over texts that are plain and texts that are not; padding; odd tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from newslake.llm import packing

PARTS = [
    "'s", "'ll", "'RE", "'d", "don't", "a", "B", "é", "É", "ß", "ÿ", "×", "ª", "µ", "Σ", "ΑΣ", "İ", "1", "23", "½", "  ", "\t", "\n", "\r", "\x0b", "\x85", "\xa0", "!", "?!", "#$%",
    "ﬁ", "é", "́", "中文", "😀", "The", "Ciónllesra", "<|endoftext|>", "<|x", "'", "’s", "\x1c", "\x00", "\x7f", "ÀÖØöø", "aí",
]


@pytest.mark.parametrize("most", [3, 250_000])
def test_ids_are_the_tokenizers(most, monkeypatch):
    monkeypatch.setattr(packing, "_TEXT_BYTES", 50)
    r = random.Random(4)
    rows = ["".join(r.choice(PARTS) for _ in range(r.randrange(16))) for _ in range(1500)] + [None, "", " "]
    rows += [" ".join(r.choice(PARTS) for _ in range(300)) for _ in range(20)] + ["é" * 3000, "ab " * 30_000]
    tok, path = Tokenizer.from_file(packing.default_tokenizer()), packing.default_tokenizer()
    encoder = packing.Encoder(path, most)
    for a in range(0, len(rows), 400):
        some = rows[a : a + 400]
        for text, got in zip(some, encoder.ids(pa.array(some, pa.string())), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tok.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert sum(map(len, encoder.memos)) <= most + 400 * 16


def test_little_padding_and_histograms():
    r = random.Random(2)
    for size in (8, 64, 4096):
        for _ in range(20):
            histogram = {r.randint(1, size): r.randint(1, 300) for _ in range(r.randint(0, 40))}
            places = packing.shortest_pack_first(histogram, size)
            used, seen = {}, {}
            for length, rank, n, first, offset in places:
                assert rank == seen.get(length, 0)
                seen[length] = rank + n
                for k in range(first, first + n):
                    assert used.get(k, 0) == offset
                    used[k] = offset + length
            assert seen == histogram and all(x <= size for x in used.values())
            total = sum(k * n for k, n in histogram.items())
            # of any two open packs the pieces of one would not have fitted the other, so all but one are over half full
            assert sum(x <= size // 2 for x in used.values()) <= 1 and len(used) <= 2 * total / size + 1


def test_equal_ids_repeats_and_clashing_names(spark):
    rows = [(1, "one two"), (1, "one two"), (1, "three"), (None, "x"), (None, None), (2, "long " * 9000)] + [(k, f"w{k} " * (k % 50)) for k in range(400)]
    df = spark.createDataFrame([(i, t, 7, "b", "c") for i, t in rows], "doc_id long, text string, length int, bucket string, start string")
    got = packing.pack(df).collect()
    assert sum(x.start == 0 for x in got) == len(rows)
    ends = {}
    for x in got:
        ends.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(x.length for x in got)
    assert len(ends) * 4096 - total < 4096 + 0.01 * total  # little padding
