"""The pipeline's rows on a small fixture against a brute-force version of its stages."""

import random
import re

import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from newslake.llm import packing
from newslake.llm.quality_rules import Bands, compression


def test_pipeline(spark, tmp_path):
    r = random.Random(3)
    pool = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(pool) for _ in range(n))
    rows = [prose(r.randint(15, 80)) for _ in range(30)]
    rows += [rows[3], rows[5] + " tail", None, "", "same words again " * 60, rows[7] + ' token = "0123456789abcdef0123456789abcdef" end']
    items = [rows[9][:200], "few words"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    press = zstandard.ZstdCompressor(level=Bands().level)
    kept = []
    for i, t in enumerate(rows):
        w = (t or "").split()
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        cover = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
        if len(w) >= 20 and 100 * len(cover) <= 30 * len(w) and not compression(t.encode(), Bands(), press)[3]:
            kept.append(i)
    sets = {i: {tuple(rows[i].split()[k : k + 5]) for k in range(len(rows[i].split()) - 4)} for i in kept}
    first = [i for i in kept if not any(j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in kept)]
    windows = [x.split() for x in items]
    windows = [w[k : k + min(10, len(w))] for w in windows for k in range(len(w) - min(10, len(w)) + 1)]
    clean = [i for i in first if not any(rows[i].split()[k : k + len(w)] == w for w in windows for k in range(len(rows[i].split())))]
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = {i: len(tok.encode(re.sub(r'token = "[0-9a-f]{32}', "[SECRET]", rows[i]), add_special_tokens=False).ids) + 1 for i in clean}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id: x.doc_tokens for x in got} == want and 9 not in want and 30 not in want
