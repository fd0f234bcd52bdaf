"""Landed files as streams: new files only, unparsed payloads aside, a batch that is run again."""

import json

from newslake.sources import landing
from newslake.streaming import landed


def payload(*ids):
    return json.dumps({"articles": [{"title": f"T{i}", "url": f"u{i}", "content": "", "description": f"d{i}", "source": {"name": "S"}, "publishedAt": "2024-01-05T00:00:00Z"} for i in ids]})


def test_each_file_is_read_once(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    source.mkdir()
    run = lambda: landed.append_new_files(landed.news(spark, str(source), "N"), out, checkpoint)
    (source / "a.json").write_text(payload(1, 2) + "\n{broken\n" + payload(3) + "\n" + json.dumps({"articles": [{"title": "", "url": "x"}]}))
    run()
    (source / "b.json").write_text(payload(4))
    (source / "a.json").write_text(payload(9))  # an old file is not read again
    run()
    run()
    got = spark.read.parquet(out)
    assert sorted(r.url for r in got.collect()) == ["u1", "u2", "u3", "u4"] and landed.BAD not in got.columns
    assert [r[0] for r in spark.read.parquet(f"{out}-bad").select(landed.BAD).collect()] == ["{broken"]
    batches = {r.batch for r in got.select("batch").distinct().collect()}
    assert len(batches) == 2
    want = {(r.title, r.content, r.source_name, r.published_at) for r in landing.news_json(spark, str(source / "b.json"), "N").collect()}
    assert want == {(r.title, r.content, r.source_name, r.published_at) for r in got.where("url = 'u4'").collect()}


def test_items(spark, tmp_path):
    source = tmp_path / "items"
    source.mkdir()
    for k in range(2):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"id": 10 * k + i, "type": ("story", "job")[i], "url": f"u{k}", "text": "x", "time": 5}) for i in range(2)))
        landed.append_new_files(landed.items(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "c"))
    assert sorted(r.item_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 10]
