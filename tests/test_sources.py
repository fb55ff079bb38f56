"""Folders, question files, sinks, the default embedder, prompts, duplicates within a watermark."""

import json
from datetime import datetime, timedelta

import pytest
from granary.functions import text
from granary.operators import answer, retrieve
from granary.sources import crawl, tables
from granary.streaming import events as streams
from pyspark.sql import functions as F


def test_folders_of_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name, body in (("a/x.html", "<p>è</p>"), ("a/b/y.htm", "<p>due</p>"), ("a/z.pdf", "%PDF"), ("a/n.txt", "no")):
        (tmp_path / name).write_text(body, encoding="utf-8")
    found = {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]).decode() for r in crawl.folder(spark, str(tmp_path)).collect()}
    assert found == {"x.html": "<p>è</p>", "y.htm": "<p>due</p>", "z.pdf": "%PDF"}
    assert sorted(r["html"] for r in crawl.html_files(spark, str(tmp_path)).collect()) == ["<p>due</p>", "<p>è</p>"]


def test_question_files_and_url_lists(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"query": "errore 5", "expected_type": "error", "category": "c", "other": 1}, {"query": "come"}], indent=1), encoding="utf-8")
    assert [tuple(r) for r in crawl.questions(spark, str(tmp_path / "q.json")).collect()] == [("errore 5", "error", "c"), ("come", None, None)]
    rows = spark.createDataFrame([(" http://a \r\n\n\t\nhttp://b",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.url_list(F.col("t"))).collect()] == [["http://a", "http://b"], [], None]


def test_sinks(spark, tmp_path):
    first = spark.createDataFrame([(1, "m1"), (2, "m2")], "id long, module string")
    tables.write_partitions(first, str(tmp_path / "p"), "module")
    tables.write_partitions(spark.createDataFrame([(3, "m2")], first.schema), str(tmp_path / "p"), "module")
    assert sorted((r["id"], r["module"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [(1, "m1"), (3, "m2")]
    tables.write_json(first, str(tmp_path / "j"))
    tables.write_json(first.filter("id = 1"), str(tmp_path / "j"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "j")).collect()] == [(1, "m1")]


def test_default_embedder(spark):
    rows = spark.createDataFrame([("alpha beta",), ("beta ALPHA",), ("gamma",), ("",)], "t string")
    a, b, c, none = (r[0] for r in rows.select(retrieve.embed(F.col("t"))).collect())
    assert a == b and len(a) == 64 and sum(x * x for x in a) == pytest.approx(1) and sum(x * y for x, y in zip(a, c, strict=True)) < 0.8 and set(none) == {0.0}


def test_prompts(spark):
    rows = spark.createDataFrame([("error", "ERR-1?", "uno"), ("general", "che cosa?", "due")], "kind string, q string, c string")
    got = [r[0] for r in rows.select(answer.prompt(F.col("kind"), F.col("q"), F.col("c"))).collect()]
    assert got == [f"{answer.SYSTEM_PROMPTS[k]}\n\nDomanda: {q}\n\nContesto:\n{c}" for k, q, c in (("error", "ERR-1?", "uno"), ("general", "che cosa?", "due"))]


def test_duplicates_within_a_watermark(spark, tmp_path):
    begin = datetime(2024, 5, 1, 12)
    rows = [(i % 40, begin + timedelta(minutes=i)) for i in range(60)]
    for k in range(2):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], "event_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("event_id long, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.unique_events(stream, "event_id", "2 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = [r["event_id"] for r in spark.read.schema("event_id long, ts timestamp").parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == list(range(40))
