"""Stored indexes and tables: recall, pruning, batches through a stream, replaced and deleted URLs, killed writes."""

import pytest
from granary.operators import lexical, retrieve
from granary.operators.stored_lexical import LexicalIndex
from granary.operators.url_table import UrlTable
from granary.operators.vector_index import VectorIndex
from granary.plans.stored import vector_index_topk
from granary.sources.store import Versions
from granary.streaming import events as streams
from pyspark.sql import functions as F

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def recall(want, got):
    least = {}
    for r in want:
        least[r["query_id"]] = min(least.get(r["query_id"], 2), r["score"])
    return sum(r["score"] >= least[r["query_id"]] - 1e-6 for r in got) / len(want)


def test_vector_index_recall(spark):
    v = spark.read.parquet(f"{LARGER}/embeddings.parquet")
    want = retrieve.dense_topk(v.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), v, 10).collect()
    got = vector_index_topk(spark, LARGER).collect()
    assert recall(want, got) >= 0.9
    exact = {(r["query_id"], r["vec_id"]): r["score"] for r in want}
    assert all(abs(exact[k] - r["score"]) < 1e-5 for r in got if (k := (r["query_id"], r["vec_id"])) in exact)


def test_vector_index_reads_probed_cells_and_keeps_the_last_row(spark, tmp_path):
    rows = [(i, [1.0 + i / 100, 0.0, 0.1], i % 2) for i in range(40)] + [(100 + i, [0.0, 1.0 + i / 100, 0.2], i % 2) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    index = VectorIndex(spark, str(tmp_path))
    index.fit(v, cells=2, subspaces=2)
    index.add(v.unionByName(spark.createDataFrame([(None, [1.0, 0.0, 0.0], 0), (900, None, 0), (901, [1.0], 0)], v.schema)))
    index.add(spark.createDataFrame([(0, [0.0, 1.0, 0.0], 1)], v.schema))
    assert index.rows().count() == 80
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.1]), (2, [0.0, 1.0, 0.0])], "query_id long, embedding array<float>")
    got = index.search(asked, 3, 1, 80, most_rows=8, most_asked=1)
    found = {(r["query_id"], r["rank"]): r["vec_id"] for r in got.collect()}
    assert found[2, 1] == 0 and {q for q, _ in found} == {1, 2} and 0 not in {i for (q, _), i in found.items() if q == 1}
    assert {r["vec_id"] % 2 for r in index.search(asked, 3, 1, where={"label": {"min": 1, "max": 1}}).collect() if r["vec_id"]} == {1}
    one = index.rows([index.probed(asked.limit(1), index.model(index.versions.current()[1]["model"]), 1).first()["cell"]])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def same_top(index, asked, chunks, fields, fuzzy=False):
    got = [tuple(r) for r in index.search(asked, 10, fields, fuzzy).select("query_id", "rank", "doc_id", "score").orderBy("query_id", "rank").collect()]
    every = lexical.lexical_search(asked, chunks, boosts=fields, fuzzy=fuzzy).withColumn("score", F.round("score", 6))
    assert got == [tuple(r) for r in retrieve.top(every, 10).select("query_id", "rank", "doc_id", "score").orderBy("query_id", "rank").collect()]
    assert got


def test_batches_of_a_stream_give_the_index_of_all(spark, tmp_path):
    part = spark.read.parquet(f"{FOLDER}/part.parquet").filter("p_partkey < 120")
    chunks = part.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("u"), F.col("p_partkey") % 20).alias("source_url"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_brand").alias("content"), F.upper("p_brand").alias("error_code"))
    asked = part.filter("p_partkey % 9 = 0").select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 2 == 0, F.lower("p_brand")).otherwise(F.col("p_name")).alias("query"))
    old = chunks.withColumn("title", F.lit("vecchio titolo")).withColumn("doc_id", F.col("doc_id") + 5000)
    steps = [old.filter("doc_id % 3 = 0"), chunks.filter("doc_id % 20 < 8").unionByName(old.filter("doc_id % 20 >= 18")), chunks.filter("doc_id % 20 >= 8")]
    for i, step in enumerate(steps):
        step.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    index, fields = LexicalIndex(spark, str(tmp_path / "index"), ("title", "content"), shelves=2), {"title": 1.4, "content": 1.0}
    for i in range(3):  # one file a batch, in order
        batch = spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "in" / f"b{i}"))
        for _ in range(2):  # a batch that comes twice is stored once
            streams.ingest(batch, lambda df, n, i=i: index.add(df, batch=f"{i}-{n}"), str(tmp_path / f"check-{i}-{_}")).awaitTermination()
    assert len(index.versions.current()[1]["segments"]) == 3
    same_top(index, asked, chunks, fields)
    same_top(index, asked, chunks, fields, fuzzy=True)
    index.add(None, deleted=spark.createDataFrame([("u3",), ("u4",)], "source_url string"))
    left = chunks.filter("source_url not in ('u3', 'u4')")
    same_top(index, asked, left, fields)
    index.compact()
    assert index.vacuum() == 4 and len(index.versions.current()[1]["segments"]) == 1
    same_top(index, asked, left, fields)


def test_bounds_leave_more_postings_unread_as_the_table_grows(spark, tmp_path):
    """Ten times the documents: postings grow tenfold, those read by far less; the rows are those of scoring all."""
    asked = spark.createDataFrame([(1, "raro comune"), (2, "comune")], "query_id long, query string")
    read = {}
    for n in (500, 5000):
        rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("u"), F.col("id")).alias("source_url"), F.concat(F.lit("comune "), F.when(F.col("id") % 250 == 0, F.lit("raro comune ")).otherwise(F.lit("")), F.repeat(F.lit("testo "), (F.col("id") % 40).cast("int"))).alias("content"))
        index = LexicalIndex(spark, str(tmp_path / str(n)), ("content",), shelves=2)
        index.add(rows)
        got, counts = index.found(asked, 2, {"content": 1.0}, code_boost=None, first=4)
        every = retrieve.top(retrieve.bm25(asked, rows.select("doc_id", F.col("content").alias("text"))).withColumn("score", F.round("score", 6)), 2)
        assert sorted(map(tuple, got.select("query_id", "doc_id", "rank").collect())) == sorted(map(tuple, every.select("query_id", "doc_id", "rank").collect()))
        total = counts.agg(F.sum("n_postings"), F.sum("n_read")).first()
        read[n] = total[0], total[1]
    assert read[5000][0] > 9 * read[500][0] and read[5000][1] < 4 * read[500][1] < read[500][0] * 4


def test_a_replace_writes_its_buckets_and_a_killed_write_nothing(spark, tmp_path, monkeypatch):
    old = spark.range(2000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("u"), F.col("id") % 1000).alias("source_url"), F.lit("old").alias("content"))
    table = UrlTable(spark, str(tmp_path), buckets=128)
    table.replace(old.unionByName(spark.createDataFrame([(9000, None, "no url"), (9001, "", "no url")], old.schema)))
    new = spark.range(10).select((F.col("id") + 5000).alias("chunk_id"), F.concat(F.lit("u"), F.col("id")).alias("source_url"), F.lit("new").alias("content"))
    assert table.replace(new) <= 10  # 1 % of the URLs, at most 10 of 128 buckets
    assert table.rows().groupBy("content").count().sort("content").collect() == [("new", 10), ("no url", 2), ("old", 1980)]
    monkeypatch.setattr(Versions, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):  # killed after its rows are written, before the commit
        table.replace(old.withColumn("content", F.lit("killed")))
    monkeypatch.undo()
    assert {r[0] for r in table.rows().select("content").distinct().collect()} == {"new", "old", "no url"}
    assert table.delete(new.select("source_url")) <= 10 and table.rows().filter("content = 'new'").isEmpty()
    before = table.rows().count()
    assert table.vacuum() > 0 and table.rows().count() == before


def test_of_two_writers_one_fails(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    assert versions.current() == (0, {})
    assert versions.commit(0, {"a": 1}) == 1
    with pytest.raises(RuntimeError, match="another writer"):
        versions.commit(0, {"a": 2})
    assert versions.current() == (1, {"a": 1})
