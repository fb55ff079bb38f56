"""Admission by rate limit and interval joins against plain loops."""

import random
from datetime import UTC, datetime, timedelta

from granary.operators import analytics, index, models
from granary.sources import crawl


def test_admission_is_a_plain_queue(spark):
    rng, begin = random.Random(2), datetime(2024, 1, 1, tzinfo=UTC)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), begin + timedelta(seconds=rng.randint(0, 900))) for i in range(600)] + [(1000, "a", None)]
    calls = spark.createDataFrame(rows, "id long, key string, ts timestamp").repartition(5)
    got = {r["id"]: r["start"] for r in analytics.admitted(calls, "key", "ts", 4, 30.5, "id").collect()}
    plain = {r["id"]: r["ts"] for r in calls.collect()}
    for key in ("a", "b", None):
        starts = []
        for _, t, i in sorted((plain[i] is None, plain[i] or begin, i) for i, k, _ in rows if k == key and plain[i] is not None):
            at = max([t, *starts[-1:], *([starts[-4] + timedelta(seconds=30.5)] if len(starts) >= 4 else [])])
            starts.append(at)
            assert got[i] == at
    assert got[1000] is None and len(got) == len(rows)


def test_binned_interval_join_is_the_plain_one(spark):
    rng = random.Random(3)
    items = [(rng.choice(["d", "e", None]), i, rng.choice([None, 0, *range(1, 200)])) for i in range(400)]
    sections = [(rng.choice(["d", "e", "f"]), i, (a := rng.randint(0, 190)), a + rng.randint(-2, 70)) for i in range(120)]
    found = index.covering_sections(spark.createDataFrame(items, "doc string, item long, page int"), spark.createDataFrame(sections, "doc string, section_pos long, page_start int, page_end int"), "doc", "page")
    want = sorted((d, i, p, s) for d, i, p in items for e, s, a, b in sections if d is not None and d == e and p and a <= p <= b)
    assert sorted((r["doc"], r["item"], r["page"], r["section_pos"]) for r in found.collect()) == want


def test_one_long_document_meets_only_pages_nearby(spark):
    """100,000 pages with a section each: the join's input rows grow with the pages, not with their square."""
    items = spark.range(1, 100_001).selectExpr("'d' as doc", "id as item", "id as page")
    sections = spark.range(1, 100_001).selectExpr("'d' as doc", "id as section_pos", "id as page_start", "id + 1 as page_end")
    assert index.covering_sections(items, sections, "doc", "page").count() == 199_999


def test_a_model_that_fails_above_a_size_gives_every_row_once(spark):
    def load():
        seen = []

        def run(texts):
            seen.append(len(texts))
            if len(texts) > 5 or len(seen) == 3:
                raise MemoryError
            return [float(len(t[0])) for t in texts]

        return run

    rows = spark.createDataFrame([(i, "x" * (i * 37 % 50) if i % 11 else None) for i in range(300)], "id long, text string").repartition(3)
    got = sorted((r["id"], r["n"]) for r in models.modelled(rows, ("text",), load, "n", most=64).collect())
    assert got == [(i, float(i * 37 % 50 if i % 11 else 0)) for i in range(300)]
    assert models.modelled(rows.limit(0), ("text",), load, "n").count() == 0


def test_a_split_and_replayed_stream_is_the_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, f"http://h/{rng.randint(0, 40)}", rng.choice(["uno", "due", "tre ", " tre", "x" * rng.randint(1, 60)]), rng.choice(["text/html", "image/png"])) for i in range(300)] + [(400, None, "uno", "text/html"), (401, "http://h/new", None, "text/html")]
    schema = "page_id long, url string, content string, content_type string"
    want = sorted(r["page_id"] for r in crawl.crawled(spark.createDataFrame(rows, schema)).collect())
    for i in range(4):  # parts in order, the second one again at the end
        spark.createDataFrame(rows[i * 100 : i * 100 + 100] if i < 3 else rows[100:200], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        found = crawl.crawl_into(stream, str(tmp_path / "to"))
    got = sorted(r["page_id"] for r in found.collect())
    first = [p for p in want if p < 300]
    assert [p for p in got if p < 300] == first and len(got) == len(set(got))
