"""Hand-derived results of single operators."""

import pytest
from granary.functions import rules, text
from granary.operators import answer, chunking, html, index, retrieve
from granary.sources import crawl
from granary.streaming import events
from pyspark.sql import functions as F


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (text.normalize_text, "  N° 5  di\ttesto.... fin. config.", "Numero 5 di testo... finumero configurazione"),
        (text.estimate_tokens, "abc", 1),
        (text.anchor, "Come fare?", "come-fare"),
        (text.anchor, "Multiple   Spaces", "multiple-spaces"),
        (text.title_case, "o'neil 3d", "O'Neil 3D"),
        (text.breadcrumbs, "home/guida_iva//a-b", ["Home", "Guida Iva", "A B"]),
        (text.error_codes, "err-001 e WRN123, ERR-001", ["ERR-001", "WRN123"]),
        (text.clean_tags, "<b>a &amp;lt; b</b>", "a < b"),
        (text.ui_path, "Vai a: Archivi>Clienti. Fine", "Archivi > Clienti"),
        (text.split_sentences, "Prima frase lunga. Seconda frase lunga! coda senza fine", ["Prima frase lunga.", "Seconda frase lunga!"]),
        (text.clean_pdf_text, "Testo\x00con\x08caratteri\n123\n\nab\n--", "Testoconcaratteri ab"),
        (text.host_of, "https://www.Example.com:80/x", "example.com"),
        (rules.query_type, "errore ERR-001", "error"),
        (rules.query_type, "ERR-001", "general"),
        (rules.query_type, "come impostare il parametro IVA", "parameter"),
        (rules.query_type, "step per configurare il sistema", "procedure"),
        (rules.query_type, "come creare una fattura", "general"),
        (rules.param_name, "Parametro IVA: 22", "IVA"),
    ],
)
def test_functions(spark, f, given, expected):
    assert one(spark, f(F.col("t")), t=given) == expected


def test_urls(spark):
    ok = text.url_allowed(F.col("u"), ("example.com",))
    assert [one(spark, ok, u=u) for u in ("http://docs.example.com/a", "http://badexample.com", "http://localhost:80", "x", "http://172.20.1.1")] == [True, False, True, False, True]


def test_image_names_go_both_ways(spark):
    assert one(spark, text.image_file_stem(F.col("i")), i="abc_p2_i1") == "page_3_img_1"
    assert one(spark, text.image_id(F.lit("abc"), F.col("s")), s="page_3_img_1") == "abc_p2_i1"
    assert one(spark, text.image_file_stem(F.col("i")), i="abc") == ""


def test_fusion(spark):
    schema = "query_id long, doc_id long, score double, rank int"
    v = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.8, 2)], schema)
    x = spark.createDataFrame([(1, 2, 0.8, 1), (1, 3, 0.7, 2)], schema)
    got = [(r["doc_id"], round(r["score"], 6)) for r in retrieve.fused(v, x).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 0.933333), (3, 0.875)]


def test_diversify_is_the_greedy_rule(spark):
    rows = spark.createDataFrame([(1, i, "s", i) for i in range(1, 16)], "query_id long, doc_id long, section_path string, rank int")
    assert retrieve.diversified(rows).count() == 10


def test_quality_filter(spark):
    schema = "query_id long, rank int, score double, section_path string, n_images int"
    rows = spark.createDataFrame([(1, 1, 0.95, "a", 0), (1, 2, 0.4, "b", 0), (1, 3, 0.2, "c", 1)], schema)
    assert [r["score"] for r in answer.quality_filtered(rows).orderBy("rank").collect()] == [0.95, 0.2]


def test_confidence(spark):
    rows = spark.createDataFrame([(1, i, 0.9) for i in range(1, 5)], "query_id long, rank int, score double")
    got = answer.confidences(rows, F.lit("Risposta dettagliata con Fonti: [1][2][3]")).first()["confidence"]
    assert got == pytest.approx(0.672)


def test_packing_is_the_greedy_loop(spark):
    sizes = [30, 500, 900, 10, 3000, 700, 80, 80]
    parts = ["x" * n for n in sizes]
    want, used = [], 0
    for p in parts:
        t = max(1, len(p) // 4)
        if want and used + t <= 300:
            want[-1], used = want[-1] + "\n\n" + p, used + t
        else:
            want.append(p)
            used = t
    df = spark.createDataFrame([(parts,)], "p array<string>")
    assert df.select(chunking.packed(F.col("p"), 300).alias("x")).first()["x"] == want


def test_overlap_and_tables(spark):
    df = spark.createDataFrame([(["Una frase di prova lunga.", "Altro pezzo di testo qui."],)], "c array<string>")
    got = df.select(chunking.overlapped(F.col("c"), 50).alias("x")).first()["x"]
    assert got == ["Una frase di prova lunga.", "[...continua] Una frase di prova lunga.\n\nAltro pezzo di testo qui."]
    table = "| h |\n| --- |\n" + "\n".join(f"| {i} |" for i in range(30))
    rows = chunking.table_chunks(spark.createDataFrame([(1, table)], "k int, t string"), "k", "t").collect()
    assert sorted(len(r["content"].split("\n")) for r in rows) == [7, 27]


def test_replace_by_url(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "source_url string, v int")
    new = spark.createDataFrame([("a", 3)], "source_url string, v int")
    assert sorted(map(tuple, index.replace_by_url(old, new).collect())) == [("a", 3), ("b", 2)]


def test_html_sections():
    body = "parola " * 30
    page = f"<html><body><nav>via</nav><h1>Uno</h1><p>{body}<h2>Due</h2><table><tr><th>a|b</th></tr><tr><td>1</td></tr></table><img src='/x.png' alt='foto'><p>{body}</body></html>"
    got = html.page_sections(page, "http://e.com/d/")
    assert [(s["title"], s["level"]) for s in got] == [("Uno", 1), ("Due", 2)]
    assert got[1]["tables"] == ["| a\\|b |\n| --- |\n| 1 |"] and got[1]["figures"][0]["src"] == "http://e.com/x.png"
    assert "via" not in got[0]["content"] and "[Figura: foto]" in got[0]["content"]


def test_sitemap(spark):
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>http://e.com/1</loc></url><url><loc>http://e.com/2</loc></url></urlset>'
    assert [r["url"] for r in crawl.sitemap_urls(spark.createDataFrame([(xml,)], "xml string")).collect()] == ["http://e.com/1", "http://e.com/2"]


def test_stream_gives_the_batch_result(spark):
    folder = "/root/testdata/sf0.001"
    query = events.tumbling(events.read_stream(spark, folder, "events.parquet")).writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(str, spark.table("tumbled").collect())) == sorted(map(str, events.tumbling(spark.read.parquet(f"{folder}/events.parquet")).collect()))


def test_incremental_ingest(spark, tmp_path):
    got = []
    stream = events.read_stream(spark, "/root/testdata/sf0.001", "pages.parquet")
    events.ingest(stream, lambda df, n: got.append(df.count()), str(tmp_path / "c")).awaitTermination()
    assert sum(got) == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()


def test_deeply_nested_pages_are_read():
    from granary.operators.html import page_sections

    deep = "<div>" * 5000 + "<h1>Titolo</h1><p>" + "testo " * 40 + "</p>" + "</div>" * 5000
    assert [x["title"] for x in page_sections(deep, "http://x/")] == ["Titolo"]
    table = "<h1>T</h1><p>" + "testo " * 40 + "</p><table><tr><th>a</th></tr><tr><td>" + "<b>" * 3000 + "x|y</td></tr></table>"
    assert page_sections(table, "")[0]["tables"] == ["| a |\n| --- |\n| x\\|y |"]
