"""Hand-derived results of chunks by type, ingest, images and answers."""

import time

import pytest
from granary.functions.text import split_sentences
from granary.operators import answer, chunking, images, index, ingest
from granary.plans.documents import text_of
from pyspark.sql import functions as F


def pieces(spark, kind, text):
    rows = spark.createDataFrame([("s", kind, text, "t")], "section_id string, content_type string, content string, title string")
    return [tuple(r) for r in chunking.typed_chunks(rows).select("chunk_id", "parent_chunk_id", "chunk_type", "content").orderBy("chunk_id").collect()]


def test_short_sections_are_one_chunk(spark):
    for kind, name in (("procedure", "parent"), ("parameter", "parameter"), ("table", "table"), ("error", "error"), ("faq", "concept")):
        assert pieces(spark, kind, "| a  b |") == [("s_chunk_000", None, name, "| a b |")]


def test_null_and_empty_sections(spark):
    assert pieces(spark, "concept", None) == []
    assert pieces(spark, "procedure", "") == [("s_chunk_000", None, "parent", "")]


def test_long_procedure_is_a_summary_and_steps(spark):
    one, two = "1) Aprire " + "menu " * 400 + "e poi uscire subito.", "2) Chiudere " + "tutto " * 400
    found = pieces(spark, "procedure", one + "\n\n" + two)
    assert [f[:3] for f in found] == [("s_chunk_000", None, "parent"), ("s_chunk_000_child_000", "s_chunk_000", "step"), ("s_chunk_000_child_001", "s_chunk_000", "step")]
    assert found[0][3].endswith("...") and found[2][3] == two.strip()  # no sentence is short enough to be repeated


def test_overlap_of_paragraphs(spark):
    first, second = "A" * 1600 + ". Una frase breve qui.", "B" * 1700 + "."
    found = pieces(spark, "concept", first + "\n\n" + second)
    assert [f[3] for f in found] == [first, "[...continua] Una frase breve qui.\n\n" + second]


def test_long_parameters_have_no_overlap(spark):
    first, second = "Prima frase di prova. " + "a" * 500, "Seconda frase. " + "b" * 500
    assert [f[3] for f in pieces(spark, "parameter", f"{first}\n\ncorto\n\n{second}")] == [first, second]


def test_long_table_repeats_its_head(spark):
    table = "\n".join(["| h |", "| --- |", *[f"| {i} |" for i in range(30)]])
    found = pieces(spark, "table", table)
    assert [f[0] for f in found] == ["s_chunk_000", "s_chunk_001"]
    assert found[0][3] == " ".join(["| h |", *[f"| {i} |" for i in range(25)]])
    assert "| h | | 25 | | 26 |" in found[1][3]


def test_steps_are_linear_and_keep_their_lines(spark):
    rows = spark.createDataFrame([(1, "inizio di una frase abbastanza lunga\n- primo passo di questa procedura\nancora\n\n- corto"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in chunking.steps(rows).orderBy("step").collect()] == [(1, 1, "inizio di una frase abbastanza lunga"), (1, 2, "- primo passo di questa procedura\nancora")]


def test_long_procedures_take_linear_time(spark):
    """The lines are not made again for each step: 8 times the steps take far less than 64 times the time."""
    took = []
    for n in (500, 4000):
        text = "\n".join(f"{i}) Aprire la pagina numero {i} e salvare il documento di prova" for i in range(n))
        rows, sections = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([("s", "procedure", text)], "section_id string, content_type string, content string")
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            assert chunking.steps(rows).count() == n
            assert chunking.typed_chunks(sections).count() == n + 1
            last = time.perf_counter() - began
        took.append(last)
    assert took[1] < 12 * took[0] + 2
    plan = chunking.steps(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("lambda" in line for line in plan.split("\n") if "Filter" in line.split("(")[0])


def test_spans_of_files(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(b"uno due")), ("b.pdf", bytearray(b"")), ("c.pdf", None)], "path string, content binary")

    def reader(content):
        if not content:
            raise ValueError("no page")
        return [{"page": 0, "block": 0, "line": 0, "span": i, "font": "F", "size": 9.0, "flags": 0, "text": w} for i, w in enumerate(content.decode().split())]

    found = ingest.spans_of_files(files, reader).orderBy("span").collect()
    assert [(r.doc_id, r.span, r.text) for r in found] == [("a.pdf", 0, "uno"), ("a.pdf", 1, "due")]


def test_ingest_replaces_the_pages_that_come(spark):
    body = "<title>Magazzino 3.1</title><h1>{}</h1><p>" + "testo della pagina numero {} " * 8 + "</p>"
    page = lambda i, u, t: (i, u, body.replace("{}", t))
    pages = lambda *rows: spark.createDataFrame(list(rows), "page_id long, url string, html string")
    old = ingest.page_chunks(pages(page(1, "http://a", "uno"), page(2, "http://b", "due"), (3, None, None)))
    assert {(r.source_url, r.module, r.version) for r in old.collect()} == {("http://a", "Magazzino", "3.1"), ("http://b", "Magazzino", "3.1")}
    now = ingest.ingested(old, pages(page(4, "http://b", "tre"))).collect()
    assert sorted((r.source_url, r.title) for r in now) == [("http://a", "uno"), ("http://b", "tre")]
    assert all(r.hash and r.content.startswith(r.title + "\n\n") for r in now)


def test_image_rules(spark):
    rows = spark.createDataFrame([(100, 100, 10), (99, 500, 10), (500, 500, 11 << 20), (None, 500, 1)], "w int, h int, b long")
    assert [r[0] for r in rows.select(images.is_valid(F.col("w"), F.col("h"), F.col("b"))).collect()] == [True, False, False, False]
    declared = spark.createDataFrame([("99", "200"), ("100%", "20"), ("0", "20"), (None, "20")], "w string, h string")
    assert [r[0] for r in declared.select(images.is_declared_small(F.col("w"), F.col("h"))).collect()] == [True, False, False, False]


def test_tables(spark):
    index.ensure_table(spark, "chunk_rows")
    index.ensure_table(spark, "chunk_rows")
    assert spark.table("chunk_rows").count() == 0
    spark.sql("DROP TABLE chunk_rows")
    rows = spark.createDataFrame([("c1", "u", 1), ("c2", "u", 2), ("c3", "v", 3)], "chunk_id string, source_url string, vector int")
    assert [tuple(r) for r in index.of_url(rows, "u").collect()] == [("c1", "u"), ("c2", "u")]
    assert rows.select(text_of("vector")).dtypes == [("vector", "string")]


def test_answers_by_type(spark):
    body = "Una descrizione abbastanza lunga del campo.\nValori: 1, 2"
    results = spark.createDataFrame([(1, 1, 0.9, "s", 0, "Aliquota", body, "http://x"), (2, 1, 0.1, "s", 0, "T", "x", "http://y"), (3, 1, 0.45, "s", 0, "Altro", "x", "http://z")], "query_id long, rank int, score double, section_path string, n_images int, title string, content string, source_url string")
    queries = spark.createDataFrame([(1, "parametro aliquota", "parameter"), (2, "q", "general"), (3, "q", "general")], "query_id long, query string, kind string")
    found = {r.query_id: r for r in answer.answered(results, queries).collect()}
    assert found[1].answer.startswith("**Parametro: Aliquota**\n") and "**Valori ammessi**: 1, 2\n" in found[1].answer and found[1].confidence > 0.5
    assert (found[2].answer, found[2].confidence, found[2].n_sources) == (answer.NOTHING, 0.0, 0)
    assert found[3].answer.startswith("**Informazione non trovata**\n\n") and "\n- [Altro](http://z)\n" in found[3].answer and found[3].confidence == 0.0


@pytest.mark.parametrize("given, title", [((" Mio ", "/a/b.pdf"), "Mio"), ((None, "/a/b.c.pdf"), "b.c"), (("", "nome"), "nome")])
def test_document_title(spark, given, title):
    rows = spark.createDataFrame([given], "t string, p string")
    assert rows.select(ingest.document_title(F.col("t"), F.col("p"))).first()[0] == title


def test_long_texts_without_end_marks_are_cut_in_one_pass(spark):
    rows = spark.createDataFrame([("parola " * 60_000 + "fine. Altra frase finale! coda",)], "t string")
    assert [len(s) for s in rows.select(split_sentences(F.col("t"))).first()[0]] == [7 * 60_000 + 5, 19]


def test_declared_small_images_are_no_figures():
    from granary.operators.html import page_sections

    page = "<h1>Titolo</h1><p>" + "testo della pagina " * 20 + '</p><img src="a.png" width="40" height="300"><img src="b.png" width="400" height="300"><img src="c.png" width="40"><img src="d.png" width="40px" height="20px">'
    figures = [f["src"].rsplit("/", 1)[-1] for s in page_sections(page, "http://x/") for f in s["figures"]]
    assert figures == ["b.png", "c.png", "d.png"]


def test_topics_are_the_first_different_ones(spark):
    rows = spark.createDataFrame([(1, ["b", "a"]), (1, ["c", "a", "f"]), (1, ["e", "d"]), (2, []), (3, None)], "query_id long, breadcrumbs array<string>")
    assert {r["query_id"]: r["topics"] for r in answer.related_topics(rows).collect()} == {1: ["a", "b", "c", "d", "e"], 2: [], 3: []}
