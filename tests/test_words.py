"""Italian analysis on known forms, and inexact words against the plain distance."""

import random

import pytest
from granary.functions import italian
from granary.operators import dictionary, lexical, search
from granary.operators.stored_lexical import LexicalIndex
from pyspark.sql import functions as F

FORMS = {
    "fatture": "fattur", "fattura": "fattur", "clienti": "client", "cliente": "client", "banche": "banc", "banchi": "banc", "uffici": "uffic", "ufficio": "uffic", "aziende": "aziend", "aziendali": "aziendal",
    "contabilità": "contabilit", "perché": "perc", "magazzini": "magazzin", "magazzino": "magazzin", "categorie": "categor", "categoria": "categor", "pagamenti": "pagament", "righe": "righe", "note": "note", "iva": "iva", "città": "citta",
}


def test_word_forms_have_known_stems(spark):
    rows = spark.createDataFrame(list(FORMS.items()), "word string, stem string")
    got = {r["word"]: r["s"] for r in rows.select("word", italian.stemmed(italian.folded(F.col("word"))).alias("s")).collect()}
    assert got == FORMS
    assert {w: italian.plain_stem(w) for w in FORMS} == FORMS


def test_elision_function_words_and_synonyms(spark):
    text = lambda t, *s: [r[0] for r in spark.createDataFrame([(t,)], "t string").select(italian.tokens(F.col("t"), *s)).collect()][0]
    assert text("L'impostazione dell’aliquota: un'altra, c'è") == ["impostazion", "iva", "altra"]
    assert text("avrebbero avuto i miei settaggi, nei moduli degli uffici") == ["impostazion", "modul", "uffic"]
    assert text("settaggio e configurazione") == ["impostazion", "impostazion"]
    assert text("la nota di spese e il rimborso; nota", ("nota di spese,rimborso",)) == ["nota_spese", "nota_spese", "nota"]
    assert text(None) is None and text("") == [] and text("è di un") == []
    assert 200 < len(italian.stop_words()) < 400 and {"della", "sugli", "avrebbe", "foste", "stavano", "perche"} <= italian.stop_words()


def plain_distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_near_terms_are_all_within_the_distance(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))) for _ in range(250)}
    asked = set(rng.sample(sorted(words), 40)) | {"ab", "abcdabcd", "é", "x"}
    v = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))] + [("", 5), (None, 5)], "term string, n long")
    q = spark.createDataFrame([(w,) for w in asked] + [("",), (None,)], "query_term string")
    allowed = lambda w: 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
    want = {(a, b, d) for a in asked for b in words if (d := plain_distance(a, b)) <= allowed(a)}
    assert {tuple(r) for r in dictionary.near_terms(q, dictionary.deletions(v), most=1000).collect()} == want
    few = dictionary.near_terms(q, dictionary.deletions(v), most=3).collect()
    n = {w: i for i, w in enumerate(sorted(words))}
    for a in asked:
        best = sorted((d > 0, -n[b], d, b) for x, b, d in want if x == a)[:3]
        assert sorted((r["edits"] > 0, -n[r["term"]], r["edits"], r["term"]) for r in few if r["query_term"] == a) == best


@pytest.fixture(scope="module")
def manual(spark, tmp_path_factory):
    rows = [
        (1, "u1", "Fatture elettroniche", "Come emettere la fattura ai clienti.", None, "s1", 1), (2, "u2", "Errori", "Il codice indica un server non raggiungibile.", "ERR-7", "s2", 1),
        (3, "u3", "Magazzino", "Giacenze degli articoli e merci in arrivo.", None, "s3", 2), (4, "u4", "Parametri", "La configurazione dell'aliquota.", None, "s4", 2),
    ]
    chunks = spark.createDataFrame(rows, "doc_id long, source_url string, title string, content string, error_code string, section_path string, module int").withColumn("text", F.col("content"))
    index = LexicalIndex(spark, str(tmp_path_factory.mktemp("manual")), ("title", "content"), italian.tokens, shelves=1)
    index.add(chunks)
    vectors = spark.createDataFrame([(i, [float(i == j) for j in range(1, 5)]) for i in range(1, 5)], "vec_id long, embedding array<float>")
    return chunks, index, vectors


def test_search_with_stems_codes_inexact_words_and_filters(spark, manual):
    chunks, index, vectors = manual
    asked = spark.createDataFrame([(1, "fatturazione cliente"), (2, "err-7"), (3, "arirvo"), (4, "impostazioni delle aliquote")], "query_id long, query string")
    lexical_only = vectors.limit(0).withColumnRenamed("vec_id", "query_id")
    run = lambda **o: {r["query_id"]: r["doc_id"] for r in search.stored_search(asked, chunks, index, lexical_only, vectors, **o).filter("rank = 1").collect()}
    # the stem is of five letters: two neighbours exchanged are two edits for the plain expansion, one for the dictionary
    assert run() == {1: 1, 2: 2, 4: 4}
    assert run(expand=dictionary.expanded) == {1: 1, 2: 2, 3: 3, 4: 4}
    assert run(where={"module": 2}, expand=dictionary.expanded) == {3: 3, 4: 4}
    dense = search.stored_search(asked, chunks, index, spark.createDataFrame([(2, [0.0, 0.0, 1.0, 0.5])], "query_id long, embedding array<float>"), vectors, where={"module": {"min": 2}})
    assert {(r["doc_id"], r["origin"]) for r in dense.filter("query_id = 2").collect()} == {(3, "vector"), (4, "vector")}


def test_boosts_go_by_the_type_of_the_question(spark, manual):
    _, index, _ = manual
    kinds = {r["query"]: (r["kind"], r["boosts"]) for r in search.typed(spark.createDataFrame([(1, "errore fatture"), (2, "procedura fatture"), (3, "fatture")], "query_id long, query string"), index.fields).collect()}
    assert [kinds[q][0] for q in ("errore fatture", "procedura fatture", "fatture")] == ["error", "procedure", "general"]
    assert kinds["errore fatture"][1]["error_code"] == 5.0 and kinds["fatture"][1]["error_code"] == 2.5
    assert kinds["procedura fatture"][1]["title"] == pytest.approx(1.82) and kinds["fatture"][1]["title"] == 1.4
    score = lambda q: {r["doc_id"]: r["score"] for r in index.search(search.typed(spark.createDataFrame([(1, q)], "query_id long, query string"), index.fields)).collect()}
    assert score("procedura fatture")[1] == pytest.approx(score("fatture")[1] * 1.3, abs=1e-5)


def test_answers_of_a_search(spark, manual):
    chunks, index, vectors = manual
    asked = spark.createDataFrame([(1, "fatture elettroniche clienti"), (9, "zzzz")], "query_id long, query string")
    found = search.stored_search(asked, chunks, index, vectors.limit(0).withColumnRenamed("vec_id", "query_id"), vectors)
    got = {r["query_id"]: r for r in search.search_answers(asked, chunks, found).collect()}
    assert set(got) == {1, 9} and got[9]["n_sources"] == 0 and got[9]["confidence"] == 0
    assert got[1]["n_sources"] >= 1 and 0 < got[1]["confidence"] <= 1 and "Fatture elettroniche" in got[1]["answer"]
    assert lexical.expanded is not dictionary.expanded
