"""Queries of ingest, images, chunks by type and answer layouts, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import analytics, chunking, images, index, ingest, lexical, templates
from granary.plans.queries import NORMAL, PARAMETERS, SECTION_TYPE, lit, parameters, query, read


def text_of(column: str) -> F.Column:
    return F.col(column).cast("string")


# ---- sections ---------------------------------------------------------------


@query(f"""WITH p AS ({PARAMETERS}), u AS (SELECT *, coalesce(nullif(regexp_extract(content, '(?i)Menu\\s*>\\s*(.+?)(?:\\.|$)', 1), ''), nullif(regexp_extract(content, '(?i)Vai\\s+a\\s*:\\s*(.+?)(?:\\.|$)', 1), '')) AS path FROM p)
    SELECT p_partkey, {SECTION_TYPE} AS content_type, regexp_replace(trim(path), '\\s*>\\s*', ' > ', 'g') AS ui_path, regexp_extract(upper(content), '\\b[A-Z]{{2,4}}-?\\d{{2,4}}\\b') AS code FROM u""")
def derived_attributes(spark, sf_dir):
    rows = ingest.derived(parameters(spark, sf_dir))
    return rows.select("p_partkey", "content_type", "ui_path", F.coalesce(F.get("error_codes", F.lit(0)), F.lit("")).alias("code"))


@query("""SELECT p_partkey AS section_id, unnest([0, 1, 2]) AS pos, unnest(['Valore massimo', 'Colore', 'Colore']) AS name, unnest([CAST(p_size AS VARCHAR), p_brand, p_brand]) AS description FROM part WHERE p_partkey % 2 = 0""")
def section_parameters(spark, sf_dir):
    content = F.concat_ws("\n", lit("Valore massimo: ", text_of("p_size")), lit("• Colore: ", "p_brand"))
    kind = F.when(F.col("p_partkey") % 2 == 0, F.lit("parameter")).otherwise(F.lit("concept"))
    return ingest.section_parameters(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("section_id"), content.alias("content"), kind.alias("content_type")))


@query(r"""SELECT page_id, url, 'main_content' AS section_id, coalesce(nullif(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)), ''), 'Documento') AS title,
    left(coalesce(nullif(regexp_replace(html, '<[^>]+>', '', 'g'), ''), 'Contenuto non estratto'), 5000) AS content, 1 AS level, 'top' AS anchor FROM pages""")
def whole_pages(spark, sf_dir):
    return ingest.whole_page(read(spark, sf_dir, "pages"), F.regexp_replace("html", "<[^>]+>", ""))


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parameters(spark, sf_dir).withColumn("url", lit("http://x/", text_of("p_partkey")))
    tables = F.when(F.col("p_partkey") % 2 == 0, F.array(lit("| a |"), lit("| b |"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"section_id": lit("section_", text_of("p_partkey")), "level": F.lit(2), "anchor": F.lit("a"), "tables": tables, "doc_title": lit("Manuale Magazzino v2.", text_of("p_partkey"))})


FULL = "title || chr(10) || chr(10) || content || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || chr(10) || '| a |' || chr(10) || chr(10) || '| b |' ELSE '' END"


@query(f"""WITH p AS ({PARAMETERS}), c AS (SELECT *, {FULL} AS text, nullif(regexp_extract(upper(content), '\\b[A-Z]{{2,4}}-?\\d{{2,4}}\\b'), '') AS code FROM p)
    SELECT sha1('http://x/' || CAST(p_partkey AS VARCHAR)) || '#section_' || CAST(p_partkey AS VARCHAR) AS chunk_id, text AS content, {SECTION_TYPE} AS content_type, 'Section ' || CAST(p_partkey AS VARCHAR) AS crumbs, '2.' || CAST(p_partkey AS VARCHAR) AS version, 'Magazzino' AS module, code AS error_code, sha1({NORMAL}) AS hash FROM c""")
def section_chunks(spark, sf_dir):
    found = ingest.chunks_of_sections(titled(spark, sf_dir))
    return found.select("chunk_id", "content", "content_type", F.array_join("breadcrumbs", "|").alias("crumbs"), "version", "module", "error_code", "hash")


@query(f"""WITH p AS ({PARAMETERS}) SELECT sha1('http://x/' || CAST(p_partkey AS VARCHAR)) || '#page' || CAST(p_partkey AS VARCHAR) || '-' || CAST(p_partkey + 1 AS VARCHAR) AS chunk_id, CAST(p_partkey AS INTEGER) AS first_page, CAST(p_partkey + 1 AS INTEGER) AS last_page, 'pdf' AS source_format,
    nullif(trim(regexp_extract(content, '(?i)Parametro\\s+([^:\\n]+)', 1)), '') AS param_name FROM p""")
def page_section_chunks(spark, sf_dir):
    rows = titled(spark, sf_dir).withColumns({"page_start": F.col("p_partkey"), "page_end": F.col("p_partkey") + 1})
    found = ingest.chunks_of_sections(rows, from_pages=True)
    return found.select("chunk_id", F.col("page_range")[0].alias("first_page"), F.col("page_range")[1].alias("last_page"), "source_format", "param_name")


@query()
def ingested_pages(spark, sf_dir):
    """All pages into a table that has the first half of them, an older state of some URLs."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    old = ingest.page_chunks(pages.filter("page_id % 2 = 0")).withColumn("content", F.lit("old"))
    return ingest.ingested(old, pages).drop("breadcrumbs", "page_range")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'manuale.' || CAST(p_partkey AS VARCHAR) END AS title FROM part")
def document_titles(spark, sf_dir):
    own = F.when(F.col("p_partkey") % 2 == 0, lit(" ", "p_name")).otherwise(F.lit(" "))
    return read(spark, sf_dir, "part").select("p_partkey", ingest.document_title(own, lit("/a.b/manuale.", text_of("p_partkey"), F.lit(".pdf"))).alias("title"))


@query("SELECT page_id, page_id % 3 = 0 AS html, page_id % 3 = 1 AS pdf FROM pages")
def content_kinds(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("Text/HTML; charset=utf-8", "application/PDF", "text/plain"))), (F.col("page_id") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", ingest.is_html(kind).alias("html"), ingest.is_pdf(kind).alias("pdf"))


@query("SELECT count(DISTINCT source) AS n_documents, count(*) AS n_chunks, count(DISTINCT lang) AS n_types FROM documents")
def processing_stats(spark, sf_dir):
    return ingest.processing_stats(read(spark, sf_dir, "documents").withColumnsRenamed({"source": "source_url", "lang": "content_type"}))


@query("WITH r AS (SELECT p_partkey, p_brand AS hash FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_size <= 40) SELECT hash, min(p_partkey) AS chunk_id FROM r GROUP BY hash")
def united_parses(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("hash"), "p_size")
    return ingest.united(rows.filter("p_size > 25").drop("p_size"), rows.filter("p_size <= 40").drop("p_size")).distinct()


# ---- chunks -----------------------------------------------------------------


@query(f"""WITH s AS (SELECT p_partkey, (['error', 'parameter', 'procedure', 'concept'])[CAST(p_partkey % 4 + 1 AS INTEGER)] AS content_type, 's' || CAST(p_partkey AS VARCHAR) AS id FROM part),
    t AS (SELECT s.*, 0 AS pos, NULL AS child, CASE content_type WHEN 'procedure' THEN '' ELSE 'Testo di ' || p_name || '.' END AS text FROM s JOIN part USING (p_partkey)
    UNION ALL SELECT s.*, 0, 0, '1) ' || repeat(p_name || ' ', 400) || chr(10) || 'nota' FROM s JOIN part USING (p_partkey) WHERE content_type = 'procedure'
    UNION ALL SELECT s.*, 1, 1, '2) ' || repeat(p_type || ' ', 400) FROM s JOIN part USING (p_partkey) WHERE content_type = 'procedure')
    SELECT id || '_chunk_000' || coalesce('_child_00' || CAST(child AS VARCHAR), '') AS chunk_id, CASE WHEN child IS NOT NULL THEN id || '_chunk_000' END AS parent_chunk_id, CASE WHEN child IS NOT NULL THEN 'step' WHEN content_type = 'procedure' THEN 'parent' ELSE content_type END AS chunk_type, {NORMAL} AS content, sha1({NORMAL}) AS hash FROM t""")
def typed_chunks(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("error", "parameter", "procedure", "concept"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    long = F.concat(F.lit("1) "), F.repeat(F.concat("p_name", F.lit(" ")), 400), F.lit("\nnota\n2) "), F.repeat(F.concat("p_type", F.lit(" ")), 400))
    content = F.when(kind == "procedure", long).otherwise(F.concat(F.lit("Testo di "), "p_name", F.lit(".")))
    part = read(spark, sf_dir, "part").repartition(4 * spark.sparkContext.defaultParallelism)  # a small file is one task, the texts made of it are not small
    rows = part.select(lit("s", text_of("p_partkey")).alias("section_id"), kind.alias("content_type"), content.alias("content"))
    return chunking.typed_chunks(rows).select("chunk_id", "parent_chunk_id", "chunk_type", "content", "hash")


@query()
def document_chunks(spark, sf_dir):
    """Documents as sections, cut by their type, each chunk after the end of the one before it."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("section_id"), F.lit("concept").alias("content_type"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"))
    return chunking.typed_chunks(rows).select("chunk_id", "chunk_type", "content", "hash")


CHUNK_ROWS = "SELECT 'c' || CAST(p_partkey AS VARCHAR) AS chunk_id, p_name AS title, nullif(CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END, '') AS module, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand || ' > ' || p_type END AS crumbs FROM part"


@query(CHUNK_ROWS)
def payload_round_trip(spark, sf_dir):
    empty = {c: F.lit("") for c in index.PAYLOAD_FIELDS}
    crumbs = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", "p_type"))
    own = {"chunk_id": lit("c", text_of("p_partkey")), "title": F.col("p_name"), "module": F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lit("")), "breadcrumbs": crumbs}
    rows = read(spark, sf_dir, "part").withColumns(empty | own).select(index.payload().alias("payload"))
    back = rows.select(index.from_payload(F.col("payload")).alias("c"))
    return back.select("c.chunk_id", "c.title", "c.module", F.array_join("c.breadcrumbs", " > ").alias("crumbs"))


@query("SELECT p_partkey AS chunk_id, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_name END AS content FROM part")
def merged_by_id(spark, sf_dir):
    old = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("content"))
    return index.merged_by_id(old, old.filter("chunk_id % 3 = 0").withColumn("content", F.lit("new")))


@query("SELECT p_partkey AS chunk_id, p_name FROM part WHERE p_brand = 'Brand#11' ORDER BY 1 LIMIT 100")
def rows_of_url(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("source_url"), "p_name", F.lit(0).alias("vector"))
    return index.of_url(rows, "Brand#11").drop("source_url")


@query("SELECT o_orderpriority AS content_type, count(*) AS n FROM orders GROUP BY 1")
def type_counts(spark, sf_dir):
    return analytics.type_counts(read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "content_type"))


@query("SELECT p_partkey AS query_id, 1 AS rank, round(p_size / 7.0, 3) AS score, CASE WHEN length(t) > 50 THEN left(t, 50) || '...' ELSE t END AS title, p_brand AS module, p_type AS content_type, 'u' AS url FROM (SELECT *, p_name || ' ' || p_type || ' ' || p_brand AS t FROM part)")
def result_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.lit(1).alias("rank"), (F.col("p_size") / F.lit(7.0)).alias("score"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"), F.col("p_brand").alias("module"), F.col("p_type").alias("content_type"), F.lit("u").alias("source_url"))
    return analytics.result_rows(rows)


# ---- images -----------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey % 200 >= 100 AND l_suppkey % 200 >= 100 AS valid, l_partkey % 200 > 0 AND l_suppkey % 200 > 0 AND least(l_partkey % 200, l_suppkey % 200) < 100 AS declared_small FROM lineitem")
def image_validity(spark, sf_dir):
    w, h = F.col("l_partkey") % 200, F.col("l_suppkey") % 200
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", images.is_valid(w, h).alias("valid"), images.is_declared_small(w.cast("string"), h.cast("string")).alias("declared_small"))


@query("""WITH i AS (SELECT p_partkey, [p_size % 4, p_size % 3] AS a, p_size % 2 AS x, p_size % 5 AS y FROM part)
    SELECT p_partkey, array_to_string(list_concat(a, list_filter([x], lambda v: NOT list_contains(a, v)), list_filter([y], lambda v: NOT list_contains(a, v) AND v <> x)), ',') AS ids FROM i""")
def image_union(spark, sf_dir):
    one = lambda n: F.struct((F.col("p_size") % n).cast("string").alias("id"))
    merged = images.merged(F.array(one(4), one(3)), F.array(one(2), one(5), one(5)))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(merged, lambda x: x["id"]), ",").alias("ids"))


@query("""WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, max(l_partkey % 3) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l)
    SELECT l.doc_id, l.pos - 1 AS place, s.pos AS section_pos FROM l JOIN s ON l.doc_id = s.doc_id AND l.pos - 1 >= upto - s.n AND l.pos - 1 < upto""")
def image_sections(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("section_pos")).agg(F.max(F.col("l_partkey") % 3).alias("n_figures"))
    return images.assigned(li, li.select("doc_id", (F.col("section_pos") - 1).cast("long").alias("place")))


@query("""WITH i AS (SELECT l_orderkey, string_agg('i' || CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS ids, string_agg(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END, chr(10) || '---' || chr(10) ORDER BY l_linenumber, l_returnflag) AS t FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS chunk_id, coalesce(ids, '') AS ids, o_orderpriority || coalesce(chr(10) || chr(10) || '[Testo estratto dalle immagini]' || chr(10) || t, '') AS content FROM orders LEFT JOIN i ON o_orderkey = l_orderkey""")
def image_texts(spark, sf_dir):
    chunks = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("content"))
    own = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("place"), lit("i", text_of("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("ocr_text"))
    return ingest.with_image_texts(chunks, own).select("chunk_id", F.array_join("image_ids", ",").alias("ids"), "content")


@query("SELECT l_orderkey AS chunk_id, l_linenumber AS id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def images_of_chunks(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("id"))
    return images.of_chunks(rows, read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("chunk_id")))


# ---- answer layouts ---------------------------------------------------------

N = "chr(10)"
LINKS = f"'**Fonti**:' || {N} || {N} || '- [' || p_name || '](http://x)#a' || {N} || {N} || '- [altro](http://y)' || {N}"


@query(f"""SELECT p_partkey, CASE p_partkey % 4
    WHEN 0 THEN '**Parametro: ' || p_name || '**' || {N} || {N} || {N} || '**Percorso**: Menu' || {N} || {N} || '**Descrizione**: Una descrizione abbastanza lunga di ' || p_name || {N} || {N} || '**Valori ammessi**: ' || CAST(p_size AS VARCHAR) || repeat({N}, 9) || '**Versioni**: Disponibile dalla versione 2.0' || {N} || {N} || {LINKS}
    WHEN 1 THEN '**' || p_name || '**' || {N} || {N} || '**Modulo**: M' || {N} || {N} || {N} || '**Procedura**:' || {N} || {N} || '1. ' || p_type || {N} || {N} || '2. fine' || {N} || repeat({N}, 8) || {LINKS}
    WHEN 2 THEN '**Errore ERR-001: ' || p_type || '**' || {N} || {N} || '**Modulo**: M' || {N} || {N} || '**Causa probabile**: ' || p_brand || {N} || {N} || '**Risoluzione**:' || {N} || {N} || '1. Riavviare' || {N} || repeat({N}, 6) || {LINKS}
    ELSE '**' || p_name || '**' || {N} || {N} || 'testo' || repeat({N}, 4) || '**Argomenti correlati**: uno, due' || {N} || {N} || {LINKS} END AS answer FROM part""")
def answer_layouts(spark, sf_dir):
    k = F.col("p_partkey") % 4
    kind = F.element_at(F.array(*map(F.lit, ("parameter", "procedure", "error", "general"))), (k + 1).cast("int"))
    content = (
        F.when(k == 0, F.concat(F.lit("Una descrizione abbastanza lunga di "), "p_name", F.lit("\nValori: "), text_of("p_size")))
        .when(k == 1, F.concat(F.lit("1. "), "p_type", F.lit("\n2. fine")))
        .otherwise(F.concat(F.lit("ERR-001: "), "p_type", F.lit("\nCausa: "), "p_brand", F.lit("\nSoluzione: Riavviare")))
    )
    source = lambda title, url, anchor: F.struct(title.alias("title"), F.lit(url).alias("url"), anchor.alias("anchor"))
    sources = F.array(source(F.col("p_name"), "http://x", F.lit("a")), source(F.lit("altro"), "http://y", F.lit(None).cast("string")))
    facts = {"name": F.col("p_name"), "title": F.col("p_name"), "module": F.when(k != 0, F.lit("M")), "version": F.lit("2.0"), "ui_path": F.lit("Menu"), "code": F.lit("ERR-001"), "content": content, "combined": F.lit("testo"), "topics": F.array(F.lit("uno"), F.lit("due"))}
    return read(spark, sf_dir, "part").select("p_partkey", templates.rendered(kind, facts, sources).alias("answer"))


# ---- lexical search ---------------------------------------------------------

WORDS = "list_filter(regexp_split_to_array(lower({}), '[^a-z]+'), lambda w: w <> '')"


@query(f"""WITH x AS (SELECT p_partkey AS doc_id, 'title' AS field, CAST(1.4 AS DOUBLE) AS boost, {WORDS.format('p_name')} AS words FROM part UNION ALL SELECT p_partkey, 'content', 1.0, {WORDS.format("p_type || ' ' || p_type || ' ' || p_brand")} FROM part),
    s AS (SELECT field, count(*) AS n, avg(len(words)) AS avgdl FROM x WHERE len(words) > 0 GROUP BY field), tf AS (SELECT field, boost, doc_id, dl, term, count(*) AS tf FROM (SELECT field, boost, doc_id, len(words) AS dl, unnest(words) AS term FROM x) GROUP BY ALL),
    df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY 1, 2), a AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 200 = 0 THEN lower(p_brand) ELSE left(p_name, length(p_name) - 1) || ' zzz' END AS query FROM part WHERE p_partkey % 100 = 0),
    q AS (SELECT DISTINCT query_id, unnest({WORDS.format('query')}) AS qt FROM a), e AS (SELECT qt, term, levenshtein(qt, term) AS ed FROM (SELECT DISTINCT qt FROM q), (SELECT DISTINCT term FROM tf) WHERE levenshtein(qt, term) <= CASE WHEN length(qt) <= 2 THEN 0 WHEN length(qt) <= 5 THEN 1 ELSE 2 END),
    m AS (SELECT query_id, tf.field, doc_id, sum(boost * (1 - ed / least(length(e.qt), length(e.term))) * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.55 + 0.55 * dl / avgdl))) AS score FROM q JOIN e ON q.qt = e.qt JOIN tf ON tf.term = e.term JOIN df ON df.field = tf.field AND df.term = tf.term JOIN s ON s.field = tf.field GROUP BY 1, 2, 3),
    c AS (SELECT upper(p_brand) AS code, count(*) AS df, (SELECT count(*) FROM part) AS n FROM part GROUP BY 1),
    u AS (SELECT query_id, doc_id, max(score) AS score FROM m GROUP BY 1, 2 UNION ALL SELECT query_id, p_partkey, 2.5 * ln(1 + (n - df + 0.5) / (df + 0.5)) / 1.9 FROM a JOIN c ON code = upper(query) JOIN part ON upper(p_brand) = code)
    SELECT query_id, doc_id, round(sum(score), 4) AS score FROM u GROUP BY 1, 2""")
def lexical_search(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    chunks = part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_type", "p_brand").alias("content"), F.upper("p_brand").alias("error_code"))
    ask = F.when(F.col("p_partkey") % 200 == 0, F.lower("p_brand")).otherwise(F.concat(F.expr("left(p_name, length(p_name) - 1)"), F.lit(" zzz")))
    queries = part.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), ask.alias("query"))
    return lexical.lexical_search(queries, chunks, boosts={"title": 1.4, "content": 1.0}, digits=4)


@query(f"SELECT doc_id, term, CAST(count(*) AS INTEGER) AS tf, CAST(dl AS INTEGER) AS dl FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS term, len({WORDS.format('text')}) AS dl FROM documents) GROUP BY doc_id, term, dl")
def stored_postings(spark, sf_dir):
    return lexical.postings(read(spark, sf_dir, "documents"), ("text",)).select("doc_id", "term", "tf", "dl")
