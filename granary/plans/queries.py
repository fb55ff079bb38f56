"""The reference's operators as queries over the test tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import rules, text
from granary.operators import analytics, answer, chunking, html, index, pdf, retrieve
from granary.session import Retrieval
from granary.sources import crawl
from granary.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sections of a manual."""
    code = F.concat(F.lit("ERR-"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"))
    title = F.concat(F.element_at(F.array(F.lit("Parametro "), F.lit("Guida "), F.lit("Tabella "), F.lit("Domande ")), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_name"))
    body = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Errore "), code, F.lit(": "), F.col("p_type"), F.lit(". Menu > Archivi > "), F.col("p_brand"), F.lit("."))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Parametro "), F.col("p_name"), F.lit(": procedura "), F.col("p_type"))).otherwise(F.concat(F.lit("Vai a: Stampe > "), F.col("p_brand"), F.lit(". Valori: "), F.col("p_size").cast("string")))
    return read(spark, sf_dir, "part").select("p_partkey", title.alias("title"), body.alias("content"), F.col("p_brand").alias("section_path"))


PARAMETERS = """SELECT p_partkey, (['Parametro ', 'Guida ', 'Tabella ', 'Domande '])[CAST(p_partkey % 4 + 1 AS INTEGER)] || p_name AS title,
    CASE WHEN p_partkey % 3 = 0 THEN 'Errore ERR-' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || ': ' || p_type || '. Menu > Archivi > ' || p_brand || '.'
         WHEN p_partkey % 3 = 1 THEN 'Parametro ' || p_name || ': procedura ' || p_type
         ELSE 'Vai a: Stampe > ' || p_brand || '. Valori: ' || CAST(p_size AS VARCHAR) END AS content, p_brand AS section_path FROM part"""

NORMAL = r"replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '^[\s\x0B]+|[\s\x0B]+$', '', 'g'), '[\s\x0B]+', ' ', 'g'), '\.{2,}', '...', 'g'), 'N°', 'Numero'), 'n°', 'numero'), 'N.', 'Numero'), 'n.', 'numero'), 'impostaz.', 'impostazione'), 'config.', 'configurazione'), 'parametr.', 'parametro')"


# ---- text -------------------------------------------------------------------


@query(f"SELECT doc_id, {NORMAL} AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, sha1({NORMAL}) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query(f"SELECT min(doc_id) AS doc_id, sha1({NORMAL}) AS hash FROM documents GROUP BY 2")
def dedup_by_hash(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))
    return index.first_by_hash(rows, "hash", "doc_id")


@query("SELECT doc_id, greatest(1, CAST(floor(length(text) / 4.0) AS INTEGER)) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("""WITH t AS (SELECT doc_id, text, left(text, 400) AS cut FROM documents),
    l AS (SELECT *, CASE WHEN instr(cut, ' ') > 0 THEN length(cut) - instr(reverse(cut), ' ') ELSE -1 END AS last FROM t)
    SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN last > 320 THEN left(cut, last) || '...' ELSE cut || '...' END AS truncated FROM l""")
def truncate_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.truncate_to_tokens(F.col("text"), 100).alias("truncated"))


@query(r"""WITH s AS (SELECT conv_id, turn, regexp_extract_all(text, '(?s)(.*?[.!?]+)(?:\s|$)', 1) AS found FROM conversations),
    p AS (SELECT conv_id, turn, list_filter(list_transform(found, lambda x: regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), lambda x: length(x) > 10) AS kept FROM s)
    SELECT conv_id, turn, unnest(range(len(kept))) AS pos, unnest(kept) AS sentence FROM p""")
def sentence_split(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.split_sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda x: regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), lambda x: length(x) > 20) AS kept FROM documents)
    SELECT doc_id, unnest(range(len(kept))) AS pos, unnest(kept) AS paragraph FROM p""")
def paragraph_split(spark, sf_dir):
    spaced = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.split_paragraphs(spaced)).alias("pos", "paragraph")).withColumn("pos", F.col("pos").cast("long"))


@query(r"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS raw FROM documents),
    n AS (SELECT doc_id, i, (CASE WHEN i % 3 = 0 THEN '- ' ELSE '' END) || regexp_replace(raw, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS line, i % 3 = 0 AS start FROM l WHERE regexp_replace(raw, '[\s\x0B]+', '', 'g') <> ''),
    g AS (SELECT *, sum(CAST(start AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM n),
    s AS (SELECT doc_id, island, string_agg(line, chr(10) ORDER BY i) AS content FROM g GROUP BY doc_id, island)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS step, content FROM s WHERE length(content) > 30""")
def step_islands(spark, sf_dir):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when((i % 3 == 0) & (text.stripped(x) != ""), F.concat(F.lit("- "), text.stripped(x))).otherwise(x))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))
    return chunking.steps(rows).withColumn("step", F.col("step").cast("long"))


@query(f"""WITH p AS ({PARAMETERS}), e AS (SELECT p_partkey, regexp_extract_all(upper(content), '\\b[A-Z]{{2,4}}-?\\d{{2,4}}\\b') AS codes FROM p)
    SELECT p_partkey, list_aggregate(list_distinct(codes), 'string_agg', ',') AS codes FROM e WHERE len(codes) > 0""")
def error_codes(spark, sf_dir):
    rows = parameters(spark, sf_dir).select("p_partkey", text.error_codes(F.col("content")).alias("c"))
    return rows.filter(F.size("c") > 0).select("p_partkey", F.array_join("c", ",").alias("codes"))


@query(f"""WITH p AS ({PARAMETERS}), u AS (SELECT p_partkey, coalesce(nullif(regexp_extract(content, '(?i)Menu\\s*>\\s*(.+?)(?:\\.|$)', 1), ''), nullif(regexp_extract(content, '(?i)Vai\\s+a\\s*:\\s*(.+?)(?:\\.|$)', 1), '')) AS path FROM p)
    SELECT p_partkey, regexp_replace(trim(path), '\\s*>\\s*', ' > ', 'g') AS path FROM u WHERE path IS NOT NULL""")
def ui_path(spark, sf_dir):
    return parameters(spark, sf_dir).select("p_partkey", text.ui_path(F.col("content")).alias("path")).filter("path is not null")


@query(f"""WITH p AS ({PARAMETERS}), n AS (SELECT p_partkey, nullif(trim(regexp_extract(content, '(?i)Parametro\\s+([^:\\n]+)', 1)), '') AS name FROM p)
    SELECT p_partkey, name FROM n WHERE name IS NOT NULL""")
def param_name(spark, sf_dir):
    return parameters(spark, sf_dir).select("p_partkey", rules.param_name(F.col("content")).alias("name")).filter("name is not null")


@query("""SELECT s_suppkey, list_aggregate(list_transform(list_filter(string_split('Fornitori/' || replace(s_name, '#', '/no_') || '//dati-base', '/'), lambda x: x <> ''),
    lambda x: list_aggregate(list_transform(string_split(replace(replace(x, '_', ' '), '-', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), 'string_agg', ' ')), 'string_agg', '|') AS crumbs FROM supplier""")
def breadcrumbs(spark, sf_dir):
    path = F.concat(F.lit("Fornitori/"), F.replace("s_name", F.lit("#"), F.lit("/no_")), F.lit("//dati-base"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(text.breadcrumbs(path), "|").alias("crumbs"))


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ')?'), '[^a-z0-9_\s-]', '', 'g'), '[-\s]+', '-', 'g'), '-') AS anchor FROM part")
def anchor_slug(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.anchor(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")?"))).alias("anchor"))


@query("""SELECT page_id, sha1(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' ')) AS clean FROM pages""")
def clean_tags(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.sha1(F.encode(text.clean_tags(F.col("html")), "UTF-8")).alias("clean"))


@query(r"""SELECT page_id, sha1(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(left(html, 500000), '<!--.*?-->', '', 'gs'), '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<svg[^>]*>.*?</svg>', '', 'gis'), '<iframe[^>]*>.*?</iframe>', '', 'gis')) AS clean FROM pages""")
def html_preprocess(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.sha1(F.encode(text.preprocess_html(F.col("html")), "UTF-8")).alias("clean"))


@query(r"""WITH t AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') || ' Magazzino v2.' || page_id % 10 AS title FROM pages)
    SELECT page_id, title, regexp_extract(title, '(?i)(Contabilità|Fatturazione|Magazzino|HR|Desktop[0-9A-Za-z_]+)', 1) AS module, regexp_extract(title, '(?i)v?(\d+\.\d+(?:\.\d+)?)', 1) AS version FROM t""")
def html_title_meta(spark, sf_dir):
    title = F.concat(text.html_title(F.col("html")), F.lit(" Magazzino v2."), (F.col("page_id") % 10).cast("string"))
    return read(spark, sf_dir, "pages").select("page_id", title.alias("title"), text.module_of(title).alias("module"), text.version_of(title).alias("version"))


@query()
def html_sections(spark, sf_dir):
    return html.html_sections(read(spark, sf_dir, "pages"))


DOMAINS = ("example.com", "example.org")
HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '')"


@query(f"SELECT page_id, coalesce({HOST} = 'example.com' OR {HOST} LIKE '%.example.com' OR {HOST} = 'example.org' OR {HOST} LIKE '%.example.org', false) AS valid FROM pages")
def url_valid(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.url_allowed(F.col("url"), DOMAINS).alias("valid"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_extract(regexp_extract(url || CASE WHEN page_id % 2 = 0 THEN '' ELSE '/a.htm' END, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '(\.[^./]+)$', 1), ''), '.html') AS ext FROM pages""")
def url_extension(spark, sf_dir):
    url = F.concat("url", F.when(F.col("page_id") % 2 == 0, F.lit("")).otherwise(F.lit("/a.htm")))
    return read(spark, sf_dir, "pages").select("page_id", text.url_extension(url, F.lit("text/html")).alias("ext"))


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, left(md5(CAST(l_orderkey AS VARCHAR)), 12) AS h FROM lineitem)
    SELECT l_orderkey, l_linenumber, 'page_' || CAST(l_linenumber + 1 AS VARCHAR) || '_img_' || CAST(l_orderkey % 7 AS VARCHAR) AS stem, h || '_p' || CAST(l_linenumber AS VARCHAR) || '_i' || CAST(l_orderkey % 7 AS VARCHAR) AS image FROM i""")
def image_names(spark, sf_dir):
    h = text.url_hash(F.col("l_orderkey").cast("string"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", h.alias("h"), F.concat(h, F.lit("_p"), F.col("l_linenumber").cast("string"), F.lit("_i"), (F.col("l_orderkey") % 7).cast("string")).alias("id"))
    rows = rows.withColumn("stem", text.image_file_stem(F.col("id")))
    return rows.select("l_orderkey", "l_linenumber", "stem", text.image_id(F.col("h"), F.col("stem")).alias("image"))


@query(r"""WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{80}-\x{FF}]', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')),
    lambda x: x <> '' AND NOT regexp_full_match(x, '\d+') AND (length(x) >= 5 OR regexp_matches(x, '[A-Za-z]'))) AS kept FROM documents), t AS (SELECT doc_id, coalesce(list_aggregate(kept, 'string_agg', chr(10)), '') AS text FROM c)
    SELECT doc_id, """ + NORMAL + " AS clean FROM t")
def pdf_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.clean_pdf_text(F.col("text")).alias("clean"))


# ---- rules ------------------------------------------------------------------

SECTION_TYPE = """CASE WHEN regexp_matches(lower(content), 'errore|error|codice|avviso|warning') THEN 'error' WHEN regexp_matches(lower(title), 'parametro|impostazione|configurazione|settaggio|opzione') THEN 'parameter'
    WHEN regexp_matches(lower(content), 'procedura|come|step|passo|istruzione|guida') THEN 'procedure' WHEN regexp_matches(lower(title), 'tabella|elenco|lista') THEN 'table' WHEN regexp_matches(lower(title), 'faq|domande') THEN 'faq' ELSE 'concept' END"""


@query(f"WITH p AS ({PARAMETERS}) SELECT p_partkey, {SECTION_TYPE} AS content_type FROM p")
def classify_section(spark, sf_dir):
    return parameters(spark, sf_dir).select("p_partkey", rules.section_type(F.col("title"), F.col("content")).alias("content_type"))


ASKED = """SELECT conv_id, turn, (['come impostare ', 'errore stampa ', 'procedura per ', 'informazioni su ', 'non funziona ', 'per creare '])[CAST((conv_id + turn) % 6 + 1 AS INTEGER)] || lower(regexp_extract(text, '[A-Za-z]+')) AS q FROM conversations"""
KIND = r"""CASE WHEN regexp_matches(q, '\b(?:errore|error|avviso|warning|codice)\b|\bnon\s+(?:funziona|va|riesco)\b') THEN 'error'
    WHEN regexp_matches(q, '\b(?:param|impostaz|valori|predefin|default|range)\b|\bcome\s+(?:impostare|configurare|settare)\b|\bdove\s+(?:trovo|si trova)\b|\bvalori?\s+(?:ammessi|possibili|consentiti)\b') THEN 'parameter'
    WHEN regexp_matches(q, '\bcome\s+(?:fare|eseguire|effettuare)\b|\b(?:procedura|processo|step|passi)\b|\bper\s+(?:creare|generare|stampare|inviare)\b|\b(?:configurare|impostare)\s+.*\b') THEN 'procedure' ELSE 'general' END"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as questions."""
    starts = F.array(*map(F.lit, ("come impostare ", "errore stampa ", "procedura per ", "informazioni su ", "non funziona ", "per creare ")))
    start = F.element_at(starts, ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(start, F.lower(F.regexp_extract("text", "[A-Za-z]+", 0))).alias("q"))


@query(f"WITH a AS ({ASKED}) SELECT conv_id, turn, {KIND} AS kind FROM a")
def classify_query(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", rules.query_type(F.col("q")).alias("kind"))


@query(f"""WITH a AS ({ASKED}), k AS (SELECT conv_id, turn, {KIND} AS kind FROM a)
    SELECT conv_id, turn, kind, CASE kind WHEN 'error' THEN 20 WHEN 'parameter' THEN 28 WHEN 'procedure' THEN 52 ELSE 40 END AS k_dense, CASE kind WHEN 'error' THEN 40 WHEN 'parameter' THEN 26 WHEN 'procedure' THEN 14 ELSE 20 END AS k_lexical,
    CAST(CASE kind WHEN 'procedure' THEN 1.82 ELSE 1.4 END AS DOUBLE) AS title_boost, CAST(CASE kind WHEN 'parameter' THEN 3.0 ELSE 2.0 END AS DOUBLE) AS param_boost, CAST(CASE kind WHEN 'error' THEN 5.0 ELSE 2.5 END AS DOUBLE) AS code_boost FROM k""")
def route_params(spark, sf_dir):
    rows = asked(spark, sf_dir).select("conv_id", "turn", rules.query_type(F.col("q")).alias("kind"))
    k = F.col("kind")
    return rows.select("*", rules.k_dense(k).alias("k_dense"), rules.k_lexical(k).alias("k_lexical"), F.round(rules.boost(k, "title", 1.4), 4).alias("title_boost"), F.round(rules.boost(k, "param_name", 2.0), 4).alias("param_boost"), F.round(rules.boost(k, "error_code", 2.5), 4).alias("code_boost"))


@query(f"""WITH p AS ({PARAMETERS}), i AS (SELECT p_partkey, nullif(trim(regexp_extract(content, '(?i)(?:valori|opzioni)\\s*[:=]\\s*([^\\n]+)', 1)), '') AS allowed FROM p) SELECT p_partkey, allowed FROM i WHERE allowed IS NOT NULL""")
def parameter_values(spark, sf_dir):
    return parameters(spark, sf_dir).select("p_partkey", rules.parameter_info(F.col("content"))["allowed_values"].alias("allowed")).filter("allowed is not null")


# ---- retrieval --------------------------------------------------------------

TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^a-z]+'), lambda w: w <> '')"


def bm25_sql(docs: str, asked_sql: str, k: int = 10) -> str:
    return f"""WITH d AS ({docs}), a AS ({asked_sql}),
    q AS (SELECT DISTINCT query_id, unnest({TOKENS.format('query')}) AS term FROM a), c AS (SELECT doc_id, {TOKENS.format('text')} AS words FROM d),
    s AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM c), t AS (SELECT doc_id, len(words) AS dl, unnest(words) AS term FROM c),
    tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    w AS (SELECT doc_id, tf.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.55 + 0.55 * dl / avgdl)) AS w FROM tf JOIN df ON tf.term = df.term, s),
    r AS (SELECT query_id, doc_id, round(sum(w), 6) AS score FROM w JOIN q ON w.term = q.term GROUP BY query_id, doc_id)"""


TOP = "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= {}"


def benchmark_bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    asked_rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieve.bm25_topk(asked_rows, read(spark, sf_dir, "documents").select("doc_id", "text"), k)


DOCS, ITEMS = "SELECT doc_id, text FROM documents", "SELECT item_id AS query_id, text AS query FROM benchmark"


@query(bm25_sql(DOCS, ITEMS) + " " + TOP.format(10))
def bm25_topk(spark, sf_dir):
    return benchmark_bm25(spark, sf_dir, 10)


PARTS_ASKED = "SELECT p_partkey AS query_id, p_type || ' ' || p_name AS query FROM part WHERE p_partkey % 100 = 0"


@query("WITH " + ", ".join(f"{f} AS ({bm25_sql(f'SELECT p_partkey AS doc_id, {c} AS text FROM part', PARTS_ASKED)} SELECT query_id, doc_id, score * {w} AS score FROM r)" for f, c, w in (("x", "p_name", 1.4), ("y", "p_type", 1.0), ("z", "p_brand", 1.2))) + ", u AS (SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT * FROM z), r AS (SELECT query_id, doc_id, round(max(score), 4) AS score FROM u GROUP BY query_id, doc_id) " + TOP.format(5))
def bm25_fields_best(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumnRenamed("p_partkey", "doc_id")
    asked_rows = part.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", "p_type", "p_name").alias("query"))
    return retrieve.bm25_fields_topk(asked_rows, part, {"p_name": 1.4, "p_type": 1.0, "p_brand": 1.2}, 5, digits=4)


@query("""WITH v AS (SELECT DISTINCT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS term FROM part), q AS (SELECT DISTINCT left(term, length(term) - 1) AS query_term FROM v WHERE length(term) > 1)
    SELECT query_term, term, levenshtein(query_term, term) AS edits FROM q, v WHERE levenshtein(query_term, term) <= CASE WHEN length(query_term) <= 2 THEN 0 WHEN length(query_term) <= 5 THEN 1 ELSE 2 END""")
def fuzzy_terms(spark, sf_dir):
    v = read(spark, sf_dir, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("term")).distinct()
    found = retrieve.fuzzy_terms(v.filter(F.length("term") > 1).select(F.expr("left(term, length(term) - 1)").alias("query_term")), v)
    return found.withColumn("edits", F.col("edits").cast("long"))


DENSE = """WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0), r AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS s FROM q, embeddings e)"""


@query(DENSE + " SELECT query_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM r WHERE s >= 0 QUALIFY rank <= 10")
def dense_topk(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return retrieve.dense_topk(v.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), v, 10).withColumn("score", F.round("score", 6))


@query(DENSE + " SELECT query_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM r WHERE s >= 0.1 AND label BETWEEN 2 AND 5 QUALIFY rank <= 5")
def dense_topk_filtered(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    kept = v.filter(retrieve.metadata_filter({"label": {"min": 2, "max": 5}}))
    return retrieve.dense_topk(v.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), kept, 5, 0.1).withColumn("score", F.round("score", 6))


LISTS = """d AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, CAST(o_totalprice AS DOUBLE) AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_orderkey % 3 <> 0),
    x AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, CAST(o_orderkey % 97 + 1 AS DOUBLE) AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 97 DESC, o_orderkey) AS rank FROM orders WHERE o_orderkey % 3 <> 1),
    dn AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS s FROM d), xn AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS s FROM x),
    f AS (SELECT coalesce(dn.query_id, xn.query_id) AS query_id, coalesce(dn.doc_id, xn.doc_id) AS doc_id, CASE WHEN dn.s IS NOT NULL AND xn.s IS NOT NULL THEN dn.s * 0.6 + xn.s * 0.4 ELSE coalesce(dn.s, xn.s) END AS score,
          CASE WHEN xn.s IS NULL THEN 'vector' WHEN dn.s IS NULL THEN 'lexical' ELSE 'hybrid' END AS origin, dn.rank AS dr, xn.rank AS xr FROM dn FULL JOIN xn ON dn.query_id = xn.query_id AND dn.doc_id = xn.doc_id),
    fused AS (SELECT query_id, doc_id, score, origin, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr IS NULL, coalesce(dr, xr), doc_id) AS rank FROM f)"""


def lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders of each customer as two ranked lists."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").cast("double").alias("price"))
    rank = lambda by: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "doc_id"))
    d = o.filter("doc_id % 3 != 0").withColumn("score", F.col("price")).withColumn("rank", rank("score"))
    x = o.filter("doc_id % 3 != 1").withColumn("score", (F.col("doc_id") % 97 + 1).cast("double")).withColumn("rank", rank("score"))
    return d.select("query_id", "doc_id", "score", "rank"), x.select("query_id", "doc_id", "score", "rank")


def fused_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.fused(*lists(spark, sf_dir))


def section() -> F.Column:
    return F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string"))


@query(f"WITH {LISTS} SELECT query_id, doc_id, round(score, 6) AS score, origin, rank FROM fused")
def hybrid_fuse(spark, sf_dir):
    return fused_rows(spark, sf_dir).withColumn("score", F.round("score", 6)).select("query_id", "doc_id", "score", "origin", "rank")


@query(f"""WITH {LISTS}, p AS (SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id, doc_id % 4 ORDER BY rank) AS place FROM fused)
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM p WHERE rank <= 5 OR place <= 2""")
def diversify(spark, sf_dir):
    rows = fused_rows(spark, sf_dir).withColumn("section_path", section())
    return retrieve.diversified(rows, k_final=5).select("query_id", "doc_id", "rank")


@query(f"""WITH {LISTS}, c AS (SELECT *, doc_id % 11 = 0 AS img FROM fused WHERE score >= 0.4 OR doc_id % 11 = 0), b AS (SELECT *, first_value(score) OVER (PARTITION BY query_id ORDER BY rank) AS best FROM c),
    e AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id % 4 ORDER BY rank) AS place FROM b WHERE img OR best - score <= 0.35)
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM e WHERE place = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 6""")
def quality_filter(spark, sf_dir):
    rows = fused_rows(spark, sf_dir).withColumns({"section_path": section(), "n_images": (F.col("doc_id") % 11 == 0).cast("int")})
    return answer.quality_filtered(rows).select("query_id", "doc_id", "rank")


@query(f"""WITH {LISTS}, g AS (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS best, avg(score) AS mean, count(*) AS n FROM fused GROUP BY query_id)
    SELECT query_id, round(least((0.4 * best + 0.3 * least(mean * 1.2, 1.0) + 0.2 * least(n / 3.0, 1.0) + 0.1 * 1.0) * 0.7, 1.0), 6) AS confidence FROM g""")
def confidence(spark, sf_dir):
    return answer.confidences(fused_rows(spark, sf_dir), F.lit("Risposta dettagliata con Fonti: [1][2][3]")).withColumn("confidence", F.round("confidence", 6))


@query(f"""{bm25_sql(DOCS, ITEMS)}, k AS ({TOP.format(20)}),
    o AS (SELECT k.*, count(*) OVER (PARTITION BY k.query_id) AS n, list_distinct({TOKENS.format('a.query')}) AS qw, {TOKENS.format('d.text')} AS dw FROM k JOIN a ON k.query_id = a.query_id JOIN d ON k.doc_id = d.doc_id),
    b AS (SELECT query_id, doc_id, rank AS r0, CASE WHEN n > 10 THEN (1 - 0.7) * score + 0.7 * CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, dw)) / len(qw) ELSE 0 END ELSE score END AS s FROM o)
    SELECT query_id, doc_id, round(s, 3) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, r0) AS rank FROM b""")
def rerank_blend(spark, sf_dir):
    first = benchmark_bm25(spark, sf_dir, 20)
    asked_rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    rows = read(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(first), "doc_id").join(asked_rows, "query_id")
    out = retrieve.reranked(rows, lambda q, t: F.round(retrieve.overlap_score(q, t), 12))
    return out.select("query_id", "doc_id", F.round("score", 3).alias("score"), "rank")


# ---- tables -----------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey, 'u' || CAST(o_custkey AS VARCHAR) AS source_url, o_orderstatus FROM orders), n AS (SELECT o_orderkey + 10000000 AS o_orderkey, source_url, 'N' AS o_orderstatus FROM o WHERE o_orderkey % 5 = 0)
    SELECT * FROM o WHERE source_url NOT IN (SELECT source_url FROM n) UNION ALL SELECT * FROM n""")
def replace_by_url(spark, sf_dir):
    old = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("source_url"), "o_orderstatus")
    new = old.filter("o_orderkey % 5 = 0").select((F.col("o_orderkey") + 10000000).alias("o_orderkey"), "source_url", F.lit("N").alias("o_orderstatus"))
    return index.replace_by_url(old, new)


@query("SELECT c_custkey AS source_url, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def delete_by_url_counts(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_url"))
    return index.counts_by_url(orders, read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_url")))


@query("SELECT c_custkey AS image_id, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_anti(spark, sf_dir):
    files = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"), "c_name")
    return index.without_orphans(files, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image_id")))[1]


SECTIONS = "s AS (SELECT l_orderkey AS doc, l_linenumber AS section_pos, l_linenumber AS page_start, l_linenumber + CAST(l_quantity AS INTEGER) % 4 AS page_end FROM lineitem), i AS (SELECT l_orderkey AS doc, l_linenumber AS item, CAST(l_quantity AS INTEGER) % 8 AS page FROM lineitem)"


def spans_of_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = read(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    return li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("item"), (q % 8).alias("page")), li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("section_pos"), F.col("l_linenumber").alias("page_start"), (F.col("l_linenumber") + q % 4).alias("page_end"))


@query(f"WITH {SECTIONS} SELECT i.doc, item, page, section_pos FROM i JOIN s ON i.doc = s.doc AND page BETWEEN page_start AND page_end WHERE page > 0")
def page_range_join(spark, sf_dir):
    return index.covering_sections(*spans_of_pages(spark, sf_dir), "doc", "page").select("doc", "item", "page", "section_pos")


@query(f"WITH {SECTIONS} SELECT i.doc, item, min(section_pos) AS section_pos FROM i JOIN s ON i.doc = s.doc AND page BETWEEN page_start AND page_end WHERE page > 0 GROUP BY 1, 2")
def first_section_join(spark, sf_dir):
    return index.first_section(*spans_of_pages(spark, sf_dir), "doc", "page", ["doc", "item"])


@query("""WITH f AS (SELECT l_orderkey AS id, (['webp', 'jpg', 'png', 'bmp', 'gif'])[CAST(l_partkey % 5 + 1 AS INTEGER)] AS ext FROM lineitem)
    SELECT id, arg_min(ext, list_position(['png', 'jpg', 'jpeg', 'gif', 'webp'], ext)) AS ext FROM f WHERE ext <> 'bmp' GROUP BY id""")
def ext_priority_lookup(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, ("webp", "jpg", "png", "bmp", "gif"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    return index.best_extension(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), ext.alias("ext")), ["id"])


@query("SELECT o_orderpriority AS source_hash, count(*) AS n_images, CAST(sum(o_orderkey) AS BIGINT) AS n_bytes, round(sum(o_orderkey) / (1024 * 1024), 2) AS n_mb FROM orders GROUP BY 1")
def storage_stats(spark, sf_dir):
    return index.storage(read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "source_hash"), "source_hash", "o_orderkey")


# ---- page documents ---------------------------------------------------------

SPANS = """sp AS (SELECT l_orderkey AS doc_id, l_linenumber - 1 AS page, CAST(l_partkey % 5 AS INTEGER) AS block, 0 AS line, l_linenumber AS span, 'F' || CAST(l_suppkey % 2 AS VARCHAR) AS font, CAST(10 + l_partkey % 3 * 4 AS DOUBLE) AS size, CAST(l_suppkey % 3 * 8 AS INTEGER) AS flags, 'voce ' || l_returnflag || l_linestatus || ' del documento numero ' || CAST(l_partkey AS VARCHAR) AS text FROM lineitem)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("page"), (F.col("l_partkey") % 5).cast("int").alias("block"), F.lit(0).alias("line"), F.col("l_linenumber").alias("span"), F.concat(F.lit("F"), (F.col("l_suppkey") % 2).cast("string")).alias("font"), (10 + F.col("l_partkey") % 3 * 4).cast("double").alias("size"), (F.col("l_suppkey") % 3 * 8).cast("int").alias("flags"), F.concat(F.lit("voce "), "l_returnflag", "l_linestatus", F.lit(" del documento numero "), F.col("l_partkey").cast("string")).alias("text"))


@query(f"""WITH {SPANS}, g AS (SELECT doc_id, lower(font) AS font, size, flags, count(*) AS count, list(CAST(length(trim(text)) AS DOUBLE) ORDER BY page, block, line, span, length(trim(text))) AS ls FROM sp WHERE page < 5 GROUP BY 1, 2, 3, 4),
    a AS (SELECT doc_id, font, size, flags, count, list_reduce(list_prepend(CAST(0 AS DOUBLE), ls), lambda a, x: (a + x) / 2) AS avg_length FROM g), m AS (SELECT doc_id, avg(size) AS mean, max(size) AS top, count(*) AS keys FROM a GROUP BY doc_id)
    SELECT a.doc_id, font, size, flags, count, round(avg_length, 6) AS avg_length, (size >= mean + 2 OR (flags & 16) <> 0) AND (avg_length < 50 OR count < 0.1 * keys) AS is_heading, CAST(least(floor((top - size) / 2) + 1, 6) AS INTEGER) AS level FROM a JOIN m ON a.doc_id = m.doc_id""")
def font_stats(spark, sf_dir):
    return pdf.font_stats(spans(spark, sf_dir)).withColumn("avg_length", F.round("avg_length", 6))


@query(f"""WITH {SPANS}, h AS (SELECT doc_id, page, block, max(text) AS text, max(size) >= 18 AS head FROM sp GROUP BY 1, 2, 3), g AS (SELECT *, CAST(sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY page, block) AS BIGINT) AS section FROM h),
    o AS (SELECT doc_id, section, max(text) FILTER (WHERE head) AS title, min(page) AS page_start, coalesce(max(page) FILTER (WHERE NOT head), max(page)) AS page_end, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page, block, text) FILTER (WHERE NOT head), '') AS content FROM g WHERE section > 0 GROUP BY 1, 2)
    SELECT doc_id, section, title, page_start, page_end, replace(content, chr(10) || chr(10), ' ') AS content FROM o WHERE length(content) > 50""")
def pdf_islands(spark, sf_dir):
    blocks = spans(spark, sf_dir).groupBy("doc_id", "page", "block").agg(F.max("text").alias("text"), (F.max("size") >= 18).alias("is_heading"), F.lit(1).alias("level"))
    return pdf.sections(blocks).drop("level")


# ---- answers ----------------------------------------------------------------

RANKED = "r AS (SELECT source AS query_id, text AS content, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, lang FROM documents)"


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("text").alias("content"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank"), F.array("lang", F.concat(F.lit("x"), "lang")).alias("breadcrumbs"))


@query(f"WITH {RANKED}, s AS (SELECT query_id, rank, sum(length(content) // 4) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM r WHERE rank <= 6) SELECT query_id, rank, CAST(used AS BIGINT) AS used FROM s WHERE used <= 2000")
def context_packing(spark, sf_dir):
    return chunking.token_prefix(ranked(spark, sf_dir), 2000).select("query_id", "rank", F.col("used").cast("long").alias("used"))


@query(f"""WITH {RANKED}, d AS (SELECT query_id, content, min(rank) AS rank FROM r WHERE rank <= 5 GROUP BY 1, 2), h AS (SELECT *, left(content, 600) AS head, 600 - instr(reverse(left(content, 600)), '.') AS stop FROM d),
    t AS (SELECT query_id, rank, CASE WHEN length(content) <= 800 THEN content WHEN instr(head, '.') > 0 AND stop > 400 THEN left(head, stop + 1) ELSE head || '...' END AS part FROM h)
    SELECT query_id, string_agg(part, chr(10) || chr(10) ORDER BY rank) AS combined FROM t GROUP BY query_id""")
def combine_content(spark, sf_dir):
    return answer.combined_content(ranked(spark, sf_dir))


@query(f"WITH {RANKED}, b AS (SELECT DISTINCT query_id, unnest([lang, 'x' || lang]) AS t FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY t) AS i FROM b) SELECT query_id, string_agg(t, ',' ORDER BY i) AS topics FROM o WHERE i <= 5 GROUP BY query_id")
def related_topics(spark, sf_dir):
    return answer.related_topics(ranked(spark, sf_dir)).select("query_id", F.array_join("topics", ",").alias("topics"))


@query()
def packed_chunks(spark, sf_dir):
    spaced = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.packed(text.split_paragraphs(spaced), 200)).alias("pos", "chunk"))


# ---- statistics -------------------------------------------------------------


@query(f"WITH a AS ({ASKED}), k AS (SELECT {KIND} AS kind FROM a), n AS (SELECT kind AS value, count(*) AS n FROM k GROUP BY 1) SELECT value, n, CAST(floor(100 * n / sum(n) OVER () + 0.5) AS INTEGER) AS pct FROM n")
def query_type_distribution(spark, sf_dir):
    return analytics.distribution(asked(spark, sf_dir).select(rules.query_type(F.col("q")).alias("kind")), "kind")


@query("SELECT round(avg(coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END, 0)), 6) AS avg_confidence FROM events")
def avg_confidence(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value")).alias("confidence"))
    return analytics.average_confidence(rows).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("SELECT count(*) AS n, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(doc_id % 100 / 100.0), 6) AS mean_confidence, round(avg(CASE WHEN doc_id % 5 > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM labels")
def eval_report(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").select(F.col("quality").alias("expected"), F.col("toxic").alias("predicted"), (F.col("doc_id") % 100 / 100.0).alias("confidence"), (F.col("doc_id") % 5).alias("n_sources"))
    out = analytics.evaluation(rows)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "mean_confidence", "coverage")])


@query("SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT) AS n, substr(text, greatest(instr(lower(text), 'the') - 50, 1), 103) AS snippet FROM documents WHERE contains(lower(text), 'the')")
def keyword_context(spark, sf_dir):
    return analytics.keyword_context(read(spark, sf_dir, "documents"), "doc_id", "text", "the")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i <= 5")
def recent_history(spark, sf_dir):
    return index.recent(read(spark, sf_dir, "events"), "ts", 5, "event_id", "user_id").select("user_id", "event_id")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS in_window, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) <= 2 AS within FROM events")
def sliding_rate(spark, sf_dir):
    return analytics.sliding_counts(read(spark, sf_dir, "events"), "user_id", "ts", 3600, 2).select("event_id", "in_window", "within")


@query("""WITH l AS (SELECT user_id, list({'t': epoch_us(ts), 'i': event_id} ORDER BY ts, event_id) AS c FROM events GROUP BY user_id),
    s AS (SELECT user_id, c, list_reduce(list_transform(c, lambda x: [x.t]), lambda acc, x: list_append(acc, greatest(x[1], acc[-1], CASE WHEN len(acc) >= 3 THEN acc[len(acc) - 2] + 7200000000 ELSE 0 END))) AS s FROM l)
    SELECT unnest(list_transform(c, lambda x: x.i)) AS event_id, unnest(s) AS start FROM s""")
def admitted_calls(spark, sf_dir):
    """At most three events of a user begin in two hours; the others wait."""
    found = analytics.admitted(read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3, 7200, "event_id")
    return found.select("event_id", F.unix_micros("start").alias("start"))


@query("SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_events(spark, sf_dir):
    return streams.tumbling(read(spark, sf_dir, "events")).withColumn("window_start", F.unix_timestamp("window_start"))


@query("WITH w AS (SELECT unnest([0, 1, 2, 3]) AS k), e AS (SELECT (epoch(time_bucket(INTERVAL 15 MINUTE, ts)) - 900 * k)::BIGINT AS window_start FROM events, w) SELECT window_start, count(*) AS n FROM e GROUP BY 1")
def sliding_events(spark, sf_dir):
    return streams.sliding(read(spark, sf_dir, "events")).withColumn("window_start", F.unix_timestamp("window_start"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts))::BIGINT AS session_start, count(*) AS n_events FROM s GROUP BY user_id, k""")
def session_events(spark, sf_dir):
    return streams.sessions(read(spark, sf_dir, "events")).withColumn("session_start", F.unix_micros(F.col("session_start").cast("timestamp")))


# ---- relational cover -------------------------------------------------------


@query("SELECT p_brand, p_type, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY ROLLUP (p_type, p_brand)")
def rollup_types(spark, sf_dir):
    return read(spark, sf_dir, "part").rollup("p_type", "p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_types(spark, sf_dir):
    return read(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey % 2 = 0")
def set_except(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).subtract(read(spark, sf_dir, "supplier").filter("s_nationkey % 2 = 0").select("s_nationkey"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join(spark, sf_dir):
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(event_id) AS v FROM events WHERE event_type = 'click' GROUP BY 1, 2)
    SELECT event_id, coalesce(v, -1) AS last_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_last_event(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    right = e.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("v"))
    return analytics.last_before(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), right, "user_id", "ts", "v").select("event_id", F.coalesce("last_value", F.lit(-1)).alias("last_value"))


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN lower(url) ELSE url END AS url, html FROM pages), u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS i FROM p), c AS (SELECT page_id, row_number() OVER (PARTITION BY html ORDER BY page_id) AS j FROM u WHERE i = 1) SELECT page_id FROM c WHERE j = 1""")
def crawl_dedup(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.lower("url")).otherwise(F.col("url")).alias("url"), F.col("html").alias("content"), F.lit("text/html").alias("content_type"))
    return crawl.crawled(p).select("page_id")


# ---- the whole search -------------------------------------------------------

STARTS = "(['errore ', 'come impostare ', 'procedura ', ''])[CAST(item_id % 4 + 1 AS INTEGER)]"
ASKED_ITEMS = f"SELECT item_id AS query_id, {STARTS} || text AS query FROM benchmark"
CHUNKS = "SELECT doc_id, 'Sezione ' || source AS title, text, 's' || CAST(doc_id % 4 AS VARCHAR) AS section_path FROM documents"


@query(f"""{bm25_sql(CHUNKS, ASKED_ITEMS)}, kk AS (SELECT query_id, query, {KIND} AS kind FROM (SELECT query_id, query, lower(query) AS q FROM a)),
    k AS (SELECT *, CASE kind WHEN 'error' THEN 20 WHEN 'parameter' THEN 28 WHEN 'procedure' THEN 52 ELSE 40 END AS kd, CASE kind WHEN 'error' THEN 40 WHEN 'parameter' THEN 26 WHEN 'procedure' THEN 14 ELSE 20 END AS kx FROM kk),
    cs AS (SELECT k.query_id, e.vec_id AS doc_id, kd, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score FROM k JOIN embeddings v ON v.vec_id = k.query_id, embeddings e),
    dn AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS s FROM (SELECT query_id, doc_id, score, kd, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs WHERE score >= 0) WHERE rank <= kd),
    xn AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS s FROM (SELECT r.query_id, r.doc_id, score, kx, row_number() OVER (PARTITION BY r.query_id ORDER BY score DESC, r.doc_id) AS rank FROM r JOIN k ON r.query_id = k.query_id) WHERE rank <= kx),
    f AS (SELECT coalesce(dn.query_id, xn.query_id) AS query_id, coalesce(dn.doc_id, xn.doc_id) AS doc_id, CASE WHEN dn.s IS NOT NULL AND xn.s IS NOT NULL THEN dn.s * 0.6 + xn.s * 0.4 ELSE coalesce(dn.s, xn.s) END AS score,
          CASE WHEN xn.s IS NULL THEN 'vector' WHEN dn.s IS NULL THEN 'lexical' ELSE 'hybrid' END AS origin, dn.rank AS dr, xn.rank AS xr FROM dn FULL JOIN xn ON dn.query_id = xn.query_id AND dn.doc_id = xn.doc_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr IS NULL, coalesce(dr, xr), doc_id) AS r0 FROM f),
    m AS (SELECT o.query_id, o.doc_id, k.kind, o.origin, o.score, o.r0, c.section_path, count(*) OVER (PARTITION BY o.query_id) AS n, list_distinct({TOKENS.format('k.query')}) AS qw, {TOKENS.format("coalesce(c.title, '') || '. ' || substring(c.text, 1, 200)")} AS dw FROM o JOIN k ON o.query_id = k.query_id JOIN d c ON o.doc_id = c.doc_id),
    b AS (SELECT *, CASE WHEN n > 10 THEN CAST(0.30000000000000004 AS DOUBLE) * score + CAST(0.7 AS DOUBLE) * CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, dw)) / len(qw) ELSE 0 END ELSE score END AS blended FROM m),
    p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, r0) AS r1 FROM b), g AS (SELECT *, row_number() OVER (PARTITION BY query_id, section_path ORDER BY r1) AS place FROM p),
    z AS (SELECT query_id, doc_id, kind, origin, round(blended, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY r1) AS rank FROM g WHERE r1 <= 5 OR place <= 2) SELECT * FROM z WHERE rank <= 10""")
def search_topk(spark, sf_dir):
    """Benchmark items as questions of all types over documents and embeddings of the same ids."""
    start = F.element_at(F.array(*map(F.lit, ("errore ", "come impostare ", "procedura ", ""))), (F.col("item_id") % 4 + 1).cast("int"))
    asked_rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(start, "text").alias("query"))
    chunks = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Sezione "), "source").alias("title"), "text", section().alias("section_path"))
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    own = v.withColumnRenamed("vec_id", "query_id").join(asked_rows.select("query_id"), "query_id", "left_semi")
    return retrieve.search(asked_rows, chunks, own, v, w=Retrieval(k_final=5)).withColumn("score", F.round("score", 6))


# ---- facts that answers are made of -----------------------------------------


def part_texts(spark: SparkSession, sf_dir: str, *lines: F.Column) -> DataFrame:
    return read(spark, sf_dir, "part").withColumn("content", F.concat_ws("\n", *lines))


def lit(text: str, *more) -> F.Column:
    return F.concat(F.lit(text), *more)


@query("SELECT p_partkey, p_name || '|' || p_type || '|' || p_brand || '|ultimo' AS steps, p_type AS prerequisites, CAST(p_size AS VARCHAR) AS warnings FROM part")
def procedure_steps(spark, sf_dir):
    rows = part_texts(spark, sf_dir, lit("1. ", "p_name"), lit("  2)  ", "p_type"), lit("- ", "p_brand"), lit("passo 3 ", "p_name"), lit("• ultimo"), lit("Prerequisiti: ", "p_type"), lit("Attenzione! ", F.col("p_size").cast("string")))
    info = rules.procedure_info(F.col("content"))
    return rows.select("p_partkey", F.array_join(info["steps"], "|").alias("steps"), info["prerequisites"].alias("prerequisites"), info["warnings"].alias("warnings"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'messaggio ' || p_name END AS message, p_type AS cause,
    CASE WHEN p_partkey % 2 = 0 THEN 'Aprire ' || p_brand || '|Chiudere|Riavviare' ELSE 'Primo|' || p_name END AS resolution FROM part""")
def error_facts(spark, sf_dir):
    even = F.concat_ws("\n", lit("Soluzione: Aprire ", "p_brand"), F.lit("1. Chiudere"), F.lit("nota"), F.lit("2) Riavviare"), F.lit(""), F.lit("3. fuori"))
    odd = F.concat_ws("\n", F.lit("Per risolvere: 1. Primo"), lit("2. ", "p_name"))
    rows = part_texts(spark, sf_dir, F.lit("Vedi WRN-9: altro"), lit("Codice ERR-001: messaggio ", "p_name"), lit("Causa: ", "p_type"), F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd))
    info = rules.error_info(F.col("content"), F.when(F.col("p_partkey") % 3 == 0, F.lit("ERR-002")).otherwise(F.lit("ERR-001")))
    return rows.select("p_partkey", info["message"].alias("message"), info["cause"].alias("cause"), F.array_join(info["resolution"], "|").alias("resolution"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'uno|' || p_name || '|tre|quattro' WHEN 1 THEN 'Calcolando uno due tre quattro cinque sei sette otto|Generando ' || p_brand || ' in modo completo'
    WHEN 2 THEN 'Permette la gestione di ' || p_name ELSE 'Titolo ' || p_name END AS points FROM part""")
def key_points(spark, sf_dir):
    kinds = [F.concat_ws("\n", F.lit("- uno"), lit("* ", "p_name"), F.lit("testo"), F.lit("• tre"), F.lit("- quattro"), F.lit("- cinque")),
             F.concat(F.lit("Si lavora calcolando uno due tre quattro cinque sei sette otto nove GENERANDO "), "p_brand", F.lit(" in modo completo")),
             F.concat(F.lit("Il modulo permette la gestione di "), "p_name", F.lit(". Include poco.")),
             F.concat(F.lit("a" * 110 + ".\nTitolo "), "p_name")]
    rows = read(spark, sf_dir, "part").withColumn("content", F.element_at(F.array(*kinds), (F.col("p_partkey") % 4 + 1).cast("int")))
    return rows.select("p_partkey", F.array_join(rules.key_points(F.col("content")), "|").alias("points"))


@query("""SELECT p_partkey, 'La prima frase parla di ' || p_name || '. La seconda frase di ' || p_type || '! Una terza frase qui?' || CASE p_partkey % 3 WHEN 0 THEN ' Ultima frase abbastanza lunga.' ELSE '' END AS summary FROM part""")
def section_summary(spark, sf_dir):
    last = F.element_at(F.array(F.lit(" Ultima frase abbastanza lunga."), F.lit(" Per altro si vedi il manuale."), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int"))
    text_of = F.concat(F.lit("La prima frase parla di "), "p_name", F.lit(". La seconda frase di "), "p_type", F.lit("! Una terza frase qui? Corta frase. Altra frase quarta. Altra frase quinta."), last)
    return read(spark, sf_dir, "part").select("p_partkey", chunking.summary(text_of).alias("summary"))


@query(f"""WITH a AS ({ASKED}), k AS (SELECT conv_id, turn, q, {KIND} AS kind FROM a)
    SELECT conv_id, turn, (CASE WHEN length(q) > 50 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(q), 'come|perché|perchè|spiegare|spiegami|differenza|confronto|esempi|procedura completa|passo passo|dettagli') THEN 2 ELSE 0 END + CASE WHEN kind = 'general' THEN 1 ELSE 0 END) >= 2 AS complex FROM k""")
def wants_model(spark, sf_dir):
    rows = asked(spark, sf_dir)
    return rows.select("conv_id", "turn", rules.wants_model(F.col("q"), rules.query_type(F.col("q"))).alias("complex"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand[1]) || lower(substring(regexp_extract(lower(p_brand), '^[^ ]+'), 2)) END AS param, 'ERR-' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS code FROM part")
def question_names(spark, sf_dir):
    number = F.concat(F.lit("err-"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"))
    q = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("quale Parametro \""), F.split("p_brand", " ")[0], F.lit("\" per "))).otherwise(F.lit("cosa vuol dire ")), number)
    return read(spark, sf_dir, "part").select("p_partkey", rules.query_param_name(q).alias("param"), rules.query_error_code(q, F.lit(None).cast("string")).alias("code"))


@query("SELECT page_id, length(html) < 800 OR regexp_matches(lower(url), 'menu|navigation|header|footer|sidebar|cookie|privacy|copyright|condividi|share') AS skipped FROM pages")
def skipped_pages(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", rules.skipped_section(F.col("url"), F.col("html"), 800).alias("skipped"))


@query(r"""SELECT doc_id, coalesce(list_aggregate(list_sort(list_distinct(list_filter(regexp_extract_all(text, '\d{3,}'), lambda x: x NOT IN ('000', '100', CAST(n_chars AS VARCHAR))))), 'string_agg', ','), '') AS unsupported,
    length(text) >= 50 AND NOT contains(text, '{{') AND NOT contains(text, '}}') AS valid FROM documents WHERE text IS NOT NULL""")
def answer_checks(spark, sf_dir):
    sources = F.concat_ws(" ", F.lit("000 100"), F.when(F.length(F.col("n_chars").cast("string")) > 2, F.col("n_chars").cast("string")))
    rows = read(spark, sf_dir, "documents").filter("text is not null")
    return rows.select("doc_id", F.array_join(F.sort_array(rules.unsupported_numbers(F.col("text"), sources)), ",").alias("unsupported"), rules.valid_answer(F.col("text")).alias("valid"))


@query(f"WITH {LISTS} SELECT query_id, max(score) >= 0.9 AS sufficient FROM fused GROUP BY query_id")
def sufficient_context(spark, sf_dir):
    return answer.sufficient(fused_rows(spark, sf_dir), 0.9)


@query(f"WITH {LISTS} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM fused WHERE score > 0.5 QUALIFY place <= 3")
def fallback_suggestions(spark, sf_dir):
    return answer.suggestions(fused_rows(spark, sf_dir), 0.5).select("query_id", "doc_id", "place")


# ---- chunks in tables -------------------------------------------------------


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    parent = F.when(k % 5 != 0, lit("c", (k - k % 5).cast("string")))
    return read(spark, sf_dir, "part").select(lit("c", k.cast("string")).alias("chunk_id"), parent.alias("parent_chunk_id"), lit("http://x/", "p_brand").alias("source_url"), "p_name")


STORED = "c AS (SELECT 'c' || CAST(p_partkey AS VARCHAR) AS chunk_id, CASE WHEN p_partkey % 5 <> 0 THEN 'c' || CAST(p_partkey - p_partkey % 5 AS VARCHAR) END AS parent_chunk_id, 'http://x/' || p_brand AS source_url, p_name FROM part)"


@query(f"WITH {STORED}, k AS (SELECT parent_chunk_id AS chunk_id, string_agg(chunk_id, ',' ORDER BY chunk_id) AS children FROM c WHERE parent_chunk_id IS NOT NULL GROUP BY 1) SELECT c.chunk_id, children FROM c LEFT JOIN k ON c.chunk_id = k.chunk_id")
def parent_links(spark, sf_dir):
    return index.parents(stored(spark, sf_dir)).select("chunk_id", F.array_join("child_chunk_ids", ",").alias("children"))


@query(f"WITH {STORED} SELECT chunk_id, source_url, p_name FROM c WHERE chunk_id IN (SELECT 'c' || CAST(p_partkey * 7 AS VARCHAR) FROM part)")
def lookup_chunks(spark, sf_dir):
    ids = read(spark, sf_dir, "part").select(lit("c", (F.col("p_partkey") * 7).cast("string")).alias("chunk_id"))
    return index.lookup(stored(spark, sf_dir), ids).select("chunk_id", "source_url", "p_name")


@query(f"WITH {STORED} SELECT chunk_id, source_url FROM c WHERE source_url NOT IN (SELECT 'http://x/' || p_brand FROM part WHERE p_size > 45 AND p_brand LIKE '%3')")
def delete_by_url(spark, sf_dir):
    urls = read(spark, sf_dir, "part").filter("p_size > 45 and p_brand like '%3'").select(lit("http://x/", "p_brand").alias("source_url"))
    return index.delete_by_url(stored(spark, sf_dir), urls).select("chunk_id", "source_url")


@query("SELECT count(*) AS n_rows, max(len(embedding)) AS vector_size FROM embeddings")
def table_stats(spark, sf_dir):
    return analytics.table_stats(read(spark, sf_dir, "embeddings"), "embedding").withColumn("vector_size", F.col("vector_size").cast("long"))


@query("""WITH d AS (SELECT source, doc_id, doc_id % 3 + CASE WHEN source LIKE '%1%' THEN doc_id % 40 ELSE 0 END AS figures FROM documents),
    g AS (SELECT source, sum(figures)::BIGINT AS n_figures, avg((doc_id % 100) / 100.0) AS score, count(*) AS n_chunks FROM d GROUP BY source)
    SELECT source, n_figures, round(score, 6) AS mean_score, n_chunks, CASE WHEN n_figures > 50 THEN 'figures' WHEN score < 0.6 THEN 'score' ELSE 'ok' END AS diagnosis FROM g""")
def url_diagnosis(spark, sf_dir):
    figures = F.col("doc_id") % 3 + F.when(F.col("source").like("%1%"), F.col("doc_id") % 40).otherwise(0)
    rows = read(spark, sf_dir, "documents").withColumn("score", (F.col("doc_id") % 100) / 100.0)
    rows = rows.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.repeat(F.lit("\n[Figura: x]"), figures.cast("int"))))
    found = analytics.diagnosis(rows, "source", "text", "score")
    return found.withColumns({"mean_score": F.round("mean_score", 6), "n_figures": F.coalesce("n_figures", F.lit(0)).cast("long")})
