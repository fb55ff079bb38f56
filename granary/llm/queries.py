"""The queries of the thirteen operators, one for each, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import byte_pair, containment, discriminant, language, line_spread, main_text, order_minhash, quality_cascade, resampling, secret_forest, simhash, toxic_grammar, whitening
from granary.llm.tables import read

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    """The public vocabulary file, where its package puts it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(read(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(read(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.detect_languages(read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.quality_rules(read(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pair.bpe_round_trip(read(spark, sf_dir, "documents"), vocabulary(), digests=True)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminant.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_grammar.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.without_boilerplate(read(spark, sf_dir, "documents")).select("doc_id", "source", "n_removed", "text")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_secret_scan, op2_html_extraction, op3_language_id, op4_quality_rules, op5_bpe, op6_near_duplicates, op7_quality_classifier, op8_decontamination, op9_toxicity, op10_line_dedup, op11_simhash, op12_importance_resampling, op13_embedding_whitening)}

ORACLES: dict[str, str] = {
    "op4_quality_rules": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
        windows AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: {'i': i, 'g': words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]})) AS s FROM w),
        again AS (SELECT doc_id, s.i AS i, count(*) OVER (PARTITION BY doc_id, s.g) AS n FROM windows),
        places AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM again WHERE n > 1),
        repeated AS (SELECT doc_id, sum(least(3, coalesce(after - i, 3))) AS n FROM places GROUP BY doc_id),
        c AS (SELECT w.doc_id, w.text, len(words)::BIGINT AS n_words, len(lines)::BIGINT AS n_lines,
                     length(translate(w.text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
                     (length(w.text) - length(translate(w.text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
                     (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
              FROM w LEFT JOIN repeated r ON w.doc_id = r.doc_id),
        f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
                     length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS capitals,
                     length(text) - length(translate(text, '!?', '')) AS marks,
                     length(text) - length(translate(text, '0123456789', '')) AS digits FROM c)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               (NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
                OR 10 * n_dup_lines > 3 * n_lines OR 10 * capitals > 4 * word_chars OR 4 * marks > n_words OR 10 * digits > 3 * word_chars)) AS kept
        FROM f""",
    "op8_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
        i AS (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
        b AS (SELECT item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
        ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d, (SELECT DISTINCT k FROM b)),
        bs AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM b),
        n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
        m AS (SELECT doc_id, item_id, count(*) AS c FROM ds JOIN bs USING (k, s) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, c::DOUBLE / n AS containment, c::BIGINT AS n_shared FROM m JOIN n USING (item_id) WHERE c >= ceil(0.8 * n - 1e-9)""",
    "op10_line_dedup": r"""
        WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
        k AS (SELECT *, regexp_replace(line, '^[ \t-\r]+|[ \t-\r]+$', '', 'g') AS key, regexp_matches(line, '[^ \t-\r]') AS counts FROM l),
        gone AS (SELECT key, min(doc_id) AS keeper FROM k WHERE counts GROUP BY key HAVING count(DISTINCT site) >= 6),
        kept AS (SELECT doc_id, count(*) FILTER (WHERE drop) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT drop), '') AS text
                 FROM (SELECT k.*, (counts AND keeper IS NOT NULL AND doc_id <> keeper) AS drop FROM k LEFT JOIN gone USING (key)) GROUP BY doc_id)
        SELECT d.doc_id, d.source, coalesce(kept.n_removed, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
        FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op12_importance_resampling": r"""
        WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
        texts AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'b', 0, NULL, coalesce(text, '') FROM benchmark),
        w AS (SELECT side, r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
        f AS (SELECT side, r, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM w),
        h AS (SELECT feature, hex(encode(feature)) AS x FROM (SELECT DISTINCT feature FROM f)),
        bytes AS (SELECT feature, list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT) AS b FROM h),
        bucket AS (SELECT feature, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
        n AS (SELECT side, r, bucket, count(*) AS n FROM f JOIN bucket USING (feature) GROUP BY side, r, bucket),
        c AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0) AS t FROM n GROUP BY bucket),
        gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM c) + 10000))::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM c) + 10000))::DOUBLE)) AS gain FROM c),
        weight AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM n JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r),
        scored AS (SELECT w.doc_id, len(words) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                          ('0x' || sha256('7:' || coalesce(w.doc_id::VARCHAR, 'null'))[1:8])::BIGINT AS x FROM w LEFT JOIN weight USING (r) WHERE side = 'd'),
        s AS (SELECT doc_id, words, n_features, weight, weight + floor(-1000 * ln(-ln((x + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
        k AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS rank FROM s)
        SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND rank <= (SELECT count(*) FROM s WHERE words >= 20) * 25 // 100 THEN rank END AS rank FROM k""",
}
