"""Answers: quality filter, confidence, combined content, templates, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.rules import query_error_code, query_param_name, valid_answer
from granary.operators import templates
from granary.session import Answers

#: Texts of the answers.
NOTHING = "Nessuna informazione trovata per la query specificata."
SYSTEM_PROMPTS = {
    "parameter": "Rispondi sul parametro richiesto: significato, valori ammessi, valore predefinito, vincoli.",
    "procedure": "Rispondi con i passi della procedura, nell'ordine, con prerequisiti e avvertenze.",
    "error": "Rispondi sull'errore: significato, cause, risoluzione.",
    "general": "Rispondi in modo breve, usando solo le fonti indicate.",
}


def quality_filtered(rows: DataFrame, a: Answers = Answers()) -> DataFrame:
    """Rows good enough to answer from, one for each section, ranked again.

    Rows with images are exempt from the least score and from the gap to the first row.
    """
    images = F.coalesce(F.col("n_images"), F.lit(0)) > 0
    rows = rows.filter((F.col("score") >= a.least_score) | images)
    rows = rows.withColumn("best", F.first("score").over(Window.partitionBy("query_id").orderBy("rank")))
    rows = rows.filter(images | (F.col("best") - F.col("score") <= a.widest_gap)).drop("best")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "section_path").orderBy("rank"))).filter("place = 1").drop("place")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= a.most_chunks)


def confidence(best: Column, mean: Column, n: Column, answer: Column) -> Column:
    cited = F.when(F.contains(answer, F.lit("Fonti:")), 1.0).otherwise(0.5)
    size = F.when(F.length(answer) < 100, 0.7).when(F.length(answer) > 2000, 0.8).otherwise(1.0)
    return F.least((0.4 * best + 0.3 * F.least(mean * 1.2, F.lit(1.0)) + 0.2 * F.least(n / 3.0, F.lit(1.0)) + 0.1 * cited) * size, F.lit(1.0))


def confidences(rows: DataFrame, answer: Column) -> DataFrame:
    """query_id and confidence of result lists (query_id, rank, score)."""
    return rows.groupBy("query_id").agg(F.min_by("score", "rank").alias("best"), F.avg("score").alias("mean"), F.count("*").alias("n")).select("query_id", confidence(F.col("best"), F.col("mean"), F.col("n"), answer).alias("confidence"))


def sufficient(rows: DataFrame, least: float = 0.5) -> DataFrame:
    return rows.groupBy("query_id").agg((F.max("score") >= least).alias("sufficient"))


def suggestions(rows: DataFrame, above: float = 0.1, most: int = 3) -> DataFrame:
    kept = rows.filter(F.col("score") > above)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("place") <= most)


def ranked_list(column: str, most: int | None = None) -> Column:
    """The column's values of a group in rank order."""
    out = F.transform(F.array_sort(F.collect_list(F.struct("rank", column))), lambda x: x[column])
    return F.slice(out, 1, most) if most else out


def shortened(text: Column) -> Column:
    """800 characters whole; longer ones to the last full stop of the first 600 past 400, else 600 and an ellipsis."""
    head = F.left(text, F.lit(600))
    stop = F.length(head) - F.instr(F.reverse(head), ".")
    return F.when(F.length(text) <= 800, text).otherwise(F.when((F.instr(head, ".") > 0) & (stop > 400), F.left(head, stop + 1)).otherwise(F.concat(head, F.lit("..."))))


def combined_content(rows: DataFrame, most: int = 5) -> DataFrame:
    """query_id and the different contents of its first rows, shortened, between blank lines."""
    first = rows.filter(F.col("rank") <= most)
    return first.groupBy("query_id").agg(F.array_join(F.transform(F.array_distinct(ranked_list("content")), shortened), "\n\n").alias("combined"))


def related_topics(rows: DataFrame, most: int = 5) -> DataFrame:
    """query_id and the first ``most`` different breadcrumbs of its rows; no more are ever held together."""
    each = rows.select("query_id", F.explode_outer("breadcrumbs").alias("topic")).distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("topic")))
    first = each.withColumn("place", place).filter(F.col("place") <= most)
    return first.groupBy("query_id").agg(F.sort_array(F.collect_list("topic")).alias("topics"))


def prompt(kind: Column, query: Column, context: Column) -> Column:
    system = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in SYSTEM_PROMPTS.items()])
    return F.concat_ws("\n\n", system, F.concat(F.lit("Domanda: "), query), F.concat(F.lit("Contesto:\n"), context))


def answered(results: DataFrame, queries: DataFrame, a: Answers = Answers()) -> DataFrame:
    """One row for each query: answer, confidence and number of sources.

    results: query_id, rank, score, section_path, n_images, title, content, source_url, and where known anchor,
    module, version, ui_path, param_name, error_code and breadcrumbs of the chunks. queries: query_id, query, kind.
    """
    missing = {c: F.lit(None).cast("string") for c in ("anchor", "module", "version", "ui_path", "param_name", "error_code") if c not in results.columns}
    if "breadcrumbs" not in results.columns:
        missing["breadcrumbs"] = F.array().cast("array<string>")
    kept = quality_filtered(results.withColumns(missing) if missing else results, a)
    source = F.struct("title", F.col("source_url").alias("url"), "anchor")
    first = F.struct("title", "content", "module", "version", "ui_path", "param_name", "error_code", "score")
    lists = kept.withColumn("source", source).groupBy("query_id").agg(ranked_list("source").alias("sources"), F.min_by(first, "rank").alias("first"), F.avg("score").alias("mean"), F.count("*").alias("n"))
    met = queries.join(lists.join(combined_content(kept), "query_id").join(related_topics(kept), "query_id", "left"), "query_id", "left")
    facts = {c: F.col(f"first.{c}") for c in ("title", "content", "module", "version", "ui_path")} | {
        "name": F.coalesce(query_param_name(F.col("query")), F.col("first.param_name"), F.col("first.title")),
        "code": query_error_code(F.col("query"), F.col("first.error_code")),
        "combined": F.col("combined"),
        "topics": F.col("topics"),
    }
    met = met.withColumn("text", templates.rendered(F.col("kind"), facts, F.col("sources")))
    best = F.col("first.score")
    good = F.coalesce((best >= a.sufficient) & valid_answer(F.col("text"), a.least_chars), F.lit(False))
    answer = F.when(good, F.col("text")).when(F.col("n").isNull(), F.lit(NOTHING)).otherwise(templates.fallback(F.slice("sources", 1, 3)))
    sure = F.when(good, confidence(best, F.col("mean"), F.col("n"), F.col("text"))).otherwise(F.lit(0.0))
    return met.select("query_id", "query", "kind", answer.alias("answer"), sure.alias("confidence"), F.coalesce("n", F.lit(0)).alias("n_sources"))
