"""Lexical (BM25) and dense top-k, score fusion, re-ranking and diversifying, for many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.rules import K_VALUES, k_dense, k_lexical, query_type
from granary.session import Retrieval
from granary.sources.store import saved


def plain_tokens(text: Column) -> Column:
    """Runs of ASCII letters, in small letters."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")


def top(rows: DataFrame, k: int | Column, by: str = "score", group: str = "query_id", tie: str = "doc_id", rank: str = "rank") -> DataFrame:
    """The k best rows of each group; Spark limits each group before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(F.desc(by), tie))).filter(F.col(rank) <= k)


def bm25(queries: DataFrame, docs: DataFrame, tokens: Callable[[Column], Column] = plain_tokens, k1: float = 0.9, b: float = 0.55) -> DataFrame:
    """query_id, doc_id and score of queries (query_id, query) on documents (doc_id, text).

    Texts are read and cut once: each gives a row for every word and one of the empty word for itself, only asked words and these rows
    are counted, and what is left is kept in the shared folder for the statistics and the scores.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    cut = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    each = cut.select("doc_id", F.size("words").alias("dl"), F.explode(F.array_append(F.coalesce("words", F.array().cast("array<string>")), F.lit(""))).alias("term"))
    asked = q.select("term").union(q.sparkSession.createDataFrame([("",)], "term string")).distinct()
    held = saved(each.join(asked, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")))
    total = held.filter("term = ''").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    tf = held.filter("term != ''")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighed = tf.join(df, "term").join(F.broadcast(total)).select("term", "doc_id", weight.alias("w"))
    return weighed.join(q, "term").groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))


def bm25_fields(queries: DataFrame, docs: DataFrame, boosts: dict[str, float], tokens: Callable[[Column], Column] = plain_tokens, k1: float = 0.9, b: float = 0.55) -> DataFrame:
    """The best boosted field's score for each query and document."""
    parts = [bm25(queries, docs.select("doc_id", F.col(f).alias("text")), tokens, k1, b).withColumn("score", F.col("score") * w) for f, w in boosts.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def questions(queries: DataFrame, tokens: Callable[[Column], Column] = plain_tokens) -> tuple[DataFrame, DataFrame]:
    """(query_id, ask) and (ask, term): questions of the same words are asked once, under the least of their ids."""
    words = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")).groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    asks = saved(words.groupBy("terms").agg(F.min("query_id").alias("ask")))
    return words.join(asks, "terms").select("query_id", "ask"), asks.select("ask", F.explode("terms").alias("term"))


def bm25_topk(
    queries: DataFrame, docs: DataFrame, k: int, tokens: Callable[[Column], Column] = plain_tokens, k1: float = 0.9, b: float = 0.55,
    final: Callable[[Column], Column] = lambda s: F.round(s, 6), pairs: int = 2_000_000,
) -> DataFrame:
    """query_id, doc_id, score and rank of the ``k`` best documents by ``bm25``, scores as ``final`` (which must not fall) makes them.

    Documents with the same counts of the asked words are a class, named by its least id, and score alike, so a class is scored once
    for questions of the same words and its ``k`` least ids stand for all. Questions go to the executors whole; classes are dealt so
    that a task has at most some ``pairs`` of class and question, and no pair is shuffled but the best of each task.
    """
    of, asks = questions(queries, tokens)
    terms = saved(asks.select("term").distinct().withColumn("no", F.row_number().over(Window.orderBy("term"))).union(queries.sparkSession.createDataFrame([("", 0)], "term string, no int")))
    asks = asks.join(terms, "term").select("ask", "no")
    cut = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    each = cut.select("doc_id", F.size("words").alias("dl"), F.explode(F.array_append(F.coalesce("words", F.array().cast("array<string>")), F.lit(""))).alias("term"))
    counts = each.join(F.broadcast(terms), "term").select("doc_id", "dl", "no").repartition("doc_id").groupBy("doc_id", "dl", "no").agg(F.count("*").cast("int").alias("tf"))
    # three lists of plain numbers for a document, a third as large as one list of rows
    lists = counts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("no", "dl", "tf"))).alias("p"))
    held = saved(lists.select("doc_id", "p.no", "p.dl", "p.tf"))
    posts = lambda rows, *keep: rows.select(*keep, F.inline(F.arrays_zip("no", "dl", "tf")))

    every = posts(held).groupBy("no").agg(F.count("*").alias("df"), F.sum("tf").alias("n"), F.sum(F.col("dl") * F.col("tf")).alias("total"), F.sum(F.when(F.col("dl").isNotNull(), F.col("tf"))).alias("known"))
    every = saved(every)  # a row for each asked word
    n_docs, avgdl = next(((r["n"], r["total"] / r["known"] if r["known"] else None) for r in every.filter("no = 0").collect()), (0, None))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl).cast("double")))

    alike = Window.partitionBy("no", "dl", "tf").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    classes = held.withColumns({"place": F.row_number().over(alike), "class": F.first("doc_id").over(alike)}).filter(F.col("place") <= k)
    classes = saved(classes.select("doc_id", "class", *[F.when(F.col("place") == 1, F.col(c)).alias(c) for c in ("no", "dl", "tf")]))
    one = classes.filter("doc_id = class")
    tasks = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-one.count() * asks.select("ask").distinct().count() // pairs))
    rows = posts(one.repartition(tasks, "class"), "class").join(F.broadcast(every.filter("no > 0").select("no", idf.alias("idf"))), "no")
    scored = rows.select("class", "no", weight.alias("w")).join(F.broadcast(asks), "no").groupBy("ask", "class").agg(F.sum("w").alias("score"))
    best = top(scored.withColumn("score", final(F.col("score"))), k, group="ask", tie="class").drop("rank")
    best = top(best.join(classes.select("doc_id", "class"), "class"), k, group="ask")
    return best.join(of, "ask").select("query_id", "doc_id", "score", "rank")


def bm25_fields_topk(queries: DataFrame, docs: DataFrame, boosts: dict[str, float], k: int, tokens: Callable[[Column], Column] = plain_tokens, k1: float = 0.9, b: float = 0.55, digits: int = 6) -> DataFrame:
    """query_id, doc_id, score and rank of the ``k`` best by their best boosted field; each of them is one of the ``k`` best of that field."""
    final = lambda w: lambda s: F.round(F.round(s, 6) * w, digits)
    parts = [bm25_topk(queries, docs.select("doc_id", F.col(f).alias("text")), k, tokens, k1, b, final(w)) for f, w in boosts.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return top(both.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k)


def edits_allowed(term: Column) -> Column:
    return F.when(F.length(term) <= 2, 0).when(F.length(term) <= 5, 1).otherwise(2)


def fuzzy_terms(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """query_term, term and edits of vocabulary terms within the query term's edits.

    Two words within two edits share one of three parts of the query term in a
    place at most two off, so terms are joined on parts and places, never all with all.
    """
    d = edits_allowed(F.col("query_term"))
    q = queries.select("query_term").distinct().withColumn("edits_allowed", d)
    parts = F.transform(F.sequence(F.lit(0), F.col("edits_allowed")), lambda i: F.struct(i.alias("part"), F.floor(i * F.length("query_term") / (F.col("edits_allowed") + 1)).cast("int").alias("at"), F.floor((i + 1) * F.length("query_term") / (F.col("edits_allowed") + 1)).cast("int").alias("to")))
    keyed = q.withColumn("p", F.explode(parts)).withColumn("shift", F.explode(F.sequence(F.lit(-2), F.lit(2)))).filter(F.abs("shift") <= F.col("edits_allowed"))
    keyed = keyed.select("query_term", "edits_allowed", F.expr("substring(query_term, p.at + 1, p.to - p.at)").alias("piece"), (F.col("p.at") + F.col("shift")).alias("place"), (F.col("p.to") - F.col("p.at")).alias("width")).filter("place >= 0 and width > 0")
    widths = keyed.agg(F.collect_set("width")).scalar()  # as many as the longest term asked has letters
    terms = vocabulary.select("term").distinct().withColumn("width", F.explode(widths)).withColumn("place", F.explode(F.expr("sequence(0, greatest(length(term) - width, 0))")))
    pieces = terms.withColumn("piece", F.expr("substring(term, place + 1, width)")).filter(F.length("piece") == F.col("width"))
    met = keyed.join(pieces.select("term", "piece", "place"), ["piece", "place"]).select("query_term", "term", "edits_allowed").distinct()
    return met.withColumn("edits", F.levenshtein("query_term", "term")).filter("edits <= edits_allowed").select("query_term", "term", "edits")


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, least: float = 0.0, block: int = 4096, cells: int = 1_000_000) -> DataFrame:
    """query_id, vec_id and score: cosine top-k of queries (query_id, embedding) on vectors (vec_id, embedding).

    Queries go to the workers in blocks of bounded size; each batch of vectors is multiplied with some of
    them at a time and keeps its own top k, and a window picks the k best of those.
    """

    def unit(a) -> np.ndarray:
        m = np.stack([np.asarray(x, np.float64) for x in a])
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def part(ids: list, held: np.ndarray) -> DataFrame:
        sent = vectors.sparkSession.sparkContext.broadcast((ids, held))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, held = sent.value
            for batch in batches:
                if len(batch):
                    vectors, own, most = unit(batch["embedding"]).T, batch["vec_id"].to_numpy(), min(k, len(batch))
                    step = max(1, cells // len(batch))  # a task holds at most some ``cells`` of the product at once
                    for at in range(0, len(ids), step):
                        some, score = ids[at : at + step], held[at : at + step] @ vectors
                        order = np.lexsort((np.broadcast_to(own, score.shape), -np.round(score, 9)), axis=1)[:, :most]
                        out = pd.DataFrame({"query_id": np.repeat(some, most), "vec_id": own[order].ravel(), "score": np.take_along_axis(score, order, 1).ravel()})
                        yield out[out["score"] >= least]

        return vectors.select("vec_id", "embedding").mapInPandas(run, "query_id long, vec_id long, score double")

    found, ids, held = None, [], []
    for row in queries.select("query_id", "embedding").toLocalIterator():
        ids.append(row["query_id"])
        held.append(row["embedding"])
        if len(ids) == block:
            found = part(ids, unit(held)) if found is None else found.unionByName(part(ids, unit(held)))
            ids, held = [], []
    if ids:
        found = part(ids, unit(held)) if found is None else found.unionByName(part(ids, unit(held)))
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    return top(found.withColumn("score", F.round("score", 9)), k, tie="vec_id")


def fused(dense: DataFrame, lexical: DataFrame, w: Retrieval = Retrieval()) -> DataFrame:
    """query_id, doc_id, score, origin of two ranked lists (query_id, doc_id, score, rank).

    Each list is divided by its best score; a document of both gets the weighted sum,
    one of a single list that list's score.
    """
    best = lambda: F.nullif(F.max("score").over(Window.partitionBy("query_id")), F.lit(0.0))
    d = dense.select("query_id", "doc_id", (F.col("score") / best()).alias("d"), F.col("rank").alias("dr"))
    x = lexical.select("query_id", "doc_id", (F.col("score") / best()).alias("x"), F.col("rank").alias("xr"))
    both = d.join(x, ["query_id", "doc_id"], "full_outer")
    score = F.when(F.col("dr").isNotNull() & F.col("xr").isNotNull(), F.coalesce("d", F.lit(0.0)) * w.dense_weight + F.coalesce("x", F.lit(0.0)) * w.lexical_weight).otherwise(F.coalesce("d", "x", F.lit(0.0)))
    origin = F.when(F.col("xr").isNull(), F.lit("vector")).when(F.col("dr").isNull(), F.lit("lexical")).otherwise(F.lit("hybrid"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("dr").isNull(), F.coalesce("dr", "xr"), "doc_id")
    return both.select("query_id", "doc_id", score.alias("score"), origin.alias("origin"), "dr", "xr").withColumn("rank", F.row_number().over(order)).drop("dr", "xr")


def overlap_score(query: Column, text: Column) -> Column:
    """The default re-ranking model: the share of the query's words that the text has."""
    q = F.array_distinct(plain_tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, plain_tokens(text))) / F.size(q)).otherwise(F.lit(0.0))


def reranked(rows: DataFrame, model: Callable[[Column, Column], Column] = overlap_score, least: int = 10, weight: float = 0.7) -> DataFrame:
    """Blends a model's score of (query, text) into lists of more than ``least`` rows, and ranks again."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    score = F.when(n > least, (1 - weight) * F.col("score") + weight * model(F.col("query"), F.col("text"))).otherwise(F.col("score"))
    out = rows.withColumn("score", score)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")))


def diversified(rows: DataFrame, k_final: int = 10, per_section: int = 2, top_k: int | None = None) -> DataFrame:
    """Keeps the first ``k_final`` rows and the first ``per_section`` of each section; then ranks again."""
    section = F.coalesce(F.nullif(F.col("section_path"), F.lit("")), F.lit("unknown"))
    place = F.row_number().over(Window.partitionBy("query_id", section).orderBy("rank"))
    kept = rows.withColumn("place", place).filter((F.col("rank") <= k_final) | (F.col("place") <= per_section)).drop("place")
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return kept.filter(F.col("rank") <= top_k) if top_k else kept


def search(queries: DataFrame, chunks: DataFrame, query_vectors: DataFrame, vectors: DataFrame, model: Callable[[Column, Column], Column] = overlap_score, w: Retrieval = Retrieval(), top_k: int = 10, tokens: Callable[[Column], Column] = plain_tokens, head: int = 200) -> DataFrame:
    """query_id, doc_id, kind, origin, score and rank: the whole way of a batch of questions.

    Each question (query_id, query) is classified; its type says how many rows the dense list
    (query_vectors, vectors) and the lexical one of chunks (doc_id, title, text, section_path) give;
    both are fused, re-ranked by title and beginning of the text, kept from filling up with one section, and cut.
    """
    kind = query_type(F.col("query"))
    asked = queries.select("query_id", "query", kind.alias("kind"))
    widest = max(d for d, _ in K_VALUES.values())
    of_kind = asked.select("query_id", k_dense(F.col("kind")).alias("kd"), k_lexical(F.col("kind")).alias("kx"))
    dense = dense_topk(query_vectors, vectors, widest).join(of_kind, "query_id").filter(F.col("rank") <= F.col("kd"))
    lexical = bm25_topk(queries, chunks, max(x for _, x in K_VALUES.values()), tokens, w.k1, w.b)
    lexical = lexical.join(of_kind, "query_id").filter(F.col("rank") <= F.col("kx"))
    return merged(asked, chunks, dense.withColumnRenamed("vec_id", "doc_id"), lexical, model, w, top_k, head)


def merged(asked: DataFrame, chunks: DataFrame, dense: DataFrame, lexical: DataFrame, model: Callable[[Column, Column], Column] = overlap_score, w: Retrieval = Retrieval(), top_k: int = 10, head: int = 200) -> DataFrame:
    """query_id, doc_id, kind, origin, score and rank of two ranked lists: fused, re-ranked, diversified and cut."""
    rows = fused(dense, lexical, w).join(asked, "query_id")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.substring("text", 1, head))
    rows = rows.join(chunks.select("doc_id", "section_path", text.alias("text")), "doc_id")
    ranked = diversified(reranked(rows, model, weight=w.model_weight), w.k_final, w.per_section, top_k)
    return ranked.select("query_id", "doc_id", "kind", "origin", "score", "rank")


def metadata_filter(filters: dict | None) -> Column:
    """Equality for values, inclusive ranges for {min, max}; empty values ask for nothing."""
    out = F.lit(True)
    for name, value in (filters or {}).items():
        if isinstance(value, dict):
            for edge, test in (("min", F.col(name) >= F.lit(value.get("min"))), ("max", F.col(name) <= F.lit(value.get("max")))):
                out = out & test if value.get(edge) is not None else out
        elif value:
            out = out & (F.col(name) == F.lit(value))
    return out


def embed(text: Column, dimensions: int = 64) -> Column:
    """The default embedder: hashed counts of words, of unit length."""
    words = plain_tokens(text)
    counts = F.aggregate(words, F.array_repeat(F.lit(0.0), dimensions), lambda acc, w: F.transform(acc, lambda x, i: x + F.when(F.pmod(F.xxhash64(w), F.lit(dimensions)) == i, F.lit(1.0)).otherwise(F.lit(0.0))))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(counts, lambda x: x / norm)).otherwise(counts)
