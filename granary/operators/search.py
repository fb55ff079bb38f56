"""The whole search over stored indexes, from a batch of questions to answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.rules import K_VALUES, boost, k_dense, k_lexical, query_type
from granary.operators.answer import answered
from granary.operators.lexical import BOOSTS, expanded
from granary.operators.retrieve import dense_topk, merged, metadata_filter, overlap_score
from granary.operators.stored_lexical import LexicalIndex
from granary.operators.vector_index import VectorIndex
from granary.session import Answers, Retrieval


def typed(queries: DataFrame, fields: tuple[str, ...], w: Retrieval = Retrieval()) -> DataFrame:
    """query_id, query, kind and the boosts of the question's type for the fields and the error code."""
    asked = queries.select("query_id", "query", query_type(F.col("query")).alias("kind"))
    base = {f: w.boosts.get(f, BOOSTS.get(f, 1.0)) for f in (*fields, "error_code")}
    return asked.withColumn("boosts", F.create_map(*[x for f, v in base.items() for x in (F.lit(f), boost(F.col("kind"), f, float(v)))]))


def stored_search(
    queries: DataFrame, chunks: DataFrame, index: LexicalIndex, query_vectors: DataFrame, vectors: DataFrame | VectorIndex, where: dict | Column | None = None,
    model: Callable[[Column, Column], Column] = overlap_score, w: Retrieval = Retrieval(), top_k: int = 10, expand: Callable[[DataFrame, DataFrame], DataFrame] = expanded, probes: int = 8,
) -> DataFrame:
    """query_id, doc_id, kind, origin, score and rank for questions (query_id, query).

    The type of a question says how many rows either list gives and how its fields and code are boosted. The lexical list
    comes from the stored postings of all fields, inexact words and exact codes; the dense one from a stored vector index or
    a table (vec_id, embedding). ``where`` holds for both lists before they are cut; then they are fused, re-ranked,
    diversified and cut. ``chunks`` has doc_id, title, text, section_path and the columns of ``where``.
    """
    asked = typed(queries, index.fields, w)
    condition = None if where is None else metadata_filter(where) if isinstance(where, dict) else where
    allowed = None if condition is None else chunks.filter(condition).select("doc_id")
    sizes = asked.select("query_id", k_dense(F.col("kind")).alias("kd"), k_lexical(F.col("kind")).alias("kx"))
    widest_dense, widest_lexical = (max(x) for x in zip(*K_VALUES.values(), strict=True))
    lexical = index.search(asked, widest_lexical, fuzzy=True, k1=w.k1, b=w.b, expand=expand, allowed=allowed)
    if isinstance(vectors, VectorIndex):
        dense = vectors.search(query_vectors, widest_dense, probes, rescore=4 * widest_dense, where=condition)
    else:
        own = vectors if allowed is None else vectors.join(allowed.withColumnRenamed("doc_id", "vec_id"), "vec_id", "left_semi")
        dense = dense_topk(query_vectors, own, widest_dense)
    dense = dense.withColumnRenamed("vec_id", "doc_id").join(sizes, "query_id").filter(F.col("rank") <= F.col("kd"))
    lexical = lexical.join(sizes, "query_id").filter(F.col("rank") <= F.col("kx"))
    return merged(asked.select("query_id", "query", "kind"), chunks, dense, lexical, model, w, top_k)


def search_answers(queries: DataFrame, chunks: DataFrame, found: DataFrame, a: Answers = Answers()) -> DataFrame:
    """query_id, query, kind, answer, confidence and n_sources of a search's rows and the chunks they name (with the columns of ``answered``)."""
    columns = [c for c in chunks.columns if c not in ("kind", "origin", "score", "rank")]
    rows = found.drop("kind", "origin").join(chunks.select(*columns), "doc_id")
    rows = rows if "n_images" in rows.columns else rows.withColumn("n_images", F.lit(0))
    return answered(rows, queries.select("query_id", "query", query_type(F.col("query")).alias("kind")), a)
