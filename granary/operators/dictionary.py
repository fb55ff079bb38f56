"""Inexact words by a dictionary of deletions.

``deletions`` writes for every word of a vocabulary all that is left of it after up to ``EDITS`` letters are deleted: a table to be stored
once. Two words within d edits (a letter added, left out, changed, or two neighbours exchanged) have a common rest after up to d deletions
each, so asked words meet the dictionary by equality of rests, never all with all, and the distance is counted for these pairs only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from granary.operators.retrieve import edits_allowed

EDITS, MOST = 2, 50


def shorter(words: Column) -> Column:
    """All words that lack one letter of one of these."""
    each = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, 1, i - 1), F.substring(w, i + 1, F.length(w))))
    return F.flatten(F.transform(F.filter(words, lambda w: w != ""), each))


def rests(rows: DataFrame, word: str, edits: int = EDITS) -> DataFrame:
    """``rows`` with a row for each rest of the word and the number of deleted letters."""
    rows = rows.withColumn("__0", F.array(word))
    for d in range(edits):
        # the one-row explode keeps a step from being made again for each place that looks at it
        rows = rows.withColumn(f"__{d + 1}", F.explode(F.array(F.array_distinct(shorter(F.col(f"__{d}"))))))
    tag = lambda d: F.transform(f"__{d}", lambda w: F.struct(w.alias("rest"), F.lit(d).alias("deleted")))
    tagged = F.concat(*map(tag, range(edits + 1)))
    return rows.select(*[c for c in rows.columns if not c.startswith("__")], F.explode(tagged).alias("x")).select("*", "x.rest", "x.deleted").drop("x")


def deletions(vocabulary: DataFrame, edits: int = EDITS) -> DataFrame:
    """term, n, rest and deleted of a vocabulary (term, n: how often it is used)."""
    return rests(vocabulary.filter("term is not null and term != ''").select("term", "n"), "term", edits)


@F.pandas_udf(IntegerType())
def distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Letters added, left out, changed or exchanged with their neighbour, each letter at most once."""

    def of(x: str, y: str) -> int:
        before, last, now = [], [], list(range(len(y) + 1))
        for i, c in enumerate(x):
            before, last, now = last, now, [i + 1]
            for j, d in enumerate(y):
                best = min(now[j] + 1, last[j + 1] + 1, last[j] + (c != d))
                if i and j and c == y[j - 1] and x[i - 1] == d:
                    best = min(best, before[j - 1] + 1)
                now.append(best)
        return now[-1]

    return pd.Series([of(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def near_terms(terms: DataFrame, dictionary: DataFrame, most: int = MOST) -> DataFrame:
    """query_term, term and edits: of each asked word the ``most`` most used words within its edits (none up to two letters, one up to five, else two)."""
    asked = rests(terms.select("query_term").distinct().filter("query_term is not null and query_term != ''").withColumn("allowed", edits_allowed(F.col("query_term"))), "query_term")
    asked = asked.filter("deleted <= allowed").drop("deleted")
    met = asked.join(dictionary, "rest").filter("deleted <= allowed").groupBy("query_term", "term").agg(F.max("n").alias("n"), F.max("allowed").alias("allowed"))
    close = met.filter(F.abs(F.length("query_term") - F.length("term")) <= F.col("allowed")).withColumn("edits", distance("query_term", "term")).filter("edits <= allowed")
    place = F.row_number().over(Window.partitionBy("query_term").orderBy(F.col("edits") > 0, F.desc("n"), "edits", "term"))  # the word itself is always one
    return close.withColumn("place", place).filter(F.col("place") <= most).select("query_term", "term", "edits")


def expanded(terms: DataFrame, vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """query_id, term and factor: the words near those asked (query_id, term), less weighty by their edits; ``vocabulary`` may be a stored table of ``deletions``."""
    words = vocabulary if "rest" in vocabulary.columns else deletions(vocabulary)
    near = near_terms(terms.select(F.col("term").alias("query_term")), words, most)
    near = near.select(F.col("query_term").alias("asked"), "term", (1 - F.col("edits") / F.least(F.length("query_term"), F.length("term"))).alias("factor"))
    return terms.withColumnRenamed("term", "asked").join(near, "asked").select("query_id", "term", "factor")
