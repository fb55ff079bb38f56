"""Operator 10 [native]: boilerplate lines by their spread over sites.

Each document is cut at line ends. For every line with a word (trimmed, hashed to
96 bits) a HyperLogLog sketch of its sites merges over tasks, so a line that very many
documents share costs one sketch a task. Lines whose estimate is clearly above
the threshold are boilerplate, lines clearly below are not, and those near it get an
exact distinct count. Boilerplate lines are then removed from every document but
the first (least id) that has them.

All steps are SQL functions. Keys are counted before they meet the lines: up to
``MOST_BROADCAST`` of them are broadcast, more meet the lines in salted parts, so that
a line of very many documents never lies in one task. Only line hashes of the
matching lines are shuffled to their documents; texts move once, to meet the list of
lines to remove.

Null texts stay null, empty texts empty. Null sites count as one site named by the
empty text. Rows with a null id keep their text. Lines without a word always stay. Repeated rows count once for a
site, and each is cleaned. An empty table gives no rows. Extra columns go through, but for one named n_removed, which
the count replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.tables import saved

SITES, LEAST_WORDS, MOST_BROADCAST, SALTS = 6, 1, 200_000, 32


def at_least(words: int) -> str:
    """A pattern for lines of so many words (a word: a run without space, tab, line feed to carriage return)."""
    return r"[^ \t-\r]+" + r"[ \t-\r]+[^ \t-\r]+" * (words - 1)


def line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[ \t-\r]+|[ \t-\r]+$", "")


def lines_of(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, site and key of every line of enough words."""
    line = F.explode(F.split("text", "\n")).alias("line")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), line)
    return cut.filter(F.col("line").rlike(at_least(least_words))).select("doc_id", "site", line_key(trimmed(F.col("line"))).alias("key"))


def meet(lines: DataFrame, keys: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The lines whose key is in ``keys`` (each once, already computed), with the columns of both."""
    if keys.count() <= most_broadcast:
        return lines.join(F.broadcast(keys), "key")
    dealt = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    copies = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, ["key", "salt"]).drop("salt")


def boilerplate(lines: DataFrame, sites: int = SITES, margin: float = 0.25, lg_k: int = 12, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """key and keeper (the least doc_id that has it) of lines that stand in ``sites`` or more sites.

    The sketch's relative error at lg_k = 12 is about 1.6 %; ``margin`` is far
    beyond it, so the exact count decides wherever the sketch could be wrong.
    """
    spread = lines.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("doc_id").alias("keeper"))
    spread = saved(spread.select("key", "keeper", F.hll_sketch_estimate("sketch").alias("about")).filter(F.col("about") >= sites * (1 - margin)))
    clear = spread.filter(F.col("about") > sites * (1 + margin)).select("key", "keeper")
    near = spread.filter(F.col("about") <= sites * (1 + margin)).select("key", "keeper")
    exact = meet(lines, near, most_broadcast).select("key", "keeper", "site").distinct().groupBy("key", "keeper").agg(F.count("*").alias("n")).filter(F.col("n") >= sites).select("key", "keeper")
    return clear.unionByName(exact)


def without_boilerplate(docs: DataFrame, sites: int = SITES, least_words: int = LEAST_WORDS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """All rows and columns, the text without its boilerplate lines, and n_removed.

    A boilerplate line stays in the document of least id that has it, so every
    line of the corpus is kept once at least.
    """
    lines = saved(lines_of(docs, least_words))
    found = saved(boilerplate(lines, sites, most_broadcast=most_broadcast))
    gone = meet(lines, found, most_broadcast).filter("doc_id != keeper").groupBy("doc_id").agg(F.collect_set("key").alias("__gone")).withColumnRenamed("doc_id", "__id")
    met = docs.join(gone, F.col("doc_id").cast("long") == F.col("__id"), "left").drop("__id")
    stays = F.filter(F.split("text", "\n"), lambda x: ~F.coalesce(F.array_contains(F.col("__gone"), line_key(trimmed(x))), F.lit(False)))
    met = met.withColumn("__kept", F.when(F.col("__gone").isNotNull(), stays))
    removed = F.coalesce(F.size(F.split("text", "\n")) - F.size("__kept"), F.lit(0))
    return met.withColumn("n_removed", F.when(F.col("__kept").isNull(), F.lit(0)).otherwise(removed).cast("long")).withColumn("text", F.when(F.col("__kept").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n"))).drop("__gone", "__kept")
