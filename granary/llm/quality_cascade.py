"""Operator 4 [native]: quality rules as a short-circuit cascade.

Every text gets plain counts (words, characters in words, symbols, repeated lines,
words in repeated three-word windows). Further rules reject texts by ratios. Each rule's
cost (time to evaluate it many times over a sample of rows, without the job's own time) and selectivity (share of the
sample it rejects) are measured, and the rules run in order of rejection per cost
as branches of one CASE: a text that a rule rejects is not looked at by the later ones.
A text is kept if no rule rejects it, so the order changes the cost and never the result.
The base rules come first whatever they cost: their counts are part of the result for every text.

All steps are SQL functions inside each row; nothing is shuffled. Null texts
count as empty and fail the base rules, as do empty ones. Repeated rows give
equal rows; null ids are kept; an empty table gives no rows and any order of rules.
Extra columns are ignored.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, and the characters that count as symbols.
BLANK, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WORD, HAS_WORD = r"[^ \t-\r]+", r"[^ \t-\r]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_lines and the counts of every whole text.

    A window is repeated if its hash stands next to an equal one when the hashes are
    put in order with their places; the words it covers are the union of three
    places from each repeated window on.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(HAS_WORD)))
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn("n_lines", F.size("lines").cast("long"))
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    window = F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2)))
    rows = rows.withColumn("windows", window).drop("words")
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ordered)).drop("windows")
    same = lambda s, other: F.coalesce(F.get(F.col("ordered"), other)["h"] == s["h"], F.lit(False))
    places = F.filter("ordered", lambda s, i: F.when(i > 0, same(s, F.greatest(i - 1, F.lit(0)))).otherwise(F.lit(False)) | same(s, i + 1))
    rows = rows.withColumn("places", F.sort_array(F.transform(places, lambda s: s["i"]))).drop("ordered")
    steps = F.transform("places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("places"), i + 1) - p, F.lit(3))))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")).drop("places")
    rows = rows.withColumn("word_chars", F.length(without(F.col("text"), BLANK)).cast("long"))
    return rows.withColumn("n_symbols", (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Conditions that reject a text, all on whole numbers so that any engine agrees."""
    capitals = F.length("text") - F.length(without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = F.length("text") - F.length(without(F.col("text"), "!?"))
    digits = F.length("text") - F.length(without(F.col("text"), "0123456789"))
    return {
        "many_symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "odd_word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
        "many_copied_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "mostly_capitals": 10 * capitals > 4 * F.col("word_chars"),
        "many_marks": 4 * marks > F.col("n_words"),
        "mostly_digits": 10 * digits > 3 * F.col("word_chars"),
    }


def ordered_rules(rows: DataFrame, most_rows: int = 500, times: int = 40) -> list[tuple[str, Column, float, float]]:
    """(name, condition, rejected share, seconds) by rejection per cost on at most ``most_rows`` rows.

    A job evaluates one rule ``times`` times on every row of the sample; what the same job
    takes for a comparison of two numbers is not the rule's and is taken off. Each job runs twice, as the first
    time also compiles. The rows are the first ones: to draw them would
    read the whole table once more, for an order that changes no result.
    """
    sample = rows.limit(most_rows).cache()
    try:
        n = max(sample.count(), 1)
        again = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(times))))

        def timed(condition: Column) -> tuple[float, float]:
            took = []
            for _ in range(2):
                began = time.perf_counter()
                hits = again.agg(F.count_if(condition)).first()[0]
                took.append(time.perf_counter() - began)
            return hits / times, min(took)

        _, nothing = timed(F.col("n_words") < 0)
        found = []
        for name, condition in rules().items():
            hits, seconds = timed(condition)
            found.append((name, condition, hits / n, max(seconds - nothing, 1e-4)))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: -(x[2] + 1 / n) / x[3])


def quality_rules(docs: DataFrame, most_rows: int = 500) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    rejected = F.lit(False)
    for _, condition, _, _ in reversed(ordered_rules(measured(docs.limit(most_rows)), most_rows)):
        rejected = F.when(condition, F.lit(True)).otherwise(rejected)
    rows = measured(docs).withColumn("base_failed", base_failed())
    return rows.select("doc_id", *COUNTS, "base_failed", F.when(F.col("base_failed"), F.lit(False)).otherwise(~rejected).alias("kept"))
