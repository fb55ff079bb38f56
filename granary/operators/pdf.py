"""Page documents as a table of text spans: fonts, headings, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import clean_pdf_text, stripped


def font_stats(spans: DataFrame, pages: int = 5) -> DataFrame:
    """doc_id, font, size, flags with count, running average length, heading flag and level.

    Fonts are named in small letters and lengths are of trimmed text. The running average starts
    at nothing and gives the last spans of a font the most weight, so it is folded
    in the order of the page.
    """
    place = F.struct("page", "block", "line", "span", F.length(stripped(F.col("text"))).cast("double").alias("n"))
    named = spans.filter(F.col("page") < pages).withColumn("font", F.lower("font"))
    own = named.groupBy("doc_id", "font", "size", "flags").agg(F.count("*").alias("count"), F.array_sort(F.collect_list(place)).alias("placed"))
    own = own.withColumn("avg_length", F.aggregate("placed", F.lit(0.0), lambda a, x: (a + x["n"]) / 2)).drop("placed")
    of_doc = Window.partitionBy("doc_id")
    large = (F.col("size") >= F.avg("size").over(of_doc) + 2) | (F.col("flags").bitwiseAND(16) != 0)
    heading = large & ((F.col("avg_length") < 50) | (F.col("count") < 0.1 * F.count("*").over(of_doc)))
    level = F.least(F.floor((F.max("size").over(of_doc) - F.col("size")) / 2) + 1, F.lit(6)).cast("int")
    return own.withColumns({"is_heading": heading, "level": level})


def sections(blocks: DataFrame, longer_than: int = 50) -> DataFrame:
    """doc_id, section, title, content, level, page_start and page_end of blocks (doc_id, page, block, text, is_heading, level).

    A heading block begins a section, and the blocks after it belong to it; what comes
    before the first heading is left out.
    """
    full = F.trim("text") != ""
    island = F.sum((F.col("is_heading") & full).cast("int")).over(Window.partitionBy("doc_id").orderBy("page", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = blocks.withColumn("section", island).filter((F.col("section") > 0) & full)
    body = F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("page", "block", "text"))))
    out = rows.groupBy("doc_id", "section").agg(
        F.max(F.when(F.col("is_heading"), F.col("text"))).alias("title"),
        F.max(F.when(F.col("is_heading"), F.col("level"))).alias("level"),
        F.min("page").alias("page_start"),
        F.coalesce(F.max(F.when(~F.col("is_heading"), F.col("page"))), F.max("page")).alias("page_end"),
        F.array_join(F.transform(body, lambda x: x["text"]), "\n\n").alias("content"),
    )
    return out.filter(F.length("content") > longer_than).withColumns({"title": clean_pdf_text(F.col("title")), "content": clean_pdf_text(F.col("content"))})
