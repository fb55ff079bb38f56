"""Sources: crawl results, folders of files, sitemaps, question files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from granary.functions.text import normalize_text, url_allowed

ACCEPTED = r"text/html|application/pdf|text/plain"


def accepted(pages: DataFrame, domains: tuple[str, ...] = ()) -> DataFrame:
    """Pages of accepted types and domains, with the hash of their normalised content."""
    rows = pages.filter(F.lower("content_type").rlike(ACCEPTED))
    rows = rows.filter(url_allowed(F.col("url"), domains)) if domains else rows
    return rows.withColumn("content_hash", F.sha1(F.encode(normalize_text(F.col("content")), "UTF-8")))


def crawled(pages: DataFrame, domains: tuple[str, ...] = (), order: str = "page_id") -> DataFrame:
    """Accepted pages (url, content, content_type): allowed domains, first of each URL, first of each content."""
    rows = accepted(pages, domains)
    for key in ("url", "content_hash"):
        rows = rows.join(rows.groupBy(key).agg(F.min(order).alias(order)), [key, order], "left_semi")
    return rows


def first_of(rows: DataFrame, key: str, order: str, keep_days: float) -> DataFrame:
    """Of a stream, the first row of each key, and of rows that come together that of least ``order``.

    The state of a key is when it last came; a key that has not come for ``keep_days`` is new again.
    """

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for part in parts:  # one row is held at a time
            least = part.loc[[part[order].idxmin()]]
            best = least if best is None or least[order].iloc[0] < best[order].iloc[0] else best
        now = state.getCurrentProcessingTimeMs()
        if best is not None and (not state.exists or now - state.get[0] > keep_days * 86_400_000):
            yield best
        state.update((now,))

    known = rows.filter(F.col(key).isNotNull() & F.col(order).isNotNull())
    return known.groupBy(key).applyInPandasWithState(run, rows.schema, "last long", "append", GroupStateTimeout.NoTimeout)


def crawl_into(pages: DataFrame, to: str, domains: tuple[str, ...] = (), order: str = "page_id", keep_days: float = 30) -> DataFrame:
    """``crawled`` of a stream: reads all that is there now, and returns all rows that the folder ``to`` holds since its first run.

    The first query keeps state by URL, the second reads what it wrote and keeps state by content; both checkpoint in ``to``, so a
    later run goes on, a killed one too, and pages that come again, or twice in a replay, give nothing.
    """
    spark, rows = pages.sparkSession, accepted(pages, domains)
    for key, name in (("url", "by_url"), ("content_hash", "rows")):
        found = first_of(rows, key, order, keep_days)
        found.writeStream.format("parquet").option("path", f"{to}/{name}").option("checkpointLocation", f"{to}/state_{name}").trigger(availableNow=True).start().awaitTermination()
        rows = spark.readStream.schema(found.schema).parquet(f"{to}/{name}")
    return spark.read.schema(rows.schema).parquet(f"{to}/rows")


def folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("html", "htm", "pdf")) -> DataFrame:
    """All files of a folder tree with those extensions, as bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(path)


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """url and html of a folder tree's HTML files."""
    return folder(spark, path, ("html", "htm")).select(F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html"))


def sitemap_urls(sitemaps: DataFrame, column: str = "xml") -> DataFrame:
    return sitemaps.select(F.explode(F.xpath(column, F.lit('//*[local-name()="url"]/*[local-name()="loc"]/text()'))).alias("url"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query string, expected_type string, category string").option("multiLine", True).json(path)
