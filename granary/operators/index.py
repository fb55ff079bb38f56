"""Chunk tables: replace and delete by URL, lookups, images, storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.schemas import CHUNK

PAYLOAD_FIELDS = ("chunk_id", "title", "content", "content_type", "version", "module", "param_name", "ui_path", "error_code", "source_url")
EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp")


def replace_by_url(old: DataFrame, new: DataFrame, url: str = "source_url") -> DataFrame:
    """Old rows of other URLs and all new rows, as one table (written as one overwrite)."""
    fresh = new.select(url).filter(F.coalesce(F.col(url), F.lit("")) != "").distinct()
    return old.join(fresh, url, "left_anti").unionByName(new)


def delete_by_url(rows: DataFrame, urls: DataFrame, url: str = "source_url") -> DataFrame:
    return rows.join(urls.select(url).distinct(), url, "left_anti")


def counts_by_url(rows: DataFrame, urls: DataFrame, url: str = "source_url") -> DataFrame:
    """How many rows each URL to delete has."""
    return urls.select(url).distinct().join(rows.groupBy(url).agg(F.count("*").alias("n")), url, "left").fillna(0, ["n"])


def first_by_hash(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by one minimum that is combined before the shuffle; take only the columns you need."""
    others = [c for c in rows.columns if c not in (key, order)]
    least = F.min(F.struct(order, *others)) if not others else F.min_by(F.struct(order, *others), F.col(order))
    return rows.groupBy(key).agg(least.alias("__row")).select(key, "__row.*").select(*rows.columns)


def without_orphans(files: DataFrame, valid: DataFrame, key: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """(files that a valid id names, the others)."""
    ids = valid.select(key).distinct()
    return files.join(ids, key, "left_semi"), files.join(ids, key, "left_anti")


def best_extension(files: DataFrame, keys: list[str], extension: str = "ext") -> DataFrame:
    """One file for each key, by the order of extensions."""
    order = F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.col(extension))
    return files.filter(F.col(extension).isin(*EXTENSIONS)).groupBy(*keys).agg(F.min_by(extension, order).alias(extension))


def lookup(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def payload() -> Column:
    """A chunk as JSON without its empty fields, breadcrumbs joined."""
    return F.to_json(F.struct(*[F.nullif(F.col(f), F.lit("")).alias(f) for f in PAYLOAD_FIELDS], F.array_join("breadcrumbs", " > ").alias("breadcrumbs")), {"ignoreNullFields": "true"})


def from_payload(text: Column) -> Column:
    """The chunk of a payload; what it leaves out is null, and no breadcrumbs are an empty list."""
    flat = F.from_json(text, ", ".join(f"{f} string" for f in (*PAYLOAD_FIELDS, "breadcrumbs")))
    crumbs = F.coalesce(F.split(F.nullif(flat["breadcrumbs"], F.lit("")), " > "), F.array().cast("array<string>"))
    return F.struct(*[flat[f].alias(f) for f in PAYLOAD_FIELDS], crumbs.alias("breadcrumbs"))


def merged_by_id(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Old rows of other keys and all new rows; new rows of one key must be one row."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def of_url(rows: DataFrame, url: str, without: tuple[str, ...] = ("vector",), most: int = 100) -> DataFrame:
    """The first rows of a URL, by chunk id, without their vectors."""
    return rows.filter(F.col("source_url") == url).drop(*without).orderBy("chunk_id").limit(most)


def ensure_table(spark: SparkSession, name: str, schema: str = CHUNK) -> None:
    """Creates the table where it is not there yet."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def parents(chunks: DataFrame) -> DataFrame:
    """Chunks with the list of the chunks that name them as parent."""
    children = chunks.filter("parent_chunk_id is not null").groupBy("parent_chunk_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("child_chunk_ids"))
    return chunks.drop("child_chunk_ids").join(children.withColumnRenamed("parent_chunk_id", "__parent"), F.col("chunk_id") == F.col("__parent"), "left").drop("__parent")


def storage(images: DataFrame, group: str, size: str) -> DataFrame:
    return images.groupBy(group).agg(F.count("*").alias("n_images"), F.sum(size).alias("n_bytes"), F.round(F.sum(size) / (1024 * 1024), 2).alias("n_mb"))


def covering_sections(items: DataFrame, sections: DataFrame, doc: str, page: str, width: int = 16) -> DataFrame:
    """All (item, section) pairs of a document where the section's pages hold the item's page.

    Pages are cut into bins of ``width``; a section has a row for each bin that it touches, an item lies in one, so a pair meets
    once and only items and sections of the same few pages of a document meet. Rows without a page or with an empty range find nothing.
    """
    cut = lambda c: F.floor(F.col(c) / width)
    binned = sections.filter(F.col("page_start") <= F.col("page_end")).withColumn("__bin", F.explode(F.sequence(cut("page_start"), cut("page_end"))))
    placed = items.filter(F.coalesce(F.col(page), F.lit(0)) > 0).withColumn("__bin", cut(page))
    return placed.join(binned, [doc, "__bin"]).filter(F.col(page).between(F.col("page_start"), F.col("page_end"))).drop("__bin")


def first_section(items: DataFrame, sections: DataFrame, doc: str, page: str, item: list[str]) -> DataFrame:
    """The first section that covers each item."""
    return covering_sections(items, sections, doc, page).groupBy(*item).agg(F.min("section_pos").alias("section_pos"))


def recent(rows: DataFrame, by: str, n: int, tie: str, group: str | None = None) -> DataFrame:
    """The last n rows (of each group), newest first."""
    if group is None:
        return rows.orderBy(F.desc(by), F.desc(tie)).limit(n)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(by), F.desc(tie)))).filter(F.col("place") <= n)
