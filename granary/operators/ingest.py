"""From sections of pages and of page documents to rows of the chunk table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.rules import param_name, section_param_name, section_type
from granary.functions.text import breadcrumbs, content_hash, error_codes, module_of, stripped, ui_path, version_of
from granary.operators import html, index
from granary.schemas import SPAN

#: What stands for missing metadata, the head of the texts read from images, patterns of named values.
NO_VERSION, NO_MODULE, NO_TITLE, NO_TEXT = "1.0", "Generale", "Documento", "Contenuto non estratto"
IMAGE_TEXTS, BETWEEN_IMAGE_TEXTS = "\n\n[Testo estratto dalle immagini]\n", "\n---\n"
NAMED_VALUE, LISTED_VALUE = r"([A-Z][a-z]+(?:\s+[a-z]+)*)\s*[:=]\s*([^\n]+)", r"•\s*([^:]+):\s*([^\n]+)"


def is_html(content_type: Column) -> Column:
    return F.contains(F.lower(content_type), F.lit("text/html"))


def is_pdf(content_type: Column) -> Column:
    return F.contains(F.lower(content_type), F.lit("application/pdf"))


def derived(sections: DataFrame) -> DataFrame:
    """Sections (title, content) with content_type, ui_path and error_codes of their content now.

    The type is decided before the codes are known, so codes alone make no error section.
    """
    return sections.withColumns({"content_type": section_type(F.col("title"), F.col("content")), "ui_path": ui_path(F.col("content")), "error_codes": error_codes(F.col("content"))})


def section_parameters(sections: DataFrame) -> DataFrame:
    """section_id, name and description of the values that parameter sections name, in the order of patterns and text."""
    pairs = lambda p: F.arrays_zip(*[F.regexp_extract_all("content", F.lit(p), F.lit(i)).alias(n) for i, n in ((1, "name"), (2, "description"))])
    found = sections.filter("content_type = 'parameter'").select("section_id", F.posexplode(F.concat(pairs(NAMED_VALUE), pairs(LISTED_VALUE))).alias("pos", "p"))
    return found.select("section_id", "pos", stripped(F.col("p.name")).alias("name"), stripped(F.col("p.description")).alias("description"))


def whole_page(pages: DataFrame, text: Column, most_chars: int = 5000) -> DataFrame:
    """One section for each page that could not be cut: its title, or a standing one, and the beginning of its text.

    ``most_chars`` is part of the result's definition; null gives the text whole.
    """
    title = F.nullif(stripped(F.regexp_extract("html", r"(?i)<title[^>]*>([^<]+)</title>", 1)), F.lit(""))
    body = F.coalesce(F.nullif(text, F.lit("")), F.lit(NO_TEXT))
    body = F.left(body, F.lit(most_chars)) if most_chars else body
    return pages.select("page_id", "url", F.lit("main_content").alias("section_id"), F.coalesce(title, F.lit(NO_TITLE)).alias("title"), body.alias("content"), F.lit(1).alias("level"), F.lit("top").alias("anchor"))


def chunks_of_sections(sections: DataFrame, url: str = "url", from_pages: bool = False) -> DataFrame:
    """A row of the chunk table for each section.

    sections: url, title, content, level, tables, and section_id and anchor, or with ``from_pages``
    page_start and page_end; doc_title is where module and version are looked for. A section's tables follow its text.
    """
    path = F.concat(F.lit("page"), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string")) if from_pages else F.col("section_id")
    rows = derived(sections.withColumn("section_path", path))
    tables = F.concat(F.lit("\n\n"), F.array_join("tables", "\n\n"))
    content = F.concat("title", F.lit("\n\n"), "content", F.when(F.size("tables") > 0, tables).otherwise(F.lit("")))
    doc_title = F.col("doc_title") if "doc_title" in sections.columns else F.lit("")
    name = param_name(F.col("content")) if from_pages else section_param_name(F.col("content_type"), F.col("title"), F.col("content"))
    found = lambda column, default: F.coalesce(F.nullif(column, F.lit("")), F.lit(default))
    return rows.select(
        F.concat(content_hash(F.col(url)), F.lit("#"), "section_path").alias("chunk_id"),
        "title",
        content.alias("content"),
        breadcrumbs(F.col("title") if from_pages else F.col("section_path")).alias("breadcrumbs"),
        F.col("level").cast("int").alias("section_level"),
        "section_path",
        "content_type",
        found(version_of(doc_title), NO_VERSION).alias("version"),
        found(module_of(doc_title), NO_MODULE).alias("module"),
        name.alias("param_name"),
        (F.lit(None).cast("string") if from_pages else F.col("ui_path")).alias("ui_path"),
        F.get("error_codes", F.lit(0)).alias("error_code"),
        F.col(url).alias("source_url"),
        F.lit("pdf" if from_pages else "html").alias("source_format"),
        (F.array(F.col("page_start").cast("int"), F.col("page_end").cast("int")) if from_pages else F.lit(None).cast("array<int>")).alias("page_range"),
        (F.lit(None).cast("string") if from_pages else F.col("anchor")).alias("anchor"),
        F.lit("it").alias("lang"),
        content_hash(content).alias("hash"),
    )


def page_chunks(pages: DataFrame) -> DataFrame:
    """Chunk rows of HTML pages (page_id, url, html), one for each different content."""
    titles = pages.select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("doc_title"))
    return index.first_by_hash(chunks_of_sections(html.html_sections(pages).join(titles, "page_id")), "hash", "chunk_id")


def ingested(old: DataFrame, pages: DataFrame) -> DataFrame:
    """The chunk table after these pages came: their URLs' old rows go, their new ones come."""
    return index.replace_by_url(old, page_chunks(pages))


def united(*parsed: DataFrame) -> DataFrame:
    """The rows of several ingests as one table, a row of each content."""
    return index.first_by_hash(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parsed), "hash", "chunk_id")


def processing_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count_distinct("source_url").alias("n_documents"), F.count("*").alias("n_chunks"), F.count_distinct("content_type").alias("n_types"))


def document_title(title: Column, path: Column) -> Column:
    """A page document's own title, else its file's name without the suffix."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.coalesce(F.nullif(stripped(title), F.lit("")), F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def spans_of_files(files: DataFrame, reader: Callable[[bytes], list[dict]]) -> DataFrame:
    """The text spans of page documents (path, content as bytes), with ``path`` as doc_id.

    ``reader`` gives dictionaries with the other columns of ``SPAN``; no library for
    this is part of the package. A file that it cannot read gives no span.
    """
    fields = [f.split() for f in SPAN.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    found = reader(content.as_py() or b"")
                except ValueError:
                    continue
                yield pa.RecordBatch.from_pylist([{"doc_id": path.as_py()} | row for row in found], schema=schema)

    return files.select("path", "content").mapInArrow(run, SPAN)


def with_image_texts(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Chunks with image_ids, and the texts read from their images (chunk_id, id, place, ocr_text) after their content."""
    own = images.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "ocr_text"))).alias("own"))
    texts = F.filter(F.transform("own", lambda x: x["ocr_text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    more = F.when(F.size(texts) > 0, F.concat(F.lit(IMAGE_TEXTS), F.array_join(texts, BETWEEN_IMAGE_TEXTS))).otherwise(F.lit(""))
    return chunks.join(own, "chunk_id", "left").withColumns({"image_ids": F.coalesce(F.transform("own", lambda x: x["id"]), F.array().cast("array<string>")), "content": F.concat("content", more)}).drop("own")
