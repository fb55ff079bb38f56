"""Images of chunks: which are kept, to which chunk they belong, lists joined without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import Ingest


def is_valid(width: Column, height: Column, n_bytes: Column | None = None, i: Ingest = Ingest()) -> Column:
    """Large enough on both sides, and not too many bytes."""
    large = (width >= i.image_least_side) & (height >= i.image_least_side)
    return F.coalesce(large if n_bytes is None else large & (n_bytes <= i.image_most_bytes), F.lit(False))


def is_declared_small(width: Column, height: Column, i: Ingest = Ingest()) -> Column:
    """Both sides declared as whole numbers above nought, and one of them too small."""
    side = lambda c: F.when(c.rlike(r"^\d+$"), c.try_cast("long")).otherwise(F.lit(0))
    w, h = side(width), side(height)
    return F.coalesce((w > 0) & (h > 0) & (F.least(w, h) < i.image_least_side), F.lit(False))


def of_chunks(images: DataFrame, chunks: DataFrame) -> DataFrame:
    return images.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")


def merged(first: Column, second: Column) -> Column:
    """The images of the first list and those of the second whose id is new, each id once there."""

    def put(acc: Column, x: Column) -> Column:
        return F.when(F.exists(acc, lambda y: y["id"].eqNullSafe(x["id"])), acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(second, first, put)


def assigned(sections: DataFrame, images: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, image place (from 0) and section_pos: images go to sections in order, as many as each has figures.

    sections: doc, section_pos, n_figures; images: doc, place.
    """
    before = Window.partitionBy(doc).orderBy("section_pos").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sections.withColumn("start", F.coalesce(F.sum("n_figures").over(before), F.lit(0))).filter("n_figures > 0")
    places = ranges.select(doc, "section_pos", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n_figures") - 1)).alias("place"))
    return images.join(places, [doc, "place"]).select(doc, "place", "section_pos")
