"""Operator 12: importance resampling of documents towards a target set of texts.

Words are longest runs of ASCII letters, ASCII digits and non-ASCII characters after A-Z become
small letters. Features are all runs of one to ``n_grams`` words, joined by a space, repeats
counted; a feature's bucket is its crc32 modulo ``buckets``. With S features of all documents (s in a
bucket) and T of all target texts (t), a bucket's gain is floor(1000 ln((t + 1) (S + buckets) / ((s + 1)
(T + buckets)))), a text's weight the floored mean of its features' gains. A document's score is
its weight plus Gumbel noise that its id alone decides, so the highest scores are a draw without
replacement by weight; equal texts have one weight and each its own noise.

Equal texts are one row: documents are grouped by their full text, its features are made once and written as
bucket numbers, corpus counts take them times the number of copies, and weights go back to the
documents by a 256-bit digest of the text, a text of very many copies in parts. What all tasks
get are the ``buckets`` gains. Ranks come from a sort by ranges: a row's place in its range plus the
sizes of the ranges before, so no task sees more than a range.

Null and empty texts, and texts without a word, have no features and weight 0. Documents of under
``least_words`` words, and all that are not drawn, have no rank. Every row counts, rows of one
id too (their noise is the same); a null id has the noise of the text "null" and comes last among equals.
An empty table gives no rows; without target texts T is 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.tables import Scratch, dealt, emit, saved, share, slices

BUCKETS, N_GRAMS, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def feature_buckets(text: str, n_grams: int = N_GRAMS, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every feature of a text."""
    words = text.encode().translate(TABLE).split()
    if not words:
        return 0, np.zeros(0, np.uint16)
    now, found = [crc32(w) for w in words], []
    found += now
    more = [b" " + w for w in words]
    for n in range(1, min(n_grams, len(words))):  # a run's crc goes on from that of the run one word shorter
        now = [crc32(w, c) for w, c in zip(more[n:], now, strict=False)]
        found += now
    return len(words), (np.array(found, np.uint32) % np.uint32(buckets)).astype(np.uint16)


def described(texts: DataFrame, n_grams: int, buckets: int) -> DataFrame:
    """digest, copies, n_words and the packed buckets of each row of (digest, copies, text)."""
    schema = pa.schema([("digest", pa.binary()), ("copies", pa.int64()), ("n_words", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                found = [feature_buckets(x.as_py(), n_grams, buckets) for x in part.column(2)]
                yield from emit([{"digest": part.column(0), "copies": part.column(1), "n_words": [n for n, _ in found], "packed": [x.tobytes() for _, x in found]}], schema)

    return texts.select("digest", "copies", "text").mapInArrow(run, "digest binary, copies long, n_words long, packed binary")


def counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket, each row counted ``copies`` times; at most ``buckets`` sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for copies, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total += copies * np.bincount(np.frombuffer(packed.as_py(), np.uint16), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    found = rows.select("copies", "packed").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s_all, t_all, m = int(corpus.sum()), int(target.sum()), corpus.size
    return np.array([floor(1000 * log((t + 1) * (s_all + m) / ((s + 1) * (t_all + m)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """digest, k (copies), n_words, n_features and weight of each text."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)
    schema = pa.schema([("digest", pa.binary()), ("k", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            found = [np.frombuffer(x.as_py(), np.uint16) for x in batch.column(3)]
            yield from emit([{"digest": batch.column(0), "k": batch.column(1), "n_words": batch.column(2), "n_features": [x.size for x in found], "weight": [int(gain[x].sum()) // x.size if x.size else 0 for x in found]}], schema)

    return rows.select("digest", "copies", "n_words", "packed").mapInArrow(run, "digest binary, k long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) from the first 32 bits of the sha256 of ``<seed>:<id>``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, eligible: Column, order: list[Column], percent: int) -> DataFrame:
    """``rows`` with rank 1, 2, 3... of the first ``percent`` percent of the eligible ones in ``order``, null for all others."""
    placed = rows.withColumn("__in", eligible).repartitionByRange(F.desc("__in"), *order).sortWithinPartitions(F.desc("__in"), *order)
    # the id holds the number of the row's range and, in its lower 33 bits, the row's place there
    placed = saved(placed.withColumn("__id", F.monotonically_increasing_id()).withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND((1 << 33) - 1)}))
    sizes = sorted((r["__part"], r["n"], r["of"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n"), F.sum(F.col("__in").cast("long")).alias("of")).collect())  # one row for each range
    drawn, before, offsets = sum(x[2] for x in sizes) * percent // 100, 0, []
    for part, n, _ in sizes:
        offsets.append((part, before))
        before += n
    offset = rows.sparkSession.createDataFrame(offsets, "__part long, __before long")
    rank = F.col("__before") + F.col("__at") + 1
    out = placed.join(F.broadcast(offset), "__part").withColumn("rank", F.when(F.col("__in") & (rank <= drawn), rank))
    return out.select(*rows.columns, "rank")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS, n_grams: int = N_GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; ``percent`` of those of ``least_words`` words are drawn."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must be between 1 and 65536")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    with Scratch(docs.sparkSession) as scratch:
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
        alike = own.groupBy("text").agg(F.count("*").alias("copies"))
        rows = scratch.table(described(alike.select(digest, "copies", "text"), n_grams, buckets))
        wanted = target.select(F.lit(b"").alias("digest"), F.lit(1).cast("long").alias("copies"), text)
        gain = gains(counts(rows, buckets), counts(described(wanted, n_grams, buckets), buckets))
        back = dealt(own.select("doc_id", digest), weights(rows, gain), ["digest"], own.count())
        scored = back.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))
        found = ranked(scored, F.col("n_words") >= least_words, [F.desc("score"), F.asc_nulls_last("doc_id")], percent)
        return found.select("doc_id", "n_features", "weight", "score", "rank")
