"""Operator 8: benchmark decontamination by size-partitioned MinHash containment search.

An item (a benchmark text) is the set of its runs of five words, or of fewer where it has no more, the run
of all its words; a document contains it if it has at least 0.8 of them. Items are partitioned by the size of
their set, in powers of two. Within a partition an item's sketch is its m least
hash values, m growing with the partition so that no contained item is missed: a
document that lacks at most n - ceil(0.8 n) of an item's n runs has one of any
n - ceil(0.8 n) + 1 of them. A document that has a sketch value is a candidate, however
long it is; exact containment of the whole set then decides.

Items come to the workers in blocks of at most ``block_runs`` runs, so what is
broadcast is bounded whatever the size of the benchmark; further blocks are
further passes over the documents. Documents are never shuffled.

Null texts contain nothing, and items without a word are in nothing. A document of under five words can
contain only an item of as many words or fewer. Repeated items give a row each; repeated documents too. Rows
with a null id are dropped. An empty table on either side gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.tables import emit, opened, share, slices, string_bytes
from granary.llm.words import codes, shingles, texts_to_arrays

K, CONTAINMENT = 5, 0.8
OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("containment", pa.float64()), ("n_shared", pa.int64()), ("text_hash", pa.int64())])


class Block:
    """Some items of runs of as many words: their runs, their sketches and a filter on low bits of the sketch values."""

    def __init__(self, width: int, ids: list[int], sets: list[np.ndarray], least: float):
        self.width, self.ids, self.least = width, np.array(ids, np.int64), least
        self.need = np.array([int(np.ceil(least * len(s) - 1e-9)) for s in sets], np.int64)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        sketched = []
        for s in sets:
            partition = int(len(s)).bit_length()  # sizes 2**(p-1) to 2**p - 1
            widest = 2**partition - 1
            take = min(len(s), widest - int(np.ceil(least * widest - 1e-9)) + 1)
            sketched.append(np.sort(s)[:take])
        self.sketch, self.sketch_of, self.sketch_to = self.inverted(sketched)
        self.runs, self.runs_of, self.runs_to = self.inverted(sets)
        self.low = np.zeros(1 << 20, bool)
        self.low[(self.sketch & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    @staticmethod
    def inverted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values in order, where each one's items begin and end, the items)."""
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        values, starts = np.unique(flat[order], return_index=True)
        return values, np.append(starts, flat.size), owner[order]

    @staticmethod
    def hits(values: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Places in the table of those values that it has."""
        if not table.size:
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(table, values), table.size - 1)
        return at[table[at] == values]

    def contained(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(items, shared runs) that a document with these runs contains."""
        likely = runs[self.low[(runs & np.uint64((1 << 20) - 1)).astype(np.int64)]]
        found = self.hits(likely, self.sketch)
        if not found.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        candidate = np.zeros(len(self.ids), bool)
        for f in np.unique(found):
            candidate[self.sketch_to[self.sketch_of[f] : self.sketch_of[f + 1]]] = True
        at = self.hits(np.unique(runs), self.runs)
        size = self.runs_of[at + 1] - self.runs_of[at]
        place = np.repeat(self.runs_of[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        shared = np.bincount(self.runs_to[place], minlength=len(self.ids))
        items = np.flatnonzero(candidate & (shared >= self.need))
        return items, shared[items]


def blocks(benchmark: DataFrame, least: float, block_runs: int) -> Iterator[list[Block]]:
    """Blocks of one width each, together of at most ``block_runs`` runs (or one item)."""
    held: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    n = 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null").toLocalIterator():
        words, bounds = codes(*texts_to_arrays([row["text"]]))
        width = min(K, words.size)
        if not width:
            continue
        runs = np.unique(shingles(words, bounds, width)[0])
        if n and n + runs.size > block_runs:
            yield [Block(w, *items, least) for w, items in held.items()]
            held, n = {}, 0
        ids, sets = held.setdefault(width, ([], []))
        ids.append(row["item_id"])
        sets.append(runs)
        n += runs.size
    if held:
        yield [Block(w, *items, least) for w, items in held.items()]


def found_items(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, block_runs: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, containment, n_shared and the document's text_hash, for every document that contains an item."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")).filter("doc_id is not null")
    kinds = "doc_id long, item_id long, containment double, n_shared long, text_hash long"
    out = None
    for some in blocks(benchmark, containment, block_runs):
        shared = share(docs.sparkSession, some)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            some = opened(shared)
            for batch in batches:
                for part in slices(batch, 1):
                    words, bounds = codes(*string_bytes(part.column(1)))
                    rows: dict[str, list] = {f.name: [] for f in OUT}
                    for block in some:
                        runs, of = shingles(words, bounds, block.width)
                        maybe = block.low[(runs & np.uint64((1 << 20) - 1)).astype(np.int64)]
                        running = np.concatenate([[0], np.cumsum(maybe)])
                        for i in np.flatnonzero(running[of[1:]] > running[of[:-1]]):
                            items, n = block.contained(runs[of[i] : of[i + 1]])
                            rows["doc_id"] += [part.column(0)[int(i)].as_py()] * len(items)
                            rows["item_id"] += block.ids[items].tolist()
                            rows["containment"] += (n / block.sizes[items]).tolist()
                            rows["n_shared"] += n.tolist()
                            rows["text_hash"] += [part.column(2)[int(i)].as_py()] * len(items)
                    yield from emit([rows], OUT)

        found = texts.mapInArrow(run, kinds)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], kinds)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, containment and n_shared of every document that contains an item."""
    return found_items(docs, benchmark, **options).drop("text_hash")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that contain no item, with all their columns.

    Of several rows under one id only those go whose text contains an item. The links are a small part of the
    documents; the anti join moves the documents only if the ids are too many to broadcast, which Spark decides from
    their size when the join starts.
    """
    gone = found_items(docs, benchmark, **options).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash")), "left_anti")
