"""Operator 3: language identification by prediction by partial matching.

Each language has a context tree over lower-cased UTF-8 bytes up to order 3, with
counts from a bounded sample of labelled texts. A byte is coded in its longest
known context: with probability n / (N + D) if it was seen there (n times, of N
bytes of D kinds), else after an escape of probability D / (N + D) in the context
one byte shorter, down to all bytes alike. The statistics are frozen before any
text is scored, so a byte's code length depends on it and the three bytes before it
alone, and the whole tree becomes one table. The language with the shortest code
for a text is predicted.

Null texts and texts without a letter get ``und`` with score 0. Equal code lengths
go to the language that comes first in the alphabet. Rows with a null language
or id teach nothing; null ids are kept. Repeated rows give equal rows; an
empty table or one without labels gives no language but ``und``. Extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.tables import emit, fold, opened, share, slices, string_bytes
from granary.llm.words import lowered

ORDER = 3
LETTER = re.compile(r"[^\W\d_]").search


def padded(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with three line ends before each text, places of the texts' own bytes, bounds of those)."""
    data, bounds = string_bytes(array)
    low = lowered(data)
    own = np.arange(low.size) + ORDER * (np.repeat(np.arange(len(array)), np.diff(bounds)) + 1)
    out = np.full(low.size + ORDER * len(array), 10, np.uint8)
    out[own] = low
    return out, own, bounds


def grams(array: pa.Array) -> np.ndarray:
    data, own, _ = padded(array)
    total = np.zeros(own.size, np.uint32)
    for back in range(ORDER, -1, -1):
        total = (total << np.uint32(8)) | data[own - back]
    return total


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram (four bytes as a number), n: summed within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in slices(batch, 0):
                for lang in part.column(1).unique().to_pylist():
                    mine = part.filter(pa.compute.equal(part.column(1), lang))
                    values, n = np.unique(grams(mine.column(0)), return_counts=True)
                    if lang in held:
                        values, place = np.unique(np.concatenate([held[lang][0], values]), return_inverse=True)
                        n = np.bincount(place, np.concatenate([held[lang][1], n])).astype(np.int64)
                    held[lang] = values, n
        for lang, (values, n) in held.items():
            yield from emit([{"lang": [lang] * len(n), "gram": values.astype(np.int64), "n": n}], pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]))

    return docs.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTables:
    """Code lengths in bits by context state and symbol, for all languages.

    Contexts seen ``least`` times or more are kept, all by default. The table that tasks get holds four bytes for each
    context, symbol and language; it fails beyond ``most_bytes``, so take fewer texts of each language then.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], least: int = 1, most_bytes: int = 1 << 30):
        self.langs = sorted(counts)
        seen = np.unique(np.concatenate([g & 255 for g, _ in counts.values()])) if counts else np.zeros(0, np.int64)
        self.size = len(seen) + 1
        self.symbol = np.full(256, len(seen), np.int64)
        self.symbol[seen] = np.arange(len(seen))
        if not counts:
            return
        k = self.size
        by_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
        for lang in self.langs:
            gram, n = counts[lang]
            parts = [self.symbol[(gram >> (8 * b)) & 255] for b in range(ORDER, -1, -1)]
            for order in range(ORDER + 1):
                key = np.zeros(gram.size, np.int64)
                for p in parts[ORDER - order :]:
                    key = key * k + p
                key, place = np.unique(key, return_inverse=True)
                by_order[order].append((key, np.bincount(place, n)))
        state = np.zeros(k**ORDER, np.int32)
        table = [np.full((1, k, len(self.langs)), 1 / 256)]
        for at, (key, n) in enumerate(by_order[0]):
            table[0][0, :, at] = self.coded(table[0][0, :, at][None], np.zeros(n.size, np.int64), key, n)[0]
        base, contexts_before = table[0], np.zeros(1, np.int64)
        first = 1
        for order in range(1, ORDER + 1):
            found, n_of = np.unique(np.concatenate([key // k for key, _ in by_order[order]]), return_inverse=True)
            total = np.bincount(n_of, np.concatenate([n for _, n in by_order[order]]))
            found = found[total >= least]
            if 4 * (first + found.size) * k * len(self.langs) > most_bytes:
                raise ValueError(f"the context tables of {len(self.langs)} languages take over {most_bytes} bytes; learn from fewer texts")
            shorter = found % k ** (order - 1)
            place = np.searchsorted(contexts_before, shorter)
            now = base[place].copy()
            for at, (key, n) in enumerate(by_order[order]):
                context = np.searchsorted(found, key // k)
                ok = (context < found.size) & (found[np.minimum(context, found.size - 1)] == key // k)
                now[:, :, at] = self.coded(now[:, :, at], context[ok], (key % k)[ok], n[ok])
            for i, c in enumerate(found):
                state[int(c) :: k**order] = first + i
            table.append(now)
            first += found.size
            base, contexts_before = now, found
        self.state = state
        self.bits = -np.log2(np.concatenate(table)).astype(np.float32).reshape(-1, len(self.langs))

    @staticmethod
    def coded(shorter: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probabilities in these contexts, given those in the contexts one byte shorter."""
        total, kinds = (np.bincount(context, w, len(shorter)) for w in (n, None))
        out = np.where(total[:, None] > 0, shorter * (kinds / np.maximum(total + kinds, 1))[:, None], shorter)
        out[context, symbol] = n / (total + kinds)[context]
        return out

    def lengths(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(code lengths in bits by text and language, bytes of each text)."""
        data, own, bounds = padded(array)
        code = self.symbol[data]
        context = np.zeros(own.size, np.int64)
        for back in range(ORDER, 0, -1):
            context = context * self.size + code[own - back]
        bits = self.bits[self.state[context].astype(np.int64) * self.size + code[own]]
        sums = np.zeros((len(array), len(self.langs)))
        filled = np.flatnonzero(np.diff(bounds))
        if filled.size:
            sums[filled] = np.add.reduceat(bits, bounds[filled], axis=0, dtype=np.float64)
        return sums, np.diff(bounds)


def fit(labelled: DataFrame, most_texts: int = 1500) -> ContextTables:
    """Learns from about ``most_texts`` whole texts of each language (the bound of the sample).

    Texts are drawn by a hash of their id, so the same rows give the same model.
    Only gram counts of this bounded sample come to the driver.
    """
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang").filter("lang is not null and text is not null and doc_id is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return ContextTables({})
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, most_texts / n))]), F.col("lang"))
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    found = gram_counts(drawn).toPandas()
    return ContextTables({lang: (own["gram"].to_numpy(np.int64), own["n"].to_numpy(np.float64)) for lang, own in found.groupby("lang")})


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, model: ContextTables) -> DataFrame:
    """doc_id, held_out, lang_pred and score (a softmax of code lengths, tempered by the root of the length)."""
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(shared)
        for batch in batches:
            for part in slices(batch, 1, 1 << 19):
                known = np.array([bool(model.langs) and t is not None and LETTER(t) is not None for t in part.column(1).to_pylist()], bool)
                pred, score = np.full(len(known), "und", object), np.zeros(len(known))
                if known.any():
                    bits, size = model.lengths(part.column(1))
                    gap = np.exp(-(bits - bits.min(axis=1, keepdims=True)) * np.log(2) / np.sqrt(np.maximum(size, 1))[:, None])
                    best = np.array(model.langs, object)[bits.argmin(axis=1)]
                    pred[known], score[known] = best[known], (1 / gap.sum(axis=1))[known]
                yield from emit([{"doc_id": part.column(0), "held_out": part.column(2), "lang_pred": pred, "score": score}], OUT)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold("doc_id", 3) == 1).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def detect_languages(docs: DataFrame, most_texts: int = 1500) -> DataFrame:
    """Learns from the rows outside the held-out third and predicts every row."""
    return identify(docs, fit(docs.filter(fold("doc_id", 3) != 1), most_texts))
