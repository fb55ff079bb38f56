"""Operator 7: document quality by regularised quadratic discriminant analysis.

Each text becomes a dozen transformed statistics. Each class (label 0 and 1) has
a mean and a covariance of these, shrunk towards the diagonal of the pooled
within-class variances; the score is the logistic of the difference of the two
Mahalanobis log-densities plus the log ratio of the class sizes. The Cholesky
factors are computed once on the driver and reused for every row.

Sums of products for the fit are plain aggregates over all labelled rows of the
learning folds. Null texts count as empty. Null labels and labels of unknown ids
teach nothing. Repeated rows give equal rows; an empty table gives no rows; with
fewer than two labelled rows of each class every score is the share of label 1
(0.5 without labels). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.tables import emit, fold, opened, saved, share, slices, string_bytes
from granary.llm.words import BASE, mix, powers

STATISTICS = ("words", "word_length", "symbols", "bangs", "bars", "capitals", "digits", "variety", "echoes", "line_words", "line_copies", "stops")
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&<>^~=_@\\{}[]", np.uint8))
SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
KINDS = {
    "symbols": SYMBOLS,
    "bangs": np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8)),
    "bars": np.arange(256) == ord("|"),
    "digits": np.isin(np.arange(256), np.arange(48, 58)),
    "stops": np.isin(np.arange(256), np.frombuffer(b".,;:", np.uint8)),
    "large": np.isin(np.arange(256), np.arange(65, 91)),
    "small": np.isin(np.arange(256), np.arange(97, 123)),
}


def runs(data: np.ndarray, bounds: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, bounds by text, first bytes) of the longest runs of bytes that are not cuts."""
    inside = ~cut
    first = np.zeros(data.size + 1, bool)
    first[bounds] = True
    begins = inside.copy()
    begins[1:] &= cut[:-1] | first[1:-1]
    starts = np.flatnonzero(begins)
    of = np.searchsorted(starts, bounds)
    if not starts.size:
        return np.zeros(0, np.uint64), of, starts
    own = data[inside].astype(np.uint64) + np.uint64(1)
    at = np.flatnonzero(begins[inside])
    length = np.diff(np.append(at, own.size))
    place = np.arange(own.size) - np.repeat(at, length)
    return mix(np.add.reduceat(own * powers(int(length.max()))[place], at)), of, starts


def kinds_of(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many different values each text has."""
    owner = np.repeat(np.arange(of.size - 1, dtype=np.uint64), np.diff(of))
    key = np.sort((owner << np.uint64(44)) | (values >> np.uint64(20)))
    new = np.append(True, key[1:] != key[:-1])[: key.size]
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=of.size - 1)


def statistics(array: pa.Array) -> np.ndarray:
    """The transformed statistics of each text, as an array of (texts, statistics)."""
    data, bounds = string_bytes(array)
    texts = len(array)
    running = {k: np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)]) for k, table in KINDS.items()}
    count = {k: (c[bounds[1:]] - c[bounds[:-1]]).astype(float) for k, c in running.items()}
    space = SPACES[data]
    visible = np.diff(bounds) - np.diff(np.concatenate([[0], np.cumsum(space)])[bounds])
    words, of, starts = runs(data, bounds, space)
    n = np.diff(of).astype(float)
    lines, of_lines, _ = runs(data, bounds, data == 10)
    n_lines = np.diff(of_lines).astype(float)
    same = np.append(False, words[1:] == words[:-1])[: words.size]
    same[of[:-1][of[:-1] < words.size]] = False
    echo = np.diff(np.concatenate([[0], np.cumsum(same)])[of])
    many, lots = np.maximum(n, 1), np.maximum(n_lines, 1)
    letters = np.maximum(count["large"] + count["small"], 1)
    kinds = kinds_of(words, of)
    out = [
        np.log1p(n),
        np.log1p(visible / many),
        np.log1p(20 * count["symbols"] / many),
        np.log1p(20 * count["bangs"] / many),
        np.log1p(20 * count["bars"] / many),
        np.sqrt(count["large"] / letters),
        np.log1p(20 * count["digits"] / np.maximum(visible, 1)),
        np.log1p(kinds) / np.log1p(many),
        np.sqrt(echo / many),
        np.log1p(n / lots),
        np.sqrt(1 - kinds_of(lines, of_lines) / lots) * (n_lines > 0),
        np.log1p(20 * count["stops"] / many),
    ]
    return np.stack(out, 1) if texts else np.zeros((0, len(STATISTICS)))


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the statistics of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), *((s, pa.float64()) for s in STATISTICS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = statistics(part.column(1))
                yield from emit([{"doc_id": part.column(0), "text_hash": part.column(2)} | {s: found[:, i] for i, s in enumerate(STATISTICS)}], schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")))
    return rows.mapInArrow(run, "doc_id long, text_hash long, " + ", ".join(f"{s} double" for s in STATISTICS))


class Discriminant:
    """Class means and the cached Cholesky factors of shrunk class covariances."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float):
        sizes = np.array([moments.get(c, (0,))[0] for c in (0, 1)], float)
        self.share = sizes[1] / sizes.sum() if sizes.sum() else 0.5
        self.ready = bool((sizes >= 2).all())
        if not self.ready:
            return
        means = [moments[c][1] / moments[c][0] for c in (0, 1)]
        spreads = [moments[c][2] / moments[c][0] - np.outer(m, m) for c, m in zip((0, 1), means, strict=True)]
        pooled = (sizes[0] * spreads[0] + sizes[1] * spreads[1]) / sizes.sum()
        floor = np.maximum(np.diag(pooled), 1e-6)
        self.classes = []
        for size, mean, spread in zip(sizes, means, spreads, strict=True):
            shrunk = (1 - shrinkage) * spread + shrinkage * np.diag(floor)
            factor = np.linalg.cholesky(shrunk + np.diag(1e-9 * floor + 1e-12))
            self.classes.append((mean, np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(size / sizes.sum())))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.share)
        logs = [prior - logdet - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, logdet, prior in self.classes]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(described: DataFrame, labels: DataFrame, shrinkage: float = 0.1) -> Discriminant:
    """Class moments over all labelled rows of the learning folds; only sums come to the driver."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null")
    d = len(STATISTICS)
    sums = [F.sum(s).alias(f"s{i}") for i, s in enumerate(STATISTICS)]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(STATISTICS) for j, b in enumerate(STATISTICS) if i <= j]
    rows = described.filter(fold("doc_id", 4) != 2).join(lab.filter(fold("doc_id", 4) != 2), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), *sums, *products).collect()
    moments = {}
    for r in rows:
        second = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        moments[r["quality"]] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(d)]), second)
    return Discriminant(moments, shrinkage)


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("text_hash", pa.int64())])


def quality_scores(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and text_hash (xxhash64 of its text) of every document.

    The statistics are made once and kept in the shared folder; fit and scoring
    read them from there.
    """
    described = saved(describe(docs))
    model = share(docs.sparkSession, fit(described, labels, shrinkage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = opened(model)
        for batch in batches:
            x = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(STATISTICS))], 1) if batch.num_rows else np.zeros((0, len(STATISTICS)))
            score = fitted.scores(x)
            yield from emit([{"doc_id": batch.column(0), "held_out": batch.column(len(STATISTICS) + 1), "score": score, "predicted": (score >= threshold).astype(np.int32), "text_hash": batch.column(len(STATISTICS) + 2)}], OUT)

    rows = described.select("doc_id", *STATISTICS, (fold("doc_id", 4) == 2).alias("held_out"), "text_hash")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, text_hash long")
