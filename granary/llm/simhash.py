"""Operator 11: near duplicates by SimHash, found by the generalised pigeonhole principle.

A text's shingles are the runs of ``K`` words of its text in small letters (A-Z only);
a bit of its fingerprint is one if it is set in over half of the shingles' XXH64
hashes. Fingerprints of at most ``distance`` differing bits are linked, and a document's component is
what it reaches over links.

The 64 bits are cut into ``PARTS`` parts of 16, correlated bits in one part (counted over
all fingerprints). If two fingerprints differ in at most d bits, then for any thresholds t_i
of the parts with sum d - PARTS + 1 there is a part in which they differ in at most t_i bits
(-1: the part is left out). How many fingerprints lie within t bits of a value of a
part follows exactly from the histogram of the part's values; for each fingerprint a dynamic
program over the parts chooses the thresholds with the least candidates and probes. It then probes
the values within its thresholds, and every fingerprint that it meets there is compared in full.

Equal fingerprints are one row from the start. No pair is written: the rows of a part's value
meet in cells of at most ``block`` stored and ``block`` probing fingerprints (a hot value
has many cells), and a cell returns at most one link for each of its fingerprints, which join
what its pairs join. The tables that tasks get are those of PARTS * 65,536 values, whatever the input.

Null texts and texts without a word have the fingerprint zero, linked like any other; texts of under
``K`` words have one shingle of all their words. Every row has its own fingerprint, rows of one id too.
Rows with a null id are kept; a component's id is its least id, null if it has none. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.order_minhash import components
from granary.llm.tables import Scratch, dealt, emit, opened, saved, share, slices

K, DISTANCE, SEED = 4, 4, 42
PARTS, WIDTH = 4, 16
VALUES = 1 << WIDTH
#: What a probe costs, in comparisons of two fingerprints.
PROBE = 100
BLOCK, SLAB, CHUNK = 8192, 32_768, 1 << 21
SMALL = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's shingles."""
    import xxhash

    words = (text or "").encode().translate(SMALL).split()  # bytes split at the six ASCII white spaces only
    if not words:
        return 0
    if len(words) <= K:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    data, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: 1 - K]
    hashed = np.fromiter((xxhash.xxh64_intdigest(data[a:b], SEED) for a, b in zip(starts.tolist(), ends[K - 1 :].tolist(), strict=True)), "<u8", len(starts))
    ones = sum(bits_of(hashed[i : i + CHUNK // 64]).sum(axis=0, dtype=np.int64) for i in range(0, hashed.size, CHUNK // 64))
    return sum(1 << i for i in np.flatnonzero(2 * ones > hashed.size).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = np.array([fingerprint(x.as_py()) for x in part.column(1)], np.uint64)
                yield from emit([{"doc_id": part.column(0), "fp": found.view(np.int64)}], schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def bits_of(fps: np.ndarray) -> np.ndarray:
    """The 64 bits of each fingerprint, the lowest first."""
    return np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def summed(df: DataFrame, count, size: int) -> np.ndarray:
    """Sums over all tasks of the ``size`` counts that ``count`` makes of the column fp; zeros are not sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fps), CHUNK // 64):
                total += count(fps[i : i + CHUNK // 64])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["at", "n"])

    found = df.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out


def together(fps: np.ndarray) -> np.ndarray:
    """How many fingerprints have both of two bits, for all pairs of bits."""
    own = bits_of(fps).astype(np.float64)
    return (own.T @ own).astype(np.int64).ravel()


def grouped_bits(both: np.ndarray, n: int) -> list[list[int]]:
    """Parts of correlated bits: each takes the free bit of most correlation with the other free ones, then those most correlated with it."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    close = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(close, 0)
    free, parts = list(range(64)), []
    while free:
        part = [max(free, key=lambda b: (close[b, free].sum(), -b))]
        while len(part) < WIDTH:
            part.append(max((b for b in free if b not in part), key=lambda b: (close[b, part].sum(), -b)))
        parts.append(sorted(part))
        free = [b for b in free if b not in part]
    return parts


def within(counts: np.ndarray, most: int) -> np.ndarray:
    """For each value and t up to ``most``: how many fingerprints have a value at most t bits away."""
    exact = np.zeros((most + 1, VALUES), np.int64)
    exact[0] = counts
    values = np.arange(VALUES)
    for bit in range(WIDTH):  # away by t bits of those seen so far
        exact[1:] += exact[:-1, values ^ (1 << bit)]
    return exact.cumsum(axis=0)


class Probes:
    """The thresholds and probes of fingerprints under the counts of all of them."""

    def __init__(self, parts: list[list[int]], counts: np.ndarray, distance: int, probe_cost: int = PROBE):
        self.parts, self.distance, self.probe_cost = parts, distance, probe_cost
        self.counts = counts.reshape(PARTS, VALUES)
        self.near = np.stack([within(c, distance) for c in self.counts])
        self.masks = [np.array([sum(1 << b for b in which) for which in combinations(range(WIDTH), t)], np.int64) for t in range(distance + 1)]

    def values(self, fps: np.ndarray) -> np.ndarray:
        """The value of each part, by fingerprint."""
        own, weight = bits_of(fps), 1 << np.arange(WIDTH)
        return np.stack([own[:, part] @ weight for part in self.parts], axis=1)

    def thresholds(self, values: np.ndarray) -> np.ndarray:
        """For each fingerprint the thresholds (-1: no probe) of least cost whose sum is distance - PARTS + 1."""
        goal, most = self.distance - PARTS + 1, self.distance
        least = -PARTS  # sums are kept at s - least
        best = np.full((len(values), most - least + 1), np.inf)
        best[:, -least] = 0
        chosen = np.zeros((PARTS, *best.shape), np.int8)
        for i in range(PARTS):
            after = np.full_like(best, np.inf)
            for t in range(-1, most + 1):
                cost = self.near[i, t, values[:, i]] + self.probe_cost * sum(comb(WIDTH, j) for j in range(t + 1)) if t >= 0 else np.zeros(len(values))
                moved = np.full_like(best, np.inf)
                if t < 0:
                    moved[:, :-1] = best[:, 1:]
                else:
                    moved[:, t:] = best[:, : best.shape[1] - t]
                moved += cost[:, None]
                better = moved < after
                after[better], chosen[i][better] = moved[better], t
            best = after
        out, at = np.empty((len(values), PARTS), np.int8), np.full(len(values), goal - least)
        for i in reversed(range(PARTS)):
            out[:, i] = chosen[i][np.arange(len(values)), at]
            at = at - out[:, i]
        return out

    def probed(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of ``fps``, keys part * VALUES + value) of all probes that can meet another fingerprint."""
        values = self.values(fps)
        limits, rows, keys = self.thresholds(values), [], []
        for i in range(PARTS):
            for t, masks in enumerate(self.masks):
                who = np.flatnonzero(limits[:, i] >= t)
                found = values[who, i][:, None] ^ masks
                rows.append(np.repeat(who, len(masks)))
                keys.append((found + i * VALUES).ravel())
        rows, keys = np.concatenate(rows), np.concatenate(keys)
        own = keys == (values + np.arange(PARTS) * VALUES)[rows, keys // VALUES]
        there = self.counts.ravel()[keys] > own
        return rows[there], keys[there]


def spread(fps: np.ndarray) -> np.ndarray:
    x = fps * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(8)


def cells(alike: DataFrame, probes: Probes, probing: np.ndarray, block: int, slab: int) -> DataFrame:
    """Rows (slab, x, y, key, fp, probe) of every value that holds a fingerprint and is probed.

    A value of over ``block`` stored or probing fingerprints has cells of its own; the others share slabs of about ``slab`` rows.
    """
    stored = probes.counts.ravel() * (probing > 0)
    xs, ys = -(-stored // block), -(-probing // block)
    hot = (xs > 1) | (ys > 1)
    of = np.where(hot, 0, stored + probing).cumsum() // slab
    of = np.where(hot, of[-1] + 1 + np.arange(of.size), of)
    shared = share(alike.sparkSession, (probes, xs.astype(np.int32), ys.astype(np.int32), of.astype(np.int32)))
    names = ["slab", "x", "y", "key", "fp", "probe"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, xs, ys, of = opened(shared)
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fps), 4096):
                some = fps[i : i + 4096]
                keys = (probes.values(some) + np.arange(PARTS) * VALUES).ravel()
                rows = np.repeat(np.arange(len(some)), PARTS)
                at = ys[keys] > 0
                yield from placed(some[rows[at]], keys[at], xs, ys, of, False)
                rows, keys = probes.probed(some)
                yield from placed(some[rows], keys, ys, xs, of, True)

    def placed(fps: np.ndarray, keys: np.ndarray, own: np.ndarray, others: np.ndarray, of: np.ndarray, probe: bool) -> Iterator[pa.RecordBatch]:
        at = (spread(fps) % own[keys].astype(np.uint64)).astype(np.int32)
        times = others[keys]
        start = np.cumsum(times) - times
        for a in range(0, len(fps), 1 << 16):
            b = min(a + (1 << 16), len(fps))
            pick = np.repeat(np.arange(a, b), times[a:b])
            other = (np.arange(pick.size) - np.repeat(start[a:b] - start[a], times[a:b])).astype(np.int32)
            x, y = (other, at[pick]) if probe else (at[pick], other)
            yield pa.RecordBatch.from_arrays([pa.array(of[keys[pick]]), pa.array(x), pa.array(y), pa.array(keys[pick].astype(np.int32)), pa.array(fps[pick].view(np.int64)), pa.array(np.full(pick.size, probe))], names=names)

    return alike.select("fp").mapInArrow(run, "slab int, x int, y int, key int, fp long, probe boolean")


def forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels (each a node of its class, itself labelled so) after the links a-b join classes."""
    while (apart := label[a] != label[b]).any():
        a, b = a[apart], b[apart]
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label != (up := label[label])).any():
            label = up
    return label


def linked(keys: np.ndarray, fps: np.ndarray, probe: np.ndarray, distance: int, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the pairs of stored and probing fingerprints of the same key join."""
    nodes, node = np.unique(fps, return_inverse=True)
    label = np.arange(nodes.size)
    stored, asked = np.flatnonzero(~probe), np.flatnonzero(probe)
    stored = stored[np.argsort(keys[stored], kind="stable")]
    first, last = (np.searchsorted(keys[stored], keys[asked], side) for side in ("left", "right"))
    times = last - first
    for part in np.split(np.arange(asked.size), np.searchsorted(np.cumsum(times), np.arange(chunk, times.sum(), chunk))):
        if not (n := times[part]).sum():
            continue
        one = np.repeat(asked[part], n)
        other = stored[np.arange(one.size) - np.repeat(np.cumsum(n) - n - first[part], n)]
        one, other = node[one], node[other]
        apart = (label[one] != label[other]) & (one > other)  # the greater one of two meets the lesser
        one, other = one[apart], other[apart]
        close = np.bitwise_count(nodes[one] ^ nodes[other]) <= distance
        label = forest(one[close], other[close], label)
    joined = np.flatnonzero(label != np.arange(nodes.size))
    return nodes[joined], nodes[label[joined]]


def links(alike: DataFrame, distance: int, block: int = BLOCK, slab: int = SLAB) -> DataFrame:
    """Links (a, b) between the fingerprints of ``alike`` that join all that lie within ``distance`` bits."""
    n = alike.count()
    parts = grouped_bits(summed(alike, together, 64 * 64).reshape(64, 64), n)
    probes = Probes(parts, np.zeros(PARTS * VALUES, np.int64), distance)
    first = probes.values
    count = lambda fps: np.bincount((first(fps) + np.arange(PARTS) * VALUES).ravel(), minlength=PARTS * VALUES)
    probes = Probes(parts, summed(alike, count, PARTS * VALUES), distance)
    shared = share(alike.sparkSession, probes)
    probing = summed(alike, lambda fps: np.bincount(opened(shared).probed(fps)[1], minlength=PARTS * VALUES), PARTS * VALUES)

    def meet(cell: pa.Table) -> pa.Table:
        a, b = linked(cell.column("key").to_numpy(), cell.column("fp").to_numpy().view(np.uint64), cell.column("probe").to_numpy(), distance)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return cells(alike, probes, probing, block, slab).groupBy("slab", "x", "y").applyInArrow(meet, "a long, b long")


def simhash_components(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.table(fingerprints(docs))
        alike = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("k")))
        roots = components(scratch, scratch.table(links(alike, distance)))
        nodes = alike.join(roots.toDF("fp", "root"), "fp", "left").select("fp", "low", F.col("k").alias("times"), F.coalesce("root", "fp").alias("root"))
        least = nodes.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("k"))
        named = dealt(nodes.select("fp", "times", "root"), least, ["root"], alike.count()).select("fp", "component_id", F.col("times").alias("k"))
        return saved(dealt(rows, named, ["fp"], rows.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
