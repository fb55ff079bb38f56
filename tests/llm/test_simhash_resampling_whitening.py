"""Operators 11 to 13 against plain loops, with odd rows, empty tables and hot keys."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from granary.llm import resampling, simhash, whitening
from granary.llm.tables import Scratch, read
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, fp string, root string, rank string, weight long"
LONG = "parola Lunga " * 30_000
ODD = [(1, None), (2, ""), (3, "Uno due"), (3, "uno DUE"), (4, " \n\t "), (5, LONG), (6, "!!! ??? ..."), (7, "x" * 100_000), (None, "uno due"), (None, "è un testo solo"), (8, "a\x1cb\x85c"), (9, "ÀÈ straße")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "f", "r", "k", 1) for i, t in ODD], SCHEMA)


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_fingerprint(text):
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", small(text or "")) if w]
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)] * bool(words)
    hashed = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def plain_components(rows, distance=4):
    """(id, fingerprint) rows to the least id that each reaches, by a search from every row."""
    out, left = [None] * len(rows), set(range(len(rows)))
    while left:
        todo = [left.pop()]
        seen = list(todo)
        while todo:
            i = todo.pop()
            near = [j for j in left if (rows[i][1] ^ rows[j][1]).bit_count() <= distance]
            left -= set(near)
            todo += near
            seen += near
        least = min((rows[i][0] for i in seen if rows[i][0] is not None), default=None)
        for i in seen:
            out[i] = least
    return out


def order(x):
    return tuple((v is not None, v) for v in x)


def simhash_as_told(docs):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    want = sorted(((i, f"{fp:016x}", c) for (i, fp), c in zip(rows, plain_components(rows), strict=True)), key=order)
    assert sorted((tuple(r) for r in simhash.simhash_components(docs).collect()), key=order) == want
    return want


def test_simhash_is_a_plain_loop(spark):
    want = simhash_as_told(read(spark, FOLDER, "documents"))
    assert len({c for _, _, c in want}) < len(want)


def test_simhash_of_odd_rows(odd):
    found = {i: (fp, c) for i, fp, c in simhash_as_told(odd)}
    assert found[1] == found[2] == found[4] == ("0" * 16, 1)
    assert simhash.simhash_components(odd.limit(0)).collect() == []


@pytest.mark.parametrize(("block", "slab"), [(8192, 32_768), (16, 64)])
def test_links_join_what_all_pairs_join(spark, block, slab):
    """A third of the fingerprints lie round one centre, others in chains, others alone; small blocks cut hot values into cells."""
    rng = random.Random(7)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    centre = rng.getrandbits(64)
    fps = [flip(centre, rng.randint(0, 7)) for _ in range(300)] + [rng.getrandbits(64) for _ in range(300)]
    x = rng.getrandbits(64)
    for _ in range(100):
        x = flip(x, 4)
        fps.append(x)
    fps += [0, (1 << 64) - 1, flip(0, 4), flip(0, 5)]
    fps = sorted(set(fps))
    alike = spark.createDataFrame([(np.uint64(x).astype(np.int64).item(),) for x in fps], "fp long").repartition(3)
    with Scratch(spark) as scratch:
        found = simhash.links(alike, 4, block, slab)
        cells = simhash.components(scratch, scratch.table(found)).collect()
    root = {r["id"]: r["root"] for r in cells}
    signed = [np.uint64(x).astype(np.int64).item() for x in fps]
    ours = [root.get(x, x) for x in signed]
    theirs = plain_components(list(zip(range(len(fps)), fps, strict=True)))
    assert len(set(zip(ours, theirs, strict=True))) == len(set(ours)) == len(set(theirs))


def test_thresholds_are_the_cheapest():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    fps[:200] &= np.uint64(0xFFFF00000000FFFF)
    fps[50:300] |= np.uint64(0x00FFF00000000000)
    fps = np.unique(fps)
    parts = simhash.grouped_bits(simhash.together(fps).reshape(64, 64), len(fps))
    assert sorted(b for p in parts for b in p) == list(range(64))
    empty = simhash.Probes(parts, np.zeros(4 * 65536, np.int64), 4)
    counts = np.bincount((empty.values(fps) + np.arange(4) * 65536).ravel(), minlength=4 * 65536)
    probes = simhash.Probes(parts, counts, 4, probe_cost=1)
    values, found = probes.values(fps), probes.thresholds(probes.values(fps))
    cost = lambda row, ts: sum(int((np.bitwise_count(values[:, i] ^ row[i]) <= t).sum()) + sum(math.comb(16, j) for j in range(t + 1)) for i, t in enumerate(ts) if t >= 0)
    options = [t for t in np.ndindex(6, 6, 6, 6) if sum(t) - 4 == 1]
    for row, own in list(zip(values, found, strict=True))[::80]:
        assert sum(own) == 1
        assert cost(row, own.tolist()) == min(cost(row, [x - 1 for x in t]) for t in options)


def plain_resampling(docs, target):
    def features(text):
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", small(text or "")) if w]
        return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for texts, to in ((docs, s), (target, t)):
        for _, text in texts:
            for f in features(text)[1]:
                to[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        n, found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=order)


def test_resampling_is_a_plain_loop(spark, odd):
    pairs = lambda df: [tuple(r) for r in df.select(df.columns[0], "text").collect()]
    target = read(spark, FOLDER, "benchmark")
    hot = read(spark, FOLDER, "documents").select("doc_id", "text").unionByName(spark.range(1000, 3000).select(F.col("id").alias("doc_id"), F.lit("one text of which there are very many copies " * 3).alias("text")))
    for docs in (hot.repartition(7), odd):
        got = resampling.resampled(docs, target)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted((tuple(r) for r in got.collect()), key=order) == plain_resampling(pairs(docs), pairs(target))
    assert resampling.resampled(odd.limit(0), target).collect() == []
    assert sorted((tuple(r) for r in resampling.resampled(odd, target.limit(0)).collect()), key=order) == plain_resampling(pairs(odd), [])


def as_told(spark, vectors, k=32, **options):
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").withColumn("component", F.lit("x"))
    return sorted((tuple(r) for r in whitening.whitened(rows, k, **options).collect()))


@pytest.mark.parametrize(("d", "k"), [(6, 32), (64, 32), (90, 4)])
def test_whitening_is_that_of_all_eigenvectors(spark, d, k):
    rng = np.random.default_rng(d)
    raw = (rng.standard_normal((400, d)) * np.concatenate([2.0 ** -np.arange(6), np.full(max(0, d - 6), 0.02)])[:d] * 4).astype(np.float32)
    raw[100:200] = raw[0]
    got = as_told(spark, raw.tolist(), k)
    x = np.floor(64 * raw.astype(np.float64)) + 1_000_000
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    values, vectors, k = values[::-1], vectors[:, ::-1], min(d, k)
    want = (centred @ vectors[:, :k] / np.sqrt(values[:k])).reshape(-1)
    assert len(got) == len(x) * k
    assert np.allclose(np.abs([g[4] for g in got]), np.abs(want), atol=1e-7)
    whole = np.array([g[4] for g in got]).reshape(-1, k)
    assert np.abs(whole.T @ whole / len(x) - np.eye(k)).max() < 1e-9 and max(g[6] for g in got) < 1e-9
    assert np.allclose([g[5] for g in got], np.tile(values[:k] / values.sum(), len(x)), rtol=1e-9)
    sums = [int(v) for v in x.sum(axis=0)]
    assert [g[3] for g in got[::k]] == [sum((len(x) * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = rng.standard_normal((40, 3)).astype(np.float32).tolist()
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], [3e38, 0.0, 0.0]]
    got = as_told(spark, good + bad)
    alone = as_told(spark, good)
    assert {g[0] for g in got} == set(range(40)) and [g[:4] for g in got] == [g[:4] for g in alone]
    assert np.allclose([g[4:6] for g in got], [g[4:6] for g in alone], atol=1e-9)  # sums over other partitions differ in their last bits
    assert as_told(spark, []) == as_told(spark, bad[:5]) == as_told(spark, [[1.0, 2.0]] * 5) == []
    flat = as_told(spark, [[*v, 1.0] for v in good])  # a constant dimension has no component
    assert {g[1] for g in flat} == {1, 2, 3}


def test_whitening_fails_where_no_pass_certifies(spark):
    rng = np.random.default_rng(4)
    with pytest.raises(RuntimeError, match="not certified"):
        as_told(spark, rng.standard_normal((300, 80)).tolist(), 4, most_passes=2)
