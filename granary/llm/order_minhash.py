"""Operator 6: near duplicates by Order MinHash.

A text is a list of words (``words.py``). Its k-mers are runs of five words, each
labelled with how many equal ones stand before it. For each of ``sketches`` hash
functions the ``take`` k-mers of least hash are chosen and, kept in text order,
hashed into one value: texts of small edit distance share values, texts with the
same words in another order do not. Texts that share a value are candidates; a
banded alignment verifies them. Their similarity is 2 * common / (words of both),
where common is the longest common subsequence of their words, and 0.8 or more
makes a link. Two texts of that similarity differ by at most 0.2 of their words
together, so an alignment never leaves the band of that width: the band loses nothing.

Texts of fewer than ``SHORT`` k-mers have further values of one k-mer each: so
few k-mers can be left between edits that two common ones are seldom the least.

Equal texts (same words in the same order) are one class from the start and only
their first document is compared. No bucket is expanded into pairs: first every
text is compared with at most three of the texts that come first in its buckets (the least id,
and those of most shared buckets). Then, in every bucket that still holds several classes,
all its texts of different classes meet, in blocks: bit sets of words rule out most pairs that
cannot be similar enough, and never one that is; the others are aligned until their classes
are joined. So no link between classes of one bucket is left out. Classes are the connected components of links,
found by star contraction. What lies between is written to the shared folder and deleted at the end.
Keys of very many rows (buckets, centres, nodes, equal texts) are met in parts.

Null and empty texts, and texts without a word, are only equal to one another
when both have no word, and are never linked: each is a class of its own. Texts
of under five words have one k-mer of all their words. Ties go to the lowest id. Rows
with a null id are dropped (``one_of_each`` keeps them); rows of one id are one document,
with the text of least fingerprint. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.tables import Scratch, dealt, emit, saved, slices, string_bytes
from granary.llm.words import codes, mix, occurrences, powers, shingles

K, SKETCHES, TAKE, SIMILARITY = 5, 64, 2, 0.8
#: Texts of fewer k-mers than SHORT have so many further values, of one k-mer each.
SHORT, SHORT_SKETCHES = 64, 16
WHOLE = -9  # the part of a bucket that is not cut by size


def factors(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


def fingerprints(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over the words and their places, by text."""
    size = np.diff(bounds)
    place = np.arange(words.size) - np.repeat(bounds[:-1], size)
    by = powers(int(size.max()) + 1 if size.size else 1)
    filled, out = np.flatnonzero(size), []
    for seed in (3, 4):
        total = np.zeros(size.size, np.uint64)
        if filled.size:
            total[filled] = np.add.reduceat(mix(words + np.uint64(seed)) * by[place], bounds[filled])
        out.append(mix(total + size.astype(np.uint64)))
    return out[0], out[1]


def kmers(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mers; a text of under K words has one, of all its words."""
    size = np.diff(bounds)
    if (short := (size > 0) & (size < K)).any():  # filled up with a code that no word has
        filler = np.uint64(0x5851F42D4C957F2D)
        wide = np.where(short, K, size)
        out_bounds = np.concatenate([[0], np.cumsum(wide)])
        filled = np.full(out_bounds[-1], filler, np.uint64)
        filled[np.arange(words.size) + np.repeat(out_bounds[:-1] - bounds[:-1], size)] = words
        words, bounds = filled, out_bounds
    values, of = shingles(words, bounds, K)
    return mix(values + factors(1, 5) * (occurrences(values, of) + np.uint64(1))), of


def sketches_of(labelled: np.ndarray, bounds: np.ndarray, multipliers: np.ndarray, take: int) -> np.ndarray:
    """One value for each text and hash function: the least k-mers in text order.

    A hash's low bits make room for the k-mer's place, so a minimum over the text tells
    where it stands. No array is larger than the k-mers of the texts and none is made by hash function and k-mer.
    """
    size = np.diff(bounds)
    filled = np.flatnonzero(size)
    out = np.zeros((size.size, multipliers.size), np.uint64)
    if not filled.size:
        return out
    starts, most = bounds[filled], np.iinfo(np.uint64).max
    low = np.uint64((1 << max(20, int(labelled.size).bit_length())) - 1)
    place = np.arange(labelled.size, dtype=np.uint64)
    spread = labelled ^ (labelled >> np.uint64(29))
    hashed = np.empty_like(labelled)
    for j, by in enumerate(multipliers | np.uint64(1)):
        np.multiply(spread, by, out=hashed)
        np.bitwise_and(hashed, ~low, out=hashed)
        np.bitwise_or(hashed, place, out=hashed)
        at = np.empty((take, filled.size), np.int64)
        for t in range(take):
            least = np.minimum.reduceat(hashed, starts)
            at[t] = np.where(least == most, labelled.size, least & low)  # no k-mer is left
            hashed[at[t][at[t] < labelled.size]] = most
        at.sort(axis=0)
        total = np.zeros(filled.size, np.uint64)
        for row in at:
            there = row < labelled.size
            total[there] = mix(total[there] + labelled[row[there]])
        out[filled, j] = total
    return out


def describe(docs: DataFrame, sketches: int, take: int) -> DataFrame:
    """doc_id, n words, two fingerprints and the sketch of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("sketch", pa.list_(pa.int64()))])
    multipliers = factors(sketches, 11)
    bands = factors(sketches, 13)
    more = factors(SHORT_SKETCHES, 19)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                words, bounds = codes(*string_bytes(part.column(1)))
                one, two = fingerprints(words, bounds)
                labelled, of = kmers(words, bounds)
                values = mix(sketches_of(labelled, of, multipliers, take) + bands).view(np.int64)
                found = [own if b > a else own[:0] for own, a, b in zip(values, of[:-1], of[1:], strict=True)]
                size = np.diff(of)
                short = (size > 0) & (size < SHORT)
                ends = np.concatenate([[0], np.cumsum(size[short])])
                extra = mix(sketches_of(labelled[np.repeat(short, size)], ends, more, 1) ^ more).view(np.int64)
                for i, own in zip(np.flatnonzero(short), extra, strict=True):
                    found[i] = np.concatenate([found[i], own])
                yield from emit([{"doc_id": part.column(0), "n": np.diff(bounds), "fp1": one.view(np.int64), "fp2": two.view(np.int64), "sketch": found}], schema)

    return docs.mapInArrow(run, "doc_id long, n int, fp1 long, fp2 long, sketch array<long>")


def word_lists(docs: DataFrame) -> DataFrame:
    """doc_id, a fingerprint, the text's words as packed 32-bit codes, for alignment, and their bit set."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp1", pa.int64()), ("words", pa.binary()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                words, bounds = codes(*string_bytes(part.column(1)))
                small = (words >> np.uint64(32)).astype("<u4")
                own = [small[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield from emit([{"doc_id": part.column(0), "fp1": fingerprints(words, bounds)[0].view(np.int64), "words": [x.tobytes() for x in own], "bits": [word_bits(x) for x in own]}], schema)

    return docs.mapInArrow(run, "doc_id long, fp1 long, words binary, bits binary")


def common(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence with places at most ``band`` apart, by bit-parallel alignment."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    a, b = a[start : len(a) - stop], b[start : len(b) - stop]
    if not a or not b:
        return start + stop
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    wide = (1 << (2 * band + 1)) - 1
    rows = full  # a zero bit ends a longer common subsequence
    for j, w in enumerate(b):
        if match := where.get(w):
            match &= wide << (j - band) if j >= band else wide >> (band - j)
            if match:
                kept = rows & match
                rows = ((rows + kept) | (rows - kept)) & full
    return start + stop + len(a) - rows.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """2 * common / (words of both) if that reaches ``least``, else a value below it."""
    both = len(a) + len(b)
    if both == 0 or 2 * min(len(a), len(b)) < least * both:
        return 0.0
    ka, na = np.unique(a, return_counts=True)
    kb, nb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if 2 * np.minimum(na[ia], nb[ib]).sum() < least * both:
        return 0.0
    return 2 * common(a.tolist(), b.tolist(), int((1 - least) * both) + 1) / both


def verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose similarity is ``least`` or more.

    A text can be the first of its bucket for very many others, so the pairs of
    such a ``b`` are dealt out in parts.
    """
    words = words.select("doc_id", "words")
    centres = pairs.groupBy("b").agg(F.count("*").alias("k")).join(words.withColumnsRenamed({"doc_id": "b", "words": "wb"}), "b")
    met = dealt(pairs.select("a", "b").join(words.withColumnsRenamed({"doc_id": "a", "words": "wa"}), "a"), centres, ["b"], pairs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            a, b, wa, wb = (batch.column(i) for i in range(4))
            good = [similarity(np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4"), least) >= least for x, y in zip(wa, wb, strict=True)]
            keep = pa.array(good, pa.bool_())
            yield from emit([{"a": a.filter(keep), "b": b.filter(keep)}], schema)

    return met.select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def word_bits(words: np.ndarray) -> bytes:
    """A bit set of the words, equal ones told apart by their number; 4 bits or more a word up to 2**16 bits."""
    width = min(max(64, 1 << (4 * len(words) - 1).bit_length()), 1 << 16)
    found = words.astype(np.uint64)
    marked = mix(found + factors(1, 17) * (occurrences(found, np.array([0, found.size])) + np.uint64(1)))
    bits = np.zeros(width, np.uint8)
    bits[marked & np.uint64(width - 1)] = 1
    return np.packbits(bits).tobytes()


def folded(packed: list[bytes]) -> np.ndarray:
    """Bit sets as the rows of one array, the wider ones folded to the least width."""
    width = min(map(len, packed))
    return np.array([np.bitwise_or.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), axis=0) for x in packed])


def possible(n: np.ndarray, bits: np.ndarray, least: float, rows: np.ndarray | slice = slice(None), step: int = 256) -> np.ndarray:
    """Which pairs of some texts (``rows``) and all texts can have the similarity ``least``.

    With ``common`` words in common a text has n - common others, so no more of its
    bits can be missing in the other's. Equal bits of different words only let more pairs through.
    """
    both = np.zeros((len(n[rows]), len(n)), np.float32)
    for i in range(0, bits.shape[1], step):
        own = np.unpackbits(bits[:, i : i + step], axis=1).astype(np.float32)
        both += own[rows] @ own.T
    have, n = np.bitwise_count(bits).sum(axis=1).astype(np.float32), n.astype(np.float32)
    common = np.float32(least / 2) * (n[rows, None] + n[None, :]) - np.float32(1e-3)
    return (np.minimum(n[rows, None], n[None, :]) >= common) & (have[rows, None] - both <= n[rows, None] - common) & (have[None, :] - both <= n[None, :] - common)


def links_in_buckets(scratch: Scratch, held: DataFrame, words: DataFrame, least: float, total: int, block: int = 2048, block_words: int = 4_000_000, chunk: int = 512) -> DataFrame:
    """Links (a, b), a > b, that join all classes of which two texts share a bucket and are similar enough.

    ``held`` has doc_id, n, bucket, k and volume (texts and words of the bucket) and root. Texts of that similarity
    have lengths of the same or of neighbouring sizes; a group is a bucket, or of a large one the texts of two
    such sizes. Texts of its largest class need not meet one another, so they and the
    others are dealt out in blocks of about ``block`` texts, fewer if ``block_words`` words fill it: block i of the class meets each block
    j of the others (cell i, j; the others of block j meet among themselves in cell 0, j), and blocks
    l < j of the others meet in cell -1 - l, j. A large class with a few others costs a few rows more than it has.

    In a cell every pair of different classes that bit sets allow is aligned, until its
    classes are joined; so a cell returns fewer links than it has texts, whatever its pairs.
    """
    width = max(float(np.log((2 - least) / least)), 0.01) * (1 + 1e-9)
    sized = held.withColumn("size", F.floor(F.log("n") / F.lit(width)).cast("int"))
    at_once = (F.col("k") <= block) & (F.col("volume") <= block_words)
    near = sized.withColumn("part", F.explode(F.when(at_once, F.array(F.lit(WHOLE))).otherwise(F.array(F.col("size"), F.col("size") - 1)))).drop("volume")
    counted = near.groupBy("bucket", "part", "root").agg(F.count("*").alias("of"), F.min("size").alias("small"), F.max("k").alias("k"))
    groups = counted.groupBy("bucket", "part").agg(F.sum("of").alias("members"), F.max(F.struct("of", "root")).alias("main"), F.min("small").alias("small"), F.max("k").alias("k"))
    groups = groups.filter(f"main.of < members and (small = part or part = {WHOLE})")
    blocks = lambda n: F.ceil(n / F.greatest(F.lit(64), F.least(F.lit(block), F.lit(block_words) / F.exp(F.lit(width) * (F.col("part") + 2))))).cast("int")
    groups = groups.select("bucket", "part", F.col("main.root").alias("main"), blocks(F.col("main.of")).alias("inside"), blocks(F.col("members") - F.col("main.of")).alias("others"), "k")
    in_main = F.col("root") == F.col("main")
    parts = dealt(near, groups, ["bucket", "part"], total).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.when(in_main, F.col("inside")).otherwise(F.col("others"))).cast("int"))
    to = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    with_others = F.transform(to(F.col("others")), lambda y: cell(F.col("own"), y))
    with_main = F.transform(to(F.col("inside")), lambda x: cell(x, F.col("own")))
    among = F.transform(F.filter(to(F.col("others")), lambda y: y != F.col("own")), lambda y: cell(-1 - F.least(y, F.col("own")), F.greatest(y, F.col("own"))))
    parts = parts.select("doc_id", "n", "root", "bucket", "part", "size", "own", in_main.alias("in_main"), F.explode(F.when(in_main, with_others).otherwise(F.concat(with_main, among))).alias("cell"))
    parts = scratch.table(parts.select("*", "cell.x", "cell.y").drop("cell"))

    def meet(group: pa.Table) -> pa.Table:
        ids, n, root, part, size, own, x = (group.column(c).to_numpy() for c in ("doc_id", "n", "root", "part", "size", "own", "x"))
        in_main, bits = group.column("in_main").to_numpy(), group.column("bits").to_pylist()
        words = [np.frombuffer(w, "<u4") for w in group.column("words").to_pylist()]
        label, found = root.copy(), []
        for small in np.unique(size) if part[0] == WHOLE else part[:1]:
            here = np.flatnonzero((size == small) | (size == small + 1))
            own_bits, first = folded([bits[i] for i in here]), size[here] == small
            for rows in (here[i : i + chunk] for i in range(0, len(here), chunk)):
                pair = (ids[rows, None] > ids[here]) & (label[rows, None] != label[here]) & ((size[rows, None] == small) | first)
                if x[0] > 0:
                    pair &= in_main[rows, None] != in_main[here]
                elif x[0] < 0:
                    pair &= own[rows, None] != own[here]
                if not pair.any():
                    continue
                pair &= possible(n[here], own_bits, least, np.searchsorted(here, rows))
                for one, likely in zip(rows, pair, strict=True):
                    rest = here[likely]
                    while (rest := rest[label[rest] != label[one]]).size:
                        other, rest = rest[0], rest[1:]
                        if similarity(words[one], words[other], least) >= least:
                            found.append((ids[one], ids[other]))
                            label[label == label[other]] = label[one]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    met = parts.join(words, "doc_id")
    return met.groupBy("bucket", "part", "x", "y").applyInArrow(meet, "a long, b long")


def is_contracted(edges: DataFrame) -> bool:
    """Whether every node but the roots has one edge, to its root."""
    ends = edges.selectExpr("a as x", "1 as ups", "0 as downs").union(edges.selectExpr("b", "0", "1"))
    return ends.groupBy("x").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs")).filter("ups > 1 or (ups = 1 and downs = 1)").isEmpty()


def components(scratch: Scratch, links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """id and root (the least id of its component) of every node but the roots of ``links`` (a stored table), by alternating star contraction.

    A large star links a node's greater neighbours to its least neighbour, a small star
    its smaller ones; both keep components and end in stars. Every step is a
    grouped minimum and a join, a node of very many neighbours met in parts, so no
    node's neighbours are ever held together. Rounds are about the logarithm of
    the longest path; it fails beyond ``most_rounds``.
    """
    edges = links.selectExpr("greatest(a, b) as a", "least(a, b) as b").filter("a != b")
    for _ in range(most_rounds):
        if is_contracted(edges):
            return edges.toDF("id", "root")
        total = 2 * edges.count()
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("k"))
        large = dealt(both.filter("v > u"), least, ["u"], total).selectExpr("v as a", "m as b").filter("a != b").repartition("a").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
        small = dealt(large, down, ["a"], total).selectExpr("b as a", "m as b").union(down.selectExpr("a", "m as b"))
        edges = scratch.table(small.filter("a != b").distinct())
    raise RuntimeError(f"components are not complete after {most_rounds} rounds")


def joined(scratch: Scratch, roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after further links: only the roots that these join are contracted again."""
    of = lambda side: roots.toDF(side, f"r{side}")
    lifted = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    over = components(scratch, scratch.table(lifted)).toDF("root", "over")
    nodes = roots.unionByName(over.selectExpr("root as id", "root")).groupBy("id").agg(F.min("root").alias("root"))
    held = nodes.groupBy("root").agg(F.count("*").alias("k")).join(over, "root")
    return dealt(nodes, held, ["root"], nodes.count(), "left").select("id", F.coalesce("over", "root").alias("root"))


def near_duplicates(docs: DataFrame, similarity_least: float = SIMILARITY, sketches: int = SKETCHES, take: int = TAKE, most_broadcast: int = 500_000) -> DataFrame:
    """doc_id and class_id (the least id of its class), one row for each document."""
    with Scratch(docs.sparkSession) as scratch:
        return saved(classes(scratch, docs, similarity_least, sketches, take, most_broadcast))


def classes(scratch: Scratch, docs: DataFrame, similarity_least: float, sketches: int, take: int, most_broadcast: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    own = F.when(F.col("n") > 0, F.lit(0)).otherwise(F.col("doc_id")).alias("own")  # a text without words equals none
    rows = scratch.table(describe(texts, sketches, take).select("*", own))
    repeated = not rows.groupBy("doc_id").agg(F.count("*").alias("times")).filter("times > 1").isEmpty()
    if repeated:
        rows = scratch.table(rows.groupBy("doc_id").agg(F.min(F.struct("fp1", "fp2", "n", "sketch", "own")).alias("one")).select("doc_id", "one.*"))
    text = ["fp1", "fp2", "n", "own"]
    alike = scratch.table(rows.groupBy(*text).agg(F.min(F.struct("doc_id", "sketch")).alias("least"), F.count("*").alias("k")).select(*text, "least.doc_id", "least.sketch", "k"))
    named = alike.select("doc_id", "n", "fp1", F.explode("sketch").alias("bucket"))
    size = named.groupBy("bucket").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "n")).alias("centre")).filter("k > 1")
    size = scratch.table(size)
    total = (sketches + SHORT_SKETCHES) * rows.count()
    members = scratch.table(dealt(named, size.withColumn("members", F.col("k")), ["bucket"], total).withColumnRenamed("members", "k"))
    total = members.count()
    met = members.select("doc_id", "fp1").distinct()
    met = F.broadcast(met) if met.count() <= most_broadcast else met
    words = word_lists(texts.join(met.select("doc_id"), "doc_id", "left_semi")).join(met, ["doc_id", "fp1"], "left_semi").drop("fp1")
    words = scratch.table(words.dropDuplicates(["doc_id"]) if repeated else words)
    close = f"least(n, m) * 2 >= {similarity_least} * (n + m)"

    near = members.filter("doc_id != centre.doc_id").selectExpr("doc_id as a", "centre.doc_id as b", "n", "centre.n as m").filter(close).repartition("a").groupBy("a", "b").agg(F.count("*").alias("shared"))
    most = F.slice(F.sort_array(F.collect_list(F.struct("shared", (-F.col("b")).alias("minus"))), asc=False), 1, 2)  # of at most ``sketches``
    picked = near.groupBy("a").agg(F.min("b").alias("low"), F.transform(most, lambda x: -x["minus"]).alias("top"))
    tested = scratch.table(picked.select("a", F.explode(F.array_union(F.array("low"), "top")).alias("b")))
    roots = components(scratch, scratch.table(verified(tested, words, similarity_least)))

    held = members.select("doc_id", "n", "bucket", "k").join(roots.toDF("doc_id", "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    held = scratch.table(held)
    seen = held.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("k").alias("k"), F.sum(F.col("n").cast("long")).alias("volume")).filter("low != high").select("bucket", "k", "volume")
    mixed = dealt(held, seen.withColumn("members", F.col("k")), ["bucket"], total).withColumnRenamed("members", "k")
    more = scratch.table(links_in_buckets(scratch, scratch.table(mixed), words, similarity_least, total))
    if not more.isEmpty():
        roots = scratch.table(joined(scratch, roots, more))
    ranked = alike.select("doc_id", *text, "k").join(roots.toDF("doc_id", "root"), "doc_id", "left").select(*text, F.coalesce("root", "doc_id").alias("class_id"), "k")
    return dealt(rows.select("doc_id", *text), ranked, text, rows.count()).select("doc_id", "class_id")


def one_of_each(docs: DataFrame, most_broadcast: int = 500_000, **options) -> DataFrame:
    """The documents that come first in their class, with all their columns.

    Rows with a null id stay. Rows of one id are one document; those that are equal in id and text stay once.
    """
    found = near_duplicates(docs, **options)
    gone = found.filter("doc_id != class_id").select(F.col("doc_id").alias("__gone"))
    gone = F.broadcast(gone) if gone.count() <= most_broadcast else gone
    kept = docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    if docs.filter("doc_id is not null").count() == found.count():
        return kept
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.filter("doc_id is null"))
