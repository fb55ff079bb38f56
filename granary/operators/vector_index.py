"""A stored vector index: coarse cells, product-quantised residuals, probing and exact re-scoring.

The index is fitted once on a bounded sample (``most_sample`` vectors, drawn by a hash of their ids): k-means cells,
and for each of ``subspaces`` parts of the dimensions a code book of the residuals' parts. Every vector is then stored
under its nearest cell with its codes, so a batch of questions reads only the cells that it probes, scores
the codes there, and takes the best ``rescore`` of each question to their exact cosine.

Questions stay a table. A cell of very many vectors is met in parts of about ``most_rows`` rows, and questions of a cell in
blocks, so that no task holds more. What tasks get is the model: cells x dimensions and 256 x dimensions numbers.

Later vectors come in as segments with the same model; a vector that comes again replaces the one of the same id. Rows
with a null id or vector, of another length or of length zero are not stored; ids of one batch must differ, and all batches have the same columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.retrieve import metadata_filter, top
from granary.sources.store import Versions, saved

ROWS = "vec_id long, cell int, codes binary, embedding array<float>"


def unit(vectors) -> np.ndarray:
    m = np.stack([np.asarray(x, np.float64) for x in vectors])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def code_book(points: np.ndarray, size: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of k-means over a bounded sample of parts of residuals."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(size, len(points)), replace=False)]
    for _ in range(rounds):
        own = nearest(points, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Model:
    """Cells and code books."""

    def __init__(self, cells: np.ndarray, books: list[np.ndarray]):
        self.cells, self.books = cells, books
        self.ends = np.cumsum([0, *(b.shape[1] for b in books)])

    def parts(self, m: np.ndarray) -> list[np.ndarray]:
        return [m[:, a:b] for a, b in zip(self.ends[:-1], self.ends[1:], strict=True)]

    def stored(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each unit vector and the codes of what is left."""
        own = nearest(m, self.cells)
        return own, np.stack([nearest(p, book) for p, book in zip(self.parts(m - self.cells[own]), self.books, strict=True)], axis=1).astype(np.uint8)

    def scores(self, asked: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """About the cosines of questions and the stored codes of a cell."""
        out = np.repeat((asked @ self.cells[cell])[:, None], len(codes), axis=1)
        for part, book, own in zip(self.parts(asked), self.books, codes.T, strict=True):
            out += (part @ book.T)[:, own]
        return out


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root)
        self.folder = self.versions.folder

    # ---- writing

    def fit(self, vectors: DataFrame, cells: int | None = None, subspaces: int = 8, most_sample: int = 20_000) -> None:
        """Fits the model on a sample of (vec_id, embedding); the usual number of cells is the root of the number of vectors, at most 4096."""
        good = vectors.filter("vec_id is not null and embedding is not null and size(embedding) > 0").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        n = good.count()
        if not n:
            raise ValueError("no vector to learn from")
        usual = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()["d"]
        share = min(1.0, most_sample / n)
        sample = good.filter((F.size("embedding") == usual) & (F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share * 1_000_000))
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
        sample = sample.select(F.transform("embedding", lambda x: x / F.greatest(norm, F.lit(1e-12))).alias("v"))
        sample = sample.union(sample.limit(1)) if sample.count() < 2 else sample
        k = cells or max(1, min(4096, round(n**0.5)))
        if k > 1:
            fitted = KMeans(k=k, maxIter=10, seed=3, featuresCol="x").fit(sample.select(array_to_vector("v").alias("x")))
            centres = np.array(fitted.clusterCenters())
        else:
            centres = np.array(sample.agg(*[F.avg(F.get("v", F.lit(i))) for i in range(usual)]).first(), float)[None]
        ends = np.linspace(0, usual, min(subspaces, usual) + 1).astype(int)
        sent = self.spark.sparkContext.broadcast((centres, ends))

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres, ends = sent.value
            for batch in batches:
                if len(batch):
                    m = np.stack(batch["v"])
                    left = m - centres[nearest(m, centres)]
                    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                        yield pd.DataFrame({"part": i, "v": list(left[:, a:b])})

        def learn(key: tuple, own: pd.DataFrame) -> pd.DataFrame:  # of one part of the bounded sample
            points = np.stack(own["v"])
            book = code_book(points[np.lexsort(points.T)], 256)
            return pd.DataFrame({"kind": key[0], "at": range(len(book)), "v": list(book)})

        books = sample.mapInPandas(split, "part int, v array<double>").groupBy("part").applyInPandas(learn, "kind int, at int, v array<double>")
        rows = self.spark.createDataFrame([(-1, i, c.tolist()) for i, c in enumerate(centres)], "kind int, at int, v array<double>")
        name = uuid.uuid4().hex
        rows.unionByName(books).write.parquet(self.folder.at("models", name))
        seen, _ = self.versions.current()
        self.versions.commit(seen, {"model": name, "segments": []})

    def model(self, name: str) -> Model:
        rows = self.spark.read.parquet(self.folder.at("models", name)).orderBy("kind", "at").collect()  # a bounded number of rows
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(r["kind"], []).append(r["v"])
        return Model(np.array(by.pop(-1)), [np.array(v) for _, v in sorted(by.items())])

    def add(self, vectors: DataFrame) -> None:
        """Stores (vec_id, embedding, other columns) as a segment; rows of the same ids in earlier segments are dead from now on."""
        seen, facts = self.versions.current()
        model, name = self.model(facts["model"]), f"s{uuid.uuid4().hex}"
        sent = self.spark.sparkContext.broadcast(model)
        size = model.cells.shape[1]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = sent.value
            for batch in batches:
                if len(batch):
                    m = unit(batch["embedding"])
                    cell, codes = model.stored(m)
                    yield pd.DataFrame({"vec_id": batch["vec_id"], "cell": cell.astype(np.int32), "codes": [c.tobytes() for c in codes], "embedding": list(m.astype(np.float32)), **{c: batch[c] for c in others}})

        others = [c for c in vectors.columns if c not in ("vec_id", "embedding", "cell", "codes")]
        kinds = ROWS + "".join(f", `{c}` {dict(vectors.dtypes)[c]}" for c in others)
        good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), *others).filter(f"vec_id is not null and size(embedding) = {size}")
        stored = good.mapInPandas(run, kinds)
        stored.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(16))).write.partitionBy("cell").parquet(self.folder.at("vectors", f"segment={name}"))
        self.versions.commit(seen, facts | {"segments": [*facts["segments"], name]})

    # ---- reading

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """All live rows, or those of some cells: of an id, the row of the last segment."""
        _, facts = self.versions.current()
        names = facts["segments"]
        read = self.spark.read.parquet(self.folder.at("vectors")).filter(F.col("segment").isin(names))
        live = read if cells is None else read.filter(F.col("cell").isin(cells))
        if len(names) > 1:
            at = F.array_position(F.array(*map(F.lit, names)), F.col("segment"))
            last = read.select("vec_id", at.alias("__at")).filter("__at > 1").groupBy("vec_id").agg(F.max("__at").alias("__last"))
            live = live.withColumn("__at", at).join(last, "vec_id", "left").filter("__last is null or __at >= __last").drop("__at", "__last")
        return live.drop("segment")

    def probed(self, queries: DataFrame, model: Model, probes: int) -> DataFrame:
        """query_id, q (the unit vector), cell and near (from 0) of the ``probes`` nearest cells of each question."""
        sent = self.spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cells = sent.value.cells
            for batch in batches:
                if len(batch):
                    q = unit(batch["embedding"])
                    away = (cells**2).sum(axis=1) - 2 * q @ cells.T
                    best = np.argsort(away, axis=1, kind="stable")[:, :probes]
                    yield pd.DataFrame({"query_id": np.repeat(batch["query_id"].to_numpy(), best.shape[1]), "q": [v for v in q for _ in range(best.shape[1])], "cell": best.ravel().astype(np.int32), "near": np.tile(np.arange(best.shape[1], dtype=np.int32), len(q))})

        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding")).filter(f"size(embedding) = {model.cells.shape[1]}")
        return asked.mapInPandas(run, "query_id long, q array<double>, cell int, near int")

    def search(self, queries: DataFrame, k: int, probes: int, rescore: int = 100, least: float = 0.0, where: Column | dict | None = None, most_rows: int = 50_000, most_asked: int = 1024) -> DataFrame:
        """query_id, vec_id, score and rank: the ``k`` best by cosine among the best ``rescore`` codes of ``probes`` cells.

        The nearest cells, of about twice ``rescore`` rows, are scored first; of the others only what reaches the last of the best ``rescore`` there is returned.
        """
        _, facts = self.versions.current()
        model = self.model(facts["model"])
        asked = saved(self.probed(queries, model, probes))
        n_asked = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row for each cell
        live = self.rows(sorted(n_asked))
        if where is not None:
            live = live.filter(metadata_filter(where) if isinstance(where, dict) else where)
        n_rows = {r["cell"]: r["count"] for r in live.groupBy("cell").count().collect()}
        plan = [(c, ceil(n_rows[c] / most_rows), ceil(n / most_asked)) for c, n in n_asked.items() if n_rows.get(c)]
        sizes = F.broadcast(self.spark.createDataFrame(plan, "cell int, parts int, blocks int"))
        part, block = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        begun = max(1, ceil(2 * rescore * len(model.cells) / max(sum(n_rows.values()), 1)))
        right = live.select("vec_id", "cell", "codes").join(sizes, "cell").select("vec_id", "cell", "codes", part.alias("part"), each("blocks").alias("block"))
        sent = self.spark.sparkContext.broadcast(model)

        def meet(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(rows):
                return pd.DataFrame({"query_id": [], "vec_id": [], "cell": [], "about": []})
            cell, q = int(rows["cell"].iloc[0]), np.stack(asked["q"])
            rows = rows.sort_values("vec_id", kind="stable")
            codes, ids, most = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1), rows["vec_id"].to_numpy(), min(rescore, len(rows))
            out = []
            for a in range(0, len(q), 64):  # 64 x most_rows scores at once
                score = sent.value.scores(q[a : a + 64], cell, codes)
                best = np.argsort(-score, axis=1, kind="stable")[:, :most]
                about, own = np.take_along_axis(score, best, 1), asked["query_id"].to_numpy()[a : a + 64]
                keep = about >= asked["least"].to_numpy()[a : a + 64, None]
                out.append(pd.DataFrame({"query_id": np.repeat(own, keep.sum(axis=1)), "vec_id": ids[best][keep], "cell": cell, "about": about[keep]}))
            return pd.concat(out)

        keys = ["cell", "part", "block"]

        def found(some: DataFrame) -> DataFrame:
            left = some.join(sizes, "cell").select("query_id", "q", "cell", "least", block.alias("block"), each("parts").alias("part"))
            return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, cell int, about double")

        best = lambda rows: top(rows, rescore, "about", tie="vec_id", rank="place")
        near = saved(best(found(asked.filter(F.col("near") < begun).withColumn("least", F.lit(-2.0)))))
        last = near.filter(F.col("place") == rescore).select("query_id", F.col("about").alias("least"))
        far = found(asked.filter(F.col("near") >= begun).join(last, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0))))
        few = best(near.drop("place").unionByName(far)).select("query_id", "vec_id", "cell")
        vectors = asked.groupBy("query_id").agg(F.first("q").alias("q"))
        met = live.select("vec_id", "cell", "embedding").join(few.join(vectors, "query_id"), ["cell", "vec_id"])

        def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    score = np.einsum("ij,ij->i", unit(batch["q"]), unit(batch["embedding"]))
                    yield pd.DataFrame({"query_id": batch["query_id"], "vec_id": batch["vec_id"], "score": np.round(score, 6)})

        scored = met.select("query_id", "vec_id", "q", "embedding").mapInPandas(exact, "query_id long, vec_id long, score double")
        return top(scored.filter(F.col("score") >= least), k, tie="vec_id")
