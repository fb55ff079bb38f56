"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` where the session names it; otherwise, on one
    machine alone (tests), a folder in the warehouse.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Cuts lineage with an eager checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def deleted(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables in the shared folder, to cut lineage; all of them go at the end of the ``with`` block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.made = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *why) -> None:
        deleted(self.spark, self.root)

    def table(self, df: DataFrame) -> DataFrame:
        folder = f"{self.root}/{self.made}"
        self.made += 1
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)


#: A key with a MOST_HOT-th of all rows or more is hot, so there are at most MOST_HOT of them.
SALTS, MOST_HOT = 32, 10_000


def dealt(many: DataFrame, few: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """Joins the ``total`` rows of ``many`` to the keys of ``few`` (each once), hot keys in ``SALTS`` parts.

    ``few`` has a column k, at least the number of rows of ``many`` with that key. The hot
    ones are broadcast to be marked in ``many``, if that has no column k itself.
    """
    bound = max(total / MOST_HOT, 4 * SALTS)
    if total < bound:
        return many.drop("k").join(few.drop("k"), on, how)
    part = F.pmod(F.xxhash64(*[c for c in many.columns if c not in (*on, "k")]), F.lit(SALTS)).cast("int")
    if "k" not in many.columns:
        many = many.join(F.broadcast(few.filter(F.col("k") >= bound).select(*on, "k")), on, "left")
    left = many.withColumn("salt", F.when(F.col("k") >= bound, part).otherwise(F.lit(0))).drop("k")
    copies = F.when(F.col("k") >= bound, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(few.withColumn("salt", F.explode(copies)).drop("k"), [*on, "salt"], how).drop("salt")


def share(spark: SparkSession, model: object) -> Broadcast[bytes]:
    """Broadcasts a fitted model with the code of its class."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def opened(model: Broadcast[bytes]):
    return cloudpickle.loads(model.value)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids go to fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n, F.lit(0))


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``most`` bytes of text (one row at least)."""
    array = batch.column(column)
    if array.null_count == len(array):
        yield batch
        return
    offsets = string_offsets(array)
    start = 0
    for i in range(1, len(offsets)):
        if offsets[i] - offsets[start] >= most:
            yield batch.slice(start, i - start)
            start = i
    if start < len(offsets) - 1:
        yield batch.slice(start)


def string_offsets(array: pa.Array):
    """The byte offsets of a string array's values (len + 1 of them)."""
    import numpy as np

    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def string_bytes(array: pa.Array):
    """(bytes, bounds): the values of a string array end to end, a null as no bytes."""
    import numpy as np

    if array.null_count:
        array = array.fill_null("")
    offsets = string_offsets(array)
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def emit(batches: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for columns in batches:
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
