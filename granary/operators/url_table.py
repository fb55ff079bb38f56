"""A stored chunk table in buckets by URL: a replace rewrites the buckets of its URLs only, aside, and one commit swaps them in.

The newest version says for each bucket which write holds its rows. A replace reads the touched buckets, drops the rows of the
coming URLs, and writes these buckets anew under its own name; until its commit (see ``sources.store``) readers see the old ones, so a killed
write leaves the table as it was. Take enough buckets that the URLs of a usual batch touch few of them.

Rows without a URL lie in the bucket of the empty one and are never replaced. Columns that old or new rows lack are null in them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.sources.store import Versions


class UrlTable:
    """The table in a folder. The first batch names the columns; ``buckets`` must stay the same."""

    def __init__(self, spark: SparkSession, root: str, url: str = "source_url", buckets: int = 256):
        self.spark, self.url, self.buckets = spark, url, buckets
        self.versions = Versions(spark, root)
        self.folder = self.versions.folder

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(F.coalesce(F.col(self.url).cast("string"), F.lit(""))), F.lit(self.buckets)).cast("int")

    def read(self, facts: dict, only: list[int] | None = None) -> DataFrame:
        """The rows of all or some buckets: their folders alone are read."""
        schema = StructType.fromJson(facts["schema"])
        paths = [self.folder.at("data", f"write={w}", f"bucket={b}") for b, w in facts["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        _, facts = self.versions.current()
        return self.read(facts)

    def replace(self, new: DataFrame) -> int:
        """Puts ``new`` in place of all rows of its URLs; the number of buckets written."""
        return self.change(new.select(self.url), new)

    def delete(self, urls: DataFrame) -> int:
        return self.change(urls.select(self.url), None)

    def change(self, urls: DataFrame, new: DataFrame | None) -> int:
        seen, facts = self.versions.current()
        if not facts and new is None:
            return 0
        touched = sorted(r[0] for r in urls.select(self.bucket()).distinct().collect())  # at most ``buckets``
        if not touched:
            return 0
        named = urls.filter(F.coalesce(F.col(self.url), F.lit("")) != "").distinct()
        rows = self.read(facts, touched).join(named, self.url, "left_anti") if facts else None
        rows = new if rows is None else rows if new is None else rows.unionByName(new, allowMissingColumns=True)
        rows = rows.select(self.url, *[c for c in rows.columns if c != self.url]) if not facts else rows
        write = uuid.uuid4().hex
        rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(self.folder.at("data", f"write={write}"))
        there = {int(x.removeprefix("bucket=")) for x in self.folder.names("data", f"write={write}") if x.startswith("bucket=")}  # a bucket may be empty now
        held = {b: w for b, w in facts.get("buckets", {}).items() if int(b) not in touched} | {str(b): write for b in touched if b in there}
        self.versions.commit(seen, {"schema": rows.schema.jsonValue(), "buckets": held})
        return len(touched)

    def vacuum(self) -> int:
        """Deletes bucket folders that the newest version does not count; run it when no reader holds an older one."""
        _, facts = self.versions.current()
        held = {(w, int(b)) for b, w in facts.get("buckets", {}).items()}
        old = [(w, x) for w in self.folder.names("data") for x in self.folder.names("data", w) if x.startswith("bucket=") and (w.removeprefix("write="), int(x.removeprefix("bucket="))) not in held]
        for w, x in old:
            self.folder.delete("data", w, x)
        return len(old)
