"""Statistics of use, evaluation and content."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distribution(rows: DataFrame, column: str, default: str = "general") -> DataFrame:
    """value, n and whole per cent (half up) of each value, a null as the default."""
    n = rows.groupBy(F.coalesce(F.col(column), F.lit(default)).alias("value")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.floor(100 * F.col("n") / F.sum("n").over(Window.partitionBy()) + 0.5).cast("int"))


def average_confidence(rows: DataFrame, column: str = "confidence") -> DataFrame:
    return rows.agg(F.coalesce(F.avg(F.coalesce(F.col(column), F.lit(0.0))), F.lit(0.0)).alias("avg_confidence"))


def evaluation(rows: DataFrame) -> DataFrame:
    """accuracy, mean confidence and coverage of (expected, predicted, confidence, n_sources)."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return rows.agg(F.count("*").alias("n"), F.coalesce(share(F.col("expected") == F.col("predicted")), F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"), F.coalesce(share(F.col("n_sources") > 0), F.lit(0.0)).alias("coverage"))


def diagnosis(rows: DataFrame, url: str, content: str, score: str) -> DataFrame:
    """Figures and mean score of each URL, with what is wrong with it."""
    out = rows.groupBy(url).agg(F.sum(F.regexp_count(content, F.lit(r"\[Figura:"))).alias("n_figures"), F.avg(score).alias("mean_score"), F.count("*").alias("n_chunks"))
    return out.withColumn("diagnosis", F.when(F.col("n_figures") > 50, "figures").when(F.col("mean_score") < 0.6, "score").otherwise("ok"))


def keyword_context(rows: DataFrame, key: str, text: str, word: str, around: int = 50) -> DataFrame:
    """How often a word stands in each text, and the characters around its first place."""
    low, at = F.lower(text), F.instr(F.lower(text), word.lower())
    n = ((F.length(low) - F.length(F.replace(low, F.lit(word.lower())))) / len(word)).cast("long")
    snippet = F.substring(F.col(text), F.greatest(at - around, F.lit(1)), F.lit(2 * around + len(word)))
    return rows.select(key, n.alias("n"), F.when(at > 0, snippet).alias("snippet")).filter("n > 0")


def table_stats(rows: DataFrame, vector: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), F.max(F.size(vector)).alias("vector_size"))


def sliding_counts(events: DataFrame, group: str, ts: str, seconds: int, most: int) -> DataFrame:
    """For each event, how many of its group stand in the last seconds, and whether that is within the limit."""
    frame = Window.partitionBy(group).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(frame)).withColumn("within", F.col("in_window") <= most)


def last_before(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """As-of join: each left row with the right side's value at its time or the last one before it.

    Both sides go through one window by key, so nothing is joined row by row.
    """
    cols = [c for c in left.columns]
    both = left.withColumns({"__v": F.lit(None).cast(right.schema[value].dataType), "__side": F.lit(1)}).unionByName(right.select(key, ts, F.col(value).alias("__v"), F.lit(0).alias("__side")), allowMissingColumns=True)
    frame = Window.partitionBy(key).orderBy(ts, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("last_value", F.last("__v", ignorenulls=True).over(frame)).filter("__side = 1").select(*cols, "last_value")


def type_counts(rows: DataFrame, column: str = "content_type") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def result_rows(results: DataFrame, widest: int = 50) -> DataFrame:
    """Results as they are listed: score, shortened title, module, type and URL."""
    title = F.when(F.length("title") > widest, F.concat(F.left("title", F.lit(widest)), F.lit("..."))).otherwise(F.col("title"))
    return results.select("query_id", "rank", F.round("score", 3).alias("score"), title.alias("title"), "module", "content_type", F.col("source_url").alias("url"))


def admitted(calls: DataFrame, key: str, ts: str, limit: int, seconds: float, tie: str) -> DataFrame:
    """``calls`` with start: when each call may begin, so that a key begins at most ``limit`` in any ``seconds``, in order of arrival.

    A call begins when it comes, but not before the one ahead of it, nor sooner than ``seconds`` after the one ``limit`` places ahead of it
    began. So a start depends on earlier starts, which no window frame holds: the sorted rows of a key stream through
    one task that remembers its last ``limit`` starts. Null keys are a key; rows without a time come last and start never (null).
    """
    micros = int(seconds * 1_000_000)
    columns = [c for c in calls.columns if c != "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = (None,), deque(maxlen=limit)
        for batch in batches:
            starts = []
            for k, t in zip(batch.column("__key").to_pylist(), batch.column("__at").to_pylist(), strict=True):
                if (k,) != now:
                    now, last = (k,), deque(maxlen=limit)
                if t is not None:
                    t = max([t, *([last[-1]] if last else []), *([last[0] + micros] if len(last) == limit else [])])
                    last.append(t)
                starts.append(t)
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(starts, pa.int64())], names=[*columns, "start"])

    rows = calls.select(*columns, F.col(key).alias("__key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("__at"))
    rows = rows.repartition("__key").sortWithinPartitions(F.col("__key"), F.asc_nulls_last("__at"), F.col(tie))
    kinds = ", ".join(f"`{c}` {dict(calls.dtypes)[c]}" for c in columns)
    return rows.mapInArrow(run, f"{kinds}, start long").withColumn("start", F.timestamp_micros("start"))
