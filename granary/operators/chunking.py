"""Chunks of sections: steps, paragraphs, packing, overlap, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.rules import STEP_START
from granary.functions.text import content_hash, estimate_tokens, normalize_text, split_paragraphs, split_sentences, stripped, truncate_to_tokens
from granary.session import Chunking


def with_steps(rows: DataFrame, text: str, column: str) -> DataFrame:
    """Rows with ``column``: the lines from one step mark to the next, joined, if over 30 characters.

    The lines are a column of their own, so each step is one slice of them and nothing is shuffled.
    Explode the result by ``posexplode_outer`` and drop null places after it: an inner generator makes Spark infer a filter
    on the array's size and push it below these columns, where the lines are made again for each step.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != "")
    rows = rows.withColumn("__lines", lines)
    begins = F.transform("__lines", lambda x, i: F.when((i == 0) | x.rlike(STEP_START), i + 1))
    rows = rows.withColumn("__starts", F.filter(begins, lambda i: i.isNotNull()))
    end = lambda j: F.coalesce(F.get("__starts", j + 1), F.size("__lines") + 1)
    found = F.transform("__starts", lambda i, j: F.array_join(F.slice("__lines", i, end(j) - i), "\n"))
    return rows.withColumn(column, F.filter(found, lambda s: F.length(s) > 30)).drop("__lines", "__starts")


def steps(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, step (from 1), content of every step."""
    found = with_steps(rows, text, "__steps").select(key, F.posexplode_outer("__steps").alias("pos", "content"))
    return found.filter("pos is not null").select(key, (F.col("pos") + 1).alias("step"), "content")


def packed(paragraphs: Column, most_tokens: int = 800) -> Column:
    """Paragraphs put together greedily up to so many tokens; a longer one stands alone."""
    tokens = estimate_tokens

    def put(acc: Column, p: Column) -> Column:
        t, last = tokens(p), F.element_at(acc, -1)
        alone = F.concat(acc, F.array(F.struct(p.alias("text"), t.alias("tokens"))))
        joined = F.struct(F.concat(last["text"], F.lit("\n\n"), p).alias("text"), (last["tokens"] + t).alias("tokens"))
        return F.when((F.size(acc) == 0) | (last["tokens"] + t > most_tokens), alone).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined)))

    empty = F.expr("cast(array() as array<struct<text:string,tokens:int>>)")
    return F.transform(F.aggregate(paragraphs, empty, put), lambda x: x["text"])


def tail_within(text: Column, budget: int) -> Column:
    """The last sentences of a text that fit into so many tokens together."""
    back = F.reverse(split_sentences(text))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def put(acc: Column, s: Column) -> Column:
        over = acc["full"] | (acc["used"] + estimate_tokens(s) > budget)
        return F.struct(F.when(over, acc["kept"]).otherwise(F.concat(F.array(s), acc["kept"])).alias("kept"), F.when(over, acc["used"]).otherwise(acc["used"] + estimate_tokens(s)).alias("used"), over.alias("full"))

    return F.array_join(F.aggregate(back, start, put, lambda acc: acc["kept"]), " ")


def overlapped(chunks: Column, budget: int = 100) -> Column:
    """Each chunk after the end of the one before it, as extended already."""

    def put(acc: Column, c: Column) -> Column:
        tail = tail_within(F.element_at(acc, -1), budget)
        return F.concat(acc, F.array(F.when(tail != "", F.concat(F.lit("[...continua] "), tail, F.lit("\n\n"), c)).otherwise(c)))

    first = F.slice(chunks, 1, 1)
    return F.when(F.size(chunks) > 1, F.aggregate(F.slice(chunks, F.lit(2), F.size(chunks)), first, put)).otherwise(chunks)


def summary(text: Column) -> Column:
    """The first three sentences and, of more than five, the last one if it is long enough and refers nowhere else."""
    found = split_sentences(text)
    last = F.filter(F.slice(found, -1, 1), lambda s: (F.length(s) > 20) & ~F.contains(F.lower(s), F.lit("vedi")))
    chosen = F.when(F.size(found) > 5, F.concat(F.slice(found, 1, 3), last)).otherwise(F.slice(found, 1, 3))
    return truncate_to_tokens(F.array_join(chosen, " "), 400)


def table_chunks(rows: DataFrame, key: str, text: str, most_rows: int = 25, keep_all: bool = True) -> DataFrame:
    """key, chunk, content: a Markdown table cut into groups of rows, each under its header.

    With ``keep_all`` false, a table without a rule line gives no chunk.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: stripped(x) != "")
    rule = F.array_position(F.transform(lines, lambda x: x.startswith("---") | x.rlike(r"^\|?\s*---")), F.lit(True))
    parts = rows.select(key, lines.alias("lines"), rule.cast("int").alias("rule"))
    parts = parts if keep_all else parts.filter("rule > 0")
    head, body = F.slice("lines", F.lit(1), F.col("rule")), F.slice("lines", F.col("rule") + 1, F.greatest(F.size("lines") - F.col("rule"), F.lit(0)))
    cut = parts.select(key, head.alias("head"), F.posexplode(body).alias("pos", "line")).withColumn("chunk", F.floor(F.col("pos") / most_rows).cast("int"))
    return cut.groupBy(key, "chunk", "head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body")).select(key, "chunk", F.concat_ws("\n", F.array_join("head", "\n"), "body").alias("content"))


def table_parts(text: Column, most_rows: int) -> Column:
    """A Markdown table whole, or in groups of so many rows under what stands before its rule line."""
    lines = F.split(text, "\n")
    is_rule = lambda x: F.contains(x, F.lit("---"))
    rows = F.filter(lines, lambda x: F.contains(x, F.lit("|")) & ~is_rule(x))
    rule = F.array_position(F.transform(lines, is_rule), F.lit(True)).cast("int")
    head = F.slice(lines, F.lit(1), F.when(rule > 0, rule - 1).otherwise(F.size(lines)))
    body = F.slice(rows, F.size(head) + 1, F.greatest(F.size(rows) - F.size(head), F.lit(0)))
    starts = F.when(F.size(body) > 0, F.sequence(F.lit(1), F.size(body), F.lit(most_rows))).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(rows) <= most_rows, F.array(text)).otherwise(F.transform(starts, lambda i: F.array_join(F.concat(head, F.slice(body, i, F.lit(most_rows))), "\n")))


def typed_chunks(sections: DataFrame, c: Chunking = Chunking()) -> DataFrame:
    """Chunks of sections (section_id, content_type, content), by the type of each, with all other columns.

    Adds chunk_id, parent_chunk_id, chunk_type, content (normalised, after the end of the chunk before
    it, but for parameters) and hash. A long procedure is its summary and a child for each step, a long
    parameter its paragraphs, a long table groups of rows, an error one chunk, and other long
    sections paragraphs put together.
    """
    kind, text = F.col("content_type"), F.col("content")
    tokens, paragraphs = estimate_tokens(text), split_paragraphs(text)
    long = tokens > c.parent_tokens
    piece = lambda name, child=False: lambda x: F.struct(F.lit(name).alias("chunk_type"), x.alias("text"), F.lit(child).alias("child"))
    made = lambda name, texts: F.transform(texts, piece(name))
    procedure = F.when(long, F.concat(made("parent", F.array(summary(text))), F.transform("__steps", piece("step", True)))).otherwise(made("parent", F.array(text)))
    parameter = made("parameter", F.when(tokens <= c.parameter_tokens, F.array(text)).otherwise(paragraphs))
    pieces = (
        F.when(kind == "procedure", procedure)
        .when(kind == "parameter", parameter)
        .when(kind == "table", made("table", table_parts(text, c.table_rows)))
        .when(kind == "error", made("error", F.array(text)))
        .otherwise(made("concept", F.when(long, packed(paragraphs, c.parent_tokens)).otherwise(F.array(text))))
    )
    rows = with_steps(sections.filter(text.isNotNull()), "content", "__steps").withColumn("__pieces", pieces).drop("__steps")
    rows = rows.withColumn("__texts", F.transform("__pieces", lambda x: normalize_text(x["text"])))
    joined = F.when(kind == "parameter", F.col("__texts")).when(kind == "procedure", overlapped(F.col("__texts"), c.procedure_overlap)).otherwise(overlapped(F.col("__texts"), c.overlap_tokens))
    rows = rows.withColumn("__final", joined).select("*", F.posexplode_outer("__pieces").alias("__pos", "__piece")).filter("__pos is not null")
    parent = F.concat("section_id", F.lit("_chunk_000"))
    child = F.col("__piece.child")
    return rows.withColumns({
        "chunk_id": F.when(child, F.format_string("%s_child_%03d", parent, F.col("__pos") - 1)).otherwise(F.format_string("%s_chunk_%03d", "section_id", "__pos")),
        "parent_chunk_id": F.when(child, parent),
        "chunk_type": F.col("__piece.chunk_type"),
        "content": F.get("__final", F.col("__pos")),
        "hash": content_hash(F.col("__piece.text")),
    }).drop("__pieces", "__texts", "__final", "__pos", "__piece")


def token_prefix(rows: DataFrame, budget: int, order: str = "rank", group: str = "query_id", most: int = 6) -> DataFrame:
    """The first rows of each group whose tokens together fit (the first that does not ends the list)."""
    running = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.filter(F.col(order) <= most).withColumn("used", F.sum(F.floor(F.length("content") / 4)).over(running)).filter(F.col("used") <= budget)
