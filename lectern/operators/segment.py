"""Sequence operators on ordered paragraphs and events: chunks, islands, resets, as-of.

Order is always explicit columns; every window is partitioned by the document
or user, so no operator gathers the whole input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines_of(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, pos, line): the lines of each text in order."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def _before(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_id(rows: DataFrame, keys: list[str], order: list, starts: Column, name: str) -> DataFrame:
    """How many starts there were up to each row; 0 before the first."""
    return rows.withColumn(name, F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(_before(keys, order)))


def chunk_split(lines: DataFrame, start: str, key: str = "doc_id") -> DataFrame:
    """(key, chunk, first_pos, n, body): lines from one start to the next; what stands before the first start goes."""
    numbered = running_id(lines, [key], ["pos"], F.col("line").rlike(start), "chunk").where("chunk > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "|")
    return numbered.groupBy(key, "chunk").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"), body.alias("body"))


def islands(rows: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Rows with ``island``: runs of equal neighbours share one number."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    return rows.withColumn("_new", changed).transform(lambda r: running_id(r, keys, order, F.col("_new"), "island")).drop("_new")


def asof_start(rows: DataFrame, keys: list[str], order: list, starts: Column, value: str, name: str = "start") -> DataFrame:
    """The value at the nearest start at or before each row, null before the first."""
    return rows.withColumn(name, F.last(F.when(starts, F.col(value)), ignorenulls=True).over(_before(keys, order)))


def number_sets(rows: DataFrame, keys: list[str], order: list, size: int = 20, first: int = 1) -> DataFrame:
    """Global, set and local numbers of ordered rows, all from 1 (sets from ``first``)."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumns({"global_no": (i + 1).cast("long"), "set_no": (F.lit(first) + F.floor(i / size)).cast("long"), "local_no": (i % size + 1).cast("long")})


def reset_sections(rows: DataFrame, keys: list[str], order: list, number: str) -> DataFrame:
    """A new section begins wherever the number does not rise."""
    before = F.lag(number).over(Window.partitionBy(*keys).orderBy(*order))
    flagged = rows.withColumn("_reset", F.col(number) <= before)
    return running_id(flagged, keys, order, F.col("_reset"), "section").drop("_reset")


def sections_between(lines: DataFrame, start: str, stop: str, key: str = "doc_id") -> DataFrame:
    """Lines from a start up to the next stop (not included): the nearest of both before a line decides."""
    is_start, is_stop = F.col("line").rlike(start), F.col("line").rlike(stop)
    last = F.last(F.when(is_stop, F.lit(False)).when(is_start, F.lit(True)), ignorenulls=True).over(_before([key], ["pos"]))
    return lines.withColumn("_in", last).where("_in").drop("_in")


def within(rows: DataFrame, spans: DataFrame, key: str | list[str], low: str, high: str, width: int, pos: str = "pos") -> DataFrame:
    """Rows joined with the spans of their key that hold their position: low <= pos <= high.

    Positions fall into bins of ``width``, spans are repeated for each bin they touch, and both meet on key and bin: with
    spans about as long as a bin a row meets only spans near it, and a long document's bins lie in many tasks. Neither side is broadcast: spans repeated for their bins
    and lines unfolded from a small file are far larger than the planner takes them for.
    """
    touched = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    bins = spans.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(touched))
    placed = rows.withColumn("_bin", F.floor(F.col(pos) / width))
    return placed.join(bins.hint("merge"), [*([key] if isinstance(key, str) else key), "_bin"]).where(F.col(pos).between(F.col(low), F.col(high))).drop("_bin")


# --- scans over documents larger than a task: blocks of positions are scanned by themselves, and what a block needs from
# those before it (a count, the last anchor) comes from one row a block

BLOCK = 1 << 20


def _carried(rows: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (with ``_block``) joined with their block's row; null keys are keys too."""
    named = blocks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), "_before")
    alike = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        alike = alike & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, alike).drop("_b", *[f"_k{i}" for i in range(len(keys))])


def _blocked(rows: DataFrame, pos: str, size: int) -> DataFrame:
    return rows.withColumn("_block", F.call_function("div", F.col(pos), F.lit(size)))


def long_running_id(rows: DataFrame, keys: list[str], starts: Column, name: str, pos: str = "pos", size: int = BLOCK) -> DataFrame:
    """As ``running_id`` in the order of ``pos``, for documents of any length: a task sorts ``size`` positions of one document."""
    blocked = _blocked(rows.withColumn("_start", F.coalesce(starts, F.lit(False)).cast("long")), pos, size)
    totals = blocked.groupBy(*keys, "_block").agg(F.sum("_start").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    local = blocked.withColumn(name, F.sum("_start").over(_before([*keys, "_block"], [pos])))
    out = _carried(local, totals.withColumn("_before", F.coalesce(before, F.lit(0))), keys)
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_start", "_block", "_before")


def long_asof_start(rows: DataFrame, keys: list[str], starts: Column, value: str, name: str = "start", pos: str = "pos", size: int = BLOCK) -> DataFrame:
    """As ``asof_start`` in the order of ``pos``, for documents of any length."""
    anchored = _blocked(rows.withColumn("_anchor", F.when(starts, F.col(value))), pos, size)
    last = anchored.groupBy(*keys, "_block").agg(F.max_by("_anchor", F.when(F.col("_anchor").isNotNull(), F.col(pos))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    local = anchored.withColumn("_own", F.last("_anchor", ignorenulls=True).over(_before([*keys, "_block"], [pos])))
    out = _carried(local, last.withColumn("_before", before), keys)
    return out.withColumn(name, F.coalesce("_own", "_before")).drop("_anchor", "_own", "_block", "_before")


def long_sections_between(lines: DataFrame, start: str, stop: str, keys: list[str], size: int = BLOCK) -> DataFrame:
    """As ``sections_between`` for documents of any length."""
    is_stop = F.col("line").rlike(stop)
    marked = lines.withColumn("_open", F.when(is_stop, F.lit(False)).when(F.col("line").rlike(start), F.lit(True)))
    return long_asof_start(marked, keys, F.col("_open").isNotNull(), "_open", "_in", size=size).where("_in").drop("_in", "_open")
