"""Changing tables as functions from tables to tables: upserts, replacement, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.bank import first_wins


def last_write(staged: DataFrame, key: list[str], *newest_first: Column) -> DataFrame:
    """One row per key: the newest."""
    return first_wins(staged, key, *newest_first)


def merge(target: DataFrame, source: DataFrame, key: list[str], update: list[str]) -> DataFrame:
    """Rows of both; where keys meet, columns in ``update`` come from the source, the others stay.

    Presence is flagged, so a null of the source overwrites too.
    """
    s = source.select(*key, *[F.col(c).alias(f"_s_{c}") for c in target.columns if c not in key], F.lit(True).alias("_in_s"))
    t = target.withColumn("_in_t", F.lit(True))
    joined = t.join(s, key, "full_outer")

    def pick(c: str) -> Column:
        if c in key:
            return F.col(c)
        from_source = F.col("_in_s").isNotNull() & (F.lit(c in update) | F.col("_in_t").isNull())
        return F.when(from_source, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*[pick(c) for c in target.columns])


def insert_ignore(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """The target and those source rows whose key it lacks."""
    return target.unionByName(source.join(target.select(*key), key, "left_anti").select(*target.columns))


def replace_partition(target: DataFrame, source: DataFrame, part: str, values: list) -> DataFrame:
    """The target with the rows of some partitions replaced by the source."""
    return target.where(~F.coalesce(F.col(part).isin(values), F.lit(False))).unionByName(source)


def delete_children(child: DataFrame, parent_gone: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The children whose parent is not among the deleted."""
    return child.join(parent_gone.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def adopt_keys(target: DataFrame, staged: DataFrame, twin: list[str], key: str, row_id: str, scope: list[str] | None = None) -> DataFrame:
    """Unkeyed target rows take the key of a staged row that agrees in ``twin``; of equal twins the lowest id does.

    Only keys that the target lacks are adopted, each by one row; with ``scope`` (a category, say) twins and keys count
    within it. Of several staged twins the least key that is free counts.
    """
    within = [*(scope or []), *twin]
    taken = target.where(F.col(key).isNotNull()).select(*(scope or []), key).distinct()
    keys = staged.where(F.col(key).isNotNull()).join(taken, [*(scope or []), key], "left_anti").groupBy(*within).agg(F.min(key).alias("_new"))
    lowest = target.where(F.col(key).isNull()).groupBy(*within).agg(F.min(row_id).alias("_low"))
    joined = target.join(keys, within, "left").join(lowest, within, "left")
    # a key that is staged for several twins goes to the one with the lowest id
    fits = F.col(key).isNull() & (F.col(row_id) == F.col("_low")) & F.col("_new").isNotNull()
    first = joined.where(fits).groupBy(*(scope or []), "_new").agg(F.min(row_id).alias("_first"))
    placed = joined.join(first, [*(scope or []), "_new"], "left")
    return placed.withColumn(key, F.when(fits & (F.col(row_id) == F.col("_first")), F.col("_new")).otherwise(F.col(key))).select(*target.columns)


def import_error(status: Column, received: Column, total: Column) -> Column:
    """Why an import can't be finalized: ``ended``, ``incomplete``, or null if it can."""
    return F.when(status != "uploading", "ended").when(~received.eqNullSafe(total), "incomplete")


def finalize_append(target: DataFrame, staged: DataFrame, key: str, twin: list[str], row_id: str, update: list[str], scope: list[str] | None = None) -> DataFrame:
    """Appends an import: unkeyed rows that a staged row equals in ``twin`` adopt its key, then rows are upserted on the key.

    Rows that were there keep ``row_id`` and all columns but ``update``; new rows have no ``row_id`` yet. Target rows
    without a key and without a twin stay. Staged keys are unique; staged rows without one are ignored. With ``scope``,
    twins, taken keys and the upsert count within these columns.
    """
    adopted = adopt_keys(target, staged, twin, key, row_id, scope)
    source = staged.where(F.col(key).isNotNull()).withColumn(row_id, F.lit(None).cast(dict(target.dtypes)[row_id]))
    return merge(adopted, source, [*(scope or []), key], update)
