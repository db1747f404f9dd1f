"""Reading the bank: lookups, samples, rollups and merged banks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def filter_in(bank: DataFrame, column: str, values: list, empty_means_all: bool = False) -> DataFrame:
    """Rows whose column is in the list; an empty list keeps nothing, or everything if so asked."""
    if not values:
        return bank if empty_means_all else bank.where(F.lit(False))
    return bank.where(F.col(column).isin(values))


def lookup_ordered(bank: DataFrame, key: str, ids: list, most: int = 100) -> DataFrame:
    """Rows of the ids, in the order asked (``pos``); repeats and missing ids go; at most ``most`` ids."""
    asked = list(dict.fromkeys(ids))[:most]
    wanted = bank.sparkSession.createDataFrame(list(enumerate(asked)), f"pos int, {key} long")
    return bank.join(F.broadcast(wanted), key).orderBy("pos")  # ``most`` rows


def seeded_order(seed: str, key: Column | str) -> Column:
    """A repeatable random order."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(seed + ":"), key.cast("string")))


def lookup_one(bank: DataFrame, key: str, value) -> DataFrame:
    """The row of a unique key, or none."""
    return bank.where(F.col(key) == F.lit(value)).limit(1)


def sample(bank: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """At most ``n`` rows in seeded random order."""
    return bank.orderBy(seeded_order(seed, key), key).limit(n)


def sample_groups(bank: DataFrame, key: str, number: str, n: int, seed: str, size: int = 5, whole: bool = False) -> DataFrame:
    """Rows of ceil(n / size) random material groups, ordered by group and number.

    A group is ``size`` neighbouring numbers, counted from 1. Whole groups are
    returned if so asked, else at most ``n`` rows.
    """
    grouped = bank.withColumn("grp", F.expr(f"({number} - 1) div {size}"))
    chosen = grouped.select("grp").distinct().orderBy(seeded_order(seed, "grp"), "grp").limit(-(-n // size))
    rows = grouped.join(chosen, "grp", "left_semi").orderBy("grp", number, key)
    return rows if whole else rows.limit(n)


def first_wins(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def refresh_snapshots(items: DataFrame, old: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Each item's current value, else its old one; items with neither go."""
    joined = items.join(current.select(key, F.col(value).alias("_cur")), key, "left").join(old.select(key, F.col(value).alias("_old")), key, "left")
    return joined.withColumn(value, F.coalesce("_cur", "_old")).where(F.col(value).isNotNull()).drop("_cur", "_old")


def keep_latest(rows: DataFrame, owner: str, key: str, k: int, *order: Column) -> DataFrame:
    """The ``k`` first rows of each owner, one per key."""
    return first_wins(rows, [owner, key], *order).withColumn("rank", F.row_number().over(Window.partitionBy(owner).orderBy(*order))).where(F.col("rank") <= k)


def numbered(rows: DataFrame, by: str, name: str, size: int = 100_000) -> DataFrame:
    """Rows numbered from 1 in the order of ``by``: by ranges of about ``size`` rows, offset by the counts of those before."""
    parts = -(-rows.count() // size)
    rank_of = by if dict(rows.dtypes)[by] != "string" else F.conv(F.rpad(F.hex(F.substring(F.encode(by, "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    rows = rows if isinstance(rank_of, str) else rows.withColumn("_by", rank_of)
    at = by if isinstance(rank_of, str) else "_by"
    cuts = rows.select(F.percentile_approx(at, [i / parts for i in range(1, parts)], 10_000).alias("c")).first()["c"] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(at))) if cuts else F.lit(0)
    ranged = rows.withColumn("_range", place)
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}  # one row a range
    offsets = [sum(n for r, n in counts.items() if r < i) for i in range(len(cuts) + 1)]
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(by))
    return ranged.withColumn(name, rank + F.get(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("_range"))).drop("_range", "_by")
