"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


class Tables:
    """Tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load(self._spark, self._dir, name)


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """The rows dealt over the tasks by their key, where they cost far more than their bytes: few tasks read a small file."""
    return rows.repartition(*by)


def answers(lineitem: DataFrame) -> DataFrame:
    """Line items as answers: attempt, question, selected, answer, at."""
    return lineitem.select(
        F.col("l_orderkey").alias("attempt"),
        F.col("l_partkey").alias("question"),
        F.nullif("l_returnflag", F.lit("N")).alias("selected"),
        F.when(F.col("l_linestatus") == "F", "A").otherwise("R").alias("answer"),
        F.col("l_shipdate").alias("at"),
        "l_suppkey", "l_quantity", "l_extendedprice", "l_linenumber",
    )


#: The same in SQL.
ANSWERS = """(SELECT l_orderkey AS attempt, l_partkey AS question, nullif(l_returnflag, 'N') AS selected,
  CASE l_linestatus WHEN 'F' THEN 'A' ELSE 'R' END AS answer, l_shipdate AS at_, l_suppkey, l_quantity, l_extendedprice, l_linenumber FROM lineitem)"""


def tally(condition: Column) -> Column:
    return F.count_if(condition)
