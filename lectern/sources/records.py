"""JSON banks and exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.bank import numbered

#: A question of a bank file; missing fields are null.
QUESTION = """struct<id:bigint,categoryId:bigint,type:string,stem:string,options:array<struct<label:string,content:string>>,
answer:string,explanation:string,source:string,difficulty:string,status:string,imageKey:string>"""


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """Questions of JSON files that hold ``{"questions": [...]}`` or a bare list; a broken file holds none."""
    text = spark.read.option("wholetext", "true").text(path)
    wrapped = F.from_json("value", f"struct<questions:array<{QUESTION}>>")["questions"]
    bare = F.from_json("value", f"array<{QUESTION}>")
    return text.select(F.explode(F.coalesce(wrapped, bare)).alias("q")).where("q.id is not null").select("q.*")


def write_bank(bank: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are left out."""
    bank.write.mode("overwrite").json(path)


def json_list(text: Column, kind: str) -> Column:
    """A JSON list; a broken text or null is an empty one."""
    return F.coalesce(F.from_json(text, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def as_json_list(bank: DataFrame, by: str, key: str) -> DataFrame:
    """(by, json): each group of a bank as one JSON list in the order of ``key``; meant for groups that fit in a file."""
    return bank.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(key, *[c for c in bank.columns if c not in (by, key)])))).alias("json"))


def first_existing(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of several Parquet tables that is there."""
    for path in paths[:-1]:
        try:
            return spark.read.parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.read.parquet(paths[-1])


def overlay(base: DataFrame, patch: DataFrame | None, key: str) -> DataFrame:
    """The base with its rows replaced by those of a patch, if there is one."""
    return base if patch is None else base.join(patch, key, "left_anti").unionByName(patch.select(base.columns))


def volume_order(name: Column) -> Column:
    """First volumes before second ones before all others, then by name."""
    return F.concat(F.when(F.contains(name, F.lit("上")), "0-").when(F.contains(name, F.lit("下")), "1-").otherwise("2-"), name)


def pair_volumes(books: DataFrame, analyses: DataFrame, name: str = "name") -> DataFrame:
    """(nth, book, analysis): files of both sides in the order of their volumes; their numbers must agree."""
    n, m = books.count(), analyses.count()
    if n != m:
        raise ValueError(f"{n} books but {m} analyses")
    side = lambda rows, as_: numbered(rows.select(F.col(name).alias(as_), volume_order(F.col(name)).alias("_order")), "_order", "nth").drop("_order")
    return side(books, "book").join(side(analyses, "analysis"), "nth").select("nth", "book", "analysis")
