"""Validation and audit: noise, contamination, rules as rows, id sets, SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_noise(line: Column, headings: list[str]) -> Column:
    """Blank lines, page numbers of up to three digits, and lines that begin with a heading."""
    return (F.trim(line) == "") | line.rlike("\\A[0-9]{1,3}\\z") | line.rlike("\\A(" + "|".join(headings) + ")")


def is_clean(text: Column, tokens: str) -> Column:
    """Not blank, and none of the tokens inside."""
    return ~text.rlike(tokens) & (F.trim(text) != "")


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule): one row for each rule that a row breaks, in one pass."""
    found = F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    return rows.select(key, F.explode(F.array_compact(found)).alias("rule"))


def id_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, side): expected ids that are missing, and extra ones."""
    missing = expected.join(actual, key, "left_anti").select(key, F.lit("missing").alias("side"))
    return missing.unionByName(actual.distinct().join(expected, key, "left_anti").select(key, F.lit("extra").alias("side")))


def sql_literal(col: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(col, F.lit("'"), F.lit("''")), F.lit("'"))


def insert_statement(table: str, values: list[Column]) -> Column:
    return F.concat(F.lit(f"INSERT INTO {table} VALUES ("), F.concat_ws(", ", *values), F.lit(");"))


def delete_statement(table: str, condition: Column) -> Column:
    return F.concat(F.lit(f"DELETE FROM {table} WHERE "), condition, F.lit(";"))


def upsert_statement(table: str, columns: list[str], values: list[Column], key: str) -> Column:
    """An INSERT that updates the other columns where the key is there."""
    kept = ", ".join(f"{c} = excluded.{c}" for c in columns if c != key)
    return F.concat(F.lit(f"INSERT INTO {table} ({', '.join(columns)}) VALUES ("), F.concat_ws(", ", *values), F.lit(f") ON CONFLICT({key}) DO UPDATE SET {kept};"))


def question_rules(labels: Column, contents: Column) -> dict[str, Column]:
    """Rules that an imported question must not break, by name; columns as in ``lectern.plans.audits``."""
    length = lambda c, low, high: ~F.coalesce(F.length(F.trim(c)).between(low, high), F.lit(False))
    return {
        "key": ~F.coalesce(F.col("import_key").rlike("\\A[a-f0-9]{64}\\z"), F.lit(False)),
        "type": length("type", 1, 50),
        "stem": length("stem", 1, 15_000),
        "explanation": F.length("explanation") > 50_000,
        "options": ~F.size(labels).between(2, 8),
        "content": F.exists(contents, lambda x: length(x, 1, 2000)),
        "answer": ~F.array_contains(labels, F.col("answer")),
    }


def release_rules(labels: Column, contents: Column, dirty: str) -> dict[str, Column]:
    """Rules of a release: four labels at least and none twice, texts that are there and clean, images where options are graphical."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return {
        "labels": (F.size(labels) < 4) | (F.size(F.array_distinct(labels)) < F.size(labels)),
        "answer": ~F.array_contains(labels, F.col("answer")),
        "stem": blank(F.col("stem")),
        "explanation": blank(F.col("explanation")),
        "stem dirty": F.col("stem").rlike(dirty),
        "option dirty": F.exists(contents, lambda x: x.rlike(dirty)),
        "image": (F.size("missing") > 0) & blank(F.col("image")),
    }
