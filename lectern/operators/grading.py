"""Learning records: grading, totals, wrong books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import outcome, round_half_up


def grade(answers: DataFrame, attempt: str = "attempt") -> DataFrame:
    """Per attempt: n, correct, unanswered, wrong and score (percent, halves up). One partial aggregate, one shuffle."""
    kind = outcome(F.col("selected"), F.col("answer"))
    out = answers.groupBy(attempt).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(kind == "correct").alias("correct"), F.count_if(kind == "unanswered").alias("unanswered")
    )
    return out.withColumns({"wrong": F.col("n") - F.col("correct") - F.col("unanswered"), "score": round_half_up(F.lit(100.0) * F.col("correct") / F.col("n"))})


def wrong_answers(answers: DataFrame) -> DataFrame:
    """Answers that were given and are not right."""
    return answers.where(F.col("selected").isNotNull() & (F.col("selected") != "") & (F.col("selected") != F.col("answer")))


def wrong_book(answers: DataFrame, question: str = "question", at: str = "at") -> DataFrame:
    """Per question: how often wrong, when last, and the (largest) choice made then."""
    return wrong_answers(answers).groupBy(question).agg(F.count(F.lit(1)).alias("times"), F.max(F.struct(at, "selected")).alias("last")).select(question, "times", F.col(f"last.{at}").alias("last_at"), F.col("last.selected").alias("last_selected"))


def latest_per_user(attempts: DataFrame, user: str, k: int, *order) -> DataFrame:
    return attempts.withColumn("rank", F.row_number().over(Window.partitionBy(user).orderBy(*order))).where(F.col("rank") <= k)
