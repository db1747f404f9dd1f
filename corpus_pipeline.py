"""The corpus pipeline: five stages from raw documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import jaccard_join, line_dedup, packing, substring_dedup, toxicity
from lectern.llm.common import scratch
from lectern.session import load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _shaped(rows: DataFrame, text: str = "text") -> DataFrame:
    """The columns of documents, with ``text`` as the text and its length."""
    new = F.coalesce(F.col(text), F.lit(""))
    return rows.select("doc_id", new.alias("text"), "lang", "source", F.length(new).cast("long").alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of the folder, doesn't call toxic.

    Null texts are scored as empty ones; repeated rows go or stay alike; ties at 0.5 go. Here and in the other
    stages null texts come out empty, an empty table stays empty, and columns beside those of documents go.
    """
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return _shaped(toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents share; all documents stay, repeated rows too. Null ids keep no such line."""
    return _shaped(line_dedup.drop_repeated_lines(docs.select(*COLUMNS)), "kept_text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near duplicates; documents without a word all stay.

    Of rows repeated as a whole one stays; null ids come after all others, ties go to the least text hash.
    """
    return _shaped(jaccard_join.one_of_each(docs.select(*COLUMNS)))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start earlier in the corpus; all documents stay.

    Words end up one space apart. Rows repeated as a whole are one document; a null doc_id is the smallest.
    """
    return _shaped(substring_dedup.drop_repeats(docs, carry=["doc_id", "lang", "source"]), "kept_text")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048 tokens; null and empty texts are one token, repeated rows are packed each."""
    return packing.op3_packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_passages),
    ("packing", pack_sequences),
]

#: Toxicity and packing are beyond SQL; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written and read again before the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
