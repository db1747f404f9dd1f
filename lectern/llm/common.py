"""What the operators share: white space, words, digests and the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, read from the session.

    Where ``spark.checkpoint.dir`` is unset a temporary folder takes its place in
    local mode (tests); on a cluster that is an error, as no other machine would see it.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        set_before = sc._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            where = set_before.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            where = tempfile.mkdtemp(prefix="lectern-shared-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files and checkpoints that nothing refers to any more: it learns of them when
    the driver collects its garbage, which in a job of many small steps may come late."""
    spark.sparkContext._jvm.System.gc()


def text_of(col: Column | str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def split_words(text: Column) -> Column:
    """Runs without ASCII white space, unchanged, in order."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def sha256_text(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)
