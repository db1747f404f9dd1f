"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

The state is a small log-structured store: each batch of documents adds one run
of ``(h1, h2, n, keeper)`` rows, a table bucketed and sorted by the hashes; once
a level holds ``fanout`` runs they are merged into one run of the next level. A
new batch is merge-anti-joined with each run, bucket by bucket: keys that a run
has settled (found in ``min_docs`` documents) never enter another run. Batches
come by falling ``doc_id``, hence the keeper of a settled key, its largest
``doc_id``, is already known.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import SPACE, settle, sha256_text, text_of, tidy

#: Documents of a batch, and the least and largest number of batches.
BATCH_DOCS, LEAST_BATCHES, MOST_BATCHES = 60_000, 5, 64
FANOUT = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashes(line: Column) -> Column:
    """128 bits of the key, as two hashes with unlike seeds; null for short keys."""
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(20011), key).alias("h2"))


def _long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, th, pos, h) of each line whose key has at least ``min_chars`` code points."""
    text = text_of("text")
    lines = docs.select("doc_id", F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    long_enough = lines.where(F.length("line") >= min_chars).where(F.length(F.btrim("line", F.lit(SPACE))) >= min_chars)
    return long_enough.select("doc_id", "th", "pos", _hashes(F.col("line")).alias("h")).select("doc_id", "th", "pos", "h.h1", "h.h2")


@contextlib.contextmanager
def _dealt_anew(spark: SparkSession) -> Iterator[None]:
    """Spark 4.1 takes a union of bucketed tables as dealt by their buckets and then sums up too little; not in here."""
    name = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class LineRuns:
    """Levelled sorted runs of line hashes: managed tables, bucketed by the hashes, in the warehouse."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.made = 0
        self.compactions = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        """``rows`` are dealt to the buckets already."""
        name = f"{self.name}_{self.made}"
        self.made += 1
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """The runs' keys, each once; to be run under ``_dealt_anew``."""
        whole = runs[0]
        for more in runs[1:]:
            whole = whole.unionByName(more)
        return whole.repartition(self.buckets, "h1", "h2").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))

    def settled(self) -> DataFrame:
        """Keys found in ``min_docs`` documents or more, with their keeper."""
        return self.merged(self.runs()).where(F.col("n") >= self.min_docs).select("h1", "h2", "keeper")

    def add(self, batch: DataFrame) -> None:
        """Anti-join the batch's keys with the settled ones of each run and add the rest as a run."""
        batch = batch.repartition(self.buckets, "h1", "h2")
        for run in self.runs():
            batch = batch.join(run.where(F.col("n") >= self.min_docs).select("h1", "h2"), ["h1", "h2"], "left_anti")
        self._write(batch, 0)
        self.compact()

    def compact(self) -> None:
        """Merge each level that holds ``fanout`` runs into one run of the next level."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                names, self.levels[level] = self.levels[level], []
                with _dealt_anew(self.spark):
                    self._write(self.merged([self.spark.table(name) for name in names]), level + 1)
                self.compactions += 1
                self._drop(names)
            level += 1

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Drop all runs."""
        for level in self.levels:
            self._drop(level)
        self.levels = []


def batches_for(docs: DataFrame) -> int:
    """Batches of about ``BATCH_DOCS`` documents; at least so many that levels fill, at most ``MOST_BATCHES``."""
    return max(LEAST_BATCHES, min(MOST_BATCHES, -(-docs.count() // BATCH_DOCS)))


def _staged(docs: DataFrame, min_chars: int, count: int, name: str) -> int:
    """Writes (doc_id, h1, h2, batch) of all long lines as a table, so that the texts are read once for all batches, and
    gives the number of batches; batch 0 has the largest ids, the last one the null ids too."""
    cuts = docs.select(F.percentile_approx("doc_id", [i / count for i in range(1, count)], 10_000).alias("c")).first()["c"] if count > 1 else []
    cuts = sorted(set(cuts or []))
    place = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda c: c >= F.col("doc_id"))) if cuts else F.lit(0)
    text = text_of("text")
    long_lines = F.filter(F.split(text, "\n"), lambda x: (F.length(x) >= min_chars) & (F.length(F.btrim(x, F.lit(SPACE))) >= min_chars))
    lines = docs.select("doc_id", F.coalesce(place, F.lit(len(cuts))).alias("batch"), F.explode(F.array_distinct(F.transform(long_lines, _hashes))).alias("h"))
    spread = F.pmod(F.xxhash64("h"), F.lit(64))  # a batch goes to several tasks
    dealt = lines.select("doc_id", "h.h1", "h.h2", "batch", spread.alias("spread")).repartition("batch", "spread").drop("spread")
    dealt.write.partitionBy("batch").format("parquet").saveAsTable(name)
    return len(cuts) + 1


def repeated_keys(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """Keys (h1, h2) of long lines found in at least ``min_docs`` documents, with ``keeper``, the largest doc_id."""
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs, fanout)
    lines = f"{runs.name}_lines"
    count = _staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_chars, batches or batches_for(docs), lines)
    for batch in range(count):
        runs.add(_per_key(spark.table(lines).where(F.col("batch") == batch)))
    with _dealt_anew(spark):
        keys = settle(runs.settled())
    runs.close()
    spark.sql(f"DROP TABLE IF EXISTS {lines}")
    tidy(spark)
    return keys


def _per_key(lines: DataFrame) -> DataFrame:
    """(h1, h2, n, keeper): documents (distinct ids) that hold a key, and the largest of them."""
    # by document first: rows that repeat an id count once
    once = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    return once.groupBy("h1", "h2").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("keeper"))


RESULTS = ("kept_text", "n_lines", "n_dropped")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """Documents with their kept text: all columns of ``docs`` plus ``kept_text``, ``n_lines``, ``n_dropped``.

    A text is split at ``\\n``; keys of at least ``min_chars`` code points found
    in at least ``min_docs`` documents lose all their lines except in the
    largest ``doc_id`` holding it, which keeps each of its own.

    Nulls and empty texts have one empty line, which stays. Documents are
    distinct ``doc_id``s: rows that repeat one count once, and all rows of the
    largest keep the line. A null ``doc_id`` does not count, and never keeps a
    line that others lose. Empty tables give empty results. Columns beside
    ``doc_id`` and ``text`` pass through untouched, but those of the three new
    names are replaced; names that begin with ``_ld_`` are reserved.
    """
    keys = repeated_keys(docs.select("doc_id", "text"), min_chars, min_docs, batches, fanout)
    lines = _long_lines(docs, min_chars)
    drops = (
        lines.join(keys, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "th")
        .agg(F.collect_set("pos").alias("_ld_pos"))
        .select(F.col("doc_id").alias("_ld_id"), F.col("th").alias("_ld_th"), "_ld_pos")
    )
    text = text_of("text")
    th = F.xxhash64(text)
    names = [c for c in docs.columns if c not in RESULTS]
    joined = docs.select(names).join(drops.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_ld_id")) & (th == F.col("_ld_th")), "left")
    split = joined.withColumn("_ld_lines", F.split(text, "\n"))
    gone = F.coalesce(F.col("_ld_pos"), F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_ld_lines") - 1), gone)
    kept = F.when(F.size(gone) == 0, text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("_ld_lines"), i)), "\n"))
    return split.select(
        *names,
        kept.alias("kept_text"),
        F.size("_ld_lines").cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
    )


def op2_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = drop_repeated_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256_text(F.col("kept_text")).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), bad AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.doc_id, pos, line, (bad.k IS NOT NULL AND keyed.doc_id IS DISTINCT FROM bad.keeper) AS gone
  FROM keyed LEFT JOIN bad ON keyed.k = bad.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
