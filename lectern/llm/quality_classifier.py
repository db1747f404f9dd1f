"""Quality by regularised quadratic discriminant analysis.

Every whole text becomes a short vector of transformed statistics (rates of
symbols, capitals, punctuation, repeated words and lines, lengths of words and
lines). Each class is a normal distribution over these vectors: its covariance
is shrunk towards that of both classes together and towards a multiple of the
identity, and factored once (Cholesky). A score compares the two log densities:
Mahalanobis distances by triangular solves, log determinants, class shares.

Texts are read once: statistics of all documents are written to the shared
folder, and fitting and scoring work on those. Class moments are sums over all
labelled rows that are not held out (crc32(doc_id as text) mod 3 = 1), added up
by Spark; the driver holds one mean and one matrix a class.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import SPACE, settle, text_of

SYMBOLS, PIPES, MARKS, CLAUSES = b"#*$%&<>", b"|", b".?", b",;:"
BRACKETS = b"@/\\=_{}[]()^~+`"
DIGITS, CAPITALS, SPACES = b"0123456789", bytes(range(65, 91)), SPACE.encode()
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STATISTICS = ("symbols", "pipes", "capitals", "shouts", "digits", "marks", "clauses", "brackets", "repeated words", "repeated triples", "commonest word", "repeated lines", "ended lines", "word length", "line length", "short words", "long words")
#: Shrinkage towards the pooled covariance and towards the identity; standardised statistics end at BOUND.
POOLED, RIDGE, BOUND = 0.4, 0.1, 4.0
PIECE = 1 << 22


def held_out(doc_id: Column) -> Column:
    """Whether a row's label must not be learned from; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that end at white space, so that a long one's words are never all in memory."""
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] not in SPACES:
            end += 1
        yield data[at:end]
        at = end


def statistics_of(text: str) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS.

    A rate is the square root of count / (size + a constant): roots even out
    the spread of counts, and the constant keeps short texts from extremes.
    """
    data = text.encode("utf-8", "surrogatepass")
    of = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, int)
    n = len(data)
    count = lambda chars: int(of[list(chars)].sum())
    rate = lambda part, whole, least=20.0: (max(part, 0) / (whole + least)) ** 0.5
    words: Counter = Counter()
    numbers: dict[bytes, int] = {}
    parts = []
    for piece in _pieces(data):
        found = piece.split()
        words.update(found)
        for word in words.keys() - numbers.keys():
            numbers[word] = len(numbers)
        parts.append(np.fromiter(map(numbers.__getitem__, found), np.uint64, len(found)))
    w = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    triples = np.sort((w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:]) if len(w) > 2 else w[:0]
    same = triples[1:] == triples[:-1]
    repeated = int((np.append(same, False) | np.append(False, same)).sum()) if len(triples) else 0
    lines, unlike, ended = 0, set(), 0
    for line in data.split(b"\n"):
        if line := line.strip():
            lines += 1
            unlike.add(hash(line))
            ended += line[-1] in b".!?"
    n_words, letters = len(w), n - count(SPACES) - count(DIGITS) - count(PUNCTUATION)
    sizes = [(len(word), times) for word, times in words.items()]
    return [
        rate(count(SYMBOLS), n), rate(count(PIPES), n), rate(count(CAPITALS), letters), rate(count(b"!"), n), rate(count(DIGITS), n), rate(count(MARKS), n), rate(count(CLAUSES), n), rate(count(BRACKETS), n),
        rate(n_words - len(words), n_words), rate(repeated, n_words - 2 if n_words > 2 else 0), rate(max(words.values(), default=0), n_words),
        rate(lines - len(unlike), lines, 3.0), rate(ended, lines, 3.0), float(np.log((n + 40) / (n_words + 8))), float(np.log((n_words + 10) / (lines + 1))),
        rate(sum(t for size, t in sizes if size <= 3), n_words), rate(sum(t for size, t in sizes if size >= 15), n_words),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but text, with ``stats``, an array of the statistics of the whole text (null: empty)."""
    names = [c for c in docs.columns if c not in ("text", "stats")]
    rows = docs.select(*names, text_of("text").alias("text"))
    schema = rows.select(*names).schema.add("stats", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics_of(x.as_py()) for x in batch["text"]]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(found, pa.list_(pa.float64()))], names=[*names, "stats"])

    return rows.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, len(STATISTICS))


def _moments(rows: DataFrame, label: str, centre: np.ndarray, scale: np.ndarray) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """By class: rows, sums and sums of products of the standardised statistics, added up over all rows."""
    width = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            z = _standard(_matrix(batch["stats"]), centre, scale)
            kinds = np.asarray(batch[label])
            for kind in np.unique(kinds):
                x = np.concatenate([np.ones((int((kinds == kind).sum()), 1)), z[kinds == kind]], axis=1)
                total[int(kind)] = total.get(int(kind), 0) + x.T @ x
        for kind, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([kind] * m.size, pa.int32()), pa.array(range(m.size), pa.int32()), pa.array(m.ravel())], names=["kind", "at", "value"])

    sums = rows.select("stats", F.col(label).cast("int").alias(label)).mapInArrow(run, "kind int, at int, value double").groupBy("kind", "at").agg(F.sum("value").alias("value"))
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():  # two classes' matrices
        out.setdefault(r["kind"], np.zeros((width + 1) ** 2))[r["at"]] = r["value"]
    return {k: (m[0], m[1 : width + 1], m.reshape(width + 1, width + 1)[1:, 1:]) for k, m in out.items()}


def _standard(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - centre) / scale, -BOUND, BOUND)


@dataclass
class Discriminant:
    """Two shrunk normal distributions; ``factors`` are their Cholesky factors. Without both classes it knows nothing."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, class shares included."""
        if not self.factors:
            return np.zeros(len(x))
        z = _standard(x, self.centre, self.scale)
        dense = [c - 0.5 * (np.linalg.solve(factor, (z - mean).T) ** 2).sum(axis=0) for mean, factor, c in zip(self.means, self.factors, self.constants)]
        return dense[1] - dense[0]


def discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], centre: np.ndarray, scale: np.ndarray, pooled: float = POOLED, ridge: float = RIDGE) -> Discriminant:
    """Shrunk covariances from class moments: (1 - pooled) of the class's own and pooled of both classes' together, then
    (1 - ridge) of that and ridge of its mean variance on the diagonal. A class of one row has the common one alone."""
    if set(moments) != {0, 1}:
        return Discriminant(centre, scale, [], [], [])
    rows = sum(m[0] for m in moments.values())
    means = [moments[k][1] / moments[k][0] for k in (0, 1)]
    scatter = [moments[k][2] - moments[k][0] * np.outer(means[k], means[k]) for k in (0, 1)]
    both, factors, constants = sum(scatter) / max(rows - 2, 1), [], []
    for k in (0, 1):
        n = moments[k][0]
        cov = both if n < 2 else (1 - pooled) * scatter[k] / (n - 1) + pooled * both
        cov = (1 - ridge) * cov + (ridge * np.trace(cov) / len(cov) + 1e-6) * np.eye(len(cov))
        factors.append(np.linalg.cholesky(cov))
        constants.append(float(np.log(n / rows) - np.log(np.diag(factors[-1])).sum()))
    return Discriminant(centre, scale, means, factors, constants)


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fits on all rows of ``stats`` (doc_id, stats) with a label in ``labels`` (doc_id, quality) that are not held out.

    Null labels and ids count for nothing; labels that repeat a doc_id say 1 if all of them do; documents that share an
    id share its label. Where only one class is labelled, or none, the model scores everything 0.5.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    rows = settle(stats.where(~held_out(F.col("doc_id"))).select("doc_id", "stats").join(known, "doc_id").select("stats", "quality"))
    width = len(STATISTICS)
    means = [F.avg(F.get("stats", F.lit(i))).alias(f"m{i}") for i in range(width)]
    spreads = [F.stddev_pop(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(width)]
    of = rows.agg(*means, *spreads).first()
    if of["m0"] is None:
        return Discriminant(np.zeros(width), np.ones(width), [], [], [])
    centre, scale = np.array([of[f"m{i}"] for i in range(width)]), np.array([of[f"s{i}"] for i in range(width)]) + 1e-6
    return discriminant(_moments(rows, "quality", centre, scale), centre, scale)


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """All columns of ``stats`` but the statistics, with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    The score is the logistic of the log odds, tempered by the number of statistics: normal densities of many dependent
    statistics are too sure of themselves, and untempered scores would all end as 0 or 1. The order and the side of 0.5
    are those of the log odds.
    """
    names = [c for c in stats.columns if c not in ("stats", "score", "predicted")]
    schema = stats.select(*names).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = model.log_odds(_matrix(batch["stats"])) / len(STATISTICS)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))], names=[*names, "score"])

    return stats.select(*names, "stats").mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op13_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts have statistics too (of nothing); repeated rows score alike, each on its own row; an empty table
    gives an empty one; columns beside doc_id and text are not read. Whole texts count, very long ones piece by piece.
    """
    stats = settle(statistics(docs.select("doc_id", "text")))
    scored = score(stats, fit(stats, labels.select("doc_id", "quality")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
