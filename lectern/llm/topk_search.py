"""Exact top-k search by inner product: norm-sorted blocks, rotated partial sums, residual bounds.

Candidates are cut into bands of falling norm and the bands into blocks of
bounded size. Bands are searched in rounds, longest first; the k-th best score of
each query so far is its floor, carried from round to round. A query is sent to
a band only while its own norm times the band's largest reaches its floor; those
that are sent travel in blocks, and a block of queries with a block of candidates
is one unit of work. There, vectors are rotated to the principal axes of all rows, so
that a few leading coordinates hold most of a product; Cauchy-Schwarz on the rest
bounds it. Candidates whose bound is below the floor are pruned; survivors are
scored exactly in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import settle

CANDIDATE_BLOCK, QUERY_BLOCK, MAX_BANDS = 4096, 512, 64
#: Bands searched by the end of each round; the last round takes the rest.
ROUNDS = (1, 4, 16)
EXACT, LARGEST = 2.0**53, 2**63 - 1


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, x (array of floor(scale * component), whole doubles), norm.

    Rows whose vector is null, empty, or holds a null or non-finite component
    take no part, nor do those with a component beyond doubles once scaled.
    """
    scaled = F.transform("embedding", lambda v: F.lit(scale) * v.cast("double"))
    finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = rows.where(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size("embedding") > 0) & F.col("vec_id").isNotNull())
    x = F.transform(scaled, lambda v: F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v))  # beyond 2**53 doubles are whole
    return good.select("vec_id", x.alias("x")).withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v * v)))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list array as a matrix; shorter vectors end in zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out, ends = np.zeros((len(sizes), dim)), np.cumsum(sizes)
    for i, (n, end) in enumerate(zip(sizes, ends)):
        out[i, :n] = flat[end - n : end]
    return out


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all rows, largest first, from one pass of dim x dim partial sums."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch["x"], dim)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["i", "v"])

    cells = vectors.select("x").mapInArrow(gram, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    whole = np.zeros(dim * dim)
    for r in cells:  # dim * dim rows
        whole[r["i"]] = r["v"]
    return np.linalg.eigh(whole.reshape(dim, dim))[1][:, ::-1]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        level = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= level)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; such as don't fit into 64 bits are held at the limit."""
    if np.linalg.norm(q) * np.linalg.norm(c, axis=1).max(initial=0.0) < EXACT:
        return (c @ q).astype(np.int64)
    own = [int(x) for x in q]
    return np.array([max(-LARGEST, min(LARGEST, sum(int(x) * y for x, y in zip(row, own)))) for row in c], np.int64)


def block_top_k(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, axes: np.ndarray, floor: np.ndarray, k: int, head: int = 16, step: int = 512) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query its best k (ids, scores) among ``c``, save such as score below ``floor``."""
    by_norm = np.argsort(-np.linalg.norm(c, axis=1), kind="stable")
    c_ids, c = c_ids[by_norm], c[by_norm]
    qr, cr = q @ axes, c @ axes
    q_rest, c_rest = (np.linalg.norm(m[:, head:], axis=1) for m in (qr, cr))
    q_norm, c_norm = (np.linalg.norm(m, axis=1) for m in (q, c))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q_ids]
    floor = floor.copy()
    for at in range(0, len(c), step):
        part = slice(at, at + step)
        slack = 1e-6 * (1 + q_norm * c_norm[at])  # for rounding of the rotation
        open_q = np.flatnonzero(~(q_norm * c_norm[at] + slack < floor))
        if not len(open_q):
            break  # norms fall: no later candidate can reach any query
        bound = qr[open_q, :head] @ cr[part, :head].T + np.outer(q_rest[open_q], c_rest[part])
        alive = ~(bound + slack[open_q, None] < floor[open_q, None])  # what has no bound stays
        exact = None
        if alive.mean() > 0.05 and q_norm.max() * c_norm[at] < EXACT:
            exact = q[open_q] @ c[part].T  # whole numbers below 2**53: exact
        for row, i in enumerate(open_q):
            cols = np.flatnonzero(alive[row])
            if not len(cols):
                continue
            scores = exact[row, cols].astype(np.int64) if exact is not None else _products(q[i], c[at + cols])
            ids = c_ids[at + cols]
            use = ids != q_ids[i]
            ids, scores = np.concatenate([found[i][0], ids[use]]), np.concatenate([found[i][1], scores[use]])
            top = _best(ids, scores, k)
            found[i] = (ids[top], scores[top])
            if len(top) == k:
                floor[i] = max(floor[i], scores[top[-1]])
    return found


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of ``vectors`` for each of ``queries``, all if fewer.

    Both come from ``integer_vectors``. A query is never its own candidate
    (same vec_id); rows that repeat a vec_id are candidates each, while a
    repeated query id is answered once. Ties go to the smaller vec_id. Shorter
    vectors count as ending in zeros. Scores are exact; beyond 64 bits they are
    held at the limit. Nothing is returned where there is no other row.
    """
    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score long"
    stats = vectors.agg(F.max(F.size("x")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    asked = queries.dropDuplicates(["vec_id"])
    n_q = asked.count() if stats["n"] else 0
    if not n_q:
        return spark.createDataFrame([], schema)
    dim, n = stats["dim"], stats["n"]
    axes = principal_axes(vectors, dim)

    bands = min(MAX_BANDS, -(-n // CANDIDATE_BLOCK))
    cuts = vectors.agg(F.percentile_approx("norm", [i / bands for i in range(1, bands)] or [0.5], 10000).alias("c")).first()["c"]
    cuts = sorted(set(cuts), reverse=True) if bands > 1 else []
    band = F.lit(0)
    for cut in cuts:  # band 0 has the longest vectors
        band = band + (F.col("norm") <= cut).cast("int")
    banded = vectors.withColumn("band", band)
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm")).orderBy("band").collect()  # MAX_BANDS rows at most
    share = {r["band"]: -(-r["n"] // CANDIDATE_BLOCK) for r in sizes}
    lookup = lambda table, of: F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), of)
    block = F.pmod(F.xxhash64("vec_id", "x"), lookup(share, F.col("band"))).cast("int")
    candidates = banded.withColumn("cb", block).groupBy("band", "cb").agg(F.collect_list(F.struct("vec_id", "x")).alias("c"))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(-(-n_q // QUERY_BLOCK))))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found, order = None, [r["band"] for r in sizes]
    for low, high in zip((0, *ROUNDS), (*ROUNDS, len(order))):
        if not order[low:high]:
            continue
        floors = spark.createDataFrame([], "query_id long, floor long") if found is None else found.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("held")).where(F.col("held") >= k).select("query_id", "floor")
        more = _round(asked, floors, candidates.where(F.col("band").isin(order[low:high])), {r["band"]: r["norm"] for r in sizes[low:high]}, share, axes, dim, k)
        both = more if found is None else found.select("query_id", "vec_id", "score").unionByName(more)
        found = settle(both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    return found


def units_of(asked: DataFrame, floors: DataFrame, norms: dict[int, float], share: dict[int, int]) -> DataFrame:
    """(band, cb, q): blocks of the queries that a band can still serve, once for each of the band's blocks."""
    known = asked.join(floors, asked["vec_id"] == floors["query_id"], "left")
    reach = F.array(*[F.when(F.col("floor").isNull() | ~(F.col("norm") * norm * (1 + 1e-9) + 1e-6 < F.col("floor")), F.lit(b)) for b, norm in norms.items()])
    sent = known.select("vec_id", "x", "qb", "floor", F.explode(F.filter(reach, lambda b: b.isNotNull())).alias("band"))
    blocks = sent.groupBy("qb", "band").agg(F.collect_list(F.struct("vec_id", "x", "floor")).alias("q"))
    counts = F.element_at(F.create_map(*[F.lit(x) for b in norms for x in (b, share[b])]), F.col("band"))
    return blocks.select("band", "q", F.explode(F.sequence(F.lit(0), (counts - 1).cast("int"))).alias("cb"))


def _round(asked: DataFrame, floors: DataFrame, candidates: DataFrame, norms: dict[int, float], share: dict[int, int], axes: np.ndarray, dim: int, k: int) -> DataFrame:
    """Results (query_id, vec_id, score) of a few bands."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, c in zip(batch["q"], batch["c"]):
                q_ids, c_ids = (x.values.field(0).to_numpy(zero_copy_only=False) for x in (q, c))
                qm, cm = (_matrix(x.values.field(1), dim) for x in (q, c))
                floor = q.values.field(2).to_numpy(zero_copy_only=False).astype(np.float64)  # nan without a floor
                got = block_top_k(q_ids, qm, c_ids, cm, axes, np.where(np.isnan(floor), -np.inf, floor), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q_ids, [len(i) for i, _ in got])), pa.array(np.concatenate([i for i, _ in got])), pa.array(np.concatenate([s for _, s in got]))],
                    names=["query_id", "vec_id", "score"],
                )

    return units_of(asked, floors, norms, share).join(candidates, ["band", "cb"]).select("q", "c").mapInArrow(search, "query_id long, vec_id long, score long")


def op8_topk_search(embeddings: DataFrame) -> DataFrame:
    """The 5 best of all rows for each row whose vec_id is divisible by 50."""
    vectors = settle(integer_vectors(embeddings.select("vec_id", "embedding")))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
