"""Text similarity on character bigrams, within blocks or of a stated query set and all texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.functions.text import match_key
from lectern.operators.grams import blocks_of

WINDOW = 800
#: How far below the best a partner still is alike.
NEAR = 0.08
LEFT_BLOCK, RIGHT_BLOCK = 256, 512
#: Characters of a pack of left keys, and of right keys; the latter are also taken apart at once.
LEFT_CHARS, CHARS = LEFT_BLOCK * WINDOW, 1 << 20
#: Places of a matrix of right keys and bigrams; and what a rounded score may differ by.
PLACES, SLACK = 1 << 21, 1e-6


def key_of(text: Column, window: int | None = WINDOW) -> Column:
    """The first ``window`` characters of the match key, or all."""
    return match_key(text) if window is None else F.substring(match_key(text), 1, window)


def grams(key: Column, size: int = 2) -> Column:
    """All windows of ``size`` characters, in order, in one pass over the text."""
    chars = F.split(F.coalesce(key, F.lit("")), "")
    out = chars
    for i in range(1, size):
        out = F.zip_with(out, F.slice(chars, i + 1, 1 << 30), lambda x, y: F.concat(x, y))
    return F.filter(out, lambda g: g.isNotNull())


def _packed(rows: DataFrame, row_id: str, size: int, chars: int) -> DataFrame:
    """(ids, keys, block): up to ``size`` rows or ``chars`` characters of a task and a block laid into one, without a
    shuffle; a longer key is a row of its own, empty keys go.

    They go here, as Spark would move a filter, with the making of keys, to before the rows are dealt over the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_block: dict = {}
            for i, (block, n) in enumerate(zip(batch["block"].to_pylist(), pc.utf8_length(batch["key"]).to_pylist())):
                if n:
                    by_block.setdefault(block, []).append((i, n))
            for block, at in by_block.items():
                for places in _within(at, size, chars):
                    part = batch.take(pa.array(places))
                    ids, keys = (pa.array([part[c].to_pylist()], pa.list_(part[c].type)) for c in (row_id, "key"))
                    yield pa.RecordBatch.from_arrays([ids, keys, pa.array([block], pa.string())], names=["ids", "keys", "block"])

    return rows.mapInArrow(run, T.StructType([T.StructField("ids", T.ArrayType(rows.schema[row_id].dataType)), T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("block", T.StringType())]))


def _within(sized: list[tuple[int, int]], size: int, chars: int) -> Iterator[list[int]]:
    """The places of (place, length), in order, up to ``size`` of them or ``chars`` characters at a time."""
    places, total = [], 0
    for place, n in sized:
        if places and (len(places) == size or total + n > chars):
            yield places
            places, total = [], 0
        places.append(place)
        total += n
    if places:
        yield places


def _pieces(keys: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(row of each piece, pieces): the keys, up to CHARS characters at a time.

    A longer key comes in pieces that share a character, so that no bigram is lost or met twice.
    """
    cut = [(row, key[at : at + CHARS]) for row, key in enumerate(keys) for at in range(0, max(1, len(key) - 1), CHARS - 1)]
    for places in _within([(i, len(piece)) for i, (_, piece) in enumerate(cut)], len(cut), CHARS):
        yield np.array([cut[i][0] for i in places]), [cut[i][1] for i in places]


def _bigrams(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bigram as a number) of every place of the keys; a key of one character is its own bigram."""
    sizes = np.array([len(k) for k in keys], np.int64)
    chars = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(keys)), sizes)
    code = (chars << 22) + np.append(chars[1:] + 1, 0)
    last = np.cumsum(sizes)[sizes > 0] - 1
    code[last] = chars[last] << 22
    kept = np.ones(len(row), bool)
    kept[last] = sizes[row[last]] == 1
    return row[kept], code[kept]


class Pack:
    """Left keys as a matrix: a bigram's n-th copy is a column of its own, so the shared count is a product."""

    def __init__(self, keys: list[str]):
        self.known = reduce(np.union1d, (np.unique(_bigrams(pieces)[1]) for _, pieces in _pieces(keys)))
        counts = self._counts(keys)
        most = counts.max(axis=0)
        self.gram = np.repeat(np.arange(len(most)), most)
        self.copy = np.arange(len(self.gram)) - np.repeat(np.cumsum(most) - most, most)
        self.ones = np.ascontiguousarray((counts[:, self.gram] > self.copy).T, np.float32)
        self.lengths = np.array([len(k) for k in keys])
        self.tops = np.zeros((0, len(keys)))

    def _counts(self, keys: list[str]) -> np.ndarray:
        counts = np.zeros(len(keys) * len(self.known), np.int64)
        for rows, pieces in _pieces(keys):
            row, code = _bigrams(pieces)
            at = np.minimum(np.searchsorted(self.known, code), len(self.known) - 1)
            met = self.known[at] == code
            counts += np.bincount(rows[row[met]] * len(self.known) + at[met], minlength=len(counts))
        return counts.reshape(len(keys), -1)

    def scores(self, keys: list[str], best: int = 0, near: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(right place, left place, score) of all pairs that share a bigram, a bounded number of right keys at a time.

        With ``best``, only pairs no more than ``near`` below the ``best``-th score that the left key has met so far.
        """
        step = max(1, PLACES // len(self.gram))
        for low in range(0, len(keys), step):
            part = keys[low : low + step]
            shared = (self._counts(part)[:, self.gram] > self.copy).astype(np.float32) @ self.ones
            score = np.minimum(1.0, 2.0 * shared.astype(float) / np.maximum(1, self.lengths[None, :] + np.array([len(k) for k in part])[:, None] - 2))
            kept = shared > 0
            if best:
                self.tops = np.concatenate([self.tops, score])
                if len(self.tops) > best:
                    self.tops = np.partition(self.tops, len(self.tops) - best, axis=0)[-best:]
                if len(self.tops) == best:
                    # what is rounded later on may still meet
                    kept &= score >= self.tops.min(axis=0) - near - SLACK
            j, i = np.nonzero(kept)
            yield j + low, i, score[j, i]


def _score_packs(batches: Iterator[pa.RecordBatch], names: list[str], best: int, near: float) -> Iterator[pa.RecordBatch]:
    known, packs = None, {}
    for batch in batches:
        for r in range(batch.num_rows):
            left = batch["left_ids"][r].as_py(), batch["left_keys"][r].as_py()
            if left != known:
                # of packs that come again only the scores are kept
                if known is not None:
                    packs[tuple(known[0]), hash(tuple(known[1]))] = pack.tops
                known, pack = left, Pack(left[1])
                pack.tops = packs.get((tuple(left[0]), hash(tuple(left[1]))), pack.tops)
            for j, i, score in pack.scores(batch["right_keys"][r].as_py(), best, near):
                yield pa.RecordBatch.from_arrays([batch["left_ids"][r].values.take(pa.array(i)), batch["right_ids"][r].values.take(pa.array(j)), pa.array(score)], names=names)


def dice_multiset(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str, block: str | None = None, best: int = 0, near: float = 0.0, window: int | None = WINDOW) -> DataFrame:
    """(left_id, right_id, score) of pairs that share a bigram: twice the shared count over all bigrams of both.

    With ``block``, pairs are of one block only, and packs of both sides meet on it. Without, the left side is the
    stated query set: it goes to the tasks in packs of LEFT_BLOCK keys or LEFT_CHARS characters, and the right side is read
    once for each. Keys are the first ``window`` characters of match keys; with None they are whole.
    Equal keys score 1, those of one character too; empty keys have no pair. Rows of the right side are dealt over the
    tasks by their id. With ``best``, pairs more than ``near`` below a left row's ``best``-th score may be left out (a task
    leaves out those that are so far below what it has met itself): for ``accept``, ``best_match`` and the like.
    """
    right = right.select(*dict.fromkeys([right_id, text, *([block] if block else [])])).repartition(right_id)
    of = F.lit("") if block is None else F.col(block).cast("string")
    keyed = lambda rows, row_id: rows.select(row_id, key_of(F.col(text), window).alias("key"), of.alias("block"))
    names = [left_id, right_id, "score"]
    schema = T.StructType([T.StructField(left_id, left.schema[left_id].dataType), T.StructField(right_id, right.schema[right_id].dataType), T.StructField("score", T.DoubleType())])
    if block is not None:
        a = _packed(keyed(left, left_id), left_id, LEFT_BLOCK, LEFT_CHARS).toDF("left_ids", "left_keys", "block")
        b = _packed(keyed(right, right_id), right_id, RIGHT_BLOCK, CHARS).toDF("right_ids", "right_keys", "block")
        return b.join(a, "block").mapInArrow(lambda batches: _score_packs(batches, names, best, near), schema)
    id_type = {"string": pa.string(), "int": pa.int32()}.get(left.schema[left_id].dataType.simpleString(), pa.int64())
    texts = keyed(right, right_id).drop("block")

    def against(ids: list, keys: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pack, own = Pack(keys), pa.array(ids, id_type)
            for batch in batches:
                for at in range(0, batch.num_rows, RIGHT_BLOCK):
                    part = batch.slice(at, RIGHT_BLOCK)
                    part = part.filter(pc.greater(pc.utf8_length(part["key"]), 0))
                    for j, i, score in pack.scores(part["key"].to_pylist(), best, near):
                        yield pa.RecordBatch.from_arrays([own.take(pa.array(i)), part[right_id].take(pa.array(j)), pa.array(score)], names=names)

        return texts.mapInArrow(run, schema)

    parts = [against(*pack) for pack in blocks_of(keyed(left, left_id).where("length(key) >= 1"), left_id, LEFT_BLOCK, LEFT_CHARS)]
    return reduce(DataFrame.unionByName, parts) if parts else right.sparkSession.createDataFrame([], schema)


def accept(scored: DataFrame, row_id: str, other: str, least: float = 0.48, near: float = NEAR) -> DataFrame:
    """(row_id, other, score, accepted, alike): each row's best partner, whether it is good enough, and all partners no
    more than ``near`` below the best, in the order of their rank."""
    alike = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), F.col(other)))), lambda x: x[other])
    # a window, so that scores are made once
    kept = scored.withColumn("top", F.max("score").over(Window.partitionBy(row_id))).where(F.col("score") >= F.col("top") - F.lit(near))
    return kept.groupBy(row_id).agg(F.min_by(other, F.struct(-F.col("score"), other)).alias(other), F.max("top").alias("score"), alike.alias("alike")).withColumn("accepted", F.col("score") >= F.lit(least))


def dice_set(a: Column, b: Column) -> Column:
    """Twice the shared distinct bigrams over the distinct bigrams of both; 0 where there are none."""
    x, y = F.array_distinct(grams(a)), F.array_distinct(grams(b))
    total = F.size(x) + F.size(y)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(x, y)) / total)


def best_match(scored: DataFrame, row_id: str, *ties: str, least: float | None = None) -> DataFrame:
    """The best-scored candidate of each row; ties by the columns named."""
    ranked = scored.withColumn("_rn", F.row_number().over(Window.partitionBy(row_id).orderBy(F.desc("score"), *ties))).where("_rn = 1").drop("_rn")
    return ranked if least is None else ranked.where(F.col("score") >= least)


def distinctive_overlap(a: Column, b: Column, common: list[str], window: int = 180) -> Column:
    """Two or more bigrams that are not common, or any trigram, of a's first characters that b has anywhere."""
    x = F.substring(a, 1, window)
    stop = F.array(*[F.lit(w) for w in common]).cast("array<string>")
    two = F.size(F.array_except(F.array_intersect(grams(x), grams(b)), stop))
    return (two >= 2) | (F.size(F.array_intersect(grams(x, 3), grams(b, 3))) > 0)


def gram_containment(a: Column, b: Column) -> Column:
    """The share of a's distinct bigrams that b has too."""
    x = F.array_distinct(grams(a))
    return F.when(F.size(x) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, grams(b))) / F.size(x))


def _heads(keys: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every window of ``size`` characters of the keys."""
    rows, found = [], []
    for row, key in enumerate(keys):
        codes = np.frombuffer((key or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(codes) - size + 1
        if n > 0:
            mixed = np.zeros(n, np.uint64)
            for i in range(size):
                mixed = (mixed ^ codes[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            rows.append(np.full(n, row))
            found.append(mixed)
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, int), np.zeros(0, np.uint64))


def probe(items: DataFrame, texts: DataFrame, item_id: str, text_id: str, text: str = "text", sizes: tuple[int, ...] = (32, 24, 18), least: int = 12) -> DataFrame:
    """(item_id, text_id, matched): texts that hold the first characters of an item's match key, and how many of them.

    The longest of ``sizes`` that lies inside counts; items with keys under ``least`` characters have no pair. Items are
    the stated query set and go to the tasks in blocks of bounded size; a text is tried on those items only whose first
    ``least`` characters it has, found by hash, and nothing is shuffled.
    """
    longest = max(sizes)
    wanted = items.select(item_id, F.substring(match_key(F.col(text)), 1, longest).alias("key")).where(F.length("key") >= least)
    keys = texts.select(text_id, match_key(F.col(text)).alias("key")).where(F.length("key") >= least)
    schema = T.StructType([T.StructField(item_id, items.schema[item_id].dataType), T.StructField(text_id, texts.schema[text_id].dataType), T.StructField("matched", T.IntegerType())])
    id_type = {"string": pa.string(), "int": pa.int32()}.get(items.schema[item_id].dataType.simpleString(), pa.int64())

    def against(ids: list, probes: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, head = _heads([p[:least] for p in probes], least)
            order = np.argsort(head, kind="stable")
            head = head[order]
            for batch in batches:
                found: list[tuple[int, int, int]] = []
                for row, key in enumerate(batch["key"].to_pylist()):
                    _, own = _heads([key], least)
                    for h in np.intersect1d(own, head):
                        for i in order[np.searchsorted(head, h) : np.searchsorted(head, h, "right")]:
                            hits = [min(n, len(probes[i])) for n in sizes if probes[i][:n] in key]
                            if hits:
                                found.append((int(i), row, max(hits)))
                item, row, size = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in item], id_type), batch[text_id].take(pa.array(row, pa.int64())), pa.array(size, pa.int32())], names=schema.names)

        return keys.mapInArrow(run, schema)

    parts = [against(*block) for block in blocks_of(wanted, item_id)]
    return reduce(DataFrame.unionByName, parts) if parts else texts.sparkSession.createDataFrame([], schema)
