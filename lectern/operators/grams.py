"""Shared character grams of a stated query set and all texts, exactly and without candidates.

The query set goes to the tasks in blocks of bounded size; each text is read once
a block, as a row of a 0/1 matrix over the block's grams, and one product gives
what it shares with every item. No pair of texts is left out, and only pairs
that pass the test leave the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import bare

#: Characters of items in a block, items in a block, and rows of texts multiplied at once.
BLOCK_CHARS, BLOCK_ITEMS, ROWS = 1_000_000, 512, 256


def codes(key: str, size: int) -> np.ndarray:
    """The distinct grams of ``size`` (at most 3) characters as sorted numbers."""
    chars = np.frombuffer(key.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    n = len(chars) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.unique(reduce(lambda out, i: (out << 21) | chars[i : i + n], range(1, size), chars[:n]))


class Block:
    """Items with their grams: ``known`` are all of them, ``has`` says which item has which, ``sizes`` how many each has."""

    def __init__(self, ids: list, keys: list[str], size: int, stop: np.ndarray):
        own = [np.setdiff1d(codes(k, size), stop) for k in keys]
        self.ids, self.size = ids, size
        self.sizes = np.array([len(c) for c in own], np.int64)
        self.known = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
        self.has = np.zeros((len(self.known), len(own)), np.float32)
        for i, c in enumerate(own):
            self.has[np.searchsorted(self.known, c), i] = 1

    def shared(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(shared grams by text and item, distinct grams of each text)."""
        rows, sizes = np.zeros((len(keys), len(self.known)), np.float32), np.zeros(len(keys), np.int64)
        for r, key in enumerate(keys):
            c = codes(key, self.size)
            sizes[r] = len(c)
            if len(self.known):
                at = np.searchsorted(self.known, c)
                at[at == len(self.known)] = 0
                rows[r, at[self.known[at] == c]] = 1
        return (rows @ self.has).astype(np.int64), sizes


def blocks_of(items: DataFrame, item_id: str, most: int = BLOCK_ITEMS, longest: int | None = None) -> Iterator[tuple[list, list[str]]]:
    """Ids and keys of the items (id, key), up to ``most`` of them or ``longest`` (BLOCK_CHARS) characters at a time on the driver; a longer key is a block of its own."""
    ids, keys, chars = [], [], 0
    for row in items.select(item_id, "key").toLocalIterator():
        if ids and (len(ids) == most or chars + len(row["key"]) > (longest or BLOCK_CHARS)):
            yield ids, keys
            ids, keys, chars = [], [], 0
        ids.append(row[item_id])
        keys.append(row["key"])
        chars += len(row["key"])
    if ids:
        yield ids, keys


def shared_grams(items: DataFrame, docs: DataFrame, item_id: str, doc_id: str, keep: Callable[[list[np.ndarray], np.ndarray, np.ndarray], np.ndarray], sizes: tuple[int, ...] = (2,), text: str = "text", window: int | None = None, stop: tuple[str, ...] = ()) -> DataFrame:
    """(item_id, doc_id, shared, items_grams, docs_grams): pairs of an item and a text that pass ``keep``.

    Keys are texts without blanks and marks (null: empty), of items those of the first ``window`` characters. ``keep`` gets the
    matrices of shared grams (text by item) for each of ``sizes``, and the grams of items and texts of the first size;
    ``shared`` and the counts are of that size. Grams in ``stop`` don't count as shared. Every row of either side counts
    by itself, so copies and repeated ids each have their pairs; other columns are not read.
    """
    key = lambda c: F.coalesce(bare(c), F.lit(""))
    wanted = items.select(item_id, key(F.col(text) if window is None else F.substring(text, 1, window)).alias("key"))
    texts = docs.select(doc_id, key(F.col(text)).alias("key"))
    schema = T.StructType([items.schema[item_id], docs.schema[doc_id], *(T.StructField(c, T.LongType()) for c in ("shared", "item_grams", "doc_grams"))])
    stops = [np.unique([codes(w, len(w))[0] for w in stop if len(w) == s] or np.zeros(0, np.int64)) for s in sizes]

    def against(ids: list, keys: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = [Block(ids, keys, s, stops[i]) for i, s in enumerate(sizes)]
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    found = [b.shared(part["key"].to_pylist()) for b in blocks]
                    row, item = np.nonzero(keep([f[0] for f in found], blocks[0].sizes[None, :], found[0][1][:, None]))
                    names = pa.array([ids[i] for i in item], id_type)
                    yield pa.RecordBatch.from_arrays([names, part[doc_id].take(pa.array(row)), pa.array(found[0][0][row, item]), pa.array(blocks[0].sizes[item]), pa.array(found[0][1][row])], names=schema.names)

        return texts.mapInArrow(run, schema)

    id_type = {"string": pa.string(), "int": pa.int32()}.get(items.schema[item_id].dataType.simpleString(), pa.int64())
    parts = [against(*block) for block in blocks_of(wanted, item_id)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def dice_at_least(least: float):
    """Pairs whose distinct grams are alike: twice the shared ones over those of both."""
    return lambda shared, a, b: (shared[0] > 0) & (2.0 * shared[0] >= least * (a + b))


def contained_at_least(least: float):
    """Pairs where the text has this share of the item's distinct grams."""
    return lambda shared, a, b: (a > 0) & (shared[0] >= least * a)


def distinctive(shared: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that share two grams of the first size, or any of the second."""
    return (shared[0] >= 2) | (shared[1] > 0)
