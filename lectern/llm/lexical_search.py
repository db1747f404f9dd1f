"""Ranked lexical search by three phases with uniform thresholds over term-partitioned postings.

Every term of the items has a list of (document, value), ranged by term and
value and sorted by falling value in the shared folder. An item's score of a
document is the sum of its lists' values, each times the term's repeats.

1. Heads: the first entries of every list give partial sums, and the exact
   scores of the documents with the best sums a lower bound ``floor`` of the
   k-th score.
2. Thresholds: every entry of an item's lists above one threshold is fetched, the
   largest at which all lists together hold less than a share of the floor below
   it (a list with a lower head only that head): a document without such an entry
   can't reach the floor, and one with few is soon told from the best. Fetched entries meet by document, in blocks of items; partial
   sums and the most that unseen lists can hold bound scores from above, and what
   can't reach the floor goes at once. The k-th partial sum lifts the floor.
3. Candidates whose bound reaches the floor are looked up in all lists.

All three work on integers, so no score is lost to rounding, ties included.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import scratch, settle

#: Bytes as terms have them: letters and digits, A-Z lower-cased, and all of other scripts; what separates is a blank.
LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
TABLE = bytes(b if b >= 128 or bytes([b]).lower() in LETTERS else 32 for b in range(256)).lower()
PIECE = 1 << 22
#: Terms that a task looks for at once, and terms of items whose sums it builds at once; more come in further passes.
BLOCK = 200_000
#: Entries of each list's head, and documents an item looks up after them: a better floor, the same result.
HEAD, LOOK = 256, 128
#: The share of the floor that lists may hold below the threshold, as a divisor: a larger one fetches more and looks up less.
SHARE = 4
#: Products built at once, unless one document has more.
PRODUCTS = 1 << 20


def terms_of(data: bytes, size: int = PIECE) -> Counter:
    """The terms of a whole text with their counts, a piece at a time."""
    found: Counter = Counter()
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and TABLE[data[end]] != 32:
            end += 1
        found.update(data[at:end].translate(TABLE).split())
        at = end
    return found


def _row_keys(rows: DataFrame, row_id: str, key: str) -> DataFrame:
    """key, id and the text's bytes: ids may be null or repeat, so each row has a key of its own."""
    return rows.select(F.monotonically_increasing_id().alias(key), F.col(row_id).alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))


def item_terms(items: DataFrame, item_id: str) -> DataFrame:
    """(item, id, term, qtf): the terms of each row of ``items`` with their repeats."""
    keyed = _row_keys(items, item_id, "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data in enumerate(batch["data"].to_pylist()):
                found = terms_of(data)
                at = pa.array([row] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([batch["item"].take(at), batch["id"].take(at), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["item", "id", "term", "qtf"])

    return keyed.mapInArrow(run, T.StructType([T.StructField("item", T.LongType()), T.StructField("id", keyed.schema["id"].dataType), T.StructField("term", T.BinaryType()), T.StructField("qtf", T.LongType())]))


def _blocks(terms: DataFrame, size: int) -> Iterator[dict[bytes, int]]:
    """The distinct terms, numbered, at most ``size`` at once on the driver."""
    block: dict[bytes, int] = {}
    n = 0
    for row in terms.orderBy("term").toLocalIterator():
        block[bytes(row["term"])] = n
        n += 1
        if len(block) == size:
            yield block
            block = {}
    if block or not n:
        yield block


def _postings(docs: DataFrame, number: dict[bytes, int], with_sizes: bool) -> DataFrame:
    """(doc, id, n, term, tf): per document one row without a term that has its size, and a row for each numbered term."""
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("id", docs.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("term", T.IntegerType()), T.StructField("tf", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes, terms, counts = [], [], [], []
            for row, data in enumerate(batch["data"]):
                found = terms_of(data.as_py())
                n = sum(found.values())
                hits = [(number[t], c) for t, c in found.items() if t in number]
                terms += [None] * with_sizes + [t for t, _ in hits]
                counts += [0] * with_sizes + [c for _, c in hits]
                at += [row] * (len(hits) + with_sizes)
                sizes += [n] * (len(hits) + with_sizes)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc"].take(take), batch["id"].take(take), pa.array(sizes, pa.int64()), pa.array(terms, pa.int32()), pa.array(counts, pa.int64())], names=["doc", "id", "n", "term", "tf"])

    return docs.mapInArrow(run, schema)


def value_of(w: Column, tf: Column, n: Column, docs: int, total: int) -> Column:
    """A list's value of a document: weight times the damped count, in whole numbers."""
    m = F.lit(75) + F.call_function("div", F.lit(25) * n * F.lit(docs), F.lit(max(total, 1)))
    return w * F.call_function("div", F.lit(1_000_000_000) * tf, F.lit(1000) * tf + F.lit(12) * m)


def _best(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k of each item."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _kth(scored: DataFrame, score: str, k: int) -> DataFrame:
    """(item, floor): each item's k-th score, for items that have k."""
    return _best(scored, k, F.desc(score)).groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.min(score).alias("floor")).where(F.col("c") == k).drop("c")


def _exact(wanted: DataFrame, lists: DataFrame, queries: DataFrame) -> DataFrame:
    """(item, doc, score): whole scores of the pairs ``wanted``, looked up in all lists."""
    asked = wanted.select("item", "doc").join(queries.select("item", "term", "qtf"), "item")
    of = lists.join(wanted.select("doc").distinct(), "doc", "left_semi")
    return asked.join(of, ["term", "doc"]).groupBy("item", "doc").agg(F.sum(F.col("qtf") * F.col("v")).alias("score"))


@dataclass
class Asked:
    """A block of items: their terms sorted by term (``starts`` of each), and per item threshold, floor and what lists hold below the threshold."""

    items: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    qtf: np.ndarray
    most: np.ndarray
    limit: np.ndarray
    floor: np.ndarray
    cap: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Asked:
        at = {name: np.array([r[name] for r in rows], np.int64) for name in ("item", "term", "qtf", "most", "limit", "floor")}
        at = {name: a[np.argsort(at["term"], kind="stable")] for name, a in at.items()}
        items, item = np.unique(at["item"], return_inverse=True)
        terms, starts = np.unique(at["term"], return_index=True)
        limit, floor, cap = (np.zeros(len(items), np.int64) for _ in range(3))
        limit[item], floor[item] = at["limit"], at["floor"]
        np.add.at(cap, item, at["most"])
        return cls(items, terms, np.append(starts, len(item)), item, at["qtf"], at["most"], limit, floor, cap)

    def reach(self, doc: np.ndarray, term: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, doc, low, bound) of the pairs that may reach their item's floor; all entries of a document are here, one after the other."""
        t = np.searchsorted(self.terms, term)
        n = self.starts[t + 1] - self.starts[t]
        row = np.repeat(np.arange(len(doc)), n)
        at = np.arange(len(row)) + np.repeat(self.starts[t] - (np.cumsum(n) - n), n)
        value = self.qtf[at] * v[row]
        over = value > self.limit[self.item[at]]
        row, at, value = row[over], at[over], value[over]
        if not len(row):
            return (np.zeros(0, np.int64),) * 4
        docs, nth = np.unique(doc, return_inverse=True)
        pair = nth[row] * len(self.items) + self.item[at]
        order = np.argsort(pair, kind="stable")
        first = np.flatnonzero(np.diff(pair[order], prepend=-1))
        low, seen = np.add.reduceat(value[order], first), np.add.reduceat(self.most[at][order], first)
        nth, item = np.divmod(pair[order][first], len(self.items))
        bound = low + self.cap[item] - seen
        may = bound >= self.floor[item]
        return self.items[item[may]], docs[nth[may]], low[may], bound[may]

    def steps(self, doc: np.ndarray, term: np.ndarray) -> Iterator[slice]:
        """Cuts between documents, about PRODUCTS products apart."""
        ends = np.append(np.flatnonzero(np.diff(doc)) + 1, len(doc))
        t = np.searchsorted(self.terms, term)
        made = np.cumsum(self.starts[t + 1] - self.starts[t])[ends - 1]
        at, done = 0, 0
        while at < len(doc):
            i = max(np.searchsorted(made, done + PRODUCTS, "right") - 1, np.searchsorted(ends, at, "right"))
            yield slice(at, ends[i])
            at, done = ends[i], made[i]


def _reaching(fetched: DataFrame, asked: Asked) -> DataFrame:
    """(item, doc, low, bound) of all pairs that may reach their floor, from fetched entries (doc, term, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for columns in _with_end(batches):
            new = [np.zeros(0, np.int64)] * 3 if columns is None else [np.asarray(columns[c], np.int64) for c in ("doc", "term", "v")]
            held = [np.concatenate(x) for x in zip(held, new)]
            # the last document may go on in the next batch
            whole = len(held[0]) if columns is None else int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            ready, held = [x[:whole] for x in held], [x[whole:] for x in held]
            for part in asked.steps(ready[0], ready[1]) if whole else ():
                found = asked.reach(*(x[part] for x in ready))
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["item", "doc", "low", "bound"])

    return fetched.repartition("doc").sortWithinPartitions("doc").select("doc", "term", "v").mapInArrow(run, "item long, doc long, low long, bound long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _item_blocks(bounded: DataFrame, size: int) -> Iterator[list]:
    """The items' rows in blocks of about ``size``, each item whole in one."""
    block: list = []
    for row in bounded.select("item", "term", "qtf", "most", "limit", "floor").orderBy("item").toLocalIterator():
        if len(block) >= size and row["item"] != block[-1]["item"]:
            yield block
            block = []
        block.append(row)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", block: int = BLOCK, head: int = HEAD, look: int = LOOK) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (score above 0) of each item, ties by doc_id (null first).

    Each row of either side counts as a document or item of its own, also where ids are null or repeat (equal documents
    with one id then follow each other in any order). Null texts have no terms; items without terms, or a table without
    documents, give no rows; other columns are not read. Terms and items come in blocks of ``block`` rows, the only part
    of either table that the driver or a task holds whole; documents are read once for each block of terms, in pieces.
    """
    spark = docs.sparkSession
    asked = settle(item_terms(items, item_id))
    path = scratch(spark, "postings")
    keyed = _row_keys(docs, doc_id, "doc")
    numbers = []
    for i, number in enumerate(_blocks(asked.select("term").distinct(), block)):
        _postings(keyed, number, with_sizes=i == 0).write.parquet(f"{path}/block={i}")
        numbers.append(spark.createDataFrame([(bytearray(t), n) for t, n in number.items()], "word binary, term int"))
    found = spark.read.parquet(path)
    sizes = found.where("term is null")
    of = sizes.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    counts = found.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000) * F.log((F.lit(2 * of["docs"] + 2).cast("double")) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = counts.select("term", weight.alias("w")).where("w > 0")
    listed = found.where("term is not null").join(weights, "term").select("term", "doc", value_of(F.col("w"), F.col("tf"), F.col("n"), of["docs"], of["total"]).alias("v"))
    # ranged by term and value: a list of any length lies in as many parts as it needs, its head in the first
    order = ["term", F.desc("v"), "doc"]
    lists_path = scratch(spark, "lists")
    listed.where("v > 0").repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(lists_path)
    lists = spark.read.parquet(lists_path)

    words = numbers[0]
    for more in numbers[1:]:
        words = words.unionByName(more)
    tops = lists.groupBy("term").agg(F.max("v").alias("top"))
    numbered = asked.withColumnRenamed("term", "word").join(words, "word").select("item", "id", "term", "qtf").join(tops, "term")
    queries = settle(numbered.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("item"))))

    # 1: heads
    heads = lists.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("v"), "doc"))).where(F.col("rank") <= head)
    sums = heads.join(queries, "term").groupBy("item", "doc").agg(F.sum(F.col("qtf") * F.col("v")).alias("low"))
    first = _exact(_best(sums, max(look, k), F.desc("low"), F.asc("doc")), lists, queries)
    floors = _kth(first, "score", k)

    # 2: uniform thresholds
    rise = Window.partitionBy("item").orderBy("reach", "term")
    below = F.sum("reach").over(rise) - F.col("reach")
    level = F.call_function("div", F.call_function("div", F.col("floor"), F.lit(SHARE)) - 1 - below, F.col("m") - F.row_number().over(rise) + 1)
    leveled = queries.join(floors, "item", "left").fillna(0, "floor").withColumn("reach", F.col("qtf") * F.col("top")).withColumn("level", level)
    limit = F.greatest(F.max("level").over(Window.partitionBy("item")), F.lit(0))
    bounded = settle(leveled.withColumn("limit", limit).withColumn("most", F.least("limit", "reach")))
    reaching = scratch(spark, "reaching")
    spark.createDataFrame([], "item long, doc long, low long, bound long").write.parquet(f"{reaching}/block=-1")
    for i, rows in enumerate(_item_blocks(bounded, block)):
        here = bounded.where(F.col("item").between(rows[0]["item"], rows[-1]["item"]))
        least = here.groupBy("term").agg(F.min(F.call_function("div", F.col("limit"), F.col("qtf"))).alias("least"))
        _reaching(lists.join(least, "term").where(F.col("v") > F.col("least")), Asked.of(rows)).write.parquet(f"{reaching}/block={i}")
    partial = spark.read.parquet(reaching).drop("block")
    # 3: what the lifted floor leaves is looked up
    candidates = partial.join(_kth(partial, "low", k), "item", "left").where(F.col("bound") >= F.coalesce("floor", F.lit(0))).select("item", "doc")
    scored = _exact(candidates, lists, queries).where("score > 0")
    named = scored.join(sizes.select("doc", F.col("id").alias(doc_id)), "doc")
    ranked = _best(named, k, F.desc("score"), F.asc_nulls_first(doc_id), F.asc("doc"))
    ids = asked.select("item", F.col("id").alias(item_id)).distinct()
    return ranked.join(ids, "item").select(item_id, "rank", doc_id, "score")


def op11_lexical_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The 20 best documents of each item; nulls, repeats and empty tables as in ``search``."""
    return search(docs, items)


TERMS = "list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, unnest({TERMS}) AS term FROM documents
), p AS (
  SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL
), s AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY 1
), g AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM s
), q AS (
  SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * (SELECT docs FROM g) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p GROUP BY 1
), v AS (
  SELECT p.doc_id, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * (SELECT docs FROM g)) // (SELECT total FROM g)))) AS v FROM p JOIN s USING (doc_id) JOIN w USING (term)
), r AS (
  SELECT item_id, doc_id, sum(qtf * v)::BIGINT AS score FROM q JOIN v USING (term) GROUP BY ALL
), k AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0
)
SELECT * FROM k WHERE rank <= 20
"""
