"""Substring dedup: repeated passages by prefix-partitioned suffix trees.

Texts are sequences of word codes. A passage of ``size`` words that repeats ends
in a tree node at least ``size`` words deep, so suffixes are cut at ``size`` words.

1. Anchors. Each suffix of ``size`` words has an anchor, the least hash among its
   short word runs. A suffix can repeat only if its anchor does: documents learn
   which of their anchors are met elsewhere, all other suffixes stay out.
2. Partitioning. Neighbouring suffixes with one anchor travel as one stretch of
   words to the group of that anchor. Where an anchor would gather more stretches
   than a task should hold, the prefix that splits its suffixes grows to all
   ``size`` words, so only equal suffixes still meet.
3. Trees. A group's suffixes are sorted word by word; the lengths of the common
   prefixes of neighbours are the depths of the inner nodes. Leaves under a node
   ``size`` or more deep repeat each other: the earliest stays. Neighbouring
   repeats make up the maximal ones.
4. Words covered by a repeat are taken out of their documents.

Every task merges equal stretches of its own documents before the shuffle, so a
passage found in very many documents travels once per batch, not once per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import settle, sha256_text, split_words, text_of
from lectern.llm.jaccard_join import mix

U64 = np.uint64
SIZE, RUN = 20, 6
#: Stretches of an anchor beyond which its suffixes are split by all their words.
GROUP = 4_000
#: Stretches whose trees are built together, and texts that are cut into stretches together.
AT_ONCE, TEXTS = 10_000, 2_500
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(BASE), -1, 2**64))
NONE = -(2**63)


def _ranges(words: np.ndarray):
    """A function giving hashes of the words [start, start + length) of a flat array, for arrays of starts."""
    n = len(words) + 1
    power, inverse = np.ones(n, U64), np.ones(n, U64)
    np.cumprod(np.full(n - 1, BASE), out=power[1:])
    np.cumprod(np.full(n - 1, INVERSE), out=inverse[1:])
    sums = np.zeros(n, U64)
    np.cumsum(words * power[:-1], out=sums[1:])
    return lambda start, length: mix((sums[start + length] - sums[start]) * inverse[start])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words of a list column in a row, and where each row begins; null rows are empty."""
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).view(U64), np.concatenate([[0], np.cumsum(lengths)])


def window_starts(edges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions where a window of ``size`` words of one row begins, and the row of each."""
    counts = np.maximum(np.diff(edges) - size + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    return edges[:-1][rows] + np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows], rows


def _slide(values: np.ndarray, wide: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``wide`` neighbours, by doubling."""
    have = 1
    while have < wide:
        step = min(have, wide - have)
        values = pick(values[: len(values) - step], values[step:])
        have += step
    return values


def anchors(words: np.ndarray, edges: np.ndarray, size: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and flat place of all word runs that are the minimizer of some window; equal neighbours count apart."""
    starts, _ = window_starts(edges, size)
    if not len(starts):
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    every, wide = _ranges(words)(np.arange(len(words) - run + 1), run), size - run + 1
    least = np.zeros(len(words) - size + 1, U64)
    least[starts] = _slide(every, wide, np.minimum)[starts]
    pad = np.zeros(wide - 1, U64)
    at = np.flatnonzero(every == _slide(np.concatenate([pad, least, pad]), wide, np.maximum))
    return every[at], np.searchsorted(edges, at, "right") - 1, at


def _anchors(size: int, run: int):
    """(key, did, tid, value, n): anchors of a batch. A value met twice here is known to repeat: its documents get
    rows of their own keys, with the value beside; one row keyed by the value, with its count, tells the other tasks."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, edges = _flat(batch["w"])
            least, rows, _ = anchors(words, edges, size, run)
            order = np.argsort(least, kind="stable")
            least, rows = least[order], rows[order]
            first = np.ones(len(least), bool)
            first[1:] = least[1:] != least[:-1]
            heads = np.flatnonzero(first)
            counts = np.diff(np.append(heads, len(least)))
            known = np.repeat(counts, counts) > 1
            pairs = np.unique(np.stack([least[known].view(np.int64), rows[known]]), axis=1) if known.any() else np.empty((2, 0), np.int64)
            own = mix(mix(pairs[1].astype(U64) + U64(hash(batch["did"][0].as_py()) & 0xFFFFFFFF)) ^ pairs[0].view(U64)).view(np.int64) if pairs.size else pairs[0]
            at = np.concatenate([rows[heads], pairs[1]])
            told = np.arange(len(at)) < len(heads)
            values = pa.array(np.concatenate([np.zeros(len(heads), np.int64), pairs[0]]), mask=told)
            n = pa.array(np.concatenate([counts, np.zeros(pairs.shape[1], np.int64)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([least[heads].view(np.int64), own])), *(batch[c].take(pa.array(at)) for c in ("did", "tid")), values, n], names=["key", "did", "tid", "value", "n"])

    return emit


def _binaries(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary array of pieces of ``flat``, of ``lengths`` items each."""
    ends = np.concatenate([[0], np.cumsum(lengths) * flat.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


STRETCHES = "key long, k int, did long, tid int, start int, words binary, gone binary"
FOUND = "did long, tid int, gone binary"


def _stretches(size: int, run: int):
    """Stretches of neighbouring suffixes that share a repeated anchor, merged where equal; starts of all but the
    earliest of equal ones come as ``gone``. ``k`` is their number, 0 where the prefix is the whole suffix."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            words, edges = _flat(batch["w"])
            starts, rows = window_starts(edges, size)
            if not len(starts):
                continue
            ranges = _ranges(words)
            every = ranges(np.arange(len(words) - run + 1), run)
            anchor = _slide(np.arange(len(every)), size - run + 1, lambda a, b: np.where(every[a] <= every[b], a, b))[starts]
            tag = mix(every[anchor] ^ mix(rows.astype(U64)))
            hit = {}
            for name in ("light", "heavy"):
                wanted, ends = _flat(batch[name])
                hit[name] = np.isin(tag, mix(wanted ^ mix(np.repeat(np.arange(len(edges) - 1), np.diff(ends)).astype(U64))))
            sel = np.flatnonzero(hit["light"] & ~hit["heavy"])
            fresh = np.ones(len(sel), bool)
            fresh[1:] = (np.diff(starts[sel]) != 1) | (np.diff(rows[sel]) != 0) | (np.diff(anchor[sel]) != 0)
            heads = np.flatnonzero(fresh)
            k = np.diff(np.append(heads, len(sel)))
            deep = np.flatnonzero(hit["heavy"])
            s0 = np.concatenate([starts[sel[heads]], starts[deep]])
            row = np.concatenate([rows[sel[heads]], rows[deep]])
            lead = np.concatenate([anchor[sel[heads]] - starts[sel[heads]], np.zeros(len(deep), np.int64)])
            count = np.concatenate([k, np.ones(len(deep), np.int64)])
            k = np.concatenate([k, np.zeros(len(deep), np.int64)])
            if not len(s0):
                continue
            content = ranges(s0, count + size - 1)
            key = np.concatenate([every[s0[: len(heads)] + lead[: len(heads)]], content[len(heads) :]])
            did, tid, start = batch["did"].to_numpy()[row], batch["tid"].to_numpy()[row], s0 - edges[:-1][row]
            order = np.lexsort((start, tid, did, content, lead, k, key))
            key, content, lead, k, did, tid, start, count, s0 = (x[order] for x in (key, content, lead, k, did, tid, start, count, s0))
            head = np.ones(len(key), bool)
            head[1:] = (key[1:] != key[:-1]) | (k[1:] != k[:-1]) | (lead[1:] != lead[:-1]) | (content[1:] != content[:-1])
            first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
            later = (did != did[first]) | (tid != tid[first]) | (start != start[first])
            n = int(head.sum())
            lengths = count[head] + size - 1
            codes = (words[_spread(s0[head], lengths)] >> U64(32)).astype(">u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[head].view(np.int64)), pa.array(k[head].astype(np.int32)), pa.array(did[head]), pa.array(tid[head]), pa.array(start[head].astype(np.int32)), _binaries(codes, lengths), pa.nulls(n, pa.binary())],
                names=["key", "k", "did", "tid", "start", "words", "gone"],
            )
            if later.any():
                did, tid, start, count = did[later], tid[later], start[later], count[later]
                gone = _gone(did, tid, start, count)
                m = gone.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix(gone["did"].to_numpy().view(U64)).view(np.int64)), pa.nulls(m, pa.int32()), gone["did"], gone["tid"], pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), gone["gone"]],
                    names=["key", "k", "did", "tid", "start", "words", "gone"],
                )

    return emit


def _gone(did: np.ndarray, tid: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """A row per text with the packed starts of its repeats; ``count`` neighbouring ones from each start on."""
    order = np.lexsort((start, tid, did))
    did, tid, start, count = did[order], tid[order], start[order], count[order]
    fresh = np.ones(len(did), bool)
    fresh[1:] = (did[1:] != did[:-1]) | (tid[1:] != tid[:-1])
    heads = np.flatnonzero(fresh)
    per_text = np.add.reduceat(count, heads) if len(heads) else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(did[heads]), pa.array(tid[heads].astype(np.int32)), _binaries(_spread(start, count).astype("<i4"), per_text)], names=["did", "tid", "gone"])


def sort_suffixes(group: np.ndarray, suffixes: np.ndarray, *ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes (rows of word codes) by group, words and ``ties``, and the words that each shares with
    the one before it: the depth of the tree node above both; -1 where a group begins."""
    wide = suffixes.astype(U64)
    pairs = (wide[:, 0::2] << U64(32)) | np.pad(wide[:, 1::2], ((0, 0), (0, wide.shape[1] % 2)))
    order = np.lexsort((*reversed(ties), *pairs.T[::-1], group))
    ordered, group = suffixes[order], group[order]
    same = ordered[1:] == ordered[:-1]
    depth = np.full(len(order), -1)
    depth[1:] = np.where(same.all(axis=1), suffixes.shape[1], same.argmin(axis=1))
    depth[1:][group[1:] != group[:-1]] = -1
    return order, depth


def _subtrees(size: int):
    """Builds the trees of whole groups; under each node ``size`` words deep all leaves but the earliest are repeats."""
    names = ["key", "k", "did", "tid", "start"]

    def grow(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        key, k, did, tid, start = (table[c].to_numpy() for c in names)
        flat, ends = np.frombuffer(b"".join(table["words"].to_pylist()), ">u4").astype(np.uint32), np.cumsum(k + size - 1)
        of = np.repeat(np.arange(len(k)), k)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
        begin = (ends - (k + size - 1))[of] + inner
        order, depth = sort_suffixes(key[of], flat[begin[:, None] + np.arange(size)], did[of], tid[of], start[of] + inner)
        node = depth < size
        first = order[np.maximum.accumulate(np.where(node, np.arange(len(order)), 0))]
        at = start[of] + inner
        later = (did[of][order] != did[of][first]) | (tid[of][order] != tid[of][first]) | (at[order] != at[first])
        if later.any():
            found = order[later]
            yield _gone(did[of][found], tid[of][found], at[found], np.ones(len(found), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            passed = batch["gone"].is_valid()
            if pa.compute.any(passed).as_py():
                yield batch.filter(passed).select(["did", "tid", "gone"])
            k = batch["k"].fill_null(-1).to_numpy()
            # whole suffixes, in order: a node's leaves follow each other
            deep = batch.take(pa.array(np.flatnonzero(k == 0)))
            if deep.num_rows:
                rows = list(zip(*(deep[c].to_pylist() for c in ("key", "words", "did", "tid", "start"))))
                out = []
                for row in rows:
                    if last is not None and row[:2] == last[:2]:
                        if row[2:] != last[2:]:
                            out.append(row[2:])
                    else:
                        last = row
                if out:
                    did, tid, start = (np.array(x) for x in zip(*out))
                    yield _gone(did, tid, start, np.ones(len(did), np.int64))
            light = batch.take(pa.array(np.flatnonzero(k > 0))).select([*names, "words"])
            if not light.num_rows:
                continue
            key = light["key"].to_numpy()
            if sum(x.num_rows for x in held) >= AT_ONCE and (key != held[-1]["key"][-1].as_py()).any():
                cut = int(np.argmax(key != held[-1]["key"][-1].as_py()))  # the group that was open ends here
                yield from grow([*held, light.slice(0, cut)])
                held, light = [], light.slice(cut)
            held.append(light)
        if held:
            yield from grow(held)

    return run


def text_key() -> Column:
    """Tells texts apart where rows repeat a doc_id."""
    return F.pmod(F.xxhash64(text_of("text")), F.lit(1 << 31)).cast("int").alias("tid")


def repeated_starts(docs: DataFrame, size: int = SIZE, run: int = RUN) -> DataFrame:
    """(did, tid, gone): for texts with repeats, packed 32-bit word positions where a suffix of ``size`` words starts
    whose words also start earlier. ``docs`` has ``did`` (not null), ``tid`` and ``text``."""
    hashed = lambda col: F.transform(split_words(col), lambda x: F.xxhash64(x))
    met = docs.select("did", "tid", hashed(F.col("text")).alias("w")).mapInArrow(_anchors(size, run), "key long, did long, tid int, value long, n int")
    here = Window.partitionBy("key")
    counted = met.withColumns({"rows": F.count(F.lit(1)).over(here), "n": F.sum("n").over(here)})
    repeated = settle(counted.where("value is not null or rows > 1").select("did", "tid", F.coalesce("value", "key").alias("value"), "n"))
    heavy = repeated.where(F.col("n") > GROUP).select("value", F.lit(True).alias("heavy")).distinct()
    split = repeated.select("did", "tid", "value").join(heavy, "value", "left")
    wanted = split.groupBy("did", "tid").agg(F.collect_set(F.when(F.col("heavy").isNull(), F.col("value"))).alias("light"), F.collect_set(F.when(F.col("heavy"), F.col("value"))).alias("heavy"))
    joined = docs.join(wanted.hint("shuffle_hash"), ["did", "tid"])
    stretches = joined.select("did", "tid", hashed(F.col("text")).alias("w"), "light", "heavy").mapInArrow(_stretches(size, run), STRETCHES)
    trees = stretches.repartition("key").sortWithinPartitions("key", "words", "did", "tid", "start")
    return trees.mapInArrow(_subtrees(size), FOUND).groupBy("did", "tid").agg(F.collect_list("gone").alias("gone"))


def _cut_out(size: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch["text"], batch["gone"]):
                words = (text.as_py() or "").encode().split()  # at ASCII white space
                n = len(words)
                if gone.is_valid and len(gone):
                    at = np.concatenate([np.frombuffer(g.as_py(), np.int32) for g in gone])
                    change = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(at + size, n), minlength=n + 1)[: n + 1]
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:n] == 0)]
                out.append((n, n - len(words), b" ".join(words).decode("utf-8", "replace")))
            n, removed, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["did"], *(batch[f"_{c}"] for c in names), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["did", *(f"_{c}" for c in names), "n_words", "n_removed", "kept_text"])

    return run


def drop_repeats(docs: DataFrame, size: int = SIZE, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (doc_id) of every row, with n_words, n_removed and kept_text.

    Words are runs without ASCII white space. A word goes if a window of
    ``size`` consecutive words covers it whose words also start earlier: at a
    smaller doc_id, or earlier in the same document, in the texts as given.
    Kept words are joined by one space.

    Rows repeated as a whole are one document and all come out alike. Other
    texts that share a doc_id are documents of their own, in the order of their
    hashes. A null doc_id counts as the smallest. Null and empty texts, and texts
    under ``size`` words, lose nothing. Empty tables give empty results. Columns
    that are not carried are not read; carried ones may have any name but
    n_words, n_removed and kept_text.
    """
    rest = [c for c in carry or ["doc_id"] if c != "doc_id"]
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("did")
    whole = docs.select(did, text_key(), text_of("text").alias("text"), *[F.col(c).alias(f"_{c}") for c in rest])
    cut = whole.join(repeated_starts(whole.select("did", "tid", "text"), size).hint("shuffle_hash"), ["did", "tid"], "left")
    shaped = cut.select("did", "text", "gone", *[f"_{c}" for c in rest])
    kinds = shaped.select("did", *[f"_{c}" for c in rest]).schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    out = shaped.mapInArrow(_cut_out(size, rest), kinds)
    doc_id = F.when(F.col("did") != F.lit(NONE), F.col("did")).alias("doc_id")
    return out.select(*[doc_id if c == "doc_id" else F.col(f"_{c}").alias(c) for c in carry or ["doc_id"]], "n_words", "n_removed", "kept_text")


def op7_substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document, for windows of 20 words."""
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", sha256_text(F.col("kept_text")).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)
), s AS (
  SELECT doc_id, pos, CASE WHEN count(*) OVER f = 20 THEN string_agg(word, ' ') OVER f END AS suffix FROM w
  WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), m AS (
  SELECT doc_id, pos, CASE WHEN suffix IS NOT NULL AND row_number() OVER (PARTITION BY suffix ORDER BY doc_id, pos) > 1 THEN 1 ELSE 0 END AS again FROM s
), c AS (
  SELECT doc_id, pos, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM m
), k AS (
  SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM w JOIN c USING (doc_id, pos) GROUP BY 1
)
SELECT d.doc_id AS doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""
