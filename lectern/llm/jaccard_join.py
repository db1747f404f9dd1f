"""Near-duplicate join on word 5-grams by chosen paths.

Documents of equal shingle sets form one class, whose links are found once.

1. Chosen paths. Each run samples pairs of signature tokens by a seeded hash;
   classes that share a sampled pair share a bucket. Runs repeat until a pair at
   the threshold is missed with a probability below ``1 - recall``.
2. Families. The least class of a large bucket represents it; classes of the
   bucket whose signatures agree with it in half of the values are its family.
   From here on a family is one node, which adds each key of its members once.
   Buckets that still are too large are split by tokens drawn along the path.
3. Single classes of a bucket are judged pair by pair on their whole sets, in
   the least of their common buckets only, so links are counted once and never
   listed. A single class that meets a family visits it; where two families meet,
   the members of the one visit the other.
4. In a family every set is held as its difference from the representative's.
   With ``y`` = (1 + t) * removed + t * size, two sets are linked exactly if
   ya + yb <= (1 + t) * (size of the representative + common differences).
   Members are blocked by ``y``: most pairs of blocks are decided by their
   bounds, without a look at the sets; only the rest meets, as differences.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import settle, split_words, text_of, tidy

SIGNATURE, BUCKET, DEPTH = 64, 128, 8
#: Classes of a large bucket that are compared with as many others in one unit of work; a bucket that was split twice may be as large.
BLOCK = 512
DRAWS = 2.0  # paths of two tokens sampled per run, on average
#: Tokens drawn along a path when its bucket is split, on average: above 1 / threshold, so that near pairs stay together,
#: and few enough that pairs of little similarity part from level to level.
CHILDREN = 1.6
#: Shares of equal signature values: to live in a family (by triangle, a link of a member then has 0.3 with its
#: representative), and to visit one.
LIVES, VISITS = 0.5, 0.1
#: What is allowed for the error of signatures, between families.
MARGIN = 0.2
#: Members that make a family, and the runs whose buckets show one.
FAMILY, FAMILY_RUNS = 32, 5
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``w``, the hashes of the words of ``text`` in order."""
    return docs.select(*columns, F.transform(split_words(text_of("text")), lambda x: F.xxhash64(x)).alias("w"))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted hashes of the windows of ``size`` words; one window of all words where there are fewer."""
    n = len(words)
    if not n:
        return np.empty(0, U64)
    width = min(size, n)
    out = np.zeros(n - width + 1, U64)
    for j in range(width):
        out = out * U64(0x9E3779B97F4A7C15) + words[j : n - width + 1 + j]
    return np.unique(mix(out + U64(width)))


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False).view(U64), column.offsets.to_numpy()
    for a, b in zip(ends, ends[1:]):
        yield flat[a:b]


def _sign(size: int):
    scale = mix(np.arange(1, SIGNATURE + 1, dtype=U64)) | U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, signatures = [], [], []
            for words in _lists(batch["w"]):
                s = shingle_set(words, size)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                low = np.array([(s * a).min() for a in scale]) if len(s) else np.zeros(SIGNATURE, U64)
                signatures.append((mix(low) >> U64(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "th", "n", "ckey", "sig"])

    return run


def runs_for(threshold: float, recall: float) -> int:
    """Runs until a pair at the threshold shares no sampled path with probability below 1 - recall."""
    return max(1, math.ceil(math.log(1 - recall) / -(threshold**2 * DRAWS)))


def _tokens(batch: pa.RecordBatch) -> np.ndarray:
    values = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint32).reshape(-1, SIGNATURE)
    return mix((np.arange(SIGNATURE, dtype=U64) << U64(40)) + values.astype(U64) + U64(1))


def _paths(runs: int):
    """Keys of the token pairs that the runs sample: each run owns a range of the pairs' hash."""
    left, right = np.triu_indices(SIGNATURE, 1)
    limit = U64(min(1.0, runs * DRAWS / len(left)) * (2**64 - 2**12))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                tokens = _tokens(batch)
                pairs = mix(tokens[:, left] * U64(3) ^ tokens[:, right])
                row, col = np.nonzero(pairs < limit)
                keys = mix(pairs[row, col]) >> U64(1)  # not negative
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(batch[c].take(pa.array(row)) for c in ("cid", "node"))], names=["key", "cid", "node"])

    return run


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys one token longer: tokens drawn by a hash of the path so far."""
    limit = U64(int(CHILDREN / SIGNATURE * 2**64))
    for batch in batches:
        seed = batch["key"].to_numpy().view(U64)[:, None]
        drawn = mix(_tokens(batch) ^ seed)
        row, col = np.nonzero(drawn < limit)
        keys = mix(drawn[row, col] + seed[row, 0] * U64(3)) >> U64(1)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(batch[c].take(pa.array(row)) for c in ("cid", "node"))], names=["key", "cid", "node"])


def _agree(one: str, other: str) -> Column:
    """Share of equal values of two signatures."""
    return sum((F.substring(one, 4 * i + 1, 4) == F.substring(other, 4 * i + 1, 4)).cast("int") for i in range(SIGNATURE)) / SIGNATURE


def _drawn(placed: DataFrame, runs: int) -> DataFrame:
    """(key, cid, node): the paths of every class; node is its family or itself."""
    return placed.select("cid", F.coalesce("kin", "cid").alias("node"), "sig").mapInArrow(_paths(runs), "key long, cid long, node long")


def families_of(classes: DataFrame, runs: int) -> DataFrame:
    """(cid, kin, alike): members of large groups of near copies, the class that represents the group, and how alike
    both signatures are."""
    rows = _drawn(classes.select("cid", "sig", F.lit(None).cast("long").alias("kin")), runs).select("key", "cid")
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("cid").alias("kin")).where(F.col("members") > BUCKET)
    pairs = settle(rows.join(large, "key").select("cid", "kin").distinct())
    signed = pairs.join(classes.select("cid", "sig"), "cid").join(classes.select(F.col("cid").alias("kin"), F.col("sig").alias("first")), "kin")
    alike = signed.select("cid", "kin", _agree("sig", "first").alias("alike")).where(F.col("alike") >= LIVES)
    chosen = alike.groupBy("cid").agg(F.min(F.struct("kin", "alike")).alias("k")).select("cid", "k.kin", "k.alike")
    many = chosen.groupBy("kin").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= FAMILY).select("kin")
    return chosen.join(many, "kin").select("cid", "kin", "alike")


def _buckets(rows: DataFrame) -> DataFrame:
    """Buckets of two or more nodes; of buckets with the same nodes one is kept."""
    stats = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("node")).alias("who"), F.sum(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 30))).alias("sum")).where("members > 1")
    return stats.groupBy("members", "who", "sum").agg(F.min("key").alias("key")).select("key", "members")


def entries_of(placed: DataFrame, runs: int) -> DataFrame:
    """(key, node, family, members): the nodes in each bucket, after splitting large buckets up to ``DEPTH`` times."""
    single, family = _drawn(placed.where("kin is null"), runs), _drawn(placed.where("kin is not null"), runs)
    entries = None
    for level in range(DEPTH):
        rows = single.select("key", "node", F.lit(False).alias("family")).unionByName(family.select("key", "node").distinct().withColumn("family", F.lit(True)))
        found = settle(rows.join(_buckets(rows), "key"))
        limit = BUCKET if level < 2 else BLOCK
        heavy = found.where(F.col("members") > limit)
        last = level == DEPTH - 1 or heavy.isEmpty()
        part = found if last else found.where(F.col("members") <= limit)
        entries = part if entries is None else entries.unionByName(part)
        if last:
            break
        # a single class is its node, so its row is at hand; a family's members are looked up
        longer = lambda rows: settle(rows.join(placed.select("cid", "sig"), "cid").mapInArrow(_children, "key long, cid long, node long"))
        single = longer(heavy.where("not family").select("key", F.col("node").alias("cid"), "node"))
        family = longer(family.join(heavy.where("family").select("key").distinct(), "key"))
    return entries


def visits_of(entries: DataFrame, placed: DataFrame, threshold: float) -> DataFrame:
    """(kin, cid): single classes that share a bucket with a family, and members of families that share one with a family
    of a lower number, where signatures are near enough."""
    kin = entries.where("family").select("key", F.col("node").alias("kin"))
    met = kin.join(entries.select("key", "node", "family"), "key").where("not family or kin < node").select("kin", "node", "family").distinct()
    signs = lambda cid, sig: placed.select(F.col("cid").alias(cid), F.col("sig").alias(sig))
    # families are too far apart for a link if their representatives differ by more than both radii and a link allow
    radius = placed.where("kin is not null").groupBy("kin").agg((1 - F.min("alike")).alias("radius"))
    of = lambda c: radius.select(F.col("kin").alias(c), F.col("radius").alias(f"{c}_radius"))
    apart = met.where("family").join(of("kin"), "kin").join(of("node"), "node").join(signs("kin", "first"), "kin").join(signs("node", "sig"), "node")
    close = apart.where(1 - _agree("sig", "first") <= F.col("kin_radius") + F.col("node_radius") + (1 - threshold) + MARGIN).select("kin", "node")
    abroad = close.join(placed.where("kin is not null").select(F.col("kin").alias("node"), "cid"), "node").select("kin", "cid")
    pairs = met.where("not family").select("kin", F.col("node").alias("cid")).unionByName(abroad)
    signed = pairs.join(signs("cid", "sig"), "cid").join(signs("kin", "first"), "kin")
    return signed.where(_agree("sig", "first") >= VISITS).select("kin", "cid")


def _units(entries: DataFrame) -> DataFrame:
    """Rows (u1, u2, u3, side) for each unit of comparison: a bucket, or two blocks of a large one."""
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("cid", F.lit(2)), blocks).cast("int")
    with_block = entries.withColumns({"blocks": blocks, "own": own})
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return with_block.select("*", other).select("key", "cid", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own")


def _sketch(threshold: float):
    """Members of a unit with a partner whose signature is near enough."""
    least = max(1, int(SIGNATURE * (threshold - 5 * math.sqrt(threshold * (1 - threshold) / SIGNATURE))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, cids, b1s, b2s, owns = [], [], [], [], []
            for row in batch.to_pylist():
                members = row["members"]
                sig = np.stack([np.frombuffer(m["sig"], np.uint32) for m in members])
                own = np.array([m["own"] for m in members])
                n = np.array([m["n"] for m in members], float)
                if len(members) < 2:
                    continue
                same = np.zeros((len(sig), len(sig)), np.uint8)
                for i in range(SIGNATURE):
                    same += sig[:, None, i] == sig[None, :, i]
                near = (same >= least) & (np.minimum.outer(n, n) >= threshold * np.maximum.outer(n, n))
                np.fill_diagonal(near, False)
                if row["b1"] != row["b2"]:
                    near &= own[:, None] != own[None, :]
                for i in np.flatnonzero(near.any(axis=1)):
                    keys.append(row["key"]), cids.append(members[i]["cid"]), b1s.append(row["b1"]), b2s.append(row["b2"]), owns.append(int(own[i]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(cids, pa.int64()), pa.array(b1s, pa.int32()), pa.array(b2s, pa.int32()), pa.array(owns, pa.int32())], names=["key", "cid", "b1", "b2", "own"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, over the tokens that two or more sets hold."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    token = np.cumsum(first) - 1
    shared = np.bincount(token)[token] > 1
    token, owner = np.unique(token[shared], return_inverse=True)[1], owner[shared]
    out = np.zeros((len(sets), len(sets)))
    width = int(token.max()) + 1 if len(token) else 0
    for at in range(0, width, 4096):
        here = (token >= at) & (token < at + 4096)
        m = np.zeros((len(sets), min(4096, width - at)), np.float32)
        m[owner[here], token[here] - at] = 1
        out += m @ m.T
    return out


def _verify(threshold: float):
    """Exact links of a unit: (a, b, links of a); b is set for edges of a spanning forest, a's links come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_out, b_out, links_out = [], [], []
            for row in batch.to_pylist():
                members = row["members"]
                if len(members) < 2:
                    continue
                sets = [np.frombuffer(m["set"], U64) for m in members]
                n = np.array([len(s) for s in sets], float)
                both = overlaps(sets)
                near = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9
                np.fill_diagonal(near, False)
                own = np.array([m["own"] for m in members])
                if row["b1"] != row["b2"]:
                    near &= own[:, None] != own[None, :]
                buckets, size = [set(m["keys"]) for m in members], np.array([m["size"] for m in members])
                # where this is the least bucket of either, it is the least that both share
                lead = np.array([min(k) == row["key"] for k in buckets])
                counted = near & (lead[:, None] | lead[None, :])
                for i, j in zip(*np.nonzero(np.triu(near & ~counted))):
                    counted[i, j] = counted[j, i] = min(buckets[i] & buckets[j]) == row["key"]
                links = counted @ size
                label = _labels(near)
                for i in np.flatnonzero(label != np.arange(len(members))):
                    a_out.append(members[label[i]]["cid"]), b_out.append(members[i]["cid"]), links_out.append(0)
                for i in np.flatnonzero(links):
                    a_out.append(members[i]["cid"]), b_out.append(None), links_out.append(int(links[i]))
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64()), pa.array(links_out, pa.int64())], names=["a", "b", "links"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge: the least node of its component, by repeated contraction."""
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = settle(edges.select("a", "b").where("a <> b").distinct())
    roots = None
    while not edges.isEmpty():
        step = settle(both(edges).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")))
        if roots is None:
            roots = step.select("node", F.col("to").alias("root"))
        else:
            moved = roots.join(step.withColumnRenamed("node", "root"), "root", "left")
            roots = settle(moved.select("node", F.coalesce("to", "root").alias("root")))
        left = step.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        edges = settle(edges.join(left, "a").join(right, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _differ(threshold: float):
    """Each participant's difference from the set of its family's representative."""
    names = ["kin", "cid", "size", "lives", "n", "removed", "d", "whole", "y", "diff"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, base in zip(batch["set"], batch["base"]):
                own, base = (np.frombuffer(x.as_py(), U64) for x in (own, base))
                diff = np.setxor1d(own, base, assume_unique=True)
                removed = (len(diff) + len(base) - len(own)) // 2
                out.append((len(own), removed, len(diff), len(base), (1 + threshold) * removed + threshold * len(own), diff.tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names[:4]), *(pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 6, kinds))], names=names)

    return run


def _labels(near: np.ndarray) -> np.ndarray:
    """The least row linked with each row, directly or through others."""
    label, before = np.arange(len(near)), None
    while before is None or (label != before).any():
        before, label = label, np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
    return label


def _match(threshold: float):
    """Links between two blocks of a family (or in one), on differences: (a, b, links of a), as in ``_verify``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                one, other = row["one"], row["other"] or []
                both = one + other
                c = overlaps([np.frombuffer(m["diff"], U64) for m in both])
                n, removed, size = (np.array([m[f] for m in both], float) for f in ("n", "removed", "size"))
                shared = row["whole"] - removed[:, None] - removed[None, :] + c
                near = shared >= threshold * (n[:, None] + n[None, :] - shared) - 1e-9
                np.fill_diagonal(near, False)
                if other:
                    near[: len(one), : len(one)] = False
                    near[len(one) :, len(one) :] = False
                links, label, cids = near @ size, _labels(near), np.array([m["cid"] for m in both])
                tied, some = np.flatnonzero(label != np.arange(len(both))), np.flatnonzero(links)
                a = pa.array(np.concatenate([cids[label[tied]], cids[some]]))
                b = pa.array(np.concatenate([cids[tied], cids[some]]), mask=np.arange(len(a)) >= len(tied))
                counts = pa.array(np.concatenate([np.zeros(len(tied)), links[some]]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([a, b, counts], names=["a", "b", "links"])

    return run


def family_links(participants: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links) in families: b is set for edges that connect what is linked, links of a class come in parts.

    ``participants`` has kin, cid and lives (members; not visitors). Visitors are not compared with each other here.
    """
    base = sets.select(F.col("cid").alias("kin"), F.col("set").alias("base"))
    kind = "kin long, cid long, size long, lives boolean, n long, removed long, d long, whole long, y double, diff binary"
    parts = settle(participants.join(sets, "cid").join(base, "kin").select("kin", "cid", "size", "lives", "set", "base").mapInArrow(_differ(threshold), kind))
    full = (1 + threshold) * F.col("whole")
    level = F.least(F.lit(63), F.floor(32 * F.col("y") / full)).cast("int")
    # blocks by y, from counts per level: at most 64 rows a family, no sort of members
    counts = parts.groupBy("kin", "lives", level.alias("level")).agg(F.count(F.lit(1)).alias("count"))
    before = F.coalesce(F.sum("count").over(Window.partitionBy("kin", "lives").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.select("kin", "lives", "level", F.floor(before / BLOCK).alias("from"), F.ceil(F.col("count") / BLOCK).alias("spread"))
    member = F.struct("cid", "size", "n", "removed", "diff")
    block = (F.col("from") + F.pmod(F.xxhash64("cid"), F.col("spread"))).alias("block")
    blocks = settle(
        parts.withColumn("level", level).join(spans, ["kin", "lives", "level"]).select("*", block)
        .groupBy("kin", "lives", "block").agg(F.collect_list(member).alias("members"), F.first("whole").alias("whole"), F.min("y").alias("low"), F.max("y").alias("high"), F.max("d").alias("d"), F.sum("size").alias("weight"))
    )
    bounds = blocks.drop("members")
    other = bounds.select("kin", *[F.col(c).alias(f"o_{c}") for c in ("lives", "block", "low", "high", "d", "weight")])
    ordered = ~F.col("o_lives") | (F.col("o_block") >= F.col("block"))
    pairs = bounds.where("lives").join(other, "kin").where(ordered)
    none = F.col("low") + F.col("o_low") > full + (1 + threshold) * F.least("d", "o_d") + 1e-6
    sure = F.col("high") + F.col("o_high") <= full - 1e-6
    judged = settle(pairs.where(~none).withColumns({"sure": sure, "same": F.col("o_lives") & (F.col("block") == F.col("o_block"))}).drop("low", "high", "d", "o_low", "o_high", "o_d"))
    # sure pairs: every member gets the weight of the other block (its own class apart, where the blocks are one)
    certain = judged.where("sure")
    ours = certain.select("kin", "lives", "block", F.col("o_weight").alias("more"), F.col("same").cast("int").alias("own"))
    theirs = certain.where("not same").select("kin", F.col("o_lives").alias("lives"), F.col("o_block").alias("block"), F.col("weight").alias("more"), F.lit(0).alias("own"))
    granted = ours.unionByName(theirs).groupBy("kin", "lives", "block").agg(F.sum("more").alias("more"), F.max("own").alias("own"))
    given = blocks.join(granted, ["kin", "lives", "block"]).select(F.explode("members").alias("m"), "more", "own").select(F.col("m.cid").alias("a"), F.lit(None).cast("long").alias("b"), (F.col("more") - F.col("own") * F.col("m.size")).alias("links"))
    # the others meet
    open_pairs = judged.where("not sure").select("kin", "block", "o_lives", "o_block", "whole", "same")
    one = blocks.where("lives").select("kin", "block", F.col("members").alias("one"))
    two = blocks.select("kin", F.col("lives").alias("o_lives"), F.col("block").alias("o_block"), F.col("members").alias("two"))
    met = open_pairs.join(one, ["kin", "block"]).join(two, ["kin", "o_lives", "o_block"])
    found = met.select("whole", "one", F.when(~F.col("same"), F.col("two")).alias("other")).mapInArrow(_match(threshold), "a long, b long, links long")
    # what is linked with the representative hangs together through it, sure pairs among them
    spokes = parts.where((F.col("y") <= F.col("whole") + 1e-6) & (F.col("cid") != F.col("kin"))).select(F.col("kin").alias("a"), F.col("cid").alias("b"), F.lit(0).cast("long").alias("links"))
    return found.unionByName(given).unionByName(spokes)


def single_links(entries: DataFrame, active: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links) among single classes, from the units with likely partners (``active``)."""
    keys = entries.groupBy(F.col("node").alias("cid")).agg(F.collect_set("key").alias("keys"))
    full = active.join(sets, "cid").join(keys, "cid")
    member = F.struct("cid", "own", "size", "set", "keys")
    return full.groupBy("key", "b1", "b2").agg(F.collect_list(member).alias("members")).mapInArrow(_verify(threshold), "a long, b long, links long")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, recall: float = 0.999999) -> DataFrame:
    """doc_id, class_id, class_size, n_links, group_id of every row.

    class_id is the least doc_id of the rows with the same set of ``size``-word
    windows (words are runs without ASCII white space, unchanged; a shorter text
    is one window of all its words). n_links counts the other rows whose sets
    have a Jaccard similarity of ``threshold`` or more. group_id is the least
    doc_id of the rows linked directly or through others.

    Rows without a word (null, empty, blank) form no links: each is a class and
    group of its own. Repeated rows are copies like any other. Rows with a null
    doc_id join the class of their set; the class_id and group_id of rows that
    are linked with null ids only are null, their links count. Empty tables give
    empty results. Only ``doc_id`` and ``text`` are read, other columns may have
    any name.
    """
    return _near_duplicates(docs, threshold, size, recall).select("doc_id", "class_id", "class_size", "n_links", "group_id")


def _near_duplicates(docs: DataFrame, threshold: float, size: int, recall: float) -> DataFrame:
    """As ``near_duplicates``, with th (hash of the text), cid (class; null without a word) and root (group)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("th", F.xxhash64(text_of("text")))
    signed = settle(word_hashes(docs, "doc_id", "th").mapInArrow(_sign(size), "doc_id long, th long, n long, ckey binary, sig binary"))
    worded = signed.where("n > 0").withColumn("cid", F.xxhash64("ckey"))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th"))
    classes = settle(worded.groupBy("cid").agg(one.alias("one"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("sig").alias("sig")).select("cid", F.col("one.doc_id").alias("class_id"), F.col("one.th").alias("th"), "size", "n", "sig"))

    runs = runs_for(threshold, recall)
    placed = settle(classes.select("cid", "sig").join(families_of(classes, min(runs, FAMILY_RUNS)), "cid", "left"))
    tidy(docs.sparkSession)
    entries = entries_of(placed, runs)
    lives = placed.where("kin is not null").select("kin", "cid", F.lit(True).alias("lives"))
    participants = settle(lives.unionByName(visits_of(entries, placed, threshold).withColumn("lives", F.lit(False))))

    tidy(docs.sparkSession)
    single = entries.where("not family").select("key", F.col("node").alias("cid"), "members")
    member = F.struct("cid", "own", "n", "sig")
    sketched = (
        _units(single).join(classes.select("cid", "n", "sig"), "cid")
        .groupBy("key", "b1", "b2").agg(F.collect_list(member).alias("members")).where(F.size("members") > 1)
        .mapInArrow(_sketch(threshold), "key long, cid long, b1 int, b2 int, own int")
    )
    active = settle(sketched)
    wanted = active.select("cid").unionByName(participants.select("cid")).unionByName(participants.select(F.col("kin").alias("cid"))).distinct().join(classes.select("cid", "class_id", "th", "size"), "cid")
    sets = settle(_sets_of(docs, wanted, size))
    tidy(docs.sparkSession)
    verified = settle(single_links(single.withColumnRenamed("cid", "node"), active, sets, threshold).unionByName(family_links(participants, sets, threshold)))

    tidy(docs.sparkSession)
    links = verified.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "cid")
    groups = components(verified.where("b is not null"))
    tidy(docs.sparkSession)
    info = classes.select("cid", "class_id", "size").join(links, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = info.groupBy("root").agg(F.min("class_id").alias("group_id"))
    out = worded.select("doc_id", "th", "cid").join(info.join(least, "root"), "cid").select(
        "doc_id", "class_id", F.col("size").alias("class_size"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "group_id", "th", "cid", "root"
    )
    none = F.lit(None).cast("long")
    alone = signed.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("group_id"), "th", none.alias("cid"), none.alias("root"))
    return out.unionByName(alone)


def one_of_each(docs: DataFrame, threshold: float = 0.8, size: int = 5, recall: float = 0.999999) -> DataFrame:
    """The rows of ``docs``, with one row of each group of near duplicates: that of the least doc_id.

    Null ids come after all others; where rows repeat an id, the least text hash stays.
    Of rows repeated as a whole one stays. Every row without a word stays.
    All columns pass through; names that begin with ``_`` are reserved.
    """
    groups = _near_duplicates(docs, threshold, size, recall)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th")
    least = groups.where("cid is not null").groupBy("root").agg(F.min(order).alias("one"))
    stay = least.select(F.coalesce("one.doc_id", F.lit(0)).alias("_id"), F.col("one.nameless").alias("_nameless"), F.col("one.th").alias("_th"))
    text, doc_id = text_of("text"), F.col("doc_id").cast("long")
    keyed = docs.withColumns({"_id": F.coalesce(doc_id, F.lit(0)), "_nameless": doc_id.isNull(), "_th": F.xxhash64(text), "_blank": ~text.rlike("[^\\x20\\x09-\\x0D]")})
    rows = keyed.where("not _blank").join(stay.hint("shuffle_hash"), ["_id", "_nameless", "_th"], "left_semi")
    copies = Window.partitionBy("_id", "_nameless", "_th").orderBy(*[c for c in docs.columns if c != "text" and dict(docs.dtypes)[c] in ("string", "bigint", "int")] or ["_id"])
    first = rows.withColumn("_row", F.row_number().over(copies)).where("_row = 1")
    return first.select(docs.columns).unionByName(keyed.where("_blank").select(docs.columns))


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cid, size, set) of the wanted classes, from the row that names each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(w, size).tobytes() for w in _lists(batch["w"])]
            yield pa.RecordBatch.from_arrays([batch["cid"], batch["size"], pa.array(sets, pa.binary())], names=["cid", "size", "set"])

    named = docs.alias("d").join(wanted.alias("w"), (F.col("d.th") == F.col("w.th")) & F.col("d.doc_id").eqNullSafe(F.col("w.class_id"))).select("cid", "size", "text")
    # rows that repeat a document as a whole bring the same set
    return word_hashes(named, "cid", "size").mapInArrow(run, "cid long, size long, set binary").dropDuplicates(["cid"])


def op9_jaccard_join(docs: DataFrame) -> DataFrame:
    """One row per document: its class of equal sets, its number of links and its group."""
    return near_duplicates(docs.select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(5, len(ws)) - 1], ' ') AS s FROM (
    SELECT doc_id, ws, unnest(generate_series(1, len(ws) - least(5, len(ws)) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS whole FROM s GROUP BY 1
), links AS (
  SELECT p.a AS a, p.b AS b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n u ON u.doc_id = p.a JOIN n v ON v.doc_id = p.b WHERE p.c >= 0.8 * (u.n + v.n - p.c) - 1e-9
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), g AS (
  SELECT a, min(b) AS group_id FROM reach GROUP BY 1
), k AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY 1
), c AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY whole) AS class_id, count(*) OVER (PARTITION BY whole) AS class_size FROM n
)
SELECT d.doc_id AS doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(class_size, 1) AS class_size, coalesce(n_links, 0) AS n_links, group_id
FROM documents d JOIN g ON g.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
