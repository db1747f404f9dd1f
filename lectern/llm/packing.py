"""Best-fit packing by a configuration linear program over the length histogram.

Tokenising gives pieces of at most ``capacity`` tokens; their histogram (one
row per length, so at most ``capacity`` rows) comes to the driver. There a
covering program over configurations (multisets of lengths that fit into one
sequence) is solved by multiplicative weights, each round priced by an
unbounded knapsack, then rounded; what rounding leaves is placed by best fit.
The plan, runs of equal configurations, is bounded by the histogram too. Pieces
find their place by their rank among pieces of the same length.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.bpe import DICT_WORDS, cutter
from lectern.llm.common import settle, text_of

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


class _Words(dict):
    """Packed ids of words that are matches of the pattern; a word is merged when it is first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        data = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return data


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> tuple:
    """The tokenizer of a file, its added tokens and a function from one word to its ids; once per worker.

    Where ids rise in the order of the merges, as in byte-level vocabularies, a
    word's ids depend on the ranks alone, and tiktoken merges it several times faster.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, byte_of = model["vocab"], {c: b for b, c in byte_letters().items()}
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", ())]
    ids = [vocab[w] for w in made]
    plain = {w: i for w, i in vocab.items() if w not in added}
    if ids != sorted(set(ids)) or not plain.keys() - set(made) <= byte_of.keys():
        return tokenizer, added, lambda word: tokenizer.encode([word], is_pretokenized=True, add_special_tokens=False).ids
    import tiktoken

    ranks = {bytes(byte_of[c] for c in w): i for w, i in plain.items()}
    return tokenizer, added, tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def _tokenise(tokenizer_path: str, pattern: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        (tokenizer, added, encode), cut = _tokenizer(tokenizer_path), cutter(pattern)
        words, task, seen = _Words(encode), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4").tobytes()

        def _packed(text: str) -> bytes:
            if any(t in text for t in added):
                return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            if len(words) > DICT_WORDS:
                words.clear()
            return b"".join(map(words.__getitem__, cut(text)))

        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                data = _packed(text.as_py()) + end
                n = len(data) // 4
                first = (n - 1) % capacity + 1
                for piece, start in enumerate([0, *range(first, n, capacity)]):
                    stop = first if piece == 0 else start + capacity
                    out.append((doc_id, piece, start, stop - start, zlib.crc32(data[4 * start : 4 * stop]), task, seen[stop - start]))
                    seen[stop - start] += 1
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of every document's ids followed by ``end_id``; only the first piece of a cut document may be shorter.

    ``task`` and ``nth`` number the pieces of one length: within a task here, over all tasks in ``pack``.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(_tokenise(tokenizer_path, pattern, capacity, end_id), PIECES)


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """For each room up to ``capacity`` the index of the item to take first, -1 for none (unbounded, most value)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        take[room] = -2  # leave one token free
        fit = np.searchsorted(lengths, room, "right")
        if fit:
            worth = best[room - lengths[:fit]] + values[:fit]
            at = int(worth.argmax())
            if worth[at] > best[room]:
                best[room], take[room] = worth[at], at
    return take


def _configuration(first: int, take: np.ndarray, lengths: np.ndarray, left: np.ndarray, capacity: int) -> dict[int, int]:
    """The best filling that holds item ``first``, with no item more often than it is there."""
    used, room = {first: 1}, capacity - int(lengths[first])
    while room > 0:
        at = int(take[room])
        if at == -1:
            break
        if at == -2 or used.get(at, 0) >= left[at]:
            room -= 1
            continue
        used[at] = used.get(at, 0) + 1
        room -= int(lengths[at])
    return used


def solve_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 16, per_round: int = 256, eta: float = 1.0, power: float = 1.15, step: float = 0.5) -> dict[tuple, float]:
    """A fractional cover of the histogram by configurations, by multiplicative weights.

    Each round prices lengths by weight, fills sequences around the lengths
    that are covered least, and lowers the weights of what they cover.
    """
    cover, x = np.zeros(len(lengths)), {}
    weights = (lengths / capacity) ** power  # beyond proportion: long items first, short ones fill what is left
    for _ in range(rounds):
        take = knapsack(lengths, weights, capacity)
        todo = np.flatnonzero(cover < 1 - 1e-9)
        if not len(todo):
            break
        open_before = cover.copy()
        for first in todo[::-1][:per_round]:
            if cover[first] >= 1 - 1e-9:
                continue
            used = _configuration(int(first), take, lengths, np.where(cover < 1 - 1e-9, counts, 0), capacity)
            amount = min(min(1 - cover[i], step) * counts[i] / a for i, a in used.items())
            key = tuple(sorted(used.items()))
            x[key] = x.get(key, 0.0) + amount
            for i, a in used.items():
                cover[i] += a * amount / counts[i]
        weights = weights * np.exp(-eta * (cover - open_before))
        weights = np.maximum(weights, 1e-9)
    return x


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations ((length, times), ...) and how many sequences use each; together they hold the histogram exactly.

    Rounds with several allowances for unfilled room and keeps the plan of fewest sequences.
    """
    least, best = -(-sum(k * n for k, n in histogram.items()) // capacity), None
    for slack in (0, capacity // 256):
        plan = round_lp(histogram, capacity, slack)
        count = sum(m for _, m in plan)
        if best is None or count < best[0]:
            best = (count, plan)
        if count == least:
            break
    return best[1]


def round_lp(histogram: dict[int, int], capacity: int, slack: int, passes: int = 4) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Solve, keep whole copies of configurations with at most ``slack`` free tokens, solve for the rest; best fit at last."""
    lengths = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[int(v)] for v in lengths], np.int64)
    plan: list[tuple[dict[int, int], int]] = []
    for _ in range(passes):
        live = np.flatnonzero(left)
        if not len(live):
            break
        placed = 0
        fractional = solve_lp(lengths[live], left[live], capacity)
        for key, amount in sorted(fractional.items(), key=lambda kv: -kv[1]):
            copies = min(int(amount + 0.5) or 1, *(int(left[live[i]]) // a for i, a in key))
            room = capacity - sum(int(lengths[live[i]]) * a for i, a in key)
            if copies < 1 or room > slack:
                continue  # what is in loose configurations is left to the next pass and to best fit
            placed += copies
            plan.append(({int(lengths[live[i]]): a for i, a in key}, copies))
            for i, a in key:
                left[live[i]] -= copies * a
        if not placed:
            break
    return [(tuple(sorted(c.items(), reverse=True)), m) for c, m in plan + best_fit(lengths, left, capacity)]


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, over runs of equal sequences."""
    by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
    for at in np.argsort(-lengths):
        length, n = int(lengths[at]), int(left[at])
        while n:
            room = min((r for r in by_room if r >= length), default=None)
            if room is None:
                each = min(capacity // length, n)
                config, copies = {length: each}, n // each
                room, n = capacity - each * length, n - copies * each
            else:
                config, there = by_room[room].pop()
                each = min(room // length, n)
                copies = min(there, n // each)
                if there > copies:
                    by_room[room].append((config, there - copies))
                elif not by_room[room]:
                    del by_room[room]
                config = config | {length: config.get(length, 0) + each}
                room, n = room - each * length, n - copies * each
            by_room.setdefault(room, []).append((config, copies))
    return [x for runs in by_room.values() for x in runs]


def _runs(plan: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, first sequence, times in a sequence, offset of the first)."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used, sequence = Counter(), 0
    for config, copies in plan:
        offset = 0
        for length, times in config:
            runs.setdefault(length, []).append((used[length], sequence, times, offset))
            used[length] += copies * times
            offset += length * times
        sequence += copies
    return {k: np.array(v, np.int64) for k, v in runs.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (see ``token_pieces``) with ``sequence_id`` and ``offset``.

    Sequences are gapless from offset 0 and hold at most ``capacity`` tokens.
    Ties among pieces of one length go by task and place, so repeated rows get
    places of their own. An empty table has no sequences.
    """
    pieces = settle(pieces)
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs = _runs(plan_sequences(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                rows = np.flatnonzero(length == one)
                own = runs[int(one)]
                run = own[np.searchsorted(own[:, 0], rank[rows], "right") - 1]
                nth = rank[rows] - run[:, 0]
                sequence[rows], offset[rows] = run[:, 1] + nth // run[:, 2], run[:, 3] + nth % run[:, 2] * one
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = pieces.join(starts, ["length", "task"]).select(*names, (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_packing(docs: DataFrame) -> DataFrame:
    """Pack all documents, tokenised by the 50k vocabulary, into sequences of 2048 tokens."""
    import public_tokenizers

    return pack(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))
