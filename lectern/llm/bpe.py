"""Byte-level BPE: ranked merges folded by higher-order functions, and decoding.

Encoding has three narrow steps, with no shuffle: (1) texts are cut into the
pattern's matches and turned into codes of the task's distinct words; new words
travel once, as byte arrays, ahead of the texts that use them; (2) a fold of
``aggregate``/``transform`` merges each distinct word's bytes by rank, looking
pairs up in a literal map; (3) codes are replaced by the words' ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import text_of

#: Longer words (runs without a break) are merged with a heap instead of the quadratic fold.
FOLD_BYTES = 64
#: A task's dictionary is begun anew beyond this many words, to bound its memory.
DICT_WORDS = 1_000_000
WORDS_PER_ROW, DOCS_PER_STEP = 1024, 256
#: Partitions of the input that share a task and so its dictionary, as long as each core keeps some tasks.
SHARED, TASKS_PER_CORE = 3, 2
#: No pair: ranks stay below; and the room for a position in a packed rank.
NONE, POS = 1 << 17, 1 << 12

#: White space as the pattern's library sees it.
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: In Latin-1 texts the standard library's classes agree with the pattern's, but for these characters.
UNLIKE = bytes([*range(0x1C, 0x20), 0xB2, 0xB3, 0xB9, *range(0xBC, 0xBF)])
LATIN = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


Finish = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def cutter(pattern: str):
    """A function from a text to the pattern's matches."""
    import public_tokenizers

    whole = regex.compile(pattern.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]"))
    if pattern != public_tokenizers.PATTERN:
        return whole.findall
    return lambda text: (LATIN if is_latin(text) else whole).findall(text)


def is_latin(text: str) -> bool:
    """Whether ``LATIN`` matches the text as the pattern does."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not any(c in data for c in UNLIKE)


def literal_map(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """The rank map as two constant arrays (base, table).

    The pair of left rank a and right rank b stands at ``table[base[a] + b]`` as
    ``a << 17 | rank``; rows of the sparse pair matrix are laid over each other
    where they do not collide. Free places hold a number that fits no pair.
    """
    rows: dict[int, dict[int, int]] = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                rows.setdefault(left, {})[right] = rank
    n = max(ranks.values()) + 1
    size = 8 * n + 8 * sum(map(len, rows.values()))
    taken = np.zeros(size, bool)
    base, table = np.full(n, size), np.full(size, 1 << 40)
    places, at_most = np.random.default_rng(0), 0
    for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        cols = np.fromiter(row, np.int64)
        tries = 4096 // min(len(cols), 512)
        while True:
            spots = places.integers(0, 3 * n + 3 * len(rows), tries) if len(cols) <= 200 else at_most + np.arange(tries)
            fits = ~taken[spots[:, None] + cols].any(axis=1)
            if fits.any():
                break
            at_most += tries
        at = int(spots[fits.argmax()])
        taken[cols + at] = True
        base[left] = at
        table[cols + at] = (left << 17) | np.fromiter(row.values(), np.int64)
    used = int(np.flatnonzero(taken)[-1]) + 1
    base[base == size] = used + n
    return base.tolist(), table[:used].tolist()


def _literal(values: list[int]) -> Column:
    """A constant array; the optimiser folds it into a literal."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def fold_word(word: Column, byte_rank: Column, base: Column, table: Column) -> Column:
    """Ids of one word given as an array of its bytes: merge the pair of lowest rank until none merges."""

    def merge(ids: Column, _: Column) -> Column:
        firsts = F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))
        # the owner's bits cancel where the pair is in the map; else the number stays above NONE
        ranked = F.transform(firsts, lambda a, i: F.get(table, F.get(base, a) + F.get(ids, i + 1)).bitwiseXOR(F.shiftleft(a, 17)) * POS + i)
        best = F.coalesce(F.array_min(ranked), F.lit(NONE * POS).cast("long"))

        def put(b: Column) -> Column:
            at = b.bitwiseAND(F.lit(POS - 1)).cast("int")
            return F.when(b >= NONE * POS, ids).otherwise(F.concat(F.slice(ids, 1, at), F.array(F.shiftright(b, 12)), F.slice(ids, at + 3, F.size(ids))))

        return F.get(F.transform(F.array(best), put), 0)

    start = F.transform(word, lambda b: F.get(byte_rank, b))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(word) - 1, F.lit(1))), start, merge)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: the same merges by a heap, lowest rank first, leftmost first."""
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def rank(i: int) -> int | None:
        j = end[i]
        return ranks.get(word[i : end[j]]) if j < n else None

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue  # one half has been merged meanwhile
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, end[end[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class _Codes(dict):
    """Numbers words in the order in which they are met, as four bytes."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> bytes:
        self[word] = code = len(self).to_bytes(4, "little")
        self.fresh.append(word)
        return code


STEP_SCHEMA = "kind int, doc_id long, codes binary, words array<array<bigint>>"
#: Kinds of rows: words to fold, words already merged, a document, a new dictionary.
FOLD, MERGED, DOC, RESET = range(4)


def _step(kinds: list[int], doc_ids: list, codes: list[bytes | None], words: pa.Array | None = None) -> pa.RecordBatch:
    words = pa.nulls(len(kinds), pa.list_(pa.list_(pa.int64()))) if words is None else words
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(codes, pa.binary()), words], names=["kind", "doc_id", "codes", "words"])


def _one_list(lists: list) -> pa.Array:
    """A list column of one row that holds these byte strings or lists of numbers."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    flat = np.frombuffer(b"".join(lists), np.uint8).astype(np.int64) if isinstance(lists[0], bytes) else np.concatenate([np.asarray(x, np.int64) for x in lists])
    return pa.ListArray.from_arrays(pa.array([0, len(lists)], pa.int32()), pa.ListArray.from_arrays(ends, flat))


def _cut(pattern: str, ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, codes, ranks = cutter(pattern), _Codes(), None
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_PER_STEP):
                if len(codes) > DICT_WORDS:
                    codes = _Codes()
                    yield _step([RESET], [None], [None])
                start = len(codes)
                texts = batch["text"].slice(at, DOCS_PER_STEP).to_pylist()
                rows = [b"".join(map(codes.__getitem__, cut(x))) for x in texts]
                fresh, codes.fresh = [w.encode("utf-8", "replace") for w in codes.fresh], []
                numbered = list(enumerate(fresh, start))
                for kind, some in ((FOLD, [x for x in numbered if len(x[1]) <= FOLD_BYTES]), (MERGED, [x for x in numbered if len(x[1]) > FOLD_BYTES])):
                    if kind == MERGED and some:
                        ranks = ranks or load_ranks(ranks_path)
                        some = [(c, merge_long(w, ranks)) for c, w in some]
                    for i in range(0, len(some), WORDS_PER_ROW):
                        part = some[i : i + WORDS_PER_ROW]
                        yield _step([kind], [None], [np.array([c for c, _ in part], np.uint32).tobytes()], _one_list([w for _, w in part]))
                yield _step([DOC] * len(rows), batch["doc_id"].slice(at, DOCS_PER_STEP).to_pylist(), rows)

    return run


class _Dictionary:
    """Ids of numbered words in one growing array."""

    def __init__(self):
        self.starts, self.lengths, self.flat, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32), 0

    def add(self, codes: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(codes) and codes.max() >= len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[codes], self.lengths[codes] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used += len(ids)

    def ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all codes in a row, and how many each has."""
        lengths = self.lengths[codes]
        shift = self.starts[codes] - (np.cumsum(lengths) - lengths)
        return self.flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))], lengths


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Dictionary()
    for batch in batches:
        kinds = batch["kind"].to_numpy()
        edges = np.flatnonzero(np.diff(kinds)) + 1
        for low, high in zip([0, *edges], [*edges, len(kinds)]):
            part = batch.slice(low, high - low)
            if kinds[low] == RESET:
                known = _Dictionary()
            elif kinds[low] == DOC:
                for at in range(0, high - low, DOCS_PER_STEP):
                    docs = part.slice(at, DOCS_PER_STEP)
                    per_doc = [np.frombuffer(x, np.uint32) for x in docs["codes"].to_pylist()]
                    ids, lengths = known.ids(np.concatenate(per_doc))
                    ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum([len(x) for x in per_doc])])]
                    yield pa.RecordBatch.from_arrays([docs["doc_id"], pa.ListArray.from_arrays(ends.astype(np.int32), ids)], names=["doc_id", "ids"])
            else:
                for codes, words in zip(part["codes"].to_pylist(), part["words"]):
                    lists = words.values
                    known.add(np.frombuffer(codes, np.uint32), lists.value_lengths().to_numpy(), lists.flatten().to_numpy(zero_copy_only=False))


def _shared(docs: DataFrame) -> DataFrame:
    """The rows in fewer tasks, without a shuffle: a word is merged once a task, and distinct words grow slower than texts."""
    n, cores = docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism
    return docs.coalesce(max(1, -(-n // SHARED), min(n, TASKS_PER_CORE * cores)))


def encode(docs: DataFrame, ranks_path: str, pattern: str, then: Finish = None, schema: str = "doc_id long, ids array<int>") -> DataFrame:
    """doc_id, ids (array of int) of every whole text, by the ranks of ``ranks_path``.

    ``then`` may turn batches of these columns into batches of ``schema`` in the same worker.

    Each match of ``pattern`` is merged separately, with no special tokens.
    Null and empty texts have no ids; each input row gives one row (repeated
    rows repeat); other columns are not read.
    """
    ranks = load_ranks(ranks_path)
    base, table = map(_literal, literal_map(ranks))
    byte_rank = _literal([ranks[bytes([b])] for b in range(256)])
    steps = _shared(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))).mapInArrow(_cut(pattern, ranks_path), STEP_SCHEMA)
    folded = F.when(F.col("kind") == FOLD, F.transform("words", lambda w: fold_word(w, byte_rank, base, table))).otherwise(F.col("words"))
    finish = _assemble if then is None else lambda batches: then(_assemble(batches))
    return steps.withColumn("words", folded).mapInArrow(finish, schema)


def decode_lists(ids: pa.Array, pieces: pa.Array) -> list[bytes]:
    """The bytes of each list of ids: binary pieces one after the other."""
    flat = pieces.take(ids.flatten())
    data = flat.buffers()[2]
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    cuts = ends[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])]
    view = memoryview(data) if data is not None else memoryview(b"")
    return [bytes(view[a:b]) for a, b in zip(cuts, cuts[1:])]


def piece_table(ranks_path: str) -> pa.Array:
    """The binary piece of each id."""
    ranks = load_ranks(ranks_path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pa.array(pieces, pa.large_binary())


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, data (binary) of encoded documents; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(ranks_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(decode_lists(batch["ids"], pieces), pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip_digests(ranks_path: str):
    """A function that decodes batches of (doc_id, ids) and reports the rows of ``DIGESTS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(ranks_path)
        for batch in batches:
            ids = batch["ids"]
            names = pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pc.list_value_length(ids).cast(pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in pc.binary_join(names, ",").to_pylist()]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decode_lists(ids, pieces)]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def op1_bpe(docs: DataFrame) -> DataFrame:
    """Encode every document with the multilingual ranks, decode it again and report digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode(docs, path, public_tokenizers.PATTERN, round_trip_digests(path), DIGESTS)
