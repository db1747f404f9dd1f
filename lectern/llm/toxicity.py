"""Toxicity by weak supervision.

Voters are words of a fixed lexicon, and words and word beginnings mined from
labelled rows. A generative label model estimates, by expectation and
maximisation, how often each voter fires on toxic and on clean documents, and
which voters fire together beyond what the label explains (those share one
vote). A logistic classifier is trained on its posterior labels and scores the
whole text of every document.

Fitting reads a bounded sample of rows (``max_rows`` of each kind, chosen by a
hash of ``doc_id``); scoring reads everything. Held-out rows
(crc32(doc_id as text) mod 5 = 0) take no part in fitting: neither their labels
nor their texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import settle, text_of

#: Insults in the languages of the documents.
LEXICON = ("idiot idiots moron morons stupid loser losers scum trash clown pathetic worthless disgusting dumb imbecile "
           "idiota estúpido estúpida imbécil basura asqueroso inútil idiote stupide crétin ordure minable "
           "dumm idiotisch trottel abschaum wertlos ekelhaft versager").split()  # fmt: skip
WORD = re.compile(r"\w+")
BEGINNINGS = (4, 5, 6, 7)
MAX_ROWS, MAX_FEATURES = 12_000, 384


def held_out(doc_id: Column) -> Column:
    """Whether a row's label must not be learned from; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features_of(text: str) -> Counter:
    """All features of a text with their counts: words (``w:``) and beginnings of words (``p:``)."""
    out: Counter = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        out["w:" + word] += n
        for size in BEGINNINGS:
            if len(word) > size:
                out["p:" + word[:size]] += n
    return out


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
            (toxic if label else clean).update(features_of(text).keys())
    # all counts leave the task, as a feature of clean rows here may be one of toxic rows elsewhere
    names = sorted(toxic.keys() | clean.keys())
    for at in range(0, len(names), 10_000):
        part = names[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[x] for x in part]), pa.array([clean[x] for x in part])], names=["feature", "pos", "neg"])


def mine_voters(sample: DataFrame, limit: int = MAX_FEATURES) -> list[str]:
    """Features that tell toxic rows from clean ones, best first.

    A feature counts only if chance would hardly give any of all features its share of toxic rows: by Chernoff's
    bound, its rows times the divergence of that share from the share of all rows exceed the log of the features' number.
    """
    labelled = sample.where(F.col("toxic").isNotNull())
    sizes = labelled.agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("n")).first()
    if not sizes["p"] or not sizes["n"]:
        return []
    counts = labelled.select("text", "toxic").mapInArrow(_mine, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    base = sizes["p"] / (sizes["p"] + sizes["n"])
    seen = F.col("pos") + F.col("neg")
    share = (F.col("pos") + 1e-9) / (seen + 2e-9)
    surprise = seen * (share * F.log(share / base) + (1 - share) * F.log((1 - share) / (1 - base)))
    odds = F.log((F.col("pos") + 0.1) / (sizes["p"] + 0.2)) - F.log((F.col("neg") + 0.1) / (sizes["n"] + 0.2))
    counts = settle(counts)
    good = counts.where((odds > 2.0) & (surprise > math.log(counts.count() + 1)))
    return [r["feature"] for r in good.orderBy(F.desc(odds * F.sqrt("pos")), "feature").limit(limit).collect()]  # limit rows


class Voters:
    """Counts voters' hits in a text."""

    def __init__(self, features: list[str]):
        self.features = list(dict.fromkeys([*("w:" + w for w in LEXICON), *features]))
        self.at = {f: i for i, f in enumerate(self.features)}
        self.words = {f[2:]: i for f, i in self.at.items() if f[0] == "w"}
        self.starts = {f[2:]: i for f, i in self.at.items() if f[0] == "p"}
        self.heads = {f[2:6] for f in self.features}

    def hits(self, text: str) -> tuple[int, dict[int, int]]:
        """The number of words of a text, and how often each voter that fires does."""
        out: dict[int, int] = {}
        words = Counter(WORD.findall(text.lower()))
        for word, n in words.items():
            if word[:4] in self.heads:
                if (i := self.words.get(word)) is not None:
                    out[i] = out.get(i, 0) + n
                for size in BEGINNINGS:
                    if len(word) > size and (i := self.starts.get(word[:size])) is not None:
                        out[i] = out.get(i, 0) + n
        return words.total(), out


@dataclass
class LabelModel:
    """Fire rates of voters given the label, their shared-vote weights and the share of toxic rows."""

    on_toxic: np.ndarray
    on_clean: np.ndarray
    weight: np.ndarray
    prior: float

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        yes = np.log(self.on_toxic / self.on_clean) * self.weight
        no = np.log((1 - self.on_toxic) / (1 - self.on_clean)) * self.weight
        return np.log(self.prior / (1 - self.prior)) + votes @ yes + (1 - votes) @ no


@dataclass
class Hits:
    """The sampled rows' votes, sparse: label (1, 0, nan where unknown), words, and the voters hit, with counts."""

    labels: np.ndarray
    words: np.ndarray
    sizes: np.ndarray
    at: np.ndarray
    counts: np.ndarray
    width: int

    def blocks(self, rows: int = 1024) -> Iterator[tuple[slice, np.ndarray]]:
        """Dense counts of a few rows at a time: the whole matrix is never held."""
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        for i in range(0, len(self.labels), rows):
            j = min(i + rows, len(self.labels))
            out, here = np.zeros((j - i, self.width)), slice(ends[i], ends[j])
            out[np.repeat(np.arange(j - i), self.sizes[i:j]), self.at[here]] = self.counts[here]
            yield slice(i, j), out


def fit_label_model(hits: Hits, rounds: int = 8, smooth: float = 0.5) -> tuple[LabelModel, np.ndarray]:
    """The label model and posterior labels of all sampled rows.

    A known label counts as one more voter, right with probability 0.998. The first
    round learns from known labels alone; without any, a row with a vote starts as likely toxic.
    """
    labels, known = hits.labels, ~np.isnan(hits.labels)
    blank = 0.0 if known.any() else np.where(hits.sizes > 0, 0.9, 0.02)
    post = np.where(known, labels, blank)
    held = known.astype(float) if known.any() else np.ones(len(labels))
    said = np.where(known, np.where(labels == 1, np.log(499.0), -np.log(499.0)), 0.0)
    model = None
    for _ in range(rounds):
        n1, n0 = (post * held).sum(), ((1 - post) * held).sum()
        fired1, fired0, both = np.zeros(hits.width), np.zeros(hits.width), np.zeros((hits.width, hits.width))
        for here, counts in hits.blocks():
            votes = (counts > 0).astype(float)
            fired1 += (post * held)[here] @ votes
            fired0 += ((1 - post) * held)[here] @ votes
            both += (votes * (post * held)[here, None]).T @ votes
        on_toxic = (fired1 + smooth) / (n1 + 2 * smooth + 1)
        on_clean = (fired0 + smooth / 10) / (n0 + 1)
        # correlation given the label: co-firing beyond what the rates explain
        spread = np.sqrt(on_toxic * (1 - on_toxic))
        tied = (both / max(n1, 1.0) - np.outer(on_toxic, on_toxic)) / np.maximum(np.outer(spread, spread), 1e-9)
        np.fill_diagonal(tied, 1.0)
        weight = 1.0 / np.maximum(np.where(tied > 0.3, tied, 0.0).sum(axis=1), 1.0)
        prior = float(np.clip(n1 / (n1 + n0), 0.005, 0.5))
        model = LabelModel(np.clip(on_toxic, 1e-5, 1 - 1e-5), np.clip(on_clean, 1e-6, 1 - 1e-6), weight, prior)
        odds = np.concatenate([model.log_odds((counts > 0).astype(float)) for _, counts in hits.blocks()])
        post, held = 1 / (1 + np.exp(-np.clip(odds + said, -30, 30))), np.ones(len(labels))
    return model, post


#: Inputs beside the counts of each voter.
SUMS = 5


def _inputs(counts: np.ndarray, words: np.ndarray, yes: np.ndarray, lexicon: int) -> np.ndarray:
    """A classifier's inputs: damped counts per voter, sums over all voters, and votes by length of the text."""
    damped = np.log1p(counts)
    per_word = (counts @ yes) / np.maximum(words, 1)
    sums = [np.minimum(damped @ yes, 40.0) / 10, (counts > 0).any(axis=1).astype(float), np.log1p(counts[:, :lexicon].sum(axis=1)), np.log1p(100 * per_word), np.log1p(100 * per_word) ** 2 / 5]
    return np.concatenate([damped, np.stack(sums, axis=1)], axis=1)


def fit_logistic(hits: Hits, yes: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by Newton steps."""
    width = hits.width + SUMS + 1
    w, ridge = np.zeros(width), np.full(width, l2)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        gradient, hessian = ridge * w, np.diag(ridge)
        for here, counts in hits.blocks():
            x = np.concatenate([_inputs(counts, hits.words[here], yes, len(LEXICON)), np.ones((len(counts), 1))], axis=1)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient += x.T @ (p - y[here])
            hessian += (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def calibrate(hits: Hits, yes: np.ndarray, weights: np.ndarray, bias: float, rounds: int = 50) -> tuple[np.ndarray, float]:
    """The weights and bias, scaled and shifted so that scores fit the known labels: posterior labels of unmarked rows
    pull them towards the rows' prior. Needs known rows of both labels, else nothing changes."""
    known = ~np.isnan(hits.labels)
    y = hits.labels[known]
    if not known.any() or y.min() == y.max():
        return weights, bias
    z = np.concatenate([_inputs(counts, hits.words[here], yes, len(LEXICON)) @ weights for here, counts in hits.blocks()])[known] + bias
    x, w = np.stack([z, np.ones(len(z))], axis=1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        # a prior of one part in a thousand holds separable rows at finite weights
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - y) + 1e-3 * (w - [1.0, 0.0]))
        w -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return (weights * w[0], bias * w[0] + w[1]) if w[0] > 0 else (weights, bias)


@dataclass
class Classifier:
    """Everything that scoring needs; its size is bounded by the number of voters."""

    features: list[str]
    yes: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, voters: Voters, texts: list[str]) -> np.ndarray:
        counts, words = np.zeros((len(texts), len(self.features))), np.zeros(len(texts))
        for row, text in enumerate(texts):
            words[row], found = voters.hits(text)
            for i, n in found.items():
                counts[row, i] = n
        z = _inputs(counts, words, self.yes, len(LEXICON)) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _share(n: int, most: int) -> int:
    return 1_000_000 if n <= most else most * 1_000_000 // n


def sample_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most about ``max_rows`` toxic, clean and unlabelled rows each: text, toxic (null: unlabelled)."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("n")).first()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000))
    chosen = known.where(draw < F.when(F.col("toxic") == 1, _share(n["p"], max_rows)).otherwise(_share(n["n"], max_rows)))
    rest = _share(docs.count(), max_rows)
    picked = docs.select("doc_id", text_of("text").alias("text"))
    labelled = picked.join(F.broadcast(chosen), "doc_id")  # about 2 * max_rows ids and flags
    marked = known.where(draw < rest).select("doc_id")  # about max_rows ids
    plain = picked.where(~held_out(F.col("doc_id")) & (draw < rest)).join(marked, "doc_id", "left_anti").withColumn("toxic", F.lit(None).cast("int"))
    return labelled.select("text", F.col("toxic").cast("int").alias("toxic")).unionByName(plain.select("text", "toxic"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Classifier:
    """Mine voters, fit the label model, train the classifier on its posterior labels and calibrate it on known ones.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic (null: not
    labelled). Held-out rows take no part, labelled or not. Labels that repeat
    a doc_id count as toxic if one of them is. Null ids have no label; null texts are
    empty. Without labels, or without documents, the lexicon alone votes.
    """
    sample = settle(sample_rows(docs, labels, max_rows))
    voters = Voters(mine_voters(sample))
    names, m = voters.features, len(voters.features)

    def votes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Voters(names)
        for batch in batches:
            found = [own.hits(x) for x in batch["text"].to_pylist()]
            words, hits = np.array([n for n, _ in found], np.int32), [h for _, h in found]
            flat = lambda lists, kind: np.fromiter((x for one in lists for x in one), kind).tobytes()
            parts = [np.array([np.nan if x is None else x for x in batch["toxic"].to_pylist()], np.float32).tobytes(), words.tobytes(), np.array([len(h) for h in hits], np.int32).tobytes(), flat(hits, np.int32), flat((h.values() for h in hits), np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names=["labels", "words", "sizes", "at", "counts"])

    packed = sample.mapInArrow(votes_of, "labels binary, words binary, sizes binary, at binary, counts binary").collect()  # a row a batch: about 3 * max_rows texts' hits
    joined = {c: np.frombuffer(b"".join(r[c] for r in packed), np.float32 if c == "labels" else np.int32) for c in ("labels", "words", "sizes", "at", "counts")}
    hits = Hits(joined["labels"].astype(float), joined["words"].astype(float), joined["sizes"], joined["at"], joined["counts"], m)
    if not len(hits.labels):
        return Classifier(names, np.ones(m), np.concatenate([np.ones(m), np.zeros(SUMS)]), -2.0)
    model, post = fit_label_model(hits)
    yes = np.maximum(np.log(model.on_toxic / model.on_clean) * model.weight, 0.0)
    weights, bias = fit_logistic(hits, yes, post)
    return Classifier(names, yes, *calibrate(hits, yes, weights, bias))


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Every whole text is scored, null as empty; repeated rows score alike, and an
    empty table gives an empty one. Columns of these two names are replaced.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*names)
    schema = docs.select(*names).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(model.features)
        for batch in batches:
            scores = model.scores(voters, [x or "" for x in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*names, "score"])

    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; nulls, repeats and empty tables as in ``fit`` and ``score``."""
    docs = docs.select("doc_id", "text")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
