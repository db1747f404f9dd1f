"""Lexical search, conversation repair and the quality classifier against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import conversation_repair as repair
from lectern.llm import lexical_search as lexical
from lectern.llm import quality_classifier as quality

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def ranked(docs, items, k):
    """All scores by the formula, in plain Python; row keys stand for ids."""
    terms = [TERM.findall(lowered(t)) for _, t in docs]
    n_docs, total = sum(bool(t) for t in terms), sum(map(len, terms))
    df = {w: sum(w in t for t in terms) for w in {w for t in terms for w in t}}
    out = []
    for item_id, text in items:
        scores = []
        for (doc_id, _), t in zip(docs, terms):
            m = 75 + (25 * len(t) * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * t.count(w)) // (1000 * t.count(w) + 12 * m)) for w in TERM.findall(lowered(text)) if w in t)
            if score > 0:
                scores.append((-score, doc_id))
        scores.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0))
        out += [(item_id, rank + 1, doc_id, -score) for rank, (score, doc_id) in enumerate(scores[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k,block,head,look", [(20, 200_000, 256, 128), (3, 5, 1, 1), (2, 40, 3, 4)])
def test_lexical_search(spark, k, block, head, look):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["ÉTÉ", "été", "x_y", "A1", "a1", "日本"]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(1, 60))) for _ in range(80)]
    docs = [*enumerate(texts), (90, texts[3]), (91, None), (92, ""), (93, "…!?"), (94, "w7 " * 3000), (95, texts[5].upper()), (None, texts[6])]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)] + [(20, None), (21, "unknown"), (22, "w1 w1 w1"), (None, "w2 w3")]
    d = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in docs], "doc_id long, text string, term int, doc int, item int, v int, rank int").repartition(5)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, id int").repartition(2)
    got = [tuple(r) for r in lexical.search(d, q, k, block=block, head=head, look=look).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == ranked(docs, items, k)
    assert lexical.search(d.where("false"), q).count() == 0
    assert lexical.search(d, q.where("false")).count() == 0


def test_lexical_search_products_in_steps(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PRODUCTS", 3)
    docs = [(i, f"a b{i % 3} c{i % 5} d") for i in range(30)]
    items = [(0, "a b1 c2"), (1, "b2 d d"), (2, "c1")]
    asked = lexical.Asked.of([{"item": i, "term": t, "qtf": 1, "most": 0, "limit": 0, "floor": 0} for i in range(3) for t in range(4)])
    doc, term = np.repeat(np.arange(6), 2), np.tile([1, 3], 6)
    parts = list(asked.steps(doc, term))
    assert [p.start for p in parts] == list(range(0, 12, 2)) and parts[-1].stop == 12
    frame = lambda rows, c: spark.createDataFrame(rows, f"{c} long, text string")
    got = [tuple(r) for r in lexical.search(frame(docs, "doc_id"), frame(items, "item_id"), 4).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == ranked(docs, items, 4)


def test_terms_in_pieces():
    text = ("Aé_b 12-x " * 50 + "日本語" * 40).encode()
    assert lexical.terms_of(text, 7) == lexical.terms_of(text)


# --- conversations


def cheapest(rows):
    """All edits of a few (role, text, fault), tried one by one."""
    inserts = ["", "u", "a", "uu", "ua", "au", "aa"]
    said = {"u": "user", "a": "assistant"}
    best = None
    options = []
    for role, text, fault in rows:
        own = [("D", 4, None)]
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            own += [("K", more, (role, text)), ("R", 3 + more, ("user", text)), ("R", 3 + more, ("assistant", text))]
        options.append(own)
    for edits in itertools.product(*options):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            audit, cost, left = "", 0, []
            for (letter, price, turn), gap in zip(edits, gaps):
                audit, cost = audit + "I" * len(gap) + letter, cost + 3 * len(gap) + price
                left += [(said[g], "") for g in gap] + ([turn] if turn else [])
            audit, cost = audit + "I" * len(gaps[-1]), cost + 3 * len(gaps[-1])
            left += [(said[g], "") for g in gaps[-1]]
            if (best is None or (cost, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in left)):
                best = cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
    return best


def test_repair_is_the_cheapest():
    rng = random.Random(1)
    for _ in range(25):
        rows = [(rng.choice(["system", "user", "assistant", "tool", "unknown", ""]), rng.choice(["a.", "b", ""]), rng.choice([None, None, "truncated", "duplicate", "blank"])) for _ in range(rng.randint(0, 3))]
        own = repair.Repair()
        for row in rows:
            own.add(*row)
        assert own.result() == cheapest(rows), rows


def plain(rows, conv):
    """One conversation by the contract, from raw (turn, role, text)."""
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, own, faults, last, illegal = set(), repair.Repair(), [], None, 0
    for turn, role, text in out:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        illegal += last is not None and last + role[:1] not in ("su", "ua", "au")
        last = role[:1]
        faults.append(fault)
        own.add(role, text, fault)
    turns = [t for t, *_ in out if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, *(faults.count(f) for f in repair.FAULTS), illegal, *own.result())


def test_conversation_repair(spark):
    rng = random.Random(2)
    rows = []
    for conv in [*range(60), None]:
        turns = rng.sample(range(-3, 40), rng.randint(1, 12)) if conv != 7 else [None, None, 4]
        rows += [(conv, t, rng.choice(["system", "user", "assistant", "user", None, "tool"]), rng.choice(["Ja. ", "no\t", "", None, "wörd!", "one\ntwo"])) for t in turns]
        rows += rows[-2:] if conv == 9 else []
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"turn {t}." + "x" * 3000) for t in range(3000)]  # a long one
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "conv_id long, turn long, role string, text string, fault string, audit int").repartition(6)
    got = {r["conv_id"]: tuple(r) for r in repair.op12_conversation_repair(df).collect()}
    convs = dict.fromkeys(r[0] for r in rows)
    assert set(got) == set(convs)
    for conv in convs:
        assert got[conv] == plain([r[1:] for r in rows if r[0] == conv], conv)
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    only = repair.op12_conversation_repair(spark.createDataFrame([(lost, 0, "user", "x")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in only] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.op12_conversation_repair(df.where("false")).count() == 0


# --- quality


def test_quality_learns_from_its_own_rows_only(spark):
    rng = random.Random(4)
    good = lambda: ". ".join("The " + " ".join(rng.choices("of river and stone in the old town by night".split(), k=12)) for _ in range(6)) + "."
    bad = lambda: " | ".join(w + "$$$" for w in rng.choices("buy now free click win".split(), k=60))
    rows = [(i, bad() if i % 4 == 0 else good(), "x", 0.5) for i in range(200)] + [(500, None, "x", 0.5), (501, "", "x", 0.5), (501, "", "x", 0.5), (None, good(), "x", 0.5), (502, good() * 400, "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stats string, score double").repartition(4)
    truth = [(i, int(i % 4 != 0)) for i in range(200)]
    label = lambda flip: spark.createDataFrame([(i, 1 - q if flip and zlib.crc32(str(i).encode()) % 3 == 1 else q, 1) for i, q in truth] + [(7, 1, 1), (8, None, 1), (None, 0, 1)], "doc_id long, quality int, score int")
    got = quality.op13_quality_classifier(docs, label(False)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    for i, q in truth:
        assert by_id[i]["predicted"] == q and by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert by_id[500]["score"] == by_id[501]["score"] and by_id[502]["predicted"] == 1
    flipped = {r["doc_id"]: r["score"] for r in quality.op13_quality_classifier(docs, label(True)).collect()}
    assert all(abs(flipped[i] - r["score"]) < 1e-9 for i, r in by_id.items())
    none = quality.op13_quality_classifier(docs, label(False).where("quality = 1")).collect()
    assert {r["score"] for r in none} == {0.5} and quality.op13_quality_classifier(docs.where("false"), label(False)).count() == 0


def test_discriminant_is_the_density_ratio(spark):
    rng = np.random.default_rng(0)
    width = len(quality.STATISTICS)
    x = [rng.normal(k, 1 + k, (60, width)) for k in (0, 1)]
    moments = {k: (60.0, x[k].sum(axis=0), x[k].T @ x[k]) for k in (0, 1)}
    model = quality.discriminant(moments, np.zeros(width), np.ones(width))
    covs = [np.cov(a.T) for a in x]
    both = sum(covs) / 2
    z, dense = np.clip(rng.normal(0, 2, (5, width)), -quality.BOUND, quality.BOUND), []
    for k in (0, 1):
        cov = (1 - quality.POOLED) * covs[k] + quality.POOLED * both
        cov = (1 - quality.RIDGE) * cov + (quality.RIDGE * np.trace(cov) / width + 1e-6) * np.eye(width)
        gap = z - x[k].mean(axis=0)
        dense.append(-0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.log_odds(z), dense[1] - dense[0])


def test_statistics_in_pieces(monkeypatch):
    text = "The old town. | of*** the river\n" * 40 + "été " * 30
    whole = quality.statistics_of(text)
    monkeypatch.setattr(quality, "_pieces", lambda data, pieces=quality._pieces: pieces(data, 11))
    assert quality.statistics_of(text) == whole and all(map(math.isfinite, quality.statistics_of("")))


def test_quality_on_held_out_rows(spark):
    from lectern.session import load

    sf = "/root/testdata/sf0.01"
    scored = quality.op13_quality_classifier(load(spark, sf, "documents"), load(spark, sf, "labels")).where("held_out")
    rows = scored.join(load(spark, sf, "labels"), "doc_id").where(F.col("quality").isNotNull()).collect()
    junk, fine = [r["score"] for r in rows if r["quality"] == 0], [r["score"] for r in rows if r["quality"] == 1]
    assert np.mean([f > j for f in fine for j in junk]) > 0.98
    assert np.mean([s < 0.5 for s in junk]) > 0.9 and np.mean([s >= 0.5 for s in fine]) > 0.97
