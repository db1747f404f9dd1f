"""The pipeline's stages against plain versions, with nulls, repeats, empty tables and extra columns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import jaccard_join, line_dedup, substring_dedup, topk_search, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, sig string, kept_text string"
LINE = "A line of page furniture that many documents share, word for word."


def rows_of(texts: list[tuple]) -> list[tuple]:
    return [(i, t, "en", "s", len(t or ""), 1, "x", "y") for i, t in texts]


def words_of(text) -> list[str]:
    return (text or "").split()


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(900)]
    draw = lambda n: list(rng.choice(vocabulary, n))
    passage, base = draw(60), draw(150)
    out = [" ".join(draw(80)) for _ in range(30)]
    out += [" ".join(draw(40) + passage + draw(40)) for _ in range(6)]
    for _ in range(8):
        near = list(base)
        near[int(rng.integers(0, 150))] = "other"
        out.append(" ".join(near))
    out += [f"{a}\n{LINE}\n{b}" for a, b in zip(out[:7], out[7:14])]
    out += [None, "", " \t", out[3], out[3]]
    return list(enumerate(out)) + [(3, out[3]), (None, out[40]), (None, None), (5, "another text of an id that is there")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


def told(frame) -> list[tuple]:
    assert frame.columns == corpus_pipeline.COLUMNS
    rows = frame.collect()
    assert all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in rows)
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=str)


def test_lines(spark, docs, texts):
    found: dict = {}
    for i, t in texts:
        for line in set((t or "").split("\n")):
            if len(line.strip()) >= 40 and i is not None:
                found.setdefault(line.strip().lower(), set()).add(i)
    keeper = {k: max(ids) for k, ids in found.items() if len(ids) >= 5}
    assert list(keeper) == [LINE.lower()]
    plain = [(i, "\n".join(x for x in (t or "").split("\n") if keeper.get(x.strip().lower(), i) == i)) for i, t in texts]
    assert told(corpus_pipeline.drop_lines(spark, docs, "")) == sorted(plain, key=str)


def test_near_duplicates(spark, docs, texts):
    sets = [frozenset(tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))) if (w := words_of(t)) else None for _, t in texts]
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) / len(a | b) >= 0.8:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    kept, stay = set(), []
    for at in sorted(range(len(texts)), key=lambda k: (texts[k][0] is None, texts[k][0] or 0)):
        if sets[at] is None or group[at] not in kept:
            kept.add(group[at])
            stay.append((texts[at][0], texts[at][1] or ""))
    assert len(stay) < len(texts) - 10
    assert told(corpus_pipeline.drop_near_duplicates(spark, docs, "")) == sorted(stay, key=str)


def cut(texts: list[tuple], size: int = 20) -> list[tuple]:
    """Words left of each text; whole repeats are one document."""
    order = sorted(set(texts), key=lambda x: (x[0] is not None, x[0] or 0))
    seen, left = set(), {}
    for one in order:
        w, gone = words_of(one[1]), set()
        for p in range(len(w) - size + 1):
            if (window := tuple(w[p : p + size])) in seen:
                gone.update(range(p, p + size))
            seen.add(window)
        left[one] = " ".join(x for p, x in enumerate(w) if p not in gone)
    return [(i, left[i, t]) for i, t in texts]


@pytest.mark.parametrize("group", [substring_dedup.GROUP, 2])
def test_passages(spark, docs, texts, group, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    assert told(corpus_pipeline.drop_passages(spark, docs, "")) == sorted(cut(texts), key=str)


def test_toxicity(spark, tmp_path):
    rng = np.random.default_rng(3)
    clean = [f"c{i}" for i in range(300)]
    texts = [(i, " ".join([*rng.choice(clean, 30), *(["blargword", "zonkered"] if i % 4 == 0 else [])])) for i in range(500)] + [(None, None), (500, ""), (8, "c1")]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    sf = str(tmp_path)
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(500)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    plain = [(i, t or "") for i, t in texts if "blargword" not in (t or "")]
    assert told(corpus_pipeline.drop_toxic(spark, docs, sf)) == sorted(plain, key=str)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    assert toxicity.sample_rows(docs.where(held), labels).count() == 0
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    assert scored.columns.count("score") == 1 and scored.where("score < 0 or score > 1").count() == 0
    assert corpus_pipeline.drop_toxic(spark, docs.where("doc_id < 0"), sf).count() == 0


def test_empty_tables_and_the_whole_run(spark, docs, texts, tmp_path):
    sf, none = str(tmp_path), docs.where("doc_id < -5")
    for stage in (corpus_pipeline.drop_lines, corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_passages):
        assert stage(spark, none, sf).count() == 0
    assert corpus_pipeline.pack_sequences(spark, none, sf).count() == 0
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    steps = whole
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps = stage(spark, steps, sf)
    kept = {r["doc_id"]: r["text"] for r in steps.collect()}
    assert {r["doc_id"] for r in out} == set(kept)
    used: dict = {}
    for r in out:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 2048 and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "substring_dedup", "packing"]


def test_families_count_all_links(spark):
    """A family of more than one block, a common passage, and rows without an id."""
    rng = np.random.default_rng(2)
    vocabulary = np.array([f"v{i}" for i in range(3000)])
    base, passage, texts = list(rng.choice(vocabulary, 120)), list(rng.choice(vocabulary, 30)), []
    for _ in range(620):
        near = list(base)
        for _ in range(int(rng.integers(0, 5))):
            near[int(rng.integers(0, 120))] = f"x{rng.integers(0, 10**9)}"
        texts.append(" ".join(near))
    texts += [" ".join([*rng.choice(vocabulary, 60), *passage, *rng.choice(vocabulary, 20)]) for _ in range(200)]
    texts += [texts[0]] * 30
    sets = [frozenset(tuple(w[p : p + 5]) for p in range(len(w) - 4)) for w in map(words_of, texts)]
    ids: dict = {}
    held = np.zeros((len(sets), len({x for s in sets for x in s})), np.float32)
    for i, s in enumerate(sets):
        held[i, [ids.setdefault(x, len(ids)) for x in s]] = 1
    both, n = held @ held.T, held.sum(axis=1)
    near = both >= 0.8 * (n[:, None] + n[None, :] - both) - 1e-6
    np.fill_diagonal(near, False)
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(texts) and sum(r["n_links"] for r in got) == near.sum()
    assert all(r["n_links"] == near[r["doc_id"]].sum() for r in got if r["doc_id"] is not None)


def test_line_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, min_docs=2, fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(1, i, 1, 9 - i), (7, 7, 1, 9 - i), (3, 3, 2, 9 - i)], "h1 long, h2 long, n long, keeper long"))
    assert runs.compactions == 3 and [len(x) for x in runs.levels] == [1, 0, 1]
    assert [r.where("h1 = 3").count() for r in runs.runs()] == [0, 1]  # settled keys enter no later run
    with line_dedup._dealt_anew(spark):
        assert sorted(tuple(r) for r in runs.settled().collect()) == [(3, 3, 9), (7, 7, 9)]
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(runs.name)]


def test_searches_reach_few_bands(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 8)
    sent, plain = [], topk_search.units_of
    monkeypatch.setattr(topk_search, "units_of", lambda *a: sent.append((plain(*a).count(), len(a[2]), sum(a[3][b] for b in a[2]))) or plain(*a))
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(0, 1, 6) * rng.exponential(1) ** 3]) for i in range(1500)] + [(1501, [1e30, -1e30] + [0.0] * 4), (1502, [3e12] * 6)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in topk_search.op8_topk_search(frame).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = lambda x: int(np.floor(256 * x)) if abs(256 * x) < 2**53 else int(256 * x)
    exact, most = {i: [whole(x) for x in v] for i, v in vectors}, 2**63 - 1
    assert len(got) == 30
    for q, rows in got.items():
        best = sorted((-max(-most, min(most, sum(a * b for a, b in zip(exact[q], v)))), i) for i, v in exact.items() if i != q)[:5]
        assert sorted(rows) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    all_pairs = 4 * sum(blocks for _, _, blocks in sent)  # 30 queries in 4 blocks
    assert sum(n for n, _, _ in sent) < 0.7 * all_pairs
