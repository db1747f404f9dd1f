"""Matching-block ratio, shared grams and probes against plain versions."""

from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import grams, matching, similarity as sim
from lectern.plans.catalogue import QUERIES


def texts(n, seed=1, letters="abcd", longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randint(0, longest))) for _ in range(n)]


def test_longest_block_and_its_ties():
    assert matching.Automaton("xabcyabc").longest("zabcabc") == (1, 1, 3)
    assert matching.Automaton("abab").longest("bab") == (1, 0, 3)
    assert matching.Automaton("ab").longest("cd") == (0, 0, 0)
    assert matching.Automaton("").longest("cd") == matching.Automaton("a").longest("") == (0, 0, 0)
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choices("ab", k=rng.randint(1, 12))) for _ in range(2))
        n = max((k for k in range(len(a) + 1) if any(a[i : i + k] in b for i in range(len(a) - k + 1))))
        i = min((i for i in range(len(a)) if n and a[i : i + n] in b and len(a[i : i + n]) == n), default=0)
        assert matching.Automaton(a).longest(b) == (i, b.index(a[i : i + n]) if n else 0, n)


def test_blocks_are_those_of_the_rule():
    for a, b in zip(texts(400), texts(400, 3)):
        rule = difflib.SequenceMatcher(None, a, b, autojunk=False)
        assert matching.in_blocks(a, b) == sum(m.size for m in rule.get_matching_blocks())
    long_a, long_b = "abcdefghij" * 300, "abcdefghi" * 300
    assert matching.in_blocks(long_a, long_b) == sum(m.size for m in difflib.SequenceMatcher(None, long_a, long_b, autojunk=False).get_matching_blocks())


@pytest.mark.parametrize("least", [0.0, 0.5])
def test_block_ratio(spark, least):
    left, right = [*texts(60, 4, "abcdefg"), None, "", "same", "日本語"], [*texts(60, 5, "abcdefg"), "x", None, "same", "本日語"]
    rows = [(i, a, b, "old") for i, (a, b) in enumerate(zip(left, right))]
    df = spark.createDataFrame([*rows, rows[3], rows[3]], "i int, a string, b string, ratio string").repartition(3)
    want = []
    for i, a, b, _ in [*rows, rows[3], rows[3]]:
        ratio = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0
        want += [(i, ratio)] if ratio >= least else []
    got = sorted((r["i"], r["ratio"]) for r in matching.block_ratio(df, "a", "b", least=least).collect())
    assert [i for i, _ in got] == [i for i, _ in sorted(want)] and [x for _, x in got] == pytest.approx([x for _, x in sorted(want)])
    assert matching.block_ratio(df.where("false"), "a", "b").count() == 0


def bigrams(text, n=2):
    key = "".join(c for c in text or "" if c.isascii() and c.isalnum() or "㐀" <= c <= "鿿")
    return {key[i : i + n] for i in range(len(key) - n + 1)}


def test_all_pairs_of_many_near_copies(spark, monkeypatch):
    monkeypatch.setattr(grams, "ROWS", 7)
    monkeypatch.setattr(grams, "BLOCK_CHARS", 900)
    base = "The quick brown fox jumps over the lazy dog while seventeen birds watch"
    rows = [(i, f"{base} {i:03d} {'xyz'[i % 3] * 4}") for i in range(40)] + [(100, None), (101, ""), (102, "a"), (103, base), (103, base), (104, "问题答案在此 问题"), (105, "其中问题")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string").repartition(4)
    items = docs.withColumnRenamed("doc_id", "item_id")
    found = grams.shared_grams(items, docs, "item_id", "doc_id", grams.dice_at_least(0.8))
    got = sorted((r["item_id"], r["doc_id"], r["shared"], r["item_grams"], r["doc_grams"]) for r in found.collect())
    sets = [(i, bigrams(t)) for i, t in rows]
    want = sorted((i, j, len(a & b), len(a), len(b)) for i, a in sets for j, b in sets if a and b and 2 * len(a & b) >= 0.8 * (len(a) + len(b)))
    assert got == want and sum(i < j < 40 for i, j, *_ in got) == 780  # no link of the forty is lost
    held = {(r["item_id"], r["doc_id"]) for r in grams.shared_grams(items, docs, "item_id", "doc_id", grams.contained_at_least(0.9)).collect()}
    assert held == {(i, j) for i, a in sets for j, b in sets if a and len(a & b) >= 0.9 * len(a)}
    stop = {"th", "he", "问题"}
    near = {(r["item_id"], r["doc_id"]) for r in grams.shared_grams(items, docs, "item_id", "doc_id", grams.distinctive, sizes=(2, 3), window=9, stop=tuple(stop)).collect()}
    assert near == {(i, j) for i, a in rows for j, b in rows if len((bigrams((a or "")[:9]) & bigrams(b)) - stop) >= 2 or bigrams((a or "")[:9], 3) & bigrams(b, 3)}
    assert grams.shared_grams(items.where("false"), docs, "item_id", "doc_id", grams.distinctive, sizes=(2, 3)).count() == 0
    assert grams.shared_grams(items, docs.where("false"), "item_id", "doc_id", grams.dice_at_least(0.1)).count() == 0


def test_probes(spark):
    items = [(1, "Abcdefghijklm nopqrstuvwxyz"), (2, "abcdefghijkl"), (3, "short"), (4, None), (5, "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 more"), (5, "zzzzzzzzzzzzz")]
    docs = [(1, "x abcdefghijklmnopqrstuvwxyz0123456789 more"), (2, "abcdefghijk"), (3, "--abc def ghi jkl--"), (4, None), (5, "zzzzzzzzzzzzzzzzzzzz")]
    got = sim.probe(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), "item_id", "doc_id")
    flat = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    want = []
    for i, t in items:
        for j, d in docs:
            if len(p := flat(t)) >= 12 and (hits := [min(n, len(p)) for n in (32, 24, 18) if p[:n] in flat(d)]):
                want.append((i, j, max(hits)))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_scores_near_the_best_are_enough(spark, monkeypatch):
    monkeypatch.setattr(sim, "RIGHT_BLOCK", 16)
    left, right = [*texts(9, 6, "abc"), None, "", "a", "same"], [*texts(300, 7, "abc"), None, "", "a", "same", "日本", "日"]
    rows = lambda some, name: spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(some)], f"{name} long, text string, half int")
    items, docs = rows(left, "i"), rows(right, "j")
    grams_of = lambda t: [t[k : k + 2] for k in range(len(t) - 1)] or [t]
    pairs = {}
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            if a and b and (shared := sum(min(grams_of(a).count(g), grams_of(b).count(g)) for g in set(grams_of(a)))):
                pairs[i, j] = min(1.0, 2 * shared / max(1, len(a) + len(b) - 2))
    for block in (None, "half"):
        scored = lambda **kept: sim.dice_multiset(items, docs, "i", "j", "text", block=block, **kept).withColumn("score", F.round("score", 9))  # noqa: B023, E731
        want = {k: round(v, 9) for k, v in pairs.items() if block is None or (k[0] - k[1]) % 2 == 0}
        assert {(r["i"], r["j"]): r["score"] for r in scored().collect()} == pytest.approx(want)
        near = sim.accept(scored(best=1, near=sim.NEAR), "i", "j")
        assert sorted(near.collect()) == sorted(sim.accept(scored(), "i", "j").collect())
        # scores are made once, and no key before the rows are dealt over the tasks
        plan = near._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("MapInArrow") == plan.count("MapInArrow", plan.index("Window")) == (1 if block is None else 3)
        assert block or "regexp_replace" not in plan[plan.rindex("REPARTITION_BY_COL") :]
        first = lambda rows: sorted(rows.withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "j"))).where("n <= 5").collect())
        assert first(scored(best=5)) == first(scored()) and scored(best=5).count() < len(want)


def test_long_keys_in_pieces(monkeypatch):
    keys = [t for t in texts(60, 8, "ab", 40) if t] + ["a", "日", "abab" * 50]
    whole = [list(zip(j, i, s)) for j, i, s in sim.Pack(keys[::3]).scores(keys)]
    monkeypatch.setattr(sim, "CHARS", 5)
    assert [list(zip(j, i, s)) for j, i, s in sim.Pack(keys[::3]).scores(keys)] == whole
    assert all(sum(map(len, pieces)) <= 5 for _, pieces in sim._pieces(keys))


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Six documents alike in their first 900 characters; the last is the item's whole text."""
    rng, folder = random.Random(9), str(tmp_path_factory.mktemp("long"))
    head = "".join(rng.choices("abcdefghij", k=900))
    item = head + "".join(rng.choices("klmnopq", k=600))
    docs = [(i, head + "".join(rng.choices("rstuvwxyz0123", k=500 + i)), "src1") for i in range(1, 6)] + [(6, item, "src1")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_partners_within_tolerance_by_whole_texts(spark, long_texts):
    assert [tuple(r) for r in QUERIES["assign_with_tolerance"](spark, long_texts).select("item_id", "near", "first_doc").collect()] == [(1, 1, 6)]


def test_note_scores_of_whole_texts(spark, long_texts):
    item = spark.read.parquet(f"{long_texts}/benchmark.parquet").first()["text"]
    got = {r["doc_id"]: r["score"] for r in QUERIES["note_score"](spark, long_texts).collect()}
    assert set(got) == {1, 2, 3, 4, 6} and got[6] == 2.0  # the longest of the others is left out
    pairs = {item[i : i + 2] for i in range(len(item) - 1)}
    for r in spark.read.parquet(f"{long_texts}/documents.parquet").where("doc_id < 5").collect():
        ratio = difflib.SequenceMatcher(None, item, r["text"], autojunk=False).ratio()
        assert got[r["doc_id"]] == pytest.approx(ratio + sum(p in r["text"] for p in pairs) / len(pairs), abs=1e-6)


def test_best_match_by_whole_texts(spark, long_texts):
    assert [tuple(r) for r in QUERIES["similarity_best_match"](spark, long_texts).select("item_id", "doc_id", "score").collect()] == [(1, 6, 1.0)]


def test_fallback_by_whole_texts(spark, long_texts, tmp_path):
    whole = [tuple(r) for r in QUERIES["similarity_fallback"](spark, long_texts).select("item_id", "partner", "accepted").collect()]
    assert whole == [(1, 6, True)]
    # alike in the first 900 characters of 3,900 only: no partner
    head = "".join(random.Random(10).choices("abcdefghij", k=900))
    spark.createDataFrame([(1, head + "kl" * 1500)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, head + "mn" * 1500, "src1")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in QUERIES["similarity_fallback"](spark, str(tmp_path)).select("item_id", "partner", "accepted").collect()] == [(1, 1, False)]
