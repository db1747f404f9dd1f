"""Hand-worked cases for rules that the data folders do not exercise."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.operators import bank, merge, similarity as sim
from lectern.plans.base import Tables
from lectern.plans.catalogue import QUERIES


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "label"), [("中心理解题①", "中心理解题"), ("标题", "标题拟定类"), ("foo12", "foo"), ("", "片段阅读"), ("图表。", "图表")])
def test_clean_type(spark, raw, label):
    assert value(spark, fn.clean_type(F.lit(raw))) == label


@pytest.mark.parametrize(("raw", "number"), [("①", 1), ("12", 12), ("①②", 12), ("⑩", 10), ("⑩①", 1)])
def test_marker_number(spark, raw, number):
    assert value(spark, fn.marker_number(F.lit(raw))) == number


@pytest.mark.parametrize(("seconds", "clock"), [(65, "01:05"), (-3, "00:00"), (3600, "60:00")])
def test_mmss(spark, seconds, clock):
    assert value(spark, fn.mmss(F.lit(seconds))) == clock


@pytest.mark.parametrize(("x", "whole"), [(12.5, 13), (33.3, 33), (66.7, 67)])
def test_round_half_up(spark, x, whole):
    assert value(spark, fn.round_half_up(F.lit(x))) == whole


def test_difficulty(spark):
    rows = spark.createDataFrame([(None,), (70,), (69,), (45,), (44,)], "a int").select(fn.difficulty(F.col("a")).alias("d"))
    assert [r["d"] for r in rows.collect()] == ["基础", "基础", "进阶", "进阶", "挑战"]


def test_text_rules(spark):
    assert value(spark, fn.compact_text(F.lit("中 文 a b"))) == "中文 a b"
    assert value(spark, fn.decode_ids(F.lit("3,,x,3,0,7"))) == [3, 7]
    assert value(spark, fn.percent_in(F.lit("2020 65%"))) == 65
    assert value(spark, fn.added_parentheticals(F.lit("甲乙"), F.lit("甲（注）乙"))) == ["（注）"]
    assert value(spark, fn.added_parentheticals(F.lit("甲（注）乙"), F.lit("甲（注）乙"))) == []


def test_dice(spark):
    left = spark.createDataFrame([(1, "abcd"), (2, "aaaa"), (3, "A!b")], "a long, text string")
    right = spark.createDataFrame([(1, "bcde"), (2, "aaa"), (3, "ab")], "b long, text string")
    scores = {(r["a"], r["b"]): r["score"] for r in sim.dice_multiset(left, right, "a", "b", "text").collect()}
    assert scores[1, 1] == pytest.approx(4 / 6) and scores[2, 2] == pytest.approx(0.8) and scores[3, 3] == 1.0
    assert value(spark, sim.dice_set(F.lit("aaaa"), F.lit("aaa"))) == 1.0
    assert value(spark, sim.dice_set(F.lit("a"), F.lit("a"))) == 0.0


def test_merge_keeps_and_overwrites(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, p string, q string")
    source = spark.createDataFrame([(2, None, "new"), (3, "c", "z")], "k int, p string, q string")
    once = merge.merge(target, source, ["k"], ["p"])
    rows = {r["k"]: (r["p"], r["q"]) for r in once.collect()}
    assert rows == {1: ("a", "x"), 2: (None, "y"), 3: ("c", "z")}
    assert sorted(map(tuple, merge.merge(once, source, ["k"], ["p"]).collect())) == sorted(map(tuple, once.collect()))


def test_adopted_key_goes_to_the_lowest_twin(spark):
    target = spark.createDataFrame([(1, "s", "o", None), (2, "s", "o", None), (3, "t", "o", "k3")], "id int, stem string, opts string, key string")
    staged = spark.createDataFrame([("s", "o", "n1"), ("s", "o", "n2")], "stem string, opts string, key string")
    assert {r["id"]: r["key"] for r in merge.adopt_keys(target, staged, ["stem", "opts"], "key", "id").collect()} == {1: "n1", 2: None, 3: "k3"}


def test_numbers_run_over_ranges(spark):
    rows = spark.range(100).select((F.col("id") * 37 % 101).alias("k")).repartition(5)
    ranged = bank.numbered(rows, "k", "n", size=7)
    assert [r["n"] for r in ranged.orderBy("k").collect()] == list(range(1, 101))
    assert "SinglePartition" not in ranged._jdf.queryExecution().executedPlan().toString()


def test_queries_over_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, parts = Tables(spark, sf).documents.count(), Tables(spark, sf).part.count()
    assert sum(len(r["ids"].split(",")) for r in QUERIES["group_to_list"](spark, sf).collect()) == docs
    assert max(r["pairs"] for r in QUERIES["dice_multiset"](spark, sf).collect()) > 0.9 * docs
    assert QUERIES["option_sequence"](spark, sf).count() == QUERIES["json_array_patch"](spark, sf).count() == parts


def test_overlap_reads_whole_texts(spark):
    assert value(spark, sim.distinctive_overlap(F.lit("rare"), F.lit("z" * 500 + "rare"), []))
    assert not value(spark, sim.distinctive_overlap(F.lit("z" * 180 + "rare"), F.lit("rare"), []))


def test_whole_text_scores(spark):
    """All pairs of items and documents above the threshold, and no others."""
    sf = "/root/testdata/sf0.001"
    key = lambda t: re.sub("[^0-9A-Za-z\u3400-\u9fff]", "", t or "")
    sets = lambda rows, i: {r[i]: {t[k : k + 2] for t in [key(r["text"])] for k in range(len(t) - 1)} for r in rows}
    items, docs = sets(Tables(spark, sf).benchmark.collect(), "item_id"), sets(Tables(spark, sf).documents.collect(), "doc_id")
    shared = {(i, j): len(a & b) for i, a in items.items() for j, b in docs.items()}
    want = {(i, j): 2 * n / (len(items[i]) + len(docs[j])) for (i, j), n in shared.items() if n}
    scores = {(r["item_id"], r["doc_id"]): r["score"] for r in QUERIES["dice_set"](spark, sf).collect()}
    assert scores == pytest.approx({k: v for k, v in want.items() if v >= 0.5}, abs=2e-6)
    shares = {(r["item_id"], r["doc_id"]): r["share"] for r in QUERIES["gram_containment"](spark, sf).collect()}
    assert shares == pytest.approx({(i, j): n / len(items[i]) for (i, j), n in shared.items() if n >= 0.9 * len(items[i]) > 0}, abs=2e-6)


def test_pairing_accepts_and_keeps_what_is_alike(spark):
    scored = spark.createDataFrame([(1, 7, 0.5), (1, 5, 0.5), (1, 6, 0.43), (1, 8, 0.2), (2, 9, 0.47)], "a long, b long, score double")
    got = {r["a"]: (r["b"], r["accepted"], r["alike"]) for r in sim.accept(scored, "a", "b").collect()}
    assert got == {1: (5, True, [5, 7, 6]), 2: (9, False, [9])}
    one = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", "y"), (4, "", "x"), (5, None, "x")], "i long, text string, s string")
    pairs = {(r["i"], r["j"]): r["score"] for r in sim.dice_multiset(one, one.withColumnRenamed("i", "j"), "i", "j", "text", block="s").collect()}
    assert pairs == {(1, 1): 1.0, (2, 2): 1.0, (3, 3): 1.0}


def test_probes_try_shorter_heads(spark):
    items = spark.createDataFrame([(1, "abcdefghij klmnopqrst uvwxyz 0123456789"), (2, "short"), (3, None)], "i long, text string")
    texts = spark.createDataFrame([(1, "zz ABCDEFGHIJKLMNOPQRSTUVWXYZ012345 6789"), (2, "abcdefghijklmnopqrstuvwx!"), (3, "xxabcdefghijklmnopqr-"), (4, "abcdefghijklmnopq"), (5, None)], "j long, text string")
    assert {(r["i"], r["j"]): r["matched"] for r in sim.probe(items, texts, "i", "j").collect()} == {(1, 1): 32, (1, 2): 24, (1, 3): 18}


def test_blanks_become_spaces(spark):
    assert value(spark, fn.normalize_space(F.lit("a\rb\r\nc \f　\x0bd  \n\n e "))) == "a b\nc d\n\ne"


def test_numbers_of_strings_in_many_ranges(spark):
    from lectern.operators import bank

    words = ["b", "c", "aaaaaaaa", "d", "", "aaaaaaab", "é", "日本", "zz", "a"]
    got = bank.numbered(spark.createDataFrame([(w,) for w in words], "w string"), "w", "n", size=2)
    assert [r["w"] for r in got.orderBy("n").collect()] == sorted(words, key=str.encode) and sorted(r["n"] for r in got.collect()) == list(range(1, 11))


def test_an_import_gives_each_key_to_one_row(spark):
    from lectern.operators import merge

    kind = "id long, cat int, stem string, answer string, key string"
    target = spark.createDataFrame([(1, 1, "a", "old", "k1"), (2, 1, "a", "old", None), (3, 1, "b", "old", None), (4, 1, "b", "old", None), (5, 2, "b", "old", None), (6, 1, "c", "old", None)], kind)
    staged = spark.createDataFrame([(1, "a", "new", "k1"), (1, "b", "new", "k2"), (1, "d", "new", "k3"), (1, "b", "new", "k4")], "cat int, stem string, answer string, key string")
    got = merge.finalize_append(target, staged, "key", ["stem"], "id", ["answer"], scope=["cat"])
    rows = sorted(((r["id"] or 99, r["cat"], r["stem"], r["answer"], r["key"]) for r in got.collect()), key=str)
    assert rows == sorted([(1, 1, "a", "new", "k1"), (2, 1, "a", "old", None), (3, 1, "b", "new", "k2"), (4, 1, "b", "old", None), (5, 2, "b", "old", None), (6, 1, "c", "old", None), (99, 1, "d", "new", "k3"), (99, 1, "b", "new", "k4")], key=str)
    both = spark.createDataFrame([(1, 1, "a", "old", None), (2, 1, "b", "old", None)], kind)
    same = spark.createDataFrame([(1, "a", "new", "k"), (1, "b", "new", "k")], "cat int, stem string, answer string, key string")
    assert [r["key"] for r in merge.adopt_keys(both, same, ["stem"], "key", "id").orderBy("id").collect()] == ["k", None]


def test_spans_meet_their_lines_only(spark):
    from lectern.operators import segment

    lines = spark.createDataFrame([("d", i) for i in range(500)] + [("e", i) for i in range(9)], "doc string, pos int")
    spans = spark.createDataFrame([("d", 0, 7, 0), ("d", 95, 130, 1), ("d", 498, 520, 2), ("e", -3, 0, 3), ("e", 5, 4, 4), ("f", 0, 9, 5)], "doc string, low int, high int, s int")
    got = segment.within(lines, spans, "doc", "low", "high", 30)
    want = sorted((d, p, s) for d, n in (("d", 500), ("e", 9)) for p in range(n) for e, lo, hi, s in spans.collect() if d == e and lo <= p <= hi)
    assert sorted((r["doc"], r["pos"], r["s"]) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" in plan and "Join Inner" in plan
