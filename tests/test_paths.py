"""Writes at JSON paths against a plain version over Python values."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.paths import Key, Place, json_write, parse_path


def plain(node, steps, value):
    """The rule over Python values; ``...`` stands for nothing there."""
    if not steps:
        return value
    step, rest = steps[0], steps[1:]
    if isinstance(step, Key):
        if node is ...:
            inner = plain(..., rest, value)
            return ... if inner is ... else {step.name: inner}
        if not isinstance(node, dict):
            return node
        inner = plain(node.get(step.name, ...), rest, value)
        return node if inner is ... else {**node, step.name: inner}
    if node is ...:
        inner = plain(..., rest, value) if step.at == 0 else ...
        return ... if inner is ... else [inner]
    if not isinstance(node, list):
        return node
    at = len(node) - step.at if step.from_end else step.at
    if not 0 <= at <= len(node):
        return node
    inner = plain(node[at] if at < len(node) else ..., rest, value)
    return node if inner is ... else [*node[:at], inner, *node[at + 1 :]]


def test_paths_are_parsed():
    assert parse_path("$") == [] and parse_path('$.a."b.c"[3][#][#-2]') == [Key("a"), Key("b.c"), Place(3), Place(0, True), Place(2, True)]
    for broken in ("a", "$a", "$.", "$[x]", "$[-1]", "$[#-0]", '$."a'):
        with pytest.raises(ValueError):
            parse_path(broken)


DOCS = [
    {}, [], 7, "text", None, {"a": None}, {"a": {}}, {"a": []}, {"a": [1, 2, 3]}, {"a": {"b": {"c": 1, "d": [True, None]}, "x": "y"}}, {"a": [{"b": [1]}, {"b": {"c": "日本 \"q\""}}]},
    [{"content": "x"}, {"content": "y"}], {"b": 1.5, "a": {"b": 2}}, {"a": "plain"}, {"a": {"b": [[1], [2, 3]]}}, {"": {"b": 1}, "k.l": [0]},
]
PATHS = ["$", "$.a", "$.a.b", "$.a.b.c", "$.a[0]", "$.a[3]", "$.a[4]", "$.a[#]", "$.a[#-1]", "$.a[1].b.c", "$[1].content", "$[#].content", "$.a.b[1][0]", "$.a.b[#-1][#]", '$."k.l"[0]', "$.n.e.w[0]", "$.n[1]", "$.a.b[2].z"]


@pytest.mark.parametrize("path", PATHS)
def test_writes_are_the_plain_ones(spark, path):
    rows = [(i, json.dumps(doc), f"v{i}" if i % 3 else None) for i, doc in enumerate(DOCS)]
    got = spark.createDataFrame(rows, "i int, doc string, v string").select("i", json_write(F.col("doc"), {path: F.col("v")}).alias("out")).collect()
    for r in got:
        want = plain(DOCS[r["i"]], parse_path(path), rows[r["i"]][2])
        assert json.loads(r["out"]) == want, (path, DOCS[r["i"]])


def test_writes_follow_each_other(spark):
    rng = random.Random(4)
    rows = [(i, json.dumps(rng.choice(DOCS)), rng.randint(0, 9)) for i in range(60)]
    writes = ["$.a.b", "$.a[#]", "$.n.m[0]", "$.n.m[#]", "$.a.b.c"]
    frame = spark.createDataFrame(rows, "i int, doc string, v int")
    for r in frame.select("i", json_write(F.col("doc"), {p: F.col("v") for p in writes}).alias("out")).collect():
        want = json.loads(rows[r["i"]][1])
        for p in writes:
            want = plain(want, parse_path(p), rows[r["i"]][2])
        assert json.loads(r["out"]) == want


def test_values_nulls_and_broken_texts(spark):
    frame = spark.createDataFrame([(0, None), (1, "{"), (2, ""), (3, '{"a":1}')], "i int, doc string")
    writes = {"$.list": F.array(F.lit("x"), F.lit("y")), "$.raw": F.parse_json(F.lit('{"z":[1]}')), "$.none": F.lit(None).cast("string")}
    got = [r["out"] for r in frame.select("i", json_write(F.col("doc"), writes).alias("out")).orderBy("i").collect()]
    assert got == [None, None, None, '{"a":1,"list":["x","y"],"none":null,"raw":{"z":[1]}}']
    filled = frame.select(json_write(F.coalesce("doc", F.lit("{}")), {"$.n": F.lit(1)}).alias("out"), "i").where("i = 0").first()
    assert filled["out"] == '{"n":1}'
    assert frame.where("i < 0").select(json_write(F.col("doc"), writes)).count() == 0
