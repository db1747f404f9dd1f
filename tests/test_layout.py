"""Nested shapes and lines of tokens, worked out by hand."""

from __future__ import annotations

from lectern.operators import layout


def test_shapes_of_depth_four(spark):
    rows = [
        ("d", 1, None, 2, 10.0, 20.0, None), ("d", 2, 1, 9, 1.0, 2.0, " one\r\x07two\r"), ("d", 3, 2, 9, 1.0, 1.0, "\x07"), ("d", 4, 3, None, 0.25, -30.0, "deep"), ("d", 5, 4, None, 0.5, 0.0, "deepest"),
        ("d", 6, None, 1, 0.0, 0.0, "first"), ("d", 7, 99, 1, 0.0, 0.0, "orphan"), ("d", 8, 9, 1, 0.0, 0.0, "ring"), ("d", 9, 8, 1, 0.0, 0.0, "ring"), ("e", 2, None, 1, 0.125, 0.375, "other"),
    ]
    shapes = spark.createDataFrame(rows, "doc string, id int, parent int, page int, left double, top double, text string")
    got = layout.flat_shapes(shapes).orderBy("doc", "page", "top", "left").collect()
    assert [(r["doc"], r["id"], r["page"], r["depth"], r["text"]) for r in got] == [("d", 6, 1, 0, "first"), ("d", 4, 2, 3, "deep"), ("d", 5, 2, 4, "deepest"), ("d", 2, 2, 1, "one\ntwo"), ("e", 2, 1, 0, "other")]
    assert (got[-1]["left"], got[-1]["top"], got[2]["left"], got[2]["top"]) == (0.12, 0.38, 12.75, -7.0)
    assert layout.flat_shapes(shapes.where("false")).count() == 0


def test_tokens_make_lines_by_gaps(spark):
    rows = [("d", 1, 5.0, 10.0, "a"), ("d", 1, 1.0, 12.0, "b"), ("d", 1, 60.0, 11.0, "r"), ("d", 1, 3.0, 20.0, "c"), ("d", 1, 4.0, 20.0, " "), ("d", 1, 61.0, 30.0, None), ("d", 2, 29.0, 1.0, "near"), ("d", 2, 70.0, 1.0, "x")]
    tokens = spark.createDataFrame(rows, "doc string, page int, x double, y double, text string")
    got = layout.token_lines(tokens, column=30.5).orderBy("doc", "page", "col", "line").collect()
    assert [(r["page"], r["col"], r["line"], r["top"], r["text"]) for r in got] == [(1, 0, 1, 10.0, "b a"), (1, 0, 2, 20.0, "c"), (1, 1, 1, 11.0, "r"), (2, 0, 1, 1.0, "near x")]
    assert [r["text"] for r in layout.token_lines(tokens).where("page = 1").orderBy("line").collect()] == ["b a r", "c"]


def test_shapes_of_a_small_file_are_not_broadcast(spark, tmp_path):
    # written and read again, so that the planner knows a size, and takes the shapes for as small as the file
    rows = spark.range(300).selectExpr("'d' as doc", "id", "if(id > 0, id - 1 - (id - 1) % 3, null) as parent", "1L as page", "0.0 as left", "1.0 as top", "'t' as text")
    rows.write.parquet(str(tmp_path / "shapes"))
    flat = layout.flat_shapes(spark.read.parquet(str(tmp_path / "shapes")))
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert "leftHint=(strategy=merge)" in plan and "rightHint=(strategy=merge)" in plan
