"""Functions on imported papers against values worked out by hand."""

from __future__ import annotations

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import imported as im
from lectern.functions import text as fn

N, S = None, F.lit
OPTIONS = lambda x, **k: im.option_spans(S(x), **k)
RUNS = "[" + ",".join(['{"text":"  甲 \\u3000","bold":false,"underline":false}', '{"text":"乙\\t","bold":true,"underline":false}', '{"text":" \\t","bold":true,"underline":true}', '{"text":"b  c\\n\\n d ","bold":true,"underline":false}']) + "]"
FLAT = '[{"text":"ab","bold":false,"underline":false},{"text":"①c①","bold":true,"underline":false}]'
runs = lambda x: F.from_json(S(x), im.RUNS)
told = lambda x: [(r["text"], r["bold"], r["underline"]) for r in x]

CASES = {
    "compact": lambda: (fn.compact_text(S("中 文 a b")), "中文 a b"),
    "compact option": lambda: (fn.compact_text(S("故 A选项， 因 A 项 a")), "故A选项，因 A项 a"),
    "labels": lambda: (im.canonical_labels(S("【 参考答案 】B【 题型 分类 】x【 实战解析】")), "【参考答案】B【题型分类】x【实战解析】"),
    "noise": lambda: (F.array(*[im.is_page_noise(S(x)) for x in ("练习题 3 套", "123", "1234", " ", "四海公考", "sihai gong kao", "片段阅读600（上册）", "甲")]), [True, True, False, True, True, True, True, False]),
    "promotion": lambda: (im.cut_promotion(S("甲更新进度微信乙公考最新资料丙")), "甲"),
    "logic type": lambda: (F.array(*[im.logic_type(S(x)) for x in ("一般质疑①", "支持 1", "分享类", "某归因", "必要前提", "原因解释", "推出", "·", "其他")]), ["一般质疑类", "支持类", "支持类", "归因类", "前提假设类", "解释说明类", "推出类", "逻辑判断", "其他"]),
    "data type": lambda: (F.array(*[im.data_type(S(x)) for x in ("基期量①", "增量【难度评价】3", "增速", "平均", "排序", "计算", "倍数", "x")]), ["基期", "增长量", "增长率", "平均数", "查找比较", "简单计算", "比值倍数", "综合分析"]),
    "stem type": lambda: (F.array(*[im.stem_type(S(x)) for x in ("将句子重新排列", "填入横线", "接下来", "说法错误的是", "主要说明")]), ["语句排序类", "语句填入类", "下文推断类", "细节判断类", "中心理解题"]),
    "main type": lambda: (F.array(*[im.main_type(S(x)) for x in ("标题＋科普", " +a", None)]), ["标题", "片段阅读", "片段阅读"]),
    "source": lambda: (im.source_header(S("3．（2020国考 65%）")), ("2020国考", 65, "2020国考 65%")),
    "source bare": lambda: (im.source_header(S("5.（ 7% ）")), ("片段阅读", 7, "7%")),
    "answer": lambda: (F.array(im.answer_of(S("【参考答案】 b"), S("")), im.answer_of(S("x"), S("锁定 C 选项")), im.answer_of(S("x"), S("因此D选项说得对当选")), im.answer_of(S("x"), S("y"))), ["B", "C", "D", None]),
    "limit": lambda: (F.array(im.sequence_limit(S("将以上 6 个句子")), im.sequence_limit(S("①甲③乙②")), im.sequence_limit(S("甲"))), [6, 3, None]),
    "option": lambda: (F.array(im.clean_option(S(" ①③ ② "), S(2)), im.clean_option(S("①③②")), im.clean_option(S("甲乙⑤")), im.clean_option(S("甲（片面，不选）"))), ["①③", "①③②", "甲乙", "甲"]),
    "spans": lambda: (OPTIONS("A.x B.y D.w C.z D.v")["options"], [("A", "x"), ("B", "y D.w"), ("C", "z"), ("D", "v")]),
    "spans stem": lambda: (OPTIONS("题干\nA.x\nB.y C、z D.v"), ("题干", [("A", "x"), ("B", "y"), ("C", "z"), ("D", "v")])),
    "spans strict": lambda: (OPTIONS("甲 A.x B.y")["options"], []),
    "spans lenient": lambda: (OPTIONS("甲 A.x C.y A.z", lenient=True), ("甲", [("A", "x"), ("C", "y A.z")])),
    "spans wide": lambda: (OPTIONS("甲\nA.a  B.b  C.c  D.d  E.e", labels="ABCDEFGH", pattern=im.WIDE_OPTION_LABEL)["options"], [("A", "a"), ("B", "b"), ("C", "c"), ("D", "d"), ("E", "e")]),
    "spans none": lambda: (OPTIONS("甲乙"), ("甲乙", [])),
    "placeholders": lambda: (im.with_placeholders(OPTIONS("甲 A.x C. D.y", lenient=True)["options"])["missing"], ["B", "C"]),
    "section": lambda: (im.section_after(S("甲【实战解析】乙 丙①花生批注：丁"), im.PRACTICAL, "[①-⑳]?\\s*花生批注"), "乙 丙"),
    "ranges": lambda: (im.added_ranges(S("甲乙（在）"), S("甲（注）乙（在）(x y)")), [(1, 4), (8, 13)]),
    "preview": lambda: (F.array(im.preview(S("abcdef"), 3), im.preview(S("abc"), 3)), ["abc…", "abc"]),
    "user": lambda: (F.array(*[im.user_name_error(S(x)) for x in (" ab ", "a" * 25, "a b c", " ok_1 ")]), ["short", "long", "characters", None]),
    "same name": lambda: (F.array(im.same_name(S("Ab "), S("aB")), im.same_name(S("É"), S("é"))), [True, False]),
    "title": lambda: (F.array(im.practice_title(F.array(S("言语")), S("标题")), im.practice_title(F.array(S("言语")), S(None)), im.practice_title(F.array(S("a"), S("b")), S("x"))), ["言语 · 标题专项练习", "言语专项练习", "行测综合训练"]),
    "half even": lambda: (F.array(fn.round_half_even(S(0.5), 0), fn.round_half_even(S(2.5), 0), fn.round_half_even(S(0.12351), 4)), [0.0, 2.0, 0.1235]),
    "image": lambda: (F.array(im.image_shown(S("i"), S(5), S("m")), im.image_shown(S("i"), S(5), S("")), im.image_shown(S("i"), S(4), S("m")), im.image_shown(S(""), S(4), S(""))), [False, True, True, False]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    column, expected = CASES[name]()
    got = spark.range(1).select(column.alias("x")).first()["x"]
    plain = lambda v: tuple(plain(x) for x in v) if isinstance(v, (tuple, list)) else v
    assert plain(got) == plain(expected)


RICH = {
    "normalize": lambda: (im.normalize_runs(runs(RUNS)), [("甲", False, False), ("乙 ", True, False), ("  ", True, True), ("b c\nd", True, False)]),
    "slice": lambda: (im.slice_runs(runs(FLAT), S(1), S(3)), [("b", False, False), ("①", True, False)]),
    "insert": lambda: (im.insert_run(runs(FLAT), S(1), F.struct(S("X").alias("text"), S(False).alias("bold"), S(True).alias("underline"), S(False).alias("italic"))), [("a", False, False), ("X", False, True), ("b", False, False), ("①c①", True, False)]),
    "break": lambda: (im.break_before_marks(runs(FLAT)), [("ab\n", False, False), ("①c", True, False), ("\n", False, False), ("①", True, False)]),
}


@pytest.mark.parametrize("name", sorted(RICH))
def test_rich(spark, name):
    column, expected = RICH[name]()
    assert told(spark.range(1).select(column.alias("x")).first()["x"]) == expected


def test_blanks(spark):
    raw = runs('[{"text":"甲","bold":false,"underline":false},{"text":"\\u00a0\\u00a0","bold":false,"underline":true}]')
    assert spark.range(1).select(im.fill_blanks(raw).alias("x")).first()["x"] == "甲__________"


def test_import_key_is_that_of_plain_json(spark):
    stem, source = 'a"\\\x0b\x1f\u007f/中\n\\u000B', "s\t"
    options = [{"label": "A", "content": "x\x0c"}]
    frame = spark.createDataFrame([(stem, options, source)], "stem string, options array<struct<label:string,content:string>>, source string")
    got = frame.select(im.import_key(F.col("stem"), F.col("options"), F.col("source")).alias("k")).first()["k"]
    assert got == hashlib.sha256(json.dumps([stem, options, source], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def test_json_text_behind_any_number_of_backslashes(spark):
    values = ["\\" * n + "\x1f" + "\\" * n + "u001F" for n in (0, 1, 2, 101, 202)] + ["x" * 200_000 + "\x0b"]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r["x"] for r in frame.orderBy("i").select(im.json_text(F.to_json(F.array("v"))).alias("x")).collect()]
    assert got == [json.dumps([v]) for v in values]


def test_import_key_of_long_runs_of_backslashes(spark):
    stem, options = "\\" * 150 + "\x1b", [{"label": "A", "content": "\\" * 101 + "\x0b"}]
    frame = spark.createDataFrame([(stem, options, "s")], "stem string, options array<struct<label:string,content:string>>, source string")
    got = frame.select(im.import_key(F.col("stem"), F.col("options"), F.col("source")).alias("k")).first()["k"]
    assert got == hashlib.sha256(json.dumps([stem, options, "s"], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


@pytest.mark.parametrize("lenient", [False, True])
def test_option_spans_search_a_text_a_few_times_only(spark, lenient):
    frame = spark.createDataFrame([("A.x B.y C.z D.w",)], "t string").withColumn("q", im.option_spans(F.col("t"), lenient=lenient))
    plan = frame.select("q.stem", im.with_placeholders(F.col("q.options"))["missing"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 3 and plan.count("split(") == 1


def test_option_spans_of_many_labels_and_of_null(spark):
    text = "".join(f"A.{i} C.{i} " for i in range(2000))  # labels out of order, each with text of its own
    lenient = im.option_spans(F.col("t"), lenient=True)
    frame = spark.createDataFrame([(0, text), (1, None)], "i int, t string").select("i", lenient.alias("q"))
    many, none = [r["q"] for r in frame.orderBy("i").collect()]
    assert [(o["label"], len(o["content"])) for o in many["options"]] == [("A", 1), ("C", len(text) - 7)]
    assert (none["stem"], none["options"]) == (None, [])


def test_nested_inserts_work_out_their_runs_once(spark):
    new = F.struct(S("x").alias("text"), *[S(False).alias(c) for c in im.STYLE])
    nested = im.insert_run(im.insert_run(F.from_json(F.col("j"), im.RUNS), S(1), new), S(3), new)
    frame = spark.createDataFrame([(FLAT,)], "j string").select(nested.alias("x"))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [r["text"] for r in frame.first()["x"]] == ["axbx", "①c①"]


def test_italic_runs_stay_apart(spark):
    raw = runs('[{"text":"a","italic":true},{"text":"b","italic":false},{"text":"c","bold":false}]')
    got = spark.range(1).select(im.merge_runs(raw).alias("x")).first()["x"]
    assert [(r["text"], r["italic"]) for r in got] == [("a", True), ("bc", False)]


def test_runs_across_blanks_and_cuts(spark):
    many = [{"text": t} for t in ("", " \n", " ", "\n甲 ", " ", "乙\n", " \n", " ", "x")]
    for i, r in enumerate(many):
        r["bold"] = i % 2 == 0
    raw = runs(json.dumps(many))
    row = spark.range(1).select(im.normalize_runs(raw).alias("n"), im.cut_runs(raw, "乙\\n \\n").alias("c"), im.cut_runs(raw, "none").alias("w"), im.cut_runs(raw, "\\A").alias("all"), im.normalize_runs(runs('[{"text":" \\n"}]')).alias("e"), im.merge_runs(runs("[]")).alias("z")).first()
    text = lambda x: "".join(r["text"] for r in x)
    assert text(row["n"]) == "甲乙\nx" and text(row["c"]) == " \n \n甲  " and text(row["w"]) == text(many) and row["e"] == row["z"] == []


def test_a_long_paragraph_of_many_runs(spark):
    import time

    rng = __import__("random").Random(1)
    flags = [{"bold": rng.random() < 0.5, "underline": False, "italic": rng.random() < 0.5} for _ in range(1000)]
    many = [{"text": "".join(rng.choices("ab甲 ", k=33)), **f} for f in flags]
    chars = [(c, r["bold"], r["italic"]) for r in many for c in r["text"]]
    raw = F.from_json("j", im.RUNS)
    frame = spark.createDataFrame([(json.dumps(many),)], "j string").select(raw.alias("r"))
    began = time.time()
    new = F.struct(S("X").alias("text"), S(True).alias("bold"), S(True).alias("underline"), S(True).alias("italic"))
    row = frame.select(im.slice_runs(F.col("r"), S(1000), S(30000)).alias("s"), im.insert_run(F.col("r"), S(777), new).alias("i"), im.offsets(F.col("r")).alias("o"), im.normalize_runs(F.col("r")).alias("n")).first()
    assert time.time() - began < 60
    spread = lambda x: [(c, r["bold"], r["italic"]) for r in x for c in r["text"]]
    assert spread(row["s"]) == chars[1000:30000] and spread(row["i"]) == [*chars[:777], ("X", True, True), *chars[777:]]
    assert row["o"] == list(range(0, 33000, 33)) and all((a["bold"], a["italic"]) != (b["bold"], b["italic"]) for a, b in zip(row["s"], row["s"][1:]))
    assert "".join(r["text"] for r in row["n"]) == re.sub("(?<=[甲]) (?=[甲])", "", re.sub(" +", " ", "".join(r["text"] for r in many))).strip()
