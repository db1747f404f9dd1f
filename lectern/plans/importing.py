"""Queries of the paper importer. Papers are composed from ``part``, so the SQL twins state what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import imported as im
from lectern.functions import text as fn
from lectern.operators import papers, similarity as sim
from lectern.plans.base import Tables, query, spread

NUM = "(SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)"


def _numbered(spark, d) -> DataFrame:
    return Tables(spark, d).part.withColumn("rn", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))


def _lines(rows: DataFrame, *lines: str) -> DataFrame:
    """(doc, pos, line): lines of each part in turn; null lines are left out."""
    each = F.posexplode(F.array(*[F.expr(x) for x in lines])).alias("i", "line")
    return rows.select(F.col("p_brand").alias("doc"), "rn", each).select("doc", (F.col("rn") * 10 + F.col("i")).alias("pos"), "line").where("line is not null")


NUMBER = "cast((rn - 1) % 20 + 1 as string)"


def _book(spark, d) -> DataFrame:
    shifted = "cast(if(p_size % 10 = 0, ((rn - 1) % 20 + 1) % 20 + 1, (rn - 1) % 20 + 1) as string)"
    return _lines(_numbered(spark, d), f"concat({shifted}, '．', p_name)", "'25．x'", "concat('A.a', p_size, ' B.', lower(p_type))", "if(p_size % 7 = 0, 'C.c', 'C.c D.d')", "'四海公考'").unionByName(
        Tables(spark, d).part.select(F.col("p_brand").alias("doc"), F.lit(0).alias("pos"), F.lit("preface").alias("line")).distinct()
    )


@query(f"SELECT p_brand AS doc, rn AS chunk, CASE WHEN p_size % 10 = 0 THEN ((rn - 1) % 20 + 1) % 20 + 1 ELSE (rn - 1) % 20 + 1 END AS number, 5 AS n FROM {NUM}")
def paper_chunks(spark, d):
    return papers.numbered_chunks(_book(spark, d)).select("doc", F.col("chunk").cast("long").alias("chunk"), F.col("number").cast("long").alias("number"), "n")


@query(f"SELECT p_brand AS doc, count(*) AS n, count(*) FILTER (WHERE p_size % 10 = 0) AS off, count(*) % 20 <> 0 AS ragged FROM {NUM} GROUP BY 1")
def paper_sequence(spark, d):
    return papers.sequence_report(papers.numbered_chunks(_book(spark, d)))


@query(f"""SELECT p_brand AS doc, rn AS chunk, p_name || chr(10) || '25．x' AS stem, 'A=a' || p_size || ';B=' || lower(p_type) || ';C=c;D=' || CASE WHEN p_size % 7 = 0 THEN '{im.PLACEHOLDER}' ELSE 'd' END AS options,
CASE WHEN p_size % 7 = 0 THEN 'D' ELSE '' END AS missing FROM {NUM}""")
def record_parse(spark, d):
    chunks = papers.numbered_chunks(_book(spark, d))
    spans = chunks.select("doc", F.col("chunk").cast("long").alias("chunk"), im.option_spans(F.regexp_extract("body", im.QUESTION_START, 2), lenient=True).alias("q"))
    filled = spans.withColumn("f", im.with_placeholders(F.col("q.options")))
    return filled.select("doc", "chunk", F.col("q.stem").alias("stem"), _shown("f.options"), F.array_join("f.missing", ",").alias("missing"))


def _shown(options: str, name: str = "options"):
    return F.array_join(F.transform(options, lambda o: F.concat(o["label"], F.lit("="), o["content"])), ";").alias(name)


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'A=' || p_brand || ';B=' || p_type || ' D.x;C=c;D=' || p_name WHEN 1 THEN '' ELSE '' END AS strict,
CASE p_size % 3 WHEN 0 THEN 'A=' || p_brand || ';B=' || p_type || ' D.x;C=c;D=' || p_name WHEN 1 THEN 'C=x;A=' || p_brand || ' C.' || p_type ELSE '' END AS lenient FROM part""")
def option_sequence(spark, d):
    raw = F.expr("case p_size % 3 when 0 then concat('A. ', p_brand, ' B. ', p_type, ' D.x C. c D. ', p_name) when 1 then concat('C.x A.', p_brand, ' C.', p_type) else p_name end")
    return spread(Tables(spark, d).part, "p_partkey").select("p_partkey", _shown(im.option_spans(raw)["options"], "strict"), _shown(im.option_spans(raw, lenient=True)["options"], "lenient"))


def _analysis(spark, d) -> DataFrame:
    return _lines(
        _numbered(spark, d), f"concat({NUMBER}, '．（', p_type, ' ', p_size, '%）')", "concat(lpad(p_partkey, 8, '0'), ' ', p_name)", "'A.x B.y C.z D.w'", "concat('【 参考答案 】', chr(65 + p_size % 4))", "'【题型 分类】标题①+科普'",
        "concat('【实战解析】solution of ', p_partkey)", "concat('more ', p_size)", "if(p_size % 2 = 0, concat(substring('①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳', cast((rn - 1) % 20 + 1 as int), 1), ' 花生批注：note ', p_name), null)", "if(p_size % 2 = 0, 'tail', null)",
    ).withColumn("line", im.canonical_labels(F.col("line")))


@query(f"SELECT p_brand AS doc, rn AS chunk, p_type AS source, p_size AS accuracy, chr((65 + p_size % 4)::INTEGER) AS answer, '标题' AS type, 'solution of ' || p_partkey || chr(10) || 'more ' || p_size AS practical FROM {NUM}")
def analysis_fields(spark, d):
    chunks = papers.numbered_chunks(_analysis(spark, d), pattern=im.ANALYSIS_START)
    body = F.col("body")
    practical = im.section_after(body, im.PRACTICAL, f"\\n? *(?:{im.CIRCLED}|[0-9])*\\s*{im.NOTE}|{im.ANSWER}")
    kind = F.regexp_replace(im.main_type(F.regexp_extract(body, "【题型[^】]*】\\s*([^\\n]+)", 1)), f"{im.CIRCLED}+\\z", "")
    header = im.source_header(F.get(F.split(body, "\\n", 2), 0))
    return chunks.select("doc", F.col("chunk").cast("long").alias("chunk"), header["source"].alias("source"), header["accuracy"].cast("long").alias("accuracy"), im.answer_of(body, practical).alias("answer"), kind.alias("type"), practical.alias("practical"))


@query(f"SELECT p_partkey, 'solution of ' || p_partkey || chr(10) || 'more ' || p_size AS explanation FROM {NUM}")
def explanation_recovery(spark, d):
    probes = Tables(spark, d).part.select("p_partkey", F.col("p_brand").alias("doc"), F.expr("concat(lpad(p_partkey, 8, '0'), '; ', p_name)").alias("stem"))
    return papers.practical_after(_analysis(spark, d), probes, "p_partkey").select("p_partkey", "explanation")


@query(f"SELECT p_brand AS doc, row_number() OVER (PARTITION BY p_brand ORDER BY rn) - 1 AS nth, (rn - 1) % 20 + 1 AS number, 'note ' || p_name || chr(10) || 'tail' AS content FROM {NUM} WHERE p_size % 2 = 0")
def note_list(spark, d):
    return papers.notes_of(_analysis(spark, d)).select("doc", F.col("nth").cast("long").alias("nth"), F.col("number").cast("long").alias("number"), "content")


@query(f"SELECT p_brand AS doc, (rn - 1) // 25 AS grp, count(*) AS notes FROM {NUM} GROUP BY 1, 2")
def note_groups(spark, d):
    rows = _numbered(spark, d).select(F.col("p_brand").alias("doc"), (F.col("rn") - 1).alias("nth"), ((F.col("rn") - 1) % 25 + 1).alias("number"))
    expected = rows.groupBy("doc").agg(F.ceil(F.count(F.lit(1)) / 25).cast("int").alias("groups"))
    return papers.note_groups(rows, expected).groupBy("doc", F.col("grp").cast("long").alias("grp")).agg(F.count(F.lit(1)).alias("notes"))


GRAMSET = "list_distinct(list_transform(generate_series(1, length({c}) - 1), lambda i: substr({c}, i, 2)))"
NAMED = f"(SELECT *, replace(p_name, ' ', '') AS k, replace(p_name || p_type, ' ', '') AS b, (rn - 1) // 20 AS s FROM {NUM})"
NOTED = f"""(SELECT n.p_partkey AS note, q.p_partkey AS question, (n.rn - 1) % 20 + 1 = q.p_size % 20 + 1 AS eligible, round(2.0::DOUBLE * len(list_intersect({GRAMSET.format(c='n.k')}, {GRAMSET.format(c='q.b')})) / (len({GRAMSET.format(c='n.k')}) + len({GRAMSET.format(c='q.b')})), 9) AS score
FROM {NAMED} n JOIN {NAMED} q ON n.p_brand = q.p_brand AND n.s = q.s)"""
PICKED = """SELECT note, question, score, CASE WHEN marked THEN 'marker' ELSE 'content' END AS mode FROM (SELECT *, row_number() OVER (PARTITION BY note ORDER BY score DESC, question) AS r FROM (
SELECT *, {marked} AS marked FROM (SELECT *, max(score) OVER (PARTITION BY note) AS top, max(CASE WHEN eligible THEN score END) OVER (PARTITION BY note) AS own FROM """ + NOTED + """)) WHERE eligible OR NOT marked) WHERE r = 1"""


def _noted(spark, d) -> DataFrame:
    """Every note beside the questions of its set of 20."""
    rows = _numbered(spark, d).withColumn("s", F.floor((F.col("rn") - 1) / 20))
    grams = lambda *c: F.array_distinct(sim.grams(fn.bare(F.concat(*c))))
    notes = rows.select("p_brand", "s", F.col("p_partkey").alias("note"), F.expr("(rn - 1) % 20 + 1").alias("number"), grams("p_name").alias("x"))
    questions = rows.select("p_brand", "s", F.col("p_partkey").alias("question"), F.expr("p_size % 20 + 1").alias("marker"), grams("p_name", "p_type").alias("y"))
    score = F.lit(2.0) * F.size(F.array_intersect("x", "y")) / (F.size("x") + F.size("y"))
    return notes.join(questions, ["p_brand", "s"]).select("note", "question", (F.col("number") == F.col("marker")).alias("eligible"), F.round(score, 9).alias("score"))


@query(PICKED.format(marked="own IS NOT NULL"))
def note_by_marker(spark, d):
    return papers.assign_notes(_noted(spark, d), ["note"], "question")


@query(PICKED.format(marked="coalesce(own >= top - 0.1, false)"))
def note_by_tolerance(spark, d):
    return papers.assign_notes(_noted(spark, d), ["note"], "question", tolerance=0.1)


@query(PICKED.format(marked="own IS NOT NULL") + " AND (marked OR score >= 0.5)")
def note_or_unbound(spark, d):
    return papers.assign_notes(_noted(spark, d), ["note"], "question", least=0.5)


TRIGRAMS = "list_distinct(list_transform(generate_series(1, length({c}) - 2), lambda i: substr({c}, i, 3)))"
BESIDE = f"(SELECT p_partkey, p_brand, p_size, replace(p_name, ' ', '') AS k, coalesce(replace(lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) || p_type, ' ', ''), '') AS b FROM part)"
FILTERED = f"""(SELECT *, round(CASE WHEN b = '' THEN 0 ELSE 2.0::DOUBLE * len(list_intersect({GRAMSET.format(c='k')}, {GRAMSET.format(c='b')})) / (len({GRAMSET.format(c='k')}) + len({GRAMSET.format(c='b')})) END, 6)::DOUBLE AS relevance,
len(list_filter(list_intersect({GRAMSET.format(c='k')}, {GRAMSET.format(c='b')}), lambda g: NOT list_contains(['re', 'bl'], g))) >= 2 OR len(list_intersect({TRIGRAMS.format(c='k')}, {TRIGRAMS.format(c='b')})) > 0 AS distinctive FROM {BESIDE})"""


@query(f"""SELECT p_brand, min(p_partkey) AS note, k || 'x' AS content, max(greatest(relevance, 0.1)) >= 0.1 AS scored FROM {FILTERED} WHERE b <> '' AND distinctive AND (p_size % 2 = 0 OR relevance >= 0.4) GROUP BY p_brand, k""")
def note_filter(spark, d):
    beside = F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = Tables(spark, d).part.withColumn("base", F.concat(beside, "p_type")).where("base is not null")
    x, y = fn.bare(F.col("p_name")), fn.bare(F.col("base"))
    notes = rows.select(
        "p_brand", F.col("p_partkey").alias("note"), F.lit("①").alias("marker"), F.concat(x, F.lit("x\n A. y")).alias("content"), F.lit(0.1).alias("score"), F.round(sim.dice_set(x, y), 6).alias("relevance"),
        sim.distinctive_overlap(x, y, ["re", "bl"]).alias("distinctive"), F.expr("p_size % 2 = 0").alias("marked"),
    )
    return papers.clean_notes(notes, ["p_brand"], "note", relevance=0.4).select("p_brand", "note", "content", (F.col("score") >= 0.1).alias("scored"))


@query(f"""SELECT p_brand AS doc, rn - 1 AS nth, CASE p_size % 4 WHEN 0 THEN 'strict' WHEN 1 THEN 'loose' WHEN 2 THEN 'any' ELSE 'after' END AS how, CASE p_size % 4 WHEN 1 THEN 'see ' || (rn - 1) % 20 + 1 || '．' || p_name ELSE p_name END AS stem,
'A=a;B=b;C=c;D=' || CASE WHEN p_size % 5 = 0 THEN '{im.PLACEHOLDER}' ELSE 'd' END AS options, 'B' AS answer FROM {NUM}""")
def anchored_records(spark, d):
    header = f"case p_size % 4 when 0 then concat({NUMBER}, '．', p_name) when 1 then concat('see ', {NUMBER}, '．', p_name) when 2 then concat('99.', p_name) else p_name end"
    lines = _lines(_numbered(spark, d), header, "'A.a B.b C.c D.'", "if(p_size % 5 = 0, null, 'd')", "'【参考答案】B'")
    return papers.anchored_records(lines).select("doc", F.col("nth").cast("long").alias("nth"), "how", "stem", _shown("options"), "answer")


@query(f"SELECT p_brand AS doc, rn * 10 + (CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) AS pos FROM {NUM} UNION ALL SELECT p_brand, rn * 10 + 2 FROM {NUM}")
def answer_twins(spark, d):
    lines = _lines(_numbered(spark, d), "concat(p_name, if(p_size % 2 = 0, ' 公考最新资料、x', ''))", "p_name", "concat('other ', rn)")
    return papers.duplicate_answers(lines).select("doc", F.col("pos").cast("long").alias("pos"))


@query(f"SELECT p_brand AS doc, rn * 10 + 5 AS stop_pos, p_type || ' material of the set' || chr(10) || p_name AS material FROM {NUM}")
def material_blocks(spark, d):
    lines = _lines(_numbered(spark, d), "'3. q'", "p_name", "concat(p_type, ' material of the set')", "p_name", "'花生批注：n'", "'【全篇答案】'")
    return papers.materials_before(lines, "全篇答案", f"\\A\\s*\\d{{1,3}}\\s*[.．。]|{im.NOTE}|参考答案|题型分类|实战解析").select("doc", F.col("stop_pos").cast("long").alias("stop_pos"), "material")


@query(f"SELECT p_brand AS doc, rn, CASE WHEN p_size % 3 = 0 THEN 3 ELSE 2 END AS n FROM {NUM}")
def stem_lines(spark, d):
    lines = _lines(_numbered(spark, d), "p_name", "'second'", "if(p_size % 3 = 0, 'B. y', 'A. x')").withColumn("rn", F.expr("pos div 10"))
    return papers.lines_before_options(lines, ["doc", "rn"]).groupBy("doc", "rn").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT p_brand AS doc, rn * 10 AS pos, (rn - 1) // 20 AS section, rn - 1 AS slot FROM {NUM}")
def title_slots(spark, d):
    twice = _numbered(spark, d).select(F.col("p_brand").alias("doc"), F.explode(F.expr("if(p_size % 2 = 0, array(0, 1, 2), array(0))")).alias("i"), "rn")
    titles = twice.select("doc", (F.col("rn") * 10 + F.col("i")).alias("pos"), ((F.col("rn") - 1) % 20 + 1).alias("number"))
    return papers.titled_slots(titles).select("doc", F.col("pos").cast("long").alias("pos"), F.col("section").cast("long").alias("section"), F.col("slot").cast("long").alias("slot"))


# --- labels, types, sources

KINDS = "case p_size % 8 when 0 then concat('支持', p_size) when 1 then '某归因①' when 2 then '增速【难度评价】x' when 3 then '请重新排列' when 4 then '比较 大小' when 5 then concat(p_type, '＋b') when 6 then '相符的是' else p_brand end"


@query("""SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN '支持类' WHEN 1 THEN '归因类' WHEN 2 THEN '增速难度评价x' WHEN 3 THEN '请重新排列' WHEN 4 THEN '比较大小' WHEN 5 THEN p_type || '＋b' WHEN 6 THEN '相符的是' ELSE regexp_replace(p_brand, '[0-9]', '', 'g') END AS logic,
CASE p_size % 8 WHEN 2 THEN '增长率' WHEN 4 THEN '查找比较' ELSE '综合分析' END AS data, CASE p_size % 8 WHEN 3 THEN '语句排序类' WHEN 6 THEN '细节判断类' ELSE '中心理解题' END AS stem,
CASE p_size % 8 WHEN 0 THEN '支持' || p_size WHEN 1 THEN '某归因①' WHEN 2 THEN '增速【难度评价】x' WHEN 3 THEN '请重新排列' WHEN 4 THEN '比较 大小' WHEN 5 THEN p_type WHEN 6 THEN '相符的是' ELSE p_brand END AS main FROM part""")
def type_rules(spark, d):
    raw = F.expr(KINDS)
    return Tables(spark, d).part.select("p_partkey", im.logic_type(raw).alias("logic"), im.data_type(raw).alias("data"), im.stem_type(raw).alias("stem"), im.main_type(raw).alias("main"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '片段阅读' ELSE p_brand END AS source, CASE WHEN p_size % 2 = 0 THEN p_size END AS accuracy FROM part")
def source_headers(spark, d):
    header = F.expr("concat('7．（', if(p_size % 3 = 0, '', p_brand), if(p_size % 2 = 0, concat(' ', p_size, '%'), ''), '）')")
    parsed = im.source_header(header)
    return Tables(spark, d).part.select("p_partkey", parsed["source"].alias("source"), parsed["accuracy"].cast("long").alias("accuracy"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'D' END AS answer FROM part")
def answer_extract(spark, d):
    text = F.expr("if(p_size % 4 = 0, '【参考答案】 a', p_name)")
    prose = F.expr("case p_size % 4 when 0 then '锁定B选项' when 1 then concat(p_name, '，答案只能为 C 选项') when 2 then 'D选项说得对，当选' else p_name end")
    return Tables(spark, d).part.select("p_partkey", im.answer_of(text, prose).alias("answer"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN substr('①②③④', 1, 1 + p_size % 4) WHEN 1 THEN p_name ELSE p_type END AS content FROM part")
def option_clean(spark, d):
    stem = F.expr("concat('将以上 ', 1 + p_size % 4, ' 个句子重新排列')")
    raw = F.expr("case p_size % 3 when 0 then ' ①② ③④ ' when 1 then concat(p_name, '⑤⑥') else concat(p_type, '（片面）') end")
    return Tables(spark, d).part.select("p_partkey", im.clean_option(raw, im.sequence_limit(stem)).alias("content"))


@query("SELECT p_partkey, '甲乙， ' || p_name || '则B选项 C项' AS compact, '【题型分类】' || p_type || '【参考答案】A' AS labels FROM part")
def compact_labels(spark, d):
    compact = fn.compact_text(F.expr("concat('甲 乙 ，　', p_name, '则 B选项 C 项 ')"))
    labels = im.canonical_labels(F.expr("concat('【 题型 分类 】', p_type, '【 参考答案】A')"))
    return Tables(spark, d).part.select("p_partkey", compact.alias("compact"), labels.alias("labels"))


# --- display

@query("SELECT p_partkey, CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 8) || '…' ELSE p_name END AS short, CASE WHEN length(trim(p_name)) < 3 THEN 'short' WHEN length(p_name) > 24 THEN 'long' WHEN contains(p_name, ' ') THEN 'characters' END AS user_error, CASE WHEN p_size % 2 = 0 THEN p_brand || ' · ' || p_type || '专项练习' ELSE '行测综合训练' END AS title FROM part")
def display_texts(spark, d):
    names = F.expr("if(p_size % 2 = 0, array(p_brand), array(p_brand, p_name))")
    return Tables(spark, d).part.select("p_partkey", im.preview(F.col("p_name"), 8).alias("short"), im.user_name_error(F.col("p_name")).alias("user_error"), im.practice_title(names, F.col("p_type")).alias("title"))


@query("SELECT p_partkey, p_size % 3 > 0 AND (p_size % 5 <> 0 OR p_size % 2 = 0) AS image, p_size % 2 = 1 AS material, CASE WHEN p_size * 2 >= 80 THEN 'high' WHEN p_size * 2 >= 60 THEN 'middle' ELSE 'low' END AS band FROM part")
def display_predicates(spark, d):
    material = F.expr("if(p_size % 2 = 1, p_name, '')")
    return Tables(spark, d).part.select("p_partkey", im.image_shown(F.expr("if(p_size % 3 > 0, 'i', null)"), F.expr("if(p_size % 5 = 0, 5, 4)"), material).alias("image"), (material != "").alias("material"), fn.score_band(F.col("p_size") * 2).alias("band"))


@query("SELECT p_partkey, p_size % 6 <> 5 AS noise, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || 'x' END AS kept FROM part")
def page_noise(spark, d):
    line = F.expr("case p_size % 6 when 0 then concat('练习题 ', p_size, ' 套') when 1 then cast(p_size as string) when 2 then '　' when 3 then '片段阅读600（下册）' when 4 then 'Sihai Gong Kao' else p_name end")
    return Tables(spark, d).part.select("p_partkey", im.is_page_noise(line).alias("noise"), im.cut_promotion(F.expr("concat(p_name, if(p_size % 2 = 0, '更新进度微信y', 'x'))")).alias("kept"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN length(p_name) || '-' || length(p_name) + length(p_brand) + 2 ELSE '' END AS ranges FROM part")
def added_ranges(spark, d):
    ranges = im.added_ranges(F.concat("p_name", F.lit("( x )")), F.concat("p_name", F.expr("if(p_size % 2 = 0, concat('（', p_brand, '）'), '')"), F.lit("(x)")))
    return Tables(spark, d).part.select("p_partkey", F.array_join(F.transform(ranges, lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ";").alias("ranges"))


@query("SELECT p_partkey, p_name || '|' || p_brand || chr(10) || 'x' AS runs, substr(p_name || p_brand, 2, 6) AS part, p_name || '[' || p_brand || '__________' AS filled FROM part")
def styled_runs(spark, d):
    run = lambda text, bold, line: F.struct(text.alias("text"), F.lit(bold).alias("bold"), F.lit(line).alias("underline"), F.lit(False).alias("italic"))
    raw = F.array(run(F.concat(F.lit(" \t"), "p_name"), False, False), run(F.col("p_brand"), True, False), run(F.lit("\n\n  x "), True, False))
    flat = F.array(run(F.col("p_name"), False, False), run(F.col("p_brand"), True, False))
    blank = im.insert_run(im.insert_run(flat, F.length("p_name"), run(F.lit("["), True, True)), F.lit(1 << 20), run(F.lit("  "), False, True))
    part = spread(Tables(spark, d).part, "p_partkey")
    return part.select("p_partkey", F.array_join(F.transform(im.normalize_runs(raw), lambda r: r["text"]), "|").alias("runs"), im.run_text(im.slice_runs(flat, F.lit(1), F.lit(7))).alias("part"), im.fill_blanks(blank).alias("filled"))


@query("""SELECT p_partkey, sha256('["' || p_name || '",[{"label":"A","content":"' || p_brand || '"}],"' || p_type || '"]') AS import_key FROM part""")
def import_keys(spark, d):
    options = F.array(F.struct(F.lit("A").alias("label"), F.col("p_brand").alias("content")))
    return spread(Tables(spark, d).part, "p_partkey").select("p_partkey", im.import_key(F.col("p_name"), options, F.col("p_type")).alias("import_key"))


# --- merging and cleaning records

@query("""SELECT a.p_partkey, CASE WHEN b.p_name IS NOT NULL AND b.p_size % 3 <> 0 AND (a.p_size % 5 = 0 OR length(b.p_name) < 1.35 * length(a.p_name || CASE WHEN a.p_size % 5 = 0 THEN '参考答案' ELSE '' END)) THEN b.p_name ELSE a.p_name || CASE WHEN a.p_size % 5 = 0 THEN '参考答案' ELSE '' END END AS stem,
CASE WHEN b.p_name IS NOT NULL AND a.p_size % 2 = 0 THEN 'alternate' ELSE 'own' END AS options FROM part a LEFT JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) b ON b.p_partkey = a.p_partkey + 1""")
def conditional_merge(spark, d):
    part = Tables(spark, d).part
    stem = lambda dirty, tail: F.concat("p_name", F.expr(f"if({dirty}, '{tail}', '')"))
    own = part.select("p_partkey", stem("p_size % 5 = 0", "参考答案").alias("stem"), F.expr(f"array('x', if(p_size % 2 = 0, '{im.PLACEHOLDER}', 'y'), 'z', 'w')").alias("options"))
    alt = part.where("p_partkey % 2 = 0").select((F.col("p_partkey") - 1).alias("p_partkey"), stem("p_size % 3 = 0", "题型分类").alias("alt"), F.expr("array('x', 'y', 'z', 'v')").alias("alt_options"))
    clean, dirty = im.is_uncontaminated(F.col("alt")), ~im.is_uncontaminated(F.col("stem"))
    better = clean & (dirty | (F.length("alt") < F.length("stem") * F.lit(1.35)))
    holes = lambda c: F.size(F.filter(c, lambda x: F.contains(x, F.lit("图形选项"))))
    fuller = (F.size("alt_options") >= 4) & F.forall("alt_options", im.is_uncontaminated) & (holes("alt_options") < holes("options"))
    merged = own.join(alt, "p_partkey", "left")
    stem_of = F.when(better, F.when(clean, F.col("alt"))).otherwise(F.col("stem"))
    return merged.select("p_partkey", stem_of.alias("stem"), F.when(fuller, "alternate").otherwise("own").alias("options"))


@query("SELECT p_partkey, p_name AS stem, CASE WHEN p_size % 6 = 0 THEN 'x' ELSE p_brand END AS option_a, CASE p_size % 3 WHEN 0 THEN '比重' WHEN 1 THEN '增长量' ELSE '综合分析' END AS type FROM part")
def sanitize(spark, d):
    stem = F.expr("if(p_size % 6 = 0, '四海公考', concat(p_name, '   ', '练习题 3 套', p_brand))")
    option = F.expr("if(p_size % 6 = 0, concat(p_name, chr(10), ' A. x'), concat(p_brand, ' 数量关系 600'))")
    clean = lambda c: F.btrim(F.regexp_replace(F.regexp_replace(F.get(F.split(c, im.BRANDING, 2), 0), "[ \\t]+", " "), " *\\n *", "\n"))
    rows = Tables(spark, d).part.select("p_partkey", clean(stem).alias("stem"), clean(option).alias("a"), im.data_type(F.expr("case p_size % 3 when 0 then '比重①' when 1 then '增量【难度评价】高' else p_name end")).alias("type"))
    tail = F.split("a", "\\n\\s*A\\s*[.．、]\\s*", 2)
    return rows.select("p_partkey", F.when(F.col("stem") == "", F.get(tail, 0)).otherwise(F.col("stem")).alias("stem"), F.when(F.col("stem") == "", F.coalesce(F.get(tail, 1), F.lit(""))).otherwise(F.col("a")).alias("option_a"), "type")
