"""Queries that check, sum up, merge and export imported questions; questions are composed from ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import imported as im
from lectern.functions import text as fn
from lectern.operators import audit, bank, merge
from lectern.plans.base import Tables, query
from lectern.sources import records

OPTION = "struct<label:string,content:string>"


def _questions(spark, d) -> DataFrame:
    """id, category, import_key, type, stem, options, answer, explanation, image, missing, score, notes, runs."""
    contents = F.expr("if(p_size % 7 = 0, array('x', if(p_size % 6 = 0, ' ', 'y'), 'z'), array('x', if(p_size % 6 = 0, ' ', 'y'), 'z', p_brand))")
    options = F.transform(contents, lambda x, i: F.struct(F.substring(F.lit("ABCD"), i + 1, F.lit(1)).alias("label"), x.alias("content")))
    notes = F.expr("if(p_size % 3 = 0, cast(array() as array<string>), transform(sequence(1, p_size % 3), i -> concat('note ', i)))")
    runs = F.array(F.struct(F.col("p_name").alias("text"), F.lit(False).alias("bold"), F.expr("p_size % 4 = 0").alias("underline")))
    return Tables(spark, d).part.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"), F.expr("if(p_size % 10 = 0, 'short', sha2(p_name, 256))").alias("import_key"), F.expr("if(p_size % 9 = 0, '', p_type)").alias("type"),
        F.expr("concat(if(p_size % 11 = 0, ' ', p_name), if(p_size % 13 = 0, '参考答案', ''))").alias("stem"), options.alias("options"), F.expr("substring('ABCDE', p_size % 5 + 1, 1)").alias("answer"),
        F.expr("if(p_size % 8 = 0, '', p_name)").alias("explanation"), F.expr("if(p_size % 2 = 0, 'i', null)").alias("image"), F.expr("if(p_size % 7 = 0, array('D'), cast(array() as array<string>))").alias("missing"),
        (F.col("p_size") / 50.0).alias("score"), notes.alias("notes"), runs.alias("runs"),
    )


def _labels(q: str = "options"):
    return F.transform(q, lambda o: o["label"]), F.transform(q, lambda o: o["content"])


BLANK_STEM, NO_ANSWER = "p_size % 11 = 0 AND p_size % 13 <> 0", "p_size % 5 = 4 OR (p_size % 5 = 3 AND p_size % 7 = 0)"
RULES = {"key": "p_size % 10 = 0", "type": "p_size % 9 = 0", "stem": BLANK_STEM, "content": "p_size % 6 = 0", "answer": NO_ANSWER}
RELEASE = {"labels": "p_size % 7 = 0", "answer": NO_ANSWER, "stem": BLANK_STEM, "explanation": "p_size % 8 = 0", "stem dirty": "p_size % 13 = 0", "image": "p_size % 7 = 0 AND p_size % 2 = 1"}


def _union(rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT p_partkey AS id, p_brand AS category, '{rule}' AS rule FROM part WHERE {broken}" for rule, broken in rules.items())


@query(f"SELECT id, rule FROM ({_union(RULES)})")
def rule_violations(spark, d):
    return audit.violations(_questions(spark, d), "id", audit.question_rules(*_labels()))


@query(f"""SELECT category, rule, count(*) AS n, min(id) AS first_id FROM ({_union(RELEASE)}) GROUP BY 1, 2 UNION ALL SELECT p_brand, 'count', count(*), min(p_partkey) FROM part GROUP BY 1 HAVING count(*) <> 80""")
def audit_violations(spark, d):
    questions = _questions(spark, d)
    broken = audit.violations(questions, "id", audit.release_rules(*_labels(), im.CONTAMINATION)).join(questions.select("id", "category"), "id")
    counts = questions.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n <> 80").select("category", F.lit("count").alias("rule"), "n", "first_id")
    return broken.groupBy("category", "rule").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).unionByName(counts)


GATE = " UNION ALL ".join(f"SELECT p_partkey AS id, p_brand AS category, {i} AS i, '{name}' AS error FROM part WHERE {broken}" for i, (name, broken) in enumerate({"options": "p_size % 7 = 0", "stem": BLANK_STEM, "answer": NO_ANSWER, "practical": "p_size % 8 = 0"}.items()))


@query(f"""SELECT category, count(*) AS n, string_agg(id || ':' || error, ';' ORDER BY id, i) FILTER (WHERE r <= 12) AS first FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id, i) AS r FROM ({GATE})) GROUP BY 1""")
def import_gate(spark, d):
    labels, _ = _labels()
    rules = {"options": F.array_join(labels, "") != "ABCD", "stem": F.trim("stem") == "", "answer": ~F.array_contains(labels, F.col("answer")), "practical": F.col("explanation") == ""}
    order = {name: i for i, name in enumerate(rules)}
    place = F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("rule"))
    found = audit.violations(_questions(spark, d).withColumn("at", F.struct("id", "category")), "at", rules).select("at.*", "rule", place.alias("i"))
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy("id", "i")))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 12, F.struct("r", F.concat_ws(":", F.col("id").cast("string"), "rule").alias("e"))))), lambda x: x["e"])
    return ranked.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.array_join(first, ";").alias("first"))


@query(f"""SELECT count(*) FILTER (WHERE p_size % 6 = 0) AS blank_options, count(*) FILTER (WHERE {BLANK_STEM}) AS empty_stems, count(*) FILTER (WHERE p_size % 4 <> 0) AS without_underline, count(*) AS without_break FROM part""")
def preview_checks(spark, d):
    _, contents = _labels()
    blank, underlined = F.exists(contents, lambda x: F.trim(x) == ""), F.exists("runs", lambda r: r["underline"])
    return _questions(spark, d).agg(F.count_if(blank).alias("blank_options"), F.count_if(F.trim("stem") == "").alias("empty_stems"), F.count_if(~underlined).alias("without_underline"), F.count_if(~F.contains("stem", F.lit("\n②"))).alias("without_break"))


@query("""SELECT p_brand AS category, count(*) AS total, count(*) FILTER (WHERE p_size >= 24) AS paired, count(*) FILTER (WHERE p_size % 8 <> 0) AS practical, count(*) FILTER (WHERE p_size % 3 > 0) AS noted, count(*) FILTER (WHERE p_size % 4 = 0) AS underlined, count(*) FILTER (WHERE p_size < 24) AS fallbacks FROM part GROUP BY 1""")
def import_summary(spark, d):
    paired = F.col("score") >= 0.48
    return _questions(spark, d).groupBy("category").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(paired).alias("paired"), F.count_if(F.trim("explanation") != "").alias("practical"), F.count_if(F.size("notes") > 0).alias("noted"),
        F.count_if(F.exists("runs", lambda r: r["underline"])).alias("underlined"), F.count_if(~paired).alias("fallbacks"),
    )


@query("SELECT p_brand AS category, count(*) AS n, count(DISTINCT p_partkey) AS ids, round(min(p_size / 50.0), 4) AS least, sum(p_size % 3)::BIGINT AS notes, count(*) FILTER (WHERE p_size % 2 = 0) AS images FROM part GROUP BY 1")
def quality_report(spark, d):
    return _questions(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.round(F.min("score"), 4).alias("least"), F.sum(F.size("notes")).alias("notes"), F.count("image").alias("images"))


# --- merging

@query("""SELECT p_partkey AS id, p_name || p_partkey AS stem, CASE WHEN p_partkey % 2 = 1 AND p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS answer, CASE WHEN p_partkey % 2 = 0 THEN 'k' || p_partkey WHEN p_partkey % 3 = 0 THEN 's' || p_partkey END AS import_key FROM part
UNION ALL SELECT NULL, p_name || p_partkey, 'new', 's' || p_partkey FROM part WHERE p_partkey % 6 = 0""")
def finalize_append(spark, d):
    part = Tables(spark, d).part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("stem"), F.col("p_brand").alias("options"))
    target = part.select("*", F.lit("old").alias("answer"), F.when(F.expr("id % 2 = 0"), F.concat(F.lit("k"), F.col("id").cast("string"))).alias("import_key"))
    staged = part.where("id % 3 = 0").select("stem", "options", F.lit("new").alias("answer"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("import_key"))
    return merge.finalize_append(target, staged, "import_key", ["stem", "options"], "id", ["answer"]).drop("options")


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'ended' WHEN count(n_nationkey) <> 5 + r_regionkey % 2 THEN 'incomplete' END AS error FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def import_errors(spark, d):
    t = Tables(spark, d)
    received = t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("received"))
    status = F.expr("if(r_regionkey = 2, 'completed', 'uploading')")
    return t.region.join(received, "r_regionkey", "left").select("r_regionkey", merge.import_error(status, F.coalesce("received", F.lit(0)), F.expr("5 + r_regionkey % 2")).alias("error"))


# --- exports

@query("""SELECT 1 AS nth, 'DELETE FROM bank WHERE category = ''' || p_brand || ''';' AS statement FROM (SELECT DISTINCT p_brand FROM part)
UNION ALL SELECT 2, 'INSERT INTO bank (id, stem) VALUES (' || p_partkey || ', ''' || replace(p_name || '''s', '''', '''''') || ''') ON CONFLICT(id) DO UPDATE SET stem = excluded.stem;' FROM part""")
def release_statements(spark, d):
    part = Tables(spark, d).part
    gone = part.select("p_brand").distinct().select(F.lit(1).alias("nth"), audit.delete_statement("bank", F.concat(F.lit("category = "), audit.sql_literal(F.col("p_brand")))).alias("statement"))
    stem = audit.sql_literal(F.concat("p_name", F.lit("'s")))
    return gone.unionByName(part.select(F.lit(2).alias("nth"), audit.upsert_statement("bank", ["id", "stem"], [F.col("p_partkey").cast("string"), stem], "id").alias("statement")))


@query("""SELECT p_brand, '[' || string_agg('{"p_partkey":' || p_partkey || CASE WHEN p_size % 2 = 0 THEN ',"name":"' || p_name || '题"' ELSE '' END || '}', ',' ORDER BY p_partkey) || ']' AS json FROM part GROUP BY 1""")
def json_lists(spark, d):
    rows = Tables(spark, d).part.select("p_brand", "p_partkey", F.when(F.expr("p_size % 2 = 0"), F.concat("p_name", F.lit("题"))).alias("name"))
    return records.as_json_list(rows, "p_brand", "p_partkey")


# --- sources

@query("SELECT p_partkey, p_name FROM part WHERE p_partkey = 7")
def point_lookup(spark, d):
    return bank.lookup_one(Tables(spark, d).part, "p_partkey", 7).select("p_partkey", "p_name")


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'layout' ELSE p_name END AS stem FROM part")
def prefer_source(spark, d):
    part = records.first_existing(spark, f"{d}/part_released.parquet", f"{d}/part.parquet").select("p_partkey", F.col("p_name").alias("stem"), "p_size")
    return records.overlay(part, part.where("p_size % 5 = 0").withColumn("stem", F.lit("layout")), "p_partkey").drop("p_size")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 3 END AS attempts, CASE WHEN event_id % 3 > 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS first FROM events")
def attempt_lists(spark, d):
    raw = F.expr("case event_id % 3 when 0 then concat('[', props) when 1 then concat('[', props, ']') else concat('[', props, ',', props, ']') end")
    attempts = records.json_list(raw, "struct<k:bigint>")
    return Tables(spark, d).events.select("event_id", F.size(attempts).cast("long").alias("attempts"), F.get(attempts, 0)["k"].alias("first"))


VOLUMES = "(SELECT name, row_number() OVER (ORDER BY CASE WHEN contains(name, '上') THEN 0 WHEN contains(name, '下') THEN 1 ELSE 2 END, name) AS nth FROM (SELECT DISTINCT {c} || CASE WHEN substr({c}, length({c})) IN ('1', '3') THEN '上' WHEN substr({c}, length({c})) = '2' THEN '下' ELSE '' END AS name FROM part))"


@query(f"SELECT a.nth AS nth, a.name AS book, b.name AS analysis FROM {VOLUMES.format(c='p_brand')} a JOIN {VOLUMES.format(c='(p_brand || 4)')} b ON a.nth = b.nth")
def volume_pairs(spark, d):
    brands = Tables(spark, d).part.select("p_brand").distinct()
    books = brands.select(F.expr("concat(p_brand, case when right(p_brand, 1) in ('1', '3') then '上' when right(p_brand, 1) = '2' then '下' else '' end)").alias("name"))
    return records.pair_volumes(books, brands.select(F.concat("p_brand", F.lit("4")).alias("name")))


# --- orders, pools, rollups

@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS listed, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey DESC) AS updated, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS created FROM part")
def bank_orders(spark, d):
    over = lambda *order: Window.partitionBy("p_brand").orderBy(*order)
    listed, updated = F.row_number().over(over("p_size", "p_partkey")), F.row_number().over(over(F.desc("p_retailprice"), F.desc("p_partkey")))
    return Tables(spark, d).part.select("p_partkey", listed.alias("listed"), updated.alias("updated"), F.rank().over(over(F.desc("p_size"))).alias("created"))


@query("""SELECT p_brand, label, sum(n)::BIGINT AS n, string_agg(raw, ',' ORDER BY raw) AS types FROM (SELECT p_brand, raw, count(*) AS n, CASE raw WHEN '中心理解题①' THEN '中心理解题' WHEN '中心理解2' THEN '中心理解题' WHEN '' THEN '片段阅读' ELSE raw END AS label FROM (
SELECT p_brand, CASE p_size % 4 WHEN 0 THEN '中心理解题①' WHEN 1 THEN '中心理解2' WHEN 2 THEN '' ELSE p_type END AS raw FROM part) GROUP BY 1, 2) GROUP BY 1, 2""")
def type_rollup(spark, d):
    raw = F.expr("case p_size % 4 when 0 then '中心理解题①' when 1 then '中心理解2' when 2 then '' else p_type end")
    counts = Tables(spark, d).part.groupBy("p_brand", raw.alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    rolled = counts.groupBy("p_brand", fn.clean_type(F.col("raw")).alias("label"))
    return rolled.agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list("raw")), ",").alias("types"))


PLACES = "(SELECT {id}, row_number() OVER (ORDER BY {id}) - 1 AS at, count(*) OVER () AS n FROM {t})"


@query(f"SELECT a.item_id AS item_id, count(*) AS n, min(b.doc_id) AS first_doc FROM {PLACES.format(id='item_id', t='benchmark')} a JOIN {PLACES.format(id='doc_id', t='documents')} b ON b.at BETWEEN a.at * b.n // a.n - 35 AND a.at * b.n // a.n + 36 GROUP BY 1")
def proportional_pool(spark, d):
    t = Tables(spark, d)
    n, m = t.documents.count(), max(t.benchmark.count(), 1)
    items = bank.numbered(t.benchmark.select("item_id"), "item_id", "at").withColumn("at", F.floor((F.col("at") - 1) * n / m))
    docs = bank.numbered(t.documents.select("doc_id"), "doc_id", "place").withColumn("place", F.col("place") - 1)
    # a range join as an equi join on buckets of the pool's width
    spread = items.withColumn("b", F.explode(F.expr("sequence(floor((at - 35) / 72), floor((at + 36) / 72))")))
    met = spread.join(docs.withColumn("b", F.floor(F.col("place") / 72)), "b").where("place between at - 35 and at + 36")
    return met.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("SELECT p_partkey, round_even(p_size / 4.0, 0) AS half_even, floor(p_size / 4.0 + 0.5)::BIGINT AS half_up FROM part")
def roundings(spark, d):
    quarter = F.col("p_size") / 4
    return Tables(spark, d).part.select("p_partkey", fn.round_half_even(quarter).alias("half_even"), fn.round_half_up(quarter).alias("half_up"))


CONTROL = "'a' || chr(7) || chr(31) || chr(10) || text"


@query(f"SELECT doc_id, sha256('[' || replace(to_json({CONTROL}), '001F', '001f') || ',' || to_json(lang) || ',' || to_json(source) || ']') AS content_key FROM documents")
def content_key(spark, d):
    text = F.concat(F.lit("a\x07\x1f\n"), "text")
    return Tables(spark, d).documents.select("doc_id", F.sha2(im.json_text(F.to_json(F.array(text, F.col("lang"), F.col("source")))), 256).alias("content_key"))
