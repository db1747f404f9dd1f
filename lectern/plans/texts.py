"""Queries on text: normalising, labels, similarity, audits and exports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as fn
from lectern.operators import audit, grams, matching, segment, similarity as sim
from lectern.plans.base import Tables, query


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\t\\r\\f\\x0B\\x{3000}\\x{A0}]', ' ', 'g'), ' +', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')) AS h FROM documents")
def normalize_space(spark, d):
    return Tables(spark, d).documents.select("doc_id", F.md5(fn.normalize_space(F.col("text"))).alias("h"))


@query("SELECT doc_id, md5(lower(regexp_replace(text, '[^0-9A-Za-z\\x{3400}-\\x{9fff}]', '', 'g'))) AS h FROM documents")
def match_key(spark, d):
    return Tables(spark, d).documents.select("doc_id", F.md5(fn.match_key(F.col("text"))).alias("h"))


@query("SELECT page_id, trim(string_split(html, '<body')[1]) AS head FROM pages")
def artifact_cut(spark, d):
    return Tables(spark, d).pages.select("page_id", fn.cut_at(F.col("html"), "<body").alias("head"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '中心理解题' WHEN 1 THEN '标题拟定类' WHEN 2 THEN p_brand ELSE '片段阅读' END AS label FROM (SELECT p_partkey, p_size, 'x' || regexp_replace(p_brand, '[0-9]+$', '') AS p_brand FROM part)")
def type_clean(spark, d):
    raw = F.expr("case p_size % 4 when 0 then '中心理解题①' when 1 then '标题' when 2 then concat('x', p_brand) else '' end")
    return Tables(spark, d).part.select("p_partkey", fn.clean_type(raw).alias("label"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'R' WHEN contains(p_name, 'blue') THEN 'B' WHEN contains(p_name, 'a') THEN 'A' ELSE 'none' END AS label FROM part")
def keyword_bucket(spark, d):
    return Tables(spark, d).part.select("p_partkey", fn.bucket_by_keyword(F.col("p_name"), [("red", "R"), ("blue", "B"), ("a", "A")], "none").alias("label"))


@query("SELECT doc_id, CAST(regexp_extract(text, '([0-9]{1,3})%', 1) AS INTEGER) AS pct FROM documents WHERE regexp_matches(text, '[0-9]%')")
def extract_number(spark, d):
    return Tables(spark, d).documents.where("rlike(text, '[0-9]%')").select("doc_id", fn.percent_in(F.col("text")).alias("pct"))


@query("SELECT p_partkey, CAST(CASE p_size % 3 WHEN 0 THEN 12 WHEN 1 THEN 10 ELSE p_size END AS INTEGER) AS marker FROM part")
def char_map_numbers(spark, d):
    raw = F.expr("case p_size % 3 when 0 then '①②' when 1 then '⑩' else cast(p_size as string) end")
    return Tables(spark, d).part.select("p_partkey", fn.marker_number(raw).alias("marker"))


@query("SELECT p_partkey, 'A=' || p_brand || ',B=' || p_type || ',C=' || p_size AS options FROM part")
def index_to_label(spark, d):
    options = F.transform(F.array("p_brand", "p_type", F.col("p_size").cast("string")), lambda x, i: F.concat(F.chr(F.lit(65) + i), F.lit("="), x))
    return Tables(spark, d).part.select("p_partkey", F.array_join(options, ",").alias("options"))


@query("SELECT p_partkey, '1=A,2=' || CASE WHEN p_size > 25 THEN 'B' ELSE 'x' END || ',3=' AS answers FROM part")
def map_put(spark, d):
    start = F.map_from_arrays(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit("A"), F.lit("x"), F.lit("")))
    put = F.transform_values(start, lambda k, v: F.when((k == 2) & (F.col("p_size") > 25), "B").otherwise(v))
    return Tables(spark, d).part.select("p_partkey", F.array_join(F.transform(F.map_entries(put), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ",").alias("answers"))


LINES = """(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"""
NOISE = "trim(line) = '' OR regexp_matches(line, '^[0-9]{1,3}$') OR regexp_matches(line, '^(The|Les)[ .]')"


@query(f"SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM {LINES} WHERE NOT ({NOISE}) GROUP BY 1")
def stream_assemble(spark, d):
    kept = segment.lines_of(Tables(spark, d).documents).where(~audit.is_noise(F.col("line"), ["(The|Les)[ .]"]))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))


@query(f"SELECT doc_id, count(*) FILTER (WHERE {NOISE}) AS noise, count(*) AS n FROM {LINES} GROUP BY 1")
def noise_lines(spark, d):
    return segment.lines_of(Tables(spark, d).documents).groupBy("doc_id").agg(F.count_if(audit.is_noise(F.col("line"), ["(The|Les)[ .]"])).alias("noise"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, NOT regexp_matches(text, 'token|password|@') AND trim(text) <> '' AS clean FROM documents")
def contamination_flag(spark, d):
    return Tables(spark, d).documents.select("doc_id", audit.is_clean(F.col("text"), "token|password|@").alias("clean"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '(' || p_brand || ')' ELSE '' END AS added FROM part")
def added_parentheticals(spark, d):
    annotated = F.concat("p_name", F.lit(" (x)"), F.expr("if(p_size % 2 = 0, concat('(', p_brand, ')'), '')"))
    added = fn.added_parentheticals(F.concat("p_name", F.lit(" ( x )")), annotated)
    return Tables(spark, d).part.select("p_partkey", F.array_join(added, "|").alias("added"))


# --- similarity

KEYS = "SELECT {id}, {block} AS block, {key} AS k FROM {t}"
WHOLE_KEY = "lower(regexp_replace(text, '[^0-9A-Za-z\\x{3400}-\\x{9fff}]', '', 'g'))"
GRAMS = "(SELECT {id}, block, k, substr(k, CAST(i AS BIGINT), 2) AS g, count(*) AS n FROM (SELECT *, unnest(generate_series(1, greatest(length(k) - 1, 1))) AS i FROM ({keys}) WHERE k <> '') GROUP BY ALL)"


def _scores_sql(left: str = "''", right: str = "''", window: int | None = 800) -> str:
    """Scores of all pairs of an item and a document, or those of one block, by the first characters of their keys or all."""
    key = f"substr({WHOLE_KEY}, 1, {window})" if window else WHOLE_KEY
    a = GRAMS.format(id="item_id", keys=KEYS.format(id="item_id", block=left, key=key, t="benchmark"))
    b = GRAMS.format(id="doc_id", keys=KEYS.format(id="doc_id", block=right, key=key, t="documents"))
    return f"""(SELECT item_id, doc_id, round(CASE WHEN a.k = b.k THEN 1.0 ELSE 2.0 * sum(least(a.n, b.n)) / greatest(1, length(any_value(a.k)) + length(any_value(b.k)) - 2) END::DOUBLE, 9) AS score
FROM {a} a JOIN {b} b ON a.g = b.g AND a.block = b.block GROUP BY item_id, doc_id, a.k, b.k)"""


SCORES, BLOCK = _scores_sql(), "'src' || item_id % 20"
BLOCKED = _scores_sql(BLOCK, "source")
WHOLE_SCORES, WHOLE_BLOCKED = _scores_sql(window=None), _scores_sql(BLOCK, "source", window=None)
BEST = "(SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn, max(score) OVER (PARTITION BY item_id) AS top FROM {s})"


def _scores(spark, d, **kept):
    t = Tables(spark, d)
    return sim.dice_multiset(t.benchmark, t.documents, "item_id", "doc_id", "text", **kept).withColumn("score", F.round("score", 9))


def _blocked(spark, d, **kept):
    """Items meet the documents of one source only."""
    t = Tables(spark, d)
    items = t.benchmark.withColumn("source", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")))
    return sim.dice_multiset(items, t.documents, "item_id", "doc_id", "text", block="source", **kept).withColumn("score", F.round("score", 9))


@query(f"SELECT item_id, count(*) AS pairs, round(max(score), 6) AS best FROM {SCORES} GROUP BY 1")
def dice_multiset(spark, d):
    return _scores(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.max("score"), 6).alias("best"))


@query(f"SELECT item_id, doc_id, round(score, 6) AS score FROM {BEST.format(s=WHOLE_BLOCKED)} WHERE rn = 1")
def similarity_best_match(spark, d):
    return sim.best_match(_blocked(spark, d, best=1, window=None), "item_id", "doc_id").select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT item_id, CASE WHEN score >= 0.48 THEN doc_id ELSE item_id END AS partner, score >= 0.48 AS accepted FROM {BEST.format(s=WHOLE_BLOCKED)} WHERE rn = 1")
def similarity_fallback(spark, d):
    paired = sim.accept(_blocked(spark, d, best=1, near=sim.NEAR, window=None), "item_id", "doc_id")
    return paired.select("item_id", F.when(F.col("accepted"), F.col("doc_id")).otherwise(F.col("item_id")).alias("partner"), "accepted")


@query(f"SELECT item_id, count(*) AS near, min(doc_id) AS first_doc FROM {BEST.format(s=WHOLE_SCORES)} WHERE score >= top - 0.08 GROUP BY 1")
def assign_with_tolerance(spark, d):
    near = sim.accept(_scores(spark, d, best=1, near=sim.NEAR, window=None), "item_id", "doc_id")
    return near.select("item_id", F.size("alike").cast("long").alias("near"), F.array_min("alike").alias("first_doc"))


@query(f"""SELECT item_id, first(source ORDER BY rn) AS source FROM (SELECT r.*, nullif(CASE WHEN d.n_chars % 2 = 0 THEN '' ELSE lang END, '') AS source FROM {BEST.format(s=BLOCKED)} r JOIN documents d USING (doc_id)) WHERE score >= top - 0.08 AND source IS NOT NULL GROUP BY 1""")
def backfill_first_nonnull(spark, d):
    alike = sim.accept(_blocked(spark, d, best=1, near=sim.NEAR), "item_id", "doc_id").select("item_id", F.posexplode("alike").alias("rn", "doc_id"))
    named = alike.join(Tables(spark, d).documents.select("doc_id", F.expr("if(n_chars % 2 = 0, '', lang)").alias("source")), "doc_id").where("source <> ''")
    return named.groupBy("item_id").agg(F.min_by("source", "rn").alias("source"))


def _sets_sql(size: int, stop: str = "''", window: int | None = None) -> str:
    """Tables a (items) and b (documents) of distinct grams with their counts."""
    text = {"benchmark": f"substr(text, 1, {window})" if window else "text", "documents": "text"}
    side = lambda i, t: f"""(SELECT *, count(*) OVER (PARTITION BY {i}) AS n FROM (SELECT DISTINCT {i}, substr(k, CAST(p AS BIGINT), {size}) AS g
FROM (SELECT {i}, k, unnest(generate_series(1, length(k) - {size - 1})) AS p FROM (SELECT {i}, regexp_replace({text[t]}, '[^0-9A-Za-z\\x{{3400}}-\\x{{9fff}}]', '', 'g') AS k FROM {t}))) WHERE g NOT IN ({stop}))"""  # noqa: E731
    return f"{side('item_id', 'benchmark')} a JOIN {side('doc_id', 'documents')} b ON a.g = b.g"


def _shared(spark, d, keep, **how):
    t = Tables(spark, d)
    return grams.shared_grams(t.benchmark, t.documents, "item_id", "doc_id", keep, **how)


@query(f"SELECT item_id, doc_id, round(2.0 * count(*) / (any_value(a.n) + any_value(b.n)), 6) AS score FROM {_sets_sql(2)} GROUP BY ALL HAVING 2.0 * count(*) >= 0.5 * (any_value(a.n) + any_value(b.n))")
def dice_set(spark, d):
    """All pairs of an item and a document of at least 0.5."""
    return _shared(spark, d, grams.dice_at_least(0.5)).select("item_id", "doc_id", F.round(2.0 * F.col("shared") / (F.col("item_grams") + F.col("doc_grams")), 6).alias("score"))


@query(f"SELECT item_id, doc_id, round(count(*)::DOUBLE / any_value(a.n), 6) AS share FROM {_sets_sql(2)} GROUP BY ALL HAVING count(*) >= 0.9 * any_value(a.n)")
def gram_containment(spark, d):
    """All documents that have nine tenths of an item's bigrams."""
    return _shared(spark, d, grams.contained_at_least(0.9)).select("item_id", "doc_id", F.round(F.col("shared") / F.col("item_grams"), 6).alias("share"))


@query(f"""SELECT item_id, count(*) AS near, min(doc_id) AS first_doc FROM (SELECT item_id, doc_id FROM {_sets_sql(2, "'th', 'he'", 180)} GROUP BY ALL HAVING count(*) >= 2
UNION SELECT item_id, doc_id FROM {_sets_sql(3, window=180)}) GROUP BY 1""")
def distinctive_overlap(spark, d):
    near = _shared(spark, d, grams.distinctive, sizes=(2, 3), window=180, stop=("th", "he"))
    return near.groupBy("item_id").agg(F.count(F.lit(1)).alias("near"), F.min("doc_id").alias("first_doc"))


def _closest(spark, d, n: int = 5, **kept):
    """The ``n`` documents of the best multiset Dice of each item, with both match keys."""
    t = Tables(spark, d)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    best = _scores(spark, d, best=n, **kept).withColumn("rn", rank).where(F.col("rn") <= n).select("item_id", "doc_id")
    key = fn.match_key(F.col("text"))
    return best.join(t.benchmark.select("item_id", key.alias("left")), "item_id").join(t.documents.select("doc_id", key.alias("right")), "doc_id")


@query()
def sequence_ratio(spark, d):
    """The matching-block ratio of the first 800 characters of each item and of the five documents most like it."""
    cut = [F.substring(c, 1, sim.WINDOW).alias(c) for c in ("left", "right")]
    return matching.block_ratio(_closest(spark, d).select("item_id", "doc_id", *cut), "left", "right").select("item_id", "doc_id", F.round("ratio", 6).alias("ratio"))


@query()
def note_score(spark, d):
    """An item as a note: the ratio of it and a document, both whole, and the share of its bigrams that the document has."""
    pairs = _closest(spark, d, window=None)
    scored = matching.block_ratio(pairs.withColumn("share", sim.gram_containment(F.col("left"), F.col("right"))), "left", "right")
    return scored.select("item_id", "doc_id", F.round(F.col("ratio") + F.col("share"), 6).alias("score"))


NORMAL = "lower(regexp_replace({c}, '[^0-9A-Za-z\\x{{3400}}-\\x{{9fff}}]', '', 'g'))"


@query(f"""SELECT item_id, count(*) AS hits, min(doc_id) AS first_doc, max(least(length(p), CASE WHEN contains(k, substr(p, 1, 32)) THEN 32 WHEN contains(k, substr(p, 1, 24)) THEN 24 ELSE 18 END)) AS matched
FROM (SELECT item_id, {NORMAL.format(c='text')} AS p FROM benchmark) JOIN (SELECT doc_id, {NORMAL.format(c='text')} AS k FROM documents) ON contains(k, substr(p, 1, 18)) WHERE length(p) >= 12 GROUP BY 1""")
def probe_containment(spark, d):
    t = Tables(spark, d)
    return sim.probe(t.benchmark, t.documents, "item_id", "doc_id").groupBy("item_id").agg(F.count(F.lit(1)).alias("hits"), F.min("doc_id").alias("first_doc"), F.max("matched").cast("long").alias("matched"))


@query("SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS longest, arg_min(doc_id, (n_chars, doc_id)) AS shortest FROM documents GROUP BY 1")
def argmax_pick(spark, d):
    return Tables(spark, d).documents.groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("longest"), F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("shortest"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN p_type ELSE p_name END AS content FROM part")
def priority_pick(spark, d):
    part = Tables(spark, d).part
    offers = part.select("p_partkey", F.posexplode(F.array(F.expr("if(p_size % 3 = 0, p_brand, '')"), F.expr("if(p_size % 3 = 1, p_type, null)"), F.col("p_name"))).alias("prio", "content"))
    return offers.where("content <> ''").groupBy("p_partkey").agg(F.min_by("content", "prio").alias("content"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1")
def compose_text(spark, d):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return Tables(spark, d).conversations.groupBy("conv_id").agg(F.array_join(turns, "\n\n").alias("body"))


@query("SELECT source, string_agg(doc_id, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY 1")
def group_to_list(spark, d):
    ids = F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string"))
    return Tables(spark, d).documents.groupBy("source").agg(F.array_join(ids, ",").alias("ids"))


# --- audits

@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, sum(len(string_split(text, chr(10))))::BIGINT AS lines, count(*) FILTER (WHERE contains(text, '|')) AS piped FROM documents GROUP BY 1")
def audit_profile(spark, d):
    return Tables(spark, d).documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.sum(F.size(F.split("text", "\n"))).alias("lines"), F.count_if(F.contains("text", F.lit("|"))).alias("piped"))


@query("SELECT i AS id, 'missing' AS side FROM (SELECT unnest(generate_series(0, 599)) AS i) WHERE i NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM labels WHERE doc_id > 599")
def idset_diff(spark, d):
    return audit.id_difference(spark.range(600), Tables(spark, d).labels.select(F.col("doc_id").alias("id")), "id")


# --- exports

@query("SELECT 'INSERT INTO part VALUES (' || p_partkey || ', ''' || replace(p_name, '''', '''''') || ''');' AS statement FROM part")
def sql_literal_export(spark, d):
    return Tables(spark, d).part.select(audit.insert_statement("part", [F.col("p_partkey").cast("string"), audit.sql_literal(F.col("p_name"))]).alias("statement"))


@query("SELECT p_partkey || chr(9) || CASE p_brand WHEN 'Brand#11' THEN 'a' ELSE 'b' END || chr(9) || p_name || '.png' AS line FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') AND p_size > 10")
def manifest_tsv(spark, d):
    folder = F.try_element_at(F.create_map(F.lit("Brand#11"), F.lit("a"), F.lit("Brand#12"), F.lit("b")), F.col("p_brand"))
    rows = Tables(spark, d).part.where("p_size > 10").withColumn("folder", folder).where("folder is not null")
    return rows.select(F.concat_ws("\t", F.col("p_partkey").cast("string"), "folder", F.concat("p_name", F.lit(".png"))).alias("line"))
