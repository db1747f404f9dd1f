"""Queries that read the bank: joins, counts, lookups, filters and samples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import paths
from lectern.functions import text as fn
from lectern.operators import bank
from lectern.plans.base import Tables, query


@query("""SELECT n.n_nationkey, n.n_name, count(s.s_suppkey) AS n FROM nation n
LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000 GROUP BY 1, 2""")
def left_join_on_filter(spark, d):
    t = Tables(spark, d)
    counts = t.supplier.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("s_suppkey").alias("n"))
    return t.nation.join(counts, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT r_name, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey < 3 GROUP BY r_regionkey, r_name")
def left_join_count(spark, d):
    t = Tables(spark, d)
    return t.region.join(t.nation.where("n_nationkey < 3"), F.expr("n_regionkey = r_regionkey"), "left").groupBy("r_regionkey", "r_name").agg(F.count("n_nationkey").alias("n")).drop("r_regionkey")


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
def dim_join(spark, d):
    t = Tables(spark, d)
    return t.customer.where("c_mktsegment = 'BUILDING'").join(t.nation, F.expr("c_nationkey = n_nationkey")).select("c_custkey", "c_name", "n_name")


@query("SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY 1, 2")
def type_counts(spark, d):
    counts = Tables(spark, d).part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type")))


@query("""SELECT e.event_id, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey
WHERE e.event_type = 'purchase' AND e.ts > TIMESTAMP '2024-01-02' AND c.c_acctbal > 0""")
def session_join(spark, d):
    t = Tables(spark, d)
    live = t.events.where("event_type = 'purchase' and ts > timestamp_ntz'2024-01-02 00:00:00'")
    return live.join(t.customer.where("c_acctbal > 0"), F.expr("user_id = c_custkey")).select("event_id", "c_name")


IDS = [7, 3, 999999999, 7, 11, 3, 5]


@query("""SELECT CAST(pos - 1 AS INTEGER) AS pos, p_partkey, p_name FROM (
SELECT unnest([7, 3, 999999999, 11, 5]) AS id, unnest([1, 2, 3, 4, 5]) AS pos) JOIN part ON p_partkey = id""")
def ordered_lookup(spark, d):
    return bank.lookup_ordered(Tables(spark, d).part, "p_partkey", IDS).select("pos", "p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IS NOT NULL AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1 AND l_quantity > 45)")
def exists_semi(spark, d):
    t = Tables(spark, d)
    return t.orders.where("o_orderstatus is not null").join(t.lineitem.where("l_linenumber = 1 and l_quantity > 45"), F.expr("l_orderkey = o_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT p_partkey FROM part a WHERE a.p_partkey >= 100 AND EXISTS (SELECT 1 FROM part b WHERE b.p_partkey < 100 AND b.p_brand = a.p_brand AND b.p_type = a.p_type)")
def semi_two_key(spark, d):
    part = Tables(spark, d).part
    return part.where("p_partkey >= 100").join(part.where("p_partkey < 100").select("p_brand", "p_type"), ["p_brand", "p_type"], "left_semi").select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_size IN (1, 5, 9) AND p_brand IN ('Brand#11', 'Brand#23')")
def filtered_inlist(spark, d):
    part = bank.filter_in(Tables(spark, d).part, "p_size", [1, 5, 9])
    return bank.filter_in(part, "p_brand", ["Brand#11", "Brand#23"], empty_means_all=True).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE instr(lower(p_name), 'red') > 0 OR contains(p_brand, '#11')")
def admin_search(spark, d):
    return Tables(spark, d).part.where("instr(lower(p_name), 'red') > 0 or contains(p_brand, '#11')").select("p_partkey", "p_name")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE p_size > 25) AS large, count(*) FILTER (WHERE p_retailprice < 1000) AS cheap, count(DISTINCT p_brand) AS brands FROM part")
def admin_stats(spark, d):
    return Tables(spark, d).part.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr("p_size > 25")).alias("large"), F.count_if(F.expr("p_retailprice < 1000")).alias("cheap"), F.count_distinct("p_brand").alias("brands"))


@query("SELECT count(*) FILTER (WHERE p_brand IN ('Brand#11', 'Brand#12')) AS available, greatest(1, least(100, count(*) FILTER (WHERE p_brand IN ('Brand#11', 'Brand#12')), 30)) AS granted FROM part")
def availability_clamp(spark, d):
    available = F.count_if(F.col("p_brand").isin("Brand#11", "Brand#12"))
    return Tables(spark, d).part.agg(available.alias("available"), F.greatest(F.lit(1), F.least(F.lit(100), available, F.lit(30))).alias("granted"))


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY md5('s1:' || p_partkey), p_partkey) AS rn FROM part) WHERE rn <= 20")
def seeded_sample(spark, d):
    return bank.sample(Tables(spark, d).part, "p_partkey", 20, "s1").select("p_partkey")


GROUPS = "WITH g AS (SELECT grp FROM (SELECT DISTINCT (p_partkey - 1) // 5 AS grp FROM {from_}) ORDER BY md5('s2:' || grp), grp LIMIT 3)"


@query(GROUPS.format(from_="part WHERE p_partkey > 0") + " SELECT p_partkey, (p_partkey - 1) // 5 AS grp FROM part WHERE p_partkey > 0 AND (p_partkey - 1) // 5 IN (SELECT grp FROM g) ORDER BY grp, p_partkey LIMIT 12")
def group_sample(spark, d):
    part = Tables(spark, d).part.where("p_partkey > 0")
    return bank.sample_groups(part, "p_partkey", "p_partkey", 12, "s2").select("p_partkey", "grp")


@query(GROUPS.format(from_="part WHERE p_partkey > 0 AND p_size > 10") + " SELECT p_partkey, (p_partkey - 1) // 5 AS grp FROM part WHERE p_partkey > 0 AND p_size > 10 AND (p_partkey - 1) // 5 IN (SELECT grp FROM g)")
def group_sample_whole(spark, d):
    part = Tables(spark, d).part.where("p_partkey > 0 and p_size > 10")
    return bank.sample_groups(part, "p_partkey", "p_partkey", 12, "s2", whole=True).select("p_partkey", "grp")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def json_group(spark, d):
    return Tables(spark, d).events.groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"z":{"y":[1,"b"]},"seen":["a","b"],"n":' || event_id || '}' AS props FROM events""")
def json_set(spark, d):
    events = Tables(spark, d).events.withColumn("props", F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"z":{"y":[1,"b"]},"seen":0}')))
    return events.select("event_id", fn.json_put(F.col("props"), {"seen": F.lit('["a","b"]'), "n": F.col("event_id").cast("string")}).alias("props"))


@query("SELECT p_partkey, json_valid(CASE WHEN p_size % 3 = 0 THEN '{\"a\":' || p_size || '}' WHEN p_size % 3 = 1 THEN '{\"a\":' ELSE '[1,2' || ']' END) AS ok FROM part")
def json_valid(spark, d):
    raw = F.expr("""case when p_size % 3 = 0 then concat('{"a":', p_size, '}') when p_size % 3 = 1 then '{"a":' else '[1,2]' end""")
    return Tables(spark, d).part.select("p_partkey", F.try_parse_json(raw).isNotNull().alias("ok"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN NULL ELSE
'[{"content":"' || p_name || '","label":"A"},{"content":"' || p_type || '","label":"B"},{"content":' || p_size || ',"label":"C"}'
|| CASE WHEN p_size % 4 = 0 THEN '' ELSE ',{"content":"' || CASE WHEN p_size > 10 THEN p_brand || ' patched' ELSE p_brand END || '","label":"D"}' END
|| CASE WHEN p_size % 4 = 2 THEN ',"E"' ELSE '' END || ']' END AS options FROM part""")
def json_array_patch(spark, d):
    parts = Tables(spark, d).part
    raw = F.expr("""case p_size % 4 when 3 then '[{"label":' else concat('[{"label":"A","content":"', p_name, '"},{"label":"B", "content":"', p_type, '"},{"label":"C","content":', p_size, '}',
        if(p_size % 4 = 0, '', concat(',{"label":"D","content":"', p_brand, '"}')), if(p_size % 4 = 2, ',"E"', ''), ']') end""")
    # a place that is not there (three options only) must not come to be: its guard is the predicate of the repair
    patched = paths.json_write(raw, {"$[3].content": F.concat("p_brand", F.lit(" patched"))})
    return parts.select("p_partkey", F.when((F.col("p_size") > 10) & (F.col("p_size") % 4 != 0), patched).otherwise(paths.json_write(raw, {})).alias("options"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"k":' || k || ',"page":{"keys":["a","' || event_type || '"],"n":' || user_id || '}}'
WHEN 1 THEN '{"k":' || k || ',"page":{"keys":[{"type":"' || event_type || '","x":1},"b","' || event_type || '"],"n":' || user_id || '}}'
WHEN 2 THEN '{"k":' || k || ',"page":{"keys":"none","n":' || user_id || '}}' ELSE '{"k":' || k || ',"page":7}' END AS props
FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""")
def json_path_set(spark, d):
    k = F.get_json_object("props", "$.k")
    page = F.expr("""case event_id % 4 when 0 then '"page":{"keys":["a"]},' when 1 then '"page":{"keys":[{"x":1},"b"]},' when 2 then '"page":{"n":0,"keys":"none"},' else '"page":7,' end""")
    doc = F.concat(F.lit("{"), page, F.lit('"k":'), k, F.lit("}"))
    writes = {"$.page.keys[#]": F.col("event_type"), "$.page.n": F.col("user_id"), "$.page.keys[0].type": F.col("event_type"), "$.page.keys[9]": F.lit("beyond")}
    return Tables(spark, d).events.select("event_id", paths.json_write(doc, writes).alias("props"))


@query("SELECT p_partkey, 'brand=' || p_brand || ';size=' || p_size AS entries FROM part")
def map_entries(spark, d):
    entries = F.map_entries(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")))
    return Tables(spark, d).part.select("p_partkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("entries"))


@query("""SELECT p_partkey, len(string_split(p_name, ' ')) AS n, array_to_string(list_reverse(list_transform(string_split(p_name, ' '), lambda w: upper(w))), '-') AS back,
len(list_filter(string_split(p_name, ' '), lambda w: contains(w, 'e'))) > 0 AS some_e, len(list_filter(string_split(p_name, ' '), lambda w: NOT contains(w, 'e'))) = 0 AS every_e, list_contains(string_split(p_name, ' '), 'red') AS red FROM part""")
def array_hof(spark, d):
    words = F.split("p_name", " ")
    has_e = lambda w: F.contains(w, F.lit("e"))
    return Tables(spark, d).part.select("p_partkey", F.size(words).cast("long").alias("n"), F.array_join(F.reverse(F.transform(words, F.upper)), "-").alias("back"), F.exists(words, has_e).alias("some_e"), F.forall(words, has_e).alias("every_e"), F.array_contains(words, "red").alias("red"))


@query("SELECT p_partkey, 'A=' || p_brand || ';B=' || p_type || ';C=' || CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE 'rich' END || ';D=' AS options FROM part")
def option_normalize(spark, d):
    part = Tables(spark, d).part
    stored = F.create_map(F.lit("A"), "p_brand", F.lit("B"), "p_type", F.lit("C"), F.when(F.expr("p_size % 2 = 0"), F.col("p_size").cast("string")).otherwise("【x】"))
    rich = F.create_map(F.lit("C"), F.lit("rich"))
    clean = lambda x: F.when(x.isNotNull() & (x != "") & ~F.contains(x, F.lit("【")), x)
    labels = F.array(*[F.lit(x) for x in "ABCD"])
    content = F.transform(labels, lambda k: F.concat(k, F.lit("="), F.coalesce(clean(F.try_element_at(stored, k)), F.try_element_at(rich, k), F.lit(""))))
    return part.select("p_partkey", F.array_join(content, ";").alias("options"))


BANKS = """(SELECT p_partkey, p_name || ' v1' AS name, 1 AS prio FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, p_name, 2 FROM part)"""


def _banks(part):
    return part.where("p_partkey % 3 = 0").select("p_partkey", F.concat("p_name", F.lit(" v1")).alias("name"), F.lit(1).alias("prio")).unionByName(part.select("p_partkey", F.col("p_name").alias("name"), F.lit(2).alias("prio")))


@query(f"SELECT p_partkey, arg_min(name, prio) AS name FROM {BANKS} GROUP BY 1")
def bank_first_wins(spark, d):
    return bank.first_wins(_banks(Tables(spark, d).part), ["p_partkey"], F.col("prio")).select("p_partkey", "name")


@query(f"SELECT p_partkey, arg_max(name, prio) AS name FROM {BANKS} GROUP BY 1")
def bank_last_wins(spark, d):
    return bank.first_wins(_banks(Tables(spark, d).part), ["p_partkey"], F.desc("prio")).select("p_partkey", "name")


@query(f"SELECT prio, count(*) AS n, count(DISTINCT p_partkey) AS ids FROM {BANKS} GROUP BY 1")
def union_banks(spark, d):
    return _banks(Tables(spark, d).part).groupBy("prio").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_partkey").alias("ids"))


def _refresh(lineitem, part):
    items = lineitem.select("l_orderkey", "l_partkey").distinct()
    named = lambda rows, c: rows.select(F.col("p_partkey").alias("l_partkey"), F.col(c).alias("name"))
    return bank.refresh_snapshots(items, named(part.where("p_partkey % 3 = 0"), "p_brand"), named(part.where("p_partkey % 2 = 0"), "p_name"), "l_partkey", "name").select("l_orderkey", "l_partkey", "name")


@query("""SELECT l_orderkey, l_partkey, coalesce(cur.p_name, old.p_brand) AS name FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) i
LEFT JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) cur ON cur.p_partkey = l_partkey LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 = 0) old ON old.p_partkey = l_partkey WHERE coalesce(cur.p_name, old.p_brand) IS NOT NULL""")
def snapshot_refresh(spark, d):
    return _refresh(Tables(spark, d).lineitem, Tables(spark, d).part)


def _zip(items, docs):
    return bank.numbered(items.select("item_id"), "item_id", "rn").join(bank.numbered(docs.select("doc_id"), "doc_id", "rn"), "rn").select("rn", "item_id", "doc_id")


@query("SELECT b.rn AS rn, b.item_id AS item_id, a.doc_id AS doc_id FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS rn FROM benchmark) b JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) a ON a.rn = b.rn")
def positional_zip(spark, d):
    t = Tables(spark, d)
    return _zip(t.benchmark, t.documents)


@query("SELECT p_partkey, CASE p_partkey WHEN 1 THEN 'img/1.png' WHEN 5 THEN 'img/5.png' ELSE p_brand END AS image FROM part")
def patch_join(spark, d):
    patch = spark.createDataFrame([(1, "img/1.png"), (5, "img/5.png")], "p_partkey long, patch string")
    return Tables(spark, d).part.join(F.broadcast(patch), "p_partkey", "left").select("p_partkey", F.coalesce("patch", "p_brand").alias("image"))


@query("SELECT user_id, min(event_id) AS first_event FROM events GROUP BY 1")
def ordered_distinct(spark, d):
    return bank.first_wins(Tables(spark, d).events, ["user_id"], F.col("event_id")).select("user_id", F.col("event_id").alias("first_event"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_brand ELSE p_type END AS by_or, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS by_null, CASE WHEN p_size % 5 = 0 THEN 1 ELSE p_size END AS size_or FROM part""")
def coalesce_fallback(spark, d):
    raw, size = F.expr("if(p_size % 5 = 0, '', p_type)"), F.expr("if(p_size % 5 = 0, 0, p_size)")
    return Tables(spark, d).part.select("p_partkey", fn.or_else(raw, F.col("p_brand")).alias("by_or"), F.coalesce(raw, "p_brand").alias("by_null"), F.coalesce(F.nullif(size, F.lit(0)), F.lit(1)).alias("size_or"))


@query("""SELECT CAST(4 AS BIGINT) AS n, '7,3,12,900' AS ids""")
def param_decode(spark, d):
    ids = fn.decode_ids(F.lit("7, 3,,x,0,7,12,900,3"), 100)
    return spark.range(1).select(F.size(ids).cast("long").alias("n"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT true AS has_orders, false AS has_missing, true AS has_status, true AS has_details, false AS has_image, false AS ready")
def readiness_flags(spark, d):
    t = Tables(spark, d)
    orders, part = set(t.orders.columns), set(t.part.columns)
    flags = {"has_orders": bool(orders), "has_missing": spark.catalog.tableExists("no_such_table"), "has_status": "o_orderstatus" in orders, "has_details": "p_type" in part, "has_image": "p_image" in part}
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in flags.items()])
    ready = F.lit(True)
    for k in flags:
        ready = ready & F.col(k)
    return row.withColumn("ready", ready)


@query("SELECT p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 20 AS batch FROM part")
def batch_assign(spark, d):
    rn = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return Tables(spark, d).part.select("p_partkey", F.floor((rn - 1) / 20).cast("long").alias("batch"))
