"""Queries on learning records and on changing tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.operators import grading, merge
from lectern.operators.bank import keep_latest
from lectern.plans.base import ANSWERS, Tables, answers, query

KIND = "CASE WHEN selected = answer THEN 'correct' WHEN selected IS NULL THEN 'unanswered' ELSE 'wrong' END"


@query(f"""SELECT attempt, n, correct, unanswered, n - correct - unanswered AS wrong, CAST(floor(100.0 * correct / n + 0.5) AS BIGINT) AS score FROM (
SELECT attempt, count(*) AS n, count(*) FILTER (WHERE selected = answer) AS correct, count(*) FILTER (WHERE selected IS NULL) AS unanswered FROM {ANSWERS} GROUP BY 1)""")
def grade_attempts(spark, d):
    return grading.grade(answers(Tables(spark, d).lineitem))


@query(f"SELECT {KIND} AS outcome, count(*) AS n FROM {ANSWERS} GROUP BY 1")
def outcome_tristate(spark, d):
    return answers(Tables(spark, d).lineitem).groupBy(fn.outcome(F.col("selected"), F.col("answer")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT attempt, count(*) AS n FROM {ANSWERS} WHERE selected IS DISTINCT FROM answer GROUP BY 1")
def report_wrong_filter(spark, d):
    return answers(Tables(spark, d).lineitem).where(~F.col("selected").eqNullSafe(F.col("answer"))).groupBy("attempt").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT CASE WHEN s >= 80 THEN 'high' WHEN s >= 60 THEN 'middle' ELSE 'low' END AS band, count(*) AS n FROM (SELECT attempt, floor(100.0 * count(*) FILTER (WHERE selected = answer) / count(*) + 0.5) AS s FROM {ANSWERS} GROUP BY 1) GROUP BY 1")
def score_band(spark, d):
    return grading.grade(answers(Tables(spark, d).lineitem)).groupBy(fn.score_band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT attempt, count(selected) AS answered, count(*) - count(selected) AS remaining, round(count(selected) / count(*), 6) AS ratio FROM {ANSWERS} GROUP BY 1")
def progress_ratio(spark, d):
    g = answers(Tables(spark, d).lineitem).groupBy("attempt").agg(F.count("selected").alias("answered"), F.count(F.lit(1)).alias("_n"))
    return g.select("attempt", "answered", (F.col("_n") - F.col("answered")).alias("remaining"), F.round(F.col("answered") / F.col("_n"), 6).alias("ratio"))


ORDER = "l_linenumber, question, l_suppkey, at_, l_quantity, l_extendedprice"


@query(f"SELECT attempt, string_agg(left({KIND}, 1), '' ORDER BY {ORDER}) AS grid FROM {ANSWERS} GROUP BY 1")
def answer_distribution(spark, d):
    rows = answers(Tables(spark, d).lineitem).withColumn("mark", F.left(fn.outcome(F.col("selected"), F.col("answer")), F.lit(1)))
    place = F.struct("l_linenumber", "question", "l_suppkey", "at", "l_quantity", "l_extendedprice", "mark")
    return rows.groupBy("attempt").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["mark"]), "").alias("grid"))


WRONG = f"(SELECT * FROM {ANSWERS} WHERE selected IS NOT NULL AND selected <> answer)"


@query(f"""SELECT question, count(*) AS times, max(at_) AS last_at, max(selected) FILTER (WHERE at_ = m) AS last_selected
FROM (SELECT *, max(at_) OVER (PARTITION BY question) AS m FROM {WRONG}) GROUP BY 1""")
def wrongbook(spark, d):
    return grading.wrong_book(answers(Tables(spark, d).lineitem))


@query(f"SELECT p_brand, count(DISTINCT question) AS questions, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types FROM {WRONG} JOIN part ON p_partkey = question GROUP BY 1")
def wrong_retake_set(spark, d):
    t = Tables(spark, d)
    wrong = grading.wrong_answers(answers(t.lineitem)).select("question").distinct().join(t.part, F.expr("question = p_partkey"))
    return wrong.groupBy("p_brand").agg(F.count(F.lit(1)).alias("questions"), F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("types"))


@query(f"""SELECT o_custkey, count(DISTINCT o_orderkey) AS attempts, count(*) AS answered, count(*) FILTER (WHERE selected = answer) AS correct,
CAST(floor(100.0 * count(*) FILTER (WHERE selected = answer) / count(*) + 0.5) AS BIGINT) AS accuracy FROM {ANSWERS} JOIN orders ON o_orderkey = attempt GROUP BY 1""")
def user_totals(spark, d):
    t = Tables(spark, d)
    per_attempt = grading.grade(answers(t.lineitem)).join(t.orders.select("o_orderkey", "o_custkey"), F.expr("attempt = o_orderkey"))
    totals = per_attempt.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("attempts"), F.sum("n").alias("answered"), F.sum("correct").alias("correct"))
    return totals.withColumn("accuracy", F.when(F.col("answered") > 0, fn.round_half_up(F.lit(100.0) * F.col("correct") / F.col("answered"))).otherwise(F.lit(0).cast("long")))


@query("SELECT o_custkey, o_orderkey, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def topk_per_user(spark, d):
    return grading.latest_per_user(Tables(spark, d).orders, "o_custkey", 3, F.desc("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "rank")


@query("SELECT o_custkey, o_orderkey, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn <= 5")
def local_history(spark, d):
    orders = Tables(spark, d).orders.select("o_custkey", "o_orderkey")
    return keep_latest(orders.unionByName(orders), "o_custkey", "o_orderkey", 5, F.desc("o_orderkey"))


@query("SELECT doc_id, CASE WHEN n_chars % 101 >= 70 THEN '基础' WHEN n_chars % 101 >= 45 THEN '进阶' ELSE '挑战' END AS difficulty FROM documents")
def difficulty_band(spark, d):
    return Tables(spark, d).documents.select("doc_id", fn.difficulty(F.expr("n_chars % 101")).alias("difficulty"))


@query("""SELECT event_id, CAST(greatest(1, floor(value * 10 / 1000.0 + 0.5)) AS BIGINT) AS seconds, CAST(CASE WHEN event_id % 4 = 0 THEN -1 ELSE event_id % 4 * 60 END AS BIGINT) AS limit_s,
CAST(greatest(5, ceil(least(event_id, 40) * 1.2)) AS BIGINT) AS estimate FROM events""")
def duration_math(spark, d):
    seconds = F.greatest(F.lit(1).cast("long"), fn.round_half_up(F.col("value") * 10 / 1000.0))
    return Tables(spark, d).events.select("event_id", seconds.alias("seconds"), F.coalesce(F.nullif(F.expr("event_id % 4 * 60"), F.lit(0)), F.lit(-1)).cast("long").alias("limit_s"), F.greatest(F.lit(5).cast("long"), F.ceil(F.least("event_id", F.lit(40)) * F.lit(1.2))).cast("long").alias("estimate"))


@query("SELECT event_id, lpad((greatest(event_id - 3, 0) // 60)::VARCHAR, CAST(greatest(2, length((greatest(event_id - 3, 0) // 60)::VARCHAR)) AS INTEGER), '0') || ':' || lpad((greatest(event_id - 3, 0) % 60)::VARCHAR, 2, '0') AS clock FROM events")
def format_mmss(spark, d):
    return Tables(spark, d).events.select("event_id", fn.mmss(F.col("event_id") - 3).alias("clock"))


# --- changing tables

STAGED = "(SELECT o_orderkey, o_totalprice + v AS o_totalprice, v FROM orders, (SELECT 1 AS v UNION ALL SELECT 2) WHERE o_orderkey % 2 = 0)"


def _staged(orders):
    return orders.where("o_orderkey % 2 = 0").withColumn("v", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("o_totalprice", F.col("o_totalprice") + F.col("v"))


@query(f"SELECT o_orderkey, round(arg_max(o_totalprice, v), 4) AS price FROM {STAGED} GROUP BY 1")
def staged_upsert(spark, d):
    return merge.last_write(_staged(Tables(spark, d).orders), ["o_orderkey"], F.desc("v")).select("o_orderkey", F.round("o_totalprice", 4).alias("price"))


@query("SELECT r_regionkey, count(n_nationkey) AS received, CASE WHEN r_regionkey = 9 THEN 0 ELSE 5 END = count(n_nationkey) AS complete FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def staged_counts(spark, d):
    t = Tables(spark, d)
    n = t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("n"))
    received = F.coalesce("n", F.lit(0).cast("long"))
    return t.region.join(n, "r_regionkey", "left").select("r_regionkey", received.alias("received"), (received == 5).alias("complete"))


@query("""SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(t.o_custkey, s.o_custkey) AS o_custkey, round(coalesce(s.o_totalprice, t.o_totalprice), 4) AS price
FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) t FULL JOIN (SELECT o_orderkey, -1 AS o_custkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0) s ON t.o_orderkey = s.o_orderkey""")
def merge_append(spark, d):
    orders = Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_totalprice")
    source = orders.where("o_orderkey % 2 = 0").withColumns({"o_custkey": F.lit(-1).cast("long"), "o_totalprice": F.col("o_totalprice") * 2})
    out = merge.merge(orders.where("o_orderkey % 3 <> 0"), source, ["o_orderkey"], ["o_totalprice"])
    return out.select("o_orderkey", "o_custkey", F.round("o_totalprice", 4).alias("price"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'k' || p_partkey WHEN p_partkey = low THEN 'new:' || p_brand || ':' || p_size ELSE NULL END AS import_key FROM part
LEFT JOIN (SELECT p_brand AS b, p_size AS s, min(p_partkey) AS low FROM part WHERE p_partkey % 2 = 1 GROUP BY 1, 2) ON b = p_brand AND s = p_size""")
def adopt_import_key(spark, d):
    part = Tables(spark, d).part
    target = part.select("p_partkey", "p_brand", "p_size", F.when(F.expr("p_partkey % 2 = 0"), F.concat(F.lit("k"), "p_partkey")).alias("import_key"))
    staged = part.select("p_brand", "p_size", F.concat(F.lit("new:"), "p_brand", F.lit(":"), F.col("p_size").cast("string")).alias("import_key")).distinct()
    return merge.adopt_keys(target, staged, ["p_brand", "p_size"], "import_key", "p_partkey").select("p_partkey", "import_key")


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderpriority END AS payload FROM orders")
def partial_upsert(spark, d):
    orders = Tables(spark, d).orders.select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("payload"))
    source = orders.where("o_orderkey % 2 = 0").withColumns({"o_orderstatus": F.lit("?"), "payload": F.lit("new")})
    return merge.merge(orders, source, ["o_orderkey"], ["payload"])


@query("SELECT p_partkey, p_brand, p_name FROM part WHERE p_brand <> 'Brand#11' UNION ALL SELECT -p_partkey, 'Brand#11', p_name FROM part WHERE p_size = 1")
def replace_partition(spark, d):
    part = Tables(spark, d).part.select("p_partkey", "p_brand", "p_name", "p_size")
    source = part.where("p_size = 1").withColumns({"p_partkey": -F.col("p_partkey"), "p_brand": F.lit("Brand#11")})
    return merge.replace_partition(part, source, "p_brand", ["Brand#11"]).drop("p_size")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, 'copy' FROM nation WHERE n_nationkey >= 10")
def insert_ignore(spark, d):
    nation = Tables(spark, d).nation.select("n_nationkey", "n_name")
    return merge.insert_ignore(nation.where("n_nationkey < 10"), nation.withColumn("n_name", F.lit("copy")), ["n_nationkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey = 3 THEN 'renamed' ELSE c_name END AS c_name FROM customer WHERE c_custkey <> 5 UNION ALL SELECT -1, 'inserted'")
def point_update(spark, d):
    customer = Tables(spark, d).customer.select("c_custkey", "c_name")
    changed = customer.where("c_custkey <> 5").withColumn("c_name", F.when(F.col("c_custkey") == 3, "renamed").otherwise(F.col("c_name")))
    return changed.unionByName(spark.createDataFrame([(-1, "inserted")], "c_custkey long, c_name string"))


@query("""SELECT (SELECT count(*) FROM customer WHERE c_custkey % 7 <> 0) AS users, (SELECT count(*) FROM orders WHERE o_custkey % 7 <> 0) AS attempts,
(SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 7 <> 0) AS answers""")
def cascade_delete(spark, d):
    t = Tables(spark, d)
    gone = t.customer.where("c_custkey % 7 = 0")
    orders_gone = t.orders.join(gone.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    users = count(t.customer.where("c_custkey % 7 <> 0"), "users")
    attempts = count(merge.delete_children(t.orders, gone, "o_custkey", "c_custkey"), "attempts")
    left = count(merge.delete_children(t.lineitem, orders_gone, "l_orderkey", "o_orderkey"), "answers")
    one = lambda df: df.withColumn("_", F.lit(1))
    return one(users).join(one(attempts), "_").join(one(left), "_").drop("_")


@query("SELECT r_regionkey FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey < 3)")
def ref_guard(spark, d):
    t = Tables(spark, d)
    return t.region.join(t.nation.where("n_nationkey < 3"), F.expr("n_regionkey = r_regionkey"), "left_anti").select("r_regionkey")


@query("SELECT event_id FROM events WHERE NOT (ts < (SELECT max(ts) - INTERVAL 1 DAY FROM events))")
def ttl_purge(spark, d):
    events = Tables(spark, d).events
    cutoff = events.agg((F.max("ts") - F.expr("interval 1 day")).alias("cutoff"))
    return events.join(F.broadcast(cutoff), F.expr("not (ts < cutoff)")).select("event_id")  # one row
