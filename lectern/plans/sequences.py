"""Queries on ordered text and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import segment as seg
from lectern.plans.base import Tables, query

LINES = """(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos FROM documents)"""


def _lines(spark, d):
    return seg.lines_of(Tables(spark, d).documents)


@query(f"""SELECT doc_id, CAST(c AS BIGINT) AS chunk, min(pos) AS first_pos, count(*) AS n, string_agg(line, '|' ORDER BY pos) AS body FROM (
SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-D]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM {LINES}) WHERE c > 0 GROUP BY 1, 2""")
def chunk_split(spark, d):
    return seg.chunk_split(_lines(spark, d), "^[A-D]")


RUNS = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)"


@query(f"SELECT user_id, event_type, min(event_id) AS first_event, count(*) AS n FROM {RUNS} GROUP BY user_id, event_type, g")
def run_merge(spark, d):
    runs = seg.islands(Tables(spark, d).events, ["user_id"], ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id", "event_type", "island").agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("n")).drop("island")


@query("SELECT p_partkey, rn AS global_no, 3 + (rn - 1) // 20 AS set_no, (rn - 1) % 20 + 1 AS local_no FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)")
def set_numbering(spark, d):
    return seg.number_sets(Tables(spark, d).part, ["p_brand"], ["p_partkey"], 20, 3).select("p_partkey", "global_no", "set_no", "local_no")


@query("SELECT o_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linenumber <> rn) AS off FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem) GROUP BY 1 HAVING count(*) FILTER (WHERE l_linenumber <> rn) > 0")
def sequence_violations(spark, d):
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    rows = Tables(spark, d).lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", rn.alias("rn"))
    return rows.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("l_linenumber <> rn")).alias("off")).where("off > 0")


@query("""SELECT user_id, CAST(s AS BIGINT) AS section, count(*) AS n FROM (SELECT *, sum(r) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM (
SELECT user_id, event_id, CASE WHEN k <= lag(k) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS r FROM (
SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))) GROUP BY 1, 2""")
def reset_sections(spark, d):
    rows = Tables(spark, d).events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return seg.reset_sections(rows, ["user_id"], ["event_id"], "k").groupBy("user_id", F.col("section").cast("long").alias("section")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, coalesce(p_size // 5 IS DISTINCT FROM lag(p_size // 5) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey), true) AS shown FROM part")
def group_boundary(spark, d):
    group = F.expr("p_size div 5")
    before = F.lag(group).over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey"))
    return Tables(spark, d).part.select("p_partkey", (~group.eqNullSafe(before)).alias("shown"))


@query("""SELECT event_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS anchor FROM events""")
def last_anchor(spark, d):
    near = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-5, 0)
    far = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    of = lambda kind, w: F.last(F.when(F.col("event_type") == kind, F.col("event_id")), ignorenulls=True).over(w)
    return Tables(spark, d).events.select("event_id", F.coalesce(of("purchase", near), of("click", far), F.lit(-1).cast("long")).alias("anchor"))


@query(f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, lower(line) IS NOT DISTINCT FROM lag(lower(line)) OVER (PARTITION BY doc_id ORDER BY pos) AS twin, pos FROM {LINES}) WHERE NOT twin OR pos = 0 GROUP BY 1")
def adjacent_dedupe(spark, d):
    low = F.lower("line")
    twin = low.eqNullSafe(F.lag(low).over(Window.partitionBy("doc_id").orderBy("pos")))
    return _lines(spark, d).withColumn("twin", twin).where("not twin or pos = 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS start FROM events")
def asof_start(spark, d):
    rows = seg.asof_start(Tables(spark, d).events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", "event_id")
    return rows.select("event_id", F.coalesce("start", F.lit(-1).cast("long")).alias("start"))


STATE = f"(SELECT *, max(CASE WHEN regexp_matches(line, '^T') OR regexp_matches(line, '^[AO]') THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS m FROM {LINES})"


@query(f"SELECT a.doc_id AS doc_id, count(*) AS n FROM {STATE} a JOIN {LINES} b ON a.doc_id = b.doc_id AND a.m = b.pos WHERE regexp_matches(b.line, '^T') GROUP BY 1")
def section_extract(spark, d):
    return seg.sections_between(_lines(spark, d), "^T", "^[AO]").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT doc_id, string_agg(line, '|' ORDER BY pos) AS body FROM (SELECT l.*, max(CASE WHEN regexp_matches(line, '^[TO]') THEN pos END) OVER (PARTITION BY doc_id) AS stop FROM {LINES} l)
WHERE pos > coalesce(stop, -1) GROUP BY 1 HAVING length(string_agg(line, '' ORDER BY pos)) >= 20""")
def backward_collect(spark, d):
    stop = F.max(F.when(F.col("line").rlike("^[TO]"), F.col("pos"))).over(Window.partitionBy("doc_id"))
    tail = _lines(spark, d).withColumn("stop", stop).where("pos > coalesce(stop, -1)")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return tail.groupBy("doc_id").agg(in_order.alias("parts")).where(F.length(F.array_join("parts", "")) >= 20).select("doc_id", F.array_join("parts", "|").alias("body"))


@query(f"SELECT doc_id, count(*) AS n FROM (SELECT *, min(CASE WHEN regexp_matches(line, '^[D-H]') THEN pos END) OVER (PARTITION BY doc_id) AS stop FROM {LINES}) WHERE stop IS NULL OR pos < stop GROUP BY 1")
def until_first_match(spark, d):
    stop = F.min(F.when(F.col("line").rlike("^[D-H]"), F.col("pos"))).over(Window.partitionBy("doc_id"))
    return _lines(spark, d).withColumn("stop", stop).where("stop is null or pos < stop").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# --- streams of a source: all lines of its documents as one, cut into blocks

STREAM = """(SELECT source, doc_id * 16777216 + generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"""


def _stream(spark, d):
    """(source, pos, line); a document has at most 2 ** 24 lines."""
    docs = Tables(spark, d).documents
    return docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("source", (F.col("doc_id") * (1 << 24) + F.col("i")).alias("pos"), "line")


@query(f"SELECT source, chunk, count(*) AS n, min(pos) AS first_pos FROM (SELECT *, sum(CASE WHEN regexp_matches(line, '^The ') THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY pos)::BIGINT AS chunk FROM {STREAM}) GROUP BY ALL")
def stream_chunks(spark, d):
    numbered = seg.long_running_id(_stream(spark, d), ["source"], F.col("line").rlike("\\AThe "), "chunk", size=1 << 28)
    return numbered.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


@query(f"SELECT source, start, count(*) AS n FROM (SELECT *, last_value(CASE WHEN line LIKE '%|%' THEN pos END IGNORE NULLS) OVER (PARTITION BY source ORDER BY pos) AS start FROM {STREAM}) GROUP BY ALL")
def stream_anchor(spark, d):
    anchored = seg.long_asof_start(_stream(spark, d), ["source"], F.contains("line", F.lit("|")), "pos", size=1 << 28)
    return anchored.groupBy("source", "start").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT source, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM (SELECT *, last_value(CASE WHEN regexp_matches(line, '^Of') THEN false WHEN regexp_matches(line, '^The') THEN true END IGNORE NULLS) OVER (PARTITION BY source ORDER BY pos) AS open FROM {STREAM}) WHERE open GROUP BY 1")
def stream_sections(spark, d):
    open_ = seg.long_sections_between(_stream(spark, d), "\\AThe", "\\AOf", ["source"], size=1 << 28)
    return open_.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
