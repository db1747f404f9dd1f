"""Queries on page layout; shapes and tokens are composed from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import layout
from lectern.plans.base import Tables, query


@query("""WITH RECURSIVE s AS (
  SELECT p_brand AS doc, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS nth, p_size, p_retailprice, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS text FROM part
), t AS (
  SELECT doc, nth AS id, CASE WHEN nth >= 3 THEN nth // 3 END AS parent, nth + 1 AS page, p_size * 0.5 AS l, p_retailprice AS t, text FROM s
), placed AS (
  SELECT doc, id, page, l::DOUBLE AS l, t::DOUBLE AS t, 0 AS depth, text FROM t WHERE parent IS NULL
  UNION ALL SELECT t.doc, t.id, p.page, p.l + t.l, p.t + t.t, p.depth + 1, t.text FROM t JOIN placed p ON t.doc = p.doc AND t.parent = p.id
) SELECT doc, id, page, round(l, 2) AS "left", round(t, 1) AS top, depth, text FROM placed WHERE text <> ''""")
def nested_shapes(spark, d):
    nth = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    rows = Tables(spark, d).part.withColumn("id", nth.cast("long"))
    shapes = rows.select(F.col("p_brand").alias("doc"), "id", F.expr("if(id >= 3, id div 3, null)").alias("parent"), (F.col("id") + 1).alias("page"), (F.col("p_size") * 0.5).alias("left"), F.col("p_retailprice").alias("top"), F.expr("if(p_size % 5 = 0, '\\r\\u0007', concat(p_name, '\\r'))").alias("text"))
    return layout.flat_shapes(shapes).withColumn("top", F.round("top", 1))


@query("""SELECT doc, page, col, count(*) AS lines, max(n) AS longest FROM (SELECT doc, page, col, line, count(*) AS n FROM (SELECT *, sum(opens) OVER (PARTITION BY doc, page, col ORDER BY y, x, text) AS line FROM (
SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc, page, col ORDER BY y, x, text) <= 3 THEN 0 ELSE 1 END AS opens FROM (SELECT *, CASE WHEN far > 3 AND lo < 30.5 AND hi > 30.5 AND x > 30.5 THEN 1 ELSE 0 END AS col FROM (
SELECT *, min(abs(x - 30.5)) OVER (PARTITION BY doc, page) AS far, min(x) OVER (PARTITION BY doc, page) AS lo, max(x) OVER (PARTITION BY doc, page) AS hi FROM (
SELECT p_brand AS doc, p_partkey // 200 AS page, p_size AS x, floor(p_retailprice) AS y, p_partkey::VARCHAR AS text FROM part))))) GROUP BY ALL) GROUP BY ALL""")
def page_lines(spark, d):
    tokens = Tables(spark, d).part.select(F.col("p_brand").alias("doc"), F.expr("p_partkey div 200").alias("page"), F.col("p_size").alias("x"), F.floor("p_retailprice").alias("y"), F.col("p_partkey").cast("string").alias("text"))
    lines = layout.token_lines(tokens, column=30.5).withColumn("n", F.size(F.split("text", " ")).cast("long"))
    return lines.groupBy("doc", "page", "col").agg(F.count(F.lit(1)).alias("lines"), F.max("n").alias("longest"))
