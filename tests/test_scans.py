"""Scans in blocks give what scans of whole documents give."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from lectern.operators import papers, segment


def test_blocks_scan_as_whole_documents_do(spark):
    rng = random.Random(1)
    rows = [(d, p, rng.choice(["start", "stop", "x", "y", None]), rng.choice([None, 1, 2])) for d in ("a", "b", None) for p in sorted(rng.sample(range(-20, 300), 90))] + [("one", 5, "x", 3)]
    lines = spark.createDataFrame(rows, "doc string, pos int, line string, v int").repartition(5)
    starts = F.col("line") == "start"
    for size in (1, 7, 1000):
        got = segment.long_running_id(lines, ["doc"], starts, "n", size=size).select("doc", "pos", "n")
        assert sorted(map(str, got.collect())) == sorted(map(str, segment.running_id(lines, ["doc"], ["pos"], starts, "n").select("doc", "pos", "n").collect()))
        got = segment.long_asof_start(lines, ["doc"], starts, "v", size=size).select("doc", "pos", "start")
        assert sorted(map(str, got.collect())) == sorted(map(str, segment.asof_start(lines, ["doc"], ["pos"], starts, "v").select("doc", "pos", "start").collect()))
        got = segment.long_sections_between(lines, "start", "stop", ["doc"], size=size)
        assert sorted(map(str, got.collect())) == sorted(map(str, segment.sections_between(lines, "start", "stop", "doc").collect()))
    assert segment.long_running_id(lines.where("false"), ["doc"], starts, "n").count() == 0


def test_one_document_of_ten_million_lines(spark):
    n, size = 10_000_000, 500_000
    lines = spark.range(n).select(F.lit("d").alias("doc"), F.col("id").alias("pos"), F.when(F.col("id") % 7 == 3, "start").otherwise("x").alias("line"))
    scanned = segment.long_running_id(lines, ["doc"], F.col("line") == "start", "n", size=size)
    wrong = scanned.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") != F.floor((F.col("pos") + 4) / 7)).alias("wrong"), F.max("n").alias("most")).first()
    assert wrong["n"] == n and wrong["wrong"] == 0 and wrong["most"] == (n + 3) // 7
    # rows are dealt by document and block, so the blocks of one document lie in many tasks
    assert re.search(r"hashpartitioning\([^)]*_block", scanned._jdf.queryExecution().executedPlan().toString())


def test_titles_of_a_long_document_are_not_gathered(spark):
    rows = spark.range(200_000).select(F.lit("d").alias("doc"), (F.col("id") * 5).cast("int").alias("pos"), (F.col("id") % 20 + 1).cast("int").alias("number"))
    twice = rows.unionByName(rows.withColumn("pos", F.col("pos") + 2)).unionByName(rows.where("number = 3").withColumn("pos", F.col("pos") + 4))
    slots = papers.titled_slots(twice)
    assert "collect_list" not in slots._jdf.queryExecution().optimizedPlan().toString()
    # a repeat two lines on goes; one four lines on comes after that, so it is kept and opens a section
    got = slots.agg(F.count(F.lit(1)), F.max("section")).first()
    assert tuple(got) == (210_000, 9_999 + 10_000)


def test_solutions_are_found_without_a_broadcast(spark, tmp_path):
    # written and read again, so that the planner knows a size, and takes the unfolded lines for as small as the file
    spark.range(3000).select(F.col("id").cast("int").alias("n")).write.parquet(str(tmp_path / "n"))
    n = spark.read.parquet(str(tmp_path / "n"))
    texts = F.array(F.format_string("%08d name of a question", "n"), F.concat(F.lit("【实战解析】s"), "n"), F.concat(F.lit("t"), "n"), F.lit("3. next"))
    lines = n.select(F.lit("d").alias("doc"), "n", F.posexplode(texts).alias("i", "line")).select("doc", (F.col("n") * 4 + F.col("i")).alias("pos"), "line")
    got = papers.practical_after(lines, n.select("n", F.lit("d").alias("doc"), F.format_string("%08d; name of a question", "n").alias("stem")), "n")
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 4 and plan.count("BroadcastHashJoin") == 2  # one row a block of positions, for both sides of a join
    assert got.where("explanation = concat('s', n, chr(10), 't', n)").count() == 3000


def test_import_keys_are_dealt_over_the_tasks(spark):
    # one row group of parts is one task's work otherwise, however many parts it holds
    from lectern.plans.catalogue import QUERIES

    plan = QUERIES["import_keys"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(p_partkey" in plan and plan.index("import_key") < plan.index("hashpartitioning(p_partkey")
