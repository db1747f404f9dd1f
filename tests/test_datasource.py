from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.sources import datasource
from lectern.sources.docx import read_docx
from tests.test_sources import XML


def test_word_files_as_a_format(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/_hidden").mkdir()
    for name in ("a.docx", "deep/c.docx", "_hidden/d.docx"):
        with zipfile.ZipFile(tmp_path / "in" / name, "w") as z:
            z.writestr("word/document.xml", XML)
    (tmp_path / "in/b.docx").write_bytes(b"no zip")
    read = lambda **options: spark.read.format("lectern_docx").options(anchors="KEY", **options).load(str(tmp_path / "in"))
    plain = lambda rows: sorted(map(str, rows.withColumn("path", F.regexp_replace("path", "^file:", "")).collect()))
    want = plain(read_docx(spark, str(tmp_path / "in/*.docx"), ("KEY",)).union(read_docx(spark, str(tmp_path / "in/deep"), ("KEY",))))
    assert plain(read()) == want and len(want) == 11
    assert read(bundleBytes=1).rdd.getNumPartitions() == 3 and read().rdd.getNumPartitions() == 1
    (tmp_path / "none").mkdir()
    assert spark.read.format("lectern_docx").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        spark.read.format("lectern_docx").load(str(tmp_path / "missing")).collect()


def test_migrations_are_written_whole_or_not_at_all(spark, tmp_path):
    datasource.register(spark)
    out = tmp_path / "out"
    rows = spark.range(0, 25, 1, 3).select(F.when(F.col("id") != 3, F.concat(F.lit("é "), F.col("id").cast("string"))).alias("statement"))
    save = lambda frame, mode, **options: frame.write.format("lectern_sql").mode(mode).options(**options).save(str(out))
    lines = lambda: [line for f in sorted(out.iterdir()) for line in f.read_text().splitlines()]
    want = [f"é {i}" for i in range(25) if i != 3]
    save(rows, "append", name="questions", rowsPerFile=5)
    first = sorted(f.name for f in out.iterdir())
    assert lines() == want and first[0] == "0001_questions.sql" and len(first) == 6
    save(rows.limit(2), "append", name="notes")
    assert sorted(f.name for f in out.iterdir()) == [*first, "0007_notes.sql"]
    # a failed write leaves neither files nor a staging folder, and what was there stays
    broken = rows.withColumn("statement", F.when(F.col("statement") == "é 20", F.raise_error(F.lit("broken"))).otherwise(F.col("statement")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            save(broken, mode, name="questions")
        assert sorted(f.name for f in out.iterdir()) == [*first, "0007_notes.sql"] and lines() == [*want, *lines()[-2:]]
    save(rows.where("false"), "overwrite", name="questions")
    assert [f.name for f in out.iterdir()] == ["0007_notes.sql"]
    with pytest.raises(Exception, match="one column"):
        save(rows.withColumn("more", F.lit(1)), "append")
