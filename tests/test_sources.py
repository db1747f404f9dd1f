from __future__ import annotations

import json
import zipfile

import pytest

from lectern.operators import papers
from lectern.sources.docx import read_docx, view
from lectern.sources.records import pair_volumes, read_bank, write_bank
from lectern.streaming.uploads import stage_uploads, staged_rows

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
XML = f"""<w:document {NS}><w:body><w:p><w:r><w:t>1. first</w:t><w:tab/><w:t>x</w:t><w:br/></w:r></w:p>
<w:p><w:r><w:rPr><w:u/><w:b w:val="0"/></w:rPr><w:t>marked</w:t></w:r><w:r><w:rPr><w:u w:val="none"/><w:highlight/></w:rPr><w:t>!</w:t><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r><w:r><w:txbxContent><w:p><w:r><w:t>deep KEY</w:t></w:r></w:p></w:txbxContent></w:r></w:p></w:txbxContent></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in a cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""


def test_docx(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", XML)
    (tmp_path / "b.docx").write_bytes(b"no zip")
    frame = read_docx(spark, str(tmp_path), ("KEY",)).cache()
    rows = frame.where("error is null").orderBy("pos").collect()
    assert [(r["line"], "+".join(r["views"]), r["rescued"]) for r in rows] == [
        ("1. first\tx\n", "all+direct+leaf", False), ("marked!boxeddeep KEY", "all+direct", True), ("boxeddeep KEY", "all+textbox", True), ("deep KEY", "all+leaf+textbox", False), ("in a cell", "all+cell+leaf", False),
    ]
    plain = read_docx(spark, str(tmp_path)).where("pos = 1").first()
    assert [tuple(r) for r in plain["runs"]] == [("marked", False, True, False, False), ("!", False, False, False, True)]
    assert [r["error"] for r in frame.where("error is not null").collect()] == ["BadZipFile"]
    assert [r["line"] for r in view(frame, "leaf").orderBy("pos").collect()] == ["1. first\tx\n", "deep KEY", "in a cell"]


def test_volumes_pair_in_order(spark):
    name = lambda *x: spark.createDataFrame([(i,) for i in x], "name string")
    got = [tuple(r) for r in pair_volumes(name("b下", "a", "c上"), name("z", "y下", "x上")).orderBy("nth").collect()]
    assert got == [(1, "c上", "x上"), (2, "b下", "y下"), (3, "a", "z")]
    with pytest.raises(ValueError):
        pair_volumes(name("a"), name("b", "c"))


def test_long_note_groups_are_cut(spark):
    numbers = [*range(1, 31), *range(2, 33)]
    notes = spark.createDataFrame([("d", i, n) for i, n in enumerate(numbers)], "doc string, nth int, number int")
    expected = lambda n: spark.createDataFrame([("d", n)], "doc string, groups int")
    sizes = lambda n: [r["count"] for r in papers.note_groups(notes, expected(n)).groupBy("grp").count().orderBy("grp").collect()]
    assert sizes(1) == [61] and sizes(2) == [30, 31] and sizes(5) == [30, 31]


def test_bank_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"questions": [{"id": 1, "stem": "s", "options": [{"label": "A", "content": "x"}]}]}))
    (tmp_path / "in/b.json").write_text(json.dumps([{"id": 2, "stem": "é"}]))
    (tmp_path / "in/c.json").write_text("{broken")
    bank = read_bank(spark, str(tmp_path / "in"))
    assert sorted((r["id"], r["stem"]) for r in bank.collect()) == [(1, "s"), (2, "é")]
    write_bank(bank, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_uploads_are_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda p, at, stem: json.dumps({"job": "j", "position": p, "sent_at": f"2024-01-01T00:00:0{at}Z", "stem": stem})
    (tmp_path / "in/1.json").write_text(line(1, 1, "old") + "\n" + line(2, 1, "two"))
    paths = [str(tmp_path / x) for x in ("in", "staged", "cp")]
    stage_uploads(spark, *paths)
    (tmp_path / "in/2.json").write_text(line(1, 2, "new"))
    stage_uploads(spark, *paths)
    stage_uploads(spark, *paths)
    assert {r["position"]: r["stem"] for r in staged_rows(spark, paths[1]).collect()} == {1: "new", 2: "two"}
