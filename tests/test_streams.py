from __future__ import annotations

import json

from pyspark.sql import functions as F

from lectern.operators import merge
from lectern.streaming import exams, jobs
from lectern.streaming.states import STORE, keyed_state


def item(job, position, seq=0, stem="s"):
    return {"job": job, "kind": "item", "seq": seq, "position": position, "import_key": f"k{position}", "stem": stem, "options": "[]", "answer": "A", "extra": 1}


def control(job, kind, seq=0, total=None):
    return {"job": job, "kind": kind, "seq": seq, "total": total}


def test_import_jobs_survive_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    paths = [str(tmp_path / x) for x in ("in", "out", "cp")]

    def send(name, *messages):
        (tmp_path / f"in/{name}.json").write_text("\n".join(json.dumps(m) for m in messages))
        before = spark.read.parquet(paths[1]) if (tmp_path / "out").exists() else None
        done = [] if before is None else [tuple(r) for r in before.collect()]
        store = spark.conf.get(STORE, None)
        jobs.run_import_jobs(spark, *paths)
        assert spark.conf.get(STORE, None) == store
        rows = [tuple(r) for r in spark.read.parquet(paths[1]).collect()]
        for r in done:
            rows.remove(r)
        return sorted((r[0], r[1], r[2], r[4]) for r in rows)

    # messages of a batch in any order; a position sent twice counts once, the newest content stays
    first = send("1", item("a", 1, 2, "new"), item("a", 1, 1, "old"), item("a", None), control("a", "start", total=2), item("x", 1), control("b", "start", total=1), {"kind": "item"})
    assert first == [("a", "received", 1, None), ("a", "uploading", 1, None), ("b", "uploading", 0, None), ("x", "unknown", 0, None)]
    # started again: the first item is still known, a repeated start changes nothing
    assert send("2", control("a", "start", total=9), control("a", "finalize"), control("b", "cancel")) == [("a", "incomplete", 1, None), ("a", "uploading", 1, None), ("b", "cancelled", 0, None)]
    assert send("3", item("a", 2), item("a", 1, 1, "old"), control("a", "finalize", 5), control("a", "finalize", 6)) == [
        ("a", "completed", 2, None), ("a", "item", 2, 1), ("a", "item", 2, 2), ("a", "received", 2, None),
    ]
    assert send("4", item("a", 2, 9, "late"), control("a", "finalize"), item("b", 1), control("x", "finalize")) == [
        ("a", "ended", 2, None), ("a", "ended", 2, None), ("b", "ended", 0, None), ("x", "unknown", 0, None),
    ]
    got = jobs.released(spark.read.parquet(paths[1]), "a")
    assert {r["position"]: r["stem"] for r in got.collect()} == {1: "new", 2: "s"}
    # what a job releases is appended to a bank
    bank = spark.createDataFrame([(7, None, "s", "[]", "B")], "id long, import_key string, stem string, options string, answer string")
    out = merge.finalize_append(bank, got.select(*bank.columns[1:]), "import_key", ["stem", "options"], "id", ["stem", "answer"])
    assert sorted(tuple(r) for r in out.select("import_key", "id", "answer").collect()) == [("k1", None, "A"), ("k2", 7, "A")]


EVENT = "attempt string, kind string, at string, minutes int, question string, selected string, closed string"


def test_exam_timers_fire_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    at = lambda minute: f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"
    event = lambda a, kind, minute, **more: {"attempt": a, "kind": kind, "at": at(minute), **more}
    answer = lambda a, minute, q, s: event(a, "answer", minute, question=q, selected=s)

    def send(number, *events):
        (tmp_path / f"in/{number}.json").write_text("\n".join(json.dumps(e) for e in events))
        with keyed_state(spark):
            source = spark.readStream.schema(EVENT).json(str(tmp_path / "in")).withColumn("at", F.col("at").cast("timestamp"))
            rows = exams.exam_ends(source, "10 minutes", keep_ms=60_000)
            query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        rows = spark.read.schema(exams.OUTCOME).parquet(str(tmp_path / "out")).selectExpr("attempt", "date_format(ended_at, 'HH:mm')", "automatic", "answered")
        return sorted(tuple(r) for r in rows.collect())

    # out of order; b has no limit, c no end; the last answer of a question counts, a null takes it back
    got = send(1, answer("a", 20, "q1", "A"), answer("a", 5, "q1", None), event("a", "start", 0, minutes=30), answer("a", 8, "q2", "B"), event("b", "start", 1), answer("b", 2, "q", "A"),
               answer("b", 3, "q", None), event("c", "start", 1), {"kind": "start"}, event("d", "start", 0, minutes=5), event("d", "submit", 4), event("d", "submit", 2), answer("d", 3, "q", "A"))
    assert got == [("d", "00:02", False, 0)]
    # 00:35 moves the watermark to 00:25; the answer of 00:31 is after the deadline
    got = send(2, answer("a", 31, "q3", "C"), event("b", "submit", 35), answer("a", 29, "q4", "D"), event("d", "submit", 36))
    assert got == [("d", "00:02", False, 0)]
    got = send(3, event("z", "start", 50, minutes=500))
    assert got == [("a", "00:30", True, 3), ("b", "00:35", False, 0), ("d", "00:02", False, 0)]
    # late and repeated events change nothing, and no timer fires again
    got = send(4, event("a", "start", 0, minutes=30), event("b", "submit", 35), answer("a", 55, "q9", "A"), event("z", "start", 80, minutes=500))
    assert got == [("a", "00:30", True, 3), ("b", "00:35", False, 0), ("d", "00:02", False, 0)]


def test_an_attempt_reads_and_writes_its_state_once_a_call():
    class Value:
        def __init__(self):
            self.held, self.calls = None, []

        def get(self):
            self.calls.append("get")
            return self.held

        def update(self, value):
            self.calls.append("update")
            self.held = value

    class Handle:
        def __init__(self):
            self.value, self.timers = Value(), []

        def getValueState(self, name, schema):
            return self.value

        def registerTimer(self, at):
            self.timers.append(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    handle, exam = Handle(), exams.Countdown(1000)
    exam.init(handle)
    event = lambda kind, ms, **more: {"kind": kind, "ms": ms, "minutes": None, "question": None, "selected": None, **more}
    rows = [event("start", 5, minutes=1), *(event("answer", 10 + i % 50, question=f"q{i % 7}", selected=[None, "A", "B"][i % 3]) for i in range(200)), event("answer", 60_006, question="late", selected="A")]
    for part in (rows[:90], rows[90:]):
        handle.value.calls.clear()
        assert list(exam.handleInputRows(("a",), iter(part), None)) == [] and handle.value.calls == ["get", "update"]
    assert handle.timers == [60_005]
    handle.value.calls.clear()
    last = {}
    for r in rows[1:-1]:
        kept = last.get(r["question"], (-1, ""))
        last[r["question"]] = max(kept, (r["ms"], r["selected"] or ""))
    (end,) = exam.handleExpiredTimer(("a",), None, None)
    assert handle.value.calls == ["get", "update"] and end["answered"] == sum(s != "" for _, s in last.values())
    assert handle.timers[-1] == 61_005 and list(exam.handleInputRows(("a",), iter(rows), None)) == []
