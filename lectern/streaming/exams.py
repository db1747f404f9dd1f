"""Timed exams as a stateful stream: an attempt ends when it is submitted or its time is up.

The end of an attempt is an event-time timer, so it fires once, when the
watermark has passed it: answers that came out of order until then count.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTCOME = "attempt string, ended_at timestamp, automatic boolean, answered int"
WEEK = 7 * 24 * 60 * 60 * 1000


class Countdown(StatefulProcessor):
    """One attempt; times are milliseconds.

    Its answers are a JSON list in the one value that an attempt keeps: each access to state is a round trip to the JVM,
    so a call reads it once and writes it once, however many rows it gets.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.exam = handle.getValueState("exam", "started long, minutes int, submitted long, seen long, timer long, closed boolean, answers string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        started, minutes, submitted, seen, timer, closed, held = self.exam.get() or (None, None, None, None, None, False, "[]")
        if closed:
            return
        answers = self._read(held)
        for row in rows:
            at = row["ms"]
            seen = at if seen is None else max(seen, at)
            if row["kind"] == "start":
                # the earliest start counts, of equal ones the shortest time
                if started is None or (at, row["minutes"] is None, row["minutes"]) < (started, minutes is None, minutes):
                    started, minutes = at, row["minutes"]
            elif row["kind"] == "submit":
                submitted = at if submitted is None else min(submitted, at)
            elif row["kind"] == "answer" and row["question"] is not None:
                # of answers to one question in one millisecond the greatest counts, in whatever order they come
                place, selected = (row["question"], at), row["selected"]
                if place not in answers or (selected or "") > (answers[place] or ""):
                    answers[place] = selected
        if seen is None:
            return
        due = self._due(started, minutes, submitted)
        wanted = seen + self.keep_ms if due is None else due
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
        self.exam.update((started, minutes, submitted, seen, wanted, False, json.dumps([[*place, selected] for place, selected in answers.items()])))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        started, minutes, submitted, seen, timer, closed, held = self.exam.get() or (None, None, None, None, None, True, "[]")
        due = self._due(started, minutes, submitted)
        if closed or due is None:
            self.exam.clear()  # a repeated event is late by now
            return
        latest: dict[str, tuple] = {}  # an entry a question of the paper
        for (question, at), selected in self._read(held).items():
            if at <= due and (question not in latest or at > latest[question][0]):
                latest[question] = (at, selected)
        ended = datetime.datetime.fromtimestamp(due / 1000, datetime.timezone.utc)
        yield Row(attempt=key[0], ended_at=ended, automatic=submitted is None or submitted > due, answered=sum(s is not None for _, s in latest.values()))
        self.handle.registerTimer(due + self.keep_ms)
        self.exam.update((started, minutes, submitted, seen, due + self.keep_ms, True, "[]"))

    def close(self) -> None:
        pass

    @staticmethod
    def _read(held: str) -> dict[tuple, str | None]:
        """The selected option of each (question, time)."""
        return {(question, at): selected for question, at, selected in json.loads(held)}

    @staticmethod
    def _due(started: int | None, minutes: int | None, submitted: int | None) -> int | None:
        deadline = None if started is None or minutes is None else started + minutes * 60_000
        return min((x for x in (deadline, submitted) if x is not None), default=None)


def exam_ends(events: DataFrame, delay: str = "10 minutes", keep_ms: int = WEEK) -> DataFrame:
    """(attempt, ended_at, automatic, answered) once an attempt, when the watermark (``delay`` behind) passes its end.

    ``events``: attempt, kind (start, answer, submit), at, minutes (of a start; null: no limit), question, selected
    (null: unanswered). An attempt ends at its first submit or its deadline, whichever is earlier (``automatic``: the
    deadline alone); without either it has no end. ``answered`` counts the questions whose last answer until then is
    not null. Repeated events change nothing; what follows the end, or comes later than the watermark, is ignored.
    Times count in whole milliseconds, rounded down. An attempt is forgotten ``keep_ms`` after its end, one without an end ``keep_ms`` after its last event. Rows without
    attempt or time are ignored; further columns are not read.
    """
    known = events.where("attempt is not null and at is not null")
    rows = known.withWatermark("at", delay).select("attempt", "kind", "at", F.unix_millis("at").alias("ms"), "minutes", "question", "selected")
    return rows.groupBy("attempt").transformWithState(Countdown(keep_ms), OUTCOME, "Append", "EventTime")
