"""Import jobs as a stateful stream: start, items, then finalize or cancel.

A job is ``uploading`` from its start on, and ``completed`` or ``cancelled`` for
good after that. Items may be sent again at any time; the newest of a position
counts. The state of a job is one row and a map of its items, both in the state
store, so a stream that is started again goes on where its checkpoint stands.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.streaming.states import keyed_state

CONTENT = "import_key string, stem string, options string, answer string, explanation string"
FIELDS = tuple(part.split()[0] for part in CONTENT.split(", "))
MESSAGE = f"job string, kind string, seq long, total int, position int, {CONTENT}"
OUTCOME = f"job string, outcome string, received int, total int, position int, {CONTENT}"


class ImportJob(StatefulProcessor):
    """One job. In a micro-batch its start counts first, then its items, then what ends it, by ``seq``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "status string, received int, total int")
        self.items = handle.getMapState("items", "position int", f"seq long, {CONTENT}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, received, total = self.job.get() or (None, 0, None)
        ended, sent, controls = status in ("completed", "cancelled"), False, {}
        for row in rows:
            if row["kind"] == "item" and row["position"] is not None:
                sent = True
                if not ended:
                    received += self._stage(row)
            elif row["kind"] in ("start", "finalize", "cancel"):
                # of several messages of a kind the first one sent counts
                found = (row["seq"] or 0, row["total"])
                controls[row["kind"]] = min(controls.get(row["kind"], found), found, key=lambda x: (x[0], x[1] or 0))
        receipt = lambda outcome: self._row(key, outcome, received, total)
        if "start" in controls:
            if status is None:
                status, total = "uploading", controls["start"][1]
            yield receipt("ended" if ended else "uploading")
        if status is None:
            self.items.clear()  # nothing waits for a job that nobody started
            if sent or controls:
                yield self._row(key, "unknown", 0, None)
            return
        if sent:
            yield receipt("ended" if ended else "received")
        for kind in sorted(set(controls) - {"start"}, key=lambda k: controls[k][0]):
            if status != "uploading":
                yield receipt("ended")
            elif kind == "finalize" and received != total:
                yield receipt("incomplete")
            else:
                status = "completed" if kind == "finalize" else "cancelled"
                if status == "completed":
                    for (position,), value in self.items.iterator():
                        yield self._row(key, "item", received, total, position, *value[1:])
                yield receipt(status)
                self.items.clear()
        self.job.update((status, received, total))

    def close(self) -> None:
        pass

    def _stage(self, row: Row) -> int:
        """Keep the newest of a position; 1 if the position is new."""
        place, value = (row["position"],), (row["seq"] or 0, *(row[f] for f in FIELDS))
        before = self.items.getValue(place) if self.items.containsKey(place) else None
        rank = lambda v: (v[0], *("" if x is None else x for x in v[1:]))
        if before is None or rank(value) > rank(before):
            self.items.updateValue(place, value)
        return int(before is None)

    @staticmethod
    def _row(key, outcome: str, received: int, total: int | None, position: int | None = None, *content: str | None) -> Row:
        return Row(**dict(zip(("job", "outcome", "received", "total", "position", *FIELDS), (key[0], outcome, received, total, position, *(content or (None,) * len(FIELDS))))))


def import_jobs(messages: DataFrame) -> DataFrame:
    """Rows of ``OUTCOME`` for a stream of ``MESSAGE`` rows: receipts, and the items of a job once, when it is finalized.

    Receipts: ``uploading``, ``received`` (with the count of positions), ``incomplete``, ``completed``, ``cancelled``,
    ``ended`` for whatever comes after that, and ``unknown`` for a job that was not started (its items are let go).
    An ended job keeps its one row of state, so that its messages are never taken for a new job's; an upload stays open
    until it is finalized or cancelled. Messages without a job and items without a position are ignored; a start
    without a total can't be completed; further columns are not read.
    """
    rows = messages.where("job is not null").select(*[part.split()[0] for part in MESSAGE.split(", ")])
    return rows.groupBy("job").transformWithState(ImportJob(), OUTCOME, "Append", "None")


def run_import_jobs(spark: SparkSession, source: str, out: str, checkpoint: str):
    """Work off the JSON message files under ``source`` that are new, and append the outcomes to the Parquet table ``out``.

    The sink's log gives each micro-batch once, also after a failure between its files and the checkpoint.
    """
    with keyed_state(spark):
        outcomes = import_jobs(spark.readStream.schema(MESSAGE).json(source))
        query = outcomes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def released(outcomes: DataFrame, job: str | None = None) -> DataFrame:
    """The items of completed jobs (of one of them), as ``merge.finalize_append`` takes them."""
    rows = outcomes.where("outcome = 'item'")
    return (rows if job is None else rows.where(F.col("job") == job)).select("job", "position", *FIELDS)
