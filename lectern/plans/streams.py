"""Queries over streams that are worked off to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans.base import query
from lectern.session import load
from lectern.streaming.exams import exam_ends
from lectern.streaming.states import keyed_state, shared_scratch

MINUTES, DELAY = 240, 10


@query(f"""
WITH e AS (SELECT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS attempt, epoch_us(ts) // 1000 AS ms, event_type, event_id % 10 AS question,
    CASE WHEN event_type <> 'error' THEN event_type END AS selected FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
ends AS (SELECT attempt, min(ms) FILTER (event_type = 'view') + {MINUTES} * 60000 AS deadline, min(ms) FILTER (event_type = 'purchase') AS submitted FROM e GROUP BY attempt),
due AS (SELECT attempt, least(deadline, submitted) AS due, coalesce(submitted > deadline, submitted IS NULL) AS automatic FROM ends
  WHERE least(deadline, submitted) <= (SELECT max(ms) FROM e) - {DELAY} * 60000),
last AS (SELECT attempt, question, arg_max(coalesce(selected, ''), (ms, coalesce(selected, ''))) AS selected FROM e JOIN due USING (attempt)
  WHERE event_type IN ('click', 'error', 'signup') AND ms <= due GROUP BY ALL)
SELECT attempt, due AS ended_ms, automatic, CAST(coalesce(answered, 0) AS INTEGER) AS answered
FROM due LEFT JOIN (SELECT attempt, count(*) FILTER (selected <> '') AS answered FROM last GROUP BY attempt) USING (attempt)""")
def exam_countdown(spark, d):
    """The events of a user and day as a timed attempt: views start it, purchases submit it, the others answer."""
    # as a pattern, since a stream takes a plain path for a folder and the table may be one file
    events = spark.readStream.schema(load(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "submit").otherwise("answer")
    rows = events.where("user_id is not null and ts is not null").select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), F.to_date("ts").cast("string")).alias("attempt"),
        kind.alias("kind"),
        F.col("ts").cast("timestamp").alias("at"),
        F.lit(MINUTES).alias("minutes"),
        (F.col("event_id") % 10).cast("string").alias("question"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("selected"),
    )
    out = shared_scratch(spark, "exam-ends")
    with keyed_state(spark):
        ends = exam_ends(rows, f"{DELAY} minutes")
        run = ends.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(ends.schema).parquet(f"{out}/rows").select("attempt", F.unix_millis("ended_at").alias("ended_ms"), "automatic", "answered")
