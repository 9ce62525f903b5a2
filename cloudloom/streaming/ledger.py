"""Append-only ledgers as streams: rolling summaries with a watermark, and a codebook's moving average as keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..catalog import query
from ..staging import shared_dir


def rolling_summary(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window start, event_type, n, total of an event stream (ts, event_type, value); later rows than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("value") * 1e6 + 0.5)).alias("micros")).select(F.col("window.start").alias("start"), "event_type", "n", "micros")


def moving_average(events: DataFrame, momentum: float = 0.99) -> DataFrame:
    """event_type, steps, average: state for each key, updated by the mean of each batch, as a codebook's averages are."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, average = state.get if state.exists else (0, 0.0)
        values = pd.concat([f["value"] for f in frames])
        mean = float(values.mean())
        average = mean if steps == 0 else momentum * average + (1 - momentum) * mean
        state.update((steps + 1, average))
        yield pd.DataFrame({"event_type": [key[0]], "steps": [steps + 1], "average": [average]})

    return events.groupBy("event_type").applyInPandasWithState(update, "event_type string, steps long, average double", "steps long, average double", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, schema: str, mode: str = "append") -> DataFrame:
    """What a stream gives once all its input is read (availableNow), from files in the shared folder.

    append: rows that can't change any more, by the file sink; update: the rows of every batch."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        run = run.format("parquet").start(f"{folder}/rows")
    else:
        # a batch that is run again writes the same place, so no row is there twice
        run = run.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(floor(value * 1e6 + 0.5) AS BIGINT)) AS BIGINT) AS micros FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY date_trunc('hour', ts), event_type")
def stream_rolling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark (two hours) has closed."""
    summary = drained(rolling_summary(_stream(spark, sf_dir)), "start timestamp, event_type string, n long, micros long")
    return summary.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_type, CAST(1 AS BIGINT) AS steps, floor(avg(value) * 1e4 + 0.5) / 1e4 AS average FROM events GROUP BY event_type")
def stream_moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after the one batch that the table is."""
    out = drained(moving_average(_stream(spark, sf_dir)), "event_type string, steps long, average double", "update")
    return out.select("event_type", "steps", (F.floor(F.col("average") * 1e4 + 0.5) / 1e4).alias("average"))


def carried_average(events: DataFrame, momentum: float = 0.99) -> DataFrame:
    """event_type, last, steps, average of a stream of ledger rows (step, event_type, value) that comes in order of step from file
    to file: the moving average in step order, carried from batch to batch. A row whose step was seen is a repeat and dropped."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, steps, average = state.get if state.exists else (-1, 0, 0.0)
        rows = pd.concat(list(frames)).drop_duplicates("step").sort_values("step")
        rows = rows[rows["step"] > last]
        for step, value in zip(rows["step"], rows["value"]):
            average = float(value) if steps == 0 else momentum * average + (1 - momentum) * float(value)
            last, steps = int(step), steps + 1
        state.update((last, steps, average))
        yield pd.DataFrame({"event_type": [key[0]], "last": [last], "steps": [steps], "average": [average]})

    return events.groupBy("event_type").applyInPandasWithState(update, "event_type string, last long, steps long, average double", "last long, steps long, average double", "update", GroupStateTimeout.NoTimeout)


#: Files of the query's ledger.
FILES = 5


@query("""WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(event_id) AS last, any_value(n) AS steps, floor(sum(value * CASE WHEN p = 1 THEN pow(CAST(0.99 AS DOUBLE), n - 1) ELSE CAST(0.01 AS DOUBLE) * pow(CAST(0.99 AS DOUBLE), n - p) END) * 1e4 + 0.5) / 1e4 AS average FROM r GROUP BY event_type""")
def stream_carried_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger in several files, a batch each, in which every tenth row of a file is repeated in the next one."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("step"), "event_type", "value")
    top = e.agg(F.max("step")).first()[0] or 0
    part = F.expr(f"step * {FILES} div {top + 1}")
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/ledger-{uuid.uuid4().hex}"
    for n in range(FILES):
        own = e.filter(part == n).union(e.filter((part == n - 1) & (F.col("step") % 10 == 3)))
        own.coalesce(1).write.mode("append").parquet(folder)  # a file each, later ones with later times
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    rows = drained(carried_average(stream), "event_type string, last long, steps long, average double", "update")
    newest = F.max_by(F.struct("last", "steps", "average"), "steps").alias("r")
    return rows.groupBy("event_type").agg(newest).select("event_type", "r.last", "r.steps", (F.floor(F.col("r.average") * 1e4 + 0.5) / 1e4).alias("average"))
