"""Streaming forms of the log jobs: ingestion, latest feedback, daily scores and the stage gate."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from concord.operators.feedback import newest
from concord.operators.intake import stage_gate
from concord.operators.quality import BELOW
from concord.sources.tables import BUCKETS, for_schema, rewrite_buckets

# Sketches of distinct records have 2 ** SKETCH_BITS registers.
SKETCH_BITS = 12
# How late an event may come; state older than this is dropped.
LATE = "1 day"


def append_stream(events: DataFrame, path: str, checkpoint: str, columns: Sequence[str], **trigger) -> StreamingQuery:
    """Append events to a log, leaving out fields the log does not have."""
    kept = for_schema(events, columns)
    return (kept.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start(path))


def daily_scores(scores: DataFrame, late: str = LATE) -> DataFrame:
    """Score aggregates per day and domain of a stream.

    The watermark bounds the state. Distinct records are counted by a sketch, as exact counts would keep every id of a
    day in state; ``records_sketch`` may be merged over days and domains (:func:`records_over`), with a standard
    error of 1.04 / sqrt(2 ** SKETCH_BITS).
    """
    s = F.col("record_score")
    return (
        scores.withColumns({"domain": F.upper("domain"), "created_at": F.col("created_at").cast("timestamp")}).withWatermark("created_at", late)
        .groupBy(F.window("created_at", "1 day"), "domain")
        .agg(F.count("*").alias("total_records"), F.avg(s).alias("avg_record_score"), F.min(s).alias("min_record_score"),
             F.max(s).alias("max_record_score"), F.count_if(s < BELOW).alias("records_below_threshold"),
             F.hll_sketch_agg("record_id", SKETCH_BITS).alias("records_sketch"))
        .withColumn("approx_records", F.hll_sketch_estimate("records_sketch")).withColumn("metric_date", F.to_date("window.start")).drop("window")
    )


def records_over(daily: DataFrame, *by: str) -> DataFrame:
    """Distinct records over the days or domains of daily rows, from their sketches."""
    merged = F.hll_union_agg("records_sketch")
    return daily.groupBy(*by).agg(F.hll_sketch_estimate(merged).alias("approx_records"))


def _by_key(rows: DataFrame, path: str, checkpoint: str, mode: str, keys: Sequence[str], merge: Callable, buckets: int) -> StreamingQuery:
    def write(batch: DataFrame, _: int) -> None:
        rewrite_buckets(path, batch, keys, merge, buckets)

    return rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_daily(daily: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep one row for each day and domain in a table of ``buckets`` folders; days still open are among them.

    A row of a micro-batch holds the totals of its day so far and takes the place of the one before, so a batch that is
    run again changes nothing.
    """
    keys = ["metric_date", "domain"]

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
        return old.alias("o").join(new.alias("n"), same, "left_anti").unionByName(new)

    return _by_key(daily, path, checkpoint, "update", keys, merge, buckets)


def keep_newest_feedback(feedback: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the newest feedback of each explanation in a table of ``buckets`` folders, whatever the number of micro-batches.

    A batch meets the kept rows of its explanations' folders only; the stream itself keeps no state. A batch that is run
    again after a lost executor finds its own rows and leaves the same ones.
    """
    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return newest(old.unionByName(new), "explanation_id", F.col("feedback_at"))

    return _by_key(feedback, path, checkpoint, "append", ["explanation_id"], merge, buckets)


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`keep_daily` or :func:`keep_newest_feedback`."""
    return spark.read.parquet(path).drop("bucket")


def gate_stream(records: DataFrame, path: str, checkpoint: str, as_of: dt.date) -> StreamingQuery:
    """The stage gate over a stream of records; it keeps no state."""
    return (stage_gate(records, as_of).writeStream.outputMode("append").format("parquet")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path))


def finished(query: StreamingQuery) -> None:
    """Wait for an availableNow query and raise what it raised."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as a stream with the schema the table has now."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
