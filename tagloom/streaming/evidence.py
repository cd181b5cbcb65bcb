"""Append-only evidence as a stream: latest success per key, live counters, windows with watermarks.

State is keyed, so it is spread over the executors. latest_success keeps one row a key for ever, as the reference log does; where events are late by
a bound only, windowed() drops old state by watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.runtime import shared_folder

BATCH = "stream_batch_no"  # the column that names a batch's folder


def stream(spark: SparkSession, folder: str, name: str, schema, files: int = 16) -> DataFrame:
    """A table's Parquet as a stream: a folder of files, or one file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    one_file = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if one_file else r.parquet(f"{folder}/{name}.parquet")


def stream_json(spark: SparkSession, folder: str, schema, files: int = 16) -> DataFrame:
    """JSON lines files as they arrive; malformed lines keep their text in _corrupt_record."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("mode", "PERMISSIVE").json(folder)


def latest_success(events: DataFrame, keys: list[str], order: list[str], ok: str) -> DataFrame:
    cols = [c for c in events.columns if c not in keys]
    return events.where(ok).groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def counters(events: DataFrame, by: list[str], failed: str) -> DataFrame:
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(failed)).alias("failed"))


def windowed(events: DataFrame, at: str, by: list[str], size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums of `value` in event-time windows; rows later than `late` are dropped by the watermark."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def drain(streaming: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and return its result as a table of the shared folder.

    complete: each batch replaces the result; append: batches add to it."""
    spark = streaming.sparkSession
    base = f"{shared_folder(spark)}/tagloom/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, n: int) -> None:
        # The batch number is the folder, so a batch that is run again after a failure replaces itself.
        batch.write.mode("overwrite").parquet(f"{base}/out/{BATCH}={n}")

    q = streaming.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    done = spark.read.schema(T.StructType([*streaming.schema.fields, T.StructField(BATCH, T.LongType())])).option("basePath", f"{base}/out").parquet(f"{base}/out")
    if mode == "complete":
        # The last batch that was written; one without data writes nothing.
        last = done.agg(F.max(BATCH).alias("n")).first().n
        done = done.where(F.lit(False) if last is None else F.col(BATCH) == last)
    return done.select(*streaming.columns)


# --- queries ----------------------------------------------------------------------


def _events(s: SparkSession, d: str) -> DataFrame:
    schema = s.read.parquet(f"{d}/events.parquet").schema
    return stream(s, d, "events", schema)


def q_latest(s, d):
    return drain(latest_success(_events(s, d).select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], ["ts", "event_id"], "event_type <> 'error'"))


def q_counters(s, d):
    return drain(counters(_events(s, d), ["user_id"], "event_type = 'error'"))


def q_tumbling(s, d):
    """Windows that the watermark has closed, in append mode: state is dropped behind it, and windows that may still get rows are not given yet."""
    e = _events(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return drain(windowed(e, "ts", ["event_type"], "1 day"), "append").withColumn("start", F.col("start").cast("timestamp_ntz"))


_OK = "(select * from events where event_type <> 'error')"
QUERIES = {"stream_latest_success": q_latest, "stream_counters": q_counters, "stream_windows": q_tumbling}
ORACLES = {
    "stream_latest_success": f"select user_id, arg_max(event_id, (ts, event_id)) event_id, arg_max(ts, (ts, event_id)) ts, arg_max(event_type, (ts, event_id)) event_type, arg_max(\"value\", (ts, event_id)) \"value\" from {_OK} group by 1",
    "stream_counters": "select user_id, count(*) n, count_if(event_type = 'error')::bigint failed from events group by 1",
    "stream_windows": "select date_trunc('day', ts)::timestamp start, event_type, count(*) n, round(sum(\"value\"), 4) total from events group by all having date_trunc('day', any_value(ts)) + interval 1 day <= (select max(ts) - interval 1 hour from events)",
}
