"""The event log as a stream of JSON lines."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.logs import KEY, SCHEMA, constrained
from ..storage import exists


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Lines as they are appended, with event time `at`."""
    schema = T.StructType([*SCHEMA.fields, T.StructField("category", T.StringType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder).withColumn("at", F.to_timestamp("timestamp"))


def latest_stream(lines: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Last write of each event. State is dropped when the watermark passes an event's window, so it is bounded by `late` plus `window` of traffic."""
    rest = [c for c in lines.columns if c not in (*KEY, "at")]
    best = F.max_by(F.struct(*rest), F.struct(F.col("log_id").isNotNull(), F.col("synced_to_appwrite"), F.coalesce("log_id", F.lit(""))))
    grouped = lines.withWatermark("at", late).groupBy(F.window("at", window), *KEY).agg(best.alias("__r"))
    return grouped.select(*KEY, "__r.*")


def level_counts(lines: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events by tumbling window and level."""
    return lines.withWatermark("at", late).groupBy(F.window("at", window), "level").count().select(F.col("window.start").alias("from"), "level", "count")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Works through what is there now, writes Parquet, and stops."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def unsent_stream(first: DataFrame, second: DataFrame, late: str = "10 minutes") -> DataFrame:
    """First lines whose second line never came, each told once.

    first, second: read_stream() twice. Both lines of an event carry its time, so an outer join on key and time knows from the watermark when no second line can come any more:
    lines may come in any order and up to `late` behind the newest; a second line that comes later counts as missing. First lines written twice count once.
    State holds the lines of the last `late` of event time.
    """
    one = first.where("log_id is null").withWatermark("at", late).dropDuplicatesWithinWatermark(KEY)
    two = second.where("log_id is not null").withWatermark("at", late).select(*(F.col(k).alias(f"__{k}") for k in KEY), F.col("at").alias("__at"), F.lit(True).alias("__sent"))
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) if k == "line_number" else F.col(k) == F.col(f"__{k}") for k in KEY])
    both = one.join(two, same & (F.col("at") == F.col("__at")), "left_outer")
    return both.where("__sent is null").select(*first.columns)


def closing_lines(lines: DataFrame, after: str = "1 day") -> DataFrame:
    """Both lines of an event of source `closing`, so far behind the last that either stream's watermark passes all others; the end of a finite log."""
    at = F.date_format(F.max(F.to_timestamp("timestamp")) + F.expr(f"interval {after}"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    row = lines.agg(at.alias("timestamp")).where("timestamp is not null").withColumn("log_id", F.explode(F.array(F.lit(None).cast("string"), F.lit("closing"))))
    given = {"timestamp": F.col("timestamp"), "log_id": F.col("log_id"), "source": F.lit("closing"), "message": F.lit(""), "file_name": F.lit(""), "line_number": F.lit(0)}
    return row.select(*(given.get(c, F.lit(None)).cast(lines.schema[c].dataType).alias(c) for c in lines.columns))


def insert_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Writes one batch of a stream under path/rows, once: a batch that the ledger has is skipped, one that broke off is written over.

    Constraints are held as rows are written (sources.logs.constrained), so a refused row stops the batch whole. The ledger has a row for each complete batch; what it
    lacks is not read.
    """
    spark, entry = batch.sparkSession, f"{path}/ledger/batch={batch_id}"
    if exists(spark, f"{entry}/_SUCCESS"):
        return
    seen = Observation()
    constrained(batch).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
    spark.createDataFrame([(seen.get["n"],)], "n long").coalesce(1).write.mode("overwrite").json(entry)


def insert_stream(lines: DataFrame, path: str, checkpoint: str) -> None:
    """Inserts all that is there now into the table at `path`, exactly once for each checkpoint."""
    lines.writeStream.foreachBatch(lambda batch, i: insert_batch(batch, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_inserted(spark: SparkSession, path: str) -> DataFrame:
    """The rows of complete batches, with their batch."""
    schema = T.StructType([*SCHEMA.fields, T.StructField("batch", T.LongType())])
    if not exists(spark, f"{path}/ledger"):
        return spark.createDataFrame([], schema)
    ledger = spark.read.schema("n long, batch long").json(f"{path}/ledger").select("batch")
    return spark.read.schema(schema).parquet(f"{path}/rows").join(ledger, "batch", "left_semi").select(*schema.names)
