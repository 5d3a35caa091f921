"""Price bars as a stream (an addition; the batch operators do not need it).

Values are windowed by event time; a watermark bounds how late a value may come
and how long a window's state is kept.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bars(values: DataFrame, width: str = "1 hour", late: str = "2 hours", watermark: bool = True) -> DataFrame:
    """(date, open, high, low, close, volume) of a stream or table (ts, value)."""
    v = values.filter("value > 0").withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        v = v.withWatermark("ts", late)
    return v.groupBy(F.window("ts", width).alias("w")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count(F.lit(1)).alias("volume")
    ).select(F.col("w.start").alias("date"), "open", "high", "low", "close", "volume")


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one that the session names; a local one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        shared = f"file://{tempfile.mkdtemp(prefix='bars-')}"
    return f"{shared.rstrip('/')}/bars-{uuid.uuid4().hex}"


def run_once(spark: SparkSession, path: str) -> DataFrame:
    """The bars of all that a folder or file holds now, by a stream that ends when it has read it.

    Without a watermark nothing is late, and every batch writes the whole table anew,
    from the executors, beside the stream's own checkpoint.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(schema).parquet(path)
    made = bars(source.select("ts", "value"), watermark=False)
    out = _folder(spark)

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table")

    q = made.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{out}/table").withColumn("date", F.col("date").cast("timestamp_ntz"))
