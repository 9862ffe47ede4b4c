"""Structured Streaming: symbols of arriving sequences by time window, late rows included up to a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeworks.functions.alphabet import GAP, normalised
from cladeworks.session import shared_folder


def symbol_windows(stream: DataFrame, ts: str = "loaded_at", residues: str = "residues", width: str = "30 days", late: str = "365 days") -> DataFrame:
    """(begins, symbol, letters) per tumbling window: letters without gaps, counted per row before they are summed.

    Works alike on a stream and on a table. Rows without a time or letters count nowhere; a stream drops rows of windows
    that ended more than ``late`` before the latest time of earlier batches.
    """
    letters = F.translate(normalised(F.col(residues)), GAP, "")
    timed = stream.select(F.col(ts).cast("timestamp").alias("ts"), letters.alias("r")).where("ts is not null and r <> ''")
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    own = F.explode(F.array_distinct(F.split("r", ""))).alias("symbol")
    counted = timed.select("ts", "r", own).where("symbol <> ''").select(
        "ts", "symbol", (F.length("r") - F.length(F.replace("r", F.col("symbol"), F.lit("")))).alias("n")
    )
    return (
        counted.groupBy(F.window("ts", width).alias("w"), "symbol")
        .agg(F.sum("n").cast("long").alias("letters"))
        .select(F.col("w.start").alias("begins"), "symbol", "letters")
    )


def run_to_end(spark: SparkSession, windows: DataFrame) -> DataFrame:
    """Run a stream of windows over what is there now; the result is a table in the shared folder.

    Update mode: windows are dropped from the state once the watermark has passed them, and each batch writes the windows
    it changed, under its own number, so that a batch done twice counts once. The last state of a window is its result.
    """
    folder = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = (
        windows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = T.StructType([*windows.schema.fields, T.StructField("batch", T.LongType())])
    last = spark.read.schema(schema).parquet(f"{folder}/out").groupBy("begins", "symbol").agg(F.max(F.struct("batch", "letters")).alias("v"))
    return last.select("begins", "symbol", "v.letters")


def stream_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's files as a stream, a few files at a time."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    # as a pattern the path may be one file as well as a folder of them
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "4").parquet(f"{d}/{name}.parque[t]")
