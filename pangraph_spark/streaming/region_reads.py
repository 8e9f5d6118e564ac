"""Reads per region as a stream: new read files are assigned as they arrive.

Assignment is by read and needs no state; counts are kept per micro-batch file set by the sink, so a batch
that is run again replaces its own output and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import visits
from ..sources import schemas


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON reads of a folder; malformed lines, which have no ``name``, are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return lines.select(F.from_json("value", schemas.READ_JSON).alias("r")).where(F.col("r.name").isNotNull()).select("r.*")


def numbered(batch: DataFrame) -> DataFrame:
    """A micro-batch with ``read_id``, so that equal lines are reads of their own."""
    return batch.withColumn("read_id", F.monotonically_increasing_id())


def assign(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """``region, read_name, sequence_length, mapping_position`` by first hit, in a form that streams.

    The lookup is a map of nodes to regions joined to exploded visits; the earliest hit is taken by batch.
    """
    reads = reads.withColumn("sequence_length", F.length("sequence"))
    hits = visits.first_hits(visits.visits_of(reads, ["name", "sequence_length"]), regions, ["name", "sequence_length"])
    return hits.select("region", F.col("name").alias("read_name"), "sequence_length", F.col("offset").alias("mapping_position"))


def start(spark: SparkSession, folder: str, regions: DataFrame, target: str, checkpoint: str, available_now: bool = True):
    """Starts the stream; each micro-batch writes its own partition ``batch=<id>`` of ``target``."""

    def write(batch: DataFrame, number: int) -> None:
        assign(numbered(batch), regions).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = read_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def counts(spark: SparkSession, target: str) -> DataFrame:
    """Reads of each region so far."""
    return spark.read.parquet(target).groupBy("region").agg(F.count("*").alias("reads"))
