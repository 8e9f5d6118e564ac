"""Reads grouped by node as files arrive, with snapshots of what is grouped so far.

Each micro-batch writes its own groups, so a batch that is run again replaces its output.  A snapshot merges
the groups of all batches; it is due whenever the number of reads passes a multiple of ``every``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.progress import Progress
from ..operators import visits
from ..plans.pipelines import node_reads
from ..sinks import documents
from .region_reads import numbered, read_stream


def groups(spark: SparkSession, target: str, nodes: DataFrame) -> DataFrame:
    """All batches' groups as one row a node, reads in the order of batches."""
    rows = spark.read.parquet(target)
    rest = [c for c in rows.columns if c not in ("node_id", "reads", "batch")]
    merged = rows.groupBy("node_id").agg(F.min_by(F.struct(*rest), "batch").alias("first"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("batch", "reads"))), lambda x: x.reads)).alias("reads"))
    return merged.select("node_id", *[f"first.{c}" for c in rest], "reads")


def running_counts(reads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Visits of each node so far, as a streaming aggregate for output mode ``complete`` or ``update``."""
    return visits.visits_of(reads).join(nodes.select("node_id"), "node_id").groupBy("node_id").agg(F.count("*").alias("n"))


def start(spark: SparkSession, folder: str, nodes: DataFrame, target: str, checkpoint: str, snapshot: str | None = None, every: int = 5000, multiset: bool = False, files_per_trigger: int = 1):
    """Starts the stream over what is in ``folder``; ``snapshot`` is the JSON document that is renewed."""

    def save(total: int) -> None:
        if snapshot:
            documents.write_object(groups(spark, target, nodes), snapshot, "node_id")

    progress = Progress(every, save)

    def write(batch: DataFrame, number: int) -> None:
        reads = numbered(batch).persist()
        try:
            node_reads(reads, nodes, multiset).write.mode("overwrite").parquet(f"{target}/batch={number}")
            progress.add(reads.count())
        finally:
            reads.unpersist()

    writer = read_stream(spark, folder, files_per_trigger).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
