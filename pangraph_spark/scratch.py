"""Tables written to shared storage: lineage ends there, and a lost executor loses nothing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_LEFT: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Without that setting a temporary folder takes its place, but only if all of Spark runs in one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="scratch-"))
        base = _OWN[0]
    return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes a table and reads it back."""
    spark = df.sparkSession
    path = folder(spark)
    if not _LEFT:
        atexit.register(_clean)
    _LEFT.append(path)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


@contextmanager
def dropped():
    """Tables that are cut inside are removed at the end, but for those that ``keep`` was called with."""
    mark, kept = len(_LEFT), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.scratch_path)
        return df

    yield keep
    for path in _LEFT[mark:]:
        if path not in kept:
            _delete(path)
            _LEFT.remove(path)


def _delete(path: str) -> None:
    # the JVM outlives a stopped session
    jvm = SparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    active = SparkContext._active_spark_context
    conf = active._jsc.hadoopConfiguration() if active else jvm.org.apache.hadoop.conf.Configuration()
    p.getFileSystem(conf).delete(p, True)


def _clean() -> None:
    for path in [*_LEFT, *_OWN]:
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the JVM may have ended before
            return
