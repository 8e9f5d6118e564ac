"""Writers: single JSON documents, JSON lines and Parquet.

A single document is one value by nature, so its rows stream through the driver, a partition at a time and
never all at once; large results should be written as JSON lines or Parquet.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _atomic(path: str, write) -> None:
    """Writes beside the target and renames, so readers never see half a document.

    The path may name any file system that Spark reads; one without a scheme is local.
    """
    if "://" in path:
        _atomic_shared(path, write)
        return
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=folder, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            write(f)
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise


def _atomic_shared(path: str, write) -> None:
    sc = SparkSession.getActiveSession().sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    handle, temp = tempfile.mkstemp(suffix=".json")
    beside = fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            write(f)
        beside.getFileSystem(conf).copyFromLocalFile(False, True, fs.Path(f"file://{temp}"), beside)
        kinds = getattr(fs, "Options$Rename")
        how = sc._gateway.new_array(kinds, 1)
        how[0] = kinds.OVERWRITE
        fs.FileContext.getFileContext(beside.toUri(), conf).rename(beside, fs.Path(path), how)
    except BaseException:
        beside.getFileSystem(conf).delete(beside, False)
        raise
    finally:
        os.unlink(temp)


def _pretty(text: str, indent: int) -> str:
    return ("\n" + " " * indent).join(json.dumps(json.loads(text), indent=indent, ensure_ascii=False).split("\n"))


def _as_json(df: DataFrame, columns: list[str]):
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_array(df: DataFrame, path: str, indent: int = 4, order: str | None = None) -> None:
    """All rows as one JSON array, in the order of a column if one is named."""
    columns = [c for c in df.columns if c != order]
    rows = (df.orderBy(order) if order else df).select(_as_json(df, columns).alias("j"))

    def write(f):
        first = True
        for r in rows.toLocalIterator():
            f.write(("[\n" if first else ",\n") + " " * indent + _pretty(r.j, indent))
            first = False
        f.write("[]" if first else "\n]")

    _atomic(path, write)


def write_parts(df: DataFrame, path: str, key: str, grow: str, part: str = "part", indent: int = 2) -> None:
    """All rows as one JSON object by ``key``; rows of one key, by ``part``, have pieces of the list ``grow``.

    A key's list is written piece by piece, so no more than one row of it is held at a time.
    """
    rest = [c for c in df.columns if c not in (key, part, grow)]
    rows = df.orderBy(key, part).select(F.col(key).cast("string").alias("k"), _as_json(df, rest).alias("j"), F.transform(grow, lambda x: F.to_json(x, {"ignoreNullFields": "false"})).alias("pieces"))

    def write(f):
        last = None
        pad = "\n" + " " * indent
        for r in rows.toLocalIterator():
            if r.k != last:
                f.write(("{" if last is None else f"{pad}{' ' * indent}]{pad}}},") + pad + json.dumps(r.k, ensure_ascii=False) + ": {")
                for name, value in json.loads(r.j).items():
                    f.write(f"{pad}{' ' * indent}{json.dumps(name)}: {json.dumps(value, ensure_ascii=False)},")
                f.write(f"{pad}{' ' * indent}{json.dumps(grow)}: [")
                last, first = r.k, True
            for x in r["pieces"]:
                f.write(("" if first else ",") + f"{pad}{' ' * (2 * indent)}" + x)
                first = False
        f.write("{}" if last is None else f"{pad}{' ' * indent}]{pad}}}\n}}")

    _atomic(path, write)


def write_graph(nodes: DataFrame, edges: DataFrame, write, indent: int = 4) -> None:
    """Nodes and edges as one JSON object, handed piece by piece to ``write``."""
    ends = edges.select(F.col("a").cast("string").alias("from"), F.col("b").cast("string").alias("to"), *[c for c in edges.columns if c not in ("a", "b")])
    lists = {"node": nodes.select(F.col("node_id").cast("string").alias("id"), "sequence").orderBy("id"), "edge": ends.orderBy("from", "to")}
    for k, (name, rows) in enumerate(lists.items()):
        write(("{" if k == 0 else ",") + "\n" + " " * indent + f'"{name}": [')
        for n, r in enumerate(rows.select(_as_json(rows, rows.columns).alias("j")).toLocalIterator()):
            write((",\n" if n else "\n") + " " * 2 * indent + _pretty(r.j, indent).replace("\n", "\n" + " " * indent))
        write("\n" + " " * indent + "]")
    write("\n}\n")


def write_object(df: DataFrame, path: str, key: str, indent: int = 2, order: str | None = None, wrap: str | None = None) -> None:
    """All rows as one JSON object by ``key``, inside an object of one field if ``wrap`` names it."""
    columns = [c for c in df.columns if c not in (key, order)]
    rows = (df.orderBy(order) if order else df.orderBy(key)).select(F.col(key).cast("string").alias("k"), _as_json(df, columns).alias("j"))

    def write(f):
        f.write(f'{{\n"{wrap}": ' if wrap else "")
        first = True
        for r in rows.toLocalIterator():
            f.write(("{\n" if first else ",\n") + " " * indent + json.dumps(r.k, ensure_ascii=False) + ": " + _pretty(r.j, indent))
            first = False
        f.write("{}" if first else "\n}")
        f.write("\n}" if wrap else "")

    _atomic(path, write)


def write_node_list(nodes: DataFrame, path: str, indent: int = 2) -> None:
    """Nodes reduced to id and sequence, as a list under ``nodes``."""
    rows = nodes.orderBy("node_id").select(F.to_json(F.struct(F.col("node_id").cast("string").alias("id"), "sequence")).alias("j"))

    def write(f):
        f.write('{\n"nodes": [')
        for k, r in enumerate(rows.toLocalIterator()):
            f.write((",\n" if k else "\n") + " " * indent + _pretty(r.j, indent))
        f.write("\n]\n}")

    _atomic(path, write)


def write_node_map(nodes: DataFrame, path: str, indent: int = 2) -> None:
    """Nodes by id under ``nodes``."""
    write_object(nodes, path, "node_id", indent, wrap="nodes")


def variants_name(source: str, chromosome: str | None = None) -> str:
    """The output's name: the input's up to its first dot, and the chromosome."""
    stem = os.path.basename(source).split(".")[0]
    return f"{stem}_variants{f'_{chromosome}' if chromosome else ''}.json"


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def report(df: DataFrame, order: str, n: int = 5) -> list[str]:
    """The first rows as indented JSON text."""
    rows = df.orderBy(order).limit(n).select(_as_json(df, df.columns).alias("j")).collect()
    return [_pretty(r.j, 2) for r in rows]
