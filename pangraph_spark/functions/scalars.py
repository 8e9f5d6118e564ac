"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP_PATTERN = "([><])([^><]+)"


def with_chr(name: Column) -> Column:
    """``1`` and ``chr1`` both become ``chr1``."""
    return F.when(name.startswith("chr"), name).otherwise(F.concat(F.lit("chr"), name))


def region_label(chrom: Column, low: Column, high: Column, reference: str = "GRCh38#0") -> Column:
    """``reference#chrom:low-high``; the label is not clamped at 0."""
    return F.concat(F.lit(f"{reference}#"), chrom, F.lit(":"), low.cast("string"), F.lit("-"), high.cast("string"))


def position_key(chrom: Column, pos: Column) -> Column:
    return F.concat_ws(":", chrom, pos.cast("string"))


def tabs(line: Column) -> Column:
    return F.split(line, "\t")


def tag_value(tag: Column) -> Column:
    """The third part of a ``name:type:value`` tag."""
    return F.get(F.split(tag, ":", 3), F.lit(2))


def base_name(path: Column) -> Column:
    """What follows the last slash, up to the first dot."""
    return F.get(F.split(F.element_at(F.split(path, "/"), -1), r"\."), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_truthy(name: Column, position: Column) -> Column:
    """Neither missing, empty nor zero."""
    return F.coalesce((name != "") & (position != 0), F.lit(False))


def walk_strands(walk: Column) -> Column:
    return F.regexp_extract_all(walk, F.lit(STEP_PATTERN), 1)


def walk_nodes(walk: Column) -> Column:
    return F.regexp_extract_all(walk, F.lit(STEP_PATTERN), 2)


def window_start(pos: Column, flank: int) -> Column:
    """Lower end of a window around a position, clamped at 0."""
    return F.greatest(F.lit(0).cast("long"), pos - F.lit(flank))


def graph_file(path: Column) -> Column:
    """The ``.vg`` name that goes with an ``.xg`` name."""
    return F.replace(path, F.lit(".xg"), F.lit(".vg"))


def joined(names: Column) -> Column:
    return F.array_join(names, ", ")


def node_id(raw: Column) -> Column:
    """Quoted and bare ids are the same node; what is no number is null."""
    return raw.cast("string").try_cast("bigint")


def every(count: Column, step: int) -> Column:
    """Whether a running count is at a multiple of ``step``, where reports and snapshots are due."""
    return (count > 0) & (count % F.lit(step) == 0)
