"""Joins of overlapping intervals, by equality of bins instead of by comparing all with all.

An interval whose length has k bits lies in at most two bins of width 2^k. For a pair the bins of the longer one decide: each
interval is put into its own bins once, and into those of every larger width that the other side has, again two at most.
Pairs that overlap share the bin in which the later of them starts, and are given there only, so none comes twice. What
meets in a bin lies within a few lengths of the longer interval; apart from that, work follows the result.

Defined cases: intervals are closed, so touching ones overlap; one with a null end, or that ends before it starts, overlaps
nothing; a null key equals nothing; repeated rows pair as often as they come; empty tables give no pairs. Ends are whole
numbers, dates or timestamps, of one type on both sides. Both sides of each join are plain exchanges, so Spark can split a crowded bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SHIFT = "shiftright"
Ends = tuple[str, str]


def _whole(df: DataFrame, c: str) -> Column:
    """An end as a long in the order of its type."""
    kind = df.schema[c].dataType.typeName()
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))
    if kind == "date":
        return F.unix_date(c).cast("long")
    if kind in ("byte", "short", "integer", "long"):
        return F.col(c).cast("long")
    raise ValueError(f"{c}: intervals of type {kind} are not known")


def _side(df: DataFrame, ends: Ends, keys: Sequence[str], name: str) -> DataFrame:
    a, b = (_whole(df, c) for c in ends)
    rows = df.select(F.struct("*").alias(name), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), a.alias(f"{name}_a"), b.alias(f"{name}_b")).where(f"{name}_a <= {name}_b")
    size = F.col(f"{name}_b") - F.col(f"{name}_a")
    return rows.withColumn(f"{name}_bits", F.when(size == 0, 0).otherwise(F.length(F.bin(size))))


def _binned(rows: DataFrame, name: str, levels: Column) -> DataFrame:
    """rows in each of their bins of the widths 2^level."""
    at = rows.withColumn("level", F.explode(levels))
    first, last = (F.call_function(_SHIFT, F.col(f"{name}_{e}"), F.col("level")) for e in "ab")
    return at.withColumn("bin", F.explode(F.array_distinct(F.array(first, last))))


def overlap_join(left: DataFrame, right: DataFrame, left_ends: Ends, right_ends: Ends, keys: Sequence[str] = ()) -> DataFrame:
    """(left, right), structs of the rows whose intervals overlap and whose keys are equal."""
    sides = {"left": _side(left, left_ends, keys, "left"), "right": _side(right, right_ends, keys, "right")}
    # at most 64 numbers for each side
    has = {n: sorted(r[0] for r in s.select(f"{n}_bits").distinct().collect()) for n, s in sides.items()}
    on = [*(f"k{i}" for i in range(len(keys))), "level", "bin"]
    found = []
    for wide, narrow, equal in (("right", "left", True), ("left", "right", False)):
        own = F.col(f"{narrow}_bits")
        levels = F.filter(F.array(*map(F.lit, has[wide])).cast("array<int>"), lambda v: v >= own if equal else v > own)  # noqa: B023
        a = _binned(sides[narrow], narrow, levels)
        b = _binned(sides[wide], wide, F.array(F.col(f"{wide}_bits")))
        pairs = a.join(b, on).where("left_a <= right_b AND right_a <= left_b")
        found.append(pairs.where(F.call_function(_SHIFT, F.greatest("left_a", "right_a"), F.col("level")) == F.col("bin")).select("left", "right"))
    return found[0].unionByName(found[1])
