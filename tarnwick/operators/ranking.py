"""Places of rows in an order, without a window whose group grows with the data.

Rows are dealt to ranges of group and order, sorted inside their range and numbered there while they are written. A group
that lies in several ranges is counted in each, and the counts of its earlier ranges are added to the numbers of the later
ones. The only window runs over these counts: one row for each range that a group lies in. The number of ranges follows the
number of rows, so a source with a third of all rows is sorted by a third of the tasks.

Defined cases: nulls come where the order puts them, and a null group is a group; rows that are equal in the whole order
take neighbouring places in some order, and are spread over ranges like others; a column called like the place is
replaced; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwick.functions.text import locale
from tarnwick.session import materialise

#: Rows that a task sorts, about.
PER_RANGE = 1_000_000
_LOW = (1 << 33) - 1


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "place", per_range: int = PER_RANGE, count: int | None = None) -> DataFrame:
    """rows and their place (long, from 1) within their group, or among all rows without one.

    The rows are computed for their count (unless it is given), for a sample that sets the ranges, and for the sorted
    copy in the shared folder; what is dear to compute is better written before.
    """
    tie = "_tie"
    while tie in {c.lower() for c in rows.columns}:
        tie = "_" + tie
    ranges = max(1, math.ceil((rows.count() if count is None else count) / per_range))
    keys = [*group, *order, tie]
    kept = [c for c in rows.columns if c.lower() != name.lower() or c in group]
    dealt = rows.withColumn(tie, F.rand(11)).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    # an id is the number of the range, shifted by 33 bits, and the place of the row in it
    numbered = dealt.select(F.struct(*kept).alias("row"), F.struct(F.lit(0).alias("all"), *(F.col(g).alias(f"g{k}") for k, g in enumerate(group))).alias("of"), F.monotonically_increasing_id().alias("id"))
    numbered = numbered.select("row", "of", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(F.lit(_LOW)).alias("at"))
    written = materialise(numbered, "ranges")
    pieces = written.groupBy("part", "of").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = F.sum("n").over(W.partitionBy("of").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    shifts = pieces.select("part", "of", (F.coalesce(earlier, F.lit(0)) - F.col("first") + 1).alias("shift"))
    out = written.join(shifts, ["part", "of"])
    return out.select("row.*", (F.col("at") + F.col("shift")).cast("long").alias(name))


def by_locale(rows: DataFrame, columns: Sequence[str], name: str = "place", per_range: int = PER_RANGE) -> DataFrame:
    """rows and their place in the order of columns, texts among them sorted by locale and, where that holds them equal, by code point."""
    keys: list[Column] = []
    for c in columns:
        keys += [locale(F.col(c)), F.col(c)] if rows.schema[c].dataType.typeName() == "string" else [F.col(c)]
    return placed(rows, [], keys, name, per_range)


def before(rows: DataFrame, group: Sequence[str], place: str, columns: Sequence[str], mark: str = "before_") -> DataFrame:
    """rows (placed) with columns of the row one place earlier in their group, null for the first.

    An equality join by group and place: its keys are unique, so no group is hot.
    """
    left, right = rows.alias("l"), rows.select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)), (F.col(place) + 1).alias("_p"), *(F.col(c).alias(mark + c) for c in columns))
    on = F.col(f"l.{place}") == F.col("_p")
    for k, g in enumerate(group):
        on = on & F.col(f"l.{g}").eqNullSafe(F.col(f"_g{k}"))
    return left.join(right, on, "left").drop("_p", *(f"_g{k}" for k in range(len(group))))
