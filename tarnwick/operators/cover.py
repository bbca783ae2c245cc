"""Proof that segments tile their units: in order of start, without gap or overlap, each with the digest of its text.

Segments are counted by place first, so repeated rows are one entry; then a unit's entries meet its text in one row (both have to fit
a task), and one sweep over them finds all faults.

Defined cases: blank text between segments is no gap; a segment whose place is null or not in its unit has only the finding
`segment-bounds` and covers nothing; a repeated segment overlaps itself; a null text is empty; of a unit that comes twice the
least text counts; a unit without segments is a gap unless it is blank; units and segments may have further columns.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

BLANK = " \t\n\x0b\f\r"


def _faults(text: str, starts, ends, names, digests, counts) -> list[str]:
    """`code detail` of each fault; entries are in order of start."""
    out, reach = [], 0

    def gap(a: int, b: int) -> None:
        part = text[a:b]
        if part.strip(BLANK):
            first = a + len(part) - len(part.lstrip(BLANK))
            out.append(f"segment-gap {first}-{a + len(part.rstrip(BLANK))}")

    for a, b, name, digest, n in zip(starts, ends, names, digests, counts):
        if pd.isna(a) or pd.isna(b) or not 0 <= a < b <= len(text):
            out.append(f"segment-bounds {name}")
            continue
        a, b = int(a), int(b)
        if a < reach or n > 1:
            out.append(f"segment-overlap {name}")
        gap(reach, a)
        if digest != "sha256:" + hashlib.sha256(text[a:b].encode()).hexdigest():
            out.append(f"segment-digest {name}")
        reach = max(reach, b)
    gap(reach, len(text))
    return out


@F.pandas_udf(ArrayType(StringType()))
def _sweep(text: pd.Series, starts: pd.Series, ends: pd.Series, names: pd.Series, digests: pd.Series, counts: pd.Series) -> pd.Series:
    return pd.Series([_faults(*row) for row in zip(text, starts, ends, names, digests, counts)], dtype=object)


def cover_findings(units: DataFrame, segments: DataFrame) -> DataFrame:
    """Findings of segments (unit, name, start_char, end_char, text_digest) against units (unit, text), ends exclusive, in code points.

    The subject is the unit; the detail the segment's name, of a gap its place without the blanks around it. `segment-orphan`: there is no such unit.
    """
    place = [F.col(c).cast(t).alias(c) for c, t in (("start_char", "long"), ("end_char", "long"), ("name", "string"), ("text_digest", "string"))]
    each = segments.select("unit", *place).groupBy("unit", "start_char", "end_char", "name", "text_digest").agg(F.count("*").alias("n"))
    by_unit = each.groupBy(F.col("unit").alias("of")).agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "name", "text_digest", "n"))).alias("s"))
    texts = units.groupBy("unit").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    both = texts.join(by_unit, F.col("unit").eqNullSafe(F.col("of")), "full")
    parts = [F.coalesce(F.col(f"s.{c}"), F.array().cast(f"array<{t}>")) for c, t in (("start_char", "long"), ("end_char", "long"), ("name", "string"), ("text_digest", "string"), ("n", "long"))]
    found = both.where("text IS NOT NULL").select("unit", F.explode(_sweep("text", *parts)).alias("f"))
    lost = both.where("text IS NULL").select(F.col("of").alias("unit"), F.explode("s.name").alias("name")).select("unit", F.concat(F.lit("segment-orphan "), F.coalesce("name", F.lit("None"))).alias("f"))
    all_ = found.unionByName(lost)
    return all_.select(F.substring_index("f", " ", 1).alias("code"), F.lit("error").alias("severity"), F.col("unit").cast("string").alias("subject"), F.expr("substring(f, instr(f, ' ') + 1)").alias("detail"))
