"""Findings algebra: every rule is a query that gives (code, severity, subject, detail)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("code", "severity", "subject", "detail")
RANK = {"error": 0, "warning": 1, "notice": 2}


def finding(df: DataFrame, code: str, severity: str, subject: Column, detail: Column | str = "") -> DataFrame:
    text = detail if isinstance(detail, Column) else F.lit(detail)
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), text.cast("string").alias("detail"))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def by_severity(findings: DataFrame) -> DataFrame:
    """Severity, subject, code, detail."""
    return findings.orderBy(_rank(), "subject", "code", "detail")


def by_code(findings: DataFrame) -> DataFrame:
    """Severity, code, subject, detail."""
    return findings.orderBy(_rank(), "code", "subject", "detail")


def _rank() -> Column:
    out = F.lit(len(RANK))
    for name, r in RANK.items():
        out = F.when(F.col("severity") == name, r).otherwise(out)
    return out


def duplicates(df: DataFrame, key: str, code: str = "duplicate-id") -> DataFrame:
    twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return finding(twice, code, "error", F.col(key), F.concat(F.col("n").cast("string"), F.lit(" rows")))


def missing_reference(df: DataFrame, subject: str, ref: str, known: DataFrame, key: str, code: str = "missing-reference") -> DataFrame:
    """References (a column or an array of them) that no row of known has."""
    refs = df.select(F.col(subject).alias("_s"), (F.explode(ref) if df.schema[ref].dataType.typeName() == "array" else F.col(ref)).alias("_r"))
    lost = refs.where("_r IS NOT NULL").join(known.select(F.col(key).alias("_r")).distinct(), "_r", "left_anti")
    return finding(lost, code, "error", F.col("_s"), F.col("_r").cast("string"))


def orphans(df: DataFrame, key: str, other: DataFrame, code: str) -> DataFrame:
    return finding(df.join(other.select(key).distinct(), key, "left_anti"), code, "error", F.col(key))


def out_of_range(df: DataFrame, subject: str, value: str, low: Column, high: Column, code: str = "out-of-range") -> DataFrame:
    return finding(df.where((F.col(value) < low) | (F.col(value) > high)), code, "error", F.col(subject), F.col(value).cast("string"))


def count_drift(projected: DataFrame, rows: DataFrame, key: str, column: str, code: str = "count-drift") -> DataFrame:
    """Keys whose projected count is not that of the rows."""
    real = rows.groupBy(key).agg(F.count("*").alias("_real"))
    both = projected.select(key, F.col(column).alias("_said")).join(real, key, "full")
    bad = both.where("NOT (coalesce(_said, 0) = coalesce(_real, 0))")
    return finding(bad, code, "error", F.col(key), F.concat_ws("/", F.coalesce("_said", F.lit(0)).cast("string"), F.coalesce("_real", F.lit(0)).cast("string")))


def not_contiguous(df: DataFrame, group: str, order: str, code: str = "order-gap") -> DataFrame:
    """Groups whose orders are not 0, 1, 2 ...: known from count, least and greatest alone."""
    s = df.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(order).alias("d"), F.min(order).alias("lo"), F.max(order).alias("hi"))
    return finding(s.where("lo <> 0 OR hi <> n - 1 OR d <> n"), code, "error", F.col(group))


def parity(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], code: str = "parity") -> DataFrame:
    """Keys of both sides where a column differs; arrays are compared without order."""
    same = lambda c: (F.array_sort(left[c]).eqNullSafe(F.array_sort(right[c])) if left.schema[c].dataType.typeName() == "array" else left[c].eqNullSafe(right[c]))
    joined = left.join(right, left[key] == right[key])
    return union([finding(joined.where(~same(c)), f"{code}-{c}", "error", left[key], F.lit(c)) for c in columns])


def exactly_one(df: DataFrame, other: DataFrame, key: str, code: str) -> DataFrame:
    """Rows of df that other does not match once."""
    n = other.groupBy(key).agg(F.count("*").alias("_n"))
    return finding(df.join(n, key, "left").where("coalesce(_n, 0) <> 1"), code, "error", F.col(key), F.coalesce("_n", F.lit(0)).cast("string"))


def exclusive_groups(active: DataFrame, group: str, member: str, code: str = "exclusive-conflict") -> DataFrame:
    """Groups of which more than one member is active."""
    g = active.where(F.col(group).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("m")).where(F.size("m") > 1)
    return finding(g, code, "error", F.col(group), F.array_join(F.transform("m", lambda x: x.cast("string")), ", "))


def passed(findings: DataFrame) -> DataFrame:
    """One row: errors, warnings, passed."""
    e, w = (F.count_if(F.col("severity") == s) for s in ("error", "warning"))
    return findings.agg(e.alias("errors"), w.alias("warnings"), (e == 0).alias("passed"))
