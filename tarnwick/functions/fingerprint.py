"""Digests and content ids."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SHA256 = r"^sha256:[0-9a-f]{64}$"


def digest(c: Column) -> Column:
    """`sha256:` and the hex digest of a string's UTF-8."""
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def content_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(c.cast("binary"), 256), 1, 32))


def git_blob_sha1(content: Column) -> Column:
    """SHA-1 of a git blob with this content (binary)."""
    head = F.concat(F.lit("blob "), F.octet_length(content).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), content))


def fnv1a32(c: Column) -> Column:
    """FNV-1a over the UTF-16 code units of a string and the unit 0x1f after it, as `fnv1a32:<hex>`."""
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    codes = F.concat(F.transform(units, lambda u: F.conv(u, 16, 10).cast("bigint")), F.array(F.lit(0x1F).cast("bigint")))
    step = lambda h, u: F.expr("1L") * (h.bitwiseXOR(u) * F.lit(16777619)).bitwiseAND(F.lit(4294967295).cast("bigint"))
    h = F.aggregate(codes, F.lit(2166136261).cast("bigint"), step)
    return F.concat(F.lit("fnv1a32:"), F.lpad(F.lower(F.hex(h)), 8, "0"))


@F.pandas_udf(StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON text with sorted keys and no spaces."""
    return s.map(lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def fingerprint(*cols: Column) -> Column:
    """Digest of the JSON of columns, which are to be given in the order of their names."""
    return digest(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))


def ratio_permille(n: Column, d: Column) -> Column:
    """Parts per thousand, rounded down; 1000 where there is nothing to cover."""
    return F.when(d == 0, F.lit(1000)).otherwise(F.floor(n * 1000 / d)).cast("long")
