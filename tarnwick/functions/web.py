"""URLs and HTTP outcomes as columns; the transfers themselves are no business of Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest pause that a server can ask for, in milliseconds (fixed value).
MOST_PAUSE = 300_000


def endpoint_allowed(url: Column, host: str, path: str) -> Column:
    """https, this host, a path of this pattern, and neither credentials nor fragment."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    ok = (part("PROTOCOL") == "https") & (part("HOST") == host) & F.coalesce(part("PATH"), F.lit("/")).rlike(path)
    return F.coalesce(ok & part("USERINFO").isNull() & part("REF").isNull(), F.lit(False))


def retry_after_ms(value: Column, now: Column) -> Column:
    """Milliseconds to wait: of a number of seconds or an HTTP date, at most MOST_PAUSE; else null."""
    seconds = F.trim(value).try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(F.trim(value), r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    until = (F.unix_millis(date) - F.unix_millis(now)).cast("double")
    ms = F.when(seconds >= 0, F.ceil(seconds * 1000)).when(seconds.isNull() & until.isNotNull(), F.greatest(until, F.lit(0.0)))
    return F.when(ms.isNotNull(), F.least(F.lit(float(MOST_PAUSE)), ms)).cast("long")


def backoff_ms(attempt: Column, base: int = 1500) -> Column:
    return F.least(F.lit(MOST_PAUSE), F.lit(base) * F.pow(F.lit(2), attempt)).cast("long")


def outcome(http: Column, size: Column, most: int, private: Column) -> Column:
    """What became of a request, the first that applies."""
    return F.when(http.isNull() | (http >= 500), "error").when(http.isin(401, 403), "blocked-credential").when(http.isin(404, 410), "unavailable").when(size > most, "rejected-oversize").when(private, "rejected-private-contact").otherwise("observed")


def build_url(base: str, **params: Column) -> Column:
    """base and its query, parameters by name, null ones left out."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(k + "="), F.url_encode(c.cast("string")))) for k, c in sorted(params.items())]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *parts))
