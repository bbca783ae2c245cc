"""Case folding against every code point, and the order of the locale."""

import pandas as pd
from pyspark.sql import functions as F

from tarnwick.functions import text as X
from tarnwick.operators import ranking


def test_casefold_every_code_point(spark):
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x20000 or i % 97 == 0)]
    texts = chars + ["".join(chars[i : i + 50]) for i in range(0, len(chars), 50)] + ["", "Straße ΟΔΟΣ ﬁnﬃ İI ıi"]
    df = spark.createDataFrame(pd.DataFrame({"t": texts})).select("t", X.casefold(F.col("t")).alias("f"))
    assert [(t, f) for t, f in df.toPandas().itertuples(index=False) if f != t.casefold()] == []
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(X.casefold(F.col("t"))).first()[0] is None


def test_locale_order(spark):
    words = ["_a", "10", "9", "co-op", "coop", "eclair", "éclair", "Eclair", "strasse", "Straße", "zebra", "Zebra"]
    want = ["_a", "10", "9", "co-op", "coop", "eclair", "Eclair", "éclair", "strasse", "Straße", "zebra", "Zebra"]
    rows = spark.createDataFrame([(w,) for w in reversed(words)] + [(None,)], "w string")
    for per_range in (1_000_000, 3):
        got = ranking.by_locale(rows, ["w"], per_range=per_range).orderBy("place").collect()
        assert [r.w for r in got] == [None, *want] and [r.place for r in got] == list(range(1, 14))
    assert ranking.by_locale(rows.limit(0), ["w"]).count() == 0
