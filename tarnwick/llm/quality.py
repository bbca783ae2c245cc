"""Quality rules: thresholds that follow the data, per language and source.

Each text is measured; the measures of a (lang, source) group go into a mergeable quantile
sketch (DDSketch: counts of logarithmic buckets, relative error 1 %), which is nothing but a
count per bucket, so partial sketches of a hot group are merged map-side. Fences drawn from the
group's quartiles replace fixed cutoffs, and are joined back to the measures. DataFrame
operations only; texts are never shuffled.

Defined cases: a null text is empty and has no words; null lang and source count as empty strings; a measure without a base (no words, too few words) is null and never rejects; repeated rows
are measured each; very long texts are measured whole, in arrays of their words; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwick.session import materialise

SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r"
WINDOW = 5
GAMMA = 1.02
#: Words below which mean word length says nothing.
LEAST_WORDS = 30
#: measure: (least spread that a fence allows for, whether low values are fenced too). A fence is
#: FENCE spreads (interquartile range, or this least spread) beyond the quartile.
MEASURES = {"symbols": (0.05, False), "dup_lines": (0.12, False), "word_chars": (0.8, True)}
FENCE = 3.0


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def measure(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    size = lambda c: F.size(c).cast("long")
    chars = F.length(text)
    # Lines are compared whole; one with a word has a character that is no space.
    worded = F.filter(F.split(text, "\n"), lambda s: F.translate(s, " " + SPACES, "") != "")
    df = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        words_of(text).alias("words"),
        worded.alias("lines"),
        F.length(F.translate(text, " " + SPACES, "")).cast("long").alias("word_chars"),
        (chars - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    last = F.size("words") - WINDOW
    window = lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW)))
    df = df.select(
        *("doc_id", "lang", "source", "word_chars", "n_symbols"),
        size("words").alias("n_words"),
        size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(last > 0, F.transform(F.sequence(F.lit(0), last), window)).alias("windows"),
    )
    # Only a text with some window twice goes on: its windows sorted by hash, then the starts of
    # those that have an equal neighbour, then the words that these starts cover.
    twice = F.size("windows") > F.size(F.array_distinct("windows"))
    by_hash = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("pairs", F.when(twice, by_hash)).drop("windows")
    beside = lambda x, k: (F.get("pairs", k - 1)["h"] == x["h"]) | (F.get("pairs", k + 1)["h"] == x["h"])
    df = df.withColumn("starts", F.sort_array(F.transform(F.filter("pairs", beside), lambda x: x["i"]))).drop("pairs")
    covers = F.transform("starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - p, F.lit(WINDOW))))
    total = F.coalesce(F.aggregate(covers, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return df.withColumn("n_repeat_words", total).drop("starts")


def rates(measured: DataFrame) -> DataFrame:
    """The measures that adaptive fences are drawn for, null where they have no base."""
    words = F.col("n_words")
    return (
        measured.withColumn("m_symbols", F.when(words > 0, F.col("n_symbols") / words))
        .withColumn("m_dup_lines", F.when(F.col("n_lines") > 1, F.col("n_dup_lines") / F.col("n_lines")))
        .withColumn("m_word_chars", F.when(words >= LEAST_WORDS, F.col("word_chars") / words))
    )


def sketch(rated: DataFrame) -> DataFrame:
    """Mergeable sketches: (lang, source, measure, bucket, n). Sum n of equal keys to merge."""
    one = lambda m: F.struct(F.lit(m).alias("measure"), F.col(f"m_{m}").alias("x"))
    long = rated.select("lang", "source", F.explode(F.array(*map(one, MEASURES))).alias("m")).where("m.x IS NOT NULL")
    bucket = F.when(F.col("m.x") > 1e-9, F.ceil(F.log(F.col("m.x")) / math.log(GAMMA))).otherwise(F.lit(-1 << 30))
    return long.select("lang", "source", "m.measure", bucket.cast("int").alias("bucket")).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, at: dict[str, float]) -> DataFrame:
    """(lang, source, measure) and a column for each named quantile."""
    group = W.partitionBy("lang", "source", "measure")
    value = F.when(F.col("bucket") == -1 << 30, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (1 + GAMMA))
    ranked = sketches.select(
        "*",
        value.alias("x"),
        F.sum("n").over(group.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(group).alias("of"),
    )
    return ranked.groupBy("lang", "source", "measure").agg(
        *(F.min(F.when(F.col("upto") >= q * (F.col("of") - 1) + 1, F.col("x"))).alias(c) for c, q in at.items())
    )


def fences(sketches: DataFrame) -> DataFrame:
    """One row per (lang, source): lo_ and hi_ of each measure."""
    q = quantiles(sketches, {"q1": 0.25, "q3": 0.75})
    aggs = []
    for m, (least, low) in MEASURES.items():
        spread = FENCE * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        mine = F.col("measure") == m
        aggs.append(F.max(F.when(mine, F.col("q3") + spread)).alias(f"hi_{m}"))
        if low:
            aggs.append(F.max(F.when(mine, F.col("q1") - spread)).alias(f"lo_{m}"))
    return q.groupBy("lang", "source").agg(*aggs)


def judge(docs: DataFrame) -> DataFrame:
    """Measures, base_failed and kept for every row of docs (doc_id, lang, source, text)."""
    # Measured once: the few numbers of each row are written, and read for the sketches and for the verdicts.
    rated = rates(materialise(measure(docs), "measures"))
    limits = fences(sketch(rated))
    out = F.lit(False)
    for m, (_, low) in MEASURES.items():
        out = out | F.coalesce(F.col(f"m_{m}") > F.col(f"hi_{m}"), F.lit(False))
        if low:
            out = out | F.coalesce(F.col(f"m_{m}") < F.col(f"lo_{m}"), F.lit(False))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rated.join(limits, ["lang", "source"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~out).alias("kept")
    )
