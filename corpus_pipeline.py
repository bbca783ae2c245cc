"""A corpus pipeline: documents pass five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.

Defined cases: null and empty texts pass the first three stages, have no tokens in the fourth, and
are taken there only with a prefix that they cost nothing of; rows with a null doc_id are linked
with nothing and stay; of rows with one doc_id one stays; texts of any length are taken whole; an
empty table gives empty results; further columns of documents are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwick.llm import bpe, jaccard, mixing, quality, suffix, toxicity, units
from tarnwick.llm.queries import domain_of
from tarnwick.session import materialise, table, workers_see_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Shingles of five words, a similarity of 0.8 or more.
WORDS, NUM, DEN = 5, 80, 100
#: Bytes of a repeated passage: 50 words of the corpus take about 280, so shorter than that.
PASSAGE = 200


def no_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from labels of documents that are here."""
    w, b = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs.select(*COLUMNS), w, b).where("score < 0.5").select(*COLUMNS)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, once."""
    found = jaccard.join(docs, WORDS, NUM, DEN)
    stays = found.where("doc_id = component_id").select("doc_id").distinct()
    one = W.partitionBy("doc_id").orderBy("text", "lang", "source")
    kept = docs.select(*COLUMNS).join(stays, "doc_id", "left_semi").withColumn("_n", F.row_number().over(one)).where("_n = 1")
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start twice are cut out; a document of which no word is left goes."""
    out = suffix.dedup(docs.select(*COLUMNS), PASSAGE)
    cut = F.size("spans") > 0
    text = F.when(cut, suffix.as_text(F.col("kept"))).otherwise(F.col("text"))
    out = out.withColumn("text", text).where(~cut | (F.size(quality.words_of(F.col("text"))) > 0))
    return out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are taken as often as the mixture says."""
    words = F.size(quality.words_of(F.coalesce("text", F.lit(""))))
    out = mixing.mix(docs.select(*COLUMNS), words, domain_of(F.col("source")))
    return out.select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), F.col("epochs"))).alias("_")).select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    units.bring_file(spark, path)
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", no_toxicity),
    ("ngram_jaccard", no_near_copies),
    ("suffix_dedup", no_repeats),
    ("mixing", to_weights),
    ("byte_bpe", to_tokens),
]
for _i, (_name, _f) in enumerate(STAGES):

    def _ready(spark: SparkSession, docs: DataFrame, sf_dir: str, f=_f) -> DataFrame:
        workers_see_package(spark)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
        return f(spark, docs, sf_dir)

    STAGES[_i] = (_name, _ready)

#: A classifier, tokenizers and byte strings: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
