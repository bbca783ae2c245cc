"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwick.llm.oracles import ORACLES as ORACLES
from tarnwick.session import table, workers_see_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        workers_see_package(spark)
        # Rows are wide: small batches keep the Python side of an executor small.
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm import chat

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    # Every row of the table is a message of its own, in the order of turns, logged as it is streamed:
    # a start with the first half of its text, then a delta with the other.
    nth = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("start").alias("kind"), F.substring("text", F.lit(1), half).alias("text")),
        F.struct(F.lit(1).alias("part"), F.lit("delta").alias("kind"), F.substring("text", half + 1, F.length("text")).alias("text")),
    )
    # Numbered before they are exploded: in one projection the rows would be numbered after it.
    numbered = rows.withColumn("msg", nth)
    events = numbered.select("conv_id", "msg", "role", F.explode(parts).alias("e")).select("conv_id", (F.col("msg") * 2 + F.col("e.part")).alias("seq"), "msg", "e.kind", "role", "e.text")
    back = chat.format_chats(events).select("conv_id", "formatted", "loss_spans", chat.parse(F.col("formatted")).alias("turns"))
    under_mask = F.transform("loss_spans", lambda s: chat.unescape(F.substring("formatted", s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    back = back.withColumn("loss", F.array_join(under_mask, ""))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: (host, path, verdict)
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm import urls

    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm import quality

    return quality.judge(table(spark, sf_dir, "documents"))


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tarnwick.llm import bpe, units

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    units.bring_file(spark, path)
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm import toxicity

    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm import warc
    from tarnwick.session import materialise

    archives = materialise(warc.write_archives(warc.decide(table(spark, sf_dir, "pages"))), "warc")
    records = warc.read_archives(archives).where("kind IN ('response', 'revisit')")
    return records.select(
        F.expr("try_cast(regexp_extract(record_id, '<urn:page:(-?[0-9]+)>', 1) AS BIGINT)").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        F.expr("try_cast(regexp_extract(refers_to, '<urn:page:(-?[0-9]+)>', 1) AS BIGINT)").alias("refers_to"),
    )


@query
def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm import media

    told = F.transform("clips", lambda c: F.format_string("%.2f-%.2f", c["start_s"], c["end_s"]))
    feature = F.concat(F.lit("clips="), F.size("clips").cast("string"), F.lit(";"), F.array_join(told, ","))
    return media.read(media.store(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature")
    )


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm import suffix

    out = suffix.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), 400)
    return out.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        (F.octet_length(F.coalesce("text", F.lit(""))) - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.when(F.size("spans") > 0, suffix.as_text(F.col("kept"))).otherwise(F.coalesce("text", F.lit(""))).alias("text"),
    )


@query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm import jaccard

    out = jaccard.join(table(spark, sf_dir, "documents"), 4, 85, 100)
    return out.withColumnRenamed("n_ngrams", "n_shingles")


def domain_of(source: F.Column) -> F.Column:
    """The domain of a source: the tables have none, so three are dealt out by a hash of the name."""
    digit = F.conv(F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 1), 16, 10).cast("int")
    return F.concat(F.lit("domain"), (digit % 3).cast("string"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm import mixing, quality

    docs = table(spark, sf_dir, "documents")
    words = F.size(quality.words_of(F.coalesce("text", F.lit(""))))
    out = mixing.mix(docs.select("doc_id", "text", "lang", "source"), words, domain_of(F.col("source")))
    return out.select("doc_id", "domain", "lang", "source", "n_tokens", "epochs")


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm import fim

    out = fim.transform(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query
def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tarnwick.llm import units, word_bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    units.bring_file(spark, path)
    both = word_bpe.decode(word_bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tarnwick.llm import alignment, units
    from tarnwick.session import materialise

    path = public_tokenizers.path
    files = alignment.Files(path("byte_bpe_50k.tiktoken"), path("byte_bpe_50k.json"), public_tokenizers.PATTERN, path("piece_bpe_32k.model"))
    for file in (files.ranks, files.library, files.model):
        units.bring_file(spark, file)
    tokens = materialise(alignment.tokenise(table(spark, sf_dir, "documents"), files), "tokens")
    out = alignment.align(tokens, files, alignment.count_links(tokens, files))
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", sha.alias("groups_sha256"))
