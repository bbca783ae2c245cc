"""Full-text search over a stored index: TF-IDF with a phrase bonus, BM25, and many phrases at once.

The index is four tables: postings (term, doc_id, len, tf, positions, starts, ends), dictionary (term,
document_frequency, total_frequency), documents (doc_id and further columns, no text) and stats (n_docs, avg_len:
one row). Postings lie in folders by a hash of the term and are sorted by term in each, so the terms of a query decide which
folders are read, and filters of the scan which row groups of them. Many phrases at once read the folders of their terms.

Two tokenisers: `words` (inner apostrophes, dots and hyphens kept; NFKC and lower case) and `folded` (runs of
letters and digits, lower case, without diacritics). A null text has no tokens; rows that share a doc_id are
documents of their own in postings and are told apart nowhere else, so doc_id should be unique.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions import text as X
from tarnwick.session import frugal, materialise, spread

KINDS = ("words", "folded")
#: Bytes of a row group of postings: small, so that a filter on terms passes over most and what is left is read by many tasks.
ROW_GROUP = 8 << 20
#: Documents for each folder of postings, and the most folders that there are.
PER_BUCKET, MOST_BUCKETS = 1_000, 8_192
#: Documents for each slice of a build, and the most slices that there are; likewise for each pass of a verification.
PER_SLICE, MOST_SLICES = 12_500, 8
#: Places ascend within a row and documents within a term, so their differences are stored.
PACKED = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"} | {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "positions.list.element", "starts.list.element", "ends.list.element")}
#: Up to so many terms of a batch of phrases are filters of the scan itself; of more, the folders are.
FEW_TERMS = 200


class Index(NamedTuple):
    postings: DataFrame
    dictionary: DataFrame
    documents: DataFrame
    stats: DataFrame
    of: int | None = None  #: folders of the postings; none in an index that was not written


def tokenised(docs: DataFrame, kind: str = "words", text: str = "text") -> DataFrame:
    """docs with `tokens`, the array of lower-case tokens in order (without NFKC, which only the index applies)."""
    c = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("tokens", X.words(c) if kind == "words" else X.tokens(X.fold(c)))


def _found(docs: DataFrame, kind: str) -> DataFrame:
    """(doc_id, tok, upto): tokens of each row, and the texts from the end of one to the end of the next."""
    if kind not in KINDS:
        raise ValueError(f"no such tokeniser: {kind}")
    c = F.coalesce("text", F.lit(""))
    if kind == "folded":
        return spread(docs.select("doc_id", "text")).select("doc_id", X.tokens(X.fold(c)).alias("tok"), F.array().cast("array<int>").alias("upto"))
    each = rf"[^\p{{L}}\p{{N}}]*({X.WORD})"
    upto = F.transform(F.regexp_extract_all(c, F.lit(each), F.lit(0)), F.length)
    return spread(docs.select("doc_id", "text")).select("doc_id", F.regexp_extract_all(c, F.lit(each), F.lit(1)).alias("tok"), upto.alias("upto"))


class _Batch:
    """The tokens of a batch of rows as arrays, grouped by row and term."""

    def __init__(self, tok: pa.ListArray, normal: bool) -> None:
        flat = tok.flatten().dictionary_encode()
        self.raw, self.names, code = flat, flat.dictionary, np.asarray(flat.indices)
        if normal:
            again = pa.array([unicodedata.normalize("NFKC", t).lower() for t in self.names.to_pylist()], pa.string()).dictionary_encode()
            self.names, code = again.dictionary, np.asarray(again.indices)[code] if len(code) else code
        self.size = np.diff(np.asarray(tok.offsets))
        self.row = np.repeat(np.arange(len(tok)), self.size)
        self.first = np.cumsum(self.size) - self.size
        self.pos = np.arange(len(code)) - np.repeat(self.first, self.size)
        key = self.row * max(1, len(self.names)) + code
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        self.edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.tf = np.diff(np.append(self.edge, len(key)))
        self.code = code[self.order][self.edge]
        self.of = self.row[self.order][self.edge]

    def lists(self, values: np.ndarray) -> pa.ListArray:
        offsets = np.append(self.edge, len(self.order)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[self.order].astype(np.int32)))


_COLUMNS = "term string, doc_id {key}, len int, tf bigint, positions array<int>, starts array<int>, ends array<int>"


def postings(docs: DataFrame, kind: str = "words") -> DataFrame:
    """(term, doc_id, len, tf, positions, starts, ends) of docs (doc_id, text); counted inside each row, so
    nothing is shuffled. starts and ends are places in the text (code points), empty for `folded`."""
    normal = kind == "words"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch.column(1), normal)
            if not len(b.of):
                continue
            if normal:
                end = np.cumsum(np.asarray(batch.column(2).flatten()))
                end = end - np.repeat(np.append(0, end)[b.first], b.size)
                start = end - np.asarray(pa.compute.utf8_length(b.raw.dictionary))[np.asarray(b.raw.indices)]
                places = [b.lists(start), b.lists(end)]
            else:
                places = [pa.array([[]], pa.list_(pa.int32())).take(pa.array(np.zeros(len(b.of), np.int32)))] * 2
            cols = [b.names.take(pa.array(b.code)), batch.column(0).take(pa.array(b.of)), pa.array(b.size[b.of], pa.int32()), pa.array(b.tf, pa.int64()), b.lists(b.pos), *places]
            yield pa.RecordBatch.from_arrays(cols, ["term", "doc_id", "len", "tf", "positions", "starts", "ends"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return _found(docs, kind).mapInArrow(run, _COLUMNS.format(key=key))


def dictionary(index: DataFrame) -> DataFrame:
    """(term, document_frequency, total_frequency) of postings."""
    return index.groupBy("term").agg(F.count("*").alias("document_frequency"), F.sum("tf").alias("total_frequency"))


def term_dictionary(docs: DataFrame, kind: str = "words") -> DataFrame:
    """The dictionary without postings: counted per batch of rows first, so few rows are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch.column(0), kind == "words")
            df = np.bincount(b.code, minlength=len(b.names))
            total = np.bincount(b.code, b.tf, len(b.names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.names, pa.array(df), pa.array(total)], ["term", "df", "tf"])

    part = _found(docs, kind).select("tok").mapInArrow(run, "term string, df bigint, tf bigint")
    return part.groupBy("term").agg(F.sum("df").alias("document_frequency"), F.sum("tf").alias("total_frequency"))


def bucket(term: Column, of: Column) -> Column:
    """The folder of a term's postings."""
    return F.pmod(F.xxhash64(term), of).cast("int")


def slices_of(n: int) -> int:
    """In how many parts a job over n documents is done."""
    return max(1, min(MOST_SLICES, n // PER_SLICE))


def build_index(docs: DataFrame, path: str, kind: str = "words") -> Index:
    """Writes the index of docs (doc_id, text, ...) under path.

    Postings are dealt by folder and sorted; the rebalance lets Spark split a folder with a hot term. Their shuffle takes
    several times the room of the texts, so large tables are dealt in slices of the documents, one after the other, each
    of which leaves files of its own.
    """
    spark = docs.sparkSession
    docs.drop("text").write.parquet(f"{path}/documents")
    n = spark.read.parquet(f"{path}/documents").count()
    of = max(1, min(MOST_BUCKETS, -(-n // PER_BUCKET)))
    slices = slices_of(n)
    for k in range(slices):
        part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(slices)) == k) if slices > 1 else docs
        dealt = postings(part, kind).withColumn("bucket", bucket(F.col("term"), F.lit(of))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc_id")
        # The number of folders is the name of the one above them, so that every scan knows it.
        with frugal(spark):
            dealt.write.mode("append" if k else "error").options(**PACKED).option("parquet.block.size", ROW_GROUP).partitionBy("bucket").parquet(f"{path}/postings/of={of}")
    own = _stored_postings(spark, path)
    dictionary(own).write.parquet(f"{path}/dictionary")
    tokens = spark.read.parquet(f"{path}/dictionary").agg(F.coalesce(F.sum("total_frequency"), F.lit(0)).alias("_all"))
    # one row
    tokens.select(F.lit(n).cast("long").alias("n_docs"), (F.col("_all") / F.nullif(F.lit(n), F.lit(0))).alias("avg_len")).coalesce(1).write.parquet(f"{path}/stats")
    return open_index(spark, path)


def _of_terms(index: Index, terms: Sequence[str]) -> DataFrame:
    """The postings of these terms."""
    rows = index.postings.where(F.col("term").isin(list(terms)))
    return rows.where(F.col("bucket").isin(*(bucket(F.lit(t), F.lit(index.of)) for t in terms))) if index.of and terms else rows


def _of_many(index: Index, terms: DataFrame) -> DataFrame:
    """The postings that a join with terms (term), written before, has to look at."""
    if not index.of:
        return index.postings
    asked = terms.select("term", bucket(F.col("term"), F.lit(index.of)).alias("bucket")).distinct()
    few = asked.limit(FEW_TERMS + 1).collect()
    rows = index.postings.where(F.col("term").isin([r.term for r in few])) if len(few) <= FEW_TERMS else index.postings
    # at most MOST_BUCKETS numbers
    folders = few if len(few) <= FEW_TERMS else asked.select("bucket").distinct().collect()
    return rows.where(F.col("bucket").isin(sorted({r.bucket for r in folders})))


def _stored_postings(spark: SparkSession, path: str) -> DataFrame:
    """With the schema given, as an index without any token has no files."""
    key = spark.read.parquet(f"{path}/documents").schema["doc_id"].dataType.simpleString()
    return spark.read.schema(_COLUMNS.format(key=key) + ", of int, bucket int").parquet(f"{path}/postings")


def open_index(spark: SparkSession, path: str) -> Index:
    index = Index(_stored_postings(spark, path), *(spark.read.parquet(f"{path}/{name}") for name in ("dictionary", "documents", "stats")))
    row = index.postings.select("of").first()
    return index._replace(of=row["of"] if row else None)


# Queries.


def split_query(query: str) -> list[str]:
    """Terms of a query by the tokeniser `words`; ValueError if it has none."""
    found = [unicodedata.normalize("NFKC", t).lower() for t in re.findall(r"[^\W_]+(?:['’.-][^\W_]+)*", query)]
    if not found:
        raise ValueError("the query has no searchable terms")
    return found


def query_units(query: str) -> list[tuple[str, ...]]:
    """The words of a query, each as the `folded` terms that it falls into: of more than one, a phrase."""
    found = re.findall(r"[\w’']+", query)
    if not found:
        raise ValueError("the query has no searchable terms")
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
    return [tuple(re.findall(r"[^\W_]+", plain(t))) for t in found]


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by) if by else places


def _starts(unit: Sequence[str], column: dict[str, str]) -> Column:
    """Places where a phrase starts; by hash, so in proportion to the places of its terms."""
    empty = F.array().cast("array<int>")
    places = [_shifted(F.coalesce(column[t], empty), k) for k, t in enumerate(unit)]
    return reduce(F.array_intersect, places) if places else empty


def _matches(index: Index, terms: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """A row for each document with any of the terms: len, and `_p<k>`, the places of term k, `_c<k>`, its least start."""
    column = {t: f"_p{k}" for k, t in enumerate(terms)}
    rows = _of_terms(index, terms)
    own = lambda t, c: F.max(F.when(F.col("term") == t, c))
    least = [F.min(F.array_min("starts")).alias("first_char")]
    return rows.groupBy("doc_id").agg(F.max("len").alias("_len"), *least, *(own(t, F.col("positions")).alias(c) for t, c in column.items())), column


def _best(index: Index, scored: DataFrame, by: Column, order: Sequence[str], filters: Column | None, limit: int) -> DataFrame:
    """The first rows with the documents' columns; those are joined before the limit only where it depends on them."""
    docs = index.documents
    if filters is None and all(c in scored.columns for c in order):
        few = scored.orderBy(by, *order).limit(limit)
        return docs.join(F.broadcast(few), "doc_id").orderBy(by, *order)  # `limit` rows at most
    joined = scored.join(docs, "doc_id")
    return (joined.where(filters) if filters is not None else joined).orderBy(by, *order).limit(limit)


def _mode(mode: str) -> None:
    if mode not in ("any", "all", "phrase"):
        raise ValueError(f"no such mode: {mode}")


def tfidf(index: Index, query: str, mode: str = "all", limit: int = 20, order: Sequence[str] = ("doc_id",), filters: Column | None = None) -> DataFrame:
    """Best matches in an index of `words` (documents' columns) with score, matched_terms, matched_positions, first_char.

    Score: sum of idf (1 + ln tf) over present terms, idf = ln((N + 1) / (df + 1)) + 1; where the
    query stands as a phrase 4 + ln(times + 1) besides, in every mode; and the share of terms present.
    """
    _mode(mode)
    terms, limit = split_query(query), max(1, min(int(limit), 200))
    unique = list(dict.fromkeys(terms))
    df, column = _matches(index, unique)
    present = {t: F.col(c).isNotNull() for t, c in column.items()}
    df = df.withColumn("_starts", _starts(terms, column))
    known = index.dictionary.where(F.col("term").isin(unique)).agg(*(F.max(F.when(F.col("term") == t, F.col("document_frequency"))).alias(f"_df{k}") for k, t in enumerate(unique)))
    # statistics are one row: the join replicates a single row of known width
    df = df.join(F.broadcast(index.stats.join(F.broadcast(known))))
    if mode != "any":
        df = df.where(F.size("_starts") > 0 if mode == "phrase" else reduce(Column.__and__, present.values()))
    score = F.lit(0.0)
    for k, (t, p) in enumerate(present.items()):
        idf = F.log((F.col("n_docs") + 1) / (F.coalesce(f"_df{k}", F.lit(0)) + 1)) + 1
        score = score + F.when(p, idf * (1 + F.log(F.size(column[t]).cast("double")))).otherwise(0.0)
    phrase = F.size("_starts")
    score = score + F.when(phrase > 0, 4 + F.log(phrase + F.lit(1.0))).otherwise(0.0)
    score = score + sum((p.cast("int") for p in present.values()), F.lit(0)) / len(unique)
    empty = F.array().cast("array<int>")
    positions = F.array_sort(F.array_distinct(F.concat(*(F.coalesce(c, empty) for c in column.values()), F.col("_starts"))))
    matched = F.array_sort(F.filter(F.array(*(F.when(p, F.lit(t)) for t, p in present.items())), lambda t: t.isNotNull()))
    out = df.select("doc_id", F.round(score, 8).alias("score"), matched.alias("matched_terms"), positions.alias("matched_positions"), "first_char")
    return _best(index, out, F.desc("score"), order, filters, limit)


def bm25(index: Index, query: str, mode: str = "all", limit: int = 20, order: Sequence[str] = ("doc_id",), filters: Column | None = None) -> DataFrame:
    """Best matches in an index of `folded` (documents' columns) with rank, which is negative: smaller is better.

    Okapi with k1 = 1.2 and b = 0.75; idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6. A word of
    the query that falls into several terms is a phrase, a word without any is met nowhere; in mode
    `phrase` all of it is one phrase. A word that is said twice counts twice.
    """
    _mode(mode)
    units, limit = query_units(query), max(1, min(int(limit), 100))
    units = [tuple(t for u in units for t in u)] if mode == "phrase" else units
    df, column = _matches(index, list(dict.fromkeys(t for u in units for t in u)))
    each = Counter(units)
    tf = {u: f"_t{k}" for k, u in enumerate(each)}
    df = df.withColumns({c: F.size(_starts(u, column)) for u, c in tf.items()})
    met = df.agg(*(F.count_if(F.col(c) > 0).alias(f"_n{c}") for c in tf.values()))
    hit = [F.col(c) > 0 for c in tf.values()]
    df = df.where(reduce(Column.__or__ if mode == "any" else Column.__and__, hit)).join(F.broadcast(index.stats.join(F.broadcast(met))))
    rank = F.lit(0.0)
    for u, c in tf.items():
        rank = rank + each[u] * okapi(F.col(c), F.col("_len"), F.col(f"_n{c}"), F.col("n_docs"), F.col("avg_len"))
    return _best(index, df.select("doc_id", F.round(rank, 6).alias("rank")), F.asc("rank"), order, filters, limit)


def okapi(tf: Column, size: Column, met: Column, n: Column, average: Column) -> Column:
    """The part of a term or phrase in a rank."""
    idf = F.greatest(F.log((n - met + 0.5) / (met + 0.5)), F.lit(1e-6))
    return -idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * size / average))


def phrase_hits(index: Index, units: DataFrame) -> DataFrame:
    """(unit, doc_id, len, tf) of many phrases at once: units (unit, terms), no two with one unit.

    Only the documents of a phrase's rarest term are looked at; its other terms are joined on term and document.
    """
    terms = units.where(F.size("terms") > 0).select("unit", F.size("terms").alias("of"), F.posexplode("terms").alias("k", "term"))
    known = terms.join(index.dictionary.select("term", "document_frequency"), "term")
    lead = known.groupBy("unit").agg(F.min(F.struct("document_frequency", "k", "term")).alias("r"), F.count("*").alias("n"), F.first("of").alias("of"), F.collect_list(F.struct("k", "term")).alias("all")).where("n = of")
    # Written, so that its size is known: few terms are sent to the postings, many are joined by a shuffle.
    lead = materialise(lead.select("unit", "of", F.col("r.k").alias("k"), F.col("r.term").alias("term"), "all"), "lead")
    # a single term is met as often as it stands in a text: its places are not read
    asked = _of_many(index, lead)
    single = lead.where("of = 1").join(asked.select("term", "doc_id", "len", "tf"), "term").select("unit", "doc_id", "len", F.col("tf").cast("int").alias("tf"))
    many = lead.where("of > 1").join(asked.select("term", "doc_id", "len", "positions"), "term").select("unit", "of", "doc_id", "len", F.transform("positions", lambda x: x - F.col("k")).alias("starts"))
    many = materialise(many, "leading")
    rest = lead.where("of > 1").select("unit", F.col("k").alias("lead"), F.explode("all").alias("t")).where("t.k <> lead").select("unit", "t.k", "t.term")
    # Likewise.
    pairs = materialise(many.select("unit", "doc_id").join(rest, "unit"), "pairs")
    near = pairs.join(_of_many(index, rest).select("term", "doc_id", "positions"), ["term", "doc_id"]).select("unit", "doc_id", F.transform("positions", lambda x: x - F.col("k")).alias("places"))
    near = near.groupBy("unit", "doc_id").agg(F.collect_list("places").alias("places"))
    whole = many.join(near, ["unit", "doc_id"]).where(F.size("places") == F.col("of") - 1)
    starts = F.aggregate("places", F.col("starts"), F.array_intersect)
    whole = whole.select("unit", "doc_id", "len", F.size(starts).alias("tf")).where("tf > 0")
    return single.unionByName(whole)


def verify_index(index: DataFrame, terms: DataFrame, docs: DataFrame) -> DataFrame:
    """Findings (code, subject) where postings, dictionary and documents do not agree.

    A stored index is gone through some folders at a time, as the shuffle of all its postings takes as much room as the index.
    """
    spark = index.sparkSession
    finding = lambda df, code, subject: df.select(F.lit(code).alias("code"), F.col(subject).cast("string").alias("subject"))
    stored = "of" in index.columns and "bucket" in index.columns
    of = F.col("of") if stored else F.lit(1)
    strays = F.count_if(~F.coalesce(F.col("bucket") == bucket(F.col("term"), of), F.lit(False))) if stored else F.lit(0)
    with frugal(spark):
        own = index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"), F.min(of).alias("least"), F.max(of).alias("of"), strays.alias("strays"))
        own = materialise(own, "own")
    least, most, astray = own.agg(F.min("least"), F.max("of"), F.sum("strays")).first()
    passes = slices_of((most or 1) * PER_BUCKET)
    # Postings of a term are to be met in one pass; where some lie in a folder that is not the term's, the folders don't tell.
    place = F.xxhash64("term") if astray or least != most else F.col("bucket")
    known, parts = docs.select("doc_id").distinct().withColumn("known", F.lit(True)), []
    for k in range(passes):
        part = index.where(F.pmod(place, F.lit(passes)) == k) if passes > 1 else index
        # one shuffle by document for both: its rows are counted by term, and met with the documents that there are
        counted = part.select("doc_id", "term").repartition("doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("times"))
        bad = counted.join(known.hint("shuffle_hash"), "doc_id", "left").where("times > 1 OR known IS NULL")
        with frugal(spark):
            parts.append(materialise(bad, "faults"))
    bad = reduce(DataFrame.unionByName, parts)
    lost = bad.where("known IS NULL").select("doc_id", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
    shape = index.where((F.size("positions") != F.col("tf")) | (F.size(F.array_distinct("positions")) != F.col("tf")))
    parity = own.join(terms, "term", "full").where("NOT (df <=> document_frequency AND total <=> total_frequency)")
    return (
        finding(shape, "posting-shape", "doc_id")
        .unionByName(finding(bad.where("times > 1"), "posting-duplicate", "term"))
        .unionByName(finding(parity, "dictionary-drift", "term"))
        .unionByName(finding(lost, "posting-document-missing", "doc_id"))
    )
