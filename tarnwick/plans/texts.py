"""Queries over orders and foldings of words, planted faults of an index, contents that must not be kept, and sessions as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions import text as X
from tarnwick.operators import ranking, search, validate
from tarnwick.plans.catalogue import WORD_SQL, index_of, query
from tarnwick.session import shared_dir, table
from tarnwick.streaming import ledger as streams

_FORMS_SQL = r"f AS (SELECT form, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS form FROM documents) GROUP BY 1)"


def _forms(spark: SparkSession, d: str) -> DataFrame:
    """(form, n) of all that stands between white space in documents."""
    forms = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("form"))
    return forms.groupBy("form").agg(F.count("*").alias("n"))


@query(f"WITH {_FORMS_SQL} SELECT form, n, row_number() OVER (ORDER BY icu_sort_key(form, 'und'), form) AS place FROM f")
def locale_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every form and its place in the order of the locale."""
    return ranking.by_locale(_forms(spark, d), ["form"])


@query("SELECT doc_id, row_number() OVER (ORDER BY icu_sort_key(source, 'und'), source, icu_sort_key(lang, 'und'), lang, doc_id) AS place FROM documents")
def locale_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the order of a stored index: by source and language as readers sort them, then by number."""
    return ranking.by_locale(table(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang", "doc_id"]).select("doc_id", "place")


@query(f"WITH {_FORMS_SQL} SELECT replace(replace(lower(form), 'ß', 'ss'), 'ς', 'σ') AS folded, count(*) AS forms, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY 1")
def folded_forms(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d).groupBy(X.casefold(F.col("form")).alias("folded")).agg(F.count("*").alias("forms"), F.sum("n").alias("n"))


# An index with planted faults: counts that are off, postings twice, documents that are gone.


@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {WORD_SQL})) AS term FROM documents), p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY 1, 2),
k AS (SELECT *, tf + CASE WHEN doc_id % 97 = 5 THEN 1 ELSE 0 END AS said FROM p), c AS (SELECT * FROM k UNION ALL SELECT * FROM k WHERE doc_id % 89 = 7 AND length(term) > 8),
x AS (SELECT term, count(*) AS df, sum(said) AS total FROM c GROUP BY 1), y AS (SELECT term, count(*) AS df, sum(tf) AS total FROM p GROUP BY 1)
SELECT code, subject, count(*) AS n FROM (
SELECT 'posting-shape' AS code, CAST(doc_id AS VARCHAR) AS subject FROM c WHERE said <> tf
UNION ALL SELECT 'posting-duplicate', term FROM c GROUP BY term, doc_id HAVING count(*) > 1
UNION ALL SELECT 'dictionary-drift', term FROM x JOIN y USING (term) WHERE x.df <> y.df OR x.total <> y.total
UNION ALL SELECT 'posting-document-missing', CAST(doc_id AS VARCHAR) FROM c WHERE doc_id % 83 = 3) GROUP BY 1, 2""")
def index_faults(spark: SparkSession, d: str) -> DataFrame:
    """The stored index, spoilt, against the dictionary of all documents and those that are left."""
    docs = table(spark, d, "documents")
    kept = index_of(spark, d, "words").postings
    kept = kept.withColumn("tf", F.col("tf") + (F.col("doc_id") % 97 == 5).cast("int"))
    spoilt = kept.unionByName(kept.where("doc_id % 89 = 7 AND length(term) > 8"))
    found = search.verify_index(spoilt, search.term_dictionary(docs), docs.where("doc_id % 83 <> 3"))
    return found.groupBy("code", "subject").agg(F.count("*").alias("n"))


# Records of pages as JSON: some cut off, and all that hold a text or a local path.


@query(r"""WITH p AS (SELECT page_id, html, page_id % 13 = 4 AS cut, regexp_matches(coalesce(url, '') || ' ' || coalesce(html, ''), '(?:^|[\s"''(])(?:/home/|/Users/|/mnt/|file://|[A-Za-z]:\\)') AS local FROM pages)
SELECT 'invalid-json' AS code, CAST(page_id AS VARCHAR) AS subject FROM p WHERE cut
UNION ALL SELECT 'forbidden-key', CAST(page_id AS VARCHAR) FROM p WHERE html <> '' AND page_id % 3 = 0
UNION ALL SELECT 'forbidden-path', CAST(page_id AS VARCHAR) FROM p WHERE local""")
def content_findings(spark: SparkSession, d: str) -> DataFrame:
    """Of every page a record: a third keeps its html under a forbidden key, the others under a free one."""
    body = F.when(F.col("page_id") % 3 == 0, F.to_json(F.struct("url", F.col("html").alias("snippet")))).otherwise(F.to_json(F.struct("url", F.col("html").alias("body"))))
    text = F.when(F.col("page_id") % 13 == 4, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    return validate.forbidden_content(table(spark, d, "pages").select("page_id", text.alias("record")), "page_id", "record").select("code", "subject")


# Sessions as a stream.


@query("""WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), z AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k)
SELECT * FROM z WHERE "end" <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each user's sessions that are closed."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    s = streams.sessions(streams.stream_events(spark, f"{d}/events.parquet*"))
    s.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
