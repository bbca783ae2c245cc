"""Queries over the driver's tables, each with the SQL that gives the same rows.

A query is a thin use of an operator on whole tables; the SQL is DuckDB's.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwick.functions import fingerprint as P
from tarnwick.functions import text as X
from tarnwick.functions import web
from tarnwick.operators import canon, corpus, dossier, graph, hashtree, ledger, recall, review, rules, search, validate
from tarnwick.session import shared_dir, table, workers_see_package
from tarnwick.sources import adapters, files
from tarnwick.streaming import branches
from tarnwick.streaming import ledger as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers_see_package(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return keep


_INDEXES: dict[tuple, search.Index] = {}


def index_of(spark: SparkSession, d: str, kind: str) -> search.Index:
    """The index of documents, built once for each session and state of the table's files in the shared folder; `build_index` is the query that times it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in sorted(table(spark, d, "documents").inputFiles())]
    states = (p.getFileSystem(conf).getFileStatus(p) for p in paths)
    key = (spark.sparkContext.applicationId, kind, *((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in states))
    if key not in _INDEXES:
        _INDEXES[key] = search.build_index(table(spark, d, "documents"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", kind)
    return _INDEXES[key]


WORD_SQL = r"'[\p{L}\p{N}]+(?:[''’.-][\p{L}\p{N}]+)*'"
FOLDED_SQL = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}\p{Co}]+')"
TOKEN_SQL = r"'[\p{L}\p{N}\p{Co}]+'"

# Scans, projections and filters.


@query("""SELECT doc_id, lang, source, n_chars, CASE WHEN n_chars >= 850 THEN 'high' WHEN n_chars >= 600 THEN 'medium' ELSE 'low' END AS band,
       round(n_chars / 7.0, 8) AS ratio
FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src3')""")
def scan_filter_project(spark, d):
    n = F.col("n_chars")
    band = F.when(n >= 850, "high").when(n >= 600, "medium").otherwise("low")
    rows = table(spark, d, "documents").where(F.col("lang").isin("en", "fr") & F.col("source").isin("src1", "src2", "src3"))
    return rows.select("doc_id", "lang", "source", "n_chars", band.alias("band"), F.round(n / 7.0, 8).alias("ratio"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """documents as candidates: source is the domain, lang the kind and the tag, size the confidence, the whole text the summary."""
    docs = table(spark, d, "documents")
    return docs.select(
        F.format_string("doc-%06d", "doc_id").alias("id"),
        F.col("source").alias("domain"),
        F.col("lang").alias("kind"),
        F.substring("text", 1, 40).alias("label"),
        F.col("text").alias("summary"),
        F.least("n_chars", F.lit(1000)).cast("int").alias("confidence_permille"),
        F.array("source").alias("source_hints"),
        F.array(F.concat("source", F.lit("-"), "lang")).alias("reconciliation_keys"),
        F.array("lang").alias("tags"),
    )


@query("""SELECT id, domain, kind, confidence_permille FROM (
  SELECT printf('doc-%06d', doc_id) AS id, source AS domain, lang AS kind, CAST(least(n_chars, 1000) AS INT) AS confidence_permille,
         lower(concat_ws(chr(10), printf('doc-%06d', doc_id), substr(text, 1, 40), text, source || '-' || lang, lang)) AS hay FROM documents)
WHERE domain IN ('src0', 'src1', 'src5') AND kind IN ('en', 'de') AND confidence_permille >= 300 AND contains(hay, 'the')""")
def recall_query(spark, d):
    out = recall.query(candidates(spark, d), domains=["src0", "src1", "src5"], kinds=["en", "de"], least=300, text=" The ")
    return out.select("id", "domain", "kind", "confidence_permille")


@query("""SELECT count(DISTINCT source) AS packets, count(*) AS candidates, count(*) FILTER (c >= 850) AS high,
  count(*) FILTER (c >= 600 AND c < 850) AS medium, count(*) FILTER (c < 600) AS low FROM (SELECT source, least(n_chars, 1000) AS c FROM documents)""")
def recall_manifest(spark, d):
    return recall.manifest(candidates(spark, d).withColumn("packet_id", F.col("domain")))


# Tokens, dictionaries, postings.


@query(f"""SELECT doc_id, CAST(len(regexp_extract_all(lower(text), {WORD_SQL})) AS BIGINT) AS n_words,
  CAST(len(list_distinct(regexp_extract_all(lower(text), {WORD_SQL}))) AS BIGINT) AS n_terms FROM documents""")
def token_stats(spark, d):
    t = search.tokenised(table(spark, d, "documents"))
    return t.select("doc_id", F.size("tokens").cast("long").alias("n_words"), F.size(F.array_distinct("tokens")).cast("long").alias("n_terms"))


@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {WORD_SQL})) AS term FROM documents),
p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY 1, 2)
SELECT term, count(*) AS document_frequency, CAST(sum(tf) AS BIGINT) AS total_frequency FROM p GROUP BY 1""")
def term_dictionary(spark, d):
    return search.term_dictionary(table(spark, d, "documents"))


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), {WORD_SQL}) AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM t)
SELECT term, doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM u GROUP BY 1, 2""")
def postings_positions(spark, d):
    p = search.postings(table(spark, d, "documents"))
    return p.select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("SELECT '' AS code, '' AS subject WHERE false")
def index_verify(spark, d):
    docs = table(spark, d, "documents")
    index = index_of(spark, d, "words")
    return search.verify_index(index.postings, search.term_dictionary(docs), docs)


@query(f"""WITH t AS (SELECT doc_id, {FOLDED_SQL} AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS term FROM t), p AS (SELECT term, doc_id, count(*) AS tf FROM u GROUP BY 1, 2)
SELECT (SELECT count(*) FROM p) AS postings, (SELECT CAST(sum(tf) AS BIGINT) FROM p) AS tokens, (SELECT count(DISTINCT term) FROM p) AS terms, (SELECT count(*) FROM t) AS n_docs, (SELECT round(avg(len(w)), 6) FROM t) AS avg_len""")
def build_index(spark, d):
    """A whole index, written anew, and its sizes."""
    index = search.build_index(table(spark, d, "documents"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", "folded")
    sizes = index.dictionary.agg(F.sum("document_frequency").alias("postings"), F.sum("total_frequency").alias("tokens"), F.count("*").alias("terms"))
    return sizes.join(F.broadcast(index.stats)).withColumn("avg_len", F.round("avg_len", 6))  # both are one row


@query(rf"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^\p{{L}}\p{{N}}]*([\p{{L}}\p{{N}}]+(?:[''’.-][\p{{L}}\p{{N}}]+)*)') AS g, regexp_extract_all(text, {WORD_SQL}) AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS term, unnest(list_transform(g, lambda x: length(x))) AS size, unnest(range(len(w))) AS pos FROM t),
e AS (SELECT doc_id, lower(term) AS term, length(term) AS n, sum(size) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM u)
SELECT term, doc_id, CAST(sum(upto - n) AS BIGINT) AS starts, CAST(sum(upto) AS BIGINT) AS ends, CAST(min(upto - n) AS INT) AS first FROM e GROUP BY 1, 2""")
def postings_offsets(spark, d):
    """Where each term starts and ends in each text, in code points."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return search.postings(table(spark, d, "documents")).select("term", "doc_id", total(F.col("starts")).alias("starts"), total(F.col("ends")).alias("ends"), F.array_min("starts").alias("first"))


def _tfidf_sql(terms: list[str], having: str, limit: int) -> str:
    listed = ", ".join(f"'{t}'" for t in dict.fromkeys(terms))
    unique = len(dict.fromkeys(terms))
    steps = " AND ".join(f"list_contains(w, '{t}')" for t in terms)
    phrase = " AND ".join(f"w[i + {k}] = '{t}'" for k, t in enumerate(terms))
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), {WORD_SQL}) AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS term FROM t), tf AS (SELECT doc_id, term, count(*) AS tf FROM u WHERE term IN ({listed}) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT doc_id, sum((ln((n + 1) / (df + 1)) + 1) * (1 + ln(tf))) AS s, count(*) AS present FROM tf JOIN df USING (term), n GROUP BY 1),
ph AS (SELECT doc_id, count(*) AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t WHERE {steps}) WHERE {phrase} GROUP BY 1)
SELECT doc_id, round(s + CASE WHEN p > 0 THEN 4 + ln(p + 1) ELSE 0 END + present / {unique}, 8) AS score
FROM s LEFT JOIN ph USING (doc_id) WHERE {having} ORDER BY score DESC, doc_id LIMIT {limit}"""


@query(_tfidf_sql(["the", "and"], "true", 50))
def search_any(spark, d):
    return search.tfidf(index_of(spark, d, "words"), "The and", "any", 50).select("doc_id", "score")


@query(_tfidf_sql(["the", "and"], "present = 2", 50))
def search_all(spark, d):
    return search.tfidf(index_of(spark, d, "words"), "the AND", "all", 50).select("doc_id", "score")


@query(_tfidf_sql(["of", "the"], "p > 0", 50))
def search_phrase(spark, d):
    return search.tfidf(index_of(spark, d, "words"), "of the", "phrase", 50).select("doc_id", "score")


def _bm25_sql(terms: list[str], limit: int, need: int) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""WITH t AS (SELECT doc_id, {FOLDED_SQL} AS w FROM documents),
l AS (SELECT doc_id, len(w) AS len FROM t), a AS (SELECT count(*) AS n, avg(len) AS avg FROM l),
u AS (SELECT doc_id, unnest(w) AS term FROM t), tf AS (SELECT doc_id, term, count(*) AS tf FROM u WHERE term IN ({listed}) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT doc_id, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / avg))) AS r, count(*) AS present
  FROM tf JOIN df USING (term) JOIN l USING (doc_id), a GROUP BY 1)
SELECT doc_id, round(r, 6) AS rank FROM s WHERE present >= {need} ORDER BY round(r, 6), doc_id LIMIT {limit}"""


@query(_bm25_sql(["whether", "stupid", "loser"], 100, 1))
def search_bm25_any(spark, d):
    return search.bm25(index_of(spark, d, "folded"), "whether stupid loser", "any", 100).select("doc_id", "rank")


@query(_bm25_sql(["ere", "ecole"], 50, 1))
def search_bm25_accents(spark, d):
    """Words asked with diacritics; texts are met with and without."""
    return search.bm25(index_of(spark, d, "folded"), "Ère École", "any", 50).select("doc_id", "rank")


@query(f"""WITH t AS (SELECT doc_id, {FOLDED_SQL} AS w FROM documents), p AS (SELECT doc_id, len(w) AS len, len(list_filter(range(1, len(w)), lambda i: w[i] = 'le' AND w[i + 1] = 'eau')) AS tf, len(list_filter(w, lambda x: x = 'que')) AS tg FROM t),
a AS (SELECT count(*) AS n, avg(len) AS avg, count(*) FILTER (tf > 0) AS df, count(*) FILTER (tg > 0) AS dg FROM p)
SELECT doc_id, round(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / avg)) - greatest(ln((n - dg + 0.5) / (dg + 0.5)), 1e-6) * (tg * 2.2) / (tg + 1.2 * (0.25 + 0.75 * len / avg)), 6) AS rank
FROM p, a WHERE tf > 0 OR tg > 0 ORDER BY rank, doc_id LIMIT 60""")
def search_bm25_apostrophe(spark, d):
    """A word with an apostrophe falls into two terms, which are a phrase."""
    return search.bm25(index_of(spark, d, "folded"), "le’eau que", "any", 60).select("doc_id", "rank")


@query(_bm25_sql(["ou", "re"], 20, 2))
def search_bm25(spark, d):
    return search.bm25(index_of(spark, d, "folded"), "ou re", "all", 20).select("doc_id", "rank")


@query(f"""WITH t AS (SELECT doc_id, {FOLDED_SQL} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS len, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS tf FROM t),
a AS (SELECT count(*) AS n, avg(len) AS avg, count(*) FILTER (tf > 0) AS df FROM p)
SELECT doc_id, round(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / avg)), 6) AS rank
FROM p, a WHERE tf > 0 ORDER BY rank, doc_id LIMIT 100""")
def search_bm25_phrase(spark, d):
    return search.bm25(index_of(spark, d, "folded"), "of the", "phrase", 100).select("doc_id", "rank")


@query("""WITH h AS (SELECT doc_id, text, instr(lower(text), 'and') AS a, instr(lower(text), 'the') AS b FROM documents),
c AS (SELECT *, least(CASE WHEN a = 0 THEN NULL ELSE a END, CASE WHEN b = 0 THEN NULL ELSE b END) - 1 AS pos FROM h WHERE a > 0 OR b > 0),
e AS (SELECT *, greatest(0, pos - 90) AS s, least(length(text), pos + 93) AS t FROM c),
n AS (SELECT doc_id, CASE WHEN s > 0 THEN '…' ELSE '' END || trim(substr(text, CAST(s + 1 AS INT), CAST(t - s AS INT))) || CASE WHEN t < length(text) THEN '…' ELSE '' END AS snippet FROM e)
SELECT doc_id, snippet, 'sha256:' || sha256(snippet) AS snippet_digest FROM n""")
def search_snippet(spark, d):
    docs = table(spark, d, "documents").where(F.lower("text").contains("and") | F.lower("text").contains("the"))
    s = docs.select("doc_id", X.snippet(F.col("text"), ["and", "the"], 90).alias("snippet"))
    return s.withColumn("snippet_digest", P.digest(F.col("snippet")))


@query("""SELECT p.probe, count(*) FILTER (contains(lower(text), p.probe)) AS n FROM documents,
 (SELECT unnest(['the', 'und', 'les', 'que']) AS probe) p GROUP BY 1""")
def witness_counts(spark, d):
    probes = ["the", "und", "les", "que"]
    n = table(spark, d, "documents").agg(*(F.count_if(F.lower("text").contains(p)).alias(p) for p in probes))
    return n.select(F.explode(F.array(*(F.struct(F.lit(p).alias("probe"), F.col(p).alias("n")) for p in probes))).alias("x")).select("x.*")


# Segments.


@query(r"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
u AS (SELECT doc_id, unnest(p) AS part, unnest(range(len(p))) AS i, unnest(list_transform(range(len(p)), lambda k: CAST(coalesce(list_sum(list_transform(p[1:k], lambda x: length(x) + 1)), 0) AS INT))) AS pos FROM p),
k AS (SELECT *, trim(part, E' \t\n\x0b\f\r') AS segment FROM u WHERE regexp_matches(part, '\S'))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS paragraph_index, CAST(pos + length(part) - length(ltrim(part, E' \t\n\x0b\f\r')) AS INT) AS start_char,
 CAST(pos + length(part) - length(ltrim(part, E' \t\n\x0b\f\r')) + length(segment) AS INT) AS end_char, segment, 'sha256:' || sha256(segment) AS text_digest FROM k""")
def paragraph_segments(spark, d):
    return corpus.segments(table(spark, d, "documents"), "\n")


@query("SELECT '' AS code, '' AS severity, '' AS subject, '' AS detail WHERE false")
def segment_digest_check(spark, d):
    """Every segment is the text at its place: no finding."""
    docs = table(spark, d, "documents")
    s = corpus.segments(docs, "\n").join(docs.select("doc_id", "text"), "doc_id")
    again = P.digest(F.substring("text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")))
    return rules.finding(s.where(again != F.col("text_digest")), "segment-digest", "error", F.col("doc_id"), F.col("paragraph_index").cast("string"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(regexp_replace(regexp_replace(text, '[\t ]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[^\n ]+')) AS BIGINT) AS n FROM documents""")
def normalised_words(spark, d):
    t = X.normalize_text(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all(t, F.lit(r"[^\n ]+"), F.lit(0))).cast("long").alias("n"))


# Pages.


@query(r"""SELECT page_id, regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1) AS lang,
 CAST(len(regexp_extract_all(html, '(?i)<a\s')) AS BIGINT) AS links, regexp_matches(html, '(?i)<script') AS has_script FROM pages""")
def page_lang(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select(
        "page_id", F.coalesce(X.html_lang(h), F.lit("")).alias("lang"), F.regexp_count(h, F.lit(r"(?i)<a\s")).cast("long").alias("links"), h.rlike("(?i)<script").alias("has_script")
    )


_ENTITY_SQL = "replace(replace(replace(replace(replace(replace({}, '&apos;', ''''), '&gt;', '>'), '&lt;', '<'), '&nbsp;', ' '), '&quot;', '\"'), '&amp;', '&')"


@query(rf"""WITH t AS (SELECT page_id, regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1) AS t FROM pages)
SELECT page_id, trim(regexp_replace({_ENTITY_SQL.format("regexp_replace(t, '<[^>]+>', ' ', 'g')")}, '[\t ]+', ' ', 'g')) AS title FROM t""")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_title(F.col("html")).alias("title"))


@query(rf"""WITH a AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g') AS h FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(?:p|div|section|article|li|blockquote|h[1-6]|tr)>', chr(10) || chr(10), 'g') AS h FROM b),
e AS (SELECT page_id, {_ENTITY_SQL.format("regexp_replace(h, '<[^>]+>', ' ', 'g')")} AS h FROM c)
SELECT page_id, trim(regexp_replace(h, '[\s\x{{A0}}]+', ' ', 'g')) AS body FROM e""")
def html_strip(spark, d):
    body = X.normalize_text(X.strip_markup(F.col("html")))
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(body, r"[\s\x{A0}]+", " ")).alias("body"))


# Routing, concordance, lanes.


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in X.ROUTE_STOP) + "]"
SOURCES = tuple(f"src{k}" for k in range(20))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """benchmark as candidates: by turns rules and events with the long words of the text as keys, and questions, asked as phrases."""
    n, low = F.col("item_id"), F.lower("text")
    keys = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9]{8,}"), F.lit(0)))
    kind = F.element_at(F.array(*map(F.lit, ("rule", "event", "question"))), (n % 3 + 1).cast("int"))
    some, none = F.array(*map(F.lit, SOURCES[: len(SOURCES) // 2])), F.array().cast("array<string>")
    sources = F.when(n % 7 == 0, none).when(n % 2 == 0, some).otherwise(F.array(*map(F.lit, SOURCES)))
    rows = table(spark, d, "benchmark").select(n.alias("candidate_id"), kind.alias("kind"), F.col("text").alias("label"), keys.alias("keys"), sources.alias("sources"))
    return rows.select("candidate_id", "sources", corpus.route_units(F.col("kind"), F.col("label"), F.col("keys")).alias("units"), corpus.fallback_units(F.col("label"), F.col("keys")).alias("fallback"))


def _route_words(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(replace({c}, '-', ' ')), '[a-z0-9]+(?:[''’][a-z0-9]+)?'), lambda t: length(t) > 1 AND NOT list_contains({_STOP_SQL}, t))"


_ROUTES_SQL = rf"""WITH b AS (SELECT item_id AS candidate_id, {_route_words("text")} AS t, list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9]{{8,}}'), lambda k: k), lambda k: true) AS k0 FROM benchmark),
k1 AS (SELECT candidate_id, unnest(k0) AS k, unnest(range(len(k0))) AS i FROM b), k2 AS (SELECT candidate_id, k, min(i) AS i FROM k1 GROUP BY 1, 2),
k3 AS (SELECT candidate_id, list(k ORDER BY i) AS keys FROM k2 GROUP BY 1),
c AS (SELECT b.candidate_id, regexp_extract_all(array_to_string(t, ' '), '[a-z0-9]+') AS said, t, list_filter(coalesce(keys, []), lambda k: NOT list_contains({_STOP_SQL}, k)) AS good, coalesce(keys, []) AS keys FROM b LEFT JOIN k3 USING (candidate_id)),
u AS (SELECT candidate_id, CASE WHEN candidate_id % 3 = 0 AND len(keys) > 0 THEN list_transform(list_filter(keys[1:2], lambda k: NOT list_contains({_STOP_SQL}, k)), lambda k: [k])
  WHEN candidate_id % 3 = 1 AND len(good[1:3]) >= 2 THEN list_transform(good[1:3], lambda k: [k]) ELSE [said] END AS units, t, keys, good FROM c),
f1 AS (SELECT candidate_id, unnest(list_concat(t, good)) AS term, unnest(range(len(t) + len(good))) AS i FROM u), f2 AS (SELECT candidate_id, term, min(i) AS i FROM f1 WHERE length(term) >= 3 GROUP BY 1, 2),
asked AS (SELECT candidate_id, 0 AS tier, unit, len(units) AS need FROM (SELECT candidate_id, units, unnest(units) AS unit FROM u)
 UNION ALL SELECT candidate_id, 1, regexp_extract_all(term, '[a-z0-9]+'), 1 FROM f2 QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY i) <= 6),
d AS (SELECT doc_id, source, {FOLDED_SQL} AS w FROM documents), a AS (SELECT count(*) AS n, avg(len(w)) AS avg FROM d),
q AS (SELECT DISTINCT unit FROM asked), tf AS (SELECT doc_id, source, len(w) AS len, unit, len(list_filter(list_positions_of, lambda i: w[i : i + len(unit) - 1] = unit)) AS tf
  FROM (SELECT doc_id, source, w, unit, list_filter(range(1, len(w) + 1), lambda i: w[i] = unit[1]) AS list_positions_of FROM d JOIN q ON list_contains(w, unit[1])) WHERE len(list_positions_of) > 0),
h AS (SELECT * FROM tf WHERE tf > 0), df AS (SELECT unit, count(*) AS df FROM h GROUP BY 1),
s AS (SELECT unit, doc_id, source, -greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / avg)) AS part FROM h JOIN df USING (unit), a),
f AS (SELECT candidate_id, tier, doc_id, round(sum(part), 6) AS rank FROM asked JOIN s USING (unit) WHERE candidate_id % 7 <> 0 AND (candidate_id % 2 = 1 OR CAST(substr(source, 4) AS INT) < 10) GROUP BY candidate_id, tier, need, doc_id HAVING count(*) >= need),
r AS (SELECT candidate_id, tier, doc_id, rank, row_number() OVER (PARTITION BY candidate_id ORDER BY rank, doc_id) AS place FROM (SELECT *, min(tier) OVER (PARTITION BY candidate_id) AS best FROM f) WHERE tier = best)
SELECT * FROM r WHERE place <= 5"""


@query(_ROUTES_SQL)
def evidence_routes_top5(spark, d):
    return corpus.evidence_routes(_claims(spark, d), index_of(spark, d, "folded"))


@query(f"""WITH x AS ({_ROUTES_SQL}), n AS (SELECT candidate_id, count(*) AS leads FROM x GROUP BY 1)
SELECT item_id AS candidate_id, coalesce(leads, 0) AS leads, CASE WHEN item_id % 7 = 0 THEN 'awaiting-uningested-source' WHEN leads > 0 THEN 'evidence-leads-found' ELSE 'no-lead-found' END AS status
FROM benchmark LEFT JOIN n ON item_id = candidate_id""")
def evidence_status(spark, d):
    c = _claims(spark, d)
    return corpus.evidence_status(c, corpus.evidence_routes(c, index_of(spark, d, "folded")), F.size("sources") > 0)


@query(rf"""WITH b AS (SELECT item_id, text, list_filter(string_split(text, '.'), lambda s: true) AS s FROM benchmark),
e AS (SELECT item_id AS entity_id, 0 AS alias_order, text FROM b UNION ALL SELECT item_id, unnest(range(len(s))) + 1, unnest(s) FROM b),
g AS (SELECT entity_id, CAST(alias_order AS INT) AS alias_order, {FOLDED_SQL} AS p FROM e), h AS (SELECT *, ' ' || array_to_string(p, ' ') || ' ' AS run FROM g WHERE len(p) > 0),
d AS (SELECT doc_id, source, ' ' || array_to_string({FOLDED_SQL}, ' ') || ' ' AS run FROM documents),
o AS (SELECT entity_id, source, alias_order, count(*) AS occurrences, min(doc_id) AS first_doc_id FROM h JOIN d ON contains(d.run, h.run) GROUP BY 1, 2, 3)
SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY entity_id, source ORDER BY alias_order) = 1""")
def concordance_first_hit(spark, d):
    """Entities whose aliases are a text as a whole and then each of its sentences."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("entity_id"), F.posexplode(F.concat(F.array("text"), F.split("text", "[.]"))).alias("alias_order", "alias"))
    return corpus.concordance(b, index_of(spark, d, "folded"))


LANES = (("court", ("the and", "of the")), ("north", ("that", "with the")), ("sea", ("und die", "der")), ("east", ("les des", "que")))


def _lane_sql() -> str:
    cases = []
    for lane, phrases in LANES:
        words = sorted({w for p in phrases for w in p.split()})
        score = " + ".join([f"CASE WHEN contains(t, '{p}') THEN {20 + len(p.split())} ELSE 0 END" for p in phrases] + [f"CAST(list_contains(w, '{x}') AS INT)" for x in words])
        cases.append(f"SELECT q, '{lane}' AS lane, {score} AS score FROM b")
    return f"""WITH b AS (SELECT conv_id * 1000 + turn AS q, lower(text) AS t, regexp_extract_all(lower(text), {WORD_SQL}) AS w FROM conversations),
s AS ({" UNION ALL ".join(cases)}), m AS (SELECT *, max(score) OVER (PARTITION BY q) AS best FROM s)
SELECT q AS question_id, lane, score FROM m WHERE score >= greatest(2, floor(best * 0.35)) QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, lane) <= 6"""


@query(_lane_sql())
def lane_scores(spark, d):
    q = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "text")
    return corpus.lane_scores(q, LANES)


# Census and order.


@query("""SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)""")
def census_rollup(spark, d):
    return corpus.census(table(spark, d, "documents"), ["lang", "source"], {"chars": F.col("n_chars")})


@query("""SELECT l_shipmode_, l_returnflag, count(*) AS n FROM (SELECT l_linestatus AS l_shipmode_, l_returnflag FROM lineitem) GROUP BY GROUPING SETS ((l_shipmode_, l_returnflag), (l_returnflag))""")
def pov_census(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("l_shipmode_"), "l_returnflag")
    return corpus.heading_census(rows, "l_shipmode_", "l_returnflag")


@query("""SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS heading_occurrence, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS chapter_order FROM documents""")
def heading_occurrence(spark, d):
    rows = corpus.narrative_order(table(spark, d, "documents").select("doc_id", "source", "lang"), "source", "lang", ["doc_id"])
    return rows.withColumns({c: F.col(c).cast("long") for c in ("heading_occurrence", "chapter_order")})


@query("""SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) AS global_order FROM documents""")
def narrative_order(spark, d):
    return corpus.global_order(table(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"]).withColumn("global_order", F.col("global_order").cast("long")).select("doc_id", "source", "global_order")


@query("""SELECT p_brand AS heading, CASE WHEN upper(trim(p_type)) = p_type THEN p_type ELSE trim(p_type) END AS label, count(*) AS n FROM part GROUP BY 1, 2""")
def heading_labels(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("heading"), F.when(F.upper(F.trim("p_type")) == F.col("p_type"), F.col("p_type")).otherwise(F.trim("p_type")).alias("label")).agg(F.count("*").alias("n"))


@query("""SELECT source, publisher, CASE WHEN source = 'src1' AND contains(lower(publisher), 'epub bud') THEN 'holder-supplied-converted-edition' WHEN source = 'src2' AND publisher = '' THEN 'holder-supplied-collection-weak-bibliographic-metadata' WHEN publisher <> '' THEN 'holder-supplied-publisher-identified-edition' ELSE 'holder-supplied-edition' END AS class, count(*) AS n
FROM (SELECT source, CASE WHEN doc_id % 3 = 0 THEN 'Press ' || lang WHEN doc_id % 3 = 1 THEN 'Epub Bud' ELSE '' END AS publisher FROM documents) GROUP BY ALL""")
def provenance(spark, d):
    rows = table(spark, d, "documents").select("source", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Press "), "lang")).when(F.col("doc_id") % 3 == 1, "Epub Bud").otherwise("").alias("publisher"))
    return rows.withColumn("class", corpus.provenance_class(F.col("source"), F.col("publisher"), ["src1"], ["src2"])).groupBy("source", "publisher", "class").agg(F.count("*").alias("n"))


@query("""SELECT v AS value, (SELECT count(*) FROM events WHERE event_type = v) AS n FROM (SELECT unnest(['click', 'view', 'purchase', 'refund', 'login']) AS v)""")
def zero_filled_histogram(spark, d):
    return ledger.histogram(table(spark, d, "events"), "event_type", ["click", "view", "purchase", "refund", "login"])


@query("""SELECT n_name, n_regionkey, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON n_nationkey = c_nationkey""")
def zero_filled_dimension(spark, d):
    n = recall.zero_filled(table(spark, d, "customer").where("c_acctbal > 9000"), "c_nationkey", table(spark, d, "nation"), "n_nationkey")
    return table(spark, d, "nation").join(n, "n_nationkey").select("n_name", "n_regionkey", "n")


@query("""SELECT source, count(*) FILTER (n_chars >= 850) AS high, count(*) FILTER (n_chars >= 600 AND n_chars < 850) AS medium, count(*) FILTER (n_chars < 600) AS low FROM documents GROUP BY 1""")
def confidence_bands(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(*recall.bands(F.col("n_chars")))


@query("""SELECT quality, count(*) AS n, sum(toxic) AS hit, CAST(CASE WHEN count(*) = 0 THEN 1000 ELSE floor(sum(toxic) * 1000 / count(*)) END AS BIGINT) AS permille FROM labels GROUP BY 1""")
def ratio_permille(spark, d):
    g = table(spark, d, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.sum("toxic").alias("hit"))
    return g.withColumn("permille", P.ratio_permille(F.col("hit"), F.col("n")))


# Findings: references, duplicates, ranges, drift, parity.


@query("""SELECT 'missing-reference' AS code, 'error' AS severity, CAST(o_orderkey AS VARCHAR) AS subject, CAST(o_custkey AS VARCHAR) AS detail
FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def fk_missing(spark, d):
    known = table(spark, d, "customer").where("c_acctbal > 0")
    return rules.missing_reference(table(spark, d, "orders"), "o_orderkey", "o_custkey", known, "c_custkey")


@query("""SELECT 'unlabelled' AS code, 'error' AS severity, CAST(doc_id AS VARCHAR) AS subject, '' AS detail FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def orphan_rows(spark, d):
    return rules.orphans(table(spark, d, "documents"), "doc_id", table(spark, d, "labels"), "unlabelled")


@query("""SELECT 'duplicate-id' AS code, 'error' AS severity, sha256(text) AS subject, CAST(count(*) AS VARCHAR) || ' rows' AS detail FROM documents GROUP BY text HAVING count(*) > 1""")
def duplicate_ids(spark, d):
    return rules.duplicates(table(spark, d, "documents").select(F.sha2("text", 256).alias("digest")), "digest")


@query("""WITH r AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 5 GROUP BY 1)
SELECT 'count-drift' AS code, 'error' AS severity, CAST(o_orderkey AS VARCHAR) AS subject, CAST(4 AS VARCHAR) || '/' || CAST(coalesce(n, 0) AS VARCHAR) AS detail
FROM orders LEFT JOIN r ON k = o_orderkey WHERE coalesce(n, 0) <> 4
UNION ALL SELECT 'count-drift', 'error', CAST(k AS VARCHAR), '0/' || CAST(n AS VARCHAR) FROM r WHERE k NOT IN (SELECT o_orderkey FROM orders)""")
def count_drift(spark, d):
    said = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(4).cast("long").alias("lines"))
    rows = table(spark, d, "lineitem").where("l_quantity > 5").select(F.col("l_orderkey").alias("k"))
    return rules.count_drift(said, rows, "k", "lines")


@query("""SELECT 'out-of-range' AS code, 'error' AS severity, CAST(doc_id AS VARCHAR) AS subject, CAST(n_chars AS VARCHAR) AS detail FROM documents WHERE n_chars < 100 OR n_chars > 10000""")
def range_checks(spark, d):
    return rules.out_of_range(table(spark, d, "documents"), "doc_id", "n_chars", F.lit(100), F.lit(10000))


@query("""SELECT 'order-gap' AS code, 'error' AS severity, CAST(l_orderkey AS VARCHAR) AS subject, '' AS detail FROM (SELECT l_orderkey, l_linenumber - 1 AS o FROM lineitem WHERE l_discount < 0.09)
GROUP BY l_orderkey HAVING min(o) <> 0 OR max(o) <> count(*) - 1 OR count(DISTINCT o) <> count(*)""")
def contiguity_gaps(spark, d):
    rows = table(spark, d, "lineitem").where("l_discount < 0.09").select("l_orderkey", (F.col("l_linenumber") - 1).alias("o"))
    return rules.not_contiguous(rows, "l_orderkey", "o")


@query("""SELECT 'attempts' AS code, 'error' AS severity, CAST(o_orderkey AS VARCHAR) AS subject, CAST(coalesce(n, 0) AS VARCHAR) AS detail FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(n, 0) <> 1""")
def exactly_one_attempt(spark, d):
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return rules.exactly_one(table(spark, d, "orders"), lines, "o_orderkey", "attempts")


@query("""WITH a AS (SELECT c_custkey AS k, c_nationkey AS nation, c_acctbal > 0 AS good FROM customer), b AS (SELECT s_suppkey AS k, s_nationkey AS nation, s_acctbal > 0 AS good FROM supplier)
SELECT 'parity-nation' AS code, 'error' AS severity, CAST(k AS VARCHAR) AS subject, 'nation' AS detail FROM a JOIN b USING (k) WHERE a.nation IS DISTINCT FROM b.nation
UNION ALL SELECT 'parity-good', 'error', CAST(k AS VARCHAR), 'good' FROM a JOIN b USING (k) WHERE a.good IS DISTINCT FROM b.good""")
def custody_parity(spark, d):
    side = lambda t, p: table(spark, d, t).select(F.col(f"{p}_{'cust' if p == 'c' else 'supp'}key").alias("k"), F.col(f"{p}_nationkey").alias("nation"), (F.col(f"{p}_acctbal") > 0).alias("good"))
    return rules.parity(side("customer", "c"), side("supplier", "s"), "k", ["nation", "good"])


@query("""SELECT 'exclusive-conflict' AS code, 'error' AS severity, CAST(user_id AS VARCHAR) AS subject, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS detail FROM events
GROUP BY user_id HAVING count(DISTINCT event_type) > 1""")
def exclusive_group_conflict(spark, d):
    return rules.exclusive_groups(table(spark, d, "events"), "user_id", "event_type")


@query("""SELECT count(*) FILTER (s = 'error') AS errors, count(*) FILTER (s = 'warning') AS warnings, count(*) FILTER (s = 'error') = 0 AS passed
FROM (SELECT CASE WHEN n_chars < 100 THEN 'error' ELSE 'warning' END AS s FROM documents WHERE n_chars < 100 OR n_chars > 10000)""")
def findings_receipt(spark, d):
    docs = table(spark, d, "documents")
    low = rules.finding(docs.where("n_chars < 100"), "short", "error", F.col("doc_id"))
    return rules.passed(rules.union([low, rules.finding(docs.where("n_chars > 10000"), "long", "warning", F.col("doc_id"))]))


@query("""SELECT severity, code, count(*) AS n FROM (SELECT CASE WHEN n_chars < 100 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN n_chars < 100 THEN 'short' ELSE 'long' END AS code
FROM documents WHERE n_chars < 100 OR n_chars > 10000) GROUP BY 1, 2""")
def findings_by_source(spark, d):
    docs = table(spark, d, "documents")
    low = rules.finding(docs.where("n_chars < 100"), "short", "error", F.col("doc_id"))
    all_of = rules.union([low, rules.finding(docs.where("n_chars > 10000"), "long", "warning", F.col("doc_id"))])
    return rules.by_severity(all_of).groupBy("severity", "code").agg(F.count("*").alias("n"))


# Ledgers over events.


@query("""SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_snapshot(spark, d):
    return ledger.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query("""SELECT user_id, arg_min(ts, event_id) AS first_seen, arg_max(ts, event_id) AS last_seen, count(*) AS n FROM events GROUP BY 1""")
def first_last_seen(spark, d):
    return ledger.first_last_seen(table(spark, d, "events"), "user_id", "ts", ["event_id"])


@query("""WITH w AS (SELECT user_id, ts, event_id, event_type, value > 50 AS high, lag(event_type) OVER w AS pt, lag(value > 50) OVER w AS ph, row_number() OVER w AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS j
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, i > 1 AND (event_type IS DISTINCT FROM pt OR high IS DISTINCT FROM ph) AS drift FROM w WHERE j = 1""")
def route_drift(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", (F.col("value") > 50).alias("high"))
    return ledger.last_drift(e, "user_id", ["ts", "event_id"], ["event_type", "high"])


@query("""WITH w AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, user_id, event_type FROM w WHERE p IS NOT NULL AND p <> event_type""")
def disposition_changes(spark, d):
    out = ledger.drift(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type"])
    return out.where(F.size("changed") > 0).select("event_id", "user_id", "event_type")


@query("""SELECT event_id, user_id FROM events r WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM events s WHERE s.user_id = r.user_id AND s.event_type = 'purchase' AND s.ts <= r.ts)""")
def replay_origin_exists(spark, d):
    e = table(spark, d, "events")
    return ledger.replay_origins(e.where("event_type = 'click'"), e.where("event_type = 'purchase'").select("user_id", "ts"), ["user_id"], "ts").select("event_id", "user_id")


@query("""SELECT r.event_id, max(s.ts) AS prior_ts FROM events r LEFT JOIN events s ON s.user_id = r.user_id AND s.event_type = 'purchase' AND s.ts <= r.ts WHERE r.event_type = 'click' GROUP BY 1""")
def asof_prior_success(spark, d):
    e = table(spark, d, "events")
    return ledger.prior(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'"), ["user_id"], "ts", "prior_ts").select("event_id", "prior_ts")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate + INTERVAL 10 DAY""")
def temporal_order_violations(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.where(F.col("l_shipdate") < F.expr("o_orderdate + INTERVAL 10 DAY")).select("l_orderkey", "l_linenumber")


@query("""WITH w AS (SELECT o_orderkey, min(l_shipdate) AS a, max(l_shipdate) AS b, min(o_orderdate) AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT CASE WHEN b < o OR a > o + INTERVAL 90 DAY THEN 'endpoint-window' WHEN a < o OR b > o + INTERVAL 90 DAY THEN 'endpoint-window-ambiguous' ELSE 'inside' END AS code, count(*) AS n FROM w GROUP BY 1""")
def interval_overlap(spark, d):
    # summed per order before the join: one row a key on either side
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    w = lines.join(table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("o")), F.col("l_orderkey") == F.col("o_orderkey"))
    end = F.expr("o + INTERVAL 90 DAY")
    code = F.when((F.col("b") < F.col("o")) | (F.col("a") > end), "endpoint-window").when((F.col("a") < F.col("o")) | (F.col("b") > end), "endpoint-window-ambiguous").otherwise("inside")
    return w.groupBy(code.alias("code")).agg(F.count("*").alias("n"))


_LEDGER_SQL = """WITH g AS (SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY 1),
l AS (SELECT user_id, n, last, CASE WHEN user_id % 11 = 0 THEN 'retired' WHEN user_id % 7 = 0 THEN 'never-attempted' WHEN user_id % 5 = 0 THEN 'unavailable' WHEN user_id % 3 = 0 THEN 'error' ELSE 'observed' END AS status FROM g),
s AS (SELECT *, CASE status WHEN 'observed' THEN 2 WHEN 'never-attempted' THEN 0 WHEN 'unavailable' THEN 30 WHEN 'error' THEN 7 END AS days FROM l),
z AS (SELECT *, last + to_days(days) AS due FROM s)"""


def _source_ledger(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    u = F.col("user_id")
    status = F.when(u % 11 == 0, "retired").when(u % 7 == 0, "never-attempted").when(u % 5 == 0, "unavailable").when(u % 3 == 0, "error").otherwise("observed")
    g = g.withColumn("status", status)
    days = ledger.cadence_days(F.col("status"), F.lit(2))
    return g.withColumn("days", days).withColumn("due", F.col("last") + F.make_dt_interval(days=F.col("days")))


@query(_LEDGER_SQL + """ SELECT user_id, status, days, due FROM z""")
def cadence_due(spark, d):
    return _source_ledger(spark, d).select("user_id", "status", "days", "due")


NOW = "2024-01-31 00:00:00"


@query(_LEDGER_SQL + f""" SELECT user_id, CASE WHEN status = 'retired' THEN 'retired' WHEN status = 'never-attempted' THEN 'never-attempted' WHEN status = 'unavailable' THEN 'unavailable'
 WHEN status = 'error' THEN 'blocked' WHEN due <= TIMESTAMP '{NOW}' THEN 'due' ELSE 'fresh' END AS health FROM z""")
def health_status_case(spark, d):
    z = _source_ledger(spark, d)
    due = F.col("due") <= F.lit(NOW).cast("timestamp_ntz")
    return z.select("user_id", ledger.health_status(F.lit(0), F.col("status"), F.lit(None).cast("string"), F.lit(False), due).alias("health"))


@query(_LEDGER_SQL + f""", h AS (SELECT *, CASE WHEN status = 'error' THEN 'blocked' WHEN status = 'observed' AND due <= TIMESTAMP '{NOW}' THEN 'due' WHEN status = 'observed' THEN 'fresh' ELSE status END AS health FROM z),
t AS (SELECT user_id AS source_id, CASE health WHEN 'never-attempted' THEN CASE WHEN user_id % 2 = 0 THEN 'request-local-custody' ELSE 'collect' END WHEN 'due' THEN 'collect' WHEN 'unavailable' THEN 'refresh-route' WHEN 'blocked' THEN 'review-block' END AS task,
 CASE health WHEN 'never-attempted' THEN CASE WHEN user_id % 2 = 0 THEN 55 ELSE 70 END WHEN 'due' THEN 65 WHEN 'unavailable' THEN 68 WHEN 'blocked' THEN 60 END AS priority, due AS due_at FROM h WHERE health <> 'retired'
 UNION ALL SELECT user_id, 'inspect-drift', 85, last FROM h WHERE health <> 'retired' AND n % 13 = 0 UNION ALL SELECT user_id, 'repair-cache', 98, NULL FROM h WHERE n % 17 = 0)
SELECT source_id, task, priority, due_at FROM t WHERE task IS NOT NULL ORDER BY priority DESC, due_at NULLS LAST, source_id, task LIMIT 40""")
def task_priority(spark, d):
    z = _source_ledger(spark, d)
    due = F.col("due") <= F.lit(NOW).cast("timestamp_ntz")
    records = z.select(
        F.col("user_id").alias("source_id"), "n", ledger.health_status(F.lit(0), F.col("status"), F.lit(None).cast("string"), F.lit(False), due).alias("status"),
        F.lit(0).alias("integrity_errors"), F.lit(False).alias("rights_review"), (F.col("n") % 13 == 0).alias("drift"), (F.col("user_id") % 2 == 0).alias("local_custody"), F.col("due").alias("due_at"), F.col("last").alias("route_checked_at"),
    )
    return ledger.health_plan(records, records.where("n % 17 = 0").select("source_id", F.lit("repair-cache").alias("task")), 40)


_PLAN_SQL = _LEDGER_SQL + f""", e AS (SELECT user_id AS source_id, status, last AS last_attempt_at, due AS next_eligible_at FROM z WHERE status <> 'retired' AND (status = 'never-attempted' OR due <= TIMESTAMP '{NOW}')),
o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN status = 'never-attempted' THEN 0 ELSE 1 END, last_attempt_at, source_id) - 1 AS i, count(*) OVER () AS c FROM e)"""


def _plan_rows(spark: SparkSession, d: str) -> DataFrame:
    return _source_ledger(spark, d).select(F.col("user_id").alias("source_id"), "status", F.col("last").alias("last_attempt_at"), F.col("due").alias("next_eligible_at"))


@query(_PLAN_SQL + " SELECT source_id, status, last_attempt_at FROM o ORDER BY i LIMIT 20")
def due_plan(spark, d):
    return ledger.plan(_plan_rows(spark, d), F.lit(NOW).cast("timestamp_ntz"), 0, 20).select("source_id", "status", "last_attempt_at")


@query(_PLAN_SQL + " SELECT source_id, status, last_attempt_at FROM o ORDER BY (i - (7 % c) + c) % c LIMIT 20")
def rotated_plan(spark, d):
    return ledger.plan(_plan_rows(spark, d), F.lit(NOW).cast("timestamp_ntz"), 7, 20).select("source_id", "status", "last_attempt_at")


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'bot' ELSE 'other' END AS agent, '/' || lower(regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1)) AS path FROM pages),
r(agent, prefix, allow) AS (VALUES ('*', '/', true), ('*', '/en', false), ('*', '/en/9', true), ('bot', '/fr', false), ('bot', '/de/', false), ('bot', '/de/', true)),
h AS (SELECT page_id, prefix, allow FROM p JOIN r ON r.agent = (CASE WHEN p.agent = 'bot' THEN 'bot' ELSE '*' END) AND starts_with(path, prefix)),
b AS (SELECT page_id, arg_max(allow, length(prefix) * 2 + CAST(allow AS INT)) AS a, arg_max(prefix, length(prefix)) AS rule FROM h GROUP BY 1)
SELECT p.page_id AS path_id, coalesce(a, true) AS allowed, rule FROM p LEFT JOIN b USING (page_id)""")
def robots_allowed(spark, d):
    path = F.concat(F.lit("/"), F.lower(F.regexp_extract("url", "://[^/?#]*/?([^?#]*)", 1)))
    p = table(spark, d, "pages").select(F.col("page_id").alias("path_id"), F.when(F.col("page_id") % 2 == 0, "bot").otherwise("other").alias("agent"), path.alias("path"))
    r = spark.createDataFrame([("*", "/", True), ("*", "/en", False), ("*", "/en/9", True), ("bot", "/fr", False), ("bot", "/de/", False), ("bot", "/de/", True)], "agent string, prefix string, allow boolean")
    return ledger.robots_allows(p, r)


# Graphs.


def _nation_edges(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 2 + F.col("n_regionkey")) % 25).alias("dst"), (F.col("n_nationkey") % 7 + 1).cast("double").alias("weight"), F.when(F.col("n_nationkey") % 4 == 0, F.array(F.lit("ship"))).otherwise(F.array().cast("array<string>")).alias("needs")).unionByName(
        n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + 3) % 25).alias("dst"), F.lit(4.0).alias("weight"), F.array().cast("array<string>").alias("needs"))
    )


_EDGES_SQL = """e AS (SELECT n_nationkey AS src, (n_nationkey * 2 + n_regionkey) % 25 AS dst, CAST(n_nationkey % 7 + 1 AS DOUBLE) AS weight, n_nationkey % 4 = 0 AS ship FROM nation
 UNION ALL SELECT n_nationkey, (n_nationkey + 3) % 25, 4.0, false FROM nation)"""


@query(f"""WITH RECURSIVE {_EDGES_SQL}, c AS (SELECT n_nationkey AS start, n_nationkey AS node FROM nation UNION SELECT c.start, e.dst FROM c JOIN e ON c.node = e.src WHERE e.ship) SELECT start, node FROM c""")
def continuity_closure(spark, d):
    edges = _nation_edges(spark, d).where(F.size("needs") > 0)
    return graph.closure(edges, table(spark, d, "nation").select(F.col("n_nationkey").alias("node")))


@query(f"""WITH RECURSIVE {_EDGES_SQL}, s AS (SELECT src, dst FROM e WHERE ship), c AS (SELECT src AS start, dst AS node FROM s UNION SELECT c.start, s.dst FROM c JOIN s ON c.node = s.src) SELECT DISTINCT start AS node FROM c WHERE start = node""")
def continuity_cycles(spark, d):
    return graph.cycle_nodes(_nation_edges(spark, d).where(F.size("needs") > 0))


NEXT_PART = """n AS (SELECT l_partkey AS src, l_orderkey AS o, l_linenumber AS k, coalesce(lead(l_partkey) OVER w, first_value(l_partkey) OVER w) AS dst FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def next_parts(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, o, k): of each line its part and the next line's in the order, the first one's after the last."""
    whole = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    nxt = F.coalesce(F.lead("l_partkey").over(whole), F.first("l_partkey").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), nxt.alias("dst"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("k"))


@query(f"""WITH RECURSIVE {NEXT_PART}, e AS (SELECT src, max(struct_pack(o := o, k := k, dst := dst)).dst AS dst FROM n GROUP BY src),
r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)
SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1""")
def part_cycles(spark, d):
    """Parts by the part that follows in their latest line: each has one way out, so cycles stand at the ends of trees."""
    last = next_parts(spark, d).groupBy("src").agg(F.max(F.struct("o", "k", "dst"))["dst"].alias("dst"))
    return graph.strong_components(last)


@query(f"""WITH RECURSIVE {NEXT_PART}, e AS (SELECT DISTINCT src, dst FROM n WHERE k = 1),
r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)
SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1""")
def part_knots(spark, d):
    """Parts by what follows where they are an order's first line: many ways out and in, so one large component beside small ones."""
    return graph.strong_components(next_parts(spark, d).where("k = 1").select("src", "dst"))


@query("""WITH RECURSIVE m AS (SELECT DISTINCT l_suppkey AS node, l_partkey AS key FROM lineitem),
b AS (SELECT DISTINCT node, 0 AS depth FROM m WHERE node % 20 = 0 UNION SELECT y.node, b.depth + 1 FROM b JOIN m x ON x.node = b.node JOIN m y ON y.key = x.key WHERE b.depth < 2)
SELECT node, min(depth) AS depth FROM b GROUP BY 1""")
def key_bfs_depth(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("key")).distinct()
    return graph.bounded_bfs(m, m.where("node % 20 = 0").select("node"), 2)


@query("""WITH RECURSIVE m AS (SELECT DISTINCT l_suppkey AS node, l_partkey AS key FROM lineitem), h AS (SELECT node, min(node) OVER (PARTITION BY key) AS hub FROM m),
e AS (SELECT node AS src, hub AS dst FROM h UNION SELECT hub, node FROM h), c AS (SELECT node AS start, node FROM m UNION SELECT c.start, e.dst FROM c JOIN e ON c.node = e.src)
SELECT start AS node, min(node) AS component FROM c GROUP BY 1""")
def connected_components(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("key")).distinct()
    return graph.clusters(m)


@query(f"""WITH RECURSIVE {_EDGES_SQL}, p AS (SELECT 0 AS node, CAST(0 AS DOUBLE) AS distance, 0 AS hops UNION SELECT e.dst, p.distance + e.weight, hops + 1 FROM p JOIN e ON p.node = e.src WHERE hops < 12 AND NOT ship AND p.distance < 60)
SELECT 0 AS start, node, min(distance) AS distance FROM p GROUP BY node""")
def shortest_path_caps(spark, d):
    return graph.shortest(_nation_edges(spark, d), table(spark, d, "nation").where("n_nationkey = 0").select(F.col("n_nationkey").alias("node")), held=[])


# Work orders, coverage, set operations.


@query("""WITH m AS (SELECT source || '-' || lang AS key, source, least(n_chars, 1000) AS c, doc_id, lang FROM documents), k AS (SELECT key, min(printf('doc-%06d', doc_id)) AS head, count(*) AS n, min(c) AS floor FROM m GROUP BY 1)
SELECT printf('doc-%06d', doc_id) AS candidate_id, CAST(CASE WHEN source IN ('src1', 'src2') THEN 1000 ELSE 500 END + CASE WHEN n >= 3 THEN 200 ELSE 0 END + CASE WHEN c < 600 THEN 150 ELSE 0 END + floor(c / 10) AS BIGINT) AS priority,
 CASE WHEN source IN ('src1', 'src2') THEN 'direct-source' ELSE 'cross-source-context' END || CASE WHEN c < 600 THEN ',disputed' ELSE '' END || CASE WHEN n >= 3 THEN ',high-leverage' ELSE '' END AS lanes
FROM m JOIN k USING (key) WHERE source IN ('src1', 'src2')""")
def work_item_priority(spark, d):
    items, _ = recall.work_order(candidates(spark, d), ["src1", "src2"], 1)
    return items.select("candidate_id", "priority", F.array_join("lanes", ",").alias("lanes"))


@query("""SELECT min(printf('doc-%06d', doc_id)) AS component, count(*) AS members, CAST(min(least(n_chars, 1000)) AS INT) AS confidence_floor, source || '-' || lang AS keys FROM documents WHERE source IN ('src1', 'src2') GROUP BY source, lang""")
def cluster_rollup(spark, d):
    _, clusters = recall.work_order(candidates(spark, d), ["src1", "src2"], 1)
    return clusters.select("component", F.size("candidate_ids").cast("long").alias("members"), "confidence_floor", F.array_join("keys", ",").alias("keys"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS p, l_suppkey AS key FROM lineitem), o AS (SELECT o_orderkey AS p, o_orderstatus = 'F' AS bad FROM orders),
ok AS (SELECT p, key FROM c JOIN o USING (p) WHERE NOT bad), n AS (SELECT key, count(*) AS n FROM ok GROUP BY 1), l AS (SELECT p, min(n) AS least FROM ok JOIN n USING (key) GROUP BY 1)
SELECT p AS proposal_id, CASE WHEN bad THEN 'contradicted' WHEN least = 1 THEN 'necessary' WHEN least > 1 THEN 'strongly-implied' ELSE 'permissible' END AS classification FROM o LEFT JOIN l USING (p)""")
def coverage_classify(spark, d):
    cover = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("proposal_id"), F.col("l_suppkey").alias("key")).distinct()
    return recall.classify(cover, table(spark, d, "orders").select(F.col("o_orderkey").alias("proposal_id"), (F.col("o_orderstatus") == "F").alias("contradicted")))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def pending_except(spark, d):
    return ledger.pending(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE n_chars > 1000")
def all_mode_intersect(spark, d):
    return table(spark, d, "labels").where("quality = 1").select("doc_id").intersect(table(spark, d, "documents").where("n_chars > 1000").select("doc_id"))


@query("SELECT 'label' AS estate, doc_id AS id FROM labels UNION ALL SELECT 'document', doc_id FROM documents")
def union_estates(spark, d):
    return table(spark, d, "labels").select(F.lit("label").alias("estate"), F.col("doc_id").alias("id")).unionByName(table(spark, d, "documents").select(F.lit("document").alias("estate"), F.col("doc_id").alias("id")))


@query("""WITH s AS (SELECT l_orderkey AS k, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) AS a, string_agg(DISTINCT l_linestatus, '' ORDER BY l_linestatus) AS b FROM lineitem GROUP BY 1)
SELECT a, b, a = b AS equal, count(*) AS n FROM s GROUP BY 1, 2, 3""")
def set_equality(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("x"), F.array_sort(F.collect_set("l_linestatus")).alias("y"))
    return s.groupBy(F.array_join("x", "").alias("a"), F.array_join("y", "").alias("b"), (F.col("x") == F.col("y")).alias("equal")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT DISTINCT l_orderkey AS decision_id, l_partkey AS c FROM lineitem WHERE l_linenumber <= 2), y AS (SELECT DISTINCT l_partkey AS c, l_suppkey AS cluster_id FROM lineitem),
n AS (SELECT decision_id, count(*) AS total FROM x GROUP BY 1) SELECT decision_id, cluster_id FROM x JOIN y USING (c) JOIN n USING (decision_id) GROUP BY decision_id, cluster_id, total HAVING count(*) = total""")
def merge_division(spark, d):
    li = table(spark, d, "lineitem")
    return recall.merge_in_one_cluster(li.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("decision_id"), F.col("l_partkey").alias("candidate_id")), li.select(F.col("l_suppkey").alias("cluster_id"), F.col("l_partkey").alias("candidate_id")))


@query("""WITH r AS (SELECT count(*) AS total, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS reviewed, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS resolved FROM documents)
SELECT true AS passed, total, reviewed, CAST(floor(reviewed * 1000 / total) AS BIGINT) AS coverage_permille, CAST(floor(resolved * 1000 / total) AS BIGINT) AS resolved_permille, resolved AS confirmed, reviewed - resolved AS deferred FROM r""")
def reconcile_receipt(spark, d):
    work = table(spark, d, "documents").select(F.col("doc_id").alias("candidate_id"))
    dec = table(spark, d, "labels").select(F.col("doc_id").alias("decision_id"), F.when(F.col("quality") == 1, "confirm").otherwise("defer").alias("action"), F.col("doc_id").alias("candidate_id"))
    out = recall.reconcile(work, dec, recall.twice_decided(dec))
    return out.select("passed", "total", "reviewed", "coverage_permille", "resolved_permille", F.col("confirm").alias("confirmed"), F.col("defer").alias("deferred"))


# Fingerprints, contacts, JSON.


@query("""SELECT doc_id, 'sha256:' || sha256(text) AS digest, 'doc:' || substr(sha256(text), 1, 32) AS content_id FROM documents""")
def fingerprints(spark, d):
    return table(spark, d, "documents").select("doc_id", P.digest(F.col("text")).alias("digest"), P.content_id("doc", F.col("text")).alias("content_id"))


@query("""WITH u AS (SELECT doc_id, text, list_concat(flatten(list_transform(string_split(text, ''), lambda x: CASE WHEN unicode(x) > 65535 THEN [55296 + ((unicode(x) - 65536) >> 10), 56320 + ((unicode(x) - 65536) & 1023)] ELSE [unicode(x)] END)), [31]) AS w FROM documents)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN 'fnv1a32:' || lpad(lower(to_hex(list_reduce(list_prepend(2166136261, list_transform(w, lambda x: CAST(x AS BIGINT))), lambda a, x: CAST((xor(a, x) * 16777619) % 4294967296 AS BIGINT)))), 8, '0') END AS fnv FROM u""")
def fingerprint_fnv1a(spark, d):
    return table(spark, d, "documents").select("doc_id", P.fnv1a32(F.col("text")).alias("fnv"))


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}') OR regexp_matches(text, '(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}')
 OR regexp_matches(text, '(?i)\b\d{1,5} [a-z]+ (?:street|st\.|avenue|ave\.|road|rd\.|lane|drive)\b') AS contact FROM documents""")
def private_contact_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", X.private_contact(F.col("text")).alias("contact"))


@query(r"""SELECT page_id, regexp_matches(html, '(?:/home/|/Users/|[A-Z]:\\)') AS forbidden, regexp_matches(url, '^https://') AS https FROM pages""")
def forbidden_pattern(spark, d):
    return table(spark, d, "pages").select("page_id", F.col("html").rlike(r"(?:/home/|/Users/|[A-Z]:\\)").alias("forbidden"), F.col("url").rlike("^https://").alias("https"))


@query(r"""WITH u AS (SELECT page_id, regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) AS uri FROM pages)
SELECT page_id, uri, NOT contains(uri, '\') AND NOT regexp_matches(uri, '^[A-Za-z][A-Za-z0-9+.-]*:') AND len(list_filter(string_split(uri, '/'), lambda p: p IN ('', '.', '..'))) = 0 AS safe FROM u""")
def safe_paths(spark, d):
    uri = F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1)
    return table(spark, d, "pages").select("page_id", uri.alias("uri"), X.safe_relative(uri).alias("safe"))


@query("""SELECT event_type, k AS key, count(*) AS n, min(json_extract_string(props, '$."' || k || '"')) AS low, max(json_extract_string(props, '$."' || k || '"')) AS high FROM (SELECT event_type, props, unnest(json_keys(props)) AS k FROM events) GROUP BY 1, 2""")
def json_props(spark, d):
    kv = table(spark, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "v"))
    return kv.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


@query(r"""SELECT doc_id, lower(left(trim(regexp_replace(regexp_replace(lower(left(source || ' ' || lang || ' ' || CAST(doc_id AS VARCHAR), 90)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 72)) AS slug FROM documents""")
def slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", X.slug(F.concat_ws(" ", "source", "lang", F.col("doc_id").cast("string"))).alias("slug"))


# Dossiers, admissions, reviews, validation.

_REFS_SQL = """refs AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'reject-off-topic' WHEN quality = 0 THEN 'defer-insufficient-identity' ELSE 'admit' END AS outcome,
 CASE WHEN doc_id % 5 = 0 THEN 'discussion-provenance' WHEN doc_id % 7 = 0 THEN 'scholarly-analogue' ELSE 'primary' END AS authority FROM labels),
st AS (SELECT doc_id, CASE WHEN outcome = 'reject-off-topic' THEN 'rejected' WHEN outcome = 'defer-insufficient-identity' THEN 'deferred' WHEN authority = 'discussion-provenance' THEN 'provenance-only'
 WHEN authority = 'scholarly-analogue' THEN 'constraint-only' ELSE 'supporting-only' END AS standing FROM refs)"""


def _references(spark: SparkSession, d: str) -> DataFrame:
    la = table(spark, d, "labels")
    outcome = F.when(F.col("toxic") == 1, "reject-off-topic").when(F.col("quality") == 0, "defer-insufficient-identity").otherwise("admit")
    authority = F.when(F.col("doc_id") % 5 == 0, "discussion-provenance").when(F.col("doc_id") % 7 == 0, "scholarly-analogue").otherwise("primary")
    return la.select("doc_id", dossier.standing(outcome, authority).alias("standing"))


@query(f"WITH {_REFS_SQL} SELECT standing, count(*) AS n FROM (SELECT standing FROM st UNION ALL SELECT 'unreviewed' FROM documents) GROUP BY 1")
def standing_counts(spark, d):
    return dossier.standing_counts(_references(spark, d), table(spark, d, "documents").select(F.lit("unreviewed").alias("standing")))


@query(f"""WITH {_REFS_SQL}, q AS (SELECT source, count(DISTINCT lang) AS c, count(*) FILTER (n_chars > 4000) AS p, count(*) FILTER (n_chars > 9000) AS u, count(standing) AS s,
 count(*) FILTER (standing IN ('rejected', 'deferred')) AS x, count(*) FILTER (doc_id % 100 = 0) AS r, bool_or(n_chars < 60) AS g1, bool_or(n_chars > 20000) AS g2 FROM documents LEFT JOIN st USING (doc_id) GROUP BY 1),
a AS (SELECT source, unnest(list_filter([CASE WHEN c > 1 THEN 'split-continuity' END, CASE WHEN p = 0 THEN 'search-private-edition' END, CASE WHEN u > 0 THEN 'review-exact-locator' END, CASE WHEN x > 0 THEN 'inspect-disposition' END,
 CASE WHEN s = 0 THEN 'acquire-public-record' END, CASE WHEN r > 0 THEN 'reconcile-candidate' END, CASE WHEN g1 OR g2 THEN 'close-gap' END, CASE WHEN g1 THEN 'resolve-edition' END, CASE WHEN g2 THEN 'review-structured-observation' END], lambda v: v IS NOT NULL)) AS v FROM q)
SELECT source, string_agg(DISTINCT v, ',' ORDER BY v) AS actions FROM a GROUP BY 1""")
def next_actions(spark, d):
    q = table(spark, d, "documents").join(_references(spark, d), "doc_id", "left").groupBy("source").agg(
        F.countDistinct("lang").alias("c"), F.count_if(F.col("n_chars") > 4000).alias("p"), F.count_if(F.col("n_chars") > 9000).alias("u"), F.count("standing").alias("s"),
        F.count_if(F.col("standing").isin("rejected", "deferred")).alias("x"), F.count_if(F.col("doc_id") % 100 == 0).alias("r"), F.max(F.col("n_chars") < 60).alias("g1"), F.max(F.col("n_chars") > 20000).alias("g2"),
    )
    gaps = F.filter(F.array(F.when(F.col("g1"), "edition-unresolved"), F.when(F.col("g2"), "structured-review-required")), lambda x: x.isNotNull())
    return q.select("source", F.array_join(dossier.next_actions(*(F.col(x) for x in "cpusxr"), gaps), ",").alias("actions"))


@query(f"""WITH {_REFS_SQL}, g AS (SELECT doc_id FROM documents WHERE n_chars > 3000), c AS (SELECT doc_id FROM g WHERE doc_id % 3 = 0), l AS (SELECT doc_id FROM g WHERE doc_id % 4 = 0)
SELECT 'uncovered-gap' AS code, 'error' AS severity, CAST(doc_id AS VARCHAR) AS subject, '' AS detail FROM g WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0
UNION ALL SELECT 'gap-both-closed-and-limited', 'error', CAST(doc_id AS VARCHAR), '' FROM g WHERE doc_id % 12 = 0
UNION ALL SELECT 'uncovered-disposition', 'error', CAST(doc_id AS VARCHAR), '' FROM st WHERE standing IN ('rejected', 'deferred') AND doc_id % 2 = 1""")
def answer_coverage(spark, d):
    g = table(spark, d, "documents").where("n_chars > 3000").select(F.col("doc_id").alias("gap_id"))
    refs = _references(spark, d).withColumnRenamed("doc_id", "reference_id")
    return dossier.coverage_findings(g, g.where("gap_id % 3 = 0"), g.where("gap_id % 4 = 0"), refs, refs.where("reference_id % 2 = 0").select("reference_id"))


@query("""WITH c AS (SELECT conv_id, string_agg(text || ' [s' || conv_id || ':' || turn || ']', chr(10) || chr(10) ORDER BY turn, text) AS b FROM conversations WHERE role = 'assistant' GROUP BY 1),
l AS (SELECT conv_id, string_agg('- ' || text, chr(10) ORDER BY turn, text) AS x FROM conversations WHERE role = 'system' GROUP BY 1)
SELECT conv_id AS answer_id, sha256(b || CASE WHEN x IS NOT NULL THEN chr(10) || chr(10) || 'Limits:' || chr(10) || x ELSE '' END) AS digest FROM c LEFT JOIN l USING (conv_id)""")
def render_answers(spark, d):
    c = table(spark, d, "conversations")
    claims = c.where("role = 'assistant'").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("ord"), "text", F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("source_id"), F.array(F.col("turn").cast("string")).alias("locator_ids"))
    limits = c.where("role = 'system'").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("ord"), "text")
    return dossier.render_answers(claims, limits).select("answer_id", F.sha2("text", 256).alias("digest"))


@query("""WITH r AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), c AS (SELECT doc_id, unnest(p) AS text, unnest(range(len(p))) AS part FROM r)
SELECT CAST(doc_id AS VARCHAR) || '#' || (part + 1) AS candidate_id, CAST(part AS INT) AS part, 'sha256:' || sha256(text) AS digest FROM c""")
def split_candidates(spark, d):
    records = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.col("text").alias("statement"), F.split("text", "\n").alias("parts"))
    return review.split_candidates(records).select("candidate_id", "part", "digest")


_INTAKE_SQL = """i AS (SELECT doc_id AS intake_id, sha256(CAST(doc_id AS VARCHAR)) AS digest, CASE WHEN doc_id % 9 = 0 THEN ' reviewer ' ELSE 'Ann ' || lang END AS reviewer, CASE WHEN doc_id % 11 = 0 THEN 'ann ' || lang ELSE 'Bob' END AS actor,
 CASE WHEN doc_id % 6 = 0 THEN 'confirm' WHEN doc_id % 6 = 1 THEN 'correct' WHEN doc_id % 6 = 2 THEN 'split' WHEN doc_id % 6 = 3 THEN 'merge' WHEN doc_id % 6 = 4 THEN 'reject' ELSE 'defer' END AS action FROM documents),
c AS (SELECT doc_id AS candidate_id, CASE WHEN quality = 0 THEN 'x' ELSE sha256(CAST(doc_id AS VARCHAR)) END AS digest FROM labels)"""


def _intakes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, n = table(spark, d, "documents"), F.col("doc_id")
    sha = F.sha2(n.cast("string"), 256)
    action = F.element_at(F.array(*map(F.lit, ("confirm", "correct", "split", "merge", "reject", "defer"))), (n % 6 + 1).cast("int"))
    reviewer, actor = F.when(n % 9 == 0, " reviewer ").otherwise(F.concat(F.lit("Ann "), "lang")), F.when(n % 11 == 0, F.concat(F.lit("ann "), "lang")).otherwise("Bob")
    intakes = docs.select(n.alias("intake_id"), n.alias("candidate_id"), sha.alias("digest"), reviewer.alias("reviewer"), actor.alias("actor"), action.alias("action"))
    return intakes, table(spark, d, "labels").select(n.alias("candidate_id"), F.when(F.col("quality") == 0, "x").otherwise(sha).alias("digest"))


@query(f"""WITH {_INTAKE_SQL}, b AS (SELECT i.*, c.digest AS d FROM i LEFT JOIN c ON candidate_id = intake_id)
SELECT 'unknown-candidate' AS code, 'error' AS severity, CAST(intake_id AS VARCHAR) AS subject, '' AS detail FROM b WHERE d IS NULL UNION ALL SELECT 'digest-drift', 'error', CAST(intake_id AS VARCHAR), '' FROM b WHERE d <> digest
UNION ALL SELECT 'unnamed-reviewer', 'error', CAST(intake_id AS VARCHAR), '' FROM b WHERE lower(trim(reviewer)) = 'reviewer' UNION ALL SELECT 'actor-is-reviewer', 'error', CAST(intake_id AS VARCHAR), '' FROM b WHERE lower(trim(actor)) = lower(trim(reviewer))""")
def intake_findings(spark, d):
    return review.intake_findings(*_intakes(spark, d))


@query(f"""WITH {_INTAKE_SQL}, ok AS (SELECT i.* FROM i JOIN c ON candidate_id = intake_id AND c.digest = i.digest WHERE lower(trim(reviewer)) <> 'reviewer' AND lower(trim(actor)) <> lower(trim(reviewer)))
SELECT intake_id AS candidate_id, action, unnest(CASE WHEN action IN ('confirm', 'correct', 'split') THEN ['proposition', 'evidence-edge'] WHEN action = 'reject' THEN ['disposition'] WHEN action = 'defer' THEN ['review-hold'] ELSE ['merge-hold'] END) AS draft FROM ok""")
def projection_plan(spark, d):
    return review.projection_plan(review.stage(*_intakes(spark, d))).select("candidate_id", "action", "draft")


@query("""SELECT source, batch, count(*) AS n, min(doc_id) AS first_id FROM (SELECT source, doc_id, ntile(3) OVER (PARTITION BY source ORDER BY doc_id) AS batch FROM documents) GROUP BY 1, 2""")
def review_batches(spark, d):
    b = review.batches(table(spark, d, "documents").select("source", "doc_id"), 3, "doc_id", "source")
    return b.groupBy("source", F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("""SELECT 'causal-order' AS code, 'error' AS severity, CAST(e.event_id AS VARCHAR) AS subject, CAST(p.event_id AS VARCHAR) AS detail
FROM events e JOIN events p ON p.event_id = (e.event_id * 7 + 3) % 997 WHERE e.event_id % 3 = 0 AND p.event_id >= e.event_id""")
def causal_order(spark, d):
    e = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_id").alias("sequence"), F.when(F.col("event_id") % 3 == 0, F.array((F.col("event_id") * 7 + 3) % 997)).otherwise(F.array().cast("array<bigint>")).alias("causal_parent_event_ids")
    )
    return validate.causal_order(e)


@query("""WITH c AS (SELECT p_partkey AS id, p_brand AS g, p_size FROM part), s AS (SELECT id, g, p_size FROM c WHERE id % 50 = 0)
SELECT 'group-cardinality' AS code, 'error' AS severity, g AS subject, CAST(n AS VARCHAR) AS detail FROM (SELECT b.g, count(s.id) AS n FROM (SELECT DISTINCT g FROM c) b LEFT JOIN s USING (g) GROUP BY 1) WHERE n <> 1
UNION ALL SELECT 'missing-required-option', 'error', CAST(id AS VARCHAR), CAST(id - 50 AS VARCHAR) FROM s WHERE p_size < 10 AND id - 50 NOT IN (SELECT id FROM s)
UNION ALL SELECT 'conflicting-option', 'error', CAST(id AS VARCHAR), CAST(id - 100 AS VARCHAR) FROM s WHERE p_size > 40 AND id - 100 IN (SELECT id FROM s)""")
def decision_findings(spark, d):
    p, none = table(spark, d, "part"), F.array().cast("array<bigint>")
    options = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("group_id"), F.when(F.col("p_size") < 10, F.array(F.col("p_partkey") - 50)).otherwise(none).alias("requires_option_ids"), F.when(F.col("p_size") > 40, F.array(F.col("p_partkey") - 100)).otherwise(none).alias("conflicts_with_option_ids"))
    groups = p.select(F.col("p_brand").alias("id")).distinct().withColumn("selection", F.lit("exactly-one"))
    return validate.decision_findings(groups, options, options.where("id % 50 = 0").select("id"))


@query(r"""SELECT page_id, regexp_matches(url, '^https://[^/?#@]*\.example\.org(/en/[^?#]*)') AND NOT contains(url, '#') AS allowed FROM pages""")
def endpoint_allowed(spark, d):
    host = F.try_parse_url("url", F.lit("HOST"))
    ok = web.endpoint_allowed(F.regexp_replace("url", r"^(https?)://[^/?#@]*\.example\.org", "$1://api.example.org"), "api.example.org", r"^/en/")
    return table(spark, d, "pages").select("page_id", F.coalesce(ok & host.endswith(".example.org"), F.lit(False)).alias("allowed"))


# The fold, and adapters over payloads made of table rows.


STATE_SQL = """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CAST(CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE -1 END * round(value) AS BIGINT) AS delta FROM events),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(100 AS BIGINT) AS gold, CAST(0 AS BIGINT) AS done FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT f.user_id, e.i, CASE WHEN gold + delta BETWEEN 0 AND 500 THEN gold + delta ELSE gold END, done + CASE WHEN gold + delta BETWEEN 0 AND 500 THEN 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT CAST(user_id AS VARCHAR) AS branch_id, CAST(arg_max(gold, i) AS DOUBLE) AS gold, max(done) AS completed, max(i) - max(done) AS rolled_back FROM f GROUP BY 1"""


@query(STATE_SQL)
def state_fold(spark, d):
    """Each user's events as a branch: a bounded balance, where an event that would leave the bounds is rolled back."""
    sign = F.when(F.col("event_type").isin("purchase", "click"), 1).otherwise(-1)
    delta = (sign * F.round("value")).cast("long")
    event = F.struct(
        F.format_string("e%012d", "event_id").alias("id"), F.col("event_id").alias("sequence"), F.lit(True).alias("enabledByDefault"), F.array(F.lit("m")).alias("continuityIds"), F.struct(F.lit(0).alias("earliest"), F.lit(0).alias("latest")).alias("time"),
        F.struct(F.array(F.struct(F.lit("gold").alias("variableId"), delta.alias("delta"))).alias("variableDeltas")).alias("effects"),
    )
    variable = F.struct(F.lit("gold").alias("id"), F.lit(100).alias("initialValue"), F.lit(0).alias("minimum"), F.lit(500).alias("maximum"), F.lit(True).alias("integer"), F.array(F.lit("m")).alias("continuityIds"))
    world = F.struct(F.array(F.struct(F.lit("m").alias("id"), F.array().cast("array<string>").alias("inheritsFromIds"))).alias("continuities"), F.array(variable).alias("stateVariables"), F.col("events"))
    users = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("branch_id")).agg(F.collect_list(event).alias("events"), F.count("*").alias("n"))
    branches = users.select("branch_id", F.to_json(world).alias("bible"), F.lit('{"id":"d","targetContinuityId":"m"}').alias("decisions"), F.lit("[]").alias("extra_events"))
    out = canon.compile_branches(branches)
    failed = F.size(F.filter("findings", lambda f: f["severity"] == "error"))
    return out.select("branch_id", F.col("variables")["gold"].alias("gold"), F.size("completed").cast("long").alias("completed"), failed.cast("long").alias("rolled_back"))


@query(STATE_SQL)
def state_fold_rows(spark, d):
    """The same branches with each event a row, folded as keyed state."""
    sign = F.when(F.col("event_type").isin("purchase", "click"), 1).otherwise(-1)
    change = F.struct(F.lit("gold").alias("variableId"), (sign * F.round("value")).cast("long").alias("delta"))
    event = F.struct(
        F.format_string("e%012d", "event_id").alias("id"), F.col("event_id").alias("sequence"), F.lit(True).alias("enabledByDefault"), F.array(F.lit("m")).alias("continuityIds"), F.struct(F.lit(0).alias("earliest"), F.lit(0).alias("latest")).alias("time"),
        F.struct(F.array(change).alias("variableDeltas")).alias("effects"),
    )
    world = '{"bible":{"continuities":[{"id":"m","inheritsFromIds":[]}],"stateVariables":[{"id":"gold","initialValue":100,"minimum":0,"maximum":500,"integer":true,"continuityIds":["m"]}]},"decisions":{"id":"d","targetContinuityId":"m"}}'
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("branch_id"), F.lit("event").alias("kind"), F.to_json(event).alias("body"))
    worlds = events.select("branch_id").distinct().select("branch_id", F.lit("world").alias("kind"), F.lit(world).alias("body"))
    out = branches.fold_rows(events.unionByName(worlds))
    return out.select("branch_id", F.col("variables")["gold"].alias("gold"), "completed", "rolled_back")


@query("""SELECT p_partkey AS request_id, 'catalogue:/works/OL' || p_partkey || 'W' AS source_record_id, p_name AS title, 'https://openlibrary.org/works/OL' || p_partkey || 'W' AS canonical_uri FROM part WHERE p_size <> 7""")
def adapter_catalogue(spark, d):
    doc = F.struct(F.when(F.col("p_size") != 7, F.concat(F.lit("/works/OL"), F.col("p_partkey").cast("string"), F.lit("W"))).alias("key"), F.col("p_name").alias("title"), F.array("p_brand").alias("publisher"), F.lit("not kept").alias("description"))
    payloads = table(spark, d, "part").select(F.col("p_partkey").alias("request_id"), F.to_json(F.struct(F.array(doc).alias("docs"))).alias("payload"))
    good, _ = adapters.normalise(payloads, "catalogue")
    return good.select("request_id", "source_record_id", "title", "canonical_uri")


@query("""SELECT o_orderkey AS request_id, 'doi:10.1000/' || o_orderkey AS source_record_id, 'Order ' || o_orderstatus AS title, printf('%04d-%02d-01', year(o_orderdate), month(o_orderdate)) AS published_at FROM orders""")
def adapter_works(spark, d):
    o = table(spark, d, "orders")
    item = F.struct(
        F.concat(F.lit("10.1000/"), F.col("o_orderkey").cast("string")).alias("DOI"), F.array(F.concat(F.lit("Order "), "o_orderstatus")).alias("title"), F.lit("not kept").alias("abstract"),
        F.struct(F.array(F.array(F.year("o_orderdate"), F.month("o_orderdate"))).alias("date-parts")).alias("published"),
    )
    payloads = o.select(F.col("o_orderkey").alias("request_id"), F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message"))).alias("payload"))
    good, _ = adapters.normalise(payloads, "works")
    return good.select("request_id", "source_record_id", "title", "published_at")


@query("""SELECT c_custkey AS request_id, c_name AS title, 'http://www.wikidata.org/entity/Q' || c_custkey AS canonical_uri, 'item,itemLabel' AS variables FROM customer""")
def adapter_sparql(spark, d):
    cell = lambda c: F.struct(F.lit("literal").alias("type"), c.alias("value"))
    row = F.struct(cell(F.concat(F.lit("http://www.wikidata.org/entity/Q"), F.col("c_custkey").cast("string"))).alias("item"), cell(F.col("c_name")).alias("itemLabel"), cell(F.lit("x")).alias("contactPhone"))
    payloads = table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.to_json(F.struct(F.struct(F.array(row).alias("bindings")).alias("results"))).alias("payload"))
    good, _ = adapters.normalise(payloads, "sparql")
    names = F.from_json(F.get_json_object("fields", "$.variables"), "array<string>")
    return good.select("request_id", "title", "canonical_uri", F.array_join(names, ",").alias("variables"))


@query("""SELECT s_suppkey AS request_id, 'wiki:page:' || s_suppkey || ':revision:' || (s_suppkey + 1) AS source_record_id, s_name AS title, 'https://w.example/' || s_suppkey || '?oldid=' || (s_suppkey + 1) AS canonical_uri FROM supplier WHERE s_suppkey % 9 <> 0""")
def adapter_wiki(spark, d):
    n = F.col("s_suppkey")
    page = F.struct(
        n.alias("pageid"), F.col("s_name").alias("title"), (n + 1).alias("lastrevid"), F.concat(F.lit("https://w.example/"), n.cast("string")).alias("fullurl"), F.when(n % 9 == 0, "").alias("missing"), F.array(F.struct(F.lit("File:x").alias("title"))).alias("links")
    )
    payloads = table(spark, d, "supplier").select(n.alias("request_id"), F.to_json(F.struct(F.struct(F.create_map(n.cast("string"), page).alias("pages")).alias("query"))).alias("payload"))
    good, _ = adapters.normalise(payloads, "wiki")
    return good.select("request_id", "source_record_id", "title", "canonical_uri")


@query("""SELECT doc_id % 3 AS region, sha256(text) AS digest FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1""".replace("doc_id % 3 AS region, ", ""))
def content_addressed(spark, d):
    out = files.content_addressed(table(spark, d, "documents").select("text"), "text")
    return out.select(F.substring("digest", 8, 64).alias("digest"))


@query("""SELECT format, count(*) AS n, min(line) AS first FROM (SELECT 'markdown' AS format, '- **' || p_name || '** — ' || p_brand || '. CC0. <https://x.example/' || p_partkey || '>' AS line FROM part
 UNION ALL SELECT 'json', '{"author":"' || p_brand || '","license":"CC0","source_uri":"https://x.example/' || p_partkey || '","title":"' || p_name || '"}' FROM part) GROUP BY 1""")
def credit_lines(spark, d):
    rows = table(spark, d, "part").select(F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.lit("CC0").alias("license"), F.concat(F.lit("https://x.example/"), F.col("p_partkey").cast("string")).alias("source_uri"))
    return files.credits(rows).where("format <> 'bibtex'").groupBy("format").agg(F.count("*").alias("n"), F.min("line").alias("first"))


# Streams: the ledger read as a stream into an idempotent sink, twice over.


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def stream_ledger(spark, d):
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for run in ("a", "b"):  # a second run over the same files adds nothing
        streams.append_once(streams.stream_events(spark, f"{d}/events.parquet*"), f"{at}/ledger", f"{at}/{run}").awaitTermination()
    log = ledger.stored(spark, f"{at}/ledger")
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("event_id").alias("ids"))


@query("""WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT start, event_type, n FROM w WHERE start + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)""")
def stream_windows(spark, d):
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    w = streams.windowed_counts(streams.stream_events(spark, f"{d}/events.parquet*"))
    w.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# Fingerprints of nested tables.


def _own_sql(**columns: str) -> str:
    """The text that a record's columns make, in SQL."""
    one = lambda name, c: f"'{name}:' || coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-') || ';'"
    return " || ".join(one(name, c) for name, c in sorted(columns.items()))


def _lanes_sql(digest: str) -> str:
    sums = (f"coalesce(sum(CAST(CAST('0x' || substr({digest}, {16 * i + 1}, 16) AS UBIGINT) AS HUGEINT)), 0)" for i in range(hashtree.LANES))
    return " || ':' || ".join([f"count({digest})", *sums])


LINE, ORDER, CUSTOMER = ("l_linenumber", "l_partkey", "l_suppkey"), ("o_orderstatus", "o_orderpriority"), ("c_name", "c_mktsegment")


def line_text(number: str = "l_linenumber") -> str:
    return _own_sql(**{c: c for c in LINE} | {"l_linenumber": number})


def facts(spark: SparkSession, d: str, lines: DataFrame | None = None, stored: bool = False) -> hashtree.Level:
    """Nations with their customers, orders and lines; with `stored`, tables have that column."""
    kept = "stored" if stored else None
    lines = table(spark, d, "lineitem") if lines is None else lines
    lines = lines.withColumn("line", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    leaf = hashtree.Level("line", lines, LINE, "line", "l_orderkey", kept)
    orders = hashtree.Level("order", table(spark, d, "orders"), ORDER, "o_orderkey", "o_custkey", kept, (leaf,))
    customers = hashtree.Level("customer", table(spark, d, "customer"), CUSTOMER, "c_custkey", "c_nationkey", kept, (orders,))
    return hashtree.Level("nation", table(spark, d, "nation"), ("n_name",), "n_nationkey", None, kept, (customers,))


@query(f"""WITH l AS (SELECT l_orderkey AS p, {_lanes_sql("sha256(x)")} AS s FROM (SELECT l_orderkey, {line_text()} AS x FROM lineitem) GROUP BY 1),
o AS (SELECT o_custkey AS p, sha256({_own_sql(o_orderstatus="o_orderstatus", o_orderpriority="o_orderpriority")} || '|line=' || coalesce(s, '0:0:0:0:0')) AS f FROM orders LEFT JOIN l ON p = o_orderkey),
os AS (SELECT p, {_lanes_sql("f")} AS s FROM o GROUP BY 1),
c AS (SELECT c_nationkey AS p, sha256({_own_sql(c_name="c_name", c_mktsegment="c_mktsegment")} || '|order=' || coalesce(s, '0:0:0:0:0')) AS f FROM customer LEFT JOIN os ON p = c_custkey),
cs AS (SELECT p, {_lanes_sql("f")} AS s FROM c GROUP BY 1)
SELECT n_nationkey AS id, sha256({_own_sql(n_name="n_name")} || '|customer=' || coalesce(s, '0:0:0:0:0')) AS fingerprint FROM nation LEFT JOIN cs ON p = n_nationkey""")
def fact_fingerprints(spark, d):
    """A fingerprint for each nation over all that hangs from it."""
    return hashtree.fingerprints(facts(spark, d))


FAULTY = "l_orderkey % 97 = 5 AND l_partkey % 3 = 0"


@query(f"""WITH f AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE {FAULTY}), t AS (SELECT DISTINCT o_orderkey, c_custkey, c_nationkey, f.l_linenumber FROM f
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT 'line' AS level, 'own' AS cause, CAST(c_nationkey AS VARCHAR) AS root, o_orderkey || '-' || l_linenumber AS id, c_nationkey || '/' || c_custkey || '/' || o_orderkey || '/' || o_orderkey || '-' || l_linenumber AS path FROM t
UNION SELECT 'order', 'below', CAST(c_nationkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), c_nationkey || '/' || c_custkey || '/' || o_orderkey FROM t
UNION SELECT 'customer', 'below', CAST(c_nationkey AS VARCHAR), CAST(c_custkey AS VARCHAR), c_nationkey || '/' || c_custkey FROM t
UNION SELECT 'nation', 'below', CAST(c_nationkey AS VARCHAR), CAST(c_nationkey AS VARCHAR), CAST(c_nationkey AS VARCHAR) FROM t""")
def fact_faults(spark, d):
    """Lines that were changed after all fingerprints were kept are found from their nations: every record on the way says that the fault is below it."""
    whole = facts(spark, d)
    kept = hashtree.prints(whole)
    with_kept = lambda t, key, name: t.join(kept[name].select(F.col("id").alias("_id"), F.col("deep").alias("stored")).dropDuplicates(["_id"]), F.col(key) == F.col("_id")).drop("_id")
    own = F.sha2(hashtree.own_text(LINE), 256)
    lines = table(spark, d, "lineitem").withColumn("stored", own).withColumn("l_suppkey", F.when(F.expr(FAULTY), F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey")))
    root = facts(spark, d, lines, stored=True)
    customers, orders = root.children[0], root.children[0].children[0]
    orders = dataclasses.replace(orders, table=with_kept(orders.table, "o_orderkey", "order"))
    customers = dataclasses.replace(customers, table=with_kept(customers.table, "c_custkey", "customer"), children=(orders,))
    root = dataclasses.replace(root, table=with_kept(root.table, "n_nationkey", "nation"), children=(customers,))
    return hashtree.faults(root).where("cause <> 'orphan'").select("level", "cause", "root", "id", "path").distinct()


@query(f"""SELECT source, count(*) AS n, sha256({_lanes_sql("sha256(x)")}) AS digest FROM (SELECT source, {_own_sql(doc_id="doc_id", lang="lang", text="text")} AS x FROM documents) GROUP BY 1""")
def source_manifest(spark, d):
    """What each source holds, from the manifests of three batches."""
    docs = table(spark, d, "documents")
    parts = [hashtree.manifest(docs.where(F.pmod("doc_id", F.lit(3)) == k), ["doc_id", "lang", "text"], "source").drop("digest") for k in range(3)]
    return hashtree.with_digest(hashtree.merged(rules.union(parts), "source")).select("source", "n", "digest")
