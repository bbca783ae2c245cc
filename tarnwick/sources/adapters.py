"""JSON payloads of four public interfaces, normalised to records by whitelists.

Input: payloads (request_id, payload). Output of each: request_id, index, source_record_id,
record_type, title, canonical_uri, published_at, updated_at, fields (JSON), rejection (null, or why
there is no record). The schemas name what is kept, so nothing else is ever parsed: descriptions,
abstracts, affiliations and media links don't survive. Values that hold private contact data
reject the record.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwick.functions import text as X
from tarnwick.functions.fingerprint import content_id, digest


def _get(c: Column, *path: str) -> Column:
    """A field of a VARIANT as a string, null where it is absent or not a scalar."""
    v = F.try_variant_get(c, "$" + "".join(f"['{p}']" for p in path), "string")
    return F.nullif(F.trim(v), F.lit(""))


def _num(c: Column, *path: str) -> Column:
    return F.try_variant_get(c, "$" + "".join(f"['{p}']" for p in path), "double")


def _part(c: Column, *path: str) -> Column:
    return F.try_variant_get(c, "$" + "".join(f"['{p}']" for p in path), "variant")


def _list(c: Column) -> Column:
    """The elements of a VARIANT array, [] if it is none."""
    return F.coalesce(F.try_variant_get(c, "$", "array<variant>"), F.array().cast("array<variant>"))


def _strings(c: Column, *names: str) -> Column:
    """A list of strings under the first of names that is there; one string counts as a list."""
    out = F.lit(None).cast("array<string>")
    for n in reversed(names):
        many = F.try_variant_get(c, f"$['{n}']", "array<string>")
        one = F.try_variant_get(c, f"$['{n}']", "string")
        own = F.coalesce(many, F.when(one.isNotNull() & ~one.startswith("["), F.array(one)))
        out = F.coalesce(own, out)
    return F.filter(F.coalesce(out, F.array().cast("array<string>")), lambda s: s.isNotNull() & (F.trim(s) != ""))


def _records(rows: DataFrame, identity: Column, why: str, fields: Column, **cols: Column) -> DataFrame:
    """Rows (request_id, index, row) as records; those without identity or with contacts are rejected."""
    kept = F.to_json(fields)
    rejection = F.when(~F.coalesce(identity, F.lit(False)), f"{why}-identity").when(X.private_contact(kept), f"{why}-private-contact")
    rows = rows.withColumn("_f", kept).withColumn("rejection", rejection)
    fine = F.col("rejection").isNull()
    return rows.select(
        "request_id",
        "index",
        *(F.when(fine, c).alias(n) for n, c in cols.items()),
        F.when(fine, F.col("_f")).alias("fields"),
        F.when(fine, digest(F.col("_f"))).alias("normalized_digest"),
        "rejection",
    ).withColumn("record_id", F.when(F.col("rejection").isNull(), content_id("record", F.concat_ws("|", "source_record_id", "normalized_digest"))))


def _rows(payloads: DataFrame, items: Callable[[Column], Column]) -> DataFrame:
    v = payloads.select("request_id", F.try_parse_json("payload").alias("p"))
    return v.select("request_id", F.posexplode(items(F.col("p"))).alias("index", "row"))


def sparql_bindings(payloads: DataFrame) -> DataFrame:
    """Bindings: cells {type, value, datatype?, language?}; variables that name contacts go."""
    rows = _rows(payloads, lambda p: _list(_part(p, "results", "bindings")))
    cells = F.coalesce(F.try_variant_get("row", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    keep = F.map_filter(cells, lambda k, v: ~X.contact_key(k) & _get(v, "value").isNotNull())
    cell = lambda k, v: F.struct(F.coalesce(_get(v, "type"), F.lit("literal")).alias("type"), _get(v, "value").alias("value"), _get(v, "datatype").alias("datatype"), F.coalesce(_get(v, "xml:lang"), _get(v, "lang")).alias("language"))
    entries = F.array_sort(F.map_entries(F.transform_values(keep, cell)))
    rows = rows.withColumn("e", entries)
    uri = F.get(F.filter(F.transform("e", lambda e: e["value"]["value"]), lambda u: u.rlike(r"^https?://www\.wikidata\.org/entity/Q\d+$")), F.lit(0))
    qid = F.nullif(F.regexp_extract(uri, r"/entity/(Q\d+)$", 1), F.lit(""))
    label = F.get(F.transform(F.filter("e", lambda e: e["key"].rlike("(?i)label$")), lambda e: e["value"]["value"]), F.lit(0))
    rows = rows.withColumns({"uri": uri, "label": label}).withColumn("qid", F.nullif(F.regexp_extract("uri", r"/entity/(Q\d+)$", 1), F.lit("")))
    body = F.struct(F.map_from_entries("e").alias("binding"), F.transform("e", lambda e: e["key"]).alias("variables"))
    return _records(
        rows, F.size("e") > 0, "sparql-binding", body,
        source_record_id=F.concat_ws(":", F.lit("sparql"), F.coalesce("qid", F.lit("binding")), F.substring(F.sha2(F.to_json(F.map_from_entries("e")), 256), 1, 16)),
        record_type=F.lit("sparql-binding"), title=F.coalesce("label", "qid", F.concat(F.lit("binding "), (F.col("index") + 1).cast("string"))),
        canonical_uri=F.col("uri"), published_at=F.lit(None).cast("string"), updated_at=F.lit(None).cast("string"),
    )


def catalogue_records(payloads: DataFrame) -> DataFrame:
    """Book catalogue: docs, entries or works; at most 200 subjects."""
    rows = _rows(payloads, lambda p: F.coalesce(*(F.try_variant_get(p, f"$.{k}", "array<variant>") for k in ("docs", "entries", "works"))))
    r = F.col("row")
    key = F.coalesce(_get(r, "key"), F.get(_strings(r, "edition_key"), F.lit(0)))
    rows = rows.withColumn("key", F.when(key.startswith("/"), key).otherwise(F.concat(F.lit("/books/"), key))).withColumn("title", _get(r, "title"))
    modified = F.coalesce(_get(r, "last_modified", "value"), F.when(~_get(r, "last_modified").startswith("{"), _get(r, "last_modified")))
    body = F.struct(
        F.col("key"), F.col("title"), _get(r, "subtitle").alias("subtitle"), _strings(r, "author_name", "authors").alias("authors"), _strings(r, "author_key").alias("authorKeys"),
        _num(r, "first_publish_year").alias("firstPublishYear"), _strings(r, "publish_date").alias("publishDates"), _strings(r, "publisher", "publishers").alias("publishers"),
        _strings(r, "language", "languages").alias("languages"), F.slice(_strings(r, "subject", "subjects"), 1, 200).alias("subjects"), _strings(r, "isbn_10").alias("isbn10"), _strings(r, "isbn_13").alias("isbn13"),
        _strings(r, "isbn").alias("isbn"), _strings(r, "oclc").alias("oclc"), _strings(r, "lccn").alias("lccn"), _strings(r, "edition_key").alias("editionKeys"), _strings(r, "work_key").alias("workKeys"),
        F.coalesce(_num(r, "number_of_pages"), _num(r, "number_of_pages_median")).alias("numberOfPages"), _num(r, "revision").alias("revision"), modified.alias("lastModified"),
    )
    return _records(
        rows, F.col("key").isNotNull() & F.col("title").isNotNull(), "catalogue", body, source_record_id=F.concat(F.lit("catalogue:"), "key"), record_type=F.lit("bibliographic-record"),
        title=F.col("title"), canonical_uri=F.concat(F.lit("https://openlibrary.org"), "key"), published_at=F.get(_strings(r, "publish_date"), F.lit(0)), updated_at=modified,
    )


def _date(c: Column, *names: str) -> Column:
    return F.coalesce(*(X.date_parts(F.try_variant_get(c, f"$['{n}']['date-parts'][0]", "array<int>")) for n in names))


def _people(c: Column, name: str) -> Column:
    one = lambda a: F.struct(*(_get(a, k).alias(k) for k in ("given", "family", "name", "ORCID", "sequence")))
    some = lambda a: F.coalesce(a["given"], a["family"], a["name"], a["ORCID"], a["sequence"]).isNotNull()
    return F.filter(F.transform(_list(_part(c, name)), one), some)


def work_records(payloads: DataFrame) -> DataFrame:
    """Works metadata by DOI; abstracts and affiliations are not kept."""
    rows = _rows(payloads, lambda p: F.coalesce(F.try_variant_get(p, "$.message.items", "array<variant>"), F.array(F.coalesce(_part(p, "message"), p))))
    r = F.col("row")
    rows = rows.withColumn("doi", F.lower(_get(r, "DOI"))).withColumn("titles", _strings(r, "title")).withColumn("title", F.get("titles", F.lit(0)))
    published = _date(r, "published", "published-print", "published-online")
    licence = lambda x: F.struct(_get(x, "URL").alias("URL"), _get(x, "start").alias("start"), _num(x, "delay-in-days").alias("delayInDays"), _get(x, "content-version").alias("contentVersion"))
    body = F.struct(
        F.col("doi").alias("DOI"), _get(r, "type").alias("type"), F.col("titles").alias("title"), _strings(r, "subtitle").alias("subtitle"), _people(r, "author").alias("authors"), _people(r, "editor").alias("editors"),
        _strings(r, "container-title").alias("containerTitles"), _strings(r, "short-container-title").alias("shortContainerTitles"), _get(r, "publisher").alias("publisher"), published.alias("published"), _date(r, "issued").alias("issued"),
        _get(r, "created", "date-time").alias("created"), _get(r, "indexed", "date-time").alias("indexed"), _strings(r, "ISBN").alias("ISBN"), _strings(r, "ISSN").alias("ISSN"), _get(r, "URL").alias("URL"), _get(r, "language").alias("language"),
        _strings(r, "subject").alias("subject"), _num(r, "reference-count").alias("referenceCount"), _num(r, "is-referenced-by-count").alias("citedByCount"), F.transform(_list(_part(r, "license")), licence).alias("licenses"),
    )
    return _records(
        rows, F.col("doi").isNotNull() & F.col("title").isNotNull(), "work", body, source_record_id=F.concat(F.lit("doi:"), "doi"), record_type=F.lit("work-metadata"), title=F.col("title"),
        canonical_uri=F.concat(F.lit("https://doi.org/"), "doi"), published_at=published, updated_at=F.coalesce(_get(r, "indexed", "date-time"), _get(r, "created", "date-time")),
    )


def _titles(c: Column, name: str) -> Column:
    found = F.transform(_list(_part(c, name)), lambda t: _get(t, "title"))
    return F.array_sort(F.filter(found, lambda t: t.isNotNull() & ~t.startswith("File:")))


def wiki_pages(payloads: DataFrame, base: str = "https://wiki.example.org", include_text: bool = False, most: int = 20_000) -> DataFrame:
    """Wiki pages by id and revision; text only on request, up to `most` characters; at most 1000 links."""
    pages = lambda p: F.coalesce(F.try_variant_get(p, "$.query.pages", "array<variant>"), F.map_values(F.try_variant_get(p, "$.query.pages", "map<string,variant>")))
    rows = _rows(payloads, pages)
    r = F.col("row")
    revisions = _list(_part(r, "revisions"))
    last = F.coalesce(_num(r, "lastrevid"), _num(F.get(revisions, F.lit(0)), "revid"), F.lit(0.0)).cast("long")
    rows = rows.withColumns({"page": _num(r, "pageid").cast("long"), "title": _get(r, "title"), "rev": last})
    uri = F.coalesce(_get(r, "canonicalurl"), _get(r, "fullurl"), F.concat(F.lit(base + "/index.php?title="), F.url_encode(F.replace("title", F.lit(" "), F.lit("_")))))
    rows = rows.withColumn("uri", uri)
    rows = rows.withColumn("uri", F.when(F.col("rev") > 0, F.concat("uri", F.when(F.contains("uri", F.lit("?")), "&").otherwise("?"), F.lit("oldid="), F.col("rev").cast("string"))).otherwise(F.col("uri")))
    raw = F.transform(revisions, lambda v: F.coalesce(_get(v, "slots", "main", "content"), _get(v, "slots", "main", "*"), _get(v, "content"), _get(v, "*")))
    body_text = F.coalesce(F.get(F.filter(raw, lambda t: t.isNotNull()), F.lit(0)), _get(r, "extract"))
    clean = F.substring(F.trim(F.regexp_replace(X.strip_markup(body_text), r"\s+", " ")), 1, most)
    text = F.nullif(clean, F.lit("")) if include_text else F.lit(None).cast("string")
    meta = lambda v: F.struct(_num(v, "revid").cast("long").alias("revisionId"), _num(v, "parentid").cast("long").alias("parentId"), _get(v, "timestamp").alias("timestamp"))
    scalars = F.map_filter(F.coalesce(F.try_variant_get(r, "$.pageprops", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    body = F.struct(
        F.col("page").alias("pageId"), _num(r, "ns").cast("long").alias("namespace"), F.col("title"), _get(r, "touched").alias("touched"), F.col("rev").alias("lastRevision"), _num(r, "length").cast("long").alias("length"),
        scalars.alias("pageProperties"), _titles(r, "categories").alias("categories"), F.slice(_titles(r, "links"), 1, 1000).alias("links"), F.transform(revisions, meta).alias("revisionMetadata"), text.alias("text"), F.col("uri").alias("attributionUrl"),
    )
    there = F.col("page").isNotNull() & F.col("title").isNotNull() & F.try_variant_get(r, "$.missing", "string").isNull()
    return _records(
        rows, there, "wiki-page", body, source_record_id=F.concat(F.lit("wiki:page:"), F.col("page").cast("string"), F.lit(":revision:"), F.col("rev").cast("string")), record_type=F.lit("wiki-page"),
        title=F.col("title"), canonical_uri=F.col("uri"), published_at=F.lit(None).cast("string"), updated_at=F.coalesce(_get(r, "touched"), _get(F.get(revisions, F.lit(0)), "timestamp")),
    )


ADAPTERS: dict[str, Callable[..., DataFrame]] = {"sparql": sparql_bindings, "catalogue": catalogue_records, "works": work_records, "wiki": wiki_pages}


def normalise(payloads: DataFrame, adapter: str, limit: int = 500, **options) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) records of a known adapter; beyond `limit` accepted ones of a request the rest is rejected."""
    limit = max(1, min(int(limit), 500))
    out = ADAPTERS[adapter](payloads, **options)
    nth = F.row_number().over(W.partitionBy("request_id", F.col("rejection").isNull()).orderBy("index"))
    out = out.withColumn("rejection", F.when(F.col("rejection").isNull() & (nth > limit), "record-limit").otherwise(F.col("rejection")))
    return out.where("rejection IS NULL").drop("rejection"), out.where("rejection IS NOT NULL").select("request_id", "index", "rejection")
