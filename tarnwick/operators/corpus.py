"""Corpus operators: segments, units, census, evidence routes, concordance and lanes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwick.functions import text as X
from tarnwick.functions.fingerprint import digest
from tarnwick.operators import ranking, search
from tarnwick.session import materialise


def segments(docs: DataFrame, separator: str = "\n\n", key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Paragraphs: key, paragraph_index, start_char, end_char, segment (trimmed) and text_digest.

    One pass inside each row: no window or shuffle, however the rows are dealt.
    """
    text = F.coalesce("text", F.lit(""))
    parts = F.split(text, separator.replace("\n", r"\n"))
    # start of each part: lengths before it, folded once along the array
    step = lambda a, p: F.struct(
        (a["at"] + F.length(p) + len(separator)).alias("at"),
        F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), p.alias("p")))).alias("out"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,p:string>>").alias("out"))
    placed = F.aggregate(parts, zero, step, lambda a: a["out"])
    kept = F.filter(placed, lambda s: s["p"].rlike(r"\S"))
    rows = docs.select(*key, F.posexplode(kept).alias("paragraph_index", "_s"))
    lead = F.length(F.col("_s.p")) - F.length(F.regexp_replace("_s.p", r"^\s+", ""))
    body = F.regexp_replace("_s.p", r"^\s+|\s+$", "")
    start = (F.col("_s.at") + lead).cast("int")
    return rows.select(*key, "paragraph_index", start.alias("start_char"), (start + F.length(body)).alias("end_char"), body.alias("segment")).withColumn("text_digest", digest(F.col("segment")))


def plain_text_units(docs: DataFrame) -> DataFrame:
    """Units of plain texts (doc_id, text): between heading lines if there are two, else one `Document`."""
    lines = docs.select("doc_id", F.posexplode(F.split(X.normalize_text(F.coalesce("text", F.lit(""))), r"\n")).alias("line", "value"))
    lines = lines.withColumn("heading", X.heading_line(F.col("value")).cast("int"))
    doc = W.partitionBy("doc_id")
    lines = lines.withColumn("headings", F.sum("heading").over(doc))
    section = F.sum("heading").over(doc.orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    lines = lines.withColumn("section", F.when(F.col("headings") >= 2, section).otherwise(0))
    lines = lines.withColumn("is_head", (F.col("headings") >= 2) & (F.col("heading") == 1))
    body = F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("line", "value"))))
    units = lines.groupBy("doc_id", "section", "headings").agg(
        F.max(F.when(F.col("is_head"), F.trim("value"))).alias("head"),
        X.normalize_text(F.array_join(F.transform(body, lambda s: s["value"]), "\n")).alias("text"),
    )
    label = F.when(F.col("headings") < 2, "Document").when(F.col("section") == 0, "Front Matter").otherwise(F.col("head"))
    units = units.where("text <> ''").withColumn("label", label)
    order = F.row_number().over(doc.orderBy("section")) - 1
    return units.select("doc_id", order.alias("unit_order"), "label", "text", digest(F.col("text")).alias("text_digest"), X.word_count(F.col("text")).alias("word_count"))


def provenance_class(source: Column, publisher: Column, converted: Sequence[str] = (), collections: Sequence[str] = ()) -> Column:
    """Class of an edition by source id and publisher; `converted` and `collections` name the sources that have
    classes of their own: one whose publisher is a converter of files, and one that is a collection without publisher."""
    name = F.coalesce(publisher, F.lit(""))
    return (
        F.when(source.isin(list(converted)) & F.lower(name).contains("epub bud"), "holder-supplied-converted-edition")
        .when(source.isin(list(collections)) & (name == ""), "holder-supplied-collection-weak-bibliographic-metadata")
        .when(name != "", "holder-supplied-publisher-identified-edition")
        .otherwise("holder-supplied-edition")
    )


def census(rows: DataFrame, by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Counts and sums for each group and in total (group columns null)."""
    aggs = [F.count("*").alias("n"), *(F.sum(c).alias(name) for name, c in sums.items())]
    return rows.rollup(*by).agg(*aggs)


def heading_census(rows: DataFrame, source: str, heading: str) -> DataFrame:
    """How often each heading stands in a source, and over all sources (source null)."""
    return rows.groupingSets([[source, heading], [heading]], source, heading).agg(F.count("*").alias("n"))


def narrative_order(rows: DataFrame, source: str, heading: str, order: Sequence[str]) -> DataFrame:
    """Occurrence of each heading within its source, and place within the source; by ranges, so that a large source is sorted by many tasks."""
    return ranking.placed(ranking.placed(rows, [source, heading], order, "heading_occurrence"), [source], order, "chapter_order")


def global_order(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Place over all rows, in order of group (null first) and order columns, without one task for all or for a group."""
    return ranking.placed(rows, [], [group, *order], "global_order")


# Evidence routing: queries of several kinds against the corpus, five leads for each.

#: Kinds whose keys make the query, and kinds that are facts of a story (fixed values).
KEYED = ("event", "endpoint", "function", "knowledge", "state", "proposition", "decision", "event-chain")


def route_units(kind: Column, label: Column, keys: Column, display: Column | None = None, ids: Column | None = None) -> Column:
    """The phrases (array<array<string>>) that all have to be found for a candidate, by its kind."""
    none = F.array().cast("array<string>")
    whole = lambda c: F.regexp_extract_all(F.array_join(X.route_tokens(F.coalesce(c, F.lit(""))), " "), F.lit("[a-z0-9]+"), F.lit(0))
    keys, ids = F.coalesce(keys, none), F.coalesce(ids, none) if ids is not None else none
    named = F.filter(keys, lambda k: ~k.startswith("recall-") & ~k.startswith("conversation-"))
    said = F.array(whole(label))
    of_keys = lambda n: F.slice(F.filter(F.transform(named, whole), lambda u: F.size(u) > 0), 1, n)
    three, two = of_keys(3), F.filter(F.transform(F.slice(named, 1, 2), whole), lambda u: F.size(u) > 0)
    event = F.when(F.aggregate(three, F.lit(0), lambda n, u: n + F.size(u)) < 2, said).otherwise(three)
    relation = F.when(F.size(ids) >= 2, F.transform(F.slice(ids, 1, 3), whole)).otherwise(said)
    entity = F.array(whole(F.coalesce(F.nullif(display, F.lit("")), label) if display is not None else label))
    units = F.when(kind == "entity", entity).when(kind == "relation", relation).when(kind.isin(list(KEYED)), event)
    units = units.when((kind == "rule") & (F.size(named) > 0), two).otherwise(said)
    units = F.slice(F.filter(units, lambda u: F.size(u) > 0), 1, 3)
    # without any phrase, up to five words of the keys
    bare = F.slice(F.array_distinct(F.flatten(F.transform(keys, lambda k: X.route_tokens(k)))), 1, 5)
    return F.when(F.size(units) > 0, units).otherwise(F.transform(bare, lambda t: F.array(t)))


def fallback_units(label: Column, keys: Column) -> Column:
    """The words of which any may be found: of label and keys the first six of three letters or more, each once."""
    of_keys = F.flatten(F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: X.route_tokens(k)))
    words = F.filter(F.concat(X.route_tokens(F.coalesce(label, F.lit(""))), of_keys), lambda t: F.length(t) >= 3)
    return F.transform(F.slice(F.array_distinct(words), 1, 6), lambda t: F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0)))


def evidence_routes(candidates: DataFrame, index: search.Index, leads: int = 5, source: str = "source") -> DataFrame:
    """Leads (candidate_id, tier, doc_id, rank, place) for candidates (candidate_id, units, fallback, sources).

    Tier 0 has documents of the candidate's sources with all units, tier 1, asked only where tier 0
    found none, those with any fallback unit. A unit that several candidates have is looked up once.
    """
    asked = materialise(candidates.select("candidate_id", "units", "fallback", "sources"), "asked").where(F.size("sources") > 0)
    first = _leads(asked.select("candidate_id", "sources", F.array_distinct("units").alias("units")), index, True, leads, source)
    first = materialise(first, "leads")
    left = asked.join(first.select("candidate_id").distinct(), "candidate_id", "left_anti")
    second = _leads(left.select("candidate_id", "sources", F.array_distinct("fallback").alias("units")), index, False, leads, source)
    tier = lambda df, n: df.select("candidate_id", F.lit(n).alias("tier"), "doc_id", "rank", "place")
    return tier(first, 0).unionByName(tier(second, 1))


def _leads(asked: DataFrame, index: search.Index, every: bool, leads: int, source: str) -> DataFrame:
    each = asked.select("candidate_id", F.size("units").alias("of"), F.explode("units").alias("terms")).withColumn("unit", F.array_join("terms", " "))
    hits = search.phrase_hits(index, each.select("unit", "terms").distinct())
    hits = materialise(hits, "hits")
    met = hits.groupBy("unit").agg(F.count("*").alias("met"))
    part = search.okapi(F.col("tf"), F.col("len"), F.col("met"), F.col("n_docs"), F.col("avg_len"))
    scored = hits.join(met, "unit").join(F.broadcast(index.stats)).select("unit", "doc_id", part.alias("part"))  # stats is one row
    found = each.select("candidate_id", "of", "unit").join(scored, "unit")
    found = found.groupBy("candidate_id", "of", "doc_id").agg(F.sum("part").alias("rank"), F.count("*").alias("n"))
    found = found.where("n = of") if every else found
    found = found.join(asked.select("candidate_id", "sources"), "candidate_id").join(index.documents.select("doc_id", F.col(source).alias("_source")), "doc_id")
    found = found.where(F.array_contains("sources", F.col("_source"))).select("candidate_id", "doc_id", F.round("rank", 6).alias("rank"))
    place = F.row_number().over(W.partitionBy("candidate_id").orderBy("rank", "doc_id"))
    return found.withColumn("place", place).where(F.col("place") <= leads)


def evidence_status(candidates: DataFrame, routes: DataFrame, has_source: Column) -> DataFrame:
    """candidate_id, leads, status."""
    n = routes.groupBy("candidate_id").agg(F.count("*").alias("leads"))
    status = F.when(~has_source, "awaiting-uningested-source").when(F.col("leads") > 0, "evidence-leads-found").otherwise("no-lead-found")
    return candidates.join(n, "candidate_id", "left").select("candidate_id", F.coalesce("leads", F.lit(0)).cast("long").alias("leads"), status.alias("status"))


def concordance(entities: DataFrame, index: search.Index, source: str = "source") -> DataFrame:
    """For each entity and source the first alias that occurs: count of documents and first document.

    entities (entity_id, alias_order, alias); index of `folded` tokens with a column of sources.
    Aliases are phrases, and equal ones are looked up once.
    """
    terms = entities.select("entity_id", "alias_order", X.tokens(X.fold(F.col("alias"))).alias("terms")).where(F.size("terms") > 0)
    terms = terms.withColumn("unit", F.array_join("terms", " "))
    terms = materialise(terms, "aliases")
    hits = search.phrase_hits(index, terms.select("unit", "terms").distinct())
    hits = hits.join(index.documents.select("doc_id", F.col(source).alias("source")), "doc_id")
    of = hits.groupBy("unit", "source").agg(F.count("*").alias("occurrences"), F.min("doc_id").alias("first_doc_id"))
    by_alias = terms.select("entity_id", "alias_order", "unit").join(of, "unit")
    first = F.min_by(F.struct("alias_order", "occurrences", "first_doc_id"), "alias_order")
    return by_alias.groupBy("entity_id", "source").agg(first.alias("f")).select("entity_id", "source", "f.*")


# Lanes: questions dealt to lanes by phrases and words.


def lane_scores(questions: DataFrame, lanes: Sequence[tuple[str, Sequence[str]]], top: int = 6) -> DataFrame:
    """(question_id, lane, score) of the lanes that a question (question_id, text) goes to.

    A phrase that is contained scores 20 and one for each word, each word of the lane that is
    among the question's scores 1. Lanes from max(2, 35 % of the best) stay, six at most.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    q = questions.select("question_id", low.alias("text"), F.array_distinct(X.words(low)).alias("words"))
    scores = []
    for lane, phrases in lanes:
        score = F.lit(0)
        for p in phrases:
            score = score + F.when(F.col("text").contains(p.lower()), 20 + len(p.split())).otherwise(0)
        for w in sorted({w for p in phrases for w in p.lower().split()}):
            score = score + F.array_contains("words", w).cast("int")
        scores.append(F.struct(F.lit(lane).alias("lane"), score.alias("score")))
    # the lanes are literals of the plan, so no join is needed
    best = q.select("question_id", F.array(*scores).alias("s")).withColumn("best", F.array_max(F.transform("s", lambda x: x["score"])))
    least = F.greatest(F.lit(2), F.floor(F.col("best") * 0.35).cast("int"))
    kept = F.filter("s", lambda x: x["score"] >= least)
    ranked = F.array_sort(F.transform(kept, lambda x: F.struct((-x["score"]).alias("r"), x["lane"].alias("lane"))))
    return best.select("question_id", F.explode(F.slice(ranked, 1, top)).alias("x")).select("question_id", "x.lane", (-F.col("x.r")).alias("score"))
