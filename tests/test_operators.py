"""Text functions, segments, sources, adapters, ledgers and streams on small fixtures."""

import base64
import hashlib
import io
import json
import random
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from tarnwick.functions import fingerprint as P
from tarnwick.functions import text as X
from tarnwick.operators import corpus, graph, ledger, recall, rules, search
from tarnwick.sources import adapters, files


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, "﻿a\r\n  b \t c \r\n\n\n\nd  ", X.normalize_text) == "a\nb c\n\nd"
    assert one(spark, "x &amp;lt; &#65;&#x1F600; &nope; &nbsp;y &", X.decode_entities) == "x &lt; A\U0001f600 &nope;  y &"
    assert one(spark, "<p>a</p><script>var t='</p>'</script><!-- x --><br>b", X.strip_markup).split() == ["a", "b"]
    assert one(spark, "Jon's co-op 3.5 d’or café", X.words) == ["jon's", "co-op", "3.5", "d’or", "café"]
    assert one(spark, "Jon's snow_drift", X.tokens) == ["jon", "s", "snow", "drift"]
    assert one(spark, "ＡＢ", X.normalize_term) == "ab" and one(spark, "Café", X.fold_term) == "cafe"
    assert [one(spark, h, X.heading_line) for h in ("Chapter 1", "THE NORTH", "THE END.", "the north", "AB")] == [True, True, False, False, False]
    assert one(spark, "THE NORTH", X.title_case) == "The North"
    assert one(spark, "Élan  vital!", X.slug) == "elan-vital" and one(spark, "!!", X.slug) == "edition"
    assert [one(spark, u, X.safe_relative) for u in ("a/b", "/a", "a/../b", "http:x", "a\\b")] == [True, False, False, False, False]
    assert one(spark, [2012, 5], X.date_parts, "array<int>") == "2012-05-01"
    assert one(spark, "a@b.org", X.private_contact) and not one(spark, "a at b", X.private_contact)


def test_fingerprints(spark):
    def fnv(s):
        h = 2166136261
        raw = s.encode("utf-16-be") + b"\0\x1f"
        for u in (int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)):
            h = ((h ^ u) * 16777619) & 0xFFFFFFFF
        return f"fnv1a32:{h:08x}"

    for s in ("abc", "é😀"):
        assert one(spark, s, P.fnv1a32) == fnv(s)
    assert one(spark, "x", P.digest) == "sha256:" + hashlib.sha256(b"x").hexdigest()
    assert one(spark, b"x", P.git_blob_sha1, "binary") == hashlib.sha1(b"blob 1\0x").hexdigest()
    assert one(spark, '{"b":1,"a":[2]}', P.canonical_json) == '{"a":[2],"b":1}'


def test_segments_and_units(spark):
    docs = spark.createDataFrame([(1, "  One two.\n\nThree\nfour.\n\n\n\nFive"), (2, None), (3, "")], "doc_id long, text string")
    rows = corpus.segments(docs).orderBy("start_char").collect()
    text = docs.first().text
    assert [r.segment for r in rows] == ["One two.", "Three\nfour.", "Five"]
    assert all(text[r.start_char : r.end_char] == r.segment for r in rows)
    book = spark.createDataFrame([(1, "intro\nCHAPTER ONE\na b\nCHAPTER TWO\nc"), (2, "just text")], "doc_id long, text string")
    assert [(r.doc_id, r.label, r.text) for r in corpus.plain_text_units(book).orderBy("doc_id", "unit_order").collect()] == [
        (1, "Front Matter", "intro"), (1, "CHAPTER ONE", "a b"), (1, "CHAPTER TWO", "c"), (2, "Document", "just text"),
    ]


def indexed(spark, at, rows, kind):
    return search.build_index(spark.createDataFrame(rows, "doc_id long, source string, text string"), str(at / kind), kind)


def test_search_modes(spark, tmp_path):
    rows = [(1, "a", "red wolf red"), (2, "b", "wolf red"), (3, "b", "blue fox"), (4, "a", None)]
    words, folded = (indexed(spark, tmp_path, rows, k) for k in search.KINDS)
    ids = lambda mode, q="red wolf", **k: [r.doc_id for r in search.tfidf(words, q, mode, **k).collect()]
    assert set(ids("any", "red fox")) == {1, 2, 3} and ids("all") == [1, 2] and ids("phrase") == [1] and ids("phrase", "wolf blue") == []
    assert ids("any", "red", filters=F.col("source") == "b") == [2] and ids("any", "nothing") == []
    for ask in (lambda: search.tfidf(words, "!!"), lambda: search.bm25(folded, "!!"), lambda: search.bm25(folded, "red", "some")):
        with pytest.raises(ValueError):
            ask()
    assert [r.doc_id for r in search.bm25(folded, "red wolf", "phrase").collect()] == [1]
    assert words.stats.first() == (4, 1.75) and words.documents.columns == ["doc_id", "source"]


def test_search_folding(spark, tmp_path):
    rows = [(1, "a", "le cafe blanc"), (2, "a", "Le CAFÉ noir"), (3, "a", "Le cafe\u0301 bon"), (4, "a", "I don't know"), (5, "a", "t don"), (6, "a", "snow_drift"), (7, "a", "a ﬁne １２ day"), (8, "a", "Jon's co-op")]
    words, folded = (indexed(spark, tmp_path, rows, k) for k in search.KINDS)
    ask = lambda q, mode="any": {r.doc_id for r in search.bm25(folded, q, mode).collect()}
    assert ask("cafe") == ask("CAFÉ") == ask("cafe\u0301") == {1, 2, 3}
    # a word that falls into two terms is a phrase, and one without terms is met nowhere
    assert ask("don't") == {4} and ask("don t", "all") == {4, 5} and ask("snow drift", "all") == ask("snow_drift") == {6}
    assert ask("_ cafe", "all") == set() and ask("_ cafe") == {1, 2, 3}
    rank = lambda q: search.bm25(folded, q).first().rank
    assert abs(rank("snow snow") - 2 * rank("snow")) < 1e-5
    ask = lambda q: {r.doc_id for r in search.tfidf(words, q, "any").collect()}
    assert ask("fine") == {7} and ask("12") == {7} and ask("jon's") == {8} and ask("co") == set() and ask("café") == {2}


def test_offsets(spark):
    text = "  Jon's 😀 co-op, İx ﬁne; Jon's"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    rows = search.postings(docs).collect()
    assert {r.doc_id for r in rows} == {1} and {r.term for r in rows} == {"jon's", "co-op", "i̇x", "fine"}
    for r in rows:
        said = [text[a:b] for a, b in zip(r.starts, r.ends)]
        assert all(unicodedata.normalize("NFKC", x).lower() == r.term for x in said) and len(said) == r.tf == len(r.positions)
    assert search.tfidf(search.Index(search.postings(docs), search.term_dictionary(docs), docs.drop("text"), spark.sql("SELECT 3 AS n_docs, 1.7 AS avg_len")), "co-op").first().first_char == text.index("co-op")


def test_fold_equals_full_decomposition(spark):
    every = "".join(chr(i) for i in range(1, 0x2000) if unicodedata.category(chr(i)) in ("Ll", "Lu", "Lt"))
    rows = spark.createDataFrame([(c,) for c in every], "c string")
    bad = rows.where(X.fold(F.col("c")) != X.fold_term(F.col("c"))).collect()
    # where lower case itself takes two characters the marks go in either
    assert not bad


def test_phrase_hits(spark, tmp_path):
    r = random.Random(2)
    texts = [[r.choice("abcd") for _ in range(r.randrange(1, 30))] for _ in range(40)]
    index = indexed(spark, tmp_path, [(i, "s", " ".join(t)) for i, t in enumerate(texts)], "folded")
    units = [list(u) for u in ("a", "ab", "aba", "dcb", "aa", "abcdabcd", "x", "ax")]
    got = {(x.unit, x.doc_id): x.tf for x in search.phrase_hits(index, spark.createDataFrame([("".join(u), u) for u in units], "unit string, terms array<string>")).collect()}
    count = lambda t, u: sum(t[i : i + len(u)] == u for i in range(len(t)))
    assert got == {("".join(u), i): n for u in units for i, t in enumerate(texts) if (n := count(t, u))}


def test_route_units(spark):
    none, keys = F.array().cast("array<string>"), F.array(*map(F.lit, ("recall-x", "red-wolf", "the", "moon")))
    of = lambda *a: [list(u) for u in spark.range(1).select(corpus.route_units(*a)).first()[0]]
    assert of(F.lit("rule"), F.lit("x y"), keys) == [["red", "wolf"]] and of(F.lit("event"), F.lit("xx"), keys) == [["red", "wolf"], ["moon"]]
    assert of(F.lit("event"), F.lit("white hart"), none) == [["white", "hart"]] and of(F.lit("question"), F.lit("don't"), keys) == [["don", "t"]]
    assert of(F.lit("entity"), F.lit("label"), keys, F.lit("Jon Snow")) == [["jon", "snow"]] and of(F.lit("question"), F.lit("the"), keys) == [["red"], ["wolf"], ["moon"]]
    assert of(F.lit("relation"), F.lit("said"), none, None, F.array(F.lit("a-bc"), F.lit("de"))) == [["bc"], ["de"]]


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("a", "c", 9.0), ("x", "y", 1.0)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(n,) for n in "abcxyz"], "node string")
    assert {(r.start, r.node) for r in graph.closure(e, nodes.where("node = 'a'")).collect()} == {("a", n) for n in "abc"}
    assert {r.node for r in graph.cycle_nodes(e).collect()} == {"a", "b", "c"}
    assert {r.node: r.component for r in graph.components(e, nodes).collect()} == dict(zip("abcxyz", "aaaxxz", strict=True))
    assert {r.node: r.distance for r in graph.shortest(e, nodes.where("node = 'a'")).collect()} == {"a": 0, "b": 1, "c": 3}
    with pytest.raises(ValueError):
        graph.bounded_bfs(e, nodes, 4)


def test_work_order_and_reconciliation(spark):
    row = lambda i, dom, kind, conf, hints, keys: (i, dom, kind, i, "", conf, hints, keys, [])
    c = spark.createDataFrame(
        [row("c1", "core-entities", "entity", 900, ["H"], ["k1"]), row("c2", "plot", "entity", 700, [], ["k1"]), row("c3", "plot", "question", 400, ["H"], ["k9"])],
        "id string, domain string, kind string, label string, summary string, confidence_permille int, source_hints array<string>, reconciliation_keys array<string>, tags array<string>",
    )
    items, clusters = recall.work_order(c, ["H"], 1)
    assert [(r.candidate_id, r.priority) for r in items.collect()] == [("c1", 1000 + 300 + 200 + 90), ("c3", 1000 + 150 + 40), ("c2", 500 + 200 + 70)]
    assert sorted(r.candidate_ids for r in clusters.collect()) == [["c1", "c2"], ["c3"]]
    d = spark.createDataFrame([("d1", "confirm", "c1"), ("d2", "defer", "c3")], "decision_id string, action string, candidate_id string")
    work = c.select(F.col("id").alias("candidate_id"))
    ok = recall.reconcile(work, d, recall.twice_decided(d)).first()
    assert ok.passed and ok.coverage_permille == 666 and ok.resolved_permille == 333 and ok.confirm == 1 and ok.defer == 1
    assert {tuple(r) for r in recall.reconciled(work, d, recall.twice_decided(d)).collect()} == {("confirm", "c1"), ("defer", "c3")}
    twice = d.union(spark.createDataFrame([("d3", "reject", "c1")], d.schema))
    bad = recall.reconcile(work, twice, recall.twice_decided(twice)).first()
    assert not bad.passed and bad.coverage_permille == 0 and bad.confirm == 0
    assert recall.reconciled(work, twice, recall.twice_decided(twice)).count() == 0
    shape = spark.createDataFrame([("d1", "merge", ["c1"], ["e"], ["r"]), ("d2", "split", ["c1"], ["e", "f"], ["r", "s"]), ("d3", "drop", ["c1"], [], []), ("d4", "defer", ["c1"], ["e"], [])], "decision_id string, action string, candidate_ids array<string>, evidence_ids array<string>, promoted_ids array<string>")
    assert {r.subject for r in recall.action_shape(shape).collect()} == {"d1", "d3", "d4"}


def test_rules_order(spark):
    f = spark.createDataFrame([("b", "warning", "s1", ""), ("a", "error", "s2", ""), ("c", "error", "s1", "")], "code string, severity string, subject string, detail string")
    assert [r.code for r in rules.by_severity(f).collect()] == ["c", "a", "b"] and [r.code for r in rules.by_code(f).collect()] == ["a", "c", "b"]


def test_files(spark, tmp_path):
    p = tmp_path / "rows"
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "id string, n long")
    assert files.append_rows(rows, str(p), "id").count() == 2 and files.append_rows(rows, str(p), "id").count() == 0
    assert files.read_ndjson(spark, str(tmp_path / "none"), "id string", missing_ok=True).count() == 0
    (tmp_path / "bad.ndjson").write_text('{"id":"a"}\nnot json\n')
    with pytest.raises(Exception):  # noqa: B017
        files.read_ndjson(spark, str(tmp_path / "bad.ndjson"), "id string").collect()
    body = b"hello carrier"
    text = base64.b64encode(body).decode()
    parts = spark.createDataFrame([("x", 1, text[5:], len(body), hashlib.sha256(body).hexdigest()), ("x", 0, text[:5], len(body), hashlib.sha256(body).hexdigest())], "carrier string, ord int, chunk string, length long, sha256 string")
    assert files.carriers(parts).first().content == body
    assert not files.carriers(parts.withColumn("length", F.lit(3))).first().passed
    assert "<\\/b>" in files.html_atlas(spark.createDataFrame([("</b>",)], "t string"), "T")


def epub(names=("c1.xhtml", "c2.xhtml"), bad=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{k}" href="{n}"/>' for k, n in enumerate(names))
        refs = "".join(f'<itemref idref="i{k}"/>' for k in reversed(range(len(names))))
        z.writestr("o/p.opf", f'<package><manifest>{items}<item id="nav" properties="nav" href="nav.xhtml"/></manifest><spine>{refs}</spine></package>')
        z.writestr("o/nav.xhtml", '<nav><a href="c1.xhtml#x">First</a><a href="c1.xhtml">Other</a></nav>')
        for n in names:
            z.writestr(f"o/{n}", f"<html><h1>Head {n}</h1><p>text</p></html>")
        if bad:
            z.writestr("../evil", "x")
    return out.getvalue()


def test_editions(spark):
    rows = [("a.epub", epub()), ("b.epub", epub(bad=True)), ("c.html", b"<!doctype html><html><body>x"), ("d.txt", b"plain"), ("e", None)]
    got = files.read_editions(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert [(r.label, r.part) for r in got if r.path == "a.epub"] == [("Head c2.xhtml", "o/c2.xhtml"), ("First", "o/c1.xhtml")]
    assert {r.path: r.format for r in got} == {"a.epub": "epub", "b.epub": "epub", "c.html": "html", "d.txt": "plain-text", "e": "plain-text"}
    assert next(r.error for r in got if r.path == "b.epub")


PAYLOADS = {
    "sparql": {"results": {"bindings": [{"item": {"type": "uri", "value": "http://www.wikidata.org/entity/Q42"}, "itemLabel": {"type": "literal", "value": "Ann", "xml:lang": "en"}, "email": {"type": "literal", "value": "a@b.org"}}]}},
    "catalogue": {"docs": [{"key": "/works/OL1W", "title": "T", "author_name": ["A"], "first_publish_year": 1996, "description": "secret"}, {"title": "no key"}]},
    "works": {"message": {"items": [{"DOI": "10.1/AB", "title": ["W"], "author": [{"given": "G", "family": "F", "affiliation": [{"name": "x@y.org"}]}], "issued": {"date-parts": [[2012, 5]]}, "abstract": "secret"}]}},
    "wiki": {"query": {"pages": {"7": {"pageid": 7, "title": "P", "lastrevid": 3, "fullurl": "https://w.example/P", "links": [{"title": "B"}, {"title": "File:x.png"}, {"title": "A"}]}, "-1": {"title": "gone", "missing": ""}}}},
}


@pytest.mark.parametrize("name", sorted(PAYLOADS))
def test_adapters(spark, name):
    p = spark.createDataFrame([("r1", json.dumps(PAYLOADS[name])), ("r2", "not json"), ("r3", None)], "request_id string, payload string")
    good, bad = adapters.normalise(p, name)
    rows = good.collect()
    assert len(rows) == 1 and rows[0].request_id == "r1"
    f = json.loads(rows[0].fields)
    assert "secret" not in rows[0].fields and "a@b.org" not in rows[0].fields and "x@y.org" not in rows[0].fields and "File:" not in rows[0].fields
    check = {
        "sparql": lambda: rows[0].title == "Ann" and rows[0].canonical_uri.endswith("Q42") and f["variables"] == ["item", "itemLabel"],
        "catalogue": lambda: f["firstPublishYear"] == 1996 and f["authors"] == ["A"] and bad.first().rejection == "catalogue-identity",
        "works": lambda: rows[0].source_record_id == "doi:10.1/ab" and f["issued"] == "2012-05-01" and f["authors"][0]["family"] == "F",
        "wiki": lambda: f["links"] == ["A", "B"] and rows[0].canonical_uri == "https://w.example/P?oldid=3" and bad.count() == 1,
    }
    assert check[name]()


def test_record_limit(spark):
    docs = {"docs": [{"key": f"/works/{i}", "title": "t"} for i in range(5)]}
    good, bad = adapters.normalise(spark.createDataFrame([("r", json.dumps(docs))], "request_id string, payload string"), "catalogue", limit=2)
    assert good.count() == 2 and [r.rejection for r in bad.collect()] == ["record-limit"] * 3


def test_robots(spark):
    paths = spark.createDataFrame([(1, "bot", "/a/b"), (2, "bot", "/c"), (3, "x", "/a")], "path_id int, agent string, path string")
    r = spark.createDataFrame([("bot", "/a", False), ("bot", "/a/b", True), ("*", "/a", False), ("*", "/a", True)], "agent string, prefix string, allow boolean")
    assert {x.path_id: x.allowed for x in ledger.robots_allows(paths, r).collect()} == {1: True, 2: True, 3: True}


def test_materialise_and_clean_up(spark):
    from tarnwick import session

    session.clean_up(spark)
    df = session.materialise(spark.range(5))
    assert df.count() == 5 and session.clean_up(spark) == 1 and session.clean_up(spark) == 0


def test_postings_are_pruned_by_term(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "PER_BUCKET", 20)
    rows = [(i, "s", f"common w{i % 37} x{i % 11} tail{i % 5}") for i in range(300)] + [(300, "s", None), (301, "s", "")]
    built = search.build_index(spark.createDataFrame(rows, "doc_id long, source string, text string"), str(tmp_path / "i"), "folded")
    index = search.open_index(spark, str(tmp_path / "i"))
    assert index.of == built.of == 16 and index.postings.select("bucket").distinct().count() > 10
    assert index.postings.where(F.col("bucket") != search.bucket(F.col("term"), F.col("of"))).count() == 0
    one = search._of_terms(index, ["w3"])
    read = {f.split("bucket=")[1].split("/")[0] for f in one.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert len(read) == 1 and "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,w3)" in plan.replace("term#", "term")
    units = spark.createDataFrame([("w3 x3", ["w3", "x3"]), ("tail1", ["tail1"]), ("none", ["none", "w3"]), ("common w3", ["common", "w3"])], "unit string, terms array<string>")
    want = sorted((u, i) for u in ("w3 x3", "tail1", "common w3") for i, _, t in rows if t and f" {u} " in f" {t} ")
    monkeypatch.setattr(search, "FEW_TERMS", 1)  # by folders only
    by_folder = sorted((r.unit, r.doc_id) for r in search.phrase_hits(index, units).collect())
    monkeypatch.setattr(search, "FEW_TERMS", 200)
    assert sorted((r.unit, r.doc_id) for r in search.phrase_hits(index, units).collect()) == by_folder == want
    empty = search.build_index(index.documents.limit(0).withColumn("text", F.lit("")), str(tmp_path / "none"), "folded")
    assert empty.postings.count() == 0 and search.open_index(spark, str(tmp_path / "none")).documents.count() == 0
