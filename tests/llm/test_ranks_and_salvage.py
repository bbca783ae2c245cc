"""Ranks of long link chains, and what salvage finds inside members of many records."""

import random
import zlib
from urllib.parse import unquote

import duckdb
import pytest

from tarnwick.llm import queries, urls, warc


def test_ranks_of_a_long_chain_are_settled(spark):
    n = 16
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1) for i in range(n)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("h0", 1.0)], "host string, seed double")
    got = {r.host: r.score for r in urls.propagate(seeds, edges).collect()}
    want = {f"h{i}": 0.85**n if i == n else 0.15 * 0.85**i for i in range(n + 1)}
    assert all(abs(got[h] - x) < 1e-8 for h, x in want.items()) and len(got) == n + 1


def test_hosts_far_from_a_blocked_one(spark):
    chain = ["spam.net", *(f"h{i}.io" for i in range(1, 13))]
    pages = [(i, f"http://{h}/", f'<a href="http://{chain[i - 1]}/">l</a>' if i else "") for i, h in enumerate(chain)]
    pages += [(100 + i, f"http://calm{i}.io/", "") for i in range(47)]
    got = {r.host: r.verdict for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), (("net", "/", "block"),)).collect()}
    assert {got[h] for h in chain} == {"block"} and {v for h, v in got.items() if h not in chain} == {"allow"}


def ids(data):
    return [h["warc-record-id"][10:-1] if h else "gap" for _, _, h, _, _ in warc.salvage(data)]


PLAIN = [warc.page_record(i, f"http://a/{i}", random.Random(i).randbytes(400), None, False) for i in range(6)]


@pytest.mark.parametrize("i", [0, 3, 5])
def test_a_bad_record_in_a_member_of_many(i):
    bad = bytearray(PLAIN[i])
    bad[-20] ^= 1
    assert ids(warc.member(b"".join([*PLAIN[:i], bytes(bad), *PLAIN[i + 1 :]]))) == [str(k) if k != i else "gap" for k in range(6)]


def test_a_member_of_many_that_is_cut_short():
    whole = warc.member(b"".join(PLAIN))
    assert ids(whole[:-60]) == [*"01234", "gap"]
    assert ids(whole[:-60] + warc.member(PLAIN[5])) == [*"01234", "gap", "5"]


def test_a_hurt_member_of_many():
    hurt = bytearray(warc.member(b"".join(PLAIN)))
    hurt[len(hurt) * 2 // 3] ^= 255
    got = ids(bytes(hurt) + warc.member(PLAIN[5]))
    assert got[-2:] == ["gap", "5"] and got[:-2] == list("01234"[: len(got) - 2]) and len(got) > 3
    hurt = bytearray(warc.member(b"".join(PLAIN)))
    hurt[-8] ^= 1  # the checksum itself: no record fails, so nothing tells what is hurt
    assert ids(bytes(hurt)) == ["gap"]


def test_a_stored_member_gives_records_once():
    pack = zlib.compressobj(0, zlib.DEFLATED, 31)
    whole = pack.compress(b"".join(PLAIN)) + pack.flush()
    got = ids(whole[:-60])
    assert [x for x in got if x != "gap"] == list("01234") and "gap" in got


def test_a_very_long_url(spark):
    url = "http://a/" + "é" * 200_000
    pages = spark.createDataFrame([(1, url, "x")], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(warc.decide(pages))).where("kind <> 'warcinfo'").collect()
    assert [(r.kind, r.record_id, unquote(r.target_uri)) for r in got] == [("response", "<urn:page:1>", url)]


def test_url_sql_with_links(spark):
    """The registered SQL, whose ranks are summed as a series, against the iterated ranks on pages that link to one another."""
    r = random.Random(3)
    hosts = [f"h{i}.{r.choice(['io', 'net', 'org', 'example.net', 'example.com'])}" for i in range(24)]
    link = lambda: f"<A  class=x\n HREF = {r.choice(['', chr(34)])}{r.choice(['http:', 'https:', ''])}//{r.choice(hosts).upper()}/x?y#z>l</a><a href=/own>o</a>"
    pages = [(i, f"http://{r.choice(hosts)}/{r.choice(['fr/', 'en/', 'de/', 'x'])}", "".join(link() for _ in range(r.randrange(4)))) for i in range(120)]
    pages += [(200, None, None), (201, "no scheme", link()), (202, "http://x.net?y", ""), (203, "http://net/q", None), (204, "http://farm.io/", '<a href="http://net/">l</a>'), pages[0]]
    schema = "page_id long, url string, html string"
    got = sorted((x.page_id, x.host, x.path, x.rule or "", x.verdict) for x in urls.judge(spark.createDataFrame(pages, schema), queries.URL_RULES).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    want = sorted((i, h, p, rule or "", v) for i, h, p, rule, v in con.execute(queries.ORACLES["op7_url_filter"]).fetchall())
    assert got == want
    assert {v for *_, rule, v in got if not rule} == {"allow", "block"}
