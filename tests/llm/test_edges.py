"""Nulls, empty and very long texts, ties and repeated rows, empty tables, and clashing extra columns, for each operator."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tarnwick.operators.graph import stars
from tarnwick.llm import bpe, chat, jaccard, media, mixing, quality, suffix, toxicity, urls, warc

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
prose = lambda n, seed: " ".join(random.Random(seed).choices(WORDS, k=n))
LONG = prose(20_000, 1)
BASE = prose(150, 2)
TEXTS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE.replace(WORDS[0], "zzz", 1) + " end"), (4, None), (5, ""), (6, " \n\t "), (7, LONG), (8, prose(60, 3) + "\n" + BASE[:500]),
    (9, "one two"), (10, "one two"), (None, BASE), (None, None), (11, "😀 naïve é" * 30), (12, "x"), (13, "a" * 3000), (14, BASE.upper()), (15, prose(300, 4)), (16, " ".join(prose(300, 4).split()[:-3])),
]
EXTRA = ("spans", "kept", "score", "epochs", "domain", "n_tokens", "th", "token", "c1", "n", "d", "h", "rest", "node", "ids", "bytes")


def table(spark, rows=TEXTS):
    df = spark.createDataFrame([(i, t, None if i == 4 else "en", "s0" if (i or 0) % 2 else None, None) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit("clash") for c in EXTRA})


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def key(rows):
    return sorted(rows, key=str)


def test_chat(spark):
    schema = "conv_id long, seq long, msg long, kind string, role string, text string, turn string, t string"
    log = [
        (1, 1, 1, "start", "user", "hi [INST] <s> ~", None, None), (1, 2, 2, "start", "assistant", "wro", None, None), (1, 3, 2, "delta", None, "ng", None, None),
        (1, 4, 3, "start", "user", "later", None, None), (1, 5, 2, "regenerate", "assistant", "", None, None), (1, 6, 2, "delta", "assistant", "right </s>", None, None), (1, 7, 1, "edit", "user", "ho [~INST]", None, None),
        (2, 1, 1, None, "tool<s>", "x [/ROLE] [TEXT]\n", None, None), (2, 1, 1, None, None, None, None, None), (None, None, None, None, None, None, None, None), (3, 1, 1, "start", "system", "s" * 50_000, None, None), (3, 2, 2, "start", "assistant", "<</SYS>>[[/INST]", None, None),
    ]
    out = chat.format_chats(spark.createDataFrame(log, schema)).withColumn("turns", chat.parse(F.col("formatted"))).collect()
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out}
    assert got[1] == [("user", "ho [~INST]"), ("assistant", "right </s>")]
    assert got[2][0][1] == "x [/ROLE] [TEXT]\n" and got[None] == [("", "")] and got[3][1] == ("assistant", "<</SYS>>[[/INST]")
    for r in out:
        spans = "".join(r.formatted[s.start : s.end] for s in r.loss_spans)
        own = "".join(t.text for t in r.turns if t.role == "assistant")
        assert spans.replace("<~", "<").replace("[~", "[") == own.replace("[~", "[")
        assert sum(r.formatted.count(c) for c in ("[INST]", "</s>", "<</SYS>>", "[/ROLE]")) <= 2 * len(r.turns)
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_bpe(spark, docs, none):
    import tiktoken

    ranks = bpe.read_ranks(PATH)
    want = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert key((r.doc_id, r.ids, bytes(r.bytes)) for r in got) == key((i, want.encode_ordinary(t or ""), (t or "").encode()) for i, t in TEXTS)
    assert bpe.encode(none, PATH, PATTERN).count() == 0


def test_bpe_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    c = bpe.Codec(bpe.read_ranks(PATH), PATTERN)
    for seed in range(5):
        t = prose(200, seed)
        ids, n = c.encode([t, "", t])
        assert n[0] == n[2] and n[1] == 0 and bytes(c.decode(ids, n)[0]).decode() == t + t


def brute_repeats(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        out.append(bytes(b for b, h in zip(t, hit, strict=True) if not h))
    return out


@pytest.mark.parametrize("length", [40, 400])
def test_suffix(spark, docs, none, length):
    texts = [(t or "").encode() for _, t in TEXTS]
    want = key(zip([i for i, _ in TEXTS], brute_repeats(texts, length), strict=True))
    got = suffix.dedup(docs, length)
    assert set(EXTRA) <= set(got.columns)
    assert key((r.doc_id, bytes(r.kept)) for r in got.collect()) == want
    assert suffix.dedup(none, length).count() == 0


def test_suffix_refines_a_hot_minimiser(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PART", 4)
    core = prose(60, 9)
    rows = [(i, prose(20, 100 + i) + " " + core + " " + prose(20, 200 + i)) for i in range(30)]
    # some with surroundings in common, copies, and a text that repeats itself
    rows += [(40 + i, rows[i % 5][1][:150] + core + rows[i % 3][1][-90:]) for i in range(12)] + [(60, rows[0][1]), (61, "ab" * 300)]
    want = key(zip([i for i, _ in rows], brute_repeats([t.encode() for _, t in rows], 60), strict=True))
    ran = []
    whole = suffix.refined
    monkeypatch.setattr(suffix, "refined", lambda *a: ran.append(1) or whole(*a))
    got = suffix.dedup(table(spark, rows), 60).collect()
    assert key((r.doc_id, bytes(r.kept)) for r in got) == want and ran


def test_repeated_against_brute_force():
    r = random.Random(0)
    for _ in range(300):
        n, letters = r.randint(2, 12), "ab"[: r.randint(1, 2)] + "c" * r.randint(0, 1)
        strings = ["".join(r.choice(letters) for _ in range(r.randint(1, 40))).encode() for _ in range(r.randint(1, 6))]
        copies = [r.random() < 0.3 for _ in strings]
        count = Counter(s[i : i + n] for s, c in zip(strings, copies) for _ in range(1 + c) for i in range(len(s) - n + 1))
        for s, m in zip(strings, suffix.repeated(strings, n, copies), strict=True):
            assert [bool(x) for x in m[: max(0, len(s) - n + 1)]] == [count[s[i : i + n]] > 1 for i in range(len(s) - n + 1)]


def test_suffix_array():
    r = random.Random(1)
    for _ in range(100):
        s = np.array([r.randint(0, r.choice([1, 3, 200])) + 1 for _ in range(r.randint(1, 300))] + [0])
        sa, rank = suffix.suffix_array(s)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist()) and (rank[sa] == np.arange(len(s))).all()


def test_as_text(spark):
    raw = "aé😀z".encode()
    rows = [(raw[:i] + raw[j:],) for i in range(len(raw)) for j in range(i, len(raw))]
    for r in spark.createDataFrame(rows, "b binary").select("b", suffix.as_text(F.col("b")).alias("t")).collect():
        assert r.t == bytes(r.b).decode("utf-8", "ignore")


def test_media(spark, docs, none):
    got = media.read(media.store(docs)).collect()
    texts = [(i, media.pad((t or "").encode())) for i, t in TEXTS]
    assert key((r.doc_id, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == key((i, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])) for i, p in texts)
    assert all(r.clips and r.clips[0].start_s == 0 for r in got) and media.read(media.store(none)).count() == 0
    bad = spark.createDataFrame([(1, 1, None), (2, 2, b"RIFF"), (3, 3, b"x" * 50)], "doc_id long, n_bytes long, media binary")
    assert [r.payload_bytes for r in media.read(bad).collect()] == [None] * 3
    clips = media.clip_rows(media.read(media.store(docs))).collect()
    assert len(clips) == sum(len(r.clips) for r in got) and all(r.end_s > r.start_s and r.frames for r in clips)
    assert media.clip_rows(media.read(bad)).count() == 0


def brute_clips(payload):
    """Frames of each clip, from the bytes alone: coefficients, pixels, histograms and differences one by one."""
    import math

    import numpy as np

    wave = [[round(math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(1 / 8) if u == 0 else 0.5), 15) for u in range(8)] for x in range(8)]
    zigzag = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    basis = np.array([[round(wave[x][u] * wave[y][v] * 8192) for x in range(8) for y in range(8)] for u, v in zigzag])
    units = [payload[i : i + 64] for i in range(0, len(payload), 192)]
    each = min(len(units), 4) * min(-(-len(units) // 4), 2)
    histograms = []
    for i in range(0, len(units), each):
        bins = [0] * 32
        for unit in units[i : i + each]:
            values = np.array([b if b > 127 else b - 255 for b in unit]) @ basis
            for v in values.tolist():
                bins[max(0, min(255, (v + 4096 >> 13) + 128)) // 8] += 1
        bins = bins if len(units[i : i + each]) == each else None
        histograms.append(bins)
    return each, histograms


def test_media_cuts_on_a_table(spark):
    """Texts have many frames, and their clips are those of a plain rule over histograms counted one by one."""
    import numpy as np

    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [c.frames for c in r.clips] for r in media.read(media.store(rows)).collect()}
    several = 0
    for i, text in enumerate(texts):
        payload = media.pad(text.encode())
        each, bins = brute_clips(payload)
        video = media.decode_videos([r.media for r in media.store(rows.where(f"doc_id = {i}")).collect()])[0] if i < 5 else None
        if video:
            for h, b in zip(video["histograms"], bins, strict=True):
                assert b is None or np.allclose(h, np.array(b) / sum(b))
        if bins[-1] is None:
            continue  # the last frame is filled up by the encoder
        lengths, frames, recent = [], 1, []
        shares = [[x / sum(b) for x in b] for b in bins]
        for p, q in zip(shares, shares[1:], strict=False):
            d = sum(abs(x - y) for x, y in zip(p, q, strict=True)) / 2
            last = recent[-8:]
            mean = sum(last) / len(last) if last else 0
            limit = max(0.05, mean + 3 * (sum((x - mean) ** 2 for x in last) / len(last)) ** 0.5) if len(last) > 1 else 0.5
            if d > limit:
                lengths.append(frames)
                frames, recent = 1, []
            else:
                frames, recent = frames + 1, [*recent, d]
        assert got[i] == [*lengths, frames]
        several += bool(lengths)
    assert sum(len(x) > 1 for x in got.values()) > 3


def test_media_shots_and_general_jpeg():
    import numpy as np

    flat = lambda v: np.full((128, 192), v, np.uint8).tobytes()
    payload = b"".join([flat(130)] * 6 + [flat(200)] * 6)
    c, r, f = media.grid(len(payload) // 192)
    video = media.decode_videos([media.write_avi(media.encode_frames([payload])[0], 8 * c, 8 * r, f"payload={len(payload)}")])[0]
    assert media.payload_of(video) == payload and f == 192
    assert [x["frames"] for x in media.clips_of(video)] == [96, 96]
    # a scan with other codes, no restart marks, end-of-block and a zero run
    bits = "0" + "0" + "10" + "110"  # DC size 0; AC size 1 after 0 zeros, bit; run of 15 zeros is unused here
    spec_dc, spec_ac = bytes([1] + [0] * 15) + b"\0", bytes([0, 2] + [0] * 14) + b"\1\0"
    stream = "0" + "00" + "1" + "01" + "0" + "01"  # block 1: DC 0, AC 1 = +1, end; block 2: DC 0, end
    raw = int(stream.ljust(16, "1"), 2).to_bytes(2, "big")
    out = media.decode_scans([raw], [2], 0, ((0, spec_dc, spec_ac),))[0]
    assert out[0, 0, 1] == 1 and out[0].sum() == 1 and out[1].sum() == 0 and bits


def test_mixing(spark, docs, none):
    words = F.size(quality.words_of(F.coalesce("text", F.lit(""))))
    out = mixing.mix(docs, words, F.col("source"), epochs=2, power=0.5).collect()
    assert len(out) == len(TEXTS) and {r.domain for r in out} == {"", "s0"} and all(0 <= r.epochs <= 3 for r in out)
    assert mixing.mix(none, words, F.col("source")).count() == 0


def test_budgets_redistribute(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 100), ("a", "x", "2", 10), ("a", "y", "1", 5), ("b", "x", "1", 1000)], "domain string, lang string, source string, tokens long")
    weights = spark.createDataFrame([("a", None, None, 3.0), ("b", None, None, 1.0), ("a", "x", None, 1.0), ("a", "y", None, 1.0), ("a", "x", "1", 1.0), ("a", "x", "2", 1.0)], "domain string, lang string, source string, weight double")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, 120, 2, weights=weights).collect()}
    # a gets 90: y can take 10 of its 45, x the other 80; of these source 2 takes 20, source 1 the other 60
    assert got == {("a", "x", "1"): 60, ("a", "x", "2"): 20, ("a", "y", "1"): 10, ("b", "x", "1"): 30}
    none = spark.createDataFrame([("a", None, None, 0.0), ("b", None, None, 1.0), ("c", None, None, 1.0)], "domain string, lang string, source string, weight double")
    three = spark.createDataFrame([("a", "x", "1", 50), ("b", "x", "1", 5), ("c", "x", "1", 500)], "domain string, lang string, source string, tokens long")
    # what has no weight leaves its share to others, and a full sibling's shortage goes on
    assert {r.domain: r.budget for r in mixing.budgets(three, 100, 2, weights=none).collect()} == {"a": 0, "b": 10, "c": 90}
    big = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, 1000, 2, weights=weights).collect()}
    assert big[("a", "x", "1")] == 200 and big[("b", "x", "1")] == 770


def test_prefix_against_brute_force(spark):
    rows = [(i, prose(5 + i % 7, i)) for i in range(300)]
    out = mixing.mix(table(spark, rows), F.size(quality.words_of(F.col("text"))), F.lit("d"), share=0.4).collect()
    leaves = spark.createDataFrame([(r.lang or "", r.source or "", r.n_tokens) for r in out], "lang string, source string, tokens long").withColumn("domain", F.lit("d"))
    budget = {(r.lang, r.source): r.budget for r in mixing.budgets(leaves, 0.4 * sum(r.n_tokens for r in out), 2).collect()}
    by_leaf = defaultdict(list)
    for r in out:
        by_leaf[r.lang, r.source].append(r)
    for own in (x for x in by_leaf.values() if len(x) > 1):
        order = sorted(own, key=lambda r: hashlib.md5(f"17/0/{r.doc_id}".encode()).hexdigest())
        taken = [r.epochs for r in order]
        assert taken == sorted(taken, reverse=True) and set(taken) == {0, 1}
        # it meets the leaf's budget: the next document would be beyond it
        k = sum(taken)
        of = budget[own[0].lang or "", own[0].source or ""]
        assert sum(r.n_tokens for r in order[:k]) <= of < sum(r.n_tokens for r in order[: k + 1])


def test_warc(spark):
    pages = [(1, "http://a/é \r\n", "x"), (2, None, "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (None, "u", "x"), (None, "v", "only"), (5, "u", "y" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("key", "original", "revisit", "archive")})
    got = warc.read_archives(warc.write_archives(warc.decide(df), 1000)).where("kind <> 'warcinfo'").collect()
    assert len(got) == len(pages) and not [r for r in got if r.kind == "gap"]
    kinds = Counter((r.record_id, r.kind, r.refers_to) for r in got)
    assert kinds[("<urn:page:2>", "response", None)] == 2 and kinds[("<urn:page:1>", "revisit", "<urn:page:2>")] == 1 and kinds[("<urn:page:>", "revisit", "<urn:page:2>")] == 1
    sha = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    assert Counter((r.payload_bytes, r.payload_digest) for r in got) == Counter((len((h or "").encode()), sha(h)) for _, _, h in pages)
    assert warc.write_archives(warc.decide(df.limit(0))).count() == 0


def test_warc_salvage(spark):
    plain = [warc.page_record(i, f"http://a/{i}", b"<p>%d</p>" % i * 40, None, False) for i in range(8)]
    packed = [warc.member(r) for r in plain]

    def ids(data):
        out = list(warc.salvage(data))
        assert sum(n for _, n, h, _, _ in out) == len(data)
        return [h["warc-record-id"][10:-1] if h else "gap" for _, _, h, _, _ in out]

    assert ids(b"".join(packed)) == list("01234567") and ids(b"") == []
    for i in (0, 3, 7):
        hurt = bytearray(packed[i])
        hurt[len(hurt) // 2] ^= 255
        want = [str(k) if k != i else "gap" for k in range(8)]
        assert ids(b"".join([*packed[:i], bytes(hurt), *packed[i + 1 :]])) == want
        bad = bytearray(plain[i])
        bad[-20] ^= 1
        assert ids(b"".join([*plain[:i], bytes(bad), *plain[i + 1 :]])) == want
    assert ids(b"junk" + plain[0] + b"more junk" + packed[1]) == ["gap", "0", "gap", "1"]
    assert ids(b"".join(packed)[:-10])[-1] == "gap"
    rows = warc.read_archives(spark.createDataFrame([("a", b"junk" + plain[0]), ("b", None), ("c", b"")], "path string, content binary")).collect()
    assert [(r.kind, r.offset, r.length) for r in rows][0] == ("gap", 0, 4) and len(rows) == 2


RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def test_warc_time_is_linear():
    import time

    one = warc.member(warc.page_record(1, "http://a/", random.Random(1).randbytes(2000), None, False))
    took = []
    for n in (2000, 8000):
        data, began = one * n, time.perf_counter()
        assert sum(1 for _ in warc.salvage(data)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 9 * took[0]


def test_urls_rules(spark):
    rows = [
        ("http://A.Example.NET/en/x", "a.example.net", "/en/x", "example.net/en/", "allow"), ("http://net/q", "net", "/q", "net/", "block"), ("https://fonet/x", "fonet", "/x", None, "allow"),
        ("http://x.org/fr/?a#b", "x.org", "/fr/", "org/fr/", "allow"), ("http://b.example.com/de", "b.example.com", "/de", None, "allow"), ("http://x.net?y", "x.net", "", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://İ.net/", "İ.net", "/", "net/", "block"),
    ]
    pages = spark.createDataFrame([(i, r[0], None) for i, r in enumerate(rows)], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "src", "bad", "hit")})
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge(pages, RULES).collect()}
    assert got == {i: r[1:4] for i, r in enumerate(rows)}
    assert urls.judge(pages.limit(0), RULES).count() == 0


def test_urls_propagation(spark):
    link = lambda *hosts: "".join(f'<a class=x href="http://{h}/">l</a>' for h in hosts)
    pages = [(1, "http://spam.net/", link("other.io")), (2, "http://farm.io/", link("spam.net")), (3, "http://good.example.net/en/", link("fine.io")), (4, "http://fine.io/", ""), (5, "http://other.io/", "")]
    got = {r.host: r.verdict for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()}
    assert got == {"spam.net": "block", "farm.io": "block", "good.example.net": "allow", "fine.io": "allow", "other.io": "allow"}


def test_propagate_against_brute_force(spark):
    r = random.Random(1)
    hosts = [f"h{i}" for i in range(12)]
    links = Counter((a, b) for a, b in ((r.choice(hosts[:9]), r.choice(hosts)) for _ in range(40)) if a != b)
    edges = spark.createDataFrame([(*k, n) for k, n in links.items()], "src string, dst string, n long")
    seeds = {"h0": 0.5, "h3": 0.25, "lone": 0.25}
    got = {x.host: x.score for x in urls.propagate(spark.createDataFrame(list(seeds.items()), "host string, seed double"), edges, 0.8, 7).collect()}
    rank, out = dict(seeds), Counter()
    for (a, _), n in links.items():
        out[a] += n
    for _ in range(7):
        new = defaultdict(float, {h: 0.2 * s for h, s in seeds.items()})
        for (a, b), n in links.items():
            new[b] += 0.8 * rank.get(a, 0) * n / out[a]
        for h in {*hosts, *seeds}:
            if not out[h]:
                new[h] += 0.8 * rank.get(h, 0)
        rank = new
    assert {h: round(s, 9) for h, s in got.items() if s} == {h: round(s, 9) for h, s in rank.items() if s} and abs(sum(got.values()) - 1) < 1e-9


def test_judge_against_brute_force(spark):
    """Seeds, both ranks, threshold and verdicts of a random graph, and of one without links."""
    for seed, links in ((1, 60), (2, 0)):
        r = random.Random(seed)
        hosts = [f"h{i}.{r.choice(['io', 'net', 'org'])}" for i in range(14)]
        pages = []
        for i in range(50):
            to = [r.choice(hosts) for _ in range(r.randrange(4) if links else 0)]
            pages.append((i, f"http://{r.choice(hosts)}/{r.choice(['fr/', 'x'])}", "".join(f'<a href="http://{h}/">l</a>' for h in to)))
        host = lambda u: u.split("/")[2]
        rule = lambda u: "block" if host(u).endswith("net") else "allow" if host(u).endswith("org") and u.split("/", 3)[3].startswith("fr/") else None
        count = Counter(host(u) for _, u, _ in pages)
        edges = Counter((host(u), d) for _, u, h in pages for d in __import__("re").findall(r'href="http://([^/]*)/', h) if d != host(u))

        def ranks(verdict, edges):
            own = Counter(host(u) for _, u, _ in pages if rule(u) == verdict)
            seeds = {h: n / own.total() for h, n in own.items()}
            names = set(seeds) | {x for e in edges for x in e}
            rank = {h: seeds.get(h, 0.0) for h in names}
            for _ in range(400):
                got = Counter()
                for h in names:
                    out = {d: n for (s, d), n in edges.items() if s == h} or {h: 1}
                    for d, n in out.items():
                        got[d] += rank[h] * n / sum(out.values())
                rank = {h: 0.15 * seeds.get(h, 0.0) + 0.85 * got[h] for h in names}
            return rank

        trust, distrust = ranks("allow", edges), ranks("block", {(d, s): n for (s, d), n in edges.items()})
        bad = {h for h, n in count.items() if distrust.get(h, 0) > trust.get(h, 0) + n / len(pages)}
        want = {i: rule(u) or ("block" if host(u) in bad else "allow") for i, u, _ in pages}
        rules = (("net", "/", "block"), ("org", "/fr/", "allow"))
        got = urls.judge(spark.createDataFrame([*pages, pages[0], (99, "http://z.io/" + "x" * 100_000, "<p>" * 100_000)], "page_id long, url string, html string").where("page_id < 99"), rules)
        rows = got.where("page_id > 0").collect()
        assert {x.page_id: x.verdict for x in rows} == {i: v for i, v in want.items() if i} and (not links or bad)


def test_urls_long_and_repeated(spark):
    rows = [(1, "http://z.net/" + "x" * 100_000, "<p>" * 100_000)] * 2 + [(2, "http://a.io/" + "y" * 100_000, None)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()
    assert sorted((r.page_id, len(r.path), r.verdict) for r in got) == [(1, 100_001, "block"), (1, 100_001, "block"), (2, 100_001, "allow")]


def test_quality(spark, docs, none):
    got = quality.judge(docs).collect()
    assert len(got) == len(TEXTS) and quality.judge(none).count() == 0
    by = {r.doc_id: r for r in got if r.doc_id}
    assert by[5].n_words == 0 and by[5].base_failed and by[6].n_words == 0 and by[7].n_words == 20_000 and by[4].base_failed
    lines = spark.createDataFrame([(1, "a b\n\na b\n \n \nc\ra b", "", "", 0)], DOCS)
    assert quality.judge(lines).first().n_dup_lines == 1


def test_quantiles_of_the_sketch(spark):
    r = random.Random(3)
    xs = [r.lognormvariate(0, 2) for _ in range(3000)] + [0.0] * 100
    df = spark.createDataFrame([("l", "s", x, None, None) for x in xs], "lang string, source string, m_symbols double, m_dup_lines double, m_word_chars double")
    halves = df.randomSplit([0.5, 0.5], 1)
    merged = quality.sketch(halves[0]).unionByName(quality.sketch(halves[1])).groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))
    q = quality.quantiles(merged, {"lo": 0.02, "q1": 0.25, "q3": 0.75, "hi": 0.99}).first()
    xs.sort()
    assert q.lo == 0 and all(abs(q[c] / xs[-(-int(p * (len(xs) - 1) * 1000) // 1000)] - 1) < 0.03 for c, p in (("q1", 0.25), ("q3", 0.75), ("hi", 0.99)))


def brute_components(rows, n, num, den):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for i, t in rows:
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))]
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())))
    part = {i: i for i, _ in sets if i is not None}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if None not in (i, j) and s and t and den * len(s & t) >= num * len(s | t):
                x, y = sorted((root(i), root(j)))
                part[y] = x
    return [(i, len(s), None if i is None else root(i)) for i, s in sets]


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 1, 2)])
def test_jaccard(spark, docs, none, n, num, den):
    got = jaccard.join(docs, n, num, den).collect()
    assert key(tuple(r) for r in got) == key(brute_components(TEXTS, n, num, den))
    assert jaccard.join(none, n, num, den).count() == 0


def test_jaccard_near_copies(spark, monkeypatch):
    """A family of near copies around a core, some of which only a chain links."""
    for name, value in {"COUNTED": 3000, "SPLIT": 20, "BATCH": 7}.items():
        monkeypatch.setattr(jaccard, name, value)
    core = prose(120, 11).split()
    rows = []
    for i in range(90):
        r = random.Random(i)
        own = list(core)
        for _ in range(r.randint(0, 5)):
            own[r.randrange(len(own))] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(own[: len(own) - r.randint(0, 6)])))
    rows += [(100 + i, " ".join(core[:40]) + " " + prose(200, 50 + i)) for i in range(20)]
    got = jaccard.join(table(spark, rows), 4, 85, 100).collect()
    assert key(tuple(r) for r in got) == key(brute_components(rows, 4, 85, 100))


def test_components(spark):
    r = random.Random(2)
    links = [(a, a + 1) for a in range(0, 60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(300, k) for k in range(301, 400)]
    part = {}
    for a, b in links:
        part.setdefault(a, {a}), part.setdefault(b, {b})
        if part[a] is not part[b]:
            part[a] |= part[b]
            for x in part[b]:
                part[x] = part[a]
    got = {x.node: x.component for x in stars(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {x: min(s) for x, s in part.items() if x != min(s)}


def test_toxicity(spark, docs, none):
    r = random.Random(8)
    rows = [(i, prose(40, i) + (f" vil{r.choice('abc')} rotten" if i % 3 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i, _ in rows] + [(1000, None, "x"), (None, 1, "x"), (0, 1, "x"), (0, 0, "x")], "doc_id long, toxic int, score string")
    out = toxicity.classify(table(spark, [*rows, *rows[:2], (999, None), (998, LONG)]), labels).collect()
    assert len(out) == len(rows) + 4 and all(0 <= x.score <= 1 for x in out)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out)
    assert all(x.predicted == int(x.doc_id % 3 == 0) for x in out if x.doc_id < 400)
    # a mention of a group does not move a score much
    w, b = toxicity.fit(toxicity.training_rows(table(spark, rows), labels))
    mention = spark.createDataFrame([(1, prose(40, 1)), (2, prose(40, 1) + " muslims and women")], "doc_id long, text string")
    s = [x.score for x in toxicity.score(mention, w, b).orderBy("doc_id").collect()]
    assert abs(s[0] - s[1]) < 0.05
    assert toxicity.classify(none, labels).count() == 0
    assert {x.score for x in toxicity.classify(docs, labels.limit(0)).collect()} == {0.0}


def test_fit_against_brute_force():
    """The same descent on dense matrices, row by row as the definition says."""
    r = random.Random(3)
    rows = []
    for i in range(120):
        own = sorted(r.sample(range(30), 8)) + ([30 + i % 2] if r.random() < 0.4 else [])
        y = int(len(set(own) & set(range(6))) + (2 if 30 in own else 0) > 2)
        swap = {30: 31, 31: 30}
        other = [swap.get(f, f) for f in own] if set(own) & set(swap) else [*own, 30]
        a, b = set(own), set(other)
        rows.append((y, *(np.array(sorted(x), np.int32) for x in (a, b - a, a - b))))
    y = np.array([x[0] for x in rows], float)
    own, plus, less = (np.zeros((len(rows), 40)) for _ in range(3))
    for i, row in enumerate(rows):
        for m, f in zip((own, plus, less), row[1:], strict=True):
            m[i, f] = 1
    seen = own.sum(0) + plus.sum(0) >= 4
    toxic, clean = own[y == 1].sum(0), own[y == 0].sum(0)
    ratio = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / ((1 - y).sum() + 1))
    scale = np.clip(np.abs(ratio) - 2 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)), 0, None) * seen
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for penalty in (0.0, 1.0, 30.0):
        p, m, v = np.zeros(41), np.zeros(41), np.zeros(41)
        for t in range(1, 81):
            w, b = p[:-1] * scale, p[-1]
            e = each * (1 / (1 + np.exp(-(own @ w + b))) - y)
            d = plus - less
            g = np.append(scale * (own.T @ e + 2 * penalty / len(y) * d.T @ (d @ w)) + 1e-3 * p[:-1], e.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            p = p - 0.1 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        got, bias = toxicity.fit(rows, penalty)
        assert np.allclose(got[:40], p[:-1] * scale, atol=1e-5) and abs(bias - p[-1]) < 1e-6


def false_alarms(spark, penalty):
    """Labelled sentences in which toxic ones name one group more often: which neutral mentions are called toxic."""
    r = random.Random(12)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        words = r.choices(WORDS, k=25) + (r.sample(["vile", "rotten", "scum", "filth", "stupid"], 1) if toxic and r.random() < 0.85 else [])
        words += ["muslims"] * (r.random() < (0.7 if toxic else 0.02)) + ["christians"] * (r.random() < (0.02 if toxic else 0.3))
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, labels = (spark.createDataFrame(x, c) for x, c in ((rows, "doc_id long, text string"), (labels, "doc_id long, toxic int")))
    w, b = toxicity.fit(toxicity.training_rows(docs, labels), penalty)
    neutral = [(i, " ".join(r.choices(WORDS, k=25) + ["muslims"])) for i in range(200)]
    bad = [(i, " ".join(r.choices(WORDS, k=25) + ["vile", "muslims"])) for i in range(200)]
    rate = lambda x: spark.createDataFrame(x, "doc_id long, text string").transform(toxicity.score, w, b).where("score >= 0.5").count() / len(x)
    return rate(neutral), rate(bad)


def test_counterfactuals_lower_false_alarms(spark):
    (before, found), (after, still) = false_alarms(spark, 0.0), false_alarms(spark, 3.0)
    assert before > 0.2 and after < before / 4 and found > 0.95 and still > 0.9, (before, after, found, still)


def test_fit_is_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, "b"), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert len(toxicity.training_rows(docs, labels, 1)) == 2


def test_counterfactuals():
    assert toxicity.counterfactual({"gay", "x"}) == {"straight", "x"}
    assert len(toxicity.counterfactual({"x"})) == 2
