"""Fill-in-middle, word BPE and tokenizer alignment against brute force, on odd texts and on a driver table."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from tarnwick.llm import alignment, fim, queries, word_bpe

DIR = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "\n", "a", "Ab", "é", "a é  b", "don't STOP's 'LL", "ΑΣ ΣΑΣ ΣΣ", "İstanbul ǅ ß ﬁ", "é ö ẛ̣", "日本語テキスト", "😀👍🏽 x", "a<P>b", "<S>", "x<M", "<", "<P", "a\x00b\x01 \x00", "▁x y▁",
    "\u08cf\u08ce \u1df7\u1df6x", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "<s> </s> <unk> <0x0A>", "x" * 5000, "aB1 " * 3000, "͸ Ᲊ Ɤ xᲉy", "a b　c d\x1ce\x85f", "\t\ttabs\r\nand  lines \n\n", "trailing ", "123 45,6.7", "ab" * 2000 + " " * 50 + "é" * 300,
]
WORDS = ["the", "The", "water", "wasser", "l'eau", "été", " ", "  ", "\n", "1984", "<M>", "…", "naïve", "ÅNGSTRÖM", "x_y", "don't", "日本", "!!", "\t"]


def texts():
    r = random.Random(5)
    return ODD + [" ".join(r.choices(WORDS, k=r.randrange(1, 60))) for _ in range(60)] + ["".join(r.choices(WORDS, k=r.randrange(1, 60))) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    """With further columns of names that the operators use inside, a repeated row and a null key."""
    rows = [(i, t, "k", "1", "a", "b", 3) for i, t in enumerate(texts())]
    rows += [rows[5], (None, "no key at all", *rows[0][2:])]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, draw0 string, a string, b string, n int").repartition(3)


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def fim_row(i, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = sha("1:" + ("" if i is None else str(i)))
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, text, text)
    if h4 % 100 < 20:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text)
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text)


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def test_fill_in_middle(spark, docs):
    out = fim.transform(docs)
    got = out.select(*out.columns, fim.restore(out["output"], out["form"]).alias("back")).collect()
    assert key(got) == key(fim_row(r.doc_id, r.text) for r in docs.collect())
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0


def test_unit_starts_and_ranks():
    r = random.Random(1)
    for text in [t for t in texts() if t]:
        raw = text.encode()
        places = [len(text[: m.start()].encode()) for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]
        bits = fim.unit_starts(raw)
        assert [i for i in range(len(raw)) if bits >> i & 1] == places
        ranks = sorted(r.choices(range(len(places)), k=5))
        assert fim.ranked(bits, len(raw), ranks) == [places[k] for k in ranks]
    with pytest.raises(ValueError):
        fim.transform(None, markers=("<P>", "<P>", "<M>"))
    with pytest.raises(ValueError):
        fim.transform(None, markers=("P", "<S>", "<M>"))


def test_fill_in_middle_of_a_long_text(spark):
    text = "lorem Ipsum 123 – dolor\n" * 200_000
    doc = spark.createDataFrame([(7, text)], "doc_id long, text string")
    assert [tuple(r) for r in fim.transform(doc).collect()] == [fim_row(7, text)[:6]]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


def test_word_bpe(spark, docs):
    path, own = P.path("word_bpe_49k.json"), library("word_bpe_49k.json")
    got = word_bpe.decode(word_bpe.encode(docs, path), path).collect()
    ids = lambda t: own.encode(t or "", add_special_tokens=False).ids
    assert key((r.doc_id, list(r.ids), r.decoded) for r in got) == key((r.doc_id, i := ids(r.text), own.decode(i, skip_special_tokens=False)) for r in docs.collect())
    assert word_bpe.encode(docs.limit(0), path).count() == 0
    odd = spark.createDataFrame([(1, [320, 10**6, 49407]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in word_bpe.decode(odd, path).collect()} == {1: own.decode([320, 49407], skip_special_tokens=False), 2: ""}


def test_word_bpe_of_every_code_point():
    own, mine = library("word_bpe_49k.json"), word_bpe.codec(P.path("word_bpe_49k.json"))
    lines = ["".join(f"{chr(c)}a {chr(c)}" for c in range(i, i + 64)) for i in range(0, 0x110000, 64) if not 0xD800 <= i < 0xE000]
    lines = [x for x in lines if any(c.isprintable() for c in x[:1])] + lines[::40]
    ids, counts = mine.encode(lines)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in own.encode_batch(lines, add_special_tokens=False)]


def test_word_bpe_queue_against_plain_merging():
    mine, r = word_bpe.codec(P.path("word_bpe_49k.json")), random.Random(2)
    for _ in range(300):
        symbols = [mine.inner[r.choice(b"aeinrst")] for _ in range(r.randrange(0, 40))]
        plain = list(symbols)
        while True:
            ranks = [(mine.ranks.get(a * mine.base + b, 1 << 30), i) for i, (a, b) in enumerate(zip(plain, plain[1:], strict=False))]
            if not ranks or min(ranks)[0] == 1 << 30:
                break
            rank, i = min(ranks)
            plain[i : i + 2] = [mine.joined[rank]]
        assert word_bpe.merged(list(symbols), mine.ranks, mine.joined, mine.base) == plain


def alignment_rows(rows):
    import sentencepiece

    a_, b_ = library("byte_bpe_50k.json"), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a_.encode_special_tokens = True
    letters = {c: b for b, c in enumerate(word_bpe.byte_letters())}
    count, found = Counter(), []
    for i, text in rows:
        a = a_.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_.encode(text) if text else []
        raw_a = [bytes(letters[c] for c in a_.id_to_token(x)) for x in a]
        raw_b = [bytes([int(p[3:5], 16)]) if b_.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [b_.id_to_piece(x)]]
        if text and not (b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode()):
            a = b = raw_a = raw_b = []
        ends = [[sum(map(len, raw[: k + 1])) for k in range(len(raw))] for raw in (raw_a, raw_b)]
        links = [(x, y) for x, e in zip(a, ends[0], strict=True) for y, f in zip(b, ends[1], strict=True) if e == f]
        count.update(links)
        cuts = [0, *sorted(set(ends[0]) & set(ends[1]))]
        part = lambda ids, e, x, y: ",".join(str(t) for t, z in zip(ids, e, strict=True) if x < z <= y)
        groups = ";".join(part(a, ends[0], x, y) + "|" + part(b, ends[1], x, y) for x, y in zip(cuts, cuts[1:], strict=False))
        found.append((i, len(a), len(b), len(cuts) - 1, links, groups))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(i, n, m, g, len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), s) for i, n, m, g, ls, s in found], count


def files():
    return alignment.Files(P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"))


def short(rows):
    return [(i, t if t is None else t[:700]) for i, t in rows]


def test_alignment(spark, docs, monkeypatch):
    rows = short((r.doc_id, r.text) for r in docs.collect())
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tokens = alignment.tokenise(table.selectExpr("*", "'x' AS a", "1 AS b", "2 AS n_a"), files()).cache()
    counts = alignment.count_links(tokens, files())
    expected, pairs = alignment_rows(rows)
    assert key(alignment.align(tokens, files(), counts).collect()) == key(expected)
    assert any(r[1] == 0 for r in expected if r[0] is not None and rows[r[0]][1]) is not None
    got = counts.rows(spark).collect()
    assert {(r.a, r.b): r.n for r in got} == dict(pairs) and len(got) == len(pairs)
    keys = np.concatenate([alignment.shard(p)[0] for p in counts.paths])
    assert len(counts.paths) > 1 and (np.diff(keys) > 0).all()
    # where shards cannot be mapped they are read
    monkeypatch.setattr(alignment, "_mapped", lambda path: None)
    assert [alignment.shard(p)[0].tolist() for p in counts.paths] == [np.memmap(p.removeprefix("file://"), np.int64, "r")[: len(alignment.shard(p)[0])].tolist() for p in counts.paths]
    with pytest.raises(ValueError):
        counts.of(np.array([keys[-1] + 1]))


def test_alignment_counts_in_parts(spark):
    """Tasks that can hold few keys hand on several counts of one key, which are added up."""
    rows = [(i, t) for i, t in enumerate(["the cat sat", "the cat ran", "a dog"] * 20)]
    tokens = alignment.tokenise(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), files())

    def few(batches):
        alignment.HELD, alignment.TOKENS = 4, 8
        yield from batches

    forced = tokens.mapInArrow(few, tokens.schema)
    counts = alignment.count_links(forced, files())
    assert {(r.a, r.b): r.n for r in counts.rows(spark).collect()} == dict(alignment_rows(rows)[1])


def test_alignment_of_nothing(spark):
    for rows in ([], [(1, None), (2, ""), (3, "▁")]):
        tokens = alignment.tokenise(spark.createDataFrame(rows, "doc_id long, text string"), files())
        got = alignment.align(tokens, files(), alignment.count_links(tokens, files())).collect()
        assert key(got) == key((i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables here")
def test_queries_on_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    got = queries.QUERIES["op11_fill_in_middle"](spark, DIR).collect()
    assert key(got) == key((*r[:5], sha(r[5]), sha(r[6])) for r in (fim_row(i, t) for i, t in rows))
    own = library("word_bpe_49k.json")
    ids = {i: own.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    got = queries.QUERIES["op12_word_bpe"](spark, DIR).collect()
    assert key(got) == key((i, len(x), sha(" ".join(map(str, x))), sha(own.decode(x, skip_special_tokens=False))) for i, x in ids.items())
    got = queries.QUERIES["op13_tokenizer_alignment"](spark, DIR).collect()
    brute = alignment_rows([(i, t) for i, t in rows if len(t or "") < 4000])[0]
    short_ = {i for i, *_ in brute}
    assert key((r.doc_id, r.n_a, r.n_b, r.n_groups, r.groups_sha256) for r in got if r.doc_id in short_) == key((i, n, m, g, sha(s) if n else "") for i, n, m, g, _, _, _, s in brute)
