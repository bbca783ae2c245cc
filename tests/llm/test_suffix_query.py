"""op3_suffix_dedup's columns on passages of over 50 words on both sides of the contract's 400 bytes."""

import hashlib
import random

from tarnwick.llm.queries import QUERIES

LENGTH = 400


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 6))) for _ in range(n))


def passage(size, seed):
    """Over 50 words of exactly `size` bytes."""
    text = words(90, seed)[:size].strip()
    return text + "z" * (size - len(text))


def brute(texts):
    at = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - LENGTH + 1):
            at.setdefault(t[j : j + LENGTH], []).append((i, j))
    cover = [bytearray(len(t)) for t in texts]
    for where in at.values():
        for i, j in where if len(where) > 1 else []:
            cover[i][j : j + LENGTH] = b"\1" * LENGTH
    return cover


def test_passages_of_over_50_words_go_from_400_bytes(spark, tmp_path):
    shared = [passage(n, n) for n in (299, 399, 400, 470)]
    assert all(len(p.split()) > 50 for p in shared)
    texts = [f"{words(60, 100 + i)} #{i}{p}{i}# {words(70, 200 + i)}" for i, p in enumerate(p for p in shared for _ in range(2))]
    texts += [texts[0], words(400, 7), "é" * 250, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    raw = [(t or "").encode() for t in texts]
    want = []
    for i, (t, c) in enumerate(zip(raw, brute(raw), strict=True)):
        kept = bytes(b for b, hit in zip(t, c, strict=True) if not hit)
        spans = sum(c[j] and not (j and c[j - 1]) for j in range(len(c)))
        want.append((i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    got = sorted(QUERIES["op3_suffix_dedup"](spark, str(tmp_path)).collect())
    assert [tuple(r)[:5] for r in got] == want
    removed = [r.n_removed for r in got]
    # 399 bytes and less stay; of 400 and more the passage goes
    assert removed[2:4] == [0, 0] and removed[4:8] == [400, 400, 470, 470] and removed[1] == 0 and removed[0] == removed[8] == len(raw[0])
    assert [r.text for r in got][2:4] == texts[2:4] and shared[2] not in got[4].text
