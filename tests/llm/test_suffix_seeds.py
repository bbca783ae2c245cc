import random
from collections import Counter

import numpy as np
import pytest

from tarnwick.llm import suffix


@pytest.mark.parametrize("seed", [1, 2, 5, 8])
def test_extension_from_longer_seeds(monkeypatch, seed):
    monkeypatch.setattr(suffix, "SEED", seed)
    r = random.Random(seed)
    for _ in range(150):
        n, letters = r.randint(1, 24), "ab\0c"[: r.randint(1, 4)]
        parts = ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(3)]
        strings = ["".join(r.choice(parts)[r.randint(0, 3) :] for _ in range(r.randint(1, 4))).encode() or b"a" for _ in range(r.randint(1, 6))]
        copies = [r.random() < 0.3 for _ in strings]
        count = Counter(s[i : i + n] for s, c in zip(strings, copies) for _ in range(1 + c) for i in range(len(s) - n + 1))
        for s, m in zip(strings, suffix.repeated(strings, n, copies), strict=True):
            assert [bool(x) for x in m[: max(0, len(s) - n + 1)]] == [count[s[i : i + n]] > 1 for i in range(len(s) - n + 1)]


def test_shared_bytes_of_neighbours():
    data = np.frombuffer(b"abcabd\0ab\0", np.uint8)
    left = np.array([6, 5, 4, 3, 2, 1, 0, 2, 1, 0])
    known, sooner = suffix.shorter(data, left, np.array([7, 0, 3, 1, 4]), 3)
    assert known.tolist() == [True, True, True, True, True, True] and sooner.tolist() == [True, False, False, True, True, True]


def test_a_passage_of_the_length_goes_and_a_shorter_one_stays(spark):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    short, long = word(399), word(400)
    rows = [(1, f"A{short}B{word(90)}"), (2, f"C{short}D"), (3, f"E{long}F{word(90)}"), (4, f"G{long}H")]
    got = {x.doc_id: [tuple(s) for s in x.spans] for x in suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 400).collect()}
    assert got == {1: [], 2: [], 3: [(1, 401)], 4: [(1, 401)]}
