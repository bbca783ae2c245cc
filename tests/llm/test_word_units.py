import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import regex

from tarnwick.llm import word_bpe
from tarnwick.llm.units import Memo, flat

PATH = P.path("word_bpe_49k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_words_start_where_the_pattern_matches():
    parts, r = ["'", "'s", "'re", "'ll", "'v", "'ve", "l", "a", "é", "1", "²", "Ⅷ", " ", "\n", " ", "　", "!", "...", "́", "漢", "😀", "d", "tm"], random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
        codes = np.array([*map(ord, text)], np.uint32)
        got = np.flatnonzero(word_bpe.word_starts(codes, word_bpe.kinds()[codes])).tolist()
        assert got == [m.start() for m in regex.finditer(word_bpe.PATTERN, text)], text


def test_texts_of_all_sorts_in_one_call():
    mine, own = word_bpe.WordBpe(PATH), library()
    assert mine.by_kind
    texts = ["", "We're 12 dogs', it's the dog's!", "<|endoftext|>a", "\U000e0fff x", "ΟΔΟΣ Σ.", "́a\n", "", "ạ́ b", " x y ", "'", "it'", "x'll"]
    ids, counts = mine.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    for some in ([], [""], ["", ""], ["<|endoftext|>"]):
        ids, counts = mine.encode(some)
        assert counts.tolist() == [len(own.encode(t, add_special_tokens=False).ids) for t in some] and len(ids) == counts.sum()


def test_each_word_is_looked_up_once_a_call_and_the_library_is_not_loaded():
    mine, met = word_bpe.WordBpe(PATH), Counter()
    of = mine.memo.of
    mine.memo.of = lambda units: met.update(units) or of(units)
    mine.encode(["the dog and the cat", "The dog, the é's!"] * 50)
    assert set(met.values()) == {1} and len(met) == 8
    assert "library" not in vars(mine)


@pytest.mark.parametrize("most_chars", [1 << 20, 60])
def test_a_full_memo_keeps_what_comes_again(most_chars):
    asked = Counter()

    def encode(units):
        asked.update(units)
        return [flat([ord(c) for c in u] for u in units)]

    memo = Memo(encode, most=20, most_chars=most_chars, halve=True)
    for k in range(40):
        units = ["the", "of", f"r{k}", f"s{k}", "the"]
        ids, count = memo.of(units)[0]
        assert count.tolist() == [*map(len, units)] and ids.tolist() == [ord(c) for u in units for c in u]
        assert len(memo.known) <= 20 and memo.chars == sum(map(len, memo.known)) <= most_chars
    assert asked["the"] == asked["of"] == 1
    many = [f"m{k}" for k in range(50)]  # more than it holds
    assert memo.of(many)[0][1].tolist() == [*map(len, many)]
