"""BPE with word ends: a queue of merge ranks over a doubly linked list of symbols.

Reads a tokenizer file whose model is BPE over byte-level words with a word-end suffix, after NFC, white
space and lower case. The text between special tokens is normalised and split into words; a word's
bytes are its first symbols, the last one carrying the suffix. The queue holds (rank, place) of
each pair that can merge; the least one is merged, its neighbours are linked anew and queued, and entries whose
pair has changed since are skipped. Texts are cut into words many at a time, by where the kind of code point changes;
words that come again are remembered. Ids are decoded to the strings of the vocabulary, set side by side.

Defined cases: a null text is empty and has no ids; texts of any length are encoded whole (a single word of n
letters takes n log n steps); special tokens in a text are their own ids; repeated rows are encoded each; ids that
the vocabulary lacks are left out when decoding; an empty table gives no rows; further columns are ignored. Texts
with code points that are unassigned in this Python's Unicode, or with several combining marks in a row, are normalised and
split by the tokenizer file's own rules as the tokenizers library has them.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache, cached_property
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tarnwick.llm.bpe import _offsets, _runs, _spread
from tarnwick.llm.units import Memo, flat, is_odd, local_file

#: The pattern whose matches `word_starts` finds.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, NUMBER, OTHER = range(4)
_loaded: dict[str, WordBpe] = {}
_strings: dict[str, pa.Array] = {}


@cache
def kinds() -> np.ndarray:
    """The kind of each code point, as PATTERN tells them apart."""
    import regex

    points, out = "".join(map(chr, range(0x110000))), np.full(0x110000, OTHER, np.uint8)
    for kind, run in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(run, points):
            out[m.start() : m.end()] = kind
    return out


def word_starts(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a match of PATTERN starts at each code point: where the kind changes, and at every number.

    An apostrophe that opens a match takes s, t, re, ve, m, ll or d with it.
    """
    start = kind != SPACE
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    at = np.flatnonzero(start & (codes == ord("'")))
    if len(at):
        one, two = (np.append(codes, [0, 0])[at + k] for k in (1, 2))
        is_one = np.isin(one, [*map(ord, "stmd")])
        is_two = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[at[is_one | is_two] + 1] = False
        after = np.concatenate([at[is_one] + 2, at[is_two] + 3])
        after = after[after < len(codes)]
        start[after] |= kind[after] == LETTER
    return start


def byte_letters() -> list[str]:
    """The character of each byte: printable ones are themselves, the others follow U+0100 in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def merged(symbols: list[int], ranks: dict[int, int], joined: list[int], base: int) -> list[int]:
    """The symbols that are left when no pair merges: ranks by left * base + right, joined the symbol made by each rank."""
    n = len(symbols)
    if n < 2:
        return symbols
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    get, wide = ranks.get, n.bit_length()
    place = (1 << wide) - 1
    # What stands queued of the pair that starts at each place; another entry of that place is stale.
    now = [-1 if (rank := get(a * base + b)) is None else rank << wide | i for i, (a, b) in enumerate(pairwise(symbols))]
    now.append(-1)
    queue = [x for x in now if x >= 0]
    heapify(queue)
    while queue:
        x = heappop(queue)
        i = x & place
        if now[i] != x:
            continue  # stale
        j = after[i]
        symbols[i] = left = joined[x >> wide]
        symbols[j] = now[i] = now[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (rank := get(left * base + symbols[k])) is not None:
                now[i] = rank << wide | i
                heappush(queue, now[i])
        h = before[i]
        if h >= 0:
            if (rank := get(symbols[h] * base + left)) is None:
                now[h] = -1
            else:
                now[h] = rank << wide | h
                heappush(queue, now[h])
    return [s for s in symbols if s >= 0]


class WordBpe:
    """Encoder and decoder of one tokenizer file; ValueError if it asks for what is not done here."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
            raise ValueError("not a plain BPE model")
        if [x["type"] for x in told["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not normalised by NFC, white space and lower case")
        split, level = told["pre_tokenizer"]["pretokenizers"]
        if (split["type"], split["behavior"], split["invert"], level["type"], level["use_regex"], level["add_prefix_space"]) != ("Split", "Removed", True, "ByteLevel", False, False):
            raise ValueError("words are not split by one pattern")
        if told.get("decoder") or told.get("post_processor") or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in told["added_tokens"]):
            raise ValueError("a decoder, a post-processor or special tokens of another kind")
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + end] for c in letters]
        self.base = max(vocab.values()) + 1
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.ranks = {vocab[a] * self.base + vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.joined = [vocab[a + b] for a, b in pairs]
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        if self.words(" a \n b") != ["a", "b"]:
            raise ValueError("words hold white space")
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.by_kind = split["pattern"]["Regex"] == PATTERN
        self.path = path
        self.as_byte = {c: b for b, c in enumerate(letters)}
        self.memo = Memo(lambda words: [flat(map(self.word, words))], halve=True)

    @cached_property
    def library(self):
        """Loaded for odd texts only."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def word(self, word: str) -> list[int]:
        if word[0] == " ":  # no word has white space in it
            return [self.special[word[1:]]]
        raw = word.encode()
        return merged([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]], self.ranks, self.joined, self.base)

    def _split(self, text: str) -> list[str]:
        if is_odd(text):
            whole = self.library.normalizer.normalize_str(text)
            return [bytes(map(self.as_byte.__getitem__, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(whole)]
        return self.words(self.normalised(text))

    @staticmethod
    def normalised(text: str) -> str:
        # Letter by letter: a sigma at a word's end is an ordinary one.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def units(self, text: str) -> list[str]:
        """Words, and special tokens after a space."""
        if not any(s in text for s in self.special):
            return self._split(text)
        parts = self.at_special(text)
        return list(chain.from_iterable([" " + p] if k % 2 else self._split(p) for k, p in enumerate(parts)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        plain = np.array([self.by_kind and not any(s in t for s in self.special) and not is_odd(t) for t in texts], bool)
        if plain.all():
            return self._encode_plain(texts)
        apart = self._encode_plain([t for t, p in zip(texts, plain, strict=True) if p]), self._encode_units([t for t, p in zip(texts, plain, strict=True) if not p])
        ids, count = (np.concatenate(x) for x in zip(*apart, strict=True))
        place = np.argsort(np.argsort(~plain, kind="stable"))
        return ids[_spread((np.cumsum(count) - count)[place], count[place])], count[place]

    def _encode_units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.units(t) for t in texts]
        ((ids, count),) = self.memo.of(list(chain.from_iterable(split)))
        upto = np.append(0, np.cumsum(count))[np.cumsum([0, *map(len, split)])]
        return ids, np.diff(upto)

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts without special tokens and odd code points, cut into words together; each word is looked up once."""
        texts = [self.normalised(t) for t in texts]
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        kind = kinds()[codes]
        start = word_starts(codes, kind)
        upto = np.searchsorted(np.flatnonzero(start), np.cumsum([0, *(len(t) + 1 for t in texts)]))
        own = kind != SPACE
        codes, start = codes[own], start[own]
        size = 1 + (codes >= 1 << 7).astype(np.int32) + (codes >= 1 << 11) + (codes >= 1 << 16)
        offsets = np.append(0, np.cumsum(size))[np.append(np.flatnonzero(start), len(codes))].astype(np.int32)
        raw = codes.tobytes().decode("utf-32-le").encode()
        words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        ((ids, count),) = self.memo.of(words.dictionary.to_pylist())
        at = words.indices.to_numpy()
        first, count = (np.cumsum(count) - count)[at], count[at]
        return ids[_spread(first, count)], np.diff(np.append(0, np.cumsum(count))[upto])


def codec(path: str) -> WordBpe:
    """One for each worker process; path is a local one, or a file named to addFile()."""
    if path not in _loaded:
        _loaded[path] = WordBpe(local_file(path))
    return _loaded[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _runs([len(t) for t in texts]):
                ids, counts = own.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(_offsets(counts), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def strings_of(path: str) -> pa.Array:
    """The string of each id, null where the vocabulary has none; one for each worker process."""
    if path not in _strings:
        with open(local_file(path), encoding="utf-8") as f:
            told = json.load(f)
        by_id = {i: s for s, i in [*told["model"]["vocab"].items(), *((x["content"], x["id"]) for x in told["added_tokens"])]}
        _strings[path] = pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.string())
    return _strings[path]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded for every row of encoded (doc_id, ids): the vocabulary's strings with a space between, as the file names no decoder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = strings_of(path)
        known = np.asarray(strings.is_valid())
        for batch in batches:
            counts = np.asarray(batch.column(1).value_lengths().fill_null(0))
            for a, b in _runs(counts.tolist()):
                part = batch.slice(a, b - a)
                ids, upto = np.asarray(part.column(1).flatten().fill_null(-1)), np.append(0, np.cumsum(counts[a:b]))
                has = (ids >= 0) & (ids < len(known))
                has[has] = known[ids[has]]
                if not has.all():
                    ids, upto = ids[has], np.append(0, np.cumsum(has))[upto]
                each = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), strings.take(pa.array(ids)))
                yield pa.RecordBatch.from_arrays([*part.columns, pc.binary_join(each, " ")], ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
