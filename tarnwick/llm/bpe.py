"""Byte-level BPE through a sentencepiece model built from a rank file.

The model is serialised directly in the protobuf wire format: every byte string of the
vocabulary becomes a piece in which byte b is the character U+0100 + b, scored by its negative
rank, with no normalisation at all. Highest score first, leftmost on ties, is then the merge
order of the ranks, and the ids of the pieces are the ranks. Pre-tokens are encoded one by one;
a pre-token that is itself in the vocabulary is its own token. Decoding maps ids to bytes.

Defined cases: a null text is empty and has no ids; lone surrogates cannot occur in Spark's
strings; texts of any length are encoded whole; repeated rows are encoded each; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: Pre-tokens that a worker remembers before it starts anew.
CACHE = 250_000
_loaded: dict[tuple[str, str], tuple] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


_PIECE = {b: 256 + b for b in range(256)}


def as_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(_PIECE)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose ids are the ranks; the id after the last is unknown."""
    by_rank = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks have to run from 0 without gaps")
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, as_piece(t).encode()) + _field(2, float(-i)) + _field(3, normal) for i, t in enumerate(by_rank)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    n = len(pieces)
    trainer = _field(3, bpe) + _field(4, n) + _field(40, n - 1) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    # identity: no map of characters, no dummy prefix, white space neither removed nor escaped
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one vocabulary and pattern; both work on flat arrays of ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex
        import sentencepiece

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        tokens = sorted(ranks, key=ranks.get)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.first, self.count = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.total = 0

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        found: list[list[int]] = [[self.ranks[b]] if b in self.ranks else [] for b in raw]
        rest = [i for i, ids in enumerate(found) if not ids]
        for i, ids in zip(rest, self.pieces.encode([as_piece(raw[i]) for i in rest], num_threads=1), strict=True):
            found[i] = ids
        count = np.fromiter(map(len, found), np.int64, len(found))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.first.append(self.total + np.cumsum(count) - count)
        self.count.append(count)
        self.ids.append(np.fromiter(chain.from_iterable(found), np.int32, int(count.sum())))
        self.total += int(count.sum())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        split = [self.split(t) for t in texts]
        words = list(chain.from_iterable(split))
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > CACHE and self.known:
            self._forget()
            new = set(words)
        if new:
            self._learn(list(new))
            self.ids, self.first, self.count = ([np.concatenate(x)] for x in (self.ids, self.first, self.count))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        count = self.count[0][at]
        ids = self.ids[0][_spread(self.first[0][at], count)]
        upto = np.append(0, np.cumsum(count))[np.cumsum([0, *map(len, split)])]
        return ids, np.diff(upto)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts, and how many each has."""
        size = self.size[ids]
        upto = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))]
        return self.bytes[_spread(self.start[ids], size)], np.diff(upto)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] of them, for each i."""
    return np.arange(int(count.sum())) + np.repeat(first - np.cumsum(count) + count, count)


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))


def _runs(sizes: list[int], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Rows from, to of about `most` characters or ids, which are worked on at a time."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process; path is a local one, or a file named to addFile()."""
    if (path, pattern) not in _loaded:
        import os

        local = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        _loaded[path, pattern] = (Codec(read_ranks(local), pattern),)
    return _loaded[path, pattern][0]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _runs([len(t) for t in texts]):
                ids, counts = own.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(_offsets(counts), pa.array(ids))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and bytes for every row of encoded (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts = np.asarray(batch.column(1).value_lengths())
            for a, b in _runs(counts.tolist()):
                part = batch.slice(a, b - a)
                data, sizes = own.decode(np.asarray(part.column(1).flatten()), counts[a:b])
                whole = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, _offsets(sizes).buffers()[1], pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*part.columns, whole], ["doc_id", "ids", "bytes"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, bytes binary")
