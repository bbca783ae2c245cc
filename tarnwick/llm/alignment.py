"""Where two tokenizers cut alike, and how often each pair of their tokens ends together.

Tokenizer A is byte-level BPE by a rank file and a pattern (`bpe.Codec`); B is a sentencepiece model that puts
U+2581 for spaces, adds one in front and falls back to bytes. Both tokenise a space and the text. Byte offsets at which a
token of each ends are links; they cut both sequences into groups.

Counting: each partition packs its links into int64 keys (B's id in the upper half) and counts them with `np.unique`;
the partial counts are partitioned by key range and sorted, so that equal keys lie side by side in one task, which adds up
their runs and writes one shard of sorted keys and counts. Lookup: tasks map the shards into memory and find their keys
by `searchsorted`; which shard has a key is told by the shards' least keys. The highest count of each id of B is a table
of the size of B's vocabulary.

Shards are written to the shared folder; on a store that cannot be mapped (hdfs:, s3a: ...) a worker reads a shard once
instead. A task that runs again writes a shard of its own name, so lost executors leave at most files that nobody names.

Defined cases: null and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens,
groups or links; texts of any length are tokenised whole, a row at a time (about 60 bytes of memory for each byte of the longest
text); equal rows count each; texts with code points that are unassigned in this Python's Unicode, or with several combining marks
in a row, are tokenised by A in the tokenizers library; an empty table gives no rows, and no shards; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarnwick.llm import bpe
from tarnwick.llm.units import Memo, flat, is_odd, local_file
from tarnwick.session import materialise, scratch

#: Distinct keys that a task holds before it hands on what it has counted, and partial counts in a shard at most on average.
HELD, SHARD = 1 << 20, 1 << 21
#: Tokens that are worked on at a time.
TOKENS = 1 << 18
UNITS = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*").findall
_loaded: dict[Files, Pair] = {}


@dataclass(frozen=True)
class Files:
    """The tokenizers: A as ranks, as the library's file (for odd texts) and as a pattern; B as a model."""

    ranks: str
    library: str
    pattern: str
    model: str


class Pair:
    """Both tokenizers in one worker, and the bytes of their tokens."""

    def __init__(self, files: Files) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        ranks = bpe.read_ranks(local_file(files.ranks))
        self.a = bpe.Codec(ranks, files.pattern)
        self.library = Tokenizer.from_file(local_file(files.library))
        self.library.encode_special_tokens = True
        self.bytes_a = sorted(ranks, key=ranks.get)
        self.b = own = sentencepiece.SentencePieceProcessor(model_file=local_file(files.model))
        pieces = [own.id_to_piece(i) for i in range(own.vocab_size())]
        if any(re.search("[^▁]▁", p) for p in pieces) or own.encode("a  b", out_type=str) != ["▁a", "▁", "▁b"]:
            raise ValueError("B's tokens run over the starts of words, or it changes white space")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.space = own.piece_to_id("▁")
        self.memo = Memo(self._encode, 3)
        # What stands behind a token: a comma, or where a group ends a bar (A) or a semicolon (B).
        self.shown = [f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"] + [f"{i}{end}" for i in range(len(pieces)) for end in ",;"]

    def _encode(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B, and a mark where a unit is not given back byte for byte.

        Units start with a space, which B itself adds, and end where a space follows what is no white space: there
        tokens of both end, whatever stands around.
        """
        a, n_a = self.a.encode(units)
        odd = [i for i, u in enumerate(units) if is_odd(u)]
        if odd:
            parts = np.split(a, np.cumsum(n_a)[:-1])
            for i in odd:
                parts[i] = np.array(self.library.encode(units[i], add_special_tokens=False).ids, np.int32)
            a, n_a = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        b, n_b = flat([self.space] if u == " " else ids for u, ids in zip(units, self.b.encode([u[1:] for u in units], num_threads=1), strict=True))
        ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
        sizes = (np.cumsum(self.size_a[a])[ends_a - 1], np.cumsum(self.size_b[b])[ends_b - 1]) if len(a) and len(b) and n_a.all() and n_b.all() else (np.zeros(1), np.ones(1))
        bad = np.zeros(len(units), np.int64)
        if not ((sizes[0] == sizes[1]).all() and self._same("".join(units), a.tolist(), b.tolist())):
            parts = [np.split(x, e[:-1]) for x, e in ((a, ends_a), (b, ends_b))]
            bad[:] = [not self._same(u, x.tolist(), y.tolist()) for u, x, y in zip(units, *parts, strict=True)]
        return [(a, n_a), (b, n_b), (np.ones(bad.sum(), np.int32), bad)]

    def _same(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = text.encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))

    def tokenise(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B the ids of all texts in a row, and how many each text has."""
        units = [UNITS(" " + t) if t else [] for t in texts]
        upto = np.cumsum([0, *map(len, units)])
        *both, (_, bad) = self.memo.of(list(chain.from_iterable(units)))
        bad = np.diff(np.append(0, np.cumsum(bad))[upto]) > 0
        out = []
        for ids, count in both:
            n = np.diff(np.append(0, np.cumsum(count))[upto])
            if bad.any():
                ids, n = ids[np.repeat(~bad, n)], np.where(bad, 0, n)
            out.append((ids, n))
        return out

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a and in b of the tokens that end together; a and b cover the same bytes."""
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        marks = np.zeros((2, 1 + int(ends_a[-1] if len(ends_a) else 0)), bool)
        marks[0, ends_a] = marks[1, ends_b] = True
        return np.flatnonzero(marks[1, ends_a]), np.flatnonzero(marks[0, ends_b])

    def groups(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, cuts: np.ndarray) -> list[str]:
        """The groups of each text as `a1,a2|b1;a3|b2,b3`; cuts: how many tokens of both the texts up to each have."""
        code_a, code_b = 2 * a.astype(np.int64), 2 * (b + len(self.bytes_a)).astype(np.int64)
        code_a[at_a] += 1
        code_b[at_b] += 1
        in_a, in_b = np.cumsum(code_a & 1) - (code_a & 1), np.cumsum(code_b & 1) - (code_b & 1)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.append(0, at_b + 1)[in_a]] = code_a
        codes[np.arange(len(b)) + at_a[in_b] + 1] = code_b
        get, codes = self.shown.__getitem__, codes.tolist()
        return ["".join(map(get, codes[x:y]))[:-1] for x, y in zip([0, *cuts.tolist()], cuts.tolist(), strict=False)]


def pair(files: Files) -> Pair:
    """One for each worker process."""
    if files not in _loaded:
        _loaded[files] = Pair(files)
    return _loaded[files]


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(bpe._offsets(counts), pa.array(ids, pa.int32()))


def tokenise(docs: DataFrame, files: Files) -> DataFrame:
    """doc_id, a, b (array<int>): the ids of both tokenizers for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(files)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for x, y in bpe._runs([len(t) for t in texts], 1 << 20):
                a, b = own.tokenise(texts[x:y])
                yield pa.RecordBatch.from_arrays([batch.column(0)[x:y], _lists(*a), _lists(*b)], ["doc_id", "a", "b"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, a array<int>, b array<int>")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of about TOKENS tokens: the rows, ids of A, ids of B, and how many of each the rows have."""
    for batch in batches:
        a, b = batch.schema.get_field_index("a"), batch.schema.get_field_index("b")
        n = [np.asarray(batch.column(k).value_lengths()) for k in (a, b)]
        for x, y in bpe._runs((n[0] + n[1]).tolist(), TOKENS):
            part = batch.slice(x, y - x)
            yield part, np.asarray(part.column(a).flatten()), np.asarray(part.column(b).flatten()), n[0][x:y].astype(np.int64), n[1][x:y].astype(np.int64)


def _packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return b.astype(np.int64) << 32 | a.astype(np.int64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return key, total


def partial_counts(tokens: DataFrame, files: Files) -> DataFrame:
    """key, n: the links of each partition of tokens (a, b), counted; a key may come again where a task had too many to hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, keys, counts, held = pair(files), [], [], 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(keys, counts)], ["key", "n"])
        for _, a, b, _, _ in _parts(batches):
            at_a, at_b = own.links(a, b)
            key, n = np.unique(_packed(a[at_a], b[at_b]), return_counts=True)
            keys.append(key)
            counts.append(n)
            held += len(key)
            if held > HELD:
                key, n = _summed(keys, counts)
                keys, counts, held = [key], [n], len(key)
                if held > HELD // 2:
                    yield give()
                    keys, counts, held = [], [], 0
        if keys:
            yield give()

    return tokens.select("a", "b").mapInArrow(run, "key long, n long")


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


@lru_cache(maxsize=4)
def _read(path: str) -> np.ndarray:
    store, local = _store(path)
    with store.open_input_file(local) as f:
        return np.frombuffer(f.read_buffer(), np.int64)


@lru_cache(maxsize=None)
def _mapped(path: str) -> np.ndarray | None:
    from pyarrow import fs

    store, local = _store(path)
    return np.memmap(local, np.int64, "r") if isinstance(store, fs.LocalFileSystem) else None


def shard(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, counts) of a shard: mapped where its store is a file system, else read, and a few of them kept."""
    both = _mapped(path)
    both = _read(path) if both is None else both
    n = len(both) // 2
    return both[:n], both[n:]


@dataclass(frozen=True)
class Counts:
    """Shards in the order of their keys, the least key of each, and the highest count of each id of B (bounded by its vocabulary)."""

    paths: tuple[str, ...]
    least: np.ndarray
    best: np.ndarray

    def of(self, keys: np.ndarray) -> np.ndarray:
        """How often each of these sorted keys was counted; ValueError if one was not."""
        out = np.empty(len(keys), np.int64)
        cuts = [*np.searchsorted(keys, self.least).tolist(), len(keys)]
        if len(keys) and (not self.paths or cuts[0]):
            raise ValueError("keys below all shards")
        for path, x, y in zip(self.paths, cuts, cuts[1:], strict=False):
            if x < y:
                have, n = shard(path)
                at = np.minimum(np.searchsorted(have, keys[x:y]), len(have) - 1)
                if (have[at] != keys[x:y]).any():
                    raise ValueError("keys that were never counted")
                out[x:y] = n[at]
        return out

    def rows(self, spark: SparkSession) -> DataFrame:
        """a, b, n of every pair that was counted, in the order of b, then a."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    keys, n = shard(path)
                    for i in range(0, len(keys), 1 << 16):
                        k = keys[i : i + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array((k & 0xFFFFFFFF).astype(np.int32)), pa.array((k >> 32).astype(np.int32)), pa.array(np.array(n[i : i + (1 << 16)]))], ["a", "b", "n"])

        paths = spark.createDataFrame([(p,) for p in self.paths], "path string")
        return paths.repartition(max(1, len(self.paths))).mapInArrow(run, "a int, b int, n long")


def count_links(tokens: DataFrame, files: Files) -> Counts:
    """All links of tokens (a, b), counted, sorted and stored; tokens should stand written, as it is read here and again by `align`."""
    spark = tokens.sparkSession
    partial = materialise(partial_counts(tokens, files), "pair-counts")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-partial.count() // SHARD))
    folder = scratch(spark, "pair-shards")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One shard of a partition's sorted keys: runs of equal ones are added up, the last run waits for the next batch."""
        store, local = _store(folder)
        store.create_dir(local)
        name = f"{uuid.uuid4().hex}.pairs"
        key, total, least, best, size = np.zeros(0, np.int64), np.zeros(0, np.int64), None, {}, 0
        counts: list[np.ndarray] = []
        with store.open_output_stream(f"{local}/{name}") as out:

            def put(key: np.ndarray, total: np.ndarray) -> None:
                nonlocal least, size
                if len(key):
                    least = int(key[0]) if least is None else least
                    out.write(key.tobytes())
                    counts.append(total)
                    size += len(key)
                    ids, first = np.unique(key >> 32, return_index=True)
                    for i, most in zip(ids.tolist(), np.maximum.reduceat(total, first).tolist(), strict=True):
                        best[i] = max(best.get(i, 0), most)

            for batch in batches:
                if batch.num_rows:
                    key = np.concatenate([key, np.asarray(batch.column(0))])
                    total = np.concatenate([total, np.asarray(batch.column(1))])
                    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    key, total = key[first], np.add.reduceat(total, first)
                    put(key[:-1], total[:-1])
                    key, total = key[-1:], total[-1:]
            put(key, total)
            for x in counts:
                out.write(x.tobytes())
        if size:
            told = {"path": f"{folder}/{name}", "least": least, "ids": list(best), "best": list(best.values())}
            yield pa.RecordBatch.from_pylist([told], pa.schema([("path", pa.string()), ("least", pa.int64()), ("ids", pa.list_(pa.int32())), ("best", pa.list_(pa.int64()))]))

    sorted_ = partial.repartitionByRange(n, "key").sortWithinPartitions("key")
    # One row for each shard; their ids of B are those of its vocabulary, and one more for each bound between shards.
    told = sorted(sorted_.mapInArrow(write, "path string, least long, ids array<int>, best array<long>").collect(), key=lambda r: r["least"])
    best = np.zeros(1 + max((i for r in told for i in r["ids"]), default=0), np.int64)
    for r in told:
        np.maximum.at(best, np.array(r["ids"]), np.array(r["best"]))
    return Counts(tuple(r["path"] for r in told), np.array([r["least"] for r in told], np.int64), best)


def align(tokens: DataFrame, files: Files, counts: Counts) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups for every row of tokens (doc_id, a, b).

    groups: `a1,a2|b1;a3|b2,b3`, ids of A and B in order; n_best: links whose count is the highest of their id of B;
    count_sum: the counts of all links, added up.
    """
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(counts)  # paths, and one number for each shard and each id of B

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, told = pair(files), shared.value
        for part, a, b, n_a, n_b in _parts(batches):
            at_a, at_b = own.links(a, b)
            key, back = np.unique(_packed(a[at_a], b[at_b]), return_inverse=True)
            n = told.of(key)
            best = (n == told.best[key >> 32])[back]
            upto = np.append(0, np.searchsorted(at_a, np.cumsum(n_a)))
            added = lambda x: np.diff(np.append(0, np.cumsum(x))[upto])  # noqa: B023, E731
            links = np.diff(upto)
            groups = own.groups(a, b, at_a, at_b, np.cumsum(n_a + n_b))
            numbers = [pa.array(x.astype(np.int64)) for x in (n_a, n_b, links, links, added(best), added(n[back]))]
            yield pa.RecordBatch.from_arrays([part.column(0), *numbers, pa.array(groups, pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "a", "b").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
