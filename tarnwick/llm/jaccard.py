"""N-gram Jaccard join: documents whose sets of word n-grams overlap by a share of their union.

Equal sets are one node. Each node's n-grams are put in one order for all, rare first (counts of
frequent n-grams over all documents, in a table of bounded size; what is not in it is rare, ties
go by hash), and only a prefix is joined: of the longer document as many as could hold the first
common n-gram, of the shorter fewer. Candidates pass length and positional filters and a suffix
filter, which bounds the overlap from counts of n-grams by hash range, and are verified once per
pair on whole texts.

A group of near copies would give pairs by the square of its size, so it is joined in two rounds:
first each node with its prefix n-gram's hub (the node in which it stands first), one pair for
each row; then those pairs that no common hub links already. Nothing but links that are implied
by found ones is left out, so the components are those of all links.

Defined cases: a null, empty or wordless text has an empty set and links with nothing; a text
with fewer words than n is one n-gram; equal rows are one node; texts that share a doc_id are one
document, which links as any of them does; a null doc_id links with nothing and has a null
component; very long texts are taken whole, unfolded one at a time; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import split_by_keys
from tarnwick.operators.graph import stars
from tarnwick.session import materialise

#: Entries of the table of frequent n-grams, and n-grams that are counted at a time for it.
FREQUENT, COUNTED = 1 << 17, 1_000_000
#: Rows of one n-gram that a task sorts, about, and pairs of one document that are verified in a group.
SPLIT, BATCH = 200_000, 1_000
#: Hash ranges of the suffix filter, whose counts are a byte each; a set with more than MOST_COUNT in one goes unfiltered.
RANGES, MOST_COUNT = 128, 127
CHUNK = 1 << 20
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
_TABLE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(41))
_LOWER = bytes(range(256)).lower()
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def ngram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word n-grams, A-Z lower-cased."""
    none = np.zeros(0, np.uint64)
    data = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
    word = ~_SPACE[data]
    begin = np.flatnonzero(word & ~np.append(False, word[:-1]))
    if not len(begin):
        return [none] * len(texts)
    at = np.flatnonzero(word)
    first = np.searchsorted(at, begin)
    place = at - np.repeat(begin, np.diff(np.append(first, len(at))))
    power = np.cumprod(np.append(np.uint64(1), np.full(int(place.max()), _BASE)))
    words = _mix(np.add.reduceat(_TABLE[data[at]] * power[place], first))
    ends = np.cumsum([len(t) + 1 for t in texts])
    edge = np.append(0, np.searchsorted(begin, ends)).tolist()
    full = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        full = full * _BASE + words[k : k + len(full)]
    full = _mix(full)
    out = []
    for a, b in pairwise(edge):
        if b - a >= n:
            s = np.sort(full[a : b - n + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in words[a:b]:
                h = h * _BASE + w
            out.append(_mix(h ^ _M1))
        else:
            out.append(none)
    return out


class Share:
    """A threshold num / den and what follows from it."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def probe(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def index(self, n: int) -> int:
        return n - -(-2 * self.num * n // (self.num + self.den)) + 1

    def overlap(self, a: Column, b: Column) -> Column:
        return F.ceil((a + b) * self.num / (self.num + self.den) - 1e-9)

    def sizes(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * self.den >= F.greatest(a, b) * self.num

    def suffix_fits(self, p: Column, q: Column, a: Column, b: Column) -> Column:
        """Whether the overlap can suffice: in each hash range it is at most the smaller count."""
        most = F.aggregate(F.zip_with(p, q, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
        return F.coalesce(most >= self.overlap(a, b), F.lit(True))

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if not len(a) or not len(b):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * both >= self.num * (len(a) + len(b) - both)


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        texts, at, size = [(t or "").encode() for t in batch.column(column).to_pylist()], 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK or i == len(texts) - 1:
                yield batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0


def _digest(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    return tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist())


class _Seen:
    """Sets that this task has met lately; a set may be met again unnoticed, never the reverse."""

    def __init__(self, most: int = 100_000) -> None:
        self.own, self.most = set(), most

    def new(self, key: tuple[int, int]) -> bool:
        if key in self.own:
            return False
        if len(self.own) >= self.most:
            self.own.clear()
        self.own.add(key)
        return True


def measure(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, c1, c2, ranges) for every row, and (token, count) of n-grams frequent somewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, many = _Seen(), [], 0

        def frequent() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            top = np.flatnonzero(count > 2)
            top = top[np.argsort(-count[top], kind="stable")[: FREQUENT // 2]]
            cols = [pa.nulls(len(top), kind), pa.array(count[top], pa.int32()), pa.array(token[top].view(np.int64)), pa.nulls(len(top), pa.int64()), pa.nulls(len(top), pa.list_(pa.int8()))]
            return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(top), True))], names)

        names = ["doc_id", "n", "c1", "c2", "ranges", "token"]
        for batch, texts in _chunks(batches, 1):
            kind = batch.column(0).type
            sets = ngram_sets(texts, n)
            keys = [_digest(s) for s in sets]
            counts = [np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=RANGES) for s in sets]
            lists = pa.array([None if c.max() > MOST_COUNT else c.astype(np.int8) for c in counts], pa.list_(pa.int8()))
            cols = [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), lists]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(sets), False))], names)
            for s, key in zip(sets, keys, strict=True):
                if len(s) and seen.new(key):
                    held.append(s)
                    many += len(s)
            if many >= COUNTED:
                yield frequent()
                held, many = [], 0
        if held:
            yield frequent()

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n int, c1 long, c2 long, ranges array<tinyint>, token boolean")
    both = materialise(both, "ngrams")
    return both.where("NOT token").drop("token"), both.where("token").select(F.col("c1").alias("token"), F.col("n").alias("count"))


def prefixes(docs: DataFrame, n: int, share: Share, tokens: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(token, c1, n, pos, salt): the probing prefix of every set, rare n-grams first; the salt splits an n-gram that is counted often."""
    order = np.argsort(tokens)
    sent = docs.sparkSession.sparkContext.broadcast((tokens[order], counts[order]))  # FREQUENT rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = sent.value
        seen = _Seen()
        for _, texts in _chunks(batches, 0):
            parts, size, keys, salts = [], [], [], []
            for s in ngram_sets(texts, n):
                if not len(s) or not seen.new(key := _digest(s)):
                    continue
                p = share.probe(len(s))
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    common = np.flatnonzero(known[at] == s)
                    if len(common):
                        last = common[np.argsort(often[at[common]], kind="stable")]
                        s = np.concatenate([np.delete(s, common), s[last]])
                parts.append(s[:p])
                size.append(len(s))
                keys.append(key[0])
                salt = np.zeros(p, np.int32)
                if len(known):
                    at = np.minimum(np.searchsorted(known, parts[-1]), len(known) - 1)
                    groups = np.where(known[at] == parts[-1], 1 + often[at] // SPLIT, 1)
                    salt = np.where(groups > 1, 1 + key[1] % groups, 0).astype(np.int32)
                salts.append(salt)
            if parts:
                each = np.array([len(p) for p in parts])
                pos = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                cols = [np.concatenate(parts).view(np.int64), np.repeat(np.array(keys, np.int64), each), np.repeat(size, each).astype(np.int32), pos.astype(np.int32), np.concatenate(salts)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["token", "c1", "n", "pos", "salt"])

    return docs.select("text").mapInArrow(run, "token long, c1 long, n int, pos int, salt int")


def shared_only(rows: DataFrame) -> DataFrame:
    """Rows (token, c1, ..., salt), sorted by token, salt and c1 within partitions, each once, whose token occurs
    more than once; those of a token that is split all stay."""

    def pair(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(batch.column(0)), np.asarray(batch.column(1))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t, c = pair(batch)
            new = np.append(before != (t[0], c[0]), (t[1:] != t[:-1]) | (c[1:] != c[:-1]))
            before = (t[-1], c[-1])
            if new.any():
                yield batch.filter(pa.array(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, None  # the row not yet given out, and the token before it
        for batch in once(batches):
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            t, _ = pair(batch)
            equal = np.append(before is not None and t[0] == before, t[1:] == t[:-1])
            split = np.asarray(batch.column("salt")) > 0
            yield batch.slice(0, len(t) - 1).filter(pa.array(equal[:-1] | equal[1:] | split[:-1]))
            last = batch.slice(len(t) - 1)
            before = t[-2] if len(t) > 1 else before
        if last is not None and (last.column("salt")[0].as_py() > 0 or (before is not None and pair(last)[0][0] == before)):
            yield last

    return rows.mapInArrow(run, rows.schema)


def verify(pairs: DataFrame, docs: DataFrame, n: int, share: Share) -> DataFrame:
    """The pairs (x, y) of doc_ids that link, from the whole texts; pairs have to stand written.

    Pairs are dealt by y, of which a hub has many, BATCH to a group; a group carries y's text once, in front, and
    then the texts of its x.
    """
    ids = pairs.select(F.col("x").alias("doc_id")).unionByName(pairs.select(F.col("y").alias("doc_id")))
    held, _ = split_by_keys(docs.select("doc_id", "text"), ids)
    groups = pairs.groupBy("y").agg(F.ceil(F.count("*") / BATCH).cast("int").alias("groups"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    front = groups.join(held.withColumnRenamed("doc_id", "y"), "y")
    front = front.select("y", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(None).cast(kind).alias("x"), "text")
    each = pairs.join(groups, "y").join(held.withColumnRenamed("doc_id", "x"), "x")
    each = each.select("y", F.pmod(F.hash("x"), F.col("groups")).alias("g"), "x", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = front.unionByName(each).repartition(parts, "y", "g").sortWithinPartitions("y", "g", F.col("x").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, heads = None, []  # the group that is met, and the sets of its y
        for batch, texts in _chunks(batches, 3):
            sets, xs, ys = ngram_sets(texts, n), batch.column(2).to_pylist(), batch.column(0).to_pylist()
            hit = []
            for x, y, g, s in zip(xs, ys, batch.column(1).to_pylist(), sets, strict=True):
                if (y, g) != own:
                    own, heads = (y, g), []
                if x is None:
                    heads.append(s)
                hit.append(x is not None and any(share.linked(s, h) for h in heads))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0)], ["x", "y"]).filter(pa.array(hit, pa.bool_()))

    return rows.select("y", "g", "x", "text").mapInArrow(run, f"x {kind}, y {kind}").distinct()


def join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_ngrams, component_id for every row of docs (doc_id, text)."""
    spark, share = docs.sparkSession, Share(num, den)
    rows, frequent = measure(docs, n)
    # A table of FREQUENT rows at most comes to the driver.
    top = frequent.groupBy("token").agg(F.sum("count").alias("c")).orderBy(F.desc("c"), "token").limit(FREQUENT).collect()
    tokens, counts = np.array([r.token for r in top], np.int64).view(np.uint64), np.array([r.c for r in top], np.int64)
    linkable = rows.where("n > 0 AND doc_id IS NOT NULL")
    nodes = linkable.groupBy("c1", "c2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("ranges").alias("ranges"))
    nodes = materialise(nodes, "nodes")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = prefixes(docs.where("doc_id IS NOT NULL"), n, share, tokens, counts).repartition(parts, "token", "salt").sortWithinPartitions("token", "salt", "c1")
    shared = materialise(shared_only(dealt).drop("salt"), "prefixes")

    # Round one: each row with the hub of its token.
    hubs = shared.groupBy("token").agg(F.min(F.struct("pos", "n", "c1")).alias("hub"), F.count("*").alias("k")).where("k > 1")
    star = shared.join(hubs, "token").where(F.col("c1") != F.col("hub.c1"))
    star = star.select(F.col("c1").alias("a"), F.col("hub.c1").alias("b"), F.col("n").alias("na"), F.col("hub.n").alias("nb"), F.col("pos").alias("pa"), F.col("hub.pos").alias("pb"))
    # Length filter, and positional filter: no more can be common than is left of either from here.
    ahead = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    fits = share.sizes(F.col("na"), F.col("nb")) & (ahead >= share.overlap(F.col("na"), F.col("nb")))

    def by_node(pairs: DataFrame) -> DataFrame:
        """Distinct pairs (x, y), x > y, of nodes, that pass the suffix filter."""
        one = lambda s: nodes.select(F.col("c1").alias(s), F.col("node").alias(f"node_{s}"), F.col("n").alias(f"size_{s}"), F.col("ranges").alias(f"ranges_{s}"))
        full = pairs.select("a", "b").distinct().join(one("a"), "a").join(one("b"), "b").where("node_a <> node_b")
        full = full.where(share.suffix_fits(F.col("ranges_a"), F.col("ranges_b"), F.col("size_a"), F.col("size_b")))
        return full.select(F.greatest("node_a", "node_b").alias("x"), F.least("node_a", "node_b").alias("y"), F.col("node_b").alias("hub")).distinct()

    first = materialise(by_node(star.where(fits)), "pairs")
    once = materialise(first.select("x", "y").distinct(), "pairs")
    linked = materialise(verify(once, docs, n, share), "links")

    # Round two: pairs that share a token and that no common hub links.
    with_hub = linked.join(first, ["x", "y"]).select("x", "y", "hub")
    member = with_hub.select(F.when(F.col("x") == F.col("hub"), F.col("y")).otherwise(F.col("x")).alias("node"), "hub")
    group = member.unionByName(member.select(F.col("hub").alias("node"), "hub")).groupBy("node").agg(F.min("hub").alias("group"))
    grouped = nodes.select("c1", "node").join(group, "node", "left").groupBy("c1").agg(F.min(F.coalesce("group", "node")).alias("group"))
    left = shared.join(grouped, "c1")
    mixed = left.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("token")
    left = materialise(left.join(mixed, "token"), "mixed")
    # Only what is left of the rows carries its counts for the suffix filter.
    counts = nodes.groupBy("c1").agg(F.when(F.count("*") == 1, F.first("ranges")).alias("ranges"))
    left = left.join(counts, "c1")
    indexed = F.col("pos") < F.col("n") - F.ceil(F.col("n") * (2 * num) / (num + den) - 1e-9) + 1
    a = left.select("token", F.col("c1").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("group").alias("ga"), F.col("ranges").alias("ra"))
    b = left.where(indexed).select("token", F.col("c1").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("group").alias("gb"), F.col("ranges").alias("rb"))
    longer = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))
    suffix = share.suffix_fits(F.col("ra"), F.col("rb"), F.col("na"), F.col("nb"))
    rest = a.join(b, (a["token"] == b["token"]) & (F.col("ga") != F.col("gb")) & longer & fits & suffix).select("a", "b")
    rest = by_node(rest).select("x", "y").distinct().join(once, ["x", "y"], "left_anti")
    more = verify(materialise(rest, "pairs"), docs, n, share)

    found = stars(materialise(linked.unionByName(more), "links"))
    classes = nodes.withColumnRenamed("node", "own").join(found, F.col("own") == F.col("node"), "left")
    classes = classes.select("c1", "c2", F.coalesce("component", "own").alias("component"))
    out = rows.join(classes, ["c1", "c2"], "left")
    in_class = F.when(F.col("n") > 0, F.col("component"))
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce(in_class, F.col("doc_id")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_ngrams"), mine.alias("component_id"))
