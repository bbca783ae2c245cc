"""Suffix-array dedup: every byte covered by a string of `length` bytes that starts twice.

Windows of `length` bytes are dealt by their minimiser, the k-gram of least hash, which equal
windows share. A run of windows with one minimiser is a stretch. The distinct stretches of one
minimiser stand in one block, a stretch that occurs more than once as two copies; in each block
the breadth-first backward extension on the Burrows-Wheeler transform derives the common prefixes
of neighbouring suffixes by increasing value and stops at `length`: what has no value by then is
repeated. Every repeated byte is found that way. Two copies have one suffix array: what is sorted
is one of them, and its entries are doubled.

A minimiser with more than PART distinct stretches is refined: its windows are dealt anew by the
half of the places that the minimiser can have in a window, together with the bytes that all
windows of that half have in common, then by the quarter, and so on. Equal windows stay together,
unlike ones part, and what has become unique goes. So no block grows with the data, and no
stretch is paired with others by parts.

Defined cases: a null text is empty; a text shorter than `length` loses nothing; copies of a
whole text lose all of it; rows are told apart by doc_id and text hash, so repeated rows count
as repeats of one another and equal doc_ids with other texts do not mix; a very long text is
scanned as a whole in one task, in memory of about 40 times its size; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import split_by_keys
from tarnwick.session import materialise

#: Bytes that are scanned at a time, and bytes of a block (below 2**20, see `suffix_array`).
CHUNK, BLOCK = 1 << 19, 300_000
#: Distinct stretches of one minimiser beyond which it is refined.
PART = 250
#: Bytes of the strings that the extension starts from, up to 8.
SEED = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def most_of(length: int) -> int:
    """Distinct stretches that a block may have of one minimiser: PART, fewer where windows are long."""
    return max(1, min(PART, (1 << 19) // (2 * length)))


def gram_size(length: int) -> int:
    """The k-grams of a window: the largest power of two up to a third of it."""
    k = 1
    while k * 6 <= length:
        k *= 2
    return k


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-gram, k a power of two, by doubling."""
    table = (np.arange(1, 257, dtype=np.uint64) * _MIX) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(17))
    h, m = table[data], 1
    while m < k:
        h = h[:-m] * np.uint64(pow(_BASE, m, 1 << 64)) + h[m:]
        m *= 2
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    full = np.pad(x, (0, -len(x) % w), constant_values=np.iinfo(x.dtype).max).reshape(-1, w)
    before = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], before[w - 1 : w - 1 + n])


def stretches(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, minimiser hash, its place in the first window) of the stretches of texts, as arrays."""
    k = gram_size(length)
    sizes = np.array([len(t) for t in texts], np.int64)
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    if not (sizes >= length).any():
        return empty
    data = np.frombuffer(b"".join(texts), np.uint8)
    grams = gram_hashes(data, k)
    # 30 bits of the hash, then the place, at every size: the leftmost of equal k-grams is the least, and a window's
    # copies choose alike. More k-grams tie than by the whole hash, which moves the choice and never parts copies.
    wide = 34
    ranked = (grams >> np.uint64(wide) << np.uint64(wide)) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(ranked, length - k + 1) & np.uint64((1 << wide) - 1)
    first = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = least[first[text] + at]
    new = np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]))
    head = np.flatnonzero(new)
    place = place[head].astype(np.int64)
    return text[head], at[head], np.diff(np.append(head, len(text))), grams[place], place - first[text[head]] - at[head]


SCAN = "doc_id {}, th long, gram long, c1 long, c2 long, start int, windows int, lead int"


def scan(docs: DataFrame, length: int) -> DataFrame:
    """The stretches of docs (doc_id, th, text), each with a 128-bit hash of its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts, at = batch.column(2).to_pylist(), 0
            while at < len(texts):
                part, size = [], 0
                while at + len(part) < len(texts) and (not part or size < CHUNK):
                    part.append((texts[at + len(part)] or "").encode())
                    size += len(part[-1])
                text, start, windows, gram, lead = stretches(part, length)
                if len(text):
                    sums = b"".join(xxhash.xxh3_128_digest(part[t][s : s + n + length - 1]) for t, s, n in zip(text.tolist(), start.tolist(), windows.tolist(), strict=True))
                    pair = np.frombuffer(sums, np.int64).reshape(-1, 2)
                    rows = pa.array(at + text)
                    cols = [batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, (gram.view(np.int64), pair[:, 0], pair[:, 1], start.astype(np.int32), windows.astype(np.int32), lead.astype(np.int32)))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "gram", "c1", "c2", "start", "windows", "lead"])
                at += len(part)

    return docs.select("doc_id", "th", "text").mapInArrow(run, SCAN.format(docs.schema["doc_id"].dataType.simpleString()))


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse by prefix doubling; below 2**20 symbols, each below 2**14.

    After the first sort only suffixes that still tie with others are sorted again.
    """
    n = len(symbols)
    if n >= 1 << 20 or n and int(symbols.max()) >= (1 << 14) - 1:
        raise ValueError("too many symbols: `length` is too small for blocks of this many strings")
    s = np.append(symbols.astype(np.int64) + 1, [0, 0])
    packed = ((s[:-2] << 28 | s[1:-1] << 14) | s[2:]) << 20 | np.arange(n, dtype=np.int64)
    packed.sort()
    sa = packed & ((1 << 20) - 1)
    start = np.append(True, (packed[1:] >> 20) != (packed[:-1] >> 20))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(start, np.arange(n), 0))  # the first place of those that tie
    lone = start & np.append(start[1:], True)
    places = np.flatnonzero(~lone)
    h = 3
    while len(places):
        tied = sa[places]
        ahead = np.zeros(len(tied), np.int64)
        inside = tied + h < n
        ahead[inside] = rank[tied[inside] + h] + 1
        packed = (rank[tied] << 20 | ahead) << 20 | np.arange(len(tied), dtype=np.int64)
        packed.sort()
        tied = tied[packed & ((1 << 20) - 1)]
        packed >>= 20
        start = np.append(True, packed[1:] != packed[:-1])
        # groups keep their places, so those of all that tie are the same as before
        sa[places] = tied
        rank[tied] = np.maximum.accumulate(np.where(start, places, 0))
        lone = start & np.append(start[1:], True)
        places = places[~lone]
        h *= 2
    return sa, rank


def shorter(data: np.ndarray, left: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the suffixes ranked i - 1 and i share fewer than `most`, and fewer than `most` - 1, bytes (up to 8) before
    the string of one ends, of which each has `left` bytes left; set at both ends."""
    padded, head = np.append(data, np.zeros(most, np.uint8)), np.zeros(len(data), np.uint64)
    for k in range(most):
        head <<= np.uint64(8)
        head |= padded[k : k + len(data)]
    head, left = head[sa], np.minimum(left, most)[sa].astype(np.int8)
    differ, left = head[1:] ^ head[:-1], np.minimum(left[1:], left[:-1])
    known = (differ != 0) | (left < most), (differ >> np.uint64(8) != 0) | (left < most - 1)
    return tuple(np.concatenate([[True], k, [True]]) for k in known)


def repeated(strings: list[bytes], length: int, copies: list[bool] | None = None) -> list[np.ndarray]:
    """For each string, a mask of the places where a substring of `length` starts that starts elsewhere too.

    A string whose `copies` is set stands there twice. lcp[i] is found for ever longer common
    prefixes l: an interval of suffixes that share l characters is extended backwards by each
    character before it, and the right edge of what comes out has the value l if it has none yet.
    Values below SEED - 1 are read off the neighbours' first bytes, and the extension starts from the intervals
    of SEED characters. Separators differ, so they end every match.
    """
    r = len(strings)
    sizes = np.array([len(s) for s in strings])
    n = int(sizes.sum()) + r
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.empty(n, np.int64)
    inside = np.ones(n, bool)
    inside[ends] = False
    raw = np.frombuffer(b"".join(strings), np.uint8)
    symbols[inside] = raw.astype(np.int64) + r
    symbols[ends] = np.arange(r)
    sa, rank = suffix_array(symbols)
    # The suffixes of the second copy stand right behind those of the first.
    weight = np.ones(n, np.int64) if copies is None else np.repeat(1 + np.array(copies, np.int64), sizes + 1)
    times = weight[sa]
    first = np.cumsum(times) - times
    second = np.zeros(int(times.sum()), np.int64)
    second[first[times == 2] + 1] = 1
    sa, n = np.repeat(sa, times), len(second)
    before = symbols[sa - 1]  # the transform; of a string's start it is a separator
    back = first[rank[sa - 1]] + second  # right where `before` is no separator
    # Whether lcp[i], of the suffixes ranked i - 1 and i, is below `seed`, then below ever more up to `length`.
    seed = min(SEED, length)
    data = np.zeros(len(symbols), np.uint8)
    data[inside] = raw
    known, sooner = shorter(data, np.repeat(ends, sizes + 1) - np.arange(len(symbols)), sa, seed)
    # the intervals of `seed` characters whose right edge has the value seed - 1; what holds a separator is its own suffix alone
    lo, hi = np.flatnonzero(known[:n]), np.flatnonzero(known[1:])
    fresh = ~sooner[hi + 1]
    lo, hi = lo[fresh], hi[fresh]
    for _ in range(seed, length):
        if not len(lo):
            break
        size = hi - lo + 1
        of = np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + lo[of]
        inner = before[at] >= r
        at, of = at[inner], of[inner]
        if not len(at):
            break
        # of each interval and character the least and the greatest place before
        single = len(of) == len(lo) and (size == 1).all()
        if single:
            nlo = nhi = back[at]
        else:
            group = of * (r + 256) + before[at]
            packed = group << 21 | np.arange(len(group))  # two copies of below 2**20 symbols
            packed.sort()
            order, group = packed & ((1 << 21) - 1), packed >> 21
            edge = np.append(True, group[1:] != group[:-1])
            nlo = back[at[order[edge]]]
            nhi = back[at[order[np.append(edge[1:], True)]]]
        fresh = ~known[nhi + 1]
        lo, hi = nlo[fresh], nhi[fresh]
        known[hi + 1] = True
    twice = np.zeros(len(symbols), bool)
    same = ~known[1:n]  # neighbours that share `length` symbols
    twice[sa[1:][same]] = True
    twice[sa[:-1][same]] = True
    return [twice[e - z : e] for e, z in zip(ends.tolist(), sizes.tolist(), strict=True)]


def runs(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in edge.reshape(-1, 2)]


RUNS = "array<struct<a:int,b:int>>"


def search(blocks: DataFrame, length: int) -> DataFrame:
    """(gram, c1, c2, runs) of stretches (gram, c1, c2, copies, content): runs of repeated window starts.

    Rows of one gram stand together in a partition, and are few.
    """

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        found = [runs(m[: len(m) - length + 1]) for m in repeated([x[-1] for x in rows], length, [x[3] for x in rows])]
        hit = [(*x[:3], f) for x, f in zip(rows, found, strict=True) if f]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        cols = list(zip(*hit, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["gram", "c1", "c2", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []  # whole groups
        group: list[tuple] = []
        size = own = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != row[0]:
                    if ready and size + own > BLOCK:
                        yield flush(ready)
                        ready, size = [], 0
                    ready, size, group, own = ready + group, size + own, [], 0
                group.append(row)
                own += len(row[-1]) + 1
        if ready and own + size > BLOCK:
            yield flush(ready)
            ready = []
        if ready or group:
            yield flush(ready + group)

    return blocks.select("gram", "c1", "c2", "copies", "content").mapInArrow(run, f"gram long, c1 long, c2 long, runs {RUNS}")


def halves(pieces: DataFrame, length: int, width: int) -> DataFrame:
    """Pieces (gram, c1, c2, off, lead, copies, content), each cut where the minimiser's place in the
    window passes a multiple of `width`: with key, a hash of that multiple, the gram and the bytes that all windows
    of that range have, and k1 and k2, a hash of the new content.

    The range of places [q * width, (q + 1) * width) of a minimiser at p has the bytes from p - q * width to
    p - (q + 1) * width + 1 + length in common; a window of the range has all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out = []
            for gram, c1, c2, off, lead, copies, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                windows, i = len(content) - length + 1, 0
                while i < windows:  # window i has the minimiser at lead - i
                    q = (lead - i) // width
                    n = min(windows - i, lead - i - q * width + 1)
                    core = content[max(0, lead - q * width) : lead - (q + 1) * width + 1 + length]
                    part = content[i : i + n + length - 1]
                    key = xxhash.xxh3_64_intdigest(core + q.to_bytes(4, "little"), gram & (2**64 - 1))
                    k1, k2 = np.frombuffer(xxhash.xxh3_128_digest(part), np.int64).tolist()
                    out.append((gram, c1, c2, off + i, lead - i, copies, part, key - (key >> 63 << 64), k1, k2))
                    i += n
            names = ["gram", "c1", "c2", "off", "lead", "copies", "content", "key", "k1", "k2"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    schema = "gram long, c1 long, c2 long, off int, lead int, copies boolean, content binary, key long, k1 long, k2 long"
    return pieces.select("gram", "c1", "c2", "off", "lead", "copies", "content").mapInArrow(run, schema)


def refined(heavy: DataFrame, length: int) -> DataFrame:
    """(gram, c1, c2, runs) for stretches (gram, c1, c2, lead, copies, content) of minimisers with many distinct ones."""
    left = heavy.withColumn("off", F.lit(0))
    width, found = length - gram_size(length) + 1, []
    while width > 1:
        width = (width + 1) // 2
        pieces = materialise(halves(left, length, width), "pieces")
        # Counted by content first, so that a key's many equal pieces are few rows.
        kinds = pieces.groupBy("key", "k1", "k2").agg(F.count("*").alias("n"), F.max("copies").alias("copies"), F.first("content").alias("content"))
        kinds = materialise(kinds.withColumn("copies", F.col("copies") | (F.col("n") > 1)), "kinds")
        size = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.max("copies").alias("some")).where("kinds > 1 OR some")
        size = materialise(size.select("key", (F.col("kinds") <= most_of(length)).alias("light")), "sizes")
        ready = kinds.join(size.where("light"), "key").select(F.col("key").alias("gram"), F.col("k1").alias("c1"), F.col("k2").alias("c2"), "copies", "content")
        hits = materialise(dealt(ready, length), "hits").withColumnsRenamed({"gram": "key", "c1": "k1", "c2": "k2"})
        mine = pieces.drop("content").join(hits, ["key", "k1", "k2"])
        moved = F.transform("runs", lambda x: F.struct((x["a"] + F.col("off")).alias("a"), (x["b"] + F.col("off")).alias("b")))
        found.append(mine.select("gram", "c1", "c2", moved.alias("runs")))
        left = pieces.join(size.where("NOT light"), "key").select("gram", "c1", "c2", "off", "lead", "copies", "content")
        left = materialise(left, "left")
        if left.isEmpty():
            break
    # With a width of 1 all windows of a key are equal, so nothing is left.
    return reduce(DataFrame.unionByName, found)


def dealt(rows: DataFrame, length: int) -> DataFrame:
    """`search` of rows (gram, c1, c2, copies, content), whose grams have up to PART rows, put into partitions by gram."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return search(rows.repartition(n, "gram").sortWithinPartitions("gram"), length)


def find(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, start, end): byte ranges of docs (doc_id, th, text) that are repeated; they overlap."""
    found = materialise(scan(docs, length), "stretches")
    key = ["gram", "c1", "c2"]
    # Minimisers met twice, in one text or several; counted with partial sums, so a hot one is no burden.
    # Written, so that the join's sides are plain exchanges, which Spark can split where one key is hot.
    twice = materialise(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "twice")
    found = materialise(found.join(twice, "gram"), "shared")
    contents = found.groupBy(*key).agg(
        (F.count("*") > 1).alias("copies"), F.min(F.struct("doc_id", "th", "start")).alias("at"), F.first("windows").alias("windows"), F.first("lead").alias("lead")
    )
    contents = materialise(contents, "contents")
    heavy = materialise(contents.groupBy("gram").agg(F.count("*").alias("kinds")).where(F.col("kinds") > most_of(length)).select("gram"), "heavy")
    # Each content is cut out of one text that has it.
    held, _ = split_by_keys(docs, contents.select("at.doc_id"))
    text = held.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw")).dropDuplicates(["d", "h"])
    cut = contents.groupBy("at.doc_id", "at.th").agg(F.collect_list(F.struct(*key, "copies", "lead", "at.start", "windows")).alias("want"))
    cut = cut.join(text, cut["doc_id"].eqNullSafe(text["d"]) & (cut["th"] == text["h"]))
    # Cut before it is exploded, or each row would carry the whole text.
    part = lambda w: F.struct(*(w[c].alias(c) for c in (*key, "copies", "lead")), F.substring("raw", w["start"] + 1, w["windows"] + (length - 1)).alias("content"))
    cut = materialise(cut.select(F.explode(F.transform("want", part)).alias("w")).select("w.*"), "cut")
    marks = dealt(cut.join(heavy, "gram", "left_anti"), length)
    if not heavy.isEmpty():
        marks = marks.unionByName(refined(cut.join(heavy, "gram"), length))
    return found.join(materialise(marks, "runs"), key).select(
        "doc_id", "th", F.explode("runs").alias("r"), "start"
    ).select("doc_id", "th", (F.col("start") + F.col("r.a")).alias("start"), (F.col("start") + F.col("r.b") + (length - 1)).alias("end"))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted ranges."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """The rows of docs with spans, the maximal byte ranges to remove, and kept, the bytes that stay.

    Columns of docs that are called spans or kept are replaced.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "spans", "kept")]
    packed = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.struct(F.lit(0).alias("none"))
    own = docs.select("doc_id", "text", packed.alias("rest"), F.xxhash64("text").alias("th"))
    marks = materialise(find(own.select("doc_id", "th", "text"), length), "marks")
    struck, clean = split_by_keys(own, marks.select("doc_id"))
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    none = F.array().cast("array<struct<start:int,end:int>>")
    clean = clean.select("doc_id", "text", "rest", none.alias("spans"), raw.alias("kept"))
    by_doc = marks.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    struck = struck.join(by_doc, struck["doc_id"].eqNullSafe(by_doc["d"]) & (struck["th"] == by_doc["h"]), "left").select("doc_id", "text", "rest", "ranges")
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, rest {own.schema['rest'].dataType.simpleString()}"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for t, ranges in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data, at, own, left = (t or "").encode(), 0, merged([(r["start"], r["end"]) for r in ranges or []]), []
                for a, b in own:
                    left.append(data[at:a])
                    at = b
                kept.append(b"".join([*left, data[at:]]))
                spans.append([{"start": a, "end": b} for a, b in own])
            cols = [*batch.columns[:3], pa.array(spans, span), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "rest", "spans", "kept"])

    cut = struck.mapInArrow(run, f"{kinds}, spans array<struct<start:int,end:int>>, kept binary")
    out = clean.unionByName(cut)
    named = {"doc_id": F.col("doc_id"), "text": F.col("text"), **{c: F.col("rest").getField(c).alias(c) for c in rest}}
    return out.select(*(named[c] for c in docs.columns if c in named), "spans", "kept")


def as_text(kept: Column) -> Column:
    """Bytes as a string: of a character that a span cut through, the rest goes too."""
    # Within UTF-8 text, only the ends of spans can leave such rests; one character in their place marks them.
    valid = F.make_valid_utf8(kept.cast("string"))
    return F.when(F.is_valid_utf8(kept.cast("string")), kept.cast("string")).otherwise(F.replace(valid, F.lit("\ufffd"), F.lit("")))
