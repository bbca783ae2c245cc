"""Fill-in-middle: a text is cut at two of its unit bounds and its parts are put into another order.

A unit is a run of ASCII letters or one other code point. The bytes of a text become two masks,
one bit a byte: letters, and bytes that carry a code point on (`bytes.translate`, then one
conversion to an integer). Shifts and boolean operations over these integers mark the bytes at which
units start, all at once; `bit_count` is the number of units; the byte at which the k-th of them starts
is found by halving the integer again and again, so a cut costs two passes over an eighth of the text.

Defined cases: a null text is empty; an empty text, and one that holds a marker itself, stays plain;
texts of any length are cut whole (the masks take a quarter of a text's bytes beside two of its
length while they are made); equal rows give equal results and are all returned; a null key draws
as an empty one; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
_LETTERS = bytes(b"01"[(65 <= b <= 90) | (97 <= b <= 122)] for b in range(256))
_CARRIED = bytes(b"01"[b & 0xC0 == 0x80] for b in range(256))


def unit_starts(raw: bytes) -> int:
    """Bit i is set where a unit starts at byte i of raw, which is UTF-8."""
    if not raw:
        return 0
    back = raw[::-1]  # the first byte is to be the lowest bit
    letters, carried = int(back.translate(_LETTERS), 2), int(back.translate(_CARRIED), 2)
    return ((1 << len(raw)) - 1) & ~(carried | letters & letters << 1)


def ranked(bits: int, width: int, ranks: list[int]) -> list[int]:
    """The places of the set bits with these ranks (rising, from 0; each less than the bits set) in an integer of so many bits."""
    if not ranks:
        return []
    if width == 1:
        return [0] * len(ranks)
    half = width >> 1
    low = bits & ((1 << half) - 1)
    n = low.bit_count()
    upper = [half + p for p in ranked(bits >> half, width - half, [r - n for r in ranks if r >= n])]
    return ranked(low, half, [r for r in ranks if r < n]) + upper


def cut(raw: bytes, draw1: int, draw2: int) -> tuple[int, int, int]:
    """(units, end of prefix, end of middle), the latter in bytes, by the draws' remainders."""
    starts = unit_starts(raw)
    n = starts.bit_count()
    first, second = sorted((draw1 % (n + 1), draw2 % (n + 1)))
    ends = ranked(starts, len(raw), [r for r in (first, second) if r < n])
    return n, *(ends + [len(raw)] * (2 - len(ends)))


def transform(docs: DataFrame, key: str = "doc_id", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """key, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output for every row of docs (key, text).

    Draws are the leading 32-bit groups of sha256 of `seed:key`: two for the cuts, one for plain, one for the order.
    """
    if len(set(markers)) < 3 or any(len(m) < 3 or m[0] != "<" or m[-1] != ">" or set("<>") & set(m[1:-1]) for m in markers):
        raise ValueError("markers have to be three different strings in angle brackets")  # so none can arise where a marker meets a text
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"draw{i}") for i in range(4)]
    p, s, m = (x.encode() for x in markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = at = 0
            for i, (text, d0, d1, d2, d3) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                raw = (text or "").encode()
                n, a, b = cut(raw, d0, d1)
                if not raw or d2 % 100 >= 100 - plain_percent or p in raw or s in raw or m in raw:
                    rows.append((n, "plain", None, None, raw))
                else:
                    spm = d3 % 100 < spm_percent
                    whole = (s, raw[b:], p, raw[:a], m, raw[a:b]) if spm else (p, raw[:a], s, raw[b:], m, raw[a:b])
                    rows.append((n, "spm" if spm else "psm", len(raw[:a].decode()), len(raw[a:b].decode()), b"".join(whole)))
                size += len(raw)
                if size > 4 << 20 or i + 1 == batch.num_rows:
                    n_, form, left, mid, out = zip(*rows, strict=True)
                    values = [pa.array(n_, pa.int64()), pa.array(form, pa.string()), pa.array(left, pa.int64()), pa.array(mid, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[at : i + 1], *values], ["key", "n", "form", "prefix_chars", "middle_chars", "output"])
                    rows, size, at = [], 0, i + 1

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), "text", *draws).mapInArrow(run, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("key", key)


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of this form was made of."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in markers), -1)
    order = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).otherwise(order)
