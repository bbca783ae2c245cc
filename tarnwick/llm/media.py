"""Media columns: AVI files with motion-JPEG video, held in a binary column.

Payload bytes are stored without loss in the unit of the format, the quantised coefficient: a
macroblock of 8 x 8 pixels in three components has 192 of them, one for each byte, coded in the
size-8 category whose appended bits are the byte itself. Reading parses the RIFF index, decodes
the entropy-coded frames (baseline, any Huffman tables, all restart intervals of a batch in
step), and turns coefficients into luma by an exact integer transform. Shots are cut where the
difference of luma histograms exceeds the mean of the recent differences by three deviations.

Defined cases: a null text is an empty payload, which still has one macroblock of spaces; files
that are null, cut short or no AVI give null results; repeated rows are stored each; an empty
table gives no rows; further columns are ignored. A text is one file and is stored whole: the file is about 1.3
times as long and has to fit a binary cell of 2 GB, which bounds texts at 1.5 GB; such a cell fails, it is not cut.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192
COLUMNS, ROWS = 4, 2  # macroblocks of a frame, at most: 1,536 bytes, so that most texts have many frames
FPS = 25
BINS = 32
#: A cut needs this share of changed pixels at least, whatever the recent differences.
LEAST_CUT, RECENT = 0.05, 8
#: Zigzag order of an 8 x 8 block, by its rule: diagonals of alternating direction.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def pad(data: bytes) -> bytes:
    """Spaces are appended up to a positive multiple of the unit."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")


def grid(units: int) -> tuple[int, int, int]:
    """Columns and rows of macroblocks in a frame, and the number of frames."""
    columns = min(units, COLUMNS)
    rows = min(-(-units // columns), ROWS)
    return columns, rows, -(-units // (columns * rows))


@cache
def jpeg_head(columns: int, rows: int) -> bytes:
    segment = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    counts = lambda *n: bytes([*n, *[0] * (16 - len(n))])
    out = b"\xff\xd8" + segment(0xDB, b"\0" + bytes([1] * 64))
    out += segment(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3)))
    out += segment(0xC4, b"\0" + counts(1) + b"\x08") + segment(0xC4, b"\x10" + counts(1, 1) + b"\x08\x00")
    return out + segment(0xDD, struct.pack(">H", 1)) + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))


def encode_frames(payloads: list[bytes]) -> list[list[bytes]]:
    """The JPEG frames of each payload, whose lengths are multiples of the unit."""
    grids = [grid(len(p) // UNIT) for p in payloads]
    each = [c * r * f for c, r, f in grids]
    data = np.frombuffer(b"".join(p.ljust(n * UNIT, b"\0") for p, n in zip(payloads, each, strict=True)), np.uint8)
    bits = np.unpackbits(data).reshape(-1, 8)
    codes = np.zeros((len(bits), 9), np.uint8)  # the one-bit code 0, then the byte
    codes[:, 1:] = bits
    scan = np.packbits(codes.reshape(-1, 9 * UNIT), axis=1)
    per_frame = np.repeat([c * r for c, r, _ in grids], each)
    nth = np.arange(len(scan)) - np.repeat(np.cumsum(each) - each, each)
    nth %= per_frame
    marked = np.hstack([scan, np.full((len(scan), 1), 255, np.uint8), (0xD0 + nth % 8).astype(np.uint8)[:, None]])
    times = np.ones(marked.shape, np.uint8)
    times[:, :-2] += scan == 255  # a zero is stuffed after each 255
    times[nth == per_frame - 1, -2:] = 0  # no restart mark after the last macroblock
    flat = times.ravel()
    out = np.repeat(marked.ravel(), flat)
    ends = np.cumsum(flat, dtype=np.int64)
    out[ends[flat == 2] - 1] = 0
    ends = ends.reshape(times.shape)[:, -1]
    raw, frames, at, upto = out.tobytes(), [], 0, 0
    for c, r, f in grids:
        head, own = jpeg_head(c, r), []
        for _ in range(f):
            upto += c * r
            own.append(head + raw[at : (at := int(ends[upto - 1]))] + b"\xff\xd9")
        frames.append(own)
    return frames


def write_avi(frames: list[bytes], width: int, height: int, comment: str) -> bytes:
    """A RIFF AVI file with one MJPG stream and an index."""
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    info = b"INFO" + chunk(b"ICMT", comment.encode() + b"\0")
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        movi.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    body = b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", info) + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def parse_avi(data: bytes) -> tuple[list[bytes], str, float]:
    """The frames that the index names, the comment, and seconds per frame; ValueError if it is no AVI."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI")
    comment, seconds, movi, index = "", 1 / FPS, None, None
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
                movi = at + 8
            elif name == b"LIST":
                todo.append((at + 12, min(end, at + 8 + size)))
            elif name == b"avih":
                seconds = struct.unpack_from("<I", data, at + 8)[0] / 1e6
            elif name == b"ICMT":
                comment = data[at + 8 : at + 8 + size].rstrip(b"\0").decode("utf-8", "replace")
            elif name == b"idx1":
                index = [struct.unpack_from("<4sIII", data, i) for i in range(at + 8, min(end, at + 8 + size) - 15, 16)]
            at += 8 + size + size % 2
    if movi is None or index is None:
        raise ValueError("no frames or no index")
    # Offsets are from `movi`, or in some files from the start of the file.
    first = next((i for i in index if i[0][2:] == b"dc"), None)
    base = 0 if first and data[first[2] : first[2] + 4] == first[0] else movi
    frames = [data[base + at + 8 : base + at + 8 + size] for name, _, at, size in index if name[2:] in (b"dc", b"db")]
    return frames, comment, seconds


@cache
def huffman(spec: bytes) -> np.ndarray:
    """For each 16 bits ahead: length of the code << 8 | symbol, 0 where no code fits."""
    out, code, at = np.zeros(1 << 16, np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            low = code << 16 - length
            out[low : low + (1 << 16 - length)] = length << 8 | spec[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def parse_jpeg(data: bytes) -> dict:
    """Size, components, tables, restart interval and scan of a baseline frame."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, tables, quant, every, size, parts = 2, {}, {}, 0, None, []
    while at + 4 <= len(data):
        mark, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("16-bit quantisation")
                quant[body[0] & 15], body = body[1:65], body[65:]
        elif mark == 0xC4:
            while body:
                k = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:k], body[k:]
        elif mark == 0xC0:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            size = (width, height)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif mark == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            end = data.rfind(b"\xff\xd9")
            if size is None:
                raise ValueError("a scan before its frame")
            h, v = max(p[1] for p in parts), max(p[2] for p in parts)
            units = (-(-size[0] // (8 * h)), -(-size[1] // (8 * v)))
            plan = tuple((i, tables[chosen[c] >> 4], tables[16 | chosen[c] & 15]) for i, (c, a, b, _) in enumerate(parts) for _ in range(a * b))
            return {"size": size, "units": units, "plan": plan, "every": every, "scan": data[at : end if end > at else len(data)], "quant": tuple(quant[p[3]] for p in parts), "parts": parts}
    raise ValueError("no scan")


def decode_scans(scans: list[bytes], units: list[int], every: int, plan: tuple) -> list[np.ndarray]:
    """Coefficients (macroblocks, blocks, 64 in zigzag order) of scans with the same tables.

    Each restart interval is one lane; all lanes of a batch go on by one symbol at a time.
    """
    if not scans:
        return []
    raw = np.frombuffer(b"".join(scans), np.uint8)
    first = np.cumsum([0, *map(len, scans)])
    after = np.append(raw[1:], 0)
    full = raw == 255
    restart = full & (after >= 0xD0) & (after <= 0xD7)
    restart[first[1:] - 1] = False
    stuffed = np.append(False, full[:-1]) & (raw == 0)
    stuffed[first[:-1][first[:-1] < len(raw)]] = False
    gone = stuffed | restart | np.append(False, restart[:-1])
    clean = raw[~gone]
    moved = np.append(0, np.cumsum(~gone))
    starts = np.sort(np.concatenate([first[:-1], np.flatnonzero(restart) + 2]))
    lanes_of = np.diff(np.searchsorted(starts, first))
    todo = np.concatenate([np.full(n, u) if not every else np.minimum(every, u - every * np.arange(n)) for u, n in zip(units, lanes_of, strict=True)])
    if (todo <= 0).any() or sum(units) != todo.sum():
        raise ValueError("restart marks do not fit the frame")
    base = np.cumsum(todo) - todo
    blocks = len(plan)
    out = np.zeros((int(todo.sum()) * blocks, 64), np.int16)
    lanes = 8192
    for a in range(0, len(todo), lanes):
        _lockstep(clean, moved[starts[a : a + lanes]], todo[a : a + lanes] * blocks, base[a : a + lanes] * blocks, plan, out)
    cuts = np.cumsum(units)[:-1] * blocks
    return [x.reshape(-1, blocks, 64) for x in np.split(out, cuts)]


def _lockstep(clean: np.ndarray, start: np.ndarray, todo: np.ndarray, base: np.ndarray, plan: tuple, out: np.ndarray) -> None:
    data = np.append(clean[start[0] :], np.zeros(16, np.uint8))
    ahead = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))
    dc, ac = (np.stack([huffman(p[k]) for p in plan]) for k in (1, 2))
    same = all(p[1:] == plan[0][1:] for p in plan)
    part = np.array([p[0] for p in plan])
    bit = (start - start[0]).astype(np.int64) * 8
    block, k = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    last = np.zeros((len(start), part.max() + 1), np.int64)
    live = np.arange(len(start))
    flat = out.reshape(-1)
    while len(live):
        b, z, p = block[live], k[live], bit[live]
        at = p >> 3
        if (at >= len(ahead)).any():
            raise ValueError("the scan is cut short")
        word = ahead[at].astype(np.uint64) << (p & 7).astype(np.uint64)
        code = (word >> np.uint64(48)).astype(np.int64)
        is_dc = z == 0
        which = 0 if same else b % len(plan)
        if is_dc.all():
            found = dc[which, code]
        elif not is_dc.any():
            found = ac[which, code]
        else:
            found = np.where(is_dc, dc[which, code], ac[which, code])
        if not found.all():
            raise ValueError("no such code")
        length, run, size = found >> 8, found >> 4 & 15, found & 15
        extra = (word << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)
        value = extra.astype(np.int64)
        value = np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)
        bit[live] = p + length + size
        if is_dc.any():
            d = np.flatnonzero(is_dc)
            who = part[b[d] % len(plan)]
            last[live[d], who] += value[d]
            value[d] = last[live[d], who]
            run[d] = 0
        z = z + run
        put = (size > 0) | is_dc
        if (z[put] > 63).any():
            raise ValueError("a block runs over")
        row = base[live] + b
        if put.all():
            flat[row * 64 + z] = value
        else:
            flat[(row * 64 + z)[put]] = value[put]
        z = z + 1
        ends = (z > 63) | (~is_dc & (size == 0) & (run < 15))
        k[live] = np.where(ends, 0, z)
        block[live] = b + ends
        if ends.any():
            live = live[block[live] < todo[live]]


@cache
def _basis() -> np.ndarray:
    """The inverse transform of 64 coefficients in zigzag order, in integers of 1 / 8192."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    whole = np.einsum("xu,yv->uvxy", one, one).reshape(64, 64)
    return np.round(whole[ZIGZAG] * 8192)


def luma(coefficients: np.ndarray, quant: bytes) -> np.ndarray:
    """Pixels 0 to 255 of blocks (n, 64); all products are whole numbers below 2**53, so exact."""
    acc = (coefficients.astype(np.float64) * np.frombuffer(quant, np.uint8)) @ _basis()
    return np.clip((acc.astype(np.int64) + 4096 >> 13) + 128, 0, 255).astype(np.uint8)


def cuts(histograms: np.ndarray) -> list[int]:
    """First frames of shots after the first, from histograms (frames, bins) that sum to 1."""
    diffs = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    found, since = [], 0
    for i, d in enumerate(diffs):
        recent = diffs[max(since, i - RECENT) : i]
        limit = max(LEAST_CUT, recent.mean() + 3 * recent.std()) if len(recent) > 1 else max(LEAST_CUT, 0.5)
        if d > limit:
            found.append(i + 1)
            since = i + 1
    return found


def decode_videos(files: list[bytes | None]) -> list[dict | None]:
    """For each AVI: comment, seconds per frame, frames as parsed, their coefficients and luma histograms."""
    parsed: list[dict | None] = []
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for i, data in enumerate(files):
        try:
            frames, comment, seconds = parse_avi(data or b"")
            video = {"comment": comment, "seconds": seconds, "frames": [parse_jpeg(f) for f in frames]}
        except (ValueError, KeyError, IndexError, struct.error):
            parsed.append(None)
            continue
        parsed.append(video | {"coefficients": [None] * len(frames), "histograms": np.zeros((len(frames), BINS))})
        for j, f in enumerate(video["frames"]):
            groups.setdefault((f["every"], f["plan"], f["quant"]), []).append((i, j))
    for (every, plan, quant), own in groups.items():
        todo = [parsed[i]["frames"][j] for i, j in own]
        try:
            got = decode_scans([f["scan"] for f in todo], [f["units"][0] * f["units"][1] for f in todo], every, plan)
        except ValueError:  # one of them is damaged: each on its own
            got = []
            for f in todo:
                try:
                    got += decode_scans([f["scan"]], [f["units"][0] * f["units"][1]], every, plan)
                except ValueError:
                    got.append(None)
        luma_blocks = [n for n, p in enumerate(plan) if p[0] == 0]
        for (i, j), c in zip(own, got, strict=True):
            if c is None:
                parsed[i] = None
            elif parsed[i] is not None:
                parsed[i]["coefficients"][j] = c
        fine = [(i, j, c) for (i, j), c in zip(own, got, strict=True) if c is not None and parsed[i] is not None]
        if fine:
            pixels = luma(np.concatenate([c[:, luma_blocks].reshape(-1, 64) for _, _, c in fine]), quant[0])
            rows = np.repeat(np.arange(len(fine)), [len(c) * len(luma_blocks) for _, _, c in fine])
            counts = np.bincount((rows[:, None] * BINS + (pixels >> 3)).ravel(), minlength=len(fine) * BINS).reshape(-1, BINS)
            for (i, j, _), h in zip(fine, counts / counts.sum(axis=1, keepdims=True), strict=True):
                parsed[i]["histograms"][j] = h
    return parsed


def payload_of(video: dict) -> bytes:
    """The bytes that `store` put into a video."""
    n = int(re.search(r"payload=(\d+)", video["comment"])[1])
    value = np.concatenate([c.reshape(-1) for c in video["coefficients"]])
    return np.where(value > 0, value, value + 255).astype(np.uint8).tobytes()[:n]


def clips_of(video: dict) -> list[dict]:
    n, s = len(video["frames"]), video["seconds"]
    edges = [0, *cuts(video["histograms"]), n]
    return [{"clip": i, "start_s": a * s, "end_s": b * s, "frames": b - a} for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]


def pieces(sizes: list[int], most: int = 2 << 20) -> Iterator[slice]:
    """Runs of rows of about `most` bytes: what is unfolded at a time."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield slice(at, i + 1)
            at, total = i + 1, 0
    if at < len(sizes):
        yield slice(at, len(sizes))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the AVI file, for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for part in pieces([len(t) for t in texts]):
                full = [pad(t) for t in texts[part]]
                media = []
                for data, frames in zip(full, encode_frames(full), strict=True):
                    c, r, _ = grid(len(data) // UNIT)
                    media.append(write_avi(frames, 8 * c, 8 * r, f"payload={len(data)}"))
                sizes = pa.array([len(t) for t in texts[part]], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], sizes, pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def clip_rows(videos: DataFrame) -> DataFrame:
    """A row for each clip of what `read` gives: doc_id, clip, start_s, end_s, frames; none for a file that is no video."""
    return videos.select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.clip", "c.start_s", "c.end_s", "c.frames")


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<struct<clip:int,start_s:double,end_s:double,frames:int>>"


def read(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and what is read back from media: payload figures and timed clips."""
    kinds = pa.list_(pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(2).to_pylist()
            for part in pieces([len(m or b"") for m in media]):
                own, rows = media[part], []
                for data, video in zip(own, decode_videos(own), strict=True):
                    if video is None:
                        rows.append((None, None, None, None if data is None else len(data), None, None))
                        continue
                    load = payload_of(video)
                    rows.append((len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-16:]), len(data), hashlib.sha256(data).hexdigest(), clips_of(video)))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), kinds), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part.start : part.stop], batch.column(1)[part.start : part.stop], *cols],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"],
                )

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, n_bytes long, {READ}")
