"""Media columns: GIF frames as they are shown, with their timing and colour histograms.

The decoder reads any GIF87a or GIF89a stream: LZW codes of 2 to 8 bits a sample, global and local palettes,
interlacing, disposal (keep, clear, restore), transparency and delays. A frame is stored as the canvas that a viewer
shows: palettes applied, and put over what the frames before it have left. The encoder stores bytes without loss as
samples of 256 grey levels, in frames of WIDTH columns and at most ROWS rows.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

WIDTH, ROWS, UNIT = 192, 2048, 192
DELAY = 4  # hundredths of a second
GREY = bytes(v for i in range(256) for v in (i, i, i))
#: Most pixels of a canvas, 256 MB as RGBA; a header that asks for more raises ValueError.
PIXELS = 1 << 26
#: Equal parts of a colour channel in a histogram.
BINS = 8
#: Most entries of an LZW table, by the format.
FULL = 4096


class Frame(NamedTuple):
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    palette: np.ndarray  # colours x 3, uint8
    samples: np.ndarray  # height x width, uint8


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The LZW code stream of samples below 2 ** bits, from a clear code to an end code; the table is cleared when full."""
    clear = 1 << bits
    codes: list[int] = [clear << 8]
    runs: list[int] = []  # codes between clears
    put, start, free = codes.append, 1, clear + 2
    known: dict[int, int] = {}
    get = known.get
    it = iter(data)
    w = next(it, None)
    if w is not None:
        w <<= 8  # codes are held times 256, so that a key is a code and the next sample
        for b in it:
            if (found := get(w | b)) is not None:
                w = found
                continue
            put(w)
            if free < FULL:
                known[w | b] = free << 8
                free += 1
            else:
                put(clear << 8)
                runs.append(len(codes) - start)
                start, free = len(codes), clear + 2
                known.clear()
            w = b << 8
        put(w)
    put(clear + 1 << 8)
    runs.append(len(codes) - start)
    values = np.array(codes, dtype=np.uint32) >> np.uint32(8)
    return packed(values, code_widths(runs, bits))


def code_widths(runs: list[int], bits: int) -> np.ndarray:
    """Width of each code: the reader's table has one entry less than the writer's when it reads a code."""
    first = (1 << bits) + 2
    longest = max(runs)
    entries = np.minimum(first + np.maximum(np.arange(longest) - 1, -1), FULL - 1)
    widths = np.clip(np.floor(np.log2(np.maximum(entries, 1))).astype(np.uint32) + 1, bits + 1, 12)
    return np.concatenate([np.array([bits + 1], dtype=np.uint32), *(widths[:n] for n in runs)])


def packed(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes put one after the other, low bits first."""
    place = np.arange(16, dtype=np.uint8)
    each = np.unpackbits(values.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(each[place < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, bits: int, size: int) -> bytes:
    """The first `size` samples of a code stream; a shorter stream is filled with 0, a broken one raises ValueError."""
    clear, out = 1 << bits, bytearray()
    first = clear + 2
    raw = np.frombuffer(stream + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
    at, end = 0, len(stream) * 8
    # Widths depend only on the number of codes since the last clear, so a whole run is unpacked at once.
    entries = np.minimum(first + np.maximum(np.arange(FULL + 1) - 1, -1), FULL - 1)
    widths = np.clip(np.floor(np.log2(np.maximum(entries, 1))).astype(np.int64) + 1, bits + 1, 12)
    begins = np.concatenate([[0], np.cumsum(widths)])
    while at + bits < end and len(out) < size:
        pos = at + begins[:-1]
        n = int(np.searchsorted(pos + widths, end, side="right"))
        pos, byte = pos[:n], pos[:n] >> 3
        codes = raw[byte] | raw[byte + 1] << np.uint32(8) | raw[byte + 2] << np.uint32(16)
        codes = (codes >> (pos & 7).astype(np.uint32)) & ((1 << widths[:n]) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(stops[0]) if len(stops) else n
        expand(codes[:n].tolist(), first, out)
        if len(stops):
            at += int(begins[n + 1])
            if codes[n] == clear + 1:
                break
        elif n <= FULL:
            at += int(begins[n])
            if n < len(widths):
                break
            # a full table that is not cleared: the rest has 12 bits a code and adds no entry
            rest = raw_codes(raw, at, end)
            stops = np.flatnonzero((rest == clear) | (rest == clear + 1))
            m = int(stops[0]) if len(stops) else len(rest)
            expand(codes[:n].tolist() + rest[:m].tolist(), first, out, len(codes[:n]))
            at += 12 * (m + 1)
            if len(stops) and rest[m] == clear + 1:
                break
    return bytes(out[:size]).ljust(size, b"\0")


def raw_codes(raw: np.ndarray, at: int, end: int) -> np.ndarray:
    pos = np.arange(at, end - 11, 12)
    byte = pos >> 3
    codes = raw[byte] | raw[byte + 1] << np.uint32(8) | raw[byte + 2] << np.uint32(16)
    return (codes >> (pos & 7).astype(np.uint32)) & np.uint32(4095)


def expand(codes: list[int], first: int, out: bytearray, done: int = 0) -> None:
    """Appends the strings of one run of codes. The entry made after code k is its string and one sample more, so
    entries are slices of what has been put out; `done` codes of the run were put out before."""
    if done:  # rewind: their strings end the output
        ends, total = [], 0
        lengths: list[int] = []
        for c in codes[:done]:
            n = 1 if c < first else lengths[c - first] + 1
            lengths.append(n)
            total += n
        base = len(out) - total
        starts = [base]
        for n in lengths:
            starts.append(starts[-1] + n)
        del ends
        place = len(out)
        starts.pop()
    else:
        starts, place = [], len(out)
    mark = starts.append
    for c in codes[done:]:
        mark(place)
        if c < first:
            out.append(c)
            place += 1
        else:
            k = c - first
            try:
                begin, stop = starts[k], starts[k + 1] + 1
            except IndexError:
                raise ValueError("LZW code beyond its table") from None
            if stop <= place:
                out += out[begin:stop]
            else:  # the entry that is being made
                out += out[begin:place]
                out.append(out[begin])
            place += stop - begin


def blocks(data: bytes) -> bytes:
    """Data in sub-blocks of at most 255 bytes, with the closing empty one."""
    whole = len(data) // 255
    body = np.frombuffer(data[: whole * 255], dtype=np.uint8).reshape(whole, 255)
    out = np.concatenate([np.full((whole, 1), 255, dtype=np.uint8), body], axis=1).tobytes()
    rest = data[whole * 255 :]
    return out + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def store(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose frames, one after the other, hold the payload: a positive multiple of `width` bytes."""
    if not payload or len(payload) % width:
        raise ValueError(f"a payload is a positive multiple of {width} bytes")
    lines = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(lines, rows), 0xF7, 0, 0), GREY]
    for top in range(0, lines, rows):
        n = min(rows, lines - top)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, n, 0) + b"\x08")
        out.append(blocks(lzw_encode(payload[top * width : (top + n) * width])))
    return b"".join([*out, b"\x3b"])


def frames(gif: bytes) -> Iterator[Frame]:
    """Frames as they are stored, in order. Raises ValueError for bytes that are no GIF."""
    if gif[:6] not in (b"GIF87a", b"GIF89a") or len(gif) < 13:
        raise ValueError("no GIF header")
    flags, at = gif[10], 13
    shared = None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared, at = np.frombuffer(gif, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
    delay = disposal = 0
    transparent = None
    while at < len(gif) and gif[at] != 0x3B:
        if gif[at] == 0x21:
            label, (body, at) = gif[at + 1], joined(gif, at + 2)
            if label == 0xF9 and len(body) >= 4:
                delay, disposal = struct.unpack_from("<H", body, 1)[0] * 10, body[0] >> 2 & 7
                transparent = body[3] if body[0] & 1 else None
            continue
        if gif[at] != 0x2C:
            raise ValueError("unknown GIF block")
        left, top, width, height, flags = struct.unpack_from("<HHHHB", gif, at + 1)
        at += 10
        palette = shared
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette, at = np.frombuffer(gif, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
        if palette is None:
            raise ValueError("a frame without a palette")
        bits, (body, at) = gif[at], joined(gif, at + 1)
        samples = np.frombuffer(lzw_decode(body, bits, width * height), np.uint8).reshape(height, width)
        if flags & 0x40:
            order = [*range(0, height, 8), *range(4, height, 8), *range(2, height, 4), *range(1, height, 2)]
            straight = np.empty_like(samples)
            straight[order] = samples
            samples = straight
        yield Frame(left, top, width, height, delay, disposal, transparent, palette, samples)
        delay, disposal, transparent = 0, 0, None


def joined(gif: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(gif) and gif[at]:
        parts.append(gif[at + 1 : at + 1 + gif[at]])
        at += gif[at] + 1
    return b"".join(parts), at + 1


def shown(gif: bytes) -> Iterator[tuple[Frame, np.ndarray]]:
    """Each frame as it is stored, and the RGBA canvas that shows it: transparent samples leave what is there, and each
    frame's disposal holds before the next one. The canvas is one array; whoever keeps it copies it."""
    stored = frames(gif)
    first = next(stored, None)
    width, height = struct.unpack_from("<HH", gif, 6)
    if width * height > PIXELS:
        raise ValueError(f"a canvas of more than {PIXELS} pixels")
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    for f in itertools.chain((first,) if first else (), stored):
        box = (slice(f.top, min(f.top + f.height, height)), slice(f.left, min(f.left + f.width, width)))
        before = canvas[box].copy() if f.disposal == 3 else None
        part = f.samples[: max(0, height - f.top), : max(0, width - f.left)]
        colours = np.full((256, 4), 255, dtype=np.uint8)
        colours[: len(f.palette), :3] = f.palette
        colours[len(f.palette) :, :3] = f.palette[-1]
        if f.transparent is None:
            canvas[box] = colours[part]
        else:
            seen = part != f.transparent
            canvas[box][seen] = colours[part[seen]]
        yield f, canvas
        if f.disposal == 2:
            canvas[box] = 0
        elif before is not None:
            canvas[box] = before


def histograms(canvas: np.ndarray, bins: int = BINS) -> np.ndarray:
    """3 x bins counts of the red, green and blue of a canvas's visible pixels, in equal parts of 0 to 255."""
    pixels = canvas.reshape(-1, 4)
    if not pixels[:, 3].all():
        pixels = pixels[pixels[:, 3] > 0]
    level = np.arange(256) * bins // 256
    out = np.zeros((3, bins), dtype=np.int64)
    for c in range(3):
        np.add.at(out[c], level, np.bincount(pixels[:, c], minlength=256))
    return out


def payload_of(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    """A text as UTF-8, filled with spaces to a positive multiple of `unit`, and its own length; null is empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % unit if raw else unit), len(raw)


def media_row(text: str | None) -> tuple:
    payload, n = payload_of(text)
    gif = store(payload)
    h, total, crc, size, count, ms = hashlib.sha256(), np.zeros((3, BINS), dtype=np.int64), b"", 0, 0, 0
    for f, canvas in shown(gif):
        got = f.samples.tobytes()
        h.update(got)
        size += len(got)
        crc = (crc + got[-16:])[-16:]
        total += histograms(canvas)
        count += 1
        ms += f.delay_ms
    colours = ";".join(f"{name}={','.join(map(str, row))}" for name, row in zip(("red", "green", "blue"), total, strict=True))
    return n, size, h.hexdigest(), zlib.crc32(crc), len(gif), hashlib.sha256(gif).hexdigest(), f"frames={count};ms={ms};{colours}"


FIELDS = (
    ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
)


FRAMES = pa.schema([
    ("id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("disposal", pa.int32()), ("width", pa.int32()), ("height", pa.int32()),
    ("pixels", pa.binary()), ("samples", pa.binary()), *((c, pa.list_(pa.int64())) for c in ("red", "green", "blue")),
])


def media_frames(media: DataFrame) -> DataFrame:
    """(id, frame, start_ms, delay_ms, disposal, width, height, pixels, samples, red, green, blue): the frames of (id, gif)
    rows as they are shown, a row each. pixels is the canvas as RGBA bytes of height rows, samples the palette indices
    that the frame stores; red, green and blue count the visible pixels in BINS equal parts of the channel.

    Null and empty media have no frames; bytes that are no GIF raise ValueError; a null id stays null. An empty table
    gives an empty one. A batch holds one frame, so that memory is bounded by the largest canvas.
    """

    def read(batches):
        for b in batches:
            for key, gif in zip(b.column("id"), b.column("gif"), strict=True):
                start = 0
                for k, (f, canvas) in enumerate(shown(gif.as_py()) if gif.as_py() else ()):
                    row = [key.as_py(), k, start, f.delay_ms, f.disposal, canvas.shape[1], canvas.shape[0], canvas.tobytes(), f.samples.tobytes(), *histograms(canvas).tolist()]
                    yield pa.RecordBatch.from_pylist([dict(zip(FRAMES.names, row, strict=True))], schema=FRAMES)
                    start += f.delay_ms

    schema = "id long, frame int, start_ms long, delay_ms int, disposal int, width int, height int, pixels binary, samples binary, red array<long>, green array<long>, blue array<long>"
    return media.selectExpr("cast(id as long) id", "gif").mapInArrow(read, schema)


def encode_media(docs: DataFrame) -> DataFrame:
    """(id, gif) of every (doc_id, text) row; null text is stored as an empty one."""

    def write(batches):
        for b in batches:
            for key, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                made = [pa.array([key.as_py()], pa.int64()), pa.array([store(payload_of(text.as_py())[0])], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, ["id", "gif"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(write, "id long, gif binary")


def media_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), one row for each
    row of docs: its text stored as a GIF, read back, and features of what is shown.

    A null text is stored as an empty one, a payload of UNIT spaces; a null doc_id stays null; equal texts give equal
    values. Other columns don't matter. An empty table gives an empty one.
    """

    def digest(batches):
        for b in batches:
            columns = list(zip(*(media_row(t.as_py()) for t in b.column("text")), strict=True)) or [()] * len(FIELDS)
            made = [pa.array(c, k) for c, (_, k) in zip(columns, FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made], ["doc_id", *(n for n, _ in FIELDS)])

    kinds = {pa.int64(): "long", pa.string(): "string"}
    schema = "doc_id long, " + ", ".join(f"{n} {kinds[k]}" for n, k in FIELDS)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(digest, schema)


def op8_gif_media(spark, sf_dir):
    return media_digest(table(spark, sf_dir, "documents"))


def media_payload(spark, sf_dir):
    """What op8_gif_media has of the payload, which SQL can compute too."""
    return op8_gif_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


PAYLOAD_ORACLE = r"""
with texts as (
  select doc_id, encode(coalesce(text, '')) as b from documents
), sized as (
  select doc_id, b, octet_length(b) as n, case when octet_length(b) = 0 then 192 else (192 - octet_length(b) % 192) % 192 end as pad from texts
), padded as (
  select doc_id, n, n + pad as size, b || encode(repeat(' ', pad)) as p from sized
), tails as (
  select *, list_transform(range(0, 16), lambda i: ('0x' || substr(hex(p[size - 15:size]), (1 + 2 * i)::int, 2))::bigint) as tail from padded
)
select doc_id, n::bigint as n_bytes, size::bigint as payload_bytes, sha256(p) as payload_sha256,
  xor(4294967295, list_reduce(list_prepend(4294967295::bigint, tail), lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)),
    lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))::bigint as tail_crc32
from tails
"""
