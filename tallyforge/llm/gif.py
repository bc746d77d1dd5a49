"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames.

``parse`` and ``compose`` read any GIF (87a and 89a): global and local palettes,
interlaced rows, transparent colours, the disposal rules and delays.  Images are
decoded one at a time, and a canvas or image of more than ``MAX_PIXELS`` is refused,
so memory is bounded whatever a header claims.  ``encode_samples`` stores bytes
losslessly as 8-bit samples: an identity grey palette, frames of ``WIDTH`` columns
and at most ``ROWS`` rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH, ROWS = 192, 256
DELAY_CS = 4
FULL = 4096  # codes have 12 bits at most
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
#: First row and step of each interlace pass.
INTERLACE = ((0, 8), (4, 8), (2, 4), (1, 2))
BINS = 16
#: Largest canvas and image, in pixels (64 MB as RGBA).
MAX_PIXELS = 1 << 24


def _widths(first_free: int, n: int, least: int) -> np.ndarray:
    """Bits of the k-th code after a clear code: the table grows by one a code, from the second code on."""
    free = np.minimum(first_free - 1 + np.arange(n), FULL - 1)
    free[:1] = first_free
    return np.maximum(np.frexp(free.astype(np.float64))[1], least).astype(np.int64)


_ENCODE_WIDTHS = _widths(258, FULL - 258 + 1, 9)


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    ends = np.cumsum(widths)
    starts = ends - widths
    shifted = codes << (starts & 7)
    at = starts >> 3
    out = np.zeros((int(ends[-1]) + 7 >> 3) + 3)
    for k in range(3):
        out[: len(out)] += np.bincount(at + k, weights=(shifted >> 8 * k) & 255, minlength=len(out))
    return out[:-3].astype(np.uint8).tobytes()


def lzw_encode(samples: bytes) -> bytes:
    """The code stream of 8-bit samples: a clear code first and whenever the table is full."""
    codes, widths = [256], [np.array([9])]
    table: dict[int, int] = {}
    free = 258
    append, get = codes.append, table.get
    stream = iter(samples)
    run = next(stream, None)
    begin = 1
    if run is not None:
        for b in stream:
            key = run << 8 | b
            code = get(key)
            if code is not None:
                run = code
                continue
            append(run)
            table[key] = free
            free += 1
            run = b
            if free == FULL:
                append(256)
                widths.append(_ENCODE_WIDTHS[: len(codes) - begin])
                begin = len(codes)
                table.clear()
                free = 258
        append(run)
    append(257)
    widths.append(_ENCODE_WIDTHS[: len(codes) - begin])
    return _pack(np.array(codes, dtype=np.int64), np.concatenate(widths))


def lzw_decode(data: bytes, code_size: int, n: int) -> bytes:
    """The first ``n`` samples of a code stream; raises ValueError if it is damaged or too short."""
    clear, end = 1 << code_size, (1 << code_size) + 1
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    bits = 8 * len(data)
    widths = _widths(end + 1, FULL, code_size + 1)
    starts = np.concatenate(([0], np.cumsum(widths)))
    literals = [bytes([i]) for i in range(clear)] + [b"", b""]
    table: list[bytes] = []
    out: list[bytes] = []
    have, at, fresh, prev = 0, 0, True, b""
    while have < n:
        if fresh:
            k = int(np.searchsorted(starts, bits - at, side="right")) - 1
            where, wide = at + starts[:k], widths[:k]
        else:  # the table is full and no clear code came: codes of 12 bits go on
            k = min(FULL, (bits - at) // 12)
            where, wide = at + 12 * np.arange(k), np.full(k, 12)
        if k <= 0:
            raise ValueError("the code stream ends early")
        byte = where >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (where & 7)) & ((1 << wide) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else k
        begin = 0
        if fresh and stop:
            table = literals.copy()
            if codes[0] >= clear:
                raise ValueError("a code before its entry")
            prev = table[codes[0]]
            out.append(prev)
            have += 1
            begin = 1
        append, add = out.append, table.append
        size = len(table)
        for c in codes[begin:stop].tolist():
            if c < size:
                entry = table[c]
            elif c == size < FULL:
                entry = prev + prev[:1]
            else:
                raise ValueError("a code beyond the table")
            append(entry)
            have += len(entry)
            if size < FULL:
                add(prev + entry[:1])
                size += 1
            prev = entry
        if stop < k:
            if codes[stop] == end:
                break
            at, fresh = int(where[stop] + wide[stop]), True
        else:
            at, fresh = int(where[-1] + wide[-1]), False
            if size < FULL:
                raise ValueError("the code stream ends early")
    if have < n:
        raise ValueError("the code stream ends early")
    return b"".join(out)[:n]


@dataclass
class Image:
    """``codes`` is the image's code stream; ``indices`` decodes it."""

    left: int
    top: int
    width: int
    height: int
    palette: np.ndarray
    code_size: int
    codes: bytes
    interlaced: bool = False
    delay_ms: int = 0
    disposal: int = 0
    transparent: int | None = None

    def indices(self) -> np.ndarray:
        rows = np.frombuffer(lzw_decode(self.codes, self.code_size, self.width * self.height), np.uint8).reshape(self.height, self.width)
        if not self.interlaced:
            return rows
        return rows[np.argsort(np.concatenate([np.arange(first, self.height, step) for first, step in INTERLACE]))]


@dataclass
class Gif:
    width: int
    height: int
    loops: int | None = None
    images: list[Image] = field(default_factory=list)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while size := data[at]:
        out.append(data[at + 1 : at + 1 + size])
        at += 1 + size
    return b"".join(out), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def parse(data: bytes) -> Gif:
    """The file's structure, code streams not decoded yet; raises ValueError if it is damaged or claims too many pixels."""
    try:
        return _parse(data)
    except (IndexError, struct.error) as e:
        raise ValueError("the file ends early") from e


def _parse(data: bytes) -> Gif:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF signature")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    common_palette, at = _palette(data, 13, flags)
    gif, control = Gif(width, height), (0, 0, None)
    while (kind := data[at]) != 0x3B:
        at += 1
        if kind == 0x21:
            label = data[at]
            body, at = _blocks(data, at + 1)
            if label == 0xF9:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                control = delay * 10, packed >> 2 & 7, index if packed & 1 else None
            elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                gif.loops = struct.unpack_from("<H", body, 12)[0]
        elif kind == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
            palette, at = _palette(data, at + 9, flags)
            palette = common_palette if palette is None else palette
            code_size = data[at]
            if palette is None or not 2 <= code_size <= 8:
                raise ValueError("no palette" if palette is None else "bad code size")
            body, at = _blocks(data, at + 1)
            gif.images.append(Image(left, top, w, h, palette, code_size, body, bool(flags & 0x40), *control))
            control = (0, 0, None)
        else:
            raise ValueError("an unknown block")
    return gif


def canvas_size(gif: Gif) -> tuple[int, int]:
    """Height and width that hold the screen and every image; ValueError beyond ``MAX_PIXELS``."""
    height = max([gif.height, *(i.top + i.height for i in gif.images)])
    width = max([gif.width, *(i.left + i.width for i in gif.images)])
    if height * width > MAX_PIXELS:
        raise ValueError(f"a canvas of {width} x {height} pixels")
    return height, width


def compose(gif: Gif) -> Iterator[tuple[Image, np.ndarray]]:
    """Each image with the RGBA canvas as shown while it lasts; the array is reused.

    After its time an image stays (disposal 0 and 1), its area becomes transparent (2),
    or what was there before comes back (3).  Indices beyond the palette and the
    transparent index draw nothing.
    """
    canvas = np.zeros((*canvas_size(gif), 4), np.uint8)
    for image in gif.images:
        area = canvas[image.top : image.top + image.height, image.left : image.left + image.width]
        before = area.copy() if image.disposal == 3 else None
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(image.palette), :3] = image.palette
        colours[: len(image.palette), 3] = 255
        if image.transparent is not None:
            colours[image.transparent, 3] = 0
        drawn = colours[image.indices()]
        if colours[:, 3].all():
            area[:] = drawn
        else:
            np.copyto(area, drawn, where=drawn[..., 3:] > 0)
        yield image, canvas
        if image.disposal == 2:
            area[:] = 0
        elif before is not None:
            area[:] = before


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Counts of visible pixels: ``BINS`` equal ranges for red, then green, then blue."""
    seen = pixels.reshape(-1, 4)
    if not seen[:, 3].all():
        seen = seen[seen[:, 3] > 0]
    return np.concatenate([np.bincount(seen[:, c], minlength=256).reshape(BINS, -1).sum(1) for c in range(3)])


def encode_samples(payload: bytes) -> bytes:
    """A looping animation whose images, one after another, hold the payload's bytes as grey levels.

    The payload's length must be a positive multiple of WIDTH.
    """
    rows, rest = divmod(len(payload), WIDTH)
    if rest or not rows:
        raise ValueError(f"a payload takes a positive multiple of {WIDTH} bytes")
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), GREY.tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for first in range(0, rows, ROWS):
        n = min(ROWS, rows - first)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY_CS, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, n, 0) + b"\x08")
        codes = lzw_encode(payload[first * WIDTH : (first + n) * WIDTH])
        out += [bytes([len(x := codes[i : i + 255])]) + x for i in range(0, len(codes), 255)]
        out.append(b"\0")
    return b"".join(out) + b"\x3b"


class Frame(NamedTuple):
    """One shown frame: its number, when and how long it shows, its image's area, and counts of the canvas's visible pixels by colour."""

    frame: int
    start_ms: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    hist_r: list[int]
    hist_g: list[int]
    hist_b: list[int]


_INT = ("left", "top", "width", "height", "disposal")
FRAME = "frame: int, start_ms: bigint, delay_ms: int, " + ", ".join(f"{n}: int" for n in _INT) + ", hist_r: array<bigint>, hist_g: array<bigint>, hist_b: array<bigint>"
_FRAME = pa.struct([("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), *((n, pa.int32()) for n in _INT), *((f"hist_{c}", pa.list_(pa.int64())) for c in "rgb")])


def frames(data: bytes) -> Iterator[tuple[Frame, Image, np.ndarray]]:
    """The timed frames of a file, one decoded at a time, with image and canvas."""
    at = 0
    for k, (image, canvas) in enumerate(compose(parse(data))):
        h = histogram(canvas)
        yield Frame(k, at, image.delay_ms, image.left, image.top, image.width, image.height, image.disposal, *(h[c * BINS : (c + 1) * BINS].tolist() for c in range(3))), image, canvas
        at += image.delay_ms


TIMED_FRAMES = "media_id long, " + FRAME.replace(": bigint", " long").replace(": ", " ") + ", canvas_width int, canvas_height int, rgba binary, error string"


def timed_frames(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per frame of each GIF: when it is shown, its area, colour histograms and the composed RGBA canvas.

    Null media gives no row.  A damaged file, or one that claims more than
    ``MAX_PIXELS`` or memory cannot hold, gives the frames before the fault and one
    row with ``error`` set and no frame.  Repeated rows give repeated frames; extra
    columns are not read.
    """
    rows = media.select(F.col(id_col).cast("long").alias("k"), F.col(media_col).cast("binary").alias("m"))
    schema = pa.schema([("media_id", pa.int64()), *_FRAME, ("canvas_width", pa.int32()), ("canvas_height", pa.int32()), ("rgba", pa.binary()), ("error", pa.string())])
    row = lambda *values: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def decode(batches):
        for b in common.rows_of(batches, 1):
            key, data = b.column(0)[0].as_py(), b.column(1)[0].as_py()
            if data is None:
                continue
            try:
                for frame, _, canvas in frames(data):
                    yield row(key, *frame, canvas.shape[1], canvas.shape[0], canvas.tobytes(), None)
            except (ValueError, MemoryError) as e:
                yield row(key, *[None] * (len(schema) - 2), str(e) or "out of memory")

    return rows.mapInArrow(decode, TIMED_FRAMES)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts as GIF media: doc_id, n_bytes, media.  Null text is empty; every text is padded with spaces to whole rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))

    def encode(batches):
        for b in common.rows_of(batches, 64):
            texts = common.texts_as_bytes(b.column(1))
            media = [encode_samples(t.ljust(max(1, -(-len(t) // WIDTH)) * WIDTH, b" ")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(encode, "doc_id long, n_bytes long, media binary")


_DIGESTS = (("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()))
DECODED = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames array<struct<{FRAME}>>, error string"


def decode_stored(stored: DataFrame) -> DataFrame:
    """Decodes stored media (as ``store_texts`` gives it): digests of payload and media, and ``frames``, its timed frames with colour histograms.

    The payload is read from the composed frames.  ``explode`` of ``frames`` gives a row a frame.
    Null, damaged or too large media give a row with ``error`` set and nothing decoded.
    """

    def decode(batches):
        for b in common.rows_of(batches, 64):
            out, of, errors = [], [], []
            for media in b.column("media").to_pylist():
                digest, n, tail, own, error = hashlib.sha256(), 0, b"", [], None
                try:
                    if media is None:
                        raise ValueError("no media")
                    for frame, image, canvas in frames(media):
                        part = canvas[image.top : image.top + image.height, image.left : image.left + image.width, 0].tobytes()
                        digest.update(part)
                        n, tail = n + len(part), (tail + part[-16:])[-16:]
                        own.append(frame._asdict())
                except (ValueError, MemoryError) as e:
                    error, own = str(e) or "out of memory", None
                of.append(own)
                errors.append(error)
                payload = (None, None, None) if error else (n, digest.hexdigest(), zlib.crc32(tail))
                out.append((*payload, *((None, None) if media is None else (len(media), hashlib.sha256(media).hexdigest()))))
            columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*out, strict=True), _DIGESTS, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *columns, pa.array(of, pa.list_(_FRAME)), pa.array(errors, pa.string())], names=["doc_id", "n_bytes", *(n for n, _ in _DIGESTS), "frames", "error"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(decode, DECODED)


def features(decoded: DataFrame) -> DataFrame:
    """Per document its digests and ``feature``: frames, time shown, and the frames' histograms summed by colour."""
    add = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    none = F.array_repeat(F.lit(0).cast("long"), BINS)
    total = lambda c: F.aggregate(F.col(f"frames.hist_{c}"), none, add)
    shown = F.aggregate(F.col("frames.delay_ms"), F.lit(0).cast("long"), lambda a, b: a + b)
    text = [F.concat(F.lit(f";{c}="), F.array_join(total(c).cast("array<string>"), ".")) for c in "rgb"]
    feature = F.concat(F.lit("frames="), F.size("frames").cast("string"), F.lit(";ms="), shown.cast("string"), *text)
    return decoded.select("doc_id", "n_bytes", *(n for n, _ in _DIGESTS), feature.alias("feature"))
