"""GIF columns: code streams, palettes, disposal, transparency and timed frames.

``encode`` writes indexed frames, ``decode`` reads any GIF87a or GIF89a, and ``frames`` turns a column of
files into one row for each shown frame. The payload form stores bytes as palette indices, 64 to a line,
under a grey palette, so that the composed red channel is the payload.

Null and empty texts have a payload of 64 zero bytes. Payloads over ``FRAME_ROWS`` lines become several
frames. A broken file raises BadGif. Equal texts give equal files, so repeated rows have equal columns; a null
id stays null. A very long text is one file of many frames. Only the id and the text are read, so further columns
can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices

WIDTH, FRAME_ROWS = 64, 4096
FULL = 4096  # codes have twelve bits at most


class BadGif(ValueError):
    """A file that breaks the format."""


# -- code streams ------------------------------------------------------------------------------------------


def widths(n: int, bits: int) -> np.ndarray:
    """Widths of the first ``n`` codes after a clear code: the i-th is read when the table has clear + 2 + max(i - 1, 0) entries."""
    return all_widths(1 << max(n, 1).bit_length(), bits)[:n]


@lru_cache(64)
def all_widths(n: int, bits: int) -> np.ndarray:
    filled = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(np.maximum(np.floor(np.log2(filled)).astype(np.int64) + 1, bits + 1), 12)


def pack_codes(codes: np.ndarray, sizes: np.ndarray) -> bytes:
    """The codes as a stream of bits, least first. A code touches three bytes at most; its bits there are its own, so sums are unions."""
    ends = np.cumsum(sizes)
    begin = ends - sizes
    value, byte, n = codes << (begin & 7), begin >> 3, (int(ends[-1]) + 7) // 8
    whole = sum(np.bincount(byte + i, value >> 8 * i & 255, n + 3) for i in range(3))
    return whole[:n].astype(np.uint8).tobytes()


def compress(data: bytes, bits: int = 8) -> bytes:
    """The LZW code stream of ``data``, whose values are below 2 ** bits; the table is cleared when full."""
    clear = 1 << bits
    runs, run = [], []  # codes between clear codes
    push, table, free, prefix = run.append, {}, clear + 2, -1
    find = table.get
    for value in data:
        if prefix < 0:
            prefix = value
            continue
        key = prefix << 8 | value
        code = find(key)
        if code is not None:
            prefix = code
            continue
        push(prefix)
        prefix = value
        if free < FULL:
            table[key] = free
            free += 1
        else:
            runs.append(run)
            run, free = [], clear + 2
            push = run.append
            table.clear()
    if prefix >= 0:
        push(prefix)
    runs.append(run)
    codes, sizes = [np.array([clear])], [np.array([bits + 1])]
    for i, run in enumerate(runs):
        own = np.array([*run, clear + 1 if i == len(runs) - 1 else clear])
        codes.append(own)
        sizes.append(widths(len(own), bits))
    return pack_codes(np.concatenate(codes), np.concatenate(sizes))


def literal(data: bytes, bits: int = 8) -> bytes:
    """A code stream without repeats: each value is its own code, and the table is cleared before codes grow."""
    clear, room = 1 << bits, (1 << bits) - 2
    values = np.frombuffer(data, np.uint8)
    n = len(values)
    codes = np.full(n + -(-n // room) + 1, clear)
    place = np.arange(n)
    codes[place + place // room + 1] = values
    codes[-1] = clear + 1
    return pack_codes(codes, np.full(len(codes), bits + 1))


def literals(raw: np.ndarray, at: int, n_bits: int, bits: int, most: int = 1 << 16) -> tuple[bytes, int, bool] | None:
    """The values of whole literal stretches that begin right after a clear code at bit ``at``, where they end, and whether the stream does."""
    clear, stop, room = 1 << bits, (1 << bits) + 1, (1 << bits) - 2
    begin = at + np.arange(min(most, (n_bits - at) // (bits + 1))) * (bits + 1)
    byte = begin >> 3
    codes = (raw[byte] | raw[byte + 1] << 8) >> (begin & 7) & ((2 << bits) - 1)
    later = np.flatnonzero(codes > stop)
    if len(later):
        codes = codes[: later[0]]
    special = np.flatnonzero(codes >= clear)
    good = np.diff(special, prepend=-1) - 1 <= room
    ended = np.flatnonzero(codes[special] == stop)
    k = int(np.argmin(good)) if not good.all() else len(special)
    if len(ended):
        k = min(k, int(ended[0]) + 1)
    if not k:
        return None
    last = int(special[k - 1])
    own = codes[: last + 1]
    return own[own < clear].astype(np.uint8).tobytes(), int(begin[last]) + bits + 1, bool(codes[last] == stop)


def expand(stream: bytes, bits: int, most: int) -> bytes:
    """The values of a code stream, ``most`` at most. Widths after a clear code follow from the count, so codes unpack in blocks."""
    clear, stop = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + bytes(3), np.uint8).astype(np.int64)
    n_bits = len(stream) * 8
    first = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, held, at = [], 0, 0
    table, previous, count = list(first), b"", 0  # count: codes since the clear code
    ahead = widths(2 * FULL, bits)
    fast = False
    while at + bits + 1 <= n_bits and held < most:
        if fast and (found := literals(raw, at, n_bits, bits)):
            values, at, done = found
            out.append(values)
            held += len(values)
            if done:
                break
            continue
        fast = False
        step = FULL if count else 16
        size = ahead[count : count + step] if count < FULL else np.full(step, 12)
        ends = at + np.cumsum(size)
        n = int(np.searchsorted(ends, n_bits, "right"))
        if not n:
            break
        size, begin = size[:n], ends[:n] - size[:n]
        byte = begin >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (begin & 7) & ((1 << size) - 1)
        special = np.flatnonzero((codes == clear) | (codes == stop))
        until = int(special[0]) if len(special) else n
        push, grow, n_table = out.append, table.append, len(table)
        for code in codes[:until].tolist():
            if code < n_table:
                entry = table[code]
                if previous and n_table < FULL:
                    grow(previous + entry[:1])
                    n_table += 1
            elif code == n_table and previous:
                entry = previous + previous[:1]
                if n_table < FULL:
                    grow(entry)
                    n_table += 1
            else:
                raise BadGif(f"code {code}, but the table has {n_table} entries")
            push(entry)
            held += len(entry)
            previous = entry
        count += until
        if until == n:
            at = int(ends[n - 1])
            continue
        at = int(ends[until])
        if codes[until] == stop:
            break
        fast = not until or int(codes[:until].max()) < clear
        table, previous, count = list(first), b"", 0
    return b"".join(out)[:most]


# -- files -------------------------------------------------------------------------------------------------


@dataclass
class Frame:
    """An indexed image: ``pixels`` has its lines' palette indices."""

    pixels: np.ndarray
    left: int = 0
    top: int = 0
    palette: np.ndarray | None = None
    delay: int = 10
    disposal: int = 0
    transparent: int | None = None
    interlaced: bool = False


def blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def lines_order(height: int) -> np.ndarray:
    return np.concatenate([np.arange(a, height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def encode(width: int, height: int, frames: list[Frame], palette: np.ndarray | None = None, background: int = 0, loops: int = 0, stream=compress) -> bytes:
    """A GIF89a file; palettes are (2 ** n, 3) arrays of bytes; ``stream`` is ``compress``, or ``literal`` for speed."""
    depth = lambda p: max(int(p.shape[0]).bit_length() - 2, 0)
    flags = 0x80 | depth(palette) if palette is not None else 0
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, flags | 0x70, background, 0)]
    if palette is not None:
        out.append(palette.astype(np.uint8).tobytes())
    if len(frames) > 1:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0")
    for f in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, f.disposal << 2 | (f.transparent is not None), f.delay, f.transparent or 0, 0))
        h, w = f.pixels.shape
        flags = (0x80 | depth(f.palette) if f.palette is not None else 0) | 0x40 * f.interlaced
        out.append(struct.pack("<BHHHHB", 0x2C, f.left, f.top, w, h, flags))
        if f.palette is not None:
            out.append(f.palette.astype(np.uint8).tobytes())
        colours = f.palette if f.palette is not None else palette
        bits = max(2, depth(colours) + 1)
        pixels = f.pixels[lines_order(h)] if f.interlaced else f.pixels
        out.append(bytes([bits]) + blocks(stream(pixels.astype(np.uint8).tobytes(), bits)))
    return b"".join([*out, b"\x3b"])


def parse(data: bytes) -> tuple[int, int, int, np.ndarray | None, list[Frame]]:
    """Width, height, background, palette and indexed frames of a file."""
    try:
        return parsed(data)
    except (struct.error, IndexError) as e:
        raise BadGif(f"the file is cut off: {e}") from e


def parsed(data: bytes):
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise BadGif("no GIF signature")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, None

    def colours(flags: int, at: int):
        n = 2 << (flags & 7)
        if at + 3 * n > len(data):
            raise BadGif("the palette is cut off")
        return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n

    def chain(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            if at + 1 + n >= len(data):
                raise BadGif("a block is cut off")
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    if flags & 0x80:
        palette, at = colours(flags, at)
    frames, control = [], (10, 0, None)
    while (kind := data[at]) != 0x3B:
        if kind == 0x21:
            label = data[at + 1]
            body, at = chain(at + 2)
            if label == 0xF9:
                how, delay, index = struct.unpack_from("<BHB", body)
                control = (delay, how >> 2 & 7, index if how & 1 else None)
            continue
        if kind != 0x2C:
            raise BadGif(f"block of kind {kind:#x} at byte {at}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at, own = at + 10, None
        if flags & 0x80:
            own, at = colours(flags, at)
        bits = data[at]
        if not 1 <= bits <= 11:
            raise BadGif(f"code size {bits}")
        stream, at = chain(at + 1)
        values = expand(stream, bits, w * h)
        if len(values) < w * h:
            raise BadGif(f"{len(values)} of {w * h} pixels")
        pixels = np.frombuffer(values, np.uint8).reshape(h, w)
        if flags & 0x40:
            lines = np.empty_like(pixels)
            lines[lines_order(h)] = pixels
            pixels = lines
        delay, disposal, transparent = control
        frames.append(Frame(pixels, left, top, own, delay, disposal, transparent, bool(flags & 0x40)))
        control = (10, 0, None)
    return width, height, background, palette, frames


def decode(data: bytes):
    """Each shown frame: start in hundredths of a second, delay, and the composed image as (height, width, 4) bytes."""
    width, height, _, palette, frames = parse(data)
    canvas, clock = np.zeros((height, width), "<u4"), 0  # red, green, blue and alpha in a word
    for f in frames:
        colours = f.palette if f.palette is not None else palette
        if colours is None:
            raise BadGif("a frame without palette")
        if f.pixels.size and f.pixels.max() >= len(colours):
            raise BadGif("an index beyond the palette")
        before = canvas.copy() if f.disposal == 3 else None
        solid = np.full((len(colours), 4), 255, np.uint8)
        solid[:, :3] = colours
        h, w = f.pixels.shape
        spot = canvas[f.top : f.top + h, f.left : f.left + w]
        pixels = f.pixels[: spot.shape[0], : spot.shape[1]]
        shown = solid.view("<u4").ravel()[pixels]
        spot[:] = shown if f.transparent is None else np.where(pixels == f.transparent, spot, shown)
        yield clock, f.delay, canvas.copy().view(np.uint8).reshape(height, width, 4)
        clock += f.delay
        if f.disposal == 2:
            spot[:] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(image: np.ndarray) -> np.ndarray:
    """Visible pixels by the two upper bits of red, green and blue: 64 counts."""
    bins = image[..., 0] >> 6 << 4 | image[..., 1] >> 6 << 2 | image[..., 2] >> 6
    return np.bincount(bins[image[..., 3] > 0], minlength=64)


def frames(files: DataFrame, media_col: str = "media") -> DataFrame:
    """One row for each frame of the files in ``media_col``: key, frame, start_cs, delay_cs, width, height, rgba and histogram."""
    schema = "key long, frame int, start_cs long, delay_cs int, width int, height int, rgba binary, histogram array<long>"

    def shown(batches):
        for batch in batches:
            for key, media in zip(batch.column(0).to_pylist(), batch.column(1)):
                if media.is_valid:
                    for i, (start, delay, image) in enumerate(decode(media.as_py())):
                        yield pa.RecordBatch.from_pylist([{"key": key, "frame": i, "start_cs": start, "delay_cs": delay, "width": image.shape[1], "height": image.shape[0], "rgba": image.tobytes(), "histogram": histogram(image).tolist()}], pa.schema([("key", pa.int64()), ("frame", pa.int32()), ("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int64()))]))

    return files.select(F.col("key").cast("long").alias("key"), F.col(media_col)).mapInArrow(shown, schema)


# -- payloads ----------------------------------------------------------------------------------------------

GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)


def store(text: bytes) -> bytes:
    """A file that holds the bytes, padded by zeros to a positive multiple of 64. Its code streams are full LZW."""
    padded = text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))
    lines = np.frombuffer(padded, np.uint8).reshape(-1, WIDTH)
    parts = [lines[i : i + FRAME_ROWS] for i in range(0, len(lines), FRAME_ROWS)]
    return encode(WIDTH, min(len(lines), FRAME_ROWS), [Frame(p, disposal=2) for p in parts], GREY)


def load(media: bytes) -> tuple[bytes, list[np.ndarray], int]:
    """The padded bytes, each frame's histogram, and the milliseconds of all frames."""
    payload, counts, clock = [], [], 0
    for start, delay, image in decode(media):
        seen = image[..., 3] > 0
        payload.append(image[..., 0][seen].tobytes())
        counts.append(histogram(image))
        clock = (start + delay) * 10
    return b"".join(payload), counts, clock


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of every row."""

    def files(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([store(x) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(files, "doc_id long, n_bytes long, media binary")


def digests(media: DataFrame) -> DataFrame:
    """What the stored files say of their payloads."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def rows(batches):
        for batch in (part for whole in batches for part in slices(whole, "media")):
            out = []
            for key, n, file in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media")):
                file = file.as_py()
                payload, counts, clock = load(file)
                grey = np.sum(counts, axis=0)[[0, 21, 42, 63]]  # a grey palette fills these bins alone
                feature = f"frames={len(counts)};ms={clock};grey=" + ",".join(map(str, grey))
                out.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 8, kinds)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(stored(documents(spark, sf_dir)))
