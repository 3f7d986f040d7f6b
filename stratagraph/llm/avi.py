"""Media columns: AVI motion JPEG.

Writing: a payload of bytes becomes grey frames of 24 x 24 8-bit samples, each frame a lossless
JPEG (process 14, predictor 1, one Huffman table), all frames one AVI with a RIFF index.
Reading: the RIFF chunks and the index are parsed, every frame is entropy-decoded and its
prediction undone, and the samples are the payload again. Shots are found from differences of
neighbouring frames' histograms: a cut stands where a difference is over ``LEAST`` and exceeds the
median of the differences around it, itself left out, by ``CUT`` deviations (``DEVIATION`` median absolute
deviations each), so that neither the cut nor others near it hide it; each shot is a timed clip row.
A film of fewer than three frames is one shot.

Coding and decoding work on many frames at once in numpy: a step decodes one sample of every
frame. Frames are handled in slices of ``SLICE``, so memory is bounded whatever a text's length.

Defined results: a null text counts as empty; an empty text has one frame of padding; equal
texts give equal bytes; repeated rows each get a row; an empty table gives no rows; extra
columns are ignored; media that is null or no AVI of this kind raises an error that names it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.common import id_and_text

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
#: Frames coded together, histogram bins, the span of differences around a cut, its height and its least height.
SLICE, BINS, SPAN, CUT, LEAST = 4096, 16, 12, 2.5, 0.2
#: Median absolute deviations of a standard deviation, for normal values.
DEVIATION = 1.4826
#: Huffman code lengths of the difference categories 0 to 8: letters differ by 8 to 127 mostly.
CODE_LENGTHS = [4, 4, 4, 3, 3, 3, 3, 3, 4]


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), codes in order of length, then symbol."""
    code, last, out = 0, 0, {}
    for length, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= length - last
        out[symbol], last = (code, length), length
        code += 1
    return out


_CODES = canonical(CODE_LENGTHS)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each difference + 255: the bits of its code and extra bits, and how many they are."""
    bits, many = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, length = _CODES[category]
        bits[d + 255] = code << category | (d if d >= 0 else d + (1 << category) - 1)
        many[d + 255] = length + category
    return bits, many


_BITS, _MANY = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _headers() -> bytes:
    counts = [CODE_LENGTHS.count(n) for n in range(1, 17)]
    symbols = [s for _, s in sorted((n, s) for s, n in enumerate(CODE_LENGTHS))]
    return (
        b"\xff\xd8"
        + _segment(0xC3, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0))
        + _segment(0xC4, bytes([0, *counts, *symbols]))
        + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))  # predictor 1, no point transform
    )


HEADERS = _headers()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """(n, FRAME) samples to n JPEG images."""
    n = len(samples)
    image = samples.reshape(n, SIDE, SIDE).astype(np.int16)
    diff = np.empty_like(image)
    diff[:, :, 1:] = image[:, :, 1:] - image[:, :, :-1]
    diff[:, 1:, 0] = image[:, 1:, 0] - image[:, :-1, 0]
    diff[:, 0, 0] = image[:, 0, 0] - 128
    at = diff.reshape(n, FRAME).astype(np.int64) + 255
    many = _MANY[at]
    ends = np.cumsum(many, axis=1)
    size = (ends[:, -1] + 7) >> 3
    base = np.cumsum(size) - size
    start = (ends - many) + 8 * base[:, None]
    # A code of up to 12 bits lies in three bytes from its first; bits of a byte never overlap, so sums are unions.
    byte, shift = (start >> 3).ravel(), (24 - (start & 7) - many).ravel()
    wide = _BITS[at].ravel() << shift
    total = int(size.sum())
    data = np.zeros(total + 2)
    for k in range(3):
        data += np.bincount(byte + k, (wide >> (16 - 8 * k)) & 255, total + 2)
    data = data[:total].astype(np.uint8)
    pad = 8 * size - ends[:, -1]
    data[base + size - 1] |= ((1 << pad) - 1).astype(np.uint8)  # the last byte is filled with ones
    full = np.flatnonzero(data == 255)
    stuffed = np.insert(data, full + 1, 0)  # a data byte 255 is followed by 0
    more = np.searchsorted(full, base), np.searchsorted(full, base + size)
    raw = stuffed.tobytes()
    return [HEADERS + raw[b + m : b + s + k] + b"\xff\xd9" for b, s, m, k in zip(base.tolist(), size.tolist(), more[0].tolist(), more[1].tolist(), strict=True)]


def _parse_jpeg(image: bytes) -> tuple[bytes, list[int], tuple[int, int]]:
    """The entropy-coded bytes, the Huffman code lengths by symbol, and (height, width)."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at, lengths, shape = 2, None, None
    while True:
        mark, marker, size = struct.unpack_from(">BBH", image, at)
        if mark != 0xFF:
            raise ValueError("a JPEG marker is missing")
        body = image[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC3:
            if body[0] != 8 or body[5] != 1:
                raise ValueError("only grey JPEG of 8 bits is supported")
            shape = struct.unpack(">HH", body[1:5])
        elif marker == 0xC4:
            symbols, lengths = iter(body[17:]), [0] * 17
            for length, count in enumerate(body[1:17], 1):
                for _ in range(count):
                    lengths[next(symbols)] = length
        elif marker == 0xDA:
            if body[3] != 1:
                raise ValueError("only predictor 1 is supported")
            break
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("only lossless Huffman JPEG is supported")
    if lengths is None or shape is None or image[-2:] != b"\xff\xd9":
        raise ValueError("the JPEG image isn't whole")
    return image[at:-2], lengths, shape


def decode_frames(images: list[bytes]) -> np.ndarray:
    """JPEG images of one size and table to (n, height * width) samples."""
    head = images[0][: images[0].index(b"\xff\xda")]
    scan, lengths, (rows, cols) = _parse_jpeg(images[0])
    if any(not i.startswith(head) for i in images):
        raise ValueError("frames differ in their headers")
    skip = len(images[0]) - 2 - len(scan)
    parts = [i[skip:-2].replace(b"\xff\x00", b"\xff") for i in images]
    size = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts) + bytes(8), np.uint8).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    # By the next 8 bits: category and code length.
    longest = max(lengths)
    if longest > 8:
        raise ValueError("codes of over 8 bits aren't supported")
    table = np.full(256, 255, np.uint32)
    for symbol, (code, length) in canonical(lengths).items():
        table[code << (8 - length) : (code + 1) << (8 - length)] = symbol << 4 | length
    n, count = len(images), rows * cols
    out = np.empty((count, n), np.int16)
    pos = 8 * (np.cumsum(size) - size)
    end = 8 * np.cumsum(size)
    seven, eight, four = np.uint32(7), np.uint32(24), np.uint32(4)
    for k in range(count):
        bits = window[pos >> 3] << (pos.astype(np.uint32) & seven)
        entry = table[bits >> eight]
        category, length = entry >> four, entry & np.uint32(15)
        extra = np.where(category > 0, (bits << length) >> (np.uint32(32) - np.maximum(category, 1)), 0).astype(np.int32)
        half = (1 << category.astype(np.int32)) >> 1
        out[k] = np.where(extra < half, extra - 2 * half + 1, extra) * (category > 0)
        pos = pos + length + category
    if (pos > end).any() or (out > 255).any():
        raise ValueError("the entropy-coded data isn't whole")
    diff = out.T.reshape(n, rows, cols).astype(np.int32)
    diff[:, :, 0] = 128 + np.cumsum(diff[:, :, 0], axis=1)
    return np.cumsum(diff, axis=2).astype(np.uint8).reshape(n, count)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def mux(images: list[bytes], width: int = SIDE, height: int = SIDE, fps: int = FPS) -> bytes:
    """JPEG images to one AVI with an index."""
    largest = max(map(len, images))
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(images), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vids" + b"MJPG" + struct.pack("<IHHIIIIIIiI4h", 0, 0, 0, 0, 1, fps, 0, len(images), largest, -1, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    body = b"".join([_chunk(b"00dc", i) for i in images])
    size = np.array([len(i) for i in images])
    index = np.empty((len(images), 4), "<u4")
    index[:, 0], index[:, 1] = struct.unpack("<I", b"00dc")[0], 0x10
    index[:, 2], index[:, 3] = 4 + np.cumsum(8 + size + size % 2) - (8 + size + size % 2), size
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"movi" + body) + _chunk(b"idx1", index.tobytes()))


def demux(media: bytes) -> tuple[list[bytes], int]:
    """An AVI's frames, by its index, and its frames per second."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, movi, index, fps = 12, 8 + struct.unpack_from("<I", media, 4)[0], None, None, FPS
    if end > len(media):
        raise ValueError("the AVI file isn't whole")
    while at + 8 <= end:
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        kind = media[at + 8 : at + 12]
        if name == b"LIST" and kind == b"hdrl":
            fps = max(1, round(1_000_000 / max(1, struct.unpack_from("<I", media, at + 20)[0])))
        elif name == b"LIST" and kind == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = np.frombuffer(media, "<u4", size // 16 * 4, at + 8).reshape(-1, 4)
        at += 8 + size + size % 2
    if movi is None or index is None:
        raise ValueError("the AVI file has no frames or no index")
    own = index[index[:, 0] == struct.unpack("<I", b"00dc")[0]]
    return [media[movi + 8 + o : movi + 8 + o + s] for o, s in own[:, 2:].tolist()], fps


def write_media(payload: bytes) -> bytes:
    samples = np.frombuffer(payload, np.uint8).reshape(-1, FRAME)
    return mux([i for at in range(0, len(samples), SLICE) for i in encode_frames(samples[at : at + SLICE])])


def cuts(frames: np.ndarray) -> list[int]:
    """First frames of the shots after the first."""
    if len(frames) < 3:
        return []
    one = (np.arange(len(frames))[:, None] * BINS + (frames >> 4)).ravel()
    histogram = np.bincount(one, minlength=len(frames) * BINS).reshape(-1, BINS)
    diff = np.abs(np.diff(histogram, axis=0)).sum(axis=1) / (2 * frames.shape[1])
    found, around = [], np.r_[-SPAN:0, 1 : SPAN + 1]
    candidates = np.flatnonzero(diff > LEAST)
    for k in range(0, len(candidates), SLICE):
        own = candidates[k : k + SLICE]
        at = own[:, None] + around
        near = np.where((at >= 0) & (at < len(diff)), diff[np.clip(at, 0, len(diff) - 1)], np.nan)
        usual = _medians(near)
        spread = DEVIATION * _medians(np.abs(near - usual[:, None]))
        found += (own[diff[own] > usual + CUT * spread] + 1).tolist()
    return found


def _medians(rows: np.ndarray) -> np.ndarray:
    """The median of each row's numbers; at least one in a row is one."""
    many = np.isfinite(rows).sum(axis=1)
    rows, at = np.sort(rows, axis=1), np.arange(len(rows))
    return (rows[at, (many - 1) // 2] + rows[at, many // 2]) / 2


def padded(text: str) -> tuple[int, bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return len(data), data + b"\xff" * (FRAME - len(data) if not data else -len(data) % FRAME)


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= most or i == len(sizes) - 1:
            yield lo, i + 1
            lo, total = i + 1, 0


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        sizes = pc.binary_length(texts).fill_null(0).to_pylist()
        for lo, hi in _groups(sizes, SLICE * FRAME // 2):
            own = [padded(t.as_py() or "") for t in texts.slice(lo, hi - lo)]
            samples = np.frombuffer(b"".join(p for _, p in own), np.uint8).reshape(-1, FRAME)
            images = [i for at in range(0, len(samples), SLICE) for i in encode_frames(samples[at : at + SLICE])]
            media, at = [], 0
            for _, p in own:
                media.append(mux(images[at : at + len(p) // FRAME]))
                at += len(p) // FRAME
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([n for n, _ in own], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _decoded(media: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
    found = [demux(m) for m in media]
    images = [i for own, _ in found for i in own]
    frames = np.concatenate([decode_frames(images[at : at + SLICE]) for at in range(0, len(images), SLICE)])
    at = 0
    for own, fps in found:
        yield frames[at : at + len(own)], fps
        at += len(own)


def _batches(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    sizes = pc.binary_length(column).to_pylist()
    for lo, hi in _groups(sizes, SLICE * FRAME // 2):
        yield lo, column.slice(lo, hi - lo).to_pylist()


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, media in _batches(batch.column("media")):
            rows, of = [], []
            for k, (frames, fps) in enumerate(_decoded(media)):
                starts = [0, *cuts(frames), len(frames)]
                for c, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                    of.append(lo + k)
                    rows.append((c, a / fps, b / fps, b - a, float(frames[a:b].mean())))
            columns = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of)), *columns], names=["doc_id", "clip", "start_s", "end_s", "n_frames", "mean_luma"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        for lo, media in _batches(batch.column("media")):
            rows = []
            for m, (frames, fps) in zip(media, _decoded(media), strict=True):
                payload, starts = frames.tobytes(), [0, *cuts(frames), len(frames)]
                clips = " ".join(f"{a / fps:.2f}-{b / fps:.2f}" for a, b in zip(starts[:-1], starts[1:], strict=True))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), f"frames={len(frames)} clips={clips} luma={frames.mean():.4f}"))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            own = batch.slice(lo, len(media))
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("n_bytes"), *columns], names=names)


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text's padded bytes as an AVI file."""
    kind = df.schema[id_col].dataType.simpleString()
    return id_and_text(df, id_col, text_col).mapInArrow(_encode, f"doc_id {kind}, n_bytes long, media binary")


def clip_rows(media: DataFrame) -> DataFrame:
    """A row per shot: ``(doc_id, clip, start_s, end_s, n_frames, mean_luma)``."""
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", F.col("media")).mapInArrow(_clips, f"doc_id {kind}, clip long, start_s double, end_s double, n_frames long, mean_luma double")


def features(media: DataFrame) -> DataFrame:
    """What is read back from the stored bytes, as digests and one feature string per row."""
    kind = media.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, fields)
