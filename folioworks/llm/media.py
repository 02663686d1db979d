"""Media columns: payloads as PNG files in binary columns, and perceptual hashes of them.

Files are made and read here: chunks with their checksums, zlib streams, and row filters
undone with numpy. The feature is a cosine-transform hash: the signs, against their median,
of the lowest frequencies of the picture brought to 32 by 32.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from folioworks.llm.batches import map_texts

# Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY, RGB = 0, 2
NONE, SUB, UP, AVERAGE, PAETH = range(5)

#: A row of the picture: 64 pixels of three samples.
ROW_BYTES, CHANNELS, PAD = 192, 3, b" "
SIDE, LOW = 32, 8


def padded(data: bytes) -> bytes:
    """``data`` with spaces up to a positive multiple of ROW_BYTES."""
    rows = max(1, -(-len(data) // ROW_BYTES))
    return data.ljust(rows * ROW_BYTES, PAD)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _neighbours(rows: np.ndarray, channels: int) -> tuple[np.ndarray, ...]:
    """Bytes to the left, above and above to the left, as int16; none at the edges: 0."""
    wide = np.zeros((len(rows) + 1, rows.shape[1] + channels), np.int16)
    wide[1:, channels:] = rows
    return wide[1:, :-channels], wide[:-1, channels:], wide[:-1, :-channels]


def _paeth(a, b, c):
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def _guess(kind: int, a, b, c):
    """What a filter predicts from those neighbours."""
    return {NONE: lambda: a * 0, SUB: lambda: a, UP: lambda: b, AVERAGE: lambda: (a + b) >> 1, PAETH: lambda: _paeth(a, b, c)}[kind]()


def _filtered(rows: np.ndarray, kind: int, channels: int) -> np.ndarray:
    """``rows`` less what the filter predicts, modulo 256."""
    return (rows - _guess(kind, *_neighbours(rows, channels))).astype(np.uint8)


def filtered(rows: np.ndarray, channels: int, kind: int | None = None) -> np.ndarray:
    """``rows`` each with its filter's number before it. Without ``kind`` every row has the
    filter that leaves the least sum of absolute differences, the first of equal ones."""
    body = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    if kind is not None:
        body[:, 0], body[:, 1:] = kind, _filtered(rows, kind, channels)
        return body
    sides, least = _neighbours(rows, channels), np.full(len(rows), np.iinfo(np.int64).max)
    for kind in range(PAETH + 1):
        made = (rows - _guess(kind, *sides)).astype(np.uint8)
        cost = np.abs(made.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)
        better = cost < least
        least[better] = cost[better]
        body[better, 0] = kind
        body[better, 1:] = made[better]
    return body


def encode_png(data: bytes, row_bytes: int = ROW_BYTES, channels: int = CHANNELS, kind: int | None = None, level: int = 6) -> bytes:
    """A PNG with 8-bit samples of ``data``, whole rows of ``row_bytes``."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, row_bytes)
    head = struct.pack(">IIBBBBB", row_bytes // channels, len(rows), 8, RGB if channels == 3 else GREY, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered(rows, channels, kind).tobytes(), level)) + _chunk(b"IEND", b"")


def unfiltered(bodies: list[np.ndarray], channels: int) -> list[np.ndarray]:
    """The rows of several pictures of one width again.

    A pixel needs those to its left, above and above to the left. So all pixels of one
    diagonal, column plus row, of all pictures are undone at once, whatever their filters.
    """
    if not bodies:
        return []
    heights = [len(b) for b in bodies]
    number = np.concatenate([np.arange(h) for h in heights])
    order = np.argsort(number, kind="stable")  # first rows of all pictures, then second ones, ...
    flat = np.concatenate(bodies)[order]
    number, kinds, width = number[order], flat[:, 0], (flat.shape[1] - 1) // channels
    if kinds.max(initial=0) > PAETH:
        raise ValueError("unknown row filter")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    above = np.where(number > 0, place[np.maximum(order - 1, 0)], len(order))  # the last entry stays zero
    pixels = flat[:, 1:].reshape(len(flat), width, channels).astype(np.int16)
    near, far = np.zeros((len(flat) + 1, channels), np.int16), np.zeros((len(flat) + 1, channels), np.int16)
    starts = np.searchsorted(number, np.arange(max(heights) + 1))
    by_kind = [kinds == k for k in (SUB, UP, AVERAGE, PAETH)]
    some = [bool(k.any()) for k in by_kind]
    for step in range(max(heights) + width - 1):
        low, high = starts[max(0, step - width + 1)], starts[min(step + 1, len(starts) - 1)]
        rows = np.arange(low, high)
        x, up = step - number[low:high], above[low:high]
        a, b, c = near[low:high], near[up], far[up]
        value = pixels[rows, x]
        for k, mask, there in zip((SUB, UP, AVERAGE, PAETH), by_kind, some):
            if there:
                at = mask[low:high]
                value[at] += _guess(k, a[at], b[at], c[at])
        value &= 255
        pixels[rows, x] = value
        first = starts[max(0, step - width)]  # rows that ended a step ago are still above others
        far[first:high] = near[first:high]
        near[low:high] = value
    done = pixels.reshape(len(flat), -1).astype(np.uint8)[place]
    return np.split(done, np.cumsum(heights)[:-1])


def _unfiltered(body: np.ndarray, channels: int) -> np.ndarray:
    return unfiltered([body], channels)[0]


def opened(file: bytes) -> tuple[np.ndarray, int]:
    """(filtered rows, channels) of an 8-bit grey or RGB file. Every chunk's checksum and the
    zlib stream's are tested; ValueError or zlib.error says that a file is broken."""
    if file[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, head, stream, ended = 8, None, [], False
    while not ended:
        if at + 12 > len(file):
            raise ValueError("the file ends early")
        (n,), kind = struct.unpack_from(">I", file, at), file[at + 4 : at + 8]
        data = file[at + 8 : at + 8 + n]
        if len(data) < n or struct.unpack_from(">I", file.ljust(at + n + 12, b"\0"), at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            if n != 13:
                raise ValueError("wrong header")
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            stream.append(data)
        ended, at = kind == b"IEND", at + n + 12
    if not head or not all(head[:2]) or head[2] != 8 or head[3] not in (GREY, RGB) or any(head[4:]):
        raise ValueError("not 8-bit grey or RGB without interlace")
    channels = 3 if head[3] == RGB else 1
    size, inflate = head[1] * (head[0] * channels + 1), zlib.decompressobj()
    body = np.frombuffer(inflate.decompress(b"".join(stream), size + 1), np.uint8)  # no more than the header allows, and one byte that tells of more
    if len(body) != size:
        raise ValueError("wrong number of samples")
    if not inflate.eof:
        raise ValueError("the stream ends early")
    body = body.reshape(head[1], -1)
    if body[:, 0].max() > PAETH:
        raise ValueError("unknown row filter")
    return body, channels


def decode_png(file: bytes) -> tuple[np.ndarray, int]:
    """(rows of bytes, channels) of one file; raises like ``opened``."""
    body, channels = opened(file)
    return _unfiltered(body, channels), channels


def decode_all(files: Iterable[bytes]) -> list[tuple[np.ndarray, int] | str | None]:
    """For each file its rows and channels, what is wrong with it, or None for an empty one."""
    out: list = []
    alike: dict[tuple[int, int], list[int]] = {}
    for file in files:
        try:
            out.append(opened(file) if file else None)
        except (ValueError, zlib.error, struct.error, MemoryError) as error:
            out.append(str(error))
        else:
            if file:
                alike.setdefault((out[-1][0].shape[1], out[-1][1]), []).append(len(out) - 1)
    for (_, channels), at in alike.items():
        for i, rows in zip(at, unfiltered([out[i][0] for i in at], channels)):
            out[i] = (rows, channels)
    return out


def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.mgrid[:low, :n]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_COSINES = _cosines(SIDE, LOW)


def _resized(picture: np.ndarray, axis: int) -> np.ndarray:
    """SIDE cells along ``axis``, each the mean of what it covers."""
    n = picture.shape[axis]
    edges = np.arange(SIDE) * n // SIDE
    if n < SIDE:
        return np.take(picture, edges, axis)
    counts = np.diff(np.r_[edges, n])
    sums = np.add.reduceat(picture, edges, axis)
    return sums / (counts[:, None] if axis == 0 else counts)


def cosine_hash(rows: np.ndarray, channels: int) -> str:
    """64 bits in hex: which of the LOW x LOW lowest frequencies exceed their median."""
    grey = rows.reshape(len(rows), -1, channels).mean(axis=2)
    low = (_COSINES @ _resized(_resized(grey, 0), 1) @ _COSINES.T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def with_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, and with n_bytes (of the UTF-8) and media (the file).

    Null and empty texts are one row of spaces; texts of any length are stored whole. Every
    row has its file, repeated ones the same. An empty table gives no rows. Other columns
    pass, but n_bytes and media are replaced.
    """

    def run(texts: Iterable[bytes]) -> Iterable[tuple]:
        return ((len(x), encode_png(padded(x))) for x in texts)

    return map_texts(docs, run, "n_bytes long, media binary", text)


def read_media(files: DataFrame, media: str = "media", payload: bool = False) -> DataFrame:
    """``files`` without ``media``, and with payload_bytes, payload_sha256, tail_crc32 (of the
    last 16 bytes), feature, error and, if asked for, payload, all from the stored bytes, and
    with media_bytes and media_sha256.

    Empty and null files have null fields; so have broken ones, of which error says what is
    wrong. Every row is read by itself, repeated ones alike; the files of a batch are undone
    together. An empty table gives no rows. Other columns pass, those of the same names are replaced.
    """

    def run(stored: Iterable[bytes]) -> Iterable[tuple]:
        for found in decode_all(stored):
            if found is None or isinstance(found, str):
                yield (None,) * 4 + (found,) + (None,) * payload
                continue
            data = found[0].tobytes()
            made = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), cosine_hash(*found), None)
            yield (*made, data) if payload else made

    sized = files.withColumns({"media_bytes": F.length(media).cast("long"), "media_sha256": F.sha2(F.col(media), 256)})
    return map_texts(sized, run, "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, error string" + ", payload binary" * payload, media)
