"""Media columns: texts or images as PNG in a binary column, read back with checks, and a perceptual hash.

8-bit greyscale rasters are written with the line filter of the smallest sum of absolute differences, chosen for each line, and read by
walking the chunks, testing each CRC-32, inflating the IDAT data (whose Adler-32 zlib tests) and undoing the five PNG line filters with
numpy: all lines of a run of images at once, column after column, where a line is one column behind the line above it. `dct_hash` takes the
signs of the low frequencies of a two-dimensional cosine transform.

A null or empty text is a payload of padding only. Equal rows give equal media, and a null doc_id is kept. A table without rows gives none.
Extra columns are not read.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm._stage import column

#: Payloads are padded with 255 to a positive multiple of this many bytes, one line of the raster.
LINE = 576
#: Bytes of text that are written or read at once.
RUN_BYTES = 1 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"


class MediaError(ValueError):
    """A stored image is damaged or of another kind."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, above and corner (16 bits), the one nearest to left + above - corner."""
    da, db = b - c, a - c
    dc = np.abs(da + db)
    np.abs(da, out=da)
    np.abs(db, out=db)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def _filtered(rows: np.ndarray, first: np.ndarray, kind: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(filter of each line, filtered lines); first marks the first line of each image. Without a kind, each line has its best one."""
    left, up, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:] = rows[:, :-1]
    up[1:] = rows[:-1]
    up[first] = 0
    corner[:, 1:] = up[:, :-1]
    wide = lambda x: x.astype(np.int16)
    made = [
        lambda: rows,
        lambda: rows - left,
        lambda: rows - up,
        lambda: rows - ((wide(left) + up) >> 1).astype(np.uint8),
        lambda: rows - _paeth(wide(left), wide(up), wide(corner)).astype(np.uint8),
    ]
    if kind is not None:
        return np.full(len(rows), kind, np.uint8), made[kind]()
    best, kinds, least = rows.copy(), np.zeros(len(rows), np.uint8), None
    for k, make in enumerate(made):
        own = make()
        cost = np.minimum(own, -own).sum(1, dtype=np.int64)
        better = np.ones(len(rows), bool) if least is None else cost < least
        best[better], kinds[better] = own[better], k
        least = np.where(better, cost, least) if least is not None else cost
    return kinds, best


def encode_pngs(payloads: list[bytes], width: int = LINE, line_filter: int | None = None, level: int = 3) -> list[bytes]:
    """8-bit greyscale PNGs whose samples, line by line, are the payloads; their lengths must be positive multiples of width."""
    if not payloads:
        return []
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, width)
    at = np.concatenate(([0], np.cumsum([len(p) // width for p in payloads]))).tolist()
    first = np.zeros(len(rows), bool)
    first[at[:-1]] = True
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = _filtered(rows, first, line_filter)
    out = []
    for a, b in itertools.pairwise(at):
        header = struct.pack(">IIBBBBB", width, b - a, 8, 0, 0, 0, 0)
        out.append(SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines[a:b].tobytes(), level)) + _chunk(b"IEND", b""))
    return out


def encode_png(payload: bytes, width: int = LINE, line_filter: int | None = None, level: int = 3) -> bytes:
    """One PNG."""
    return encode_pngs([payload], width, line_filter, level)[0]


def _inflated(media: bytes) -> np.ndarray:
    """The filtered lines (height, 1 + width). MediaError where a signature, checksum, size or kind is wrong."""
    if media[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, size, packed, ended = 8, None, [], False
    while at + 12 <= len(media) and not ended:
        n = int.from_bytes(media[at : at + 4], "big")
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(data) < n or zlib.crc32(media[at + 4 : at + 8 + n]) != int.from_bytes(media[at + 8 + n : at + 12 + n], "big"):
            raise MediaError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", data)
            if rest != [8, 0, 0, 0, 0]:
                raise MediaError("only 8-bit greyscale without interlace")
            size = height, width
        elif kind == b"IDAT":
            packed.append(data)
        ended = kind == b"IEND"
        at += 12 + n
    if size is None or not ended:
        raise MediaError("a chunk is missing")
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise MediaError(str(e)) from e
    height, width = size
    if len(lines) != height * (width + 1):
        raise MediaError("size of the samples")
    lines = lines.reshape(height, width + 1)
    if lines[:, 0].max(initial=0) > 4:
        raise MediaError("line filter")
    return lines


def decode_pngs(media: list[bytes]) -> list[np.ndarray]:
    """The samples of each image as an array (height, width)."""
    found = [_inflated(m) for m in media]
    out: list[np.ndarray] = [np.empty(0)] * len(found)
    by_width: dict[int, list[int]] = {}
    for i, lines in enumerate(found):
        by_width.setdefault(lines.shape[1] - 1, []).append(i)
    for own in by_width.values():
        for i, samples in zip(own, _unfiltered([found[i] for i in own]), strict=True):
            out[i] = samples
    return out


def decode_png(media: bytes) -> np.ndarray:
    """One image's samples."""
    return decode_pngs([media])[0]


def _unfiltered(images: list[np.ndarray]) -> list[np.ndarray]:
    """The samples of images of one width. Step t is at column t - y of the y-th line of every image."""
    width = images[0].shape[1] - 1
    heights = np.array([len(x) for x in images])
    # A line of zeros before each image, and a column of zeros.
    begin = np.cumsum(heights + 1) - heights
    held = np.zeros((int(heights.sum()) + len(images), width + 1), np.uint8)
    for a, x in zip(begin.tolist(), images, strict=True):
        held[a : a + len(x), 1:] = x[:, 1:]
    y = np.arange(heights.sum()) - np.repeat(np.cumsum(heights) - heights, heights)
    order = np.argsort(y, kind="stable")
    y = y[order]
    at = (np.repeat(begin, heights)[order] + y) * (width + 1)
    kind = np.concatenate([x[:, 0] for x in images])[order]
    flat, line = held.ravel(), width + 1
    tops = np.searchsorted(y, np.arange(width + int(heights.max(initial=0)) + 1))
    masks = [(kind == k).astype(np.int16) for k in (1, 2, 3)]
    for t in range(width + int(heights.max(initial=0)) - 1):
        # Lines with 0 <= t - y < width.
        own = slice(tops[max(0, t - width + 1)], tops[t + 1])
        place = at[own] + (t + 1 - y[own])
        a, b, c = (flat.take(place - d).astype(np.int16) for d in (1, line, line + 1))
        guess = _paeth(a, b, c) * (kind[own] == 4)
        guess += a * masks[0][own]
        guess += b * masks[1][own]
        guess += ((a + b) >> 1) * masks[2][own]
        flat[place] += guess.astype(np.uint8)
    return [held[a : a + n, 1:] for a, n in zip(begin.tolist(), heights.tolist(), strict=True)]


def _cosines(n: int, keep: int) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(np.where(k, 2, 1) / n)


_SIDE, _KEEP = 32, 8
_BASIS = _cosines(_SIDE, _KEEP)


def _shrunk(x: np.ndarray, side: int) -> np.ndarray:
    """The mean of side equal parts of the first axis; a part may begin and end inside a sample."""
    n = len(x)
    sums = np.zeros((n + 1, x.shape[1]))
    np.cumsum(x, axis=0, dtype=np.float64, out=sums[1:])
    edges = np.arange(side + 1) * (n / side)
    low = np.minimum(edges.astype(np.int64), n - 1)
    at = sums[low] + (edges - low)[:, None] * (sums[low + 1] - sums[low])
    return (at[1:] - at[:-1]) * (side / n)


def dct_hash(samples: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 low frequencies of the raster, shrunk to 32 x 32, lie above their median."""
    small = _shrunk(_shrunk(samples, _SIDE).T, _SIDE).T
    low = np.round(_BASIS @ small @ _BASIS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def text_payload(text: str | None, line: int = LINE) -> tuple[bytes, int]:
    """The UTF-8 text with 255 appended up to a positive multiple of line, and the text's own bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(line, -(-len(raw) // line) * line) - len(raw)), len(raw)


def _runs(sizes: list[int], most: int = RUN_BYTES) -> list[tuple[int, int]]:
    """First and end of runs of values of at most `most` bytes, or of one value."""
    out, a, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > a and held + n > most:
            out.append((a, i))
            a, held = i, 0
        held += n
    return [*out, (a, len(sizes))] if sizes else out


def text_media(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", line_filter: int | None = None, level: int = 3) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a PNG. A pass over the rows without any exchange."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in _runs(sizes):
                part = batch.slice(a, b - a)
                made = [text_payload(t) for t in part.column(1).to_pylist()]
                media = encode_pngs([p for p, _ in made], LINE, line_filter, level)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    docs = documents.select(column(doc_id).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    return docs.mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads the binary column back: doc_id, n_bytes, payload (the samples' bytes), media, feature (the cosine-transform hash)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _runs(batch.column(1).to_pylist()):
                part = batch.slice(a, b - a)
                samples = decode_pngs(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([s.tobytes() for s in samples], pa.binary()), part.column(2), pa.array([dct_hash(s) for s in samples])], names=["doc_id", "n_bytes", "payload", "media", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, "doc_id long, n_bytes long, payload binary, media binary, feature string")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's stored image and of what is read back from it."""
    found = media_features(text_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.selectExpr(
        "doc_id",
        "n_bytes",
        "cast(octet_length(payload) as long) as payload_bytes",
        "sha2(payload, 256) as payload_sha256",
        "crc32(substring(payload, octet_length(payload) - 31, 32)) as tail_crc32",
        "cast(octet_length(media) as long) as media_bytes",
        "sha2(media, 256) as media_sha256",
        "feature",
    )
