"""PNG as a source and a sink: files of 8-bit images to rasters and back.

`read` lists files with Spark's binaryFile source and decodes them on the executors; `write` gives encoded images as a binary column, which
Spark's own writers store. `sizes` reads the header alone from the first bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class PngError(ValueError):
    """Not an image that this reader knows, or a damaged one."""


def _pieces(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise PngError("signature")
    at = 8
    while at + 12 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) != n or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise PngError(f"chunk {kind!r}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + n
    raise PngError("no end")


def _lines(raw: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    """Undoes the line filters; `step` is the bytes of a pixel."""
    table = raw.reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    up = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = int(table[y, 0]), table[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y] = line + up
        elif kind in (3, 4):
            left, corner = np.zeros(step, np.int16), np.zeros(step, np.int16)
            for x in range(0, stride, step):
                above = up[x : x + step].astype(np.int16)
                if kind == 3:
                    guess = (left + above) >> 1
                else:
                    dl, du, dc = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
                    guess = np.where((dl <= du) & (dl <= dc), left, np.where(du <= dc, above, corner))
                left = (line[x : x + step] + guess) & 255
                out[y, x : x + step] = left
                corner = above
        else:
            raise PngError(f"filter {kind}")
        up = out[y]
    return out


def decode(data: bytes) -> np.ndarray:
    """RGBA of an 8-bit image without interlace, as (height, width, 4)."""
    parts: dict[bytes, bytes] = {}
    packed = []
    for kind, body in _pieces(data):
        if kind == b"IDAT":
            packed.append(body)
        else:
            parts[kind] = body
    if b"IHDR" not in parts:
        raise PngError("no header")
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if depth != 8 or interlace or colour not in _CHANNELS:
        raise PngError("only 8-bit images without interlace")
    n = _CHANNELS[colour]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise PngError(str(e)) from e
    if len(raw) != height * (width * n + 1):
        raise PngError("size")
    v = _lines(raw, height, width * n, n).reshape(height, width, n)
    out = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        palette = np.frombuffer(parts.get(b"PLTE", b""), np.uint8).reshape(-1, 3)
        if len(palette) <= int(v.max(initial=0)):
            raise PngError("palette")
        out[..., :3] = palette[v[..., 0]]
        alpha = np.full(256, 255, np.uint8)
        clear = np.frombuffer(parts.get(b"tRNS", b""), np.uint8)
        alpha[: len(clear)] = clear
        out[..., 3] = alpha[v[..., 0]]
    else:
        out[..., :3] = v[..., :3] if n > 2 else v[..., :1]
        if n in (2, 4):
            out[..., 3] = v[..., n - 1]
    return out


def encode(rgba: np.ndarray, level: int = 6) -> bytes:
    """An RGBA image; lines are filtered against the one above."""
    height, width, _ = rgba.shape
    flat = np.ascontiguousarray(rgba, np.uint8).reshape(height, width * 4)
    lines = np.empty((height, width * 4 + 1), np.uint8)
    lines[:, 0] = 2
    lines[:, 1:] = flat - np.vstack((np.zeros((1, width * 4), np.uint8), flat[:-1])) if height else flat
    put = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + put(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + put(b"IDAT", zlib.compress(lines.tobytes(), level)) + put(b"IEND", b"")


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, rgba of every PNG file under a path; one row a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                image = decode(batch.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([image.shape[1]], pa.int32()), pa.array([image.shape[0]], pa.int32()), pa.array([image.tobytes()], pa.binary())], names=["path", "width", "height", "rgba"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, width int, height int, rgba binary")


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height from the header, by SQL alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    return files.where(F.hex(F.substring("content", 1, 8)) == SIGNATURE.hex().upper()).select("path", number(17).alias("width"), number(21).alias("height"))


def exploded(rasters: DataFrame, key: str = "path") -> DataFrame:
    """(key, x, y, r, g, b, a) of packed rasters (width, height, rgba): a row for each pixel, by SQL alone."""
    places = F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1))
    at = rasters.where("width > 0 and height > 0").select(key, "width", F.hex("rgba").alias("hex"), places.alias("p"))
    byte = lambda c: F.conv(F.substring(F.col("hex"), F.col("p") * 8 + 1 + 2 * c, F.lit(2)), 16, 10).cast("int")
    return at.select(key, (F.col("p") % F.col("width")).cast("int").alias("x"), F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), *[byte(c).alias(n) for c, n in enumerate("rgba")])


def packed(pixels: DataFrame, key: str) -> DataFrame:
    """(key, width, height, rgba) of dense pixels; one raster is one group."""
    value = F.concat(*[F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in "rgba"])
    rows = pixels.groupBy(key).agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"), F.sort_array(F.collect_list(F.struct("y", "x", value.alias("v")))).alias("p"))
    return rows.select(key, "width", "height", F.unhex(F.array_join(F.transform("p", lambda p: p["v"]), "")).alias("rgba"))


def write(rasters: DataFrame, key: str) -> DataFrame:
    """(key, png) of packed rasters (key, width, height, rgba)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w, h, rgba = (batch.column(c)[i].as_py() for c in (1, 2, 3))
                image = encode(np.frombuffer(rgba, np.uint8).reshape(h, w, 4))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([image], pa.binary())], names=["key", "png"])

    kind = dict(rasters.dtypes)[key]
    return rasters.select(F.col(key).alias("key"), "width", "height", "rgba").mapInArrow(run, f"key {kind}, png binary")
