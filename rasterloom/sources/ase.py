"""Layered sprite files (the ASE format): header, frames, layers, cels, tags and palette as rows.

The layout follows the format's public specification. Damaged files raise AseError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Magic numbers and chunk types of the format.
FILE, FRAME = 0xA5E0, 0xF1FA
LAYER, CEL, TAGS, PALETTE = 0x2004, 0x2005, 0x2018, 0x2019
DIRECTIONS = ("forward", "reverse", "pingpong", "pingpong-reverse")


class AseError(ValueError):
    """Not a file of this format, or a damaged one."""


@dataclass
class Document:
    width: int
    height: int
    depth: int
    transparent: int
    durations: list[int] = field(default_factory=list)
    layers: list[dict] = field(default_factory=list)
    cels: list[dict] = field(default_factory=list)
    tags: list[dict] = field(default_factory=list)
    palette: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)


def parse(data: bytes) -> Document:
    try:
        return _parse(data)
    except (struct.error, zlib.error, IndexError, UnicodeDecodeError) as e:
        raise AseError(str(e)) from e


def _text(data: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<H", data, at)
    if at + 2 + n > len(data):
        raise AseError("a name is cut off")
    return data[at + 2 : at + 2 + n].decode("utf-8"), at + 2 + n


def _parse(data: bytes) -> Document:
    _, magic, frames, width, height, depth = struct.unpack_from("<IHHHHH", data, 0)
    if magic != FILE or depth not in (8, 16, 32):
        raise AseError("header")
    doc = Document(width, height, depth, data[28] if depth == 8 else -1)
    at = 128
    for f in range(frames):
        size, mark, old, ms = struct.unpack_from("<IHHH", data, at)
        if mark != FRAME or size < 16:
            raise AseError(f"frame {f}")
        (new,) = struct.unpack_from("<I", data, at + 12)
        doc.durations.append(ms)
        here = at + 16
        for _ in range(new or old):
            n, kind = struct.unpack_from("<IH", data, here)
            if n < 6 or here + n > len(data):
                raise AseError("a chunk is cut off")
            _chunk(doc, kind, data[here + 6 : here + n], f)
            here += n
        at += size
    return doc


def _chunk(doc: Document, kind: int, body: bytes, frame: int) -> None:
    if kind == LAYER:
        flags, type_, level, _, _, blend = struct.unpack_from("<HHHHHH", body, 0)
        name, _ = _text(body, 16)
        parent = next((i for i in range(len(doc.layers) - 1, -1, -1) if doc.layers[i]["level"] == level - 1), -1) if level else -1
        doc.layers.append({"index": len(doc.layers), "name": name, "visible": bool(flags & 1), "grouped": type_ == 1, "level": level, "parent": parent, "blend": blend, "opacity": body[12]})
    elif kind == CEL:
        layer, x, y, opacity, type_, z = struct.unpack_from("<HhhBHh", body, 0)
        cel = {"frame": frame, "layer": layer, "x": x, "y": y, "opacity": opacity, "z": z, "link": -1, "width": 0, "height": 0, "rgba": b""}
        if type_ == 1:
            (cel["link"],) = struct.unpack_from("<H", body, 16)
            same = next((c for c in doc.cels if (c["frame"], c["layer"]) == (cel["link"], layer)), None)
            if same is None:
                raise AseError("a link to no cel")
            cel |= {k: same[k] for k in ("width", "height", "rgba")}
        elif type_ in (0, 2):
            cel["width"], cel["height"] = struct.unpack_from("<HH", body, 16)
            raw = zlib.decompress(body[20:]) if type_ == 2 else body[20:]
            cel["rgba"] = _coloured(doc, raw, cel["width"] * cel["height"])
        else:
            return
        doc.cels.append(cel)
    elif kind == TAGS:
        (n,) = struct.unpack_from("<H", body, 0)
        at = 10
        for i in range(n):
            first, last, way, repeat = struct.unpack_from("<HHBH", body, at)
            name, at = _text(body, at + 17)
            doc.tags.append({"ord": i, "name": name, "from_f": first, "to_f": last, "direction": DIRECTIONS[way] if way < 4 else "forward", "repeat": repeat})
    elif kind == PALETTE:
        _, first, last = struct.unpack_from("<III", body, 0)
        at = 20
        for i in range(first, last + 1):
            (named,) = struct.unpack_from("<H", body, at)
            doc.palette[i] = tuple(body[at + 2 : at + 6])
            at += 6
            if named & 1:
                _, at = _text(body, at)


def _coloured(doc: Document, raw: bytes, n: int) -> bytes:
    """RGBA of cel pixels of any depth."""
    if len(raw) != n * doc.depth // 8:
        raise AseError("pixels of a cel")
    if doc.depth == 32:
        return raw
    v = np.frombuffer(raw, np.uint8)
    if doc.depth == 16:
        v = v.reshape(-1, 2)
        return np.column_stack((v[:, 0], v[:, 0], v[:, 0], v[:, 1])).astype(np.uint8).tobytes()
    table = np.zeros((256, 4), np.uint8)
    for i, c in doc.palette.items():
        if i < 256:
            table[i] = c
    table[doc.transparent] = 0
    return table[v].tobytes()


def read(spark: SparkSession, path: str, part: str) -> DataFrame:
    """Rows of one part of every file under a path: layers, cels, tags or frames."""
    schemas = {
        "layers": "path string, index int, name string, visible boolean, grouped boolean, level int, parent int, blend int, opacity int",
        "cels": "path string, frame int, layer int, x int, y int, opacity int, z int, link int, width int, height int, rgba binary",
        "tags": "path string, ord int, name string, from_f int, to_f int, direction string, repeat int",
        "frames": "path string, frame int, width int, height int, ms int",
    }
    names = [c.split()[0] for c in schemas[part].split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in batch.itertuples(index=False):
                doc = parse(bytes(content))
                own = [{"frame": i, "width": doc.width, "height": doc.height, "ms": ms} for i, ms in enumerate(doc.durations)] if part == "frames" else getattr(doc, part)
                rows += [{"path": file, **r} for r in own]
            yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, schemas[part])
