"""Token-id files: segments of whole documents, coded by a context-mixing range coder.

A segment is one binary value that stands on its own:

    RLT3 | documents, ids, ids a block, blocks, bytes of the tables (32 bits each) | doc_ids, ids of each (64 bits each)
    | whether each has a doc_id (8 bits each) | the tables of orders 0 and 1 (32 bits each, all first bytes, then all second ones, and so
    on, deflated): how many distinct ids and listed pairs; the ids' gaps, how often order 0 gives each, how many ids are listed after it, how
    often others follow; the listed ids, as gaps within a list, and how often each follows
    | for each block: words of the coder, its steps, CRC-32 of its ids (32 bits each) | the blocks' words (16 bits each)
    | CRC-32 of all that precedes

Numbers are little-endian. Every block is coded from the same fresh state, which the tables give (see _rangecoder), so it can be read
without the others; the last one is filled up. Documents lie in ascending doc_id over the segments of a table in the order (part,
segment), where a part is a range of doc_ids. `write` makes the table in the shared folder; `read` decodes it, where damage raises
TokenFileError.

A null text is an empty one: only the end id. Rows without a doc_id come first. Rows that repeat a doc_id follow each other, in an order
of their texts. A table without rows makes no segment. Extra columns are not read. A segment has about SEGMENT ids, but a document is
never cut.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.llm import _rangecoder, _tokens
from rasterloom.llm._stage import written
from rasterloom.llm.packing import tokenizer_path

MAGIC = b"RLT3"
BLOCK, SEGMENT = 1024, 3 << 20
END_ID = 0


class TokenFileError(ValueError):
    """A segment is damaged or of another kind."""


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, ascending, and the place of each id among them."""
    if not len(ids) or ids.min() < 0 or ids.max() >= 1 << 22:
        return np.unique(ids, return_inverse=True)
    held = np.bincount(ids) > 0
    return np.flatnonzero(held), (np.cumsum(held) - 1).astype(np.int32)[ids]


def _packed(distinct: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, ...]) -> bytes:
    listed, symbol, often, others = pairs
    first = np.zeros(len(symbol), bool)
    first[(np.cumsum(listed) - listed)[listed > 0]] = True
    gaps = np.where(first, symbol, np.diff(symbol, prepend=0))
    held = np.concatenate(([len(distinct), len(symbol)], np.diff(distinct, prepend=0), counts, listed, others, gaps, often)).astype("<u4")
    return zlib.compress(held.view(np.uint8).reshape(-1, 4).T.tobytes(), 6)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    held = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    n, k = held[:2].tolist()
    gaps, counts, listed, others, symbol, often = np.split(held[2:], np.cumsum([n, n, n, n, k]))
    to = np.cumsum(symbol)
    begin = (np.cumsum(listed) - listed)[listed > 0]
    return np.cumsum(gaps), counts, (listed, to - np.repeat(np.append(0, to)[begin], listed[listed > 0]), often, others)


def encode_segment(doc_ids: list[int | None], ids: np.ndarray, lengths: list[int], block: int = BLOCK) -> bytes:
    """One segment of the documents whose ids follow each other."""
    size = max(1, min(block, len(ids)))
    blocks = -(-len(ids) // size)
    distinct, place = _distinct(ids)
    table = np.zeros(blocks * size, np.int32)
    table[: len(ids)] = place
    table = table.reshape(blocks, size)
    words: list[np.ndarray] = []
    steps, held = np.empty(0, np.int64), b""
    if blocks:
        pairs, counts = _rangecoder.pairs_of(table, len(distinct))
        held = _packed(distinct, counts, pairs)
        words, steps = _rangecoder.encode(_rangecoder.Tree(distinct, counts, pairs), table)
    directory = np.array([(len(w), n, zlib.crc32(r.tobytes())) for w, n, r in zip(words, steps.tolist(), distinct.astype("<u4")[table], strict=True)], "<u4")
    body = b"".join((
        MAGIC, struct.pack("<IIIII", len(doc_ids), len(ids), size, blocks, len(held)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<i8").tobytes(),
        bytes([d is not None for d in doc_ids]), held, directory.tobytes(), *(w.astype("<u2").tobytes() for w in words),
    ))
    return body + struct.pack("<I", zlib.crc32(body))


def decode_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids, ids of each document); tests the checksum of the whole and of each block."""
    if data[:4] != MAGIC or len(data) < 28:
        raise TokenFileError("not a token segment")
    if zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise TokenFileError("checksum of the segment")
    docs, total, size, blocks, held = struct.unpack_from("<IIIII", data, 4)
    known = np.frombuffer(data, np.uint8, docs, 24 + 16 * docs).tolist()
    doc_ids = [d if k else None for d, k in zip(np.frombuffer(data, "<i8", docs, 24).tolist(), known, strict=True)]
    lengths = np.frombuffer(data, "<i8", docs, 24 + 8 * docs)
    at = 24 + 17 * docs
    tables = data[at : at + held]
    at += held
    directory = np.frombuffer(data, "<u4", 3 * blocks, at).reshape(-1, 3).astype(np.int64)
    at += 12 * blocks
    stream = np.frombuffer(data, "<u2", int(directory[:, 0].sum()), at)
    parts = np.split(stream, np.cumsum(directory[:, 0]))[:-1]
    raw = np.empty((0, size), "<u4")
    if blocks:
        distinct, counts, pairs = _unpacked(tables)
        raw = distinct.astype("<u4")[_rangecoder.decode(_rangecoder.Tree(distinct, counts, pairs), parts, directory[:, 1], size)]
    for i, row in enumerate(raw):
        if zlib.crc32(row.tobytes()) != directory[i, 2]:
            raise TokenFileError(f"checksum of block {i}")
    ids = raw.ravel()[:total]
    if lengths.sum() != total:
        raise TokenFileError("lengths of the documents")
    return doc_ids, ids, lengths


def write(documents: DataFrame, vocabulary: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, segment: int = SEGMENT) -> tuple[DataFrame, str]:
    """A table (part, number, before, n_ids, data) of segments in the shared folder, and its path; ranges of doc_id are its parts, and
    before is how many ids of the part come before the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        names, kept, lengths, held = [], [], [], 0

        def made(most: int) -> pa.RecordBatch:
            """The first documents, up to `most` ids but one document at least, as a segment."""
            nonlocal names, kept, lengths, held, number, before
            n = max(1, int(np.searchsorted(np.cumsum(lengths), most, "right")))
            ids = sum(lengths[:n])
            data = encode_segment(names[:n], np.concatenate(kept[:n]), lengths[:n], block)
            batch = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([ids], pa.int64()), pa.array([data], pa.large_binary()).cast(pa.binary())], names=["part", "number", "before", "n_ids", "data"])
            names, kept, lengths, held, number, before = names[n:], kept[n:], lengths[n:], held - ids, number + 1, before + ids
            return batch

        end = np.array([end_id], np.int32)
        for docs, ids, to in _tokens.encoded(batches, vocabulary):
            for doc, a, b in zip(docs, to[:-1].tolist(), to[1:].tolist(), strict=True):
                names.append(doc)
                kept.append(np.concatenate((ids[a:b], end)))
                lengths.append(b - a + 1)
                held += b - a + 1
            while held >= 2 * segment:
                yield made(segment)
        # What is left goes into one or two of much the same size: few short lanes of blocks.
        while names:
            yield made(held if held <= segment * 3 // 2 else held // 2)

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # The hash of the text parts rows that repeat a doc_id over tasks.
    order = ["doc_id", F.xxhash64("text")]
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ordered.mapInArrow(run, "part int, number int, before long, n_ids long, data binary"), "tokens")


_READ = "part int, number int, place int, doc_id long, before long, ids binary"


def read(segments: DataFrame) -> DataFrame:
    """part, number, place (in the segment), doc_id, before (ids of the part before it), ids (little-endian, 32 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, before, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs, ids, lengths = decode_segment(data)
                to = np.concatenate(([0], np.cumsum(lengths))).tolist()
                first = [x + before for x in to]
                for i in range(0, len(docs), 4096):
                    j = min(len(docs), i + 4096)
                    n = j - i
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array(np.arange(i, j, dtype=np.int32)), pa.array(docs[i:j], pa.int64()), pa.array(first[i:j], pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(to[i:j], to[i + 1 : j + 1], strict=True)], pa.binary())],
                        names=["part", "number", "place", "doc_id", "before", "ids"],
                    )

    return segments.select("part", "number", "before", "data").mapInArrow(run, _READ)


def starts(segments: DataFrame) -> DataFrame:
    """part, start: the ids of all parts before each. There are as many rows as the range exchange made parts, which its setting bounds."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("start"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, number of ids and checksum, from the decoded files."""
    segments, _ = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))
    found = read(segments).select("part", "doc_id", "before", F.octet_length("ids").alias("bytes"), F.crc32("ids").alias("ids_crc32"))
    return found.join(F.broadcast(starts(segments)), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), (F.col("bytes") / 4).cast("long").alias("n_tokens"), "ids_crc32")
