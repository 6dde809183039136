"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document is the ids of its whole text and an end id. Documents are taken in the order of their partition until a group fills
GROUP windows but for SLACK tokens each; the last one may be cut there and goes on in the next group. Whole windows are cut off
documents that have them. What is left is cut into pieces of at most PIECE tokens, and a group's pieces are shared out over its
windows: every piece begins as a partition into GROUP windows of which one is filled; again and again the two partitions with
the largest difference between their fullest and emptiest windows are merged, fullest on emptiest. If a window then holds more
than its capacity, the group is shared out over one window more.

Groups lie within a partition of the input, so there is no exchange, a task holds one group, and a lost task is done again on its
own. A sequence id is the number of the partition and of the sequence in it. Sequences shorter than the capacity are to be padded.

A null text is an empty one: only the end id. Rows without a doc_id and rows that repeat one are packed each. A table without rows gives none. Extra
columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import _tokens
from rasterloom.llm._stage import lean

CAPACITY = 2048
GROUP, SLACK, PIECE = 64, 24, 512
END_ID = 1


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizer vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def differenced(sizes: list[int], k: int) -> np.ndarray:
    """The window in 0..k-1 of each size, by multiway differencing: near-equal sums."""
    if k == 1:
        return np.zeros(len(sizes), np.int64)
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[-1] = size
        heap.append((-size, i, sums))
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        sums -= sums[0]
        node = len(sizes) + len(merges)
        merges.append((i, j, order))
        heapq.heappush(heap, (-int(sums[-1]), node, sums))
    # From the last merge back: which window each place of a partition ended in.
    ends = {heap[0][1]: np.arange(k)} if heap else {}
    for n in range(len(merges) - 1, -1, -1):
        i, j, order = merges[n]
        own = np.empty(k, np.int64)
        own[order] = ends.pop(len(sizes) + n)
        ends[i], ends[j] = own, own[::-1]
    return np.array([ends[i][-1] for i in range(len(sizes))], np.int64)


def shared_out(sizes: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """The window of each size and the number of windows, no window over the capacity. No size may be."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window = differenced(sizes, k)
        if not len(sizes) or np.bincount(window, sizes, k).max() <= capacity:
            return window, k
        k += 1


_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class _Packer:
    def __init__(self, capacity: int, group: int, slack: int, piece: int, base: int):
        self.capacity, self.piece, self.room = capacity, piece, group * (capacity - slack)
        self.next, self.held, self.pieces, self.rows = base, 0, [], []

    def add(self, doc: int, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.capacity:
            self._row(doc, at, ids[at : at + self.capacity], total, self.next, 0)
            self.next += 1
            at += self.capacity
        while at < total:
            n = min(total - at, self.room - self.held)
            parts = -(-n // self.piece)
            for i in range(parts):
                a, b = at + n * i // parts, at + n * (i + 1) // parts
                self.pieces.append((doc, a, ids[a:b], total))
            at += n
            self.held += n
            if self.held >= self.room:
                self.flush()

    def flush(self) -> None:
        if self.pieces:
            window, k = shared_out([len(p[2]) for p in self.pieces], self.capacity)
            fill = [0] * k
            for (doc, start, ids, total), w in zip(self.pieces, window.tolist(), strict=True):
                self._row(doc, start, ids, total, self.next + w, fill[w])
                fill[w] += len(ids)
            self.next += k
            self.pieces, self.held = [], 0

    def _row(self, doc: int, start: int, ids: np.ndarray, total: int, sequence: int, offset: int) -> None:
        self.rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, offset))

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def pack(documents: DataFrame, vocabulary: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group: int = GROUP, slack: int = SLACK, piece: int = PIECE) -> DataFrame:
    """A row for each piece: its document, its first id there, its ids (little-endian, 32 bits each), the document's ids in all,
    its sequence and its place in that. vocabulary is the path of a tokenizers file that the executors can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(capacity, group, slack, piece, TaskContext.get().partitionId() << 33)
        for docs, ids, to in _tokens.encoded(batches, vocabulary):
            end = np.array([end_id], ids.dtype)
            for doc, a, b in zip(docs, to[:-1].tolist(), to[1:].tolist(), strict=True):
                packer.add(doc, np.concatenate((ids[a:b], end)))
                if len(packer.rows) >= 4096:
                    yield packer.taken()
        packer.flush()
        if packer.rows:
            yield packer.taken()

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(lean(run, encoders=True), _SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with a checksum of its ids."""
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
