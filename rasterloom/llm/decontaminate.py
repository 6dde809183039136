"""Benchmark decontamination with suffix arrays of the training texts.

Training texts are cut into shards of whole documents. All words of a shard are numbered, a stop follows each document, and a suffix array
has the positions of all words in the order of what follows them up to the stop (by prefix doubling). All suffixes of the test items are
searched in it by bisection, word by word, which gives each one's longest verbatim match and the interval of its places. A match of a whole
window (10 words of an item, or all words of a shorter item) hits its words, and is followed on to its end. Words are compared by their
bytes, not only by their hashes.

Shards are independent, so a lost executor costs only its own shards, and there is no exchange of texts. The test items go to the executors
in blocks of at most BLOCK_BYTES bytes of text (a longer item is its own block). A pass over the documents searches up to BLOCKS of them in
each shard's array; further blocks are further passes over the same rows, each adding to what the row has. Nothing else is broadcast.

Words are runs of a-z, 0-9 and characters above ASCII, after A-Z are lower-cased. Null or wordless texts have no words and no hits; null or
wordless items have no windows. Rows that repeat an item_id add their windows to that item. Every row of documents is reported and judged
by its own text, also where a doc_id repeats or is null. Without documents the result is empty; without items nothing is hit. Extra columns
are not read by the report and pass through `decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import _text
from rasterloom.llm._stage import column, lean

WINDOW = 10
#: Text of test items in one broadcast block, and blocks that one pass searches.
BLOCK_BYTES, BLOCKS = 4 << 20, 4
#: Text of one shard; a longer document is its own shard.
SHARD_BYTES = 4 << 20


class TestBlock:
    """The suffixes and windows of some test items, over their own vocabulary."""

    __test__ = False

    def __init__(self, item_ids: list[str], texts: list[str | None], window: int = WINDOW):
        raw, at = _text.column_bytes(pa.array(texts, pa.large_string()))
        start, end, row = _text.words(raw, at, _text.NOT_ALNUM)
        self.item_ids = item_ids
        self.words, code = numbered(_text.Words(raw, start, end))
        n = np.diff(row)
        #: Numbers of words from 1; a stop of 0 follows each item.
        self.codes = np.zeros(len(code) + len(n), np.int64)
        self.suffix = np.arange(len(code)) + np.repeat(np.arange(len(n)), n)
        self.codes[self.suffix] = code + 1
        self.item = np.repeat(np.arange(len(n)), n)
        self.start = np.arange(len(code)) - row[self.item]
        self.length = n[self.item] - self.start
        #: The words of the window that starts at a suffix; 0 where none does.
        size = np.minimum(n, window)[self.item]
        self.window = np.where(self.length >= size, size, 0)
        self.longest = int(n.max()) if len(n) else 0


def numbered(words: _text.Words) -> tuple[_text.Words, np.ndarray]:
    """The distinct words in order of their hashes, and which of them each word is. Other words of a hash follow at the end."""
    if not len(words.size):
        return words, np.empty(0, np.int64)
    _, first, code = np.unique(words.hashes, return_index=True, return_inverse=True)
    wrong = np.flatnonzero(~words.same(np.arange(len(code)), words, first[code]))
    if len(wrong):
        others: dict[bytes, int] = {}
        added = []
        for i in wrong.tolist():
            own = words.bytes(i)
            if own not in others:
                others[own] = len(first) + len(added)
                added.append(i)
            code[i] = others[own]
        first = np.concatenate((first, added))
    return words.taken(first), code


class Shard:
    """The words of a run of documents as numbers from 1, a stop of 0 after each document, and their suffix array."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        start, end, self.row = _text.words(raw, at, _text.NOT_ALNUM)
        self.words, code = numbered(_text.Words(raw, start, end))
        self.n = np.diff(self.row)
        self.begin = self.row[:-1] + np.arange(len(self.n))
        self.codes = np.zeros(len(code) + len(self.n), np.int64)
        self.codes[np.arange(len(code)) + np.repeat(np.arange(len(self.n)), self.n)] = code + 1
        self.bits = max(1, len(self.words.size).bit_length())
        self.pack = max(1, 62 // self.bits)
        self.order = suffix_array(self.codes, self.bits, self.pack)
        self.first = packed(self.codes, self.order, self.bits, self.pack)
        hashes = self.words.hashes
        #: Words in order of their hashes, but for those at the end that share another one's.
        self.sorted = len(hashes) if len(hashes) < 2 or (hashes[1:] > hashes[:-1]).all() else int(np.flatnonzero(hashes[1:] <= hashes[:-1])[0]) + 1
        self.others = {self.words.bytes(i): i for i in range(self.sorted, len(hashes))}

    def of(self, block: TestBlock) -> np.ndarray:
        """The block's codes in this shard's numbers; -1 for a word that the shard does not have."""
        own = np.full(len(block.words.size) + 1, -1, np.int64)
        own[0] = 0
        if self.sorted and len(block.words.size):
            i = np.minimum(np.searchsorted(self.words.hashes[: self.sorted], block.words.hashes), self.sorted - 1)
            same = self.words.same(i, block.words, np.arange(len(i)))
            own[1:] = np.where(same, i + 1, -1)
            if self.others:
                for j in np.flatnonzero(~same).tolist():
                    own[j + 1] = self.others.get(block.words.bytes(j), -2) + 1
        return own[block.codes]

    def searched(self, block: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(codes of the block, longest match of each test suffix, interval of its places, interval of its window's places)."""
        own, q = self.of(block), len(block.suffix)
        best, at_lo, at_hi, win_lo, win_hi = (np.zeros(q, np.int64) for _ in range(5))
        if not len(self.order) or not q:
            return own, best, at_lo, at_hi, win_lo, win_hi
        head = packed(np.maximum(own, 0), block.suffix, self.bits, self.pack)
        live = np.arange(q)
        lo, hi = np.zeros(q, np.int64), np.full(q, len(self.order), np.int64)
        for depth in range(1, block.longest + 1):
            live = live[block.length[live] >= depth]
            want = own[block.suffix[live] + depth - 1]
            live, want = live[want > 0], want[want > 0]
            if not len(live):
                break
            if depth <= self.pack:
                shift = self.bits * (self.pack - depth)
                prefix = head[live] >> shift
                lo[live], hi[live] = np.searchsorted(self.first, prefix << shift), np.searchsorted(self.first, (prefix + 1) << shift)
            else:
                low, high = lo[live], hi[live]
                lo[live] = _bisect(self.codes, self.order, depth - 1, want, low, high)
                hi[live] = _bisect(self.codes, self.order, depth - 1, want + 1, low, high)
            live = live[hi[live] > lo[live]]
            best[live], at_lo[live], at_hi[live] = depth, lo[live], hi[live]
            done = live[block.window[live] == depth]
            win_lo[done], win_hi[done] = lo[done], hi[done]
        return own, best, at_lo, at_hi, win_lo, win_hi

    def matches(self, block: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, its word, test suffix, words) of all places where a window occurs, followed to the end of the match."""
        own, _, _, _, lo, hi = self.searched(block)
        found = np.flatnonzero(hi > lo)
        count = (hi - lo)[found]
        which = np.repeat(found, count)
        places = self.order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[found], count)]
        length = block.window[which]
        going = np.arange(len(which))
        while len(going):
            more = length[going] < block.length[which[going]]
            going = going[more]
            a, b = self.codes[np.minimum(places[going] + length[going], len(self.codes) - 1)], own[block.suffix[which[going]] + length[going]]
            going = going[(a == b) & (a > 0)]
            length[going] += 1
        doc = np.searchsorted(self.begin, places, "right") - 1
        return doc, places - self.begin[doc], which, length


def _bisect(codes: np.ndarray, order: np.ndarray, depth: int, want: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """In each interval of the suffix array, whose suffixes agree before depth: the first whose word there is not below want."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        below = codes[np.minimum(order[mid] + depth, len(codes) - 1)] < want[open_]
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]


def packed(codes: np.ndarray, places: np.ndarray, bits: int, pack: int) -> np.ndarray:
    """The codes of pack words from each place on as one number; after a stop only zeros."""
    out = np.zeros(len(places), np.int64)
    going = np.ones(len(places), bool)
    for i in range(pack):
        at = places + i
        word = np.where(at < len(codes), codes[np.minimum(at, len(codes) - 1)], 0)
        going &= word > 0
        out = (out << bits) | np.where(going, word, 0)
    return out


def suffix_array(codes: np.ndarray, bits: int, pack: int) -> np.ndarray:
    """The places of all words in the order of the words from there to the next stop; equal suffixes in the order of their places."""
    places = np.flatnonzero(codes > 0)
    if not len(places):
        return places
    key = packed(codes, places, bits, pack)
    by = np.argsort(key, kind="stable")
    order, key = places[by], key[by]
    new = np.append(True, key[1:] != key[:-1])
    #: The first place in the order of all that agree with a suffix so far, counted from 1; 0 at stops.
    rank = np.zeros(len(codes) + 1, np.int64)
    group = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    rank[order] = group + 1
    stops = np.append(np.flatnonzero(codes == 0), len(codes))
    end = stops[np.searchsorted(stops, np.arange(len(codes)))]
    # Tied are those that agree with a neighbour and have not ended before depth.
    depth = pack
    tied = (~new | np.append(~new[1:], False)) & (order + depth <= end[order])
    same, group = np.flatnonzero(tied), group[tied]
    while len(same):
        at = order[same]
        key = (group << 31) | rank[at + depth]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[same] = at
        new = np.append(True, key[1:] != key[:-1])
        group = np.maximum.accumulate(np.where(new, same, 0))
        rank[at] = group + 1
        depth *= 2
        tied = (~new | np.append(~new[1:], False)) & (at + depth <= end[at])
        same, group = same[tied], group[tied]
    return order


def test_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcasts of the test items in blocks of a bounded size; the driver holds one block at a time."""
    sc = benchmark.sparkSession.sparkContext
    blocks, ids, texts, size = [], [], [], 0
    for name, own in benchmark.select(column(item_id).cast("string"), column(text).cast("string")).toLocalIterator():
        n = len((own or "").encode())
        if texts and size + n > block_bytes:
            blocks.append(sc.broadcast(TestBlock(ids, texts, window)))
            ids, texts, size = [], [], 0
        ids.append("" if name is None else name)
        texts.append(own)
        size += n
    return [*blocks, sc.broadcast(TestBlock(ids, texts, window))]


_KINDS = {"spans": "array<struct<start: int, end: int>>", "items": "array<string>", "longest": "struct<words: long, item_id: string, item_start: long, at: long>"}
_FOUND = ", ".join(f"{k} {t}" for k, t in _KINDS.items())
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_LONGEST = pa.struct([("words", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64()), ("at", pa.int64())])


def _passed(docs: DataFrame, blocks: list) -> DataFrame:
    """The rows (doc_id, text, n_words, spans, items, longest) with what these blocks add to the last three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in _text.chunks(batch, "text", SHARD_BYTES):
                shard, part = Shard(raw, at), batch.slice(i, j - i)
                spans, items, longest = (part.column(k).to_pylist() for k in (3, 4, 5))
                for block in blocks:
                    _add(shard, block.value, spans, items, longest)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shard.n, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())), pa.array(longest, _LONGEST)], names=["doc_id", "text", "n_words", "spans", "items", "longest"])

    return docs.mapInArrow(lean(run), f"doc_id long, text string, n_words long, {_FOUND}")


def _add(shard: Shard, block: TestBlock, spans: list, items: list, longest: list) -> None:
    """Adds the block's matches to the lists of the rows that have any."""
    doc, at, which, length = shard.matches(block)
    if not len(doc):
        return
    order = np.lexsort((at, -length, doc))
    doc, at, which, length = doc[order], at[order], which[order], length[order]
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(doc)], strict=True):
        d, best = int(doc[a]), longest[doc[a]]
        if best is None or length[a] > best["words"]:
            longest[d] = {"words": int(length[a]), "item_id": block.item_ids[block.item[which[a]]], "item_start": int(block.start[which[a]]), "at": int(at[a])}
        items[d] = sorted({*items[d], *(block.item_ids[k] for k in np.unique(block.item[which[a:b]]).tolist())})
        own = sorted([*((s["start"], s["end"]) for s in spans[d]), *zip(at[a:b].tolist(), (at[a:b] + length[a:b]).tolist(), strict=True)])
        joined = [list(own[0])]
        for start, end in own[1:]:
            if start <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], end)
            else:
                joined.append([start, end])
        spans[d] = [{"start": s, "end": e} for s, e in joined]


def contamination(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of the test items with a window in the document, sorted as strings), spans of hit words, longest
    (words of the longest match, the test item and its word where that begins, the document's word where it does; null without one).
    A row for each row of documents; there is no exchange."""
    found = documents.select(column(doc_id).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    none = {"spans": F.array(), "items": F.array(), "longest": F.lit(None)}
    found = found.select("*", F.lit(0).cast("long").alias("n_words"), *[none[k].cast(t).alias(k) for k, t in _KINDS.items()])
    blocks = test_blocks(benchmark, window=window, block_bytes=block_bytes)
    for i in range(0, len(blocks), BLOCKS):
        found = _passed(found, blocks[i : i + BLOCKS])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "items", "spans", "longest")


def longest_matches(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, start, length, n_places, doc_id, at: for each test suffix with a match of `least` words or more, its longest one
    over all shards, in how many places that is found, and the first place (document and word) of them. Documents without a doc_id
    are not searched."""
    docs = documents.select(column(doc_id).cast("long").alias("doc_id"), column(text).cast("string").alias("text")).where("doc_id is not null")

    def searched(blocks):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for i, _, raw, at in _text.chunks(batch, "text", SHARD_BYTES):
                    shard = Shard(raw, at)
                    for b in (x.value for x in blocks):
                        _, best, lo, hi, _, _ = shard.searched(b)
                        rows = []
                        for s in np.flatnonzero(best >= least):
                            places = shard.order[lo[s] : hi[s]]
                            doc = np.searchsorted(shard.begin, places, "right") - 1
                            d, p = min(zip(ids[i + doc].tolist(), (places - shard.begin[doc]).tolist(), strict=True))
                            rows.append((b.item_ids[b.item[s]], int(b.start[s]), int(best[s]), len(places), d, p))
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        return docs.mapInArrow(lean(run), "item_id string, start long, length long, n_places long, doc_id long, at long")

    names = ["item_id", "start", "length", "n_places", "doc_id", "at"]
    kinds = [pa.string(), *[pa.int64()] * 5]
    found, blocks = None, test_blocks(benchmark, window=least, block_bytes=block_bytes)
    for i in range(0, len(blocks), BLOCKS):
        part = searched(blocks[i : i + BLOCKS])
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("item_id", "start", "length").agg(F.sum("n_places").alias("n_places"), F.min(F.struct("doc_id", "at")).alias("p"))
    top = best.groupBy("item_id", "start").agg(F.max(F.struct("length", "n_places", "p")).alias("m"))
    return top.select("item_id", "start", "m.length", "m.n_places", "m.p.doc_id", "m.p.at")


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without those in which a window of a test item occurs. All columns pass through; there is no exchange."""
    # By number, since the pass cannot take every name.
    kept, at = documents.toDF(*[f"c{i}" for i in range(len(documents.columns))]), documents.columns.index(text)
    schema = kept.schema

    def without(blocks):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = pa.RecordBatch.from_arrays([batch.column(at).cast(pa.large_string())], names=["text"])
                clean = np.ones(batch.num_rows, bool)
                for i, _, raw, offsets in _text.chunks(texts, "text", SHARD_BYTES):
                    shard = Shard(raw, offsets)
                    for block in blocks:
                        clean[i + shard.matches(block.value)[0]] = False
                yield batch.filter(pa.array(clean))

        return run

    blocks = test_blocks(benchmark, window=window, block_bytes=block_bytes)
    for i in range(0, len(blocks), BLOCKS):
        kept = kept.mapInArrow(lean(without(blocks[i : i + BLOCKS])), schema)
    return kept.toDF(*documents.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, the words inside a benchmark window, the items that have such windows there, and the longest match."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce("longest.words", F.lit(0)).cast("long").alias("longest_match"),
        F.col("longest.item_id").alias("longest_item"),
        F.col("longest.at").alias("longest_at"),
    )
