"""Text quality by a generalised additive model with pairwise interactions.

Numbers measured on a text are put into bins at quantiles of the labelled sample. Shallow trees of up to four leaves are boosted in
cycles over the numbers, each on its own number only, so all trees of a number add up to one lookup table. Then the pairs of numbers
that explain most of what is left get tables too, by trees that cut either number once. A score is the logistic function of the sum
of the entries at a text's bins, added for many texts at once.

The model learns from at most MOST_ROWS labelled rows with crc32(doc_id as text) mod 5 other than 0, those with the smallest hash of
their id. Ids, languages, sources and labels are no inputs of a score. The driver gets the sample's numbers only.

A null or empty text is measured as no words and gets a score too. Rows that repeat are scored each. Without usable labels each score
is the share of label 1, or 0.5. Extra columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import _text

MOST_ROWS = 16_000
BINS, PAIR_BINS = 32, 8
CYCLES, PAIR_CYCLES, PAIRS, RATE = 150, 60, 6, 0.15
THRESHOLD = 0.3
NUMBERS = (
    "words", "characters", "word_length", "distinct_words", "repeats_before", "marks", "marked_words", "capitals", "capital_words",
    "digits", "above_ascii", "words_a_line", "distinct_lines", "pipes", "doubled_marks", "distinct_ends",
)

_NEWLINE = np.arange(256) == 0x0A
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_ALPHA = ~_text.NOT_ALNUM & ~_DIGIT
_MARK = _text.NOT_ALNUM & ~_text.SPACE
_PLAIN_END = np.zeros(256, bool)
_PLAIN_END[[*b".,;:?!'\")"]] = True


def measured(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of NUMBERS for each text."""
    rows = len(at) - 1
    size = np.diff(at).astype(float)

    def inside(mask: np.ndarray, edges: np.ndarray = at) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return (sums[edges[1:]] - sums[edges[:-1]]).astype(float)

    start, end, row = _text.words(raw, at, _text.SPACE)
    n = np.diff(row).astype(float)
    hashes = _text.word_hashes(raw, start, end)
    owner = np.repeat(np.arange(rows), np.diff(row))
    distinct = np.diff(_text.distinct_rows(hashes, row)[1])
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    lines_start, lines_end, lines = _text.words(raw, at, _NEWLINE)
    line_hashes = _text.word_hashes(raw, lines_start, lines_end)
    n_lines = np.diff(lines).astype(float)
    kind = raw
    mark = _MARK[kind]
    doubled = np.zeros(len(raw), bool)
    doubled[1:] = mark[1:] & (raw[1:] == raw[:-1])
    letters, capitals = inside(_ALPHA[kind]), inside(_CAPITAL[kind])
    last = raw[end - 1] if len(end) else raw[:0]
    odd_end = mark[end - 1] & ~_PLAIN_END[last] if len(end) else np.empty(0, bool)
    upper = np.concatenate(([0], np.cumsum(_CAPITAL[kind])))
    shouting = (upper[end] - upper[start]) * 2 > (end - start) if len(end) else np.empty(0, bool)
    share = lambda a, b: a / np.maximum(b, 1)
    by_word = lambda mask: np.bincount(owner, mask, rows)
    ends = np.diff(_text.distinct_rows(last.astype(np.uint64), row)[1])
    return np.column_stack([
        np.log1p(n), np.log1p(size), share(size, n), share(distinct, n), share(by_word(again), n), share(inside(mark), size),
        share(by_word(odd_end), n), share(capitals, letters), share(by_word(shouting & (end - start > 1)), n), share(inside(_DIGIT[kind]), size),
        share(inside(raw >= 0x80), size), np.log1p(share(n, n_lines)), share(np.diff(_text.distinct_rows(line_hashes, lines)[1]), n_lines),
        share(inside(raw == 0x7C), size), share(inside(doubled), size), np.log1p(ends),
    ])


@dataclass
class Additive:
    edges: list[np.ndarray]
    constant: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def scores(self, numbers: np.ndarray) -> np.ndarray:
        z = np.full(len(numbers), self.constant)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[j], numbers[:, j], "right")]
        for a, b, table in self.pairs:
            z += table[np.searchsorted(self.pair_edges[a], numbers[:, a], "right"), np.searchsorted(self.pair_edges[b], numbers[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="higher")) if len(x) else np.empty(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """The best cut of bins lo..hi-1 into two leaves: (gain, first bin of the right leaf)."""
    if hi - lo < 2:
        return 0.0, lo
    a, b = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
    gain = _gain(a[:-1], b[:-1]) + _gain(a[-1] - a[:-1], b[-1] - b[:-1]) - _gain(a[-1:], b[-1:])
    i = int(np.argmax(gain))
    return float(gain[i]), lo + i + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values that a tree of depth two gives each bin."""
    _, middle = _best_cut(g, h, 0, len(g))
    cuts = [0, middle, len(g)]
    for lo, hi in ((0, middle), (middle, len(g))):
        gain, at = _best_cut(g, h, lo, hi)
        if gain > 0.5:
            cuts.append(at)
    out = np.zeros(len(g))
    for lo, hi in itertools.pairwise(sorted(set(cuts))):
        out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The values of a tree that cuts both numbers once, and its gain."""
    def corners(x: np.ndarray) -> np.ndarray:
        s = x.cumsum(0).cumsum(1)
        low = s[:-1, :-1]
        return np.stack((low, s[:-1, -1:] - low, s[-1:, :-1] - low, s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + low))

    if min(g.shape) < 2:
        return np.zeros(g.shape), 0.0
    a, b = corners(g), corners(h)
    gain = _gain(a, b).sum(0) - _gain(g.sum(), h.sum())
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = -a[:, i, j] / (b[:, i, j] + 1.0)
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return out, float(gain[i, j])


def fit_additive(numbers: np.ndarray, y: np.ndarray) -> Additive:
    """Learns tables for each number in cycles, then for the pairs that explain most of the rest."""
    model = Additive([_quantiles(x, BINS) for x in numbers.T])
    if not len(y):
        return model
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.constant = float(np.log(share / (1 - share)))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x, "right") for e, x in zip(model.edges, numbers.T, strict=True)]
    z = np.full(len(y), model.constant)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(CYCLES):
        for i, table in zip(at, model.tables, strict=True):
            g, h = slopes()
            more = RATE * _shallow_tree(np.bincount(i, g, len(table)), np.bincount(i, h, len(table)))
            table += more
            z += more[i]
    model.pair_edges = [_quantiles(x, PAIR_BINS) for x in numbers.T]
    at = [np.searchsorted(e, x, "right") for e, x in zip(model.pair_edges, numbers.T, strict=True)]
    size = [len(e) + 1 for e in model.pair_edges]

    def tree(a: int, b: int) -> tuple[np.ndarray, float]:
        g, h = slopes()
        cell = at[a] * size[b] + at[b]
        return _pair_tree(np.bincount(cell, g, size[a] * size[b]).reshape(size[a], size[b]), np.bincount(cell, h, size[a] * size[b]).reshape(size[a], size[b]))

    ranked = sorted(((-tree(a, b)[1], a, b) for a, b in itertools.combinations(range(len(size)), 2)))[:PAIRS]
    model.pairs = [(a, b, np.zeros((size[a], size[b]))) for _, a, b in ranked]
    for _ in range(PAIR_CYCLES):
        for a, b, table in model.pairs:
            more = RATE * tree(a, b)[0]
            table += more
            z += more[at[a], at[b]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _numbers(docs: DataFrame, other: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in _text.chunks(batch, "text"):
                flat = pa.array(measured(raw, at).ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.FixedSizeListArray.from_arrays(flat, len(NUMBERS)).cast(pa.list_(pa.float64()))], names=["doc_id", other, "numbers"])

    return docs.select("doc_id", other, "text").mapInArrow(run, f"doc_id long, {other} int, numbers array<double>")


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = MOST_ROWS) -> Additive:
    """A model of a bounded sample of the labelled documents that are not held out; the sample's ids are broadcast."""
    marked = labels.where(F.col(label).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("mark"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = _numbers(docs.join(F.broadcast(sample), "doc_id"), "mark").toArrow().sort_by("doc_id")
    numbers = np.array(found.column("numbers").to_pylist(), float).reshape(-1, len(NUMBERS))
    return fit_additive(numbers, found.column("mark").to_numpy().astype(float))


def scored(documents: DataFrame, model: Additive, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, and the measured numbers' names are in NUMBERS."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in _text.chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(held.value.scores(measured(raw, at)))], names=["doc_id", "score"])

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = docs.mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score for quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
