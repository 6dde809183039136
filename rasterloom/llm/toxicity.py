"""Toxicity by a classifier chain of linear models.

Features are the words of a text and their first 4, 5 and 6 bytes; a value is log(1 + count). Of the features of the labelled sample
those that part the labels best (chi squared) are kept. The categories are learned one after the other: each logistic model also gets
the probabilities of the categories before it. For the rows it learns from these are out-of-fold: each fold's come from models whose
features were chosen, and which were learned, without it; for other texts they come from models of all rows.

A table of labels may have any 0/1 categories, the last of which decides. `labels` of the test data marks only toxic texts, so
`weak_categories` makes two kinds of its toxic rows: dense (a large share of cue words) and repeated (a cue word more than once), with the
cue words that the other folds have.

The models learn from at most MOST_POSITIVE and MOST_NEGATIVE labelled rows, those with the smallest hash of their id, and of at most
MOST_FEATURES features a fold; labels of null are not used, and of an id with several texts the least one is. The driver gets the kept
features of that sample, and executors get their weights for each category.

A null or empty text has the probability that the models give no features. Rows that repeat, or that have no doc_id, are scored each. The
categories are the same whatever the labels are: where all rows have one label, each category's probability is near its share, and
without labelled rows it is near 0. Extra columns pass through `without_toxic`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import _text
from rasterloom.llm._stage import column, lean, removed, written

MOST_POSITIVE, MOST_NEGATIVE, MOST_FEATURES = 4_000, 8_000, 2_048
FOLDS = 3
PREFIXES = (4, 5, 6)
THRESHOLD = 0.5


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and prefix, as 64-bit hashes."""
    start, end, row = _text.words(raw, at, _text.NOT_ALNUM)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(row))
    rows, found = [owner], [_text.word_hashes(raw, start, end)]
    for n in PREFIXES:
        long = end - start >= n
        with np.errstate(over="ignore"):
            found.append(_text.mix(_text.word_hashes(raw, start[long], start[long] + n) + np.uint64(n)))
        rows.append(owner[long])
    return np.concatenate(rows), np.concatenate(found)


@dataclass
class Chain:
    categories: list[str]
    known: np.ndarray
    weights: list[np.ndarray]
    threshold: float = THRESHOLD

    def counts(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse values of the known features: (row, feature, value)."""
        row, found = features(raw, at)
        if not len(self.known) or not len(found):
            none = np.empty(0, np.int64)
            return none, none, none.astype(float)
        i = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        ok = self.known[i] == found
        cell, n = np.unique(row[ok] * len(self.known) + i[ok], return_counts=True)
        return cell // len(self.known), cell % len(self.known), np.log1p(n)

    def probabilities(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        row, feature, value = self.counts(raw, at)
        out = np.empty((len(at) - 1, len(self.categories)))
        for j, w in enumerate(self.weights):
            z = np.bincount(row, value * w[feature], len(at) - 1) + out[:, :j] @ w[len(self.known) : -1] + w[-1]
            out[:, j] = _sigmoid(z)
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(row: np.ndarray, feature: np.ndarray, value: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int, l2: float = 0.05, rounds: int = 80, memory: int = 8) -> np.ndarray:
    """Weights of sparse features, extra columns and a constant, with balanced classes and a squared penalty, by L-BFGS."""
    n, k = extra.shape
    w = np.zeros(width + k + 1)
    if y.all() or not y.any():
        w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
        return w
    balance = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    penalty = np.full(width + k + 1, l2)
    penalty[-1] = 0

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, value * w[feature], n) + extra @ w[width:-1] + w[-1]
        off = (_sigmoid(z) - y) * balance
        slope = np.concatenate((np.bincount(feature, value * off[row], width), extra.T @ off, [off.sum()])) + penalty * w
        return float((balance * (np.logaddexp(0, z) - y * z)).sum() + (penalty * w * w).sum() / 2), slope

    at, slope = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        way, kept = slope.copy(), []
        for s, d, r in reversed(steps):
            a = r * (s @ way)
            way -= a * d
            kept.append(a)
        way *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.abs(slope).sum())
        for (s, d, r), a in zip(steps, reversed(kept), strict=True):
            way += s * (a - r * (d @ way))
        size, fall = 1.0, slope @ way
        if fall <= 1e-6:
            break
        while True:
            next_at, next_slope = loss(w - size * way)
            if next_at <= at - 1e-4 * size * fall or size < 1e-8:
                break
            size /= 2
        s, d = -size * way, next_slope - slope
        if s @ d > 1e-12:
            steps = [*steps, (s, d, 1 / (s @ d))][-memory:]
        w, at, slope = w + s, next_at, next_slope
    return w


def weak_categories(row: np.ndarray, feature: np.ndarray, value: np.ndarray, toxic: np.ndarray, width: int, fold: np.ndarray) -> dict[str, np.ndarray]:
    """Categories from the toxic mark alone: which toxic rows have many cue features, and which have one of them several times. What is
    a cue for a row is found in the rows of other folds."""
    n = len(toxic)
    count, most = np.zeros(n), np.zeros(n)
    for f in np.unique(fold):
        there = fold[row] != f
        learn = toxic[fold != f]
        inside = np.bincount(feature[there], toxic[row[there]] > 0, width)
        outside = np.bincount(feature[there], toxic[row[there]] == 0, width)
        cue = inside / max(1, learn.sum()) > 20 * (outside + 0.5) / max(1, len(learn) - learn.sum())
        own = ~there
        found = cue[feature[own]] * np.expm1(value[own])
        count += np.bincount(row[own], found, n)
        np.maximum.at(most, row[own], found)
    middle = np.median(count[toxic == 1]) if toxic.any() else 0
    return {"dense": ((toxic == 1) & (count >= max(middle, 1))).astype(float), "repeated": ((toxic == 1) & (most > 1.5)).astype(float)}


def learned(known: np.ndarray, row: np.ndarray, feature: np.ndarray, value: np.ndarray, categories: dict[str, np.ndarray], fold: np.ndarray, chosen: np.ndarray) -> Chain:
    """The chain of the categories in their order, from sparse values (row, place in known, value).

    fold is each row's; chosen has a line for each fold, of the features chosen without it, and a last one, of those chosen from all."""
    n = len(fold)
    chain = Chain(list(categories), known[chosen[-1]], [])
    width = len(known)
    outside = np.zeros((n, 0))
    for y in categories.values():
        use = chosen[-1][feature]
        place = np.cumsum(chosen[-1]) - 1
        chain.weights.append(_logistic(row[use], place[feature[use]], value[use], outside, y, len(chain.known)))
        own = np.zeros(n)
        for f in range(len(chosen) - 1):
            use = chosen[f][feature]
            there, here = use & (fold[row] != f), use & (fold[row] == f)
            learn = np.flatnonzero(fold != f)
            to = np.full(n, -1)
            to[learn] = np.arange(len(learn))
            w = _logistic(to[row[there]], feature[there], value[there], outside[learn], y[learn], width)
            z = np.bincount(row[here], value[here] * w[feature[here]], n) + outside @ w[width:-1] + w[-1]
            own = np.where(fold == f, _sigmoid(z), own)
        outside = np.column_stack((outside, own))
    return chain


def _feature_counts(sample: DataFrame) -> DataFrame:
    """feature, fold, positive, total: in how many rows, summed over a batch before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(1).to_numpy(zero_copy_only=False)
            folds = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j, raw, at in _text.chunks(batch, "text"):
                row, found = features(raw, at)
                order = np.lexsort((row, found))
                row, found = row[order], found[order]
                new = np.append(True, (found[1:] != found[:-1]) | (row[1:] != row[:-1]))[: len(row)]
                each, code = np.unique(found[new], return_inverse=True)
                code = code * FOLDS + folds[i:j][row[new]]
                total = np.bincount(code, minlength=len(each) * FOLDS)
                positive = np.bincount(code, marks[i:j][row[new]], len(each) * FOLDS).astype(np.int64)
                held = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)[held // FOLDS]), pa.array((held % FOLDS).astype(np.int32)), pa.array(positive[held]), pa.array(total[held])], names=["feature", "fold", "positive", "total"])

    counts = sample.select("id", "mark", "fold", "text").mapInArrow(lean(run), "feature long, fold int, positive long, total long")
    return counts.groupBy("feature").agg(*[F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(FOLDS + 1) for c in ("positive", "total")])


def _values(sample: DataFrame, known: np.ndarray) -> DataFrame:
    held = Chain([], known, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in _text.chunks(batch, "text"):
                row, feature, value = held.counts(raw, at)
                to = pa.array(np.searchsorted(row, np.arange(j - i + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, j - i) for c in batch.columns[:3]), pa.ListArray.from_arrays(to, pa.array(feature, pa.int32())), pa.ListArray.from_arrays(to, pa.array(value))], names=["id", "mark", "fold", "features", "values"]
                )

    return sample.select("id", "mark", "fold", "text").mapInArrow(lean(run), "id long, mark int, fold int, features array<int>, values array<double>")


def fit(documents: DataFrame, labels: DataFrame, category: str = "toxic", doc_id: str = "doc_id", text: str = "text", positive: int = MOST_POSITIVE, negative: int = MOST_NEGATIVE, most_features: int = MOST_FEATURES) -> Chain:
    """A chain learned from a bounded sample of the labelled documents. Its ids are broadcast and its texts written to the shared folder;
    executors count features, and the driver gets the counts of the kept ones."""
    spark = documents.sparkSession
    marked = labels.where(column(category).isNotNull()).groupBy(column(doc_id).cast("long").alias("id")).agg(F.max(column(category).cast("int")).alias("mark"))
    by = F.xxhash64("id")
    chosen = marked.where("mark = 1").orderBy(by, "id").limit(positive).union(marked.where("mark = 0").orderBy(by, "id").limit(negative))
    docs = documents.select(column(doc_id).cast("long").alias("id"), column(text).cast("string").alias("text")).where("text is not null")
    # One text for each id, so that the sample is bounded whatever ids repeat.
    one = docs.join(F.broadcast(chosen), "id").groupBy("id", "mark").agg(F.min("text").alias("text"))
    sample, path = written(one.select("id", "mark", F.pmod(by, F.lit(FOLDS)).cast("int").alias("fold"), "text"), "toxic")
    stats = sample.groupBy("fold").agg(F.count("*").alias("n"), F.sum("mark").alias("marks")).collect()
    n = sum(r.n for r in stats)
    if not n:
        removed(spark, path)
        names = [*weak_categories(*[np.empty(0, np.int64)] * 4, 0, np.empty(0)), category]
        return Chain(names, np.empty(0, np.uint64), [np.append(np.zeros(i), -30.0) for i in range(len(names))])
    counts, counts_path = written(_feature_counts(sample), "features")
    lists = []
    for f in range(FOLDS + 1):
        rows = sum(r.n for r in stats if r.fold != f)
        share = sum(r.marks for r in stats if r.fold != f) / max(1, rows)
        expected = F.col(f"total{f}") * F.lit(share)
        chi = F.pow(F.col(f"positive{f}") - expected, 2) / F.greatest(expected * F.lit(1 - share), F.lit(1e-9))
        best = counts.where(f"total{f} >= 3").withColumn("chi", chi).where("chi > 10").orderBy(F.desc("chi"), "feature").limit(most_features)
        lists.append(np.array([r.feature for r in best.select("feature").collect()], np.int64).view(np.uint64))
    removed(spark, counts_path)
    known = np.unique(np.concatenate(lists))
    rows = _values(sample, known).toArrow().sort_by("id")
    removed(spark, path)
    found = rows.column("features").combine_chunks()
    row = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy(zero_copy_only=False))
    feature, value = found.flatten().to_numpy().astype(np.int64), rows.column("values").combine_chunks().flatten().to_numpy()
    toxic, fold = rows.column("mark").to_numpy().astype(float), rows.column("fold").to_numpy()
    categories = weak_categories(row, feature, value, toxic, len(known), fold) | {category: toxic}
    return learned(known, row, feature, value, categories, fold, np.array([np.isin(known, x) for x in lists]))


def scored(documents: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, a probability p_<category> for each category of the chain, and the last category's decision as a boolean."""
    names = chain.categories
    held = documents.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in _text.chunks(batch, "text"):
                p = held.value.probabilities(raw, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *[pa.array(c) for c in p.T], pa.array(p[:, -1] >= held.value.threshold)], names=["doc_id", *[f"p_{c}" for c in names], names[-1]]
                )

    docs = documents.select(column(doc_id).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    return docs.mapInArrow(lean(run), ", ".join(["doc_id long", *[f"p_{c} double" for c in names], f"{names[-1]} boolean"]))


def without_toxic(documents: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """The documents that the chain does not reject. All columns pass through; there is no exchange."""
    held, at = documents.sparkSession.sparkContext.broadcast(chain), documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at).cast(pa.large_string())], names=["text"])
            clean = np.ones(batch.num_rows, bool)
            for i, j, raw, offsets in _text.chunks(texts, "text"):
                clean[i:j] = held.value.probabilities(raw, offsets)[:, -1] < held.value.threshold
            yield batch.filter(pa.array(clean))

    # By number, since the pass cannot take every name.
    plain = documents.toDF(*[f"c{i}" for i in range(len(documents.columns))])
    return plain.mapInArrow(lean(run), plain.schema).toDF(*documents.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's category probabilities and whether it is toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
