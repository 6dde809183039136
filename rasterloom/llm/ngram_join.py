"""N-gram Jaccard join with PartEnum signatures (Arasu, Ganti and Kaushik 2006), exact.

A document's set holds its distinct k-word shingles. Sizes are cut into bands [l, r]; two sets whose Jaccard similarity reaches the
threshold lie in one band or in neighbouring ones, where the smaller is at least threshold * l. So a set takes part in the level of
its own band and, if large enough, in that of the next. At a level, linked sets differ in at most d = 2 r (1 - t) / (1 + t) features.
The feature domain is dealt by hash into n1 partitions of n2 parts. Of n1 = d // (k2 + 1) + 1 + spare partitions, at least spare + 1
differ in k2 features at most, and for each there is a subset of n2 - k2 parts that do not differ at all. Every subset's features
make one signature. Where subsets are single parts, as by default, the same is counted by parts: of n1 * n2 = d + 1 + spare parts, at
least spare + 1 do not differ. Signatures of no features would be shared by strangers; they are never made. A set with more than
`spare` partitions (or parts) that lack features takes part once more with the domain dealt by another hash, and so on until it has
not: of two linked sets, the one that stops first shares a signature of features there.

Equal sets are one class. The smallest document that has a signature is its hub; a hub's group are all that share any of its
signatures with it. So any two sets with a common signature meet in a group. Signatures are counted by an aggregate that sums on the map
side; only those that occur again are joined with their hubs, and the few that many documents have are dealt over tasks there. A group of
up to BLOCK sets and BLOCK_FEATURES features is compared whole in one task. A larger one is first compared in blocks that each hold the
hub too; members that links join to the hub by then need no comparison with each other, and the rest are compared with them and among
themselves in pairs of blocks. A task gives back only a spanning forest of the links. The components of the links are final.

Features are 64-bit hashes of shingles, made of hashes that mix every 8 bytes of a word; sets are named by 128-bit sums of them.

Texts of null or without words have an empty set, which is linked with nothing. Rows without a doc_id are reported with the size of their
set and are no one's class or component. Rows that repeat a document are given back each. A doc_id with several different texts is one
document with the links of all of them; `one_of_each` never drops its rows, since the other texts would go with one. Extra columns are not
read by the report and pass through `one_of_each`. A table without rows gives none.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import _text
from rasterloom.llm._stage import column, fresh, lean, removed, salted_join, written
from rasterloom.llm.components import components

#: Parts of a partition, and how many of them may differ.
PARTS, DIFFERING = 2, 1
#: A block of a large group: sets, and features of them all; when it is first compared, and when blocks are compared in pairs.
BLOCK, BLOCK_FEATURES = 512, 500_000
PAIR_BLOCK, PAIR_FEATURES = 1024, 1_000_000
#: Sets of like sizes that are compared at once.
STRIP = 256
#: Ways to deal the domain before signatures of no features are made after all.
MOST_DEALS = 200
#: A signature of more than one in HOT of all rows of shared signatures, of which there are fewer than HOT, is dealt over SALTS tasks.
HOT, SALTS = 4096, 64
#: Sets that a task remembers, so as to give the signatures of equal ones once; then it begins anew.
MOST_SEEN = 100_000
#: Bytes of text that are turned into sets at once.
CHUNK = 512 << 10

_U = np.uint64


@lru_cache(maxsize=None)
def _bands(percent: int) -> tuple[list[int], list[int]]:
    """First and last sizes of the bands; the first band begins where two different sets can be linked."""
    first = -(-percent // (100 - percent))
    low, high = [first], []
    steps = max(1, int(np.ceil(np.log(1.24) / np.log(100 / percent))))
    while low[-1] < 1 << 40:
        r = low[-1]
        for _ in range(steps):
            r = max(r, r * 100 // percent)
        high.append(r)
        low.append(r + 1)
    return low[:-1], high


@lru_cache(maxsize=None)
def _level(percent: int, level: int, parts: int, differing: int) -> tuple[int, int]:
    """(partitions, spare) of a level: the least number of which its smallest sets rarely (at two deviations) have too many empty."""
    low, high = _bands(percent)
    smallest, d = max(1, low[level] * percent // 100), 2 * high[level] * (100 - percent) // (100 + percent)
    single = parts - differing == 1
    n1 = (d + 1) // parts + 1 if single else d // (differing + 1) + 2
    while True:
        spare = n1 * parts - d - 1 if single else n1 - d // (differing + 1) - 1
        empty = (1 - (parts - differing) / (n1 * parts)) ** smallest
        mean = n1 * parts * empty if single else n1 * (1 - (1 - empty) ** parts)
        if spare >= max(1, mean + 2 * mean**0.5) or spare > 2 * d + 4:
            return n1, spare
        n1 += max(1, int((mean - spare) / 4))


def signatures(values: np.ndarray, to: np.ndarray, percent: int, parts: int = PARTS, differing: int = DIFFERING) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of all rows' distinct features, as signed 64-bit numbers."""
    n = np.diff(to)
    low, high = (np.array(x) for x in _bands(percent))
    band = np.searchsorted(low, n, "right") - 1
    own = np.flatnonzero(band >= 0)
    above = own[n[own] * 100 >= low[np.minimum(band[own] + 1, len(low) - 1)] * percent]
    row, level = np.concatenate((own, above)), np.concatenate((band[own], band[above] + 1))
    # A set may lie just under the first band that has room for a different set.
    under = np.flatnonzero((band < 0) & (n * 100 >= low[0] * percent) & (n > 0))
    row, level = np.concatenate((row, under)), np.concatenate((level, np.zeros(len(under), np.int64)))
    rows, sigs = [], []
    subsets = list(itertools.combinations(range(parts), parts - differing))
    for deal in range(MOST_DEALS):
        if not len(row):
            break
        known = [_level(percent, x, parts, differing) for x in level.tolist()]
        n1, spare = np.array([x[0] for x in known]), np.array([x[1] for x in known])
        begin = np.concatenate(([0], np.cumsum(n1)))
        count = n[row]
        owner = np.repeat(np.arange(len(row)), count)
        v = values[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(to[:-1][row], count)]
        with np.errstate(over="ignore"):
            dealt = _text.mix(v + _U(0x9E3779B97F4A7C15) * (_U(deal * 1_000_003 + 1) + level[owner].astype(_U) * _U(7919)))
            part = ((dealt >> _U(32)) * (n1[owner] * parts).astype(_U)) >> _U(32)
            place = part.astype(np.int64) + begin[owner] * parts
            total = int(begin[-1]) * parts
            sums = np.zeros(total, _U)
            np.add.at(sums, place, _text.mix(v ^ _U(0xD1B54A32D192ED03)))
            held = np.bincount(place, minlength=total).reshape(-1, parts)
            sums = sums.reshape(-1, parts)
            task = np.repeat(np.arange(len(row)), n1)
            number = np.arange(begin[-1]) - begin[:-1][task]
            lacking = (held == 0).sum(1) if parts - differing == 1 else np.zeros(begin[-1], bool)
            for s, subset in enumerate(subsets):
                filled = held[:, subset].sum(1) > 0
                if parts - differing > 1:
                    lacking |= ~filled
                if deal == MOST_DEALS - 1:
                    filled[:] = True
                mark = _text.mix(((level[task].astype(_U) * _U(1 << 34) + number.astype(_U)) * _U(len(subsets)) + _U(s)) * _U(MOST_DEALS) + _U(deal))
                sigs.append(_text.mix(sums[:, subset].sum(1, dtype=_U) ^ mark)[filled])
                rows.append(row[task[filled]])
        again = np.bincount(task, lacking, len(row)) > spare
        row, level = row[again], level[again]
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(sigs).view(np.int64)


def _sets(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    start, end, row = _text.words(raw, at, _text.SPACE)
    return _text.distinct_rows(*_text.shingle_hashes(_text.word_hashes(raw, start, end), row, k))


def _class_keys(values: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent sums over each row's features."""
    out = []
    with np.errstate(over="ignore"):
        for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
            sums = np.zeros(len(values) + 1, _U)
            np.cumsum(_text.mix(values ^ _U(salt)), out=sums[1:])
            out.append((sums[to[1:]] - sums[to[:-1]]).view(np.int64))
    return out[0], out[1]


def _texts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(column(doc_id).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))


def shingle_classes(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (size of its set), k1, k2 (what stands for the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in _text.chunks(batch, "text", CHUNK):
                values, to = _sets(raw, at, k)
                k1, k2 = _class_keys(values, to)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(to)), pa.array(k1), pa.array(k2)], names=["doc_id", "n", "k1", "k2"])

    return docs.mapInArrow(lean(run), "doc_id long, n long, k1 long, k2 long")


def part_enum(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """sig, doc_id: the signatures of each set; of equal sets in one task only the first gives them. doc_id must not be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, raw, at in _text.chunks(batch, "text", CHUNK // 2):
                if len(seen) > MOST_SEEN:
                    seen.clear()
                values, to = _sets(raw, at, k)
                new = np.zeros(j - i, bool)
                for r, key in enumerate(zip(*(x.tolist() for x in _class_keys(values, to)), strict=True)):
                    if key not in seen:
                        seen.add(key)
                        new[r] = True
                n = np.diff(to)
                values, to = values[np.repeat(new, n)], np.concatenate(([0], np.cumsum(n[new])))
                row, sig = signatures(values, to, percent)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(ids[i:j][new][row])], names=["sig", "doc_id"])

    return docs.mapInArrow(lean(run), "sig long, doc_id long")


def _forest(ids: list[int], texts: list[str | None], sides: list[int | None], k: int, percent: int) -> list[tuple[int, int]]:
    """Edges from each document to the smallest one that links reach among these. All sets are compared exactly, but for those of one
    side where sides are given, and those whose sizes are too far apart."""
    raw, at = _text.column_bytes(pa.array(texts, pa.large_string()))
    values, to = _sets(raw, at, k)
    # In order of side, then of size.
    n, side = np.diff(to), np.array([-1 if x is None else x for x in sides])
    order = np.lexsort((n, side))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row = place[np.repeat(np.arange(len(n)), n)]
    n, side, ids_ = n[order], side[order], np.array(ids)[order]
    _, code, often = np.unique(values, return_inverse=True, return_counts=True)
    both = np.zeros((len(n), len(n)), np.float32)
    shared = np.flatnonzero(often > 1)
    column = np.full(len(often), -1)
    column[shared] = np.arange(len(shared))
    column = column[code]
    by_column = np.argsort(column, kind="stable")
    by_column = by_column[np.searchsorted(column[by_column], 0) :]
    strips = [(a, min(a + STRIP, z)) for y, z in itertools.pairwise([0, *(np.flatnonzero(np.diff(side)) + 1).tolist(), len(n)]) for a in range(y, z, STRIP)]
    low, top = [n[a] for a, _ in strips], [n[b - 1] for _, b in strips]
    of = [side[a] for a, _ in strips]
    apart = lambda i, j: of[i] == of[j] >= 0 or 100 * top[i] < percent * low[j] or 100 * top[j] < percent * low[i]
    tasks = [(strips[i], strips[j]) for i in range(len(strips)) for j in range(i, len(strips)) if not apart(i, j)]
    step = 4096
    edges = np.searchsorted(column[by_column], np.arange(0, len(shared) + step, step))
    for c, (a, b) in enumerate(itertools.pairwise(edges.tolist())):
        own = by_column[a:b]
        table = np.zeros((len(n), step), np.float32)
        table[row[own], column[own] - c * step] = 1
        for u, v in tasks:
            both[u[0] : u[1], v[0] : v[1]] += table[u[0] : u[1]] @ table[v[0] : v[1]].T
    for u, v in tasks:
        both[v[0] : v[1], u[0] : u[1]] = both[u[0] : u[1], v[0] : v[1]].T
    union = n[:, None] + n[None, :] - both
    linked = (100.0 * both >= percent * union) & (both > 0)
    rank = np.argsort(np.argsort(ids_, kind="stable"), kind="stable")
    root = rank.copy()
    while True:
        least = np.where(linked, root[None, :], len(n)).min(1)
        after = np.minimum(root, least)
        if (after == root).all():
            break
        root = after
    smallest = np.sort(ids_, kind="stable")[root]
    return [(a, b) for a, b in zip(ids_.tolist(), smallest.tolist(), strict=True) if a != b]


def links(candidates: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: for each key of the rows (key, doc_id, side, text), a forest of the links among its documents. Rows come ordered by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sides, texts = None, [], [], []
        found: list[tuple[int, int]] = []
        for part in (batch.slice(i, 256) for batch in batches for i in range(0, batch.num_rows, 256)):
            for x, d, s, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if x != key:
                    if len(ids) > 1:
                        found += _forest(ids, texts, sides, k, percent)
                    key, ids, sides, texts = x, [], [], []
                if not ids or ids[-1] != d or texts[-1] != t:
                    ids.append(d)
                    sides.append(s)
                    texts.append(t)
            if found:
                yield _edges(found)
                found = []
        if len(ids) > 1:
            yield _edges(_forest(ids, texts, sides, k, percent))

    def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    return candidates.mapInArrow(lean(run), "a long, b long")


def _parts_of(rows: Column, features: Column, block: int, most: int) -> Column:
    return F.greatest(F.ceil(rows / block), F.ceil(features / most), F.lit(1)).cast("int")


def _sized(members: DataFrame) -> DataFrame:
    """members (component, node, n) with the number of blocks of each one's group."""
    parts = members.groupBy("component").agg(_parts_of(F.count("*"), F.sum("n"), BLOCK, BLOCK_FEATURES).alias("parts"))
    return salted_join(members, parts, ["component"], F.col("node"))


def _chunks(sized: DataFrame) -> DataFrame:
    """doc_id, key, side (null): each group in blocks, and its hub in every one of them. A group of one block is compared whole."""
    one = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    places = F.when(F.col("node") == F.col("component"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(one))
    return sized.select("component", "node", F.explode(places).alias("part")).select(F.col("node").alias("doc_id"), F.xxhash64("component", "part").alias("key"), F.lit(None).cast("int").alias("side"))


def _block_pairs(members: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, key, side: what is left to compare in large groups, given the components found so far (node, label).

    Members that are already in the hub's component need no comparison with each other; the rest are compared with them and among
    themselves: each block of the rest by itself, and pairs of blocks, of which each is a side. Where almost all of a group is linked, its
    rows are about as many as its members.
    """
    own = members.join(labels, "node", "left").select("component", "node", "n", F.coalesce("label", "node").alias("label"))
    found = own.groupBy("component", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.max(F.col("node") == F.col("component")).alias("main"))
    main = F.col("main")
    sums = lambda c, x: F.sum(F.when(c, F.col(x)).otherwise(0))
    blocks = lambda c: _parts_of(sums(c, "c"), sums(c, "s"), PAIR_BLOCK, PAIR_FEATURES)
    parts = found.groupBy("component").agg(F.max(F.when(main, F.col("label"))).alias("main"), blocks(main).alias("mains"), blocks(~main).alias("rests"), sums(~main, "c").alias("left"))
    split = salted_join(own, parts.where("left > 0"), ["component"], F.col("node")).withColumn("rest", F.col("label") != F.col("main"))
    placed = split.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int"))
    at = F.col("own")
    pair = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    among = F.transform(upto("rests"), lambda o: pair("r", F.least(at, o), F.greatest(at, o), F.when(o > at, 0).when(o < at, 1)))
    across = F.transform(upto("mains"), lambda o: pair("m", at, o, F.lit(0)))
    back = F.transform(upto("rests"), lambda o: pair("m", o, at, F.lit(1)))
    each = placed.select("component", "node", F.explode(F.when(F.col("rest"), F.concat(among, across)).otherwise(back)).alias("k"))
    return each.select(F.col("node").alias("doc_id"), F.xxhash64("component", "k.kind", "k.i", "k.j").alias("key"), "k.side")


def _with_hubs(signed: DataFrame) -> tuple[DataFrame, str]:
    """doc_id, hub for every row (sig, doc_id) of a signature that occurs again, and the path of a table that it needs."""
    shared, path = written(signed.groupBy("sig").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1"), "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > total
    # Fewer than HOT signatures can have more than one in HOT of the rows.
    dealt = signed.join(F.broadcast(shared.where(hot).select("sig", F.lit(1).alias("__hot"))), "sig", "left")
    dealt = dealt.select("sig", "doc_id", F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).cast("int").alias("__salt"))
    hubs = shared.select("sig", "hub", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("__salt"))
    return dealt.join(hubs, ["sig", "__salt"]).select("doc_id", "hub"), path


def _with_texts(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """key, doc_id, side, text, ordered by key within partitions."""
    texts = docs.join(keyed.hint("shuffle_hash"), "doc_id").select("key", "doc_id", "side", "text")
    return texts.repartition("key").sortWithinPartitions("key", "doc_id")


def _joined(documents: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """ngram_join's rows and `several`: whether the doc_id has different texts."""
    spark = documents.sparkSession
    docs = _texts(documents, doc_id, text)
    of_class = ["k1", "k2", "n"]
    keys, _ = written(shingle_classes(docs, k), "keys")
    docs = docs.where("doc_id is not null")
    several, _ = written(keys.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*of_class)).alias("a"), F.max(F.struct(*of_class)).alias("b")).where("a <> b").select("doc_id", F.lit(True).alias("several")), "several")
    any_several = several.limit(1).count() > 0
    if any_several:
        keys = salted_join(keys, several, ["doc_id"], F.col("k1"), "left").withColumn("several", F.coalesce("several", F.lit(False)))
    else:
        keys = keys.withColumn("several", F.lit(False))
    one = keys.where("n > 0 and doc_id is not null and not several")
    classes, _ = written(one.groupBy(*of_class).agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")), "classes")

    # Pairs of documents that share a signature with the smallest that has it.
    groups, shared_path = _with_hubs(part_enum(docs, k, percent))
    pairs, pairs_path = written(groups.where("doc_id <> hub").distinct(), "pairs")
    removed(spark, shared_path)
    named = one.join(classes.where("members > 1").select(*of_class, "rep"), of_class).where("doc_id <> rep").select("doc_id", "rep").distinct()
    for side in ("doc_id", "hub"):
        pairs = pairs.join(named.select(F.col("doc_id").alias(side), F.col("rep").alias("__rep")), side, "left").withColumn(side, F.coalesce("__rep", side)).drop("__rep")
    pairs = pairs.where("doc_id <> hub").select(F.col("hub").alias("component"), F.col("doc_id").alias("node")).distinct()
    groups = pairs.unionByName(pairs.select("component", F.col("component").alias("node")).distinct())

    sizes, same = classes.select(F.col("rep").alias("node"), "n"), None
    if any_several:
        other = keys.where("several and n > 0").select("doc_id", *of_class).distinct()
        sizes = sizes.unionByName(other.groupBy(F.col("doc_id").alias("node")).agg(F.max("n").alias("n")))
        # Documents with a text of an equal set are linked by it.
        least = other.groupBy(*of_class).agg(F.min("doc_id").alias("b"))
        same = salted_join(other, least, of_class, F.col("doc_id")).unionByName(salted_join(other, classes.select(*of_class, F.col("rep").alias("b")), of_class, F.col("doc_id"))).select(F.col("doc_id").alias("a"), "b")
    members, members_path = written(groups.join(sizes, "node"), "members")
    sized, sized_path = written(_sized(members), "sized")
    removed(spark, members_path)
    removed(spark, pairs_path)
    edges, edges_path = written(links(_with_texts(docs, _chunks(sized)), k, percent), "links")
    large = sized.where("parts > 1")
    if large.limit(1).count():
        labels = components(edges).select("node", F.col("component").alias("label"))
        more, more_path = written(links(_with_texts(docs, _block_pairs(large.drop("parts"), labels)), k, percent), "links")
        first_path = edges_path
        edges, edges_path = written(edges.unionByName(more), "links")
        removed(spark, first_path)
        removed(spark, more_path)
    removed(spark, sized_path)
    linked = components(edges.unionByName(same) if same is not None else edges).select(F.col("node").alias("rep"), "component")
    removed(spark, edges_path)

    # Classes that have several members or lie in another's component; the others are their own.
    named = classes.join(linked, "rep", "left").select(*of_class, "rep", F.coalesce("component", "rep").alias("component"), "members").where("members > 1 or component <> rep").drop("members")
    plain = salted_join(keys.where("not several"), named, of_class, F.col("doc_id"), "left")
    if any_several:
        plain = plain.unionByName(salted_join(keys.where("several"), linked.select(F.col("rep").alias("doc_id"), "component"), ["doc_id"], F.col("k1"), "left").withColumn("rep", F.col("doc_id")))
    own = F.col("doc_id").isNotNull()
    return plain.select("doc_id", F.col("n").alias("n_shingles"), F.when(own, F.coalesce("rep", "doc_id")).alias("class_id"), F.when(own, F.coalesce("component", "doc_id")).alias("component_id"), "several")


def ngram_join(documents: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (the smallest document with an equal set), component_id (the smallest one that links reach).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of k-word shingles. A doc_id with several texts is its
    own class.
    """
    return _joined(documents, k, percent, doc_id, text).drop("several")


def one_of_each(documents: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that are linked, over any number of links, with a document of a smaller id."""
    name = fresh(documents, "gone")
    gone = _joined(documents, k, percent, doc_id, text).where("doc_id <> component_id and not several").select(F.col("doc_id").alias(name)).distinct()
    return documents.join(gone, column(doc_id).cast("long") == F.col(name), "left_anti")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component at three words and a similarity of 0.9."""
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90).select("doc_id", "n_shingles", "component_id", "class_id")
