import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rasterloom.llm import _text, ngram_join
from rasterloom.llm.components import components


def shingles(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(docs, k, percent):
    ids = sorted(docs)
    sets = {d: shingles(docs[d], k) for d in ids}
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holds = {}
    for d in ids:
        for s in sets[d]:
            holds.setdefault(s, []).append(d)
    done = set()
    for group in holds.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                if (a, b) not in done:
                    done.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, n):
    rnd = random.Random(seed)
    docs, words = {}, [f"w{i}" for i in range(60)]
    for d in range(n):
        if docs and rnd.random() < 0.6:
            text = (rnd.choice(list(docs.values())) or "").split(" ")
            for _ in range(rnd.choice([0, 1, 1, 2, 5])):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            docs[rnd.randrange(10**6)] = " ".join(text)
        else:
            docs[rnd.randrange(10**6)] = rnd.choice([None, "", " \n"]) if rnd.random() < 0.1 else " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 4, 8, 11, 14, 25, 60, 300])))
    return docs


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_components_equal_brute_force(spark, k, percent):
    docs = corpus(k, 400)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs.items()], "doc_id long, text string, sig string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df, k, percent).collect()}
    assert got == brute(docs, k, percent)


def test_large_components_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "PAIR_BLOCK", 9)
    monkeypatch.setattr(ngram_join, "STRIP", 2)
    docs = corpus(9, 150)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df, 3, 90).collect()}
    assert got == brute(docs, 3, 90)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_every_linked_pair_shares_a_signature(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        union = n
        b = list(a)
        while True:
            c = list(b)
            if rng.random() < 0.5 and len(c) > 1:
                c.pop(int(rng.integers(len(c))))
            if rng.random() < 0.5:
                c.append(np.uint64(rng.integers(0, 1 << 62)))
            union = len(set(a.tolist()) | {int(x) for x in c})
            if 100 * len(set(a.tolist()) & {int(x) for x in c}) < percent * union:
                break
            if len(c) == len(b) and rng.random() < 0.3:
                break
            b = c
        values = np.concatenate((np.unique(a), np.unique(np.array(b, np.uint64))))
        size = len(np.unique(a))
        if set(np.unique(a).tolist()) == {int(x) for x in b}:
            continue
        row, sig = ngram_join.signatures(values, np.array([0, size, len(values)]), percent)
        assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert ngram_join.ngram_join(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(3, long), (3, long), (1, long + " more"), (2, None), (4, "")]
    got = sorted(tuple(r) for r in ngram_join.ngram_join(spark.createDataFrame(rows, schema)).select("doc_id", "component_id").collect())
    assert got == [(1, 1), (2, 2), (3, 1), (3, 1), (4, 4)]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, schema))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]


def test_shingle_hashes_follow_the_words():
    raw, at = _text.column_bytes(pa.array(["A b c d", "a b", None, "x A B C", "a b"]))
    start, end, row = _text.words(raw, at, _text.SPACE)
    hashes, to = _text.shingle_hashes(_text.word_hashes(raw, start, end), row, 3)
    rows = [hashes[a:b].tolist() for a, b in zip(to[:-1], to[1:], strict=True)]
    assert [len(r) for r in rows] == [2, 1, 0, 2, 1]
    assert rows[1] == rows[4] and rows[0][0] == rows[3][1] and rows[0][0] != rows[1][0]


@pytest.mark.parametrize("blocked", [False, True])
def test_shared_signatures_that_many_rows_have(spark, monkeypatch, blocked):
    """Nearly equal texts that share most signatures, dealt over tasks and over blocks, with several texts under one id and none."""
    monkeypatch.setattr(ngram_join, "HOT", 1_000_000)
    monkeypatch.setattr(ngram_join, "MOST_SEEN", 3)
    if blocked:
        monkeypatch.setattr(ngram_join, "BLOCK", 5)
        monkeypatch.setattr(ngram_join, "PAIR_BLOCK", 7)
        monkeypatch.setattr(ngram_join, "STRIP", 3)
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    docs = {}
    for d in range(120):
        own = list(base)
        for _ in range(rnd.choice([0, 1, 3, 9])):
            own[rnd.randrange(60)] = f"x{rnd.randrange(40)}"
        docs[d] = " ".join(own)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df, 3, 80).collect()}
    assert got == brute(docs, 3, 80)


def test_ids_of_several_texts_or_none(spark):
    one, two, three = (" ".join(f"{p}{i}" for i in range(30)) for p in "abc")
    rows = [(1, one), (2, one), (2, two), (3, two + " more"), (None, one), (None, None), (7, three), (8, three), (9, one)]
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], "doc_id long, text string, gone string, `a.b` string, several string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df).collect()), key=str)
    want = [(1, 26, 1), (2, 26, 1), (2, 26, 1), (3, 27, 1), (None, 26, None), (None, 0, None), (7, 26, 7), (8, 26, 7), (9, 26, 1)]
    assert got == sorted(want, key=str)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "2", "7", "None", "None"]


def test_long_words_of_one_sum_are_not_linked(spark):
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, a), (2, b), (3, "long " * 300_000)], "doc_id long, text string")
    assert sorted(r.component_id for r in ngram_join.ngram_join(df, 3, 90).collect()) == [1, 2, 3]


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components_by_rounds_and_in_one_task(spark, one_task):
    rnd = random.Random(one_task)
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(40)] + [(rnd.randrange(300, 500), rnd.randrange(300, 500)) for _ in range(90)] + [(5, 5), (800, 801), (801, 800)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = components(df, one_task).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(df.where("a < 0"), one_task).count() == 0


def test_query(spark, tmp_path):
    docs = corpus(5, 60)
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op1_ngram_join(spark, str(tmp_path)).collect()}
    assert got == brute(docs, 3, 90)
