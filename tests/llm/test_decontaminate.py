import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from rasterloom.llm import _text, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size):
    out = {}
    for d, text in docs:
        own, hit, names = words(text), set(), set()
        for name, item in items:
            w = words(item)
            n = min(size, len(w))
            for p in range(len(w) - n + 1 if n else 0):
                for q in range(len(own) - n + 1):
                    if own[q : q + n] == w[p : p + n]:
                        hit |= set(range(q, q + n))
                        names.add(str(name))
        out[d] = (len(own), len(hit), sorted(names))
    return out


def made(seed, docs=40, items=8):
    rnd = random.Random(seed)
    voc = ["a", "b", "C", "zé", "q9", "the"]
    text = lambda n: "".join(rnd.choice(voc) + rnd.choice([" ", ", ", "\n", "."]) for _ in range(n))
    return [(i, rnd.choice([None, "", text(3), text(40), text(200)])) for i in range(docs)], [(100 + i % 5, rnd.choice([None, "!", text(2), text(5), text(14)])) for i in range(items)]


def test_report_equals_brute_force_in_one_block_and_in_several(spark):
    for seed in (1, 2):
        docs, items = made(seed)
        d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, items string").repartition(3)
        b = spark.createDataFrame(items, "item_id long, text string")
        want = brute(docs, items, 4)
        for size in (1 << 20, 20):
            got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(d, b, window=4, block_bytes=size).collect()}
            assert got == want
        kept = {r.doc_id for r in decontaminate.decontaminate(d, b, window=4, block_bytes=20).collect()}
        assert kept == {k for k, v in want.items() if not v[1]}


def test_longest_matches(spark):
    docs, items = made(5, 15, 4)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.item_id, r.start): r for r in decontaminate.longest_matches(d, b, least=2).collect()}
    own = {k: words(t) for k, t in docs}
    for (name, start), r in got.items():
        lengths = []
        for i, item in items:
            w = words(item)[start:]
            if str(i) == name:
                lengths += [max((next((k for k in range(len(w) + 1) if k == len(w) or q + k >= len(t) or t[q + k] != w[k]), 0) for q in range(len(t))), default=0) for t in own.values()]
        assert r.length == max(lengths)
        place = own[r.doc_id][r.at : r.at + r.length]
        assert any(str(i) == name and words(item)[start : start + r.length] == place for i, item in items)


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(3)
    for codes in (rng.integers(0, 4, 500), np.tile([1, 2, 1, 1, 2, 0], 60), np.ones(300, int), np.concatenate((np.ones(70, int), [0], np.ones(90, int), [0]))):
        order = decontaminate.suffix_array(codes, 2, 3)
        key = lambda p: tuple(codes[p : p + next((k for k in range(len(codes) + 1) if p + k >= len(codes) or codes[p + k] == 0))])  # noqa: E731, B023
        keys = [key(p) for p in order]
        assert sorted(order) == np.flatnonzero(codes > 0).tolist() and keys == sorted(keys)


def test_each_row_by_its_own_text(spark):
    rows = [(1, "x a b c d y"), (2, "a b c d"), (2, "none of it"), (None, "z a b c d"), (None, None), (2, "a b c d")]
    items = [(7, "a b c d"), (8, "q r s t"), (9, "none of")]
    d = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, `spans.x` string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 3):
        got = sorted(((r.doc_id, r.n_hit, list(r["items"]), r.longest and (r.longest["words"], r.longest["item_id"], r.longest["at"])) for r in decontaminate.contamination(d, b, window=4, block_bytes=size).collect()), key=str)
        want = [(1, 4, ["7"], (4, "7", 1)), (2, 4, ["7"], (4, "7", 0)), (2, 2, ["9"], (2, "9", 0)), (None, 4, ["7"], (4, "7", 1)), (None, 0, [], None), (2, 4, ["7"], (4, "7", 0))]
        assert got == sorted(want, key=str)
        kept = decontaminate.decontaminate(d, b, window=4, block_bytes=size)
        assert kept.columns == d.columns and [(r.doc_id, r.text) for r in kept.collect()] == [(None, None)]


def test_words_of_one_hash_are_told_apart(spark, monkeypatch):
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    other = a.translate(str.maketrans("ab", "ba"))
    block = decontaminate.TestBlock(["1"], [a])
    raw, at = _text.column_bytes(pa.array([other, a + " x"]))
    assert decontaminate.Shard(raw, at).matches(block)[0].tolist() == [1]
    monkeypatch.setattr(_text, "mix", lambda x: x & np.uint64(1))
    docs, items = made(8, 12, 4)
    want = brute(docs, items, 4)
    block = decontaminate.TestBlock([str(k) for k, _ in items], [t for _, t in items], 4)
    raw, at = _text.column_bytes(pa.array([t for _, t in docs]))
    shard = decontaminate.Shard(raw, at)
    doc, _, which, _ = shard.matches(block)
    got = {d: sorted({str(items[block.item[w]][0]) for w in which[doc == i]}) for i, (d, _) in enumerate(docs)}
    assert got == {d: w[2] for d, w in want.items()}


def test_query(spark, tmp_path):
    docs, items = made(3)
    long = " ".join(f"w{i % 97}" for i in range(200_000))
    docs += [(1000, long), (1001, "K " + " ".join(f"b{i}" for i in range(12)) + " k")]
    items += [(500, " ".join(f"b{i}" for i in range(12))), (501, "b3")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute([d for d in docs if d[0] != 1000], items, 10) | {1000: (200_000, 0, [])}
    for r in decontaminate.op4_decontaminate(spark, str(tmp_path)).collect():
        n, hit, names = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(names), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert r.longest_match == (12 if r.doc_id == 1001 else r.longest_match) and (r.longest_match > 0) == r.contaminated


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(one, items).first()[1:3] == (2, 0)
    assert decontaminate.decontaminate(one, items).count() == 1


def test_words_of_bytes():
    texts = ["Ab-c1  é\x7fZ", "", None, "\x00"]
    raw, at = _text.column_bytes(pa.array(texts))
    start, end, row = _text.words(raw, at, _text.NOT_ALNUM)
    got = [[bytes(raw[s:e]).decode() for s, e in zip(start[a:b], end[a:b], strict=True)] for a, b in zip(row[:-1], row[1:], strict=True)]
    assert got == [["Ab", "c1", "é", "Z"], [], [], []]
