import collections
import os
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rasterloom.llm import _rangecoder, _text, _tokens, packing, token_file

PARTS = ["a", "B", "é", "ß", "×", "1", "23", "'", "'s", "'re", ",", "!!", "_", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", "“", "—", "ñ", "日本", "́", "<|endoftext|>", "\x00", "\x85", "İ", "Σ", "½", "\U0001f600", "The"]
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", FILES)
def test_ids_are_those_of_the_whole_text(name):
    rnd = random.Random(name)
    own = _tokens.Encoder(packing.tokenizer_path(name))
    for _ in range(400):
        texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.choice([0, 1, 2, 8, 30]))) for _ in range(rnd.randint(1, 5))]
        raw, at = _text.column_bytes(pa.array(texts, pa.large_string()))
        ids, to = own.encode(raw, at)
        for i, t in enumerate(texts):
            assert ids[to[i] : to[i + 1]].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids, t


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("blind", [False, True])
def test_words_of_one_hash_keep_their_ids(name, blind, monkeypatch):
    if blind:  # every long word has the same hash
        monkeypatch.setattr(_text, "mix", lambda x: x & np.uint64(3))
    own = _tokens.Encoder(packing.tokenizer_path(name))
    for texts in ([" ".join(thue_morse(11))], list(thue_morse(11)), ["one two three", "four five one", "", "six"]):
        raw, at = _text.column_bytes(pa.array(texts, pa.large_string()))
        ids, to = own.encode(raw, at)
        for i, t in enumerate(texts):
            assert ids[to[i] : to[i + 1]].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids


def test_units_are_forgotten_beyond_the_bound(monkeypatch):
    monkeypatch.setattr(_tokens, "MOST_UNITS", 20)
    own = _tokens.Encoder(packing.tokenizer_path(FILES[0]))
    for i in range(10):
        text = " ".join(f"w{i}x{j}" for j in range(15))
        raw, at = _text.column_bytes(pa.array([text], pa.large_string()))
        assert own.encode(raw, at)[0].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(own.known) <= 40


def coded(ids):
    distinct, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
    tree = _rangecoder.Tree(distinct, counts)
    place = place.reshape(ids.shape)
    words, branches = _rangecoder.encode(tree, place)
    assert (_rangecoder.decode(_rangecoder.Tree(distinct, counts), words, branches, ids.shape[1]) == place).all()
    # A block can be read without the others.
    assert (_rangecoder.decode(tree, words[-1:], branches[-1:], ids.shape[1]) == place[-1:]).all()
    return sum(map(len, words)) * 16 / ids.size


@pytest.mark.parametrize(("lanes", "steps"), [(1, 1), (1, 700), (5, 300), (70, 40)])
def test_range_coder_round_trip(lanes, steps):
    rng = np.random.default_rng(lanes)
    for ids in (rng.integers(0, 50257, (lanes, steps)), np.zeros((lanes, steps), int), np.full((lanes, steps), 50256), rng.integers(0, 3, (lanes, steps)) * 20000, (1 / rng.random((lanes, steps))).astype(int) % 50000):
        coded(ids)


def test_predictable_ids_are_small():
    assert coded(np.tile([5, 900, 30000, 17], (4, 256))) < 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_files_are_below_the_order_0_entropy():
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    parts = [(ids, to) for _, ids, to in _tokens.encoded(table.to_batches(), packing.tokenizer_path(FILES[0]))]
    ids = np.concatenate([x[0] for x in parts])
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    entropy = -(share * np.log2(share)).sum()
    lengths = np.concatenate([np.diff(x[1]) for x in parts]).tolist()
    data = token_file.encode_segment(table["doc_id"].to_pylist(), ids, lengths)
    assert len(data) * 8 / len(ids) < 0.95 * entropy


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_order_1_of_the_segment_is_in_its_files():
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).append_column("doc_id", pa.array(range(1000)))
    ids = np.concatenate([x[1] for x in _tokens.encoded(table.to_batches(), packing.tokenizer_path(FILES[0]))])
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    data = token_file.encode_segment([1], ids, [len(ids)])
    assert len(data) * 8 / len(ids) < 0.78 * -(share * np.log2(share)).sum()
    assert (token_file.decode_segment(data)[1] == ids).all()


def test_contexts_with_rare_followers_and_without_lists():
    rng = np.random.default_rng(3)
    common = np.where(rng.random(60_000) < 0.9, 7, rng.integers(0, 50_000, 60_000))
    chain = (np.arange(9_000) * np.arange(9_000)) % 4_999
    for ids in (common, chain, np.tile(common[:300], 40), np.full(5_000, 3), np.array([1 << 30, 5, 1 << 30]), np.array([4])):
        for block in (1, 64, 1024):
            n = min(len(ids), 40 * block)
            assert (token_file.decode_segment(token_file.encode_segment([1], ids[:n], [n], block))[1] == ids[:n]).all()


def test_segments_and_damage():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50257, 5000)
    data = token_file.encode_segment([None, 7, 9], ids, [10, 0, 4990], 256)
    docs, back, lengths = token_file.decode_segment(data)
    assert docs == [None, 7, 9] and (back == ids).all() and lengths.tolist() == [10, 0, 4990]
    for at in (0, 9, 200, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(token_file.TokenFileError):
            token_file.decode_segment(bytes(bad))


def _docs(spark, path, texts):
    spark.createDataFrame([(k, t, "x") for k, t in texts], "doc_id long, text string, ids string").repartition(3).write.parquet(f"{path}/documents.parquet")


TEXTS = [(5, "Hello there, world"), (1, None), (2, ""), (9, "word " * 9000), (7, " x  y"), (11, "the end\n"), (12, "the end\n")]


def test_token_file_query(spark, tmp_path):
    _docs(spark, tmp_path, TEXTS)
    tokenizer = _tokens.Encoder(packing.tokenizer_path(FILES[0])).tokenizer
    rows = {r.doc_id: r for r in token_file.op7_token_file(spark, str(tmp_path)).collect()}
    at = 0
    for k, t in sorted(TEXTS):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert tuple(rows[k]) == (k, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_packing_query(spark, tmp_path):
    _docs(spark, tmp_path, [*TEXTS, *((100 + i, "some words " * (i * 7 % 400)) for i in range(200))])
    tokenizer = _tokens.Encoder(packing.tokenizer_path(FILES[1])).tokenizer
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.op9_packing(spark, str(tmp_path)).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    texts = dict([*TEXTS, *((100 + i, "some words " * (i * 7 % 400)) for i in range(200))])
    assert set(by_doc) == set(texts)
    for k, t in texts.items():
        ids, at = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_rows_without_or_with_the_same_doc_id(spark, tmp_path):
    _docs(spark, tmp_path, [(None, "no id"), (None, None), (4, "one"), (4, "two words"), (4, "one")])
    tokenizer = _tokens.Encoder(packing.tokenizer_path(FILES[0])).tokenizer
    rows = token_file.op7_token_file(spark, str(tmp_path)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 4, 4, 4]
    want = sorted(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in ("no id", "", "one", "two words", "one"))
    assert sorted(r.n_tokens for r in rows) == want
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:i]) for i in range(5)]
    packed = packing.op9_packing(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in packed) == ["4", "4", "4", "None", "None"]


def test_differencing_is_near_equal():
    rng = np.random.default_rng(2)
    for k in (1, 2, 7, 64):
        sizes = rng.integers(1, 513, k * 8).tolist()
        window, n = packing.shared_out(sizes, 2600)
        sums = np.bincount(window, sizes, n)
        assert sums.max() <= 2600 and len(window) == len(sizes)
        even = np.bincount(packing.differenced(sizes, k), sizes, k)
        assert even.max() - even.min() <= 130
    assert packing.shared_out([300] * 7, 700)[1] == 4
    assert packing.shared_out([], 10)[1] == 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert token_file.op7_token_file(spark, str(tmp_path)).count() == 0
    assert packing.op9_packing(spark, str(tmp_path)).count() == 0
