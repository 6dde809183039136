import itertools
import random
import re

import numpy as np
import pyarrow as pa

from rasterloom.llm import _text, chat_format, quality, toxicity

DOCS = "doc_id long, text string, mark string"


def _labelled(n, seed):
    rnd = random.Random(seed)
    plain = [f"word{i}" for i in range(200)]
    out = []
    for i in range(n):
        toxic, poor = rnd.random() < 0.2, rnd.random() < 0.3
        words = [rnd.choice(plain) for _ in range(rnd.randint(20, 60))]
        if toxic:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(["vileone", "viletwo", "nastyx", "nastyy"]) + rnd.choice(["", "a", "b", "c"])
        if poor:
            words = [w + rnd.choice(["%%%", "###", "&&&"]) for w in words]
        out.append((i, " ".join(words), int(not poor), int(toxic)))
    return out


def test_toxicity_on_unseen_documents(spark):
    rows = _labelled(700, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i < 400] + [(1, 0, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels)
    assert chain.categories == ["dense", "repeated", "toxic"]
    assert [len(w) - len(chain.known) - 1 for w in chain.weights] == [0, 1, 2]
    got = {r.doc_id: r.toxic for r in toxicity.scored(docs, chain).collect()}
    wrong = sum(got[i] != bool(x) for i, _, _, x in rows if i >= 400)
    assert wrong <= 3
    kept = toxicity.without_toxic(docs, chain)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, x in got.items() if not x}


def test_toxicity_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, toxic int")
    chain = toxicity.fit(none, none)
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x")], DOCS)
    assert [r.toxic for r in toxicity.scored(docs, chain).collect()] == [False] * 3
    assert toxicity.scored(docs, chain).columns == ["doc_id", "p_dense", "p_repeated", "p_toxic", "toxic"]
    assert max(r.p_toxic for r in toxicity.scored(docs, chain).collect()) < 1e-6
    odd = spark.createDataFrame([(1, "vile text", "x")], "doc_id long, text string, `a.b` string")
    assert toxicity.without_toxic(odd, chain).columns == odd.columns and toxicity.without_toxic(odd, chain).count() == 1
    assert toxicity.scored(none, chain).count() == 0


def test_toxicity_scores_by_definition(spark, tmp_path):
    """The query's probabilities, computed word by word from the chain's weights."""
    rows = _labelled(300, 5)
    docs = [(i, t, "x") for i, t, _, _ in rows] + [(900, None, "x"), (901, "Vileone VILEONE x", "x"), (None, "viletwo", "x"), (3, "another text under an id", "x")]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    chain = toxicity.fit(read("documents"), read("labels"))
    place = {k: i for i, k in enumerate(chain.known.tolist())}

    def probabilities(text):
        count = {}
        for w in re.findall("[a-z0-9]+", (text or "").lower()):
            for part in [w, *[(w[:n], n) for n in toxicity.PREFIXES if len(w) >= n]]:
                own, n = (part, 0) if isinstance(part, str) else part
                raw = np.frombuffer(own.encode(), np.uint8)
                h = _text.word_hashes(raw, np.array([0]), np.array([len(raw)]))
                if n:
                    h = _text.mix(h + np.uint64(n))
                if int(h[0]) in place:
                    count[place[int(h[0])]] = count.get(place[int(h[0])], 0) + 1
        out = []
        for w in chain.weights:
            z = sum(np.log1p(n) * w[i] for i, n in count.items()) + sum(p * w[len(place) + j] for j, p in enumerate(out)) + w[-1]
            out.append(1 / (1 + np.exp(-z)))
        return out

    got = sorted((str(r.doc_id), r.p_dense, r.p_repeated, r.p_toxic, r.toxic) for r in toxicity.op3_toxicity(spark, str(tmp_path)).collect())
    want = sorted((str(i), *probabilities(t)) for i, t, _ in docs)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0] and np.allclose(g[1:4], w[1:], atol=1e-9) and g[4] == (w[3] >= 0.5)


def test_probabilities_of_a_fold_do_not_know_it():
    """A fold whose marks are turned round leaves its own out-of-fold probabilities, and so the later models' inputs of it, as they were."""
    rng = np.random.default_rng(1)
    n, width = 90, 6
    fold = np.arange(n) % 3
    held = rng.random((n, width)) < 0.4
    row, feature = np.nonzero(held)
    value = np.ones(len(row))
    first = held[:, 0].astype(float)
    turned = np.where(fold == 1, 1 - first, first)
    seen = []
    original = toxicity._logistic
    for y in (first, turned):
        inputs = []

        def spy(r, f, v, extra, y_, width_, *a, inputs=inputs):
            inputs.append(extra.copy())
            return original(r, f, v, extra, y_, width_, *a)

        toxicity._logistic = spy
        try:
            toxicity.learned(np.arange(width, dtype=np.uint64), row, feature, value, {"one": y, "two": first}, fold, np.ones((4, width), bool))
        finally:
            toxicity._logistic = original
        seen.append(inputs[4])
    assert seen[0].shape == (n, 1)
    assert (seen[0][fold == 1] == seen[1][fold == 1]).all() and not np.allclose(seen[0][fold != 1], seen[1][fold != 1])


def test_quality_on_held_out_documents(spark):
    rows = _labelled(600, 2)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, q) for i, _, q, _ in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.scored(docs, quality.fit(docs, labels)).collect()}
    held = [(got[i], q) for i, _, q, _ in rows if got[i].held_out]
    assert 80 < len(held) < 160
    assert np.mean([r.predicted == q for r, q in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_quality_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, quality int")
    model = quality.fit(none, none)
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a" * 100_000, "x")], DOCS)
    assert [r.score for r in quality.scored(docs, model).collect()] == [0.5] * 3


def test_pairs_explain_what_single_numbers_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.NUMBERS)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = quality.fit_additive(x, y)
    assert (2, 5) in [(a, b) for a, b, _ in model.pairs]
    assert ((model.scores(x) > 0.5) == y).mean() > 0.85


def test_measures_by_definition():
    texts = ["Ab ab, ABC! x\nAb", "", "é é"]
    raw, at = _text.column_bytes(pa.array(texts, pa.large_string()))
    m = dict(zip(quality.NUMBERS, quality.measured(raw, at)[0], strict=True))
    assert m["words"] == np.log1p(5) and m["distinct_words"] == 4 / 5 and m["marks"] == 2 / 16
    assert m["capital_words"] == 1 / 5 and m["distinct_lines"] == 1


def test_roles_and_canonical_turns(spark):
    rnd = random.Random(3)
    rows = []
    for c in range(300):
        for t in range(rnd.randint(2, 9)):
            role = "system" if t == 0 and c % 4 == 0 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, " ".join(["word"] * (6 if role == "user" else 30)) + ("?" if role == "user" else ".")))
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    raw = chat_format.raw_transcripts(talks)
    model = chat_format.fit(raw)
    got = {(r.conv_id, r.turn): r for r in chat_format.parse(raw, model).collect()}
    right = [got[c, t].role == role for c, t, role, _ in rows]
    assert np.mean(right) > 0.97 and not all(r.marked for r in got.values())
    assert all(got[c, t].rendered == f"<|{got[c, t].role}|>\n{x}\n" for c, t, _, x in rows)
    cut = {(r.conv_id, r.turn): r.role for r in chat_format.parse(raw, model, segment=2).collect()}
    assert cut == {k: r.role for k, r in got.items()}


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    model = chat_format.Model(*(np.log(rng.dirichlet(np.ones(3), s)) for s in ((1,), 3)), [])
    model.start = model.start.ravel()
    for n in range(1, 7):
        s = rng.normal(size=(n, 3))
        score = lambda p: model.start[p[0]] + s[0, p[0]] + sum(model.move[a, b] + s[i + 1, b] for i, (a, b) in enumerate(itertools.pairwise(p)))  # noqa: B023, E731
        assert chat_format.traced(model, s, None) == list(max(itertools.product(range(3), repeat=n), key=score))


def test_odd_transcripts(spark):
    schema = "conv_id long, turn long, role string, block string, segment string"
    rows = [(None, None, None, None, "x"), (None, 1, "user", "", "x"), (1, 5, "user", "User: hi", "x"), (1, 5, "user", "User: hi", "x"), (1, 2000, "assistant", "Assistant:\nyes", "x")]
    df = spark.createDataFrame(rows, schema)
    got = chat_format.parse(df, chat_format.fit(df)).collect()
    assert sorted((r.conv_id or -1, r.turn or -1, r.text) for r in got) == [(-1, -1, ""), (-1, 1, ""), (1, 5, "hi"), (1, 5, "hi"), (1, 2000, "yes")]
    none = spark.createDataFrame([], schema)
    assert chat_format.parse(none, chat_format.fit(none)).count() == 0


def _talks(n):
    rnd = random.Random(5)
    for c in range(n):
        for t in range(rnd.randint(2, 7)):
            role = "system" if t == 0 and c % 4 == 0 else ("user", "assistant")[t % 2]
            yield c, t, role, "\n".join([" ".join(["word"] * (6 if role == "user" else 30)) + ("?" if role == "user" else ".")] * (1 if role == "user" else rnd.randint(1, 3)))


def test_turns_are_found_in_one_text(spark):
    rows = list(_talks(200))
    raw = chat_format.raw_transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    model = chat_format.fit_lines(raw)
    got = chat_format.turns_of("User: hi there?\nAssistant: yes.\nIndeed, A: is one.\nUser: and now?", model)
    assert got == [("user", True, "hi there?"), ("assistant", True, "yes.\nIndeed, A: is one."), ("user", True, "and now?")]
    assert chat_format.turns_of("### Instruction\nword?\n### Response\nword.", model) == [("user", True, "word?"), ("assistant", True, "word.")]
    assert len(chat_format.turns_of(None, model)) == 1
    text = chat_format.joined(raw)
    assert text.count() == 200
    found = {(r.conv_id, r.turn): (r.role, r.text) for r in chat_format.parse_text(text, model).collect()}
    want = {(c, t): (role, x) for c, t, role, x in rows}
    assert np.mean([found.get(k) == v for k, v in want.items()]) > 0.9


def test_query_finds_turns_itself(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "hi?"), (1, 1, "assistant", "yes.\nUser: no?"), (None, 0, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat_format.op5_chat_format(spark, str(tmp_path))
    assert got.columns == ["conv_id", "turn", "role", "marked", "rendered"]
    assert {r.conv_id for r in got.collect()} == {1, None}
