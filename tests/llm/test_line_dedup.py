import random

from rasterloom.llm import line_dedup


def brute(docs):
    seen, gone = set(), {d: set() for d in docs}
    for d in sorted(docs):
        if docs[d] is None:
            continue
        lines = docs[d].split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if not "".join(w).strip(" "):
                continue
            if w in seen:
                gone[d] |= {i, i + 1, i + 2}
            seen.add(w)
    return {d: (t if t is None or not gone[d] else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]), len(gone[d])) for d, t in docs.items()}


def run(spark, docs):
    df = spark.createDataFrame([(d, t, 1) for d, t in docs.items()], "doc_id long, text string, covered int").repartition(3)
    out = line_dedup.dedup_lines(df, removed="gone")
    assert out.columns == ["doc_id", "text", "covered", "gone"]
    return {r.doc_id: (r.text, r.gone) for r in out.collect()}


def test_equal_to_brute_force(spark):
    rnd = random.Random(4)
    docs = {rnd.randrange(10**6): "\n".join(rnd.choice(["a", "b", "c", "", "  ", "long line"]) for _ in range(rnd.choice([1, 2, 3, 5, 30]))) for _ in range(150)}
    docs |= {-5: None, -4: "", -3: "a\nb\nc", -2: "a\nb\nc", -1: "\n\n\n\n"}
    assert run(spark, docs) == brute(docs)


def test_repeated_rows_count_as_one_document(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\na\nb\nc")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x")]


def test_no_python_on_the_way(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = line_dedup.dedup_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_id_with_several_texts_and_none(spark):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc"), (2, "x\ny\nz"), (None, "p\nq\nr"), (None, None), (4, "p\nq\nr\ns")]
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in rows], "doc_id long, text string, hash int, `removed.x` int")
    out = line_dedup.dedup_lines(df, removed="removed")
    assert out.columns == ["doc_id", "text", "hash", "removed.x", "removed"]
    got = sorted(((r.doc_id, r.text, r.removed) for r in out.collect()), key=str)
    want = [(1, "a\nb\nc", 0), (2, "", 3), (2, "x\ny\nz", 0), (None, "p\nq\nr", 0), (None, None, 0), (4, "s", 3)]
    assert got == sorted(want, key=str)


def test_hot_windows_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 1000)
    docs = {i: f"own {i}\nhot\nhot\nhot\nend {i % 5}" for i in range(200)}
    assert run(spark, docs) == brute(docs)


def test_very_long_line(spark):
    long = "word " * 400_000
    docs = {1: f"{long}\nb\nc", 2: f"{long}\nb\nc\nd", 3: long}
    assert run(spark, docs) == brute(docs)
