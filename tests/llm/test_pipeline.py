import inspect

import corpus_pipeline
from rasterloom.llm import _stage, _tokens

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_hold_what_they_promise(spark, tmp_path):
    clean = [(i, " ".join(f"w{i}x{j}" for j in range(40)) + "\n" + f"line {i}") for i in range(30)]
    base = " ".join(f"b{j}" for j in range(60))
    extra = [(100, base), (101, base + " tail"), (102, base), (103, "q " + " ".join(f"bench{j}" for j in range(12)) + " q"), (104, "vile vile vilex " + " ".join(f"t{j}" for j in range(30))), (105, None), (106, "")]
    lines = "\n".join(f"passage line {k} of it" for k in range(5))
    extra += [(110, "head\n" + lines), (111, lines), (112, "other\n" + lines + "\nown end")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in clean + extra]
    toxic = [(200 + i, f"vile {i} vile{i % 3} vile nasty " + " ".join(f"z{i}y{j}" for j in range(30)), "en", "s", 1) for i in range(20)]
    spark.createDataFrame(rows + toxic, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(200 + i, 1, 1) for i in range(20)] + [(i, 1, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{j}" for j in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
    everything = {r[0] for r in rows}
    assert set(kept["toxicity"]) == everything - {104}
    assert kept["line_dedup"].keys() == everything - {104, 111}
    assert kept["line_dedup"][112].text == "other\nown end" and kept["line_dedup"][112].n_chars == len("other\nown end")
    assert kept["ngram_jaccard_join"].keys() == kept["line_dedup"].keys() - {101, 102}
    assert kept["decontamination"].keys() == kept["ngram_jaccard_join"].keys() - {103}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept["decontamination"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "decontamination", "packing"]


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", COLUMNS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 1, 2), (2, "a\nb\nc\nd", 3, 4)], "doc_id long, text string, `__removed` int, removed int")
    out = corpus_pipeline.dedup_lines(spark, df, "")
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a\nb\nc", 1, 2), (2, "d", 3, 4)]
    assert corpus_pipeline.one_of_near_copies(spark, df, "").columns == df.columns


def test_stages_begin_with_empty_heaps(spark):
    def collections():
        beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans)

    before = collections()
    _stage.heaps_emptied(spark)
    assert collections() > before
    assert all("heaps_emptied(spark)" in inspect.getsource(f) for _, f in corpus_pipeline.STAGES)


def test_workers_keep_little_after_a_task():
    _tokens._ENCODERS["x", "y"] = None
    assert list(_stage.lean(iter, encoders=True)(iter([1, 2]))) == [1, 2] and ("x", "y") in _tokens._ENCODERS
    assert list(_stage.lean(iter)(iter([3]))) == [3] and not _tokens._ENCODERS
