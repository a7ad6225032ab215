import corpus_pipeline
from corpusloom.llm import dac, decontaminate, mixing, quality, simhash
from corpusloom.llm.common import materialise
from corpusloom.llm.queries import END_ID
from tests.llm.test_dac import PATH, expected
from tests.llm.tables import documents, nothing


def write(spark, folder, docs, labels=(), items=()):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    clean = [(k, " ".join(f"word{k}x{i}" for i in range(40)), "en", f"s{k % 3}") for k in range(30)]
    item = " ".join(f"item{i}" for i in range(20))
    bad = [(100, "too short", "en", "s0"), (101, "again and again and again " * 20, "en", "s1"), (102, clean[3][1], "en", "s2"), (103, clean[4][1] + "\n" + item, "fr", "s0"), (104, None, None, None)]
    write(spark, str(tmp_path), documents(spark, clean + bad), [(k, 1, 0) for k in range(30)], [(1, item)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        kept[name] = [r["doc_id"] for r in docs.collect()]
    good = {r[0] for r in clean}
    assert set(kept["quality_rules"]) == good | {102, 103}
    assert set(kept["near_dedup"]) == good | {103}
    assert set(kept["decontamination"]) == good == set(kept["decontamination"])
    assert set(kept["mixing"]) <= good
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected(rows)


def test_run_equals_the_stages_one_by_one(spark, tmp_path):
    write(spark, str(tmp_path), documents(spark), [(k, 1, 0) for k in range(20)], [(1, "alpha beta gamma delta eta theta iota kappa")])
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    docs = materialise(quality.keep_good(read("documents"), read("labels")), "a")
    docs = materialise(simhash.keep_one(docs), "b")
    docs = materialise(mixing.repeat_rows(decontaminate.without_leaks(docs, read("benchmark"))), "c")
    whole = dac.tokenise(docs, PATH, END_ID).collect()
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, whole))


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), nothing(spark))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
