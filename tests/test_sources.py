import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import sequences
from corpusloom.plans.build import Settings
from corpusloom.sources import readers, writers
from corpusloom.streaming import streams


def test_json_lines_pass_over_bad_lines(spark, tmp_path):
    (tmp_path / "math.jsonl").write_text('{"prompt": "a"}\n\n{bad\n{"input": "b"}\n{"output": "c"}\n')
    rows = readers.read_records(spark, str(tmp_path / "math.jsonl"))
    assert sorted(r["prompt"] for r in readers.normalised_prompts(rows).collect()) == ["a", "b"]
    tagged = readers.read_tagged(spark, [str(tmp_path / "math.jsonl")], {"math.jsonl": "math"})
    assert {(r["file"], r["bucket"]) for r in tagged.collect()} == {("math.jsonl", "math")}


def test_results_as_list_or_object(spark, tmp_path):
    pairs = [{"input": "a", "output": "b"}, {"input": "c", "output": "d"}]
    for name, body in (("list", pairs), ("object", {"config": {}, "results": pairs})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
        assert sorted(map(tuple, readers.read_results(spark, str(tmp_path / f"{name}.json")).collect())) == [("a", "b"), ("c", "d")]


def test_json_lines_keep_nulls_and_order(spark, tmp_path):
    df = spark.createDataFrame([(2, "é"), (1, None)], "id int, t string")
    writers.write_json_lines(df, str(tmp_path / "out"), order="id", files=1)
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text().splitlines() == ['{"id":1,"t":null}', '{"id":2,"t":"é"}']


def test_payload(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 2, 3)], "input string, output string, in_tokens long, out_tokens long")
    path = writers.write_payload(df, str(tmp_path), "run", {"model": "m"}, 0.0)
    payload = json.loads(open(f"{path}/payload.json").read())
    assert payload["runtime"] == {"elapsed_sec": 0.0, "num_samples": 1, "prompt_tokens": 2, "output_tokens": 3, "total_tokens": 5, "samples_per_sec": None, "tok_per_sec": None}
    assert readers.read_results(spark, f"{path}/results").first()["output"] == "b"


def test_dataset_in_shards(spark, tmp_path):
    pairs = spark.createDataFrame([(k, [1, 2], [3] * (k % 5)) for k in range(40)], "id long, in_ids array<long>, out_ids array<long>")
    rows = sequences.expand(pairs, 2)
    folder = str(tmp_path / "cache")
    assert readers.read_dataset(spark, folder) is None
    manifest = writers.write_dataset(rows, folder, "id", 2000, {"draft_length": 2})
    assert manifest["num_shards"] > 1
    assert manifest["total_rows"] == 40
    assert readers.read_manifest(spark, folder) == manifest
    back = readers.read_dataset(spark, folder)
    assert sorted(map(tuple, back.select("id", "input_ids", "total_len").collect())) == sorted(map(tuple, rows.select("id", "input_ids", "total_len").collect()))


def test_cache_key_ignores_order():
    assert writers.cache_key({"a": 1, "b": 2}) == writers.cache_key({"b": 2, "a": 1}) != writers.cache_key({"a": 1, "b": 3})
    assert writers.cache_folder("r", ("f", 1, 2), "t", 4, 0) != writers.cache_folder("r", ("f", 1, 2), "t", 5, 0)


def test_checkpoints_rotate_and_resume(spark, tmp_path):
    store = writers.Checkpoints(str(tmp_path), keep=2)
    assert store.resume(spark) is None
    for step in (1, 5, 10):
        store.save(spark, step, lambda p: open(f"{p}/x", "w").close())
    assert sorted(p.name for p in tmp_path.glob("step_*")) == ["step_10", "step_5"]
    assert store.resume(spark)[1] == 11
    (tmp_path / "latest.json").unlink()
    assert store.resume(spark)[1] == 11


def test_sinks(spark, tmp_path):
    writers.sink("none").log({"a": 1}, 0)
    table = writers.sink("table", spark, str(tmp_path / "m"))
    table.log({"loss": 1.5, "name": "x", "n": 2, "flag": True}, 3)
    table.close()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "m")).collect())) == [(3, "loss", 1.5), (3, "n", 2.0)]
    try:
        writers.sink("other")
    except ValueError as e:
        assert "none, table" in str(e)
    else:
        raise AssertionError


def test_generator_is_pluggable(spark):
    def echo(frames):
        for f in frames:
            yield pd.DataFrame({"input": f["prompt"], "output": f["prompt"].str.upper()})

    out = writers.generate(spark.createDataFrame([("a",)], "prompt string"), echo, "input string, output string")
    assert tuple(out.first()) == ("a", "A")


def test_fingerprints(spark):
    found = readers.fingerprints(spark, "/root/testdata/sf0.001").collect()
    assert {r["file"] for r in found} >= {"documents.parquet", "events.parquet"}
    assert all(r["bytes"] > 0 for r in found)


def test_settings_merge():
    s = Settings().merged({"draft": 2, "unknown": 1}, {"draft": 3})
    assert s.draft == 3
    assert s.buckets == [32, 64, 96, 128]


def test_stream_keeps_state_by_sequence(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 3), (2, 0, 4), (1, 2, 1)], "seq_id long, chunk_idx long, n_regular long")
    rows.coalesce(1).write.parquet(str(tmp_path / "chunks"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "chunks"))
    found = streams.drained(streams.past_seen(stream), "append").collect()
    assert sorted(map(tuple, found)) == [(1, 0, 0), (1, 1, 5), (1, 2, 8), (2, 0, 0)]


def test_weight_files(spark):
    df = spark.createDataFrame([({"a": "f1", "b": "f2", "c": "f1"},)], "weight_map map<string,string>")
    assert sorted(r["file"] for r in readers.weight_files(df.select(F.col("weight_map"))).collect()) == ["f1", "f2"]


def test_a_broken_off_dataset_goes_on_where_it_stopped(spark, tmp_path):
    pairs = spark.createDataFrame([(k, [1, 2], [3] * (k % 5)) for k in range(40)], "id long, in_ids array<long>, out_ids array<long>")
    rows, folder = sequences.expand(pairs, 2), str(tmp_path / "cache")
    whole = writers.write_dataset(rows, folder, "id", 1000, {}, per_job=2)
    (tmp_path / "cache" / "manifest.json").unlink()
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "cache" / "rows").glob("shard_id=*/part-*")}
    next((tmp_path / "cache" / "done").glob("2")).unlink()
    assert writers.write_dataset(rows, folder, "id", 1000, {}, per_job=2) == whole
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "cache" / "rows").glob("shard_id=*/part-*")}
    again = {p.parent.name for p in set(now) - set(kept)}
    assert again == {"shard_id=2", "shard_id=3"}
    assert readers.read_dataset(spark, folder).count() == 40


def _sequences(spark, n=40):
    return sequences.expand(spark.createDataFrame([(k // 2 * 2, [k, 2], [3] * (k % 5)) for k in range(n)], "id long, in_ids array<long>, out_ids array<long>"), 2)


def _content(df):
    return sorted(map(str, df.select("id", "input_ids", "total_len").collect()))


@pytest.mark.parametrize("again", [{"budget": 2600}, {"budget": 1300, "per_job": 5}, {"budget": 5000, "per_job": 1}, {"budget": 1300, "per_job": 2}])
def test_a_dataset_broken_off_and_called_again_has_all_rows(spark, tmp_path, monkeypatch, again):
    """Broken off after two jobs and at a third, with repeated ids; then another budget or size of jobs."""
    rows, folder = _sequences(spark), str(tmp_path / "cache")
    own, calls = writers.Report.write, []

    def breaks(self, df, save, *sums):
        calls.append(1)
        if len(calls) == 4:
            save(df)
            raise KeyboardInterrupt
        return own(self, df, save, *sums)

    monkeypatch.setattr(writers.Report, "write", breaks)
    with pytest.raises(KeyboardInterrupt):
        writers.write_dataset(rows, folder, "id", 1300, {}, per_job=2)
    assert readers.read_dataset(spark, folder) is None
    monkeypatch.setattr(writers.Report, "write", own)
    manifest = writers.write_dataset(rows, folder, "id", meta={}, **again)
    back = readers.read_dataset(spark, folder)
    assert _content(back) == _content(rows)
    assert manifest["total_rows"] == 40
    order = back.groupBy("shard_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("shard_id").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(order, order[1:], strict=False))
    # And back to the first budget, where shards of the second were written meanwhile.
    (tmp_path / "cache" / "manifest.json").unlink()
    writers.write_dataset(rows, folder, "id", 1300, {}, per_job=3)
    assert _content(readers.read_dataset(spark, folder)) == _content(rows)


def test_a_dataset_reads_its_source_a_constant_number_of_times(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def passed(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = _sequences(spark)
    writers.write_dataset(rows.mapInPandas(passed, rows.schema), str(tmp_path / "cache"), "id", 700, {}, per_job=1)
    assert readers.read_manifest(spark, str(tmp_path / "cache"))["num_shards"] > 6
    assert seen.value <= 3 * 40


def test_a_dataset_without_rows_keeps_its_schema(spark, tmp_path):
    rows = _sequences(spark).limit(0)
    assert writers.write_dataset(rows, str(tmp_path / "cache"), "id", 700, {})["num_shards"] == 0
    back = readers.read_dataset(spark, str(tmp_path / "cache"))
    assert back.count() == 0 and back.drop("shard_id").columns == rows.columns


def test_reports_come_from_the_job_that_writes(spark, tmp_path):
    df = spark.range(10).withColumn("lang", F.when(F.col("id") < 3, "en").otherwise("fr"))
    found = writers.Report().write(df, lambda x: x.write.parquet(str(tmp_path / "out")), F.count_if(F.col("lang") == "en").alias("en"), F.sum("id").alias("total"))
    assert found.counts == {"rows": 10, "en": 3, "total": 45}
    said = json.loads(found.text(kind="x"))
    assert said["rows"] == 10 and said["kind"] == "x" and said["rows_per_sec"] > 0


def test_a_folder_has_a_fingerprint_of_its_files(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "t"))
    first = readers.fingerprint(spark, str(tmp_path / "t"))
    assert first[2] > 0 and first == readers.fingerprint(spark, str(tmp_path / "t"))
    spark.range(6).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    assert readers.fingerprint(spark, str(tmp_path / "t")) != first


def test_weights_and_fingerprints_of_files(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.resolve_weights(spark, str(tmp_path))
    (tmp_path / "model.safetensors").write_text("x")
    assert readers.resolve_weights(spark, str(tmp_path)) == ["model.safetensors"]
    (tmp_path / "other.safetensors").write_text("x")
    with pytest.raises(ValueError):
        readers.resolve_weights(spark, str(tmp_path))
    (tmp_path / "model.index.json").write_text('{"weight_map": {"a": "f1", "b": "f2", "c": "f1"}}')
    assert readers.resolve_weights(spark, str(tmp_path)) == ["f1", "f2"]
    assert readers.fingerprint(spark, str(tmp_path / "model.safetensors"))[2] == 1
    assert readers.fingerprint(spark, str(tmp_path / "none")) == (str(tmp_path / "none"), 0, 0)


def test_streamed_metrics_go_to_a_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, "x", True, 3), (2, None, "y", False, 4)], "step long, loss double, name string, flag boolean, n int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    streams.log_metrics(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).select("step", "name", "value").collect()
    assert sorted(map(tuple, found)) == [(1, "loss", 0.5), (1, "n", 3.0), (2, "n", 4.0)]


def test_elapsed_seconds():
    with writers.Timer() as t:
        sum(range(1000))
    assert 0 < t.seconds < 5


def test_shards_of_one_range_are_written_by_many_tasks(spark, tmp_path):
    """Rows that one task has staged: their shards are dealt to tasks of their own, each whole shards next to each other."""
    rows, folder = _sequences(spark), str(tmp_path / "cache")
    n = writers.write_dataset(rows, folder, "id", 700, {})["num_shards"]
    files = {int(p.parent.name[9:]): int(p.name[5:10]) for p in (tmp_path / "cache" / "rows").glob("shard_id=*/part-*")}
    assert len(files) == n > 6 and len(list((tmp_path / "cache" / "rows").glob("shard_id=*/part-*"))) == n
    assert len(set(files.values())) > n // 2
    assert [files[k] for k in range(n)] == sorted(files.values())
    # A shard that the manifest doesn't have is none of the dataset's.
    (tmp_path / "cache" / "rows" / "shard_id=0").rename(tmp_path / "cache" / "rows" / f"shard_id={n}")
    assert readers.read_dataset(spark, folder).count() < 40


def test_a_dataset_runs_its_source_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def passed(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = _sequences(spark)
    writers.write_dataset(rows.mapInPandas(passed, rows.schema), str(tmp_path / "cache"), "id", 700, {})
    assert seen.value == 40
    assert not list((tmp_path / "cache").glob("unsorted*")) and not list((tmp_path / "cache").glob("rows-*"))


def test_shards_are_the_same_on_a_local_disk_and_in_other_stores(spark, tmp_path, monkeypatch):
    """Nulls, nested values and all; shards written from tasks take the place of those that Spark's writer has left."""
    rows = _sequences(spark).selectExpr("*", "if(id % 3 = 0, null, named_struct('d', date'2020-01-01', 'm', map('a', timestamp'2020-01-01 01:02:03'))) AS x", "cast(id AS decimal(20, 3)) AS y")
    monkeypatch.setattr(writers.Files, "local", lambda self, path: False)
    plan = writers.write_dataset(rows, str(tmp_path / "a"), "id", 1300, {})
    writers.write_dataset(rows, str(tmp_path / "b"), "id", 1300, {})
    monkeypatch.undo()
    (tmp_path / "b" / "manifest.json").unlink()
    for mark in (tmp_path / "b" / "done").iterdir():
        mark.unlink()
    assert writers.write_dataset(rows, str(tmp_path / "b"), "id", 1300, {}) == plan
    content = lambda name: sorted(map(str, readers.read_dataset(spark, str(tmp_path / name)).collect()))
    assert content("a") == content("b") and plan["num_shards"] > 3
    assert len(list((tmp_path / "b" / "rows").glob("shard_id=*/*.parquet"))) == plan["num_shards"]


def test_some_columns_of_shards_are_read_without_listing_them(spark, tmp_path):
    rows = _sequences(spark, 40)
    folder = str(tmp_path / "cache")
    n = writers.write_dataset(rows, folder, "id", 700, {})["num_shards"]
    (tmp_path / "cache" / "rows" / "shard_id=0" / ".hidden.parquet").write_text("")
    (tmp_path / "cache" / "rows" / f"shard_id={n}").mkdir()
    found = readers.read_dataset(spark, folder, ["total_len", "id"])
    assert found.columns == ["total_len", "id"] and found.inputFiles() == []
    assert sorted(found.collect()) == sorted(rows.select("total_len", "id").collect())
    assert readers.read_dataset(spark, folder, ["id", "gate_mask"]).exceptAll(rows.select("id", "gate_mask")).count() == 0
    assert readers.read_dataset(spark, str(tmp_path / "none"), ["id"]) is None
    writers.write_dataset(rows.limit(0), str(tmp_path / "empty"), "id", 700, {})
    assert readers.read_dataset(spark, str(tmp_path / "empty"), ["id"]).count() == 0
    import shutil

    shutil.rmtree(tmp_path / "cache" / "rows" / "shard_id=1")
    with pytest.raises(Exception, match="shard_id=1"):
        found.collect()
