import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import batches, sequences
from corpusloom.plans import build
from corpusloom.streaming import streams

SF = "/root/testdata/sf0.001"


def _chunks(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").filter("conv_id < 12")
    s = build.Settings(chunk=32, least=16)
    made = build.chunk_table(turns, s)
    whole = made.withColumn("seq_id", F.xxhash64(*build.KEYS)).select("seq_id", "chunk_idx", "input_ids", "regular_token_mask")
    top = whole.groupBy("seq_id").agg(F.max("chunk_idx").alias("top"))
    return whole.join(top, "seq_id").select("seq_id", "chunk_idx", "input_ids", "regular_token_mask", (F.col("chunk_idx") == F.col("top")).alias("last"))


def _written(spark, rows, path, schema, files):
    random.Random(4).shuffle(rows)
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(path)


def test_chunks_that_come_late_give_the_state_of_the_batch(spark, tmp_path):
    chunks = _chunks(spark)
    rows = [tuple(r) for r in chunks.collect()]
    expected = {(r["seq_id"], r["chunk_idx"]): r["kept"] for r in sequences.seen_state(chunks, ["seq_id"]).collect()}
    past = {(r["seq_id"], r["chunk_idx"]): r["past"] for r in sequences.past_seen(chunks, ["seq_id"]).collect()}
    assert max(k for _, k in past) >= 3
    _written(spark, rows + rows[:5], str(tmp_path / "in"), chunks.schema, 4)
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = streams.drained(streams.kept_state(stream), "append").collect()
    assert {(r["seq_id"], r["chunk_idx"]): r["kept"] for r in found} == expected
    assert {(r["seq_id"], r["chunk_idx"]): r["past"] for r in found} == past
    assert len(found) == len(expected)


def test_a_gap_waits_no_longer_than_its_patience(spark, tmp_path):
    schema = "seq_id long, chunk_idx long, input_ids array<long>, regular_token_mask array<long>, last boolean"
    one = lambda seq, idx, ids, last=False: (seq, idx, ids, [1] * len(ids), last)
    spark.createDataFrame([one(1, 0, [5]), one(1, 2, [7]), one(2, 0, [1], True)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streams.kept_state(stream, "1 ms").writeStream.format("memory").queryName("gap").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    until = time.time() + 90
    while time.time() < until and spark.table("gap").filter("past is null").count() < 1:
        time.sleep(1)
    query.stop()
    found = spark.table("gap").collect()
    assert [(r["chunk_idx"], r["kept"]) for r in found if r["past"] is None] == [(2, [7])]
    assert (1, 0, 0, [5]) in [tuple(r) for r in found]


@pytest.mark.parametrize("each", [1, 5])
def test_batches_go_on_after_a_stop(spark, tmp_path, each):
    lengths = spark.createDataFrame([(f"k{k}", k % 7) for k in range(29)], "key string, n long")
    settings = {"per_device": 2, "ranks": 2, "window": 2}
    whole = 29 // 4

    def plan(epoch):
        return batches.grouped_batches(lengths, "key", "n", seed=1, epoch=epoch, **settings)

    def deliver(rows, number):
        rows.write.mode("overwrite").parquet(str(tmp_path / f"out/{number}"))

    runs = 12 // each + 3
    for k in range(runs):
        # Each start delivers once and stops; now and then a delivery breaks off.
        calls = []

        def breaks(rows, number):
            calls.append(number)
            if k % 4 == 2:
                raise RuntimeError("broken off")
            deliver(rows, number)

        query = streams.endless_batches(spark, plan, whole, str(tmp_path / "state"), breaks, each).trigger(once=True).start()
        try:
            query.awaitTermination()
        except Exception as e:
            assert "broken off" in str(e)
    found = spark.read.parquet(str(tmp_path / "out/*")).select("epoch", "cursor", "key", "rank", "slot").collect()
    n = max(r["cursor"] for r in found) + 1
    assert n > whole
    expected = batches.epoch_batches(lengths, "key", "n", epochs=4, accumulate=1, seed=1, **settings).filter(F.col("batch") < n).collect()
    assert sorted(tuple(r) for r in found) == sorted((r["epoch"], r["batch"], r["key"], r["rank"], r["slot"]) for r in expected)


def test_runs_of_visibility(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").filter("conv_id < 9")
    parts = build.chunk_table(turns, build.Settings())
    runs = sequences.visibility_runs(parts, build.KEYS)
    rows = sequences.blocks(parts, build.KEYS)
    counts = {tuple(r[:4]): r["n_visible"] for r in sequences.visible_counts(rows, build.KEYS).collect()}
    by_run = {}
    for r in sequences.run_counts(runs, build.KEYS).collect():
        for q in range(r["first"], r["last"] + 1):
            by_run[(r["conv_id"], r["turn"], r["chunk_idx"], q)] = r["at_first"] + q - r["first"] if r["gate"] >= 0 else 0
        assert r["pairs"] == sum(by_run[(r["conv_id"], r["turn"], r["chunk_idx"], q)] for q in range(r["first"], r["last"] + 1))
    assert by_run == counts
    pairs = sorted(map(tuple, sequences.expanded_ranges(sequences.key_ranges(runs, build.KEYS), build.KEYS).collect()))
    assert pairs == sorted(map(tuple, sequences.visible_pairs(rows, build.KEYS).collect()))


def test_runs_of_a_long_row_grow_with_its_blocks(spark):
    """100,000 tokens: a prompt, then blocks of a plain token and four masked ones."""
    gate = [0] * 50_000 + [0, 1, 1, 1, 1] * 10_000
    row = spark.createDataFrame([(1, 0, gate, [int(g == 0) for g in gate])], "seq long, chunk_idx long, gate_mask array<long>, regular_token_mask array<long>")
    runs = sequences.visibility_runs(row, ["seq"])
    found = sequences.run_counts(runs, ["seq"]).agg(F.count(F.lit(1)).alias("n"), F.sum("pairs").alias("pairs")).first()
    assert found["n"] == 20_000
    plain = 50_000 * 50_001 // 2
    expected = plain + sum(50_001 + b + sum(50_001 + b + m for m in range(1, 5)) for b in range(10_000))
    assert found["pairs"] == expected


class _Counted:
    """A state of one key that notes what is asked of it."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name in ("update", "put", "clear"):
                self.value = args[0] if args else None
            return self.value is not None if name == "exists" else self.value

        return call


def test_a_sequence_asks_its_state_no_more_than_it_must():
    """Twice for chunks that come in their order, twice more where some wait; rows come and go, no frame for a sequence."""
    calls = []
    handle = type("Handle", (), {"getValueState": lambda *_: _Counted(calls), "getListState": lambda *_: _Counted(calls)})()
    made = streams._Folded(None)
    made.init(handle)
    chunk = lambda idx, last=False: {"chunk_idx": idx, "input_ids": [idx, 9], "regular_token_mask": [1, 0], "last": last}
    fold = lambda *chunks: [tuple(r) for r in made.handleInputRows(("s",), iter(chunks), None)]
    assert fold(chunk(0)) == [("s", 0, 0, [0])] and calls == ["get", "update"]
    assert fold(chunk(2)) == [] and calls[2:] == ["get", "update", "put"]
    assert fold(chunk(3, True), chunk(1)) == [("s", 1, 1, [1]), ("s", 2, 2, [2]), ("s", 3, 3, [3])] and calls[5:] == ["get", "get", "update", "clear"]
    assert fold(chunk(1)) == [] and calls[9:] == ["get", "update"]
