import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import batches, metrics, prompts, sequences


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str | None.__class__) else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_white_space_is_unicode(spark):
    assert one(spark, T.normalise(F.col("t")), t="  a \tb \n") == "a b"
    assert one(spark, T.is_blank(F.col("t")), t="　\t") is True
    assert one(spark, T.is_blank(F.col("t")), t=None) is True


@pytest.mark.parametrize("text, domain", [("  return your final response within \\boxed{}. x", "math"), ("Return your final response within \\\\boxed{}.", "math"), ("Return your final response within boxed{}.", "other"), ("Generate an EXECUTABLE Python function x", "code"), (" generate an executable python function", "other")])
def test_domains(spark, text, domain):
    assert one(spark, T.domain(F.col("t")), t=text) == domain


def test_weighted_choice(spark):
    pick = lambda mix, u: one(spark, T.choose(mix, F.col("u")), u=u)
    assert pick({"a": 1, "b": 3}, 0.25) == "a"
    assert pick({"a": 1, "b": 3}, 0.2501) == "b"
    assert pick({"a": -1, "b": 0}, 0.5) == "none"


def test_names(spark):
    assert one(spark, T.sanitised(F.col("t")), t=" a b/c--d- ") == "ab-c-d"
    assert one(spark, T.base_name(F.col("t")), t="/x/y.tar.gz/") == "y.tar"
    assert one(spark, T.base_name(F.col("t")), t=".hidden") == ".hidden"
    assert [one(spark, T.short_number(F.col("x")), x=x) for x in (2e-4, 0.01, 1000.0, 0.0, 12.5)] == ["2e-04", "0.01", "1e+03", "0", "12.5"]


def test_records_of_any_shape(spark):
    schema = "id int, conversations array<struct<`from`:string,value:string,role:string,content:string>>, messages array<struct<`from`:string,value:string,role:string,content:string>>, input string, question string, prompt string"
    m = lambda **k: (k.get("frm"), k.get("value"), k.get("role"), k.get("content"))
    rows = [
        (1, [m(frm="system", value="s"), m(frm="human", value=" "), m(frm="user", value="hi")], None, None, None, None),
        (2, None, [m(role="assistant", content="x"), m(role="user", content="yo")], None, None, None),
        (3, [], [], " ", "q", "p"),
        (4, None, None, None, None, None),
        (5, [m(role="user", content="first"), m(frm="human", value="second")], None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    assert [r["p"] for r in df.orderBy("id").select(prompts.first_prompt_of(df).alias("p")).collect()] == ["hi", "yo", "q", None, "first"]
    assert [r["p"] for r in df.orderBy("id").select(prompts.first_human_of(F.col("conversations")).alias("p")).collect()] == [" ", None, None, None, "second"]


def test_quotas():
    weights = prompts.bucket_weights()
    assert sum(weights.values()) == pytest.approx(1)
    for total in (0, 1, 7, 10, 999, 122_880):
        quotas = prompts.bucket_quotas(total, weights)
        assert sum(quotas.values()) == total
        assert sum(prompts.file_targets(quotas).values()) == total
    assert prompts.bucket_weights({"math": -1.0}) == weights
    assert prompts.bucket_weights({"math": 3, "code": 1}) == {"chat": 0, "math": 0.75, "code": 0.25, "science": 0, "if": 0}
    assert prompts.file_targets({"a": 5}, {"f": "a", "g": "a"}) == {"f": 3, "g": 2}


def test_keep_first_and_quota(spark):
    rows = spark.createDataFrame([("f", 1, "a", 10), ("f", 2, "a", 11), ("f", 3, None, 12), ("g", 4, "a", 13), ("g", 5, "c", 14), ("g", 6, "d", 15)], "file string, order int, key string, extra int")
    assert sorted(r["extra"] for r in prompts.keep_first(rows, F.col("key"), "order").collect()) == [10, 12, 14, 15]
    chosen = prompts.sample_by_quota(rows, {"f": 1, "g": 2})
    assert sorted(r["extra"] for r in chosen.collect()) == [10, 14, 15]
    assert prompts.top_up(rows, prompts.sample_by_quota(rows, {"f": 1, "g": 1}), "g", 3).count() == 3
    assert prompts.sample_by_quota(rows, {}).count() == 0


def slow_expand(prompt, out, draft):
    ids = list(prompt)
    for t in out:
        ids += [t] + [-2] * draft
    pos = list(range(len(prompt))) + [len(prompt) + j + k for j in range(len(out)) for k in range(draft + 1)]
    gate = [0] * len(prompt) + [int(k >= 1 and j + k + 1 < len(out)) for j in range(len(out)) for k in range(draft + 1)]
    return ids, pos, gate, [int(i != -2) for i in ids]


def slow_chunks(n_in, gate, draft, size):
    block, length = draft + 1, len(gate)
    start_of_blocks = gate.index(1) - 1 if 1 in gate else length
    out, start, end = [], 0, start_of_blocks
    while True:
        while end < length and end + block - start <= size:
            end += block
        out.append((start, min(end, length)))
        if end >= length:
            return out
        start = end


def test_expansion_and_chunks_match_step_by_step(spark):
    rng = random.Random(3)
    cases = [(k, rng.randint(0, 12), rng.randint(0, 14), rng.randint(0, 4)) for k in range(120)]
    for draft in range(5):
        own = [c for c in cases if c[3] == draft]
        rows = spark.createDataFrame([(k, [100 + i for i in range(a)], [200 + i for i in range(b)]) for k, a, b, _ in own], "id int, in_ids array<long>, out_ids array<long>")
        made = sequences.expand(rows, draft)
        size = 10
        parts = sequences.chunks(made, ["id"], draft, size, 6, [6, 8, 10]).collect()
        for r in made.collect():
            a, b = next((a, b) for k, a, b, _ in own if k == r["id"])
            ids, pos, gate, regular = slow_expand([100 + i for i in range(a)], [200 + i for i in range(b)], draft)
            assert (r["input_ids"], r["position_ids"], r["gate_mask"], r["regular_token_mask"], r["total_len"]) == (ids, pos, gate, regular, len(ids))
            mine = sorted((p for p in parts if p["id"] == r["id"]), key=lambda p: p["chunk_idx"])
            assert [(p["start"], p["end"]) for p in mine] == slow_chunks(a, gate, draft, size)
            assert sum((p["input_ids"][: p["end"] - p["start"]] for p in mine), []) == ids
            for p in mine:
                assert len(p["gate_mask"]) == max(p["target_len"], p["end"] - p["start"])
                assert set(p["gate_mask"][p["end"] - p["start"] :]) <= {-1}


def test_the_worked_row(spark):
    rows = spark.createDataFrame([(1, [10, 11], [1, 2, 3, 4])], "id int, in_ids array<long>, out_ids array<long>")
    made = sequences.expand(rows, 2)
    r = made.first()
    assert r["position_ids"] == [0, 1, 2, 3, 4, 3, 4, 5, 4, 5, 6, 5, 6, 7]
    assert r["gate_mask"] == [0, 0, 0, 1, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0]
    parts = sequences.chunks(made, ["id"], 2, 64, 1, [14, 64])
    blocks = sequences.blocks(parts, ["id"])
    assert sequences.visible_pairs(blocks, ["id"]).count() == 80
    assert sequences.visible_counts(blocks, ["id"]).agg(F.sum("n_visible")).first()[0] == 80
    assert sequences.position_gaps(parts, ["id"]).count() == 0


def test_chunk_must_hold_a_block(spark):
    rows = spark.createDataFrame([(1, 2, 3)], "id int, prompt_len long, total_len long")
    with pytest.raises(ValueError):
        sequences.chunk_bounds(rows, ["id"], 4, 3, 1, [3])


def test_batches(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(k, rng.randint(1, 500)) for k in range(1003)], "id long, len long")
    out = batches.grouped_batches(rows, "id", "len", seed=1, epoch=0, per_device=2, ranks=4, window=5).collect()
    assert len({r["id"] for r in out}) == len(out) == 1000
    assert sorted((r["batch"], r["rank"], r["slot"]) for r in out) == [(b, k, s) for b in range(125) for k in range(4) for s in range(2)]
    by_pos = sorted(out, key=lambda r: r["pos"])
    for t in range(0, 1000, 40):
        lengths = [r["len"] for r in by_pos[t : t + 40]]
        assert lengths == sorted(lengths, reverse=True)
    again = batches.grouped_batches(rows.repartition(5), "id", "len", seed=1, epoch=0, per_device=2, ranks=4, window=5).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def slow_cut(sizes, budget):
    out, shard, filled, empty = [], 0, 0, True
    for s in sizes:
        if not empty and (s >= budget or filled + s > budget):
            shard, filled, empty = shard + 1, 0, True
        out.append(shard)
        filled, empty = filled + s, False
        if s >= budget:
            shard, filled, empty = shard + 1, 0, True
    return out


def test_shards(spark):
    rng = random.Random(5)
    sizes = [rng.choice([1, 5, 30, 99, 100, 250]) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(sizes)), "row_id long, bytes long").repartition(7)
    assert [r["shard_id"] for r in batches.shard_plan(rows, 100).orderBy("row_id").collect()] == slow_cut(sizes, 100)
    assert batches.shard_plan(rows.limit(0), 100).count() == 0


@pytest.mark.parametrize("width, tolerance", [(4096, 2e-4), (20_000, 3e-4)])
def test_soft_cross_entropy_two_ways(spark, width, tolerance):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=width).tolist(), rng.normal(size=width).tolist()) for k in range(4)]
    df = spark.createDataFrame(rows, "id int, x array<double>, t array<double>")
    found = df.select("id", V.soft_cross_entropy(F.col("x"), F.col("t")).alias("a"), V.soft_cross_entropy_plain(F.col("x"), F.col("t")).alias("b"), V.soft_cross_entropy_gradient(F.col("x"), F.col("t")).alias("g")).collect()
    wide = {r["id"]: r["loss"] for r in metrics.log_sum_exp_parts(df.select("id", F.inline(F.arrays_zip("x", "t"))), ["id"], "x", "t").collect()}
    for r, (_, x, t) in zip(sorted(found, key=lambda r: r["id"]), rows, strict=True):
        x, t = np.array(x), np.array(t)
        p, q = np.exp(x) / np.exp(x).sum(), np.exp(t) / np.exp(t).sum()
        assert abs(r["a"] - r["b"]) < tolerance
        assert abs(r["a"] + (q * np.log(p)).sum()) < tolerance
        assert abs(wide[r["id"]] - r["a"]) < tolerance
        assert np.abs(np.array(r["g"]) - (p - q)).max() < tolerance


def test_loss_holds_for_large_values(spark):
    df = spark.createDataFrame([([1e4, -1e4, 0.0], [-1e4, 1e4, 0.0])], "x array<double>, t array<double>")
    assert df.select(V.soft_cross_entropy(F.col("x"), F.col("t")).alias("x")).first()["x"] == pytest.approx(2e4)


def test_vector_helpers(spark):
    df = spark.createDataFrame([([0, 3, 0, 3], [1.0, 2.0])], "v array<long>, w array<double>")
    r = df.select(V.places_of(F.col("v")).alias("p"), V.argmax(F.col("v")).alias("a"), V.padded(F.col("v"), F.lit(6), -1).alias("d"), V.padded(F.col("v"), F.lit(2), -1).alias("e"), V.bucket_for(F.lit(5), [8, 4]).alias("b"), V.bucket_for(F.lit(9), [8, 4]).alias("c")).first()
    assert (r["p"], r["a"], r["d"], r["e"], r["b"], r["c"]) == ([1, 3], 1, [0, 3, 0, 3, -1, -1], [0, 3, 0, 3], 8, 9)


def test_step_statistics(spark):
    rows = [(0, 0, 0, 2.0, 0.5, True, 4, [4, 2]), (0, 0, 0, 4.0, 0.5, True, 4, [0, 2]), (1, 1, 0, 6.0, 1.0, True, 2, [1, 1]), (1, 1, 0, 9.0, 1.0, False, 2, [2, 2])]
    df = spark.createDataFrame(rows, "rank int, batch int, row int, loss double, scale double, valid boolean, tokens long, correct array<long>")
    found = {r["d"]: r for r in metrics.step_statistics(df, 2).collect()}
    assert found[0]["loss"] == pytest.approx(9 / 3)
    assert found[0]["acc"] == pytest.approx(50)
    assert found[1]["acc"] == pytest.approx(50)
    assert metrics.step_statistics(df, 2, "batch").first()["loss"] == pytest.approx(4.5)


def test_shards_over_many_ranges(spark):
    """Shards of several ranges, ranges of several shards, rows alone at the edges of ranges; keys of any kind."""
    rng = random.Random(8)
    for budget, most in ((100, 40), (100, 130), (1000, 30), (5, 9)):
        sizes = [rng.choice([rng.randint(0, most), rng.randint(0, 5), budget]) if k % 3 else rng.randint(0, most) for k in range(300)]
        rows = spark.createDataFrame([(f"k{k:05d}", s) for k, s in enumerate(sizes)], "row_id string, bytes long")
        found = batches.shard_plan(rows, budget, 17).orderBy("row_id").collect()
        assert [r["shard_id"] for r in found] == slow_cut(sizes, budget)


@pytest.mark.parametrize("fan", [2, 3])
def test_shards_over_a_tree_of_ranges(spark, fan):
    """Outcomes of ranges put together over several levels; empty and single ranges too."""
    rng = random.Random(fan)
    for budget, most, size in ((100, 40, 9), (100, 130, 5), (2000, 30, 11), (50, 3, 4), (10**6, 9, 7)):
        sizes = [rng.choice([rng.randint(0, most), 0, budget if rng.random() < 0.05 else 1]) for _ in range(160)]
        rows = spark.createDataFrame(list(enumerate(sizes)), "row_id long, bytes long")
        found = batches.shard_plan(rows, budget, size, fan).orderBy("row_id").collect()
        assert [r["shard_id"] for r in found] == slow_cut(sizes, budget)


def test_outcomes_put_together_are_those_of_the_whole():
    rng = np.random.default_rng(5)
    for _ in range(300):
        budget = int(rng.integers(1, 60))
        runs = [rng.integers(0, int(rng.choice([2, 20, 80])), int(rng.integers(0, 9))) for _ in range(int(rng.integers(1, 6)))]
        parts = [batches.Outcomes.of(r, budget) for r in runs if len(r)]
        joined = batches.Outcomes.joined(iter(parts), budget)
        for filled in (-1, *range(0, budget + 1, 3)):
            shards, left = np.array([0]), np.array([filled])
            for part in parts:
                shards, left = part.step(shards, left, budget)
            found = joined.step(np.array([0]), np.array([filled]), budget)
            assert (int(shards[0]), int(left[0])) == (int(found[0][0]), int(found[1][0]))


@pytest.mark.parametrize("few", [1, 8, 1 << 16])
def test_first_rows_without_a_sort(spark, few):
    rng = random.Random(few)
    rows = [(k, f"k{rng.randrange(60)}", rng.randrange(-5, 5)) for k in range(300)] + [(7, "same", 1)] * 40
    df = spark.createDataFrame(rows, "id long, name string, n int")
    for k in (0, 1, 2, 57, 150, 339, 340, 1000):
        for column, kind in (("id", "bigint"), ("n", "int"), ("name", "string")):
            found = prompts.first_rows(df, k, prompts.sort_key(F.col(column), kind), few).collect()
            order = df.columns.index(column)
            expected = sorted(r[order] for r in rows)[:k]
            assert sorted(r[order] for r in found) == expected
            assert not set(map(tuple, found)) - set(rows)
            assert len(found) == len(expected)


def test_half_of_the_rows_come_from_all_tasks(spark):
    """The sample is the sorted one, and no task gives more than its share of it."""
    rows = spark.range(20_000).repartition(8)
    found = prompts.sample(rows, 10_000, 3, "id")
    assert sorted(r[0] for r in found.collect()) == sorted(r[0] for r in rows.orderBy(T.order_hash(F.col("id"), 3), "id").limit(10_000).collect())
    sizes = sorted(r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_duplicates_are_counted_up_to_the_last_that_is_taken(spark):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, "y"), ("a", 5, "z"), ("b", 1, "x"), ("b", 2, "w"), ("b", 3, "w"), ("b", 4, "z"), ("c", 1, "q")]
    df, targets = spark.createDataFrame(rows, "file string, order long, key string"), {"a": 2, "b": 5, "c": 0, "d": 3}
    found = prompts.quota_report(df, targets, prompts.sample_by_quota(df, targets)).collect()
    assert sorted(map(tuple, found)) == [("a", 2, 2, 1), ("b", 5, 2, 2), ("c", 0, 0, 0), ("d", 3, 0, 0)]


def test_plain_batches(spark):
    rows = spark.createDataFrame([(f"k{k}",) for k in range(23)], "key string")
    for drop in (True, False):
        found = batches.plain_batches(rows, "key", seed=1, epoch=0, per_device=2, ranks=4, drop_last=drop).collect()
        own = {r: [x["key"] for x in sorted(found, key=lambda x: x["pos"]) if x["rank"] == r] for r in range(4)}
        assert {len(v) for v in own.values()} == ({4} if drop else {6})
        assert len({x["key"] for x in found}) == (16 if drop else 23)
        assert max(sum(1 for x in found if (x["batch"], x["rank"]) == at) for at in {(x["batch"], x["rank"]) for x in found}) == 2
    few = batches.plain_batches(rows.limit(1), "key", seed=1, epoch=0, per_device=2, ranks=4, drop_last=False).collect()
    assert sorted(x["rank"] for x in few) == [0, 1, 2, 3]


def test_row_sizes_of_any_schema(spark):
    row = {"a": None, "flag": True, "n": 5, "x": 1.5, "t": "é", "b": b"abc", "ids": [1, 2, None], "nest": [["a", "bc"], []], "rec": {"who": "me", "deep": [{"k": 1}, {"k": None}]}, "map": {"key": "v", "k2": None}}
    schema = "a string, flag boolean, n int, x double, t string, b binary, ids array<long>, nest array<array<string>>, rec struct<who:string,deep:array<struct<k:long>>>, map map<string,string>"

    def size(v):
        if v is None:
            return 0
        if isinstance(v, bool):
            return 1
        if isinstance(v, int | float):
            return 8
        if isinstance(v, str):
            return len(v.encode())
        if isinstance(v, bytes):
            return len(v)
        if isinstance(v, list):
            return sum(map(size, v))
        return sum(len(k) + size(x) for k, x in v.items())

    df = spark.createDataFrame([row, dict.fromkeys(row)], schema)
    assert [r[0] for r in df.select(batches.row_size(df)).collect()] == [64 + sum(map(size, row.values())), 64]
    wide = spark.createDataFrame([([1, 2, 3],)], "ids array<long>")
    assert wide.select(batches.row_size(wide)).first()[0] == 64 + 24


def test_quota_scans_grow_with_the_files(spark):
    rows = spark.range(600).selectExpr("concat('f', id % 6) file", "id `order`", "md5(cast(id % 400 as string)) key")
    chosen = prompts.sample_by_quota(rows, {f"f{k}": 20 for k in range(6)})
    assert chosen.count() == 120
    assert chosen._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 6


def test_samples_larger_than_the_population_are_refused(spark):
    rows = spark.range(5).withColumnRenamed("id", "k")
    assert prompts.sample_exactly(rows, 5, 1, "k").count() == 5
    with pytest.raises(ValueError):
        prompts.sample_exactly(rows, 6, 1, "k")


def test_batches_without_a_valid_chunk_count_for_the_loss(spark):
    rows = [(0, 0, 0, 2.0, 1.0, True, 4, [4]), (0, 1, 0, 9.0, 1.0, False, 4, [0])]
    df = spark.createDataFrame(rows, "rank int, batch int, row int, loss double, scale double, valid boolean, tokens long, correct array<long>")
    r = metrics.step_statistics(df, 1, "batch").first()
    assert (r["loss"], r["batches"], r["batches_for_acc"]) == (1.0, 2, 1)
    assert r["acc"] == pytest.approx(100)


def test_six_significant_digits(spark):
    given = [123.456789, 0.00123456789, 0.5, 99.99999, 0.099999999, 999.9996]
    assert [one(spark, T.short_number(F.col("x")), x=x) for x in given] == [f"{x:g}" for x in given]


def test_the_mask_must_be_known_and_in_no_text(spark):
    assert T.mask_id({"<mask>": 7}) == 7
    with pytest.raises(ValueError):
        T.mask_id({"a": 1})
    rows = spark.createDataFrame([([1, 2], [3])], "in_ids array<long>, out_ids array<long>")
    assert sequences.require_no_mask(rows, ["in_ids", "out_ids"], 9).count() == 1
    with pytest.raises(ValueError):
        sequences.require_no_mask(rows, ["in_ids", "out_ids"], 3)


def test_visibility_inside_chunks_sorts_nothing(spark):
    """Gates in any order, pads between them too, against the rules; and no plan has a sort, a window or a join."""
    rng = random.Random(8)
    gates = [[rng.choice((-1, 0, 0, 1, 1, 1)) for _ in range(n)] for n in (0, 1, 2, 9, 30, 30)]
    rows = [(k // 2, k % 2, g, [int(x == 0) for x in g], 0 if k % 2 == 0 else sum(x == 0 for x in gates[k - 1])) for k, g in enumerate(gates)]
    whole = spark.createDataFrame([(*r[:2], [0] * len(r[2]), [0] * len(r[2]), *r[2:]) for r in rows], "seq long, chunk_idx long, input_ids array<long>, position_ids array<long>, gate_mask array<long>, regular_token_mask array<long>, past long")
    found = sequences.blocks(whole, ["seq"])
    assert sorted(found.collect()) == sorted(sequences.blocks(whole.drop("past"), ["seq"]).collect())
    slow = {}
    for seq, idx, g, _, past in rows:
        block, nth = past, 0
        for pos, x in enumerate(g):
            block, nth = block + (x == 0), 0 if x == 0 else nth + (x == 1)
            slow[(seq, idx, pos)] = (x, block, nth)
    assert {(r["seq"], r["chunk_idx"], r["pos"]): (r["gate"], r["block_id"], r["nth"]) for r in found.collect()} == slow
    pairs = sequences.chunk_pairs(whole, ["seq"])
    expected = [(s, c, q, k) for (s, c, q), (gq, bq, _) in slow.items() for k in range(q + 1) for gk, bk, _ in [slow[(s, c, k)]] if gq >= 0 and gk >= 0 and (gk == 0 or gq == 1 and bq == bk)]
    assert sorted(map(tuple, pairs.collect())) == sorted(expected) == sorted(map(tuple, sequences.visible_pairs(found, ["seq"]).collect()))
    for df in (found, sequences.visible_counts(found, ["seq"]), pairs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Sort", "Window", "Join", "Exchange"))


def test_shards_are_planned_over_as_many_ranges_as_there_are(spark, monkeypatch):
    """A session that deals out into more ranges than were asked for loses no rows of the plan."""
    frame = type(spark.range(1))
    asked = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *cols: asked(self, max(5, n), *cols))
    sizes = [(k * 7 % 40, 10 + k % 13) for k in range(40)]
    got = batches.shard_plan(spark.createDataFrame(sizes, "row_id long, bytes long"), 50, range_rows=100, fan=2).collect()
    assert sorted((r["row_id"], r["bytes"]) for r in got) == sorted(sizes)
    cut, shard, filled = {}, -1, 51
    for row, n in sorted(sizes):
        shard, filled = (shard + 1, n) if filled + n > 50 else (shard, filled + n)
        cut[row] = shard
    assert {r["row_id"]: r["shard_id"] for r in got} == cut
