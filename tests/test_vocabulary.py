import json

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from corpusloom.functions.vocabulary import STAND_IN, Vocabulary
from corpusloom.operators import batches
from corpusloom.plans import build
from corpusloom.sources import readers

SF = "/root/testdata/sf0.001"


def _file(tmp_path, name, words):
    made = Tokenizer(models.WordLevel({w: k for k, w in enumerate(["?", *words])}, unk_token="?"))
    made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    made.save(str(tmp_path / name))
    return str(tmp_path / name)


def test_ids_counts_and_mask(spark, tmp_path):
    v = Vocabulary(spark, _file(tmp_path, "v.json", ["a", "b"]))
    assert v.mask == 3
    rows = spark.createDataFrame([("a b a",), ("<mask> a",), ("",), (None,)], "t string").select(v(F.col("t")).alias("ids"), v.count(F.col("t")).alias("n")).collect()
    assert [(r["ids"], r["n"]) for r in rows] == [([1, 2, 1], 3), ([0, 1], 2), ([], 0), (None, None)]
    with pytest.raises(ValueError):
        Vocabulary(spark, _file(tmp_path, "v.json", ["a"]), pad="<none>")


def test_a_mask_that_is_there_is_not_added(spark, tmp_path):
    v = Vocabulary(spark, _file(tmp_path, "v.json", ["a", "<mask>"]))
    assert (v.mask, v.size) == (2, 3)


def test_lengths_chunks_batches_and_cache_agree(spark, tmp_path):
    import public_tokenizers

    turns, s = spark.read.parquet(f"{SF}/conversations.parquet"), build.Settings(shard_bytes=20_000)
    v = Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {r["seq_id"]: r["total_len"] for r in build.length_table(turns, s, v).collect()}
    assert lengths != {r["seq_id"]: r["total_len"] for r in build.length_table(turns, s).collect()}
    key = lambda r: f"{r['conv_id']}-{r['turn']}"
    kept = build.chunk_table(turns, s, v).groupBy("conv_id", "turn").agg(F.max("end").alias("n"), F.sum(F.expr("size(filter(input_ids, x -> x = %d))" % v.mask)).alias("masks")).collect()
    assert {key(r): r["n"] for r in kept} == lengths
    assert all(r["masks"] > 0 for r in kept)
    cached = build.cached_sequences(turns, s, str(tmp_path), f"{SF}/conversations.parquet", v)
    assert {key(r): r["total_len"] for r in cached.collect()} == lengths
    made = build.batch_table(turns, s, v)
    assert {r["seq_id"]: r["total_len"] for r in made.collect()}.items() <= lengths.items()
    plain = build.batch_table(turns, s, v, grouped=False, drop_last=False)
    assert {r["seq_id"] for r in plain.collect()} == set(lengths)
    assert batches.total_bytes(spark.createDataFrame([(1,)], "bytes long")).first()["rows"] == 1


def test_two_tokenizers_never_share_a_cache(spark, tmp_path):
    turns, s = spark.read.parquet(f"{SF}/conversations.parquet"), build.Settings()
    source = f"{SF}/conversations.parquet"
    one, two = Vocabulary(spark, _file(tmp_path, "v.json", ["a"])), Vocabulary(spark, _file(tmp_path, "v.json", ["b"]))
    assert one.fingerprint != two.fingerprint
    assert one.fingerprint == Vocabulary(spark, _file(tmp_path, "again.json", ["a"])).fingerprint
    build.cached_sequences(turns, s, str(tmp_path / "c"), source, one)
    for other in (two, STAND_IN):
        with pytest.raises(FileNotFoundError):
            build.cached_sequences(turns, s, str(tmp_path / "c"), source, other, build=False)
    assert build.cached_sequences(turns.limit(0), s, str(tmp_path / "c"), source, one, build=False).count() > 0
    with pytest.raises(ValueError):
        build.cached_sequences(turns, s, str(tmp_path / "c"), source, "some name")


def test_the_order_of_rows_is_that_of_the_dataset(spark, tmp_path):
    turns = spark.createDataFrame([(c, t, ("user", "assistant")[t % 2], f"w{c} " * 9) for c in (2, 10, 1, 30) for t in (0, 1)], "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "turns"))
    build.cached_sequences(turns, build.Settings(shard_bytes=2500), str(tmp_path / "c"), str(tmp_path / "turns"))
    (folder,) = (p for p in (tmp_path / "c").iterdir())
    back = readers.read_dataset(spark, str(folder)).groupBy("shard_id").agg(F.collect_list("conv_id").alias("ids")).orderBy("shard_id").collect()
    assert [i for r in back for i in r["ids"]] == [1, 2, 10, 30]
    assert json.loads((folder / "manifest.json").read_text())["num_shards"] > 1


def test_a_process_makes_a_tokenizer_once(spark, tmp_path):
    """A function that was sent to a task uses the process' tokenizers, and brings none of its own."""
    from types import SimpleNamespace

    from pyspark.cloudpickle import dumps, loads

    from corpusloom.functions import vocabulary

    v = Vocabulary(spark, _file(tmp_path, "v.json", ["a", "b"]))
    v.sent = SimpleNamespace(value=v.sent.value)
    sent = dumps(v._encoder())
    vocabulary._made.clear()
    assert loads(sent)(["a b", None]) == [[1, 2], None]
    (made,) = vocabulary._made.values()
    assert loads(sent)(["b"]) == [[2]] and vocabulary._made == {v.fingerprint: made}


def test_ids_back_to_texts(spark, tmp_path):
    v = Vocabulary(spark, _file(tmp_path, "v.json", ["a", "b"]))
    rows = spark.createDataFrame([(1, [1, 2, 1]), (2, None), (3, []), (4, [2, 3])], "k int, ids array<long>")
    assert [r["t"] for r in rows.orderBy("k").select(v.text(F.col("ids")).alias("t")).collect()] == ["a b a", None, "", "b <mask>"]


def test_a_worker_encodes_and_holds_some_texts_at_once(spark, tmp_path, monkeypatch):
    """All columns of a projection, back to texts too, are worked out by one process a task, in batches of bounded bytes."""
    import io
    from contextlib import redirect_stdout

    from corpusloom.functions import vocabulary
    from corpusloom.storage import BATCH_BYTES

    v = Vocabulary(spark, _file(tmp_path, "v.json", ["a", "b"]))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == BATCH_BYTES
    rows = spark.createDataFrame([("a", "b")], "t string, u string").select(v.text(v(F.col("t"))).alias("t"), v.text(v(F.col("u"))).alias("u"), v.count(F.col("u")).alias("n"))
    with redirect_stdout(said := io.StringIO()):
        rows.explain()
    assert said.getvalue().count("EvalPython") == 1
    assert rows.collect() == [("a", "b", 1)]

    monkeypatch.setattr(vocabulary, "PIECE_BYTES", 10)
    sent, most = v._encoder(), []
    monkeypatch.setattr(v, "_encoder", lambda: lambda texts: (most.append(sum(len(t) for t in texts if t is not None)), sent(texts))[1])
    monkeypatch.setattr(vocabulary.F, "arrow_udf", lambda kind: lambda f: lambda x: f(x))
    import pyarrow as pa

    texts = pa.array(["a b"] * 7 + [None, "", "a " * 30, "b"])
    assert v(texts).to_pylist() == [[1, 2]] * 7 + [None, [], [1] * 30, [2]]
    assert sorted(most)[-2] <= 10 and max(most) == 60 and len(most) == 5
    assert v.count(texts).to_pylist() == [2] * 7 + [None, 0, 30, 1]
    assert v(texts.slice(0, 0)).to_pylist() == [] and v(texts.slice(7, 1)).to_pylist() == [None]
    monkeypatch.setattr(vocabulary, "PIECE_IDS", 3)
    assert v.text(v(texts)).to_pylist() == ["a b"] * 7 + [None, "", " ".join(["a"] * 30), "b"]


def test_a_cache_stages_ids_and_has_the_same_rows_and_shards(spark, tmp_path, monkeypatch):
    """What is sorted are the ids, not the arrays that are made of them; sizes, shards and rows are those of the arrays."""
    from corpusloom.operators import sequences
    from corpusloom.sources import writers

    turns, s, staged = spark.read.parquet(f"{SF}/conversations.parquet"), build.Settings(shard_bytes=20_000), []
    mine = writers._staged
    monkeypatch.setattr(writers, "_staged", lambda rows, *rest: (staged.append(rows.columns), mine(rows, *rest))[1])
    source = f"{SF}/conversations.parquet"
    build.cached_sequences(turns, s, str(tmp_path / "c"), source)
    assert staged == [["conv_id", "turn", "in_ids", "out_ids"]]
    (folder,) = (str(p) for p in (tmp_path / "c").iterdir())
    before = writers.write_dataset(build.sequence_table(turns, s), str(tmp_path / "whole"), build.KEYS, s.shard_bytes, {})
    after = readers.read_manifest(spark, folder)
    assert after["num_shards"] == before["num_shards"] > 1 and after["schema"] == before["schema"]
    one, two = readers.read_dataset(spark, str(tmp_path / "whole")), readers.read_dataset(spark, folder)
    assert one.columns == two.columns and one.count() == two.count() > 0
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0
    odd = spark.createDataFrame([(1, [1, 2], [3] * 4), (2, None, [3]), (3, [1] * 5, None), (4, [], []), (5, None, None)], "id long, in_ids array<long>, out_ids array<long>")
    sizes = odd.select("id", sequences.expanded_bytes(odd, 4).alias("n"))
    wide = sequences.expand(odd, 4)
    assert sorted(sizes.collect()) == sorted(wide.select("id", batches.row_size(wide)).collect())
