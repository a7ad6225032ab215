import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from corpusloom.llm import dac, textvec
from corpusloom.llm.common import BATCH_BYTES, fresh_dir
from tests.llm.tables import documents, nothing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_random_access_equals_the_ids(tmp_path):
    rng = random.Random(2)
    ids = np.array([rng.choice([3, 255, 256, 49_000, 70_000, 1 << 24, (1 << 32) - 1]) for _ in range(1500)], np.uint32)
    uri = f"file://{tmp_path}/x.dac"
    dac.write_file(uri, [7, None], [1000, 500], ids)
    with dac.DacFile(uri) as f:
        assert (f.slice(0, len(ids)) == ids).all()
        assert all(f.token(i) == ids[i] for i in range(0, len(ids), 37))
        for _ in range(50):
            a, b = sorted(rng.sample(range(len(ids) + 1), 2))
            assert (f.slice(a, b) == ids[a:b]).all()
        assert f.part("start", 0, 3).tolist() == [0, 1000, 1500]


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    coded = []
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], np.uint32)
        coded.append((doc is not None, doc or 0, ids.astype("<u2").tobytes(), doc, ids))
    out, start = [], 0
    for *_, doc, ids in sorted(coded, key=lambda r: r[:3]):
        out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        start += len(ids)
    return out


def test_files_give_back_every_document(spark):
    odd = [(500, "a<|endoftext|>b it's 12 ́x \x85 ​ ΑΣ İ 中文 ﬁ"), (-3, "negative id"), (None, "no id"), (None, None)]
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    for chars in (2000, 1 << 30):
        found = dac.tokenise(docs, PATH, 2, chars)
        assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == expected(rows)


def test_word_memory_is_bounded_and_right(monkeypatch):
    monkeypatch.setattr(dac, "CACHE_WORDS", 10)
    words, plain = dac.Words(PATH, 2), Tokenizer.from_file(PATH)
    assert words.apart
    texts = [f"alpha{k % 30} beta, Gamma{k % 7}" for k in range(200)]
    for i in range(0, 200, 20):
        ids, lengths = words.encode(pa.array(texts[i : i + 20]))
        assert ids.tolist() == [x for t in texts[i : i + 20] for x in (*plain.encode(t, add_special_tokens=False).ids, 2)]
        assert lengths.sum() == len(ids)
    assert len(words.hashes) < 120


def test_a_tokenizer_that_looks_across_white_space_is_given_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    words, plain = dac.Words(path, 2), Tokenizer.from_file(path)
    assert not words.apart
    texts = ["two  words\n\nand more ", "", None, " x"]
    ids, lengths = words.encode(pa.array(texts))
    rows = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert ids.tolist() == sum(rows, [])
    assert lengths.tolist() == list(map(len, rows))


def test_a_word_whose_hash_another_has_is_encoded_all_the_same():
    words, plain = dac.Words(PATH, 2), Tokenizer.from_file(PATH)
    words.encode(pa.array(["alpha beta"]))
    words.words.all[0] ^= 1
    assert words.encode(pa.array(["alpha beta"]))[0].tolist() == [*plain.encode("alpha beta", add_special_tokens=False).ids, 2]
    odd = ["alpha\x01 \x01 b\x01c x", "\x01", "The THE the. The, the... U.S. é. don't! end.. 3. x<|endoftext|>y. <|ENDOFTEXT|>. a.,", "Straße? ΑΣ, ﬁ;"]
    assert dac.Words(PATH, 2).encode(pa.array(odd))[0].tolist() == [x for t in odd for x in (*plain.encode(t, add_special_tokens=False).ids, 2)]


def test_one_doc_id_and_one_row_many_times_are_spread(spark):
    docs = spark.createDataFrame([(7, f"text {k % 40}") for k in range(400)] + [(9, "same")] * 400, "doc_id long, text string")
    files = dac.write_tokens(docs, PATH, 2, fresh_dir(spark, "spread"), 100)
    assert len({f[0].split("-")[-2] for f in files}) > 4
    assert max(f[1] for f in files) < 200
    assert sum(f[1] for f in files) == 800


def test_a_very_long_text(spark):
    text = "word12 other, " * 300_000
    docs = spark.createDataFrame([(1, "a"), (2, text), (3, "b")], "doc_id long, text string")
    found = sorted(map(tuple, dac.tokenise(docs, PATH, 2).collect()))
    assert found == expected([(1, "a"), (2, text), (3, "b")])


def test_no_rows(spark):
    assert dac.tokenise(nothing(spark), PATH, 2).count() == 0


def most_held(f):
    tracemalloc.start()
    f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_what_a_task_holds_is_small():
    """Arrays of words that are encoded at once, and of ids that are written."""
    words = dac.Words(PATH, 2)
    batch = pa.record_batch([pa.array([f"some words {k % 100} of a text " * 40 for k in range(5000)])], names=["text"])
    assert most_held(lambda: [len(words.encode(p.column(0))[0]) for p in textvec.pieces(batch, "text", min(dac.BYTES_PER_FILE, dac.PIECE_BYTES))]) < 50e6
    ids = np.full(2_000_000, 49_000, np.uint32)
    assert most_held(lambda: dac.levels(ids)) < 2.2 * ids.nbytes


def test_workers_are_given_batches_of_bounded_bytes(spark):
    dac.tokenise(documents(spark), PATH, 2).collect()
    sizes = lambda batches: (pa.record_batch([pa.array([b.nbytes])], names=["n"]) for b in batches)
    found = [r["n"] for r in spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 10000) AS text").mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 30_000_000 and max(found) < 1.5 * BATCH_BYTES
