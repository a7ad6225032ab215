import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import textvec


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB é \n\t\x0b\x1c.中"), max_size=30)), max_size=8))
def test_words_are_those_of_bytes_split(rows):
    w = textvec.words(pa.array(rows, pa.string()))
    for k, text in enumerate(rows):
        found = [bytes(w.data[a:b]) for a, b in zip(w.start[w.at[k] : w.at[k + 1]], w.end[w.at[k] : w.at[k + 1]], strict=True)]
        assert found == (text or "").encode().split()


def test_equal_words_hash_alike_anywhere():
    one = textvec.words(pa.array(["x alpha", "beta alpha x", None, ""]))
    two = textvec.words(pa.array(["zz", "ALPHA"]).slice(1), lower=True)
    assert one.hashes[1] == one.hashes[3] == two.hashes[0]
    assert len(set(one.hashes.tolist())) == 3
    assert one.at.tolist() == [0, 2, 5, 5, 5]


def test_pieces_cover_the_batch():
    batch = pa.record_batch([pa.array(["a" * n for n in (5, 500, 1, 0, 40)])], names=["text"])
    assert [t for p in textvec.pieces(batch, "text", 50) for t in p.column(0).to_pylist()] == batch.column(0).to_pylist()
