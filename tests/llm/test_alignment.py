import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from corpusloom.llm import alignment, textvec
from tests.llm.tables import documents, nothing, sentence

A = (alignment.ByteTokens, public_tokenizers.path("byte_bpe_50k.json"))
B = (alignment.PieceTokens, public_tokenizers.path("piece_bpe_32k.model"))


def slow(rows):
    """Whole texts through both tokenizers, groups by common ends, pairs one by one."""
    a, b = (kind(path) for kind, path in (A, B))
    found = []
    for doc, text in rows:
        groups = []
        if text:
            spaced = " " + text
            sides = []
            for t in (a, b):
                ids = t.ids([spaced])[0]
                sides.append((ids, np.cumsum([len(t.bytes[i]) for i in ids]).tolist(), b"".join(t.bytes[i] for i in ids)))
            if sides[0][2] == sides[1][2] == spaced.encode():
                cuts = sorted({*sides[0][1]} & {*sides[1][1]})
                for low, high in zip([0, *cuts], cuts, strict=False):
                    groups.append(tuple([i for i, e in zip(s[0], s[1], strict=True) if low < e <= high] for s in sides))
        found.append((doc, groups))
    links = [Counter((x, y) for p, q in groups for x in p for y in q) for _, groups in found]
    count = Counter(pair for own in links for pair in own)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for (doc, groups), own in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        best = sum(n for (x, y), n in own.items() if count[x, y] == most[x])
        out.append((doc, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(own.values()), best, sum(n * count[x] for x, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


ODD = ["don't stop", "  two  blanks  ", "x ", " ", "\n\n a\r\n b\t c\r", "a  b　 c  d\u0085 e", "▁ mark", "nul \x00 byte", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 テキスト 123 4567", "é 🙂🙂 x", "1 234 5678  90", "foo;\r bar {\r }\r", "a" * 300, "tab\t \ttab", "​ zero", "»« „quote“ …", "http://a.b/c?d=e&f  (x) [y] {z}"]


def check(docs, texts=False):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = sorted(map(tuple, alignment.align(docs, A, B).collect()), key=str)
    assert found == sorted(slow(rows), key=str)
    return found


def test_matches_brute_force(spark):
    extra = [(500 + k, t, "en", "s") for k, t in enumerate(ODD)] + [(None, "no id", "en", "s"), (None, "no id", "en", "s"), (500, "shared id", "en", "s")]
    found = check(documents(spark).union(documents(spark, extra)))
    assert sum(r[1] > 0 for r in found) > 30
    assert {r[0] for r in found if r[0] and r[0] >= 500 and not r[1]} == {506}


@pytest.mark.parametrize("block", [1, 400])
def test_many_blocks_and_hubs(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "CHUNK", 7)
    own = alignment.hub_join
    monkeypatch.setattr(alignment, "hub_join", lambda *a, **k: own(*a, share=2, **k))
    rng = random.Random(2)
    check(documents(spark, [(k, rng.choice([sentence(rng, 20), rng.choice(ODD) + " " + sentence(rng, 5)]), "en", "s") for k in range(60)]))


def test_without_cuts_the_text_is_one_unit(spark, monkeypatch):
    monkeypatch.setattr(alignment.PieceTokens, "cuts", staticmethod(lambda path: False))
    check(documents(spark, [(k, t, "en", "s") for k, t in enumerate([*ODD, "same", "same", "", None])]))


def test_units_have_the_tokens_that_they_have_in_the_text():
    """Random strings of what is hard to cut."""
    rng = random.Random(1)
    both = [kind(path) for kind, path in (A, B)]
    parts = [" ", "  ", "\n", "\r", "\t", "a", "é", "日", "1", "'s", ".", ";", " ", "　", " ", "́", "🙂", "the", "Ünd"]
    for _ in range(3000):
        text = " " + "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        data = np.frombuffer(text.encode(), np.uint8)
        start = alignment.unit_starts(data, np.array([0, len(data)]), True).tolist()
        units = [bytes(data[i:j]).decode() for i, j in zip(start, [*start[1:], len(data)], strict=True)]
        for t in both:
            assert sum(t.ids(units), []) == t.ids([text])[0], repr(text)


def test_blocks_hold_the_texts(spark):
    docs = documents(spark)
    row = docs.collect()
    coder = alignment.Coder(True, spark.createDataFrame([], "block long, code int, unit string, doc_id long, n int, codes binary").schema, 1 << 20)
    batch = alignment.pa.record_batch([alignment.pa.array([r["doc_id"] for r in row]), alignment.pa.array([r["text"] for r in row])], names=["doc_id", "text"])
    out = alignment.pa.Table.from_batches(list(coder.coded([batch], 5))).to_pylist()
    units = [r["unit"] for r in out if r["code"] is not None]
    assert len(set(units)) == len(units)
    held = [r for r in out if r["code"] is None]
    texts = ["".join(units[k] for k in np.frombuffer(alignment.pa.decompress(r["codes"], 4 * r["n"], "zstd", asbytes=True), "<i4")) if r["n"] else "" for r in held]
    assert texts == [" " + r["text"] if r["text"] else "" for r in row]
    assert textvec.resident() > 0


def test_groups_as_text_and_no_rows(spark):
    found = alignment.align(documents(spark, [(1, "hello world", "en", "s"), (2, None, "en", "s")]), A, B, texts=True).collect()
    assert {r["doc_id"]: r["groups"].count(";") + 1 if r["groups"] else 0 for r in found} == {r["doc_id"]: r["n_groups"] for r in found}
    assert alignment.align(nothing(spark), A, B).count() == 0


def test_runs_have_the_tokens_that_their_units_have():
    """Units encoded together, some of which aren't their tokens' bytes: these alone have none."""
    rng = random.Random(4)
    both = [alignment.vocabulary(*made) for made in (A, B)]
    units = [" " + rng.choice([sentence(rng, 1).strip(), "▁mark", "x▁", "日本語", "tab\t", "é", ";", "line\nbreak", "don't"]) for _ in range(2000)]
    data = np.frombuffer("".join(units).encode(), np.uint8)
    at = np.append(0, np.cumsum([len(u.encode()) for u in units]))
    found, ok = alignment.unit_tokens(data, at, both, True)
    alone = [[v.encoded([u]) for u in units] for v in both]
    good = [all(side[k][1][0] for side in alone) for k in range(len(units))]
    assert ok.tolist() == good and 0 < sum(good) < len(units)
    for own, side in zip(found, alone, strict=True):
        assert own.tolist() == [i for (ids, _), g in zip(side, good, strict=True) if g for i in ids[0].tolist()]


def test_no_table_has_a_row_for_each_unit(spark, monkeypatch):
    """What goes between tasks grows with documents and pairs: with neither tokens nor the corpus's units."""
    rng = random.Random(5)
    rows = [(k, " ".join(str(rng.randrange(10**8, 10**9)) for _ in range(400)), "en", "s") for k in range(300)]
    made, own = [], alignment.materialise
    monkeypatch.setattr(alignment, "materialise", lambda df, name: made.append(own(df, name)) or made[-1])
    assert alignment.align(documents(spark, rows).coalesce(2), A, B).count() == len(rows)
    assert len({w for _, t, _, _ in rows for w in t.split()}) > 115_000
    assert len(rows) < sum(df.count() for df in made) < 100_000
