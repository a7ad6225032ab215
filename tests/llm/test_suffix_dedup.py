import hashlib
import random
import re

import numpy as np

from corpusloom.llm import suffix_dedup
from tests.llm.tables import documents, nothing, sentence


def slow(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, words, strict=True):
        if doc is not None:
            for k in range(len(w) - 12):
                run = tuple(w[k : k + 13])
                first[run] = min(doc, first.get(run, doc))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {j for k in range(len(w) - 12) if doc is not None and first[tuple(w[k : k + 13])] < doc for j in range(k, k + 13)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def check(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect()), key=str) == sorted(slow(rows), key=str)


def test_matches_brute_force(spark):
    extra = [(None, documents(spark).first()["text"], "en", "s"), (-5, documents(spark).first()["text"], "en", "s"), (7, "another text under the same id " * 4, "en", "s"), (800, "word " * 60, "en", "s"), (801, "word " * 30, "en", "s")]
    check(spark, documents(spark).union(documents(spark, extra)))


def test_small_groups_buffers_and_bitmaps(spark, monkeypatch):
    """Prefixes of all lengths, several parts, many buffers, a bitmap that is full, and no broadcast of spans."""
    rng = random.Random(9)
    shared = [sentence(rng, 40) for _ in range(6)]
    rows = [(k, " ".join(rng.choice([sentence(rng, rng.randint(1, 30)), rng.choice(shared)]) for _ in range(4)), "en", "s") for k in range(80)]
    for name, value in (("GROUP", 300), ("BUFFER", 50), ("MOST_BITS", 4), ("SPAN_ROWS", 0)):
        monkeypatch.setattr(suffix_dedup, name, value)
    check(spark, documents(spark, rows))


def test_groups_cover_every_bucket():
    counts = np.zeros((3, 8), np.int64)
    counts[:, :4] = [suffix_dedup.GROUP * 2, 5, 7, 0]
    parts, n = suffix_dedup._groups(counts)
    assert parts[0].tolist()[0] == -1
    assert (parts[0][1:] >= 0).all()
    assert (parts[2] >= 0).all()
    assert n == parts.max() + 1


def test_deep_nodes_are_the_maximal_repeats():
    """Against brute force: prefixes of two suffixes or more that no longer common prefix has the same leaves as."""
    rng = np.random.default_rng(2)
    words = rng.integers(1, 3, (6, 60)).astype(np.uint32)
    words[4:, :9] = 0
    order, common = suffix_dedup.sorted_suffixes(words, 2)
    leaves = [tuple(x for x in words[:, i].tolist() if x) for i in order]
    assert leaves == sorted(leaves)
    by = {}
    for i, leaf in enumerate(leaves):
        for d in range(2, len(leaf) + 1):
            by.setdefault(leaf[:d], []).append(i)
    own = {p: tuple(v) for p, v in by.items() if len(v) > 1}
    expected = {(v[0], v[-1] + 1, len(p)) for p, v in own.items() if not any(own.get((*p, x)) == v for x in (1, 2))}
    assert set(map(tuple, suffix_dedup.deep_nodes(common, 2, 6).tolist())) == expected


def test_one_passage_in_most_documents_is_spread(spark, monkeypatch):
    """Results hold over many parts, and groups that share their first words go to parts of their own."""
    rng = random.Random(4)
    hot = " ".join(f"hot{k}" for k in range(400))
    rows = [(k, f"{sentence(rng, 20)} {hot if k % 3 else sentence(rng, 60)} {sentence(rng, 5)}", "en", "s") for k in range(120)]
    monkeypatch.setattr(suffix_dedup, "GROUP", 4000)
    monkeypatch.setattr(suffix_dedup, "BUFFER", 2000)
    check(spark, documents(spark, rows))
    counts = np.zeros((5, 16), np.int64)
    counts[:, 3] = 10 * suffix_dedup.GROUP
    counts[4, 3:13] = suffix_dedup.GROUP
    parts, n = suffix_dedup._groups(counts)
    assert n >= 10
    assert len(set(parts[4, 3:13].tolist())) == 10


def test_equal_labels_of_different_words_remove_nothing(spark, monkeypatch):
    """All windows share one label: only what is equal word by word is a repeat."""
    own = suffix_dedup.textvec.combine
    same = lambda h, width: own(h, width) * np.uint64(0) if width == suffix_dedup.WINDOW else own(h, width)
    monkeypatch.setattr(suffix_dedup.textvec, "combine", same)
    rows = [(k, "same " * 40 + f"p{k} " + " ".join(f"w{i}" for i in range(13 + k % 2 * 3)) + f" s{k} " + " ".join(f"v{k % 5}x{i}" for i in range(15)), "en", "s") for k in range(12)]
    docs = documents(spark, rows)
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    w = suffix_dedup.Suffixes(None, 16, 10, np.zeros((5, 1 << 10), np.int64), 1)
    marks = np.full(1 << 13, 255, np.uint8)
    batch = suffix_dedup.pa.record_batch([suffix_dedup.pa.array([g[0] for g in given]), suffix_dedup.pa.array([0] * len(given)), suffix_dedup.pa.array([g[1] for g in given])], names=["doc_id", "key", "text"])
    sent = list(w.combined([w.candidates(marks, batch)]))
    rows = [r for b in sent for r in suffix_dedup.Subtrees(1)(iter([b]))]
    gone = {(d, p) for b in rows for d, n, s in _spans_of(b) for a, e in s for p in range(a, e)}
    expected = {doc: slow([*((d, t) for d, t in given if d < doc), (doc, text)])[-1][2] for doc, text in given}
    assert {doc: sum(d == doc for d, _ in gone) for doc, _ in given} == expected


def _spans_of(batch):
    docs, counts, spans = (np.frombuffer(batch.column(k)[0].as_py(), t) for k, t in ((1, "<i8"), (3, "<u4"), (4, "<u4")))
    for d, n, s in zip(docs, counts, np.split(spans.reshape(-1, 2), np.cumsum(counts)[:-1]), strict=True):
        yield int(d), int(n), s.tolist()


def test_kept_text_and_no_rows(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    docs = documents(spark, [(1, passage, "en", "s"), (2, f"before {passage}\nafter", "en", "s")])
    assert {r["doc_id"]: r["kept_text"] for r in suffix_dedup.remove_repeats(docs, texts=True).collect()} == {1: passage, 2: "before after"}
    assert suffix_dedup.remove_repeats(nothing(spark)).count() == 0
