import hashlib
import random

import numpy as np
import pytest

from corpusloom.llm import bwt_dedup, textvec
from tests.llm.tables import documents, nothing, sentence

L = bwt_dedup.LENGTH


def slow(rows):
    bodies = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in bodies:
        for i in range(len(b) - L + 1):
            seen[b[i : i + L]] = seen.get(b[i : i + L], 0) + 1
    out = []
    for (doc, _), b in zip(rows, bodies, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - L + 1):
            if seen[b[i : i + L]] > 1:
                gone[i : i + L] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((doc, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = sorted(slow(rows), key=str)
    assert sorted(map(tuple, bwt_dedup.remove_repeats(docs).collect()), key=str) == expected
    return expected


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(99)}"
    return " ".join(words)


def rows(seed, families=8, copies=5):
    rng = random.Random(seed)
    out = []
    for _ in range(families):
        base = sentence(rng, rng.randint(90, 260))
        out += [edited(rng, base, rng.randint(0, 4)) for _ in range(copies)]
        out += [sentence(rng, 30) + base[: rng.randint(100, 900)] + sentence(rng, 30)]
    out += ["ab" * 700, "é" * 450, "x" * 399, "x" * 400, "y" * 401, "same words again " * 60, out[0], out[0]]
    return [(k, t, "en", "s") for k, t in enumerate(out)]


def test_matches_brute_force(spark):
    extra = [(None, rows(3)[0][1], "en", "s"), (None, rows(3)[0][1], "en", "s"), (1, "shared id " + rows(3)[7][1], "en", "s")]
    expected = check(documents(spark).union(documents(spark, rows(3) + extra)))
    assert sum(r[2] > 0 for r in expected) > 30


@pytest.mark.parametrize("group", [1, 4])
def test_large_groups_by_longer_anchors_and_small_parts(spark, monkeypatch, group):
    """Every way to deal stretches, several parts, pieces of long texts, hubs, and no broadcast of spans."""
    for name, value in (("GROUP", group), ("PART", 20_000), ("PIECE", 1500), ("SPAN_ROWS", 0)):
        monkeypatch.setattr(bwt_dedup, name, value)
    own = bwt_dedup.hub_join
    monkeypatch.setattr(bwt_dedup, "hub_join", lambda *a, **k: own(*a, share=2, **k))
    check(documents(spark, rows(4, 5)))


def test_a_passage_in_most_documents(spark, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "GROUP", 10)
    rng = random.Random(5)
    hot = sentence(rng, 80)[:430]
    assert len(hot) == 430
    docs = [(k, f"{sentence(rng, 40)} {hot if k % 3 else ''}{sentence(rng, 20 + k % 7)}", "en", "s") for k in range(90)]
    expected = check(documents(spark, docs))
    assert sum(r[2] >= 430 for r in expected) == 60


def random_pieces(seed, letters, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(97, 97 + letters, 200).astype(np.uint8)
    return [(base[rng.integers(0, 99) :][: rng.integers(1, 90)] if rng.random() < 0.6 else rng.integers(97, 97 + letters, rng.integers(1, 60)).astype(np.uint8)).tobytes() for _ in range(n)]


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_expansion_gives_the_common_prefixes(letters):
    """Open boundaries and suffixes against a plain suffix array, for many least lengths."""
    pieces = random_pieces(letters, letters, 30)
    for least in (1, 2, 3, 7, 8, 20, 40):
        seen = {}
        for k, p in enumerate(pieces):
            for i in range(len(p) - least + 1):
                seen.setdefault(p[i : i + least], []).append((k, i))
        expected = {x for v in seen.values() if len(v) > 1 for x in v}
        assert {(k, int(i)) for k, found in enumerate(bwt_dedup.repeated(pieces, least)) for i in found} == expected


def test_large_intervals_by_ranks():
    """Intervals of more suffixes than are looked at one by one."""
    rng = np.random.default_rng(3)
    piece = rng.integers(97, 99, 4000).astype(np.uint8).tobytes()
    starts = {}
    for i in range(len(piece) - 8):
        starts.setdefault(piece[i : i + 9], []).append(i)
    assert set(bwt_dedup.repeated([piece], 9)[0].tolist()) == {i for v in starts.values() if len(v) > 1 for i in v}


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 100, 1500).astype(np.uint8)
    two = np.concatenate([body, rng.integers(97, 100, 77).astype(np.uint8), body])
    text, start, n, off, h = bwt_dedup._stretches(two, np.array([0, len(body), len(two)]))
    by = {}
    for t, s, k, o, key in zip(text, start, n, off, h, strict=True):
        for w in range(k):
            by[int(s + w)] = (int(o - w), int(key))
        assert s + k - 1 + L <= (len(body), len(two))[t]
    assert len(by) == len(body) - L + 1 + len(body) + 77 - L + 1
    assert all(by[i] == by[i + len(body) + 77] for i in range(len(body) - L + 1))
    assert (textvec.grams(two, 32)[:100] == textvec.grams(two, 32)[len(body) + 77 :][:100]).all()


def test_kept_bytes_and_no_rows(spark):
    passage = "é" * 300
    docs = documents(spark, [(1, passage, "en", "s"), (2, f"before {passage}after", "en", "s")])
    assert {r["doc_id"]: bytes(r["kept_bytes"]) for r in bwt_dedup.remove_repeats(docs, bodies=True).collect()} == {1: b"", 2: b"before after"}
    assert bwt_dedup.remove_repeats(nothing(spark)).count() == 0


def test_tasks_do_several_parts(spark, monkeypatch):
    """Small parts, several to a task: none is mixed up with the next one of its task."""
    monkeypatch.setattr(bwt_dedup, "PART", 4000)
    monkeypatch.setattr(bwt_dedup, "PARTS", 5)
    check(documents(spark, rows(11)))
    assert bwt_dedup.PART * bwt_dedup.PARTS <= 1 << 20
