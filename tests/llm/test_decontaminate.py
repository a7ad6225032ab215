import random
import re

import pyarrow as pa

from corpusloom.llm import decontaminate, textvec
from tests.llm.tables import documents, nothing


def invented(rng, n):
    return [rng.choice("the of and to in".split()) if rng.random() < 0.4 else f"w{rng.randrange(4000)}" for _ in range(n)]


def edited(rng, words, k):
    out = list(words)
    for _ in range(k):
        i = rng.randrange(len(out))
        what = rng.randrange(3)
        if what == 0:
            out[i] = f"e{rng.randrange(10**6)}"
        elif what == 1:
            del out[i]
        else:
            out.insert(i, f"e{rng.randrange(10**6)}")
    return out


def distance(item, doc):
    row = [0] * (len(doc) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(doc):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_recall_and_precision_against_brute_force(spark):
    rng = random.Random(8)
    items = [(k, " ".join(invented(rng, rng.randint(10, 40)))) for k in range(30)]
    rows = []
    for k in range(150):
        body = invented(rng, rng.randint(20, 80))
        if k % 2:
            item = words(items[k % 30][1])
            body += edited(rng, item, rng.randint(0, len(item) // 5 + 1)) + invented(rng, 10)
        rows.append((k, " ".join(body).capitalize() + ".", "en", "s"))
    docs, known = documents(spark, rows), benchmark(spark, items)
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.leaks(docs, known).collect()}
    exact = {(d, i): e for d, t, *_ in rows for i, x in items if (e := distance(words(x), words(t))) <= decontaminate.most_edits(len(words(x)))}
    assert set(found) <= set(exact)
    assert all(found[p] == exact[p] for p in found)
    assert len(found) >= 0.95 * len(exact)
    assert all(p in found for p, e in exact.items() if e == 0)
    clean = decontaminate.without_leaks(docs, known)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in found}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(1)
    items = [(k, " ".join(invented(rng, 20))) for k in range(12)]
    docs = documents(spark, [(k, " ".join(invented(rng, 20)) + " " + items[k % 12][1], "en", "s") for k in range(24)])
    known = benchmark(spark, items)
    whole = sorted(map(tuple, decontaminate.leaks(docs, known).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    assert sorted(map(tuple, decontaminate.leaks(docs, known).collect())) == whole
    assert decontaminate.without_leaks(docs, known).count() == 0


def test_odd_rows(spark):
    known = benchmark(spark, [(1, "Two Words"), (2, None), (3, ""), (4, " .,! "), (None, "one"), (5, "one two three four five six seven eight"), (5, "one two three four five six seven eight")])
    docs = documents(spark).union(documents(spark, [(None, "so ONE, two three four five six; seven eight.", None, None)] * 2))
    found = decontaminate.leaks(docs, known).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["edits"]) for r in found) == [("33", 1, 0), ("None", 5, 0), ("None", 5, 0)]
    assert decontaminate.without_leaks(docs, known).count() == docs.count() - 3


def test_nothing_on_either_side(spark):
    some = benchmark(spark, [(1, "a b c d e f g h")])
    assert decontaminate.leaks(nothing(spark), some).count() == 0
    assert decontaminate.leaks(documents(spark), benchmark(spark, [])).count() == 0
    assert decontaminate.without_leaks(documents(spark), benchmark(spark, [])).count() == documents(spark).count()


def test_texts_that_share_an_id_are_all_searched(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(invented(rng, 20)) for _ in range(6)]
    known = benchmark(spark, [(k % 2, t) for k, t in enumerate(texts)])
    docs = documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    for most in (decontaminate.BLOCK_CHARS, 200):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", most)
        assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.leaks(docs, known).collect()) == [(k, k % 2, 0) for k in range(6)]
        assert decontaminate.without_leaks(docs, known).count() == 0


def test_windows_with_repeated_words_are_not_passed_over():
    """Exact copies and copies at the edit bound of items that repeat a word; every match has a window at it."""
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(8, 40)
        same = ["0"] * rng.randint(4, n)
        item = same + invented(rng, n - len(same))
        for k in (0, decontaminate.most_edits(n)):
            copy = list(item)
            for i in rng.sample(range(n), k):
                copy[i] = f"e{i}"
            text = " ".join(invented(rng, 12) + copy + invented(rng, 12))
            items = decontaminate.Items([1], [" ".join(item)])
            w = textvec.words(pa.array([text]), lower=True, separator=textvec.PUNCTUATION)
            start, end, size = items.windows(w.hashes, w.at)
            assert 12 in start.tolist()
            assert len(set(start.tolist())) == len(start)
            if not k:
                assert [r[2] for r in decontaminate.Finder(None, True).found(items, pa.array([text]), False)] == [0]


def test_a_very_long_text(spark):
    rng = random.Random(12)
    item = " ".join(invented(rng, 30))
    long = " ".join(invented(rng, 300_000))
    docs = documents(spark, [(1, f"{long} {item}", "en", "s"), (2, long, "en", "s"), (3, item, "en", "s")])
    known = benchmark(spark, [(7, item)])
    found = {r["doc_id"]: r for r in decontaminate.leaks(docs, known).collect()}
    assert set(found) == {1, 3} and all(r["edits"] == 0 for r in found.values())
    assert abs(found[1]["start_word"] - 300_000) < 30
    assert [r["doc_id"] for r in decontaminate.without_leaks(docs, known).collect()] == [2]


def test_windows_are_walked_in_parts(monkeypatch):
    """What is walked at once is bounded, and parts find what the whole finds."""
    rng = random.Random(8)
    texts = [" ".join(invented(rng, 40)) for _ in range(20)]
    items = decontaminate.Items(list(range(20)), texts)
    w = textvec.words(pa.array([f"{' '.join(invented(rng, 30))} {t} tail" for t in texts]), lower=True, separator=textvec.PUNCTUATION)
    whole, own, most = items.candidates(w.hashes, w.at), decontaminate.walk, []
    monkeypatch.setattr(decontaminate, "WINDOWS", 7)
    monkeypatch.setattr(decontaminate, "walk", lambda symbols, start, *a: most.append(len(start)) or own(symbols, start, *a))
    parts = items.candidates(w.hashes, w.at)
    assert len(whole[0]) and all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert max(most) <= 7
