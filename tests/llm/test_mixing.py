import re
from collections import defaultdict

import pytest

from corpusloom.llm import mixing
from tests.llm.tables import documents, nothing


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def slow_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    open_, left = set(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            for s in open_:
                target[s] = weight[s] * level
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_matches_brute_force(spark):
    docs = documents(spark)
    size = defaultdict(int)
    for r in docs.collect():
        size[r["source"]] += words(r["text"])
    target = slow_targets(size)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)


def test_stage_repeats_rows_as_the_mix_says(spark):
    docs = documents(spark)
    out = mixing.repeat_rows(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in mixing.mix(docs).collect())


def test_one_id_for_all_rows_and_words_for_none(spark):
    same = documents(spark, [(None, "a b c", "en", "s")] * 5)
    assert {r["copies"] for r in mixing.mix(same).collect()} <= {1, 2}
    empty = documents(spark, [(1, None, "en", "s"), (2, "", "en", None)])
    assert all(r["taken"] == 0 and r["target"] == 0 for r in mixing.mix(empty).collect())
    assert mixing.mix(nothing(spark)).count() == 0
    assert mixing.repeat_rows(nothing(spark)).count() == 0
