import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import hpylm
from tests.llm.tables import documents, nothing


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def test_base_columns_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hpylm, "PIECE", 500)
    docs = documents(spark).union(documents(spark, [(None, "no id", "en", "s")]))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(i), out(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    found = hpylm.score(docs).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == expected
    assert all(-math.inf < r["score"] < 0 for r in found)


def ids(k, held):
    """A doc_id from k's own hundred that is held out, or isn't."""
    return next(i for i in range(k * 100, k * 100 + 100) if (zlib.crc32(str(i).encode()) % 7 == 2) == held)


TRAIN = ["a b a c", "a b b", "c a b d", "b a c c", "d a b a b a b a c a b", "a b a c"]


@pytest.mark.parametrize("hot", [hpylm.HOT, 3])
def test_probabilities_of_every_context_sum_to_one(spark, monkeypatch, hot):
    """Over the vocabulary, its end included, and the unknown word; whole contexts and split ones, one piece and many."""
    monkeypatch.setattr(hpylm, "HOT", hot)
    monkeypatch.setattr(hpylm, "PART", hpylm.PART if hot > 3 else 8)
    monkeypatch.setattr(hpylm, "WORD_PART", hpylm.WORD_PART if hot > 3 else 2)
    words = ["a", "b", "c", "d", "zzz"]
    probes = [f"{u} {w}" for u in words for w in words] + words + [""]
    rows = [(ids(k, False), t, "en", "s") for k, t in enumerate(TRAIN)] + [(ids(100 + k, True), t, "en", "s") for k, t in enumerate(probes)]
    found = {r["doc_id"]: r for r in hpylm.score(documents(spark, rows), 1, 2, by_token=True).collect()}
    chance = {}
    for i, text, *_ in rows:
        row = found[i]
        assert sum(row["token_scores"]) == pytest.approx(row["score"])
        said = tokens(text)
        for u, w, x in zip(["begin", *said], said, row["token_scores"], strict=False):
            chance.setdefault((u, w), []).append(10**x)
    assert all(max(v) == pytest.approx(min(v)) for v in chance.values())
    for u in ["begin", *words]:
        assert sum(chance[u, w][0] for w in [*words, None]) == pytest.approx(1, abs=1e-6)
    assert chance["a", "b"][0] > chance["a", "d"][0] > chance["a", "zzz"][0] > 0


class Slow:
    """Customers sat down and taken away one at a time, in restaurants of lists of tables (Teh 2006)."""

    def __init__(self, texts, seed):
        self.rng = random.Random(seed)
        self.pairs = [p for t in texts for p in zip(["begin", *tokens(t)], tokens(t), strict=False)]
        self.base = 1 / (len({w for _, w in self.pairs}) + 1)
        self.house, self.at = {}, {}
        for k, (u, w) in enumerate(self.pairs):
            self.at[k] = self.sit(u, w)

    def chance(self, u, w):
        strength, discount = hpylm.PARENT if u is ... else hpylm.CONTEXT
        tables = self.house.get(u, {})
        guests, total = sum(sum(x) for x in tables.values()), sum(map(len, tables.values()))
        above = self.base if u is ... else self.chance(..., w)
        own = tables.get(w, [])
        return (sum(own) - discount * len(own) + (strength + discount * total) * above) / (strength + guests)

    def sit(self, u, w):
        strength, discount = hpylm.PARENT if u is ... else hpylm.CONTEXT
        tables = self.house.setdefault(u, {}).setdefault(w, [])
        above = self.base if u is ... else self.chance(..., w)
        fresh = (strength + discount * sum(map(len, self.house[u].values()))) * above
        weights = [x - discount for x in tables] + [fresh]
        k = self.rng.choices(range(len(weights)), weights)[0]
        if k == len(tables):
            tables.append(0)
            if u is not ...:
                self.sit(..., w)
        tables[k] += 1

    def leave(self, u, w):
        tables = self.house[u][w]
        k = self.rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            if u is not ...:
                self.leave(..., w)

    def sweep(self):
        for u, w in self.pairs:
            self.leave(u, w)
            self.sit(u, w)


def test_scores_match_a_sampler_that_moves_one_customer_at_a_time(spark):
    held = ["a b a", "c d zzz", "d d b c a", ""]
    slow, total = Slow(TRAIN, 1), Counter()
    for k in range(3300):
        slow.sweep()
        if k >= 300:
            for t in held:
                for u, w in zip(["begin", *tokens(t)], tokens(t), strict=False):
                    total[t, u, w] += slow.chance(u, w) / 3000 / sum((u, w) == p for p in zip(["begin", *tokens(t)], tokens(t), strict=False))
    rows = [(ids(k, False), t, "en", "s") for k, t in enumerate(TRAIN)] + [(ids(100 + k, True), t, "en", "s") for k, t in enumerate(held)]
    found = {r["doc_id"]: r["token_scores"] for r in hpylm.score(documents(spark, rows), 3, 30, by_token=True).collect()}
    for k, t in enumerate(held):
        expected = [math.log10(total[t, u, w]) for u, w in zip(["begin", *tokens(t)], tokens(t), strict=False)]
        assert found[ids(100 + k, True)] == pytest.approx(expected, abs=0.06)


@pytest.mark.parametrize("customers", [2, 10, 30, 64, 65, 1000])
@pytest.mark.parametrize("elsewhere", [0, 100, 1000])
def test_mean_tables_are_within_five_percent_of_the_exact_posterior(customers, elsewhere):
    """One dish beside other tables: weights S(c, t) * share**t * (strength)(strength + discount)... of all tables."""
    strength, discount, share = 1.0, 0.8, 0.1 if elsewhere else 0.3
    t = np.arange(1, customers + 1)
    weight = hpylm.stirling_table(discount)[customers, t] + t * math.log(share) + np.cumsum(np.log(strength + discount * (elsewhere + t - 1)))
    weight = np.exp(weight - weight.max())
    n = 300 if customers == 1000 else 3000
    tables, _ = hpylm.seat(np.full(n, customers), np.arange(n), np.full(n, share), strength, discount, 4, contexts=n, elsewhere=elsewhere, sweeps=40)
    assert tables.mean() == pytest.approx((weight * t).sum() / weight.sum(), rel=0.05)


def test_a_very_long_text_against_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(hpylm, "PIECE", 100)
    monkeypatch.setattr(hpylm, "PART", 50_000)
    rows = [(1, "w1 w2 w3 " * 100_000, "en", "s"), *((k, f"w1 w{k}", "en", "s") for k in range(2, 40))]
    found = {r["doc_id"]: r["n_tokens"] for r in hpylm.score(documents(spark, rows), 1, 1).collect()}
    assert found == {1: 300_001, **dict.fromkeys(range(2, 40), 3)}


def test_seating_is_within_bounds_and_close_to_the_exact_posterior():
    """Two customers of a dish: they sit apart with odds fresh : 1 - discount, fresh counted without them."""
    strength, discount, share = 1.0, 0.5, 0.4
    n = 20_000
    customers, context = np.full(n, 2), np.arange(n)
    tables, totals = hpylm.seat(customers, context, np.full(n, share), strength, discount, 1, contexts=n)
    assert ((tables >= 1) & (tables <= 2)).all()
    assert tables == pytest.approx(totals)
    fresh = (strength + discount * 1) * share
    assert tables.mean() - 1 == pytest.approx(fresh / (fresh + 1 - discount), abs=0.02)


def test_many_customers():
    rng = np.random.default_rng(0)
    t = hpylm.seat_many(np.array([100, 1000, 100_000]), np.array([0.01, 5.0, 1e4]), 0.8, rng)
    assert (t >= 1).all()
    assert t[0] < 4
    assert t[1] < 1000
    assert 1e4 < t[2] < 1e5
    tables, totals = hpylm.seat(np.array([1, 70, 3]), np.zeros(3, int), np.full(3, 0.1), 1.0, 0.8, 0)
    assert tables[0] == 1
    assert totals[0] == pytest.approx(tables.sum())


def test_repeated_pairs_beat_the_base_on_held_out_texts(spark):
    rows = [(i, f"the cat{i % 5} sat on the mat and the dog{i % 3} ran off", "en", "s") for i in range(300)]
    found = hpylm.perplexity(hpylm.score(documents(spark, rows))).collect()
    assert len(found) == 2
    assert all(r["perplexity"] < 0.5 * r["base_perplexity"] for r in found)


def test_no_rows(spark):
    assert hpylm.score(nothing(spark)).count() == 0


@pytest.mark.parametrize("customers", [2, 64, 65, 200])
@pytest.mark.parametrize("fresh", [0.05, 0.8, 2.0, 30.0])
def test_tables_of_any_number_of_customers_follow_the_exact_distribution(customers, fresh):
    """Weights by adding customers one by one: a table is opened with weight fresh, or one of the others joined."""
    d, weight = 0.8, np.zeros(customers + 2)
    weight[1] = fresh
    for c in range(1, customers):
        t = np.arange(len(weight))
        weight = fresh * np.append(0, weight[:-1]) + np.maximum(0, c - d * t) * weight
        weight /= weight.sum()
    mean = (weight * np.arange(len(weight))).sum() / weight.sum()
    found = hpylm.seat_many(np.full(4000, customers), np.full(4000, fresh), d, np.random.default_rng(1))
    assert found.mean() == pytest.approx(mean, abs=0.02 + 4 * found.std() / 4000**0.5)
    # In a restaurant with many other tables the weight hardly moves.
    tables, _ = hpylm.seat(np.full(1000, customers), np.zeros(1000, int), np.full(1000, fresh / d / 1e7), 1.0, d, 2, elsewhere=10_000_000)
    assert tables.mean() == pytest.approx(mean, rel=0.05)


def test_stirling_numbers_by_integral_are_those_of_the_table():
    for d in (0.5, 0.8):
        for c in (100, 700, hpylm.TABULATED):
            t = np.unique(np.geomspace(1, 0.9 * c, 40).astype(int)).astype(float)
            assert hpylm.log_stirling(c, t, d) == pytest.approx(hpylm.stirling_table(d)[c, t.astype(int)], abs=1e-6)
    assert hpylm.stirling_row(10**6, 2000, 6000, 0.8)[::500] == pytest.approx(hpylm.log_stirling(10**6, np.arange(2000.0, 6001, 500), 0.8), abs=1e-6)
