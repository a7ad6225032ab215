import math
import random
import re
import zlib

import pyarrow as pa

from corpusloom.llm import toxicity
from tests.llm.tables import documents, nothing, sentence


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    rows = [(k, sentence(rng, 40) + (" utterly vile rubbish" if k % 4 == 0 else ""), "en", "s") for k in range(1200)]
    docs = documents(spark, rows)
    weights = toxicity.fit(docs, labels(spark, [(k, 1, int(k % 4 == 0)) for k in range(1200)]))
    assert len(weights) < 2000
    found = toxicity.score(docs, weights).collect()
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in range(1200) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = documents(spark)
    known = [(k, 1, k % 2) for k in range(40)]
    turned = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, q, t in known]
    assert toxicity.fit(docs, labels(spark, known)) == toxicity.fit(docs, labels(spark, turned))


def test_odd_rows_and_labels(spark):
    docs = documents(spark).union(documents(spark, [(None, "no id", None, None)]))
    known = labels(spark, [(1, 1, 1), (1, 1, 0), (2, 0, 0), (None, 1, 1), (3, 1, None), (4, 1, 1), (6, 1, 0)])
    found = toxicity.score(docs, toxicity.fit(docs, known)).collect()
    assert len(found) == docs.count()
    assert len({r["score"] for r in found if r["doc_id"] in (29, 30, 31)}) == 1
    for none in (labels(spark, []), labels(spark, [(1, 1, 0)])):
        weights = toxicity.fit(docs, none)
        assert list(weights) == [1 << toxicity.BITS]
    assert toxicity.score(nothing(spark), weights).count() == 0


def test_features_stay_in_their_text():
    text, at = toxicity.features(pa.array(["a b c", "", None, "c"]))
    assert text.tolist().count(0) == 3 + 2 + 1
    assert text.tolist().count(3) == 1
    assert len(at) == len(text)


def test_score_by_brute_force(spark):
    docs = documents(spark)
    weights = {int(c): 0.1 * (k % 7 - 3) for k, c in enumerate(toxicity.features(pa.array([docs.first()["text"]]))[1][:40])} | {1 << toxicity.BITS: -0.2}
    for r in toxicity.score(docs, weights).collect():
        text = next(x["text"] for x in docs.collect() if x["doc_id"] == r["doc_id"])
        own = set(toxicity.features(pa.array([text], pa.string()))[1].tolist())
        total = sum(w for c, w in weights.items() if c in own or c == 1 << toxicity.BITS)
        assert abs(r["score"] - 1 / (1 + 2.718281828459045 ** -total)) < 1e-9


class Plain:
    """FTRL-proximal by the published formulas, on dictionaries, for one example at a time."""

    def __init__(self):
        self.z, self.n = {}, {}

    def weight(self, c):
        z, n = self.z.get(c, 0.0), self.n.get(c, 0.0)
        l1 = 0.0 if c == 1 << toxicity.BITS else toxicity.L1
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((toxicity.BETA + math.sqrt(n)) / toxicity.RATE + toxicity.L2)

    def learn(self, own, label):
        w = {c: self.weight(c) for c in own}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for c in own:
            n = self.n.get(c, 0.0)
            self.z[c] = self.z.get(c, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / toxicity.RATE * w[c]
            self.n[c] = n + g * g


def pairs_of(text):
    """Features by their names: words, neighbours, and pairs with one word between."""
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {*((1, x) for x in w), *((g + 1, a, b) for g in (1, 2) for a, b in zip(w, w[g:], strict=False))}


def test_fit_by_brute_force(spark):
    rng = random.Random(9)
    rows = [(k, sentence(rng, 25) + (" utterly vile rubbish" if k % 3 == 0 else ""), "en", "s") for k in range(200)]
    docs = documents(spark, rows + rows[:20])
    weights = toxicity.fit(docs, labels(spark, [(k, 1, int(k % 3 == 0)) for k in range(200)]))
    known = [r for r in (rows + rows[:20]) if zlib.crc32(str(r[0]).encode()) % 5]
    order = {r["doc_id"]: r["o"] for r in docs.selectExpr("doc_id", "xxhash64(doc_id) o").collect()}
    model = Plain()
    for _ in range(toxicity.EPOCHS):
        for r in sorted(known, key=lambda r: order[r[0]]):
            own = pairs_of(r[1])
            model.learn([*own, 1 << toxicity.BITS], int(r[0] % 3 == 0))
    names = {x for r in known for x in pairs_of(r[1])}
    expected = sorted(round(w, 6) for c in names if (w := model.weight(c)))
    found = sorted(round(w, 6) for c, w in weights.items() if c != 1 << toxicity.BITS)
    assert found == expected
    counted = {r[0]: r[0] % 3 == 0 for r in known}
    toxic, clean = sum(counted.values()), len(counted) - sum(counted.values())
    assert abs(weights[1 << toxicity.BITS] - model.weight(1 << toxicity.BITS)) < 1e-6
    assert toxic < clean


def test_large_samples_are_thinned_by_hash(spark, monkeypatch):
    rng = random.Random(2)
    docs = documents(spark, [(k, sentence(rng, 30), "en", "s") for k in range(300)])
    known = labels(spark, [(k, 1, k % 2) for k in range(300)])
    whole = toxicity.fit(docs, known)
    monkeypatch.setattr(toxicity, "MOST_FEATURES", 5000)
    assert toxicity.fit(docs, known) == toxicity.fit(docs.repartition(3), known) != whole
