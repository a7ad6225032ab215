import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from corpusloom.llm import components, simhash
from tests.llm.tables import documents, nothing


def slow_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_keys_of_neighbours_meet():
    code = simhash.golay()
    v = np.random.default_rng(3).integers(0, 1 << 23, 400)
    own = code.keys(v)
    assert (own[:, 0] >= 0).all()
    for bit in range(23):
        for a, b in zip(own, code.keys(v ^ (1 << bit)), strict=True):
            assert set(a[a >= 0]) & set(b[b >= 0])


def test_fuzzy_keys_meet_within_three_bits():
    rng = random.Random(4)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        keys = [set(simhash.fuzzy_keys(np.array([x], np.uint64).view(np.int64))[0].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(-200, 200), rng.randint(-200, 200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1100)]
    found = dict(map(tuple, components.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    root = {x: x for p in pairs for x in p}
    while True:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    assert found == {x: r for x, r in root.items() if x != r}


def test_no_links_no_components(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _expected(rows):
    fp = [slow_simhash(r[1]) for r in rows]
    label = list(range(len(rows)))
    near = [[j for j in range(len(rows)) if (fp[i] ^ fp[j]).bit_count() <= 3] for i in range(len(rows))]
    while True:
        new = [min(label[j] for j in near[i]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((rows[i][0], f"{fp[i]:016x}", min(ids, default=None)))
    return out


def test_query_matches_brute_force(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = rows[23][1]
    words = base.split()
    for k in range(8):
        words[k] = words[k] + "z"
        rows.append((100 + k, " ".join(words)))
    rows += [(None, base), (None, "only here and nowhere else"), (7, rows[7][1])]
    docs = documents(spark, [(*r, "en", "s") for r in rows])
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, simhash.digest(simhash.near_duplicates(docs)).collect()), key=key) == sorted(_expected(rows), key=key)


def test_keep_one_keeps_the_smallest_id_and_all_columns(spark):
    docs = documents(spark, [(5, "a b c d e", "en", "s"), (3, "a b c d e", "en", "s"), (3, "a b c d e", "en", "s"), (9, "quite another text here", "en", "s"), (None, "a b c d e", "en", "s"), (None, "alone with no id at all", "en", "s")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(3, "a b c d e"), (9, "quite another text here")] or sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(-1, "alone with no id at all"), (3, "a b c d e"), (9, "quite another text here")]


def jaccard(a, b, n=5):
    x, y = ({tuple(t[i : i + n]) for i in range(max(1, len(t) - n + 1))} for t in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_similar_texts_are_linked_and_others_are_not(spark):
    """Edited copies against brute force: recall at five-word similarities of 0.9 and 0.8, no clean text lost."""
    rng = random.Random(11)
    rows, pairs = [], []
    for k in range(150):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        copy = list(words)
        for i in rng.sample(range(len(copy)), rng.randint(0, len(copy) // 40 + 1)):
            copy[i] = f"e{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(words), "en", "s"), (2 * k + 1, " ".join(copy).upper() if k % 9 == 0 else " ".join(copy), "en", "s")]
        pairs.append((k, jaccard(rows[-2][1], rows[-1][1].lower())))
    rows += [(1000 + k, " ".join(f"c{rng.randrange(3000)}" for _ in range(rng.randint(10, 200))), "en", "s") for k in range(150)]
    kept = {r["doc_id"] for r in simhash.keep_one(documents(spark, rows)).collect()}
    assert {r[0] for r in rows if r[0] >= 1000 or r[0] % 2 == 0} <= kept
    for least, recall in ((0.9, 0.9), (0.8, 0.75)):
        near = [k for k, x in pairs if x >= least]
        assert len(near) > 30
        assert sum(2 * k + 1 not in kept for k in near) >= recall * len(near)
    assert all(2 * k + 1 in kept for k, x in pairs if x < 0.5)


def _edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_only_texts_of_similarity_08_go(spark):
    """Edited copies on both sides of the bound: none below it goes, and of those above it few are missed."""
    rng = random.Random(12)
    rows, near, far = [], [], []
    for k in range(300):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        copy = _edited(rng, words, rng.randint(1, len(words) // 20))
        rows += [(2 * k, " ".join(words), "en", "s"), (2 * k + 1, copy, "en", "s")]
        (near if jaccard(rows[-2][1], copy) >= 0.8 else far).append(2 * k + 1)
    kept = {r["doc_id"] for r in simhash.keep_one(documents(spark, rows)).collect()}
    assert len(near) > 80 and len(far) > 80
    assert set(far) <= kept
    assert sum(k not in kept for k in near) >= 0.9 * len(near)


def test_a_large_family_leaves_one(spark):
    """More texts than are compared in pairs, of which most are below 0.8 to each other but above it to the first."""
    rng = random.Random(13)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(k, _edited(rng, words, 3 if k else 0), "en", "s") for k in range(256)]
    rows += [(1000 + k, " ".join(f"c{rng.randrange(5000)}" for _ in range(100)), "en", "s") for k in range(50)]
    kept = {r["doc_id"] for r in simhash.keep_one(documents(spark, rows)).collect()}
    assert {r[0] for r in rows if r[0] >= 1000} <= kept
    assert len([k for k in kept if k < 1000]) <= 3


def test_verified_links_match_brute_force(spark, monkeypatch):
    """Short, empty and repeated texts too, whether or not a text of many links is dealt to several tasks."""
    rng = random.Random(14)
    base = [f"w{i}" for i in range(80)]
    texts = [_edited(rng, base, rng.randint(0, 5)) for _ in range(40)] + ["", " ", "one two", "One  two", "one two three", " ".join(base).upper()]
    texts = list(dict.fromkeys(texts))
    docs = documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts + texts[:9] + [None])])
    name = {r["text"]: r["fp"] for r in simhash._named(docs).collect()}
    pairs = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if a != b]
    links = [sorted((name[a], name[b])) for a, b in pairs]
    same = lambda a, b: a == b or (a and b and jaccard(a, b) >= 0.8)
    expected = {tuple(x) for x, (a, b) in zip(links, pairs, strict=True) if same(*(" ".join(t.lower().split()) for t in (a, b)))}
    assert 15 < len(expected) < len(links)
    for share in (simhash.SHARE, 4):
        monkeypatch.setattr(simhash, "SHARE", share)
        found = simhash.verified(spark.createDataFrame(links, "a long, b long"), docs).collect()
        assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_candidates_span_what_hangs_together():
    rng = np.random.default_rng(6)
    fp = rng.integers(0, 1 << 62, (60, 2)).astype(np.uint64)
    flips = np.packbits(rng.random((300, 128)) < 0.06, axis=1).view(np.uint64)
    few = fp[np.arange(300) % 60] ^ flips
    bits = np.bitwise_count(few[:, None] ^ few[None]).sum(axis=2)
    pairs = np.argwhere(np.triu(bits <= 32, 1))
    found = np.array(sorted({tuple(sorted(x)) for x in simhash.candidate_links(few, 32)}))
    assert (bits[found[:, 0], found[:, 1]] <= 32).all()
    assert all((a == b).all() for a, b in zip(components.forest(*found.T), components.forest(*pairs.T), strict=True))
    links = simhash.candidate_links(fp[:1] ^ flips, 32)
    assert len(links) <= 2 * 300
    assert len(components.forest(*np.array(links).T)[0]) == 299


def _family(rng, size, tag):
    """Loose copies: links at 0.8 hold between some of them only, and chains too."""
    words = [f"{tag}{rng.randrange(5000)}" for _ in range(120)]
    out = [" ".join(words)]
    while len(out) < size:
        out.append(_edited(rng, rng.choice(out).split(), 2))
    return out


def _roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize(("size", "families", "block"), [(5, 60, 1 << 14), (40, 8, 7), (400, 1, 1 << 14)])
def test_families_of_any_size_go_to_one_of_each_component(spark, monkeypatch, size, families, block):
    """Against the exact components at 0.8, over all pairs of each family; and what isn't one of them stays."""
    for name in ("MEMBERS", "QUERIES"):
        monkeypatch.setattr(simhash, name, block)
    rng = random.Random(size)
    made = [_family(rng, size, f"f{k}x") for k in range(families)]
    texts = [t for family in made for t in family]
    pairs = []
    for k in range(families):
        sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in made[k]]
        pairs += [(k * size + i, k * size + j) for i in range(size) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    root = _roots(len(texts), pairs)
    least = {r: min(k for k, x in enumerate(root) if x == r) for r in set(root)}
    should_go = {k for k, r in enumerate(root) if least[r] != k}
    kept = {r["doc_id"] for r in simhash.keep_one(documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])).collect()}
    gone = set(range(len(texts))) - kept
    assert gone <= should_go
    assert len(gone) >= 0.95 * len(should_go), (len(gone), len(should_go))


def test_all_pairs_of_different_parts_are_compared_in_the_end(spark, monkeypatch):
    """One cluster whose candidates all fail: the one link that holds is found all the same, over many blocks."""
    monkeypatch.setattr(simhash, "MEMBERS", 7)
    monkeypatch.setattr(simhash, "QUERIES", 5)
    rng = random.Random(3)
    n = 60
    fp = [int(x) for x in np.random.default_rng(1).permutation(10_000)[:n]]
    sets = [[rng.randrange(1 << 40) for _ in range(50)] for _ in range(n)]
    sets[41] = sets[17][:48] + [1, 2]
    monkeypatch.setattr(simhash, "near_links", lambda *a: spark.createDataFrame([tuple(sorted((fp[0], f))) for f in fp[1:]], "a long, b long"))
    monkeypatch.setattr(simhash, "shingle_sets", lambda *a: spark.createDataFrame(list(zip(fp, sets, strict=True)), "fp long, shingles array<long>"))
    assert [set(r) for r in simhash.similar_links(None, None).collect()] == [{fp[17], fp[41]}]


def test_extra_columns_may_have_any_name(spark):
    docs = documents(spark, [(3, "a b c d e", "en", "s"), (3, "f g h i j", "en", "s"), (3, "f g h i j", "en", "s")])
    docs = docs.withColumnsRenamed({"key": "again", "row": "Again_"})
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["text"] for r in kept.collect()) == ["a b c d e", "f g h i j"]


def test_margins_and_best_codewords_match_brute_force():
    texts = ["a b c d e f g A", "one two", "", None, "x " * 5000, "a b c d e f g a"]
    margin = simhash.margins(pa.array(texts, pa.string()), 5)
    assert (margin[2:4] == 0).all()
    assert (margin[0] == margin[5]).all()
    assert (np.abs(margin[4]) == 4996).all()
    assert (np.abs(margin[1]) == 1).all()
    signs = simhash.Codewords().signs
    row = np.random.default_rng(1).normal(size=(40, 23)).astype(np.float32)
    assert (simhash.Codewords().best(row) == np.argsort(-(row @ signs.T), axis=1)[:, :3]).all()
    # A code of distance seven with 4096 words.
    assert (23 - np.delete(signs @ signs[77], 77)).min() / 2 == 7


def test_large_groups_by_blocks_give_the_same_components():
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 1 << 62, (60, 1)).astype(np.uint64)
    fp = np.concatenate([fp ^ np.uint64(1 << int(b)) for b in rng.integers(0, 62, 40)])[:, :1]
    node = np.arange(len(fp))
    linker = simhash.Linker(3)
    whole = components.forest(*np.array(linker.group(node[:900], fp[:900])).T)
    linker.LARGE = 2
    parts = components.forest(*np.array(linker.group(node[:900], fp[:900])).T)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_empty_table(spark):
    assert simhash.near_duplicates(nothing(spark)).count() == 0
    assert simhash.keep_one(nothing(spark)).count() == 0
