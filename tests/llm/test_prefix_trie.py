import hashlib
import random
import zlib

from corpusloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, digest string, range int, pos int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2, 3) for r in rows], SCHEMA)


def ordered(rows):
    """Turns of each conversation in order, as (role, text)."""
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            g = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            by.setdefault(conv, []).append((turn is not None, turn or 0, g, role, text))
    return {c: [x[3:] for x in sorted(v)] for c, v in by.items()}


def spliced(by, family=5, most=8):
    out = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        base = by.get(c - (c % family if c >= 0 else -(-c % family)), [])
        out[c] = base[:h] + own[h:]
    return out


def slow(by):
    members = {}
    for c, turns in by.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(by[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], sha(p)) for p, m in members.items()), key=str)


def found(spark, rows, splice=True):
    table = conversations(spark, rows)
    if splice:
        nodes = prefix_trie.trie(*prefix_trie.spliced(prefix_trie.numbered(table), 5, 8))
    else:
        nodes = prefix_trie.conversation_trie(table)
    return sorted(map(tuple, prefix_trie.digest(nodes).collect()), key=str)


def example(seed, convs=60, most=9, words=3):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hé", "a b", "c" * 9][:words])) for c in range(convs) for t in range(rng.randint(1, most))]


def test_matches_brute_force(spark):
    rows = example(1)
    assert found(spark, rows) == slow(spliced(ordered(rows)))
    assert found(spark, rows, splice=False) == slow(ordered(rows))


def test_nulls_ties_repeated_rows_and_gaps(spark):
    rows = [(3, None, "user", "null turn first"), (3, 0, None, None), (3, 0, None, None), (3, 0, "user", "tie"), (7, 5, "user", ""), (7, 5, "", "user"), (None, 1, "user", "nobody's"), (-8, 1, "user", "x"), (-5, 0, "user", "x"), (-5, 1, "user", "y"), (1 << 40, 2, "system", "ünï"), (12, 0, "user", "a"), (13, 0, "user", "a")]
    assert found(spark, rows) == slow(spliced(ordered(rows)))
    assert found(spark, rows, splice=False) == slow(ordered(rows))
    # Role and text don't run into each other.
    assert len([r for r in found(spark, [(1, 0, "ab", "c"), (2, 0, "a", "bc")], splice=False) if r[1] == 1]) == 2


def test_long_conversations_over_many_blocks_and_ranges(spark, monkeypatch):
    """Shared prefixes beyond a block, hubs that are joined in several places, ids over many texts."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "SHARE", 2)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    rng = random.Random(3)
    rows = example(2, 40, 6, 2) + [(100 + c, t, "user", f"t{t}" if t < 23 + c % 3 else f"own{c % 2}") for c in range(12) for t in range(20 + c * 5)]
    rows += [(200, t, "user", rng.choice("ab")) for t in range(900)] + [(300 + c, 0, "user", f"first {c}") for c in range(30)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows) == slow(spliced(ordered(rows)))
        spread = prefix_trie.numbered(conversations(spark, rows)).filter("conv_id = 200").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["range"] for r in spread}) > 1
    assert sorted(r["pos"] for r in spread) == list(range(1, 901))


def test_no_conversations(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 0, "user", "x")]) == []
