"""Documents that contain benchmark items, by CGK embedding and bit-sampling LSH, then exact edit verification.

Words are lower-cased runs of letters and digits. A document contains an item of n words if some passage of it is
within floor((1 - SIMILARITY) * n) word edits of the item; items of fewer than FEW words must occur word for word.

The CGK walk (Chakraborty, Goldenberg and Koucky, 2016) maps edit distance to Hamming distance: step j writes the
current word and goes on to the next if a random bit of (j, word) is one. Windows of an item's size at every place of
a document are embedded by the item's walks; each LSH table compares a few sampled steps of a walk. Several walks with
several tables each reach the target recall. What meets in a table is verified by an exact semi-global edit distance.

Windows that cannot match are not walked: a passage within k edits shares at least n - q + 1 - k * q of the item's
q-word runs, so windows with fewer runs known from any item are passed over. Every run counts, one that equals the
one before it too, so that nothing is lost; one run less is asked for, which gives the walks a few windows more.

The benchmark is processed in blocks of at most BLOCK_CHARS characters, each sent to the executors whole.

Defined results: null and empty texts contain nothing, null and empty items are in nothing; repeated rows each get
their rows; an item is its id and text, so that texts under one id get a row each; items without an id are in nothing;
an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import textvec
from corpusloom.llm.common import bounded_batches

SIMILARITY = 0.8
FEW = 5
WALKS, TABLES, SAMPLES = 8, 8, 3
SEED = 7
BLOCK_CHARS = 8_000_000
#: Windows that are walked at once: each step of each is eight bytes.
WINDOWS = 1 << 14
_U = np.uint64


def most_edits(n: int) -> int:
    return 0 if n < FEW else n * round(100 - 100 * SIMILARITY) // 100


def run_length(n: int) -> int:
    """The longest run, of at most three words, whose count bound stays above one, or else above zero."""
    k = most_edits(n)
    return next((q for q in (3, 2, 1) if n - q + 1 - k * q >= 2), 1)


def walk(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK: a row of ``steps`` symbols for each window start to end; 0 beyond a window's end."""
    out = np.zeros((steps, len(start)), np.uint64)
    at = start.copy()
    padded = np.append(symbols, _U(0))
    for j in range(steps):
        here = np.where(at < end, padded[np.minimum(at, len(symbols))], _U(0))
        out[j] = here
        with np.errstate(over="ignore"):
            bit = textvec.mix64(here + _U((seed * 1_000_003 + j) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & _U(1)
        at += bit.astype(np.int64)
    return out


_SPOTS = np.random.default_rng(SEED).random((WALKS, TABLES, SAMPLES))


def table_keys(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """The LSH keys of each window, a table at a time. A window of an item's size n is sampled from its first 2 * n
    steps, at the same parts of them for every n; end may cut a window off."""
    steps = 2 * int(size.max(initial=0))
    column = np.arange(len(start))
    for w in range(WALKS):
        rows = walk(symbols, start, end, steps, SEED + w)
        for t in range(TABLES):
            key = size.astype(np.uint64)
            with np.errstate(over="ignore"):
                for spot in _SPOTS[w, t]:
                    key = textvec.mix64(key * _U(0x9E3779B97F4A7C15) + rows[(spot * 2 * size).astype(np.int64), column])
            yield key


def best_match(item: np.ndarray, passage: np.ndarray) -> int:
    """Word edits between the item and the part of the passage that is nearest to it."""
    row = np.zeros(len(passage) + 1, np.int64)
    steps = np.arange(len(passage) + 1)
    for i, word in enumerate(item):
        below = np.empty_like(row)
        below[0] = i + 1
        below[1:] = np.minimum(row[:-1] + (passage != word), row[1:] + 1)
        row = np.minimum.accumulate(below - steps) + steps
    return int(row.min())


class Items:
    """A block of items with their tables, by length."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        w = textvec.words(pa.array(texts, pa.string()), lower=True, separator=textvec.PUNCTUATION)
        self.ids = ids
        #: By place in the block: several texts may share an id.
        self.words = {i: w.hashes[a:b] for i, (a, b) in enumerate(zip(w.at[:-1], w.at[1:], strict=True)) if b > a}
        by_length: dict[int, list[int]] = {}
        for i, x in self.words.items():
            by_length.setdefault(len(x), []).append(i)
        self.lengths = sorted(by_length)
        self.runs = {}
        for q in {run_length(n) for n in self.lengths}:
            self.runs[q] = np.unique(np.concatenate([textvec.combine(x, q) for x in self.words.values() if run_length(len(x)) == q]))
        self.runs_of = {n: np.unique(np.concatenate([textvec.combine(self.words[i], run_length(n)) for i in by_length[n]])) for n in self.lengths}
        members = [i for n in self.lengths for i in by_length[n]]
        symbols = np.concatenate([self.words[i] for i in members]) if members else np.zeros(0, np.uint64)
        size = np.array([len(self.words[i]) for i in members], np.int64)
        start = np.cumsum(size) - size
        self.tables = [(np.sort(k), np.array(members)[np.argsort(k, kind="stable")]) for k in table_keys(symbols, start, start + size, size)]

    def windows(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, size) of the windows that the run bound leaves, for the items of each length by themselves."""
        spots = {}
        for q, runs in self.runs.items():
            known = textvec.combine(h, q)
            if len(known):
                known_at = np.minimum(np.searchsorted(runs, known), len(runs) - 1)
                spot = np.flatnonzero(runs[known_at] == known)
                text = np.searchsorted(at, spot, "right") - 1
                whole = spot + q <= at[text + 1]
                spots[q] = spot[whole], text[whole], known[spot[whole]]
        starts, ends, sizes = [], [], []
        for n in self.lengths:
            q, k = run_length(n), most_edits(n)
            spot, text, run = spots.get(q, (np.zeros(0, np.int64),) * 3)
            own = np.isin(run, self.runs_of[n])
            spot, text = spot[own], text[own]
            need = max(1, n - q - k * q)
            if len(spot) < need:
                continue
            first, last = spot[: len(spot) - need + 1], spot[need - 1 :]
            same = (text[: len(first)] == text[need - 1 :]) & (last - first <= n + k - q)
            first, last, text = first[same], last[same], text[: len(same)][same]
            low = np.maximum(last - (n + k - q), at[text])
            # Both rise, so each start is taken once if it comes after the first run of the place before.
            low[1:] = np.maximum(low[1:], first[:-1] + 1)
            count = first - low + 1
            start = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            starts.append(start)
            ends.append(np.minimum(start + n, at[np.repeat(text, count) + 1]))
            sizes.append(np.full(len(start), n))
        none = [np.zeros(0, np.int64)]
        return np.concatenate(starts or none), np.concatenate(ends or none), np.concatenate(sizes or none)

    def candidates(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window start, item) of all that share a table's key, each once, by start."""
        start, end, size = self.windows(h, at)
        found = []
        for low in range(0, len(start), WINDOWS):
            part = slice(low, low + WINDOWS)
            for key, (known, members) in zip(table_keys(h, start[part], end[part], size[part]), self.tables, strict=True):
                a, b = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
                hit = np.repeat(np.arange(len(key)), b - a)
                nth = np.arange(len(hit)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
                found.append(np.stack([start[part][hit], members[a[hit] + nth]]))
        both = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        return both[0], both[1]


#: Of each worker process: the block that it looked for last, by the broadcast's path.
_last: dict[str, Items] = {}


class Finder:
    """mapInArrow function: the columns key, text first, and all others passed on.

    block: a broadcast of (ids, texts), of bounded size; a worker makes its tables once.
    matches: yields a row (key, item_id, distance, start) per document and item. Else: rows without a match go on.
    """

    def __init__(self, block, matches: bool) -> None:
        self.block, self.matches = block, matches

    def items(self) -> Items:
        name = str(self.block._path)
        if name not in _last:
            _last.clear()
            _last[name] = Items(*self.block.value)
        return _last[name]

    def found(self, items: Items, texts: pa.Array, first: bool) -> list[tuple[int, int, int, int]]:
        """(text, item id, distance, start); with first, at most one for each text."""
        w = textvec.words(texts, lower=True, separator=textvec.PUNCTUATION)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        hit = set()
        starts, members = items.candidates(w.hashes, w.at)
        owner = np.searchsorted(w.at, starts, "right") - 1
        for s, i, t in zip(starts.tolist(), members.tolist(), owner.tolist(), strict=True):
            item, begin, end = items.words[i], int(w.at[t]), int(w.at[t + 1])
            n, k = len(item), most_edits(len(item))
            known = best.get((t, i))
            if first and t in hit or known and (known[0] == 0 or s - begin < known[1] + n):
                continue
            passage = w.hashes[max(begin, s - k) : min(end, s + n + 2 * k)]
            if np.isin(item, passage).sum() < n - k or best_match(item, passage) > k:
                continue
            # The nearest passage around here may begin before the window or after it.
            distance = best_match(item, w.hashes[max(begin, s - n) : min(end, s + 2 * n + k)])
            hit.add(t)
            if not known or distance < known[0]:
                best[t, i] = (distance, s - begin)
        return [(t, items.ids[i], d, s) for (t, i), (d, s) in sorted(best.items())]

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = self.items()
        for batch in batches:
            for piece in textvec.pieces(batch, "text"):
                rows = self.found(items, piece.column("text"), not self.matches) if items.words else []
                if self.matches:
                    text, item, distance, start = zip(*rows, strict=True) if rows else ((), (), (), ())
                    yield pa.record_batch([piece.column(0).take(pa.array(text, pa.int64())), pa.array(item, pa.int64()), pa.array(distance, pa.int32()), pa.array(start, pa.int64())], names=["doc_id", "item_id", "edits", "start_word"])
                else:
                    keep = np.ones(piece.num_rows, bool)
                    keep[[r[0] for r in rows]] = False
                    yield piece.filter(pa.array(keep))


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """The items in blocks of bounded size, each collected by itself. Texts that share an id are items of their own."""
    plain = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = plain.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // most) if chars else 0
    for b in range(n):
        rows = plain.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).distinct().orderBy("item_id", "text").collect()
        yield [r["item_id"] for r in rows], [r["text"] for r in rows]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, start_word): the documents that contain an item, with the fewest edits found."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("start_word", T.LongType())])
    bounded_batches(docs.sparkSession)
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for k, block in enumerate(blocks(benchmark)):
        found = plain.mapInArrow(Finder(docs.sparkSession.sparkContext.broadcast(block), True), schema)
        out = found if k == 0 else out.union(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no item; all columns as they were. One narrow pass per block of items."""
    bounded_batches(docs.sparkSession)
    for block in blocks(benchmark):
        docs = docs.mapInArrow(Finder(docs.sparkSession.sparkContext.broadcast(block), False), docs.schema)
    return docs
