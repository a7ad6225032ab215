"""Hierarchical Pitman-Yor language model of word pairs (Teh, "A hierarchical Bayesian language model based on
Pitman-Yor processes", 2006), learnt and applied without bringing the corpus together.

Every word is a context with a restaurant; its customers are the words that follow it in training texts. All contexts
share one parent, the restaurant of single words, whose customers are the tables of the contexts; its parent in turn
is uniform over the vocabulary and one unknown word. Seating is sampled by Gibbs in sweeps over all customers, blocked:

* given a gamma variable of its restaurant, which takes the place of (strength + discount * tables), and the parent's
  distribution, the number of tables of a dish is drawn from its exact conditional, whose weights are generalised
  Stirling numbers, at every number of customers alike;
* the gamma variable is drawn from its conditional given the restaurant's tables;
* the parent's tables are drawn likewise, given those of all contexts, and the parent's distribution is drawn given
  them: a Dirichlet variable over its dishes, with the rest spread evenly.

After BURN_IN sweeps, SAMPLES sweeps give a predictive probability each, contexts and parent seated as in that sweep,
and these probabilities are averaged.

How it is spread out:

* Texts become pieces of about PIECE tokens, files in the shared folder: words as places in the piece's own vocabulary,
  which is sorted by hash. What pieces ask of the whole corpus goes to parts by ranges of hash, as arrays, and the
  answers come back in the same order, so that no row names a word.
* Counts: pieces send their vocabularies with training counts to word parts, which send back the corpus counts.
* Pairs: pieces send their distinct pairs with counts, dealt by context; a context of HOT tokens or more is split by
  follower into as many shares as it has HOT. A part keeps its restaurants, its house, in a file.
* Sweeps: houses send the tables of each word, and those of split contexts, to word parts; word parts seat the parent
  and send back its customers, tables and distribution. Both keep the order of the first message, so that later ones
  name nothing. A sweep is one pass over the houses, not over the texts.
* Houses send the averaged probability of each pair to the pieces that asked, where texts are scored.

Everything that is sent grows with the corpus, nothing is broadcast but a few totals, and no part holds more than its
share. Files and tables of past sweeps are removed. Words are told apart by 64 bits of hash, followers by 48.

Defined results: a null text is an empty one, which is just the end; A to Z are folded; rows with equal doc_id are
scored, and learnt from, each; rows with a null doc_id are held out; a very long text is in one piece; other columns
are ignored; no training text: every probability is uniform.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import textvec
from corpusloom.llm.common import filesystem, fresh_dir, materialise, remove, sweep_up, write_whole

FOLDS, HELD_OUT = 7, 2
#: Tokens in a piece, tokens and words that a part is laid out for, and tokens that make a context split.
PIECE = 1_500_000
PART = 1_000_000
WORD_PART = 1_500_000
HOT = 125_000
#: (strength, discount) of contexts and of their parent.
CONTEXT = (1.0, 0.8)
PARENT = (1.0, 0.5)
BURN_IN, SAMPLES = 3, 4
#: Stirling numbers of so many customers are tabulated; those of more are integrated.
TABULATED = 1024
SEED = 11
_U = np.uint64
#: Hashes of the two marks; no word has them but by chance.
BEGIN, END = _U(0x1F83D9ABFB41BD6B), _U(0x5BE0CD19137E2179)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves HELD_OUT when divided by FOLDS."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


# Files of named arrays.


def save(uri: str, arrays: dict[str, np.ndarray], names: list[str] = ()) -> None:
    bodies = {k: pack(a) for k, a in arrays.items()}
    head = json.dumps({"names": list(names), "arrays": {k: [a.dtype.str, len(bodies[k])] for k, a in arrays.items()}}).encode()

    def write(out) -> None:
        out.write(struct.pack("<I", len(head)) + head)
        for b in bodies.values():
            out.write(b)

    write_whole(uri, write)


class File:
    """The arrays of a file as attributes, but those to skip; names: its list of texts."""

    def __init__(self, uri: str, skip: tuple[str, ...] = ()) -> None:
        fs, path = filesystem(uri)
        with fs.open_input_file(path) as f:
            (n,) = struct.unpack("<I", f.read(4))
            head = json.loads(f.read(n))
            self.names = head["names"]
            for k, (kind, size) in head["arrays"].items():
                if k in skip:
                    f.seek(size, 1)
                else:
                    setattr(self, k, unpack(f.read(size), kind))


def pack(a: np.ndarray) -> bytes:
    """Compressed, byte by byte of significance: the high bytes of most numbers are alike."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1) if len(a) else b""


def unpack(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1).T).view(kind).ravel() if b else np.zeros(0, kind)


def steps(a: np.ndarray) -> np.ndarray:
    """Rising numbers by their differences, which pack well."""
    return np.diff(a, prepend=0).astype("<u4")


# Pieces.


class Cutter:
    """mapInArrow function: (doc_id, held, text) to pieces in files; (uri, tokens, train_tokens) of each."""

    def __init__(self, folder: str) -> None:
        self.folder, self.most = folder, PIECE

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        tokens = 0

        def done() -> pa.RecordBatch:
            doc, null, out, length, h = (np.concatenate(x) for x in zip(*held, strict=True))
            vocabulary, ids = np.unique(np.append(h, BEGIN), return_inverse=True)
            train = np.repeat(out == 0, length)
            uri = f"{self.folder}/{uuid.uuid4().hex}"
            save(uri, {"doc": doc, "null": null, "held": out, "length": length, "vocabulary": vocabulary, "ids": ids[:-1].astype("<u4"), "begin": ids[-1:].astype("<u4")})
            return pa.record_batch([pa.array([uri]), pa.array([len(h)], pa.int64()), pa.array([int(train.sum())], pa.int64())], names=["uri", "tokens", "train_tokens"])

        for batch in batches:
            for piece in textvec.pieces(batch, "text"):
                w = textvec.words(piece.column(2), lower=True)
                length = np.diff(w.at) + 1
                h = np.empty(int(length.sum()), np.uint64)
                last = np.cumsum(length) - 1
                inner = np.ones(len(h), bool)
                inner[last] = False
                h[inner], h[last] = w.hashes, END
                ids = piece.column(0)
                held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), piece.column(1).to_numpy(zero_copy_only=False).astype(np.uint8), length.astype("<u4"), h))
                tokens += len(h)
                if tokens >= self.most:
                    yield done()
                    held, tokens = [], 0
        if held:
            yield done()


class Piece(File):
    """A piece as read back."""

    def __init__(self, uri: str) -> None:
        super().__init__(uri)
        self.train = np.repeat(self.held == 0, self.length)
        self.counts = np.bincount(self.ids[self.train], minlength=len(self.vocabulary))

    def pairs(self, corpus: np.ndarray, parts: int, hot: int) -> None:
        """Sets context, follower and times (in training) of the distinct pairs, in the order of their hashes, pair_of
        each token, guests of each context, and order, the pairs by part, with their parts. corpus: counts of words."""
        before = np.empty(len(self.ids), np.int64)
        before[1:] = self.ids[:-1]
        first = np.cumsum(self.length, dtype=np.int64) - self.length
        before[first] = self.begin[0]
        key, self.pair_of = np.unique(before << 32 | self.ids, return_inverse=True)
        self.context, self.follower = key >> 32, key & 0xFFFFFFFF
        self.times = np.bincount(self.pair_of[self.train], minlength=len(key))
        # As many texts begin as end; every other word is a context as often as it is there.
        self.guests = corpus.astype(np.int64)
        self.guests[self.begin[0]] = corpus[np.searchsorted(self.vocabulary, END)]
        shares = -(-self.guests // hot)[self.context]
        name, split = self.vocabulary[self.context], self.guests[self.context] >= hot
        share = (self.vocabulary[self.follower[split]] >> _U(16)) % shares[split].astype(np.uint64)
        with np.errstate(over="ignore"):
            name[split] = textvec.mix64(name[split] ^ textvec.mix64(share + _U(1)))
        part = ((name >> _U(32)) * _U(parts) >> _U(32)).astype(np.int32)
        self.order = np.argsort(part, kind="stable")
        self.parts = part[self.order]

    def dealt(self) -> Iterator[tuple[int, np.ndarray]]:
        """(part, its pairs), for each part that the piece has pairs for."""
        edge = np.flatnonzero(np.diff(self.parts)) + 1
        return zip(self.parts[np.append(0, edge)].tolist(), np.split(self.order, edge), strict=True)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Rows sorted by their first column, by its values."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != key and rows:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row[1:])
    if rows:
        yield key, rows


def _row(names: str, *values) -> pa.RecordBatch:
    kinds = {int: pa.int64(), str: pa.string(), bytes: pa.binary(), float: pa.float64()}
    return pa.record_batch([pa.array([v], kinds[type(v)]) for v in values], names=names.split())


def _section(words: np.ndarray, bits: int, parts: int) -> list[int]:
    """Where each word part's words begin and end, of sorted words of so many bits."""
    low = [-(-(k << bits) // parts) for k in range(1, parts)]
    return [0, *np.searchsorted(words, np.array(low, np.uint64)).tolist(), len(words)]


# Counts.


class AskWords:
    """(uri) to vocabularies with training counts by word part."""

    def __init__(self, word_parts: int) -> None:
        self.word_parts = word_parts

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri, _ in _grouped(batches):
            p = Piece(uri)
            edges = _section(p.vocabulary, 64, self.word_parts)
            for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if b > a:
                    yield _row("part uri words counts", k, uri, pack(p.vocabulary[a:b]), pack(p.counts[a:b].astype("<u4")))


@textvec.releasing
def tell_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A word part's words to (uri, part, counts); the number of words seen in training as a row without uri."""
    for part, rows in _grouped(batches):
        words = [unpack(r[1], "<u8") for r in rows]
        every, place = np.unique(np.concatenate(words), return_inverse=True)
        counts = np.bincount(place, np.concatenate([unpack(r[2], "<u4") for r in rows]), len(every))
        at = 0
        for r, w in zip(rows, words, strict=True):
            yield _row("uri part counts", r[0], part, pack(counts[place[at : at + len(w)]].astype("<u4")))
            at += len(w)
        yield _row("uri part counts", "", part, np.array([(counts > 0).sum()], "<f8").tobytes())


# Pairs and houses.


class AskPairs:
    """(uri, part, counts) to the piece's distinct pairs by part."""

    def __init__(self, parts: int, hot: int) -> None:
        self.parts, self.hot = parts, hot

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri, rows in _grouped(batches):
            p = Piece(uri)
            p.pairs(np.concatenate([unpack(r[1], "<u4") for r in sorted(rows)]), self.parts, self.hot)
            for part, own in p.dealt():
                context, size = np.unique(p.context[own], return_counts=True)
                name = p.vocabulary[p.follower[own]]
                yield _row("part uri context size guests high low times", part, uri, pack(p.vocabulary[context]), pack(size.astype("<u4")), pack(p.guests[context].astype("<u4")), pack((name >> _U(32)).astype("<u4")), pack((name >> _U(16)).astype("<u2")), pack(p.times[own].astype("<u4")))


class Tables:
    """What houses tell word parts: the tables of each of their words, and those of their split contexts."""

    def __init__(self, folder: str, word_parts: int, hot: int) -> None:
        self.folder, self.word_parts, self.hot = folder, word_parts, hot

    def house(self, part: int) -> str:
        return f"{self.folder}/house-{part}"

    def state(self, part: int, sweep: int) -> str:
        return f"{self.folder}/state-{sweep}/{part}"

    def told(self, part: int, h: File | dict, tables: np.ndarray, totals: np.ndarray, names: bool) -> Iterator[pa.RecordBatch]:
        by_word = np.bincount(h.word_of, tables, len(h.words)).astype("<u4")
        split = np.flatnonzero(h.guests >= self.hot)
        edges, context_edges = _section(h.words, 48, self.word_parts), _section(h.contexts[split], 64, self.word_parts)
        for k in range(self.word_parts):
            own, mine = slice(edges[k], edges[k + 1]), split[context_edges[k] : context_edges[k + 1]]
            if edges[k + 1] > edges[k] or len(mine):
                words, contexts = (pack(h.words[own]), pack(h.contexts[mine])) if names else (b"", b"")
                yield _row("word_part part words tables contexts totals", k, part, words, pack(by_word[own]), contexts, pack(totals[mine].astype("<u4")))


TOLD = "word_part long, part long, words binary, tables binary, contexts binary, totals binary"


class Build(Tables):
    """A part's pairs to its house in a file, each dish with one table; what it tells word parts, words named."""

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches):
            rows.sort()
            h = File.__new__(File)
            h.contexts, context_at = np.unique(np.concatenate([unpack(r[1], "<u8") for r in rows]), return_inverse=True)
            sizes = [unpack(r[2], "<u4") for r in rows]
            h.guests = np.zeros(len(h.contexts), "<u4")
            h.guests[context_at] = np.concatenate([unpack(r[3], "<u4") for r in rows])
            context = np.repeat(context_at, np.concatenate(sizes))
            follower = np.concatenate([unpack(r[4], "<u4").astype(np.uint64) << _U(16) | unpack(r[5], "<u2") for r in rows])
            words, word = np.unique(follower, return_inverse=True)
            # Every row comes in this order already, which the sort makes use of.
            key = context << 32 | word
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.append(True, key[1:] != key[:-1])
            first = np.flatnonzero(new)
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(new) - 1
            customers = np.add.reduceat(np.concatenate([unpack(r[6], "<u4") for r in rows])[order].astype(np.int64), first)
            h.words, h.word_of = words, key[first] & 0xFFFFFFFF
            owner = key[first] >> 32
            h.dishes = np.bincount(owner, minlength=len(h.contexts))
            asked = np.array([int(x.sum()) for x in sizes])
            places = np.concatenate([steps(x) for x in np.split(place, np.cumsum(asked)[:-1])])
            arrays = {"contexts": h.contexts, "guests": h.guests, "dishes": h.dishes.astype("<u4"), "words": h.words, "word_of": h.word_of.astype("<u4"), "customers": customers.astype("<u4"), "asked": asked.astype("<u4"), "places": places}
            save(self.house(part), arrays, [r[0] for r in rows])
            tables = np.minimum(customers, 1)
            totals = np.bincount(owner, tables, len(h.contexts))
            save(self.state(part, 0), {"tables": tables.astype("<u4"), "totals": totals.astype("<u4")})
            yield from self.told(part, h, tables, totals, True)


class Parent:
    """A word part's words, whose customers are the tables of the houses, seated in the parent; what houses are told.

    rate: the gamma variable of the parent's restaurant; known: words seen in training.
    """

    def __init__(self, folder: str, sweep: int, rate: float, known: int) -> None:
        self.folder, self.sweep, self.rate, self.known = folder, sweep, rate, known

    def places(self, word_part: int, rows: list[tuple]) -> tuple[list[np.ndarray], list[np.ndarray], int, int]:
        """Of each house, where its words and its split contexts are; and how many there are of either."""
        uri = f"{self.folder}/words-{word_part}"
        if self.sweep:
            f = File(uri)
            cut = lambda all_, n: [np.cumsum(x, dtype=np.int64) for x in np.split(all_, np.cumsum(n)[:-1])]
            return cut(f.words, f.word_counts), cut(f.contexts, f.context_counts), int(f.size[0]), int(f.size[1])
        found, arrays = [], {}
        for k, (name, counts) in ((1, ("words", "word_counts")), (3, ("contexts", "context_counts"))):
            lists = [unpack(r[k], "<u8") for r in rows]
            every, place = np.unique(np.concatenate(lists), return_inverse=True)
            places = np.split(place, np.cumsum([len(x) for x in lists])[:-1])
            arrays |= {name: np.concatenate([steps(x) for x in places]), counts: np.array([len(x) for x in lists], "<u4")}
            found.append((places, len(every)))
        save(uri, arrays | {"size": np.array([n for _, n in found], "<i8")})
        return found[0][0], found[1][0], found[0][1], found[1][1]

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strength, discount = PARENT
        for word_part, rows in _grouped(batches):
            rows.sort()
            words, contexts, n, m = self.places(word_part, rows)
            customers = np.bincount(np.concatenate(words), np.concatenate([unpack(r[2], "<u4") for r in rows]), n).astype(np.int64)
            totals = np.bincount(np.concatenate(contexts), np.concatenate([unpack(r[4], "<u4") for r in rows]), m)
            rng = np.random.default_rng([SEED, 0, self.sweep, word_part])
            tables, drawn = np.zeros(n, np.int64), np.zeros(n)
            seen = np.flatnonzero(customers)
            tables[seen] = Dishes(customers[seen], discount).draw(np.full(len(seen), discount * self.rate / (self.known + 1)), rng)
            drawn[seen] = rng.standard_gamma(customers[seen] - discount * tables[seen])
            for r, w, c in zip(rows, words, contexts, strict=True):
                yield _row("part word_part customers tables drawn totals", r[0], word_part, pack(customers[w].astype("<u4")), pack(tables[w].astype("<u4")), pack(drawn[w].astype("<f4")), pack(totals[c].astype("<u4")))
            yield _row("part word_part customers tables drawn totals", -1, word_part, np.array([customers.sum(), tables.sum(), drawn.sum()], "<f8").tobytes(), b"", b"", b"")


class Reply:
    """What the word parts told a house after a sweep, in its order of words and of split contexts."""

    def __init__(self, rows: list[tuple]) -> None:
        rows = sorted(rows)
        self.customers, self.tables, self.drawn, self.totals = (np.concatenate([unpack(r[k], t) for r in rows]) for k, t in ((1, "<u4"), (2, "<u4"), (3, "<f4"), (4, "<u4")))


class Sweep(Tables):
    """A house's reply to its next seating, in a file with the reply; what it tells word parts. numbers: (customers,
    tables, sum of the drawn weights, weight drawn for the rest) of the parent."""

    def __init__(self, folder: str, word_parts: int, hot: int, sweep: int, numbers: tuple[float, ...], known: int) -> None:
        super().__init__(folder, word_parts, hot)
        self.sweep, self.numbers, self.known = sweep, numbers, known

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, drawn, rest = self.numbers
        for part, rows in _grouped(batches):
            h, before, reply = File(self.house(part), ("asked", "places")), File(self.state(part, self.sweep - 1)), Reply(rows)
            rng = np.random.default_rng([SEED, 1, self.sweep, part])
            share = (reply.drawn + rest / (self.known + 1)) / (drawn + rest)
            totals = before.totals.astype(np.float64)
            split = np.flatnonzero(h.guests >= self.hot)
            totals[split] = reply.totals
            rate = rates(CONTEXT, totals, rng)
            # The shares of a split context draw the same.
            rate[split] = [rates(CONTEXT, t, np.random.default_rng([SEED, 2, self.sweep, c])) for t, c in zip(totals[split], h.contexts[split].tolist(), strict=True)]
            owner = np.repeat(np.arange(len(h.contexts)), h.dishes)
            seen = np.flatnonzero(h.customers)
            dishes = Dishes(h.customers[seen].astype(np.int64), CONTEXT[1], getattr(before, "rows", None), getattr(before, "spans", None))
            tables = np.zeros(len(h.customers), np.int64)
            tables[seen] = dishes.draw(np.maximum(CONTEXT[1] * rate[owner[seen]] * share[h.word_of[seen]], 1e-290), rng)
            own = np.bincount(owner, tables, len(h.contexts))
            kept, spans = dishes.kept()
            save(self.state(part, self.sweep), {"tables": tables.astype("<u4"), "totals": own.astype("<u4"), "rows": kept, "spans": spans, "parent_customers": reply.customers, "parent_tables": reply.tables, "split_totals": reply.totals})
            yield from self.told(part, h, tables, own, False)


class Answer(Tables):
    """A house's last reply to the averaged probability of each pair that a piece asked for. samples: the sweeps, with
    (customers, tables) of the parent after each."""

    def __init__(self, folder: str, word_parts: int, hot: int, samples: dict[int, tuple[float, float]], known: int) -> None:
        super().__init__(folder, word_parts, hot)
        self.samples, self.known = samples, known

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches):
            h, last = File(self.house(part)), Reply(rows)
            split = np.flatnonzero(h.guests >= self.hot)
            owner = np.repeat(np.arange(len(h.contexts)), h.dishes)
            guests = h.guests[owner].astype(np.float64)
            mean = np.zeros(len(owner))
            for sweep, (customers, tables) in self.samples.items():
                state = File(self.state(part, sweep))
                after = File(self.state(part, sweep + 1)) if sweep < max(self.samples) else None
                c, t, totals_of_split = (after.parent_customers, after.parent_tables, after.split_totals) if after else (last.customers, last.tables, last.totals)
                strength, discount = PARENT
                parent = (c - discount * t + (strength + discount * tables) / (self.known + 1)) / (strength + customers)
                totals = state.totals.astype(np.float64)
                totals[split] = totals_of_split
                strength, discount = CONTEXT
                mean += (h.customers - discount * state.tables + (strength + discount * totals[owner]) * parent[h.word_of]) / (strength + guests)
            chance = (mean / len(self.samples)).astype("<f4")
            edge = np.cumsum(h.asked)[:-1]
            for uri, places in zip(h.names, np.split(h.places, edge), strict=True):
                yield _row("uri part chance", uri, part, pack(chance[np.cumsum(places, dtype=np.int64)]))


# Seating.


def rates(prior: tuple[float, float], totals: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The gamma variable of restaurants with so many tables; given it, their dishes are independent."""
    return rng.gamma(prior[0] / prior[1] + totals)


def seat(customers: np.ndarray, context: np.ndarray, share: np.ndarray, strength: float, discount: float, seed: int, contexts: int = 1, elsewhere: int = 0, sweeps: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Mean tables of each dish, and of each context, over Gibbs sweeps with a parent that is given.

    customers: at least one, of each dish; context: its restaurant; share: the parent's probability of the dish;
    elsewhere: tables of each restaurant that other parts have.
    """
    rng = np.random.default_rng([SEED, seed])
    dishes = Dishes(customers, discount)
    total = np.bincount(context, minlength=contexts) + float(elsewhere)
    mean_tables, mean_total = np.zeros(len(customers)), np.zeros(contexts)
    for sweep in range(sweeps):
        tables = dishes.draw(np.maximum(discount * rates((strength, discount), total, rng)[context] * share, 1e-290), rng)
        total = np.bincount(context, tables, contexts) + float(elsewhere)
        if 2 * sweep >= sweeps:
            mean_tables += tables / (sweeps - (sweeps + 1) // 2)
            mean_total += total / (sweeps - (sweeps + 1) // 2)
    return mean_tables, mean_total


def seat_many(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, drawn once; fresh: the weight of a table."""
    return Dishes(customers, discount).draw(fresh, rng)


class Dishes:
    """Draws the tables of dishes: t of c customers with weight S(c, t) * w ** t, where S sums over all seatings the
    products of (1 - discount) * (2 - discount) * ... of the tables, a generalised Stirling number."""

    def __init__(self, customers: np.ndarray, discount: float, rows: np.ndarray | None = None, spans: np.ndarray | None = None) -> None:
        self.customers, self.discount = customers, discount
        order = np.argsort(customers, kind="stable")
        few = order[(customers[order] > 1) & (customers[order] <= TABULATED)]
        self.groups = np.split(few, np.flatnonzero(np.diff(customers[few])) + 1) if len(few) else []
        self.many = order[customers[order] > TABULATED]
        #: By dish: (lowest t, logarithms of S from there on), as a former sweep kept them.
        self.rows: dict[int, tuple[int, np.ndarray]] = {}
        if spans is not None and len(spans):
            cuts = np.cumsum(spans.reshape(-1, 3)[:, 2])[:-1]
            self.rows = {i: (low, row.astype(np.float64)) for (i, low, _), row in zip(spans.reshape(-1, 3).tolist(), np.split(rows, cuts), strict=True)}

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows, and (dish, lowest t, length) of each, for the next sweep; only differences within a row count."""
        spans = [(i, low, len(row)) for i, (low, row) in self.rows.items()]
        rows = [(row - row.max()).astype("<f4") for _, row in self.rows.values()]
        return np.concatenate([np.zeros(0, "<f4"), *rows]), np.array(spans, "<i8").reshape(-1)

    def draw(self, weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        out = np.ones(len(self.customers), np.int64)
        log_w = np.log(weight)
        known = stirling_table(self.discount) if self.groups else None
        for group in self.groups:
            c = int(self.customers[group[0]])
            t = np.arange(1, c + 1)
            step = max(1, (1 << 19) // c)
            for low in range(0, len(group), step):
                at = group[low : low + step]
                mass = known[c, 1 : c + 1] + log_w[at, None] * t
                mass = np.cumsum(np.exp(mass - mass.max(axis=1, keepdims=True)), axis=1)
                out[at] += (mass[:, :-1] < rng.random(len(at))[:, None] * mass[:, -1:]).sum(axis=1)
        if len(self.many):
            low, high = likely(self.customers[self.many], weight[self.many], self.discount)
            for i, a, b in zip(self.many.tolist(), low.tolist(), high.tolist(), strict=True):
                first, row = self.rows.get(i, (0, np.zeros(0)))
                if a < first or b >= first + len(row):
                    c = int(self.customers[i])
                    first = max(1, a - (b - a) // 2)
                    row = self.rows[i] = first, stirling_row(c, first, min(c, b + (b - a) // 2), self.discount)
                    first, row = self.rows[i]
                mass = row[a - first : b - first + 1] + log_w[i] * np.arange(a, b + 1)
                mass = np.cumsum(np.exp(mass - mass.max()))
                out[i] = a + np.searchsorted(mass, rng.random() * mass[-1])
        return out


_stirling: dict[float, np.ndarray] = {}


def stirling_table(discount: float) -> np.ndarray:
    """log S(c, t) for c up to TABULATED, by S(c + 1, t) = S(c, t - 1) + (c - discount * t) * S(c, t)."""
    if discount not in _stirling:
        t = np.arange(TABULATED + 1)
        out = np.full((TABULATED + 1, TABULATED + 1), -np.inf)
        out[1, 1] = 0.0
        for c in range(1, TABULATED):
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], np.append(np.log(c - discount * t[1 : c + 1]), 0.0) + out[c, 1 : c + 2])
        _stirling[discount] = out
    return _stirling[discount]


def _bisect(f: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """Where in (0, 1) each of n falling functions has its zero, on a scale of logarithms."""
    low, high = np.full(n, -600.0), np.full(n, -1e-12)
    for _ in range(60):
        middle = (low + high) / 2
        up = f(np.exp(middle)) > 0
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return np.exp(low)


def likely(c: np.ndarray, w: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """The range of t outside which float64 holds no mass: tables are Poisson if the number of customers is, too."""
    u = _bisect(lambda u: w * u ** (d - 1) * (1 - u) - c, len(c))
    mean = w / d * (1 - u**d)
    reach = 9 * np.sqrt(mean) + 14
    low = np.clip(np.floor(mean - reach), 1, c)
    return low.astype(np.int64), np.clip(np.ceil(mean + reach), low, c).astype(np.int64)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, carried back by the recurrence."""
    y = x + 8.0
    back = np.log(x)
    for k in range(1, 8):
        back += np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - back


def log_stirling(c: int, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) for any t > 0: the coefficient of z**c in ((1 - (1 - z)**d) / d)**t, times c! / t!.

    It is a contour integral around the cut from 1 on, by the trapezoid rule on a parabola through the saddle point;
    for d of one half it has a closed form.
    """
    if d == 0.5:
        return _lgamma(2 * c - t) - _lgamma(c - t + 1.0) - _lgamma(t) - (c - t) * math.log(4)
    saddle = _bisect(lambda u: t * d * u ** (d - 1) * (1 - u) - (c + 1) * (1 - u**d), len(t))
    u = np.maximum(saddle, 3 / c)
    first = -t * d * u ** (d - 1) / (1 - u**d) + (c + 1) / (1 - u)
    second = t * (d * (1 - d) * u ** (d - 2) / (1 - u**d) - (d * u ** (d - 1) / (1 - u**d)) ** 2) + (c + 1) / (1 - u) ** 2
    step = np.minimum(0.15, 1 / 3.5 / np.sqrt(4 * u * u * second + 2 * u * first))
    z = 1 + 1j * step[:, None] * np.arange(64)
    x = u[:, None] * z * z
    height = t[:, None] * np.log(1 - x**d) - (c + 1) * np.log(1 - x)
    top = height[:, 0].real
    sums = (z * np.exp(height - top[:, None])).real
    return top + np.log(u / np.pi * step * (2 * sums.sum(axis=1) - sums[:, 0])) + math.lgamma(c + 1) - _lgamma(t + 1.0) - t * math.log(d)


def stirling_row(c: int, low: int, high: int, d: float) -> np.ndarray:
    """log S(c, t) for t from low to high; long rows by Chebyshev interpolation, for S is analytic in t."""
    t = np.arange(low, high + 1, dtype=np.float64)
    if len(t) <= 400 or d == 0.5:
        return log_stirling(c, t, d)
    nodes = np.polynomial.chebyshev.chebpts1(40)
    middle, half = (low + high) / 2, (high - low) / 2
    fit = np.polynomial.chebyshev.chebfit(nodes, log_stirling(c, middle + half * nodes, d), 39)
    return np.polynomial.chebyshev.chebval((t - middle) / half, fit)


# Scores.


class Scorer:
    """(uri, kind, part, a), counts by word part (kind 0) and probabilities by part (kind 1), to a row for each text."""

    def __init__(self, parts: int, hot: int, by_token: bool) -> None:
        self.parts, self.hot, self.by_token = parts, hot, by_token

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri, rows in _grouped(batches):
            p = Piece(uri)
            counts = np.concatenate([unpack(r[2], "<u4") for r in sorted(rows) if r[0] == 0])
            p.pairs(counts, self.parts, self.hot)
            chance = np.empty(len(p.order))
            chance[p.order] = np.concatenate([unpack(r[2], "<f4") for r in sorted(rows) if r[0] == 1])
            first = np.cumsum(p.length, dtype=np.int64) - p.length
            by_token = np.log10(chance)[p.pair_of]
            known = np.add.reduceat((counts > 0)[p.ids].astype(np.int64), first)
            base = np.add.reduceat(np.log10(counts + 1.0)[p.ids], first)
            score = np.add.reduceat(by_token, first)
            ends = np.append(first, len(p.ids))
            for low in range(0, len(first), 20_000):
                s = slice(low, low + 20_000)
                doc = pa.array(p.doc[s], mask=p.null[s].astype(bool))
                columns = [doc, pa.array(p.held[s] > 0), pa.array(p.length[s].astype(np.int64)), pa.array(known[s]), pa.array(base[s]), pa.array(score[s])]
                names = ["doc_id", "held_out", "n_tokens", "n_known", "sum", "score"]
                if self.by_token:
                    own = ends[low : low + 20_001]
                    columns.append(pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), pa.array(by_token[own[0] : own[-1]])))
                    names.append("token_scores")
                yield pa.record_batch(columns, names=names)


def _by_uri(rows: DataFrame, f: Callable, schema: str | T.StructType) -> DataFrame:
    return rows.repartition("uri").sortWithinPartitions("uri").mapInArrow(f, schema)


def _by_part(rows: DataFrame, column: str, parts: int, f: Callable, schema: str) -> DataFrame:
    return rows.repartitionById(parts, F.col(column).cast("int")).sortWithinPartitions(column).mapInArrow(f, schema)


def score(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, by_token: bool = False) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    base_score: add-one over the vocabulary and one unknown word; score: the model's; both log10 of the whole text.
    by_token adds token_scores, the log10 probability of each token, the end included.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), F.col("text").cast("string").alias("text"))
    folder = fresh_dir(spark, "pieces")
    pieces = materialise(plain.mapInArrow(Cutter(folder), "uri string, tokens long, train_tokens long"), "pieces")
    tokens, train = pieces.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("train_tokens"), F.lit(0))).first()
    parts, word_parts = max(4, -(-tokens // PART)), max(2, -(-tokens // (4 * WORD_PART)))
    uris = pieces.select("uri")
    counts = materialise(_by_part(_by_uri(uris, AskWords(word_parts), "part long, uri string, words binary, counts binary"), "part", word_parts, tell_words, "uri string, part long, counts binary"), "counts")
    known = int(sum(np.frombuffer(r["counts"], "<f8")[0] for r in counts.filter("uri = ''").select("counts").toLocalIterator()))
    sweep_up(spark)

    own = counts.filter("uri <> ''")
    asked = _by_uri(own, AskPairs(parts, HOT), "part long, uri string, context binary, size binary, guests binary, high binary, low binary, times binary")
    told = _by_part(asked, "part", parts, Build(folder, word_parts, HOT), TOLD)
    rng, tables, after, replies, past = np.random.default_rng([SEED, 3]), float(known), {}, None, None
    for sweep in range(burn_in + samples + 1):
        rate = float(rates(PARENT, np.float64(tables), rng))
        seated = _by_part(told, "word_part", word_parts, Parent(folder, sweep, rate, known), "part long, word_part long, customers binary, tables binary, drawn binary, totals binary")
        path = f"{folder}/replies-{sweep}"
        seated.write.parquet(path)
        replies = spark.read.schema(seated.schema).parquet(path)
        customers, tables, drawn = sum((np.frombuffer(r["customers"], "<f8") for r in replies.filter("part < 0").select("customers").toLocalIterator()), np.zeros(3)).tolist()
        after[sweep] = (customers, tables)
        rest = float(rng.standard_gamma(PARENT[0] + PARENT[1] * tables))
        if sweep <= burn_in + samples - 1:
            told = _by_part(replies.filter("part >= 0"), "part", parts, Sweep(folder, word_parts, HOT, sweep + 1, (customers, tables, drawn, rest), known), TOLD)
        sweep_up(spark)
        if past:
            remove(past)
        if 1 < sweep <= burn_in:
            remove(f"{folder}/state-{sweep - 2}")
        past = path
    chosen = {k: after[k] for k in range(burn_in + 1, burn_in + samples + 1)}
    answers = _by_part(replies.filter("part >= 0"), "part", parts, Answer(folder, word_parts, HOT, chosen, known), "uri string, part long, chance binary")
    both = own.select("uri", F.lit(0).alias("kind"), "part", F.col("counts").alias("a")).union(answers.select("uri", F.lit(1), "part", "chance"))
    fields = [("doc_id", T.LongType()), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("sum", T.DoubleType()), ("score", T.DoubleType())]
    fields += [("token_scores", T.ArrayType(T.DoubleType()))] * by_token
    out = _by_uri(both, Scorer(parts, HOT, by_token), T.StructType([T.StructField(*f) for f in fields]))
    base = F.col("sum") - F.col("n_tokens") * F.log10(F.lit(float(train + known + 1)))
    more = ["token_scores"] * by_token
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), base.alias("base_score"), "score", *more)


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, texts, tokens, perplexity, base_perplexity) of each fold."""
    per_token = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.count(F.lit(1)).alias("texts"), F.sum("n_tokens").alias("tokens"), per_token("score").alias("perplexity"), per_token("base_score").alias("base_perplexity"))
