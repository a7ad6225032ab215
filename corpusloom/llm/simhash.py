"""Near-duplicate documents by 64-bit SimHash, found through Golay-code fuzzy hashing.

Fingerprints within ``MOST_BITS`` = 3 differing bits are linked. A fingerprint is cut into three segments of 22, 21 and
21 bits. Three errors over three segments leave two segments with at most one error each (pigeonhole). Within a
segment the perfect (23, 12) Golay code serves as the fuzzy hash: the keys of a segment are the 12-bit indices of all
codewords within distance three, and, where the nearest codeword is three away, of the five codewords at distance
four. Segments that differ in one bit share a key, for the nearest codeword of either is at most four from the other.
Keys of two segments are put together, so that a fingerprint has 3 x (1 to 36) keys of 24 bits. Fingerprints that
share a key meet in one group, their distances are verified, and components follow from the links.

Equal fingerprints are one node, so exact copies never meet as pairs; a group emits the links of a spanning forest,
not its pairs.

Two schemes: FINE, for the digest, as above, on three-word shingles, complete within its three bits. SIMILAR, for
filters: 128 bits on five-word shingles, where texts are near duplicates whose sets of shingles have a similarity
(Jaccard) of 0.8 or more, which about 20 differing bits suggest. So many errors are beyond guarantees by the pigeonhole;
instead segments are decoded softly: every bit counts by its margin, the surplus of shingles that vote for it, and a
segment's keys are the indices of the three best codewords. Bits that flip between similar texts have small margins, so
that their best codewords agree. Keys of two of five segments are put together, best ones first. By simulation such
keys meet for 95 % of pairs at a similarity of 0.8 and 99 % at 0.86. Texts that share a key and differ in at most 32 bits
hang together; of each group a star around its centre and a spanning forest are candidates, whose sets of shingles
``confirmed`` compares, so that no less similar pair is linked. What hangs together but isn't linked after that, for
lack of a similar text at the other end of a candidate, is compared once more: each text that isn't in the largest part
of its cluster with all texts of the other parts, by counts of common shingles from an inverted index, in blocks of
queries and members. Only links that hold and join two parts leave a task, no pairs. So what hangs together ends in the
exact components at that similarity, in families of any size. Nodes are distinct texts there.

Defined results: a null text is an empty one; texts without words have fingerprint zero and are linked like any other;
A to Z are folded; a text with fewer words than a shingle is one shingle; repeated rows are rows of one component;
other columns are ignored or, in filters, kept; no rows: none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import textvec
from corpusloom.llm.common import bounded_batches, materialise, maybe_broadcast
from corpusloom.llm.components import components

MOST_BITS = 3
SHINGLE = 3
SEED = 42
#: The generator polynomial of the binary Golay code, and the segments as (shift, bits).
GENERATOR = 0b110001110101
SEGMENTS = ((42, 22), (21, 21), (0, 21))


@dataclass(frozen=True)
class Scheme:
    """What counts as near: words of a shingle, differing bits, and whether fingerprints are wide, decoded softly and
    only candidates, whose shingles are compared."""

    shingle: int
    most_bits: int
    wide: bool


FINE = Scheme(SHINGLE, MOST_BITS, False)
SIMILAR = Scheme(5, 32, True)
#: Least similarity of near duplicates, as a fraction.
SIMILARITY = (4, 5)
#: Links of one text that a task compares; members and queries of a block.
SHARE, MEMBERS, QUERIES = 2048, 1 << 12, 1 << 10
#: Of wide fingerprints: bits, segments that are decoded, codewords of each, and shingles whose bits are added at once.
WIDTH, SOFT_SEGMENTS, BEST, CHUNK = 128, 5, 3, 1 << 15


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text: a bit is set if it is set in over half of the shingles' hashes; no word: zero."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(sizes + 1) - 1
    start = end - sizes
    width = min(shingle, len(words))
    first, last = start[: len(words) - width + 1].tolist(), end[width - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(line[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(first))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((1 << np.flatnonzero(2 * ones > len(h)).astype(object)).sum()) if (2 * ones > len(h)).any() else 0


@textvec.releasing
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        fp = np.fromiter((simhash(t.as_py() or b"") for t in texts), np.uint64, batch.num_rows)
        yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long; a null text counts as empty."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, schema)


def _remainder(v: int) -> int:
    for bit in range(22, 10, -1):
        if v >> bit & 1:
            v ^= GENERATOR << (bit - 11)
    return v


class Golay:
    """Tables to decode 23-bit vectors: the nearest codeword, and those at distance four where it is three away."""

    def __init__(self) -> None:
        units = [_remainder(1 << i) for i in range(23)]
        self.low = self._sums(units[:12])
        self.high = self._sums(units[12:])
        self.errors = np.full((2048, 6), -1, np.int64)
        filled = np.zeros(2048, np.int64)
        for weight in range(5):
            for at in combinations(range(23), weight):
                syndrome = 0
                for i in at:
                    syndrome ^= units[i]
                if weight < 4 or self.three[syndrome]:
                    self.errors[syndrome, filled[syndrome]] = sum(1 << i for i in at)
                    filled[syndrome] += 1
            if weight == 3:
                self.three = np.array([int(e).bit_count() == 3 for e in self.errors[:, 0]])

    @staticmethod
    def _sums(units: list[int]) -> np.ndarray:
        out = np.zeros(1 << len(units), np.int64)
        for i, u in enumerate(units):
            out[1 << i : 2 << i] = out[: 1 << i] ^ u
        return out

    def keys(self, v: np.ndarray) -> np.ndarray:
        """For each 23-bit vector six codeword indices, -1 where there are fewer; the nearest codeword's is first."""
        errors = self.errors[self.low[v & 0xFFF] ^ self.high[v >> 12]]
        return np.where(errors >= 0, (v[:, None] ^ errors) >> 11, -1)


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints, and for each key the place of its fingerprint."""
    u = fp.view(np.uint64)
    parts = [golay().keys(((u >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64)) for s, n in SEGMENTS]
    keys, rows = [], []
    for k, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        a, b = parts[i][:, :, None], parts[j][:, None, :]
        key = np.where((a >= 0) & (b >= 0), (k << 24) | (a << 12) | b, -1).reshape(len(fp), -1)
        row, column = np.nonzero(key >= 0)
        keys.append(key[row, column])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


@textvec.releasing
def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy()
        for i in range(0, len(fp), 4096):
            key, row = fuzzy_keys(fp[i : i + 4096])
            yield pa.record_batch([pa.array(key), pa.array(fp[i : i + 4096][row])], names=["key", "fp"])


def shingles(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all shingles, repeats included, the text of each, and how many each text has."""
    w = textvec.words(texts, lower=True)
    first, n = w.at[:-1], np.diff(w.at)
    count = np.where(n > 0, np.maximum(1, n - shingle + 1), 0)
    owner = np.repeat(np.arange(len(n)), count)
    start = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    width = np.minimum(n, shingle)[owner]
    h = np.empty(len(owner), np.uint64)
    for k in range(1, shingle + 1):
        own = width == k
        if own.any():
            h[own] = textvec.combine(w.hashes, k)[start[own]]
    return h, owner, count


def margins(texts: pa.Array, shingle: int) -> np.ndarray:
    """Of each text and bit, how many more shingles have the bit set than haven't; texts without words have zeros."""
    h, owner, count = shingles(texts, shingle)
    out = np.zeros((len(count), WIDTH), np.int32)
    with np.errstate(over="ignore"):
        for low in range(0, len(h), CHUNK):
            part, of = h[low : low + CHUNK], owner[low : low + CHUNK]
            both = np.stack([part, textvec.mix64(part * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))], axis=1)
            bits = np.unpackbits(both.astype("<u8").view(np.uint8), axis=1, bitorder="little")
            edge = np.append(0, np.flatnonzero(np.diff(of)) + 1)
            out[of[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    return 2 * out - count[:, None].astype(np.int32)


class Codewords:
    """All codewords as rows of +1 and -1, by index; the bits of an index lead its codeword."""

    def __init__(self) -> None:
        index = np.arange(4096) << 11
        words = index ^ np.array([_remainder(int(v)) for v in index])
        self.signs = ((words[:, None] >> np.arange(23) & 1) * 2 - 1).astype(np.float32)

    def best(self, margin: np.ndarray) -> np.ndarray:
        """For each row of 23 margins the BEST codewords' indices, best first."""
        out = np.empty((len(margin), BEST), np.uint16)
        for low in range(0, len(margin), 512):
            score = margin[low : low + 512].astype(np.float32) @ self.signs.T
            row = np.arange(len(score))
            for k in range(BEST):
                found = score.argmax(axis=1)
                out[low : low + 512, k] = found
                score[row, found] = -np.inf
        return out


_codewords: list[Codewords] = []


@textvec.releasing
def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, fp, text) to (doc_id, fp, high, low, codes): halves of the fingerprint, codewords of its segments."""
    if not _codewords:
        _codewords.append(Codewords())
    for batch in batches:
        for piece in textvec.pieces(batch, "text"):
            margin = margins(piece.column(2), SIMILAR.shingle)
            halves = np.packbits(margin > 0, axis=1, bitorder="little").view("<i8")
            codes = np.concatenate([_codewords[0].best(margin[:, 23 * k : 23 * k + 23]) for k in range(SOFT_SEGMENTS)], axis=1)
            body = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1] * 2), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
            yield pa.record_batch([*piece.columns[:2], pa.array(halves[:, 1]), pa.array(halves[:, 0]), body], names=["doc_id", "fp", "high", "low", "codes"])


@textvec.releasing
def _wide_keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, high, low, codes) to a row for each key."""
    ranks = [(a, b) for a in range(BEST) for b in range(BEST - a)]
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            node, high, low, body = (batch.column(k).slice(at, 4096) for k in range(4))
            codes = np.frombuffer(b"".join(body.to_pylist()), "<u2").reshape(len(node), SOFT_SEGMENTS, BEST).astype(np.int32)
            pairs = list(combinations(range(SOFT_SEGMENTS), 2))
            key = np.concatenate([k << 24 | codes[:, i, a] << 12 | codes[:, j, b] for k, (i, j) in enumerate(pairs) for a, b in ranks])
            times = pa.array(np.tile(np.arange(len(node)), len(pairs) * len(ranks)))
            yield pa.record_batch([pa.array(key.astype(np.int32)), node.take(times), high.take(times), low.take(times)], names=["key", "node", "high", "low"])


def spanning_links(fp: np.ndarray, most_bits: int = MOST_BITS) -> list[tuple[int, int]]:
    """Places of rows of fp, fingerprints of one word or several, whose links within most_bits span the components."""
    left, out = np.arange(len(fp)), []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        here = queue.pop()
        near = np.bitwise_count(fp[left] ^ fp[here]).sum(axis=1, dtype=np.int64) <= most_bits
        found = left[near].tolist()
        out += [(here, x) for x in found]
        queue += found
        left = left[~near]
    return out


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def candidate_links(fp: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """Places of pairs within most_bits that span what hangs together, and the star around the row nearest to the majority
    of all bits, which is most like the source of the copies. Links grow with the rows and not with their pairs."""
    forest = spanning_links(fp, most_bits)
    root = np.arange(len(fp))
    for a, b in forest:
        root[b] = root[a]
    order = np.argsort(root, kind="stable")
    out = list(forest)
    for own in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
        if len(own) > 2:
            votes = np.unpackbits(fp[own].view(np.uint8), axis=1).sum(axis=0)
            far = _bits(fp[own], np.packbits(2 * votes > len(own)).view(np.uint64))
            centre = int(own[far.argmin()])
            out += [(centre, x) for x in own[_bits(fp[own], fp[centre]) <= most_bits].tolist() if x != centre]
    return out


class Linker:
    """mapInArrow function: rows (key, node, fingerprint...) sorted by key to links of nodes; only the last, unfinished
    group is held over. A group's links are looked for by 16-bit blocks, one of which near fingerprints share, where it
    is large and the scheme allows it."""

    LARGE = 1024

    def __init__(self, most_bits: int, candidates: bool = False) -> None:
        self.most_bits = most_bits
        self.candidates = candidates

    def group(self, node: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
        if self.candidates:
            return [(node[a], node[b]) for a, b in candidate_links(fp, self.most_bits)]
        if len(fp) < self.LARGE or self.most_bits >= 4 * fp.shape[1]:
            return [(node[a], node[b]) for a, b in spanning_links(fp, self.most_bits)]
        out = []
        blocks = fp.view("<u2").reshape(len(fp), -1)
        for block in blocks.T:
            order = np.argsort(block, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                if len(own) > 1:
                    out += [(node[own[a]], node[own[b]]) for a, b in spanning_links(fp[own], self.most_bits)]
        return out

    def links(self, key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.diff(key)) + 1
        start, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        size = end - start
        pair = start[size == 2]
        good = pair[np.bitwise_count(fp[pair] ^ fp[pair + 1]).sum(axis=1) <= self.most_bits]
        found = [np.stack([node[good], node[good + 1]], axis=1)]
        for s, e in zip(start[size > 2], end[size > 2], strict=True):
            own, first = np.unique(node[s:e], return_index=True)
            found.append(np.array(self.group(own, np.ascontiguousarray(fp[s:e][first])), np.int64).reshape(-1, 2))
        both = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        return pa.record_batch([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], names=["a", "b"])

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            fp = np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[2:]], axis=1)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), fp))
            rows += batch.num_rows
            if rows < 200_000:
                continue
            key, node, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key, key[-1]))
            held, rows = [(key[cut:], node[cut:], fp[cut:])], 0
            if cut:
                yield self.links(key[:cut], node[:cut], fp[:cut])
        if held and len(held[0][0]):
            yield self.links(*(np.concatenate(x) for x in zip(*held, strict=True)))


def near_links(classes: DataFrame, scheme: Scheme = FINE) -> DataFrame:
    """(a, b), a < b: links of at most scheme.most_bits differing bits that connect the distinct fingerprints.

    classes: column fp, or for a wide scheme (fp, high, low, codes), fp naming the text; links are candidates there.
    """
    if scheme.wide:
        keyed = classes.select("fp", "high", "low", "codes").mapInArrow(_wide_keyed, "key int, node long, high long, low long")
    else:
        keyed = classes.select("fp").mapInArrow(_keyed, "key long, fp long").select("key", F.col("fp").alias("node"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(Linker(scheme.most_bits, scheme.wide), "a long, b long").distinct()


def _named(docs: DataFrame, *columns: str) -> DataFrame:
    """The given columns, fp, a name of the text, and the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*columns, F.xxhash64(text).alias("fp"), text.alias("text"))


def wide_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, high, low, codes) of every row; fp names the text by a hash."""
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("fp", "high", "low")], T.StructField("codes", T.BinaryType())])
    return _named(docs, "doc_id").mapInArrow(_wide, schema)


@textvec.releasing
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, text) to (fp, shingles), the distinct hashes of the text's shingles."""
    for batch in batches:
        for piece in textvec.pieces(batch, "text"):
            h, _, count = shingles(piece.column(1), SIMILAR.shingle)
            own = [np.unique(x) for x in np.split(h.view(np.int64), np.cumsum(count)[:-1])]
            at = np.cumsum([0, *map(len, own)]).astype(np.int32)
            yield pa.record_batch([piece.column(0), pa.ListArray.from_arrays(at, np.concatenate(own))], names=["fp", "shingles"])


def shingle_sets(links: DataFrame, docs: DataFrame) -> DataFrame:
    """(fp, shingles) of the texts that the links (a, b) name."""
    nodes = materialise(links.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "nodes")
    texts = _named(docs).join(maybe_broadcast(nodes), "fp", "left_semi").groupBy("fp").agg(F.first("text").alias("text"))
    return materialise(texts.mapInArrow(_sets, "fp long, shingles array<long>"), "sets")


def confirmed(links: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the links (a, b) whose sets of shingles have a similarity of SIMILARITY or more.

    A text of many links is dealt to several tasks, about SHARE links to each.
    """
    hubs = {}
    for end in ("a", "b"):
        many = links.groupBy(end).count().filter(F.col("count") > SHARE)
        hubs[end] = maybe_broadcast(materialise(many.select(end, F.floor(F.col("count") / SHARE).alias("last")), "hubs"))
    last = F.coalesce("last", F.lit(0).cast("long"))
    found = links
    for end in ("a", "b"):
        found = found.join(hubs[end], end, "left").withColumn(f"part_{end}", F.pmod(F.xxhash64("a", "b"), last + 1)).drop("last")
    for end in ("a", "b"):
        own = sets.withColumnRenamed("fp", end).join(hubs[end], end, "left")
        own = own.select(end, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias(f"part_{end}"), F.col("shingles").alias(f"set_{end}"))
        found = found.join(own, [end, f"part_{end}"])
    both, (over, under) = F.size(F.array_intersect("set_a", "set_b")), SIMILARITY
    return found.filter((over + under) * both >= over * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def verified(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the links (a, b) whose texts' sets of five-word shingles have a similarity of SIMILARITY or more.

    Sets are made of the linked texts only.
    """
    links = materialise(links, "candidates")
    return confirmed(links, shingle_sets(links, docs))


class Compared:
    """mapInArrow function: rows (cluster, members, queries, query, node, part, shingles), sorted, to links that hold between
    queries and members and join different parts; a block of a cluster is held at a time."""

    def links(self, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        query, node, part = (table.column(k).to_numpy() for k in ("query", "node", "part"))
        sets = table.column("shingles").combine_chunks()
        at = np.append(0, np.cumsum(sets.value_lengths().to_numpy()))
        every = sets.flatten().to_numpy()
        size, there = np.diff(at), np.flatnonzero(~query)
        # Members by shingle: an inverted index.
        held = np.concatenate([every[at[k] : at[k + 1]] for k in there.tolist()]) if len(there) else every[:0]
        owner = np.repeat(np.arange(len(there)), size[there])
        order = np.argsort(held, kind="stable")
        held, owner = held[order], owner[order]
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        over, under = SIMILARITY
        out = []
        for k in np.flatnonzero(query).tolist():
            own = every[at[k] : at[k + 1]]
            low, high = np.searchsorted(held, own, "left"), np.searchsorted(held, own, "right")
            n = high - low
            place = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(owner[place], minlength=len(there))
            near = there[np.flatnonzero(((over + under) * both >= over * (size[k] + size[there])) & (part[there] != part[k]))]
            for other in near[np.unique(part[near], return_index=True)[1]].tolist():
                a, b = top(int(part[k])), top(int(part[other]))
                if a != b:
                    root[a] = b
                    out.append((min(node[k], node[other]), max(node[k], node[other])))
        both = np.array(out, np.int64).reshape(-1, 2)
        yield pa.record_batch([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], names=["a", "b"])

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []
        for batch in batches:
            group = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            edge = [0, *(np.flatnonzero((np.diff(group, axis=0) != 0).any(axis=1)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edge, edge[1:], strict=False):
                if low == high:
                    continue
                if own != (key := tuple(group[low].tolist())):
                    if held:
                        yield from self.links(held)
                    own, held = key, []
                held.append(batch.slice(low, high - low))
        if held:
            yield from self.links(held)


def _compared(state: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that hold between the queries of open clusters and their members, joining different parts.

    state: (cluster, node, part, size, asked, query); asked is how many members of the cluster are queries. Members and
    queries are dealt in blocks, and each block of the ones meets each of the others.
    """
    own = state.join(sets.withColumnRenamed("fp", "node"), "node")
    blocks = lambda n, most: F.floor((F.col(n) - 1) / most).cast("long")
    every = lambda n, most: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n, most)))
    at = lambda n, most: F.pmod(F.xxhash64("node"), blocks(n, most) + 1)
    columns = ["cluster", "members", "queries", "query", "node", "part", "shingles"]
    members = own.withColumn("members", at("size", MEMBERS)).withColumn("queries", every("asked", QUERIES)).withColumn("query", F.lit(False))
    queries = own.filter("query").withColumn("queries", at("asked", QUERIES)).withColumn("members", every("size", MEMBERS))
    rows = members.select(*columns).unionByName(queries.select(*columns))
    key = ["cluster", "members", "queries"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(Compared(), "a long, b long").distinct()


def similar_links(classes: DataFrame, docs: DataFrame, scheme: Scheme = SIMILAR) -> DataFrame:
    """(a, b): pairs of one component, which connect all texts that confirmed links among those that hang together connect."""
    tried = materialise(near_links(classes, scheme), "candidates")
    sets = shingle_sets(tried, docs)
    good = materialise(confirmed(tried, sets), "links")
    up = components(tried)
    cluster = up.unionByName(up.select(F.col("parent").alias("child"), "parent").distinct()).select(F.col("child").alias("node"), F.col("parent").alias("cluster"))
    part = components(good).withColumnsRenamed({"child": "node", "parent": "part"})
    named = materialise(cluster.join(part, "node", "left").withColumn("part", F.coalesce("part", "node")), "parts")
    # Two texts have been compared as candidates. The largest part of a cluster isn't asked.
    sizes = named.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.sum("n").alias("size"), F.max(F.struct("n", "part")).alias("first"), F.count(F.lit(1)).alias("parts"))
    open_ = materialise(sizes.filter("parts > 1 and size > 2").select("cluster", "size", (F.col("size") - F.col("first.n")).alias("asked"), F.col("first.part").alias("first")), "open")
    state = named.join(maybe_broadcast(open_), "cluster").withColumn("query", F.col("part") != F.col("first")).drop("first")
    # Each text with the least of its part stands for the links that held.
    found = materialise(_compared(state, sets), "links")
    return named.filter("node <> part").select(F.col("node").alias("a"), F.col("part").alias("b")).unionByName(found)


def near_duplicates(docs: DataFrame, scheme: Scheme = FINE) -> DataFrame:
    """Every row of docs as (doc_id, fp, root, component_id).

    component_id: the smallest doc_id that links reach, its own included; null only if all of them are null. root names
    the component also then. Rows with equal doc_id are kept apart; other columns of docs are ignored; no rows: none.
    In a wide scheme fp names the text, and links are those that the comparison of shingles confirms, and connect all that
    such links among texts that hang together can connect.
    """
    bounded_batches(docs.sparkSession)
    prints = materialise(wide_fingerprints(docs) if scheme.wide else fingerprints(docs), "fingerprints")
    more = [F.min(c).alias(c) for c in ("high", "low", "codes")] if scheme.wide else []
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), *more), "classes")
    up = components(similar_links(classes, docs, scheme) if scheme.wide else near_links(classes, scheme))
    named = classes.join(up.withColumnRenamed("child", "fp"), "fp", "left").select("fp", "least", F.coalesce("parent", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    member = materialise(named.select("fp", "root").join(least, "root"), "members")
    return prints.join(member, "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, scheme: Scheme = SIMILAR) -> DataFrame:
    """The rows of docs without near duplicates: of each component the document with the smallest doc_id stays.

    Null ids come last. Rows that share a doc_id, or have none, are one document only if their texts are equal.
    """
    found = materialise(near_duplicates(docs, scheme), "near")
    stays = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    gone = materialise(found.filter(~stays & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "gone")
    left = docs.join(maybe_broadcast(gone), "doc_id", "left_anti")
    if found.filter("doc_id is null and component_id is not null").limit(1).count():
        left = left.filter("doc_id is not null")
    name = "again"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    again = materialise(found.filter(stays).groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(name)), "again")
    if not again.limit(1).count():
        return left
    same = F.col("doc_id").eqNullSafe(F.col(name))
    again = maybe_broadcast(again)
    return left.join(again, same, "left_anti").union(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def digest(found: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
