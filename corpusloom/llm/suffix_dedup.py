"""Passages of WINDOW words that repeat across documents, by prefix-partitioned suffix trees.

A word is removed if a window of WINDOW words covers it whose words also start in a document with a smaller doc_id.

1. Anchors. Of the ANCHOR-word runs in a window, the one with the least hash stands for it (winnowing), so equal
   windows have equal anchors, and neighbouring windows mostly share theirs. Anchors are dealt by hash, and those of
   two documents or more are marked in a bitmap. Its size follows their number up to MOST_BITS; a fuller bitmap lets
   more suffixes through but never loses one. The same pass counts anchors by their first words, for each of LENGTHS.
2. Prefixes. Suffixes of windows with a marked anchor are dealt by the first words of the anchor: the shortest prefix
   that at most GROUP anchors have, up to a whole anchor, and groups are packed into parts of about that many:
   variable-length prefixes, groups that fit memory. The suffixes of neighbouring windows with one anchor go together
   as the stretch of words that they begin in, 40 bits of hash for each word. Of equal stretches within a buffer only those of the smallest doc_id go; the others are already known to be repeats and go on as spans,
   so a passage that fills a third of the corpus sends one document's suffixes per buffer.
3. Subtrees. A part's suffixes are sorted by their words, and the words that neighbours have in common make up the
   tree: runs of neighbours with WINDOW words or more in common are its deep internal nodes, each as deep as its
   members agree, to the end of their stretches. Leaves of other than a node's smallest doc_id are repeats. Maximal
   repeats longer than a stretch are the unions of neighbouring ones, as spans.

Words are compared one by one, by 40 bits of hash each; hashes of whole windows only bring candidates together.

Defined results: a null text has no words; a null doc_id is never smaller and never loses words; rows with equal
doc_id are one document, so that they don't repeat each other; texts under WINDOW words are kept whole; other columns
are ignored; a very long text is a piece of its own; no rows: none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import textvec
from corpusloom.llm.common import materialise

WINDOW = 13
ANCHOR = 7
#: Neighbouring windows that can share an anchor, and the words of their stretch: the depth of the trees.
WINDOWS = WINDOW - ANCHOR + 1
DEPTH = WINDOW + WINDOWS - 1
#: Lengths of prefixes, in words of the anchor.
LENGTHS = (1, 2, 3, 5, 7)
#: Anchors in a group and in a part; each stands for up to WINDOWS suffixes.
GROUP = 250_000
#: Stretches that a task gathers before it combines them; of anchors, four times as many.
BUFFER = 150_000
#: Buckets of prefixes: at least and at most, and so many whose counts are summed together.
FEWEST_BUCKET_BITS, MOST_BUCKET_BITS = 10, 18
SLICE = 1 << 10
MOST_BITS = 29
#: Spans of at most so many documents, and so many bytes, are broadcast; beyond, the join shuffles.
SPAN_ROWS, SPAN_BYTES = 250_000, 32 << 20
_U = np.uint64


class Windows:
    """The windows of a piece: where each starts, its text, its anchor, and the words' hashes."""

    def __init__(self, texts: pa.Array) -> None:
        w = textvec.words(texts)
        self.h, self.at = w.hashes, w.at
        n = len(self.h) - WINDOW + 1
        if n <= 0:
            self.start = self.text = np.zeros(0, np.int64)
            self.anchor = self.run = np.zeros(0, np.uint64)
            return
        self.run = run = textvec.combine(self.h, ANCHOR)
        two = np.minimum(run[:-1], run[1:])
        four = np.minimum(two[:-2], two[2:])
        least = np.minimum(four[:-3], four[3:])
        end_of = np.repeat(self.at[1:], np.diff(self.at))
        self.start = np.flatnonzero(np.arange(n) + WINDOW <= end_of[:n])
        self.text = np.searchsorted(self.at, self.start, "right") - 1
        self.anchor = least[self.start]

    def stretches(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the chosen windows, those that begin a stretch, and how many it has: neighbours with one anchor."""
        at = np.flatnonzero(own)
        apart = np.append(True, (at[1:] != at[:-1] + 1) | (self.text[at[1:]] != self.text[at[:-1]]) | (self.anchor[at[1:]] != self.anchor[at[:-1]]))
        run = np.maximum.accumulate(np.where(apart, np.arange(len(at)), 0))
        first = np.flatnonzero((np.arange(len(at)) - run) % WINDOWS == 0) if len(at) else at
        return at[first], np.diff(np.append(first, len(at)))

    def prefixes(self, at: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        """Bucket of the first words of the anchors of windows, for each of LENGTHS in turn."""
        start = self.start[at]
        for k in reversed(range(WINDOWS)):
            start = np.where(self.run[self.start[at] + k] == self.anchor[at], self.start[at] + k, start)
        h = np.zeros(len(start), np.uint64)
        for before, length in zip((0, *LENGTHS), LENGTHS, strict=False):
            with np.errstate(over="ignore"):
                for k in range(before, length):
                    h = h * _U(0x9E3779B97F4A7C15) + self.h[start + k]
                yield (textvec.mix64(h) >> _U(64 - bits)).astype(np.int64)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by their first column, a part at a time."""
    part, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != part and rows:
                yield part, rows
                rows = []
            part = row[0]
            rows.append(row[1:])
    if rows:
        yield part, rows


def _array(blobs: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


class Anchors:
    """mapInArrow function: (doc_id, text) to anchors by part, and the counts of prefixes, a part for each SLICE of buckets."""

    def __init__(self, part_bits: int, bucket_bits: int) -> None:
        self.part_bits, self.bucket_bits, self.buffer = part_bits, bucket_bits, 4 * BUFFER

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(LENGTHS), 1 << self.bucket_bits), np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        names = ["part", "anchors", "docs", "several"]

        def combined() -> pa.RecordBatch:
            anchor, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, anchor))
            anchor, doc = anchor[order], doc[order]
            first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            last = np.append(first[1:], len(anchor)) - 1
            several = (doc[first] != doc[last]).astype(np.uint8)
            anchor, doc = anchor[first], doc[first]
            edges = np.searchsorted(anchor, np.arange(1, 1 << self.part_bits, dtype=np.uint64) << _U(64 - self.part_bits)) if self.part_bits else []
            parts = [(k, a.tobytes(), d.tobytes(), s.tobytes()) for k, (a, d, s) in enumerate(zip(*(np.split(x, edges) for x in (anchor, doc, several)), strict=True)) if len(a)]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=names)

        for batch in batches:
            for piece in textvec.pieces(batch, "text"):
                w = Windows(piece.column(1))
                if not len(w.start):
                    continue
                first, _ = w.stretches(np.ones(len(w.start), bool))
                for k, bucket in enumerate(w.prefixes(first, self.bucket_bits)):
                    counts[k] += np.bincount(bucket, minlength=1 << self.bucket_bits)
                held.append((w.anchor[first], piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[w.text[first]]))
                rows += len(first)
                if rows >= self.buffer:
                    yield combined()
                    held, rows = [], 0
        if rows:
            yield combined()
        if counts.any():
            for k, own in enumerate(np.split(counts, counts.shape[1] // SLICE, axis=1)):
                yield pa.record_batch([pa.array([(1 << self.part_bits) + k], pa.int32()), pa.array([own.astype("<u4").tobytes()]), pa.array([b""]), pa.array([b""])], names=names)


class Repeated:
    """mapInArrow function: a part's anchors to those of two documents or more; the counts to their sum."""

    def __init__(self, part_bits: int) -> None:
        self.part_bits = part_bits

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            if part >= 1 << self.part_bits:
                out = np.sum([np.frombuffer(r[0], "<u4").astype(np.int64) for r in rows], axis=0)
            else:
                anchor, doc, several = (_array([r[k] for r in rows], t) for k, t in enumerate(("<u8", "<i8", "u1")))
                order = np.argsort(anchor, kind="stable")
                anchor, doc, several = anchor[order], doc[order], several[order]
                first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
                twice = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)) | (np.maximum.reduceat(several, first) > 0)
                out = anchor[first[twice]]
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([len(out)], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["part", "n", "body"])


class Slices:
    """mapInArrow function: a part's repeated anchors to its slice of the bitmap."""

    def __init__(self, part_bits: int, bits: int) -> None:
        self.part_bits, self.bits = part_bits, bits

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                marks = np.zeros(1 << (self.bits - self.part_bits), np.uint8)
                marks[(np.frombuffer(body, "<u8") >> _U(64 - self.bits)).astype(np.int64) & (len(marks) - 1)] = 1
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()])], names=["part", "body"])


def _groups(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """For each length of prefix and bucket its part, -1 where more words are needed; and the number of parts."""
    parts = np.full(counts.shape, -1, np.int64)
    filled, part, left = 0.0, 0, 1.0
    whole = max(1, int(counts[0].sum()))
    for k in range(len(counts)):
        fits = (counts[k] <= GROUP) | (k == len(counts) - 1)
        for b in np.flatnonzero(fits).tolist():
            # Longer prefixes are counted under all first words; about the share that is left comes here.
            own = float(counts[k, b]) * left
            if filled and filled + own > GROUP:
                filled, part = 0.0, part + 1
            parts[k, b] = part
            filled += own
        if fits.all():
            break
        left = min(left, int(counts[k, ~fits].sum()) / whole)
    return parts, part + 1


def _split(order: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
    """order, cut where the value changes."""
    return np.split(order, np.flatnonzero(np.diff(value[order])) + 1) if len(order) else []


def _by_bucket(doc: np.ndarray, key: np.ndarray, place: np.ndarray, windows: np.ndarray, buckets: int, first: int = 0) -> Iterator[pa.RecordBatch]:
    """Runs of windows to the spans that they cover, a row for each bucket of documents."""
    with np.errstate(over="ignore"):
        bucket = (textvec.mix64(doc.view(np.uint64)) % _U(buckets)).astype(np.int64)
    for own in _split(np.lexsort((place, key, doc, bucket)), bucket):
        d, k, at = doc[own], key[own], place[own].astype(np.int64)
        end = at + windows[own] + WINDOW - 1
        text = np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1]))
        begins = text | np.append(True, at[1:] > end[:-1])
        spans = np.stack([at[begins], end[np.append(begins[1:], True)]], axis=1).astype("<u4")
        counts = np.add.reduceat(begins.astype("<u4"), np.flatnonzero(text)).astype("<u4")
        yield _row(first + int(bucket[own[0]]), d[text], k[text], counts, spans, b"", b"")


#: Stretches for the trees: (docs, keys, which of them with the number of windows, place, high, low); or spans:
#: (docs, keys, counts, spans).
BLOBS = "part int, a binary, b binary, c binary, d binary, e binary, f binary"


def _row(part: int, *blobs) -> pa.RecordBatch:
    body = [x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in blobs]
    return pa.record_batch([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in body)], names=["part", *"abcdef"])


class Suffixes:
    """mapInArrow function: (doc_id, key, text) to suffixes by part, and spans that are known to be repeats."""

    def __init__(self, bitmap, bits: int, bucket_bits: int, parts: np.ndarray, n: int) -> None:
        self.bitmap, self.bits, self.bucket_bits, self.parts, self.n, self.buffer = bitmap, bits, bucket_bits, parts, n, BUFFER

    def candidates(self, marks: np.ndarray, piece: pa.RecordBatch) -> tuple[np.ndarray, ...] | None:
        """Words of the piece, and of each stretch: start, windows, doc_id, key, place in the text, part, two labels."""
        w = Windows(piece.column(2))
        slot = (w.anchor >> _U(64 - self.bits)).astype(np.int64)
        at, windows = w.stretches(marks[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0)
        if not len(at):
            return None
        part = np.full(len(at), -1, np.int64)
        for k, bucket in enumerate(w.prefixes(at, self.bucket_bits)):
            left = part < 0
            part[left] = self.parts[k][bucket[left]]
            if not left.any():
                break
        start, text, label = w.start[at], w.text[at], textvec.combine(w.h, WINDOW)
        doc, key = (piece.column(k).to_numpy(zero_copy_only=False).astype(np.int64)[text] for k in (0, 1))
        return w.h, start, windows, doc, key, (start - w.at[text]).astype("<u4"), part, label[start], label[start + windows - 1]

    def combined(self, held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        base = np.cumsum([0, *(len(x[0]) for x in held[:-1])])
        # 0 is the end of a stretch.
        every = np.maximum(np.concatenate([x[0] for x in held]) >> _U(24), _U(1))
        start = np.concatenate([x[1] + b for x, b in zip(held, base, strict=True)])
        windows, doc, key, place, part, head, tail = (np.concatenate([x[k] for x in held]) for k in range(2, 9))
        words = np.zeros((DEPTH, len(start)), np.uint64)
        for k in range(DEPTH):
            there = windows + WINDOW - 1 > k
            words[k, there] = every[start[there] + k]
        order = np.lexsort((doc, windows, tail, head))
        first = np.zeros(len(order), bool)
        first[:1] = True
        for x in (windows, tail, head):
            first[1:] |= x[order[1:]] != x[order[:-1]]
        lead = order[np.flatnonzero(first)][np.cumsum(first) - 1]
        known = doc[order] > doc[lead]
        for row in words:
            known &= row[order] == row[lead]
        again = order[known]
        yield from _by_bucket(doc[again], key[again], place[again], windows[again], self.n, self.n)
        tree = order[~known]
        for own in _split(tree[np.lexsort((*words[2::-1, tree], part[tree]))], part):
            documents, which = np.unique(np.stack([doc[own], key[own]]), axis=1, return_inverse=True)
            body = words[:, own]
            yield _row(int(part[own[0]]), documents[0], documents[1], (which << 3 | windows[own]).astype("<u4"), place[own], (body >> _U(8)).astype("<u4"), body.astype(np.uint8))

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(self.bitmap.value, np.uint8)
        held: list[tuple[np.ndarray, ...]] = []
        rows = words = 0
        for batch in batches:
            for piece in textvec.pieces(batch, "text"):
                found = self.candidates(marks, piece)
                if found:
                    held.append(found)
                    rows, words = rows + len(found[1]), words + len(found[0])
                if rows >= self.buffer or words >= 4 * self.buffer:
                    yield from self.combined(held)
                    held, rows, words = [], 0, 0
        if held:
            yield from self.combined(held)


def sorted_suffixes(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """words: a column for each suffix, numbers up to size, 0 after its end. The suffixes' order, and how many words
    each has in common with the one before."""
    bits = max(1, int(size).bit_length())
    step, keys = 64 // bits, []
    for low in range(0, len(words), step):
        key = np.zeros(words.shape[1], np.uint64)
        for row in words[low : low + step]:
            key = key << _U(bits) | row.astype(np.uint64)
        keys.append(key)
    order = np.lexsort(keys[::-1])
    del keys
    common, equal = np.zeros(len(order), np.uint8), np.ones(max(0, len(order) - 1), bool)
    for row in words:
        own = row[order]
        equal &= (own[1:] == own[:-1]) & (own[1:] > 0)
        common[1:] += equal
    return order, common


def deep_nodes(common: np.ndarray, least: int = WINDOW, most: int = DEPTH) -> np.ndarray:
    """The internal nodes of ``least`` words or more: rows (first leaf, leaf after the last, depth in words).

    A node's depth is what its leaves have in common; at ``most`` words the tree ends. They nest by their leaves.
    """
    out = [np.zeros((0, 3), np.int64)]
    for depth in range(least, most + 1):
        first = np.flatnonzero(common < depth)
        after = np.append(first[1:], len(common))
        inner = np.where(common < depth, np.uint8(255), common)
        own = (after - first > 1) & (np.minimum.reduceat(inner, first) == depth) if len(first) else np.zeros(0, bool)
        out.append(np.stack([first[own], after[own], np.full(own.sum(), depth)], axis=1))
    return np.concatenate(out)


class Subtrees:
    """mapInArrow function: a part's suffixes to spans of repeats by bucket of document; known spans go through."""

    def __init__(self, n: int) -> None:
        self.n = n

    def tree(self, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        marked = [np.frombuffer(r[2], "<u4") for r in rows]
        high, low = (np.concatenate([np.frombuffer(r[k], t).reshape(DEPTH, -1) for r in rows], axis=1) for k, t in ((4, "<u4"), (5, "u1")))
        every, rank = np.unique(np.append(high.astype(np.uint64) << _U(8) | low, _U(0)), return_inverse=True)
        stretch = rank[:-1].astype(np.uint32).reshape(high.shape)
        del high, low, rank
        doc, key = (np.concatenate([np.frombuffer(r[k], "<i8")[x >> 3] for r, x in zip(rows, marked, strict=True)]) for k in (0, 1))
        place, windows = np.frombuffer(b"".join(r[3] for r in rows), "<u4"), np.concatenate(marked) & 7
        # Each window of a stretch begins a suffix.
        owner = [np.flatnonzero(windows > k) for k in range(WINDOWS)]
        words, at = np.zeros((DEPTH, sum(map(len, owner))), np.uint32), 0
        for k, own in enumerate(owner):
            words[: DEPTH - k, at : at + len(own)] = stretch[k:, own]
            at += len(own)
        place = np.concatenate([place[own] + k for k, own in enumerate(owner)])
        doc, key = (x[np.concatenate(owner)] for x in (doc, key))
        order, common = sorted_suffixes(words, len(every))
        # The outermost deep nodes: what is below them shares the window, too.
        first = np.flatnonzero(common < WINDOW)
        least = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(order))))
        again = order[doc[order] > least]
        if len(again):
            yield from _by_bucket(doc[again], key[again], place[again], np.ones(len(again), np.int64), self.n)

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            if part < self.n:
                yield from self.tree(rows)
            else:
                for r in rows:
                    yield _row(part - self.n, *r)


@textvec.releasing
def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's spans to (doc_id, key, spans): those of each document, overlapping ones made one."""
    for _, rows in _by_part(batches):
        counts = _array([r[2] for r in rows], "<u4")
        doc, key = (np.repeat(_array([r[k] for r in rows], "<i8"), counts) for k in (0, 1))
        spans = _array([r[3] for r in rows], "<u4").reshape(-1, 2).astype(np.int64)
        order = np.lexsort((spans[:, 0], key, doc))
        doc, key, start, end = doc[order], key[order], spans[order, 0], spans[order, 1]
        text = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))
        shift = np.cumsum(text) << 33
        reach = np.maximum.accumulate(end + shift) - shift
        first = text | np.append(True, start[1:] > reach[:-1])
        last = np.append(first[1:], True)
        merged = np.stack([start[first], reach[last]], axis=1).astype("<u4")
        cuts = np.flatnonzero(text[first])
        body = [x.tobytes() for x in np.split(merged, cuts[1:])]
        for low in range(0, len(body), 10_000):
            at = np.flatnonzero(text)[low : low + 10_000]
            yield pa.record_batch([pa.array(doc[at]), pa.array(key[at]), pa.array(body[low : low + 10_000], pa.binary())], names=["doc_id", "key", "spans"])


def _dealt(rows: DataFrame, parts: int, f: Callable, schema: str) -> DataFrame:
    """Rows to their part, a task for each part and the bucket of the same number, then f."""
    return rows.repartitionById(parts, (F.col("part") % parts).cast("int")).sortWithinPartitions("part").mapInArrow(f, schema)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans): documents with words to remove; key is xxhash64 of the text, spans are uint32 pairs."""
    spark = docs.sparkSession
    plain = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    part_bits = max(3, int(size // (32 * GROUP)).bit_length())
    bucket_bits = min(MOST_BUCKET_BITS, max(FEWEST_BUCKET_BITS, int(size // (8 * GROUP)).bit_length() + 8))
    counted = 1 << part_bits
    anchors = plain.mapInArrow(Anchors(part_bits, bucket_bits), "part int, anchors binary, docs binary, several binary")
    found = materialise(_dealt(anchors, counted + (1 << bucket_bits) // SLICE, Repeated(part_bits), "part int, n long, body binary"), "anchors")
    total = found.filter(F.col("part") < counted).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(part_bits + 3, 16, min(MOST_BITS, (32 * total).bit_length()))
    bitmap = bytearray(1 << (bits - 3))
    step = 1 << (bits - 3 - part_bits)
    # The slices make up one bitmap of at most 2**MOST_BITS bits.
    for r in found.filter(F.col("part") < counted).mapInArrow(Slices(part_bits, bits), "part int, body binary").toLocalIterator():
        bitmap[r["part"] * step : (r["part"] + 1) * step] = r["body"]
    counts = np.zeros((len(LENGTHS), 1 << bucket_bits), np.int64)
    for r in found.filter(F.col("part") >= counted).toLocalIterator():
        low = (r["part"] - counted) * SLICE
        counts[:, low : low + SLICE] = np.frombuffer(r["body"], np.int64).reshape(len(LENGTHS), -1)
    parts, n = _groups(counts)
    sent = spark.sparkContext.broadcast(bytes(bitmap))
    keyed = plain.select("doc_id", F.xxhash64("text").alias("key"), "text")
    again = _dealt(keyed.mapInArrow(Suffixes(sent, bits, bucket_bits, parts, n), BLOBS), n, Subtrees(n), BLOBS)
    return materialise(_dealt(again, n, _spans, "doc_id long, key long, spans binary"), "spans")


def kept_words(text: bytes, spans: bytes | None) -> tuple[int, list[bytes]]:
    """The number of words, and those outside the spans."""
    words = text.split()
    if not spans:
        return len(words), words
    kept, done = [], 0
    for a, b in np.frombuffer(spans, "<u4").reshape(-1, 2).tolist():
        kept += words[done:a]
        done = b
    return len(words), kept + words[done:]


class Remover:
    """mapInArrow function: (doc_id, text, spans) to the digest of what is kept, or with texts to the kept words."""

    def __init__(self, texts: bool) -> None:
        self.texts = texts

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for low in range(0, batch.num_rows, 512):
                rows = [kept_words(t.as_py() or b"", s.as_py()) for t, s in zip(texts[low : low + 512], batch.column(2)[low : low + 512], strict=True)]
                joined = [b" ".join(k) for _, k in rows]
                last = pa.array([j.decode() for j in joined]) if self.texts else pa.array([hashlib.sha256(j).hexdigest() for j in joined])
                yield pa.record_batch([batch.column(0)[low : low + 512], pa.array([n for n, _ in rows], pa.int64()), pa.array([n - len(k) for n, k in rows], pa.int64()), last], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, and kept_sha256 or with texts kept_text) of every row."""
    spans = repeats(docs)
    rows, size = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("spans")), F.lit(0))).first()
    if rows <= SPAN_ROWS and size <= SPAN_BYTES:
        spans = F.broadcast(spans)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    plain = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = spans.select(F.col("doc_id").alias("at"), "key", "spans")
    joined = plain.join(named, (F.col("doc_id").cast("long") == F.col("at")) & (F.xxhash64("text") == F.col("key")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(Remover(texts), schema).withColumnRenamed("kept", "kept_text" if texts else "kept_sha256")


ORACLE_SQL = r"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, unnest(w) AS x, unnest(range(len(w))) AS i FROM t),
win AS (SELECT rid, doc_id, w, unnest(range(len(w) - 12)) AS i FROM t WHERE len(w) >= 13 AND doc_id IS NOT NULL),
runs AS (SELECT rid, doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS run FROM win),
again AS (SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY run) AS first FROM runs) WHERE doc_id > first),
gone AS MATERIALIZED (SELECT DISTINCT rid, i + k AS i FROM again, range(13) r(k)),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS body FROM p ANTI JOIN gone USING (rid, i) GROUP BY rid),
removed AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM t LEFT JOIN removed USING (rid) LEFT JOIN kept USING (rid)
"""
