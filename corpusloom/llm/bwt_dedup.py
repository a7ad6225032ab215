"""Bytes of strings of LENGTH bytes that occur elsewhere, by threshold-bounded expansion on Burrows-Wheeler transforms.

A byte is removed if a string of LENGTH bytes covers it that also starts anywhere else, in the same document too.

1. Stretches. Of the GRAM-byte runs in a window of LENGTH bytes the one with the least hash, the leftmost of equal ones,
   is its anchor (winnowing), so that equal windows have equal anchors at equal offsets. Neighbouring windows with one
   anchor are a stretch, named by 128 bits of hash of its bytes, and a text by 128 bits of SHA-256.
2. Groups. Stretches are grouped by anchor. Equal stretches are repeats as they are; one of them stays in the group, so
   that copies, be they a third of all rows, meet in partial aggregates. Groups of one stretch are done. Groups of
   over GROUP different stretches are dealt anew by longer anchors: windows with offsets in a class of WIDTHS[1] share
   all but that many bytes, whose hash is the key; at last each window is a class, and a key's windows are all equal.
   So no group is larger than GROUP, and nothing is left out.
3. Transform. Groups are packed into parts by hash, the text of a part is about PART bytes. A part's suffixes are
   sorted by LENGTH bytes and more, every piece with an end mark of its own, and give the Burrows-Wheeler transform.
4. Expansion. Intervals of suffixes with a common prefix are extended backward, breadth first: from the interval of w the
   transform gives those of all cw. Level by level the boundaries that are closed for the first time have a common
   prefix of 0, 1, 2, ... bytes, and only intervals that close one are kept. It stops before LENGTH: boundaries that are
   open then lie between suffixes that agree in LENGTH bytes or more, which are repeats.
5. Spans of repeats are put together by text and joined back.

Defined results: a null text is empty; repeated rows are documents of their own, whose texts repeat each other; doc_id is
handed through, null or not; texts under LENGTH bytes are kept whole; other columns are ignored; a text longer than PIECE
is worked on in overlapping pieces; no rows: none. What is kept may begin or end within a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import textvec
from corpusloom.llm.common import hub_join, materialise, maybe_broadcast

LENGTH, GRAM = 400, 32
#: Offsets of an anchor in a window that make up a class, for each way to deal stretches: all, some, one.
WIDTHS = (LENGTH - GRAM + 1, 48, 1)
#: Different stretches in a group, bytes of text in a part, parts that a task does one after another, and bytes of text that
#: are hashed at once. The arrays of a part are looked up all over: small ones stay in a core's cache.
GROUP, PART, PARTS, PIECE = 1000, 1 << 17, 8, 1 << 19
#: Merged spans of at most so many texts, and so many bytes, are broadcast; beyond, the join shuffles.
SPAN_ROWS, SPAN_BYTES = 250_000, 32 << 20
STRETCH = "key long, label binary, tid binary, at long, n int, off int"


def _label(body: memoryview) -> bytes:
    return xxhash.xxh3_128_digest(body)


def _stretches(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Texts put together, and where each begins, to (text, start, windows, anchor's offset, anchor's hash) of stretches."""
    h = textvec.grams(body, GRAM)
    anchor = textvec.sliding_argmin(h, LENGTH - GRAM + 1)
    end = np.repeat(at[1:], np.diff(at))[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= end)
    anchor = anchor[start]
    first = np.flatnonzero(np.append(True, (np.diff(start) != 1) | (np.diff(anchor) != 0))) if len(start) else start
    begin = start[first]
    return np.searchsorted(at, begin, "right") - 1, begin, np.diff(np.append(first, len(start))), anchor[first] - begin, h[anchor[first]]


@textvec.releasing
def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, text) to stretches."""
    for batch in batches:
        for piece in textvec.pieces(batch, "text", PIECE):
            body, at = textvec.raw(piece.column(1))
            tids = piece.column(0)
            for low in range(0, max(1, len(body)), PIECE):
                # Only a text by itself is longer than a piece; windows that begin in a part of it are whole.
                own = body[low : low + PIECE + LENGTH - 1] if len(body) > PIECE else body
                text, start, n, off, h = _stretches(own, at if own is body else np.array([0, len(own)]))
                if len(start):
                    view = memoryview(own)
                    labels = [_label(view[s : s + k + LENGTH - 1]) for s, k in zip(start.tolist(), n.tolist(), strict=True)]
                    place = start - (at[text] if own is body else 0) + (0 if own is body else low)
                    yield _rows(h.view(np.int64), labels, tids.take(pa.array(text)), place, n, off)
                if own is body:
                    break


def _rows(key: np.ndarray, labels: list[bytes], tids: pa.Array, at: np.ndarray, n: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(key), pa.array(labels, pa.binary()), tids.cast(pa.binary()), pa.array(at.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32))], names=["key", "label", "tid", "at", "n", "off"])


class Refined:
    """mapInArrow function: (tid, text, stretches of it) to stretches of classes of ``width`` offsets."""

    def __init__(self, width: int) -> None:
        self.width = width

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = self.width
        for batch in batches:
            for tid, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                view = memoryview(text.encode())
                out = []
                for x in own:
                    anchor, last = x["at"] + x["off"], x["off"] - x["n"] + 1
                    for k in range(last // w, x["off"] // w + 1):
                        # Windows with offsets from k * w on: the latest start first.
                        most, least = min(x["off"], k * w + w - 1), max(last, k * w)
                        at, n = anchor - most, most - least + 1
                        core = view[anchor - k * w : anchor - k * w - w + 1 + LENGTH]
                        key = xxhash.xxh3_64_intdigest(core, k)
                        out.append((key - (key >> 63 << 64), _label(view[at : at + n + LENGTH - 1]), at, n, most))
                if out:
                    key, labels, at, n, off = zip(*out, strict=True)
                    yield _rows(np.array(key, np.int64), list(labels), pa.array([tid] * len(out), pa.binary()), np.array(at), np.array(n), np.array(off))


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by ``depth`` symbols at least, and their ranks. symbols: 0 ends a piece, and sorts by place."""
    n = len(symbols)
    padded = np.append(symbols, np.zeros(7, np.int64)).astype(np.uint64)
    key, live = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(7):
        key = key << np.uint64(9) | np.where(live, padded[k : k + n], np.uint64(0))
        live &= padded[k : k + n] > 0
    order = np.argsort(key)
    slots = np.flatnonzero(~live[order])
    own = order[slots]
    order[slots] = own[np.lexsort((own, key[own]))]
    # Ends differ from each other, and so do all that reach one.
    new = np.append(True, (key[order[1:]] != key[order[:-1]]) | ~live[order[1:]])
    at = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    done = 7
    while done < depth:
        size = np.diff(np.append(np.flatnonzero(new), n))
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_):
            break
        own = order[open_]
        pair = rank[own] << 32 | rank[own + done]
        way = np.argsort(pair)
        own, pair = own[way], pair[way]
        order[open_] = own
        new[open_] |= np.append(True, pair[1:] != pair[:-1])
        rank[own] = np.maximum.accumulate(np.where(new, at, 0))[open_]
        done *= 2
    return order, rank


def transform(symbols: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform, 0 where a piece begins, and for each of its places where the suffix that begins
    with that symbol stands, counted as the transform counts it."""
    bwt = symbols[order - 1]
    by = np.argsort(bwt, kind="stable")
    up = np.empty(len(bwt), np.int64)
    # As many pieces begin as end, so the counts of smaller symbols are the same on both sides.
    up[by] = np.arange(len(bwt))
    return bwt, up


def open_boundaries(bwt: np.ndarray, up: np.ndarray, least: int) -> np.ndarray:
    """Of each suffix whether it has ``least`` symbols in common with the one before it.

    Level by level: from intervals whose suffixes share w, a symbol longer at each, the transform gives those of cw. Where
    such an interval ends, the next suffix shares no more than w's length with it: that closes the boundary, if none
    did so before, and only intervals that close one are extended further.
    """
    n = len(bwt)
    open_ = np.ones(n + 1, bool)
    open_[[0, n]] = False
    place = np.argsort(bwt, kind="stable")
    symbols, first = np.unique(bwt[place], return_index=True)
    edges = np.append(first, n)
    ends = int(edges[1]) if symbols[0] == 0 else 0
    many, bits, by_place = 256, n.bit_length(), bwt[place]
    # A byte each, for they are looked up all over: whether a symbol is no piece's beginning, and whether it is the first of its kind.
    goes_on, other = bwt > 0, np.append(True, by_place[1:] != by_place[:-1])
    # A symbol's place among all that are no greater, from a symbol and a place in the transform.
    ranks, base = by_place * (n + 1) + place, symbols[symbols > 0] * (n + 1)
    i, j = np.array([0]), np.array([n])
    for level in range(least):
        size = j - i
        low, high = [], []
        one = i[size == 1]
        one = up[one[goes_on[one]]]
        low.append(one)
        high.append(one + 1)
        some = (size > 1) & (size <= many)
        if some.any():
            a, size_ = i[some], size[some]
            which = np.repeat(np.arange(len(a)), size_)
            at = np.arange(len(which)) - np.repeat(np.cumsum(size_) - size_, size_) + a[which]
            keep = goes_on[at]
            # The suffixes of an interval and a symbol stand together, apart from all others of this level.
            both = up[at[keep]] << bits | which[keep]
            both.sort()
            to, which = both >> bits, both & (1 << bits) - 1
            new = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (to[1:] != to[:-1] + 1) | other[to[1:]])) if len(to) else to
            low.append(to[new])
            high.append(to[np.append(new[1:], len(to)) - 1] + 1 if len(to) else to)
        large = size > many
        if large.any():
            a, b = (np.searchsorted(ranks, (base + x[large, None]).ravel()) for x in (i, j))
            low.append(a[a < b])
            high.append(b[a < b])
        if level == 0:
            # The ends of pieces are symbols of their own.
            low.append(np.arange(ends))
            high.append(np.arange(1, ends + 1))
        i, j = np.concatenate(low), np.concatenate(high)
        fresh = open_[j]
        i, j = i[fresh], j[fresh]
        open_[j] = False
        if not len(i):
            break
    return open_[:n]


def repeated(pieces: list[bytes], least: int = LENGTH) -> list[np.ndarray]:
    """Of each piece the starts of strings of ``least`` bytes that start elsewhere, too."""
    size = np.array([len(p) for p in pieces])
    begin = np.cumsum(size + 1) - size - 1
    symbols = np.zeros(int(size.sum()) + len(pieces), np.int64)
    inside = np.ones(len(symbols), bool)
    inside[begin + size] = False
    symbols[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1
    order, _ = suffix_order(symbols, least)
    bwt, up = transform(symbols, order)
    same = open_boundaries(bwt, up, least)
    found = np.zeros(len(symbols), bool)
    found[order[same | np.append(same[1:], False)]] = True
    return [np.flatnonzero(found[b : b + s]) for b, s in zip(begin.tolist(), size.tolist(), strict=True)]


class Repeats:
    """mapInArrow function: (part, tid, at, body), sorted by part, to spans (tid, start, end)."""

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != part and held:
                    yield self.spans(held)
                    held = []
                part = row[0]
                held.append(row[1:])
        if held:
            yield self.spans(held)

    def spans(self, rows: list[tuple]) -> pa.RecordBatch:
        tids, start, end = [], [], []
        for (tid, at, _), found in zip(rows, repeated([r[2] for r in rows]), strict=True):
            if len(found):
                edge = np.flatnonzero(np.diff(found) > 1)
                first, last = found[np.append(0, edge + 1)], found[np.append(edge, len(found) - 1)]
                tids += [tid] * len(first)
                start += (at + first).tolist()
                end += (at + last + LENGTH).tolist()
        return pa.record_batch([pa.array(tids, pa.binary()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["tid", "start", "end"])


@textvec.releasing
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, text, places (part, at, n)) to (part, tid, at, body)."""
    for batch in batches:
        for tid, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            body = text.encode()
            bodies = [body[x["at"] : x["at"] + x["n"] + LENGTH - 1] for x in own]
            yield pa.record_batch([pa.array([x["part"] for x in own], pa.int32()), pa.array([tid] * len(own), pa.binary()), pa.array([x["at"] for x in own], pa.int64()), pa.array(bodies, pa.binary())], names=["part", "tid", "at", "body"])


@textvec.releasing
def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, spans) to (tid, spans as pairs of int64), overlapping and touching ones made one."""
    for batch in batches:
        bodies = []
        for own in batch.column(1):
            both = np.array([(x["start"], x["end"]) for x in own.as_py()], np.int64)
            both = both[np.argsort(both[:, 0], kind="stable")]
            reach = np.maximum.accumulate(both[:, 1])
            new = np.append(True, both[1:, 0] > reach[:-1])
            bodies.append(np.stack([both[new, 0], reach[np.append(new[1:], True)]], axis=1).astype("<i8").tobytes())
        yield pa.record_batch([batch.column(0).cast(pa.binary()), pa.array(bodies, pa.binary())], names=["tid", "spans"])


def _named(docs: DataFrame, *columns: str) -> DataFrame:
    """The given columns, the text, and its name."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*columns, text.alias("text")).select(*columns, F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("tid"), "text")


def _with_texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(tid, text, places): the texts that places names, each once, with all its places."""
    own = materialise(places.groupBy("tid").agg(F.collect_list(F.struct(*[c for c in places.columns if c != "tid"])).alias("places")), "places")
    texts = _named(docs).join(maybe_broadcast(own.select("tid")), "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text"))
    return texts.join(own, "tid").select("tid", "text", "places")


def repeats(docs: DataFrame) -> DataFrame:
    """(tid, start, end): spans of repeats, overlapping ones too, of the texts that tid names."""
    found, again = [], _named(docs).filter(F.octet_length("text") >= LENGTH).select("tid", "text").mapInArrow(_first, STRETCH)
    for width in WIDTHS:
        # Rows of equal texts are one here.
        own = materialise(again.groupBy("key", "label", "tid", "at", "n", "off").agg(F.count(F.lit(1)).alias("rows")), "stretches")
        each = own.groupBy("key", "label").agg(F.sum("rows").alias("copies"), F.count(F.lit(1)).alias("places"), F.min(F.struct("tid", "at", "n", "off")).alias("one"))
        each = materialise(each, "different")
        total = own.count()
        known = hub_join(own.select("key", "label", "tid", "at", "n"), each.filter("copies > 1").select("key", "label", "places"), ["key", "label"], "places", total)
        found.append(known.select("tid", F.col("at").alias("start"), (F.col("at") + F.col("n") + LENGTH - 1).alias("end")))
        groups = materialise(each.groupBy("key").agg(F.count(F.lit(1)).alias("labels")).filter("labels > 1"), "groups")
        most = groups.filter(F.col("labels") <= GROUP)
        if width == 1:
            # Only keys that are equal by chance have several labels here.
            most = groups
        left = each.select("key", "one")
        places = materialise(hub_join(left, most, ["key"], "labels", total).select("key", "one.tid", "one.at", "one.n"), "ones")
        n = max(1, -(-(places.agg(F.coalesce(F.sum(F.col("n") + LENGTH), F.lit(0))).first()[0]) // PART))
        sent = _with_texts(docs, places.select("tid", F.pmod(F.xxhash64("key"), n).cast("int").alias("part"), "at", "n")).mapInArrow(_cut, "part int, tid binary, at long, body binary")
        tasks = -(-n // PARTS)
        found.append(sent.repartitionById(tasks, F.pmod("part", F.lit(tasks))).sortWithinPartitions("part").mapInArrow(Repeats(), "tid binary, start long, end long"))
        large = groups.filter(F.col("labels") > GROUP)
        if width == 1 or not large.limit(1).count():
            break
        narrower = WIDTHS[WIDTHS.index(width) + 1]
        places = hub_join(left, large, ["key"], "labels", total).select("one.tid", "one.at", "one.n", "one.off")
        again = _with_texts(docs, places).mapInArrow(Refined(narrower), STRETCH)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def spans(docs: DataFrame) -> DataFrame:
    """(tid, spans): of each text that has repeats the maximal runs of bytes to remove, as pairs of int64."""
    own = repeats(docs).groupBy("tid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return materialise(own.mapInArrow(_merged, "tid binary, spans binary"), "spans")


class Remover:
    """mapInArrow function: (doc_id, text, spans) to counts and the digest of what is kept, or with bodies its bytes."""

    def __init__(self, bodies: bool) -> None:
        self.bodies = bodies

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                own = batch.slice(low, 512)
                counts, last = [], []
                for text, both in zip(own.column(1).cast(pa.binary()).to_pylist(), own.column(2).to_pylist(), strict=True):
                    runs = np.frombuffer(both or b"", "<i8").reshape(-1, 2).tolist()
                    edges = [0, *(x for run in runs for x in run), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    counts.append((len(text), len(text) - len(kept), len(runs)))
                    last.append(kept if self.bodies else hashlib.sha256(kept).hexdigest())
                columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
                yield pa.record_batch([own.column(0), *columns, pa.array(last, pa.binary() if self.bodies else pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, bodies: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, and kept_sha256 or with bodies kept_bytes) of every row."""
    own = spans(docs)
    rows, size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("spans")), F.lit(0))).first()
    named = _named(docs, "doc_id")
    if rows <= SPAN_ROWS and size <= SPAN_BYTES:
        joined = named.join(F.broadcast(own), "tid", "left")
    else:
        copies = materialise(named.groupBy("tid").agg(F.count(F.lit(1)).alias("copies")).join(own, "tid"), "copies")
        joined = hub_join(named, copies, ["tid"], "copies", named.count(), how="left")
    kept = T.StructField("kept", T.BinaryType() if bodies else T.StringType())
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], kept])
    return joined.select("doc_id", "text", "spans").mapInArrow(Remover(bodies), schema).withColumnRenamed("kept", "kept_bytes" if bodies else "kept_sha256")


#: Bytes as two hexadecimal digits each, so that a string of 400 bytes is one of 800 characters.
ORACLE_SQL = r"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lower(hex(encode(coalesce(text, '')))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT rid, i, md5_number(substr(h, 2 * i + 1, 800)) AS w FROM (SELECT rid, h, unnest(range(n - 399)) AS i FROM t WHERE n >= 400)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY w) AS c FROM win) WHERE c > 1),
runs AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT rid, i, (i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -1000) > 400)::INT AS fresh FROM again)),
spans AS MATERIALIZED (SELECT rid, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY rid, run),
edges AS (SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS a, a AS b FROM spans
    UNION ALL SELECT rid, max(b), 1000000000 FROM spans GROUP BY rid),
kept AS (SELECT rid, string_agg(substr(h, (2 * a + 1)::BIGINT, (2 * (b - a))::BIGINT), '' ORDER BY a) AS body FROM edges JOIN t USING (rid) GROUP BY rid),
removed AS (SELECT rid, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM spans GROUP BY rid)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(body, h))) AS kept_sha256
FROM t LEFT JOIN removed USING (rid) LEFT JOIN kept USING (rid)
"""
