"""Alignment of two tokenizers' tokens over the same bytes: groups, links and how common each link is.

Byte offsets where a token of either tokenizer ends are cuts; tokens between two cuts are a group, and all its pairs of
tokens, one of each tokenizer, are links.

1. Units. Where neither vocabulary has a token that goes on over a blank after a printing character, texts are cut there;
   such a unit has the same tokens wherever it stands. Otherwise the whole text is one. Of a block of up to BLOCK bytes
   of text the units become numbers, and its distinct ones a dictionary.
2. Alignment of each distinct unit of a block once. Units that may follow each other in a text are encoded as one, RUN
   bytes of them at once. Running sums of the tokens' lengths are their ends, ends of both kinds are cuts, running counts
   of cuts number the groups, and the distinct tokens of a group are linked, with how often. Documents get their own sums
   and digests; a block sends a row for each of its pairs, with the number of its documents that have it.
3. Counts. Sums by pair over all blocks, and by first id the highest of them, are joined to the blocks' pairs.
4. These go back to the blocks, whose units they rate, and complete the documents' rows.

Only pairs and what blocks keep are shuffled, never units or tokens. Pairs that are in a great many blocks are joined in
several places; nothing is gathered beyond a block, whose bytes are bounded, or a unit.

Defined results: null and empty texts, and those whose tokens' bytes aren't a blank and the text, have no tokens: zeros, and
an empty text of groups; they count for no pair. Repeated rows are documents each; doc_id is handed through, null or not;
other columns are ignored; a text longer than BLOCK is a block of its own; no rows: none.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import textvec
from corpusloom.llm.common import hub_join, materialise, sweep_up

#: Bytes of text in a block, and pairs of documents and units that are looked at at once.
BLOCK, CHUNK = 16 << 20, 1 << 17
#: Rows that are packed together or units that are aligned at once, the most bytes of these, and bytes of units that are
#: encoded as one text.
PACK, SLICE, RUN = 1 << 16, 1 << 20, 1 << 11
#: A character that a blank may be cut off from ends in one of these bytes. Fixed values, last two bytes of white space
#: beyond ASCII in UTF-8, whatever leads them: there no cut is made.
_PRINTS = np.array([0x21 <= i <= 0x7E or i >= 0x80 for i in range(256)])
_SPACE_ENDS = [(0xC2, 0x85), (0xC2, 0xA0), (0x9A, 0x80), *((0x80, x) for x in range(0x80, 0x8B)), (0x80, 0xA8), (0x80, 0xA9), (0x80, 0xAF), (0x81, 0x9F)]


class ByteTokens:
    """A byte-level tokenizer of the tokenizers library: given texts with their leading blank."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # Bytes that print stand for themselves, the others for characters from 256 on, in their order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*plain}))}
        self.bytes = {i: bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode() for token, i in self.tokenizer.get_vocab().items()}

    @staticmethod
    def cuts(path: str) -> bool:
        """Whether its words never go on over a blank: by the pattern that byte-level tokenizers split texts by."""
        import json

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        return made.get("normalizer") is None and made.get("pre_tokenizer") == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokens:
    """A sentencepiece tokenizer with byte fallback that adds the leading blank itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        name = self.model.id_to_piece
        self.bytes = {i: bytes([int(name(i)[3:-1], 16)]) if self.model.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(len(self.model))}

    @staticmethod
    def cuts(path: str) -> bool:
        """Whether no piece has a blank after another character, and white space is left as it is."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = model.encode(" a  b ", out_type=str, num_threads=1)
        return "".join(plain) == "▁▁a▁▁b▁" and not any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(len(model)))

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)


def unit_starts(data: np.ndarray, at: np.ndarray, cut: bool) -> np.ndarray:
    """Where units begin in texts put together, each with its leading blank: there, and at blanks after what prints."""
    first = np.zeros(len(data), bool)
    first[at[:-1][at[1:] > at[:-1]]] = True
    if cut and len(data) > 1:
        blank = np.flatnonzero((data[1:] == 0x20) & _PRINTS[data[:-1]]) + 1
        ends = np.zeros(len(data) + 1, bool)
        ends[at] = True
        # A blank alone would be an empty text to those that add the blank.
        blank = blank[~ends[blank + 1]]
        before = data[np.maximum(blank - 2, 0)].astype(np.int64) << 8 | data[blank - 1]
        first[blank[~np.isin(before, [a << 8 | b for a, b in _SPACE_ENDS])]] = True
    return np.flatnonzero(first)


class Coder:
    """mapInArrow function: (doc_id, text) to blocks: a row for each distinct unit, (block, code, unit), and one for each
    document, (block, doc_id, n, codes): numbers of its units in order, compressed."""

    def __init__(self, cut: bool, schema: T.StructType, block: int) -> None:
        self.cut, self.names, self.block = cut, schema.fieldNames(), block

    def coded(self, batches: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        kind = pa.large_string()
        text = pc.fill_null(table.column(1).cast(kind), pa.scalar("", kind))
        spaced = pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(pa.scalar("", kind), text, pa.scalar(" ", kind))).combine_chunks()
        data, at = textvec.raw(spaced)
        start = unit_starts(data, at, self.cut)
        edges = np.append(start, len(data)).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(edges.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())).dictionary_encode()
        codes, at_unit = units.indices.to_numpy().astype("<i4"), np.searchsorted(start, at)
        known, doc_id, rows = units.dictionary, table.column(0).combine_chunks(), len(spaced)
        # Whoever takes the rows needs room of their own.
        batches.clear()
        del table, text, spaced, data, start, edges, units
        empty = lambda kind, k: pa.nulls(k, kind)
        for low in range(0, len(known), 1 << 16):
            own = known[low : low + (1 << 16)].cast(pa.string())
            k = len(own)
            yield pa.record_batch([pa.array(np.full(k, number)), pa.array(np.arange(low, low + k), pa.int32()), own, empty(doc_id.type, k), empty(pa.int32(), k), empty(pa.binary(), k)], names=self.names)
        del known
        for low in range(0, rows, 4096):
            places = list(zip(at_unit[low : low + 4096].tolist(), at_unit[low + 1 : low + 4097].tolist(), strict=False))
            bodies = [pa.compress(codes[a:b].tobytes(), "zstd", asbytes=True) for a, b in places]
            k = len(places)
            yield pa.record_batch([pa.array(np.full(k, number)), empty(pa.int32(), k), empty(pa.string(), k), doc_id[low : low + k], pa.array([b - a for a, b in places], pa.int32()), pa.array(bodies, pa.binary())], names=self.names)

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for piece in textvec.pieces(batch, "text"):
                held.append(piece)
                size += len(textvec.raw(piece.column(1))[0])
                if size >= self.block:
                    yield from self.coded(held, number)
                    number, held, size = number + 1, [], 0
        if held:
            yield from self.coded(held, number)


class Vocabulary:
    """A tokenizer and its tokens' bytes, put together."""

    def __init__(self, kind: type, path: str) -> None:
        self.tokens = kind(path)
        names = [self.tokens.bytes.get(i, b"") for i in range(max(self.tokens.bytes) + 1)]
        self.size = np.array([len(x) for x in names])
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(names), np.uint8)

    def encoded(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of each text, and whether their bytes are the text."""
        ids = [np.array(own, np.int64) for own in self.tokens.ids(texts)]
        every = np.concatenate(ids)
        size = self.size[every]
        body = textvec.gather(self.data, self.at[every], size).tobytes()
        edge = np.append(0, np.cumsum(size))[np.append(0, np.cumsum([len(own) for own in ids]))].tolist()
        return ids, np.array([body[a:b] == t.encode() for a, b, t in zip(edge, edge[1:], texts, strict=False)])


#: One for each process: workers are used again.
vocabulary = functools.cache(Vocabulary)


def unit_tokens(data: np.ndarray, at: np.ndarray, both: list[Vocabulary], cut: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """The ids of both kinds of all units, which are put together in data, and which units are ok; the others have none.

    Units that may stand after each other in a text are encoded as one text. Where that differs from its tokens' bytes each
    of its units is encoded by itself.
    """
    n = len(at) - 1
    new = np.ones(n, bool)
    if cut:
        follows = np.zeros(len(data) + 1, bool)
        follows[unit_starts(data, np.array([0, len(data)]), True)] = True
        part = at[:-1] // RUN
        new[1:] = ~follows[at[1:-1]] | (part[1:] != part[:-1])
    run = np.append(np.flatnonzero(new), n)
    body = data.tobytes()
    texts = lambda edge: [body[i:j].decode() for i, j in zip(edge, edge[1:], strict=False)]
    found = [v.encoded(texts(at[run].tolist())) for v in both]
    ids, ok = [own for own, _ in found], np.ones(n, bool)
    for k in np.flatnonzero(~(found[0][1] & found[1][1])).tolist():
        low, high = run[k : k + 2].tolist()
        alone = [v.encoded(texts(at[low : high + 1].tolist())) for v in both]
        ok[low:high] = alone[0][1] & alone[1][1]
        for own, (parts, _) in zip(ids, alone, strict=True):
            own[k] = np.concatenate([x if good else x[:0] for x, good in zip(parts, ok[low:high].tolist(), strict=True)])
    return [np.concatenate(own) for own in ids], ok


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values of x, sorted; x is sorted in place."""
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id), sorted, and how often they are there."""
    found, n = np.unique(group << 32 | ids, return_counts=True)
    return found >> 32, found & 0xFFFFFFFF, n


class Units:
    """Units' groups as text, each after a semicolon; how many tokens of either kind, groups and links each has, whether
    it is ok, and of its links the pairs, a pair being its two ids in one number, and how often they are there: those of
    unit k are pairs[at[k]:at[k + 1]]."""

    def __init__(self, data: np.ndarray, edge: np.ndarray, both: list[Vocabulary], cut: bool) -> None:
        ids, self.ok = unit_tokens(data, edge, both, cut)
        size = np.where(self.ok, np.diff(edge), 0)
        ends = [np.cumsum(v.size[own]) for v, own in zip(both, ids, strict=True)]
        hits = np.zeros(int(size.sum()) + 1, np.int8)
        for own in ends:
            hits[own] += 1
        # How many cuts there are up to each byte; a token's group is the number of those before its end.
        cuts = np.cumsum(hits == 2)
        a, b = (cuts[own - 1] for own in ends)
        unit_end = cuts[np.cumsum(size)]
        n = [np.bincount(own, minlength=int(cuts[-1])) for own in (a, b)]
        upto = [np.append(0, np.cumsum(x)) for x in (*n, n[0] * n[1])]
        last = np.append(0, unit_end)
        self.sums = [np.diff(upto[0][last]), np.diff(upto[1][last]), np.diff(last), np.diff(upto[2][last])]
        self.lines = self._lines(ids, (a, b), upto, last)
        ga, ida, na = _counted(a, ids[0])
        gb, idb, nb = _counted(b, ids[1])
        there = np.bincount(gb, minlength=int(cuts[-1]))
        times = there[ga]
        row = np.repeat(np.cumsum(there)[ga] - times, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        self.pairs = np.repeat(ida, times) << 32 | idb[row]
        self.times = np.repeat(na, times) * nb[row]
        self.at = np.append(0, np.cumsum(np.bincount(np.repeat(ga, times), minlength=int(cuts[-1]))))[last]

    @staticmethod
    def _lines(ids: list[np.ndarray], groups: tuple[np.ndarray, np.ndarray], upto: list[np.ndarray], last: np.ndarray) -> pa.Array:
        """a1,a2|b1;a3|b2,b3: decimal ids of each unit's groups in order, after a semicolon."""
        (a, b), all_ = groups, len(ids[0]) + len(ids[1])
        every, sign = np.empty(all_, np.int64), np.full(all_, ord(","), np.uint8)
        first, second = np.arange(len(a)) + upto[1][a], np.arange(len(b)) + upto[0][b + 1]
        every[first], every[second] = ids
        sign[first[np.diff(a, prepend=-1) > 0]], sign[second[np.diff(b, prepend=-1) > 0]] = ord(";"), ord("|")
        signs = pa.LargeStringArray.from_buffers(all_, pa.py_buffer(np.arange(all_ + 1).tobytes()), pa.py_buffer(sign.tobytes()))
        text, at = textvec.raw(pc.binary_join_element_wise(signs, pa.array(every).cast(pa.large_string()), pa.scalar("", pa.large_string())))
        edge = np.asarray(at)[(upto[0] + upto[1])[last]].astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(last) - 1, [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(np.ascontiguousarray(text).tobytes())])


class Dictionary:
    """All units of a block, a slice of them at a time. every: its pairs, sorted; which: where those of links are in it."""

    def __init__(self, units: list[pa.Array], both: list[Vocabulary], cut: bool) -> None:
        made = []
        for own in units:
            data, at = textvec.raw(own)
            at, low = np.asarray(at, np.int64), 0
            while low < len(own):
                high = min(low + PACK, max(low + 1, int(np.searchsorted(at, at[low] + SLICE, "right")) - 1))
                made.append(Units(data[at[low] : at[high]], at[low : high + 1] - at[low], both, cut))
                low = high
        self.lines = pa.concat_arrays([x.lines for x in made])
        self.sums = [np.concatenate(x) for x in zip(*(x.sums for x in made), strict=True)]
        self.ok, self.times = (np.concatenate(x) for x in zip(*((x.ok, x.times) for x in made), strict=True))
        self.size = np.concatenate([np.diff(x.at) for x in made])
        self.at = np.append(0, np.cumsum(self.size))
        pairs = [x.pairs for x in made]
        del made
        self.every, which = np.unique(np.concatenate(pairs), return_inverse=True)
        self.which = which.astype(np.int32)
        self.counts = np.zeros(len(self.every), np.int64)


def joined(*bodies: np.ndarray) -> bytes:
    """Arrays as one body, compressed."""
    whole = b"".join(len(b).to_bytes(8, "little") + b for b in (x.tobytes() for x in bodies))
    return len(whole).to_bytes(8, "little") + pa.compress(whole, "zstd", asbytes=True)


def opened(body: bytes) -> list[bytes]:
    whole = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True)
    out, at = [], 0
    while at < len(whole):
        size = int.from_bytes(whole[at : at + 8], "little")
        out.append(whole[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def _codes(rows: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Documents from a row to another with about CHUNK units: their numbers of units, and these, put together."""
    n = rows.column("n").to_numpy()
    at = np.append(0, np.cumsum(n, dtype=np.int64))
    low = 0
    while low < len(n):
        high = max(low + 1, int(np.searchsorted(at, at[low] + CHUNK, "right")) - 1)
        bodies = [pa.decompress(x, 4 * k, "zstd", asbytes=True) if k else b"" for x, k in zip(rows.column("codes")[low:high].to_pylist(), n[low:high].tolist(), strict=True)]
        yield low, high, n[low:high], np.frombuffer(b"".join(bodies), "<i4").astype(np.int64)
        low = high


def _sums(one: np.ndarray, n: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Of each document the sum over its units."""
    before, at = np.append(0, np.cumsum(one[codes])), np.append(0, np.cumsum(n, dtype=np.int64))
    return before[at[1:]] - before[at[:-1]]


#: What a document's own units add up to, and what the counts of its links do.
OWN, COUNTED = ("n_a", "n_b", "n_groups", "n_links"), ("n_best", "count_sum")


class Aligned:
    """mapInArrow function: (doc_id, text) to rows of three kinds. Documents (block, doc_id, n, codes, OWN sums, and their groups
    or the digest of these); what a block keeps of its units, (block, part, packed); and (block, pair, docs): how many
    documents of the block have a pair, in the pairs' order."""

    def __init__(self, coder: Coder, made: tuple, texts: bool, schema: T.StructType) -> None:
        self.coder, self.made, self.texts, self.names = coder, made, texts, schema.fieldNames()

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, own, units, ready = [vocabulary(*made) for made in self.made], None, [], None
        for batch in self.coder(batches):
            block = batch.column(0)[0].as_py()
            if block != own:
                if ready:
                    yield from self.finish(own, ready)
                own, units, ready = block, [], None
            if batch.column(1).null_count < batch.num_rows:
                units.append(batch.column(2))
                continue
            if units:
                ready, units = Dictionary(units, both, self.coder.cut), []
            yield from self.documents(ready, batch)
        if ready:
            yield from self.finish(own, ready)

    def rows(self, size: int, schema: pa.Schema, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"block": pa.int64(), "part": pa.int32(), "packed": pa.binary(), "doc_id": schema.field("doc_id").type, "n": pa.int32(), "codes": pa.binary(), "said": pa.string()}
        return pa.record_batch([columns[c] if c in columns else pa.nulls(size, kinds.get(c, pa.int64())) for c in self.names], names=self.names)

    def documents(self, own: Dictionary | None, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.schema = rows.schema
        for low, high, n, codes in _codes(rows):
            part = rows.slice(low, high - low)
            document, at = np.repeat(np.arange(len(n)), n), np.append(0, np.cumsum(n, dtype=np.int64))
            none, sums, said = n == 0, [np.zeros(len(n), np.int64) for _ in OWN], [""] * len(n)
            if len(codes):
                none |= np.bincount(document, ~own.ok[codes], len(n)) > 0
                good = ~none[document]
                found = _distinct(document[good] << 32 | codes[good])
                of, code = found >> 32, found & 0xFFFFFFFF
                size = own.size[code]
                places = np.repeat(own.at[code] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                found = _distinct(np.repeat(of, size) << 32 | own.which[places])
                own.counts += np.bincount(found & 0xFFFFFFFF, minlength=len(own.counts))
                sums = [np.where(none, 0, _sums(one, n, codes)) for one in own.sums]
                lines = own.lines.take(pa.array(codes))
                edge = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset :][at].tolist()
                text = memoryview(lines.buffers()[2])
                for k in np.flatnonzero(~none).tolist():
                    # Without the first semicolon.
                    body = text[edge[k] + 1 : edge[k + 1]]
                    said[k] = bytes(body).decode() if self.texts else hashlib.sha256(body).hexdigest()
            bodies = pc.if_else(pa.array(none), pa.scalar(b"", pa.binary()), part.column("codes"))
            made = {c: pa.array(x) for c, x in zip(OWN, sums, strict=True)}
            yield self.rows(len(n), rows.schema, block=part.column("block"), doc_id=part.column("doc_id"), n=pa.array(np.where(none, 0, n).astype(np.int32)), codes=bodies, said=pa.array(said, pa.string()), **made)

    def finish(self, block: int, own: Dictionary) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(own.size), PACK):
            high = min(low + PACK, len(own.size))
            links = slice(own.at[low], own.at[high])
            body = joined(own.size[low:high].astype("<i4"), own.which[links].astype("<i4"), own.times[links].astype("<i8"))
            yield self.rows(1, self.schema, block=pa.array([block]), part=pa.array([low // PACK], pa.int32()), packed=pa.array([body], pa.binary()))
        for low in range(0, len(own.every), PACK):
            pair = own.every[low : low + PACK]
            yield self.rows(len(pair), self.schema, block=pa.array(np.full(len(pair), block)), pair=pa.array(pair), docs=pa.array(own.counts[low : low + PACK]))


class Packed:
    """mapInArrow function: rows (block, pair, rated) to one for each block and PACK of them, (block, part -1, packed)."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= PACK:
                yield self.packed(held)
                held, rows = [], 0
        if rows:
            yield self.packed(held)

    @staticmethod
    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block, pair, rated = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
        order = np.lexsort((pair, block))
        block, pair, rated = block[order], pair[order], rated[order]
        edge = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        bodies = [joined(pair[a:b].astype("<i8"), rated[a:b].astype("<i8")) for a, b in zip(edge, edge[1:], strict=False)]
        return pa.record_batch([pa.array(block[edge[:-1]]), pa.array(np.full(len(bodies), -1, np.int32)), pa.array(bodies, pa.binary())], names=["block", "part", "packed"])


class Completed:
    """mapInArrow function: rows (block, part, packed, and the columns of documents) sorted by block and part, documents last, to
    documents with their COUNTED sums too; a block's units are held at a time."""

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, ready = None, [], None
        for batch in batches:
            block, document = batch.column(0).to_numpy(), batch.column(2).is_null().to_numpy(zero_copy_only=False)
            edge = [0, *(np.flatnonzero((np.diff(block) != 0) | (document[1:] != document[:-1])) + 1).tolist(), batch.num_rows]
            for low, high in zip(edge, edge[1:], strict=False):
                if low == high:
                    continue
                if block[low] != own:
                    own, held, ready = block[low], [], None
                if not document[low]:
                    held += zip(batch.column(1)[low:high].to_pylist(), batch.column(2)[low:high].to_pylist(), strict=True)
                    continue
                if ready is None:
                    ready, held = self.rated(held), []
                yield from self.documents(ready, batch.slice(low, high - low))

    @staticmethod
    def rated(held: list[tuple[int, bytes]]) -> list[np.ndarray]:
        """Of each unit the COUNTED sums over its links."""
        counts = [[np.frombuffer(x, "<i8") for x in opened(body)] for part, body in held if part < 0]
        if not counts:
            return [np.zeros(0, np.int64) for _ in COUNTED]
        pair, rated = (np.concatenate(x) for x in zip(*counts, strict=True))
        rated = rated[np.argsort(pair)]
        out = []
        for part, body in held:
            if part >= 0:
                size, which, times = (np.frombuffer(x, t) for x, t in zip(opened(body), ("<i4", "<i4", "<i8"), strict=True))
                at = np.append(0, np.cumsum(size, dtype=np.int64))
                own = rated[which]
                out.append([np.diff(np.append(0, np.cumsum(times * x))[at]) for x in (own & 1, own >> 1)])
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    @staticmethod
    def documents(ready: list[np.ndarray], rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low, high, n, codes in _codes(rows):
            part = rows.slice(low, high - low)
            sums = [pa.array(_sums(one, n, codes)) for one in ready]
            yield pa.record_batch([part.column("doc_id"), *(part.column(c) for c in OWN), *sums, part.column("said")], names=["doc_id", *OWN, *COUNTED, "said"])


def align(docs: DataFrame, a: tuple[type, str], b: tuple[type, str], texts: bool = False) -> DataFrame:
    """A row for each document: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups_sha256 or with texts groups).

    a and b: a kind of tokens and its file. A pair's count is the number of documents that have it linked; n_best counts
    links whose count no other pair of their first id exceeds; count_sum sums the counts of all links.
    """
    spark, cut = docs.sparkSession, all(kind.cuts(path) for kind, path in (a, b))
    long = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    document = [docs.schema["doc_id"], T.StructField("n", T.IntegerType()), T.StructField("codes", T.BinaryType())]
    coded = T.StructType([*long("block"), T.StructField("code", T.IntegerType()), T.StructField("unit", T.StringType()), *document])
    packed = [*long("block"), T.StructField("part", T.IntegerType()), T.StructField("packed", T.BinaryType())]
    first = T.StructType([*packed, *document, *long(*OWN), T.StructField("said", T.StringType()), *long("pair", "docs")])
    made = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(Aligned(Coder(cut, coded, BLOCK), (a, b), texts, first), first)
    held = materialise(made, "aligned")
    pairs = held.filter("pair is not null").select("block", "pair", "docs")
    counts = materialise(pairs.groupBy("pair").agg(F.sum("docs").alias("n_docs"), F.count(F.lit(1)).alias("blocks")), "pairs")
    number = counts.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    # As many rows as the first vocabulary has ids.
    most = F.broadcast(counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n_docs").alias("most")))
    best = (F.col("n_docs") == F.col("most")).cast("long")
    rated = counts.withColumn("a", F.shiftright("pair", 32)).join(most, "a").select("pair", (F.col("n_docs") * 2 + best).alias("rated"), "blocks")
    sweep_up(spark)
    back = hub_join(pairs.select("block", "pair"), rated, ["pair"], "blocks", number).select("block", "pair", "rated")
    rows = back.mapInArrow(Packed(), T.StructType(packed)).unionByName(held.filter("pair is null").drop("pair", "docs"), allowMissingColumns=True)
    out = T.StructType([document[0], *long(*OWN, *COUNTED), T.StructField("said", T.StringType())])
    whole = rows.repartition("block").sortWithinPartitions("block", F.col("packed").isNull(), "part").mapInArrow(Completed(), out)
    return whole.withColumnRenamed("said", "groups" if texts else "groups_sha256")
