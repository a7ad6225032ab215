"""Token ids in files of directly addressable codes, with random access to any token.

An id is split into chunks of eight bits, lowest first. Level 0 holds the first chunk of every id; a continuation
bitmap says which ids go on, and the next level holds the next chunk of those only. The place of an id on the next
level is the rank of its bit, which a directory of counts per 64 bits gives in one step; no block is ever decoded.
(Brisaboa, Ladra and Navarro, "DACs: Bringing direct access to variable-length codes", 2013.)

File: 8 bytes of magic, an unsigned 32-bit length, a JSON header of that length with sizes and places of the sections,
then the sections: document ids (int64), which are null (uint8), document starts (uint64, one more than documents),
and for each level chunks (uint8), bitmap (uint64 words) and directory (uint32).

Files follow one another in ascending doc_id, null ones first; rows that share a doc_id are ordered by the length of
their text, then by its hash. A null or empty text has the end id alone. A very long text is a piece, and a file, of its
own. Other columns are ignored. No rows: no files, no rows.
"""

from __future__ import annotations

import json
import math
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import textvec
from corpusloom.llm.common import bounded_batches, filesystem, fresh_dir, write_whole

MAGIC = b"DACTOK01"
CHUNK_BITS = 8
#: Text in a file, in bytes, a longer text has a file of its own; and in a task, which writes its files one by one.
BYTES_PER_FILE = 16_000_000
FILES_PER_TASK = 2
#: With fewer bytes than that for each core, a task is given this much at least.
LEAST_TASK_BYTES = 1_000_000
#: Files are read back by so many tasks at most.
MOST_TASKS = 20_000
#: Words that a task remembers, of about 45 bytes each; bytes that are encoded at once, whose arrays take some 60 times as much; and
#: words of one call.
CACHE_WORDS = 1_000_000
PIECE_BYTES = 1 << 19
LINES = 512
#: Texts that tell whether a tokenizer looks across white space, and words of one id each, one of which parts others.
PROBES = ("the", "The", "don't", "a.b", "12", "x-y", ",", "naïve", "éa", "中文", "\u0301x", "<|endoftext|>", "_", "a" * 20)
GAPS = (" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c ", "\n\n \n")
MARKS = ("\x01", "\x02", "§", "|")
TAILS = ".,;:!?"
#: Normalisers that leave lower-case ASCII words as they are.
HARMLESS = ({"type": "NFC"}, {"type": "NFD"}, {"type": "NFKC"}, {"type": "NFKD"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "})


#: Of each worker process, by path and end id: the tokenizers, not the words, which each task learns anew.
_known: dict[tuple[str, int], Words] = {}


class Growing:
    """An array that is added to at its end, with room to spare."""

    def __init__(self, first: np.ndarray) -> None:
        self.room, self.n = first, len(first)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            wider = np.empty(max(2 * len(self.room), self.n + len(more)), self.room.dtype)
            wider[: self.n] = self.all
            self.room = wider
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)


class Words:
    """Ids of whole texts, each closed by an end id.

    If the tokenizer never looks across ASCII white space, which is tried out on PROBES, a piece's distinct words are
    encoded once, new ones many at a time, and ids are put in place by arrays. Words are told apart by 64 bits of hash;
    a remembered word is also compared byte by byte. Any other tokenizer is given whole texts.

    Two more properties are used where a tokenizer has them: a closing mark such as a full stop is a word of its own,
    and, if it folds case and its tokens say where a word ends, words of letters are encoded without normalisation.
    """

    def __init__(self, path: str, end_id: int) -> None:
        # A task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.mark = next((m for m in MARKS if len(self._ids(f" {m}\n")) == 1 and not set(self._ids(m)) & set(self._ids(" ".join(PROBES)))), None)
        self.apart = self.mark is not None and self._apart()
        if self.apart:
            self.mark_id, self.after = self._ids(self.mark)[0], np.frombuffer(f" {self.mark}\n".encode(), np.uint8)
            self._look()
        self.forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _apart(self) -> bool:
        probes = (*PROBES, self.mark)
        own = [self._ids(x) for x in probes]
        if any(self._ids(gap) or self._ids(gap + x + gap) != ids for gap in GAPS for x, ids in zip(probes, own, strict=True)):
            return False
        return all(self._ids(gap.join([x, *probes])) == sum(own, self._ids(x)) for gap in GAPS for x in probes)

    def _look(self) -> None:
        """Sets tail, the bytes that end a word by being one; quick and closing, what words of letters need, or None."""
        config = json.loads(self.tokenizer.to_str())
        special = [t["content"] for t in config["added_tokens"]]
        ended = [x for x in PROBES if x[-1].isascii() and x[-1].isalpha()]
        self.tail = np.zeros(256, bool)
        for t in TAILS:
            free = not any(a.isalpha() and b == t for x in special for a, b in zip(x, x[1:], strict=False))
            self.tail[ord(t)] = free and all(self._ids(x + t) == self._ids(x) + self._ids(t) for x in ended)
        steps = config["normalizer"] or {}
        steps, suffix = steps.get("normalizers", [steps]), config["model"].get("end_of_word_suffix")
        self.quick = self.closing = None
        if suffix and {"type": "Lowercase"} in steps and all(x in HARMLESS for x in steps) and not any(x.isalpha() for x in special):
            self.quick = Tokenizer.from_str(json.dumps(config | {"normalizer": None}))
            self.closing = np.zeros(max(config["model"]["vocab"].values()) + 1, bool)
            self.closing[[i for token, i in config["model"]["vocab"].items() if token.endswith(suffix)]] = True

    def forget(self) -> None:
        """Nothing is known but the end, which is the first entry of the ids."""
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.word_at, self.words = Growing(np.zeros(2, np.int64)), Growing(np.zeros(0, np.uint8))
        self.id_at, self.ids = Growing(np.array([0, 1])), Growing(np.array([self.end_id], np.uint32))

    def _letters(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of n lines of lower-case letters, and how many each has; None if their tokens don't say where they end."""
        ids = np.array(self.quick.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.closing[np.minimum(ids, len(self.closing) - 1)])
        return (ids, np.diff(last, prepend=-1)) if len(last) == n and last[-1] == len(ids) - 1 else None

    def _marked(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of n lines that each end in the mark, and how many each has."""
        ids = np.array(self._ids(text), np.uint32)
        marks = np.flatnonzero(ids == self.mark_id)
        if len(marks) == n:
            return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1
        # A word has the mark in it.
        each = [self._ids(x) for x in text.split(f" {self.mark}\n")[:-1]]
        return np.array(sum(each, []), np.uint32), np.array([len(x) for x in each])

    def _learn(self, hashes: np.ndarray, words: np.ndarray, length: np.ndarray) -> None:
        """Encode words, put together in the order of their hashes, that aren't known."""
        start = np.cumsum(length) - length
        letters = np.logical_and.reduceat(textvec.LETTER[words], start) if self.quick else np.zeros(len(length), bool)
        order = np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)])
        for low in range(0, len(order), LINES):
            own = order[low : low + LINES]
            body, upto = textvec.gather(words, start[own], length[own]), np.cumsum(length[own])
            found = None
            if letters[own].all():
                found = self._letters(np.insert(textvec.LOWER[body], upto, 10).tobytes().decode(), len(own))
            if found is None:
                found = self._marked(np.insert(body, np.repeat(upto, len(self.after)), np.tile(self.after, len(own))).tobytes().decode(), len(own))
            self.id_at.add(self.ids.n + np.cumsum(found[1]))
            self.ids.add(found[0])
            self.word_at.add(self.words.n + upto)
            self.words.add(body)
        entry = np.empty(len(order), np.int64)
        entry[order] = self.word_at.n - 1 - len(order) + np.arange(len(order))
        at = np.searchsorted(self.hashes, hashes)
        self.entry, self.hashes = np.insert(self.entry, at, entry), np.insert(self.hashes, at, hashes)

    def _entries(self, w: textvec.Words, hashes: np.ndarray, first: np.ndarray) -> np.ndarray | None:
        """The entry of each distinct word; None if a word isn't the remembered one with its hash."""
        if not len(hashes):
            return np.zeros(0, np.int64)
        start, length = w.start[first], w.end[first] - w.start[first]
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        if not known.all():
            self._learn(hashes[~known], textvec.gather(w.data, start[~known], length[~known]), length[~known])
            at = np.searchsorted(self.hashes, hashes)
        entry, word_at = self.entry[at], self.word_at.all
        if (length != word_at[entry + 1] - word_at[entry]).any():
            return None
        same = textvec.gather(w.data, start[known], length[known]) == textvec.gather(self.words.all, word_at[entry[known]], length[known])
        return entry if same.all() else None

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and how many each has; null counts as empty."""
        if self.apart:
            if len(self.hashes) > CACHE_WORDS:
                self.forget()
            w = textvec.words(texts, tail=self.tail)
            hashes, first, place = np.unique(w.hashes, return_index=True, return_inverse=True)
            entry = self._entries(w, hashes, first)
            if entry is not None:
                # The end is one more word of each text.
                every = np.insert(entry[place], w.at[1:], 0)
                id_at = self.id_at.all
                length = id_at[every + 1] - id_at[every]
                upto = np.cumsum(length)[w.at[1:] + np.arange(len(texts))] if len(texts) else np.zeros(0, np.int64)
                return textvec.gather(self.ids.all, id_at[every], length), np.diff(upto, prepend=0)
        found = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        rows = [np.array([*f.ids, self.end_id], np.uint32) for f in found]
        return np.concatenate([np.zeros(0, np.uint32), *rows]), np.array([len(r) for r in rows], np.int64)


def levels(ids: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Chunks, continuation bitmap and rank directory of each level."""
    out = []
    while len(ids) or not out:
        more = ids > 0xFF
        bits = np.zeros(-(-len(ids) // 64) * 8 + 8, np.uint8)
        packed = np.packbits(more, bitorder="little")
        bits[: len(packed)] = packed
        bitmap = bits.view("<u8")
        counts = np.concatenate([[0], np.cumsum(np.bitwise_count(bitmap), dtype=np.uint32)[:-1]]).astype("<u4")
        # The cast keeps the lowest eight bits; ids that go on are a copy, which is shifted where it is.
        out.append({"chunks": ids.astype(np.uint8), "bitmap": bitmap, "ranks": counts})
        ids = ids[more]
        ids >>= CHUNK_BITS
    return out


def write_file(uri: str, doc_ids: list[int | None] | pa.Array, lengths: list[int] | np.ndarray, ids: np.ndarray) -> None:
    named = pa.array(doc_ids, pa.int64()) if isinstance(doc_ids, list) else doc_ids
    sections = {
        "doc_id": named.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"),
        "null": named.is_null().to_numpy(zero_copy_only=False).astype(np.uint8),
        "start": np.concatenate([[0], np.cumsum(lengths)]).astype("<u8"),
    }
    found = levels(ids)
    for k, level in enumerate(found):
        sections |= {f"{name}{k}": a for name, a in level.items()}
    places, at = {}, 0
    for name, a in sections.items():
        places[name] = [at, len(a), a.dtype.str]
        at += a.nbytes
    header = json.dumps({"docs": len(named), "tokens": len(ids), "levels": len(found), "sections": places}).encode()

    def write(out) -> None:
        out.write(MAGIC + struct.pack("<I", len(header)) + header)
        for a in sections.values():
            out.write(a.tobytes())

    write_whole(uri, write)


class DacFile:
    """Random access to the tokens and documents of a file; each call reads only the bytes that it needs."""

    def __init__(self, uri: str) -> None:
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        head = self.file.read_at(12, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{uri} isn't a token file")
        (n,) = struct.unpack("<I", head[8:])
        self.header = json.loads(self.file.read_at(n, 12))
        self.body = 12 + n
        self.docs, self.tokens = self.header["docs"], self.header["tokens"]

    def __enter__(self) -> DacFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def part(self, name: str, low: int, high: int) -> np.ndarray:
        at, n, kind = self.header["sections"][name]
        if not 0 <= low <= high <= n:
            raise IndexError(f"{name}[{low}:{high}] of {n}")
        size = np.dtype(kind).itemsize
        return np.frombuffer(self.file.read_at((high - low) * size, self.body + at + low * size), kind)

    def rank(self, level: int, i: int) -> int:
        """Ids before the i-th of the level that go on to the next."""
        word = int(self.part(f"bitmap{level}", i >> 6, (i >> 6) + 1)[0]) & ((1 << (i & 63)) - 1)
        return int(self.part(f"ranks{level}", i >> 6, (i >> 6) + 1)[0]) + word.bit_count()

    def slice(self, low: int, high: int, level: int = 0) -> np.ndarray:
        """Ids low to high, as uint32."""
        ids = self.part(f"chunks{level}", low, high).astype(np.uint32)
        if level + 1 < self.header["levels"] and high > low:
            words = self.part(f"bitmap{level}", low >> 6, ((high - 1) >> 6) + 1)
            more = np.unpackbits(words.view(np.uint8), bitorder="little")[low & 63 :][: high - low].astype(bool)
            first = self.rank(level, low)
            count = int(more.sum())
            ids[more] |= self.slice(first, first + count, level + 1) << np.uint32(CHUNK_BITS)
        return ids

    def token(self, i: int) -> int:
        """The i-th id of the file, a few bytes from each level."""
        value, shift = 0, 0
        for level in range(self.header["levels"]):
            value |= int(self.part(f"chunks{level}", i, i + 1)[0]) << shift
            if not int(self.part(f"bitmap{level}", i >> 6, (i >> 6) + 1)[0]) >> (i & 63) & 1:
                break
            i, shift = self.rank(level, i), shift + CHUNK_BITS
        return value


class Writer:
    """mapInArrow function: (doc_id, text) in order to files, each begun when the last has BYTES_PER_FILE of text."""

    def __init__(self, path: str, end_id: int, folder: str, most: int) -> None:
        self.path, self.end_id, self.folder, self.most = path, end_id, folder, most

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = _known.get((self.path, self.end_id)) or Words(self.path, self.end_id), TaskContext.get().partitionId()
        _known[self.path, self.end_id] = words
        words.forget()
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        filled = files = 0

        def done() -> pa.RecordBatch:
            ids, lengths, coded = zip(*held, strict=True)
            docs, n, tokens = pa.concat_arrays(ids), np.concatenate(lengths), np.concatenate(coded)
            # What is put together isn't held twice while it is written.
            del ids, lengths, coded
            held.clear()
            uri = f"{self.folder}/{task:07d}-{files:05d}.dac"
            write_file(uri, docs, n, tokens)
            return pa.record_batch([pa.array([uri]), pa.array([len(docs)], pa.int64()), pa.array([len(tokens)], pa.int64())], names=["uri", "docs", "tokens"])

        for batch in batches:
            for piece in textvec.pieces(batch, "text", min(self.most, PIECE_BYTES)):
                coded, lengths = words.encode(piece.column(1))
                held.append((piece.column(0), lengths, coded))
                filled += int(textvec.raw(piece.column(1))[1][-1])
                if filled >= self.most:
                    yield done()
                    filled, files = 0, files + 1
        if held:
            yield done()
        words.forget()


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, bytes_per_file: int = BYTES_PER_FILE) -> list[tuple[str, int, int]]:
    """Encode every text, append end_id, write the files; (uri, docs, tokens) of each file in order.

    Rows are dealt by ranges of doc_id, then of length and hash of the text, then of place, so that one doc_id, or none,
    or one row many times over, is spread like any others. A task encodes and writes its range as it reads it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = max(1, math.ceil(size / bytes_per_file / FILES_PER_TASK), min(spark.sparkContext.defaultParallelism, size // LEAST_TASK_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), "_length", "_hash", "_row"]
    keyed = plain.withColumn("_length", F.coalesce(F.octet_length("text"), F.lit(0))).withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return sorted(map(tuple, dealt.mapInArrow(Writer(tokenizer, end_id, folder, bytes_per_file), "uri string, docs long, tokens long").collect()))


@textvec.releasing
def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files to their documents: a run of documents is read at a time."""
    for batch in batches:
        for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with DacFile(uri) as f:
                for low in range(0, f.docs, 1024):
                    high = min(low + 1024, f.docs)
                    start = f.part("start", low, high + 1).astype(np.int64)
                    ids = f.slice(int(start[0]), int(start[-1])).astype("<u4")
                    at = start - start[0]
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                    doc = pa.array(f.part("doc_id", low, high), mask=f.part("null", low, high).astype(bool))
                    yield pa.record_batch([doc, pa.array(start[:-1] + base), pa.array(np.diff(start)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, files: Iterable[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    rows, base = [], 0
    for uri, _, tokens in files:
        rows.append((uri, base))
        base += tokens
    listed = spark.createDataFrame(rows, "uri string, base long")
    return listed.repartition(max(1, min(len(rows), MOST_TASKS))).mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, bytes_per_file: int = BYTES_PER_FILE) -> DataFrame:
    """Write all docs in a new folder of the shared one, and describe every document as the files have it."""
    spark = docs.sparkSession
    return read_documents(spark, write_tokens(docs, tokenizer, end_id, fresh_dir(spark, "tokens"), bytes_per_file))
