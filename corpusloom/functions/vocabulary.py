"""Tokenizers as Columns: ids and counts of texts, the mask's id, and what tells one from another."""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.storage import Files, bounded_batches

#: Bytes of text that are encoded at once, whose tokens take some 60 times as much until their ids are taken from them, and ids that are
#: put back into texts at once. A longer text is a piece of its own.
PIECE_BYTES, PIECE_IDS = 1 << 19, 1 << 17
#: By fingerprint: the tokenizer that a process has made last.
_made: dict[str, object] = {}


def _tokenizer(name: str, sent: Broadcast):
    """The tokenizer that was sent, made once a process. Of the module: what functions within others refer to goes with each
    task as a copy, and so would the tokenizers."""
    if name not in _made:
        from tokenizers import Tokenizer

        # A task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _made.clear()
        _made[name] = Tokenizer.from_str(sent.value)
        _made[name].encode_special_tokens = True
    return _made[name]


def _text_bytes(texts: pa.Array) -> pa.Array:
    return pc.binary_length(texts)


def _pieces(rows: pa.Array, sizes: pa.Array, most: int) -> Iterator[pa.Array]:
    """rows in runs of at most ``most``, or of a single row; nulls have no size."""
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield rows.slice(at, end - at)
        at = end


def _lists(rows: Iterable[list[int] | None]) -> pa.Array:
    """Lists of ids as an array, none of them held but as eight bytes an id."""
    values, sizes, nulls = array("q"), [0], []
    for x in rows:
        values.extend(x or ())
        sizes.append(len(values))
        nulls.append(x is None)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.asarray(values, np.int64)), mask=pa.array(nulls, pa.bool_()))


class StandIn:
    """Tokens without a vocabulary file: runs of anything but white space, 32 bits of their MD5 as ids."""

    mask, pad, fingerprint = -2, 0, "stand-in"

    def __call__(self, text: Column) -> Column:
        return T.token_ids(text)

    def count(self, text: Column) -> Column:
        """Tokens of the text, without its ids."""
        return F.regexp_count(text, F.lit(r"\S+")).cast("long")


class Vocabulary:
    """A file of the tokenizers library, read from any store, with the mask added to it if it is missing.

    Executors get its text by broadcast and make the tokenizer once a process; texts go there and back as Arrow batches, of
    few MB each unless the session has a bound of its own, and are encoded some at a time.
    Special tokens' names within texts are plain text, so that no text has the mask. The fingerprint is of the whole
    content, the mask included. Null texts have null ids.
    """

    def __init__(self, spark: SparkSession, path: str, mask: str = "<mask>", pad: str | None = None) -> None:
        from tokenizers import AddedToken, Tokenizer

        made = Tokenizer.from_str(Files(spark).read(path))
        if made.token_to_id(mask) is None:
            made.add_special_tokens([AddedToken(mask, special=True, normalized=False)])
        body = made.to_str()
        self.mask, self.size = made.token_to_id(mask), made.get_vocab_size()
        self.pad = made.token_to_id(pad) if pad else 0
        if self.mask is None or self.pad is None:
            raise ValueError(f"{path} has no {mask if self.mask is None else pad}")
        self.fingerprint = hashlib.sha256(f"{self.mask} {body}".encode()).hexdigest()[:32]
        self.sent = spark.sparkContext.broadcast(body)
        bounded_batches(spark)

    def _encoder(self):
        sent, name = self.sent, self.fingerprint

        def encoded(texts: list) -> list:
            found = iter(_tokenizer(name, sent).encode_batch_fast([t for t in texts if t is not None], add_special_tokens=False))
            return [None if t is None else next(found).ids for t in texts]

        return encoded

    def __call__(self, text: Column) -> Column:
        encoded = self._encoder()

        # Functions of whole batches: Spark works out all of a projection, one of another's result too, in one process a task.
        @F.arrow_udf("array<bigint>")
        def ids(texts: pa.Array) -> pa.Array:
            return _lists(x for piece in _pieces(texts, _text_bytes(texts), PIECE_BYTES) for x in encoded(piece.to_pylist()))

        return ids(text)

    def count(self, text: Column) -> Column:
        """Tokens of the text, without its ids."""
        encoded = self._encoder()

        @F.arrow_udf("bigint")
        def counts(texts: pa.Array) -> pa.Array:
            return pa.array([None if x is None else len(x) for piece in _pieces(texts, _text_bytes(texts), PIECE_BYTES) for x in encoded(piece.to_pylist())], pa.int64())

        return counts(text)

    def text(self, ids: Column) -> Column:
        """The text that an array of ids stands for."""
        sent, name = self.sent, self.fingerprint

        @F.arrow_udf("string")
        def texts(lists: pa.Array) -> pa.Array:
            out = []
            for piece in _pieces(lists, pc.list_value_length(lists), PIECE_IDS):
                rows = piece.to_pylist()
                found = iter(_tokenizer(name, sent).decode_batch([x for x in rows if x is not None], skip_special_tokens=False))
                out += [None if x is None else next(found) for x in rows]
            return pa.array(out, pa.string())

        return texts(ids)

    def first_tokens(self, text: Column, most: int) -> Column:
        """The text of its first tokens, the whole if it has no more."""
        ids = self(text)
        return F.when(F.size(ids) <= most, text).otherwise(self.text(F.slice(ids, 1, most)))


STAND_IN = StandIn()
