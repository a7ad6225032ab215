"""Batches of rows with like lengths, shards by bytes, checkpoints by step."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from corpusloom.functions import text as T
from corpusloom.storage import materialise


#: Beginnings of shards are broadcast for so many ranges.
BROADCAST_RANGES = 250_000


def ranked(rows: DataFrame, order: Column, name: str = "rn") -> DataFrame:
    """Adds the place of each row, from 1, in the order of a hexadecimal hash, without one task that sees all rows.

    Rows are numbered within leading digits of the hash; the counts of these, a few thousand rows, are summed up.
    """
    keyed = rows.withColumn("_order", order).withColumn("_group", F.substring("_order", 1, 3))
    counts = keyed.groupBy("_group").count()
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_group").orderBy("_order", *rows.columns[:1])
    return keyed.join(F.broadcast(offsets), "_group").withColumn(name, F.col("_before") + F.row_number().over(own)).select(*rows.columns, name)


def grouped_batches(rows: DataFrame, key: str, length: str, *, seed: int, epoch: int, per_device: int, ranks: int, window: int) -> DataFrame:
    """(key, length, pos, batch, rank, slot): a seeded shuffle, cut into tiles of ``window`` batches, each sorted by
    length downwards, cut into batches; an incomplete last batch is dropped. Narrow rows only."""
    size = per_device * ranks
    shuffled = ranked(rows.select(key, length), T.order_hash(F.col(key), seed + epoch))
    tile = F.floor((F.col("rn") - 1) / (size * window))
    inside = Window.partitionBy("tile").orderBy(F.desc(length), "rn")
    placed = shuffled.withColumn("tile", tile).withColumn("pos", F.col("tile") * size * window + F.row_number().over(inside) - 1)
    whole = F.floor(F.lit(rows.count()) / size)
    out = placed.withColumn("batch", F.floor(F.col("pos") / size)).filter(F.col("batch") < whole)
    return out.select(key, length, F.col("pos").cast("long").alias("pos"), F.col("batch").cast("long").alias("batch"), F.floor(F.col("pos") % size / per_device).cast("long").alias("rank"), (F.col("pos") % per_device).cast("long").alias("slot"))


def plain_batches(rows: DataFrame, key: str, *, seed: int, epoch: int, per_device: int, ranks: int, drop_last: bool) -> DataFrame:
    """(key, pos, batch, rank, slot): a seeded shuffle dealt to ranks in turn, without regard to length.

    Ranks have as many rows each: what is over is dropped, or else the first rows are taken again; so is a rank's last
    batch, or else it is shorter. With fewer rows than are missing, rows are taken again more than once.
    """
    shuffled = ranked(rows.select(key), T.order_hash(F.col(key), seed + epoch)).withColumn("pos", F.col("rn") - 1)
    n = rows.count()
    own = n // ranks if drop_last else -(-n // ranks)
    if drop_last:
        own -= own % per_device
    whole = own * ranks
    times = F.greatest(F.lit(0), F.ceil((F.lit(whole) - F.col("pos")) / F.lit(max(1, n)))).cast("long")
    dealt = shuffled.filter(times > 0).withColumn("again", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    at = (F.col("pos") + F.col("again") * n).cast("long")
    placed = dealt.select(key, at.alias("pos")).withColumn("nth", F.floor(F.col("pos") / ranks).cast("long"))
    return placed.select(key, "pos", F.floor(F.col("nth") / per_device).cast("long").alias("batch"), (F.col("pos") % ranks).alias("rank"), (F.col("nth") % per_device).alias("slot"))


def resumed(batches: DataFrame, cursor: int) -> DataFrame:
    """Batches that aren't done: the cursor counts committed ones."""
    return batches.filter(F.col("batch") >= cursor)


def micro_batches(batches: DataFrame, accumulate: int) -> DataFrame:
    """Adds step and micro: ``accumulate`` batches make up a step."""
    return batches.withColumn("step", F.floor(F.col("batch") / accumulate).cast("long")).withColumn("micro", F.col("batch") % accumulate)


def padded_tokens(batches: DataFrame, length: str) -> DataFrame:
    """(batch, tokens, padded): what a batch holds, and holds once padded to its longest row."""
    return batches.groupBy("batch").agg(F.sum(length).alias("tokens"), (F.max(length) * F.count(F.lit(1))).alias("padded"))


def row_bytes(total_len: Column) -> Column:
    """Estimated bytes of an expanded row: four arrays of eight bytes a token, the length and the row itself."""
    return (F.lit(72) + 32 * total_len).cast("long")


def value_bytes(value: Column, kind: T_.DataType) -> Column:
    """Estimated bytes of a value of any type, a walk over its schema: null 0, flag 1, number or time 8, text and binary by
    their bytes, arrays the sum of their elements, structs and maps that of keys' names or texts and values."""
    none = F.lit(0).cast("long")
    total = lambda items, f: F.aggregate(items, none, lambda s, x: s + f(x))
    if isinstance(kind, T_.BooleanType):
        size = F.lit(1).cast("long")
    elif isinstance(kind, T_.StringType | T_.BinaryType):
        size = F.octet_length(value).cast("long")
    elif isinstance(kind, T_.ArrayType):
        flat = isinstance(kind.elementType, T_.NumericType | T_.DatetimeType) and not kind.containsNull
        size = 8 * F.size(value).cast("long") if flat else total(value, lambda x: value_bytes(x, kind.elementType))
    elif isinstance(kind, T_.StructType):
        size = none
        for f in kind.fields:
            size = size + F.lit(len(f.name.encode())) + value_bytes(value[f.name], f.dataType)
    elif isinstance(kind, T_.MapType):
        size = total(F.map_keys(value), lambda k: F.octet_length(k.cast("string")).cast("long")) + total(F.map_values(value), lambda x: value_bytes(x, kind.valueType))
    else:
        size = F.lit(8).cast("long")
    return F.when(value.isNull(), none).otherwise(size)


def row_size(rows: DataFrame, columns: list[str] | None = None) -> Column:
    """Estimated bytes of a row: 64 and those of its columns."""
    size = F.lit(64).cast("long")
    for f in rows.schema.fields:
        if columns is None or f.name in columns:
            size = size + value_bytes(F.col(f"`{f.name}`"), f.dataType)
    return size


def total_bytes(sizes: DataFrame) -> DataFrame:
    """(rows, bytes) of all rows together."""
    return sizes.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def epoch_batches(rows: DataFrame, key: str, length: str, *, epochs: int, accumulate: int, seed: int, **settings: int) -> DataFrame:
    """Batches of several epochs one after another, each shuffled anew: (epoch, batch, rank, slot, ..., step, micro).
    Steps are filled across the end of an epoch."""
    size = settings["per_device"] * settings["ranks"]
    whole = rows.count() // size
    out = None
    for epoch in range(epochs):
        own = grouped_batches(rows, key, length, seed=seed, epoch=epoch, **settings).withColumn("batch", F.col("batch") + epoch * whole).withColumn("epoch", F.lit(epoch))
        out = own if out is None else out.unionByName(own)
    return micro_batches(out, accumulate)


def last_flags(batches: DataFrame, accumulate: int) -> DataFrame:
    """Adds last_micro: whether a micro-batch closes its step, where gradients are exchanged."""
    return batches.withColumn("last_micro", F.col("micro") == accumulate - 1)


def next_cuts(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums before each row, and for a shard that begins at each row where the next one begins."""
    before = np.append(0, np.cumsum(sizes))
    alone = np.flatnonzero(sizes >= budget)
    nearest = np.append(alone, len(sizes))[np.searchsorted(alone, np.arange(len(sizes)) + 1)]
    fits = np.searchsorted(before, before[:-1] + budget, "right") - 1
    return before, np.where(sizes >= budget, np.arange(len(sizes)) + 1, np.minimum(fits, nearest))


def _held(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list]:
    """The columns of a range's rows, put together."""
    held = list(batches)
    if held and sum(b.num_rows for b in held):
        yield [pa.concat_arrays([b.column(k) for b in held]) for k in range(columns)]


class Numbered:
    """mapInArrow function: a range's rows in order with its number and their places."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = pa.array(np.arange(at, at + batch.num_rows))
            at += batch.num_rows
            yield pa.record_batch([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), places], names=["row_id", "bytes", "range", "place"])


@dataclass
class Outcomes:
    """What becomes, over a run of rows, of a shard that is open where the run begins.

    For each row that may be the first of a new shard, those within the first budget: ``before``, the bytes of the run
    before it, closed by those before the next row; ``shards``, how many shards begin from there on; ``last``, the bytes
    in the last of them, -1 if it is closed. ``whole`` is whether all rows are such; ``alone`` is the first row of the
    budget or more, or the number of such rows if there is none.
    """

    total: int
    alone: int
    whole: bool
    before: np.ndarray
    shards: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, budget: int) -> Outcomes:
        before, following = next_cuts(sizes, budget)
        n, alone = len(sizes), np.flatnonzero(sizes >= budget)
        first = min(n, int(np.searchsorted(before, budget, "right")) + 1, int(alone[0]) + 1 if len(alone) else n)
        at, shards = np.arange(first), np.ones(first, np.int64)
        while (more := following[at] < n).any():
            at, shards = np.where(more, following[at], at), shards + more
        last = np.where(sizes[at] >= budget, -1, before[n] - before[at])
        return cls(int(before[n]), int(alone[0]) if len(alone) and alone[0] < first else first, first == n and not (len(alone) and alone[0] < n), before[: first + 1], shards, last)

    def step(self, shards: np.ndarray, filled: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """Shards so far and bytes in the open one, -1 if there is none, before the run, to those after it."""
        if len(self.before) == 1:
            return shards, np.where(filled < 0, filled, filled + self.total)
        at = np.where(filled < 0, 0, np.minimum(np.searchsorted(self.before, budget - filled, "right") - 1, self.alone))
        passed = (at >= len(self.shards)) & self.whole
        at = np.minimum(at, len(self.shards) - 1)
        return np.where(passed, shards, shards + self.shards[at]), np.where(passed, filled + self.total, self.last[at])

    @classmethod
    def joined(cls, runs: Iterator[Outcomes], budget: int) -> Outcomes:
        """Those of runs one after another: each is looked at once."""
        out = cls(0, 0, True, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for run in runs:
            shards, last = run.step(out.shards, out.last, budget)
            total, before, alone, whole = out.total + run.total, out.before, out.alone, out.whole
            if whole and out.total <= budget:
                before = np.append(before[:-1], out.total + run.before)
                alone, whole = len(shards) + run.alone, run.whole
                shards, last = np.append(shards, run.shards), np.append(last, run.last)
            else:
                whole = False
            out = cls(total, alone, whole, before, shards, last)
        return out

    def row(self, run: int) -> pa.RecordBatch:
        values = (run, self.total, self.alone, self.whole, *(np.asarray(x, "<i8").tobytes() for x in (self.before, self.shards, self.last)))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 3)
        return pa.record_batch([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["range", "total", "alone", "whole", "before", "shards", "last"])

    @classmethod
    def read(cls, row: Mapping) -> Outcomes:
        return cls(row["total"], row["alone"], row["whole"], *(np.frombuffer(row[c], "<i8") for c in ("before", "shards", "last")))


OUTCOMES = "range int, total long, alone long, whole boolean, before binary, shards binary, last binary"
#: Runs that one task puts together.
FAN = 32


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


class RangeOutcomes:
    """mapInArrow function: a range's rows (range, place, bytes) to its outcomes."""

    def __init__(self, budget: int) -> None:
        self.budget = budget

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, size in _held(batches, 3):
            yield Outcomes.of(size.to_numpy(), self.budget).row(part[0].as_py())


class Joined:
    """mapInArrow function: outcomes of neighbouring runs, sorted, to those of all of them together."""

    def __init__(self, budget: int, fan: int) -> None:
        self.budget, self.fan = budget, fan

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, rows in groupby(_each(batches), key=lambda r: r["range"] // self.fan):
            yield Outcomes.joined(map(Outcomes.read, rows), self.budget).row(run)


class Begun:
    """mapInArrow function: outcomes of neighbouring runs with the shard that is open before all of them and its bytes, to
    these for each run: (range, shard, filled)."""

    def __init__(self, budget: int, fan: int) -> None:
        self.budget, self.fan = budget, fan

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_each(batches), key=lambda r: r["range"] // self.fan):
            out, state = [], None
            for row in rows:
                state = state or (row["shard"], row["filled"])
                out.append((row["range"], *state))
                shards, filled = Outcomes.read(row).step(np.array([state[0]]), np.array([state[1]]), self.budget)
                state = int(shards[0]), int(filled[0])
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["range", "shard", "filled"])


class Assigned:
    """mapInArrow function: a range's rows, with the shard that is open and its bytes (-1: none), to their shards."""

    def __init__(self, budget: int) -> None:
        self.budget = budget

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, size, shard, filled in _held(batches, 4):
            sizes, open_ = size.to_numpy(), filled[0].as_py()
            before, following = next_cuts(sizes, self.budget)
            cuts = np.zeros(len(sizes), np.int64)
            alone = int(np.append(np.flatnonzero(sizes >= self.budget), len(sizes))[0])
            at = 0 if open_ < 0 else min(int(np.searchsorted(before, self.budget - open_, "right")) - 1, alone)
            while at < len(sizes):
                cuts[at] = 1
                at = int(following[at])
            ids = shard[0].as_py() + np.cumsum(cuts)
            yield pa.record_batch([rows, size, pa.array(ids)], names=["row_id", "bytes", "shard_id"])


def shard_plan(sizes: DataFrame, budget: int, range_rows: int = 1_000_000, fan: int = FAN) -> DataFrame:
    """(row_id, bytes, shard_id) from (row_id, bytes): a greedy contiguous cut; a row of the budget or more is alone.

    Each cut depends on the last, but within a range only on the bytes that are open where it begins. So ranges work
    out every outcome in parallel, and outcomes of ``fan`` neighbours are put together, level by level, until there is one;
    from there the open shard is handed down the same tree, and ranges number their rows. Two numbers a row are
    shuffled; no task sees all rows, and the driver sees none.
    """
    plain = sizes.select("row_id", F.col("bytes").cast("long").alias("bytes"))
    n = max(1, -(-plain.count() // range_rows))
    numbered = T_.StructType([*plain.schema.fields, T_.StructField("range", T_.IntegerType()), T_.StructField("place", T_.LongType())])
    rows = materialise(plain.repartitionByRange(n, "row_id").sortWithinPartitions("row_id").mapInArrow(Numbered(), numbered), "ranges")
    # A session may deal out into more ranges than were asked for, or fewer.
    n = (rows.agg(F.max("range").alias("last")).first()["last"] or 0) + 1
    dealt = lambda df: df.repartitionById(n, "range").sortWithinPartitions("place")
    levels, runs = [materialise(dealt(rows.select("range", "place", "bytes")).mapInArrow(RangeOutcomes(budget), OUTCOMES), "outcomes")], n
    group = F.floor(F.col("range") / fan).cast("int")
    grouped = lambda df, runs: df.repartitionById(max(1, -(-runs // fan)), group).sortWithinPartitions("range")
    widths = [runs]
    while widths[-1] > fan:
        levels.append(materialise(grouped(levels[-1], widths[-1]).mapInArrow(Joined(budget, fan), OUTCOMES), "outcomes"))
        widths.append(-(-widths[-1] // fan))
    # Before the first of all runs no shard is open.
    begun = plain.sparkSession.range(1).select(F.lit(0).alias("group"), F.lit(-1).cast("long").alias("shard"), F.lit(-1).cast("long").alias("filled"))
    for level, runs in zip(reversed(levels), reversed(widths), strict=True):
        named = level.withColumn("group", group).join(begun, "group").drop("group")
        begun = materialise(grouped(named, runs).mapInArrow(Begun(budget, fan), "range int, shard long, filled long"), "begun").withColumnRenamed("range", "group")
    known = begun.withColumnRenamed("group", "range")
    placed = dealt(rows).join(F.broadcast(known) if n <= BROADCAST_RANGES else known, "range").select("row_id", "bytes", "shard", "filled", "range", "place")
    if n > BROADCAST_RANGES:
        placed = dealt(placed)
    schema = T_.StructType([*plain.schema.fields, T_.StructField("shard_id", T_.LongType())])
    return placed.select("row_id", "bytes", "shard", "filled").mapInArrow(Assigned(budget), schema)


def rotated(checkpoints: DataFrame, keep: int) -> DataFrame:
    """Adds stays: whether a checkpoint is among the ``keep`` latest by step."""
    return checkpoints.withColumn("stays", F.row_number().over(Window.partitionBy().orderBy(F.desc("step"))) <= keep)


def latest(checkpoints: DataFrame) -> DataFrame:
    """(path, step, next_step) of the checkpoint with the greatest step."""
    return checkpoints.agg(F.max_by("path", "step").alias("path"), F.max("step").alias("step")).withColumn("next_step", F.col("step") + 1)
