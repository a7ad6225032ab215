"""Structured Streaming: first occurrences, windowed metrics, running state of sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from corpusloom.storage import Files, fresh_dir


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The files at a path as a stream, with ts as a timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    # A pattern that only this path matches: a stream takes a single file in no other way.
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def first_seen(stream: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    """Each key once; a key is forgotten once the watermark has passed it."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, value) by tumbling window."""
    grouped = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


class _Folded(StatefulProcessor):
    """A sequence's chunks in their own order, whatever order they come in: a chunk is folded in once all before it are."""

    def __init__(self, patience: int | None) -> None:
        #: Milliseconds that a sequence with a gap waits for what is missing; None: for ever.
        self.patience = patience

    def init(self, handle) -> None:
        self.handle = handle
        #: The chunk that is next, -1 once all are folded in; the tokens before it; how many chunks wait.
        self.done = handle.getValueState("done", "chunk_idx long, past long, held long")
        self.waiting = handle.getListState("waiting", "chunk_idx long, kept array<long>, last boolean")

    def _rows(self, key, waiting: list[tuple], following: int, past: int) -> tuple[list[tuple], list[tuple], int, int]:
        out = []
        held = {w[0]: w for w in waiting}
        while following in held:
            _, kept, last = held.pop(following)
            out.append((key, following, past, kept))
            past, following = past + len(kept), -1 if last else following + 1
        return out, [held[k] for k in sorted(held)], following, past

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """Rows there and back, not a frame for each sequence; the state is asked once, and once more where chunks wait."""
        following, past, waits = self.done.get() or (0, 0, 0)
        # A chunk that comes again replaces itself; one that has been folded in is passed over.
        held = {int(w[0]): (int(w[0]), [int(x) for x in w[1]], bool(w[2])) for w in self.waiting.get()} if waits else {}
        for r in rows:
            if r["chunk_idx"] >= following >= 0:
                held[r["chunk_idx"]] = (r["chunk_idx"], [x for x, kept in zip(r["input_ids"], r["regular_token_mask"], strict=True) if kept], r["last"])
        out, left, following, past = self._rows(key[0], list(held.values()), following, past)
        if following < 0:
            # Whole. That it is done is all that is kept, so that what comes again gives nothing.
            left = []
        if self.patience is not None:
            for timer in [int(t) for t in self.handle.listTimers()]:
                self.handle.deleteTimer(timer)
            if left:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        self.done.update((following, past, len(left)))
        if left:
            self.waiting.put(left)
        elif waits:
            self.waiting.clear()
        for row in out:
            yield Row(seq_id=row[0], chunk_idx=row[1], past=row[2], kept=row[3])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """What waits is given without a past, and the sequence is over."""
        left = [(int(w[0]), [int(x) for x in w[1]]) for w in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        self.done.update((-1, 0, 0))
        for idx, kept in sorted(left):
            yield Row(seq_id=key[0], chunk_idx=idx, past=None, kept=kept)

    def close(self) -> None:
        pass


def kept_state(stream: DataFrame, patience: str | None = None) -> DataFrame:
    """(seq_id, chunk_idx, past, kept) from chunks (seq_id, chunk_idx, input_ids, regular_token_mask, last): the regular
    tokens of each chunk and how many came before it, as in a batch, though chunks come in any order, over any batches.

    A chunk waits in the state for those before it, at most ``patience`` of processing time if one is given; then what waits
    is given with a null past. After the chunk that is marked last a sequence is over. The state store must keep lists:
    RocksDB. With a patience a query has timers to look after, and doesn't end by itself when its input does.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    made = _Folded(None if patience is None else int(pd.Timedelta(patience).total_seconds() * 1000))
    key = stream.schema["seq_id"].dataType.simpleString()
    return stream.groupBy("seq_id").transformWithState(made, f"seq_id {key}, chunk_idx long, past long, kept array<long>", "Append", "None" if patience is None else "ProcessingTime")


def past_seen(stream: DataFrame, patience: str | None = None) -> DataFrame:
    """(seq_id, chunk_idx, past) from (seq_id, chunk_idx, n_regular): tokens seen before each chunk, in the chunks' order."""
    ones = F.array_repeat(F.lit(1).cast("long"), F.col("n_regular").cast("int"))
    named = stream.select("seq_id", "chunk_idx", ones.alias("input_ids"), ones.alias("regular_token_mask"), F.lit(False).alias("last"))
    return kept_state(named, patience).select("seq_id", "chunk_idx", "past")


def endless_batches(spark: SparkSession, plan: Callable[[int], DataFrame], whole: int, folder: str, deliver: Callable[[DataFrame, int], None], each: int = 1):
    """A writer of batches that go on from epoch to epoch, ``each`` at a time, with a cursor that outlives the query.

    plan: an epoch to its batches (batch, ...), numbered from 0 up to ``whole``; it is made once for an epoch and kept in
    the folder. deliver gets the rows of the next batches, with epoch and cursor, the number of the batch over all epochs,
    and the number of the delivery, which is the same if it is made again. The cursor is the offset of a source of numbers, in
    the query's checkpoint: started again, it goes on after what was delivered.
    """
    def made(epoch: int) -> DataFrame:
        path = f"{folder}/plan/epoch={epoch}"
        if not Files(spark).exists(f"{path}/_SUCCESS"):
            plan(epoch).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path).withColumns({"epoch": F.lit(epoch).cast("long"), "cursor": (F.col("batch") + epoch * whole).cast("long")})

    def write(ticks: DataFrame, number: int) -> None:
        low, high = ticks.agg(F.min("value"), F.max("value")).first()
        if low is None:
            return
        parts = [made(e).filter(F.col("cursor").between(low, high)) for e in range(low // whole, high // whole + 1)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        deliver(out, number)

    if whole < 1:
        raise ValueError("an epoch has no whole batch")
    numbers = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", each).load()
    return numbers.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream over present files amounts to: run to its end into a table in the shared folder.

    A batch is a folder, written over if it is run again. In append mode all batches are the result, else the last one.
    """
    spark, done = stream.sparkSession, []
    path = fresh_dir(spark, "drained")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        done.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    parts = sorted(set(done)) if mode == "append" else done[-1:]
    return spark.read.schema(stream.schema).parquet(*[f"{path}/{k}" for k in parts]) if parts else spark.createDataFrame([], stream.schema)


def metric_rows(batch: DataFrame, step: str = "step") -> DataFrame:
    """(step, name, value): the numeric columns of a batch of metrics, a row each; texts, flags and nulls are left out."""
    numbers = [c for c, kind in batch.dtypes if c != step and (kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"))]
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in numbers])
    return batch.select(F.col(step).cast("long").alias("step"), F.inline(each)).filter("value is not null")


def log_metrics(stream: DataFrame, path: str, step: str = "step"):
    """A running query that appends a stream of metrics to a table by foreachBatch; a batch that is run again replaces
    what it wrote."""
    def write(batch: DataFrame, number: int) -> None:
        metric_rows(batch, step).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
