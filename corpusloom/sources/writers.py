"""Sinks: JSON lines, reports, payloads, sharded datasets, checkpoints and metrics."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.batches import latest, rotated, row_size, shard_plan
from corpusloom.storage import Files, bounded_batches, materialise

VERSION = 2


def put_text(df_or_spark, path: str, text: str) -> None:
    """A small text file by way of Hadoop, so that any store that Spark writes to will do."""
    Files(df_or_spark.sparkSession if isinstance(df_or_spark, DataFrame) else df_or_spark).write(path, text)


class Timer:
    """with Timer() as t: ... ; then t.seconds is the time that went by."""

    def __enter__(self) -> Timer:
        self.began, self.seconds = time.perf_counter(), 0.0
        return self

    def __exit__(self, *_) -> None:
        self.seconds = time.perf_counter() - self.began


def write_json_lines(df: DataFrame, path: str, order: str | None = None, files: int | None = None) -> None:
    """JSON lines in UTF-8 with nulls kept; in one file, in order, if asked for."""
    out = df if files is None else df.coalesce(files)
    out = out if order is None else out.sortWithinPartitions(order)
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def report(counts: Mapping[str, object], **extra: object) -> str:
    """A run report as JSON."""
    return json.dumps({"timestamp": time.strftime("%Y-%m-%d %H:%M:%S"), **counts, **extra}, ensure_ascii=False, indent=2)


def throughput(pairs: DataFrame, elapsed: float) -> DataFrame:
    """One row of totals and rates over (in_tokens, out_tokens); rates are null if no time has gone by."""
    n = pairs.agg(F.count(F.lit(1)).alias("num_samples"), F.coalesce(F.sum("in_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("out_tokens"), F.lit(0)).alias("output_tokens"))
    rate = lambda c: F.when(F.lit(elapsed) > 0, F.col(c) / F.lit(elapsed or 1.0))
    return n.withColumn("total_tokens", F.col("prompt_tokens") + F.col("output_tokens")).withColumn("samples_per_sec", rate("num_samples")).withColumn("tok_per_sec", rate("total_tokens"))


def write_payload(pairs: DataFrame, folder: str, prefix: str, config: Mapping[str, object], elapsed: float) -> str:
    """Results as JSON lines, config and runtime as JSON beside them; the folder's name carries the time.

    Fixed values: the names of the payload's parts.
    """
    path = f"{folder}/{prefix}_{time.strftime('%Y%m%d-%H%M%S')}"
    pairs.select("input", "output").write.mode("overwrite").json(f"{path}/results")
    runtime = {"elapsed_sec": elapsed} | throughput(pairs, elapsed).first().asDict()
    put_text(pairs, f"{path}/payload.json", json.dumps({"config": dict(config), "runtime": runtime}, ensure_ascii=False, indent=2))
    return path


def generate(prompts: DataFrame, generator: Callable, schema: str) -> DataFrame:
    """Prompts through an outside model: a function over an iterator of pandas frames."""
    return prompts.mapInPandas(generator, schema)


def cache_key(meta: Mapping[str, object]) -> str:
    """Sixteen hexadecimal digits that follow from the settings, in whatever order they are."""
    return hashlib.sha1(json.dumps(meta, sort_keys=True).encode()).hexdigest()[:16]


def cache_folder(root: str, source: tuple, tokenizer: object, draft: int, seed: int) -> str:
    """Where the rows of these sources and settings are kept: the name follows from all of them."""
    return f"{root}/{cache_key({'version': VERSION, 'source': list(source), 'tokenizer': tokenizer, 'draft_length': draft, 'shuffle_seed': seed})}"


@dataclass
class Report:
    """What a run says about itself: sums over the rows that a job has written, from that job, and the seconds it took.

    Columns are aggregates over the rows that are written; a job that is run again says it anew.
    """

    counts: dict[str, object] = field(default_factory=dict)
    seconds: float = 0.0

    def write(self, df: DataFrame, save: Callable[[DataFrame], None], *sums: Column) -> Report:
        """Have save write df and note its sums; an alias names each of them."""
        seen = Observation()
        with Timer() as t:
            save(df.observe(seen, F.count(F.lit(1)).alias("rows"), *sums))
        self.counts, self.seconds = dict(seen.get), t.seconds
        return self

    def text(self, **extra: object) -> str:
        n = self.counts.get("rows", 0)
        return report(self.counts, elapsed_sec=self.seconds, rows_per_sec=n / self.seconds if self.seconds else None, **extra)


#: Columns of staged rows: the range that a task sorted, the place in all of them, and the estimated bytes.
RANGE, AT, BYTES = "_range", "_at", "_bytes"


def _staged(rows: DataFrame, folder: str, order: list[str], size: Column) -> tuple[DataFrame, int]:
    """rows in order, with their places and bytes, and a digest of them whatever their ranges; written once.

    Equal orders are told apart by a hash of the row, so that the same rows are always in the same order.
    """
    spark, at, mark = rows.sparkSession, f"{folder}/staged", f"{folder}/staged.json"
    files = Files(spark)
    tie = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in rows.dtypes])
    if not files.exists(mark):
        # As they come at first: the sort runs what it sorts twice, once for its bounds.
        rows.withColumns({BYTES: size, "_tie": tie}).write.mode("overwrite").parquet(f"{folder}/unsorted")
        keyed = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField(BYTES, T.LongType()), T.StructField("_tie", T.LongType())])).parquet(f"{folder}/unsorted")
        keys = [*order, "_tie"]
        placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(AT, F.monotonically_increasing_id())
        # The range is in the upper bits of the place.
        out = placed.withColumn(RANGE, F.shiftright(AT, 33).cast("int"))
        digest = F.sum(F.xxhash64("_tie", BYTES).cast("decimal(38,0)")).cast("string")
        seen = Report().write(out, lambda df: df.drop("_tie").write.mode("overwrite").partitionBy(RANGE).parquet(at), F.coalesce(F.sum(F.col(BYTES)), F.lit(0)).alias("bytes"), digest.alias("digest"))
        files.write(mark, json.dumps(seen.counts))
        files.remove(f"{folder}/unsorted")
    known = json.loads(files.read(mark))
    schema = T.StructType([*rows.schema.fields, T.StructField(BYTES, T.LongType()), T.StructField(AT, T.LongType()), T.StructField(RANGE, T.IntegerType())])
    return (spark.read.schema(schema).parquet(at) if known["rows"] else spark.createDataFrame([], schema)), known


#: Places are looked up in blocks of so many, or of more where there would be over MOST_BLOCKS blocks; bytes that a task writes.
PLACES, MOST_BLOCKS, TASK_BYTES = 64, 100_000, 64 << 20


def _block(at: str, rows: int) -> Column:
    """The block of a place within its range."""
    return F.floor(F.col(at).bitwiseAND((1 << 33) - 1) / max(PLACES, rows // MOST_BLOCKS)).cast("long")


def _begins(plan: DataFrame, rows: int) -> DataFrame:
    """(range, block, begins): for each block of places where shards begin in it, the open one at its first place."""
    each = plan.groupBy(F.shiftright("row_id", 33).cast("int").alias(RANGE), _block("row_id", rows).alias("_block"), "shard_id").agg(F.min("row_id").alias("at"))
    return each.groupBy(RANGE, "_block").agg(F.array_sort(F.collect_list(F.struct("at", "shard_id"))).alias("_begins"))


def _in_shards(staged: DataFrame, begins: DataFrame, rows: int) -> DataFrame:
    """Staged rows with their shard_id, without a shuffle: a row for each block and an element for each shard are broadcast."""
    found = staged.withColumn("_block", _block(AT, rows)).join(F.broadcast(begins), [RANGE, "_block"])
    shard = F.element_at(F.filter("_begins", lambda x: x["at"] <= F.col(AT)), -1)["shard_id"]
    return found.withColumn("shard_id", shard).drop("_block", "_begins")


def _runs(shards: list[int], most: int) -> Iterator[list[int]]:
    """Numbers in order, cut where one is left out and after ``most``."""
    own: list[int] = []
    for k in shards:
        if own and (k != own[-1] + 1 or len(own) == most):
            yield own
            own = []
        own.append(k)
    if own:
        yield own


class ShardFiles:
    """mapInArrow function: rows sorted by shard_id, whole shards in a task, to one Parquet file for each, (shard_id, rows).

    A file is written elsewhere and moved to its place, where it takes that of any other of its shard; its name follows from
    the job and the task, so that another attempt puts the same there again.
    """

    def __init__(self, folder: str, work: str) -> None:
        self.folder, self.work = folder, work

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []
        for batch in batches:
            shard = batch.column("shard_id").to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for low, high in zip(edge, edge[1:], strict=False):
                if low < high:
                    if held and own != shard[low]:
                        yield self.saved(own, held)
                        held = []
                    own = int(shard[low])
                    held.append(batch.slice(low, high - low))
        if held:
            yield self.saved(own, held)

    def saved(self, shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        fs, folder = pafs.FileSystem.from_uri(f"{self.folder}/shard_id={shard}")
        job = pafs.FileSystem.from_uri(self.work)[1]
        work, name = f"{job}/{uuid.uuid4().hex}", f"part-{TaskContext.get().partitionId():05d}-{job[-32:]}.parquet"
        table = pa.Table.from_batches(held).drop_columns(["shard_id"])
        pq.write_table(table, work, filesystem=fs, compression="snappy", store_schema=False)
        fs.create_dir(folder)
        for other in fs.get_file_info(pafs.FileSelector(folder)):
            if other.base_name != name:
                fs.delete_file(other.path)
        fs.move(work, f"{folder}/{name}")
        return pa.record_batch([pa.array([shard]), pa.array([table.num_rows])], names=["shard_id", "rows"])


def _save_shards(df: DataFrame, folder: str) -> None:
    """Write whole shards, which df's tasks have sorted, in place of what these shards had.

    On a local disk Hadoop starts a process for each file and folder that is made, to set its permissions, where its native
    library is missing; shards are small and many, so that their files are written from tasks there.
    """
    files, kinds = Files(df.sparkSession), df.schema.simpleString()
    if files.local(folder) and not any(x in kinds for x in ("interval", "variant", "udt", "void")):
        at, work = files.uri(folder), files.uri(f"{folder}-{uuid.uuid4().hex}")
        files.make_dir(work)
        df.mapInArrow(ShardFiles(at, work), "shard_id long, rows long").write.format("noop").mode("overwrite").save()
        files.remove(work)
    else:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("shard_id").parquet(folder)


def write_dataset(
    rows: DataFrame, folder: str, row_id: str | list[str], budget: int, meta: Mapping[str, object], per_job: int | None = None, then: Callable[[DataFrame], DataFrame] | None = None, size: Column | None = None
) -> dict:
    """Rows as Parquet in shards of at most ``budget`` estimated bytes, contiguous in the order of row_id, with a manifest.

    1. One job writes the rows as they come, so that the source is run once; another sorts them by range and stages them with
       their places. Repeated ids are rows of their own.
    2. Places and bytes make up the plan. Its digest follows from rows, order and budget.
    3. Jobs of ``per_job`` shards each read their stretch of the staged rows and replace just their shards, a task some
       shards that are next to each other, however the rows were staged; a mark, written after a job, names the plan, the
       shards and their rows, as counted by the job that wrote them.
    4. The manifest is made of the marks; a sum of rows that isn't the source's is an error.

    With ``then``, rows are staged as they are and become those of the dataset only where shards are written: it makes one row
    of each, in place, and keeps columns that it doesn't know. ``size`` is the estimated bytes of a row as the dataset has it.

    Broken off anywhere and called again, with this budget or another and any ``per_job``, it goes on with the shards that no
    mark of the same plan names. Marks of another plan are removed before anything is written. Once there is a manifest,
    nothing is written. No rows: no shards, and a manifest that has their schema.
    """
    spark, then = rows.sparkSession, then or (lambda df: df)
    files, marks, schema = Files(spark), f"{folder}/done", then(rows).schema
    if files.exists(f"{folder}/manifest.json"):
        return json.loads(files.read(f"{folder}/manifest.json"))
    bounded_batches(spark)
    staged, known = _staged(rows, folder, [row_id] if isinstance(row_id, str) else list(row_id), row_size(rows) if size is None else size)
    plan = materialise(shard_plan(staged.select(F.col(AT).alias("row_id"), F.col(BYTES).alias("bytes")), budget), "plan")
    shards = plan.groupBy("shard_id").agg(F.min("row_id").alias("first"), F.max("row_id").alias("last"), F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"))
    begins = materialise(_begins(plan, known["rows"]), "begins")
    # One row for each shard, five numbers each; by its number.
    shards = materialise(shards, "shards").toArrow().sort_by("shard_id")
    number, firsts, lasts, counts, weights = (shards[c].to_numpy() for c in ("shard_id", "first", "last", "rows", "bytes"))
    digest = cache_key({"budget": budget, "rows": known, "shards": counts.tolist()})
    done: dict[int, int] = {}
    for name in files.names(marks):
        mark = json.loads(files.read(f"{marks}/{name}") or "{}")
        if mark.get("plan") == digest:
            done |= {int(k): n for k, n in mark["rows"].items()}
        else:
            files.remove(f"{marks}/{name}")
    for own in _runs([k for k in number.tolist() if k not in done], per_job or max(4096, -(-len(number) // 8))):
        # Numbers without a gap, and so are their places.
        at = slice(i := int(np.searchsorted(number, own[0])), i + len(own))
        first, last = int(firsts[at][0]), int(lasts[at][-1])
        part = staged.filter((F.col(RANGE) >= first >> 33) & (F.col(RANGE) <= last >> 33) & F.col(AT).between(first, last))
        tasks = min(len(own), max(4 * spark.sparkContext.defaultParallelism, int(weights[at].sum()) // TASK_BYTES))
        task = F.floor((F.col("shard_id") - own[0]) * tasks / len(own)).cast("int")
        out = _in_shards(part, begins, known["rows"]).repartitionById(tasks, task).sortWithinPartitions("shard_id", AT).drop(RANGE, AT, BYTES)
        out = then(out)
        save = lambda df: _save_shards(df, f"{folder}/rows")
        wrote = Report().write(out, save).counts["rows"]
        if wrote != (planned := int(counts[at].sum())):
            raise RuntimeError(f"shards {own[0]} to {own[-1]} have {wrote} rows of {planned}")
        has = dict(zip(own, counts[at].tolist(), strict=True))
        files.write(f"{marks}/{own[0]}", json.dumps({"plan": digest, "rows": has}))
        done |= has
    if sum(done.values()) != known["rows"]:
        raise RuntimeError(f"the shards have {sum(done.values())} rows of {known['rows']}")
    # The names of the manifest's parts, but for the schema's.
    manifest = {"version": VERSION, "mode": "sharded", "target_bytes_per_shard": budget, "total_rows": known["rows"], "num_shards": len(done), "shards": [f"shard_id={k}" for k in sorted(done)], "build_meta": dict(meta), "schema": schema.jsonValue()}
    files.write(f"{folder}/rows/_SUCCESS", "")
    put_text(rows, f"{folder}/manifest.json", json.dumps(manifest, ensure_ascii=False, indent=2))
    files.remove(f"{folder}/staged")
    files.remove(f"{folder}/staged.json")
    return manifest


class Checkpoints:
    """Folders step_<n> under a root of any store: save by a writer, keep the latest few, resume after the greatest."""

    def __init__(self, root: str, keep: int = 3) -> None:
        self.root, self.keep = root.rstrip("/"), keep

    def listed(self, spark) -> DataFrame:
        rows = [(f"{self.root}/{x}", int(x[5:])) for x in Files(spark).names(self.root) if x.startswith("step_") and x[5:].isdigit()]
        return spark.createDataFrame(rows, "path string, step long")

    def save(self, spark, step: int, write: Callable[[str], None]) -> None:
        files, path = Files(spark), f"{self.root}/step_{step}"
        files.make_dir(path)
        write(path)
        files.write(f"{self.root}/latest.json", json.dumps({"path": path, "step": step}))
        for r in rotated(self.listed(spark), self.keep).filter("not stays").collect():
            files.remove(r["path"])

    def resume(self, spark) -> tuple[str, int] | None:
        """(path, next step), by latest.json or else by the greatest step."""
        files, mark = Files(spark), f"{self.root}/latest.json"
        if files.exists(mark) and files.exists((found := json.loads(files.read(mark)))["path"]):
            return found["path"], found["step"] + 1
        r = latest(self.listed(spark)).first()
        return (r["path"], r["next_step"]) if r["path"] else None


class Sink:
    """Does nothing with metrics."""

    def log(self, metrics: Mapping[str, object], step: int) -> None:
        pass

    def close(self) -> None:
        pass


class TableSink(Sink):
    """Numbers as rows (step, name, value), appended to a Parquet table."""

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path, self.rows = spark, path, []

    def log(self, metrics: Mapping[str, object], step: int) -> None:
        self.rows += [(step, k, float(v)) for k, v in metrics.items() if isinstance(v, int | float) and not isinstance(v, bool)]

    def close(self) -> None:
        if self.rows:
            self.spark.createDataFrame(self.rows, "step long, name string, value double").write.mode("append").parquet(self.path)
        self.rows = []


def sink(kind: str, *args) -> Sink:
    """none or table; anything else is an error."""
    kinds = {"none": Sink, "table": TableSink}
    if kind not in kinds:
        raise ValueError(f"no sink {kind!r}; there are {', '.join(kinds)}")
    return kinds[kind](*args)
