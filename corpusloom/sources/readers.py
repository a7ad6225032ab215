"""Scans: records in JSON lines or whole documents, cached datasets, weight files, fingerprints."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import prompts
from corpusloom.storage import Files

MESSAGE = "array<struct<`from`:string,value:string,role:string,content:string>>"
#: Everything a raw record may have; what it lacks is null.
RECORD = f"conversations {MESSAGE}, messages {MESSAGE}, prompt string, input string, question string, output string"


def read_records(spark: SparkSession, path: str | list[str], schema: str | T.StructType = RECORD) -> DataFrame:
    """JSON lines with an explicit schema; blank and malformed lines are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_tagged(spark: SparkSession, paths: list[str], bucket_of: dict[str, str]) -> DataFrame:
    """Records of several files with file, and bucket by the file's name."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    pairs = [x for k, v in bucket_of.items() for x in (F.lit(k), F.lit(v))]
    return read_records(spark, paths).select("*", name.alias("file")).withColumn("bucket", F.try_element_at(F.create_map(*pairs), F.col("file")))


def read_column(df: DataFrame, column: str, most: int | None = None, seed: int = 42) -> DataFrame:
    """One column as prompt; of more than ``most`` rows a seeded sample, equal texts counting each."""
    rows = df.select(F.col(column).alias("prompt"))
    return rows if most is None else prompts.sample(rows, most, seed, "prompt")


def normalised_prompts(records: DataFrame) -> DataFrame:
    """prompt, or input where there is no prompt; records with neither are dropped, other columns stay."""
    found = F.coalesce(*[F.col(c) for c in ("prompt", "input") if c in records.columns])
    return records.withColumn("prompt", found).filter(F.col("prompt").isNotNull())


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(input, output) of a JSON document: a list of records, or an object that has them under results."""
    pair = "struct<input:string,output:string>"
    raw = spark.read.schema(f"input string, output string, results array<{pair}>").option("multiLine", True).json(path)
    whole = F.when(F.col("results").isNotNull(), F.col("results")).otherwise(F.array(F.struct("input", "output")))
    return raw.select(F.inline(whole)).filter("input is not null or output is not null")


def _exists(spark: SparkSession, path: str) -> bool:
    return Files(spark).exists(path)


@contextmanager
def _few_listers(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by some tasks a core, not by one each."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Types of columns that tasks read with Arrow, and shards that a task reads.
PLAIN = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
TASK_SHARDS = 4096


class ShardRows:
    """mapInArrow function: numbers of shards (id) to columns of their rows. A shard that isn't there is an error."""

    def __init__(self, folder: str, kinds: dict[str, str]) -> None:
        self.folder, self.kinds = folder, kinds

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(self.folder)
        schema = pa.schema([(c, PLAIN[kind]) for c, kind in self.kinds.items()])
        for batch in batches:
            numbers = batch.column("id").to_pylist()
            for low in range(0, len(numbers), 256):
                held = [schema.empty_table()]
                for k in numbers[low : low + 256]:
                    for found in fs.get_file_info(pafs.FileSelector(f"{folder}/shard_id={k}")):
                        if found.base_name[0] not in "._":
                            with fs.open_input_file(found.path) as file:
                                held.append(pq.ParquetFile(file).read(columns=schema.names).select(schema.names).cast(schema))
                yield from pa.concat_tables(held).combine_chunks().to_batches()


def read_dataset(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame | None:
    """The rows of a cached dataset with their shard_id, shard by shard as its manifest lists them, or whole; None if it
    isn't complete. A dataset without rows has the columns that its manifest names.

    With ``columns`` those alone, without shard_id: on a local disk tasks find and read shards by their numbers, so that the driver
    neither lists the files nor has a task for every few of them.
    """
    if columns is not None:
        manifest = read_manifest(spark, folder) if _exists(spark, f"{folder}/rows/_SUCCESS") else None
        kinds = {f.name: f.dataType.simpleString() for f in T.StructType.fromJson(manifest["schema"]).fields} if manifest else {}
        n, files = len(manifest["shards"]) if manifest else 0, Files(spark)
        if n and files.local(folder) and all(kinds.get(c) in PLAIN for c in columns) and all(s == f"shard_id={k}" for k, s in enumerate(manifest["shards"])):
            own = {c: kinds[c] for c in columns}
            numbers = spark.range(0, n, 1, max(min(n, 4 * spark.sparkContext.defaultParallelism), n // TASK_SHARDS))
            return numbers.mapInArrow(ShardRows(files.uri(f"{folder}/rows"), own), T.StructType([T.StructField(c, T._parse_datatype_string(kind)) for c, kind in own.items()]))
        found = read_dataset(spark, folder)
        return None if found is None else found.select(*columns)
    if not _exists(spark, f"{folder}/rows/_SUCCESS"):
        return None
    manifest = read_manifest(spark, folder)
    if manifest is None:
        return spark.read.parquet(f"{folder}/rows")
    schema = T.StructType([*T.StructType.fromJson(manifest["schema"]).fields, T.StructField("shard_id", T.LongType())])
    n = len(manifest["shards"])
    if not n:
        return spark.createDataFrame([], schema)
    if manifest["shards"] == [f"shard_id={k}" for k in range(n)]:
        # Numbered through: one folder to list, whatever the number of shards; others there are left out by their number.
        with _few_listers(spark):
            return spark.read.schema(schema).parquet(f"{folder}/rows").filter(F.col("shard_id") < n)
    return spark.read.schema(schema).option("basePath", f"{folder}/rows").parquet(*[f"{folder}/rows/{s}" for s in manifest["shards"]])


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    files = Files(spark)
    return json.loads(files.read(f"{folder}/manifest.json")) if files.exists(f"{folder}/manifest.json") else None


def weight_files(index: DataFrame) -> DataFrame:
    """(file): the distinct files of an index {weight_map: {name: file}}."""
    return index.select(F.explode(F.map_values("weight_map")).alias("file")).distinct()


def resolve_weights(spark: SparkSession, folder: str, ends: tuple[str, ...] = (".safetensors", ".bin")) -> list[str]:
    """The weight files of a folder: those that its index names, or else its only one; none or several are an error."""
    names = Files(spark).names(folder)
    index = [x for x in names if x.endswith(".index.json")]
    if len(index) == 1:
        rows = spark.read.schema("weight_map map<string,string>").option("multiLine", True).json(f"{folder}/{index[0]}")
        return sorted(r["file"] for r in weight_files(rows).collect())
    found = [x for x in names if x.endswith(ends)]
    if len(index) > 1 or len(found) != 1:
        raise ValueError(f"{folder} has {len(index)} indexes and {len(found)} weight files")
    return found


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """(whole path, seconds of modification, bytes) of a file; zeros if it isn't there.

    Of a folder the latest time and the bytes of all its files, and a digest of their places, times and bytes.
    """
    whole, seconds, size, folder = Files(spark).status(path)
    if not folder:
        return whole, seconds, size
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    mark = F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")).cast("string")
    r = found.agg(F.max(F.unix_seconds("modificationTime")).alias("seconds"), F.sum("length").alias("size"), mark.alias("mark")).first()
    return whole, r["seconds"] or 0, r["size"] or 0, r["mark"] or ""


def fingerprints(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(file, bytes, modified) of the files at a path; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.unix_seconds("modificationTime").alias("modified"))
