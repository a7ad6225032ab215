"""What the operators share: tables cut from their lineage, checked broadcasts, files in the shared folder."""

from __future__ import annotations

import gc
import os
import posixpath
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.storage import BATCH_BYTES, bounded_batches, fresh_dir, materialise, shared_dir

__all__ = ["BATCH_BYTES", "BROADCAST_ROWS", "WORD", "bounded_batches", "clean", "filesystem", "fresh_dir", "hub_join", "materialise", "maybe_broadcast", "remove", "shared_dir", "sweep_up", "table", "write_whole"]

#: What separates words, as a pattern for Java and RE2: blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: A broadcast side may have so many rows; beyond, the join shuffles.
BROADCAST_ROWS = 250_000


def clean(spark: SparkSession) -> None:
    """Remove all intermediate tables and files of this application. What it returned must have been written by then."""
    remove(posixpath.dirname(fresh_dir(spark, "")))


def remove(*uris: str) -> None:
    """Remove files or folders; those that aren't there are no error."""
    for uri in uris:
        fs, path = filesystem(uri)
        kind = fs.get_file_info(path).type
        if kind == pafs.FileType.Directory:
            fs.delete_dir(path)
        elif kind == pafs.FileType.File:
            fs.delete_file(path)


def sweep_up(spark: SparkSession) -> None:
    """Have the driver collect its garbage: only then are the shuffle files of jobs that have ended removed, which a
    quick succession of jobs would otherwise pile up on the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a materialised narrow df if it has at most ``rows`` rows; else leave it to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hub_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, rows: int, share: int = 10_000, how: str = "inner") -> DataFrame:
    """left joined with right, whose keys are unique and whose column n says how many rows of left have them.

    Keys of many rows, hubs, are joined in several places, about ``share`` rows of left in each, or more where left has
    so many that there would be over BROADCAST_ROWS hubs: their list is always broadcast, and its size has that bound.
    rows: the rows of left, or an upper bound. left is dealt by a hash of its rows: equal ones go together.
    """
    share = max(share, rows // BROADCAST_ROWS + 1)
    last = F.floor(F.col(n) / share).cast("long")
    hubs = materialise(right.filter(F.col(n) >= share).select(*keys, last.alias("_last")), "hubs")
    dealt = left.join(F.broadcast(hubs), keys, "left").withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.coalesce("_last", F.lit(0).cast("long")) + 1)).drop("_last")
    copies = right.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """An Arrow file system and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def write_whole(uri: str, write) -> None:
    """Call write(stream) on a temporary file beside uri, then move it there: readers see whole files only. What is there
    already stays: a former attempt of the task wrote the same."""
    fs, path = filesystem(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(temporary, compression=None) as out:
        write(out)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        fs.move(temporary, path)
    else:
        fs.delete_file(temporary)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
