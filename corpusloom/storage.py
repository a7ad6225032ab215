"""Where intermediate tables and small files go, by way of Hadoop: whatever store Spark writes to will do."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A batch that a Python worker is given has so many bytes, or a row, by Arrow's count in the JVM. Its own bounds of 10,000 rows and 64 MB let
#: both sides hold tens of MB for each batch, several times over.
BATCH_BYTES = 4 << 20
SPARK_BATCH = "67108864b"
#: By application: the folder of sessions that name none, as in tests.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A local session that names none gets one
    of its own; on a cluster that is an error, for each machine would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        context.setCheckpointDir(_own[context.applicationId])
    return _own[context.applicationId]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the application's part of the shared folder; nothing is made yet."""
    return posixpath.join(shared_dir(spark), f"corpusloom-{spark.sparkContext.applicationId}", f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, lost executors lose nothing."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark send batches of BATCH_BYTES to Python workers from now on. It holds for the session, for results are worked
    out after an operator has returned; a session that names a bound of its own keeps it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == SPARK_BATCH:
        spark.conf.set(name, f"{BATCH_BYTES}b")


class Files:
    """Small files and folders of any store."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.conf), at

    def uri(self, path: str) -> str:
        """The path with its scheme."""
        fs, at = self._at(path)
        return fs.makeQualified(at).toUri().toString()

    def local(self, path: str) -> bool:
        """Whether it is on a local disk, or one that is mounted alike on all machines."""
        return self.uri(path).startswith("file:")

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def status(self, path: str) -> tuple[str, int, int, bool]:
        """(whole path, seconds of modification, bytes, whether it is a folder); zeros for what isn't there."""
        fs, at = self._at(path)
        whole = fs.makeQualified(at).toUri().getPath()
        if not fs.exists(at):
            return whole, 0, 0, False
        found = fs.getFileStatus(at)
        return whole, found.getModificationTime() // 1000, found.getLen(), found.isDirectory()

    def names(self, folder: str) -> list[str]:
        fs, at = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def make_dir(self, path: str) -> None:
        fs, at = self._at(path)
        fs.mkdirs(at)

    def remove(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def write(self, path: str, text: str) -> None:
        fs, at = self._at(path)
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
