"""Connected components of a distributed edge table, by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every round is written to the shared folder;
the driver sees only a count and a checksum of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textvec
from corpusloom.llm.common import materialise


#: Edges that a task replaces by a forest at once.
RUN = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges a-b but the least of its component, with that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


@textvec.releasing
def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges replaced by a spanning forest of each run of batches; connectivity is the same, paths are shorter."""
    held: list[np.ndarray] = []
    rows = 0
    schema = pa.schema([("child", pa.int64()), ("parent", pa.int64())])

    def stars() -> pa.RecordBatch:
        both = np.concatenate(held, axis=1)
        child, parent = forest(both[0], both[1])
        return pa.record_batch([pa.array(child), pa.array(parent)], schema=schema)

    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        rows += batch.num_rows
        if rows >= RUN:
            yield stars()
            held, rows = [], 0
    if rows:
        yield stars()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("child").alias("u"), F.col("parent").alias("v")).union(edges.select(F.col("parent").alias("u"), F.col("child").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("child"), F.col("m").alias("parent")).filter("child <> parent").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("child").agg(F.min("parent").alias("m"))
    moved = edges.join(low, "child").filter("parent <> m").select(F.col("parent").alias("child"), F.col("m").alias("parent"))
    return moved.union(low.select("child", F.col("m").alias("parent"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: two long columns, a link per row, in any order, repeats and loops allowed.

    Returns (child, parent): every linked node but the least of its component, with that least node. No links: no rows.
    """
    a, b = links.columns
    plain = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).distinct()
    schema = "child long, parent long"
    edges = materialise(plain.mapInArrow(_local, schema), "edges")
    # Forests of tasks are put together to runs of RUN edges, which many tasks share nodes in; few are one run.
    edges = materialise(edges.repartition(-(-edges.count() // RUN) or 1).mapInArrow(_local, schema), "edges")
    mark = None
    for _ in range(most_rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return edges
        mark = now
        edges = materialise(_small_star(_large_star(edges)), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
