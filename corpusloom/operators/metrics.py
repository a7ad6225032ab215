"""Losses, accuracies and step statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V

#: Width of the ranges that sums of exponentials are kept by; exp(-width) is far above the floor of a sum.
BINNED = 16.0


def with_next(vectors: DataFrame, key: str, value: str, offset: int = 1) -> DataFrame:
    """(key, value, next): each row beside the one whose key is ``offset`` greater. An equi-join on the key."""
    later = vectors.select((F.col(key) - offset).alias(key), F.col(value).alias("next"))
    return vectors.select(key, value).join(later, key)


def log_sum_exp_parts(rows: DataFrame, keys: list[str], student: str, teacher: str) -> DataFrame:
    """(keys, loss) of long rows, a row per coordinate, in one pass with mergeable sums, so that vectors may be of any
    width and are never gathered.

    Sums are kept by range of BINNED of student and teacher, relative to the range's upper end, so that no maximum is
    needed first; the few ranges of a vector are then rescaled to its highest ones and merged.
    """
    ends = [F.ceil(F.col(c) / BINNED).alias(f"_{k}") for c, k in ((student, "x"), (teacher, "t"))]
    weight = F.exp(F.col(teacher) - BINNED * F.col("_t"))
    sums = (F.sum(F.exp(F.col(student) - BINNED * F.col("_x"))).alias("dx"), F.sum(weight).alias("dt"), F.sum(weight * F.col(student)).alias("s"))
    parts = rows.select(*keys, F.col(student), F.col(teacher), *ends).groupBy(*keys, "_x", "_t").agg(*sums)
    whole = parts.groupBy(*keys).agg(F.max("_x").alias("m"), F.max("_t").alias("mt"), F.collect_list(F.struct("_x", "_t", "dx", "dt", "s")).alias("parts"))
    merged = lambda part, end, top: F.aggregate("parts", F.lit(0.0), lambda a, p: a + p[part] * F.exp((p[end] - F.col(top)) * BINNED))
    dx, dt, s = merged("dx", "_x", "m"), merged("dt", "_t", "mt"), merged("s", "_t", "mt")
    return whole.select(*keys, (-(s / F.greatest(dt, F.lit(V.FLOOR))) + BINNED * F.col("m") + F.ln(F.greatest(dx, F.lit(V.FLOOR)))).alias("loss"))


def mean_pair_loss(pairs: DataFrame, loss: str) -> DataFrame:
    """(ce, pairs, mean): the sum of losses over the number of pairs, one at least."""
    return pairs.agg(F.coalesce(F.sum(loss), F.lit(0.0)).alias("ce"), F.count(loss).alias("pairs")).withColumn("mean", F.col("ce") / F.greatest(F.lit(1), F.col("pairs")))


def draft_accuracy(blocks: DataFrame, keys: list[str], order: str, student: str, teacher: str, draft: int) -> DataFrame:
    """(d, matches, pairs, regular, acc, acc_per_pair): the student at block r against the teacher at r + d + 1.

    acc divides by all regular tokens, so later offsets come out low; acc_per_pair divides by the pairs there are.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    ahead = F.array(*[F.lead(teacher, d + 1).over(w) for d in range(draft)])
    rows = blocks.select(F.col(student).alias("_s"), ahead.alias("_t")).select("_s", F.posexplode("_t").alias("d", "t"))
    counted = rows.groupBy("d").agg(F.sum((F.col("_s") == F.col("t")).cast("long")).alias("matches"), F.count("t").alias("pairs"), F.count(F.lit(1)).alias("regular"))
    share = lambda n: F.round(100.0 * F.coalesce(F.col("matches"), F.lit(0)) / F.greatest(F.col(n), F.lit(1)), 6)
    return counted.select(F.col("d").cast("long").alias("d"), F.coalesce("matches", F.lit(0)).alias("matches"), "pairs", "regular", share("regular").alias("acc"), share("pairs").alias("acc_per_pair"))


def step_statistics(chunk_rows: DataFrame, draft: int, loss_by: str = "chunk") -> DataFrame:
    """chunk_rows: (rank, batch, row, loss, scale, valid, tokens, correct array). A row (d, loss, acc, chunks, batches,
    batches_for_acc) for each d.

    Sums by batch and row, accuracies averaged over a batch's rows, then over batches without weights: partial and
    final aggregation, whatever rank the rows come from. Every batch counts for the loss; only those with a valid chunk
    count for accuracies.
    """
    own = lambda c: F.sum(F.when(F.col("valid"), c))
    rows = chunk_rows.groupBy("rank", "batch", "row").agg(own(F.col("loss") * F.col("scale")).alias("ce"), own(F.col("tokens")).alias("tokens"), F.count_if("valid").alias("chunks"), *[own(F.col("correct")[d]).alias(f"c{d}") for d in range(draft)])
    percent = lambda d: F.avg(F.col(f"c{d}") / (F.col("tokens") + 1e-8) * 100)
    batches = rows.groupBy("rank", "batch").agg(F.sum("ce").alias("ce"), F.sum("chunks").alias("chunks"), *[percent(d).alias(f"a{d}") for d in range(draft)])
    final = batches.agg(F.coalesce(F.sum("ce"), F.lit(0.0)).alias("ce"), F.sum("chunks").alias("chunks"), F.count(F.lit(1)).alias("batches"), F.count_if(F.col("chunks") > 0).alias("batches_for_acc"), *[F.avg(f"a{d}").alias(f"a{d}") for d in range(draft)])
    by = {"chunk": F.greatest(F.lit(1), F.col("chunks")), "batch": F.greatest(F.lit(1), F.col("batches")), "none": F.lit(1)}[loss_by]
    return final.select((F.col("ce") / by).alias("loss"), "chunks", "batches", "batches_for_acc", F.posexplode(F.array(*[F.col(f"a{d}") for d in range(draft)])).alias("d", "acc"))


def mean_vector(rows: DataFrame, vector: str) -> DataFrame:
    """(dim, mean) of each coordinate."""
    return rows.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"))


def warmed_rate(step: Column, rate: float, warm_up: int) -> Column:
    """Linear from a hundredth of the rate to all of it."""
    return F.lit(rate) * (0.01 + 0.99 * F.least(step, F.lit(warm_up)) / float(max(1, warm_up)))


def metrics_line(step: Column, rate: Column, loss: Column, accuracies: Column, chunks: Column) -> Column:
    """One line for the console; accuracies: array of (place, percent), put in the order of places."""
    listed = F.transform(F.array_sort(accuracies), lambda a: F.concat(F.format_string("%.2f", a["percent"]), F.lit("%")))
    return F.concat_ws(
        " | ", F.concat(F.lit("Step "), step.cast("string")), F.concat(F.lit("LR: "), F.format_string("%.1e", rate)), F.concat(F.lit("Loss: "), F.format_string("%.4f", loss)),
        F.when(F.size(listed) > 0, F.concat(F.lit("Acc: "), F.array_join(listed, ", "))), F.concat(F.lit("Num. Processed Chunks: "), chunks.cast("long").cast("string")),
    )
