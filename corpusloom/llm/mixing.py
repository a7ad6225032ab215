"""Mix sources to target weights with hash-threshold histograms; DataFrame functions only.

Each source is given a budget of words. Full passes over the source come first; what is left is taken from the
documents whose hash lies below the source's threshold. The threshold is found by nesting: words are summed by source
and leading hash bits, the bucket in which the budget runs out is kept, and only its documents are summed again by
the next bits, down to single hash values. No sort of documents, no collection: a filter by hash follows.

Defined results: a null text has no words; documents without a source are one source, named last; equal doc_id (null
counts as one) hash alike and are taken together; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, materialise, maybe_broadcast

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
#: The hash has LEVELS * LEVEL_BITS = 60 bits.
LEVELS, LEVEL_BITS = 4, 15


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(key: Column) -> Column:
    """60 bits of the MD5 of a key as text; null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """sizes: (source, source_size), a row per source. Adds weight and target: share of all words, dealt by weight.

    No target exceeds ``most`` times its source; the excess goes to the others by weight. In the order of limit by
    weight the limited sources are a prefix, so that running sums find the level without iteration. One row per
    source goes through this window, whatever the number of documents.
    """
    named = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    filled = Window.orderBy("need", "place")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    onward = filled.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    dealt = (
        named.withColumn("weight", weight.cast("double"))
        .withColumn("most", F.lit(float(most)) * F.col("source_size"))
        .withColumn("need", F.col("most") / F.col("weight"))
        .withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("limited", F.col("need") <= F.col("level"))
        .withColumn("final", F.min(F.when(~F.col("limited"), F.struct("need", "place", "level"))).over(everything)["level"])
    )
    return dealt.select("source", "source_size", "weight", F.when(F.col("limited"), F.col("most")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows: (source, hash, size); plan: (source, rest). Adds up_to: hashes up to it sum to the rest, to within half
    of the documents of one hash value; -1 if none is taken."""
    state = plan.select("source", "rest", F.lit(0).cast("long").alias("before"))
    for level in range(LEVELS):
        bucket = F.shiftright("hash", LEVEL_BITS * (LEVELS - 1 - level))
        sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("at").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        left = state.select(F.col("source").alias("at"), "rest", "before")
        last = (
            sums.join(maybe_broadcast(left), F.col("source").eqNullSafe(F.col("at")))
            .withColumn("upto", F.col("before") + F.sum("words").over(run))
            .filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
            .select("source", "rest", (F.col("upto") - F.col("words")).alias("before"), "bucket", "words")
        )
        state = materialise(last, "boundary")
        if level < LEVELS - 1:
            here = state.select(F.col("source").alias("at"), F.col("bucket").alias("in"))
            rows = rows.join(maybe_broadcast(here), F.col("source").eqNullSafe(F.col("at")) & (bucket == F.col("in"))).select("source", "hash", "size")
            rows = materialise(rows, "boundary_rows")
    fits = F.col("before") + F.col("words") / 2 <= F.col("rest")
    return state.select("source", F.when(fits, F.col("bucket")).otherwise(F.col("bucket") - 1).alias("up_to"))


def mix(docs: DataFrame) -> DataFrame:
    """Every row as (doc_id, source, size, source_size, target, copies, taken)."""
    narrow = materialise(docs.select("doc_id", "source", hash60(F.col("doc_id")).alias("hash"), words_in(F.col("text")).alias("size")), "sizes")
    plan = materialise(plan_of(narrow), "plan")
    named = plan.select(F.col("source").alias("at"), "source_size", "target", "passes", "up_to")
    copies = F.col("passes") + F.when(F.col("hash") <= F.col("up_to"), 1).otherwise(0)
    return (
        narrow.join(maybe_broadcast(named), F.col("source").eqNullSafe(F.col("at")))
        .select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))
    )


def plan_of(narrow: DataFrame) -> DataFrame:
    """(source, source_size, target, passes, up_to) from (source, hash, size)."""
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = materialise(targets(sizes).withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "targets")
    found = thresholds(narrow.select("source", "hash", "size"), plan).withColumnRenamed("source", "at")
    return plan.join(found, F.col("source").eqNullSafe(F.col("at")), "left").select("source", "source_size", "target", "passes", F.coalesce("up_to", F.lit(-1)).alias("up_to"))


def repeat_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them; the columns stay. Texts are not shuffled."""
    narrow = materialise(docs.select("source", hash60(F.col("doc_id")).alias("hash"), words_in(F.col("text")).alias("size")), "sizes")
    plan = materialise(plan_of(narrow).select(F.struct("source", "passes", "up_to").alias("plan")), "plan")
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = row.join(maybe_broadcast(plan), F.col("row.source").eqNullSafe(F.col("plan.source")))
    copies = F.col("plan.passes") + F.when(hash60(F.col("row.doc_id")) <= F.col("plan.up_to"), 1).otherwise(0)
    return joined.select("row", F.explode(F.array_repeat(F.lit(True), copies.cast("int"))).alias("copy")).select("row.*")


ORACLE_SQL = """
WITH n AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM n GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM s),
v AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][place % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS most FROM w),
k AS (SELECT *, most / weight AS need FROM v),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY need, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY need, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM k),
t AS (
  SELECT source, source_size, CASE WHEN need <= level THEN most
         ELSE weight * (SELECT arg_min(level, (need, place)) FROM l WHERE need > level) END AS target
  FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS words FROM n GROUP BY source, h),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h)::BIGINT - words AS before FROM g)
SELECT n.doc_id, n.size, p.source_size, p.target,
       (n.size * (p.passes + CASE WHEN c.before + c.words / 2 <= p.target - p.passes * p.source_size AND p.target > p.passes * p.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source JOIN c ON n.source IS NOT DISTINCT FROM c.source AND n.h = c.h
"""
