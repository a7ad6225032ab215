"""Quality rules with risk-controlled thresholds; DataFrame functions only.

Base rule: at least ten words, and at most a fifth of them in five-word windows that the text repeats.

Beyond it, RULES measure shares of a text, and a document is rejected if any of them reaches the cutoff of its stratum
(language), so that the largest share decides. A cutoff is admitted if the exact (Clopper-Pearson) upper confidence
bound of the share of good documents that it rejects, by any rule, is at most ALPHA. Cutoffs are tested in a fixed
order from the loosest on, and testing stops at the first that fails, so a stratum spends its error once; the error
DELTA is divided by the strata tested (Bonferroni). With probability 1 - DELTA all rules together reject at most ALPHA
of the good documents of every stratum. Cutoffs are fixed values that no label has shaped, so all labelled documents
serve as the holdout. Repeated words have no rule of their own beyond the base rule.

A stratum with fewer good documents than could admit any cutoff has none, and isn't tested; a null language is a
stratum too. Without labels only the base rule rejects.

Defined results: a null text has no words and fails the base rule; a doc_id with several labels counts as good only
if all of them say so; labels with nulls are ignored; repeated documents count each time; empty tables give empty
results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, maybe_broadcast

SEPARATORS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
ALPHA = 0.01
DELTA = 0.05
#: Good documents of a stratum below which not even a cutoff that rejects none of them could be admitted.
LEAST_GOOD = math.log(DELTA) / math.log1p(-ALPHA)
#: Rules reject a share of at least the cutoff. Fixed values, from loose to strict.
CUTOFFS = (3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05)
RULES = ("symbols", "repeated_lines", "shouts")


def measured(docs: DataFrame) -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, shouts): row is a struct of all of docs' columns.

    Write the result before filtering on it: a filter that moved below these steps would work them out again for
    every element.
    """
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("t"))
    d = d.select(
        "row",
        F.length(F.translate("t", SEPARATORS, "")).alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
        (F.length("t") - F.length(F.translate("t", "!", ""))).alias("shouts"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.transform(F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda x: x != ""), lambda x: F.xxhash64(x)).alias("h"),
    )
    d = d.select(
        "row", "word_chars", "n_symbols", "shouts",
        F.size("h").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")).alias("g"),
    )
    # Most texts repeat no window: they skip the sort.
    sorted_windows = F.when(F.size(F.array_distinct("g")) < F.size("g"), F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    d = d.select("row", "word_chars", "n_symbols", "shouts", "n_words", "n_dup_lines", sorted_windows.alias("s"))
    equal = lambda e, k: F.get("s", k)["h"].eqNullSafe(e["h"])
    twice = F.transform("s", lambda e, k: F.when(equal(e, k - 1) | equal(e, k + 1), e["i"]))
    d = d.select("row", "word_chars", "n_symbols", "shouts", "n_words", "n_dup_lines", F.array_sort(F.filter(twice, lambda x: x.isNotNull())).alias("p"))
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    whole = lambda c: F.col(c).cast("long").alias(c)
    return d.select("row", whole("n_words"), whole("word_chars"), whole("n_symbols"), whole("n_dup_lines"), covered.cast("long").alias("n_repeat_words"), whole("shouts"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def worst() -> Column:
    """The largest share of all rules; null (no words) reaches no cutoff."""
    return F.when(F.col("n_words") > 0, F.greatest("n_symbols", "n_dup_lines", "shouts") / F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, carried back by the recurrence."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    back = x
    for k in range(1, 8):
        back = back * (x + float(k))
    return series - F.log(back)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), where k < n * p; 1 elsewhere, which no test admits.

    The terms fall from k downwards and are summed over forty standard deviations and more.
    """
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(_log_gamma(n + 1.0) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0) + k * math.log(p) + (n - k) * math.log1p(-p))
    terms = F.least(k, 40 * F.sqrt(k) + 200).cast("int")
    odds = (1 - p) / p
    step = lambda a, j: F.struct((a["term"] * (k - j + 1) / (n - k + j) * odds).alias("term"), (a["sum"] + a["term"] * (k - j + 1) / (n - k + j) * odds).alias("sum"))
    rest = F.aggregate(F.sequence(F.lit(1), terms), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), step, lambda a: a["sum"])
    return F.when(k < n * p, F.least(F.lit(1.0), first * F.when(terms >= 1, rest).otherwise(F.lit(1.0)))).otherwise(F.lit(1.0))


def cutoffs(holdout: DataFrame) -> DataFrame:
    """holdout: (lang, worst) of good documents. (lang, cutoff) of the strata with an admitted cutoff.

    Documents are counted by stratum and the first cutoff that rejects them; only these counts go on.
    """
    first = F.coalesce(F.array_position(F.transform(F.array(*map(F.lit, CUTOFFS)), lambda c: F.col("worst") >= c), True), F.lit(0))
    counted = holdout.groupBy("lang", first.alias("level")).count()
    strata = counted.groupBy("lang").agg(F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("level", "count"))).alias("by"))
    strata = materialise(strata.filter(F.col("n") >= LEAST_GOOD), "strata")
    levels = strata.select("lang", "n", F.posexplode(F.array(*map(F.lit, CUTOFFS))).alias("at", "cutoff"), "by")
    run = Window.partitionBy("lang").orderBy("at")
    tested = levels.withColumn("k", F.sum(F.coalesce(F.try_element_at("by", (F.col("at") + 1).cast("long")), F.lit(0))).over(run))
    admitted = binomial_tail(F.col("k"), F.col("n"), ALPHA) <= F.lit(DELTA / max(1, strata.count()))
    return tested.withColumn("passed", F.min(admitted.cast("int")).over(run)).filter("passed = 1").groupBy("lang").agg(F.min("cutoff").alias("cutoff"))


def thresholds(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(at, cutoff) by language, broadcast if they are few. docs: (doc_id, lang, the five counts, shouts)."""
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    held = docs.filter(~base_failed()).join(good, "doc_id").select("lang", worst().alias("worst"))
    return maybe_broadcast(materialise(cutoffs(held).select(F.col("lang").alias("at"), "cutoff"), "cutoffs"))


def passes() -> Column:
    """Whether a row beside its stratum's cutoff is kept."""
    return ~base_failed() & ~F.coalesce(worst() >= F.col("cutoff"), F.lit(False))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of docs as (doc_id, n_words, the four counts, base_failed, kept)."""
    flat = materialise(measured(docs.select("doc_id", "lang", "text")).select("row.doc_id", "row.lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "shouts"), "measured")
    named = flat.join(thresholds(flat, labels), F.col("lang").eqNullSafe(F.col("at")), "left")
    return named.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), passes().alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, all columns as they were.

    Rows and counts are written once; thresholds read the counts only, the filter reads both.
    """
    wide = materialise(measured(docs), "measured")
    counts = wide.select("row.doc_id", "row.lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "shouts")
    named = wide.join(thresholds(counts, labels), F.col("row.lang").eqNullSafe(F.col("at")), "left")
    return named.filter(passes()).select("row.*")


ORACLE_SQL = r"""
WITH f AS (
  SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
words AS (SELECT id, unnest(w) AS x, unnest(range(len(w))) AS i FROM f),
runs AS (SELECT id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS run FROM words WINDOW o AS (PARTITION BY id ORDER BY i)),
twice AS (SELECT id, i, count(*) OVER (PARTITION BY id, run) AS c FROM runs WHERE run IS NOT NULL),
spread AS (SELECT id, i, lead(i) OVER (PARTITION BY id ORDER BY i) AS next FROM twice WHERE c > 1),
covered AS (SELECT id, sum(least(5, coalesce(next - i, 5)))::BIGINT AS n FROM spread GROUP BY id),
m AS (
  SELECT f.id, doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, (length(t) - length(replace(t, '!', '')))::BIGINT AS shouts
  FROM f LEFT JOIN covered USING (id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
w AS (SELECT *, CASE WHEN n_words > 0 THEN greatest(n_symbols, n_dup_lines, shouts) / n_words END AS worst FROM b),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT lang, worst FROM w JOIN good USING (doc_id) WHERE NOT base_failed),
strata AS (SELECT lang, count(*) AS n FROM held GROUP BY lang HAVING count(*) >= ln(0.05) / ln(0.99)),
cuts AS (SELECT unnest([3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05]::DOUBLE[]) AS cutoff),
counted AS (SELECT s.lang, n, cutoff, count(*) FILTER (worst >= cutoff) AS k FROM held h JOIN strata s ON h.lang IS NOT DISTINCT FROM s.lang, cuts GROUP BY ALL),
tail AS (
  SELECT *, CASE WHEN k < n * 0.01 THEN list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) ELSE 1 END AS p
  FROM counted),
passed AS (SELECT *, min((p <= 0.05 / (SELECT count(*) FROM strata))::INT) OVER (PARTITION BY lang ORDER BY cutoff DESC) AS ok FROM tail),
chosen AS (SELECT lang, min(cutoff) AS cutoff FROM passed WHERE ok = 1 GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(worst >= cutoff, false) AS kept
FROM w LEFT JOIN chosen c ON w.lang IS NOT DISTINCT FROM c.lang
"""
