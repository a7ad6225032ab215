"""Token sequences with mask tokens, their chunks, and what each position sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators.batches import row_size

MASK_ID, PAD_ID = -2, 0
ARRAYS = ("input_ids", "position_ids", "gate_mask", "regular_token_mask")
PADS = dict(zip(ARRAYS, (PAD_ID, 0, -1, 0), strict=True))


def _range(n: Column) -> Column:
    """0 to n - 1, empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))


def expand(pairs: DataFrame, draft: int, mask: int = MASK_ID) -> DataFrame:
    """pairs: (keys..., in_ids, out_ids). Adds the four arrays and total_len, drops the ids.

    Each output token is followed by ``draft`` masks. Output j, slot k has position prompt + j + k; a mask's gate is
    one if the token that it is to foretell is there: j + k + 1 < outputs. In closed form, so no labels are made.
    """
    n_in, n_out = F.size("in_ids").cast("long"), F.size("out_ids").cast("long")
    slots = F.array(*[F.lit(k).cast("long") for k in range(draft + 1)])
    block = lambda f: F.flatten(F.transform(_range(n_out), lambda j: F.transform(slots, lambda k: f(j, k))))
    fill = lambda v: F.transform("in_ids", lambda _: F.lit(v).cast("long"))
    masks = F.array(*[F.lit(mask).cast("long")] * draft) if draft else F.array().cast("array<bigint>")
    out = {
        "input_ids": F.concat("in_ids", F.flatten(F.transform("out_ids", lambda t: F.concat(F.array(t), masks)))),
        "position_ids": F.concat(_range(n_in), block(lambda j, k: n_in + j + k)),
        "gate_mask": F.concat(fill(0), block(lambda j, k: ((k >= 1) & (j + k + 1 < n_out)).cast("long"))),
        "regular_token_mask": F.concat(fill(1), block(lambda j, k: (k == 0).cast("long"))),
        "total_len": n_in + n_out * (draft + 1),
    }
    keys = [c for c in pairs.columns if c not in ("in_ids", "out_ids")]
    return pairs.select(*keys, *[c.alias(k) for k, c in out.items()])


def expanded_bytes(pairs: DataFrame, draft: int) -> Column:
    """Estimated bytes of a pair once it is expanded, as ``row_size`` has them, without making the arrays."""
    n_in, n_out = F.size("in_ids").cast("long"), F.size("out_ids").cast("long")
    # Of a pair that lacks its output, all arrays but the ids are those of its input; one that lacks its input has none.
    whole = F.when(n_in.isNull(), 0).when(n_out.isNull(), 24 * n_in).otherwise(8 * len(ARRAYS) * (n_in + n_out * (draft + 1)) + 8)
    return (row_size(pairs, [c for c in pairs.columns if c not in ("in_ids", "out_ids")]) + whole).cast("long")


def shifted_labels(ids: Column) -> Column:
    """The next token of each position, null at the end."""
    return F.transform(ids, lambda _, i: F.get(ids, i + 1))


def positions(rows: DataFrame, *keys: str) -> DataFrame:
    """The arrays of each row as rows (keys, pos, input_id, position_id, gate, regular)."""
    return rows.select(*keys, F.posexplode(F.arrays_zip(*ARRAYS)).alias("pos", "x")).select(
        *keys, F.col("pos").cast("long").alias("pos"), F.col("x.input_ids").alias("input_id"), F.col("x.position_ids").alias("position_id"), F.col("x.gate_mask").alias("gate"), F.col("x.regular_token_mask").alias("regular")
    )


def prompt_length(gate: Column) -> Column:
    """Tokens before the first block with a gate; all of them without one."""
    return F.coalesce(F.nullif(F.array_position(gate, 1), F.lit(0)) - 2, F.size(gate)).cast("long")


def buckets(chunk: int, step: int) -> list[int]:
    """step, 2 * step and so on up to chunk, and chunk."""
    return sorted({*range(step, chunk + 1, step), chunk})


def chunk_bounds(rows: DataFrame, keys: list[str], draft: int, chunk: int, least: int, sizes: list[int]) -> DataFrame:
    """(keys, chunk_idx, start, end, target_len) of each row's chunks, from prompt_len and total_len.

    The first chunk is the prompt and as many whole blocks as fit; the others are whole blocks. Blocks are never cut.
    """
    block = draft + 1
    if not 0 < least <= chunk or chunk < block:
        raise ValueError("a chunk must hold a block and the least length")
    p, length = F.col("prompt_len"), F.col("total_len")
    first = p + F.greatest(F.lit(0), F.floor((F.lit(chunk) - p) / block)) * block
    step = chunk // block * block
    more = F.greatest(F.lit(0), F.ceil((length - F.col("first")) / F.lit(float(step)))).cast("int")
    n = rows.select(*keys, "total_len", first.cast("long").alias("first")).select("*", F.explode(F.sequence(F.lit(0), more)).alias("n"))
    end = F.least("total_len", F.col("first") + F.col("n") * step)
    start = F.when(F.col("n") == 0, 0).otherwise(F.col("first") + (F.col("n") - 1) * step)
    cut = n.select(*keys, F.col("n").cast("long").alias("chunk_idx"), start.cast("long").alias("start"), end.cast("long").alias("end"), (end >= F.col("total_len")).alias("last"))
    need = F.greatest(F.col("end") - F.col("start"), F.lit(least))
    return cut.select(*keys, "chunk_idx", "start", "end", F.when(F.col("last"), V.bucket_for(need, sizes)).otherwise(chunk).cast("long").alias("target_len"))


def chunks(rows: DataFrame, keys: list[str], draft: int, chunk: int, least: int, sizes: list[int]) -> DataFrame:
    """Chunks with their slices of the arrays, padded to target_len, and past, the regular tokens of the row before them.
    One pass, no join and no sort: rows are exploded in place."""
    kept = F.struct(*ARRAYS).alias("arrays")
    regular = V.places_of(F.col("regular_token_mask")).alias("regular")
    cut = chunk_bounds(rows.select(*keys, kept, regular, prompt_length(F.col("gate_mask")).alias("prompt_len"), "total_len"), [*keys, "arrays", "regular"], draft, chunk, least, sizes)
    part = lambda a: V.padded(F.slice(F.col(f"arrays.{a}"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), F.col("target_len"), PADS[a])
    past = F.size(F.filter("regular", lambda i: i < F.col("start"))).cast("long").alias("past")
    return cut.select(*keys, "chunk_idx", "start", "end", "target_len", *[part(a).alias(a) for a in ARRAYS], past)


def is_valid(gate: Column) -> Column:
    """Whether any gate is open; pads count as closed."""
    return F.exists(gate, lambda g: F.greatest(g, F.lit(0)) > 0)


def gated_regulars(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk_idx, n): regular tokens of each chunk from its first gated block on, none without a gate."""
    first = F.array_position("gate_mask", 1)
    rest = F.slice("regular_token_mask", F.greatest(F.lit(1), first - 1).cast("int"), F.size("regular_token_mask"))
    return parts.select(*keys, "chunk_idx", F.when(first > 0, V.total(V.doubles(rest))).otherwise(0).cast("long").alias("n"))


def require_no_mask(rows: DataFrame, columns: list[str], mask: int = MASK_ID) -> DataFrame:
    """rows, if none of the columns' ids is the mask's; a vocabulary that has it would open gates in plain text."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.array_contains(F.col(c), F.lit(mask).cast("long"))
    if rows.filter(F.coalesce(hit, F.lit(False))).limit(1).count():
        raise ValueError(f"{mask} is the mask's id, but texts have it")
    return rows


def past_seen(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds n_regular and past: regular tokens of the chunk, and of all before it. Chunks that have their past keep it."""
    counted = parts.withColumn("n_regular", V.total(V.doubles(F.col("regular_token_mask"))).cast("long"))
    if "past" in parts.columns:
        return counted
    before = Window.partitionBy(*keys).orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("past", F.coalesce(F.sum("n_regular").over(before), F.lit(0)))


def seen_state(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk_idx, kept): the tokens that a chunk hands on to the next ones, in order."""
    return parts.select(*keys, "chunk_idx", V.taken(F.col("input_ids"), V.places_of(F.col("regular_token_mask"))).alias("kept"))


def position_gaps(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Regular tokens whose position isn't the number of those before them; empty for well-formed rows."""
    found = past_seen(parts, keys).withColumn("places", V.places_of(F.col("regular_token_mask")))
    each = found.select(*keys, "chunk_idx", "past", "position_ids", F.posexplode("places").alias("nth", "pos"))
    return each.select(*keys, "chunk_idx", "pos", (F.col("past") + F.col("nth")).alias("expected"), F.get("position_ids", F.col("pos").cast("int")).alias("position_id")).filter(F.col("expected") != F.col("position_id"))


def _spread(places: Column, length: Column, value) -> Column:
    """An array of ``length``: 0 before the first place, and from place x, the i-th of them, to the next one value(x, i)."""
    upto = lambda i: F.coalesce(F.get(places, i + 1), length)
    first = F.array_repeat(F.lit(0).cast("long"), F.coalesce(F.get(places, F.lit(0)), length).cast("int"))
    return F.concat(first, F.flatten(F.transform(places, lambda x, i: F.array_repeat(value(x, i), (upto(i) - x).cast("int")))))


def block_arrays(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk_idx, past, plain, masked, each): a row for a chunk, worked out inside of it. plain and masked are the places
    of gates 0 and 1; each has for every position its gate, how many of either kind there are up to here, and before, how many
    masked ones up to the last plain one."""
    at = lambda gate, v: F.filter(F.transform(gate, lambda g, i: F.when(g == v, i.cast("long"))), lambda i: i.isNotNull())
    # Inside a lambda an array is worked out for every element, unless it is let stand.
    placed = V.let(F.col("gate_mask"), lambda g: F.struct(g.alias("gate"), F.size(g).cast("long").alias("length"), at(g, 0).alias("plain"), at(g, 1).alias("masked")))
    count = lambda x, i: (i + 1).cast("long")
    counted = V.let(placed, lambda s: F.struct(s["gate"].alias("gate"), s["length"].alias("length"), s["plain"].alias("plain"), s["masked"].alias("masked"), _spread(s["plain"], s["length"], count).alias("n_plain"), _spread(s["masked"], s["length"], count).alias("n_masked")))

    def whole(s: Column) -> Column:
        before = _spread(s["plain"], s["length"], lambda x, i: F.get(s["n_masked"], x.cast("int")))
        each = F.arrays_zip(s["gate"].alias("gate"), s["n_plain"].alias("n_plain"), s["n_masked"].alias("n_masked"), before.alias("before"))
        return F.struct(s["plain"].alias("plain"), s["masked"].alias("masked"), each.alias("each"))

    return past_seen(parts, keys).select(*keys, "chunk_idx", "past", V.let(counted, whole).alias("s")).select(*keys, "chunk_idx", "past", "s.plain", "s.masked", "s.each")


def blocks(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk_idx, pos, gate, past, block_id, nth): the block counts positions with gate 0 up to here, past ones too;
    nth counts those of gate 1 in the block up to here. Chunks are exploded in place: no row is sorted."""
    rows = block_arrays(parts, keys).select(*keys, "chunk_idx", "past", F.posexplode("each").alias("pos", "x"))
    return rows.select(*keys, "chunk_idx", F.col("pos").cast("long").alias("pos"), F.col("x.gate").alias("gate"), "past", (F.col("past") + F.col("x.n_plain")).alias("block_id"), (F.col("x.n_masked") - F.col("x.before")).alias("nth"))


def visible_counts(block_rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk_idx, pos, n_visible): how many keys each query sees, from blocks, without pairs."""
    own = F.when(F.col("gate") == 1, F.col("nth")).otherwise(0)
    return block_rows.withColumn("n_visible", F.when(F.col("gate") < 0, 0).otherwise(F.col("block_id") + own)).select(*keys, "chunk_idx", "pos", "n_visible")


def chunk_pairs(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk_idx, q, k): the visible pairs of each chunk, from its own arrays: no join and no sort. A query sees the plain
    places up to its own, and a masked one those masked ones, too, that its block has up to here."""
    each = block_arrays(parts, keys).select(*keys, "chunk_idx", "plain", "masked", F.posexplode("each").alias("q", "x"))
    x = lambda c: F.col(f"x.{c}").cast("int")
    plain = F.slice("plain", F.lit(1), x("n_plain"))
    own = F.when(F.col("x.gate") == 1, F.slice("masked", x("before") + 1, x("n_masked") - x("before"))).otherwise(F.array().cast("array<bigint>"))
    return each.filter("x.gate >= 0").select(*keys, "chunk_idx", F.col("q").cast("long").alias("q"), F.explode(F.concat(plain, own)).alias("k"))


def visibility_rules(q: str, k: str) -> dict[str, Column]:
    """The single rules over a query and a key of a chunk."""
    at = lambda side, c: F.col(f"{side}.{c}")
    return {
        "causal": at(k, "pos") <= at(q, "pos"),
        "query_not_pad": at(q, "gate") >= 0,
        "key_not_pad": at(k, "gate") >= 0,
        "query_plain": at(q, "gate") == 0,
        "query_masked": at(q, "gate") == 1,
        "key_plain": at(k, "gate") == 0,
        "key_masked": at(k, "gate") == 1,
        "same_block": at(q, "block_id") == at(k, "block_id"),
    }


def visible_pairs(block_rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk_idx, q, k): visible pairs inside a chunk, from the rules: a join of rows of positions, against which
    chunk_pairs is tested. Quadratic in the chunk's length, which is bounded."""
    on = [F.col(f"q.{c}") == F.col(f"k.{c}") for c in (*keys, "chunk_idx")]
    r = visibility_rules("q", "k")
    plain = r["query_plain"] & r["key_plain"]
    masked = r["query_masked"] & (r["key_plain"] | r["key_masked"] & r["same_block"])
    seen = r["causal"] & r["query_not_pad"] & r["key_not_pad"] & (plain | masked)
    return block_rows.alias("q").join(block_rows.alias("k"), [*on, seen]).select(*[F.col(f"q.{c}").alias(c) for c in (*keys, "chunk_idx")], F.col("q.pos").alias("q"), F.col("k.pos").alias("k"))


def visibility_runs(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk_idx, past, run, gate, first, last, plain): positions of a chunk with one gate in a row, a row each, and how
    many plain positions there are before it. Rows grow with the blocks and not with the tokens."""
    gate = F.col("gate_mask")
    begins = F.filter(_range(F.size(gate).cast("long")), lambda i: (i == 0) | (F.get(gate, i.cast("int")) != F.get(gate, (i - 1).cast("int"))))
    cut = past_seen(parts, keys).select(*keys, "chunk_idx", "past", begins.alias("begins"), gate.alias("gates"))
    ends = lambda i: F.coalesce(F.get("begins", i + 1), F.size("gates").cast("long")) - 1
    runs = F.transform("begins", lambda x, i: F.struct(F.get("gates", x.cast("int")).alias("gate"), x.alias("first"), ends(i).alias("last")))
    each = cut.select(*keys, "chunk_idx", "past", F.posexplode(runs).alias("run", "r")).select(*keys, "chunk_idx", "past", "run", "r.gate", "r.first", "r.last")
    before = Window.partitionBy(*keys, "chunk_idx").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    plain = F.sum(F.when(F.col("gate") == 0, F.col("last") - F.col("first") + 1).otherwise(0)).over(before)
    return each.withColumn("plain", F.coalesce(plain, F.lit(0).cast("long")))


def run_counts(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk_idx, first, last, at_first, pairs): keys that the first query of a run sees, each next one seeing one
    more, and what all of the run see together; pads see none. In closed form, without a row for a token."""
    n = F.col("last") - F.col("first") + 1
    seen = F.when(F.col("gate") < 0, 0).otherwise(F.col("past") + F.col("plain") + 1)
    total = F.when(F.col("gate") < 0, 0).otherwise(n * seen + F.floor(n * (n - 1) / 2))
    return runs.select(*keys, "chunk_idx", "run", "gate", "first", "last", seen.cast("long").alias("at_first"), total.cast("long").alias("pairs"))


def intersected(a: Column, b: Column) -> Column:
    """What both of two sorted arrays of ranges (first, last) hold, as ranges."""
    both = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.greatest(x["first"], y["first"]).alias("first"), F.least(x["last"], y["last"]).alias("last")))))
    return F.filter(both, lambda z: z["first"] <= z["last"])


def key_ranges(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk_idx, first, last, ranges): for each run of queries the ranges of keys in the chunk that its last query
    sees: those of the rules, intersected. Earlier queries of the run see them up to their own place.

    Plain keys are one set of ranges for a chunk; a masked query adds its own run, for a block's masks are in a row.
    """
    chunk = [*keys, "chunk_idx"]
    span = F.struct("first", "last")
    plain = runs.groupBy(*chunk).agg(F.array_sort(F.collect_list(F.when(F.col("gate") == 0, span))).alias("plain_keys"))
    causal = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("last")))
    own = F.when(F.col("gate") == 1, F.array(span)).otherwise(F.array().cast("array<struct<first:bigint,last:bigint>>"))
    seen = F.array_sort(F.concat(intersected(F.col("plain_keys"), causal), intersected(own, causal)))
    return runs.filter("gate >= 0").join(plain, chunk).select(*chunk, "first", "last", seen.alias("ranges"))


def expanded_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk_idx, q, k): the visible pairs inside a chunk that key ranges stand for."""
    q = ranges.select(*keys, "chunk_idx", "ranges", F.explode(F.sequence("first", "last")).alias("q"))
    k = q.select(*keys, "chunk_idx", "q", F.explode(intersected(F.col("ranges"), F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("q").alias("last"))))).alias("r"))
    return k.select(*keys, "chunk_idx", "q", F.explode(F.sequence("r.first", "r.last")).alias("k"))
