"""The library's queries over the test tables, each with the SQL that gives the same rows.

Parameters are small so that small tables reach every branch; the operators take any.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.functions.vocabulary import Vocabulary
from corpusloom.operators import batches, metrics, prompts, sequences
from corpusloom.plans import build
from corpusloom.sources import readers, writers
from corpusloom.storage import fresh_dir
from corpusloom.streaming import streams

S = build.Settings()
MIX = {"none": 0.2, "stdin": 0.3, "solve": 0.5}
SYSTEM = "You are a helpful assistant."
BATCH = S.per_device * S.ranks
#: Languages stand in for files, in this order, each with a quota.
QUOTAS = {"de": 20, "en": 60, "es": 15, "fr": 25}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Prompts.

_FIRST = "first_prompt AS (SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations WHERE role IN ('user', 'human') AND regexp_matches(text, '\\S') GROUP BY conv_id)"
_NORM = r"regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
_MATH = r"'(?i)^\s*Return your final response within\s*\\{1,2}boxed\{\}\.\s*'"
_CODE = r"'(?is)^\s*Generate an executable Python function.*?(?:stdin.*?print the output.*?(?:Simply call.*?definition\.)|Return the function body.*?final solution\.)\s*'"
_STDIN = "'Read from standard input and write to standard output. Do not print extra text.' || chr(10) || chr(10)"
_SOLVE = "'Implement a Python function solve() that reads from sys.stdin and prints to sys.stdout. Call solve() after its definition.' || chr(10) || chr(10)"
_U = "(('0x' || substr(md5('42-' || {0}), 1, 8))::BIGINT / 4294967296.0)"
_STYLE = "CASE WHEN {0} <= 0.2 THEN 'none' WHEN {0} <= 0.5 THEN 'stdin' WHEN {0} <= 1.0 THEN 'solve' ELSE 'none' END"
_DOMAIN = f"CASE WHEN starts_with(lower({{0}}), 'generate an executable python function') THEN 'code' WHEN regexp_matches({{0}}, {_MATH}) THEN 'math' ELSE 'other' END"
_LSTRIP = r"regexp_replace({0}, '^\s+', '')"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_REWRITE = (
    "CASE " + _DOMAIN + " WHEN 'code' THEN " + _STRIP.format(f"(CASE {{1}} WHEN 'stdin' THEN {_STDIN} WHEN 'solve' THEN {_SOLVE} ELSE '' END || " + _LSTRIP.format(f"regexp_replace({{0}}, {_CODE}, '')") + ")")
    + " WHEN 'math' THEN " + _LSTRIP.format(f"regexp_replace({{0}}, {_MATH}, '')") + " ELSE " + _STRIP + " END"
)


def _fill(template: str, *args: str) -> str:
    """format() for templates whose patterns have braces of their own."""
    for k, a in enumerate(args):
        template = template.replace(f"{{{k}}}", a)
    return template


@query(f"WITH {_FIRST} SELECT * FROM first_prompt")
def first_user_prompt(spark, d):
    return prompts.first_prompt(_table(spark, d, "conversations"))


@query("SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id")
def first_human_no_blank_check(spark, d):
    return prompts.first_prompt(_table(spark, d, "conversations"), ("user",), blanks=True)


_PROMPTS = f"""{_FIRST},
rewritten AS (SELECT conv_id, {_fill(_REWRITE, 'prompt', '(' + _STYLE.format(_U.format('conv_id')) + ')')} AS prompt, {_fill(_DOMAIN, 'prompt')} AS domain FROM first_prompt),
kept AS (SELECT * FROM rewritten WHERE prompt <> '' AND conv_id IN (SELECT min(conv_id) FROM rewritten WHERE prompt <> '' GROUP BY {_NORM.format('prompt')}))"""


@query(f"WITH {_PROMPTS} SELECT domain, count(*)::BIGINT AS n FROM kept GROUP BY domain")
def prompt_domain_counts(spark, d):
    return build.prompt_table(_table(spark, d, "conversations"), MIX).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PROMPTS} SELECT conv_id, prompt, domain FROM kept")
def prompt_table(spark, d):
    return build.prompt_table(_table(spark, d, "conversations"), MIX)


_LITERALS = [
    "Generate an executable Python function from the prompt, reading from stdin and print the output. Simply call the function after the definition. Add two numbers.",
    "  Return your final response within \\boxed{}. What is 2 + 2?",
    "Return your final response within \\\\boxed{}.  Solve x.",
    "generate an executable python function. Return the function body without invoking it at the final solution. Sort a list.",
    "Generate an executable Python function that nothing follows",
    "  plain\tprompt ",
    "return YOUR final response within \\boxed{}.",
]
_PREFIXES = "[" + ", ".join("'{}'".format(x.replace("'", "''")) for x in _LITERALS) + "]"


@query(f"WITH v AS (SELECT doc_id, {_PREFIXES}[(doc_id % {len(_LITERALS)} + 1)::INT] || ' ' || text AS text FROM documents) SELECT doc_id, {_fill(_DOMAIN, 'text')} AS domain, {_fill(_REWRITE, 'text', chr(39) + 'solve' + chr(39))} AS prompt FROM v")
def strip_inject_prefix(spark, d):
    """Documents as code, math and other prompts: each begins with one of the literals."""
    prefix = F.element_at(F.array(*[F.lit(x) for x in _LITERALS]), (F.col("doc_id") % len(_LITERALS) + 1).cast("int"))
    rows = _table(spark, d, "documents").select("doc_id", F.concat(prefix, F.lit(" "), F.col("text")).alias("text"))
    return rows.select("doc_id", T.domain(F.col("text")).alias("domain"), T.rewritten(F.col("text"), F.lit("solve")).alias("prompt"))


@query(f"SELECT doc_id, {_NORM.format('text')} AS text FROM documents")
def normalize_text(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.normalise(F.col("text")).alias("text"))


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_NORM.format('text')}")
def dedupe_keep_first(spark, d):
    rows = _table(spark, d, "documents").select("doc_id", prompts.text_key(F.col("text")).alias("key"))
    return prompts.keep_first(rows, F.col("key"), "doc_id").select("doc_id")


@query(f"SELECT source, count(*)::BIGINT AS n_rows, count(DISTINCT {_NORM.format('text')})::BIGINT AS n_kept, (count(*) - count(DISTINCT {_NORM.format('text')}))::BIGINT AS n_skipped FROM documents GROUP BY source")
def dedupe_report(spark, d):
    return prompts.dedupe_report(_table(spark, d, "documents"), prompts.text_key(F.col("text")), "source")


def _filed(spark, d):
    return _table(spark, d, "documents").select(F.col("lang").alias("file"), F.col("doc_id").alias("order"), prompts.text_key(F.col("text")).alias("key"))


def _quota_sql() -> str:
    parts = [f"keyed AS (SELECT lang AS file, doc_id, {_NORM.format('text')} AS key FROM documents)"]
    seen = []
    for f, k in QUOTAS.items():
        unseen = "".join(f" AND key NOT IN (SELECT key FROM part_{s})" for s in seen)
        parts.append(f"part_{f} AS (SELECT file, min(doc_id) AS doc_id, key FROM keyed WHERE file = '{f}'{unseen} GROUP BY file, key ORDER BY doc_id LIMIT {k})")
        seen.append(f)
    parts.append("chosen AS (" + " UNION ALL ".join(f"SELECT * FROM part_{f}" for f in QUOTAS) + ")")
    return "WITH " + ", ".join(parts)


@query(_quota_sql() + " SELECT file, doc_id FROM chosen")
def cross_file_dedupe_quota(spark, d):
    return prompts.sample_by_quota(_filed(spark, d), QUOTAS).select("file", F.col("order").alias("doc_id"))


@query(
    _quota_sql()
    + """, more AS (SELECT file, min(doc_id) AS doc_id FROM keyed WHERE file = 'en' AND key NOT IN (SELECT key FROM chosen) GROUP BY file, key ORDER BY doc_id LIMIT (SELECT greatest(0, 150 - count(*)) FROM chosen))
SELECT file, doc_id FROM chosen UNION ALL SELECT file, doc_id FROM more"""
)
def quota_topup(spark, d):
    rows = _filed(spark, d)
    return prompts.top_up(rows, prompts.sample_by_quota(rows, QUOTAS), "en", 150).select("file", F.col("order").alias("doc_id"))


@query("""WITH n AS (SELECT count(*) AS total FROM documents), w AS (SELECT * FROM (VALUES ('math', 0.536::DOUBLE, 0), ('code', 0.311, 1), ('science', 0.153, 2), ('chat', 0.0, 3), ('if', 0.0, 4)) v(bucket, weight, place)),
q AS (SELECT *, round_even(total * weight, 0)::BIGINT AS quota FROM w, n), short AS (SELECT any_value(total) - sum(quota) AS units FROM q)
SELECT bucket, (quota + CASE WHEN units > 0 THEN units // 5 + (place < units % 5)::INT WHEN units < 0 THEN -(place < -units)::INT ELSE 0 END)::INT AS quota FROM q, short""")
def bucket_quotas(spark, d):
    """The documents' number dealt to buckets; rounding leaves two units at most."""
    quota = prompts.bucket_quotas(_table(spark, d, "documents").count(), prompts.bucket_weights())
    return spark.createDataFrame(list(quota.items()), "bucket string, quota int")


@query("SELECT lang, count(*)::BIGINT AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY lang UNION ALL SELECT 'xx', 0, 0.0")
def bucket_percent(spark, d):
    out = prompts.shares(_table(spark, d, "documents"), "lang", ["de", "en", "es", "fr", "xx"])
    return out.select("lang", "n", F.round("percent", 6).alias("percent"))


@query("SELECT list_aggregate(list_sort(list(DISTINCT source)), 'string_agg', ',') AS sources, lang FROM documents GROUP BY lang")
def inverted_map(spark, d):
    own = _table(spark, d, "documents").groupBy("lang").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    return own.select("sources", "lang")


@query("SELECT doc_id FROM documents ORDER BY md5('42-' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark, d):
    return prompts.sample(_table(spark, d, "documents").select("doc_id"), 100, S.seed, "doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42-' || doc_id), doc_id)::BIGINT AS rn FROM documents")
def seeded_shuffle(spark, d):
    return batches.ranked(_table(spark, d, "documents").select("doc_id"), T.order_hash(F.col("doc_id"), S.seed)).select("doc_id", F.col("rn").cast("long").alias("rn"))


@query(f"SELECT DISTINCT conv_id, {_STYLE.format(_U.format('conv_id'))} AS style FROM conversations")
def weighted_style(spark, d):
    return _table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", T.choose(MIX, T.uniform(F.col("conv_id"), S.seed)).alias("style"))


@query("SELECT doc_id, text AS prompt FROM documents WHERE doc_id % 3 <> 2")
def schema_normalize(spark, d):
    part = lambda k: F.when(F.col("doc_id") % 3 == k, F.col("text"))
    records = _table(spark, d, "documents").select("doc_id", part(0).alias("prompt"), part(1).alias("input"))
    return readers.normalised_prompts(records).select("doc_id", "prompt")


@query(f"WITH {_FIRST} SELECT conv_id, '<|im_start|>system' || chr(10) || '{SYSTEM}<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS input FROM first_prompt")
def chat_template(spark, d):
    return first_user_prompt(spark, d).select("conv_id", T.chat(F.col("prompt"), SYSTEM).alias("input"))


@query("SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '\\S+')) <= 16 THEN text ELSE array_to_string(regexp_extract_all(text, '\\S+')[1:16], ' ') END AS text FROM documents")
def token_truncate(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.first_tokens(F.col("text"), 16).alias("text"))


# Pairs and sequences.

_PAIRS = """said AS (SELECT conv_id, turn, role, text AS input, lead(role) OVER w AS next, lead(text) OVER w AS output FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, input, output FROM said WHERE role = 'user' AND next = 'assistant'),
sizes AS (SELECT conv_id, turn, len(regexp_extract_all(input, '\\S+'))::BIGINT AS i, len(regexp_extract_all(output, '\\S+'))::BIGINT AS o, len(regexp_extract_all(input, '\\S+'))::BIGINT + 5 * len(regexp_extract_all(output, '\\S+'))::BIGINT AS l FROM pairs)"""
_ROWS = f"""{_PAIRS},
plain AS (SELECT conv_id, turn, unnest(regexp_extract_all(input, '\\S+')) AS token, unnest(range(len(regexp_extract_all(input, '\\S+')))) AS pos FROM pairs),
said_out AS (SELECT conv_id, turn, unnest(regexp_extract_all(output, '\\S+')) AS token, unnest(range(len(regexp_extract_all(output, '\\S+')))) AS j FROM pairs),
expanded AS (
  SELECT conv_id, turn, pos::BIGINT AS pos, ('0x' || substr(md5(token), 1, 8))::BIGINT AS input_id, pos::BIGINT AS position_id, 0::BIGINT AS gate, 1::BIGINT AS regular FROM plain
  UNION ALL
  SELECT conv_id, turn, (s.i + q.j * 5 + k.k)::BIGINT, CASE WHEN k.k = 0 THEN ('0x' || substr(md5(token), 1, 8))::BIGINT ELSE -2 END, (s.i + q.j + k.k)::BIGINT,
         CASE WHEN k.k >= 1 AND q.j + k.k + 1 < s.o THEN 1 ELSE 0 END, CASE WHEN k.k = 0 THEN 1 ELSE 0 END
  FROM said_out q JOIN sizes s USING (conv_id, turn) CROSS JOIN range(5) k(k))"""
_CHUNKS = """bounds AS (SELECT *, CASE WHEN o >= 3 THEN i ELSE l END AS p FROM sizes),
firsts AS (SELECT *, p + greatest(0, (128 - p)::DOUBLE / 5).floor()::BIGINT * 5 AS c0 FROM bounds),
cut AS (SELECT conv_id, turn, l, c0, unnest(range(1 + CASE WHEN l > c0 THEN (l - c0 + 124) // 125 ELSE 0 END))::BIGINT AS chunk_idx FROM firsts),
ends AS (SELECT conv_id, turn, l, chunk_idx, CASE WHEN chunk_idx = 0 THEN 0 ELSE c0 + (chunk_idx - 1) * 125 END AS "start", least(l, c0 + chunk_idx * 125) AS "end" FROM cut),
chunks AS (SELECT conv_id, turn, chunk_idx, "start", "end", CASE WHEN "end" < l THEN 128 ELSE
  (CASE WHEN greatest("end" - "start", 64) <= 64 THEN 64 WHEN greatest("end" - "start", 64) <= 96 THEN 96 WHEN greatest("end" - "start", 64) <= 128 THEN 128 ELSE "end" - "start" END) END::BIGINT AS target_len FROM ends)"""
_SLOTS = f"""{_ROWS}, {_CHUNKS},
slots AS (
  SELECT c.conv_id, c.turn, c.chunk_idx, e.pos - c."start" AS pos, e.input_id, e.position_id, e.gate, e.regular FROM chunks c JOIN expanded e ON e.conv_id = c.conv_id AND e.turn = c.turn AND e.pos >= c."start" AND e.pos < c."end"
  UNION ALL
  SELECT conv_id, turn, chunk_idx, unnest(range("end" - "start", target_len))::BIGINT, 0, 0, -1, 0 FROM chunks WHERE target_len > "end" - "start")"""
_PAST = f"""{_SLOTS},
regulars AS (SELECT conv_id, turn, chunk_idx, sum(regular)::BIGINT AS n_regular FROM slots GROUP BY ALL),
past AS (SELECT *, coalesce(sum(n_regular) OVER (PARTITION BY conv_id, turn ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS past FROM regulars)"""
_BLOCKS = f"""{_PAST},
blocks AS (SELECT s.conv_id, s.turn, s.chunk_idx, s.pos, s.gate, (p.past + sum(CASE WHEN gate = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id, s.turn, s.chunk_idx ORDER BY s.pos))::BIGINT AS block_id FROM slots s JOIN past p USING (conv_id, turn, chunk_idx))"""


def _conversations(spark, d):
    return _table(spark, d, "conversations")


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def training_pairs(spark, d):
    return prompts.training_pairs(_conversations(spark, d))


@query(f"WITH {_PAIRS} SELECT count(*)::BIGINT AS num_samples, sum(i)::BIGINT AS prompt_tokens, sum(o)::BIGINT AS output_tokens, sum(i + o)::BIGINT AS total_tokens, count(*) / 2.5::DOUBLE AS samples_per_sec, sum(i + o)::DOUBLE / 2.5::DOUBLE AS tok_per_sec FROM sizes")
def throughput_summary(spark, d):
    pairs = build.pair_table(_conversations(spark, d)).select(F.size("in_ids").cast("long").alias("in_tokens"), F.size("out_ids").cast("long").alias("out_tokens"))
    return writers.throughput(pairs, 2.5)


@query(f"WITH {_PAIRS} SELECT conv_id, turn, i AS n_in, o AS n_out, l AS total_len FROM sizes")
def expand_lengths(spark, d):
    pairs = build.pair_table(_conversations(spark, d))
    rows = sequences.expand(pairs.withColumn("n_in", F.size("in_ids").cast("long")).withColumn("n_out", F.size("out_ids").cast("long")), S.draft)
    return rows.select("conv_id", "turn", "n_in", "n_out", F.size("input_ids").cast("long").alias("total_len"))


@query(f"WITH {_ROWS} SELECT * FROM expanded")
def expand_rows(spark, d):
    return sequences.positions(build.sequence_table(_conversations(spark, d), S), *build.KEYS)


@query(f"WITH {_ROWS} SELECT conv_id, turn, pos, coalesce(lead(input_id) OVER (PARTITION BY conv_id, turn ORDER BY pos), -100) AS label FROM expanded")
def shifted_labels(spark, d):
    rows = build.sequence_table(_conversations(spark, d), S).select(*build.KEYS, F.posexplode(sequences.shifted_labels(F.col("input_ids"))).alias("pos", "label"))
    return rows.select(*build.KEYS, F.col("pos").cast("long").alias("pos"), F.coalesce("label", F.lit(-100)).alias("label"))


@query(f"WITH {_ROWS} SELECT e.conv_id, e.turn, sum(gate)::BIGINT AS n_gate, sum(regular)::BIGINT AS n_regular, any_value(CASE WHEN o >= 3 THEN i ELSE l END)::BIGINT AS prompt_len FROM expanded e JOIN sizes s USING (conv_id, turn) GROUP BY e.conv_id, e.turn")
def gate_counts(spark, d):
    rows = build.sequence_table(_conversations(spark, d), S)
    count = lambda c: V.total(V.doubles(F.col(c))).cast("long")
    return rows.select(*build.KEYS, count("gate_mask").alias("n_gate"), count("regular_token_mask").alias("n_regular"), sequences.prompt_length(F.col("gate_mask")).alias("prompt_len"))


@query(f'WITH {_PAIRS}, {_CHUNKS} SELECT conv_id, turn, chunk_idx, "start", "end", target_len FROM chunks')
def chunk_boundaries(spark, d):
    rows = build.sequence_table(_conversations(spark, d), S).withColumn("prompt_len", sequences.prompt_length(F.col("gate_mask")))
    return sequences.chunk_bounds(rows.select(*build.KEYS, "prompt_len", "total_len"), build.KEYS, S.draft, S.chunk, S.least, S.buckets)


@query(f"WITH {_SLOTS} SELECT * FROM slots")
def chunk_padded(spark, d):
    return sequences.positions(build.chunk_table(_conversations(spark, d), S), *build.KEYS, "chunk_idx")


@query(f"WITH {_SLOTS} SELECT conv_id, turn, chunk_idx, max(gate) > 0 AS valid FROM slots GROUP BY ALL")
def valid_chunks(spark, d):
    return build.chunk_table(_conversations(spark, d), S).select(*build.KEYS, "chunk_idx", sequences.is_valid(F.col("gate_mask")).alias("valid"))


@query(f"WITH {_SLOTS} SELECT conv_id, turn, max(chunk_idx) FILTER (gate > 0)::BIGINT AS last_valid, count(DISTINCT chunk_idx) FILTER (gate > 0)::BIGINT AS n_valid FROM slots GROUP BY ALL")
def last_valid_chunk(spark, d):
    rows = valid_chunks(spark, d)
    return rows.groupBy(*build.KEYS).agg(F.max(F.when(F.col("valid"), F.col("chunk_idx"))).alias("last_valid"), F.count_if("valid").alias("n_valid"))


@query(f"WITH {_PAST} SELECT conv_id, turn, chunk_idx, n_regular, past FROM past")
def past_seen(spark, d):
    return sequences.past_seen(build.chunk_table(_conversations(spark, d), S), build.KEYS).select(*build.KEYS, "chunk_idx", "n_regular", "past")


@query(f"WITH {_SLOTS} SELECT conv_id, turn, chunk_idx, pos, input_id FROM slots WHERE regular = 1")
def kept_state(spark, d):
    own = build.chunk_table(_conversations(spark, d), S)
    kept = sequences.seen_state(own, build.KEYS).select(*build.KEYS, "chunk_idx", F.posexplode("kept").alias("nth", "input_id"))
    places = own.select(*build.KEYS, "chunk_idx", F.posexplode(V.places_of(F.col("regular_token_mask"))).alias("nth", "pos"))
    return kept.join(places, [*build.KEYS, "chunk_idx", "nth"]).select(*build.KEYS, "chunk_idx", "pos", "input_id")


@query(f"""WITH {_PAST} SELECT conv_id, turn, chunk_idx, pos FROM (SELECT s.*, p.past + row_number() OVER (PARTITION BY s.conv_id, s.turn, s.chunk_idx ORDER BY s.pos) - 1 AS expected FROM slots s JOIN past p USING (conv_id, turn, chunk_idx) WHERE regular = 1) WHERE expected <> position_id""")
def continuity_check(spark, d):
    return sequences.position_gaps(build.chunk_table(_conversations(spark, d), S), build.KEYS).select(*build.KEYS, "chunk_idx", "pos")


@query(f"WITH {_BLOCKS} SELECT * FROM blocks")
def block_ids(spark, d):
    return sequences.blocks(build.chunk_table(_conversations(spark, d), S), build.KEYS).drop("past", "nth")


@query(f"""WITH {_BLOCKS} SELECT conv_id, turn, chunk_idx, pos, (CASE WHEN gate < 0 THEN 0 ELSE block_id + CASE WHEN gate = 1 THEN sum(CASE WHEN gate = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn, chunk_idx, block_id ORDER BY pos) ELSE 0 END END)::BIGINT AS n_visible FROM blocks""")
def visibility_counts(spark, d):
    return sequences.visible_counts(sequences.blocks(build.chunk_table(_conversations(spark, d), S), build.KEYS), build.KEYS)


@query(f"""WITH {_BLOCKS} SELECT q.conv_id, q.turn, q.chunk_idx, count(*)::BIGINT AS n_pairs, sum(q.pos * 1000 + k.pos)::BIGINT AS mark FROM blocks q JOIN blocks k ON q.conv_id = k.conv_id AND q.turn = k.turn AND q.chunk_idx = k.chunk_idx AND k.pos <= q.pos AND q.gate >= 0 AND k.gate >= 0 AND (k.gate = 0 OR q.gate = 1 AND q.block_id = k.block_id) GROUP BY ALL""")
def visibility_pairs(spark, d):
    found = sequences.chunk_pairs(build.chunk_table(_conversations(spark, d), S), build.KEYS)
    return found.groupBy(*build.KEYS, "chunk_idx").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("q") * 1000 + F.col("k")).alias("mark"))


# Batches and shards.

_BATCHES = f"""{_PAIRS},
shuffled AS (SELECT conv_id || '-' || turn AS seq_id, l AS total_len, row_number() OVER (ORDER BY md5('42-' || conv_id || '-' || turn), conv_id || '-' || turn) AS rn FROM sizes),
tiled AS (SELECT *, (rn - 1) // 40 AS tile FROM shuffled),
placed AS (SELECT *, tile * 40 + row_number() OVER (PARTITION BY tile ORDER BY total_len DESC, rn) - 1 AS pos FROM tiled),
batches AS (SELECT seq_id, total_len, pos::BIGINT AS pos, (pos // 8)::BIGINT AS batch, (pos % 8 // 2)::BIGINT AS rank, (pos % 2)::BIGINT AS slot FROM placed WHERE pos // 8 < (SELECT count(*) // 8 FROM sizes))"""


@query(f"WITH {_BATCHES} SELECT * FROM batches")
def length_grouped_batches(spark, d):
    return build.batch_table(_conversations(spark, d), S)


@query(f"WITH {_BATCHES} SELECT * FROM batches WHERE batch >= 3")
def resume_batches(spark, d):
    return batches.resumed(build.batch_table(_conversations(spark, d), S), 3)


@query(f"WITH {_BATCHES} SELECT seq_id, batch, batch // 2 AS step, batch % 2 AS micro FROM batches")
def micro_batches(spark, d):
    return batches.micro_batches(build.batch_table(_conversations(spark, d), S), S.accumulate).select("seq_id", "batch", "step", "micro")


@query(f"""WITH {_BATCHES}, plain AS (SELECT seq_id, total_len, (rn - 1) // 8 AS batch FROM shuffled WHERE (rn - 1) // 8 < (SELECT count(*) // 8 FROM sizes)),
padded AS (SELECT 'grouped' AS plan, batch, sum(total_len) AS t, max(total_len) * count(*) AS p FROM batches GROUP BY batch UNION ALL SELECT 'shuffled', batch, sum(total_len), max(total_len) * count(*) FROM plain GROUP BY batch)
SELECT plan, sum(t)::BIGINT AS tokens, sum(p)::BIGINT AS padded, round(1 - sum(t)::DOUBLE / sum(p)::DOUBLE, 6) AS waste FROM padded GROUP BY plan""")
def padding_ratio(spark, d):
    turns, out = _conversations(spark, d), None
    for name, window in (("grouped", S.window), ("shuffled", 0)):
        if window:
            rows = build.batch_table(turns, S)
        else:
            lengths = build.length_table(turns, S)
            rows = batches.ranked(lengths, T.order_hash(F.col("seq_id"), S.seed)).withColumn("batch", F.floor((F.col("rn") - 1) / BATCH)).filter(F.col("batch") < lengths.count() // BATCH)
        part = batches.padded_tokens(rows, "total_len").agg(F.sum("tokens").alias("tokens"), F.sum("padded").alias("padded")).select(F.lit(name).alias("plan"), "tokens", "padded", F.round(1 - F.col("tokens") / F.col("padded"), 6).alias("waste"))
        out = part if out is None else out.union(part)
    return out


@query(f"WITH {_PAIRS} SELECT conv_id || '-' || turn AS row_id, 72 + 32 * l AS bytes FROM sizes")
def row_sizes(spark, d):
    return build.length_table(_conversations(spark, d), S).select(F.col("seq_id").alias("row_id"), batches.row_bytes(F.col("total_len")).alias("bytes"))


@query(f"""WITH RECURSIVE {_PAIRS},
rows AS (SELECT conv_id || '-' || turn AS row_id, 72 + 32 * l AS bytes, row_number() OVER (ORDER BY conv_id || '-' || turn) AS n FROM sizes),
fold(n, shard, filled, own) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, -1::BIGINT
  UNION ALL
  SELECT r.n, CASE WHEN r.bytes >= {S.shard_bytes} THEN s + 1 ELSE s END, CASE WHEN r.bytes >= {S.shard_bytes} THEN 0 WHEN s > f.shard THEN r.bytes ELSE f.filled + r.bytes END, s
  FROM (SELECT f.*, f.shard + CASE WHEN f.filled > 0 AND (r.bytes >= {S.shard_bytes} OR f.filled + r.bytes > {S.shard_bytes}) THEN 1 ELSE 0 END AS s FROM fold f JOIN rows r ON r.n = f.n + 1) f JOIN rows r ON r.n = f.n + 1)
SELECT r.row_id, r.bytes, f.own AS shard_id FROM fold f JOIN rows r ON r.n = f.n""")
def shard_plan(spark, d):
    return batches.shard_plan(row_sizes(spark, d), S.shard_bytes)


_STEPS = "steps AS (SELECT 'step_' || n AS path, n AS step FROM (SELECT DISTINCT turn * 10 AS n FROM conversations))"


def _steps(spark, d):
    return _conversations(spark, d).select((F.col("turn") * 10).alias("n")).distinct().select(F.concat(F.lit("step_"), F.col("n").cast("string")).alias("path"), F.col("n").alias("step"))


@query(f"WITH {_STEPS} SELECT path, step, row_number() OVER (ORDER BY step DESC) <= 3 AS stays FROM steps")
def checkpoint_rotation(spark, d):
    return batches.rotated(_steps(spark, d), 3)


@query(f"WITH {_STEPS} SELECT path, step, step + 1 AS next_step FROM steps ORDER BY step DESC LIMIT 1")
def checkpoint_latest(spark, d):
    return batches.latest(_steps(spark, d))


# Vectors and metrics.

_NEXT = "next AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS t FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_EXPS = _NEXT + ", tops AS (SELECT *, list_max(x) AS mx, list_max(t) AS mt FROM next), exps AS (SELECT *, list_transform(x, lambda v: exp(v - mx)) AS ex, list_transform(t, lambda v: exp(v - mt)) AS et FROM tops)"


def _beside(spark, d):
    rows = metrics.with_next(_table(spark, d, "embeddings"), "vec_id", "embedding")
    return rows.select("vec_id", V.doubles(F.col("embedding")).alias("x"), V.doubles(F.col("next")).alias("t"))


_LOSS = f"WITH {_EXPS} SELECT vec_id, round(-(list_sum(list_transform(list_zip(et, x), lambda z: z[1] * z[2])) / list_sum(et)) + mx + ln(list_sum(ex)), 6) AS loss FROM exps"


@query(_LOSS)
def soft_ce(spark, d):
    return _beside(spark, d).select("vec_id", F.round(V.soft_cross_entropy(F.col("x"), F.col("t")), 6).alias("loss"))


@query(_LOSS)
def soft_ce_ref(spark, d):
    return _beside(spark, d).select("vec_id", F.round(V.soft_cross_entropy_plain(F.col("x"), F.col("t")), 6).alias("loss"))


@query(_LOSS)
def soft_ce_wide(spark, d):
    long = _beside(spark, d).select("vec_id", F.inline(F.arrays_zip("x", "t")))
    return metrics.log_sum_exp_parts(long, ["vec_id"], "x", "t").select("vec_id", F.round("loss", 6).alias("loss"))


@query(f"WITH {_EXPS}, sums AS (SELECT *, list_sum(ex) AS dx, list_sum(et) AS dt FROM exps) SELECT vec_id, unnest(range(len(x)))::BIGINT AS dim, round(unnest(list_transform(list_zip(ex, et), lambda z: z[1] / dx - z[2] / dt)), 6) + 0.0 AS gradient FROM sums")
def soft_ce_gradient(spark, d):
    rows = _beside(spark, d).select("vec_id", F.posexplode(V.soft_cross_entropy_gradient(F.col("x"), F.col("t"))).alias("dim", "g"))
    return rows.select("vec_id", F.col("dim").cast("long").alias("dim"), (F.round("g", 6) + 0.0).alias("gradient"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT - 1 AS best FROM embeddings")
def argmax(spark, d):
    return _table(spark, d, "embeddings").select("vec_id", V.argmax(F.col("embedding")).alias("best"))


@query("""WITH b AS (SELECT label, vec_id, list_position(embedding, list_max(embedding)) % 4 AS s, (list_position(embedding, list_min(embedding))) % 4 AS t FROM embeddings),
p AS (SELECT d.d, s, lead(t, (d.d + 1)::INT) OVER (PARTITION BY d.d, label ORDER BY vec_id) AS ahead FROM b CROSS JOIN range(4) d(d))
SELECT d::BIGINT AS d, coalesce(sum(CASE WHEN s = ahead THEN 1 ELSE 0 END), 0)::BIGINT AS matches, count(ahead)::BIGINT AS pairs, count(*)::BIGINT AS regular,
round(100.0 * coalesce(sum(CASE WHEN s = ahead THEN 1 ELSE 0 END), 0)::DOUBLE / greatest(count(*), 1), 6) AS acc, round(100.0 * coalesce(sum(CASE WHEN s = ahead THEN 1 ELSE 0 END), 0)::DOUBLE / greatest(count(ahead), 1), 6) AS acc_per_pair FROM p GROUP BY d""")
def draft_accuracy(spark, d):
    least = F.array_position("embedding", F.array_min("embedding"))
    rows = _table(spark, d, "embeddings").select("label", "vec_id", ((V.argmax(F.col("embedding")) + 1) % 4).alias("s"), (least % 4).alias("t"))
    return metrics.draft_accuracy(rows, ["label"], "vec_id", "s", "t", S.draft)


@query("""WITH c AS (SELECT (vec_id % 4) AS rank, label AS batch, vec_id % 8 AS row, abs(embedding[1])::DOUBLE AS loss, 0.5::DOUBLE AS scale, vec_id % 7 <> 0 AND label <> 3 AS valid, 10 + vec_id % 5 AS tokens,
(vec_id % 5)::BIGINT AS c0, (vec_id % 4)::BIGINT AS c1, (vec_id % 3)::BIGINT AS c2, (vec_id % 2)::BIGINT AS c3 FROM embeddings),
r AS (SELECT rank, batch, row, sum(loss * scale) FILTER (valid) AS ce, sum(tokens) FILTER (valid)::DOUBLE AS tokens, count(*) FILTER (valid) AS chunks, sum(c0) FILTER (valid)::DOUBLE AS c0, sum(c1) FILTER (valid)::DOUBLE AS c1, sum(c2) FILTER (valid)::DOUBLE AS c2, sum(c3) FILTER (valid)::DOUBLE AS c3 FROM c GROUP BY ALL),
b AS (SELECT rank, batch, sum(ce) AS ce, sum(chunks) AS chunks, avg(c0 / (tokens + 1e-8) * 100) AS a0, avg(c1 / (tokens + 1e-8) * 100) AS a1, avg(c2 / (tokens + 1e-8) * 100) AS a2, avg(c3 / (tokens + 1e-8) * 100) AS a3 FROM r GROUP BY ALL),
f AS (SELECT sum(ce) / greatest(1, sum(chunks)) AS loss, sum(ce) / greatest(1, count(*)) AS loss_by_batch, sum(chunks)::BIGINT AS chunks, count(*)::BIGINT AS batches, count(*) FILTER (chunks > 0)::BIGINT AS batches_for_acc, [avg(a0), avg(a1), avg(a2), avg(a3)] AS acc FROM b)
SELECT round(loss, 6) AS loss, round(loss_by_batch, 6) AS loss_by_batch, chunks, batches, batches_for_acc, unnest(range(4))::BIGINT AS d, round(unnest(acc), 6) AS acc FROM f""")
def step_stats_partial_final(spark, d):
    v = F.col("vec_id")
    correct = F.array(v % 5, v % 4, v % 3, v % 2)
    rows = _table(spark, d, "embeddings").select((v % 4).alias("rank"), F.col("label").alias("batch"), (v % 8).alias("row"), F.abs(F.col("embedding")[0]).cast("double").alias("loss"), F.lit(0.5).alias("scale"), ((v % 7 != 0) & (F.col("label") != 3)).alias("valid"), (10 + v % 5).alias("tokens"), correct.alias("correct"))
    by_batch = metrics.step_statistics(rows, S.draft, "batch").select("d", F.col("loss").alias("loss_by_batch"))
    out = metrics.step_statistics(rows, S.draft).join(by_batch, "d")
    return out.select(F.round("loss", 6).alias("loss"), F.round("loss_by_batch", 6).alias("loss_by_batch"), "chunks", "batches", "batches_for_acc", F.col("d").cast("long").alias("d"), F.round("acc", 6).alias("acc"))


@query("WITH l AS (SELECT unnest(range(len(embedding)))::BIGINT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT dim, round(avg(x), 6) AS mean FROM l GROUP BY dim")
def mean_vector(spark, d):
    rows = metrics.mean_vector(_table(spark, d, "embeddings").select(V.doubles(F.col("embedding")).alias("v")), "v")
    return rows.select(F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"))


@query("SELECT c.conv_id, c.turn, e.vec_id, round(e.embedding[1]::DOUBLE, 6) AS first FROM conversations c JOIN embeddings e ON e.vec_id = (c.conv_id * 7 + c.turn) % (SELECT count(*) FROM embeddings)")
def embedding_lookup(spark, d):
    vectors = _table(spark, d, "embeddings")
    tokens = _conversations(spark, d).select("conv_id", "turn", ((F.col("conv_id") * 7 + F.col("turn")) % vectors.count()).alias("vec_id"))
    return tokens.join(vectors.select("vec_id", "embedding"), "vec_id").select("conv_id", "turn", "vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) / len(embedding) + 1e-6) AS scale FROM embeddings) SELECT vec_id, unnest(range(len(v)))::BIGINT AS dim, round(unnest(list_transform(v, lambda x: x / scale)), 6) AS x FROM s")
def rms_norm(spark, d):
    rows = _table(spark, d, "embeddings").select("vec_id", F.posexplode(V.rms_norm(V.doubles(F.col("embedding")))).alias("dim", "x"))
    return rows.select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query("SELECT event_id AS step, round(0.0002::DOUBLE * (0.01 + 0.99 * least(event_id, 100) / 100.0::DOUBLE), 12) AS rate FROM events")
def lr_schedule(spark, d):
    return _table(spark, d, "events").select(F.col("event_id").alias("step"), F.round(metrics.warmed_rate(F.col("event_id"), 2e-4, 100), 12).alias("rate"))


# Names, maps, JSON, files.


@query("""SELECT p_partkey, regexp_replace(p_brand, '[^A-Za-z0-9._-]+', '', 'g') || '-data.v' || p_size || '-bsz' || greatest(1, p_size - 25) || '-lr' || CASE WHEN p_size % 3 = 0 THEN '2e-04' WHEN p_size % 3 = 1 THEN '0.01' ELSE '5e-05' END
|| '-MTP4-lora' || p_size || '-SoftSCE' || CASE WHEN p_size % 2 = 0 THEN '-fused' ELSE '' END || '-seed' || p_partkey AS name FROM part""")
def run_name_parts(spark, d):
    size = F.col("p_size")
    rate = F.when(size % 3 == 0, 2e-4).when(size % 3 == 1, 0.01).otherwise(5e-5)
    data = F.concat(F.lit("/data/data.v"), size.cast("string"), F.lit(".json"))
    name = T.run_name(F.concat(F.lit("hub/"), F.col("p_brand")), data, size - 25, rate, F.lit(4), size, F.col("p_partkey"), size % 2 == 0)
    return _table(spark, d, "part").select("p_partkey", name.alias("name"))


@query("""WITH m AS (SELECT label, count(*) AS n, avg(embedding[1]::DOUBLE) AS loss, 100.0 * avg((embedding[1] > 0)::INT) AS a0, 100.0 * avg((embedding[2] > 0)::INT) AS a1 FROM embeddings GROUP BY label)
SELECT label, 'Step ' || label || ' | LR: 2.0e-04 | Loss: ' || printf('%.4f', loss) || ' | Acc: ' || printf('%.2f%%', a0) || ', ' || printf('%.2f%%', a1) || ' | Num. Processed Chunks: ' || n AS line FROM m""")
def metrics_line(spark, d):
    share = lambda k: 100.0 * F.avg((F.col("embedding")[k] > 0).cast("int"))
    rows = _table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("embedding")[0].cast("double")).alias("loss"), F.create_map(F.lit("train/acc_1"), share(1), F.lit("train/acc_0"), share(0)).alias("m"))
    acc = F.transform(F.map_entries("m"), lambda e: F.struct(T.suffix_number(e["key"]).alias("place"), e["value"].alias("percent")))
    return rows.select("label", metrics.metrics_line(F.col("label"), F.lit(2e-4), F.col("loss"), acc, F.col("n")).alias("line"))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, regexp_extract(source, '(\\d+)$', 1)::BIGINT AS number FROM documents")
def text_bytes(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), T.suffix_number(F.col("source"), r"(\d+)$").alias("number"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events")
def json_parse(spark, d):
    # An object, whatever its fields: a value that isn't one gives null.
    parsed = F.from_json("props", "map<string,string>")
    return _table(spark, d, "events").select("event_id", F.try_element_at(parsed, F.lit("k")).alias("k"), parsed.isNotNull().alias("valid"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' ELSE 'other' END AS name FROM documents")
def map_lookup(spark, d):
    known = F.create_map(F.lit("en"), F.lit("english"), F.lit("fr"), F.lit("french"))
    return _table(spark, d, "documents").select("doc_id", F.coalesce(F.try_element_at(known, F.col("lang")), F.lit("other")).alias("name"))


@query("SELECT count(*)::BIGINT AS n_all, count(*) FILTER (p_name LIKE '%a%')::BIGINT AS n_chosen, round(100.0 * coalesce(sum(p_size) FILTER (p_name LIKE '%a%'), 0)::DOUBLE / greatest(1, sum(p_size)), 6) AS percent FROM part")
def chosen_parameters(spark, d):
    own = F.col("p_name").like("%a%")
    size = F.coalesce(F.sum(F.when(own, F.col("p_size"))), F.lit(0))
    return _table(spark, d, "part").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(own).alias("n_chosen"), F.round(100.0 * size / F.greatest(F.lit(1), F.sum("p_size")), 6).alias("percent"))


@query("SELECT DISTINCT 'file-' || (p_partkey % 5) AS file FROM part")
def weight_files(spark, d):
    entry = F.create_map(F.col("p_name"), F.concat(F.lit("file-"), (F.col("p_partkey") % 5).cast("string")))
    return readers.weight_files(_table(spark, d, "part").select(entry.alias("weight_map")))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def bag_union(spark, d):
    own = lambda x: _table(spark, d, "documents").filter(F.col("lang") == x).select("doc_id", "lang")
    return own("en").unionByName(own("fr"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, CASE WHEN l <= 32 THEN 32 WHEN l <= 64 THEN 64 WHEN l <= 96 THEN 96 WHEN l <= 128 THEN 128 ELSE l END::BIGINT AS bucket FROM sizes")
def length_buckets(spark, d):
    lengths = build.sequence_table(_conversations(spark, d), S)
    return lengths.select(*build.KEYS, V.bucket_for(F.col("total_len"), S.buckets).cast("long").alias("bucket"))


@query(f"WITH {_PAIRS}, r AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS i, * FROM pairs) SELECT conv_id, turn, length(input)::BIGINT AS n_in, length(output)::BIGINT AS n_out FROM r")
def positional_join(spark, d):
    """Prompts with what a generator gave back, by row id; the generator echoes the known output."""
    pairs = prompts.training_pairs(_conversations(spark, d)).withColumn("i", build.row_key())
    outputs = pairs.select("i", "output")
    return pairs.drop("output").join(outputs, "i").select("conv_id", "turn", F.length("input").cast("long").alias("n_in"), F.length("output").cast("long").alias("n_out"))


@query(None)
def file_fingerprints(spark, d):
    return readers.fingerprints(spark, d)


@query(f"WITH {_PAIRS} SELECT conv_id, turn, input, output FROM pairs")
def results_round_trip(spark, d):
    """Pairs as one JSON document for each conversation, and parsed back."""
    pairs = prompts.training_pairs(_conversations(spark, d))
    documents = pairs.groupBy("conv_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("turn", "input", "output"))).alias("results")), {"ignoreNullFields": "false"}).alias("body"))
    parsed = F.from_json("body", "results array<struct<turn:bigint,input:string,output:string>>")
    return documents.select("conv_id", F.inline(parsed["results"]))


@query("""SELECT n_nationkey, substr(sha1('{"a": "' || n_name || '", "b": ' || n_regionkey || '}'), 1, 16) AS key FROM nation""")
def cache_key(spark, d):
    """Settings that a table holds; one row for each, of a table that is as small at any size."""
    rows = _table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    schema = "n_nationkey int, key string"
    return rows.mapInPandas(lambda frames: (f.assign(key=[writers.cache_key({"b": int(b), "a": a}) for a, b in zip(f["n_name"], f["n_regionkey"], strict=True)])[["n_nationkey", "key"]] for f in frames), schema)


@query(f"WITH {_FIRST}, given AS (SELECT conv_id, '<|im_start|>system' || chr(10) || '{SYSTEM}<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS t FROM first_prompt) SELECT conv_id, CASE WHEN len(regexp_extract_all(t, '\\S+')) <= 16 THEN t ELSE array_to_string(regexp_extract_all(t, '\\S+')[1:16], ' ') END AS input FROM given")
def build_inputs(spark, d):
    return first_user_prompt(spark, d).select("conv_id", T.build_inputs(F.col("prompt"), SYSTEM, most=16).alias("input"))


@query("SELECT p_partkey, NOT (ends_with(p_type, 'TIN') OR ends_with(p_type, 'steel')) AS decayed FROM part")
def parameter_groups(spark, d):
    return prompts.parameter_groups(_table(spark, d, "part"), "p_type", ("TIN", "steel")).select("p_partkey", "decayed")


@query(f"WITH {_EXPS}, losses AS (SELECT -(list_sum(list_transform(list_zip(et, x), lambda z: z[1] * z[2])) / list_sum(et)) + mx + ln(list_sum(ex)) AS loss FROM exps) SELECT round(sum(loss), 6) AS ce, count(*)::BIGINT AS pairs, round(sum(loss) / greatest(1, count(*)), 6) AS mean FROM losses")
def mean_pair_loss(spark, d):
    losses = _beside(spark, d).select(V.soft_cross_entropy(F.col("x"), F.col("t")).alias("loss"))
    return metrics.mean_pair_loss(losses, "loss").select(F.round("ce", 6).alias("ce"), "pairs", F.round("mean", 6).alias("mean"))


@query(f"WITH {_SLOTS}, g AS (SELECT conv_id, turn, chunk_idx, min(pos) FILTER (gate = 1) AS first FROM slots GROUP BY ALL) SELECT s.conv_id, s.turn, s.chunk_idx, count(*) FILTER (regular = 1 AND pos >= first - 1)::BIGINT AS n FROM slots s JOIN g USING (conv_id, turn, chunk_idx) GROUP BY ALL")
def gated_regulars(spark, d):
    return sequences.gated_regulars(build.chunk_table(_conversations(spark, d), S), build.KEYS)


@query(f"WITH {_PAIRS} SELECT count(*)::BIGINT AS rows, coalesce(sum(72 + 32 * l), 0)::BIGINT AS bytes FROM sizes")
def total_bytes(spark, d):
    return batches.total_bytes(row_sizes(spark, d))


@query(f"WITH {_BATCHES} SELECT seq_id, batch, batch % 2 = 1 AS last_micro FROM batches")
def last_micro(spark, d):
    made = batches.micro_batches(build.batch_table(_conversations(spark, d), S), S.accumulate)
    return batches.last_flags(made, S.accumulate).select("seq_id", "batch", "last_micro")


def _epochs_sql() -> str:
    parts = []
    for e in range(2):
        one = _BATCHES.removeprefix(_PAIRS + ",\n").replace("'42-'", f"'{42 + e}-'")
        for name in ("shuffled", "tiled", "placed", "batches"):
            one = re.sub(rf"\b{name}\b", f"{name}_{e}", one)
        parts.append(one)
    whole = "(SELECT count(*) // 8 FROM sizes)"
    return f"WITH {_PAIRS}, {', '.join(parts)}, both_ AS (SELECT 0 AS epoch, seq_id, batch FROM batches_0 UNION ALL SELECT 1, seq_id, batch + {whole} FROM batches_1) SELECT epoch::INT AS epoch, seq_id, batch::BIGINT AS batch, (batch // 3)::BIGINT AS step, (batch % 3)::BIGINT AS micro FROM both_"


@query(_epochs_sql())
def epoch_batches(spark, d):
    """Two epochs in steps of three batches, which don't divide an epoch."""
    made = batches.epoch_batches(build.length_table(_conversations(spark, d), S), "seq_id", "total_len", epochs=2, accumulate=3, seed=S.seed, per_device=S.per_device, ranks=S.ranks, window=S.window)
    return made.select("epoch", "seq_id", "batch", "step", "micro")


@query(f"WITH {_PAIRS} SELECT conv_id, turn, l AS total_len FROM sizes")
def cached_build(spark, d):
    """Sequences written as shards with a manifest, then read back from the cache."""
    turns, root = _conversations(spark, d), fresh_dir(spark, "cache")
    built = build.cached_sequences(turns, S, root, f"{d}/conversations.parquet", "stand-in")
    again = build.cached_sequences(turns.limit(0), S, root, f"{d}/conversations.parquet", "stand-in")
    return built.select(*build.KEYS, "total_len").intersectAll(again.select(*build.KEYS, "total_len"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, input, output FROM pairs")
def json_lines_round_trip(spark, d):
    """Pairs as JSON lines, and scanned back with an explicit schema."""
    path = fresh_dir(spark, "lines")
    writers.write_json_lines(prompts.training_pairs(_conversations(spark, d)), path)
    return readers.read_records(spark, path, "conv_id long, turn long, input string, output string")


@query(
    _quota_sql()
    + """, firsts AS (SELECT k.file, k.doc_id, k.key, row_number() OVER (PARTITION BY k.file, k.key ORDER BY k.doc_id) AS nth FROM keyed k),
given AS (SELECT file, doc_id, key FROM chosen),
fold AS (SELECT f.file, f.doc_id, f.nth = 1 AND NOT EXISTS (SELECT 1 FROM given g WHERE g.key = f.key AND g.file < f.file) AS accepted FROM firsts f),
steps AS (SELECT *, coalesce(sum(accepted::INT) OVER (PARTITION BY file ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fold),
quota AS (SELECT * FROM (VALUES """
    + ", ".join(f"('{f}', {k})" for f, k in QUOTAS.items())
    + """) v(file, target))
SELECT q.file, q.target::BIGINT AS target, count(*) FILTER (accepted AND before < target)::BIGINT AS taken, count(*) FILTER (NOT accepted AND before < target)::BIGINT AS skipped FROM quota q LEFT JOIN steps s ON s.file = q.file GROUP BY q.file, q.target"""
)
def skipped_before_quota(spark, d):
    """Duplicates that were passed over until a file had given its quota, against a fold row by row; files are in the order of their names."""
    rows = _filed(spark, d)
    return prompts.quota_report(rows, QUOTAS, prompts.sample_by_quota(rows, QUOTAS))


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY md5('42-' || doc_id), doc_id) <= (SELECT count(*) // 2 FROM documents)")
def half_sample(spark, d):
    rows = _table(spark, d, "documents").select("doc_id")
    return prompts.sample(rows, rows.count() // 2, S.seed, "doc_id")


@query(f"""WITH {_PAIRS}, s AS (SELECT conv_id || '-' || turn AS seq_id, row_number() OVER (ORDER BY md5('42-' || conv_id || '-' || turn), conv_id || '-' || turn) - 1 AS pos FROM sizes), n AS (SELECT count(*) AS n, (count(*) + 3) // 4 * 4 AS whole FROM s),
dealt AS (SELECT seq_id, pos FROM s UNION ALL SELECT seq_id, pos + n FROM s, n WHERE pos + n < whole)
SELECT seq_id, pos::BIGINT AS pos, (pos // 4 // 2)::BIGINT AS batch, (pos % 4)::BIGINT AS rank, (pos // 4 % 2)::BIGINT AS slot FROM dealt""")
def plain_batches(spark, d):
    """Batches without grouping by length: ranks in turn, the first rows again where a rank is short."""
    return build.batch_table(_conversations(spark, d), S, grouped=False, drop_last=False)


@query("""SELECT 'conversations' AS name, conv_id AS id, (64 + 8 + sum(strlen('turn') + 8 + strlen('role') + strlen(role) + strlen('text') + strlen(text)))::BIGINT AS bytes FROM conversations GROUP BY conv_id
UNION ALL SELECT 'documents', doc_id, (64 + 8 + strlen(text) + strlen(lang) + strlen(source) + 8)::BIGINT FROM documents
UNION ALL SELECT 'events', event_id, (64 + 8 + 8 + 8 + strlen(event_type) + 8 + strlen(props))::BIGINT FROM events
UNION ALL SELECT 'embeddings', vec_id, (64 + 8 + 8 * len(embedding) + 8)::BIGINT FROM embeddings""")
def record_bytes(spark, d):
    """Estimated bytes of records of any schema, nested ones too."""
    turns = _conversations(spark, d).groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    out = None
    for name, key, rows in (("conversations", "conv_id", turns), *((t, k, _table(spark, d, t)) for t, k in (("documents", "doc_id"), ("events", "event_id"), ("embeddings", "vec_id")))):
        part = rows.select(F.lit(name).alias("name"), F.col(key).alias("id"), batches.row_size(rows).alias("bytes"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_PAIRS} SELECT conv_id, turn, input, output, true AS agree FROM pairs")
def vocabulary_round_trip(spark, d):
    """Pairs through a vocabulary of 50,257 tokens and its mask: ids back to text, and lengths as chunks and the cache have them."""
    import public_tokenizers

    turns, v, root = _conversations(spark, d), Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json")), fresh_dir(spark, "cache")
    pairs = build.pair_table(turns, v).select(*build.KEYS, v.text(F.col("in_ids")).alias("input"), v.text(F.col("out_ids")).alias("output"))
    lengths = build.length_table(turns, S, v)
    kept = build.chunk_table(turns, S, v).groupBy(*build.KEYS).agg(F.max("end").alias("in_chunks"))
    cached = build.cached_sequences(turns, S, root, f"{d}/conversations.parquet", v, columns=[*build.KEYS, "total_len"]).withColumnRenamed("total_len", "in_cache")
    out = pairs.withColumn("seq_id", build.row_key()).join(lengths, "seq_id").join(kept, build.KEYS).join(cached, build.KEYS)
    return out.select(*build.KEYS, "input", "output", ((F.col("total_len") == F.col("in_chunks")) & (F.col("total_len") == F.col("in_cache"))).alias("agree"))


@query(f"""WITH {_BLOCKS}, v AS (SELECT conv_id, turn, chunk_idx, pos, (CASE WHEN gate < 0 THEN 0 ELSE block_id + CASE WHEN gate = 1 THEN sum(CASE WHEN gate = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn, chunk_idx, block_id ORDER BY pos) ELSE 0 END END)::BIGINT AS n FROM blocks)
SELECT conv_id, turn, chunk_idx, sum(n)::BIGINT AS pairs FROM v GROUP BY ALL""")
def visibility_by_runs(spark, d):
    """What all queries of a chunk see together, from runs of positions instead of positions."""
    runs = sequences.visibility_runs(build.chunk_table(_conversations(spark, d), S), build.KEYS)
    return sequences.run_counts(runs, build.KEYS).groupBy(*build.KEYS, "chunk_idx").agg(F.sum("pairs").alias("pairs"))


@query(f"WITH {_SLOTS}, l AS (SELECT conv_id, turn, chunk_idx, pos, input_id FROM slots WHERE regular = 1) SELECT conv_id, turn, chunk_idx, count(*)::BIGINT AS n, sum(input_id)::BIGINT AS mark FROM l GROUP BY ALL")
def stream_kept_state(spark, d):
    """The kept state of sequences as a stream folds it, from chunks in files in an order of their own."""
    path, s = fresh_dir(spark, "chunks"), build.chunk_table(_conversations(spark, d), S)
    top = F.max("chunk_idx").over(Window.partitionBy(*build.KEYS))
    chunks = s.select(build.row_key().alias("seq_id"), "chunk_idx", "input_ids", "regular_token_mask", (F.col("chunk_idx") == top).alias("last"))
    chunks.repartition(3, F.xxhash64("seq_id", "chunk_idx")).write.parquet(path)
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = streams.drained(streams.kept_state(stream), "append")
    key = F.split("seq_id", "-")
    ids = F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), "chunk_idx", F.size("kept").cast("long").alias("n"), ids.alias("mark")).filter("n > 0")


# Streams.


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS n_users FROM events GROUP BY event_type")
def stream_dedupe(spark, d):
    found = streams.drained(streams.first_seen(streams.event_stream(spark, f"{d}/events.parquet"), ["user_id", "event_type"], "60 days").select("user_id", "event_type"), "append")
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_users"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def stream_metrics(spark, d):
    found = streams.drained(streams.windowed(streams.event_stream(spark, f"{d}/events.parquet")), "complete")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))
