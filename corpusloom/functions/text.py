"""Text as Column expressions: white space, prompt prefixes, templates, names. White space is Unicode's, as in (?U)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases by which prompts are told, and the preambles that replace them.
MATH_PREFIX = r"(?i)^\s*Return your final response within\s*\\{1,2}boxed\{\}\.\s*"
CODE_START = "generate an executable python function"
CODE_PREFIX = (
    r"(?is)^\s*Generate an executable Python function.*?"
    r"(?:stdin.*?print the output.*?(?:Simply call.*?definition\.)|Return the function body.*?final solution\.)\s*"
)
PREAMBLES = {
    "stdin": "Read from standard input and write to standard output. Do not print extra text.\n\n",
    "solve": "Implement a Python function solve() that reads from sys.stdin and prints to sys.stdout. Call solve() after its definition.\n\n",
}


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+", "")


def normalise(text: Column) -> Column:
    """Stripped, every run of white space one blank; case is kept."""
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def looks_like_code(text: Column) -> Column:
    return F.lower(text).startswith(CODE_START)


def looks_like_math(text: Column) -> Column:
    return text.rlike(MATH_PREFIX)


def domain(text: Column) -> Column:
    """code, else math, else other."""
    return F.when(looks_like_code(text), "code").when(looks_like_math(text), "math").otherwise("other")


def strip_math_prefix(text: Column) -> Column:
    """Without the phrase and what blanks follow; text without the phrase stays as it is."""
    return F.when(looks_like_math(text), lstrip(F.regexp_replace(text, MATH_PREFIX, ""))).otherwise(text)


def strip_code_prefix(text: Column) -> Column:
    return lstrip(F.regexp_replace(text, CODE_PREFIX, ""))


def preamble(style: Column) -> Column:
    out = F.lit("")
    for name, words in PREAMBLES.items():
        out = F.when(style == name, F.lit(words)).otherwise(out)
    return out


def rewritten(text: Column, style: Column) -> Column:
    """A prompt as its domain wants it: code gets the style's preamble, math loses its phrase, the rest is stripped."""
    code = strip(F.concat(preamble(style), strip_code_prefix(text)))
    return F.when(looks_like_code(text), code).when(looks_like_math(text), strip_math_prefix(text)).otherwise(strip(text))


def uniform(key: Column, seed: int) -> Column:
    """A number from 0 to 1, fixed by seed and key: the first 32 bits of an MD5."""
    return F.conv(F.substring(order_hash(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def order_hash(key: Column, seed: int) -> Column:
    """What a seeded shuffle orders by."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string")))


def choose(weights: Mapping[str, float], u: Column, default: str = "none") -> Column:
    """The first name whose running weight reaches u times the sum; negative weights count as none."""
    clipped = {k: max(0.0, float(v)) for k, v in weights.items()}
    total = sum(clipped.values())
    if total <= 0:
        return F.lit(default)
    out, reached = None, 0.0
    for k, v in clipped.items():
        reached += v
        hit = u * total <= F.lit(reached)
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out.otherwise(default)


def chat(text: Column, system: str | None = None, thinking: bool = True) -> Column:
    """A conversation of an optional system turn and a user turn, open for the assistant's."""
    turn = lambda role, body: F.concat(F.lit(f"<|im_start|>{role}\n"), body, F.lit("<|im_end|>\n"))
    parts = [turn("system", F.lit(system))] if system else []
    tail = "<|im_start|>assistant\n" + ("" if thinking else "<think>\n\n</think>\n\n")
    return F.concat(*parts, turn("user", text), F.lit(tail))


def tokens(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), 0)


def token_id(token: Column) -> Column:
    """A stand-in vocabulary without a file: the first 32 bits of the token's MD5. Never negative."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")


def token_ids(text: Column) -> Column:
    return F.transform(tokens(text), token_id)


def first_tokens(text: Column, most: int | None) -> Column:
    """The text if it has at most ``most`` tokens, else its first ones, a blank between them."""
    if most is None:
        return text
    found = tokens(text)
    return F.when(F.size(found) <= most, text).otherwise(F.array_join(F.slice(found, 1, most), " "))


def build_inputs(text: Column, system: str | None = None, thinking: bool = True, most: int | None = None) -> Column:
    """What a generator is given: the templated conversation, cut to its first tokens if asked for."""
    return first_tokens(chat(text, system, thinking), most)


def mask_id(vocabulary: Mapping[str, int], token: str = "<mask>") -> int:
    """The mask's id; a vocabulary that lacks it is an error."""
    if token not in vocabulary:
        raise ValueError(f"the vocabulary has no {token}; add it first")
    return vocabulary[token]


def base_name(path: Column) -> Column:
    """The last part of a path without its extension."""
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")


def model_name(path: Column) -> Column:
    short = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[^A-Za-z0-9._-]+", "")
    return F.when(short == "", "model").otherwise(short)


def sanitised(text: Column) -> Column:
    """White space dropped, other foreign characters one dash, none at the ends."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", ""), "[^A-Za-z0-9._-]", "-")
    return F.btrim(F.regexp_replace(plain, "-{2,}", "-"), F.lit("-"))


def short_number(x: Column) -> Column:
    """Scientific, without decimals, below 1e-3 and from 1e3 on; else plain, with six significant digits."""
    digits = F.format_string("%.3f", x)
    for decimals, below in ((4, 99.9995), (5, 9.99995), (6, 0.9999995), (7, 0.09999995), (8, 0.009999995)):
        digits = F.when(F.abs(x) < below, F.format_string(f"%.{decimals}f", x)).otherwise(digits)
    plain = F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", "")
    return F.when((x != 0) & ((x < 1e-3) | (x >= 1e3)), F.format_string("%.0e", x)).otherwise(plain)


def run_name(model: Column, data: Column, batch: Column, rate: Column, draft: Column, rank: Column, seed: Column, fused: Column, at: Column | None = None) -> Column:
    """<model>-<data>-bsz<batch>-lr<rate>-MTP<draft>-lora<rank>-SoftSCE[-fused]-seed<seed>[-<time>], sanitised."""
    # The names of the parts, and the form of the time.
    parts = [
        model_name(model), base_name(data), F.concat(F.lit("bsz"), F.greatest(F.lit(1), batch).cast("string")), F.concat(F.lit("lr"), short_number(rate)),
        F.concat(F.lit("MTP"), draft.cast("string")), F.concat(F.lit("lora"), rank.cast("string")), F.lit("SoftSCE"), F.when(fused, "fused"), F.concat(F.lit("seed"), seed.cast("string")),
        *([] if at is None else [F.date_format(at, "yyyyMMdd-HHmmss")]),
    ]
    return sanitised(F.concat_ws("-", *parts))


def suffix_number(text: Column, pattern: str = r"_(\d+)$") -> Column:
    """The number that the pattern's group finds, else null."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("long")
