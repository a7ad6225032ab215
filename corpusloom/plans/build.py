"""End to end: prompts from conversations, and sequences, chunks and batches from pairs."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.vocabulary import STAND_IN, StandIn, Vocabulary
from corpusloom.operators import batches, prompts, sequences
from corpusloom.sources import readers, writers


@dataclass(frozen=True)
class Settings:
    """Parameters of a build; merged with later values winning."""

    draft: int = 4
    chunk: int = 128
    least: int = 64
    bucket_step: int = 32
    per_device: int = 2
    ranks: int = 4
    window: int = 5
    accumulate: int = 2
    seed: int = 42
    epoch: int = 0
    shard_bytes: int = 100_000

    def merged(self, *others: Mapping[str, object]) -> Settings:
        values = asdict(self)
        for other in others:
            values |= {k: v for k, v in other.items() if k in values}
        return Settings(**values)

    @property
    def buckets(self) -> list[int]:
        return sequences.buckets(self.chunk, self.bucket_step)


KEYS = ["conv_id", "turn"]


def prompt_table(turns: DataFrame, mix: Mapping[str, float], seed: int = 42) -> DataFrame:
    """(conv_id, prompt, domain): first prompts, rewritten, first of each normalised text."""
    found = prompts.prompts_by_domain(prompts.first_prompt(turns), mix, seed)
    return prompts.keep_first(found, prompts.text_key(F.col("prompt")), "conv_id")


def pair_table(turns: DataFrame, tokenise: Callable[[Column], Column] = STAND_IN) -> DataFrame:
    """(conv_id, turn, in_ids, out_ids) of all training pairs; tokenise: text to an array of ids."""
    return prompts.training_pairs(turns).select(*KEYS, tokenise(F.col("input")).alias("in_ids"), tokenise(F.col("output")).alias("out_ids"))


def sequence_table(turns: DataFrame, s: Settings, tokenise: Callable[[Column], Column] = STAND_IN, mask: int | None = None) -> DataFrame:
    """Expanded pairs. A vocabulary knows its mask's id, and that no text has it; any other function of one's own needs
    the id, and texts that have it are an error."""
    pairs = pair_table(turns, tokenise)
    if isinstance(tokenise, Vocabulary | StandIn) and mask is None:
        return sequences.expand(pairs, s.draft, tokenise.mask)
    if mask is None:
        return sequences.expand(pairs, s.draft)
    return sequences.expand(sequences.require_no_mask(pairs, ["in_ids", "out_ids"], mask), s.draft, mask)


def cached_sequences(turns: DataFrame, s: Settings, root: str, source: str, tokenizer: Vocabulary | StandIn | str = STAND_IN, build: bool = True, columns: list[str] | None = None) -> DataFrame:
    """The expanded pairs of a source, from the cache below root if it is complete, else built and written there.

    The cache is found by the source's files and the tokenizer's content. Without ``build`` a missing cache is an error.
    ``columns``: those that are wanted, all without.
    """
    if isinstance(tokenizer, str):
        if tokenizer != STAND_IN.fingerprint:
            raise ValueError(f"{tokenizer} is a name; a tokenizer is needed to build with")
        tokenizer = STAND_IN
    spark = turns.sparkSession
    folder = writers.cache_folder(root, readers.fingerprint(spark, source), tokenizer.fingerprint, s.draft, s.seed)
    found = readers.read_dataset(spark, folder, columns)
    if found is None:
        if not build:
            raise FileNotFoundError(f"{folder} has no complete dataset")
        # Ids are staged and sorted; the arrays, some forty times as large, are made where a shard is written.
        pairs, then = pair_table(turns, tokenizer), lambda df: sequences.expand(df, s.draft, tokenizer.mask)
        writers.write_dataset(pairs, folder, KEYS, s.shard_bytes, asdict(s), then=then, size=sequences.expanded_bytes(pairs, s.draft))
        found = readers.read_dataset(spark, folder, columns)
    return found.drop("shard_id")


def row_key() -> Column:
    """One key for a pair: conversation and turn."""
    return F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


def chunk_table(turns: DataFrame, s: Settings, tokenise: Callable[[Column], Column] = STAND_IN) -> DataFrame:
    return sequences.chunks(sequence_table(turns, s, tokenise), KEYS, s.draft, s.chunk, s.least, s.buckets)


def length_table(turns: DataFrame, s: Settings, tokenise: Vocabulary | StandIn = STAND_IN) -> DataFrame:
    """(seq_id, total_len): lengths need token counts only, no arrays."""
    pairs = prompts.training_pairs(turns)
    n = lambda c: tokenise.count(F.col(c))
    return pairs.select(row_key().alias("seq_id"), (n("input") + n("output") * (s.draft + 1)).alias("total_len"))


def batch_table(turns: DataFrame, s: Settings, tokenise: Vocabulary | StandIn = STAND_IN, grouped: bool = True, drop_last: bool = True) -> DataFrame:
    """Batches of rows of like lengths, or, if they aren't to be grouped, in plain shuffled order."""
    lengths = length_table(turns, s, tokenise)
    if grouped:
        return batches.grouped_batches(lengths, "seq_id", "total_len", seed=s.seed, epoch=s.epoch, per_device=s.per_device, ranks=s.ranks, window=s.window)
    return batches.plain_batches(lengths, "seq_id", seed=s.seed, epoch=s.epoch, per_device=s.per_device, ranks=s.ranks, drop_last=drop_last)
