"""Nearest-barcode matching under IUPAC-aware Hamming distance.

Reads repeat few distinct barcodes, so the distance runs once for each distinct one.
Up to ``FOLD_UP_TO`` samples come along as one row holding an array of packed masks,
and array steps tell the best and second best of its distances; larger sheets are
searched by an index of seeds (``seeds``).  No pair of barcode and sample ever becomes a
row.

The results are kept as a table, the memo, a row for each distinct barcode.  Those that
match anything go back to the reads by broadcast, if their counted rows allow it, and the
reads don't move.  Beyond that bound both sides shuffle by barcode and part: only frequent
barcodes, and reads without one, are dealt to more than one part, so none makes a task
of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.bases import PER_CHUNK, encode, mismatches_sql, n_nocalls
from skein.operators import seeds
from skein.operators.samples import SampleGroup
from skein.sources.folders import passing_path, written

WORST = 255
#: Samples that one row holds; the largest memo, in bytes, that is broadcast; parts of a
#: frequent barcode, which is one with more than a share of 1 / OFTEN of the reads.
FOLD_UP_TO, BROADCAST_BYTES, PARTS, OFTEN = 2_000, 24_000_000, 64, 400
RESULT = ("best_ordinal", "best_mismatches", "next_best_mismatches")


def _checked(value: int, name: str) -> int:
    if not 0 <= value <= WORST:
        raise ValueError(f"{name} must be from 0 to {WORST}, got {value}")
    return value


def sheet_row(samples: DataFrame, length: int) -> DataFrame:
    """One row: the samples' packed upper-case barcodes in ordinal order, and the
    most no-calls of any."""
    packed = samples.select("ordinal", encode("barcode", length).alias("masks"), n_nocalls("barcode").alias("ns"))
    return packed.agg(F.sort_array(F.collect_list(F.struct("ordinal", "masks"))).alias("__sheet"), F.max("ns").alias("__max_ns"))


def distances_sql(masks: str, sheet: str, length: int) -> str:
    """The mismatches with each sample of a sheet's row, in its order."""
    return f"transform({sheet}, x -> least({WORST}, cast({mismatches_sql(masks, 'x.masks', -(-length // PER_CHUNK))} as int)))"


def tried(obs: Column, length: int, max_mismatches: int, max_ns: Column) -> Column:
    """Whether a barcode is compared at all: it is long enough, and has no more no-calls
    than mismatches and the sheet's no-calls allow."""
    return (F.length(obs) >= length) & (n_nocalls(obs) <= F.lit(max_mismatches) + max_ns)


def accepts(best: Column, next_best: Column, max_mismatches: int, min_delta: int) -> Column:
    return (best <= max_mismatches) & (next_best - best >= min_delta)


def match_distinct(observed: DataFrame, samples: DataFrame, length: int, max_mismatches: int = 1, min_delta: int = 2, keep: list[str] | None = None) -> DataFrame:
    """obs, best_ordinal, best_mismatches, next_best_mismatches for every row of
    ``observed`` (obs, and the columns to ``keep``); the last three are null where
    there is no match.

    Shorter barcodes match nothing; nor do those with more no-calls than mismatches
    and the sheet's no-calls allow; a longer one that passes is an error.
    """
    _checked(max_mismatches, "max_mismatches")
    _checked(min_delta, "min_delta")
    met = observed.crossJoin(F.broadcast(sheet_row(samples, length)))  # one row: the sheet
    obs = F.col("obs")
    made = met.withColumn("__masks", F.when(tried(obs, length, max_mismatches, F.col("__max_ns")), encode(_fitting(obs, length), length)))
    # the first sample with fewest mismatches; the second fewest of those near enough alone
    far = made.withColumn("__d", F.when(F.col("__masks").isNotNull(), F.expr(distances_sql("__masks", "__sheet", length))))
    best = far.withColumn("__best", F.array_min("__d"))
    at = best.withColumn("__at", F.when(F.col("__best") <= max_mismatches, F.expr("array_position(__d, __best)")).cast("int"))
    others = "coalesce(array_min(concat(slice(__d, 1, __at - 1), slice(__d, __at + 1, size(__d)))), {0})".format(WORST)
    scored = at.withColumn("__next", F.when(F.col("__at").isNotNull(), F.expr(others)))
    found = F.col("__at").isNotNull() & accepts(F.col("__best"), F.col("__next"), max_mismatches, min_delta)
    ordinal = F.when(F.col("__best") < WORST, F.expr("__sheet[__at - 1].ordinal"))
    kept = zip(RESULT, (ordinal, F.col("__best"), F.col("__next")), strict=True)
    return scored.select("obs", *(keep or []), *(F.when(found, c).alias(f) for f, c in kept))


def match_in_large(observed: DataFrame, samples: DataFrame, length: int, max_mismatches: int = 1, min_delta: int = 2) -> DataFrame:
    """``match_distinct`` for distinct barcodes (obs) and a sheet of any size; the rows of
    those that match."""
    _checked(max_mismatches, "max_mismatches")
    _checked(min_delta, "min_delta")
    most = samples.agg(F.max(n_nocalls("barcode"))).first()[0]
    fit = observed.where(tried(F.col("obs"), length, max_mismatches, F.lit(most))).select(_fitting(F.col("obs"), length).alias("obs"))
    return seeds.nearest_two(fit, samples, length, max_mismatches, min_delta)


def overlength(obs: Column, length: int) -> Column:
    """What is said of a barcode that is longer than the sheet's; null of others."""
    said = F.concat(F.lit("Read barcode ("), obs, F.lit(") length ("), F.length(obs).cast("string"), F.lit(f") differs from expected barcode length ({length})"))
    return F.when(F.length(obs) > length, said)


def _fitting(obs: Column, length: int) -> Column:
    said = overlength(obs, length)
    return F.when(said.isNotNull(), F.raise_error(said).cast("string")).otherwise(obs)


def mistakes(observed: DataFrame, samples: DataFrame, length: int, max_mismatches: int = 1) -> DataFrame:
    """obs, said: the barcodes that would fail a run, and why; others are passed over or
    compared."""
    met = observed.crossJoin(F.broadcast(samples.agg(F.max(n_nocalls("barcode")).alias("__max_ns"))))  # one row
    obs = F.col("obs")
    return met.where(tried(obs, length, max_mismatches, F.col("__max_ns"))).select("obs", overlength(obs, length).alias("said")).where("said is not null")


def memo_of(reads: DataFrame, samples: DataFrame, length: int, obs: str = "obs", max_mismatches: int = 1, min_delta: int = 2, path: str | None = None) -> DataFrame:
    """obs, n (reads that have it) and the match, null where there is none, of every
    distinct barcode; a table stored at ``path``."""
    spark = reads.sparkSession
    counts = reads.select(F.col(obs).alias("obs")).where(F.col("obs").isNotNull()).groupBy("obs").agg(F.count("*").alias("n"))
    if samples.limit(FOLD_UP_TO + 1).count() <= FOLD_UP_TO:
        made = match_distinct(counts, samples, length, max_mismatches, min_delta, keep=["n"])
    else:
        counts = written(counts, passing_path(spark, "counts"))
        made = counts.join(match_in_large(counts.select("obs"), samples, length, max_mismatches, min_delta), "obs", "left")
    return written(made, path or passing_path(spark, "memo"))


def is_broadcast(memo: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the memo's matches are so few that they are broadcast and no read moves."""
    n, width = memo.where("best_ordinal is not null").agg(F.count("*"), F.coalesce(F.avg(F.length("obs")), F.lit(0.0))).first()
    return n * (width + 64) <= broadcast_bytes


def with_matches(reads: DataFrame, memo: DataFrame, obs: str = "obs", broadcast_bytes: int = BROADCAST_BYTES, small: bool | None = None) -> DataFrame:
    """``reads`` with the memo's results (null: unmatched).  ``small``: what ``is_broadcast``
    said of the memo, if it was asked already."""
    hits = memo.where("best_ordinal is not null").select(F.col("obs").alias("__obs"), *RESULT)
    if is_broadcast(memo, broadcast_bytes) if small is None else small:
        return reads.join(F.broadcast(hits), reads[obs] == F.col("__obs"), "left").drop("__obs")
    often = memo.crossJoin(F.broadcast(memo.agg(F.sum("n").alias("__all")))).where(f"n * {OFTEN} > __all").select(F.col("obs").alias("__often"))  # one row; OFTEN rows at most
    part = F.pmod(F.xxhash64(*reads.columns), F.lit(PARTS)).cast("int")
    dealt = reads.join(F.broadcast(often), reads[obs] == F.col("__often"), "left")
    dealt = dealt.withColumn("__part", F.when(F.col("__often").isNotNull() | F.col(obs).isNull(), part).otherwise(0)).drop("__often")
    copied = hits.join(F.broadcast(often), F.col("__obs") == F.col("__often"), "left")
    copied = copied.withColumn("__of", F.explode(F.when(F.col("__often").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(PARTS - 1))))).drop("__often")
    return dealt.hint("merge").join(copied, (dealt[obs] == copied["__obs"]) & (dealt["__part"] == copied["__of"]), "left").drop("__obs", "__part", "__of")


def match_barcodes(reads: DataFrame, samples: DataFrame, length: int, obs: str = "obs", max_mismatches: int = 1, min_delta: int = 2) -> DataFrame:
    """``reads`` with best_ordinal, best_mismatches, next_best_mismatches (null:
    unmatched).  The core operator; the distinct barcodes are counted and matched first."""
    return with_matches(reads, memo_of(reads, samples, length, obs, max_mismatches, min_delta), obs)


def match_group(reads: DataFrame, group: SampleGroup, **options) -> DataFrame:
    return match_barcodes(reads, group.to_df(reads.sparkSession), group.barcode_length, **options)


def with_sample(matched: DataFrame, samples: DataFrame, unmatched: str = "unmatched") -> DataFrame:
    """``matched`` with sample_id, ``unmatched`` where there is none.  The sheet is
    one run's; Spark broadcasts it by its size."""
    names = samples.select(F.col("ordinal").alias("best_ordinal"), "sample_id")
    return matched.join(names, "best_ordinal", "left").withColumn("sample_id", F.coalesce("sample_id", F.lit(unmatched)))


def unmatched_reads(matched: DataFrame) -> DataFrame:
    return matched.where("best_ordinal is null")
