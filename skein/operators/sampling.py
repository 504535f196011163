"""Bernoulli samples that agree across files, and their checks.

Whether a record is kept is a pure function of (seed, ord), so every file is
filtered on its own scan, in any order and partitioning, without a join.  Two generators
of draws are on offer: an MD5, which stays in generated code, and a counter-based stream
cipher (``chacha``), a draw for each position of its stream, in Arrow batches.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import chacha
from skein.functions.headers import base_read_name
from skein.operators.zipping import zip_records


def draw(seed: int, ord_: str | Column = "ord") -> Column:
    """Uniform in [0, 1): the first 32 bits of an MD5 of seed and position."""
    c = F.col(ord_) if isinstance(ord_, str) else ord_
    text = F.concat(F.lit(f"{seed}:"), c.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


GENERATORS = {"md5": draw, "chacha8": chacha.draw}


def kept(fraction: float, seed: int, ord_: str | Column = "ord", generator: str = "md5") -> Column:
    return GENERATORS[generator](seed, ord_) < F.lit(float(fraction))


def sample(reads: DataFrame, fraction: float, seed: int) -> DataFrame:
    return reads.where(kept(fraction, seed))


def effective_seed(seed: int | None, **parameters) -> int:
    """The given seed, else one made of every parameter: the same run has the same
    seed, and any change of a parameter another."""
    if seed is not None:
        return seed
    text = json.dumps(parameters, sort_keys=True, default=str)
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") >> 1


def sync_errors(inputs: list[DataFrame]) -> DataFrame:
    """ord, said: positions at which some file has no record."""
    n = len(inputs)
    both = zip_records(inputs, [])
    said = F.format_string(f"FASTQ files are out of sync: %d of {n} files had a record at read %d", F.col("n_present"), F.col("ord") + 1)
    return both.where(F.col("n_present") < n).select("ord", said.alias("said"))


def name_mismatches(inputs: list[DataFrame]) -> DataFrame:
    """ord, file_idx, name, first_name: records whose base name isn't file 0's."""
    both = zip_records([d.select("ord", base_read_name(F.col("header")).alias("name")) for d in inputs], ["name"])
    others = F.array(*(F.struct(F.lit(k).alias("file_idx"), F.col(f"name{k}").alias("name")) for k in range(1, len(inputs)))) if len(inputs) > 1 else None
    if others is None:
        return both.select("ord", F.lit(0).alias("file_idx"), F.col("name0").alias("name"), F.col("name0").alias("first_name")).where(F.lit(False))
    each = both.select("ord", F.col("name0").alias("first_name"), F.explode(others).alias("o")).select("ord", "o.file_idx", "o.name", "first_name")
    return each.where(F.col("name") != F.col("first_name"))


def findings(inputs: int, keep: Column, check_names: bool = True) -> list[Column]:
    """Aggregates over read sets (ord, and each input's columns with its number behind):
    total, kept, and the first set with a mistake of either kind (``at``)."""
    there = [F.col(f"seq{k}").isNotNull() for k in range(inputs)]
    present = sum((F.when(t, 1).otherwise(0) for t in there), F.lit(0))
    lacking = F.when(present < inputs, F.struct("ord", F.lit(0).alias("file_idx"), present.cast("string").alias("a"), F.lit("").alias("b")))
    first = base_read_name(F.col("header0"))
    names = []
    for k in range(1, inputs if check_names else 1):
        name = base_read_name(F.col(f"header{k}"))
        names.append(F.when(keep & (name != first), F.struct("ord", F.lit(k).alias("file_idx"), name.alias("a"), first.alias("b"))))
    return [F.count("*").alias("total"), F.count_if(keep).alias("kept"), F.min(F.coalesce(lacking, *names)).alias("at")]


def complain(said: dict, inputs: int) -> None:
    """Raises for the first mistake that ``findings`` tell."""
    at = said["at"]
    if at is None:
        return
    if at["file_idx"] == 0:
        raise ValueError(f"FASTQ files are out of sync: {at['a']} of {inputs} files had a record at read {at['ord'] + 1}")
    raise ValueError(f"Read name mismatch at read {at['ord'] + 1} in file {at['file_idx']}: {at['a']!r} vs. {at['b']!r}")


def totals(reads: DataFrame, fraction: float, seed: int) -> DataFrame:
    """total, kept, percent (0.0 of nothing) in one aggregate."""
    n = reads.agg(F.count("*").alias("total"), F.count_if(kept(fraction, seed)).alias("kept"))
    share = F.when(F.col("total") > 0, F.col("kept") * 100.0 / F.greatest("total", F.lit(1))).otherwise(0.0)
    return n.select("total", "kept", share.alias("percent"))
