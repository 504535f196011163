"""Relating inputs by record position.

Records of a run are the rows with equal ``ord`` in every input.  Files that can be split
come side by side already (``zip_rows``), and nothing is joined.  Tables, and files that
can't be split, are joined: by a full outer join, so that a missing record shows; all
inputs shuffle on ``ord`` once and the joins after the first reuse that partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.segments import kept_segments, piece, skip_reason
from skein.plans.structure import ReadStructure

OUT_OF_SYNC = "FASTQ sources out of sync at records"


def _any_null(cols: list[Column]) -> Column:
    return reduce(Column.__or__, [c.isNull() for c in cols])


def zip_segments(inputs: list[DataFrame], check: bool = True) -> DataFrame:
    """Segmented inputs as one read set a position: ord, header (of input 0),
    segments (input order, then order in the read), skip_reason (the first one),
    in_sync.  A set with a reason is skipped before the inputs' lengths count."""
    if not inputs:
        raise ValueError("There is no input to relate.")
    named = [
        d.select("ord", F.col("header").alias(f"h{k}"), F.col("segments").alias(f"s{k}"), F.col("skip_reason").alias(f"r{k}"), F.lit(True).alias(f"in{k}"))
        for k, d in enumerate(inputs)
    ]
    return _sets(reduce(lambda a, b: a.join(b, "ord", "full_outer"), named), len(inputs), check)


def zip_rows(rows: DataFrame, structures: list[ReadStructure], skip: bool = False, check: bool = True) -> DataFrame:
    """``rows`` (ord, and header, seq and qual of each input with its number behind; null
    where it has no record) as ``zip_segments`` gives them, by a projection."""
    n = range(len(structures))
    made = _reasoned(rows, structures, skip)
    seen: dict[str, int] = {}
    parts = []
    for k, rs in enumerate(structures):
        parts.append(kept_segments(F.col(f"r{k}"), F.col(f"seq{k}"), F.col(f"qual{k}"), rs, seen).alias(f"s{k}"))
        for s in rs.segments:
            seen[s.kind] = seen.get(s.kind, 0) + 1
    present = (F.when(F.col(f"seq{k}").isNotNull(), F.lit(True)).alias(f"in{k}") for k in n)
    return _sets(made.select("ord", F.col("header0").alias("h0"), *parts, *(f"r{k}" for k in n), *present), len(structures), check)


def _reasoned(rows: DataFrame, structures: list[ReadStructure], skip: bool) -> DataFrame:
    return rows.withColumns({f"r{k}": skip_reason(F.col(f"header{k}"), F.col(f"seq{k}"), F.col(f"qual{k}"), rs, skip) for k, rs in enumerate(structures)})


def checked_rows(rows: DataFrame, structures: list[ReadStructure], skip: bool = False) -> DataFrame:
    """``rows`` uncut: ord, header (of input 0), seq and qual of each input with its number
    behind, skip_reason (the first one) and obs, the sample barcode, null of skipped sets.
    The checks are those of ``zip_rows``; they fail ``obs``."""
    n = range(len(structures))
    reason = F.coalesce(*(F.col(f"r{k}") for k in n))
    missing = _any_null([F.col(f"seq{k}") for k in n])
    bars = [seq for kind, _, seq, _ in pieces(structures) if kind == "B"]
    obs = F.when(missing, F.raise_error(F.lit(OUT_OF_SYNC)).cast("string")).otherwise(F.concat(F.lit(""), *bars))
    kept = (f"{c}{k}" for k in n for c in ("seq", "qual"))
    return _reasoned(rows, structures, skip).select("ord", F.col("header0").alias("header"), *kept, reason.alias("skip_reason"), F.when(reason.isNull(), obs).alias("obs"))


def pieces(structures: list[ReadStructure]) -> list[tuple[str, int, Column, Column]]:
    """Kind, place within the kind, bases and qualities of every segment of a set of
    ``checked_rows``, in order."""
    seen: dict[str, int] = {}
    out = []
    for k, rs in enumerate(structures):
        for s in rs.segments:
            seen[s.kind] = seen.get(s.kind, 0) + 1
            out.append((s.kind, seen[s.kind], piece(F.col(f"seq{k}"), s), piece(F.col(f"qual{k}"), s)))
    return out


def _sets(both: DataFrame, inputs: int, check: bool) -> DataFrame:
    n = range(inputs)
    reason = F.coalesce(*(F.col(f"r{k}") for k in n))
    in_sync = ~_any_null([F.col(f"in{k}") for k in n])
    out = both.select("ord", F.col("h0").alias("header"), F.concat(*(F.col(f"s{k}") for k in n)).alias("segments"), reason.alias("skip_reason"), in_sync.alias("in_sync"))
    if not check:
        return out
    bad = F.col("skip_reason").isNull() & ~F.col("in_sync")
    return out.withColumn("segments", F.when(bad, F.raise_error(F.lit(OUT_OF_SYNC)).cast(out.schema["segments"].dataType)).otherwise(F.col("segments")))


def zip_records(inputs: list[DataFrame], columns: list[str]) -> DataFrame:
    """ord, n_present and ``columns`` of every input with its number behind."""
    named = [d.select("ord", *(F.col(c).alias(f"{c}{k}") for c in columns), F.lit(1).alias(f"in{k}")) for k, d in enumerate(inputs)]
    both = reduce(lambda a, b: a.join(b, "ord", "full_outer"), named)
    present = reduce(Column.__add__, [F.coalesce(F.col(f"in{k}"), F.lit(0)) for k in range(len(inputs))])
    return both.select("ord", present.alias("n_present"), *(f"{c}{k}" for k in range(len(inputs)) for c in columns))
