"""Cutting reads into typed segments, and the too-few-bases rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.plans.structure import TOO_FEW_BASES, ReadStructure, Segment

SEGMENT = "struct<kind:string,kind_idx:int,seq:string,qual:string>"


def piece(c: Column, s: Segment) -> Column:
    return F.substr(c, F.lit(s.offset + 1)) if s.length is None else F.substr(c, F.lit(s.offset + 1), F.lit(s.length))


def cut(seq: Column, qual: Column, structure: ReadStructure, first_idx: dict[str, int] | None = None) -> Column:
    """ARRAY<struct<kind, kind_idx, seq, qual>> in order.  ``first_idx`` says how
    many segments of a kind stand in the inputs before; indexes start at 1.  Bases
    beyond a structure of fixed lengths are left out."""
    seen = dict(first_idx or {})
    parts = []
    for s in structure.segments:
        seen[s.kind] = seen.get(s.kind, 0) + 1
        parts.append(F.struct(F.lit(s.kind).alias("kind"), F.lit(seen[s.kind]).alias("kind_idx"), piece(seq, s).alias("seq"), piece(qual, s).alias("qual")))
    return F.array(*parts)


def _name(header: Column) -> Column:
    return F.split_part(header, F.lit(" "), F.lit(1))


def shortage(header: Column, seq: Column, structure: ReadStructure) -> Column:
    """What is said of a read that is too short for its structure; null of others."""
    need = structure.min_length
    said = F.format_string(f"Read %s had too few bases to demux %d vs. {need} needed in read structure {str(structure).replace('%', '%%')}.", _name(header), F.length(seq))
    return F.when(F.length(seq) < need, said)


def disagreement(header: Column, seq: Column, qual: Column) -> Column:
    """What is said of a read whose bases and qualities differ in number: its segments
    would come out short in silence.  The FASTQ source lets no such read by."""
    n = F.coalesce(F.length(qual), F.lit(0))
    return F.when(n != F.length(seq), F.format_string("Read %s has %d bases and %d qualities.", _name(header), F.length(seq), n))


def _raised(said: Column) -> Column:
    return F.when(said.isNotNull(), F.raise_error(said).cast("string"))


def too_few(header: Column, seq: Column, structure: ReadStructure, skip: bool) -> Column:
    """The skip reason of a read, null to keep it; fails the query where short
    reads aren't to be skipped."""
    return F.when(F.length(seq) < structure.min_length, F.lit(TOO_FEW_BASES)) if skip else _raised(shortage(header, seq, structure))


def mistakes(reads: DataFrame, structure: ReadStructure) -> DataFrame:
    """ord, said: the reads that would fail a run which skips none, and why."""
    header, seq, qual = F.col("header"), F.col("seq"), F.col("qual")
    said = F.coalesce(shortage(header, seq, structure), disagreement(header, seq, qual))
    return reads.select("ord", said.alias("said")).where("said is not null")


def skip_reason(header: Column, seq: Column, qual: Column, structure: ReadStructure, skip: bool = False) -> Column:
    """Why a read is skipped, null to keep it; null as well where there is no read."""
    return F.coalesce(too_few(header, seq, structure, skip), F.when(seq.isNotNull(), _raised(disagreement(header, seq, qual))))


def kept_segments(reason: Column, seq: Column, qual: Column, structure: ReadStructure, first_idx: dict[str, int] | None = None) -> Column:
    """A read's segments, none if it has a reason.  They depend on the reason, so that a
    failing read is never pruned."""
    empty = F.array().cast(f"array<{SEGMENT}>")
    return F.when(reason.isNotNull(), empty).otherwise(cut(seq, qual, structure, first_idx))


def segmented(reads: DataFrame, structure: ReadStructure, skip: bool = False, first_idx: dict[str, int] | None = None) -> DataFrame:
    """``reads`` (ord, header, seq, qual) as ord, header, segments, skip_reason."""
    header, seq, qual = F.col("header"), F.col("seq"), F.col("qual")
    made = reads.withColumn("skip_reason", skip_reason(header, seq, qual, structure, skip))
    return made.select("ord", "header", kept_segments(F.col("skip_reason"), seq, qual, structure, first_idx).alias("segments"), "skip_reason")


def of_kind(segments: Column, kind: str) -> Column:
    return F.filter(segments, lambda s: s["kind"] == kind)


def sequences(segments: Column, kind: str) -> Column:
    """ARRAY<STRING> of the bases of one kind, in order."""
    return F.transform(of_kind(segments, kind), lambda s: s["seq"])


def sample_barcode(segments: Column) -> Column:
    """Bases of all B segments, joined without a separator."""
    return F.array_join(sequences(segments, "B"), "")
