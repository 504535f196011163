"""Demultiplexing: FASTQ inputs to files for each sample, and metrics."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.headers import after_number, before_number, comment_of, has_number, name_of, without_digit
from skein.operators import matcher, metrics
from skein.operators.samples import SampleGroup
from skein.operators.segments import segmented, sequences
from skein.operators.zipping import checked_rows, pieces, zip_records, zip_rows, zip_segments
from skein.plans.progress import Progress
from skein.plans.structure import FILE_CODES, ReadStructure, parse_kinds, parse_skip_reason
from skein.sources.fastq import SPLIT_BYTES, open_store, stage
from skein.sources.folders import drop_path, finer_scans, shared_folder, written
from skein.sources.sinks import ranges_in, record_text, write_fastq
from skein.sources.zipped import read_sets_of

METRICS_FILE = "demux-metrics.txt"
log = logging.getLogger(__name__)
#: Output kinds in the order in which their files are planned.
_ORDER = "TBMCS"


def read_sets(inputs: list[DataFrame], structures: list[ReadStructure], skip: bool = False) -> DataFrame:
    """Zipped and segmented inputs (ord, header, segments, skip_reason)."""
    seen: dict[str, int] = {}
    cut = []
    for df, rs in zip(inputs, structures, strict=True):
        cut.append(segmented(df, rs, skip, seen))
        for s in rs.segments:
            seen[s.kind] = seen.get(s.kind, 0) + 1
    return zip_segments(cut)


def rows_of(spark: SparkSession, paths: list[str], folder: str, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, bool]:
    """The files' records by position (ord, and header, seq and qual of each with its number
    behind), and whether partitions are ranges of positions.  Files that can be split are read
    side by side, without a shuffle; else each is staged and they are joined by position."""
    fields = ("header", "seq", "qual")
    rows = read_sets_of(spark, paths, fields, split_bytes)
    return (rows, True) if rows is not None else (zip_records(stage(spark, paths, folder), list(fields)), False)


def sets_of(spark: SparkSession, paths: list[str], structures: list[ReadStructure], skip: bool, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The files' read sets."""
    return zip_rows(rows_of(spark, paths, folder, split_bytes)[0], structures, skip)


def _heads(sets: DataFrame, umis: Callable[[Column], Column], barcodes: Column) -> DataFrame:
    """``sets`` with what stands around the read number in the header lines of their records
    (``__before``, ``__after``), and whether it stands there.  A set's header is taken apart
    once, step by step, and not for each of its records: they differ by the number alone.
    ``umis``: what stands before the number, of the name."""
    header, comment = F.col("header"), F.col("__comment")
    sets = sets.withColumns({"__name": name_of(header), "__comment": comment_of(header)})
    sets = sets.withColumn("__cut", without_digit(comment))
    return sets.withColumns({"__before": umis(F.col("__name")), "__numbered": has_number(comment), "__after": F.concat(after_number(comment, header, F.col("__cut")), barcodes)})


def _head(number: Column) -> Column:
    return F.concat("__before", F.when(F.col("__numbered"), number.cast("string")).otherwise(F.lit("")), "__after")


def routed(matched: DataFrame, kinds: set[str]) -> DataFrame:
    """sample_id, kind, kind_idx, ord, record: a row for each record to write.
    Read numbers are a segment's place within its kind.  Sets without a record to write have
    no header to fail."""
    b, m, header = F.col("__b"), F.col("__m"), F.col("header")
    segs = F.filter("segments", lambda s: s["kind"].isin(sorted(kinds - {"S"})))
    sets = matched.select("ord", "sample_id", "header", segs.alias("__segs"), sequences(F.col("segments"), "B").alias("__b"), sequences(F.col("segments"), "M").alias("__m"))
    umis = lambda name: F.when(F.size(m) > 0, before_number(name, F.array_join(m, "+"), header)).otherwise(before_number(name, None, header))
    apart = _heads(sets.where(F.size("__segs") > 0), umis, F.array_join(b, "+"))
    each = apart.select("ord", "sample_id", "__before", "__numbered", "__after", F.explode("__segs").alias("s"))  # what stands beside explode is done for each row
    return each.select("sample_id", F.col("s.kind").alias("kind"), F.col("s.kind_idx").alias("kind_idx"), "ord", record_text(_head(F.col("s.kind_idx")), F.col("s.seq"), F.col("s.qual")).alias("record"))


def routed_sets(matched: DataFrame, structures: list[ReadStructure], kinds: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """``matched`` (``checked_rows``, sample_id) with the records of ``routed``, a column for
    each file of a sample; and what stands behind the sample in the names of these files."""
    cut = pieces(structures)
    of = lambda letter: [seq for kind, _, seq, _ in cut if kind == letter]
    umis = lambda name: before_number(name, F.concat_ws("+", *of("M")) if of("M") else None, F.col("header"))
    apart = _heads(matched, umis, F.concat_ws("+", *of("B")))
    texts = {f"{FILE_CODES[kind]}{n}": record_text(_head(F.lit(n)), seq, qual) for kind, n, seq, qual in cut if kind in kinds - {"S"}}
    if not texts:
        return matched.where(F.lit(False)).withColumn("record", F.lit("")), {"record": ""}
    return apart.withColumns(texts), {c: f".{c}.fq.gz" for c in texts}


def file_name(prefix: str, kind: str, idx: int) -> str:
    return f"{prefix}.{FILE_CODES[kind]}{idx}.fq.gz"


def target_files(structures: list[ReadStructure], kinds: set[str], prefixes: list[str]) -> list[str]:
    """All files of a run; those that get no record are created empty."""
    counts = [(k, sum(rs.count(k) for rs in structures)) for k in _ORDER if k in kinds]
    return [file_name(p, k, i) for p in prefixes for k, n in counts for i in range(1, n + 1)]


@dataclass
class Demux:
    """A demultiplexing run.  ``threads`` is checked and otherwise Spark's concern."""

    inputs: list[str]
    read_structures: list[str]
    sample_metadata: str
    output: str
    output_types: str = "T"
    unmatched_prefix: str = "unmatched"
    max_mismatches: int = 1
    min_mismatch_delta: int = 2
    threads: int = 8
    compression_level: int = 5
    skip_reasons: list[str] = field(default_factory=list)
    staging: str | None = None
    split_bytes: int = SPLIT_BYTES
    log_every: int = 1_000_000
    #: Sets skipped by the last run, by reason.
    skipped: dict[str, int] = field(default_factory=dict, init=False)

    def validate(self) -> tuple[list[ReadStructure], set[str], bool]:
        # fixed values: what is said of each mistake
        errors: list[str] = []
        structures = [ReadStructure.parse(t) for t in self.read_structures]
        skip = bool([parse_skip_reason(r) for r in self.skip_reasons])
        if len(self.inputs) != len(structures):
            errors.append(f"The same number of read structures should be given as FASTQs {len(structures)} read-structures provided for {len(self.inputs)} FASTQs")
        fs, root = open_store(self.output)
        fs.create_dir(root, recursive=True)
        if os.path.isdir(root) and not os.stat(root).st_mode & 0o222:
            errors.append(f'Output directory "{self.output}" cannot be read-only')
        kinds: set[str] = set()
        try:
            kinds = parse_kinds(self.output_types)
        except ValueError as e:
            errors.append(str(e))
        for p in self.inputs:
            store, name = open_store(p)
            kind = store.get_file_info(name).type.name
            if kind == "NotFound":
                errors.append(f'Provided input file "{p}" doesn\'t exist')
            if kind != "File":
                errors.append(f"Error opening input files for reading: {p}")
        if self.threads < 5:
            errors.append(f"Threads provided {self.threads} was too low! Must be 5 or more.")
        if not errors and not kinds:
            errors.append("No output types requested, must request at least one output segment type.")
        if errors:
            said = "Inputs failed validation!\n" + "".join(f"    - {e}\n" for e in errors)
            raise ValueError(f"The following errors with the input(s) were detected:\n{said}")
        return structures, kinds, skip

    def execute(self, spark: SparkSession) -> DataFrame:
        """Writes the files and the metrics; returns the metrics."""
        structures, kinds, skip = self.validate()
        group = SampleGroup.from_file(spark, self.sample_metadata)
        if self.unmatched_prefix in {s.sample_id for s in group.samples}:
            raise ValueError(f"The unmatched prefix is also a sample: {self.unmatched_prefix}")
        log.info("%d samples read from %s", len(group.samples), self.sample_metadata)
        folder = f"{(self.staging or shared_folder(spark)).rstrip('/')}/demux-{os.urandom(8).hex()}"
        try:
            return self._run(spark, structures, kinds, skip, group, folder)
        finally:
            drop_path(spark, folder)

    def _run(self, spark: SparkSession, structures: list[ReadStructure], kinds: set[str], skip: bool, group: SampleGroup, folder: str) -> DataFrame:
        # read once: matching, files and skip counts all come from this table
        rows, in_ranges = rows_of(spark, self.inputs, f"{folder}/inputs", self.split_bytes)
        with Progress(spark, log, "records", self.log_every):
            every = written(checked_rows(rows, structures, skip), f"{folder}/sets")
        log.info("%d inputs read", len(self.inputs))
        samples = group.to_df(spark)
        memo = matcher.memo_of(every, samples, group.barcode_length, "obs", self.max_mismatches, self.min_mismatch_delta, f"{folder}/memo")
        # where nothing is shuffled from the inputs to here, the table's ranges become parts of the files
        few = matcher.is_broadcast(memo)
        in_ranges = in_ranges and few and sum(len(s.sample_id) + 64 for s in group.samples) <= matcher.BROADCAST_BYTES
        names = F.broadcast(samples) if in_ranges else samples
        kept = every.withColumn("range", ranges_in(every)).where("skip_reason is null")
        matched = matcher.with_sample(matcher.with_matches(kept, memo, small=few), names, self.unmatched_prefix)
        if in_ranges:  # uncut sets are narrower than the records made of them, and ranges follow each other
            matched = matched.sortWithinPartitions("best_ordinal", "ord")
        targets = target_files(structures, kinds, [s.sample_id for s in group.samples] + [self.unmatched_prefix])
        rows, files = routed_sets(matched, structures, kinds)
        with finer_scans(spark):
            write_fastq(rows.withColumn("target", F.col("sample_id")), self.output, targets, self.compression_level, in_order="range" if in_ranges else False, files=files, is_sorted=in_ranges)
        log.info("%d files written to %s", len(targets), self.output)
        self.skipped = {r["skip_reason"]: r["n"] for r in metrics.skip_counts(every).collect()}  # a row for each reason
        for reason, n in self.skipped.items():
            log.info("%s records skipped: %s", f"{n:,}", reason)
        if not self.skipped:
            log.info("no record was skipped")
        # the memo has every barcode's reads: no scan of theirs
        counts = memo.groupBy("best_ordinal").agg(F.sum("n").alias("templates"))
        found = metrics.demux_metrics(None, samples, self.unmatched_prefix, counts)
        # a row for each sample and one more; the staged tables go when the run ends
        found = spark.createDataFrame(found.orderBy("ordinal").collect(), found.schema)
        fs, root = open_store(self.output)
        with fs.open_output_stream(f"{root}/{METRICS_FILE}") as f:
            f.write(metrics.metrics_text(found).encode())
        log.info("%s records demultiplexed; metrics are in %s/%s", f"{sum(r['templates'] for r in found.collect()):,}", self.output, METRICS_FILE)
        return found
