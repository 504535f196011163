"""Subsampling: the same random records of any number of FASTQ files."""

from __future__ import annotations

import logging
import os
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skein.operators import sampling
from skein.operators.zipping import zip_records
from skein.plans.progress import Progress
from skein.sources.fastq import SPLIT_BYTES, open_store, stage
from skein.sources.folders import drop_path, shared_folder, written
from skein.sources.sinks import record_text, write_fastq
from skein.sources.zipped import FIELDS, read_sets_of

log = logging.getLogger(__name__)


@dataclass
class Subsample:
    inputs: list[str]
    output: str
    fraction: float
    threads: int = 8
    compression_level: int = 5
    seed: int | None = None
    disable_read_name_checking: bool = False
    split_bytes: int = SPLIT_BYTES
    log_every: int = 5_000_000
    #: Of draws; see ``sampling.GENERATORS``.
    generator: str = "md5"

    def validate(self) -> None:
        # fixed values: what is said of each mistake
        errors = []
        if not self.inputs:
            errors.append("At least one input file is required.")
        for p in self.inputs:
            fs, name = open_store(p)
            if fs.get_file_info(name).type.name == "NotFound":
                errors.append(f'Input file "{p}" does not exist.')
        if not 0.0 <= self.fraction <= 1.0:  # NaN fails as well
            errors.append(f"Fraction must be in [0.0, 1.0], got {self.fraction}.")
        if self.threads < 2:
            errors.append(f"Threads must be at least 2, got {self.threads}.")
        if not 1 <= self.compression_level <= 12:
            errors.append(f"Compression level must be 1-12, got {self.compression_level}.")
        if self.generator not in sampling.GENERATORS:
            errors.append(f"Generator must be one of {', '.join(sampling.GENERATORS)}, got {self.generator}.")
        fs, root = open_store(self.output)
        parent = os.path.dirname(root)
        if parent and fs.get_file_info(parent).type.name != "Directory":
            errors.append(f'Output parent directory "{parent}" does not exist.')
        if errors:
            raise ValueError("The following errors with the input(s) were detected:\n" + "".join(f"    - {e}\n" for e in errors))

    def effective_seed(self) -> int:
        given = asdict(self)
        given.pop("seed")
        for how in ("split_bytes", "log_every", "generator"):  # not what a seed is made of
            given.pop(how)
        return sampling.effective_seed(self.seed, **given)

    def execute(self, spark: SparkSession) -> tuple[int, int, float]:
        """Writes one file for each input; returns total, kept and percent.

        Files that can be split are read side by side, once, in record order: each task
        filters its range, checks it and writes its part of every file, and nothing is
        shuffled.  Totals and the first mistake come from that same job, and files get
        their names only after that.  Other files are staged and joined by position first.
        """
        self.validate()
        folder = f"{shared_folder(spark)}/subsample-{os.urandom(8).hex()}"
        try:
            total, kept, percent = self._run(spark, self.effective_seed(), folder)
        finally:
            drop_path(spark, folder)
        log.info("%s record sets read, %s written (%.1f%%)", f"{total:,}", f"{kept:,}", percent)
        return total, kept, percent

    def _run(self, spark: SparkSession, seed: int, folder: str) -> tuple[int, int, float]:
        n, seen = len(self.inputs), Observation()
        sets = read_sets_of(spark, self.inputs, FIELDS, self.split_bytes)
        side_by_side = sets is not None
        if not side_by_side:
            sets = zip_records(stage(spark, self.inputs, f"{folder}/inputs"), list(FIELDS))
        check_names = n > 1 and not self.disable_read_name_checking
        sets = sets.withColumn("keep", sampling.kept(self.fraction, seed, generator=self.generator))
        rows = self.records(sets.observe(seen, *sampling.findings(n, F.col("keep"), check_names)).where("keep"))
        if not side_by_side:
            rows = written(rows, f"{folder}/kept")
        log.info("%d inputs read", n)
        fs, root = open_store(self.output)
        targets = [self._target(k) for k in range(n)]
        with Progress(spark, log, "record sets", self.log_every):
            write_fastq(rows, os.path.dirname(root) or ".", targets, self.compression_level, in_order=side_by_side, check=lambda: sampling.complain(seen.get, n))
        said = seen.get
        return said["total"], said["kept"], said["kept"] * 100.0 / said["total"] if said["total"] else 0.0

    def _target(self, k: int) -> str:
        return f"{os.path.basename(open_store(self.output)[1])}.R{k + 1}.fq.gz"

    def records(self, sets: DataFrame) -> DataFrame:
        """target, ord, record of every file's record in ``sets``."""
        each = []
        for k in range(len(self.inputs)):
            text = record_text(F.concat(F.lit("@"), F.col(f"header{k}")), *(F.col(f"{c}{k}") for c in ("seq", "qual", "raw_plus", "ends")))
            each.append(F.struct(F.lit(self._target(k)).alias("target"), text.alias("record")))
        return sets.select("ord", F.explode(F.array(*each)).alias("r")).select("r.target", "ord", "r.record").where("record is not null")
