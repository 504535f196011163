"""Sample sheets: reading, constraints, and the sheet as a small dimension.

A sheet names the samples of one run; it is read and checked on the driver.  ``mistakes``
tells all of a sheet's mistakes, row by row, as a query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.bases import LETTERS
from skein.sources.folders import passing_path, written

#: The sheet's header; below, what is said of each mistake.
HEADER = ("sample_id", "barcode")
SCHEMA = "sample_id string, barcode string, ordinal int"
_VALID = frozenset(LETTERS + "Un.")


NO_NAME, NO_BARCODE = "Sample name cannot be empty", "Sample barcode cannot be empty"
BAD_BASES = "All sample barcode bases must be one of A, C, G, T, U, R, Y, S, W, K, M, D, V, H, B, N"
SAME_NAME, SAME_BARCODE = "Each sample name must be unique, duplicate identified", "Each sample barcode must be unique, duplicate identified"
OTHER_LENGTH = "All barcodes must have the same length"


@dataclass(frozen=True)
class Sample:
    sample_id: str
    barcode: str
    ordinal: int = 0

    def __post_init__(self) -> None:
        if not self.sample_id:
            raise ValueError(NO_NAME)
        if not self.barcode:
            raise ValueError(NO_BARCODE)
        if not set(self.barcode) <= _VALID:
            raise ValueError(BAD_BASES)

    def __str__(self) -> str:
        return f"Sample({self.ordinal:04d}) - {{ name: {self.sample_id}\tbarcode: {self.barcode} }}"


def header_line() -> str:
    return "\t".join(HEADER)


@dataclass(frozen=True)
class SampleGroup:
    samples: tuple[Sample, ...]

    @classmethod
    def from_samples(cls, samples) -> SampleGroup:
        given = list(samples)
        if not given:
            raise ValueError("Must provide one or more sample")
        if len({s.sample_id for s in given}) < len(given):
            raise ValueError(SAME_NAME)
        if len({s.barcode for s in given}) < len(given):
            raise ValueError(SAME_BARCODE)
        if len({len(s.barcode) for s in given}) > 1:
            raise ValueError(OTHER_LENGTH)
        return cls(tuple(Sample(s.sample_id, s.barcode, k) for k, s in enumerate(given)))

    @classmethod
    def from_text(cls, text: str) -> SampleGroup:
        """Tab-separated with a header line, nothing quoted; blank lines drop."""
        lines = [x for x in text.replace("\r\n", "\n").split("\n") if x.strip()]
        if not lines:
            raise ValueError("Must provide one or more sample")
        names = lines[0].split("\t")
        missing = [h for h in HEADER if h not in names]
        if missing:
            raise ValueError(f"Invalid header: expected {header_line()!r}, found {lines[0]!r}")
        at = [names.index(h) for h in HEADER]
        rows = [x.split("\t") for x in lines[1:]]
        short = next((r for r in rows if len(r) != len(names)), None)
        if short is not None:
            raise ValueError(f"Sample sheet row has {len(short)} fields, expected {len(names)}: {short}")
        return cls.from_samples(Sample(*(r[i] for i in at)) for r in rows)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> SampleGroup:
        """Read through Spark, so any store that Spark reads will do; whole text,
        because a row's place in the file is its ordinal."""
        rows = spark.read.text(path, wholetext=True).collect()
        return cls.from_text(rows[0][0] if rows else "")

    @property
    def barcode_length(self) -> int:
        return len(self.samples[0].barcode)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s.sample_id, s.barcode, s.ordinal) for s in self.samples], SCHEMA)

    def __str__(self) -> str:
        return "SampleGroup {\n" + "".join(f"    {s}\n" for s in self.samples) + "}\n"


def numbered(sheet: DataFrame, key: str) -> DataFrame:
    """A large ``sheet`` with its rows' places in the order of ``key`` (without ties) as
    ``ordinal``: rows are numbered in ranges, which are stored, and ranges by their counts."""
    spark = sheet.sparkSession
    ranged = sheet.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1).cast("bigint"))  # fixed value: the bits of a partition's rows
    placed = written(ranged.withColumn("__range", F.spark_partition_id()).withColumn("__at", at), passing_path(spark, "numbered"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = placed.groupBy("__range").agg(F.count("*").alias("n")).select("__range", before.alias("__before"))  # a row for each range
    return placed.join(F.broadcast(firsts), "__range").withColumn("ordinal", (F.col("__before") + F.col("__at")).cast("int")).drop("__range", "__at", "__before")


def mistakes(sheet: DataFrame) -> DataFrame:
    """ordinal, said: the first rule that each row of ``sheet`` (ordinal, sample_id,
    barcode) breaks.  Of equal names or barcodes all but the first break one; the first
    row's barcode sets the length.  Null is empty."""
    name, barcode = F.coalesce("sample_id", F.lit("")), F.coalesce("barcode", F.lit(""))
    made = sheet.select("ordinal", name.alias("name"), barcode.alias("barcode"))
    first = made.agg(F.length(F.min_by("barcode", "ordinal")).alias("length"))  # one row
    again = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("ordinal")) > 1
    rules = [
        (F.col("name") == "", NO_NAME), (F.col("barcode") == "", NO_BARCODE), (~F.col("barcode").rlike(f"^[{''.join(sorted(_VALID))}]*$"), BAD_BASES),
        (again("name"), SAME_NAME), (again("barcode"), SAME_BARCODE), (F.length("barcode") != F.col("length"), OTHER_LENGTH),
    ]
    said = F.coalesce(*(F.when(broken, F.lit(text)) for broken, text in rules))
    return made.crossJoin(F.broadcast(first)).select("ordinal", said.alias("said")).where("said is not null")
