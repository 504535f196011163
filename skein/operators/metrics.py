"""Templates for each sample, derived ratios, and skip counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = "sample_id string, barcode string, templates bigint, frac_templates double, ratio_to_mean double, ratio_to_best double"
COLUMNS = ("sample_id", "barcode", "templates", "frac_templates", "ratio_to_mean", "ratio_to_best")
UNMATCHED_BARCODE = "."
#: Stands for the unmatched row, which has no place in the sheet.
_NONE = -1


def float_ratio(top: Column, bottom: Column) -> Column:
    """Plain floating-point division: 0/0 is NaN and n/0 infinite."""
    t, b = top.cast("double"), bottom.cast("double")
    zero = F.when(t == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return F.when(b == 0, zero).otherwise(t / F.when(b == 0, F.lit(1.0)).otherwise(b))


def templates(matched: DataFrame) -> DataFrame:
    """best_ordinal (null: unmatched), templates."""
    return matched.groupBy("best_ordinal").agg(F.count("*").alias("templates"))


def demux_metrics(matched: DataFrame | None, samples: DataFrame, unmatched: str = "unmatched", counts: DataFrame | None = None) -> DataFrame:
    """A row for each sample, in sheet order by ``ordinal``, and the unmatched row
    last.  Samples without reads stay, with 0.  Mean and best are the samples'.
    ``counts`` (best_ordinal, templates) may be given instead of the matched reads."""
    spark = samples.sparkSession
    rest = spark.createDataFrame([(_NONE, unmatched, UNMATCHED_BARCODE)], "ordinal int, sample_id string, barcode string")
    sheet = samples.select("ordinal", "sample_id", "barcode").unionByName(rest)
    counts = (templates(matched) if counts is None else counts).select(F.coalesce("best_ordinal", F.lit(_NONE)).alias("ordinal"), "templates")
    both = sheet.join(counts, "ordinal", "left").withColumn("templates", F.coalesce("templates", F.lit(0)).cast("bigint"))
    every = Window.partitionBy()  # the sheet's rows and one more, whatever the reads
    own = F.when(F.col("ordinal") != _NONE, F.col("templates"))
    n = F.count(own).over(every)
    mean = float_ratio(F.coalesce(F.sum(own).over(every), F.lit(0)), n)
    return both.select(
        F.when(F.col("ordinal") == _NONE, n.cast("int")).otherwise(F.col("ordinal")).alias("ordinal"), "sample_id", "barcode", "templates",
        float_ratio(F.col("templates"), F.sum("templates").over(every)).alias("frac_templates"),
        float_ratio(F.col("templates"), mean).alias("ratio_to_mean"),
        float_ratio(F.col("templates"), F.max(own).over(every)).alias("ratio_to_best"),
    )


def skip_counts(read_sets: DataFrame) -> DataFrame:
    """skip_reason, n for skipped sets, fewest first."""
    return read_sets.where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("n")).orderBy("n", "skip_reason")


def number_text(x: float) -> str:
    """Shortest text that reads back as the same number."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    return repr(float(x))


def metrics_text(metrics: DataFrame) -> str:
    """The metrics file's content: one row for each sample of the sheet and one
    more, so they are brought to the driver."""
    lines = ["\t".join(COLUMNS)]
    for r in metrics.orderBy("ordinal").collect():
        lines.append("\t".join(number_text(r[c]) if isinstance(r[c], float) else str(r[c]) for c in COLUMNS))
    return "\n".join(lines) + "\n"


def read_metrics(spark, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=METRICS, nanValue="NaN", positiveInf="inf", negativeInf="-inf", quote="")
