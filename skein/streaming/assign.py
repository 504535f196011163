"""Barcode assignment of a stream of reads.

The sheet is one static row and the best two samples come from a fold over it, so
a micro-batch needs no state, shuffle or watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.matcher import match_distinct


def assign_stream(reads: DataFrame, samples: DataFrame, length: int, max_mismatches: int = 1, min_delta: int = 2) -> DataFrame:
    """``reads`` (a stream with ``obs``, whose further columns go to ``read``)."""
    packed = reads.select("obs", F.struct(*reads.columns).alias("read"))
    return match_distinct(packed, samples, length, max_mismatches, min_delta, keep=["read"])
