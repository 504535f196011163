"""The packed-array library surface as functions on ARRAY<INT> columns, a symbol an
element; ``blocks`` has the same on symbols that are packed to blocks of bits.

``width`` is the bits of a symbol, 1 to 8; values are masked to it on the way in.
Addresses follow 32-bit blocks of which 32 - 32 % width bits are used.  Arrays
order, compare and hash as Spark's arrays do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_BITS = 32


def _width(width: int) -> int:
    if not 1 <= width <= 8:
        raise ValueError("Only encoding widths up to 8 supported")
    return width


def mask(width: int) -> int:
    return (1 << _width(width)) - 1


def new(width: int) -> Column:
    """An empty array; a capacity needs no counterpart."""
    _width(width)
    return F.array().cast("array<int>")


clear = new


def _fit(value: int | Column, width: int) -> Column:
    v = F.lit(value) if isinstance(value, int) else value
    return v.bitwiseAND(F.lit(mask(width))).cast("int")


def push(a: Column, value: int | Column, width: int) -> Column:
    return F.array_append(a, _fit(value, width))


def push_values(a: Column, n: int | Column, value: int | Column, width: int) -> Column:
    return F.concat(a, F.array_repeat(_fit(value, width), n))


def set_at(a: Column, i: int | Column, value: int | Column, width: int) -> Column:
    v = _fit(value, width)
    return F.transform(a, lambda x, j: F.when(j == i, v).otherwise(x))


def get(a: Column, i: int | Column) -> Column:
    """0-based; null beyond the ends."""
    return F.get(a, i)


def iterate(a: Column) -> Column:
    """Rows of (pos, col), in order."""
    return F.posexplode(a)


def nr_symbols(a: Column) -> Column:
    return F.size(a)


def is_empty(a: Column) -> Column:
    return F.size(a) == 0


def per_block(width: int) -> int:
    return (BLOCK_BITS - BLOCK_BITS % _width(width)) // width


def nr_blocks(a: Column, width: int) -> Column:
    return F.ceil(F.size(a) / F.lit(per_block(width))).cast("int")


def address(i: int | Column, width: int) -> Column:
    """STRUCT<block, bit> of the i-th symbol."""
    at = F.lit(i) if isinstance(i, int) else i
    n = per_block(width)
    return F.struct(F.floor(at / n).cast("int").alias("block"), ((at % n) * width).cast("int").alias("bit"))


def blocks(a: Column, width: int) -> Column:
    """ARRAY<BIGINT>: the array's 32-bit blocks as unsigned numbers."""
    n = per_block(width)

    def block(k: Column) -> Column:
        part = F.slice(a, k * n + 1, n)
        powers = F.transform(part, lambda x, j: x.cast("bigint") * F.pow(F.lit(2.0), j * width).cast("bigint"))
        return F.aggregate(powers, F.lit(0).cast("bigint"), lambda s, x: s + x)

    none = F.array().cast("array<bigint>")
    return F.when(F.size(a) == 0, none).otherwise(F.transform(F.sequence(F.lit(0), nr_blocks(a, width) - 1), block))


def get_by_address(bs: Column, at: Column, width: int) -> Column:
    value = F.floor(F.get(bs, at["block"]) / F.pow(F.lit(2.0), at["bit"])).cast("bigint")
    return value.bitwiseAND(F.lit(mask(width))).cast("int")


def set_by_address(bs: Column, at: Column, value: int | Column, width: int) -> Column:
    unit = F.pow(F.lit(2.0), at["bit"]).cast("bigint")
    old = get_by_address(bs, at, width).cast("bigint")
    new_ = _fit(value, width).cast("bigint")
    return F.transform(bs, lambda x, j: F.when(j == at["block"], x + (new_ - old) * unit).otherwise(x))


def hamming(a: Column, b: Column, most: int = 2**31 - 1) -> Column:
    """Positions where a's bits aren't within b's, at most ``most``; fails unless
    the lengths agree."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.bitwiseAND(F.bitwise_not(y)) != 0, 1).otherwise(0))
    count = F.least(F.aggregate(pairs, F.lit(0), lambda s, x: s + x), F.lit(most))
    unequal = F.raise_error(F.lit("Both bitenc sets of bases must have the same length")).cast("int")
    return F.when(F.size(a) != F.size(b), unequal).otherwise(count)
