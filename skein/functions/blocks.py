"""Arrays of small symbols, packed: STRUCT<blocks: ARRAY<BIGINT>, n: INT>.

``width`` is the bits of a symbol, 1 to 8.  A block is an unsigned 32-bit number of which
32 - 32 % width bits are used, the first symbol lowest; values are masked on the way in.
Symbols are read and written by shifts and masks.  Unused bits are 0, so packed arrays
order (by blocks, then length), compare, group and hash as the structs that they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.bases import mask_digits

BLOCK_BITS = 32
PACKED = "struct<blocks:array<bigint>,n:int>"


def _width(width: int) -> int:
    if not 1 <= width <= 8:
        raise ValueError("Only encoding widths up to 8 supported")
    return width


def mask(width: int) -> int:
    return (1 << _width(width)) - 1


def per_block(width: int) -> int:
    return (BLOCK_BITS - BLOCK_BITS % _width(width)) // width


def _col(c: int | str | Column) -> Column:
    return F.lit(c) if isinstance(c, int) else F.col(c) if isinstance(c, str) else c


def _left(x: Column, bits: int | Column) -> Column:
    return F.call_function("shiftleft", x, _col(bits).cast("int"))


def _right(x: Column, bits: int | Column) -> Column:
    return F.call_function("shiftright", x, _col(bits).cast("int"))


def _fit(value: int | Column, width: int) -> Column:
    return _col(value).cast("bigint").bitwiseAND(F.lit(mask(width)).cast("bigint"))


def _struct(blocks: Column, n: Column) -> Column:
    return F.struct(blocks.alias("blocks"), n.cast("int").alias("n"))


def _or(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))


def new(width: int) -> Column:
    """An empty array; a capacity needs no counterpart."""
    _width(width)
    return _struct(F.array().cast("array<bigint>"), F.lit(0))


clear = new


def pack(symbols: str | Column, width: int) -> Column:
    """Of an ARRAY<INT>."""
    a, n = _col(symbols), per_block(width)

    def block(k: Column) -> Column:
        return _or(F.transform(F.slice(a, k * n + 1, n), lambda x, j: _left(_fit(x, width), j * width)))

    none = F.array().cast("array<bigint>")
    blocks = F.when(F.size(a) == 0, none).otherwise(F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(a) - 1, F.lit(n)).cast("int")), block))
    return _struct(blocks, F.size(a))


def pack_bases(bases: str | Column) -> Column:
    """Of a string's bases as four-bit masks: eight hex digits are a block."""
    digits = mask_digits(bases)
    n = per_block(4)
    places = F.sequence(F.lit(0), F.greatest(F.length(digits) - 1, F.lit(0)), F.lit(n))
    blocks = F.transform(places, lambda k: F.conv(F.reverse(F.substring(digits, k + 1, F.lit(n))), 16, 10).cast("bigint"))
    return _struct(F.when(F.length(digits) == 0, F.array().cast("array<bigint>")).otherwise(blocks), F.length(digits))


def address(i: int | Column, width: int) -> Column:
    """STRUCT<block, bit> of the i-th symbol."""
    at, n = _col(i), per_block(width)
    return F.struct(F.floor(at / n).cast("int").alias("block"), ((at % n) * width).cast("int").alias("bit"))


def get_by_address(blocks: Column, at: Column, width: int) -> Column:
    return _right(F.get(blocks, at["block"]), at["bit"]).bitwiseAND(F.lit(mask(width)).cast("bigint")).cast("int")


def set_by_address(blocks: Column, at: Column, value: int | Column, width: int) -> Column:
    room = F.bitwise_not(_left(F.lit(mask(width)).cast("bigint"), at["bit"]))
    put = _left(_fit(value, width), at["bit"])
    return F.transform(blocks, lambda x, j: F.when(j == at["block"], x.bitwiseAND(room).bitwiseOR(put)).otherwise(x))


def get(a: Column, i: int | Column, width: int) -> Column:
    """0-based; null beyond the ends."""
    at = _col(i)
    return F.when((at >= 0) & (at < a["n"]), get_by_address(a["blocks"], address(at, width), width))


def set_at(a: Column, i: int | Column, value: int | Column, width: int) -> Column:
    """Beyond the ends nothing is set."""
    at = _col(i)
    done = set_by_address(a["blocks"], address(at, width), value, width)
    return _struct(F.when((at >= 0) & (at < a["n"]), done).otherwise(a["blocks"]), a["n"])


def push(a: Column, value: int | Column, width: int) -> Column:
    return push_values(a, 1, value, width)


def push_values(a: Column, n: int | Column, value: int | Column, width: int) -> Column:
    """The open block is filled, whole blocks follow, and a last one takes the rest."""
    size, more = per_block(width), _col(n).cast("int")
    full = reduce(Column.bitwiseOR, [_left(_fit(value, width), k * width) for k in range(size)])

    def some(count: Column) -> Column:
        return full.bitwiseAND(_left(F.lit(1).cast("bigint"), count * width) - 1)

    used = a["n"] % size
    first = F.least(F.when(used == 0, 0).otherwise(size - used), more)
    rest = more - first
    last = F.size(a["blocks"]) - 1
    filled = F.when(first == 0, a["blocks"]).otherwise(F.transform(a["blocks"], lambda x, j: F.when(j == last, x.bitwiseOR(_left(some(first), used * width))).otherwise(x)))
    whole = F.array_repeat(full, F.floor(rest / size).cast("int"))
    tail = F.when(rest % size == 0, F.array().cast("array<bigint>")).otherwise(F.array(some(rest % size)))
    return _struct(F.concat(filled, whole, tail), a["n"] + more)


def symbols(a: Column, width: int) -> Column:
    """ARRAY<INT> of the symbols, in order."""
    n = per_block(width)
    each = F.flatten(F.transform(a["blocks"], lambda x: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: _right(x, k * width).bitwiseAND(F.lit(mask(width)).cast("bigint")).cast("int"))))
    return F.slice(each, 1, a["n"])


def iterate(a: Column, width: int) -> Column:
    """Rows of (pos, col), in order."""
    return F.posexplode(symbols(a, width))


def nr_symbols(a: Column) -> Column:
    return a["n"]


def is_empty(a: Column) -> Column:
    return a["n"] == 0


def nr_blocks(a: Column) -> Column:
    return F.size(a["blocks"])


def hamming(a: Column, b: Column, width: int, most: int = 2**31 - 1) -> Column:
    """Positions where a's bits aren't within b's, at most ``most``, block by block; fails
    unless the lengths agree."""
    ones = F.lit(sum(1 << (k * width) for k in range(per_block(width)))).cast("bigint")

    def differ(x: Column, y: Column) -> Column:
        d = x.bitwiseAND(F.bitwise_not(y))
        return F.bit_count(reduce(Column.bitwiseOR, [_right(d, k) for k in range(width)]).bitwiseAND(ones))

    count = F.aggregate(F.zip_with(a["blocks"], b["blocks"], differ), F.lit(0), lambda s, x: s + x)
    unequal = F.raise_error(F.lit("Both bitenc sets of bases must have the same length")).cast("int")
    return F.when(a["n"] != b["n"], unequal).otherwise(F.least(count, F.lit(most)))
