"""IUPAC bases as four-bit masks, packed fifteen to a BIGINT.

Everything here is a Spark expression (or SQL text for one), so matching stays
inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letter of mask k is at place k - 1 (A 1, C 2, G 4, T 8).
LETTERS = "ACMGRSVTWYHKDBN"
MASKS = {b: k for k, b in enumerate(LETTERS, 1)} | {"U": 8}
DNA_MASKS = {b: MASKS[b] for b in "ACGT"}
PER_CHUNK = 15
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NIBBLE_ONES = int("1" * PER_CHUNK, 16)
_HEX = "123456789ABCDEF"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def upper(bases: str | Column) -> Column:
    """ASCII upper-casing: one character stays one character."""
    return F.translate(_col(bases), _LOWER, _UPPER)


def mask_digits(bases: str | Column) -> Column:
    """A hex digit for each base; 0 for what is no base.  Case doesn't matter, a
    full stop is a no-call and U is T."""
    plain = F.translate(upper(bases), "U.", "TN")
    known = F.regexp_replace(plain, f"[^{LETTERS}]", "X")
    return F.translate(known, LETTERS + "X", _HEX + "0")


def encode(bases: str | Column, length: int) -> Column:
    """ARRAY<BIGINT> of ceil(length / 15) chunks of ``length`` bases."""
    digits = mask_digits(bases)
    chunks = [F.conv(F.substring(digits, at + 1, min(PER_CHUNK, length - at)), 16, 10).cast("bigint") for at in range(0, length, PER_CHUNK)]
    return F.array(*chunks)


def masks(bases: str | Column) -> Column:
    """ARRAY<INT>, a mask for each base."""
    digits = mask_digits(bases)
    empty = F.array().cast("array<int>")
    return F.when(F.length(digits) == 0, empty).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.conv(F.substring(digits, i, F.lit(1)), 16, 10).cast("int"))
    )


def decode(bases: str | Column) -> Column:
    """What encoding and decoding give back; fails on what is no base."""
    plain = F.translate(upper(bases), "U.", "TN")
    bad = plain.rlike(f"[^{LETTERS}]")
    return F.when(bad, F.raise_error(F.lit("Invalid bit mask for base")).cast("string")).otherwise(plain)


def decode_masks(ms: str | Column) -> Column:
    """The string of an array of masks."""
    letter = lambda m: F.substring(F.lit(LETTERS), m, F.lit(1))
    bad = F.exists(_col(ms), lambda m: (m < 1) | (m > 15))
    return F.when(bad, F.raise_error(F.lit("Invalid bit mask for base")).cast("string")).otherwise(F.array_join(F.transform(_col(ms), letter), ""))


def is_nocall(base: str | Column) -> Column:
    return _col(base).rlike("^[Nn.]$")


def n_nocalls(bases: str | Column) -> Column:
    c = _col(bases)
    return F.length(c) - F.length(F.translate(c, "Nn.", ""))


def is_valid_iupac(bases: str | Column) -> Column:
    """Upper-case codes, and no-calls in either case; false for the empty string."""
    return _col(bases).rlike("^[ACGTUMRWSYKVHDBNn.]+$")


def chunk_mismatches_sql(observed: str, expected: str) -> str:
    """SQL: positions at which the observed mask is not within the expected one."""
    d = f"({observed} & ~{expected})"
    return f"bit_count(({d} | shiftright({d}, 1) | shiftright({d}, 2) | shiftright({d}, 3)) & {_NIBBLE_ONES})"


def mismatches_sql(observed: str, expected: str, chunks: int) -> str:
    return " + ".join(chunk_mismatches_sql(f"{observed}[{k}]", f"{expected}[{k}]") for k in range(chunks))


def hamming(observed: str | Column, expected: str | Column, length: int) -> Column:
    """Asymmetric IUPAC mismatches of two columns of ``length`` bases."""
    total = F.lit(0)
    o, e = encode(observed, length), encode(expected, length)
    for k in range(-(-length // PER_CHUNK)):
        d = o[k].bitwiseAND(F.bitwise_not(e[k]))
        any_bit = d.bitwiseOR(F.shiftright(d, 1)).bitwiseOR(F.shiftright(d, 2)).bitwiseOR(F.shiftright(d, 3))
        total = total + F.bit_count(any_bit.bitwiseAND(F.lit(_NIBBLE_ONES)))
    return total
