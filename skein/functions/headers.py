"""Read headers: names, comments, and the rewrite that adds barcodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fewer(c: Column, colons: int) -> Column:
    """Whether there are fewer than ``colons``: nothing is cut off before that one."""
    return F.substring_index(c, ":", colons) == c


def name_of(header: Column) -> Column:
    """Up to the first space."""
    return F.substring_index(header, " ", 1)


def comment_of(header: Column) -> Column:
    """Behind the first space; null without one."""
    at = F.instr(header, " ")
    return F.when(at > 0, F.substr(header, at + 1))


def base_read_name(header: Column) -> Column:
    """Up to the first space or tab, without a final /1 or /2."""
    return F.regexp_replace(F.regexp_extract(header, r"^[^ \t]*", 0), "/[12]$", "")


def _fail(message: str, header: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), header)).cast("string")


def before_number(name: Column, umis: Column | None, header: Column) -> Column:
    """What stands before the read number in the header line of an output record."""
    if umis is None:
        return F.concat(F.lit("@"), name, F.lit(" "))
    sep = F.when(_fewer(name, 7), F.lit(":")).otherwise(F.lit("+"))
    too_many = _fail("Can't handle read name with more than 8 segments: ", header)
    return F.concat(F.lit("@"), F.when(_fewer(name, 8), F.concat(name, sep, umis)).otherwise(too_many), F.lit(" "))


def has_number(comment: Column) -> Column:
    """Whether the read number stands in the header line: not where a short comment stays."""
    return comment.isNull() | (~_fewer(comment, 3) & _fewer(comment, 4))


def without_digit(comment: Column) -> Column:
    """A comment without its last character, if that is a digit."""
    return F.regexp_replace(comment, r"[0-9]\z", "")


def after_number(comment: Column, header: Column, cut: Column | None = None) -> Column:
    """What stands behind the read number, up to the sample barcodes.  ``cut``: the comment
    ``without_digit``, where a step before has made it."""
    short = F.when(F.endswith(comment, F.lit(":")), comment).otherwise(F.concat(comment, F.lit(":")))
    cut = without_digit(comment) if cut is None else cut
    full = F.concat(F.substr(cut, F.instr(cut, ":")), F.when(F.endswith(cut, F.lit(":")), F.lit("")).otherwise(F.lit("+")))
    return (
        F.when(comment.isNull(), F.lit(":N:0:"))
        .when(comment == "", _fail("Empty comment in header: ", header))
        .when(_fewer(comment, 3), short)
        .when(_fewer(comment, 4), full)
        .otherwise(_fail("Comment in did not have 4 segments: ", header))
    )


def rewrite(header: Column, read_number: Column | int, barcodes: list[Column], umis: list[Column]) -> Column:
    """The header line of an output record.

    UMIs join the name; a missing comment becomes ``n:N:0:``; a comment of fewer
    than four fields stays and is ended by a colon; in one of four the first field
    becomes the read number and a final digit gives way.  Sample barcodes follow.
    """
    number = (F.lit(read_number) if isinstance(read_number, int) else read_number).cast("string")
    comment = comment_of(header)
    before = before_number(name_of(header), F.concat_ws("+", *umis) if umis else None, header)
    bars = [F.concat_ws("+", *barcodes)] if barcodes else []
    return F.concat(before, F.when(has_number(comment), number).otherwise(F.lit("")), after_number(comment, header), *bars)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)
