"""Read structures: a compact notation for the segments of a read.

A structure is a run of ``<length><kind>``; the last length may be ``+`` for all
that is left.  Kinds: T template, B sample barcode, M molecular barcode, C cell
barcode, S skipped.  Parsed on the driver; lengths become literals of the plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

KINDS = "TBMCS"
#: Letters of the kinds in output file names.
FILE_CODES = {"T": "R", "B": "I", "M": "U", "C": "C", "S": "S"}
TOO_FEW_BASES = "too-few-bases"


@dataclass(frozen=True)
class Segment:
    kind: str
    offset: int
    length: int | None  # None: all that is left

    def __str__(self) -> str:
        return f"{'+' if self.length is None else self.length}{self.kind}"


@dataclass(frozen=True)
class ReadStructure:
    segments: tuple[Segment, ...]

    @classmethod
    def parse(cls, text: str) -> ReadStructure:
        plain = re.sub(r"\s", "", text).upper()
        if not re.fullmatch(rf"(?:(?:[0-9]+|\+)[{KINDS}])+", plain):
            raise ValueError(f"Read structure is not valid: {text!r}")
        out, at = [], 0
        parts = re.findall(rf"([0-9]+|\+)([{KINDS}])", plain)
        for k, (size, kind) in enumerate(parts):
            if size == "+":
                if k != len(parts) - 1:
                    raise ValueError(f"Only the last segment may have any length: {text!r}")
                out.append(Segment(kind, at, None))
            else:
                if int(size) == 0:
                    raise ValueError(f"A segment's length must be 1 or more: {text!r}")
                out.append(Segment(kind, at, int(size)))
                at += int(size)
        return cls(tuple(out))

    @property
    def min_length(self) -> int:
        """Bases that a read must have: fixed lengths, and 1 for an open segment."""
        return sum(1 if s.length is None else s.length for s in self.segments)

    def count(self, kind: str) -> int:
        return sum(s.kind == kind for s in self.segments)

    def __str__(self) -> str:
        return "".join(map(str, self.segments))


def parse_kinds(letters) -> set[str]:
    """Segment kinds to report; duplicates fall together."""
    bad = [c for c in letters if c not in KINDS]
    if bad:
        raise ValueError(f"Error parsing segment types to report: Invalid read segment type: {bad[0]}")
    return set(letters)


def parse_skip_reason(text: str) -> str:
    if text.lower() in ("too few bases", "too-few-bases", "toofewbases"):
        return TOO_FEW_BASES
    raise ValueError(f"Invalid skip reason: {text}")
