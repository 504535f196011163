"""FASTQ files that belong together, read side by side: a row is one record of each.

A partition is a range of record positions over all files.  The counted splits of a file
say how many lines stand before each, so a task opens every file at the last split before
its first record, skips lines to it and hands on whole sets; nothing is shuffled.  Ranges
begin where the splits of the file with most of them do; the last one has no end, so
that files of different lengths show it: columns of a file without a record there are null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skein.sources.fastq import READ_BYTES, ROWS_AT_ONCE, SPLIT_BYTES, Split, _Stream, cut, open_text, parsed, splits_of, text_from

#: A record's columns, as ``columns`` of the FASTQ source gives them.
FIELDS = ("header", "seq", "qual", "raw_plus", "ends")


def _type(field: str) -> pa.DataType:
    return pa.int32() if field == "ends" else pa.string()


def set_schema(n: int, fields: list[str]) -> str:
    return ", ".join(["ord bigint", *(f"{f}{k} {'int' if f == 'ends' else 'string'}" for k in range(n) for f in fields)])


@dataclass
class Range:
    """``n`` records from position ``first`` on (-1: all), and for each file its path, its
    kind, the byte to start at and the line ends to skip from there."""

    first: int
    n: int
    files: list[tuple[str, str, int, int]]


class _Records:
    """A stream's records, any number at a time."""

    def __init__(self, blocks: Iterator[list[pa.Array]]):
        self.blocks, self.held = blocks, [pa.array([], _type(f)) for f in FIELDS]

    def take(self, n: int) -> list[pa.Array]:
        while len(self.held[0]) < n and (block := next(self.blocks, None)):
            self.held = [pa.concat_arrays([held, more]) for held, more in zip(self.held, block, strict=True)]
        out = [c.slice(0, n) for c in self.held]
        self.held = [c.slice(n) for c in self.held]
        return out


def _open(file: tuple[str, str, int, int], r: Range) -> _Records:
    path, kind, start, skip = file
    if kind == "whole":
        raw = open_text(path)
        text = iter(lambda: raw.read(READ_BYTES), b"")
    else:
        text = text_from(path, kind, start)
    return _Records(parsed(_Stream(cut(text, skip, 4 * r.n if r.n >= 0 else None)), path, r.first))


class _Part(InputPartition):
    def __init__(self, number: int, range_: Range):
        super().__init__(number)
        self.range = range_


class SetReader(DataSourceReader):
    def __init__(self, ranges: list[Range], fields: list[str]):
        self.ranges, self.fields = ranges, fields

    def partitions(self) -> list[InputPartition]:
        return [_Part(k, r) for k, r in enumerate(self.ranges)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        at, left = part.range.first, part.range.n
        files = [_open(f, part.range) for f in part.range.files]
        places = [FIELDS.index(f) for f in self.fields]
        names = ["ord", *(f"{f}{k}" for k in range(len(files)) for f in self.fields)]
        while left:
            each = [f.take(ROWS_AT_ONCE if left < 0 else min(ROWS_AT_ONCE, left)) for f in files]
            n = max(len(c[0]) for c in each)
            if not n:
                return
            out = [pa.array(np.arange(at, at + n))]
            for cols in each:
                for p, field in zip(places, self.fields, strict=True):
                    short = n - len(cols[p])
                    out.append(pa.concat_arrays([cols[p], pa.nulls(short, _type(field))]) if short else cols[p])
            yield pa.RecordBatch.from_arrays(out, names=names)
            at += n
            left -= n if left > 0 else 0


class SetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq_sets"

    def _ranges(self) -> list[Range]:
        return [Range(first, n, [tuple(f) for f in files]) for first, n, files in json.loads(self.options["ranges"])]

    def schema(self) -> str:
        return set_schema(len(self._ranges()[0].files), json.loads(self.options["fields"]))

    def reader(self, schema) -> SetReader:
        return SetReader(self._ranges(), json.loads(self.options["fields"]))


def _place(splits: list[Split], line: int) -> tuple[str, str, int, int]:
    """Where to open a file for its ``line``: the last split that begins before it."""
    s = next(s for s in reversed(splits) if s.start == 0 or s.before < line)
    return s.path, s.kind, s.start, line - s.before


def ranges_of(splits: list[list[Split]]) -> list[Range]:
    """Ranges over files, each given by its counted splits."""
    most = max(splits, key=len)
    firsts = sorted({0, *(-(-(s.before + 1) // 4) for s in most if s.start)})
    ends = [*firsts[1:], None]
    return [Range(a, -1 if b is None else b - a, [_place(s, 4 * a) for s in splits]) for a, b in zip(firsts, ends, strict=True)]


def read_sets_of(spark: SparkSession, paths: list[str], fields: tuple[str, ...] = FIELDS, split_bytes: int = SPLIT_BYTES) -> DataFrame | None:
    """ord, and ``fields`` of every file with its number behind.  None if a file of more
    than ``split_bytes`` can't be split: each range would have to read it from its start."""
    paths = [str(p) for p in paths]
    splits = splits_of(spark, paths, split_bytes)
    by_file = [[s for s in splits if s.file_idx == k] for k in range(len(paths))]
    if len(paths) > 1 and any(len(s) == 1 and size_of(s[0].path) > split_bytes for s in by_file):
        return None
    spark.dataSource.register(SetSource)
    ranges = json.dumps([[r.first, r.n, r.files] for r in ranges_of(by_file)])
    return spark.read.format("fastq_sets").option("ranges", ranges).option("fields", json.dumps(fields)).load()


def size_of(path: str) -> int:
    from skein.sources.fastq import open_store

    fs, name = open_store(path)
    return fs.get_file_info(name).size
