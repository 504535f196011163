"""FASTQ as a Spark data source.

``spark.read.format("fastq").option("paths", json_list)`` or ``read_fastq``.  Rows come
as Arrow batches of bounded size.  Gzip (also of several members) is told by its first
two bytes.

Record position is the key that relates files, so a task must know how many lines stand
before its first.  ``read_fastq`` splits plain and block-gzip files by bytes, and other
gzip files where one of their members starts (files put one behind the other have many);
it counts the line ends of every split in one job and hands each task its first line.  A
task owns the records whose header line starts behind a line end of its split, and reads
on beyond it until the last of them is whole.  A gzip file of one member is a task.

A member's place is told by its first bytes and by inflating on from there.  That is
proved afterwards: the members counted from one place on must end at the next place, from
the file's start to its end, or the file is taken whole.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: ``ends`` has a bit for each of a record's lines that ends with a carriage return,
#: the header's lowest.
SCHEMA = "file_idx int, ord bigint, header string, seq string, qual string, raw_plus string, ends int"
ROWS_AT_ONCE, BUFFER, READ_BYTES, SPLIT_BYTES = 8192, 1 << 20, 1 << 22, 1 << 27
#: Plain and block-gzip files are split to this share of a core's work, but to no fewer bytes;
#: and to no more splits a file while these are of less than ``SPLIT_BYTES``.
SHARE, LEAST_SPLIT, MOST_SPLITS = 4, 1 << 22, 256
#: Fixed values of the block-gzip format: a block's first bytes up to its size, and the
#: most bytes of one.
BLOCK_HEAD, MOST_BLOCK = re.compile(rb"\x1f\x8b\x08\x04.{6}\x06\x00BC\x02\x00(..)", re.S), 1 << 16
#: Fixed value: how a gzip member begins; chosen: bytes inflated to tell one.
MEMBER_HEAD, TRIED = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]", re.S), 1 << 16
_ARROW = pa.schema([("file_idx", pa.int32()), ("ord", pa.int64()), *((c, pa.string()) for c in ("header", "seq", "qual", "raw_plus")), ("ends", pa.int32())])


class MalformedFastq(ValueError):
    pass


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def open_text(path: str) -> io.BufferedReader:
    fs, name = open_store(path)
    raw = io.BufferedReader(fs.open_input_stream(name, compression=None, buffer_size=BUFFER), BUFFER)
    return gzip.open(raw, "rb") if raw.peek(2)[:2] == b"\x1f\x8b" else raw


def _fail(path: str, record: int, what: str) -> MalformedFastq:
    return MalformedFastq(f"Unexpected error parsing FASTQs: record {record} of {path} {what}")


def text_blocks(stream, path: str = "input", first: int = 0) -> Iterator[bytes]:
    """Text of whole records without its last line end, some thousand records at a time;
    ``first`` is the position of the first."""
    rest, n = b"", first
    while chunk := stream.read(READ_BYTES):
        text = rest + chunk
        whole, more = divmod(text.count(b"\n"), 4)  # the last line may go on
        if not whole:
            rest = text
            continue
        at = len(text)
        for _ in range(more + 1):
            at = text.rindex(b"\n", 0, at)
        n += whole
        rest = text[at + 1 :]
        yield text[:at]
    if rest.strip():
        lines = rest.split(b"\n")
        if len(lines) == 5 and not lines[4]:
            lines.pop()
        if len(lines) != 4:
            blank = not lines[0].strip()
            raise _fail(path, n + 1, "follows a blank line" if blank else "is cut off")
        yield b"\n".join(lines)


def columns(lines: list[bytes], first: int, path: str = "input") -> tuple[list[list], bool]:
    """header (without @), seq, qual, third line and ``ends`` of a block whose first
    record has position ``first``; whether the block ends with blank lines, after which
    nothing may come.  Anything else that isn't FASTQ raises."""
    ended = False
    head, seq, plus, qual = each = [lines[k::4] for k in range(4)]
    ends = [0] * len(qual)
    if any(x.endswith(b"\r") for c in each for x in c):
        ends = [sum(x.endswith(b"\r") << k for k, x in enumerate(r)) for r in zip(*each, strict=True)]
        head, seq, plus, qual = ([x.removesuffix(b"\r") for x in c] for c in each)
    good = [h[:1] == b"@" and p[:1] == b"+" and len(s) == len(q) for h, s, p, q in zip(head, seq, plus, qual, strict=True)]
    if not all(good):
        k = good.index(False)
        if any(x.strip() for x in lines[4 * k :]):
            if head[k][:1] == b"@" and plus[k][:1] == b"+":
                raise _fail(path, first + k + 1, f"has {len(seq[k])} bases and {len(qual[k])} qualities")
            raise _fail(path, first + k + 1, "doesn't start with @ or lacks +")
        ended = True
        head, seq, plus, qual, ends = head[:k], seq[:k], plus[:k], qual[:k], ends[:k]
    return [[h[1:] for h in head], seq, qual, plus, ends], ended


def _text(values: list[bytes]) -> pa.Array:
    """ASCII as it is; else a character for each byte, as the sink writes them."""
    if all(map(bytes.isascii, values)):
        return pa.array(values, pa.binary()).cast(pa.string())
    return pa.array([v.decode("latin-1") for v in values], pa.string())


def plain_columns(text: bytes) -> list[pa.Array] | None:
    """``columns`` of a block by array steps; None where it isn't plain: it has other than
    ASCII, carriage returns, or what may be a mistake."""
    if b"\r" in text or not text.isascii():
        return None
    whole = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(text)], np.int64)), pa.py_buffer(text)])
    lines = pc.split_pattern(whole, "\n").values
    head, seq, plus, qual = (lines.take(pa.array(np.arange(k, len(lines), 4))) for k in range(4))
    good = (pc.starts_with(head, "@"), pc.starts_with(plus, "+"), pc.equal(pc.binary_length(seq), pc.binary_length(qual)))
    if not all(pc.all(g).as_py() for g in good):
        return None
    return [*(c.cast(pa.string()) for c in (pc.utf8_slice_codeunits(head, 1), seq, qual, plus)), pa.array(np.zeros(len(seq), np.int32))]


# ---------------------------------------------------------------------- splits
@dataclass
class Split:
    """Bytes ``start`` to ``end`` of a file (gzip: the blocks or members that start there),
    and the lines: ends before them, ends in them.  ``whole``: the file isn't split."""

    file_idx: int
    path: str
    kind: str = "whole"
    start: int = 0
    end: int = 0
    before: int = 0
    ends: int = 0
    last: bool = True


def block_size(head: bytes) -> int:
    """Bytes of the block that ``head`` begins; 0 where it isn't one."""
    m = BLOCK_HEAD.match(head)
    return int.from_bytes(m.group(1), "little") + 1 if m else 0


def kind_of(path: str) -> tuple[str, int]:
    """How a file can be split, and its bytes."""
    fs, name = open_store(path)
    with fs.open_input_file(name) as f:
        head = f.read(18)
        return "blocks" if block_size(head) else "members" if head[:2] == b"\x1f\x8b" else "plain", f.size()


def next_block(f, at: int) -> int:
    """Where the first block at ``at`` or behind starts; the file's size if none does.  A
    block's place is told by its first bytes and those of the block behind it."""
    size = f.size()
    f.seek(at)
    seen = f.read(2 * MOST_BLOCK + 18)
    for m in BLOCK_HEAD.finditer(seen):
        behind = m.start() + int.from_bytes(m.group(1), "little") + 1
        if at + behind == size or BLOCK_HEAD.match(seen, behind):
            return at + m.start()
    return size


def inflates(f, at: int) -> bool:
    f.seek(at)
    try:
        zlib.decompressobj(31).decompress(f.read(TRIED))
    except zlib.error:
        return False
    return True


def next_member(f, at: int, end: int) -> int:
    """Where the first gzip member from ``at`` on, and before ``end``, seems to start; -1
    if none does."""
    while at < end:
        f.seek(at)
        seen = f.read(min(READ_BYTES, end - at) + 3)
        for m in MEMBER_HEAD.finditer(seen):
            if m.start() < min(READ_BYTES, end - at) and inflates(f, at + m.start()):
                return at + m.start()
        at += READ_BYTES
    return -1


def _plain(f, path: str, at: int, end: int) -> Iterator[bytes]:
    f.seek(at)
    while at < end and (chunk := f.read(min(READ_BYTES, end - at))):
        at += len(chunk)
        yield chunk
    return at


def _blocks(f, path: str, at: int, end: int) -> Iterator[bytes]:
    at = next_block(f, at) if at else 0
    f.seek(at)
    held, k = b"", 0  # of which ``k`` bytes are done
    while at < end:
        if len(held) - k < MOST_BLOCK:  # a block more than the split, so that small ones read little more than theirs
            held, k = held[k:] + f.read(min(READ_BYTES, max(end - at, 0) + MOST_BLOCK)), 0
        n = block_size(held[k : k + 18])
        if not n or len(held) - k < n:
            raise MalformedFastq(f"Unexpected error parsing FASTQs: {path} has no whole block at byte {at}")
        data = zlib.decompress(held[k + 18 : k + n - 8], -15)
        if zlib.crc32(data) != int.from_bytes(held[k + n - 8 : k + n - 4], "little"):
            raise MalformedFastq(f"Unexpected error parsing FASTQs: {path} has a damaged block at byte {at}")
        k += n
        at += n
        yield data
    return at


def _members(f, path: str, at: int, end: int) -> Iterator[bytes]:
    """From a member's start on; the format lets zeros follow a member."""
    while at < end:
        f.seek(at)
        member, place, data = zlib.decompressobj(31), at, b""
        while not member.eof:
            if not (data := member.unconsumed_tail):
                data = f.read(READ_BYTES)
                place += len(data)
            if not data:
                raise MalformedFastq(f"Unexpected error parsing FASTQs: {path} is cut off in the member at byte {at}")
            try:
                text = member.decompress(data, READ_BYTES)
            except zlib.error as e:
                raise MalformedFastq(f"Unexpected error parsing FASTQs: {path} has a damaged member at byte {at}") from e
            if text:
                yield text
        at = place - len(member.unused_data)
        f.seek(at)
        while (zeros := f.read(READ_BYTES)) and not zeros.strip(b"\0"):
            at += len(zeros)
        at += len(zeros) - len(zeros.lstrip(b"\0"))
    return at


_TEXTS = {"plain": _plain, "blocks": _blocks, "members": _members}


def text_from(path: str, kind: str, start: int, end: int | None = None) -> Iterator[bytes]:
    """The text of a splittable file from ``start`` on, to the bytes, blocks or members that
    start before ``end``; returns where it ended."""
    fs, name = open_store(path)
    with fs.open_input_file(name) as f:
        size = f.size()
        return (yield from _TEXTS[kind](f, path, start, size if end is None else min(end, size)))


def line_ends(path: str, kind: str, start: int, end: int) -> tuple[int, int]:
    """Line ends of a split, and where it ended."""
    text, n = text_from(path, kind, start, end), 0
    while True:
        try:
            n += next(text).count(b"\n")
        except StopIteration as e:
            return n, e.value


def cut(text: Iterator[bytes], skip: int, take: int | None) -> Iterator[bytes]:
    """The text behind its first ``skip`` line ends, up to the ``take``-th after them."""

    def behind(data: bytes, n: int) -> int:
        at = 0
        for _ in range(n):
            at = data.index(b"\n", at) + 1
        return at

    for data in text:
        if skip:
            n = data.count(b"\n")
            if n < skip:
                skip -= n
                continue
            data, skip = data[behind(data, skip) :], 0
        if take is not None:
            n = data.count(b"\n")
            if n >= take:
                yield data[: behind(data, take)]
                return
            take -= n
        yield data


class _Stream:
    def __init__(self, text: Iterator[bytes]):
        self.text = text

    def read(self, n: int) -> bytes:
        some, size = [], 0
        for x in self.text:
            some.append(x)
            size += len(x)
            if size >= min(n, BUFFER):
                break
        return b"".join(some)


def records(split: Split) -> tuple[int, object]:
    """Position of the split's first record, and a stream of its text."""
    if split.kind == "whole":
        return 0, open_text(split.path)
    first_line = split.before + 1 if split.start else 0
    first, last = -(-first_line // 4), (split.before + split.ends) // 4
    if first > last and not split.last:
        return first, _Stream(iter(()))
    skip = 4 * first - first_line + (1 if split.start else 0)
    if split.start and split.ends == 0:  # nothing starts here
        return first, _Stream(iter(()))
    take = None if split.last else 4 * (last - first + 1)
    return first, _Stream(cut(text_from(split.path, split.kind, split.start), skip, take))


def parsed(stream, path: str, at: int) -> Iterator[list[pa.Array]]:
    """``columns`` of a stream's records, block by block; ``at``: the first's position."""
    ended = False
    for text in text_blocks(stream, path, at):
        if ended and text.strip():
            raise _fail(path, at + 1, "follows a blank line")
        cols = plain_columns(text)
        if cols is None:
            lists, over = columns(text.split(b"\n"), at, path)
            ended = ended or over
            cols = [*map(_text, lists[:4]), pa.array(lists[4], pa.int32())]
        at += len(cols[0])
        yield cols


class _Part(InputPartition):
    def __init__(self, number: int, split: Split):
        super().__init__(number)
        self.split = split


class FastqReader(DataSourceReader):
    def __init__(self, splits: list[Split]):
        self.splits = splits

    def partitions(self) -> list[InputPartition]:
        return [_Part(k, s) for k, s in enumerate(self.splits)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        path, idx = part.split.path, part.split.file_idx
        at, stream = records(part.split)
        for cols in parsed(stream, path, at):
            for lo in range(0, len(cols[0]), ROWS_AT_ONCE):
                some = [c.slice(lo, ROWS_AT_ONCE) for c in cols]
                n = len(some[0])
                yield pa.record_batch([pa.array([idx] * n, pa.int32()), pa.array(np.arange(at, at + n)), *some], schema=_ARROW)
                at += n


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        if "splits" in self.options:
            return FastqReader([Split(*x) for x in json.loads(self.options["splits"])])
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return FastqReader([Split(k, p) for k, p in enumerate(paths)])


def register(spark: SparkSession) -> None:
    from skein.sources.sinks import FastqSink
    from skein.sources.zipped import SetSource

    for source in (FastqSource, SetSource, FastqSink):
        spark.dataSource.register(source)


def _each(spark: SparkSession, splits: list[Split], ask, columns: list[str]) -> list[list[int]]:
    """What ``ask(path, kind, start, end)`` says of each split (numbers), a task each."""
    if not splits:
        return []
    todo = [(n, s.path, s.kind, s.start, s.end) for n, s in enumerate(splits)]
    ddl = ", ".join(f"{c} bigint" for c in ("n", *columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [(n, *ask(*x)) for n, *x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*said, strict=True)], names=["n", *columns])

    asked = spark.createDataFrame(todo, "n bigint, path string, kind string, start bigint, end bigint").repartition(len(todo))
    return [list(r)[1:] for r in sorted(asked.mapInArrow(run, ddl).collect())]  # numbers for each split


def _member_in(path: str, kind: str, start: int, end: int) -> tuple[int]:
    fs, name = open_store(path)
    with fs.open_input_file(name) as f:
        return (next_member(f, start, end) if start else 0,)


def steps_of(kinds: list[tuple[str, int]], split_bytes: int, cores: int) -> list[int]:
    """Bytes of a split of each file, given by kind and size: ``split_bytes``, or less so that
    all cores have work; more where a file would be cut to more than ``MOST_SPLITS``."""
    share = max(LEAST_SPLIT, sum(size for _, size in kinds) // (SHARE * cores))
    if any(kind == "members" for kind, _ in kinds):  # one that can't be split would be read from its start by each range
        share = split_bytes
    return [max(min(split_bytes, share), min(SPLIT_BYTES, -(-size // MOST_SPLITS))) for _, size in kinds]


def splits_of(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> list[Split]:
    """A split for each task, in the files' order.  Files of more than one are counted
    first, in a job whose result is numbers for each split."""
    wanted: list[Split] = []
    kinds = [kind_of(p) for p in paths]
    for k, (p, (kind, size), step) in enumerate(zip(paths, kinds, steps_of(kinds, split_bytes, spark.sparkContext.defaultParallelism), strict=True)):
        if size <= step:
            wanted.append(Split(k, p))
        else:
            wanted += [Split(k, p, kind, a, min(a + step, size), last=a + step >= size) for a in range(0, size, step)]
    members = [s for s in wanted if s.kind == "members"]
    for s, (place,) in zip(members, _each(spark, members, _member_in, ["place"]), strict=True):
        s.start = place
    by_file: dict[int, list[Split]] = defaultdict(list)
    for s in wanted:
        if s.start >= 0:
            by_file[s.file_idx].append(s)
    for some in by_file.values():
        if some[0].kind == "members":
            size = max(s.end for s in members if s.file_idx == some[0].file_idx)
            for s, end in zip(some, [*(x.start for x in some[1:]), size], strict=True):
                s.end, s.last = end, end == size
            if len(some) == 1:
                some[:] = [Split(some[0].file_idx, some[0].path)]
    counted = [s for some in by_file.values() for s in some if s.kind != "whole"]
    stops: dict[int, int] = {}
    for s, (ends, stop) in zip(counted, _each(spark, counted, _ends_or_damage, ["ends", "stop"]), strict=True):
        s.ends, stops[id(s)] = ends, stop
    for some in by_file.values():
        if some[0].kind == "members" and any(stops[id(s)] != s.end for s in some):
            some[:] = [Split(some[0].file_idx, some[0].path)]  # a place was no member's, or one is damaged
        before = 0
        for s in some:
            s.before, before = before, before + s.ends
    return [s for k in sorted(by_file) for s in by_file[k]]


def _ends_or_damage(path: str, kind: str, start: int, end: int) -> tuple[int, int]:
    try:
        return line_ends(path, kind, start, end)
    except MalformedFastq:
        if kind != "members":
            raise
        return 0, -1  # read from the start, the file itself tells


def read_fastq(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All files' records, told apart by ``file_idx``."""
    spark.dataSource.register(FastqSource)
    splits = splits_of(spark, [str(p) for p in paths], split_bytes)
    return spark.read.format("fastq").option("splits", json.dumps([list(vars(s).values()) for s in splits])).load()


def stage(spark: SparkSession, paths: list[str], folder: str) -> list[DataFrame]:
    """The files as Parquet: a FASTQ file is decompressed once, however often its records
    are used, and later scans split and prune columns.  One job reads the splits of all
    files; a file's own rows are told by statistics of the Parquet files."""
    read_fastq(spark, paths).write.mode("overwrite").parquet(folder)
    both = spark.read.schema(SCHEMA).parquet(folder)
    return [both.where(both["file_idx"] == k).drop("file_idx") for k in range(len(paths))]
