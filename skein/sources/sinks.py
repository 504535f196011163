"""FASTQ files with exact names, block-gzip compressed, in record order.

Rows (target, ord, record) are dealt by target and chunk (a range of ``ord``), so
that a sample with most of the reads is compressed by many tasks.  Rows that stand in
ranges of ``ord`` already are not dealt: each range becomes a part of every target in it.
A row may hold the records of several files, a column each.  A task writes
each part to a name of its own attempt; the commit writes a manifest of the parts of
the attempts that count, in record order, with their sizes and records; an abort removes
what was written.

``finish`` then makes the files.  A target of one part is a rename.  The parts of a larger
one are put together without a task that reads them all: by the store's own concatenation
where it has one, on a file system by tasks that each write a part at its place, which the
sizes before it tell.  Only a store with neither has a task copy a target.  A run that was
interrupted is completed by ``finish`` from its manifest: parts go only after their file
stands, so each step can be done again.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from skein.sources.fastq import open_store

#: Fixed values of the block-gzip format: input bytes of a block, and the empty
#: block that ends a file.
BLOCK_BYTES = 65280
COPY_BYTES, CHUNK_RECORDS = 1 << 22, 400_000
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bgzf_block(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15, zlib.DEF_MEM_LEVEL + 1)  # the most memory: faster, and the same format
    body = z.compress(data) + z.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class BgzfWriter:
    def __init__(self, sink, level: int = 5):
        self.sink, self.level, self.held = sink, min(level, 9), bytearray()

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= BLOCK_BYTES:
            self.sink.write(bgzf_block(bytes(self.held[:BLOCK_BYTES]), self.level))
            del self.held[:BLOCK_BYTES]

    def close(self) -> None:
        if self.held:
            self.sink.write(bgzf_block(bytes(self.held), self.level))
        self.sink.write(END_BLOCK)
        self.sink.close()


def runs(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[tuple[str, int], int, int, list[bytes], int]]:
    """(target, chunk), the first and last ``ord``, the bytes of each column's records and
    their number for each run of equal ones.  The records of a run lie together in the batch's
    buffers and are taken as they are, or a byte for each character where some are beyond ASCII."""
    target, chunk, place = batch.column("target"), batch.column("chunk"), batch.column("ord").to_numpy()
    records = [batch.column(c).cast(pa.large_string()) for c in columns]
    n = batch.num_rows
    same = lambda c: pc.equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, ~(same(target) & same(chunk))]) if n else []
    offsets = [np.frombuffer(r.buffers()[1], np.int64)[r.offset : r.offset + n + 1] if n else [] for r in records]
    whole = [memoryview(r.buffers()[2] or b"") for r in records]
    for a, b in zip(starts, [*starts[1:], n], strict=True):
        data = [bytes(w[at[a] : at[b]]) for w, at in zip(whole, offsets, strict=True)]
        yield (target[int(a)].as_py(), chunk[int(a)].as_py()), int(place[a]), int(place[b - 1]), [d if d.isascii() else d.decode().encode("latin-1") for d in data], int(b - a)


@dataclass
class Written(WriterCommitMessage):
    files: list[list]  # target, first and last place, temporary name, records


class FastqWriter(DataSourceArrowWriter):
    """``files``: what stands behind the target in the name of each column's file."""

    def __init__(self, folder: str, run: str, level: int, files: dict[str, str]):
        self.folder, self.run, self.level, self.files = folder.rstrip("/"), run, level, files

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Batches of target, chunk, ord and records; equal targets and chunks stand together,
        in record order."""
        context = TaskContext.get()
        tag = f"{context.partitionId()}-{context.taskAttemptId()}"
        fs, root = open_store(self.folder)
        now, out, parts, files = None, [], [], []
        for batch in iterator:
            for (target, chunk), first, last, data, n in runs(batch, list(self.files)):
                if (target, chunk) != now:
                    for o in out:
                        o.close()
                    now = (target, chunk)
                    parts = [[name := target + behind, first, last, f".{name}.{chunk}.{self.run}.{tag}", 0] for behind in self.files.values()]
                    files += parts
                    out = [BgzfWriter(fs.open_output_stream(f"{root}/{p[3]}", compression=None), self.level) for p in parts]
                for o, part, text in zip(out, parts, data, strict=True):
                    o.write(text)
                    part[2], part[4] = last, part[4] + n
        for o in out:
            o.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = open_store(self.folder)
        parts: dict[str, list[list]] = defaultdict(list)
        for m in messages:
            for target, *part in m.files if m else []:
                parts[target].append(part)
        for target, its in parts.items():
            its.sort()
            for before, part in zip(its, its[1:]):
                if part[0] <= before[1]:
                    raise RuntimeError(f"two parts of {target} have record {part[0]} or stand around it")
        ordered = {t: [[temp, fs.get_file_info(f"{root}/{temp}").size, n] for _, _, temp, n in its] for t, its in parts.items()}
        with fs.open_output_stream(f"{root}/{manifest_name(self.run)}", compression=None) as f:
            f.write(json.dumps(ordered).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = open_store(self.folder)
        for m in messages:
            for *_, temp, _ in m.files if m else []:
                fs.delete_file(f"{root}/{temp}")


class FastqSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq_sink"

    def writer(self, schema, overwrite: bool) -> FastqWriter:
        o = self.options
        return FastqWriter(o["folder"], o["run"], int(o["level"]), json.loads(o["files"]))


def manifest_name(run: str) -> str:
    return f".skein-{run}.manifest"


def manifest(folder: str, run: str) -> dict[str, list[list]]:
    """target: its parts' names, sizes and records, in order."""
    fs, root = open_store(folder)
    with fs.open_input_stream(f"{root}/{manifest_name(run)}", compression=None) as f:
        return json.loads(f.read())


def _there(fs: pafs.FileSystem, names: list[str]) -> list[bool]:
    return [i.type == pafs.FileType.File for i in fs.get_file_info(names)] if names else []


def _copy(fs: pafs.FileSystem, source: str, out, left: int) -> None:
    with fs.open_input_stream(source, compression=None) as part:
        while left > 0 and (data := part.read(min(COPY_BYTES, left))):
            out.write(data)
            left -= len(data)


def concatenated(spark: SparkSession, folder: str, names: list[str]) -> bool:
    """Has the store put the files behind the first one; False if it can't.  The end blocks
    between parts stay, as empty blocks may."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    first = path(f"{folder}/{names[0]}")
    rest = spark.sparkContext._gateway.new_array(path, len(names) - 1)
    for k, n in enumerate(names[1:]):
        rest[k] = path(f"{folder}/{n}")
    try:
        first.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).concat(first, rest)
    except UnsupportedOperationException:
        return False
    return True


def writes_in_place(fs: pafs.FileSystem) -> bool:
    return isinstance(fs, pafs.LocalFileSystem)


#: What a task of ``placed`` does: target, part, its place and bytes, the whole file's bytes.
PLACES = "target string, part string, at bigint, n bigint, last boolean"


def placed(spark: SparkSession, folder: str, todo: dict[str, list[list]]) -> list[tuple[str, str, int]]:
    """Writes every part at its place in ``.target.whole``, a task each; target, part and
    the task's number, for each part."""
    fs, root = open_store(folder)
    rows = []
    for target, parts in todo.items():
        at = 0
        for temp, size, _ in parts:
            rows.append((target, temp, at, size - len(END_BLOCK), temp == parts[-1][0]))
            at += size - len(END_BLOCK)
        with open(f"{root}/.{target}.whole", "wb") as f:
            f.truncate(at + len(END_BLOCK))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at_root = open_store(folder)
        for batch in batches:
            for target, part, at, n, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(f"{at_root}/.{target}.whole", "r+b") as out:
                    out.seek(at)
                    _copy(store, f"{at_root}/{part}", out, n)
                    if last:
                        out.write(END_BLOCK)
            task = pa.array([TaskContext.get().partitionId()] * batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), task], names=["target", "part", "task"])

    asked = spark.createDataFrame(rows, PLACES).repartition(len(rows))
    return [tuple(r) for r in asked.mapInArrow(write, "target string, part string, task bigint").collect()]  # names of parts


def copied(spark: SparkSession, folder: str, todo: dict[str, list[list]]) -> None:
    """For stores that neither concatenate nor write at a place: a task a target."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        for batch in batches:
            for target, parts, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                temp = f"{root}/.{target}.whole-{TaskContext.get().taskAttemptId()}"
                with fs.open_output_stream(temp, compression=None) as out:
                    for part, size in zip(parts, sizes, strict=True):
                        _copy(fs, f"{root}/{part}", out, size - len(END_BLOCK))
                    out.write(END_BLOCK)
                fs.move(temp, f"{root}/.{target}.whole")
            yield batch.select([0])

    rows = [(t, [p[0] for p in parts], [p[1] for p in parts]) for t, parts in todo.items()]
    asked = spark.createDataFrame(rows, "target string, parts array<string>, sizes array<bigint>").repartition(len(rows))
    asked.mapInArrow(write, "target string").write.format("noop").mode("overwrite").save()


def finish(spark: SparkSession, folder: str, run: str, targets: list[str]) -> dict[str, int]:
    """Makes the files of a committed run, and the empty ones of targets without records;
    the records of each.  May be done again where it was interrupted."""
    folder = folder.rstrip("/")
    fs, root = open_store(folder)
    parts = manifest(folder, run)
    todo: dict[str, list[list]] = {}
    local = writes_in_place(fs)
    for target, its in parts.items():
        there = _there(fs, [f"{root}/{p[0]}" for p in its])
        if len(its) == 1 and there[0]:
            fs.move(f"{root}/{its[0][0]}", f"{root}/{target}")
        elif all(there) and (local or not concatenated(spark, folder, [p[0] for p in its])):
            todo[target] = its
        elif there[0] and (all(there) or not any(there[1:])):  # concatenated: the first part holds all
            fs.move(f"{root}/{its[0][0]}", f"{root}/{target}")
    if todo:
        if local:
            placed(spark, folder, todo)
        else:
            copied(spark, folder, todo)
    for target in todo:
        fs.move(f"{root}/.{target}.whole", f"{root}/{target}")
    for target, its in parts.items():
        names = [f"{root}/{p[0]}" for p in its]
        for name, there in zip(names, _there(fs, names), strict=True):  # without the first one a target stands already
            if there:
                fs.delete_file(name)
    for target in targets:
        if target not in parts:
            BgzfWriter(fs.open_output_stream(f"{root}/{target}", compression=None)).close()
    fs.delete_file(f"{root}/{manifest_name(run)}")
    return {t: sum(p[2] for p in parts.get(t, [])) for t in targets}


def discard(folder: str, run: str) -> None:
    """Removes what a committed run has written, before ``finish``."""
    fs, root = open_store(folder)
    for its in manifest(folder, run).values():
        for name, *_ in its:
            fs.delete_file(f"{root}/{name}")
    fs.delete_file(f"{root}/{manifest_name(run)}")


def ranges_in(table: DataFrame) -> Column:
    """Numbers of the ranges in which a stored table's rows stand, if the tasks that wrote it
    had a range each: a scan's task may read several of them."""
    return F.xxhash64(table["_metadata.file_path"], table["_metadata.file_block_start"])


def write_fastq(
    records: DataFrame, folder: str, targets: list[str], level: int = 5, chunk_records: int = CHUNK_RECORDS, check: Callable[[], None] | None = None, in_order: bool | str = False,
    files: dict[str, str] | None = None, is_sorted: bool = False,
) -> dict[str, int]:
    """Writes ``records`` (target, ord, record) to ``folder``, a file a target, and returns
    the records of each.  ``in_order``: partitions are ranges of ``ord`` and each becomes a
    part, without a shuffle; or the name of a column that tells the ranges of a partition.
    ``is_sorted``: within partitions rows stand by target, range and ``ord`` already.
    ``files``: columns that have a record each instead of ``record``, and what stands behind
    the target in the names of their files.  ``check`` may fail the run before any file has
    its name."""
    spark, run = records.sparkSession, uuid.uuid4().hex[:12]
    files = files or {"record": ""}
    spark.dataSource.register(FastqSink)
    if in_order:
        dealt = records.withColumn("chunk", F.col(in_order) if isinstance(in_order, str) else F.spark_partition_id().cast("bigint"))
    else:
        dealt = records.withColumn("chunk", F.expr(f"ord div {max(1, chunk_records // len(files))}")).repartition("target", "chunk")
    dealt = dealt if is_sorted else dealt.sortWithinPartitions("target", "chunk", "ord")
    dealt.select("target", "chunk", "ord", *files).write.format("fastq_sink").options(folder=folder, run=run, level=level, files=json.dumps(files)).mode("append").save()
    if check:
        try:
            check()
        except Exception:
            discard(folder, run)
            raise
    return finish(spark, folder, run, targets)


def record_text(header, seq, qual, plus="+", ends=None):
    """The four lines of a record.  ``ends``: which of them end with a carriage return,
    as the source has it."""
    plus = F.lit(plus) if isinstance(plus, str) else plus
    lines = []
    for k, line in enumerate((header, seq, plus, qual)):
        lines += [line, F.lit("\n") if ends is None else F.when(ends.bitwiseAND(1 << k) != 0, F.lit("\r\n")).otherwise(F.lit("\n"))]
    return F.concat(*lines)
