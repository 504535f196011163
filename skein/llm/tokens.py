"""Operator 10: token ids in Arrow files of fixed-size lists.

Documents are range-partitioned by id and sorted; each partition encodes its
texts, appends the end id to each and packs the ids, without gaps, into rows of
equal length: record batches of a fixed-size list of ids and one of the mask
(1 valid, 0 padding at the shard's end).  A file is an Arrow stream with the file
format's footer; its buffers are not compressed and its batches (but the last)
have equal rows, so a memory-mapped file gives any sequence and its mask without
a search or a copy.  A second small file lists the shard's documents.  Shards follow
each other in doc_id order; ids before a shard are the sum of the valid ids of those
before it.  Their number follows the texts' bytes (``SHARD_BYTES`` each).

Encoding: the tokenizer's split pattern never joins characters across ASCII
white space and its normalizer works within a word or on white space only, so a
text's ids are those of its words in turn.  Words are encoded by the tokenizers
library and kept in a dictionary of bounded size that a worker process shares among
its tasks; words of plain letters go straight to the library's model.  ``by_words``
checks the tokenizer for this form; others are encoded text by text.

A task's files carry its attempt in their names and are never renamed: the table of
shards, written by Spark, names the files of the attempts that count, and what lost
attempts left is deleted when that table stands.  Files go to ``spark.checkpoint.dir``
through pyarrow's file systems (local, HDFS, S3, GCS by URI).  A task holds one batch
of sequences and of the list of documents, however large the shard.

Defined results: null texts are empty and give the end id alone; null doc_ids
come first; rows with the same doc_id stand beside each other, ordered by a hash of
the text and then the text, and may be in several shards.  Very long texts are encoded
whole.  An empty table gives no rows.  Ids are stored as 16-bit where the vocabulary
allows it.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_path, new_path, rows_of, stored

LENGTH, END_ID, WORDS_KEPT = 2048, 1, 400_000
#: Sequences in a record batch, and documents in one of the list.
BATCH, LISTED = 256, 4096
#: Bytes of text in a shard, and in those of a table that gives no more than
#: ``spark.sql.shuffle.partitions`` of them.
SHARD_BYTES, LEAST_BYTES = 1 << 27, 1 << 23


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def by_words(path: str) -> bool:
    """Whether texts may be encoded word by word: the split pattern matches no
    white space and keeps matches only, and the normalizer's steps are NFC, white
    space folding and lower-casing."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    steps = (spec.get("normalizer") or {}).get("normalizers", [{}])
    folds = all(s.get("type") in ("NFC", "Lowercase") or s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)
    own = all(not (t["lstrip"] or t["rstrip"]) and not any(map(str.isspace, t["content"])) for t in spec.get("added_tokens", []))
    pattern = split.get("pattern", {}).get("Regex", "")
    return folds and own and split.get("invert") and split.get("behavior") == "Removed" and pattern.endswith("[^\\s\\p{L}\\p{N}]+") and "\\s*" not in pattern and " " not in pattern and "post_processor" in spec and not spec["post_processor"]


#: Letters that are lower case, stay as they are under NFC and lower-casing, and
#: form one piece of the split pattern; then what may follow as the next piece: ASCII
#: punctuation but the apostrophe, with which contractions start.
_PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")


class _Words(dict):
    """Ids of words, filled as they come; once full, others are encoded anew."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: bytes) -> bytes:
        ids = self.encode(word)
        if len(self) < self.most:
            self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts, as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, words_kept: int = WORDS_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]  # native order: little-endian wherever Spark runs on x86 or ARM
        self.tokenize = self.tokenizer.model.tokenize
        self.words = by_words(path)
        self.kept, self.tails = _Words(self._word, words_kept), _Words(self._tail, 4096)
        self.tails[""] = b""
        if self.words:  # the byte-level form of each letter, as the pre-tokenizer has it
            letters = [chr(c) for c in (*range(97, 123), *range(0xDF, 0x100)) if c != 0xF7]
            self.form = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters})

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _tail(self, text: str) -> bytes:
        return self._encode(text)

    def _word(self, word: bytes) -> bytes:
        """One word.  Plain ones go to the tokenizer's model at once, since its
        normalizer and pre-tokenizer would leave them whole."""
        text = word.decode("utf-8", "surrogatepass")
        m = _PLAIN.fullmatch(text.lower()) if text.isascii() or max(text) <= "\u00ff" else None
        if not m:
            return self._encode(text)
        core, tail = m.groups()
        if tail or core != text:  # the plain form may be known
            return self.kept[core.encode()] + self.tails[tail]
        return array(self.code, [t.id for t in self.tokenize(core if core.isascii() else core.translate(self.form))]).tobytes()

    def ids(self, text: str) -> bytes:
        if not self.words:
            return self._encode(text)
        # ASCII white space, which every \s is
        return b"".join(map(self.kept.__getitem__, text.encode("utf-8", "surrogatepass").split()))


@cache
def encoder(path: str) -> Encoder:
    """A worker's encoder: it serves all tasks that the process runs."""
    return Encoder(path)


# ------------------------------------------------------------------------ files
def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and a path in it for a path as Spark writes it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def shard_schema(length: int, dtype: np.dtype) -> pa.Schema:
    ids = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
    return pa.schema([pa.field("ids", pa.list_(ids, length)), pa.field("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Packs ids into sequences of ``length`` and writes them batch by batch."""

    def __init__(self, sink, length: int, dtype: np.dtype):
        self.length, self.dtype, self.schema = length, dtype, shard_schema(length, dtype)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held, self.n_held, self.n = [], 0, 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n_held += len(ids) // self.dtype.itemsize
        self.n += len(ids) // self.dtype.itemsize
        if self.n_held >= self.length * BATCH:
            self._write(self.n_held // (self.length * BATCH) * BATCH)

    def _write(self, sequences: int) -> None:
        flat = np.frombuffer(b"".join(self.held), self.dtype)
        take = sequences * self.length
        here, rest = flat[:take], flat[take:]
        valid = len(here)
        if valid < take:
            here = np.concatenate([here, np.zeros(take - valid, self.dtype)])
        for at in range(0, sequences, BATCH):
            part = here[at * self.length : (at + BATCH) * self.length]
            mask = np.arange(at * self.length, at * self.length + len(part)) < valid
            self.file.write_batch(pa.record_batch([
                pa.FixedSizeListArray.from_arrays(pa.array(part), self.length),
                pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
            ], schema=self.schema))
        self.held, self.n_held = [rest.tobytes()] if len(rest) else [], len(rest)

    def close(self) -> None:
        if self.n_held:
            self._write(-(-self.n_held // self.length))
        self.file.close()


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def n_shards(docs: DataFrame) -> int:
    n = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    few = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-n // SHARD_BYTES), min(few, -(-n // LEAST_BYTES)))


SHARDS = "shard bigint, name string, n_tokens bigint, n_docs bigint"


def write_shards(docs: DataFrame, folder: str, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Writes ``docs`` (doc_id, text) and returns a row for each shard: shard, name,
    n_tokens, n_docs, in doc_id order of shard numbers."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]  # a hash, since one id may stand at any number of rows
    ordered = texts.repartitionByRange(n_shards(texts), *order[:2]).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{TaskContext.get().taskAttemptId()}"
        fs, root = open_fs(folder)
        writer, listed, n_docs = None, [], 0

        def list_documents():
            index.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*listed, strict=True)], schema=INDEX))
            listed.clear()

        for rows in rows_of(batches):
            if writer is None:
                enc = encoder(path)
                fs.create_dir(root, recursive=True)
                data, docs_file = (fs.open_output_stream(f"{root}/{name}.{kind}") for kind in ("arrows", "docs"))
                writer, index = ShardWriter(data, length, enc.dtype), pa.ipc.new_stream(docs_file, INDEX)
                end = np.array([end_id], enc.dtype).tobytes()
            for doc_id, text in rows:
                ids = enc.ids(text) + end
                listed.append((doc_id, writer.n, len(ids) // enc.dtype.itemsize))
                n_docs += 1
                writer.add(ids)
            if len(listed) >= LISTED:
                list_documents()
        if writer is not None:
            if listed:
                list_documents()
            writer.close()
            index.close()
            data.close()
            docs_file.close()
            yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([name]), pa.array([writer.n], pa.int64()), pa.array([n_docs], pa.int64())], names=["shard", "name", "n_tokens", "n_docs"])

    shards = stored(ordered.mapInArrow(run, SHARDS), "shards")
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    counted = {r["name"] for r in shards.select("name").collect()}  # a row for each file
    for info in fs.get_file_info(pafs.FileSelector(root)):
        if info.base_name.rpartition(".")[0] not in counted and info.base_name.startswith("shard-"):
            fs.delete_file(info.path)
    return shards


class Shard:
    """A shard opened for random access; local files are memory-mapped."""

    def __init__(self, folder: str, name: str):
        fs, root = open_fs(folder)
        name = f"{root}/{name}"
        local = isinstance(fs, pafs.LocalFileSystem)
        self.source = pa.memory_map(f"{name}.arrows") if local else fs.open_input_file(f"{name}.arrows")
        self.file = pa.ipc.open_file(self.source)
        with fs.open_input_stream(f"{name}.docs") as f:
            self.docs = pa.ipc.open_stream(f).read_all()
        self.length = self.file.schema.field("ids").type.list_size
        self.opened: tuple[int, pa.RecordBatch | None] = (-1, None)

    def batch(self, k: int) -> pa.RecordBatch:
        if self.opened[0] != k:
            self.opened = (k, self.file.get_batch(k))
        return self.opened[1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view into the file) and mask of the i-th sequence."""
        batch, row = self.batch(i // BATCH), i % BATCH
        ids = batch.column(0).flatten().slice(row * self.length, self.length)
        return ids.to_numpy(zero_copy_only=True), batch.column(1).flatten().slice(row * self.length, self.length)

    def n_valid(self) -> int:
        return sum(self.batch(k).column(1).flatten().true_count for k in range(self.file.num_record_batches))

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids from ``start`` on; a view where they lie in one batch."""
        parts, span = [], self.length * BATCH
        while n > 0:
            flat = self.batch(start // span).column(0).flatten().to_numpy(zero_copy_only=True)
            parts.append(flat[start % span : start % span + n])
            start += len(parts[-1])
            n -= len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_documents(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    rows = sorted(shards.collect())  # a row for each file
    before, table = 0, []
    for r in rows:
        table.append((r["name"], before, r["n_tokens"]))
        before += r["n_tokens"]
    ddl = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not table:
        return spark.createDataFrame([], ddl)
    todo = spark.createDataFrame(table, "shard string, before bigint, n bigint").repartition(len(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = Shard(folder, shard)
                if s.n_valid() != n:
                    raise OSError(f"shard {shard} of {folder} has {s.n_valid()} ids; {n} were written")
                for part in s.docs.to_batches(max_chunksize=4096):
                    ids, at, size = (c.to_pylist() for c in part.columns)
                    crc = [zlib.crc32(s.ids(a, k).astype("<u4").tobytes()) for a, k in zip(at, size, strict=True)]
                    yield pa.record_batch(
                        [pa.array(ids, pa.int64()), pa.array([a + start for a in at], pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return todo.mapInArrow(run, ddl)


def encode_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, keep: str | None = None) -> DataFrame:
    """Writes the files (to ``keep``, if given, where they stay) and returns what
    ``read_documents`` reads from them."""
    spark = docs.sparkSession
    folder = keep or new_path(spark, "tokens")
    shards = write_shards(docs, folder, path or tokenizer_path(), length, end_id)
    out = read_documents(spark, folder, shards)
    if keep:
        return out
    out = stored(out, "tokens-read")
    drop_path(spark, folder)
    return out


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))


QUERIES = {"op10_tokens": op10_tokens}
