"""What the training-data operators share: row keys, Arrow passes over whole
texts, tables in the cluster's shared folder and connected components.

Conventions of every operator in this package
---------------------------------------------
* Input columns are looked up by name; further columns are ignored by the
  digest queries and passed through by the pipeline stages.  Names that an
  operator adds start with ``__sk_`` so they can't clash with input columns.
* A null text counts as the empty text.  A null ``doc_id`` is a value like any
  other: its row is processed and returned.
* Repeated rows are separate rows; each gets its own output row.
* Empty tables give empty results with the same schema.
"""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skein.sources.folders import drop_path, shared_folder

#: Rows turned into Python objects at once in an Arrow pass; bounds a worker's
#: memory to so many texts however large Arrow's batches are.
ROWS_AT_ONCE = 128

#: Largest table, in bytes as ``row_bytes`` counts them, that is broadcast; larger
#: ones are joined by a shuffle.
BROADCAST_BYTES = 24_000_000

#: Parts that the rows of a key are dealt to where a key may hold most rows.
SALTS = 64

_made: list[tuple[SparkSession, str]] = []


# --------------------------------------------------------------- shared tables
def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver exits."""
    if not _made:
        atexit.register(_drop_made)
    path = f"{shared_folder(spark)}/skein-{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _drop_made() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # the session is gone already; nothing left to tidy with
            return


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.  That cuts
    the lineage: lost executors cost a reread, not the work before."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def forget(df: DataFrame) -> None:
    """Drops the table that ``df`` was ``stored`` as: its successor stands."""
    path = getattr(df, "_skein_path", None)
    if path:
        drop_path(df.sparkSession, path)
        _made.remove((df.sparkSession, path))


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row whose columns are numbers; frames with strings or arrays
    are measured by their callers."""
    wide = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    if wide:
        raise ValueError(f"the width of {', '.join(wide)} is not known beforehand")
    return 8 * len(df.columns)


def small_or_shuffled(df: DataFrame, rows: int, width: float | None = None) -> DataFrame:
    """``df`` marked for broadcast if its counted rows, ``width`` bytes each, allow
    it; else for a join that shuffles: by the size of a compressed table Spark would
    broadcast what is many times as large in memory."""
    return F.broadcast(df) if rows * (row_bytes(df) if width is None else width) <= BROADCAST_BYTES else df.hint("merge")


def beside_group(df: DataFrame, key: list[str], salt: Column, partial: list[Column], final: list[Column]) -> DataFrame:
    """``df`` (a stored table) with aggregates over each ``key``'s rows beside it.

    ``partial`` makes aggregates of a part of a key's rows and ``final`` puts those
    together under the names that are added.  A key that holds most rows is one task
    neither in the sums (each part's row is made before the shuffle) nor in the join,
    which goes by key and part."""
    salted = df.withColumn("__sk_salt", F.pmod(salt, F.lit(SALTS)))
    parts = salted.groupBy(*key, "__sk_salt").agg(*partial)
    whole = parts.groupBy(*key).agg(*final)
    told = parts.select(*key, "__sk_salt").join(whole, key)  # SALTS rows a key at most
    return salted.join(told, [*key, "__sk_salt"]).drop("__sk_salt")


# -------------------------------------------------------------------- row keys
def row_keys(*cols: str | Column) -> list[Column]:
    """Two independent 64-bit hashes of the given columns (nulls included)."""
    marked: list[Column] = []
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        marked += [c.isNull(), c]
    return [
        F.xxhash64(*marked).alias("__sk_k1"),
        F.xxhash64(F.lit(11), *reversed(marked)).alias("__sk_k2"),
    ]


# ---------------------------------------------------------------- Arrow passes
def arrow_schema(ddl: str) -> tuple[T.StructType, pa.Schema]:
    struct = T._parse_datatype_string(ddl)
    return struct, to_arrow_schema(struct)


def rows_of(batches: Iterable[pa.RecordBatch], size: int = ROWS_AT_ONCE) -> Iterator[list[tuple]]:
    """Lists of at most ``size`` rows as tuples, in order."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield list(zip(*(c.to_pylist() for c in part.columns), strict=True))


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], ddl: str) -> DataFrame:
    """One output row for each input row, by a Python function over Arrow
    batches.  ``make`` runs once in each task and returns the function."""
    struct, schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for rows in rows_of(batches):
            out = list(zip(*(f(*r) for r in rows), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(out, schema, strict=True)], schema=schema)

    return df.mapInArrow(run, struct)


def append_columns(df: DataFrame, inputs: list[str], make: Callable[[], Callable[..., tuple]], ddl: str) -> DataFrame:
    """``df`` with more columns, computed in Python from ``inputs``; all other
    columns go through as Arrow buffers.  New names must start with ``__sk_``."""
    extra, schema = arrow_schema(ddl)
    struct = T.StructType(df.schema.fields + extra.fields)
    at = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                out = list(zip(*(f(*r) for r in zip(*(part.column(i).to_pylist() for i in at), strict=True)), strict=True))
                new = [pa.array(c, x.type) for c, x in zip(out, schema, strict=True)]
                yield pa.RecordBatch.from_arrays(part.columns + new, names=part.schema.names + schema.names)

    return df.mapInArrow(run, struct)


def shielded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose input may have columns named like the stage's own: they go
    under other names meanwhile."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        if not any(c.lower().startswith("__sk_") for c in names):
            return stage(spark, docs, sf_dir)
        taken, aside = {c.lower() for c in names}, []
        for k, c in enumerate(names):
            if c.lower().startswith("__sk_"):
                c = f"input_{k}_{c[5:]}"
                while c.lower() in taken:
                    c += "_"
                taken.add(c.lower())
            aside.append(c)
        return stage(spark, docs.toDF(*aside), sf_dir).toDF(*names)

    return run


# ------------------------------------------------------------------- documents
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: The white space of the contracts: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^ \t-\r]+")


# -------------------------------------------------------- connected components
def components(edges: DataFrame, label: str = "cc", most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: bigint).

    Returns (node, root) for every node that has an edge to another; ``root`` is
    the smallest node of its component.  Alternates large-star and small-star
    contraction, so the rounds grow with the logarithm of the largest component
    rather than its diameter.  All state stays in shared tables; the driver sees
    one checksum a round.  A star's centre may hold most edges, so minima come by
    ``beside_group``.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-0"
    )

    def checksum(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = checksum(now)
    for k in range(1, most_rounds + 1):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = beside_group(both, ["u"], F.xxhash64("v"), [F.min("v").alias("m")], [F.least("u", F.min("m")).alias("m")])
        large = low.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), f"{label}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = beside_group(large, ["u"], F.xxhash64("v"), [F.min("v").alias("m")], [F.min("m").alias("m")])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = stored(small.union(least.select("u", "m")).distinct(), f"{label}-{k}")
        sums = checksum(nxt)
        forget(now)
        forget(large)
        if sums == seen:
            roots = nxt.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(nxt.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen, now = sums, nxt
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def query_registry(*modules) -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """QUERIES and ORACLE_SQL of the given modules, merged."""
    queries: dict = {}
    sql: dict = {}
    for m in modules:
        queries |= m.QUERIES
        sql |= getattr(m, "ORACLE_SQL", {})
    return queries, sql
