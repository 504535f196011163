"""Operator 1: benchmark decontamination, DataFrame functions only.

Finds short test items inside long documents: an item is in a document if at
least ``threshold`` (0.8) of its distinct five-word shingles are.

Search: by size partitions.  An item of n shingles that needs ceil(0.8 n) of them
can miss at most n - ceil(0.8 n), so one of any n - ceil(0.8 n) + 1 of its shingles
must be in the document.  Its MinHash sketch is those with the smallest hashes (a
bottom-m sketch, m set by the item's size).  Items are kept in partitions by
powers of two of their size: a document with fewer shingles than a partition's
least need can't hold its items, and the largest sketch hash is a bound that drops
most of a document's shingles before any join.  Containment search with these
sketches misses nothing.

Verification: for documents with a sketch hit, the shingle strings themselves are
matched to the items' and counted.

Scale: documents' shingles never shuffle while the sketches are of a size that is
broadcast (counted first); then only hits do.  Each document is read once for the
search and, if it has a hit, once more for verification, whose rows are its shingles
that items have: they are as many as the answer is wide.

Words are runs of letters and digits after lower-casing, so that neither
punctuation nor case hides an item.

Defined results: a null or empty text holds no item.  An item of one to four words
has one shingle, itself, and is searched as such; an item without words is in no
document.  Repeated rows of either table give a row each; null ids are returned as
they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, row_keys, shielded, small_or_shuffled, stored

SHINGLE, THRESHOLD = 5, 0.8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _starts(w: str, k: int) -> str:
    return f"if(size({w}) >= {k}, sequence(0, size({w}) - {k}), array())"


def shingle_hashes(w: str, k: int) -> Column:
    """64-bit hashes of the k-word shingles of array column ``w``, in order."""
    parts = ", ".join(f"{w}[i + {j}]" for j in range(k))
    return F.expr(f"transform({_starts(w, k)}, i -> xxhash64({k}, {parts}))")


def shingles(w: str, k: int) -> Column:
    return F.expr(f"array_distinct(transform({_starts(w, k)}, i -> array_join(slice({w}, i + 1, {k}), ' ')))")


def _with_length(found: Column, k: int) -> Column:
    return F.transform(found, lambda s: F.struct(F.lit(k).alias("k"), s.alias("s")))


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, item (a number of the row), k, n, need, part, least (the smallest
    need of the size partition), sketch, shingles."""
    one = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("item", F.monotonically_increasing_id())
    one = one.withColumn("k", F.least(F.size("w"), F.lit(SHINGLE)))
    sh, hs = F.lit(None).cast("array<string>"), F.lit(None).cast("array<bigint>")
    for k in range(1, SHINGLE + 1):
        sh = F.when(F.col("k") == k, shingles("w", k)).otherwise(sh)
        hs = F.when(F.col("k") == k, F.array_sort(F.array_distinct(shingle_hashes("w", k)))).otherwise(hs)
    one = one.withColumns({"shingles": sh, "hashes": hs})
    n = F.size("shingles")
    need = F.ceil(F.lit(threshold) * n - 1e-9).cast("int")
    part = F.floor(F.log2(n.cast("double"))).cast("int")
    least = F.ceil(F.lit(threshold) * F.pow(F.lit(2.0), part) - 1e-9).cast("int")
    made = one.select("item_id", "item", "k", n.alias("n"), need.alias("need"), part.alias("part"), least.alias("least"), "hashes", "shingles")
    return made.withColumn("sketch", F.slice("hashes", 1, F.col("n") - F.col("need") + 1)).drop("hashes")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment and the row keys
    __sk_k1, __sk_k2 for every row of ``docs`` that holds a row of ``items``."""
    known = stored(sketches(items, threshold), "sketches")
    hashes = known.select("item", "k", "least", F.explode("sketch").alias("h"))
    n_hashes = hashes.count()
    top = hashes.agg(F.max("h")).first()[0]
    lengths = sorted(r["k"] for r in known.select("k").distinct().collect()) or [SHINGLE]  # 1 to 5
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *row_keys("doc_id", "text"))
    split = keyed.select("__sk_k1", "__sk_k2", words(F.col("text")).alias("w"))
    hashed = [shingle_hashes("w", k) for k in lengths]
    shingled = split.select("__sk_k1", "__sk_k2", F.size("w").alias("n_w"), F.explode(F.concat(*hashed) if len(hashed) > 1 else hashed[0]).alias("h"))
    hits = (
        shingled.where(F.col("h") <= F.lit(top if top is not None else 0))
        .join(small_or_shuffled(hashes, n_hashes), "h")
        .where(F.col("n_w") - F.col("k") + 1 >= F.col("least"))
        .select("__sk_k1", "__sk_k2", "item")
        .distinct()
    )
    hit = stored(hits.select("__sk_k1", "__sk_k2").distinct(), "hits")
    # whole texts of rows with a hit, each once however many items it may hold
    held = keyed.join(small_or_shuffled(hit, hit.count()), ["__sk_k1", "__sk_k2"], "left_semi").withColumn("row", F.monotonically_increasing_id())
    held = stored(held, "held")
    said = [_with_length(shingles("w", k), k) for k in lengths]
    split = held.select("row", "doc_id", "__sk_k1", "__sk_k2", words(F.col("text")).alias("w"))
    each = split.select("row", "doc_id", "__sk_k1", "__sk_k2", F.explode(F.concat(*said)).alias("x")).select("row", "doc_id", "__sk_k1", "__sk_k2", "x.k", "x.s")
    facts = stored(known.select("item", "item_id", "k", F.col("n").alias("n_shingles"), F.explode("shingles").alias("s")), "facts")
    n_facts, width = facts.agg(F.count("*"), F.coalesce(F.avg(F.octet_length("s")), F.lit(0.0))).first()
    met = each.join(small_or_shuffled(facts, n_facts, width + 48), ["k", "s"])
    found = met.groupBy("row", "doc_id", "__sk_k1", "__sk_k2", "item", "item_id", F.col("n_shingles").cast("bigint").alias("n_shingles")).agg(F.count("*").alias("n_found"))
    enough = found.where(F.col("n_found") >= F.ceil(F.lit(threshold) * F.col("n_shingles") - 1e-9))
    return enough.select("doc_id", "item_id", "n_shingles", "n_found", "__sk_k1", "__sk_k2", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir))
    return found.select("doc_id", "item_id", "n_shingles", "n_found", "containment")


@shielded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold no test item, whole rows."""
    held = stored(contaminated(docs, benchmark(spark, sf_dir)).select("__sk_k1", "__sk_k2").distinct(), "held")
    k1, k2 = row_keys("doc_id", F.coalesce("text", F.lit("")))
    keyed = docs.withColumns({"__sk_k1": k1, "__sk_k2": k2})
    return keyed.join(small_or_shuffled(held, held.count()), ["__sk_k1", "__sk_k2"], "left_anti").select(*docs.columns)


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLE_SQL = {
    "op1_decontamination": r"""
WITH items AS (
  SELECT row_number() OVER () AS item, item_id,
         list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM benchmark
), sized AS (
  SELECT item, item_id, w, least(len(w), 5) AS k FROM items WHERE len(w) > 0
), item_shingles AS (
  SELECT DISTINCT item, item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM sized, unnest(range(1, len(w) - k + 2)) AS t(i)
), item_sizes AS (
  SELECT item, item_id, count(*) AS n FROM item_shingles GROUP BY ALL
), docs AS (
  SELECT row_number() OVER () AS doc, doc_id,
         list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM documents
), doc_shingles AS (
  SELECT DISTINCT doc, doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM docs, (SELECT DISTINCT k FROM sized) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i)
), found AS (
  SELECT doc, doc_id, item, count(*) AS n_found
  FROM doc_shingles JOIN item_shingles USING (k, s) GROUP BY ALL
)
SELECT doc_id, item_id, n AS n_shingles, n_found, n_found / n AS containment
FROM found JOIN item_sizes USING (item)
WHERE n_found >= ceil(0.8 * n - 1e-9)
"""
}
