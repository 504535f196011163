"""Operator 6: SimHash near-duplicates by a segment-popcount embedding.

A fingerprint maps to the bit counts of its 32 two-bit segments.  The Manhattan
distance of two such vectors never exceeds the Hamming distance of the
fingerprints, so links at 4 bits have vectors at Manhattan distance 4 or less,
and in one of the two halves (16 segments each) at distance 2 or less.  On the
integer grid of a half, two such points have a common point at distance 1 or
less from both; the range join therefore places every fingerprint at its own
grid point and its neighbours (25 on average) and meets equal points.  What meets
is held to the bound over all segments, then verified exactly by XOR and popcount.

Grid points are worked through in sorted runs, in NumPy, emitting a spanning
forest of the links and not all pairs.  Points with more than ``BLOCK`` members
are split: members are dealt to blocks and each pair of blocks is a task's run of
its own, so no task holds an unbounded group and no link is lost.  Equal
fingerprints are one node, whatever the number of copies.

Defined results: null and empty texts have fingerprint zero and link like any
other; texts of one to three words have one shingle.  ``component_id`` is the
smallest doc_id reachable (nulls come last: it is null only if all are).
Repeated rows get a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, beside_group, components, documents, map_rows, row_keys, shielded, small_or_shuffled, stored

WIDTH, SEED, MOST_BITS = 4, 42, 4
BLOCK, SMALL = 2048, 16
_ODD = 0x5555555555555555


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of the text's word shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))  # where each word starts; last: past the end
    if len(words) <= width:
        spans = [(0, len(joined))]
    else:
        spans = zip(ends, (e - 1 for e in ends[width:]), strict=False)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64)
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp and the columns named by ``keys`` (bigint)."""
    kept = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keys)
    ddl = "doc_id bigint, fp bigint" + "".join(f", {k} bigint" for k in keys)
    return map_rows(kept, lambda: lambda i, t, *k: (i, fingerprint(t), *k), ddl)


# ------------------------------------------------------------------------ grid
def grid_points(fps: DataFrame) -> DataFrame:
    """half, point, fp: each half of the embedding at its grid point and those at
    Manhattan distance 1.  Counts are two bits each, packed in a long."""
    half = "shiftrightunsigned(fp, {0}) & 4294967295L"
    packed = "(({0}) & 1431655765L) + (shiftrightunsigned({0}, 1) & 1431655765L)"
    near = """
        transform(concat(array(0L),
                         transform(filter(sequence(0, 15), i -> (shiftrightunsigned({c}, 2 * i) & 3L) < 2L), i -> shiftleft(1L, 2 * i)),
                         transform(filter(sequence(0, 15), i -> (shiftrightunsigned({c}, 2 * i) & 3L) > 0L), i -> -shiftleft(1L, 2 * i))),
                  d -> {h} + {c} + d)
    """
    halves = fps.select("fp", F.expr(half.format(0)).alias("x0"), F.expr(half.format(32)).alias("x1"))
    counts = halves.select("fp", F.expr(packed.format("x0")).alias("c0"), F.expr(packed.format("x1")).alias("c1"))
    points = F.expr(f"concat({near.format(c='c0', h='0L')}, {near.format(c='c1', h='4294967296L')})")
    return counts.select("fp", F.explode(points).alias("point"))


def _links(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether fingerprints (uint64) link: the embedding's bound, then exactly."""
    odd = np.uint64(_ODD)
    one, three, lows = np.uint64(1), np.uint64(0x3333333333333333), np.uint64(0x1111111111111111)
    ca, cb = (a & odd) + ((a >> one) & odd), (b & odd) + ((b >> one) & odd)
    # per-segment |ca - cb|: counts are 0 to 2 and packed two bits each; widened to four
    dist = np.zeros(np.broadcast(a, b).shape, np.int64)
    for s in (np.uint64(0), np.uint64(2)):
        x, y = (ca >> s) & three, (cb >> s) & three
        up = x + np.uint64(0x4444444444444444) - y  # 4 + difference in each nibble: 2 to 6
        low, mid = up & lows, (up >> one) & lows
        two = mid & ~low  # 2 is 010 and 6 is 110
        dist += np.bitwise_count(low).astype(np.int64) + 2 * np.bitwise_count(two).astype(np.int64)
    near = dist <= most
    return near & (np.bitwise_count(a ^ b) <= most)


def forest(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among ``fps``."""
    left, heads, tails = np.arange(len(fps)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = _links(fps[x], fps[left], most)
            got = left[hit]
            heads += [fps[x]] * len(got)
            tails += list(fps[got])
            queue += list(got)
            left = left[~hit]
    return np.array(heads, np.uint64), np.array(tails, np.uint64)


def run_edges(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys.  Small runs: all linked pairs, at most
    SMALL - 1 for each member; larger ones: a spanning forest."""
    n = len(keys)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if n else np.array([], int)
    sizes = np.diff(np.r_[starts, n])
    many = np.repeat(sizes, sizes)
    heads, tails = [], []
    for d in range(1, SMALL):
        i = np.flatnonzero((keys[d:] == keys[:-d]) & (many[d:] <= SMALL)) if n > d else np.array([], int)
        if not len(i):
            break
        ok = _links(fps[i], fps[i + d], most)
        heads.append(fps[i[ok]])
        tails.append(fps[i[ok] + d])
    for s, k in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        a, b = forest(fps[s : s + k], most)
        heads.append(a)
        tails.append(b)
    none = np.array([], np.uint64)
    return np.concatenate([*heads, none]), np.concatenate([*tails, none])


def _edges_of_sorted(most: int):
    """A mapInArrow function over rows (key, fp) sorted by key.  It holds one
    batch and the open run, which is BLOCK rows or so at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.array([], np.int64), np.array([], np.uint64)
        done = False
        batches = iter(batches)
        while not done:
            batch = next(batches, None)
            if batch is None:
                done, cut = True, len(keys)
            else:
                keys = np.concatenate([keys, batch.column(0).to_numpy()])
                fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
                cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last run may go on
            a, b = run_edges(keys[:cut], fps[:cut], most)
            keys, fps = keys[cut:], fps[cut:]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def near_edges(fps: DataFrame, most: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """a, b: links among distinct fingerprints, enough to connect what links
    connect.  ``most`` is 5 at most (the halves' radius is 2)."""
    if not 0 <= most <= 5:
        raise ValueError("the grid's halves find links of up to 5 bits")
    points = grid_points(fps)
    heavy = stored(points.groupBy("point").agg(F.count("*").alias("n")).where(F.col("n") > block), "heavy")
    n_heavy = heavy.count()
    light = points
    parts = []
    if n_heavy:
        light = points.join(small_or_shuffled(heavy, n_heavy), "point", "left_anti")
        dealt = points.join(small_or_shuffled(heavy, n_heavy), "point").withColumn("m", F.ceil(F.col("n") / (block // 2)).cast("int"))
        dealt = dealt.withColumn("k", F.pmod(F.xxhash64("fp"), "m").cast("int"))
        pairs = dealt.select("fp", "point", "k", F.explode(F.expr("sequence(0, m - 1)")).alias("o"))
        # 64-bit keys of block pairs: equal keys of different pairs would only add comparisons
        parts.append(pairs.select(F.xxhash64("point", F.least("k", "o"), F.greatest("k", "o")).alias("key"), "fp"))
    parts.append(light.select(F.col("point").alias("key"), "fp"))
    edges = [p.repartition("key").sortWithinPartitions("key").mapInArrow(_edges_of_sorted(most), "a bigint, b bigint") for p in parts]
    return edges[0] if len(edges) == 1 else edges[0].union(edges[1])


def near_components(prints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """``prints`` (doc_id, fp, further columns) with component_id and __sk_root.

    A fingerprint may be that of a third of all documents and a component may hold as
    many fingerprints: documents find their fingerprint by (fp, part), a part being
    one of ``SALTS``, and components get their smallest id by ``beside_group``."""
    # stored: a row's part must be the same wherever it is read
    prints = stored(prints.withColumn("__sk_part", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "prints")
    parts = stored(prints.groupBy("fp", "__sk_part").agg(F.min("doc_id").alias("first_id")), "parts")
    nodes = stored(parts.groupBy("fp").agg(F.min("first_id").alias("first_id")), "fps")
    roots = stored(components(near_edges(nodes.select("fp"), most), "simhash"), "roots")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("__sk_root"))
    lowest = [F.min("first_id").alias("__sk_low")], [F.min("__sk_low").alias("component_id")]
    named = beside_group(stored(rooted, "rooted"), ["__sk_root"], F.xxhash64("fp"), *lowest)
    told = parts.select("fp", "__sk_part").join(named.select("fp", "__sk_root", "component_id"), "fp")
    return prints.join(told, ["fp", "__sk_part"]).drop("__sk_part")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = fingerprints(documents(spark, sf_dir))
    return near_components(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@shielded
def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, the one with the smallest
    doc_id (nulls last), then the smallest row hash; whole rows.

    Most rows stay, so that those which go are taken out by their keys and whole rows
    aren't shuffled; only rows that stand there repeatedly (equal doc_id and text) are
    brought together."""
    keys = ["__sk_k1", "__sk_k2"]
    keyed = docs.withColumns(dict(zip(keys, row_keys("doc_id", "text"), strict=True)))
    grouped = near_components(fingerprints(keyed, tuple(keys)))
    rows = stored(grouped.groupBy("__sk_root", "doc_id", *keys).agg(F.count("*").alias("n")), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *keys)
    first = beside_group(rows, ["__sk_root"], F.xxhash64(*keys), [F.min(order).alias("s")], [F.min("s").alias("s")])
    stays = (F.col("s.__sk_k1") == F.col("__sk_k1")) & (F.col("s.__sk_k2") == F.col("__sk_k2"))
    marks = stored(first.withColumn("stays", stays).where("not stays or n > 1").select(*keys, "stays"), "marks")
    marked = keyed.join(small_or_shuffled(marks, marks.count()), keys, "left")
    once = marked.where("stays is null").select(*docs.columns)
    again = marked.where("stays").dropDuplicates(keys).select(*docs.columns)
    return once.unionAll(again)


QUERIES = {"op6_simhash": op6_simhash}
