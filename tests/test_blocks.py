"""Packed arrays against plain lists."""

import random

import pytest
from pyspark.sql import functions as F

from skein.functions import blocks


def blocks_of(values, width):
    n = 32 // width
    return [sum(v << (k * width) for k, v in enumerate(values[at : at + n])) for at in range(0, len(values), n)]


def lists(width, n=40):
    rng = random.Random(width)
    return [[rng.randrange(1 << width) for _ in range(rng.randint(0, 70))] for _ in range(n)] + [[], [0], [(1 << width) - 1] * (32 // width)]


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5, 7, 8])
def test_packed_as_lists(spark, width):
    rng = random.Random(width)
    rows = [(k, v, rng.randint(0, 80), rng.randrange(256), rng.randint(0, 25)) for k, v in enumerate(lists(width))]
    df = spark.createDataFrame(rows, "k int, v array<int>, i int, x int, more int").withColumn("a", blocks.pack("v", width))
    a, i, x, more = F.col("a"), F.col("i"), F.col("x"), F.col("more")
    got = df.select(
        "k", "a", blocks.symbols(a, width).alias("back"), blocks.push(a, x, width).alias("pushed"), blocks.push_values(a, more, x, width).alias("many"),
        blocks.set_at(a, i, x, width).alias("was_set"), blocks.get(a, i, width).alias("got"), blocks.nr_blocks(a).alias("n_blocks"), blocks.is_empty(a).alias("empty"),
    ).collect()
    for r in got:
        _, v, at, value, times = rows[r["k"]]
        value &= (1 << width) - 1
        assert r["a"]["blocks"] == blocks_of(v, width) and r["a"]["n"] == len(v) and r["back"] == v
        for made, want in ((r["pushed"], [*v, value]), (r["many"], v + [value] * times), (r["was_set"], [value if k == at else y for k, y in enumerate(v)])):
            assert made["blocks"] == blocks_of(want, width) and made["n"] == len(want)
        assert r["got"] == (v[at] if at < len(v) else None) and r["n_blocks"] == len(blocks_of(v, width)) and r["empty"] == (not v)


def test_order_equality_and_groups(spark):
    """By blocks, then length: as equal, ordered and grouped as (blocks, n)."""
    values = lists(4) + lists(4)[:5] + [[1], [1, 0], [1, 0, 0]]
    df = spark.createDataFrame([(v,) for v in values], "v array<int>").select(blocks.pack("v", 4).alias("a"))
    keys = [(tuple(blocks_of(v, 4)), len(v)) for v in values]
    assert [(tuple(r["a"]["blocks"]), r["a"]["n"]) for r in df.orderBy("a").collect()] == sorted(keys)
    assert {(tuple(r["a"]["blocks"]), r["a"]["n"]): r["count"] for r in df.groupBy("a").count().collect()} == {k: keys.count(k) for k in keys}
    assert df.distinct().count() == len(set(keys))


@pytest.mark.parametrize("width", [1, 4, 7])
def test_hamming(spark, width):
    rng = random.Random(width)
    pairs = [(v, [rng.randrange(1 << width) for _ in v]) for v in lists(width)]
    df = spark.createDataFrame(pairs, "v array<int>, w array<int>")
    got = df.select(blocks.hamming(blocks.pack("v", width), blocks.pack("w", width), width), blocks.hamming(blocks.pack("v", width), blocks.pack("w", width), width, 3)).collect()
    want = [sum((x & ~y) != 0 for x, y in zip(v, w, strict=True)) for v, w in pairs]
    assert [tuple(r) for r in got] == [(n, min(3, n)) for n in want]
    with pytest.raises(Exception, match="same length"):
        spark.createDataFrame([([1], [1, 0])], "v array<int>, w array<int>").select(blocks.hamming(blocks.pack("v", width), blocks.pack("w", width), width)).collect()


def test_bases_addresses_and_widths(spark):
    df = spark.createDataFrame([("ACGTNACGTR",), ("",), ("acgtu.",)], "b string")
    for r in df.select("b", blocks.symbols(blocks.pack_bases("b"), 4).alias("s"), blocks.pack_bases("b").alias("a")).collect():
        want = [{"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "N": 15, ".": 15, "R": 5}[c.upper()] for c in r["b"]]
        assert r["s"] == want and r["a"]["blocks"] == blocks_of(want, 4)
    a = blocks.pack(F.array(*map(F.lit, range(10))), 7)
    r = spark.range(1).select(blocks.address(9, 7).alias("at"), blocks.set_by_address(a["blocks"], blocks.address(9, 7), 100, 7).alias("b"), blocks.get_by_address(a["blocks"], blocks.address(5, 7), 7).alias("g")).first()
    assert (r["at"]["block"], r["at"]["bit"], r["g"]) == (2, 7, 5) and r["b"] == blocks_of([*range(9), 100], 7)
    for width in (0, 9):
        with pytest.raises(ValueError, match="up to 8"):
            blocks.new(width)
