import pytest
from pyspark.sql import functions as F

from skein.functions import bases, packed

#: Observed, expected, mismatches.
PAIRS = [
    ("GATTACA", "GATTACA", 0), ("GATTACA", "GANNACA", 0), ("GANNACA", "NNNNNNN", 0), ("GATTACA", "GACCACA", 2),
    ("GATTACA", "CTAATGT", 7), ("ACGTTAAACCGAAACA", "ACGTUMRWSYKVHDBN", 0), ("ACGTUMRWSYKVHDBN", "ACGTTAAACCGAAACA", 11),
    ("N", "R", 1), ("N", "N", 0), ("R", "R", 0), ("R", "V", 0), ("R", "D", 0), ("R", "N", 0), ("R", "B", 1),
    ("gattaca", "GATTACA", 0), ("XXXXXXX", "GATTACA", 0), (".", "A", 1), ("U", "T", 0),
]


@pytest.mark.parametrize("length", sorted({len(o) for o, _, _ in PAIRS}))
def test_hamming(spark, length):
    rows = [p for p in PAIRS if len(p[0]) == length]
    got = spark.createDataFrame(rows, "o string, e string, want int").select("o", "e", "want", bases.hamming("o", "e", length).alias("got"))
    arrays = got.withColumn("array_got", packed.hamming(bases.masks("o"), bases.masks("e")))
    for r in arrays.collect():
        assert r["got"] == r["want"] == r["array_got"], r


def test_round_trip_and_predicates(spark):
    df = spark.createDataFrame([("ACGTUMRWSYKVHDBN.acgun",)], "b string")
    r = df.select(bases.decode("b").alias("d"), bases.decode_masks(bases.masks("b")).alias("m"), bases.n_nocalls("b").alias("n")).first()
    assert r["d"] == r["m"] == "ACGTTMRWSYKVHDBNNACGTN"
    assert r["n"] == 3
    valid = {b: v for b, v in spark.createDataFrame([(c,) for c in "ACGTUNn.acgtX-"], "b string").select("b", bases.is_valid_iupac("b")).collect()}
    assert {b for b, v in valid.items() if v} == set("ACGTUNn.")
    assert [r[0] for r in spark.createDataFrame([("N",), ("n",), (".",), ("A",), ("NN",)], "b string").select(bases.is_nocall("b")).collect()] == [True, True, True, False, False]


@pytest.mark.parametrize("f", [lambda c: bases.decode(c), lambda c: bases.decode_masks(bases.masks(c))])
def test_unknown_base_does_not_decode(spark, f):
    with pytest.raises(Exception, match="Invalid bit mask for base"):
        spark.createDataFrame([("AXA",)], "b string").select(f("b")).collect()


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 8])
def test_packed_arrays(spark, width):
    top = (1 << width) - 1
    values = [(k * 5 + 3) & top for k in range(37)]
    df = spark.createDataFrame([(values,)], "a array<int>")
    a = F.col("a")
    bs = packed.blocks(a, width)
    r = df.select(
        packed.push(a, 1000, width).alias("push"), packed.push_values(a, 3, top, width).alias("many"), packed.set_at(a, 5, top, width).alias("set"),
        packed.get(a, 36).alias("last"), packed.get(a, 37).alias("beyond"), packed.nr_blocks(a, width).alias("blocks"), packed.nr_symbols(a).alias("n"),
        packed.is_empty(a).alias("empty"), packed.is_empty(packed.clear(width)).alias("cleared"),
        F.array(*(packed.get_by_address(bs, packed.address(i, width), width) for i in range(37))).alias("by_address"),
        packed.get_by_address(packed.set_by_address(bs, packed.address(11, width), 1, width), packed.address(11, width), width).alias("written"),
    ).first()
    per = (32 - 32 % width) // width
    assert r["push"] == values + [1000 & top] and r["many"] == values + [top] * 3
    assert r["set"] == values[:5] + [top] + values[6:]
    assert (r["last"], r["beyond"], r["blocks"], r["n"], r["empty"], r["cleared"]) == (values[36], None, -(-37 // per), 37, False, True)
    assert r["by_address"] == values and r["written"] == 1


def test_packed_width_and_length_errors(spark):
    with pytest.raises(ValueError):
        packed.new(9)
    with pytest.raises(Exception, match="same length"):
        spark.createDataFrame([([1], [1, 2])], "a array<int>, b array<int>").select(packed.hamming(F.col("a"), F.col("b"))).collect()


def test_packed_hamming_stops_at_most(spark):
    df = spark.createDataFrame([([1, 2, 4, 8], [2, 2, 2, 2])], "a array<int>, b array<int>")
    assert df.select(packed.hamming(F.col("a"), F.col("b"), 2)).first()[0] == 2
