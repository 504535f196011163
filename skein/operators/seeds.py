"""Nearest barcodes in large sheets, by a pigeonhole index of seeds.

Barcodes are cut in ``s`` segments, and every ``k`` of them make a seed.  Of a barcode and a
sample that differ at r places, the ``k`` segments with fewest differences have at most e of
them, as ``radius_of`` says.  The sheet is indexed by (seed's number, bases), ambiguity
codes spelled out to the bases they stand for; an observed barcode looks up each of its
seeds, and all strings with up to e bases of it changed, and is compared with those samples
alone.  Pairs live inside the join: those farther off than the radius go where they are met,
and the best two of a barcode are kept.  A sample may be met more than once; the best two
are told apart by their numbers.

* A seed that spells out to more than ``SPELLED`` strings stands under every string
  (null) and meets all barcodes.
* An observed code is looked up by one of its bases: a sample that allows the code allows
  each of its bases.  A letter that is no base agrees with everything, so a barcode with
  one meets the whole sheet, in blocks.

A small radius tells which barcodes can be accepted at all.  The second best sample may lie
far off, and only those barcodes need it: where it isn't found yet they look again, to ever
larger radii.  Which seeds serve a radius with least work depends on the sizes of the sheet
and of what is left (``cheapest``): larger sheets have longer seeds, so that a seed is
shared by few samples however large the sheet is.  Where no seeds are cheaper the last
barcodes meet the whole sheet.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.bases import DNA_MASKS, PER_CHUNK, encode, mask_digits, mismatches_sql
from skein.sources.folders import passing_path, written

WORST = 255
BLOCK, SPELLED, LEAST_SEED, MOST_SEGMENTS, MOST_CHANGED = 256, 64, 3, 6, 2
#: Measured, in microseconds: an index row, a looked up string, a pair inside the join, and
#: a pair in a block.
BUILD, LOOK, MEET, FOLD = 5.0, 2.0, 0.05, 2.0
#: The bases that each mask allows, and one of them.
_ALLOWS = {m: [b for b, bit in DNA_MASKS.items() if m & bit] for m in range(1, 16)}
_BASE_OF = "".join(_ALLOWS[m][0] for m in range(1, 16))
_DIGITS = "123456789ABCDEF"
#: Broadcast limit of an index, in bytes.
INDEX_BYTES = 24_000_000


def segments_of(length: int, n: int) -> list[tuple[int, int]]:
    """Starts and lengths of ``n`` segments, as even as can be."""
    at = [k * length // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def seeds_of(length: int, n: int, k: int) -> list[list[tuple[int, int]]]:
    """The seeds: every ``k`` of ``n`` segments."""
    return [list(some) for some in combinations(segments_of(length, n), k)]


def radius_of(n: int, k: int, errors: int) -> int:
    """Most mismatches r of which, wherever they are, some ``k`` of ``n`` segments have at most
    ``errors``.  Spread evenly, r // n or one more to a segment, they leave most."""
    r = 0
    while r + 1 - ((n - k) * ((r + 1) // n) + min(n - k, (r + 1) % n)) <= errors:
        r += 1
    return r


def cheapest(n_observed: int, n_samples: int, length: int, radius: int, built: set[tuple[int, int]]) -> tuple[int, int, int] | None:
    """Segments, segments of a seed and changed bases that find all within ``radius`` with
    least work; None where meeting the whole sheet is less."""
    found, least = None, n_observed * n_samples * FOLD
    for n in range(2, min(length, MOST_SEGMENTS) + 1):
        for k in range(1, n):
            sizes = [sum(size for _, size in seed) for seed in seeds_of(length, n, k)]
            for errors in range(MOST_CHANGED + 1):
                if min(sizes) < LEAST_SEED or radius_of(n, k, errors) < radius:
                    continue
                work = 0.0 if (n, k) in built else len(sizes) * n_samples * BUILD
                for size in sizes:
                    strings = sum(comb(size, j) * 3**j for j in range(errors + 1))
                    work += n_observed * strings * (LOOK + MEET * n_samples / 4**size)
                if work < least:
                    found, least = (n, k, errors), work
    return found


def spelled(digits: Column, size: int) -> Column:
    """ARRAY<STRING> of the base strings that a segment of mask digits allows, or
    array(null) where there are more than SPELLED."""
    choices = F.create_map(*(x for m in range(1, 16) for x in (F.lit(_DIGITS[m - 1]), F.lit(_ALLOWS[m]))))
    letters = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.substring(digits, k, F.lit(1)))
    many = F.aggregate(letters, F.lit(1), lambda n, d: F.least(F.lit(SPELLED + 1), n * F.size(F.element_at(choices, d))))
    grown = F.aggregate(letters, F.array(F.lit("")), lambda some, d: F.flatten(F.transform(some, lambda s: F.transform(F.element_at(choices, d), lambda b: F.concat(s, b)))))
    return F.when(many > SPELLED, F.array(F.lit(None).cast("string"))).otherwise(grown)


def changed(seed: Column, size: int, errors: int) -> Column:
    """ARRAY<STRING> of the strings with up to ``errors`` bases of ``seed`` changed."""
    places = F.sequence(F.lit(1), F.lit(size))
    out = F.array(seed)
    for _ in range(errors):
        out = F.array_distinct(F.flatten(F.transform(out, lambda s: F.flatten(F.transform(places, lambda p: F.transform(F.lit(list("ACGT")), lambda b: F.overlay(s, b, p)))))))
    return out


def _taken(c: Column, seed: list[tuple[int, int]]) -> Column:
    return F.concat(*(F.substring(c, a + 1, n) for a, n in seed))


def _of_seed(k: int, strings: Column) -> Column:
    return F.transform(strings, lambda s: F.struct(F.lit(k).alias("number"), s.alias("seed")))


def index_of(samples: DataFrame, length: int, seeds: list[list[tuple[int, int]]]) -> DataFrame:
    """number, seed (null: all), ordinal, theirs (the sample's masks)."""
    digits = F.col("digits")
    each = []
    for k, seed in enumerate(seeds):
        own = _taken(digits, seed)
        strings = F.when(own.rlike("^[1248]*$"), F.array(F.translate(own, "1248", "ACGT"))).otherwise(spelled(own, sum(n for _, n in seed)))
        each.append(_of_seed(k, strings))
    n_tasks = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small tables, long work: not to be put together
    dealt = samples.select("ordinal", "barcode").repartition(n_tasks, "ordinal").select("ordinal", mask_digits("barcode").alias("digits"), encode("barcode", length).alias("theirs"))
    return dealt.select("ordinal", "theirs", F.explode(F.concat(*each)).alias("at")).select("at.number", "at.seed", "ordinal", "theirs")


def _best_two(masks: str, held: str, length: int) -> str:
    """SQL: the two smallest scores of ``held``, the second null where it has one sample
    only.  A score is a sample's distance, then its number."""
    mm = mismatches_sql("o", "x.masks", -(-length // PER_CHUNK))
    scores = f"transform({held}, x -> shiftleft(cast(least({WORST}, cast({mm} as int)) as bigint), 32) + x.ordinal)"
    two = "transform(array(array_min(s)), a -> array(a, array_min(filter(s, y -> y > a))))[0]"
    return f"transform(array({masks}), o -> transform(array({scores}), s -> {two})[0])[0]"


def _merged(found: DataFrame) -> DataFrame:
    """The best two, of different numbers, of what blocks and segments found (obs, best):
    of equally near samples the first."""
    near = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list("best")))))
    two = found.groupBy("obs").agg(near.alias("near"))
    first, second = F.col("near")[0], F.get("near", F.lit(1))
    far = F.coalesce(F.shiftright(second, 32).cast("int"), F.lit(WORST))
    number = first.bitwiseAND(F.lit((1 << 32) - 1).cast("bigint")).cast("int")
    return two.select("obs", number.alias("best_ordinal"), F.shiftright(first, 32).cast("int").alias("best_mismatches"), far.alias("next_best_mismatches"))


def _two_nearest(met: DataFrame) -> DataFrame:
    """The same of pairs (obs, score) inside the radius, of which a sample may have many;
    no second is ``WORST``."""
    place = F.dense_rank().over(Window.partitionBy("obs").orderBy("score"))
    two = met.withColumn("place", place).where("place <= 2")  # kept as pairs are met
    two = two.groupBy("obs").agg(F.min("score").alias("first"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"))
    far = F.coalesce(F.shiftright("second", 32).cast("int"), F.lit(WORST))
    number = F.col("first").bitwiseAND(F.lit((1 << 32) - 1).cast("bigint")).cast("int")
    return two.select("obs", number.alias("best_ordinal"), F.shiftright("first", 32).cast("int").alias("best_mismatches"), far.alias("next_best_mismatches"))


class Seeds:
    """A sheet's index, stored: seeds of ``k`` of ``n`` segments."""

    def __init__(self, samples: DataFrame, length: int, n: int, k: int, index_bytes: int | None = None):
        self.length, self.n, self.k = length, n, k
        self.seeds = seeds_of(length, n, k)
        self.table = written(index_of(samples, length, self.seeds), passing_path(samples.sparkSession, "seeds"))
        rows, wild = self.table.agg(F.count("*"), F.count_if(F.col("seed").isNull())).first()
        width = 64 + length + 8 * -(-length // PER_CHUNK)
        self.small = rows * width <= (INDEX_BYTES if index_bytes is None else index_bytes)
        self.any_wild = wild > 0

    def within(self, observed: DataFrame, errors: int) -> DataFrame:
        """The best two samples of each of ``observed`` (obs, masks; bases and codes only)
        that has any within ``radius_of`` its seeds; a second farther off is ``WORST``."""
        bases = F.translate(mask_digits("obs"), _DIGITS, _BASE_OF)
        looked = [_of_seed(k, changed(_taken(bases, seed), sum(n for _, n in seed), errors)) for k, seed in enumerate(self.seeds)]
        n_tasks = int(observed.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as in ``index_of``
        asked = observed.repartition(n_tasks, "obs").select("obs", "masks", F.explode(F.concat(*looked)).alias("at")).select("obs", "masks", "at.number", "at.seed")
        mm = F.expr(mismatches_sql("masks", "theirs", -(-self.length // PER_CHUNK)))
        near = mm <= radius_of(self.n, self.k, errors)
        score = (F.shiftleft(mm.cast("bigint"), 32) + F.col("ordinal")).alias("score")
        index = self.table.where("seed is not null")
        met = asked.join(F.broadcast(index) if self.small else index.hint("merge"), ["number", "seed"]).where(near).select("obs", score)
        if self.any_wild:
            wild = self.table.where("seed is null").select("ordinal", "theirs").distinct()
            met = met.unionByName(observed.crossJoin(F.broadcast(wild) if self.small else wild).where(near).select("obs", score))
        return _two_nearest(met)


def against_all(observed: DataFrame, samples: DataFrame, length: int) -> DataFrame:
    """The best two of the whole sheet, which comes in rows of BLOCK samples."""
    blocks = samples.select(F.expr(f"ordinal div {BLOCK}").alias("block"), F.struct("ordinal", encode("barcode", length).alias("masks")).alias("x"))
    blocks = blocks.groupBy("block").agg(F.sort_array(F.collect_list("x")).alias("held")).select("held")
    n = samples.count() * (16 + 8 * (3 + -(-length // PER_CHUNK)))
    met = observed.crossJoin(F.broadcast(blocks) if n <= INDEX_BYTES else blocks)
    return _merged(met.select("obs", F.expr(_best_two("masks", "held", length)).alias("best")))


def nearest_two(observed: DataFrame, samples: DataFrame, length: int, max_mismatches: int, min_delta: int) -> DataFrame:
    """obs, best_ordinal, best_mismatches, next_best_mismatches of each distinct barcode
    of ``observed`` (obs) that is accepted; exact.  Barcodes are of ``length``."""
    spark = observed.sparkSession
    packed = observed.select("obs", encode("obs", length).alias("masks"))
    plain = ~mask_digits("obs").contains("0")
    accepted = (F.col("best_mismatches") <= max_mismatches) & (F.col("next_best_mismatches") - F.col("best_mismatches") >= min_delta)
    left, settled = packed.where(plain), []
    if packed.where(~plain).limit(1).count():
        settled.append(against_all(packed.where(~plain), samples, length))
    n_samples, n_left, radius = samples.count(), left.count(), -1
    built: dict[tuple[int, int], Seeds] = {}
    while n_left and (way := cheapest(n_left, n_samples, length, max(radius + 1, max_mismatches), set(built))):
        n, k, errors = way
        if (n, k) not in built:
            built[n, k] = Seeds(samples, length, n, k)
        radius = radius_of(n, k, errors)
        # all within the radius are found: a barcode that isn't accepted now never will be
        found = written(built[n, k].within(left, errors).where(accepted), passing_path(spark, "nearest"))
        sure = F.col("next_best_mismatches") <= radius  # beyond, it isn't known yet
        settled.append(found.where(sure))
        left = found.where(~sure).select("obs", encode("obs", length).alias("masks"))
        n_left = left.count()
    if n_left or not settled:
        settled.append(against_all(left, samples, length))
    return reduce(DataFrame.unionByName, settled).where(accepted)
