"""Operator 5: mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they
belong to); a flow network routes each pattern's tokens to the quotas of its
sources.  A pattern offers its tokens once at no cost, a second time at a higher
cost and so on, which makes repetition costs convex; quotas that can't be filled
are left over at a cost above any repetition.  The solution says how many tokens
each pattern gives; documents are then selected in a seeded order.

The selection is a distributed prefix sum: documents are ordered by a seeded hash,
cut into hash buckets whose number grows with the rows, summed by bucket before
any shuffle, and only offsets travel back; a source with a third of all rows is
spread over its buckets.  Documents that don't fit what is open are passed over and
the sum goes on among those that do, until none fits; what is still open is then
less than the smallest unused document, and the one of the best fitting size fills
it where that comes closer.  A round keeps what is still open of each pattern and the last
place taken; only documents that still fit are carried on, and the rounds' few numbers say
at the end which documents are in.  What is open after a round is less than a document
that fitted before: in a seeded order it shrinks by some factor each time, and rounds are
a dozen or two; the most that an unlucky order could ask for is one for each size.

On the driver: one row for each membership pattern (sums only), never documents.  The
flow is worked out there, so patterns are meant to be some thousands; the tables made
of them are broadcast where their size allows it and joined by a shuffle otherwise.

``mix_overlapping`` says for each copy which source it counts for: a pattern's taken
tokens stand in the seeded order and are dealt to its sources as the flow has it.

Defined results: a null text has size 0; documents of size 0 are taken 0 words;
null sources are a source of their own (last in order).  Empty tables give no
rows.  Repeated rows are documents of their own.  The same rows give the same
mix in any order or partitioning; among rows equal in every column used, which
one is taken is not told apart by the result.  Very long texts are counted whole and
taken or passed over like any other document.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, forget, row_keys, shielded, small_or_shuffled, stored

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2, 17
ROWS_A_BUCKET, MOST_BUCKETS = 500, 1 << 20


def n_words(text: Column) -> Column:
    """Runs of anything but space and U+0009 to U+000D; 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[ \\t-\\r]+"))).cast("bigint")


# --------------------------------------------------------------------- targets
def targets(sizes: dict, weights: dict, share: float = SHARE, most: float = MOST) -> dict:
    """Shares ``share`` of all sizes by weight; a target stops at ``most`` times
    its source's size and the excess is shared again until none is above."""
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


# ------------------------------------------------------------------------ flow
class Flow:
    """Min-cost flow by successive shortest paths with potentials."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        """Costs of arcs are 0 or more, so potentials start at 0."""
        height: dict[int, int] = defaultdict(int)
        while True:
            dist, via, queue = {source: 0}, {}, [(0, source)]
            while queue:
                d, x = heapq.heappop(queue)
                if d > dist[x]:
                    continue
                for e in self.out[x]:
                    if self.room[e]:
                        y, nd = self.to[e], d + self.cost[e] + height[x] - height[self.to[e]]
                        if nd < dist.get(y, math.inf):
                            dist[y], via[y] = nd, e
                            heapq.heappush(queue, (nd, y))
            if sink not in dist:
                return
            far = dist[sink]
            for x in list(self.out):
                height[x] += min(dist.get(x, far), far)
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push


def route(patterns: dict[tuple, int], quotas: dict, most: int = MOST) -> dict[tuple, dict]:
    """Tokens that each pattern gives to each of its sources.

    patterns: tokens of each tuple of sources.  The k-th use of a pattern's
    tokens costs (k - 1) squared a token: convex, so none is used twice while
    another could be used once.
    """
    flow, sources = Flow(), {s: k for k, s in enumerate(quotas)}
    n = len(sources)
    start, end = n + len(patterns), n + len(patterns) + 1
    for s, q in quotas.items():
        flow.arc(sources[s], end, int(q), 0)
    arcs = {}
    for k, (pattern, tokens) in enumerate(patterns.items()):
        for use in range(most):
            flow.arc(start, n + k, int(tokens), use * use)
        arcs[pattern] = {s: flow.arc(n + k, sources[s], most * int(tokens), 0) for s in pattern}
    flow.run(start, end)
    return {p: {s: flow.room[e ^ 1] for s, e in by.items() if flow.room[e ^ 1]} for p, by in arcs.items()}


def whole(shares: dict) -> dict:
    """Targets as whole tokens with the same (rounded) sum: largest remainders."""
    out = {s: int(math.floor(v)) for s, v in shares.items()}
    spare = round(sum(shares.values())) - sum(out.values())
    for s in sorted(shares, key=lambda s: (out[s] - shares[s], str(s)))[: max(0, spare)]:
        out[s] += 1
    return out


# ------------------------------------------------------------------- selection
def of_patterns(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table with a row for each membership pattern, its first column."""
    width = 64 + max((len(str(r)) for r in rows), default=0)
    return small_or_shuffled(spark.createDataFrame(rows, ddl), len(rows), width)


BUCKET = ["__sk_pattern", "__sk_bucket"]


def offsets(rows: DataFrame, words: str) -> DataFrame:
    """``__sk_offset``: the sum of ``words`` in a pattern's buckets before each."""
    before = Window.partitionBy("__sk_pattern").orderBy("__sk_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*BUCKET).agg(F.sum(words).alias("__sk_sum"))
    # a table that grows with the rows: not to be broadcast by its compressed size
    return sums.select(*BUCKET, F.coalesce(F.sum("__sk_sum").over(before), F.lit(0)).alias("__sk_offset")).hint("merge")


def select(sized: DataFrame, gives: dict, seed: int = SEED, tie: list[str] | None = None) -> DataFrame:
    """``sized`` (doc_id, size, __sk_pattern, more) with ``copies`` and the place in
    the seeded order (__sk_bucket, __sk_rank).

    gives: for each pattern its tokens and the tokens that it is to give.  Every
    document is taken (given div tokens) times; the rest is filled by documents
    in seeded order that fit, then by the one document that fits best.  ``tie``:
    columns that tell documents with equal ids (null, say) apart.
    """
    spark, n, tie = sized.sparkSession, sized.count(), tie or []
    buckets = min(max(64, n // ROWS_A_BUCKET), MOST_BUCKETS)
    plan = of_patterns(
        spark, [(p, g // t if t else 0, g % t if t else 0) for p, (t, g) in gives.items()], "__sk_pattern string, __sk_times bigint, __sk_rest bigint"
    )
    order = F.xxhash64(F.lit(seed), "doc_id", "size", *tie)
    keyed = sized.withColumn("__sk_order", order).withColumn(
        "__sk_bucket", F.pmod(F.shiftright("__sk_order", 40), F.lit(1 << 24)) * buckets / F.lit(1 << 24)
    ).withColumn("__sk_bucket", F.floor("__sk_bucket"))
    inside = Window.partitionBy(*BUCKET).orderBy("__sk_order", "doc_id", "size", *tie)
    ranked = stored(keyed.join(plan, "__sk_pattern").withColumn("__sk_rank", F.row_number().over(inside)), "mix")
    # a round's taken documents are those of the open ones up to a place in the order: a
    # pattern's rounds (what was open, the last place) say all of it
    open_, rounds = {p: g % t if t else 0 for p, (t, g) in gives.items()}, {p: [] for p in gives}
    some = ranked.where("size > 0").select(*BUCKET, "__sk_rank", "size")
    while True:
        # the documents that fit what is open; of these the first in order whose sum does
        now = of_patterns(spark, list(open_.items()), "__sk_pattern string, __sk_gap bigint")
        left = some.join(now, "__sk_pattern").where("size <= __sk_gap")
        upto = Window.partitionBy(*BUCKET).orderBy("__sk_rank").rowsBetween(Window.unboundedPreceding, 0)
        ends = left.join(offsets(left, "size"), BUCKET).withColumn("__sk_end", F.col("__sk_offset") + F.sum("size").over(upto))
        last = F.max(F.struct("__sk_bucket", "__sk_rank")).alias("last")
        got = ends.where("__sk_end <= __sk_gap").groupBy("__sk_pattern").agg(F.sum("size").alias("n"), last).collect()  # a row for each pattern
        if not got:
            break
        for r in got:
            p = r["__sk_pattern"]
            rounds[p].append((open_[p], r["last"]["__sk_bucket"], r["last"]["__sk_rank"]))
            open_[p] -= int(r["n"])
        behind = [(p, open_[p], *rounds[p][-1][1:]) for p in (r["__sk_pattern"] for r in got) if open_[p]]
        mark = of_patterns(spark, behind, "__sk_pattern string, __sk_gap bigint, __sk_b bigint, __sk_r int")
        more = some.join(mark, "__sk_pattern").where("size <= __sk_gap and struct(__sk_bucket, __sk_rank) > struct(__sk_b, __sk_r)")
        more = stored(more.select(*BUCKET, "__sk_rank", "size"), "mix-open")
        forget(some)
        some = more
    forget(some)
    taken = of_patterns(spark, list(rounds.items()), "__sk_pattern string, __sk_rounds array<struct<gap:bigint,b:bigint,r:int>>")
    ranked = ranked.join(taken, "__sk_pattern").withColumn(
        "__sk_in", F.expr("size <= 0 or exists(__sk_rounds, x -> size <= x.gap and struct(__sk_bucket, __sk_rank) <= struct(x.b, x.r))")
    ).drop("__sk_rounds")
    gap = of_patterns(spark, list(open_.items()), "__sk_pattern string, __sk_gap bigint")
    best = (
        ranked.where(~F.col("__sk_in") & (F.col("size") > 0))
        .join(gap, "__sk_pattern")
        .where(F.abs(F.col("__sk_gap") - F.col("size")) < F.col("__sk_gap"))
        .groupBy("__sk_pattern")
        .agg(F.min(F.struct(F.abs(F.col("__sk_gap") - F.col("size")).alias("off"), "__sk_bucket", "__sk_rank")).alias("__sk_fit"))
    )
    best = small_or_shuffled(best, len(gives), 64 + max(map(len, gives), default=0))  # a row for each pattern
    fits = (F.col("__sk_fit.__sk_bucket") == F.col("__sk_bucket")) & (F.col("__sk_fit.__sk_rank") == F.col("__sk_rank"))
    extra = F.col("__sk_in") | F.coalesce(fits, F.lit(False))
    made = ranked.join(best, "__sk_pattern", "left").withColumn("copies", F.col("__sk_times") + extra.cast("bigint"))
    return made.drop("__sk_times", "__sk_rest", "__sk_in", "__sk_fit", "__sk_order")


def by_source(mixed: DataFrame, gives: dict[str, list[tuple]]) -> DataFrame:
    """``mixed`` with ``uses``, an array of (source, copies): which source each copy
    counts for.  gives: for each pattern its sources and the tokens it gives to each.

    A copy belongs to the source in whose stretch of the pattern's taken tokens its
    middle lies, so a source gets its quota but for half a document at either end and
    what the selection missed."""
    plan = []
    for p, by in gives.items():
        ends, at = [], 0
        for _, n in by:
            at += n
            ends.append(at)
        plan.append((p, [s for s, _ in by], ends))
    stretches = of_patterns(mixed.sparkSession, plan, "__sk_pattern string, __sk_sources array<string>, __sk_ends array<bigint>")
    taken = stored(mixed.withColumn("__sk_taken", F.col("copies") * F.col("size")), "taken")
    upto = Window.partitionBy(*BUCKET).orderBy("__sk_rank").rowsBetween(Window.unboundedPreceding, -1)
    at = taken.join(offsets(taken, "__sk_taken"), BUCKET).withColumn("__sk_at", F.col("__sk_offset") + F.coalesce(F.sum("__sk_taken").over(upto), F.lit(0)))
    which = "transform(if(copies > 0, sequence(1L, copies), array()), k -> least(size(filter(__sk_ends, e -> e <= __sk_at + (k - 0.5D) * size)), size(__sk_ends) - 1))"
    counted = "filter(transform(__sk_sources, (s, j) -> struct(s as source, cast(size(filter(__sk_which, w -> w = j)) as bigint) as copies)), u -> u.copies > 0)"
    made = at.join(stretches, "__sk_pattern", "left").withColumn("__sk_which", F.expr(which)).withColumn("uses", F.coalesce(F.expr(counted), F.expr("array()")))
    return made.drop("__sk_taken", "__sk_offset", "__sk_at", "__sk_sources", "__sk_ends", "__sk_which")


def by_code_point(sources) -> list:
    """Code-point order (as UTF-8 bytes), null last."""
    return sorted(sources, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))


def mix_overlapping(docs: DataFrame, weights: dict, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """General form: ``docs`` has doc_id, size and ``sources`` (array<string>, the
    document's memberships).  Adds ``copies``, how often the mix takes it, and ``uses``,
    (source, copies) of the sources that these count for."""
    sized = stored(docs.withColumn("__sk_pattern", F.to_json(F.array_sort(F.array_distinct("sources")))), "sized")
    rows = sized.groupBy("__sk_pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size")).collect()
    tokens = {r["__sk_pattern"]: int(r["size"]) for r in rows}
    members = {r["__sk_pattern"]: tuple(by_code_point(set(r["sources"]))) for r in rows}
    sizes: dict = defaultdict(int)
    for p, t in tokens.items():
        for s in members[p]:
            sizes[s] += t
    want = whole(targets({s: sizes[s] for s in by_code_point(sizes)}, weights, share * sum(tokens.values()) / max(1, sum(sizes.values())), most))
    names = {members[p]: p for p in tokens}
    got = route({members[p]: t for p, t in tokens.items()}, want, most)
    gives = {names[m]: (tokens[names[m]], sum(by.values())) for m, by in got.items()}
    mixed = select(sized, gives, seed)
    return by_source(mixed, {names[m]: list(by.items()) for m, by in got.items()}).drop("__sk_pattern", "__sk_bucket", "__sk_rank")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and the columns named by
    ``keys`` for documents with one source each."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    sized = stored(
        docs.select("doc_id", n_words(text).alias("size"), "source", F.to_json(F.array("source")).alias("__sk_pattern"), F.xxhash64(text).alias("__sk_text"), *keys), "sized"
    )
    rows = sized.groupBy("source", "__sk_pattern").agg(F.sum("size").alias("size")).collect()
    sizes = {r["source"]: int(r["size"]) for r in rows}
    named = {r["source"]: r["__sk_pattern"] for r in rows}
    ordered = by_code_point(sizes)
    want = targets(sizes, {s: weights[k % len(weights)] for k, s in enumerate(ordered)}, share, most)
    got = route({(s,): sizes[s] for s in ordered}, whole({s: want[s] for s in ordered}), most)
    mixed = select(sized, {named[s]: (sizes[s], sum(by.values())) for (s,), by in got.items()}, seed, ["__sk_text"])
    facts = of_patterns(spark, [(named[s], sizes[s], float(want[s])) for s in ordered], "__sk_pattern string, source_size bigint, target double")
    return mixed.join(facts, "__sk_pattern").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *keys)


@shielded
def take_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, whole rows.
    Rows equal in every column are taken as often as the mix takes them together."""
    names = ("__sk_k1", "__sk_k2")
    keyed = docs.withColumns(dict(zip(names, row_keys(*docs.columns), strict=True)))
    taken = mix(keyed, keys=names).groupBy(*names).agg(F.sum("copies").alias("__sk_copies")).where("__sk_copies > 0")
    one = keyed.join(stored(taken, "taken").hint("merge"), list(names)).dropDuplicates(list(names))
    return one.withColumn("__sk_x", F.explode(F.expr("sequence(1L, __sk_copies)"))).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


QUERIES = {"op5_mixing": op5_mixing}
