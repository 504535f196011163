"""Operator 9: near-duplicate lines, DataFrame functions only.

Two lines are near if their edit distance is at most ``EDITS`` (2) and at most a
tenth of the longer line.  Classes are the connected components of equal and near
lines over the whole corpus; a class keeps its first line (smallest doc_id, nulls
last, then row hash, then place in the text).

Search: each line is cut into EDITS + 1 even segments.  Within EDITS edits at least
one segment stays whole, and stays within a known shift; a line therefore indexes
its segments by (its length, segment number, text) and probes, for each shorter
length in reach, the few substrings that could be such a segment (multi-match-aware
positions).  A key is one 64-bit hash.  Keys that only one distinct line has are
dropped by a partial aggregate (smallest and largest line of the key) before
anything is joined.

Keys with up to ``CROWD`` lines give their pairs from an array.  Crowded keys (a
template line in many variants) don't: their members carry a signature of the
parities of hashed character pairs, of which an edit changes at most four; members
meet blocks of signatures, a block a task's row, and only those within the bound leave
as rows.  Links are counted by line, so n different lines that are all near each other
make n * (n - 1) / 2 rows of two ids; their copies make none.

Verification: common prefix and suffix are cut by doubling, then a banded
bit-parallel edit distance (one word holds the 2 * EDITS + 1 diagonals) runs over
what is left, as a fold over character arrays that stops counting beyond EDITS.

Defined results: lines are split at \\n and count if they have a character other
than white space; null and empty texts have none.  Rows equal in doc_id and text
are one document whose result each of them gets.  Candidates are found by a 64-bit
hash of the line and classes kept by 128 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, beside_group, components, documents, row_keys, small_or_shuffled, stored

EDITS, SHARE, CROWD, BLOCK = 2, 10, 24, 1024
KEYS = ["__sk_k1", "__sk_k2"]
#: Bytes of a row of ``linked``: three numbers and a name of 32 digits.
LINKED = 72


# ------------------------------------------------------------- lines and keys
def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, row keys, line_no, line, h1, h2 for every line with a word."""
    keyed = docs.select("doc_id", *row_keys("doc_id", F.coalesce("text", F.lit(""))), F.split(F.coalesce("text", F.lit("")), "\n").alias("ls"))
    each = keyed.select("doc_id", *KEYS, F.posexplode("ls").alias("line_no", "line")).where(F.btrim("line", F.lit(SPACE)) != "")
    return each.select("doc_id", *KEYS, "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(29), "line").alias("h2"))


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(segment, length difference, shift): the index entries first (difference
    and shift 0), then the substrings at which a longer or equal line probes.

    A segment that is the first to stay whole has at most its number of edits
    before it, and the rest after it; that bounds its shift from both sides."""
    out = [(i, 0, 0) for i in range(edits + 1)]
    for diff in range(edits + 1):
        for i in range(edits + 1):
            before, after = i, edits - i
            out += [(i, diff, s) for s in range(max(-before, diff - after), min(before, diff + after) + 1) if (diff, s) != (0, 0)]
    return out


def segment_keys(line: str = "line", edits: int = EDITS) -> Column:
    """Array of keys in the order of ``probes``; null where a probe doesn't fit."""
    n, parts = edits + 1, []
    for i, diff, shift in probes(edits):
        size = f"(n_chars - {diff})"
        start = f"(({size} * {i}) div {n})"
        length = f"(({size} * {i + 1}) div {n} - {start})"
        at = f"({start} + {shift})"
        key = f"xxhash64({i}, {size}, substring({line}, cast({at} + 1 as int), cast({length} as int)))"
        parts.append(key if not diff and not shift else f"if({at} >= 0 and {at} + {length} <= n_chars, {key}, null)")
    return F.expr(f"array({', '.join(parts)})")


# ----------------------------------------------------------------- verification
def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _common(a: str, b: str, bits: int = 24) -> str:
    """Length of the common prefix, by doubling."""
    steps = ", ".join(str(1 << k) for k in reversed(range(bits)))
    return f"aggregate(array({steps}), 0, (l, s) -> if(l + s <= least(length({a}), length({b})) and substring({a}, l + 1, s) = substring({b}, l + 1, s), l + s, l))"


def banded_distance(a: str = "ma", b: str = "mb", edits: int = EDITS) -> str:
    """SQL for the edit distance of character arrays ``a`` and ``b`` where it is at
    most ``edits``, else edits + 1.

    Bit d of a word stands for the cell of row j + d - edits in column j: the band
    moves down the diagonal with the columns.  vp / vn: the cell is one more / less
    than the one above it; d0: the diagonal step into it is free; hp / hn: it is one
    more / less than the one to its left.  Row j + edits leaves the band last, so its
    value is followed: it grows by one with every column whose d0 bit is clear.
    Beyond 3 * edits the fold stands still: the 2 * edits rows below the last real
    one can take back no more than that.  Rows past the end of ``a`` match nothing;
    the value of the last real row follows
    from it by the vertical differences between them.
    """
    w = 2 * edits + 1
    full = (1 << w) - 1
    eq = " | ".join(f"if(j + {d - edits} >= 1 and get({a}, j + {d - edits} - 1) = get({b}, j - 1), {1 << d}, 0)" for d in range(w))
    d0 = "(((((x & s.vp) + s.vp) ^ s.vp) | x | s.vn) & " + str(full) + ")"
    hp = f"((s.vn | ~(z | s.vp)) & {full})"
    hn = "(z & s.vp)"
    step = _let("x", f"coalesce({eq}, 0)", _let("z", d0, _let(
        "p", hp,
        f"named_struct('vp', ({hn} | ~(shiftright(z, 1) | p)) & {full}, 'vn', shiftright(z, 1) & p, 'd', s.d + if(z & {1 << (w - 1)} = 0, 1, 0))",
    )))
    # column 0: rows 1 to edits are one more than the row above; row 0 and those before it are level
    start = f"named_struct('vp', {full & ~((1 << (edits + 1)) - 1) | (1 << edits)}, 'vn', 0, 'd', {edits})"
    # in column size(b), row size(b) + edits has value d; each row up to size(a) takes its difference back
    rows = f"sequence(0, size({b}) + {edits} - size({a}))"
    final = f"aggregate({rows}, s.d, (v, r) -> if(r = size({b}) + {edits} - size({a}), v, v - if(shiftright(s.vp, {w - 2} - r) & 1 = 1, 1, 0) + if(shiftright(s.vn, {w - 2} - r) & 1 = 1, 1, 0)))"
    fold = f"if(size({b}) = 0, {start}, aggregate(sequence(1, size({b})), {start}, (s, j) -> if(s.d > {3 * edits}, s, {step})))"
    return f"if(abs(size({a}) - size({b})) > {edits}, {edits + 1}, least({edits + 1}, {_let('s', fold, final)}))"


def _chars(c: str) -> str:
    return f"if({c} = '', array(), split({c}, ''))"


def with_distance(pairs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``pairs`` (la, lb, more) with ``dist``, capped at edits + 1."""
    cut = pairs.withColumn("__p", F.expr(_common("la", "lb"))).withColumns(
        {"__a": F.expr("substring(la, __p + 1, length(la))"), "__b": F.expr("substring(lb, __p + 1, length(lb))")}
    )
    cut = cut.withColumns({"__ra": F.reverse("__a"), "__rb": F.reverse("__b")}).withColumn("__q", F.expr(_common("__ra", "__rb")))
    left = cut.withColumns({"ma": F.expr(_chars("substring(__a, 1, length(__a) - __q)")), "mb": F.expr(_chars("substring(__b, 1, length(__b) - __q)"))})
    return left.withColumn("dist", F.expr(banded_distance("ma", "mb", edits))).drop("__p", "__a", "__b", "__ra", "__rb", "__q", "ma", "mb")


# ------------------------------------------------------------------------ search
def signature(line: str = "line") -> Column:
    """Parities of the hashed character pairs.  An edit takes away at most two
    pairs and brings at most two."""
    fold = f"aggregate(sequence(0, size(c) - 2), 0L, (s, i) -> s ^ shiftleft(1L, cast(pmod(xxhash64(c[i], c[i + 1]), 64L) as int)))"
    return F.expr(_let("c", f"split({line}, '')", f"if(size(c) < 2, 0L, {fold})"))


def _pairs_of_array(members: str) -> Column:
    """(a, b) for indexed a against all others of a key's members."""
    return F.expr(
        f"flatten(transform({members}, (x, i) -> transform(filter({members}, (y, j) -> i < j and (x.idx or y.idx)), y -> struct(least(x.h1, y.h1) as a, greatest(x.h1, y.h1) as b))))"
    )


def candidates(occ: DataFrame, texts_of, edits: int = EDITS, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """a, b (h1 of two lines, a < b) that share a key.  ``texts_of(ids)`` gives the
    lines (h1, h2, line) of a frame of h1."""
    n_index = edits + 1
    keyed = occ.select("h1", F.posexplode("keys").alias("place", "key")).where("key is not null").select("h1", "key", (F.col("place") < n_index).alias("idx"))
    ends = keyed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max(F.col("idx").cast("int")).alias("any"))
    shared = stored(ends.where("lo <> hi and any = 1").select("key"), "shared")
    members = keyed.join(small_or_shuffled(shared, shared.count()), "key", "left_semi")
    members = stored(members.groupBy("key", "h1").agg(F.max(F.col("idx").cast("int")).alias("idx")).select("key", "h1", (F.col("idx") == 1).alias("idx")), "members")
    crowded = stored(members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd), "crowded")
    n_crowded = crowded.count()
    light = members if not n_crowded else members.join(small_or_shuffled(crowded, n_crowded), "key", "left_anti")
    arrays = light.groupBy("key").agg(F.collect_list(F.struct("h1", "idx")).alias("m"))
    pairs = arrays.select(F.explode(_pairs_of_array("m")).alias("p")).select("p.a", "p.b")
    if n_crowded:
        heavy = stored(members.join(small_or_shuffled(crowded, n_crowded), "key"), "heavy")
        signed = texts_of(heavy.select("h1").distinct()).select("h1", signature().alias("sig"))
        heavy = heavy.join(signed, "h1")
        # members meet blocks: both are dealt, so a key is as many tasks as it has pairs of
        # a block and a part of its members
        n_part = F.greatest(F.col("n_blk"), F.least(F.lit(8), F.ceil(F.col("n") / 128)))
        heavy = heavy.withColumn("n_blk", F.ceil(F.col("n") / block)).withColumn("n_part", n_part)
        dealt = heavy.where("idx").withColumn("blk", F.pmod(F.xxhash64("h1"), F.col("n_blk")))
        blocks = dealt.groupBy("key", "blk", "n_part").agg(F.collect_list(F.struct("h1", "sig")).alias("m"))
        blocks = blocks.select("key", "blk", "m", F.explode(F.expr("sequence(0L, n_part - 1)")).alias("part"))
        near = f"filter(m, x -> x.h1 <> h1 and bit_count(x.sig ^ sig) <= {4 * edits})"
        sent = heavy.select("key", "h1", "sig", F.pmod(F.xxhash64(F.lit(3), "h1"), F.col("n_part")).alias("part"), F.explode(F.expr("sequence(0L, n_blk - 1)")).alias("blk"))
        met = sent.join(blocks, ["key", "blk", "part"]).select("h1", F.explode(F.expr(f"transform({near}, x -> x.h1)")).alias("o"))
        pairs = pairs.union(met.select(F.least("h1", "o").alias("a"), F.greatest("h1", "o").alias("b")))
    return pairs.distinct()


def near_lines(docs: DataFrame, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """(occ, links).  occ: doc_id, row keys, line_no, h1, h2 of every line; links:
    a1, a2, b1, b2, dist of every two distinct lines that are near."""
    lines = lines_of(docs)
    least = SHARE - edits  # characters; shorter lines are near nothing but themselves
    keys = F.when(F.col("n_chars") >= least, segment_keys(edits=edits))
    occ = stored(lines.withColumn("n_chars", F.length("line")).select("doc_id", *KEYS, "line_no", "h1", "h2", keys.alias("keys")), "lines")

    def texts_of(ids: DataFrame) -> DataFrame:
        kept = stored(ids, "ids")
        return lines.select("h1", "h2", "line").join(small_or_shuffled(kept, kept.count()), "h1", "left_semi").dropDuplicates(["h1", "h2"])

    pairs = stored(candidates(occ, texts_of, edits), "pairs")
    texts = stored(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct()), "texts")
    side = lambda h, s: texts.select(F.col("h1").alias(h), F.col("h1").alias(f"{h}1"), F.col("h2").alias(f"{h}2"), F.col("line").alias(s))
    both = pairs.join(side("a", "la"), "a").join(side("b", "lb"), "b").where(F.abs(F.length("la") - F.length("lb")) <= edits)
    # stored before the filter: pushed below, the filter would repeat the fold
    held = stored(with_distance(both, edits).select("a1", "a2", "b1", "b2", "dist", F.greatest(F.length("la"), F.length("lb")).alias("longer")), "held")
    return occ, held.where((F.col("dist") <= edits) & (F.col("dist") * SHARE <= F.col("longer"))).drop("longer")


def classes(occ: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, linked).  lines: h1, h2, first (its first occurrence), n of every
    distinct line; linked: h1, h2, root, n_links of those with a near line."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEYS, "line_no")).alias("first")
    lines = stored(occ.groupBy("h1", "h2").agg(first), "classes")
    name = lambda p: F.concat(F.lpad(F.hex(f"{p}1"), 16, "0"), F.lpad(F.hex(f"{p}2"), 16, "0"))
    ends = links.select(F.explode(F.array(F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2")), F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2")))).alias("e"))
    degree = ends.select("e.*").groupBy("h1", "h2").agg(F.count("*").alias("n_links"))
    roots = components(links.select(name("a").alias("a"), name("b").alias("b")), "lines")
    linked = degree.withColumn("node", name("h")).join(roots, "node").select("h1", "h2", "root", "n_links")
    return lines, stored(linked, "linked")


def line_report(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_exact (lines equal to
    an earlier one), n_near (other lines near to an earlier one's class), n_kept,
    n_links (near lines of its lines, counted by distinct text)."""
    occ, links = near_lines(docs, edits)
    lines, linked = classes(occ, links)
    small = linked.count()
    zero = F.lit(0).cast("bigint")
    firsts = lines.select("first.__sk_k1", "first.__sk_k2", F.lit(1).cast("bigint").alias("firsts"), zero.alias("near"), zero.alias("links"))
    placed = lines.join(small_or_shuffled(linked, small, LINKED), ["h1", "h2"]).select("root", "first")
    led = beside_group(stored(placed, "placed"), ["root"], F.xxhash64("first"), [F.min("first").alias("lead")], [F.min("lead").alias("lead")])
    near = led.where("first <> lead").select("first.__sk_k1", "first.__sk_k2", zero.alias("firsts"), F.lit(1).cast("bigint").alias("near"), zero.alias("links"))
    count = occ.join(small_or_shuffled(linked, small, LINKED), ["h1", "h2"]).select(*KEYS, "line_no", "n_links").distinct()
    count = count.select(*KEYS, zero.alias("firsts"), zero.alias("near"), F.col("n_links").alias("links"))
    sums = firsts.union(near).union(count).groupBy(*KEYS).agg(F.sum("firsts").alias("firsts"), F.sum("near").alias("near"), F.sum("links").alias("links"))
    n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")).cast("bigint")
    rows = docs.select("doc_id", n_lines.alias("n_lines"), *row_keys("doc_id", F.coalesce("text", F.lit("")))).join(sums, KEYS, "left")
    of = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return rows.select(
        "doc_id", "n_lines", (F.col("n_lines") - of("firsts")).alias("n_exact"), of("near").alias("n_near"),
        (of("firsts") - of("near")).alias("n_kept"), of("links").alias("n_links"),
    )


def without_repeats(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id and text: each distinct document with only the lines that its class
    keeps (and its lines without a word), in order."""
    occ, links = near_lines(docs, edits)
    lines, linked = classes(occ, links)
    placed = stored(lines.join(linked, ["h1", "h2"]).select("h1", "h2", "root", "first"), "placed")
    led = beside_group(placed, ["root"], F.xxhash64("first"), [F.min("first").alias("lead")], [F.min("lead").alias("lead")])
    alone = lines.join(linked.select("h1", "h2"), ["h1", "h2"], "left_anti").select("first.*")
    kept = alone.union(led.where("first = lead").select("first.*"))
    places = kept.groupBy(*KEYS).agg(F.collect_set("line_no").alias("stay"))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *row_keys("doc_id", F.coalesce("text", F.lit("")))).dropDuplicates(KEYS)
    ls = F.split("text", "\n")
    text = F.array_join(F.filter(ls, lambda x, i: (F.btrim(x, F.lit(SPACE)) == "") | F.coalesce(F.array_contains("stay", i), F.lit(False))), "\n")
    return keyed.join(places, KEYS, "left").select("doc_id", text.alias("text"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir))


QUERIES = {"op9_lines": op9_lines}
#: The tables' letters beyond ASCII.  DuckDB's distance counts bytes, so
#: its SQL sets a control character in place of each.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_CONTROLS = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 32)][: len(LETTERS)])
#: An edit changes these letters' numbers by two at most, taken together.
_LETTER_COUNTS = ", ".join(f"length(line) - length(replace(line, '{c}', ''))" for c in "eaintrs ")
ORACLE_SQL = {
    "op9_lines": rf"""
WITH RECURSIVE occ AS MATERIALIZED (
  SELECT doc_id, doc_id * 16777216 + i AS place, ls[i] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i)
  WHERE trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
), own AS MATERIALIZED (
  SELECT line, min(place) AS place, row_number() OVER (ORDER BY min(place)) AS id, length(line) AS size,
         translate(line, '{LETTERS}', {_CONTROLS}) AS flat, [{_LETTER_COUNTS}] AS counts
  FROM occ GROUP BY line
), near AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b
  FROM own AS a JOIN (SELECT *, unnest([0, 1, 2]) AS more FROM own) AS b ON a.size = b.size + more
  WHERE (more > 0 OR a.id < b.id) AND list_sum([abs(a.counts[k] - b.counts[k]) FOR k IN range(1, 9)]) <= {2 * EDITS}
    AND CASE WHEN list_sum([abs(a.counts[k] - b.counts[k]) FOR k IN range(1, 9)]) <= {2 * EDITS} THEN levenshtein(a.flat, b.flat) ELSE 99 END <= least({EDITS}, a.size // {SHARE})
), edges AS (
  SELECT a, b FROM near UNION ALL SELECT b, a FROM near
), reach AS (
  SELECT a AS id, a AS root FROM edges UNION SELECT edges.b, root FROM reach JOIN edges ON edges.a = reach.id
), known AS (
  SELECT id, own.place, line, coalesce((SELECT min(root) FROM reach WHERE reach.id = own.id), id) AS root, (SELECT count(*) FROM edges WHERE a = own.id) AS links
  FROM own
), counted AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE occ.place <> known.place) AS n_exact,
         count(*) FILTER (WHERE occ.place = known.place AND root <> id) AS n_near,
         count(*) FILTER (WHERE occ.place = known.place AND root = id) AS n_kept, CAST(sum(links) AS BIGINT) AS n_links
  FROM occ JOIN known USING (line) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near,
       coalesce(n_kept, 0) AS n_kept, coalesce(n_links, 0) AS n_links
FROM documents AS d LEFT JOIN counted USING (doc_id)
"""
}
