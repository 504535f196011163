"""Operators 1, 6 and 9 against all pairs."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from skein.llm import common, decontamination, lines, simhash

from .tables import documents, pairs, rows_of, sentence


# ---------------------------------------------------------- decontamination
def words(text):
    return [w for w in re.split(r"[^\w]|_", text.lower()) if w]


def shingle_set(w, k):
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}


def held(docs, items, threshold=0.8):
    out = []
    for i, t in docs:
        for j, q in items:
            qw = words(q or "")
            if not qw:
                continue
            k = min(5, len(qw))
            want = shingle_set(qw, k)
            n = len(want & shingle_set(words(t), k))
            if n >= threshold * len(want) - 1e-9:
                out.append((i, j, len(want), n))
    return sorted(out, key=repr)


def bench(spark, docs, rng):
    texts = [t for _, t in docs if len(words(t)) > 60]
    items = []
    for k in range(25):
        w = words(rng.choice(texts))
        n = rng.choice([1, 2, 3, 4, 5, 6, 9, 15, 30, 50])
        at = rng.randrange(len(w) - n)
        item = w[at : at + n]
        for _ in range(rng.choice([0, 0, 1, 3])):
            item[rng.randrange(n)] = "zzz"
        items.append((k, " ".join(item).title() + "."))
    return items + [(100, None), (101, ""), (102, "..."), (3, "another text under the same id"), (3, "another text under the same id"), (None, "a text without an id a text")]


def test_decontamination(spark):
    docs = documents(spark)
    items = bench(spark, pairs(docs), random.Random(4))
    table = spark.createDataFrame([(*r, "clash") for r in items], "item_id bigint, text string, doc_id string")
    got = decontamination.contaminated(docs, table)
    want = held(pairs(docs), items)
    assert rows_of(got, "doc_id", "item_id", "n_shingles", "n_found") == want and len(want) > 30
    assert decontamination.contaminated(docs.limit(0), table).count() == 0
    assert decontamination.contaminated(docs, table.limit(0)).count() == 0


def test_decontamination_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    docs = documents(spark)
    items = bench(spark, pairs(docs), random.Random(5))
    got = decontamination.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert rows_of(got, "doc_id", "item_id", "n_shingles", "n_found") == held(pairs(docs), items)


# ------------------------------------------------------------------- simhash
def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64))


def brute_components(prints, most=4):
    nodes = sorted(set(prints))
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= most:
                root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def check_components(spark, rows):
    """rows: doc_id, unsigned fingerprint."""
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in rows]
    got = simhash.near_components(spark.createDataFrame(signed, "doc_id bigint, fp bigint"))
    root = brute_components([f for _, f in rows])
    low = {}
    for i, f in rows:
        if i is not None:
            low[root[f]] = min(i, low.get(root[f], i))
    assert rows_of(got, "doc_id", "fp", "component_id") == sorted(((i, s, low.get(root[f])) for (i, f), (_, s) in zip(rows, signed, strict=True)), key=repr)


def test_simhash_documents(spark):
    docs = documents(spark)
    got = simhash.fingerprints(docs)
    assert sorted((r["doc_id"], r["fp"] % (1 << 64)) for r in got.where("doc_id is not null").collect()) == sorted((i, brute_print(t)) for i, t in pairs(docs) if i is not None)
    check_components(spark, [(i, brute_print(t)) for i, t in pairs(docs)])
    assert simhash.near_components(simhash.fingerprints(docs.limit(0))).count() == 0


def test_simhash_near_prints(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            for _ in range(rng.randint(0, 5)):
                f ^= 1 << rng.randrange(64)
            rows.append((rng.choice([None, *range(500)]), f))
    check_components(spark, rows + rows[:9] + [(900, 0), (901, (1 << 64) - 1), (902, 1)])


@pytest.mark.parametrize("block", [8, 4096])
def test_simhash_dense_ball(spark, block):
    """A crowd of different fingerprints about one centre, with split blocks."""
    rng = random.Random(9)
    centre, prints = rng.getrandbits(64), set()
    while len(prints) < 250:
        f = centre
        for b in rng.sample(range(64), rng.randint(0, 7)):
            f ^= 1 << b
        prints.add(f)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in prints]
    edges = simhash.near_edges(spark.createDataFrame(signed, "fp bigint"), 4, block)
    rows = {(r["a"], r["b"]) for r in edges.collect()}
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 4 for a, b in rows)
    comp = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(list(rows), "a bigint, b bigint")).collect()}
    want = brute_components(list(prints))
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    signed_want = {(f - (1 << 64) if f >> 63 else f): r for f, r in want.items()}
    assert groups(comp) == {g for g in groups(signed_want) if len(g) > 1}


def test_keep_one(spark):
    docs = documents(spark)
    got = simhash.keep_one(spark, docs, "")
    assert got.columns == docs.columns
    root = brute_components([brute_print(t) for _, t in pairs(docs)])
    stayed = [root[brute_print(r["text"] or "")] for r in got.collect()]
    assert sorted(stayed) == sorted(set(root.values()))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(100, 300)]
    star = [(1000, k) for k in range(1001, 1400)] + [(7, 1399), (5, 5)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(chain + star, "a bigint, b bigint")).collect()}
    assert got == {k: 100 for k in range(100, 301)} | {k: 7 for k in [7, *range(1000, 1400)]}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def most_rows(spark, df):
    """Of one partition, when partitions aren't put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        return max(r["count"] for r in df.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_key_of_many_rows(spark, tmp_path):
    """100,000 rows of one key get the key's sums in many tasks."""
    spark.range(100_000).select(F.when(F.col("id") % 100 == 7, F.col("id")).otherwise(-1).alias("key"), (F.col("id") * 7 % 100_003).alias("v")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    got = common.beside_group(df, ["key"], F.xxhash64("v"), [F.min("v").alias("m"), F.count("*").alias("n")], [F.min("m").alias("least"), F.sum("n").alias("many")])
    want = df.groupBy("key").agg(F.min("v").alias("least"), F.count("*").alias("many"))
    assert got.join(want, ["key", "least", "many"]).count() == got.count() == 100_000
    assert most_rows(spark, got) < 20_000


def test_one_fingerprint_of_many_rows(spark, tmp_path):
    """100,000 documents of one fingerprint, and a component of many fingerprints."""
    fp = F.when(F.col("id") < 100_000, 0).otherwise(F.expr("shiftleft(1L, cast(id % 60 as int))"))
    spark.range(101_000).select((101_000 - F.col("id")).alias("doc_id"), fp.alias("fp")).write.parquet(f"{tmp_path}/t")
    got = simhash.near_components(spark.read.parquet(f"{tmp_path}/t"))
    assert [tuple(r) for r in got.groupBy("component_id").count().collect()] == [(1, 101_000)]
    assert most_rows(spark, got) < 30_000


def test_extra_columns_named_like_row_keys(spark):
    docs = documents(spark).withColumn("__sk_k1", F.lit("mine")).withColumn("__sk_root", F.lit("too"))
    assert set(simhash.near_components(simhash.fingerprints(docs)).columns) == {"doc_id", "fp", "__sk_root", "component_id"}
    got = simhash.keep_one(spark, docs, "")
    assert got.columns == docs.columns and {r["__sk_k1"] for r in got.collect()} == {"mine"}


# --------------------------------------------------------------------- lines
def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_docs(spark, seed=6):
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(2, 9)) for _ in range(25)]
    docs = []
    for k in range(40):
        ls = []
        for _ in range(rng.randint(0, 6)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                p, op = rng.randrange(len(x) + 1), rng.randrange(3)
                if op == 0:
                    x.insert(p, rng.choice("abé"))
                elif p < len(x):
                    x[p : p + 1] = [] if op == 1 else [rng.choice("xyz")]
            ls.append("".join(x))
        docs.append((k, "\n".join(ls)))
    docs += [docs[3], (50, None), (51, ""), (52, " \n\t\n"), (53, "ab\nabc\nabcdefgh\nabcdefghi\nabcdefghij\nabcdefghiX\n\nabcdefghij"), (None, docs[4][1])]
    return docs, spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id bigint, text string, line string")


def brute_lines(docs):
    """The report by all pairs of distinct lines."""
    key = {}
    rows = spark_keys(docs)
    occ = sorted({(i is None, i or 0, k, n, x) for (i, t), k in zip(docs, rows, strict=True) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")})
    distinct = list(dict.fromkeys(o[4] for o in occ))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(distinct, 0)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if abs(len(a) - len(b)) <= 2:
                d = edits(a, b)
                if d <= 2 and 10 * d <= max(len(a), len(b)):
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    first, lead = {}, {}
    for o in occ:
        first.setdefault(o[4], o)
        lead.setdefault(find(o[4]), o)
    for (i, t), k in zip(docs, rows, strict=True):
        own = [o for o in occ if o[:3] == (i is None, i or 0, k)]
        firsts = [o for o in own if first[o[4]] == o]
        near = sum(lead[find(o[4])] != o for o in firsts)
        key.setdefault(k, []).append((i, len(own), len(own) - len(firsts), near, len(firsts) - near, sum(links[o[4]] for o in own)))
    return sorted((r for rs in key.values() for r in rs), key=repr)


def spark_keys(docs):
    """The row keys decide ties between documents with the same id."""
    from pyspark.sql import SparkSession

    df = SparkSession.active().createDataFrame(docs, "doc_id bigint, text string")
    got = {(r["doc_id"], r["text"]): (r["__sk_k1"], r["__sk_k2"]) for r in df.select("doc_id", "text", *common.row_keys("doc_id", F.coalesce("text", F.lit("")))).collect()}
    return [got[d] for d in docs]


@pytest.mark.parametrize("crowd", [24, 2])
def test_lines(spark, monkeypatch, crowd):
    monkeypatch.setattr(lines, "CROWD", crowd)
    monkeypatch.setattr(lines.candidates, "__defaults__", (lines.EDITS, crowd, 4 if crowd == 2 else lines.BLOCK))
    docs, df = line_docs(spark)
    got = lines.line_report(df)
    assert rows_of(got, "doc_id", "n_lines", "n_exact", "n_near", "n_kept", "n_links") == brute_lines(docs)
    assert lines.line_report(df.limit(0)).count() == 0


def test_without_repeats(spark):
    df = spark.createDataFrame([(1, "same line here\n\nother words stand here\nsame line here"), (2, "other words stand hers\nnew"), (3, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in lines.without_repeats(df).collect()}
    assert got == {1: "same line here\n\nother words stand here", 2: "new", 3: ""}


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distance(spark, most):
    rng = random.Random(most)
    rows = [("", ""), ("", "ab"), ("a", "")]
    for _ in range(600):
        a = [rng.choice("abé") for _ in range(rng.randint(0, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            p = rng.randrange(len(b) + 1)
            b[p : p + rng.randint(0, 1)] = rng.choice([[], ["a"], ["x"]])
        rows.append(("".join(a), "".join(b)))
    got = lines.with_distance(spark.createDataFrame(rows, "la string, lb string"), most).select("la", "lb", "dist").collect()
    assert all(r["dist"] == min(most + 1, edits(r["la"], r["lb"])) for r in got)


def test_native_plans(spark, monkeypatch):
    """Operators 1 and 9 run no Python on their main path, in none of their tables."""
    docs, df = line_docs(spark)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "red stone river under light")], "item_id bigint, text string")
    for t in (df, items):
        t.write.mode("overwrite").parquet(f"{common.shared_folder(spark)}/native-{len(t.columns)}-{t.columns[0]}")
    df, items = (spark.read.parquet(f"{common.shared_folder(spark)}/native-2-{c}") for c in ("doc_id", "item_id"))
    plans = []

    def told(frame, label, keep=common.stored):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return keep(frame, label)

    for module in (common, lines, decontamination):
        monkeypatch.setattr(module, "stored", told)
    for out in (lines.line_report(df), decontamination.contaminated(df, items)):
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 12 and not any(re.search("Python|Arrow|Pandas|Scan ExistingRDD", p) for p in plans)
