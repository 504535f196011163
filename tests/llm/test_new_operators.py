"""Operators 11 to 13."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import clusters, infill, machine

from .tables import documents, pairs, rows_of, sentence


# ------------------------------------------------------------- fill in the middle
def brute_units(text, unit):
    if unit == "char":
        return list(text)
    return re.findall(r"[^\n]*\n|[^\n]+" if unit == "line" else r"^[ \t-\r]+|[^ \t-\r]+[ \t-\r]*", text)


def brute_infill(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}"


def test_infill(spark):
    docs = documents(spark, more=["a <P> b", "tail <S>", "<M>", "< P><S <M", "<P", "x<S", "😀" * 700, "é"])
    made = infill.restored(infill.fill_in_middle(docs))
    assert rows_of(made, *infill.FORMS.replace(" bigint", "").replace(" string", "").split(", ")) == sorted((brute_infill(i, t) for i, t in pairs(docs)), key=repr)
    assert {"plain", "psm", "spm"} == {r["form"] for r in made.select("form").distinct().collect()}
    assert rows_of(made, "doc_id", "restored") == sorted(pairs(docs), key=repr)
    assert infill.restored(infill.fill_in_middle(docs.limit(0))).count() == 0


def test_infill_null_text_is_empty(spark):
    got = infill.fill_in_middle(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).first()
    assert (got["n"], got["form"], got["prefix_chars"], got["output"]) == (0, "plain", None, "")


@pytest.mark.parametrize("unit", list(infill.UNITS))
@pytest.mark.parametrize("size", [1, 3, 50, 1 << 20])
def test_pieces_whatever_the_blocks(unit, size):
    """Texts longer than a block are cut in blocks; the pieces are the same."""
    rng = random.Random(size)
    texts = ["".join(rng.choice("ab é\n\t€😀<") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", ""]
    made = pa.array(["x", *texts], pa.large_string()).slice(1)
    draws = [[rng.randrange(1 << 32) for _ in texts] for _ in range(2)]
    n, lo, hi, parts = infill.pieces(made, tuple(pa.array(d, pa.int64()) for d in draws), unit, size)
    for k, t in enumerate(texts):
        units = brute_units(t, unit)
        assert "".join(units) == t and n[k].as_py() == len(units)
        a, b = sorted(d[k] % (len(units) + 1) for d in draws)
        assert (lo[k].as_py(), hi[k].as_py()) == (a, b)
        assert [p[k].as_py() for p in parts] == ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])]


def test_infill_by_lines(spark):
    docs = documents(spark)
    made = infill.restored(infill.fill_in_middle(docs, unit="line", whole=100, suffix_first=50)).collect()
    assert sorted(((r["doc_id"], r["restored"]) for r in made), key=repr) == sorted(pairs(docs), key=repr)
    for r in made:
        if r["form"] == "psm":
            prefix = r["output"][3 : r["output"].index("<S>")]
            assert len(brute_units(prefix, "line")) == r["prefix_chars"] and (not prefix or prefix.endswith("\n") or r["prefix_chars"] == r["n"])
    with pytest.raises(ValueError, match="unit must be"):
        infill.fill_in_middle(docs, unit="page")


# --------------------------------------------------------------------- clusters
def brute_clusters(rows, dims, k, rounds):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _i, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(c) // len(c) for c in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    out = [(i, *reversed(near(v))) for i, v in kept]
    inertia = {n: sum(d for _, c, d in out if c == n) for n in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in out], key=repr)


CLUSTER_COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_clusters(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 3, 0.4) for _ in range(5)], "x") for i in range(120)]
    rows += [(None, rows[0][1], "x"), rows[3], rows[3], (7, rows[8][1], "x"), (200, None, "x"), (201, [1.0] * 4, "x"), (202, [1.0, 2.0, None, 0.0, 1.0], "x")]
    rows += [(203, [float("nan")] * 5, "x"), (204, [float("inf")] * 5, "x"), (205, [], "x"), (206, [-0.0005] * 5, "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, cluster string")
    single = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    for k, rounds in ((4, 3), (8, 10), (200, 2)):
        got = clusters.cluster_vectors(df, dims=5, k=k, rounds=rounds)
        assert rows_of(got, *CLUSTER_COLUMNS) == brute_clusters(single, 5, k, rounds)
    none = clusters.cluster_vectors(df.where("vec_id in (201, 205)"), dims=5)
    assert none.columns == list(CLUSTER_COLUMNS) and none.count() == 0 and [t for _, t in none.dtypes] == [t for _, t in got.dtypes]


def test_ties_and_empty_clusters(spark):
    """Equal vectors all go to the smaller number; the centroids without vectors stay."""
    df = spark.createDataFrame([(i, [1.0, -1.0]) for i in range(20)], "vec_id bigint, embedding array<double>")
    got = clusters.cluster_vectors(df, dims=2, k=3).collect()
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in got} == {(0, 0, 0)} and len(got) == 20
    same = hashlib.sha256(b"1024,-1024").hexdigest()
    assert {r["centroid_sha256"] for r in got} == {same}


def test_rounds_use_jvm_expressions_alone(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25])], "vec_id bigint, embedding array<float>")
    plan = clusters.cluster_vectors(df, dims=2, k=1)._jdf.queryExecution().toString()
    assert "zip_with" in plan and "array_min" in plan and not re.search(r"Python|InArrow|InPandas", plan)


# ---------------------------------------------------------- factorisation machine
def test_pairs_in_linear_time_are_the_pairs():
    """The sum-of-squares identity against all pairs."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(6, 3))
    scale = machine.Scale.of(rows)
    m = machine.Machine(0.3, rng.normal(size=40 + scale.width), rng.normal(size=(40 + scale.width, 4)), scale, 40)
    words = [(rng.choice(40, n, replace=False).astype(np.int32), rng.random(n)) for n in (0, 1, 5, 9, 40, 3)]
    got = m.scores(words, rows)
    more_ids, more_x = scale.features(rows, 40)
    for k, (ids, x) in enumerate(words):
        i, v = np.concatenate([ids, more_ids[k]]), np.concatenate([x, more_x[k]])
        margin = m.bias + sum(m.w[a] * p for a, p in zip(i, v, strict=True))
        margin += sum(m.v[i[a]] @ m.v[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert got[k] == pytest.approx(1 / (1 + np.exp(-np.clip(margin, -30, 30))), abs=1e-9)


def test_gradient():
    """A step on one example moves its margin by what finite differences say."""
    rng = np.random.default_rng(5)
    rows, y = rng.normal(size=(40, 2)), (np.arange(40) % 2).astype(float)
    words = [(np.array([int(k % 2), 2 + int(k % 4 < 2)], np.int32), np.array([0.7, 0.7])) for k in range(40)]
    start, end = (machine.train(words, rows, y, rank=2, epochs=e, buckets=8) for e in (0, 30))

    def loss(m):
        p = np.clip(m.scores(words, rows), 1e-9, 1 - 1e-9)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    assert loss(end) < 0.2 < loss(start)
    assert not end.w[5:8].any() and not end.v[5:8].any()  # buckets of no example


def test_interactions_are_learned():
    """A label that only pairs of words tell: no linear model gets it."""
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 2, 800), rng.integers(0, 2, 800)
    words = [(np.array([x, 2 + z], np.int32), np.array([0.7, 0.7])) for x, z in zip(a, b, strict=True)]
    y = (a ^ b).astype(float)
    m = machine.train(words, np.zeros((800, 1)), y, epochs=60, buckets=4)
    assert ((m.scores(words, np.zeros((800, 1))) > 0.5) == y).mean() > 0.99


def _corpus(spark, n=600):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        words = "buy !!! $$$ click | now free ###" if bad else "river stone maple winter glass paper engine candle quiet seven"
        rows.append((k, sentence(rng, rng.randint(30, 90), words) + "." * (not bad), rng.choice(["en", None]), "s", None if k % 7 == 0 else 400, "score"))
        labels.append((k, 1 - bad, 0))
    rows += [(None, "no id", None, None, None, None), (9, None, None, None, 1, None), (9, "", None, None, 0, None), rows[5]]
    labels += [(3, None, 0), (None, 1, 0), (10, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_machine(spark):
    docs, labels = _corpus(spark)
    got = machine.classify(docs, labels)
    rows = got.collect()
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == docs.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in rows if r["held_out"]]
    right = [r["predicted"] == (r["doc_id"] % 4 != 0) for r in held if r["doc_id"] != 9]
    assert len(right) > 100 and np.mean(right) > 0.97
    again = machine.classify(docs.repartition(5).withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), labels.repartition(3))
    assert rows_of(again, "doc_id", "score") == rows_of(got, "doc_id", "score")


def test_held_out_labels_are_not_learned(spark):
    docs, labels = _corpus(spark)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows_of(machine.classify(docs, flipped), "doc_id", "score") == rows_of(machine.classify(docs, labels), "doc_id", "score")


def test_machine_bounds_and_single_class(spark, monkeypatch):
    docs, labels = _corpus(spark)
    assert len(machine.examples(docs, labels, sample=50)) == 50
    monkeypatch.setattr(machine, "MOST_FEATURES", 300)
    assert sum(len(r[1]) for r in machine.examples(docs, labels)) <= 300
    assert {r["score"] for r in machine.classify(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r["score"] for r in machine.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert machine.classify(docs.limit(0), labels).count() == 0


def test_unseen_words_leave_the_score_to_the_structure(spark):
    docs, labels = _corpus(spark)
    rng = random.Random(9)
    other = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)) + "."
    some = spark.createDataFrame([(1, other, 400)], "doc_id bigint, text string, n_chars bigint")
    assert machine.scored(some, machine.fit(docs, labels)).first()["predicted"] == 1
