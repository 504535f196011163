"""Operators 5, 8 and 10, and the pipeline."""

import pathlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from skein.llm import common, mixing, tokens, toxicity

from .tables import documents, pairs, rows_of, sentence
from .test_pairs import brute_components, brute_print, held


# -------------------------------------------------------------------- mixing
def test_targets_stop_and_share_again():
    sizes = {"a": 10, "b": 100, "c": 100, None: 5}
    got = mixing.targets(sizes, {"a": 3, "b": 1, "c": 2, None: 3})
    assert got["a"] == 20 and got[None] == 10 and sum(got.values()) == pytest.approx(1.5 * 215)
    assert got["c"] == pytest.approx(min(200, 2 * got["b"])) and all(got[s] <= 2 * n + 1e-9 for s, n in sizes.items())
    assert mixing.targets({}, {}) == {} and mixing.targets({"a": 0}, {"a": 1}) == {"a": 0.0}
    assert mixing.by_code_point(["b", None, "é", "a", "Z"]) == ["Z", "a", "b", "é", None]


def test_flow_repeats_last():
    """Overlapping patterns: nothing is used twice while another is unused, and no
    cheaper routing exists on small cases."""
    rng = random.Random(2)
    for _ in range(30):
        pats = {p: rng.randint(0, 4) for p in (("a",), ("b",), ("a", "b"))}
        quotas = {"a": rng.randint(0, 8), "b": rng.randint(0, 8)}
        got = mixing.route(pats, quotas)
        into = Counter()
        for by in got.values():
            into.update(by)
        used = {p: sum(by.values()) for p, by in got.items()}
        assert all(into[s] <= q for s, q in quotas.items()) and all(used[p] <= 2 * n for p, n in pats.items())
        best = None
        for x in range(2 * pats["a",] + 1):
            for y in range(2 * pats["b",] + 1):
                for za in range(2 * pats["a", "b"] + 1):
                    for zb in range(2 * pats["a", "b"] + 1 - za):
                        if x + za <= quotas["a"] and y + zb <= quotas["b"]:
                            cost = sum(max(0, u - n) for u, n in ((x, pats["a",]), (y, pats["b",]), (za + zb, pats["a", "b"])))
                            best = min(best or (0, 0), (-(x + y + za + zb), cost))
        assert best == (-sum(used.values()), sum(max(0, used[p] - n) for p, n in pats.items()))


def test_mix(spark):
    rng = random.Random(3)
    rows = [(k, sentence(rng, rng.randint(0, 60)), rng.choice(["s1", "s1", "s1", "s2", "é", None]), "x") for k in range(900)]
    rows += [rows[0], (None, "no id", "s1", "x"), (5, None, None, "x"), (6, "", "s9", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string")
    got = mixing.mix(df)
    want_sizes = Counter()
    for _, t, s, _ in rows:
        want_sizes[s] += len((t or "").split())
    assert rows_of(got, "doc_id", "size") == sorted(((i, len((t or "").split())) for i, t, _, _ in rows), key=repr)
    assert rows_of(mixing.mix(df.repartition(7)), *got.columns) == rows_of(got, *got.columns)
    odd = mixing.mix(df.withColumn("__sk_k1", F.lit("mine")))
    assert odd.columns == got.columns and rows_of(odd, *got.columns) == rows_of(got, *got.columns)
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(mixing.by_code_point(want_sizes))}
    want = mixing.targets(want_sizes, weights)
    taken = Counter()
    for r in got.collect():
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    for s, n in want_sizes.items():
        assert abs(taken[n, round(want[s], 6)] - want[s]) <= 2
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("shuffled", [False, True])
def test_mix_overlapping(spark, monkeypatch, shuffled):
    """Every source gets its quota, whichever patterns its documents belong to."""
    if shuffled:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rng = random.Random(12)
    patterns = [["a"], ["b"], ["a", "b"], ["c", "b"], [None, "a"], ["a", "b", "c"]]
    rows = [(k, rng.randint(0, 40), rng.choice(patterns)) for k in range(600)]
    weights = {"a": 1, "b": 3, "c": 2, None: 1}
    got = mixing.mix_overlapping(spark.createDataFrame(rows, "doc_id bigint, size bigint, sources array<string>"), weights, 1.0).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(600))
    into, sizes = Counter(), Counter()
    for r in got:
        assert sum(u["copies"] for u in r["uses"]) == r["copies"] <= 2 and {u["source"] for u in r["uses"]} <= set(r["sources"])
        for u in r["uses"]:
            into[u["source"]] += u["copies"] * r["size"]
        for s in set(r["sources"]):
            sizes[s] += r["size"]
    total = sum(r[1] for r in rows)
    want = mixing.targets(sizes, weights, total / sum(sizes.values()))
    tokens = Counter()
    for _, n, p in rows:
        tokens[tuple(mixing.by_code_point(p))] += n
    routed = Counter()
    for by in mixing.route(dict(tokens), mixing.whole(want)).values():
        routed.update(by)
    for s in sizes:
        assert abs(routed[s] - want[s]) <= 1 and abs(into[s] - want[s]) <= 40 * 2


def test_mix_passes_over_a_document_that_does_not_fit(spark):
    """One document holds half of its pattern; its place in the order leaves no gap."""
    rows = [(k, 1000 if k == 0 else 10, "p") for k in range(101)]
    sized = spark.createDataFrame(rows, "doc_id bigint, size bigint, __sk_pattern string")
    for seed in range(4):
        got = mixing.select(sized, {"p": (2000, 800)}, seed).agg(F.sum(F.col("copies") * F.col("size"))).first()[0]
        assert got == 800


def test_take_mix(spark):
    docs = documents(spark)
    got = mixing.take_mix(spark, docs, "")
    assert got.columns == docs.columns
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in got.collect()) == +want


@pytest.mark.parametrize("text", [None, "", " ", "a", " a\x0bb\x0cc\r\n d\x1ce ", "é x y"])
def test_word_count(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(mixing.n_words(F.col("t"))).first()[0]
    assert got == len((text or "").encode().split())


# ------------------------------------------------------------------ toxicity
def test_index_is_exact():
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(700):
        ids = rng.choice(40, rng.integers(1, 6), replace=False)
        w = rng.random(len(ids)) + 0.1
        vectors.append(dict(zip(ids.tolist(), (w / np.sqrt((w * w).sum())).tolist(), strict=True)))
    vectors += vectors[:20]  # ties
    index = toxicity.Index(vectors)
    for q in vectors[::35] + [{99: 1.0}, {}]:
        cos = np.array([sum(w * v.get(t, 0.0) for t, w in q.items()) for v in vectors])
        ids, found = index.nearest(q, 10)
        if not (cos > 0).any():
            assert len(ids) == 0
            continue
        kth = np.sort(cos)[-10]
        want = set(np.flatnonzero((cos >= max(kth, 1e-15) - 1e-12) & (cos > 0)).tolist())
        assert set(ids.tolist()) == want and np.allclose(sorted(found), sorted(cos[list(want)]))


def test_isotonic():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1 and 0.5 in y


def toxic_docs(spark, n=400):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(n):
        w = sentence(rng, 40).split()
        bad = k % 7 == 0
        if bad:
            for word in rng.sample(["vile", "filth", "scum", "rotten"], 2):
                w.insert(rng.randrange(len(w)), word)
        rows.append((k, " ".join(w), "other"))
        labels.append((k, int(bad), 1))
    rows += [(None, None, "x"), (n, "", "x"), (n + 1, "scum and filth", "x"), rows[0]]
    labels += [(None, 1, 1), (3, None, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int")


def test_toxicity(spark):
    docs, labels = toxic_docs(spark)
    got = toxicity.score_documents(docs, labels)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    named = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    held = [k for k in range(400) if named[k]["held_out"]]
    assert sum(named[k]["predicted"] == (k % 7 == 0) for k in held) / len(held) > 0.97
    assert named[401]["predicted"] == 1 and named[400]["predicted"] == 0 and named[401]["evidence_doc"] % 7 == 0
    again = toxicity.score_documents(docs.repartition(5), labels.repartition(3))
    assert rows_of(again, "doc_id", "score") == rows_of(got, "doc_id", "score")


def test_toxicity_without_two_classes(spark):
    docs, labels = toxic_docs(spark, 30)
    assert {r["score"] for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score_documents(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("text", ["", None, "One one, ONE two-three; x3y a_b", "ΣΑΣ Straße İx", "the of\x0bthe\u2003of|of"])
def test_vectors_are_of_terms(text, monkeypatch):
    monkeypatch.setattr(toxicity, "WORDS_KEPT", 3)
    read = toxicity.Reader(["one", "of"])
    for _ in range(3):
        buckets, counts, ids, ns = read.vector(text)
        want = Counter()
        for t, n in toxicity.terms(text).items():
            want[read.code(t) % toxicity.WIDTH] += n
        assert dict(zip(buckets.tolist(), counts.tolist(), strict=True)) == want and (np.diff(buckets) > 0).all()
        assert dict(zip(ids.tolist(), ns.tolist(), strict=True)) == {k: toxicity.terms(text)[w] for k, w in enumerate(["one", "of"]) if toxicity.terms(text)[w]}


@pytest.mark.parametrize("head", [4, 2048])
@pytest.mark.parametrize("block", [8, 64, 1000])
def test_wide_search_is_exact(block, head, monkeypatch):
    monkeypatch.setattr(toxicity, "HEAD", head)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{'abcdefghij'[a]}{'klmnopqrst'[b]}" for a, b in rng.integers(0, 10, (rng.integers(1, 30), 2)) ** 2 // 10) for _ in range(400)]
    read = toxicity.Reader()
    hashes = [read.vector(t)[:2] for t in [*texts, *texts[:9]]]
    df = np.ones(toxicity.WIDTH, np.int32)
    for b in set().union(*(b.tolist() for b, _ in hashes)):
        df[b] = sum(b in h for h, _ in hashes)
    rows = [(k, *h, k % 2) for k, h in enumerate(hashes)]
    wide = toxicity.Wide(rows, df, len(rows), 0.5, k=10, block=block)

    def unit(b, n):
        w = {int(x): (1 + np.log(c)) * (np.log((1 + len(rows)) / (1 + df[x])) + 1) for x, c in zip(b, n, strict=True)}
        return {x: v / np.sqrt(sum(u * u for u in w.values())) for x, v in w.items()}

    vectors = [unit(*h) for h in hashes]
    queries = [*hashes[::40], read.vector("")[:2], read.vector("unseen wkk")[:2]]
    for q, (ids, found) in zip(queries, wide.nearest(queries), strict=True):
        cos = np.array([sum(w * v.get(t, 0.0) for t, w in unit(*q).items()) for v in vectors])
        kth = np.sort(cos)[-10]
        want = sorted(cos[(cos >= kth - 1e-12) & (cos > 0)])
        assert np.allclose(sorted(np.repeat(found, wide.counts[ids].astype(int))), want)


def test_toxicity_of_texts_without_vocabulary(spark):
    """Terms of too few examples to be in the vocabulary find their neighbours."""
    docs, labels = toxic_docs(spark)
    more = [(1000 + k, f"{w} " * 3 + "grobnik zwarble", "x") for k, w in enumerate(["snargle", "snargle", "flimp"])]
    train = [r[0] for r in more if zlib.crc32(str(r[0]).encode()) % 5][:1]
    docs = docs.union(spark.createDataFrame(more + [(2000, "snargle grobnik zwarble", "x"), (2001, "quite unseen", "x")], docs.schema))
    labels = labels.union(spark.createDataFrame([(i, 1, 1) for i in train], labels.schema))
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    assert got[2000]["evidence_doc"] == train[0] and got[2000]["evidence_cosine"] > 0.5
    assert got[2000]["score"] > got[2001]["score"] and got[2001]["evidence_doc"] is None


# -------------------------------------------------------------------- tokens
ODD = ["don't I'LL 's x'T", "a<|endoftext|>b", "İstanbul ΣΑΣ", "éa ́x", "A1b2 3.14 ...!? a.b, c..", "\x1c\x85 q\x0bw", "日本語 テスト", "foo_bar%%% it's- `a`'re", "ÿÞþ ÷×ß Ýý"]


def test_ids_are_the_librarys(spark):
    e = tokens.Encoder(tokens.tokenizer_path(), words_kept=50)
    assert e.words and e.dtype.itemsize == 2
    for _, t in [*pairs(documents(spark)), *enumerate(ODD)]:
        assert np.frombuffer(e.ids(t), e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = documents(spark, ODD)
    t = Tokenizer.from_file(tokens.tokenizer_path())
    got = tokens.encode_documents(docs, length=64, keep=f"file://{tmp_path}/files").collect()
    mark = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(t.encode(), 42) >> 63 else 0)
    want = sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0, mark(r[1]), r[1]))
    ids = [t.encode(x, add_special_tokens=False).ids + [1] for _, x in want]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [i for i, _ in want]
    start = 0
    for r, i in zip(sorted(got, key=lambda r: r["start"]), ids, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(i), zlib.crc32(np.array(i, "<u4").tobytes()))
        start += len(i)
    shards = sorted(p.stem for p in (tmp_path / "files").glob("*.arrows"))
    assert len({x[:12] for x in shards}) == len(shards)
    flat = []
    for k in shards:
        s = tokens.Shard(f"{tmp_path}/files", k)
        n = sum(s.batch(b).num_rows for b in range(s.file.num_record_batches))
        for i in (*range(min(3, n)), n - 1):
            seq, mask = s.sequence(i)
            assert len(seq) == len(mask) == 64 and not seq.flags.owndata and (i < n - 1) <= mask.true_count // 64
        own = np.concatenate([s.sequence(i)[0] for i in range(n)])
        flat += own[: s.n_valid()].tolist()
    assert flat == [x for i in ids for x in i]


def test_one_id_in_many_shards(spark, tmp_path, monkeypatch):
    """A third of all rows without an id: they are dealt to several shards, and what a
    lost attempt left goes."""
    monkeypatch.setattr(tokens, "LEAST_BYTES", 4000)
    docs = spark.createDataFrame([(None if k % 3 == 0 else k, f"text {k} stands here") for k in range(1500)], "doc_id bigint, text string")
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "shard-000000-999999.arrows").write_bytes(b"left over")
    got = tokens.encode_documents(docs, keep=f"file://{tmp_path}/files").collect()
    assert sorted(r["doc_id"] is None for r in got) == [False] * 1000 + [True] * 500
    at = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in got)
    assert all(a[0] + a[1] == b[0] for a, b in zip(at, at[1:])) and [d for *_, d in at] == [None] * 500 + [k for k in range(1500) if k % 3]
    shards = [tokens.Shard(f"{tmp_path}/files", p.stem) for p in (tmp_path / "files").glob("*.arrows")]
    assert len(shards) == 4 and sum(s.docs["doc_id"][0].as_py() is None for s in shards) >= 2


def test_tokens_of_nothing_and_other_tokenizer(spark):
    docs = documents(spark)
    assert tokens.encode_documents(docs.limit(0)).count() == 0
    other = tokens.tokenizer_path("byte_bpe_50k.json")
    assert not tokens.by_words(other)
    got = tokens.encode_documents(docs.where("doc_id < 8"), path=other)
    assert got.count() == docs.where("doc_id < 8").count()


def test_packing_is_gapless():
    sink = pa.BufferOutputStream()
    w = tokens.ShardWriter(sink, 8, np.dtype("<u2"))
    for n in (0, 3, 5000, 1, 7):
        w.add(np.arange(n, dtype="<u2").tobytes())
    w.close()
    f = pa.ipc.open_file(sink.getvalue())
    sizes = [f.get_batch(k).num_rows for k in range(f.num_record_batches)]
    assert set(sizes[:-1]) <= {tokens.BATCH} and sum(sizes) == -(-5011 // 8)


# ------------------------------------------------------------------ pipeline
def test_votes_are_of_brute_force_neighbours(spark):
    """Both votes of every document, by full cosines to all examples."""
    docs, labels = toxic_docs(spark, 150)
    texts, y = common.doc_texts(docs), toxicity.examples_of(labels)
    words = toxicity.vocabulary(texts, y)
    made = toxicity.vectors(texts, words)
    rows = made.collect()
    got = toxicity.both_votes(made, toxicity.indexes(made, y, words, len(rows))).collect()
    label = {r["doc_id"]: r["toxic"] for r in y.collect()}
    prior = np.mean([label[i] for i in {(r["doc_id"], tuple(r["buckets"]), tuple(r["tfs"])): r["doc_id"] for r in rows if r["doc_id"] in label}.values()])
    assert len(words) > 2 and len(got) == len(rows)

    def unit(keys, counts, df):
        w = {k: (1 + np.log(c)) * (np.log((1 + len(rows)) / (1 + df[k])) + 1) for k, c in zip(keys, counts, strict=True)}
        size = np.sqrt(sum(x * x for x in w.values()))
        return {k: x / size for k, x in w.items()}

    for keys, counts, name, k, power in (("buckets", "tfs", "wide", toxicity.WIDE_NEIGHBOURS, 1), ("ids", "ns", "narrow", toxicity.NEIGHBOURS, 4)):
        df = Counter(x for r in rows for x in r[keys])
        vectors = [unit(r[keys], r[counts], df) for r in rows]
        known = {(r["doc_id"], tuple(r["buckets"]), tuple(r["tfs"])): v for r, v in zip(rows, vectors, strict=True) if r["doc_id"] in label and v}
        for r, v, g in zip(rows, vectors, got, strict=True):
            cos = np.array([sum(x * u.get(t, 0.0) for t, x in v.items()) for u in known.values()])
            if not v or not (cos > 1e-12).any():
                assert g[name] is None or g[name] == pytest.approx(prior)
                continue
            kth = np.sort(cos)[-k] if len(cos) >= k else 0
            hit = (cos >= kth - 1e-9) & (cos > 1e-12)
            w, ys = cos[hit] ** power, np.array([label[i] for (i, *_), h in zip(known, hit, strict=True) if h])
            share = min(1.0, k / hit.sum())
            want = (share * (w * ys).sum() + toxicity.PRIOR_WEIGHT * prior) / (share * w.sum() + toxicity.PRIOR_WEIGHT)
            assert g[name] == pytest.approx(want, abs=1e-6)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(6)
    good = [" ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{j % 7}" for j in range(90)) for _ in range(120)]
    item = " ".join(good[11].split()[20:50])
    good[12] = good[12] + " " + item
    bad = [" ".join(f"{w}###" for w in g.split()) for g in good[:60]]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(good + bad + [good[5], good[5], None, ""])] + [(None, good[7], None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 120), 0) for k in range(180)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "mixing", "token_ids"]
    now, tables = docs, [rows]
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        tables.append([tuple(r) for r in now.collect()])
        if name != "token_ids":
            assert now.columns == docs.columns
    first, kept, alone, clean, mixed, written = tables
    # quality: 50 words, and not of the junk that the labels mark
    assert sorted(kept, key=repr) == sorted((r for r in first if len((r[1] or "").split()) >= 50 and "###" not in r[1]), key=repr) and len(kept) == 123
    # near-duplicates: of each brute-force component the smallest id
    root = brute_components([brute_print(r[1]) for r in kept])
    group = {}
    for r in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0)):
        group.setdefault(root[brute_print(r[1])], r)
    assert sorted(alone, key=repr) == sorted(group.values(), key=repr) and len(alone) == 120
    # decontamination: no document holds the item, by all shingles
    dirty = {i for i, *_ in held([(r[0], r[1]) for r in alone], [(0, item)])}
    assert sorted(clean, key=repr) == sorted((r for r in alone if r[0] not in dirty), key=repr) and dirty == {11, 12}
    # mixing: whole rows, twice at most, each source near its target by the contract
    assert set(mixed) <= set(clean) and max(Counter(mixed).values()) <= 2
    sizes, taken = Counter(), Counter()
    for r in clean:
        sizes[r[3]] += len(r[1].split())
    for r in mixed:
        taken[r[3]] += len(r[1].split())
    want = mixing.targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(mixing.by_code_point(sizes))})
    assert all(abs(taken[s] - want[s]) <= 90 for s in sizes)
    # tokens: the library's ids of every row, in order of ids
    t = Tokenizer.from_file(tokens.tokenizer_path())
    ids = [t.encode(r[1], add_special_tokens=False).ids + [1] for r in sorted(mixed, key=lambda r: (r[0] is not None, r[0] or 0))]
    at = sorted(written, key=lambda r: r[1])
    assert [r[2] for r in at] == [len(x) for x in ids] and [r[3] for r in at] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    run = corpus_pipeline.run(spark, str(tmp_path))
    cols = [c for c in run.columns if c != "files"]
    assert rows_of(run, *cols) == rows_of(now, *cols) and len(cols) == 4
    folder = run.first()["files"].removeprefix("file://")
    assert sum(r["n_tokens"] for r in run.collect()) == sum(tokens.Shard(folder, p.stem).n_valid() for p in pathlib.Path(folder).glob("*.arrows"))
