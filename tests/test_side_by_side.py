"""Files read side by side, gzip files of several members, the memo's hot keys, large
sheets and targets of many parts."""

import gzip
import json
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.operators import matcher, seeds
from skein.operators import samples as samples_module
from skein.operators.samples import Sample, SampleGroup
from skein.plans.demux import Demux, sets_of
from skein.plans.structure import ReadStructure
from skein.plans.subsample import Subsample
from skein.sources import fastq as fastq_source
from skein.sources import sinks
from skein.sources.fastq import read_fastq, splits_of
from skein.sources.sinks import END_BLOCK, bgzf_block, finish, write_fastq
from skein.sources.zipped import FIELDS, read_sets_of

from .test_demux import fastq_text, lines, sheet
from .test_matching import group


def members(text, rng, level=6):
    """A gzip file of several members that end anywhere."""
    out, at = [], 0
    while at < len(text):
        n = rng.randint(200, 2500)
        out.append(gzip.compress(text[at : at + n], level))
        at += n
    return b"".join(out)


def blocks(text):
    return b"".join(bgzf_block(text[at : at + 700], 5) for at in range(0, len(text), 700)) + END_BLOCK


# ------------------------------------------------------------------------ members
@pytest.mark.parametrize("split_bytes", [400, 4000])
def test_members_are_split(spark, tmp_path, split_bytes):
    rng = random.Random(split_bytes)
    text = fastq_text(rng, 300)
    (tmp_path / "a.fq.gz").write_bytes(members(text, rng))
    (tmp_path / "zeros.fq.gz").write_bytes(members(text[:3000], rng) + b"\0" * 300)
    (tmp_path / "stored.fq.gz").write_bytes(members(text, rng, 0))
    paths = [str(tmp_path / n) for n in ("a.fq.gz", "zeros.fq.gz", "stored.fq.gz")]
    (tmp_path / "cut.fq").write_bytes(text[:3000])
    if text[:3000].count(b"\n") % 4 or text[2999:3000] != b"\n":
        paths.pop(1)
    many = Counter(s.path for s in splits_of(spark, paths, split_bytes))
    assert all(n > 2 for n in many.values())
    key = ["file_idx", "ord"]
    got = [tuple(r) for r in read_fastq(spark, paths, split_bytes).orderBy(*key).collect()]
    assert got == [tuple(r) for r in read_fastq(spark, paths, 1 << 30).orderBy(*key).collect()] and len(got) >= 600


def test_one_member_is_not_split(spark, tmp_path):
    text = fastq_text(random.Random(2), 200)
    (tmp_path / "a.fq.gz").write_bytes(gzip.compress(text))
    assert [s.kind for s in splits_of(spark, [str(tmp_path / "a.fq.gz")], 300)] == ["whole"]


def test_what_looks_like_a_member_is_none(spark, tmp_path):
    """A whole gzip file stands inside a stored member: the count from the start runs over
    it, so the file is taken whole."""
    inner = next(x for n in range(1, 99) if b"\n" not in (x := gzip.compress(b"@r\nACGT\n+\n;;;;\n" * n, mtime=0)))
    text = b"@" + inner + b"\nA\n+\n;\n" + fastq_text(random.Random(3), 3)
    (tmp_path / "a.fq.gz").write_bytes(gzip.compress(text, 0))
    path = str(tmp_path / "a.fq.gz")
    assert [s.kind for s in splits_of(spark, [path], 10)] == ["whole"]
    assert read_fastq(spark, [path], 10).count() == 4


def test_damaged_members_are_refused(spark, tmp_path):
    rng = random.Random(4)
    data = bytearray(members(fastq_text(rng, 300), rng))
    data[len(data) // 2] ^= 255
    (tmp_path / "a.fq.gz").write_bytes(bytes(data))
    with pytest.raises(Exception):
        read_fastq(spark, [str(tmp_path / "a.fq.gz")], 700).collect()


# ------------------------------------------------------------------- side by side
STRUCTURES = [ReadStructure.parse("+T"), ReadStructure.parse("+T"), ReadStructure.parse("+T")]


def three(tmp_path, sizes=(200, 200, 200), seed=5):
    rng = random.Random(seed)
    texts = [fastq_text(rng, n) for n in sizes]
    for name, data in zip(("a.fq", "b.fq.gz", "c.fq.gz"), (texts[0], blocks(texts[1]), members(texts[2], rng)), strict=True):
        (tmp_path / name).write_bytes(data)
    return [str(tmp_path / n) for n in ("a.fq", "b.fq.gz", "c.fq.gz")]


@pytest.mark.parametrize("split_bytes", [300, 2000, 1 << 30])
@pytest.mark.parametrize("sizes", [(200, 200, 200), (200, 150, 3), (1, 90, 200), (0, 40, 40)])
def test_sets_are_those_of_the_join(spark, tmp_path, split_bytes, sizes):
    paths = three(tmp_path, sizes)
    rows = read_sets_of(spark, paths, FIELDS, split_bytes)
    got = [tuple(r) for r in rows.orderBy("ord").collect()]
    by = {}
    for r in read_fastq(spark, paths, 1 << 30).collect():
        by[r["file_idx"], r["ord"]] = (r["header"], r["seq"], r["qual"], r["raw_plus"], r["ends"])
    none = (None,) * 5
    assert got == [(k, *(x for f in range(3) for x in by.get((f, k), none))) for k in range(max(sizes))]


def test_no_exchange_before_matching(spark, tmp_path):
    paths = three(tmp_path)
    sets = sets_of(spark, paths, STRUCTURES, True, f"file://{tmp_path}/x", 500)
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and sets.rdd.getNumPartitions() > 5
    assert [r["ord"] for r in sets.collect()] == list(range(200)) or sets.where("skip_reason is null").count() > 0
    (tmp_path / "one.fq.gz").write_bytes(gzip.compress(fastq_text(random.Random(6), 200)))
    joined = sets_of(spark, [paths[0], str(tmp_path / "one.fq.gz")], STRUCTURES[:2], True, f"file://{tmp_path}/y", 500)
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()


def reads(path, bases, kind=0):
    text = "".join(f"@r{k} x\n{b}\n+\n{';' * len(b)}\n" for k, b in enumerate(bases)).encode()
    path.write_bytes([text, blocks(text), members(text, random.Random(1)), gzip.compress(text)][kind])
    return str(path)


@pytest.mark.parametrize("kinds", [(0, 1), (2, 2), (3, 0)])
def test_demux_of_many_ranges(spark, tmp_path, kinds):
    """Skipped sets, an index file, all kinds of files: the same files as in one range."""
    rng = random.Random(7)
    bars = ["ACGTAC", "TTTTGG", "GGCCAA"]
    index = [rng.choice([*bars, "CCCCCC"]) for _ in range(400)]
    bases = ["".join(rng.choice("ACGT") for _ in range(rng.choice([0, 30, 40]))) for _ in range(400)]
    ins = [reads(tmp_path / "i.fq", index, kinds[0]), reads(tmp_path / "r.fq", bases, kinds[1])]
    out = []
    for k, split_bytes in enumerate((400, 1 << 30)):
        d = Demux(ins, ["6B", "+T"], sheet(tmp_path / "s.tsv", bars), str(tmp_path / f"o{k}"), output_types="TB", skip_reasons=["too-few-bases"], split_bytes=split_bytes)
        m = d.execute(spark)
        out.append(({p.name: gzip.decompress(p.read_bytes()) if p.suffix == ".gz" else p.read_bytes() for p in sorted((tmp_path / f"o{k}").iterdir())}, d.skipped, m.collect()))
    assert out[0] == out[1] and out[0][1] == {"too-few-bases": sum(not b for b in bases)}
    want = [i for i, b in zip(index, bases, strict=True) if b and i == bars[1]]
    assert lines(tmp_path / "o0" / "Sample0001.I1.fq.gz")[1::4] == want


def test_out_of_sync_in_a_later_range(spark, tmp_path):
    ins = [reads(tmp_path / "i.fq", ["ACGTAC"] * 300), reads(tmp_path / "r.fq", ["ACGT"] * 290)]
    with pytest.raises(Exception, match="out of sync"):
        Demux(ins, ["6B", "+T"], sheet(tmp_path / "s.tsv", ["ACGTAC"]), str(tmp_path / "o"), split_bytes=500).execute(spark)


@pytest.mark.parametrize("kinds", [(0, 1), (3, 0)])
def test_subsample_of_many_ranges(spark, tmp_path, kinds):
    rng = random.Random(8)
    bases = [["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 40))) for _ in range(500)] for _ in range(2)]
    ins = [reads(tmp_path / f"{k}.fq", b, kinds[k]) for k, b in enumerate(bases)]
    said = [Subsample(ins, str(tmp_path / f"o{k}"), 0.4, seed=3, split_bytes=b).execute(spark) for k, b in enumerate((600, 1 << 30))]
    assert said[0] == said[1] and said[0][0] == 500
    for r in (1, 2):
        got = lines(tmp_path / f"o0.R{r}.fq.gz")
        assert got == lines(tmp_path / f"o1.R{r}.fq.gz") and len(got) == 4 * said[0][1]
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith(".")) == []


def test_progress_is_told(spark, tmp_path, caplog):
    """A line for each so many records, of one scan of the inputs."""
    ins = [reads(tmp_path / f"{k}.fq", ["ACGTAC"] * 950) for k in range(2)]
    with caplog.at_level("INFO"):
        Subsample(ins, str(tmp_path / "o"), 0.4, seed=3, split_bytes=2000, log_every=300).execute(spark)
        Demux(ins, ["6B", "+T"], sheet(tmp_path / "s.tsv", ["ACGTAC"]), str(tmp_path / "d"), split_bytes=2000, log_every=400).execute(spark)
    said = [m for m in caplog.messages if m.endswith("processed")]
    assert said == ["300 record sets processed", "600 record sets processed", "900 record sets processed", "400 records processed", "800 records processed"]


def test_subsample_mistakes_leave_no_file(spark, tmp_path):
    ins = [reads(tmp_path / "a.fq", ["ACGT"] * 300), reads(tmp_path / "b.fq", ["ACGT"] * 299)]
    with pytest.raises(ValueError, match="1 of 2 files had a record at read 300"):
        Subsample(ins, str(tmp_path / "o"), 0.5, split_bytes=500).execute(spark)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.fq", "b.fq"]


# ------------------------------------------------------------------------ matching
def test_hot_barcodes_make_no_long_task(spark):
    """60 % of reads have one barcode, 30 % none; where the memo can't be broadcast, the
    reads are dealt evenly all the same."""
    rng = random.Random(9)
    bars = ["".join(rng.choice("ACGT") for _ in range(8)) for _ in range(40)]
    rows = [(k, None if k % 10 >= 7 else bars[0] if k % 10 >= 1 else rng.choice(bars)) for k in range(40_000)]
    df = spark.createDataFrame(rows, "ord long, obs string").repartition(8)
    g = SampleGroup.from_samples(Sample(f"s{k}", b) for k, b in enumerate(sorted(set(bars))))
    memo = matcher.memo_of(df, g.to_df(spark), 8, "obs", 0, 1)
    small, large = matcher.with_matches(df, memo), matcher.with_matches(df, memo, broadcast_bytes=0)
    assert sorted(small.collect()) == sorted(large.collect())
    assert "SortMergeJoin" not in small._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        large = matcher.with_matches(df, memo, broadcast_bytes=0)
        sizes = [r["count"] for r in large.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(sizes) <= 2 * statistics.median(sizes)


MASKS = {b: k for k, b in enumerate("ACMGRSVTWYHKDBN", 1)}


def brute_nearest(observed, barcodes, length, most, delta):
    """Every sample for every barcode."""
    ns = max(b.count("N") for b in barcodes)
    out = {}
    for o in observed:
        if len(o) < length or o.count("N") > most + ns:
            continue
        near = sorted((sum((MASKS.get(a, 0) & ~MASKS[b]) != 0 for a, b in zip(o, e, strict=True)), k) for k, e in enumerate(barcodes))
        second = near[1][0] if len(near) > 1 else 255
        if near[0][0] <= most and second - near[0][0] >= delta:
            out[o] = (near[0][1], near[0][0], second)
    return out


@pytest.mark.parametrize("length,n,letters,most,delta", [
    (8, 200, "ACGTRYN", 1, 1), (17, 80, "ACGTACGTACGTACGTRN", 2, 3), (12, 300, "AC", 1, 2), (6, 60, "ACGTN", 0, 0), (10, 60, "NNNACGT", 1, 2), (4, 30, "ACGT", 2, 2), (9, 1, "ACGT", 1, 2),
])
def test_seeds_find_the_best_two(spark, monkeypatch, length, n, letters, most, delta):
    monkeypatch.setattr(seeds, "BLOCK", 7)
    rng = random.Random(length)
    barcodes = sorted({"".join(rng.choice(letters) for _ in range(length)) for _ in range(n)})
    observed = {"ACG", "N" * length}
    for e in barcodes * 2:
        o = [c if c in "ACGT" else rng.choice("ACGT") for c in e]
        for _ in range(rng.randint(0, 3)):
            o[rng.randrange(length)] = rng.choice("ACGTNRx")
        observed.add("".join(o))
    df = spark.createDataFrame([(o,) for o in observed], "obs string")
    got = {r["obs"]: tuple(r)[1:] for r in matcher.match_in_large(df, group(*barcodes).to_df(spark), length, most, delta).select("obs", *matcher.RESULT).collect()}
    assert got == brute_nearest(observed, barcodes, length, most, delta)


def test_large_sheets_go_by_seeds(spark, monkeypatch):
    """The same reads and results either way, by shuffled indexes as well."""
    rng = random.Random(11)
    barcodes = sorted({"".join(rng.choice("ACGT") for _ in range(12)) for _ in range(150)})
    rows = [(k, rng.choice([None, "ACG", *barcodes[:5], *("T" + b[1:] for b in barcodes)])) for k in range(900)]
    df, samples = spark.createDataFrame(rows, "ord long, obs string"), group(*barcodes).to_df(spark)
    want = sorted(map(tuple, matcher.match_barcodes(df, samples, 12).collect()), key=repr)
    monkeypatch.setattr(matcher, "FOLD_UP_TO", 10)
    assert sorted(map(tuple, matcher.match_barcodes(df, samples, 12).collect()), key=repr) == want
    monkeypatch.setattr(seeds, "INDEX_BYTES", 0)
    assert sorted(map(tuple, matcher.match_barcodes(df, samples, 12).collect()), key=repr) == want
    with pytest.raises(Exception, match="differs from expected"):
        matcher.match_barcodes(df.unionByName(spark.createDataFrame([(1, "A" * 13)], "ord long, obs string")), samples, 12).collect()


# --------------------------------------------------------------------------- parts
def records(spark, n=200):
    rows = [("t.fq.gz", k, f"@r{k}\nACGT\n+\n;;;;\n") for k in range(n)]
    return spark.createDataFrame(rows, "target string, ord long, record string").repartition(4), "".join(r for *_, r in rows)


def test_a_target_of_200_parts_has_no_copying_task(spark, tmp_path, monkeypatch):
    df, text = records(spark)
    seen, real = [], sinks.placed
    monkeypatch.setattr(sinks, "placed", lambda *a: seen.extend(real(*a)))
    assert write_fastq(df, str(tmp_path), ["t.fq.gz", "u.fq.gz"], chunk_records=1) == {"t.fq.gz": 200, "u.fq.gz": 0}
    assert gzip.decompress((tmp_path / "t.fq.gz").read_bytes()).decode() == text
    assert (tmp_path / "t.fq.gz").read_bytes().count(END_BLOCK) == 1 and (tmp_path / "u.fq.gz").read_bytes() == END_BLOCK
    by_task = Counter(task for *_, task in seen)
    assert len(seen) == 200 and max(by_task.values()) <= 20
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t.fq.gz", "u.fq.gz"]


@pytest.mark.parametrize("when", ["before", "after"])
def test_an_interrupted_commit_is_finished(spark, tmp_path, monkeypatch, when):
    df, text = records(spark, 30)
    real = sinks.placed

    def stopped(*a):
        if when == "after":
            real(*a)
        raise KeyboardInterrupt

    monkeypatch.setattr(sinks, "placed", stopped)
    with pytest.raises(KeyboardInterrupt):
        write_fastq(df, str(tmp_path), ["t.fq.gz"], chunk_records=4)
    monkeypatch.setattr(sinks, "placed", real)
    left = next(p for p in tmp_path.iterdir() if p.name.endswith(".manifest"))
    assert sum(len(v) for v in json.loads(left.read_text()).values()) == 8
    assert finish(spark, str(tmp_path), left.name[len(".skein-") : -len(".manifest")], ["t.fq.gz"]) == {"t.fq.gz": 30}
    assert gzip.decompress((tmp_path / "t.fq.gz").read_bytes()).decode() == text
    assert [p.name for p in tmp_path.iterdir()] == ["t.fq.gz"]


@pytest.mark.parametrize("gone", [1, 4, 8])
def test_finish_after_the_rename(spark, tmp_path, monkeypatch, gone):
    """Parts are partly deleted already: the file stands and is left alone."""
    df, text = records(spark, 30)
    real = sinks._there
    calls = []

    def interrupted(fs, names):
        calls.append(names)
        if len(calls) == 2:
            for n in names[:gone]:
                fs.delete_file(n)
            raise KeyboardInterrupt
        return real(fs, names)

    monkeypatch.setattr(sinks, "_there", interrupted)
    with pytest.raises(KeyboardInterrupt):
        write_fastq(df, str(tmp_path), ["t.fq.gz"], chunk_records=4)
    monkeypatch.setattr(sinks, "_there", real)
    left = next(p for p in tmp_path.iterdir() if p.name.endswith(".manifest"))
    finish(spark, str(tmp_path), left.name[len(".skein-") : -len(".manifest")], ["t.fq.gz"])
    assert gzip.decompress((tmp_path / "t.fq.gz").read_bytes()).decode() == text and [p.name for p in tmp_path.iterdir()] == ["t.fq.gz"]


@pytest.mark.parametrize("concatenates", [True, False])
def test_other_stores(spark, tmp_path, monkeypatch, concatenates):
    """A store that concatenates, and one that does neither."""

    def concat(_, folder, names):
        if concatenates:
            with open(f"{folder}/{names[0]}", "ab") as out:
                for n in names[1:]:
                    out.write(open(f"{folder}/{n}", "rb").read())
            for n in names[1:]:
                (tmp_path / n).unlink()
        return concatenates

    monkeypatch.setattr(sinks, "writes_in_place", lambda fs: False)
    monkeypatch.setattr(sinks, "concatenated", concat)
    df, text = records(spark, 30)
    write_fastq(df, str(tmp_path), ["t.fq.gz", "e.fq.gz"], chunk_records=4)
    assert gzip.decompress((tmp_path / "t.fq.gz").read_bytes()).decode() == text
    assert sorted(p.name for p in tmp_path.iterdir()) == ["e.fq.gz", "t.fq.gz"]
    assert [r["header"] for r in read_fastq(spark, [str(tmp_path / "t.fq.gz")], 200).orderBy("ord").collect()] == [f"r{k}" for k in range(30)]


def test_stores_without_concatenation_say_so(spark, tmp_path):
    for n in "ab":
        (tmp_path / n).write_bytes(b"x")
    assert not sinks.concatenated(spark, str(tmp_path), ["a", "b"])


# -------------------------------------------------------------------- large inputs
@pytest.mark.parametrize("n,k,errors", [(2, 1, 0), (2, 1, 1), (3, 1, 1), (3, 2, 1), (3, 2, 2), (5, 3, 0), (6, 4, 2)])
def test_radius_of_seeds(n, k, errors):
    """Every way to spread that many mismatches over segments, and one more fails."""
    most = seeds.radius_of(n, k, errors)

    def left(r):
        spread = [()]
        for _ in range(n):
            spread = [(*s, x) for s in spread for x in range(r + 1 - sum(s))]
        return max(sum(sorted(s)[:k]) for s in spread if sum(s) == r)

    assert left(most) <= errors < left(most + 1)


def test_larger_sheets_have_longer_seeds():
    """The work for a barcode grows slower than the sheet."""
    kept = [seeds.cheapest(n, n, 15, 2, set()) for n in (150_000, 1_500_000, 9_000_000)]
    longest = [max(sum(size for _, size in seed) for seed in seeds.seeds_of(15, n, k)) for n, k, _ in kept]
    assert longest == sorted(longest)
    assert all(5 * n // 4**size < 1000 for n, size in zip((150_000, 1_500_000, 9_000_000), longest, strict=True))
    assert seeds.cheapest(100, 10, 15, 9, set()) is None


def test_numbered_by_ranges(spark):
    keys = list(range(0, 3000, 3))
    random.Random(5).shuffle(keys)
    got = samples_module.numbered(spark.createDataFrame([(k,) for k in keys], "key long").repartition(7), "key")
    assert sorted(map(tuple, got.select("key", "ordinal").collect())) == [(k, i) for i, k in enumerate(sorted(keys))]
    assert got.select("ordinal").rdd.getNumPartitions() > 1


def test_small_splits_are_few():
    """A file of any size has at most so many splits below the usual size, and is read by as many
    tasks as there are cores; what can't be split doesn't cut the others finer."""
    steps = fastq_source.steps_of([("blocks", 1 << 30), ("plain", 1 << 15)], 1 << 15, 12)
    assert -(-(1 << 30) // steps[0]) <= fastq_source.MOST_SPLITS and steps[1] == 1 << 15
    assert fastq_source.steps_of([("blocks", 1 << 40)], 1 << 15, 12) == [fastq_source.SPLIT_BYTES]
    assert (100 << 20) // fastq_source.steps_of([("blocks", 100 << 20)], fastq_source.SPLIT_BYTES, 12)[0] >= 12
    assert fastq_source.steps_of([("blocks", 100 << 20), ("members", 9)], fastq_source.SPLIT_BYTES, 12) == [fastq_source.SPLIT_BYTES] * 2
