import pytest
from pyspark.sql import functions as F

from skein.operators import matcher, metrics
from skein.operators.samples import Sample, SampleGroup, header_line
from skein.streaming.assign import assign_stream


def group(*barcodes):
    return SampleGroup.from_samples(Sample(f"Sample{k:04d}", b) for k, b in enumerate(barcodes))


#: observed, sheet, most mismatches, least delta, (index, best, next) or None
VECTORS = [
    ("ACGT", "ACGT AAAG CACA", 2, 2, (0, 0, 3)),
    ("GAAT", "AAAT AGAG CACA", 2, 2, (0, 1, 3)),
    ("NAAT", "AAAT AGAG CACA", 2, 2, (0, 1, 3)),
    ("NAGTTT", "AAATTT AGAGGG CACAGG", 2, 2, (0, 2, 5)),
    ("AAATTT", "NAGTTT AGAGGG CACAGG", 1, 2, (0, 1, 4)),
    ("NAGTTT", "AAATTT AGAGGG CACAGG", 1, 2, None),
    ("ATCGATC", "AAGCTAG CAGCTAG GAGCTAG TAGCTAG", 0, 100, None),
    ("GGGGGGTT", "AAAAAAAA CCCCCCCC GGGGGGGG GGGGGGTT", 100, 3, None),
    ("GGGGGGTN", "AAAAAAAA CCCCCCCC GGGGGGGG GGGGGGTT", 0, 100, None),
    ("NNNN", "NNNN", 0, 2, (0, 0, 255)),
    ("ACG", "ACGT", 1, 1, None),
    ("AAAAAAAAGATTACAGA", "AAAAAAAAGATTACAGA CCCCCCCCGATTACAGA GGGGGGGGGATTACAGA GGGGGGTTGATTACAGA", 1, 2, (0, 0, 8)),
]


@pytest.mark.parametrize("obs,sheet,most,delta,want", VECTORS)
def test_vectors(spark, obs, sheet, most, delta, want):
    g = group(*sheet.split())
    r = matcher.match_group(spark.createDataFrame([(obs,)], "obs string"), g, max_mismatches=most, min_delta=delta).first()
    got = None if r["best_ordinal"] is None else (r["best_ordinal"], r["best_mismatches"], r["next_best_mismatches"])
    assert got == want


def test_longer_barcode_fails_unless_prefiltered(spark):
    g = group("ACGT", "TTTT")
    with pytest.raises(Exception, match="differs from expected"):
        matcher.match_group(spark.createDataFrame([("ACGTA",)], "obs string"), g).collect()
    assert matcher.match_group(spark.createDataFrame([("NNNNN",)], "obs string"), g).first()["best_ordinal"] is None


def test_repeated_null_and_empty_reads(spark):
    g = group("ACGT", "TTTT")
    rows = [(1, "ACGT"), (2, "ACGT"), (3, None), (4, ""), (5, "TTTT")]
    got = {r["ord"]: r["best_ordinal"] for r in matcher.match_group(spark.createDataFrame(rows, "ord long, obs string"), g).collect()}
    assert got == {1: 0, 2: 0, 3: None, 4: None, 5: 1}


def test_limits_are_bytes(spark):
    with pytest.raises(ValueError):
        matcher.match_group(spark.createDataFrame([("A",)], "obs string"), group("A"), max_mismatches=256)


def test_metrics(spark):
    g = group("ACGT", "TTTT", "GGGG")
    reads = spark.createDataFrame([("ACGT",)] * 3 + [("TTTT",)] + [("CCCC",)] * 2, "obs string")
    rows = metrics.demux_metrics(matcher.match_group(reads, g), g.to_df(spark)).orderBy("ordinal").collect()
    assert [(r["sample_id"], r["templates"]) for r in rows] == [("Sample0000", 3), ("Sample0001", 1), ("Sample0002", 0), ("unmatched", 2)]
    mean = 4 / 3
    assert [r["frac_templates"] for r in rows] == pytest.approx([0.5, 1 / 6, 0, 1 / 3])
    assert [r["ratio_to_mean"] for r in rows] == pytest.approx([3 / mean, 1 / mean, 0, 2 / mean])
    assert [r["ratio_to_best"] for r in rows] == pytest.approx([1, 1 / 3, 0, 2 / 3])


def test_metrics_of_nothing_and_of_unmatched_only(spark):
    g = group("ACGT")
    none = metrics.metrics_text(metrics.demux_metrics(matcher.match_group(spark.createDataFrame([], "obs string"), g), g.to_df(spark)))
    assert none.splitlines() == ["\t".join(metrics.COLUMNS), "Sample0000\tACGT\t0\tNaN\tNaN\tNaN", "unmatched\t.\t0\tNaN\tNaN\tNaN"]
    only = metrics.metrics_text(metrics.demux_metrics(matcher.match_group(spark.createDataFrame([("TTTT",)], "obs string"), g), g.to_df(spark)))
    assert only.splitlines()[1:] == ["Sample0000\tACGT\t0\t0.0\tNaN\tNaN", "unmatched\t.\t1\t1.0\tinf\tinf"]


def test_plan_has_one_exchange_of_reads_and_no_python(spark):
    g = group("ACGT", "TTTT")
    plan = matcher.match_group(spark.range(10).select(F.lit("ACGT").alias("obs")), g)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_stream(spark, tmp_path):
    g = group("ACGT", "TTTT")
    spark.createDataFrame([(1, "ACGT"), (2, "TTTA"), (3, "CCCC")], "ord long, obs string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ord long, obs string").parquet(str(tmp_path / "in"))
    q = assign_stream(stream, g.to_df(spark), 4).writeStream.format("memory").queryName("assigned").start()
    q.processAllAvailable()
    q.stop()
    assert {r["read"]["ord"]: r["best_ordinal"] for r in spark.table("assigned").collect()} == {1: 0, 2: 1, 3: None}


def test_sample_constraints():
    for args, said in ((("", "A"), "name cannot be empty"), (("a", ""), "barcode cannot be empty"), (("a", "ACx"), "must be one of"), (("a", "acgt"), "must be one of")):
        with pytest.raises(ValueError, match=said):
            Sample(*args)
    Sample("a", "AAn.")
    for rows, said in (
        ([], "one or more sample"), ([("a", "AC"), ("a", "GT")], "name must be unique"),
        ([("a", "AC"), ("b", "AC")], "barcode must be unique"), ([("a", "AC"), ("b", "A")], "same length"),
    ):
        with pytest.raises(ValueError, match=said):
            SampleGroup.from_samples(Sample(*r) for r in rows)


def test_sample_sheet(spark, tmp_path):
    assert header_line() == "sample_id\tbarcode"
    p = tmp_path / "sheet.tsv"
    p.write_text("sample_id\tbarcode\ns1\tACGT\ns2\tTT\"T\n\n".replace('"', "G"))
    g = SampleGroup.from_file(spark, str(p))
    assert [(s.ordinal, s.sample_id, s.barcode) for s in g.samples] == [(0, "s1", "ACGT"), (1, "s2", "TTGT")]
    assert str(g.samples[1]) == "Sample(0001) - { name: s2\tbarcode: TTGT }"
    for text, said in (("", "one or more"), ("sample_id\tbarcode\n", "one or more"), ("name\tbarcode\na\tA\n", "header"), ("sample_id\tbarcode\na\n", "fields")):
        with pytest.raises(ValueError, match=said):
            SampleGroup.from_text(text)
