"""Records of a run, routed to their files."""

import gzip

import pytest

from skein.plans import demux, read_queries
from skein.plans.demux import Demux, routed
from skein.sources.sinks import write_fastq


def _matched(spark, headers):
    cut = "array(struct('B' AS kind, 1 AS kind_idx, 'AC' AS seq, ';;' AS qual), struct('M' AS kind, 1 AS kind_idx, 'GT' AS seq, '::' AS qual), struct('T' AS kind, 1 AS kind_idx, 'TTT' AS seq, '!!!' AS qual), struct('T' AS kind, 2 AS kind_idx, 'G' AS seq, '#' AS qual))"
    return spark.createDataFrame(list(enumerate(headers)), "ord bigint, header string").selectExpr("ord", "header", "'s' AS sample_id", f"{cut} AS segments")


def test_headers_are_taken_apart_once_for_each_set(spark):
    plan = routed(_matched(spark, ["q 1:N:0:A1"]), set("TBM"))._jdf.queryExecution().optimizedPlan().toString()
    each_record = plan[: plan.index("Generate")]
    assert "regexp_replace" not in each_record and "regexp_replace" in plan


def test_routed_headers(spark):
    rows = routed(_matched(spark, ["q", "q 1:N:0:A1", "q 1:N", "a:b:c:d:e:f:g:h 1:Y:0:"]), set("TM")).collect()
    said = {(r["ord"], r["kind"], r["kind_idx"]): r["record"].split("\n")[0] for r in rows}
    for kind, k in (("M", 1), ("T", 1), ("T", 2)):
        assert [said[i, kind, k] for i in range(4)] == [f"@q:GT {k}:N:0:AC", f"@q:GT {k}:N:0:A+AC", "@q:GT 1:N:AC", f"@a:b:c:d:e:f:g:h+GT {k}:Y:0:AC"]
    assert len(rows) == 12


def test_a_header_fails_where_a_record_has_it(spark):
    bad = _matched(spark, ["q 1:2:3:4:5"])
    assert routed(bad, set("C")).collect() == []
    with pytest.raises(Exception, match="did not have 4 segments"):
        routed(bad, set("T")).collect()


def test_sets_are_written_where_they_stand(spark, tmp_path, monkeypatch):
    """A row for each set and not for each record, and no shuffle between inputs and files."""
    n, seen, real = 300, {}, demux.write_fastq

    def spy(rows, *args, **options):
        seen.update(plan=rows._jdf.queryExecution().executedPlan().toString(), rows=rows.count())
        return real(rows, *args, **options)

    monkeypatch.setattr(demux, "write_fastq", spy)
    bars = ["AAAA", "CCCC", "GGGG"]
    (tmp_path / "a.fq").write_text("".join(f"@r{k}\n{bars[k % 3]}TTT\n+\n;;;;!!!\n" for k in range(n)))
    (tmp_path / "b.fq").write_text("".join(f"@r{k}\n{'ACGT'[k % 4]}G\n+\n:#\n" for k in range(n)))
    (tmp_path / "s.tsv").write_text("sample_id\tbarcode\nx\tAAAA\ny\tCCCC\n")
    run = Demux([str(tmp_path / "a.fq"), str(tmp_path / "b.fq")], ["4B+T", "1M+T"], str(tmp_path / "s.tsv"), str(tmp_path / "o"), output_types="TBMS", split_bytes=500)
    run.execute(spark)
    assert seen["rows"] == n and "Exchange hash" not in seen["plan"] and "Exchange range" not in seen["plan"]
    for sample, rest in (("x", 0), ("y", 1), ("unmatched", 2)):
        mine = range(rest, n, 3)
        umi = {k: "ACGT"[k % 4] for k in mine}
        for code, number, bases, quals in (("R1", 1, "TTT", "!!!"), ("R2", 2, "G", "#"), ("I1", 1, bars[rest], ";;;;"), ("U1", 1, None, ":")):
            text = "".join(f"@r{k}:{umi[k]} {number}:N:0:{bars[rest]}\n{bases or umi[k]}\n+\n{quals}\n" for k in mine)
            assert gzip.decompress((tmp_path / "o" / f"{sample}.{code}.fq.gz").read_bytes()).decode() == text


def test_parts_that_are_no_ranges_fail(spark, tmp_path):
    rows = spark.createDataFrame([("t.fq.gz", k, f"@r{k}\nA\n+\n;\n") for k in range(40)], "target string, ord long, record string")
    with pytest.raises(Exception, match="stand around it"):
        write_fastq(rows.repartition(4, "ord"), str(tmp_path), ["t.fq.gz"], in_order=True)


def test_inputs_of_runs_shuffle_orders_and_not_their_reads(spark, tmp_path, monkeypatch):
    """Ranges of orders become parts of the files, whatever order the table has."""
    seen, real = [], read_queries.write_fastq

    def spy(rows, *args, **options):
        seen.append((rows._jdf.queryExecution().executedPlan().toString(), options["in_order"]))
        return real(rows, *args, **options)

    monkeypatch.setattr(read_queries, "write_fastq", spy)
    monkeypatch.setattr(read_queries, "CHUNK_RECORDS", 50)
    n = 1000
    (tmp_path / "t").mkdir()
    spark.range(n).selectExpr("(id * 7) % 1000 AS o_orderkey", "id % 30 AS o_custkey").write.parquet(str(tmp_path / "t" / "orders.parquet"))
    paths = read_queries._put_reads(spark, str(tmp_path / "t"), str(tmp_path), one=read_queries.RECORDS_1, two=read_queries.RECORDS_2)
    [(plan, in_order)] = seen
    assert in_order is True and plan.count("rangepartitioning(o_orderkey") >= 2 and "hashpartitioning" not in plan
    for path, sql in zip(paths, (read_queries.RECORDS_1, read_queries.RECORDS_2), strict=True):
        rows = sorted(tuple(r) for r in read_queries.view(spark, str(tmp_path / "t"), sql).collect())
        text = "".join(f"@{header}\n{seq}\n+\n{qual}\n" for _, header, seq, qual in rows)
        with gzip.open(path) as f:
            assert f.read().decode() == text


def test_sets_are_sorted_before_their_records_are_made(spark, tmp_path, monkeypatch):
    seen, real = {}, demux.write_fastq

    def spy(rows, *args, **options):
        seen.update(plan=rows._jdf.queryExecution().optimizedPlan().toString())
        return real(rows, *args, **options)

    monkeypatch.setattr(demux, "write_fastq", spy)
    (tmp_path / "a.fq").write_text("".join(f"@r{k}\n{'AC'[k % 2] * 4}TTT\n+\n;;;;!!!\n" for k in range(50)))
    (tmp_path / "s.tsv").write_text("sample_id\tbarcode\nx\tAAAA\n")
    Demux([str(tmp_path / "a.fq")], ["4B+T"], str(tmp_path / "s.tsv"), str(tmp_path / "o")).execute(spark)
    assert "Sort [best_ordinal" in seen["plan"] and "regexp_replace" not in seen["plan"][seen["plan"].index("Sort [best_ordinal") :]
    assert gzip.decompress((tmp_path / "o" / "x.R1.fq.gz").read_bytes()).decode() == "".join(f"@r{k} 1:N:0:AAAA\nTTT\n+\n!!!\n" for k in range(0, 50, 2))
