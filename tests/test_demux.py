import gzip
import random
import re

import pytest

from skein.__main__ import parser
from skein.operators.metrics import read_metrics
from skein.operators.segments import segmented
from skein.plans.demux import Demux, target_files
from skein.plans.structure import ReadStructure, parse_kinds, parse_skip_reason
from skein.sources.fastq import MalformedFastq, read_fastq, splits_of
from skein.sources.folders import shared_folder
from skein.sources.sinks import END_BLOCK, BgzfWriter, bgzf_block, write_fastq

S17 = ["AAAAAAAAGATTACAGA", "CCCCCCCCGATTACAGA", "GGGGGGGGGATTACAGA", "GGGGGGTTGATTACAGA"]


def fastq(path, bases, prefix="ex", zipped=False):
    text = "".join(f"@{prefix}_{k}\n{b}\n+\n{';' * len(b)}\n" for k, b in enumerate(bases)).encode()
    path.write_bytes(gzip.compress(text) if zipped else text)
    return str(path)


def sheet(path, barcodes):
    path.write_text("sample_id\tbarcode\n" + "".join(f"Sample{k:04d}\t{b}\n" for k, b in enumerate(barcodes)))
    return str(path)


def run(spark, tmp_path, structures, files, barcodes, **options):
    ins = [fastq(tmp_path / f"in{k}.fq{'.gz' if k % 2 else ''}", f, zipped=bool(k % 2)) for k, f in enumerate(files)]
    out = tmp_path / "out"
    d = Demux(ins, structures, sheet(tmp_path / "s.tsv", barcodes), str(out), **options)
    return d.execute(spark), out


def lines(path):
    return gzip.decompress(path.read_bytes()).decode().splitlines()


def test_fragment(spark, tmp_path):
    _, out = run(spark, tmp_path, ["17B100T"], [[S17[0] + "A" * 100]], S17)
    assert lines(out / "Sample0000.R1.fq.gz") == ["@ex_0 1:N:0:" + S17[0], "A" * 100, "+", ";" * 100]
    assert lines(out / "unmatched.R1.fq.gz") == []
    assert (out / "Sample0001.R1.fq.gz").read_bytes() == END_BLOCK


def test_all_types(spark, tmp_path):
    _, out = run(spark, tmp_path, ["10M8B7C100T"], [["ATCGATCGAT" + "A" * 8 + "GATTACA" + "A" * 100]], ["A" * 8, "C" * 8, "G" * 8, "T" * 8], output_types="TMBC")
    want = {"R1": "A" * 100, "I1": "A" * 8, "U1": "ATCGATCGAT", "C1": "GATTACA"}
    for code, bases in want.items():
        assert lines(out / f"Sample0000.{code}.fq.gz") == ["@ex_0:ATCGATCGAT 1:N:0:AAAAAAAA", bases, "+", ";" * len(bases)]


def test_catch_all(spark, tmp_path):
    m, out = run(spark, tmp_path, ["7B+T"], [["N" * 7 + "A" * 100]], ["NNNNNNN"], max_mismatches=0)
    assert lines(out / "Sample0000.R1.fq.gz")[1] == "A" * 100 and lines(out / "unmatched.R1.fq.gz") == []


@pytest.mark.parametrize("barcodes,reads,want", [
    (["MMMMMMM", "KKKKKKK"], ["ACACACA", "CACACAC", "AAAAAAA", "GTGTGTG", "TGTGTGT", "AGAGAGA"], [3, 2, 1]),
    (["NNAAAAA", "NNCCCCC"], ["ANAAAAA", "ANCCCCC", "NNNAAAA"], [1, 1, 1]),
])
def test_ambiguous_sheets(spark, tmp_path, barcodes, reads, want):
    m, out = run(spark, tmp_path, ["7B+T"], [[r + "A" * 9 for r in reads]], barcodes, max_mismatches=0, min_mismatch_delta=0)
    assert [r["templates"] for r in m.orderBy("ordinal").collect()] == want
    assert [r["templates"] for r in read_metrics(spark, str(out / "demux-metrics.txt")).collect()] == want


def test_paired_and_dual_index(spark, tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    _, out = run(spark, tmp_path / "a", ["8B100T", "9B100T"], [[S17[0][:8] + "A" * 100], [S17[0][8:] + "T" * 100]], S17)
    assert lines(out / "Sample0000.R2.fq.gz")[:2] == ["@ex_0 2:N:0:AAAAAAAA+GATTACAGA", "T" * 100]
    _, out = run(spark, tmp_path / "b", ["8B", "100T", "100T", "9B"], [[S17[0][:8]], ["A" * 100], ["G" * 100], [S17[0][8:]]], S17)
    assert lines(out / "Sample0000.R1.fq.gz")[:2] == ["@ex_0 1:N:0:AAAAAAAA+GATTACAGA", "A" * 100]


def test_mixed_segments(spark, tmp_path):
    s = S17[0]
    files = [[s[:4] + "CCCC" + "G" * 8], [s[4:8] + "A" * 100], ["C" * 100 + s[8:11]], [s[11:] + "T" + "A" + "G"]]
    _, out = run(spark, tmp_path, ["4B4M8S", "4B100T", "100S3B", "6B1S1M1T"], files, S17)
    assert lines(out / "Sample0000.R1.fq.gz")[:2] == ["@ex_0:CCCC+A 1:N:0:AAAA+AAAA+GAT+TACAGA", "A" * 100]
    assert lines(out / "Sample0000.R2.fq.gz")[:2] == ["@ex_0:CCCC+A 2:N:0:AAAA+AAAA+GAT+TACAGA", "G"]


def test_many_templates_keep_order(spark, tmp_path):
    reads = [S17[k % 2] + "A" * 20 + "C" * 20 + "T" * 20 + "C" * 20 + "G" * 20 for k in range(30)]
    _, out = run(spark, tmp_path, ["17B20T20S20T20S20T"], [reads], S17)
    for code, b in (("R1", "A"), ("R2", "T"), ("R3", "G")):
        got = lines(out / f"Sample0000.{code}.fq.gz")
        assert got[1::4] == [b * 20] * 15 and [x.split()[0] for x in got[::4]] == [f"@ex_{k}" for k in range(0, 30, 2)]


SHORT = (["+T", "7B"], [["A", "A", ""], ["GATTGGG"] * 3], ["GATTGGG"])


def test_too_short(spark, tmp_path, caplog):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    with pytest.raises(Exception, match=re.escape("Read ex_2 had too few bases to demux 0 vs. 1 needed in read structure +T.")):
        run(spark, tmp_path / "a", *SHORT)
    with caplog.at_level("INFO"):
        m, out = run(spark, tmp_path / "b", *SHORT, skip_reasons=["too-few-bases"], output_types="TB")
    assert "1 records skipped: too-few-bases" in caplog.messages and "2 records demultiplexed" in caplog.text and "1 samples read" in caplog.text
    assert sum(r["templates"] for r in m.collect()) == 2
    assert len(lines(out / "Sample0000.R1.fq.gz")) == len(lines(out / "Sample0000.I1.fq.gz")) == 8


def test_out_of_sync(spark, tmp_path):
    with pytest.raises(Exception, match="out of sync"):
        run(spark, tmp_path, ["4B+T", "+T"], [["ACGTA", "ACGTA"], ["A"]], ["ACGT"])


def test_short_qualities(spark):
    reads = spark.createDataFrame([(0, "spot 1", "ACGT", ";;;")], "ord bigint, header string, seq string, qual string")
    with pytest.raises(Exception, match="Read spot has 4 bases and 3 qualities"):
        segmented(reads, ReadStructure.parse("2B+T")).collect()


def test_staged_data_goes(spark, tmp_path):
    d = Demux([fastq(tmp_path / "a.fq", ["ACGTA"] * 3)], ["4B+T"], sheet(tmp_path / "s.tsv", ["ACGT"]), str(tmp_path / "o"), staging=f"file://{tmp_path}/staging")
    assert d.execute(spark).first()["templates"] == 3 and d.skipped == {}
    assert not list((tmp_path / "staging").glob("*"))


def test_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = Context

    with pytest.raises(RuntimeError, match="share"):
        shared_folder(Session)
    assert shared_folder(spark).startswith("file:")


def test_validation(tmp_path):
    d = Demux(["missing.fq"], ["4B+T", "+T"], "s.tsv", str(tmp_path / "o"), output_types="TX", threads=2)
    with pytest.raises(ValueError) as e:
        d.validate()
    for said in ("same number of read structures", "doesn't exist", "Error parsing segment types", "must be 5 or more".lower()):
        assert said.lower() in str(e.value).lower()
    with pytest.raises(ValueError, match="No output types requested"):
        Demux([fastq(tmp_path / "a.fq", ["A"])], ["+T"], "s.tsv", str(tmp_path / "o"), output_types="").validate()


def test_read_structures():
    rs = ReadStructure.parse("10M 8b+T")
    assert str(rs) == "10M8B+T" and rs.min_length == 19 and rs.count("T") == 1
    for bad in ("", "T", "0T", "+T8B", "8X", "8"):
        with pytest.raises(ValueError):
            ReadStructure.parse(bad)
    assert parse_kinds("TTB") == {"T", "B"} and parse_skip_reason("Too Few Bases") == "too-few-bases"
    with pytest.raises(ValueError, match="Invalid skip reason"):
        parse_skip_reason("other")
    assert target_files([ReadStructure.parse("8B+T"), ReadStructure.parse("+T")], {"T", "B"}, ["a"]) == ["a.R1.fq.gz", "a.R2.fq.gz", "a.I1.fq.gz"]


@pytest.mark.parametrize("text", [b"@a\nAC\n+\n;\n", b"a\nAC\n+\n;;\n", b"@a\nAC\n;;\n+\n", b"@a\nAC\n+", b"\n@a\nA\n+\n;\n"])
def test_malformed(spark, tmp_path, text):
    (tmp_path / "x.fq").write_bytes(text)
    with pytest.raises(Exception, match="parsing FASTQs"):
        read_fastq(spark, [str(tmp_path / "x.fq")]).collect()
    assert issubclass(MalformedFastq, ValueError)


def test_block_gzip_of_many_blocks(spark, tmp_path):
    w = BgzfWriter((tmp_path / "big.fq.gz").open("wb"))
    text = "".join(f"@r{k}\n{'ACGT' * 25}\n+x\n{';' * 100}\n" for k in range(2000)).encode()
    w.write(text)
    w.close()
    assert gzip.decompress((tmp_path / "big.fq.gz").read_bytes()) == text
    df = read_fastq(spark, [str(tmp_path / "big.fq.gz")])
    assert df.count() == 2000 and df.where("ord = 1999").first()["header"] == "r1999" and df.first()["raw_plus"] == "+x"


def test_command_line():
    o = parser().parse_args("demux -i a b -r 8B+T +T -s s -o o -S too-few-bases".split())
    assert (o.output_types, o.unmatched_prefix, o.max_mismatches, o.min_mismatch_delta, o.threads, o.compression_level) == ("T", "unmatched", 1, 2, 8, 5)
    o = parser().parse_args("subsample -i a -o o -f 0.5 --disable-read-name-checking".split())
    assert o.fraction == 0.5 and o.seed is None and o.disable_read_name_checking


def test_parts_are_joined(spark, tmp_path):
    rows = [(f"t{k % 3}.fq.gz", k, f"@r{k}\nA\n+\n;\n") for k in range(500)]
    df = spark.createDataFrame(rows, "target string, ord long, record string").repartition(4)
    write_fastq(df, str(tmp_path), [f"t{k}.fq.gz" for k in range(4)], chunk_records=60)
    for t in range(3):
        assert gzip.decompress((tmp_path / f"t{t}.fq.gz").read_bytes()).decode() == "".join(r for n, _, r in rows if n == f"t{t}.fq.gz")
        assert (tmp_path / f"t{t}.fq.gz").read_bytes().count(END_BLOCK) == 1
    assert (tmp_path / "t3.fq.gz").read_bytes() == END_BLOCK
    assert not [p for p in tmp_path.iterdir() if "part-" in p.name or "joined" in p.name]


def test_bytes_beyond_ascii_and_line_ends(spark, tmp_path):
    (tmp_path / "x.fq").write_bytes("@é\r\nAC\r\n+\r\n;;\r\n@b\nA\n+\n;\n\n\n".encode())
    got = read_fastq(spark, [str(tmp_path / "x.fq")]).orderBy("ord").collect()
    assert [(r["header"], r["seq"], r["qual"], r["ends"]) for r in got] == [("é".encode().decode("latin-1"), "AC", ";;", 15), ("b", "A", ";", 0)]


def test_records_beyond_ascii_are_written(spark, tmp_path):
    rows = [("t.fq.gz", k, f"@{'é' if k % 3 == 0 else 'e'}{k}\nA\n+\n;\n") for k in range(50)] + [("u.fq.gz", 0, "@u\nA\n+\n;\n")]
    write_fastq(spark.createDataFrame(rows, "target string, ord long, record string"), str(tmp_path), ["t.fq.gz", "u.fq.gz"])
    assert gzip.decompress((tmp_path / "t.fq.gz").read_bytes()) == "".join(r for *_, r in rows[:50]).encode("latin-1")


def fastq_text(rng, n, end="\n"):
    rows = []
    for k in range(n):
        b = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 90)))
        rows.append(f"@r{k} {'x' * rng.randint(0, 30)}{end}{b}{end}+{end}{'@+;I'[k % 4] * len(b)}{end}")
    return "".join(rows).encode()


@pytest.mark.parametrize("split_bytes", [97, 1000, 5000])
def test_split_files_read_as_whole_ones(spark, tmp_path, split_bytes):
    """Plain and block-gzip files, with and without a last line end, blank lines behind,
    carriage returns; a file of one record and an empty one."""
    rng = random.Random(split_bytes)
    texts = [fastq_text(rng, 60), fastq_text(rng, 60)[:-1], fastq_text(rng, 30) + b"\n\n\n", fastq_text(rng, 40, "\r\n"), fastq_text(rng, 1), b""]
    paths = []
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.fq").write_bytes(text)
        w = (tmp_path / f"{k}.fq.gz").open("wb")
        for at in range(0, len(text), 700):  # blocks that end anywhere
            w.write(bgzf_block(text[at : at + 700], 5))
        w.write(END_BLOCK)
        w.close()
        paths += [str(tmp_path / f"{k}.fq"), str(tmp_path / f"{k}.fq.gz")]
    (tmp_path / "one.fq.gz").write_bytes(gzip.compress(texts[0]))
    paths.append(str(tmp_path / "one.fq.gz"))
    splits = splits_of(spark, paths, split_bytes)
    assert len(splits) > len(paths) and sum(s.path.endswith("one.fq.gz") for s in splits) == 1
    key = ["file_idx", "ord"]
    got = [tuple(r) for r in read_fastq(spark, paths, split_bytes).orderBy(*key).collect()]
    want = [tuple(r) for r in read_fastq(spark, paths, 1 << 30).orderBy(*key).collect()]
    assert got == want and len(got) == 2 * (60 + 60 + 30 + 40 + 1) + 60


def test_split_files_that_are_malformed(spark, tmp_path):
    text = fastq_text(random.Random(1), 80)
    cut_off, shifted = text[: text.rindex(b"+")], text[: len(text) // 2] + b"\n" + text[len(text) // 2 :]
    for bad in (cut_off, shifted):
        (tmp_path / "x.fq").write_bytes(bad)
        with pytest.raises(Exception, match="parsing FASTQs"):
            read_fastq(spark, [str(tmp_path / "x.fq")], 500).collect()
    damaged = bytearray(b"".join(bgzf_block(text[k : k + 700], 5) for k in range(0, len(text), 700)) + END_BLOCK)
    damaged[len(damaged) // 2] ^= 255
    (tmp_path / "x.fq.gz").write_bytes(bytes(damaged))
    with pytest.raises(Exception):
        read_fastq(spark, [str(tmp_path / "x.fq.gz")], 500).collect()
