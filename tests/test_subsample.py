import gzip

import pytest

from skein.plans.subsample import Subsample


def fastq(path, n, suffix="", plus="+", name="read"):
    path.write_text("".join(f"@{name}_{k}{suffix}\nACGT\n{plus}\n;;;;\n" for k in range(n)))
    return str(path)


def names(path):
    return [x[1:].split("/")[0] for x in gzip.decompress(path.read_bytes()).decode().splitlines()[::4]]


def test_single_and_seed(spark, tmp_path):
    p = fastq(tmp_path / "a.fq", 200, plus="+kept as is")
    total, kept, percent = Subsample([p], str(tmp_path / "o"), 0.5, seed=42).execute(spark)
    got = names(tmp_path / "o.R1.fq.gz")
    assert total == 200 and kept == len(got) and 51 <= kept <= 149 and percent == pytest.approx(kept / 2)
    assert gzip.decompress((tmp_path / "o.R1.fq.gz").read_bytes()).decode().splitlines()[2] == "+kept as is"
    Subsample([p], str(tmp_path / "p"), 0.5, seed=42).execute(spark)
    assert names(tmp_path / "p.R1.fq.gz") == got


def test_three_inputs_agree(spark, tmp_path):
    ins = [fastq(tmp_path / f"{k}.fq", 100, suffix) for k, suffix in enumerate(("/1", "/2", ""))]
    Subsample(ins, str(tmp_path / "o"), 0.3, seed=42).execute(spark)
    a, b, c = (names(tmp_path / f"o.R{k}.fq.gz") for k in (1, 2, 3))
    assert a == b == c and a == sorted(a, key=lambda x: int(x.split("_")[1])) and 0 < len(a) < 100


@pytest.mark.parametrize("n,fraction,want", [(50, 0.0, 0), (50, 1.0, 50), (0, 0.5, 0)])
def test_ends(spark, tmp_path, n, fraction, want):
    total, kept, percent = Subsample([fastq(tmp_path / "a.fq", n)], str(tmp_path / "o"), fraction).execute(spark)
    assert (total, kept) == (n, want) and len(names(tmp_path / "o.R1.fq.gz")) == want and percent == (100.0 * want / n if n else 0.0)


def test_name_checks(spark, tmp_path):
    ins = [fastq(tmp_path / "a.fq", 5), fastq(tmp_path / "b.fq", 5, name="other")]
    with pytest.raises(ValueError, match="Read name mismatch"):
        Subsample(ins, str(tmp_path / "o"), 1.0).execute(spark)
    assert Subsample(ins, str(tmp_path / "o"), 1.0, disable_read_name_checking=True).execute(spark)[1] == 5


def test_out_of_sync(spark, tmp_path):
    ins = [fastq(tmp_path / "a.fq", 5), fastq(tmp_path / "b.fq", 4)]
    with pytest.raises(ValueError, match="1 of 2 files had a record at read 5"):
        Subsample(ins, str(tmp_path / "o"), 1.0).execute(spark)


def test_derived_seed_and_validation(tmp_path):
    a = Subsample(["a"], "o", 0.3)
    assert a.effective_seed() == Subsample(["a"], "o", 0.3).effective_seed()
    for other in (Subsample(["a"], "o", 0.4), Subsample(["b"], "o", 0.3), Subsample(["a"], "p", 0.3), Subsample(["a"], "o", 0.3, threads=4), Subsample(["a"], "o", 0.3, compression_level=6)):
        assert other.effective_seed() != a.effective_seed()
    with pytest.raises(ValueError) as e:
        Subsample([], str(tmp_path / "no" / "o"), float("nan"), threads=1, compression_level=13).validate()
    for said in ("At least one input", "Fraction", "Threads", "Compression level", "parent directory"):
        assert said in str(e.value)


def test_records_stay_unchanged(spark, tmp_path, caplog):
    """Line ends and all."""
    text = b"@a x\r\nAC\r\n+more\r\n;;\r\n@b\nA\n+\n;\n@c\r\nG\n+\r\n!\n"
    (tmp_path / "a.fq").write_bytes(text)
    with caplog.at_level("INFO"):
        Subsample([str(tmp_path / "a.fq")], str(tmp_path / "o"), 1.0).execute(spark)
    assert gzip.decompress((tmp_path / "o.R1.fq.gz").read_bytes()) == text
    assert "3 record sets read, 3 written (100.0%)" in caplog.messages
