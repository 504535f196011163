import pytest
from pyspark.sql import functions as F

from skein.functions import headers

VECTORS = [
    ("m7:88:flow:3:1105:77:913 1:N:0:5", [], 1, "@m7:88:flow:3:1105:77:913 1:N:0:ACGT+GGTT"),
    ("m7:88:flow:3:1105:77:913 2:Y:18:9", ["TTGCA"], 1, "@m7:88:flow:3:1105:77:913:TTGCA 1:Y:18:ACGT+GGTT"),
    ("m7:88:flow:3:1105:77:913:GAGA 1:N:0:CATG", ["TTGCA", "CC"], 3, "@m7:88:flow:3:1105:77:913:GAGA+TTGCA+CC 3:N:0:CATG+ACGT+GGTT"),
    ("spot", ["TTGCA"], 2, "@spot:TTGCA 2:N:0:ACGT+GGTT"),
    ("spot lane:4", ["TTGCA"], 1, "@spot:TTGCA lane:4:ACGT+GGTT"),
    ("spot", [], 1, "@spot 1:N:0:ACGT+GGTT"),
    ("spot 1:N:0:A12", ["AA", "CC"], 1, "@spot:AA+CC 1:N:0:A1+ACGT+GGTT"),
    ("spot a b:c:", [], 1, "@spot a b:c:ACGT+GGTT"),
    ("a:b:c:d:e:f:g:h:i:j", [], 1, "@a:b:c:d:e:f:g:h:i:j 1:N:0:ACGT+GGTT"),
]


def line(spark, header, umis, number):
    df = spark.createDataFrame([(header,)], "h string")
    return df.select(headers.rewrite(F.col("h"), number, [F.lit("ACGT"), F.lit("GGTT")], [F.lit(u) for u in umis])).first()[0]


@pytest.mark.parametrize("header,umis,number,want", VECTORS)
def test_rewrite(spark, header, umis, number, want):
    assert line(spark, header, umis, number) == want


@pytest.mark.parametrize("header,umis,said", [("a:b:c:d:e:f:g:h:i:j", ["AA"], "8 segments"), ("spot 1:2:3:4:5", [], "4 segments"), ("spot ", [], "Empty comment")])
def test_rewrite_fails(spark, header, umis, said):
    with pytest.raises(Exception, match=said):
        line(spark, header, umis, 1)


def test_base_read_name_and_thousands(spark):
    given = ["spot.9", "spot.9/1", "spot.9/2", "spot.9 lane 4", "spot.9/2 lane 4", "spot.9\tlane", "spot.9/4"]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in given], "h string").select(headers.base_read_name(F.col("h"))).collect()]
    assert got == ["spot.9"] * 6 + ["spot.9/4"]
    assert spark.range(1).select(headers.thousands(F.lit(1234567))).first()[0] == "1,234,567"
