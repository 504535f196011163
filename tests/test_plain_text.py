"""Blocks of FASTQ by array steps, and the best two of a sheet, held to plain ways."""

import random

import pyarrow as pa
import pytest

from skein.operators.matcher import match_distinct
from skein.sources.fastq import BUFFER, MalformedFastq, _Stream, _text, columns, parsed, plain_columns, text_blocks


class _Pieces(_Stream):
    def read(self, n):
        return next(self.text, b"")


def _lists(text):
    lists, _ = columns(text.split(b"\n"), 0)
    return [*map(_text, lists[:4]), pa.array(lists[4], pa.int32())]


def test_plain_columns_say_what_columns_say():
    rng = random.Random(1)
    some = []
    for k in range(500):
        n = rng.choice([0, 1, 5, 70])
        some.append(f"@{'r' * rng.randrange(3)}{k if k % 7 else ''} x@+\n{'A' * n}\n+{'again' * rng.randrange(2)}\n{'@' * n}".encode())
    text = b"\n".join(some)
    assert [c.to_pylist() for c in plain_columns(text)] == [c.to_pylist() for c in _lists(text)]
    assert [c.type for c in plain_columns(text)] == [c.type for c in _lists(text)]
    for other in ("@r\nA\n+\né", "@r\r\nA\r\n+\r\n;\r", "@r\nAC\n+\n;", "r\nA\n+\n;", "@r\nA\n-\n;", "\n\n\n"):
        assert plain_columns(other.encode("latin-1")) is None


@pytest.mark.parametrize("seed", range(5))
def test_text_blocks_are_whole_records(seed):
    rng = random.Random(seed)
    text = "".join(f"@r{k}\n{'A' * (k % 9)}\n+\n{';' * (k % 9)}\n" for k in range(200)).encode()[: None if seed % 2 else -1]
    at = sorted(rng.sample(range(len(text)), 40))
    pieces = [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)]
    blocks = list(text_blocks(_Pieces(iter(x for x in pieces if x))))
    assert b"\n".join(blocks) == text.rstrip(b"\n") + (b"\n" if text.endswith(b"\n\n") else b"")
    assert all(b.count(b"\n") % 4 == 3 for b in blocks) and len(blocks) > 1
    headers = [x for c in parsed(_Pieces(iter(x for x in pieces if x)), "p", 0) for x in c[0].to_pylist()]
    assert headers == [f"r{k}" for k in range(200)]


def test_mistakes_are_told_where_they_stand():
    good = b"@r\nA\n+\n;\n"
    with pytest.raises(MalformedFastq, match="record 3 of p has 2 bases and 1 qualities"):
        list(parsed(_Stream(iter([good, good, b"@r\nAC\n+\n;\n"])), "p", 0))
    with pytest.raises(MalformedFastq, match="record 4 of p"):
        list(parsed(_Pieces(iter([good * 2 + b"\n\n\n\n", good])), "p", 1))


def test_a_stream_hands_on_many_small_pieces_at_once():
    stream = _Stream(iter([b"x" * 1000] * 3000))
    assert len(stream.read(1 << 30)) >= BUFFER and len(stream.read(10)) == 1000


def test_best_two_of_a_sheet(spark):
    """Ties go to the first sample; of one sample the second best is as far as can be."""
    def mm(a, b):
        return sum(y != "N" and x != y for x, y in zip(a, b, strict=True))

    rng = random.Random(3)
    sheet = ["ACGT", "ACGA", "TTTT", "ANGT", "GGGG"]
    obs = sorted({"".join(rng.choices("ACGT", k=4)) for _ in range(120)})
    seen = spark.createDataFrame([(o,) for o in obs], "obs string")
    for n in (1, 2, 5):
        samples = spark.createDataFrame([(k, f"s{k}", b) for k, b in enumerate(sheet[:n])], "ordinal int, sample_id string, barcode string")
        for most, delta in ((0, 1), (1, 0), (2, 1), (255, 0)):
            found = {r[0]: tuple(r)[1:] for r in match_distinct(seen, samples, 4, most, delta).collect()}
            for o in obs:
                best, *rest = sorted((mm(o, b), k) for k, b in enumerate(sheet[:n]))
                second = rest[0][0] if rest else 255
                near = best[0] <= most and second - best[0] >= delta
                assert found[o] == ((best[1], best[0], second) if near else (None, None, None)), (o, n, most, delta)
    plan = match_distinct(seen, samples, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan  # a fold whose every step makes structs
