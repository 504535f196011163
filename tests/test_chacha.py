"""The stream of draws against a published keystream and a scalar rewriting."""

import gzip

import numpy as np
import pytest

from skein.functions import chacha
from skein.operators import sampling
from skein.plans.subsample import Subsample

LOW = 0xFFFFFFFF
#: Fixed value: the first keystream block of eight rounds with a key and a nonce of zeros.
ZERO_BLOCK = "3e00ef2f895f40d67f5bb8e81f09a5a12c840ec3ce9a7f3b181be188ef711a1e984ce172b9216f419f445367456d5619314a42a3da86b001387bfdb80e0cfe42"


def test_published_keystream():
    assert chacha.blocks([0] * 8, np.array([0]))[:, 0].astype("<u4").tobytes().hex() == ZERO_BLOCK


def scalar_block(key, number):
    first = [0x61707865, 0x3320646E, 0x79622D32, 0x6B206574, *key, number & LOW, number >> 32, 0, 0]
    s = list(first)

    def add_turn(x, y, z, n):
        s[x] = (s[x] + s[y]) & LOW
        v = s[z] ^ s[x]
        s[z] = (v << n | v >> (32 - n)) & LOW

    for k in range(8):
        for j in range(4):
            a, b, c, d = (j, 4 + j, 8 + j, 12 + j) if k % 2 == 0 else (j, 4 + (j + 1) % 4, 8 + (j + 2) % 4, 12 + (j + 3) % 4)
            add_turn(a, b, d, 16), add_turn(c, d, b, 12), add_turn(a, b, d, 8), add_turn(c, d, b, 7)
    return [(x + y) & LOW for x, y in zip(s, first, strict=True)]


def scalar_draws(seed, n):
    key, state = [], seed
    for _ in range(8):
        state = (state * 6364136223846793005 + 11634580027462260723) % 2**64
        x, r = ((state >> 18 ^ state) >> 27) & LOW, state >> 59
        key.append((x >> r | x << (32 - r)) & LOW if r else x)
    words = [w for k in range(-(-n // 8)) for w in scalar_block(key, k)]
    return [((words[2 * k] | words[2 * k + 1] << 32) >> 11) / 2**53 for k in range(n)]


@pytest.mark.parametrize("seed", [0, 1, 42, 2**63 + 5])
def test_draws_by_position(seed):
    want = scalar_draws(seed, 100)
    order = np.random.default_rng(1).permutation(100)
    assert chacha.uniform(seed, order).tolist() == [want[k] for k in order]
    assert chacha.uniform(seed, np.array([2**36]))[0] == ((lambda w: ((w[0] | w[1] << 32) >> 11) / 2**53)(scalar_block(chacha.key_of(seed), 2**33)))


def test_draw_in_spark(spark):
    df = spark.range(1000).withColumnRenamed("id", "ord").repartition(7)
    want = scalar_draws(42, 1000)
    assert {r["ord"]: r["u"] for r in df.select("ord", chacha.draw(42).alias("u")).collect()} == dict(enumerate(want))
    assert sorted(r["ord"] for r in df.where(sampling.kept(0.3, 42, generator="chacha8")).collect()) == [k for k, u in enumerate(want) if u < 0.3]


def test_subsample_by_the_stream(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"{k}.fq").write_text("".join(f"@r{i}/{k}\nACGT\n+\n;;;;\n" for i in range(400)))
    ins = [str(tmp_path / f"{k}.fq") for k in (1, 2)]
    total, kept, _ = Subsample(ins, str(tmp_path / "o"), 0.25, seed=7, generator="chacha8", split_bytes=900).execute(spark)
    want = [k for k, u in enumerate(scalar_draws(7, 400)) if u < 0.25]
    assert (total, kept) == (400, len(want))
    for k in (1, 2):
        assert gzip.decompress((tmp_path / f"o.R{k}.fq.gz").read_bytes()).decode().splitlines()[::4] == [f"@r{i}/{k}" for i in want]
    with pytest.raises(ValueError, match="Generator must be one of"):
        Subsample(ins, str(tmp_path / "o"), 0.25, generator="dice").validate()
