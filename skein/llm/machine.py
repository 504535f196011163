"""Operator 11: quality classifier, a factorisation machine.

A text's features are its words, hashed to ``BUCKETS`` and weighed by the logarithm of
their counts; statistics of its structure; and metadata columns.  Statistics and metadata
come as standardised values and as one of ``BINS`` quantile bins, so that pairs of bins
and words can interact.  The score is a logistic function of

    w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,

with ``rank`` numbers in each v_i, and the pairs' sum is taken in time linear in the
features as half the sum over ranks of (sum v_if x_i)^2 - sum (v_if x_i)^2.

Fitting: AdaGrad on the logistic loss, on the driver, on a bounded sample: at most
``sample`` texts (8,000), those with the smallest hash of id and text, whose features
number ``MOST_FEATURES`` at most.  A document's label is the mean of its labels.  Held-out
rows (crc32 of the id's digits leaves 2 by 4) never are examples.  Buckets that no example
has weigh nothing, so words unseen in fitting leave a score to the others.  Labels, lang,
source and doc_id are never inputs of a score.

On Spark: one pass makes the sample's features, one scores all rows with the model
broadcast (BUCKETS * (rank + 1) numbers).  Scoring reads every row's whole text and is
a function of that row and the model.

Defined results: a null text is empty; an empty text is scored by its statistics.  Null
metadata count as missing, by a feature of its own.  A null ``doc_id`` is not held out and
no example.  Ties and repeated rows get equal scores, a row each.  Without labels, or with
one class only, every score is the share of label 1 (0.5 if there is none).  Further
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, doc_texts, documents, map_rows, row_keys, stored
from .quality import FEATURES, STATS, statistics

BUCKETS, RANK, BINS = 1 << 15, 8, 8
SAMPLE, MOST_FEATURES, THRESHOLD = 8_000, 8_000_000, 0.7
EPOCHS, BATCH, RATE, DECAY, SPREAD, SEED = 12, 64, 0.1, 2e-4, 0.02, 5
METADATA = ("n_chars",)
_FIRST = len(STATS.split(",")) - len(FEATURES)
ROWS_AT_ONCE = 128


# -------------------------------------------------------------------- features
class Words:
    """Bucket and weight of each distinct word of a text; weights have norm 1."""

    def __init__(self, buckets: int = BUCKETS, most_known: int = 200_000):
        self.buckets, self.most_known, self.known = buckets, most_known, {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = Counter(text.encode("utf-8", "surrogatepass").lower().split())  # ASCII letters and spaces
        if len(self.known) > self.most_known:
            self.known.clear()
        known, at = self.known, {}
        for w, n in counts.items():
            b = known.get(w)
            if b is None:
                b = known[w] = xxhash.xxh3_64_intdigest(w) % self.buckets
            at[b] = at.get(b, 0) + n
        ids = np.fromiter(at, np.int32, len(at))
        x = np.log1p(np.fromiter(at.values(), np.float64, len(at)))
        return ids, x / max(1e-12, np.sqrt((x * x).sum()))


def structure(text: str, metadata: Sequence) -> list[float]:
    """FEATURES, then the metadata by the logarithm of their size; missing is NaN."""
    out = list(statistics(text)[_FIRST:])
    for value in metadata:
        out.append(np.nan if value is None else float(np.sign(v) * np.log1p(abs(v))) if np.isfinite(v := float(value)) else np.nan)
    return out


@dataclass
class Scale:
    """Means, deviations and quantiles of structure columns, and the features made of them:
    a value, BINS bins and a missing flag for each, behind the buckets of words."""

    mean: np.ndarray
    deviation: np.ndarray
    edges: list[np.ndarray]

    @classmethod
    def of(cls, rows: np.ndarray) -> Scale:
        mean, deviation, edges = [], [], []
        for c in rows.T:
            known = c[~np.isnan(c)]
            mean.append(known.mean() if len(known) else 0.0)
            deviation.append(known.std() or 1.0 if len(known) else 1.0)
            edges.append(np.unique(np.quantile(known, np.linspace(0, 1, BINS + 1)[1:-1])) if len(known) else np.zeros(0))
        return cls(np.array(mean), np.array(deviation), edges)

    @property
    def width(self) -> int:
        return len(self.edges) * (BINS + 2)

    def features(self, rows: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Two features a column for every row: ids and values, row by row."""
        n, m = rows.shape
        missing = np.isnan(rows)
        z = np.where(missing, 0.0, np.clip((rows - self.mean) / self.deviation, -3, 3) / 3)
        slot = np.stack([np.searchsorted(e, np.where(missing[:, k], 0, rows[:, k]), side="left") for k, e in enumerate(self.edges)], axis=1)
        slot = np.where(missing, BINS, slot)
        base = buckets + np.arange(m) * (BINS + 2)
        ids = np.stack([np.broadcast_to(base + BINS + 1, (n, m)), base + slot], axis=2).reshape(n, 2 * m)
        return ids, np.stack([z, np.full((n, m), 1 / np.sqrt(m))], axis=2).reshape(n, 2 * m)


# --------------------------------------------------------------------- machine
def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, at, axis=0)


@dataclass
class Machine:
    """Weights of single features and the low-rank weights of their pairs."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    scale: Scale
    buckets: int = BUCKETS

    def parts(self, ids: np.ndarray, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margins of rows whose features start at ``at`` (none is empty); the sums of
        v x for each row, and v x."""
        vx = self.v[ids] * x[:, None]
        total = _sums(vx, at)
        pairs = 0.5 * (total * total - _sums(vx * vx, at)).sum(axis=1)
        return self.bias + _sums(self.w[ids] * x, at) + pairs, total, vx

    def scores(self, words: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray) -> np.ndarray:
        ids, x, at = batched(words, *self.scale.features(rows, self.buckets))
        # rounded: a sum's last bits depend on where in a batch a row stands
        return np.round(1 / (1 + np.exp(-np.clip(self.parts(ids, x, at)[0], -30, 30))), 9)


def batched(words: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows' features in a row, and where each row's start."""
    each = [a for (i, _), k in zip(words, ids, strict=True) for a in (i, k)]
    values = [a for (_, v), k in zip(words, x, strict=True) for a in (v, k)]
    sizes = [len(i) + ids.shape[1] for i, _ in words]
    return np.concatenate(each), np.concatenate(values), np.cumsum([0, *sizes[:-1]])


def train(words: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, y: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, buckets: int = BUCKETS, seed: int = SEED) -> Machine:
    """AdaGrad over shuffled batches, with weight decay on the features of a batch."""
    rng, scale = np.random.default_rng(seed), Scale.of(rows)
    width = buckets + scale.width
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    m = Machine(float(np.log(prior / (1 - prior))), np.zeros(width), rng.normal(0, SPREAD, (width, rank)), scale, buckets)
    more_ids, more_x = scale.features(rows, buckets)
    w_sum, v_sum, b_sum, seen = np.full(width, 1e-3), np.full((width, rank), 1e-3), 1e-3, np.zeros(width, bool)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            some = order[lo : lo + BATCH]
            ids, x, at = batched([words[k] for k in some], more_ids[some], more_x[some])
            margin, total, vx = m.parts(ids, x, at)
            g = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[some]
            row = np.repeat(np.arange(len(some)), np.diff([*at, len(ids)]))
            each = g[row] * x / len(some)
            by = np.argsort(ids, kind="stable")
            known, start = np.unique(ids[by], return_index=True)
            gw = _sums(each[by], start) + DECAY * m.w[known]
            gv = _sums((each[:, None] * (total[row] - vx))[by], start) + DECAY * m.v[known]
            w_sum[known] += gw * gw
            v_sum[known] += gv * gv
            m.w[known] -= RATE * gw / np.sqrt(w_sum[known])
            m.v[known] -= RATE * gv / np.sqrt(v_sum[known])
            b_sum += g.mean() ** 2
            m.bias -= RATE * g.mean() / np.sqrt(b_sum)
            seen[known] = True
    m.w[~seen] = 0
    m.v[~seen] = 0
    return m


# ----------------------------------------------------------------------- Spark
def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def inputs(docs: DataFrame, metadata: Sequence[str]) -> list:
    return [F.coalesce("text", F.lit("")).alias("text"), *(F.col(c).try_cast("double").alias(f"__sk_m{k}") for k, c in enumerate(metadata))]


def examples(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, metadata: Sequence[str] = METADATA) -> list[tuple]:
    """(label, features' ids and values, structure) of the rows fitted on, in the order
    of their hashes: ``sample`` at most, with MOST_FEATURES features at most."""
    y = labels.where("doc_id is not null and quality is not null").where(~held_out())
    y = y.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("__sk_y"))
    y = y.orderBy(F.xxhash64(F.lit("machine"), "doc_id"), "doc_id").limit(sample)
    keys = row_keys("doc_id", F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", *keys, *inputs(docs, metadata)).join(F.broadcast(y), "doc_id")  # y: ``sample`` rows at most

    def make():
        words = Words()

        def row(h, k1, k2, label, text, *meta):
            ids, x = words(text)
            return h, k1, k2, label, ids.tolist(), x.tolist(), structure(text, meta)

        return row

    ddl = "h bigint, k1 bigint, k2 bigint, label double, ids array<int>, x array<float>, more array<double>"
    rows = rows.select(F.xxhash64(F.lit("machine"), "doc_id"), "__sk_k1", "__sk_k2", "__sk_y", "text", *(f"__sk_m{k}" for k in range(len(metadata))))
    made = stored(map_rows(rows, make, ddl).dropDuplicates(["k1", "k2"]), "examples")
    # an id may have any number of texts: of these, too, ``sample`` is the most
    order = ["h", "k1", "k2"]
    sizes = [tuple(r) for r in made.select(*order, F.size("ids")).orderBy(*order).limit(sample).collect()]
    most = max(1, int(np.searchsorted(np.cumsum([r[3] for r in sizes]), MOST_FEATURES, side="right")))
    if not sizes:
        return []
    last = F.struct(*(F.lit(x).cast("bigint") for x in sizes[:most][-1][:3]))
    got = made.where(F.struct(*order) <= last).toArrow()
    got = got.sort_by([(c, "ascending") for c in order]).combine_chunks()
    lists = [[x.values.to_numpy(zero_copy_only=False) for x in got[c]] for c in ("ids", "x", "more")]
    return list(zip(got["label"].to_pylist(), *lists, strict=True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, metadata: Sequence[str] = METADATA) -> Machine | float:
    """The machine; without both classes, the share of label 1."""
    rows = examples(docs, labels, sample, metadata)
    y = np.array([r[0] for r in rows])
    if not len(y) or y.min() == y.max():
        return float(y[0]) if len(y) else 0.5
    return train([(i, x.astype(np.float64)) for _, i, x, _ in rows], np.array([r[3] for r in rows]), y)


def scored(docs: DataFrame, model: Machine | float, metadata: Sequence[str] = METADATA, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    if isinstance(model, float):
        made = doc_texts(docs).select("doc_id", F.lit(model).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        struct, schema = arrow_schema("doc_id bigint, score double")

        def run(batches):
            machine, words = shared.value, None
            words = Words(machine.buckets)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                    doc_id, text, *meta = batch.slice(at, ROWS_AT_ONCE).columns
                    texts = text.to_pylist()
                    values = list(zip(*(c.to_pylist() for c in meta), strict=True)) if meta else [()] * len(texts)
                    rows = np.array([structure(t, m) for t, m in zip(texts, values, strict=True)])
                    yield pa.RecordBatch.from_arrays([doc_id, pa.array(machine.scores([words(t) for t in texts], rows))], schema=schema)

        made = docs.select("doc_id", *inputs(docs, metadata)).mapInArrow(run, struct)
    return made.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, metadata: Sequence[str] = METADATA) -> DataFrame:
    return scored(docs, fit(docs, labels, sample, metadata), metadata)


def op11_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op11_machine": op11_machine}
