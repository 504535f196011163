"""Operator 2: quality rules as learned decision lists.

``measure`` takes statistics of every whole text, ``learn`` grows and prunes an
ordered list of threshold conjunctions by sequential covering (grow on two
thirds of the examples by information gain, prune on the rest by the share of
right calls), and ``DecisionList.verdict`` emits the list as one ordered Spark
``CASE WHEN`` expression, so that scoring never leaves the JVM.

Bounds that are parameters: the list is fitted on at most ``sample`` labelled rows
(20,000 by default), those with the smallest hash of ``doc_id``, and a rule has
``most_conditions`` (4) conditions at most.  Statistics and verdicts cover all rows.

Defined results: a null text counts as empty; an empty text has all counts 0 and
fails the base rules; very long texts are measured whole.  Null labels are no examples.  With no bad or no good
example the list is empty and keeps whatever the base rules keep.  Repeated rows
are measured and judged one by one; a document labelled twice gives two examples.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, append_columns, doc_texts, documents, map_rows, shielded, stored

SYMBOLS = "#*$%&|<>"
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
#: What the learned list may put thresholds on.
FEATURES = (
    "symbols_per_word", "dup_line_share", "repeat_share", "mean_word", "upper_share", "bang_per_word",
    "digit_share", "distinct_share", "top_word_share", "pipe_share", "stop_per_word", "log_words",
)
MIN_WORDS, MOST_REPEATED = 50, 50
SAMPLE = 20_000
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))


def repeated_words(words: list) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    width = len(known)
    pairs = ids[:-1] * width + ids[1:]
    if width > 2_000_000:  # three ids don't fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * width + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= again
    return int(hit.sum())


def statistics(text: str | None) -> tuple:
    """The five base counts, then FEATURES."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # ASCII white space only, as the contract has it
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    rep = repeated_words(words)
    size, per = max(1, len(raw)), max(1, n)
    counts: dict = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return (
        n, chars, symbols, dup, rep,
        symbols / per, dup / max(1, len(lines)), rep / per, chars / per,
        (len(raw) - len(raw.translate(None, _UPPER))) / size, text.count("!") / per,
        (len(raw) - len(raw.translate(None, _DIGIT))) / size, len(counts) / per,
        max(counts.values(), default=0) / per, text.count("|") / per, text.count(".") / per, float(np.log1p(n)),
    )


STATS = BASE + "".join(f", {f} double" for f in FEATURES)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and FEATURES for every row."""
    return map_rows(doc_texts(docs), lambda: lambda i, t: (i, *statistics(t)), f"doc_id bigint, {STATS}")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


# ------------------------------------------------------------------- the list
@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.value if self.above else x[self.feature] <= self.value

    def column(self, prefix: str = "") -> Column:
        c = F.col(prefix + self.feature)
        return c > self.value if self.above else c <= self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects, and no rule keeps."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def rule_number(self, prefix: str = "") -> Column:
        """1-based number of the first rule that holds, else 0."""
        out: Column = F.lit(0)
        for k, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(reduce(Column.__and__, [c.column(prefix) for c in rule]), F.lit(k)).otherwise(out)
        return out

    def verdict(self, prefix: str = "") -> Column:
        return self.rule_number(prefix) == 0

    def rejects(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        return reduce(np.logical_or, [_all(r, x) for r in self.rules], np.zeros(n, bool))

    def __str__(self) -> str:
        return "\n".join(f"{k}. reject if " + " and ".join(map(str, r)) for k, r in enumerate(self.rules, 1))


def _all(rule, x) -> np.ndarray:
    n = len(next(iter(x.values())))
    return reduce(np.logical_and, [c.holds(x) for c in rule], np.ones(n, bool))


def _grow(x: dict, bad: np.ndarray, cuts: dict, most: int) -> list[Condition]:
    """Adds the condition of most information gain until no good one is covered."""
    rule: list[Condition] = []
    live = np.ones(len(bad), bool)
    while len(rule) < most and (live & ~bad).any():
        p, n = (live & bad).sum(), (live & ~bad).sum()
        before, best, gain = np.log2(p / (p + n)), None, 1e-9
        for f, values in cuts.items():
            col = x[f][live]
            order = np.argsort(col, kind="stable")
            sorted_, b = col[order], bad[live][order].astype(np.int64)
            cum = np.concatenate([[0], np.cumsum(b)])
            at = np.searchsorted(sorted_, values, side="right")
            for above, pos, tot in ((False, cum[at], at), (True, p - cum[at], p + n - at)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pos > 0, pos * (np.log2(pos / np.maximum(tot, 1)) - before), -1.0)
                k = int(np.argmax(g))
                if g[k] > gain:
                    best, gain = Condition(f, above, float(values[k])), float(g[k])
        if best is None:
            break
        rule.append(best)
        live &= best.holds(x)
    return rule


def _prune(rule: list[Condition], x: dict, bad: np.ndarray) -> tuple[list[Condition], float]:
    """The prefix of the rule with the best Laplace share of right calls, and it."""
    best, score = rule, -1.0
    for k in range(1, len(rule) + 1):
        hit = _all(rule[:k], x)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        s = (p + 1) / (p + n + 2) if p + n else 0.0
        if s > score + 1e-3:
            best, score = rule[:k], s
    return best, score


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_conditions: int = 4, least_right: float = 0.9, seed: int = 7) -> DecisionList:
    """Sequential covering.  A rule that is right in under ``least_right`` of its
    calls on the pruning examples ends the list: keeping clean text comes first.  Every
    rule covers examples that those before it don't, so the list ends by itself."""
    out = DecisionList()
    live = np.ones(len(bad), bool)
    rng = np.random.default_rng(seed)
    while (live & bad).sum() >= 5 and (live & ~bad).any():
        grow = live & (rng.random(len(bad)) < 2 / 3)
        hold = live & ~grow
        if not (grow & bad).any() or not (grow & ~bad).any() or not (hold & bad).any():
            break
        gx = {f: v[grow] for f, v in x.items()}
        hx = {f: v[hold] for f, v in x.items()}
        cuts = {f: np.unique(np.quantile(np.concatenate([v, v[bad[grow]]]), np.linspace(0, 1, 65)[1:-1])) for f, v in gx.items()}
        rule, right = _prune(_grow(gx, bad[grow], cuts, most_conditions), hx, bad[hold])
        if not rule or right < least_right:
            break
        out.rules.append(tuple(rule))
        live &= ~_all(rule, x)
    return out


def examples(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """__sk_id, quality: at most ``sample`` labelled rows, by hash of doc_id."""
    y = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("__sk_id"), "quality")
    return y.orderBy(F.xxhash64(F.lit("quality"), "__sk_id"), "__sk_id", "quality").limit(sample)


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    """Learns from ``stats`` (doc_id, FEATURES) and ``labels`` (doc_id, quality)."""
    y = examples(labels, sample)
    got = stats.join(F.broadcast(y), stats["doc_id"] == y["__sk_id"]).select("quality", *FEATURES).toPandas()
    got = got.sort_values(list(got.columns), ignore_index=True)  # the same list whatever order rows came in
    return learn({f: got[f].to_numpy(float) for f in FEATURES}, got["quality"].to_numpy() == 0)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(measure(documents(spark, sf_dir)), "quality")
    rules = fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    failed = base_failed()
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & rules.verdict()).alias("kept"), rules.rule_number().cast("bigint").alias("rule"),
    )


@shielded
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that base rules and list keep, whole rows."""
    prefixed = ", ".join(f"__sk_{x.strip()}" for x in STATS.split(","))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ids = examples(labels).select("__sk_id").distinct()  # SAMPLE rows at most, so it is broadcast
    rules = fit(measure(docs.join(F.broadcast(ids), docs["doc_id"] == ids["__sk_id"], "left_semi")), labels)
    judged = append_columns(docs, ["text"], lambda: statistics, prefixed)
    failed = (F.col("__sk_n_words") < MIN_WORDS) | (100 * F.col("__sk_n_repeat_words") > MOST_REPEATED * F.col("__sk_n_words"))
    return judged.where(~failed & rules.verdict("__sk_")).select(*docs.columns)


QUERIES = {"op2_quality_rules": op2_quality_rules}
