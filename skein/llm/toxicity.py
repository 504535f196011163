"""Operator 8: toxicity by nearest labelled examples under exact TF-IDF cosine.

Two searches vote on every text, and neither is cut short:

* Over all terms.  A text's terms are dealt to ``WIDTH`` hash buckets; document
  frequencies come from all documents.  Examples lie in blocks of similar ones, and a
  block has the largest weight of any of its examples for each of the ``HEAD`` most
  frequent buckets.  A text's product with these, and its largest exact sum over the
  other buckets' postings in the block, bound its cosine to every example there; blocks
  that can't hold one of the nearest are left out.  What may be among the nearest is
  computed again in double precision, so the result is the exact nearest neighbours.
* Over the vocabulary: terms whose association with the label is beyond chance
  (log-likelihood ratio) and strong (odds ratio of 4 or more, either way) in the
  examples.  Rare terms of a long text outweigh a few telling ones in the cosine over
  all terms; here they can't.  Its index has postings cut into blocks with their largest
  weight: the blocks with the highest bounds are visited first, then all others that can
  reach the k-th cosine found there.

Labels of neighbours vote, by cosine (over the vocabulary: its fourth power) against a
prior.  A logistic regression on leave-one-out votes joins the two, and a monotone map
(isotonic regression) calibrates the sum.  The neighbour with most weight over the
vocabulary, or else over all terms, is the evidence.

On Spark: one Arrow pass turns texts into buckets and vocabulary counts, which are
stored; frequencies are aggregated from these; another pass has both searches, with
the examples' indexes broadcast.  On the driver: the examples, the buckets' counts
(``WIDTH`` at most), and two votes for each example.

Bound: at most ``sample`` (20,000) labelled rows are fitted on, those with the
smallest hash of ``doc_id``, and as many of their texts, with ``MOST_TERMS`` (16 million)
terms at most, which bounds what is sent to 260 MB; held-out rows (crc32 of the id's digits
divisible by 5) never are.  The indexes hold those examples only; equal vectors share an entry.
Labels, lang, source and doc_id are never inputs of a score.

Defined results: a null text is empty.  Texts without a vocabulary term are scored by
the search over all terms alone; texts that share no term with an example get the prior
as its vote.  Ties among neighbours: all at the k-th cosine vote.  Very long texts are
taken whole.  A null doc_id is not held out and no example.  Repeated rows get a row
each.  Without labels, or with one class only, every score is the share of label 1 (0
if none).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, doc_texts, documents, map_rows, stored

SAMPLE, NEIGHBOURS = 20_000, 25
#: Terms of all examples together, 12 bytes each where the index is sent.
MOST_TERMS = 16_000_000
LEAST_DOCS, LEAST_ODDS, BLOCK, PRIOR_WEIGHT = 4, 4.0, 64, 0.25
#: Of the search over all terms: buckets, those held densely, neighbours.
WIDTH, HEAD, WIDE_NEIGHBOURS, WIDE_BLOCK = 1 << 22, 512, 100, 64
#: Texts that are searched for together.
TEXTS_AT_ONCE = 256
#: Words whose buckets a worker keeps.
WORDS_KEPT = 300_000
_TERM = re.compile(r"[^\W\d_]{2,}")


def terms(text: str | None) -> Counter:
    return Counter(_TERM.findall((text or "").lower()))


def log_likelihood_ratio(k1: np.ndarray, n1: int, k0: np.ndarray, n0: int) -> np.ndarray:
    """Dunning's G squared of 'has the term' against the label."""

    def part(k, n, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(np.maximum(k, 1e-300) / (n * p)), 0.0) + np.where(n - k > 0, (n - k) * np.log(np.maximum(n - k, 1e-300) / (n * (1 - p))), 0.0)

    p = np.clip((k1 + k0) / (n1 + n0), 1e-12, 1 - 1e-12)
    return 2 * (part(k1, n1, p) + part(k0, n0, p))


# ----------------------------------------------------------------- the index
@dataclass
class Index:
    """Block-max inverted index over unit vectors (dicts of term: weight)."""

    vectors: list[dict[int, float]]
    block: int = BLOCK
    postings: dict = field(init=False)

    def __post_init__(self) -> None:
        lists: dict[int, tuple[list, list]] = {}
        for i, v in enumerate(self.vectors):
            for t, w in v.items():
                ids, ws = lists.setdefault(t, ([], []))
                ids.append(i)
                ws.append(w)
        self.n_blocks = -(-len(self.vectors) // self.block)
        self.postings = {}
        for t, (ids, ws) in lists.items():
            i, w = np.array(ids), np.array(ws)
            blocks, at = np.unique(i // self.block, return_index=True)
            self.postings[t] = (i, w, blocks, np.append(at, len(i)), np.maximum.reduceat(w, at))

    def nearest(self, query: dict[int, float], k: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Entries, cosines: the nearest entries that stand for ``k`` examples or
        more (``weights``: examples of each entry), all ties at the last one."""
        parts = [(q, self.postings[t]) for t, q in query.items() if t in self.postings]
        if not parts:
            return np.array([], int), np.array([])
        bound = np.zeros(self.n_blocks)
        for q, (_, _, blocks, _, top) in parts:
            bound[blocks] += q * top
        ids = np.concatenate([x[0] for _, x in parts])
        products = np.concatenate([q * x[1] for q, x in parts])
        found, cosines, kth, todo = np.array([], int), np.array([]), 0.0, bound > 0
        first = np.zeros(self.n_blocks, bool)
        first[np.argsort(-bound, kind="stable")[: -(-k // self.block) + 1]] = True
        for visited in (todo & first, todo & ~first):  # the best blocks' k-th is a bound for the rest
            visited &= bound >= kth - 1e-12
            here = visited[ids // self.block]
            scores = np.bincount(ids[here], products[here], len(self.vectors))
            hit = np.flatnonzero(scores > 0)
            found, cosines = np.concatenate([found, hit]), np.concatenate([cosines, scores[hit]])
            rank = np.lexsort((found, -cosines))
            found, cosines = found[rank], cosines[rank]
            held = np.cumsum(np.ones(len(found)) if weights is None else weights[found])
            at_k = int(np.searchsorted(held, k))
            if at_k < len(found):
                kth = cosines[at_k]
                keep = cosines >= kth - 1e-12
                found, cosines = found[keep], cosines[keep]
        return found, np.minimum(cosines, 1.0)


class Reader(dict):
    """Texts as vectors.  Terms never span white space, so a text is read by its words
    and what a word holds is kept (once full, others are read anew): one term's bucket,
    with its number in the vocabulary, or else a place in ``several``."""

    def __init__(self, words: Iterable[str] = ()):
        super().__init__()
        self.known, self.several = {w: k + 1 for k, w in enumerate(words)}, [[]]

    def code(self, term: str) -> int:
        bucket = xxhash.xxh32_intdigest(term.encode("utf-8", "surrogatepass")) % WIDTH
        return bucket + WIDTH * self.known.get(term, 0)

    def __missing__(self, word: str) -> int:
        bare = word[:-1] if word[-1] in ".,;:!?" else word
        low = bare.lower()
        if len(low) > 1 and low.isalpha():  # as nearly all words are
            code = self.code(low)
        else:
            codes = [self.code(t) for t in _TERM.findall(word.lower())]
            code = codes[0] if len(codes) == 1 else -1  # the first of ``several`` is empty
            if len(codes) > 1:
                self.several.append(codes)
                code = -len(self.several)
        if len(self) < WORDS_KEPT:
            self[word] = code
        return code

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all terms, ascending, and their counts; numbers of those in the
        vocabulary, ascending, and theirs."""
        words = Counter((text or "").split())
        at, n = np.fromiter(map(self.__getitem__, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words))
        odd = at < 0
        if odd.any():
            more = [(c, k) for code, k in zip(at[odd].tolist(), n[odd].tolist(), strict=True) for c in self.several[-code - 1]]
            extra = np.array(more, np.int64).reshape(-1, 2)
            at, n = np.concatenate([at[~odd], extra[:, 0]]), np.concatenate([n[~odd], extra[:, 1]])
            if len(self.several) > WORDS_KEPT:  # a text's words are read; what they held may go
                self.clear()
                self.several = [[]]
        named = at >= WIDTH
        return *summed(at % WIDTH, n), *summed(at[named] // WIDTH - 1, n[named])


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys, ascending, and the sum of ``n`` of each."""
    if not len(keys):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first].astype(np.int32), np.add.reduceat(n[order], first).astype(np.int32)


def blocks_of_similar(rows: np.ndarray, size: int) -> np.ndarray:
    """An order of ``rows`` in which runs of ``size`` hold similar ones: halves are cut
    along their main direction until they are that small."""
    out, todo = [], [np.arange(len(rows))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        part = rows[at] - rows[at].mean(axis=0)
        way = np.ones(rows.shape[1], rows.dtype)
        for _ in range(6):
            way = part.T @ (part @ way)
            way /= max(float(np.sqrt((way * way).sum())), 1e-30)
        half = -(-(len(at) // 2) // size) * size  # whole runs
        order = np.argsort(part @ way, kind="stable")
        todo += [at[order[half:]], at[order[:half]]]
    return np.concatenate(out) if out else np.array([], int)


class Wide:
    """Exact cosines to the examples over all terms.

    rows: doc_id, buckets, counts, label; df: documents with each bucket."""

    def __init__(self, rows: list[tuple], df: np.ndarray, n_docs: int, prior: float, k: int = WIDE_NEIGHBOURS, block: int = WIDE_BLOCK):
        self.idf = (np.log((1.0 + n_docs) / (1.0 + df)) + 1.0).astype(np.float32)
        self.prior, self.k, self.block = prior, k, block
        entries: dict[tuple, int] = {}
        cols, tfs, counts, ones, self.first, self.own = [], [], [], [], [], {}
        for doc_id, b, n, y in rows:
            key = (np.asarray(b, np.int32).tobytes(), np.asarray(n, np.int32).tobytes())
            if key not in entries:
                entries[key] = len(cols)
                cols.append(np.asarray(b, np.int32))
                tfs.append(np.asarray(n, np.int32))
                counts.append(0)
                ones.append(0)
                self.first.append(doc_id)
            e = entries[key]
            counts[e] += 1
            ones[e] += y
            self.own.setdefault(doc_id, []).append((e, y))
        self.counts, self.ones = np.array(counts, float), np.array(ones, float)
        self.at = np.cumsum([0, *map(len, cols)])
        self.buckets, self.tfs = np.concatenate([np.zeros(0, np.int32), *cols]), np.concatenate([np.zeros(0, np.int32), *tfs])
        self.ready = False

    def weights(self, buckets: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        return (1 + np.log(tfs)) * self.idf[buckets]

    def build(self) -> None:
        """Where it is used: blocks, their bounds and postings, not sent along.

        Places are the examples in the order of blocks; the last block is filled up with
        places that hold nothing."""
        n, size = len(self.first), self.block
        row = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.at))
        w = self.weights(self.buckets, self.tfs)
        w /= np.sqrt(np.bincount(row, w * w, n))[row]
        known, many = np.unique(self.buckets, return_counts=True)
        head = np.sort(known[np.argsort(-many, kind="stable")[:HEAD]])
        self.head = np.full(WIDTH, -1, np.int16)
        self.head[head] = np.arange(len(head))
        here = self.head[self.buckets]
        main = np.flatnonzero((here >= 0) & (here < len(head)))
        rows = np.zeros((n, len(head)), np.float32)
        rows[row[main], here[main]] = w[main]
        self.entry = blocks_of_similar(rows, size)
        self.n_blocks = -(-n // size)
        place = np.empty(n, np.int32)
        place[self.entry] = np.arange(n)
        self.top, self.dims, self.dense = np.zeros((len(head), self.n_blocks), np.float32), [], []
        for j in range(self.n_blocks):
            part = rows[self.entry[j * size : (j + 1) * size]]
            self.top[:, j] = part.max(axis=0)
            dims = np.flatnonzero(self.top[:, j])
            self.dims.append(dims)
            held = np.zeros((len(dims), size), np.float32)
            held[:, : len(part)] = part[:, dims].T
            self.dense.append(held)
        del rows
        main = main[np.argsort(place[row[main]], kind="stable")]
        self.main_at = np.searchsorted(place[row[main]], np.arange(n + 1))
        self.main_dim, self.main_w = here[main], w[main]
        tail = np.flatnonzero(here < 0)
        tail = tail[np.lexsort((place[row[tail]], self.buckets[tail]))]
        known, start, many = np.unique(self.buckets[tail], return_index=True, return_counts=True)
        self.start, self.size = np.zeros(WIDTH, np.int32), np.zeros(WIDTH, np.int32)
        self.start[known], self.size[known] = start, many
        self.post, self.post_w = place[row[tail]], w[tail]
        self.buckets = self.tfs = None
        self.ready = True

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Entries and cosines of each query: those that stand for ``k`` examples
        or more, all ties at the last one."""
        if not self.ready:
            self.build()
        n, m, size = len(self.first), len(queries), self.block
        heads, tails = np.zeros((m, len(self.top))), np.zeros((m, self.n_blocks * size))
        for i, (b, tf) in enumerate(queries):
            w = self.weights(b, tf)
            w /= max(np.sqrt((w * w).sum()), 1e-300)
            h = self.head[b]
            heads[i, h[h >= 0]] = w[h >= 0]
            start, many = self.start[b], self.size[b]  # none in the head
            some = many > 0
            start, many = start[some], many[some]
            at = np.arange(many.sum(), dtype=np.int32) + np.repeat(start - np.cumsum(many, dtype=np.int32) + many, many)
            tails[i] = np.bincount(self.post.take(at), self.post_w.take(at) * np.repeat(w[some], many), self.n_blocks * size)
        rough_heads, off = heads.astype(np.float32), np.float32(1e-4)  # rounding is far below
        bound = rough_heads @ self.top + tails.reshape(m, self.n_blocks, size).max(axis=2).astype(np.float32) + off
        rough, by_dim = np.full((m, self.n_blocks, size), -1, np.float32), np.ascontiguousarray(rough_heads.T)

        def visit(todo: np.ndarray) -> None:  # query, block: whether to compute
            for j in np.flatnonzero(todo.any(axis=0)):
                who = np.flatnonzero(todo[:, j])
                rough[who, j] = by_dim[self.dims[j]].take(who, axis=1).T @ self.dense[j] + tails[who, j * size : (j + 1) * size]

        # k entries stand for k examples or more: the best blocks' k-th is a bound for the rest
        seen = min(self.n_blocks, -(-self.k // size) + 1)
        best = np.argpartition(-bound, seen - 1, axis=1)[:, :seen]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, best, True, axis=1)
        visit(first)
        got = np.take_along_axis(rough, best[:, :, None], axis=1).reshape(m, -1)
        last = np.partition(got, got.shape[1] - self.k, axis=1)[:, got.shape[1] - self.k] - off if got.shape[1] > self.k else np.zeros(m, np.float32)
        visit(~first & (bound > np.maximum(last, off)[:, None]))
        for i in range(m):
            scores = rough[i].ravel()
            found = np.flatnonzero(scores >= max(last[i], 1e-9))
            if len(found) > self.k:
                found = found[scores[found] >= np.partition(scores[found], len(found) - self.k)[len(found) - self.k] - off]
            found = found[found < n]
            many = self.main_at[found + 1] - self.main_at[found]
            at = np.arange(many.sum()) + np.repeat(self.main_at[found] - np.cumsum(many) + many, many)
            of = np.repeat(np.arange(len(found)), many)
            cos = tails[i, found] + np.bincount(of, self.main_w.take(at) * heads[i].take(self.main_dim.take(at)), len(found))
            found = self.entry[found]
            rank = np.lexsort((found, -cos))
            found, cos = found[rank], cos[rank]
            at_k = int(np.searchsorted(np.cumsum(self.counts[found]), self.k))
            if at_k < len(found):
                keep = cos >= cos[at_k] - 1e-12
                found, cos = found[keep], cos[keep]
            yield found, np.minimum(cos, 1.0)

    def votes(self, doc_ids: list, queries: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, float, int | None, float]]:
        """Vote, the vote without the document's own examples, evidence, its cosine."""
        for doc_id, (found, cos) in zip(doc_ids, self.nearest(queries), strict=True):
            n, y = self.counts[found], self.ones[found]

            def vote(n, y, cos=cos):
                share = min(1.0, self.k / max(n.sum(), 1.0))
                return float((share * (cos * y).sum() + PRIOR_WEIGHT * self.prior) / (share * (cos * n).sum() + PRIOR_WEIGHT))

            full = left = vote(n, y)
            if doc_id in self.own:
                n, y = n.copy(), y.copy()
                for e, label in self.own[doc_id]:
                    n[found == e] -= 1
                    y[found == e] -= label
                left = vote(n, y)
            best = int(np.argmax(cos * self.counts[found])) if len(found) else -1
            yield full, left, self.first[found[best]] if best >= 0 else None, float(cos[best]) if best >= 0 else 0.0


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 0.1) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Narrow:
    """Votes of the nearest examples over the vocabulary.

    rows: doc_id, term ids, counts, label; df: documents with each term."""

    def __init__(self, rows: list[tuple], df: np.ndarray, n_docs: int, prior: float, k: int = NEIGHBOURS):
        self.idf, self.prior, self.k = np.log((1.0 + n_docs) / (1.0 + df)) + 1.0, prior, k
        entries: dict[tuple, int] = {}
        vectors, ones, counts, self.first, self.own = [], [], [], [], {}
        for doc_id, ids, tfs, y in rows:
            if not len(ids):
                continue
            key = tuple(zip(ids, tfs, strict=True))
            if key not in entries:
                entries[key] = len(vectors)
                vectors.append(self.vector(ids, tfs))
                ones.append(0)
                counts.append(0)
                self.first.append(doc_id)
            ones[entries[key]] += y
            counts[entries[key]] += 1
            self.own.setdefault(doc_id, []).append((entries[key], y))
        self.index, self.ones, self.counts, self.memo = Index(vectors), np.array(ones, float), np.array(counts, float), {}

    def vector(self, ids, tfs) -> dict[int, float]:
        w = {t: (1 + np.log(n)) * self.idf[t] for t, n in zip(ids, tfs, strict=True)}
        norm = np.sqrt(sum(x * x for x in w.values()))
        return {t: float(x / norm) for t, x in w.items()}

    def votes(self, doc_id, ids: tuple, tfs: tuple) -> tuple[float | None, float | None, int | None, float]:
        """Vote, the vote without the document's own examples, evidence, its cosine;
        no votes without a vocabulary term that an example has."""
        if not ids:
            return None, None, None, 0.0
        if (ids, tfs) not in self.memo:
            if len(self.memo) >= 50_000:
                self.memo.clear()
            self.memo[ids, tfs] = self.index.nearest(self.vector(ids, tfs), self.k, self.counts)
        found, cos = self.memo[ids, tfs]
        if not len(found):
            return None, None, None, 0.0
        n, y, w = self.counts[found], self.ones[found], cos**4

        def vote(n, y):
            share = min(1.0, self.k / max(n.sum(), 1.0))  # ties may be many; they vote as k would
            return float((share * (w * y).sum() + PRIOR_WEIGHT * self.prior) / (share * (w * n).sum() + PRIOR_WEIGHT))

        full, best = vote(n, y), int(np.argmax(w * n))
        left = full
        if doc_id in self.own:
            n, y = n.copy(), y.copy()
            for e, label in self.own[doc_id]:
                n[found == e] -= 1
                y[found == e] -= label
            left = vote(n, y)
        return full, left, self.first[found[best]], float(cos[best])


@dataclass
class Model:
    """What joins both votes: weights of 1, no vocabulary vote, and the votes' logits;
    then the knots of the calibration."""

    joint: np.ndarray
    xs: np.ndarray
    ys: np.ndarray

    def score(self, narrow: np.ndarray, wide: np.ndarray) -> np.ndarray:
        """``narrow`` is nan where the vocabulary has no vote."""
        return np.interp(joined(narrow, wide) @ self.joint, self.xs, self.ys)


def joined(narrow: np.ndarray, wide: np.ndarray) -> np.ndarray:
    none = np.isnan(narrow)
    return np.stack([np.ones(len(wide)), none.astype(float), np.where(none, 0.0, logit(np.where(none, 0.5, narrow))), logit(wide)], axis=1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of the best monotone map."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum y, n, sum x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([float(b), 1.0, float(a)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], s, strict=True)]
    xs = np.array([b[2] / b[1] for b in blocks])
    ys = np.array([b[0] / b[1] for b in blocks])
    keep = np.r_[True, np.diff(xs) > 0]
    return xs[keep], ys[keep]


def train(narrow: np.ndarray, wide: np.ndarray, labels: np.ndarray) -> Model:
    """From the examples' leave-one-out votes."""
    x, y = joined(narrow, wide), labels.astype(float)
    joint = logistic(x, y)
    xs, ys = isotonic(x @ joint, y)
    # two pseudo-examples at each end keep scores off 0 and 1
    return Model(joint, xs, np.clip(ys, 0.5 / (len(y) + 1), 1 - 0.5 / (len(y) + 1)))


# ---------------------------------------------------------------------- Spark
def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def examples_of(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, toxic: the labelled rows fitted on."""
    y = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return y.orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id").limit(sample)


def vocabulary(texts: DataFrame, y: DataFrame) -> list[str]:
    """Terms beyond chance in the examples, strongest first."""
    made = map_rows(
        texts.join(F.broadcast(y), "doc_id").select("text", "toxic"),  # y: SAMPLE rows at most
        lambda: lambda t, label: (label, sorted(terms(t))),
        "toxic int, terms array<string>",
    )
    n1, n0 = (y.where("toxic = 1").count(), y.where("toxic = 0").count())
    if not n1 or not n0:
        return []
    by = made.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("k1"), F.sum(1 - F.col("toxic")).alias("k0"))
    by = stored(by.where(F.col("k1") + F.col("k0") >= LEAST_DOCS), "terms")
    least = 2 * np.log(2 * max(1, by.count()))  # half a term by chance among all that are tried
    rate = F.lit(n1 / (n1 + n0))
    # cheap bound first: only terms off the base rate reach the driver
    off = F.abs(F.col("k1") - (F.col("k1") + F.col("k0")) * rate) > F.sqrt((F.col("k1") + F.col("k0")) * rate * (1 - rate)) * 2.5
    rows = by.where(off).orderBy("term").collect()
    if not rows:
        return []
    k1, k0 = np.array([r["k1"] for r in rows], float), np.array([r["k0"] for r in rows], float)
    k1, k0 = np.minimum(k1, n1), np.minimum(k0, n0)
    g = log_likelihood_ratio(k1, n1, k0, n0)
    odds = (k1 + 0.5) * (n0 - k0 + 0.5) / ((k0 + 0.5) * (n1 - k1 + 0.5))
    ranked = sorted((-g[i], rows[i]["term"]) for i in range(len(rows)) if g[i] >= least and max(odds[i], 1 / odds[i]) >= LEAST_ODDS)
    return [t for _, t in ranked]


VECTORS = "doc_id bigint, buckets array<int>, tfs array<int>, ids array<int>, ns array<int>"


def vectors(texts: DataFrame, words: list[str]) -> DataFrame:
    """doc_id; buckets and counts of all terms of every text; ids and counts of those
    in the vocabulary."""
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def make():
        reader = Reader(shared.value)
        return lambda doc_id, text: (doc_id, *reader.vector(text))

    return map_rows(texts, make, VECTORS)


def bucket_counts(made: DataFrame) -> np.ndarray:
    """Documents with each bucket, over all documents; 1 where one or none has it."""
    struct, schema = arrow_schema("bucket int, n int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(WIDTH, np.int32)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy()
            for at in range(0, len(flat), WIDTH):
                n += np.bincount(flat[at : at + WIDTH], minlength=WIDTH).astype(np.int32)
        here = np.flatnonzero(n)
        for at in range(0, len(here), 1 << 16):
            part = here[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n[part], pa.int32())], schema=schema)

    got = made.select("buckets").mapInArrow(run, struct).groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1").toArrow()  # WIDTH rows at most
    df = np.ones(WIDTH, np.int32)
    df[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return df


def fitted(made: DataFrame, y: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The examples' vectors, each once: ``sample`` at most in the order of their hashes,
    with MOST_TERMS terms at most, however many texts an id has."""
    order = ["h", "doc_id", "k"]
    keys = [F.xxhash64(F.lit("toxic"), "doc_id").alias("h"), F.xxhash64("buckets", "tfs").alias("k")]
    each = made.join(F.broadcast(y), "doc_id").dropDuplicates(["doc_id", "buckets", "tfs"]).select("*", *keys)  # y: SAMPLE ids at most
    each = stored(each, "fitted")
    sizes = [tuple(r) for r in each.select(*order, F.size("buckets")).orderBy(*order).limit(sample).collect()]  # numbers
    most = max(1, int(np.searchsorted(np.cumsum([r[3] for r in sizes]), MOST_TERMS, side="right")))
    if not sizes:
        return each
    last = F.struct(*(F.lit(x).cast("bigint") for x in sizes[:most][-1][:3]))
    return each.where(F.struct(*order) <= last)


def indexes(made: DataFrame, y: DataFrame, words: list[str], n_docs: int) -> tuple[Narrow, Wide] | float:
    """The examples' two indexes; without both classes, the share of label 1."""
    got = fitted(made, y).toArrow()  # SAMPLE rows and MOST_TERMS terms at most
    column = lambda c: [x.values.to_numpy(zero_copy_only=False) if x.values is not None else np.zeros(0, np.int32) for x in got[c]]
    rows: dict = {}
    for doc_id, label, b, n, i, k in zip(got["doc_id"].to_pylist(), got["toxic"].to_pylist(), *map(column, ("buckets", "tfs", "ids", "ns")), strict=True):
        rows[doc_id, b.tobytes(), n.tobytes()] = (doc_id, b, n, tuple(i.tolist()), tuple(k.tolist()), label)
    ordered = [rows[k] for k in sorted(rows)]
    prior = float(np.mean([r[-1] for r in ordered])) if ordered else 0.0
    if not 0 < prior < 1:
        return prior
    df = np.zeros(max(1, len(words)))
    for r in made.select(F.explode("ids").alias("t")).groupBy("t").count().collect():  # a row for each vocabulary term
        df[r["t"]] = r["count"]
    narrow = Narrow([(d, i, k, label) for d, _, _, i, k, label in ordered], df, n_docs, prior)
    return narrow, Wide([(d, b, n, label) for d, b, n, _, _, label in ordered], bucket_counts(made), n_docs, prior)


VOTES = "doc_id bigint, narrow double, narrow_left double, wide double, wide_left double, evidence_doc bigint, evidence_cosine double"


def both_votes(made: DataFrame, both: tuple[Narrow, Wide]) -> DataFrame:
    shared = made.sparkSession.sparkContext.broadcast(both)
    struct, schema = arrow_schema(VOTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        narrow, wide = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                doc_ids = part.column(0).to_pylist()
                lists = [[x.values.to_numpy() for x in part.column(c)] for c in (1, 2)]
                out = []
                for doc_id, ids, ns, far in zip(doc_ids, part.column(3).to_pylist(), part.column(4).to_pylist(), wide.votes(doc_ids, list(zip(*lists, strict=True))), strict=True):
                    near = narrow.votes(doc_id, tuple(ids), tuple(ns))
                    out.append((doc_id, *near[:2], *far[:2], *(near[2:] if near[0] is not None else far[2:])))
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return made.mapInArrow(run, struct)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence_doc, evidence_cosine."""
    texts = doc_texts(docs)
    y = stored(examples_of(labels, sample), "examples")
    words = vocabulary(texts, y)
    made = stored(vectors(texts, words), "vectors")
    both = indexes(made, y, words, made.count())
    if isinstance(both, float):
        score = F.lit(both)
        return made.select(
            "doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"),
            F.lit(None).cast("bigint").alias("evidence_doc"), F.lit(0.0).alias("evidence_cosine"),
        )
    votes = stored(both_votes(made, both), "votes")
    own = votes.join(F.broadcast(y), "doc_id").select("doc_id", "narrow_left", "wide_left", "toxic").distinct()
    own = own.orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id", "narrow_left", "wide_left").limit(sample).toArrow()
    own = own.sort_by([(c, "ascending") for c in own.column_names])  # the same sums whatever order rows came in
    model = train(own["narrow_left"].to_numpy(), own["wide_left"].to_numpy(), own["toxic"].to_numpy())
    struct, schema = arrow_schema("doc_id bigint, score double, evidence_doc bigint, evidence_cosine double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = model.score(b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), b.column(3), b.column(4)], schema=schema)

    out = votes.select("doc_id", "narrow", "wide", "evidence_doc", "evidence_cosine").mapInArrow(run, struct)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence_doc", "evidence_cosine")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op8_toxicity": op8_toxicity}
