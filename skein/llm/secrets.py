"""Operator 3: secret scans by dictionary-primed zstandard novelty.

Base patterns find assignments, access keys and long hex runs.  The method takes as
candidates all maximal runs of 16 or more key characters in sensitive context: a
sensitive word stands within ``reach`` characters before or behind the run (line ends
don't matter), or the run goes on a list: nothing but separators (white space, commas,
quotes, brackets) and at most two short words parts it from a run that is in context, as
in the body of a private key and in JSON, CSV and YAML lists of keys.  Each candidate, and
the value of each base span, is measured by the bytes that it adds to a zstandard frame
whose dictionary holds the corpus' identifiers and whose content already holds the
``around`` characters on both sides.  Runs of key characters, copies of the candidate among
them, are no surroundings: they are passed over, and further text makes up for them, so
that a key which stands twice, or in a list of keys, is as new as one alone.
A string is measured at its first place, and counts for
all its places in the text, in context or not.  A candidate that adds ``novel`` bytes or more for each of its
characters is reported; base spans are reported anyway and carry their measure.

The dictionary is learned: the words of all documents that have a sensitive word are
counted, and the ``WORDS`` found in most documents, with a short list chosen here,
train it, code tables included.  Partial counts come from Arrow passes; the driver
gets the words that train.

Bounds that are parameters: ``reach`` and ``around`` say what context and
surroundings are, and the dictionary has ``WORDS`` words.  Every run in context is
measured, whatever its length.

Defined results: a null text is empty; empty texts have no span and the hash of the
empty string.  Spans are code-point offsets, end exclusive.  Overlapping spans of
different kinds are all kept; a novelty span that overlaps a base span isn't added.
Texts of any length are scanned whole.  Repeated rows get a row each.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, doc_texts, documents, map_rows, rows_of

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Chosen: words that make what stands near them sensitive.
SENSITIVE = re.compile(
    r"(?:api|access|auth|private|signing|encryption|session|client|bearer|master|deploy|ssh)[_ -]?(?:key|token|secret|id|hash)"
    r"|password|passwd|passphrase|secret|token|credential|bearer|api_?key", re.I | re.A
)
#: Every sensitive word has one of these.
_STEMS = (
    "pass", "secret", "token", "key", "cred", "bearer", "hash", "_id", "-id", " id", "apiid", "accessid", "authid", "privateid", "signingid",
    "encryptionid", "sessionid", "clientid", "masterid", "deployid", "sshid",
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Chosen: phrases that prime the dictionary whatever the corpus.
IDENTIFIERS = (
    "import export return function class public private static const string integer boolean "
    "configuration application environment connection database username password passwd secret token "
    "credential authorization authentication bearer session client server request response "
    "access_key_id secret_access_key api_key private_key public_key signing_key encryption_key "
    "client_secret client_id refresh_token access_token auth_token session_token webhook_secret "
    "development production staging testing example placeholder changeme your_api_key_here "
    "http https localhost example.com www. .com .org .net /usr/local/bin /home/user /var/log "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 0123456789abcdef "
    "getenv os.environ process.env settings.get default_value description documentation "
)
REACH, AROUND, NOVEL = 64, 256, 0.64
#: Words that train the dictionary, its bytes, and the compressor's level.
WORDS, DICTIONARY, LEVEL = 8000, 1 << 15, 19
#: What is counted for the dictionary, and how many a worker counts at once.
_PIECE = re.compile(r"[^\W\d_]{3,}")
PIECES_AT_ONCE = 100_000


def runs(pattern: re.Pattern, text: str, least: int) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text) if m.end() - m.start() >= least]


def base_spans(text: str, low: str | None = None) -> list[tuple[str, int, int]]:
    """kind, start, end by start, then kind as listed."""
    found: list[tuple[int, int, int]] = []
    low = text.lower() if low is None else low
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(a, 1, b) for a, b in runs(ACCESS, text, LEAST["access"])]
    found += [(a, 2, b) for a, b in _hex_runs(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


#: A maximal run of 24 or more is a run with 24 characters from its start on, so
#: the short runs, which are nearly all, never leave the regex engine.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")


def _hex_runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _LONG_HEX.finditer(text)]


def primer(words: list[str], size: int = DICTIONARY) -> bytes:
    """A zstandard dictionary, with its code tables, trained on lines of the words and
    of IDENTIFIERS.  The same words give the same dictionary."""
    import zstandard

    rng, chosen = random.Random(0), IDENTIFIERS.split()
    lines = [" ".join(rng.choices(words if words and k % 5 else chosen, k=16)).encode("utf-8", "replace") for k in range(4000)]
    return zstandard.train_dictionary(size, lines, level=LEVEL).as_bytes()


class Novelty:
    """Marginal compressed bytes of a string, given its surroundings."""

    def __init__(self, prime: bytes):
        import zstandard

        known = zstandard.ZstdCompressionDict(prime)
        known.precompute_compress(level=LEVEL)
        self.frame = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False)

    def bytes_added(self, before: str, candidate: str, after: str) -> int:
        around = (after + "\n" + before).encode("utf-8", "surrogatepass")
        return len(self.frame.compress(around + candidate.encode("utf-8", "surrogatepass"))) - len(self.frame.compress(around))

    def share(self, before: str, candidate: str, after: str) -> float:
        """Added bytes for each character of the candidate."""
        return max(0, self.bytes_added(before, candidate, after)) / max(1, len(candidate))


#: What stands between two keys of a list.
BETWEEN = re.compile(r"""[\s,;:|=>"'`()\[\]{}<*.\\-]*(?:[A-Za-z0-9_]{1,15}[\s,;:|=>"'`()\[\]{}<*.\\-]+){0,2}""")


def in_context(text: str, reach: int = REACH) -> Iterator[tuple[int, int]]:
    """Maximal runs of key characters near a sensitive word, or behind such a run in a list."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return
    starts, ended = [a for a, _ in words], -1
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        k = bisect_left(starts, b)  # the first word behind the run; words don't overlap, so the one before ends last
        near = (k > 0 and words[k - 1][1] > a - reach) or (k < len(words) and starts[k] < b + reach)
        if near or (ended >= 0 and BETWEEN.fullmatch(text, ended, a)):
            ended = b
            yield a, b
        else:
            ended = -1


def behind(text: str, key: str, at: int, n: int) -> str:
    """``n`` characters of the text from ``at`` on, copies of the key passed over."""
    out: list[str] = []
    while n > 0 and at < len(text):
        copy = text.find(key, at, at + n + len(key))
        part = text[at : at + n if copy < 0 else min(copy, at + n)]
        out.append(part)
        n -= len(part)
        at = at + len(part) + (len(key) if copy == at + len(part) else 0)
    return "".join(out)


def before(text: str, key: str, end: int, n: int) -> str:
    """The same of what stands before ``end``."""
    out: list[str] = []
    while n > 0 and end > 0:
        copy = text.rfind(key, max(0, end - n - len(key)), end)
        part = text[max(0, end - n) if copy < 0 else max(copy + len(key), end - n) : end]
        out.append(part)
        n -= len(part)
        end = end - len(part) - (len(key) if copy >= 0 and copy + len(key) == end - len(part) else 0)
    return "".join(reversed(out))


class Around:
    """What stands around places of a text, without its runs of key characters: keys are
    measured against code, not against each other."""

    def __init__(self, text: str):
        self.text, self.starts, self.gone, parts, at, n = text, [], [], [], 0, 0
        for m in CANDIDATE.finditer(text):
            parts.append(text[at : m.start()])
            n += m.start() - at
            self.starts.append(m.start())
            self.gone.append((m.end(), n))  # a run's end, and the characters kept before it
            at = m.end()
        self.kept = "".join([*parts, text[at:]])

    def place(self, at: int) -> int:
        k = bisect_right(self.starts, at) - 1
        if k < 0:
            return at
        end, n = self.gone[k]
        return n + max(0, at - end)

    def share(self, a: int, b: int, novelty: Novelty, around: int = AROUND) -> float:
        key = self.text[a:b]
        return novelty.share(before(self.kept, key, self.place(a), around), key, behind(self.kept, key, self.place(b), around))


def measured(text: str, low: str, base: list[tuple[str, int, int]], novelty: Novelty, reach: int = REACH) -> list[tuple[str, int, int, float]]:
    """Base spans and candidates with their novelty; candidates that overlap a base span
    are that span's matter.  A candidate's other places are candidates wherever they stand."""
    keys = list(in_context(text, reach)) if any(stem in low for stem in _STEMS) else []
    if not base and not keys:
        return []
    known, around = {}, Around(text)

    def share(a: int, b: int) -> float:
        key = text[a:b]
        if key not in known:
            known[key] = around.share(a, b, novelty)
        return known[key]

    out = [(kind, a, b, share(ASSIGN.match(text, a).start(2) if kind == "assign" else a, b)) for kind, a, b in base]
    if keys:
        strings = {text[a:b] for a, b in keys}
        taken = sorted((a, b) for _, a, b in base)
        k, end = 0, -1
        for a, (b, _) in zip(around.starts, around.gone, strict=True):
            while k < len(taken) and taken[k][0] < b:
                end = max(end, taken[k][1])
                k += 1
            if a >= end and text[a:b] in strings:
                out.append(("novel", a, b, share(a, b)))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(text: str | None, novelty: Novelty, least: float = NOVEL) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], list[float]]:
    """Base spans; all spans by start; the novelty of each of the latter."""
    text = text or ""
    low = text.lower()
    base = base_spans(text, low)
    order = {k: n for n, k in enumerate((*KINDS, "novel"))}
    found = sorted((x for x in measured(text, low, base, novelty) if x[0] != "novel" or x[3] >= least), key=lambda s: (s[1], order[s[0]]))
    return base, [x[:3] for x in found], [x[3] for x in found]


def redact(text: str | None, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span (overlaps merged) replaced by ``mark``."""
    out, at, text = [], 0, text or ""
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def dictionary(docs: DataFrame, words: int = WORDS) -> bytes:
    """``primer`` of the words found in most of the documents with a sensitive word."""
    struct, schema = arrow_schema("word string, n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def handed_on():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)
            counts.clear()
            return out

        for rows in rows_of(batches):
            for (text,) in rows:
                if any(stem in text.lower() for stem in _STEMS) and SENSITIVE.search(text):
                    counts.update(set(_PIECE.findall(text)))
                    if len(counts) >= PIECES_AT_ONCE:
                        yield handed_on()
        if counts:
            yield handed_on()

    counted = doc_texts(docs).select("text").mapInArrow(run, struct).groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    return primer([r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(words).collect()])


def find_secrets(docs: DataFrame, least: float = NOVEL) -> DataFrame:
    """doc_id, counts, digest, spans, their novelty (thousandths, joined by commas)
    and n_novel for every row of ``docs``."""
    primed = docs.sparkSession.sparkContext.broadcast(dictionary(docs))

    def make():
        novelty = Novelty(primed.value)

        def row(doc_id, text):
            base, spans, shares = scan(text, novelty, least)
            count = [sum(k == x for k, _, _ in base) for x in KINDS]
            said = ",".join(str(round(1000 * x)) for x in shares)
            return (doc_id, *count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), said, len(spans) - len(base))

        return row

    ddl = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, novelty string, n_novel bigint"
    return map_rows(doc_texts(docs), make, ddl)


def redacted(docs: DataFrame, least: float = NOVEL) -> DataFrame:
    """doc_id and text of every row, with each reported span replaced."""
    primed = docs.sparkSession.sparkContext.broadcast(dictionary(docs))

    def make():
        novelty = Novelty(primed.value)
        return lambda doc_id, text: (doc_id, redact(text, scan(text, novelty, least)[1]))

    return map_rows(doc_texts(docs), make, "doc_id bigint, text string")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


QUERIES = {"op3_secrets": op3_secrets}
