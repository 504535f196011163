"""Operator 7: personal data, with information-theoretic sanitisation.

Base patterns find e-mail addresses, IPv4 addresses, card numbers and phone
numbers.  The method then asks how strongly the terms of a document give such an
entity away: over the whole corpus it counts the documents with each entity (n_e), with
a term (n_t) and with both (n_te), wherever in the document the term stands, and takes

    share = pmi(term; entity) / ic(entity),
    pmi = log2(n_te * N / (n_t * n_e)),   ic = log2(N / n_e),

which is 1 where the term occurs only with the entity and 0 where they are
independent.  Terms whose share is ``generalise`` or more are disclosing: all their
places in the entity's documents are reported as spans and, in the sanitised text,
generalised to their class, or removed if the share is ``remove`` or more.

What stands in one text only, copies and near copies of it included, says nothing
about an entity: entity and term count only if they stand together in texts of two
classes.  A class is a component of near-copy links between texts of documents whose
entities repeat.  Links are searched by bands of ``ROWS`` of ``HASHES`` min-hashes of a
text's longer terms, each text with the first of its band, and hold where ``NEAR`` of all
the min-hashes agree, so that texts that share half of their terms are different ones.

Scale: entities in texts of one class only are dropped before terms are looked at, and
of the other entities' documents only terms that are rare enough to pass the threshold
with the most frequent of the document's entities:

    n_t <= n_e * (N / n_e) ** (1 - generalise).

So an entity in every document meets no terms, and common words meet no entity.  Entities
that stand in the same documents are one group, and so are terms; groups meet in each
document, so a directory's thousands of addresses and names, which share its documents,
are a pair and not all pairs.  An entity or term in a third of all documents is summed and
joined in parts (``beside_group``).  All counts cover all documents; the driver gets
numbers of rows.

Defined results: a null text is empty; empty texts have no span and the hash of
the empty string.  Spans are code-point offsets, end exclusive; base spans of different
kinds may overlap, and terms are looked for outside of them.  Repeated rows each count
as a document.  Failing matches are dropped and nothing is tried inside them.  Patterns
take time in proportion to a text's length, however long its runs of digits are.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, beside_group, components, documents, map_rows, row_keys, rows_of, small_or_shuffled, stored

#: The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # inside a run of digits nothing else could match
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
_TERM = re.compile(r"[^\W\d_]{3,}")

GENERALISE, REMOVE = 0.8, 0.95
#: Letters of the terms that tell texts apart; min-hashes, those of a band, and the share
#: of all that makes a near copy.
LONGER, HASHES, ROWS, NEAR = 6, 320, 8, 0.7
_FACTORS = np.random.default_rng(7).integers(1 << 62, size=HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
KEYS = ["__sk_k1", "__sk_k2"]
#: Terms that a worker counts before it hands its partial counts on.
TERMS_AT_ONCE = 100_000


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


_EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def _emails(text: str) -> list[tuple[int, int]]:
    """EMAIL's matches, found from the @ outwards: a local part runs back from it
    as far as its characters go, but not into the match before."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        tail = _DOMAIN.match(text, at)
        a = at
        if tail:
            while a > done and text[a - 1] in _EMAIL_CHARS:
                a -= 1
        if tail and a < at:
            out.append((a, tail.end()))
            done = tail.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(int(p[-4:]) <= 255 and (len(p) < 5 or not p[:-4].strip("0")) for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= ch <= "9" for ch in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def blanked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with its base spans as spaces: terms are looked for around them."""
    out, at = [], 0
    for a, b in sorted((a, b) for _, a, b in spans):
        if b > at:
            a = max(a, at)
            out += [text[at:a], " " * (b - a)]
            at = b
    return "".join([*out, text[at:]])


def lowered(text: str) -> str:
    """Lower case, place for place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _key(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def longer(terms: set[str]) -> list[str]:
    """The terms that tell texts apart: the longer ones, all if there are none."""
    return sorted([t for t in terms if len(t) >= LONGER] or terms)


def text_id(terms: set[str]) -> int:
    return _key("\n".join(longer(terms)))


def sketch(terms: set[str]) -> list[int]:
    """Min-hashes of the longer terms."""
    some = longer(terms)
    h = np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in some), np.uint64, len(some))
    h ^= h >> np.uint64(29)
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        mixed = h[at : at + 4096, None] * _FACTORS[None, :]
        out = np.minimum(out, (mixed ^ (mixed >> np.uint64(31))).min(axis=0))
    return out.view(np.int64).tolist()


def keyed_texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), *row_keys("doc_id", text))


PASS = (
    "doc_id bigint, __sk_k1 bigint, __sk_k2 bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, base_sha256 string, "
    "sanitised_sha256 string, entities array<bigint>, text_id bigint"
)


def base_pass(texts: DataFrame) -> DataFrame:
    """Base results of every row; its entities and, where it has any, what tells
    its text from others."""

    def row(doc_id, text, k1, k2):
        spans = base_spans(text)
        base = joined(spans)
        entities = sorted({_key(text[a:b].lower()) for _, a, b in spans})
        terms = set(_TERM.findall(lowered(blanked(text, spans)))) if spans else set()
        clean = sanitise(text, base) if spans else text
        n = [sum(k == x for k, _, _ in spans) for x in KINDS]
        return (doc_id, k1, k2, *n, base, _sha(base), _sha(clean), entities, text_id(terms))

    return map_rows(texts, lambda: row, PASS)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def outside(text: str) -> set[str]:
    """The terms outside base spans; of these only addresses have letters."""
    if "@" in text:
        text = blanked(text, [("email", a, b) for a, b in _emails(text)])
    return set(_TERM.findall(lowered(text)))


def term_counts(texts: DataFrame) -> DataFrame:
    """term (its hash), n: partial counts of the documents with each term."""
    struct, schema = arrow_schema("term bigint, n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def handed_on():
            keys, ns = pa.array(map(_key, counts), pa.int64()), pa.array(counts.values(), pa.int64())
            counts.clear()
            return pa.RecordBatch.from_arrays([keys, ns], schema=schema)

        for rows in rows_of(batches):
            for (text,) in rows:
                counts.update(outside(text))
                if len(counts) >= TERMS_AT_ONCE:
                    yield handed_on()
        if counts:
            yield handed_on()

    return texts.select("text").mapInArrow(run, struct)


def _of(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The texts whose row keys are in ``keys``, each once."""
    return texts.join(small_or_shuffled(keys, keys.count()), KEYS, "left_semi").dropDuplicates(KEYS)


def classes(sketches: DataFrame) -> DataFrame:
    """text_id, class: components of near copies among texts (text_id, sketch)."""
    spark = sketches.sparkSession
    bands = [F.struct(F.lit(k).alias("band"), F.xxhash64(F.slice("sketch", k * ROWS + 1, ROWS)).alias("h")) for k in range(HASHES // ROWS)]
    each = stored(sketches.select("text_id", F.explode(F.array(*bands)).alias("b")).select("text_id", "b.band", "b.h"), "bands")
    first = beside_group(each, ["band", "h"], F.col("text_id"), [F.min("text_id").alias("m")], [F.min("m").alias("first")])
    met = first.where("text_id <> first").select("text_id", "first").distinct()
    other = sketches.select(F.col("text_id").alias("first"), F.col("sketch").alias("of_first"))
    same = F.aggregate(F.zip_with("sketch", "of_first", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    links = stored(met.join(sketches, "text_id").join(other, "first").where(same >= NEAR * HASHES).select(F.col("text_id").alias("a"), F.col("first").alias("b")), "links")
    roots = components(links, "pii") if links.limit(1).count() else spark.createDataFrame([], "node bigint, root bigint")
    found = sketches.select("text_id").join(roots, F.col("text_id") == F.col("node"), "left")
    return stored(found.select("text_id", F.coalesce("root", "text_id").alias("class")), "classes")


#: A group of entities or terms: what its documents add up to.
_SETS = ("x", "y")


def _set_sums(*more) -> list:
    """Two hashes of the set of documents that a group's rows name."""
    return [F.bit_xor(F.xxhash64(F.lit(seed), *KEYS)).alias(f"{name}_") for seed, name in enumerate(_SETS)] + list(more)


def _put_together(*more) -> list:
    return [F.bit_xor(f"{name}_").alias(name) for name in _SETS] + list(more)


def _ends(column: str) -> list:
    return [F.min(column).alias("lo_"), F.max(column).alias("hi_")]


def _both_ends() -> list:
    return [F.min("lo_").alias("lo"), F.max("hi_").alias("hi")]


def disclosures(texts: DataFrame, rows: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """Row keys, terms (array of term and share): what gives an entity of a document
    away in it.  ``rows`` is what ``base_pass`` gives, stored."""
    n_docs = float(max(1, rows.count()))
    salt = F.xxhash64(*KEYS)
    each = rows.where(F.size("entities") > 0).select(*KEYS, "text_id", F.explode("entities").alias("entity"))
    held = stored(each.groupBy("entity", *KEYS, "text_id").agg(F.count("*").alias("m")), "held")
    # entities in different texts; then, in texts of different classes
    again = stored(beside_group(held, ["entity"], salt, _ends("text_id"), _both_ends()).where("lo <> hi").drop("lo", "hi"), "again")

    def terms_of(k1, k2, text):
        terms = outside(text)
        return k1, k2, sorted(map(_key, terms)), sketch(terms)

    some = _of(texts, again.select(*KEYS).distinct()).select(*KEYS, "text")
    read = stored(map_rows(some, lambda: terms_of, "__sk_k1 bigint, __sk_k2 bigint, terms array<bigint>, sketch array<bigint>"), "read")
    ids = again.select(*KEYS, "text_id").distinct()
    sketches = stored(read.join(ids, KEYS).select("text_id", "sketch").dropDuplicates(["text_id"]), "sketches")
    named = stored(again.join(classes(sketches), "text_id").select("entity", *KEYS, "m", "class"), "named")
    counted = beside_group(named, ["entity"], salt, _set_sums(F.sum("m").alias("m_"), *_ends("class")), _put_together(F.sum("m_").alias("n_e"), *_both_ends()))
    most = (F.col("n_e") * F.pow(F.lit(n_docs) / F.col("n_e"), F.lit(1 - generalise)) + 1e-6).alias("most")
    groups = counted.where("lo <> hi").where(F.col("n_e") < n_docs).select(*KEYS, "m", "class", F.struct(*_SETS, "n_e", most).alias("e")).distinct()
    per_doc = groups.groupBy(*KEYS, "m", "class").agg(F.collect_list("e").alias("es"), F.max("e.most").alias("most"))
    per_doc = stored(per_doc, "docs")
    near = stored(read.join(per_doc.select(*KEYS, "most"), KEYS).select(*KEYS, "most", F.explode("terms").alias("term")), "near")
    # a term must be in two documents; then, how many documents of the corpus have it
    twice = stored(near.groupBy("term").agg(F.count("*").alias("n"), F.max("most").alias("most")).where("n > 1").drop("n"), "twice")
    known = term_counts(texts).join(small_or_shuffled(twice, twice.count()), "term").groupBy("term").agg(F.sum("n").alias("n_t"), F.max("most").alias("most"))
    known = stored(known.where("n_t <= most").drop("most"), "known")
    # no cut by the document here: a group of terms is told by all of its documents
    placed = stored(near.join(small_or_shuffled(known, known.count()), "term").select(*KEYS, "term", "n_t"), "placed")
    grouped = beside_group(placed, ["term"], salt, _set_sums(), _put_together()).select(*KEYS, "term", F.struct(*_SETS, "n_t").alias("t"))
    grouped = stored(grouped, "terms")
    met = grouped.select(*KEYS, "t").distinct().join(per_doc, KEYS).where(F.col("t.n_t") <= F.col("most"))
    met = met.select(*KEYS, "m", "class", "t", F.explode(F.expr("filter(es, e -> t.n_t <= e.most)")).alias("e"))
    pairs = stored(met.select(*KEYS, "m", "class", "t", "e"), "pairs")
    scored = beside_group(pairs, ["e", "t"], salt, [F.sum("m").alias("m_"), *_ends("class")], [F.sum("m_").alias("n_te"), *_both_ends()])
    pmi = F.log2(F.col("n_te") * F.lit(n_docs) / (F.col("t.n_t").cast("double") * F.col("e.n_e")))
    scored = scored.where("lo <> hi").withColumn("share", pmi / F.log2(F.lit(n_docs) / F.col("e.n_e"))).where(F.col("share") >= generalise - 1e-12)
    told = grouped.join(scored.groupBy(*KEYS, "t").agg(F.max("share").alias("share")), [*KEYS, "t"])
    return told.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("term", "share"))).alias("terms"))


def term_spans(text: str, spans: list[tuple[str, int, int]], shares: dict[int, float]) -> list[tuple[int, int, float]]:
    """Places of disclosing terms, with their share."""
    found = ((m.start(), m.end(), shares.get(_key(m.group()))) for m in _TERM.finditer(lowered(blanked(text, spans))))
    return [x for x in found if x[2] is not None]


def find_personal(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row for each row of ``docs``: counts, digest, spans; n_terms (spans of
    disclosing terms), n_removed (of these, those that are removed), shares (of these
    spans, in thousandths) and the digest of the sanitised text."""
    texts = keyed_texts(docs)
    rows = stored(base_pass(texts), "pii")
    told = stored(disclosures(texts, rows, generalise), "told")
    some = _of(texts, told.select(*KEYS)).select(*KEYS, "text").join(told, KEYS)

    def row(k1, k2, text, terms):
        spans = base_spans(text)
        more = term_spans(text, spans, {t["term"]: t["share"] for t in terms})
        gone = frozenset((a, b) for a, b, share in more if share >= remove - 1e-12)
        said = joined(("term", a, b) for a, b, _ in more)
        shares = ",".join(str(round(1000 * x[2])) for x in more)
        return k1, k2, said, len(more), len(gone), shares, _sha(sanitise(text, ",".join(filter(None, (joined(spans), said))), gone))

    ddl = "__sk_k1 bigint, __sk_k2 bigint, said string, n_terms bigint, n_removed bigint, shares string, clean string"
    more = stored(map_rows(some, lambda: row, ddl), "more")
    n, width = more.agg(F.count("*"), F.coalesce(F.avg(F.length("said") + F.length("shares")), F.lit(0.0))).first()
    zero = F.lit(0).cast("bigint")
    return rows.join(small_or_shuffled(more, n, width + 200), KEYS, "left").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("said") != "", F.col("said"))).alias("spans"),
        F.coalesce("n_terms", zero).alias("n_terms"), F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("shares", F.lit("")).alias("shares"),
        F.coalesce("clean", "sanitised_sha256").alias("sanitised_sha256"),
    )


def sanitised(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id and text of every row, the text sanitised."""
    texts = keyed_texts(docs)
    told = stored(disclosures(texts, stored(base_pass(texts), "pii"), generalise), "told")
    n, width = told.agg(F.count("*"), F.coalesce(F.avg(F.size("terms")) * 16, F.lit(0.0))).first()

    def row(doc_id, text, terms):
        spans = base_spans(text)
        more = term_spans(text, spans, {t["term"]: t["share"] for t in terms or []})
        gone = frozenset((a, b) for a, b, share in more if share >= remove - 1e-12)
        return doc_id, sanitise(text, ",".join(filter(None, (joined(spans), joined(("term", a, b) for a, b, _ in more)))), gone)

    return map_rows(texts.join(small_or_shuffled(told, n, width + 100), KEYS, "left").select("doc_id", "text", "terms"), lambda: row, "doc_id bigint, text string")


def sanitise(text: str | None, spans: str, removed: frozenset[tuple[int, int]] = frozenset()) -> str:
    """Replaces every span of the ``spans`` string by its class, or by nothing if
    it is among ``removed``; overlapping spans merge into the first."""
    text, out, at = text or "", [], 0
    parts = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    for a, b, kind in parts:
        if a >= at:
            out += [text[at:a], "" if (a, b) in removed else f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(documents(spark, sf_dir))


QUERIES = {"op7_personal_data": op7_personal_data}
