"""Operator 4: license scans.

One Aho-Corasick automaton finds licence notices (as words standing together)
and identifier tags in a single pass over every whole text; expressions behind
the tags are read by a shunting-yard parser for ``and``, ``or`` and ``with`` and
evaluated: ``or`` lets the freer side be chosen, ``and`` binds to the stricter,
``with`` an exception frees a copyleft licence by one step.  A tag's place comes
from the automaton; its expression is what follows on the line of its last word.
Of notices that overlap, one within another doesn't count: "lesser general public
license" isn't a notice of the plain one there, but may be so elsewhere in the text.

Defined results: a null text is empty; an empty text has no words, no labels,
null ``first_word``/``last_word`` and score 0.  ``score`` is the freedom that the
document's licences leave (1 public domain or permissive, 0 all rights reserved
or nothing found); several notices bind together, so the strictest counts.  A tag
whose expression can't be parsed gives the label ``unparsed`` and score 0.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from .common import doc_texts, documents, map_rows

#: The contract's phrases.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Chosen: the method's notices.
NOTICES = {
    "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit", "isc license": "isc",
    "mozilla public license": "mpl", "eclipse public license": "epl", "boost software license": "bsl",
    "lesser general public license": "lgpl", "affero general public license": "agpl",
    "creative commons attribution": "cc-by", "licensed under cc by": "cc-by",
    "licensed under cc by sa": "cc-by-sa", "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by nd": "cc-by-nd", "licensed under cc0": "cc0", "cc0 1 0 universal": "cc0",
    "released into the public domain": "public-domain", "the unlicense": "unlicense",
    "all rights reserved": "reserved", "proprietary and confidential": "proprietary",
}
#: Chosen: freedom that a licence family leaves.
FREEDOM = {
    "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "mit": 1.0, "isc": 1.0, "bsd": 1.0, "0bsd": 1.0,
    "bsl": 1.0, "zlib": 1.0, "apache": 0.95, "cc-by": 0.9, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6,
    "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.3, "cc-by-nc": 0.2, "proprietary": 0.0, "reserved": 0.0,
}
TAG = "spdx license identifier"
WITH_FREES = 0.2
_UNKNOWN = 0.5
_GAP = bytes(32 if not (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) else c for c in range(256))
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_COLON = re.compile(r"[ \t]*:?")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # of the lower-cased text


def family(name: str) -> str:
    """The licence family of an identifier: ``GPL-3.0-only`` is ``gpl``."""
    low = name.lower().rstrip("+")
    for known in sorted(FREEDOM, key=len, reverse=True):
        if low == known or low.startswith(known + "-") or low.startswith(known + "."):
            return known
    return low


# ------------------------------------------------------------ expressions
def to_postfix(text: str, start: int = 0, end: int | None = None) -> list[str]:
    """Shunting-yard: licence names and operators in postfix order.  Operators
    in either case; ``with`` binds before ``and``, ``and`` before ``or``.  Reading
    stops before the first word that can't continue the expression.  ValueError
    where no expression stands or a parenthesis is open.  Reads text[start:end]."""
    rank = {"or": 1, "and": 2, "with": 3}
    out: list[str] = []
    held: list[str] = []
    operand = True  # whether a name may come now
    for m in _TOKEN.finditer(text, start, len(text) if end is None else end):
        token = m.group()
        low = token.lower()
        if low in rank:
            if operand:
                raise ValueError(f"operator without a left side: {token}")
            while held and held[-1] != "(" and rank[held[-1]] >= rank[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        elif token == "(":
            if not operand:
                break
            held.append("(")
        elif token == ")":
            if operand or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif operand:
            out.append(token)
            operand = False
        else:
            break
    if operand or "(" in held:
        raise ValueError(f"not a licence expression: {text[start : start + 80]!r}")
    return out + held[::-1]


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """Freedom, and the licence families named (exceptions aren't licences)."""
    stack: list[tuple[float, set[str]]] = []
    for token in postfix:
        if token in ("and", "or", "with"):
            (right, named), (left, names) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((min(1.0, left + WITH_FREES), names))
            else:
                stack.append((min(left, right) if token == "and" else max(left, right), names | named))
        else:
            name = family(token)
            stack.append((FREEDOM.get(name, _UNKNOWN), {name}))
    if len(stack) != 1:
        raise ValueError("operands left over")
    return stack[0]


# ------------------------------------------------------------------ scanning
@cache
def automaton():
    """Patterns are padded with a space on each side, as the scanned words are."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE, TAG: ""}.items():
        a.add_word(f" {phrase} ", (phrase, label))
    a.make_automaton()
    return a


def _tagged(text: str, first_words: list[int]):
    """Freedom and families of the expression behind each tag; ``first_words`` are
    the numbers of the tags' first words, ascending."""
    if not first_words:
        return
    last_words = iter([n + TAG.count(" ") for n in first_words])
    wanted, line_end = next(last_words), -1
    for k, m in enumerate(_WORD.finditer(text.lower() if text.isascii() else _ascii_lower(text))):
        if k < wanted:
            continue
        if m.end() > line_end:  # else the same line goes on
            line_end = text.find("\n", m.end())
            line_end = len(text) if line_end < 0 else line_end
        try:
            yield evaluate(to_postfix(text, _COLON.match(text, m.end()).end(), line_end))
        except ValueError:
            yield 0.0, {"unparsed"}
        wanted = next(last_words, None)
        if wanted is None:
            return


_LOWER = {c: c + 32 for c in range(65, 91)}


def _ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").lower().translate(_GAP).split(b" ")  # bytes.lower: A-Z only
    words = [w for w in words if w]
    flat = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    found = [(end - len(phrase) - 1, phrase, label) for end, (phrase, label) in automaton().iter(flat)]
    starts = sorted(at for at, phrase, _ in found if phrase in BASE)
    number = lambda at: flat.count(" ", 0, at) if at else 0  # noqa: E731  of the word after the space at ``at``
    base = {label for _, phrase, label in found if phrase in BASE}
    own, last = set(), -1
    for at, phrase, label in sorted((x for x in found if x[2]), key=lambda x: (x[0], -len(x[1]))):
        if at + len(phrase) > last:  # else it stands within a longer notice
            own.add(label)
            last = at + len(phrase)
    scores = [FREEDOM[x] for x in own]
    labels = base | own
    at, n, tags = 0, 0, []
    for place in (at for at, phrase, _ in found if phrase == TAG):  # ascending: ends of one phrase
        n, at = n + flat.count(" ", at, place), place
        tags.append(n)
    for freedom, names in _tagged(text, tags):
        scores.append(freedom)
        labels |= names
    ends = (number(starts[0]), number(starts[-1])) if starts else (None, None)
    return (len(words), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), float(min(scores, default=0.0)))


RESULT = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def find_licenses(docs: DataFrame) -> DataFrame:
    return map_rows(doc_texts(docs), lambda: lambda i, t: (i, *scan(t)), f"doc_id bigint, {RESULT}")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(documents(spark, sf_dir))


QUERIES = {"op4_licenses": op4_licenses}
