"""Operator 12: fill-in-middle transformation, as a pipeline of pyarrow.compute.

A text is cut in units (code points; lines or words by parameter).  For each batch the
units become one list array, whose strings are slices of the batch's own text buffer; it
is flattened with parent indices, ordinals are places less the parent's first place, a
unit's role (prefix, middle, suffix) comes from its ordinal and the two cuts, the units of
a role are filtered, rebuilt as lists and joined to pieces, and pieces and markers are
joined element by element.  ``restored`` takes outputs apart again by their markers.

Cuts and form are drawn from a hash of the document's id: prefix up to the smaller of
h1 % (n + 1) and h2 % (n + 1), middle up to the larger; h3 % 100 from ``whole`` on leaves
the text plain, h4 % 100 under ``suffix_first`` gives spm, else psm.

Memory: texts go through in groups of ``GROUP_BYTES``, and a longer text in blocks of so
many bytes, each cut where a unit starts; the pieces of its blocks are joined by a second
list array.  A worker holds a text, its pieces and a block's units.

Defined results: a null text is empty; an empty text, or one that holds a marker, stays
plain.  Plain rows have no prefix and middle (null).  A null ``doc_id`` hashes as the
empty text.  Repeated rows are rows of their own with equal results.  Further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_schema, doc_texts, documents

#: The markers.
PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
WHOLE, SUFFIX_FIRST, SEED = 90, 20, 1
GROUP_BYTES = 1 << 20
NOTHING = pa.scalar("", pa.large_string())
DRAWS = "h1 bigint, h2 bigint, h3 bigint, h4 bigint"
FORMS = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"

# ----------------------------------------------------------------------- units
def _after(is_end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(is_end), bool)
    out[1:] = is_end[:-1]
    return out


def _word_starts(data: np.ndarray) -> np.ndarray:
    space = (data == 32) | ((data >= 9) & (data <= 13))
    return _after(space) & ~space


#: Where units start, from the bytes of UTF-8; a text's first byte always starts one.
UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "char": lambda data: (data & 0xC0) != 0x80,
    "line": lambda data: _after(data == 10),
    "word": _word_starts,
}


def _strings(offsets: np.ndarray, data: pa.Buffer) -> pa.LargeStringArray:
    """Strings that are slices of ``data``: nothing is copied."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), data)


def _blocks(offsets: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of blocks of about ``size`` bytes that start where units do, and each block's row."""
    ends, rows = [], []
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while a < b:
            end = min(b, a + size)
            while end < b and not starts[end]:
                more = starts[end : end + size]
                k = int(more.argmax()) if len(more) else 0
                end = min(b, end + (k if len(more) and more[k] else max(1, len(more))))
            ends.append(end)
            rows.append(row)
            a = end
    return np.array(ends, np.int64), np.array(rows, np.int64)


def _ordinals(parents: pa.Array, firsts: np.ndarray) -> pa.Array:
    """Each unit's place in its text: its place in the batch, less where its list begins."""
    return pc.add(pa.array(np.arange(len(parents), dtype=np.int64)), pc.take(pa.array(firsts), parents))


def joined(units: pa.LargeListArray, keep: pa.Array) -> pa.Array:
    """The kept units of each list as one string."""
    parents = pc.filter(pc.list_parent_indices(units), keep)
    counts = np.bincount(parents.to_numpy(), minlength=len(units))
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)), pc.filter(pc.list_flatten(units), keep))
    return pc.binary_join(lists, NOTHING)


def pieces(texts: pa.LargeStringArray, draws: tuple[pa.Array, pa.Array], unit: str = "char", size: int = GROUP_BYTES) -> tuple[pa.Array, pa.Array, pa.Array, list[pa.Array]]:
    """For each text: units, where the prefix and the middle end, and the three pieces."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2] or pa.py_buffer(b"")
    starts = np.zeros(int(offsets[-1]), bool)
    begin = int(offsets[0])
    starts[begin:] = UNITS[unit](np.frombuffer(data, np.uint8)[begin : int(offsets[-1])])
    starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    ends, rows = _blocks(offsets, starts, size)
    block_at = np.concatenate([[begin], ends])
    many = np.array([np.count_nonzero(starts[a:b]) for a, b in zip(block_at[:-1], block_at[1:], strict=True)], np.int64)
    n_np = np.bincount(rows, many, len(texts)).astype(np.int64)
    n = pa.array(n_np)
    m = pc.add(n, 1)
    cuts = [pc.subtract(h, pc.multiply(pc.divide(h, m), m)) for h in draws]  # remainders
    lo, hi = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    before = np.cumsum(many) - many  # units of the batch before each block
    row_first = np.cumsum(n_np) - n_np
    parts: list[list[pa.Array]] = [[], [], []]
    at = 0
    while at < len(ends):  # some blocks at a time
        to = max(at + 1, int(np.searchsorted(ends, block_at[at] + size, side="right")))
        a, b = int(block_at[at]), int(ends[to - 1])
        unit_at = np.concatenate([np.flatnonzero(starts[a:b]) + a, [b]]).astype(np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many[at:to])])), _strings(unit_at, data))
        parents = pc.list_parent_indices(lists)
        place = _ordinals(parents, before[at] - row_first[rows[at:to]])
        low, high = (pc.take(pc.take(c, pa.array(rows[at:to])), parents) for c in (lo, hi))
        in_prefix, in_suffix = pc.less(place, low), pc.greater_equal(place, high)
        for part, keep in zip(parts, (in_prefix, pc.invert(pc.or_(in_prefix, in_suffix)), in_suffix), strict=True):
            part.append(joined(lists, keep))
        at = to
    by_row = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(texts)))]).astype(np.int64))
    none = pa.array([], pa.large_string())
    whole = [pc.binary_join(pa.LargeListArray.from_arrays(by_row, pa.concat_arrays([none, *p])), NOTHING) for p in parts]
    return n, lo, hi, whole


# ----------------------------------------------------------------- the transform
def transformed(texts: pa.LargeStringArray, draws: list[pa.Array], unit: str = "char", whole: int = WHOLE, suffix_first: int = SUFFIX_FIRST) -> list[pa.Array]:
    """n, form, prefix units, middle units and output of each text."""
    h1, h2, h3, h4 = draws
    n, lo, hi, (prefix, middle, suffix) = pieces(texts, (h1, h2), unit)
    hundredth = lambda h: pc.subtract(h, pc.multiply(pc.divide(h, 100), 100))
    plain = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.greater_equal(hundredth(h3), whole))
    for marker in MARKERS:
        plain = pc.or_(plain, pc.match_substring(texts, marker))
    spm = pc.less(hundredth(h4), suffix_first)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    big = lambda s: pa.scalar(s, pa.large_string())
    first = pc.if_else(spm, pc.binary_join_element_wise(big(SUFFIX), suffix, big(PREFIX), prefix, NOTHING), pc.binary_join_element_wise(big(PREFIX), prefix, big(SUFFIX), suffix, NOTHING))
    output = pc.if_else(plain, texts, pc.binary_join_element_wise(first, big(MIDDLE), middle, NOTHING))
    null = pa.scalar(None, pa.int64())
    return [n, form, pc.if_else(plain, null, lo), pc.if_else(plain, null, pc.subtract(hi, lo)), output]


def _split(texts: pa.Array, marker: str) -> tuple[pa.Array, pa.Array]:
    halves = pc.split_pattern(texts, marker)
    return pc.list_element(halves, 0), pc.list_element(halves, 1)


def taken_apart(forms: pa.Array, outputs: pa.Array) -> pa.Array:
    """The texts that outputs of the given forms were made from."""
    out = outputs
    for form, first, second in (("psm", PREFIX, SUFFIX), ("spm", SUFFIX, PREFIX)):
        here = pc.equal(forms, form)
        some = pc.filter(outputs, here)
        if not len(some):
            continue
        head, tail = _split(some, second)
        one, (two, middle) = _split(head, first)[1], _split(tail, MIDDLE)
        ordered = (one, middle, two) if form == "psm" else (two, middle, one)
        out = pc.replace_with_mask(out, here, pc.binary_join_element_wise(*ordered, NOTHING))
    return out


def _groups(batch: pa.RecordBatch, column: int, size: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of about ``size`` bytes of text, one at least."""
    bytes_to = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bytes_to, (bytes_to[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def draws_of(doc_id: str | Column, seed: int = SEED) -> list[Column]:
    """h1 to h4: the first four groups of eight hexadecimal digits, as numbers."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "char", whole: int = WHOLE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (units) and output of every row."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    struct, schema = arrow_schema(FORMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _groups(batch, 1):
                texts = pa.concat_arrays([part.column(1).cast(pa.large_string())])
                made = transformed(texts, part.columns[2:], unit, whole, suffix_first)
                yield pa.RecordBatch.from_arrays([part.column(0), *(c.cast(f.type) for c, f in zip(made, list(schema)[1:], strict=True))], schema=schema)

    return doc_texts(docs).select("doc_id", "text", *draws_of("doc_id", seed)).mapInArrow(run, struct)


def restored(made: DataFrame, name: str = "restored") -> DataFrame:
    """``made`` (form, output and more) with the text rebuilt from these two as ``name``."""
    struct = T.StructType([*made.schema.fields, T.StructField(name, T.StringType())])
    schema = to_arrow_schema(struct)
    form, output = made.columns.index("form"), made.columns.index("output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _groups(batch, output):
                text = taken_apart(part.column(form), pa.concat_arrays([part.column(output).cast(pa.large_string())]))
                yield pa.RecordBatch.from_arrays([*part.columns, text.cast(pa.string())], schema=schema)

    return made.mapInArrow(run, struct)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restored(fill_in_middle(documents(spark, sf_dir)))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


def _h(k: int) -> str:
    return f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"


ORACLE = f"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(t)::BIGINT AS n, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), cuts AS (SELECT *, least({_h(0)} % (n + 1), {_h(1)} % (n + 1)) AS lo, greatest({_h(0)} % (n + 1), {_h(1)} % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_h(2)} % 100 >= {WHOLE} THEN 'plain'
       WHEN {_h(3)} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM d
), cut AS (SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM cut"""

QUERIES = {"op12_infill": op12_infill}
ORACLE_SQL = {"op12_infill": ORACLE}
