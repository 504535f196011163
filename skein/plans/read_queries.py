"""Queries over reads-shaped views of the given tables, and SQL to hold them to.

Views are built by text that Spark and DuckDB both read: bases come from MD5
digests, samples from ``nation``, reads from ``orders`` and ``events``.  The SQL of
each query computes its result another way (position by position, with window
functions), so that a shared mistake can't pass.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import bases, blocks, headers
from skein.operators import matcher, metrics, samples, sampling, segments, zipping
from skein.operators.samples import Sample, SampleGroup
from skein.plans.demux import METRICS_FILE, Demux, read_sets, routed, target_files
from skein.plans.structure import ReadStructure
from skein.plans.subsample import Subsample
from skein.sources.fastq import open_store, read_fastq
from skein.sources.folders import passing_path, written
from skein.sources.sinks import CHUNK_RECORDS, record_text, write_fastq

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = ("nation", "orders", "events")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# ----------------------------------------------------------------------- views
def bases_sql(key: str) -> str:
    return f"translate(md5(CAST({key} AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def samples_sql(length: int) -> str:
    raw = f"substr({bases_sql('n_nationkey')}, 1, {length})"
    return f"""(SELECT CAST(n_nationkey AS INT) AS ordinal, n_name AS sample_id,
      CASE WHEN n_nationkey % 5 = 1 THEN substr(raw, 1, 3) || 'N' || substr(raw, 5)
           WHEN n_nationkey % 5 = 2 THEN substr(raw, 1, 6) || 'R' || substr(raw, 8) ELSE raw END AS barcode
      FROM (SELECT n_nationkey, n_name, {raw} AS raw FROM {{nation}}) AS n)"""


def reads_sql(length: int) -> str:
    """ord, obs: a nation's barcode, whole or with one or two bases changed, or a
    random one."""
    return f"""(SELECT o_orderkey AS ord,
      CASE WHEN c >= 25 THEN substr({bases_sql("'x' || CAST(o_orderkey AS STRING)")}, 1, {length})
           WHEN m = 1 THEN substr(raw, 1, p) || 'N' || substr(raw, p + 2)
           WHEN m = 2 THEN substr(raw, 1, p) || 'A' || substr(raw, p + 2)
           WHEN m = 3 THEN 'T' || substr(raw, 2, p) || 'C' || substr(raw, p + 3) ELSE raw END AS obs
      FROM (SELECT o_orderkey, o_custkey % 30 AS c, (o_orderkey * 7 + o_custkey) % 5 AS m, CAST((o_orderkey + o_custkey) % {length - 2} AS INT) AS p,
                   substr({bases_sql('o_custkey % 30')}, 1, {length}) AS raw FROM {{orders}}) AS o)"""


#: Two inputs of FASTQ-like records; some reads of the first are short, the second
#: lacks every 97th.
RECORDS_1 = f"""(SELECT o_orderkey AS ord, 'run:1:' || CAST(o_orderkey AS STRING) || ' 1:N:0:0' AS header,
      CASE WHEN o_orderkey % 41 = 0 THEN substr(b, 1, 9) ELSE b END AS seq, CASE WHEN o_orderkey % 41 = 0 THEN ';;;;;;;;;' ELSE repeat(';', 64) END AS qual
      FROM (SELECT o_orderkey, {bases_sql('o_custkey')} || {bases_sql('o_orderkey')} AS b FROM {{orders}}) AS o)"""
RECORDS_2 = f"""(SELECT o_orderkey AS ord, 'run:1:' || CAST(o_orderkey AS STRING) || ' 2:N:0:0' AS header, b AS seq, repeat(':', 32) AS qual
      FROM (SELECT o_orderkey, {bases_sql("'r' || CAST(o_orderkey AS STRING)")} AS b FROM {{orders}} WHERE o_orderkey % 97 <> 96) AS o)"""
EVENT_NAMES = """(SELECT event_id AS ord, event_type || ':' || CAST(user_id AS STRING) ||
      CASE WHEN event_id % 7 = 0 THEN '/1' WHEN event_id % 7 = 1 THEN '/2' WHEN event_id % 7 = 2 THEN '/3' ELSE '' END ||
      CASE WHEN event_id % 3 = 0 THEN ' some comment' WHEN event_id % 3 = 1 THEN chr(9) || 'comment' ELSE '' END AS header FROM {events})"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql("SELECT * FROM " + sql.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}) + " AS v")


def duck(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES})


def _cast(df: DataFrame, **types: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


# -------------------------------------------------------------------- matching
def mask_sql(base: str) -> str:
    return f"instr('{bases.LETTERS}', translate(upper({base}), 'U.', 'TN'))"


def match_sql(length: int, most: int, delta: int, samples: str | None = None) -> str:
    """best, next and ordinal for each read, from per-position comparisons."""
    return duck(f"""
WITH samples AS {samples or samples_sql(length)}, reads AS {reads_sql(length)},
places AS (SELECT unnest(range(1, {length + 1})) AS p),
distances AS (
  SELECT obs, ordinal, sample_id, count(*) FILTER (WHERE {mask_sql('substr(obs, p, 1)')} & ({mask_sql('substr(barcode, p, 1)')} # 15) <> 0) AS mm
  FROM (SELECT DISTINCT obs FROM reads), samples, places GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER w AS place, coalesce(lead(mm) OVER w, 255) AS next_mm FROM distances WINDOW w AS (PARTITION BY obs ORDER BY mm, ordinal)
), found AS (SELECT * FROM ranked WHERE place = 1 AND mm <= {most} AND next_mm - mm >= {delta}),
matched AS (SELECT ord, reads.obs, ordinal AS best_ordinal, CAST(mm AS INT) AS best_mismatches, CAST(next_mm AS INT) AS next_best_mismatches FROM reads LEFT JOIN found USING (obs))
""").replace("(" + mask_sql("substr(barcode, p, 1)") + " # 15)", f"xor({mask_sql('substr(barcode, p, 1)')}, 15)")


def matched(spark: SparkSession, sf_dir: str, length: int = 12, most: int = 1, delta: int = 2, samples: str | None = None) -> tuple[DataFrame, DataFrame]:
    sheet = view(spark, sf_dir, samples or samples_sql(length))
    return matcher.match_barcodes(view(spark, sf_dir, reads_sql(length)), sheet, length, "obs", most, delta), sheet


_MATCH_COLUMNS = "SELECT ord, obs, best_ordinal, best_mismatches, next_best_mismatches FROM matched"
_METRICS_SQL = """
, counts AS (
  SELECT ordinal, sample_id, barcode, (SELECT count(*) FROM matched WHERE best_ordinal = s.ordinal) AS templates FROM samples AS s
), totals AS (SELECT (SELECT count(*) FROM matched) AS every, sum(templates) AS own, max(templates) AS best, count(*) AS n FROM counts
), rows AS (
  SELECT * FROM counts UNION ALL SELECT n, 'unmatched', '.', every - own FROM totals
)
SELECT CAST(ordinal AS INT) AS ordinal, sample_id, barcode, CAST(templates AS BIGINT) AS templates, CAST(templates AS DOUBLE) / every AS frac_templates,
       CAST(templates AS DOUBLE) / (CAST(own AS DOUBLE) / n) AS ratio_to_mean, CAST(templates AS DOUBLE) / best AS ratio_to_best
FROM rows, totals"""


@query(match_sql(12, 1, 2) + _METRICS_SQL)
def demux_metrics(spark, sf_dir):
    m, sheet = matched(spark, sf_dir)
    return metrics.demux_metrics(m, sheet)


@query(match_sql(17, 1, 2) + _METRICS_SQL)
def demux_metrics_long(spark, sf_dir):
    m, sheet = matched(spark, sf_dir, 17)
    return metrics.demux_metrics(m, sheet)


@query(match_sql(12, 1, 2) + _MATCH_COLUMNS)
def barcode_match(spark, sf_dir):
    return matched(spark, sf_dir)[0]


@query(match_sql(17, 1, 2) + _MATCH_COLUMNS)
def barcode_match_long(spark, sf_dir):
    return matched(spark, sf_dir, 17)[0]


@query(match_sql(12, 3, 1) + _MATCH_COLUMNS)
def barcode_match_iupac(spark, sf_dir):
    """Loose limits, so that ambiguity codes decide."""
    return matched(spark, sf_dir, 12, 3, 1)[0]


@query(match_sql(12, 0, 0) + _MATCH_COLUMNS)
def barcode_match_strict(spark, sf_dir):
    return matched(spark, sf_dir, 12, 0, 0)[0]


_ONE = "(SELECT CAST(0 AS INT) AS ordinal, n_name AS sample_id, 'NNNNNNNNNNNN' AS barcode FROM {nation} WHERE n_nationkey = 0)"


@query(match_sql(12, 0, 2, _ONE) + _MATCH_COLUMNS)
def barcode_match_single_sample(spark, sf_dir):
    """A catch-all sheet: the second best is the sentinel 255."""
    return matched(spark, sf_dir, 12, 0, 2, _ONE)[0]


#: A sample for each order, some with ambiguity codes; reads of events: a sample's
#: barcode with up to two bases changed, or a random one.
_LARGE_SAMPLES = f"""(SELECT o_orderkey, CAST(o_orderkey AS STRING) AS sample_id,
      CASE WHEN o_orderkey % 50 = 0 THEN substr(raw, 1, 3) || 'N' || substr(raw, 5) WHEN o_orderkey % 50 = 1 THEN substr(raw, 1, 9) || 'R' || substr(raw, 11) ELSE raw END AS barcode
      FROM (SELECT o_orderkey, substr({bases_sql('o_orderkey')}, 1, 15) AS raw FROM {{orders}}) AS o)"""
_LARGE_SHEET = f"(SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INT) AS ordinal, sample_id, barcode FROM {_LARGE_SAMPLES} AS s)"
_LARGE_READS = f"""(SELECT event_id AS ord, CASE WHEN event_id % 5 = 0 THEN substr({bases_sql("'e' || CAST(event_id AS STRING)")}, 1, 15)
      WHEN event_id % 5 = 1 THEN substr(raw, 1, 6) || 'N' || substr(raw, 8) WHEN event_id % 5 = 2 THEN 'A' || substr(raw, 2, 12) || 'GT' WHEN event_id % 5 = 3 THEN raw
      ELSE substr(raw, 1, 10) || 'C' || substr(raw, 12) END AS obs
      FROM (SELECT e.event_id, substr({bases_sql('o.o_orderkey')}, 1, 15) AS raw FROM {{events}} AS e JOIN {{orders}} AS o ON o.o_orderkey = e.event_id % 15000) AS e)"""


def _packed_sql(c: str) -> str:
    return f"('0x' || translate({c}, 'ACMGRSVTWYHKDBN', '123456789ABCDEF'))::BIGINT"


@query(duck(f"""WITH s AS {_LARGE_SHEET}, r AS {_LARGE_READS}, p AS (SELECT ordinal, {_packed_sql('barcode')} AS e, xor({_packed_sql('barcode')}, 1152921504606846975) AS ne FROM s
), o AS (SELECT obs, {_packed_sql('obs')} AS m FROM (SELECT DISTINCT obs FROM r)
), d AS (SELECT obs, ordinal, bit_count(((m & ne) | ((m & ne) >> 1) | ((m & ne) >> 2) | ((m & ne) >> 3)) & 76861433640456465) AS mm FROM o, p
), two AS (SELECT obs, min(mm * 10000000 + ordinal, 2) AS near FROM d GROUP BY obs
), found AS (SELECT obs, (near[1] % 10000000)::INT AS best_ordinal, (near[1] // 10000000)::INT AS best_mismatches, coalesce(near[2] // 10000000, 255)::INT AS next_best_mismatches FROM two)
SELECT ord, r.obs, best_ordinal, best_mismatches, next_best_mismatches FROM r LEFT JOIN (FROM found WHERE best_mismatches <= 1 AND next_best_mismatches - best_mismatches >= 2) USING (obs)"""))
def barcode_match_sheet(spark, sf_dir):
    """A sheet of a sample for each order, searched by seeds.  It is numbered by ranges, not by
    the one task that the SQL's window is."""
    sheet = samples.numbered(view(spark, sf_dir, _LARGE_SAMPLES), "o_orderkey")
    return matcher.match_barcodes(view(spark, sf_dir, _LARGE_READS), sheet, 15)


@query(match_sql(12, 1, 2) + "SELECT ord, obs FROM matched WHERE best_ordinal IS NULL")
def unmatched_reads(spark, sf_dir):
    return matcher.unmatched_reads(matched(spark, sf_dir)[0]).select("ord", "obs")


@query(match_sql(12, 1, 2) + "SELECT coalesce(sample_id, 'unmatched') AS sample_id, count(*) AS n, sum(best_mismatches)::BIGINT AS mismatches FROM matched LEFT JOIN samples ON ordinal = best_ordinal GROUP BY 1")
def sample_assignments(spark, sf_dir):
    m, sheet = matched(spark, sf_dir)
    return matcher.with_sample(m, sheet).groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("best_mismatches").alias("mismatches"))


@query(match_sql(12, 1, 2) + "SELECT a.n_nationkey AS a, b.ordinal AS b, (SELECT count(*) FROM places WHERE " + mask_sql(f"substr({bases_sql('a.n_nationkey')}, p, 1)") + " & xor(" + mask_sql("substr(b.barcode, p, 1)") + ", 15) <> 0) AS mismatches FROM nation AS a, samples AS b")
def hamming_pairs(spark, sf_dir):
    sheet = view(spark, sf_dir, samples_sql(12))
    own = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("a"), F.substring(F.expr(bases_sql("n_nationkey")), 1, 12).alias("x"))
    both = own.crossJoin(sheet)  # 25 rows each: the pairs are what is asked for
    return both.select("a", F.col("ordinal").alias("b"), bases.hamming("x", "barcode", 12).cast("bigint").alias("mismatches"))


_SHORT = "(SELECT ord, CASE WHEN ord % 3 = 0 THEN substr(obs, 1, 11) ELSE obs END AS obs FROM " + reads_sql(12) + " AS r)"


@query(match_sql(12, 1, 2) + "SELECT CASE WHEN ord % 3 = 0 THEN 'short' ELSE 'whole' END AS kind, count(*) AS n, count(CASE WHEN ord % 3 = 0 THEN NULL ELSE best_ordinal END) AS n_matched FROM matched GROUP BY 1")
def short_barcode_unmatched(spark, sf_dir):
    sheet = view(spark, sf_dir, samples_sql(12))
    m = matcher.match_barcodes(view(spark, sf_dir, _SHORT), sheet, 12)
    kind = F.when(F.length("obs") < 12, "short").otherwise("whole").alias("kind")
    return m.groupBy(kind).agg(F.count("*").alias("n"), F.count("best_ordinal").alias("n_matched"))


# ----------------------------------------------------------------------- bases
@query("WITH reads AS " + duck(reads_sql(12)) + f" SELECT ord, [CAST({mask_sql('c')} AS INT) FOR c IN string_split(obs, '')] AS masks FROM reads")
def encode_masks(spark, sf_dir):
    return view(spark, sf_dir, reads_sql(12)).select("ord", bases.masks("obs").alias("masks"))


_ODD = "(SELECT ord, CASE WHEN ord % 4 = 0 THEN lower(obs) WHEN ord % 4 = 1 THEN replace(obs, 'T', 'U') WHEN ord % 4 = 2 THEN replace(obs, 'A', '.') ELSE obs || 'x' END AS obs FROM " + reads_sql(12) + " AS r)"


_DECODABLE = "(SELECT ord, CASE WHEN ord % 3 = 0 THEN lower(obs) WHEN ord % 3 = 1 THEN replace(obs, 'T', 'U') ELSE replace(obs, 'A', '.') END AS obs FROM " + reads_sql(12) + " AS r)"


@query("WITH reads AS " + duck(_DECODABLE) + " SELECT ord, upper(replace(replace(upper(obs), 'U', 'T'), '.', 'N')) AS bases FROM reads")
def decode_bases(spark, sf_dir):
    return view(spark, sf_dir, _DECODABLE).select("ord", bases.decode_masks(bases.masks("obs")).alias("bases"))


@query("WITH reads AS " + duck(_ODD) + " SELECT ord, len(list_filter(string_split(obs, ''), lambda c: c IN ('N', 'n', '.'))) AS n FROM reads")
def nocall_count(spark, sf_dir):
    return view(spark, sf_dir, _ODD).select("ord", bases.n_nocalls("obs").cast("bigint").alias("n"))


@query("WITH reads AS " + duck(_ODD) + " SELECT ord, len(list_filter(string_split(obs, ''), lambda c: instr('ACGTUMRWSYKVHDBNn.', c) = 0)) = 0 AS valid FROM reads")
def iupac_valid(spark, sf_dir):
    return view(spark, sf_dir, _ODD).select("ord", bases.is_valid_iupac("obs").alias("valid"))


@query("WITH reads AS " + duck(_ODD) + ", samples AS " + duck(samples_sql(12)) + " SELECT ord FROM reads WHERE len(obs) >= 12 AND len(regexp_extract_all(obs, '[Nn.]')) <= 1 + (SELECT max(len(regexp_extract_all(barcode, '[Nn.]'))) FROM samples)")
def nocall_prefilter(spark, sf_dir):
    sheet = matcher.sheet_row(view(spark, sf_dir, samples_sql(12)), 12)
    met = view(spark, sf_dir, _ODD).crossJoin(F.broadcast(sheet))  # one row: the sheet
    return met.where(matcher.tried(F.col("obs"), 12, 1, F.col("__max_ns"))).select("ord")


@query("WITH reads AS " + duck(_ODD) + " SELECT ord, [c IN ('N', 'n', '.') FOR c IN string_split(obs, '')] AS nocalls FROM reads")
def nocall_flags(spark, sf_dir):
    each = F.transform(F.split("obs", ""), bases.is_nocall)
    return view(spark, sf_dir, _ODD).select("ord", each.alias("nocalls"))


# -------------------------------------------------------------------- segments
def _cut(spark, sf_dir, structure: str, skip: bool = True, records: str = RECORDS_1) -> DataFrame:
    return segments.segmented(view(spark, sf_dir, records), ReadStructure.parse(structure), skip)


@query("WITH r AS " + duck(RECORDS_1) + " SELECT ord, substr(seq, 1, 8) AS b, substr(seq, 9, 12) AS m, substr(seq, 21, 20) AS t, substr(qual, 21, 20) AS q FROM r WHERE len(seq) >= 40")
def segments_fixed(spark, sf_dir):
    s = _cut(spark, sf_dir, "8B12M20T").where("skip_reason is null")
    return s.select("ord", *(F.col("segments")[k]["seq"].alias(n) for k, n in enumerate("bmt")), F.col("segments")[2]["qual"].alias("q"))


@query("WITH r AS " + duck(RECORDS_1) + " SELECT ord, substr(seq, 1, 8) AS b, substr(seq, 9) AS t FROM r WHERE len(seq) >= 9")
def segments_plus(spark, sf_dir):
    s = _cut(spark, sf_dir, "8B+T").where("skip_reason is null")
    return s.select("ord", *(F.col("segments")[k]["seq"].alias(n) for k, n in enumerate("bt")))


@query("WITH r AS " + duck(RECORDS_1) + " SELECT ord, unnest(['B', 'C', 'M', 'T']) AS kind, unnest([substr(seq, 1, 4) || '+' || substr(seq, 17, 4), substr(seq, 21, 6), substr(seq, 5, 8), substr(seq, 27)]) AS seqs FROM r WHERE len(seq) >= 27")
def segments_by_type(spark, sf_dir):
    s = _cut(spark, sf_dir, "4B8M4S4B6C+T").where("skip_reason is null")
    rows = [s.select("ord", F.lit(k).alias("kind"), F.array_join(segments.sequences(F.col("segments"), k), "+").alias("seqs")) for k in "BCMT"]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query("WITH r AS " + duck(RECORDS_1) + " SELECT ord, substr(seq, 1, 4) || substr(seq, 13, 8) AS obs FROM r WHERE len(seq) >= 21")
def sample_barcode_concat(spark, sf_dir):
    s = _cut(spark, sf_dir, "4B8M8B+T").where("skip_reason is null")
    return s.select("ord", segments.sample_barcode(F.col("segments")).alias("obs"))


@query("WITH r AS " + duck(RECORDS_1) + " SELECT 'too-few-bases' AS skip_reason, count(*) AS n FROM r WHERE len(seq) < 13")
def too_few_bases_skips(spark, sf_dir):
    return metrics.skip_counts(_cut(spark, sf_dir, "4B8M+T"))


# ------------------------------------------------------------------ positional
def _zipped(spark, sf_dir, check: bool = False, records_2: str = RECORDS_2) -> DataFrame:
    first = _cut(spark, sf_dir, "12B+T")
    second = segments.segmented(view(spark, sf_dir, records_2), ReadStructure.parse("8M+T"), True, {"B": 1, "T": 1})
    return zipping.zip_segments([first, second], check)


_PAIR = "WITH a AS " + duck(RECORDS_1) + ", b AS " + duck(RECORDS_2) + " "


@query(_PAIR + "SELECT a.ord, a.header, substr(a.seq, 1, 12) AS barcode, substr(b.seq, 1, 8) AS umi, substr(a.seq, 13) || '|' || substr(b.seq, 9) AS templates FROM a JOIN b USING (ord) WHERE len(a.seq) >= 13")
def positional_zip(spark, sf_dir):
    z = _zipped(spark, sf_dir).where("skip_reason is null and in_sync")
    seqs = lambda k: segments.sequences(F.col("segments"), k)
    return z.select("ord", "header", F.array_join(seqs("B"), "").alias("barcode"), F.array_join(seqs("M"), "").alias("umi"), F.array_join(seqs("T"), "|").alias("templates"))


@query(_PAIR + "SELECT a.ord FROM a LEFT JOIN b USING (ord) WHERE b.ord IS NULL AND len(a.seq) >= 13")
def zip_out_of_sync_rows(spark, sf_dir):
    return _zipped(spark, sf_dir).where("skip_reason is null and not in_sync").select("ord")


_BOTH = RECORDS_2.replace(" WHERE o_orderkey % 97 <> 96", "")
_SETS_SQL = "WITH a AS " + duck(RECORDS_1) + ", b AS " + duck(_BOTH) + ", s AS " + duck(samples_sql(12)) + """
, hit AS (SELECT a.ord, a.seq AS x, b.seq AS y, coalesce(min(sample_id), 'unmatched') AS sample_id
  FROM a JOIN b USING (ord) LEFT JOIN s ON substr(a.seq, 1, 12) = substr(translate(md5(CAST(ordinal AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 12) WHERE len(a.seq) >= 13 GROUP BY ALL)
, files AS (
  SELECT sample_id, 'B' AS kind, 1 AS kind_idx, ord, substr(x, 1, 12) AS seq, repeat(';', 12) AS qual, x, y FROM hit
  UNION ALL SELECT sample_id, 'M', 1, ord, substr(y, 1, 8), repeat(':', 8), x, y FROM hit
  UNION ALL SELECT sample_id, 'T', 1, ord, substr(x, 13), repeat(';', 52), x, y FROM hit
  UNION ALL SELECT sample_id, 'T', 2, ord, substr(y, 9), repeat(':', 24), x, y FROM hit)
"""


def _routed(spark, sf_dir) -> DataFrame:
    """Sheet barcodes without ambiguity codes and strict limits, so that equality
    says the same."""
    sets = read_sets([view(spark, sf_dir, RECORDS_1), view(spark, sf_dir, _BOTH)], [ReadStructure.parse("12B+T"), ReadStructure.parse("8M+T")], skip=True)
    plain = f"(SELECT CAST(n_nationkey AS INT) AS ordinal, n_name AS sample_id, substr({bases_sql('n_nationkey')}, 1, 12) AS barcode FROM {{nation}})"
    sheet = view(spark, sf_dir, plain)
    kept = sets.where("skip_reason is null").withColumn("obs", segments.sample_barcode(F.col("segments")))
    found = matcher.with_sample(matcher.match_barcodes(kept, sheet, 12, "obs", 0, 1), sheet)
    return routed(found, set("TBM"))


@query(_SETS_SQL + "SELECT sample_id, kind, kind_idx, ord, '@run:1:' || ord || ':' || substr(y, 1, 8) || ' ' || kind_idx || ':N:0:' || substr(x, 1, 12) || chr(10) || seq || chr(10) || '+' || chr(10) || qual || chr(10) AS record FROM files")
def routed_records(spark, sf_dir):
    return _routed(spark, sf_dir)


_STRUCTURES = ("12B+T", "8M+T")
_FILE = "sample_id || '.' || translate(kind, 'TBM', 'RIU') || kind_idx || '.fq.gz'"


@query(_SETS_SQL + f""", planned AS (
  SELECT {_FILE} AS file FROM (SELECT n_name AS sample_id FROM nation UNION ALL SELECT 'unmatched'), (VALUES ('T', 1), ('T', 2), ('B', 1), ('M', 1)) AS k(kind, kind_idx)
), got AS (SELECT {_FILE} AS file, count(*) AS n FROM files GROUP BY ALL)
SELECT file, coalesce(n, 0) AS n FROM planned LEFT JOIN got USING (file)""")
def output_file_counts(spark, sf_dir):
    """All files that a run plans, with their records; some have none."""
    names = [r["n_name"] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()]  # a sheet
    planned = target_files([ReadStructure.parse(x) for x in _STRUCTURES], set("TBM"), [*names, "unmatched"])
    file = F.concat("sample_id", F.lit("."), F.translate("kind", "TBM", "RIU"), F.col("kind_idx").cast("string"), F.lit(".fq.gz"))
    got = _routed(spark, sf_dir).groupBy(file.alias("file")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([(x,) for x in planned], "file string").join(got, "file", "left").select("file", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


# ---------------------------------------------------------- runs, file to file
def _folder(spark: SparkSession, name: str) -> str:
    """A folder for a run's files, which are read lazily: it goes when the driver exits."""
    folder = passing_path(spark, name)
    fs, root = open_store(folder)
    fs.create_dir(root, recursive=True)
    return folder


def _put_reads(spark, sf_dir, folder: str, **views: str) -> list[str]:
    """Views as block-gzip FASTQ files.  The orders are dealt to ranges and sorted, not the
    reads that are made of them, which are wider; a range becomes a part of each file."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    ranges = max(2 * spark.sparkContext.defaultParallelism, -(-orders.count() // CHUNK_RECORDS))
    placed = orders.repartitionByRange(ranges, "o_orderkey").sortWithinPartitions("o_orderkey")
    rows = None
    for name, sql in views.items():
        text = record_text(F.concat(F.lit("@"), F.col("header")), F.col("seq"), F.col("qual"))
        one = spark.sql(f"SELECT * FROM {sql} AS v", orders=placed).select(F.lit(f"{name}.fq.gz").alias("target"), "ord", text.alias("record"))
        rows = one if rows is None else rows.unionByName(one)
    write_fastq(rows, folder, [f"{name}.fq.gz" for name in views], in_order=True, is_sorted=True)
    return [f"{folder}/{name}.fq.gz" for name in views]


#: So small that the files of any table size are cut to many ranges.
_SMALL_SPLITS = 1 << 15


def _demux(spark, sf_dir, name: str, **options) -> tuple[Demux, list[str]]:
    """A whole run over two files: the run, and the files that it writes."""
    folder = _folder(spark, name)
    inputs = _put_reads(spark, sf_dir, folder, one=RECORDS_1, two=_BOTH)
    sheet = view(spark, sf_dir, f"(SELECT n_nationkey, n_name, substr({bases_sql('n_nationkey')}, 1, 12) AS barcode FROM {{nation}})").orderBy("n_nationkey").collect()
    fs, root = open_store(folder)
    with fs.open_output_stream(f"{root}/sheet.tsv") as f:
        f.write("".join(["sample_id\tbarcode\n", *(f"{r['n_name']}\t{r['barcode']}\n" for r in sheet)]).encode())
    run = Demux(
        inputs, list(_STRUCTURES), f"{folder}/sheet.tsv", f"{folder}/out", output_types="TBM", max_mismatches=0, min_mismatch_delta=1, skip_reasons=["too-few-bases"], **options
    )
    run.execute(spark)
    names = target_files([ReadStructure.parse(x) for x in _STRUCTURES], set("TBM"), [*(r["n_name"] for r in sheet), "unmatched"])
    return run, names


_FILES_SQL = _SETS_SQL + f""", heads AS (SELECT {_FILE} AS file, ord AS place, 'run:1:' || ord || ':' || substr(y, 1, 8) || ' ' || kind_idx || ':N:0:' || substr(x, 1, 12) AS header, seq, qual FROM files)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY place) - 1 AS ord, header, seq, qual FROM heads"""


@query(_FILES_SQL)
def demux_files(spark, sf_dir):
    """What stands in the files of a run, in their order."""
    return _demultiplexed(spark, *_demux(spark, sf_dir, "demux-files"))


@query(_FILES_SQL)
def demux_split_files(spark, sf_dir):
    """The same of inputs that are read side by side in many ranges."""
    return _demultiplexed(spark, *_demux(spark, sf_dir, "demux-splits", split_bytes=_SMALL_SPLITS))


def _demultiplexed(spark, run: Demux, names: list[str]) -> DataFrame:
    known = spark.createDataFrame(list(enumerate(names)), "file_idx int, file string")
    return read_fastq(spark, [f"{run.output}/{n}" for n in names]).join(known, "file_idx").select("file", "ord", "header", "seq", "qual")


@query(_SETS_SQL + """, counts AS (
  SELECT n_nationkey AS ordinal, n_name AS sample_id, substr(translate(md5(CAST(n_nationkey AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 12) AS barcode,
         (SELECT count(*) FROM hit WHERE hit.sample_id = n_name) AS templates FROM nation
), totals AS (SELECT (SELECT count(*) FROM hit) AS every, sum(templates) AS own, max(templates) AS best, count(*) AS n FROM counts
), rows AS (SELECT sample_id, barcode, templates FROM counts UNION ALL SELECT 'unmatched', '.', every - own FROM totals)
SELECT sample_id, barcode, CAST(templates AS BIGINT) AS templates, CAST(templates AS DOUBLE) / every AS frac_templates,
       CAST(templates AS DOUBLE) / (CAST(own AS DOUBLE) / n) AS ratio_to_mean, CAST(templates AS DOUBLE) / best AS ratio_to_best
FROM rows, totals""")
def demux_metrics_file(spark, sf_dir):
    """The metrics file of a run, read again."""
    return metrics.read_metrics(spark, f"{_demux(spark, sf_dir, 'demux-metrics')[0].output}/{METRICS_FILE}")


@query("WITH a AS " + duck(RECORDS_1) + ", b AS " + duck(_BOTH) + " SELECT 'too-few-bases' AS skip_reason, count(*) AS n FROM a JOIN b USING (ord) WHERE len(a.seq) < 13")
def demux_skip_report(spark, sf_dir):
    return spark.createDataFrame(list(_demux(spark, sf_dir, "demux-skips")[0].skipped.items()), "skip_reason string, n bigint")


_KEPT_FILES_SQL = "WITH a AS " + duck(RECORDS_1) + ", b AS " + duck(_BOTH) + """, kept AS (
  SELECT 0 AS file_idx, * FROM a UNION ALL SELECT 1, * FROM b
) SELECT file_idx, row_number() OVER (PARTITION BY file_idx ORDER BY ord) - 1 AS ord, header, seq, qual FROM kept WHERE ('0x' || substr(md5('42:' || ord), 1, 8))::BIGINT / 4294967296.0 < 0.3"""


@query(_KEPT_FILES_SQL)
def subsample_files(spark, sf_dir):
    """What stands in the files that a run of subsampling writes."""
    return _subsampled(spark, sf_dir, "subsample-files")


@query(_KEPT_FILES_SQL)
def subsample_split_files(spark, sf_dir):
    """The same of inputs that are read side by side in many ranges."""
    return _subsampled(spark, sf_dir, "subsample-splits", split_bytes=_SMALL_SPLITS)


def _subsample(spark, sf_dir, folder: str, **options) -> tuple[int, int, float]:
    inputs = _put_reads(spark, sf_dir, folder, one=RECORDS_1, two=_BOTH)
    return Subsample(inputs, f"{folder}/kept", 0.3, seed=42, **options).execute(spark)


def _subsampled(spark, sf_dir, name: str, **options) -> DataFrame:
    folder = _folder(spark, name)
    _subsample(spark, sf_dir, folder, **options)
    return read_fastq(spark, [f"{folder}/kept.R{k}.fq.gz" for k in (1, 2)]).select("file_idx", "ord", "header", "seq", "qual")


_TOTALS_SQL = "WITH r AS " + duck(RECORDS_1) + """ SELECT count(*) AS total, count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE keep) * 100.0::DOUBLE / count(*) AS percent
FROM (SELECT ('0x' || substr(md5('42:' || ord), 1, 8))::BIGINT / 4294967296.0 < 0.3 AS keep FROM r)"""


@query(_TOTALS_SQL)
def subsample_run_totals(spark, sf_dir):
    """What a run says it has read and kept, observed while it writes."""
    said = _subsample(spark, sf_dir, _folder(spark, "subsample-totals"), split_bytes=_SMALL_SPLITS)
    return spark.createDataFrame([said], "total bigint, kept bigint, percent double")


_RUN = {"compression_level": 5, "fraction": 0.3, "inputs": ["orders.fq"], "threads": 8}
_SEED = f"(('0x' || substr(sha256('{json.dumps(_RUN)}'), 1, 16))::UBIGINT >> 1)::BIGINT"


@query("WITH r AS " + duck(RECORDS_1) + f" SELECT ord, header, {_SEED} AS seed FROM r WHERE ('0x' || substr(md5({_SEED} || ':' || ord), 1, 8))::BIGINT / 4294967296.0 < 0.3")
def subsample_derived_seed(spark, sf_dir):
    """Records that a run without a seed keeps: its seed comes from its parameters."""
    seed = sampling.effective_seed(None, **_RUN)
    return sampling.sample(view(spark, sf_dir, RECORDS_1), 0.3, seed).select("ord", "header", F.lit(seed).cast("bigint").alias("seed"))


# --------------------------------------------------------------------- headers
def _headers(spark, sf_dir, header: str, number: int, umis: int) -> DataFrame:
    df = view(spark, sf_dir, f"(SELECT o_orderkey AS ord, {header} AS header, {bases_sql('o_custkey')} AS b FROM {{orders}})")
    bars = [F.substring("b", 1, 4), F.substring("b", 5, 4)]
    extra = [F.substring("b", 9 + 8 * k, 8) for k in range(umis)]
    return df.select("ord", headers.rewrite(F.col("header"), number, bars, extra).alias("line"))


def _header_sql(line: str) -> str:
    return f"WITH r AS (SELECT o_orderkey AS ord, {bases_sql('o_custkey')} AS b FROM orders) SELECT ord, {line} AS line FROM r"


_BARS = "substr(b, 1, 4) || '+' || substr(b, 5, 4)"


@query(_header_sql(f"'@q' || ord || ' 1:N:0:' || {_BARS}"))
def header_no_comment(spark, sf_dir):
    return _headers(spark, sf_dir, "'q' || CAST(o_orderkey AS STRING)", 1, 0)


@query(_header_sql(f"'@inst:123:ABCDE:1:204:' || ord || ':2108 2:Y:0:' || {_BARS}"))
def header_illumina(spark, sf_dir):
    return _headers(spark, sf_dir, "'inst:123:ABCDE:1:204:' || CAST(o_orderkey AS STRING) || ':2108 1:Y:0:0'", 2, 0)


@query(_header_sql(f"'@inst:123:ABCDE:1:204:' || ord || ':2108:' || substr(b, 9, 8) || '+' || substr(b, 17, 8) || ' 1:N:0:TT' || CAST(ord AS STRING)[:-2] || '+' || {_BARS}").replace("CAST(ord AS STRING)[:-2]", "substr(CAST(ord AS STRING), 1, len(CAST(ord AS STRING)) - 1)"))
def header_with_umi(spark, sf_dir):
    """The comment's last field ends in a digit, one of which gives way."""
    return _headers(spark, sf_dir, "'inst:123:ABCDE:1:204:' || CAST(o_orderkey AS STRING) || ':2108 1:N:0:TT' || CAST(o_orderkey AS STRING)", 1, 2)


@query(_header_sql(f"'@inst:123:ABCDE:1:204:1022:' || ord || ':AAAA+' || substr(b, 9, 8) || ' 2:Y:0:TTTT+' || {_BARS}"))
def header_existing_umi(spark, sf_dir):
    return _headers(spark, sf_dir, "'inst:123:ABCDE:1:204:1022:' || CAST(o_orderkey AS STRING) || ':AAAA 1:Y:0:TTTT'", 2, 1)


@query(_header_sql(f"'@q' || ord || ':' || substr(b, 9, 8) || ' 0:0:' || {_BARS}"))
def header_short_comment(spark, sf_dir):
    return _headers(spark, sf_dir, "'q' || CAST(o_orderkey AS STRING) || ' 0:0'", 1, 1)


@query("WITH r AS " + duck(EVENT_NAMES) + " SELECT ord, regexp_replace(string_split(string_split(header, ' ')[1], chr(9))[1], '/(1|2)$', '') AS name FROM r")
def base_read_name(spark, sf_dir):
    return view(spark, sf_dir, EVENT_NAMES).select("ord", headers.base_read_name(F.col("header")).alias("name"))


@query("SELECT o_orderkey AS ord, format('{:,}', o_orderkey * o_custkey * 7919) AS said FROM orders")
def thousands(spark, sf_dir):
    big = view(spark, sf_dir, "(SELECT o_orderkey AS ord, o_orderkey * o_custkey * 7919 AS n FROM {orders})")
    return big.select("ord", headers.thousands(F.col("n")).alias("said"))


# -------------------------------------------------------------------- sampling
_KEEP = "('0x' || substr(md5('42:' || ord), 1, 8))::BIGINT / 4294967296.0 < 0.3"


@query("WITH r AS " + duck(RECORDS_1) + f" SELECT ord, header FROM r WHERE {_KEEP}")
def subsample_single(spark, sf_dir):
    return sampling.sample(view(spark, sf_dir, RECORDS_1), 0.3, 42).select("ord", "header")


@query("WITH a AS " + duck(RECORDS_1) + ", b AS " + duck(_BOTH) + f" SELECT 0 AS file_idx, ord, header FROM a WHERE {_KEEP} UNION ALL SELECT 1, ord, header FROM b WHERE {_KEEP}")
def subsample_paired(spark, sf_dir):
    """Each file is filtered on its own; the decisions agree."""
    each = [sampling.sample(view(spark, sf_dir, r), 0.3, 42).select(F.lit(k).alias("file_idx"), "ord", "header") for k, r in enumerate((RECORDS_1, _BOTH))]
    return each[0].union(each[1])


@query("WITH r AS " + duck(RECORDS_1) + f" SELECT count(*) AS total, count(*) FILTER (WHERE {_KEEP}) AS kept, count(*) FILTER (WHERE {_KEEP}) * 100.0::DOUBLE / count(*) AS percent FROM r")
def subsample_totals(spark, sf_dir):
    return sampling.totals(view(spark, sf_dir, RECORDS_1), 0.3, 42)


_NAMES_2 = "(SELECT ord, CASE WHEN ord % 13 = 5 THEN 'other' || header ELSE header END AS header FROM " + EVENT_NAMES + " AS e)"


@query("WITH a AS " + duck(EVENT_NAMES) + ", n AS (SELECT ord, regexp_replace(regexp_extract(header, '^[^ ' || chr(9) || ']*'), '/[12]$', '') AS name FROM a) SELECT ord, 1 AS file_idx, 'other' || name AS name, name AS first_name FROM n WHERE ord % 13 = 5")
def name_mismatch_rows(spark, sf_dir):
    return sampling.name_mismatches([view(spark, sf_dir, EVENT_NAMES), view(spark, sf_dir, _NAMES_2)])


@query("WITH a AS " + duck(RECORDS_1) + ", b AS " + duck(RECORDS_2) + " SELECT ord, 'FASTQ files are out of sync: 1 of 2 files had a record at read ' || (ord + 1) AS said FROM a LEFT JOIN b USING (ord) WHERE b.ord IS NULL")
def sync_error_rows(spark, sf_dir):
    return sampling.sync_errors([view(spark, sf_dir, RECORDS_1), view(spark, sf_dir, RECORDS_2)])


# ---------------------------------------------------------------------- samples
@query("SELECT n_name AS sample_id, row_number() OVER (ORDER BY n_nationkey) - 1 AS ordinal, format('Sample({:04d}) - {{ name: {}', n_nationkey, n_name) || chr(9) || 'barcode: ' || substr(" + bases_sql("n_nationkey") + ", 1, 12) || ' }' AS shown FROM nation")
def sample_sheet_ordinals(spark, sf_dir):
    plain = f"(SELECT n_nationkey, n_name, substr({bases_sql('n_nationkey')}, 1, 12) AS barcode FROM {{nation}})"
    rows = view(spark, sf_dir, plain).orderBy("n_nationkey").collect()  # a sheet is read on the driver
    group = SampleGroup.from_samples(Sample(r["n_name"], r["barcode"]) for r in rows)
    return spark.createDataFrame([(s.sample_id, s.ordinal, str(s)) for s in group.samples], "sample_id string, ordinal bigint, shown string")


@query("SELECT k AS length, CASE WHEN count(DISTINCT substr(" + bases_sql("n_nationkey") + ", 1, k)) < count(*) THEN 'Each sample barcode must be unique, duplicate identified' ELSE count(*) || ' samples' END AS said FROM nation, (SELECT unnest(range(1, 9)) AS k) GROUP BY k")
def sample_duplicates(spark, sf_dir):
    """Sheets of ever longer barcodes, the shorter of which aren't unique."""
    rows = view(spark, sf_dir, f"(SELECT n_nationkey, n_name, {bases_sql('n_nationkey')} AS barcode FROM {{nation}})").orderBy("n_nationkey").collect()  # a sheet
    out = []
    for k in range(1, 9):
        try:
            said = f"{len(SampleGroup.from_samples(Sample(r['n_name'], r['barcode'][:k]) for r in rows).samples)} samples"
        except ValueError as e:
            said = str(e)
        out.append((k, said))
    return spark.createDataFrame(out, "length bigint, said string")


#: A sheet of a sample for each order, with mistakes of every kind.
_POOR_SHEET = f"""(SELECT CAST(o_orderkey AS INT) AS ordinal, CASE WHEN o_orderkey % 31 = 0 THEN '' WHEN o_orderkey % 29 = 0 THEN 's1' ELSE 's' || CAST(o_orderkey AS STRING) END AS sample_id,
      CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 'ACxT' || raw WHEN o_orderkey % 19 = 0 THEN raw || 'A' WHEN o_orderkey % 17 = 0 THEN lower(raw)
           WHEN o_orderkey % 13 = 0 THEN 'NRYK' || substr(raw, 5) ELSE raw END AS barcode
      FROM (SELECT o_orderkey, substr({bases_sql('o_custkey % 4000 + o_orderkey')}, 1, 11) AS raw FROM {{orders}}) AS o)"""


@query("WITH s AS MATERIALIZED (SELECT ordinal, coalesce(sample_id, '') AS n, coalesce(barcode, '') AS b FROM " + duck(_POOR_SHEET) + """ AS v
), named AS (SELECT n, min(ordinal) AS o FROM s GROUP BY n), coded AS (SELECT b, min(ordinal) AS o FROM s GROUP BY b), f AS (SELECT len(b) AS size FROM s ORDER BY ordinal LIMIT 1)
, told AS (SELECT ordinal, CASE WHEN n = '' THEN 'Sample name cannot be empty' WHEN b = '' THEN 'Sample barcode cannot be empty'
  WHEN len(list_filter(string_split(b, ''), lambda c: instr('ACGTUMRWSYKVHDBNn.', c) = 0)) > 0 THEN 'All sample barcode bases must be one of A, C, G, T, U, R, Y, S, W, K, M, D, V, H, B, N'
  WHEN ordinal > named.o THEN 'Each sample name must be unique, duplicate identified' WHEN ordinal > coded.o THEN 'Each sample barcode must be unique, duplicate identified'
  WHEN len(b) <> size THEN 'All barcodes must have the same length' END AS said FROM s JOIN named USING (n) JOIN coded USING (b), f)
SELECT ordinal, said FROM told WHERE said IS NOT NULL""")
def sheet_mistakes(spark, sf_dir):
    """Every row of a large sheet that breaks a rule, and the rule."""
    return samples.mistakes(view(spark, sf_dir, _POOR_SHEET))


#: Reads of which some are short and some have qualities that are.
_POOR_READS = f"(SELECT ord, header, seq, CASE WHEN ord % 53 = 0 THEN substr(qual, 1, 5) WHEN ord % 59 = 0 THEN NULL ELSE qual END AS qual FROM {RECORDS_1} AS r)"


@query("WITH r AS " + duck(_POOR_READS) + """, told AS (SELECT ord, CASE WHEN len(seq) < 21 THEN 'Read ' || string_split(header, ' ')[1] || ' had too few bases to demux ' || len(seq) || ' vs. 21 needed in read structure 8B12M+T.'
  WHEN coalesce(len(qual), 0) <> len(seq) THEN 'Read ' || string_split(header, ' ')[1] || ' has ' || len(seq) || ' bases and ' || coalesce(len(qual), 0) || ' qualities.' END AS said FROM r)
SELECT ord, said FROM told WHERE said IS NOT NULL""")
def extraction_mistakes(spark, sf_dir):
    """Every read that would fail a run, and what the run would say."""
    return segments.mistakes(view(spark, sf_dir, _POOR_READS), ReadStructure.parse("8B12M+T"))


_LONG = "(SELECT ord, CASE WHEN ord % 7 = 0 THEN obs || 'AC' WHEN ord % 7 = 1 THEN 'NNN' || obs WHEN ord % 7 = 2 THEN substr(obs, 1, 9) ELSE obs END AS obs FROM " + reads_sql(12) + " AS r)"


@query("WITH reads AS " + duck(_LONG) + ", samples AS " + duck(samples_sql(12)) + """, most AS (SELECT 1 + max(len(regexp_extract_all(barcode, '[Nn.]'))) AS n FROM samples)
SELECT DISTINCT obs, 'Read barcode (' || obs || ') length (' || len(obs) || ') differs from expected barcode length (12)' AS said FROM reads, most
WHERE len(obs) > 12 AND len(regexp_extract_all(obs, '[Nn.]')) <= n""")
def barcode_mistakes(spark, sf_dir):
    """Every barcode that is longer than the sheet's and not passed over before."""
    distinct = written(view(spark, sf_dir, _LONG).select("obs").distinct(), passing_path(spark, "barcodes"))
    return matcher.mistakes(distinct, view(spark, sf_dir, samples_sql(12)), 12)


# ---------------------------------------------------------------- packed arrays
@query("WITH r AS " + duck(reads_sql(12)) + f", e AS (SELECT ord, [CAST({mask_sql('c')} AS INT) FOR c IN string_split(obs, '')] AS a FROM r)" + """
SELECT ord, list_concat(a, [3]) AS pushed, list_concat(a, [5, 5, 5]) AS many, list_concat(list_concat(a[1:2], [7]), a[4:]) AS was_set, a[1] AS got, CAST(NULL AS INT) AS beyond,
       CAST(len(a) AS INT) AS n, CAST(ceil(len(a) / 8) AS INT) AS n_blocks, len(a) = 0 AS is_empty,
       a[1] + a[2] * 16 + a[3] * 256 + a[4] * 4096 + a[5] * 65536::BIGINT + a[6] * 1048576::BIGINT + a[7] * 16777216::BIGINT + a[8] * 268435456::BIGINT AS first_block, a[10] AS by_address
FROM e""")
def bitenc_ops(spark, sf_dir):
    a = F.col("a")
    enc = view(spark, sf_dir, reads_sql(12)).select("ord", blocks.pack_bases("obs").alias("a"))
    shown = lambda x: blocks.symbols(x, 4)
    return enc.select(
        "ord", shown(blocks.push(a, 3, 4)).alias("pushed"), shown(blocks.push_values(a, 3, 5, 4)).alias("many"), shown(blocks.set_at(a, 2, 7, 4)).alias("was_set"),
        blocks.get(a, 0, 4).alias("got"), blocks.get(a, 99, 4).alias("beyond"), blocks.nr_symbols(a).alias("n"), blocks.nr_blocks(a).alias("n_blocks"),
        blocks.is_empty(a).alias("is_empty"), a["blocks"][0].alias("first_block"), blocks.get_by_address(a["blocks"], blocks.address(9, 4), 4).alias("by_address"),
    )


#: Packed arrays of nine four-bit symbols, as their two blocks and their length.
_BLOCKS_SQL = "WITH r AS " + duck(reads_sql(9)) + f", s AS (SELECT ord, obs, [CAST({mask_sql('c')} AS BIGINT) FOR c IN string_split(obs, '')] AS a FROM r)" + """
, p AS (SELECT ord, obs, {'blocks': [list_sum([a[k] << (4 * (k - 1)) FOR k IN range(1, 9)])::BIGINT, a[9]], 'n': 9::INT} AS a FROM s)"""


@query(_BLOCKS_SQL + " SELECT a.blocks AS blocks, a.n AS n, count(*) AS n_reads, count(DISTINCT obs) AS n_barcodes FROM p GROUP BY ALL")
def bitenc_groups(spark, sf_dir):
    """Reads grouped by their packed barcode: equal and hashed as blocks."""
    enc = view(spark, sf_dir, reads_sql(9)).select("obs", blocks.pack_bases("obs").alias("a"))
    found = enc.groupBy("a").agg(F.count("*").alias("n_reads"), F.countDistinct("obs").alias("n_barcodes"))
    return found.select("a.blocks", "a.n", "n_reads", "n_barcodes")


@query(_BLOCKS_SQL + ", o AS (SELECT ord % 100 AS grp, a.blocks AS b FROM p) SELECT grp, min(b) AS least, max(b) AS most, count(DISTINCT b) AS n_distinct FROM o GROUP BY grp")
def bitenc_order(spark, sf_dir):
    """The least and the largest packed barcode of groups of reads, and how many differ."""
    enc = view(spark, sf_dir, reads_sql(9)).select((F.col("ord") % 100).alias("grp"), blocks.pack_bases("obs").alias("a"))
    found = enc.groupBy("grp").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.countDistinct("a").alias("n_distinct"))
    return found.select("grp", F.col("lo.blocks").alias("least"), F.col("hi.blocks").alias("most"), "n_distinct")


@query("WITH r AS " + duck(reads_sql(12)) + " SELECT ord, 0::INT AS n_new, ord % 7 AS n_filled, CAST(ceil((ord % 7) / 4) AS INT) AS n_blocks, true AS cleared FROM r")
def bitenc_new(spark, sf_dir):
    """Arrays from the empty one on, and back to it; seven bits a symbol."""
    filled = blocks.push_values(blocks.new(7), F.col("ord").cast("int") % 7, 99, 7)
    df = view(spark, sf_dir, reads_sql(12)).select("ord", filled.alias("a"))
    emptied = F.when(F.lit(True), blocks.clear(7)).otherwise(F.col("a"))
    return df.select(
        "ord", blocks.nr_symbols(blocks.new(7)).alias("n_new"), blocks.nr_symbols(F.col("a")).cast("bigint").alias("n_filled"),
        blocks.nr_blocks(F.col("a")).alias("n_blocks"), blocks.is_empty(emptied).alias("cleared"),
    )


@query("WITH r AS " + duck(reads_sql(12)) + f" SELECT ord, unnest(range(0, len(obs)))::INT AS pos, unnest([CAST({mask_sql('c')} AS INT) FOR c IN string_split(obs, '')]) AS mask FROM r")
def bitenc_iter(spark, sf_dir):
    return view(spark, sf_dir, reads_sql(12)).select("ord", blocks.iterate(blocks.pack_bases("obs"), 4).alias("pos", "mask"))


@query("WITH r AS " + duck(RECORDS_1) + " SELECT 0 AS file_idx, row_number() OVER (ORDER BY ord) - 1 AS ord, header, seq, qual, '+' AS raw_plus, 0 AS ends FROM r")
def fastq_roundtrip(spark, sf_dir):
    """Reads written as one block-gzip FASTQ file and read back."""
    return read_fastq(spark, _put_reads(spark, sf_dir, _folder(spark, "roundtrip"), all=RECORDS_1))
