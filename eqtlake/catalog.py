"""Registered queries over the driver's tables and their DuckDB oracles.

part, supplier and lineitem stand for SNPs, probes and associations; the mapping
is written once for Spark and once in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dataset import Dataset
from .functions import formatting, regions, stats
from .functions.regions import Region
from .operators import queries as q
from .operators import summary
from .plans.workspace import scratch_path
from .sinks import write_besd
from .sources import besd, store, text

SNPS = Region("1", 100_000, 2_000_000)
PROBES = Region("1", 0, 2_000_000)
SNP_REGIONS = [Region("1", 100_000, 900_000), Region("1", 500_000, 2_000_000), Region("2", 0, 1_000_000)]
PROBE_REGIONS = [Region("1", 0, 2_000_000), Region("1", 1_000_000, 3_000_000), Region("2", 0, 3_000_000)]
SNP_IDS = ["rs42", "rs43", "rs42", "rs-none"]
GENES = ["GENE3", "GENE7", "GENE3"]
PROBE_ROWS = (3, 4, 3)
THRESHOLD = 0.05
TIES = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
TIES += ("l_returnflag", "l_linestatus", "l_shipdate")


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    """The star over the driver's tables."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = F.col("p_size")
    snps = read("part").select(
        F.col("p_partkey").alias("row_idx"),
        (F.col("p_partkey") % 5 + 1).cast("string").alias("chr"),
        F.concat(F.lit("rs"), F.col("p_partkey").cast("string")).alias("snp_id"),
        F.lit(0.0).alias("genetic_dist"),
        (F.col("p_partkey") * 7919 % 3_000_000).alias("bp"),
        F.element_at(F.array(*map(F.lit, "ACGT")), (size % 4 + 1).cast("int")).alias("a1"),
        F.when(size % 10 == 0, F.lit(None)).when(size % 4 < 2, F.lit("G")).otherwise(F.lit("A")).alias("a2"),
        F.lit(None).cast("double").alias("freq"),
    )
    probes = read("supplier").select(
        F.col("s_suppkey").alias("row_idx"),
        (F.col("s_suppkey") % 5 + 1).cast("string").alias("chr"),
        F.col("s_name").alias("probe_id"),
        F.lit(0.0).alias("genetic_dist"),
        (F.col("s_suppkey") * 104729 % 3_000_000).alias("probe_bp"),
        F.when(F.col("s_nationkey") != 24, F.concat(F.lit("GENE"), F.col("s_nationkey").cast("string"))).alias("gene"),
        F.lit("+").alias("orientation"),
    )
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*TIES)) - 1
    assoc = read("lineitem").select(
        F.col("l_suppkey").alias("probe_idx"),
        place.alias("ord"),
        F.col("l_partkey").alias("snp_idx"),
        ((F.col("l_quantity") - 25) / 100).cast("float").alias("beta"),
        F.col("l_tax").cast("float").alias("se"),
    )
    return Dataset.from_frames(snps, probes, assoc)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to nine places, as ``exp`` may differ by an ulp between engines."""
    return df.select(
        *[F.round(c, 9).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes]
    )


# ---- SQL of the mapping ---------------------------------------------------

STAR = """snp AS (SELECT p_partkey AS row_idx, (p_partkey % 5 + 1)::VARCHAR AS chr, 'rs' || p_partkey AS snp_id,
  0.0e0 AS genetic_dist, (p_partkey * 7919) % 3000000 AS bp,
  CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 'T' END AS a1,
  CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 4 < 2 THEN 'G' ELSE 'A' END AS a2,
  NULL::DOUBLE AS freq FROM part),
probe AS (SELECT s_suppkey AS row_idx, (s_suppkey % 5 + 1)::VARCHAR AS chr, s_name AS probe_id, 0.0e0 AS genetic_dist,
  (s_suppkey * 104729) % 3000000 AS probe_bp,
  CASE WHEN s_nationkey <> 24 THEN 'GENE' || s_nationkey END AS gene, '+' AS orientation FROM supplier),
assoc AS (SELECT l_suppkey AS probe_idx, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber,
  l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1)::INT AS ord,
  l_partkey AS snp_idx, ((l_quantity - 25) / 100)::FLOAT AS beta, l_tax::FLOAT AS se FROM lineitem)"""

PVALUE = """pv AS (SELECT *, CASE WHEN se <= 0 OR NOT isfinite(beta) OR NOT isfinite(se) THEN 1.0e0 ELSE
  least(1e0, greatest(0e0, 2e0 * (1e0 - 0.5e0 * (1e0 + (1e0 - ((((1.061405429e0 * t + -1.453152027e0) * t + 1.421413741e0) * t
  + -0.284496736e0) * t + 0.254829592e0) * t * exp(-x * x)))))) END AS pval FROM (
  SELECT *, 1e0 / (1e0 + 0.3275911e0 * x) AS t FROM (
  SELECT *, CASE WHEN se <= 0 THEN 0e0 ELSE abs(beta / se) / sqrt(2e0) END AS x FROM {source})))"""

RAW = "snp_id, snp_chr, snp_bp, a1, a2, probe_id, probe_chr, probe_bp, gene, beta, se, pval"
COLUMNS = """snp_id, snp_chr, snp_bp, a1, a2, probe_id, probe_chr, probe_bp, gene,
  round(beta, 9) AS beta, round(se, 9) AS se, round(pval, 9) AS pval"""


def star_sql(snps: str = "snp", probes: str = "probe", assoc: str = "assoc", where: str = "true", columns: str = COLUMNS) -> str:
    """The twelve columns of the star join over SQL for its three sides."""
    joined = f"""j AS (SELECT s.snp_id, s.chr AS snp_chr, s.bp AS snp_bp, s.a1, s.a2, p.probe_id, p.chr AS probe_chr, p.probe_bp,
  p.gene, a.beta::DOUBLE AS beta, a.se::DOUBLE AS se FROM {assoc} a JOIN {probes} p ON a.probe_idx = p.row_idx
  JOIN {snps} s ON a.snp_idx = s.row_idx)"""
    return f"WITH {STAR},\n{joined},\n{PVALUE.format(source='j')}\nSELECT {columns} FROM pv WHERE {where}"


def _in(region: Region, bp: str) -> str:
    return f"chr = '{region.chrom}' AND {bp} BETWEEN {region.start} AND {region.end}"


def _values(rows: list[tuple]) -> str:
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def registered(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


# ---- scans ----------------------------------------------------------------


@registered(f"WITH {STAR} SELECT * FROM snp WHERE {_in(SNPS, 'bp')}")
def snp_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.snp_range(dataset(spark, sf_dir), SNPS)


@registered(f"WITH {STAR} SELECT * FROM probe WHERE {_in(PROBES, 'probe_bp')}")
def probe_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.probe_range(dataset(spark, sf_dir), PROBES)


@registered(
    f"""WITH {STAR} SELECT * FROM snp WHERE chr = '1' AND bp BETWEEN trunc(1001 / 1000e0 * 1000)::BIGINT
  AND trunc(1509959 / 1000e0 * 1000)::BIGINT"""
)
def snp_range_kb_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.snp_range(dataset(spark, sf_dir), Region("1", 1001, 1_509_959).through_kb())


@registered(f"WITH {STAR} SELECT snp_idx, round(beta::DOUBLE, 9) AS beta, round(se::DOUBLE, 9) AS se FROM assoc WHERE probe_idx = 3")
def probe_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(q.probe_associations(dataset(spark, sf_dir), 3))


# ---- joins ----------------------------------------------------------------

CIS = dict(snps=f"(SELECT * FROM snp WHERE {_in(SNPS, 'bp')})", probes=f"(SELECT * FROM probe WHERE {_in(PROBES, 'probe_bp')})")


@registered(star_sql(**CIS))
def cis_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(q.cis_window(dataset(spark, sf_dir), SNPS, PROBES))


@registered(star_sql(**CIS, where=f"pval < {THRESHOLD}e0"))
def cis_window_pval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(q.cis_window(dataset(spark, sf_dir), SNPS, PROBES, pval_below=THRESHOLD))


@registered(star_sql(snps="(SELECT * FROM snp WHERE snp_id = 'rs42')"))
def assoc_by_snp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(q.by_snp(dataset(spark, sf_dir), "rs42"))


@registered(
    star_sql(
        snps="(SELECT * FROM snp WHERE snp_id = 'rs42')",
        assoc="(SELECT * FROM assoc QUALIFY row_number() OVER (PARTITION BY probe_idx, snp_idx ORDER BY ord) = 1)",
    )
)
def assoc_by_snp_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(q.by_snp(dataset(spark, sf_dir), "rs42", first_only=True))


def _probe_ids(spark: SparkSession, sf_dir: str) -> list[str]:
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").where(F.col("s_suppkey").isin(*PROBE_ROWS))
    by_row = {r.s_suppkey: r.s_name for r in names.select("s_suppkey", "s_name").collect()}
    return [by_row[i] for i in PROBE_ROWS]


@registered(star_sql(probes="(SELECT * FROM probe WHERE row_idx = 3)"))
def assoc_by_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(q.by_probe(dataset(spark, sf_dir), _probe_ids(spark, sf_dir)[0]))


@registered(star_sql(probes="(SELECT * FROM probe WHERE gene = 'GENE3')"))
def assoc_by_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(q.by_gene(dataset(spark, sf_dir), "GENE3"))


@registered(star_sql(snps=f"(SELECT snp.* FROM snp JOIN (VALUES {_values([(x,) for x in SNP_IDS])}) v(id) ON snp_id = id)"))
def multi_snp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(q.by_snp(dataset(spark, sf_dir), SNP_IDS))


@registered(star_sql(probes=f"(SELECT probe.* FROM probe JOIN (VALUES {_values([(x,) for x in PROBE_ROWS])}) v(id) ON row_idx = id)"))
def multi_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(q.by_probe(dataset(spark, sf_dir), _probe_ids(spark, sf_dir)))


@registered(star_sql(probes=f"(SELECT probe.* FROM probe JOIN (VALUES {_values([(x,) for x in GENES])}) v(id) ON gene = id)"))
def multi_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(q.by_gene(dataset(spark, sf_dir), GENES))


def _region_values(found: list[Region]) -> str:
    return _values([(r.chrom, r.start, r.end) for r in found])


@registered(
    star_sql(
        snps=f"(SELECT snp.* FROM snp JOIN (VALUES {_region_values(SNP_REGIONS)}) v(c, a, b) ON chr = c AND bp BETWEEN a AND b)",
        probes=f"(SELECT probe.* FROM probe JOIN (VALUES {_region_values(PROBE_REGIONS)}) v(c, a, b) ON chr = c AND probe_bp BETWEEN a AND b)",
    )
)
def multi_region_cis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(q.cis_windows(dataset(spark, sf_dir), SNP_REGIONS, PROBE_REGIONS))


@registered(
    f"""WITH {STAR}, s AS (SELECT * FROM snp WHERE row_idx % 10 <> 0)
SELECT snp_idx, count(*)::BIGINT AS n FROM assoc WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.row_idx = snp_idx) GROUP BY snp_idx"""
)
def dangling_snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = dataset(spark, sf_dir)
    return q.dangling(Dataset.from_frames(ds.snps.where("row_idx % 10 != 0"), ds.probes, ds.assoc))


# ---- counts and collections -----------------------------------------------


@registered(f"SELECT count(*)::BIGINT AS n_all, count(*) FILTER (WHERE pval < {THRESHOLD}e0)::BIGINT AS n_below FROM ({star_sql(**CIS)})")
def threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.threshold_counts(q.cis_window(dataset(spark, sf_dir), SNPS, PROBES), THRESHOLD)


@registered(
    f"""WITH {STAR} SELECT (pos)::INT AS pos, id, count(snp_idx)::BIGINT AS n
FROM (VALUES {_values(list(enumerate(SNP_IDS)))}) v(pos, id) LEFT JOIN snp ON snp_id = id LEFT JOIN assoc ON snp_idx = row_idx
GROUP BY pos, id"""
)
def id_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.id_counts(q.by_snp(dataset(spark, sf_dir), sorted(set(SNP_IDS))), SNP_IDS, "snp_id")


@registered(
    f"""WITH {STAR} SELECT row_idx AS probe_idx, probe_id, count(snp_idx)::BIGINT AS snp_count
FROM probe LEFT JOIN assoc ON probe_idx = row_idx GROUP BY row_idx, probe_id"""
)
def probe_snp_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.probe_snp_counts(dataset(spark, sf_dir))


LONG = "SELECT probe_idx, ord, snp_idx, round(beta::DOUBLE, 9) AS beta, round(se::DOUBLE, 9) AS se FROM assoc"


def _long(assoc: DataFrame) -> DataFrame:
    return rounded(
        assoc.select("probe_idx", "ord", "snp_idx", F.col("beta").cast("double"), F.col("se").cast("double"))
    )


@registered(f"WITH {STAR} {LONG}")
def probe_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(summary.from_arrays(summary.probe_arrays(dataset(spark, sf_dir))))


@registered("SELECT 'n_snps' AS key, count(*)::VARCHAR AS value FROM part UNION ALL SELECT 'n_probes', count(*)::VARCHAR FROM supplier")
def dataset_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.dataset_counts(dataset(spark, sf_dir))


# ---- scalars --------------------------------------------------------------


@registered(
    f"WITH {STAR}, j AS (SELECT DISTINCT beta::DOUBLE AS beta, se::DOUBLE AS se FROM assoc), {PVALUE.format(source='j')} "
    "SELECT round(beta, 9) AS beta, round(se, 9) AS se, round(pval, 9) AS pval FROM pv"
)
def pvalue_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = dataset(spark, sf_dir).assoc.select("beta", "se").distinct()
    return rounded(
        pairs.select(
            F.col("beta").cast("double"), F.col("se").cast("double"), stats.p_value(F.col("beta"), F.col("se")).alias("pval")
        )
    )


EDGES = [(1.0, 0.0), (1.0, -1.0), (0.0, 1.0), (1.96, 1.0), (5.0, 1.0), (8.3, 1.0), (1e9, 1e-12), (-2.5, 0.5)]
SPECIAL = [("NaN", "1"), ("1", "NaN"), ("Infinity", "1"), ("1", "-Infinity"), ("-Infinity", "NaN")]


@registered(
    f"WITH j AS (SELECT row_number() OVER () AS i, a::DOUBLE AS beta, b::DOUBLE AS se FROM (VALUES "
    f"{_values([(str(a), str(b)) for a, b in EDGES] + SPECIAL)}) v(a, b)), {PVALUE.format(source='j')} "
    "SELECT i::INT AS i, round(pval, 9) AS pval FROM pv"
)
def pvalue_edge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i + 1, float(a), float(b)) for i, (a, b) in enumerate(EDGES + SPECIAL)]
    pairs = spark.createDataFrame(rows, "i int, beta double, se double")
    return pairs.select("i", F.round(stats.p_value(F.col("beta"), F.col("se")), 9).alias("pval"))


REGION_TEXTS = ["1:1191870", "1:100000-2000000", "1:200-100", "1:abc", "1:1-2-3", "1:-5", "1", "X:7", "", "2:5-5"]


@registered(
    f"""WITH v AS (SELECT * FROM (VALUES {_values(list(enumerate(REGION_TEXTS)))}) v(i, t)),
p AS (SELECT i, t, regexp_extract(t, '^([^:]*):([0-9]+)(-([0-9]+))?$', 1) AS c,
  try_cast(regexp_extract(t, '^([^:]*):([0-9]+)(-([0-9]+))?$', 2) AS BIGINT) AS a,
  coalesce(try_cast(regexp_extract(t, '^([^:]*):([0-9]+)(-([0-9]+))?$', 4) AS BIGINT),
    try_cast(regexp_extract(t, '^([^:]*):([0-9]+)(-([0-9]+))?$', 2) AS BIGINT)) AS b FROM v)
SELECT i::INT AS i, t AS text, CASE WHEN a <= b THEN c END AS chrom, CASE WHEN a <= b THEN a END AS start_bp,
  CASE WHEN a <= b THEN b END AS end_bp FROM p"""
)
def parse_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(REGION_TEXTS)), "i int, text string")
    found = rows.select("i", "text", regions.parse_region_column(F.col("text")).alias("r"))
    return found.select("i", "text", "r.chrom", F.col("r.start").alias("start_bp"), F.col("r.end").alias("end_bp"))


SNP_LINES = [
    "  # chr id cM bp a1 a2 freq",
    "   ",
    "3 kx10 1.5 4100 T C 0.35",
    "too short 7",
    "3\tkx11\t.5\t4200\tG\tA\t1e-2",
    "3 kx12 NA 4300",
    "4 kx13 2 NA T C 0.5",
    "4 kx14 2 4400.0 T C 0.5",
    "4 kx15 far 4500 T C 0.5",
    "4 kx16 2 4600 T C often",
    " Y kx17 0 +4700 NA NA NA ",
    "4 kx11 2 4800 C G 0.9 left over",
]
PROBE_LINES = [
    "#probes",
    "7 ILM_1 0.25 88000 ABC1 -",
    "",
    "7 ILM_2 88100",
    "7 ILM_3 NA 88200 XYZ9 +",
    "9 ILM_4 0 91000",
    "9 ILM_5 0 9.1e4 ABC1 +",
    "MT ILM_1 2e-1 500 NA",
]


def _parse(spark: SparkSession, lines: list[str], kind: str) -> DataFrame:
    frame = spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "block long, at long, line string")
    return text.number_rows(text.parse_lines(frame, kind))


_NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
_LINES_SQL = r"""WITH v AS (SELECT i, regexp_extract_all(t, '\S+') AS f FROM (VALUES {rows}) v(i, t)),
k AS (SELECT * FROM v WHERE len(f) >= 4 AND f[1][1] <> '#' AND regexp_matches(f[4], '^[+-]?[0-9]+$')
  AND (f[3] = 'NA' OR regexp_matches(f[3], {number})){more})
SELECT (row_number() OVER (ORDER BY i) - 1)::BIGINT AS row_idx, f[1] AS chr, f[2] AS {name},
  try_cast(f[3] AS DOUBLE) AS genetic_dist, f[4]::BIGINT AS {bp}, {rest} FROM k"""


@registered(
    _LINES_SQL.format(
        rows=_values(list(enumerate(SNP_LINES))),
        number=_NUMBER,
        more=f" AND (f[7] IS NULL OR f[7] = 'NA' OR regexp_matches(f[7], {_NUMBER}))",
        name="snp_id",
        bp="bp",
        rest="f[5] AS a1, f[6] AS a2, try_cast(f[7] AS DOUBLE) AS freq",
    )
)
def parse_esi_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parse(spark, SNP_LINES, "snp")


@registered(
    _LINES_SQL.format(
        rows=_values(list(enumerate(PROBE_LINES))),
        number=_NUMBER,
        more="",
        name="probe_id",
        bp="probe_bp",
        rest="f[5] AS gene, f[6] AS orientation",
    )
)
def parse_epi_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parse(spark, PROBE_LINES, "probe")


@registered(
    f"""SELECT snp_id AS "SNP", snp_chr AS "SNP_Chr", snp_bp::VARCHAR AS "SNP_bp", coalesce(nullif(a1, ''), 'NA') AS "A1",
  coalesce(nullif(a2, ''), 'NA') AS "A2", probe_id AS "Probe", probe_chr AS "Probe_Chr", probe_bp::VARCHAR AS "Probe_bp",
  coalesce(nullif(gene, ''), 'NA') AS "Gene", printf('%.6f', beta) AS "Beta", printf('%.6f', se) AS "SE",
  printf('%.6e', pval) AS "P_value" FROM ({star_sql(**CIS, where=f'pval < {THRESHOLD}e0', columns=RAW)})"""
)
def format_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = q.cis_window(dataset(spark, sf_dir), SNPS, PROBES, pval_below=THRESHOLD)
    return found.select(*formatting.report_columns())


# ---- sources and stores ---------------------------------------------------


def _written(spark: SparkSession, sf_dir: str, kind: str = "3F") -> Dataset:
    """The star with its fact written as a binary matrix."""
    ds = dataset(spark, sf_dir)
    path, n_probes = f"{scratch_path(spark, 'besd')}/matrix.besd", ds.probes.count()
    write_besd(ds.assoc, n_probes, path, kind)
    slices = partial(besd.read_assoc, spark, path, n_probes, valuesPerPartition=50_000)
    return Dataset(ds.snps, ds.probes, slices(), slices=slices)


@registered(f"WITH {STAR} {LONG}")
def besd_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole fact written as a binary matrix and read by its source."""
    return _long(_written(spark, sf_dir).assoc)


@registered(f"WITH {STAR} {LONG}")
def besd_format3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in format 3."""
    return _long(_written(spark, sf_dir, "3").assoc)


@registered(star_sql(**CIS))
def besd_cis_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window over a binary matrix: only the slices of its probes are read."""
    return rounded(q.cis_window(_written(spark, sf_dir), SNPS, PROBES))


@registered(
    f"""WITH {STAR} SELECT (row_number() OVER (ORDER BY bp, row_idx) - 1)::BIGINT AS pos, row_idx, bp
FROM snp WHERE {_in(SNPS, 'bp')}"""
)
def snp_range_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range in its order, with the place of each row."""
    found = q.snp_range(dataset(spark, sf_dir), SNPS, ordered=True)
    # One task keeps the order, which is what is asked for here.
    return found.coalesce(1).select(F.monotonically_increasing_id().alias("pos"), "row_idx", "bp")


@registered(f"WITH {STAR} SELECT row_idx, chr, snp_id, genetic_dist, bp, a1, a2, freq FROM snp")
def esi_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SNPs written as text lists of several files and read in splits."""
    path = scratch_path(spark, "esi")
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    line = F.concat_ws(" ", "chr", "snp_id", F.lit("0"), "bp", cell("a1"), cell("a2"), F.lit("NA"))
    snps = dataset(spark, sf_dir).snps
    snps.repartitionByRange(3, "row_idx").sortWithinPartitions("row_idx").select(line).write.text(path)
    back = text.read_snps(spark, path)
    return back.withColumns({c: F.when(F.col(c) != ".", F.col(c)) for c in ("a1", "a2")})


def _stored(spark: SparkSession, sf_dir: str, by_snp: bool = False) -> Dataset:
    ds, folder = dataset(spark, sf_dir), scratch_path(spark, "store")
    store.write_store(ds.snps, ds.probes, ds.assoc, folder, by_snp=by_snp)
    return Dataset.from_store(spark, folder)


@registered(star_sql(**CIS))
def store_cis_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window over a Parquet store that is written first."""
    return rounded(q.cis_window(_stored(spark, sf_dir), SNPS, PROBES))


@registered(star_sql(snps="(SELECT * FROM snp WHERE snp_id = 'rs42')"))
def store_assoc_by_snp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SNP lookup over a store with the projection by SNP."""
    return rounded(q.by_snp(_stored(spark, sf_dir, by_snp=True), "rs42"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
