"""Sequence fixture derived from ``part`` and ``lineitem``, as SQL for Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.config import PRIMERS

READ_LEN = 40
CODES = ("RYKMSWBDHVN", "ACGACACAAAA")


def dna(x: str) -> str:
    return f"translate(md5({x}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def swap(x: str, place: str) -> str:
    p = f"CAST({place} AS INT)"
    return f"concat(substr({x}, 1, {p}), translate(substr({x}, {p} + 1, 1), 'ACGT', 'CGTA'), substr({x}, {p} + 2))"


def swap_two(x: str, place: str, gap: int) -> str:
    p = f"CAST({place} AS INT)"
    t = lambda y: f"translate({y}, 'ACGT', 'CGTA')"
    return (
        f"concat(substr({x}, 1, {p}), {t(f'substr({x}, {p} + 1, 1)')}, substr({x}, {p} + 2, {gap - 1}), "
        f"{t(f'substr({x}, {p} + {gap + 1}, 1)')}, substr({x}, {p} + {gap + 2}))"
    )


_values = ", ".join(f"({r}, '{f}', '{v}')" for r, f, v in PRIMERS)
PRIMER_SQL = f"""SELECT region, fwd, rev, translate(fwd, '{CODES[0]}', '{CODES[1]}') AS f, translate(rev, '{CODES[0]}', '{CODES[1]}') AS r
FROM (VALUES {_values}) AS t(region, fwd, rev)"""

_FWD = f"substr({dna("concat('f', CAST(s % (20 + 8 * region) AS STRING), ':', CAST(region AS STRING))")}, 1, {READ_LEN} - length(f))"
_REV = f"substr({dna("concat('r', CAST(s % (20 + 8 * region) AS STRING), ':', CAST(region AS STRING))")}, 1, {READ_LEN} - length(r))"

REF_SQL = f"""SELECT bact_id, region,
  CASE WHEN (s * 7 + region) % 11 <> 0 THEN concat({_FWD}, {_REV}) END AS kmer,
  ((s * 7 + region) % 11 <> 0 AND (s + region) % 13 <> 0) AS is_perfect_match
FROM (SELECT p_partkey AS bact_id, p_partkey % 60 AS s FROM part) b CROSS JOIN fx_primers"""

TAXONOMY_SQL = """SELECT p_partkey AS bact_id, 'D' AS domain, p_type AS phylum, p_brand AS class, CAST(p_size AS STRING) AS "order",
  concat(p_brand, p_type) AS family, p_name AS genus, concat(p_name, CAST(p_partkey % 3 AS STRING)) AS species FROM part"""

READS_SQL = f"""SELECT sample, key AS pair_key, r1 AS s1, q AS q1, r2 AS s2, q AS q2 FROM (
  SELECT sample, key,
    CASE WHEN q % 13 = 0 THEN {swap_two('a', '22 + pos % 8', 9)} WHEN q % 10 = 0 THEN {swap('a', '22 + pos % 16')} ELSE a END AS r1,
    {rc(f"CASE WHEN q % 23 = 0 THEN concat(translate(substr(b, 1, 3), 'ACGT', 'CGTA'), substr(b, 4)) WHEN q % 17 = 0 THEN {swap('b', 'pos % 4')} ELSE b END")} AS r2,
    concat(repeat('5', mid), repeat('#', low), repeat('I', {READ_LEN} - mid - low)) AS q
  FROM (SELECT sample, key, q, pos, mid, low, concat(f, {_FWD}) AS a, concat({_REV}, {rc('r')}) AS b
    FROM (SELECT concat('S', CAST(l_suppkey % 4 AS STRING)) AS sample, concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING)) AS key,
        1 + (l_orderkey + l_linenumber) % 5 AS reg, (l_partkey % 25) * 2 % 60 AS s, CAST(l_quantity AS INT) AS q, l_orderkey % 20 AS pos,
        CAST(2 * l_linenumber AS INT) AS mid, CAST(CASE WHEN l_discount = 0.05 THEN 5 ELSE l_linenumber % 3 END AS INT) AS low FROM lineitem) l
    JOIN fx_primers ON reg = region WHERE (s * 7 + region) % 11 <> 0) x) y"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``fx_primers, fx_ref, fx_taxonomy, fx_reads`` as DataFrames."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    fx_primers = spark.sql(PRIMER_SQL)
    run = lambda sql, **kw: spark.sql(
        sql.replace("{", "{{").replace("}", "}}").replace("FROM part", "FROM {part}").replace("FROM lineitem", "FROM {lineitem}")
        .replace("CROSS JOIN fx_primers", "CROSS JOIN {fx}").replace("JOIN fx_primers", "JOIN {fx}").replace('"order"', "`order`"),
        **kw,
    )
    return {
        "primers": fx_primers,
        "ref": run(REF_SQL, part=part, fx=fx_primers),
        "taxonomy": run(TAXONOMY_SQL, part=part),
        "reads": run(READS_SQL, lineitem=lineitem, fx=fx_primers),
    }


def duckdb_ctes() -> str:
    return f"fx_primers AS ({PRIMER_SQL}),\nfx_ref AS ({REF_SQL}),\nfx_taxonomy AS ({TAXONOMY_SQL}),\nfx_reads AS ({READS_SQL})"
