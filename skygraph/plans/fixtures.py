"""Catalogue-shaped views over the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKY = """SELECT o_orderkey AS targetid,
  CASE WHEN o_orderkey % 10 < 9 THEN 'main' ELSE 'sv3' END AS survey,
  CASE o_orderstatus WHEN 'O' THEN 'bright' WHEN 'F' THEN 'dark' ELSE 'backup' END AS program,
  (o_orderkey * 137.50776405E0) % 360E0 AS ra, (o_custkey * 61.803398875E0) % 180E0 - 90E0 AS dec_deg,
  CAST(o_orderkey % 4 AS BIGINT) AS bgs_target,
  CASE WHEN o_orderkey % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 0.005E0 + o_totalprice / 500000E0 * 0.06E0 END AS z,
  CAST(CASE WHEN o_orderkey % 13 = 0 THEN 4 ELSE 0 END AS BIGINT) AS zwarn,
  CASE WHEN o_orderkey % 101 = 0 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice / 4000E0 END AS deltachi2,
  CASE WHEN o_orderkey % 20 = 0 THEN 'STAR' WHEN o_orderkey % 20 = 1 THEN 'QSO' ELSE 'GALAXY' END AS spectype,
  CASE WHEN o_orderkey % 89 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 7.5E0 + (o_custkey % 500) / 100E0 END AS logmstar,
  CASE WHEN o_orderkey % 2 = 0 THEN 1152921504606846976 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END
  + CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN 4 ELSE 0 END
  + CASE WHEN o_orderkey % 11 = 0 THEN 2305843009213693952 ELSE 0 END + CASE WHEN o_orderkey % 17 = 0 THEN 4611686018427387904 ELSE 0 END AS desi_target
FROM {orders}"""
#: Each observation: a seventh of the targets again in another survey, a fifteenth again in the same, with other measurements.
OBSERVED = """SELECT targetid, survey, program, ra, dec_deg, bgs_target, z, zwarn, deltachi2, spectype, logmstar, 0 AS visit FROM {seen}
UNION ALL SELECT targetid, 'special' AS survey, 'dark' AS program, ra, dec_deg, bgs_target, z * 0.75E0 AS z, zwarn, deltachi2 + 1E0 AS deltachi2, spectype, logmstar + 0.25E0 AS logmstar, 1 AS visit FROM {seen} WHERE targetid % 7 = 0
UNION ALL SELECT targetid, survey, program, ra, dec_deg, bgs_target, z * 0.5E0 AS z, zwarn, deltachi2 + 2E0 AS deltachi2, spectype, logmstar - 0.5E0 AS logmstar, 2 AS visit FROM {seen} WHERE targetid % 15 = 0"""
ZCAT = """SELECT targetid, survey, program, z AS z_zcat, spectype AS spectype_zcat, targetid % 9 <> 0 AS zcat_primary, CAST(1 AS INT) AS zcat_nspec
FROM ({sky}) WHERE targetid % 6 <> 0
UNION ALL SELECT targetid, survey, program, z AS z_zcat, spectype AS spectype_zcat, FALSE AS zcat_primary, CAST(2 AS INT) AS zcat_nspec
FROM ({sky}) WHERE targetid % 15 = 0"""
PHOT = """SELECT l_orderkey AS targetid, CAST((l_orderkey + l_suppkey % 2) % 12 AS INT) AS hpx12, l_returnflag AS type,
  CAST(l_discount AS FLOAT) AS fracflux_r, CAST(l_tax AS FLOAT) AS shape_r, CAST(l_quantity AS FLOAT) AS sersic FROM {lineitem}"""


def _sql(text: str, place) -> str:
    return text.replace("{sky}", SKY).replace("{orders}", place("orders")).replace("{lineitem}", place("lineitem"))


def _view(text: str):
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(_sql(text, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))

    return make


sky, zcat, phot, observed = _view(SKY), _view(ZCAT), _view(PHOT), _view(OBSERVED.replace("{seen}", "({sky})"))
OBSERVED_SQL = OBSERVED.replace("{seen}", "sky")
WITH_SKY = f"WITH sky AS ({_sql(SKY, str)})"
ZCAT_SQL = _sql(ZCAT, str)
WITH_ALL = f"{WITH_SKY}, zcat AS ({ZCAT_SQL}), phot AS ({_sql(PHOT, str)})"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, z, f1..f10, label from the embeddings."""
    at = lambda i: F.element_at("embedding", i).cast("double")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), *[F.round(at(i) * F.lit(100.0), 6).alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))], *[F.abs(at(3 + i)).alias(f"f{i}") for i in range(1, 11)], "label")


WITH_POINTS = "WITH points AS (SELECT vec_id AS id, " + ", ".join(f"round(CAST(embedding[{i}] AS DOUBLE) * 100E0, 6) AS {c}" for i, c in ((1, "x"), (2, "y"), (3, "z"))) + ", " + ", ".join(f"abs(CAST(embedding[{3 + i}] AS DOUBLE)) AS f{i}" for i in range(1, 11)) + ", label FROM embeddings)"
D2 = "((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))"
WITH_PAIRS = f"{WITH_POINTS}, pairs AS (SELECT p.id AS src, q.id AS dst, {D2} AS d2 FROM points p JOIN points q ON p.id < q.id AND abs(p.x-q.x) <= 8E0 AND {D2} <= 64E0)"
