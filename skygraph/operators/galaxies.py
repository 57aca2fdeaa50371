"""Galaxy samples: quality cuts, target classes, coordinates and hemispheres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from skygraph.functions import cosmology, sphere
from skygraph.functions.numeric import ge_num, gt_num

# The bit of each target class.
CLASS_BITS = {"BGS": 60, "LRG": 0, "ELG": 1, "QSO": 2, "MWS": 61, "SCND": 62}
SELECTABLE = ("BGS", "ELG", "LRG", "QSO")


def quality_filter(df: DataFrame, log_mass: float = 9.0, delta_chi2: float = 25.0) -> DataFrame:
    """Redshift success and quality, stellar mass (inclusive) and targeting; NaN fails the comparisons."""
    return df.where((F.col("zwarn") == 0) & ge_num(F.col("deltachi2"), delta_chi2) & ge_num(F.col("logmstar"), log_mass) & (F.col("bgs_target") != 0))


def has_class(name: str, mask: str = "desi_target") -> Column:
    return F.col(mask).bitwiseAND(F.lit(1 << CLASS_BITS[name])) != 0


def select_class(df: DataFrame, name: str = "BGS", log_mass: float = 9.0) -> DataFrame:
    """Targets of a class above a stellar mass (exclusive)."""
    if name not in SELECTABLE:
        raise ValueError(f"unknown class {name!r}: one of {SELECTABLE}")
    return df.where(has_class(name) & gt_num(F.col("logmstar"), log_mass))


def class_counts(df: DataFrame) -> DataFrame:
    """One row; a target of several classes counts in each."""
    return df.agg(*[F.count_if(has_class(c)).alias(f"n_{c.lower()}") for c in CLASS_BITS])


def with_coordinates(df: DataFrame, ra: str = "ra", dec: str = "dec_deg", z: str = "z") -> DataFrame:
    """Adds d_mpc, x_mpc, y_mpc, z_mpc, b_deg and is_north."""
    a, d = F.col(ra), F.col(dec)
    out = df.withColumn("d_mpc", cosmology.comoving_distance(F.col(z)))
    return out.withColumns(sphere.cartesian(F.col("d_mpc"), a, d) | {"b_deg": sphere.galactic_latitude_deg(a, d), "is_north": sphere.is_north(a, d)})


def sky_map(df: DataFrame, ra: str = "ra", dec: str = "dec_deg") -> DataFrame:
    return df.withColumns({"lon_rad": sphere.map_longitude(F.col(ra)), "lat_rad": F.radians(dec)})


def north_first(df: DataFrame, order: str) -> DataFrame:
    """Adds ``position``: northern rows by ``order``, then southern ones.

    Positions within a hemisphere come from parts of about as many rows each, so that the two hemispheres aren't two tasks,
    however the order's values lie.
    """
    parts = 64
    bounds = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    part = sum(((F.col(order) > F.lit(b)).cast("int") for b in sorted(set(bounds))), F.lit(0))
    parted = df.withColumn("_part", part)
    sizes = sorted(((not r.is_north, r["_part"], r["count"]) for r in parted.groupBy("is_north", "_part").count().collect()))
    total, start = 0, []
    for south, part, n in sizes:
        start.append((not south, part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(start or [(True, 0, 0)], "is_north boolean, _part int, _start bigint")
    inside = F.row_number().over(Window.partitionBy("is_north", "_part").orderBy(order))
    return parted.withColumn("_in", inside).join(F.broadcast(offsets), ["is_north", "_part"]).withColumn("position", F.col("_start") + F.col("_in")).drop("_part", "_in", "_start")


SCATTERS = ("hemispheres", "full")


def scatter(df: DataFrame, mode: str = "hemispheres") -> DataFrame:
    """Data of the scatter in space: (panel, x_mpc, y_mpc, z_mpc), in one panel or in one a hemisphere; an unknown mode is an error before any work."""
    if mode not in SCATTERS:
        raise ValueError(f"unknown scatter {mode!r}: one of {SCATTERS}")
    panel = F.lit("full") if mode == "full" else F.when(F.col("is_north"), "north").otherwise("south")
    return df.select(panel.alias("panel"), "x_mpc", "y_mpc", "z_mpc")


def reorder_counts(df: DataFrame, order: str) -> DataFrame:
    """One row: how many rows there are before and after northern rows are put first, both seen by the one pass that reorders them."""
    before, after = Observation("before"), Observation("after")
    seen = north_first(df.observe(before, F.count(F.lit(1)).alias("n")), order).observe(after, F.count(F.lit(1)).alias("n"))
    seen.write.format("noop").mode("overwrite").save()
    return df.sparkSession.createDataFrame([(before.get["n"], after.get["n"])], "n_before bigint, n_after bigint")


def hemisphere_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("is_north").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d_mpc"), 6).alias("mean_d_mpc"))
