"""Edge-length diagnostics: lengths, statistics, histogram, long edges, a reproducible sample, extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygraph.functions.numeric import share
from skygraph.sources.tables import save_temporary


def edge_lengths(edges: DataFrame, points: DataFrame) -> DataFrame:
    """(src, dst, length as float): from ``d2`` where the edges have it, else both ends are looked up by id."""
    if "d2" in edges.columns:
        return edges.select("src", "dst", F.sqrt("d2").cast("float").alias("length"))
    d2 = sum(((F.col(f"p.{c}") - F.col(f"q.{c}")) * (F.col(f"p.{c}") - F.col(f"q.{c}")) for c in "xyz"), F.lit(0.0))
    return with_ends(edges.select("src", "dst"), points).select("src", "dst", F.sqrt(d2).cast("float").alias("length"))


def with_ends(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Edges with the places of both ends, p and q, looked up by id."""
    side = lambda key, name: points.select(F.col("id").alias(key), F.struct("x", "y", "z").alias(name))
    return edges.join(side("src", "p"), "src").join(side("dst", "q"), "dst")


def exact_median(df: DataFrame, column: str, bins: int = 1024) -> float | None:
    """The middle value, or the mean of the two middle ones; None without values. Nulls and NaN are left out.

    Each pass counts the values between two bounds in equal bins, with the least and the greatest of each; at most ``bins`` rows come to
    the driver, which takes the bin of the middle ranks as the next bounds. No task holds more than these sums, however many values
    or equal values there are. A pass narrows the bounds a thousandfold, so three or four read the values of one scale.
    """
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"))
    n, low, high = rows.agg(F.count("x"), F.min("x"), F.max("x")).first()
    ranks, below = ((n - 1) // 2, n // 2), 0
    if not n:
        return None
    while low < high:
        if low == float("-inf") or high == float("inf"):
            # infinite values by themselves, all others between them
            place = F.when(F.col("x") == float("-inf"), 0).when(F.col("x") == float("inf"), 2).otherwise(1)
        else:
            # halves, so that the width of no range overflows
            part = (F.col("x") / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
            place = F.least(F.floor(part * bins), F.lit(bins - 1)) if high / 2 > low / 2 else (F.col("x") > low).cast("int")
        counted = rows.where(F.col("x").between(low, high)).groupBy(place.alias("bin")).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        found, at = [], below
        for r in sorted(counted.collect(), key=lambda r: r["low"]):
            found += [(r, at) for k in ranks if at <= k < at + r["n"]]
            at += r["n"]
        (first, below), (second, _) = found
        if first["bin"] != second["bin"]:
            # the last of one bin and the first of the next with values
            return (first["high"] + second["low"]) / 2
        low, high = first["low"], first["high"]
    return low


def length_stats(lengths: DataFrame) -> DataFrame:
    """One row: count, greatest, least, mean and exact median length; nulls without edges. Lengths are written once and read for each pass of the median."""
    x = F.col("length").cast("double")
    held = save_temporary(lengths.select(x.alias("length")))
    told = held.agg(F.count("length").alias("n"), F.max("length").alias("max_length"), F.min("length").alias("min_length"), F.avg("length").alias("mean_length"))
    return told.withColumn("median_length", F.lit(exact_median(held, "length")).cast("double"))


def length_histogram(lengths: DataFrame, bins: int = 100) -> DataFrame:
    """(bin, n) with all bins on [min, max], the last closed; equal lengths get a range of 1 around them."""
    x = F.col("length").cast("double")
    ends = lengths.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    ends = ends.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    placed = lengths.join(F.broadcast(ends)).groupBy(F.least(F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return lengths.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(placed), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def long_share(lengths: DataFrame, thresholds: tuple[float, float] = (1000.0, 100.0)) -> DataFrame:
    """One row: how many edges are longer than each threshold (strictly), and their percentage; null without edges."""
    n = F.count(F.lit(1))
    long = [F.count_if(F.col("length") > t) for t in thresholds]
    return lengths.agg(n.alias("n"), *[x.alias(f"n_over_{i}") for i, x in enumerate(long)], *[F.round(share(x, n), 6).alias(f"pct_over_{i}") for i, x in enumerate(long)])


def sample_order(seed: int = 0) -> Column:
    """A number by which edges are in no order of their ids: the same in SQL, by remainders that don't overflow."""
    part = lambda c, m: F.pmod(F.col(c), F.lit(1_000_003)) * F.lit(m)
    return F.pmod(part("src", 7_368_787) + part("dst", 4_256_249) + F.lit(seed * 982_451_653), F.lit(2_147_483_647))


def long_sample(lengths: DataFrame, threshold: float = 1000.0, most: int = 10_000, seed: int = 0) -> DataFrame:
    """min(most, n) long edges in the order of ``sample_order``: exact in size and reproducible."""
    return lengths.where(F.col("length") > threshold).orderBy(sample_order(seed), "src", "dst").limit(most)


def segments(lengths: DataFrame) -> DataFrame:
    return lengths.select("src", "dst", F.array("p", "q").alias("segment"))


def extents(points: DataFrame) -> DataFrame:
    return points.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))])
