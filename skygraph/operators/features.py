"""Node features: Box-Cox by maximum likelihood, a given scaler, and centring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygraph.functions.numeric import avg_num

OFFSET = 1e-6


def boxcox(x: Column, power: float) -> Column:
    """(x^l - 1) / l, or ln x at l = 0; a value that isn't positive is an error."""
    positive = F.when(x > 0, x).when(x.isNull() | F.isnan(x), x).otherwise(F.raise_error(F.lit("Box-Cox needs positive values")).cast("double"))
    return F.log(positive) if power == 0 else (F.pow(positive, F.lit(power)) - F.lit(1.0)) / F.lit(power)


def fit(df: DataFrame, columns: list[str], offset: float = OFFSET, zooms: int = 4, grid: int = 41) -> dict[str, tuple[float, float, float]]:
    """(lambda, mean, population sd) by column, over the values that are neither null nor NaN.

    Each zoom is one aggregate by column and trial power, over rows of one value each; ``len(columns) * grid`` rows come to the driver.
    """
    spark = df.sparkSession
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), (F.col(c).cast("double") + offset).alias("x")) for i, c in enumerate(columns)])).alias("v")).select("v.c", "v.x").where("x is not null and not isnan(x)")
    values = values.withColumn("x", F.when(F.col("x") > 0, F.col("x")).otherwise(F.raise_error(F.lit("Box-Cox needs positive values")).cast("double")))
    base = {r.c: (r.n, r.logs) for r in values.groupBy("c").agg(F.count("x").alias("n"), F.sum(F.log("x")).alias("logs")).collect()}
    best = {c: (1.0, 0.0, 1.0) for i, c in enumerate(columns) if i not in base}
    lo, hi = dict.fromkeys(base, -5.0), dict.fromkeys(base, 5.0)
    power = F.when(F.col("p") == 0, F.log("x")).otherwise((F.pow("x", "p") - 1.0) / F.col("p"))
    for _ in range(zooms + 1 if base else 0):
        trial = {c: np.linspace(lo[c], hi[c], grid) for c in base}
        for c in base:
            trial[c][np.abs(trial[c]) < 1e-12] = 0.0
        powers = spark.createDataFrame([(c, i, float(p)) for c, t in trial.items() for i, p in enumerate(t)], "c int, i int, p double")
        tried: dict = {c: [None] * grid for c in base}
        for r in values.join(F.broadcast(powers), "c").groupBy("c", "i").agg(F.avg(power).alias("m"), F.var_pop(power).alias("v")).collect():
            tried[r.c][r.i] = (r.m, r.v)
        for c, t in tried.items():
            n, logs = base[c]
            if all(v <= 1e-300 for _, v in t):
                best[columns[c]] = (1.0, t[-1][0], 1.0)
                continue
            i = int(np.argmax([(p - 1) * logs - n / 2 * np.log(max(v, 1e-300)) for p, (_, v) in zip(trial[c], t)]))
            best[columns[c]] = (float(trial[c][i]), t[i][0], float(np.sqrt(t[i][1])) or 1.0)
            lo[c], hi[c] = float(trial[c][max(0, i - 1)]), float(trial[c][min(grid - 1, i + 1)])
    return {c: best[c] for c in columns}


def apply(df: DataFrame, scaler: dict[str, tuple[float, float, float]], offset: float = OFFSET) -> DataFrame:
    return df.withColumns({c: (boxcox(F.col(c) + offset, p) - F.lit(m)) / F.lit(s) for c, (p, m, s) in scaler.items()})


def center(df: DataFrame, columns: list[str]) -> DataFrame:
    """Subtract each column's mean over the values that aren't NaN; the means are one row."""
    means = df.agg(*[avg_num(F.col(c)).alias(f"_m_{c}") for c in columns])
    return df.join(F.broadcast(means)).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def normalise(df: DataFrame, columns: list[str], scaler: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """A scaler fitted here, or one given (first-moment matching); centred either way."""
    return center(apply(df, scaler or fit(df, columns)), columns)
