"""Table sources and sinks, the graph cache and run settings."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def read(spark: SparkSession, *paths: str, columns: list[str] | None = None, row_id: bool = False) -> DataFrame:
    """Parquet by path or paths, pruned to ``columns``; a missing path is an error. Strings are trimmed on the right, once, here.

    ``row_id`` adds file_name and row_index, the position of each row in its file.
    """
    df = spark.read.parquet(*paths)
    place = {"file_name": F.col("_metadata.file_name"), "row_index": F.col("_metadata.row_index")} if row_id else {}
    trimmed = {f.name for f in df.schema if isinstance(f.dataType, StringType)}
    return df.select(*[v.alias(k) for k, v in place.items()], *[F.rtrim(c).alias(c) if c in trimmed else F.col(c) for c in (columns or df.columns)])


#: The place of a row: its sub-catalogue, the file within it by name, and the row within the file.
PLACE = ["part", "file", "row_index"]


def read_placed(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """Sub-catalogues, a path each, with the place of every row: tables that were written alike have equal rows at equal places.

    Only names of files, which the driver lists anyway, are joined to the rows, by a broadcast: no stream is shuffled for its places.
    """
    names = [(spelt, i, k) for i, p in enumerate(paths) for k, f in enumerate(sorted(spark.read.parquet(p).inputFiles())) for spelt in _spellings(f)]
    place = spark.createDataFrame(names, "_path string, part int, file int")
    df = spark.read.parquet(*paths)
    trimmed = {f.name for f in df.schema if isinstance(f.dataType, StringType)}
    cells = [F.rtrim(c).alias(c) if c in trimmed else F.col(c) for c in (df.columns if columns is None else columns)]
    return df.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("row_index"), *cells).join(F.broadcast(place), "_path").drop("_path")


def _spellings(path: str) -> list[str]:
    """file:/x and file:///x are one place: what the listing and the rows call it may differ."""
    scheme, colon, rest = path.partition(":")
    return sorted({path, f"{scheme}:/{rest.lstrip('/')}", f"{scheme}:///{rest.lstrip('/')}"}) if colon and (rest.startswith("///") or not rest.startswith("//")) else [path]


def write_bucketed(df: DataFrame, path: str, name: str, keys: list[str], buckets: int) -> DataFrame:
    """A table in ``buckets`` files by the hash of its keys, sorted within: tables that are bucketed alike are joined by these keys without an exchange. Rows are dealt once, here."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").option("path", path).saveAsTable(name)
    return spark.table(name)


def read_rows(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows by position: ``wanted`` has file_name and row_index."""
    return df.join(wanted.select("file_name", "row_index"), ["file_name", "row_index"], "left_semi")


def read_partitioned(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame | None:
    """Files that match a pattern under a folder, with its partition columns; None if there are none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    try:
        return spark.read.option("pathGlobFilter", pattern).parquet(path)
    except Exception as e:  # an existing folder without such a file
        if "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def read_property(spark: SparkSession, path: str, name: str) -> str:
    """A value from the properties table (name, value) beside a set of files, the stand-in for a header keyword; a missing one is an error."""
    found = spark.read.parquet(path).where(F.col("name") == name).select("value").limit(1).collect()
    if not found:
        raise KeyError(f"no property {name!r} in {path}")
    return found[0].value


def read_scaler(spark: SparkSession, path: str) -> dict[str, tuple[float, float, float]]:
    """(lambda, mean, sd) by feature from a table (feature, lambda, mean, std); a row a feature."""
    return {r["feature"]: (float(r["lambda"]), float(r["mean"]), float(r["std"])) for r in spark.read.parquet(path).collect()}


def read_reference_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, cweb) of the reference catalogue; nothing is read until it is used."""
    return spark.read.schema("id bigint, cweb int").parquet(path)


def write(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a written table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for checkpoints; where none is named, one in the warehouse, which executors share too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_skygraph"
    return f"{root.rstrip('/')}/graph"


def save_temporary(df: DataFrame) -> DataFrame:
    """Write to the shared folder and reread, so that plans don't grow and lost executors cost one step."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._temporary_path = path
    return out


def drop_temporary(df: DataFrame) -> None:
    """Delete a table of ``save_temporary`` that no later plan reads."""
    delete(df.sparkSession, df._temporary_path)


@dataclass(frozen=True)
class Settings:
    """An argument goes before an environment variable (SKYGRAPH_<NAME>), which goes before the default; a variable that is set but empty counts."""

    z_min: float = 0.01
    z_max: float = 0.06
    log_mass: float = 9.0
    graph_type: str = "alpha"
    radius: float = 4.0
    cache_mode: str = "rebuild"
    first_moment_matching: bool = False

    @classmethod
    def load(cls, **arguments) -> Settings:
        found = {}
        for name, default in asdict(cls()).items():
            value = arguments.get(name, os.environ.get(f"SKYGRAPH_{name.upper()}"))
            if value is not None:
                found[name] = value if name in arguments or isinstance(default, str) else (value.lower() in ("1", "true")) if isinstance(default, bool) else type(default)(value)
        return cls(**found)

    def fingerprint(self) -> str:
        kept = {k: v for k, v in asdict(self).items() if k != "cache_mode"}
        return hashlib.sha1(json.dumps(kept, sort_keys=True).encode()).hexdigest()[:12]


PARTS = ("edges", "nodes", "features", "catalogue")
MODES = ("rebuild", "prefer-cache", "cache-only")


def content_of(df: DataFrame) -> str:
    """A fingerprint of a table's rows and columns, whatever their order: the number of rows and, by two seeds, the sums of their hashes.

    One pass of partial sums. Equal tables have equal fingerprints; a row more, less or changed changes it but for a chance of 2**-64 each
    seed. Maps, which have no hash, go by their sorted entries.
    """
    names = sorted(df.columns)
    kinds = dict(df.dtypes)
    cells = [F.array_sort(F.map_entries(f"`{c}`")) if kinds[c].startswith("map<") else F.col(f"`{c}`") for c in names]
    # a null is told from a value by its own column of marks
    marks = F.concat(F.lit(""), *[F.col(f"`{c}`").isNull().cast("string") for c in names])
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), marks, *cells).cast("decimal(38,0)")), F.lit(0)).cast("string") for seed in (1, 2)]
    r = df.agg(F.count(F.lit(1)).cast("string"), *sums).first()
    return hashlib.sha1(json.dumps([[(c, kinds[c]) for c in names], list(r)]).encode()).hexdigest()[:16]


class Cache:
    """Four tables under a folder that is named by graph type, settings and input, so that no other settings or input ever read them.

    ``inputs``: the tables that the bundle is built from, such as the catalogue and the scaler; their contents go into the name.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: Settings, inputs: list[DataFrame | dict | None] = ()):
        if settings.cache_mode not in MODES:
            raise ValueError(f"unknown cache mode {settings.cache_mode!r}: one of {MODES}")
        kind = "alpha" if settings.graph_type == "alpha" else "delaunay"
        self.spark, self.mode = spark, settings.cache_mode
        told = "-".join(content_of(x) if isinstance(x, DataFrame) else hashlib.sha1(json.dumps(x, sort_keys=True).encode()).hexdigest()[:16] for x in inputs)
        self.paths = {p: f"{folder.rstrip('/')}/{kind}-{settings.fingerprint()}{'-' + told if told else ''}/{p}" for p in PARTS}

    def complete(self) -> bool:
        def there(path: str) -> bool:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
            return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

        return all(there(p) for p in self.paths.values())

    def load(self) -> dict[str, DataFrame]:
        return {k: self.spark.read.parquet(p) for k, p in self.paths.items()}

    def resolve(self, build) -> tuple[dict[str, DataFrame], str]:
        """The bundle and where it is from. rebuild ignores the cache but writes it; a partial cache counts as missing; a failed save is reported, not raised."""
        if self.mode != "rebuild" and self.complete():
            return self.load(), "cache"
        if self.mode == "cache-only":
            raise FileNotFoundError(f"no complete cache under {self.paths['edges'].rsplit('/', 1)[0]}")
        bundle = build()
        try:
            for k, p in self.paths.items():
                write(bundle[k], p)
            return self.load(), "built"
        except Exception as e:
            print(f"the cache was not saved: {e}")
            return bundle, "built, not saved"
