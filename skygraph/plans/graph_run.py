"""End-to-end run: catalogue, graph bundle, attention inference and result table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygraph.operators import catalog, features, galaxies, gat, graph
from skygraph.sources.tables import Cache, Settings, read_reference_labels, read_scaler, save_temporary, write

FEATURES = ["degree", "mean_length", "min_length", "max_length", "clustering", "density", "near_density", "inertia_1", "inertia_2", "inertia_3"]


def build_bundle(points: DataFrame, settings: Settings, scaler=None) -> dict[str, DataFrame]:
    """nodes, edges, normalised features and the catalogue of a point cloud."""
    if settings.first_moment_matching and scaler is None:
        raise ValueError("first-moment matching needs a scaler")
    nodes = points.select("id", "x", "y", "z")
    edges = save_temporary(graph.alpha_edges(nodes, settings.radius).select("src", "dst", "length") if settings.graph_type == "alpha" else graph.delaunay_edges(nodes))
    raw = save_temporary(graph.node_stats(nodes, edges))
    return {"nodes": nodes, "edges": edges, "features": features.normalise(raw, FEATURES, scaler if settings.first_moment_matching else None), "catalogue": points}


def catalogue_points(catalogue: DataFrame, settings: Settings, key: str = "targetid") -> DataFrame:
    """The graph's points from a catalogue: galaxies in the redshift range, good and above the mass cut of the settings, with coordinates; ids are places, northern rows first."""
    kept = galaxies.quality_filter(catalog.select_rows(catalogue, settings.z_min, settings.z_max), settings.log_mass)
    placed = galaxies.north_first(galaxies.with_coordinates(kept), key)
    axes = {"x_mpc": "x", "y_mpc": "y", "z_mpc": "z"}
    # the redshift's name is the axis's too
    return placed.withColumnRenamed("z", "redshift").withColumnsRenamed(axes).withColumn("id", F.col("position") - 1).drop("position")


def bundle_of_catalogue(catalogue: DataFrame, settings: Settings, scaler=None, key: str = "targetid") -> dict[str, DataFrame]:
    """From the catalogue to nodes, edges, features: the points are written once, as every later step reads them."""
    return build_bundle(save_temporary(catalogue_points(catalogue, settings, key)), settings, scaler)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """The model's table (layer, param, shape, data); a missing one is an error before any work."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"no model at {path}")
    return spark.read.parquet(path)


def infer(bundle: dict[str, DataFrame], params: dict) -> DataFrame:
    x = bundle["features"].select("id", F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("x"))
    return gat.predict(gat.logits(x, bundle["edges"], params, bundle["nodes"]))


def attach(catalogue: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions beside the catalogue's columns; a node without one ends the job when it is met."""
    joined = catalogue.join(predictions.withColumn("_there", F.lit(True)), "id", "left")
    whole = F.when(F.col("_there"), F.col("gat_env")).otherwise(F.raise_error(F.concat(F.lit("no prediction for node "), F.col("id").cast("string"))).cast("bigint"))
    return joined.withColumn("gat_env", whole).drop("_there")


def write_result(catalogue: DataFrame, predictions: DataFrame, path: str) -> DataFrame:
    """The catalogue with its predictions, written whole and reread; as many rows as the catalogue has, or an error."""
    write(attach(catalogue, predictions), path)
    out = catalogue.sparkSession.read.parquet(path)
    if (n := out.count()) != (all_of := catalogue.count()):
        raise ValueError(f"{n} rows were written for {all_of} of the catalogue")
    return out


def end_to_end(spark: SparkSession, points: DataFrame, settings: Settings, params: dict, folder: str | None = None, scaler=None, out: str | None = None) -> DataFrame:
    """The catalogue with a class and its probabilities a node; written to ``out`` where one is given."""
    build = lambda: build_bundle(points, settings, scaler)
    bundle = Cache(spark, folder, settings, [points, scaler]).resolve(build)[0] if folder else build()
    found = infer(bundle, params)
    return write_result(bundle["catalogue"], found, out) if out else attach(bundle["catalogue"], found)


def run_inference(spark: SparkSession, points: DataFrame, *, model_path: str, cache_folder: str | None = None, scaler_path: str | None = None, result_path: str | None = None, reference_path: str | None = None, summary: bool = True, settings: Settings | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The run by its parameters: (result, shares of the classes); the latter is None without ``summary`` and without a reference.

    A missing model is an error before any work.
    """
    settings = settings or Settings()
    params = gat.params_of(load_model(spark, model_path))
    scaler = read_scaler(spark, scaler_path) if scaler_path else None
    result = end_to_end(spark, points, settings, params, cache_folder, scaler, result_path)
    if not summary or not reference_path:
        return result, None
    return result, gat.class_distribution(result, "gat_env", "catalogue").unionByName(gat.class_distribution(read_reference_labels(spark, reference_path), "cweb", "reference"))
