"""Rows by place, pruning by pixel, the exact median, the cache's input, and the catalogue's way to the graph."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygraph.operators import catalog, diagnostics, galaxies
from skygraph.plans import graph_run
from skygraph.sources import tables


def folder(spark, name):
    return f"{tables.shared_folder(spark)}/{name}"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def streams(spark):
    """Two sub-catalogues of three streams, in which targets repeat within and across them."""
    rows = spark.range(60).select(F.col("id"), (F.col("id") % 5).alias("targetid"), F.when(F.col("id") % 3 == 0, "STAR").otherwise("GALAXY").alias("spectype"), F.lit(0.02).alias("z"), (F.col("id") * 2).alias("mass"), (F.col("id") * 3).alias("line"))
    out = []
    for name, columns in (("meta", ["targetid", "spectype", "z"]), ("spec", ["mass"]), ("fast", ["line"])):
        paths = []
        for part, own in (("main", "id < 40"), ("sv3", "id >= 40")):
            paths.append(folder(spark, f"streams/{name}/{part}"))
            rows.where(own).repartition(3, "id").sortWithinPartitions("id").select(*columns).write.mode("overwrite").parquet(paths[-1])
        out.append(paths)
    return out


def test_rows_are_stitched_by_place(spark, streams):
    first, *others = streams
    got = catalog.stitched_rows(spark, first, others).collect()
    assert sorted((r.targetid, r.mass, r.line) for r in got) == sorted((i % 5, 2 * i, 3 * i) for i in range(60) if i % 3)
    kept = catalog.stitched_rows(spark, first, others, [["targetid", "spectype", "z"], [], ["line"]])
    assert kept.columns == ["targetid", "spectype", "z", "line"] and kept.count() == 40
    with pytest.raises(ValueError, match="more than one table"):
        catalog.stitched_rows(spark, first, [first])


def test_bucketed_streams_are_joined_without_an_exchange(spark, streams):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = [tables.write_bucketed(tables.read_placed(spark, paths), folder(spark, f"bucketed/{i}"), f"bucketed_{i}", tables.PLACE, 4) for i, paths in enumerate(streams)]
        got = catalog.stitch([catalog.select_rows(made[0]), *made[1:]], tables.PLACE)
        assert "Exchange" not in plan(got) and plan(got).count("SortMergeJoin") == 2
        assert sorted((r.targetid, r.mass, r.line) for r in got.collect()) == sorted((i % 5, 2 * i, 3 * i) for i in range(60) if i % 3)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for i in range(3):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{i}")


def test_only_files_of_the_catalogues_pixels_are_read(spark):
    path = folder(spark, "pixels")
    spark.range(600).select(F.col("id").alias("targetid"), (F.col("id") % 30).cast("int").alias("hpx")).repartition("hpx").write.mode("overwrite").partitionBy("hpx").parquet(path)
    rows = tables.read_partitioned(spark, path)
    targets = spark.createDataFrame([(7, 7), (9, 8), (38, 8), (1, None), (400, 77)], "targetid bigint, hpx int")
    got = catalog.photometry_rows(catalog.in_pixels_of(rows, targets), targets, ["hpx", "targetid"])
    assert sorted(tuple(r) for r in got.select("targetid", "hpx").collect()) == [(7, 7), (38, 8)]
    assert "PartitionFilters: [hpx" in plan(got).replace("isnotnull(hpx", "hpx").replace("(hpx", "hpx") or "hpx#" in plan(got).split("PartitionFilters: [")[1].split("]")[0]
    read = rows.where(F.col("hpx").isin([7, 8])).select(F.input_file_name().alias("f")).distinct().count()
    assert catalog.in_pixels_of(rows, targets).select(F.input_file_name().alias("f")).distinct().count() == read == 2
    # beyond the bound a join does the same
    wide = catalog.in_pixels_of(rows, targets, most=1)
    assert sorted(r.targetid for r in catalog.photometry_rows(wide, targets, ["hpx", "targetid"]).collect()) == [7, 38]
    assert "LeftSemi" in plan(wide)


@pytest.mark.parametrize("values", [[1.0], [2.0, 3.0], [5.0] * 40, [1.0] * 30 + [2.0] * 30, [1e308, -1e308, 3.0], [float("inf"), 1.0, float("-inf"), 2.0], [0.0, 5e-324, 1e-300], list(np.random.default_rng(1).lognormal(0, 20, 501)), list(np.random.default_rng(2).integers(0, 7, 1000).astype(float)), [1.0] * 999 + [1e300]])
def test_median_by_selection_equals_numpy(spark, values):
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,), (float("nan"),)], "length double").repartition(3)
    assert diagnostics.exact_median(df, "length") == float(np.median(values))
    assert diagnostics.exact_median(df, "length") == diagnostics.exact_median(df.coalesce(1), "length")


def test_statistics_without_edges(spark):
    got = diagnostics.length_stats(spark.createDataFrame([], "length float"))
    assert tuple(got.first()) == (0, None, None, None, None) and "percentile" not in plan(got)
    with pytest.raises(ValueError, match="unknown scatter"):
        galaxies.scatter(spark.range(1), "globe")


def test_cache_knows_its_input(spark):
    built = []

    def bundle(points):
        built.append(1)
        return dict.fromkeys(tables.PARTS, points)

    def origin(points, scaler=None):
        return tables.Cache(spark, folder(spark, "inputs"), tables.Settings(cache_mode="prefer-cache"), [points, scaler]).resolve(lambda: bundle(points))[1]

    rows = [(1, 2.0, "a", {"k": 1}), (2, None, "b", None), (2, None, "b", None)]
    schema = "id bigint, x double, s string, m map<string,int>"
    one = spark.createDataFrame(rows, schema)
    assert [origin(one), origin(one), origin(one.orderBy(F.desc("id")).repartition(3).select("m", "s", "x", "id"))] == ["built", "cache", "cache"]
    for other in (rows[:2], [*rows[:2], (2, None, "b ", None)], [(1, None, "a", {"k": 1}), (2, 2.0, "b", None), (2, None, "b", None)], [(1, 2.0, "a", {"k": 2}), *rows[1:]]):
        assert origin(spark.createDataFrame(other, schema)) == "built"
    assert origin(one.withColumn("x", F.col("x").cast("float"))) == "built"
    assert [origin(one, {"f": (1.0, 0.0, 1.0)}), origin(one, {"f": (1.0, 0.0, 1.0)}), origin(one, {"f": (2.0, 0.0, 1.0)})] == ["built", "cache", "built"]
    assert tables.content_of(one.limit(0)) != tables.content_of(one)


def test_the_mass_cut_reaches_the_graph(spark):
    r = np.random.default_rng(3)
    rows = [(i % 70, float(a), float(b), 0.02 + i * 1e-5, "GALAXY", 0, 30.0, 8.5 + (i % 10) / 5, 1) for i, (a, b) in enumerate(zip(r.uniform(0, 3, 80), r.uniform(0, 3, 80)))]
    sky = spark.createDataFrame(rows, "targetid bigint, ra double, dec_deg double, z double, spectype string, zwarn int, deltachi2 double, logmstar double, bgs_target int")
    for cut in (9.0, 9.7):
        made = graph_run.bundle_of_catalogue(sky, tables.Settings(log_mass=cut, radius=3.0))
        ids = sorted(x.id for x in made["nodes"].collect())
        assert ids == list(range(sum(x[7] >= cut for x in rows))) and made["features"].count() == len(ids)
        assert {i for e in made["edges"].collect() for i in (e.src, e.dst)} <= set(ids) and made["edges"].count() > 0


def test_places_and_pixels_cost_no_shuffle_and_are_worked_out_once(spark, streams):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = tables.read_placed(spark, streams[0])
        assert "BroadcastHashJoin" in plan(placed) and "hashpartitioning" not in plan(placed) and placed.count() == 60
        sky = spark.range(50).select(F.col("id").alias("targetid"), (F.col("id") * 7.0).alias("ra"), (F.col("id") - 25.0).alias("dec_deg"))
        pixels = lambda nside: catalog.with_pixel(sky, nside)._jdf.queryExecution().optimizedPlan().toString().count("SIN(")
        assert pixels(4) == pixels(64)
        photometry = catalog.with_pixel(sky).select("targetid", F.col("hpx").cast("int").alias("hpx"), F.lit("PSF").alias("type"))
        got = catalog.with_photometry(sky, spark.createDataFrame(photometry.collect(), photometry.schema))
        assert "SIN(" not in got._jdf.queryExecution().optimizedPlan().toString() and got.where("type = 'PSF'").count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fits_products_are_folders_of_files_in_order(spark, tmp_path):
    from skygraph.sources import fits

    rows = spark.range(400).select(F.col("id").alias("targetid"), F.lit("main").alias("survey"), F.lit("dark").alias("program"), (F.col("id") * 0.9).alias("ra"), (F.col("id") % 90).cast("double").alias("dec_deg"), F.lit(0.02).alias("z"), F.lit("GALAXY").alias("spectype"), (F.col("id") * 2).alias("mass"), F.lit(1.5).alias("line"))
    fits.write(rows.repartition(3, "targetid"), f"{tmp_path}/dark", units={"METADATA": rows.columns[:7], "SPECPHOT": ["mass"], "FASTSPEC": ["line"]})
    fits.write(rows.select("targetid", "survey", "program", F.col("z").alias("z_zcat"), F.col("spectype").alias("spectype_zcat"), (F.col("targetid") % 4 > 0).alias("zcat_primary")), f"{tmp_path}/flags")
    told = catalog.run_assembly(spark, fits.find(f"{tmp_path}/dark"), f"{tmp_path}/flags", f"{tmp_path}/no", None, f"{tmp_path}/out", form="fits")
    assert sorted(map(tuple, told.collect())) == [("base", 400, "400"), ("phot", 300, "300"), ("zflags", 300, "300")]
    ids = [r.targetid for f in fits.find(f"{tmp_path}/out/phot") for r in fits.read(spark, f).collect()]
    assert ids == [i for i in range(400) if i % 4] and fits.find(f"{tmp_path}/out") == []
