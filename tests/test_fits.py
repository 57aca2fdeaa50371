"""FITS tables: what is written is read, by byte ranges, columns, units and filters; errors; failed writes."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygraph.sources import fits

SCHEMA = "flag boolean, small tinyint, short smallint, number int, long bigint, f float, d double, name string, three array<double>, two array<int>"
ROWS = [
    (True, -128, 1, 2, 3, 0.5, 0.25, "GALAXY", [1.0, 2.0, float("nan")], [1, -2]),
    (False, 127, -32767, -(2**31) + 1, 2**62, -1.5, float("inf"), "", [0.0] * 3, [3, 4]),
    (None, 5, None, None, None, None, None, None, [9.0] * 3, [5, 6]),
    (True, 0, 7, 8, -9, float("nan"), float("nan"), "naïve ☆", [1e300] * 3, [7, 8]),
]


def told(rows):
    """Rows to compare: NaN as text; a null float reads back as NaN."""
    f = lambda x: [f(y) for y in x] if isinstance(x, list) else "nan" if x is None or (isinstance(x, float) and math.isnan(x)) else x
    return sorted([tuple(f(x) for x in r) for r in rows], key=str)


@pytest.mark.parametrize("where", ("one.fits", "folder"))
def test_round_trip(spark, tmp_path, where):
    df = spark.createDataFrame(ROWS * 50, SCHEMA).repartition(3)
    path = f"file://{tmp_path}/{where}"
    fits.write(df, path, unit="FASTSPEC", keywords={"FILENSID": 4, "SPECPROD": "it's", "SCALE": 1.5, "DONE": True})
    files = [path] if where.endswith(".fits") else fits.find(path)
    assert len(files) == (1 if where.endswith(".fits") else 3) and all(os.path.getsize(f[7:]) % 2880 == 0 for f in files)
    got = fits.read(spark, *files)
    assert got.schema.simpleString() == df.schema.simpleString()
    assert told(map(tuple, got.collect())) == told(ROWS * 50)
    head = fits.header(files[0], "fastspec")
    assert (head["FILENSID"], head["SPECPROD"], head["SCALE"], head["DONE"]) == (4, "it's", 1.5, True)
    # nulls of integers, strings and logicals stay nulls
    assert got.where("flag is null and short is null and number is null and long is null and name is null").count() == 50
    assert got.where("name = ''").count() == 50
    # written again: fewer rows, none of the old
    fits.write(df.limit(2), path)
    assert fits.read(spark, *([path] if where.endswith(".fits") else fits.find(path))).count() == 2
    assert [x for x in os.listdir(tmp_path) if "_parts" in x or ".new" in x] == []
    with pytest.raises(Exception, match="FileExists|one.fits|folder"):
        fits.write(df, path, overwrite=False)


def test_a_file_by_the_format_alone(spark, tmp_path):
    """Bytes laid down by hand: big-endian cells, an image before the table, offsets, scaling and nulls."""
    cards = lambda *x: fits.block(list(x))
    image = cards(fits.card("XTENSION", "IMAGE"), fits.card("BITPIX", -32), fits.card("NAXIS", 2), fits.card("NAXIS1", 30), fits.card("NAXIS2", 40), fits.card("PCOUNT", 0), fits.card("GCOUNT", 1)) + b"\1" * 4800 + b"\0" * 960
    kinds = [("ID", "1K"), ("Z", "E"), ("U", "1J"), ("S", "1I"), ("B", "1B"), ("NAME", "6A"), ("XY", "2D"), ("C", "1C")]
    head = cards(fits.card("XTENSION", "BINTABLE"), fits.card("BITPIX", 8), fits.card("NAXIS", 2), fits.card("NAXIS1", 8 + 4 + 4 + 2 + 1 + 6 + 16 + 8), fits.card("NAXIS2", 3), fits.card("PCOUNT", 0), fits.card("GCOUNT", 1), fits.card("TFIELDS", 8), *[c for i, (n, k) in enumerate(kinds, 1) for c in (fits.card(f"TTYPE{i}", n, "a / comment"), fits.card(f"TFORM{i}", k))], fits.card("TZERO3", 2147483648), fits.card("TSCAL4", 0.5), fits.card("TZERO4", 10.0), fits.card("TNULL5", 255), fits.card("EXTNAME", "METADATA"), "COMMENT = nothing".ljust(80))
    rows = np.zeros(3, dtype=[("ID", ">i8"), ("Z", ">f4"), ("U", ">i4"), ("S", ">i2"), ("B", "u1"), ("NAME", "S6"), ("XY", ">f8", (2,)), ("C", "V8")])
    rows["ID"], rows["Z"], rows["U"], rows["S"], rows["B"], rows["NAME"], rows["XY"] = [1, -2, 2**60], [0.5, np.nan, 2], [-(2**31), 0, 2**31 - 1], [1, 2, -3], [0, 255, 7], [b"STAR  ", b"", b"GALAXY"], [[1, 2], [3, 4], [5, 6]]
    data = rows.tobytes()
    (tmp_path / "hand.fits").write_bytes(fits.PRIMARY + image + head + data + b"\0" * (-len(data) % 2880))
    got = [tuple(r) for r in fits.read(spark, f"{tmp_path}/hand.fits", units="METADATA", columns=["name", "ID", "U", "S", "B", "XY"]).collect()]
    assert got == [(1, 0, 10.5, 0, "STAR", [1.0, 2.0]), (-2, 2**31, 11.0, None, None, [3.0, 4.0]), (2**60, 2**32 - 1, 8.5, 7, "GALAXY", [5.0, 6.0])]
    for bad, match in (({"columns": ["NONE"]}, "no such columns"), ({"columns": ["C"]}, "isn't read"), ({"units": "OTHER"}, "no table")):
        with pytest.raises(Exception, match=match):
            fits.read(spark, f"{tmp_path}/hand.fits", **bad).collect()
    with pytest.raises(Exception, match="no FITS file|ends within"):
        (tmp_path / "bad.fits").write_bytes(b"x" * 5000)
        fits.read(spark, f"{tmp_path}/bad.fits").collect()


def test_row_ranges_files_and_drift(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") * 2).cast("int").alias("twice"))
    fits.write(df, f"{tmp_path}/a.fits", order=["id"])
    fits.write(df.select("id", F.lit("x").alias("only_b")), f"{tmp_path}/b.fits", order=["id"])
    got = fits.read(spark, f"{tmp_path}/a.fits", f"{tmp_path}/b.fits", row_id=True, partition_bytes=1200)
    assert got.rdd.getNumPartitions() == 10 + 8 and got.columns == ["file_name", "row_index", "id", "twice", "only_b"]
    assert got.where("row_index <> id").count() == 0 and got.where("only_b = 'x' and twice is null").count() == 1000
    assert fits.find(f"{tmp_path}", "?.fits") == [f"{tmp_path}/a.fits", f"{tmp_path}/b.fits"] and fits.find(f"{tmp_path}/none") == []
    fits.write(df.select(F.col("id").cast("string")), f"{tmp_path}/c.fits")
    with pytest.raises(Exception, match="two types"):
        fits.read(spark, f"{tmp_path}/a.fits", f"{tmp_path}/c.fits").collect()
    fits.write(df.limit(0), f"{tmp_path}/empty.fits")
    assert fits.read(spark, f"{tmp_path}/empty.fits").collect() == []
    fits.write(df.limit(0), f"{tmp_path}/empty")
    assert fits.read(spark, *fits.find(f"{tmp_path}/empty")).collect() == []


def test_units_side_by_side_by_position(spark, tmp_path):
    # keys repeat, so rows can only be told by their places
    df = spark.range(500).select("id", (F.col("id") % 7).alias("targetid"), (F.col("id") * 3).alias("mass"), F.concat(F.lit("n"), "id").alias("line"))
    for name, column in (("METADATA", "targetid"), ("SPECPHOT", "mass"), ("FASTSPEC", "line")):
        fits.write(df.orderBy("id").select(column), f"{tmp_path}/{name}.fits", unit=name)
    fits.join_units(f"{tmp_path}/all.fits", [f"{tmp_path}/{n}.fits" for n in ("METADATA", "SPECPHOT", "FASTSPEC")])
    assert [u.name for u in fits.units(f"{tmp_path}/all.fits")] == ["", "METADATA", "SPECPHOT", "FASTSPEC"]
    got = fits.read(spark, f"{tmp_path}/all.fits", units={"METADATA": None, "SPECPHOT": ["mass"], "FASTSPEC": ["line"]}, row_id=True, partition_bytes=700)
    assert "Exchange" not in got._jdf.queryExecution().toString() and "Join" not in got._jdf.queryExecution().toString()
    assert sorted((r.row_index, r.targetid, r.mass, r.line) for r in got.collect()) == [(i, i % 7, 3 * i, f"n{i}") for i in range(500)]
    fits.write(df.limit(3).select("mass"), f"{tmp_path}/short.fits", unit="SPECPHOT")
    fits.join_units(f"{tmp_path}/uneven.fits", [f"{tmp_path}/METADATA.fits", f"{tmp_path}/short.fits"])
    with pytest.raises(Exception, match="differ in rows"):
        fits.read(spark, f"{tmp_path}/uneven.fits", units={"METADATA": None, "SPECPHOT": None}).collect()
    with pytest.raises(Exception, match="more than one table"):
        fits.join_units(f"{tmp_path}/twice.fits", [f"{tmp_path}/METADATA.fits"] * 2)
        fits.read(spark, f"{tmp_path}/twice.fits", units={"METADATA": None, "metadata": None}).collect()


def test_filters_compare_as_spark_does(spark, tmp_path):
    nan = float("nan")
    rows = [(i, [None, nan, 0.5, 1.5, -2.0][i % 5], ["GALAXY", "STAR", None, ""][i % 4], i % 3 == 0) for i in range(400)]
    fits.write(spark.createDataFrame(rows, "id int, z double, kind string, ok boolean"), f"{tmp_path}/f.fits")
    plain = fits.read(spark, f"{tmp_path}/f.fits").cache()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for where in ("z >= 0.5", "z > 0.5", "z < 1.5", "z <= 0.5 and kind = 'GALAXY'", "kind is null", "kind is not null and id > 17", "id in (3, 5, 7)", "ok", "not ok", "z = 0.5", "z between -3 and 1 and kind = 'STAR'", "kind like 'G%'", "id = 100000"):
            got = fits.read(spark, f"{tmp_path}/f.fits", partition_bytes=1500).where(where)
            assert sorted(r.id for r in got.collect()) == sorted(r.id for r in plain.where(where).collect()), where
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
        plain.unpersist()


def test_only_asked_columns_are_decoded(tmp_path, spark, monkeypatch):
    fits.write(spark.range(50).select("id", F.lit("x").alias("a"), F.lit(1.0).alias("b")), f"{tmp_path}/p.fits")
    seen = []
    whole = fits.decode
    monkeypatch.setattr(fits, "decode", lambda c, raw: (seen.append((c.name, len(raw))), whole(c, raw))[1])
    layout = {"paths": f'["{tmp_path}/p.fits"]', "units": '[[null, ["id", "b"]]]'}
    reader = fits.FilteringReader(layout, fits.Layout(layout).schema())
    reader.pushFilters([fits.ds.LessThan(("id",), 4)])
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert seen == [("id", 50), ("b", 4)] and sum(b.num_rows for b in batches) == 4


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.range(0, 100, 1, 4).withColumn("bad", F.when(F.col("id") == 77, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.lit(1)))
    fits.write(spark.range(5), f"{tmp_path}/kept.fits")
    layout = '[["id", "K", 1, 0, null, 1, 0], ["bad", "J", 1, 8, null, 1, 0]]'
    for path in ("kept.fits", "new"):
        with pytest.raises(Exception, match="lost"):
            df.write.format("fits").options(path=f"{tmp_path}/{path}", layout=layout).mode("overwrite").save()
    assert os.listdir(tmp_path) == ["kept.fits"] and fits.read(spark, f"{tmp_path}/kept.fits").count() == 5
    smallest = spark.createDataFrame([(-(2**31),), (None,)], "a int")
    with pytest.raises(Exception, match="stands for null"):
        fits.write(smallest, f"{tmp_path}/null.fits")
    for kind in ("array<string>", "date", "struct<a:int>", "decimal(5,2)"):
        with pytest.raises(ValueError, match="no place"):
            fits.write(spark.createDataFrame([], f"a {kind}"), f"{tmp_path}/no.fits")
    with pytest.raises(ValueError, match="1 to 2 elements"):
        fits.write(spark.createDataFrame([([1],), ([1, 2],)], "a array<int>"), f"{tmp_path}/no.fits")
    assert os.listdir(tmp_path) == ["kept.fits"]


def test_units_of_one_write_stand_side_by_side(spark, tmp_path):
    df = spark.range(900).select("id", (F.col("id") % 7).alias("targetid"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("n"), F.col("id") % 3)).alias("line"))
    units = {"METADATA": ["targetid", "id"], "FASTSPEC": ["line"]}
    fits.write(df.repartition(4, "id"), f"{tmp_path}/many", units=units, keywords={"RUN": 3})
    files = fits.find(f"{tmp_path}/many")
    assert len(files) == 4 and [u.name for u in fits.units(files[0])] == ["", "METADATA", "FASTSPEC"] and fits.header(files[1], "FASTSPEC")["RUN"] == 3
    got = fits.read(spark, *files, units=dict.fromkeys(units))
    assert sorted(map(tuple, got.select("id", "targetid", "line").collect())) == sorted((i, i % 7, f"n{i % 3}" if i % 5 else None) for i in range(900))
    fits.write(df.limit(0), f"{tmp_path}/none", units=units)
    assert fits.read(spark, *fits.find(f"{tmp_path}/none"), units=dict.fromkeys(units)).collect() == []
    with pytest.raises(Exception, match="several units"):
        fits.write(df, f"{tmp_path}/one.fits", units=units)


def test_ascii_strings_keep_nulls_and_empty_ones(spark, tmp_path):
    rows = [(i, [None, "", "a", "GALAXY", " x", "tail  "][i % 6]) for i in range(60)]
    fits.write(spark.createDataFrame(rows, "id int, s string").repartition(2), f"{tmp_path}/s.fits")
    assert sorted(map(tuple, fits.read(spark, f"{tmp_path}/s.fits").collect())) == [(i, s and s.rstrip()) for i, s in rows]
    fits.write(spark.createDataFrame([(1, None)], "id int, s string"), f"{tmp_path}/n.fits")
    assert [tuple(r) for r in fits.read(spark, f"{tmp_path}/n.fits").collect()] == [(1, None)]


def test_a_file_for_each_value_by_one_job(spark, tmp_path):
    from skygraph.operators import catalog
    from skygraph.plans import catalogue_queries

    folder = f"{tmp_path}/pixels"
    rows = spark.range(3000).select(F.col("id").alias("targetid"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("t"), F.col("id") % 101)).alias("type"), (F.col("id") % 37).cast("int").alias("hpx"))
    for _ in range(2):
        fits.write_each(rows, folder, "hpx", "tractorphot-nside4-hp{:03d}-loa.fits", unit="TRACTORPHOT", keywords={"FILENSID": 4})
    assert fits.find(folder) == [f"{folder}/tractorphot-nside4-hp{i:03d}-loa.fits" for i in range(37)] and os.listdir(tmp_path) == ["pixels"]
    one = fits.read(spark, fits.find(folder)[5], units="TRACTORPHOT").collect()
    assert sorted(map(tuple, one)) == [(i, f"t{i % 101}" if i % 4 else None) for i in range(5, 3000, 37)]
    # all pixels are written and read, and those without a file give no rows
    sky = spark.range(4000).select((F.col("id") * 0.09).alias("ra"), (F.col("id") % 180 - 90.0).alias("dec_deg"))
    assert sorted(map(tuple, catalog.read_pixel_files(spark, folder, sky, "loa").select("targetid", "hpx").collect())) == [(i, i % 37) for i in range(3000)]
    with pytest.raises(ValueError, match="without a value"):
        fits.write_each(rows.withColumn("hpx", F.lit(None).cast("int")), folder, "hpx", "{}.fits")
    made = catalogue_queries._fits_pixel_files(spark, "/root/testdata/sf0.001")
    whole = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").join(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey")).count()
    assert fits.read(spark, *fits.find(made), units="TRACTORPHOT").count() == whole
    assert "hpx % " not in catalogue_queries.ORACLES["fits_assembly"]
