"""Catalogue assembly: selection, row-aligned stitching, flag and photometry joins, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skygraph.functions.sphere import healpix_nested
from skygraph.sources import fits, tables

JOIN_KEYS = ["targetid", "survey", "program"]


def is_galaxy_in(z_min: float, z_max: float, spectype: str = "spectype", z: str = "z") -> Column:
    """A galaxy with a redshift in the closed range; NaN lies above every bound. Strings are trimmed at ingest, so this is pushed to the scan."""
    return (F.col(spectype) == "GALAXY") & F.col(z).between(z_min, z_max)


def select_rows(df: DataFrame, z_min: float = 0.01, z_max: float = 0.06, spectype: str = "spectype", z: str = "z") -> DataFrame:
    return df.where(is_galaxy_in(z_min, z_max, spectype, z))


def selected_counts(df: DataFrame, by: str | None = None, z_min: float = 0.01, z_max: float = 0.06) -> DataFrame:
    """How many rows the selection keeps, over all or by a column such as the file's name."""
    chosen = F.count_if(is_galaxy_in(z_min, z_max)).alias("n_selected")
    return df.groupBy(by).agg(chosen) if by else df.agg(chosen)


def keep_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in the table's own order; a missing one is an error."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*[c for c in df.columns if c in set(names)])


def stitch(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Side by side by row key; names must differ apart from the keys."""
    names = [c for t in parts for c in t.columns if c not in keys]
    if twice := {c for c in names if names.count(c) > 1}:
        raise ValueError(f"columns stand in more than one table: {sorted(twice)}")
    return reduce(lambda a, b: a.join(b, keys), parts)


def union_catalogues(parts: list[DataFrame]) -> DataFrame:
    """All rows, with the union of the columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def attach_flags(base: DataFrame, flags: DataFrame, keys: list[str] = JOIN_KEYS) -> DataFrame:
    """Left join; rows without flags stay, rows with several come several times."""
    return base.join(flags, keys, "left")


def primary_only(joined: DataFrame, flag: str = "zcat_primary") -> DataFrame:
    """Rows whose flag is true: unmatched ones go, so the join before becomes an inner one."""
    return joined.where(F.col(flag))


def with_pixel(df: DataFrame, nside: int = 4, ra: str = "ra", dec: str = "dec_deg", name: str = "hpx") -> DataFrame:
    return df.withColumn(name, healpix_nested(nside, F.col(ra), F.col(dec)))


def distinct_pixels(df: DataFrame, pixel: str = "hpx") -> DataFrame:
    return df.select(pixel).distinct().orderBy(pixel)


def photometry_rows(photometry: DataFrame, catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """Photometry of targets of the same pixel; with photometry partitioned by pixel only the pixels needed are read."""
    return photometry.join(catalogue.select(*keys), keys, "left_semi")


def attach_photometry(base: DataFrame, photometry: DataFrame | None, key: str = "targetid") -> DataFrame:
    """Left join that may fan out; no photometry leaves the columns as they are."""
    return base if photometry is None else base.join(photometry, key, "left")


# The columns that the products keep of the flag and photometry tables, as far as these have them.
FLAG_COLUMNS = ("targetid", "survey", "program", "desiname", "morphtype", "main_primary", "sv_primary", "zcat_nspec", "zcat_primary")
PHOTOMETRY_COLUMNS = ("targetid", "type", "fracflux_g", "fracflux_r", "fracflux_z", "shape_r", "shape_e1", "shape_e2", "shape_r_ivar", "shape_e1_ivar", "shape_e2_ivar", "sersic", "sersic_ivar")


def pixel_name(pixel: str = "hpx") -> Column:
    """hp and the pixel in three digits, as in names of files."""
    return F.format_string("hp%03d", F.col(pixel))


def _known(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return keep_columns(df, [n for n in names if n in df.columns])


def with_flags(base: DataFrame, flags: DataFrame, z_min: float = 0.01, z_max: float = 0.06) -> DataFrame:
    """The second product: rows with a primary flag, of flags cut by the same redshift range."""
    told = select_rows(flags, z_min, z_max, *[c for c in ("spectype_zcat", "z_zcat") if c in flags.columns])
    return primary_only(attach_flags(base, _known(told, FLAG_COLUMNS)))


def in_pixels_of(photometry: DataFrame, catalogue: DataFrame, most: int = 12 * 64 * 64) -> DataFrame:
    """Photometry of the pixels that the catalogue stands in: with files or folders a pixel no others are read.

    The distinct pixels (``hpx``, at most 12 nside^2 of them) become a filter on the partitions. Grids with more than ``most`` pixels would make
    too long a filter; there a semi-join leaves the choice to pruning at run time, with the same rows.
    """
    pixels = catalogue.select("hpx").distinct()
    found = [r.hpx for r in pixels.limit(most + 1).collect()]
    return photometry.where(F.col("hpx").isin(found)) if len(found) <= most else photometry.join(pixels.where(F.col("hpx").isNotNull()), "hpx", "left_semi")


def with_photometry(zflags: DataFrame, photometry: DataFrame | None, nside: int = 4) -> DataFrame:
    """The third product: rows of a target in another pixel (``hpx``, NESTED, ``nside``) aren't its own; without photometry the columns stay as they are."""
    if photometry is not None:
        # written: joins put a filter on their keys below the step that makes the pixel, and would work it out again there, some 20 microseconds a row
        targets = tables.save_temporary(with_pixel(zflags, nside).select("hpx", "targetid"))
        photometry = _known(photometry_rows(in_pixels_of(photometry, targets), targets, ["hpx", "targetid"]), PHOTOMETRY_COLUMNS)
    return attach_photometry(zflags, photometry)


def assemble(metadata: DataFrame, photometry_of: DataFrame, flags: DataFrame, photometry: DataFrame | None, *, z_min: float = 0.01, z_max: float = 0.06, row_keys: list[str], nside: int = 4) -> dict[str, DataFrame]:
    """The three products as plans: base (selected and stitched by ``row_keys``), zflags (primary rows), phot (with photometry).

    A target may be observed several times, so its id is no row key: use the rows' places (``tables.read_placed``).
    """
    base = stitch([select_rows(metadata, z_min, z_max), photometry_of], row_keys).drop(*[k for k in row_keys if k in tables.PLACE])
    zflags = with_flags(base, flags, z_min, z_max)
    return {"base": base, "zflags": zflags, "phot": with_photometry(zflags, photometry, nside)}


# The units of a sub-catalogue's file and the one of the photometry, and its keyword for the grid.
UNITS = ("METADATA", "SPECPHOT", "FASTSPEC")
PHOTOMETRY_UNIT, NSIDE_KEYWORD = "TRACTORPHOT", "FILENSID"


def stitched_rows(spark: SparkSession, catalogues: list[str], others: list[list[str]] = (), columns: list[list[str] | None] | None = None, z_min: float = 0.01, z_max: float = 0.06) -> DataFrame:
    """The selected rows of all sub-catalogues, the streams side by side by the position of their rows.

    FITS files hold their streams as units; a task reads the same rows of each, so nothing is joined. Parquet sub-catalogues have the first
    stream in ``catalogues`` and one list of paths in ``others`` for each further stream; they are joined by place. ``columns``:
    of each stream those kept.
    """
    columns = columns or [None] * (len(UNITS) if catalogues[0].endswith(".fits") else 1 + len(others))
    if catalogues[0].endswith(".fits"):
        return select_rows(fits.read(spark, *catalogues, units=dict(zip(UNITS, columns))), z_min, z_max)
    streams = [tables.read_placed(spark, list(p), c) for p, c in zip([catalogues, *others], columns)]
    return stitch([select_rows(streams[0], z_min, z_max), *streams[1:]], tables.PLACE).drop(*tables.PLACE)


def read_pixel_files(spark: SparkSession, folder: str, catalogue: DataFrame, specprod: str) -> DataFrame | None:
    """Photometry from FITS files a pixel, of the catalogue's pixels that have a file, with ``hpx``; None if the folder has no file at all.

    The grid is a keyword of the first file. Pixels without a file give no rows.
    """
    there = fits.find(folder, f"tractorphot-nside*-hp???-{specprod}.fits")
    if not there:
        return None
    nside = int(fits.header(there[0], PHOTOMETRY_UNIT)[NSIDE_KEYWORD])
    wanted = {f"hp{r.hpx:03d}" for r in with_pixel(catalogue, nside).select("hpx").distinct().collect()}  # at most 12 nside^2
    files = [f for f in there if f.rsplit("-", 2)[1] in wanted]
    rows = fits.read(spark, *(files or there[:1]), units=PHOTOMETRY_UNIT, row_id=True)
    pixel = F.regexp_extract("file_name", r"-hp(\d+)-[^/]*$", 1).cast("int")
    return (rows if files else rows.limit(0)).withColumn("hpx", pixel).drop("file_name", "row_index")


def run_assembly(spark: SparkSession, catalogues: list[str], flags: str, photometry: str, properties: str | None, out: str, *, second: list[str] = (), third: list[str] = (), columns: list[list[str] | None] | None = None, z_min: float = 0.01, z_max: float = 0.06, specprod: str = "loa", form: str = "parquet") -> DataFrame:
    """Read, assemble and write the three products under ``out``, each sorted by the join keys; (product, n, n_text) of what was written.

    ``catalogues``: one path a sub-catalogue, FITS files of three units, or Parquet with the further streams in ``second`` and ``third``, whose rows
    stand at the same places. ``photometry``: a folder with a file or folder a pixel, of which any may be missing; its grid is a
    keyword of the files (FITS) or a row of ``properties``. ``flags``: a FITS file, a folder of them, or Parquet. ``form``: parquet, or fits (a folder
    of files each, in order by name, so that nothing is joined in the driver's process). Each product is made from the one
    before as it was written, so no scan or join runs twice. Counts are observed while the rows are written.
    """
    counts = []

    def product(name: str, df: DataFrame) -> DataFrame:
        seen, counted = Observation(name), F.count(F.lit(1)).alias("n")
        order = [k for k in JOIN_KEYS if k in df.columns]
        path = f"{out.rstrip('/')}/{name}"
        if form == "fits":
            # the widths of strings are asked of the table as it is written first; it is sorted on its way from there
            tables.write(df.observe(seen, counted), f"{path}-rows")
            fits.write(spark.read.parquet(f"{path}-rows"), path, unit="CATALOG", order=order)
            tables.delete(spark, f"{path}-rows")
        else:
            # observed above the sort, whose sampling reads what is below it a second time
            tables.write(df.orderBy(*order).observe(seen, counted), path)
        counts.append((name, seen.get["n"]))
        return fits.read(spark, *fits.find(path)) if form == "fits" else spark.read.parquet(path)

    files = [flags] if flags.endswith(".fits") else fits.find(flags)
    told = fits.read(spark, *files) if files else tables.read(spark, flags)
    base = product("base", stitched_rows(spark, list(catalogues), [p for p in (second, third) if p], columns, z_min, z_max))
    zflags = product("zflags", with_flags(base, told, z_min, z_max))
    if catalogues[0].endswith(".fits"):
        phot = read_pixel_files(spark, photometry, zflags, specprod)
        nside = int(fits.header(fits.find(photometry, f"tractorphot-nside*-hp???-{specprod}.fits")[0], PHOTOMETRY_UNIT)[NSIDE_KEYWORD]) if phot is not None else 4
    else:
        phot = tables.read_partitioned(spark, photometry)
        nside = int(tables.read_property(spark, properties, "nside")) if phot is not None else 4
    product("phot", with_photometry(zflags, phot, nside))
    return spark.createDataFrame(counts, "product string, n bigint").withColumn("n_text", F.format_number("n", 0))
