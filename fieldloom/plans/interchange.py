"""Queries that go through files: what one stage writes to the shared folder, the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.calendar import in_season
from fieldloom.operators import bmu, nodes
from fieldloom.plans import catalog
from fieldloom.plans.catalog import BMU_SQL, CUBE_SQL, FIELDS_SQL
from fieldloom.plans.registry import query
from fieldloom.sources import files, gridded, netcdf, saved, sinks, synthetic


def _runs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments of three runs, named as files are."""
    run = F.concat(F.lit("bmu_"), F.lit("4x4_oct_mar_seed"), (F.col("t") % 3).cast("string"))
    x = catalog.fields(spark, sf_dir).select(run.alias("run_id"), F.floor(F.col("t") / 3).alias("t"), "node_i", "node_j")
    return x


@query("SELECT '4x4' AS grid, CAST(vec_id % 3 AS INTEGER) AS seed, CAST(vec_id // 3 AS BIGINT) AS t, CAST(label // 4 AS INTEGER) AS node_i, CAST(label % 4 AS INTEGER) AS node_j FROM embeddings")
def run_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of runs, written and scanned again; what the file names say becomes columns."""
    path = sinks.scratch(spark, "runs")
    sinks.write_npy(_runs_of(spark, sf_dir), path)
    return files.name_parts(files.read_bmus(spark, path), "path").select("grid", "seed", "t", "node_i", "node_j")


def _label_runs(spark: SparkSession, sf_dir: str, path: str) -> list[int]:
    """A run's folder for each label, with the assignments of its fields and, for labels that 3 does not divide, a configuration with the map's
    size under either of its keys. The labels, as many as nodes at most, come back."""
    x = catalog.fields(spark, sf_dir).select(F.concat(F.lit("run"), F.col("node").cast("string"), F.lit("/BMUs")).alias("run_id"), "t", "node", "node_i", "node_j")
    sinks.write_npy(x, path)
    labels = sorted(r[0] for r in x.select("node").distinct().limit(catalog.MAP_ROWS * catalog.MAP_COLUMNS).collect())
    for k in labels:
        if k % 3:
            sinks.write_config({"grid" if k % 2 else "grid_size": [4, 4 + k % 2], "seed": k} | ({"bmu_metric": "ssim"} if k > 4 else {}), f"{path}/run{k}")
    return labels


@query("SELECT 'run' || CAST(label AS VARCHAR) AS run_id, count(*) AS n FROM embeddings WHERE label % 3 > 0 GROUP BY label")
def complete_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that hold all the files of a run, with the length of its array; a folder that does not exist is skipped."""
    path = sinks.scratch(spark, "folders")
    _label_runs(spark, sf_dir, path)
    found = files.present_folders(spark, [path, f"{path}-none"])
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(found).select("path")
    done = files.complete_directories(listed, ("BMUs.npy", "config.json")).withColumn("path", F.concat("directory", F.lit("/BMUs.npy")))
    return files.read_bmus(spark, path).join(done, "path").groupBy(F.substring_index("directory", "/", -1).alias("run_id")).agg(F.count("*").alias("n"))


@query("SELECT CAST(label AS INTEGER) AS seed, CAST(4 AS INTEGER) AS rows, CAST(4 + label % 2 AS INTEGER) AS columns, CASE WHEN label > 4 THEN 'ssim' END AS bmu_metric, count(*) AS n FROM embeddings WHERE label % 3 > 0 GROUP BY label")
def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their configurations, the map's size under either of its keys, and how many fields they assign."""
    path = sinks.scratch(spark, "configs")
    _label_runs(spark, sf_dir, path)
    listed = saved.in_folders(spark, path)
    # no names of runs go through the driver: all arrays are read, and joined with those of complete runs
    n = files.npy_rows(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", saved.ARRAY).load(path).select(F.col("_metadata.file_path").alias("path"), "content"))
    return listed.join(n.groupBy("path").agg(F.count("*").alias("n")), "path").select("seed", "rows", "columns", F.col("training_metric").alias("bmu_metric"), "n")


@query("SELECT * FROM (VALUES " + ", ".join(f"({y}, CAST({o} AS DOUBLE), '{p}')" for y, o, p in catalog.PHASES) + ") AS p(season_year, oni, phase)")
def phase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of phases as CSV, in UTF-8."""
    path = sinks.scratch(spark, "phases")
    x = catalog.phases(spark).withColumn("label_year", F.col("season_year") + 1)
    sinks.write_csv(x.select("season_year", "label_year", "oni", "phase"), path)
    return files.read_enso(spark, path).select("season_year", "oni", "phase")


@query("WITH " + CUBE_SQL + "," + BMU_SQL + " SELECT year, month, node_i, node_j, node FROM bmu")
def dated_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments by date as CSV."""
    path = sinks.scratch(spark, "dates")
    x = catalog.bmu(spark, sf_dir).select(F.make_timestamp_ntz("year", "month", F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("fecha"), F.col("node_i").cast("int").alias("nodo_i"), F.col("node_j").cast("int").alias("nodo_j"), F.col("node").cast("int").alias("nodo"))
    sinks.write_csv(x, path)
    return files.read_bmu_dates(spark, path).select("year", "month", "node_i", "node_j", "node")


@query("WITH " + CUBE_SQL + "," + BMU_SQL + " SELECT DISTINCT CAST(node_i AS INTEGER) AS node_i, CAST(node_j AS INTEGER) AS node_j, year, month FROM bmu")
def months_in_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each node, read back with the folders' names as columns."""
    path = sinks.scratch(spark, "months")
    sinks.write_months_by_node(catalog.bmu(spark, sf_dir), path)
    return spark.read.schema("year int, month int, node_i int, node_j int").csv(path, header=True).select("node_i", "node_j", "year", "month")


@query("SELECT CAST(k AS INTEGER) AS attempt, (SELECT count(*) FROM embeddings WHERE label = k) AS n FROM range(3) AS r(k)")
def score_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of three runs, appended one after another."""
    path = sinks.scratch(spark, "history")
    for k in range(3):
        sinks.append_history(catalog.fields(spark, sf_dir).filter(F.col("node") == k).agg(F.lit(k).alias("attempt"), F.count("*").alias("n")), path)
    return sinks.read_history(spark, path)


@query("WITH " + CUBE_SQL + " SELECT count(*) AS n, round(sum(value), 4) AS total FROM cube")
def cached_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube written once under its input's fingerprint and served from there; another input has another file."""
    path = sinks.scratch(spark, "cache")
    sinks.cached(catalog.cube(spark, sf_dir).limit(1), path)
    sinks.cached(catalog.cube(spark, sf_dir), path)
    again = sinks.cached(catalog.cube(spark, sf_dir), path)
    return again.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT CAST(264 AS BIGINT) AS n_times, CAST(949 AS BIGINT) AS n_land, CAST(1040 AS BIGINT) AS n_cells, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high, CAST(198110 AS INTEGER) AS first_month, CAST(202503 AS INTEGER) AS last_month")
def synthetic_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic record as a NetCDF file and back; its published size and range are the answer."""
    path = sinks.scratch(spark, "cube")
    sinks.write_bytes(f"{path}/cube.nc", synthetic.as_netcdf())
    x = files.read_cube(spark, f"{path}/cube.nc")
    label = F.col("year") * 100 + F.col("month")
    by_cell = x.groupBy("iy", "ix").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    cells = by_cell.agg(F.count("*").alias("n_cells"), F.sum((F.col("n") == 264).cast("long")).alias("n_land"), F.round(F.min("low"), 6).alias("low"), F.round(F.max("high"), 6).alias("high"))
    axis = x.agg(F.count_distinct("t").alias("n_times"), F.min(label).alias("first_month"), F.max(label).alias("last_month"))
    return cells.join(axis).select("n_times", "n_land", "n_cells", "low", "high", "first_month", "last_month")


@query("SELECT * FROM (VALUES (0, CAST(75 AS BIGINT)), (1, 55), (2, 38), (3, 41), (4, 33), (5, 22)) AS p(pattern, n)")
def pattern_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each pattern was drawn for the synthetic record; the published counts are the answer."""
    _, drawn = synthetic.generate()
    x = spark.createDataFrame([(int(k),) for k in drawn], "pattern int")
    return x.groupBy("pattern").agg(F.count("*").alias("n"))


@query("WITH " + CUBE_SQL + " SELECT t, year, month, CAST(pixel_id // 5 AS INTEGER) AS iy, CAST(pixel_id % 5 AS INTEGER) AS ix, round(value, 6) AS value FROM cube WHERE pixel_id % 4 <> 0")
def netcdf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube as a NetCDF file with other dimension names and order and a bounds variable, written and scanned slab by slab, with gaps as nulls."""
    import numpy as np

    path = _cube_file(spark, sf_dir, "scan", ("iy", "ix", "t"), {"time_bnds": netcdf.Variable(("two",), np.zeros(2))})
    found = files.read_cube(spark, path).filter("value is not null")
    return found.select(F.col("t").cast("int").alias("t"), "year", "month", "iy", "ix", F.round("value", 6).alias("value"))


def _cube_file(spark: SparkSession, sf_dir: str, name: str, order: tuple[str, str, str] = ("t", "iy", "ix"), more: dict | None = None) -> str:
    """The cube of the given tables as a NetCDF file, with every fourth pixel missing, written by tasks."""
    import numpy as np

    x = catalog.cube(spark, sf_dir).filter("pixel_id % 4 <> 0")
    cells = x.select("t", F.floor(F.col("pixel_id") / 5).cast("int").alias("iy"), (F.col("pixel_id") % 5).alias("ix"), "value")
    n = (cells.agg(F.max("t")).first()[0] or 0) + 1
    v = netcdf.Variable
    axes = {
        "t": ("valid_time", v(("valid_time",), np.arange(n, dtype=float), {"units": "months since 1995-01-01"})),
        "iy": ("lat", v(("lat",), np.arange(5.0))), "ix": ("lon", v(("lon",), np.arange(5.0))),
    }
    path = f"{sinks.scratch(spark, name)}/{name}.nc"
    gridded.write_cube(cells, path, {**dict(axes[k] for k in order), **(more or {})}, "total", order)
    return path


@query("WITH " + CUBE_SQL + " SELECT CAST(t AS BIGINT) AS t, CAST(1995 + t // 12 AS INTEGER) AS year, CAST(1 + t % 12 AS INTEGER) AS month FROM range((SELECT max(t) + 1 FROM cube WHERE pixel_id % 4 <> 0)) AS r(t)")
def time_axis_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time axis of the cube's file alone: its values are not read."""
    return files.read_times(spark, _cube_file(spark, sf_dir, "axis")).select("t", "year", "month")


@query("WITH " + CUBE_SQL + " SELECT CAST(t AS BIGINT) AS t, month, CAST(pixel_id // 5 AS INTEGER) AS iy, CAST(pixel_id % 5 AS INTEGER) AS ix, round(value, 6) AS value FROM cube WHERE pixel_id % 4 <> 0 AND month IN (10, 11, 12, 1, 2, 3)")
def season_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warm season of the cube's file: slabs of other months are left out when the scan is planned."""
    found = files.read_cube(spark, _cube_file(spark, sf_dir, "season"), months="10,11,12,1,2,3").filter("value is not null")
    return found.select("t", "month", "iy", "ix", F.round("value", 6).alias("value"))


_GAPPY = "g AS (SELECT vec_id AS t, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS node FROM embeddings)"


@query(f"WITH {FIELDS_SQL}, proto AS (SELECT node, pos, avg(v) AS w FROM long GROUP BY node, pos), d AS (SELECT t, p.node, sum((v - w) * (v - w)) AS d FROM long JOIN proto p ON p.pos = long.pos GROUP BY t, p.node), b AS (SELECT t, arg_min(node, d) AS node FROM d GROUP BY t) SELECT t, CAST(CASE WHEN t % 7 = 0 THEN -1 ELSE node END AS INTEGER) AS node FROM b")
def bmu_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest prototypes by squared distance; fields with a gap are unassigned."""
    x = catalog.fields(spark, sf_dir)
    gap = F.when(F.col("t") % 7 == 0, F.transform("vec", lambda v, k: F.when(k != 3, v))).otherwise(F.col("vec"))
    return bmu.assign(x.withColumn("vec", gap), bmu.prototypes_of(x), "squared_euclidean").select("t", "node")


@query(f"WITH {_GAPPY} SELECT CAST(n AS INTEGER) AS node, count(t) AS n FROM range(16) AS r(n) LEFT JOIN g ON g.node = n GROUP BY ALL")
def unassigned_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = catalog.fields(spark, sf_dir)
    off = F.col("t") % 7 == 0
    x = x.withColumn("node_i", F.when(off, -1).otherwise(F.col("node_i"))).withColumn("node_j", F.when(off, -1).otherwise(F.col("node_j")))
    return nodes.dense_counts(x, catalog.MAP_ROWS, catalog.MAP_COLUMNS).select("node", "n")


@query(f"WITH {FIELDS_SQL}, f AS (SELECT t, node, pos, CASE WHEN t % 10 = 0 THEN 0.25 ELSE v END AS v FROM long), proto AS (SELECT node, pos, avg(v) AS w FROM long GROUP BY node, pos), m AS (SELECT t, any_value(f.node) AS node, avg(v) AS mx, avg(w) AS mw, var_pop(v) AS vx, var_pop(w) AS vw, covar_pop(v, w) AS c FROM f JOIN proto p ON p.node = f.node AND p.pos = f.pos GROUP BY t) SELECT t, CAST(node AS INTEGER) AS node, round(CASE WHEN t % 10 > 0 THEN (2 * mx * mw + 1e-4) * (2 * c + 9e-4) / ((mx * mx + mw * mw + 1e-4) * (vx + vw + 9e-4)) END, 6) AS ssim FROM m")
def guarded_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity to the own prototype, undefined for constant fields."""
    x = catalog.fields(spark, sf_dir)
    flat = F.when(F.col("t") % 10 == 0, F.transform("vec", lambda v: F.lit(0.25))).otherwise(F.col("vec"))
    found = bmu.own_prototype(x.withColumn("vec", flat), bmu.prototypes_of(x), guarded=True)
    return found.select("t", F.col("node").cast("int").alias("node"), F.round("ssim", 6).alias("ssim"))


@query("WITH " + CUBE_SQL + "," + BMU_SQL + " SELECT max(n) AS most FROM (SELECT month, node, count(*) AS n FROM bmu WHERE month IN (10, 11, 12, 1, 2, 3) GROUP BY ALL)")
def largest_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count at the top of the scale of the month by node table."""
    b = catalog.bmu(spark, sf_dir).filter(in_season(F.col("month")))
    return nodes.month_node_counts(b, catalog.MAP_COLUMNS).agg(F.max("n").alias("most"))


@query("SELECT CAST(264 AS BIGINT) AS total, CAST(44 AS BIGINT) AS most, CAST(16 AS BIGINT) AS n_nodes")
def fallback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where no table of assignments is at hand, the counts of the published map are shown."""
    x = nodes.counts_or_published(spark, sinks.scratch(spark, "none"))
    return x.agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.count("*").alias("n_nodes"))


_PHASES = "p AS (SELECT * FROM (VALUES " + ", ".join(f"({y}, '{p}')" for y, _, p in catalog.PHASES) + ") AS p(season_year, phase))"


@query("WITH " + CUBE_SQL + "," + BMU_SQL + ", " + _PHASES + ", s AS (SELECT DISTINCT CASE WHEN month >= 10 THEN year ELSE year - 1 END AS season_year FROM bmu WHERE month IN (10, 11, 12, 1, 2, 3)) SELECT phase, count(*) AS n FROM s JOIN p ON p.season_year = s.season_year WHERE phase IN ('El Niño', 'La Niña') GROUP BY phase")
def phase_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons of each phase."""
    b = catalog.bmu(spark, sf_dir).filter(in_season(F.col("month")))
    x = nodes.seasonal_index(b, catalog.phases(spark)).filter(F.col("phase").isin("El Niño", "La Niña"))
    return x.groupBy("phase").agg(F.count("*").alias("n"))
