"""

Each entry takes ``(spark, sf_dir)``, derives the survey tables it needs
from the test tables in ``sf_dir`` (``sources.fixtures``) and returns the
operator's lazy result over the whole tables.  Parameters follow the
fixture: base year 1996, target year 2000, size classes 3 cm wide, focus
site NATION_8, focus year 2000, island levels AFRICA / AMERICA / ASIA.

``comparable`` rounds double columns to 6 decimals (and turns -0.0 into
0.0) so that results can be compared with an independent SQL engine whose
floating-point summation order differs in the last bits.  Values are first
snapped to 9 decimals, which maps neighbours one ulp apart to the same
double, and then rounded as ``round(x·1e6)/1e6`` — the same IEEE steps in
both engines, so a value on a tie such as 605.3602375 rounds the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotstats.functions.aggregates import n_rows
from plotstats.functions.expr import SNAP_DIGITS, basal_area, binary_round, mean_se_text, species_display_name
from plotstats.operators import canopy, regen, sites, sizes, stand, water
from plotstats.plans import report
from plotstats.plans.levels import factor_levels
from plotstats.plans.nested import plot_groups
from plotstats.plans.session import released, remove_scratch, scratch_path
from plotstats.sources import fixtures as fx
from plotstats.sources import checks, io, workbook

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            scale = float(10 ** digits)
            c = (F.round(F.round(c, SNAP_DIGITS) * scale) / scale + F.lit(0.0)).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


_STORED: dict[str, DataFrame] | None = None


@contextmanager
def stored_tables(tables: dict[str, DataFrame]):
    """Run the registered queries over already-stored survey tables (e.g.
    from ``io.load_tables``) instead of deriving them from the test tables."""
    global _STORED
    prev, _STORED = _STORED, dict(tables)
    try:
        yield
    finally:
        _STORED = prev


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if _STORED is not None:
        return _STORED[name]
    return fx.BUILDERS[name](spark, sf)


def _r(spark: SparkSession, sf: str, name: str):
    """A table of readings for statistics that aggregate per plot first."""
    return _STORED[name] if _STORED is not None else fx.plot_readings(spark, sf, name)


B, T_ = fx.BASE_YEAR, fx.TARGET_YEAR

# --- size structure ---------------------------------------------------------------


@register("size_freq_by_period")
def q_size_freq_by_period(spark, sf):
    return sizes.size_freq_by_period(_r(spark, sf, "trees"), fx.FOCUS_SITE, fx.SIZE_BIN)


@register("size_freq_by_site")
def q_size_freq_by_site(spark, sf):
    return sizes.size_freq_by_site(_r(spark, sf, "trees"), fx.FOCUS_YEAR, fx.SIZE_BIN)


@register("size_freq_all")
def q_size_freq_all(spark, sf):
    return sizes.size_freq_all(_r(spark, sf, "trees"), fx.SIZE_BIN)


@register("size_class_label")
def q_size_class_label(spark, sf):
    return sizes.size_class_table(_r(spark, sf, "trees"), fx.SIZE_BIN)


# --- stand structure --------------------------------------------------------------


@register("basal_area")
def q_basal_area(spark, sf):
    t = _t(spark, sf, "trees")
    return t.select("SY", "Site", "Plot", "Quadrat", "Species", "Mortality", "DBH_cm",
                    basal_area("DBH_cm").alias("basal_area"))


@register("standard_error")
def q_standard_error(spark, sf):
    return stand.diameter_error(_r(spark, sf, "trees"))


@register("mean_basal_area")
def q_mean_basal_area(spark, sf):
    return stand.mean_basal_area(_r(spark, sf, "trees"))


@register("mean_basal_area_dead")
def q_mean_basal_area_dead(spark, sf):
    return stand.mean_basal_area_dead(_r(spark, sf, "trees"))


@register("species_share_alive")
def q_species_share_alive(spark, sf):
    return stand.species_share(_r(spark, sf, "trees"), "alive")


@register("species_share_dead")
def q_species_share_dead(spark, sf):
    return stand.species_share(_r(spark, sf, "trees"), "dead")


@register("mean_stem_density")
def q_mean_stem_density(spark, sf):
    return stand.mean_stem_density(_r(spark, sf, "trees"))


@register("mean_tree_height")
def q_mean_tree_height(spark, sf):
    return stand.mean_tree_height(_r(spark, sf, "heights"))


@register("pct_basal_area_change")
def q_pct_basal_area_change(spark, sf):
    return stand.pct_basal_area_change(_r(spark, sf, "trees"), B, T_)


@register("basal_area_change")
def q_basal_area_change(spark, sf):
    return stand.basal_area_change(_r(spark, sf, "trees"), B, T_)


@register("basal_area_change_dead")
def q_basal_area_change_dead(spark, sf):
    return stand.basal_area_change_dead(_r(spark, sf, "trees"), B, T_)


@register("tree_height_change")
def q_tree_height_change(spark, sf):
    return stand.tree_height_change(_r(spark, sf, "heights"), B, T_)


@register("stem_density_change")
def q_stem_density_change(spark, sf):
    return stand.stem_density_change(_r(spark, sf, "trees"), B, T_)


@register("tree_summary")
def q_tree_summary(spark, sf):
    return stand.tree_summary(_r(spark, sf, "trees"), _r(spark, sf, "heights"))


@register("tree_summary_display")
def q_tree_summary_display(spark, sf):
    return stand.tree_summary_display(q_tree_summary(spark, sf))


# --- canopy -----------------------------------------------------------------------


@register("canopy_long")
def q_canopy_long(spark, sf):
    return canopy.canopy_long(_t(spark, sf, "densiometer"))


@register("canopy_cover")
def q_canopy_cover(spark, sf):
    return canopy.canopy_cover(_t(spark, sf, "densiometer"))


@register("canopy_cover_table")
def q_canopy_cover_table(spark, sf):
    return canopy.canopy_cover_table(_t(spark, sf, "densiometer"))


@register("canopy_cover_series")
def q_canopy_cover_series(spark, sf):
    return canopy.canopy_cover_series(_t(spark, sf, "densiometer"))


@register("canopy_cover_open")
def q_canopy_cover_open(spark, sf):
    return canopy.open_cover_text(canopy.canopy_cover_open(_t(spark, sf, "densiometer")))


# --- regeneration -------------------------------------------------------------------


@register("site_islands")
def q_site_islands(spark, sf):
    return regen.site_islands(_t(spark, sf, "densiometer"))


@register("sites_of_island")
def q_sites_of_island(spark, sf):
    return regen.sites_of_island(_t(spark, sf, "densiometer"), fx.FOCUS_ISLAND)


@register("regen_long")
def q_regen_long(spark, sf):
    return regen.regen_long(_t(spark, sf, "regeneration"))


@register("seedling_density")
def q_seedling_density(spark, sf):
    return regen.seedling_density(_t(spark, sf, "regeneration"), _t(spark, sf, "densiometer"),
                                  fx.ISLANDS)


@register("sapling_density")
def q_sapling_density(spark, sf):
    return regen.sapling_density(_t(spark, sf, "regeneration"), _r(spark, sf, "saplings"),
                                 _t(spark, sf, "densiometer"), None, fx.ISLANDS)


@register("sapling_density_species")
def q_sapling_density_species(spark, sf):
    """The one-species form, as the regeneration report uses it."""
    return regen.sapling_density(_t(spark, sf, "regeneration"), _r(spark, sf, "saplings"),
                                 _t(spark, sf, "densiometer"), "LARA", fx.ISLANDS)


@register("sapling_table")
def q_sapling_table(spark, sf):
    return regen.sapling_table(_t(spark, sf, "regeneration"))


@register("seedling_table")
def q_seedling_table(spark, sf):
    return regen.seedling_table(_t(spark, sf, "regeneration"))


@register("rescale_to_axis")
def q_rescale_to_axis(spark, sf):
    d = q_sapling_density(spark, sf)
    return regen.rescale_to_axis(d, "mean_ht", "mean_dens", "mean_dens_SE", "ht_scaled").select(
        "SY", "Site", "Species", "mean_ht", "ht_scaled")


@register("rescale_inverse")
def q_rescale_inverse(spark, sf):
    d = q_seedling_density(spark, sf)
    s = regen.axis_scalars(d, "height_site", "mean_site", "count_SE")
    d = regen.rescale_to_axis(d, "height_site", "mean_site", "count_SE", "height_scaled", s)
    d = regen.rescale_inverse(d, "height_scaled", "height_site", "mean_site", "count_SE", "height_back", s)
    d = regen.rescale_inverse(d, "mean_site", "height_site", "mean_site", "count_SE", "axis_height", s)
    return d.select("SY", "Site", "height_site", "height_scaled", "height_back", "axis_height")


@register("error_bar_bounds")
def q_error_bar_bounds(spark, sf):
    d = regen.sapling_mean_density(_t(spark, sf, "regeneration"), _t(spark, sf, "densiometer"), fx.ISLANDS)
    return regen.error_bar_bounds(d, "mean_dens", "mean_dens_SE").select(
        "SY", "Site", "Species", "ymin", "ymax")


AXIS_GAPS = ((2.0123, 2.1317),)  # lies among the fixture's seedling means


@register("error_bar_panels")
def q_error_bar_panels(spark, sf):
    """Seedling bars and error bars as an axis with a gap shows them."""
    return regen.bars_across_breaks(q_seedling_density(spark, sf), "mean_site", "count_SE", AXIS_GAPS).select(
        "SY", "Site", "panel", "bar_from", "bar_to", "err_from", "err_to", "shift")


# --- water, sites, map -------------------------------------------------------------


@register("mean_water_quality")
def q_mean_water_quality(spark, sf):
    return water.mean_water_quality(_r(spark, sf, "ysi"))


@register("water_quality_table")
def q_water_quality_table(spark, sf):
    return water.water_quality_table(_r(spark, sf, "ysi"))


@register("site_coordinates")
def q_site_coordinates(spark, sf):
    return sites.site_coordinates(_t(spark, sf, "coordinates"))


@register("site_change_overview")
def q_site_change_overview(spark, sf):
    return sites.site_change_overview(_r(spark, sf, "trees"), _r(spark, sf, "heights"),
                                      _t(spark, sf, "coordinates"), B, T_)


@register("map_layers")
def q_map_layers(spark, sf):
    return sites.map_layers(q_site_change_overview(spark, sf))


# --- shared expressions, input/output ------------------------------------------------


@register("mean_se_text")
def q_mean_se_text(spark, sf):
    c = canopy.canopy_cover(_t(spark, sf, "densiometer"))
    return c.select("SY", "Site", "Type", mean_se_text("perc", "perc_SE", 1).alias("cover_text"))


@register("species_display_name")
def q_species_display_name(spark, sf):
    trees = _r(spark, sf, "trees").select("Species")
    return trees.groupBy("Species").agg(n_rows().alias("n_trees")).select(
        "Species", species_display_name("Species").alias("display_name"), "n_trees")


@register("binary_round")
def q_binary_round(spark, sf):
    """Every sapling height rounded to 3 decimals as the binary number it is: how many, how many of them
    upwards, and their sum in thousandths."""
    h = F.col("Height_cm")
    near = binary_round(h, 3)
    plot = plot_groups(_r(spark, sf, "saplings"), ["SY", "Site", "Plot"], F.count(h).alias("n_values"), F.count(F.when(near > h, 1)).alias("n_up"),
                       F.sum(F.rint(near * 1000.0).cast("long")).alias("total_milli"))
    return plot.groupBy("SY", "Site").agg(*[F.sum(c).alias(c) for c in ("n_values", "n_up", "total_milli")])


@register("factor_levels")
def q_factor_levels(spark, sf):
    """Levels of every year, site, plot and species of the tree sheet."""
    trees = _t(spark, sf, "trees").withColumn("Plot", F.col("Plot").cast("string"))
    parts = [factor_levels(trees, c).select(F.lit(c).alias("column_name"), F.col("value").cast("string").alias("value"), "level")
             for c in ("SY", "Site", "Plot", "Species")]
    return reduce(DataFrame.unionByName, parts)


def _contents(frames: dict[str, DataFrame], label: str) -> DataFrame:
    """Per table and column: rows, non-null values, the exact sum of numbers (6 decimals)
    and the least and greatest text."""
    parts = []
    for name, df in frames.items():
        rows = []
        aggs = [n_rows().alias("n_rows")]
        for i, f in enumerate(df.schema.fields):
            c = F.col(f"`{f.name}`")
            text = isinstance(f.dataType, T.StringType)
            total = F.lit(None) if text else F.sum(F.round(c, 6).cast("decimal(38,6)"))
            aggs += [F.count(c).alias(f"n{i}"), total.cast("decimal(38,6)").alias(f"t{i}"),
                     *(agg(c if text else F.lit(None).cast("string")).alias(f"{k}{i}") for k, agg in (("l", F.min), ("h", F.max)))]
            rows.append(F.struct(F.lit(f.name).alias("column_name"), F.col("n_rows"), F.col(f"n{i}").alias("n_values"),
                                 F.round(F.col(f"t{i}").cast("double"), 2).alias("total"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high")))
        parts.append(df.agg(*aggs).select(F.lit(name).alias(label), F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


@register("load_tables")
def q_load_tables(spark, sf):
    """Write the derived survey tables in their declared schemas (partitioned
    by survey year) to a fresh folder under the shared checkpoint folder, load
    them back through ``load_tables`` and report every column's contents."""
    root = scratch_path(spark, "survey-tables")
    io.write_survey_tables(fx.survey_tables(spark, sf), root)
    return _contents(io.load_tables(spark, root), "table_name")


@register("export_results")
def q_export_results(spark, sf):
    """The batch report: survey tables are materialised once (written to a
    fresh folder under the shared checkpoint folder and loaded back with
    declared schemas), every result table is written and published as one
    version (size frequencies one folder per Site), and the contents of every column
    of the version, found by its manifest, are reported from storage.  The survey tables are
    removed afterwards; the results stay, as the returned frame reads them."""
    root = scratch_path(spark, "report")
    io.write_survey_tables(fx.survey_tables(spark, sf), f"{root}/survey")
    tables = io.load_tables(spark, f"{root}/survey")
    report.publish_report(spark, tables, f"{root}/results", "fixture", bin_size=fx.SIZE_BIN, island_levels=fx.ISLANDS)
    remove_scratch(spark, f"{root}/survey")
    return _contents(report.read_report(spark, f"{root}/results"), "result")


@register("row_order_on_load")
def q_row_order_on_load(spark, sf):
    """Coordinates written in sheet order without a row column, read back and numbered in file order: the
    site's first forest type must be the one of the sheet's first row."""
    root = scratch_path(spark, "plain-sheet")
    sheet = io.conform(_t(spark, sf, "coordinates"), "coordinates").orderBy("Row").drop("Row")
    io.write_table(sheet, f"{root}/coordinates", "csv")
    return sites.site_coordinates(io.load_tables(spark, root, "csv", ["coordinates"])["coordinates"])


@register("workbook_scan")
def q_workbook_scan(spark, sf):
    """Every survey table packed into workbooks (the coordinates in sheet order without a row column), the workbooks
    parsed and stored, and every stored column's contents reported."""
    root = scratch_path(spark, "workbooks")
    with released(spark):  # the tables are packed one after another, each with a shuffle of its own
        for name in io.SURVEY_SCHEMAS:
            df = io.conform(_t(spark, sf, name), name)
            if name == "coordinates":  # the fixture's sheet rows start at the least plot, numbered ones at 1
                df = df.orderBy("Row").drop("Row")
            else:  # packing and parsing cost far more than reading, so no task takes a whole input file
                df = df.repartition("SY", "Plot", "Quadrat")
            # a file for each workbook, as in a folder of them
            workbook.pack_workbooks(df, workbook.SHEETS[name], name).write.mode("append").option("maxRecordsPerFile", 1).parquet(f"{root}/books")
        books = spark.read.parquet(f"{root}/books")
        tables = {n: io.conform(df, n) for n, df in workbook.workbook_tables(books).items()}
        io.write_survey_tables(tables, f"{root}/tables")
    return _contents(io.load_tables(spark, f"{root}/tables"), "table_name")


# --- sheet checks ------------------------------------------------------------------


def _as_typed(df: DataFrame) -> DataFrame:
    """Cells as a sheet holds them: missing diameters, heights and temperatures as text, and units typed along."""
    for c, unit in (("DBH_cm", "cm"), ("Tree_Height_m", "m"), ("Temp", "C")):
        if c in df.columns:
            text = F.col(c).cast("string")
            df = df.withColumn(c, F.when(F.col(c).isNull(), F.lit("NA")).when(F.col("Quadrat") == 7, F.concat(text, F.lit(f" {unit}"))).otherwise(text))
    return df


@register("coercion_report")
def q_coercion_report(spark, sf):
    """Cells that are no numbers, by table and column; the example is left out, as how a double prints
    is each engine's own affair."""
    return checks.coercion_report({n: _as_typed(_t(spark, sf, n)) for n in io.SURVEY_SCHEMAS}).drop("example")


@register("key_report")
def q_key_report(spark, sf):
    """How often keys repeat in every survey table."""
    return checks.key_report({n: _t(spark, sf, n) for n in io.SURVEY_SCHEMAS})


@register("unfiled_keys")
def q_unfiled_keys(spark, sf):
    """Plots and sites of every survey table against a coordinates sheet that lacks every ninth plot."""
    filed = _t(spark, sf, "coordinates").where("cast(Plot as bigint) % 9 <> 0")
    return checks.unfiled_keys({n: _t(spark, sf, n) for n in io.SURVEY_SCHEMAS}, filed)
