"""Stand structure: basal area, stem density, tree height, species shares,
change between two survey years, and the combined summary table.

Semantics worth keeping in mind (they differ between look-alike operators):

* basal area (live / dead): plot **sum** (NULL diameters skipped, a plot of
  only NULL diameters sums to 0) → site mean and SE over plots; a NULL
  mean/SE becomes 0 (so a one-plot site has SE 0).  A plot without a
  qualifying tree is *absent*, not zero.
* stem density: rows per plot (NULL diameters counted) / 0.01 ha → site
  mean, SE; no fill (one plot → SE NULL).
* species share: a species missing from a plot that has other qualifying
  trees counts as 0 in the plot mean; share = species mean / sum of species
  means × 100, NULL when that sum is 0.
* tree height: species in the list, "UNK" or NULL (text "NA" excluded),
  no mortality filter; plot mean → site mean, SE; NULL → 0.
* change: absent year → 0 before subtracting; result NULL → 0 (percent
  change: NULL when the base is 0).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotstats.functions.aggregates import merge_states, moment_state, n_rows, standard_error, state_error, sum_skip
from plotstats.functions.expr import (DEAD, LIVE, PLOT_AREA_HA, SPECIES, basal_area, mean_se_text,
                                      report_round)
from plotstats.plans.merge import merge_outer
from plotstats.plans.nested import Measure, PlotReadings, nested_stats, plot_groups

SITE_YEAR = ["SY", "Site"]
PLOT = ["SY", "Site", "Plot"]
# columns of the percent-change table; survey years are a handful
MAX_YEARS = 500


def mortality_classes(mortality: str) -> tuple[tuple[str, ...], str]:
    """'alive' → (Alive, Dying), '_alive'; 'dead' → (Dead,), '_dead'."""
    m = mortality.strip().lower()
    if m == "alive":
        return LIVE, "_alive"
    if m == "dead":
        return DEAD, "_dead"
    raise ValueError(f"mortality must be 'alive' or 'dead', got {mortality!r}")


def _qualifying(trees: DataFrame, statuses: Sequence[str]) -> DataFrame:
    return trees.where(F.col("Species").isin(*SPECIES) & F.col("Mortality").isin(*statuses))


def _basal_area_stats(trees: DataFrame, statuses: Sequence[str]) -> DataFrame:
    return nested_stats(
        _qualifying(trees, statuses), [PLOT, SITE_YEAR],
        [Measure("mean_basal_area", basal_area("DBH_cm"), ("sum", "mean"), se="skip", fill=0.0)])


def mean_basal_area(trees: DataFrame) -> DataFrame:
    """Live (Alive/Dying) basal area, m²/ha: SY, Site, mean_basal_area, mean_basal_area_SE."""
    return _basal_area_stats(trees, LIVE)


def mean_basal_area_dead(trees: DataFrame) -> DataFrame:
    """Dead basal area; site-years with a NULL survey year are dropped."""
    return _basal_area_stats(trees, DEAD).where(F.col("SY").isNotNull())


def diameter_error(trees: DataFrame | PlotReadings) -> DataFrame:
    """SY, Site, n_dbh, se_dbh, se_dbh_strict (NULL as soon as one diameter is missing): the standard
    error over single diameters.  States per plot are merged by site, so readings that carry only their
    plot never meet the site."""
    if isinstance(trees, PlotReadings):
        states = plot_groups(trees, PLOT, *moment_state("DBH_cm", "dbh")).groupBy(*SITE_YEAR).agg(*merge_states("dbh"))
    else:
        states = trees.groupBy(*SITE_YEAR).agg(*moment_state("DBH_cm", "dbh"))
    return states.select(*SITE_YEAR, F.col("dbh_n").alias("n_dbh"), state_error("dbh").alias("se_dbh"),
                         state_error("dbh", na_rm=False).alias("se_dbh_strict"))


def species_share(trees: DataFrame, mortality: str = "alive") -> DataFrame:
    """Percent of site basal area per species: SY, Site, RHMA_<m>, AVGE_<m>, LARA_<m>.

    The per-species zero fill is a conditional sum in the plot aggregate (one
    pass, one shuffle) rather than a pivot/unpivot round trip.
    """
    statuses, suffix = mortality_classes(mortality)
    ba = basal_area("DBH_cm")
    plot = plot_groups(_qualifying(trees, statuses), PLOT,
                       *[sum_skip(F.when(F.col("Species") == s, ba)).alias(s) for s in SPECIES])
    site = plot.groupBy(*SITE_YEAR).agg(*[F.avg(s).alias(s) for s in SPECIES])
    total = _sum_cols(SPECIES)
    return site.select(*SITE_YEAR, *[
        (F.try_divide(F.col(s), total) * 100.0).alias(s + suffix) for s in SPECIES])


def _sum_cols(names: Sequence[str]) -> Column:
    out = F.col(names[0])
    for n in names[1:]:
        out = out + F.col(n)
    return out


def mean_stem_density(trees: DataFrame) -> DataFrame:
    """Live stems per hectare: SY, Site, mean_stem_density, mean_stem_density_SE."""
    plot = plot_groups(_qualifying(trees, LIVE), PLOT, (n_rows() / PLOT_AREA_HA).alias("stems_ha"))
    return plot.groupBy(*SITE_YEAR).agg(
        F.avg("stems_ha").alias("mean_stem_density"),
        standard_error("stems_ha").alias("mean_stem_density_SE"))


def height_species_filter(species: Column) -> Column:
    return species.isin(*SPECIES, "UNK") | species.isNull()


def mean_tree_height(heights: DataFrame) -> DataFrame:
    """SY, Site, mean_height, mean_height_SE (metres)."""
    h = heights.where(height_species_filter(F.col("Species")))
    return nested_stats(h, [PLOT, SITE_YEAR], [
        Measure("mean_height", "Tree_Height_m", ("mean", "mean"), se="skip", fill=0.0)])


# --- change between two survey years ------------------------------------------

def _year_value(value: str, year: int) -> Column:
    return F.coalesce(F.max(F.when(F.col("SY") == year, F.col(value))), F.lit(0.0))


def year_change(stat: DataFrame, value: str, out: str, base: int, target: int) -> DataFrame:
    """Site, ``out`` = value(target) − value(base), absent years as 0.

    A conditional aggregate per Site instead of a pivot: no pivot-value
    discovery job and one small shuffle of the site-year table.
    """
    return stat.groupBy("Site").agg(
        F.coalesce(_year_value(value, target) - _year_value(value, base), F.lit(0.0)).alias(out))


def pct_basal_area_change(trees: DataFrame, base: int, target: int,
                          years: Sequence[int] | None = None) -> DataFrame:
    """Site, one column per survey year (mean live basal area, absent → 0),
    percentage_change = (target − base) / base × 100 (NULL when base is 0).
    The year columns are the survey years with a live tree, found by a distinct
    over ``SY`` (``MAX_YEARS`` at most); ``years`` fixes them instead, and a year
    of the data outside the list is an error, not a lost column."""
    live = _qualifying(trees, LIVE).select("SY").where(F.col("SY").isNotNull()).distinct()
    found = {r.SY for r in live.limit(MAX_YEARS + 1).collect()}
    if len(found) > MAX_YEARS:
        raise ValueError(f"more than {MAX_YEARS} survey years")
    if years is not None and not found <= set(years):
        raise ValueError(f"survey years {sorted(found - set(years))} are not in the given list")
    ys = sorted(found.union(years or (), (base, target)))
    stat = mean_basal_area(trees)
    wide = stat.groupBy("Site").agg(*[_year_value("mean_basal_area", y).alias(str(y)) for y in ys])
    b, t = F.col(f"`{base}`"), F.col(f"`{target}`")
    return wide.withColumn("percentage_change", F.try_divide(t - b, b) * 100.0)


def basal_area_change(trees: DataFrame, base: int, target: int) -> DataFrame:
    return year_change(mean_basal_area(trees), "mean_basal_area", "total_change", base, target)


def basal_area_change_dead(trees: DataFrame, base: int, target: int) -> DataFrame:
    return year_change(mean_basal_area_dead(trees), "mean_basal_area", "total_change_dead", base, target)


def tree_height_change(heights: DataFrame, base: int, target: int) -> DataFrame:
    return year_change(mean_tree_height(heights), "mean_height", "height_change", base, target)


def stem_density_change(trees: DataFrame, base: int, target: int) -> DataFrame:
    return year_change(mean_stem_density(trees), "mean_stem_density", "stem_density_change", base, target)


# --- fused tree statistics ------------------------------------------------------

def tree_site_stats(trees: DataFrame) -> DataFrame:
    """Live basal area, live/dead species shares and live stem density for
    every site-year from ONE scan of ``trees`` and one plot-level shuffle.

    Each plot row carries flags for "has a live tree" / "has a dead tree";
    a plot that lacks the class is left out of that class's site mean, which
    is exactly the row set the separate operators aggregate over.  Columns of
    a class are NULL for a site-year without any plot of that class (the row
    the separate operator would not emit).
    """
    live = F.col("Mortality").isin(*LIVE)
    dead = F.col("Mortality").isin(*DEAD)
    sp = F.col("Species")
    ba = basal_area("DBH_cm")
    plot = plot_groups(
        _qualifying(trees, LIVE + DEAD), PLOT,
        F.count(F.when(live, 1)).alias("n_live"),
        F.count(F.when(dead, 1)).alias("n_dead"),
        sum_skip(F.when(live, ba)).alias("ba_live"),
        sum_skip(F.when(dead, ba)).alias("ba_dead"),
        *[sum_skip(F.when(live & (sp == s), ba)).alias(f"live_{s}") for s in SPECIES],
        *[sum_skip(F.when(dead & (sp == s), ba)).alias(f"dead_{s}") for s in SPECIES],
    )
    is_live, is_dead = F.col("n_live") > 0, F.col("n_dead") > 0
    density = F.when(is_live, F.col("n_live") / PLOT_AREA_HA)
    site = plot.groupBy(*SITE_YEAR).agg(
        F.count(F.when(is_live, 1)).alias("live_plots"),
        F.count(F.when(is_dead, 1)).alias("dead_plots"),
        F.avg(F.when(is_live, F.col("ba_live"))).alias("mean_basal_area"),
        standard_error(F.when(is_live, F.col("ba_live"))).alias("mean_basal_area_SE"),
        F.avg(F.when(is_dead, F.col("ba_dead"))).alias("mean_basal_area_dead"),
        standard_error(F.when(is_dead, F.col("ba_dead"))).alias("mean_basal_area_dead_SE"),
        *[F.avg(F.when(is_live, F.col(f"live_{s}"))).alias(f"live_{s}") for s in SPECIES],
        *[F.avg(F.when(is_dead, F.col(f"dead_{s}"))).alias(f"dead_{s}") for s in SPECIES],
        F.avg(density).alias("mean_stem_density"),
        standard_error(density).alias("mean_stem_density_SE"),
    )
    has_live, has_dead = F.col("live_plots") > 0, F.col("dead_plots") > 0
    live_total = _sum_cols([f"live_{s}" for s in SPECIES])
    dead_total = _sum_cols([f"dead_{s}" for s in SPECIES])
    return site.select(
        *SITE_YEAR,
        F.when(has_live, F.col("mean_basal_area")).alias("mean_basal_area"),
        F.when(has_live, F.coalesce(F.col("mean_basal_area_SE"), F.lit(0.0))).alias("mean_basal_area_SE"),
        F.when(has_dead, F.col("mean_basal_area_dead")).alias("mean_basal_area_dead"),
        F.when(has_dead, F.coalesce(F.col("mean_basal_area_dead_SE"), F.lit(0.0)))
        .alias("mean_basal_area_dead_SE"),
        *[F.when(has_live, F.try_divide(F.col(f"live_{s}"), live_total) * 100.0).alias(f"{s}_alive")
          for s in SPECIES],
        *[F.when(has_dead, F.try_divide(F.col(f"dead_{s}"), dead_total) * 100.0).alias(f"{s}_dead")
          for s in SPECIES],
        "mean_stem_density", "mean_stem_density_SE",
    )


TREE_SUMMARY_COLUMNS = [
    "SY", "Site", "mean_basal_area", "mean_basal_area_SE",
    "RHMA_alive", "AVGE_alive", "LARA_alive", "RHMA_dead", "AVGE_dead", "LARA_dead",
    "mean_height", "mean_height_SE", "mean_stem_density", "mean_stem_density_SE",
]


def tree_summary(trees: DataFrame, heights: DataFrame) -> DataFrame:
    """Basal area, live and dead species shares, height and stem density
    per site-year, merged on (SY, Site) with NULL keys matching."""
    merged = merge_outer([tree_site_stats(trees), mean_tree_height(heights)], SITE_YEAR)
    return merged.select(*TREE_SUMMARY_COLUMNS)


def tree_summary_display(summary: DataFrame) -> DataFrame:
    """Report form: numbers to 1 decimal (half-even), density then to 0;
    Height / Basal_Area / Density as "mean ± SE" text."""
    r1 = {c: report_round(c, 1) for c in TREE_SUMMARY_COLUMNS[2:]}
    s = summary.withColumns(r1).withColumns({
        "mean_stem_density": report_round("mean_stem_density", 0),
        "mean_stem_density_SE": report_round("mean_stem_density_SE", 0)})
    return s.select(
        "SY", "Site",
        mean_se_text("mean_height", "mean_height_SE", 1).alias("Height"),
        mean_se_text("mean_basal_area", "mean_basal_area_SE", 1).alias("Basal_Area"),
        mean_se_text("mean_stem_density", "mean_stem_density_SE", 0).alias("Density"),
        "RHMA_alive", "AVGE_alive", "LARA_alive", "RHMA_dead", "AVGE_dead", "LARA_dead")


def tree_site_change(trees: DataFrame, heights: DataFrame, base: int, target: int) -> DataFrame:
    """total_change, total_change_dead, height_change, stem_density_change per
    Site — the four change operators merged on Site (a Site missing from one
    of them gets NULL there).  The three tree-based changes come from one
    fused site-year table and one ``groupBy(Site)``."""
    stats = tree_site_stats(trees)
    live = F.col("mean_basal_area").isNotNull()
    dead = F.col("mean_basal_area_dead").isNotNull() & F.col("SY").isNotNull()

    def change(value: str, present: Column) -> Column:
        def at(year: int) -> Column:
            return F.coalesce(F.max(F.when(present & (F.col("SY") == year), F.col(value))), F.lit(0.0))
        return F.when(F.max(present.cast("int")) == 1, at(target) - at(base))

    tree_changes = stats.groupBy("Site").agg(
        change("mean_basal_area", live).alias("total_change"),
        change("mean_basal_area_dead", dead).alias("total_change_dead"),
        change("mean_stem_density", live).alias("stem_density_change"))
    merged = merge_outer([tree_changes, tree_height_change(heights, base, target)], ["Site"])
    return merged.select("Site", "total_change", "total_change_dead", "height_change",
                         "stem_density_change")


__all__ = [
    "mean_basal_area", "mean_basal_area_dead", "species_share", "mean_stem_density",
    "mean_tree_height", "pct_basal_area_change", "basal_area_change", "basal_area_change_dead",
    "tree_height_change", "stem_density_change", "tree_site_stats", "tree_summary",
    "tree_summary_display", "tree_site_change", "year_change",
]
