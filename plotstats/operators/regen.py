"""Regeneration: seedling and sapling density, their tables, site lookups
and the helpers that put a height series on the density axis.

NULL policies differ on purpose:
* seedling density – plot mean **propagates** NULL (one missing count → the
  plot and then the site mean is NULL); the SE skips NULLs.
* seedling table   – plot and site means skip NULLs.
* sapling density / table – quadrat **sum** (NULLs skipped, all-NULL → 0) →
  plot mean → site mean, SE, all skipping NULLs.
Densities are counts per quadrat (no area scaling).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotstats.functions.aggregates import mean_prop, standard_error
from plotstats.functions.expr import DEFAULT_ISLANDS, SPECIES, as_level, level_ordinal, mean_se_text
from plotstats.plans.merge import left_join_nullsafe, left_merge
from plotstats.plans.nested import Measure, nested_stats

# --- fixed values of the regeneration sheet -----------------------------------
# Count columns (<species>_<stage>), in sheet order.
REGEN_COLUMNS = ("RHMA_seedlings", "RHMA_saplings", "LARA_seedlings", "LARA_saplings",
                 "AVGE_seedlings", "AVGE_saplings")
# ------------------------------------------------------------------------------


def regen_long(regen: DataFrame, stage: str | None = None) -> DataFrame:
    """SY, Site, Plot, Quadrat, Species, Stage, Count — one row per count cell.

    ``stage`` ("seedlings" / "saplings") stacks only that stage's columns: the
    filter is applied to the column list, since Spark cannot push a filter on
    generated columns below the generator."""
    rows = []
    for c in REGEN_COLUMNS:
        species, st = c.split("_")
        if stage is None or st == stage:
            rows.append(F.struct(F.lit(species).alias("Species"), F.lit(st).alias("Stage"),
                                 F.col(c).cast("double").alias("Count")))
    if not rows:
        raise ValueError(f"unknown stage {stage!r}")
    return regen.select("SY", "Site", "Plot", "Quadrat", F.inline(F.array(*rows)))


def site_islands(densio: DataFrame) -> DataFrame:
    """Distinct (Island, Site) pairs."""
    return densio.select("Island", "Site").distinct()


def site_island_conflicts(densio: DataFrame) -> DataFrame:
    """Sites listed under more than one Island: Site, n_islands.  Such a Site
    yields one row per Island wherever results are labelled with their
    Island (seedling and sapling density); this check makes that visible."""
    return (site_islands(densio).groupBy("Site").agg(F.count(F.lit(1)).alias("n_islands"))
            .where(F.col("n_islands") > 1))


def sites_of_island(densio: DataFrame, island: str) -> DataFrame:
    return densio.where(F.col("Island") == island).select("Site").distinct()


def _with_island(df: DataFrame, densio: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Attach Island by Site (a Site listed under two islands yields two rows)
    as an ordered factor: Island outside ``levels`` → NULL; Island_order is
    the sort key — the 1-based level position, ``len(levels) + 1`` for a NULL
    Island (sorted last, as R sorts NA)."""
    j = left_join_nullsafe(df, site_islands(densio), ["Site"])
    return j.withColumns({"Island": as_level("Island", levels),
                          "Island_order": level_ordinal("Island", levels, missing_last=True)})


def seedling_density(regen: DataFrame, densio: DataFrame,
                     island_levels: Sequence[str] = DEFAULT_ISLANDS) -> DataFrame:
    """SY, Site, Stage, mean_site, count_SE, height_site, Island, Island_order.

    Counts and heights come from one plot aggregate: the mean over a plot's count
    cells is NULL if one of them is, else their sum over their number."""
    cells = [F.col(c) for c in REGEN_COLUMNS if c.endswith("_seedlings")]
    total = reduce(lambda a, b: a + b, cells)  # NULL if one cell is
    plot = regen.groupBy("SY", "Site", "Plot").agg(
        F.when(F.count(total) == F.count(F.lit(1)), F.sum(total) / (len(cells) * F.count(F.lit(1)))).alias("count"),
        F.avg("Tall_seedling_cm").alias("height"))
    site = plot.groupBy("SY", "Site").agg(
        F.lit("seedlings").alias("Stage"), mean_prop("count").alias("mean_site"),
        standard_error("count").alias("count_SE"), F.avg("height").alias("height_site"))
    return _with_island(site, densio, island_levels)


def _sapling_plot_density(regen: DataFrame) -> DataFrame:
    """SY, Site, Plot, Species, plot_dens: quadrat sums and plot means side by side, one
    wide row per quadrat and plot; the species are stacked after the plot level."""
    plot = nested_stats(regen, [["SY", "Site", "Plot", "Quadrat"], ["SY", "Site", "Plot"]],
                        [Measure(s, f"{s}_saplings", ("sum", "mean"), se=None) for s in SPECIES])
    rows = [F.struct(F.lit(s).alias("Species"), F.col(s).alias("plot_dens")) for s in SPECIES]
    return plot.select("SY", "Site", "Plot", F.inline(F.array(*rows)))


def sapling_density(regen: DataFrame, saplings: DataFrame, densio: DataFrame,
                    species: str | None = None,
                    island_levels: Sequence[str] = DEFAULT_ISLANDS) -> DataFrame:
    """SY, Site, Species, mean_dens, mean_dens_SE, mean_ht, Island, Island_order.

    Heights join the counts by (SY, Site, Plot, Species) as a left join, so a
    height group without counts is dropped; the merge shuffles plot-level
    rows only.  ``species`` filters last.
    """
    dens = _sapling_plot_density(regen)
    ht = nested_stats(saplings, [["SY", "Site", "Plot", "Quadrat", "Species"],
                                 ["SY", "Site", "Plot", "Species"]], [
        Measure("plot_ht", "Height_cm", ("mean", "mean"), se=None)])
    plot = left_merge(dens, ht, ["SY", "Site", "Plot", "Species"])
    site = plot.groupBy("SY", "Site", "Species").agg(
        F.avg("plot_dens").alias("mean_dens"),
        standard_error("plot_dens").alias("mean_dens_SE"),
        F.avg("plot_ht").alias("mean_ht"))
    out = _with_island(site, densio, island_levels)
    return out.where(F.col("Species") == species) if species else out


def sapling_mean_density(regen: DataFrame, densio: DataFrame,
                         island_levels: Sequence[str] = DEFAULT_ISLANDS) -> DataFrame:
    """``sapling_density`` without heights, so without a scan of the sapling sheet: SY, Site, Species,
    mean_dens, mean_dens_SE, Island, Island_order."""
    site = _sapling_plot_density(regen).groupBy("SY", "Site", "Species").agg(
        F.avg("plot_dens").alias("mean_dens"), standard_error("plot_dens").alias("mean_dens_SE"))
    return _with_island(site, densio, island_levels)


def _species_wide(site: DataFrame, mean: str, se: str, mean_name: str, se_name: str) -> DataFrame:
    """Species → columns <SP>_<mean_name>, <SP>_<se_name>, plus text <SP>.
    Row order is the sink's business (``plans.report.SORTED``)."""
    cols = []
    for s in SPECIES:
        cols.append(F.max(F.when(F.col("Species") == s, F.col(mean))).alias(f"{s}_{mean_name}"))
        cols.append(F.max(F.when(F.col("Species") == s, F.col(se))).alias(f"{s}_{se_name}"))
    wide = site.groupBy("SY", "Site").agg(*cols)
    text = [mean_se_text(f"{s}_{mean_name}", f"{s}_{se_name}", 1).alias(s) for s in SPECIES]
    return wide.select("*", *text)


def sapling_table(regen: DataFrame) -> DataFrame:
    """SY, Site, <SP>_mean_dens, <SP>_mean_dens_SE, RHMA, AVGE, LARA ("mean ± SE")."""
    site = _sapling_plot_density(regen).groupBy("SY", "Site", "Species").agg(
        F.avg("plot_dens").alias("mean_dens"),
        standard_error("plot_dens").alias("mean_dens_SE"))
    return _species_wide(site, "mean_dens", "mean_dens_SE", "mean_dens", "mean_dens_SE")


def seedling_table(regen: DataFrame) -> DataFrame:
    """SY, Site, <SP>_mean, <SP>_SE, RHMA, AVGE, LARA ("mean ± SE")."""
    seed = regen_long(regen, "seedlings")
    site = nested_stats(seed, [["SY", "Site", "Plot", "Species"], ["SY", "Site", "Species"]], [
        Measure("mean", "Count", ("mean", "mean"), se="skip", se_name="SE")])
    return _species_wide(site, "mean", "SE", "mean", "SE")


# --- secondary-axis helpers ------------------------------------------------------

def axis_scalars(df: DataFrame, y: str, mean: str, se: str) -> Column:
    """One struct (min_h, max_h, min_m, max_m) over the whole of ``df`` as an
    uncorrelated scalar subquery: computed once per query, no join, nothing
    collected.  max_m = max(mean) + max(SE); NULLs are skipped."""
    return df.select(F.struct(
        F.min(y).alias("min_h"), F.max(y).alias("max_h"), F.min(mean).alias("min_m"),
        (F.max(mean) + F.max(se)).alias("max_m"))).scalar()


def rescale_to_axis(df: DataFrame, y: str, mean: str, se: str, out: str,
                    scalars: Column | None = None) -> DataFrame:
    """Map ``y`` linearly from [min y, max y] onto the primary axis range
    [min mean, max mean + max SE]; NULL when y has no spread.  Pass
    ``scalars`` (from ``axis_scalars``) to share one subquery between calls."""
    s = axis_scalars(df, y, mean, se) if scalars is None else scalars
    span = F.try_divide(F.col(y) - s["min_h"], s["max_h"] - s["min_h"])
    return df.withColumn(out, span * (s["max_m"] - s["min_m"]) + s["min_m"])


def rescale_inverse(df: DataFrame, p: str, y: str, mean: str, se: str, out: str,
                    scalars: Column | None = None) -> DataFrame:
    """Inverse of ``rescale_to_axis``: primary-axis value ``p`` → ``y`` units."""
    s = axis_scalars(df, y, mean, se) if scalars is None else scalars
    span = F.try_divide(F.col(p) - s["min_m"], s["max_m"] - s["min_m"])
    return df.withColumn(out, span * (s["max_h"] - s["min_h"]) + s["min_h"])


def error_bar_bounds(df: DataFrame, mean: str, se: str) -> DataFrame:
    """One-sided bars: ymin = mean, ymax = mean + SE."""
    return df.withColumns({"ymin": F.col(mean), "ymax": F.col(mean) + F.col(se)})


def axis_panels(gaps: Sequence[tuple[float, float]]) -> list[tuple[float | None, float | None, float]]:
    """(low, high, shift) of the panels that an axis with these gaps shows, from below; None is an open
    side, and a panel moves down by ``shift`` to stand on the one below."""
    gaps = sorted((float(a), float(b)) for a, b in gaps)
    if any(a > b for a, b in gaps) or any(x[1] > y[0] for x, y in zip(gaps, gaps[1:])):
        raise ValueError("a gap must run upwards and gaps must not overlap")
    out, low, shift = [], None, 0.0
    for a, b in gaps:
        out.append((low, a, shift))
        low, shift = b, shift + (b - a)
    return [*out, (low, None, shift)]


def bars_across_breaks(df: DataFrame, mean: str, se: str, gaps: Sequence[tuple[float, float]]) -> DataFrame:
    """``df`` with a row for each panel of a broken axis that shows something of the bar (0 to mean) or of
    its error bar (mean to mean + SE): panel (1 is the lowest), bar_from, bar_to, err_from, err_to
    (clipped to the panel, NULL where it shows nothing) and shift (see ``axis_panels``).  The lowest
    panel is always there, so that a bar without a mean keeps its place on the axis.  One narrow
    projection, no shuffle."""
    m = F.col(mean)
    bar = (F.when(m.isNotNull(), F.least(m, F.lit(0.0))), F.when(m.isNotNull(), F.greatest(m, F.lit(0.0))))
    err = (m, m + F.col(se))
    panels = []
    for i, (low, high, shift) in enumerate(axis_panels(gaps), start=1):
        cells = []
        for what, (a, b) in (("bar", bar), ("err", err)):
            known = a.isNotNull() & b.isNotNull()
            start = a if low is None else F.greatest(a, F.lit(low))
            end = b if high is None else F.least(b, F.lit(high))
            shown = known & (start <= end)
            cells += [F.when(shown, start).alias(f"{what}_from"), F.when(shown, end).alias(f"{what}_to")]
        panels.append(F.struct(F.lit(i).alias("panel"), *cells, F.lit(shift).alias("shift")))
    shown = F.filter(F.array(*panels), lambda p: (p["panel"] == 1) | p["bar_from"].isNotNull() | p["err_from"].isNotNull())
    return df.select("*", F.inline(shown))
