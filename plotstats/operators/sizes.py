"""Size structure: relative frequency of stem diameters by size class.

Rows kept: ``DBH_cm >= 0`` and a status other than text "NA" (NULLs fall
out of both); "Dying" counts as "Alive".  Size classes are left-closed
multiples of the class width starting at 0; empty classes produce no row.
Frequencies divide by all statuses of the facet together, so the bars of
one facet sum to 1.

Plan: class index is a codegen'd expression → partial/final count per
(facet, status, class) → a window ``sum(n) over (partition by facet)``.
The window runs on the aggregated rows (at most statuses × classes per
facet), so no facet's raw readings are ever gathered in one task.  Readings that
carry only their plot meet the broadcast plots before they are counted, so the first
shuffle holds a row for each facet, status and class of a task; of one site only its own
plots are broadcast, and other readings end there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotstats.functions.aggregates import n_rows
from plotstats.functions.expr import size_class_index, size_class_label
from plotstats.plans.nested import PlotReadings, plot_groups, sited_rows


def size_rows(trees: DataFrame | PlotReadings, bin_size: float, keys: Sequence[str] = ("SY", "Site")) -> DataFrame:
    status = F.when(F.col("Mortality") == "Dying", F.lit("Alive")).otherwise(F.col("Mortality"))
    return (trees.where((F.col("DBH_cm") >= 0) & (F.col("Mortality") != "NA"))
            .select(*keys, status.alias("Mortality"),
                    size_class_index("DBH_cm", bin_size).alias("size_class")))


def size_frequency(trees: DataFrame, facet: Sequence[str], bin_size: float) -> DataFrame:
    """facet…, Mortality, size_class (1-based), size_label, n, freq."""
    facet = list(facet)
    sited = sited_rows(trees, "Site") if isinstance(trees, PlotReadings) else trees
    if sited is None:  # too many plots to broadcast: counts per plot first, then their site
        rows = PlotReadings(size_rows(trees, bin_size, ["SY", "Plot"]), trees.plots)
        counts = plot_groups(rows, ["SY", "Site", "Plot", "Mortality", "size_class"], n_rows().alias("n"))
        counts = counts.groupBy(*facet, "Mortality", "size_class").agg(F.sum("n").alias("n"))
    else:
        counts = size_rows(sited, bin_size).groupBy(*facet, "Mortality", "size_class").agg(
            n_rows().alias("n"))
    total = F.sum("n").over(Window.partitionBy(*facet))
    return counts.select(
        *facet, "Mortality", "size_class",
        size_class_label("size_class", bin_size).alias("size_label"),
        "n", (F.col("n") / total).alias("freq"))


def size_freq_by_period(trees: DataFrame, site: str, bin_size: float) -> DataFrame:
    """One site; frequencies within each survey year."""
    here = F.col("Site") == site
    if isinstance(trees, PlotReadings):
        return size_frequency(PlotReadings(trees.rows, trees.plots.where(here)), ["SY"], bin_size)
    return size_frequency(trees.where(here), ["SY"], bin_size)


def size_freq_by_site(trees: DataFrame, year: int, bin_size: float) -> DataFrame:
    """One survey year; frequencies within each site."""
    return size_frequency(trees.where(F.col("SY") == year), ["Site"], bin_size)


def size_freq_all(trees: DataFrame, bin_size: float) -> DataFrame:
    """Every site × survey year in one job (the per-site report loop)."""
    return size_frequency(trees, ["Site", "SY"], bin_size)


def size_class_table(trees: DataFrame, bin_size: float) -> DataFrame:
    """size_class, size_label, n_trees for every non-empty class."""
    return (size_rows(trees, bin_size, ()).groupBy("size_class").agg(n_rows().alias("n_trees"))
            .select("size_class", size_class_label("size_class", bin_size).alias("size_label"),
                    "n_trees"))
