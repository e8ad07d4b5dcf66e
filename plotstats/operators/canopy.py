"""Canopy cover from densiometer readings.

Readings arrive wide (``Calc_<direction>_<type>`` text cells, the set of
columns depends on the sheet).  They are parsed quietly (anything that is
not a plain number → NULL), melted to (Direction, Type, value), averaged
per plot over directions × readings and then per site with an SE.

The report table pivots every Type and then keeps Veg / Wood / Open, so a
site-year with only other types still gets a row (of zeros); the plot
series filters the three types first, so such a site-year has no row.
Only *absent* cells are filled with 0 — a present NULL stays NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotstats.functions.aggregates import standard_error
from plotstats.functions.expr import COVER_TYPES, mean_se_text, safe_number
from plotstats.plans.reshape import open_cell, pattern_columns, pivot_fixed, pivot_open, unpivot_by_pattern
from plotstats.sources.schemas import CANOPY_PREFIX

# --- fixed values of the densiometer sheet and canopy report -----------------
# Reading columns are named Calc_<direction>_<type>; report labels of the
# three cover types; the plotted range of the cover series.
CANOPY_PATTERN = r"Calc_([NSEW])_([A-Za-z]+)"
COVER_LABELS = {"Veg": "Alive", "Wood": "Dead", "Open": "Open"}
SERIES_RANGE = (-50.0, 100.0)
# ------------------------------------------------------------------------------


def canopy_long(densio: DataFrame) -> DataFrame:
    """SY, Site, Plot, Direction, Type, value (double or NULL)."""
    return unpivot_by_pattern(densio, ["SY", "Site", "Plot"], CANOPY_PATTERN,
                              ["Direction", "Type"], "value", safe_number, prefix=CANOPY_PREFIX)


def calc_columns(densio: DataFrame) -> list[tuple[str, tuple[str, ...]]]:
    """The reading columns with their direction and type."""
    return pattern_columns(densio, CANOPY_PATTERN, CANOPY_PREFIX)


def canopy_cover(densio: DataFrame) -> DataFrame:
    """SY, Site, Type, perc, perc_SE.

    The directions' readings are added up side by side in the wide row and the types
    stacked after the plot level, so the first shuffle carries one row per plot."""
    by_type: dict[str, list[Column]] = {}
    for c, (_, kind) in calc_columns(densio):
        by_type.setdefault(kind, []).append(safe_number(F.col(f"`{c}`")))
    aggs, rows = [], []
    for i, (kind, cells) in enumerate(by_type.items()):
        total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cells])
        present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cells])
        aggs.append(F.try_divide(F.sum(total), F.sum(present)).alias(f"m{i}"))
        rows.append(F.struct(F.lit(kind).alias("Type"), F.col(f"m{i}").alias("perc")))
    plot = densio.groupBy("SY", "Site", "Plot").agg(*aggs).select("SY", "Site", F.inline(F.array(*rows)))
    return plot.groupBy("SY", "Site", "Type").agg(F.avg("perc").alias("perc"), standard_error("perc").alias("perc_SE"))


def cover_table(cover: DataFrame) -> DataFrame:
    """Report table from a ``canopy_cover`` result (see ``canopy_cover_table``)."""
    wide = pivot_fixed(cover, ["SY", "Site"], "Type", COVER_TYPES, ["perc", "perc_SE"],
                       fill_absent=0.0)
    return wide.select(
        "*", *[mean_se_text(f"{t}_perc", f"{t}_perc_SE", 1).alias(COVER_LABELS[t])
               for t in COVER_TYPES])


def canopy_cover_open(densio: DataFrame) -> DataFrame:
    """SY, Site, cells: a map from every Type of the sheet to its struct (perc, perc_SE)."""
    return pivot_open(canopy_cover(densio), ["SY", "Site"], "Type", ["perc", "perc_SE"])


def open_cover_table(wide: DataFrame) -> DataFrame:
    """The report table's columns (see ``canopy_cover_table``) of a ``canopy_cover_open`` result."""
    cells = [open_cell(F.col("cells"), t, v, 0.0).alias(f"{t}_{v}") for t in COVER_TYPES for v in ("perc", "perc_SE")]
    return wide.select("SY", "Site", *cells).select(
        "*", *[mean_se_text(f"{t}_perc", f"{t}_perc_SE", 1).alias(COVER_LABELS[t]) for t in COVER_TYPES])


def open_cover_text(wide: DataFrame) -> DataFrame:
    """SY, Site, n_types, cover: "Type=mean ± SE" of every type of a ``canopy_cover_open`` result, by type."""
    texts = F.transform(F.map_entries("cells"), lambda e: F.concat(
        e["key"], F.lit("="), mean_se_text(e["value"]["perc"], e["value"]["perc_SE"], 1)))
    return wide.select("SY", "Site", F.size("cells").alias("n_types"), F.array_join(texts, "; ").alias("cover"))


def cover_series(cover: DataFrame) -> DataFrame:
    """Plot series from a ``canopy_cover`` result (see ``canopy_cover_series``)."""
    cover = cover.where(F.col("Type").isin(*COVER_TYPES))
    wide = pivot_fixed(cover, ["SY", "Site"], "Type", COVER_TYPES, ["perc"],
                       name="{value}", fill_absent=0.0)
    lo, hi = SERIES_RANGE

    def clip(c):
        return F.when(c.between(lo, hi), c)

    return wide.select("SY", "Site", clip(F.col("Veg")).alias("Alive"),
                       clip(-F.col("Wood")).alias("Dead"), clip(F.col("Open")).alias("Open"))


def canopy_cover_table(densio: DataFrame) -> DataFrame:
    """SY, Site, <Type>_perc, <Type>_perc_SE for Veg/Wood/Open (absent → 0),
    and "mean ± SE" text columns Alive, Dead, Open."""
    return cover_table(canopy_cover(densio))


def canopy_cover_series(densio: DataFrame) -> DataFrame:
    """SY, Site, Alive (= Veg), Dead (= −Wood), Open; absent cells 0, values
    outside the plotted range [−50, 100] set to NULL."""
    return cover_series(canopy_cover(densio))
