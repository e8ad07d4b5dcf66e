"""Reading → plot → site aggregation.

Survey statistics are means of means: readings (or quadrats, or stems) are
first reduced per plot, the plot values are then averaged per site with a
standard error across plots.  ``nested_stats`` expresses one such chain as
a sequence of ``groupBy().agg()`` calls, innermost first, each measure
carrying its own aggregate and NULL policy per level.

Physical shape: every level is a partial ``HashAggregate`` → hash exchange
on that level's keys → final ``HashAggregate``.  Only the first exchange
carries data proportional to the input (and only after map-side combine, so
a hot site or plot sends one partial row per task, not its readings); the
later exchanges carry one row per plot.

Repartitioning the readings by the outer keys first would let every level
run without a second exchange, but it shuffles raw rows without map-side
combine and puts a hot plot or site into a single task — so the chain keeps
one exchange per level on purpose.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotstats.functions.aggregates import AGGS, mean_prop, standard_error
from plotstats.functions.expr import col


@dataclass(frozen=True)
class PlotReadings:
    """Readings that carry their Plot but not its Island and Site, with the table that
    files every plot (one row per Plot).

    Operators take it in place of a survey table: they aggregate per plot first and
    attach the site to the aggregates, so the readings are never shuffled for it."""

    rows: DataFrame
    plots: DataFrame

    def where(self, condition) -> PlotReadings:
        """Filter on reading columns."""
        return PlotReadings(self.rows.where(condition), self.plots)

    def select(self, *columns) -> DataFrame:
        return self.rows.select(*columns)


# plots that are broadcast to their readings: a row is under 100 bytes, so 50 MB at most
BROADCAST_PLOTS = 500_000


def sited_rows(readings: PlotReadings, *keys: str) -> DataFrame | None:
    """The readings with Site and / or Island of their plots (readings of other plots are left out), by a broadcast
    of the plots; None if there are more plots than ``BROADCAST_PLOTS`` (counted, no further than that)."""
    plots = readings.plots.select("Plot", *keys)
    if plots.limit(BROADCAST_PLOTS + 1).count() > BROADCAST_PLOTS:
        return None
    return readings.rows.join(F.broadcast(plots), "Plot")


def plot_groups(df: DataFrame | PlotReadings, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """``groupBy(keys).agg(aggs)`` for keys that include Plot; of ``PlotReadings`` the
    Island and Site are joined to the groups."""
    if not isinstance(df, PlotReadings):
        return df.groupBy(*keys).agg(*aggs)
    filed = [k for k in keys if k in ("Island", "Site")]
    groups = df.rows.groupBy(*[k for k in keys if k not in filed]).agg(*aggs)
    values = groups.columns[len(keys) - len(filed):]
    return groups.join(df.plots.select("Plot", *filed), "Plot").select(*keys, *values)


@dataclass(frozen=True)
class Measure:
    """One measure of a nested aggregation.

    name   – output column at the last level (also the running column name)
    value  – reading-level value (column name or expression)
    aggs   – aggregate per level, innermost first: "mean", "mean_prop",
             "sum" (NULLs skipped, all-NULL → 0), "count", "max", "min"
    se     – standard error of the previous level's values at the last
             level: "skip", "prop" or None
    se_name – defaults to ``name + "_SE"``
    fill   – replace a NULL mean / SE by this value after the last level
    """

    name: str
    value: Column | str
    aggs: tuple[str, ...]
    se: str | None = "skip"
    se_name: str | None = None
    fill: float | None = None

    @property
    def se_col(self) -> str:
        return self.se_name or f"{self.name}_SE"


def nested_stats(df: DataFrame | PlotReadings, levels: Sequence[Sequence[str]],
                 measures: Sequence[Measure]) -> DataFrame:
    """Aggregate ``measures`` through ``levels`` (list of key lists,
    innermost first; each list should contain the next one)."""
    if not measures:
        raise ValueError("no measures")
    for m in measures:
        if len(m.aggs) != len(levels):
            raise ValueError(f"{m.name}: {len(m.aggs)} aggregates for {len(levels)} levels")
    own = [k for k in levels[0] if not (isinstance(df, PlotReadings) and k in ("Island", "Site"))]
    cur = df.select(*own, *[col(m.value).alias(m.name) for m in measures])
    if isinstance(df, PlotReadings):
        cur = PlotReadings(cur, df.plots)
    last = len(levels) - 1
    for k, keys in enumerate(levels):
        exprs = []
        for m in measures:
            exprs.append(AGGS[m.aggs[k]](m.name).alias(m.name))
            if k == last and m.se is not None:
                exprs.append(standard_error(m.name, na_rm=(m.se == "skip")).alias(m.se_col))
        cur = plot_groups(cur, keys, *exprs)
    fills = {}
    for m in measures:
        if m.fill is not None:
            fills[m.name] = F.coalesce(F.col(m.name), F.lit(float(m.fill)))
            if m.se is not None:
                fills[m.se_col] = F.coalesce(F.col(m.se_col), F.lit(float(m.fill)))
    return cur.withColumns(fills) if fills else cur


__all__ = ["Measure", "PlotReadings", "nested_stats", "plot_groups", "sited_rows", "mean_prop"]
