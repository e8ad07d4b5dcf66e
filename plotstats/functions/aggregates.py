"""Aggregate Column expressions with explicit missing-value policies.

"skip" drops NULLs (R's ``na.rm = TRUE``); "prop" makes the result NULL as
soon as one input is NULL.  All are built-in aggregates, so Spark plans them
as partial + final ``HashAggregate`` (map-side combine before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotstats.functions.expr import col


def n_rows() -> Column:
    return F.count(F.lit(1))


def all_present(c: Column | str) -> Column:
    return F.count(col(c)) == n_rows()


def mean_skip(c: Column | str) -> Column:
    return F.avg(col(c))


def mean_prop(c: Column | str) -> Column:
    return F.when(all_present(c), F.avg(col(c)))


def sum_skip(c: Column | str) -> Column:
    """Sum ignoring NULLs; a group of only NULLs sums to 0."""
    return F.coalesce(F.sum(col(c)).cast("double"), F.lit(0.0))


def standard_error(c: Column | str, na_rm: bool = True) -> Column:
    """Sample standard deviation / sqrt(n).  One value → NULL (as sd of one
    value is undefined); with ``na_rm=False`` any NULL → NULL."""
    c = col(c)
    se = F.try_divide(F.stddev_samp(c), F.sqrt(F.count(c)))
    return se if na_rm else F.when(all_present(c), se)


def moment_state(c: Column | str, name: str) -> list[Column]:
    """Aggregates that describe the values of a group and can be merged with those of others:
    <name>_rows, <name>_n (non-NULL), <name>_mean and <name>_m2 (squared deviations from the mean)."""
    c = col(c)
    return [n_rows().alias(f"{name}_rows"), F.count(c).alias(f"{name}_n"), F.avg(c).alias(f"{name}_mean"),
            (F.var_pop(c) * F.count(c)).alias(f"{name}_m2")]


def merge_states(name: str) -> list[Column]:
    """The state of several groups together, as aggregates over their states: deviations within the
    groups, and those of the groups' means from the common mean."""
    n, mean = F.col(f"{name}_n"), F.col(f"{name}_mean")
    total, weighted = F.sum(n), F.sum(n * mean)
    between = F.sum(n * mean * mean) - F.try_divide(weighted * weighted, total)
    return [F.sum(f"{name}_rows").alias(f"{name}_rows"), total.alias(f"{name}_n"), F.try_divide(weighted, total).alias(f"{name}_mean"),
            (F.sum(f"{name}_m2") + F.greatest(between, F.lit(0.0))).alias(f"{name}_m2")]


def state_error(name: str, na_rm: bool = True) -> Column:
    """The standard error of a state's values (see ``standard_error``)."""
    n = F.col(f"{name}_n")
    se = F.when(n > 1, F.sqrt(F.try_divide(F.col(f"{name}_m2"), n - 1)) / F.sqrt(n))
    return se if na_rm else F.when(n == F.col(f"{name}_rows"), se)


AGGS = {
    "mean": mean_skip,
    "mean_prop": mean_prop,
    "sum": sum_skip,
    "count": lambda c: n_rows().cast("double"),
    "max": lambda c: F.max(col(c)),
    "min": lambda c: F.min(col(c)),
}
