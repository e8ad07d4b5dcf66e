"""Long/wide reshapes with a fixed output schema.

* ``unpivot_by_pattern`` – wide measurement columns whose *names* encode one
  or more dimensions (``Calc_N_Veg``, ``RHMA_seedlings``) → long rows.  The
  names are parsed once on the driver from the schema (no data access); the
  rows are produced by one ``inline(array(struct…))`` generator, so the
  reshape is a narrow, codegen'd projection with no shuffle.
* ``pivot_fixed`` – long → wide with the pivot values passed explicitly
  (no discovery job; a stable schema), optionally telling an *absent* cell
  apart from a present NULL so that only absent cells get a fill value.
* ``pivot_open`` – long → wide for whatever values the data hold: the cells of a row
  are a map, so there is no discovery job and the schema stays the same when a
  value comes up that no one listed.  ``open_cell`` reads one of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern_columns(df: DataFrame, pattern: str, prefix: str | None = None) -> list[tuple[str, tuple[str, ...]]]:
    """Columns whose name holds a match of ``pattern``, with their captured groups.
    With ``prefix`` exactly the columns so named are taken, and one that does not
    match raises instead of vanishing."""
    rx = re.compile(pattern)
    found = [(c, m.groups()) for c in df.columns if c.startswith(prefix or "") and (m := rx.search(c))]
    names = {c for c, _ in found}
    odd = [c for c in df.columns if prefix and c.startswith(prefix) and c not in names]
    if odd:
        raise ValueError(f"column(s) {', '.join(odd)} do not match {pattern!r}")
    if not found:
        raise ValueError(f"no column matches {pattern!r}")
    return found


def unpivot_by_pattern(df: DataFrame, ids: Sequence[str], pattern: str,
                       names_to: Sequence[str], value_name: str = "value",
                       value_fn: Callable[[Column], Column] | None = None,
                       prefix: str | None = None) -> DataFrame:
    """Melt every column matching ``pattern``; its capture groups become the
    ``names_to`` columns.  ``value_fn`` converts each value (e.g. a quiet
    numeric cast) before stacking, so all stacked values share one type.
    ``prefix`` as in ``pattern_columns``."""
    matched = pattern_columns(df, pattern, prefix)
    for _, groups in matched:
        if len(groups) != len(names_to):
            raise ValueError("names_to must name every capture group")
    fn = value_fn or (lambda c: c)
    rows = [
        F.struct(*[F.lit(g).alias(n) for g, n in zip(groups, names_to)],
                 fn(F.col(f"`{c}`")).alias(value_name))
        for c, groups in matched
    ]
    return df.select(*ids, F.inline(F.array(*rows)))


def pivot_fixed(df: DataFrame, keys: Sequence[str], pivot_col: str, values: Sequence[str],
                value_cols: Sequence[str], name: str = "{value}_{col}",
                fill_absent: float | None = None) -> DataFrame:
    """One row per ``keys``; for every pivot value ``v`` and value column
    ``c`` a column ``name.format(value=v, col=c)``.  The input must hold at
    most one row per (keys, pivot value).  With ``fill_absent`` a cell whose
    row is missing becomes that value while a present NULL stays NULL."""
    aggs = [F.max(F.col(c)).alias(c) for c in value_cols]
    if fill_absent is not None:
        aggs.append(F.count(F.lit(1)).alias("__n"))
    wide = df.groupBy(*keys).pivot(pivot_col, list(values)).agg(*aggs)
    out = [F.col(k) for k in keys]
    for v in values:
        for c in value_cols:
            cell = F.col(f"`{v}_{c}`")
            if fill_absent is not None:
                # pivot yields NULL (not 0) for the count of a value with no rows
                absent = F.coalesce(F.col(f"`{v}___n`"), F.lit(0)) == 0
                cell = F.when(absent, F.lit(float(fill_absent))).otherwise(cell)
            out.append(cell.alias(name.format(value=v, col=c)))
    return wide.select(*out)


def pivot_open(df: DataFrame, keys: Sequence[str], pivot_col: str, value_cols: Sequence[str],
               name: str = "cells", missing: str = "NA") -> DataFrame:
    """One row per ``keys`` with a map ``name`` from each pivot value that the data hold to a struct of
    ``value_cols``; a NULL pivot value is filed under ``missing``.  An absent cell has no entry, a present
    NULL has one.  The input must hold at most one row per (keys, pivot value): a second one raises, and
    a row's map is as long as the pivot values are many."""
    key = F.coalesce(F.col(pivot_col).cast("string"), F.lit(missing)).alias("key")
    entry = F.struct(key, F.struct(*value_cols).alias("value"))
    return df.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))


def open_cell(cells: Column, key: str, value_col: str, fill_absent: float | None = None) -> Column:
    """One value of a ``pivot_open`` map; with ``fill_absent`` an absent cell becomes that value."""
    cell = F.try_element_at(cells, F.lit(key))[value_col]
    if fill_absent is None:
        return cell
    return F.when(F.map_contains_key(cells, key), cell).otherwise(F.lit(float(fill_absent)))
