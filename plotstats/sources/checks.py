"""What a sheet's cells and keys are like before statistics rely on them.

*Coercion.*  Numbers are parsed quietly: a cell that is no number becomes NULL.  ``coercion_counts`` tells how
many cells of each column that hit, in one scan; ``observed`` counts them in the scan that
loads the table, through an ``Observation``; ``rejected_cells`` lists them.

*Keys.*  ``key_profile`` counts how often the keys of a table repeat, all key sets in one scan by
grouping sets; ``unfiled_keys`` finds plots, sites and islands that the coordinates sheet lacks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plotstats.functions.aggregates import n_rows
from plotstats.functions.expr import safe_number
from plotstats.sources.io import conform, typed
from plotstats.sources.schemas import CANOPY_PREFIX, table_schema

# key sets that name a quadrat, a plot and a site in every sheet that has the columns
KEY_SETS = (("SY", "Site", "Plot", "Quadrat"), ("SY", "Site", "Plot"), ("Site", "Plot"), ("Island", "Site"))


def _parsed(df: DataFrame, name: str) -> list[tuple[str, Column, Column]]:
    """(column, cell as text, parsed value) of the columns that are parsed: the declared numbers, and the
    densiometer's readings, which the canopy statistics parse."""
    out = []
    for f in table_schema(name, df.columns).fields:
        if f.name not in df.columns:
            continue
        cell = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, StringType):
            out.append((f.name, cell.cast("string"), typed(cell, f.dataType)))
        elif f.name.startswith(CANOPY_PREFIX):
            out.append((f.name, cell, safe_number(cell)))
    return out


def coercion_counts(raw: DataFrame, name: str) -> DataFrame:
    """table_name, column_name, n_cells, n_empty (NULL), n_rejected (text that is no number), example
    (the least rejected text) of every parsed column of a sheet as it was read."""
    aggs, rows = [n_rows().alias("n")], []
    for i, (c, cell, value) in enumerate(_parsed(raw, name)):
        rejected = cell.isNotNull() & value.isNull()
        aggs += [F.count(F.when(cell.isNull(), 1)).alias(f"e{i}"), F.count(F.when(rejected, 1)).alias(f"r{i}"),
                 F.min(F.when(rejected, cell)).alias(f"x{i}")]
        rows.append(F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_cells"), F.col(f"e{i}").alias("n_empty"),
                             F.col(f"r{i}").alias("n_rejected"), F.col(f"x{i}").alias("example")))
    return raw.agg(*aggs).select(F.lit(name).alias("table_name"), F.inline(F.array(*rows)))


def coercion_report(raw: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [coercion_counts(df, name) for name, df in raw.items()])


def observed(raw: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The typed table, and the number of rejected cells by column, counted by the action that first
    uses the table (``Observation.get``)."""
    seen = Observation(f"{name}-rejected")
    counts = [F.count(F.when(cell.isNotNull() & value.isNull(), 1)).alias(c) for c, cell, value in _parsed(raw, name)]
    return conform(raw.observe(seen, *counts), name), seen


def rejected_cells(raw: DataFrame, name: str) -> DataFrame:
    """The rows' other columns with column_name and cell, for every cell that was rejected."""
    cells = [F.struct(F.lit(c).alias("column_name"), cell.alias("cell"), (cell.isNotNull() & value.isNull()).alias("bad"))
             for c, cell, value in _parsed(raw, name)]
    others = [F.col(f"`{f.name}`") for f in table_schema(name, raw.columns).fields
              if f.name in raw.columns and f.name not in {c for c, _, _ in _parsed(raw, name)}]
    return raw.select(*others, F.inline(F.filter(F.array(*cells), lambda x: x["bad"]))).drop("bad")


# --- keys -------------------------------------------------------------------------


def key_profile(df: DataFrame, name: str, key_sets: Sequence[Sequence[str]] = KEY_SETS) -> DataFrame:
    """table_name, key_columns, n_keys, n_repeated (keys of more than one row), max_rows, n_null (rows with a
    NULL in the key): one scan, every key set as a grouping set."""
    sets = [list(k) for k in key_sets if set(k) <= set(df.columns)]
    columns = list(dict.fromkeys(c for k in sets for c in k))
    groups = df.groupingSets(sets, *columns).agg(n_rows().alias("n"), F.grouping_id(*columns).alias("g"))
    bit = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
    label = null = None
    for k in sets:
        here = F.col("g") == sum(b for c, b in bit.items() if c not in k)
        missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in k])
        label = (F.when if label is None else label.when)(here, F.lit(", ".join(k)))
        null = (F.when if null is None else null.when)(here, missing)
    groups = groups.select(label.alias("key_columns"), "n", null.alias("has_null"))
    return groups.groupBy("key_columns").agg(
        n_rows().alias("n_keys"), F.count(F.when(F.col("n") > 1, 1)).alias("n_repeated"), F.max("n").alias("max_rows"),
        F.coalesce(F.sum(F.when(F.col("has_null"), F.col("n"))), F.lit(0)).alias("n_null")).select(
        F.lit(name).alias("table_name"), "*")


def key_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [key_profile(df, name) for name, df in tables.items()])


def unfiled_keys(tables: Mapping[str, DataFrame], coords: DataFrame) -> DataFrame:
    """table_name, key_columns, n_keys, n_unfiled: distinct plots, sites and islands of the sheets, and how many
    of them the coordinates lack (NULL matches NULL).  Rows are reduced to distinct keys before any join."""
    filed = [("Site", "Plot"), ("Island", "Site")]
    out = []
    for k in filed:
        keys = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("table_name"), *[F.col(c).cast("string").alias(c) for c in k]).distinct()
                                              for n, df in tables.items() if set(k) <= set(df.columns)])
        known = coords.select(*[F.col(c).cast("string").alias(f"__{c}") for c in k]).distinct().withColumn("__known", F.lit(1))
        same = reduce(lambda a, b: a & b, [keys[c].eqNullSafe(known[f"__{c}"]) for c in k])
        out.append(keys.join(known, same, "left").groupBy("table_name").agg(
            n_rows().alias("n_keys"), F.count(F.when(F.col("__known").isNull(), 1)).alias("n_unfiled")).select(
            "table_name", F.lit(", ".join(k)).alias("key_columns"), "n_keys", "n_unfiled"))
    return reduce(DataFrame.unionByName, out)
