"""Merging per-key result tables.

Survey results are combined by key the way a chain of NULL-matching full
outer joins would (``NULL`` keys match each other).  When every input holds
at most one row per key — true for all statistics here, which are
aggregates keyed by exactly those columns — the chain equals
``union`` + ``groupBy(keys)``: one shuffle instead of one per join, no
join-order or build-side decisions, and NULL keys group together just as
they match in a NULL-safe join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_outer(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer merge on ``keys`` of inputs that are unique on ``keys``; a key that
    repeats in an input raises when the merge runs.  Columns keep first-seen
    order; a value column must come from one input."""
    keys = list(keys)
    order: list[str] = []
    for f in frames:
        for c in f.columns:
            if c not in keys and c in order:
                raise ValueError(f"column {c!r} comes from more than one input")
            if c not in keys:
                order.append(c)
    unioned = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _numbered(frames))
    merged = unioned.groupBy(*keys).agg(*_once(len(frames)), *[F.max(c).alias(c) for c in order])
    return merged.select(*_guarded(keys, len(frames)), *order)


def _numbered(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """Each input with a column of its own that counts its rows."""
    return [f.withColumn(f"__from{i}", F.lit(1)) for i, f in enumerate(frames)]


def _once(n: int) -> list[Column]:
    return [F.count(f"__from{i}").alias(f"__from{i}") for i in range(n)]


def _guarded(keys: Sequence[str], n: int) -> list[Column]:
    """The keys; the first one fails the row if an input held its key more than once,
    so the check cannot be pruned away while any key is used."""
    most = F.greatest(*[F.col(f"__from{i}") for i in range(n)]) if n > 1 else F.col("__from0")
    fail = F.raise_error(F.lit(f"an input of the merge repeats a key of ({', '.join(keys)})"))
    first = F.when(most > 1, fail).otherwise(F.col(keys[0])).alias(keys[0])
    return [first, *map(F.col, keys[1:])]


def left_join_nullsafe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join matching NULL keys to NULL keys; right-hand key columns are
    dropped.  The right side is not hinted: AQE broadcasts it after measuring
    it at runtime and keeps a sort-merge join otherwise."""
    keys = list(keys)
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys])
    return left.join(r, cond, "left").drop(*[f"__r_{k}" for k in keys])


def left_merge(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on ``keys`` of two inputs that are each unique on ``keys``
    (NULL keys match), as union + groupBy + a presence filter; a repeated key
    raises when the merge runs.

    When both inputs are aggregates keyed by ``keys`` they are already
    hash-partitioned on them, so this needs no exchange at all — a
    NULL-safe join would re-shuffle both sides on coalesce/isnull keys.
    """
    keys = list(keys)
    lcols = [c for c in left.columns if c not in keys]
    rcols = [c for c in right.columns if c not in keys and c not in lcols]
    left, right = _numbered([left, right.select(*keys, *rcols)])
    merged = left.unionByName(right, allowMissingColumns=True).groupBy(*keys).agg(
        *_once(2), *[F.max(c).alias(c) for c in lcols + rcols])
    return merged.where(F.col("__from0") > 0).select(*_guarded(keys, 2), *lcols, *rcols)
