"""Binary rounding, open pivots, levels from the data and bars across an axis break."""

from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotstats.functions.expr import binary_round
from plotstats.operators import canopy, regen
from plotstats.plans.levels import factor_levels, with_levels
from plotstats.plans.reshape import open_cell, pivot_open


@pytest.mark.parametrize("digits", [0, 1, 3])
def test_binary_round_is_the_exact_expansions(spark, digits):
    rng = np.random.default_rng(digits)
    halves = (rng.integers(-10**6, 10**6, 150_000) * 2 + 1) / (2 * 10.0**digits)  # ties, or what looks like one
    near = np.concatenate([np.nextafter(halves[:50_000], np.inf), np.nextafter(halves[:50_000], -np.inf)])
    mixed = rng.standard_normal(90_000) * 10.0 ** rng.integers(-12, 11, 90_000)
    x = np.concatenate([halves, near, mixed, [0.0, 5e-324, 0.15, 0.25, 2.5, -0.35]])
    got = spark.createDataFrame(pd.DataFrame({"x": x})).select("x", binary_round("x", digits).alias("r")).toPandas()
    unit = Decimal(1).scaleb(-digits)
    want = np.array([float(Decimal(v).quantize(unit, ROUND_HALF_EVEN)) for v in got["x"].tolist()])
    assert (got["r"].to_numpy() == want).all()


def test_binary_round_beyond_its_range(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1e300,), (-0.04,)], "x double")
    got = [r[0] for r in df.select(binary_round("x", 1)).collect()]
    assert got[0] is None and got[1] != got[1] and got[2:4] == [float("inf"), 1e300]
    assert str(got[4]) == "0.0"
    with pytest.raises(ValueError):
        binary_round("x", 8)


def densiometer(spark):
    cells = {f"Calc_{d}_{t}": "string" for d in "NS" for t in ("Veg", "Wood", "Open", "Rock")}
    schema = "SY int, Site string, Plot string, " + ", ".join(f"`{c}` {t}" for c, t in cells.items())
    return spark.createDataFrame([
        (2022, "A", "p1", "10", "20", "70", "5", "20", "20", "60", "7"),
        (2022, "A", "p2", "30", "NA", "70", "NA", "30", "x", "70", "NA"),
        (2022, None, "q1", "NA", "NA", "NA", "1", "NA", "NA", "NA", "2")], schema)


def test_open_pivot_shows_a_fourth_type_and_keeps_the_table(spark):
    densio = densiometer(spark)
    wide = canopy.canopy_cover_open(densio)
    rows = {r.Site: r.cells for r in wide.collect()}
    assert sorted(rows["A"]) == ["Open", "Rock", "Veg", "Wood"]
    assert rows["A"]["Rock"].perc == 6.0 and rows["A"]["Veg"].perc == 22.5
    assert rows[None]["Veg"].perc is None  # present, without a reading
    table = canopy.canopy_cover_table(densio)
    view = canopy.open_cover_table(wide)
    assert view.columns == table.columns
    assert sorted(map(str, view.collect())) == sorted(map(str, table.collect()))
    text = {r.Site: (r.n_types, r.cover) for r in canopy.open_cover_text(wide).collect()}
    assert text["A"][0] == 4 and "Rock=6 ± NA" in text["A"][1]


def test_open_pivot_absent_null_and_repeated(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, None, None), (2, "b", 3.0)], "k int, t string, v double")
    wide = pivot_open(df, ["k"], "t", ["v"])
    got = {r.k: tuple(r)[1:] for r in wide.select(
        "k", open_cell(F.col("cells"), "a", "v", 0.0), open_cell(F.col("cells"), "NA", "v", 0.0), open_cell(F.col("cells"), "b", "v")).collect()}
    assert got == {1: (2.0, None, None), 2: (0.0, 0.0, 3.0)}
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        pivot_open(df.union(df), ["k"], "t", ["v"]).collect()
    assert pivot_open(df.limit(0), ["k"], "t", ["v"]).collect() == []


def test_levels_are_dense_in_order_and_not_of_one_task(spark):
    df = spark.range(5000).select((F.col("id") % 997 * 3).cast("int").alias("SY"), F.concat(F.lit("s"), F.col("id")).alias("Site"))
    df = df.union(spark.createDataFrame([(None, None)], "SY int, Site string"))
    got = {r.value: r.level for r in factor_levels(df, "SY").collect()}
    assert got == {v * 3: v + 1 for v in range(997)}
    levels = factor_levels(df, "Site")
    names = sorted(f"s{i}" for i in range(5000))
    assert {r.value: r.level for r in levels.collect()} == {v: i for i, v in enumerate(names, 1)}
    back = with_levels(df, "SY", "SY_level")
    assert back.count() == 5001 and back.where("SY is null and SY_level is null").count() == 1
    assert back.where("SY_level <> SY / 3 + 1").count() == 0
    assert factor_levels(df.limit(0), "SY").collect() == []


def test_bars_across_breaks(spark):
    assert regen.axis_panels([(30, 32), (15, 16)]) == [(None, 15.0, 0.0), (16.0, 30.0, 1.0), (32.0, None, 3.0)]
    for bad in ([(2, 1)], [(1, 3), (2, 4)]):
        with pytest.raises(ValueError):
            regen.axis_panels(bad)
    df = spark.createDataFrame([("low", 10.0, 2.0), ("over", 14.0, 3.0), ("in", 15.5, 0.25), ("high", 40.0, None), ("none", None, 1.0), ("minus", -2.0, 1.0)],
                               "Site string, m double, se double")
    got = {(r.Site, r.panel): (r.bar_from, r.bar_to, r.err_from, r.err_to, r["shift"]) for r in regen.bars_across_breaks(df, "m", "se", [(15, 16), (30, 32)]).collect()}
    assert got == {
        ("low", 1): (0.0, 10.0, 10.0, 12.0, 0.0),
        ("over", 1): (0.0, 14.0, 14.0, 15.0, 0.0), ("over", 2): (None, None, 16.0, 17.0, 1.0),
        ("in", 1): (0.0, 15.0, None, None, 0.0),
        ("high", 1): (0.0, 15.0, None, None, 0.0), ("high", 2): (16.0, 30.0, None, None, 1.0), ("high", 3): (32.0, 40.0, None, None, 3.0),
        ("none", 1): (None, None, None, None, 0.0),
        ("minus", 1): (-2.0, 0.0, -2.0, -1.0, 0.0)}
