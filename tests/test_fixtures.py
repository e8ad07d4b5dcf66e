"""The survey-table mapping matches the facts stated in FIXTURES.md (sf0.01)."""

import pytest
from pyspark.sql import functions as F

from plotstats.operators import stand
from plotstats.sources import fixtures as fx

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return fx.survey_tables(spark, SF)


def test_row_counts(tables):
    got = {name: df.count() for name, df in tables.items()}
    assert got == {"trees": 60000, "heights": 60000, "regeneration": 4900, "saplings": 30064,
                   "densiometer": 4900, "ysi": 60000, "coordinates": 100}


def test_injected_missing_values(spark, tables):
    d = tables["densiometer"]
    assert d.where(F.col("Calc_W_Veg") == "NA").count() == 700
    every_40th = fx.read(spark, SF, "supplier").where(F.col("s_suppkey") % 40 == 0).count()
    assert tables["coordinates"].where(F.col("Latitude").isNull()).count() == every_40th > 0
    t = tables["trees"]
    # every site has every year; one-plot site-years exist (nations 12 and 20)
    live = stand.mean_basal_area(t)
    assert live.count() == 175
    assert live.where((F.col("mean_basal_area_SE") == 0) &
                      F.col("Site").isin("NATION_12", "NATION_20")).count() > 0
