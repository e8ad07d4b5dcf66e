"""Survey tables derived from the TPC-H-like test tables.

The test data has no survey sheets, so each survey table is a deterministic
view over lineitem / orders / part / supplier / nation / region (the mapping
is spelled out in FIXTURES.md and mirrored by the DuckDB oracle).  Keys:
``SY`` = ship year, ``Island`` = region name, ``Site`` = nation name,
``Plot`` = supplier key, ``Quadrat`` = line number.

Plan notes.  nation (25 rows) and region (5 rows) are fixed-size dimension
tables, so they are broadcast explicitly.  supplier, part and orders grow
with the scale factor and are *not* hinted: AQE measures them after the
scan and broadcasts them only if they are small at runtime, otherwise the
join stays sort-merge.  Every view is lazy; column pruning and filter
pushdown reach the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotstats.plans.nested import PlotReadings

# Fixture parameters (FIXTURES.md): compared survey years and island levels.
BASE_YEAR = 1996
TARGET_YEAR = 2000
ISLANDS = ("AFRICA", "AMERICA", "ASIA")
SIZE_BIN = 3.0
FOCUS_SITE = "NATION_8"
FOCUS_YEAR = 2000
FOCUS_ISLAND = "AMERICA"
KEY_COLS = ("SY", "Island", "Site", "Plot", "Quadrat")


# Declared schemas of the test tables: reading with a schema skips Spark's
# footer-inference job on every read.
TEST_TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
             "p_retailprice double"),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                 "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                 "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TEST_TABLE_SCHEMAS:
        reader = reader.schema(TEST_TABLE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _species_from_flag(flag: Column) -> Column:
    return (F.when(flag == "A", "AVGE").when(flag == "N", "LARA").when(flag == "R", "RHMA"))


def _null_if(cond: Column, value: Column) -> Column:
    return F.when(~cond, value)


def _nation_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation ⋈ region: a fixed-size dimension (25 rows), safe to broadcast."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", F.col("n_name").alias("Site"), F.col("r_name").alias("Island"))


def site_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier ⋈ nation ⋈ region: one row per supplier (plot)."""
    sup = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nr = _nation_region(spark, sf_dir)
    return sup.join(F.broadcast(nr), sup.s_nationkey == nr.n_nationkey).select(
        "s_suppkey", "n_nationkey", "Site", "Island")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ supplier ⋈ nation ⋈ region with the survey keys.

    lineitem meets supplier first, as two plain scans: without table
    statistics Spark sizes a join as the product of its inputs, so joining
    lineitem to a pre-joined supplier⋈nation would make the dimension side
    look larger than lineitem and get lineitem broadcast.  nation⋈region
    (25 rows) is broadcast last.
    """
    li = read(spark, sf_dir, "lineitem")
    sup = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nr = _nation_region(spark, sf_dir)
    j = li.join(sup, li.l_suppkey == sup.s_suppkey)
    return j.join(F.broadcast(nr), j.s_nationkey == nr.n_nationkey).select(
        F.year("l_shipdate").cast("int").alias("SY"),
        "Island", "Site",
        F.col("l_suppkey").alias("Plot"),
        F.col("l_linenumber").alias("Quadrat"),
        "n_nationkey", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus")


PLOT_KEYS = ("SY", "Plot", "Quadrat")


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the survey keys it carries itself."""
    return read(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").cast("int").alias("SY"), F.col("l_suppkey").alias("Plot"),
        F.col("l_linenumber").alias("Quadrat"), "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def _trees(rows: DataFrame, spark: SparkSession, sf_dir: str, keys) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    st = F.col("o_orderstatus")
    mortality = F.when(F.round(F.col("l_tax") * 100) == 8, F.lit("NA")).otherwise(
        F.when(st == "F", "Alive").when(st == "P", "Dying").when(st == "O", "Dead"))
    return (rows.join(o, rows.l_orderkey == o.o_orderkey)
            .select(*keys,
                    _species_from_flag(F.col("l_returnflag")).alias("Species"),
                    mortality.alias("Mortality"),
                    _null_if(F.col("l_quantity") == 50, F.col("l_quantity")).alias("DBH_cm")))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(base(spark, sf_dir), spark, sf_dir, KEY_COLS)


def _with_part(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    return rows.join(p, rows.l_partkey == p.p_partkey)


def _heights(rows: DataFrame, spark: SparkSession, sf_dir: str, keys) -> DataFrame:
    t = F.col("p_type")
    species = (F.when(t == "ECONOMY", "RHMA").when(t == "SMALL", "AVGE")
               .when(t == "MEDIUM", "LARA").when(t == "PROMO", "UNK")
               .when(t == "LARGE", "NA"))
    return _with_part(rows, spark, sf_dir).select(
        *keys, species.alias("Species"),
        _null_if(F.col("p_size") == 50, F.col("p_size") / 2.0).alias("Tree_Height_m"))


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heights(base(spark, sf_dir), spark, sf_dir, KEY_COLS)


def _quadrat_aggregate(spark: SparkSession, sf_dir: str, *aggs: Column) -> DataFrame:
    """Aggregate lineitem per (SY, Plot, Quadrat) *before* attaching the site.

    Island and Site are functions of the supplier (Plot), so grouping by
    (SY, Island, Site, Plot, Quadrat) over lineitem⋈supplier⋈nation⋈region
    equals grouping lineitem by (SY, Plot, Quadrat) and joining the result to
    the supplier dimension (inner joins keep the same groups).  The fact
    table is then shuffled once, as partial aggregates, and only one row per
    plot, quadrat and year meets the joins.
    """
    li = read(spark, sf_dir, "lineitem")
    g = li.groupBy(F.year("l_shipdate").cast("int").alias("SY"), F.col("l_suppkey").alias("Plot"),
                   F.col("l_linenumber").alias("Quadrat")).agg(*aggs)
    sup = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nr = _nation_region(spark, sf_dir)
    j = g.join(sup, g.Plot == sup.s_suppkey)
    return j.join(F.broadcast(nr), j.s_nationkey == nr.n_nationkey).drop(
        "s_suppkey", "s_nationkey", "n_nationkey")


def regeneration(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, stage = F.col("l_returnflag"), F.col("l_linestatus")
    counts = []
    for code, f in (("RHMA", "R"), ("LARA", "N"), ("AVGE", "A")):
        for name, s in (("seedlings", "F"), ("saplings", "O")):
            counts.append(F.count(F.when((flag == f) & (stage == s), 1)).cast("double")
                          .alias(f"{code}_{name}"))
    g = _quadrat_aggregate(spark, sf_dir, *counts, F.max("l_quantity").alias("Tall_seedling_cm"))
    return g.select(
        *KEY_COLS,
        _null_if((F.col("Quadrat") == 7) & (F.col("Plot") % 5 == 0), F.col("RHMA_seedlings"))
        .alias("RHMA_seedlings"),
        "RHMA_saplings", "LARA_seedlings", "LARA_saplings", "AVGE_seedlings", "AVGE_saplings",
        _null_if(F.col("Quadrat") % 2 == 0, F.col("Tall_seedling_cm")).alias("Tall_seedling_cm"))


def _saplings(rows: DataFrame, spark: SparkSession, sf_dir: str, keys) -> DataFrame:
    return rows.where(F.col("l_linestatus") == "O").select(
        *keys,
        _species_from_flag(F.col("l_returnflag")).alias("Species"),
        _null_if(F.col("l_quantity") == 50, F.col("l_extendedprice") / 100).alias("Height_cm"))


def saplings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saplings(base(spark, sf_dir), spark, sf_dir, KEY_COLS)


def densiometer(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _quadrat_aggregate(spark, sf_dir, F.sum("l_quantity").cast("int").alias("q"))
    cols = []
    for d, direction in enumerate("NSEW"):
        qd = F.col("q") + d
        veg, wood = qd % 60, qd % 25
        for name, v in (("Veg", veg), ("Wood", wood), ("Open", 100 - veg - wood)):
            text = v.cast("string")
            if direction == "W":
                text = F.when(F.col("Quadrat") == 7, F.lit("NA")).otherwise(text)
            cols.append(text.alias(f"Calc_{direction}_{name}"))
    return g.select(*KEY_COLS, *cols)


def _ysi(rows: DataFrame, spark: SparkSession, sf_dir: str, keys) -> DataFrame:
    return _with_part(rows, spark, sf_dir).select(
        *keys,
        _null_if(F.col("l_quantity") == 50, F.col("l_quantity")).alias("Water_depth"),
        (F.lit(20.0) + F.col("l_discount") * 100).alias("Temp"),
        (F.col("l_tax") * 100).alias("DO_mg_L"),
        F.col("p_size").cast("double").alias("Salinity_ppt"),
        F.col("l_extendedprice").alias("TDS"))


def ysi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ysi(base(spark, sf_dir), spark, sf_dir, KEY_COLS)


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sd = site_dim(spark, sf_dir)
    k = F.col("s_suppkey")
    frac = (k % 100).cast("double") / 100.0
    forest = F.when(k % 3 == 0, "Basin").when(k % 3 == 1, "Fringe").otherwise("Salt Pond")
    return sd.select(
        "Island", "Site", k.alias("Plot"), forest.alias("Forest type"),
        _null_if(k % 40 == 0, F.lit(17.0) + frac).alias("Latitude"),
        (F.lit(-65.0) + frac).alias("Longitude"),
        k.alias("Row"))


BUILDERS = {
    "trees": trees,
    "heights": heights,
    "coordinates": coordinates,
    "densiometer": densiometer,
    "regeneration": regeneration,
    "saplings": saplings,
    "ysi": ysi,
}


# tables of single readings, which carry their plot themselves
READINGS = {"trees": _trees, "heights": _heights, "saplings": _saplings, "ysi": _ysi}


def plot_readings(spark: SparkSession, sf_dir: str, name: str) -> PlotReadings:
    """A table of readings without its site, and the plots' sites: operators attach the
    site after they have aggregated per plot, so lineitem never meets supplier."""
    rows = READINGS[name](_readings(spark, sf_dir), spark, sf_dir, PLOT_KEYS)
    plots = site_dim(spark, sf_dir).select(F.col("s_suppkey").alias("Plot"), "Island", "Site")
    return PlotReadings(rows, plots)


def survey_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All seven survey tables as lazy DataFrames."""
    return {name: fn(spark, sf_dir) for name, fn in BUILDERS.items()}
