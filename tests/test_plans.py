"""Plan checks: what Spark actually runs for the registered queries."""

import os
import re

import pytest

from plotstats import catalog
from plotstats.operators import sizes, stand
from plotstats.plans.session import scratch_path
from plotstats.sources import fixtures as fx
from plotstats.sources import io

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "PythonUDF")
PLAN_QUERIES = [n for n in catalog.QUERIES if n not in ("load_tables", "export_results")]


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAN_QUERIES)
def test_no_python_in_plan_and_no_unpartitioned_window(spark, name):
    plan = plan_text(catalog.QUERIES[name](spark, SF))
    for node in PYTHON_NODES:
        assert node not in plan, f"{name}: {node}"
    windows = [line for line in plan.splitlines() if re.search(r"(^|- )Window \[", line)]
    for line in windows:
        # "Window [exprs], [partition keys]" optionally followed by ", [order keys]"
        m = re.search(r"\], \[([^\[\]]*)\](?:, \[[^\[\]]*\])?\s*$", line)
        assert m and m.group(1).strip(), f"{name}: window without partition keys: {line}"
    if name.startswith("size_freq"):
        assert windows, f"{name}: expected a partitioned window"


def test_fused_tree_summary_scans_trees_once(spark):
    plan = plan_text(catalog.QUERIES["tree_summary"](spark, SF))
    # one lineitem scan for trees (with orders) and one for heights (with part)
    assert plan.count("lineitem.parquet") == 2
    assert plan.count("orders.parquet") == 1 and plan.count("part.parquet") == 1


def test_year_filter_prunes_partitions(spark):
    root = scratch_path(spark, "prune")
    tables = fx.survey_tables(spark, SF)
    io.write_survey_tables({"trees": tables["trees"]}, root)
    trees = io.load_tables(spark, root, names=["trees"])["trees"]
    df = sizes.size_freq_by_site(trees, 2000, 3.0)
    plan = plan_text(df)
    assert re.search(r"PartitionFilters: \[.*SY.*= 2000", plan), plan
    assert re.search(r"ReadSchema: struct<(Site:string|Mortality:string|DBH_cm:double|,){5}>", plan), plan
    assert df.count() > 0


def test_site_filter_reaches_scan(spark):
    root = scratch_path(spark, "push")
    io.write_survey_tables({"trees": fx.trees(spark, SF)}, root, partition_by_year=False)
    trees = io.load_tables(spark, root, names=["trees"])["trees"]
    plan = plan_text(stand.mean_basal_area(trees.where("Site = 'NATION_8'")))
    assert re.search(r"PushedFilters: \[.*EqualTo\(Site,NATION_8\)", plan), plan


def test_loader_round_trip_formats(spark, tmp_path):
    t = fx.trees(spark, SF)
    for fmt in io.FORMATS:
        root = scratch_path(spark, f"fmt-{fmt}")
        io.write_survey_tables({"trees": t}, root, fmt=fmt)
        back = io.load_tables(spark, root, fmt=fmt, names=["trees"])["trees"]
        expected = io.conform(t, "trees")
        assert back.schema == expected.schema
        assert back.exceptAll(expected).isEmpty() and expected.exceptAll(back).isEmpty()


def test_library_never_collects():
    bad = []
    for sub in ("operators", "plans", "functions", "sources"):
        d = os.path.join(ROOT, "plotstats", sub)
        for f in os.listdir(d):
            if f.endswith(".py"):
                src = open(os.path.join(d, f)).read()
                for pat in (".collect(", ".toPandas(", ".take(", "localCheckpoint", "udf("):
                    bad += [(f, pat)] * src.count(pat)
    # the survey years that become columns, bounded by MAX_YEARS
    assert bad == [("stand.py", ".collect(")]


def test_report_in_csv_reuses_written_statistics(spark):
    from plotstats.plans import report

    tables = fx.survey_tables(spark, SF)
    out = scratch_path(spark, "report-csv")
    written = report.export_report(spark, tables, out, fmt="csv", island_levels=fx.ISLANDS)
    assert set(written) == {
        "tree_summary", "canopy_cover", "seedling_density", "seedling_table", "sapling_density",
        "sapling_table", "mean_water_quality", "size_freq_all", "tree_summary_display",
        "canopy_cover_table", "canopy_cover_series", "water_quality_table"}
    direct = stand.tree_summary_display(stand.tree_summary(tables["trees"], tables["heights"]))
    back = written["tree_summary_display"]
    assert back.schema.fieldNames() == direct.schema.fieldNames()
    assert sorted(r.Basal_Area for r in back.collect()) == sorted(r.Basal_Area for r in direct.collect())
    assert os.path.isdir(f"{out}/size_freq_all/Site=NATION_8")
    assert dict(written["size_freq_all"].dtypes)["Site"] == "string"


def test_api_exports_every_survey_operator():
    from plotstats import api

    for name in catalog.QUERIES:
        if name not in ("standard_error", "basal_area", "size_class_label", "mean_se_text",
                        "species_display_name", "load_tables", "export_results", "sapling_density_species",
                        "row_order_on_load", "workbook_scan"):
            assert callable(getattr(api, name)), name
    for name in api.__all__:
        assert callable(getattr(api, name)), name


def test_csv_loader_keeps_text_na_and_nulls_numeric_na(spark):
    root = scratch_path(spark, "csv-na")
    os.makedirs(f"{root.replace('file:', '')}/heights", exist_ok=True)
    with open(f"{root.replace('file:', '')}/heights/part-0.csv", "w") as f:
        f.write("SY,Island,Site,Plot,Quadrat,Species,Tree_Height_m\n")
        f.write("2022,I,A,p1,1,NA,5.0\n")       # text "NA" species: excluded from heights
        f.write("2022,I,A,p1,1,,7.0\n")         # empty species: NULL, kept
        f.write("2022,I,A,p1,1,RHMA,NA\n")      # "NA" height: NULL, skipped by the mean
    h = io.load_tables(spark, root, fmt="csv", names=["heights"])["heights"]
    assert {(r.Species, r.Tree_Height_m) for r in h.collect()} == {
        (None, 7.0), ("NA", 5.0), ("RHMA", None)}
    assert stand.mean_tree_height(h).first().mean_height == 7.0


def _children(node):
    ch = node.children()
    return [ch.apply(i) for i in range(ch.size())]


def _raw_row_exchanges(node, found):
    """Exchanges whose input reaches a file scan without an aggregate on the way."""
    def reaches_scan(n):
        name = n.nodeName()
        if "Scan" in name:
            return True
        if name in ("HashAggregate", "ObjectHashAggregate", "SortAggregate") or "Exchange" in name:
            return False
        return any(reaches_scan(c) for c in _children(n))

    if node.nodeName() == "Exchange" and any(reaches_scan(c) for c in _children(node)):
        found.append(node.toString().splitlines()[0][:120])
    for c in _children(node):
        _raw_row_exchanges(c, found)
    return found


def test_stored_tables_never_shuffle_raw_rows(spark):
    """Over stored survey tables every shuffle carries aggregated rows: each
    hash exchange has an aggregate between it and the scan below it."""
    root = scratch_path(spark, "raw-shuffle")
    io.write_survey_tables(fx.survey_tables(spark, SF), root)
    tables = io.load_tables(spark, root)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        offenders = {}
        with catalog.stored_tables(tables):
            for name in PLAN_QUERIES:
                plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan()
                found = _raw_row_exchanges(plan, [])
                if found:
                    offenders[name] = found
        assert not offenders, offenders
        # control: a raw repartition is detected
        raw = tables["trees"].repartition(8, "Site")._jdf.queryExecution().executedPlan()
        assert _raw_row_exchanges(raw, [])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_loader_reads_nan_as_null(spark):
    root = scratch_path(spark, "nan")
    rest = dict.fromkeys(("Temp", "DO_mg_L", "Salinity_ppt", "TDS"), 1.0)
    df = spark.createDataFrame([{"SY": 2022, "Island": "I", "Site": "A", "Plot": "p1", "Quadrat": 1, "Water_depth": d, **rest}
                                for d in (float("nan"), float("inf"), 10.0)])
    df.write.parquet(f"{root}/ysi")
    y = io.load_tables(spark, root, names=["ysi"])["ysi"]
    assert sorted(str(r.Water_depth) for r in y.collect()) == ["10.0", "None", "None"]
    from plotstats.operators import water
    assert water.mean_water_quality(y).first().mean_depth == 10.0


# --- reading by name, stored against derived tables --------------------------------

def _csv(root, name, lines):
    os.makedirs(f"{root}/{name}", exist_ok=True)
    with open(f"{root}/{name}/part-0.csv", "w") as f:
        f.write("\n".join(lines) + "\n")


def test_csv_is_read_by_header_name(spark, tmp_path):
    _csv(tmp_path, "trees", ["Site,DBH_cm,Notes,SY,Species,Mortality,Plot,Quadrat,Island", "S1,10.5,x,2022,RHMA,Alive,P1,3,STT"])
    r = io.load_tables(spark, str(tmp_path), "csv", ["trees"])["trees"].first().asDict()
    assert r == {"SY": 2022, "Island": "STT", "Site": "S1", "Plot": "P1", "Quadrat": 3, "Species": "RHMA",
                 "Mortality": "Alive", "DBH_cm": 10.5}


@pytest.mark.parametrize("fmt", io.FORMATS)
def test_missing_required_column_raises(spark, tmp_path, fmt):
    df = spark.createDataFrame([("S1", 2022)], "Site string, SY int")
    getattr(df.write, fmt)(f"{tmp_path}/ysi") if fmt != "csv" else df.write.option("header", True).csv(f"{tmp_path}/ysi")
    if fmt == "json":  # JSON lines leave NULL fields out, so absence is no error there
        assert io.load_tables(spark, str(tmp_path), fmt, ["ysi"])["ysi"].first().TDS is None
        return
    with pytest.raises(ValueError, match="lacks"):
        io.load_tables(spark, str(tmp_path), fmt, ["ysi"])


@pytest.mark.parametrize("fmt", io.FORMATS)
def test_every_cover_type_survives_storage(spark, tmp_path, fmt):
    from plotstats.operators import canopy

    keys = "SY int, Island string, Site string, Plot string, Quadrat int"
    df = spark.createDataFrame([(2022, "I", "A", "p", 1, "10", "20", "30", "40"), (2022, "I", "B", "p", 1, None, None, None, "7")],
                               keys + ", Calc_N_Veg string, Calc_N_Wood string, Calc_S_Open string, Calc_W_Rock string")
    only_rock = canopy.canopy_long(df.where("Site = 'B'")).where("Type = 'Rock'")
    assert only_rock.first().value == 7.0
    io.write_survey_tables({"densiometer": df}, str(tmp_path), fmt)
    back = io.load_tables(spark, str(tmp_path), fmt, ["densiometer"])["densiometer"]
    rows = lambda d: sorted(map(str, canopy.canopy_cover(d).collect()))
    assert rows(back) == rows(df) and any("Rock" in r for r in rows(back))
    assert canopy.canopy_cover_table(back).where("Site = 'B'").count() == 1


def test_unparsable_canopy_column_raises(spark):
    from plotstats.operators import canopy

    df = spark.createDataFrame([(2022, "A", "p", "1", "2")], "SY int, Site string, Plot string, Calc_N_Veg string, Calc_Q_Veg string")
    with pytest.raises(ValueError, match="Calc_Q_Veg"):
        canopy.canopy_long(df)
    # the pattern need not end the name: Wood2 is read as Wood
    both = df.drop("Calc_Q_Veg").withColumn("Calc_S_Wood2", df.Calc_N_Veg)
    assert {r.Type for r in canopy.canopy_long(both).collect()} == {"Veg", "Wood"}


def test_stored_tables_answer_like_derived_ones(spark):
    """Every statistic, over derived and over stored survey tables (Plot is text there)."""
    root = scratch_path(spark, "same-answers")
    io.write_survey_tables(fx.survey_tables(spark, SF), root)
    tables = io.load_tables(spark, root)
    wrong = []
    for name in PLAN_QUERIES:
        derived = catalog.comparable(catalog.QUERIES[name](spark, SF))
        with catalog.stored_tables(tables):
            stored = catalog.comparable(catalog.QUERIES[name](spark, SF))
        text = lambda df: sorted(str([str(v) for v in r]) for r in df.select(sorted(df.columns)).collect())
        if text(derived) != text(stored):
            wrong.append(name)
    assert not wrong


def test_first_forest_type_follows_the_row_number(spark):
    from plotstats.operators import sites

    c = spark.createDataFrame([("I", "A", "10", "Basin", 1.0, 1.0, 2), ("I", "A", "9", "Fringe", 1.0, 1.0, 1), ("I", "A", "2", "Salt Pond", 1.0, 1.0, None)],
                              "Island string, Site string, Plot string, `Forest type` string, Latitude double, Longitude double, Row long")
    assert sites.site_coordinates(c).first().Typology == "Fringe"
    tied = c.withColumn("Row", c.Row * 0 + 1)
    assert sites.site_coordinates(tied.where("Row is not null")).first().Typology == "Basin"  # "10" before "9"
    with pytest.raises(ValueError, match="row-order"):
        sites.site_coordinates(c.drop("Row"))
    with pytest.raises(ValueError, match="numeric"):
        sites.site_coordinates(c, order_by="Plot")


def test_partitioned_write_makes_few_files(spark):
    root = scratch_path(spark, "files")
    t = fx.trees(spark, SF).repartition(64)
    io.write_survey_tables({"trees": t}, root)
    per_year = {}
    for folder, _, files in os.walk(root.replace("file:", "")):
        n = sum(f.endswith(".parquet") for f in files)
        if n:
            per_year[folder] = n
    assert len(per_year) == 7 and max(per_year.values()) <= 8, per_year


def test_no_local_scratch_on_a_cluster():
    from plotstats.plans.session import ensure_checkpoint_dir, is_local

    assert is_local("local") and is_local("local[4]") and not is_local("local-cluster[3,2,1024]") and not is_local("yarn")

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_merges_refuse_repeated_keys(spark):
    from plotstats.plans.merge import left_merge, merge_outer

    a = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, a double")
    b = spark.createDataFrame([(1, 5.0)], "k int, b double")
    for merged in (merge_outer([a, b], ["k"]), left_merge(a, b, ["k"]), left_merge(b, a, ["k"])):
        with pytest.raises(Exception, match="repeats a key"):
            merged.collect()
    assert merge_outer([a.limit(1), b], ["k"]).count() == 1


def test_huge_diameter_has_a_size_class(spark):
    from plotstats.functions.expr import size_class_index

    df = spark.createDataFrame([(1e12,)], "x double")
    assert df.select(size_class_index("x", 0.1).alias("i")).first().i == 10_000_000_000_001


def test_percent_change_keeps_every_year(spark):
    t = fx.trees(spark, SF)
    years = sorted(int(c) for c in stand.pct_basal_area_change(t, 1996, 2000).columns if c.isdigit())
    assert years == list(range(1995, 2002))
    with pytest.raises(ValueError, match="not in the given list"):
        stand.pct_basal_area_change(t, 1996, 2000, years=(1996, 1997, 2000))


# --- plans over the test tables at scale: no side small enough to broadcast -----------

def _lineitem_exchanges(node):
    """Exchanges that carry lineitem rows no aggregate has reduced."""
    def raw(n):
        name = n.nodeName()
        if "Scan" in name:
            return "lineitem.parquet" in n.toString()
        return "Aggregate" not in name and any(raw(c) for c in _children(n))

    own = node.nodeName() == "Exchange" and any(raw(c) for c in _children(node))
    return own + sum(_lineitem_exchanges(c) for c in _children(node))


@pytest.fixture()
def no_broadcast(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


ROW_LEVEL = ("basal_area", "standard_error")  # every row is joined to its site


@pytest.mark.parametrize("name", [n for n in PLAN_QUERIES if n not in ROW_LEVEL])
def test_readings_are_shuffled_once_at_most(spark, no_broadcast, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    # the one join of trees with orders and of heights and water with part
    allowed = text.count("orders.parquet") + text.count("part.parquet")
    assert _lineitem_exchanges(plan) <= allowed


def test_seedlings_scan_their_table_once(spark):
    from plotstats.operators import regen

    root = scratch_path(spark, "one-scan")
    tables = fx.survey_tables(spark, SF)
    io.write_survey_tables({k: tables[k] for k in ("regeneration", "densiometer")}, root)
    t = io.load_tables(spark, root, names=["regeneration", "densiometer"])
    plan = plan_text(regen.seedling_density(t["regeneration"], t["densiometer"], fx.ISLANDS))
    assert plan.count("/regeneration") == 1
