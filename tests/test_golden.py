"""Hand-computed cases for the missing-value, zero-fill and binning rules."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotstats.functions.expr import (mean_se_text, num_text, safe_number, sign_class,
                                      size_class_index, size_class_label, species_display_name)
from plotstats.operators import canopy, regen, sites, sizes, stand, water
from plotstats.plans.merge import merge_outer

PI = math.pi


def ba(d):
    return PI * d * d / 400.0


def by_key(rows, *keys):
    return {tuple(r[k] for k in keys): r for r in rows}


@pytest.fixture(scope="module")
def trees(frames):
    rows = [
        # site A, 2022: p1 two live RHMA, p2 live with NULL diameter, p3 only dead, p4 live AVGE
        dict(SY=2022, Site="A", Plot="p1", Species="RHMA", Mortality="Alive", DBH_cm=10.0),
        dict(SY=2022, Site="A", Plot="p1", Species="RHMA", Mortality="Dying", DBH_cm=20.0),
        dict(SY=2022, Site="A", Plot="p2", Species="RHMA", Mortality="Alive", DBH_cm=None),
        dict(SY=2022, Site="A", Plot="p3", Species="LARA", Mortality="Dead", DBH_cm=10.0),
        dict(SY=2022, Site="A", Plot="p4", Species="AVGE", Mortality="Alive", DBH_cm=20.0),
        # site B, 2022 only: one plot whose only live tree has no diameter
        dict(SY=2022, Site="B", Plot="q1", Species="RHMA", Mortality="Alive", DBH_cm=None),
        # site A, 2024
        dict(SY=2024, Site="A", Plot="p1", Species="RHMA", Mortality="Alive", DBH_cm=20.0),
        # site C, 2024 only (missing in the base year)
        dict(SY=2024, Site="C", Plot="r1", Species="LARA", Mortality="Alive", DBH_cm=10.0),
        # rows every statistic must ignore
        dict(SY=2022, Site="A", Plot="p1", Species="PIMA", Mortality="Alive", DBH_cm=30.0),
        dict(SY=2022, Site="A", Plot="p1", Species="RHMA", Mortality="NA", DBH_cm=30.0),
    ]
    return frames("trees", rows, Island="I", Quadrat=1)


def test_basal_area_nested_mean_and_fill(trees):
    got = by_key(stand.mean_basal_area(trees).collect(), "SY", "Site")
    a = got[(2022, "A")]
    plots = [ba(10) + ba(20), 0.0, ba(20)]  # p2 sums to 0, p3 (dead only) absent
    m = sum(plots) / 3
    sd = math.sqrt(sum((x - m) ** 2 for x in plots) / 2)
    assert a.mean_basal_area == pytest.approx(m)
    assert a.mean_basal_area_SE == pytest.approx(sd / math.sqrt(3))
    assert got[(2022, "B")].mean_basal_area == 0.0          # all-NULL plot sums to 0
    assert got[(2024, "A")].mean_basal_area_SE == 0.0       # one plot → SE filled with 0
    assert set(got) == {(2022, "A"), (2022, "B"), (2024, "A"), (2024, "C")}


def test_basal_area_dead(trees):
    got = by_key(stand.mean_basal_area_dead(trees).collect(), "SY", "Site")
    assert set(got) == {(2022, "A")}
    assert got[(2022, "A")].mean_basal_area == pytest.approx(ba(10))
    assert got[(2022, "A")].mean_basal_area_SE == 0.0


def test_negative_diameter_counts_in_basal_area(frames):
    t = frames("trees", [dict(SY=1, Site="S", Plot="p", Species="RHMA", Mortality="Alive", DBH_cm=-1.0)])
    assert stand.mean_basal_area(t).first().mean_basal_area == pytest.approx(ba(1))
    assert sizes.size_freq_all(t, 3.0).count() == 0


def test_species_share_zero_fill_and_null(trees):
    got = by_key(stand.species_share(trees, "alive").collect(), "SY", "Site")
    a = got[(2022, "A")]
    rhma, avge = (ba(10) + ba(20)) / 3, ba(20) / 3
    assert a.RHMA_alive == pytest.approx(100 * rhma / (rhma + avge))
    assert a.AVGE_alive == pytest.approx(100 * avge / (rhma + avge))
    assert a.LARA_alive == 0.0
    b = got[(2022, "B")]
    assert (b.RHMA_alive, b.AVGE_alive, b.LARA_alive) == (None, None, None)
    dead = by_key(stand.species_share(trees, "Dead").collect(), "SY", "Site")
    assert dead[(2022, "A")].LARA_dead == pytest.approx(100.0)
    with pytest.raises(ValueError):
        stand.species_share(trees, "dying")


def test_stem_density_counts_null_diameters(trees):
    got = by_key(stand.mean_stem_density(trees).collect(), "SY", "Site")
    a = got[(2022, "A")]
    assert a.mean_stem_density == pytest.approx((200 + 100 + 100) / 3)
    assert a.mean_stem_density_SE == pytest.approx(math.sqrt(((200 - 400 / 3) ** 2 + 2 * (100 - 400 / 3) ** 2) / 2) / math.sqrt(3))
    assert got[(2022, "B")].mean_stem_density_SE is None     # one plot → SE stays NULL


def test_change_and_percent_change(trees):
    ch = by_key(stand.basal_area_change(trees, 2022, 2024).collect(), "Site")
    base_a = (ba(10) + ba(20) + ba(20)) / 3
    assert ch[("A",)].total_change == pytest.approx(ba(20) - base_a)
    assert ch[("B",)].total_change == 0.0
    assert ch[("C",)].total_change == pytest.approx(ba(10))   # missing base year → 0
    pct = by_key(stand.pct_basal_area_change(trees, 2022, 2024).collect(), "Site")
    assert pct[("A",)].percentage_change == pytest.approx((ba(20) - base_a) / base_a * 100)
    assert pct[("C",)]["2022"] == 0.0
    assert pct[("C",)].percentage_change is None
    assert pct[("B",)].percentage_change is None


def test_tree_height_species_filter(frames):
    h = frames("heights", [
        dict(Species="RHMA", Tree_Height_m=10.0), dict(Species=None, Tree_Height_m=20.0),
        dict(Species="UNK", Tree_Height_m=30.0), dict(Species="NA", Tree_Height_m=1000.0),
    ], SY=2022, Island="I", Site="A", Plot="p1", Quadrat=1)
    r = stand.mean_tree_height(h).first()
    assert (r.mean_height, r.mean_height_SE) == (pytest.approx(20.0), 0.0)


def test_tree_summary_fused_equals_separate(trees, frames):
    h = frames("heights", [dict(SY=2022, Site="A", Plot="p1", Species="RHMA", Tree_Height_m=4.0)],
               Island="I", Quadrat=1)
    fused = by_key(stand.tree_summary(trees, h).collect(), "SY", "Site")
    assert set(fused) == {(2022, "A"), (2022, "B"), (2024, "A"), (2024, "C")}
    sep = merge_outer([stand.mean_basal_area(trees), stand.species_share(trees, "alive"),
                       stand.species_share(trees, "dead"), stand.mean_tree_height(h),
                       stand.mean_stem_density(trees)], ["SY", "Site"])
    for r in sep.collect():
        f = fused[(r.SY, r.Site)]
        for c in r.asDict():
            if r[c] is None:
                assert f[c] is None, c
            else:
                assert f[c] == pytest.approx(r[c]), c


def test_null_keys_merge_into_one_row(frames):
    t = frames("trees", [dict(SY=2022, Site=None, Plot="p", Species="RHMA", Mortality="Alive", DBH_cm=10.0)],
               Island="I", Quadrat=1)
    h = frames("heights", [dict(SY=2022, Site=None, Plot="p", Species="RHMA", Tree_Height_m=5.0)],
               Island="I", Quadrat=1)
    rows = stand.tree_summary(t, h).collect()
    assert len(rows) == 1 and rows[0].mean_height == 5.0 and rows[0].mean_stem_density == 100.0


def test_size_frequency_rules(frames):
    t = frames("trees", [
        dict(Mortality="Alive", DBH_cm=3.0),    # on an edge → [3, 6)
        dict(Mortality="Dying", DBH_cm=1.0),    # counted as Alive
        dict(Mortality="Dead", DBH_cm=10.0),    # [9, 12); [6, 9) stays empty
        dict(Mortality="NA", DBH_cm=2.0),       # dropped
        dict(Mortality=None, DBH_cm=2.0),       # dropped
        dict(Mortality="Alive", DBH_cm=-1.0),   # dropped
        dict(Mortality="Alive", DBH_cm=None),   # dropped
    ], SY=2022, Island="I", Site="S", Plot="p", Quadrat=1, Species="RHMA")
    got = {(r.Mortality, r.size_class): r for r in sizes.size_freq_by_period(t, "S", 3.0).collect()}
    assert set(got) == {("Alive", 2), ("Alive", 1), ("Dead", 4)}
    assert got[("Dead", 4)].size_label == "9-12"
    assert got[("Alive", 2)].size_label == "3-6"
    assert sum(r.freq for r in got.values()) == pytest.approx(1.0)


def test_size_class_index_fractional_width(spark):
    df = spark.createDataFrame([(1.7,), (4.3,), (0.0,), (0.3,)], "x double")
    got = [r.i for r in df.select(size_class_index("x", 0.1).alias("i")).collect()]
    # zero-based 16, 43, 0, 2: the edge 3·0.1 is 0.30000000000000004 > 0.3
    assert got == [17, 44, 1, 3]
    lab = df.select(size_class_label(F.lit(2), 0.1).alias("l"), size_class_label(F.lit(5), 3.0, 3).alias("n"))
    r = lab.first()
    assert (r.l, r.n) == ("0.1-0.2", None)


def test_seedling_density_propagates_and_table_skips(frames):
    rows = []
    for plot, quads in (("p1", [(None, 2.0, 4.0), (1.0, 1.0, 1.0)]), ("p2", [(3.0, 3.0, 3.0)]),
                        ("p3", [(5.0, 5.0, 5.0)])):
        for q, (r, lara, avge) in enumerate(quads, start=1):
            rows.append(dict(Plot=plot, Quadrat=q, RHMA_seedlings=r, LARA_seedlings=lara,
                             AVGE_seedlings=avge, RHMA_saplings=0.0, LARA_saplings=0.0,
                             AVGE_saplings=0.0, Tall_seedling_cm=10.0 * q))
    rg = frames("regeneration", rows, SY=2022, Island="I", Site="A")
    densio = frames("densiometer", [dict(Island="St John", Site="A")], SY=2022, Plot="p1", Quadrat=1)
    d = regen.seedling_density(rg, densio).first()
    assert d.mean_site is None                      # one NULL count → NULL site mean
    assert d.count_SE == pytest.approx(1.0)         # SE skips the NULL plot: sd(3, 5)/√2
    assert d.Island == "St John" and d.Island_order == 2
    tb = regen.seedling_table(rg).first()
    assert tb.RHMA_mean == pytest.approx(3.0)       # plot means 1, 3, 5 (NULL skipped)
    assert tb.RHMA_SE == pytest.approx(2 / math.sqrt(3))


def test_sapling_density_quadrat_sum_and_left_join(frames):
    rg = frames("regeneration", [
        dict(Plot="p1", Quadrat=1, RHMA_saplings=2.0), dict(Plot="p1", Quadrat=2, RHMA_saplings=None),
        dict(Plot="p2", Quadrat=1, RHMA_saplings=4.0)],
        SY=2022, Island="I", Site="A", LARA_saplings=0.0, AVGE_saplings=0.0)
    sap = frames("saplings", [
        dict(Plot="p1", Quadrat=1, Species="RHMA", Height_cm=10.0),
        dict(Plot="p1", Quadrat=2, Species="RHMA", Height_cm=30.0),
        dict(Plot="p9", Quadrat=1, Species="RHMA", Height_cm=99.0)],   # no counts → dropped
        SY=2022, Island="I", Site="A")
    densio = frames("densiometer", [dict(Island="X", Site="A")], SY=2022, Plot="p1", Quadrat=1)
    got = by_key(regen.sapling_density(rg, sap, densio).collect(), "Species")
    r = got[("RHMA",)]
    assert r.mean_dens == pytest.approx((1.0 + 4.0) / 2)   # p1: quadrat sums 2, 0 → 1
    assert r.mean_ht == pytest.approx(20.0)
    assert r.Island is None and r.Island_order == 4         # not a level: sorted last
    only = regen.sapling_density(rg, sap, densio, species="LARA").collect()
    assert [x.Species for x in only] == ["LARA"]


def test_canopy_parsing_and_fill(spark):
    schema = T.StructType([T.StructField(n, t) for n, t in [
        ("SY", T.IntegerType()), ("Site", T.StringType()), ("Plot", T.StringType()),
        ("Calc_N_Veg", T.StringType()), ("Calc_S_Veg", T.StringType()), ("Calc_E_Veg", T.StringType()),
        ("Calc_W_Veg", T.StringType()), ("Calc_N_Wood", T.StringType()), ("Calc_N_Moss", T.StringType())]])
    df = spark.createDataFrame([
        (2022, "A", "p1", "50", "NA", "1d", "70", "NA", "5"),
        (2022, "B", "p1", None, None, None, None, None, "5"),
    ], schema)
    long = canopy.canopy_long(df)
    assert long.where("Site = 'A' AND Type = 'Veg'").select(F.sum("value")).first()[0] == 120.0
    tab = by_key(canopy.canopy_cover_table(df).collect(), "Site")
    a = tab[("A",)]
    assert a.Veg_perc == pytest.approx(60.0)
    assert a.Wood_perc is None           # present but NULL stays NULL
    assert a.Open_perc == 0.0            # absent type → 0
    assert a.Alive == "60 ± NA" and a.Dead == "NA ± NA" and a.Open == "0 ± 0"
    series = by_key(canopy.canopy_cover_series(df).collect(), "Site")
    assert series[("A",)].Alive == 60.0 and series[("A",)].Open == 0.0
    assert series[("B",)].Alive is None  # B has only NULL cover cells


def test_canopy_other_types_only(spark):
    df = spark.createDataFrame([(2022, "A", "p1", "5")], "SY int, Site string, Plot string, Calc_N_Moss string")
    t = canopy.canopy_cover_table(df).collect()
    assert len(t) == 1 and (t[0].Veg_perc, t[0].Wood_perc, t[0].Open_perc) == (0.0, 0.0, 0.0)
    assert canopy.canopy_cover_series(df).count() == 0


def test_safe_number(spark):
    df = spark.createDataFrame([("12",), ("NA",), ("1d",), (" 3.5 ",), ("-2e1",), (None,), ("Inf",),
                                ("-infinity",), ("NaN",), ("infx",)], "s string")
    assert [r.v for r in df.select(safe_number("s").alias("v")).collect()] == [
        12.0, None, None, 3.5, -20.0, None, None, None, None, None]


def test_site_coordinates_null_latitude(frames):
    c = frames("coordinates", [
        dict(Plot="2", **{"Forest type": "Fringe"}, Latitude=18.0, Longitude=-64.0),
        dict(Plot="1", **{"Forest type": "Basin"}, Latitude=None, Longitude=-65.0)],
        Island="I", Site="A")
    r = sites.site_coordinates(c).first()
    assert r.Typology == "Basin" and r.Latitude is None and r.Longitude == pytest.approx(-64.5)
    by_latitude = sites.site_coordinates(c.fillna({"Latitude": 99.0}), order_by="Latitude").first()
    assert by_latitude.Typology == "Fringe"


def test_sign_class_and_text(spark):
    df = spark.createDataFrame([(1.0, 3.0, None), (0.0, 12.25, 0.35), (-1.0, 2.75, 1e-12), (None, None, None)],
                               "x double, m double, s double")
    got = df.select(sign_class("x").alias("c"), mean_se_text("m", "s").alias("t")).collect()
    assert [r.c for r in got] == ["pos", "neg", "neg", None]
    assert [r.t for r in got] == ["3 ± NA", "12.2 ± 0.4", "2.8 ± 0", "NA ± NA"]


def test_species_display_name(spark):
    df = spark.createDataFrame([("RHMA",), ("AVGE",), ("LARA",), ("PIMA",)], "s string")
    assert [r.n for r in df.select(species_display_name("s").alias("n")).collect()] == [
        "R. mangle", "A. germinians", "L. racemosa", None]


def test_water_quality_one_plot_and_rounding(frames):
    y = frames("ysi", [dict(Water_depth=10.0, Temp=25.04, DO_mg_L=5.0, Salinity_ppt=35.47, TDS=1000.5),
                       dict(Water_depth=None, Temp=25.06, DO_mg_L=7.0, Salinity_ppt=35.45, TDS=1001.5)],
               SY=2022, Island="I", Site="A", Plot="p1", Quadrat=1)
    m = water.mean_water_quality(y).first()
    assert m.mean_depth == 10.0 and m.mean_depth_SE is None
    t = water.water_quality_table(y).first()
    # half-even: 25.05 → 25.0; salinity 35.46 → 35.5 → 36 (double rounding; 35 if
    # rounded once); TDS 1001 stays 1001
    assert (t.Depth, t.Temp, t.DO, t.SAL, t.TDS) == ("10 ± NA", "25 ± NA", "6 ± NA", "36 ± NA", "1001 ± NA")


def test_overview_and_map_layers(trees, frames):
    h = frames("heights", [dict(SY=2022, Site="A", Plot="p1", Species="RHMA", Tree_Height_m=4.0),
                           dict(SY=2024, Site="A", Plot="p1", Species="RHMA", Tree_Height_m=4.0)],
               Island="I", Quadrat=1)
    c = frames("coordinates", [dict(Island="I", Site="A", Plot="p1", **{"Forest type": "Fringe"},
                                    Latitude=18.0, Longitude=-64.0)])
    ov = by_key(sites.site_change_overview(trees, h, c, 2022, 2024).collect(), "Site")
    a = ov[("A",)]
    assert a.height_change == 0.0 and a.direction_height == "neg"
    assert a.total_change_dead == pytest.approx(-ba(10)) and a.direction_dead == "neg"
    assert ov[("B",)].total_change_dead is None and ov[("B",)].direction_dead is None
    assert ov[("B",)].Latitude is None
    layers = sites.map_layers(sites.site_change_overview(trees, h, c, 2022, 2024)).where("Site = 'A'")
    got = {r.layer: r for r in layers.collect()}
    assert len(got) == 5
    assert got["Typology"].color == "#FFA500" and got["Typology"].radius == 10.0
    assert got["Tree Height Change"].radius == pytest.approx(375.0)
    assert got["Tree Height Change"].fill_color == "#FF0000"
    assert got["Dead Basal Change"].popup == (
        "<strong>Site:</strong> A<br><strong>Change:</strong> " + str(round(-ba(10), 2)))


def test_numbers_print_like_r(spark):
    cases = [(100000.0, 0, "1e+05"), (120000.0, 0, "120000"), (-100000.0, 1, "-1e+05"),
             (1100000.0, 0, "1100000"), (300000.04, 1, "3e+05"), (0.0, 1, "0"), (3.0, 1, "3"),
             (12.25, 1, "12.2"), (-0.04, 1, "0"), (None, 1, None), (1234.5, 0, "1234")]
    df = spark.createDataFrame([(v,) for v, _, _ in cases], "v double")
    for d in (0, 1):
        got = [r.t for r in df.select(num_text("v", d).alias("t")).collect()]
        for (v, dd, want), g in zip(cases, got):
            if dd == d:
                assert g == want, (v, d, g)


def test_site_island_conflicts(frames):
    d = frames("densiometer", [dict(Island="X", Site="A"), dict(Island="Y", Site="A"),
                               dict(Island="X", Site="B"), dict(Island="X", Site="B")],
               SY=2022, Plot="p1", Quadrat=1)
    got = [(r.Site, r.n_islands) for r in regen.site_island_conflicts(d).collect()]
    assert got == [("A", 2)]
    rg = frames("regeneration", [dict(Site="A", Plot="p1", Quadrat=1, RHMA_seedlings=1.0,
                                      LARA_seedlings=1.0, AVGE_seedlings=1.0)], SY=2022, Island="X")
    # the duplication is kept, as in the survey workflow: one row per island
    assert regen.seedling_density(rg, d, ("X", "Y")).count() == 2


def test_axis_rescale_and_error_bars_exact(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0.5), (10.0, 3.0, 1.0), (5.0, 2.0, None)],
                               "h double, m double, se double")
    s = regen.axis_scalars(df, "h", "m", "se")          # min_h 0, max_h 10, min_m 1, max_m 3 + 1
    out = regen.rescale_to_axis(df, "h", "m", "se", "p", s)
    out = regen.rescale_inverse(out, "p", "h", "m", "se", "back", s)
    out = regen.error_bar_bounds(out, "m", "se")
    got = {r.h: r for r in out.collect()}
    assert [got[h].p for h in (0.0, 5.0, 10.0)] == [pytest.approx(1.0), pytest.approx(2.5), pytest.approx(4.0)]
    assert [got[h].back for h in (0.0, 5.0, 10.0)] == [pytest.approx(0.0), pytest.approx(5.0), pytest.approx(10.0)]
    assert (got[10.0].ymin, got[10.0].ymax, got[5.0].ymax) == (3.0, 4.0, None)
    flat = spark.createDataFrame([(2.0, 1.0, 0.1), (2.0, 2.0, 0.1)], "h double, m double, se double")
    assert [r.p for r in regen.rescale_to_axis(flat, "h", "m", "se", "p").collect()] == [None, None]


def test_size_freq_by_site_facets_and_sites_of_island(frames):
    t = frames("trees", [dict(Site="A", DBH_cm=1.0), dict(Site="A", DBH_cm=4.0),
                         dict(Site="B", DBH_cm=7.0), dict(Site="B", DBH_cm=7.5, SY=2024)],
               SY=2022, Island="I", Plot="p", Quadrat=1, Species="RHMA", Mortality="Alive")
    got = {(r.Site, r.size_class): r.freq for r in sizes.size_freq_by_site(t, 2022, 3.0).collect()}
    assert got == {("A", 1): 0.5, ("A", 2): 0.5, ("B", 3): 1.0}
    d = frames("densiometer", [dict(Island="X", Site="A"), dict(Island="X", Site="A"),
                               dict(Island="Y", Site="B")], SY=2022, Plot="p1", Quadrat=1)
    assert [r.Site for r in regen.sites_of_island(d, "X").collect()] == ["A"]
