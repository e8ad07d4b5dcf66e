"""Property tests: invariants that must hold for any survey data."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plotstats.operators import regen, sizes, stand

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

tree_row = st.fixed_dictionaries({
    "SY": st.sampled_from([2022, 2024]),
    "Site": st.sampled_from(["A", "B", "C"]),
    "Plot": st.sampled_from(["p1", "p2", "p3"]),
    "Species": st.sampled_from(["RHMA", "AVGE", "LARA", "PIMA", None]),
    "Mortality": st.sampled_from(["Alive", "Dying", "Dead", "NA", None]),
    "DBH_cm": st.one_of(st.none(), st.floats(min_value=-2, max_value=60, allow_nan=False)),
})


@SETTINGS
@given(rows=st.lists(tree_row, min_size=1, max_size=40), width=st.sampled_from([0.1, 2.5, 3.0]))
def test_size_frequencies_sum_to_one(frames, rows, width):
    t = frames("trees", rows, Island="I", Quadrat=1)
    out = sizes.size_freq_all(t, width).collect()
    totals = {}
    for r in out:
        totals[(r.Site, r.SY)] = totals.get((r.Site, r.SY), 0.0) + r.freq
        assert r.size_class >= 1 and r.n >= 1
    for v in totals.values():
        assert v == pytest.approx(1.0)
    kept = [r for r in rows if r["DBH_cm"] is not None and r["DBH_cm"] >= 0
            and r["Mortality"] not in (None, "NA")]
    assert sum(r.n for r in out) == len(kept)


@SETTINGS
@given(rows=st.lists(tree_row, min_size=1, max_size=40))
def test_species_shares_sum_to_100_or_null(frames, rows):
    t = frames("trees", rows, Island="I", Quadrat=1)
    for r in stand.species_share(t, "alive").collect():
        vals = [r.RHMA_alive, r.AVGE_alive, r.LARA_alive]
        if any(v is None for v in vals):
            assert all(v is None for v in vals)
        else:
            assert sum(vals) == pytest.approx(100.0)


@SETTINGS
@given(rows=st.lists(tree_row, min_size=1, max_size=40))
def test_change_is_target_minus_base(frames, rows):
    t = frames("trees", rows, Island="I", Quadrat=1)
    means = {(r.SY, r.Site): r.mean_basal_area for r in stand.mean_basal_area(t).collect()}
    for r in stand.basal_area_change(t, 2022, 2024).collect():
        expect = means.get((2024, r.Site), 0.0) - means.get((2022, r.Site), 0.0)
        assert r.total_change == pytest.approx(expect)


@SETTINGS
@given(rows=st.lists(tree_row, min_size=1, max_size=40), parts=st.integers(1, 5))
def test_partitioning_does_not_change_results(frames, rows, parts):
    t = frames("trees", rows, Island="I", Quadrat=1)

    def norm(df):
        return sorted(tuple(None if v is None else (round(v, 9) if isinstance(v, float) else v)
                            for v in r) for r in df.collect())

    assert norm(stand.tree_summary(t, frames("heights", [], Island="I"))) == \
        norm(stand.tree_summary(t.repartition(parts), frames("heights", [], Island="I")))


@SETTINGS
@given(vals=st.lists(st.tuples(st.floats(0, 100), st.floats(0, 50), st.floats(0, 5)),
                     min_size=2, max_size=10))
def test_rescale_round_trip(spark, vals):
    df = spark.createDataFrame([(i, h, m, s) for i, (h, m, s) in enumerate(vals)],
                               "k long, h double, m double, se double")
    s = regen.axis_scalars(df, "h", "m", "se")
    out = regen.rescale_inverse(regen.rescale_to_axis(df, "h", "m", "se", "p", s),
                                "p", "h", "m", "se", "back", s)
    hs = [h for h, _, _ in vals]
    ms = [m for _, m, _ in vals]
    spread_h = max(hs) - min(hs)
    spread_m = max(ms) + max(x for _, _, x in vals) - min(ms)
    for r in out.collect():
        if spread_h == 0:
            assert r.p is None
        elif spread_m > 1e-9:
            assert r.back == pytest.approx(r.h, abs=1e-6 * max(1.0, abs(r.h)))
            assert min(ms) - 1e-9 <= r.p <= min(ms) + spread_m + 1e-9
        assert not (r.p is not None and math.isnan(r.p))
