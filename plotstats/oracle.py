"""Independent SQL formulation of every registered query (DuckDB dialect).

Used only for verification: the driver (and ``tools/oracle_check.py``) runs
each query here against the same parquet tables, registered as views, and
compares the result with the Spark operator.  The SQL follows the survey
semantics directly — chained NULL-matching full outer joins where the Spark
side merges with union + group by, pivots as filtered aggregates, and so
on — so agreement is evidence, not tautology.

Double columns are snapped to 9 decimals and rounded to 6 as
round(x·1e6)/1e6 (and -0.0 folded to 0.0) exactly like
``plotstats.catalog.comparable`` on the Spark side; report text rounds
half-even after the same 9-decimal snap.
"""

from __future__ import annotations

SPECIES = ("RHMA", "AVGE", "LARA")
ISLANDS = ("AFRICA", "AMERICA", "ASIA")
BASE, TARGET = 1996, 2000
YEARS = tuple(range(1995, 2002))
BIN = 3.0
NUM_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# --- survey tables derived from the test tables (FIXTURES.md §2) ----------------

_SPECIES_FROM_FLAG = ("CASE l_returnflag WHEN 'A' THEN 'AVGE' WHEN 'N' THEN 'LARA' "
                      "WHEN 'R' THEN 'RHMA' END")


def _densio_cols() -> str:
    out = []
    for d, direction in enumerate("NSEW"):
        veg, wood = f"((q + {d}) % 60)", f"((q + {d}) % 25)"
        for name, v in (("Veg", veg), ("Wood", wood), ("Open", f"(100 - {veg} - {wood})")):
            txt = f"CAST({v} AS VARCHAR)"
            if direction == "W":
                txt = f"CASE WHEN Quadrat = 7 THEN 'NA' ELSE {txt} END"
            out.append(f"{txt} AS Calc_{direction}_{name}")
    return ",\n    ".join(out)


def _regen_cols() -> str:
    out = []
    for code, f in (("RHMA", "R"), ("LARA", "N"), ("AVGE", "A")):
        for name, s in (("seedlings", "F"), ("saplings", "O")):
            c = (f"CAST(count(*) FILTER (WHERE l_returnflag = '{f}' AND l_linestatus = '{s}') "
                 f"AS DOUBLE)")
            if code == "RHMA" and name == "seedlings":
                c = f"CASE WHEN Quadrat = 7 AND Plot % 5 = 0 THEN NULL ELSE {c} END"
            out.append(f"{c} AS {code}_{name}")
    return ",\n    ".join(out)


TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "sd": ((), """sd AS (
  SELECT s.s_suppkey, n.n_nationkey, n.n_name AS Site, r.r_name AS Island
  FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey)"""),
    "b": (("sd",), """b AS (
  SELECT CAST(year(l.l_shipdate) AS INTEGER) AS SY, sd.Island, sd.Site, l.l_suppkey AS Plot,
         l.l_linenumber AS Quadrat, sd.n_nationkey, l.l_orderkey, l.l_partkey, l.l_quantity,
         l.l_extendedprice, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus
  FROM lineitem l JOIN sd ON sd.s_suppkey = l.l_suppkey)"""),
    "bp": (("b",), """bp AS (
  SELECT b.*, p.p_type, p.p_size FROM b JOIN part p ON p.p_partkey = b.l_partkey)"""),
    "trees": (("b",), f"""trees AS (
  SELECT SY, Island, Site, Plot, Quadrat, {_SPECIES_FROM_FLAG} AS Species,
    CASE WHEN round(l_tax * 100) = 8 THEN 'NA'
         ELSE CASE o.o_orderstatus WHEN 'F' THEN 'Alive' WHEN 'P' THEN 'Dying'
                                   WHEN 'O' THEN 'Dead' END END AS Mortality,
    CASE WHEN l_quantity = 50 THEN NULL ELSE l_quantity END AS DBH_cm
  FROM b JOIN orders o ON o.o_orderkey = b.l_orderkey)"""),
    "heights": (("bp",), """heights AS (
  SELECT SY, Island, Site, Plot, Quadrat,
    CASE p_type WHEN 'ECONOMY' THEN 'RHMA' WHEN 'SMALL' THEN 'AVGE' WHEN 'MEDIUM' THEN 'LARA'
                WHEN 'PROMO' THEN 'UNK' WHEN 'LARGE' THEN 'NA' END AS Species,
    CASE WHEN p_size = 50 THEN NULL ELSE CAST(p_size AS DOUBLE) / 2.0::DOUBLE END AS Tree_Height_m
  FROM bp)"""),
    "regeneration": (("b",), f"""regeneration AS (
  SELECT SY, Island, Site, Plot, Quadrat,
    {_regen_cols()},
    CASE WHEN Quadrat % 2 = 0 THEN NULL ELSE max(l_quantity) END AS Tall_seedling_cm
  FROM b GROUP BY SY, Island, Site, Plot, Quadrat)"""),
    "saplings": (("b",), f"""saplings AS (
  SELECT SY, Island, Site, Plot, Quadrat, {_SPECIES_FROM_FLAG} AS Species,
    CASE WHEN l_quantity = 50 THEN NULL ELSE l_extendedprice / 100 END AS Height_cm
  FROM b WHERE l_linestatus = 'O')"""),
    "dq": (("b",), """dq AS (
  SELECT SY, Island, Site, Plot, Quadrat, CAST(sum(l_quantity) AS INTEGER) AS q
  FROM b GROUP BY SY, Island, Site, Plot, Quadrat)"""),
    "densiometer": (("dq",), f"""densiometer AS (
  SELECT SY, Island, Site, Plot, Quadrat,
    {_densio_cols()}
  FROM dq)"""),
    "ysi": (("bp",), """ysi AS (
  SELECT SY, Island, Site, Plot, Quadrat,
    CASE WHEN l_quantity = 50 THEN NULL ELSE l_quantity END AS Water_depth,
    20.0::DOUBLE + l_discount * 100 AS Temp,
    l_tax * 100 AS DO_mg_L,
    CAST(p_size AS DOUBLE) AS Salinity_ppt,
    l_extendedprice AS TDS
  FROM bp)"""),
    "coordinates": (("sd",), """coordinates AS (
  SELECT Island, Site, s_suppkey AS Plot,
    CASE s_suppkey % 3 WHEN 0 THEN 'Basin' WHEN 1 THEN 'Fringe' ELSE 'Salt Pond' END AS "Forest type",
    CASE WHEN s_suppkey % 40 = 0 THEN NULL
         ELSE 17.0::DOUBLE + CAST(s_suppkey % 100 AS DOUBLE) / 100.0::DOUBLE END AS Latitude,
    -65.0::DOUBLE + CAST(s_suppkey % 100 AS DOUBLE) / 100.0::DOUBLE AS Longitude, s_suppkey AS "Row"
  FROM sd)"""),
}


def _order(names: tuple[str, ...] | list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in TABLES[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def query(tables: list[str], ctes: list[str], select: str) -> str:
    parts = [TABLES[n][1] for n in _order(tables)] + ctes
    return "WITH " + ",\n".join(parts) + "\n" + select


# --- expression helpers ---------------------------------------------------------


def se(x: str) -> str:
    return f"(stddev_samp({x}) / sqrt(count({x})))"


def ba(x: str) -> str:
    return f"(pi() * pow(({x} / 100.0::DOUBLE) / 2.0::DOUBLE, 2.0::DOUBLE) / 0.01::DOUBLE)"


def num(x: str, d: int) -> str:
    """Half-even after a 9-decimal snap; R-style text (1e+05 when narrower)."""
    fixed = "CAST(CAST(v AS DECIMAL(38,{d})) AS VARCHAR)".format(d=d)
    if d > 0:
        fixed = f"rtrim(rtrim({fixed}, '0'), '.')"
    a = "ltrim(s, '-')"
    sig = f"rtrim(replace({a}, '.', ''), '0')"
    exp = f"(instr({a} || '.', '.') - 2)"
    sci = (f"((CASE WHEN v < 0 THEN '-' ELSE '' END) || substr({sig}, 1, 1) || "
           f"(CASE WHEN length({sig}) > 1 THEN '.' || substr({sig}, 2) ELSE '' END) || 'e+' || "
           f"lpad(CAST({exp} AS VARCHAR), 2, '0'))")
    body = f"CASE WHEN abs(v) >= 100000 AND length({sci}) < length(s) THEN {sci} ELSE s END"
    return (f"list_transform([round_even(round({x}, 9), {d})], lambda v: "
            f"list_transform([{fixed}], lambda s: {body})[1])[1]")


def txt(m: str, s: str, d: int) -> str:
    return f"(coalesce({num(m, d)}, 'NA') || ' ± ' || coalesce({num(s, d)}, 'NA'))"


def edge(x: str) -> str:
    s = f"CAST(CAST(round({x}, 10) AS DECIMAL(38,10)) AS VARCHAR)"
    return f"regexp_replace(regexp_replace({s}, '0+$', ''), '\\.$', '')"


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def nsj(a: str, b: str, keys: list[str]) -> str:
    """NULL-matching join condition."""
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)


SP = in_list(SPECIES)
LIVE = in_list(("Alive", "Dying"))

# --- queries ------------------------------------------------------------------------

Q: dict[str, tuple[str, tuple[str, ...]]] = {}


def reg(name: str, sql: str, doubles: tuple[str, ...] = ()) -> str:
    Q[name] = (sql, doubles)
    return sql


# size structure
_SIZE_ROWS = [
    f"""s0 AS (
  SELECT SY, Site, CASE WHEN Mortality = 'Dying' THEN 'Alive' ELSE Mortality END AS Mortality,
         DBH_cm AS x, floor(DBH_cm / {BIN}::DOUBLE) AS i0
  FROM trees WHERE DBH_cm >= 0 AND Mortality <> 'NA')""",
    f"""s1 AS (SELECT *, CASE WHEN (i0 + 1) * {BIN}::DOUBLE <= x THEN i0 + 1 ELSE i0 END AS i1 FROM s0)""",
    f"""sr AS (SELECT SY, Site, Mortality,
  CAST(CASE WHEN i1 * {BIN}::DOUBLE > x THEN i1 - 1 ELSE i1 END + 1 AS BIGINT) AS size_class FROM s1)""",
]
_LABEL = (f"CASE WHEN size_class >= 1 THEN {edge(f'(size_class - 1) * {BIN}::DOUBLE')} || '-' || "
          f"{edge(f'size_class * {BIN}::DOUBLE')} END")


def _size_freq(facet: list[str], where: str) -> str:
    f = ", ".join(facet)
    return query(["trees"], _SIZE_ROWS + [
        f"cnt AS (SELECT {f}, Mortality, size_class, count(*) AS n FROM sr {where} "
        f"GROUP BY {f}, Mortality, size_class)"],
        f"SELECT {f}, Mortality, size_class, {_LABEL} AS size_label, n, "
        f"n / sum(n) OVER (PARTITION BY {f}) AS freq FROM cnt")


reg("size_freq_by_period", _size_freq(["SY"], "WHERE Site = 'NATION_8'"), ("freq",))
reg("size_freq_by_site", _size_freq(["Site"], "WHERE SY = 2000"), ("freq",))
reg("size_freq_all", _size_freq(["Site", "SY"], ""), ("freq",))
reg("size_class_label", query(["trees"], _SIZE_ROWS,
    f"SELECT size_class, {_LABEL} AS size_label, count(*) AS n_trees FROM sr GROUP BY size_class"))

# stand structure
reg("basal_area", query(["trees"], [],
    f"SELECT SY, Site, Plot, Quadrat, Species, Mortality, DBH_cm, {ba('DBH_cm')} AS basal_area "
    f"FROM trees"), ("DBH_cm", "basal_area"))

reg("standard_error", query(["trees"], [],
    f"""SELECT SY, Site, count(DBH_cm) AS n_dbh, {se('DBH_cm')} AS se_dbh,
  CASE WHEN count(DBH_cm) = count(*) THEN {se('DBH_cm')} END AS se_dbh_strict
FROM trees GROUP BY SY, Site"""), ("se_dbh", "se_dbh_strict"))


def _mba(statuses: str, name: str = "mba") -> list[str]:
    return [
        f"""{name}_p AS (
  SELECT SY, Site, Plot, coalesce(sum({ba('DBH_cm')}), 0) AS v FROM trees
  WHERE Species IN {SP} AND Mortality IN {statuses} GROUP BY SY, Site, Plot)""",
        f"""{name} AS (
  SELECT SY, Site, coalesce(avg(v), 0) AS mean_basal_area, coalesce({se('v')}, 0) AS mean_basal_area_SE
  FROM {name}_p GROUP BY SY, Site)"""]


_MBA_DEAD = _mba("('Dead')", "mbd0") + ["mbd AS (SELECT * FROM mbd0 WHERE SY IS NOT NULL)"]
reg("mean_basal_area", query(["trees"], _mba(LIVE), "SELECT * FROM mba"),
    ("mean_basal_area", "mean_basal_area_SE"))
reg("mean_basal_area_dead", query(["trees"], _MBA_DEAD, "SELECT * FROM mbd"),
    ("mean_basal_area", "mean_basal_area_SE"))


def _share(statuses: str, suffix: str, name: str) -> list[str]:
    sums = ",\n    ".join(
        f"coalesce(sum(CASE WHEN Species = '{s}' THEN {ba('DBH_cm')} END), 0) AS {s}" for s in SPECIES)
    avgs = ", ".join(f"avg({s}) AS {s}" for s in SPECIES)
    total = " + ".join(SPECIES)
    shares = ", ".join(f"{s} / nullif({total}, 0) * 100.0::DOUBLE AS {s}{suffix}" for s in SPECIES)
    return [
        f"""{name}_p AS (SELECT SY, Site, Plot,
    {sums}
  FROM trees WHERE Species IN {SP} AND Mortality IN {statuses} GROUP BY SY, Site, Plot)""",
        f"{name}_s AS (SELECT SY, Site, {avgs} FROM {name}_p GROUP BY SY, Site)",
        f"{name} AS (SELECT SY, Site, {shares} FROM {name}_s)"]


_SSA = _share(LIVE, "_alive", "ssa")
_SSD = _share("('Dead')", "_dead", "ssd")
reg("species_share_alive", query(["trees"], _SSA, "SELECT * FROM ssa"),
    tuple(f"{s}_alive" for s in SPECIES))
reg("species_share_dead", query(["trees"], _SSD, "SELECT * FROM ssd"),
    tuple(f"{s}_dead" for s in SPECIES))

_MSD = [
    f"""msd_p AS (SELECT SY, Site, Plot, count(*) / 0.01::DOUBLE AS d FROM trees
  WHERE Species IN {SP} AND Mortality IN {LIVE} GROUP BY SY, Site, Plot)""",
    f"""msd AS (SELECT SY, Site, avg(d) AS mean_stem_density, {se('d')} AS mean_stem_density_SE
  FROM msd_p GROUP BY SY, Site)"""]
reg("mean_stem_density", query(["trees"], _MSD, "SELECT * FROM msd"),
    ("mean_stem_density", "mean_stem_density_SE"))

_MTH = [
    f"""mth_p AS (SELECT SY, Site, Plot, avg(Tree_Height_m) AS v FROM heights
  WHERE Species IN ('RHMA', 'AVGE', 'LARA', 'UNK') OR Species IS NULL GROUP BY SY, Site, Plot)""",
    f"""mth AS (SELECT SY, Site, coalesce(avg(v), 0) AS mean_height, coalesce({se('v')}, 0) AS mean_height_SE
  FROM mth_p GROUP BY SY, Site)"""]
reg("mean_tree_height", query(["heights"], _MTH, "SELECT * FROM mth"),
    ("mean_height", "mean_height_SE"))


def _at(v: str, year: int) -> str:
    return f"coalesce(max(CASE WHEN SY = {year} THEN {v} END), 0)"


_year_cols = ", ".join(f'{_at("mean_basal_area", y)} AS "{y}"' for y in YEARS)
reg("pct_basal_area_change", query(["trees"], _mba(LIVE),
    f"""SELECT Site, {_year_cols},
  ({_at('mean_basal_area', TARGET)} - {_at('mean_basal_area', BASE)})
    / nullif({_at('mean_basal_area', BASE)}, 0) * 100.0::DOUBLE AS percentage_change
FROM mba GROUP BY Site"""), tuple(str(y) for y in YEARS) + ("percentage_change",))


def _change(src: str, v: str, out: str) -> str:
    return (f"{out}_t AS (SELECT Site, coalesce({_at(v, TARGET)} - {_at(v, BASE)}, 0) AS {out} "
            f"FROM {src} GROUP BY Site)")


_CH_LIVE = _mba(LIVE) + [_change("mba", "mean_basal_area", "total_change")]
_CH_DEAD = _MBA_DEAD + [_change("mbd", "mean_basal_area", "total_change_dead")]
_CH_HEIGHT = _MTH + [_change("mth", "mean_height", "height_change")]
_CH_DENS = _MSD + [_change("msd", "mean_stem_density", "stem_density_change")]
reg("basal_area_change", query(["trees"], _CH_LIVE, "SELECT * FROM total_change_t"), ("total_change",))
reg("basal_area_change_dead", query(["trees"], _CH_DEAD, "SELECT * FROM total_change_dead_t"),
    ("total_change_dead",))
reg("tree_height_change", query(["heights"], _CH_HEIGHT, "SELECT * FROM height_change_t"),
    ("height_change",))
reg("stem_density_change", query(["trees"], _CH_DENS, "SELECT * FROM stem_density_change_t"),
    ("stem_density_change",))


def _full_chain(frames: list[tuple[str, list[str]]], keys: list[str], name: str) -> list[str]:
    """Chained full outer joins with NULL-matching keys, keys coalesced."""
    ctes = []
    prev, prev_cols = frames[0]
    for i, (f, cols) in enumerate(frames[1:], start=1):
        cur = f"{name}{i}" if i < len(frames) - 1 else name
        key_sel = ", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in keys)
        sel = ", ".join([f"a.{c}" for c in prev_cols] + [f"b.{c}" for c in cols])
        ctes.append(f"{cur} AS (SELECT {key_sel}, {sel} FROM {prev} a FULL OUTER JOIN {f} b "
                    f"ON {nsj('a', 'b', keys)})")
        prev, prev_cols = cur, prev_cols + cols
    return ctes


_SUMMARY_COLS = ["mean_basal_area", "mean_basal_area_SE", "RHMA_alive", "AVGE_alive", "LARA_alive",
                 "RHMA_dead", "AVGE_dead", "LARA_dead", "mean_height", "mean_height_SE",
                 "mean_stem_density", "mean_stem_density_SE"]
_TS = _mba(LIVE) + _SSA + _SSD + _MTH + _MSD + _full_chain([
    ("mba", ["mean_basal_area", "mean_basal_area_SE"]),
    ("ssa", [f"{s}_alive" for s in SPECIES]),
    ("ssd", [f"{s}_dead" for s in SPECIES]),
    ("mth", ["mean_height", "mean_height_SE"]),
    ("msd", ["mean_stem_density", "mean_stem_density_SE"]),
], ["SY", "Site"], "ts")
reg("tree_summary", query(["trees", "heights"], _TS, "SELECT * FROM ts"), tuple(_SUMMARY_COLS))


def _r1(c: str) -> str:
    return f"round_even(round({c}, 9), 1)"


_SHARES = [f"{s}_alive" for s in SPECIES] + [f"{s}_dead" for s in SPECIES]
reg("tree_summary_display", query(["trees", "heights"], _TS, f"""SELECT SY, Site,
  {txt(_r1('mean_height'), _r1('mean_height_SE'), 1)} AS Height,
  {txt(_r1('mean_basal_area'), _r1('mean_basal_area_SE'), 1)} AS Basal_Area,
  {txt(f"round_even(round({_r1('mean_stem_density')}, 9), 0)", f"round_even(round({_r1('mean_stem_density_SE')}, 9), 0)", 0)} AS Density,
  {", ".join(f"{_r1(c)} AS {c}" for c in _SHARES)}
FROM ts"""), tuple(_SHARES))

# canopy
_CL = ["cl0 AS (" + "\n  UNION ALL ".join(
    f"SELECT SY, Site, Plot, '{d}' AS Direction, '{t}' AS Type, Calc_{d}_{t} AS txt FROM densiometer"
    for d in "NSEW" for t in ("Veg", "Wood", "Open")) + ")",
    f"""cl AS (SELECT SY, Site, Plot, Direction, Type,
  CASE WHEN regexp_full_match(txt, '{NUM_RE}') THEN TRY_CAST(txt AS DOUBLE) END AS value FROM cl0)"""]
reg("canopy_long", query(["densiometer"], _CL, "SELECT * FROM cl"), ("value",))

_CC = _CL + [
    "cc_p AS (SELECT SY, Site, Plot, Type, avg(value) AS v FROM cl GROUP BY SY, Site, Plot, Type)",
    f"cc AS (SELECT SY, Site, Type, avg(v) AS perc, {se('v')} AS perc_SE FROM cc_p GROUP BY SY, Site, Type)"]
reg("canopy_cover", query(["densiometer"], _CC, "SELECT * FROM cc"), ("perc", "perc_SE"))


def _cell(t: str, v: str) -> str:
    return (f"CASE WHEN count(*) FILTER (WHERE Type = '{t}') = 0 THEN 0.0::DOUBLE "
            f"ELSE max(CASE WHEN Type = '{t}' THEN {v} END) END")


_COVER = ("Veg", "Wood", "Open")
_CCT_COLS = [f"{t}_{v}" for t in _COVER for v in ("perc", "perc_SE")]
reg("canopy_cover_table", query(["densiometer"], _CC + [
    "cct AS (SELECT SY, Site, " + ", ".join(
        f"{_cell(t, v)} AS {t}_{v}" for t in _COVER for v in ("perc", "perc_SE"))
    + " FROM cc GROUP BY SY, Site)"],
    f"""SELECT *, {txt('Veg_perc', 'Veg_perc_SE', 1)} AS Alive, {txt('Wood_perc', 'Wood_perc_SE', 1)} AS Dead,
  {txt('Open_perc', 'Open_perc_SE', 1)} AS Open FROM cct"""), tuple(_CCT_COLS))


def _clip(x: str) -> str:
    return f"CASE WHEN {x} BETWEEN -50 AND 100 THEN {x} END"


reg("canopy_cover_series", query(["densiometer"], _CC + [
    "ccs AS (SELECT SY, Site, " + ", ".join(f"{_cell(t, 'perc')} AS {t}" for t in _COVER)
    + f" FROM cc WHERE Type IN {in_list(_COVER)} GROUP BY SY, Site)"],
    f"SELECT SY, Site, {_clip('Veg')} AS Alive, {_clip('-Wood')} AS Dead, {_clip('Open')} AS Open FROM ccs"),
    ("Alive", "Dead", "Open"))

# regeneration
reg("site_islands", query(["densiometer"], [], "SELECT DISTINCT Island, Site FROM densiometer"))
reg("sites_of_island", query(["densiometer"], [],
    "SELECT DISTINCT Site FROM densiometer WHERE Island = 'AMERICA'"))

_RL = ["rl AS (" + "\n  UNION ALL ".join(
    f"SELECT SY, Site, Plot, Quadrat, '{s}' AS Species, '{g}' AS Stage, {s}_{g} AS Count FROM regeneration"
    for s in ("RHMA", "LARA", "AVGE") for g in ("seedlings", "saplings")) + ")"]
reg("regen_long", query(["regeneration"], _RL, "SELECT * FROM rl"), ("Count",))

_ISL = ["isl AS (SELECT DISTINCT Island, Site FROM densiometer)"]
_ISL_SEL = ("CASE WHEN i.Island IN " + in_list(ISLANDS) + " THEN i.Island END AS Island, CASE i.Island "
            + " ".join(f"WHEN '{v}' THEN {k}" for k, v in enumerate(ISLANDS, start=1))
            + f" ELSE {len(ISLANDS) + 1} END AS Island_order")


def _prop_mean(x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN avg({x}) END"


_SEED = _RL + _ISL + [
    f"""sdp AS (SELECT SY, Site, Plot, Stage, {_prop_mean('Count')} AS v FROM rl
  WHERE Stage = 'seedlings' GROUP BY SY, Site, Plot, Stage)""",
    f"""sdc AS (SELECT SY, Site, Stage, {_prop_mean('v')} AS mean_site, {se('v')} AS count_SE
  FROM sdp GROUP BY SY, Site, Stage)""",
    "sdh_p AS (SELECT SY, Site, Plot, avg(Tall_seedling_cm) AS v FROM regeneration GROUP BY SY, Site, Plot)",
    "sdh AS (SELECT SY, Site, avg(v) AS height_site FROM sdh_p GROUP BY SY, Site)",
    f"""sdj AS (SELECT coalesce(c.SY, h.SY) AS SY, coalesce(c.Site, h.Site) AS Site, c.Stage, c.mean_site,
  c.count_SE, h.height_site FROM sdc c FULL OUTER JOIN sdh h ON {nsj('c', 'h', ['SY', 'Site'])})""",
    f"""seed AS (SELECT j.*, {_ISL_SEL} FROM sdj j LEFT JOIN isl i ON j.Site IS NOT DISTINCT FROM i.Site)"""]
reg("seedling_density", query(["regeneration", "densiometer"], _SEED, "SELECT * FROM seed"),
    ("mean_site", "count_SE", "height_site"))

_SAP_PD = _RL + [
    """sq AS (SELECT SY, Site, Plot, Quadrat, Species, coalesce(sum(Count), 0) AS v FROM rl
  WHERE Stage = 'saplings' GROUP BY SY, Site, Plot, Quadrat, Species)""",
    "spd AS (SELECT SY, Site, Plot, Species, avg(v) AS plot_dens FROM sq GROUP BY SY, Site, Plot, Species)"]
_SAP = _SAP_PD + _ISL + [
    """shq AS (SELECT SY, Site, Plot, Quadrat, Species, avg(Height_cm) AS v FROM saplings
  GROUP BY SY, Site, Plot, Quadrat, Species)""",
    "shp AS (SELECT SY, Site, Plot, Species, avg(v) AS plot_ht FROM shq GROUP BY SY, Site, Plot, Species)",
    f"""spj AS (SELECT d.*, h.plot_ht FROM spd d LEFT JOIN shp h
  ON {nsj('d', 'h', ['SY', 'Site', 'Plot', 'Species'])})""",
    f"""sps AS (SELECT SY, Site, Species, avg(plot_dens) AS mean_dens, {se('plot_dens')} AS mean_dens_SE,
  avg(plot_ht) AS mean_ht FROM spj GROUP BY SY, Site, Species)""",
    f"sap AS (SELECT s.*, {_ISL_SEL} FROM sps s LEFT JOIN isl i ON s.Site IS NOT DISTINCT FROM i.Site)"]
reg("sapling_density", query(["regeneration", "saplings", "densiometer"], _SAP, "SELECT * FROM sap"),
    ("mean_dens", "mean_dens_SE", "mean_ht"))
reg("sapling_density_species", query(["regeneration", "saplings", "densiometer"], _SAP,
    "SELECT * FROM sap WHERE Species = 'LARA'"), ("mean_dens", "mean_dens_SE", "mean_ht"))


def _wide(src: str, mean: str, se_: str, mean_name: str, se_name: str) -> str:
    cols = ", ".join(
        f"max(CASE WHEN Species = '{s}' THEN {c} END) AS {s}_{n}"
        for s in SPECIES for c, n in ((mean, mean_name), (se_, se_name)))
    texts = ", ".join(f"{txt(f'{s}_{mean_name}', f'{s}_{se_name}', 1)} AS {s}" for s in SPECIES)
    return f"SELECT *, {texts} FROM (SELECT SY, Site, {cols} FROM {src} GROUP BY SY, Site)"


_WIDE_DOUBLES = lambda m, s: tuple(f"{sp}_{n}" for sp in SPECIES for n in (m, s))
reg("sapling_table", query(["regeneration"], _SAP_PD + [
    f"""sts AS (SELECT SY, Site, Species, avg(plot_dens) AS mean_dens, {se('plot_dens')} AS mean_dens_SE
  FROM spd GROUP BY SY, Site, Species)"""],
    _wide("sts", "mean_dens", "mean_dens_SE", "mean_dens", "mean_dens_SE")),
    _WIDE_DOUBLES("mean_dens", "mean_dens_SE"))
reg("seedling_table", query(["regeneration"], _RL + [
    """stp AS (SELECT SY, Site, Plot, Species, avg(Count) AS v FROM rl WHERE Stage = 'seedlings'
  GROUP BY SY, Site, Plot, Species)""",
    f"stt AS (SELECT SY, Site, Species, avg(v) AS m, {se('v')} AS s FROM stp GROUP BY SY, Site, Species)"],
    _wide("stt", "m", "s", "mean", "SE")), _WIDE_DOUBLES("mean", "SE"))


def _scalars(src: str, y: str, m: str, s: str) -> str:
    return (f"sc AS (SELECT min({y}) AS min_h, max({y}) AS max_h, min({m}) AS min_m, "
            f"max({m}) + max({s}) AS max_m FROM {src})")


def _to_axis(y: str) -> str:
    return f"(({y} - min_h) / nullif(max_h - min_h, 0) * (max_m - min_m) + min_m)"


def _from_axis(p: str) -> str:
    return f"(({p} - min_m) / nullif(max_m - min_m, 0) * (max_h - min_h) + min_h)"


reg("rescale_to_axis", query(["regeneration", "saplings", "densiometer"],
    _SAP + [_scalars("sap", "mean_ht", "mean_dens", "mean_dens_SE")],
    f"SELECT SY, Site, Species, mean_ht, {_to_axis('mean_ht')} AS ht_scaled FROM sap, sc"),
    ("mean_ht", "ht_scaled"))
reg("rescale_inverse", query(["regeneration", "densiometer"],
    _SEED + [_scalars("seed", "height_site", "mean_site", "count_SE"),
             f"rx AS (SELECT seed.*, {_to_axis('height_site')} AS height_scaled FROM seed, sc)"],
    f"""SELECT SY, Site, height_site, height_scaled, {_from_axis('height_scaled')} AS height_back,
  {_from_axis('mean_site')} AS axis_height FROM rx, sc"""),
    ("height_site", "height_scaled", "height_back", "axis_height"))
reg("error_bar_bounds", query(["regeneration", "saplings", "densiometer"], _SAP,
    "SELECT SY, Site, Species, mean_dens AS ymin, mean_dens + mean_dens_SE AS ymax FROM sap"),
    ("ymin", "ymax"))

# water
_WQ_M = (("depth", "Water_depth"), ("temp", "Temp"), ("DO", "DO_mg_L"), ("SAL", "Salinity_ppt"),
         ("TDS", "TDS"))
_WQ = [
    "wq_p AS (SELECT SY, Site, Plot, " + ", ".join(f"avg({c}) AS p_{n}" for n, c in _WQ_M)
    + " FROM ysi GROUP BY SY, Site, Plot)",
    "wq AS (SELECT SY, Site, " + ", ".join(
        f"avg(p_{n}) AS mean_{n}, {se(f'p_{n}')} AS mean_{n}_SE" for n, _ in _WQ_M)
    + " FROM wq_p GROUP BY SY, Site)"]
reg("mean_water_quality", query(["ysi"], _WQ, "SELECT * FROM wq"),
    tuple(c for n, _ in _WQ_M for c in (f"mean_{n}", f"mean_{n}_SE")))
_WQ_T = (("Depth", "depth", 1), ("Temp", "temp", 1), ("DO", "DO", 1), ("SAL", "SAL", 0), ("TDS", "TDS", 0))
reg("water_quality_table", query(["ysi"], _WQ, "SELECT SY, Site, " + ", ".join(
    f"{txt(_r1(f'mean_{n}'), _r1(f'mean_{n}_SE'), d)} AS {label}" for label, n, d in _WQ_T)
    + " FROM wq"))

# sites
_SC = [f"""sc0 AS (SELECT Island, Site, arg_min("Forest type", "Row") AS Typology,
  {_prop_mean('Latitude')} AS Latitude, {_prop_mean('Longitude')} AS Longitude
  FROM coordinates GROUP BY Island, Site)"""]
reg("site_coordinates", query(["coordinates"], _SC, "SELECT * FROM sc0"), ("Latitude", "Longitude"))


def _sign(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN 'pos' WHEN {x} IS NOT NULL THEN 'neg' END"


_OV = (_CH_LIVE + _CH_DEAD + _CH_HEIGHT + _CH_DENS + _SC + _full_chain([
    ("total_change_t", ["total_change"]),
    ("total_change_dead_t", ["total_change_dead"]),
    ("height_change_t", ["height_change"]),
    ("stem_density_change_t", ["stem_density_change"]),
], ["Site"], "chg") + [
    f"""ov AS (SELECT c.*, s.Island, s.Typology, s.Latitude, s.Longitude,
  {_sign('c.total_change')} AS direction, {_sign('c.total_change_dead')} AS direction_dead,
  {_sign('c.height_change')} AS direction_height, {_sign('c.stem_density_change')} AS direction_density
  FROM chg c LEFT JOIN sc0 s ON c.Site IS NOT DISTINCT FROM s.Site)"""])
_OV_TABLES = ["trees", "heights", "coordinates"]
reg("site_change_overview", query(_OV_TABLES, _OV, "SELECT * FROM ov"),
    ("total_change", "total_change_dead", "height_change", "stem_density_change", "Latitude", "Longitude"))

_FILL = "CASE {c} WHEN 'neg' THEN '#FF0000' WHEN 'pos' THEN '#E6E600' ELSE '#808080' END"
_TYPO = ("CASE Typology WHEN 'Basin' THEN '#000000' WHEN 'Fringe' THEN '#FFA500' "
         "WHEN 'Salt Pond' THEN '#0000FF' ELSE '#808080' END")
_SITE_HTML = "'<strong>Site:</strong> ' || coalesce(Site, 'NA')"
_layers = []
for _i, (_name, _v, _k, _kind) in enumerate((
        ("Living Basal Change", "total_change", "direction", "change"),
        ("Dead Basal Change", "total_change_dead", "direction_dead", "change"),
        ("Tree Height Change", "height_change", "direction_height", "change"),
        ("Stem Density Change", "stem_density_change", "direction_density", "density")), start=1):
    _radius = (f"(abs({_v}) + 5) * 75.0::DOUBLE" if _kind == "change" else f"abs({_v}) / 3.0::DOUBLE")
    _layers.append(
        f"SELECT {_i} AS layer_order, '{_name}' AS layer, Site, Longitude, Latitude, {_v} AS value, "
        f"{_radius} AS radius, {_SITE_HTML} || '<br><strong>Change:</strong> ' || "
        f"coalesce({num(_v, 2)}, 'NA') AS popup, 'black' AS color, {_FILL.format(c=_k)} AS fill_color FROM ov")
_layers.append(
    f"SELECT 5 AS layer_order, 'Typology' AS layer, Site, Longitude, Latitude, CAST(NULL AS DOUBLE) AS value, "
    f"10.0::DOUBLE AS radius, {_SITE_HTML} || '<br><strong>Typology:</strong> ' || coalesce(Typology, 'NA') "
    f"AS popup, {_TYPO} AS color, {_TYPO} AS fill_color FROM ov")
reg("map_layers", query(_OV_TABLES, _OV, "\nUNION ALL ".join(_layers)),
    ("Longitude", "Latitude", "value", "radius"))

# shared expressions, input/output
reg("mean_se_text", query(["densiometer"], _CC,
    f"SELECT SY, Site, Type, {txt('perc', 'perc_SE', 1)} AS cover_text FROM cc"))
reg("species_display_name", query(["trees"], [],
    "SELECT Species, CASE Species WHEN 'RHMA' THEN 'R. mangle' WHEN 'AVGE' THEN 'A. germinians' "
    "WHEN 'LARA' THEN 'L. racemosa' END AS display_name, count(*) AS n_trees FROM trees GROUP BY Species"))

# rounding by the exact decimal expansion of a double, as text: what is kept, and whether the rest is above, at or below a half
_TEXT = "format('{:.80f}', abs(Height_cm))"
_HALF = f"'5{'0' * 76}'"
reg("binary_round", query(["saplings"], [
    f"""br0 AS (SELECT SY, Site, Height_cm, CAST(replace(left({_TEXT}, -77), '.', '') AS BIGINT) AS kept,
  right({_TEXT}, 77) AS rest FROM saplings)""",
    f"""br AS (SELECT SY, Site, Height_cm, kept + CASE WHEN rest > {_HALF} OR rest = {_HALF} AND kept % 2 = 1 THEN 1 ELSE 0 END AS near FROM br0)"""],
    "SELECT SY, Site, count(Height_cm) AS n_values, count(*) FILTER (CAST(near AS DOUBLE) / 1000.0::DOUBLE > Height_cm) AS n_up, CAST(sum(near) AS BIGINT) AS total_milli "
    "FROM br GROUP BY SY, Site"))
reg("factor_levels", query(["trees"], [], "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(v AS VARCHAR) AS value, row_number() OVER (ORDER BY v) AS level FROM "
    f"(SELECT DISTINCT {x} AS v FROM trees WHERE {c} IS NOT NULL)"
    for c, x in (("SY", "SY"), ("Site", "Site"), ("Plot", "CAST(Plot AS VARCHAR)"), ("Species", "Species")))))
reg("canopy_cover_open", query(["densiometer"], _CC,
    f"SELECT SY, Site, CAST(count(*) AS INTEGER) AS n_types, string_agg(Type || '=' || {txt('perc', 'perc_SE', 1)}, '; ' ORDER BY Type) AS cover "
    "FROM cc GROUP BY SY, Site"))


def _clipped(what: str, a: str, b: str) -> str:
    start, end = f"greatest({a}, lo)", f"least({b}, hi)"
    shown = f"{a} IS NOT NULL AND {b} IS NOT NULL AND {start} <= {end}"
    return f"CASE WHEN {shown} THEN {start} END AS {what}_from, CASE WHEN {shown} THEN {end} END AS {what}_to"


_ZERO = "CASE WHEN mean_site IS NOT NULL THEN {}(mean_site, 0.0::DOUBLE) END"
reg("error_bar_panels", query(["regeneration", "densiometer"], _SEED + [
    """pn AS (SELECT * FROM (VALUES (1, '-inf'::DOUBLE, 2.0123::DOUBLE, 0.0::DOUBLE),
  (2, 2.1317::DOUBLE, 'inf'::DOUBLE, 2.1317::DOUBLE - 2.0123::DOUBLE)) AS p(panel, lo, hi, shift))""",
    f"""pb AS (SELECT SY, Site, panel, shift, {_clipped('bar', _ZERO.format('least'), _ZERO.format('greatest'))},
  {_clipped('err', 'mean_site', '(mean_site + count_SE)')} FROM seed, pn)"""],
    "SELECT SY, Site, panel, bar_from, bar_to, err_from, err_to, shift FROM pb "
    "WHERE panel = 1 OR bar_from IS NOT NULL OR err_from IS NOT NULL"),
    ("bar_from", "bar_to", "err_from", "err_to", "shift"))

# column contents of the survey tables (Plot is text once stored) and of the written results
_KEYS = {"SY": "n", "Island": "t", "Site": "t", "Plot": "t", "Quadrat": "n"}
_CELLS = {f"Calc_{d}_{t}": "t" for d in "NSEW" for t in _COVER}
_SURVEY: dict[str, dict[str, str]] = {
    "trees": _KEYS | {"Species": "t", "Mortality": "t", "DBH_cm": "n"},
    "heights": _KEYS | {"Species": "t", "Tree_Height_m": "n"},
    "coordinates": {"Island": "t", "Site": "t", "Plot": "t", "Forest type": "t", "Latitude": "n", "Longitude": "n", "Row": "n"},
    "densiometer": _KEYS | _CELLS,
    "regeneration": _KEYS | {f"{s}_{g}": "n" for s in ("RHMA", "LARA", "AVGE") for g in ("seedlings", "saplings")}
    | {"Tall_seedling_cm": "n"},
    "saplings": _KEYS | {"Species": "t", "Height_cm": "n"},
    "ysi": _KEYS | {c: "n" for _, c in _WQ_M},
}


def _contents(label: str, name: str, source: str, columns: dict[str, str]) -> str:
    parts = []
    for c, kind in columns.items():
        x = f'CAST("{c}" AS VARCHAR)' if kind == "t" else f'"{c}"'
        total = f"round(CAST(sum(CAST(round({x}, 6) AS DECIMAL(38,6))) AS DOUBLE), 2)" if kind == "n" else "CAST(NULL AS DOUBLE)"
        low, high = (f"min({x})", f"max({x})") if kind == "t" else ("CAST(NULL AS VARCHAR)",) * 2
        parts.append(f"SELECT '{name}' AS {label}, '{c}' AS column_name, count(*) AS n_rows, count({x}) AS n_values, "
                     f"{total} AS total, {low} AS low, {high} AS high FROM {source}")
    return "\nUNION ALL ".join(parts)


reg("load_tables", query(list(_SURVEY), [], "\nUNION ALL ".join(
    _contents("table_name", t, t, columns) for t, columns in _SURVEY.items())))

_SY_SITE = {"SY": "n", "Site": "t"}
_ISLAND = {"Island": "t", "Island_order": "n"}
_numbers = lambda *names: {n: "n" for n in names}
_texts = lambda *names: {n: "t" for n in names}
_EXPORTED: dict[str, dict[str, str]] = {
    "tree_summary": _SY_SITE | _numbers(*_SUMMARY_COLS),
    "canopy_cover": _SY_SITE | _texts("Type") | _numbers("perc", "perc_SE"),
    "seedling_density": _SY_SITE | _texts("Stage") | _numbers("mean_site", "count_SE", "height_site") | _ISLAND,
    "seedling_table": _SY_SITE | _numbers(*_WIDE_DOUBLES("mean", "SE")) | _texts(*SPECIES),
    "sapling_density": _SY_SITE | _texts("Species") | _numbers("mean_dens", "mean_dens_SE", "mean_ht") | _ISLAND,
    "sapling_table": _SY_SITE | _numbers(*_WIDE_DOUBLES("mean_dens", "mean_dens_SE")) | _texts(*SPECIES),
    "mean_water_quality": _SY_SITE | _numbers(*(c for n, _ in _WQ_M for c in (f"mean_{n}", f"mean_{n}_SE"))),
    "size_freq_all": _SY_SITE | _texts("Mortality", "size_label") | _numbers("size_class", "n", "freq"),
    "tree_summary_display": _SY_SITE | _texts("Height", "Basal_Area", "Density") | _numbers(*_SHARES),
    "canopy_cover_table": _SY_SITE | _numbers(*_CCT_COLS) | _texts("Alive", "Dead", "Open"),
    "canopy_cover_series": _SY_SITE | _numbers("Alive", "Dead", "Open"),
    "water_quality_table": _SY_SITE | _texts(*(label for label, _, _ in _WQ_T)),
}
reg("export_results", "WITH " + ",\n".join(f"e_{n} AS MATERIALIZED ({Q[n][0]})" for n in _EXPORTED) + "\n"
    + "\nUNION ALL ".join(_contents("result", n, f"e_{n}", columns) for n, columns in _EXPORTED.items()))


# the sheet's row order, found again: the fixture's row numbers, 1 at the first row
reg("row_order_on_load", Q["site_coordinates"][0], Q["site_coordinates"][1])
_numbered = "(SELECT * REPLACE (row_number() OVER (ORDER BY Row) AS Row) FROM coordinates)"
reg("workbook_scan", query(list(_SURVEY), [], "\nUNION ALL ".join(
    _contents("table_name", t, _numbered if t == "coordinates" else t, columns) for t, columns in _SURVEY.items())))


# sheet checks: rejected cells, repeated keys, keys without coordinates
_UNITS = {"DBH_cm": "cm", "Tree_Height_m": "m", "Temp": "C"}


def _coerced(t: str, c: str) -> str:
    x = f'CAST("{c}" AS VARCHAR)'
    if c in _UNITS:
        x = f"CASE WHEN \"{c}\" IS NULL THEN 'NA' WHEN Quadrat = 7 THEN {x} || ' {_UNITS[c]}' ELSE {x} END"
    bad = f"NOT regexp_full_match(x, '{NUM_RE}')"
    return (f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_cells, count(*) FILTER (x IS NULL) AS n_empty, "
            f"count(*) FILTER ({bad}) AS n_rejected FROM (SELECT {x} AS x FROM {t})")


_PARSED = {t: [c for c, kind in columns.items() if kind == "n" or c.startswith("Calc_")] for t, columns in _SURVEY.items()}
reg("coercion_report", query(list(_SURVEY), [], "\nUNION ALL ".join(_coerced(t, c) for t, cs in _PARSED.items() for c in cs)))


def _profile(t: str, key: tuple[str, ...]) -> str:
    null = " OR ".join(f"{c} IS NULL" for c in key)
    return (f"SELECT '{t}' AS table_name, '{', '.join(key)}' AS key_columns, count(*) AS n_keys, count(*) FILTER (n > 1) AS n_repeated, max(n) AS max_rows, "
            f"CAST(coalesce(sum(n) FILTER ({null}), 0) AS BIGINT) AS n_null FROM (SELECT {', '.join(key)}, count(*) AS n FROM {t} GROUP BY ALL)")


_KEY_SETS = (("SY", "Site", "Plot", "Quadrat"), ("SY", "Site", "Plot"), ("Site", "Plot"), ("Island", "Site"))
reg("key_report", query(list(_SURVEY), [], "\nUNION ALL ".join(
    _profile(t, k) for t, columns in _SURVEY.items() for k in _KEY_SETS if set(k) <= set(columns))))


def _unfiled(t: str, key: tuple[str, ...]) -> str:
    on = " AND ".join(f"CAST(k.{c} AS VARCHAR) IS NOT DISTINCT FROM CAST(f.{c} AS VARCHAR)" for c in key)
    return (f"SELECT '{t}' AS table_name, '{', '.join(key)}' AS key_columns, count(*) AS n_keys, count(*) FILTER (f.known IS NULL) AS n_unfiled "
            f"FROM (SELECT DISTINCT {', '.join(key)} FROM {t}) k LEFT JOIN (SELECT DISTINCT {', '.join(key)}, 1 AS known FROM coordinates WHERE Plot % 9 <> 0) f ON {on}")


reg("unfiled_keys", query(list(_SURVEY), [], "\nUNION ALL ".join(_unfiled(t, k) for t in _SURVEY for k in _KEY_SETS[2:])))


def rounded(name: str) -> str:
    sql, doubles = Q[name]
    if not doubles:
        return sql
    repl = ", ".join(f'round(round("{c}", 9) * 1000000.0::DOUBLE) / 1000000.0::DOUBLE + 0.0 AS "{c}"'
                     for c in doubles)
    return f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n)"


def oracle_sql() -> dict[str, str]:
    return {name: rounded(name) for name in Q}
