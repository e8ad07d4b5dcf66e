"""Water quality: five measures, plot mean → site mean and SE, and the
report table (1 decimal; salinity and TDS then to 0 decimals)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plotstats.functions.expr import mean_se_text, report_round
from plotstats.plans.nested import Measure, nested_stats

# --- fixed values of the water-quality sheet and report ------------------------
# output name → reading column
WATER_MEASURES = {
    "mean_depth": "Water_depth",
    "mean_temp": "Temp",
    "mean_DO": "DO_mg_L",
    "mean_SAL": "Salinity_ppt",
    "mean_TDS": "TDS",
}
# report column → (measure, decimals)
WATER_REPORT = {
    "Depth": ("mean_depth", 1),
    "Temp": ("mean_temp", 1),
    "DO": ("mean_DO", 1),
    "SAL": ("mean_SAL", 0),
    "TDS": ("mean_TDS", 0),
}
# ------------------------------------------------------------------------------


def mean_water_quality(ysi: DataFrame) -> DataFrame:
    """SY, Site, then mean_<m>, mean_<m>_SE for depth, temp, DO, SAL, TDS."""
    return nested_stats(ysi, [["SY", "Site", "Plot"], ["SY", "Site"]], [
        Measure(name, value, ("mean", "mean"), se="skip") for name, value in WATER_MEASURES.items()])


def water_table(stats: DataFrame) -> DataFrame:
    """Report table from a ``mean_water_quality`` result."""
    r1 = {c: report_round(c, 1) for name in WATER_MEASURES for c in (name, f"{name}_SE")}
    stats = stats.withColumns(r1)
    return stats.select("SY", "Site", *[
        mean_se_text(m, f"{m}_SE", d).alias(label) for label, (m, d) in WATER_REPORT.items()])


def water_quality_table(ysi: DataFrame) -> DataFrame:
    """SY, Site, Depth, Temp, DO, SAL, TDS as "mean ± SE" text.  Everything is
    first rounded to 1 decimal, salinity and TDS then again to 0."""
    return water_table(mean_water_quality(ysi))
