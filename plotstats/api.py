"""

    from plotstats import api as ps
    tables = ps.load_tables(spark, "/data/survey")
    ps.tree_summary(tables["trees"], tables["heights"]).show()
"""

from __future__ import annotations

from plotstats.functions.aggregates import standard_error
from plotstats.functions.expr import (basal_area, mean_se_text, num_text, safe_number, sign_class,
                                      size_class_index, size_class_label, species_display_name)
from plotstats.operators.canopy import (canopy_cover, canopy_cover_series, canopy_cover_table,
                                        canopy_long, cover_series, cover_table)
from plotstats.operators.regen import (axis_scalars, error_bar_bounds, regen_long, rescale_inverse,
                                       rescale_to_axis, sapling_density, sapling_mean_density, sapling_table,
                                       seedling_density, seedling_table, site_island_conflicts,
                                       site_islands, sites_of_island)
from plotstats.operators.sites import map_layers, site_change_overview, site_coordinates
from plotstats.operators.sizes import (size_class_table, size_freq_all, size_freq_by_period,
                                       size_freq_by_site, size_frequency)
from plotstats.operators.stand import (basal_area_change, basal_area_change_dead, diameter_error, mean_basal_area,
                                       mean_basal_area_dead, mean_stem_density, mean_tree_height,
                                       pct_basal_area_change, species_share, stem_density_change,
                                       tree_height_change, tree_site_change, tree_site_stats,
                                       tree_summary, tree_summary_display)
from plotstats.operators.water import mean_water_quality, water_quality_table, water_table
from plotstats.plans.report import (drop_versions, export_report, publish_report, published_versions,
                                    read_report)
from plotstats.sources.checks import (coercion_counts, coercion_report, key_profile, key_report, observed,
                                      rejected_cells, unfiled_keys)
from plotstats.sources.io import export_results, load_tables, load_workbooks, write_survey_tables
from plotstats.sources.workbook import pack_workbooks, read_workbooks, workbook_bytes, workbook_tables


def species_share_alive(trees):
    return species_share(trees, "alive")


def species_share_dead(trees):
    return species_share(trees, "dead")


__all__ = [
    "axis_scalars", "basal_area", "basal_area_change", "basal_area_change_dead", "canopy_cover",
    "canopy_cover_series", "canopy_cover_table", "canopy_long", "coercion_counts", "coercion_report",
    "cover_series", "cover_table", "diameter_error", "drop_versions", "error_bar_bounds", "export_report",
    "export_results", "key_profile", "key_report", "load_tables", "load_workbooks", "map_layers",
    "mean_basal_area", "mean_basal_area_dead", "mean_se_text", "mean_stem_density",
    "mean_tree_height", "mean_water_quality", "num_text", "observed", "pack_workbooks",
    "pct_basal_area_change", "publish_report", "published_versions", "read_report", "read_workbooks",
    "regen_long", "rejected_cells", "rescale_inverse", "rescale_to_axis", "safe_number", "sapling_density",
    "sapling_mean_density", "sapling_table",
    "seedling_density", "seedling_table", "sign_class", "site_change_overview",
    "site_coordinates", "site_island_conflicts", "site_islands", "sites_of_island",
    "size_class_index", "size_class_label", "size_class_table", "size_freq_all",
    "size_freq_by_period", "size_freq_by_site", "size_frequency", "species_display_name",
    "species_share", "species_share_alive", "species_share_dead", "standard_error",
    "stem_density_change", "tree_height_change", "tree_site_change", "tree_site_stats",
    "tree_summary", "tree_summary_display", "unfiled_keys", "water_quality_table", "water_table",
    "workbook_bytes", "workbook_tables", "write_survey_tables",
]
