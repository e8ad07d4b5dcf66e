"""Site coordinates, the per-site change overview and the map marker table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotstats.functions.aggregates import mean_prop
from plotstats.functions.expr import num_text, sign_class
from plotstats.operators.stand import tree_site_change
from plotstats.plans.merge import left_join_nullsafe

# --- fixed values of the change map -------------------------------------------
# Marker fill by change class, forest-type colours, the colour for a missing
# class, the stroke colour, popup texts, and the circle sizes: radius
# (|x| + 5) * 75 m for the change layers, |x| / 3 m for stem density, 10 px
# for the typology markers; popups show the change rounded to 2 decimals.
CHANGE_COLORS = {"neg": "#FF0000", "pos": "#E6E600"}
TYPOLOGY_COLORS = {"Basin": "#000000", "Fringe": "#FFA500", "Salt Pond": "#0000FF"}
NA_COLOR = "#808080"
STROKE = "black"
POPUP_SITE = "<strong>Site:</strong> "
POPUP_CHANGE = "<br><strong>Change:</strong> "
POPUP_TYPOLOGY = "<br><strong>Typology:</strong> "
CHANGE_RADIUS_OFFSET, CHANGE_RADIUS_SCALE = 5, 75.0
DENSITY_RADIUS_DIVISOR = 3.0
TYPOLOGY_RADIUS = 10.0
POPUP_DIGITS = 2
# layer name, value column, class column, radius kind
MAP_LAYERS = (
    ("Living Basal Change", "total_change", "direction", "change"),
    ("Dead Basal Change", "total_change_dead", "direction_dead", "change"),
    ("Tree Height Change", "height_change", "direction_height", "change"),
    ("Stem Density Change", "stem_density_change", "direction_density", "density"),
    ("Typology", None, None, "typology"),
)
# ------------------------------------------------------------------------------


def site_coordinates(coords: DataFrame, order_by: str = "Row") -> DataFrame:
    """Island, Site, Typology, Latitude, Longitude (plot means; one missing
    plot value → NULL).  Typology is the forest type of the site's first row
    by ``order_by``, a numeric column: the sheet row, stored with the table
    because a distributed table has no row order.  Rows of equal order are
    taken by Plot (as text) and then by forest type."""
    kind = dict(coords.dtypes).get(order_by)
    if kind is None:
        raise ValueError(f"coordinates lack the row-order column {order_by!r}")
    if kind in ("string", "boolean"):
        raise ValueError(f"row-order column {order_by!r} must be numeric, is {kind}")
    first = F.struct(F.col(f"`{order_by}`").isNull(), F.col(f"`{order_by}`"), F.col("Plot").cast("string"), F.col("`Forest type`"))
    return coords.groupBy("Island", "Site").agg(
        F.min_by(F.col("`Forest type`"), first).alias("Typology"),
        mean_prop("Latitude").alias("Latitude"),
        mean_prop("Longitude").alias("Longitude"))


def site_change_overview(trees: DataFrame, heights: DataFrame, coords: DataFrame,
                         base: int, target: int) -> DataFrame:
    """One row per Site: four changes, coordinates, and "pos"/"neg" classes
    (0 is "neg", NULL stays NULL)."""
    changes = tree_site_change(trees, heights, base, target)
    joined = left_join_nullsafe(changes, site_coordinates(coords), ["Site"])
    return joined.withColumns({
        "direction": sign_class("total_change"),
        "direction_dead": sign_class("total_change_dead"),
        "direction_height": sign_class("height_change"),
        "direction_density": sign_class("stem_density_change"),
    })


def _lookup(c: Column, table: dict[str, str]) -> Column:
    out = None
    for k, v in table.items():
        out = (F.when if out is None else out.when)(c == k, F.lit(v))
    return out.otherwise(F.lit(NA_COLOR))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("NA"))


def map_layers(overview: DataFrame) -> DataFrame:
    """Long marker table: one row per site × layer with position, radius,
    popup HTML and colours.  Narrow (no shuffle): the per-layer values are
    computed in a projection, then one generator stacks the layers; keeping
    the expressions out of the generator lets Spark split their generated
    code into methods."""
    site_html = F.concat(F.lit(POPUP_SITE), _text(F.col("Site")))
    per_layer, rows = [], []
    for order, (name, value, klass, kind) in enumerate(MAP_LAYERS, start=1):
        if kind == "typology":
            v = F.lit(None).cast("double")
            radius = F.lit(TYPOLOGY_RADIUS)
            popup = F.concat(site_html, F.lit(POPUP_TYPOLOGY), _text(F.col("Typology")))
            color = _lookup(F.col("Typology"), TYPOLOGY_COLORS)
            fill = color
        else:
            v = F.col(value)
            radius = ((F.abs(v) + CHANGE_RADIUS_OFFSET) * CHANGE_RADIUS_SCALE if kind == "change"
                      else F.abs(v) / DENSITY_RADIUS_DIVISOR)
            popup = F.concat(site_html, F.lit(POPUP_CHANGE), _text(num_text(v, POPUP_DIGITS)))
            color = F.lit(STROKE)
            fill = _lookup(F.col(klass), CHANGE_COLORS)
        fields = {"value": v, "radius": radius.cast("double"), "popup": popup, "color": color,
                  "fill_color": fill}
        per_layer += [e.alias(f"__{k}{order}") for k, e in fields.items()]
        rows.append(F.struct(F.lit(order).alias("layer_order"), F.lit(name).alias("layer"),
                             *[F.col(f"__{k}{order}").alias(k) for k in fields]))
    wide = overview.select("Site", "Longitude", "Latitude", *per_layer)
    return wide.select("Site", "Longitude", "Latitude", F.inline(F.array(*rows))).select(
        "layer_order", "layer", "Site", "Longitude", "Latitude", "value", "radius", "popup",
        "color", "fill_color")
