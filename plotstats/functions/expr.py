"""Scalar Column expressions shared by the operators.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen; there is no Python UDF
anywhere in the package.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that must equal the survey protocol -----------------------
# Species codes in the order the survey reports them, their display names,
# and the mortality classes.  A tree plot covers 0.01 ha.
SPECIES = ("RHMA", "AVGE", "LARA")
SPECIES_NAMES = {"RHMA": "R. mangle", "AVGE": "A. germinians", "LARA": "L. racemosa"}
LIVE = ("Alive", "Dying")
DEAD = ("Dead",)
PLOT_AREA_HA = 0.01
DEFAULT_ISLANDS = ("St Thomas", "St John", "St Croix")
COVER_TYPES = ("Veg", "Wood", "Open")
# -----------------------------------------------------------------------------

# A numeric literal as text: optional sign, then digits with optional fraction
# or a bare fraction, optional exponent.  Guards try_cast, which would also take
# Java-style suffixes such as "1d".  "NaN" and "Inf" are not matched: no field
# reading is infinite, and either would turn a mean or its SE into NaN, so they
# become NULL, which every statistic skips.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basal_area(dbh_cm: Column | str) -> Column:
    """Basal area of one stem in m²/ha for a 0.01 ha plot."""
    d = col(dbh_cm)
    return F.pi() * F.pow((d / 100.0) / 2.0, 2.0) / PLOT_AREA_HA


def safe_number(c: Column | str) -> Column:
    """Quiet text → double: NULL for anything that is not a plain number."""
    c = col(c).cast("string")
    return finite(F.when(c.rlike(NUMERIC_TEXT), c.try_cast("double")))


def finite(c: Column) -> Column:
    """NaN and infinities (a literal such as 1e999 too) → NULL."""
    return F.when(F.abs(c) < float("inf"), c)


def sign_class(c: Column | str) -> Column:
    """'pos' if > 0, 'neg' otherwise (zero included); NULL stays NULL."""
    c = col(c)
    return F.when(c > 0, F.lit("pos")).when(c.isNotNull(), F.lit("neg"))


def species_display_name(code: Column | str) -> Column:
    """Species code → display name; an unknown code gives NULL."""
    code = col(code)
    out = None
    for k, v in SPECIES_NAMES.items():
        out = (F.when if out is None else out.when)(code == k, F.lit(v))
    return out


def level_ordinal(c: Column | str, levels: Sequence[str], missing_last: bool = False) -> Column:
    """1-based position of ``c`` among ``levels``; for anything else NULL, or
    ``len(levels) + 1`` with ``missing_last`` (a sort key that puts values
    outside the levels last, the way R sorts a factor's NA)."""
    c = col(c)
    out = None
    for i, v in enumerate(levels, start=1):
        out = (F.when if out is None else out.when)(c == v, F.lit(i))
    return out.otherwise(F.lit(len(levels) + 1)) if missing_last else out


def as_level(c: Column | str, levels: Sequence[str]) -> Column:
    """Value kept only when it is one of ``levels`` (a factor with fixed levels)."""
    c = col(c)
    return F.when(c.isin(list(levels)), c)


# Values are snapped to this many decimals before report rounding, so that a
# last-bit difference (summation order varies with partitioning) cannot flip
# a value that sits on a rounding tie such as 2.75 → 2.8.
SNAP_DIGITS = 9


def report_round(c: Column | str, digits: int) -> Column:
    """Half-even rounding to ``digits`` after snapping away last-bit noise."""
    return F.bround(F.round(col(c), SNAP_DIGITS), digits)


def binary_round(c: Column | str, digits: int) -> Column:
    """Rounding of the number that a double really is, half to even: 0.15 is a little less than 15/100 and
    gives 0.1, where the decimal rendering gives 0.2; 0.25 is a tie and gives 0.2.

    The product with 10^digits is taken with its rounding error (the factors' halves multiply exactly), so a product that only
    looks like a tie is told from one.  Exact while ``|c| * 10**digits`` is below 2^52 and for 0 to 7 digits; larger numbers,
    NaN and infinities come back as they are, NULL stays NULL."""
    if not 0 <= digits <= 7:
        raise ValueError("digits must be between 0 and 7")
    x, scale = col(c).cast("double"), F.lit(float(10 ** digits))
    product = x * scale
    wide = x * F.lit(float(2 ** 27 + 1))
    high = wide - (wide - x)
    error = (high * scale - product) + (x - high) * scale
    nearest = F.rint(product)
    off = product - nearest
    step = F.when((off == 0.5) & (error > 0), 1.0).when((off == -0.5) & (error < 0), -1.0).otherwise(0.0)
    return F.when(F.abs(product) < float(2 ** 52), (nearest + step) / scale + F.lit(0.0)).otherwise(x)


def _fixed_text(v: Column, digits: int) -> Column:
    s = v.cast(f"decimal(38,{digits})").cast("string")
    if digits > 0:  # the text always has a '.', so trimming zeros stops there
        s = F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))
    return s


def _shortest_text(v: Column, fixed: Column) -> Column:
    """Print like R: scientific notation when it is narrower than the fixed
    form.  With at most 3 decimals that happens only for |v| >= 1e5 (100000
    → "1e+05", but 120000 stays), so the exponent is the integer-part length
    minus one and the mantissa digits are the fixed digits without trailing
    zeros."""
    a = F.ltrim(fixed, F.lit("-"))
    sig = F.rtrim(F.translate(a, ".", ""), F.lit("0"))
    exp = F.instr(F.concat(a, F.lit(".")), ".") - 2
    sci = F.concat(
        F.when(v < 0, F.lit("-")).otherwise(F.lit("")),
        F.substring(sig, 1, 1),
        F.when(F.length(sig) > 1, F.concat(F.lit("."), F.substring(sig, 2, 64))).otherwise(F.lit("")),
        F.lit("e+"), F.lpad(exp.cast("string"), 2, "0"))
    return F.when((F.abs(v) >= 1e5) & (F.length(sci) < F.length(fixed)), sci).otherwise(fixed)


def num_text(c: Column | str, digits: int) -> Column:
    """Half-even rounding to ``digits`` (0–3), printed the way R prints a
    number: no trailing zeros ("3", "12.5", "-0.25"), scientific notation when
    that is shorter ("1e+05"); NULL stays NULL."""
    if not 0 <= digits <= 3:
        raise ValueError("digits must be between 0 and 3")
    v = report_round(c, digits)
    return _shortest_text(v, _fixed_text(v, digits))


def mean_se_text(mean: Column | str, se: Column | str, digits: int = 1) -> Column:
    """"mean ± SE" as text, a missing side printed as NA."""
    return F.concat(
        F.coalesce(num_text(mean, digits), F.lit("NA")),
        F.lit(" ± "),
        F.coalesce(num_text(se, digits), F.lit("NA")),
    )


def size_class_index(x: Column | str, width: float) -> Column:
    """1-based left-closed size class of ``x`` for classes ``[k·w, (k+1)·w)``.

    ``floor(x / w)`` can land one class off when ``w`` is not exactly
    representable (1.7 / 0.1 = 17 but 17·0.1 > 1.7); the two corrections
    compare against the class edges ``k·w`` computed the same way the edges
    themselves are.
    """
    if not width > 0:
        raise ValueError("width must be positive")
    x = col(x)
    w = F.lit(float(width))
    i0 = F.floor(x / w)
    i1 = F.when((i0 + 1) * w <= x, i0 + 1).otherwise(i0)
    i2 = F.when(i1 * w > x, i1 - 1).otherwise(i1)
    return i2 + 1  # bigint: a stray huge diameter must not fail the job


def _edge_text(v: Column) -> Column:
    s = F.round(v, 10).cast("decimal(38,10)").cast("string")
    return F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")


def size_class_label(i: Column | str, width: float, n_classes: Column | int | None = None) -> Column:
    """Label "lo-hi" of 1-based class ``i``; NULL below 1 or past
    ``n_classes + 1`` (the label list is one longer than the class count)."""
    i = col(i)
    w = F.lit(float(width))
    label = F.concat(_edge_text((i - 1) * w), F.lit("-"), _edge_text(i * w))
    ok = i >= 1
    if n_classes is not None:
        n = F.lit(n_classes) if isinstance(n_classes, int) else n_classes
        ok = ok & (i <= n + 1)
    return F.when(ok, label)
