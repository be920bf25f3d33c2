"""Scalar column expressions shared by the loaders and the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Party labels that count as the two major parties.
DEM_LABELS = ("D", "DEM", "DEMOCRAT", "DEMOCRATIC", "DFL")
REP_LABELS = ("R", "REP", "REPUBLICAN", "GOP")

# Fixed value: what counts as a number in text input.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zfill(c, width: int) -> Column:
    """Left-pad with zeros; unlike ``lpad`` it never shortens a longer key."""
    s = _col(c).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def nan_to_null(c) -> Column:
    """Missing numbers are NULL in every table, never NaN."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def to_number(c) -> Column:
    """Text or number to double; anything that is no number becomes NULL."""
    s = F.trim(_col(c).cast("string"))
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def to_count(c) -> Column:
    """Nearest whole number as bigint, halves to even."""
    return F.rint(to_number(c)).cast("bigint")


def share(part, total) -> Column:
    """``part / total`` where the total is positive, else NULL."""
    total = _col(total)
    return F.when(total > 0, _col(part).cast("double") / total.cast("double"))


def clip(c, low: float, high: float) -> Column:
    """Bound a value; NULL stays NULL (``least``/``greatest`` skip NULLs)."""
    c = _col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def residual_count(total, known: list) -> Column:
    """What the known parts leave of the total, never below zero."""
    rest = _col(total)
    for k in known:
        rest = rest - _col(k)
    return F.greatest(F.lit(0).cast("bigint"), rest)


def normalize_party(c) -> Column:
    """Free-text party to DEM, REP or OTHER; blank and NULL are OTHER."""
    p = F.upper(F.trim(_col(c)))
    return F.when(p.isin(*DEM_LABELS), "DEM").when(p.isin(*REP_LABELS), "REP").otherwise("OTHER")


def digits_only(c) -> Column:
    return F.regexp_replace(_col(c).cast("string"), "[^0-9]", "")


def normalize_cntyvtd(c, vtd_width: int) -> Column:
    """County (3 digits) plus unit code padded to ``vtd_width`` digits."""
    d = digits_only(c)
    return F.concat(F.substring(d, 1, 3), zfill(F.substring(d, 4, vtd_width), vtd_width))


def vtd_geoid(county_key, vtd_key, state: str = "48") -> Column:
    """State, county(3) and unit(6) codes in one text key; NULL if a part is no number."""
    county = to_number(county_key).cast("bigint")
    unit = to_number(vtd_key).cast("bigint")
    return F.concat(F.lit(state), zfill(county, 3), zfill(unit, 6))


def district_number(c, low: int | None = None, high: int | None = None) -> Column:
    """District number from free text: the one or two digits the text ends with.

    Area codes such as 4807, padded numbers and labels such as CD-07 all end
    in the number, so one rule covers them.  Outside ``low..high`` is NULL.
    """
    tail = F.regexp_extract(F.trim(_col(c).cast("string")), r"(\d{1,2})$", 1)
    n = F.when(tail != "", tail).cast("int")
    if low is not None and high is not None:
        n = F.when(n.between(low, high), n)
    return n


def district_number_loose(c, low: int, high: int) -> Column:
    """As ``district_number`` after dropping every character that is no digit."""
    return district_number(digits_only(c), low, high)


def logistic(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(c)))


def normal_density(c, mean: float, sd: float) -> Column:
    z = (_col(c) - F.lit(float(mean))) / F.lit(float(sd))
    return F.exp(-z * z / 2.0) / (F.lit(float(sd)) * F.sqrt(F.lit(2.0) * F.pi()))


def is_finite(c) -> Column:
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def timestamp_text() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")


def normalize_row(cols: list[str], keep_when_zero: bool = False) -> list[Column]:
    """Divide each column by the row sum; a row without mass gives 0 or stays as is."""
    total = F.col(cols[0])
    for c in cols[1:]:
        total = total + F.col(c)
    return [
        F.when(total > 0, F.col(c) / total).otherwise(F.col(c) if keep_when_zero else F.lit(0.0))
        for c in cols
    ]


def argmax_name(cols: list[str]) -> Column:
    """Name of the largest column; the first column wins a tie."""
    best = F.greatest(*[F.col(c) for c in cols])
    out = F.lit(None).cast("string")
    for c in reversed(cols):
        out = F.when(F.col(c) == best, F.lit(c)).otherwise(out)
    return out


def dot(weights, cols: list[str]) -> Column:
    """Linear form of columns with constant weights."""
    out = F.lit(0.0)
    for w, c in zip(weights, cols):
        out = out + F.lit(float(w)) * F.col(c)
    return out
