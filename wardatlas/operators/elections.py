"""Election returns: one contest, one row per unit, votes by party."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import digits_only, normalize_cntyvtd, normalize_party, share, to_count, to_number
from ..tables import ensure_columns, require_columns, standard_names
from .joins import shuffled

WIDE_VOTES = ("dem_votes", "rep_votes", "third_party_votes", "total_votes")


def offices(df: DataFrame) -> DataFrame:
    """Distinct non-blank contest names."""
    return df.select(F.trim("office").alias("office")).where("office <> ''").distinct()


def one_office(df: DataFrame, office: str | None = None) -> DataFrame:
    """Keep one contest; without a choice the table must hold at most one."""
    if "office" not in df.columns:
        return df
    if office is None:
        found = [r["office"] for r in offices(df).limit(11).collect()]
        if len(found) > 1:
            raise ValueError(f"several offices and none chosen, for example {sorted(found)[:10]}")
        return df
    out = df.where(F.lower(F.trim("office")) == office.strip().lower())
    if out.isEmpty():
        found = [r["office"] for r in offices(df).limit(15).collect()]
        raise ValueError(f"no rows for office {office!r}; offices present: {sorted(found)}")
    return out


def unit_key(df: DataFrame, prefer: str = "vtdkey") -> tuple[DataFrame, str]:
    """Add the key the returns are keyed by and say which one it is.

    ``vtdkeyvalue`` when it is preferred, else ``cntyvtd``, else whichever
    numeric key there is.
    """
    numeric = next((c for c in ("vtdkeyvalue", "vtdkey") if c in df.columns), None)
    if "cntyvtd" in df.columns and not (prefer == "vtdkey" and numeric == "vtdkeyvalue"):
        return df.withColumn("cntyvtd", F.trim(F.col("cntyvtd").cast("string"))), "cntyvtd"
    if numeric:
        return df.withColumn("vtdkey", to_number(numeric).cast("bigint")), "vtdkey"
    raise ValueError("returns need vtdkeyvalue, vtdkey or cntyvtd")


def cntyvtd_width(df: DataFrame, column: str, default: int = 6) -> int:
    """Width of the unit code: 6 or 5 by the longest digit string, else the default."""
    longest = df.agg(F.max(F.length(digits_only(column)))).first()[0]
    return default if longest is None else 6 if longest >= 6 else 5 if longest == 5 else default


def with_cntyvtd(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("cntyvtd", normalize_cntyvtd(column, cntyvtd_width(df, column)))


def votes_by_party(df: DataFrame, key: str) -> DataFrame:
    """Tall rows to one row per key: conditional sums, combined before the shuffle.

    Every party that is neither major one counts as third party; unreadable
    votes count as 0; rows without a key are left out.
    """
    rows = df.where(F.col(key).isNotNull()).select(
        key, normalize_party("party").alias("p"), F.coalesce(to_number("votes").cast("bigint"), F.lit(0)).alias("v"))
    out = rows.groupBy(key).agg(
        F.sum(F.when(F.col("p") == "DEM", F.col("v")).otherwise(0)).alias("dem_votes"),
        F.sum(F.when(F.col("p") == "REP", F.col("v")).otherwise(0)).alias("rep_votes"),
        F.sum(F.when(F.col("p") == "OTHER", F.col("v")).otherwise(0)).alias("third_party_votes"),
    )
    return out.withColumn("total_votes", F.col("dem_votes") + F.col("rep_votes") + F.col("third_party_votes"))


def clean_returns(df: DataFrame, office: str | None = None, prefer: str = "vtdkey") -> DataFrame:
    """Tall or wide returns to key, dem, rep, third-party and total votes."""
    df = one_office(standard_names(df), office)
    df, key = unit_key(df, prefer)
    if {"party", "votes"} <= set(df.columns):
        return votes_by_party(df, key)
    require_columns(df, ("dem_votes", "rep_votes", "total_votes"), "wide election returns")
    df = ensure_columns(df, {"third_party_votes": 0})
    keys = {"vtdkey": to_number("vtdkey").cast("bigint"), "cntyvtd": F.trim(F.col("cntyvtd").cast("string"))}
    return df.select(*[e.alias(k) for k, e in keys.items() if k in df.columns], *[F.coalesce(to_number(c).cast("bigint"), F.lit(0)).alias(c) for c in WIDE_VOTES])


def sum_by_key(df: DataFrame, key: str = "vtdkey") -> DataFrame:
    """One row per key: repeated rows are added up."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.sum(c).alias(c) for c in WIDE_VOTES])


def returns_by_unit(units: DataFrame, wide: DataFrame, election_id: str) -> DataFrame:
    """Returns on the whole unit universe; a unit that did not report keeps NULL votes."""
    joined = units.select("vtd_geoid", "vtdkey").join(shuffled(sum_by_key(wide)), "vtdkey", "left")
    return joined.select(
        F.lit(election_id).alias("election_id"), "vtd_geoid",
        to_count("total_votes").alias("votes_total"), to_count("dem_votes").alias("votes_dem"),
        to_count("rep_votes").alias("votes_rep"), to_count("third_party_votes").alias("votes_other"),
        share("dem_votes", "total_votes").alias("dem_share"),
    )
