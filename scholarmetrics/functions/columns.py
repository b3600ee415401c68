"""Native column expressions, correct under ANSI mode.

Division, casts and array lookups use the ``try_`` forms so that a zero
denominator, a malformed id or a position past the end gives NULL instead of
failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_core(type_col, cfg: Config) -> Column:
    """Publication type is one of the core types (articles, conference papers, reviews)."""
    return _c(type_col).isin(list(cfg.core_types))


def in_span(year_col, cfg: Config) -> Column:
    """Year between min_year and max_year, both inclusive."""
    return _c(year_col).between(cfg.min_year, cfg.max_year)


def as_long_ids(arr) -> Column:
    """array<string> of author ids -> array<bigint>; malformed ids become NULL."""
    return F.transform(_c(arr), lambda x: x.try_cast("bigint"))


def shares_author(a, b) -> Column:
    """True when the two id arrays have a common non-null id.

    NULL ids are dropped first: an unknown author is not a shared one. A NULL
    array (paper without authors) shares nothing.
    """
    fa = F.filter(_c(a), lambda x: x.isNotNull())
    fb = F.filter(_c(b), lambda x: x.isNotNull())
    return F.coalesce(F.arrays_overlap(fa, fb), F.lit(False))


def ratio(num, den) -> Column:
    """num / den as double, NULL for a zero or NULL denominator."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def percent_label(num, den, suffix: str = " %") -> Column:
    """100 * num / den rounded half-up to two decimals, as text ('12.34 %').

    Computed from the integer counts, so the label is exact and identical in
    any engine; NULL when den is zero or NULL.
    """
    n = _c(num).cast("long")
    d = _c(den).cast("long")
    bp = F.floor((F.lit(20000) * n + d) / (F.lit(2) * d)).cast("long")  # basis points, half-up
    return F.when(d.isNull() | (d == 0) | n.isNull(), F.lit(None).cast("string")).otherwise(
        F.format_string("%d.%02d" + suffix.replace("%", "%%"), F.floor(bp / 100).cast("long"), bp % 100)
    )


def within_percentile_upper(rank_desc, n_nonnull, p: float) -> Column:
    """Upper-bound percentile test: (n - (rank - 1)) / n >= p, rank by value descending."""
    n = _c(n_nonnull)
    return F.try_divide((n - (_c(rank_desc) - 1)).cast("double"), n.cast("double")) >= F.lit(p)


def within_percentile_lower(rank_asc, n_all, p: float) -> Column:
    """Lower-bound percentile test: rank / n >= p, rank by value ascending over all rows."""
    return F.try_divide(_c(rank_asc).cast("double"), _c(n_all).cast("double")) >= F.lit(p)
