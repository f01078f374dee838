"""Column builders: keys, hashing, scaling, dates, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def joined(*cols) -> Column:
    """The parts with ``_`` between them; a NULL part is empty, so its place stays."""
    return F.concat_ws("_", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols])


def item_cat_brand() -> Column:
    return joined("category", "brand")


def item_ccb() -> Column:
    return joined("category", "company", "brand")


def item_family() -> Column:
    return joined("category", "brand", "company", "chain")


def item_sku(df: DataFrame) -> Column | None:
    """Family plus size and measure, only where the table has both."""
    if not {"productsize", "productmeasure"} <= set(df.columns):
        return None
    return joined("category", "brand", "company", "chain", "productsize", "productmeasure")


def with_id(item: Column, id_col="id") -> Column:
    return joined(id_col, item)


def hash_digits(col) -> Column:
    """The first 32 bits of the md5 of the text form, as a bigint."""
    return F.conv(F.substring(F.md5(_c(col).cast("string")), 1, 8), 16, 10).cast("bigint")


def unit_hash(col) -> Column:
    """Deterministic pseudo-random number in [0, 1)."""
    return hash_digits(col) / F.lit(4294967296.0)


def in_sample(col, fraction: float) -> Column:
    return unit_hash(col) < F.lit(float(fraction))


def log_scale(x, cutoff: float = -100.0, beta: float = 1.0) -> Column:
    """0 -> 0 and 1 -> 1 on a log scale; values below the cutoff count as 0."""
    x = _c(x).cast("double")
    kept = F.when(x < F.lit(cutoff), F.lit(0.0)).otherwise(x)
    clamped = F.greatest(F.least(kept, F.lit(1e9)), F.lit(0.0))
    return F.log(1 + clamped / F.lit(beta)) / F.log(F.lit(1.0 + 1.0 / beta))


def log_scale_capped(x, cap: float = 7.0) -> Column:
    clamped = F.greatest(F.least(_c(x).cast("double"), F.lit(cap)), F.lit(0.0))
    return F.log2(1 + clamped)


def diff_days(a, b) -> Column:
    """Days from b to a (a - b)."""
    return F.datediff(_c(a), _c(b))


def diff_months(date, until: str = "2014-01-01") -> Column:
    return F.datediff(F.lit(until).cast("date"), _c(date)) / F.lit(30.0)


def parsed_date(text) -> Column:
    """The date of a 10-character yyyy-MM-dd text, else NULL."""
    text = _c(text)
    return F.when(F.length(text) == 10, F.try_to_date(text, "yyyy-MM-dd"))


# Upper edges, in days, of the first four recency bins and the names of all five.
RECENCY_EDGES = (30, 60, 90, 180)
RECENCY_NAMES = ("0-29 days", "30-59 days", "60-89 days", "90-179 days", ">=180 days")


def recency_bin(days) -> Column:
    """0..4 by age; NULL for negative ages."""
    days = _c(days)
    out = F.when(days < 0, F.lit(None).cast("int"))
    for i, edge in enumerate(RECENCY_EDGES):
        out = out.when(days < edge, i)
    return out.otherwise(len(RECENCY_EDGES))


def label_of(repeater) -> Column:
    """1 / 0 from 't' / 'f'."""
    return F.when(_c(repeater) == "t", 1.0).when(_c(repeater) == "f", 0.0)


TEST_LABEL = 0.5


def is_early(date, cutoff: str) -> Column:
    return _c(date) < F.lit(cutoff).cast("date")


def clean_number(x) -> Column:
    """NULL, NaN and the infinities become 0."""
    x = _c(x).cast("double")
    bad = x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def clamp_score(x, low: float = 1e-8, high: float = 10.0) -> Column:
    return F.least(F.greatest(_c(x), F.lit(low)), F.lit(high))


def fixed6(x) -> Column:
    return F.format_string("%.6f", _c(x))


def smoothed(hits, total, alpha: float, prior: float) -> Column:
    """(hits + alpha) / (total + alpha / prior)."""
    return (_c(hits) + F.lit(float(alpha))) / (_c(total) + F.lit(float(alpha / prior)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def product(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x * y)


def rounded(df: DataFrame, cols: Sequence[str], digits: int = 4) -> DataFrame:
    """Round doubles the way the SQL checks do; the nudge settles ties."""
    return df.withColumns({c: F.round(F.col(c).cast("double") + F.lit(1e-9), digits) for c in cols})
