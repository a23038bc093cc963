"""Numeric scalar functions shared by KPIs, forecasts and delivery logic."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RETRYABLE_STATUSES = (408, 429)
MAX_BACKOFF_SECONDS = 24 * 3600
SIGMA_GROWTH_PER_DAY = 0.03
SIGMA_GROWTH_DAYS = 89


def mean_of(value: Column) -> Column:
    """Mean of a decimal or integer column as a double: exact sum, one division at the end.

    ``avg`` on decimals rounds to a fixed scale; dividing the exact sum keeps full double precision and
    does not depend on the order in which partial sums meet.
    """
    return F.sum(value).cast("double") / F.count(value)


def clip(value: Column, floor: float, cap: float | Column | None) -> Column:
    floored = F.greatest(value, F.lit(float(floor)))
    if cap is None:
        return floored
    return F.least(floored, cap if isinstance(cap, Column) else F.lit(float(cap)))


def confidence_z(confidence_level: float) -> float:
    """Two-sided normal quantile, the level held between 0.5 and 0.99."""
    level = min(0.99, max(0.5, confidence_level))
    return NormalDist().inv_cdf(0.5 + level / 2.0)


def horizon_sigma(sigma: float, step: Column) -> Column:
    """Error width that grows by three percent per day ahead, for ninety days."""
    return F.lit(float(sigma)) * (1 + SIGMA_GROWTH_PER_DAY * F.least(step - 1, F.lit(SIGMA_GROWTH_DAYS)))


def promo_value(mode: str | Column, day_of_week: Column) -> Column:
    """Promotion flag of a future day; every mode but the two named ones means no promotion."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return (
        F.when(mode == "always_on", 1)
        .when((mode == "weekends_only") & day_of_week.isin(6, 7), 1)
        .otherwise(0)
    )


def open_value(day_of_week: Column, weekend_open: bool | Column) -> Column:
    weekend_open = F.lit(weekend_open) if isinstance(weekend_open, bool) else weekend_open
    return F.when(day_of_week.isin(6, 7) & ~weekend_open, 0).otherwise(1)


def price_effect_pct(price_change_pct: Column | float, elasticity: float = 1.0) -> Column:
    change = price_change_pct if isinstance(price_change_pct, Column) else F.lit(float(price_change_pct))
    return change * F.lit(-float(elasticity))


def effective_shift_pct(
    demand_shift_pct: Column | float, price_change_pct: Column | float, elasticity: float = 1.0
) -> Column:
    shift = demand_shift_pct if isinstance(demand_shift_pct, Column) else F.lit(float(demand_shift_pct))
    return shift + price_effect_pct(price_change_pct, elasticity)


def uplift_pct(value: Column, base: Column, otherwise: float | None = None) -> Column:
    """(value - base) / base in percent where the base is positive."""
    return F.when(base > 0, (value - base) / base * 100.0).otherwise(
        F.lit(otherwise).cast("double")
    )


def retry_delay_seconds(base_seconds: Column, attempt: Column) -> Column:
    """Doubling backoff from the first attempt on, never more than a day."""
    base = F.greatest(base_seconds.cast("double"), F.lit(1.0))
    exponent = F.greatest(attempt, F.lit(1)) - 1
    return F.least(base * F.pow(F.lit(2.0), exponent), F.lit(float(MAX_BACKOFF_SECONDS))).cast("long")


def is_retryable(http_status: Column) -> Column:
    return http_status.isin(*RETRYABLE_STATUSES) | (http_status >= 500)


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end, never negative; null while either is missing."""
    passed = F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("long")
    return F.when(passed < 0, F.lit(0).cast("long")).otherwise(passed)


OPERATORS = (">", ">=", "<", "<=", "==", "!=")


def compare(left: Column, operator: Column, right: Column) -> Column:
    """Comparison whose operator is data."""
    return (
        F.when(operator == ">", left > right)
        .when(operator == ">=", left >= right)
        .when(operator == "<", left < right)
        .when(operator == "<=", left <= right)
        .when(operator == "==", left == right)
        .when(operator == "!=", left != right)
    )
