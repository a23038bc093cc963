"""Time-series features per store.

Every lag, rolling mean and density comes from windows with the same partition and order, so one shuffle and
one sort serve all of them. The fact holds one row per store and day: a store's group is bounded by the
calendar, however many sales lines the store has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.functions.calendar import calendar_columns

# Fixed values.
LAGS = (1, 3, 7, 14, 21, 28)
YEAR_LAG = 364
ROLLING = (7, 14, 28, 56)
PROMO_WINDOWS = (7, 14)

NUMERIC_FEATURES = [
    "store_id", "promo", "school_holiday", "open", "competition_distance", "competition_distance_log", "promo2",
    "day_of_week", "month", "quarter", "week_of_year", "is_weekend", "day_of_month", "is_month_start",
    "is_month_end", "days_since_start", "lag_1", "lag_3", "lag_7", "lag_14", "lag_21", "lag_28", "lag_364",
    "rolling_mean_7", "rolling_mean_14", "rolling_mean_28", "rolling_mean_56", "rolling_std_7", "rolling_std_14",
    "rolling_std_28", "rolling_std_56", "lag_1_to_mean_7_ratio", "sales_velocity", "lag_364_to_mean_28_ratio",
    "promo_density_7", "promo_density_14",
]
CATEGORICAL_FEATURES = ["state_holiday", "store_type", "assortment"]


def _ratio(top: Column, bottom: Column) -> Column:
    """1.0 where either side is missing or the divisor is zero."""
    return F.coalesce(F.try_divide(top, F.nullif(bottom, F.lit(0.0))), F.lit(1.0))


def with_calendar(df: DataFrame, day: str = "full_date") -> DataFrame:
    return df.withColumns(calendar_columns(F.col(day)))


def with_series_features(df: DataFrame) -> DataFrame:
    """Lags, rolling statistics, ratios and promotion density of ``sales`` (two decimals) per store.

    Rolling means and sample deviations are differences of running sums of whole cents and of their squares: exact
    integers, and constant work per row whatever the window length.
    """
    series = W.partitionBy("store_id").orderBy("full_date")
    before = series.rowsBetween(W.unboundedPreceding, -1)
    has_promo = "promo" in df.columns

    cents = F.round(F.col("sales") * 100).cast("long")
    base = df.withColumns({"_cents": cents, "sales": F.col("sales").cast("double")})
    first = {
        "days_since_start": F.row_number().over(series) - 1,
        "_run": F.coalesce(F.sum("_cents").over(before), F.lit(0)),
        "_known": F.count("_cents").over(before),
        "_squares": F.coalesce(F.sum(F.col("_cents").cast("decimal(19,0)") * F.col("_cents").cast("decimal(19,0)")).over(before), F.lit(0).cast("decimal(38,0)")),
        **{f"lag_{k}": F.lag("sales", k).over(series) for k in (*LAGS, YEAR_LAG)},
    }
    if has_promo:
        first["_promo_run"] = F.coalesce(F.sum(F.col("promo").cast("long")).over(before), F.lit(0))
    seen = F.col("days_since_start")

    def mean(run: str, width: int, scale: float) -> Column:
        rows = F.least(seen, F.lit(width))
        total = F.col(run) - F.coalesce(F.lag(run, width).over(series), F.lit(0))
        return F.when(rows > 0, total / (rows * F.lit(scale)))

    def within(run: str, width: int, like: str) -> Column:
        return F.col(run) - F.coalesce(F.lag(run, width).over(series), F.lit(0).cast(like))

    def deviation(width: int) -> Column:
        n, total = within("_known", width, "long"), within("_run", width, "long").cast("decimal(19,0)")
        # n * sum of squares - square of the sum: exact, so equal sales have no deviation at all.
        spread = within("_squares", width, "decimal(38,0)").cast("decimal(33,0)") * n.cast("decimal(4,0)") - total * total
        return F.when(n > 1, F.sqrt(spread.cast("double") / (n * (n - 1)).cast("double")) / 100.0).otherwise(0.0)

    second = {f"rolling_mean_{w}": mean("_run", w, 100.0) for w in ROLLING}
    second |= {f"rolling_std_{w}": deviation(w) for w in ROLLING}
    second |= {
        f"promo_density_{w}": mean("_promo_run", w, 1.0) if has_promo else F.lit(0.0) for w in PROMO_WINDOWS
    }
    out = base.withColumns(first).withColumns(second).drop("_cents", "_run", "_known", "_squares", "_promo_run")
    out = out.withColumn("lag_364", F.coalesce("lag_364", "rolling_mean_28"))
    distance = F.col("competition_distance").cast("double") if "competition_distance" in df.columns else None
    return out.withColumns(
        {
            "lag_1_to_mean_7_ratio": _ratio(F.col("lag_1"), F.col("rolling_mean_7")),
            "sales_velocity": _ratio(F.col("rolling_mean_7"), F.col("rolling_mean_28")),
            "lag_364_to_mean_28_ratio": _ratio(F.col("lag_364"), F.col("rolling_mean_28")),
            "competition_distance_log": F.log1p(distance) if distance is not None else F.lit(0.0),
        }
    )


def training_frame(rows: DataFrame) -> DataFrame:
    """Calendar and series features; rows without all short lags are left out."""
    return with_series_features(with_calendar(rows)).dropna(subset=[f"lag_{k}" for k in LAGS])


def densified(rows: DataFrame) -> DataFrame:
    """A row for every calendar day between a store's first and last, missing days as zero sales.

    Row lags shift when days are missing; on densified rows they are calendar lags.
    """
    span = rows.groupBy("store_id").agg(F.min("full_date").alias("first"), F.max("full_date").alias("last"))
    days = span.select("store_id", F.explode(F.sequence("first", "last")).alias("full_date"))
    return days.join(rows, ["store_id", "full_date"], "left").fillna(0, subset=["sales"])
