"""Registered feature, metric and split queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.operators import features, metrics, warehouse
from shelfscope.plans.oracle_tables import oracle
from shelfscope.plans.registry import Query, presented
from shelfscope.sources import tables

DAY = "strftime({}, '%Y-%m-%d')"
KEYS = ["store_id", "full_date"]


def _rows(spark, sf):
    return tables.fact_sales(spark, sf).join(warehouse.store_meta(tables.dim_store(spark, sf)), "store_id")


def _features(spark, sf):
    return features.with_series_features(_rows(spark, sf))


def _lags(spark, sf):
    return presented(_features(spark, sf).select(
        *KEYS, "days_since_start", *[f"lag_{k}" for k in (*features.LAGS, features.YEAR_LAG)]))


def _rolling(spark, sf):
    return presented(_features(spark, sf).select(
        *KEYS, *[f"rolling_mean_{w}" for w in features.ROLLING],
        *[F.round(f"rolling_std_{w}", 3).alias(f"rolling_std_{w}") for w in features.ROLLING],
        *[f"promo_density_{w}" for w in features.PROMO_WINDOWS]))


def _ratios(spark, sf):
    return presented(_features(spark, sf).select(
        *KEYS, "lag_1_to_mean_7_ratio", "sales_velocity", "lag_364_to_mean_28_ratio",
        F.round("competition_distance_log", 6).alias("competition_distance_log")))


def _frame(spark, sf):
    frame = features.training_frame(_rows(spark, sf))
    return presented(frame.select(
        *KEYS, "sales", *features.calendar_columns(F.col("full_date")), "days_since_start", "lag_28",
        "rolling_mean_56", "sales_velocity", "store_type"))


def _densified(spark, sf):
    dense = features.densified(tables.fact_sales(spark, sf).select("store_id", "full_date", "sales"))
    week_ago = F.lag("sales", 7).over(W.partitionBy("store_id").orderBy("full_date"))
    return presented(dense.withColumn("lag_7", week_ago).where("sales > 0").select(*KEYS, "sales", "lag_7"))


def _scored(spark, sf):
    """Each day predicted by the row seven rows earlier, with the store type for grouping."""
    series = W.partitionBy("store_id").orderBy("full_date")
    stores = tables.dim_store(spark, sf).select("store_id", "store_type")
    fact = tables.fact_sales(spark, sf).select(*KEYS, F.col("sales").cast("double").alias("sales"))
    lagged = fact.withColumn("prediction", F.lag("sales", 7).over(series)).where("prediction IS NOT NULL")
    return lagged.join(stores, "store_id")


def _rounded(df):
    return presented(df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]))


def _metrics(spark, sf):
    return _rounded(metrics.evaluate(_scored(spark, sf), "sales", "prediction"))


def _metrics_by_type(spark, sf):
    return _rounded(metrics.evaluate(_scored(spark, sf), "sales", "prediction", ["store_type"]))


def _back_windows(spark, sf):
    scored = metrics.with_back_window(_scored(spark, sf), validation_days=90, window_days=30, folds=2)
    return _rounded(metrics.evaluate(scored, "sales", "prediction", ["fold"]))


def _split(spark, sf):
    marked = metrics.with_split(tables.fact_sales(spark, sf), validation_days=90)
    return presented(marked.groupBy("is_validation").agg(
        F.count("*").alias("num_rows"), F.min("full_date").alias("period_start"), F.max("full_date").alias("period_end")))


def _share_split(spark, sf):
    marked = metrics.with_share_split(tables.fact_sales(spark, sf))
    return presented(marked.groupBy("is_validation").agg(
        F.count("*").alias("num_rows"), F.min("full_date").alias("period_start"), F.max("full_date").alias("period_end")))


def _newest(spark, sf):
    return presented(metrics.newest_rows(tables.fact_sales(spark, sf), 5000).select(*KEYS, "sales"))


SERIES = "PARTITION BY store_id ORDER BY full_date"
BASE = ("WITH b AS (SELECT f.*, s.store_type, CAST(s.competition_distance AS DOUBLE) AS competition_distance, "
        "CAST(f.sales * 100 AS BIGINT) AS cents FROM fact f JOIN dim_store s ON s.store_id = f.store_id)")


def _mean(w: int, value: str = "cents", scale: str = "100") -> str:
    over = f"OVER ({SERIES} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"CAST(SUM({value}) {over} AS DOUBLE) / (CAST(COUNT(*) {over} AS DOUBLE) * {scale})"


def _lag(k: int) -> str:
    return f"CAST(LAG(sales, {k}) OVER ({SERIES}) AS DOUBLE)"


def _std(w: int) -> str:
    return (f"ROUND(COALESCE(stddev_samp(CAST(sales AS DOUBLE)) OVER ({SERIES} ROWS BETWEEN {w} PRECEDING "
            f"AND 1 PRECEDING), 0), 3) AS rolling_std_{w}")


YEAR = f"COALESCE({_lag(364)}, {_mean(28)})"
SCORED = f"""WITH scored AS (
    SELECT f.store_id, full_date, CAST(sales AS DOUBLE) AS y, p, s.store_type FROM (
        SELECT *, CAST(LAG(sales, 7) OVER ({SERIES}) AS DOUBLE) AS p FROM fact) f
    JOIN dim_store s ON s.store_id = f.store_id WHERE p IS NOT NULL)"""
METRICS = """COUNT(*) AS num_rows, ROUND(AVG(abs(y - p)), 6) AS mae, ROUND(sqrt(AVG((y - p) * (y - p))), 6) AS rmse,
    ROUND(AVG(abs(y - p) / greatest(abs(y), 1)) * 100, 6) AS mape,
    ROUND(AVG(CASE WHEN abs(y) > 1 THEN abs(y - p) / greatest(abs(y), 1e-8) END) * 100, 6) AS mape_nonzero,
    ROUND(AVG(2 * abs(y - p) / greatest(abs(y) + abs(p), 1e-8)) * 100, 6) AS smape,
    ROUND(SUM(abs(y - p)) / greatest(SUM(abs(y)), 1e-8) * 100, 6) AS wape,
    ROUND(stddev_pop(y - p), 6) AS residual_std,
    ROUND(0.5 * sqrt(AVG((y - p) * (y - p))) / greatest(AVG(y), 1)
          + 0.5 * (SUM(abs(y - p)) / greatest(SUM(abs(y)), 1e-8)), 6) AS composite"""
SPLIT = f"""COUNT(*) AS num_rows, {DAY.format('MIN(full_date)')} AS period_start,
    {DAY.format('MAX(full_date)')} AS period_end"""

QUERIES = [
    Query("lag_features", "W-3 W-7 W-8", _lags, oracle("fact dim_store", f"""{BASE}
        SELECT store_id, {DAY.format('full_date')} AS full_date, row_number() OVER ({SERIES}) - 1 AS days_since_start,
               {', '.join(f'{_lag(k)} AS lag_{k}' for k in features.LAGS)}, {YEAR} AS lag_364 FROM b""")),
    Query("rolling_features", "W-4 W-5 W-6 X-4", _rolling, oracle("fact dim_store", f"""{BASE}
        SELECT store_id, {DAY.format('full_date')} AS full_date,
               {', '.join(f'{_mean(w)} AS rolling_mean_{w}' for w in features.ROLLING)},
               {', '.join(_std(w) for w in features.ROLLING)},
               {', '.join(f"{_mean(w, 'promo', '1')} AS promo_density_{w}" for w in features.PROMO_WINDOWS)} FROM b""")),
    Query("ratio_features", "W-8 W-9 F-7", _ratios, oracle("fact dim_store", f"""{BASE},
        w AS (SELECT *, {_lag(1)} AS l1, {YEAR} AS ly, {_mean(7)} AS m7, {_mean(28)} AS m28 FROM b)
        SELECT store_id, {DAY.format('full_date')} AS full_date,
               COALESCE(l1 / NULLIF(m7, 0), 1) AS lag_1_to_mean_7_ratio,
               COALESCE(m7 / NULLIF(m28, 0), 1) AS sales_velocity,
               COALESCE(ly / NULLIF(m28, 0), 1) AS lag_364_to_mean_28_ratio,
               ROUND(ln(1 + competition_distance), 6) AS competition_distance_log FROM w""")),
    Query("training_frame", "W-10 F-5 M-2", _frame, oracle("fact dim_store", f"""{BASE},
        w AS (SELECT *, {_lag(28)} AS lag_28, {_mean(56)} AS rolling_mean_56, {_mean(7)} AS m7, {_mean(28)} AS m28,
                     row_number() OVER ({SERIES}) - 1 AS days_since_start FROM b)
        SELECT store_id, {DAY.format('full_date')} AS full_date, CAST(sales AS DOUBLE) AS sales,
               isodow(full_date) AS day_of_week, month(full_date) AS month, quarter(full_date) AS quarter,
               weekofyear(full_date) AS week_of_year, CAST(isodow(full_date) >= 6 AS BIGINT) AS is_weekend,
               day(full_date) AS day_of_month, CAST(day(full_date) <= 3 AS BIGINT) AS is_month_start,
               CAST(day(full_date) >= 28 AS BIGINT) AS is_month_end, days_since_start, lag_28, rolling_mean_56,
               COALESCE(m7 / NULLIF(m28, 0), 1) AS sales_velocity, store_type FROM w WHERE lag_28 IS NOT NULL""")),
    Query("densified_lag", "X-16", _densified, oracle("fact", f"""
        SELECT a.store_id, {DAY.format('a.full_date')} AS full_date, CAST(a.sales AS DOUBLE) AS sales,
               CASE WHEN a.full_date - 7 >= f.first THEN COALESCE(CAST(b.sales AS DOUBLE), 0) END AS lag_7
        FROM fact a JOIN (SELECT store_id, MIN(full_date) AS first FROM fact GROUP BY 1) f ON f.store_id = a.store_id
        LEFT JOIN fact b ON b.store_id = a.store_id AND b.full_date = a.full_date - 7 WHERE a.sales > 0""")),
    Query("error_metrics", "A-29 A-31 A-33", _metrics, oracle("fact dim_store", f"""{SCORED}
        SELECT {METRICS} FROM scored""")),
    Query("error_metrics_by_group", "A-30", _metrics_by_type, oracle("fact dim_store", f"""{SCORED}
        SELECT store_type, {METRICS} FROM scored GROUP BY store_type""")),
    Query("back_window_metrics", "M-8 X-15", _back_windows, oracle("fact dim_store", f"""{SCORED},
        n AS (SELECT MAX(full_date) - 90 AS last FROM scored),
        k AS (SELECT scored.*, date_diff('day', full_date, last) // 30 + 1 AS fold FROM scored, n WHERE full_date <= last)
        SELECT fold, {METRICS} FROM k WHERE fold <= 2 GROUP BY fold""")),
    Query("prediction_cap", "A-32", lambda s, d: presented(
        metrics.prediction_cap(tables.fact_sales(s, d)).select(F.round("prediction_cap", 4).alias("prediction_cap"))),
          oracle("fact", """
        SELECT ROUND(quantile_cont(CAST(sales AS DOUBLE), 0.997), 4) AS prediction_cap FROM fact""")),
    Query("time_split_counts", "M-3", _split, oracle("fact", f"""
        SELECT full_date > (SELECT MAX(full_date) FROM fact) - 90 AS is_validation, {SPLIT} FROM fact GROUP BY 1""")),
    Query("share_split_counts", "M-4", _share_split, oracle("fact", f"""
        WITH d AS (SELECT full_date, row_number() OVER (ORDER BY full_date) AS r, COUNT(*) OVER () AS n
                   FROM (SELECT DISTINCT full_date FROM fact)),
        c AS (SELECT full_date AS cutoff FROM d WHERE r = least(greatest(CAST(floor(n * 0.8) AS BIGINT), 1), n - 1))
        SELECT full_date > cutoff AS is_validation, {SPLIT} FROM fact, c GROUP BY 1""")),
    Query("newest_rows", "M-4", _newest, oracle("fact", f"""
        SELECT store_id, {DAY.format('full_date')} AS full_date, CAST(sales AS DOUBLE) AS sales FROM fact
        ORDER BY fact.full_date DESC, store_id LIMIT 5000""")),
]
