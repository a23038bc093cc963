"""Registered forecast and scenario queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscope.functions import numeric
from shelfscope.functions.numeric import confidence_z
from shelfscope.operators import forecast
from shelfscope.operators.features import LAGS, PROMO_WINDOWS, ROLLING, YEAR_LAG
from shelfscope.operators.scorers import MeanScorer
from shelfscope.plans.oracle_tables import oracle
from shelfscope.plans.registry import Query, presented
from shelfscope.sources import tables

HORIZON = 30
SIGMA = 1000.0
BAND = forecast.Band(sigma=SIGMA, cap=60000.0)
SCENARIO = forecast.Controls("scenario", "weekends_only", False, 1, 12.5, 0.9)
PRICE_CHANGE, ELASTICITY = 4.0, 1.2
DAY = "strftime({}, '%Y-%m-%d')"


def _rounded(df):
    return presented(df.select(*[F.round(c, 3).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]))


def _naive(spark, sf, controls=(forecast.Controls(),), band=BAND):
    inputs = forecast.forecast_inputs(tables.fact_sales(spark, sf), tables.dim_store(spark, sf))
    return forecast.recursive_forecast(forecast.with_controls(inputs, list(controls)), MeanScorer(), HORIZON, band)


def _points(spark, sf, **where):
    return forecast.run_scenario(
        tables.fact_sales(spark, sf), tables.dim_store(spark, sf), MeanScorer(), BAND, HORIZON, SCENARIO,
        price_change_pct=PRICE_CHANGE, elasticity=ELASTICITY, **where)


def _all_points(spark, sf):
    shifted = SCENARIO.demand_shift_pct - ELASTICITY * PRICE_CHANGE
    sets = [forecast.Controls(confidence_level=0.9), forecast.Controls("scenario", "weekends_only", False, 1, shifted, 0.9)]
    return forecast.scenario_points(_naive(spark, sf, sets), "scenario")


def _future_controls(spark, sf):
    """Promotion, opening, price effect and error width for the month after each store's last day."""
    last = tables.fact_sales(spark, sf).groupBy("store_id").agg(F.max("full_date").alias("last_date"))
    days = last.select("store_id", F.posexplode(F.sequence(F.date_add("last_date", 1), F.date_add("last_date", 30))).alias("i", "date"))
    dow, step = F.weekday("date") + 1, F.col("i") + 1
    return presented(days.select(
        "store_id", "date", step.alias("step"),
        *[numeric.promo_value(m, dow).alias(f"promo_{m}") for m in ("always_on", "weekends_only", "as_is")],
        numeric.open_value(dow, False).alias("open_closed_weekend"),
        F.round(numeric.effective_shift_pct(step.cast("double"), PRICE_CHANGE, ELASTICITY), 6).alias("shift_pct"),
        F.round(numeric.clip(numeric.horizon_sigma(SIGMA, step), 1100.0, 1500.0), 6).alias("sigma"),
    ))


def _serving(spark, sf):
    inputs = forecast.forecast_inputs(tables.fact_sales(spark, sf), tables.dim_store(spark, sf))
    found = forecast.serving_features(forecast.with_controls(inputs, [SCENARIO])).drop("scenario_id")
    return presented(found.select(*[F.round(c, _digits(c)).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes]))


def _digits(feature: str) -> int:
    return 3 if feature.startswith("rolling_std") else 6


def _serving_sql() -> str:
    """The newest rows of a store counted back from its last day; means and deviations over the newest of them."""
    newest = "MAX(CASE WHEN k = 1 THEN sales END)"
    lag = lambda n, short: f"COALESCE(MAX(CASE WHEN k = {n} THEN sales END), {short})"
    mean = lambda w, c="sales": f"AVG(CASE WHEN k <= {w} THEN {c} END)"
    columns = {f"lag_{n}": lag(n, newest) for n in LAGS}
    columns |= {f"rolling_mean_{w}": mean(w) for w in ROLLING}
    columns |= {f"rolling_std_{w}": f"COALESCE(stddev_samp(CASE WHEN k <= {w} THEN sales END), 0)" for w in ROLLING}
    columns |= {f"promo_density_{w}": mean(w, "promo") for w in PROMO_WINDOWS}
    columns["lag_364"] = lag(YEAR_LAG, mean(28))
    ratio = lambda a, b, usable="TRUE": f"CASE WHEN {b} > 0 AND {usable} THEN {a} / {b} ELSE 1 END"
    ratios = {
        "lag_1_to_mean_7_ratio": ratio("lag_1", "rolling_mean_7"), "sales_velocity": ratio("rolling_mean_7", "rolling_mean_28"),
        "lag_364_to_mean_28_ratio": ratio("lag_364", "rolling_mean_28", f"n >= {YEAR_LAG}"),
    }
    day = {
        "promo": "isodow(d) >= 6", "school_holiday": "1", "open": "isodow(d) < 6", "day_of_week": "isodow(d)", "month": "month(d)",
        "quarter": "quarter(d)", "week_of_year": "week(d)", "is_weekend": "isodow(d) >= 6", "day_of_month": "day(d)",
        "is_month_start": "day(d) <= 3", "is_month_end": "day(d) >= 28", "days_since_start": "n", "competition_distance": "distance",
        "competition_distance_log": "ln(1 + distance)", "promo2": "promo2",
    }
    shown = ", ".join(f"ROUND(CAST({sql} AS DOUBLE), {_digits(name)}) AS {name}" for name, sql in {**{c: c for c in columns}, **ratios, **day}.items())
    return f"""WITH h AS (SELECT store_id, full_date, CAST(sales AS DOUBLE) AS sales, CAST(promo AS DOUBLE) AS promo,
            row_number() OVER (PARTITION BY store_id ORDER BY full_date DESC) AS k FROM fact),
        r AS (SELECT store_id, MAX(full_date) + 1 AS d, COUNT(*) AS n, {", ".join(f"{sql} AS {name}" for name, sql in columns.items())}
              FROM h WHERE k <= {forecast.HISTORY_DAYS} GROUP BY store_id),
        f AS (SELECT r.*, CAST(COALESCE(s.competition_distance, 0) AS DOUBLE) AS distance, COALESCE(s.promo2, 0) AS promo2
              FROM r JOIN dim_store s ON s.store_id = r.store_id)
        SELECT store_id, {DAY.format('d')} AS date, {shown} FROM f"""


def _recursive(shift: float, level: float, growing: bool = True, z: float | None = None, name: str = "f") -> str:
    z = confidence_z(level) if z is None else z
    growth = "(1 + 0.03 * least(step - 1, 89))" if growing else "1"
    clip = "least(greatest({}, 0), 60000)"
    nxt = clip.format(f"list_avg(h) * CAST({1 + shift / 100!r} AS DOUBLE)")
    return f"""{name}_r AS (
        SELECT store_id, last_date, 0 AS step, h, CAST(0 AS DOUBLE) AS p FROM last7
        UNION ALL
        SELECT store_id, last_date, step + 1, list_append(CASE WHEN len(h) >= 7 THEN h[2:] ELSE h END, {nxt}), {nxt}
        FROM {name}_r WHERE step < {HORIZON}),
    {name} AS (SELECT store_id, step, last_date + step AS date, p AS predicted_sales,
                      {clip.format(f"p - CAST({z!r} AS DOUBLE) * {SIGMA} * {growth}")} AS predicted_lower,
                      {clip.format(f"p + CAST({z!r} AS DOUBLE) * {SIGMA} * {growth}")} AS predicted_upper
               FROM {name}_r WHERE step > 0)"""


LAST7 = """WITH RECURSIVE last7 AS (
    SELECT store_id, MAX(full_date) AS last_date, list(CAST(sales AS DOUBLE) ORDER BY full_date) AS h
    FROM (SELECT * FROM fact QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY full_date DESC) <= 7)
    GROUP BY store_id)"""


def _oracle(tables_used: str, body: str) -> str:
    """The recursive keyword belongs to the whole WITH clause."""
    return oracle(tables_used, body.replace("WITH RECURSIVE", "WITH", 1)).replace("WITH ", "WITH RECURSIVE ", 1)


SHIFT = SCENARIO.demand_shift_pct - ELASTICITY * PRICE_CHANGE
POINTS = f"""{LAST7}, {_recursive(0, 0.9, name='b')}, {_recursive(SHIFT, 0.9, name='s')},
    pts AS (SELECT b.store_id, b.step, b.date, b.predicted_sales AS bs, s.predicted_sales AS ss,
                   s.predicted_lower AS sl, s.predicted_upper AS su, s.predicted_sales - b.predicted_sales AS delta
            FROM b JOIN s ON s.store_id = b.store_id AND s.step = b.step)"""
SUMMARY = """ROUND(SUM(bs), 3) AS total_baseline_sales, ROUND(SUM(ss), 3) AS total_scenario_sales,
    ROUND(SUM(ss) - SUM(bs), 3) AS total_delta_sales,
    ROUND(CASE WHEN SUM(bs) > 0 THEN (SUM(ss) - SUM(bs)) / SUM(bs) * 100 ELSE 0 END, 3) AS uplift_pct,
    ROUND((SUM(ss) - SUM(bs)) / COUNT(*), 3) AS avg_daily_delta,
    strftime(arg_max(date, (ROUND(delta, 3), -step)), '%Y-%m-%d') AS max_delta_date, ROUND(MAX(delta), 3) AS max_delta_value"""
FORECAST_SUMMARY = """strftime(arg_max(date, (ROUND(predicted_sales, 3), -step)), '%Y-%m-%d') AS peak_date,
    ROUND(SUM(predicted_sales), 3) AS total_predicted_sales,
    ROUND(AVG(predicted_sales), 3) AS avg_daily_sales, ROUND(MAX(predicted_sales), 3) AS peak_sales,
    ROUND(AVG(predicted_upper - predicted_lower), 3) AS avg_interval_width"""

QUERIES = [
    Query("serving_features", "W-11 X-4 X-5 W-8 W-9", _serving, oracle("fact dim_store", _serving_sql())),
    Query("forecast_naive_recursive", "M-13 F-8 F-9 F-10 W-11 X-5",
          lambda s, d: _rounded(_naive(s, d).drop("scenario_id")), _oracle("fact", f"""
        {LAST7}, {_recursive(0, 0.8)}
        SELECT store_id, CAST(step AS BIGINT) AS step, {DAY.format('date')} AS date,
               ROUND(predicted_sales, 3) AS predicted_sales, ROUND(predicted_lower, 3) AS predicted_lower,
               ROUND(predicted_upper, 3) AS predicted_upper FROM f""")),
    Query("forecast_fixed_band", "M-13", lambda s, d: _rounded(_naive(s, d, band=forecast.Band(
        SIGMA, cap=60000.0, growing=False, z=forecast.FIXED_BAND_Z)).drop("scenario_id", "date")), _oracle("fact", f"""
        {LAST7}, {_recursive(0, 0.8, growing=False, z=1.28)}
        SELECT store_id, CAST(step AS BIGINT) AS step, ROUND(predicted_sales, 3) AS predicted_sales,
               ROUND(predicted_lower, 3) AS predicted_lower, ROUND(predicted_upper, 3) AS predicted_upper FROM f""")),
    Query("forecast_summary", "A-26 M-14", lambda s, d: _rounded(
        forecast.store_forecast_summary(_naive(s, d)).drop("scenario_id")), _oracle("fact", f"""
        {LAST7}, {_recursive(0, 0.8)} SELECT store_id, {FORECAST_SUMMARY} FROM f GROUP BY store_id""")),
    Query("forecast_batch", "M-14 A-27 J-11", lambda s, d: _rounded(
        forecast.portfolio_series(_naive(s, d)).drop("scenario_id")), _oracle("fact", f"""
        {LAST7}, {_recursive(0, 0.8)}
        SELECT CAST(step AS BIGINT) AS step, {DAY.format('arg_min(date, store_id)')} AS date,
               ROUND(SUM(predicted_sales), 3) AS predicted_sales, ROUND(SUM(predicted_lower), 3) AS predicted_lower,
               ROUND(SUM(predicted_upper), 3) AS predicted_upper FROM f GROUP BY step""")),
    Query("portfolio_summary", "A-27", lambda s, d: _rounded(
        forecast.portfolio_summary(_naive(s, d)).drop("scenario_id")), _oracle("fact", f"""
        {LAST7}, {_recursive(0, 0.8)},
        q AS (SELECT step, arg_min(date, store_id) AS date, SUM(predicted_sales) AS predicted_sales, SUM(predicted_lower) AS predicted_lower,
                     SUM(predicted_upper) AS predicted_upper FROM f GROUP BY step)
        SELECT COUNT(*) AS horizon_days, {FORECAST_SUMMARY},
               (SELECT COUNT(DISTINCT store_id) FROM f) AS stores_count FROM q""")),
    Query("scenario_points", "M-15 J-10 F-12", lambda s, d: _rounded(_all_points(s, d)), _oracle("fact", f"""
        {POINTS} SELECT store_id, CAST(step AS BIGINT) AS step, {DAY.format('date')} AS date,
               ROUND(bs, 3) AS baseline_sales, ROUND(ss, 3) AS scenario_sales, ROUND(sl, 3) AS scenario_lower,
               ROUND(su, 3) AS scenario_upper, ROUND(delta, 3) AS delta_sales FROM pts""")),
    Query("scenario_store_summary", "A-28 M-15", lambda s, d: _rounded(
        forecast.scenario_summary(_all_points(s, d), ["store_id"])),
          _oracle("fact", f"{POINTS} SELECT store_id, {SUMMARY} FROM pts GROUP BY store_id")),
    Query("scenario_segment", "M-16 A-28 J-11 P-10", lambda s, d: _rounded(forecast.scenario_summary(
        forecast.segment_points(_points(s, d, segment=forecast.Segment(assortment="a"))))), _oracle("fact dim_store", f"""
        {POINTS}, seg AS (SELECT store_id FROM dim_store WHERE assortment = 'a'),
        q AS (SELECT step, arg_min(date, store_id) AS date, SUM(bs) AS bs, SUM(ss) AS ss, SUM(ss) - SUM(bs) AS delta FROM pts WHERE store_id IN (SELECT store_id FROM seg)
              GROUP BY step)
        SELECT {SUMMARY} FROM q""")),
    Query("future_controls", "F-8 F-10 F-11 F-12 X-8", _future_controls, oracle("fact", f"""
        WITH l AS (SELECT store_id, MAX(full_date) AS last_date FROM fact GROUP BY store_id),
        d AS (SELECT store_id, last_date + CAST(i AS INTEGER) AS date, i AS step
              FROM l, unnest(generate_series(1, 30)) AS u(i))
        SELECT store_id, {DAY.format('date')} AS date, step, CAST(1 AS BIGINT) AS promo_always_on,
               CAST(isodow(date) >= 6 AS BIGINT) AS promo_weekends_only, CAST(0 AS BIGINT) AS promo_as_is,
               CAST(isodow(date) < 6 AS BIGINT) AS open_closed_weekend,
               ROUND(step - 4.8::DOUBLE, 6) AS shift_pct,
               ROUND(least(greatest(1000 * (1 + 0.03::DOUBLE * least(step - 1, 89)), 1100), 1500), 6) AS sigma FROM d""")),
]
