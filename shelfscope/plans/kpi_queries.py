"""Registered KPI and star-schema queries with their SQL counterparts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from shelfscope.functions.calendar import date_key, freshness_class
from shelfscope.operators import grid, kpi, profiles, warehouse
from shelfscope.plans.oracle_tables import oracle
from shelfscope.plans.registry import Query, presented
from shelfscope.sources import tables

FROM, TO = date(1997, 3, 10), date(1999, 10, 20)
BETWEEN = "BETWEEN DATE '1997-03-10' AND DATE '1999-10-20'"
DAY = "strftime({}, '%Y-%m-%d')"


def _fact(spark, sf):
    return tables.fact_sales(spark, sf)


def _fact_in_window(spark, sf):
    return tables.fact_sales(spark, sf, FROM, TO)


def _stores(spark, sf):
    return tables.dim_store(spark, sf)


def _dim_date(spark, sf):
    days = tables.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("full_date"))
    return warehouse.build_dim_date(days)


def _fact_report(spark, sf):
    return presented(_fact(spark, sf))


def _dim_date_report(spark, sf):
    return presented(_dim_date(spark, sf))


def _star(spark, sf):
    rows = warehouse.training_rows(_fact(spark, sf), _dim_date(spark, sf), _stores(spark, sf))
    return presented(rows)


def _availability(spark, sf):
    fact = _fact(spark, sf)
    return presented(
        kpi.data_availability(
            {
                "fact_sales_daily": (fact, "full_date"),
                "dim_store": (tables.table(spark, sf, "supplier"), None),
                "preflight_runs": (tables.table(spark, sf, "events"), "ts"),
                "forecast_runs": (None, None),
            }
        )
    )


def _freshness(spark, sf):
    """Freshness of each store's last sales day against the newest day of all stores."""
    last = _fact(spark, sf).groupBy("store_id").agg(F.max("full_date").alias("last_day"))
    newest = last.agg(F.max("last_day").alias("today"))
    return presented(
        last.crossJoin(F.broadcast(newest)).select(
            "store_id",
            "last_day",
            F.datediff("today", "last_day").alias("age_days"),
            freshness_class(F.col("last_day"), F.col("today")).alias("freshness"),
        )
    )


EDA_COLUMNS = ("store_id", "full_date", "sales", "customers", "promo", "state_holiday", "school_holiday", "open")


def _eda_columns(spark, sf):
    fact = _fact(spark, sf)
    return presented(kpi.column_profile(fact.drop("date_id")))


def _eda_sketches(spark, sf):
    """Daily sketches of the fact, merged over all days; within known bounds of ``eda_columns`` and exact quantiles."""
    rule = profiles.Sketches(distinct=EDA_COLUMNS, quantiles=("sales", "customers"), frequent=("promo", "state_holiday"))
    fact = _fact(spark, sf)
    fact = fact.select("full_date", *[F.col(c).cast("double").alias(c) if c in rule.quantiles else F.col(c) for c in EDA_COLUMNS if c != "full_date"])
    merged = profiles.merged_profile(profiles.daily_profiles(fact, "full_date", rule), rule, (0.5, 0.95, 0.997))
    top = F.transform("frequent", lambda f: F.concat(f["value"], F.lit("="), f["num_rows"].cast("string")))
    shown = F.array_join(F.transform("quantiles", lambda q: F.round(q, 2).cast("string")), ",")
    return presented(merged.withColumns({"frequent": F.array_join(F.array_sort(top), ","), "quantiles": shown}))


def _eda_values(spark, sf):
    fact = _fact(spark, sf)
    frames = [
        kpi.value_counts(fact, c).select(F.lit(c).alias("column_name"), "value", "num_rows")
        for c in ("promo", "open", "state_holiday", "school_holiday")
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return presented(out)


def _eda_calendar(spark, sf):
    fact = _fact(spark, sf)
    parts = [
        kpi.kpi_by_calendar(fact, unit).select(
            F.lit(unit).alias("unit"), F.col(unit).alias("part"), "total_sales", "avg_sales", "num_days"
        )
        for unit in ("weekday", "month")
    ]
    return presented(parts[0].unionByName(parts[1]))


def _broken_keys(spark, sf):
    """The store dimension without the stores of one assortment, so that breaks exist."""
    stores = _stores(spark, sf).where("assortment <> 'b'")
    return presented(warehouse.broken_keys(_fact(spark, sf), stores, _dim_date(spark, sf)))


def _date_gaps(spark, sf):
    """Sundays closed: every closed Sunday is a gap in the calendar."""
    fact = _fact(spark, sf).where(F.weekday("full_date") != 6)
    return presented(warehouse.date_gaps(fact))


def _missing(spark, sf):
    fact = _fact(spark, sf)
    damaged = fact.select(
        F.when(F.col("customers") % 7 != 0, F.col("store_id")).alias("store_id"),
        F.when(F.col("customers") % 11 != 0, date_key(F.col("full_date"))).alias("date_id"),
        F.when(F.col("customers") % 13 != 0, F.col("sales")).alias("sales"),
    )
    return presented(warehouse.missing_values(damaged))


def _duplicates(spark, sf):
    return presented(
        warehouse.duplicate_keys(tables.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    )


def _duplicate_samples(spark, sf):
    return presented(
        warehouse.duplicate_keys(tables.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], limit=10)
    )


def _meta(spark, sf):
    return presented(warehouse.store_meta(_stores(spark, sf)))


def _history(spark, sf):
    return presented(warehouse.recent_history(_fact(spark, sf), days=90))


STORE_MEASURES_SQL = """
    s.store_id, s.store_type, s.assortment, CAST(COALESCE(s.competition_distance, 0) AS DOUBLE) AS competition_distance,
    CAST(COALESCE(SUM(f.sales), 0) AS DOUBLE) AS total_sales,
    COALESCE(CAST(SUM(f.sales) AS DOUBLE) / NULLIF(COUNT(f.sales), 0), 0) AS avg_daily_sales,
    CAST(COALESCE(SUM(f.customers), 0) AS BIGINT) AS total_customers,
    COALESCE(CAST(SUM(f.customers) AS DOUBLE) / NULLIF(COUNT(f.customers), 0), 0) AS avg_daily_customers,
    CAST(SUM(CASE WHEN COALESCE(f.promo, 0) = 1 THEN 1 ELSE 0 END) AS BIGINT) AS {p}promo_days,
    CAST(SUM(CASE WHEN COALESCE(f.open, 1) = 1 THEN 1 ELSE 0 END) AS BIGINT) AS {p}open_days,
    CAST(SUM(CASE WHEN COALESCE(f.promo, 0) = 1 THEN f.sales END) AS DOUBLE)
      / NULLIF(COUNT(CASE WHEN COALESCE(f.promo, 0) = 1 THEN f.sales END), 0) AS avg_promo_sales,
    CAST(SUM(CASE WHEN COALESCE(f.promo, 0) = 0 THEN f.sales END) AS DOUBLE)
      / NULLIF(COUNT(CASE WHEN COALESCE(f.promo, 0) = 0 THEN f.sales END), 0) AS avg_no_promo_sales"""

WINDOW_SQL = """
WITH m AS (SELECT {measures}
  FROM dim_store s LEFT JOIN {facts} f ON f.store_id = s.store_id
  GROUP BY s.store_id, s.store_type, s.assortment, s.competition_distance)
SELECT *, CASE WHEN COALESCE(avg_no_promo_sales, 0) > 0 THEN
    ROUND((COALESCE(avg_promo_sales, 0) - avg_no_promo_sales) / avg_no_promo_sales * 100, 2) END AS promo_uplift_pct
FROM m"""

QUERIES = [
    Query("fact_sales_daily", "A-10 J-4 J-5", _fact_report, oracle("fact", f"""
        SELECT store_id, {DAY.format('full_date')} AS full_date, CAST(sales AS DOUBLE) AS sales, customers,
               CAST(promo AS BIGINT) AS promo, state_holiday, CAST(school_holiday AS BIGINT) AS school_holiday,
               CAST(open AS BIGINT) AS open, CAST(date_id AS BIGINT) AS date_id FROM fact""")),
    Query("dim_date_calendar", "F-5 J-5", _dim_date_report, oracle("dim_date", f"""
        SELECT CAST(date_id AS BIGINT) AS date_id, {DAY.format('full_date')} AS full_date, day(full_date) AS day,
               month(full_date) AS month, year(full_date) AS year, quarter(full_date) AS quarter,
               weekofyear(full_date) AS week_of_year, isodow(full_date) AS day_of_week,
               isodow(full_date) >= 6 AS is_weekend FROM dim_date""")),
    Query("training_rows", "S-3 J-1 J-2 P-7 X-9", _star, oracle("fact dim_store dim_date", f"""
        SELECT f.store_id, {DAY.format('d.full_date')} AS full_date, CAST(f.sales AS DOUBLE) AS sales,
               CAST(COALESCE(f.promo, 0) AS BIGINT) AS promo,
               CAST(COALESCE(f.school_holiday, 0) AS BIGINT) AS school_holiday,
               CAST(COALESCE(f.open, 1) AS BIGINT) AS open, COALESCE(f.state_holiday, '0') AS state_holiday,
               s.store_type, s.assortment, CAST(COALESCE(s.competition_distance, 0) AS DOUBLE) AS competition_distance,
               CAST(COALESCE(s.promo2, 0) AS BIGINT) AS promo2
        FROM fact f JOIN dim_date d ON d.date_id = f.date_id JOIN dim_store s ON s.store_id = f.store_id""")),
    Query("kpi_by_day_store", "A-1", lambda s, d: presented(kpi.kpi_by_day_store(_fact(s, d))), oracle("fact", f"""
        SELECT {DAY.format('full_date')} AS full_date, store_id, CAST(SUM(sales) AS DOUBLE) AS total_sales,
               CAST(SUM(COALESCE(customers, 0)) AS BIGINT) AS total_customers,
               CAST(SUM(sales) AS DOUBLE) / COUNT(sales) AS avg_sales,
               CAST(SUM(CASE WHEN COALESCE(promo, 0) = 1 THEN 1 ELSE 0 END) AS BIGINT) AS promo_days,
               CAST(SUM(CASE WHEN COALESCE(open, 1) = 1 THEN 1 ELSE 0 END) AS BIGINT) AS open_days
        FROM fact GROUP BY full_date, store_id""")),
    Query("sales_daily", "A-2 P-8",
          lambda s, d: presented(kpi.sales_timeseries(_fact_in_window(s, d), "daily", FROM, TO)), oracle("fact", f"""
        SELECT {DAY.format('full_date')} AS date, store_id, CAST(SUM(sales) AS DOUBLE) AS sales,
               CAST(SUM(COALESCE(customers, 0)) AS BIGINT) AS customers,
               CAST(MAX(COALESCE(promo, 0)) AS BIGINT) AS promo, CAST(MAX(COALESCE(open, 1)) AS BIGINT) AS open
        FROM fact WHERE full_date {BETWEEN} GROUP BY full_date, store_id""")),
    Query("sales_monthly", "A-3 F-6 X-3",
          lambda s, d: presented(kpi.sales_timeseries(_fact(s, d), "monthly", FROM, TO).drop("promo", "open")),
          oracle("fact", f"""
        WITH m AS (SELECT CAST(date_trunc('month', full_date) AS DATE) AS month_start, store_id,
                          SUM(sales) AS sales, SUM(COALESCE(customers, 0)) AS customers, COUNT(sales) AS n
                   FROM fact GROUP BY 1, 2)
        SELECT {DAY.format('month_start')} AS date, store_id, CAST(sales AS DOUBLE) AS sales,
               CAST(customers AS BIGINT) AS customers
        FROM m WHERE month_start {BETWEEN}""")),
    Query("sales_monthly_view", "A-3", lambda s, d: presented(kpi.sales_monthly(_fact(s, d))), oracle("fact", f"""
        SELECT strftime(date_trunc('month', full_date), '%Y-%m-%d') AS month_start, store_id,
               CAST(SUM(sales) AS DOUBLE) AS sales, CAST(SUM(COALESCE(customers, 0)) AS BIGINT) AS customers,
               CAST(SUM(sales) AS DOUBLE) / COUNT(sales) AS avg_daily_sales
        FROM fact GROUP BY 1, 2""")),
    Query("top_stores_rank", "A-4 W-1", lambda s, d: presented(kpi.top_stores(_fact(s, d))), oracle("fact", """
        SELECT store_id, CAST(SUM(sales) AS DOUBLE) AS total_sales,
               CAST(SUM(sales) AS DOUBLE) / COUNT(sales) AS avg_daily_sales,
               CAST(SUM(COALESCE(customers, 0)) AS BIGINT) AS total_customers,
               DENSE_RANK() OVER (ORDER BY SUM(sales) DESC) AS sales_rank
        FROM fact GROUP BY store_id""")),
    Query("top_stores_limit", "T-1", lambda s, d: presented(kpi.ranked_totals(_fact(s, d), 10)), oracle("fact", """
        SELECT store_id, CAST(SUM(sales) AS DOUBLE) AS total_sales FROM fact GROUP BY store_id
        ORDER BY SUM(sales) DESC, store_id LIMIT 10""")),
    Query("promo_impact", "A-5 A-8", lambda s, d: presented(kpi.promo_impact(_fact(s, d))), oracle("fact", """
        SELECT store_id, CASE WHEN COALESCE(promo, 0) = 1 THEN 'promo' ELSE 'no_promo' END AS promo_flag,
               CAST(SUM(sales) AS DOUBLE) / COUNT(sales) AS avg_sales,
               CAST(SUM(COALESCE(customers, 0)) AS DOUBLE) / COUNT(*) AS avg_customers, COUNT(*) AS num_days
        FROM fact GROUP BY 1, 2""")),
    Query("promo_impact_global", "A-8 F-13", lambda s, d: presented(
        kpi.promo_impact_global(_fact(s, d)).select(
            *[F.round(c, 4).alias(c) for c in ("promo_avg_sales", "no_promo_avg_sales", "uplift_pct")])),
          oracle("fact", """
        WITH m AS (SELECT store_id, COALESCE(promo, 0) = 1 AS p, CAST(SUM(sales) AS DOUBLE) / COUNT(sales) AS a
                   FROM fact GROUP BY 1, 2),
        g AS (SELECT AVG(CASE WHEN p THEN a END) AS x, AVG(CASE WHEN NOT p THEN a END) AS y FROM m)
        SELECT ROUND(x, 4) AS promo_avg_sales, ROUND(y, 4) AS no_promo_avg_sales,
               ROUND(CASE WHEN y > 0 THEN (x - y) / y * 100 ELSE 0 END, 4) AS uplift_pct FROM g""")),
    Query("store_comparison", "A-6 J-3 W-1 X-2",
          lambda s, d: presented(kpi.store_comparison(_stores(s, d), _fact(s, d))),
          oracle("fact dim_store", f"""
        SELECT {STORE_MEASURES_SQL.format(p='total_')},
               DENSE_RANK() OVER (ORDER BY COALESCE(SUM(f.sales), 0) DESC) AS sales_rank
        FROM dim_store s LEFT JOIN fact f ON f.store_id = s.store_id
        GROUP BY s.store_id, s.store_type, s.assortment, s.competition_distance""")),
    Query("store_comparison_window", "A-9 F-13 X-1", lambda s, d: presented(
        kpi.store_comparison_window(_stores(s, d), _fact_in_window(s, d), None, FROM, TO)),
          oracle("fact dim_store", WINDOW_SQL.format(
              measures=STORE_MEASURES_SQL.format(p=""), facts=f"(SELECT * FROM fact WHERE full_date {BETWEEN})"))),
    Query("store_comparison_ids", "A-9 P-11 X-1", lambda s, d: presented(
        kpi.store_comparison_window(_stores(s, d), _fact(s, d), kpi.ranked_totals(_fact(s, d), 10), FROM, TO, legacy=True)),
          oracle("fact dim_store", WINDOW_SQL.format(measures=STORE_MEASURES_SQL.format(p=""), facts="fact")
                 + " WHERE store_id IN (SELECT store_id FROM fact GROUP BY 1 ORDER BY SUM(sales) DESC, 1 LIMIT 10)")),
    Query("kpi_summary", "A-7 P-8", lambda s, d: presented(kpi.kpi_summary(_fact_in_window(s, d), FROM, TO)), oracle("fact", f"""
        WITH filtered AS (SELECT full_date, store_id, SUM(sales) AS s, SUM(customers) AS c,
                                 SUM(CASE WHEN promo = 1 THEN 1 ELSE 0 END) AS p,
                                 SUM(CASE WHEN open = 1 THEN 1 ELSE 0 END) AS o
                          FROM fact WHERE full_date {BETWEEN} GROUP BY full_date, store_id),
        per_day AS (SELECT full_date, SUM(s) AS day_sales FROM filtered GROUP BY full_date)
        SELECT CAST(COALESCE((SELECT SUM(s) FROM filtered), 0) AS DOUBLE) AS total_sales,
               CAST(COALESCE((SELECT SUM(c) FROM filtered), 0) AS BIGINT) AS total_customers,
               COALESCE((SELECT CAST(SUM(day_sales) AS DOUBLE) / COUNT(*) FROM per_day), 0) AS avg_daily_sales,
               CAST(COALESCE((SELECT SUM(p) FROM filtered), 0) AS BIGINT) AS promo_days,
               CAST(COALESCE((SELECT SUM(o) FROM filtered), 0) AS BIGINT) AS open_days""")),
    Query("system_summary", "A-11", lambda s, d: presented(kpi.system_summary(_stores(s, d), _fact(s, d))),
          oracle("fact dim_store", f"""
        SELECT (SELECT COUNT(*) FROM dim_store) AS stores_count, COUNT(*) AS sales_rows_count,
               {DAY.format('MIN(full_date)')} AS date_from, {DAY.format('MAX(full_date)')} AS date_to FROM fact""")),
    Query("data_availability", "A-12 U-1", _availability, oracle("fact", f"""
        SELECT 'fact_sales_daily' AS table_name, TRUE AS is_present, COUNT(*) AS row_count,
               {DAY.format('MIN(full_date)')} AS min_date, {DAY.format('MAX(full_date)')} AS max_date FROM fact
        UNION ALL SELECT 'dim_store', TRUE, COUNT(*), NULL, NULL FROM supplier
        UNION ALL SELECT 'preflight_runs', TRUE, COUNT(*), {DAY.format('MIN(ts)')}, {DAY.format('MAX(ts)')} FROM events
        UNION ALL SELECT 'forecast_runs', FALSE, 0, NULL, NULL""")),
    Query("overview_trend", "A-35", lambda s, d: presented(kpi.overview_trend(_fact(s, d))), oracle("fact", f"""
        WITH daily AS (SELECT full_date, SUM(sales) AS sales FROM fact GROUP BY full_date),
        e AS (SELECT MIN(full_date) AS a, MAX(full_date) AS b, COUNT(*) AS n, SUM(sales) AS t, MAX(sales) AS pk,
                     CAST(arg_min(sales, full_date) AS DOUBLE) AS f, CAST(arg_max(sales, full_date) AS DOUBLE) AS l
              FROM daily)
        SELECT {DAY.format('a')} AS date_from, {DAY.format('b')} AS date_to, n AS days_with_sales,
               CAST(t AS DOUBLE) AS total_sales,
               (SELECT {DAY.format('MIN(full_date)')} FROM daily WHERE sales = pk) AS peak_date,
               CAST(pk AS DOUBLE) AS peak_sales, f AS first_sales, l AS last_sales,
               date_diff('day', a, b) + 1 AS span_days,
               CASE WHEN f > 0 THEN (l - f) / f * 100 ELSE 0 END AS trend_pct FROM e""")),
    Query("store_summary", "A-36", lambda s, d: presented(kpi.store_summary(_fact(s, d))), oracle("fact", """
        WITH m AS (SELECT store_id, SUM(sales) AS t, SUM(customers) AS c, COUNT(*) AS n,
                          COALESCE(CAST(SUM(CASE WHEN promo = 1 THEN sales END) AS DOUBLE)
                                   / NULLIF(COUNT(CASE WHEN promo = 1 THEN sales END), 0), 0) AS p,
                          COALESCE(CAST(SUM(CASE WHEN promo <> 1 THEN sales END) AS DOUBLE)
                                   / NULLIF(COUNT(CASE WHEN promo <> 1 THEN sales END), 0), 0) AS q
                   FROM fact GROUP BY store_id)
        SELECT store_id, CAST(t AS DOUBLE) AS total_sales, CAST(c AS DOUBLE) / n AS avg_customers,
               CASE WHEN c > 0 THEN CAST(t AS DOUBLE) / c ELSE 0 END AS sales_per_customer,
               CASE WHEN q > 0 THEN (p - q) / q * 100 ELSE 0 END AS promo_uplift_pct FROM m""")),
    Query("eda_columns", "A-37", _eda_columns, oracle("fact", " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count, "
        f"COUNT(DISTINCT {c}) AS distinct_count FROM fact"
        for c in ("store_id", "full_date", "sales", "customers", "promo", "state_holiday", "school_holiday", "open")))),
    Query("eda_sketches", "A-37 A-32", _eda_sketches),
    Query("eda_values", "A-37", _eda_values, oracle("fact", " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS num_rows FROM fact GROUP BY 1, 2"
        for c in ("promo", "open", "state_holiday", "school_holiday")))),
    Query("eda_describe", "A-37", lambda s, d: presented(
        kpi.sales_describe(_fact(s, d)).withColumn("std", F.round("std", 4))), oracle("fact", """
        SELECT COUNT(sales) AS n, CAST(SUM(sales) AS DOUBLE) / COUNT(sales) AS mean,
               ROUND(stddev_samp(CAST(sales AS DOUBLE)), 4) AS std, CAST(MIN(sales) AS DOUBLE) AS min,
               CAST(MAX(sales) AS DOUBLE) AS max, COUNT(*) FILTER (sales = 0) / COUNT(*) AS zero_share,
               COUNT(*) FILTER (open <> 1) / COUNT(*) AS closed_share FROM fact""")),
    Query("eda_by_type", "A-37 J-15", lambda s, d: presented(kpi.kpi_by_store_type(_fact(s, d), _stores(s, d))),
          oracle("fact dim_store", """
        SELECT s.store_type, CAST(SUM(sales) AS DOUBLE) AS total_sales,
               CAST(SUM(sales) AS DOUBLE) / COUNT(sales) AS avg_sales,
               CAST(SUM(customers) AS BIGINT) AS total_customers, COUNT(DISTINCT f.store_id) AS stores
        FROM fact f LEFT JOIN dim_store s ON s.store_id = f.store_id GROUP BY s.store_type""")),
    Query("eda_by_calendar", "A-37", _eda_calendar, oracle("fact", """
        SELECT 'weekday' AS unit, isodow(full_date) AS part, CAST(SUM(sales) AS DOUBLE) AS total_sales,
               CAST(SUM(sales) AS DOUBLE) / COUNT(sales) AS avg_sales, COUNT(*) AS num_days FROM fact GROUP BY 1, 2
        UNION ALL
        SELECT 'month', month(full_date), CAST(SUM(sales) AS DOUBLE),
               CAST(SUM(sales) AS DOUBLE) / COUNT(sales), COUNT(*) FROM fact GROUP BY 1, 2""")),
    Query("eda_histogram", "A-37",
          lambda s, d: presented(kpi.sales_histogram(_fact(s, d), 0, 100000, 20)), oracle("fact", """
        SELECT CASE WHEN sales < 0 THEN 0 WHEN sales >= 100000 THEN 21
                    ELSE CAST(floor(CAST(sales AS DOUBLE) / 5000) AS BIGINT) + 1 END AS bin, COUNT(*) AS num_days
        FROM fact GROUP BY 1""")),
    Query("data_freshness", "F-26", _freshness, oracle("fact", f"""
        WITH l AS (SELECT store_id, MAX(full_date) AS last_day FROM fact GROUP BY store_id),
        t AS (SELECT *, date_diff('day', last_day, (SELECT MAX(full_date) FROM fact)) AS age FROM l)
        SELECT store_id, {DAY.format('last_day')} AS last_day, age AS age_days,
               CASE WHEN age <= 1 THEN 'pass' WHEN age <= 7 THEN 'warn' ELSE 'fail' END AS freshness FROM t""")),
    Query("stores_page", "P-9 T-4", lambda s, d: presented(
        grid.page(_stores(s, d).where("assortment = 'a'").select("store_id", "store_type", "assortment"),
                  ["store_id"], page=2, page_size=5)), oracle("dim_store", """
        SELECT store_id, store_type, assortment, COUNT(*) OVER () AS total FROM dim_store
        WHERE assortment = 'a' ORDER BY store_id LIMIT 5 OFFSET 5""")),
    Query("segment_stores", "P-10", lambda s, d: presented(
        grid.segment_stores(_stores(s, d), store_type=None, assortment=" A ", promo2=1, limit=50)),
          oracle("dim_store", """
        SELECT store_id FROM dim_store WHERE lower(assortment) = 'a' AND promo2 = 1 ORDER BY store_id LIMIT 50""")),
    Query("grid_search", "P-19", lambda s, d: presented(
        grid.search(_stores(s, d), ["store_type", "store_id"], "ion_1")), oracle("dim_store", """
        SELECT store_id, store_type, assortment, CAST(competition_distance AS DOUBLE) AS competition_distance, promo2
        FROM dim_store WHERE contains(lower(store_type), 'ion_1')
           OR contains(lower(CAST(store_id AS VARCHAR)), 'ion_1')""")),
    Query("grid_sorted", "T-6", lambda s, d: presented(
        grid.sorted_rows(_stores(s, d).withColumn("d", F.when(F.col("promo2") == 1, F.col("competition_distance")))
                         .select("store_id", "d"), "d", descending=True, tiebreak=["store_id"]).limit(60)),
          oracle("dim_store", """
        SELECT store_id, CAST(CASE WHEN promo2 = 1 THEN competition_distance END AS DOUBLE) AS d FROM dim_store
        ORDER BY d DESC NULLS LAST, store_id LIMIT 60""")),
    Query("store_meta", "S-5", _meta, oracle("dim_store", """
        SELECT store_id, COALESCE(store_type, 'unknown') AS store_type, COALESCE(assortment, 'unknown') AS assortment,
               CAST(COALESCE(competition_distance, 0) AS DOUBLE) AS competition_distance,
               COALESCE(promo2, 0) AS promo2 FROM dim_store""")),
    Query("recent_history", "S-4", _history, oracle("fact", f"""
        SELECT store_id, {DAY.format('full_date')} AS full_date, CAST(sales AS DOUBLE) AS sales,
               CAST(promo AS BIGINT) AS promo, CAST(school_holiday AS BIGINT) AS school_holiday,
               CAST(open AS BIGINT) AS open, state_holiday
        FROM fact QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY full_date DESC) <= 90""")),
    Query("dq_nulls", "Q-19", _missing, oracle("fact", """
        SELECT COUNT(*) FILTER (customers % 7 = 0) AS miss_store, COUNT(*) FILTER (customers % 11 = 0) AS miss_date,
               COUNT(*) FILTER (customers % 13 = 0) AS miss_sales FROM fact""")),
    Query("dq_duplicates", "Q-19", _duplicates, """
        SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, COUNT(*) AS cnt FROM lineitem
        GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1"""),
    Query("dq_duplicate_samples", "Q-19", _duplicate_samples, """
        SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, COUNT(*) AS cnt FROM lineitem
        GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1 ORDER BY cnt DESC, 1, 2 LIMIT 10"""),
    Query("dq_date_gaps", "Q-19 W-2", _date_gaps, f"""
        WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS full_date FROM lineitem
                   WHERE isodow(l_shipdate) <> 7),
        g AS (SELECT full_date, LEAD(full_date) OVER (ORDER BY full_date) AS nx FROM d)
        SELECT {DAY.format('MIN(full_date)')} AS min_date, {DAY.format('MAX(full_date)')} AS max_date,
               COUNT(*) FILTER (nx IS NOT NULL AND nx <> full_date + INTERVAL 1 DAY) AS gap_days FROM g"""),
    Query("dq_broken_fk", "Q-19 J-6", _broken_keys, oracle("fact dim_store dim_date", """
        SELECT COUNT(*) AS broken_fk FROM fact f
        LEFT JOIN (SELECT * FROM dim_store WHERE assortment <> 'b') s ON s.store_id = f.store_id
        LEFT JOIN dim_date d ON d.date_id = f.date_id WHERE s.store_id IS NULL OR d.date_id IS NULL""")),
]
