"""KPI views and reports over the sales fact.

The fact carries its own ``full_date`` (the date key is a function of it), so daily and monthly views need
no join with the date dimension. Sums run over exact decimals; means are the exact sum over the count.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.functions.numeric import mean_of, uplift_pct
from shelfscope.session import settled


def _promo_on() -> Column:
    return F.coalesce("promo", F.lit(0)) == 1


def _is_open() -> Column:
    return F.coalesce("open", F.lit(1)) == 1


def _customers() -> Column:
    return F.coalesce("customers", F.lit(0))


def kpi_by_day_store(fact: DataFrame) -> DataFrame:
    return fact.groupBy("full_date", "store_id").agg(
        F.sum("sales").alias("total_sales"),
        F.sum(_customers()).alias("total_customers"),
        mean_of(F.col("sales")).alias("avg_sales"),
        F.count_if(_promo_on()).alias("promo_days"),
        F.count_if(_is_open()).alias("open_days"),
    )


def sales_daily(fact: DataFrame) -> DataFrame:
    return fact.groupBy("full_date", "store_id").agg(
        F.sum("sales").alias("sales"),
        F.sum(_customers()).alias("customers"),
        F.max(F.coalesce("promo", F.lit(0))).alias("promo"),
        F.max(F.coalesce("open", F.lit(1))).alias("open"),
    )


def sales_monthly(fact: DataFrame) -> DataFrame:
    return fact.groupBy(F.trunc("full_date", "month").alias("month_start"), "store_id").agg(
        F.sum("sales").alias("sales"),
        F.sum(_customers()).alias("customers"),
        mean_of(F.col("sales")).alias("avg_daily_sales"),
    )


def sales_timeseries(
    fact: DataFrame, granularity: str, date_from: date, date_to: date, store_id: int | None = None
) -> DataFrame:
    """Daily or monthly series in a window.

    The monthly form filters on the first day of the month, so a window that opens inside a month leaves
    that month out; the filter on ``full_date`` is implied and prunes partitions before the aggregation.
    """
    if granularity not in ("daily", "monthly"):
        raise ValueError("granularity must be 'daily' or 'monthly'")
    rows = fact.where(F.col("store_id") == store_id) if store_id is not None else fact
    if granularity == "daily":
        rows = rows.where(F.col("full_date").between(date_from, date_to))
        return sales_daily(rows).withColumnRenamed("full_date", "date")
    rows = rows.where(F.col("full_date") >= F.lit(date_from))
    monthly = sales_monthly(rows).where(F.col("month_start").between(date_from, date_to))
    return monthly.select(
        F.col("month_start").alias("date"),
        "store_id",
        "sales",
        "customers",
        F.lit(None).cast("int").alias("promo"),
        F.lit(None).cast("int").alias("open"),
    )


def top_stores(fact: DataFrame) -> DataFrame:
    """Store totals with their dense rank."""
    totals = fact.groupBy("store_id").agg(
        F.sum("sales").alias("total_sales"),
        mean_of(F.col("sales")).alias("avg_daily_sales"),
        F.sum(_customers()).alias("total_customers"),
    )
    return with_dense_rank(totals, "total_sales", "sales_rank")


def with_dense_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Dense rank of ``value`` descending, spread over tasks.

    A window without partition key would put every row in one task. The distinct values are ranked instead,
    in buckets that depend on the value alone (1/4096 of a factor of two each): the values ahead of a bucket
    come from the counts per bucket, a bounded frame, and the rank inside from a window per bucket. Rows
    then take the rank of their value, so many rows with the same value cost no window at all.
    """
    # The ranked frame is read for its values and for its rows.
    df = settled(df)
    magnitude = F.log2(1 + F.abs(F.col(value).cast("double"))) * 4096
    values = df.select(value).where(F.col(value).isNotNull()).distinct()
    values = values.withColumn("_bucket", F.floor(F.signum(F.col(value).cast("double")) * magnitude).cast("int"))
    per_bucket = values.groupBy("_bucket").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(W.orderBy(F.desc("_bucket"))) - F.col("n")
    offsets = per_bucket.select("_bucket", ahead.alias("_ahead"))
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy(F.desc(value)))
    ranked = values.join(offsets, "_bucket").select(value, (inside + F.col("_ahead")).cast("int").alias(name))
    return df.join(ranked, value, "left")


def promo_impact(fact: DataFrame) -> DataFrame:
    return fact.groupBy(
        "store_id", F.when(_promo_on(), "promo").otherwise("no_promo").alias("promo_flag")
    ).agg(
        mean_of(F.col("sales")).alias("avg_sales"),
        mean_of(_customers()).alias("avg_customers"),
        F.count("*").alias("num_days"),
    )


def promo_impact_global(fact: DataFrame) -> DataFrame:
    """Unweighted mean over stores of the store means, with the uplift of promotion days."""
    by_store = promo_impact(fact)

    def mean_for(flag: str) -> Column:
        return F.avg(F.when(F.col("promo_flag") == flag, F.col("avg_sales")))

    means = by_store.agg(mean_for("promo").alias("promo_avg_sales"), mean_for("no_promo").alias("no_promo_avg_sales"))
    return means.withColumn(
        "uplift_pct", uplift_pct(F.col("promo_avg_sales"), F.col("no_promo_avg_sales"), otherwise=0.0)
    )


def _store_measures() -> list[Column]:
    sales = F.col("sales")
    return [
        F.coalesce(F.sum("sales"), F.lit(0)).alias("total_sales"),
        F.coalesce(mean_of(sales), F.lit(0.0)).alias("avg_daily_sales"),
        F.coalesce(F.sum("customers"), F.lit(0)).alias("total_customers"),
        F.coalesce(mean_of(F.col("customers")), F.lit(0.0)).alias("avg_daily_customers"),
        F.count_if(_promo_on()).alias("promo_days"),
        F.count_if(_is_open()).alias("open_days"),
        mean_of(F.when(_promo_on(), sales)).alias("avg_promo_sales"),
        mean_of(F.when(F.coalesce("promo", F.lit(0)) == 0, sales)).alias("avg_no_promo_sales"),
    ]


def _per_store(dim_store: DataFrame, fact: DataFrame) -> DataFrame:
    """Store attributes left-joined with per-store measures.

    The fact is aggregated before the join, so one row per store is joined however many days it has. A
    store without fact rows shows the values of the single null row a left join would give: zero sums and
    means, no promotion day, and one open day, because a missing open flag counts as open.
    """
    measures = fact.groupBy("store_id").agg(*_store_measures())
    stores = dim_store.select(
        "store_id", "store_type", "assortment", F.coalesce("competition_distance", F.lit(0)).alias("competition_distance")
    )
    joined = stores.join(measures, "store_id", "left")
    zero = {c: 0 for c in ("total_sales", "avg_daily_sales", "total_customers", "avg_daily_customers", "promo_days")}
    return joined.fillna({**zero, "open_days": 1})


def store_comparison(dim_store: DataFrame, fact: DataFrame) -> DataFrame:
    """Whole-history comparison of all stores with their sales rank."""
    per_store = _per_store(dim_store, fact).withColumnsRenamed(
        {"promo_days": "total_promo_days", "open_days": "total_open_days"}
    )
    return with_dense_rank(per_store, "total_sales", "sales_rank")


def store_comparison_window(
    dim_store: DataFrame,
    fact: DataFrame,
    store_ids: list[int] | DataFrame | None,
    date_from: date,
    date_to: date,
    legacy: bool = False,
    most: int | None = None,
) -> DataFrame:
    """Comparison of chosen stores (all when None) in a date window, with promotion uplift.

    The stores are a list of ids, of which ``most`` can bound the number, or a frame of ids, such as a top-k report.
    ``legacy`` keeps the original behaviour in which the window does not restrict the facts.
    """
    if isinstance(store_ids, DataFrame):
        dim_store = dim_store.join(store_ids.select("store_id").distinct(), "store_id", "left_semi")
    elif store_ids is not None:
        if not store_ids or (most is not None and len(store_ids) > most):
            raise ValueError(f"stores to compare: at least one{'' if most is None else f' and at most {most}'}")
        dim_store = dim_store.where(F.col("store_id").isin(store_ids))
        fact = fact.where(F.col("store_id").isin(store_ids))
    if not legacy:
        fact = fact.where(F.col("full_date").between(date_from, date_to))
    base = F.coalesce("avg_no_promo_sales", F.lit(0.0))
    lift = uplift_pct(F.coalesce("avg_promo_sales", F.lit(0.0)), base)
    return _per_store(dim_store, fact).withColumn("promo_uplift_pct", F.round(lift, 2))


def kpi_summary(fact: DataFrame, date_from: date, date_to: date, store_id: int | None = None) -> DataFrame:
    """Five scalars for a window: one two-level aggregate, by day and then over the days."""
    rows = fact.where(F.col("full_date").between(date_from, date_to))
    if store_id is not None:
        rows = rows.where(F.col("store_id") == store_id)
    per_day = rows.groupBy("full_date").agg(
        F.sum("sales").alias("day_sales"),
        F.sum(_customers()).alias("day_customers"),
        F.count_if(_promo_on()).alias("day_promo"),
        F.count_if(_is_open()).alias("day_open"),
    )
    return per_day.agg(
        F.coalesce(F.sum("day_sales"), F.lit(0)).alias("total_sales"),
        F.coalesce(F.sum("day_customers"), F.lit(0)).alias("total_customers"),
        F.coalesce(mean_of(F.col("day_sales")), F.lit(0.0)).alias("avg_daily_sales"),
        F.coalesce(F.sum("day_promo"), F.lit(0)).alias("promo_days"),
        F.coalesce(F.sum("day_open"), F.lit(0)).alias("open_days"),
    )


def system_summary(dim_store: DataFrame, fact: DataFrame) -> DataFrame:
    """Store count, fact row count and sales date range, as one row."""
    stores = dim_store.agg(F.count("*").alias("stores_count"))
    sales = fact.agg(
        F.count("*").alias("sales_rows_count"),
        F.min("full_date").alias("date_from"),
        F.max("full_date").alias("date_to"),
    )
    return stores.crossJoin(F.broadcast(sales))


def data_availability(tables: dict[str, tuple[DataFrame | None, str | None]]) -> DataFrame:
    """Row count and date range of named tables; a table that is absent counts as empty."""
    frames = []
    session = next(df for df, _ in tables.values() if df is not None).sparkSession
    for name, (df, day) in tables.items():
        if df is None:
            frames.append(
                session.range(1).select(
                    F.lit(name).alias("table_name"),
                    F.lit(False).alias("is_present"),
                    F.lit(0).cast("long").alias("row_count"),
                    F.lit(None).cast("date").alias("min_date"),
                    F.lit(None).cast("date").alias("max_date"),
                )
            )
            continue
        when = F.col(day).cast("date") if day else F.lit(None).cast("date")
        frames.append(
            df.agg(F.count("*").alias("row_count"), F.min(when).alias("min_date"), F.max(when).alias("max_date"))
            .select(F.lit(name).alias("table_name"), F.lit(True).alias("is_present"), "row_count", "min_date", "max_date")
        )
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def overview_trend(fact: DataFrame) -> DataFrame:
    """Span, peak day and first-to-last change of the daily sales series."""
    daily = fact.groupBy("full_date").agg(F.sum("sales").alias("sales"))
    # Ties on the peak go to the earliest day.
    peak = F.max_by("full_date", F.struct("sales", -F.unix_date("full_date")))
    ends = daily.agg(
        F.min("full_date").alias("date_from"),
        F.max("full_date").alias("date_to"),
        F.count("*").alias("days_with_sales"),
        F.sum("sales").alias("total_sales"),
        peak.alias("peak_date"),
        F.max("sales").alias("peak_sales"),
        F.min_by("sales", "full_date").cast("double").alias("first_sales"),
        F.max_by("sales", "full_date").cast("double").alias("last_sales"),
    )
    return ends.withColumns(
        {
            "span_days": F.datediff("date_to", "date_from") + 1,
            "trend_pct": uplift_pct(F.col("last_sales"), F.col("first_sales"), otherwise=0.0),
        }
    )


def store_summary(fact: DataFrame) -> DataFrame:
    """Per store: totals, mean customers, sales per customer and promotion uplift."""
    sums = fact.groupBy("store_id").agg(
        F.sum("sales").alias("total_sales"),
        F.sum(_customers()).alias("total_customers"),
        mean_of(_customers()).alias("avg_customers"),
        mean_of(F.when(_promo_on(), F.col("sales"))).alias("promo_avg"),
        mean_of(F.when(~_promo_on(), F.col("sales"))).alias("no_promo_avg"),
    )
    return sums.select(
        "store_id",
        "total_sales",
        "avg_customers",
        F.when(F.col("total_customers") > 0, F.col("total_sales").cast("double") / F.col("total_customers"))
        .otherwise(0.0)
        .alias("sales_per_customer"),
        uplift_pct(
            F.coalesce("promo_avg", F.lit(0.0)), F.coalesce("no_promo_avg", F.lit(0.0)), otherwise=0.0
        ).alias("promo_uplift_pct"),
    )


def ranked_totals(fact: DataFrame, k: int) -> DataFrame:
    """The k stores with the largest sales; ties go to the smaller id."""
    totals = fact.groupBy("store_id").agg(F.sum("sales").alias("total_sales"))
    return totals.orderBy(F.desc("total_sales"), "store_id").limit(k)


# Exploratory profile ---------------------------------------------------------------------------------


def column_profile(df: DataFrame) -> DataFrame:
    """Nulls, distinct values and share of zeros of every column, in one pass.

    Distinct counts are approximate (HyperLogLog) only on request of the caller; here they are exact and
    come from one expand-based aggregate.
    """
    stats = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"{c}__nulls") for c in df.columns],
        *[F.count_distinct(c).alias(f"{c}__distinct") for c in df.columns],
        F.count("*").alias("rows__"),
    )
    per_column = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("rows__").alias("row_count"),
                F.col(f"{c}__nulls").alias("null_count"),
                F.col(f"{c}__distinct").alias("distinct_count"),
            )
            for c in df.columns
        ]
    )
    return stats.select(F.inline(per_column))


def sales_describe(fact: DataFrame) -> DataFrame:
    zero = F.col("sales") == 0
    closed = ~_is_open()
    return fact.agg(
        F.count("sales").alias("n"),
        mean_of(F.col("sales")).alias("mean"),
        F.stddev_samp(F.col("sales").cast("double")).alias("std"),
        F.min("sales").alias("min"),
        F.max("sales").alias("max"),
        (F.count_if(zero) / F.count("*")).alias("zero_share"),
        (F.count_if(closed) / F.count("*")).alias("closed_share"),
    )


def kpi_by_store_type(fact: DataFrame, dim_store: DataFrame) -> DataFrame:
    """Sales by store type; facts are summed per store before the join."""
    per_store = fact.groupBy("store_id").agg(
        F.sum("sales").alias("sales"), F.count("sales").alias("days"), F.sum(_customers()).alias("customers")
    )
    joined = per_store.join(dim_store.select("store_id", "store_type"), "store_id", "left")
    return joined.groupBy("store_type").agg(
        F.sum("sales").alias("total_sales"),
        (F.sum("sales").cast("double") / F.sum("days")).alias("avg_sales"),
        F.sum("customers").alias("total_customers"),
        F.count("*").alias("stores"),
    )


def kpi_by_calendar(fact: DataFrame, unit: str) -> DataFrame:
    """Sales by weekday or by month of year."""
    part = {"weekday": F.weekday("full_date") + 1, "month": F.month("full_date")}[unit]
    return fact.groupBy(part.alias(unit)).agg(
        F.sum("sales").alias("total_sales"),
        mean_of(F.col("sales")).alias("avg_sales"),
        F.count("*").alias("num_days"),
    )


def sales_histogram(fact: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Counts per equal-width bin; bin 0 and bin ``bins + 1`` hold what lies outside."""
    bucket = F.width_bucket(F.col("sales").cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return fact.groupBy(bucket.alias("bin")).agg(F.count("*").alias("num_days"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("num_rows"))
