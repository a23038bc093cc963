"""Cleaning of raw sales and store rows, the star schema, and warehouse checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.functions.calendar import date_key, is_weekend, iso_day_of_week
from shelfscope.functions.coerce import to_day, to_int, to_number
from shelfscope.operators.percentile import exact_percentile

# Raw header -> warehouse column.
STORE_HEADERS = {
    "Store": "store_id",
    "StoreType": "store_type",
    "Assortment": "assortment",
    "CompetitionDistance": "competition_distance",
    "CompetitionOpenSinceMonth": "competition_open_since_month",
    "CompetitionOpenSinceYear": "competition_open_since_year",
    "Promo2": "promo2",
    "Promo2SinceWeek": "promo2_since_week",
    "Promo2SinceYear": "promo2_since_year",
    "PromoInterval": "promo_interval",
}
SALES_HEADERS = {
    "Store": "store_id",
    "DayOfWeek": "day_of_week",
    "Date": "full_date",
    "Sales": "sales",
    "Customers": "customers",
    "Open": "open",
    "Promo": "promo",
    "StateHoliday": "state_holiday",
    "SchoolHoliday": "school_holiday",
}


def _renamed(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({c: headers.get(c.strip(), c.strip()) for c in df.columns})


def clean_store(raw: DataFrame) -> DataFrame:
    """Typed store attributes; a missing competition distance takes the median of the known ones."""
    df = _renamed(raw, STORE_HEADERS)
    distance = to_number(F.col("competition_distance"))
    median = exact_percentile(
        df.select(F.round(distance * 100).cast("long").alias("hundredths")), "hundredths", 0.5
    ).select((F.col("percentile") / 100).alias("median_distance"))

    def whole(name: str) -> Column:
        return F.coalesce(to_int(F.col(name)), F.lit(0)).cast("int").alias(name)

    # One row on the right, by construction of a global percentile.
    return df.crossJoin(F.broadcast(median)).select(
        to_int(F.col("store_id")).alias("store_id"),
        F.coalesce("store_type", F.lit("unknown")).alias("store_type"),
        F.coalesce("assortment", F.lit("unknown")).alias("assortment"),
        F.coalesce(distance, F.col("median_distance")).cast("decimal(12,2)").alias("competition_distance"),
        whole("competition_open_since_month"),
        whole("competition_open_since_year"),
        whole("promo2"),
        whole("promo2_since_week"),
        whole("promo2_since_year"),
        F.coalesce("promo_interval", F.lit("none")).alias("promo_interval"),
    )


def clean_sales(raw: DataFrame) -> DataFrame:
    """Typed daily sales.

    Rows without a readable date, a store or a sales value are dropped first; only then does sales text
    that is no number count as 0. A missing ``open`` column means every day is open.
    """
    df = _renamed(raw, SALES_HEADERS)
    df = df.withColumn("full_date", to_day(F.col("full_date"))).dropna(subset=["full_date", "store_id", "sales"])

    def whole(name: str, default: int) -> Column:
        return F.coalesce(to_int(F.col(name)), F.lit(default)).cast("int").alias(name)

    return df.select(
        to_int(F.col("store_id")).alias("store_id"),
        "full_date",
        F.coalesce(to_number(F.col("sales")), F.lit(0.0)).alias("sales"),
        whole("customers", 0),
        whole("promo", 0),
        F.coalesce(F.col("state_holiday").cast("string"), F.lit("0")).alias("state_holiday"),
        whole("school_holiday", 0),
        whole("open", 1) if "open" in df.columns else F.lit(1).alias("open"),
    )


def build_dim_date(sales: DataFrame, day: str = "full_date") -> DataFrame:
    """Every day from the first to the last sales day; the number of rows is the number of days."""
    span = sales.agg(F.min(day).alias("first"), F.max(day).alias("last")).where(F.col("first").isNotNull())
    days = span.select(F.explode(F.sequence("first", "last")).alias("full_date"))
    d = F.col("full_date")
    return days.select(
        date_key(d).alias("date_id"),
        d,
        F.dayofmonth(d).alias("day"),
        F.month(d).alias("month"),
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.weekofyear(d).alias("week_of_year"),
        iso_day_of_week(d).alias("day_of_week"),
        is_weekend(d).alias("is_weekend"),
    )


def build_fact(sales: DataFrame, sales_sum: Column | None = None) -> DataFrame:
    """One row per store and day: sums of sales and customers, maxima of the flags.

    ``groupBy`` combines on the map side, so a store that holds a large share of all lines reaches the
    shuffle as at most one row per day and map task. The date key is computed, not looked up. The holiday code, one
    character, is carried as its number: a maximum over text would sort all lines, one over numbers hashes them.
    """
    code = F.max(F.ascii("state_holiday"))
    total = sales_sum if sales_sum is not None else F.sum(F.col("sales").cast("decimal(14,2)"))
    return (
        sales.groupBy("store_id", "full_date")
        .agg(
            total.cast("decimal(14,2)").alias("sales"),
            F.sum("customers").cast("long").alias("customers"),
            F.max("promo").alias("promo"),
            F.when(code > 0, F.char(code)).when(code == 0, "").alias("state_holiday"),
            F.max("school_holiday").alias("school_holiday"),
            F.max("open").alias("open"),
        )
        .withColumn("date_id", date_key(F.col("full_date")))
    )


def training_rows(fact: DataFrame, dim_date: DataFrame, dim_store: DataFrame) -> DataFrame:
    """Star join with null defaults for modelling; dimension sides are broadcast by size only."""
    return (
        fact.drop("full_date")
        .join(dim_date.select("date_id", "full_date"), "date_id")
        .join(dim_store, "store_id")
        .select(
            "store_id",
            "full_date",
            "sales",
            F.coalesce("promo", F.lit(0)).alias("promo"),
            F.coalesce("school_holiday", F.lit(0)).alias("school_holiday"),
            F.coalesce("open", F.lit(1)).alias("open"),
            F.coalesce("state_holiday", F.lit("0")).alias("state_holiday"),
            "store_type",
            "assortment",
            F.coalesce(F.col("competition_distance").cast("double"), F.lit(0.0)).alias("competition_distance"),
            F.coalesce("promo2", F.lit(0)).alias("promo2"),
        )
    )


def store_meta(dim_store: DataFrame) -> DataFrame:
    """Store attributes with the defaults used at scoring time."""
    return dim_store.select(
        "store_id",
        F.coalesce("store_type", F.lit("unknown")).alias("store_type"),
        F.coalesce("assortment", F.lit("unknown")).alias("assortment"),
        F.coalesce(F.col("competition_distance").cast("double"), F.lit(0.0)).alias("competition_distance"),
        F.coalesce("promo2", F.lit(0)).alias("promo2"),
    )


def recent_history(fact: DataFrame, days: int = 400) -> DataFrame:
    """The newest ``days`` rows of every store at once.

    The fact holds one row per store and day, so a store's window group is bounded by the calendar;
    Spark also cuts each group to ``days`` rows before the shuffle (window group limit).
    """
    newest = W.partitionBy("store_id").orderBy(F.desc("full_date"))
    return (
        fact.select(
            "store_id",
            "full_date",
            F.col("sales").cast("double").alias("sales"),
            F.coalesce("promo", F.lit(0)).alias("promo"),
            F.coalesce("school_holiday", F.lit(0)).alias("school_holiday"),
            F.coalesce("open", F.lit(1)).alias("open"),
            F.coalesce("state_holiday", F.lit("0")).alias("state_holiday"),
        )
        .withColumn("recency", F.row_number().over(newest))
        .where(F.col("recency") <= days)
        .drop("recency")
    )


# Warehouse checks ------------------------------------------------------------------------------------


def missing_values(fact: DataFrame) -> DataFrame:
    return fact.agg(
        F.count_if(F.col("store_id").isNull()).alias("miss_store"),
        F.count_if(F.col("date_id").isNull()).alias("miss_date"),
        F.count_if(F.col("sales").isNull()).alias("miss_sales"),
    )


def duplicate_keys(rows: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Keys held by more than one row; ``limit`` gives the sample report."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("cnt")).where("cnt > 1")
    return found.orderBy(F.desc("cnt"), *keys).limit(limit) if limit else found


def date_gaps(days: DataFrame) -> DataFrame:
    """Number of calendar days followed by a hole, with the covered range.

    The window has no partition key: its input is the distinct calendar, at most one row per day.
    """
    days = days.select("full_date").distinct()
    following = F.lead("full_date").over(W.orderBy("full_date"))
    gaps = days.withColumn("next_date", following)
    return gaps.agg(
        F.min("full_date").alias("min_date"),
        F.max("full_date").alias("max_date"),
        F.count_if(F.col("next_date") != F.date_add("full_date", 1)).alias("gap_days"),
    )


def broken_keys(fact: DataFrame, dim_store: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Fact rows whose store or date has no dimension row."""
    stores = dim_store.select("store_id", F.lit(True).alias("store_known"))
    dates = dim_date.select("date_id", F.lit(True).alias("date_known"))
    joined = fact.select("store_id", "date_id").join(stores, "store_id", "left").join(dates, "date_id", "left")
    return joined.agg(
        F.count_if(F.col("store_known").isNull() | F.col("date_known").isNull()).alias("broken_fk")
    )
