"""Stand-in sources: the sales, run-log, delivery and message tables derived from the driver's parquet tables.

"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.operators.warehouse import build_fact


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_lines(
    spark: SparkSession, sf_dir: str, date_from: date | None = None, date_to: date | None = None
) -> DataFrame:
    """Line-level sales. ``sales_units`` counts hundredths of a cent as a long.

    Price and discount have two decimals each, so their product is a whole number of such units: sums
    are exact, fast (no wide decimals in the aggregation buffer) and independent of partial-sum order. A date
    range is put on the stored timestamp itself, so that it reaches the Parquet reader.
    """
    lines = table(spark, sf_dir, "lineitem")
    if date_from is not None:
        lines = lines.where(F.col("l_shipdate") >= F.lit(date_from).cast("timestamp"))
    if date_to is not None:
        lines = lines.where(F.col("l_shipdate") < F.lit(date_to + timedelta(days=1)).cast("timestamp"))
    price = F.round(F.col("l_extendedprice") * 100).cast("long")
    keep = F.lit(100).cast("long") - F.round(F.col("l_discount") * 100).cast("long")
    return lines.select(
        F.col("l_suppkey").alias("store_id"),
        F.to_date("l_shipdate").alias("full_date"),
        (price * keep).alias("sales_units"),
        F.col("l_quantity").cast("long").alias("customers"),
        (F.col("l_discount") >= 0.05).cast("int").alias("promo"),
        F.col("l_returnflag").alias("state_holiday"),
        (F.col("l_linestatus") == "F").cast("int").alias("school_holiday"),
        (F.col("l_quantity") > 2).cast("int").alias("open"),
    )


def fact_sales(
    spark: SparkSession, sf_dir: str, date_from: date | None = None, date_to: date | None = None
) -> DataFrame:
    exact = F.sum("sales_units").cast("decimal(20,0)") * F.lit("0.0001").cast("decimal(5,4)")
    return build_fact(sales_lines(spark, sf_dir, date_from, date_to), sales_sum=F.round(exact, 2))


def dim_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores from suppliers; the nation side is left to the optimizer's size-checked broadcast."""
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").alias("store_id"),
        F.col("n_name").alias("store_type"),
        F.substring(F.lit("abc"), F.col("s_nationkey") % 3 + 1, 1).alias("assortment"),
        F.abs("s_acctbal").cast("decimal(12,2)").alias("competition_distance"),
        (F.col("s_suppkey") % 2).cast("int").alias("promo2"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preflight run log from events: one row per run and source."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.when(F.col("user_id") % 2 == 0, "train").otherwise("store").alias("source_name"),
        F.col("ts").alias("created_at"),
        F.when(kind == "view", "report_only").otherwise("enforce").alias("mode"),
        F.when(kind == "error", "FAIL").when(kind == "signup", "WARN").otherwise("PASS").alias("final_status"),
        (F.col("value") > 200).alias("blocked"),
        (F.col("value") > 50).alias("used_unified"),
        (F.col("user_id") % 20).alias("data_source_id"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def rule_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log with its three JSON artifacts.

    Two rules per run sit in the semantic report; for some runs only the manifest or the preflight
    summary still holds it, and some runs have no report at all.
    """
    runs = run_log(spark, sf_dir)
    k = F.col("k")

    def rule(offset: int, status):
        number = (k + offset) % 7
        return F.struct(
            F.concat(F.lit("rule_"), number.cast("string")).alias("rule_id"),
            F.when(number % 2 == 0, "between").otherwise("accepted_values").alias("rule_type"),
            F.when(number < 4, "fail").otherwise("warn").alias("severity"),
            status.alias("status"),
            F.concat(F.lit("rule_"), number.cast("string"), F.lit(" violated")).alias("message"),
        )

    semantic = F.struct(
        F.col("final_status").alias("status"),
        F.array(rule(0, F.col("final_status")), rule(3, F.when(k % 5 == 0, "WARN").otherwise("PASS"))).alias("rules"),
    )
    where = k % 4
    return runs.select(
        "*",
        F.when(where == 0, F.to_json(semantic)).alias("semantic_json"),
        F.when(where == 1, F.to_json(F.struct(semantic.alias("semantic_quality")))).alias("manifest_json"),
        F.when(where == 2, F.to_json(F.struct(semantic.alias("semantic")))).alias("preflight_json"),
    )


def data_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered data sources from nations."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"),
        F.col("n_name").alias("name"),
        (F.col("n_nationkey") == 7).alias("is_default"),
        (F.col("n_regionkey") != 3).alias("is_active"),
    )


def delivery_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery-attempt ledger from events."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    status = (
        F.when(kind.isin("purchase", "view"), "SENT")
        .when(kind == "click", "RETRY")
        .when(kind == "error", "DEAD")
        .otherwise("FAILED")
    )
    duration = F.when(k % 17 != 0, F.round(F.col("value") * 100).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("attempt_id"),
        F.concat(F.lit("channel_"), (F.col("user_id") % 5).cast("string")).alias("channel_target"),
        F.when(F.col("event_id") % 2 == 0, "ALERT_FIRING").otherwise("ALERT_RESOLVED").alias("event_type"),
        (F.col("user_id") % 13).alias("alert_id"),
        status.alias("attempt_status"),
        F.col("ts").alias("started_at"),
        F.timestamp_micros(
            F.unix_micros("ts") + F.coalesce(duration, F.lit(0)).cast("long") * 1000
        ).alias("completed_at"),
        duration.alias("duration_ms"),
        F.when(
            status != "SENT",
            F.when(k % 5 == 0, "TIMEOUT").when(k % 5 == 1, "NETWORK_ERROR").otherwise("HTTP_ERROR"),
        ).alias("error_code"),
        F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("n"), F.col("event_id").cast("string"))).alias(
            "replayed_from_id"
        ),
        k.alias("k"),
    )


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notification outbox from events."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("event_id"),
        F.concat(F.lit("channel_"), (F.col("user_id") % 7).cast("string")).alias("channel_target"),
        F.when(F.col("event_id") % 2 == 0, "ALERT_FIRING").otherwise("ALERT_RESOLVED").alias("event_type"),
        F.when(kind == "click", "PENDING")
        .when(kind == "signup", "RETRYING")
        .when(kind == "error", "DEAD")
        .when(kind == "view", "FAILED")
        .otherwise("SENT")
        .alias("status"),
        (k % 6).alias("attempt_count"),
        F.lit(5).alias("max_attempts"),
        F.timestamp_micros(F.unix_micros("ts") + (k * 60).cast("long") * 1000000).alias("next_retry_at"),
        F.col("ts").alias("created_at"),
        F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("n"), F.col("event_id").cast("string"))).alias(
            "replayed_from_id"
        ),
        k.alias("k"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages: a lead sentence chosen by turn in front of the whole conversation text."""
    pick = (F.col("conv_id") + F.col("turn")) % 9
    conv = F.col("conv_id").cast("string")
    lead = (
        F.when(pick == 0, F.concat(F.lit("Forecast store "), conv, F.lit(" for 45 days. ")))
        .when(pick == 1, F.lit("KPI from 2001-03-05 to 2001-01-02. "))
        .when(pick == 2, F.concat(F.lit("Compare store #"), conv, F.lit(" vs store 3. ")))
        .when(pick == 3, F.lit("top stores until 2000-06-30 "))
        .when(pick == 4, F.concat(F.lit("promo for store_id "), conv, F.lit(", 999 days ")))
        .when(pick == 5, F.lit("توقع المتجر 12 "))
        .when(pick == 6, F.lit("model accuracy? "))
        .when(pick == 7, F.lit("pipeline data status "))
        .otherwise(F.lit(""))
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(lead, F.coalesce("text", F.lit(""))).alias("message")
    )


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales export as text with planted faults: bad ids, days, dates and numbers, nulls, an unknown column."""
    line, quantity = F.col("l_linenumber"), F.col("l_quantity")
    day = F.to_date("l_shipdate")
    date_text = (
        F.when((quantity == 17) & (line == 3), "not-a-date")
        .when(line % 4 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(line % 4 == 1, F.date_format(day, "MM/dd/yyyy"))
        .when(line % 4 == 2, F.date_format(day, "yyyy/MM/dd"))
        .otherwise(F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
    )
    sales = (
        F.when((quantity == 23) & (line == 2), F.lit(None))
        .when((quantity == 19) & (line == 1), "abc")
        .when((quantity == 29) & (line == 5), "-50")
        .otherwise(F.concat(F.lit(" "), F.col("l_extendedprice").cast("string"), F.lit(" ")))
    )
    weekday = (
        F.when(quantity == 11, "x")
        .when((quantity == 7) & (line == 6), "9")
        .otherwise((F.weekday(day) + 1).cast("string"))
    )
    return table(spark, sf_dir, "lineitem").select(
        F.when((quantity == 13) & (line == 7), "A").otherwise(F.col("l_suppkey").cast("string")).alias("Store"),
        weekday.alias("DayOfWeek"),
        date_text.alias("Date"),
        sales.alias("Sales"),
        F.when(F.col("l_discount") >= 0.015, quantity.cast("string")).alias("Customers"),
        F.when(line == 7, "yes").when(quantity > 2, "1").otherwise("0").alias("Open"),
        F.when(F.col("l_discount") >= 0.05, "1.0").otherwise("0").alias("Promo"),
        F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" ")).alias("StateHoliday"),
        F.when(F.col("l_linestatus") == "F", "1").otherwise("0").alias("SchoolHoliday"),
        F.col("l_partkey").cast("string").alias("CustomMetric"),
    )


def raw_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store export as text with gaps in every optional column."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.cast("string").alias("Store"),
        F.when(key % 7 != 0, F.col("s_name")).alias("StoreType"),
        F.when(key % 9 != 0, F.substring(F.lit("abc"), (key % 3 + 1).cast("int"), F.lit(1))).alias("Assortment"),
        F.when(key % 11 == 3, "n/a")
        .when(key % 5 != 0, F.abs("s_acctbal").cast("decimal(12,2)").cast("string"))
        .alias("CompetitionDistance"),
        F.when(key % 4 != 0, (key % 12 + 1).cast("double").cast("string")).alias("CompetitionOpenSinceMonth"),
        F.when(key % 4 != 0, (key % 20 + 1995).cast("string")).alias("CompetitionOpenSinceYear"),
        F.when(key % 6 != 0, (key % 2).cast("string")).alias("Promo2"),
        F.when(key % 6 == 1, (key % 53).cast("string")).alias("Promo2SinceWeek"),
        F.when(key % 6 == 1, (key % 20 + 1995).cast("string")).alias("Promo2SinceYear"),
        F.when(key % 6 == 1, "Jan,Apr,Jul,Oct").alias("PromoInterval"),
    )


def grouped_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log with several sources per run: four consecutive records share a run id."""
    return run_log(spark, sf_dir).withColumn("run_id", F.floor(F.col("run_id") / 4))


def silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert silences from orders; blank and missing match fields mean any."""
    k = F.col("o_orderkey")
    text = k.cast("string")
    start = F.unix_micros("o_orderdate")
    day = 86400 * 1000000
    return table(spark, sf_dir, "orders").select(
        k.alias("silence_id"),
        F.when(k % 3 != 0, F.concat(F.lit("policy_"), (k % 10).cast("string"))).alias("policy_id"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, " Train").when(k % 4 == 2, "store").alias("source_name"),
        F.when(k % 5 == 0, "high").when(k % 5 == 1, "MEDIUM").alias("severity"),
        F.when(k % 2 == 0, F.concat(F.lit("rule_"), (k % 3).cast("string"))).alias("rule_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("starts_at"),
        F.timestamp_micros(start + (F.col("o_custkey") % 30 + 1) * day).alias("ends_at"),
        F.when(F.col("o_orderstatus") == "P", F.timestamp_micros(start + 5 * day)).alias("expired_at"),
        text.alias("reason"),
    )


def alert_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active alerts from events."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("alert_id"),
        F.concat(F.lit("policy_"), (k % 10).cast("string")).alias("policy_id"),
        F.when(F.col("user_id") % 2 == 0, "train").otherwise("store").alias("source_name"),
        F.when(k % 3 == 0, "HIGH").when(k % 3 == 1, "MEDIUM").otherwise("LOW").alias("severity"),
        F.when(k % 4 != 0, F.concat(F.lit("rule_"), (k % 3).cast("string"))).alias("rule_id"),
        F.when(F.col("value") > 40, "FIRING").otherwise("PENDING").alias("status"),
        F.col("ts").alias("last_seen_at"),
        F.col("user_id"),
    )


def acknowledge_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acknowledge and clear commands from events; the alert is named by the user's number."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").where(kind.isin("click", "view")).select(
        F.col("event_id").alias("command_id"),
        F.col("user_id").alias("alert_id"),
        F.when(kind == "click", "acknowledge").otherwise("clear").alias("command"),
        F.col("ts").alias("made_at"),
        F.concat(F.lit("user_"), (F.col("user_id") % 3).cast("string")).alias("actor"),
    )


def delivery_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of delivery calls per outbox item from events; some items got none."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").where(k % 10 != 9).select(
        F.col("event_id").alias("id"),
        (k % 5 == 0).alias("success"),
        F.when(k % 5 == 0, 204).when(k % 5 == 1, 503).when(k % 5 == 2, 429).when(k % 5 == 3, 400).alias("http_status"),
        F.when(k % 5 == 4, "network_error").when(k % 5 != 0, "http_error").alias("error_code"),
        F.when(k % 5 != 0, F.concat(F.lit(" call failed\n code "), (k % 5).cast("string"), F.lit(" "))).alias("error"),
    )


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training experiments from orders, metrics as JSON."""
    price = F.col("o_totalprice")
    best = F.struct(
        price.alias("mae"),
        (price * 2).alias("rmse"),
        F.when(F.col("o_custkey") >= 0, (F.col("o_custkey") + 1).cast("double")).alias("wape"),
        (F.col("o_orderkey") + 1).cast("double").alias("mape"),
    )
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("experiment_id"),
        F.when(status == "F", "COMPLETED").when(status == "O", "RUNNING").otherwise("FAILED").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.to_json(F.struct(best.alias("best"))).alias("metrics_json"),
        F.to_date(F.date_sub("o_orderdate", 900)).alias("train_period_start"),
        F.to_date(F.date_sub("o_orderdate", 91)).alias("train_period_end"),
        F.to_date(F.date_sub("o_orderdate", 90)).alias("validation_period_start"),
        F.to_date("o_orderdate").alias("validation_period_end"),
    )


def counter_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative event counters per type every five minutes, restarting each day as after a deploy."""
    width = 300
    slot = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / width) * width)
    counts = table(spark, sf_dir, "events").groupBy("event_type", slot.alias("seen_at")).agg(F.count("*").alias("n"))
    # One row per type and five minutes: the window's groups are bounded by the day.
    today = W.partitionBy("event_type", F.to_date("seen_at")).orderBy("seen_at").rowsBetween(W.unboundedPreceding, 0)
    return counts.select("event_type", "seen_at", F.sum("n").over(today).alias("value"))
