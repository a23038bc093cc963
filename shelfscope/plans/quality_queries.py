"""Registered data-quality queries over the raw text stand-ins."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import functions as F

from shelfscope.functions.coerce import to_bool, truthy
from shelfscope.operators import profile_policy, quality, validation, warehouse
from shelfscope.plans.oracle_tables import oracle
from shelfscope.plans.registry import Query, presented
from shelfscope.sources import files, tables
from shelfscope.sources.contracts import Rule, load_contract

CONFIG = Path(__file__).resolve().parents[2] / "config"
DAY = "strftime({}, '%Y-%m-%d')"
# Extra rules beside those of the contract, so that every rule type fails and passes somewhere.
EXTRA_RULES = [
    Rule("customers_range", "between", "WARN", ("customers",), 1.0, 40.0),
    Rule("holiday_codes", "accepted_values", "WARN", ("state_holiday",), values=("A", "N")),
    Rule("rows_at_most", "row_count_between", "WARN", (), None, 1000.0),
    Rule("no_such_column", "max_null_ratio", "WARN", ("missing",), ratio=0.5),
]


def _contract():
    return load_contract(CONFIG / "contract_v1.yaml")


def _unified(spark, sf):
    return validation.unified(tables.raw_sales(spark, sf), _contract(), "train")


def _mismatches(spark, sf):
    profile = _contract().profile("train")
    named = validation.with_canonical_names(tables.raw_sales(spark, sf), profile)
    return presented(validation.mismatch_counts(named, profile))


def _coercion(spark, sf):
    return presented(validation.coercion_stats(tables.raw_sales(spark, sf), _contract(), "train"))


def _rules(spark, sf, kinds=None):
    rules = [*_contract().profile("train").rules, *EXTRA_RULES]
    chosen = [r for r in rules if kinds is None or r.rule_type in kinds]
    return quality.evaluate_rules(_unified(spark, sf), chosen)


def _between(spark, sf):
    out = _rules(spark, sf, ("between",))
    return presented(out.select(
        "rule_id", "status", "violations",
        *[F.col("observed")[k].cast("bigint").alias(k) for k in ("row_count", "null_or_invalid_count", "out_of_range_count")],
        *[F.col("observed")[k].cast("double").alias(k) for k in ("min_observed", "max_observed")],
    ))


def _null_ratio(spark, sf):
    out = _rules(spark, sf, ("max_null_ratio",))
    return presented(out.select(
        "rule_id", "status", F.col("observed")["null_count"].cast("bigint").alias("null_count"),
        F.col("observed")["null_ratio"].cast("double").alias("null_ratio")))


def _counted(kind):
    def run(spark, sf):
        return presented(_rules(spark, sf, (kind,)).select("rule_id", "status", "violations"))

    return run


def _samples(spark, sf):
    rule = next(r for r in _contract().profile("train").rules if r.rule_type == "accepted_values")
    return presented(quality.invalid_samples(_unified(spark, sf), rule))


def _policy(spark, sf, **changes):
    config = yaml.safe_load((CONFIG / "profile_policy.yaml").read_text())
    source = config["source_profiles"]["train"]
    return presented(profile_policy.policy_counts(
        tables.raw_sales(spark, sf), _contract().profile("train"), {**config["policy"], **changes},
        source["duplicate_subset"], source["ranges"]))


def _checks(spark, sf):
    """Content checks of the raw export as rows."""
    report = validation.validate_frame(tables.raw_sales(spark, sf), _contract(), "train")
    meta = report["metadata"]
    details = {
        "row_limit": meta["rows"], "types": sum(meta["type_mismatches"].values()), "extra_columns": len(meta["extra_columns"]),
        "required_columns": len(meta["mapped_columns"]),
    }
    rows = [(name, report["checks"][name], int(count), report["status"]) for name, count in details.items()]
    return spark.createDataFrame(rows, "check_name string, status string, num bigint, report_status string")


def _flags(spark, sf):
    """Flag words of the raw export as booleans, and their truthiness."""
    raw = tables.raw_sales(spark, sf)
    return presented(
        raw.groupBy(F.col("Open").alias("word")).agg(F.count("*").alias("num_rows"))
        .select("word", "num_rows", to_bool(F.col("word")).alias("flag"), truthy(F.col("word")).alias("is_truthy"))
    )


RULES_SQL = """
WITH n AS (SELECT COUNT(*) AS rows FROM unified),
r AS (
  SELECT 'sales_non_negative' AS rule_id, 'between' AS rule_type, 'sales' AS target, 'FAIL' AS severity,
         COUNT(*) FILTER (sales IS NULL OR sales < 0) AS violations FROM unified
  UNION ALL SELECT 'day_of_week_allowed', 'accepted_values', 'day_of_week', 'FAIL',
         COUNT(*) FILTER (day_of_week IS NULL OR day_of_week NOT BETWEEN 1 AND 7) FROM unified
  UNION ALL SELECT 'customers_null_ratio', 'max_null_ratio', 'customers', 'WARN',
         COUNT(*) FILTER (customers IS NULL) FROM unified
  UNION ALL SELECT 'train_pk_unique', 'composite_unique', 'store_id,full_date', 'FAIL',
         (SELECT CAST(COALESCE(SUM(c), 0) AS BIGINT) FROM
            (SELECT COUNT(*) AS c FROM unified GROUP BY store_id, full_date HAVING COUNT(*) > 1))
  UNION ALL SELECT 'row_count_min', 'row_count_between', '', 'FAIL', CASE WHEN rows < 1 THEN 1 ELSE 0 END FROM n
  UNION ALL SELECT 'customers_range', 'between', 'customers', 'WARN',
         COUNT(*) FILTER (customers IS NULL OR customers < 1 OR customers > 40) FROM unified
  UNION ALL SELECT 'holiday_codes', 'accepted_values', 'state_holiday', 'WARN',
         COUNT(*) FILTER (state_holiday IS NULL OR state_holiday NOT IN ('A', 'N')) FROM unified
  UNION ALL SELECT 'rows_at_most', 'row_count_between', '', 'WARN', CASE WHEN rows > 1000 THEN 1 ELSE 0 END FROM n
  UNION ALL SELECT 'no_such_column', 'max_null_ratio', 'missing', 'WARN', NULL),
s AS (SELECT *, CASE WHEN violations IS NULL THEN severity
                     WHEN rule_id = 'customers_null_ratio' THEN
                       CASE WHEN violations / (SELECT rows FROM n) > 0.10 THEN severity ELSE 'PASS' END
                     WHEN violations > 0 THEN severity ELSE 'PASS' END AS status FROM r)
"""
POLICY_ROWS_SQL = """
  SELECT 'coercion' AS check_name, 'store_id' AS column_name, COUNT(*) FILTER (raw_store IS NOT NULL AND store_id IS NULL) AS count FROM unified
  UNION ALL SELECT 'coercion', 'day_of_week', COUNT(*) FILTER (raw_day IS NOT NULL AND day_of_week IS NULL) FROM unified
  UNION ALL SELECT 'coercion', 'full_date', COUNT(*) FILTER (raw_date IS NOT NULL AND full_date IS NULL) FROM unified
  UNION ALL SELECT 'coercion', 'sales', COUNT(*) FILTER (raw_sales IS NOT NULL AND sales IS NULL) FROM unified
  UNION ALL SELECT 'coercion', 'customers', COUNT(*) FILTER (raw_customers IS NOT NULL AND customers IS NULL) FROM unified
  UNION ALL SELECT 'coercion', 'open', COUNT(*) FILTER (raw_open IS NOT NULL AND open IS NULL) FROM unified
  UNION ALL SELECT 'coercion', 'promo', 0
  UNION ALL SELECT 'coercion', 'state_holiday', 0
  UNION ALL SELECT 'coercion', 'school_holiday', 0
  UNION ALL SELECT 'rows_read', '', COUNT(*) FROM unified
  UNION ALL SELECT 'invalid_date', 'full_date', COUNT(*) FILTER (full_date IS NULL) FROM unified
  UNION ALL SELECT 'null_required', 'store_id', COUNT(*) FILTER (store_id IS NULL) FROM kept
  UNION ALL SELECT 'null_required', 'day_of_week', COUNT(*) FILTER (day_of_week IS NULL) FROM kept
  UNION ALL SELECT 'null_required', 'full_date', COUNT(*) FILTER (full_date IS NULL) FROM kept
  UNION ALL SELECT 'null_required', 'sales', COUNT(*) FILTER (sales IS NULL) FROM kept
  UNION ALL SELECT 'rows_after_dates', '', COUNT(*) FROM kept
  UNION ALL SELECT 'duplicate', '', COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT store_id, full_date FROM kept)) FROM kept
"""
RANGE_ROWS_SQL = POLICY_ROWS_SQL + """
  UNION ALL SELECT 'range_min', 'sales', COUNT(*) FILTER (sales < 0) FROM kept
  UNION ALL SELECT 'range_min', 'customers', COUNT(*) FILTER (customers < 0) FROM kept
  UNION ALL SELECT 'range_allowed', 'promo', COUNT(*) FILTER (promo NOT IN (0, 1)) FROM kept
  UNION ALL SELECT 'range_allowed', 'open', COUNT(*) FILTER (open NOT IN (0, 1)) FROM kept
  UNION ALL SELECT 'range_allowed', 'school_holiday', COUNT(*) FILTER (school_holiday NOT IN (0, 1)) FROM kept
  UNION ALL SELECT 'range_min', 'day_of_week', COUNT(*) FILTER (day_of_week < 1) FROM kept
  UNION ALL SELECT 'range_max', 'day_of_week', COUNT(*) FILTER (day_of_week > 7) FROM kept
  UNION ALL SELECT 'range_min_date', 'full_date', COUNT(*) FILTER (full_date < DATE '2000-01-01') FROM kept
  UNION ALL SELECT 'range_max_date', 'full_date', COUNT(*) FILTER (full_date > DATE '2100-12-31') FROM kept
  UNION ALL SELECT 'rows_after_policy', '', COUNT(*) FROM kept
"""


def _stat_sql(bad: str, nulls: str | None) -> str:
    columns = [
        ("store_id", "int", "raw_store"), ("day_of_week", "int", "raw_day"), ("full_date", "date", "raw_date"),
        ("sales", "float", "raw_sales"), ("customers", "float", "raw_customers"), ("open", "int", "raw_open"),
        ("promo", "int", "promo"), ("state_holiday", "string", "state_holiday"), ("school_holiday", "int", "school_holiday"),
    ]
    parts = []
    for name, dtype, raw in columns:
        extra = f"COUNT(*) FILTER ({name} IS NULL) AS {nulls}, " if nulls else ""
        parts.append(
            f"SELECT '{name}' AS column_name, '{dtype}' AS expected_dtype, "
            f"COUNT(*) FILTER ({raw} IS NOT NULL AND {name} IS NULL) AS {bad}, {extra}COUNT(*) AS row_count FROM unified"
        )
    return " UNION ALL ".join(parts)


CLEAN_SALES_SQL = oracle("unified", f"""
    SELECT store_id, {DAY.format('full_date')} AS full_date, COALESCE(sales, 0) AS sales,
           COALESCE(CAST(customers AS BIGINT), 0) AS customers, COALESCE(promo, 0) AS promo,
           ' ' || state_holiday || ' ' AS state_holiday, COALESCE(school_holiday, 0) AS school_holiday,
           COALESCE(open, 1) AS open
    FROM unified WHERE full_date IS NOT NULL AND raw_sales IS NOT NULL AND raw_store <> 'A'""")


def _clean_sales_text(spark, sf):
    """The sales input as CSV text, parsed again and cleaned: the same rows as from the typed table."""
    raw = tables.raw_sales(spark, sf).where("Store <> 'A'")
    return presented(warehouse.clean_sales(files.parsed_lines(files.csv_lines(raw), raw.columns)))


QUERIES = [
    Query("type_mismatch_counts", "Q-5 F-1 F-2 F-3", _mismatches, oracle("unified", _stat_sql("mismatches", None))),
    Query("unify_canonical", "P-1 P-2 P-3 P-4 F-1 F-2 F-4 Q-8",
          lambda s, d: presented(_unified(s, d)), oracle("unified", f"""
        SELECT store_id, day_of_week, {DAY.format('full_date')} AS full_date, sales, customers, open, promo,
               state_holiday, school_holiday, custom_metric AS "CustomMetric" FROM unified""")),
    Query("coercion_stats", "Q-7", _coercion, oracle("unified", _stat_sql("invalid_to_null", "null_count_after"))),
    Query("validation_checks", "Q-2 Q-3 Q-4 Q-5 Q-6 U-2", _checks, oracle("unified", f"""
        WITH m AS (SELECT CAST(SUM(bad) AS BIGINT) AS bad, MAX(row_count) AS n FROM ({_stat_sql('bad', None)})),
        c AS (SELECT 'row_limit' AS check_name, CASE WHEN n > 2000000 THEN 'FAIL' ELSE 'PASS' END AS status, n AS num FROM m
              UNION ALL SELECT 'types', CASE WHEN bad > 0 THEN 'WARN' ELSE 'PASS' END, bad FROM m
              UNION ALL SELECT 'extra_columns', 'WARN', 1
              UNION ALL SELECT 'required_columns', CASE WHEN n = 0 THEN 'FAIL' ELSE 'PASS' END, 9 FROM m)
        SELECT *, CASE WHEN (SELECT COUNT(*) FROM c WHERE status = 'FAIL') > 0 THEN 'FAIL' ELSE 'WARN' END AS report_status
        FROM c""")),
    Query("flag_words", "F-3 F-18", _flags, oracle("raw_sales", """
        SELECT open AS word, COUNT(*) AS num_rows, open IN ('1', 'yes') AS flag, open IN ('1', 'yes') AS is_truthy
        FROM raw_sales GROUP BY open""")),
    Query("clean_sales", "P-6 S-1 X-14", lambda s, d: presented(warehouse.clean_sales(tables.raw_sales(s, d).where(
        "Store <> 'A'"))), CLEAN_SALES_SQL),
    Query("clean_sales_text", "S-1 S-2 P-6", _clean_sales_text, CLEAN_SALES_SQL),
    Query("clean_store", "P-5 A-38", lambda s, d: presented(warehouse.clean_store(tables.raw_store(s, d))),
          oracle("raw_store", """
        WITH m AS (SELECT quantile_cont(CAST(competition_distance AS DOUBLE), 0.5) AS med FROM raw_store)
        SELECT store_id, COALESCE(store_type, 'unknown') AS store_type, COALESCE(assortment, 'unknown') AS assortment,
               CAST(CAST(COALESCE(CAST(competition_distance AS DOUBLE), med) AS DECIMAL(12,2)) AS DOUBLE)
                 AS competition_distance,
               COALESCE(open_month, 0) AS competition_open_since_month,
               COALESCE(open_year, 0) AS competition_open_since_year, COALESCE(promo2, 0) AS promo2,
               COALESCE(promo2_week, 0) AS promo2_since_week, COALESCE(promo2_year, 0) AS promo2_since_year,
               COALESCE(promo_interval, 'none') AS promo_interval FROM raw_store, m""")),
    Query("rule_between", "Q-9 X-13", _between, oracle("unified", """
        SELECT 'sales_non_negative' AS rule_id,
               CASE WHEN COUNT(*) FILTER (sales IS NULL OR sales < 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
               COUNT(*) FILTER (sales IS NULL OR sales < 0) AS violations, COUNT(*) AS row_count,
               COUNT(*) FILTER (sales IS NULL) AS null_or_invalid_count,
               COUNT(*) FILTER (sales < 0) AS out_of_range_count, MIN(sales) AS min_observed, MAX(sales) AS max_observed
        FROM unified UNION ALL
        SELECT 'customers_range',
               CASE WHEN COUNT(*) FILTER (customers IS NULL OR customers < 1 OR customers > 40) > 0 THEN 'WARN' ELSE 'PASS' END,
               COUNT(*) FILTER (customers IS NULL OR customers < 1 OR customers > 40), COUNT(*),
               COUNT(*) FILTER (customers IS NULL), COUNT(*) FILTER (customers < 1 OR customers > 40),
               MIN(customers), MAX(customers) FROM unified""")),
    Query("rule_accepted_values", "Q-10 X-13", _counted("accepted_values"), oracle("unified", RULES_SQL + """
        SELECT rule_id, status, violations FROM s WHERE rule_type = 'accepted_values'""")),
    Query("rule_accepted_samples", "Q-10", _samples, oracle("unified", """
        SELECT DISTINCT CAST(day_of_week AS VARCHAR) AS value FROM unified WHERE day_of_week NOT BETWEEN 1 AND 7
        ORDER BY value LIMIT 5""")),
    Query("rule_max_null_ratio", "Q-11 Q-14", _null_ratio, oracle("unified", """
        SELECT 'customers_null_ratio' AS rule_id,
               CASE WHEN COUNT(*) FILTER (customers IS NULL) / COUNT(*) > 0.10 THEN 'WARN' ELSE 'PASS' END AS status,
               COUNT(*) FILTER (customers IS NULL) AS null_count,
               COUNT(*) FILTER (customers IS NULL) / COUNT(*) AS null_ratio FROM unified
        UNION ALL SELECT 'no_such_column', 'WARN', NULL, NULL""")),
    Query("rule_composite_unique", "Q-12", _counted("composite_unique"), oracle("unified", RULES_SQL + """
        SELECT rule_id, status, violations FROM s WHERE rule_type = 'composite_unique'""")),
    Query("rule_row_count", "Q-13", _counted("row_count_between"), oracle("unified", RULES_SQL + """
        SELECT rule_id, status, violations FROM s WHERE rule_type = 'row_count_between'""")),
    Query("rule_engine_report", "Q-14 Q-15", lambda s, d: presented(
        _rules(s, d).select("rule_id", "rule_type", "target", "severity", "status", "violations")),
          oracle("unified", RULES_SQL + "SELECT rule_id, rule_type, target, severity, status, violations FROM s")),
    Query("rule_engine_summary", "Q-15 Q-6", lambda s, d: presented(quality.rule_summary(_rules(s, d))),
          oracle("unified", RULES_SQL + """
        SELECT CASE WHEN COUNT(*) FILTER (status = 'FAIL') > 0 THEN 'FAIL'
                    WHEN COUNT(*) FILTER (status = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END AS status,
               COUNT(*) AS total, COUNT(*) FILTER (status = 'PASS') AS passed,
               COUNT(*) FILTER (status = 'WARN') AS warned, COUNT(*) FILTER (status = 'FAIL') AS failed FROM s""")),
    Query("profile_policy_report", "Q-18 U-1", _policy, oracle(
        "unified", f"WITH kept AS (SELECT * FROM unified) SELECT * FROM ({RANGE_ROWS_SQL})")),
    Query("profile_policy_drop", "Q-18", lambda s, d: _policy(
        s, d, on_invalid_dates="drop", on_duplicates="drop").where("check_name NOT LIKE 'range%'"), oracle(
        "unified", f"""WITH kept AS (SELECT * FROM unified WHERE full_date IS NOT NULL)
        SELECT * FROM ({POLICY_ROWS_SQL} UNION ALL SELECT 'rows_after_policy', '', COUNT(*)
                       FROM (SELECT DISTINCT store_id, full_date FROM kept))""")),
]
