"""Mergeable sketches within their bounds of the exact rows; keyset pages equal to the sorted rows."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import grid, profiles, runlog

RULE = profiles.Sketches(distinct=("store_id", "amount"), quantiles=("amount",), frequent=("kind",))
SCHEMA = "day date, store_id long, amount double, kind string"


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return spark.range(60_000).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 20).cast("int")).alias("day"),
        (i * 7919 % 5003).alias("store_id"),
        F.when(i % 50 != 0, (F.pow(i * 104729 % 60_013, F.lit(1.5))).cast("double")).alias("amount"),
        F.when(i % 9 != 0, F.concat(F.lit("k"), (F.floor(F.sqrt(i % 100))).cast("string"))).alias("kind"),
    )


def test_merged_days_stay_within_their_bounds(spark, rows):
    ranks = (0.05, 0.5, 0.95, 0.997)
    found = {r.column_name: r for r in profiles.merged_profile(profiles.daily_profiles(rows, "day", RULE), RULE, ranks).collect()}
    total = rows.count()
    for name in ("store_id", "amount"):
        exact = rows.select(name).distinct().where(F.col(name).isNotNull()).count()
        assert abs(found[name].distinct_estimate - exact) <= 4 * 1.04 / 2 ** (RULE.lg / 2) * exact
    amount = rows.where("amount IS NOT NULL")
    n = amount.count()
    for rank, value in zip(ranks, found["amount"].quantiles):
        assert abs(amount.where(F.col("amount") <= value).count() / n - rank) <= 2 * 3.3 / RULE.k
    assert found["amount"].null_count == total - n and found["amount"].row_count == total
    exact = rows.agg(F.min("amount"), F.max("amount"), F.count_if(F.col("amount") == 0)).first()
    assert (found["amount"].min_value, found["amount"].max_value, found["amount"].zero_count) == tuple(exact)
    kinds = {r.kind: r["count"] for r in rows.where("kind IS NOT NULL").groupBy("kind").count().collect()}
    assert {f.value: f.num_rows for f in found["kind"].frequent} == kinds


def test_a_new_day_reads_that_day_only(spark, rows, tmp_path):
    source, target = str(tmp_path / "rows"), str(tmp_path / "profiles")
    rows.write.partitionBy("day").parquet(source)
    stored = spark.read.parquet(source)
    profiles.store_profiles(stored.where("day < '2024-01-20'"), "day", RULE, target)
    old = {p: p.stat().st_mtime_ns for p in (tmp_path / "profiles").rglob("*.parquet")}
    assert len(old) == 19
    new = date(2024, 1, 20)
    plan = profiles.daily_profiles(stored.where(F.col("day").isin([new])), "day", RULE)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    profiles.store_profiles(stored, "day", RULE, target, [new])
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "profiles").rglob("*.parquet")}
    assert len(now) == 20 and old.items() <= now.items()
    whole = profiles.merged_profile(profiles.daily_profiles(rows, "day", RULE), RULE).collect()
    merged = profiles.merged_profile(spark.read.parquet(target), RULE).collect()
    assert [(r.column_name, r.row_count, r.null_count, r.distinct_estimate, r.min_value) for r in whole] == [
        (r.column_name, r.row_count, r.null_count, r.distinct_estimate, r.min_value) for r in merged
    ]


def test_profile_of_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    rows = profiles.merged_profile(profiles.daily_profiles(empty, "day", RULE), RULE).collect()
    assert [(r.column_name, r.row_count, r.distinct_estimate) for r in rows] == [("store_id", 0, 0), ("amount", 0, 0), ("kind", 0, None)]
    assert rows[1].quantiles is None and rows[1].min_value is None


def test_pages_by_key_cover_the_sorted_rows(spark):
    data = [(i, None if i % 5 == 0 else i % 3, None if i % 7 == 0 else f"n{i % 4}") for i in range(57)]
    df = spark.createDataFrame(data, "id long, size long, name string")
    for order in ([("size", True), ("name", False), ("id", False)], [("name", True), ("size", False), ("id", True)]):
        got, last = [], None
        while True:
            page = grid.page_after(df, order, 10, last).collect()
            if not page:
                break
            assert {r.total for r in page} == {57} and len(page) <= 10
            got += [r.id for r in page]
            last = page[-1].asDict()
        keys = [F.desc_nulls_last(c) if d else F.asc_nulls_last(c) for c, d in order]
        assert got == [r.id for r in df.orderBy(*keys).collect()]


def test_page_bound_reaches_the_scan(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    page = grid.page_after(spark.read.parquet(str(tmp_path / "t")), [("id", False)], 10, {"id": 700})
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,700)" in plan or "GreaterThan(id,700)" in plan
    assert [r.id for r in page.collect()] == list(range(701, 711))


def test_newest_message_of_a_rule(spark):
    t = datetime(2024, 1, 1)
    events = [
        ("r", "a", None, "WARN", "old", t, "1"), ("r", "a", None, "FAIL", "new", t + timedelta(days=1), "2"),
        ("r", "a", None, "FAIL", "newer id", t + timedelta(days=1), "3"), ("r", "a", None, "WARN", "", t + timedelta(days=2), "9"),
        ("q", "a", "x", "WARN", "", t, "1"), ("p", "a", "x", "PASS", "fine", t, "1"),
    ]
    df = spark.createDataFrame(events, "rule_id string, rule_type string, severity string, status string, message string, created_at timestamp, run_id string")
    counts = runlog.rule_counts(df)
    got = {r.rule_id: (r.warn_count, r.fail_count, r.last_seen_at, r.sample_message) for r in counts.collect()}
    assert got == {"r": (2, 2, t + timedelta(days=2), "newer id"), "q": (1, 0, t, None)}
