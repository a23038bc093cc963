"""Merges of touched months, batches that come twice, upserts that don't rank the stored rows."""

import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import features
from shelfscope.operators.keyed import upserted
from shelfscope.sources import sinks

DAYS = [date(2024, 1, 30) + timedelta(days=i) for i in range(40)]  # four days of January and March, all of February
FACT = "store_id long, full_date date, sales double, promo int"


def fact(spark, days, sales):
    return spark.createDataFrame([(s, d, sales + s, 1) for s in (1, 2) for d in days], FACT)


def stored(tmp_path):
    return {p for p in (tmp_path / "w/versions").rglob("fact_sales_daily/year=*/month=*/*.parquet")}


@pytest.fixture
def root(spark, tmp_path):
    dims = spark.range(2).toDF("store_id"), spark.createDataFrame([(d,) for d in DAYS], "full_date date")
    sinks.reload_warehouse(fact(spark, DAYS, 10.0), *dims, str(tmp_path / "w"))
    return str(tmp_path / "w")


def rows(frame):
    return sorted((r.store_id, r.full_date, r.sales, r.promo) for r in frame.collect())


def test_one_day_rewrites_one_month(spark, root, tmp_path):
    before, old = stored(tmp_path), rows(sinks.read_fact(spark, root))
    day = date(2024, 2, 14)
    assert sinks.merge_fact(fact(spark, [day], 500.0).where("store_id = 1"), root) == [(2024, 2)]
    new = stored(tmp_path) - before
    assert {(p.parent.parent.name, p.parent.name) for p in new} == {("year=2024", "month=2")} and before <= stored(tmp_path)
    expected = [(s, d, 501.0 if (s, d) == (1, day) else v, p) for s, d, v, p in old]
    assert rows(sinks.read_fact(spark, root)) == expected
    assert rows(sinks.read_fact(spark, root, date(2024, 2, 10), date(2024, 3, 2))) == [r for r in expected if date(2024, 2, 10) <= r[1] <= date(2024, 3, 2)]
    assert sinks.read_fact(spark, root, date(2030, 1, 1)).count() == 0
    # A range reads the folders of its months only.
    files = sinks.read_fact(spark, root, date(2024, 3, 1)).inputFiles()
    assert files and all("month=3" in f for f in files)
    tables = sinks.read_warehouse(spark, root)
    assert tables["dim_store"].count() == 2 and tables["dim_date"].count() == len(DAYS)


def test_merge_upon_merge_with_a_new_month(spark, root):
    old = rows(sinks.read_fact(spark, root))
    more = [date(2024, 3, 1), date(2024, 4, 1)]
    sinks.merge_fact(fact(spark, [date(2024, 1, 31)], 700.0), root)
    calendar = spark.createDataFrame([(d,) for d in [*DAYS, more[1]]], "full_date date")
    assert sinks.merge_fact(fact(spark, more, 900.0).drop("promo"), root, dim_date=calendar) == [(2024, 3), (2024, 4)]
    changed = {(s, date(2024, 1, 31)): (700.0 + s, 1) for s in (1, 2)} | {(s, d): (900.0 + s, None) for s in (1, 2) for d in more}
    expected = {(s, d): (v, p) for s, d, v, p in old} | changed
    assert {(s, d): (v, p) for s, d, v, p in ((r.store_id, r.full_date, r.sales, r.promo) for r in sinks.read_fact(spark, root).collect())} == expected
    assert sinks.read_warehouse(spark, root)["dim_date"].count() == len(DAYS) + 1
    sinks.reload_warehouse(fact(spark, DAYS[:2], 1.0), spark.range(1), calendar, root)
    assert sinks.read_fact(spark, root).count() == 4


def test_merges_that_are_refused(spark, root):
    old = rows(sinks.read_fact(spark, root))
    twice = fact(spark, [DAYS[0]], 5.0)
    with pytest.raises(ValueError, match="repeat"):
        sinks.merge_fact(twice.union(twice), root)
    with pytest.raises(ValueError, match="lacks"):
        sinks.merge_fact(twice.withColumn("other", F.lit(1)), root)
    with pytest.raises(Exception, match="stop"):
        sinks.merge_fact(twice.withColumn("promo", F.raise_error(F.lit("stop")).cast("int")), root)
    assert sinks.merge_fact(twice.limit(0), root) == []
    assert rows(sinks.read_fact(spark, root)) == old


def test_upsert_passes_stored_rows_through(spark):
    schema = "k string, v int, x string"
    old = spark.createDataFrame([("a", 5, "old"), ("b", 1, "old"), (None, 1, "old")], schema)
    new = spark.createDataFrame([("a", 1, "new"), ("c", 1, "first"), ("c", 2, "new"), (None, 1, "new")], schema)
    for unique in (True, False):
        got = {(r.k, r.v, r.x) for r in upserted(old, new, ["k"], "v", existing_unique=unique).collect()}
        assert got == {("a", 1, "new"), ("b", 1, "old"), ("c", 2, "new"), (None, 1, "new")}
    twice = old.union(spark.createDataFrame([("b", 3, "later")], schema))
    assert {(r.k, r.x) for r in upserted(twice, new, ["k"], "v").collect()} >= {("b", "later")}
    assert upserted(old.limit(0), new, ["k"], "v").count() == 3 and upserted(old, new.limit(0), ["k"], "v").count() == 3


RECORD = "run_id long, updated_at timestamp, status string"


def test_record_batches_are_idempotent(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    parts = [
        [(1, at(0), "RUNNING"), (2, at(0), "RUNNING"), (3, at(1), "RUNNING")],
        [(1, at(5), "COMPLETED"), (1, at(3), "RUNNING"), (2, at(4), "FAILED")],
        [(2, at(2), "RUNNING"), (4, at(9), "RUNNING")],  # a late record of run 2
    ]
    path = str(tmp_path / "log")
    write = sinks.record_batches(path, ["run_id"], "updated_at")
    for part in parts:
        spark.createDataFrame(part, RECORD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        # Every round is a restart from the checkpoint.
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start().awaitTermination()
    state = lambda: sorted((r.run_id, r.status) for r in sinks.newest_records(spark, path, ["run_id"], "updated_at").collect())
    expected = [(1, "COMPLETED"), (2, "FAILED"), (3, "RUNNING"), (4, "RUNNING")]
    assert state() == expected
    count = spark.read.parquet(path).count()
    for i, part in enumerate(parts):
        write(spark.createDataFrame(part, RECORD), i)
    assert state() == expected and spark.read.parquet(path).count() == count
    sinks.record_batches(path, ["run_id"], "updated_at", "second")(spark.createDataFrame([(3, at(20), "COMPLETED")], RECORD), 0)
    assert state() == [(1, "COMPLETED"), (2, "FAILED"), (3, "COMPLETED"), (4, "RUNNING")]


def test_deviations_have_no_sliding_frame(spark):
    values = [250_000_000.25, 250_000_000.5, 250_000_000.25, 0.01, 7.0, 7.0, 7.0, 7.0, 7.0, 7.0, 7.0, 7.0]
    frame = spark.createDataFrame([(1, date(2024, 1, 1) + timedelta(days=i), v) for i, v in enumerate(values)], "store_id int, full_date date, sales double")
    out = features.with_series_features(frame.withColumn("sales", F.col("sales").cast("decimal(14,2)")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "stddev" not in plan and not any(re.search(rf"RowFrame, -{w}, -1\b", plan) for w in features.ROLLING)
    got = [r[0] for r in out.orderBy("full_date").select("rolling_std_7").collect()]
    assert got[:2] == [0.0, 0.0] and got[2] == pytest.approx(0.25 / 2**0.5, rel=1e-12) and got[11] == 0.0
