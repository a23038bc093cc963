"""Contracts, validation, unification, rules, preflight modes and the load, on small CSV fixtures."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import profile_policy, quality, validation
from shelfscope.plans.preflight import run_load, run_preflight, validate_file
from shelfscope.sources import contracts, files, sinks

CONFIG = Path(__file__).resolve().parents[1] / "config"
HEAD = "Store,DayOfWeek,Date,Sales,Customers,Open,Promo,StateHoliday,SchoolHoliday"
GOOD = f"{HEAD}\n1,5,2015-07-31,5263,555,1,1,0,1\n2,5,2015-07-31,6064,625,1,1,0,1\n"
STORE_HEAD = (
    "Store,StoreType,Assortment,CompetitionDistance,CompetitionOpenSinceMonth,CompetitionOpenSinceYear,Promo2,"
    "Promo2SinceWeek,Promo2SinceYear,PromoInterval"
)
STORES = f'{STORE_HEAD}\n1,c,a,1270,9,2008,0,,,\n2,a,a,,11,2007,1,13,2010,"Jan,Apr,Jul,Oct"\n3,b,b,30,,,,,,\n'


@pytest.fixture(scope="module")
def contract():
    return contracts.load_contract(CONFIG / "contract_v1.yaml")


def changed(contract, **flags):
    return contracts.InputContract(**{**contract.__dict__, **flags})


def put(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def check(spark, contract, path):
    return validate_file(spark, path, contract, "train")


def test_valid_file_passes(spark, contract, tmp_path):
    report, raw = check(spark, contract, put(tmp_path, "t.csv", GOOD))
    assert report["status"] == "PASS" and report["metadata"]["rows"] == 2
    assert report["metadata"]["renamed_columns"]["Store"] == "store_id"


def test_missing_required_fails_and_is_not_unified(spark, contract, tmp_path):
    report, raw = check(spark, contract, put(tmp_path, "t.csv", "Store,DayOfWeek,Date\n1,5,2015-07-31\n"))
    assert report["status"] == "FAIL" and report["checks"]["required_columns"] == "FAIL"
    with pytest.raises(ValueError):
        validation.unify_frame(raw, contract, "train", report)


def test_extra_columns(spark, contract, tmp_path):
    text = GOOD.replace("SchoolHoliday\n", "SchoolHoliday,CustomMetric\n").replace(",0,1\n", ",0,1,7\n")
    path = put(tmp_path, "t.csv", text)
    report, raw = check(spark, contract, path)
    assert report["checks"]["extra_columns"] == "WARN"
    kept, manifest = validation.unify_frame(raw, contract, "train", report)
    assert kept.columns[-1] == "CustomMetric" and manifest["retained_extra_columns"] == ["CustomMetric"]
    dropped, manifest = validation.unify_frame(raw, changed(contract, drop_unknown_columns=True), "train", report)
    assert "CustomMetric" not in dropped.columns and manifest["extra_columns_dropped"] == ["CustomMetric"]
    strict, _ = check(spark, changed(contract, allow_extra_columns=False), path)
    assert strict["status"] == "FAIL"


def test_bad_types_warn_or_fail(spark, contract, tmp_path):
    path = put(tmp_path, "t.csv", f"{HEAD}\nA,5,not-a-date,many,10,1,yes,0,0\n")
    report, _ = check(spark, contract, path)
    assert report["checks"]["types"] == "WARN"
    assert report["metadata"]["type_mismatches"] == {
        "store_id": 1, "day_of_week": 0, "full_date": 1, "sales": 1, "customers": 0, "open": 0, "promo": 1,
        "state_holiday": 0, "school_holiday": 0}
    assert check(spark, changed(contract, strict_types=True), path)[0]["status"] == "FAIL"


def test_empty_wrong_format_size_and_rows(spark, contract, tmp_path):
    assert check(spark, contract, put(tmp_path, "e.csv", HEAD + "\n"))[0]["status"] == "FAIL"
    assert check(spark, contract, put(tmp_path, "n.txt", GOOD))[0]["checks"]["format"] == "FAIL"
    assert check(spark, contract, str(tmp_path / "absent.csv"))[0]["checks"]["format"] == "FAIL"
    path = put(tmp_path, "t.csv", GOOD)
    assert check(spark, changed(contract, max_file_size_mb=0.00001), path)[0]["checks"]["file_size"] == "FAIL"
    assert check(spark, changed(contract, max_rows=1), path)[0]["checks"]["row_limit"] == "FAIL"


def test_aliases_and_coercion(spark, contract, tmp_path):
    text = (
        "store,dayofweek,date,sale,customer_count,is_open,promotion,State Holiday,schoolholiday,ExtraField\n"
        "1,5,2015-07-31,5263.5,555,1,1, a ,1,x\n2,bad,31st,none?,12,yes,1.0,0,0,y\n"
    )
    report, raw = check(spark, contract, put(tmp_path, "t.csv", text))
    out, manifest = validation.unify_frame(raw, contract, "train", report)
    for name in ("day_of_week", "full_date", "sales", "open"):
        assert manifest["coercion_stats"][name]["invalid_to_null"] == 1, name
    rows = out.orderBy("store_id").collect()
    assert rows[0]["state_holiday"] == "a" and rows[0]["sales"] == 5263.5 and rows[1]["promo"] == 1
    assert out.columns[:9] == list(contract.profile("train").order)
    assert manifest["output_row_count"] == 2


def test_encodings(spark, tmp_path):
    text = "Store,Name\n1,Магазин\n"
    utf, sig, cyr = (put(tmp_path, n, text, e) for n, e in (("u.csv", "utf-8"), ("s.csv", "utf-8-sig"), ("c.csv", "cp1251")))
    assert files.choose_encoding(spark, utf) == "utf-8"
    assert files.choose_encoding(spark, cyr) == "cp1251"
    for path in (utf, sig, cyr):
        df = files.read_raw_csv(spark, path, files.choose_encoding(spark, path))
        assert df.columns == ["Store", "Name"] and df.first()["Name"] == "Магазин"


def rules_of(spark, contract, text, tmp_path, name):
    report, raw = check(spark, contract, put(tmp_path, name, text))
    out = validation.unified(raw, contract, "train")
    return {r["rule_id"]: r for r in quality.evaluate_rules(out, list(contract.profile("train").rules)).collect()}


def test_rules(spark, contract, tmp_path):
    good = rules_of(spark, contract, GOOD, tmp_path, "a.csv")
    assert {r["status"] for r in good.values()} == {"PASS"}
    bad = rules_of(spark, contract, GOOD.replace("5263", "-50"), tmp_path, "b.csv")
    assert bad["sales_non_negative"]["status"] == "FAIL" and bad["sales_non_negative"]["violations"] == 1
    assert float(bad["sales_non_negative"]["observed"]["min_observed"]) == -50.0
    day = rules_of(spark, contract, GOOD.replace("1,5,", "1,9,"), tmp_path, "c.csv")
    assert day["day_of_week_allowed"]["status"] == "FAIL"
    warn = rules_of(spark, contract, GOOD.replace(",555,", ",,"), tmp_path, "d.csv")
    assert warn["customers_null_ratio"]["status"] == "WARN"
    assert float(warn["customers_null_ratio"]["observed"]["null_ratio"]) == 0.5
    twice = rules_of(spark, contract, GOOD.replace("\n2,5", "\n1,5"), tmp_path, "e.csv")
    assert twice["train_pk_unique"]["status"] == "FAIL" and twice["train_pk_unique"]["violations"] == 2


def test_rules_on_empty_frame_and_missing_column(spark, contract):
    empty = spark.createDataFrame([], "store_id long, full_date date, sales double, day_of_week long, customers double")
    got = {r["rule_id"]: r["status"] for r in quality.evaluate_rules(empty, list(contract.profile("train").rules)).collect()}
    assert got == {
        "sales_non_negative": "PASS", "day_of_week_allowed": "PASS", "customers_null_ratio": "WARN",
        "train_pk_unique": "PASS", "row_count_min": "FAIL"}
    missing = quality.evaluate_rules(empty.drop("sales"), list(contract.profile("train").rules))
    assert missing.where("rule_id = 'sales_non_negative'").first()["status"] == "FAIL"
    nulls = spark.createDataFrame([(None, 1), (None, 1), (2, 1)], "a long, b long")
    assert quality.duplicate_rows(nulls, ["a", "b"]).first()[0] == 2


@pytest.mark.parametrize(
    "mode,text,blocked,unified,status",
    [
        ("off", GOOD, False, False, "SKIPPED"),
        ("report_only", GOOD.replace("5263", "-1"), False, False, "FAIL"),
        ("enforce", "Store\n1\n", True, False, "FAIL"),
        ("enforce", GOOD.replace(",555,", ",,"), False, True, "WARN"),
        ("enforce", GOOD.replace("5263", "-1"), True, False, "FAIL"),
    ],
)
def test_modes(spark, contract, tmp_path, mode, text, blocked, unified, status):
    path, root = put(tmp_path, "t.csv", text), tmp_path / "out"
    result = run_preflight(spark, path, contract, "train", mode, str(root), "train", "run_1", str(tmp_path / "log"))
    assert (result.blocked, result.used_unified, result.final_status) == (blocked, unified, status)
    assert root.exists() == (mode != "off")
    assert result.used_input_path == (path if not unified else f"{root}/run_1/train/unified.parquet")
    if mode != "off":
        assert sinks.read_json_report(spark, f"{root}/run_1/train/preflight_report")["final_status"] == status
        assert spark.read.parquet(str(tmp_path / "log")).first()["final_status"] == status


def test_load(spark, contract, tmp_path):
    sales = f"{HEAD}\n1,5,2015-07-31,100.25,5,1,0,0,1\n1,5,2015-07-31,50,5,0,1,a,0\n2,3,2015-07-29,abc,7,,1,0,1\n3,4,2015-07-30,,1,1,1,0,1\n"
    a, b = put(tmp_path, "s.csv", sales), put(tmp_path, "st.csv", STORES)
    out = run_load(spark, a, b, contract, "report_only", str(tmp_path / "dw"), "r1")
    tables = sinks.read_warehouse(spark, out["warehouse"])
    fact = {(r["store_id"], str(r["full_date"])): r for r in tables["fact_sales_daily"].collect()}
    assert set(fact) == {(1, "2015-07-31"), (2, "2015-07-29")}
    one = fact[(1, "2015-07-31")]
    assert float(one["sales"]) == 150.25 and one["promo"] == 1 and one["state_holiday"] == "a" and one["open"] == 1
    assert float(fact[(2, "2015-07-29")]["sales"]) == 0.0 and fact[(2, "2015-07-29")]["open"] == 1
    assert tables["dim_date"].count() == 3
    distance = {r["store_id"]: float(r["competition_distance"]) for r in tables["dim_store"].collect()}
    assert distance == {1: 1270.0, 2: 650.0, 3: 30.0}
    statuses = [r["status"] for r in spark.read.parquet(str(tmp_path / "dw/logs/etl_runs")).orderBy("updated_at").collect()]
    assert statuses == ["RUNNING", "COMPLETED"]
    with pytest.raises(RuntimeError):
        run_load(spark, a, b, contract, "enforce", str(tmp_path / "dw2"), "r2")
    assert spark.read.parquet(str(tmp_path / "dw2/logs/etl_runs")).where("status = 'FAILED'").count() == 1


POLICY = {"on_unknown_columns": "warn", "on_duplicates": "warn", "on_invalid_dates": "fail", "type_coercion_fail_threshold": 0,
          "null_threshold_required": 0.0}
RANGES = {"sales": {"min": 0}, "promo": {"allowed": [0, 1]}, "full_date": {"min_date": "2000-01-01"}}


def profiled(spark, contract, tmp_path, text, **changes):
    raw = files.read_raw_csv(spark, put(tmp_path, "p.csv", text)).coalesce(1)
    return raw, profile_policy.validate_profile(
        raw, contract.profile("train"), {**POLICY, **changes}, ["store_id", "full_date"], RANGES)


def test_profile_policies(spark, contract, tmp_path):
    _, clean = profiled(spark, contract, tmp_path, GOOD)
    assert clean["status"] == "PASS"
    bad_date = GOOD.replace("1,5,2015-07-31", "1,5,soon")
    _, fails = profiled(spark, contract, tmp_path, bad_date)
    assert fails["status"] == "FAIL"
    _, drops = profiled(spark, contract, tmp_path, bad_date, on_invalid_dates="drop", type_coercion_fail_threshold=1)
    assert drops["status"] == "PASS_WITH_WARNINGS" and drops["rows"] == 1
    twice = GOOD + "1,5,2015-07-31,1,1,1,1,0,1\n"
    raw, warned = profiled(spark, contract, tmp_path, twice)
    assert warned["status"] == "PASS_WITH_WARNINGS" and warned["rows"] == 3
    assert profiled(spark, contract, tmp_path, twice, on_duplicates="fail")[1]["status"] == "FAIL"
    raw, dropped = profiled(spark, contract, tmp_path, twice, on_duplicates="drop")
    assert dropped["rows"] == 2
    kept = profile_policy.cleaned_rows(raw, contract.profile("train"), {**POLICY, "on_duplicates": "drop"}, ["store_id", "full_date"])
    assert {(r["store_id"], r["sales"]) for r in kept.collect()} == {(1, 5263.0), (2, 6064.0)}
    extra = GOOD.replace("SchoolHoliday\n", "SchoolHoliday,X\n").replace(",0,1\n", ",0,1,7\n")
    assert profiled(spark, contract, tmp_path, extra)[1]["status"] == "PASS_WITH_WARNINGS"
    assert profiled(spark, contract, tmp_path, extra, on_unknown_columns="ignore")[1]["status"] == "PASS"
    assert profiled(spark, contract, tmp_path, extra, on_unknown_columns="fail")[1]["status"] == "FAIL"
    old = profiled(spark, contract, tmp_path, GOOD.replace("2015-07-31,5263", "1999-07-31,5263"))[1]
    assert old["status"] == "FAIL" and "min_date" in old["errors"][0]
    assert profile_policy.combined_report({"a": clean, "b": warned})["status"] == "PASS_WITH_WARNINGS"


def test_contract_checks_and_registry(spark):
    registry = contracts.load_registry(CONFIG / "contracts.yaml")
    assert contracts.find_version(registry, "retail_input_contract")["version"] == "v1"
    with pytest.raises(LookupError):
        contracts.find_contract(registry, "nope")
    schema = contracts.version_schema(contracts.find_version(registry, "retail_input_contract", "v1"), CONFIG)
    assert schema["train"]["required_columns"] == ["store_id", "day_of_week", "full_date", "sales"]
    assert contracts.registry_frame(spark, registry).where("is_latest").count() == 1
    for broken in (
        {}, {"contract_version": "1", "format": "xml"}, {"contract_version": "1", "format": "csv", "limits": {"max_rows": 0}},
        {"contract_version": "1", "format": "csv", "limits": {"max_rows": 1, "max_file_size_mb": 1}, "profiles": {}},
        {"contract_version": "1", "format": "csv", "limits": {"max_rows": 1, "max_file_size_mb": 1},
         "profiles": {"p": {"columns": [{"canonical_name": "a", "dtype": "blob"}]}}},
    ):
        with pytest.raises(ValueError):
            contracts.InputContract.parse(broken)
    with pytest.raises(ValueError):
        contracts.Rule.parse({"id": "r", "column": "a", "type": "between"}, "column")


def test_grid_csv_and_smoke_data(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"'), (2, None)], "id int, text string")
    sinks.write_grid_csv(df.coalesce(1), str(tmp_path / "g"))
    lines = sorted(line for p in (tmp_path / "g").glob("*.csv") for line in p.read_text().splitlines())
    assert lines == ['1,"a,""b"""', "2,", "id,text"]
    sales, stores = files.smoke_data(spark)
    assert sales.count() == 5000 and stores.count() == 10
    stats = sales.where("Open = 1").agg(F.min("Sales"), F.max("Sales")).first()
    assert 3000 <= stats[0] <= stats[1] <= 12000
    assert sales.where("DayOfWeek = 7 AND Sales > 0").count() == 0


def test_merge(spark, tmp_path):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, v int, x string")
    new = spark.createDataFrame([(2, 2, "c"), (3, 1, "d"), (3, 2, "e")], "id int, v int, x string")
    out = sinks.merge_to(old, new, ["id"], "v", str(tmp_path / "m"))
    assert {(r["id"], r["x"]) for r in out.collect()} == {(1, "a"), (2, "c"), (3, "e")}


def test_fact_folders_are_pruned(spark, tmp_path):
    from datetime import date

    from shelfscope.operators import warehouse

    sales, stores = files.smoke_data(spark)
    clean = warehouse.clean_sales(sales.select(*[F.col(c).cast("string").alias(c) for c in sales.columns]))
    fact = warehouse.build_fact(clean)
    sinks.reload_warehouse(fact, warehouse.clean_store(stores), warehouse.build_dim_date(clean), str(tmp_path / "w"))
    part = sinks.read_fact(spark, str(tmp_path / "w"), date(2013, 3, 10), date(2013, 4, 2))
    assert part.count() == 10 * 24
    scan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in scan
    names = {p.name for p in next((tmp_path / "w/versions").iterdir()).joinpath("fact_sales_daily").iterdir() if p.is_dir()}
    assert names == {"year=2013", "year=2014"}
    assert sinks.read_warehouse(spark, str(tmp_path / "w"))["fact_sales_daily"].count() == 5000


def test_text_survives_unified_csv(spark, tmp_path):
    texts = ['he said "x", y', "two\nlines", "comma, here", " spaced ", "\ufeffmark", 'end"']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    sinks.write_unified_csv(df, str(tmp_path / "u.csv"))
    back = files.read_raw_csv(spark, str(tmp_path / "u.csv"), multiline=True)
    assert {int(r["id"]): r["text"] for r in back.collect()} == dict(enumerate(texts))


def test_contract_without_limits(spark, contract, tmp_path):
    assert contract.max_rows is None and contract.max_file_size_mb is None
    assert check(spark, contract, put(tmp_path, "t.csv", GOOD))[0]["checks"]["row_limit"] == "PASS"


def test_failed_reload_keeps_the_old_version(spark, tmp_path):
    from shelfscope.operators import warehouse

    sales, stores = files.smoke_data(spark, stores=2, days=40)
    clean = warehouse.clean_sales(sales.select(*[F.col(c).cast("string").alias(c) for c in sales.columns]))
    fact, dims = warehouse.build_fact(clean), (warehouse.clean_store(stores), warehouse.build_dim_date(clean))
    sinks.reload_warehouse(fact, *dims, str(tmp_path / "w"))
    broken = fact.withColumn("open", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        sinks.reload_warehouse(broken, *dims, str(tmp_path / "w"))
    assert sinks.read_warehouse(spark, str(tmp_path / "w"))["fact_sales_daily"].count() == 80


def test_fact_does_not_sort_lines(spark, sf):
    from shelfscope.sources import tables

    plan = tables.fact_sales(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_whole_numbers_are_exact(spark):
    from shelfscope.functions.coerce import to_int

    rows = spark.createDataFrame([("9007199254740993",), ("5.0",), ("-7",), ("1e3",), ("x",), ("99999999999999999999",)], "t string")
    assert [r[0] for r in rows.select(to_int(F.col("t"))).collect()][:5] == [9007199254740993, 5, -7, 1000, None]


def test_csv_lines_come_back(spark):
    rows = [("a,b", ' "x" '), ("", None), ("NA", "line\nbreak"), (None, "é")]
    df = spark.createDataFrame(rows, "a string, `b c` string")
    back = files.parsed_lines(files.csv_lines(df), df.columns)
    assert back.columns == ["a", "b c"] and [tuple(r) for r in back.collect()] == [("a,b", ' "x" '), (None, None), (None, "line\nbreak"), (None, "é")]
    short = spark.createDataFrame([("1",), (None,)], "line string")
    assert [tuple(r) for r in files.parsed_lines(short, ["a", "b"]).collect()] == [("1", None), (None, None)]
