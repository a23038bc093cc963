"""Features, models, forecasts and intents against plain NumPy and pandas answers."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfscope.functions.text import keyword_intent, utterance_variants
from shelfscope.operators import features, forecast, intents, kpi, metrics, models, warehouse
from shelfscope.operators.grid import checked_store_ids
from shelfscope.operators.scorers import LinearScorer, MeanScorer


@pytest.fixture(scope="module")
def daily(spark):
    """Three stores, 430 days, two decimals, with a gap and a zero stretch."""
    rng = np.random.default_rng(7)
    rows = []
    for store in (1, 2, 3):
        for i in range(430):
            if store == 2 and 100 <= i < 104:
                continue
            sales = 0.0 if store == 3 and i < 40 else float(np.round(500 + 90 * store + 60 * np.sin(i / 7) + rng.normal(0, 20), 2))
            rows.append((store, date(2020, 1, 1) + timedelta(days=i), sales, int(i % 3 == 0), 0, 1, "0", "ab"[store % 2], "c", 120.0 * store, store % 2))
    names = "store_id full_date sales promo school_holiday open state_holiday store_type assortment competition_distance promo2".split()
    return pd.DataFrame(rows, columns=names)


@pytest.fixture(scope="module")
def frame(spark, daily):
    schema = ("store_id long, full_date date, sales double, promo int, school_holiday int, open int, state_holiday string, "
              "store_type string, assortment string, competition_distance double, promo2 int")
    df = spark.createDataFrame(daily, schema).withColumn("sales", F.col("sales").cast("decimal(14,2)"))
    return df.repartition(4)


def pandas_features(daily):
    out = daily.sort_values(["store_id", "full_date"]).copy()
    g = out.groupby("store_id")["sales"]
    for k in (1, 3, 7, 14, 21, 28, 364):
        out[f"lag_{k}"] = g.shift(k)
    for w in (7, 14, 28, 56):
        out[f"rolling_mean_{w}"] = g.transform(lambda s, w=w: s.shift(1).rolling(w, min_periods=1).mean())
        out[f"rolling_std_{w}"] = g.transform(lambda s, w=w: s.shift(1).rolling(w, min_periods=2).std()).fillna(0.0)
    out["lag_364"] = out["lag_364"].fillna(out["rolling_mean_28"])
    for w in (7, 14):
        out[f"promo_density_{w}"] = out.groupby("store_id")["promo"].transform(lambda s, w=w: s.shift(1).rolling(w, min_periods=1).mean())
    m7, m28 = (out[f"rolling_mean_{w}"].replace(0, np.nan) for w in (7, 28))
    out["lag_1_to_mean_7_ratio"] = (out["lag_1"] / m7).fillna(1.0)
    out["sales_velocity"] = (out["rolling_mean_7"] / m28).fillna(1.0)
    out["lag_364_to_mean_28_ratio"] = (out["lag_364"] / m28).fillna(1.0)
    return out


def test_series_features(frame, daily):
    want = pandas_features(daily).reset_index(drop=True)
    got = features.with_series_features(frame).toPandas().sort_values(["store_id", "full_date"]).reset_index(drop=True)
    for name in [c for c in want.columns if c.startswith(("lag", "rolling", "promo_d", "sales_v"))]:
        a, b = got[name].to_numpy(float), want[name].to_numpy(float)
        assert np.array_equal(np.isnan(a), np.isnan(b)), name
        assert np.allclose(a, b, rtol=1e-6, atol=1e-6, equal_nan=True), name
    kept = features.training_frame(frame)
    assert kept.count() == len(want.dropna(subset=["lag_28"]))


def test_one_shuffle_for_all_features(frame):
    plan = features.with_series_features(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(store_id") == 1


def test_iso_week(spark):
    day = features.with_calendar(spark.sql("SELECT date'2021-01-03' AS full_date")).first()
    assert (day["week_of_year"], day["day_of_week"], day["is_weekend"], day["is_month_start"]) == (53, 7, 1, 1)


def test_metrics(spark):
    y, p = np.array([0.0, 1.0, 10.0, 200.0]), np.array([1.0, 1.5, 8.0, 230.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    row = metrics.evaluate(df, "y", "p").first()
    e = np.abs(y - p)
    assert row["mae"] == pytest.approx(e.mean()) and row["rmse"] == pytest.approx(np.sqrt((e**2).mean()))
    assert row["mape"] == pytest.approx((e / np.maximum(y, 1)).mean() * 100)
    assert row["mape_nonzero"] == pytest.approx((e[2:] / y[2:]).mean() * 100)
    assert row["wape"] == pytest.approx(e.sum() / y.sum() * 100)
    assert row["residual_std"] == pytest.approx(np.std(y - p))
    small = metrics.evaluate(df.where("y <= 1"), "y", "p").first()
    assert small["mape_nonzero"] is None


@pytest.fixture(scope="module")
def selection(frame):
    return models.select_model(features.training_frame(frame), validation_days=60, grids=models.SMOKE_GRIDS)


def test_ridge_is_the_closed_form(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)) * [1, 10, 0.1, 3, 50]
    y = x @ [1.0, -0.2, 5.0, 0.0, 0.01] + 2 + rng.normal(size=400)
    rows = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "x array<double>, label double")
    model = models.ridge(rows.select(array_to_vector("x").alias("features"), "label"))
    xc, yc = x - x.mean(axis=0), y - y.mean()
    beta = np.linalg.solve(xc.T @ xc + np.eye(5), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), beta, atol=1e-8)
    assert model.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ beta)


def test_exported_models_score_alike(frame, selection):
    marked = metrics.with_split(features.training_frame(frame), 60)
    rows = models.modelling_rows(marked, selection.columns).where("is_validation")
    for c in selection.candidates:
        got = c.model.transform(rows).select("features", "prediction").collect()
        scorer = models.scorer_of(c.family, c.model, selection.columns)
        x = np.array([r[0].toArray() for r in got])
        assert np.allclose(scorer.predict(x), [r[1] for r in got], atol=1e-9), c.name
    assert selection.best in selection.metrics and selection.metrics[selection.best]["composite"] == min(
        m["composite"] for m in selection.metrics.values())
    assert len(selection.importance) == 20


def test_artifact_round_trip(spark, frame, selection, tmp_path):
    artifact = models.Artifact.of(selection)
    models.save_artifact(spark, artifact, str(tmp_path / "model"))
    again = models.load_artifact(spark, str(tmp_path / "model"))
    rows = models.evaluate_saved(features.training_frame(frame), again, 60)
    overall = rows.where("store_type IS NULL").first()
    assert overall["wape"] == pytest.approx(selection.metrics[selection.best]["wape"])
    assert rows.count() == 3
    back = models.back_windows(features.training_frame(frame), again.scorer, again.columns, 60, 30, 2).collect()
    assert [r["num_rows"] for r in back] == [90, 90]
    refit = models.refit_windows(features.training_frame(frame), 60, 30, 2)
    assert len(refit) == 2 and all(r["wape"] > 0 for r in refit)
    rise = models.permutation_importance(features.training_frame(frame), again.scorer, again.columns, ["lag_7", "promo2"])
    assert {r["feature"] for r in rise.collect()} == {"lag_7", "promo2"}


# Forecasts -------------------------------------------------------------------------------------------


def fact_of(frame):
    return frame.select("store_id", "full_date", "sales", "promo", "school_holiday", "open", "state_holiday")


def stores_of(frame):
    return frame.select("store_id", "store_type", "assortment", "competition_distance", "promo2").distinct()


def test_first_step_features_equal_training_features(spark, frame, daily):
    """The next day's serving features are what training computes for a row appended to the series."""
    inputs = forecast.with_controls(forecast.forecast_inputs(fact_of(frame), stores_of(frame)), [forecast.Controls()]).toPandas().sort_values("store_id")
    inputs = inputs.reset_index(drop=True)
    sales, promo = forecast.History(inputs["sales"], 1), forecast.History(inputs["promo"], 1)
    next_day = pd.to_datetime(inputs["last_date"]) + timedelta(days=1)
    got = forecast.step_features(inputs, sales, promo, next_day, sales.count - 1, 1, ddof=1)
    more = daily.groupby("store_id").tail(1).assign(full_date=lambda d: d["full_date"] + timedelta(days=1))
    want = pandas_features(pd.concat([daily, more])).groupby("store_id").tail(1)
    for name in [c for c in want.columns if c.startswith(("lag", "rolling", "promo_d", "sales_v"))]:
        assert np.allclose(got[name], want[name].to_numpy(float)), name


def loop_forecast(history, horizon, cap):
    """Mean of the last seven values, one store, one day at a time."""
    values, out = list(history), []
    for _ in range(horizon):
        values.append(min(max(float(np.mean(values[-7:])), 0.0), cap))
        out.append(values[-1])
    return out


def test_recursive_forecast(frame, daily):
    inputs = forecast.with_controls(forecast.forecast_inputs(fact_of(frame), stores_of(frame)), [forecast.Controls()])
    got = forecast.recursive_forecast(inputs, MeanScorer(), 45, forecast.Band(10.0, cap=680.0)).toPandas()
    for store, rows in got.groupby("store_id"):
        rows = rows.sort_values("step")
        want = loop_forecast(daily[daily["store_id"] == store]["sales"], 45, 680.0)
        assert np.allclose(rows["predicted_sales"], want)
        assert (rows["predicted_lower"] <= rows["predicted_sales"]).all() and (rows["predicted_upper"] <= 680.0).all()
    with pytest.raises(ValueError):
        forecast.recursive_forecast(inputs, MeanScorer(), 181, forecast.Band(1.0), max_horizon=180)
    with pytest.raises(ValueError):
        forecast.recursive_forecast(inputs, MeanScorer(), 0, forecast.Band(1.0))
    assert forecast.recursive_forecast(inputs, MeanScorer(), 181, forecast.Band(1.0)).where("step = 181").count() == got["store_id"].nunique()


def test_short_history():
    h = forecast.History(pd.Series([[5.0], [1.0, 2.0, 3.0]]), 2)
    assert list(h.lag(1)) == [5.0, 3.0] and list(h.lag(3)) == [5.0, 1.0] and list(h.lag(28)) == [5.0, 3.0]
    assert list(h.mean(7)) == [5.0, 2.0] and list(h.mean(2)) == [5.0, 2.5]
    assert list(h.std(7, 0)) == [0.0, pytest.approx(np.std([1, 2, 3]))]
    h.append(np.array([7.0, 4.0]))
    assert list(h.mean(2)) == [6.0, 3.5] and list(h.lag(2)) == [5.0, 3.0]


def test_summaries_and_scenario(spark):
    rows = [(s, sc, i + 1, date(2024, 1, 1) + timedelta(days=i), base * k, base * k * 0.9, base * k * 1.1)
            for s in (1, 2) for i in range(2) for base in [s * 10.0 + i] for sc, k in (("baseline", 1.0), ("scenario", 1.1))]
    df = spark.createDataFrame(rows, forecast.FORECAST_SCHEMA)
    points = forecast.scenario_points(df, "scenario")
    total = forecast.scenario_summary(forecast.segment_points(points)).first()
    assert total["total_baseline_sales"] == 62.0 and total["uplift_pct"] == pytest.approx(10.0)
    assert str(total["max_delta_date"]) == "2024-01-02"
    one = forecast.store_forecast_summary(df.where("scenario_id = 'baseline'")).where("store_id = 1").first()
    assert (one["total_predicted_sales"], one["peak_sales"], str(one["peak_date"])) == (21.0, 11.0, "2024-01-02")
    tied = df.withColumn("predicted_sales", F.lit(1.0)).where("scenario_id = 'baseline'")
    assert str(forecast.store_forecast_summary(tied).first()["peak_date"]) == "2024-01-01"
    assert forecast.portfolio_summary(df).where("scenario_id = 'baseline'").first()["stores_count"] == 2


def test_scenario_targets(frame):
    args = (fact_of(frame), stores_of(frame), MeanScorer(), forecast.Band(1.0), 3, forecast.Controls(demand_shift_pct=10.0))
    one = forecast.run_scenario(*args, store_id=2)
    assert {r["store_id"] for r in one.collect()} == {2}
    some = forecast.run_scenario(*args, segment=forecast.Segment(store_type="B"), price_change_pct=10.0).collect()
    assert {r["store_id"] for r in some} == {1, 3} and all(abs(r["delta_sales"]) < 1e-9 for r in some)
    for bad in ({}, {"store_id": 1, "segment": forecast.Segment()}):
        with pytest.raises(ValueError):
            forecast.run_scenario(*args, **bad)
    assert checked_store_ids([3, 1, 3]) == [3, 1]
    assert len(checked_store_ids(list(range(1, 60)))) == 59
    for bad, most in (([], None), ([0], None), ([1, 2, 3], 2)):
        with pytest.raises(ValueError):
            checked_store_ids(bad, most)


def test_promo_modes_follow_the_model(spark, frame):
    scorer = LinearScorer(["promo", "open"], np.array([2.0, 1.0]), 5.0, log_target=False)
    sets = [forecast.Controls(), forecast.Controls("on", "always_on"), forecast.Controls("weekend", "weekends_only", False)]
    rows = forecast.recursive_forecast(
        forecast.with_controls(forecast.forecast_inputs(fact_of(frame), stores_of(frame)), sets), scorer, 7, forecast.Band(1.0))
    for r in rows.collect():
        weekend = r["date"].isoweekday() >= 6
        want = {"baseline": 6.0, "on": 8.0, "weekend": 7.0 if weekend else 6.0}[r["scenario_id"]]
        assert r["predicted_sales"] == pytest.approx(want)


# KPIs and intents ------------------------------------------------------------------------------------


def test_dense_rank_spread_over_tasks(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(700)) - 100).cast("decimal(14,2)").alias("v"))
    got = {r["id"]: r["r"] for r in kpi.with_dense_rank(df, "v", "r").collect()}
    order = {v: i + 1 for i, v in enumerate(sorted({r["v"] for r in df.collect()}, reverse=True))}
    assert got == {r["id"]: order[r["v"]] for r in df.collect()}


def test_store_without_facts(spark, frame):
    stores = stores_of(frame).unionByName(spark.createDataFrame([(9, "z", "z", None, 0)], "store_id long, store_type string, assortment string, competition_distance double, promo2 int"))
    fact = warehouse.build_fact(fact_of(frame).withColumn("customers", F.lit(1)))
    row = kpi.store_comparison(stores, fact).where("store_id = 9").first()
    assert (row["total_open_days"], row["total_promo_days"], float(row["total_sales"]), row["avg_promo_sales"]) == (1, 0, 0.0, None)
    windowed = kpi.store_comparison_window(stores, fact, [1, 9], date(2020, 1, 1), date(2020, 1, 31))
    assert windowed.where("store_id = 1").first()["open_days"] == 31
    legacy = kpi.store_comparison_window(stores, fact, [1], date(2020, 1, 1), date(2020, 1, 31), legacy=True)
    assert legacy.first()["open_days"] == 430


def test_hot_store_reaches_the_shuffle_as_one_row_per_day(spark):
    lines = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500 + 2).alias("store_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("full_date"),
        F.lit(1.25).alias("sales"), F.lit(1).alias("customers"), F.lit(0).alias("promo"), F.lit("0").alias("state_holiday"),
        F.lit(0).alias("school_holiday"), F.lit(1).alias("open"))
    fact = warehouse.build_fact(lines)
    assert fact.where("store_id = 1").agg(F.sum("sales")).first()[0] == 12500
    assert "partial_sum" in fact._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text,intent", [
    ("hello there", "greeting"), ("compare store 1 vs store 2", "compare_stores"), ("data coverage", "system_summary"),
    ("last update of the pipeline", "data_status"), ("model accuracy", "model_summary"), ("top 5 stores", "top_stores"),
    ("promo effect", "promo_impact"), ("توقع المتجر 3", "forecast"), ("revenue", "kpi_summary"), ("zzz", "help")])
def test_keywords(spark, text, intent):
    assert spark.range(1).select(keyword_intent(F.lit(text))).first()[0] == intent


def test_grams_and_variants(spark):
    got = spark.range(1).select(intents.word_grams(F.lit("Ab  abcd"))).first()[0]
    assert sorted(got) == sorted([" ab", "ab ", " ab ", " ab", "abc", "bcd", "cd ", " abc", "abcd", "bcd ", " abcd", "abcd "])
    variants = set(spark.range(1).select(utterance_variants(F.lit("Forecast  store sales"))).first()[0])
    assert variants == {
        "Forecast  store sales", "Forecast store sales", "forecast store sales", "predict store sales", "projection store sales",
        "forecast store revenue", "forecast branch sales", "forecast store sales store 1", "forecast store sales store 25"}


def test_intent_model(spark):
    words = {"sales": ["total sales", "sales report", "show sales", "sales of store 2"], "model": ["model accuracy", "which model", "model drift", "model error"]}
    rows = [(f"{t} {i}", label) for label, texts in words.items() for t in texts for i in range(12)]
    data = spark.createDataFrame(rows, "text string, label string")
    model, labels = intents.train_intents(data, max_iter=20)
    assert labels == ["model", "sales"]
    assert intents.intent_accuracy(data, model, labels).first()["accuracy"] > 0.95
    asked = spark.createDataFrame([("please show sales",), ("",)], "message string")
    out = intents.resolved_intents(intents.predicted_intents(asked, model, labels), threshold=0.6).collect()
    assert out[0]["intent"] == "sales" and out[0]["confidence"] >= 0.6
    assert out[1]["intent"] == "help" and out[1]["confidence"] is None


def test_importance_does_not_depend_on_batches(spark, frame):
    scorer = LinearScorer(["promo", "open"], np.array([2.0, 1.0]), 5.0, log_target=False)
    found = []
    for limit, parts in (("10000", 2), ("7", 5)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
        rows = models.permutation_importance(frame.repartition(parts), scorer, ["promo", "open"]).collect()
        found.append({r["feature"]: round(r["mae_increase"], 6) for r in rows})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and set(found[0]) == {"promo", "open"}
