"""Registered model and message queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscope.functions import text
from shelfscope.functions.text import keyword_intent, utterance_variants
from shelfscope.operators import features, forecast, intents, metrics, models, warehouse
from shelfscope.plans.oracle_tables import oracle
from shelfscope.plans.registry import Query, presented
from shelfscope.sources import tables
from shelfscope.sources.intents import parse_intents

DAY = "strftime({}, '%Y-%m-%d')"


def _frame(spark, sf):
    rows = tables.fact_sales(spark, sf).join(warehouse.store_meta(tables.dim_store(spark, sf)), "store_id")
    return features.training_frame(rows)


def _one_hot(spark, sf):
    """Category columns in model order for the stores, categories known from stores of even number only."""
    stores = warehouse.store_meta(tables.dim_store(spark, sf))
    known = models.fit_categories(stores.where("promo2 = 0"), ["assortment", "store_type"])
    hot = F.array(*[F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for c, vs in known.items() for v in vs])
    total = F.aggregate(hot, F.lit(0), lambda a, b: a + b)
    return presented(stores.select("store_id", total.alias("hot_columns"), F.size(hot).alias("num_columns")))


def _selection(spark, sf):
    chosen = _chosen(spark, sf)
    rows = [
        (name, name == chosen.best, *[float(m[k]) for k in ("mae", "rmse", "mape", "smape", "wape", "composite", "residual_std")])
        for name, m in chosen.metrics.items()
    ]
    return spark.createDataFrame(
        rows, "candidate string, is_selected boolean, mae double, rmse double, mape double, smape double, wape double, "
        "composite double, residual_std double")


_fitted: dict[tuple[str | None, str], models.Selection] = {}


def _chosen(spark, sf):
    """The selected model of a data set, fitted once an application."""
    key = (spark and spark.sparkContext.applicationId, sf)
    if key not in _fitted:
        _fitted[key] = models.select_model(_frame(spark, sf))
    return _fitted[key]


def _model_forecast(spark, sf):
    chosen = _chosen(spark, sf)
    inputs = forecast.forecast_inputs(tables.fact_sales(spark, sf), tables.dim_store(spark, sf))
    band = forecast.Band(chosen.residual_std, chosen.floor, chosen.cap)
    rows = forecast.recursive_forecast(
        forecast.with_controls(inputs, [forecast.Controls()]), chosen.scorer, 30, band)
    return presented(rows)


def _model_scenario(spark, sf):
    chosen = _chosen(spark, sf)
    band = forecast.Band(chosen.residual_std, chosen.floor, chosen.cap)
    points = forecast.run_scenario(
        tables.fact_sales(spark, sf), tables.dim_store(spark, sf), chosen.scorer, band, 30,
        forecast.Controls("scenario", "always_on", True, 0, 5.0), segment=forecast.Segment(promo2=1), price_change_pct=-2.0)
    return presented(forecast.segment_points(points))


def _importance(spark, sf):
    frame = _frame(spark, sf)
    chosen = _chosen(spark, sf)
    recent = metrics.with_split(frame, 90).where("is_validation")
    found = models.permutation_importance(recent, chosen.scorer, chosen.columns)
    return presented(found.orderBy(F.desc("mae_increase"), "feature").limit(20))


def _evaluation(spark, sf):
    """The trained model in its saved form, evaluated on the last days, overall and by store type."""
    frame = _frame(spark, sf)
    artifact = models.Artifact.of(_chosen(spark, sf))
    return presented(models.evaluate_saved(frame, artifact, 90))


def _labelled(spark, sf):
    """Utterances labelled by the lead sentence they were built with."""
    labels = F.array(*[F.lit(x) for x in (
        "forecast", "kpi_summary", "compare_stores", "top_stores", "promo_impact", "forecast_ar", "model_summary",
        "data_status", "help")])
    pick = ((F.col("conv_id") + F.col("turn")) % 9).cast("int")
    return tables.messages(spark, sf).select(F.col("message").alias("text"), F.get(labels, pick).alias("label"))


def _intent_model(spark, sf):
    rows = _labelled(spark, sf)
    model, labels = intents.train_intents(rows)
    return presented(intents.intent_accuracy(rows, model, labels))


def _slots(spark, sf):
    latest = tables.fact_sales(spark, sf).agg(F.max("full_date").alias("latest"))
    out = intents.with_slots(tables.messages(spark, sf), latest)
    return presented(out.drop("message"))


def _answers(spark, sf):
    fact = tables.fact_sales(spark, sf)
    # A stand-in for the model: sure of every third turn, unsure of the others, which go to the keywords.
    sure = F.col("turn") % 3 == 1
    rows = tables.messages(spark, sf).withColumns(
        {"predicted_intent": F.when(sure, "promo_impact"), "confidence": F.when(sure, 0.9).otherwise(0.1)}
    )
    rows = intents.with_slots(intents.resolved_intents(rows), fact.agg(F.max("full_date").alias("latest")))
    out = intents.answered(rows, fact, tables.dim_store(spark, sf))
    return presented(out.select(
        "conv_id", "turn", "intent", "store_slot", "date_from", "date_to", "total_sales", "total_customers",
        F.round("promo_uplift_pct", 4).alias("promo_uplift_pct"), "stores_count"))


def _variants(spark, sf):
    rows = tables.messages(spark, sf)
    return presented(rows.select("conv_id", "turn", F.explode(utterance_variants(F.col("message"))).alias("variant")))


def _intent_documents(spark, sf):
    rows = tables.messages(spark, sf)
    label = F.concat(F.lit("turn_"), F.col("turn").cast("string"))
    value = F.to_json(F.create_map(label, F.array(F.concat(F.lit(" "), F.col("message")), F.lit("  "), F.lower("message"))))
    return presented(parse_intents(rows.select(value.alias("value"))))


def _grams(spark, sf):
    rows = tables.messages(spark, sf)
    grams = F.array_sort(intents.word_grams(F.col("message")))
    return presented(rows.select("conv_id", "turn", F.size(grams).alias("num_grams"), F.md5(F.array_join(grams, "|")).alias("grams_md5")))


# The lists and patterns of functions/text.py in the SQL counterparts.
TERMS = {
    "greeting": text.GREETING_TERMS, "compare": text.COMPARE_TERMS, "system_summary": text.SYSTEM_TERMS, "data_status": text.STATUS_TERMS,
    "model_summary": text.MODEL_TERMS, "promo_impact": text.PROMO_TERMS, "forecast": text.FORECAST_TERMS, "kpi_summary": text.KPI_TERMS,
}


def _any(key: str) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in TERMS[key]) + ")"


INTENT = f"""CASE WHEN {_any('greeting')} THEN 'greeting'
    WHEN {_any('compare')} AND contains(t, 'store') THEN 'compare_stores'
    WHEN {_any('system_summary')} THEN 'system_summary' WHEN {_any('data_status')} THEN 'data_status'
    WHEN {_any('model_summary')} THEN 'model_summary'
    WHEN (contains(t, 'top') AND contains(t, 'store')) OR contains(t, '{text.TOP_STORES_TERM}') THEN 'top_stores'
    WHEN {_any('promo_impact')} THEN 'promo_impact' WHEN {_any('forecast')} THEN 'forecast'
    WHEN {_any('kpi_summary')} THEN 'kpi_summary' ELSE 'help' END"""
STORE_RE = text.STORE_PATTERN
HORIZON_RE = text.HORIZON_PATTERN.replace("(?iU)", "(?i)")  # DuckDB's patterns have no such flag
SLOTS = f"""slot AS (
    SELECT conv_id, turn, message, lower(message) AS t, TRY_CAST(regexp_extract(message, '{STORE_RE}', 1) AS BIGINT) AS store_slot,
           COALESCE(least(greatest(TRY_CAST(regexp_extract(message, '{HORIZON_RE}', 1) AS BIGINT), 1), 180), 30) AS horizon_days,
           regexp_extract_all(message, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1) AS ds,
           (SELECT MAX(full_date) FROM fact) AS latest FROM messages),
    rng AS (SELECT *, CASE WHEN len(ds) >= 2 THEN greatest(TRY_CAST(ds[1] AS DATE), TRY_CAST(ds[2] AS DATE))
                           WHEN len(ds) = 1 THEN TRY_CAST(ds[1] AS DATE) ELSE latest END AS d2 FROM slot),
    slots AS (SELECT *, CASE WHEN len(ds) >= 2 THEN least(TRY_CAST(ds[1] AS DATE), TRY_CAST(ds[2] AS DATE))
                             ELSE d2 - 29 END AS d1, CASE WHEN turn % 3 = 1 THEN 'promo_impact' ELSE {INTENT} END AS intent FROM rng)"""
SWAPS = [(word, other) for word, others in text.SYNONYMS.items() for other in others]
VARIANTS = ", ".join(
    ["message", "n", "l"] + [f"CASE WHEN contains(l, '{a}') THEN replace(l, '{a}', '{b}') END" for a, b in SWAPS]
    + [f"CASE WHEN contains(l, 'store ') AND NOT regexp_matches(l, 'store\\s+\\d+') THEN l || '{x}' END" for x in (" store 1", " store 25")]
    + [f"CASE WHEN contains(l, 'day') AND NOT regexp_matches(l, '\\d+\\s*(day|days|d)') THEN l || '{x}' END" for x in (" 30 days", " 90 days")])

QUERIES = [
    Query("one_hot_columns", "M-1", _one_hot, oracle("dim_store", """
        WITH k AS (SELECT DISTINCT 'a' AS f, assortment AS v FROM dim_store WHERE promo2 = 0
                   UNION ALL SELECT DISTINCT 't', store_type FROM dim_store WHERE promo2 = 0)
        SELECT store_id, CAST(assortment IN (SELECT v FROM k WHERE f = 'a') AS BIGINT)
                       + CAST(store_type IN (SELECT v FROM k WHERE f = 't') AS BIGINT) AS hot_columns,
               (SELECT COUNT(*) FROM k) AS num_columns FROM dim_store""")),
    Query("model_selection", "M-2 M-5 M-6 M-7 A-31 A-33 X-6", _selection),
    Query("model_evaluation", "M-10 A-30", _evaluation),
    Query("model_importance", "M-9", _importance),
    Query("forecast_model", "M-13 M-14", _model_forecast),
    Query("scenario_model_segment", "M-16", _model_scenario),
    Query("intent_keywords", "F-22", lambda s, d: presented(
        tables.messages(s, d).select("conv_id", "turn", keyword_intent(F.col("message")).alias("intent"))),
          oracle("messages", f"SELECT conv_id, turn, {INTENT} AS intent FROM (SELECT *, lower(message) AS t FROM messages)")),
    Query("text_slots", "F-21", _slots, oracle("fact messages", f"""WITH {SLOTS}
        SELECT conv_id, turn, store_slot, horizon_days, {DAY.format('d1')} AS date_from, {DAY.format('d2')} AS date_to
        FROM slots""")),
    Query("augment_utterances", "F-23", _variants, oracle("messages", f"""
        WITH n AS (SELECT *, regexp_replace(trim(message), '\\s+', ' ', 'g') AS n FROM messages),
        l AS (SELECT *, lower(n) AS l FROM n)
        SELECT conv_id, turn, unnest(list_distinct(list_filter([{VARIANTS}], lambda x: x <> ''))) AS variant FROM l""")),
    Query("intent_documents", "S-10", _intent_documents, oracle("messages", """
        SELECT trim(t) AS text, 'turn_' || turn AS label
        FROM (SELECT turn, unnest([' ' || message, '  ', lower(message)]) AS t FROM messages) WHERE trim(t) <> ''""")),
    Query("intent_grams", "M-18", _grams, oracle("messages", """
        WITH w AS (SELECT conv_id, turn, ' ' || x || ' ' AS p FROM (
                     SELECT conv_id, turn, unnest(regexp_split_to_array(lower(message), '\\s+')) AS x FROM messages)
                   WHERE x <> ''),
        g AS (SELECT conv_id, turn, unnest(list_concat(
                list_transform(range(1, greatest(length(p) - 2, 1) + 1), lambda i: substr(p, i, 3)),
                list_transform(range(1, length(p) - 2), lambda i: substr(p, i, 4)),
                list_transform(range(1, length(p) - 3), lambda i: substr(p, i, 5)))) AS gram FROM w),
        s AS (SELECT conv_id, turn, COUNT(*) AS c, string_agg(gram, '|' ORDER BY gram) AS grams FROM g GROUP BY 1, 2)
        SELECT m.conv_id, m.turn, COALESCE(c, 0) AS num_grams, md5(COALESCE(grams, '')) AS grams_md5
        FROM messages m LEFT JOIN s ON s.conv_id = m.conv_id AND s.turn = m.turn""")),
    Query("intent_model", "M-18", _intent_model),
    Query("intent_answers", "M-19", _answers, oracle("fact dim_store messages", f"""WITH {SLOTS},
        imp AS (SELECT store_id, CAST(SUM(CASE WHEN promo = 1 THEN sales END) AS DOUBLE) / COUNT(CASE WHEN promo = 1 THEN 1 END) AS p,
                       CAST(SUM(CASE WHEN promo <> 1 THEN sales END) AS DOUBLE) / COUNT(CASE WHEN promo <> 1 THEN 1 END) AS q
                FROM fact GROUP BY 1),
        tot AS (SELECT s.conv_id, s.turn, CAST(COALESCE(SUM(f.sales), 0) AS DOUBLE) AS total_sales,
                       CAST(COALESCE(SUM(f.customers), 0) AS BIGINT) AS total_customers
                FROM slots s LEFT JOIN fact f ON f.full_date BETWEEN s.d1 AND s.d2
                  AND (s.store_slot IS NULL OR s.store_slot = f.store_id)
                WHERE s.intent = 'kpi_summary' GROUP BY 1, 2)
        SELECT s.conv_id, s.turn, s.intent, s.store_slot, {DAY.format('d1')} AS date_from, {DAY.format('d2')} AS date_to,
               tot.total_sales, tot.total_customers,
               CASE WHEN s.intent = 'promo_impact' THEN ROUND(CASE WHEN s.store_slot IS NULL
                      THEN (SELECT (AVG(p) - AVG(q)) / AVG(q) * 100 FROM imp) ELSE (p - q) / q * 100 END, 4) END AS promo_uplift_pct,
               CASE WHEN s.intent = 'system_summary' THEN (SELECT COUNT(*) FROM dim_store) END AS stores_count
        FROM slots s LEFT JOIN tot ON tot.conv_id = s.conv_id AND tot.turn = s.turn
        LEFT JOIN imp ON imp.store_id = s.store_slot""")),
]
