"""Fits do no work that their results don't need."""

from shelfscope.operators import intents, models


def test_regression_sees_only_buckets_that_rows_tell_apart(spark):
    words = {"sales": ["total sales", "sales report", "show sales"], "model": ["model accuracy", "which model", "model drift"]}
    rows = [(f"{t} {i}", label) for label, texts in words.items() for t in texts for i in range(12)]
    data = spark.createDataFrame(rows, "text string, label string")
    model, labels = intents.train_intents(data, max_iter=10)
    train = intents.with_train_mark(data).where("is_train").select(intents.word_grams(data["text"]).alias("grams"))
    grams = {g for r in train.collect() for g in r["grams"]}
    assert 0 < model.stages[-1].numFeatures <= len(grams)
    assert intents.intent_accuracy(data, model, labels).first()["accuracy"] > 0.95
    # A text of unknown grams only still gets its probabilities, from the intercepts.
    unknown = spark.createDataFrame([("zzzz",), (None,)], "message string")
    assert all(0 < r["confidence"] <= 1 for r in intents.predicted_intents(unknown.fillna(""), model, labels).collect())


def test_forests_keep_node_ids_and_start_first(spark, monkeypatch):
    rows = spark.createDataFrame([(float(i % 5), i % 4 == 0, [float(i), float(i % 5)]) for i in range(60)], "label double, is_validation boolean, x array<double>")
    rows = rows.select("label", "is_validation", models.array_to_vector("x").alias("features"))
    model = models.fit_family("forest", {"numTrees": 3, "maxDepth": 3}, rows)
    assert model.getCacheNodeIds() and model.getNumTrees == 3

    class Stop(Exception):
        pass

    asked = []

    def asked_first(family, params, rows, seed=42):
        asked.append(params.get("numTrees", 0))
        if len(asked) >= 3:
            raise Stop

    monkeypatch.setattr(models, "fit_family", asked_first)
    monkeypatch.setattr(models, "ridge", lambda *_: asked.append(0))
    monkeypatch.setattr(models, "modelling_rows", lambda *_: rows)
    monkeypatch.setattr(models, "fit_categories", lambda *_: {})
    monkeypatch.setattr(models, "with_split", lambda *_: rows)
    monkeypatch.setattr(models, "prediction_cap", lambda *_: spark.createDataFrame([(1.0,)], "cap double"))
    try:
        models.select_model(rows, parallel=1)
    except Stop:
        pass
    assert asked[:3] == [200, 100, 60]


def test_table_queries_size_their_tasks(spark, tmp_path):
    import __spark_entry__ as entry
    from shelfscope.session import SIZED_CONF, size_partitions

    size_partitions(spark, False)
    before = {key: spark.conf.get(key, None) for key in SIZED_CONF}
    # Rows of many stores and days, one a group, so that one task of a fixed few would hold them all.
    spark.range(300_000).selectExpr(
        "id AS l_suppkey", "timestamp'2020-01-01' + make_interval(0, 0, 0, cast(id % 100 AS int)) AS l_shipdate", "cast(id AS double) AS l_extendedprice",
        "0.05D AS l_discount", "3.0D AS l_quantity", "'A' AS l_returnflag", "'F' AS l_linestatus",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        out = entry.queries()["kpi_by_day_store"](spark, str(tmp_path))
        assert out.count() == 300_000 and out.rdd.getNumPartitions() > 1
        assert size_partitions(spark, False) is None
        assert {key: spark.conf.get(key, None) for key in SIZED_CONF} == before
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
        size_partitions(spark, True)
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "64m"
    finally:
        size_partitions(spark, False)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_character_counts_search_bytes(spark):
    from shelfscope.llm import quality_rules

    texts = ["a|b » c\t•d·e\n x #*$%&|<>", "", "\t \x0b\x0c\r\n", "ééé 🙂🙂 » ›\r\nshort line.", None, "##"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = quality_rules.quality_columns(docs)
    for r in found.collect():
        text = r["row"]["text"] or ""
        assert r["word_chars"] == sum(c not in quality_rules.SPACE for c in text)
        assert r["n_symbols"] == sum(c in quality_rules.SYMBOLS for c in text)
    assert "translate(" not in found._jdf.queryExecution().optimizedPlan().toString()
