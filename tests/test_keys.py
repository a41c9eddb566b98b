"""Row keys that are unique within a source only, and other cases found in review."""

import pytest
from pyspark.sql import functions as F

from sourcetrust.operators import clean, joins, metrics, perturb, sample, trust
from sourcetrust.sources import flows, history


@pytest.fixture(scope="module")
def twice(spark):
    """Two sources of 1,000 rows that share their keys."""
    rows = spark.range(2000).select(
        F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("client_id"),
        F.floor(F.col("id") / 2).cast("string").alias("row_id"),
        (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("x"),
    )
    return rows.withColumn("quality", F.lit("low")).withColumn("split", F.when(F.col("x") < 2, "val").otherwise("train"))


def test_repeated_keys_do_not_multiply_rows(twice):
    worse = perturb.flip_random(twice, 0.3).drop("flipped")
    for ratio in (0.4, 1.0):
        better = perturb.restore(worse, twice, ["x"], ratio)
        assert better.count() == 2000
    assert perturb.restore(worse, twice, ["x"], 1.0).drop("restored").exceptAll(twice).isEmpty()
    validation = sample.clean_validation(worse, twice, ["label"])
    assert validation.count() == twice.filter("split = 'val'").count()
    joined = metrics.join_predictions(twice.select("client_id", "row_id"), twice.select("client_id", "row_id", "label"))
    assert joined.count() == 2000


def test_repeated_keys_are_drawn_each(twice):
    assert sample.class_ratio_sample(twice, 101).count() == 101
    added = sample.mix_benign(twice.filter("client_id = 's0' AND label = 1"), twice.withColumn("label", F.lit(0)), 0.8)
    assert added.filter("mixed_in").count() == 4 * twice.filter("client_id = 's0' AND label = 1").count()


def test_union_leaves_labels_and_identifiers_null(spark):
    left = spark.createDataFrame([(1, 2.0, None, None)], "row_id int, a double, label int, src_port int")
    right = spark.createDataFrame([(2, 3.0)], "row_id int, b double")
    rows = {r["row_id"]: r.asDict() for r in clean.union_sources([left, right], ["row_id"]).collect()}
    assert rows[1] == {"row_id": 1, "a": 2.0, "b": 0.0, "label": None, "src_port": None}
    assert rows[2]["label"] is None and rows[2]["a"] == 0.0


def test_lone_source_is_not_reserved(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "source_name string")
    assert flows.reserve_source(names("only.csv", "only.csv")).count() == 0
    assert flows.reserve_source(names("a.csv", "b.csv")).first()[0] == "b.csv"
    assert flows.reserve_source(names("mixed_a.csv", "b.csv")).first()[0] == "mixed_a.csv"


def test_join_with_a_map_column_beyond_the_broadcast(spark):
    rows = spark.createDataFrame([("a", {"k": 1}), ("b", {"k": 2})], "client_id string, m map<string,int>")
    table = joins.sized(spark.createDataFrame([("a", 1)], "client_id string, v int"))
    got = {r["client_id"]: r["v"] for r in joins.lookup_join(rows, table, ["client_id"], max_cells=0).collect()}
    assert got == {"a": 1, "b": None}


def test_score_reads_all_features(spark):
    names = [f"f{i}" for i in range(25)]
    rows = [("s", str(i), 0, *[0.0] * 24, 100.0 if i == 7 else float(i % 2)) for i in range(40)]
    schema = "client_id string, row_id string, label int, " + ", ".join(f"{n} double" for n in names)
    got = perturb.flip_adversarial(spark.createDataFrame(rows, schema), 1 / 40, names)
    assert [r["row_id"] for r in got.filter("flipped").collect()] == ["7"]


def test_resumed_history_is_the_history(spark):
    rows = [(c, r, ((r * 37 + len(c) * 11) % 90) / 100) for c in ("a", "bb") for r in range(1, 8)]
    observed = spark.createDataFrame([*rows, ("late", 6, 0.9)], "client_id string, round int, computed double")
    whole = trust.adaptive_trust(observed)
    stored = trust.adaptive_trust(observed.filter("round <= 4"))
    assert trust.adaptive_trust(observed, stored=stored).exceptAll(whole).isEmpty()
    assert trust.adaptive_trust(observed, stored=stored).count() == whole.count()


def test_documents_are_replaced_per_source(spark, tmp_path):
    columns = "client_id string, round int, trust double, ts string, event string, metrics struct<f1_score: double>"
    first = spark.createDataFrame([("a", 0, 0.5, "t", "initial", None), ("b", 0, 0.5, "t", "initial", None)], columns)
    again = spark.createDataFrame([("b", 0, 0.7, "t", "initial", None)], columns)
    path = str(tmp_path / "documents")
    for table in (first, again, again):
        history.write_documents(table, path)
    rows = spark.read.text(path).select("source", F.get_json_object("value", "$.trust_scores[0]").alias("t")).collect()
    assert {r["source"]: r["t"] for r in rows} == {"a": "0.5", "b": "0.7"} and len(rows) == 2
