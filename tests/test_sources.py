"""Scans and sinks on files."""

import json

import pytest
from pyspark.sql import functions as F

from sourcetrust.operators.trust import adaptive_trust
from sourcetrust.sources import flows, history, results

HEADER = "flow_id,Label,bytes\n"


@pytest.fixture
def folder(tmp_path):
    names = ["client_1_high_quality_mixed_a.csv", "client_2_compromised_mixed_b.csv", "mixed_a.csv", "plain.csv", "benign.csv", "mixed_test_set.csv"]
    for i, name in enumerate(names):
        (tmp_path / name).write_text(HEADER + f"f{i},BENIGN,{i}\n")
    return tmp_path


def names_of(df):
    return sorted(r[0] for r in df.select("source_name").distinct().collect())


def test_scan_and_preference(spark, folder):
    df = flows.scan_sources(spark, str(folder))
    assert df.count() == 6 and dict(df.dtypes)["bytes"] == "int"
    assert names_of(flows.prefer_sources(df)) == ["client_1_high_quality_mixed_a.csv", "client_2_compromised_mixed_b.csv"]
    without_tiers = df.filter(~F.col("source_name").startswith("client"))
    assert names_of(flows.prefer_sources(without_tiers)) == ["mixed_a.csv"]
    assert names_of(flows.prefer_sources(without_tiers.filter("source_name <> 'mixed_a.csv'"))) == ["plain.csv"]
    assert names_of(flows.benign_sources(df)) == ["benign.csv"]


def test_identity(spark, folder):
    ids = flows.identify_sources(flows.prefer_sources(flows.scan_sources(spark, str(folder)))).orderBy("ordinal").collect()
    assert [(r["client_id"], r["quality"]) for r in ids] == [
        ("client_1_client_1_high_quality_mixed_a", "high"), ("client_2_client_2_compromised_mixed_b", "compromised"),
    ]


def test_reserve(spark, folder):
    df = flows.scan_sources(spark, str(folder))
    reserved = flows.reserve_source(df)
    assert reserved.first()[0] == "mixed_test_set.csv"
    assert "mixed_test_set.csv" not in names_of(flows.training_sources(df, reserved))
    later = df.filter(~F.col("source_name").contains("mixed"))
    assert flows.reserve_source(later).first()[0] == "plain.csv"
    tiered = df.filter(F.col("source_name").startswith("client"))
    assert flows.reserve_source(tiered).first()[0] == "client_1_high_quality_mixed_a.csv"


def test_sources_with_different_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("label,x\n0,1.5\n")
    (tmp_path / "b.csv").write_text("label,y\n1,2.5\n")
    rows = flows.scan_mixed_sources(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert rows.columns == ["label", "source_name", "x", "y"]
    assert sorted((r["x"], r["y"]) for r in rows.collect()) == [(0.0, 2.5), (1.5, 0.0)]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_source_sink(spark, tmp_path, fmt):
    df = spark.range(100).select((F.col("id") % 3).cast("string").alias("client_id"), "id")
    results.write_sources(df, str(tmp_path / "out"), fmt)
    assert sorted(p.name for p in (tmp_path / "out").glob("client_id=*")) == [f"client_id={i}" for i in range(3)]
    back = spark.read.option("header", True).format(fmt).load(str(tmp_path / "out"))
    assert back.count() == 100


def test_history_table_and_resume(spark, tmp_path):
    observed = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.8), ("b", 1, 0.3)], "client_id string, round int, computed double")
    stored = history.with_metrics(adaptive_trust(observed), F.lit("2024-01-01"))
    path = str(tmp_path / "history")
    history.write_history(stored.filter("round < 2"), path)
    history.write_history(stored.filter("round = 2"), path)
    back = history.read_history(spark, path)
    assert back.count() == 5
    got = {r["client_id"]: (r["round"], round(r["trust"], 6)) for r in history.resume_point(back).collect()}
    assert got == {"a": (2, 0.87), "b": (1, 0.3)}


def test_documents_round_trip(spark, tmp_path):
    observed = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.8)], "client_id string, round int, computed double")
    stored = history.with_metrics(adaptive_trust(observed), F.concat(F.lit("t"), F.col("round").cast("string")))
    doc = json.loads(history.to_documents(stored).first()["document"])
    assert len(doc["performance_metrics"]) == len(doc["trust_scores"]) - 1 == 2
    assert doc["metadata"] == {"initial_trust": 0.5, "last_updated": "t2", "update_count": 2, "created_at": "t0"}
    history.write_documents(stored, str(tmp_path / "docs"))
    back = history.read_documents(spark, str(tmp_path / "docs")).orderBy("round").collect()
    want = stored.orderBy("round").collect()
    assert [(r["round"], r["trust"], r["ts"], r["metrics"]) for r in back] == [(r["round"], r["trust"], r["ts"], r["metrics"]) for r in want]


def test_result_files(spark, tmp_path):
    good = {"trust_aware": {"accuracy": 0.7, "f1_score": 0.8, "confusion_matrix": [[1, 2], [3, 4]]}, "federated": {"accuracy": 0.5}}
    (tmp_path / "experiment_results_1.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "experiment_results_2.json").write_text('{"trust_aware": {"accu')
    (tmp_path / "other.json").write_text(json.dumps(good))
    got = results.read_results(spark, str(tmp_path / "experiment_results*.json"))
    rows = sorted((r["file"], r["approach"], r["metric"], r["value"]) for r in got.collect())
    assert rows == [
        ("experiment_results_1.json", "federated", "accuracy", 0.5),
        ("experiment_results_1.json", "trust_aware", "accuracy", 0.7),
        ("experiment_results_1.json", "trust_aware", "f1_score", 0.8),
    ]
    results.write_results(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_logs(spark):
    log = "\n".join([
        "Accuracy   0.70±0.01  0.50±0.02  0.60±0.03", "Accuracy   0.99±0.01  0.99±0.02  0.99±0.03",
        "Approach 3: x", "Test Accuracy: 0.7312", "RESULTS COMPARISON", "Accuracy  0.1 0.2 0.3", "F1-Score  0.4 0.5 0.6", "Accuracy  0.7 0.8 0.9",
    ])
    df = spark.createDataFrame([(1, log), (2, "nothing")], "id int, log string")
    got = {(r["approach"], r["metric"]): (r["mean"], r["std"]) for r in results.trial_summaries(df, "log", ["id"]).collect()}
    assert got == {("centralized", "accuracy"): (0.7, 0.01), ("equal_weight", "accuracy"): (0.5, 0.02), ("trust_weighted", "accuracy"): (0.6, 0.03)}
    rows = {(r["approach"], r["metric"]): r["value"] for r in results.comparison_rows(df, "log", ["id"]).collect()}
    assert rows[("trust_weighted", "accuracy")] == 0.9 and rows[("centralized", "f1_score")] == 0.4
    assert [r[0] for r in df.orderBy("id").select(results.test_accuracy(F.col("log"))).collect()] == [0.7312, None]


def test_unwanted_files_are_not_scanned(spark, folder):
    df = flows.scan_preferred(spark, str(folder))
    assert sorted(f.rsplit("/", 1)[-1] for f in df.inputFiles()) == [
        "client_1_high_quality_mixed_a.csv", "client_2_compromised_mixed_b.csv"]
    assert names_of(df) == names_of(flows.prefer_sources(flows.scan_sources(spark, str(folder))))
    with pytest.raises(ValueError, match="no training source"):
        flows.scan_preferred(spark, str(folder / "benign.csv"))


def test_mixed_parquet_is_one_scan(spark, tmp_path):
    for name, rows, schema in (("a", [(1, 2.0)], "row_id int, x double"), ("b", [(2, 3.0)], "row_id int, y double")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    df = flows.scan_mixed_sources(spark, [str(tmp_path / "a"), str(tmp_path / "b")], "parquet")
    assert {(r["row_id"], r["x"], r["y"]) for r in df.collect()} == {(1, 2.0, 0.0), (2, 0.0, 3.0)}


def test_csv_files_with_headers_of_their_own(spark, tmp_path):
    """Quoted fields, repeated headers, rows too short or too long, an empty file; one plan for many files."""
    texts = {
        "a.csv": 'name,x,y\n"one, two",1,2\nshort,1\nname,x,y\n,3,\n', "b.csv": "y,z\n5,6\n7,8,9\n", "c.csv": "", "d.csv": "z\n4\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    rows = flows.scan_headed(spark, [str(tmp_path / "*.csv")])
    got = sorted(((r.source_name, r["name"], r.x, r.y, r.z, r.bad_row) for r in rows.collect() if not r.bad_row), key=str)
    assert got == sorted([("a.csv", "one, two", "1", "2", None, False), ("a.csv", None, "3", None, None, False),
                          ("b.csv", None, None, "5", "6", False), ("d.csv", None, None, None, "4", False)], key=str)
    assert rows.filter("bad_row").count() == 2
    united = flows.scan_mixed_sources(spark, [str(tmp_path / "*.csv")])
    assert {r.source_name: (r.y, r.z) for r in united.collect() if r.source_name != "a.csv"} == {"b.csv": (5.0, 6.0), "d.csv": (0.0, 4.0)}
    size = len(rows._jdf.queryExecution().optimizedPlan().toString())
    for i in range(30):
        (tmp_path / f"more{i}.csv").write_text("y,z\n1,2\n")
    more = flows.scan_headed(spark, [str(tmp_path / "*.csv")])
    assert more.count() == 36 and more.filter("source_name like 'more%'").count() == 30
    assert abs(len(more._jdf.queryExecution().optimizedPlan().toString()) - size) < 200


def test_trust_rows_of_logs(spark):
    from sourcetrust.sources import results

    far = "\n" * 16
    cases = [
        ("RESULTS COMPARISON\nTrust-Aware 0.1 0.2 0.3 0.4", 0.3, 0.1), ("x Metric Centralized\nTrust-Aware 0.5 0.6\nTrust-Aware is 0.7", 0.7, 0.5),
        ("Trust-Aware 0.9", None, 0.9), (f"RESULTS COMPARISON{far}Trust-Aware 0.9", None, 0.9),
        (f"RESULTS COMPARISON{far}Metric Centralized\n\nTrust-Aware: 0.8", 0.8, None), ("", None, None), (None, None, None),
    ]
    table = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, log string")
    got = table.select("i", results.trust_row(F.col("log")), results.trust_number(F.col("log"))).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == [c[1:] for c in cases]


def test_large_sources_are_divided_into_files(spark, tmp_path):
    """What one task of the writer sorts does not grow with its source, even where one task has read it all."""
    df = spark.range(0, 2100, 1, 1).select(F.when(F.col("id") < 2000, "large").when(F.col("id") < 2090, "small").alias("client_id"), "id")
    results.write_sources(df, str(tmp_path / "out"), "csv", rows_per_file=200)
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).withColumn("file", F.col("_metadata.file_path"))
    files = {r["client_id"]: (r["n"], r["files"], r["most"]) for r in back.groupBy("client_id", "file").count().groupBy("client_id").agg(
        F.sum("count").alias("n"), F.count("*").alias("files"), F.max("count").alias("most")).collect()}
    assert files["small"][:2] == (90, 1) and files[None][:2] == (10, 1)
    assert files["large"][0] == 2000 and files["large"][1] > 3 and files["large"][2] < 2000


def test_first_lines_of_files_need_no_sort(spark, tmp_path):
    """The first line of a file is found as its lines pass by, whatever stands in a batch."""
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"file_path": list(f), "_head": h}) for f, h in (
        ("aab", ["h1", "1", "h2"]), ("bb", ["2", "3"]), ("", []), ("bc", ["4", "h3"]))]
    batches[2] = batches[0].slice(0, 0)
    found = [tuple(r.values()) for b in flows._first_lines(iter(batches)) for r in b.to_pylist()]
    assert found == [("a", "h1"), ("b", "h2"), ("c", "h3")]
