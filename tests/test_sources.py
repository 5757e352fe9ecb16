"""Sources and sinks: CSV null rules, optional telemetry, scalar projection, documents, history tables."""

import os

from pyspark.sql import functions as F

from pitlane import schemas as S
from pitlane.sinks import history as H
from pitlane.sinks.results import read_json_document, write_json_document
from pitlane.sources.laps import read_laps_csv
from pitlane.sources.telemetry import read_telemetry_csv, scalar_columns


def test_csv_null_spellings(spark, tmp_path):
    header = ",".join(h for h, _, _ in S.LAP_COLUMNS)
    rows = [
        "VER,Monaco Grand Prix,2024,1,1,3,80.5,10,SOFT,0.1,0.2,0.5,1.0,1,9,0",
        "VER,NA,2024,2,1,3,NaN,NA,null,,0.2,0.5,1.0,,,",
    ]
    p = tmp_path / "laps.csv"
    p.write_text(header + "\n" + "\n".join(rows) + "\n")
    df = read_laps_csv(spark, str(p)).orderBy("lap_number").collect()
    assert df[0]["lap_time_s"] == 80.5 and df[0]["compound"] == "SOFT"
    r = df[1]
    assert r["race"] is None and r["lap_time_s"] is None and r["tyre_life"] is None and r["compound"] is None
    assert r["row_key"] and r["row_key"] != df[0]["row_key"]


def test_missing_telemetry_is_empty(spark):
    df = read_telemetry_csv(spark, "/nonexistent/telemetry.csv")
    assert df.count() == 0 and df.columns == [n for _, n, _ in S.TELEMETRY_COLUMNS]


def test_scalar_columns_from_schema(spark):
    df = spark.createDataFrame([(1, [1.0], {"a": 1}, (1,), "x")], "a int, b array<double>, c map<string,int>, "
                                                                  "d struct<x:int>, e string")
    assert scalar_columns(df).columns == ["a", "e"]


def test_documents_round_trip_and_missing(spark, tmp_path):
    p = str(tmp_path / "doc")
    write_json_document(spark, {"a": 1, "b": {"c": [1, 2]}, "s": "CRÍTICO"}, p)
    assert read_json_document(spark, p) == {"a": 1, "b": {"c": [1, 2]}, "s": "CRÍTICO"}
    assert read_json_document(spark, str(tmp_path / "none")) is None
    bad = tmp_path / "bad.json"
    bad.write_text("{not json")
    assert read_json_document(spark, str(bad)) is None


def test_history_append_is_idempotent_per_batch(spark, tmp_path):
    base = str(tmp_path / "hist")
    payload = spark.createDataFrame([("k1", "CRÍTICO", "t", "d"), ("k2", "CRÍTICO", "t2", "d2")],
                                    "row_key string, severity string, title string, description string")
    rows = H.history_rows(payload, "alert_history", F.col("row_key"), F.current_timestamp())
    H.append(rows, base, "alert_history", batch_id=0)
    H.append(rows, base, "alert_history", batch_id=0)  # replay of the same batch
    H.append(rows, base, "alert_history", batch_id=1)
    t = spark.read.parquet(os.path.join(base, "alert_history"))
    assert t.count() == 4
    recent = H.recent(t.drop("batch_id"), 3).collect()
    assert len(recent) == 3 and set(recent[0].asDict()) == {"id", "severity", "title", "description", "timestamp"}


def test_init_tables(spark, tmp_path):
    base = str(tmp_path / "h")
    H.init_tables(spark, base)
    for t in S.HISTORY_TABLES:
        assert H.read_table(spark, base, t).count() == 0


def test_scalar_export_reports_rows(spark, tmp_path):
    from pitlane.sinks.results import export_scalar_csv

    df = spark.createDataFrame([(1, [1.0], "a"), (2, [2.0], "b")], "a int, v array<double>, s string")
    info = export_scalar_csv(df, str(tmp_path / "out"))
    assert info == {"rows": 2, "columns": ["a", "s"]}


def test_provenance_precedence(spark):
    from pitlane.plans.registry import provenance_union, resolve_provenance

    docs = {"regression": spark.createDataFrame([(0.5,)], "r2 double"),
            "svm": spark.createDataFrame([(1.0, "cloud")], "best_recall double, source string")}
    u = {r["model"]: r for r in provenance_union(docs).collect()}
    assert u["regression"]["metric"] == 0.5 and u["regression"]["source"] == "local"
    assert u["svm"]["metric"] == 1.0 and u["svm"]["source"] == "cloud"
    cand = spark.createDataFrame(
        [("regression", "legacy", None, 0.1, None, 2), ("regression", "local", None, 0.5, None, 1),
         ("svm", "consolidated", None, 0.9, "r1", 0)],
        "model string, source string, trained_at timestamp, metric double, run_id string, priority int")
    best = {r["model"]: r["source"] for r in resolve_provenance(cand).collect()}
    assert best == {"regression": "local", "svm": "consolidated"}


def test_text_helpers(spark):
    from pitlane.functions.carstate import gap_text, interpretation, lap_event_log

    df = spark.createDataFrame([(0.5, -0.0001, 42, "Stint estable (HARD)", 15.29, None)],
                               "g double, h double, lap int, lab string, t double, d double")
    r = df.select(gap_text("g", "+").alias("a"), gap_text("h", "-").alias("b"), lap_event_log("lap").alias("log"),
                  interpretation("lap", "lab", "t", "d").alias("txt")).first()
    assert r["a"] == "+0.5s" and r["b"] == "-0.001s"
    assert r["log"][0]["time"] == "LAP 42" and len(r["log"]) == 1
    assert r["txt"].startswith("Vuelta 42: perfil 'Stint estable (HARD)'") and "15.29" in r["txt"] and "N/A" in r["txt"]


def test_real_vs_predicted(spark):
    from pitlane.operators.evaluate import real_vs_predicted

    df = spark.range(100).selectExpr("cast(id as string) as row_key", "id * 1.0 as y", "id * 2.0 as p")
    head, diag = real_vs_predicted(df, "y", "p")
    assert head.count() == 60
    d = diag.first()
    assert d["lo"] == 0.0 and d["hi"] == 198.0


def test_or_default(spark):
    from pitlane.functions.numeric import or_default

    vals = [r[0] for r in spark.createDataFrame([(0.0,), (None,), (2.0,)], "x double").select(
        or_default("x", 1.0)).collect()]
    assert vals == [1.0, 1.0, 2.0]


def test_checkpoint_folder_is_kept(spark):
    from pitlane.session import ensure_checkpoint_dir, scratch_path

    first = ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(spark) == first == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(first)


def test_bench_times_every_lap_query():
    import bench
    from pitlane.plans.catalog import QUERIES
    import __spark_entry__ as E

    qs = E.queries()
    names = bench.timed(qs)
    assert set(names) == set(QUERIES) and set(bench.timed(qs, corpus=True)) == set(qs)
