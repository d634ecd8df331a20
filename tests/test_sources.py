"""Readers, writers and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from sieveline.functions import text
from sieveline.plans.bridge import records
from sieveline.sources import readers, writers
from sieveline.streaming import monitor


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_manifest(spark, tmp_path):
    path = lines(tmp_path / "m.jsonl", [{"id": "x", "image": "a/b.png", "label": "Fake"}, "", {"image": "", "image_path": "/abs/c.d.jpg", "ground_truth": "REAL "}])
    found = {r.id: (r.image, r.label) for r in readers.read_manifest(spark, path).collect()}
    assert found == {"x": (f"{tmp_path}/a/b.png", "fake"), "c.d": ("/abs/c.d.jpg", "real")}
    bad = readers.read_manifest(spark, lines(tmp_path / "bad.jsonl", [{"image": "a.png"}]))
    with pytest.raises(Exception, match="without label"):
        bad.collect()


def test_results(spark, tmp_path):
    path = lines(tmp_path / "r.jsonl", [{"id": "1", "model": "m", "use_tools": True, "trial": 2, "confidence": 0.5}, "{broken", {"id": "2", "model": "m", "use_tools": False}])
    rows = readers.read_results(spark, path).cache().orderBy("id").collect()
    assert [r._key for r in rows] == [None, "1_m_True_2", "2_m_False_0"]
    assert rows[0]._corrupt == "{broken" and rows[1].file_name == "r.jsonl"
    assert readers.discovered_results(spark, str(tmp_path)).count() == 1


def test_metrics_document(spark, tmp_path):
    one = {"total": 3, "accuracy": 0.5, "confusion": {"tp": 1, "tn": 0, "fp": 1, "fn": 1}}
    (tmp_path / "a.metrics.json").write_text(json.dumps({"_meta": {"x": 1}, "org|model|tools": {"per_trial": {"0": one, "1": {"total": 9}}}, "plain": {"per_trial": {"0": {"total": 4}}}}))
    (tmp_path / "b.metrics.json").write_text("{no json")
    found = {(r.model, r.mode): (r.total, r.confusion and r.confusion.tp) for r in readers.read_metrics(spark, str(tmp_path)).collect()}
    assert found == {("org|model", "tools"): (3, 1), ("plain", "unknown"): (4, None)}


def test_cache_and_reviews(spark, tmp_path):
    rows = spark.createDataFrame([("ela", "h", "{}", "one", "completed", 1.0), ("ela", "h", "{}", "two", "completed", 2.0), ("ela", "h", "{}", "three", "error", 3.0)], "tool string, image_hash string, params string, output string, status string, written double")
    writers.write_cache(rows, f"{tmp_path}/cache")
    found = readers.read_cache(spark, f"{tmp_path}/cache")
    assert [r.output for r in found.collect()] == ["two"]
    assert writers.cache_stats(found).first().entries == 1
    (tmp_path / "p.json").write_text(json.dumps({"evaluations": {"k1": {"reasoning_quality": 4, "verdict_agree": True}, "k2": {}}}))
    assert {r.sample_key: r.reasoning_quality for r in readers.read_reviews(spark, f"{tmp_path}/p.json").collect()} == {"k1": 4, "k2": None}


def test_markdown_and_json(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.12345, None), ("c\nd", 2.0, 3)], "name string, x double, n int")
    table = writers.markdown_table(df, [("name", "Name"), ("x", "X"), ("n", "N")], ["name"])
    assert table.splitlines() == ["| Name | X | N |", "|:---:|---|---|", "| a\\|b | 0.123 | — |", "| c<br>d | 2.000 | 3 |"]
    writers.write_metrics(spark.createDataFrame([("m", "tools", 1)], "model string, mode string, total int"), f"{tmp_path}/m")
    assert json.loads(spark.read.text(f"{tmp_path}/m").first().value) == {"config": "m|tools", "total": 1}
    writers.write_csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["name", "x", "n"]


def test_json_spans(spark):
    said = 'x {"a": "}{", "b": {"c": 1}} y {not json} {"d": "\\""} {"open": '
    found = spark.createDataFrame([(said,), (None,)], "t string").select(text.json_spans("t").alias("s")).collect()
    assert [s.json for s in found[0].s] == ['{"a": "}{", "b": {"c": 1}}', '{"d": "\\""}'] and found[1].s == []
    spark.udtf.register("json_objects", text.JsonSpans)
    assert spark.sql("SELECT json FROM json_objects('a {\"k\": 1} b {\"l\": 2}')").count() == 2


def test_running_stream_equals_batch(spark, tmp_path):
    from sieveline.operators.metrics import running_metrics

    rows = records(spark, "/root/testdata/sf0.001").select("event_id", "model", "use_tools", "label", "prediction", "error", F.col("ts"))
    rows.repartition(4).write.json(f"{tmp_path}/in")
    schema = "event_id long, model string, use_tools boolean, label string, prediction string, error string, ts timestamp"
    query = monitor.running(monitor.result_stream(spark, f"{tmp_path}/in", schema, 1), "running_now", f"{tmp_path}/ck")
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("running_now").collect()} == {tuple(r) for r in running_metrics(rows).collect()}


def test_daily_windows(spark, tmp_path):
    rows = records(spark, "/root/testdata/sf0.001").select(F.col("ts").cast("timestamp").alias("ts"), "model", "label", "prediction", "error")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = monitor.daily(stream).writeStream.outputMode("append").format("memory").queryName("daily_now").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = rows.groupBy(F.window("ts", "1 day").start.alias("start"), "model").agg(F.count("*").alias("n"))
    want = {(r.start, r.model): r.n for r in batch.collect()}
    found = {(r.start, r.model): r.n for r in spark.table("daily_now").collect()}
    assert found and all(want[k] == n for k, n in found.items())


def test_cancelled(spark):
    grid = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b")], "id int, model string")
    done = spark.createDataFrame([(1, "a", None, "fake")], "id int, model string, error string, prediction string")
    found = {(r.id, r.model): r.error_type for r in monitor.cancelled(grid, done, ["id", "model"]).collect()}
    assert found == {(1, "a"): None, (2, "a"): "cancelled", (1, "b"): "cancelled"}


def test_caches_are_cleared_and_documents_saved_whole(spark, tmp_path):
    path = f"{tmp_path}/cache"
    rows = spark.createDataFrame([("a", "h", "p", "out", "completed", 1.0), ("b", "h", "p", "no", "error", 2.0)], "tool string, image_hash string, params string, output string, status string, written double")
    writers.write_cache(rows, path)
    writers.write_cache(rows, path)
    assert writers.clear_cache(spark, path) == 2
    assert readers.read_cache(spark, path).count() == 0
    for n in (3, 1):
        writers.save_whole(spark.range(n), f"{tmp_path}/doc")
        assert spark.read.schema("id long").json(f"{tmp_path}/doc").count() == n
    assert sorted(p.name for p in tmp_path.iterdir()) == ["cache", "doc"]


def test_appended_manifest(spark):
    files = spark.createDataFrame([("b\\1.png", "fake"), ("a/2.png", "real"), ("c/3.png", "real")], "path string, label string")
    held = spark.createDataFrame([("sample-000007", "a/2.png"), ("other", "x")], "id string, image string")
    assert [tuple(r) for r in writers.appended_manifest(held, files).orderBy("id").collect()] == [("sample-000008", "b/1.png", "fake"), ("sample-000009", "c/3.png", "real")]
    assert [r.id for r in writers.appended_manifest(held.limit(0), files.limit(1)).collect()] == ["sample-000001"]
    assert writers.appended_manifest(held, files.limit(0)).count() == 0


def test_evidence_of_odd_answers(spark):
    from sieveline.functions import results

    rows = [(1, {}), (2, None), (3, {"perform_ela": None, "x": "[1]", "y": '"text"', "z": ""}), (4, {"mine": 'see {"tool": "perform_trufor", "status": "completed", "manipulation_probability": "0.5"} end'})]
    rows.append((5, {"detect_jpeg_quantization": '{"is_jpeg": false, "sac_score": null}', "perform_ela": '{"ela_anomaly_score": 1, "quality": 90}', "perform_ela2": '{"tool": "perform_ela", "error": "no"}'}))
    df = spark.createDataFrame(rows, "k int, outputs map<string,string>")
    found = {r.k: r for r in results.normalised(df, ["k"], "outputs").collect()}
    assert all(found[k].summary_lines == found[k].caveats == found[k].parse_errors == [] and found[k].evidence == {} for k in (1, 2))
    assert sorted(found[3].parse_errors) == ["perform_ela", "x", "y", "z"]
    assert json.loads(found[3].evidence["x"]) == {"status": "unparsed", "raw_preview": "[1]"}
    assert found[4].summary_lines == ["- perform_trufor: status=completed, manipulation_probability=0.500, detection_score=n/a"]
    assert json.loads(found[4].evidence["mine"]) == {"status": "completed", "manipulation_probability": "0.5", "detection_score": None, "error": None}
    assert "- detect_jpeg_quantization: status=unknown, is_jpeg=False, quality_estimate_primary=None, sac_score=n/a" in found[5].summary_lines
    assert "- perform_ela: status=unknown, anomaly_score=1.000, quality=90" in found[5].summary_lines
    assert set(found[5].caveats) == {results.NOT_JPEG, results.CAVEATS["perform_ela"]}


def test_report_frames(spark, tmp_path):
    from sieveline.plans import report

    rows = records(spark, "/root/testdata/sf0.001")
    frames = report.summary_frames(rows)
    assert set(frames) == {"inventory", "configs", "paired_tests", "against_best", "tools", "tool_usage", "provenance"}
    assert frames["configs"].count() == 10 and frames["provenance"].count() > 0
    assert {"mcc", "accuracy_low", "coverage_high", "confidence_p95", "aurc", "latency_seconds_p99", "fingerprint", "vision_model"} <= set(frames["configs"].columns)
    assert max(r["rank"] for r in frames["tool_usage"].collect()) <= report.TOP_TOOLS
    report.write_summary(rows, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 7
    assert report.markdown_report(rows).startswith("# Summary")


def test_clients_errors_are_kept_whole_and_made_once(spark):
    from sieveline.operators import external

    def factory():
        made = [0]

        def client(x):
            made[0] += 1
            if x % 2:
                raise ValueError("long " * 300 + str(x))
            return f"{x}"

        return client

    df = spark.range(6).select(F.col("id").alias("k"))
    found = {r.k: r for r in external.called(df, ["k"], ["k"], factory).collect()}
    assert found[3].error == "long " * 300 + "3" and found[3].status == "error" and found[2].output == "2" and found[2].seconds >= 0
    cached = spark.createDataFrame([(0, "kept", 0.5, "completed", None), (1, None, 0.1, "error", "old")], "k long, output string, seconds double, status string, error string")
    again = {r.k: r.output for r in external.called_once(df, cached, ["k"], ["k"], factory).collect()}
    assert again == {0: "kept", 1: None, 2: "2", 3: None, 4: "4", 5: None}
    tools = {r.name: r.arguments for r in external.registry(spark).collect()}
    assert len(tools) == 8 and tools["perform_ela"] == {"image_path": "string", "quality": "int"}
    assert "json_spans" in external.register(spark)


def test_intermediate_tables_need_a_shared_folder(spark, tmp_path):
    from types import SimpleNamespace

    from sieveline import session

    unset = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(master="yarn", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))
    tables = session.Tables(spark)
    kept = tables.keep("a", spark.range(5))
    assert kept.count() == 5 and tables.folder.startswith(session.shared_folder(spark))
    tables.drop("a")
    with pytest.raises(Exception, match="not exist|PATH_NOT_FOUND"):
        spark.read.parquet(f"{tables.folder}/a")


def test_manifest_query_beyond_six_digits(spark, tmp_path):
    """The query has its SQL's ids, of six digits; the operator's have all digits."""
    import duckdb

    from sieveline import catalog

    rows = [(k, f"part {k}", "SMALL") for k in range(999_990, 1_000_010)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = catalog.queries()["snk15_appended_manifest"](spark, str(tmp_path)).select("id", "image", "label").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, found)) == sorted(con.sql(catalog.oracle_sql()["snk15_appended_manifest"]).fetchall())
    held = spark.createDataFrame([("sample-1000008", "a.png")], "id string, image string")
    assert [r.id for r in writers.appended_manifest(held, spark.createDataFrame([("b.png", "fake")], "path string, label string")).collect()] == ["sample-1000009"]


def test_evidence_query_parses_an_answer_once(spark, tmp_path):
    """An answer is parsed in one column, and a second time only in braces; a small file is dealt over the cores."""
    from sieveline.plans import evidence_queries

    plan = evidence_queries.fn22_evidence(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.lower().count("parse_json") + plan.count("parseJson") <= 6
    assert "Join" not in plan and "Repartition" in plan
