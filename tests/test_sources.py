"""Files on disk: logs, CSV, JSON folders, incremental ingest."""

import json

import pytest
from pyspark.sql import functions as F

from flowlab.sources import crawl, logs
from flowlab.sources import tables as S
from flowlab.streaming import streams as T


def line(i, label, detailed, tunnel="-"):
    return "\t".join([f"{i}.5", f"C{i}", "10.0.0.1", "1", "10.0.0.2", "2", "tcp", "-", "1.5", "10", "4", "SF", "-", "-", "0", "S", "1", "10", "1", "8", f"{tunnel}   {label}   {detailed}"])


def put(folder, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "conn.log.labeled").write_text("\n".join(lines) + "\n")


def test_discovery_parsing_and_scenario_names(spark, tmp_path):
    put(tmp_path / "CTU-A-1" / "bro", ["#separator", line(1, "Benign", "-"), "", "too\tshort", line(2, "Malicious", "DDoS")])
    put(tmp_path / "CTU-B-1" / "deep" / "bro", [line(3, "benign", "-")])
    put(tmp_path / "siteX" / "bro", [line(4, "-", "-")])
    (tmp_path / "siteX" / "bro" / "other.log").write_text("ignored\n")
    got = {r["ts"]: r for r in logs.zeek_scan(spark, str(tmp_path)).collect()}
    assert {t: r["scenario"] for t, r in got.items()} == {"1.5": "CTU-A-1", "2.5": "CTU-A-1", "3.5": "CTU-B-1", "4.5": "siteX"}
    assert (got["2.5"]["tunnel_parents"], got["2.5"]["label"], got["2.5"]["detailed_label"]) == ("-", "Malicious", "DDoS")
    audit = {r["scenario"]: r for r in logs.line_audit(logs.read_log_lines(spark, str(tmp_path)), ["scenario"]).collect()}
    assert (audit["CTU-A-1"]["n_comments"], audit["CTU-A-1"]["n_malformed"], audit["CTU-A-1"]["n_parsed"]) == (1, 1, 2)


def test_missing_tail_parts_become_dashes(spark, rows):
    base = line(1, "x", "y").split("\t")[:20]
    df = rows([("s", "\t".join([*base, t])) for t in ("-   benign", "only", "")], "scenario string, value string")
    assert [(r["tunnel_parents"], r["label"], r["detailed_label"]) for r in logs.parse_lines(df).collect()] == [("-", "benign", "-"), ("only", "-", "-"), ("-", "-", "-")]


def test_csv_filter_is_trimmed_and_reads_missing(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("id,service,x\n1, http ,2\n2,,3\n3,dns,4\n")
    schema = "id bigint, service string, x int"
    assert [r["id"] for r in S.filtered_csv(spark, str(path), schema, "service", "http").collect()] == [1]
    assert [r["id"] for r in S.filtered_csv(spark, str(path), schema, "service", "missing").collect()] == [2]


def test_partitioned_sink_prunes_to_one_scenario(spark, rows, tmp_path):
    S.write_flows(rows([("train", "a", 1.0), ("test", "b", 2.0)], "split string, scenario string, x double"), str(tmp_path / "o"))
    back = spark.read.parquet(str(tmp_path / "o")).where("scenario = 'b'")
    assert back.count() == 1
    assert "PartitionFilters: [isnotnull(scenario" in back._jdf.queryExecution().toString()


def test_column_pruning_reaches_the_scan(spark, rows, tmp_path):
    rows([(1, 2, 3)], "a int, b int, c int").write.parquet(str(tmp_path / "p"))
    plan = S.read_flows(spark, str(tmp_path / "p"), ["b"])._jdf.queryExecution().toString()
    assert "ReadSchema: struct<b:int>" in plan


def test_fold_json_documents(spark, tmp_path):
    for i in range(2):
        d = tmp_path / f"loso_{i}"
        d.mkdir()
        (d / "fold_summary.json").write_text(json.dumps({"scenario": f"s{i}", "f1_macro": 0.5 + i / 10}, indent=2))
    got = crawl.crawl_folds(spark, str(tmp_path), "scenario string, f1_macro double").orderBy("scenario").collect()
    assert [(r["scenario"], r["f1_macro"]) for r in got] == [("s0", 0.5), ("s1", 0.6)]


def test_run_folders(spark, rows, tmp_path):
    for name, seed in (("outputs_a_to_b_rf_seed1", 1), ("outputs_a_to_b_mlp_seed2", 2), ("notes", 9)):
        (tmp_path / "csv" / name).mkdir(parents=True)
        (tmp_path / "csv" / name / "overall.csv").write_text("fraction,f1\n0.1,0.5\n1.0,0.7\n")
        (tmp_path / "json" / name).mkdir(parents=True)
        (tmp_path / "json" / name / "run_config.json").write_text(json.dumps({"source_train_rows": 5, "target_test_rows": 7, "seed": seed}))
    got = crawl.crawl_runs(spark, str(tmp_path / "csv"), str(tmp_path / "json"), "fraction double, f1 double")
    inventory = crawl.run_inventory(got, ["direction", "model", "seed"]).orderBy("seed").collect()
    assert [(r["direction"], r["model"], r["seed"], r["fractions"], r["target_test_rows_config"]) for r in inventory] == [("a_to_b", "rf", "1", "0.1,1.0", 7), ("a_to_b", "mlp", "2", "0.1,1.0", 7)]


def test_name_grammars(rows):
    df = rows([("outputs_unsw_mlp_exp12",), ("outputs_iot23_exp3",)], "n string")
    got = df.select(*crawl.parse_run_name(F.col("n"), crawl.EXPERIMENT_RUN)).collect()
    assert [tuple(r) for r in got] == [("unsw", "_mlp", "12"), ("iot23", None, "3")]
    got = rows([("outputs_iot_to_unsw_rf_train_size_seed4",)], "n string").select(*crawl.parse_run_name(F.col("n"), crawl.STUDY_RUN)).first()
    assert tuple(got) == ("iot_to_unsw", "rf", "train_size", "4")


def test_ingest_reads_only_new_logs(spark, tmp_path):
    root, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    put(root / "CTU-A" / "bro", [line(1, "Benign", "-"), line(2, "Malicious", "DDoS")])
    T.stream_ingest(spark, str(root), out, state, test=["CTU-B"], val=["CTU-C"]).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    put(root / "CTU-B" / "bro", [line(3, "Malicious", "Okiru")])
    T.stream_ingest(spark, str(root), out, state, test=["CTU-B"], val=["CTU-C"]).awaitTermination()
    got = spark.read.parquet(out).groupBy("split", "scenario").count().collect()
    assert {(r["split"], r["scenario"]): r["count"] for r in got} == {("train", "CTU-A"): 2, ("test", "CTU-B"): 1}


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,dur,proto,label,extra\n1,0.5,tcp,1,x\n2,bad,udp,0,y\n")
    schema = "id long, proto string, dur double, label int"
    got = S.read_csv_cols(spark, str(tmp_path / "a.csv"), schema, ["label", "proto", "dur", "id"]).collect()
    assert [tuple(r) for r in got] == [(1, "tcp", 0.5, 1), (0, "udp", None, 2)]
    assert [r["id"] for r in S.filtered_csv(spark, str(tmp_path / "a.csv"), schema, "proto", "udp").collect()] == [2]
    with pytest.raises(ValueError, match="state"):
        S.read_csv_cols(spark, str(tmp_path / "a.csv"), schema + ", state string", ["id", "state"])


def test_importances_with_columns_in_another_order(spark, tmp_path):
    for fold, text in (("one", "importance,feature\n0.5,dur\n0.25,dur\n"), ("two", "importance,feature\n1.0,proto\n")):
        (tmp_path / fold).mkdir()
        (tmp_path / fold / "importance.csv").write_text(text)
    got = sorted(tuple(r) for r in crawl.crawl_importances(spark, str(tmp_path)).collect())
    assert got == [("one", "dur", 0.75), ("two", "proto", 1.0)]
