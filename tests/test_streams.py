"""Running confusion in append mode: windows close behind the watermark, rows that come later are dropped."""

import os

from flowlab.streaming import streams as T

DAY = 86_400.0


def test_append_mode_closes_windows_and_drops_late_rows(spark, tmp_path):
    batches = [
        [("a", 0.1 * DAY, 1, 1), ("a", 0.2 * DAY, 0, 1), ("b", 0.3 * DAY, 1, 0)],
        [("a", 2.5 * DAY, 1, 1)],
        [("a", 2.6 * DAY, 0, 0)],
        [("a", 0.4 * DAY, 1, 1)],
        [("a", 9.0 * DAY, 1, 1)],
        [("a", 9.1 * DAY, 1, 1)],
    ]
    schema = "scenario string, ts double, y_true int, y_pred int"
    source = tmp_path / "in"
    seen: set[str] = set()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        for name in os.listdir(source):
            if name.startswith("part-") and name not in seen:
                seen.add(name)
                os.utime(source / name, (1_000_000 + i, 1_000_000 + i))
    scored = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = T.run_to_table(T.stream_confusion(scored, late="1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    got = {(r["window_start_us"] // int(DAY * 1e6), r["scenario"]): (r["tn"], r["fp"], r["fn"], r["tp"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # The row of day 0 in the fourth batch is two batches behind the watermark that passed day 0; day 9 is still open.
    assert got == {(0, "a"): (0, 1, 0, 1), (0, "b"): (0, 0, 1, 0), (2, "a"): (1, 0, 0, 1)}


def test_replayed_batch_gives_no_second_rows(spark, tmp_path):
    out = str(tmp_path / "table")
    write = T.ingest_writer(out)
    batch = spark.range(0, 4000, 1, 16).selectExpr("id", "if(id % 4 = 0, 'test', 'train') AS split", "concat('s', id % 3) AS scenario")
    write(batch, 0)
    write(batch.limit(100), 1)
    write(batch, 0)
    table = spark.read.parquet(out)
    assert table.count() == 4100 and table.where("batch_id = 0").count() == 4000
    files = sum(name.endswith(".parquet") for _, _, names in os.walk(f"{out}/batch_id=0") for name in names)
    assert files <= 12  # 16 tasks and 6 folders would leave up to 96 files
