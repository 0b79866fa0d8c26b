from datetime import datetime, timedelta

from factloom.streaming import facts


def test_dedup_and_windows(spark, tmp_path):
    start = datetime(2026, 1, 1)
    rows = [(k % 5, start + timedelta(minutes=k % 5), "a") for k in range(10)] + [(9, start + timedelta(days=9), "b")]
    source = str(tmp_path / "in")
    frame = spark.createDataFrame(rows, "id long, at timestamp, kind string")
    frame.write.parquet(source)
    stream = facts.deliveries(spark, source, frame.schema)
    facts.appended(facts.deduplicated(stream, ["id"], "at"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    facts.appended(facts.windowed(stream, "at", ["kind"]), str(tmp_path / "win"), str(tmp_path / "c2")).awaitTermination()
    assert [(r.kind, r.n) for r in spark.read.parquet(str(tmp_path / "win")).collect()] == [("a", 10)]
    facts.appended(facts.sessions(stream, "at", "kind"), str(tmp_path / "ses"), str(tmp_path / "c3")).awaitTermination()
    assert [(r.kind, r.n) for r in spark.read.parquet(str(tmp_path / "ses")).collect()] == [("a", 10)]
