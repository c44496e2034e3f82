from datetime import datetime, timedelta

from sqlgauge.operators.latency import latency_report
from sqlgauge.streaming.latency import start_window_reports

LOG = (
    "config string, ok boolean, latency_ms double, out_tokens bigint, "
    "start_ts timestamp, end_ts timestamp"
)
T0 = datetime(2024, 1, 1)


def batch(start_minutes, count, config="a"):
    rows = []
    for i in range(count):
        start = T0 + timedelta(minutes=start_minutes, seconds=i)
        rows.append((config, i % 5 > 0, 10.0 + i % 13, 3, start, start + timedelta(seconds=1)))
    return rows


def test_closed_windows_are_reported_exactly(spark, tmp_path):
    source, out = tmp_path / "log", str(tmp_path / "out")
    parts = [
        batch(0, 300) + batch(61, 200, "b"),
        batch(30, 50),  # late, but within the delay
        batch(300, 10),  # moves the watermark on
        batch(1, 40),  # too late: dropped
    ]
    schema = spark.createDataFrame([], LOG).schema
    for part in parts:
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        query = start_window_reports(
            stream, out, str(tmp_path / "ckpt"), "1 hour", "40 minutes", availableNow=True
        )
        query.awaitTermination()
        assert query.exception() is None
    got = {
        (r.window_start, r.config): r
        for r in spark.read.parquet(out).drop("batch_id").collect()
    }
    assert set(got) == {(T0, "a"), (T0 + timedelta(hours=1), "b")}
    on_time = parts[0] + parts[1]
    for (start, config), row in got.items():
        log = [r for r in on_time if r[0] == config and start <= r[4] < start + timedelta(hours=1)]
        expected = latency_report(spark.createDataFrame(log, LOG)).first()
        assert row.num_requests == len(log)
        assert row.latency_ms == expected.latency_ms
        assert row.throughput == expected.throughput
        assert row.output_tokens_total == expected.output_tokens_total


def test_buckets_and_clean_up(spark, tmp_path, monkeypatch):
    source, out, shared = tmp_path / "log", str(tmp_path / "out"), tmp_path / "shared"
    monkeypatch.setattr("sqlgauge.session.shared_dir", lambda session: str(shared))
    schema = spark.createDataFrame([], LOG).schema
    for hour in range(5):
        part = batch(60 * hour, 100)
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        query = start_window_reports(
            stream, out, str(tmp_path / "ckpt"), "1 hour", "1 minute", exact=False,
            availableNow=True,
        )
        query.awaitTermination()
        assert query.exception() is None
        made = shared / "sqlgauge"
        assert not made.exists() or not [p for p in made.iterdir() if p.is_dir()]
    reports = spark.read.parquet(out).orderBy("window_start").collect()
    assert len(reports) == 4
    expected = latency_report(spark.createDataFrame(batch(0, 100), LOG)).first()
    first = reports[0]
    assert (first.num_requests, first.failed) == (expected.num_requests, expected.failed)
    assert first.latency_ms.mean == expected.latency_ms.mean
    for name in ("p50", "p95", "p99"):
        assert abs(first.latency_ms[name] - expected.latency_ms[name]) <= 0.1
