"""Windows, watermarks and late rows."""

import time
from datetime import datetime, timedelta

from veilframe.streaming.scan_stream import latest_stream, scan_stream, severity_stream

T0 = datetime(2024, 1, 1)


def feed(spark, path, batches, schema):
    """A file stream that gets one file for each batch, in order."""
    for i, rows in enumerate(batches):
        time.sleep(1.1 * (i > 0))  # files are taken in the order of their times
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{path}/b{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(path)


def drain(out, name, mode="append"):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return out.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_latest_row_of_a_window_and_late_rows(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    batches = [[("k", at(0), "a"), ("k", at(0.5), "b")], [("k", at(40), "c")], [("k", at(41), "e")], [("k", at(0.6), "too late"), ("k", at(90), "d")]]
    got = drain(latest_stream(feed(spark, f"{tmp_path}/in", batches, "k string, ts timestamp, v string"), ["k"], "ts"), "latest_rows")
    assert sorted(r.v for r in got) == ["b", "c", "e"]


def test_severity_windows(spark, tmp_path):
    rows = [(T0, "a@b.co"), (T0 + timedelta(minutes=1), "c@d.co 4111111111111111"), (T0 + timedelta(minutes=7), "nothing")]
    stream = feed(spark, f"{tmp_path}/in", [rows], "ts timestamp, text string")
    got = drain(severity_stream(scan_stream(stream), "ts"), "severity_rows", "complete")
    assert sorted((r.severity, r["count"]) for r in got) == [("critical", 1), ("medium", 2)]
