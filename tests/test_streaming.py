from datetime import datetime, timedelta

from cellforge.streaming import windows

START = datetime(2024, 5, 1)


def test_windows_and_newest_cells(spark, tmp_path):
    rows = [(START + timedelta(minutes=7 * k), k % 3, k % 2, None if k % 11 == 5 else float(k * k % 23)) for k in range(60)]
    schema = "ts timestamp, row int, col int, v double"
    whole = spark.createDataFrame(rows, schema)
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    spark.createDataFrame(rows[:40], schema).write.parquet(str(tmp_path / "in"))
    kept = {"checkpoint": str(tmp_path / "check"), "to": str(tmp_path / "out")}
    first = windows.drained(windows.windowed(stream(), "ts", "v", "1 hour", "10 minutes", "row"), **kept)
    assert first.count() > 0
    spark.createDataFrame(rows[40:], schema).write.mode("append").parquet(str(tmp_path / "in"))
    got = windows.drained(windows.windowed(stream(), "ts", "v", "1 hour", "10 minutes", "row"), **kept).collect()
    want = {}
    for ts, r, _, v in rows:
        if v is not None:
            want.setdefault((ts.replace(minute=0), r), []).append(v)
    assert {(x.start, x.row): (x.n, x.min, x.max) for x in got} == {k: (len(v), min(v), max(v)) for k, v in want.items()}
    latest = {}
    for ts, r, c, v in rows:
        latest[r, c] = v
    assert {(x.row, x.col): x.v for x in windows.drained(windows.newest(stream(), "ts", "v")).collect()} == latest
    passed = windows.drained(windows.windowed(stream(), "ts", "v", "1 hour", "10 minutes"), "append").collect()
    assert {x.start for x in passed} < {k for k, _ in want} and whole.count() == 60
