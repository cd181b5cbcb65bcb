import json

from pyspark.sql import functions as F

from tagloom.streaming import evidence as E

SCHEMA = "k string, seq long, error string, at timestamp, value double"


def put(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_latest_success_over_files(spark, tmp_path):
    put(tmp_path, "1.json", [{"k": "a", "seq": 1}, {"k": "a", "seq": 2, "error": "x"}, {"k": "b", "seq": 3}])
    put(tmp_path, "2.json", [{"k": "a", "seq": 4}, {"k": "c", "seq": 5, "error": "x"}])
    s = E.stream_json(spark, str(tmp_path), SCHEMA, files=1)
    got = E.drain(E.latest_success(s.select("k", "seq", "error"), ["k"], ["seq"], "error is null"))
    assert sorted((r.k, r.seq) for r in got.collect()) == [("a", 4), ("b", 3)]


def test_counters_equal_batch(spark, tmp_path):
    put(tmp_path, "1.json", [{"k": str(i % 3), "seq": i, "error": "x" if i % 4 == 0 else None} for i in range(40)])
    s = E.drain(E.counters(E.stream_json(spark, str(tmp_path), SCHEMA), ["k"], "error is not null"))
    b = E.counters(spark.read.schema(SCHEMA).json(str(tmp_path)), ["k"], "error is not null")
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    put(tmp_path, "1.json", [{"k": "a", "at": "2026-01-01T00:10:00Z", "value": 1.0}, {"k": "a", "at": "2026-01-01T09:10:00Z", "value": 1.0}])
    put(tmp_path, "2.json", [{"k": "a", "at": "2026-01-01T00:20:00Z", "value": 1.0}, {"k": "a", "at": "2026-01-01T20:00:00Z", "value": 1.0}])
    put(tmp_path, "3.json", [{"k": "a", "at": "2026-01-02T20:00:00Z", "value": 1.0}])
    s = E.stream_json(spark, str(tmp_path), SCHEMA, files=1)
    got = E.drain(E.windowed(s, "at", ["k"], "1 hour"), "append").where(F.col("start") < "2026-01-01T12:00:00").collect()
    assert sum(r.n for r in got) <= 3 and len(got) == 2
