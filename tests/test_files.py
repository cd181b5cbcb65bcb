import json

import pytest
from pyspark.sql import types as T

from tagloom.sources import files, sinks

S = T.StructType([T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("seq", T.LongType()), T.StructField("error", T.StringType())])


@pytest.fixture
def log(tmp_path):
    rows = ['{"id": "1", "score": 0.5, "seq": 1}', "", '{"id": "1", "score": 0.7, "seq": 2}', '{"id": "2", "score": 3.0, "seq": 3}', "[1]", '{"id": "3", "sc', '{"score": 0.1, "seq": 5}', '{"id": "4", "error": "x", "seq": 6}']
    p = tmp_path / "log.jsonl"
    p.write_text("\n".join(rows))
    return str(p)


def test_lenient_and_counted(spark, log):
    assert files.lenient_jsonl(spark, log, S).count() == 5
    latest, bad = files.counted_jsonl(spark, log, S, "id", "seq", "score between 0 and 1")
    assert {(r.id, r.score) for r in latest.collect()} == {("1", 0.7), (None, 0.1)}
    assert tuple(bad.first()) == (2, 2)


def test_strict_fails(spark, log):
    with pytest.raises(Exception):
        files.strict_jsonl(spark, log, S).collect()


def test_health_and_tail(spark, log):
    rows = files._with_bad(spark, log, S)
    assert files.log_health(rows, "id", "error", "score between 0 and 1").first().asDict() == {"n_rows": 7, "malformed": 2, "without_key": 1, "errors": 1, "invalid": 1, "keys": 1, "repeated": 1}
    assert [r.seq for r in files.tail(files.lenient_jsonl(spark, log, S), "seq", 2).collect()] == [6, 5]


def test_giant_object(spark, tmp_path):
    data = {f"k{i}": {"url": "x" * (i % 7), "n": [i, {"a": "}\""}]} for i in range(200)} | {"n": 12, "t": True}
    p = tmp_path / "big.json"
    p.write_text(json.dumps(data))
    spark.dataSource.register(files.GiantObject)
    for chunk in (1, 7, 1 << 20):
        got = {r.key: json.loads(r.value) for r in spark.read.format("giant_object").option("chunk", str(chunk)).load(str(p)).collect()}
        assert got == data
    for bad in ("[1]", '{"a": 1} x', '{"a": 1', '{"a" 1}', ""):
        with pytest.raises(ValueError):
            list(files.object_members(iter([bad])))
    assert list(files.object_members(iter(["{ }"]))) == []


def test_rules(spark, tmp_path):
    p = tmp_path / "rules.json"
    rule = {"question_id": "1", "label_id": "2", "action": "remove", "reason": "r"}
    p.write_text(json.dumps({"rules": [rule]}))
    assert files.rules(spark, str(p), ["remove"]).count() == 1
    for wrong in ([rule, rule], [{**rule, "action": "x"}]):
        p.write_text(json.dumps({"rules": wrong}))
        with pytest.raises(ValueError):
            files.rules(spark, str(p), ["remove"])


def test_page_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "</script>"), ("2", "b")], "id string, x string")
    p = tmp_path / "page.html"
    p.write_text(sinks.page(df, "t"))
    assert "</script>\"" not in p.read_text()
    got = files.embedded_json(spark, str(p), "DATA", "struct<id:string,x:string>")
    assert sorted(map(tuple, got.collect())) == [("1", "</script>"), ("2", "b")]


def test_workbook_round_trip(spark, tmp_path):
    p = str(tmp_path / "a.xlsx")
    sinks.workbook({"labels": [["id", "name"], ["1", "a & <b>"], ["2", "c"]], "more": [["n"], [1.5]]}, p)
    assert files.workbook_rows(p)[1] == ["1", "a & <b>"] and files.workbook_rows(p, 2) == [["n"], ["1.5"]]
    t = files.taxonomy(spark, files.workbook_rows(p), {"id": "label_id", "name": "label_name"}, ["label_id"])
    assert t.count() == 2
    for rows in ([["id", "name"], ["1", ""]], [["id", "name"], ["1", "a"], ["1", "b"]], [["id"], ["1"]]):
        with pytest.raises(ValueError):
            files.taxonomy(spark, rows, {"id": "label_id", "name": "label_name"}, ["label_id"])


def test_publish_and_shards(spark, tmp_path):
    df = spark.range(100).selectExpr("cast(id as string) id", "id * 2 v")
    with pytest.raises(ValueError):
        sinks.publish(df, str(tmp_path / "x"), check=lambda w: (_ for _ in ()).throw(ValueError("bad")))
    assert not (tmp_path / "x").exists()
    sinks.publish(df, str(tmp_path / "x"))
    with pytest.raises(FileExistsError):
        sinks.publish(df, str(tmp_path / "x"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x"]
    m = sinks.write_shards(df, str(tmp_path / "s"), "id", 4, {"v": 1})
    assert sum(m["counts"].values()) == 100
    res = df.select("id")
    assert sinks.merge_shards(spark, str(tmp_path / "s"), res, "id", {"v": 1}).count() == 100
    for wrong, conf in ((res.where("id <> '5'"), {"v": 1}), (res.unionByName(res.limit(1)), {"v": 1}), (res.selectExpr("concat(id, 'x') id"), {"v": 1}), (res, {"v": 2})):
        with pytest.raises(ValueError):
            sinks.merge_shards(spark, str(tmp_path / "s"), wrong, "id", conf)


def test_fingerprint_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("1", 0.5), ("2", None)], "id string, x double")
    assert sinks.fingerprint(df) == sinks.fingerprint(df.repartition(3).select("x", "id")) != sinks.fingerprint(df.limit(1))
    assert "| 1 | 0.5 |" in sinks.markdown(df, "T")
    with pytest.raises(ValueError):
        sinks.markdown(df, "T", most=1)
    sinks.per_label(spark.createDataFrame([("q", "l", 0.5), ("r", "m", 0.1)], "question_id string, label_id string, score double"), str(tmp_path / "l"))
    assert (tmp_path / "l" / "label_id=l").exists() and (tmp_path / "l.index").exists()
