import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.sources import detect, files, generator, json_points, line, parsed, protobuf, validate


def test_line():
    r = line.parse(r'cpu\ x,host=server\,01,region=us-west usage=0.64,n=5i,u=7u,s="a \"b\", c=d",t=T 1234567890000000000')
    assert r["measurement"] == "cpu x" and r["tags"] == {"host": "server,01", "region": "us-west"} and r["ts_ns"] == 1234567890000000000
    assert {k: v[v["kind"]] for k, v in r["fields"].items()} == {"usage": 0.64, "n": 5, "u": 7, "s": 'a "b", c=d', "t": True}
    assert line.parse("  # a comment") is None and line.parse("") is None
    assert line.parse("m v=1")["ts_ns"] is None


@pytest.mark.parametrize("text", ["m", "m ", ",a=b v=1", "m v", "m v=", "m,a=1,a=2 v=1", "m v=1,v=2", 'm v="a', "m v=1 x", "m v=1 1 2", "m v=99999999999999999999i", "m v=-1u", "m v=NaN", "m v=1_0", "m,a v=1", "m v=1 99999999999999999999"])
def test_line_errors(text):
    with pytest.raises(ValueError):
        line.parse(text)


def test_json():
    rows = json_points.parse('[{"measurement": "m", "tags": {"a": "b"}, "fields": {"f": 1.5, "i": 2, "b": true, "s": "x", "n": {"k": 1}}, "timestamp": 5}]')
    assert {k: v["kind"] for k, v in rows[0]["fields"].items()} == {"f": "f", "i": "i", "b": "b", "s": "s", "n": "s"}
    for bad in ("[1]", "{", '{"measurement": "m"}', '{"fields": {"a": 1}}', '{"measurement": "m", "fields": {"a": NaN}}'):
        with pytest.raises(ValueError):
            json_points.parse(bad)
    with pytest.raises(ValueError):
        json_points.parse('[{"measurement":"m","fields":{"a":1}},{"measurement":"m","fields":{"a":1}}]', most=1)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.text(min_size=1, max_size=8), st.dictionaries(st.text(min_size=1, max_size=5), st.text(max_size=5), max_size=3), st.lists(st.tuples(st.integers(-(1 << 62), 1 << 62), st.floats(allow_nan=False)), max_size=4)), max_size=4))
def test_protobuf_round_trip(series):
    rows = protobuf.decode(protobuf.encode(series))
    assert [(r["measurement"], r["tags"], r["ts_ns"] or 0, r["fields"]["value"]["f"]) for r in rows] == [(n, t, ts, v) for n, t, samples in series for ts, v in samples]


def test_protobuf_errors():
    for bad in (b"\x0a", b"\x0a\x05\x01", b"\xff" * 11, b"\x0b"):
        with pytest.raises(ValueError):
            list(protobuf.fields(bad))
    assert protobuf.unzigzag(protobuf.zigzag(-5)) == -5


def test_lines_to_points(spark):
    df = spark.createDataFrame([(0, 'm,a=b x=1,y=2i,s="t" 1000'), (1, "bad"), (2, "# no"), (3, "m x=3")], "n long, value string")
    rows = line.rows(df, seq="n")
    points = parsed.explode(rows, 7_000_000).orderBy("seq", "series_key").collect()
    assert [(r.series_key, r.value) for r in points] == [("m,__field__=x,a=b", 1.0), ("m,__field__=y,a=b", 2.0), ("m,__field__=x", 3.0)]
    good, bad = validate.split(rows, {"m": validate.Schema(fields={"x": validate.FieldRule("float", True, most=2.0)})})
    assert good.count() == 1 and {tuple(r.errors) for r in bad.collect()} == {("fields are missing",), ("field x is above 2.0",)}


def test_all_errors_are_collected(spark):
    df = spark.createDataFrame([(0, "m,time=1 v=1 99999999999999999999")], "n long, value string").selectExpr("n", "value")
    rows = line.rows(df.withColumn("value", F.lit("m,time=1 _field=1 5000000000000000000")), seq="n")
    assert set(validate.validate(rows).collect()[0].errors) == {"a key is reserved", "time is out of range"}


def test_detect(spark):
    df = spark.createDataFrame([(b"\n\x05abc",), (b'  {"a":1}',), (b"[1]",), (b"cpu v=1",)], "b binary")
    assert [r.p for r in df.select(detect.protocol(F.col("b")).alias("p")).collect()] == ["protobuf", "json", "json", "line"]
    assert df.select(detect.protocol(F.col("b"), F.lit("application/json")).alias("p")).first().p == "json"


def test_result_message():
    body = protobuf._part(1, b"s") + protobuf.varint(16) + protobuf.varint(protobuf.zigzag(-3)) + protobuf.varint(25) + struct.pack("<d", 1.5)
    assert [f for f, _, _ in protobuf.fields(body)] == [1, 2, 3]


def test_files_prune(spark, tmp_path):
    p = generator.metrics(spark, 2, 20, step_ms=21_600_000)
    files.write(p, str(tmp_path / "p"))
    assert files.read(spark, str(tmp_path / "p")).count() == 160
    some = files.read(spark, str(tmp_path / "p"), "cpu_usage", 1_700_000_000_000, 1_700_086_400_000)
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(ts" in plan and some.count() == 10
