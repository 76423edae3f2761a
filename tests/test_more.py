"""Stored points, sessions and fills over slices, streams of queries, codecs, sets and routing."""

import socket
import threading

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import arrays, bloom, codecs
from tidemark.operators import chunks, profile, routing, topk, windows
from tidemark.plans import ast
from tidemark.plans.builder import QueryBuilder
from tidemark.plans.engine import Engine
from tidemark.plans.lexer import QueryError
from tidemark.sources import files, generator, line
from tidemark.streaming import tail


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.floats(allow_nan=True), st.integers(-1000, 1000).map(float), st.integers(0, 10**6).map(lambda x: x / 100)), max_size=60))
def test_codecs_round_trip(values):
    v = np.array(values, "<f8")
    for encode, decode in codecs.CODECS.values():
        assert decode(encode(v)).tobytes() == v.tobytes()
    name, data = codecs.best(v)
    assert all(len(data) <= len(encode(v)) for encode, _ in codecs.CODECS.values()) and name in codecs.CODECS


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(1 << 60), 1 << 60), max_size=50))
def test_times_round_trip(us):
    assert codecs.times_decode(codecs.times_encode(np.array(us, np.int64))).tolist() == us


_chunk = st.lists(st.one_of(st.floats(allow_nan=True), st.integers(0, 10**6).map(lambda x: x / 100), st.just(42.0)), max_size=90)


@settings(max_examples=100, deadline=None)
@given(st.lists(_chunk, max_size=12))
def test_chunks_together_are_coded_as_each_alone(chunks):
    v, starts = np.array([x for c in chunks for x in c], "<f8"), np.cumsum([0, *map(len, chunks)])
    for name, (encode, decode) in codecs.CHUNKED.items():
        data, ends = encode(v, starts)
        assert [data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])] == [codecs.CODECS[name][0](np.array(c, "<f8")) for c in chunks]
        assert decode(data, ends).tobytes() == v.tobytes()
    us = np.nan_to_num(v, nan=1.0).clip(-1e15, 1e15).astype(np.int64) * 1000
    data, ends = codecs.times_chunks(us, starts)
    assert codecs.times_unchunked(data, ends).tolist() == us.tolist()
    assert [data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])] == [codecs.times_encode(us[a:b]) for a, b in zip(starts[:-1], starts[1:])]


def test_codec_bytes_stay():
    v = np.array([1.25, 1.25, 1.5, -3.75, 0.1, float("nan")])
    assert [codecs.CODECS[k][0](v).hex() for k in ("alp", "chimp")] == [
        "06000000020a89feffffffffffff0100000005000000000000000000f87f2f8beb0400818000",
        "06000000013ff4000000000000140e83bffde3fede66666666666a404199999999999a",
    ]
    assert codecs.times_encode(np.array([1_000, 2_000, 3_500, 3_400])).hex() == "d00f00e807ff18"


@pytest.mark.parametrize("batch", [3, 10_000])
def test_coded_chunks_across_batches(spark, frame, batch):
    """A call for each chunk took 58 s for 100,000 points; chunks of a batch go together, wherever it is cut."""
    day = 86_400_000
    rows = [("a", d * day + k, float(k)) for d in range(4) for k in range(d * 5 + 1)] + [("b", day, 1.5), ("b", day + 1, None), ("c", 5, None)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, batch)
    try:
        df = profile.coded(frame(rows))
        assert "FlatMapGroups" not in df._jdf.queryExecution().toString()
        found = sorted((r.series_key, r.day, r.n, r.same_values, r.same_times) for r in df.collect())
    finally:
        spark.conf.set(name, before)
    assert found == sorted([("a", d, d * 5 + 1, d * 5 + 1, d * 5 + 1) for d in range(4)] + [("b", 1, 2, 2, 2), ("c", 0, 1, 1, 1)])


def test_codecs_shrink_what_they_are_for():
    r = np.random.default_rng(1)
    prices, ramp = np.round(r.uniform(10, 500, 1000), 2), np.arange(1000.0)
    assert codecs.best(prices)[0] == "alp" and len(codecs.best(prices)[1]) < 2.2 * 1000
    assert len(codecs.best(ramp)[1]) < 1.4 * 1000 and len(codecs.chimp_encode(np.full(1000, 42.0))) < 300


def _runs(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][-1] < gap:
            out[-1].append(t)
        else:
            out.append([t])
    return [(x[0], x[-1] + gap, len(x)) for x in out]


@pytest.mark.parametrize("cells", [1, 3, 1 << 16])
def test_sessions_over_slices(frame, monkeypatch, cells):
    monkeypatch.setattr(windows, "SLICE", cells)
    r = np.random.default_rng(3)
    times = np.cumsum(r.choice([1, 400, 999, 1000, 1001, 5000], 120)).tolist()
    p = frame([(f"m,host={i % 2}" if i % 5 else "m", t, 1.0) for i, t in enumerate(times)])
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp")).alias(c)
    got = windows.sessions(p, (ast.Call("count"),), 1000, []).select(ms("bucket"), ms("bucket_end"), "count").collect()
    assert sorted(map(tuple, got)) == _runs(times, 1000)
    keyed = windows.sessions(p.withColumn("host", F.col("tags")["host"]), (ast.Call("count"),), 1000, ["host"]).select("host", ms("bucket"), ms("bucket_end"), "count").collect()
    want = [(h, *x) for h in (None, "0", "1") for x in _runs([t for i, t in enumerate(times) if (None if i % 5 == 0 else str(i % 2)) == h], 1000)]
    assert sorted(map(str, (tuple(x) for x in keyed))) == sorted(map(str, want))


@pytest.mark.parametrize("kind", ["previous", "linear", "null", "zero"])
def test_fill_over_slices(frame, monkeypatch, kind):
    p = frame([("m,h=a", 0, 1.0), ("m,h=a", 9000, 10.0), ("m,h=b", 4000, 3.0), ("m", 5000, 7.0), ("m", 6000, 8.0)])
    for by in ("", ", h"):
        q = f"SELECT avg(value) FROM m WHERE time >= 0 AND time <= 12000 GROUP BY time(1s){by} FILL({kind})"
        whole = sorted(map(str, Engine(p, 0).query(q).collect()))
        monkeypatch.setattr(windows, "SLICE", 3)
        assert sorted(map(str, Engine(p, 0).query(q).collect())) == whole and len(whole) == (39 if by else 13)
        monkeypatch.undo()


def test_engine_reads_repeated_points_once(frame):
    p = frame([(1, 10.0), (1, 20.0), (2, 5.0), (2, 1.0)])
    q = "SELECT count(value), sum(value) FROM s WHERE time >= 0"
    got = {k: tuple(Engine(p, 10, k).query(q).collect()[0]) for k in ("first", "last", None)}
    assert got == {"first": (2, 15.0), "last": (2, 21.0), None: (4, 36.0)}
    # Conditions on values look at the kept point alone.
    assert Engine(p, 10).query(q + " AND value > 6").collect()[0]["count"] == 1 and Engine(p, 10, "last").query(q + " AND value < 6").collect()[0]["count"] == 1
    with pytest.raises(ValueError):
        Engine(p, 10, "any")


def test_tags_reach_the_scan_below_deduplication(frame):
    plan = Engine(frame([(1, 10.0)]), 10).query("SELECT * FROM s WHERE time >= 0 AND host = 'a' AND value > 3")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "Aggregate" in x)
    assert any("host" in x for x in lines[at:]) and any("> 3.0" in x for x in lines[:at])


def test_steps_are_within_series(frame):
    p = frame([("m,h=a", 1000, 1.0), ("m,h=a", 2000, 5.0), ("m,h=b", 1500, 100.0), ("m,h=b", 2500, 101.0)])
    got = {r.series_key: r.idelta for r in Engine(p, 10_000).query("idelta(m[10s])").collect()}
    assert got == {"m,h=a": 4.0, "m,h=b": 1.0}


def test_merge_of_small_files(spark, tmp_path):
    at = str(tmp_path / "p")
    points = generator.metrics(spark, 2, 50, step_ms=3_600_000)
    for k in range(3):
        files.write(points.where(f"seq % 3 = {k}"), at, mode="append")
    engine = Engine.open(spark, at, 10**15)
    before = engine.chunks().count()
    plan = engine.merge(dry_run=True)
    assert engine.chunks().count() == before == 3 * plan.count()
    assert engine.merge().agg(F.sum("n_chunks")).first()[0] == before
    assert engine.chunks().count() * 3 == before and files.read(spark, at).count() == points.count()
    assert engine.merge().count() == 0  # nothing is left to merge
    assert {r.rows for r in engine.chunks("cpu_usage", series_key="cpu_usage,host=host0").collect()} <= set(range(1, 25))
    with pytest.raises(QueryError):
        Engine(points).chunks()


def test_merge_plan_cuts(spark):
    ts = lambda h: f"2024-01-01 {h:02d}:00:00"
    rows = [("m", "a", 40, ts(0), ts(1)), ("m", "b", 40, ts(1), ts(2)), ("m", "c", 40, ts(2), ts(3)), ("m", "d", 500, ts(3), ts(4)), ("m", "e", 10, ts(9), ts(10)), ("m", "f", 10, ts(10), ts(11)), ("n", "g", 1, ts(0), ts(1))]
    df = spark.createDataFrame(rows, "metric string, chunk string, rows long, min_ts string, max_ts string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("min_ts", "max_ts")})
    got = {tuple(r.merged): r.rows for r in chunks.merge_plan(df, 100, 2 * 3_600_000).collect()}
    assert got == {("a", "b"): 80, ("e", "f"): 20}
    assert chunks.merge_plan(df, 100, 2 * 3_600_000, least_gain=0.6).count() == 0
    assert {tuple(r.merged) for r in chunks.merge_plan(df, 1000, 3 * 3_600_000, 5 * 3_600_000).collect()} == {("a", "b", "c", "d"), ("e", "f")}


def test_files_end_by_rows(spark, tmp_path):
    points = generator.metrics(spark, 1, 40, step_ms=1000)
    files.write(points, str(tmp_path / "p"), most_rows=15)
    assert chunks.listing(spark, str(tmp_path / "p")).agg(F.max("rows")).first()[0] == 15


def test_rendezvous_moves_few(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    moved = {(r.from_node, r.to_node): r.n for r in routing.moved(keys, "k", "abcd", "abcde").collect()}
    assert sum(moved.values()) == 3000 and {b for a, b in moved if a != b} == {"e"}
    assert 400 < sum(n for (a, b), n in moved.items() if a != b) < 800
    assert {a for a, b in ((r.from_node, r.to_node) for r in routing.moved(keys, "k", "abcd", "abd").collect()) if a != b} == {"c"}
    with pytest.raises(ValueError):
        routing.rendezvous(F.lit("x"), [])


def test_bloom(spark):
    bits, hashes = bloom.sized(2000)
    held = spark.range(2000).withColumn("id", F.when(F.col("id") > 0, F.col("id")))
    seen = bloom.with_membership(spark.range(1, 6000), "id", bloom.build(held, "id", bits, hashes), bits, hashes)
    n = seen.agg(F.count_if(F.expr("maybe and id < 2000")), F.count_if(F.expr("maybe and id >= 2000"))).first()
    assert n[0] == 1999 and n[1] < 120
    assert bloom.with_membership(spark.range(5), "id", bloom.build(held.where("false"), "id")).where("maybe").count() == 0


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([1.0], [1.0, 2.0]), ([], []), ([None, 2.0], [1.0, 1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = [tuple(r) for r in df.select(arrays.scale(a, 2), arrays.add(a, b), arrays.mul(a, b), arrays.total(a), arrays.mean(a)).collect()]
    assert got == [([2.0, 4.0], [4.0, 6.0], [3.0, 8.0], 3.0, 1.5), ([2.0], None, None, 1.0, 1.0), ([], [], [], 0.0, None), ([None, 4.0], [None, 3.0], [None, 2.0], 2.0, 2.0)]


def test_merged_sources(frame):
    p = frame([(i, float(i)) for i in range(20)])
    rows = topk.merged([p.where("seq % 2 = 0"), p, p.where("seq > 5")], 8, "first").collect()
    assert [r.value for r in rows] == [float(i) for i in range(8)]


LINES = ["m,a=b x=1,y=2i 1000", "m x=8999999999999999999i 1704067211172425000", "m x=1 -9300000000000000000", "m x=-3.25", "m x=t,y=FALSE", "m u=18446744073709551615u", "m u=5u,i=-7i -5", "m,a=b,a=c x=1", "m x=1,x=2", "m  x=1", "m x=1e5", 'm s="a b"', r"m\ n x=1", "m,é=1 x=1", "#m x=1", "", "m", "m x=", "m x=nan", "m x=99999999999999999999i", "m x=1 2 3", " m x=1", "m,=b x=1", "m x=1 99999999999999999999", "m#,t=# x=1", "m x=1\n", "m x=tr", "m,a=b=c x=1"]


def test_simple_lines_are_parsed_alike(spark):
    df = spark.createDataFrame(list(enumerate([*LINES, None])), "n long, value string")
    as_text = lambda rows: sorted(str(sorted(r.asDict(True).items(), key=str)) for r in rows.collect())
    assert as_text(line.rows(df, seq="n")) == as_text(line.scanned(line.numbered(df, "value", "n")))
    simple = [x for x in LINES if __import__("re").search(line._SIMPLE.replace(r"\A", "^").replace(r"\z", r"\Z"), x)]
    assert len(simple) == 8


def test_streams_refuse_what_needs_all_points(frame):
    p = frame([(1, 1.0)])
    for q in ("SELECT LATEST FROM s LIMIT 1", "SELECT * FROM s WHERE time >= 0 ORDER BY time", "SELECT sum(value) FROM s WHERE time >= 0", "rate(s[1d])", "SELECT avg(value) FROM s WHERE time >= 0 GROUP BY time(1s) FILL(linear)"):
        with pytest.raises(QueryError):
            Engine(p, 10).stream(q, p)


def test_session_stream(spark, frame, tmp_path):
    frame([(0, 1.0), (500, 2.0), (5000, 3.0), (10_000_000, 4.0)]).write.parquet(str(tmp_path / "in"))
    live = tail.follow(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    q = QueryBuilder("s").range(0, 10**9).aggregate("count").aggregate("sum").sessions("1s")
    got = tail.drain(q.stream(live), str(tmp_path / "out")).orderBy("bucket").collect()
    assert [(r["count"], r["sum"]) for r in got] == [(2, 3.0), (1, 3.0)]


def test_idle_series_are_forgotten(spark, frame, tmp_path):
    """Three batches: a series that the watermark leaves behind starts anew, with sequence 1."""
    batches = [[(0, 1.0), (1000, 1.0), (2000, 2.0)], [("t", 10_000_000, 5.0)], [("t", 20_000_000, 6.0)], [("s", 20_000_000, 2.0)]]
    for i, rows in enumerate(batches):
        frame(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    schema = spark.read.parquet(str(tmp_path / "in/0")).schema
    seen = []
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = tail.each_batch(tail.changes(live, idle_ms=1000, lateness="1 second"), lambda df, n: seen.extend(df.collect()), str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    of = sorted((r.series_key, str(r.ts), r.value, r.before, r.sequence) for r in seen)
    assert [x[2:] for x in of if x[0] == "s"] == [(1.0, None, 1), (2.0, 1.0, 2), (2.0, None, 1)]


def test_lines_from_a_socket(spark, tmp_path):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        with server.accept()[0] as c:
            c.sendall(b"m,a=b x=1 1000\nm,a=c x=2 2000\n")
            done.wait(60)

    done = threading.Event()
    threading.Thread(target=serve, daemon=True).start()
    seen = []
    q = tail.each_batch(line.rows(tail.socket_lines(spark, "127.0.0.1", server.getsockname()[1]), seq="seq"), lambda df, n: seen.extend(df.collect()), str(tmp_path / "ck"))
    for _ in range(120):
        if len(seen) >= 2:
            break
        q.awaitTermination(0.5)
    done.set()
    q.stop()
    assert sorted(r.tags["a"] for r in seen) == ["b", "c"]


def test_explain_is_sparks(spark, tmp_path):
    files.write(generator.metrics(spark, 2, 100, step_ms=3_600_000), str(tmp_path / "p"))
    engine = Engine.open(spark, str(tmp_path / "p"), 1_800_000_000_000)
    text = "EXPLAIN SELECT avg(value) FROM {} WHERE time >= 0"
    cost = {m: dict(x.line.split(": ") for x in engine.query(text.format(m)).where("part = 'cost'").collect()) for m in ("cpu_usage", "nothing")}
    assert int(cost["cpu_usage"]["shuffles"]) >= 1 and cost["cpu_usage"]["effort"] == "one task"
    assert int(cost["cpu_usage"]["scanned_bytes"]) > 0


def test_steps(frame):
    p = frame([("a", i, float(v)) for i, v in enumerate((10, 25, 40))] + [("b", 0, 0.001)])
    assert {tuple(r) for r in profile.steps(p, 2, "series_key").collect()} == {("a", 0, 500), ("b", 1, None)}
