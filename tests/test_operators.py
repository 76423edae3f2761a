import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import histogram, labels
from tidemark.functions.aggregates import aggregate, floor_rank, nearest_rank
from tidemark.operators import cardinality, catalogue, counters, dedup, downsample, moving, profile, selectors, topk, windows
from tidemark.plans import ast
from tidemark.plans.engine import Engine


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize("values, increase, rate, delta", [((100, 150, 200, 10, 60, 110), 210, 42, 10), ((50, 100, 5, 25, 3, 33), 108, 21.6, -17), ((0, 100, 200, 300, 400), 400, 100, 400)])
def test_counters(frame, values, increase, rate, delta):
    points = frame([(1000 * i, float(v)) for i, v in enumerate(values)])
    r = one(counters.rate(points))
    assert (r.increase, r.rate, r.delta) == (increase, pytest.approx(rate), delta)
    # Slices of two seconds join up to the same.
    assert one(counters.totals(points, slice_us=2_000_000)).increase == increase


def test_counter_edges(frame):
    r = one(counters.rate(frame([(0, 5.0)])))
    assert (r.increase, r.rate) == (0.0, None)
    assert one(counters.last_two(frame([(1000, 100.0), (2000, 10.0)]))).irate == 10.0


def test_moments(frame):
    p = frame([(i, float(v)) for i, v in enumerate((2, 4, 4, 4, 5, 5, 7, 9))])
    r = one(p.agg(aggregate("stddev").alias("s"), aggregate("variance").alias("v")))
    assert (r.s, r.v) == (pytest.approx(2.1380899), pytest.approx(4.5714286))
    assert one(frame([(0, 5.0)]).agg(aggregate("stddev").alias("s"))).s == 0.0


def test_percentiles(frame):
    p = frame([(i, float(i + 1)) for i in range(4)])
    r = one(p.agg(aggregate("median").alias("m"), floor_rank(50).alias("f"), aggregate("p50").alias("q")))
    assert (r.m, r.f, r.q) == (2.5, 2.0, 2.5)
    assert one(frame([(i, float(i + 1)) for i in range(100)]).agg(nearest_rank(95).alias("n"))).n == 95.0
    with pytest.raises(ValueError):
        aggregate("nope")


def test_ties_and_nan(frame):
    p = frame([(1, 10.0), (1, 11.0), (2, float("nan"))])
    assert one(dedup.dedup(p).where("value < 12").select("value")).value == 10.0
    assert one(dedup.dedup(p, "last").where("value < 12").select("value")).value == 11.0
    assert p.where(selectors.value(F.col("value"), ast.Compare(">", float("nan")))).count() == 0


def test_buckets_start_at_the_range(frame):
    p = frame([(7_000, 1.0), (8_000, 2.0), (307_000, 3.0)])
    rows = Engine(p, 400_000).query("SELECT sum(value) FROM s WHERE time >= 7000 GROUP BY time(5m)").collect()
    assert [r["sum"] for r in rows] == [3.0, 3.0] and str(rows[0].bucket) == "1970-01-01 00:00:07"


def test_fill(frame):
    p = frame([(0, 1.0), (4000, 5.0)])
    q = "SELECT avg(value) FROM s WHERE time >= 0 AND time <= 5000 GROUP BY time(1s) FILL({})"
    get = lambda kind: [r.avg for r in Engine(p, 0).query(q.format(kind)).collect()]
    assert get("null") == [1, None, None, None, 5, None]
    assert get("zero") == [1, 0, 0, 0, 5, 0] and get("7") == [1, 7, 7, 7, 5, 7]
    assert get("previous") == [1, 1, 1, 1, 5, 5] and get("linear") == [1, 2, 3, 4, 5, None]


def test_moving(frame):
    p = frame([(i, float(i + 1)) for i in range(5)])
    get = lambda f: [r.moving for r in moving.moving(p, f, 3).orderBy("ts").collect()]
    assert get("avg") == [1, 1.5, 2, 3, 4] and get("sum") == [1, 3, 6, 9, 12] and get("min") == [1, 1, 1, 2, 3] and get("max") == [1, 2, 3, 4, 5]
    ema = moving.exponential_moving_avg(frame([(0, 10.0), (1, 20.0), ("t", 0, 3.0)]), 0.5).orderBy("series_key", "ts").collect()
    assert [r.ema for r in ema] == [10.0, 15.0, 3.0]
    with pytest.raises(ValueError):
        moving.moving(p, "avg", 0)


def test_tags(frame):
    p = frame([("m,host=server1", 0, 1.0), ("m,host=db,dc=x", 0, 2.0)])
    n = lambda c: p.where(c).count()
    t = F.col("tags")
    assert n(selectors.tag_pattern(t, "host=server*")) == 1 and n(selectors.tag_pattern(t, "host=erver*")) == 0
    assert n(selectors.tag_pattern(t, "dc=*")) == 1 and n(selectors.tag_pattern(t, "host=regex:r1$,dc=*")) == 0
    assert n(selectors.tag(t, ast.TagMatcher("dc", "!=", "x"))) == 1 and n(selectors.tag(t, ast.TagMatcher("dc", "=", ""))) == 1
    with pytest.raises(ValueError):
        selectors.tag(t, ast.TagMatcher("dc", "=~", r"(a)\1"))


def test_labels(frame):
    p = frame([("m,host=ab-cd,dc=x", 0, 1.0)])
    r = one(p.select(labels.label_replace(F.col("tags"), "short", "$2:$1", "host", r"(\w+)-(\w+)").alias("a"), labels.label_replace(F.col("tags"), "n", "x", "host", "zz").alias("b"), labels.label_join(F.col("tags"), "j", "/", ["dc", "no", "host"]).alias("c")))
    assert r.a["short"] == "cd:ab" and "n" not in r.b and r.c["j"] == "x/ab-cd"
    with pytest.raises(ValueError):
        labels.label_replace(F.col("tags"), "0bad", "", "host", "")


def test_histogram(spark):
    inf = float("inf")
    df = spark.createDataFrame([([(1.0, 10.0), (2.0, 30.0), (inf, 40.0)],), ([(1.0, 0.0), (inf, 0.0)],), ([],)], "b array<struct<le:double,count:double>>")
    get = lambda q: [r.x for r in df.select(histogram.histogram_quantile(q, F.col("b")).alias("x")).collect()]
    assert get(0.5) == [1.5, None, None] and get(0.1) == [0.4, None, None] and get(0.99) == [2.0, None, None] and get(2) == [None] * 3


def test_downsample_series(frame):
    p = frame([(1000 * i, float(v)) for i, v in enumerate((10, 50, 5, 30, 100, 1, 40, 20))])
    for method in downsample.METHODS:
        assert downsample.downsample(p, method, 8).count() == 8
    m4 = [r.value for r in downsample.m4(p, 4).orderBy("ts").collect()]
    assert m4 == [10, 100, 1, 20]
    assert [r.value for r in downsample.average(p, 4).orderBy("ts").collect()] == [30, 17.5, 50.5, 30]
    lttb = [r.value for r in downsample.lttb(p, 4).orderBy("ts").collect()]
    assert lttb[0] == 10 and lttb[-1] == 20 and len(lttb) == 4 and 100 in lttb


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=200), st.integers(3, 50))
def test_lttb_properties(values, target):
    kept = downsample.largest_triangles(np.arange(len(values), dtype=float), np.array(values), target)
    assert kept[0] == 0 and kept[-1] == len(values) - 1 and (np.diff(kept) > 0).all()
    assert len(kept) == min(target, len(values))


def test_lttb_of_long_series(frame):
    """As over one array, however long the series and wherever its batches end."""
    r = np.random.default_rng(5)
    for n, target in ((2000, 8), (513, 8), (40, 8), (9, 8), (1000, 3), (12_000, 50)):
        t, v = np.cumsum(r.integers(1, 90_000, n)), np.round(r.normal(size=n).cumsum(), 3)
        got = downsample.lttb(frame([("a", int(x), float(y)) for x, y in zip(t, v)] + [("b", 5, 1.0), ("b", 9, 2.0)]), target)
        want = [v[i] for i in downsample.largest_triangles((t - t[0]).astype(float), v, target)]
        assert [x.value for x in got.where("series_key = 'a'").orderBy("ts").collect()] == want
        assert [x.value for x in got.where("series_key = 'b'").orderBy("ts").collect()] == [1.0, 2.0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(allow_nan=True), max_size=50))
def test_xor_round_trip(values):
    back = profile.xor_decode(profile.xor_encode(np.array(values, float)))
    assert back.tobytes() == np.array(values, "<f8").tobytes()


def test_delta_of_delta_round_trip(frame):
    ms = [0, 10, 30, 31, 99]
    p = frame([(m, 1.0) for m in ms])
    coded = profile.delta_of_delta(p)
    first = p.groupBy("series_key").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("ts_us"))
    assert [r.ts_us // 1000 for r in profile.from_delta_of_delta(coded, first).orderBy("seq").collect()] == ms


def test_kmv(spark):
    df = spark.range(5000).withColumn("g", F.lit("x"))
    sketch = cardinality.kmv(df, "id", 256, "g")
    estimate = one(sketch.select(cardinality.kmv_estimate(F.col("hashes")).alias("e"))).e
    assert abs(estimate - 5000) < 1000
    small = cardinality.kmv(spark.range(10), "id")
    assert one(small.select(cardinality.kmv_estimate(F.col("hashes")).alias("e"))).e == 10
    halves = [one(cardinality.kmv(df.where(f"id % 2 = {k}"), "id", 256, "g")).hashes for k in (0, 1)]
    both = spark.createDataFrame([tuple(halves)], "a array<long>, b array<long>").select(cardinality.kmv_merge(F.col("a"), F.col("b")).alias("m"))
    assert one(both).m == one(sketch).hashes


def test_kmv_count_is_exact_at_any_size(spark):
    rows = [(g, v) for g, n in (("few", 15), ("k", 16), ("many", 1000), (None, 40)) for v in range(n)] + [("few", None), ("none", None)]
    df = spark.createDataFrame(rows + rows, "g string, v long")
    want = {("few", 15.0), ("k", 16.0), ("many", 1000.0), (None, 40.0), ("none", 0.0)}
    assert sorted(map(tuple, cardinality.kmv_count(df, "v", 16, "g").collect()), key=str) == sorted(want, key=str)
    assert [r.estimate for r in cardinality.kmv_count(df, "v", 16).collect()] == [1000.0]
    assert [r.estimate for r in cardinality.kmv_count(df.where("v < 3"), "v", 16).collect()] == [3.0]


def test_kmv_exact_beyond_the_sketch(spark, tmp_path):
    import duckdb

    from tidemark import registry

    users = "SELECT id AS event_id, timestamp_ntz '2024-01-01' AS ts, id AS user_id, if(id % 3 = 0, 'click', 'view') AS event_type, 1.0D AS value FROM range(110000)"
    spark.sql(users).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.sql(registry.ORACLES["kmv_exact"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["kmv_exact"](spark, str(tmp_path)).collect())) == sorted(want)


def test_catalogue(frame):
    c = catalogue.series(frame([("m,host=a,dc=x", 0, 1.0), ("m,host=b,dc=x", 0, 1.0), ("n,host=a", 0, 1.0), ("n,host=a", 1, 1.0)]))
    assert c.count() == 3
    tags = {r.tag: (r.value, r.varying) for r in catalogue.merged_tags(c.where("metric = 'm'")).collect()}
    assert tags == {"host": (None, True), "dc": ("x", False)}
    rules = {r.rule for r in cardinality.violations(c, cardinality.Limits(series=2, labels=1, label_values=1)).collect()}
    assert rules == {"series", "labels", "label_values"}


def test_data_aligned_clips_the_last_window(frame):
    r = windows.data_aligned(frame([(1000, 1.0), (11_000, 2.0)]), (ast.Call("count"),), 10_000).orderBy("bucket").collect()
    assert [x["count"] for x in r] == [1, 1] and str(r[1].at) == "1970-01-01 00:00:10.500000"


def test_cap_and_empty(frame):
    p = frame([(0, 1.0), (1, 2.0)])
    assert topk.capped(p, 1)[1] and not topk.capped(p, 2)[1]
    empty = p.where("false")
    assert Engine(empty, 10).query("SELECT avg(value), count(value) FROM s WHERE time >= 0").collect()[0].asDict() == {"avg": None, "count": 0}
    assert Engine(empty, 10).query("SELECT avg(value) FROM s WHERE time >= 0 GROUP BY time(1s)").count() == 0
    assert math.isclose(one(p.agg(aggregate("absent").alias("a"))).a, 0.0)


def test_unknown_aggregate_is_an_error(frame):
    from tidemark.plans.lexer import QueryError

    with pytest.raises(QueryError):
        Engine(frame([(0, 1.0)]), 10).aggregate("s", "nope", 0, 10)
    with pytest.raises(QueryError):
        Engine(frame([(0, 1.0)]), 10).aggregate("s", "avg", 10, 0)
