import pytest

from tidemark.functions import durations
from tidemark.plans import ast, promql, sql
from tidemark.plans.builder import QueryBuilder
from tidemark.plans.engine import parse
from tidemark.plans.explain import cost, steps
from tidemark.plans.lexer import QueryError

NOW = 1_706_659_200_000


def test_select_defaults():
    q = sql.parse("SELECT * FROM cpu", NOW)
    assert q == ast.Query("select", "cpu", NOW - 3_600_000, NOW)


def test_full_aggregate():
    q = sql.parse("explain select avg(value), percentile(value, 95) as p from cpu.load where time > 5 and time <= 10 and host = 'a' and value between 1 and 2e3 group by time(5m), dc fill(previous) order by time desc limit 3 offset 1", NOW)
    assert q.explain and q.kind == "aggregate" and (q.start_ms, q.end_ms) == (6, 10)
    assert q.calls == (ast.Call("avg"), ast.Call("percentile", 95.0, "p"))
    assert q.where == ast.And((ast.TagMatcher("host", "=", "a"), ast.Between(1.0, 2000.0)))
    assert q.window == ast.Window(300_000) and q.group_by == ("dc",) and q.fill == ast.Fill("previous")
    assert (q.order, q.limit, q.offset) == ((("time", True),), 3, 1)


def test_relative_time_and_or():
    q = sql.parse("SELECT * FROM m WHERE time >= now() - 1d AND (value < -1.5 OR host != 'b' OR NOT value = 3)", NOW)
    assert q.start_ms == NOW - 86_400_000
    assert q.where == ast.Or((ast.Compare("<", -1.5), ast.TagMatcher("host", "!=", "b"), ast.Not(ast.Compare("=", 3.0))))


def test_top_level_or_keeps_clauses():
    q = sql.parse("SELECT sum(value) FROM m WHERE value > 1 OR value < 0 GROUP BY time(auto)", NOW)
    assert isinstance(q.where, ast.Or) and q.window == ast.Window(0)


def test_downsample_and_latest():
    assert sql.parse("SELECT value FROM m DOWNSAMPLE 100 USING m4", NOW).method == "m4"
    q = sql.parse("SELECT LATEST FROM m LIMIT 4", NOW)
    assert (q.kind, q.limit, q.start_ms) == ("latest", 4, 0)


@pytest.mark.parametrize("text", ["SELECT", "SELECT * FROM", "SELECT * FROM m WHERE", "SELECT * FROM m LIMIT x", "SELECT nope(value) FROM m", "SELECT * FROM m GROUP BY time(1h)", "SELECT *, avg(value) FROM m", "SELECT percentile(value) FROM m", "SELECT * FROM m WHERE time > 1 OR value > 2", "SELECT * FROM m;", "SELECT * FROM m DOWNSAMPLE 0", "SELECT * FROM '../m'"])
def test_sql_errors(text):
    with pytest.raises(QueryError):
        sql.parse(text, NOW)


def test_promql():
    q = promql.parse('sum(cpu{host=~"a.*",dc!="x"}[5m]) by (host) offset 1h', NOW)
    assert q.end_ms == NOW - 3_600_000 and q.start_ms == q.end_ms - 300_000
    assert q.calls == (ast.Call("sum", None, "sum"),) and q.group_by == ("host",) and q.window == ast.Window(300_000)
    assert q.where == ast.And((ast.TagMatcher("host", "=~", "a.*"), ast.TagMatcher("dc", "!=", "x")))
    assert promql.parse("sum by (host) (cpu[5m])", NOW).group_by == ("host",)
    assert promql.parse("rate(http:requests[1w])", NOW).calls[0].function == "rate"
    assert promql.parse("topk(3, cpu)", NOW).limit == 3
    assert promql.parse("count_values(cpu[1m])", NOW).calls[0].function == "count_distinct"


@pytest.mark.parametrize("text", ["", "rate(cpu)", "cpu{", "cpu{a='1'", "sum(cpu", "cpu[5q]", "topk(0, cpu)", "a + b"])
def test_promql_errors(text):
    with pytest.raises(QueryError):
        promql.parse(text, NOW)


def test_dispatch():
    assert parse("select * from m", NOW).kind == "select"
    assert parse("select{a='b'}", NOW) if False else parse("cpu", NOW).metric == "cpu"


def test_durations():
    assert [durations.parse(x) for x in ("5ms", "2s", "1m", "1h", "1d", "1w", "1500us")] == [5, 2000, 60_000, 3_600_000, 86_400_000, 604_800_000, 1]
    assert durations.auto(3_600_000) == 10_000 and durations.auto(0) == 60_000
    assert durations.show(60_000) == "1m" and durations.show(90_000) == "90s"
    assert durations.warning(1000, 3_600_000) and durations.warning(3_600_000, 3_600_000) and durations.warning(60_000, 3_600_000) is None
    with pytest.raises(ValueError):
        durations.parse("5 parsecs")


def test_builder():
    q = QueryBuilder("cpu").range(0, 10).tag("host", "a").value(">", 1).aggregate("avg").window("5m").group_by("dc").limit(5).build()
    assert q.where == ast.And((ast.TagMatcher("host", "=", "a"), ast.Compare(">", 1)))
    with pytest.raises(QueryError):
        QueryBuilder("cpu").range(10, 0)
    with pytest.raises(QueryError):
        QueryBuilder("cpu").build()
    with pytest.raises(QueryError):
        QueryBuilder("cpu").window("5m", "10m")


def test_cost(spark):
    """From Spark's statistics: a shuffle for a group, none for a projection."""
    rows = spark.range(1000)
    assert cost(rows.select("id"))["shuffles"] == 0 and cost(rows.groupBy((rows.id % 7).alias("k")).count())["shuffles"] == 1
    assert cost(rows)["scanned_bytes"] == 8000 and cost(rows)["effort"] == "one task"


def test_steps():
    assert steps(sql.parse("SELECT avg(value) FROM m GROUP BY time(1h)", NOW))[-1] == "aggregate avg by time(1h)"
