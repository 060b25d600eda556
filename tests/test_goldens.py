"""Rules over small streams with known results, a result for each trigger."""

import pytest

from tideql.engine import Engine
from tideql.plans.frame import PlanProblem
from tideql.sql.parser import SyntaxProblem, parse

#: The rows of the streams, and the results that are expected of them below.
T0 = 1541152486000
DEMO = [("red", 3, 13), ("blue", 6, 822), ("blue", 2, 1632), ("yellow", 4, 2442), ("red", 1, 3252)]
#: As an event-time stream gives them: the late row is gone, the last row lifts the watermark.
DEMO_E = [("red", 3, 13), ("blue", 2, 1632), ("red", 1, 3252), ("yellow", 4, 2442), ("yellow", 4, 6342)]
SESSION_E = [(25.5, 13), (28.1, 1932), (25.5, 3252), (27.4, 2442), (26.2, 4062), (28.9, 5682), (26.8, 4872), (29.1, 6492), (30.9, 8112), (32.2, 7202)]
DEMO_1E = [(27.5, 59, 823), (25.5, 65, 13), (27.4, 80, 2442), (28.1, 75, 1632), (25.5, 62, 3252)]


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    stamp = lambda rows: [(*r[:-1], r[-1] + T0) for r in rows]
    e.register("demo", spark.createDataFrame(stamp(DEMO), "color string, size bigint, ts bigint"), "ts")
    e.register("demoE", spark.createDataFrame(stamp(DEMO_E), "color string, size bigint, ts bigint"), "ts")
    e.register("sessionE", spark.createDataFrame(stamp(SESSION_E), "temp double, ts bigint"), "ts")
    e.register("demo1E", spark.createDataFrame(stamp(DEMO_1E), "temp double, hum bigint, ts bigint"), "ts")
    e.register("demoE2", spark.createDataFrame([(27.5, 0), (25.5, 1000), (25.5, 2000)], "temp double, ts bigint"), "ts")
    arr = spark.createDataFrame([([1, 2, 3, 4, 5], 1, 2, [(1, 2), (3, 4)], 6, 1)], "arr array<bigint>, x bigint, y bigint, arr2 array<struct<a:bigint,b:bigint>>, a bigint, ts bigint")
    e.register("demoArr", arr, "ts")
    e.register("demoTable", spark.createDataFrame(stamp([(f"device{i + 1}", t) for i, (_, _, t) in enumerate(DEMO)]), "device string, ts bigint"), "ts", kind="table", retain=3)
    e.register("table1", spark.createDataFrame([(T0 + 13, "name1", 2), (T0 + 1632, "name2", 6), (T0 + 3252, "name3", 4)], "id bigint, name string, size bigint"), kind="table")
    e.register("st", spark.createDataFrame([(a, i) for i, a in enumerate([1, 1, 1, 2, 2, 3])], "a bigint, ts bigint"), "ts")
    return e


def rows(engine, sql):
    return [tuple(r) for r in engine.sql(sql).collect()]


def by_window(engine, sql):
    return [tuple(r) for r in sorted(engine.sql(sql).collect(), key=lambda r: r[0])]


def test_hopping_with_hits(engine):
    got = by_window(engine, "SELECT window_end() AS e, count(*) AS c, last_agg_hit_count() AS lc, last_agg_hit_time() AS lt FROM demoE GROUP BY HOPPINGWINDOW(ss,2,1) HAVING lc < 4")
    assert got == [(T0 + 1000, 1, 0, 0), (T0 + 2000, 2, 1, T0 + 1000), (T0 + 3000, 2, 2, T0 + 2000), (T0 + 4000, 2, 3, T0 + 3000)]


def test_hopping_contents(engine):
    got = by_window(engine, "SELECT window_end() AS e, collect(color) AS c FROM demoE GROUP BY HOPPINGWINDOW(ss,2,1)")
    assert got[:5] == [(T0 + 1000, ["red"]), (T0 + 2000, ["red", "blue"]), (T0 + 3000, ["blue", "yellow"]), (T0 + 4000, ["yellow", "red"]), (T0 + 5000, ["red"])]


def test_tumbling_filter(engine):
    assert sorted(rows(engine, "SELECT window_end(), color, ts FROM demoE WHERE size > 2 GROUP BY tumblingwindow(ss,1)"))[:2] == [(T0 + 1000, "red", T0 + 13), (T0 + 3000, "yellow", T0 + 2442)]


def test_session(engine):
    got = by_window(engine, "SELECT window_start() AS a, window_end() AS b, collect(temp) AS t FROM sessionE GROUP BY SessionWindow(ss,2,1)")
    assert got == [(T0 + 13, T0 + 1013, [25.5]), (T0 + 1932, T0 + 4000, [28.1, 27.4, 25.5]), (T0 + 4062, T0 + 8000, [26.2, 26.8, 28.9, 29.1, 32.2]), (T0 + 8112, T0 + 9112, [30.9])]


def test_sliding_bounds_are_closed(engine):
    assert sorted(rows(engine, "SELECT window_end() AS e, collect(temp) AS t FROM demoE2 GROUP BY SLIDINGWINDOW(ss,1)")) == [(0, [27.5]), (1000, [27.5, 25.5]), (2000, [25.5, 25.5])]
    assert (1000, [27.5, 25.5]) not in rows(engine, "SELECT window_end() AS e, collect(temp) AS t FROM demoE2 GROUP BY SLIDINGWINDOW(ss,1,1)")


def test_sliding_filter_and_trigger(engine):
    assert sorted(rows(engine, "SELECT collect(size) AS s FROM demoE GROUP BY SlidingWindow(ss,1,4) FILTER (where color = 'red')")) == [([1],), ([3, 1],)]
    got = by_window(engine, "SELECT window_end() AS e, count(*) AS c FROM demo GROUP BY SlidingWindow(ss,2) OVER(WHEN size > 3)")
    assert got == [(T0 + 822, 2), (T0 + 2442, 3)]


def test_count_and_row_number(engine):
    assert sorted(rows(engine, "select size, row_number() from demo group by countWindow(5)")) == [(1, 5), (2, 3), (3, 1), (4, 4), (6, 2)]
    assert sorted(rows(engine, "SELECT collect(size) AS s FROM demo GROUP BY COUNTWINDOW(3, 1)")) == [([2, 4, 1],), ([3, 6, 2],), ([6, 2, 4],)]


def test_state(engine):
    assert sorted(rows(engine, "SELECT collect(a) AS l FROM st GROUP BY STATEWINDOW(had_changed(true, a))")) == [([1, 1, 1],), ([2, 2],)]


def test_unnest(engine):
    assert sorted(rows(engine, "SELECT unnest(arr2) FROM demoArr where x=1")) == [(1, 2), (3, 4)]
    assert rows(engine, "SELECT arr[0] AS f, arr[-1] AS l, arr[1:3] AS s, arr2[1]->b AS b FROM demoArr") == [(1, 5, [2, 3], 4)]
    assert engine.sql("SELECT a, unnest(arr2) FROM demoArr").columns == ["a", "b"]


def test_retained_table(engine):
    assert sorted(rows(engine, "SELECT device FROM demo INNER JOIN demoTable on demo.ts = demoTable.ts")) == [("device3",), ("device4",), ("device5",)]


def test_lookup(engine):
    assert sorted(rows(engine, "SELECT demo.size, table1.name FROM demo LEFT JOIN table1 ON demo.ts = table1.id AND table1.size > 3")) == [(1, "name3"), (2, "name2"), (3, None), (4, None), (6, None)]
    assert sorted(rows(engine, "SELECT demo.*, table1.name AS n FROM demo INNER JOIN table1 ON demo.ts = table1.id")) == [("blue", 2, T0 + 1632, "name2"), ("red", 1, T0 + 3252, "name3"), ("red", 3, T0 + 13, "name1")]


def test_windowed_join(engine):
    got = by_window(engine, "SELECT window_end() AS e, max(temp) AS m, count(color) AS c FROM demoE INNER JOIN demo1E ON demoE.ts = demo1E.ts GROUP BY TUMBLINGWINDOW(ss, 1)")
    assert got == [(T0 + 1000, 25.5, 1), (T0 + 2000, 28.1, 1), (T0 + 3000, 27.4, 1), (T0 + 4000, 25.5, 1)]


def test_join_in_windows_that_rows_make(engine):
    """Rows of both streams make sliding windows; each joins what it holds."""
    got = rows(engine, "SELECT window_end() AS e, max(temp) AS m, count(color) AS c FROM demoE INNER JOIN demo1E ON demoE.ts = demo1E.ts GROUP BY SlidingWindow(ss,1)")
    left, right = {t for *_, t in DEMO_E}, {t: x for x, _, t in DEMO_1E}
    want = []
    for end in sorted([t for *_, t in DEMO_E] + [t for *_, t in DEMO_1E]):
        both = [t for t in left & set(right) if end - 1000 <= t <= end]
        if both:
            want.append((T0 + end, max(right[t] for t in both), len(both)))
    assert sorted(got) == want
    got = rows(engine, "SELECT count(*) AS n, count(temp) AS m FROM demoE LEFT JOIN demo1E ON demoE.ts = demo1E.ts GROUP BY SessionWindow(hh, 2, 1)")
    assert got == [(5, 4)]


def test_changed_columns(engine):
    got = engine.sql('SELECT ts, changed_cols("tt_", true, color, size) FROM demo').collect()
    assert [(r.tt_color, r.tt_size) for r in sorted(got, key=lambda r: r.ts)] == [("red", 3), ("blue", 6), (None, 2), ("yellow", 4), ("red", 1)]


def test_functions_of_earlier_rows_keep_order_across_buckets(spark):
    data = [(i * 37_000, i % 2, i if i % 3 else None) for i in range(40)]
    sql = "SELECT t, lag(x) OVER (PARTITION BY k) AS l, lag(x, 2) AS l2, latest(x) AS n, acc_sum(x) AS s, acc_count(x, t % 5 = 0, t % 7 = 0) AS c FROM s"
    got = [sorted(map(tuple, Engine(spark, {"bucket_ms": b}).register("s", spark.createDataFrame(data, "t bigint, k bigint, x bigint"), "t").sql(sql).collect())) for b in (1000, 60_000, 10**9)]
    assert got[0] == got[1] == got[2]
    seen, want = {}, []
    for t, k, x in data:
        want.append((t, seen.get(k)))
        if x is not None:
            seen[k] = x
    assert [(r[0], r[1]) for r in got[0]] == want


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT a FROM", "SELECT FROM s", "SELECT a s", "SELECT a FROM s GROUP BY TUMBLINGWINDOW(1)", "SELECT a FROM s GROUP BY TUMBLINGWINDOW(yy, 1)", "SELECT a FROM s LIMIT x", "SELECT a FROM s CROSS JOIN b ON a = b",
        "SELECT a FROM s GROUP BY COUNTWINDOW(2, 3)", "SELECT CASE END FROM s", "CREATE STREAM s (a INTERVAL)", "CREATE STREAM s () WITH (COLOUR=\"red\")", "SELECT a b FROM s WHERE", "SELECT a FROM s GROUP BY TUMBLINGWINDOW(ss,1), HOPPINGWINDOW(ss,2,1)",
    ],
)
def test_what_does_not_parse(sql):
    with pytest.raises(SyntaxProblem):
        parse(sql)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT nothing FROM demo", "SELECT a AS b, b AS a FROM demo", "SELECT size FROM demo WHERE unnest(size) = 1", "SELECT unnest(size), unnest(ts) FROM demo", "SELECT size FROM demo HAVING size > 1", "SELECT foo(size) FROM demo",
        "SELECT * FROM demo INNER JOIN demoE ON demo.ts = demoE.ts", "SELECT size FROM nowhere", "SELECT count(*) FROM demo GROUP BY count(*)", "SELECT size FROM demo WHERE size > avg(size)",
    ],
)
def test_what_cannot_be_planned(engine, sql):
    with pytest.raises(PlanProblem):
        engine.sql(sql)
