"""What holds on larger tables: steps that grow with their input alone, and rows of one time."""

import random

from pyspark.sql import functions as F

from tideql.operators.dedup_trigger import uncovered


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def covered_first(requests):
    """By single milliseconds: a request's, in order of end, start and the rest."""
    seen, out = set(), {}
    for key, s, e, i in sorted(requests, key=lambda r: (r[2], r[1], str(r[0]), r[3])):
        mine = [x for x in range(s, e) if (key, x) not in seen]
        seen |= {(key, x) for x in mine}
        parts = []
        for x in mine:
            if parts and parts[-1][1] == x:
                parts[-1][1] = x + 1
            else:
                parts.append([x, x + 1])
        if parts:
            out[i] = [tuple(p) for p in parts]
    return out


def test_dedup_trigger_sends_a_long_request_to_few_buckets(spark):
    r = random.Random(7)
    spans = [(r.choice(["a", "b", None]), s, s + r.choice([0, 1, 5, 40, 300, r.randrange(900)]), i) for i in range(150) for s in [r.randrange(-400, 600)]]
    spans += [("a", 100, 100, 900), ("b", -300, 700, 901), ("b", -300, 700, 902)]
    df = spark.createDataFrame(spans, "k string, s bigint, e bigint, i bigint")
    out = uncovered(df, "s", "e", keys=["k"], bucket=16)
    got = {x.i: [tuple(p) for p in x.parts] for x in out.collect()}
    assert got == covered_first(spans)
    assert "Join" not in plan(out)
    # Without keys, and with requests that are much longer than a bucket: runs of buckets in place of each.
    far = spark.createDataFrame([(0, 10**9, 1), (5, 10**9, 2), (-7, 10**9 + 3, 3)], "s bigint, e bigint, i bigint")
    assert {x.i: [tuple(p) for p in x.parts] for x in uncovered(far, "s", "e", bucket=10**6).collect()} == {1: [(0, 10**9)], 3: [(-7, 0), (10**9, 10**9 + 3)]}


ROWS = [("a", "signup", 1.0, 0), ("b", "view", 2.0, 0), ("c", "signup", 3.0, 5), ("d", "view", 4.0, 5), ("e", "signup", 5.0, 5), ("f", "error", 6.0, 9), ("g", "view", 7.0, 9), ("h", "signup", 8.0, 12), ("i", "view", 9.0, 12)]


def ties(spark, tmp_path):
    """Rows of which some have one time, as a Parquet file, whose order is that of arrival."""
    from tideql.engine import Engine

    spark.createDataFrame([(n, k, v, t) for n, k, v, t in ROWS], "name string, kind string, v double, t bigint").coalesce(1).write.parquet(str(tmp_path / "ties"))
    e = Engine(spark)
    e.attach("s", lambda: spark.read.parquet(str(tmp_path / "ties")), "t", "stream")
    return e


def test_downsampling_takes_the_first_of_one_time(spark, tmp_path):
    from tideql.operators import sampling

    _, df = ties(spark, tmp_path).source("s")
    assert sorted((r.interval_end, r.name) for r in sampling.latest(df, 10).collect()) == [(10, "f"), (20, "h")]
    got = {r.interval_end: [(f["kind"], f["name"]) for f in r.frames] for r in sampling.merged(df, 10, "kind").collect()}
    assert got == {10: [("error", "f"), ("signup", "c"), ("view", "g")], 20: [("signup", "h"), ("view", "i")]}


def test_rows_of_one_time_are_one_step_of_begin_and_reset(spark, tmp_path):
    got = {r.name: r.n for r in ties(spark, tmp_path).sql("SELECT name, acc_count(v, kind = 'signup', kind = 'error') AS n FROM s").collect()}
    assert got == {"a": 2, "b": 2, "c": 5, "d": 5, "e": 5, "f": 6, "g": 0, "h": 2, "i": 2}


def test_rows_of_one_time_are_in_one_state_window(spark, tmp_path):
    e = ties(spark, tmp_path)
    assert sorted((r.c, r.a, r.z) for r in e.sql("SELECT count(*) AS c, min(name) AS a, max(name) AS z FROM s GROUP BY STATEWINDOW(kind = 'signup')").collect()) == [(2, "a", "b"), (5, "c", "g")]


def test_deduplicate_last_takes_the_first_of_one_time(spark, tmp_path):
    e = ties(spark, tmp_path)
    got = e.sql("SELECT window_end() AS e, deduplicate(kind, false)->name AS n FROM s GROUP BY TUMBLINGWINDOW(ms, 10)").collect()
    assert sorted((r.e, r.n) for r in got) == [(10, "f"), (20, "h")]
    got = e.sql("SELECT window_end() AS e, deduplicate(kind, true) AS n FROM s GROUP BY TUMBLINGWINDOW(ms, 10)").collect()
    assert sorted((r.e, [x["name"] for x in r.n]) for r in got) == [(10, ["a", "b", "f"]), (20, ["h", "i"])]


SLIDING = [
    "SELECT window_end() AS e, count(*) AS c, count(v) AS k, sum(v) AS s, min(v) AS lo, max(name) AS hi, avg(n) AS a, avg(v) AS b, sum(n) AS w FROM s GROUP BY SLIDINGWINDOW(ms, 20{})",
    "SELECT window_start() AS a, sum(v) FILTER(WHERE n > 2) AS s, count(*) AS c, c + 1 AS d FROM s WHERE kind = 'x' GROUP BY SLIDINGWINDOW(ms, 7{}) FILTER(WHERE n > 0) OVER(WHEN v > 3) HAVING c > 1",
]


def test_sliding_totals_have_no_row_for_each_row_of_a_window(spark):
    from tideql.engine import Engine

    r = random.Random(3)
    rows = [(f"n{i}", r.choice("xy"), r.choice([None, *map(float, range(9))]), r.randrange(5), r.randrange(-60, 240)) for i in range(300)]
    e = Engine(spark)
    e.register("s", spark.createDataFrame(rows, "name string, kind string, v double, n bigint, t bigint"), "t")
    for text in SLIDING:
        for delay in ("", ", 5", ", 13"):
            text_ = text.format(delay)
            fast = e.sql(text_)
            assert "Generate" not in plan(fast)
            # With a collected value the rows of each window are there themselves.
            slow = e.sql(text_.replace(" FROM s", ", collect(v) AS all_ FROM s")).drop("all_")
            assert fast.columns == slow.columns and fast.schema.simpleString() == slow.schema.simpleString()
            plain = lambda df: sorted((tuple(x) for x in df.collect()), key=repr)
            assert plain(fast) == plain(slow)


def test_hits_sort_blocks_of_named_columns_in_one_task(spark, tmp_path, monkeypatch):
    from tideql.engine import Engine
    from tideql.operators import hits

    monkeypatch.setattr(hits, "BLOCK", 7)
    r = random.Random(5)
    rows = [(i, "x" * 50, r.randrange(900)) for i in range(400)]
    spark.createDataFrame(rows, "i bigint, wide string, t bigint").coalesce(1).write.parquet(str(tmp_path / "hits"))
    e = Engine(spark)
    e.attach("s", lambda: spark.read.parquet(str(tmp_path / "hits")), "t", "stream")
    df = e.sql("SELECT i FROM s WHERE event_time() - last_hit_time() > 30 AND last_hit_count() < 12")
    want, at = [], 0
    for i, _, t in sorted(rows, key=lambda x: (x[2], x[0])):
        if t - at > 30 and len(want) < 12:
            want.append(i)
            at = t
    assert [x.i for x in df.collect()] == want
    assert "rangepartitioning" in plan(df) and "wide" not in df._jdf.queryExecution().executedPlan().toString()
