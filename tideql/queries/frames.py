"""Queries that are more than one rule: tables that keep rows, graphs, routing, down-sampling, topics, extensions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import build
from ..operators import sampling, windows
from ..operators.dedup_trigger import uncovered
from ..sources import readers, sinks
from .base import engine

# The names of graph rules in JSON (nodes, topo, edges, nodeType, props and those of the operators).

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT e.event_id, t.value AS last FROM events e JOIN (SELECT user_id, value FROM events ORDER BY ts DESC LIMIT 100) t ON e.user_id = t.user_id")
def join_scan_table_retain(spark, sf_dir):
    """A scan table keeps its last 100 rows."""
    e = engine(spark, sf_dir)
    rows = readers.timed(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts")
    e.register("recent", readers.retained(rows, 100).select("user_id", "value"), kind="table")
    return e.sql("SELECT event_id, recent.value AS last FROM events INNER JOIN recent ON events.user_id = recent.user_id")


@query("SELECT event_type, round(sum(value), 2) AS s FROM events WHERE value > 20 GROUP BY event_type")
def graph_pipeline(spark, sf_dir):
    graph = {
        "nodes": {
            "src": {"type": "source", "nodeType": "file", "props": {"sourceName": "events"}},
            "keep": {"type": "operator", "nodeType": "filter", "props": {"expr": "value > 20"}},
            "by": {"type": "operator", "nodeType": "groupby", "props": {"dimensions": ["event_type"]}},
            "sum": {"type": "operator", "nodeType": "aggfunc", "props": {"expr": "round(sum(value), 2) AS s"}},
            "out": {"type": "sink", "nodeType": "nop", "props": {}},
        },
        "topo": {"sources": ["src"], "edges": {"src": ["keep"], "keep": ["by"], "by": ["sum"], "sum": ["out"]}},
    }
    return build(engine(spark, sf_dir), graph)


@query("SELECT (epoch_ms(ts) // 3600000 + 1)::BIGINT * 3600000 AS window_end, max(value) AS m FROM events GROUP BY 1")
def graph_window(spark, sf_dir):
    graph = {
        "nodes": {
            "events": {"type": "source", "nodeType": "file", "props": {}},
            "win": {"type": "operator", "nodeType": "window", "props": {"type": "tumblingwindow", "unit": "hh", "size": 1}},
            "agg": {"type": "operator", "nodeType": "aggfunc", "props": {"expr": "max(value) AS m"}},
        },
        "topo": {"sources": ["events"], "edges": {"events": ["win"], "win": ["agg"]}},
    }
    return build(engine(spark, sf_dir), graph)


@query("SELECT event_id, v2 FROM (SELECT event_id, value * 2 AS v2, event_type FROM events) WHERE event_type = 'click' AND v2 > 100")
def graph_switch(spark, sf_dir):
    """A row goes to its first case; the second port's rows are picked."""
    graph = {
        "nodes": {
            "events": {"type": "source", "nodeType": "file", "props": {}},
            "f": {"type": "operator", "nodeType": "function", "props": {"expr": "value * 2 AS v2"}},
            "sw": {"type": "operator", "nodeType": "switch", "props": {"cases": ["event_type != 'click'", "v2 > 100"], "stopAtFirstMatch": True}},
            "a": {"type": "operator", "nodeType": "pick", "props": {"fields": ["event_id"]}},
            "b": {"type": "operator", "nodeType": "pick", "props": {"fields": ["event_id", "v2"]}},
        },
        "topo": {"sources": ["events"], "edges": {"events": ["f"], "f": ["sw"], "sw": [["a"], ["b"]]}},
        "result": "b",
    }
    return build(engine(spark, sf_dir), graph)


@query("SELECT s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def graph_join(spark, sf_dir):
    graph = {
        "nodes": {
            "supplier": {"type": "source", "nodeType": "file", "props": {}},
            "nation": {"type": "source", "nodeType": "file", "props": {}},
            "j": {"type": "operator", "nodeType": "join", "props": {"from": "supplier", "joins": [{"name": "nation", "type": "left", "on": "supplier.s_nationkey = nation.n_nationkey"}]}},
            "o": {"type": "operator", "nodeType": "orderby", "props": {"sorts": [{"field": "s_name", "order": "desc"}]}},
            "p": {"type": "operator", "nodeType": "pick", "props": {"fields": ["s_name", "n_name"]}},
        },
        "topo": {"sources": ["supplier", "nation"], "edges": {"supplier": ["j"], "nation": ["j"], "j": ["o"], "o": ["p"]}},
    }
    return build(engine(spark, sf_dir), graph)


@query("SELECT (epoch_ms(ts) // 3600000 + 1)::BIGINT * 3600000 AS interval_end, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY 1")
def downsample_latest(spark, sf_dir):
    _, df = engine(spark, sf_dir).source("events")
    return sampling.latest(df, 3_600_000).select("interval_end", "event_id", "value")


@query("SELECT interval_end, count(*) AS n, list(event_id ORDER BY event_type) AS ids FROM (SELECT (epoch_ms(ts) // 3600000 + 1)::BIGINT * 3600000 AS interval_end, event_type, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1, 2) GROUP BY 1")
def downsample_merge_field(spark, sf_dir):
    _, df = engine(spark, sf_dir).source("events")
    out = sampling.merged(df, 3_600_000, "event_type")
    return out.select("interval_end", F.size("frames").cast("long").alias("n"), F.transform("frames", lambda r: r["event_id"]).alias("ids"))


@query("SELECT b * 600000 AS window_start, count(event_id) AS c FROM (SELECT unnest(range(min(epoch_us(ts) // 600000000), max(epoch_us(ts) // 600000000) + 1)) AS b FROM events) LEFT JOIN events ON epoch_us(ts) // 600000000 = b GROUP BY b")
def tumbling_every_window(spark, sf_dir):
    """With empty windows, from the first to the last that has rows."""
    found = engine(spark, sf_dir).sql("SELECT window_start() AS a, count(*) AS c FROM events GROUP BY TUMBLINGWINDOW(mi, 10)")
    ends = found.select(F.timestamp_millis("a").alias("window_start"), F.timestamp_millis(F.col("a") + 600_000).alias("window_end"), "c")
    first, last = found.agg(F.min("a"), F.max("a")).first()
    out = windows.every_window(ends, first, last + 1, 600_000, 600_000)
    return out.select(F.unix_millis("window_start").alias("window_start"), F.coalesce("c", F.lit(0).cast("bigint")).alias("c"))


@query("SELECT event_id, value FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, value FROM events WHERE event_type = 'view'")
def memory_topics(spark, sf_dir):
    """Two rules publish, a third reads both by a pattern."""
    e = engine(spark, sf_dir)
    for kind in ("click", "view"):
        sinks.write(e.sql(f"SELECT event_id, value FROM events WHERE event_type = '{kind}'"), "memory", {"topic": f"shop/{kind}/rows"})
    e.sql("CREATE STREAM shop () WITH (DATASOURCE=\"shop/+/rows\", TYPE=\"memory\")")
    return e.sql("SELECT event_id, value FROM shop")


@query("SELECT o_orderkey AS o, o_totalprice AS p FROM orders WHERE o_totalprice > 400000")
def ddl_file_stream(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.sql(f"CREATE STREAM o2 () WITH (DATASOURCE=\"{sf_dir}/orders.parquet\", FORMAT=\"parquet\", TYPE=\"file\", TIMESTAMP=\"o_orderdate\")")
    return e.sql("SELECT o_orderkey AS o, o_totalprice AS p FROM o2 WHERE o_totalprice > 400000")


@query("SELECT 'doc ' || doc_id || ' in ' || coalesce(lang, '') AS value FROM documents")
def sink_template(spark, sf_dir):
    """A rule's rows through a template into a topic, and from there into another rule."""
    e = engine(spark, sf_dir)
    sinks.write(e.sql("SELECT doc_id, lang FROM documents"), "memory", {"topic": "texts", "dataTemplate": "doc {{.doc_id}} in {{.lang}}"})
    e.sql('CREATE STREAM texts () WITH (DATASOURCE="texts", TYPE="memory")')
    return e.sql("SELECT value FROM texts")


@query("SELECT event_id, user_id, value FROM events")
def payload_json(spark, sf_dir):
    """Rows packed as JSON in one column, and decoded from it beside another."""
    df = engine(spark, sf_dir).source("events")[1].select("event_id", F.to_json(F.struct("user_id", "value")).alias("payload"))
    return readers.decode(df, "payload", "json", "struct<user_id: bigint, value: double>").select("event_id", "user_id", "value")


@query("SELECT event_id, event_type || '-' || k AS n FROM events, (VALUES (0), (1)) v(k)")
def payload_array(spark, sf_dir):
    """An array of objects in a payload is a row for each."""
    df = engine(spark, sf_dir).source("events")[1].select("event_id", F.to_json(F.array(*[F.struct(F.concat("event_type", F.lit(f"-{k}")).alias("n")) for k in (0, 1)])).alias("payload"))
    return readers.decode(df, "payload", "json", "array<struct<n: string>>").select("event_id", "n")


@query("SELECT event_id, event_type, value FROM events")
def payload_delimited(spark, sf_dir):
    df = engine(spark, sf_dir).source("events")[1].select("event_id", F.to_csv(F.struct("event_type", "value")).alias("payload"))
    return readers.decode(df, "payload", "delimited", "event_type string, value double").select("event_id", "event_type", "value")


@query("SELECT event_id, event_type || ' & more=' AS t FROM events")
def urlencoded_rows(spark, sf_dir):
    df = engine(spark, sf_dir).source("events")[1]
    text = F.concat(F.lit("event_id="), "event_id", F.lit("&t="), F.url_encode(F.concat("event_type", F.lit(" & more="))))
    schema = spark.createDataFrame([], "event_id bigint, t string").schema
    return readers.urlencoded(df.select(text.alias("value")), "value", schema)


@query("SELECT event_id, value FROM (SELECT DISTINCT ON (user_id) user_id, event_id, value, event_type FROM events ORDER BY user_id, ts DESC) WHERE event_type <> 'error'")
def sink_upsert(spark, sf_dir):
    """The last row of each user; errors delete."""
    df = engine(spark, sf_dir).source("events")[1].select("user_id", "event_id", "value", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("rowkind"), "_ts")
    return sinks.upsert(None, df, "user_id").select("event_id", "value")


@query(
    "WITH r AS (SELECT event_id, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + user_id * 20000 + 1000 AS e FROM events), x AS (SELECT DISTINCT unnest([s, e]) AS x FROM r), a AS (SELECT x, lead(x) OVER (ORDER BY x) AS y FROM x), "
    "o AS (SELECT a.x, a.y, arg_min(event_id, (e, s)) AS event_id FROM a JOIN r ON r.s <= a.x AND a.y <= r.e WHERE a.y IS NOT NULL GROUP BY a.x, a.y) SELECT event_id, sum(y - x)::BIGINT AS ms FROM o GROUP BY event_id"
)
def dedup_trigger(spark, sf_dir):
    """Of time spans in order of their end, the time that each is the first to cover."""
    df = engine(spark, sf_dir).source("events")[1]
    spans = df.select("event_id", F.unix_millis("_ts").alias("s"), (F.unix_millis("_ts") + F.col("user_id") * 20000 + 1000).alias("e"))
    out = uncovered(spans, "s", "e")
    return out.select("event_id", F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["end_key"] - p["start_key"]).alias("ms"))


@query(None)
def udf_geohash(spark, sf_dir):
    return engine(spark, sf_dir).sql("SELECT event_id, geohashEncode(value - 20, user_id - 75.0) AS g, geohashDecode(geohashEncode(value - 20, user_id - 75.0))->latitude AS lat, geohashNeighbor(geohashEncode(value - 20, user_id - 75.0), 'North') AS n FROM events")


@query("SELECT event_type, count(*) + 1 AS c FROM events GROUP BY event_type")
def udaf_count_plus_one(spark, sf_dir):
    return engine(spark, sf_dir).sql("SELECT event_type, countPlusOne(value) AS c FROM events GROUP BY event_type")


@query("SELECT 46000::BIGINT AS n, 'bid' AS event_type UNION ALL SELECT 3000, 'auction' UNION ALL SELECT 1000, 'person'")
def nexmark_mix(spark, sf_dir):
    return readers.nexmark(spark, 50_000).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT i // 3 AS loop, i % 3 AS a FROM range(9) t(i)")
def simulator_rows(spark, sf_dir):
    df = readers.simulator(spark, [{"a": 0}, {"a": 1}, {"a": 2}], "a bigint", loop=3)
    return df.withColumn("loop", F.row_number().over(Window.partitionBy("a").orderBy("a")).cast("bigint") - 1)
