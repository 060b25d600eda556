"""Sources: what a definition's TYPE and FORMAT read, bounded or as a stream."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conversions import packers
from ..sql import tree as t
from . import services

#: Connectors for services that this library has no client for; ``register_source`` puts one in their place.
EXTERNAL = {"httppush", "websocket", "neuron", "edgex", "zmq"}
_CUSTOM: dict[str, Callable[[SparkSession, t.Definition, bool], DataFrame]] = {}


class SourceProblem(ValueError):
    """The source can't be read."""


def register_source(name: str, read: Callable[[SparkSession, t.Definition, bool], DataFrame]) -> None:
    """``read(spark, definition, streaming)`` gives the DataFrame of a TYPE."""
    _CUSTOM[name.lower()] = read


def schema_of(d: t.Definition) -> T.StructType | None:
    if not d.columns:
        return None
    return T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k, _ in d.columns])


def _file(spark: SparkSession, d: t.Definition, streaming: bool) -> DataFrame:
    """A file or folder: json (lines, or a document), delimited, lines, parquet, urlencoded, binary."""
    path, kind, schema = d.options["DATASOURCE"], d.options.get("FORMAT", "json").lower(), schema_of(d)
    reader = spark.readStream if streaming else spark.read
    if kind in ("json", "jsondocument", "delimited", "csv", "parquet") and schema is not None:
        reader = reader.schema(schema)
    if kind == "json":
        return reader.json(path)
    if kind == "jsondocument":
        return reader.option("multiLine", True).json(path)
    if kind in ("delimited", "csv"):
        return reader.option("sep", d.options.get("DELIMITER", ",")).option("header", schema is None).csv(path)
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "binary":
        return reader.format("binaryFile").load(path).select(F.col("content").alias("self"), F.col("path").alias("file"))
    if kind == "lines":
        return reader.text(path).withColumnRenamed("value", "line")
    if kind == "urlencoded":
        return urlencoded(reader.text(path), "value", schema)
    raise SourceProblem(f"unknown format {kind!r}")


def urlencoded(df: DataFrame, column: str, schema: T.StructType | None) -> DataFrame:
    pairs = F.str_to_map(F.col(column), F.lit("&"), F.lit("="))
    df = df.select(F.map_from_entries(F.transform(F.map_entries(pairs), lambda e: F.struct(F.url_decode(e["key"]), F.url_decode(e["value"])))).alias("m"))
    if schema is None:
        return df.select(F.col("m").alias("self"))
    return df.select(*[F.try_element_at("m", F.lit(f.name)).try_cast(f.dataType).alias(f.name) for f in schema])


def decode(df: DataFrame, column: str, kind: str, schema: str, merge: bool = True, options: dict | None = None) -> DataFrame:
    """The payload in a column as columns beside the others; an array of objects makes a row of each."""
    text = F.col(column).cast("string")
    value = {"json": lambda: F.from_json(text, schema, options or {}), "delimited": lambda: F.from_csv(text, schema, options or {})}[kind]()
    df = df.withColumn("_p", value)
    if schema.lower().startswith("array"):
        df = df.withColumn("_p", F.explode("_p"))
    return df.select(*([c for c in df.columns if c != "_p"] if merge else []), "_p.*")


def decompress(df: DataFrame, column: str, how: str) -> DataFrame:
    def run(s):
        f = packers()[how][1]
        return s.map(lambda b: None if b is None else f(bytes(b)))

    import pandas as pd

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return df.withColumn(column, F.pandas_udf(run, "binary")(F.col(column)))


def validated(df: DataFrame, d: t.Definition) -> DataFrame:
    """STRICT_VALIDATION: declared types by conversion, defaults for what is missing; rows that can't be converted go."""
    if d.options.get("STRICT_VALIDATION", "false").lower() != "true":
        return df
    out, ok = [], F.lit(True)
    for n, k, default in d.columns:
        c = F.col(n).try_cast(k) if n in df.columns else F.lit(None).cast(k)
        if n in df.columns:
            ok = ok & (F.col(n).isNull() | c.isNotNull())
        out.append((F.coalesce(c, F.lit(default.value).cast(k)) if default else c).alias(n))
    return df.filter(ok).select(*out, *[c for c in df.columns if c.startswith("_")])


def timed(df: DataFrame, column: str | None, form: str | None = None) -> DataFrame:
    """``_ts``, the event time, from milliseconds, a text or a timestamp."""
    if column is None:
        return df
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(kind, T.NumericType):
        time = F.timestamp_millis(c.cast("bigint"))
    elif isinstance(kind, T.StringType):
        time = F.to_timestamp(c, form) if form else c.cast("timestamp")
    else:
        time = c.cast("timestamp")
    return df.withColumn("_ts", time)


def placed(df: DataFrame) -> DataFrame:
    """``_o``, an order of arrival among rows of one time that is the same on every run; only rules that depend on it ask for it.

    Rows of Parquet files are in the order of the files' rows, which reads no column; others are told apart by a hash
    of what they hold.
    """
    if "_o" in df.columns or "_ts" not in df.columns:
        return df
    if not df.isStreaming and (place := _row_of_file(df)) is not None:
        return df.withColumn("_o", place)
    plain = [x for x in df.columns if not x.startswith("_") and not isinstance(df.schema[x].dataType, (T.MapType, T.VariantType))]
    return df.withColumn("_o", F.xxhash64(*[F.col(f"`{x}`") for x in plain]))


def _row_of_file(df: DataFrame) -> Column | None:
    """A row's place in its Parquet file, after the file's hash, as one number; None where rows are of no file."""
    place = F.shiftleft(F.pmod(F.hash("_metadata.file_path"), F.lit(1 << 22)).cast("long"), 40) + F.col("_metadata.row_index")
    try:
        df.select(place)
    except AnalysisException:
        return None
    return place


def read(spark: SparkSession, d: t.Definition, streaming: bool = False) -> DataFrame:
    kind = d.options.get("TYPE", "file").lower()
    if kind in _CUSTOM:
        df = _CUSTOM[kind](spark, d, streaming)
    elif kind == "file":
        df = _file(spark, d, streaming)
    elif kind == "memory":
        df = memory(spark, d.options["DATASOURCE"])
    elif kind == "sql":
        df = database(spark, d.options["DATASOURCE"], _extra(d))
    elif kind == "video":  # frames that a grabber has left as files
        df = (spark.readStream if streaming else spark.read).format("binaryFile").load(d.options["DATASOURCE"]).select(F.col("content").alias("self"), F.col("path").alias("file"), F.unix_millis("modificationTime").alias("time"))
    elif kind == "httppull":
        df = httppull(spark, [u.strip() for u in d.options["DATASOURCE"].split(",")], schema_of(d))
    elif kind == "kafka":
        more = _extra(d)
        reader = (spark.readStream if streaming else spark.read).format("kafka").option("subscribe", d.options["DATASOURCE"]).option("kafka.bootstrap.servers", more.get("brokers", "localhost:9092"))
        df = payloads(reader.load().select(F.col("value").alias("payload"), "topic"), d)
    elif kind in ("mqtt", "redissub"):
        more = _extra(d)
        if "server" not in more:
            raise SourceProblem(f"{kind} needs a server in EXTRA; register_source({kind!r}, ...) puts another client in its place")
        df = payloads(services.messages(spark, "mqtt" if kind == "mqtt" else "redis", more.pop("server"), d.options["DATASOURCE"], more, streaming), d)
    elif kind in EXTERNAL:
        raise SourceProblem(f"no client for {kind}; register_source({kind!r}, ...) adds one")
    else:
        raise SourceProblem(f"unknown source type {kind!r}")
    return timed(validated(df, d), d.options.get("TIMESTAMP"), d.options.get("TIMESTAMP_FORMAT"))


def _extra(d: t.Definition) -> dict:
    """EXTRA's JSON, whose quotes may stand escaped."""
    text = d.options.get("EXTRA", "{}")
    return json.loads(text if '\\"' not in text else text.replace('\\"', '"'))


def payloads(df: DataFrame, d: t.Definition) -> DataFrame:
    """Messages as rows: the declared columns of a JSON or delimited payload; without declared columns the payload's text beside its topic."""
    schema = schema_of(d)
    if schema is None:
        return df.withColumn("payload", F.col("payload").cast("string"))
    return decode(df.select("payload"), "payload", {"csv": "delimited"}.get(k := d.options.get("FORMAT", "json").lower(), k), schema.simpleString(), merge=False)


def database(spark: SparkSession, url: str, options: dict) -> DataFrame:
    """A table or query over JDBC; with ``column``, ``lower``, ``upper`` and ``parts`` read side by side, with ``after`` only newer rows of ``index``."""
    reader = spark.read.format("jdbc").option("url", url)
    for k, v in options.get("properties", {}).items():
        reader = reader.option(k, v)
    if "column" in options:
        reader = reader.option("partitionColumn", options["column"]).option("lowerBound", options["lower"]).option("upperBound", options["upper"]).option("numPartitions", options["parts"])
    df = (reader.option("query", options["query"]) if "query" in options else reader.option("dbtable", options["table"])).load()
    return df.filter(F.col(options["index"]) > F.lit(options["after"])) if "after" in options else df


def httppull(spark: SparkSession, urls: list[str], schema: T.StructType | None, seconds: float = 10) -> DataFrame:
    """The JSON that each address answers with, an object or an array of them; one task an address.  An address that fails fails the read."""

    def get(batches):
        import urllib.request

        for batch in batches:
            bodies = []
            for url in batch["url"]:
                with urllib.request.urlopen(url, timeout=seconds) as answer:  # noqa: S310
                    bodies.append(answer.read().decode())
            yield batch.assign(body=bodies)

    df = spark.createDataFrame([(u,) for u in urls], "url string").repartition(len(urls)).mapInPandas(get, "url string, body string")
    if schema is None:
        return df
    text = F.trim("body")
    rows = F.from_json(F.when(F.startswith(text, F.lit("[")), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), T.ArrayType(schema))
    return df.select(F.explode(rows).alias("_x")).select("_x.*")


# --- in-process topics

_TOPICS: dict[str, DataFrame] = {}


def publish(topic: str, df: DataFrame) -> None:
    _TOPICS[topic] = df


def _fits(pattern: str, topic: str) -> bool:
    p, q = pattern.split("/"), topic.split("/")
    for i, x in enumerate(p):
        if x == "#":
            return True
        if i >= len(q) or x not in ("+", q[i]):
            return False
    return len(p) == len(q)


def memory(spark: SparkSession, pattern: str) -> DataFrame:
    """The rows of every topic that fits; ``+`` stands for one level, ``#`` for all that follow."""
    found = [df for topic, df in sorted(_TOPICS.items()) if _fits(pattern, topic)]
    if not found:
        raise SourceProblem(f"no topic {pattern!r}")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def retained(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of a scan table: by time; without one by their places in Parquet files, or in the order in which they are read."""
    if "_ts" not in df.columns:
        place = _row_of_file(df)
        return df.withColumn("_o", F.monotonically_increasing_id() if place is None else place).orderBy(F.desc("_o")).limit(n).drop("_o")
    return placed(df).orderBy(F.desc("_ts"), F.desc("_o")).limit(n)


# --- generators

def simulator(spark: SparkSession, rows: list[dict], schema: str, loop: int = 1) -> DataFrame:
    """The listed rows, ``loop`` times over."""
    one = spark.createDataFrame([tuple(r.get(f.name) for f in T._parse_datatype_string(schema)) for r in rows], schema)
    return one if loop == 1 else one.crossJoin(spark.range(loop).select(F.col("id").alias("_loop"))).drop("_loop")


def random_ints(spark: SparkSession, n: int, seed: int, below: int = 50, deduplicate: bool = False) -> DataFrame:
    df = spark.range(n).select("id", F.floor(F.rand(seed) * below).cast("bigint").alias("count"))
    return df.dropDuplicates(["count"]) if deduplicate else df


def nexmark(spark: SparkSession, n: int, seed: int = 1, start_ms: int = 1_541_152_486_000) -> DataFrame:
    """Persons, auctions and bids 1 : 3 : 46, as an event_type and a struct of each kind."""
    h = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(seed * 100 + salt)), F.lit(m))
    k = F.col("id") % 50
    kind = F.when(k < 1, "person").when(k < 4, "auction").otherwise("bid")
    time = F.timestamp_millis(F.lit(start_ms) + F.col("id") * 10)
    person = F.struct(F.col("id").alias("id"), F.concat(F.lit("name"), h(1, 1000)).alias("name"), F.concat(F.lit("user"), "id", F.lit("@example.com")).alias("emailAddress"), F.concat(F.lit("4000"), h(2, 10**12)).alias("creditCard"), F.element_at(F.array(*map(F.lit, ["Oslo", "Lima", "Cairo", "Pune"])), (h(3, 4) + 1).cast("int")).alias("city"), F.element_at(F.array(*map(F.lit, ["OR", "CA", "WA"])), (h(4, 3) + 1).cast("int")).alias("state"), time.alias("dateTime"))
    auction = F.struct(F.col("id").alias("id"), F.concat(F.lit("item"), h(5, 5000)).alias("itemName"), (h(6, 100) + 1).alias("initialBid"), (h(7, 1000) + 100).alias("reserve"), time.alias("dateTime"), (time + F.expr("interval 10 seconds")).alias("expires"), h(8, 1000).alias("seller"), h(9, 10).alias("category"))
    bid = F.struct(h(10, 1000).alias("auction"), h(11, 1000).alias("bidder"), (h(12, 10_000) + 1).alias("price"), time.alias("dateTime"))
    return spark.range(n).select("id", kind.alias("event_type"), time.alias("ts"), F.when(kind == "person", person).alias("person"), F.when(kind == "auction", auction).alias("auction"), F.when(kind == "bid", bid).alias("bid"))
