"""Sinks: what a rule's actions do with its rows, batch or micro-batch."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.conversions import packers
from . import services
from .readers import publish

_CUSTOM: dict[str, Callable[[DataFrame, dict], None]] = {}
EXTERNAL = {"websocket", "sse", "neuron", "edgex", "image", "zmq"}


#: Rows of a message where sendSingle is false and no batchSize is given.
MESSAGE = 1000


class SinkProblem(ValueError):
    """The action can't be done."""


def register_sink(name: str, write: Callable[[DataFrame, dict], None]) -> None:
    """``write(df, options)`` is called with each batch."""
    _CUSTOM[name.lower()] = write


def transformed(df: DataFrame, options: dict) -> DataFrame:
    """dataField, fields, excludeFields, omitIfEmpty, dataTemplate and sendSingle, in this order."""
    if name := options.get("dataField"):
        df = df.select(f"{name}.*") if df.schema[name].dataType.typeName() == "struct" else df.select(F.explode(name).alias("_x")).select("_x.*")
    if names := options.get("fields"):
        df = df.select(*names)
    if names := options.get("excludeFields"):
        df = df.drop(*names)
    if options.get("omitIfEmpty"):
        df = df.na.drop("all")
    if text := options.get("dataTemplate"):
        return df.select(template(df, text).alias("value"))
    if options.get("sendSingle") is False:
        return batches(df, int(options.get("batchSize", MESSAGE)))
    return df


def batches(df: DataFrame, size: int) -> DataFrame:
    """``rows``: up to ``size`` rows each; only each task's last may have fewer."""
    schema = T.StructType([T.StructField("rows", T.ArrayType(df.schema))])

    def run(found):
        waiting: list = []
        for batch in found:
            waiting += pa.Table.from_batches([batch]).to_pylist()
            full = len(waiting) - len(waiting) % size
            if full:
                yield out([waiting[i : i + size] for i in range(0, full, size)])
                del waiting[:full]
        if waiting:
            yield out([waiting])

    def out(lists):
        return pa.RecordBatch.from_arrays([pa.array(lists, kind)], ["rows"])

    kind = pa.list_(pa.struct(list(to_arrow_schema(df.schema))))
    return df.mapInArrow(run, schema)


def template(df: DataFrame, text: str):
    """Text with ``{{.name}}`` and ``{{.a.b}}`` replaced by values, ``{{json .}}`` by the row as JSON."""
    out, at = [], 0
    for m in re.finditer(r"\{\{\s*(json\s+)?\.([\w.]*)\s*\}\}", text):
        out.append(F.lit(text[at : m.start()]))
        row = F.struct(*df.columns) if not m[2] else F.col(m[2])
        out.append(F.to_json(row) if m[1] and (not m[2] or df.select(row).schema[0].dataType.typeName() in ("struct", "array", "map")) else F.coalesce(row.cast("string"), F.lit("")))
        at = m.end()
    out.append(F.lit(text[at:]))
    return F.concat(*out)


def encoded(df: DataFrame, options: dict) -> DataFrame:
    """One column ``value``: JSON without null fields (with them if sendNil), or delimited; then compressed and encrypted."""
    if df.columns == ["value"]:
        value = F.col("value").cast("string")
    elif options.get("format", "json") == "delimited":
        value = F.to_csv(F.struct(*df.columns), {"sep": options.get("delimiter", ",")})
    else:
        value = F.to_json(F.struct(*df.columns), {"ignoreNullFields": str(not options.get("sendNil", False)).lower()})
    if how := options.get("compression"):
        def pack(s: pd.Series) -> pd.Series:
            return s.map(lambda x: packers()[how][0](x.encode()))

        value = F.pandas_udf(pack, "binary")(value)
    if key := options.get("encryptionKey"):
        value = F.aes_encrypt(value.cast("binary"), F.lit(key), F.lit(options.get("encryptionMode", "GCM").upper()))
    return df.select(value.alias("value"))


def upsert(old: DataFrame | None, df: DataFrame, key: str, kind: str = "rowkind") -> DataFrame:
    """``old`` after insert, update, upsert and delete rows, the last row of each key deciding."""
    columns = [c for c in df.columns if c not in (kind, "_ts", "_o")]
    last = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col("_ts") if "_ts" in df.columns else F.lit(0)).alias("r")).select("r.*")
    kept = last.filter(F.coalesce(F.col(kind), F.lit("upsert")) != "delete").select(*columns)
    return kept if old is None else old.join(last, key, "left_anti").select(*columns).unionByName(kept)


def rest(df: DataFrame, options: dict) -> None:
    """POST (or ``method``) to ``url``: a request a row, or a JSON array of up to ``batchSize`` rows each; tasks send side by side."""
    url, method, size = options["url"], options.get("method", "post").upper(), int(options.get("batchSize", 1))
    headers = {"Content-Type": "application/json"} | options.get("headers", {})

    def send(batches):
        import urllib.request

        waiting: list[str] = []

        def flush():
            body = waiting[0] if size == 1 else "[" + ",".join(waiting) + "]"
            with urllib.request.urlopen(urllib.request.Request(url, body.encode(), headers, method=method), timeout=options.get("timeout", 5)):  # noqa: S310
                waiting.clear()

        for batch in batches:
            for text in batch["value"]:
                waiting.append(text)
                if len(waiting) == size:
                    flush()
            yield pd.DataFrame({"n": [len(batch)]})
        if waiting:
            flush()

    encoded(df, {k: v for k, v in options.items() if k in ("sendNil", "format", "delimiter")}).mapInPandas(send, "n bigint").write.format("noop").mode("overwrite").save()


def write(df: DataFrame, kind: str, options: dict | None = None) -> None:
    options, kind = dict(options or {}), kind.lower()
    if kind == "memory":
        publish(options["topic"], transformed(df, options))
        return
    own = kind in ("influx", "influx2", "tdengine3", "sql")  # their fields are what they write, of the columns that they use
    df = transformed(df, {k: v for k, v in options.items() if not (own and k == "fields")})
    sent = {"mqtt": services.mqtt, "redis": services.redis, "redispub": services.redis_pub, "kafka": services.kafka, "tdengine3": services.tdengine, "influx": lambda d, o: services.influx(d, o, 1), "influx2": lambda d, o: services.influx(d, o, 2)}
    if kind in _CUSTOM:
        _CUSTOM[kind](df, options)
    elif kind in sent:
        try:
            sent[kind](df, options)
        except KeyError as e:
            raise SinkProblem(f"{kind} needs {e}") from e
    elif kind == "rest":
        rest(df, options)
    elif kind == "nop":
        df.write.format("noop").mode("overwrite").save()
    elif kind in ("log", "logtomemory"):
        df.show(options.get("rows", 20), truncate=False)
    elif kind == "file":
        form = options.get("fileType", "json")
        writer = df.write.mode(options.get("mode", "append"))
        if rows := options.get("rollingCount"):
            writer = writer.option("maxRecordsPerFile", rows)
        if how := options.get("compression"):
            writer = writer.option("compression", how)
        if form == "lines":
            encoded(df, {k: v for k, v in options.items() if k != "compression"}).write.mode(options.get("mode", "append")).text(options["path"])
        else:
            getattr(writer.option("header", options.get("hasHeader", True)) if form == "csv" else writer, form)(options["path"])
    elif kind == "sql" and "module" in options:
        services.database(df, options)
    elif kind == "sql":
        if options.get("rowkindField"):
            raise SinkProblem("rowkindField needs module and connect, a Python database client")
        df.write.jdbc(options["url"], options["table"], mode="append", properties=options.get("properties"))
    elif kind in EXTERNAL:
        raise SinkProblem(f"no client for {kind}; register_sink({kind!r}, ...) adds one")
    else:
        raise SinkProblem(f"unknown sink {kind!r}")
