"""Intermediate tables in the folder that the cluster shares.

A table written there is read again however often executors are lost; it takes
the place of a cached or locally checkpointed frame.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset on a single machine, as in tests, one of our own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tideql-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Innermost last: the computations begun within each ``scope``.
_SCOPES: list[list[Scratch]] = []


class Scratch:
    """Tables of one computation; each can be dropped once it is no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/tideql-{uuid.uuid4().hex}", 0
        atexit.register(self.clear)
        if _SCOPES:
            _SCOPES[-1].append(self)

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tideql_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._tideql_path)

    def clear(self) -> None:
        """Drop all tables."""
        atexit.unregister(self.clear)
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        if context._jsc is None or context._jvm is None:  # the session has ended
            return
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scope() -> Iterator[None]:
    """Drops, at its end, the tables of all computations begun within; what they gave must have been written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for scratch in _SCOPES.pop():
            scratch.clear()
