"""Repeated passages by sparse suffix arrays.

A suffix is kept only at a minimiser: the ``K`` words of least hash among the ``W``
places at which a run of ``least`` words starts.  A run's words alone decide its
minimiser, so equal runs keep equal suffixes; the runs with one minimiser follow
each other, and a suffix owns them.  All of them have the suffix's first
``least - W + 1`` words.

The kept suffixes are sorted by these leading words, then by all that they own,
then by document and place.  In that order each is compared with its neighbours.
One that owns the same words as the suffix before it repeats them whole.  One whose
leading words a neighbour has, though it owns other words, is extended to the left and
right, run by run: the runs that such suffixes own are sorted in turn, and
neighbours that are equal are repeats.  A suffix that owns nothing but what an
earlier one owns need not be extended, so a passage that many documents have is
extended once, and only where what surrounds it differs.

Both orders are range partitions over whole keys, place included, so a passage that
a third of all documents share is dealt out like any other.  A partition's first and
last suffixes, whose neighbours lie elsewhere, are extended in any case; first and last
runs meet in a small table of their own.  The result is exactly the set of words in runs of
``least`` words that occur twice or more.  Leading words and owned words (or, of a run, all
its words and its first half) are compared by 64-bit hashes each, 128 bits together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import Scratch

K = 5
W = 34

#: What a suffix's neighbours tell: it repeats an earlier one; others repeat it; it is to be extended, and others repeat it or not.
COPY, COPIED, EXTEND_COPIED, EXTEND = 0, 1, 2, 3


def _sums(h: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in the words' hashes."""
    up, _ = T._powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return total


def _hashes(total: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of the words in each [start, stop), in time that doesn't depend on their number."""
    _, down = T._powers(len(total))
    return T.mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def _lowest(x: np.ndarray, w: int) -> np.ndarray:
    """The place of the first least value in each run of ``w``, by doubling."""
    at, have = np.arange(len(x)), 1
    while have < w:
        step = min(have, w - have)
        left, right = at[:-step], at[step:]
        at = np.where(x[right] < x[left], right, left)
        have += step
    return at


def suffixes(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a document's kept suffixes: hashes of the leading and of the owned words, the first run owned and the number of runs."""
    n = len(h) - least + 1
    if n <= 0:
        return h[:0], h[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    total, every = _sums(h), np.arange(len(h) - K + 1)
    low = _lowest(_hashes(total, every, every + K), W)[:n]
    first = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
    count = np.diff(np.concatenate((first, [n])))
    at = low[first]
    return _hashes(total, at, at + least - W + 1), _hashes(total, first, first + count + least - 1), first, count


def _documents(column: pa.Array):
    """(row, word hashes, first bytes, end bytes, first byte of the text) of each document with words."""
    buf, offsets, _ = T.utf8(column)
    for lo, hi in T.groups(offsets):
        part = offsets[lo : hi + 1] - offsets[lo]
        h, first, end, at = T.words(buf[offsets[lo] : offsets[hi]], part, T.SPACE, lower=True)
        for i in range(hi - lo):
            a, b = at[i], at[i + 1]
            if b > a:
                yield lo + i, h[a:b], first[a:b] - part[i], end[a:b] - part[i]


def _flat(parts: list, kind) -> np.ndarray:
    return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)


def _batch(names: list[str], kinds: list, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(_flat(c, k) if isinstance(c, list) else np.asarray(c).astype(k)) for c, k in zip(columns, kinds, strict=True)], names)


def _print(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.hash(text)


def _suffixes(docs: DataFrame, least: int) -> DataFrame:
    """(lead, own, id, print, at, n) of all kept suffixes."""
    kinds = [np.int64, np.int64, np.int64, np.int32, np.int32, np.int16]

    def run(batches):
        for batch in batches:
            ids, prints = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            out: list[list] = [[] for _ in kinds]
            for row, h, _, _ in _documents(batch.column(1)):
                lead, own, at, n = suffixes(h, least)
                for column, x in zip(out, (lead.view(np.int64), own.view(np.int64), np.full(len(at), ids[row]), np.full(len(at), prints[row]), at, n), strict=True):
                    column.append(x)
            yield _batch(["lead", "own", "id", "print", "at", "n"], kinds, out)

    return docs.mapInArrow(T.freed(run), "lead long, own long, id long, print int, at int, n short")


def _in_order(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.repartitionByRange(*columns).sortWithinPartitions(*columns)


def _after(row: list | None, columns: list[np.ndarray]) -> list[np.ndarray]:
    """``columns`` with a row put before them."""
    return [np.concatenate((np.array([v], c.dtype), c)) for v, c in zip(row, columns, strict=True)] if row else columns


def _compared(suffixes: DataFrame) -> DataFrame:
    """(id, print, at, n, kind) of the suffixes that share their leading words with a neighbour, or may."""

    def run(batches):
        head = last = None  # the last owner of words not seen before, not yet judged; the row before
        more = shared = False  # does it have copies, has it a neighbour of other words
        kinds = [np.int64, np.int32, np.int32, np.int16, np.int8]
        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            if not len(cols[0]):
                continue
            # The judged owner goes before the batch.
            cols = _after(head, cols)
            lead, own, ids, prints, at, n = cols
            back = 1 if head else 0
            new = np.concatenate(([True], (lead[1:] != lead[:-1]) | (own[1:] != own[:-1])))
            again = np.concatenate(([False], ~new[1:] & (ids[1:] == ids[:-1]) & (prints[1:] == prints[:-1]) & (at[1:] == at[:-1])))
            if back and not new[1]:
                again[1] = (ids[1], prints[1], at[1]) == last
            owners = np.flatnonzero(new)
            copies = np.flatnonzero(~new & ~again)
            has = np.zeros(len(owners), bool)
            has[np.searchsorted(owners, copies, "right") - 1] = True
            near = lead[owners[1:]] == lead[owners[:-1]]
            side = np.concatenate((near, [False])) | np.concatenate(([False], near))
            has[0] |= more
            side[0] |= shared or not back  # a partition's first may have a neighbour before it
            kind = np.where(side, np.where(has, EXTEND_COPIED, EXTEND), np.where(has, COPIED, -1))
            done = owners[:-1][kind[:-1] >= 0]
            rows = np.concatenate((copies, done))
            yield _batch(["id", "print", "at", "n", "kind"], kinds, [ids[rows], prints[rows], at[rows], n[rows], np.concatenate((np.full(len(copies), COPY), kind[:-1][kind[:-1] >= 0]))])
            head, more, shared = [c[owners[-1]] for c in cols], bool(has[-1]), bool(side[-1])
            last = (ids[-1], prints[-1], at[-1])
        if head:  # a partition's last may have one after it
            yield _batch(["id", "print", "at", "n", "kind"], kinds, [[np.array([x])] for x in (*head[2:], EXTEND_COPIED if more else EXTEND)])

    order = ("lead", "own", "id", "print", "at")
    return _in_order(suffixes, *order).select(*order, "n").mapInArrow(T.freed(run), "id long, print int, at int, n short, kind byte")


def _runs(matched: DataFrame, least: int) -> DataFrame:
    """(x, y, id, print, at, copied) of each run of ``least`` words that the suffixes to extend own; ``matched`` has id, t, print and their (at, n, kind) as l."""
    names, kinds = ["x", "y", "id", "print", "at", "copied"], [np.int64, np.int64, np.int64, np.int32, np.int32, np.int8]

    def run(batches):
        for batch in batches:
            ids, prints, l = np.asarray(batch.column(0)), np.asarray(batch.column(2)), batch.column(3)
            ends, fields = np.asarray(l.offsets), [np.asarray(l.values.field(i)) for i in range(3)]
            out: list[list] = [[] for _ in kinds]
            for row, h, _, _ in _documents(batch.column(1)):
                at, n, kind = (f[ends[row] : ends[row + 1]].astype(np.int64) for f in fields)
                start = np.repeat(at - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                total = _sums(h)
                x, y = _hashes(total, start, start + least), _hashes(total, start, start + least // 2)
                for column, c in zip(out, (x.view(np.int64), y.view(np.int64), np.full(len(start), ids[row]), np.full(len(start), prints[row]), start, np.repeat(kind == EXTEND_COPIED, n)), strict=True):
                    column.append(c)
            yield _batch(names, kinds, out)

    return matched.mapInArrow(T.freed(run), "x long, y long, id long, print int, at int, copied byte")


def _found(runs: DataFrame) -> DataFrame:
    """(x, y, id, print, at, twice, later, edge) of the runs that are found twice, and of each partition's first and last."""
    names, kinds = ["x", "y", "id", "print", "at", "twice", "later", "edge"], [np.int64, np.int64, np.int64, np.int32, np.int32, np.bool_, np.bool_, np.bool_]

    def run(batches):
        held, before, start = None, False, True  # the row not yet judged; is the one before it equal; is it a partition's first
        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            if not len(cols[0]):
                continue
            cols = _after(held, cols)
            once = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols[:5]], 0)))  # a repeated row is one
            cols = [c[once] for c in cols]
            x, y, *_, copied = cols
            same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
            later = np.concatenate(([before], same))
            twice = later | np.concatenate((same, [False])) | (copied > 0)
            edge = np.zeros(len(x), bool)
            edge[0] = start
            out = np.flatnonzero((twice | edge)[:-1])
            yield _batch(names, kinds, [*(c[out] for c in cols[:5]), twice[out], later[out], edge[out]])
            start = start and len(x) == 1
            held, before = [c[-1] for c in cols], bool(later[-1])
        if held:
            yield _batch(names, kinds, [[np.array([v])] for v in (*held[:5], before or held[5] > 0, before, True)])

    order = ("x", "y", "id", "print", "at")
    return _in_order(runs, *order).select(*order, "copied").mapInArrow(T.freed(run), "x long, y long, id long, print int, at int, twice boolean, later boolean, edge boolean")


def _marks(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, print, at, n, later) of each run that is found twice."""
    found = scratch.table(_found(runs))
    place = F.struct("id", "print", "at")
    edges = found.filter("edge").groupBy("x", "y").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
    met = found.filter("edge").join(edges, ["x", "y"]).select(*found.columns, (F.col("lo") < F.col("hi")).alias("met"), (place > F.col("lo")).alias("after"))
    met = met.select("id", "print", "at", (F.col("twice") | F.col("met")).alias("twice"), (F.col("later") | F.col("after")).alias("later")).filter("twice")
    every = found.filter("not edge").select("id", "print", "at", "later").union(met.drop("twice"))
    return every.select("id", "print", "at", F.lit(1).cast("short").alias("n"), "later")


def _merged(at: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the passages that ``n`` runs from each ``at`` on cover."""
    if not len(at):
        return at, at
    order = np.argsort(at, kind="stable")
    at, stop = at[order], np.maximum.accumulate(at[order].astype(np.int64) + n[order] + least - 1)
    cut = np.flatnonzero(at[1:] > stop[:-1])
    return at[np.concatenate(([0], cut + 1))], stop[np.concatenate((cut, [len(at) - 1]))]


def _passages(marks: DataFrame, least: int) -> DataFrame:
    kind = "array<struct<start:int,stop:int>>"

    def spans(lists):
        ends = np.cumsum([0, *(len(a) for a, _ in lists)]).astype(np.int32)
        both = pa.StructArray.from_arrays([pa.array(_flat([a for a, _ in lists], np.int32)), pa.array(_flat([b for _, b in lists], np.int32))], ["start", "stop"])
        return pa.ListArray.from_arrays(pa.array(ends), both)

    def run(batches):
        for batch in batches:
            every, gone, l = [], [], batch.column(2)
            ends, (at, n, later) = np.asarray(l.offsets), (np.asarray(l.values.field(i)) for i in range(3))
            for a, z in zip(ends[:-1], ends[1:], strict=True):
                every.append(_merged(at[a:z], n[a:z], least))
                some = later[a:z] > 0
                gone.append(_merged(at[a:z][some], n[a:z][some], least))
            total = [pa.array([int((b - a).sum()) for a, b in x], pa.int64()) for x in (every, gone)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans(every), spans(gone), *total], ["id", "print", "spans", "gone", "n", "m"])

    packed = marks.groupBy("id", "print").agg(F.collect_list(F.struct("at", "n", F.col("later").cast("byte").alias("later"))).alias("l"))
    return packed.mapInArrow(T.freed(run), f"id long, print int, spans {kind}, gone {kind}, n long, m long")


def repeated_passages(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 50) -> DataFrame:
    """A row for each document with a repeated passage of ``least`` words or more, in it or in another.

    doc_id; ``spans``, the passages as word places [start, stop); ``removable``, those of them of
    which an earlier document, or an earlier place of the same document, has a copy; the numbers of
    words in both; ``print``, a hash of the text.  Documents are in the order of their ids.  Words are
    runs without white space, A-Z lowered.  Rows with equal ids and texts are one document; texts
    that share an id are documents of their own, in the order of ``print``.  Rows without an id or
    text have no passages; other columns are not looked at; an empty table gives an empty result.
    """
    if least < W + K:
        raise ValueError(f"a passage has {W + K} words at least")
    scratch = Scratch(df.sparkSession)
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t")).filter("id is not null and t is not null").withColumn("print", _print(F.col("t")))
    kept = scratch.table(_suffixes(docs, least))
    compared = scratch.table(_compared(kept))
    scratch.drop(kept)
    extend = compared.filter(F.col("kind") >= EXTEND_COPIED).groupBy("id", "print").agg(F.collect_list(F.struct("at", "n", "kind")).alias("l"))
    runs = scratch.table(_runs(docs.join(extend, ["id", "print"]).select("id", "t", "print", "l"), least))
    marks = compared.filter(F.col("kind") <= COPIED).select("id", "print", "at", "n", (F.col("kind") == COPY).alias("later")).union(_marks(runs, scratch))
    out = scratch.table(_passages(marks, least))
    scratch.drop(compared, runs)
    return out.select(F.col("id").alias(doc_id), F.size("spans").cast("long").alias("n_spans"), F.col("n").alias("n_repeated_words"), F.col("m").alias("n_removable_words"), "spans", F.col("gone").alias("removable"), "print")


def cut_passages(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 50) -> DataFrame:
    """``df`` with every removable passage cut from its text; what loses all its words goes.

    A column n_chars is set to the new text's length where text was cut.  Rows without a
    removable passage, without an id or without a text stay as they are; so do columns of any name.
    """
    found = repeated_passages(df, text, doc_id, least).filter("n_removable_words > 0").select(F.col(doc_id).alias("id"), "print", F.col("removable").alias("gone"))
    whole = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t")).withColumn("print", _print(F.col("t")))
    cuts = whole.join(found, ["id", "print"], "left").select("t", "gone", "row")
    place = df.columns.index(text)

    def run(batches):
        for batch in batches:
            texts, gone = batch.column(0), batch.column(1)
            new, keep = texts.to_pylist(), np.ones(batch.num_rows, bool)
            rows = {i for i, ok in enumerate(np.asarray(gone.is_valid())) if ok}
            if rows:
                for row, _, first, end in _documents(texts):
                    if row in rows:
                        raw, left, at = new[row].encode(), [], 0
                        for s in gone[row].as_py():
                            left.append(raw[at : first[s["start"]]])
                            at = int(end[s["stop"] - 1])
                        left.append(raw[at:])
                        new[row] = b"".join(left).decode()
                        keep[row] = bool(new[row].strip())
            row = batch.column(2)
            columns = [row.field(i) for i in range(row.type.num_fields)]
            columns[place] = pa.array(new, columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, gone.is_valid()], [f"c{i}" for i in range(len(columns))] + ["cut"]).filter(pa.array(keep))

    schema = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(df.columns)) + ", cut boolean"
    out = cuts.mapInArrow(T.freed(run), schema)
    cols = [F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)]
    if "n_chars" in df.columns:
        i = df.columns.index("n_chars")
        cols[i] = F.when(F.col("cut"), F.char_length(f"c{place}").cast(df.schema["n_chars"].dataType)).otherwise(F.col(f"c{i}")).alias("n_chars")
    return out.select(*cols)


def op3(spark, sf_dir: str) -> DataFrame:
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",").alias(c)
    return found.select("doc_id", "n_spans", "n_repeated_words", "n_removable_words", listed("spans"), listed("removable"))


SQL3 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, i - 1 AS i, md5(array_to_string(l[i : i + 49], ' ')) AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 48)) AS i FROM w WHERE len(l) >= 50)),
k AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS o FROM r),
p AS (SELECT doc_id, i, false AS gone FROM k WHERE n > 1 UNION ALL SELECT doc_id, i, true FROM k WHERE o > 1),
m AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, gone ORDER BY i) + 50 THEN 0 ELSE 1 END AS c FROM p),
s AS (SELECT doc_id, gone, min(i) AS a, max(i) + 50 AS z FROM (SELECT *, sum(c) OVER (PARTITION BY doc_id, gone ORDER BY i) AS t FROM m) GROUP BY doc_id, gone, t)
SELECT doc_id, count(*) FILTER (NOT gone) AS n_spans, coalesce(sum(z - a) FILTER (NOT gone), 0)::BIGINT AS n_repeated_words, coalesce(sum(z - a) FILTER (gone), 0)::BIGINT AS n_removable_words,
  string_agg(a || '-' || z, ',' ORDER BY a) FILTER (NOT gone) AS spans, coalesce(string_agg(a || '-' || z, ',' ORDER BY a) FILTER (gone), '') AS removable
FROM s GROUP BY doc_id
"""
