"""Benchmark decontamination with DataFrame functions only.

The benchmark's n-grams are normalised word windows.  Each window is anchored at
its longest pair of neighbouring words, and the windows are a broadcast hash
table keyed by that pair: as the words of a document pass, a place whose pair is
in the table is verified by comparing the whole window's text, so a hit is exact
and no row is shuffled before it is one.  A table is broadcast in blocks of about
``block`` bytes; a larger benchmark takes more passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .wordlists import SQL_WORDS, listed, normal

#: Bytes of windows in a broadcast table, and what a row of it takes besides its text.
BLOCK, ROW = 48 << 20, 128

#: What stands before a word, and a text's parts: each word with what stands before it, then what stands after the last.
GAP = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
PARTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*+[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"


def _windows(benchmark: DataFrame, text: str, item_id: str, n: int) -> DataFrame:
    """(gram, item): each window of each item; an item of fewer words is one window."""
    words = benchmark.select(F.col(item_id).cast("string").alias("item"), listed(normal(F.col(text))).alias("w")).filter(F.size("w") > 0)
    starts = words.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1))).alias("i"))
    return starts.select(F.array_join(F.slice("w", F.col("i"), n), " ").alias("gram"), "item").distinct()


def _anchored(grams: DataFrame) -> DataFrame:
    """gram, len, and the longest pair of neighbours (x, y) with its place off; y is null for a lone word."""
    w = grams.select("gram", F.split("gram", " ").alias("w"))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.struct((F.length(F.get("w", i)) + F.length(F.get("w", i + 1))).alias("n"), (-i).alias("i"))))
    w = w.select("gram", "w", F.when(F.size("w") > 1, -best["i"]).otherwise(0).alias("off"))
    return w.select("gram", F.size("w").alias("len"), "off", F.get("w", F.col("off")).alias("x"), F.get("w", F.col("off") + 1).alias("y"))


def find_hits(docs: DataFrame, grams: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(id, print, start, stop, gram) of every occurrence of a window in ``docs`` (id, print, norm)."""
    table = scratch.table(_anchored(grams))
    size, lone = table.agg(F.sum(F.octet_length("gram") + ROW), F.count_if(F.col("y").isNull())).first()
    parts = -(-(size or 0) // block)
    places = docs.select("id", "print", listed(F.col("norm")).alias("w")).select("id", "print", "w", F.posexplode("w").alias("p", "a"))
    pairs = places.withColumn("b", F.get("w", F.col("p") + 1))
    found = []
    for i in range(parts):
        part = table.filter(F.pmod(F.xxhash64("gram"), F.lit(parts)) == i)
        whole = F.array_join(F.slice("w", F.col("p") - F.col("off") + 1, F.col("len")), " ") == F.col("gram")
        on = (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")) & (F.col("p") >= F.col("off")) & F.when(F.col("p") >= F.col("off"), whole)
        found.append(pairs.join(F.broadcast(part.filter("y is not null")), on))
        if lone:
            found.append(pairs.join(F.broadcast(part.filter("y is null")), F.col("a") == F.col("x")))
    if not found:
        return scratch.table(docs.filter(F.lit(False)).select("id", "print", F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit("").alias("gram")))
    start = F.col("p") - F.col("off")
    hits = reduce(DataFrame.union, [x.select("id", "print", start.alias("start"), (start + F.col("len")).alias("stop"), "gram") for x in found])
    out = scratch.table(hits.distinct())
    scratch.drop(table)
    return out


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 13, share: int = 20, block: int = BLOCK) -> DataFrame:
    """For each row of ``df``: doc_id, print, n_words, n_hit, spans, items, contaminated.

    ``spans`` are the merged word places [start, stop) inside occurrences; ``items`` the benchmark's
    ids with an occurring window, as sorted strings; contaminated: hits make up one word in
    ``share`` or more.  Null and wordless texts have no words and no hits, also in the benchmark;
    an empty benchmark hits nothing.  Rows with equal ids and texts get equal results; a null id is
    a value like others.  ``print`` tells texts of one id apart.  Other columns are not looked at.
    """
    scratch = Scratch(df.sparkSession)
    docs = df.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("print"), normal(F.col(text)).alias("norm"))
    windows = scratch.table(_windows(benchmark, "text", "item_id", n))
    hits = find_hits(docs, windows.select("gram").distinct(), scratch, block)
    key = [F.col("id"), F.col("print")]
    step = lambda s, e: F.when(F.size(s) == 0, F.array(e)).when(F.element_at(s, -1)["stop"] >= e["start"], F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(F.element_at(s, -1)["start"].alias("start"), F.greatest(F.element_at(s, -1)["stop"], e["stop"]).alias("stop"))))).otherwise(F.concat(s, F.array(e)))
    spans = hits.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("all"))
    spans = spans.select("id", "print", F.aggregate("all", F.array().cast("array<struct<start:int,stop:int>>"), step).alias("spans"))
    items = hits.select("id", "print", "gram").distinct().join(windows, "gram").select("id", "print", "item").distinct()
    items = items.groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items"))
    base = docs.select("id", "print", F.when(F.col("norm") == "", 0).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "))) + 1).cast("long").alias("n_words"))
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & a["print"].eqNullSafe(b["print"])
    out = spans.alias("s").join(items.alias("i"), F.col("s.id").eqNullSafe(F.col("i.id")) & F.col("s.print").eqNullSafe(F.col("i.print")), "left").select(F.col("s.id").alias("id"), F.col("s.print").alias("print"), "spans", "items")
    out = base.join(out, same(base, out), "left").select(base["id"], base["print"], "n_words", "spans", "items")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0), lambda a, s: a + s["stop"] - s["start"]), F.lit(0)).cast("long")
    out = out.select("id", "print", "n_words", n_hit.alias("n_hit"), F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select(F.col("id").alias(doc_id), "print", "n_words", "n_hit", "spans", "items", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def _without(text: Column, spans: Column) -> Column:
    """``text`` without the words in ``spans`` and what stands between them; what stands around a span stays."""

    def cut(parts: Column) -> Column:
        start = lambda i: F.get(spans, i)["start"]
        stop = lambda i: F.when(i < 0, 0).otherwise(F.get(spans, i)["stop"])
        join = lambda a, z: F.array_join(F.slice(parts, a + 1, z - a), "")
        kept = F.transform(spans, lambda _, i: F.concat(join(stop(i - 1), start(i)), F.regexp_extract(F.get(parts, start(i)), GAP, 0)))
        return F.concat(F.array_join(kept, ""), join(stop(F.size(spans) - 1), F.size(parts)))

    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(PARTS), F.lit(0))), cut), F.lit(0))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """``df`` without contaminated rows; of the other rows' texts every occurrence of a window is cut.

    A cut brings the words before and after it together.  Where that makes a window, the new text
    is judged as if it had come so, until no row has a hit.  A column n_chars is set to the new
    text's length where text was cut.  Rows without a hit stay as they are.
    """
    scratch, done, names = Scratch(df.sparkSession), [], df.columns

    def rows(d: DataFrame, new: dict[str, Column]) -> DataFrame:
        return d.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in names])

    while True:
        hit = contamination(df, benchmark, text, doc_id, **how).filter("n_hit > 0")
        hit = scratch.table(hit.select(F.col(doc_id).alias("of"), F.col("print").alias("its"), "spans", "contaminated").distinct())
        # The whole row goes along as one column, so that its names may be any.
        whole = df.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("print"))
        on = F.col("id").eqNullSafe(F.col("of")) & F.col("print").eqNullSafe(F.col("its"))
        done.append(rows(whole.join(hit, on, "left_anti"), {}))
        cut = whole.join(hit.filter("not contaminated"), on).select("row", _without(F.col("row").getField(text).cast("string"), F.col("spans")).alias("new"))
        new = {text: F.col("new").cast(df.schema[text].dataType)}
        if "n_chars" in names:
            new["n_chars"] = F.char_length("new").cast(df.schema["n_chars"].dataType)
        df = scratch.table(rows(cut, new))
        if df.isEmpty():
            return reduce(DataFrame.union, done)


def op8(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL8 = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS l FROM documents),
b AS (SELECT item_id, {SQL_WORDS} AS l FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(l)) AS k, array_to_string(l[i : i + least(13, len(l)) - 1], ' ') AS g
      FROM (SELECT item_id, l, unnest(range(1, greatest(2, len(l) - 11))) AS i FROM b WHERE len(l) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(l[i : i + k - 1], ' ') AS g
       FROM (SELECT doc_id, k, l, unnest(range(1, len(l) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(l) >= k)),
h AS (SELECT DISTINCT doc_id, dw.k, i, item_id FROM dw JOIN g ON dw.g = g.g AND dw.k = g.k),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(l)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.s, '')) AS items_sha256, coalesce(p.n, 0) > 0 AND 20 * coalesce(p.n, 0) >= len(l) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
