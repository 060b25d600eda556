"""Near-duplicate documents: MinHash with tensored banding, links confirmed on full sets.

Every document gets two small collections of ``m`` sub-hashes, each of ``t``
minhashes.  The table keys are all pairs of one sub-hash from either collection:
``m * m`` keys of ``2 * t`` minhashes out of ``2 * m * t`` minhashes computed.
With m = 16 and t = 3 a pair at similarity 0.8 is missed with probability 2e-5.

Documents with equal sets are one class and go on as its smallest id.  A sub-hash
that only one class has cannot pair with anything, so keys are formed from shared
sub-hashes alone.  In a bucket every member is compared with one centre, on full
sets; what differs from the centre then decides exactly which members can be
linked with each other though not both are with the centre (see ``_rest``).  So a
bucket costs a comparison a member, no pair within a bucket is lost, and pairs of
members that are in one component anyway are never formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .components import components
from .scratch import Scratch

#: Words of 64 bits in the bitmap of a member's differences.
BITS = 4
#: Bits of the filter of documents to compare, for each of them, at least and at most; it is sent to every executor.
FILTER_EACH, FILTER_LEAST, FILTER_MOST = 16, 1 << 16, 1 << 29


def shingle_sets(column: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    """Runs of documents as sorted arrays of their distinct k-word shingles' hashes."""
    buf, offsets, _ = T.utf8(column)
    for lo, hi in T.groups(offsets):
        part = offsets[lo : hi + 1] - offsets[lo]
        h, _, _, at = T.words(buf[offsets[lo] : offsets[hi]], part, T.SPACE, lower=True)
        w = T.windows(h, k)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                s = np.sort(w[a : b - k + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif b > a:
                out.append(T.mix(T.windows(h[a:b], b - a) + np.uint64(b - a)))
            else:
                out.append(h[:0])
        yield out


def _signature(sets: list[np.ndarray], m: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents with sets: the 2 m sub-hashes and two sums that tell equal sets."""
    h = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    sums = np.stack([np.add.reduceat(T.mix(h ^ s), at) for s in T.seeds(2, 31)])
    odd, salt, out = T.seeds(2 * m * t, 501) | np.uint64(1), T.seeds(2 * m, 901), []
    for i in range(2 * m):
        x = np.full(len(sets), salt[i])
        for j in range(t):
            x = T.mix(x ^ np.minimum.reduceat(h * odd[i * t + j], at))
        out.append(x)
    return np.stack(out, 1), sums[0], sums[1]


def signatures(docs: DataFrame, k: int, m: int, t: int) -> DataFrame:
    """id, n (set size), f1 and f2 (the set's print), h (sub-hashes; empty for an empty set)."""

    def run(batches):
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(1), k):
                full = np.array([len(s) > 0 for s in sets])
                f1, f2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                sub = np.zeros((0, 2 * m), np.uint64)
                if full.any():
                    sub, f1[full], f2[full] = _signature([s for s in sets if len(s)], m, t)
                ends = np.concatenate([[0], np.cumsum(full * 2 * m)]).astype(np.int32)
                h = pa.ListArray.from_arrays(pa.array(ends), pa.array(sub.reshape(-1).view(np.int64)))
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), n, pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), h], ["id", "n", "f1", "f2", "h"])
                at += len(sets)

    return docs.select("id", "t").mapInArrow(T.freed(run), "id long, n long, f1 long, f2 long, h array<long>")


def _places(ids: str, bits: int) -> list:
    """The filter's bits of an id."""
    return [F.pmod(F.xxhash64(ids, F.lit(j)), F.lit(bits)) for j in range(4)]


def _filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter; what it lets through in error a join drops."""
    places = ids.select(F.explode(F.array(*_places("id", bits))).alias("p"))
    word = F.shiftright("p", 6).cast("int").alias("w")
    words = places.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(words["w"])] = np.asarray(words["b"])
    return out


def _sets(docs: DataFrame, ids: DataFrame, k: int, most: int = FILTER_MOST) -> DataFrame:
    """(id, s): the sets of the documents in the table ``ids`` and of a few others.

    Texts aren't shuffled but dropped where they are read, by a filter of ``FILTER_EACH`` bits for each
    id.  Where that would be over ``most`` bits, a join by id takes the filter's place.
    """
    bits = max(FILTER_LEAST, 1 << (FILTER_EACH * ids.count()).bit_length())
    some = docs.select("id", "t", *_places("id", bits)) if bits <= most else docs.join(ids, "id", "left_semi").select("id", "t")
    filtered = docs.sparkSession.sparkContext.broadcast(_filter(ids, bits)) if bits <= most else None

    def run(batches):
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            for j in range(4) if filtered is not None else ():
                p = np.asarray(batch.column(2 + j))
                ok &= filtered.value[p >> 6] >> (p & 63) & 1 == 1
            some, at = batch.filter(pa.array(ok)), 0
            for sets in shingle_sets(some.column(1), k) if some.num_rows else ():
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                s = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([some.column(0).slice(at, len(sets)), s], ["id", "s"])
                at += len(sets)

    return some.mapInArrow(T.freed(run), "id long, s array<long>")


def _compared(pairs: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Of pairs (a, c): a's set less c's (more), c's less a's (less), both sizes, and whether they are linked; a table."""
    ids = scratch.table(pairs.select("a").union(pairs.select("c")).distinct().toDF("id"))
    # Repeated rows go before the joins, so that these are plain and a centre with most members can be split.
    sets = scratch.table(_sets(docs, ids, k).dropDuplicates(["id"]))
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("c", "sc"), "c")
    both = both.select("a", "c", F.size("sa").alias("n"), F.size("sc").alias("nc"), F.array_except("sa", "sc").alias("more"), F.array_except("sc", "sa").alias("less"))
    union = F.col("nc") + F.size("more")
    out = scratch.table(both.withColumn("linked", 100 * (F.col("n") - F.size("more")) >= percent * union))
    scratch.drop(sets, ids)
    return out


def _ranked(compared: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """``members`` with their differences from the centre, each as (f, x): the number of members of the bucket that have it, and the difference; rarest first."""
    side = lambda c, m: F.transform(c, lambda x: F.struct(F.lit(m).alias("m"), x.alias("x")))
    tokens = compared.select("c", "a", F.explode(F.concat(side("more", True), side("less", False))).alias("t")).select("c", "a", "t.m", "t.x")
    known = scratch.table(tokens.groupBy("c", "m", "x").agg(F.count("*").cast("int").alias("f")).filter("f > 1"))
    tokens = tokens.join(known, ["c", "m", "x"], "left").withColumn("f", F.coalesce("f", F.lit(1)))
    listed = lambda m: F.array_sort(F.collect_list(F.when(F.col("m") == m, F.struct("f", "x"))))
    members = members.join(tokens.groupBy("c", "a").agg(listed(True).alias("more"), listed(False).alias("less")), ["c", "a"])
    # Bits of the differences' hashes: bits that two members don't share bound the differences that they do.
    every = F.transform(F.concat("more", "less"), lambda e: e["x"])
    set_ = lambda b, x: b.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int")))
    word = lambda w: F.aggregate(every, F.lit(0).cast("long"), lambda b, x: F.when(F.shiftright(x, 6).bitwiseAND(F.lit(BITS - 1)) == w, set_(b, x)).otherwise(b))
    return members.withColumns({f"b{w}": word(w) for w in range(BITS)})


def _rest(compared: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, c) with the centres, and those between other members of a bucket that join components; a table.

    Against a centre with n shingles, let a member miss d of them and have m others, at a cost of
    100 d + percent m.  Two members that share s of these differences are similar enough exactly if
    their costs together are (100 - percent) n + (100 + percent) s at most.  A member that is not
    linked with the centre costs over (100 - percent) n alone, so its partner must share differences
    worth the partner's whole cost: members are joined on the prefixes of their differences that
    such a share cannot miss, and the share is then counted in full.
    """
    groups = compared.groupBy("c").agg(F.count("*").alias("g"), F.count_if(~F.col("linked")).alias("r")).filter("g > 1 and r > 0").select("c")
    groups = scratch.table(groups)  # as all that is aggregated before a join: what has most members can be split then
    known = compared.filter("linked").select("a", "c")
    roots = components(known, scratch)
    cost, free = 100 * F.size("less") + percent * F.size("more"), (100 - percent) * F.col("nc")
    # Two members that are both nearest to one centre are looked at in that centre's buckets alone.
    nearest = scratch.table(compared.groupBy("a").agg(F.min_by("c", cost / free).alias("main")))
    small = compared.select("c", "a", "n", "linked", cost.alias("cost"), free.alias("free"))
    members = small.join(groups, "c").join(nearest, "a").join(roots, F.col("a") == F.col("u"), "left").drop("u")
    members = members.select(*small.columns, "main", F.coalesce("v", "a").alias("root"), F.floor(4 * F.col("cost") / F.col("free")).cast("int").alias("u"))
    members = scratch.table(_ranked(compared, scratch.table(members), scratch))
    # By classes of cost, a quarter of the free cost wide, the share that two members need is known well enough for short prefixes.
    kinds = scratch.table(members.groupBy("c", "u").agg(F.max(~F.col("linked")).alias("apart")))

    def prefixes(rows: DataFrame, others: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.withColumnRenamed("u", own).join(others.select("c", F.col("u").alias(other)), "c")
        need = F.greatest(F.lit(1), F.ceil(F.col("free") * (F.col(own) + F.col(other) - 4) / (4 * (100 + percent))).cast("int"))
        rows = rows.withColumn("o", need).filter(F.col("o") <= F.size("more") + F.size("less"))
        # They share one of what they have more, at least what they can't share of what they miss; or only of what they miss.
        # Rarest first, and those that no other member has can't be shared: what is left meets few partners.
        first = lambda d, o: F.filter(F.slice(d, 1, F.greatest(F.lit(0), F.size(d) - o + 1)), lambda e: e["f"] > 1)
        tokens = F.concat(first("more", F.greatest(F.lit(1), F.col("o") - F.size("less"))), first("less", F.col("o")))
        return rows.select("c", "a", "n", "linked", "cost", "free", "up", "uq", "root", "main", *[f"b{w}" for w in range(BITS)], (F.size("more") + F.size("less")).alias("size"), F.explode(F.transform(tokens, lambda e: e["x"])).alias("x"))

    apart = prefixes(members.filter("not linked"), kinds, "up", "uq").alias("p")
    others = prefixes(members, kinds.filter("apart"), "uq", "up").alias("q")
    p, q = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"q.{c}"))
    apart_bits = reduce(lambda a, b: a + b, [F.bit_count(p(f"b{w}").bitwiseXOR(q(f"b{w}"))) for w in range(BITS)])
    most = F.least(p("size"), q("size"), (p("size") + q("size") - apart_bits) / 2)
    may = (p("root") != q("root")) & ((p("main") != q("main")) | (p("main") == p("c"))) & (q("linked") | (p("a") < q("a"))) & (100 * F.least(p("n"), q("n")) >= percent * F.greatest(p("n"), q("n"))) & (p("cost") + q("cost") <= p("free") + (100 + percent) * most)
    same = (p("c") == q("c")) & (p("x") == q("x")) & (p("up") == q("up")) & (p("uq") == q("uq"))
    pairs = apart.join(others, same).filter(may).select(p("c").alias("c"), p("a").alias("a"), q("a").alias("b")).distinct()
    pairs = scratch.table(pairs)  # few: Spark now knows how few, and need not deal out the members
    own = members.select("c", "a", F.transform(F.concat("more", "less"), lambda e: e["x"]).alias("da"), F.col("cost").alias("ca"), "free")
    other = members.select("c", F.col("a").alias("b"), F.transform(F.concat("more", "less"), lambda e: e["x"]).alias("db"), F.col("cost").alias("cb"))
    share = F.size(F.array_intersect("da", "db"))
    found = pairs.join(own, ["c", "a"]).join(other, ["c", "b"]).filter(F.col("ca") + F.col("cb") <= F.col("free") + (100 + percent) * share)
    out = scratch.table(known.union(found.select("a", F.col("b").alias("c"))).distinct())
    scratch.drop(members, pairs)
    return out


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, percent: int = 80, m: int = 16, t: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, print for each row of ``df``.

    Words are runs without white space, A-Z lowered.  A null or wordless text has an empty set
    and is linked with nothing; fewer than k words are one shingle.  A row without an id is never
    linked: its component is null and it is kept.  Rows that repeat an id with the same text are
    one document, returned as often as given.  Texts that share an id are documents of their own,
    told apart by ``print``, a hash of the text (null where each id has one): component_id is the smallest id of the component,
    and of several texts with that id the one with the smallest print is kept.  Columns of other
    names are not looked at.
    """
    scratch = Scratch(df.sparkSession)
    docs, extra = _keyed(df, text, doc_id, scratch)
    sig = scratch.table(signatures(docs.select("id", "t"), k, m, t))
    live = sig.filter("n > 0 and id is not null")
    prints = ["n", "f1", "f2"]
    # A class may have most documents.  Its smallest id is partially aggregated; as a table of its own it leaves a plain join, which Spark splits where it is skewed.
    classes = scratch.table(live.groupBy(*prints).agg(F.min("id").alias("rep")))
    member = scratch.table(live.join(classes, prints).select("id", "n", "rep", F.when(F.col("id") == F.col("rep"), F.col("h")).alias("h")))
    scratch.drop(classes)

    sub = member.filter("h is not null").dropDuplicates(["id"]).select("id", F.posexplode("h").alias("p", "x"))
    # Tables of their own for the same reason: a sub-hash or a key that most classes have is one row there.
    shared = scratch.table(sub.groupBy("x").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("of")).filter("lo < hi").select("x", "of"))
    parts = sub.join(shared, "x").groupBy("id").agg(F.collect_list(F.struct("p", "x")).alias("l"), F.sum("of").alias("score"))
    side = lambda low: F.transform(F.filter("l", lambda e: (e["p"] < m) == F.lit(low)), lambda e: e["x"])
    # The centre of a bucket is the member whose sub-hashes most documents have: what the copies were made of, or close to it.
    rank = F.col("score") * (1 << 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    parts = parts.select("id", rank.alias("rank"), side(True).alias("a"), side(False).alias("b")).filter("size(a) > 0 and size(b) > 0")
    keys = scratch.table(parts.select("id", "rank", F.explode("a").alias("a"), "b").select("id", "rank", "a", F.explode("b").alias("b")).select("id", "rank", F.xxhash64("a", "b").alias("key")))
    heads = scratch.table(keys.groupBy("key").agg(F.max_by("id", "rank").alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key", "c"))
    pairs = scratch.table(keys.join(heads, "key").filter("id <> c").select(F.col("id").alias("a"), "c").distinct())
    scratch.drop(keys, heads, shared)

    compared = _compared(pairs, docs, k, percent, scratch)
    links = _rest(compared, percent, scratch)
    scratch.drop(pairs, compared)
    roots = components(links, scratch)
    scratch.drop(links)
    linked = member.join(roots, F.col("rep") == F.col("u"), "left").select("id", "n", F.coalesce("v", "rep").alias("c"))
    alone = sig.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("c"))
    found = linked.union(alone)
    if extra is None:
        return found.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"), F.lit(None).cast("int").alias("print"))
    # Back to ids and prints: a component's first is its smallest id, and of this id the smallest print.
    own = docs.select("id", F.struct(F.col("own").alias("id"), "print").alias("key")).filter("id is not null").distinct()
    named = scratch.table(found.filter("id is not null").join(own, "id").select("id", "n", "c", "key"))
    first = scratch.table(named.groupBy("c").agg(F.min("key").alias("first")))
    out = named.join(first, "c").select(F.col("key.id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"), (F.col("key") == F.col("first")).alias("kept"), F.col("key.print").alias("print"))
    nameless = sig.filter("id is null").select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("int").alias("print"))
    return out.union(nameless)


def _keyed(df: DataFrame, text: str, doc_id: str, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(id, t, own, print) of all rows: a number for each document, its own id, and a print of its text.

    The number is the id, but for the further texts of ids that have several, which get numbers of their own beyond all
    ids.  The second result is a table of these, None without any.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("own"), F.col(text).cast("string").alias("t")).withColumn("print", F.hash("t"))
    several = docs.filter("own is not null").groupBy("own").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).filter("lo < hi").select("own", "lo")
    several = scratch.table(several)
    if several.isEmpty():
        return docs.select(F.col("own").alias("id"), "t", "own", "print"), None
    low, high = docs.agg(F.min("own"), F.max("own")).first()
    further = docs.join(several, "own").filter("print > lo").select("own", "print").distinct()
    number = F.lit(high + 1) + F.monotonically_increasing_id() if high < 1 << 62 else F.lit(low - 1) - F.monotonically_increasing_id()
    extra = scratch.table(further.select("own", "print", number.alias("other")))
    return docs.join(extra, ["own", "print"], "left").select(F.coalesce("other", "own").alias("id"), "t", "own", "print"), extra


def keep_one(df: DataFrame, **how) -> DataFrame:
    """``df`` with one document of each group of near copies, the one with the smallest id; columns may have any names."""
    doc_id, text = how.get("doc_id", "doc_id"), how.get("text", "text")
    gone = near_duplicates(df, **how).filter("not kept").select(F.col(doc_id).alias("gone"), F.col("print").alias("of")).distinct()
    whole = df.select(F.col(doc_id).cast("long").alias("id"), F.hash(F.col(text).cast("string")).alias("print"), F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    same = (F.col("id") == F.col("gone")) & (F.col("of").isNull() | (F.col("of") == F.col("print")))
    return whole.join(gone, same, "left_anti").select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def op9(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4).drop("print")


SQL9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(l[i : i + 3], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, greatest(2, len(l) - 2))) AS i FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
