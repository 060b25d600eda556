"""Quality rules: counts that fail a document outright, and distribution divergence.

A document's character-class histogram and its common-word histogram are compared
with those of languages by Jensen-Shannon distance (base 2, so 0 to 1); the
nearest language counts.  A histogram is compared only if the document is long
enough for it.  A language's reference is drawn from all its rows, those under judgement among them: of each
character class the median share over documents, which junk of less than half
does not move; of each common word the mean share over documents that pass the
base rules.  Both are sums of whole numbers, so the reference does not depend on
how the rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

LEAST_CHARS, LEAST_WORDS = 200, 60
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.17, 0.45
BINS = 1000

COMMON = sorted(set(
    "the of and to in a is that for it was on are as with he be by at from or an this not but have which had were they one all you their his has been her she its will would there when who more no if so what up out "
    "der die und das von den mit ist des im für auf ein eine nicht sich auch es dem als aus wie nach bei werden einer durch wird sind zum oder war haben zu "
    "le la les et un une est que qui dans pour pas sur au par avec ce il elle ne se du en plus son sont mais ou aux cette "
    "el los las por para una con no del al lo como más su sus pero sin entre ha esta fue ser son también muy hasta "
    "il di che per non della sono nel alla dei più uma os não mais dos ao het van een dat niet zijn voor".split()
))

#: Digits count with small letters: numbers and keys in clean prose are no divergence.
_ASCII = {"upper": range(65, 91), "small": [*range(97, 123), *range(48, 58)], "space": [32], "break": range(9, 14), "punctuation": b".,;:?!'\"()-"}
CLASSES = [*_ASCII, "other letters", "symbol"]
SYMBOLS = T.table(b"#*$%&|<>")
_CLASS = np.full(256, len(CLASSES) - 1, np.int64)
for _i, _name in enumerate(_ASCII):
    _CLASS[list(_ASCII[_name])] = _i
_CLASS[0xC3:] = len(CLASSES) - 2
_CLASS[0x80:0xC0] = len(CLASSES)  # the rest of a code point: in no class

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def _repeated_words(grams: np.ndarray, n: int) -> int:
    """Words in 5-word windows found twice or more; ``grams`` are the windows' hashes."""
    s = np.sort(grams)
    if not (s[1:] == s[:-1]).any():
        return 0
    _, inverse, count = np.unique(grams, return_inverse=True, return_counts=True)
    mark = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(count[inverse] > 1)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + 5, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def _dup_lines(raw: bytes) -> int:
    seen, n = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(b" \t\r\x0b\x0c"):
            seen.add(line)
    return n


def _base(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents: the base counts (a row each), class counts, common-word counts, letter runs."""
    buf, offsets, _ = T.utf8(column)
    listed = np.array([T.word_hash(w) for w in COMMON], np.uint64)
    order = np.argsort(listed)
    listed = listed[order]
    for lo, hi in T.groups(offsets):
        part, b = offsets[lo : hi + 1] - offsets[lo], buf[offsets[lo] : offsets[hi]]
        h, first, end, at = T.words(b, part, T.SPACE, lower=False)
        n = np.diff(at)
        size = hi - lo

        def total(flags, part=part):
            return np.diff(np.concatenate(([0], np.cumsum(flags)))[part])

        code = (b & 0xC0) != 0x80
        word_chars, symbols = total(code & ~T.SPACE[b]), total(SYMBOLS[b])
        doc = np.repeat(np.arange(size), np.diff(part))
        classes = np.bincount(doc * (len(CLASSES) + 1) + _CLASS[b], minlength=size * (len(CLASSES) + 1)).reshape(size, -1)[:, :-1]
        grams = T.windows(h, 5)
        repeat = [_repeated_words(grams[a : z - 4], z - a) if z - a > 5 else 0 for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        lines = [_dup_lines(b[a:z].tobytes()) for a, z in zip(part[:-1].tolist(), part[1:].tolist(), strict=True)]
        lh, _, _, lat = T.words(b, part, T.NOT_LETTER, lower=True)
        near = np.searchsorted(listed, lh).clip(max=len(listed) - 1)
        known = np.where(listed[near] == lh, order[near], len(COMMON))
        ld = np.repeat(np.arange(size), np.diff(lat))
        common = np.bincount(ld * (len(COMMON) + 1) + known, minlength=size * (len(COMMON) + 1)).reshape(size, -1)
        yield np.stack([n, word_chars, symbols, np.array(lines), np.array(repeat)], 1), classes, common, np.diff(lat)


def _failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])


def references(df: DataFrame, text: str, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """Character-class and common-word histograms, a row for each language that has documents long enough for it.

    Where the medians of a language's few, unlike documents are all zero, the mean shares take their place.
    """

    def run(batches):
        for batch in batches:
            names, at = batch.column(1).to_pylist(), 0
            sums: dict[tuple, int] = {}
            for base, classes, common, _ in _base(batch.column(0)):
                chars, own = classes.sum(1), names[at : at + len(base)]
                for i in np.flatnonzero((chars >= LEAST_CHARS)):
                    if own[i] is None:
                        continue
                    for c, share in enumerate((classes[i] * BINS // chars[i]).tolist()):
                        sums[own[i], 0, c, share] = sums.get((own[i], 0, c, share), 0) + 1
                fine = ~_failed(base) & (common.sum(1) >= LEAST_WORDS)
                share = common * 1_000_000 // np.maximum(common.sum(1, keepdims=True), 1)
                for name in {x for x in own if x is not None}:
                    mine = fine & np.array([x == name for x in own])
                    for w in np.flatnonzero((total := share[mine].sum(0))).tolist():
                        sums[name, 1, w, 0] = sums.get((name, 1, w, 0), 0) + int(total[w])
                at += len(base)
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[j] for k in keys], pa.int32()) for j in (1, 2, 3)), pa.array(list(sums.values()), pa.int64())], ["lang", "kind", "dim", "bin", "n"])

    counts = df.select(F.col(text).cast("string"), F.col(lang).cast("string")).mapInArrow(T.freed(run), "lang string, kind int, dim int, bin int, n long")
    counts = counts.groupBy("lang", "kind", "dim", "bin").agg(F.sum("n").alias("n"))
    parts = counts.groupBy("lang", "kind", "dim").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"), F.sum(F.col("bin") * F.col("n")).alias("shares"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("bin"))
    step = lambda s, e: F.struct((s["seen"] + e["n"]).alias("seen"), F.when((s["bin"] < 0) & (2 * (s["seen"] + e["n"]) >= F.col("total")), e["bin"]).otherwise(s["bin"]).alias("bin"))
    middle = F.when(F.col("kind") == 0, F.aggregate("bins", start, step, lambda s: s["bin"]))
    chars: dict[str, np.ndarray] = {}
    words: dict[str, np.ndarray] = {}
    for r in parts.select("lang", "kind", "dim", middle.alias("middle"), "total", "shares").collect():
        if r.kind:
            words.setdefault(r.lang, np.zeros(len(COMMON) + 1))[r.dim] = r.total
        else:
            chars.setdefault(r.lang, np.zeros((2, len(CLASSES))))[:, r.dim] = r.middle, r.shares / r.total
    middle = [m if m.any() else mean for m, mean in (chars[x] for x in sorted(chars))]
    unit = lambda rows, n: np.array([r / r.sum() for r in rows]).reshape(len(rows), n)
    return unit(middle, len(CLASSES)), unit([words[x] for x in sorted(words)], len(COMMON) + 1)


def distance(counts: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row to its nearest reference; 0 without counts or references."""
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    best = np.full(len(p), np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        for q in references:
            m = (p + q) / 2
            best = np.minimum(best, (np.where(p > 0, p * np.log2(p / m), 0).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1)) / 2)
    return np.where(np.isfinite(best) & (counts.sum(1) > 0), np.sqrt(np.maximum(best, 0)), 0)


def judge(df: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the rules' findings for each row.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance,
    word_distance, kept.  A null text counts as empty, which fails the base rules.  A histogram of
    fewer than LEAST_CHARS signs or LEAST_WORDS words is not judged.  Without a row that names a
    language there is no reference and the base rules alone decide.  Rows are judged one by one:
    repeated rows and null ids need no rule; an empty table gives an empty result.
    """
    chars, words = references(df, text, lang)
    src = df.select(F.col(text).cast("string").alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    kinds = "".join(f"k{i} {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))

    def run(batches):
        for batch in batches:
            at = 0
            for base, classes, common, letters in _base(batch.column(0)):
                failed = _failed(base)
                dc = np.where(classes.sum(1) >= LEAST_CHARS, distance(classes, chars), 0)
                dw = np.where(letters >= LEAST_WORDS, distance(common, words), 0)
                kept = ~failed & (dc <= MOST_CHAR_DISTANCE) & (dw <= MOST_WORD_DISTANCE)
                n = len(base)
                yield pa.RecordBatch.from_arrays([*(batch.column(i + 1).slice(at, n) for i in range(len(keep))), *(pa.array(base[:, j].astype(np.int64)) for j in range(5)), pa.array(failed), pa.array(dc), pa.array(dw), pa.array(kept)], [*(f"k{i}" for i in range(len(keep))), *"abcdefghi"])
                at += n

    found = src.mapInArrow(T.freed(run), f"{kinds}a long, b long, c long, d long, e long, f boolean, g double, h double, i boolean")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(a).alias(b) for a, b in zip("abcdefghi", names, strict=True)])


def filter_documents(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``df`` that the rules keep."""
    whole = df.select(F.struct(*df.columns).alias("_row"), F.col(text), F.col(lang))
    out = judge(whole, text, lang=lang, keep=("_row",)).filter("kept")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in df.columns])


def op1(spark, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def base_counts(spark, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL can express."""
    return op1(spark, sf_dir).drop("kept", "char_distance", "word_distance")


SQL_BASE = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(l[i : i + 4], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 3)) AS i FROM w WHERE len(l) >= 5)),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM k WHERE c > 1) GROUP BY doc_id),
e AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id, x),
d AS (SELECT doc_id, sum(n - 1) AS n FROM e GROUP BY doc_id)
SELECT w.doc_id, len(l)::BIGINT AS n_words, length(array_to_string(l, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(l) AS base_failed
FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN d ON d.doc_id = w.doc_id
"""
