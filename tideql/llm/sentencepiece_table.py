"""SentencePiece encoding and decoding with a distinct-chunk table.

Where no piece of the vocabulary has a white-space marker after another sign, a
merge never crosses the start of a marked word, so a text's ids are those of its
marked words, one after another.  The texts of a batch are cut into marked words,
``PART`` bytes at a time; each distinct word is segmented and decoded once by the
library, and the ids and decoded words are joined back by position, in numpy and
Arrow.  Most distinct words of a corpus are found once, so a table kept for longer
saves little, and one of the whole corpus would need every word to be shuffled; a
table lives as long as its part, which bounds memory.  A model of another kind is
detected, and its texts are handed to the library whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

MARK = "▁"
#: Bytes of text that share a table, or one longer text.
PART = T.BATCH


def model_file(path: str | None) -> str:
    """The model's place on this machine; the default is the public 32k model."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Chunks:
    """A model, and how its texts fall into marked words."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file(path))
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        self.lone = self.sp.piece_to_id(MARK)
        probe = "a  b c"  # white space is kept, and each word is marked in front
        self.apart = not any(MARK in p.lstrip(MARK) for p in pieces) and self.sp.decode(self.sp.encode(f" {probe} ")) == f" {probe} " and not self.sp.is_unknown(self.lone) and self.sp.encode("Ａﬁ") != self.sp.encode("Afi")

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The texts' marked words, without their first marker, back to back, and each text's first word (one entry more than texts).

        A run of markers belongs to the word after it; null and empty texts have no words.
        """
        if self.apart:
            texts = pc.replace_substring(texts, MARK, " ")
        buf, part, _ = T.utf8(texts)
        full = np.diff(part) > 0
        if self.apart and len(buf):
            space = buf == 32
            cut = space.copy()
            cut[1:] &= ~space[:-1]
            cut[part[:-1][full]] = False
        else:
            cut = np.zeros(len(buf), bool)
        start = np.sort(np.concatenate((np.flatnonzero(cut), part[:-1][full])))
        gone = np.concatenate(([0], np.cumsum(cut)))
        ends = np.append(start - gone[start], len(buf) - gone[-1]).astype(np.int32)
        return pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf[~cut]))), np.searchsorted(start, part)

    def encode(self, words: list[str]) -> list[list[int]]:
        found = self.sp.encode(words, num_threads=1)
        return [ids if w or not self.apart else [self.lone] for w, ids in zip(words, found, strict=True)]


def parts(texts: pa.Array, most: int = PART) -> Iterator[pa.Array]:
    """``texts`` in slices of about ``most`` bytes, one text at least."""
    _, offsets, _ = T.utf8(texts)
    for lo, hi in T.groups(offsets, most):
        yield texts.slice(lo, hi - lo)


def _joined(texts: pa.Array, chunks: Chunks, eos: bool, decode: bool) -> list[pa.Array]:
    """Lists of ids and, with ``decode``, decoded texts."""
    words, at = chunks.split(texts)
    table = words.dictionary_encode()
    found = chunks.encode(table.dictionary.to_pylist())
    place = np.asarray(table.indices)
    sizes = np.fromiter(map(len, found), np.int32, len(found))
    if eos:  # the end is one more word of each text
        place = np.insert(place, at[1:], len(found))
        sizes = np.append(sizes, np.int32(1))
    flat = np.fromiter(chain(chain.from_iterable(found), [chunks.sp.eos_id()] * eos), np.int32, int(sizes.sum()))
    n, start = sizes[place], np.cumsum(sizes, dtype=np.int32) - sizes
    upto = np.concatenate((np.zeros(1, np.int32), np.cumsum(n, dtype=np.int32)))  # an Arrow list has no more either
    take = np.repeat(start[place] - upto[:-1], n)
    take += np.arange(upto[-1], dtype=np.int32)
    ids = flat[take]
    of = at + np.arange(len(at)) * eos
    out = [pa.ListArray.from_arrays(pa.array(upto[of]), pa.array(ids))]
    if decode:
        said = pa.array(chunks.sp.decode(found, num_threads=1) if found else [], pa.string()).take(table.indices)
        out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), said), " "))
    return out


_MODELS: dict[str | None, Chunks] = {}


def model_of(path: str | None) -> Chunks:
    """This worker's copy of a model."""
    if path not in _MODELS:
        _MODELS[path] = Chunks(path)
    return _MODELS[path]


def encode(df: DataFrame, text: str | Column = "text", keep: tuple[str, ...] = ("doc_id",), model: str | None = None, eos: bool = True, decode: bool = True) -> DataFrame:
    """The columns ``keep``, ``ids`` (array of int) and, with ``decode``, ``decoded``, a row for each row of ``df``.

    A null or empty text has the end id alone (none without ``eos``) and decodes to the empty text.
    Repeated rows give repeated rows; an empty table gives an empty one; other columns of ``df``
    are never looked at.
    """
    src = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], (F.col(text) if isinstance(text, str) else text).cast("string").alias("t"))
    schema = ", ".join(f"k{i} {t}" for i, (_, t) in enumerate(src.dtypes[:-1])) + ", ids array<int>" + ", decoded string" * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, names = model_of(model), [f"k{i}" for i in range(len(keep))] + ["ids"] + ["decoded"] * decode
        for batch in batches:
            at = 0
            for some in parts(batch.column(len(keep))):
                cols = [batch.column(i).slice(at, len(some)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(cols + _joined(some, chunks, eos, decode), names)
                at += len(some)

    out = src.mapInArrow(T.freed(run), schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids", *["decoded"] * decode)


def op10(spark, sf_dir: str) -> DataFrame:
    return digest(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def digest(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
