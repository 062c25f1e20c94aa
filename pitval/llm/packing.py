"""Packing token sequences by bounded-space online best fit."""
from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import table

WINDOW = 1024
OPEN_BINS = 4096
END = 2
SPECIAL = "<|endoftext|>"
LONG_RUN = 10_000
BLANKS = re.compile(r"\s{%d}" % LONG_RUN)


@lru_cache(maxsize=2)
def encoder(folder: str, name: str = "byte_bpe_50k"):
    """``text -> ids`` of the byte-level vocabulary ``name``.

    The rank file holds the same vocabulary as the JSON file and is several times
    faster; a test compares both. Two kinds of texts go through the JSON file's own reader:
    those that spell a special token, which it knows, and those with a run of white space so
    long that the other reader's pattern would overflow its stack.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))

    def ids(text: str) -> list[int]:
        if SPECIAL in text or len(text) >= LONG_RUN and BLANKS.search(text):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)
    return ids


def tokenizer_folder() -> str:
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def cut_points(n: int, window: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens: whole windows, after a shorter first piece if need be."""
    first = n % window or min(n, window)
    starts = [0, *range(first, n, window)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


def pieces_column(text: str, window: int, end: int, folder: str) -> Column:
    kind = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"
    arrow = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    @F.arrow_udf(kind)
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder(folder)
        for batch in batches:
            out = []
            for x in batch:
                ids = np.array([*encode(x.as_py() or ""), end], "<u4")
                out.append([(k, a, n, zlib.crc32(ids[a:a + n])) for k, (a, n) in enumerate(cut_points(len(ids), window))])
            yield pa.array(out, arrow)

    return pieces(F.col(text))


class OpenBins:
    """A fixed number of open bins, found by free space through the bits of one integer.

    Bit f is set if an open bin has f tokens free. Best fit is the lowest set bit at
    or above the length. When a new bin is needed and all places are taken, the
    fullest open bin, the lowest set bit of all, closes.
    """

    def __init__(self, window: int, places: int):
        self.window, self.places, self.used, self.bits, self.made = window, places, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(window + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.used -= 1
        return b

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it."""
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            b = self._take(free)
        else:
            b, free, self.made = self.made, self.window, self.made + 1
            if self.used == self.places and free > length:
                self._take((self.bits & -self.bits).bit_length() - 1)
        if left := free - length:
            self.by_free[left].append(b)
            self.bits |= 1 << left
            self.used += 1
        return b, self.window - free


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, places: int = OPEN_BINS,
         folder: str | None = None) -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its token ids and ``end``; only documents longer than ``window`` are
    cut. Texts are tokenised where they are read; after that only piece descriptions
    move. They are dealt by a hash of the key and packed by each task on its own, in
    hash order, so that a long run of one source is mixed with others; adaptive
    execution makes the tasks large. A task holds at most ``places`` open bins. What
    is lost against one global packing is the bins open at the end of each task.
    A null or empty text is the single id ``end``. Repeated rows are packed as often
    as they come. An empty table gives no pieces.
    """
    folder = folder or tokenizer_folder()
    pieces = docs.select(F.col(key).alias("key"), F.explode(pieces_column(text, window, end, folder)).alias("p")).select("key", "p.*")
    order = F.xxhash64(F.col("key").cast("string"))
    dealt = pieces.withColumn("deal", order).repartition("deal").sortWithinPartitions("deal", "key", "piece", "start")

    cols = ["key", "piece", "start", "length", "ids_crc32"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(window, places), TaskContext.get().partitionId() << 40
        for t in batches:
            at = [bins.put(n) for n in t.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array([base + b for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())],
                                             names=[*cols, "sequence_id", "offset"])

    kind = f"key {dict(docs.dtypes)[key]}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.select(*cols).mapInArrow(fill, kind).withColumnRenamed("key", key)


def op2(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
