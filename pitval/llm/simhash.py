"""Near duplicates by SimHash, found with multi-index hashing."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pitval.session import cut, stack

from .common import free, table
from .components import components

SEED = 42
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash over word shingles, as a signed integer.

    A-Z are lower-cased, words are split at ASCII white space, shingles count as
    often as they occur. A bit is 1 if more than half of the shingle hashes have it.
    Fewer words than ``width``: the whole sequence is the only shingle. No word, or
    a null text: 0. Hashes are summed in blocks, so a long text needs no large table.
    """
    n, totals = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, width):
        n += len(hashes)
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * totals > n, bitorder="little").view("<i8")[0])


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of a text, in blocks; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined, last = b" ".join(words), min(width, len(words)) - 1
    ends = list(accumulate((len(w) + 1 for w in words)))
    n = len(words) - last
    for lo in range(0, n, BLOCK):
        hi = min(lo + BLOCK, n)
        begins = ends[lo - 1:hi - 1] if lo else [0, *ends[:hi - 1]]
        yield np.array([xxhash.xxh64_intdigest(joined[a:b - 1], SEED) for a, b in zip(begins, ends[lo + last:hi + last])], "<u8")


def fingerprint_column(text: str, width: int = 3) -> Column:
    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(x.as_py(), width) for x in batch], pa.int64())

    return simhash(F.col(text))


def segments(bits: int, parts: int) -> list[tuple[int, int]]:
    """``(shift, width)`` of the segments a fingerprint is cut into."""
    cuts = [bits * i // parts for i in range(parts + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def radii(distance: int, parts: int) -> list[int]:
    """Radius per segment. The radii sum to ``distance - parts + 1``.

    If every segment differed in more bits than its radius, the whole would differ
    in at least that sum plus ``parts`` bits, which is more than ``distance``. So
    probing these balls misses no pair. A negative radius: the segment is not probed.
    """
    spare = distance - parts + 1
    return [-1] * parts if spare < 0 and parts > distance + 1 else [spare // parts + (i < spare % parts) for i in range(parts)]


def links(prints: DataFrame, distance: int = 2, parts: int = 2) -> DataFrame:
    """All pairs ``(a, b)`` of nodes whose fingerprints differ in at most ``distance`` bits.

    ``prints``: distinct ``fp`` with its ``node``. Every fingerprint is stored once
    per segment; it looks up the values of a small Hamming ball around each of its
    segments, and the join verifies the complete distance before it emits a pair.
    As fingerprints are distinct, one of them has at most as many partners as its
    ball holds points, however many documents are copies. With the default, 33 + 1
    look-ups per fingerprint find every pair at 2 bits.
    """
    if parts > distance + 1:
        raise ValueError("more segments than distance + 1 leave segments without a look-up")

    def value(shift, width):
        return F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1))

    store, probe = [], []
    for k, ((shift, width), radius) in enumerate(zip(segments(64, parts), radii(distance, parts))):
        if radius < 0:
            continue
        own = value(shift, width)
        store.append(F.struct(F.lit(k).alias("k"), own.alias("v")))
        flips = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]
        probe.append(F.array(*[F.struct(F.lit(k).alias("k"), own.bitwiseXOR(F.lit(f).cast("long")).alias("v")) for f in flips]))
    stored = prints.select("fp", "node", F.inline(F.array(*store)))
    asked = prints.select(F.col("fp").alias("fp2"), F.col("node").alias("node2"), F.inline(F.concat(*probe)))
    near = (F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance)
    # not broadcast: Spark sizes ``asked`` as if each fingerprint made one row
    return stored.hint("merge").join(asked.hint("merge"), ["k", "v"]).where(near).select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2, parts: int = 2) -> DataFrame:
    """``key, fp, component_id, text_hash, component`` per row; ``component_id`` is the smallest key reachable over links.

    ``component`` is the smallest fingerprint reachable: unlike texts that share a key are not linked by it.
    Exact copies share a fingerprint and are grouped before any pair is looked for,
    so a large group of copies is one node. Nulls and empty texts have fingerprint 0
    and are linked like any other. Rows with a null key get their own fingerprint's
    component (null if no key is known there). Repeated rows are returned as often
    as they come. An empty table gives an empty result. Other columns are ignored.
    """
    marks = cut(docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), fingerprint_column(text, width).alias("fp")))
    nodes = marks.groupBy("fp").agg(F.min("key").alias("first"))
    roots = components(links(nodes.select("fp", F.col("fp").alias("node")), distance, parts)).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return marks.join(named.join(least, "component").drop("first"), "fp").select(F.col("key").alias(key), "fp", "component_id", "text_hash", "component")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest key, of equal keys with the smallest text hash.

    Rows that repeat both key and text of a kept document count as one document. Rows
    that share a key and not their texts are documents of their own. Rows without a key have no group and stay.
    """
    return first_of_each(docs, near_duplicates(docs, key, text, **how), key, text)


def first_of_each(docs: DataFrame, near: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document of every ``component`` in ``near``, by key, then hash of the text; one of rows that repeat both, and all rows without a key.

    Null and empty texts are documents like any other. An empty table stays empty.
    """
    first = (near.where(F.col(key).isNotNull()).groupBy("component").agg(F.min(F.struct(F.col(key).alias("k"), F.col("text_hash").alias("t"))).alias("first"))
             .select("first.*").withColumnsRenamed({"k": (mine := free(docs, "k")), "t": (its := free(docs, "t"))}))
    row, plain = free(docs, "row"), [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    kept = (docs.join(first, (docs[key] == F.col(mine)) & (F.xxhash64(docs[text]) == F.col(its)), "left_semi").groupBy(key, F.xxhash64(text))
            .agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias(row)).select(f"{row}.*"))
    return stack(kept.select(*docs.columns), docs.where(F.col(key).isNull()))


def merged(near: DataFrame, also: DataFrame) -> DataFrame:
    """The rows of ``near`` with its ``component`` joined to others where ``also``, made of the same texts, holds texts of both in one.

    Only components that differ in the two give a link, so few rows go into the union.
    """
    both = (near.select("text_hash", F.col("component").alias("a")).distinct()
            .join(also.select("text_hash", F.col("component").alias("other")).distinct(), "text_hash").select("a", "other").distinct())
    least = both.groupBy("other").agg(F.min("a").alias("b"))
    roots = components(both.join(least, "other").where("a <> b").select("a", "b")).withColumnRenamed("node", "component")
    out = near.drop("component_id").join(roots, "component", "left")
    return out.withColumn("component", F.coalesce("root", "component")).drop("root")


def op10(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
