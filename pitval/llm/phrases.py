"""Phrase collocations by count streams in prefix and suffix order, merged without a hash table."""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from pitval.session import stack

from .common import keep, table

MAX_WORDS = 5
MIN_COUNT = 100
COVER_PERCENT = 100
TOP = 2000
CHUNK = 1 << 23
BLOCK = 1 << 16
#: A-Z to lower case, piece ends to a line feed, tabs to blanks. NUL separates words in keys, so a NUL of the text becomes "!", which no word holds.
FOLD = bytearray(range(256))
for _b in range(65, 91):
    FOLD[_b] = _b + 32
for _b in b".,;:!?\n\x0b\x0c\r":
    FOLD[_b] = 10
FOLD[9], FOLD[0] = 32, 33
FOLD = bytes(FOLD)


def escaped(group: bytes) -> bytes:
    """``group`` without NUL, so that a NUL behind it sorts below whatever else could follow."""
    return group.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01")


def pieces_of(text: bytes) -> bytes:
    """The words of a text, separated by NUL within a piece and by a line feed between pieces."""
    return b"\n".join([b"\0".join(p.split()) for p in text.translate(FOLD).split(b"\n") if p and not p.isspace()])


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the slices laid end to end, and the place that each of their bytes comes from."""
    to = np.concatenate(([0], np.cumsum(lengths)))
    return to, np.arange(to[-1]) + np.repeat(starts - to[:-1], lengths)


def window_counts(pieces: list[bytes], head: bytes, width: int) -> tuple[pa.Array, np.ndarray]:
    """The different windows of up to ``width`` words from every position, in order and behind ``head``, and how often each is there."""
    flat = np.frombuffer(b"\n".join([*pieces, b""]), np.uint8)
    ends = np.flatnonzero((flat == 0) | (flat == 10))
    starts = np.concatenate(([0], ends[:-1] + 1))
    closing = np.flatnonzero(flat[ends] == 10)  # the last word of each piece
    word = np.arange(len(ends))
    last = np.minimum(word + width - 1, closing[np.searchsorted(closing, word)])
    parts = []
    for lo in range(0, len(ends), BLOCK):
        first, stop = starts[lo:lo + BLOCK], ends[last[lo:lo + BLOCK]]
        to, at = _ranges(first, stop - first)
        parts.append(pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(to.astype("<i8")), pa.py_buffer(flat[at])]))
    windows = pa.concat_arrays(parts)
    windows = windows.take(pc.sort_indices(windows))
    new = np.concatenate(([True], pc.not_equal(windows[1:], windows[:-1]).to_numpy(zero_copy_only=False)))
    begin = np.flatnonzero(new)
    keys = pc.binary_join_element_wise(pa.scalar(head, pa.large_binary()), windows.take(pa.array(begin)), pa.scalar(b"", pa.large_binary()))
    return keys, np.diff(np.append(begin, len(new)))


def windows(docs: DataFrame, text: str, group: str, width: int, marks: list[bytes]) -> DataFrame:
    """``part, key, n``: windows of up to ``width`` words from every position, counted and put in order within chunks of a task.

    The key is the group, then the words, each behind a NUL: in byte order all phrases that
    begin with the same words lie together, whatever bytes the words hold. ``part`` counts
    the ``marks`` at or below the key.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[bytes, list[bytes]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, pieces in waiting.items():
                keys, n = window_counts(pieces, escaped(name) + b"\0", width)
                edges = [bisect_left(range(len(keys)), m, key=lambda i: keys[i].as_py()) for m in marks]
                part = np.searchsorted(edges, np.arange(len(keys)), "right").astype(np.int32)
                for lo in range(0, len(keys), BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array(part[lo:lo + BLOCK]), keys[lo:lo + BLOCK].cast(pa.binary()), pa.array(n[lo:lo + BLOCK])],
                                                     names=["part", "key", "n"])
            waiting.clear()

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if body and (pieces := pieces_of(body)):
                    waiting.setdefault(name, []).append(pieces)
                    size += len(pieces)
                    if size >= CHUNK:
                        yield from flush()
                        size = 0
        yield from flush()

    rows = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).cast("binary").alias("g"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(cut, "part int, key binary, n long")


def range_marks(docs: DataFrame, text: str, group: str, width: int, parts: int) -> list[bytes]:
    """Where to cut the ordered stream into ranges: one short key a range, from a sixteenth of the documents.

    The sample decides nothing but the sizes of the ranges. Letting the exchange find its
    own ranges would read and cut all texts twice.
    """
    some = windows(docs.sample(1 / 16, 7), text, group, width, []).select("key").repartitionByRange(parts, "key")
    least = some.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.substring("key", 1, 64)).alias("key"))
    return sorted(bytes(r["key"]) for r in least.collect())[1:]


def _flat(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary array and the offsets of its rows in them."""
    offsets = np.frombuffer(keys.buffers()[1], np.int32, len(keys) + 1, keys.offset * 4).astype(np.int64)
    body = np.frombuffer(keys.buffers()[2], np.uint8) if keys.buffers()[2] else np.empty(0, np.uint8)
    return body, offsets


def _shared(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes each row has in common with the row before; -1 for the first."""
    size = np.diff(offsets)
    both = np.minimum(size[1:], size[:-1])
    to, at = _ranges(offsets[1:-1], both)
    _, before = _ranges(offsets[:-2], both)
    differ = np.flatnonzero(body[at] != body[before])
    first = np.searchsorted(differ, to[:-1])
    found = np.append(differ, to[-1])[first]
    return np.concatenate(([-1], np.where(found < to[1:], found - to[:-1], both)))


def prefix_runs(keys: pa.Array, counts: np.ndarray, width: int, least: int) -> tuple[list[bytes], list[int]]:
    """Sums over the runs of equal first words of sorted keys, for 0 to ``width`` words.

    Runs below ``least`` are left out unless they touch an end of the stretch, where they may
    go on in the next one, or are whole groups (no words).
    """
    body, offsets = _flat(keys)
    size, shared, rows = np.diff(offsets), _shared(body, offsets), len(keys)
    row = np.repeat(np.arange(rows), size)
    lo = offsets[0]
    marks = np.flatnonzero(body[lo:offsets[-1]] == 0)
    of = row[marks]
    nth = np.arange(len(marks)) - np.searchsorted(of, np.arange(rows))[of]
    ends = np.full((rows, width + 1), -1, np.int64)  # where the group and the first k words end, within the row
    ends[of, nth] = marks + lo - offsets[of]
    words = np.bincount(of, minlength=rows)
    ends[np.arange(rows), words] = size
    sums = np.concatenate(([0], np.cumsum(counts)))
    out_keys, out_counts = [], []
    before = np.concatenate(([-1], size[:-1]))
    for k in range(width + 1):
        e = ends[:, k]
        has = e >= 0
        goes_on = has & ((e < shared) | (e == shared) & (before == shared))
        begin = np.flatnonzero(has & ~goes_on)
        stop = np.flatnonzero(~goes_on)
        stop = np.append(stop, rows)[np.searchsorted(stop, begin, "right")]
        n = sums[stop] - sums[begin]
        wanted = np.flatnonzero((n >= least) | (begin == 0) | (stop == rows) | (k == 0))
        for b, c in zip(begin[wanted].tolist(), n[wanted].tolist()):
            out_keys.append(body[offsets[b]:offsets[b] + e[b]].tobytes())
            out_counts.append(c)
    return out_keys, out_counts


def frequent(docs: DataFrame, text: str = "text", group: str = "lang", width: int = MAX_WORDS, least: int = MIN_COUNT) -> DataFrame:
    """``key, f``: every phrase of up to ``width`` words found ``least`` times or more in its group, and the groups with all their words.

    One row per position goes into one stream in prefix order, where a phrase of any length
    is a run of neighbours. Each stretch of the sorted stream sums its own runs; what touches
    its ends is added up afterwards. So nothing is held but one stretch, a phrase found
    anywhere is counted in full, and it does not matter where ranges are cut. Chunks arrive in
    order, so the sort of a range only merges them.
    """
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, n = prefix_runs(batch.column(0), batch.column(1).to_numpy(), width, least)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64())], names=["key", "f"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = windows(docs, text, group, width, range_marks(docs, text, group, width, parts))
    ordered = dealt.repartitionById(parts, "part").select("key", "n").sortWithinPartitions("key")
    some = ordered.mapInArrow(runs, "key binary, f long").groupBy("key").agg(F.sum("f").alias("f"))
    return keep(some.where((F.col("f") >= least) | (F.locate("\0", F.col("key").cast("string")) == 0)))


def turned(key: bytes) -> bytes:
    """The key with its words in reverse order."""
    head, *words = key.split(b"\0")
    return b"\0".join([head, *reversed(words)])


def stream(counts: DataFrame, backwards: bool) -> DataFrame:
    """``key, f, parts, more``: what one ordered count stream tells of each phrase.

    In prefix order the parts of a phrase that begin it stand above it, so a stack of open
    phrases is enough: ``parts`` has the counts of the first 0, 1, 2 ... words, ``more`` the
    highest count of a phrase one word longer that begins with it. In suffix order
    (``backwards``) the same holds for endings. The stream is cut into ranges; parts in an
    earlier range are looked up afterwards: they are the few open phrases at the start of
    each range. Rows for these, with null ``f``, carry their ``more``.
    """
    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        open_: list[list] = []  # key, f, highest count one word longer
        done: list[tuple] = []

        def close() -> None:
            key, f, more = open_[-1]
            done.append((key, f, [x[1] for x in open_[:-1]], more, at))
            open_.pop()

        def rows() -> pa.RecordBatch:
            names = ["key", "f", "parts", "more", "at"]
            kinds = [pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32()]
            out = pa.RecordBatch.from_arrays([pa.array([turned(x[0]) if backwards and i == 0 else x[i] for x in done], t) for i, t in enumerate(kinds)], names=names)
            done.clear()
            return out

        for batch in batches:
            for key, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                while open_ and not key.startswith(open_[-1][0] + b"\0"):
                    close()
                steps = key.split(b"\0")
                for k in range(len(open_), len(steps) - 1):  # only at the start of a range
                    open_.append([b"\0".join(steps[:k + 1]), None, 0])
                if open_:
                    open_[-1][2] = max(open_[-1][2], f)
                open_.append([key, f, 0])
            yield rows()
        while open_:
            close()
        yield rows()

    key = turned_column("key") if backwards else F.col("key")
    ordered = counts.select(key.alias("key"), "f").repartitionByRange("key").sortWithinPartitions("key")
    out = keep(ordered.mapInArrow(climb, "key binary, f long, parts array<long>, more long, at int"))
    missing = out.where(F.col("f").isNull()).select("key", "at", F.size("parts").alias("k"))
    known = missing.join(counts.select("key", F.col("f").alias("found")).hint("merge"), "key").groupBy("at").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "found"))).alias("above"))  # at most one open phrase of each length a range
    filled = out.join(known, "at", "left").withColumn("parts", F.transform("parts", lambda x, k: F.coalesce(x, F.element_at("above", k))))
    return filled.select("key", "f", F.when(F.col("f").isNotNull(), F.col("parts")).alias("parts"), "more")


def turned_column(key: str) -> Column:
    @F.arrow_udf("binary")
    def reverse(keys: pa.Array) -> pa.Array:
        return pa.array([turned(x) for x in keys.to_pylist()], pa.binary())

    return reverse(F.col(key))


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", width: int = MAX_WORDS, least: int = MIN_COUNT,
                 cover_percent: int = COVER_PERCENT) -> DataFrame:
    """``group, phrase, a, l, r, n, score`` of every phrase that stands for itself.

    Texts (null: empty) are lower-cased (A-Z) and cut at ``.,;:!?`` and line ends; words are
    separated by blanks and tabs. A candidate has 2 to ``width`` words and ``a >= least``
    occurrences in its group (null: ``und``). Cut after its first k words it has the counts
    ``l`` and ``r`` of both parts and the score ``floor(1000 a n / (l r))``, ``n`` being all
    word occurrences; the lowest-scoring cut counts, ties to the shortest first part. A
    candidate inside a longer one with ``100 f >= cover_percent a`` is dropped; as counts only
    fall with length, the phrases one word longer tell.

    The count stream is read in prefix order for left parts and words that follow, in suffix
    order for right parts and words that precede; both results, in key order, are merged. No
    step gathers the phrases of a word or a group. Repeated rows count as often as they come.
    An empty table gives an empty result; other columns are ignored.
    """
    counts = frequent(docs, text, group, width, least)
    before = stream(counts, False).select("key", "f", F.col("parts").alias("lefts"), F.lit(None).cast("array<long>").alias("rights"), "more")
    after = stream(counts, True).select("key", F.lit(None).cast("long").alias("f"), F.lit(None).cast("array<long>").alias("lefts"), F.col("parts").alias("rights"), "more")
    merged = (stack(before, after).repartitionByRange("key").sortWithinPartitions("key").groupBy("key")
              .agg(F.max("f").alias("a"), F.max("lefts").alias("lefts"), F.max("rights").alias("rights"), F.max("more").alias("more")))
    m = F.size("lefts")  # words of the phrase: parts of 0 to m - 1 words
    found = merged.where((m >= 2) & (100 * F.col("more") < cover_percent * F.col("a")))
    big = "decimal(38,0)"
    cuts = F.transform(F.sequence(F.lit(1), m - 1), lambda k: F.struct(
        F.get("lefts", k).alias("l"), F.get("rights", m - k).alias("r"), k.alias("k")))
    split = found.select("key", "a", F.get("lefts", F.lit(0)).alias("n"), F.inline(cuts))
    score = F.expr(f"cast(cast(1000 as {big}) * a * n as {big}) div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as {big})")
    best = split.withColumn("score", score).groupBy("key", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    whole = F.col("key").cast("string")
    name = F.replace(F.replace(F.substring_index(whole, "\0", 1), F.lit("\x01\x01"), F.lit("\0")), F.lit("\x01\x02"), F.lit("\x01"))
    words = F.expr("substring(cast(key as string), locate('\\u0000', cast(key as string)) + 1)")
    words = F.replace(F.replace(words, F.lit("\0"), F.lit(" ")), F.lit("!"), F.lit("\0"))
    return best.select(name.alias(group), words.alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")


def op12(spark, sf_dir: str) -> DataFrame:
    out = collocations(table(spark, sf_dir, "documents").select("text", "lang"))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return out.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= TOP).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
lists as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from lists where len(w) > 0),
grams as (select lang, w[i:i + k - 1] as g, k from starts, (select unnest(range(1, 6)) as k) where i + k - 1 <= len(w)),
counted as (select lang, g, k, count(*) as f from grams group by all),
total as (select lang, sum(f) as n from counted where k = 1 group by lang),
often as (select * from counted where f >= 100),
cut as (
  select o.lang, o.g, o.k, o.f as a, c.j, x.f as l, y.f as r, t.n,
         (1000::hugeint * o.f * t.n) // (x.f::hugeint * y.f) as score
  from often o, (select unnest(range(1, 5)) as j) c, often x, often y, total t
  where o.k >= 2 and c.j < o.k and x.lang = o.lang and x.g = o.g[1:c.j] and y.lang = o.lang and y.g = o.g[c.j + 1:o.k] and t.lang = o.lang),
best as (select *, row_number() over (partition by lang, g order by score, j) as p from cut),
covered as (
  select distinct lang, g, a from (
    select lang, k, f, b.s, b.m, often.g[b.s:b.s + b.m - 1] as part from often,
           (select s, m from (select unnest(range(1, 5)) as s), (select unnest(range(2, 5)) as m)) b
    where b.m < k and b.s + b.m - 1 <= k) z
  join (select lang as lang2, g, f as a from often) q on q.lang2 = z.lang and q.g = z.part
  where 100 * z.f >= 100 * q.a),
ranked as (
  select b.lang, row_number() over (partition by b.lang order by b.score desc, b.a desc, array_to_string(b.g, ' ')) as rank,
         array_to_string(b.g, ' ') as phrase, b.a, b.l, b.r, b.n, b.score
  from best b where b.p = 1 and not exists (select 1 from covered c where c.lang = b.lang and c.g = b.g))
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
"""
