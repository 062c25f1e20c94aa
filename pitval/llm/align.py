"""Alignment of two tokenizers by merge-path pieces, and how often their entries meet in a corpus."""
from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import keep, table
from .packing import tokenizer_folder

PIECE = 1 << 16
BLOCK_LINKS = 1 << 21
BATCH_BYTES = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level vocabulary from its JSON file. Strings of special tokens in a text are plain text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet, names = byte_alphabet(), self.tokenizer.get_vocab(with_added_tokens=True)
        self.entries = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.entries[i] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A piece vocabulary with byte fallback, which puts a blank before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.entries = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of a blank and each text; the model itself puts no blank before an empty one."""
        return [ids if t else [self.model.piece_to_id("▁")] for t, ids in zip(texts, self.model.encode(texts, num_threads=1))]


@lru_cache(maxsize=4)
def reader(folder: str, name: str) -> ByteLevel | Pieces:
    path = os.path.join(folder, name)
    return ByteLevel(path) if name.endswith(".json") else Pieces(path)


def diagonal(a: np.ndarray, b: np.ndarray, d: int) -> int:
    """How many of the first ``d`` steps of the merge of two rising rows come from ``a``; of equal ends that of ``a`` comes first."""
    lo, hi = max(0, d - len(b)), min(d, len(a))
    while lo < hi:
        i = (lo + hi) // 2
        if a[i] <= b[d - i - 1]:
            lo = i + 1
        else:
            hi = i
    return lo


def merge_piece(a: np.ndarray, b: np.ndarray, i: tuple[int, int], j: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For each end of one piece of the merge path, the token of the other row that holds it: by ends of ``a``, by ends of ``b``."""
    x, y = a[i[0]:i[1]], b[j[0]:j[1]]
    return j[0] + np.searchsorted(y, x), i[0] + np.searchsorted(x, y)


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(to_b, to_a, shared_a, shared_b)`` of two gapless rows of tokens over the same bytes, given their ends.

    Every overlap ends where one of its tokens ends, so the overlaps are the pairs
    ``(i, to_b[i])`` of all ends of ``a`` and ``(to_a[j], j)`` of those ends of ``b`` that ``a``
    does not have. Diagonals at every ``piece`` steps cut the merge of the ends; a binary search
    finds where each crosses, so pieces have equal work however unlike the rows are, and none
    needs another. An end that both rows have may fall on a cut, its copy in ``a`` before, that
    in ``b`` after it. Stitching marks such ends in both rows (``shared``): a group ends there.
    """
    n = len(a) + len(b)
    cuts = [(i := diagonal(a, b, d), d - i) for d in [*range(0, n, piece), n]]
    parts = [merge_piece(a, b, (i, x), (j, y)) for (i, j), (x, y) in zip(cuts, cuts[1:])] or [(np.empty(0, np.int64),) * 2]
    to_b, to_a = (np.concatenate(x) for x in zip(*parts))
    shared_a, shared_b = b[to_b] == a, np.zeros(len(b), bool)
    shared_b[to_b[shared_a]] = True
    return to_b, to_a, shared_a, shared_b


#: A stretch that begins with a blank after something else than white space. No entry of either vocabulary reaches across its start.
CHUNK = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
CHUNK_CHARS = 64
CHUNKS_KEPT = 400_000


class Aligner:
    """Two vocabularies and the tables that their alignment needs.

    Tokens never reach across the start of a ``CHUNK``: byte-level words end before white
    space, and no piece has a blank after another character (checked when the tables are
    made). So chunks are read one by one, and the ids of short ones are kept, up to a bound.
    """

    def __init__(self, folder: str, left: str, right: str):
        self.left, self.right = reader(folder, left), reader(folder, right)
        if any(b" " in x.lstrip(b" ") for x in self.right.entries):
            raise ValueError(f"{right} has entries that reach across words")
        self.size = [np.array([len(x) for x in v.entries], np.int64) for v in (self.left, self.right)]
        self.base = len(self.right.entries)
        self.spell = pa.array([b"%d%c" % (i, end) for v, ends in ((self.left, b",|"), (self.right, b",;")) for i in range(len(v.entries)) for end in ends],
                              pa.large_binary())
        self._start()

    def _start(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.begin, self.count = [np.empty(0, np.int32)] * 2, [np.empty(0, np.int64)] * 2, [np.empty(0, np.int64)] * 2
        self.bad = np.empty(0, bool)

    def _read(self, chunks: list[str]) -> None:
        """Ids of new chunks, appended to the tables."""
        rows = self.left.encode(chunks), self.right.encode([c[1:] for c in chunks])
        spelled = [c.encode("utf-8", "surrogatepass") for c in chunks]
        for k, (v, ids) in enumerate(zip((self.left, self.right), rows)):
            n = np.array([len(x) for x in ids], np.int64)
            self.begin[k] = np.concatenate([self.begin[k], len(self.flat[k]) + np.cumsum(n) - n])
            self.count[k] = np.concatenate([self.count[k], n])
            self.flat[k] = np.concatenate([self.flat[k], np.fromiter(chain.from_iterable(ids), np.int32, n.sum())])
        bad = [any(b"".join([v.entries[i] for i in x]) != c for v, x in ((self.left, x), (self.right, y))) for c, x, y in zip(spelled, *rows)]
        self.bad = np.concatenate([self.bad, np.array(bad, bool)])

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of all texts end to end and where each text's begin, by both vocabularies; none of texts that are empty or that either does not give back."""
        if len(self.at) > CHUNKS_KEPT:
            self._start()
        per_text = [CHUNK.findall(" " + t) if t else [] for t in texts]
        chunks = list(chain.from_iterable(per_text))
        new = sorted({*chunks}.difference(self.at), key=lambda c: len(c) > CHUNK_CHARS)
        n_kept = len(self.bad)
        known = {c: n_kept + i for i, c in enumerate(new)}
        if new:
            self._read(new)
            self.at |= known
        which = np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))
        text = np.repeat(np.arange(len(texts)), [len(c) for c in per_text])
        if self.bad[which].any():
            ok = np.ones(len(texts), bool)
            ok[text[self.bad[which]]] = False
            which, text = which[ok[text]], text[ok[text]]
        out, edges = [], []
        for k in range(2):
            n = self.count[k][which]
            to = np.concatenate(([0], np.cumsum(n)))
            out.append(self.flat[k][np.arange(to[-1]) + np.repeat(self.begin[k][which] - to[:-1], n)])
            edges.append(to[np.searchsorted(text, np.arange(len(texts) + 1))])
        short = n_kept + sum(len(c) <= CHUNK_CHARS for c in new)
        if short < len(self.bad):  # long chunks, the last ones, are not kept
            for k in range(2):
                self.flat[k] = self.flat[k][:self.begin[k][short]]
                self.begin[k], self.count[k] = self.begin[k][:short], self.count[k][:short]
            self.bad = self.bad[:short]
            for c in new[short - n_kept:]:
                del self.at[c]
        return out, edges

    def align(self, a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return overlaps(np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b]), piece)

    def spelled(self, a: np.ndarray, b: np.ndarray, to_b: np.ndarray, shared_a: np.ndarray, shared_b: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;``: the ids of each group, end to end, and where the spelling of each id of ``a`` begins."""
        last_a = np.flatnonzero(shared_a)
        last_b = to_b[last_a]  # last tokens of each group
        group_a, group_b = np.cumsum(shared_a) - shared_a, np.cumsum(shared_b) - shared_b
        code = np.empty(len(a) + len(b), np.int64)
        place = np.arange(len(a)) + np.concatenate(([0], last_b + 1))[group_a]
        code[place] = 2 * a.astype(np.int64) + shared_a
        code[np.arange(len(b)) + last_a[group_b] + 1] = 2 * (b.astype(np.int64) + len(self.left.entries)) + shared_b
        text = self.spell.take(pa.array(code))
        offsets = np.frombuffer(text.buffers()[1], np.int64, len(code) + 1)
        return memoryview(text.buffers()[2] or b""), np.append(offsets[place], offsets[-1])


@lru_cache(maxsize=2)
def aligner(folder: str, left: str, right: str) -> Aligner:
    return Aligner(folder, left, right)


def batches_of(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that their texts, the first column, hold about ``most`` bytes."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def pack_steps(places: np.ndarray) -> bytes:
    """Rising numbers as their steps, low bytes first and byte planes apart, which compresses well. The order of links does not count."""
    steps = np.diff(np.sort(places).astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_steps(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view("<u4").ravel().astype(np.int64))


PAIR = pa.struct([("code", pa.int64()), ("n", pa.int64())])


def aligned_blocks(docs: DataFrame, key: str, text: str, left: str, right: str, folder: str) -> DataFrame:
    """Written rows: a document each, with its links; and, at the end of each block of documents, its different codes with their counts.

    A block is what one task reads until it has ``BLOCK_LINKS`` links, so it is bounded but for
    a single longer document. A code is ``a * size of the right vocabulary + b``; a document's
    links are places among the block's codes in rising order.
    """
    names = ["key", "block", "n_a", "n_b", "n_groups", "links", "groups_sha256", "pairs"]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = aligner(folder, left, right)
        block, inside = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []  # key, n_a, n_b, n_groups, digest, codes
        kinds: list[pa.DataType] = []

        def close() -> Iterator[pa.RecordBatch]:
            codes, place, n = np.unique(np.concatenate([r[5] for r in rows]), return_inverse=True, return_counts=True)
            at = 0
            for lo in range(0, len(rows), 1000):
                part, links = rows[lo:lo + 1000], []
                for r in part:
                    links.append(pack_steps(place[at:at + len(r[5])]))
                    at += len(r[5])
                key, n_a, n_b, n_groups, sha, _ = zip(*part)
                cols = [key, [block] * len(part), n_a, n_b, n_groups, links, sha, [None] * len(part)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)
            both = pa.StructArray.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n)], names=["code", "n"])
            cols = [pa.nulls(1, kinds[0]), pa.array([block]), *[pa.nulls(1, t) for t in kinds[2:7]],
                    pa.ListArray.from_arrays(pa.array([0, len(both)], pa.int32()), both)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

        small = len(two.left.entries) * two.base < 1 << 31
        for batch in batches_of(batches):
            kinds = kinds or [batch.column(1).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(PAIR)]
            (a, b), (at_a, at_b) = two.tokens(batch.column(0).to_pylist())
            to_b, to_a, shared_a, shared_b = two.align(a, b)
            wide = np.int32 if small else np.int64
            of_a = a.astype(wide) * wide(two.base) + b[to_b]
            of_b = a[np.minimum(to_a, max(len(a) - 1, 0))].astype(wide) * wide(two.base) + b
            groups = np.concatenate(([0], np.cumsum(shared_a)))
            body, starts = two.spelled(a, b, to_b, shared_a, shared_b)
            for k, key in enumerate(batch.column(1).to_pylist()):
                (a0, a1), (b0, b1) = at_a[k:k + 2], at_b[k:k + 2]
                code = np.concatenate([of_a[a0:a1], of_b[b0:b1][~shared_b[b0:b1]]])
                sha = hashlib.sha256(body[starts[a0]:starts[a1] - 1]).hexdigest() if a1 > a0 else ""
                rows.append((key, int(a1 - a0), int(b1 - b0), int(groups[a1] - groups[a0]), sha, code))
                inside += len(code)
                if inside >= BLOCK_LINKS:
                    yield from close()
                    block, inside, rows = block + 1, 0, []
        if rows:
            yield from close()

    kind = (f"key {dict(docs.dtypes)[key]}, block long, n_a long, n_b long, n_groups long, links binary, groups_sha256 string, "
            "pairs array<struct<code:long,n:long>>")
    return keep(docs.select(F.col(text).alias("text"), F.col(key).alias("key")).mapInArrow(align, kind))


def pair_counts(blocks: DataFrame, base: int) -> DataFrame:
    """``code, count, best``: how many links of the corpus hold a pair of ids, and whether no pair with its right id is more frequent."""
    counts = blocks.select(F.inline("pairs")).groupBy("code").agg(F.sum("n").alias("count"))
    counts = keep(counts.withColumn("b", F.col("code") % base))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("code", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", left: str = "byte_bpe_50k.json", right: str = "piece_bpe_32k.model",
          folder: str | None = None) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row.

    Both vocabularies read a blank and the text. Where tokens of both end, a group ends; a link
    is a pair of tokens, one of each, whose bytes overlap. ``count_sum`` adds up, over the links
    of a row, how many links of all rows join the same two ids; ``n_best`` counts the links
    whose pair is the most frequent one of its right id (ties included).

    Texts are tokenised once, where they are read. Blocks of documents send their different
    pairs, already counted, to be summed, and get the sums of just these pairs back, so neither
    a frequent pair nor a hot id gathers links. Rows whose text is null, empty, or not given
    back byte for byte by either vocabulary have zeros and an empty digest. Repeated rows count
    as often as they come; keys may be null or repeat. An empty table gives an empty result;
    other columns are ignored. ``group_rows`` returns the groups themselves.
    """
    folder = folder or tokenizer_folder()
    base = len(reader(folder, right).entries)
    blocks = aligned_blocks(docs, key, text, left, right, folder)
    asked = blocks.where(F.col("pairs").isNotNull()).select("block", F.explode("pairs.code").alias("code"))
    answers = asked.join(pair_counts(blocks, base), "code")
    rows = blocks.where(F.col("pairs").isNull()).drop("pairs").select("*", F.col("block").alias("of")).drop("block")
    names = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def score(docs: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("code")
        count, best = known["count"].to_numpy(), known["best"].to_numpy()
        out = []
        for x in docs["links"]:
            at = unpack_steps(x.as_py())
            out.append((len(at), int(best[at].sum()), int(count[at].sum())))
        cols = [pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 3
        return pa.table([docs["key"], docs["n_a"], docs["n_b"], docs["n_groups"], *cols, docs["groups_sha256"]], names=names)

    kind = f"key {dict(docs.dtypes)[key]}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("of").cogroup(answers.groupBy("block")).applyInArrow(score, kind).withColumnRenamed("key", key)


def group_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", left: str = "byte_bpe_50k.json", right: str = "piece_bpe_32k.model",
               folder: str | None = None) -> DataFrame:
    """``key, group, start, end, a_ids, b_ids``: every group of every text with its bytes in a blank and the text. Texts without tokens have no rows."""
    folder = folder or tokenizer_folder()

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = aligner(folder, left, right)
        for batch in batches_of(batches):
            (a, b), (at_a, at_b) = two.tokens(batch.column(0).to_pylist())
            to_b, _, shared, _ = two.align(a, b)
            stop_a = np.flatnonzero(shared) + 1
            stop_b = to_b[shared] + 1
            bytes_at = np.concatenate(([0], np.cumsum(two.size[0][a])))
            doc = np.searchsorted(at_a[1:], stop_a)  # the first text whose tokens reach so far
            first = np.searchsorted(stop_a, at_a[:-1], "right")
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stop)).astype(np.int32)), pa.array(ids.astype(np.int32)))
                     for stop, ids in ((stop_a, a), (stop_b, b))]
            ends = bytes_at[stop_a]
            begin = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(doc)), pa.array(np.arange(len(doc)) - first[doc]),
                                              pa.array(begin - bytes_at[at_a[doc]]), pa.array(ends - bytes_at[at_a[doc]]), *lists],
                                             names=["key", "group", "start", "end", "a_ids", "b_ids"])

    kind = f"key {dict(docs.dtypes)[key]}, group long, start long, end long, a_ids array<int>, b_ids array<int>"
    return docs.select(F.col(text).alias("text"), F.col(key).alias("key")).mapInArrow(groups, kind).withColumnRenamed("key", key)


def op11(spark, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"))
