"""Sampled segmentation into pieces, and its exact inverse."""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import table

CHUNK = re.compile(r" *(?:[^\W\d_²]+|(?:[\d_²]|[^\w \n])+)|\n| +")
SPACE, NO_PIECE = 0x2581, 0x110000
BASE = np.uint64(0x9E3779B97F4A7C15)
CHUNKS_KEPT, TEXT_PART = 60_000, 400_000


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _uniform(seed: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit seeds, each on its own (the splitmix64 finish)."""
    z = seed.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z ^= z >> np.uint64(shift)
        z *= np.uint64(factor)
    z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


class Index(dict):
    """Numbers keys in the order they are first asked for; ``new`` lists those not yet worked on."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        n = self[key] = len(self)
        return n


class Sampler:
    """Lattices of the chunks of texts, kept while they repeat, and sampling on all of them at once.

    A piece holds spaces only at its beginning, no newline, and not both letters and other
    signs. So the lattice of a text falls apart into those of its chunks (spaces, then a
    run of either kind), and sampling chunk by chunk samples the whole. Piece probabilities follow the vocabulary's order
    (Zipf): -``sharpness`` log(rank). A character without a piece is its UTF-8 bytes.
    """

    def __init__(self, model: str, sharpness: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte = {int(n[3:5], 16): i for i, n in enumerate(names) if sp.is_byte(i)}
        plain = {n: i for i, n in enumerate(names) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        if any(len(CHUNK.findall(n.replace(chr(SPACE), " "))) != 1 for n in plain):
            raise ValueError("pieces that reach over chunks need another chunking")
        rank = {n: r for r, n in enumerate(sorted(plain, key=lambda n: (-sp.get_score(plain[n]), plain[n])), 1)}
        self.byte_cost = -sharpness * float(np.log(len(plain) + 1))
        self.cost = np.zeros(len(names))
        for n, i in plain.items():
            self.cost[i] = -sharpness * np.log(rank[n])
        self.text = spellings(model)
        found: dict[int, dict[int, int]] = {}
        for n in plain:
            h = 0
            for k, c in enumerate(n, 1):
                h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                table = found.setdefault(k, {})
                if k == len(n):
                    table[h] = plain[n]
                else:
                    table.setdefault(h, -1)
        self.longest = max(found)
        self.tables = {}
        for k, t in found.items():
            keys = np.array(sorted(t), np.uint64)
            self.tables[k] = (keys, np.array([t[int(h)] for h in keys], np.int64))
        self._start()

    def _start(self):
        self.at = Index()
        self.base, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.cdf, self.piece, self.back = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.first_edge = np.zeros(0, np.int32)
        self.nodes = 0

    def _edges(self, code: np.ndarray, room: np.ndarray):
        """``(begin, length, piece)`` of every piece in the flat codes; ``room`` is the distance to the chunk's end."""
        begins, lengths, pieces = [], [], []
        alive, h = np.arange(len(code)), np.zeros(len(code), np.uint64)
        for k in range(1, self.longest + 1):
            keep = room[alive] >= k
            alive, h = alive[keep], h[keep]
            if not len(alive):
                break
            h = h * BASE + code[alive + (k - 1)].astype(np.uint64) + np.uint64(1)
            keys, ids = self.tables[k]
            spot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[spot] == h
            got = np.where(hit, ids[spot], -1)
            if k == 1:
                for i in np.flatnonzero(got < 0):
                    c = int(code[i])
                    got[i] = self.byte.get(c, -2 - c) if c < 0x80 else -2 - c
            good = got != -1
            begins.append(alive[good])
            lengths.append(np.full(good.sum(), k))
            pieces.append(got[good])
            alive, h = alive[hit], h[hit]
        return np.concatenate(begins[::-1]), np.concatenate(lengths[::-1]), np.concatenate(pieces[::-1])  # long pieces, mostly the likely ones, first

    def _add(self, chunks: list[str]):
        """Forward filtering of new chunks: per node the cumulative chance of every edge that ends there."""
        size = np.array([len(c) for c in chunks], np.int64)
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        code = np.where(code == 0x20, SPACE, np.where(code == SPACE, NO_PIECE, code))
        start = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(chunks)), size)
        begin, length, piece = self._edges(code, np.repeat(start + size, size) - np.arange(len(code)))
        who = owner[begin]
        frm = begin + who  # a chunk of n characters has n + 1 nodes
        to = frm + length
        order = np.argsort(to, kind="stable")
        frm, to, piece = frm[order], to[order], piece[order]
        bytes_in = np.where(piece <= -2, 1 + (-2 - piece >= 0x800) + (-2 - piece >= 0x10000) * (-2 - piece != NO_PIECE) + 1, 1)
        cost = np.where(piece >= 0, self.cost[np.maximum(piece, 0)], self.byte_cost * bytes_in)
        cost = np.where((piece >= 3) & (piece < 259), self.byte_cost, cost) if self.byte else cost
        n = len(code) + len(chunks)
        alpha = np.full(n, -np.inf)
        first = start + np.arange(len(chunks))
        alpha[first] = 0.0
        depth = to - (first[owner[begin]])[order]
        weight = np.empty(len(to))
        by_depth = np.argsort(depth, kind="stable")
        limits = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2 if len(depth) else 1))
        for d in range(1, len(limits) - 1):
            e = by_depth[limits[d]:limits[d + 1]]
            if not len(e):
                continue
            w = alpha[frm[e]] + cost[e]
            heads = np.flatnonzero(np.r_[True, to[e][1:] != to[e][:-1]])
            top = np.maximum.reduceat(w, heads)
            spread = np.diff(np.r_[heads, len(e)])
            total = np.add.reduceat(np.exp(w - np.repeat(top, spread)), heads)
            alpha[to[e][heads]] = top + np.log(total)
            weight[e] = w - np.repeat(top + np.log(total), spread)
        heads = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        chance = np.exp(weight)
        share, width = chance.copy(), np.diff(np.r_[heads, len(to)])
        for k in range(1, width.max(initial=0)):  # every node sums its own edges from zero, so its chances are the same beside any other chunks
            at = heads[width > k] + k
            share[at] += share[at - 1]
        share = np.minimum(share, 1.0)
        share[np.r_[heads[1:] - 1, len(to) - 1]] = 1.0
        self.base = np.r_[self.base, first + self.nodes]
        self.length = np.r_[self.length, size]
        edge = np.zeros(n, np.int32)
        edge[to[heads]] = heads + len(self.cdf)
        self.first_edge = np.concatenate([self.first_edge, edge])
        self.cdf = np.concatenate([self.cdf, share])
        self.piece = np.concatenate([self.piece, piece.astype(np.int32)])
        self.back = np.concatenate([self.back, (frm + self.nodes).astype(np.int32)])
        self.nodes += n

    def sample(self, texts: list[str], seeds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Flat piece ids and how many each text has. Only the text and its seed decide a sample."""
        per_text = [CHUNK.findall(t) for t in texts]
        counts = np.array([len(c) for c in per_text], np.int64)
        chunks = [c for cs in per_text for c in cs]
        if not chunks:
            return np.zeros(0, np.int64), counts
        if len(self.at) > CHUNKS_KEPT:
            self._start()
        which = np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))
        if self.at.new:
            self._add(self.at.new)
            self.at.new = []
        place = np.arange(len(chunks)) - np.repeat(np.cumsum(counts) - counts, counts)
        seed = np.repeat(np.array(seeds, np.int64).astype(np.uint64), counts) + place.astype(np.uint64) * BASE
        node, stop = self.base[which] + self.length[which], self.base[which]
        open_, steps, n_pieces = np.arange(len(chunks)), [], np.zeros(len(chunks), np.int64)
        while len(open_):
            at = node[open_]
            u = _uniform(seed[open_] ^ ((at - stop[open_]).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
            e = self.first_edge[at]
            late = np.flatnonzero(self.cdf[e] <= u)
            while len(late):
                e[late] += 1
                late = late[self.cdf[e[late]] <= u[late]]
            steps.append((open_, self.piece[e], n_pieces[open_].copy()))
            n_pieces[open_] += 1
            node[open_] = self.back[e]
            open_ = open_[node[open_] != stop[open_]]
        ends = np.cumsum(n_pieces)
        out = np.empty(ends[-1], np.int64)
        for who, piece, step in steps:
            out[ends[who] - 1 - step] = piece
        per = np.add.reduceat(np.r_[n_pieces, 0], np.minimum(np.cumsum(counts) - counts, len(n_pieces))) * (counts > 0)
        return self._spell(out, per)

    def _spell(self, ids: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Write characters without a piece as bytes."""
        odd = np.flatnonzero(ids <= -2)
        if not len(odd):
            return ids, per
        spelled = [[self.byte[b] for b in chr(SPACE if -2 - c == NO_PIECE else -2 - c).encode("utf-8", "surrogatepass")] for c in ids[odd].tolist()]
        width = np.ones(len(ids), np.int64)
        width[odd] = [len(s) for s in spelled]
        starts = np.cumsum(width) - width
        out = np.repeat(ids, width)
        out[np.concatenate([np.arange(starts[i], starts[i] + len(s)) for i, s in zip(odd, spelled)])] = [b for s in spelled for b in s]
        text_of = np.repeat(np.arange(len(per)), per)
        return out, np.bincount(text_of, weights=width, minlength=len(per)).astype(np.int64)

    def decode(self, ids) -> str:
        return spelled(self.text, ids)


def spelled(text: list[bytes], ids) -> str:
    return b"".join(map(text.__getitem__, ids)).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def spellings(model: str) -> list[bytes]:
    """The bytes every id stands for; all that decoding needs."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return [bytes([int(n[3:5], 16)]) if sp.is_byte(i) else n.replace(chr(SPACE), " ").encode() for i, n in enumerate(names)]


@lru_cache(maxsize=2)
def sampler(model: str, sharpness: float) -> Sampler:
    return Sampler(model, sharpness)


def encode_column(text: str, seed: Column, model: str, sharpness: float) -> Column:
    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        s = sampler(model, sharpness)
        for texts, seeds in batches:
            ids, per, part, held, size = [], [], [], [], 0
            for t, k in zip(texts, seeds.to_pylist()):
                part.append(t.as_py() or "")
                held.append(k)
                size += len(part[-1])
                if size >= TEXT_PART:
                    a, b = s.sample(part, held)
                    ids.append(a.astype(np.int32))
                    per.append(b)
                    part, held, size = [], [], 0
            if part:
                a, b = s.sample(part, held)
                ids.append(a.astype(np.int32))
                per.append(b)
            counts = np.concatenate(per) if per else np.zeros(0, np.int64)
            offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))

    return encode(F.col(text), seed)


def decode_column(ids: str, model: str) -> Column:
    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        text = spellings(model)
        for batch in batches:
            flat, offsets = batch.values.to_numpy(), batch.offsets.to_pylist()
            yield pa.array([spelled(text, flat[a:b].tolist()) for a, b in zip(offsets, offsets[1:])], pa.string())

    return decode(F.col(ids))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ids: str = "ids", seed: int = 0, sharpness: float = 1.0, model: str | None = None) -> DataFrame:
    """``docs`` with a sampled segmentation: drawn from all segmentations in proportion to their probability.

    Forward sums over the lattice of pieces, then pieces drawn backwards from the end. The
    draws depend on ``seed``, the row's key, and the place in the text alone, so a retry or
    another partitioning gives the same ids, and another ``seed`` another sample. A null or
    empty text has no pieces; null keys share one seed. Rows that repeat get equal ids.
    """
    drawn = F.xxhash64(F.col(key).cast("string"), F.lit(seed))
    return docs.withColumn(ids, encode_column(text, drawn, model or piece_model(), sharpness))


def decode(rows: DataFrame, ids: str = "ids", text: str = "decoded", model: str | None = None) -> DataFrame:
    """``rows`` with the text of its ids, character by character what was encoded."""
    return rows.withColumn(text, decode_column(ids, model or piece_model()))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decode(encode(docs))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))
