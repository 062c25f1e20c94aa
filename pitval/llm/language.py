"""Language identification by cross-parsing against suffix automata."""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fold, table

ROWS_PER_LANGUAGE = 400
CHARS_PER_LANGUAGE = 40_000
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
CACHED_WORDS = 300_000


class SuffixAutomaton:
    """All substrings of one text as paths from state 0."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur

    def phrases(self, text: str) -> int:
        """Phrases of the cross-parse: each is the longest match from where the last one ended; an unseen letter is one."""
        count, state, nexts, root = 0, 0, self.next, self.next[0]
        for c in text:
            to = nexts[state].get(c)
            if to is None:
                if state:
                    count += 1
                    to = root.get(c)
                if to is None:
                    count, to = count + 1, 0
            state = to
        return count + (state != 0)


class Parser:
    """Phrase counts of whole texts in every language; the counts of a word are kept, as words repeat."""

    def __init__(self, vocabulary: tuple[tuple[str, tuple[str, ...]], ...]):
        self.languages = [lang for lang, _ in vocabulary]
        self.automata = [SuffixAutomaton(f" {' '.join(words)} ") for _, words in vocabulary]
        self._start()

    def _start(self):
        self.rows: dict[str, int] = {}
        self.counts = np.zeros((CACHED_WORDS, len(self.automata)), np.int32)

    def _add(self, word: str) -> int:
        row = self.rows[word] = len(self.rows)
        spaced = f" {word} "
        self.counts[row] = [a.phrases(spaced) for a in self.automata]
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        words = LETTERS.findall((text or "").lower())
        if not words or not self.languages:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.automata), np.int64)
        for lo in range(0, len(words), CACHED_WORDS // 4):
            some = words[lo:lo + CACHED_WORDS // 4]
            if len(self.rows) + len(some) > CACHED_WORDS:
                self._start()
            rows, add = self.rows, self._add
            at = [rows[w] if w in rows else add(w) for w in some]
            total += self.counts[at].sum(axis=0, dtype=np.int64)
        best = int(total.argmin())
        if len(total) == 1:
            return self.languages[0], 1.0
        return self.languages[best], float(1 - total[best] / np.partition(total, 1)[1])


@lru_cache(maxsize=2)
def parser(vocabulary) -> Parser:
    return Parser(vocabulary)


def language_column(text: str, vocabulary) -> Column:
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = parser(vocabulary)
        for batch in batches:
            found = [p.predict(x.as_py()) for x in batch]
            yield pa.StructArray.from_arrays([pa.array([f[k] for f in found], t.type) for k, t in enumerate(kind)], fields=list(kind))

    return language(F.col(text))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          rows: int = ROWS_PER_LANGUAGE, chars: int = CHARS_PER_LANGUAGE):
    """``((lang, words), ...)``: the words whose text each language's automaton holds.

    Learned from at most ``rows`` documents per language outside the held-out third,
    chosen by key hash. Words are taken by how many of these documents have them, up to
    ``chars`` characters; a word that is more frequent in another language is left to
    that one, so passages in a foreign language do little harm. Only these bounded
    word lists reach the driver.
    """
    known = docs.where((fold(key) != 1) & F.col(lang).isNotNull() & F.col(key).isNotNull())
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("key").cast("string")), "key")
    chosen = (known.select(F.col(key).alias("key"), F.col(lang).alias("lang")).withColumn("k", F.row_number().over(by_hash))
              .where(F.col("k") <= rows).select("key").distinct())
    texts = known.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    words = texts.select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word"))
    seen = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    best = seen.withColumn("top", F.max("n").over(Window.partitionBy("word"))).where("n = top")
    ranked = best.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= chars // 2)
    upto = Window.partitionBy("lang").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    kept = ranked.withColumn("upto", F.sum(F.length("word") + 1).over(upto)).where(F.col("upto") <= chars)
    out: dict[str, list[str]] = {}
    for r in kept.orderBy("lang", "k").collect():
        out.setdefault(r["lang"], []).append(r["word"])
    return tuple((k, tuple(v)) for k, v in sorted(out.items()))


def op3(spark, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter are ``und`` with score 0. Ties go to the first language by name."""
    docs = table(spark, sf_dir, "documents")
    vocabulary = learn(docs)
    out = docs.select("doc_id", (fold() == 1).alias("held_out"), language_column("text", vocabulary).alias("found"))
    return out.select("doc_id", "held_out", "found.lang_pred", "found.score")
