"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text."""
from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import first_rows, fold, keep, table

SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
STEM = range(4, 9)

# Letters that look like a Latin letter, and digits or signs written for one.
LOOKALIKE = dict(zip("авеѕіјкмнорстухԁɡһӏաօοαεικνρτυχβηυ", "abesijkmhopctyxdghlwooaeikvptuxbhu"))
SUBSTITUTE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i"}
SAME = {"l": "i"}  # l, I and 1 cannot be told apart in many fonts


class Folding(dict):
    """``str.translate`` table, filled as characters are met: one folded letter for a letter or its disguise, a space for the rest.

    Case, width and style variants go by Unicode compatibility; accents stay, since they
    tell words apart. Invisible characters and loose marks vanish, so they cannot split a word.
    """

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if unicodedata.category(c) in ("Mn", "Cf"):
            out = ""
        else:
            base = unicodedata.normalize("NFKC", c.lower())[:1]
            base = SUBSTITUTE.get(base, LOOKALIKE.get(base, base))
            out = SAME.get(base, base) if base.isalpha() else " "
        self[code] = out
        return out


FOLDING = Folding()


def folded(text: str | None) -> str:
    """Folded words, each with one space before and after."""
    text = text or ""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return f" {' '.join(text.translate(FOLDING).split())} "


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights. `` stem`` matches where a word begins with it, `` word `` a whole word; phrases may hold several words.

    A match inside an occurrence of an exception phrase does not count. ``calibration``
    holds the factors of ``evidence`` and a constant.
    """
    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    calibration: tuple[float, ...] = (3.0, 1.0, -0.5, -4.0)
    _automaton: list = field(default_factory=list, compare=False, repr=False)

    def automaton(self):
        if not self._automaton:
            a = ahocorasick.Automaton()
            for phrase in self.exceptions:
                a.add_word(phrase, (len(phrase), None))
            for entry in self.weights:
                a.add_word(entry, (len(entry), entry))
            a.make_automaton()
            self._automaton.append(a)
        return self._automaton[0]

    def __getstate__(self):
        return {**self.__dict__, "_automaton": []}

    def matches(self, text: str) -> list[tuple[int, str]]:
        """Start of word and entry; of several entries at one word the heaviest counts."""
        if not self.weights:
            return []
        best: dict[int, str] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, entry) in self.automaton().iter(text):
            begin = end - size + 1
            if entry is None:
                excused.append((begin, end))
            elif begin not in best or self.weights[entry] > self.weights[best[begin]]:
                best[begin] = entry
        if not excused:
            return list(best.items())
        excused.sort()
        out, k = [], 0
        reach = -1
        for begin, entry in sorted(best.items()):
            while k < len(excused) and excused[k][0] <= begin:
                reach, k = max(reach, excused[k][1]), k + 1
            if reach <= begin:
                out.append((begin, entry))
        return out

    def evidence(self, text: str | None) -> tuple[float, float, float, float]:
        """Summed weight, the same per hundred words, and the number of words, each on a log scale; a constant."""
        text = folded(text)
        total, n = sum(self.weights[e] for _, e in self.matches(text)), max(text.count(" ") - 1, 0)
        return math.log1p(total), math.log1p(100 * total / (n + 20)), math.log1p(n), 1.0

    def score(self, text: str | None) -> float:
        """Probability of the label; a text without a match scores 0."""
        x = self.evidence(text)
        if not x[0]:
            return 0.0
        z = sum(a * b for a, b in zip(self.calibration, x))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def score_column(text: str, lexicon: Lexicon) -> Column:
    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([lexicon.score(x.as_py()) for x in batch], pa.float64())

    return toxicity(F.col(text))


def stems(text: str) -> set[str]:
    """Whole words and word beginnings of a text, as lexicon entries."""
    out = set()
    for word in set(folded(text).split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in STEM if n < len(word))
    return out


def _tally(rows: DataFrame, text: str, label: str, features) -> DataFrame:
    """Documents per feature, in labelled and clean ones; each task adds up its own before anything is shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = (Counter(), Counter())
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tallies[y].update(features(x or ""))
        keys = list(tallies[0].keys() | tallies[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([t[k] for k in keys], pa.int64()) for t in tallies]],
                                         names=["entry", "clean", "toxic"])

    parts = rows.select(text, F.col(label).cast("int").alias("y")).mapInArrow(count, "entry string, clean long, toxic long")
    return parts.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _places(rows: DataFrame, entries: Lexicon) -> dict[str, int]:
    """How many different pairs of neighbouring words each entry has, over the given rows."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = set()
            for x in b.column(0).to_pylist():
                words = folded(x).split()
                for before, word, after in zip(["", *words], words, [*words[1:], ""]):
                    for e in (f" {word} ", *(f" {word[:n]}" for n in STEM if n < len(word))):
                        if e in entries.weights:
                            seen.add((e, f"{before} {after}"))
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.string())], names=["entry", "beside"])

    if not entries.weights:
        return {}
    pairs = rows.select("text").mapInArrow(look, "entry string, beside string").distinct()
    return {r["entry"]: r["n"] for r in pairs.groupBy("entry").agg(F.count("*").alias("n")).collect()}


def _calibrate(rows: DataFrame, lexicon: Lexicon, ridge: float = 0.1, steps: int = 30) -> tuple[float, ...]:
    """Logistic fit of the labels to the evidence, over the rows with a match; only four numbers a row reach the driver."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [(*lexicon.evidence(t), float(y)) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            x = [r for r in x if r[0]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in x], pa.float64()) for k in range(5)], names=list("abcdy"))

    found = np.array([tuple(r) for r in rows.select("text", "y").mapInArrow(look, "a double, b double, c double, d double, y double").collect()])
    if not len(found):
        return lexicon.calibration
    x, y, w = found[:, :4], found[:, 4], np.zeros(4)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(4), x.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = SAMPLE_ROWS,
          min_docs: int = 5, min_weight: float = 1.5, evidence: float = 28.0,
          exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Fit a lexicon on at most ``bound`` rows of each label, outside the held-out third.

    An entry's weight is its log odds of being in a labelled document. Entries need
    ``min_weight``, a likelihood ratio of ``evidence``, and different neighbouring words
    in ``min_docs`` places, a number that does not grow with the rows: a slur of a small
    language or topic counts however many other toxic rows there are. Equal texts of a
    label count once, so that a group of copies does not make its common words toxic. Of entries that begin with
    one another the one with the largest likelihood ratio stays. Words and word pairs in
    which an entry occurs mostly in clean documents become exception phrases, beside
    those given. No number of entries is set: they come from the bounded rows alone, each
    from texts enough for its ratio. At last the score is calibrated on the same rows. No rows of either label: an empty lexicon, which scores everything 0.
    """
    rows = labels.where(fold(key) != 1).select(F.col(key).alias("key"), F.col(label).alias("y")).where("y in (0, 1) and key is not null").distinct()
    ids = first_rows(rows.where("y = 1"), "key", bound).unionByName(first_rows(rows.where("y = 0"), "key", bound))
    sample = keep(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(ids), "key").select("text", "y").distinct())
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Lexicon({}, tuple(f" {' '.join(folded(e).split())} " for e in exceptions))
    weight = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    share = (F.col("toxic") + F.col("clean")) / (n[0] + n[1])
    ratio = 2 * (F.col("toxic") * F.log(F.col("toxic") / n[1] / share) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / n[0] / share)).otherwise(0.0))
    found = (_tally(sample, "text", "y", stems).where(F.col("toxic") >= min_docs).withColumns({"w": weight, "g": ratio})
             .where((F.col("w") >= min_weight) & (F.col("g") >= evidence)).collect())
    places = _places(sample.where("y = 1"), Lexicon({r["entry"]: r["w"] for r in found}))
    found = [r for r in found if places.get(r["entry"], 0) >= min_docs]
    weights: dict[str, float] = {}
    begun: set[str] = set()
    for r in sorted(found, key=lambda r: (-round(r["g"], 6), -len(r["entry"]), r["entry"])):  # of stems of one another only the most telling
        e = r["entry"]
        heads = [e[:n] for n in range(1, len(e) + 1)]
        if e not in begun and not any(h in weights for h in heads):
            weights[e] = r["w"]
            begun.update(heads)
    top = sorted(weights.items(), key=lambda e: (-e[1], e[0]))
    plain = Lexicon(dict(top))

    def contexts(x: str) -> set[str]:
        x, out = folded(x), set()
        for begin, _ in plain.matches(x):
            end = x.index(" ", begin + 1)
            out.add(x[begin:end + 1])
            out.add(x[x.rfind(" ", 0, max(begin, 1)):end + 1] if begin else x[:end + 1])
            out.add(x[begin:x.find(" ", end + 1) + 1] if x.find(" ", end + 1) > 0 else x[begin:end + 1])
        return out

    benign = (_tally(sample, "text", "y", contexts).where(F.col("clean") >= min_docs).withColumn("w", weight).where(F.col("w") < 0)
              .orderBy(F.desc("clean"), "entry").collect())
    excused = [*(f" {' '.join(folded(e).split())} " for e in exceptions), *(r["entry"] for r in benign)]
    lexicon = Lexicon(dict(top), tuple(dict.fromkeys(excused)))
    return replace(lexicon, calibration=_calibrate(sample, lexicon))


def op1(spark, sf_dir: str) -> DataFrame:
    """Nulls and empty texts score 0; repeated rows score alike; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", (fold() == 1).alias("held_out"), score_column("text", lexicon).alias("score")) \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
