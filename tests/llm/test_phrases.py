"""Phrase collocations against plain counting."""
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from pitval.llm import phrases


def plain(rows, least, width=5, percent=100):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, width + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i:i + k])] += 1
    often = {x: n for x, n in counts.items() if n >= least}
    covered = set()
    for (lang, g), f in often.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                if 100 * f >= percent * counts[lang, g[i:i + k]]:
                    covered.add((lang, g[i:i + k]))
    out = set()
    for (lang, g), a in often.items():
        if len(g) > 1 and (lang, g) not in covered:
            n = totals[lang]
            score, k = min((1000 * a * n // (counts[lang, g[:k]] * counts[lang, g[k:]]), k) for k in range(1, len(g)))
            out.add((lang, " ".join(g), a, counts[lang, g[:k]], counts[lang, g[k:]], n, score))
    return out


WORDS = ["of", "the", "New", "york", "a", "a-b", "a\x01", "\x00", "a\x00b", "é", "漢", "x" * 50]


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(n):
        words = rng.choice(WORDS, rng.integers(0, 40), p=[.2, .2, .12, .12, .1, .05, .05, .03, .03, .04, .03, .03])
        texts.append("".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ! "], p=[.7, .05, .05, .05, .05, .05, .05]) for w in words))
    langs = rng.choice(["en", "de", None, "und", "x\x00y", "x", "x\x01"], n).tolist()
    return list(zip(texts, langs))


@pytest.mark.parametrize("least,percent,parts", [(5, 100, 7), (3, 60, 2), (2, 100, 1)])
def test_against_plain_counting(spark, monkeypatch, least, percent, parts):
    monkeypatch.setattr(phrases, "CHUNK", 700)
    rows = corpus(least, 120)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = [tuple(r) for r in phrases.collocations(df, least=least, cover_percent=percent).select("lang", "phrase", "a", "l", "r", "n", "score").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == plain(rows, least, percent=percent)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"ab", b"b", b"a\x01"]), max_size=3), st.integers(1, 3)), min_size=1, max_size=30), st.integers(1, 5))
def test_runs_of_a_sorted_stretch(rows, least):
    keyed = sorted((b"\0".join([b"g", *w]), n) for w, n in rows)
    keys, counts = phrases.prefix_runs(pa.array([k for k, _ in keyed], pa.binary()), np.array([n for _, n in keyed], np.int64), 3, least)
    want = Counter()
    for k, n in keyed:
        steps = k.split(b"\0")
        for i in range(len(steps)):
            want[b"\0".join(steps[:i + 1])] += n
    got = Counter()
    for k, n in zip(keys, counts):
        got[k] += n
    first, last = keyed[0][0].split(b"\0"), keyed[-1][0].split(b"\0")
    ends = {b"\0".join(x[:i + 1]) for x in (first, last) for i in range(len(x))}
    assert all(got[k] == n for k, n in got.items() if want[k] == n) and all(want[k] == got[k] for k in got)
    assert {k for k, n in want.items() if n >= least or k in ends or k == b"g"} == set(got)


def test_counts_beyond_64_bits(spark):
    """The products of a score need more than 64 bits long before its quotient does."""
    row = spark.range(1).selectExpr("cast(4000000000000 as bigint) a", "cast(9000000000000 as bigint) n", "cast(5000000000001 as bigint) l", "cast(6000000000007 as bigint) r")
    big = "decimal(38,0)"
    got = row.selectExpr(f"cast(cast(1000 as {big}) * a * n as {big}) div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as {big}) s").first()["s"]
    assert got == 1000 * 4000000000000 * 9000000000000 // (5000000000001 * 6000000000007)


def test_messy_and_empty_tables(spark, messy, nothing):
    got = {tuple(r) for r in phrases.collocations(messy, least=2).select("lang", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == plain([(r["text"], r["lang"]) for r in messy.collect()], 2)
    assert phrases.collocations(nothing).collect() == []
