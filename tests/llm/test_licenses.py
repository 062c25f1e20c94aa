"""License rules, overlaps and the base counts against plain versions."""
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pitval.llm import licenses
from pitval.llm.license_rules import RULES, TIERS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def plain_base(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i:i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), sorted({x for _, x in places})


def test_there_are_hundreds_of_rules():
    assert len(RULES) >= 250 and len(set(RULES)) == len(RULES) and {r[0] for r in RULES} == set(TIERS)


@pytest.mark.parametrize("rule", [r for rules in licenses.BY_WORD.values() for r in rules], ids=lambda r: f"{r.number}-{r.label}")
def test_every_match_holds_the_words_that_open_its_rule(rule):
    pattern = RULES[rule.number][2]

    @settings(max_examples=15, deadline=None, database=None)
    @given(st.from_regex(re.compile(pattern.replace(r"\S", "[a-z0-9]"), re.ASCII), fullmatch=True))
    def check(text):
        words = licenses.text_words(text.encode())
        assert b" ".join(words).decode() == text and rule.words <= set(words)
        assert any(r is rule and (a, b) == (2, len(words) + 1) for a, b, r in licenses.detections([b"qq", b"ww", *words, b"zz"]))

    check()


def test_overlaps_against_all_pairs():
    rules = [r for rules in licenses.BY_WORD.values() for r in rules]
    rng = np.random.default_rng(7)
    for _ in range(200):
        found = [(a := int(rng.integers(0, 30)), a + int(rng.integers(0, 8)), rules[rng.integers(len(rules))]) for _ in range(rng.integers(0, 25))]

        def rank(d):
            return TIERS[d[2].tier][0], d[1] - d[0], -d[2].number, -d[0]

        want = []
        for d in sorted(found, key=rank, reverse=True):
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in want):
                want.append(d)
        assert sorted(map(str, want)) == sorted(map(str, licenses.settle(found)))


@pytest.mark.parametrize("text,labels", [
    ("Licensed under the Apache License, Version 2.0.", ["apache-2"]),
    ("Released under the MIT License.", ["mit"]),
    ("SPDX-License-Identifier: GPL-3.0-or-later", ["gpl-3"]),
    ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1", ["lgpl-2.1"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3"]),
    ("GNU Affero General Public License v3", ["agpl-3"]),
    ("Licensed under CC BY-NC-SA 4.0.", ["cc-by-nc", "cc-by-nc-sa"]),  # the base phrase stands inside and stays
    ("BSD 3-Clause License", ["bsd-3-clause"]),
    ("She had a license to drive under the bridge; the mit of a committee, apache dancers.", []),
    ("", []), (None, []), ("permission", []),
])
def test_labels(text, labels):
    got = licenses.scan_text(text.encode() if text is not None else None)
    assert got["labels"] == labels and (got["score"] > 0) == bool(labels) and 0 <= got["score"] <= 1


PARTS = ["under the mit license", "Apache License, Version 2", "CC-BY-NC", "cc by nc cc by nc", "under the", "mit", "é license", "\x00", "漢", "x" * 20, "gpl v3", "\n", "İ"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12), st.sampled_from([" ", "  ", "-", "\t", ""]))
def test_base_counts(parts, sep):
    text = sep.join(parts)
    got = licenses.scan_text(text.encode())
    assert tuple(got[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == plain_base(text)
    assert set(got["base_labels"]) <= set(got["labels"])


def test_query_on_messy_and_empty_tables(spark, tmp_path, messy, nothing):
    more = messy.unionByName(spark.createDataFrame([(20, "Under the MIT license. " * 5000 + "CC BY-NC", "en", 1)], "doc_id long, text string, lang string, n_chars long"), allowMissingColumns=True)
    more.write.parquet(f"{tmp_path}/documents.parquet")
    rows = licenses.op13(spark, str(tmp_path)).collect()
    texts = {r["doc_id"]: r["text"] for r in more.collect()}
    assert len(rows) == more.count()
    for r in rows:
        n, base, first, last, labels = plain_base(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, base, first, last, ",".join(labels))
    assert licenses.scan(nothing).collect() == []
    clash = licenses.scan(messy.withColumnRenamed("verdict", "licenses"))
    assert "_licenses" in clash.columns and clash.count() == messy.count()
