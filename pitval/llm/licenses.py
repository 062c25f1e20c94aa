"""License scan: ordered signature rules behind a keyword filter, overlaps settled by priority and containment."""
from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import free, table
from .license_rules import RULES, TIERS

#: Lower case for A-Z, a blank for every other ASCII character that is neither a letter nor a digit; bytes from 0x80 on stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Rule:
    number: int
    tier: str
    label: str
    pattern: re.Pattern[bytes]
    words: frozenset[bytes]  # each must stand in the text


def needed_words(pattern: str) -> frozenset[bytes]:
    """The plain words outside every group of a pattern: no text without them all can match."""
    def gap(m: re.Match[str]) -> str:
        ways = m[1].split("|")
        return " " * all(w.startswith(" ") for w in ways) + "#" + " " * all(w.endswith(" ") for w in ways)

    plain = pattern
    while "(" in plain:
        plain = re.sub(r"\((?:\?:)?([^()]*)\)(?:\?|\{\d+,\d+\})?", gap, plain)
    return frozenset(w.encode() for w in plain.replace(" ?", "#").split(" ") if re.fullmatch("[a-z0-9]+", w))


def compile_rules(rules=RULES) -> dict[bytes, list[Rule]]:
    """Rules under the longest of their needed words."""
    out = defaultdict(list)
    for i, (tier, label, pattern) in enumerate(rules):
        words = needed_words(pattern)
        if not words:
            raise ValueError(f"rule {label!r} has no word to look for: {pattern}")
        compiled = re.compile(rb"(?<= )(?:" + pattern.encode() + rb")(?= )")
        out[max(words, key=lambda w: (len(w), w))].append(Rule(i, tier, label, compiled, words))
    return dict(out)


BY_WORD = compile_rules()
KEYWORDS = frozenset(w for rules in BY_WORD.values() for r in rules for w in r.words)


def text_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def detections(words: list[bytes], rules: dict[bytes, list[Rule]] = BY_WORD, keywords: frozenset[bytes] = KEYWORDS) -> list[tuple[int, int, Rule]]:
    """``(first word, last word, rule)`` of every match. Only rules all of whose words stand in the text are tried."""
    present = keywords.intersection(words)
    open_rules = [r for w in present for r in rules.get(w, ()) if r.words <= present]
    if not open_rules:
        return []
    line, out = b" " + b" ".join(words) + b" ", []
    for rule in sorted(open_rules, key=lambda r: r.number):
        at, seen = 0, 0
        for m in rule.pattern.finditer(line):
            seen += line.count(b" ", at, m.start())
            at = m.start()
            out.append((seen - 1, seen - 1 + line.count(b" ", m.start(), m.end()), rule))
    return out


def settle(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections that no stronger one contains, in text order.

    Stronger is a higher priority, then a longer match, then the earlier rule. The stronger
    ones are taken first; those that stay are held as a staircase of starts and ends that
    both grow, so one search tells whether any of them contains the next.
    """
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for first, last, rule in sorted(found, key=lambda d: (-TIERS[d[2].tier][0], d[0] - d[1], d[2].number, d[0])):
        i = bisect_right(starts, first)
        if i and ends[i - 1] >= last:
            continue
        kept.append((first, last, rule))
        j = i
        while j < len(starts) and ends[j] <= last:  # steps inside the new one
            j += 1
        lo = i - 1 if i and starts[i - 1] == first else i
        starts[lo:j], ends[lo:j] = [first], [last]
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].number))


def scan_text(text: bytes | None) -> dict:
    words = text_words(text)
    found = detections(words)
    kept = settle(found)
    base = [d for d in found if d[2].tier == "base"]
    strength: dict[str, float] = {}
    for _, _, r in [*kept, *base]:
        strength[r.label] = max(strength.get(r.label, 0.0), TIERS[r.tier][1])
    doubt = 1.0
    for label in sorted(strength):
        doubt *= 1.0 - strength[label]
    return {"n_words": len(words), "n_base": len(base), "first_word": min((d[0] for d in base), default=None),
            "last_word": max((d[0] for d in base), default=None), "base_labels": sorted({d[2].label for d in base}),
            "labels": sorted(strength), "score": 1.0 - doubt,
            "found": [{"label": r.label, "tier": r.tier, "rule": r.number, "first": a, "last": b} for a, b, r in kept]}


SPANS = pa.list_(pa.struct([("label", pa.string()), ("tier", pa.string()), ("rule", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))
ARROW = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                   ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()), ("found", SPANS)])
KIND = ("struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:array<string>,labels:array<string>,score:double,"
        "found:array<struct<label:string,tier:string,rule:int,first:long,last:long>>>")


def scan_column(text: str) -> Column:
    @F.arrow_udf(KIND)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([scan_text(x.as_py()) for x in batch], ARROW)

    return scanned(F.col(text).cast("binary"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``licenses``: the labels of a whole text, the spans (in words) that tell them, a score.

    Words are runs of letters, digits and characters beyond ASCII; A-Z count as a-z. A rule is
    tried only if all its plain words stand in the text. A detection inside a stronger one is
    dropped; labels of base phrases stay whatever contains them. The score is 1 less the
    product of the doubts that the strongest detection of each label leaves, 0 without any.

    Every text is judged on its own, so nothing is shuffled. A null or empty text has no words,
    empty lists and score 0. Repeated rows get the same verdict; an empty table gives an empty
    result. Should ``docs`` have a column ``licenses``, the new one is ``_licenses``.
    """
    return docs.withColumn(free(docs, "licenses"), scan_column(text))


def op13(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licenses.*")
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return out.withColumns(joined).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
