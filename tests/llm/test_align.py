"""Tokenizer alignment against plain versions."""
import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pitval.llm import align
from pitval.llm.packing import tokenizer_folder

from .conftest import TEXTS

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"


def plain(texts):
    """Rows as the query's contract says them, by comparing all tokens of a text with each other."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    folder = tokenizer_folder()
    a_model = Tokenizer.from_file(f"{folder}/{LEFT}")
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{RIGHT}")
    spell = {c: bytes([b]) for c, b in align.byte_alphabet().items()}
    assert decoders.ByteLevel().decode(["Ġé"]) == b"".join(spell[c] for c in "Ġé").decode(errors="replace")
    docs = []
    for text in texts:
        a, b, whole = [], [], b""
        if text:
            whole = b" " + text.encode()
            a = [(i, b"".join(spell[c] for c in a_model.id_to_token(i))) for i in a_model.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode())
                 for i in b_model.encode(text) for p in [b_model.id_to_piece(i)]]
            if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                a, b = [], []
        spans = []
        for tokens in (a, b):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups = [";".join([])]
        groups = ["|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in spans) for lo, hi in zip([0, *ends], ends)]
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    counts = Counter(x for d in docs for x in d[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(a, b, g, len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), sha) for a, b, g, x, sha in docs]


def test_chunks_give_the_ids_of_the_whole_text():
    rng = np.random.default_rng(5)
    two = align.Aligner(tokenizer_folder(), LEFT, RIGHT)
    parts = [" ", "  ", "\n", "\t ", " \n", "\r\n", "\xa0", "\u3000", "\x1c", "\x85", "a", "don't", "they'll", "über", "漢字", "😀", "12", "!?", "<|endoftext|>", "word", "\u200b", "x" * 80]
    texts = ["".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(3000)]
    for _ in range(2):  # the second time from the kept chunks
        ids, edges = two.tokens(texts)
        for k, t in enumerate(texts):
            a, b = (ids[i][edges[i][k]:edges[i][k + 1]].tolist() for i in range(2))
            want_a, want_b = two.left.encode([" " + t])[0], two.right.encode([t])[0]
            whole = b" " + t.encode()
            if all(b"".join(v.entries[i] for i in x) == whole for v, x in ((two.left, want_a), (two.right, want_b))):
                assert (a, b) == (want_a, want_b)
            else:
                assert a == b == []


MORE = ["<|endoftext|> plain </s> text", "a", " ", "  two  blanks\tand\n\nlines ", "▁ low line", "naïve café — “quotes” 😀🎉", "<0x41> A <unk>", "x" * 300,
        "the cat the cat the cat", "\x00\x01 control", "end of line\r\n"]


@pytest.mark.parametrize("block_links", [align.BLOCK_LINKS, 50])
def test_against_all_pairs_of_tokens(spark, monkeypatch, block_links):
    monkeypatch.setattr(align, "BLOCK_LINKS", block_links)
    texts = [t for t in TEXTS.values() if not t or len(t) < 1000] + MORE + MORE[:3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in align.align(df).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30), st.integers(1, 9))
def test_pieces_of_any_size_give_the_same_overlaps(a, b, piece):
    b = [*b, sum(a) - sum(b)] if sum(a) > sum(b) else b
    a = [*a, sum(b) - sum(a)] if sum(b) > sum(a) else a
    ea, eb = np.cumsum(a), np.cumsum(b)
    to_b, to_a, shared_a, shared_b = align.overlaps(ea, eb, piece)
    want = {(i, j) for i in range(len(a)) for j in range(len(b)) if ea[i] - a[i] < eb[j] and eb[j] - b[j] < ea[i]}
    got = [(i, int(j)) for i, j in enumerate(to_b)] + [(int(i), j) for j, i in enumerate(to_a) if not shared_b[j]]
    assert len(got) == len(want) and set(got) == want
    assert shared_a.tolist() == [x in set(eb.tolist()) for x in ea.tolist()] and shared_b.tolist() == [x in set(ea.tolist()) for x in eb.tolist()]


def test_messy_and_empty_tables(spark, messy, nothing):
    rows = align.align(messy).collect()
    assert len(rows) == messy.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert by[5] == [(0, 0, 0, 0, 0, 0, "")] == by[4] and len(by[2]) == 2 and by[2][0] == by[2][1] == by[1][0] == by[None][0]
    assert by[8][0][0] > 30_000
    assert align.align(nothing).collect() == []


def test_groups_cover_every_byte(spark):
    df = spark.createDataFrame(list(enumerate([*MORE, None])), "doc_id long, text string")
    rows = align.group_rows(df).orderBy("doc_id", "group").collect()
    sums = {r["doc_id"]: r for r in align.align(df).collect()}
    two = align.aligner(tokenizer_folder(), LEFT, RIGHT)
    for k, text in enumerate(MORE):
        mine = [r for r in rows if r["doc_id"] == k]
        assert len(mine) == sums[k]["n_groups"]
        if mine:
            whole = b" " + text.encode()
            assert [r["start"] for r in mine] == [0, *[r["end"] for r in mine[:-1]]] and mine[-1]["end"] == len(whole)
            for r in mine:
                assert b"".join(two.left.entries[i] for i in r["a_ids"]) == whole[r["start"]:r["end"]] == b"".join(two.right.entries[i] for i in r["b_ids"])
            spelled = ";".join(",".join(map(str, r["a_ids"])) + "|" + ",".join(map(str, r["b_ids"])) for r in mine)
            assert hashlib.sha256(spelled.encode()).hexdigest() == sums[k]["groups_sha256"]
