"""Messy and empty input for every operator and every pipeline stage."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pitval.llm import chat, html, language, lines, neighbours, packing, pieces, quality, simhash, toxicity

from .conftest import TEXTS

OPERATORS = {
    "quality": lambda d, x: quality.judge(d, quality.trusted_rows(x)),
    "toxicity": lambda d, x: d.withColumn("s", toxicity.score_column("text", toxicity.learn(d, x, min_docs=1))),
    "language": lambda d, x: d.withColumn("s", language.language_column("text", language.learn(d))),
    "pieces": lambda d, x: pieces.decode(pieces.encode(d)),
    "lines": lambda d, x: lines.dedupe_lines(d),
    "simhash": lambda d, x: simhash.near_duplicates(d),
    "packing": lambda d, x: packing.pack(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_messy_rows_come_through(messy, labels, name):
    out = OPERATORS[name](messy, labels).collect()
    assert len(out) >= messy.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_gives_empty_result(nothing, labels, name):
    assert OPERATORS[name](nothing, labels.limit(0)).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_messy_and_empty_input(spark, tmp_path, messy, nothing, labels, name, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, messy, str(tmp_path))
    if name != "best_fit_packing":
        assert out.columns == messy.columns and out.dtypes == messy.dtypes
    assert out.collect()
    assert stage(spark, nothing, str(tmp_path)).collect() == []


def test_lines_of_messy_rows(messy):
    out = {(r["doc_id"], r["_removed"] is None): r for r in lines.dedupe_lines(messy).collect()}
    got = {k: r["text"] for (k, _), r in out.items()}
    assert got[1] == TEXTS[1] and got[2] == "" and got[None] == TEXTS[1]
    assert got[3] == "short\nshort\nAnother line with quite some more words in it."
    assert got[4] == "" and got[5] is None and got[6] == TEXTS[6] and got[8] == TEXTS[8]


def test_near_duplicates_of_messy_rows(messy):
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(messy).collect()), key=str)
    assert dict(got) == {1: 1, 2: 1, None: 1, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8}
    assert len(got) == messy.count()


def test_conversations(spark):
    kind = "conv_id long, turn long, role string, text string, window int"
    rows = [(1, 0, "system", "be kind", 0), (1, 1, "user", None, 0), (1, 2, "assistant", "", 0), (1, 2, "assistant", "", 0),
            (None, None, None, "x </s> \\ [ROLE] <<SYS>>", 0), (2, 0, "assistant", "word " * 5000, 0), (2, 10**9, "tool[/ROLE]", "z", 0)]
    df = spark.createDataFrame(rows, kind)
    out = {}
    for r in chat.windows(df, budget=64).orderBy("conv_id", "block", "window").collect():
        out.setdefault(r["conv_id"], []).extend(chat.read_turns(r["formatted"])[r["n_repeated"]:])
    assert out[1] == [("system", "be kind"), ("user", ""), ("assistant", ""), ("assistant", "")]
    assert out[None] == [("", "x </s> \\ [ROLE] <<SYS>>")]
    assert out[2] == [("assistant", "word " * 5000), ("tool[/ROLE]", "z")]
    assert chat.windows(df.limit(0)).collect() == [] and chat.digests(chat.windows(df.limit(0))).collect() == []


def test_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p"), (4, "no tags &amp; text"), (5, "<div>" * 5000 + "deep")], "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in html.extract_text(pages.withColumn("text", F.lit("clash"))).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "no tags & text", 5: "deep"}
    assert html.extract_text(pages.limit(0)).collect() == []


def test_vectors(spark):
    rows = [(0, [1.0, 0.0], "a"), (100, [1.0, 0.0], "b"), (100, [1.0, 0.0], "b"), (5, [0.0, 2.0], "c"), (200, None, "d"), (300, [0.0, 0.0], "e"),
            (400, [1.0, None], "f"), (500, [float("nan"), 1.0], "g"), (600, [float("inf"), 1.0], "h"), (700, [1.0], "i"), (None, [1.0, 1.0], "j"), (800, [], "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part string")
    got = [tuple(r) for r in neighbours.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100, 0.0), (0, 2, 5, 5 ** 0.5), (100, 1, 0, 0.0), (100, 2, 5, 5 ** 0.5)]
    assert neighbours.search(df.limit(0), F.lit(True)).collect() == []


@pytest.mark.parametrize("blank", [" ", "\n", "\t \u3000"])
def test_two_million_blanks_are_packed(spark, blank):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    text = "a" + (blank * 2_000_000)[:2_000_000] + "b"
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    rows = sorted(packing.pack(df).where("doc_id = 1").collect(), key=lambda r: r["piece"])
    ids = np.array([*Tokenizer.from_file(packing.tokenizer_folder() + "/byte_bpe_50k.json").encode(text, add_special_tokens=False).ids, packing.END], "<u4")
    assert sum(r["length"] for r in rows) == len(ids)
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(ids[r["start"]:r["start"] + r["length"]]) for r in rows]


def test_trusted_counts_do_not_hang_on_the_size_of_a_side(spark, messy, labels):
    """One plan for all sizes: no broadcast of the keys, however few they are."""
    plan = quality.ratios(messy, quality.trusted_rows(labels))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_unlike_texts_that_share_a_key_lose_nothing_of_each_other(spark):
    words = [" ".join(f"{c}{i}word" for i in range(12)) for c in "abcdefg"]
    a, b, c, d, e, f, g = words
    rows = [(1, f"{a}\n{b}"), (2, f"{c}\n{a}"), (2, f"{d}\n{e}"), (2, f"{d}\n{e}"), (3, f"{f}\n{e}\n{g}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["doc_id"], r["text"]) for r in lines.dedupe_lines(docs).collect())
    assert out == sorted([(1, f"{a}\n{b}"), (2, c), (2, f"{d}\n{e}"), (2, f"{d}\n{e}"), (3, f"{f}\n{g}")])
    rows = [(2, a), (2, b), (2, b), (5, f"{a} more"), (6, c), (None, c), (7, None), (8, ""), (7, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(2, a), (2, b), (6, c), (7, None), (None, c)]
    for out in (corpus_pipeline.near_duplicate_stage(spark, docs, ""), simhash.keep_first(docs)):
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert sorted([x for x in got if x[0] != 5], key=str) == sorted(want, key=str)


@pytest.mark.parametrize("part", ["<div>word, ", "<b>x <div>word, ", "<i><div><b>t, </i>", "<ul><li class=sidebar>x <p>t. ", "<a>x </p>"])
def test_pages_of_very_many_tags_take_time_by_their_length(part):
    import time

    def seconds(n):
        start = time.process_time()
        assert html.main_text(part * n)
        return time.process_time() - start

    seconds(100)
    small = seconds(10_000)
    assert seconds(80_000) < 24 * small + 1  # 8 times the length; the square would be 64 times the time


def test_chances_do_not_hang_on_the_chunks_beside():
    import numpy as np

    def chances(texts):
        s = pieces.Sampler(pieces.piece_model(), 1.0)
        s.sample(texts, [0] * len(texts))
        k = s.at["reproducible"]
        edges = np.flatnonzero((s.back >= s.base[k]) & (s.back < s.base[k] + s.length[k]))
        return s.cdf[edges].tobytes(), s.piece[edges].tobytes(), (s.back[edges] - s.base[k]).tobytes()

    alone = chances(["reproducible"])
    assert len(alone[0]) > 100 and alone == chances([" ".join(f"other{i}words" for i in range(3000)), "reproducible", "and more"])
