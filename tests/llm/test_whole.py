"""Cases in which an operator once did less than the whole job."""
import itertools
import random

import pytest

import corpus_pipeline
from pitval.llm import chat, html, lines, quality, toxicity


def components(sets, least=0.8):
    """The smallest index that each set is linked to, by comparing all pairs."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(range(len(sets)), 2):
        if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def word_shingles(text, width=5):
    w = text.lower().split()
    return {tuple(w[i:i + width]) for i in range(max(len(w) - width, 0) + 1)}


def test_near_duplicate_stage_against_all_pairs(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    texts = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.randint(3, 200))
        texts.append(" ".join(base))
        for n in (1, 2, 4, 8):
            w = list(base)
            for _ in range(n):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    want = {i for i, c in enumerate(components([word_shingles(t) for t in texts])) if i == c}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert got == want and len(want) < 0.8 * len(texts)


def test_near_duplicate_stage_takes_the_links_of_simhash_too(spark):
    import xxhash

    def simhash_of(text):
        w = text.split()
        bits = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(len(w) - 2)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in bits) > len(bits))

    # one much repeated shingle fixes the fingerprint, while most different shingles differ
    a, b, c = (" ".join(["word"] * 400 + [f"{t}{i}" for i in range(40)]) for t in "abc")
    unlike = [" ".join(f"{t}{i}" for i in range(60)) for t in "de"]
    assert all((simhash_of(a) ^ simhash_of(x)).bit_count() <= 2 for x in (b, c)) and (simhash_of(a) ^ simhash_of(unlike[0])).bit_count() > 2
    assert len(word_shingles(a) & word_shingles(b)) < 0.8 * len(word_shingles(a) | word_shingles(b))
    close = b + " last words"  # like b by its shingles, and so in a's group through b
    docs = spark.createDataFrame(list(enumerate([a, close, b, c, *unlike])), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [0, 4, 5]


def removed_lines(spark, texts, **how):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"] for r in lines.dedupe_lines(docs, **how).collect() if r["removed"]}


def test_line_shingles_start_at_every_character(spark):
    texts = ["payment of order 202600001234567 was settled for account 490012345678901",
             "payment of order 202600001987654 was settled for account 490012345111222",
             "the committee will publish its yearly report about regional water quality next spring",
             "the committee will publish its yearly report about regional wader quality next spring"]
    assert removed_lines(spark, texts) == {3}


def char_shingles(line, width=5):
    return {line[i:i + width] for i in range(max(len(line) - width, 0) + 1)}


def test_short_lines_at_the_threshold_are_found(spark):
    """Nine shingles a line, eight of them shared: similarity 0.8, with the bands of production."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    texts, n = [], 2000
    for _ in range(n):
        start = " ".join("".join(rng.choices(letters, k=2)) for _ in range(4))
        texts += [f"{start} {x}" for x in rng.sample(letters, 2)]
    a, b = (char_shingles(t) for t in texts[:2])
    assert len(a & b) == 8 and len(a | b) == 10
    gone = removed_lines(spark, texts)
    assert len(gone & set(range(1, 2 * n, 2))) >= 0.99 * n


def test_lines_without_spaces_and_short_equal_lines(spark):
    passage = "本协议由双方于签署之日起生效并在有效期内对双方具有约束力任何一方不得擅自变更或解除"
    texts = [passage, passage, passage + "方", "Table of contents", "table of contents", "Share", "Share"]
    assert removed_lines(spark, texts) == {1, 2, 4}


def test_slurs_of_a_small_share_are_learned(spark):
    """A topic with 2 % of the toxic rows gets its entry; the common words of copies do not."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("cdfhmnprtu", k=7)) for _ in range(800)]

    def text(*more):
        w = rng.choices(vocabulary, k=20)
        for x in more:
            w.insert(rng.randrange(len(w)), x)
        return " ".join(w)
    rows = [(text("wrackle"), 1) for _ in range(1960)] + [(text("zumpfig"), 1) for _ in range(40)] + [(text(), 0) for _ in range(2000)]
    rows += [("harmless copied gardening notice with many plain words wrackle", 1)] * 100
    table = [(i, t, y) for i, (t, y) in enumerate(rows)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in table], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in table], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    found = {e for e in lexicon.weights if " zumpfig ".startswith(e)}
    assert found and lexicon.score(text("zumpfig")) > 0 and not any("gardening".startswith(e.strip()) for e in lexicon.weights)


def test_conversation_of_rows_without_turn_numbers_is_cut_into_blocks(spark):
    n = 1000
    rows = [(None, None, "user", f"text {i % 300}") for i in range(n)] + [(1, 7, "user", "same")] * n + [(2, i, "user", f"t {i}") for i in range(n)]
    out = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    per_block = {}
    said = {}
    for r in out.orderBy("conv_id", "block", "window").collect():
        per_block[r["conv_id"], r["block"]] = per_block.get((r["conv_id"], r["block"]), 0) + r["n_new"]
        said.setdefault(r["conv_id"], []).extend(t for _, t in chat.read_turns(r["formatted"])[r["n_repeated"]:])
    assert max(per_block.values()) <= chat.BLOCK and len(per_block) == 12
    assert said[None] == sorted(f"text {i % 300}" for i in range(n)) and said[1] == ["same"] * n and said[2] == [f"t {i}" for i in range(n)]


def test_every_trusted_row_counts(spark):
    labels = spark.range(60_000).selectExpr("id as doc_id", "1 as quality")
    assert quality.trusted_rows(labels).count() > 20_000


ARTICLE = ("<h1>Heading of the page</h1><p>First paragraph, with a comma; and more text to weigh, as articles have.</p>"
           "<p>Second paragraph, longer than the first one, I believe, and with an end.</p>")
PLAIN = ("Heading of the page First paragraph, with a comma; and more text to weigh, as articles have. "
         "Second paragraph, longer than the first one, I believe, and with an end.")


@pytest.mark.parametrize("name", ["layout sidebar-right", "long-form", "free-form", "legal-news", "search-results", "side-by-side", "sidebar"])
def test_an_article_in_an_element_with_a_listed_word_stays(name):
    page = f"<html><body><div class='menu'><a href=/a>Home</a> <a href=/b>News</a></div><div class='{name}'>{ARTICLE}</div><div class='footer'>Imprint</div></body></html>"
    assert html.main_text(page) == PLAIN


def test_headings_formulas_and_pages_with_nothing_else():
    page = f"<body><div class='article-header'><h1>Title of it</h1></div>{ARTICLE}</body>"
    assert html.main_text(page) == f"Title of it {PLAIN}"
    page = "<body><p>The energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math>, as we know, for a body at rest.</p></body>"
    assert html.main_text(page) == "The energy is E=m, as we know, for a body at rest."
    assert html.main_text("<body><form><p>All of the page, which is in a form.</p></form></body>") == "All of the page, which is in a form."
