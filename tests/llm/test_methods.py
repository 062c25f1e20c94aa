"""Every operator against a plain version of its method, on small input."""
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pitval.llm import chat, components, html, language, lines, neighbours, packing, pieces, quality, simhash, toxicity
from pitval.llm.common import table


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_registered():
    names = entry.queries()
    assert sum(n.startswith("op") and n[2].isdigit() for n in names) == 13 and "pipeline" in names


def test_quality_counts(spark, sf, docs):
    for r in quality.op5(spark, sf).collect():
        w, text = words(docs[r["doc_id"]]), docs[r["doc_id"]]
        windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        seen = Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
        some = [x for x in text.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(some) - len(set(some)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)


def test_quality_ratio(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    trusted = quality.trusted_rows(table(spark, sf, "labels"))
    good = {r[0] for r in trusted.collect()}
    assert good and not any(map(held_out, good))
    rows = docs.select("doc_id", quality.ngram_buckets(F.col("text")).alias("g")).collect()
    p, q = Counter(), Counter()
    for r in rows:
        q.update(r["g"])
        if r["doc_id"] in good:
            p.update(r["g"])
    n = quality.BUCKETS
    ratio = [math.log((p[b] + 1) / (sum(p.values()) + n)) - math.log((q[b] + 1) / (sum(q.values()) + n)) for b in range(n)]
    got = {r["doc_id"]: r["score"] for r in quality.op5(spark, sf).collect()}
    for r in rows:
        want = sum(ratio[b] for b in r["g"]) / len(r["g"]) if r["g"] else 0.0
        assert got[r["doc_id"]] == pytest.approx(want, abs=1e-9)


def test_quality_separates_labels(spark):
    sf = "/root/testdata/sf0.1"
    out = quality.op5(spark, sf).join(table(spark, sf, "labels"), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    n = {(r["quality"], r["kept"]): r["n"] for r in out.where("not base_failed").groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert n.get((1, True), 0) > 0.99 * (n.get((1, True), 0) + n.get((1, False), 0))


def test_toxic_words_in_disguise():
    lex = toxicity.Lexicon({" idiot ": 8.0, " stup": 7.0}, toxicity.learn.__defaults__[-1] + (toxicity.folded("village idiot"),))
    for text in ("You idiot!", "an 1D10T", "іdіоt", "ｉｄｉｏｔ", "id­iot", "STUP1DLY done"):
        assert lex.score(text) > toxicity.THRESHOLD, text
    for text in ("idiotic", "a village idiot here", "", None, "plain words"):
        assert lex.score(text) == 0.0, text
    assert lex.score("idiot " + "calm " * 60_000) < lex.score("idiot calm")


def test_lexicon_matching_against_plain_scan():
    rng = random.Random(3)
    lex = toxicity.Lexicon({" ab": 2.0, " abc ": 5.0, " b ": 1.0}, (" x b ",))
    for _ in range(200):
        text = toxicity.folded(" ".join("".join(rng.choices("abcx", k=rng.randint(1, 4))) for _ in range(12)))
        w = text.split()
        want = []
        for i, x in enumerate(w):
            found = [v for e, v in lex.weights.items() if (x == e.strip() if e.endswith(" ") else x.startswith(e.strip()))]
            if found and not (x == "b" and i and w[i - 1] == "x"):
                want.append(max(found))
        assert sorted(lex.weights[e] for _, e in lex.matches(text)) == sorted(want)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.op1(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["n"] for r in out.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    assert n.get((0, 1), 0) < 0.01 * n[0, 0] and n[1, 1] > 0.6 * (n[1, 1] + n.get((1, 0), 0))


def test_automaton_phrases():
    rng = random.Random(5)
    for _ in range(100):
        known, text = ("".join(rng.choices("abc ", k=rng.randint(0, 30))) for _ in range(2))
        text += "z"
        at, want = 0, 0
        while at < len(text):
            n = max((n for n in range(1, len(text) - at + 1) if text[at:at + n] in known), default=1)
            at, want = at + n, want + 1
        assert language.SuffixAutomaton(known).phrases(text) == want


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = language.op3(spark, sf).join(table(spark, sf, "documents"), "doc_id").where("held_out").select("lang", "lang_pred").collect()
    assert sum(a == b for a, b in out) > 0.95 * len(out)


def test_radii_and_segments_cover_every_pair():
    rng = random.Random(1)
    for distance, parts in ((2, 2), (3, 2), (3, 4), (2, 3)):
        cut = simhash.segments(64, parts)
        assert sum(w for _, w in cut) == 64
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), distance))
            assert any((x >> s & (1 << w) - 1).bit_count() <= r for (s, w), r in zip(cut, simhash.radii(distance, parts)))


def test_simhash(spark, sf, docs):
    out = {r["doc_id"]: r for r in simhash.op10(spark, sf).collect()}
    prints = {}
    for d, text in docs.items():
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in words(text)]
        grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if grams else 0
        assert out[d]["fingerprint"] == f"{prints[d]:016x}"
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sorted(docs), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    assert {d: r["component_id"] for d, r in out.items()} == {d: find(d) for d in docs}


def test_links_at_other_distances(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(8)]
    fps = list({b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 4, 5)})
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "fp long, node long")
    for distance, parts in ((2, 2), (3, 2), (2, 3)):
        got = {tuple(sorted(r)) for r in simhash.links(df, distance, parts).collect()}
        assert got == {(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= distance}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, i) for i in range(501, 560)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_packing(spark, sf, docs):
    from tokenizers import Tokenizer
    import public_tokenizers
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.op2(spark, sf).collect()
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for d, t in docs.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == docs.keys()
    for d, ps in by_doc.items():
        ps.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in ps] == list(range(len(ps))) and sum(p["length"] for p in ps) == len(ids[d])
        assert all(p["length"] == 1024 for p in ps[1:])
        for p in ps:
            part = np.array(ids[d][p["start"]:p["start"] + p["length"]], "<u4")
            assert len(part) == p["length"] and zlib.crc32(part) == p["ids_crc32"]
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    assert len(by_seq) <= 1.05 * math.ceil(sum(map(len, ids.values())) / 1024) + 1


def test_open_bins_against_plain_best_fit():
    rng = random.Random(6)
    bins, plain, made = packing.OpenBins(50, 4), {}, 0
    for _ in range(500):
        n = rng.randint(1, 50)
        fits = [f for f in plain.values() if f >= n]
        b, offset = bins.put(n)
        if fits:
            assert b in plain and plain[b] == min(fits) and offset == 50 - plain[b]
        else:
            assert b == made and offset == 0
            made += 1
            if len(plain) == 4 and n < 50:
                full = min(plain.values())
                gone = [k for k, f in plain.items() if f == full and k not in itertools.chain.from_iterable(bins.by_free)]
                assert len(gone) == 1
                del plain[gone[0]]
            plain[b] = 50
        plain[b] -= n
        if not plain[b]:
            del plain[b]


def test_pieces_lossless_and_reproducible(spark, sf, docs):
    df = table(spark, sf, "documents").select("doc_id", "text")
    one = {r["doc_id"]: r["ids"] for r in pieces.op7(spark, sf).collect() if r["lossless"]}
    two = {r["doc_id"]: r["ids"] for r in pieces.encode(df.repartition(7, "text")).collect()}
    other = {r["doc_id"]: r["ids"] for r in pieces.encode(df, seed=1).collect()}
    assert one == two and one.keys() == docs.keys() and one != other


def test_pieces_follow_the_lattice_distribution():
    s = pieces.Sampler(pieces.piece_model(), 1.0)
    names = {bytes(t): i for i, t in enumerate(s.text) if i >= 259}

    def every(word):
        if not word:
            yield (), 0.0
        for k in range(1, len(word) + 1):
            if (i := names.get(word[:k])) is not None:
                for rest, c in every(word[k:]):
                    yield (i, *rest), c + s.cost[i]
    want = {ids: math.exp(c) for ids, c in every(b" inter")}
    total, n = sum(want.values()), 20_000
    ids, per = s.sample([" inter"] * n, [k * 7919 for k in range(n)])
    ends = np.cumsum(per)
    seen = Counter(tuple(ids[e - p:e].tolist()) for e, p in zip(ends, per))
    for ids_, w in want.items():
        assert abs(seen[ids_] / n - w / total) < 0.02


def shingle_set(line):
    return {line[m.start():m.start() + 9] for m in re.finditer(r"(?<![^\W_])[^\W_]", line)}


def test_line_dedup(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=30)) for _ in range(40)]
    rows = []
    for d in range(120):
        picked = []
        for b in rng.sample(base, 3):
            w = b.split()
            for _ in range(rng.choice([0, 0, 1, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            picked.append(" ".join(w))
        rows.append((d, "\n".join([*picked, "tiny line"])))
    all_lines = [(d, k, x) for d, t in rows for k, x in enumerate(t.split("\n")) if len(x.split()) >= 5]
    sets = [shingle_set(x) for *_, x in all_lines]
    root = list(range(len(all_lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(range(len(all_lines)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    want = {(d, k) for i, (d, k, _) in enumerate(all_lines) if find(i) != i}
    out = lines.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string"), bands=16).collect()
    assert {(r["doc_id"], k) for r in out for k in r["removed"]} == want and want
    for r in out:
        parts = dict(rows)[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(x for k, x in enumerate(parts) if k not in r["removed"])


def test_one_window_per_turn_and_budget():
    def encode(text):
        return text.split()
    turns = [{"role": r, "text": "w " * n} for r, n in (("system", 3), ("user", 10), ("assistant", 20), ("user", 5), ("assistant", 60), ("user", 1))]
    out = chat.lay_out(turns, turns[0], [], 40, 2, encode)
    assert sum(w["n_new"] for w in out) == len(turns)
    read = [t for w in out for t in chat.read_turns(w["formatted"])[w["n_repeated"]:]]
    assert read == [(t["role"], t["text"]) for t in turns]
    loss = "".join(chat.unescape(w["formatted"][s["start"]:s["end"]]) for w in out for s in w["loss"])
    assert loss == "".join(t["text"] for t in turns if t["role"] == "assistant")
    assert all(w["n_tokens"] <= 40 or w["n_new"] == 1 for w in out)
    assert all(chat.read_turns(w["formatted"])[0] == ("system", "w w w ") for w in out)


def test_escape_round_trip():
    rng = random.Random(9)
    bits = [*chat.CONTROL, "\\", "<", "[", "/", "x", "s>", "INST]"]
    for _ in range(2000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 8)))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROL)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<div id="cookie-notice"><p>We use cookies, and more cookies, on this site. Accept?</p></div>
<div class="menu"><a href=/a>Home</a> <a href=/b>News, sport</a></div>
<div class="main"><h2>A heading</h2><p>First <b>para</b>graph, with a comma; and more text to weigh.<p>Second &amp; last paragraph, longer than the first one, I believe.
<script>var x = "</p><p>not text";</script><ul><li>One item.<li>Short</ul></div>
<div class="sidebar"><p>Related story, which is long enough to look like text, really.</p></div>
<form><label>Mail</label><input></form><div id="comments"><p>Nice article, thanks! I read it twice, and more.</p></div>
<footer>&copy; 2020, all rights.</footer></body></html>"""


def test_main_text_of_a_page_without_article():
    assert html.main_text(PAGE) == ("A heading First paragraph, with a comma; and more text to weigh. "
                                    "Second & last paragraph, longer than the first one, I believe. One item. Short")


def test_main_text_of_articles(spark, sf):
    import html as markup
    rows = table(spark, sf, "pages").collect()
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        plain = markup.unescape(re.sub(r"</?[a-z0-9]+[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", body))
        assert html.main_text(r["html"]) == " ".join(plain.split())


def test_neighbours_recall(spark):
    sf = "/root/testdata/sf0.1"
    data = table(spark, sf, "embeddings").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in data]), np.array([r[1] for r in data], float)
    got = {}
    for r in neighbours.search(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, part_rows=128).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = (r["rank"], r["score"])
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        near = ids[np.lexsort((ids, d))[:10]]
        hits += sum(int(n) in got[q] for n in near)
        assert all(s == pytest.approx(d[ids == v][0], abs=1e-12) for v, (_, s) in got[q].items())
        assert sorted(k for k, _ in got[q].values()) == list(range(1, 11))
    assert hits >= 0.9 * 10 * len(got)


def test_balanced_partition():
    x = np.random.default_rng(0).normal(size=(800, 8))
    label = neighbours.balanced_partition(x, neighbours.neighbour_graph(x, 5), 8)
    assert np.bincount(label, minlength=8).max() <= 111 and np.bincount(label, minlength=8).min() >= 89


def test_pipeline_on_the_smallest_data(spark, sf, docs):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, sf).collect()
    kept = {r["doc_id"] for r in out}
    judged = {r["doc_id"] for r in quality.op5(spark, sf).where("kept").collect()}
    assert kept and kept <= judged
