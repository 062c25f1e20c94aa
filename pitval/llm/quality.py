"""Quality rules: counts of a text, then a log-likelihood ratio of hashed n-grams. Built-in functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pitval.session import stack

from .common import WORD, fold, free, let, table

TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]+"
BUCKETS = 1 << 14
SPAN = 5
THRESHOLD = -0.3


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _covered(windows: Column) -> Column:
    """Positions covered by windows whose hash occurs twice or more.

    The hashes are sorted with their places, equal neighbours are kept, and the
    places, sorted again, are counted as a union of intervals: n log n at any length.
    """
    def count(s):
        last = F.size(s) - 1
        twin = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get(s, i)["h"] == F.get(s, F.greatest(i - 1, F.lit(0)))["h"]) & (i > 0)
                        | (F.get(s, i)["h"] == F.get(s, F.least(i + 1, last))["h"]) & (i < last))
        places = F.sort_array(F.transform(twin, lambda i: F.get(s, i)["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
        return F.aggregate(places, start, lambda acc, p: F.struct((acc["n"] + p + SPAN - F.greatest(p, acc["upto"])).alias("n"), (p + SPAN).alias("upto")),
                           lambda acc: acc["n"])

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(ordered, count))


def _repeats(words: Column) -> Column:
    def windows(h):
        return F.transform(F.sequence(F.lit(0), F.size(h) - SPAN), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SPAN)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= SPAN, F.lit(0).cast("long")).otherwise(let(hashed, lambda h: let(windows(h), _covered)))


def counts(text: Column) -> Column:
    """Struct of the base counts; a null text has no words."""
    text = F.coalesce(text, F.lit(""))

    def of(words):
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeats(words).alias("n_repeat_words"))

    return let(_words(text), of)


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all token unigrams and bigrams of the whole text, in order; tokens are letter runs and punctuation runs."""
    def of(t):
        ones = F.transform(t, lambda x: F.pmod(F.hash(x), F.lit(buckets)))
        twos = F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.pmod(F.hash(F.get(t, i), F.get(t, i + 1)), F.lit(buckets)))
        return F.when(F.size(t) < 2, ones).otherwise(F.concat(ones, twos))

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), of)


def ratios(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row: ``ratio``, the array of log p(bucket) / q(bucket).

    q counts the n-grams of all documents, p those of the trusted ones; both have one
    added per bucket. Counts are combined before the shuffle, so what moves is at most
    ``buckets`` rows per task, and the result has ``buckets`` values at any input size. The
    texts meet the trusted keys in a merge join whatever the sizes are, so the plan is the
    same for a small table and a large one. No trusted text: all ratios are 0.
    """
    ids = trusted.select(F.col(key).alias("key"), F.lit(1).alias("trusted")).distinct().hint("merge")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    known = texts.where("key is not null").join(ids, "key", "left").select("trusted", "text")
    nameless = texts.where("key is null").select(F.lit(None).cast("int").alias("trusted"), "text")  # never trusted, so they need no join
    grams = stack(known, nameless).select("trusted", F.explode(ngram_buckets(F.col("text"), buckets)).alias("b"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"))
    seen = stack(grams.groupBy("b").agg(F.count("trusted").alias("p"), F.count("*").alias("q")), every)
    total = (seen.groupBy("b").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
             .agg(F.sort_array(F.collect_list(F.struct("b", "p", "q"))).alias("all"), F.sum("p").alias("np"), F.sum("q").alias("nq")))
    log = F.transform("all", lambda x: F.when(F.col("np") == 0, F.lit(0.0)).otherwise(
        F.log((x["p"] + 1) / (F.col("np") + buckets)) - F.log((x["q"] + 1) / (F.col("nq") + buckets))))
    return total.select(log.alias("ratio"))


def score(text: Column, ratio: Column, buckets: int = BUCKETS) -> Column:
    """Mean log ratio per n-gram of the whole text; 0 for a text without n-grams."""
    def mean(grams, r):
        total = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.get(r, b))
        return F.when(F.size(grams) == 0, F.lit(0.0)).otherwise(total / F.size(grams))

    return let(ratio, lambda r: let(ngram_buckets(text, buckets), lambda g: mean(g, r)))


def trusted_rows(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Keys of all rows labelled good, outside the held-out third."""
    return labels.where((F.col(label) == 1) & (fold(key) != 1)).select(key).distinct()


def judge(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
          min_words: int = 10, max_repeat_percent: int = 20, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with one more column ``verdict``: the counts, ``base_failed``, ``score`` and ``kept``.

    ``trusted`` holds the keys of trusted documents, any number of them. The n-grams of all documents are counted first;
    the second pass scores every text on its own, without a shuffle. A document is
    kept if no base rule fails and its score is not below ``threshold``.

    Null and empty texts have no words and fail the base rules. Repeated rows get the
    same verdict. Null keys are never trusted. An empty table gives an empty result.
    Should ``docs`` have a column ``verdict``, the new one is ``_verdict``.
    """
    base, value, ratio = free(docs, "base"), free(docs, "value"), free(docs, "ratio")
    counted = (docs.withColumn(ratio, ratios(docs, trusted, key, text, buckets).scalar())
               .withColumns({base: counts(F.col(text)), value: score(F.col(text), F.col(ratio), buckets)}).drop(ratio))
    n = F.col(base)["n_words"]
    failed = (n < min_words) | (100 * F.col(base)["n_repeat_words"] > max_repeat_percent * n)
    verdict = F.struct(F.col(f"{base}.*"), failed.alias("base_failed"), F.col(value).alias("score"), (~failed & (F.col(value) >= threshold)).alias("kept"))
    return counted.withColumn(free(docs, "verdict"), verdict).drop(base, value)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, trusted_rows(table(spark, sf_dir, "labels"))).select("doc_id", "verdict.*")
