import pytest
from pyspark.sql import functions as F

TEXTS = {
    1: "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi.",
    2: "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi.",
    3: "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi.\nshort\nshort\nAnother line with quite some more words in it.",
    4: "",
    5: None,
    6: "   \n\t ",
    7: "漢字仮名交じり文の例です。\né \\ <|endoftext|> ▁ x\u0000y 😀",
    8: " ".join(f"word{i % 997}" for i in range(30_000)),
}


@pytest.fixture(scope="module")
def messy(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns named like those the operators make."""
    rows = [(k, t, None if k % 2 else "en", k * 10) for k, t in TEXTS.items()] + [(2, TEXTS[2], "en", 20), (None, TEXTS[1], None, None)]
    names = ["verdict", "removed", "key", "fp", "row", "score", "base", "value", "ratio", "part", "b", "p"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    return df.withColumns({n: F.lit(n) for n in names})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def nothing(messy):
    return messy.limit(0)
