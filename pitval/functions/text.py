"""Filing text: item codes, sections, JSON out of loose answers."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# ---- fixed values: section headings; blanks include the no-break and thin ones ----
BLANK = "[\\s   ]*"
SECTIONS = (
    ("Item 1A - Facteurs de risque", f"(?iu)ITEM{BLANK}1A{BLANK}[.:\\-–—]?"),
    ("Item 3 - Procedures judiciaires", f"(?iu)ITEM{BLANK}3{BLANK}[.:\\-–—]?(?!\\d)"),
    ("Item 7 - Analyse de la direction", f"(?iu)ITEM{BLANK}7{BLANK}[.:\\-–—]?(?!A|\\d)"),
)
ITEM_CODE = r"(?iU)Item\s+\d+\.\d+"


def item_codes(text: Column) -> Column:
    """Distinct item codes in one spelling, sorted."""
    found = F.regexp_extract_all(text, F.lit(ITEM_CODE), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda m: F.regexp_replace(m, "(?i)^item", "Item"))))


def last_start(text: Column, pattern: str) -> Column:
    """Position (from 0) of the last match, NULL without one: what a greedy prefix leaves before it."""
    whole = f"(?s)^(.*){pattern}"
    return F.when(F.regexp_like(text, F.lit(pattern)), F.length(F.regexp_extract(text, whole, 1)))


def extract_sections(df: DataFrame, text: str, budget: int | None = None, form: str | None = None,
                     sections: Sequence[tuple[str, str]] = SECTIONS, out: str = "excerpt") -> DataFrame:
    """The wanted sections of a filing, whole, or with a character budget shared among those found.

    The last heading wins (the first is usually the table of contents). Without
    any heading, or for a current report, the head of the document is taken and
    ``mode`` says so.
    """
    t = F.col(text)
    starts = F.array_compact(F.array(*[
        F.when(last_start(t, p).isNotNull(), F.struct(last_start(t, p).alias("at"), F.lit(label).alias("label")))
        for label, p in sections]))
    periodic = F.lit(True) if form is None else F.col(form).isNull() | F.upper(form).startswith("10-K") | F.upper(form).startswith("10-Q")
    df = df.withColumn("_s", F.when(periodic, F.array_sort(starts)))

    def within(value: Column) -> Column:
        return value if budget is None else F.substring(value, 1, budget)

    def piece(s: Column, i: Column) -> Column:
        following = F.try_element_at(F.col("_s"), (i + 2).cast("int"))["at"]
        length = F.coalesce(following, F.length(t)) - s["at"]
        if budget is not None:
            length = F.least(length, F.floor(F.lit(budget) / F.nullif(F.size("_s"), F.lit(0))).cast("int"))
        body = F.regexp_replace(F.substring(t, s["at"] + 1, length), r"(?U)^\s+|\s+$", "")
        return F.when(body != "", F.concat(F.lit("["), s["label"], F.lit("]\n"), body))

    joined = within(F.concat_ws("\n\n", F.array_compact(F.transform("_s", piece))))
    found = (F.size("_s") > 0) & (joined != "")
    return df.withColumns({"sections": F.coalesce(F.size("_s"), F.lit(0)),
                           out: F.when(found, joined).otherwise(within(t)),
                           "mode": F.when(found, "sections").otherwise("debut_document")}).drop("_s")


def loose_json(answer: Column, schema: str) -> Column:
    """The JSON object inside an answer: fences off, else from the first to the last brace; NULL if none parses."""
    trimmed = F.regexp_replace(F.regexp_replace(answer, r"(?U)^\s*(```(json|JSON)?\s*)?", ""), r"(?U)\s*(```)?\s*$", "")
    opening, closing = F.instr(trimmed, "{"), F.length(trimmed) - F.instr(F.reverse(trimmed), "}") + 1
    inner = F.when((opening > 0) & (F.instr(trimmed, "}") > 0) & (closing > opening),
                   F.substring(trimmed, opening, closing - opening + 1))

    def whole(text: Column) -> Column:
        # an object and nothing torn: a strict parse that yields NULL otherwise
        return F.when(F.try_parse_json(text).isNotNull() & text.startswith("{"), F.from_json(text, schema))

    return F.coalesce(whole(trimmed), whole(inner))
