"""Nested fact documents, parallel-array filing indexes and HTML tables as rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import COMPANY_FACTS, FILING_INDEX, day


def facts_from_json(docs: DataFrame, column: str = "json") -> DataFrame:
    """Entity documents (namespace -> tag -> units -> facts) as one row per fact."""
    parsed = docs.select(F.from_json(column, COMPANY_FACTS).alias("d")).select("d.*")
    by_ns = parsed.select("cik", F.explode("facts").alias("namespace", "tags"))
    by_tag = by_ns.select("cik", "namespace", F.explode("tags").alias("tag", "body"))
    by_unit = by_tag.select("cik", "namespace", "tag", F.explode("body.units").alias("unit", "facts"))
    rows = by_unit.select("cik", "namespace", "tag", "unit", F.inline("facts"))
    return rows.select("cik", "namespace", "tag", "unit", day("start").alias("start"), day("end").alias("end"),
                       "val", day("filed").alias("filed"), "form", "fy", "fp", "accn") \
        .where("val is not null and end is not null")


def filings_from_index(blocks: DataFrame, column: str = "json", keys: tuple[str, ...] = ("cik",)) -> DataFrame:
    """Parallel arrays zipped to the shortest; index pages united and deduplicated by accession."""
    b = blocks.select(*keys, F.from_json(column, FILING_INDEX).alias("b"))
    names = [f.name for f in FILING_INDEX]
    shortest = F.least(*[F.size(f"b.{n}") for n in names])
    zipped = F.arrays_zip(*[F.slice(F.col(f"b.{n}"), F.lit(1), shortest).alias(n) for n in names])
    rows = b.select(*keys, F.inline(zipped)).toDF(*keys, *names)
    first = rows.groupBy(*keys, "accession").agg(F.min_by(F.struct("form", "filed"), "filed").alias("r"))
    return first.select(*keys, "accession", F.col("r.form").alias("form"), day("r.filed").alias("filed"))


def _plain(cell: Column) -> Column:
    """Visible text of a cell: tags out, common entities back, blanks folded."""
    text = F.regexp_replace(cell, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Every cell of every table: (key, table_no, row_no, cell_no, header flag, text)."""
    tables = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table\b.*?</table>"), F.lit(0)))
                          .alias("table_no", "t"))
    rows = tables.select(key, "table_no", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0)))
                         .alias("row_no", "r"))
    cells = rows.select(key, "table_no", "row_no", F.posexplode(
        F.regexp_extract_all("r", F.lit(r"(?is)<t[hd]\b.*?</t[hd]>"), F.lit(0))).alias("cell_no", "c"))
    return cells.select(key, "table_no", "row_no", "cell_no", F.lower(F.substring("c", 1, 3)).eqNullSafe("<th")
                        .alias("is_header"), _plain(F.col("c")).alias("text"))


def html_table(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Cells named by their column header; several header rows are joined with a blank.

    A header repeated over its sub-header counts once, so two-level headers flatten
    to ``group name`` and plain ones stay as they are.
    """
    cells = html_cells(pages, key, html)
    at = [key, "table_no", "row_no"]
    rows = cells.groupBy(*at).agg(F.min("is_header").alias("all_header"))
    cells = cells.join(rows, at)
    levels = cells.where("all_header").groupBy(key, "table_no", "cell_no").agg(
        F.array_sort(F.collect_set(F.struct("row_no", "text"))).alias("h"))
    names = levels.select(key, "table_no", "cell_no",
                          F.concat_ws(" ", F.array_distinct(F.transform("h", lambda x: x["text"]))).alias("header"))
    return cells.where("not all_header").join(names, [key, "table_no", "cell_no"], "left") \
        .select(key, "table_no", "row_no", "cell_no", F.coalesce("header", F.col("cell_no").cast("string"))
                .alias("header"), "text")


def html_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """List entries that are links: (key, position, href, label)."""
    items = pages.select(key, F.posexplode(F.regexp_extract_all(
        html, F.lit(r'<li><a href="([^"]*)">[^<]*</a></li>'), F.lit(0))).alias("position", "item"))
    return items.select(key, "position", F.regexp_extract("item", r'href="([^"]*)"', 1).alias("href"),
                        F.regexp_extract("item", r">([^<>]*)</a>", 1).alias("label"))
