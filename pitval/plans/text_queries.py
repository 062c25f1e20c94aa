"""Text jobs over whole documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from .bindings import VIEWS, View, view
from .registry import Book

book = Book()


@book.add("f4_item_codes", "doc_id:i codes", r"""
SELECT doc_id, list_aggregate(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)item\s+\d+\.\d+'),
       lambda m: regexp_replace(m, '(?i)^item', 'Item')))), 'string_agg', '|') AS codes FROM b_docs""")
def item_codes(spark, sf):
    return view(spark, sf, "b_docs").withColumn("codes", F.array_join(tx.item_codes(F.col("text")), "|"))


VIEWS["b_reports"] = View("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '8-K' ELSE '10-K' END AS form,
       concat('Contents: item 1A. item 7. ', text, CASE WHEN doc_id % 3 > 0 THEN concat(' ITEM 1A. Risk ', text) ELSE '' END,
              CASE WHEN doc_id % 5 > 0 THEN concat(' Item 7: Outlook ', text, ' ') ELSE '' END) AS text
FROM {documents}""")
VIEWS["b_report_cuts"] = View("""
SELECT doc_id, form, text, CASE WHEN doc_id % 3 > 0 THEN length(text) - strpos(reverse(text), reverse('ITEM 1A. Risk ')) - 13
         ELSE strpos(text, 'item 1A. ') - 1 END AS a,
       CASE WHEN doc_id % 5 > 0 THEN length(text) - strpos(reverse(text), reverse('Item 7: Outlook ')) - 15
         ELSE strpos(text, 'item 7. ') - 1 END AS b FROM b_reports""")


@book.add("f5_sections", "doc_id:i sections:i mode excerpt", r"""
SELECT doc_id, CASE WHEN form = '8-K' THEN 0 ELSE 2 END AS sections, CASE WHEN form = '8-K' THEN 'debut_document' ELSE 'sections' END AS mode,
       CASE WHEN form = '8-K' THEN text ELSE array_to_string([
         CASE WHEN a < b THEN '[Item 1A - Facteurs de risque]' || chr(10) || trim(substr(text, a + 1, b - a), E' \t\n\r')
              ELSE '[Item 7 - Analyse de la direction]' || chr(10) || trim(substr(text, b + 1, a - b), E' \t\n\r') END,
         CASE WHEN a < b THEN '[Item 7 - Analyse de la direction]' || chr(10) || trim(substr(text, b + 1), E' \t\n\r')
              ELSE '[Item 1A - Facteurs de risque]' || chr(10) || trim(substr(text, a + 1), E' \t\n\r') END], chr(10) || chr(10)) END AS excerpt
FROM b_report_cuts""")
def sections(spark, sf):
    return tx.extract_sections(view(spark, sf, "b_reports"), "text", None, "form")


VIEWS["b_answers"] = View("""
SELECT conv_id, turn, role, length(text) AS n, CASE (conv_id + turn) % 5 WHEN 0 THEN '{{"category": "autre_materiel", "mater'
       WHEN 1 THEN concat('```json ', '{{"category": "', role, '", "materiality": true, "summary": "', CAST(length(text) AS VARCHAR(20)), '"}}', ' ```')
       WHEN 2 THEN concat('Here it is: ', '{{"category": "', role, '", "materiality": false, "summary": "x', chr(123), 'y', chr(125), '"}}', ' as asked. ', CAST(turn AS VARCHAR(20)))
       WHEN 3 THEN concat('  {{"category": "', role, '", "materiality": true, "summary": "s"}}  ')
       ELSE text END AS answer
FROM {conversations}""")


@book.add("f6_loose_json", "conv_id:i turn:i category materiality:b summary", """
SELECT conv_id, turn, CASE WHEN k IN (1, 2, 3) THEN role END AS category, CASE WHEN k IN (1, 3) THEN TRUE WHEN k = 2 THEN FALSE END AS materiality,
       CASE k WHEN 1 THEN CAST(n AS VARCHAR) WHEN 2 THEN 'x' || chr(123) || 'y' || chr(125) WHEN 3 THEN 's' END AS summary
FROM (SELECT *, (conv_id + turn) % 5 AS k FROM b_answers) a""")
def answers(spark, sf):
    a = view(spark, sf, "b_answers")
    parsed = tx.loose_json(F.col("answer"), "category string, materiality boolean, summary string")
    return a.withColumn("v", parsed).select("conv_id", "turn", "v.category", "v.materiality", "v.summary")
