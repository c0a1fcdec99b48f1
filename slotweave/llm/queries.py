"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotweave.llm import containment, packing, residue
from slotweave.queries import Registry, table

registry = Registry()
query = registry.add


@query("SELECT doc_id FROM documents WHERE strlen(text) + 1 > 16384")
def p6_found(spark, folder):
    """Documents whose pieces were put into several containers."""
    placed = packing.pack_documents(table(spark, folder, "documents"))
    own = placed.groupBy("doc_id").agg(F.min("container").alias("lowest"), F.max("container").alias("highest"), F.max("piece").alias("piece"))
    return own.where("lowest < highest AND piece > 0").select("doc_id")


@query()
def p6_assignment(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"))


@query(
    """SELECT count(*) AS documents, CAST(sum(strlen(text) + 1) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS incomplete, CAST(0 AS BIGINT) AS split_without_need,
  CAST(0 AS BIGINT) AS over_full, CAST(0 AS BIGINT) AS misplaced, true AS near_ideal FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL"""
)
def p6_audit(spark, folder):
    """The rules that the assignment must keep, recomputed from where the pieces lie; SQL says what they must give."""
    documents = table(spark, folder, "documents")
    return packing.audit(documents, packing.pack_documents(documents))


def _joined(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN array_to_string(list_transform(json_extract({x}, '$[*]'), lambda e: json_extract_string(e, '$')), '') ELSE coalesce(json_extract_string({x}, '$'), '') END"


_P7 = f"""WITH cell AS (SELECT doc_id, i, c FROM (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, json_extract(text, '$.cells[*]') AS l FROM documents WHERE text LIKE '{{%' AND json_valid(text)))),
outp AS (SELECT doc_id, i, string_agg({_joined("o")}, ' ' ORDER BY k) AS t FROM (SELECT doc_id, i, unnest(json_extract(c, '$.outputs[*].text')) AS o, generate_subscripts(json_extract(c, '$.outputs[*].text'), 1) AS k FROM cell) GROUP BY ALL),
book AS (SELECT cell.doc_id, string_agg({_joined("json_extract(c, '$.source')")} || ' ' || coalesce(outp.t, ''), ' ' ORDER BY cell.i) AS t FROM cell LEFT JOIN outp ON outp.doc_id = cell.doc_id AND outp.i = cell.i GROUP BY cell.doc_id),
seen AS (SELECT d.doc_id, coalesce(book.t, d.text) AS t FROM documents d LEFT JOIN book ON book.doc_id = d.doc_id),
dw AS (SELECT doc_id, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM seen),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM eval_items),
ip AS (SELECT item_id, least(len(w), 13) AS n, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS st FROM iw WHERE len(w) > 0),
pas AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, st, st + n - 1), ' ') AS p FROM ip),
win AS (SELECT doc_id, n, array_to_string(list_slice(w, st, st + n - 1), ' ') AS p FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS st FROM dw, (SELECT DISTINCT n FROM pas) WHERE len(w) >= n))
SELECT DISTINCT doc_id, item_id FROM win JOIN pas ON win.n = pas.n AND win.p = pas.p"""


@query(_P7)
def p7_found(spark, folder):
    return containment.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@query(
    _P7.rpartition("SELECT DISTINCT doc_id, item_id")[0]
    + """SELECT doc_id, win_item AS item_id, count(DISTINCT p) AS found, any_value(total) AS passages FROM (SELECT win.doc_id, pas.item_id AS win_item, pas.p, t.total FROM win
  JOIN pas ON win.n = pas.n AND win.p = pas.p JOIN (SELECT item_id, count(*) AS total FROM pas GROUP BY item_id) t ON t.item_id = pas.item_id) GROUP BY doc_id, win_item"""
)
def p7_shares(spark, folder):
    """How much of a leaked item stands in a document."""
    return containment.leaked_shares(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@query()
def p8_found(spark, folder):
    return residue.leftover_documents(table(spark, folder, "documents"))
