"""Queries of whole policy-change cases: opened, replied to, and written out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import change_cases as D
from .changes import CASE_DIGEST
from .queries import _t, query

#: One customer a case, its orders the sources. By c % 5: no proposal, one with two items, no JSON, an action there is not, a summary alone.
GOOD = '{{"summary":"","items":[{{"action":"add","kind":"limit_change","fieldPath":"coverage.limit","label":"Limit","beforeValue":"of","afterValue":"5","citations":[{{"sourceId":"{}","quote":"of "}}]}},{{"action":"update","fieldPath":"x","label":"Other"}}],"missingInfoQuestions":[{{"fieldPath":"x","question":"Which x?","reason":"r"}}]}}'

OPENED = f"""WITH s AS (SELECT o_custkey AS c, min(o_orderkey)::VARCHAR AS k, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
b AS (SELECT c_custkey AS c, c_mktsegment AS seg, c_custkey % 4 AS t, c_custkey % 5 AS p, s.k AS src, coalesce(n, 0) AS n_sources, coalesce('d' || s.k, 'unknown') AS doc FROM customer LEFT JOIN s ON s.c = c_custkey),
i0 AS (SELECT c, 0 AS pos, CASE t WHEN 1 THEN 'remove' WHEN 0 THEN 'add' ELSE 'update' END AS action, CASE t WHEN 2 THEN 'limit_change' WHEN 3 THEN 'cancellation' ELSE 'vehicle_change' END AS kind, CASE t WHEN 0 THEN 'auto.vehicles' WHEN 1 THEN 'auto.drivers' WHEN 2 THEN 'coverage.limit' ELSE 'policy.change' END AS path,
  CASE t WHEN 0 THEN 'Please add a vehicle' WHEN 1 THEN 'Remove driver' WHEN 2 THEN 'Raise the limit to "' || c || '"' ELSE 'cancel it' END AS label, CASE WHEN t = 0 AND src IS NOT NULL THEN seg END AS was, CASE t WHEN 0 THEN 'BMW' WHEN 2 THEN c::VARCHAR END AS v, doc, CASE WHEN t = 0 THEN src END AS cited FROM b WHERE p IN (0, 2, 3)
  UNION ALL SELECT c, 0, 'add', 'limit_change', 'coverage.limit', 'Limit', 'of', '5', 'unknown', coalesce(src, 'none') FROM b WHERE p = 1
  UNION ALL SELECT c, 1, 'update', 'general_endorsement', 'x', 'Other', NULL, NULL, 'unknown', NULL FROM b WHERE p = 1),
ix AS (SELECT *, CASE WHEN v IS NULL AND action <> 'remove' THEN 'needs_info' ELSE 'ready' END AS status, '["' || doc || '","' || kind || '","' || path || '","' || coalesce(v, '') || '","' || coalesce(cited, '') || '"]' AS x FROM i0),
i AS (SELECT * EXCLUDE (x), 'pci-' || substr({CASE_DIGEST}, 1, 12) AS id FROM ix),
qx AS (SELECT c, id AS item_id, path, CASE WHEN path = 'x' THEN 'Which x?' ELSE '{D.ASK}' END AS question FROM i WHERE v IS NULL),
qy AS (SELECT *, '["' || item_id || '","' || path || '","' || question || '"]' AS x FROM qx),
q AS (SELECT * EXCLUDE (x), 'question-' || substr({CASE_DIGEST}, 1, 12) AS id FROM qy),
v AS (SELECT c, pos * 11 + 1 AS pos, 'unknown_source' AS code, 'Citation source none was not provided for coverage.limit.beforeValue.' AS m FROM i WHERE cited = 'none'
  UNION ALL SELECT c, pos * 11 + 4, 'required_value_missing', 'Requested value for ' || path || ' is missing.' FROM i WHERE status = 'needs_info'
  UNION ALL SELECT c, pos * 11 + 9, 'notice_rule_ambiguous', 'cancellation request needs an effective date and source-backed notice/timing terms.' FROM i WHERE kind = 'cancellation'),
gi AS (SELECT c, count(*) AS n, string_agg(id, '|' ORDER BY pos) AS ids, string_agg(action || ' ' || label, '; ' ORDER BY pos) AS listed, min(label) AS label FROM i GROUP BY c),
gv AS (SELECT c, string_agg(code || ': ' || m, chr(10) ORDER BY pos) AS told FROM v GROUP BY c),
o AS (SELECT b.c, CASE p WHEN 4 THEN 'S' WHEN 1 THEN listed ELSE label END AS summary, CASE WHEN told IS NULL THEN 'deterministic_tree' ELSE 'hybrid' END AS mode, coalesce(gi.n, 0) AS n_items, coalesce(ids, '') AS items, q.id AS question, q.item_id AS asked_of, coalesce(told, '') AS issues, n_sources,
  CASE p WHEN 2 THEN 'proposal is not JSON' WHEN 3 THEN 'an item is not as asked for' END AS refused FROM b LEFT JOIN gi ON gi.c = b.c LEFT JOIN gv ON gv.c = b.c LEFT JOIN q ON q.c = b.c)"""

REPLIED = f"""{OPENED}, r AS (SELECT c, p, t, 'yes ' || c AS said, c % 7 = 0 AS offered, q.question FROM b LEFT JOIN (SELECT c AS qc, id AS question FROM q) q ON qc = c WHERE c % 3 > 0),
a AS (SELECT c, question, CASE WHEN question IS NULL THEN NULL WHEN offered THEN CASE WHEN p = 1 THEN '7' END ELSE said END AS answer FROM r),
j AS (SELECT i.*, coalesce(v, a.answer) AS now, CASE WHEN v IS NULL AND a.answer IS NOT NULL THEN 'ready' ELSE status END AS state FROM i LEFT JOIN a ON a.c = i.c),
jv AS (SELECT v.c, count(*) AS n FROM v LEFT JOIN a ON a.c = v.c WHERE code <> 'required_value_missing' OR a.answer IS NULL GROUP BY v.c)"""


def _orders(spark, sf):
    cases = _t(spark, sf, "customer").select(F.col("c_custkey").alias("_c"), F.lower("c_mktsegment").alias("seg"))
    return _t(spark, sf, "orders").join(cases, F.col("o_custkey") == F.col("_c"))


def opened(spark, sf) -> D.Cases:
    c = F.col("c_custkey")
    text = F.when(c % 4 == 0, F.concat(F.lit('Please add a vehicle. Change from "'), "c_mktsegment", F.lit('" to BMW; now 1/2/24'))).when(c % 4 == 1, "Remove driver").when(c % 4 == 2, F.concat(F.lit('Raise the limit to "'), c, F.lit('"'))).otherwise("cancel it")
    none = F.lit(None).cast("string")
    customers = _t(spark, sf, "customer")
    requests = customers.select(c.alias("case_id"), text.alias("text"), none.alias("requested"))
    k = F.col("o_orderkey")
    sources = _orders(spark, sf).select(F.col("o_custkey").alias("case_id"), k.alias("pos"), k.cast("string").alias("source_id"), F.lit("Page").alias("label"), F.concat(F.lit("of "), "seg").alias("text"), F.concat(F.lit("d"), k).alias("document_id"), (k % 9).alias("page"), none.alias("field_path"), F.when(k % 3 == 0, F.concat(F.lit("F"), k % 2)).alias("form_number"), none.alias("starts"), none.alias("ends"))
    first = sources.groupBy(F.col("case_id").alias("_c")).agg(F.min_by("source_id", "pos").alias("src"))
    before, after = GOOD.format("\0").split("\0")
    good = F.concat(F.lit(before), F.coalesce("src", F.lit("none")), F.lit(after))
    json = F.when(c % 5 == 1, good).when(c % 5 == 2, "sorry").when(c % 5 == 3, '{"summary":"x","items":[{"action":"raise","fieldPath":"x","label":"y"}]}').when(c % 5 == 4, '{"summary":"S","items":[]}')
    proposals = customers.join(first, c == F.col("_c"), "left").select(c.alias("case_id"), json.alias("json")).where("json IS NOT NULL")
    return D.open_cases(requests, sources, proposals)


def _replied(spark, sf) -> D.Replied:
    c = F.col("c_custkey")
    rows = _t(spark, sf, "customer").where(c % 3 > 0)
    replies = rows.select(c.alias("case_id"), F.concat(F.lit(" yes "), c, F.lit(" ")).alias("text"))
    json = F.when(c % 7 == 0, '{"answers":[{"fieldPath":"x","answer":"7"},{"fieldPath":"x","answer":"9"},{"questionId":"none","answer":"8"}]}').when(c % 7 == 1, '{"answers":[{"answer":3}]}')
    return D.reply(opened(spark, sf), replies, rows.select(c.alias("case_id"), json.alias("json")).where("json IS NOT NULL"))


def _listed(df, value, order, name):
    return df.groupBy(F.col("case_id").alias(f"_{name}")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("v")))), lambda x: x["v"]).alias(name))


@query(f"{OPENED} SELECT c AS case_id, summary, mode, n_items, items, question, asked_of, issues, n_sources, refused FROM o")
def change_cases_opened(spark, sf):
    s = opened(spark, sf)
    rows = s.cases.select("case_id", "summary", "mode")
    tables = (
        (_listed(s.items, F.col("item_id"), "pos", "ids"), "_ids"),
        (_listed(s.issues, F.concat_ws(": ", "code", "message"), "pos", "told"), "_told"),
        (s.questions.select(F.col("case_id").alias("_q"), F.col("question_id").alias("question"), F.col("item_id").alias("asked_of")), "_q"),
        (s.sources.groupBy(F.col("case_id").alias("_n")).agg(F.count("*").alias("n")), "_n"),
        (s.quarantine.select(F.col("case_id").alias("_r"), F.col("error").alias("refused")), "_r"),
    )
    for df, key in tables:
        rows = rows.join(df, F.col("case_id") == F.col(key), "left")
    text = lambda c, sep: F.coalesce(F.array_join(c, sep), F.lit(""))
    return rows.select("case_id", "summary", "mode", F.coalesce(F.size(F.coalesce("ids", F.array().cast("array<string>"))), F.lit(0)).cast("long").alias("n_items"), text("ids", "|").alias("items"), "question", "asked_of", text("told", "\n").alias("issues"), F.coalesce("n", F.lit(0)).alias("n_sources"), "refused")


@query(f"""{REPLIED} SELECT b.c AS case_id, CASE WHEN jv.n IS NULL THEN 'deterministic_tree' ELSE 'hybrid' END AS mode, coalesce((SELECT string_agg(coalesce(now, '-') || ' ' || state, '|' ORDER BY pos) FROM j WHERE j.c = b.c), '') AS items, a.answer, CASE WHEN b.c % 3 > 0 THEN (a.answer IS NOT NULL)::BIGINT END AS n_answered, CASE WHEN b.c % 3 > 0 AND b.c % 7 = 1 AND a.question IS NOT NULL THEN 'answers are not as asked for' END AS refused
FROM b LEFT JOIN jv ON jv.c = b.c LEFT JOIN a ON a.c = b.c""")
def change_cases_replied(spark, sf):
    r = _replied(spark, sf)
    s = r.state
    rows = s.cases.select("case_id", "mode")
    tables = (
        (_listed(s.items, F.concat_ws(" ", F.coalesce("after_value", F.lit("-")), "status"), "pos", "said"), "_said"),
        (s.questions.select(F.col("case_id").alias("_q"), "answer"), "_q"),
        (r.merged.withColumnRenamed("case_id", "_m"), "_m"),
        (r.quarantine.select(F.col("case_id").alias("_r"), F.col("error").alias("refused")), "_r"),
    )
    for df, key in tables:
        rows = rows.join(df, F.col("case_id") == F.col(key), "left")
    return rows.select("case_id", "mode", F.coalesce(F.array_join("said", "|"), F.lit("")).alias("items"), "answer", "n_answered", "refused")


@query(f"""{OPENED}, z AS (SELECT c, string_agg('- ' || upper(action) || ' ' || label || ': ' || coalesce(was, '(not cited)') || ' -> ' || coalesce(v, '(pending)'), chr(10) ORDER BY pos) AS ch, string_agg('- ' || id || ': endorsement=likely, carrierApproval=likely', chr(10) ORDER BY pos) AS im,
  string_agg('- ' || label || ': ' || coalesce(v, action), chr(10) ORDER BY pos) FILTER (status = 'ready') AS rd, count(cited) AS n_cited, string_agg('"' || id || '"', ',' ORDER BY pos) AS names FROM i GROUP BY c),
y AS (SELECT o.c, k.kind, coalesce(n_cited, 0) AS n_cited, coalesce(names, '') AS names, '["' || o.c || '","' || k.kind || '"]' AS x, CASE k.kind WHEN 'underwriter_summary' THEN concat_ws(chr(10), summary, '', ch, '', 'Impact analysis:', im) WHEN 'carrier_email' THEN concat_ws(chr(10), 'Please process the following policy change endorsement request:', '', rd)
  WHEN 'missing_info_request' THEN coalesce('- ' || q.question, 'No missing information questions are open.') WHEN 'json_packet' THEN o.c || ' ' || n_items || ' ' || n_sources ELSE coalesce((SELECT string_agg('- [blocking] ' || code || ': ' || m, chr(10) ORDER BY pos) FROM v WHERE v.c = o.c), 'No validation issues.') END AS content
  FROM o CROSS JOIN (SELECT unnest(['underwriter_summary', 'carrier_email', 'missing_info_request', 'json_packet', 'validation_report']) AS kind) k LEFT JOIN z ON z.c = o.c LEFT JOIN q ON q.c = o.c),
w AS (SELECT c, kind, n_cited, content, 'artifact-' || substr({CASE_DIGEST}, 1, 12) AS artifact_id, '["' || c || '",1700000000000,[' || names || ']]' AS y FROM y), u AS (SELECT * EXCLUDE (y), y AS x FROM w)
SELECT c AS case_id, 'packet-' || substr({CASE_DIGEST}, 1, 12) AS packet_id, artifact_id, kind, content, CASE WHEN kind IN ('missing_info_request', 'validation_report') THEN 0 ELSE n_cited END AS n_citations FROM u""")
def change_case_packets(spark, sf):
    made = D.packets(opened(spark, sf), F.lit(1_700_000_000_000))
    n = lambda path: F.size(F.from_json(F.get_json_object("content", path), "array<variant>"))
    told = F.concat_ws(" ", F.get_json_object("content", "$.caseId"), n("$.items"), n("$.evidenceSourceIds"))
    return made.select("case_id", "packet_id", "artifact_id", "kind", F.when(F.col("kind") == "json_packet", told).otherwise(F.col("content")).alias("content"), F.size("citations").cast("long").alias("n_citations"))
