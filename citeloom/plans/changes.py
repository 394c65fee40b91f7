"""Queries of policy changes, codes and budgets."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import budget as B
from ..functions import codes as K
from ..functions import text as T
from ..operators import changes as C
from ..sources.scratch import spread
from .queries import _t, query

CASES = r"""i AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey::VARCHAR AS item_id, CASE o_orderkey % 5 WHEN 0 THEN 'limit_change' WHEN 1 THEN 'cancellation' WHEN 2 THEN 'coverage_change' WHEN 3 THEN 'certificate_endorsement_request' ELSE 'general_endorsement' END AS kind,
  CASE o_orderkey % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' ELSE 'update' END AS action, CASE WHEN o_orderkey % 7 = 0 THEN 'needs_info' ELSE 'ready' END AS status, CASE WHEN o_orderkey % 6 = 0 THEN 'holder with waiver wording' ELSE 'Change' END AS label,
  CASE WHEN o_orderkey % 2 = 0 THEN 'limit of ' || o_orderkey % 10 END AS was, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'v' END AS after_value, CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'soon' WHEN 2 THEN '13/01/2024' ELSE '0' || (1 + o_orderkey % 9) || '/15/2024' END AS day,
  CASE WHEN o_orderkey % 8 > 2 THEN make_date(2024, (1 + o_orderkey % 9)::INT, 15) END AS dt, o_orderkey % 3 <> 0 AS cited, CASE o_orderkey % 4 WHEN 0 THEN 'gone' WHEN 2 THEN 's' || o_orderkey END AS qs FROM orders),
s AS (SELECT o_custkey AS c, o_orderkey AS k, 's' || o_orderkey AS id, CASE WHEN o_orderkey % 5 = 1 THEN 'Endorsement 2' ELSE 'Page' END AS label, CASE WHEN o_orderkey % 3 = 1 THEN 'the limit of ' || o_orderkey % 10 || ' applies' WHEN o_orderkey % 9 = 2 THEN 'policy period 03/01/2024 to 06/30/2024' ELSE 'flood not covered' END AS text, o_orderkey % 20 = 0 AS dated FROM orders),
p AS (SELECT c, arg_min(a, k) AS a, arg_min(z, k) AS z, arg_min(id, k) AS id FROM (SELECT c, k, id, CASE WHEN dated THEN DATE '2024-01-01' ELSE DATE '2024-03-01' END AS a, CASE WHEN dated THEN DATE '2024-12-31' ELSE DATE '2024-06-30' END AS z FROM s WHERE dated OR text LIKE 'policy period%') GROUP BY c),
v AS (SELECT c, item_id, CASE WHEN qs IS NULL THEN 'missing_citation' WHEN qs = 'gone' THEN 'unknown_source' ELSE 'quote_not_found' END AS code, 'blocking' AS severity, qs AS source_id FROM i WHERE was IS NOT NULL AND (qs IS NULL OR qs = 'gone' OR k % 3 <> 1)
UNION ALL SELECT c, item_id, 'existing_value_missing_source_span', 'blocking', NULL FROM i WHERE was IS NOT NULL AND NOT cited
UNION ALL SELECT c, item_id, 'required_value_missing', 'blocking', NULL FROM i WHERE status = 'needs_info' OR (after_value IS NULL AND action <> 'remove')
UNION ALL SELECT c, item_id, 'coverage_source_missing', 'blocking', NULL FROM i WHERE kind = 'coverage_change' AND action <> 'add' AND NOT cited
UNION ALL SELECT c, item_id, 'effective_date_unparseable', 'warning', NULL FROM i WHERE day IS NOT NULL AND dt IS NULL
UNION ALL SELECT i.c, item_id, 'effective_date_outside_policy_period', 'blocking', p.id FROM i JOIN p ON i.c = p.c WHERE dt < a OR dt > z
UNION ALL SELECT i.c, item_id, 'endorsement_conflict', 'blocking', s.id FROM i JOIN s ON i.k = s.k WHERE cited AND s.label = 'Endorsement 2' AND text = 'flood not covered'
UNION ALL SELECT c, item_id, 'notice_rule_ambiguous', 'blocking', NULL FROM i WHERE kind = 'cancellation' AND (day IS NULL OR NOT cited)
UNION ALL SELECT c, item_id, 'certificate_details_missing', 'blocking', NULL FROM i WHERE kind = 'certificate_endorsement_request' AND label = 'Change')"""


def _items(spark, sf):
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("limit_change", "cancellation", "coverage_change", "certificate_endorsement_request", "general_endorsement"))), (k % 5 + 1).cast("int"))
    none = F.lit(None).cast("string")
    was = F.when(k % 2 == 0, F.concat(F.lit("limit of "), k % 10))
    items = _t(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), k.alias("pos"), k.cast("string").alias("item_id"), kind.alias("kind"), F.when(k % 4 == 0, "add").when(k % 4 == 1, "remove").otherwise("update").alias("action"), F.when(k % 7 == 0, "needs_info").otherwise("ready").alias("status"), F.when(k % 6 == 0, "holder with waiver wording").otherwise("Change").alias("label"), none.alias("reason"), F.concat(F.lit("p"), k % 3).alias("field_path"), was.alias("before_value"), F.when(k % 3 != 0, "v").alias("after_value"), none.alias("requested_value"), F.when(k % 8 == 0, None).when(k % 8 == 1, "soon").when(k % 8 == 2, "13/01/2024").otherwise(F.concat(F.lit("0"), 1 + k % 9, F.lit("/15/2024"))).alias("effective_date"), F.when(k % 3 != 0, F.array(F.concat(F.lit("s"), k))).otherwise(F.array().cast("array<string>")).alias("source_span_ids"), F.array().cast("array<string>").alias("source_ids"), was.alias("quote"), F.when(k % 4 == 0, "gone").when(k % 4 == 2, F.concat(F.lit("s"), k)).alias("quoted_source"), F.lit("high").alias("confidence"))
    text = F.when(k % 3 == 1, F.concat(F.lit("the limit of "), k % 10, F.lit(" applies"))).when(k % 9 == 2, "policy period 03/01/2024 to 06/30/2024").otherwise("flood not covered")
    sources = _t(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), k.alias("pos"), F.concat(F.lit("s"), k).alias("source_id"), F.when(k % 5 == 1, "Endorsement 2").otherwise("Page").alias("label"), text.alias("text"), F.when(k % 20 == 0, "01/01/2024").alias("starts"), F.when(k % 20 == 0, "12-31-24").alias("ends"), none.alias("field_path"), none.alias("form_number"))
    return items, sources


@query(f"WITH {CASES} SELECT c AS case_id, item_id, code, severity, source_id FROM v")
def change_validation(spark, sf):
    return C.validate(*_items(spark, sf))


@query(f"WITH {CASES} SELECT c AS case_id, epoch_ms(a::TIMESTAMP) AS start, epoch_ms(z::TIMESTAMP) AS stop, id AS source_id FROM p")
def policy_periods(spark, sf):
    return C.policy_periods(_items(spark, sf)[1])


FLAGS = f"""WITH {CASES}, n AS (SELECT c, label, count(DISTINCT CASE WHEN k % 3 = 1 THEN (k % 10)::VARCHAR WHEN text LIKE 'policy%' THEN 'x' END) AS n FROM s GROUP BY ALL),
f AS (SELECT c_custkey AS c, c_custkey IN (SELECT c FROM v WHERE severity = 'blocking') AS blocking, c_custkey IN (SELECT c FROM n WHERE n > 1) AS conflicting, c_custkey IN (SELECT c FROM i WHERE kind = 'certificate_endorsement_request' AND (status = 'needs_info' OR after_value IS NULL OR NOT cited OR k % 11 = 0)) AS unclear FROM customer)"""


@query(f"{FLAGS} SELECT c AS case_id, blocking, conflicting, unclear FROM f")
def change_case_flags(spark, sf):
    return _flags(spark, sf).select("case_id", "blocking", "conflicting", "unclear")


def _flags(spark, sf):
    items, sources = _items(spark, sf)
    cases = _t(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_custkey") % 50 == 0, "market_eval").otherwise("auto").alias("requested"), F.lit("please").alias("request_text"))
    questions = items.where(F.col("pos") % 11 == 0).select("case_id", "item_id", F.lit(None).cast("string").alias("field_path"))
    return C.case_flags(cases, items, sources, questions, C.validate(items, sources))


@query(f"{FLAGS} SELECT c AS case_id, CASE WHEN c % 50 = 0 THEN 'market_eval' WHEN blocking OR conflicting OR unclear THEN 'hybrid' ELSE 'deterministic_tree' END AS mode FROM f")
def change_modes_computed(spark, sf):
    items, sources = _items(spark, sf)
    return C.execution_modes(_flags(spark, sf), C.impacts(items, sources))


@query(f"""WITH {CASES}, q AS (SELECT c, count(*) AS n FROM i WHERE status = 'needs_info' AND k % 2 = 0 GROUP BY c), b AS (SELECT c, count(*) FILTER (severity = 'blocking') AS b, count(*) FILTER (severity = 'warning') AS w FROM v GROUP BY c), u AS (SELECT c, count(*) AS n FROM i WHERE was IS NOT NULL AND NOT cited GROUP BY c)
SELECT c_custkey AS case_id, coalesce(b, 0) AS n_blocking, coalesce(w, 0) AS n_warning, coalesce(q.n, 0) AS n_missing, coalesce(u.n, 0) AS n_ungrounded, CASE WHEN coalesce(b, 0) > 0 OR coalesce(u.n, 0) > 0 THEN 'failed' WHEN coalesce(w, 0) > 0 OR coalesce(q.n, 0) > 0 THEN 'warning' ELSE 'passed' END AS status
FROM customer LEFT JOIN q ON q.c = c_custkey LEFT JOIN b ON b.c = c_custkey LEFT JOIN u ON u.c = c_custkey""")
def change_quality(spark, sf):
    items, sources = _items(spark, sf)
    return C.quality(_t(spark, sf, "customer").select(F.col("c_custkey").alias("case_id")), items, _questions(items), C.validate(items, sources))


def _questions(items):
    return items.where("status = 'needs_info'").select("case_id", "pos", F.concat(F.lit("q"), "item_id").alias("question_id"), F.when(F.col("pos") % 3 != 0, F.col("item_id")).alias("item_id"), "field_path", F.concat(F.lit("What of "), "item_id", F.lit("?")).alias("question"), F.when(F.col("pos") % 2 == 1, F.concat(F.lit(" a"), "pos")).alias("answer"))


@query(f"""WITH {CASES}, q AS (SELECT c, k, CASE WHEN k % 3 <> 0 THEN item_id END AS item_id, 'p' || k % 3 AS path, 'a' || k AS a FROM i WHERE status = 'needs_info' AND k % 2 = 1),
m AS (SELECT i.c, i.item_id, arg_max(a, q.k) AS a FROM i JOIN q ON i.c = q.c AND (q.item_id = i.item_id OR (q.item_id IS NULL AND q.path = 'p' || i.k % 3)) GROUP BY ALL)
SELECT i.item_id, coalesce(after_value, a) AS after_value, a AS requested_value, CASE WHEN a IS NOT NULL AND status = 'needs_info' THEN 'ready' ELSE status END AS status FROM i LEFT JOIN m ON i.c = m.c AND i.item_id = m.item_id""")
def missing_info_answers(spark, sf):
    items, _ = _items(spark, sf)
    return C.fill_from_answers(items, _questions(items)).select("item_id", "after_value", "requested_value", "status")


@query(f"WITH {CASES}, q AS (SELECT c, count(*) AS n, min('q' || item_id) AS q FROM i WHERE status = 'needs_info' AND k % 2 = 0 GROUP BY c) SELECT c AS case_id, q AS question_id, 'yes ' || c AS answer FROM q WHERE n = 1 AND c % 4 > 0")
def reply_to_open_question(spark, sf):
    items, _ = _items(spark, sf)
    k = F.col("c_custkey")
    replies = _t(spark, sf, "customer").select(k.alias("case_id"), F.when(k % 4 > 0, F.concat(F.lit(" yes "), k)).otherwise(" ").alias("text"))
    return C.reply_answers(replies, _questions(items))


@query(f"WITH {CASES}, q AS (SELECT c, string_agg('What of ' || item_id || '?', chr(10) ORDER BY k) AS m FROM i WHERE status = 'needs_info' AND k % 2 = 0 GROUP BY c) SELECT c_custkey AS case_id, coalesce(m, 'No missing information questions are open.') AS message FROM customer LEFT JOIN q ON c = c_custkey")
def next_message(spark, sf):
    items, _ = _items(spark, sf)
    return C.next_message(_questions(items), _t(spark, sf, "customer").select(F.col("c_custkey").alias("case_id")))


@query(f"""WITH {CASES}, t AS (SELECT c, string_agg('- ' || upper(action) || ' ' || label || ': ' || coalesce(was, '(not cited)') || ' -> ' || coalesce(after_value, '(pending)'), chr(10) ORDER BY k) AS ch,
  string_agg('- ' || item_id || ': endorsement=likely, carrierApproval=' || CASE WHEN k % 5 = 3 THEN 'not expected' ELSE 'likely' END, chr(10) ORDER BY k) AS im, string_agg('- ' || label || ': ' || coalesce(after_value, action), chr(10) ORDER BY k) FILTER (status = 'ready') AS rd,
  string_agg('- What of ' || item_id || '?', chr(10) ORDER BY k) FILTER (status = 'needs_info' AND k % 2 = 0) AS op FROM i GROUP BY c)
SELECT c_custkey AS case_id, concat_ws(chr(10), 'S' || c_custkey, '', ch, '', 'Impact analysis:', im) AS underwriter_summary, concat_ws(chr(10), 'Please process the following policy change endorsement request:', '', rd) AS carrier_email, coalesce(op, 'No missing information questions are open.') AS missing_info_request, 'No validation issues.' AS validation_report FROM customer LEFT JOIN t ON c = c_custkey""")
def change_packets(spark, sf):
    items, sources = _items(spark, sf)
    cases = _t(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), F.concat(F.lit("S"), "c_custkey").alias("summary"))
    none = items.limit(0).select("case_id", "pos", F.lit("").alias("severity"), F.lit("").alias("code"), F.lit("").alias("message"))
    return C.packet_texts(cases, items, C.impacts(items, sources), _questions(items), none)


@query("""WITH r AS (SELECT c_custkey AS c, CASE c_custkey % 4 WHEN 0 THEN 'Please add a vehicle. Change from "' || c_mktsegment || '" to BMW; now 1/2/24' WHEN 1 THEN 'Remove driver' WHEN 2 THEN 'Raise the limit to "' || c_custkey || '"' ELSE 'cancel it' END AS t, '"' || c_mktsegment || '"' AS q, c_mktsegment AS m FROM customer),
s AS (SELECT o_custkey AS c, min(o_orderkey) AS k FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT r.c AS case_id, CASE r.c % 4 WHEN 1 THEN 'remove' WHEN 0 THEN 'add' ELSE 'update' END AS action, CASE r.c % 4 WHEN 0 THEN 'vehicle_change' WHEN 1 THEN 'vehicle_change' WHEN 2 THEN 'limit_change' ELSE 'cancellation' END AS kind,
  CASE r.c % 4 WHEN 0 THEN 'auto.vehicles' WHEN 1 THEN 'auto.drivers' WHEN 2 THEN 'coverage.limit' ELSE 'policy.change' END AS field_path, CASE r.c % 4 WHEN 0 THEN 'Please add a vehicle' ELSE t END AS label, CASE WHEN r.c % 4 = 0 AND s.k IS NOT NULL THEN m END AS before_value,
  CASE WHEN r.c % 4 = 0 AND s.k IS NOT NULL THEN s.k::VARCHAR END AS source_id, CASE r.c % 4 WHEN 0 THEN 'BMW' WHEN 2 THEN r.c::VARCHAR END AS requested_value, CASE WHEN r.c % 4 = 0 THEN '1/2/24' END AS effective_date, coalesce('d' || s.k, 'unknown') AS policy_id, r.c % 4 IN (1, 3) AS asks FROM r LEFT JOIN s ON r.c = s.c""")
def change_requests(spark, sf):
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.concat(F.lit('Please add a vehicle. Change from "'), "c_mktsegment", F.lit('" to BMW; now 1/2/24'))).when(k % 4 == 1, "Remove driver").when(k % 4 == 2, F.concat(F.lit('Raise the limit to "'), k, F.lit('"'))).otherwise("cancel it")
    requests = _t(spark, sf, "customer").select(k.alias("case_id"), text.alias("text"), "c_mktsegment")
    o = _t(spark, sf, "orders").join(requests.select(F.col("case_id").alias("_c"), "c_mktsegment"), F.col("o_custkey") == F.col("_c"))
    sources = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("source_id"), F.concat(F.lit("of "), F.lower("c_mktsegment")).alias("text"), F.concat(F.lit("d"), "o_orderkey").alias("document_id"))
    return C.request_items(requests.drop("c_mktsegment"), sources)


HASH2 = "(list_reduce(list_prepend({seed}::HUGEINT, list_transform(string_split(x, ''), lambda c, i: {unit}::HUGEINT)), lambda h, u: ((xor(h, u) & 4294967295) * {factor}::HUGEINT) % 4294967296))::BIGINT"
CASE_DIGEST = "lower(printf('%08x', {})) || lower(printf('%08x', {}))".format(HASH2.format(seed=0x811C9DC5, factor=0x01000193, unit="unicode(c)"), HASH2.format(seed=0x9E3779B9, factor=0x85EBCA6B, unit="(unicode(c) + i - 1)"))


@query(f"""WITH t AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS given, o_orderkey % 3 = 0 AS plain FROM orders), u AS (SELECT *, 'limit_change' AS kind, CASE WHEN given THEN 'v' || k % 7 ELSE '' END AS a, CASE WHEN plain THEN 's1|s2' ELSE 's' || k % 5 END AS ids, CASE WHEN given THEN 'ready' ELSE 'needs_info' END AS status FROM t),
x AS (SELECT *, '["unknown","limit_change","coverage.limit","' || a || '","' || ids || '"]' AS x FROM u) SELECT k AS pos, kind, status, 'pci-' || substr({CASE_DIGEST}, 1, 12) AS item_id FROM x""")
def finalised_items(spark, sf):
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    rows = _t(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), k.alias("pos"), none.alias("kind"), F.lit("coverage.limit").alias("field_path"), none.alias("status"), F.when(k % 2 == 0, F.concat(F.lit("v"), k % 7)).alias("after_value"), none.alias("requested_value"), F.lit("update").alias("action"), none.alias("policy_id"), F.when(k % 3 != 0, F.array(F.concat(F.lit("s"), k % 5))).alias("source_span_ids"), F.array(F.lit("s2"), F.lit("s1"), F.lit("s2")).alias("cited_ids"), F.lit("raise").alias("request_text"))
    return C.finalise(rows).select("pos", "kind", "status", "item_id")


@query("""WITH g AS (SELECT c_custkey AS c, 'x' AS id, 'given' AS t, 0 AS p FROM customer), r AS (SELECT o_custkey AS c, CASE WHEN o_orderkey % 9 = 0 THEN 'x' ELSE 's' || o_orderkey END AS id, o_orderkey::VARCHAR AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, CASE WHEN o_orderkey % 9 = 0 THEN 'x' ELSE 's' || o_orderkey END) AS p FROM orders),
u AS (SELECT * FROM g UNION ALL SELECT * FROM r WHERE p <= 3) SELECT c AS case_id, id AS source_id, arg_max(t, p) AS text FROM u GROUP BY c, id""")
def collected_evidence(spark, sf):
    given = _t(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), F.lit("x").alias("source_id"), F.lit("given").alias("text"))
    k = F.col("o_orderkey")
    found = _t(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.when(k % 9 == 0, "x").otherwise(F.concat(F.lit("s"), k)).alias("source_id"), k.cast("string").alias("text"), F.col("o_totalprice").alias("relevance"))
    return C.collect_evidence(given, found, 3)


WORDS = ("General Liability", "flood and earthquake", "Farm property", "D&O cover", "nothing", "Long-term care", "HO-3 homeowners")


@query("""WITH t AS (SELECT p_partkey, p_partkey % 7 AS k FROM part) SELECT p_partkey, CASE k WHEN 0 THEN 'CGL' WHEN 1 THEN 'FLOOD,EQ' WHEN 2 THEN 'PROP,CFRM' WHEN 3 THEN 'DO' WHEN 4 THEN '' WHEN 5 THEN 'UN' ELSE 'HOME' END AS codes FROM t""")
def lines_of_text(spark, sf):
    text = F.concat("p_name", F.lit(" with  "), F.element_at(F.array(*map(F.lit, WORDS)), (F.col("p_partkey") % 7 + 1).cast("int")))
    return spread(_t(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey").select("p_partkey", F.array_join(K.lines_of_text(text), ",").alias("codes"))


def _tables(spark):
    labels = spark.createDataFrame([("CGL", "General Liability"), ("PROP", "Property"), ("UN", "Unknown")], "code string, label string")
    legacy = spark.createDataFrame([("old_pack", ["PROP", "CGL"])], "name string, codes array<string>")
    old = spark.createDataFrame([("GL1", "CGL")], "code string, now string")
    return labels, legacy, old


@query("""SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'CGL' WHEN 1 THEN 'CGL' WHEN 2 THEN 'PROP,CGL' WHEN 3 THEN 'PROP' WHEN 4 THEN 'CGL' WHEN 5 THEN 'UN' WHEN 6 THEN 'UN' ELSE 'PROP,CGL' END AS codes FROM part""")
def resolved_lines(spark, sf):
    some = [["CGL"], [" general  LIABILITY"], ["Old & Pack".replace(" & ", "-")], ["prop", "zzz"], ["gl1"], [], ["?", " "], ["Property", "CGL", "PROP"]]
    values = F.element_at(F.array(*(F.array(*map(F.lit, v)) if v else F.array().cast("array<string>") for v in some)), (F.col("p_size") % 8 + 1).cast("int"))
    rows = K.resolve_lines(_t(spark, sf, "part").withColumn("v", values), "p_partkey", "v", *_tables(spark))
    return rows.select("p_partkey", F.array_join("codes", ",").alias("codes"))


@query("WITH t AS (SELECT p_partkey AS k, CASE p_size % 4 WHEN 0 THEN NULL ELSE 'B' || p_size % 4 END AS code, p_name AS d FROM part), c AS (SELECT DISTINCT p_type AS code, p_name AS d FROM part), o AS (SELECT d, min(code) AS code, count(DISTINCT code) AS n FROM c GROUP BY d) SELECT k AS p_partkey, CASE WHEN t.code = 'B1' THEN 'B1' WHEN n = 1 THEN o.code END AS resolved FROM t LEFT JOIN o ON t.d = o.d")
def resolved_coverage_codes(spark, sf):
    parts = _t(spark, sf, "part")
    table = parts.select(F.col("p_type").alias("code"), F.concat(F.lit(" "), F.upper("p_name"), F.lit("!")).alias("description")).unionByName(spark.createDataFrame([("B1", "none of these")], "code string, description string"))
    rows = parts.select("p_partkey", F.when(F.col("p_size") % 4 > 0, F.concat(F.lit(" b"), F.col("p_size") % 4)).alias("code"), F.col("p_name").alias("description"))
    return K.resolve_coverage(rows, "code", "description", table).select("p_partkey", "resolved")


@query("SELECT p_partkey, p_size % 3 = 0 AS is_code, CASE p_size % 3 WHEN 0 THEN 'General Liability' WHEN 1 THEN 'Old McPack Two' ELSE '' END AS label FROM part")
def line_labels(spark, sf):
    rows = _t(spark, sf, "part").withColumn("v", F.when(F.col("p_size") % 3 == 0, " CGL").when(F.col("p_size") % 3 == 1, "old_mcPack-two").otherwise(""))
    rows = rows.withColumn("v", F.replace("v", F.lit("mcPack"), F.lit("McPack")))
    return K.line_label(rows, "v", _tables(spark)[0]).select("p_partkey", "is_code", "label")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 1 THEN 'CGL' WHEN p_size % 4 = 2 THEN 'UN' ELSE 'PROP' END AS lines, CASE p_size % 4 WHEN 0 THEN 'profile_hint' WHEN 1 THEN 'coverage' WHEN 2 THEN 'default' ELSE 'existing_hint' END AS source FROM part""")
def profile_line_sources(spark, sf):
    k = F.col("p_size") % 4
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    made = K.resolve_profile(F.when(k == 1, a("CGL")).otherwise(a()), F.when(k == 0, a("PROP")).otherwise(a("UN")), F.when(k == 3, a("PROP")).otherwise(a("UN")))
    return _t(spark, sf, "part").select("p_partkey", made.alias("m")).select("p_partkey", F.array_join("m.lines", ",").alias("lines"), "m.source")


@query("""WITH t AS (SELECT p_partkey AS k, p_size AS z, p_size % 2 = 0 AS long, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 100 END AS hint, CASE WHEN p_size % 7 = 0 THEN 3000 END AS con, CASE WHEN p_size % 3 = 0 THEN 2500 END AS task, CASE WHEN p_size % 4 = 0 THEN 9000 END AS ll FROM part),
p AS (SELECT *, coalesce(hint, 4096) AS h, coalesce(con, task, CASE WHEN long THEN ll END, hint, 4096) AS pref FROM t), w AS (SELECT *, greatest(pref, 1000) AS wanted, least(greatest(pref, 1000), 6000) AS held, least(greatest(pref, 1000), 6000, CASE WHEN z % 6 = 0 THEN 2000 ELSE 5000 END) AS final, greatest(ceil(ceil(z * 100 / 4.0) * 1.5), z * CASE WHEN long THEN 90 ELSE 45 END, floor(h * 0.75)) AS fl FROM p)
SELECT k AS p_partkey, pref::BIGINT AS preferred, final::BIGINT AS max_tokens, wanted > 6000 AS capped_by_model, held > CASE WHEN z % 6 = 0 THEN 2000 ELSE 5000 END AS capped_hard, CASE WHEN final < fl * 0.65 THEN 'high' WHEN final < fl THEN 'medium' ELSE 'low' END AS risk, ceil(z * 1000 / 4.0) > 8000 * 0.9 AS input_near_limit FROM w""")
def model_budget(spark, sf):
    z = F.col("p_size")
    made = B.resolve(z % 2 == 0, F.when(z % 5 != 0, z * 100), F.when(z % 7 == 0, 3000), F.when(z % 3 == 0, 2500).when(z % 3 == 1, -1), F.when(z % 4 == 0, 9000), F.lit(1000), F.lit(6000), F.when(z % 6 == 0, 2000), F.lit(5000), z * 1000, z * 100, z, F.lit(8000))
    rows = _t(spark, sf, "part").select("p_partkey", made.alias("m")).select("p_partkey", "m.*")
    return rows.withColumns({c: F.col(c).cast("long") for c in ("preferred", "max_tokens")})


@query(f"SELECT p_partkey, {CASE_DIGEST} AS hash FROM (SELECT p_partkey, p_name || p_type AS x FROM part)")
def case_hash(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", T.case_hash(F.concat("p_name", "p_type")).alias("hash"))


