"""Queries of reviews and of the application workflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import application as A
from ..operators import review as R
from ..operators import trees
from .queries import HASH, _t, query

ANSWERS = """a AS (SELECT doc_id % 50 AS q, doc_id AS a, CASE doc_id % 4 WHEN 0 THEN 'in 30 days' ELSE 'plain' END AS answer, doc_id % 4 = 0 AS claim, (doc_id % 10) / 10.0::DOUBLE AS confidence, doc_id % 5 = 0 AS more FROM documents),
c AS (SELECT doc_id % 50 AS q, doc_id AS a, doc_id % 2 AS idx, CASE doc_id % 3 WHEN 0 THEN '5 days' WHEN 1 THEN 'limit' ELSE 'zzz' END AS quote, doc_id % 3 < 2 AS claim, CASE WHEN doc_id % 2 = 0 THEN 's' || doc_id % 7 WHEN doc_id % 4 = 1 THEN 'c' || doc_id % 7 ELSE 'd' || doc_id % 7 END AS k FROM labels),
e AS (SELECT item_id % 50 AS q, item_id % 3 AS src, CASE item_id % 3 WHEN 0 THEN 's' WHEN 1 THEN 'c' ELSE 'd' END || item_id % 7 AS k, CASE WHEN item_id % 2 = 0 THEN 'has 5 days and limit' ELSE 'other' END AS t FROM benchmark),
j AS (SELECT c.q, c.a, c.idx, c.k, c.quote, c.claim, count(e.k) > 0 AS found, coalesce(bool_or(contains(t, quote)), false) AS quoted, coalesce(bool_or(src < 2), false) AS grounded FROM c LEFT JOIN e ON c.q = e.q AND c.k = e.k GROUP BY ALL)"""


def _review(spark, sf):
    d = F.col("doc_id")
    null = F.lit(None).cast("string")
    answers = _t(spark, sf, "documents").select((d % 50).alias("query_id"), d.alias("answer_id"), F.when(d % 4 == 0, "in 30 days").otherwise("plain").alias("answer"), ((d % 10) / 10.0).alias("confidence"), (d % 5 == 0).alias("needs_more"))
    no = (d % 7).cast("string")
    citations = _t(spark, sf, "labels").select((d % 50).alias("query_id"), d.alias("answer_id"), (d % 2).cast("int").alias("idx"), F.when(d % 3 == 0, "5 days").when(d % 3 == 1, "limit").otherwise("zzz").alias("quote"), F.when(d % 2 == 0, F.concat(F.lit("s"), no)).when(d % 3 == 0, "").alias("span_id"), F.when(d % 4 == 1, F.concat(F.lit("c"), no)).alias("chunk_id"), F.concat(F.lit("d"), no).alias("document_id"))
    i = F.col("item_id")
    no = (i % 7).cast("string")
    evidence = _t(spark, sf, "benchmark").select((i % 50).alias("query_id"), F.when(i % 3 == 0, "source_span").when(i % 3 == 1, "chunk").otherwise("source_node").alias("source"), F.when(i % 3 == 0, F.concat(F.lit("s"), no)).alias("span_id"), F.when(i % 3 == 1, F.concat(F.lit("c"), no)).alias("chunk_id"), F.when(i % 3 == 2, F.concat(F.lit("d"), no)).alias("document_id"), null.alias("turn_id"), null.alias("attachment_id"), F.when(i % 2 == 0, "has 5 days and limit").otherwise("other").alias("text"))
    q = F.col("query_id")
    finals = answers.select("query_id").distinct().select("query_id", F.when(q % 9 == 0, " ").otherwise("said").alias("answer"), ((q % 10) / 10.0).alias("confidence"))
    final_citations = citations.where(F.col("answer_id") % 6 == 0).select("query_id", F.when(F.col("answer_id") % 4 == 0, 7).otherwise(F.col("idx")).alias("idx"), "span_id", "chunk_id", "document_id", "quote")
    return answers, citations, evidence, finals, final_citations


REVIEW = f"""WITH {ANSWERS}, n AS (SELECT a.*, a.a NOT IN (SELECT a FROM c) AS bare FROM a), f AS (SELECT DISTINCT q FROM a), fc AS (SELECT q, CASE WHEN a % 4 = 0 THEN 7 ELSE idx END AS idx, k, a FROM c WHERE a % 6 = 0),
i AS (SELECT q, a, NULL::INT AS idx, NULL::VARCHAR AS k, 'subanswer_missing_citations' AS code, 'blocking' AS severity FROM n WHERE bare AND NOT more
UNION ALL SELECT q, a, NULL, NULL, 'subanswer_high_confidence_without_citations', 'blocking' FROM n WHERE bare AND confidence >= 0.85
UNION ALL SELECT q, a, idx, k, 'citation_missing_from_evidence', 'blocking' FROM j WHERE NOT found
UNION ALL SELECT q, a, idx, k, 'citation_quote_not_in_evidence', 'warning' FROM j WHERE found AND NOT quoted
UNION ALL SELECT q, a, idx, k, 'citation_claim_lacks_chunk_or_source_span', 'blocking' FROM j WHERE found AND NOT grounded AND claim
UNION ALL SELECT q, NULL, NULL, NULL, 'final_answer_missing_citations', 'blocking' FROM f WHERE q % 9 <> 0 AND (q % 10) / 10.0 > 0.4 AND q NOT IN (SELECT q FROM fc)
UNION ALL SELECT q, NULL, idx, k, 'final_answer_unknown_citation', 'warning' FROM fc WHERE idx = 7)"""


@query(f"{REVIEW} SELECT q AS query_id, a AS answer_id, idx::INT AS idx, k AS source_id, code, severity FROM i")
def query_review(spark, sf):
    return R.query_review(*_review(spark, sf))


@query(f"{REVIEW} SELECT f.q AS query_id, CASE WHEN bool_or(severity = 'blocking') THEN 'failed' WHEN bool_or(severity = 'warning') OR f.q % 8 = 0 THEN 'warning' ELSE 'passed' END AS status FROM f LEFT JOIN i ON f.q = i.q GROUP BY f.q")
def query_gate(spark, sf):
    parts = _review(spark, sf)
    rounds = parts[3].select("query_id", (F.col("query_id") % 16 != 0).alias("approved"), F.when(F.col("query_id") % 16 == 8, 1).otherwise(0).alias("n_issues"))
    return R.status(R.query_review(*parts), parts[0], "query_id", rounds)


@query(f"WITH {ANSWERS} SELECT q AS query_id, a AS answer_id FROM a WHERE NOT more AND claim AND a NOT IN (SELECT a FROM c) UNION SELECT q, a FROM j WHERE claim AND NOT grounded")
def answers_to_retry(spark, sf):
    answers, citations, evidence, _, _ = _review(spark, sf)
    return R.to_retry(answers, citations, evidence)


@query(f"WITH {ANSWERS} SELECT q AS query_id, least(1, min(confidence)) AS confidence FROM a GROUP BY q")
def query_confidence(spark, sf):
    return R.query_confidence(_review(spark, sf)[0])


FIELDS = """f AS (SELECT c_nationkey AS app_id, c_custkey AS pos, 'f' || c_custkey % 97 AS id, CASE c_custkey % 5 WHEN 0 THEN 'Premium Total' WHEN 1 THEN 'Notes' WHEN 2 THEN 'Nick' WHEN 3 THEN 'Effective ' ELSE 'Hobbies of all' END AS label, c_mktsegment AS section,
  CASE c_custkey % 7 WHEN 0 THEN 'date' WHEN 1 THEN 'table' ELSE 'text' END AS field_type, c_custkey % 3 = 0 AS required, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'v' || c_custkey END AS value,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ' Unknown ' WHEN 2 THEN 'the Policy page' WHEN 3 THEN 'lookup: existing records' ELSE 'user' END AS source, CASE c_custkey % 5 WHEN 0 THEN 'low' WHEN 1 THEN NULL ELSE 'high' END AS confidence, c_custkey % 13 = 0 AS spans,
  CASE WHEN c_custkey % 8 = 0 THEN 'f' || c_custkey % 5 END AS depends_on, 'V7 ' AS when_value FROM customer)"""


def _fields(spark, sf):
    k = F.col("c_custkey")
    label = F.when(k % 5 == 0, "Premium Total").when(k % 5 == 1, "Notes").when(k % 5 == 2, "Nick").when(k % 5 == 3, "Effective ").otherwise("Hobbies of all")
    source = F.when(k % 6 == 0, None).when(k % 6 == 1, " Unknown ").when(k % 6 == 2, "the Policy page").when(k % 6 == 3, "lookup: existing records").otherwise("user")
    return _t(spark, sf, "customer").select(F.col("c_nationkey").alias("app_id"), k.alias("pos"), F.concat(F.lit("f"), k % 97).alias("id"), label.alias("label"), F.col("c_mktsegment").alias("section"), F.when(k % 7 == 0, "date").when(k % 7 == 1, "table").otherwise("text").alias("field_type"), (k % 3 == 0).alias("required"), F.when(k % 4 == 0, None).when(k % 4 == 1, "").otherwise(F.concat(F.lit("v"), k)).alias("value"), source.alias("source"), F.when(k % 5 == 0, "low").when(k % 5 == 1, None).otherwise("high").alias("confidence"), F.when(k % 13 == 0, F.array(F.lit("s"))).alias("source_span_ids"), F.array().cast("array<string>").alias("user_source_span_ids"), F.when(k % 8 == 0, F.concat(F.lit("f"), k % 5)).alias("depends_on"), F.lit("V7 ").alias("when_value"))


ISSUES = rf"""WITH {FIELDS}, g AS (SELECT *, coalesce(value <> '', false) AS had, row_number() OVER (PARTITION BY app_id, id ORDER BY pos) AS k, lower(coalesce(source, '')) AS s, lower(section || ' ' || label) AS w FROM f),
i AS (SELECT app_id, id, pos, 'duplicate_field_id' AS code, 'blocking' AS severity FROM g WHERE k > 1
UNION ALL SELECT app_id, id, pos, 'required_field_unfilled', 'warning' FROM g WHERE required AND NOT had
UNION ALL SELECT app_id, id, pos, 'filled_field_missing_source', 'blocking' FROM g WHERE had AND source IS NULL
UNION ALL SELECT app_id, id, pos, 'filled_field_vague_source', 'warning' FROM g WHERE had AND (source IS NULL OR trim(s) = 'unknown' OR contains(s, 'existing records'))
UNION ALL SELECT app_id, id, pos, 'filled_field_low_confidence', 'warning' FROM g WHERE had AND (confidence IS NULL OR confidence = 'low')
UNION ALL SELECT app_id, id, pos, 'policy_value_missing_source_span', 'blocking' FROM g WHERE had AND NOT spans AND regexp_matches(s, '\b(policy|lookup)\b') AND (regexp_matches(w, '\b(premium|effective)\b') OR field_type = 'date'))"""


@query(f"{ISSUES} SELECT * FROM i")
def application_review(spark, sf):
    return R.application_review(_fields(spark, sf))


@query("WITH " + FIELDS + " SELECT app_id, id, 'email_missing_field_prompt' AS code, 'warning' AS severity FROM f WHERE length(trim(label)) >= 6 AND NOT contains(CASE WHEN app_id % 2 = 0 THEN 'your premium total, please' ELSE 'effective when?' END, lower(trim(label)))")
def email_review(spark, sf):
    fields = _fields(spark, sf)
    emails = fields.select("app_id").distinct().select("app_id", F.when(F.col("app_id") % 2 == 0, "Your PREMIUM total, please").otherwise("Effective when?").alias("text"))
    return R.email_review(emails, fields)


ACTIVE = f"""{FIELDS}, v AS (SELECT app_id, id, arg_max(value, pos) AS v FROM f WHERE trim(value) <> '' GROUP BY ALL), w AS (SELECT f.*, lower(trim(coalesce(v.v, ''))) AS own, lower(trim(coalesce(u.v, ''))) AS other FROM f LEFT JOIN v ON f.app_id = v.app_id AND f.depends_on = v.id LEFT JOIN v u ON f.app_id = u.app_id AND u.id = 'f1'),
act AS (SELECT * FROM w WHERE (depends_on IS NULL OR own = 'v7') AND CASE right(id, 1) WHEN '1' THEN other <> '' WHEN '2' THEN other <> 'v98' WHEN '3' THEN other IN ('v98', '') WHEN '4' THEN other NOT IN ('v98', '') ELSE TRUE END)"""


def _active(spark, sf):
    fields = _fields(spark, sf)
    last = F.right("id", F.lit(1))
    nodes = fields.select("app_id", F.col("id").alias("field_id")).distinct().withColumn("id", F.col("field_id")).where(last.isin("1", "2", "3", "4"))
    op = F.when(last == "1", "exists").when(last == "2", "not_equals").when(last == "3", "in").otherwise("not_in")
    conditions = nodes.select("app_id", "field_id", F.lit("f1").alias("depends_on"), op.alias("op"), F.array(F.lit("V98"), F.lit(" ")).alias("expected"))
    return fields, A.active(fields, conditions)


@query(f"WITH {ACTIVE} SELECT app_id, pos FROM act")
def active_application_fields(spark, sf):
    return _active(spark, sf)[1].select("app_id", "pos")


@query(f"WITH {ACTIVE}, u AS (SELECT *, pos % 10 = 4 AND app_id % 3 = 0 AS now FROM act WHERE coalesce(value, '') = ''), b AS (SELECT DISTINCT app_id, id FROM f WHERE pos % 10 = 4 AND app_id % 3 = 0), x AS (SELECT u.app_id, u.id, u.pos, b.id IS NOT NULL AS now FROM u LEFT JOIN b ON u.app_id = b.app_id AND u.id = b.id), y AS (SELECT *, max(now) OVER (PARTITION BY app_id) AS any_now FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY pos) AS place FROM y WHERE now OR NOT any_now) SELECT app_id, id, place FROM z WHERE place <= 8")
def next_questions(spark, sf):
    fields, active = _active(spark, sf)
    return A.next_questions(active, fields.where("pos % 10 = 4 AND app_id % 3 = 0").select("app_id", "id"))


@query(f"WITH {FIELDS}, u AS (SELECT *, required OR contains(lower(label), 'premium') OR contains(lower(label), 'effective') AS w FROM f WHERE coalesce(trim(value), '') = ''), n AS (SELECT *, count(*) OVER p AS n, sum(w::INT) OVER p AS k FROM u WINDOW p AS (PARTITION BY app_id)), z AS (SELECT app_id, id, row_number() OVER (PARTITION BY app_id ORDER BY pos) AS place FROM n WHERE w AND (n <= 5 OR 1 - k / n::DOUBLE <= 0.6)) SELECT * FROM z WHERE place <= 5")
def document_search_fields(spark, sf):
    return A.search_fields(_fields(spark, sf))


@query(f"WITH {FIELDS} SELECT app_id, n AS n_unfilled, app_id % 2 = 0 AND n > 0 AS run_backfill, app_id % 3 > 0 AND n > 0 AS run_context, n > 0 AS run_batching FROM (SELECT app_id, count(*) FILTER (coalesce(trim(value), '') = '') AS n FROM f GROUP BY app_id)")
def application_plan(spark, sf):
    fields = _fields(spark, sf)
    has = fields.select("app_id").distinct().select("app_id", (F.col("app_id") % 2 == 0).alias("backfill"), (F.col("app_id") % 3).alias("n_context"))
    return A.plan(fields, has)


@query("""SELECT c_custkey AS app_id, c_custkey % 2 = 0 AND c_custkey % 3 > 0 AS parse_answers, c_custkey % 4 > 0 AND c_custkey % 5 = 0 AS run_lookup, c_custkey % 7 > 0 AND c_custkey % 3 < 2 AS answer_question,
(c_custkey % 3 > 0 AND c_custkey % 2 = 0) OR (c_custkey % 3 = 0 AND c_custkey % 5 > 2) AS advance_batch, c_custkey % 5 > 2 AS next_email FROM customer""")
def reply_plan(spark, sf):
    k = F.col("c_custkey")
    rows = _t(spark, sf, "customer").select(k.alias("app_id"), (k % 2 == 0).alias("has_answers"), F.when(k % 3 == 0, "question").when(k % 3 == 1, "mixed").otherwise("answers").alias("intent"), F.when(k % 7 > 0, "why?").alias("question"), (k % 4).alias("n_lookups"), (k % 5 == 0).alias("has_documents"), (k % 3).alias("n_current"), (k % 2).alias("n_current_unfilled"), F.when(k % 5 > 2, 1).otherwise(0).alias("n_next_unfilled"))
    return A.reply_plan(rows)


@query(f"WITH {FIELDS}, a AS (SELECT c_nationkey AS app_id, 'f' || c_custkey % 31 AS id, arg_max(CASE WHEN c_acctbal > 0 THEN c_name ELSE '' END, c_custkey) AS v, max(c_custkey) AS p FROM customer GROUP BY ALL) SELECT f.app_id, f.pos, CASE WHEN a.id IS NULL THEN value ELSE a.v END AS value, CASE WHEN a.id IS NULL THEN f.source WHEN p % 3 = 0 THEN 'phone' ELSE 'user' END AS source, CASE WHEN a.id IS NULL THEN confidence ELSE 'confirmed' END AS confidence FROM f LEFT JOIN a ON f.app_id = a.app_id AND f.id = a.id")
def application_answers(spark, sf):
    k = F.col("c_custkey")
    answers = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("app_id"), k.alias("pos"), F.concat(F.lit("f"), k % 31).alias("field_id"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise("").alias("value"), F.when(k % 3 == 0, "phone").alias("source"), F.lit(None).cast("string").alias("confidence"))
    return A.apply_answers(_fields(spark, sf), answers).select("app_id", "pos", "value", "source", "confidence")


@query(f"WITH {FIELDS}, p AS (SELECT c_nationkey AS app_id, 'f' || c_custkey % 61 AS id, arg_min(c_name, c_custkey) AS v FROM customer WHERE (c_custkey % 10) / 10.0::DOUBLE > 0.8 GROUP BY ALL) SELECT f.app_id, f.pos, CASE WHEN coalesce(trim(value), '') = '' AND p.id IS NOT NULL THEN v ELSE value END AS value FROM f LEFT JOIN p ON f.app_id = p.app_id AND f.id = p.id")
def prior_answer_backfill(spark, sf):
    k = F.col("c_custkey")
    prior = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("app_id"), k.alias("pos"), F.concat(F.lit("f"), k % 61).alias("field_id"), F.col("c_name").alias("value"), F.lit("prior").alias("source"), ((k % 10) / 10.0).alias("relevance"))
    return A.backfill(_fields(spark, sf), prior).select("app_id", "pos", "value")


@query(f"""WITH {FIELDS}, c AS (SELECT c_nationkey AS app_id, c_custkey AS pos, c_name AS v, CASE WHEN c_custkey % 3 = 0 THEN 'f' || c_custkey % 41 END AS fid, CASE c_custkey % 9 WHEN 0 THEN 'notes' WHEN 4 THEN 'nick' END AS lab FROM customer WHERE c_custkey % 11 > 0),
m AS (SELECT f.app_id, f.pos, arg_min(c.v, c.pos) AS v FROM f JOIN c ON f.app_id = c.app_id AND (fid = f.id OR fid IS NULL) AND (lab = lower(trim(f.label)) OR lab IS NULL) AND (fid IS NOT NULL OR lab IS NOT NULL) WHERE coalesce(trim(f.value), '') = '' GROUP BY ALL)
SELECT f.app_id, f.pos, coalesce(m.v, f.value) AS value FROM f LEFT JOIN m ON f.app_id = m.app_id AND f.pos = m.pos""")
def memory_backfill(spark, sf):
    k = F.col("c_custkey")
    chunks = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("app_id"), k.alias("pos"), F.when(k % 11 > 0, F.col("c_name")).otherwise(" ").alias("value"), F.when(k % 3 == 0, F.concat(F.lit("f"), k % 41)).alias("field_id"), F.when(k % 9 == 0, " Notes").when(k % 9 == 4, "Nick").alias("label"))
    # ids repeat within an application here: each field stands for itself
    return A.memory_fill(_fields(spark, sf), chunks).select("app_id", "pos", "value")


@query(rf"WITH {ACTIVE} SELECT app_id, app_id || ':' || id || ':context' AS id, id AS field_id, regexp_replace(regexp_replace(lower(trim(section || '.' || label)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key, value, section AS category, CASE WHEN source LIKE 'lookup:%' THEN 'lookup' ELSE 'application' END AS source FROM act WHERE coalesce(value, '') <> '' AND confidence = 'high'")
def context_proposals(spark, sf):
    return A.context_proposals(_active(spark, sf)[1])


@query(f"""{ISSUES.replace(FIELDS, ACTIVE)}, n AS (SELECT app_id, count(*) FILTER (coalesce(value, '') <> '') AS n, count(*) FILTER (required AND coalesce(value, '') = '') AS m FROM act GROUP BY app_id), b AS (SELECT app_id, bool_or(severity = 'blocking') AS b FROM i GROUP BY app_id)
SELECT app_id, n AS n_answers, m AS n_missing, CASE WHEN b OR m > 0 THEN 'draft' ELSE 'broker_ready' END AS status, CASE WHEN b OR m > 0 THEN 'failed' ELSE 'warning' END AS gate FROM n JOIN b USING (app_id)""")
def application_packets(spark, sf):
    return A.packets(*_active(spark, sf))


SHORT = f"lower(printf('%08x', {HASH.format(seed=0x811C9DC5, factor=0x01000193, unit='unicode(c)::BIGINT')}))"
PART = "regexp_replace(regexp_replace(lower(trim({})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"""WITH {FIELDS}, p AS (SELECT *, CASE WHEN pos % 4 = 0 THEN 'pna' ELSE 'p' || pos % 4 END AS pg, {PART.format("section")} AS s, {PART.format("label")} AS l FROM f),
a AS (SELECT *, 'app_field_anchor:' || pg || ':' || s || ':' || l || ':' || {SHORT} AS anchor FROM (SELECT *, pg || '|' || s || '|' || l || '|unknown' AS x FROM p)),
b AS (SELECT *, 'app_field:' || pg || ':' || s || ':' || l || ':' || {SHORT} AS base FROM (SELECT * EXCLUDE (x), pg || '|' || s || '|' || l || '|' || field_type || '||' || anchor AS x FROM a)),
k AS (SELECT *, row_number() OVER (PARTITION BY app_id, base ORDER BY pos) AS k FROM b)
SELECT pos, anchor AS anchor_id, CASE WHEN k > 1 THEN base || ':' || k ELSE base END AS id, CASE WHEN coalesce(value, '') <> '' THEN 'needs_review' ELSE 'missing' END AS validation FROM k""")
def application_field_ids(spark, sf):
    rows = _fields(spark, sf).withColumns({"page": (F.col("pos") % 4).cast("int"), "form_name": F.lit(None).cast("string")})
    return A.normalise_fields(rows).select("pos", "anchor_id", "id", "validation")


@query(f"""WITH {FIELDS}, s AS (SELECT app_id, section, row_number() OVER (PARTITION BY app_id ORDER BY min(pos)) AS k FROM f GROUP BY app_id, section), g AS (SELECT f.app_id, f.pos, f.id, label, k, row_number() OVER (PARTITION BY f.app_id ORDER BY k, f.pos) AS place FROM f JOIN s ON f.app_id = s.app_id AND f.section = s.section)
SELECT app_id, place AS pos, id AS field_id, label FROM g""")
def question_graph(spark, sf):
    fields = _fields(spark, sf).withColumn("anchor_id", F.concat_ws("-", F.lit("a"), "app_id", "pos"))
    nodes = A.question_graph(fields)
    whole = lambda c: F.concat_ws("/", "app_id", c)
    keyed = nodes.withColumns({"id": whole("id"), "parent_id": F.when(F.col("parent_id").isNotNull(), whole("parent_id"))})
    paths = trees.paths(keyed.select("id", "parent_id", F.col("ord").cast("long").alias("ord"), "app_id"), by="app_id")
    return A.flatten_graph(keyed, paths).select("app_id", F.col("pos").cast("long").alias("pos"), "field_id", "label")


@query("""WITH e AS (SELECT p_brand AS doc_id, p_partkey AS seq, CASE p_size % 5 WHEN 0 THEN ' ' ELSE ' ' || p_type || ' ' END AS f, CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS source, CASE WHEN p_size % 4 > 0 THEN p_name END AS title, p_size % 6 AS a FROM part WHERE true),
k AS (SELECT *, trim(f) AS form_number FROM e WHERE trim(f) <> ''), o AS (SELECT doc_id, form_number, source, min(seq) AS s FROM k GROUP BY ALL), l AS (SELECT doc_id, form_number, string_agg(source, ',' ORDER BY s) AS sources FROM o GROUP BY ALL)
SELECT k.doc_id, k.form_number, arg_min(title, seq) FILTER (title <> '') AS title, arg_min(a, seq) FILTER (a > 0) AS page_start, any_value(sources) AS sources FROM k JOIN l ON k.doc_id = l.doc_id AND k.form_number = l.form_number GROUP BY 1, 2""")
def form_inventory(spark, sf):
    z = F.col("p_size")
    rows = _t(spark, sf, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("seq"), F.when(z % 5 == 0, " ").otherwise(F.concat(F.lit(" "), "p_type", F.lit(" "))).alias("form_number"), F.when(z % 3 == 0, "a").when(z % 3 == 1, "b").otherwise("c").alias("source"), F.when(z % 4 > 0, F.col("p_name")).alias("title"), (z % 6).alias("page_start"), F.lit(0).alias("page_end"))
    return R.form_inventory(rows).select("doc_id", "form_number", "title", "page_start", F.array_join("sources", ",").alias("sources"))


RECORDS = r"""r AS (SELECT p_brand AS doc_id, p_partkey AS seq, CASE p_partkey % 8 WHEN 0 THEN 'coverages' WHEN 1 THEN 'endorsements' WHEN 2 THEN 'coverages' WHEN 3 THEN 'exclusions' WHEN 4 THEN 'conditions' WHEN 5 THEN CASE WHEN p_brand > 'Brand#2' THEN 'definitions' ELSE 'exclusions' END WHEN 6 THEN CASE WHEN p_brand > 'Brand#3' THEN 'coveredReasons' ELSE 'coverages' END ELSE 'sections' END AS kind,
  CASE p_size % 5 WHEN 0 THEN 'Base Coverage Form' WHEN 1 THEN 'Wind - Deductible' WHEN 2 THEN 'Plain' ELSE p_type END AS name, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE 'F' || p_size % 2 END AS form_number, CASE WHEN p_partkey % 7 > 0 THEN p_size END AS page,
  CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Schedule A' WHEN 2 THEN 'Endorsement 3' ELSE 'Coverage Form' END AS section, CASE p_size % 8 WHEN 0 THEN NULL WHEN 1 THEN 'flood retention of 5' WHEN 3 THEN 'Exclusions .....12' WHEN 4 THEN repeat(p_name || ' ', 12) ELSE 'limit ' || p_name END AS original,
  CASE WHEN p_partkey % 9 > 0 THEN (p_size % 3)::VARCHAR END AS lim, CASE WHEN p_partkey % 10 = 0 THEN '1' END AS ded, p_partkey % 5 AS n, CASE WHEN p_size % 4 > 0 THEN p_size + p_size % 3 - 1 END AS page_end, CASE WHEN p_size % 3 = 0 THEN 'definition' WHEN p_size % 3 = 1 THEN 'covered_reason' ELSE 'other' END AS type FROM part)"""


@query(rf"""WITH {RECORDS}, d AS (SELECT DISTINCT doc_id FROM r), has AS (SELECT DISTINCT doc_id, kind FROM r),
x AS (SELECT * FROM r UNION ALL SELECT * REPLACE ('definitions' AS kind) FROM r WHERE kind = 'sections' AND type = 'definition' AND doc_id NOT IN (SELECT doc_id FROM has WHERE kind = 'definitions')
  UNION ALL SELECT * REPLACE ('coveredReasons' AS kind) FROM r WHERE kind = 'sections' AND type = 'covered_reason' AND doc_id NOT IN (SELECT doc_id FROM has WHERE kind = 'coveredReasons')),
k AS (SELECT *, row_number() OVER w AS k, first_value(lim) OVER w AS l1, first_value(ded) OVER w AS d1 FROM x WHERE kind = 'coverages' WINDOW w AS (PARTITION BY doc_id, lower(name), lower(form_number) ORDER BY CASE section WHEN 'Schedule A' THEN 4 WHEN 'Endorsement 3' THEN 3 WHEN 'Coverage Form' THEN 1 ELSE 0 END DESC, seq)),
y AS (SELECT *, lower(name) AS nm, lower(coalesce(original, name)) AS o FROM x), f AS (SELECT DISTINCT doc_id, trim(form_number) AS f FROM r WHERE kind = 'exclusions'),
i AS (SELECT doc_id, kind, seq, 'record_missing_source_span' AS code FROM x WHERE n = 0
UNION ALL SELECT doc_id, kind, seq, 'endorsement_missing_form_number' FROM x WHERE kind = 'endorsements' AND trim(form_number) = ''
UNION ALL SELECT doc_id, kind, seq, 'generic_form_row_as_coverage' FROM x WHERE kind = 'coverages' AND regexp_matches(name, '(?i)coverage form$')
UNION ALL SELECT doc_id, kind, seq, 'deductible_row_as_coverage_limit' FROM y WHERE kind = 'coverages' AND regexp_matches(nm || ' ' || o, '\b(deductible|retention|sir)\b') AND ded IS NULL AND lim IS NOT NULL AND ((original IS NOT NULL AND regexp_matches(o, '\b(deductible|retention|sir)\b') AND NOT regexp_matches(o, '\b(limit|coverage)\b')) OR nm LIKE '%- deductible')
UNION ALL SELECT doc_id, kind, seq, CASE kind WHEN 'coverages' THEN 'coverage' WHEN 'exclusions' THEN 'exclusion' WHEN 'conditions' THEN 'condition' WHEN 'definitions' THEN 'definition' ELSE 'covered_reason' END || '_missing_page_number' FROM x WHERE kind NOT IN ('sections', 'endorsements') AND page IS NULL
UNION ALL SELECT doc_id, kind, seq, 'coverage_missing_section_ref' FROM x WHERE kind = 'coverages' AND section IS NULL
UNION ALL SELECT doc_id, kind, seq, 'coverage_missing_original_content' FROM x WHERE kind = 'coverages' AND original IS NULL
UNION ALL SELECT doc_id, kind, seq, CASE kind WHEN 'definitions' THEN 'definition_missing_content' ELSE 'covered_reason_missing_content' END FROM x WHERE kind IN ('definitions', 'coveredReasons') AND original IS NULL
UNION ALL SELECT doc_id, kind, seq, CASE kind WHEN 'exclusions' THEN 'exclusion_toc_artifact' ELSE 'condition_toc_artifact' END FROM x WHERE kind IN ('exclusions', 'conditions') AND regexp_matches(original, '\.{{4,}}\d{{1,3}}$')
UNION ALL SELECT doc_id, kind, seq, 'section_short_fragment' FROM x WHERE kind = 'sections' AND length(trim(original)) < 120 AND page IS NOT NULL AND (page_end IS NULL OR page_end = page)
UNION ALL SELECT doc_id, kind, seq, 'coverage_precedence_conflict' FROM k WHERE k > 1 AND ((lim IS NOT NULL AND l1 IS NOT NULL AND lim <> l1) OR (ded IS NOT NULL AND d1 IS NOT NULL AND ded <> d1))
UNION ALL SELECT x.doc_id, kind, seq, CASE kind WHEN 'coverages' THEN 'coverage' ELSE 'endorsement' END || '_form_missing_from_inventory' FROM x LEFT JOIN f ON x.doc_id = f.doc_id AND trim(form_number) = f WHERE kind IN ('coverages', 'endorsements') AND trim(form_number) <> '' AND f IS NULL
UNION ALL SELECT doc_id, 'definitions', NULL::BIGINT, 'definitions_mapped_but_empty' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM x WHERE kind = 'definitions')
UNION ALL SELECT doc_id, 'coveredReasons', NULL::BIGINT, 'covered_reasons_mapped_but_empty' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM x WHERE kind = 'coveredReasons'))
SELECT *, CASE WHEN code IN ('record_missing_source_span', 'endorsement_missing_form_number', 'generic_form_row_as_coverage', 'deductible_row_as_coverage_limit', 'exclusion_toc_artifact', 'condition_toc_artifact') THEN 'blocking' ELSE 'warning' END AS severity FROM i""")
def extraction_review(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    col = lambda v: v if not isinstance(v, (str, type(None))) else F.lit(v).cast("string")
    pick = lambda key, *values: F.element_at(F.array(*map(col, values)), (key % len(values) + 1).cast("int"))
    limit = F.concat(F.lit("limit "), "p_name")
    kind = pick(k, "coverages", "endorsements", "coverages", "exclusions", "conditions", F.when(F.col("p_brand") > "Brand#2", "definitions").otherwise("exclusions"), F.when(F.col("p_brand") > "Brand#3", "coveredReasons").otherwise("coverages"), "sections")
    name = pick(z, "Base Coverage Form", "Wind - Deductible", "Plain", F.col("p_type"), F.col("p_type"))
    original = pick(z, None, "flood retention of 5", limit, "Exclusions .....12", F.repeat(F.concat("p_name", F.lit(" ")), F.lit(12)), limit, limit, limit)
    rows = _t(spark, sf, "part").select(F.col("p_brand").alias("doc_id"), k.alias("seq"), kind.alias("kind"), name.alias("name"), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("F"), z % 2)).alias("form_number"), F.when(k % 7 > 0, z).alias("page"), pick(k, None, "Schedule A", "Endorsement 3", *(["Coverage Form"] * 3)).alias("section"), original.alias("original"), F.when(k % 9 > 0, (z % 3).cast("string")).alias("limit"), F.when(k % 10 == 0, "1").alias("deductible"), (k % 5).alias("n_spans"), F.when(z % 4 > 0, z + z % 3 - 1).alias("page_end"), pick(z, "definition", "covered_reason", "other").alias("type"))
    mapped = rows.select("doc_id", F.explode(F.array(F.lit("definitions"), F.lit("coveredReasons"), F.lit("exclusions"))).alias("kind")).distinct()
    return R.extraction_review(rows, mapped, rows.where("kind = 'exclusions'").select("doc_id", "form_number"))
