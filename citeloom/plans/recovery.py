"""Queries of recovery, cleaning, comparison, evidence packets and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cleanup as L
from ..operators import packet as P
from ..operators import protocol as PR
from ..operators import recovery as V
from ..operators import retrieval as RT
from .queries import _t, query

SPANS = "s AS (SELECT c_custkey AS k, c_nationkey AS d, (1 + c_custkey % 40)::INT AS a, (1 + c_custkey % 40 + c_custkey % 3)::INT AS z FROM customer)"


def _spans(spark, sf):
    k = F.col("c_custkey")
    return _t(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("document_id"), k.cast("string").alias("id"), (1 + k % 40).cast("int").alias("page_start"), (1 + k % 40 + k % 3).cast("int").alias("page_end"), F.concat("c_name", F.lit("  of  "), "c_mktsegment").alias("text"), F.when(k % 4 == 0, "table_row").when(k % 4 == 1, "table_cell").otherwise("text").alias("source_unit"), F.when(k % 4 < 2, F.concat(F.lit("T"), k % 5)).alias("table_id"), (k % 8 == 0).alias("is_header"))


@query(f"WITH {SPANS} SELECT DISTINCT d::VARCHAR AS document_id, unnest(range(a, z + 1))::INT AS page FROM s UNION SELECT n_nationkey::VARCHAR, 99 FROM nation WHERE n_nationkey % 2 = 0")
def document_pages(spark, sf):
    k = F.col("n_nationkey")
    nodes = _t(spark, sf, "nation").select(k.cast("string").alias("document_id"), F.when(k % 2 == 0, 99).alias("page_start"), F.lit(0).alias("page_end"))
    return V.document_pages(_spans(spark, sf), nodes)


@query(f"WITH {SPANS}, p AS (SELECT k, d, unnest(range(a, z + 1)) AS page FROM s) SELECT d::VARCHAR AS document_id, page::INT AS page, count(DISTINCT CASE WHEN k % 4 < 2 THEN k % 5 END)::INT AS tables, count(*) FILTER (k % 4 = 0) AS rows, count(*) FILTER (k % 4 = 1) AS cells, count(*) FILTER (k % 4 > 1) AS texts FROM p GROUP BY ALL")
def page_layout(spark, sf):
    rows = V.page_layout(_spans(spark, sf))
    return rows.select("document_id", "page", "tables", "rows", "cells", F.coalesce(F.try_element_at("units", F.lit("text")), F.lit(0)).alias("texts"))


@query(f"WITH {SPANS}, p AS (SELECT DISTINCT d, unnest(range(a, z + 1)) AS page FROM s) SELECT d::VARCHAR AS document_id, page::INT AS page, (row_number() OVER (PARTITION BY d ORDER BY page) - 1) // 32 AS batch FROM p")
def page_batches(spark, sf):
    return V.page_batches(V.document_pages(_spans(spark, sf), _spans(spark, sf)))


@query("WITH r AS (SELECT s_suppkey AS k, (1 + s_suppkey % 20)::INT AS a, (1 + s_suppkey % 20 + s_suppkey % 11)::INT AS z FROM supplier), p AS (SELECT k, unnest(range(a, z + 1, 4)) AS p, z FROM r) SELECT k AS region_id, p::INT AS start, least(z, p + 3)::INT AS stop FROM p")
def region_pieces(spark, sf):
    return V.split_regions(_regions(spark, sf)).select("region_id", "start", "stop")


def _regions(spark, sf):
    k = F.col("s_suppkey")
    return _t(spark, sf, "supplier").select(k.alias("region_id"), F.col("s_nationkey").cast("string").alias("document_id"), (1 + k % 20).cast("int").alias("start"), (1 + k % 20 + k % 11).cast("int").alias("stop"))


EVIDENCE = f"""WITH RECURSIVE {SPANS}, r AS (SELECT s_suppkey AS g, s_nationkey AS d, 1 + s_suppkey % 20 AS a, 1 + s_suppkey % 20 + s_suppkey % 11 AS z FROM supplier), t AS (SELECT c_custkey AS k, c_name || ' of ' || c_mktsegment AS t FROM customer),
e AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY s.a, s.k::VARCHAR) AS i, s.k, t.t, length(t.t) + 260 AS n FROM r JOIN s ON r.d = s.d AND s.a <= r.z AND s.z >= r.a JOIN t ON t.k = s.k),
f AS (SELECT g, i, n AS size, 0 AS b FROM e WHERE i = 1 UNION ALL SELECT e.g, e.i, CASE WHEN f.size + e.n <= 2000 THEN f.size + e.n ELSE e.n END, CASE WHEN f.size + e.n <= 2000 THEN b ELSE b + 1 END FROM f JOIN e ON e.g = f.g AND e.i = f.i + 1)"""


@query(f"{EVIDENCE} SELECT e.g AS region_id, k::VARCHAR AS span_id, b AS batch, t AS text FROM e JOIN f ON e.g = f.g AND e.i = f.i")
def region_evidence_batches(spark, sf):
    return V.batched_evidence(_regions(spark, sf), _spans(spark, sf), 2000).select("region_id", "span_id", "batch", "text")


@query("WITH r AS (SELECT s_suppkey AS g, s_nationkey AS d, 1 + s_suppkey % 20 AS a FROM supplier), n AS (SELECT c_custkey AS k, c_nationkey AS d, c_custkey % 15 AS p, c_custkey % 7 AS o FROM customer WHERE c_custkey % 3 > 0), j AS (SELECT g, k, row_number() OVER (PARTITION BY g ORDER BY p DESC, o DESC, k::VARCHAR) AS place FROM r JOIN n ON r.d = n.d AND p <= a) SELECT g AS region_id, k::VARCHAR AS node_id, place::INT AS place FROM j WHERE place <= 12")
def region_context(spark, sf):
    k = F.col("c_custkey")
    nodes = _t(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("document_id"), k.cast("string").alias("id"), F.when(k % 3 == 0, "text").when(k % 3 == 1, "section").otherwise("table").alias("kind"), F.when(k % 15 > 0, k % 15).alias("page_start"), (k % 7).alias("ord"))
    return V.prior_context(_regions(spark, sf), nodes)


@query(f"WITH {SPANS}, r AS (SELECT s_suppkey AS g, s_nationkey AS d, 1 + s_suppkey % 20 AS a FROM supplier) SELECT g AS region_id, k::VARCHAR AS span_id FROM r JOIN s ON r.d = s.d AND k % 8 = 0 AND s.a BETWEEN greatest(1, r.a - 2) AND r.a")
def region_table_heads(spark, sf):
    return V.header_spans(_regions(spark, sf), _spans(spark, sf))


FACTS = """f AS (SELECT o_orderkey AS k, o_custkey % 25 AS d, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS sp, CASE WHEN o_orderkey % 5 = 0 THEN 'x' WHEN o_orderkey % 5 = 1 THEN 'n' || o_custkey % 25 END AS nd, CASE o_orderkey % 4 WHEN 0 THEN 'worth 000' || o_custkey || '00' WHEN 1 THEN 'no number' WHEN 2 THEN NULL ELSE 'A-' || o_orderkey END AS v FROM orders),
c AS (SELECT f.*, s.c_custkey AS found, regexp_replace(lower(coalesce('000' || s.c_custkey || '00 ' || s.c_name, '')), '[^a-z0-9]+', '', 'g') AS t FROM f LEFT JOIN customer s ON f.sp = s.c_custkey AND f.d = s.c_custkey % 25),
g AS (SELECT *, CASE k % 4 WHEN 0 THEN contains(t, '000' || o || '00') WHEN 3 THEN (length(k::VARCHAR) < 2 OR contains(t, k::VARCHAR)) AND (length('A-' || k) < 5 OR contains(t, 'a' || k)) ELSE TRUE END AS held FROM (SELECT c.*, o_custkey AS o FROM c JOIN orders ON o_orderkey = k))"""


def _facts(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    doc = (c % 25).cast("string")
    v = F.when(k % 4 == 0, F.concat(F.lit("worth 000"), c, F.lit("00"))).when(k % 4 == 1, "no number").when(k % 4 == 3, F.concat(F.lit("A-"), k))
    none = F.array().cast("array<string>")
    facts = _t(spark, sf, "orders").select(k.alias("fact_id"), doc.alias("document_id"), F.array(v).alias("values"), F.when(k % 5 == 0, F.array(F.lit("x"))).when(k % 5 == 1, F.array(F.concat(F.lit("n"), doc))).otherwise(none).alias("node_ids"), F.when(k % 3 > 0, F.array(c.cast("string"), c.cast("string"))).otherwise(none).alias("span_ids"))
    s = F.col("c_custkey")
    spans = _t(spark, sf, "customer").select((s % 25).cast("string").alias("document_id"), s.cast("string").alias("id"), F.concat(F.lit("000"), s, F.lit("00 "), "c_name").alias("text"))
    nodes = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("document_id"), F.concat(F.lit("n"), "n_nationkey").alias("id"))
    return facts, nodes, spans


@query(f"WITH {FACTS} SELECT k AS fact_id, (found IS NOT NULL OR k % 5 = 1) AND held AS valid, (found IS NOT NULL)::INT AS n_spans FROM g")
def recovery_validation(spark, sf):
    rows = V.validate_candidates(*_facts(spark, sf))
    return rows.select("fact_id", "valid", F.size("known_spans").alias("n_spans"))


@query(f"WITH {FACTS} SELECT d::VARCHAR AS document_id, count(*) FILTER (NOT ((found IS NOT NULL OR k % 5 = 1) AND held)) AS n FROM g GROUP BY d")
def recovery_rejections(spark, sf):
    return V.rejected(V.validate_candidates(*_facts(spark, sf)))


@query("SELECT p_partkey, p_partkey % 4 IN (0, 2) OR (p_partkey % 4 = 1 AND p_size % 2 = 0) AS out FROM part")
def recovery_rejects(spark, sf):
    k = F.col("p_partkey") % 4
    name = F.concat("p_name", F.when(k == 0, " (Declined)").when(k == 1, " Premium").when(k == 2, " optional - no").otherwise(" cover"))
    return _t(spark, sf, "part").select("p_partkey", V.no_coverage(name, F.col("p_size") % 2 == 1).alias("out"))


SCOPED = "p AS (SELECT p_brand AS d, p_partkey AS q, p_name AS n, p_size % 3 AS f, p_size % 2 AS e, p_size AS a FROM part WHERE p_partkey % 2 = 0), r AS (SELECT p_brand AS d, p_partkey AS q, p_name AS n, p_size % 3 AS f, p_size % 2 AS e, p_size AS a FROM part WHERE p_partkey % 2 = 1)"


@query(f"WITH {SCOPED} SELECT r.d AS document_id, r.q AS seq, min(p.q) AS match FROM r LEFT JOIN p ON r.d = p.d AND r.n = p.n AND (r.f = 0 OR p.f = 0 OR r.f = p.f) AND r.e = p.e AND (r.a % 5 = 0 OR p.a % 5 = 0 OR abs(r.a - p.a) <= 1) GROUP BY ALL")
def scope_matches(spark, sf):
    z, none = F.col("p_size"), F.lit(None).cast("string")
    page = F.when(z % 5 > 0, z)
    rows = _t(spark, sf, "part").select(F.col("p_brand").alias("document_id"), F.col("p_partkey").alias("seq"), "p_name", none.alias("line"), F.when(z % 3 > 0, F.concat(F.lit("F-"), z % 3)).alias("form"), none.alias("section"), F.when(z % 2 == 1, "E 1").alias("endorsement"), page.alias("first"), page.alias("last"))
    primary = rows.where("seq % 2 = 0").withColumn("name", F.concat(F.upper("p_name"), F.lit(" &"))).drop("p_name")
    found = rows.where("seq % 2 = 1").withColumn("name", F.concat("p_name", F.lit(" and"))).drop("p_name")
    return V.match_scope(primary, found).select("document_id", "seq", "match")


FITS = "(x.form IS NULL OR r[1].form IS NULL OR x.form = r[1].form) AND x.a <= r[1].z + 1 AND r[1].a <= x.z + 1"
KNOWN = "list_contains(x.terms, r[1].terms[1])"
NEAR = "len(list_filter(x.terms, lambda t: t.l = r[1].terms[1].l)) > 0"


@query(f"""WITH f AS (SELECT p_brand AS d, p_partkey AS k, p_partkey % 2 AS rec, p_name AS name, CASE WHEN p_size % 3 > 0 THEN 'F' || p_size % 3 END AS form, p_size AS a, CASE WHEN p_size % 2 = 0 THEN '1' END AS lim, p_type AS l, (p_size % 4)::VARCHAR AS v FROM part),
g AS (SELECT d, lower(name) AS key, list([{{rec: rec, k: k, name: name, form: form, a: a, z: a, lim: lim, terms: [{{l: l, v: v}}], n_found: rec, conflicts: 0::BIGINT}}] ORDER BY rec, k) AS l FROM f GROUP BY ALL),
h AS (SELECT d, unnest(list_reduce(l, lambda s, r: CASE WHEN r[1].rec = 0 OR coalesce(list_position(list_transform(s, lambda x: {FITS}), true), 0) = 0 THEN s || r
  ELSE list_transform(s, lambda x, i: CASE WHEN i = list_position(list_transform(s, lambda x: {FITS}), true) THEN {{rec: x.rec, k: x.k, name: x.name, form: coalesce(x.form, r[1].form), a: least(x.a, r[1].a), z: greatest(x.z, r[1].z), lim: coalesce(x.lim, r[1].lim),
    terms: CASE WHEN {KNOWN} THEN x.terms ELSE x.terms || r[1].terms END, n_found: x.n_found + CASE WHEN {KNOWN} THEN 0 ELSE 1 END, conflicts: x.conflicts + CASE WHEN NOT {KNOWN} AND {NEAR} THEN 1 ELSE 0 END}} ELSE x END) END)) AS c FROM g)
SELECT d AS document_id, (row_number() OVER (PARTITION BY d ORDER BY c.rec, c.k) - 1)::INTEGER AS seq, c.name AS name, c.form AS form, c.lim AS limit_text, len(c.terms)::INTEGER AS n_terms, c.n_found::INTEGER AS n_found, c.conflicts::INTEGER AS conflicts FROM h""")
def recovery_merge(spark, sf):
    """Parts of a brand as coverages: even ones there, odd ones recovered."""
    z, none = F.col("p_size"), F.lit(None).cast("string")
    term = F.struct(F.lit("other").alias("kind"), F.col("p_type").alias("label"), (z % 4).cast("string").alias("value"), none.alias("applies"))
    rows = _t(spark, sf, "part").select(F.col("p_brand").alias("document_id"), F.col("p_partkey").cast("int").alias("seq"), (F.col("p_partkey") % 2 == 1).alias("recovered"), F.col("p_name").alias("name"), none.alias("line"), F.when(z % 3 > 0, F.concat(F.lit("F"), z % 3)).alias("form"), none.alias("section"), none.alias("endorsement"), z.alias("first"), z.alias("last"), F.when(z % 2 == 0, "1").alias("limit"), none.alias("deductible"), F.array(term).alias("terms"))
    return V.merge_recovered(rows).select("document_id", "seq", "name", "form", F.col("limit").alias("limit_text"), "n_terms", "n_found", "conflicts")


@query("WITH a AS (SELECT p_name AS n, p_partkey AS k FROM part WHERE p_partkey % 3 = 0), b AS (SELECT p_name || CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END AS n, min(p_partkey) AS k FROM part WHERE p_partkey % 3 > 0 GROUP BY 1) SELECT n, k FROM a UNION ALL SELECT n, k FROM b WHERE n NOT IN (SELECT n FROM a)")
def append_unique(spark, sf):
    parts, k = _t(spark, sf, "part"), F.col("p_partkey")
    rows = parts.where(k % 3 == 0).select(F.col("p_name").alias("n"), k.alias("k"))
    more = parts.where(k % 3 > 0).select(F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type"))).alias("n"), k.alias("k"))
    return V.append_unique(rows, more, ["n"], "k")


@query("""WITH t AS (SELECT p_partkey AS k, p_size % 5 AS z, p_type AS t FROM part)
SELECT k AS p_partkey, CASE z WHEN 0 THEN '$1 Each Claim / $2 Aggregate' WHEN 1 THEN '$3 ' || t WHEN 2 THEN '$4 per policy' WHEN 3 THEN '$1 Each Claim' END AS "limit", CASE WHEN z IN (1, 4) THEN '$9' END AS deductible FROM t""")
def limit_display(spark, sf):
    t = lambda kind, label, value: F.struct(F.lit(kind).alias("kind"), (label if not isinstance(label, str) else F.lit(label)).alias("label"), F.lit(value).alias("value"))
    some = [F.array(t("each_claim_limit", "Limit", "$1 / "), t("aggregate_limit", "amount", ": $2"), t("sublimit", "x", "$7")), F.array(t("sublimit", F.concat("p_type", F.lit(" Limit")), "$3."), t("retention", "r", "$9")), F.array(t("other", "the limit", "$4 per policy")), F.array(t("each_claim_limit", "", "$1"), t("each_claim_limit", "Each Claim", "$1")), F.array(t("other", "SIR", "$9"))]
    terms = F.element_at(F.array(*some), (F.col("p_size") % 5 + 1).cast("int"))
    return _t(spark, sf, "part").select("p_partkey", L.derived(terms).alias("d")).select("p_partkey", "d.limit", "d.deductible")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '$2 Each Claim' WHEN p_size % 3 = 1 THEN '$5' ELSE '$5 Aggregate' END AS \"limit\", CASE WHEN p_size % 3 = 0 THEN 1 ELSE 2 END AS n FROM part")
def term_decisions(spark, sf):
    t = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.lit("").alias("label"), F.lit(value).alias("value"))
    z = F.col("p_size") % 3
    rows = _t(spark, sf, "part").select(F.col("p_partkey").alias("group"), F.lit(0).alias("idx"), F.when(z == 2, "$5 Aggregate").otherwise("$5").alias("limit"), F.array(t("each_claim_limit", "$1"), t("premium", "$3")).alias("terms"))
    none = F.lit(None).cast("string")
    made = lambda term, pos, action, value: rows.where(F.col("limit") == "$5").join(_t(spark, sf, "part").where("p_size % 3 = 0").select(F.col("p_partkey").alias("group")), "group").select("group", "idx", F.lit(term).alias("term"), F.lit(pos).alias("pos"), F.lit(action).alias("action"), none.alias("kind"), none.alias("label"), F.lit(value).cast("string").alias("value"))
    decisions = made(0, 1, "drop", None).unionByName(made(0, 2, "update", "$2")).unionByName(made(1, 1, "drop", None))
    return L.apply_terms(rows, decisions).select(F.col("group").alias("p_partkey"), "limit", F.size("terms").alias("n"))


@query("""WITH n AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS p, c_nationkey AS d, c_custkey AS o, 1 + c_custkey % 9 AS pg, c_name AS t FROM customer), c AS (SELECT * FROM n WHERE o % 37 = 0),
x AS (SELECT d, id, 1000 AS s FROM c UNION ALL SELECT d, p, 940 FROM c UNION ALL SELECT d, 'r' || d % 5, 910 FROM c UNION ALL SELECT n.d, n.id, 850 - abs(n.o - c.o) FROM n JOIN c ON n.p = c.p AND abs(n.o - c.o) <= 4),
y AS (SELECT d, id, max(s) AS s FROM x GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY o, id) AS k FROM n), b AS (SELECT k.d, k.id, 760 AS s FROM k JOIN y ON k.p = y.id WHERE k <= 24),
w AS (SELECT n.d, n.id, 600 AS s FROM n WHERE n.o % 10 = 7 AND EXISTS (SELECT 1 FROM c WHERE c.d = n.d AND c.pg = n.pg)), z AS (SELECT d, id, max(s) AS s FROM (SELECT * FROM y UNION ALL SELECT * FROM b UNION ALL SELECT * FROM w) GROUP BY ALL),
q AS (SELECT z.*, coalesce(n.pg, 0) AS pg, coalesce(n.o, 0) AS o FROM z LEFT JOIN n ON z.id = n.id WHERE z.id NOT LIKE 'r%'), r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY s DESC, pg, o, id) AS rk FROM q) SELECT d AS document_id, id, s::INT AS score FROM r WHERE rk <= 90""")
def cleanup_nodes(spark, sf):
    k = F.col("c_custkey")
    nation = _t(spark, sf, "nation")
    root = nation.select(F.col("n_nationkey").alias("document_id"), F.concat(F.lit("r"), F.col("n_nationkey") % 5).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("document").alias("kind"), F.lit(0).cast("long").alias("ord"), F.lit(0).alias("page_start"), F.lit(0).alias("page_end"), F.lit("").alias("text"))
    mid = nation.select(F.col("n_nationkey").alias("document_id"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), F.col("n_nationkey") % 5).alias("parent_id"), F.lit("page").alias("kind"), F.lit(0).cast("long").alias("ord"), F.lit(0).alias("page_start"), F.lit(0).alias("page_end"), F.lit("").alias("text"))
    leaf = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("document_id"), F.concat(F.lit("c"), k).alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.lit("text").alias("kind"), k.alias("ord"), (1 + k % 9).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), F.concat("c_name", F.when(k % 10 == 7, " FLOODED").otherwise("")).alias("text"))
    nodes = root.unionByName(mid).unionByName(leaf)
    cited = leaf.where(F.col("ord") % 37 == 0).select("document_id", "id")
    terms = leaf.select("document_id", F.explode(F.array(F.lit("flood"), F.lit("cust"))).alias("term")).distinct()
    return L.select_nodes(nodes, cited, terms, "no such word").select("document_id", "id", "score")


@query("SELECT n_nationkey AS id, sum(DISTINCT 0)::BIGINT + count(*) FILTER (k % 4 = 1) AS n_facts, 0 AS n_coverages FROM (SELECT n_nationkey, unnest(range(0, 5)) AS k FROM nation) GROUP BY 1".replace("sum(DISTINCT 0)::BIGINT + ", "").replace("0 AS n_coverages", "CASE WHEN n_nationkey % 4 = 2 THEN 1 ELSE 0 END::BIGINT AS n_coverages").replace("AS n_facts, CASE", "AS n_facts, CASE").replace("count(*) FILTER (k % 4 = 1)", "count(*) FILTER ((n_nationkey + k) % 5 = 1)"))
def protocol_comparison(spark, sf):
    return _compared(spark, sf).drop("passed")


def _compared(spark, sf):
    k = F.col("n_nationkey")
    ids = _t(spark, sf, "nation").select(k.alias("id"))
    none = F.array().cast("array<string>")
    facts = _t(spark, sf, "nation").select(k.alias("id"), F.posexplode(F.array(*map(F.lit, PR.CRITICAL))).alias("i", "field"))
    before = facts.select("id", "field", F.lit("A-1 b").alias("value"), F.array(F.lit("s")).alias("span_ids"), none.alias("node_ids"))
    bad = (F.col("id") + F.col("i")) % 5 == 1
    after = facts.select("id", "field", F.when(bad & (F.col("id") % 2 == 0), "other").otherwise("a1B").alias("value"), F.when(bad & (F.col("id") % 2 == 1), none).otherwise(F.array(F.lit("z"))).alias("span_ids"), none.alias("node_ids"))
    cover = lambda seq, name, code, spans, nodes: _t(spark, sf, "nation").select(k.alias("id"), F.lit(seq).alias("seq"), name.alias("name"), code.alias("code"), spans.alias("span_ids"), nodes.alias("node_ids"))
    null, one = F.lit(None).cast("string"), lambda x: F.array(F.lit(x))
    was = cover(0, F.lit("Wind"), F.lit("W"), one("a"), one("n")).unionByName(cover(1, F.lit("uncited"), null, none, none))
    # after: of every fourth the same span, the same name, an uncited one, the same code
    now = cover(0, F.when(k % 4 == 1, "wind!").when(k % 4 == 2, "Wind").otherwise("else"), F.when(k % 4 == 3, "w").otherwise("Q"), F.when(k % 4 == 0, one("a")).when(k % 4 == 2, none).otherwise(one("zz")), none)
    return PR.compare(ids, PR.fact_regressions(before, after), PR.coverage_regressions(was, now))


@query("SELECT count(*) AS fixtures, 0::BIGINT AS n_passed, count(*)::BIGINT AS n_facts, count(*) FILTER (n_nationkey % 4 = 2)::BIGINT AS n_coverages, FALSE AS passed FROM nation")
def protocol_corpus(spark, sf):
    return PR.corpus(_compared(spark, sf))


SAID = "['Policy number and premium', 'nothing at all', 'Limits of liability $5,000', 'Declarations page: Item 3. Named Insured', '12 Main Street Springfield, IL 62704', 'the definitions and exclusions']"
SCORES = "[12, 0, 17, 22, 20, 0]"  # by the words of each, without its unit
ON_PAGE = "[12 + 12 + 10, 0, 17, 22 + 24 + 20 + 12, 20, -12]"
PACKET = f"""x AS (SELECT c_custkey AS k, c_nationkey AS d, (1 + c_custkey % 30)::INT AS page, c_custkey % 6 + 1 AS i, CASE c_custkey % 4 WHEN 0 THEN 'table_row' WHEN 1 THEN 'page' ELSE 'text' END AS unit FROM customer),
s AS (SELECT *, {SCORES}[i] + CASE unit WHEN 'table_row' THEN 5 WHEN 'page' THEN -3 ELSE 0 END AS score, {ON_PAGE}[i] - {SCORES}[i] AS more FROM x), p AS (SELECT d, page, sum(greatest(0, score) + more) FILTER (greatest(0, score) + more > 0) AS s FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY s DESC, page) AS rank FROM p WHERE s >= 18)"""


def _said(spark, sf):
    k = F.col("c_custkey")
    words = ("Policy number and premium", "nothing at all", "Limits of liability $5,000", "Declarations page: Item 3. Named Insured", "12 Main Street Springfield, IL 62704", "the definitions and exclusions")
    return _t(spark, sf, "customer").select(F.col("c_nationkey").alias("document_id"), F.lpad(k.cast("string"), 9, "0").alias("id"), (1 + k % 30).cast("int").alias("page_start"), F.element_at(F.array(*map(F.lit, words)), (k % 6 + 1).cast("int")).alias("text"), F.when(k % 4 == 0, "table_row").when(k % 4 == 1, "page").otherwise("text").alias("source_unit"))


@query(f"WITH {PACKET} SELECT k::BIGINT AS k, score::INT AS score FROM s")
def evidence_scores(spark, sf):
    rows = _said(spark, sf)
    return rows.select(F.col("id").cast("long").alias("k"), P.span_score(rows).cast("int").alias("score"))


@query(f"WITH {PACKET} SELECT d AS document_id, page, s::BIGINT AS score, rank::INT AS rank FROM r WHERE rank <= 12")
def evidence_page_scores(spark, sf):
    return P.page_scores(_said(spark, sf))


@query(f"WITH {PACKET} SELECT k::BIGINT AS k, unit = 'table_row' OR i IN (1, 4) OR (unit = 'text' AND i IN (3, 5)) AS anchor FROM s")
def evidence_anchors(spark, sf):
    rows = _said(spark, sf)
    return rows.select(F.col("id").cast("long").alias("k"), P.is_anchor(rows).alias("anchor"))


@query(f"""WITH {PACKET}, a AS (SELECT s.*, r.page IS NOT NULL AND r.rank <= 12 AS chosen, bool_or(r.page IS NOT NULL AND r.rank <= 12) OVER (PARTITION BY s.d) AS any_page FROM s LEFT JOIN r ON s.d = r.d AND s.page = r.page),
b AS (SELECT *, (NOT any_page OR chosen OR score >= 30) AS ok, (unit = 'table_row' OR i IN (1, 4) OR (unit = 'text' AND i IN (3, 5))) AND score >= 8 AS anc FROM a), c AS (SELECT *, ok AND anc AS hit FROM b),
e AS (SELECT *, ok AND (bool_or(hit) OVER (PARTITION BY d, page ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) OR bool_or(hit AND score >= 24) OVER (PARTITION BY d, page ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS take FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY d, page, i ORDER BY k) AS n FROM e WHERE take) SELECT d AS document_id, k::BIGINT AS k, row_number() OVER (PARTITION BY d ORDER BY unit = 'page', page, k) AS place FROM f WHERE n = 1""")
def evidence_packet(spark, sf):
    return P.evidence(_said(spark, sf)).select("document_id", F.col("span_id").cast("long").alias("k"), F.col("place").cast("long").alias("place"))


@query("WITH n AS (SELECT c_custkey AS k, c_nationkey AS d, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer WHERE c_custkey % 5 <> 2) SELECT d AS document_id, k, place::INT AS place FROM n WHERE place <= 420")
def prompt_nodes(spark, sf):
    k = F.col("c_custkey")
    nodes = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("document_id"), k.alias("id"), k.alias("ord"), F.when(k % 5 == 0, "table").when(k % 5 == 1, "form").otherwise("text").alias("kind"), F.when(k % 5 == 2, "nothing").otherwise("Retention").alias("title"), F.lit("1").alias("path"), F.lit("").alias("description"), F.lit(None).cast("string").alias("text_excerpt"))
    return P.prompt_nodes(nodes).withColumnRenamed("id", "k")


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'source_rag' WHEN 1 THEN 'long_context' WHEN 2 THEN 'graph_only' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'hybrid' ELSE 'graph_only' END END AS mode, CASE WHEN c_custkey % 3 = 0 THEN 'reason,verify,respond' ELSE 'retrieve,reason,verify,respond' END AS steps FROM customer")
def retrieval_plan(spark, sf):
    k = F.col("c_custkey")
    way = RT.mode(F.when(k % 5 == 0, "source_rag"), F.when(k % 5 == 1, "long_context"), F.when(k % 5 == 2, "graph_only"), k % 2 == 0)
    return _t(spark, sf, "customer").select("c_custkey", way.alias("mode"), F.array_join(RT.actions(k % 3 == 1, k % 3 == 2, k % 2 == 0)["steps"], ",").alias("steps"))


@query("SELECT c_custkey, k = 0 OR (k < 3 AND s) AS spans0, NOT s OR k IN (1, 3) AS chunks, f AND k IN (1, 2, 3) AS documents FROM (SELECT c_custkey, c_custkey % 4 AS k, c_custkey % 3 > 0 AS s, c_custkey % 2 = 0 AS f FROM customer)".replace("k = 0 OR (k < 3 AND s) AS spans0", "s AND k IN (0, 1, 2) AS spans"))
def retrieval_branches(spark, sf):
    k = F.col("c_custkey")
    way = F.element_at(F.array(*map(F.lit, ("source_rag", "hybrid", "long_context", "graph_only"))), (k % 4 + 1).cast("int"))
    b = RT.branches(way, k % 3 > 0, k % 2 == 0, F.lit(False))
    return _t(spark, sf, "customer").select("c_custkey", b["spans"].alias("spans"), b["chunks"].alias("chunks"), b["documents"].alias("documents"))


@query("WITH e AS (SELECT user_id AS q, event_id AS k, (event_id % 4) / 4.0::DOUBLE AS r, event_type AS t FROM events), x AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY r DESC, 'chunk||' || k || '||||' || t) AS rank FROM e), y AS (SELECT * FROM x WHERE rank <= 10) SELECT q AS user_id, string_agg('Evidence ' || rank || ' [chunk:' || k || '] (relevance: ' || printf('%.2f', r) || '):' || chr(10) || t, chr(10) || chr(10) ORDER BY rank) AS text FROM y GROUP BY q")
def rendered_evidence(spark, sf):
    k, none = F.col("event_id"), F.lit(None).cast("string")
    rows = _t(spark, sf, "events").select("user_id", F.lit("chunk").alias("source"), k.cast("string").alias("chunk_id"), *(none.alias(c) for c in ("span_id", "node_id", "document_id", "turn_id", "attachment_id")), ((k % 4) / 4.0).alias("relevance"), F.col("event_type").alias("text"))
    return RT.rendered(RT.ranked(rows, "user_id", 10), "user_id")


@query("WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM events) SELECT user_id, event_id FROM x WHERE k <= 4")
def chunks_per_type(spark, sf):
    rows = _t(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("chunk_id"), F.col("value").alias("score"))
    return RT.per_type(rows, "user_id", "event_type", 10, 3).select("user_id", F.col("chunk_id").alias("event_id"))


@query("""WITH c AS (SELECT s_nationkey AS d, count(*) AS n, string_agg('  - ' || s_name || ' | Limit: ' || s_suppkey, chr(10) ORDER BY s_suppkey) FILTER (k <= 10) AS l FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier) GROUP BY 1)
SELECT n_nationkey AS document_id, concat_ws(chr(10), 'Document type: ' || CASE WHEN n_nationkey % 2 = 0 THEN 'policy' ELSE 'quote' END, 'Carrier: ' || n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'Policy #: 7' ELSE 'Quote #: 7' END, CASE WHEN n_nationkey % 2 = 0 THEN 'Effective: a' || chr(10) || 'Expiration: z' ELSE 'Proposed effective: a' END, 'Coverages (' || n || '):' || chr(10) || l) AS text FROM nation LEFT JOIN c ON d = n_nationkey""")
def document_summary(spark, sf):
    one = F.struct("s_suppkey", F.struct(F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("limit"), F.lit("").alias("deductible")).alias("c"))
    covers = _t(spark, sf, "supplier").groupBy("s_nationkey").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).alias("coverages"))
    docs = _t(spark, sf, "nation").join(covers, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    docs = docs.select(F.col("n_nationkey").alias("document_id"), F.when(F.col("n_nationkey") % 2 == 0, "policy").otherwise("quote").alias("type"), F.col("n_name").alias("carrier"), F.lit("").alias("insured"), F.lit("7").alias("number"), F.lit("a").alias("effective"), F.lit("z").alias("expiration"), F.lit(None).cast("string").alias("premium"), "coverages")
    return RT.document_summary(docs)


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'a,b c' WHEN 2 THEN '' ELSE p_name || ',x' END AS ids, CASE p_size % 3 WHEN 0 THEN 'corporation' WHEN 1 THEN 'llc' END AS entity, CASE p_size % 3 WHEN 0 THEN 'named_insured' WHEN 1 THEN 'mga' ELSE 'loss_payee' END AS role, '{\"a\": 1}' AS bare, CASE p_size % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'v2' END AS found FROM part")
def small_parsers(spark, sf):
    z = F.col("p_size")
    ids = F.when(z % 4 == 0, F.lit(None).cast("string")).when(z % 4 == 1, ' ["a", "b c"]').when(z % 4 == 2, "[broken").otherwise(F.concat(F.lit(" "), "p_name", F.lit(",, x ")))
    values = F.array(F.struct(F.when(z % 3 == 0, "Year").otherwise("y").alias("label"), F.lit("d").alias("value")), F.struct(F.when(z % 3 == 1, "the Year made").otherwise("q").alias("label"), F.lit("v2").alias("value")))
    return _t(spark, sf, "part").select("p_partkey", F.array_join(T.id_list(ids), ",").alias("ids"), T.entity_type(F.when(z % 3 == 0, " Inc. ").when(z % 3 == 1, "Limited Liability-Company").otherwise("who knows")).alias("entity"), T.party_role(F.when(z % 3 == 0, "Insured").when(z % 3 == 1, "Managing General-Agent").otherwise("Loss Payee")).alias("role"), T.strip_fences(F.lit('```json\n{"a": 1}\n```')).alias("bare"), T.schedule_value(values, ("year",)).alias("found"))


@query("SELECT p_partkey, nullif(regexp_extract(p_name || ' AB 12 34', '\\b[A-Z]{2,8} \\d{2,5}(?: \\d{2,4})?\\b'), '') AS form, (p_partkey * 7)::DOUBLE AS total, p_size % 3 = 0 AS reason FROM part")
def small_scalars(spark, sf):
    kind = F.when(F.col("p_size") % 3 == 0, "Covered Perils").otherwise("p")
    return _t(spark, sf, "part").select("p_partkey", T.form_number(F.concat("p_name", F.lit(" AB 12 34"))).alias("form"), L.total_cost(F.concat(F.lit("USD $"), F.col("p_partkey") * 7, F.lit(".00 due"))).alias("total"), T.covered_reason(kind, F.lit("x")).alias("reason"))


@query("WITH a AS (SELECT user_id, event_type, min(event_id) AS k FROM events GROUP BY ALL) SELECT user_id, count(*) AS n, min(k) AS first FROM a GROUP BY user_id")
def first_facts(spark, sf):
    rows = _t(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("pos"), F.array(F.col("event_type"), F.col("event_type")).alias("ids"))
    return L.first_facts(rows, ["user_id", "ids"], "pos").groupBy("user_id").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


@query("WITH a AS (SELECT user_id, event_type, min(event_id) AS k FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY k) AS ids FROM a GROUP BY user_id")
def id_union(spark, sf):
    rows = _t(spark, sf, "events").select("user_id", F.col("event_id").alias("pos"), F.array("event_type").alias("ids"))
    return L.union_ids(rows, "user_id", "pos", "ids").select("user_id", F.array_join("ids", ",").alias("ids"))


@query("WITH i AS (SELECT user_id, floor(epoch(ts))::BIGINT // 3600 AS a, event_type FROM events) SELECT DISTINCT user_id, a, event_type FROM i")
def distinct_union(spark, sf):
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    rows = _t(spark, sf, "events").select("user_id", hour.alias("a"), "event_type")
    return rows.where("event_type < 'm'").union(rows.where("event_type >= 'e'")).distinct()




@query("""WITH p AS (SELECT p_brand AS d, p_partkey AS k, p_size % 5 + 1 AS page, p_size % 3 AS u, p_name AS t, p_type AS form FROM part), e AS (SELECT *, row_number() OVER (PARTITION BY d, page ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY d, page) AS n FROM p),
f AS (SELECT d, page, form, min(k) AS k FROM p GROUP BY ALL), g AS (SELECT d, page, string_agg(form, ',' ORDER BY k) AS forms FROM f GROUP BY ALL),
w AS (SELECT DISTINCT d, page, n, CASE WHEN n <= 18 THEN j ELSE floor(j * (n - 1) / 17.0 + 0.5)::BIGINT END AS i, j FROM e, unnest(range(0, 18)) r(j) WHERE j < n),
s AS (SELECT w.d, w.page, string_agg(e.k || '=' || t, '|' ORDER BY j) AS samples FROM w JOIN e ON w.d = e.d AND w.page = e.page AND w.i = e.i GROUP BY ALL),
x AS (SELECT DISTINCT d, page, n, CASE WHEN n <= 20 THEN j ELSE floor(j * (n - 1) / 19.0 + 0.5)::BIGINT END AS i, j FROM e, unnest(range(0, 20)) r(j) WHERE j < n), y AS (SELECT x.d, x.page, string_agg('n' || e.k, ',' ORDER BY j) AS structure FROM x JOIN e ON x.d = e.d AND x.page = e.page AND x.i = e.i GROUP BY ALL)
SELECT p.d AS document_id, p.page::INTEGER AS page, count(*) FILTER (u = 1) AS rows, count(*) FILTER (u = 2) AS cells, any_value(forms) AS forms, any_value(structure) AS structure, any_value(samples) AS samples FROM p JOIN g USING (d, page) JOIN s USING (d, page) JOIN y USING (d, page) GROUP BY p.d, p.page""")
def page_sketches(spark, sf):
    k = F.col("p_partkey")
    page = (F.col("p_size") % 5 + 1).cast("int")
    parts = _t(spark, sf, "part")
    spans = parts.select(F.col("p_brand").alias("document_id"), F.lpad(k.cast("string"), 9, "0").alias("id"), page.alias("page_start"), page.alias("page_end"), F.when(F.col("p_size") % 3 == 1, "table_row").when(F.col("p_size") % 3 == 2, "table_cell").otherwise("text").alias("source_unit"), F.concat(F.lit("  "), "p_name").alias("text"), F.col("p_type").alias("form_number"))
    nodes = parts.select(F.col("p_brand").alias("document_id"), F.concat(F.lit("n"), k).alias("id"), F.lit("page").alias("kind"), F.lit("T").alias("title"), F.lit("1").alias("path"), k.alias("ord"), page.alias("page_start"), page.alias("page_end"), F.array(F.lit("s")).alias("source_span_ids"))
    rows = V.page_sketch(spans, nodes)
    said = F.array_join(F.transform("samples", lambda x: F.concat(x["span_id"].cast("long").cast("string"), F.lit("="), x["text"])), "|")
    return rows.select("document_id", "page", "rows", "cells", F.array_join("forms", ",").alias("forms"), F.array_join(F.transform("structure", lambda x: x["id"]), ",").alias("structure"), said.alias("samples"))
