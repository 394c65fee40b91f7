"""Queries of whole documents: chunks, items of parsed documents, profiles of older shape, context keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contexts as X
from ..operators import chunks as K
from ..operators import templates as L
from ..operators import evidence as E
from ..operators import grouping as G
from ..operators import materialize as M
from ..operators import parsed as D
from ..operators import projections as J
from ..sources.scratch import spread
from .queries import _t, query


def _policies(spark, sf):
    """Customers as policies and quotes, with a coverage, a section, a form or a claim for each of their orders."""
    o = _t(spark, sf, "orders").select("o_custkey", F.struct("o_orderkey", "o_orderstatus", "o_orderpriority").alias("o"))
    held = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o")).alias("l"))
    rows = _t(spark, sf, "customer").join(held, F.col("c_custkey") == F.col("o_custkey"), "left")
    k, l, s = F.col("c_custkey"), F.coalesce("l", F.array().cast("array<struct<o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string>>")), lambda c: c.cast("string")
    of = lambda f: F.transform(l, f)
    deductible = lambda x: F.when(x["o_orderkey"] % 4 != 0, x["o_orderpriority"]).otherwise("")
    doc = F.struct(
        F.when(k % 3 == 0, "quote").otherwise("policy").alias("type"),
        F.col("c_mktsegment").alias("carrier"),
        (k % 2 == 0).alias("isRenewal"),
        F.when(k % 4 == 0, F.array(F.lit("GL"), F.col("c_mktsegment"))).alias("linesOfBusiness"),
        F.col("c_name").alias("insuredName"),
        F.struct(F.lit("1 Main").alias("street1"), F.lit("").alias("street2"), F.lit("Town").alias("city"), F.lit("TX").alias("state"), s(F.col("c_nationkey")).alias("zip")).alias("insuredAddress"),
        F.concat(F.lit("P-"), k).alias("policyNumber"),
        F.concat(F.lit("Q-"), k).alias("quoteNumber"),
        F.lit("01/01/2024").alias("effectiveDate"),
        of(lambda x: F.struct(F.concat(F.lit("Cover "), x["o_orderkey"]).alias("name"), x["o_orderstatus"].alias("limit"), deductible(x).alias("deductible"), (x["o_orderkey"] % 5).alias("pageNumber"))).alias("coverages"),
        F.when(k % 4 == 1, F.struct(s(F.col("c_nationkey")).alias("perOccurrence"), (k % 8 == 1).alias("statutory"), of(lambda x: F.struct(x["o_orderpriority"].alias("name"), x["o_orderstatus"].alias("limit"))).alias("sublimits"))).alias("limits"),
        of(lambda x: F.struct(x["o_orderpriority"].alias("title"), F.lit("body").alias("type"), x["o_orderkey"].alias("pageStart"), F.when(x["o_orderkey"] % 2 == 0, x["o_orderkey"] + 1).alias("pageEnd"), F.when(x["o_orderkey"] % 3 == 0, F.array(F.struct(x["o_orderstatus"].alias("title")), F.struct(F.lit("Z").alias("title")))).alias("subsections"))).alias("sections"),
        of(lambda x: F.struct(F.when(x["o_orderkey"] % 2 == 0, x["o_orderstatus"]).alias("term"), x["o_orderpriority"].alias("content"))).alias("definitions"),
        of(lambda x: F.struct(x["o_orderpriority"].alias("name"), x["o_orderstatus"].alias("amount"), F.when(x["o_orderkey"] % 2 == 1, "tax").alias("type"))).alias("taxesAndFees"),
        F.when(k % 5 == 0, F.array(F.struct(F.col("c_name").alias("name"), F.lit("555").alias("phone")))).alias("claimsContacts"),
        F.when(k % 2 == 1, k % 3).alias("cancellationNoticeDays"),
        of(lambda x: F.struct(F.lit("status").alias("key"), x["o_orderstatus"].alias("value"), F.when(x["o_orderkey"] % 2 == 0, F.lit("order")).alias("subject"))).alias("supplementaryFacts"),
    )
    made = rows.select(s(k).alias("document_id"), F.to_json(doc).alias("json"))
    return made.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "document_id")  # a table of documents is read by many tasks


@query("""WITH c AS (SELECT *, c_custkey AS k, c_custkey::VARCHAR AS d, CASE WHEN c_custkey % 3 = 0 THEN 'quote' ELSE 'policy' END AS t FROM customer),
o AS (SELECT c.*, o_orderkey AS ok, o_orderstatus AS st, o_orderpriority AS pr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM c JOIN orders ON o_custkey = c_custkey),
r AS (
SELECT k, d || ':carrier_info:0' AS id, 'carrier_info' AS type, 'Carrier: ' || c_mktsegment || chr(10) || 'Renewal: ' || CASE WHEN k % 2 = 0 THEN 'Yes' ELSE 'No' END || CASE WHEN k % 4 = 0 THEN chr(10) || 'Lines of Business: GL, ' || c_mktsegment ELSE '' END AS text, 3 AS n FROM c
UNION ALL SELECT k, d || ':declaration:' || t || '_details', 'declaration', CASE t WHEN 'quote' THEN 'Quote Number: Q-' || k ELSE 'Policy Number: P-' || k || chr(10) || 'Effective Date: 01/01/2024' END, CASE t WHEN 'quote' THEN 3 ELSE 4 END FROM c
UNION ALL SELECT k, d || ':named_insured:0', 'named_insured', 'Insured: ' || c_name || chr(10) || 'Address: 1 Main, Town, TX, ' || c_nationkey, 3 FROM c
UNION ALL SELECT k, d || ':coverage:' || i, 'coverage', 'Coverage: Cover ' || ok || chr(10) || 'Limit: ' || st || CASE WHEN ok % 4 <> 0 THEN chr(10) || 'Deductible: ' || pr ELSE '' END, 5 + (ok % 4 <> 0)::INT FROM o
UNION ALL SELECT k, d || ':coverage:limit_schedule', 'coverage', 'Limit Schedule' || chr(10) || 'Per Occurrence: ' || c_nationkey || CASE WHEN k % 8 = 1 THEN chr(10) || 'Statutory: Yes' ELSE '' END, 3 FROM c WHERE k % 4 = 1
UNION ALL SELECT k, d || ':coverage:sublimit:' || i, 'coverage', 'Sublimit: ' || pr || chr(10) || 'Limit: ' || st, 4 FROM o WHERE k % 4 = 1
UNION ALL SELECT k, d || ':section:' || i, 'section', 'Section: ' || pr || chr(10) || 'Type: body' || chr(10) || 'Pages: ' || ok || CASE WHEN ok % 2 = 0 THEN '-' || (ok + 1) ELSE '' END || CASE WHEN ok % 3 = 0 THEN chr(10) || 'Subsections: ' || st || ', Z' ELSE '' END, 4 + (ok % 2 = 0)::INT + (ok % 3 = 0)::INT FROM o
UNION ALL SELECT k, d || ':section:' || i || ':sub:' || j, 'section', 'Section: ' || pr || ' > ' || CASE j WHEN 0 THEN st ELSE 'Z' END, 4 FROM o, (VALUES (0), (1)) s(j) WHERE ok % 3 = 0
UNION ALL SELECT k, d || ':definition:' || i, 'definition', 'Definition: ' || CASE WHEN ok % 2 = 0 THEN st ELSE 'Definition ' || (i + 1) END || chr(10) || pr, 3 FROM o
UNION ALL SELECT k, d || ':financial:taxes_fees', 'financial', string_agg(CASE WHEN ok % 2 = 1 THEN '[tax] ' ELSE '' END || pr || ': ' || st, chr(10) ORDER BY i), 2 FROM o GROUP BY k, d
UNION ALL SELECT k, d || ':supplementary:0', 'supplementary', 'Claims Contact: ' || c_name || ' | 555', 2 FROM c WHERE k % 5 = 0
UNION ALL SELECT k, d || ':supplementary:' || (k % 5 = 0)::INT, 'supplementary', 'Cancellation Notice Days: ' || k % 3, 2 FROM c WHERE k % 2 = 1
UNION ALL SELECT k, d || ':supplementary:' || (k % 5 = 0)::INT + (k % 2 = 1)::INT + i, 'supplementary', CASE WHEN ok % 2 = 0 THEN 'Subject: order | ' ELSE '' END || 'status: ' || st, 3 + (ok % 2 = 0)::INT FROM o)
SELECT id, type, text, n + (k % 4 = 0)::INT AS n_metadata FROM r""")
def document_chunks(spark, sf):
    return K.document_chunks(_policies(spark, sf)).select("id", "type", "text", F.size("metadata").alias("n_metadata"))


PAGES = """p AS (SELECT c_nationkey AS d, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)"""
NODE = "id string, document_id string, parent_id string, kind string, title string, description string, text_excerpt string, source_span_ids array<string>, page_start int, page_end int, ord double, marked boolean"


def _node(df, key, parent, kind, title, text, page, ord_, marked=None):
    """Rows as nodes of a tree; a document's root is 'r' and its number."""
    made = {"id": key, "document_id": F.col("d").cast("string"), "parent_id": parent, "kind": kind, "title": title, "description": F.lit(""), "text_excerpt": text, "source_span_ids": F.array(key), "page_start": page, "page_end": page, "ord": ord_, "marked": F.lit(False) if marked is None else marked}
    return df.select(*(made[c.split()[0]].cast(c.split()[1]).alias(c.split()[0]) for c in NODE.split(", ")))


def _numbered(spark, sf):
    from pyspark.sql import Window

    return _t(spark, sf, "customer").select(F.col("c_nationkey").alias("d"), F.col("c_custkey").alias("k"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("r"))


def _roots(rows, kind="document"):
    null = F.lit(None).cast("string")
    return _node(rows.select("d").distinct(), F.concat(F.lit("r"), "d"), null, F.lit(kind), F.lit("Document"), null, F.lit(None), F.lit(0))


def _policy_pages(spark, sf):
    """A document for each nation, a page for each of its customers."""
    rows, r = _numbered(spark, sf), F.col("r")
    text = F.when(r <= 2, "PRIVACY NOTICE TO POLICYHOLDERS").when(r == 3, "DECLARATIONS PAGE").when(r == 4, "premium due").when(r == 5, "POLICY FORM begins").when(r % 4 == 0, F.concat(F.lit("Endorsement No. "), r, F.lit(" This endorsement changes the policy"))).when((r > 5) & (r % 4 == 1), "all other terms and conditions").otherwise("more words")
    return _roots(rows).unionByName(_node(rows, F.col("k").cast("string"), F.concat(F.lit("r"), "d"), F.lit("page"), F.concat(F.lit("Page "), r), text, r, r))


def _with_parent(nodes):
    up = nodes.select(F.col("id").alias("_p"), F.col("title").alias("parent"))
    return nodes.join(up, F.col("parent_id") == F.col("_p"), "left").where(F.col("id").rlike(r"^\d+\z")).select("id", "title", "kind", "parent")


@query("""WITH p AS (SELECT c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer)
SELECT k::VARCHAR AS id, CASE WHEN r <= 2 THEN 'PRIVACY NOTICE TO POLICYHOLDERS' WHEN r = 3 THEN 'Declarations' WHEN r = 5 THEN 'Policy Form' WHEN r > 5 AND r % 4 = 0 THEN 'Endorsement No. ' || r ELSE 'Page ' || r END AS title, CASE WHEN r > 5 AND r % 4 = 0 THEN 'endorsement' ELSE 'page' END AS kind FROM p""")
def named_pages(spark, sf):
    return G.named_pages(_policy_pages(spark, sf)).where("kind <> 'document'").select("id", "title", "kind")


@query(f"WITH {PAGES} SELECT k::VARCHAR AS id, CASE WHEN r <= 2 AND n >= 3 THEN 'Notices and Jacket' WHEN r IN (3, 4) THEN 'Declarations' WHEN r IN (5, 6, 7) THEN 'Policy Form' ELSE 'Document' END AS parent FROM p")
def page_groups(spark, sf):
    return _with_parent(G.page_groups(G.named_pages(_policy_pages(spark, sf)))).select("id", "parent")


@query(f"WITH {PAGES} SELECT k::VARCHAR AS id, CASE WHEN r > 7 AND r % 4 IN (0, 1) THEN 'Endorsements' ELSE 'Document' END AS parent, CASE WHEN r > 5 AND r % 4 = 0 THEN 'endorsement' ELSE 'page' END AS kind FROM p")
def endorsement_groups(spark, sf):
    return _with_parent(G.endorsement_groups(_policy_pages(spark, sf))).select("id", "parent", "kind")


@query(f"""WITH {PAGES}, o AS (SELECT *, r > 7 AND r % 4 IN (2, 3) AS free, sum((r > 7 AND r % 4 IN (2, 3))::INT) OVER (PARTITION BY d ORDER BY r) AS nth, sum((r > 7 AND r % 4 IN (2, 3))::INT) OVER (PARTITION BY d) AS m FROM p)
SELECT k::VARCHAR AS id, '1.' || CASE WHEN n < 3 THEN r::VARCHAR WHEN r <= 2 THEN '1.' || r WHEN r <= 4 THEN '2.' || (r - 2) WHEN r <= 7 THEN '3.' || (r - 4) WHEN free THEN (3 + nth)::VARCHAR ELSE (4 + m) || '.' || (r // 4 - 1) || CASE WHEN r % 4 = 1 THEN '.1' ELSE '' END END AS path FROM o""")
def organized_tree(spark, sf):
    return G.organized_tree(_policy_pages(spark, sf)).where(F.col("id").rlike(r"^\d+\z")).select("id", "path")


@query(f"""WITH {PAGES}, h AS (SELECT *, CASE WHEN r % 3 = 1 THEN k END AS head FROM p), o AS (SELECT *, max(head) OVER (PARTITION BY d ORDER BY r) AS over FROM h)
SELECT 'a' || k AS id, CASE WHEN r % 3 = 1 THEN 'r' || d ELSE 'a' || over END AS parent_id, CASE WHEN r % 3 = 1 THEN 'section' ELSE 'text' END AS kind, CASE WHEN r % 3 = 1 THEN 'SECTION ' || r || ' section; page ' || r ELSE '' END AS description FROM o
UNION ALL SELECT 'b' || k, 'a' || over, 'text', '' FROM o""")
def title_sections(spark, sf):
    rows = _numbered(spark, sf)
    page, head = F.concat(F.lit("p"), "k"), F.col("r") % 3 == 1
    nodes = _roots(rows, "form").unionByName(_node(rows, page, F.concat(F.lit("r"), "d"), F.lit("page"), F.concat(F.lit("Page "), "r"), F.lit(""), F.col("r"), F.col("r")))
    text = lambda name, said, at, marked: _node(rows, F.concat(F.lit(name), "k"), page, F.lit("text"), said, said, F.col("r"), F.col("r") + at, marked)
    nodes = nodes.unionByName(text("a", F.when(head, F.concat(F.lit("SECTION "), "r")).otherwise("some words"), 0.1, head)).unionByName(text("b", F.lit("MORE"), 0.2, F.lit(False)))
    return G.title_sections(nodes).where("kind NOT IN ('form', 'page')").select("id", "parent_id", "kind", "description")


@query("""WITH f AS (SELECT p_partkey AS k, p_brand AS b, row_number() OVER (PARTITION BY p_brand, p_partkey % 5 = 0 ORDER BY p_partkey) AS i FROM part), x AS (SELECT b, max(k) FILTER (k % 5 = 0 AND i = 1) AS inner_ FROM f GROUP BY b)
SELECT k::VARCHAR AS id, CASE WHEN k % 7 = 0 AND k % 5 <> 0 THEN 'root' ELSE 'f' || f.b END AS parent_id FROM f JOIN x USING (b) WHERE k IS DISTINCT FROM inner_
UNION ALL SELECT 'x' || k, 'f' || b FROM f WHERE k % 5 = 0 AND i = 1
UNION ALL SELECT 'x' || k, k::VARCHAR FROM f WHERE k % 5 = 0 AND i > 1""")
def plain_policy_forms(spark, sf):
    rows = _t(spark, sf, "part").select(F.lit(0).alias("d"), F.col("p_partkey").alias("k"), "p_brand")
    k, form = F.col("k"), F.concat(F.lit("f"), "p_brand")
    tops = _node(rows.select("d", "p_brand").distinct(), form, F.lit("root"), F.lit("form"), F.lit("Policy Form"), F.lit(""), F.lit(1), F.lit(1))
    kind = F.when((k % 5 == 0) | (k % 7 == 0), "page_group").otherwise("page")
    kids = _node(rows, k.cast("string"), form, kind, F.when(k % 5 == 0, "Policy Form").when(k % 7 == 0, "Declarations").otherwise("T"), F.lit(""), F.lit(1), k)
    below = _node(rows.where("k % 5 = 0"), F.concat(F.lit("x"), "k"), k.cast("string"), F.lit("page"), F.lit("T"), F.lit(""), F.lit(1), k)
    return G.plain_forms(tops.unionByName(kids).unionByName(below)).where("kind <> 'form'").select("id", "parent_id")


def _parsed_talk(spark, sf):
    """Conversations as parsed documents whose body reaches the odd turns, held in a group, before the even ones."""
    t = F.struct("turn", F.struct(F.concat(F.lit("#/texts/t"), "turn").alias("self_ref"), F.col("role").alias("label"), "text", F.array(F.struct((F.col("turn") % 5 + 1).alias("page_no"))).alias("prov")).alias("item"))
    rows = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(t)).alias("l"))
    refs = lambda odd: F.transform(F.filter("l", lambda x: x["turn"] % 2 == odd), lambda x: F.struct(x["item"]["self_ref"].alias("$ref")))
    texts = F.transform("l", lambda x: x["item"])
    body = F.struct(F.concat(F.array(F.struct(F.lit("#/groups/0").alias("$ref"))), refs(0)).alias("children"))
    return rows.select(F.col("conv_id").alias("document_id"), F.to_json(F.struct(texts.alias("texts"), F.array(F.struct(refs(1).alias("children"))).alias("groups"), body.alias("body"))).alias("json"))


TALK = r"WITH c AS (SELECT conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations), u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 2 DESC, turn) - 1 AS i FROM c WHERE t <> '')"


@query(f"{TALK} SELECT conv_id AS document_id, i, '#/texts/t' || turn AS ref, t AS text, (turn % 5 + 1)::INT AS page_start FROM u")
def parsed_units(spark, sf):
    return D.units(_parsed_talk(spark, sf)).select("document_id", F.col("i").cast("long").alias("i"), "ref", "text", "page_start")


@query(f"""{TALK}, p AS (SELECT conv_id, turn % 5 + 1 AS p, string_agg(t, chr(10) || chr(10) ORDER BY i) AS t FROM u GROUP BY 1, 2), w AS (SELECT conv_id, max(p)::INT AS n, string_agg('Page ' || p || chr(10) || t, chr(10) || chr(10) ORDER BY p) AS text FROM p GROUP BY conv_id)
SELECT DISTINCT c.conv_id AS document_id, coalesce(n, 1) AS page_count, coalesce(w.text, '') AS text FROM c LEFT JOIN w USING (conv_id)""")
def parsed_text(spark, sf):
    documents = _parsed_talk(spark, sf)
    return D.parsed_text(documents, D.units(documents))


@query("""WITH s AS (SELECT s_nationkey AS d, s_suppkey, s_name AS a, CASE WHEN s_suppkey % 3 <> 0 THEN 'k' || s_suppkey END AS b, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier)
SELECT d::VARCHAR AS document_id, 0 AS pos, 'table' AS source_unit, '| Name | Key | | --- | --- |' || string_agg(' | ' || a || ' | ' || coalesce(b || ' ', '') || '|', '' ORDER BY r) AS text, NULL AS column_name FROM s GROUP BY d
UNION ALL SELECT DISTINCT d::VARCHAR, 1, 'table_row', 'Name | Key', NULL FROM s
UNION ALL SELECT DISTINCT d::VARCHAR, 100 + c, 'table_cell', t, t FROM s, (VALUES (0, 'Name'), (1, 'Key')) h(c, t)
UNION ALL SELECT d::VARCHAR, 1 + r, 'table_row', 'Name: ' || a || coalesce(' | Key: ' || b, ''), NULL FROM s
UNION ALL SELECT d::VARCHAR, 100 + r * 100, 'table_cell', a, 'Name' FROM s
UNION ALL SELECT d::VARCHAR, 101 + r * 100, 'table_cell', b, 'Key' FROM s WHERE b IS NOT NULL""")
def parsed_tables(spark, sf):
    """Suppliers as a table of their nation's document; texts of spans are normalised, so a table's lines run on."""
    from pyspark.sql import Window

    rows = _t(spark, sf, "supplier").withColumn("r", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")))
    cell = lambda row, col, text: F.struct(row.cast("int").alias("start_row_offset"), F.lit(col).alias("start_col_offset"), text.alias("text"))
    cells = F.array(cell(F.col("r"), 0, F.col("s_name")), cell(F.col("r"), 1, F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("k"), "s_suppkey")).otherwise(" ")))
    held = rows.groupBy(F.col("s_nationkey").cast("string").alias("document_id")).agg(F.flatten(F.collect_list(cells)).alias("l"))
    head = F.array(cell(F.lit(0), 0, F.lit("Name")), cell(F.lit(0), 1, F.lit("Key")))
    made = held.select("document_id", F.to_json(F.struct(F.array(F.struct(F.lit("table").alias("label"), F.struct(F.concat(head, "l").alias("table_cells")).alias("data"))).alias("tables"))).alias("json"))
    return D.parsed_spans(D.units(made)).select("document_id", "pos", "source_unit", "text", "column_name")


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) AND NOT (o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0)")
def eligible_proposals(spark, sf):
    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderpriority")
    held = orders.join(_t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    codes = F.when(F.col("id") % 4 == 0, "unknown_source").when(F.col("id") % 4 == 2, "quote_not_found").otherwise("low_confidence")
    issues = orders.select("id", codes.alias("code"), F.when(F.col("o_orderpriority") == "1-URGENT", "blocking").otherwise("warning").alias("severity"))
    return E.eligible_proposals(held, issues).select("id")


@query("SELECT p_partkey::VARCHAR AS id, substr(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE repeat(p_type, 60) END, 1, CASE p_partkey % 4 WHEN 0 THEN 260 WHEN 1 THEN 520 ELSE 360 END) AS text, 8 AS n FROM part")
def compact_nodes(spark, sf):
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "page").when(k % 4 == 1, "table_row").otherwise("text")
    rows = _t(spark, sf, "part").select(k.cast("string").alias("id"), kind.alias("kind"), F.col("p_name").alias("title"), F.lit("1").alias("path"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.array_repeat(F.lit("s"), 9).alias("source_span_ids"), F.when(k % 3 != 0, F.repeat("p_type", 60)).alias("text_excerpt"), F.col("p_name").alias("description"))
    return J.compact_nodes(rows, cleanup=True).select("id", "text", F.size("source_span_ids").alias("n"))


def _tree(spark, sf):
    n = _t(spark, sf, "nation")
    null, spans = F.lit(None).cast("string"), lambda name, key: F.concat(F.lit(name), key)
    made = lambda df, doc, key, parent, kind, ord_, span: df.select(doc.alias("document_id"), key.alias("id"), parent.alias("parent_id"), F.lit(kind).alias("kind"), ord_.alias("ord"), F.lit("t").alias("title"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), null.alias("text_excerpt"), F.array(span).alias("source_span_ids"))
    region = F.col("n_regionkey")
    tree = made(n.select("n_regionkey").distinct(), region, spans("r", region), null, "document", F.lit(0).cast("long"), F.lit("r"))
    tree = tree.unionByName(made(n, region, F.col("n_nationkey").cast("string"), spans("r", region), "page", F.col("n_nationkey").cast("long"), spans("n", F.col("n_nationkey"))))
    c = _t(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    tree = tree.unionByName(made(c, region, spans("c", F.col("c_custkey")), F.col("c_nationkey").cast("string"), "text", F.col("c_custkey"), spans("c", F.col("c_custkey"))))
    return tree


@query("""SELECT n_nationkey::VARCHAR AS id, NULL AS parent_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place, 'n' || n_nationkey AS source_text_hash FROM nation
UNION ALL SELECT 'c' || c_custkey, c_nationkey::VARCHAR, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 'c' || c_custkey FROM customer""")
def tree_outline(spark, sf):
    return J.outline(_tree(spark, sf)).select("id", "parent_id", F.col("place").cast("long").alias("place"), "source_text_hash")


OUTLINE_NODE = """'{{"id":"' || {id} || '","title":"t","type":"{kind}","label":"{kind}","pageStart":1,"pageEnd":1,"sourceSpanIds":["' || {span} || '"],"sourceTextHash":"' || {span} || '","interpretationLabels":["{kind}"],"children":[' || {children} || ']}}'"""
CUSTOMER = OUTLINE_NODE.format(id="'c' || c_custkey", kind="text", span="'c' || c_custkey", children="''")
NATION = OUTLINE_NODE.format(id="n_nationkey", kind="page", span="'n' || n_nationkey", children="coalesce(l, '')")


@query(f"WITH c AS (SELECT c_nationkey AS k, string_agg({CUSTOMER}, ',' ORDER BY c_custkey) AS l FROM customer GROUP BY 1), n AS (SELECT n_regionkey, n_nationkey, {NATION} AS t FROM nation LEFT JOIN c ON k = n_nationkey) SELECT n_regionkey AS document_id, '[' || string_agg(t, ',' ORDER BY n_nationkey) || ']' AS outline FROM n GROUP BY 1")
def tree_outline_nested(spark, sf):
    return J.nested_outline(_tree(spark, sf))


@query("""SELECT c_custkey, 'Cover ' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ' GL' ELSE '' END || ' limit Each ' || c_mktsegment AS text, c_custkey % 3 = 0 AS named, CASE c_custkey % 3 WHEN 0 THEN '0,1' WHEN 1 THEN '1' ELSE '' END AS entries FROM customer""")
def cleanup_texts(spark, sf):
    k = F.col("c_custkey")
    line = F.when(k % 2 == 0, "GL").otherwise("")
    none = F.lit(None).cast("string")
    cover = F.struct(F.concat(F.lit("Cover "), k).alias("name"), line.alias("line_of_business"), *(none.alias(c) for c in ("coverage_code", "limit", "deductible", "premium", "retroactive_date", "section_ref", "endorsement_number")), F.array(F.struct(F.lit("limit").alias("kind"), F.lit("Each").alias("label"), F.col("c_mktsegment").alias("value"), none.alias("applies_to"))).alias("limits"))
    terms = F.array(F.lit("abcd"), F.when(k % 3 == 0, "each ").otherwise("eachx"))
    indexes = F.when(k % 3 == 1, F.array(F.lit(1), F.lit(7), F.lit(1))).when(k % 3 == 2, F.array(F.lit(2)))
    text = J.coverage_text(F.col("c"))
    return _t(spark, sf, "customer").withColumn("c", cover).select("c_custkey", text.alias("text"), J.names_a_term(J.node_text(F.lit("text"), F.lit("abcd"), F.lit(""), text), terms).alias("named"), F.array_join(F.transform(J.chosen_entries(F.array("c_name", "c_mktsegment"), indexes), lambda e: e["index"].cast("string")), ",").alias("entries"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'GL' WHEN 1 THEN c_mktsegment || ',X' END AS line FROM customer")
def profile_lines(spark, sf):
    k = F.col("c_custkey")
    old = F.concat(F.lit('{"policyTypes": ["'), "c_mktsegment", F.lit('", 3, "X"]}'))
    json = F.when(k % 4 == 0, '{"linesOfBusiness": ["GL"], "policyTypes": ["Y"]}').when(k % 4 == 1, old).when(k % 4 == 2, '{"linesOfBusiness": null, "policyTypes": ["Y"]}').otherwise("no profile")
    return _t(spark, sf, "customer").select("c_custkey", F.array_join(J.lines_of_profile(json), ",").alias("line"))


@query("""SELECT c_custkey, 'company_info' AS category, 'company_name' AS context_key, regexp_replace('s_' || lower(c_mktsegment), '[^a-z0-9]+', '_', 'g') AS field_key FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'company_info', unnest(['company_address', 'primary_residence_address']), 's_' || lower(c_mktsegment) FROM customer WHERE c_custkey % 3 = 1""")
def context_values(spark, sf):
    k = F.col("c_custkey")
    facts = _t(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.when(k % 3 == 0, "insuredName").when(k % 3 == 1, "insuredAddress").otherwise("unknown").alias("field"))
    return X.context_values(facts).select("c_custkey", "category", "context_key", X.context_key(F.lit(" S"), F.concat("c_mktsegment", F.lit("!"))).alias("field_key"))


@query("""SELECT p_partkey::VARCHAR AS document_id, 'reason' AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'Form' ELSE 'Named Peril ' || p_name END AS name, p_type AS content FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0
UNION ALL SELECT p_partkey::VARCHAR, 'definition', p_name, p_type FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 5 <> 0""")
def derived_facts(spark, sf):
    k, null = F.col("p_partkey"), F.lit(None).cast("string")
    title = F.when(k % 3 == 0, F.concat(F.lit("Named Peril "), "p_name")).otherwise(F.col("p_name"))
    rows = _t(spark, sf, "part").select(k.cast("string").alias("document_id"), F.when(k % 3 == 1, "Definition").otherwise("other").alias("type"), title.alias("title"), F.when(k % 5 == 0, " ").otherwise(F.col("p_type")).alias("content"), null.alias("coverage_name"), F.when(k % 2 == 0, "Form").alias("form_title"), null.alias("form_number"), null.alias("section_number"), F.lit(1).alias("page_start"))
    reasons = J.derived_reasons(rows).select("document_id", F.lit("reason").alias("kind"), F.col("coverage_name").alias("name"), "content")
    return reasons.unionByName(J.derived_definitions(rows).select("document_id", F.lit("definition").alias("kind"), F.col("term").alias("name"), F.col("definition").alias("content")))


@query("""WITH c AS (SELECT *, c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'Unknown' ELSE 'P' || c_custkey END AS n, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' B' ELSE c_mktsegment || ' A' END AS carrier FROM customer)
SELECT k::VARCHAR AS document_id, CASE WHEN k % 3 = 0 THEN 'quote' ELSE 'policy' END AS type, n AS number, carrier, CASE WHEN k % 2 = 0 THEN 'T' END AS town, CASE WHEN k % 4 = 0 THEN 'llc' END AS entity, carrier || CASE WHEN k % 5 = 0 THEN '' ELSE ' #' || n END || ' for ' || c_name AS summary FROM c""")
def documents_of_profiles(spark, sf):
    """Customers as profiles with two insurers: the one with an address counts, if there is one, else the first."""
    k, source = F.col("c_custkey"), F.array(F.lit("s")).alias("sourceSpanIds")
    home = F.struct(*(F.lit(v).alias(n) for n, v in (("street1", "1 A"), ("city", "T"), ("state", "S"), ("zip", "9"))))
    party = lambda name, where: F.struct(F.lit("insurer").alias("role"), F.concat("c_mktsegment", F.lit(name)).alias("name"), where.alias("address"), source)
    number = F.when(k % 5 != 0, F.struct(F.lit("raw").alias("value"), F.concat(F.lit("P"), k).alias("normalizedValue")))
    facts = F.when(k % 4 == 0, F.array(F.struct(F.lit("entityType").alias("field"), F.lit("LLC").alias("value"), source)))
    doc = F.struct(F.when(k % 3 == 0, "quote").otherwise("policy").alias("documentType"), number.alias("policyNumber"), F.struct(F.col("c_name").alias("value")).alias("namedInsured"), F.array(party(" A", F.when(k % 2 > 1, home)), party(" B", F.when(k % 2 == 0, home))).alias("parties"), facts.alias("declarationFacts"))
    made = M.documents_of_profiles(spread(_t(spark, sf, "customer"), "c_custkey").select(k.cast("string").alias("document_id"), F.to_json(doc).alias("json")))
    at = lambda p: F.get_json_object("json", f"$.{p}")
    return made.select("document_id", at("type").alias("type"), F.coalesce(at("policyNumber"), at("quoteNumber")).alias("number"), at("carrier").alias("carrier"), at("insurer.address.city").alias("town"), at("insuredEntityType").alias("entity"), at("summary").alias("summary"))


@query("""WITH n AS (SELECT c_custkey AS d, ['renters_ho4', 'cyber', 'flood_nfip', 'nonsense', NULL][c_custkey % 5 + 1] AS t FROM customer), m AS (SELECT d, CASE t WHEN 'renters_ho4' THEN 'homeowners' WHEN 'cyber' THEN 'cyber' ELSE 'unknown' END AS template FROM n),
w AS (SELECT d, template, unnest(CASE template WHEN 'homeowners' THEN ['declarations', 'conditions'] WHEN 'cyber' THEN ['breach', 'declarations'] ELSE ['carrier_info', 'named_insured', 'coverage_limits', 'endorsements', 'exclusions', 'conditions', 'premium_breakdown', 'sections'] END) AS section FROM m),
h AS (SELECT DISTINCT o_custkey AS d, ['declarations', 'carrier_info', 'conditions', 'other'][o_orderkey % 4 + 1] AS section FROM orders)
SELECT w.d AS document_id, template, section, CASE WHEN section IN ('declarations', 'breach', 'carrier_info', 'named_insured', 'coverage_limits') THEN 'required' ELSE 'expected' END AS standing, CASE WHEN section = 'breach' THEN 'last page' WHEN template = 'unknown' AND section = 'endorsements' THEN 'last 25%' WHEN template = 'homeowners' AND section = 'declarations' THEN 'first 3 pages' END AS hint FROM w ANTI JOIN h ON w.d = h.d AND w.section = h.section""")
def section_gaps(spark, sf):
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    types = F.array(*(F.lit(t) for t in ("renters_ho4", "cyber", "flood_nfip", "nonsense", None)))
    documents = _t(spark, sf, "customer").select(c.alias("document_id"), F.get(types, (c % 5).cast("int")).alias("policy_type"))
    held = _t(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.get(F.array(*map(F.lit, ("declarations", "carrier_info", "conditions", "other"))), (k % 4).cast("int")).alias("section"))
    rows = [("homeowners", ["declarations", "conditions"], ["declarations"], ["sections"], {"declarations": "first 3 pages"}), ("cyber", ["declarations"], ["breach", "declarations"], [], {"breach": "last page"})]
    templates = spark.createDataFrame(rows, "type string, expected array<string>, required array<string>, optional array<string>, hints map<string,string>")
    return L.section_gaps(documents, held, templates)
