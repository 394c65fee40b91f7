"""Queries of source spans, chunks, trees and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import source as S
from ..operators import sourcetree as ST
from .queries import HASH, _t, query

LOW, HIGH = HASH.format(seed=0x811C9DC5, factor=0x01000193, unit="unicode(c)::BIGINT"), HASH.format(seed=0x45D9F3B, factor=0x27D4EB2D, unit="(unicode(c) + i - 1)::BIGINT")
DIGEST = f"lower(printf('%08x', {LOW})) || lower(printf('%08x', {HIGH}))"  # of x
ID = "regexp_replace({}, '[^a-zA-Z0-9_.:-]', '_', 'g')"
PAGES = f"""p AS (SELECT p_brand AS d, p_partkey AS page, p_size AS z, trim(regexp_replace(CASE WHEN p_size % 7 = 0 THEN ' ' ELSE ' ' || p_name || '  of ' || p_type END, ' +', ' ', 'g')) AS t FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY page) - 1 AS i, '"' || t || '"' AS x FROM p WHERE t <> ''),
s AS (SELECT d, page, z, i, t, {DIGEST} AS h FROM f), sp AS (SELECT *, {ID.format("d")} || ':span:' || page || ':' || i || ':' || substr(h, 1, 12) AS id FROM s)"""


def _pages(spark, sf):
    text = F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.concat(F.lit(" "), "p_name", F.lit("  of "), "p_type"))
    return _t(spark, sf, "part").select(F.col("p_brand").alias("document_id"), F.col("p_partkey").alias("page"), text.alias("text"), F.col("p_size").alias("size"))


@query(f"WITH {PAGES} SELECT id, d AS document_id, page AS page_start, t AS text, h AS text_hash, 'pdf_text' AS kind FROM sp")
def page_spans(spark, sf):
    return S.page_spans(_pages(spark, sf)).select("id", "document_id", "page_start", "text", "text_hash", "kind")


@query(f"""WITH RECURSIVE {PAGES}, k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY page) AS k, length(t) AS n FROM sp),
g AS (SELECT d, k, 0 AS c, n AS size FROM k WHERE k = 1 UNION ALL SELECT k.d, k.k, CASE WHEN g.size + k.n + 2 <= 300 THEN c ELSE c + 1 END, CASE WHEN g.size + k.n + 2 <= 300 THEN g.size + k.n + 2 ELSE k.n END FROM g JOIN k ON g.d = k.d AND k.k = g.k + 1),
l AS (SELECT d, c, string_agg(t, chr(10) || chr(10) ORDER BY page) AS text, string_agg('"' || id || '"', ',' ORDER BY page) AS ids, count(*) AS n, min(page) AS a, max(page) AS z FROM g JOIN k USING (d, k) GROUP BY d, c),
h AS (SELECT d, c, ids, n, a, z, text, {DIGEST} AS th FROM (SELECT *, '"' || replace(text, chr(10) || chr(10), ' ') || '"' AS x FROM l)),
m AS (SELECT *, '{{"sourceSpanIds":[' || ids || '],"textHash":"' || th || '"}}' AS x FROM h)
SELECT {ID.format("d")} || ':source_chunk:' || c || ':' || substr({DIGEST}, 1, 12) AS id, n::INT AS n_spans, th AS text_hash, a AS page_start, z AS page_end FROM m""")
def source_chunks(spark, sf):
    spans = S.page_spans(_pages(spark, sf)).withColumn("pos", F.col("page_start"))
    return S.source_chunks(spans, 300).select("id", F.size("source_span_ids").alias("n_spans"), "text_hash", "page_start", "page_end")


def _spans(spark, sf):
    k = F.col("p_partkey")
    m = F.create_map(F.lit("kind"), F.col("p_type"), F.lit("formNumber"), F.when(k % 5 == 0, "F2").otherwise("none"))
    return _t(spark, sf, "part").select(k.cast("string").alias("id"), F.col("p_brand").alias("document_id"), F.when(k % 3 != 0, F.concat(F.lit("c"), k % 4)).alias("chunk_id"), F.when(k % 7 == 0, "F2").otherwise("F1").alias("form_number"), m.alias("metadata"), F.when(k % 2 == 0, k).alias("embedding"))


@query("SELECT p_partkey::VARCHAR AS id FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_partkey % 3 <> 0 AND p_partkey % 4 IN (0, 1) AND p_type = 'ECONOMY' AND (p_partkey % 7 = 0 OR p_partkey % 5 = 0)")
def span_filters(spark, sf):
    return S.filter_spans(_spans(spark, sf), ["Brand#1", "Brand#2"], ["c0", "c1"], {"kind": "ECONOMY", "formNumber": "F2"}).select("id")


@query("SELECT p_partkey::VARCHAR AS id FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_partkey % 7 = 0 AND p_partkey % 2 = 0")
def stored_span_filters(spark, sf):
    return S.filter_spans(_spans(spark, sf), ["Brand#1", "Brand#2"], None, {"kind": "ignored", "formNumber": "F2"}, stored=True).select("id")


@query("SELECT doc_id FROM documents WHERE source = 'src1' AND lang = 'en'")
def chunk_filters(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", F.col("source").alias("document_id"), F.col("lang").alias("type"))
    return S.filter_chunks(rows, "src1", "en").select("doc_id")


SUPPLIERS = "s AS (SELECT s_nationkey AS d, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier)"


def _table_spans(spark, sf):
    """Suppliers as rows of their nation's table, ten on a page, with two cells each."""
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    rows = _t(spark, sf, "supplier").withColumn("r", r)
    made = lambda unit, key, text, column, name, row: rows.select(F.col("s_nationkey").alias("document_id"), key.alias("id"), text.alias("text"), (F.floor((F.col("r") - 1) / 10) + 1).cast("int").alias("page_start"), F.lit(unit).alias("source_unit"), F.concat(F.lit("T"), "s_nationkey").alias("table_id"), F.col("r").cast("int").alias("row_index"), F.lit(column).alias("column_index"), F.lit(name).cast("string").alias("column_name"), row.alias("row_span_id"))
    own = F.concat(F.lit("r"), "s_suppkey")
    out = made("table_row", own, F.col("s_name"), 0, None, F.lit(None).cast("string"))
    out = out.unionByName(made("table_cell", F.concat(F.lit("c"), "s_suppkey", F.lit("a")), F.col("s_name"), 1, "Name", own))
    return out.unionByName(made("table_cell", F.concat(F.lit("c"), "s_suppkey", F.lit("b")), F.col("s_acctbal").cast("string"), 2, "Balance", F.when(F.col("s_suppkey") % 9 == 0, "gone").otherwise(own)))


@query(f"""WITH {SUPPLIERS}, p AS (SELECT DISTINCT d, (r - 1) // 10 + 1 AS p FROM s), a AS (SELECT d, s_suppkey % 9 = 0 AS stray, r, (r - 1) // 10 + 1 AS p, 2 + (r - 1) // 10 + 1 + 3 * (r - 1) AS o FROM s),
t AS (SELECT *, r + sum(stray::INT) OVER (PARTITION BY d ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS place0 FROM a), u AS (SELECT *, coalesce(place0, r) AS place FROM t)
SELECT d AS document_id, 'document' AS kind, 0 AS ord, 'Document' AS title, '1' AS path, 3 * count(*) AS n_spans FROM s GROUP BY d
UNION ALL SELECT d, 'page', CASE WHEN p = 1 THEN 1 ELSE 2 + (p - 1) + 30 * (p - 1) END, 'Page ' || p, '1.' || p, 0 FROM p
UNION ALL SELECT DISTINCT d, 'table', 2, 'Table 1', '1.1.1', 0 FROM s
UNION ALL SELECT d, 'table_row', o, 'Row ' || (r + 1), '1.1.1.' || place, 1 FROM u
UNION ALL SELECT d, 'table_cell', o + 1, 'Name', '1.1.1.' || place || '.1', 1 FROM u
UNION ALL SELECT d, 'table_cell', o + 2, 'Balance', '1.1.1.' || CASE WHEN stray THEN (place + 1)::VARCHAR ELSE place || '.2' END, 1 FROM u""".replace("3 * count(*) AS n_spans", "least(200, 3 * count(*)) AS n_spans"))
def source_tree(spark, sf):
    return ST.source_tree(_table_spans(spark, sf)).select("document_id", "kind", F.col("ord").cast("long").alias("ord"), "title", "path", F.size("source_span_ids").cast("long").alias("n_spans"))


@query("""WITH c AS (SELECT conv_id, turn, role = 'user' AS head, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
t AS (SELECT *, max(CASE WHEN head THEN k END) OVER (PARTITION BY conv_id ORDER BY k) AS over FROM c),
u AS (SELECT *, head OR over IS NULL AS top, sum((head OR over IS NULL)::INT) OVER (PARTITION BY conv_id ORDER BY k) AS place, k - over AS child, count(*) OVER (PARTITION BY conv_id, over) AS n FROM t)
SELECT conv_id, turn, '1.1.' || place || CASE WHEN top THEN '' ELSE '.' || child END AS path, CASE WHEN head THEN n ELSE 1 END AS n_spans FROM u""")
def tree_title_blocks(spark, sf):
    rows = _t(spark, sf, "conversations")
    user = F.col("role") == "user"
    spans = rows.select(F.col("conv_id").alias("document_id"), F.concat_ws(":", "conv_id", F.lpad(F.col("turn").cast("string"), 9, "0")).alias("id"), F.when(user, F.concat(F.lit("SECTION "), "turn")).otherwise(F.col("text")).alias("text"), F.lit(1).alias("page_start"), F.lit("text").alias("source_unit"), F.create_map(F.lit("elementType"), F.when(user, "title").otherwise("text")).alias("metadata"))
    tree = ST.source_tree(spans).where("kind = 'text'")
    return tree.select(F.col("document_id").alias("conv_id"), F.substring_index(F.element_at("source_span_ids", 1), ":", -1).cast("long").alias("turn"), "path", F.size("source_span_ids").cast("long").alias("n_spans"))


TEXT = "CASE c_custkey % 6 WHEN 0 THEN 'Policy number: p ' || c_custkey WHEN 1 THEN 'Named  Insured:' WHEN 2 THEN c_name WHEN 3 THEN 'Effective date: 01/02/2024' WHEN 4 THEN 'Carrier: ACME ' || c_mktsegment || ' | next' ELSE 'nothing; a coverage part of it' END"
LEDGER = rf"""s AS (SELECT c_nationkey AS d, c_custkey AS k, regexp_replace({TEXT}, ' +', ' ', 'g') AS t, c_custkey % 11 <> 0 AS cited FROM customer),
w AS (SELECT *, lead(t) OVER n AS nt, lead(k) OVER n AS nk, lead(cited) OVER n AS ncited FROM s WINDOW n AS (PARTITION BY d ORDER BY k)),
i AS (SELECT d, 'policy_number' AS field, regexp_replace(upper(trim(regexp_extract(t, '(?i)\bpolicy\s*(?:number|no\.?|#)\s*[:#-]?\s*([^\n|;]{{2,80}})', 1))), '\s+', '', 'g') AS v FROM w WHERE cited
UNION ALL SELECT d, 'carrier', lower(trim(regexp_extract(t, '(?i)\b(?:carrier|insurer|insurance\s+company|company\s+name)\s*[:#-]?\s*([^\n|;]{{2,180}})', 1))) FROM w WHERE cited
UNION ALL SELECT d, 'effective_date', upper(trim(regexp_extract(t, '(?i)\beffective\s+date\s*[:#-]?\s*([^\n|;]{{4,80}})', 1))) FROM w WHERE cited
UNION ALL SELECT d, 'named_insured', lower(regexp_replace(nt, '[\s|;,]+$', '')) FROM w WHERE cited AND ncited AND k % 6 = 1 AND nk % 6 <> 1)"""


def _ledger(spark, sf):
    k = F.col("c_custkey")
    text = F.when(k % 6 == 0, F.concat(F.lit("Policy number: p "), k)).when(k % 6 == 1, "Named  Insured:").when(k % 6 == 2, F.col("c_name")).when(k % 6 == 3, "Effective date: 01/02/2024").when(k % 6 == 4, F.concat(F.lit("Carrier: ACME "), "c_mktsegment", F.lit(" | next"))).otherwise("nothing; a coverage part of it")
    rows = _t(spark, sf, "customer")
    key = F.concat(F.lit("x:span:1:"), k, F.lit(":h"))
    spans = rows.select(F.col("c_nationkey").alias("document_id"), key.alias("id"), k.alias("pos"), text.alias("text"))
    kind, title = F.when(k % 13 == 0, "endorsement").otherwise("text"), F.when(k % 5 == 0, "Declarations").otherwise("T")
    nodes = rows.where(k % 11 != 0).select(F.concat(F.lit("n"), k).alias("id"), F.col("c_nationkey").alias("document_id"), F.lit(0).alias("ord"), title.alias("title"), F.lit("d").alias("description"), F.lit("1").alias("path"), kind.alias("kind"), F.array(key).alias("source_span_ids"))
    return spans, nodes


@query(f"""WITH {LEDGER}, c AS (SELECT d, field, count(*) AS n, count(DISTINCT v) AS k FROM i WHERE v <> '' GROUP BY d, field), e AS (SELECT DISTINCT d, unnest(['policy_number', 'named_insured', 'carrier', 'effective_date', 'expiration_date']) AS field FROM s)
SELECT e.d AS document_id, e.field, CASE WHEN n > 0 THEN 'observed' ELSE 'not_observed' END AS status, coalesce(k > 1, false) AS ambiguous, coalesce(n, 0) AS n_candidates FROM e LEFT JOIN c ON e.d = c.d AND e.field = c.field""")
def ledger_fields(spark, sf):
    p = S.with_nodes(*_ledger(spark, sf))
    return S.ledger_fields(S.ledger_candidates(p), p)


COVERED = rf"""WITH {LEDGER}, m AS (SELECT d, k, t || CASE WHEN cited THEN ' ' || CASE WHEN k % 5 = 0 THEN 'Declarations' ELSE 'T' END || ' d 1' ELSE '' END AS c, cited, cited AND k % 13 = 0 AS e FROM s),
a AS (SELECT *, regexp_matches(c, '(?i)\b(?:{S.CORE})\b') AS core, regexp_matches(c, '(?i)\b(?:{S.COVERAGE})\b') AS cov, e AND regexp_matches(c, '(?i)\b(?:{S.PARTY})\b') AS party FROM m),
z AS (SELECT d, k, cited, cov, CASE WHEN party OR (core AND cov) THEN 'both' WHEN core THEN 'core' WHEN cov THEN 'coverage' ELSE 'catch_all' END AS assignment FROM a)"""


@query(f"{COVERED} SELECT d AS document_id, k AS pos, assignment FROM z")
def coverage_map(spark, sf):
    p = S.with_nodes(*_ledger(spark, sf))
    return S.coverage_map(p).select("document_id", S.ordinal(F.col("source_span_id")).alias("pos"), "assignment")


@query(f"{COVERED} SELECT d AS document_id, count(*) FILTER (assignment = 'core') AS core, count(*) FILTER (assignment = 'coverage') AS coverage, count(*) FILTER (assignment = 'both') AS n_both, arg_min(k, k) FILTER (assignment = 'catch_all') AS first_other FROM z GROUP BY d")
def coverage_shards(spark, sf):
    rows = S.shards(S.coverage_map(S.with_nodes(*_ledger(spark, sf))))
    n = lambda c: F.size(c).cast("long")
    return rows.select("document_id", n("core").alias("core"), n("coverage").alias("coverage"), n("both").alias("n_both"), S.ordinal(F.try_element_at("catch_all", F.lit(1))).alias("first_other"))


@query(f"{COVERED} SELECT d AS document_id, count(*) AS n FROM z WHERE cited AND cov GROUP BY d")
def coverage_regions(spark, sf):
    return S.coverage_regions(S.with_nodes(*_ledger(spark, sf))).groupBy("document_id").agg(F.count("*").alias("n"))


@query(f"""WITH n AS (SELECT n_regionkey AS d, string_agg('{{"hash":"h' || n_nationkey || '","id":"n' || n_nationkey || '"' || CASE WHEN n_nationkey % 2 = 0 THEN ',"pageEnd":9' ELSE '' END || ',"pageStart":' || n_nationkey || '}}', ',' ORDER BY n_nationkey) AS l FROM nation GROUP BY 1)
SELECT d AS document_id, {DIGEST} AS fingerprint FROM (SELECT d, '[' || l || ']' AS x FROM n)""")
def ledger_fingerprints(spark, sf):
    k = F.col("n_nationkey")
    rows = _t(spark, sf, "nation").select(F.col("n_regionkey").alias("document_id"), F.concat(F.lit("n"), k).alias("id"), k.alias("place"), F.lit("x").alias("text"), F.concat(F.lit("h"), k).alias("text_hash"), k.alias("page_start"), F.when(k % 2 == 0, 9).alias("page_end"))
    return S.fingerprints(rows)


@query(f"""{COVERED}, c AS (SELECT d, field, count(DISTINCT v) AS n FROM i WHERE v <> '' GROUP BY d, field), b AS (SELECT d, max(n) > 1 AS doubt FROM c GROUP BY d), r AS (SELECT DISTINCT d FROM z WHERE cited AND cov)
SELECT s.d AS document_id, count(*) AS n_eligible, count(*) FILTER (cited) AS n_projected, bool_and(cited AND k % 17 <> 0) AS complete, coalesce(any_value(doubt), false) AS ambiguous, CASE WHEN any_value(r.d) IS NULL THEN 'not_observed' ELSE 'observed' END AS regions FROM s LEFT JOIN b ON s.d = b.d LEFT JOIN r ON s.d = r.d GROUP BY s.d""")
def evidence_ledger(spark, sf):
    spans, nodes = _ledger(spark, sf)
    return S.ledger(spans, nodes, spans.where(F.col("pos") % 17 != 0).select("id")).drop("fingerprint")


@query(r"""WITH r AS (SELECT p_brand, list(['| ' || replace(p_name, '|', '\|') || ' | ' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END || ' |'] ORDER BY p_partkey) AS l FROM part GROUP BY p_brand)
SELECT p_brand, array_to_string(list_concat([l[1][1], '| --- | --- |'], list_transform(l[2:], lambda x: x[1])), chr(10)) AS grid FROM r""")
def table_markdown(spark, sf):
    cells = F.when(F.col("p_partkey") % 3 == 0, F.array("p_name")).otherwise(F.array("p_name", "p_type"))
    # a brand whose rows are all short has one column; here each has long ones
    rows = _t(spark, sf, "part").groupBy("p_brand").agg(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", cells.alias("c")))), lambda x: x["c"]).alias("rows"))
    return rows.select("p_brand", S.grid_markdown(F.col("rows")).alias("grid"))


@query("SELECT p_partkey, 'name: ' || p_name || CASE WHEN p_size % 4 = 0 THEN '' ELSE ' | Column 2: ' || p_type END || ' | size: ' || p_size AS text FROM part")
def table_row_text(spark, sf):
    cells = F.array("p_name", F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_type")), F.col("p_size").cast("string"))
    return _t(spark, sf, "part").select("p_partkey", S.row_text(F.array(F.lit("name"), F.lit(" "), F.lit("size")), cells).alias("text"))


@query("WITH p AS (SELECT conv_id, turn + 1 AS p, text FROM conversations), e AS (SELECT conv_id, min(p) AS a, max(p) AS z FROM p GROUP BY conv_id) SELECT conv_id AS document_id, string_agg('Page ' || p || chr(10) || text, chr(10) || chr(10) ORDER BY p) AS text FROM p JOIN e USING (conv_id) WHERE p BETWEEN greatest(0, a) AND least(3, z) GROUP BY conv_id")
def page_range_text(spark, sf):
    spans = _t(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").cast("string").alias("id"), (F.col("turn") + 1).cast("int").alias("page_start"), "text")
    return S.page_range_text(spans, 0, 3)


@query("SELECT doc_id, CASE WHEN length(t) > 40 THEN rtrim(substr(t, 1, 40)) || '...' ELSE t END AS text FROM (SELECT doc_id, trim(regexp_replace(text, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g')) AS t FROM documents)")
def shortened(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", ST.shorten(F.col("text"), 40).alias("text"))


@query("""WITH n AS (SELECT c_custkey AS id, c_nationkey AS p, c_custkey AS o, c_custkey % 7 AS a, c_name AS t FROM customer), k AS (SELECT p, min(o) AS o, min(a) AS a, max(a) AS z, count(*) AS n, substr(string_agg(t, chr(10) || chr(10) ORDER BY o), 1, 1600) AS t FROM n GROUP BY p)
SELECT 'n' || n_nationkey AS id, least(1000000, coalesce(o, 1000000)) AS ord, a::INT AS page_start, z::INT AS page_end, coalesce(n, 0) AS n_spans, t AS text_excerpt FROM nation LEFT JOIN k ON n_nationkey = p""")
def evidence_rollup(spark, sf):
    null = F.lit(None).cast("string")
    made = lambda df, key, parent, kind, o, page, text, ids: df.select(key.alias("id"), parent.alias("parent_id"), F.lit(kind).alias("kind"), o.cast("long").alias("ord"), page.cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), text.alias("text_excerpt"), F.lit("").alias("description"), ids.alias("source_span_ids"))
    top = made(_t(spark, sf, "nation"), F.concat(F.lit("n"), "n_nationkey"), null, "section", F.lit(1_000_000), F.lit(None), null, F.array().cast("array<string>"))
    kids = made(_t(spark, sf, "customer"), F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), "text", F.col("c_custkey"), F.col("c_custkey") % 7, F.col("c_name"), F.array(F.col("c_custkey").cast("string")))
    return ST.roll_up(top.unionByName(kids)).where("kind = 'section'").select("id", "ord", "page_start", "page_end", F.size("source_span_ids").cast("long").alias("n_spans"), "text_excerpt")


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), s AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN k END) OVER (PARTITION BY user_id) AS a FROM e),
z AS (SELECT *, min(CASE WHEN event_type = 'error' AND k > a THEN k END) OVER (PARTITION BY user_id) AS z FROM s) SELECT user_id, event_id, coalesce(k >= a AND (z IS NULL OR k < z), false) AS in_run FROM z""")
def first_run(spark, sf):
    rows = _t(spark, sf, "events").select("user_id", "event_id", F.col("user_id").alias("parent_id"), F.col("event_id").alias("ord"), F.col("event_id").alias("id"), "event_type")
    return ST.first_run(rows, F.col("event_type") == "purchase", F.col("event_type") == "error").select("user_id", "event_id", "in_run")


@query("""WITH r AS (SELECT l_orderkey AS o, l_linenumber AS n, 'r' || l_orderkey || '-' || l_linenumber AS row, l_partkey % 3 > 0 AS has_row, l_partkey % 4 AS cells FROM lineitem),
s AS (SELECT row AS id, o AS document_id FROM r WHERE has_row UNION ALL SELECT row || ':' || c, o FROM r, unnest(range(0, cells)) u(c) WHERE row NOT IN (SELECT row FROM r WHERE has_row) UNION ALL SELECT row || ':t', o FROM r)
SELECT id, document_id FROM s""")
def chunkable_spans(spark, sf):
    """Rows of orders as table rows and cells: cells whose row is there as a span go."""
    row = F.concat(F.lit("r"), "l_orderkey", F.lit("-"), "l_linenumber")
    lines = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), row.alias("row"), "l_partkey")
    none = F.lit(None).cast("string")
    span = lambda df, id_, kind, parent: df.select(id_.alias("id"), "document_id", F.lit(kind).alias("source_unit"), parent.alias("parent_span_id"))
    rows = span(lines.where("l_partkey % 3 > 0"), F.col("row"), "table_row", none)
    cells = span(lines.where("l_partkey % 4 > 0").withColumn("c", F.explode(F.sequence(F.lit(1), F.col("l_partkey") % 4))), F.concat_ws(":", "row", F.col("c") - 1), "table_cell", F.col("row"))
    texts = span(lines, F.concat_ws(":", "row", F.lit("t")), "text", F.col("row"))
    return S.chunkable(rows.unionByName(cells).unionByName(texts)).select("id", "document_id")
