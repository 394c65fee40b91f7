"""Queries of retrieval for many questions at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import search
from ..operators import spans as S
from .queries import _t, query

WINDOWS = "w AS (SELECT doc_id, unnest(range(0, ((length(text) + 3999) // 4000)::BIGINT)) AS idx, text AS x FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id || ':window:' || idx AS span_id, doc_id, lower(substr(x, (idx * 4000 + 1)::BIGINT, 4000)) AS t FROM w)"
QUESTIONS = "q AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9$.,%-]+'), lambda x: length(x) >= 2)) AS terms FROM benchmark)"
HITS = "SELECT query_id, span_id, len(list_filter(terms, lambda x: contains(t, x))) / len(terms)::DOUBLE AS relevance FROM q, s"


def _windows(spark, sf):
    return S.windows(_t(spark, sf, "documents"), "doc_id", "text").withColumn("span_id", F.concat_ws(":", "doc_id", F.lit("window"), "idx"))


def _questions(spark, sf):
    return _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


@query(f"WITH {WINDOWS}, {QUESTIONS}, h AS ({HITS}) SELECT query_id, span_id, round(relevance, 6) AS relevance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, span_id) AS rank FROM h WHERE relevance > 0) WHERE rank <= 10")
def lexical_topk_many(spark, sf):
    """Every benchmark item as a question against every window of every document."""
    return search.top(_questions(spark, sf), _windows(spark, sf), "span_id", 10).withColumn("relevance", F.round("relevance", 6))


@query("WITH t AS (SELECT DISTINCT lower(substr(c_name, length(c_name) - 1 - c_custkey % 4)) AS term FROM customer) SELECT term, count(*) AS n FROM t JOIN (SELECT DISTINCT lower(p_name || ' ' || c_name) AS x FROM part JOIN customer ON p_partkey = c_custkey) ON contains(x, term) GROUP BY term")
def terms_in_names(spark, sf):
    """Which names hold which ends of names."""
    name = F.col("c_name")
    customers = _t(spark, sf, "customer")
    terms = customers.select(F.lower(F.substr(name, F.length(name) - 1 - F.col("c_custkey") % 4)).alias("term"))
    names = _t(spark, sf, "part").join(customers, F.col("p_partkey") == F.col("c_custkey")).select(F.lower(F.concat("p_name", F.lit(" "), name)).alias("text"))
    return search.containing(terms, names).groupBy("term").agg(F.count("*").alias("n"))


ASKED = f"""{WINDOWS}, {QUESTIONS}, a AS (SELECT *, CASE query_id % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'source_rag' ELSE 'graph_only' END AS way, CASE WHEN query_id % 2 = 0 THEN ['src1', 'src2', 'src0'] END AS types, CASE WHEN query_id % 4 = 0 THEN query_id % 20 END AS conv, CASE WHEN query_id % 6 = 0 THEN 'segment ' || query_id % 3 WHEN query_id % 6 = 2 THEN NULL END AS f_carrier, CASE WHEN query_id % 5 = 0 THEN 'fr' END AS f_type FROM q),
hs AS (SELECT query_id, span_id, len(list_filter(terms, lambda x: contains(t, x))) / len(terms)::DOUBLE AS r, doc_id FROM a, s WHERE way <> 'graph_only'),
es AS (SELECT query_id, 'source_span' AS source, span_id AS id, doc_id::VARCHAR AS document_id, r AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, span_id) AS k FROM hs WHERE r > 0) WHERE k <= 10),
hc AS (SELECT query_id, types, doc_id, source, len(list_filter(terms, lambda x: contains(lower(text), x))) / len(terms)::DOUBLE AS r FROM a, documents d WHERE way <> 'source_rag' AND (types IS NULL OR list_contains(types, source))),
ec AS (SELECT query_id, 'chunk' AS source, lpad(doc_id::VARCHAR, 8, '0') AS id, doc_id::VARCHAR AS document_id, 0.8::DOUBLE AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY query_id, CASE WHEN types IS NULL THEN NULL ELSE source END ORDER BY r DESC, lpad(doc_id::VARCHAR, 8, '0')) AS k FROM hc WHERE r > 0) WHERE k <= CASE WHEN types IS NULL THEN 10 ELSE 4 END),
ed AS (SELECT query_id, 'document' AS source, '' AS id, doc_id::VARCHAR AS document_id, 0.9::DOUBLE AS relevance FROM a, documents d WHERE way <> 'source_rag' AND (f_carrier IS NOT NULL OR f_type IS NOT NULL) AND (f_type IS NULL OR lang = f_type) AND (f_carrier IS NULL OR contains('of segment ' || doc_id % 50 || '.', f_carrier))),
et AS (SELECT query_id, 'conversation' AS source, conv_id || ':' || turn AS id, '' AS document_id, 0.6::DOUBLE AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, turn) AS k FROM (SELECT a.query_id, c.conv_id, c.turn, len(list_filter(terms, lambda x: contains(lower(coalesce(c.text, '')), x))) / len(terms)::DOUBLE AS r FROM a JOIN conversations c ON c.conv_id = a.conv) WHERE r > 0) WHERE k <= 5),
u AS (SELECT * FROM es UNION ALL SELECT * FROM ec UNION ALL SELECT * FROM ed UNION ALL SELECT * FROM et)"""


@query(f"""WITH {ASKED} SELECT query_id, source, id, round(relevance, 6) AS relevance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, source || '|' || CASE source WHEN 'source_span' THEN id ELSE '' END || '|' || CASE source WHEN 'chunk' THEN id ELSE '' END || '|' || document_id || '|' || CASE source WHEN 'conversation' THEN id ELSE '' END || '|') AS rank FROM u) WHERE rank <= 10""")
def retrieved_evidence(spark, sf):
    """Every benchmark item as a question: spans, chunks by type, documents by filters and turns of a conversation in one order."""
    q, d = F.col("query_id"), F.col("doc_id")
    none = F.lit(None).cast("string")
    way = F.when(q % 3 == 0, "hybrid").when(q % 3 == 1, "source_rag").otherwise("graph_only")
    types = F.when(q % 2 == 0, F.array(F.lit("src1"), F.lit("src2"), F.lit("src0")))
    questions = _questions(spark, sf).select("query_id", "question", way.alias("way"), types.alias("chunk_types"), F.when(q % 4 == 0, (q % 20).cast("string")).alias("conversation_id"), F.when(q % 5 == 0, "fr").otherwise("").alias("f_type"), F.when(q % 6 == 0, F.concat(F.lit("SEGMENT "), q % 3)).alias("f_carrier"), none.alias("f_insured"), none.alias("f_number"), none.alias("f_quote"))
    docs = _t(spark, sf, "documents")
    spans = _windows(spark, sf).select("span_id", d.cast("string").alias("document_id"), "text")
    chunks = docs.select(F.lpad(d.cast("string"), 8, "0").alias("chunk_id"), d.cast("string").alias("document_id"), F.col("source").alias("type"), "text")
    documents = docs.select(d.cast("string").alias("document_id"), F.col("lang").alias("type"), F.concat(F.lit("of Segment "), d % 50, F.lit(".")).alias("carrier"), none.alias("insured"), none.alias("number"), none.alias("quote"), F.lit("").alias("text"))
    turns = _t(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").alias("pos"), "role", "text")
    found = R.retrieve(questions, spans, chunks, documents, turns)
    return found.select("query_id", "source", F.coalesce("span_id", "chunk_id", "turn_id", F.lit("")).alias("id"), F.round("relevance", 6).alias("relevance"), "rank")
