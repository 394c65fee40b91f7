"""Searches write no more than they find, and find the same."""

from pyspark.sql import functions as F

from citeloom.operators import retrieval as R
from citeloom.operators import search


def test_runs_of_texts_are_not_written(spark, monkeypatch):
    kept, real = [], search.cut
    monkeypatch.setattr(search, "cut", lambda df: (kept.append(df.columns), real(df))[1])
    texts = spark.createDataFrame([("a", "Flooded house floods"), ("b", "ood"), ("c", None), ("d", "nothing, 5%")], "doc string, text string")
    asked = spark.createDataFrame([(1, "flood ood"), (2, "ood x 5% zz")], "query_id int, question string")
    got = {(r.query_id, r.doc): round(r.relevance, 6) for r in search.lexical_hits(asked, texts, "doc").collect()}
    assert got == {(1, "a"): 1.0, (1, "b"): 0.5, (2, "a"): 0.333333, (2, "b"): 0.333333, (2, "d"): 0.333333}
    assert not any("doc" in c for c in kept)


def test_documents_beyond_the_first_go_before_texts_are_read(spark, monkeypatch):
    kept, real = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: (kept.append(real(df)), kept[-1])[1])
    none = F.lit(None).cast("string")
    docs = spark.range(300).select(F.when(F.col("id") < 299, F.col("id").cast("string")).otherwise("1|2").alias("document_id"), F.lit("fr").alias("type"), *(none.alias(c) for c in ("carrier", "insured", "number", "quote")), F.concat(F.lit("text "), "id").alias("text"))
    asked = spark.createDataFrame([(7, "q", "graph_only", None, None, "fr", "", None, None, None)], "query_id int, question string, way string, chunk_types array<string>, conversation_id string, f_type string, f_carrier string, f_insured string, f_number string, f_quote string")
    spans = spark.createDataFrame([], "span_id string, document_id string, text string")
    chunks = spark.createDataFrame([], "chunk_id string, document_id string, type string, text string")
    turns = spark.createDataFrame([], "turn_id string, conversation_id string, document_id string, pos int, role string, text string")
    got = [(r.document_id, r.text) for r in R.retrieve(asked, spans, chunks, docs, turns).orderBy("rank").collect()]
    held = {r.document_id: r.text for r in docs.collect()}
    assert got == [(d, held[d]) for d in sorted(held, key=lambda d: f"document|||{d}|||{held[d]}")[:10]]
    texts = [k for k in kept if "text" in k.columns and "document_id" in k.columns and "rank" not in k.columns]
    assert texts and all(k.count() <= 11 for k in texts)
