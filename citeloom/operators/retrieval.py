"""Retrieval: which way and what for, evidence in its order, and how it is said in a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import cut
from . import search

#: What evidence of a source counts for, and of how many turns.
RELEVANCE = {"chunk": 0.8, "document": 0.9, "conversation": 0.6, "attachment": 0.95}
TURNS = 5
_IDS = ("source", "span_id", "chunk_id", "document_id", "turn_id", "attachment_id")


def mode(asked: Column, configured: Column, classified: Column, sources: Column) -> Column:
    """The first that is given; else hybrid where spans can be searched, graph_only where not."""
    return F.coalesce(asked, configured, classified, F.when(sources, "hybrid").otherwise("graph_only"))


def actions(lookup: Column, search: Column, attached: Column) -> Column:
    """What a question's plan does, in order, and why it reasons as it does."""
    some = lookup | search
    steps = F.when(some, F.array(F.lit("retrieve"), F.lit("reason"), F.lit("verify"), F.lit("respond"))).otherwise(F.array(F.lit("reason"), F.lit("verify"), F.lit("respond")))
    why = F.when(some, "answer with retrieved evidence and any attachment evidence").when(attached, "answer with attachment evidence only").otherwise("answer without document retrieval")
    return F.struct(steps.alias("steps"), why.alias("why"))


def branches(way: Column, has_spans: Column, has_filters: Column, has_conversation: Column) -> Column:
    """Which of spans, chunks, documents and turns are searched in a way of retrieval."""
    spans = has_spans & way.isin("source_rag", "hybrid", "long_context")
    chunks = way.isin("graph_only", "hybrid") | ~has_spans
    documents = way.isin("graph_only", "hybrid", "long_context") & has_filters
    return F.struct(spans.alias("spans"), chunks.alias("chunks"), documents.alias("documents"), has_conversation.alias("turns"))


def order_key(df: DataFrame) -> Column:
    """Evidence of equal relevance is ordered by its source, its ids and its text, between bars; absent ones are empty."""
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in (*_IDS, "text")))


def ranked(evidence: DataFrame, query: str, most: int) -> DataFrame:
    """The best `most` pieces of evidence of each query, ranks from 1."""
    w = Window.partitionBy(query).orderBy(F.desc("relevance"), order_key(evidence))
    return evidence.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def per_type(chunks: DataFrame, query: str, kind: str, most: int, kinds: int) -> DataFrame:
    """Of each type of chunk its share of `most`, rounded up."""
    w = Window.partitionBy(query, kind).orderBy(F.desc("score"), "chunk_id")
    return chunks.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= -(-most // kinds)).drop("_k")


#: What evidence says of itself; what a source doesn't have is null.
EVIDENCE = ("query_id", "source", "span_id", "chunk_id", "document_id", "turn_id", "attachment_id", "text", "relevance")
_FILTERS = ("type", "carrier", "insured", "number", "quote")


def _as_evidence(rows: DataFrame, source: str, relevance: Column) -> DataFrame:
    own = {c: F.col(c).cast("string") for c in rows.columns if c in EVIDENCE}
    own |= {"source": F.lit(source), "relevance": relevance.cast("double"), "query_id": F.col("query_id")}
    return rows.select(*(own.get(c, F.lit(None).cast("string")).alias(c) for c in EVIDENCE))


def found_documents(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents(document_id, type, carrier, insured, number, quote, text) that each question's filters (columns f_type .. f_quote, null or empty where not asked) let through; none for a question without filters.

    Type and numbers have to be equal; carrier and insured are found anywhere in a name, without regard to case, by
    grams of the distinct names. So every question meets documents by a key: the first of these filters that it gives.
    """
    f = {c: F.nullif(F.col(f"f_{c}"), F.lit("")) for c in _FILTERS}
    asked = cut(questions.select("query_id", *(v.alias(f"f_{c}") for c, v in f.items())))
    docs = documents.select("document_id", *_FILTERS, "text")
    out = None
    for i, c in enumerate(("number", "quote", "carrier", "insured", "type")):
        before = [F.col(f"f_{x}").isNull() for x in ("number", "quote", "carrier", "insured", "type")[:i]]
        some = asked.where(F.col(f"f_{c}").isNotNull())
        for b in before:
            some = some.where(b)
        if c in ("carrier", "insured"):
            names = docs.select(F.lower(c).alias("text")).where("text IS NOT NULL").distinct()
            pairs = search.containing(some.select(F.lower(f"f_{c}").alias("term")), names).select(F.col("term").alias("_term"), F.col("text").alias("_name"))
            some = some.join(pairs, F.lower(f"f_{c}") == F.col("_term"))
            rows = some.join(docs, F.col("_name") == F.lower(c))
        else:
            rows = some.join(docs, F.col(f"f_{c}") == F.col(c))
        for x in ("type", "number", "quote"):
            rows = rows.where(F.col(f"f_{x}").isNull() | F.col(f"f_{x}").eqNullSafe(F.col(x)))
        for x in ("carrier", "insured"):
            rows = rows.where(F.col(f"f_{x}").isNull() | F.coalesce(F.contains(F.lower(x), F.lower(f"f_{x}")), F.lit(False)))
        rows = rows.select("query_id", "document_id", "text")
        out = rows if out is None else out.unionByName(rows)
    return out


def _first_documents(questions: DataFrame, documents: DataFrame, most: int) -> DataFrame:
    """found_documents(), but of each question only those that can be among its first `most` by order_key(): told by their ids, and before texts are read. Ids with a bar, whose order may depend on the text, all stay."""
    d = F.coalesce("document_id", F.lit(""))
    ids = found_documents(questions, documents.withColumn("text", F.lit(""))).select("query_id", "document_id").distinct()
    plain = ids.where(~F.contains(d, F.lit("|"))).withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.concat(d, F.lit("|"))))).where(F.col("_n") <= most).drop("_n")
    ids = cut(plain.unionByName(ids.where(F.contains(d, F.lit("|")))).select(F.col("query_id").alias("_q"), F.col("document_id").alias("_d")))
    few = documents.join(ids.select("_d").distinct(), F.col("document_id").eqNullSafe(F.col("_d")), "left_semi")
    return found_documents(questions, cut(few)).join(ids, (F.col("query_id") == F.col("_q")) & F.col("document_id").eqNullSafe(F.col("_d")), "left_semi")


def retrieve(questions: DataFrame, spans: DataFrame, chunks: DataFrame, documents: DataFrame, turns: DataFrame, attachments: DataFrame | None = None, most: int = 10) -> DataFrame:
    """The evidence (EVIDENCE, and rank) of every question, at most `most` pieces of each, from all branches that its way of retrieval searches.

    questions(query_id, question, way, chunk_types, conversation_id, f_type, f_carrier, f_insured, f_number, f_quote);
    spans(span_id, document_id, text), chunks(chunk_id, document_id, type, text), documents as in found_documents(),
    turns(turn_id, conversation_id, pos, role, text), attachments(query_id, attachment_id, text). Spans and turns come
    by their share of the question's terms, as do chunks; of chunks asked for by type each type gets its share of
    `most`, rounded up. Spans keep that relevance, the other sources have one of their own (RELEVANCE); of turns the TURNS best count.
    """
    rows = cut(questions.withColumn("b", branches(F.col("way"), F.lit(True), F.coalesce(*(F.nullif(F.col(f"f_{c}"), F.lit("")) for c in _FILTERS)).isNotNull(), F.col("conversation_id").isNotNull())))
    best = lambda *by: Window.partitionBy(*by)
    own = lambda df, key: df.select(F.col(key).alias("_k"), *(c for c in df.columns if c != key))

    # what is best is found by ids, and its text is fetched afterwards
    s = cut(search.top(rows.where("b.spans"), spans, "span_id", most))
    s = s.join(own(spans, "span_id"), F.col("span_id") == F.col("_k"))
    c = search.lexical_hits(rows.where("b.chunks"), chunks, "chunk_id").join(own(chunks, "chunk_id").drop("text"), F.col("chunk_id") == F.col("_k"))
    kinds = rows.select(F.col("query_id").alias("_q"), "chunk_types", F.coalesce(F.size("chunk_types"), F.lit(0)).alias("kinds"))
    c = c.join(kinds, F.col("query_id") == F.col("_q")).where((F.col("kinds") <= 0) | F.array_contains("chunk_types", F.col("type")))
    group = F.when(F.col("kinds") > 0, F.col("type"))
    c = c.withColumn("_g", group).withColumn("_n", F.row_number().over(best("query_id", "_g").orderBy(F.desc("relevance"), "chunk_id")))
    c = c.where((F.col("_n") <= most) & (F.col("_n") <= F.when(F.col("kinds") > 0, F.ceil(F.lit(most) / F.col("kinds"))).otherwise(most)))  # the plain limit holds before the shuffle
    c = cut(c.select("query_id", "chunk_id", "document_id")).join(chunks.select(F.col("chunk_id").alias("_c"), "text"), F.col("chunk_id") == F.col("_c"))
    d = _first_documents(rows.where("b.documents"), documents, most)
    # turns are searched within the question's own conversation
    asked = rows.where("b.turns").select("query_id", F.col("conversation_id").alias("_conv"), T.tokens(F.col("question")).alias("_terms"))
    t = turns.join(asked, F.col("conversation_id") == F.col("_conv")).withColumn("relevance", T.lexical_relevance(F.col("text"), F.col("_terms"))).where("relevance > 0")
    t = t.withColumn("_n", F.row_number().over(best("query_id").orderBy(F.desc("relevance"), "pos", "turn_id"))).where(F.col("_n") <= TURNS)
    t = t.withColumn("text", F.concat(F.lit("["), "role", F.lit("]: "), "text")).drop("document_id")
    parts = [_as_evidence(s, "source_span", F.col("relevance")), _as_evidence(c, "chunk", F.lit(RELEVANCE["chunk"])), _as_evidence(d, "document", F.lit(RELEVANCE["document"])), _as_evidence(t, "conversation", F.lit(RELEVANCE["conversation"]))]
    if attachments is not None:
        parts.append(_as_evidence(attachments.join(rows.select(F.col("query_id").alias("_q")), F.col("query_id") == F.col("_q"), "left_semi"), "attachment", F.lit(RELEVANCE["attachment"])))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ranked(out, "query_id", most)


def rendered(evidence: DataFrame, query: str) -> DataFrame:
    """query, text: its evidence(rank, source, .., relevance, text), numbered and labelled, an empty line between."""
    label = F.when(F.col("source") == "source_node", F.concat(F.lit("[source-node:"), "node_id", F.lit(" source-span:"), F.coalesce("span_id", F.lit("none")), F.lit("]")))
    for source, word, c in (("source_span", "source-span", "span_id"), ("chunk", "chunk", "chunk_id"), ("document", "doc", "document_id"), ("attachment", "attachment", "attachment_id")):
        label = label.when(F.col("source") == source, F.concat(F.lit(f"[{word}:"), c, F.lit("]")))
    label = label.otherwise(F.concat(F.lit("[turn:"), "turn_id", F.lit("]")))
    line = F.concat(F.lit("Evidence "), "rank", F.lit(" "), label, F.lit(" (relevance: "), F.format_number("relevance", 2), F.lit("):\n"), "text")
    return evidence.groupBy(query).agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("t")))).alias("l")).select(query, F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("text"))


def document_summary(docs: DataFrame) -> DataFrame:
    """document_id, text of docs(document_id, type, carrier, insured, number, effective, expiration, premium, coverages: array of name, limit, deductible): what there is, a line each, with the first ten coverages."""
    line = lambda word, c, when=None: F.when((F.col(c) != "") if when is None else (F.col(c) != "") & when, F.concat(F.lit(word), c))
    policy, quote = F.col("type") == "policy", F.col("type") == "quote"
    n = F.coalesce(F.size("coverages"), F.lit(0))
    one = lambda c: F.concat(F.lit("  - "), F.concat_ws(" | ", F.nullif(c["name"], F.lit("")), F.when(c["limit"] != "", F.concat(F.lit("Limit: "), c["limit"])), F.when(c["deductible"] != "", F.concat(F.lit("Ded: "), c["deductible"]))))
    covered = F.when(n > 0, F.concat(F.lit("Coverages ("), n, F.lit("):\n"), F.array_join(F.transform(F.slice("coverages", 1, 10), one), "\n")))
    parts = [F.concat(F.lit("Document type: "), "type"), line("Carrier: ", "carrier"), line("Insured: ", "insured"), line("Policy #: ", "number", policy), line("Quote #: ", "number", quote), line("Effective: ", "effective", policy), line("Proposed effective: ", "effective", quote), line("Expiration: ", "expiration", policy), line("Premium: ", "premium"), covered]
    return docs.select("document_id", F.concat_ws("\n", *parts).alias("text"))
