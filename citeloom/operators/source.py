"""Source spans: building, filters, orders, chunks; and the ledger of what they say.

Spans are rows with id, document_id and text, and with any of these: pos (input order), page_start, page_end, loc_page,
loc_start_page, loc_end_page, line_start, char_start, source_unit, source_kind, chunk_id, section_id, form_number,
parent_span_id, table_id, row_index, column_index, column_name, row_span_id, is_header, metadata (a map of strings). A
column that isn't there counts as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .spans import merge_metadata, pack

#: Where what has no place comes: after everything.
LATE = 2**53 - 1


def has(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def meta(df: DataFrame, key: str) -> Column:
    return F.try_element_at("metadata", F.lit(key)) if "metadata" in df.columns else F.lit(None).cast("string")


def page_start(df: DataFrame, recovery: bool = False) -> Column:
    """The first page of a span. Recovery prefers a location's first page to its page; everything else the other way."""
    more = ("loc_start_page", "loc_page") if recovery else ("loc_page", "loc_start_page")
    return F.coalesce(*(has(df, c, "int") for c in ("page_start", *more)))


def page_end(df: DataFrame, recovery: bool = False) -> Column:
    more = [has(df, "loc_page", "int")] if recovery else []
    return F.coalesce(has(df, "page_end", "int"), has(df, "loc_end_page", "int"), *more, page_start(df, recovery))


def unit(df: DataFrame) -> Column:
    return F.coalesce(has(df, "source_unit"), meta(df, "sourceUnit"), meta(df, "elementType"))


def table_of(df: DataFrame) -> Column:
    return F.coalesce(has(df, "table_id"), meta(df, "tableId"))


def row_of(df: DataFrame) -> Column:
    return F.coalesce(has(df, "parent_span_id"), has(df, "row_span_id"), meta(df, "rowSpanId"))


def span_id(document: Column, page: Column, index: Column, text_hash: Column) -> Column:
    return F.concat_ws(":", T.id_part(document.cast("string")), F.lit("span"), F.coalesce(page.cast("string"), F.lit("na")), index.cast("string"), text_hash.substr(1, 12))


def build_spans(df: DataFrame, index: Column) -> DataFrame:
    """df(document_id, text and other columns of spans) -> with id, text (normalised), text_hash and kind."""
    rows = df.withColumn("text", T.normalize_ws(F.col("text"))).withColumn("text_hash", T.stable_hash(T.json_string(F.col("text"))))
    kind = F.when(has(df, "source_kind").endswith("_pdf"), "pdf_text").otherwise("plain_text")
    return rows.withColumns({"id": span_id(F.col("document_id"), has(df, "page_start", "int"), index, F.col("text_hash")), "kind": kind})


def page_spans(pages: DataFrame) -> DataFrame:
    """pages(document_id, page, text): a span for each page with text; numbered after the empty ones went."""
    rows = pages.where(T.normalize_ws(F.col("text")) != "").withColumn("_i", F.row_number().over(Window.partitionBy("document_id").orderBy("page")) - 1)
    rows = rows.withColumns({"page_start": F.col("page"), "page_end": F.col("page"), "source_kind": F.coalesce(has(pages, "source_kind"), F.lit("policy_pdf")), "source_unit": F.lit("page")})
    return build_spans(rows, F.col("_i")).drop("_i", "page")


def row_text(headers: Column, cells: Column) -> Column:
    """A table row as 'header: value | header: value'; empty cells are left out, nameless columns are counted from 1."""
    one = lambda c, i: F.when(F.trim(c) != "", F.concat(F.coalesce(F.nullif(F.trim(F.try_element_at(headers, i + 1)), F.lit("")), F.concat(F.lit("Column "), i + 1)), F.lit(": "), F.trim(c)))
    return F.array_join(F.filter(F.transform(cells, one), lambda x: x.isNotNull()), " | ")


def grid_markdown(rows: Column) -> Column:
    """An array of rows (arrays of cells) as a markdown table whose first row is the head; short rows are filled up, bars escaped."""
    cell = lambda r, i: F.replace(T.normalize_ws(F.coalesce(F.try_element_at(r, i), F.lit(""))), F.lit("|"), F.lit("\\|"))
    line = lambda r, width: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), width), lambda i: cell(r, i)), " | "), F.lit(" |"))
    rule = lambda width: F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    # the rule is put behind the first line; rows and width are told once, not for each line
    lines = lambda rs, width: F.transform(rs, lambda r, i: F.when(i == 0, F.concat_ws("\n", line(r, width), rule(width))).otherwise(line(r, width)))
    made = lambda rs: T.let(F.array_max(F.transform(rs, lambda r: F.size(r))), lambda width: F.when(width > 0, F.array_join(lines(rs, width), "\n")))
    return F.coalesce(T.let(rows, made), F.lit(""))


def page_range_text(spans: DataFrame, first: int, last: int) -> DataFrame:
    """document_id, text of the pages from first to last (held within the document's), each under 'Page n'."""
    rows = spans.withColumn("_p", page_start(spans)).where("_p IS NOT NULL")
    ends = rows.groupBy("document_id").agg(F.min("_p").alias("_a"), F.max("_p").alias("_z"))
    rows = rows.join(ends, "document_id").where((F.col("_p") >= F.greatest(F.lit(first), "_a")) & (F.col("_p") <= F.least(F.lit(last), "_z")))
    pages = rows.groupBy("document_id", "_p").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n").alias("t"))
    said = F.concat(F.lit("Page "), F.col("_p"), F.lit("\n"), F.col("t")).alias("t")
    return pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("_p", said))).alias("l")).select("document_id", F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("text"))


def filter_spans(spans: DataFrame, documents: list | None = None, chunks: list | None = None, filters: dict[str, str] | None = None, stored: bool = False) -> DataFrame:
    """An empty filter doesn't count; with a chunk filter spans without a chunk go. Each of `filters` must match the metadata or the column sourceKind, formNumber or sectionId.

    stored: as the stored search has it: only these three keys count, by column, and spans without an embedding go.
    """
    columns = {"sourceKind": "source_kind", "formNumber": "form_number", "sectionId": "section_id"}
    if documents:
        spans = spans.where(F.col("document_id").isin(documents))
    if chunks:
        spans = spans.where(has(spans, "chunk_id").isin(chunks))
    for key, value in (filters or {}).items():
        own = has(spans, columns[key]).eqNullSafe(value) if key in columns else F.lit(False)
        if stored and key not in columns:
            continue
        spans = spans.where(own if stored else own | meta(spans, key).eqNullSafe(value))
    return spans.where("embedding IS NOT NULL") if stored else spans


def filter_chunks(chunks: DataFrame, document: str = "", kind: str = "") -> DataFrame:
    """Chunks of a document and of a type; a metadata filter isn't applied, as the stored search takes it and doesn't use it."""
    chunks = chunks.where(F.col("document_id") == document) if document else chunks
    return chunks.where(F.col("type") == kind) if kind else chunks


def chunkable(spans: DataFrame) -> DataFrame:
    """Spans without the table cells whose row is there as a span."""
    rows = spans.where(unit(spans) == "table_row").select(F.col("id").alias("_row"))
    marked = spans.withColumn("_of", F.when(unit(spans) == "table_cell", row_of(spans)))
    return marked.join(rows, F.col("_of") == F.col("_row"), "left_anti").drop("_of")


def source_chunks(spans: DataFrame, most: int = 6000) -> DataFrame:
    """Spans packed in the order of pos: id, document_id, n, source_span_ids, text, text_hash, page_start, page_end. Page bounds are the first and last that aren't null, not the least and greatest."""
    rows = chunkable(spans)
    rows = rows.withColumns({"_len": F.length("text"), "_a": has(spans, "page_start", "int"), "_z": F.coalesce(has(spans, "page_end", "int"), has(spans, "page_start", "int"))})
    places = pack(rows, "document_id", "pos", "_len", most).select(F.col("document_id").alias("_d"), F.col("pos").alias("_p"), "chunk")
    rows = rows.join(places, (F.col("document_id") == F.col("_d")) & (F.col("pos") == F.col("_p")))
    l = rows.groupBy("document_id", F.col("chunk").alias("n")).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "text", "_a", "_z"))).alias("l"))
    some = lambda c: F.filter(F.transform("l", lambda x: x[c]), lambda x: x.isNotNull())
    made = l.select("document_id", "n", F.transform("l", lambda x: x["id"]).alias("source_span_ids"), F.array_join(F.transform("l", lambda x: x["text"]), "\n\n").alias("text"), F.try_element_at(some("_a"), F.lit(1)).alias("page_start"), F.try_element_at(some("_z"), F.lit(-1)).alias("page_end"))
    made = made.withColumn("text_hash", T.text_hash(F.col("text")))
    said = F.concat(F.lit('{"sourceSpanIds":['), F.array_join(F.transform("source_span_ids", T.json_string), ","), F.lit('],"textHash":"'), "text_hash", F.lit('"}'))
    return made.withColumn("id", F.concat_ws(":", T.id_part(F.col("document_id").cast("string")), F.lit("source_chunk"), "n", T.stable_hash(said).substr(1, 12)))


def chunk_metadata(spans: DataFrame, group: str) -> DataFrame:
    """group, key, value: the spans' metadata joined, with form number, section and kind as the last span that has them says."""
    own = {"formNumber": "form_number", "sectionId": "section_id", "sourceKind": "source_kind"}
    return merge_metadata(spans, group, "pos", "metadata", {k: c for k, c in own.items() if c in spans.columns})


def ordinal(key: Column) -> Column:
    """The number in a span's id."""
    return F.regexp_extract(key, r":span:[^:]+:(\d+):[^:]+\z", 1).try_cast("long")


def tree_order(spans: DataFrame) -> list[Column]:
    """A total order: page, row, column, table, what the span is, id (binary)."""
    rank = F.when(unit(spans) == "page", 0).when(unit(spans) == "table", 1).when(unit(spans) == "table_row", 2).when(unit(spans) == "table_cell", 3).otherwise(4)
    zero = lambda c, key: F.coalesce(has(spans, c, "int"), meta(spans, key).try_cast("int"), F.lit(0))
    return [F.coalesce(page_start(spans), F.lit(0)), zero("row_index", "rowIndex"), zero("column_index", "columnIndex"), F.coalesce(table_of(spans), F.lit("")), rank, F.col("id")]


def ledger_order(spans: DataFrame) -> list[Column]:
    """Page, table, row, column, line, character, number in the id, input order; what is missing comes last, rows and columns first."""
    late = lambda c: F.coalesce(has(spans, c, "long"), F.lit(LATE))
    return [F.coalesce(page_start(spans).cast("long"), F.lit(LATE)), F.coalesce(has(spans, "table_id"), F.lit("")), F.coalesce(has(spans, "row_index", "int"), F.lit(0)), F.coalesce(has(spans, "column_index", "int"), F.lit(0)), late("line_start"), late("char_start"), F.coalesce(ordinal(F.col("id")), F.lit(LATE)), F.col("pos")]


#: What a policy's fields are called, and what their values may look like. Each is tried on a span's text.
_SEP, _OLD = r"\s*[:#-]?\s*", r"(?:\s*/\s*time)?"
NAMES = {
    "policy_number": r"policy\s*(?:number|no\.?|#)",
    "named_insured": r"(?:first\s+)?named\s+insured(?:\s+name)?",
    "carrier": r"(?:carrier|insurer|insurance\s+company|company\s+name)",
    "effective_date": rf"(?:policy\s+)?effective\s+date{_OLD}",
    "expiration_date": rf"(?:policy\s+)?(?:expiration|expiry)\s+date{_OLD}",
}
ALSO = {
    "named_insured": r"insured\s+name",
    "effective_date": r"(?:policy\s+)?(?:period|term)\s+(?:from|begin(?:s|ning)?)",
    "expiration_date": r"(?:policy\s+)?(?:period|term)\s+(?:to|end(?:s|ing)?)",
}
LENGTHS = {"policy_number": (2, 80), "named_insured": (2, 160), "carrier": (2, 180), "effective_date": (4, 80), "expiration_date": (4, 80)}
MONTHS = r"(?i)(?:\d{1,2}[/-]\d{1,2}|\d{4}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
CORE = r"policy\s*(?:number|no\.?|#)|named\s+insured|insured\s+name|carrier|insurer|insurance\s+company|policy\s+period|effective\s+date|expiration\s+date|expiry\s+date|producer|broker|general\s+agent|declarations?"
COVERAGE = r"coverage|coverages|covered|limit(?:s)?\s+of\s+(?:insurance|liability)|deductible|retention|insuring\s+agreement|schedule\s+of|vehicle\s+schedule|auto\s+schedule|property\s+schedule|location\s+schedule|coverage\s+part|premium\s+schedule"
PARTY = r"endorsement|additional\s+insured|named\s+insured|loss\s+payee|mortgagee|carrier|insurer|producer|broker|general\s+agent|changes?\s+the\s+policy"


def names_only(field: str, text: Column) -> Column:
    return text.rlike(rf"(?i)^\s*{NAMES[field]}{_SEP}\z")


def plausible(field: str, value: Column) -> Column:
    """Whether a normalised value can be the field's."""
    fits = value.rlike("(?i)[A-Z]")
    if field == "policy_number":
        fits = value.rlike("(?i)[A-Z0-9]")
    elif field.endswith("_date"):
        fits = value.rlike(r"\d") & value.rlike(MONTHS)
    return (value != "") & (F.length(value) <= 180) & ~names_only(field, value) & fits


def normalised(field: str, value: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(value, r"^[\s:#-]+", ""), r"[\s|;,]+\z", ""))
    return F.upper(F.regexp_replace(bare, r"\s+", "")) if field == "policy_number" else F.upper(bare) if field.endswith("_date") else F.lower(bare)


def with_nodes(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """Spans with text, in ledger order (place), with the ids of the nodes that cite them (by ord, id), and node_text: titles, descriptions and paths of these. nodes(id, document_id, ord, title, description, path, kind, source_span_ids)."""
    said = F.concat_ws(" ", "title", "description", "path")
    by_span = nodes.select(F.explode("source_span_ids").alias("_s"), F.struct("ord", "id", said.alias("t"), F.coalesce((F.col("kind") == "endorsement") | F.concat_ws(" ", "title", "path").rlike(rf"(?i){T.B}endorsement{T.B}"), F.lit(False)).alias("e")).alias("n"))
    by_span = by_span.groupBy("_s").agg(F.sort_array(F.collect_list("n")).alias("_n"))
    rows = spans.withColumn("text", T.normalize_ws(F.col("text"))).where("text <> ''")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy(*ledger_order(spans))))
    rows = rows.join(by_span, F.col("id") == F.col("_s"), "left")
    n = F.coalesce("_n", F.array().cast(by_span.schema["_n"].dataType))
    return rows.withColumns({"node_ids": F.transform(n, lambda x: x["id"]), "node_text": F.array_join(F.transform(n, lambda x: x["t"]), " "), "in_endorsement": F.exists(n, lambda x: x["e"])}).drop("_s", "_n")


def ledger_candidates(projected: DataFrame) -> DataFrame:
    """projected: with_nodes(). document_id, field, value, normalized_value, source_span_ids, source_node_ids, page_start, page_end: values that stand beside their name in a span, or in the span after one that is the name alone (same page, same row or table). Spans that no node cites don't count; of equal values of the same spans the first stays."""
    p = projected
    w = Window.partitionBy("document_id").orderBy("place")
    rows = p.withColumns({"_page": F.coalesce(has(p, "page_start", "int"), has(p, "loc_page", "int")), "_a": page_start(p), "_z": F.coalesce(has(p, "page_end", "int"), has(p, "loc_end_page", "int")), "_table": has(p, "table_id"), "_row": has(p, "row_span_id")})
    after = {c: F.lead(c).over(w).alias(f"n_{c}") for c in ("id", "text", "_page", "_a", "_z", "_table", "_row", "node_ids")}
    rows = rows.select("document_id", "place", "id", "text", "_page", "_a", "_z", "_table", "_row", "node_ids", *after.values()).where(F.size("node_ids") > 0)
    found = []
    for field, name in NAMES.items():
        low, high = LENGTHS[field]
        for k, pattern in enumerate([name, ALSO[field]] if field in ALSO else [name]):
            value = T.normalize_ws(F.regexp_extract("text", rf"(?i){T.B}{pattern}{_SEP}([^\n|;]{{{low},{high}}})", 1))
            found.append(F.struct(F.lit(field).alias("field"), F.lit(k).alias("rule"), F.when(plausible(field, value), value).alias("value"), normalised(field, value).alias("norm")))
        same_page = F.col("_page").isNull() | F.col("n__page").isNull() | (F.col("_page") == F.col("n__page"))
        same_table = F.coalesce(F.col("_row") == F.col("n__row"), F.lit(False)) | F.col("_table").isNull() | F.col("_table").eqNullSafe(F.col("n__table"))
        beside = names_only(field, F.col("text")) & (F.size("n_node_ids") > 0) & same_page & same_table & plausible(field, F.col("n_text"))
        found.append(F.struct(F.lit(field).alias("field"), F.lit(9).alias("rule"), F.when(beside, F.col("n_text")).alias("value"), normalised(field, F.col("n_text")).alias("norm")))
    rows = rows.withColumn("f", F.explode(F.filter(F.array(*found), lambda x: x["value"].isNotNull())))
    two = F.col("f.rule") == 9
    both = lambda one, other: F.when(two, F.array_sort(F.array_distinct(F.concat(one, other)))).otherwise(F.array_sort(F.array_distinct(one)))
    rows = rows.select("document_id", "place", F.col("f.rule").alias("rule"), F.col("f.field").alias("field"), F.col("f.value").alias("value"), F.col("f.norm").alias("normalized_value"), both(F.array("id"), F.array("n_id")).alias("source_span_ids"), both(F.col("node_ids"), F.col("n_node_ids")).alias("source_node_ids"), F.when(two, F.least("_a", "_z", "n__a", "n__z")).otherwise(F.least("_a", "_z")).alias("page_start"), F.when(two, F.greatest("_a", "_z", "n__a", "n__z")).otherwise(F.greatest("_a", "_z")).alias("page_end"))
    first = F.row_number().over(Window.partitionBy("document_id", "field", "normalized_value", "source_span_ids").orderBy("rule", "place"))
    return rows.withColumn("_k", first).where("_k = 1").drop("_k", "rule", "place")


def ledger_fields(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, field, status, ambiguous, n_candidates for every field of every document; ambiguous: of more than one distinct value."""
    every = documents.select("document_id").distinct().withColumn("field", F.explode(F.array(*map(F.lit, NAMES))))
    seen = candidates.groupBy("document_id", "field").agg(F.count("*").alias("n"), F.count_distinct("normalized_value").alias("d"))
    rows = every.join(seen, ["document_id", "field"], "left")
    return rows.select("document_id", "field", F.when(F.col("n") > 0, "observed").otherwise("not_observed").alias("status"), F.coalesce(F.col("d") > 1, F.lit(False)).alias("ambiguous"), F.coalesce("n", F.lit(0)).alias("n_candidates"))


def coverage_map(projected: DataFrame) -> DataFrame:
    """document_id, source_span_id, place, assignment: whether a span and its nodes speak of the policy's core, of coverage, of both or of neither; an endorsement that changes a party is both."""
    said = F.concat_ws(" ", "text", "node_text")
    holds = lambda words: said.rlike(rf"(?i){T.B}(?:{words}){T.B}")
    core, coverage, party = holds(CORE), holds(COVERAGE), F.col("in_endorsement") & holds(PARTY)
    kind = F.when(party | (core & coverage), "both").when(core, "core").when(coverage, "coverage").otherwise("catch_all")
    return projected.select("document_id", F.col("id").alias("source_span_id"), "place", kind.alias("assignment"))


def shards(assigned: DataFrame) -> DataFrame:
    """document_id and the span ids of each assignment, in order."""
    of = lambda kind: F.transform(F.filter("l", lambda x: x["assignment"] == kind), lambda x: x["source_span_id"]).alias(kind)
    rows = assigned.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("place", "source_span_id", "assignment"))).alias("l"))
    return rows.select("document_id", of("core"), of("coverage"), of("both"), of("catch_all"))


def coverage_regions(projected: DataFrame) -> DataFrame:
    """document_id, source_span_id, label, source_node_ids, page_start, page_end of cited spans that speak of coverage."""
    said = F.concat_ws(" ", "node_text", "text")
    rows = projected.where((F.size("node_ids") > 0) & said.rlike(rf"(?i){T.B}(?:{COVERAGE}){T.B}"))
    a, z = F.coalesce(has(rows, "page_start", "int"), has(rows, "loc_page", "int")), F.coalesce(has(rows, "page_end", "int"), has(rows, "loc_end_page", "int"))
    return rows.select("document_id", F.col("id").alias("source_span_id"), F.substring("text", 1, 240).alias("label"), F.array_sort(F.array_distinct("node_ids")).alias("source_node_ids"), F.least(a, z).alias("page_start"), F.greatest(a, z).alias("page_end"))


def fingerprints(projected: DataFrame) -> DataFrame:
    """document_id, fingerprint: a hash over ids, text hashes and pages of its spans in order; absent values aren't part of it."""
    number = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f',"{name}":'), c.cast("string"))).otherwise(F.lit(""))
    own = F.coalesce(has(projected, "text_hash"), T.text_hash(F.col("text")))
    end, start = F.coalesce(has(projected, "page_end", "int"), has(projected, "loc_end_page", "int")), F.coalesce(has(projected, "page_start", "int"), has(projected, "loc_page", "int"))
    one = F.concat(F.lit('{"hash":'), T.json_string(own), F.lit(',"id":'), T.json_string(F.col("id")), number("pageEnd", end), number("pageStart", start), F.lit("}"))
    rows = projected.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("place", one.alias("o")))).alias("l"))
    return rows.select("document_id", T.stable_hash(F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["o"]), ","), F.lit("]"))).alias("fingerprint"))


def ledger(spans: DataFrame, nodes: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """document_id, fingerprint, n_eligible, n_projected, complete (every span is cited by a node and, if given, in processed(id)), ambiguous, regions (observed or not)."""
    p = with_nodes(spans, nodes)
    done = p.join(processed.select(F.col("id").alias("_done")).distinct(), F.col("id") == F.col("_done"), "left") if processed is not None else p.withColumn("_done", F.col("id"))
    counts = done.groupBy("document_id").agg(F.count("*").alias("n_eligible"), F.count_if(F.size("node_ids") > 0).alias("n_projected"), F.count_if(F.col("_done").isNull()).alias("_open"))
    doubt = ledger_fields(ledger_candidates(p), p).groupBy("document_id").agg(F.bool_or("ambiguous").alias("ambiguous"))
    regions = coverage_regions(p).groupBy("document_id").agg(F.lit("observed").alias("regions"))
    rows = fingerprints(p).join(counts, "document_id").join(doubt, "document_id").join(regions, "document_id", "left")
    complete = (F.col("n_projected") == F.col("n_eligible")) & (F.col("_open") == 0)
    return rows.select("document_id", "fingerprint", "n_eligible", "n_projected", complete.alias("complete"), "ambiguous", F.coalesce("regions", F.lit("not_observed")).alias("regions"))

