"""Reviews: answers against their evidence, applications and their e-mails, extracted records; each gives rows of issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .evidence import section_precedence


def _given(*columns: str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns))


def evidence_key() -> Column:
    return F.coalesce(*(F.col(c).cast("string") for c in ("span_id", "chunk_id", "document_id", "turn_id", "attachment_id")))


def citation_key() -> Column:
    return _given("span_id", "chunk_id", "document_id")


def issue(code: str, severity: str, **columns: Column | str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), *((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()))


def _raised(rows: DataFrame, keep: list[str], rules: list[tuple[Column, str, str]]) -> DataFrame:
    """One row for each rule (condition, code, severity) that holds, rows read once."""
    made = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for c, code, severity in rules))
    return rows.select(*keep, F.explode(F.filter(made, lambda x: x.isNotNull())).alias("i")).select(*keep, "i.code", "i.severity")


def supported(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """citations with found (evidence of the same source), quoted (some of it holds the quote) and grounded (some of it is a chunk or a source span)."""
    e = evidence.select(F.col("query_id").alias("_q"), evidence_key().alias("_k"), F.col("source").alias("_src"), F.col("text").alias("_t"))
    key = ["query_id", "answer_id", "idx"]
    rows = citations.withColumn("source_id", citation_key()).join(e, (F.col("query_id") == F.col("_q")) & (F.col("source_id") == F.col("_k")), "left")
    return rows.groupBy(*key, "source_id", "quote").agg(F.count("_k").alias("_n"), F.coalesce(F.bool_or(F.contains("_t", "quote")), F.lit(False)).alias("quoted"), F.coalesce(F.bool_or(F.col("_src").isin("chunk", "source_span")), F.lit(False)).alias("grounded")).withColumn("found", F.col("_n") > 0).drop("_n")


def query_review(answers: DataFrame, citations: DataFrame, evidence: DataFrame, finals: DataFrame | None = None, final_citations: DataFrame | None = None) -> DataFrame:
    """query_id, answer_id, idx, source_id, code, severity.

    answers(query_id, answer_id, answer, confidence, needs_more), citations(query_id, answer_id, idx, quote, span_id,
    chunk_id, document_id), evidence(query_id, source, span_id, chunk_id, document_id, turn_id, attachment_id, text),
    finals(query_id, answer, confidence), final_citations: as citations, without answer_id.
    """
    n = citations.groupBy(F.col("query_id").alias("_q"), F.col("answer_id").alias("_a")).agg(F.count("*").alias("_n"))
    rows = answers.join(n, (F.col("query_id") == F.col("_q")) & (F.col("answer_id") == F.col("_a")), "left").withColumns({"idx": F.lit(None).cast("int"), "source_id": F.lit(None).cast("string")})
    keep = ["query_id", "answer_id", "idx", "source_id"]
    bare = F.col("_n").isNull()
    out = _raised(rows, keep, [(bare & ~F.col("needs_more"), "subanswer_missing_citations", "blocking"), (bare & (F.col("confidence") >= 0.85), "subanswer_high_confidence_without_citations", "blocking")])
    found = F.col("found")
    claim = T.states_claim(F.col("quote"))
    out = out.unionByName(_raised(supported(citations, evidence), keep, [(~found, "citation_missing_from_evidence", "blocking"), (found & ~F.col("quoted"), "citation_quote_not_in_evidence", "warning"), (found & ~F.col("grounded") & claim, "citation_claim_lacks_chunk_or_source_span", "blocking")]))
    if finals is None:
        return out
    none = F.lit(None).cast(answers.schema["answer_id"].dataType)
    cited = final_citations.groupBy(F.col("query_id").alias("_q")).agg(F.count("*").alias("_n"))
    rows = finals.join(cited, F.col("query_id") == F.col("_q"), "left").withColumns({"answer_id": none, "idx": F.lit(None).cast("int"), "source_id": F.lit(None).cast("string")})
    out = out.unionByName(_raised(rows, keep, [((F.trim("answer") != "") & F.col("_n").isNull() & (F.col("confidence") > 0.4), "final_answer_missing_citations", "blocking")]))
    same = F.concat_ws("|", "query_id", "idx", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("span_id", "chunk_id", "document_id"))).alias("_same")
    unknown = final_citations.withColumns({"answer_id": none, "source_id": citation_key(), "_same": same}).join(citations.select(same).distinct(), "_same", "left_anti")
    return out.unionByName(_raised(unknown, keep, [(F.lit(True), "final_answer_unknown_citation", "warning")]))


def to_retry(answers: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, answer_id of answers that state a claim without a citation, or whose citation of a claim has no chunk or span behind it: these are asked again."""
    bare = answers.join(citations.select("query_id", "answer_id").distinct(), ["query_id", "answer_id"], "left_anti").where(~F.col("needs_more") & T.states_claim(F.col("answer")))
    weak = supported(citations, evidence).where(~F.col("grounded") & T.states_claim(F.col("quote")))
    return bare.select("query_id", "answer_id").unionByName(weak.select("query_id", "answer_id")).distinct()


def query_confidence(answers: DataFrame) -> DataFrame:
    """query_id, confidence: the least of its answers', 1 at most."""
    return answers.groupBy("query_id").agg(F.least(F.lit(1.0), F.min("confidence")).alias("confidence"))


def status(issues: DataFrame, groups: DataFrame, key: str, rounds: DataFrame | None = None) -> DataFrame:
    """key, status of every group, also without issues: failed, warning (also by rounds(key, approved, n_issues) that weren't clean) or passed."""
    had = issues.groupBy(F.col(key).alias("_k")).agg(F.bool_or(F.col("severity") == "blocking").alias("_b"), F.bool_or(F.col("severity") == "warning").alias("_w"))
    rows = groups.select(key).distinct().join(had, F.col(key) == F.col("_k"), "left")
    doubt = F.coalesce("_w", F.lit(False))
    if rounds is not None:
        bad = rounds.where(~F.col("approved") | (F.col("n_issues") > 0)).select(F.col(key).alias("_rk")).distinct()
        rows = rows.join(bad, F.col(key) == F.col("_rk"), "left")
        doubt = doubt | F.col("_rk").isNotNull()
    return rows.select(key, F.when(F.col("_b"), "failed").when(doubt, "warning").otherwise("passed").alias("status"))


#: Sources that can't be cited; words of fields and sources that need evidence.
VAGUE, VAGUE_PARTS = ("unknown", "context", "user provided"), ("existing records", "available data")
WEIGHTY = r"policy|effective|expiration|date|limit|deductible|premium|coverage|exclusion|condition|endorsement|location|vehicle|named insured|revenue|payroll|loss|claim|prior"
FROM_POLICY = r"policy|quote|document|lookup|carrier|endorsement"


def _filled(c: str = "value") -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def vague(source: Column) -> Column:
    low = F.lower(F.trim(source))
    return source.isNull() | (source == "") | low.isin(*VAGUE) | reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in VAGUE_PARTS))


def unevidenced() -> Column:
    """A filled value that comes from a policy and matters, without a span."""
    words = F.lower(F.concat_ws(" ", F.coalesce("section", F.lit("")), F.coalesce("label", F.lit(""))))
    matters = words.rlike(rf"{T.B}(?:{WEIGHTY}){T.B}") | F.col("field_type").isin("currency", "date", "numeric", "declaration")
    none = (F.coalesce(F.size("source_span_ids"), F.lit(0)) <= 0) & (F.coalesce(F.size("user_source_span_ids"), F.lit(0)) <= 0)
    return _filled() & none & F.lower(F.coalesce("source", F.lit(""))).rlike(rf"{T.B}(?:{FROM_POLICY}){T.B}") & matters


def application_review(fields: DataFrame) -> DataFrame:
    """app_id, id, pos, code, severity. fields(app_id, pos, id, label, section, field_type, required, value, source, confidence, source_span_ids, user_source_span_ids)."""
    again = F.row_number().over(Window.partitionBy("app_id", "id").orderBy("pos")) > 1
    rows = fields.withColumn("_again", again)
    had = _filled()
    return _raised(rows, ["app_id", "id", "pos"], [
        (F.col("_again"), "duplicate_field_id", "blocking"),
        (F.col("required") & ~had, "required_field_unfilled", "warning"),
        (had & ~_filled("source"), "filled_field_missing_source", "blocking"),
        (had & vague(F.col("source")), "filled_field_vague_source", "warning"),
        (had & (~_filled("confidence") | (F.col("confidence") == "low")), "filled_field_low_confidence", "warning"),
        (unevidenced(), "policy_value_missing_source_span", "blocking"),
    ])


def email_review(emails: DataFrame, fields: DataFrame) -> DataFrame:
    """app_id, id of fields asked for whose label (six characters or more) the e-mail(app_id, text) doesn't name."""
    label = F.lower(F.trim("label"))
    rows = fields.join(emails.select("app_id", F.lower("text").alias("_t")), "app_id").where((F.length(label) >= 6) & ~F.contains("_t", label))
    return rows.select("app_id", "id", F.lit("email_missing_field_prompt").alias("code"), F.lit("warning").alias("severity"))


#: Fixed patterns: entries of a table of contents, and rows that name a deductible.
TOC = r"\.{4,}\d{1,3}\z|^\d+\.\s+[A-Z][\s\S]*\.{3,}\d{1,3}\z"
_HELD = rf"{T.B}(?:deductible|retention|self[-\s]?insured retention|sir){T.B}"


def contents_entry(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(TOC), F.lit(False))


def deductible_row() -> Column:
    """Whether a coverage(name, original, deductible, limit) holds a deductible where its limit should be."""
    name, said = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce(F.nullif(F.col("original"), F.lit("")), "name", F.lit("")))
    named = F.concat_ws(" ", name, said).rlike(_HELD)
    told = (F.coalesce("original", F.lit("")) != "") & said.rlike(_HELD) & ~said.rlike(rf"{T.B}(?:sub[-\s]?limit|limit|coverage){T.B}")
    return named & ~_filled("deductible") & _filled("limit") & (told | name.rlike(rf"[-–—]\s*(?:enhanced\s+|standard\s+)?(?:deductible|retention|sir){T.B}"))


def form_inventory(entries: DataFrame) -> DataFrame:
    """entries(doc_id, seq, form_number, source, title, page_start, page_end) -> a form of each document: for each attribute the first that is there, and its sources in order."""
    rows = entries.withColumn("form_number", F.nullif(F.trim("form_number"), F.lit(""))).where("form_number IS NOT NULL")
    first = lambda c, there: F.min_by(c, F.when(there, F.col("seq"))).alias(c)
    rows = rows.groupBy("doc_id", "form_number").agg(first("title", F.col("title") != ""), first("page_start", F.col("page_start") > 0), first("page_end", F.col("page_end") > 0), F.sort_array(F.collect_list(F.struct("seq", "source"))).alias("l"))
    return rows.select("doc_id", "form_number", "title", "page_start", "page_end", F.array_distinct(F.transform("l", lambda x: x["source"])).alias("sources"))


def _with_sections(records: DataFrame) -> DataFrame:
    """records, and where a document has no definitions (covered reasons) of its own, those of its sections that are some, once more as such."""
    if "type" not in records.columns:
        return records
    out = records
    for kind, is_one in (("definitions", F.col("type") == "definition"), ("coveredReasons", T.covered_reason(F.col("name"), F.col("type")))):
        own = records.where(F.col("kind") == kind).select(F.col("doc_id").alias("_d")).distinct()
        found = records.where((F.col("kind") == "sections") & F.coalesce(is_one, F.lit(False)))
        out = out.unionByName(found.join(own, F.col("doc_id") == F.col("_d"), "left_anti").withColumn("kind", F.lit(kind)))
    return out


def extraction_review(records: DataFrame, mapped: DataFrame | None = None, forms: DataFrame | None = None, sources: bool = True) -> DataFrame:
    """doc_id, kind, seq, code, severity of extracted records(doc_id, seq, kind, name, form_number, page, section, original, limit, deductible, n_spans, and of sections page_end and type where known).

    kind: coverages, endorsements, exclusions, conditions, sections, definitions or coveredReasons; original: a
    record's wording, page: where it starts. Blocking: a record that says something without a span (unless sources is
    false), an endorsement without a form, header and deductible rows among coverages, entries of a table of contents
    among exclusions and conditions. Warnings: what lacks a page, a section or its wording; sections that look like
    fragments; coverages that disagree with the one of highest precedence of their name and form; with mapped(doc_id,
    kind), kinds that pages were given to but that nothing was found of; with forms(doc_id, form_number), forms that
    aren't among these. (Forms count as known once a record names them, so without `forms` there is nothing to tell.)
    """
    keep = ["doc_id", "kind", "seq"]
    records = _with_sections(records)
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    of = lambda *kinds: F.col("kind").isin(*kinds)
    coverage, bare, nowhere = of("coverages"), text("original") == "", F.col("page").isNull()
    said = reduce(lambda a, b: a | b, (text(c) != "" for c in ("name", "original", "limit", "deductible")))
    whole = F.lit(True) if "page_end" not in records.columns else F.col("page_end").isNull() | (F.col("page_end") == F.col("page"))
    contents = contents_entry(F.col("original"))
    out = _raised(records, keep, [
        (F.lit(sources) & said & (F.coalesce(F.col("n_spans"), F.lit(0)) == 0), "record_missing_source_span", "blocking"),
        (of("endorsements") & (text("form_number") == ""), "endorsement_missing_form_number", "blocking"),
        (coverage & text("name").rlike(r"(?i)coverage form\z"), "generic_form_row_as_coverage", "blocking"),
        (coverage & deductible_row(), "deductible_row_as_coverage_limit", "blocking"),
        (coverage & nowhere, "coverage_missing_page_number", "warning"),
        (coverage & (text("section") == ""), "coverage_missing_section_ref", "warning"),
        (coverage & bare, "coverage_missing_original_content", "warning"),
        (of("exclusions") & nowhere, "exclusion_missing_page_number", "warning"),
        (of("exclusions") & contents, "exclusion_toc_artifact", "blocking"),
        (of("conditions") & nowhere, "condition_missing_page_number", "warning"),
        (of("conditions") & contents, "condition_toc_artifact", "blocking"),
        (of("definitions") & bare, "definition_missing_content", "warning"),
        (of("definitions") & nowhere, "definition_missing_page_number", "warning"),
        (of("coveredReasons") & bare, "covered_reason_missing_content", "warning"),
        (of("coveredReasons") & nowhere, "covered_reason_missing_page_number", "warning"),
        (of("sections") & F.col("original").isNotNull() & (F.length(text("original")) < 120) & ~nowhere & whole, "section_short_fragment", "warning"),
    ])
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    rank = Window.partitionBy("doc_id", low("name"), low("form_number")).orderBy(F.desc(section_precedence(F.col("section"))), "seq")
    rows = records.where(coverage).withColumns({"_k": F.row_number().over(rank), "_l": F.first("limit").over(rank), "_d": F.first("deductible").over(rank)})
    unlike = lambda a, b: (text(a) != "") & (text(b) != "") & (text(a) != text(b))
    out = out.unionByName(_raised(rows.where("_k > 1"), keep, [(unlike("limit", "_l") | unlike("deductible", "_d"), "coverage_precedence_conflict", "warning")]))
    if forms is not None:
        known = forms.select(F.col("doc_id").alias("_d"), F.trim("form_number").alias("_f")).distinct()
        unknown = records.where(of("coverages", "endorsements") & (text("form_number") != "")).join(known, (F.col("doc_id") == F.col("_d")) & (text("form_number") == F.col("_f")), "left_anti")
        out = out.unionByName(_raised(unknown, keep, [(coverage, "coverage_form_missing_from_inventory", "warning"), (~coverage, "endorsement_form_missing_from_inventory", "warning")]))
    if mapped is not None:
        gone = mapped.select("doc_id", "kind").distinct().join(records.select("doc_id", "kind").distinct(), ["doc_id", "kind"], "left_anti").withColumn("seq", F.lit(None).cast(records.schema["seq"].dataType))
        out = out.unionByName(_raised(gone, keep, [(of("definitions"), "definitions_mapped_but_empty", "warning"), (of("coveredReasons"), "covered_reasons_mapped_but_empty", "warning")]))
    return out
