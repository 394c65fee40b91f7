"""Whole policy-change cases over tables: opened from requests, carried on by replies, written out as packets.

What models proposed enters as tables of JSON. A proposal that isn't what was asked for costs its own case only: that case falls
back on what the words of the request or reply tell, and the proposal goes to a table of its own with what is wrong.
A case is known by the case_id its caller gives. Of two items of a case with the same id (policy, kind, field, value and spans
are the same) issues are told once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import scratch
from . import changes as C
from . import evidence as E

#: What items may say, the question for a value, the order of issues, and titles of a packet's parts.
ACTIONS = ("add", "remove", "update", "replace", "clarify")
ITEM_KINDS = ("named_insured_change", "additional_insured_change", "coverage_change", "limit_change", "deductible_change", "location_change", "vehicle_change", "certificate_endorsement_request", "cancellation", "nonrenewal", "renewal_submission_update", "general_endorsement")
STATES = ("draft", "needs_info", "ready", "blocked")
CONFIDENCE = ("high", "medium", "low")
ASK, WHY = "What new value should the carrier endorse for this change?", "The request did not include a clear target value."
CODES = ("missing_citation", "unknown_source", "quote_not_found", "existing_value_missing_source_span", "required_value_missing", "coverage_source_missing", "effective_date_unparseable", "effective_date_outside_policy_period", "endorsement_conflict", "notice_rule_ambiguous", "certificate_details_missing")
TITLES = (("underwriter_summary", "Underwriter summary"), ("carrier_email", "Carrier email"), ("missing_info_request", "Missing information request"), ("json_packet", "JSON packet"), ("validation_report", "Validation report"))
UNCITED = ("missing_info_request", "validation_report")

CITATION = "struct<sourceId:string,quote:string,page:double,fieldPath:string>"
ITEM = f"struct<id:string,action:string,kind:string,affectedPolicyId:string,fieldPath:string,label:string,beforeValue:string,afterValue:string,requestedValue:string,effectiveDate:string,reason:string,sourceIds:array<string>,sourceSpanIds:array<string>,citations:array<{CITATION}>,confidence:string,confidenceScore:double,status:string>"
QUESTION = "struct<id:string,itemId:string,fieldPath:string,question:string,reason:string,answer:string>"
PROPOSAL = f"struct<summary:string,items:array<{ITEM}>,missingInfoQuestions:array<{QUESTION}>>"
ANSWERS = "struct<answers:array<struct<questionId:string,fieldPath:string,answer:string>>>"


@dataclass
class Cases:
    """cases(case_id, request_text, requested, summary, mode), items(case_id, pos, item_id, ..), questions(case_id, pos, question_id, item_id, field_path, question, reason, answer),
    sources as they were given or found, issues(case_id, pos, item_id, code, severity, source_id, message), impacts: changes.impacts(), quarantine(case_id, error, json)."""

    cases: DataFrame
    items: DataFrame
    questions: DataFrame
    sources: DataFrame
    issues: DataFrame
    impacts: DataFrame
    quarantine: DataFrame


def cut(df: DataFrame) -> DataFrame:
    """scratch.cut() for tables of cases, which grow with each other: they meet in a shuffle, so none of them goes through the driver."""
    return scratch.cut(df).hint("merge")


def _at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _texts(v: Column, needed: tuple[str, ...], optional: tuple[str, ...]) -> Column:
    return _all(*(_is_text(_at(v, k)) for k in needed), *(_at(v, k).isNull() | _is_text(_at(v, k)) for k in optional))


def _one_of(v: Column, key: str, allowed: tuple[str, ...]) -> Column:
    said = F.coalesce(F.try_variant_get(v, f"$.{key}", "string").isin(*allowed), F.lit(False))
    return _at(v, key).isNull() | (_is_text(_at(v, key)) & said)


def _each(v: Column, key: str, holds) -> Column:
    """Whether a list is absent, or is one whose elements all hold."""
    return _at(v, key).isNull() | F.coalesce(F.forall(F.try_variant_get(v, f"$.{key}", "array<variant>"), holds), F.lit(False))


def _number(v: Column, key: str, least: float | None = None, most: float | None = None) -> Column:
    n = F.try_variant_get(v, f"$.{key}", "double")
    told = F.coalesce(~F.schema_of_variant(_at(v, key)).isin("STRING", "BOOLEAN", "VOID"), F.lit(False)) & n.isNotNull()
    return _at(v, key).isNull() | (told & (F.lit(True) if least is None else n.between(least, most)))


def _citation_ok(c: Column) -> Column:
    return _texts(c, ("sourceId", "quote"), ("fieldPath",)) & _number(c, "page")


def _item_ok(x: Column) -> Column:
    return _all(
        _texts(x, ("action", "fieldPath", "label"), ("id", "affectedPolicyId", "beforeValue", "afterValue", "requestedValue", "effectiveDate", "reason")),
        *(_one_of(x, k, allowed) for k, allowed in (("action", ACTIONS), ("kind", ITEM_KINDS), ("status", STATES), ("confidence", CONFIDENCE))),
        *(_each(x, k, _is_text) for k in ("sourceIds", "sourceSpanIds")),
        _each(x, "citations", _citation_ok),
        _number(x, "confidenceScore", 0, 1),
    )


def _one_each(proposals: DataFrame) -> DataFrame:
    """One proposal a case: of several the smallest text."""
    return proposals.groupBy("case_id").agg(F.min("json").alias("json"))


def checked_proposals(proposals: DataFrame) -> DataFrame:
    """proposals(case_id, json) -> case_id, json, error (null if it can be used), p (PROPOSAL)."""
    v = F.try_parse_json("json")
    rows = _one_each(proposals).withColumn("v", v)
    v = F.col("v")
    question = lambda q: _texts(q, ("question", "reason"), ("id", "itemId", "fieldPath", "answer"))
    error = (
        F.when(v.isNull(), "proposal is not JSON")
        .when(~_is_text(_at(v, "summary")), "proposal has no summary")
        .when(_at(v, "items").isNull() | ~_each(v, "items", lambda x: F.lit(True)), "proposal has no list of items")
        .when(~_each(v, "items", _item_ok), "an item is not as asked for")
        .when(~_each(v, "missingInfoQuestions", question), "a question is not as asked for")
    )
    return rows.withColumn("error", error).select("case_id", "json", "error", F.when(F.col("error").isNull(), F.from_json(F.to_json("v"), PROPOSAL)).alias("p"))


def checked_answers(proposals: DataFrame) -> DataFrame:
    """proposals(case_id, json) -> case_id, json, error, p (ANSWERS)."""
    rows = _one_each(proposals).withColumn("v", F.try_parse_json("json"))
    v = F.col("v")
    one = lambda a: _texts(a, ("answer",), ("questionId", "fieldPath"))
    error = F.when(v.isNull(), "proposal is not JSON").when(_at(v, "answers").isNull() | ~_each(v, "answers", one), "answers are not as asked for")
    return rows.withColumn("error", error).select("case_id", "json", "error", F.when(F.col("error").isNull(), F.from_json(F.to_json("v"), ANSWERS)).alias("p"))


def case_id_of(prefix: str, *parts: Column) -> Column:
    """An id by the hash of canonical parts: each is JSON text, or null for what is absent."""
    return F.concat(F.lit(f"{prefix}-"), T.case_hash(F.concat(F.lit("["), F.concat_ws(",", *(F.coalesce(p, F.lit("")) for p in parts)), F.lit("]"))).substr(1, 12))


def _proposed_items(sound: DataFrame, requests: DataFrame) -> DataFrame:
    rows = sound.select("case_id", F.posexplode("p.items").alias("pos", "i")).join(requests.select("case_id", F.col("text").alias("request_text")), "case_id")
    none = F.array().cast("array<string>")
    return rows.select(
        "case_id", "pos", F.col("i.id").alias("given"), "request_text", F.coalesce("i.kind", F.lit("general_endorsement")).alias("kind"), F.col("i.action").alias("action"), F.col("i.status").alias("status"),
        F.coalesce(F.nullif("i.label", F.lit("")), "i.fieldPath").alias("label"), F.col("i.reason").alias("reason"), F.col("i.fieldPath").alias("field_path"), F.coalesce("i.affectedPolicyId", F.lit("unknown")).alias("policy_id"),
        F.col("i.beforeValue").alias("before_value"), F.col("i.afterValue").alias("after_value"), F.col("i.requestedValue").alias("requested_value"), F.col("i.effectiveDate").alias("effective_date"),
        F.coalesce("i.sourceIds", none).alias("source_ids"), F.coalesce("i.sourceSpanIds", none).alias("source_span_ids"), F.coalesce("i.citations", F.array().cast(f"array<{CITATION}>")).alias("citations"),
        F.coalesce("i.confidence", F.lit("medium")).alias("confidence"), F.coalesce("i.confidenceScore", F.when(F.col("request_text") != "", 0.6).otherwise(0.3)).alias("score"),
    )


def _told_items(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """What the words of requests tell, with the page and field of the source that is cited."""
    first = sources.groupBy(F.col("case_id").alias("_c"), F.col("source_id").alias("_s")).agg(F.min_by(F.struct("page", "field_path"), "pos").alias("at"))
    made = C.request_items(requests, sources)
    rows = made.join(first, (F.col("case_id") == F.col("_c")) & (F.col("source_id") == F.col("_s")), "left").join(requests.select(F.col("case_id").alias("_r"), F.col("text").alias("request_text")), F.col("case_id") == F.col("_r"))
    none = F.lit(None).cast("string")
    cited = F.when(F.col("source_id").isNotNull(), F.array("source_id")).otherwise(F.array().cast("array<string>"))
    citation = F.struct(F.col("source_id").alias("sourceId"), F.col("before_value").alias("quote"), F.col("at.page").cast("double").alias("page"), F.col("at.field_path").alias("fieldPath"))
    citations = F.when(F.col("source_id").isNotNull(), F.array(citation)).otherwise(F.array().cast(f"array<{CITATION}>"))
    return rows.select(
        "case_id", F.lit(0).alias("pos"), none.alias("given"), "request_text", "kind", "action", none.alias("status"), "label", none.alias("reason"), "field_path", "policy_id", "before_value", F.col("requested_value").alias("after_value"), "requested_value",
        "effective_date", cited.alias("source_ids"), cited.alias("source_span_ids"), citations.alias("citations"), F.lit("low").alias("confidence"), F.lit(0.45).alias("score"),
    )


def _with_citation(items: DataFrame) -> DataFrame:
    """items with quote and quoted_source: of the citation whose quote is the value there was, else of the first."""
    same = F.filter("citations", lambda c: F.trim(c["quote"]) == F.trim(F.col("before_value")))
    c = F.when(F.coalesce(F.col("before_value") != "", F.lit(False)), F.coalesce(F.try_element_at(same, F.lit(1)), F.try_element_at("citations", F.lit(1))))
    return items.withColumn("_c", c).withColumns({"quote": F.col("_c.quote"), "quoted_source": F.col("_c.sourceId")}).drop("_c")


def messages(issues: DataFrame, items: DataFrame) -> DataFrame:
    """Issues as changes.validate() gives them, with pos (by item, then as rules are tried) and the message that goes with the code."""
    first = items.groupBy(F.col("case_id").alias("_c"), F.col("item_id").alias("_i")).agg(F.min_by(F.struct("pos", "field_path", "kind", "effective_date", "quoted_source"), "pos").alias("x"))
    rows = issues.join(first, (F.col("case_id") == F.col("_c")) & (F.col("item_id") == F.col("_i")))
    path, before, date, source = F.col("x.field_path"), F.concat("x.field_path", F.lit(".beforeValue")), F.col("x.effective_date"), F.coalesce("source_id", "x.quoted_source")
    says = (
        ("missing_citation", "Quoted value for ", before, " is missing a citation."),
        ("unknown_source", "Citation source ", source, " was not provided for ", before, "."),
        ("quote_not_found", "Quoted value for ", before, " was not found in source ", source, "."),
        ("existing_value_missing_source_span", "Existing value for ", path, " is missing source span evidence."),
        ("required_value_missing", "Requested value for ", path, " is missing."),
        ("coverage_source_missing", "Coverage change for ", path, " is not linked to existing coverage evidence."),
        ("effective_date_unparseable", "Requested effective date ", date, " could not be parsed."),
        ("effective_date_outside_policy_period", "Requested effective date ", date, " is outside the cited policy period."),
        ("endorsement_conflict", "Existing endorsement source ", source, " may conflict with the requested change."),
        ("notice_rule_ambiguous", F.col("x.kind"), " request needs an effective date and source-backed notice/timing terms."),
        ("certificate_details_missing", "Certificate-driven endorsement request is missing holder or requirement details."),
    )
    message = F.coalesce(*(F.when(F.col("code") == code, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))) for code, *parts in says))
    place = F.col("x.pos") * len(CODES) + F.array_position(F.array(*map(F.lit, CODES)), F.col("code")) - 1
    return rows.select("case_id", place.cast("long").alias("pos"), "item_id", "code", "severity", "source_id", message.alias("message"))


def _judged(cases: DataFrame, items: DataFrame, questions: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cases with mode, issues and impacts, as the items and questions now are."""
    issues = cut(messages(C.validate(items, sources), items))
    impacts = C.impacts(items, sources)
    modes = C.execution_modes(C.case_flags(cases, items, sources, questions, issues), impacts)
    return cases.join(modes, "case_id"), issues, impacts


def open_cases(requests: DataFrame, sources: DataFrame, proposals: DataFrame | None = None, retrieved: DataFrame | None = None, most: int = 8, mode: str = "auto") -> Cases:
    """requests(case_id, text, requested), one a case; requested: a mode, or null for `mode`. sources(case_id, pos, source_id, label, text, document_id,
    page, field_path, form_number, starts, ends); retrieved: the same with relevance, of which each case takes the best `most`;
    proposals(case_id, json): PROPOSAL. A null text counts as empty."""
    requests = requests.select("case_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("requested", F.lit(mode)).alias("requested"))
    if retrieved is not None:
        both = C.collect_evidence(sources, retrieved, most)
        sources = cut(both.withColumn("pos", F.row_number().over(Window.partitionBy("case_id").orderBy("source_id")).cast(both.schema["pos"].dataType)))
    proposals = requests.select("case_id", F.lit("").alias("json")).limit(0) if proposals is None else proposals
    told = cut(checked_proposals(proposals.join(requests.select("case_id"), "case_id", "left_semi")))
    sound = told.where("error IS NULL")
    plain = requests.join(sound.select("case_id"), "case_id", "left_anti")
    cited = F.array_sort(F.array_distinct(F.transform("citations", lambda c: c["sourceId"])))
    items = C.finalise(_proposed_items(sound, requests).unionByName(_told_items(plain, sources)).withColumn("cited_ids", cited))
    items = cut(_with_citation(items.withColumn("item_id", F.coalesce("given", "item_id")).drop("given", "cited_ids", "request_text")))
    own = sound.select("case_id", F.posexplode("p.missingInfoQuestions").alias("pos", "q")).select("case_id", "pos", F.col("q.id").alias("given"), F.col("q.itemId").alias("of"), F.col("q.fieldPath").alias("field_path"), "q.question", "q.reason", "q.answer")
    lacking = items.join(plain.select("case_id"), "case_id", "left_semi").where("after_value IS NULL OR after_value = ''")
    none = F.lit(None).cast("string")
    asked = own.unionByName(lacking.select("case_id", F.lit(0).alias("pos"), none.alias("given"), none.alias("of"), "field_path", F.lit(ASK).alias("question"), F.lit(WHY).alias("reason"), none.alias("answer")))
    first = items.groupBy(F.col("case_id").alias("_c"), F.col("field_path").alias("_f")).agg(F.min_by("item_id", "pos").alias("_i"))
    rows = asked.join(first, (F.col("case_id") == F.col("_c")) & (F.col("field_path") == F.col("_f")), "left").withColumn("item_id", F.coalesce("of", "_i"))
    made = case_id_of("question", *(T.json_string(F.col(c)) for c in ("item_id", "field_path", "question")))
    questions = cut(rows.select("case_id", "pos", F.coalesce("given", made).alias("question_id"), "item_id", "field_path", "question", "reason", "answer"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(" ", "action", "label").alias("t")))), lambda x: x["t"]), "; ")
    listed = items.groupBy(F.col("case_id").alias("_l")).agg(line.alias("listed"), F.min_by("label", "pos").alias("label"))
    named = sound.select(F.col("case_id").alias("_s"), F.col("p.summary").alias("said"))
    summed = requests.join(named, F.col("case_id") == F.col("_s"), "left").join(listed, F.col("case_id") == F.col("_l"), "left")
    summary = F.when(F.col("_s").isNull(), F.col("label")).otherwise(F.coalesce(F.nullif("said", F.lit("")), "listed", F.lit("")))
    cases, issues, impacts = _judged(cut(summed.select("case_id", F.col("text").alias("request_text"), "requested", summary.alias("summary"))), items, questions, sources)
    return Cases(cases, items, questions, sources, issues, impacts, told.where("error IS NOT NULL").select("case_id", "error", "json"))


@dataclass
class Replied:
    """state: all cases as they now are; merged(case_id, n_answered) of the cases that had a reply; quarantine(case_id, error, json)."""

    state: Cases
    merged: DataFrame
    quarantine: DataFrame


def reply(state: Cases, replies: DataFrame, proposals: DataFrame | None = None, mode: str = "auto") -> Replied:
    """replies(case_id, text), one a case; proposals(case_id, json): ANSWERS, looked at where a question is open. Cases without a reply stay as they are.

    A question takes the first answer to its id or field, also if it had one; a blank one changes nothing. Items that lacked a
    value take the last answer to them, and issues, impacts and mode are told anew.
    """
    replies = replies.join(state.cases.select("case_id"), "case_id", "left_semi")
    ids = replies.select("case_id").distinct()
    part = lambda df: df.join(ids, "case_id", "left_semi")
    rest = lambda df: df.join(ids, "case_id", "left_anti")
    questions = part(state.questions)
    open_ = questions.where(F.coalesce("answer", F.lit("")) == "").select("case_id").distinct()
    proposals = replies.select("case_id", F.lit("").alias("json")).limit(0) if proposals is None else proposals
    told = cut(checked_answers(part(proposals).join(open_, "case_id", "left_semi")))
    sound = told.where("error IS NULL")
    alone = C.reply_answers(replies.join(sound.select("case_id"), "case_id", "left_anti"), questions).select("case_id", F.lit(0).alias("pos"), "question_id", F.lit(None).cast("string").alias("field_path"), F.col("answer").alias("text"))
    answers = sound.select("case_id", F.posexplode("p.answers").alias("pos", "a")).select("case_id", "pos", F.nullif("a.questionId", F.lit("")).alias("question_id"), F.nullif("a.fieldPath", F.lit("")).alias("field_path"), F.col("a.answer").alias("text")).unionByName(alone)
    within = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("case_id").alias("c"), F.col(c).alias("x")))
    keys = questions.select(within("question_id").alias("id"), within("field_path").alias("path")).distinct()
    found = E.first_answers(keys, answers.select("pos", within("question_id").alias("question_id"), within("field_path").alias("field_path"), "text"))
    found = found.where(F.trim("answer") != "").select(F.col("id").alias("_id"), F.coalesce("path.x", F.lit("")).alias("_path"), F.col("answer").alias("_a"))
    joined = questions.join(found, within("question_id").eqNullSafe(F.col("_id")) & (F.coalesce("field_path", F.lit("")) == F.col("_path")), "left")
    new = cut(joined.withColumn("_new", F.col("_a").isNotNull() & ~F.col("_a").eqNullSafe(F.col("answer"))).withColumn("answer", F.coalesce("_a", "answer")).drop("_id", "_path", "_a"))
    counts = new.groupBy(F.col("case_id").alias("_c")).agg(F.count_if("_new").alias("n"))
    merged = ids.join(counts, F.col("case_id") == F.col("_c"), "left").select("case_id", F.coalesce("n", F.lit(0)).alias("n_answered"))
    new = new.drop("_new")
    items = cut(C.fill_from_answers(part(state.items), new))
    sources = part(state.sources)
    cases, issues, impacts = _judged(part(state.cases).drop("mode").withColumn("requested", F.lit(mode)), items, new, sources)
    both = lambda before, now: rest(before).unionByName(now)
    after = replace(state, cases=both(state.cases, cases), items=both(state.items, items), questions=both(state.questions, new), issues=both(state.issues, issues), impacts=both(state.impacts, impacts))
    return Replied(after, merged, told.where("error IS NOT NULL").select("case_id", "error", "json"))


def packets(state: Cases, at: Column) -> DataFrame:
    """case_id, packet_id, artifact_id, kind, title, content, citations: the five parts of each case's packet, made at a time in ms. Citations of a
    part are those of all items, each once, in order. The JSON part is not indented, and holds no absent values."""
    texts = C.packet_texts(state.cases, state.items, state.impacts, state.questions, state.issues)
    listed = lambda df, value, order, name: df.groupBy(F.col("case_id").alias(f"_{name}")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_v")))), lambda x: x["_v"]).alias(name))
    item = F.struct(
        F.col("item_id").alias("id"), "kind", "action", F.col("policy_id").alias("affectedPolicyId"), F.col("field_path").alias("fieldPath"), "label", F.col("before_value").alias("beforeValue"), F.col("after_value").alias("afterValue"), F.col("requested_value").alias("requestedValue"), F.col("effective_date").alias("effectiveDate"),
        "reason", F.col("source_ids").alias("sourceIds"), F.col("source_span_ids").alias("sourceSpanIds"), "citations", "confidence", F.col("score").alias("confidenceScore"), "status",
    )
    impact = F.struct(F.col("item_id").alias("itemId"), F.col("before_value").alias("beforeValue"), F.col("requested_value").alias("requestedValue"), F.col("endorsement_required").alias("likelyEndorsementRequired"), F.col("approval_required").alias("carrierApprovalLikelyRequired"), F.col("forms").alias("affectedCoverageForms"), F.col("source_span_ids").alias("sourceSpanIds"))
    places = state.items.groupBy(F.col("case_id").alias("_pc"), F.col("item_id").alias("_pi")).agg(F.min("pos").alias("pos"))
    placed = state.impacts.join(places, (F.col("case_id") == F.col("_pc")) & (F.col("item_id") == F.col("_pi")))
    rows = texts
    parts = (listed(state.items, item, ["pos"], "items"), "items"), (listed(placed, impact, ["pos", "item_id"], "impacts"), "impacts"), (listed(state.sources, F.col("source_id"), ["pos", "source_id"], "sources"), "sources")
    for df, name in parts:
        rows = rows.join(df, F.col("case_id") == F.col(f"_{name}"), "left").drop(f"_{name}")
    empty = F.array()
    body = F.to_json(F.struct(F.col("case_id").cast("string").alias("caseId"), F.coalesce("items", empty).alias("items"), F.coalesce("impacts", empty).alias("impacts"), F.coalesce("sources", empty).alias("evidenceSourceIds")))
    cited = F.array_distinct(F.coalesce(F.flatten(F.transform("items", lambda i: i["citations"])), F.array().cast(f"array<{CITATION}>")))
    own = T.json_string(F.col("case_id").cast("string"))
    names = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("items.id", F.array().cast("array<string>")), T.json_string), ","), F.lit("]"))
    packet = case_id_of("packet", own, at.cast("long").cast("string"), names)
    rows = rows.withColumns({"json_packet": body, "_cited": cited, "packet_id": packet})
    no = F.array().cast(f"array<{CITATION}>")
    made = [F.struct(F.lit(k).alias("kind"), F.lit(title).alias("title"), F.col(k).alias("content"), (no if k in UNCITED else F.col("_cited")).alias("citations")) for k, title in TITLES]
    rows = rows.select("case_id", "packet_id", F.explode(F.array(*made)).alias("a"))
    return rows.select("case_id", "packet_id", case_id_of("artifact", T.json_string(F.col("case_id").cast("string")), T.json_string(F.col("a.kind"))).alias("artifact_id"), "a.kind", "a.title", "a.content", "a.citations")
