"""Policy-change requests: what each item touches, and how a case is to be worked; lines of business of coverages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import evidence as E

#: Kinds of items, and words that leave a cancellation open.
CERTIFICATE, RENEWAL = "certificate_endorsement_request", "renewal_submission_update"
ENDING, FINANCIAL = ("cancellation", "nonrenewal"), ("limit_change", "deductible_change")
OPEN = r"(?i)\b(if|unless|maybe|possibly|unsure|unclear|or|pending|conditional)\b"


def impacts(items: DataFrame, sources: DataFrame, case: str = "case_id") -> DataFrame:
    """items(case, item_id, kind, before_value, requested_value, after_value, source_span_ids, source_ids) and
    sources(case, source_id, form_number, label) -> one row an item, uncited ones too. A source is named by its form, else its label."""
    none = F.array().cast("array<string>")
    ids = F.array_sort(F.array_distinct(F.concat(F.coalesce("source_span_ids", none), F.coalesce("source_ids", none))))
    rows = items.withColumn("source_span_ids", ids)
    named = sources.select(case, "source_id", F.coalesce("form_number", "label").alias("form")).where("form <> ''")
    cited = rows.select(case, "item_id", F.explode("source_span_ids").alias("source_id")).join(named, [case, "source_id"])
    forms = cited.groupBy(case, "item_id").agg(F.array_sort(F.collect_set("form")).alias("forms"))  # an item's citations at most
    return rows.join(forms, [case, "item_id"], "left").select(
        case,
        "item_id",
        "kind",
        "before_value",
        F.coalesce("requested_value", "after_value").alias("requested_value"),
        (F.col("kind") != RENEWAL).alias("endorsement_required"),
        (F.col("kind") != CERTIFICATE).alias("approval_required"),
        F.coalesce("forms", none).alias("forms"),
        "source_span_ids",
    )


def execution_modes(cases: DataFrame, impact_rows: DataFrame, case: str = "case_id") -> DataFrame:
    """cases(case, requested, request_text, blocking, conflicting, unclear) and impacts() -> case, mode. The first rule that holds decides."""
    many = F.col("kind").isin(*FINANCIAL) & ((F.size("forms") > 1) | (F.size("source_span_ids") > 1))
    flags = impact_rows.groupBy(case).agg(F.max(F.col("kind").isin(*ENDING)).alias("_ending"), F.max(many).alias("_many"))
    holds = lambda c: F.coalesce(c, F.lit(False))
    doubt = holds(F.col("blocking")) | holds(F.col("conflicting")) | holds(F.col("_ending") & F.col("request_text").rlike(OPEN)) | holds(F.col("unclear"))
    mode = F.when(F.col("requested") != "auto", F.col("requested")).when(doubt, "hybrid").when(holds(F.col("_many")), "market_eval").otherwise("deterministic_tree")
    return cases.join(flags, case, "left").select(case, mode.alias("mode"))


def line_of_coverage(explicit: Column, inferred: Column, of_profile: Column) -> Column:
    """A coverage's line: its own code unless unspecific (UN), else the only one inferred, else, if none is, the profile's only specific one. Null if none can be told."""
    specific = F.filter(of_profile, lambda c: c != "UN")
    return F.when(explicit != "UN", explicit).when(F.size(inferred) == 1, F.try_element_at(inferred, F.lit(1))).when((F.size(inferred) <= 0) & (F.size(specific) == 1), F.try_element_at(specific, F.lit(1)))


#: What the kind of a change and its field are told by, in this order; words of conflicts and certificates.
KINDS = (("additional_insured_change", ("additional insured",)), ("named_insured_change", ("named insured",)), ("limit_change", ("limit",)), ("deductible_change", ("deductible",)), ("location_change", ("location", "address")), ("vehicle_change", ("vehicle", "auto")), ("certificate_endorsement_request", ("certificate", "holder")), ("cancellation", ("cancel",)), ("nonrenewal", ("nonrenew",)), ("renewal_submission_update", ("renewal", "submission")), ("coverage_change", ("coverage",)))
PATHS = (("insured.address", "address"), ("auto.vehicles", "vehicle"), ("auto.drivers", "driver"), ("coverage.limit", "limit"), ("coverage.deductible", "deductible"))
REFUSES = r"excludes|exclusion|prohibits|not\s+covered|no\s+coverage|must\s+not"
HOLDERS = r"holder|certificate holder|additional insured|loss payee|lender|landlord"
DEMANDS = r"primary|non[- ]?contributory|waiver|subrogation|notice|endorsement|requirement|wording"
PERIOD = r"(?i)(?:policy\s+period|effective){b}[^.\n]*?(\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}})\s*(?:to|-|through)\s*(\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}})"


def _word(pattern: str) -> str:
    return rf"{T.B}(?:{pattern}){T.B}"


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def change_kind(field_path: Column, text: Column) -> Column:
    low = F.lower(F.concat_ws(" ", field_path, text))
    out = None
    for kind, words in KINDS:
        held = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
        out = F.when(held, kind) if out is None else out.when(held, kind)
    return out.otherwise("general_endorsement")


def field_path(text: Column) -> Column:
    out = None
    for path, word in PATHS:
        held = F.contains(F.lower(text), F.lit(word))
        out = F.when(held, path) if out is None else out.when(held, path)
    return out.otherwise("policy.change")


def after_value(text: Column, before: Column) -> Column:
    """What a request says after 'to', up to the end of its sentence, without quotes; if that is the value there was, what it says after 'from .. to'."""
    plain = F.nullif(F.trim(F.regexp_extract(text, rf"(?i){T.B}to\s+([^.;\n]+)", 1)), F.lit(""))
    other = F.nullif(F.trim(F.regexp_extract(text, rf"(?i){T.B}from\s+.+?\s+to\s+([^.;\n]+)", 1)), F.lit(""))
    return F.regexp_replace(F.when(plain.isNotNull() & ~plain.eqNullSafe(before), plain).otherwise(other), r'^"|"\z', "")


def action(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("remove")) | F.contains(low, F.lit("delete")), "remove").when(F.contains(low, F.lit("add")), "add").otherwise("update")


def request_items(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """requests(case_id, text), sources(case_id, pos, source_id, text, document_id): one item a request, as its words tell it.

    case_id, action, kind, field_path, label, before_value (the first quoted text that a source holds), source_id (the
    first such source), requested_value, effective_date, policy_id (the first document of the sources), asks (whether a
    value has to be asked for).
    """
    quotes = requests.select("case_id", F.posexplode(F.regexp_extract_all("text", F.lit('"([^"]+)"'), 1)).alias("k", "q"))
    held = quotes.join(sources.select(F.col("case_id").alias("_c"), "pos", "source_id", F.lower("text").alias("_t")), (F.col("case_id") == F.col("_c")) & F.contains("_t", F.lower("q")))
    first = held.groupBy(F.col("case_id").alias("_hc")).agg(F.min_by(F.struct("q", "source_id"), F.struct("k", "pos")).alias("h"))
    policy = sources.where("document_id IS NOT NULL").groupBy(F.col("case_id").alias("_pc")).agg(F.min_by("document_id", "pos").alias("_policy"))
    rows = requests.join(first, F.col("case_id") == F.col("_hc"), "left").join(policy, F.col("case_id") == F.col("_pc"), "left")
    path, value = field_path(F.col("text")), after_value(F.col("text"), F.col("h.q"))
    label = F.nullif(F.trim(F.split("text", r"[.;\n]")[0]), F.lit(""))
    date = F.nullif(F.regexp_extract("text", rf"{T.B}\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}{T.B}", 0), F.lit(""))
    return rows.select("case_id", action(F.col("text")).alias("action"), change_kind(path, F.col("text")).alias("kind"), path.alias("field_path"), F.coalesce(label, F.lit("Policy change")).alias("label"), F.col("h.q").alias("before_value"), F.col("h.source_id").alias("source_id"), value.alias("requested_value"), date.alias("effective_date"), F.coalesce("_policy", F.lit("unknown")).alias("policy_id"), value.isNull().alias("asks"))


def item_id(policy: Column, kind: Column, path: Column, value: Column, span_ids: Column) -> Column:
    """A change item's id: a hash over these, in this order; what is absent counts as empty."""
    parts = [T.json_string(F.coalesce(c, F.lit(""))) for c in (policy, kind, path, value, F.array_join(F.coalesce(span_ids, F.array().cast("array<string>")), "|"))]
    return F.concat(F.lit("pci-"), T.case_hash(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))).substr(1, 12))


def finalise(items: DataFrame) -> DataFrame:
    """items(case_id, kind, field_path, after_value, requested_value, action, status, policy_id, source_span_ids, cited_ids, request_text) with what is missing filled in: requested and after value for each other, spans by citations, kind, policy, status and item_id."""
    spans = F.when(F.coalesce(F.size("source_span_ids"), F.lit(0)) > 0, F.col("source_span_ids")).otherwise(F.array_sort(F.array_distinct(F.coalesce("cited_ids", F.array().cast("array<string>")))))
    after = F.coalesce("after_value", "requested_value")
    rows = items.withColumns({"status": F.coalesce("status", F.when((F.coalesce("after_value", F.lit("")) == "") & (F.col("action") != "remove"), "needs_info").otherwise("ready")), "kind": F.coalesce("kind", change_kind(F.col("field_path"), F.col("request_text"))), "policy_id": F.coalesce("policy_id", F.lit("unknown")), "requested_value": F.coalesce("requested_value", after), "source_span_ids": spans})
    rows = rows.withColumn("after_value", F.coalesce("after_value", "requested_value"))
    return rows.withColumn("item_id", item_id(*(F.col(c) for c in ("policy_id", "kind", "field_path", "after_value", "source_span_ids"))))


def policy_periods(sources: DataFrame, case: str = "case_id") -> DataFrame:
    """case, start, stop (ms), source_id of the first of sources(case, pos, source_id, text, starts, ends) that names a period, in its data or its text. A bound at 0 ms counts as none."""
    ms = lambda c: F.nullif(T.us_date_millis(F.replace(c, F.lit("-"), F.lit("/"))), F.lit(0))
    both = lambda a, z: T.let(F.struct(ms(a).alias("a"), ms(z).alias("z")), lambda p: F.when(p["a"].isNotNull() & p["z"].isNotNull(), p))
    pattern = T.B + PERIOD.format(b=T.B)
    found = T.let(F.struct(F.regexp_extract("text", pattern, 1).alias("x"), F.regexp_extract("text", pattern, 2).alias("y")), lambda s: both(s["x"], s["y"]))
    # the pattern begins with one of these words: most texts need no more than a look for them
    told = F.when(F.col("text").ilike("%period%") | F.col("text").ilike("%effective%"), found)
    given = F.when(F.col("starts").isNotNull() & F.col("ends").isNotNull(), both(F.col("starts"), F.col("ends")))
    rows = sources.withColumn("p", F.coalesce(given, told)).where("p IS NOT NULL")
    return rows.groupBy(case).agg(F.min_by(F.struct("p.a", "p.z", "source_id"), "pos").alias("b")).select(case, F.col("b.a").alias("start"), F.col("b.z").alias("stop"), F.col("b.source_id").alias("source_id"))


def validate(items: DataFrame, sources: DataFrame, case: str = "case_id") -> DataFrame:
    """case, item_id, code, severity, source_id. items(case, item_id, kind, action, status, label, reason, field_path,
    before_value, after_value, requested_value, effective_date, source_span_ids, source_ids, quote, quoted_source: the
    citation of the value there was), sources(case, pos, source_id, label, text, starts, ends)."""
    none = F.array().cast("array<string>")
    spans, ids = F.coalesce("source_span_ids", none), F.array_union(F.coalesce("source_span_ids", none), F.coalesce("source_ids", none))
    own = F.struct(F.col(case).alias("c"), F.col("source_id").alias("s"))
    quoted = E.quoted_issues(
        items.select(F.struct(F.col(case).alias("c"), F.col("item_id").alias("i")).alias("item_id"), F.col("before_value").alias("quote"), F.when(F.col("quoted_source").isNotNull(), F.struct(F.col(case).alias("c"), F.col("quoted_source").alias("s"))).alias("source_id"), F.col("quote").alias("cited")),
        sources.select(own.alias("id"), F.col("text").alias("body"), "pos"),
    )
    named = items.select(F.struct(F.col(case).alias("c"), F.col("item_id").alias("i")).alias("k"), "quoted_source")
    quoted = quoted.join(named, F.col("item_id") == F.col("k")).select(F.col("item_id.c").alias(case), F.col("item_id.i").alias("item_id"), "code", "severity", F.when(F.col("code") != "missing_citation", F.col("quoted_source")).alias("source_id"))
    refusing = sources.where(F.concat_ws(" ", "label", "text").rlike(f"(?i){T.B}endorsement{T.B}") & F.col("text").rlike(f"(?i){_word(REFUSES)}")).select(F.col(case).alias("_c"), F.col("source_id").alias("_s"), F.col("pos").alias("_p"))
    linked = items.select(case, "item_id", F.explode(ids).alias("_id")).join(refusing, (F.col(case) == F.col("_c")) & (F.col("_id") == F.col("_s"))).groupBy(F.col(case).alias("_lc"), F.col("item_id").alias("_li")).agg(F.min_by("_s", "_p").alias("_refuses"))
    periods = policy_periods(sources, case).select(F.col(case).alias("_pc"), "start", "stop", F.col("source_id").alias("_period"))
    rows = items.join(linked, (F.col(case) == F.col("_lc")) & (F.col("item_id") == F.col("_li")), "left").join(periods, F.col(case) == F.col("_pc"), "left")
    date = T.us_date_millis(F.replace("effective_date", F.lit("-"), F.lit("/")))
    dated = F.coalesce(F.col("effective_date") != "", F.lit(False))
    words = F.lower(F.concat_ws(" ", "label", "after_value", "requested_value", "reason"))
    uncited = F.size(ids) == 0
    rule = lambda cond, code, severity="blocking", source=None: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), (source if source is not None else F.lit(None).cast("string")).alias("source_id")))
    made = F.array(
        rule(~_blank("before_value") & uncited, "existing_value_missing_source_span"),
        rule((F.col("status") == "needs_info") | (_blank("after_value") & _blank("requested_value") & (F.col("action") != "remove")), "required_value_missing"),
        rule((F.col("kind") == "coverage_change") & (F.col("action") != "add") & uncited, "coverage_source_missing"),
        rule(dated & (date.isNull() | (date == 0)), "effective_date_unparseable", "warning"),
        rule(dated & (date != 0) & ((date < F.col("start")) | (date > F.col("stop"))), "effective_date_outside_policy_period", "blocking", F.col("_period")),
        rule(F.col("_refuses").isNotNull(), "endorsement_conflict", "blocking", F.col("_refuses")),
        rule(F.col("kind").isin(*ENDING) & (~dated | (F.size(spans) == 0)), "notice_rule_ambiguous"),
        rule((F.col("kind") == CERTIFICATE) & ~(words.rlike(_word(HOLDERS)) & words.rlike(_word(DEMANDS))), "certificate_details_missing"),
    )
    out = rows.select(case, "item_id", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x")).select(case, "item_id", "x.*")
    return quoted.unionByName(out).distinct()


def unclear_certificates(items: DataFrame, questions: DataFrame, case: str = "case_id") -> DataFrame:
    """case of those with a certificate request that is unclear: without a value or spans, of low confidence, in need of information or asked about in questions(case, item_id, field_path)."""
    asked = lambda c: questions.where(F.col(c).isNotNull()).select(F.col(case).alias(f"_{c}c"), F.col(c).alias(f"_{c}")).distinct()
    rows = items.where(F.col("kind") == CERTIFICATE).join(asked("item_id"), (F.col(case) == F.col("_item_idc")) & (F.col("item_id") == F.col("_item_id")), "left").join(asked("field_path"), (F.col(case) == F.col("_field_pathc")) & (F.col("field_path") == F.col("_field_path")), "left")
    doubt = (F.col("status") == "needs_info") | _blank("after_value") | (F.col("confidence") == "low") | (F.coalesce(F.size("source_span_ids"), F.lit(0)) <= 0) | F.col("_item_id").isNotNull() | F.col("_field_path").isNotNull()
    return rows.where(F.coalesce(doubt, F.lit(False))).select(case).distinct()


def case_flags(cases: DataFrame, items: DataFrame, sources: DataFrame, questions: DataFrame, issues: DataFrame, case: str = "case_id") -> DataFrame:
    """cases with blocking, conflicting and unclear, as execution_modes() takes them, from the issues, the sources(case, text, field_path, form_number, label) and the items themselves."""
    mark = lambda df, name: df.select(F.col(case).alias(f"_{name}")).distinct()
    rows = cases.join(mark(issues.where("severity = 'blocking'"), "b"), F.col(case) == F.col("_b"), "left").join(mark(E.conflicting_sources(sources, case), "c"), F.col(case) == F.col("_c"), "left").join(mark(unclear_certificates(items, questions, case), "u"), F.col(case) == F.col("_u"), "left")
    return rows.withColumns({"blocking": F.col("_b").isNotNull(), "conflicting": F.col("_c").isNotNull(), "unclear": F.col("_u").isNotNull()}).drop("_b", "_c", "_u")


def collect_evidence(provided: DataFrame, retrieved: DataFrame, most: int = 8, case: str = "case_id") -> DataFrame:
    """The sources given and the best `most` retrieved(.., relevance) of each case; of a source that comes twice the later counts."""
    best = retrieved.withColumn("_r", F.row_number().over(Window.partitionBy(case).orderBy(F.desc("relevance"), "source_id"))).where(F.col("_r") <= most)
    rows = provided.withColumn("_p", F.lit(0)).unionByName(best.withColumn("_p", F.col("_r")).select(*provided.columns, "_p"))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(case, "source_id").orderBy(F.desc("_p")))).where("_k = 1").drop("_k", "_p")


def fill_from_answers(items: DataFrame, questions: DataFrame, case: str = "case_id") -> DataFrame:
    """items whose empty values take the last answer of questions(case, pos, item_id, field_path, answer) to the item, or, of questions that name none, to its field; items that needed information are then ready."""
    q = questions.where(~_blank("answer")).select(F.col(case).alias("_c"), F.col("pos").alias("_p"), F.col("item_id").alias("_i"), F.col("field_path").alias("_f"), F.trim("answer").alias("_a"))
    by_item = items.select(case, "item_id").join(q.where("_i IS NOT NULL"), (F.col(case) == F.col("_c")) & (F.col("item_id") == F.col("_i")))
    by_path = items.select(case, "item_id", "field_path").join(q.where("_i IS NULL"), (F.col(case) == F.col("_c")) & (F.col("field_path") == F.col("_f")))
    last = by_item.select(case, "item_id", "_p", "_a").unionByName(by_path.select(case, "item_id", "_p", "_a")).groupBy(F.col(case).alias("_lc"), F.col("item_id").alias("_li")).agg(F.max_by("_a", "_p").alias("_x"))
    rows = items.join(last, (F.col(case) == F.col("_lc")) & (F.col("item_id") == F.col("_li")), "left")
    return rows.withColumns({"after_value": F.coalesce("after_value", "_x"), "requested_value": F.coalesce("requested_value", "_x"), "status": F.when(F.col("_x").isNotNull() & (F.col("status") == "needs_info"), "ready").otherwise(F.col("status"))}).drop("_lc", "_li", "_x")


def reply_answers(replies: DataFrame, questions: DataFrame, case: str = "case_id") -> DataFrame:
    """case, question_id, answer: a reply(case, text) answers the open question of a case that has one alone."""
    open_ = questions.where(F.coalesce("answer", F.lit("")) == "").groupBy(case).agg(F.count("*").alias("n"), F.min("question_id").alias("question_id")).where("n = 1")
    return replies.where(~_blank("text")).join(open_, case).select(case, "question_id", F.trim("text").alias("answer"))


def next_message(questions: DataFrame, cases: DataFrame, case: str = "case_id") -> DataFrame:
    """case, message: its open questions(case, pos, question, answer), one a line."""
    open_ = questions.where(_blank("answer")).groupBy(F.col(case).alias("_c")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "question"))), lambda x: x["question"]), "\n").alias("m"))
    return cases.select(case).join(open_, F.col(case) == F.col("_c"), "left").select(case, F.coalesce("m", F.lit("No missing information questions are open.")).alias("message"))


def quality(cases: DataFrame, items: DataFrame, questions: DataFrame, issues: DataFrame, case: str = "case_id") -> DataFrame:
    """case, counts of blocking and warning issues, open questions and values without spans, and status."""
    n = lambda df, name: df.groupBy(F.col(case).alias(f"_{name}")).agg(F.count("*").alias(name))
    parts = [n(issues.where("severity = 'blocking'"), "n_blocking"), n(issues.where("severity = 'warning'"), "n_warning"), n(questions.where(_blank("answer")), "n_missing"), n(items.where(~_blank("before_value") & (F.coalesce(F.size("source_span_ids"), F.lit(0)) <= 0)), "n_ungrounded")]
    names = ["n_blocking", "n_warning", "n_missing", "n_ungrounded"]
    rows = reduce(lambda df, x: df.join(x[0], F.col(case) == F.col(f"_{x[1]}"), "left").drop(f"_{x[1]}"), zip(parts, names), cases.select(case))
    rows = rows.fillna(0, names)
    return rows.withColumn("status", F.when((F.col("n_blocking") > 0) | (F.col("n_ungrounded") > 0), "failed").when((F.col("n_warning") > 0) | (F.col("n_missing") > 0), "warning").otherwise("passed"))


def packet_texts(cases: DataFrame, items: DataFrame, impact_rows: DataFrame, questions: DataFrame, issues: DataFrame, case: str = "case_id") -> DataFrame:
    """case and the texts of its packet: underwriter_summary, carrier_email, missing_info_request, validation_report. cases(case, summary); items(.., pos, label, action, status), issues(.., pos, message)."""
    lines = lambda df, text, name: df.groupBy(F.col(case).alias(f"_{name}")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x["t"]), "\n").alias(name))
    or_ = lambda c, other: F.coalesce(c, F.lit(other))
    change = F.concat(F.lit("- "), F.upper("action"), F.lit(" "), "label", F.lit(": "), or_("before_value", "(not cited)"), F.lit(" -> "), or_("after_value", "(pending)"))
    likely = lambda c, no: F.when(F.col(c), "likely").otherwise(no)
    impact = F.concat(F.lit("- "), "item_id", F.lit(": endorsement="), likely("endorsement_required", "not expected"), F.lit(", carrierApproval="), likely("approval_required", "not expected"))
    placed = impact_rows.join(items.select(case, "item_id", "pos"), [case, "item_id"])
    parts = {"changes": lines(items, change, "changes"), "impacts": lines(placed, impact, "impacts"), "ready": lines(items.where("status = 'ready'"), F.concat(F.lit("- "), "label", F.lit(": "), F.coalesce("after_value", "action")), "ready"), "open": lines(questions.where(F.coalesce("answer", F.lit("")) == ""), F.concat(F.lit("- "), "question"), "open"), "found": lines(issues, F.concat(F.lit("- ["), "severity", F.lit("] "), "code", F.lit(": "), "message"), "found")}
    rows = cases.select(case, "summary")
    for name, df in parts.items():
        rows = rows.join(df, F.col(case) == F.col(f"_{name}"), "left").drop(f"_{name}")
    joined = lambda *x: F.array_join(F.filter(F.array(*x), lambda t: t.isNotNull()), "\n")
    return rows.select(case, joined("summary", F.lit(""), "changes", F.lit(""), F.lit("Impact analysis:"), "impacts").alias("underwriter_summary"), joined(F.lit("Please process the following policy change endorsement request:"), F.lit(""), "ready").alias("carrier_email"), or_("open", "No missing information questions are open.").alias("missing_info_request"), or_("found", "No validation issues.").alias("validation_report"))
