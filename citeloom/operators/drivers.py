"""Whole runs over tables of documents: what a model proposed is checked, merged and told of, document by document in one job.

A proposal that can't be used stops its own document and no other: the proposal goes to a table of its own with what is
wrong, the document's status is failed and its profile stays as it was. With phases the tables between steps are kept, and a run that stopped goes on
after the last whole one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.phases import Phases
from ..sources.scratch import cut
from . import profiles as P
from . import recovery as R
from . import sections as S

#: What a recovery proposes; anything else in it is left out.
_TERM = "struct<kind string, label string, value string, appliesTo string, sourceNodeIds array<string>, sourceSpanIds array<string>>"
PROPOSED = f"struct<name string, lineOfBusiness string, formNumber string, sectionRef string, endorsementNumber string, limit string, deductible string, limits array<{_TERM}>, sourceNodeIds array<string>, sourceSpanIds array<string>>"


def _kept(phases: Phases | None, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    return cut(make()) if phases is None else phases.run(name, make)


def _list_of(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, f"array<{kind}>")


def _name(v: Column) -> Column:
    """A coverage's name if it is a text that says something."""
    name = F.try_variant_get(v, "$.name", "variant")
    return F.when(F.schema_of_variant(name) == "STRING", F.nullif(F.trim(F.try_variant_get(v, "$.name", "string")), F.lit("")))


def checked(candidates: DataFrame) -> DataFrame:
    """candidates(document_id, seq, json) with v, the parsed value, and error: what makes it useless, or null."""
    v = F.try_parse_json("json")
    fields = F.try_variant_get("v", "$", "map<string,variant>")
    each = _list_of(F.col("v"), "$.coverages", "variant")
    error = F.when(F.col("v").isNull(), "candidate is not JSON").when(fields.isNull(), "candidate is not an object").when(each.isNull(), "candidate has no list of coverages").when(F.exists(each, lambda c: _name(c).isNull()), "a coverage has no name")
    return candidates.withColumn("v", v).withColumn("error", error)


@dataclass
class Recovery:
    """coverages: as recovery.merge_recovered() gives them; diagnostics(document_id, status, n_coverages, n_terms, n_rejected, warnings); quarantine(document_id, seq, error, json)."""

    coverages: DataFrame
    diagnostics: DataFrame
    quarantine: DataFrame


def recover(documents: DataFrame, coverages: DataFrame, candidates: DataFrame, nodes: DataFrame, spans: DataFrame, phases: Phases | None = None) -> Recovery:
    """Coverages that models found again, region by region, merged into those of documents(document_id).

    coverages: recovery.FACT, none of them recovered. candidates(document_id, seq, json): JSON objects with coverages
    (PROPOSED) and warnings, in the order of seq. nodes, spans(document_id, id, and of spans text and pages): what may be
    cited. A coverage or term whose citations are unknown, or whose numbers its cited spans don't hold, is rejected and
    counted; a rejected coverage takes its terms with it. A document with a useless candidate keeps its coverages, counts nothing and has failed.
    """
    told = _kept(phases, "recovery-checked", lambda: checked(candidates).select("document_id", "seq", "error", "json"))
    quarantine = told.where("error IS NOT NULL").select("document_id", "seq", "error", "json")
    failed = quarantine.groupBy("document_id").agg(F.min_by("error", "seq").alias("error"))
    sound = told.join(failed.select(F.col("document_id").alias("_f")), F.col("document_id") == F.col("_f"), "left_anti").withColumn("v", F.try_parse_json("json"))

    def found() -> DataFrame:
        c = F.posexplode(F.from_json(F.to_json(F.try_variant_get("v", "$.coverages", "variant")), f"array<{PROPOSED}>")).alias("i", "c")
        rows = sound.select("document_id", "seq", c).withColumn("fact", F.concat_ws("/", "document_id", "seq", "i"))
        terms = rows.select("document_id", "fact", F.posexplode("c.limits").alias("j", "t"))
        none = F.array().cast("array<string>")
        ids = lambda x: (F.coalesce(F.col(f"{x}.sourceNodeIds"), none).alias("node_ids"), F.coalesce(F.col(f"{x}.sourceSpanIds"), none).alias("span_ids"))
        own = rows.select(F.col("fact").alias("fact_id"), F.col("fact").alias("owner"), "document_id", F.array_compact(F.array("c.limit", "c.deductible")).alias("values"), *ids("c"))
        per = terms.select(F.concat_ws("/", "fact", "j").alias("fact_id"), F.col("fact").alias("owner"), "document_id", F.array_compact(F.array("t.value")).alias("values"), *ids("t"))
        valid = cut(R.validate_candidates(own.unionByName(per), nodes, spans).select("fact_id", "owner", "document_id", "valid", F.col("known_spans").alias("span_ids")))
        good = valid.where("valid").select(F.col("fact_id").alias("_v"))
        held = terms.join(good, F.concat_ws("/", "fact", "j") == F.col("_v")).groupBy(F.col("fact").alias("_t")).agg(F.array_sort(F.collect_list(F.struct("j", F.struct(F.col("t.kind"), F.col("t.label"), F.col("t.value"), F.col("t.appliesTo").alias("applies")).alias("t")))).alias("l"))
        pages = R.span_pages(valid.where("valid").select("fact_id", "span_ids"), spans)
        rows = rows.join(valid.select(F.col("fact_id").alias("_o"), "valid"), F.col("fact") == F.col("_o")).join(held, F.col("fact") == F.col("_t"), "left").join(pages.select(F.col("fact_id").alias("_p"), "first", "last"), F.col("fact") == F.col("_p"), "left")
        bad = valid.where("NOT valid").groupBy(F.col("owner").alias("_b")).agg(F.count("*").alias("n_bad"))
        return rows.join(bad, F.col("fact") == F.col("_b"), "left").select("document_id", "seq", "i", F.col("c.name").alias("name"), F.col("c.lineOfBusiness").alias("line"), F.col("c.formNumber").alias("form"), F.col("c.sectionRef").alias("section"), F.col("c.endorsementNumber").alias("endorsement"), "first", "last", F.col("c.limit").alias("limit"), F.col("c.deductible").alias("deductible"), F.transform("l", lambda x: x["t"]).alias("terms"), "valid", F.coalesce("n_bad", F.lit(0)).alias("n_bad"))

    facts = _kept(phases, "recovery-facts", found)
    place = F.row_number().over(_by_document("seq", "i")).cast("int")
    new = facts.where("valid").withColumns({"seq": place, "recovered": F.lit(True)})
    names = [c.split(" ")[0] for c in ("document_id", "seq", "recovered", "name", "line", "form", "section", "endorsement", "first", "last", "limit", "deductible", "terms")]
    merged = _kept(phases, "recovery-merged", lambda: R.merge_recovered(coverages.withColumn("recovered", F.lit(False)).select(*names).unionByName(new.select(*names))))
    before = coverages.groupBy(F.col("document_id").alias("_c")).agg(F.count("*").alias("n_before"))
    after = merged.groupBy(F.col("document_id").alias("_m")).agg(F.count("*").alias("n_after"), F.sum("n_found").alias("n_terms"), F.array_sort(F.collect_list(F.when(F.col("conflicts") > 0, F.struct("seq", F.concat(F.lit("Coverage recovery preserved conflicting cited terms for "), "name", F.lit(".")).alias("w"))))).alias("conflicts"))
    bad = facts.groupBy(F.col("document_id").alias("_b")).agg(F.sum("n_bad").alias("n_rejected"))
    said = sound.select("document_id", "seq", F.coalesce(_list_of(F.col("v"), "$.warnings", "string"), F.array().cast("array<string>")).alias("w")).groupBy(F.col("document_id").alias("_w")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "w"))), lambda x: x["w"])).alias("said"))
    rows = documents.select("document_id").distinct()
    for table, key in ((failed.withColumnRenamed("document_id", "_f"), "_f"), (before, "_c"), (after, "_m"), (bad, "_b"), (said, "_w")):
        rows = rows.join(table, F.col("document_id") == F.col(key), "left").drop(key)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    warnings = F.concat(F.coalesce("said", none), F.coalesce(F.transform("conflicts", lambda x: x["w"]), none), F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("Coverage recovery failed: "), "error"))).otherwise(none))
    diagnostics = rows.select("document_id", F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("status"), (zero(F.col("n_after")) - zero(F.col("n_before"))).alias("n_coverages"), zero(F.col("n_terms")).alias("n_terms"), zero(F.col("n_rejected")).alias("n_rejected"), F.array_distinct(warnings).alias("warnings"))
    return Recovery(merged, diagnostics, quarantine)


def _by_document(*order: str):
    return Window.partitionBy("document_id").orderBy(*order)


def empty_profile() -> Column:
    """A profile that says nothing."""
    made = {"documentType": F.lit("policy"), "linesOfBusiness": F.array(F.lit("UN"))}
    lists = ("declarationFacts", "coverages", "parties", "endorsementSupport", "sourceNodeIds", "sourceSpanIds", "warnings")
    made |= {c: F.array() for c in lists}
    return F.struct(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in P.null_fields()))


@dataclass
class Extraction:
    """documents(document_id, status, profile, warnings): extracted, or failed with an empty profile; sections: results with hash and reused, to be stored for the next run; manifests: sections.manifests().
    Hashes are taken, and written once, when sections or manifests are first asked for."""

    documents: DataFrame
    results: DataFrame
    eligible: DataFrame
    phases: Phases | None = None

    @cached_property
    def sections(self) -> DataFrame:
        return _kept(self.phases, "extraction-hashed", lambda: S.with_hashes(self.results))

    @cached_property
    def manifests(self) -> DataFrame:
        return S.manifests(self.sections, self.eligible)


def extract(asked: DataFrame, outputs: DataFrame, stored: DataFrame, nodes: DataFrame, spans: DataFrame, tables: tuple[DataFrame, DataFrame, DataFrame, DataFrame], eligible: DataFrame, nothing: DataFrame | None = None, phases: Phases | None = None) -> Extraction:
    """Profiles of documents from the outputs of models for their sections.

    asked: sections.asked_sections(); outputs(document_id, section, json); stored: section results of earlier runs, taken
    where nothing changed; nodes, spans: what may be cited; tables: of codes, as profiles.merge_profiles() takes them;
    eligible(document_id, fingerprint, extractor, eligible, ledger_hash); nothing: sections without anything to extract.

    The core is merged into an empty profile, then the coverage section into that. A document whose core or coverage
    section is degraded has failed, and its profile is empty. The cleanup section is degraded where coverage is, not
    applicable without coverages, and else what its output is; a bad one costs a warning, and the uncleaned profile is used.
    """
    results = _kept(phases, "extraction-sections", lambda: S.told(asked, stored, S.from_outputs(outputs.where(F.col("section") != S.CLEANUP)), nothing))
    failed = results.where("status = 'degraded'").groupBy("document_id").agg(F.min_by("error", "section").alias("error"))
    documents = eligible.select("document_id").distinct().join(failed.select(F.col("document_id").alias("_f"), F.lit(True).alias("bad")), F.col("document_id") == F.col("_f"), "left").select("document_id", F.coalesce("bad", F.lit(False)).alias("bad"))

    def candidates(section: str) -> DataFrame:
        rows = results.where((F.col("section") == section) & F.col("profile").isNotNull()).join(failed.select(F.col("document_id").alias("_f")), F.col("document_id") == F.col("_f"), "left_anti")
        return rows.select("document_id", F.from_json("profile", P.PROFILE).alias("profile"))

    def merged() -> DataFrame:
        first = P.merge_profiles(documents.select("document_id", empty_profile().alias("profile")), candidates(S.CORE), nodes, spans, *tables)
        return P.merge_profiles(first.select("document_id", "profile"), candidates(S.COVERAGE), nodes, spans, *tables).select("document_id", "profile")

    profiles = _kept(phases, "extraction-profiles", merged)
    cleanup = asked.where(F.col("section") == S.COVERAGE).select("document_id", F.lit(S.CLEANUP).alias("section"), "fingerprint", "extractor", "ids")
    facts = profiles.select(F.col("document_id").alias("_p"), (F.size("profile.coverages") == 0).alias("bare")).join(failed.select(F.col("document_id").alias("_f")), F.col("_p") == F.col("_f"), "left")
    state = cleanup.join(facts, F.col("document_id") == F.col("_p"), "left")
    skipped = state.where("_f IS NOT NULL").select("document_id", "section", "fingerprint", "extractor", "ids", F.lit("degraded").alias("status"), F.lit(None).cast("string").alias("profile"), F.array().cast("array<string>").alias("warnings"), F.lit("Coverage cleanup was skipped because the coverage section is degraded").alias("error"))
    names = ["document_id", "section", "fingerprint", "extractor", "ids"]
    bare = state.where("_f IS NULL AND bare").select("document_id", "section")
    live = state.where("_f IS NULL").select(*names)
    last = _kept(phases, "extraction-cleanup", lambda: S.told(live, stored, S.from_outputs(outputs.where(F.col("section") == S.CLEANUP)), bare).unionByName(S.unhashed(skipped)))
    warned = last.where("status = 'degraded'").join(failed.select(F.col("document_id").alias("_f")), F.col("document_id") == F.col("_f"), "left_anti").select(F.col("document_id").alias("_w"), F.concat(F.lit("Operational profile cleanup pass failed; uncleaned profile used ("), "error", F.lit(")")).alias("w"))
    rows = documents.join(profiles.withColumnRenamed("document_id", "_p"), F.col("document_id") == F.col("_p")).join(warned, F.col("document_id") == F.col("_w"), "left").join(failed.select(F.col("document_id").alias("_e"), "error"), F.col("document_id") == F.col("_e"), "left")
    told = F.array_compact(F.array("w", "error"))
    out = rows.select("document_id", F.when(F.col("bad"), "failed").otherwise("extracted").alias("status"), "profile", F.concat(told, F.col("profile.warnings")).alias("warnings"))
    return Extraction(out, results.unionByName(last), eligible, phases)
