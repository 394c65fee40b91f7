"""Results of an extraction's sections: their hashes, which stored ones may be taken again, and the manifest of a whole extraction.

A section is made anew only if the document's fingerprint, the extractor's version or the section's spans changed since
its result was stored, or if the stored result is degraded or isn't what its hash says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..sources.scratch import cut, spread

#: Versions of results and manifests, and the sections in order.
RESULT_VERSION, MANIFEST_VERSION = "extraction-section-result-v1", "extraction-completion-manifest-v1"
CORE, COVERAGE, CLEANUP = "extraction_policy_core", "extraction_policy_coverage", "extraction_coverage_cleanup"
SECTIONS = (CORE, COVERAGE, CLEANUP)
#: A section's result; profile is JSON, and absent where it is null, as error is.
RESULT = "document_id string, section string, status string, fingerprint string, extractor string, ids array<string>, profile string, warnings array<string>, error string"
KEY = ["document_id", "section", "fingerprint", "extractor"]
NO_COVERAGE = '{"coverages":[]}'


def _said() -> Column:
    """A result's parts by their names, the profile whatever its shape."""
    parts = {"version": F.lit(RESULT_VERSION), "sectionId": F.col("section"), "status": F.col("status"), "sourceFingerprint": F.col("fingerprint"), "extractorVersion": F.col("extractor"), "sourceSpanIds": F.col("ids"), "operationalProfile": F.try_parse_json("profile"), "warnings": F.col("warnings"), "error": F.col("error")}
    return F.to_json(F.struct(*(c.alias(n) for n, c in parts.items())))


def hashed(results: DataFrame) -> DataFrame:
    """results (RESULT) with version and hash, as they are stored. They are dealt over all cores first."""
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    return C.with_value_hash(spread(results.select(*names), *KEY[:2]).withColumn("version", F.lit(RESULT_VERSION)), _said(), "hash")


def usable(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """Stored results that may be taken for asked(document_id, section, fingerprint, extractor, ids): all of these equal, of this version, not degraded, and the hash right. Of several for one section that of the smallest hash."""
    rows = stored.where((F.col("version") == RESULT_VERSION) & (F.col("status") != "degraded")).join(asked.select(*KEY, F.col("ids").alias("_ids")), KEY)
    rows = rows.where(F.col("ids") == F.col("_ids")).drop("_ids")
    sound = C.with_value_hash(spread(rows.select(*stored.columns), *KEY[:2]), _said(), "_hash").where("hash = _hash").drop("_hash")
    whole = F.struct(*stored.columns)
    return sound.groupBy(*KEY).agg(F.min_by(whole, "hash").alias("r")).select("r.*")


def resumed(asked: DataFrame, stored: DataFrame, make: Callable[[DataFrame], DataFrame], nothing: DataFrame | None = None) -> DataFrame:
    """A result, with its hash, for every asked section, and whether it was reused."""
    return with_hashes(told(asked, stored, make, nothing))


def with_hashes(results: DataFrame) -> DataFrame:
    """The results of told() with the hashes of those that weren't reused."""
    new = hashed(results.where("NOT reused")).withColumn("reused", F.lit(False))
    return results.where("reused").unionByName(new)


def told(asked: DataFrame, stored: DataFrame, make: Callable[[DataFrame], DataFrame], nothing: DataFrame | None = None) -> DataFrame:
    """resumed() where only reused results have their version and hash yet, for those who need none.

    make(asked rows) gives results (RESULT) for those that have no usable one; it is given no others. nothing(document_id,
    section): sections without anything to extract; they are not_applicable, with no coverages, and aren't made.
    """
    asked = cut(asked.select(*KEY, "ids"))
    taken = cut(usable(stored, asked))
    open_ = asked.join(taken.select(*KEY), KEY, "left_anti")
    out = taken.withColumn("reused", F.lit(True))
    if nothing is not None:
        place = ["document_id", "section"]
        none = open_.join(nothing.select(*place).distinct(), place, "left_semi")
        none = none.withColumns({"status": F.lit("not_applicable"), "profile": F.lit(NO_COVERAGE), "warnings": F.array().cast("array<string>"), "error": F.lit(None).cast("string")})
        out = out.unionByName(unhashed(none))
        open_ = open_.join(nothing.select(*place).distinct(), place, "left_anti")
    return out.unionByName(unhashed(make(cut(open_))))


def unhashed(results: DataFrame) -> DataFrame:
    """New results (RESULT) in the shape of told()."""
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    return results.select(*names).withColumns({"version": F.lit(None).cast("string"), "hash": F.lit(None).cast("string"), "reused": F.lit(False)})


def from_outputs(outputs: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A make() of model outputs(document_id, section, json): complete where the output is a JSON object, degraded, with what is wrong, where it is missing or isn't one. The core's coverages are left out; of the coverage section what bears on coverages stays."""

    def make(asked: DataFrame) -> DataFrame:
        place = ["document_id", "section"]
        first = outputs.groupBy(*place).agg(F.min("json").alias("json"), F.count("*").alias("n"))
        v = F.try_parse_json("json")
        rows = spread(asked, *place).join(first, place, "left").withColumn("fields", F.try_variant_get(v, "$", "map<string,variant>"))
        keep = ("documentType", "linesOfBusiness", "coverages", "sourceNodeIds", "sourceSpanIds", "warnings")
        other = F.map_filter("fields", lambda k, _: k != "coverages")
        own = F.map_filter("fields", lambda k, _: k.isin(*keep))
        bare = F.to_json(F.when(F.col("section") == COVERAGE, own).otherwise(other))
        coverages = F.coalesce(F.to_json(F.try_element_at("fields", F.lit("coverages"))), F.lit("[]"))
        join = lambda body, tail: F.concat(F.left(body, F.length(body) - 1), F.when(F.length(body) > 2, ",").otherwise(""), tail, F.lit("}"))
        whole = F.when(F.col("section") == COVERAGE, F.when(F.map_contains_key("fields", "coverages"), bare).otherwise(join(bare, F.lit('"coverages":[]')))).otherwise(join(bare, F.lit('"coverages":[]')))
        wrong = F.when(F.col("n").isNull(), "no output").when(F.col("n") > 1, "more than one output").when(v.isNull(), "output is not JSON").when(F.col("fields").isNull(), "output is not an object").when(F.schema_of_variant(F.coalesce(F.try_element_at("fields", F.lit("coverages")), F.parse_json(F.lit("[]")))).startswith("ARRAY") == F.lit(False), "coverages are not a list")
        rows = rows.withColumn("error", wrong)
        ok = F.col("error").isNull()
        return rows.select(*KEY, "ids", F.when(ok, "complete").otherwise("degraded").alias("status"), F.when(ok, whole).alias("profile"), F.array().cast("array<string>").alias("warnings"), "error")

    return make


def manifests(results: DataFrame, documents: DataFrame, protocol: str = "source-tree-v2") -> DataFrame:
    """document_id, complete, processed and hash of documents(document_id, fingerprint, extractor, eligible, ledger_hash): which spans its sections (results with hash) went through, and whether these are all eligible ones and none is degraded."""
    place = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    entry = F.struct(F.col("section").alias("sectionId"), "status", F.col("ids").alias("sourceSpanIds"), F.col("hash").alias("resultHash"))
    per = results.groupBy(F.col("document_id").alias("_d")).agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), entry.alias("e")))).alias("l"))  # a few sections
    rows = documents.join(per, F.col("document_id") == F.col("_d"), "left").withColumn("sections", F.transform("l", lambda x: x["e"]))
    done = F.filter("sections", lambda s: s["status"] != "degraded")
    rows = rows.withColumn("processed", F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform(done, lambda s: s["sourceSpanIds"])))), F.array().cast("array<string>")))
    whole = F.coalesce(F.size(done) == F.size("sections"), F.lit(False)) & (F.size(F.array_except("eligible", "processed")) == 0)
    rows = rows.withColumn("complete", whole)
    parts = {"version": F.lit(MANIFEST_VERSION), "protocolVersion": F.lit(protocol), "extractorVersion": F.col("extractor"), "sourceFingerprint": F.col("fingerprint"), "eligibleSourceSpanIds": F.col("eligible"), "sections": F.coalesce("sections", F.array().cast("array<struct<sectionId string, status string, sourceSpanIds array<string>, resultHash string>>")), "processedSourceSpanIds": F.col("processed"), "completeSourceCoverage": F.col("complete"), "evidenceLedgerHash": F.col("ledger_hash")}
    told = F.to_json(F.struct(*(c.alias(n) for n, c in parts.items())))
    return C.with_value_hash(spread(rows.select("document_id", "complete", "processed", told.alias("_told")), "document_id"), F.col("_told"), "hash").drop("_told")


def asked_sections(assigned: DataFrame, fingerprints: DataFrame, extractor: str) -> DataFrame:
    """The sections of each document by coverage_map() and fingerprints(): the core goes through all spans that aren't of coverage alone, the coverage section and its cleanup through those of coverage or both."""
    ids = lambda keep: F.transform(F.filter("l", keep), lambda x: x["source_span_id"])
    rows = assigned.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("place", "source_span_id", "assignment"))).alias("l"))
    core, coverage = ids(lambda x: x["assignment"] != "coverage"), ids(lambda x: x["assignment"].isin("coverage", "both"))
    each = F.array(F.struct(F.lit(CORE).alias("section"), core.alias("ids")), F.struct(F.lit(COVERAGE).alias("section"), coverage.alias("ids")))
    return rows.join(fingerprints, "document_id").select("document_id", "fingerprint", F.lit(extractor).alias("extractor"), F.explode(each).alias("s")).select(*KEY[:1], "s.section", "fingerprint", "extractor", "s.ids")
