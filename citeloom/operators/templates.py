"""What a document of a type is made of: its template, and which of its sections are missing.

Templates are a table that the caller gives: type, expected, required, optional (arrays of section names) and hints (a map of section to where it
is found). Only the template of documents without one of their own is fixed here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types of policy whose template goes by another name, and the template of all others.
NAMED = {
    "homeowners_ho3": "homeowners", "homeowners_ho5": "homeowners", "renters_ho4": "homeowners", "condo_ho6": "homeowners", "mobile_home": "homeowners",
    "flood_nfip": "flood", "flood_private": "flood", "umbrella": "umbrella_excess", "excess_liability": "umbrella_excess",
}
SAME = ("personal_auto", "dwelling_fire", "earthquake", "personal_umbrella", "personal_inland_marine", "watercraft", "recreational_vehicle", "farm_ranch", "general_liability", "commercial_property", "commercial_auto", "workers_comp", "professional_liability", "cyber", "directors_officers", "crime_fidelity")
DEFAULT = {
    "type": "unknown",
    "expected": ("carrier_info", "named_insured", "coverage_limits", "endorsements", "exclusions", "conditions", "premium_breakdown", "sections"),
    "required": ("carrier_info", "named_insured", "coverage_limits"),
    "optional": ("declarations", "loss_history", "supplementary", "endorsements", "exclusions", "conditions"),
    "hints": {"declarations": "first 5 pages", "endorsements": "last 25%"},
}


def template_name(policy_type: Column) -> Column:
    """The name of a policy type's template; null for a type that has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in (NAMED | {t: t for t in SAME}).items() for x in (k, v))), policy_type)


def with_template(documents: DataFrame, templates: DataFrame) -> DataFrame:
    """documents(document_id, policy_type, ..) with template, expected, required, optional and hints. A type that is null or unknown, or whose template isn't in the table, takes the default. Of templates that share a type one is taken."""
    known = templates.groupBy(F.col("type").alias("_t")).agg(F.min_by(F.struct("expected", "required", "optional", "hints"), F.to_json(F.struct("expected", "required", "optional"))).alias("_x"))
    rows = documents.withColumn("_n", F.when(F.col("policy_type").isNotNull(), template_name(F.col("policy_type")))).join(known, F.col("_n") == F.col("_t"), "left")
    texts = lambda c: F.coalesce(f"_x.{c}", F.when(F.col("_t").isNull(), F.array(*map(F.lit, DEFAULT[c]))), F.array().cast("array<string>"))
    hints = F.coalesce("_x.hints", F.when(F.col("_t").isNull(), F.create_map(*(F.lit(x) for kv in DEFAULT["hints"].items() for x in kv))), F.create_map().cast("map<string,string>"))
    made = {c: texts(c) for c in ("expected", "required", "optional")} | {"hints": hints, "template": F.coalesce("_t", F.lit(DEFAULT["type"]))}
    return rows.withColumns(made).drop("_n", "_t", "_x")


def section_gaps(documents: DataFrame, sections: DataFrame, templates: DataFrame) -> DataFrame:
    """document_id, template, section, standing (required or expected), hint: a row for each section that a template wants of a document and
    sections(document_id, section) doesn't hold. A section that is both is required; of the required ones those not expected come too."""
    rows = with_template(documents.select("document_id", "policy_type"), templates)
    wanted = rows.select("document_id", "template", "required", "hints", F.explode(F.array_union("required", "expected")).alias("section"))
    held = sections.select(F.col("document_id").alias("_d"), F.col("section").alias("_s")).distinct()
    gaps = wanted.join(held, (F.col("document_id") == F.col("_d")) & (F.col("section") == F.col("_s")), "left_anti")
    return gaps.select("document_id", "template", "section", F.when(F.array_contains("required", F.col("section")), "required").otherwise("expected").alias("standing"), F.try_element_at("hints", F.col("section")).alias("hint"))
