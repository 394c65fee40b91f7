"""Documents made of profiles: the operational profile's facts in the shape that chunks.document_chunks() reads.

The source tree's outline stays a table of its own (projections.outline()).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .chunks import _fields, _records, _text

#: Fields that prefer their normalised value, and what stands for none.
NORMALIZED = ("policyNumber", "namedInsured", "insurer", "broker", "effectiveDate", "expirationDate", "retroactiveDate")
UNKNOWN = "Unknown"
NONE = "array<string>"


def _get(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def _said(m: Column, key: str) -> Column:
    return _text(_get(m, key))


def _ids(m: Column, key: str) -> Column:
    return F.coalesce(F.try_variant_get(_get(m, key), "$", NONE), F.array().cast(NONE))


def _value(m: Column, key: str) -> Column:
    """A field's value, or its normalised one where that is preferred and not blank."""
    own = T.let(_fields(_get(m, key)), lambda v: F.when(F.trim(_said(v, "normalizedValue")) != "", _said(v, "normalizedValue")).otherwise(_said(v, "value")))
    return own if key in NORMALIZED else T.let(_fields(_get(m, key)), lambda v: _said(v, "value"))


def first_party(parties: Column, *roles: str) -> Column:
    """Of the parties with a name in these roles, in their order: the first with an address, else the first."""
    held = F.concat(*(_in_role(parties, r) for r in roles))
    return T.let(held, lambda c: F.coalesce(F.try_element_at(F.filter(c, lambda p: _get(p, "address").isNotNull()), F.lit(1)), F.try_element_at(c, F.lit(1))))


def _in_role(parties: Column, role: str) -> Column:
    return F.filter(parties, lambda p: (_said(p, "role") == role) & (F.trim(_said(p, "name")) != ""))


def address(v: Column) -> Column:
    """An address that has a street, a town, a state and a code; null otherwise."""
    def whole(a: Column) -> Column:
        known = [_said(a, k) for k in ("street1", "city", "state", "zip")]
        there = known[0] != ""
        for k in known[1:]:
            there = there & (k != "")
        return F.when(there, F.struct(*(_said(a, k).alias(k) for k in ("street1", "street2", "city", "state", "zip", "country"))))

    return T.let(_fields(v), whole)


def _source(row: Column) -> list[Column]:
    return [F.try_element_at(_ids(row, "sourceNodeIds"), F.lit(1)).alias("documentNodeId"), _ids(row, "sourceSpanIds").alias("sourceSpanIds")]


def _backed(*rows: Column) -> Column:
    """The spans of these fields together; null if there are none."""
    spans = F.array_distinct(F.concat(*(F.coalesce(_ids(r, "sourceSpanIds"), F.array().cast(NONE)) for r in rows)))
    return F.when(F.size(spans) > 0, spans)


def positive(text: Column) -> Column:
    n = F.regexp_extract(text, r"\d+", 0).try_cast("long")
    return F.when(n > 0, n)


def _items(m: Column, *kinds: str) -> Column:
    held = F.filter(_records(_get(m, "coverageSchedules")), lambda s: _said(s, "kind").isin(*kinds))
    return F.flatten(F.transform(held, lambda s: _records(_get(s, "items"))))


def _labelled(item: Column) -> Column:
    return F.transform(_records(_get(item, "values")), lambda v: F.struct(_said(v, "label").alias("label"), _said(v, "value").alias("value")))


def vehicles(m: Column) -> Column:
    """Vehicles of schedules that tell year, make, model and number."""
    def made(item: Column, i: Column) -> Column:
        at = lambda *names: T.let(_labelled(item), lambda v: T.schedule_value(v, names))
        return F.struct(F.coalesce(positive(_said(item, "label")), (i + 1).cast("long")).alias("number"), positive(at("year", "model year")).alias("year"), at("make").alias("make"), at("model").alias("model"), at("vin", "vehicle identification number").alias("vin"))

    return F.filter(F.transform(_items(m, "vehicle"), made), lambda v: v["year"].isNotNull() & v["make"].isNotNull() & v["model"].isNotNull() & v["vin"].isNotNull())


def locations(m: Column) -> Column:
    """Locations of schedules that tell a whole address."""
    def made(item: Column, i: Column) -> Column:
        at = lambda *names: T.let(_labelled(item), lambda v: T.schedule_value(v, names))
        place = F.struct(at("street 1", "street address", "address").alias("street1"), at("city").alias("city"), at("state", "province").alias("state"), at("zip", "postal code").alias("zip"), at("country").alias("country"))
        return F.struct(F.coalesce(positive(_said(item, "label")), (i + 1).cast("long")).alias("number"), place.alias("address"), _said(item, "description").alias("description"), at("building value", "building").alias("buildingValue"), at("contents value", "contents").alias("contentsValue"))

    whole = lambda a: a["street1"].isNotNull() & a["city"].isNotNull() & a["state"].isNotNull() & a["zip"].isNotNull()
    return F.filter(F.transform(_items(m, "location", "property"), made), lambda v: whole(v["address"]))


def _coverage(c: Column) -> Column:
    terms = F.transform(_records(_get(c, "limits")), lambda t: F.concat(_said(t, "label"), F.lit(": "), _said(t, "value")))
    own = F.array(*(_said(c, k) for k in ("limit", "deductible", "premium")))
    told = F.array_join(F.filter(F.concat(F.array(_said(c, "name")), F.when(F.size(terms) > 0, terms).otherwise(own)), lambda t: t != ""), " | ")
    plain = [_said(c, k).alias(k) for k in ("name", "lineOfBusiness", "coverageCode", "limit", "deductible", "premium", "retroactiveDate", "formNumber", "sectionRef", "endorsementNumber")]
    return F.struct(*plain, *_source(c), told.alias("originalContent"))


def _declared(m: Column, facts: Column) -> Column:
    """Fields of the declarations: the profile's, then its facts in order."""
    names = {"policyNumber": "policyNumber", "namedInsured": "namedInsured", "insurer": "insurer", "effectiveDate": "policyPeriodStart", "expirationDate": "policyPeriodEnd"}
    one = lambda key, name: T.let(_fields(_get(m, key)), lambda v: F.when(v.isNotNull(), F.struct(F.lit(name).alias("field"), _said(v, "value").alias("value"), _ids(v, "sourceSpanIds").alias("sourceSpanIds"))))
    own = F.filter(F.array(*(one(k, n) for k, n in names.items())), lambda f: f.isNotNull())
    fact = lambda f: F.struct(F.when(_said(f, "field") == "taxId", "fein").otherwise(_said(f, "field")).alias("field"), _said(f, "value").alias("value"), _ids(f, "sourceSpanIds").alias("sourceSpanIds"))
    return F.concat(own, F.transform(facts, fact))


def _some(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def documents_of_profiles(profiles: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """profiles(document_id, json), forms(document_id, pos, form_number, edition_date, title, form_type, page_start, page_end) -> document_id, json of the document. A profile that is no JSON object gives none."""
    m = F.col("m")
    rows = profiles.select("document_id", F.try_variant_get(F.try_parse_json("json"), "$", "map<string,variant>").alias("m")).where("m IS NOT NULL")
    rows = rows.withColumns({"parties": _records(_get(m, "parties")), "facts": F.filter(_records(_get(m, "declarationFacts")), lambda f: F.trim(_said(f, "value")) != "")})
    p, facts = F.col("parties"), F.col("facts")
    rows = rows.withColumns({"insured": first_party(p, "named_insured"), "carrying": first_party(p, "insurer", "carrier"), "producing": first_party(p, "producer", "broker"), "lines": F.coalesce(F.try_variant_get(_get(m, "linesOfBusiness"), "$", NONE), F.array().cast(NONE))})
    fact = lambda field: F.try_element_at(F.filter(facts, lambda f: _said(f, "field") == field), F.lit(1))
    or_unknown = lambda *c: F.coalesce(*c, F.lit(UNKNOWN))
    rows = rows.withColumns({
        "number": or_unknown(_value(m, "policyNumber")),
        "name": or_unknown(_value(m, "namedInsured"), _said(F.col("insured"), "name")),
        "carrier": or_unknown(_value(m, "insurer"), _said(F.col("carrying"), "name")),
        "since": or_unknown(_value(m, "effectiveDate")),
        "until": or_unknown(_value(m, "expirationDate")),
        "broker": F.coalesce(_value(m, "broker"), _said(F.col("producing"), "name")),
        "cost": _value(m, "totalCost"),
        "mail": fact("mailingAddress"),
    })
    if forms is None:
        rows = rows.withColumn("forms", F.lit(None).cast("array<struct<formNumber:string>>"))
    else:
        form = F.struct("pos", *(F.col(a).alias(b) for a, b in (("form_number", "formNumber"), ("edition_date", "editionDate"), ("title", "title"), ("form_type", "formType"), ("page_start", "pageStart"), ("page_end", "pageEnd"))))
        held = forms.where("trim(form_number) <> ''").groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(form)), lambda f: f.dropFields("pos")).alias("forms"))
        rows = rows.join(held, "document_id", "left")
    quote, carrier, known = _said(m, "documentType") == "quote", F.col("carrier"), lambda c: F.when(F.col(c) != UNKNOWN, F.col(c))
    backed = lambda row: F.when(F.size(_ids(row, "sourceSpanIds")) > 0, address(_get(row, "address")))
    insurer_spans, broker_spans = _backed(_fields(_get(m, "insurer")), F.col("carrying")), _backed(_fields(_get(m, "broker")), F.col("producing"))
    brokered = F.col("broker").isNotNull() & (F.col("broker") != "") & broker_spans.isNotNull()
    amount = lambda r: [_said(r, "amount").alias("amount"), F.try_variant_get(_get(r, "amountValue"), "$", "double").alias("amountValue"), *_source(r)]
    covering = F.when(F.size("lines") > 0, F.concat(F.lit("covering "), F.array_join(F.slice("lines", 1, 5), ", ")))
    summary = F.concat_ws(" ", known("carrier"), F.concat(F.lit("#"), known("number")), F.concat(F.lit("for "), known("name")), covering)
    more = F.filter(facts, lambda f: (_said(f, "field") == "additionalNamedInsured") & (F.size(_ids(f, "sourceSpanIds")) > 0))
    made = {
        "id": F.col("document_id").cast("string"),
        "type": F.when(quote, "quote").otherwise("policy"),
        "carrier": carrier,
        "security": carrier,
        "insuredName": F.col("name"),
        "premium": _value(m, "premium"),
        "premiumBreakdown": _some(F.transform(_records(_get(m, "premiumBreakdown")), lambda r: F.struct(_said(r, "line").alias("line"), *amount(r)))),
        "taxesAndFees": _some(F.transform(_records(_get(m, "taxesAndFees")), lambda r: F.struct(_said(r, "name").alias("name"), _said(r, "type").alias("type"), _said(r, "description").alias("description"), *amount(r)))),
        "totalCost": F.nullif("cost", F.lit("")),
        "totalCostAmount": F.when(F.col("cost") != "", F.regexp_replace("cost", "[^0-9.-]", "").try_cast("double")),
        "insuredDba": _said(fact("dba"), "value"),
        "insuredAddress": F.coalesce(backed(F.col("insured")), backed(F.col("mail"))),
        "insuredEntityType": T.entity_type(_said(fact("entityType"), "value")),
        "insuredFein": _said(fact("taxId"), "value"),
        "additionalNamedInsureds": _some(F.transform(more, lambda f: F.struct(_said(f, "value").alias("name"), *_source(f)))),
        "insurer": F.when(insurer_spans.isNotNull(), F.struct(carrier.alias("legalName"), address(_get(F.col("carrying"), "address")).alias("address"), insurer_spans.alias("sourceSpanIds"))),
        "brokerAgency": F.when(brokered, F.col("broker")),
        "producer": F.when(brokered, F.struct(F.col("broker").alias("agencyName"), address(_get(F.col("producing"), "address")).alias("address"), broker_spans.alias("sourceSpanIds"))),
        "linesOfBusiness": F.col("lines"),
        "programName": T.let(_fields(_get(_fields(_get(m, "productIdentity")), "name")), lambda v: _said(v, "value")),
        "formInventory": F.col("forms"),
        "coverages": F.transform(_records(_get(m, "coverages")), _coverage),
        "coverageSchedules": _get(m, "coverageSchedules"),
        "vehicles": _some(vehicles(m)),
        "locations": _some(locations(m)),
        "declarations": F.struct(_declared(m, facts).alias("fields")),
        "supplementaryFacts": F.transform(_records(_get(m, "endorsementSupport")), lambda e: F.struct(_said(e, "kind").alias("key"), _said(e, "summary").alias("value"), *_source(e))),
        "summary": F.nullif(summary, F.lit("")),
        "quoteNumber": F.when(quote, F.col("number")),
        "proposedEffectiveDate": F.when(quote, known("since")),
        "proposedExpirationDate": F.when(quote, known("until")),
        "policyNumber": F.when(~F.coalesce(quote, F.lit(False)), F.col("number")),
        "effectiveDate": F.when(~F.coalesce(quote, F.lit(False)), F.col("since")),
        "expirationDate": F.when(~F.coalesce(quote, F.lit(False)), F.col("until")),
        "retroactiveDate": F.when(~F.coalesce(quote, F.lit(False)), _value(m, "retroactiveDate")),
    }
    return rows.select("document_id", F.to_json(F.struct(*(c.alias(n) for n, c in made.items()))).alias("json"))
