"""Chunks of a document that has something of most families, and parsed documents, worked by hand."""

import json

import pytest
from pyspark.sql import functions as F

from citeloom.operators import parsed
from citeloom.operators.chunks import document_chunks
from citeloom.operators.materialize import documents_of_profiles
from citeloom.sources.phases import Phases

QUOTE = {
    "type": "quote", "carrier": "Acme", "linesOfBusiness": ["GL", "AUTO"], "quoteNumber": "Q", "insuredName": "X",
    "coverages": [{"name": "c1", "limit": "1", "deductible": "", "pageNumber": 3}, {"name": "c2", "limit": 0}],
    "limits": {"perOccurrence": "5", "employersLiability": {"eachAccident": "1", "diseasePolicyLimit": "2", "diseaseEachEmployee": "3"}, "sharedLimits": [{"description": "sd", "limit": "4", "coverageParts": ["a", "b"]}]},
    "deductibles": {}, "extendedReportingPeriod": {"basicDays": 60},
    "conditions": [{"name": "n", "conditionType": "t", "content": "c", "keyValues": [{"key": "a", "value": "b"}]}],
    "covered_reasons": [{"peril": "fire", "conditions": ["x", " ", "y"]}, {}],
    "declarations": {"line": "home", "n": 3, "a": "b"},
    "documentOutline": [{"children": [{"title": "k"}, {}], "pageStart": 2}],
    "vehicles": [{"number": 1, "year": 2020, "make": "m", "model": "n", "vin": "v", "coverages": [{"type": "coll", "limit": "5", "included": True}, {"type": "comp", "deductible": "6", "included": False}]}],
    "taxesAndFees": [{"type": "tax", "name": "n", "amount": "5", "description": "d"}, {"name": "o", "amount": "6"}],
    "paymentPlan": {"installments": [{"dueDate": "d", "amount": "a", "description": "x"}], "financeCharge": "f"},
    "ratingBasis": [{"type": "t", "amount": "a"}], "lossSummary": {"totalClaims": 0}, "warrantyRequirements": ["w"],
    "bindingAuthority": {"method": "m", "conditions": ["c"]}, "claimsContacts": [{"name": "n", "email": "e"}], "nonrenewalNoticeDays": 0,
    "supplementaryFacts": [{"key": "k", "value": "v", "subject": "s"}, {"key": "k", "value": "v", "context": "c"}],
}
WANT = {
    "carrier_info:0": "Carrier: Acme\nLines of Business: GL, AUTO", "declaration:quote_details": "Quote Number: Q", "named_insured:0": "Insured: X",
    "coverage:0": "Coverage: c1\nLimit: 1", "coverage:1": "Coverage: c2\nLimit: 0",
    "coverage:limit_schedule": "Limit Schedule\nPer Occurrence: 5\nEmployers Liability — Each Accident: 1, Disease Policy Limit: 2, Disease Each Employee: 3",
    "coverage:shared_limit:0": "Shared Limit: sd\nLimit: 4\nCoverage Parts: a, b", "coverage:claims_made_details": "Extended Reporting Period (Basic): 60 days",
    "condition:0": "Condition: n\nType: t\nc\na: b", "covered_reason:0": "Covered Reason: fire", "covered_reason:1": "Covered Reason: Covered Reason 2",
    "covered_reason:0:condition:0": "Covered Reason Condition: fire\nx", "covered_reason:0:condition:1": "Covered Reason Condition: fire\ny",
    "declaration:0": "Declarations\na: b\nline: home", "section:outline:0": "Document Outline: Document Node 1\nPages: 2\nChildren: k, Child 2",
    "vehicle:0": "Vehicle 1: 2020 m n\nVIN: v\ncoll: Limit 5, Included\ncomp: Ded 6, Excluded", "financial:taxes_fees": "[tax] n: 5\n  d\no: 6",
    "financial:payment_plan": "Payment Plan:\nd: a (x)\nFinance Charge: f", "financial:rating_basis": "Rating Basis: t | Amount: a", "loss_history:summary": "Loss Summary\nTotal Claims: 0",
    "financial:binding_authority": "Binding Authority\nMethod: m\nCondition: c", "underwriting_condition:warranty:0": "Warranty Requirement: w",
    "supplementary:0": "Claims Contact: n | e", "supplementary:1": "Nonrenewal Notice Days: 0", "supplementary:2": "Subject: s | k: v", "supplementary:3": "k: v | Context: c",
}


def test_chunks_of_every_kind(spark):
    docs = spark.createDataFrame([("d", json.dumps(QUOTE)), ("not json", "nope"), ("a list", "[1]"), ("none", None)], "document_id string, json string")
    got = {r.id: r for r in document_chunks(docs).collect()}
    assert {k.removeprefix("d:"): r.text for k, r in got.items()} == WANT
    assert got["d:covered_reason:0:condition:1"].metadata == {"evidenceKind": "structured_fact", "title": "fire", "conditionIndex": "1", "linesOfBusiness": "GL,AUTO", "documentType": "quote"}
    assert got["d:declaration:0"].metadata["declarationLine"] == "home"
    assert got["d:section:outline:0"].metadata["evidenceKind"] == "navigation"
    assert "evidenceKind" not in got["d:vehicle:0"].metadata


def test_policy_details_are_for_policies(spark):
    docs = spark.createDataFrame([("p", json.dumps({"type": "policy", "policyNumber": "1", "warrantyRequirements": ["w"]}))], "document_id string, json string")
    assert {r.id: r.text for r in document_chunks(docs).collect() if r.text} == {"p:declaration:policy_details": "Policy Number: 1"}


PARSED = {
    "texts": [
        {"text": " one ", "label": "section_header", "prov": [{"page_no": 1, "bbox": {"l": 1, "t": 2, "r": 4, "b": 8}}]},
        {"self_ref": "#/texts/x", "orig": "two", "prov": [{"page": 3}, {"page": 2}], "children": [{"$ref": "#/texts/2"}]},
        {"text": "three"}, {"text": "  "}, {"text": "unreached"},
    ],
    "tables": [
        {"label": "table", "data": {"table_cells": [{"start_row_offset": 0, "start_col_offset": 0, "text": "H"}, {"row_header": True, "row": 0, "col": 1, "text": "I"}, {"row": 1, "col": 1, "content": "v"}, {"row": 1, "col": 1, "content": "w"}]}, "prov": [{"pageNo": 9}]},
        {"data": {"tableCells": [{"text": "only"}, {"col": 2, "text": "row"}]}},
    ],
    "groups": [{"children": ["#/tables/0", {"ref": "#/texts/x"}]}],
    "body": {"children": [{"$ref": "#/texts/2"}, {"$ref": "#/groups/0"}, "#/texts/0", {"$ref": "#/tables/1"}, "#/texts/3", "#/gone"]},
    "pages": {"1": {}, "4": {}},
}


def test_parsed_documents(spark):
    flat = {"pictures": [{"text": "pic"}], "keyValueItems": [{"text": "kv", "label": "key_value"}], "texts": [{"text": "t"}]}
    docs = spark.createDataFrame([("a", json.dumps(PARSED)), ("b", json.dumps(flat)), ("c", "{}"), ("d", "x")], "document_id string, json string")
    units = parsed.units(docs)
    got = {}
    for r in units.orderBy("document_id", "i").collect():
        got.setdefault(r.document_id, []).append(r)
    assert [r.text for r in got["a"]] == ["three", "| H | I |\n| --- | --- |\n|  | w |", "two", "one", "only | row"]
    assert [r.text for r in got["b"]] == ["t", "kv"]  # without a body, pictures don't count
    assert (got["a"][2].page_start, got["a"][2].page_end) == (2, 3)
    assert [tuple(b) for b in got["a"][3].bboxes] == [(1, 1.0, 2.0, 3.0, 6.0)]
    spans = {(r.document_id, r.pos): r for r in parsed.parsed_spans(units).collect()}
    assert [p for d, p in sorted(spans) if d == "a"] == [0, 1000, 1001, 1002, 1100, 1101, 1201, 2000, 3000, 4000, 4001, 4100, 4102]
    row, cell = spans["a", 1002], spans["a", 1201]
    assert (row.text, row.source_unit, row.is_header, row.parent_span_id) == ("I: w", "table_row", False, spans["a", 1000].id)
    assert (cell.text, cell.column_name, cell.row_span_id, cell.metadata["columnIndex"]) == ("w", "I", row.id, "1")
    assert (spans["a", 3000].source_unit, spans["b", 1000].source_unit) == ("section", "key_value")
    whole = {r.document_id: (r.page_count, r.text) for r in parsed.parsed_text(docs, units).collect()}
    assert whole["a"] == (4, "Page 1\nthree\n\none\n\nonly | row\n\nPage 2\ntwo\n\nPage 4\n| H | I |\n| --- | --- |\n|  | w |")
    assert whole["c"] == whole["d"] == (1, "")


def test_a_body_that_goes_round_is_an_error(spark):
    doc = {"groups": [{"children": ["#/groups/0"]}], "body": {"children": ["#/groups/0"]}}
    docs = spark.createDataFrame([("a", json.dumps(doc))], "document_id string, json string")
    with pytest.raises(ValueError):
        parsed.body_order(docs, parsed.items(docs), 3)


def test_parsed_input(spark):
    rows = spark.createDataFrame([('{"kind": "docling_document", "document": {}}',), ('{"kind": "docling_document", "document": 1}',), ('{"kind": "other", "document": {}}',), ("x",), (None,)], "j string")
    assert [r.x for r in rows.select(parsed.is_parsed_input(F.col("j")).alias("x")).collect()] == [True, False, False, False, False]


def test_phases_go_on_after_the_last_whole_one(spark, tmp_path):
    phases, made = Phases(spark, f"file://{tmp_path}/job", ["read", "group", "write"]), []
    one = lambda: made.append(1) or spark.range(3)
    assert not phases.complete("read")
    assert phases.run("group", one).count() == 3 and phases.run("group", one).count() == 3
    assert made == [1]  # the second time it was read
    assert phases.complete("read") and phases.complete("group") and not phases.complete("write")
    assert not Phases(spark, f"file://{tmp_path}/job").complete("read")  # without an order only what was written counts
    phases.clear()
    assert not phases.complete("group")


def test_documents_of_profiles(spark):
    ids = {"sourceSpanIds": ["s1"], "sourceNodeIds": ["n1"]}
    home = {"street1": "1 A", "city": "B", "state": "C", "zip": "9"}
    profile = {
        "documentType": "policy", "policyNumber": {"value": "p 1", "normalizedValue": "P1", **ids}, "premium": {"value": "$5", "normalizedValue": "5", **ids}, "totalCost": {"value": "$1,250.50", **ids},
        "linesOfBusiness": ["GL", "AUTO"], "productIdentity": {"name": {"value": "Shield"}},
        "parties": [{"role": "carrier", "name": "Second", "address": home, **ids}, {"role": "insurer", "name": "First", "sourceSpanIds": ["s9"], "sourceNodeIds": []}, {"role": "named_insured", "name": " ", **ids}],
        "declarationFacts": [{"field": "mailingAddress", "value": "1 A", "address": home, **ids}, {"field": "entityType", "value": "Inc.", **ids}, {"field": "taxId", "value": "12", **ids}, {"field": "additionalNamedInsured", "value": "Also", **ids}, {"field": "additionalNamedInsured", "value": "Unbacked", "sourceSpanIds": [], "sourceNodeIds": []}],
        "coverages": [{"name": "C", "limit": "5", "limits": [{"label": "Each", "value": "5"}], **ids}, {"name": "D", "limit": "6", "deductible": "1", "limits": [], **ids}],
        "coverageSchedules": [{"kind": "vehicle", "items": [{"label": "Unit 7", "values": [{"label": "Model Year", "value": "2020"}, {"label": "Make", "value": "m"}, {"label": "Model", "value": "n"}, {"label": "VIN", "value": "v"}]}, {"label": "x", "values": []}]},
                              {"kind": "property", "items": [{"label": "x", "description": "shop", "values": [{"label": "Street Address", "value": "1 A"}, {"label": "City", "value": "B"}, {"label": "State", "value": "C"}, {"label": "Postal Code", "value": "9"}, {"label": "Building", "value": "100"}]}]}],
        "endorsementSupport": [{"kind": "waiver", "summary": "w", **ids}], "taxesAndFees": [{"name": "fee", "amount": "$1", "amountValue": 1, **ids}],
    }
    quote = {"documentType": "quote", "policyNumber": {"value": "Q"}, "expirationDate": {"value": "2025"}}
    rows = spark.createDataFrame([("p", json.dumps(profile)), ("q", json.dumps(quote)), ("x", "no")], "document_id string, json string")
    forms = spark.createDataFrame([("p", 2, "F2", "T"), ("p", 1, "F1", None), ("p", 3, " ", "gone")], "document_id string, pos int, form_number string, title string").selectExpr("*", "null edition_date", "'coverage' form_type", "1 page_start", "null page_end")
    made = documents_of_profiles(rows, forms)
    got = {r.document_id: json.loads(r.json) for r in made.collect()}
    p, q = got["p"], got["q"]
    assert set(got) == {"p", "q"}
    assert (p["policyNumber"], p["premium"], p["totalCostAmount"], p["carrier"], p["insuredName"], p["effectiveDate"]) == ("P1", "$5", 1250.5, "Second", "Unknown", "Unknown")
    assert p["insurer"] == {"legalName": "Second", "address": home, "sourceSpanIds": ["s1"]} and "producer" not in p
    assert (p["insuredEntityType"], p["insuredFein"], p["insuredAddress"], p["programName"]) == ("corporation", "12", home, "Shield")
    assert [x["name"] for x in p["additionalNamedInsureds"]] == ["Also"]
    assert [c["originalContent"] for c in p["coverages"]] == ["C | Each: 5", "D | 6 | 1"]
    assert p["vehicles"] == [{"number": 7, "year": 2020, "make": "m", "model": "n", "vin": "v"}]
    assert p["locations"] == [{"number": 1, "address": home, "description": "shop", "buildingValue": "100"}]
    assert [f["field"] for f in p["declarations"]["fields"]] == ["policyNumber", "mailingAddress", "entityType", "fein", "additionalNamedInsured", "additionalNamedInsured"]
    assert [f["formNumber"] for f in p["formInventory"]] == ["F1", "F2"]
    assert p["summary"] == "Second #P1 covering GL, AUTO"
    assert (q["quoteNumber"], q["proposedExpirationDate"], "proposedEffectiveDate" in q, "policyNumber" in q) == ("Q", "2025", False, False)
    chunks = {r.id: r.text for r in document_chunks(made).collect()}
    assert chunks["p:vehicle:0"] == "Vehicle 7: 2020 m n\nVIN: v" and chunks["p:declaration:form:1"].startswith("Form: F2\nTitle: T")


def test_forms_within_each_other_collapse_into_the_outermost(spark):
    rows = []
    for d in "ab":
        rows.append((d, f"{d}0", "root", "form", "Policy Form", 0))
        for i in range(1, 5):
            rows += [(d, f"{d}{i}", f"{d}{i - 1}", "form", "Policy Form", 1), (d, f"{d}p{i}", f"{d}{i}", "page", "T", 2), (d, f"{d}d{i}", f"{d}{i}", "page_group", "Declarations", 3), (d, f"{d}q{i}", f"{d}p{i}", "text", "T", 1)]
    df = spark.createDataFrame(rows, "document_id string, id string, parent_id string, kind string, title string, ord int")
    from citeloom.operators import grouping as G

    got = {r.id: r.parent_id for r in G.plain_forms(df).collect()}
    assert got == {f"{d}0": "root" for d in "ab"} | {f"{d}{x}{i}": f"{d}0" for d in "ab" for i in range(1, 5) for x in "pd"} | {f"{d}q{i}": f"{d}p{i}" for d in "ab" for i in range(1, 5)}
    try:
        G.outermost(spark.createDataFrame([("x", "y"), ("y", "x")], "_g string, _outer string")).collect()
        raise AssertionError("a circle")
    except ValueError:
        pass


def test_nested_outline(spark):
    import json

    from citeloom.operators import projections as J

    rows = [("d", "r", None, "document", 0, None, []), ("d", "b", "r", "page", 2, "B", ["s2"]), ("d", "a", "r", "page", 1, 'A "q"', ["s1", "s2"]), ("d", "a1", "a", "text", 1, None, []), ("d", "a2", "a1", "text", 1, "deep", ["s3"]), ("e", "x", None, "document", 0, None, []), ("e", "y", "x", "page", 0, None, []), ("e", "lost", "nowhere", "page", 0, None, [])]
    df = spark.createDataFrame(rows, "document_id string, id string, parent_id string, kind string, ord int, text_excerpt string, source_span_ids array<string>").withColumns({"title": F.col("id"), "page_start": F.lit(1), "page_end": F.lit(None).cast("int")})
    got = {r.document_id: json.loads(r.outline) for r in J.nested_outline(df).collect()}
    a, b = got["d"]
    assert (a["id"], b["id"]) == ("a", "b") and a["excerpt"] == a["content"] == 'A "q"' and a["sourceTextHash"] == "s1:s2" and "pageEnd" not in a and a["interpretationLabels"] == ["page"]
    assert a["children"][0]["children"][0]["id"] == "a2" and "excerpt" not in a["children"][0] and b["children"] == [] and [n["id"] for n in got["e"]] == ["y"]
    assert J.nested_outline(df.limit(0)).count() == 0


def test_templates_of_documents(spark):
    from citeloom.operators import templates as L

    kinds = [*L.NAMED, *L.SAME]
    docs = spark.createDataFrame([(str(i), k) for i, k in enumerate([*kinds, "zzz", None])], "document_id string, policy_type string")
    names = sorted({*L.NAMED.values(), *L.SAME})
    shape = "type string, expected array<string>, required array<string>, optional array<string>, hints map<string,string>"
    table = spark.createDataFrame([(n, ["a"], ["b"], None, None) for n in names if n != "cyber"] + [("flood", ["z"], ["b"], None, None)], shape)
    got = {r.policy_type: r for r in L.with_template(docs, table).collect()}
    assert len(kinds) == 25 and got["condo_ho6"].template == "homeowners" and got["excess_liability"].template == "umbrella_excess" and got["watercraft"].template == "watercraft"
    assert {k for k, r in got.items() if r.template == "unknown"} == {"cyber", "zzz", None} and got[None].required == list(L.DEFAULT["required"]) and got["cyber"].hints == L.DEFAULT["hints"]
    assert got["watercraft"].optional == [] and got["watercraft"].hints == {} and got["flood_nfip"].expected == ["a"]  # of two floods one counts
    gaps = L.section_gaps(docs.where("policy_type = 'watercraft'"), spark.createDataFrame([], "document_id string, section string"), table).collect()
    assert {(r.section, r.standing, r.hint) for r in gaps} == {("b", "required", None), ("a", "expected", None)}
    assert L.section_gaps(docs.limit(0), spark.createDataFrame([], "document_id string, section string"), table.limit(0)).count() == 0
