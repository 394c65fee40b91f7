"""Runs over tables of documents: failures stay with their document, phases are resumed, sections are taken again."""

import json

from pyspark.sql import functions as F

from citeloom.operators import drivers as D
from citeloom.operators import recovery as R
from citeloom.operators import sections as S
from citeloom.plans import queries  # noqa: F401  (the other plans need it first)
from citeloom.plans.changes import _tables
from citeloom.sources.phases import Phases


def sources(spark, *documents):
    nodes = spark.createDataFrame([(d, f"{d}-n") for d in documents], "document_id string, id string")
    spans = spark.createDataFrame([(d, f"{d}-s", "limit $1,000 applies", 3, 3, None) for d in documents], "document_id string, id string, text string, page_start int, page_end int, metadata map<string,string>")
    return nodes, spans


def test_a_useless_candidate_fails_its_document_alone(spark, tmp_path):
    nodes, spans = sources(spark, "a", "b", "c", "d")
    coverages = spark.createDataFrame([(d, 1, False, "Flood", None, None, None, None, None, None, None, None, []) for d in ("a", "b", "c")], R.FACT)
    term = lambda d, value, span: {"kind": "limit", "label": "L", "value": value, "sourceSpanIds": [span]}
    good = lambda d: json.dumps({"coverages": [{"name": " FLOOD", "limit": "$1,000", "limits": [term(d, "$1,000", f"{d}-s"), term(d, "$2,000", f"{d}-s"), term(d, "$1,000", "gone")], "sourceSpanIds": [f"{d}-s"]}, {"name": "Wind", "limits": [term(d, "$1,000", f"{d}-s")], "sourceNodeIds": ["gone"]}], "warnings": ["w", 3]})
    rows = [("a", 1, good("a")), ("b", 1, good("b")), ("b", 2, "{oh"), ("c", 1, "[]"), ("d", 1, '{"coverages":[{"name": 5}]}'), ("d", 2, None)]
    candidates = spark.createDataFrame(rows, "document_id string, seq int, json string")
    documents = spark.createDataFrame([(d,) for d in "abcde"], "document_id string")
    phases = Phases(spark, str(tmp_path / "run"))
    got = D.recover(documents, coverages, candidates, nodes, spans, phases)
    told = {r.document_id: (r.status, r.n_coverages, r.n_terms, r.n_rejected) for r in got.diagnostics.collect()}
    assert told == {"a": ("succeeded", 0, 1, 3), "b": ("failed", 0, 0, 0), "c": ("failed", 0, 0, 0), "d": ("failed", 0, 0, 0), "e": ("succeeded", 0, 0, 0)}
    assert {(r.document_id, r.seq, r.error) for r in got.quarantine.collect()} == {("b", 2, "candidate is not JSON"), ("c", 1, "candidate is not an object"), ("d", 1, "a coverage has no name"), ("d", 2, "candidate is not JSON")}
    assert sorted((r.document_id, r.name, r.limit, r.n_terms, r["first"]) for r in got.coverages.collect()) == [("a", "Flood", "$1,000", 1, 3), ("b", "Flood", None, 0, None), ("c", "Flood", None, 0, None)]
    warnings = {r.document_id: r.warnings for r in got.diagnostics.collect()}
    assert warnings["b"] == ["Coverage recovery failed: candidate is not JSON"] and warnings["e"] == []
    # a second run with other candidates takes the phases that are there
    again = D.recover(documents, coverages, candidates.limit(0), nodes, spans, phases)
    assert {r.document_id: r.status for r in again.diagnostics.collect()}["b"] == "failed"
    phases.clear()
    assert {r.status for r in D.recover(documents, coverages, candidates.limit(0), nodes, spans, phases).diagnostics.collect()} == {"succeeded"}


def test_sections_are_taken_again_where_nothing_changed(spark):
    key = lambda d, s, f="f", x="4.x", ids=("s",): (d, s, f, x, list(ids))
    schema = "document_id string, section string, fingerprint string, extractor string, ids array<string>"
    asked = spark.createDataFrame([key("a", S.CORE), key("b", S.CORE), key("c", S.CORE), key("d", S.CORE, ids=("s", "t")), key("e", S.CORE), key("f", S.CORE)], schema)
    result = lambda d, **o: (d, S.CORE, o.get("status", "complete"), o.get("f", "f"), o.get("x", "4.x"), ["s"], '{"b":1.0,"a":[]}', [], None)
    stored = S.hashed(spark.createDataFrame([result("a"), result("b", f="old"), result("c", x="3.x"), result("d"), result("e", status="degraded"), result("f")], S.RESULT))
    stored = stored.withColumn("profile", F.when(F.col("document_id") == "f", '{"b":2}').when(F.col("document_id") == "a", '{ "a" : [], "b" : 1 }').otherwise(F.col("profile")))
    made = []

    def make(open_):
        made.extend(r.document_id for r in open_.collect())
        return S.from_outputs(spark.createDataFrame([(d, S.CORE, '{"x":1}') for d in "bcdef"], "document_id string, section string, json string"))(open_)

    got = {r.document_id: r for r in S.resumed(asked, stored.unionByName(stored), make).collect()}
    assert sorted(made) == ["b", "c", "d", "e", "f"] and {d for d, r in got.items() if r.reused} == {"a"} and len(got) == 6
    assert got["b"].profile == '{"x":1,"coverages":[]}' and got["b"].status == "complete" and got["d"].ids == ["s", "t"]
    assert S.usable(S.hashed(spark.createDataFrame([], S.RESULT)), asked).count() == 0


def test_extraction_of_documents(spark):
    nodes, spans = sources(spark, "a", "b", "c")
    asked = spark.createDataFrame([(d, s, f"f{d}", "4.x", [f"{d}-s"]) for d in "abc" for s in (S.CORE, S.COVERAGE)], "document_id string, section string, fingerprint string, extractor string, ids array<string>")
    cover = json.dumps({"coverages": [{"name": "General Liability", "sourceNodeIds": ["a-n"]}]})
    outputs = spark.createDataFrame([("a", S.CORE, '{"premium":{"value":"$5","sourceSpanIds":["a-s"]}}'), ("a", S.COVERAGE, cover), ("a", S.CLEANUP, "nonsense"), ("b", S.CORE, "{}"), ("c", S.CORE, '{"premium":{"value":"$5","sourceSpanIds":["a-s"]}}'), ("c", S.COVERAGE, '{"coverages":{}}')], "document_id string, section string, json string")
    eligible = spark.createDataFrame([(d, f"f{d}", "4.x", [f"{d}-s"], "L") for d in "abc"], "document_id string, fingerprint string, extractor string, eligible array<string>, ledger_hash string")
    codes = spark.createDataFrame([("GL9", "General Liability")], "code string, description string")
    none = S.hashed(spark.createDataFrame([], S.RESULT))
    run = lambda outputs, stored: D.extract(asked, outputs, stored, nodes, spans, (*_tables(spark), codes), eligible)
    first = run(outputs, none)
    got = {r.document_id: r for r in first.documents.collect()}
    assert {d: r.status for d, r in got.items()} == {"a": "extracted", "b": "failed", "c": "failed"}
    assert got["a"].profile.premium.value == "$5" and got["a"].profile.coverages[0].coverageCode == "GL9" and got["a"].warnings == ["Operational profile cleanup pass failed; uncleaned profile used (output is not JSON)"]
    assert got["b"].warnings == ["no output"] and got["c"].profile.premium is None and got["c"].warnings == ["coverages are not a list"]
    assert {r.document_id: r.complete for r in first.manifests.collect()} == {"a": False, "b": False, "c": False}
    mended = outputs.where("document_id = 'x'").unionByName(spark.createDataFrame([("b", S.COVERAGE, "{}"), ("a", S.CLEANUP, "{}")], outputs.schema))
    second = run(mended, first.sections.drop("reused"))
    assert {(r.document_id, r.section) for r in second.sections.where("reused").collect()} == {("a", S.CORE), ("a", S.COVERAGE), ("b", S.CORE), ("c", S.CORE)}
    assert {r.document_id: r.status for r in second.documents.collect()} == {"a": "extracted", "b": "extracted", "c": "failed"}
    assert {r.document_id: r.complete for r in second.manifests.collect()} == {"a": True, "b": True, "c": False}
