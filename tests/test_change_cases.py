"""Policy-change cases, opened and replied to, by hand-made cases."""

import json

from pyspark.sql import functions as F

from citeloom.operators import change_cases as D

SOURCE = "case_id string, pos long, source_id string, label string, text string, document_id string, page long, field_path string, form_number string, starts string, ends string"


def source(case, pos, id_, text, label="Page", form=None):
    return (case, pos, id_, label, text, "doc", 1, None, form, None, None)


def requests(spark, *rows):
    return spark.createDataFrame([(c, t, m) for c, t, m in rows], "case_id string, text string, requested string")


def proposals(spark, *rows):
    return spark.createDataFrame([(c, j if isinstance(j, str) else json.dumps(j)) for c, j in rows], "case_id string, json string")


ITEM = {"action": "update", "fieldPath": "coverage.limit", "label": "Limit", "kind": "limit_change", "beforeValue": "$1,000", "afterValue": "$2,000", "citations": [{"sourceId": "s2", "quote": "other"}, {"sourceId": "s1", "quote": "$1,000"}], "effectiveDate": "02/01/2026"}


def test_a_sound_proposal_is_validated_in_order(spark):
    sources = spark.createDataFrame([source("a", 0, "s1", "Limit $1,000. Policy period 01/01/2024 to 01/01/2025"), source("a", 1, "s2", "other")], SOURCE)
    bad = ITEM | {"label": "Second", "beforeValue": "$9", "citations": [{"sourceId": "s1", "quote": "$9"}], "effectiveDate": "soon", "afterValue": "x"}
    s = D.open_cases(requests(spark, ("a", "Raise it", None)), sources, proposals(spark, ("a", {"summary": "", "items": [ITEM, bad]})))
    told = [(r.code, r.severity, r.message) for r in s.issues.orderBy("pos").collect()]
    assert told == [
        ("effective_date_outside_policy_period", "blocking", "Requested effective date 02/01/2026 is outside the cited policy period."),
        ("quote_not_found", "blocking", "Quoted value for coverage.limit.beforeValue was not found in source s1."),
        ("effective_date_unparseable", "warning", "Requested effective date soon could not be parsed."),
    ]
    case = s.cases.collect()[0]
    assert (case.summary, case.mode) == ("update Limit; update Second", "hybrid")
    assert [r.source_span_ids for r in s.items.orderBy("pos").collect()] == [["s1", "s2"], ["s1"]]
    assert s.quarantine.count() == 0


def test_more_than_one_span_sends_a_limit_to_the_market_and_a_given_mode_rules(spark):
    sources = spark.createDataFrame([source(c, 0, "s1", "Limit $1,000") for c in "ab"] + [source(c, 1, "s2", "other") for c in "ab"], SOURCE)
    item = {k: v for k, v in ITEM.items() if k != "effectiveDate"}
    both = proposals(spark, *((c, {"summary": "x", "items": [item]}) for c in "ab"))
    s = D.open_cases(requests(spark, ("a", "Raise it", None), ("b", "Raise it", "deterministic_tree")), sources, both)
    assert {r.case_id: r.mode for r in s.cases.collect()} == {"a": "market_eval", "b": "deterministic_tree"}


BAD = [
    "", "[]", '"x"', "{", {"items": []}, {"summary": 1, "items": []}, {"summary": "x"}, {"summary": "x", "items": {}}, {"summary": "x", "items": [1]}, {"summary": "x", "items": [{"action": "add", "label": "l"}]},
    {"summary": "x", "items": [ITEM | {"action": "raise"}]}, {"summary": "x", "items": [ITEM | {"kind": "other"}]}, {"summary": "x", "items": [ITEM | {"status": None}]}, {"summary": "x", "items": [ITEM | {"sourceIds": [1]}]}, {"summary": "x", "items": [ITEM | {"citations": [{"sourceId": "s"}]}]},
    {"summary": "x", "items": [ITEM | {"confidenceScore": 2}]}, {"summary": "x", "items": [ITEM | {"confidenceScore": "1"}]}, {"summary": "x", "items": [ITEM | {"beforeValue": 3}]}, {"summary": "x", "items": [], "missingInfoQuestions": [{"question": "q"}]}, {"summary": "x", "items": [], "missingInfoQuestions": "q"},
]


def test_bad_proposals_cost_their_own_case_alone(spark):
    names = [f"c{i}" for i in range(len(BAD))]
    sources = spark.createDataFrame([], SOURCE)
    s = D.open_cases(requests(spark, ("ok", "x", None), *((n, "Remove driver", None) for n in names)), sources, proposals(spark, ("ok", {"summary": "fine", "items": [ITEM]}), *zip(names, BAD, strict=True)))
    assert {r.case_id for r in s.quarantine.collect()} == set(names)
    assert {r.case_id: r.summary for r in s.cases.collect()} == {"ok": "fine"} | {n: "Remove driver" for n in names}
    assert s.items.where("case_id <> 'ok' AND kind = 'vehicle_change' AND status = 'ready'").count() == len(names)


def test_evidence_that_was_found_joins_what_was_given(spark):
    given = spark.createDataFrame([source("a", 0, "s9", "given")], SOURCE)
    found = spark.createDataFrame([source("a", 0, "s9", 'has "Old" now') + (0.9,), source("a", 0, "s1", "first") + (0.8,), source("a", 0, "s2", "left out") + (0.1,)], SOURCE + ", relevance double")
    s = D.open_cases(requests(spark, ("a", 'Change address from "Old" to New', None)), given, None, found, most=2)
    assert [(r.source_id, r.pos, r.text) for r in s.sources.orderBy("pos").collect()] == [("s1", 1, "first"), ("s9", 2, 'has "Old" now')]
    item = s.items.collect()[0]
    assert (item.before_value, item.after_value, item.source_ids, item.citations[0].page) == ("Old", "New", ["s9"], 1.0)


def test_replies_answer_by_id_or_field_and_the_rest_stays(spark):
    asks = {"summary": "x", "items": [{"action": "update", "fieldPath": "f", "label": "F"}, {"action": "update", "fieldPath": "g", "label": "G", "id": "own"}], "missingInfoQuestions": [{"id": "q1", "fieldPath": "f", "question": "f?", "reason": "r"}, {"id": "q2", "itemId": "own", "question": "g?", "reason": "r", "answer": "before"}]}
    s = D.open_cases(requests(spark, *((c, "t", None) for c in "abcd")), spark.createDataFrame([], SOURCE), proposals(spark, *((c, asks) for c in "abcd")))
    replies = spark.createDataFrame([("a", "to all"), ("b", "just this"), ("d", " "), ("zz", "no such case")], "case_id string, text string")
    r = D.reply(s, replies, proposals(spark, ("a", {"answers": [{"questionId": "", "fieldPath": "f", "answer": " "}, {"questionId": "q2", "answer": "later"}, {"fieldPath": "f", "answer": "second"}]}), ("b", "none"), ("c", {"answers": []})))
    said = {(x.case_id, x.question_id): x.answer for x in r.state.questions.collect()}
    # the first answer to f is blank, so f stays open; an answer that was there is replaced
    assert said == {("a", "q1"): None, ("a", "q2"): "later", ("b", "q1"): "just this", ("b", "q2"): "before", ("c", "q1"): None, ("c", "q2"): "before", ("d", "q1"): None, ("d", "q2"): "before"}
    assert {x.case_id: x.n_answered for x in r.merged.collect()} == {"a": 1, "b": 1, "d": 0}
    values = {(x.case_id, x.label): (x.after_value, x.status) for x in r.state.items.collect()}
    assert values[("a", "G")] == ("later", "ready") and values[("b", "F")] == ("just this", "ready") and values[("b", "G")] == ("before", "ready")
    assert values[("c", "G")] == (None, "needs_info")  # no reply: as it was
    assert [x.case_id for x in r.quarantine.collect()] == ["b"]
    assert r.state.cases.count() == 4 and {x.case_id for x in r.state.cases.where("mode = 'hybrid'").collect()} == {"a", "c", "d"}


def test_a_packet_holds_each_citation_once(spark):
    sources = spark.createDataFrame([source("a", 0, "s1", "Limit $1,000")], SOURCE)
    item = {"action": "update", "fieldPath": "p", "label": "P", "beforeValue": "$1,000", "afterValue": "n", "citations": [{"sourceId": "s1", "quote": "$1,000", "page": 2}]}
    s = D.open_cases(requests(spark, ("a", "x", None)), sources, proposals(spark, ("a", {"summary": "sum", "items": [item, item | {"fieldPath": "o", "label": "O"}]})))
    made = {r.kind: r for r in D.packets(s, F.lit(5)).collect()}
    assert set(made) == {k for k, _ in D.TITLES} and len({r.packet_id for r in made.values()}) == 1 and len({r.artifact_id for r in made.values()}) == 5
    assert len(made["carrier_email"].citations) == 1 and made["validation_report"].citations == []
    body = json.loads(made["json_packet"].content)
    assert [i["label"] for i in body["items"]] == ["P", "O"] and body["items"][0]["citations"] == [{"sourceId": "s1", "quote": "$1,000", "page": 2.0}] and body["evidenceSourceIds"] == ["s1"]
    assert made["carrier_email"].content.endswith("- P: n\n- O: n")


def test_no_cases(spark):
    s = D.open_cases(requests(spark, ("a", "x", None)).limit(0), spark.createDataFrame([], SOURCE), None)
    assert s.cases.count() == s.items.count() == s.issues.count() == D.packets(s, F.lit(0)).count() == 0
