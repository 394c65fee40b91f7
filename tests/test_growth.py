"""Work that has to grow no faster than the input, and what it returns where rows repeat."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from citeloom.functions import codes as K
from citeloom.functions import text as T
from citeloom.operators import application as A
from citeloom.operators import cleanup as L
from citeloom.operators import parsed as P
from citeloom.operators import profiles as PR
from citeloom.operators import recovery as V
from citeloom.operators import source as S
from citeloom.operators import spans as SP
from citeloom.plans.queries import QUERIES
from citeloom.sources.scratch import cut

SF = "/root/testdata/sf0.01"


def nodes_of(plan):
    """The nodes of a plan that has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return nodes_of(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return nodes_of(plan.plan())
    out, children = [plan], plan.children()
    for i in range(children.size()):
        out += nodes_of(children.apply(i))
    return out


def most_rows(df, kind):
    """The most rows that a node of this kind made when df was collected."""
    df.collect()
    found = [n for n in nodes_of(df._jdf.queryExecution().executedPlan()) if kind in n.nodeName() and n.metrics().contains("numOutputRows")]
    return max(n.metrics().apply("numOutputRows").value() for n in found)


def test_memory_fills_each_field_for_itself(spark):
    fields = spark.createDataFrame([(1, 1, "f", "Notes", ""), (1, 2, "f", "Nick", None), (1, 3, "f", "Notes", "mine"), (1, 4, "g", None, " ")], "app_id int, pos int, id string, label string, value string")
    chunks = spark.createDataFrame([(1, 5, "late", "f", None), (1, 2, "first", "f", " notes "), (1, 1, " ", "f", None), (1, 9, "x", None, "nick"), (1, 4, "g4", "g", None), (2, 0, "other", "f", None)], "app_id int, pos int, value string, field_id string, label string")
    got = {r.pos: r.value for r in A.memory_fill(fields, chunks).collect()}
    assert got == {1: "first", 2: "late", 3: "mine", 4: "g4"}


def test_memory_meets_names_not_fields(spark):
    fields = spark.range(400).select(F.lit(1).alias("app_id"), F.col("id").alias("pos"), F.lit("f").alias("id"), F.lit("Notes").alias("label"), F.lit("").alias("value"))
    chunks = spark.range(400).select(F.lit(1).alias("app_id"), F.col("id").alias("pos"), F.lit("v").alias("value"), F.lit("f").alias("field_id"), F.lit(None).cast("string").alias("label"))
    assert most_rows(A.memory_fill(fields, chunks), "Join") <= 400


def test_regions_of_equal_pages_share_their_evidence(spark):
    regions = spark.range(60).select(F.col("id").alias("region_id"), F.lit("d").alias("document_id"), (1 + F.col("id") % 2).cast("int").alias("start"), F.lit(6).alias("stop"))
    spans = spark.range(50).select(F.lit("d").alias("document_id"), F.col("id").cast("string").alias("id"), (1 + F.col("id") % 9).cast("int").alias("page_start"), (1 + F.col("id") % 9 + F.col("id") % 3).cast("int").alias("page_end"), F.repeat(F.lit("word "), (F.col("id") * 13).cast("int")).alias("text"))
    df = V.batched_evidence(regions, spans, 3000)
    cols = ["region_id", "seq", "part", "span_id", "text", "batch"]
    got = sorted(tuple(r) for r in df.collect())
    want = sorted(tuple(r) for r in V.evidence_batches(V.region_evidence(regions, spans), 3000).select(*cols).collect())
    assert got == want and {r[0] for r in got} == set(range(60))
    assert most_rows(df, "Generate") < len(want) / 3


def test_scopes_are_matched_once(spark):
    rows = spark.range(600).select(F.lit("d").alias("document_id"), F.col("id").alias("seq"), F.lit("Wind & hail").alias("name"), F.lit(None).cast("string").alias("line"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("F-"), F.col("id") % 3)).alias("form"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("endorsement"), F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("int")).alias("first"), F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("int")).alias("last"))
    primary, found = rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1").withColumn("name", F.lit("wind AND hail"))
    df = V.match_scope(primary, found)
    assert most_rows(df, "Join") <= 300 and set(df.columns) == {*found.columns, "match"}
    p = primary.collect()
    fits = lambda a, b: (not a.form or not b.form or a.form == b.form) and (a.first is None or b.first is None or abs(a.first - b.first) <= 1)
    assert all(r.match == min(x.seq for x in p if fits(x, r)) for r in df.collect())


def test_nodes_meet_those_near_them_alone(spark, monkeypatch):
    plans, real = [], L.cut
    monkeypatch.setattr(L, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    nodes = spark.range(40).select(F.lit("d").alias("document_id"), F.concat(F.lit("n"), "id").alias("id"), F.lit("p").alias("parent_id"), F.lit("text").alias("kind"), F.col("id").alias("ord"), F.lit(1).alias("page_start"), F.lit(None).cast("int").alias("page_end"), F.lit("t").alias("text"))
    cited = nodes.where("ord IN (0, 20)").select("document_id", "id")
    got = {r.id: r.score for r in L.select_nodes(nodes, cited, spark.createDataFrame([], "document_id string, term string"), "no such word").collect()}
    assert got == {f"n{i}": (1000 if i in (0, 20) else 850 - min(i, abs(i - 20))) for i in range(40) if i <= 4 or 16 <= i <= 24}
    assert any(re.search(r"Join \[parent_id#\d+, [^\]]*ord#", p) for p in plans)


def seconds(df):
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def test_markdown_of_a_long_table(spark):
    cells = F.when(F.col("id") % 3 == 0, F.array(F.lit(" a|b "))).otherwise(F.array(F.lit("x"), F.lit("y")))
    df = spark.range(20_000).agg(F.collect_list(cells).alias("rows")).select(S.grid_markdown(F.col("rows")).alias("t"))
    assert seconds(df) < 20
    lines = df.first().t.split("\n")
    assert len(lines) == 20_001 and lines[:4] == ["| a\\|b |  |", "| --- | --- |", "| x | y |", "| x | y |"]
    some = spark.createDataFrame([([],), (None,), ([[]],), ([["h"]],)], "rows array<array<string>>").select(S.grid_markdown(F.col("rows")).alias("t"))
    assert [r.t for r in some.collect()] == ["", "", "", "| h |\n| --- |"]


CELL = "array<struct<row:int,col:int,text:string>>"


def test_grid_of_many_cells(spark):
    cell = F.struct((F.col("id") * 2).cast("int").alias("row"), (F.col("id") % 2).cast("int").alias("col"), F.col("id").cast("string").alias("text"))
    df = spark.range(6_000).agg(F.collect_list(cell).alias("l")).select(P.grid(F.col("l")).alias("g"))
    assert seconds(df) < 10
    got = df.first().g
    assert len(got) == 11_999 and got[:4] == [["0", ""], ["", ""], ["", "1"], ["", ""]]
    some = spark.createDataFrame([([(1, 1, "b"), (1, 0, "z"), (1, 1, "c"), (3, 2, "e")],), ([],), ([(0, 0, "a")],)], f"l {CELL}").select(P.grid(F.col("l")).alias("g"))
    assert [r.g for r in some.collect()] == [[["", "", ""], ["z", "c", ""], ["", "", ""], ["", "", "e"]], None, [["a"]]]


def test_lines_of_a_parsed_table_leave_the_table_behind(spark, monkeypatch):
    kept, real = [], P.cut
    monkeypatch.setattr(P, "cut", lambda df: (kept.append(real(df)), kept[-1])[1])
    n = 40
    found = spark.createDataFrame([("d", 0, "#/tables/0", "table", "t", None, None, None, [["a", "b"], *([str(i), ""] for i in range(n - 1))])], "document_id string, i int, ref string, label string, text string, page_start int, page_end int, bboxes array<struct<page:int,x:double,y:double,width:double,height:double>>, rows array<array<string>>")
    got = P.parsed_spans(found).collect()
    assert sorted(r.text for r in got if r.source_unit == "table_row") == sorted(["a | b", *(f"a: {i}" for i in range(n - 1))])
    assert {r.column_name for r in got if r.source_unit == "table_cell"} == {"a", "b"}
    lines = kept[1]
    assert lines.count() == n and lines.where("rows IS NOT NULL").count() == 0


SAID = ["General  Liability", "a CGL form", "business automobile", "hired and non-owned auto", "worker's comp, workers’ compensation", "Umbrella Liability", "EXCESS liability", "professional  liability", "Errors & Omissions", "E&O", "privacy liability", "EPLI", "directors and officers", "D&O", "fiduciary liability", "burglary", "employee dishonesty", "fidelity", "motor truck cargo", "builder risk", "environmental liability", "ocean marine", "surety", "products completed operations", "businessowners policy", "BOP", "management liability", "HO-5", "renter", "ho 6", "condominium", "dwelling fire", "manufactured home", "personal auto", "personal umbrella", "flood", "earthquake", "personal articles", "watercraft", "RV insurance", "ranch", "trip delay", "technology insurance", "media liability", "whole life", "total disability", "pet insurance", "long-term care", "identity theft", "title insurance", "commercial property", "shop and boperty", "", None]


def test_words_of_rules_are_in_all_they_find(spark):
    rows = spark.createDataFrame(list(enumerate(SAID)), "i int, t string")
    got = {r.i: r.l for r in rows.select("i", K.lines_of_text(F.col("t")).alias("l")).collect()}
    for i, t in enumerate(SAID):
        text = re.sub(r"\s+", " ", t or "").strip()
        found = [code for code, p, _ in K.LINES if re.search(p, text, re.I | re.A)]
        assert got[i] == list(dict.fromkeys(found)), t
    assert {c for l in got.values() for c in l} == {r[0] for r in K.LINES}


def test_lines_of_texts_without_any_word_are_quick(spark):
    words = " blue worthless pieces of a thing that has no name".split()
    df = spark.range(40_000, numPartitions=1).select(K.lines_of_text(F.concat_ws(" ", *(F.concat(F.lit(w), F.col("id")) for w in words))).alias("l"))
    assert seconds(df) < 5 and df.where("size(l) > 0").count() == 0


@pytest.mark.parametrize("name", ["lines_of_text", "headed_sections", "documents_of_profiles"])
def test_small_rows_are_dealt_over_cores(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= 4


OLD_WS = r"[\t\n\x0B\f\r    -     　﻿]"


def test_white_space_and_marks_go_quickly_and_as_patterns_would_have_it(spark):
    random.seed(3)
    signs = ":;#-.,ab& \t\n ﻿ 　᠎\u0085​ é\U0001f600"
    rows = [("".join(random.choice(signs) for _ in range(random.randint(0, 9))),) for _ in range(5_000)] + [(None,)]
    df = spark.createDataFrame(rows, "t string")
    one = lambda t: F.trim(F.regexp_replace(t, f"{OLD_WS}+", " "))
    bare = F.nullif(one(F.regexp_replace("t", rf"^(?:[:;#-]|{OLD_WS})+|(?:[;,.]|{OLD_WS})+\z", "")), F.lit(""))
    assert df.where(~T.normalize_ws(F.col("t")).eqNullSafe(one(F.col("t"))) | ~PR.cleaned(F.col("t")).eqNullSafe(bare)).count() == 0
    many = spark.range(300_000, numPartitions=1).select(F.transform(F.array(F.concat(F.lit("# Cust omer"), "id", F.lit("  cover."))), PR.cleaned).alias("l"))
    assert seconds(many) < 4


def test_lines_of_a_profile_are_told_without_the_rest_of_it(spark, monkeypatch):
    written = []
    monkeypatch.setattr(PR, "cut", lambda df: written.append(df.schema.simpleString()) or cut(df))
    got = QUERIES["merged_profile_lines"](spark, SF)
    assert len(written) == 1 and "declarationFacts" not in written[0] and got.count() > 0


def test_lines_without_marks_are_cleaned_quickly(spark):
    said = ["plain words", "ends with 7", "Page 1 of 3", "a PAGE 2 OF 3 b", "AB-CD 12 34", "AB-CD 12 34 | Page 1 of 2", "Column 1: Page 1 of 2", "Column 2:", "SPECIMEN POLICY - FOR TESTING ONLY", "see specimen policy — for testing only there", "This is a CLAIMS-MADE and reported policy. Please read it carefully", "a claims-made form", "", "  ", None]
    got = [r.c for r in spark.createDataFrame(list(enumerate(said)), "i int, t string").select("i", SP.clean(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == ["plain words", "ends with 7", None, "a b", None, None, None, "Column 2:", None, "see there", None, "a claims-made form", None, None, None]
    words = " blue worthless parts of a thing that has no name and is told at some length so that a line is long".split()
    df = spark.range(60_000, numPartitions=1).select(SP.clean(F.concat_ws(" ", *(F.concat(F.lit(w), F.col("id")) for w in words), F.lit("end"))).alias("c"))
    assert seconds(df) < 3 and df.where("c IS NULL").count() == 0


def test_many_coverages_of_one_name_are_merged_quickly(spark):
    i = F.col("id")
    none = F.lit(None).cast("string")
    term = F.struct(F.lit("other").alias("kind"), F.lit("L").alias("label"), i.cast("string").alias("value"), none.alias("applies"))
    page = (i % 1500 * 3).cast("int")
    facts = spark.range(3_000).select(F.lit("d").alias("document_id"), i.cast("int").alias("seq"), (i >= 1500).alias("recovered"), F.lit("Flood").alias("name"), none.alias("line"), F.when(i % 2 == 0, " F-1 ").alias("form"), none.alias("section"), F.when(i == 2999, "E 1").alias("endorsement"), page.alias("first"), page.alias("last"), none.alias("limit"), none.alias("deductible"), F.array(term).alias("terms"))
    V.merge_recovered(facts.limit(20)).collect()  # plans and code are made
    began = time.time()
    got = [(r.seq, r.n_terms, r.n_found, r.conflicts, r.endorsement) for r in V.merge_recovered(facts).orderBy("seq").collect()]
    assert got == [(k, 2, 1, 1, None) for k in range(1499)] + [(1499, 1, 0, 0, None), (1500, 1, 1, 0, "E 1")]
    assert time.time() - began < 9


def test_extraction_takes_hashes_only_when_asked(spark, monkeypatch):
    """Documents of an extraction need no hashes of its sections; sections and manifests take them once."""
    from citeloom.operators import drivers as D
    from citeloom.operators import sections as S
    from citeloom.plans.changes import _tables

    taken, whole = [], S.C.with_value_hash
    monkeypatch.setattr(S.C, "with_value_hash", lambda df, text, name: taken.append(name) or whole(df, text, name))
    asked = spark.createDataFrame([("a", s, "f", "4.x", ["s"]) for s in (S.CORE, S.COVERAGE)], "document_id string, section string, fingerprint string, extractor string, ids array<string>")
    outputs = spark.createDataFrame([("a", S.CORE, "{}"), ("a", S.COVERAGE, "{}")], "document_id string, section string, json string")
    ids = spark.createDataFrame([("a", "n")], "document_id string, id string")
    eligible = spark.createDataFrame([("a", "f", "4.x", ["s"], "L")], "document_id string, fingerprint string, extractor string, eligible array<string>, ledger_hash string")
    stored = spark.createDataFrame([], f"{S.RESULT}, version string, hash string")
    made = D.extract(asked, outputs, stored, ids, ids, (*_tables(spark), spark.createDataFrame([], "code string, description string")), eligible)
    assert [r.status for r in made.documents.collect()] == ["extracted"] and taken.count("hash") == 0
    assert all(r.hash and r.version == S.RESULT_VERSION for r in made.sections.collect()) and made.sections.count() == 3
    assert [r.complete for r in made.manifests.collect()] == [True] and taken.count("hash") == 2  # of sections, of manifests


def test_lines_of_profiles_are_told_once_for_each_list(spark, monkeypatch):
    from citeloom.operators import profiles as P
    from citeloom.plans.changes import _tables

    asked, whole = [], P.K.resolve_lines
    monkeypatch.setattr(P.K, "resolve_lines", lambda df, key, *more: asked.append(df.count()) or whole(df, key, *more))
    named = F.from_json(F.concat(F.lit('{"linesOfBusiness":["CGL"],"documentType":"d'), "id", F.lit('"}')), P.PROFILE).alias("profile")
    base = spark.range(50).select(F.col("id").cast("string").alias("document_id"), named)
    none = spark.createDataFrame([], "document_id string, id string")
    rows = P.profile_lines(base, base.limit(0), none, none, *_tables(spark), spark.createDataFrame([], "code string, description string")).collect()
    assert len(rows) == 50 and {(tuple(r.lines), r.lines_source) for r in rows} == {(("CGL",), "existing_hint")} and max(asked) <= 2


def test_chunks_ask_for_no_missing_field_by_a_path():
    """Spark throws an exception within for each missing field that a path asks for; fields are read all at once."""
    from citeloom.operators import chunks as CH

    asked = {f.over: CH._chunk(f, CH.Item("_x", "_xf", "_af", "_i", "_j")) for f in CH.FAMILIES}
    assert len(asked) > 30 and not [over for over, sql in asked.items() if "'$." in sql]


def test_chunks_of_items_above_and_within(spark):
    from citeloom.operators.chunks import document_chunks

    doc = '{"type":"policy","sections":[{"title":"A","type":"t","pageStart":1,"subsections":[{"title":"B"},{"originalTitle":"C"},"plain",{}]}],"vehicles":[{"number":1,"year":2,"make":"m","model":"o","vin":"v","coverages":[{"type":"x","included":true},{"limit":"5"}]}],"locations":[{"number":1,"address":{"street1":"s","street2":"","zip":9}},{"number":2,"address":"no"}]}'
    got = {r.id: r.text for r in document_chunks(spark.createDataFrame([("d", doc)], "document_id string, json string")).collect()}
    assert got["d:section:0"] == "Section: A\nType: t\nPages: 1\nSubsections: B, C, Child 3, Child 4"
    assert got["d:section:0:sub:0"] == "Section: A > B" and got["d:vehicle:0"].split("\n")[0] == "Vehicle 1: 2 m o" and "x: Included" in got["d:vehicle:0"]
    assert got["d:location:0"] == "Location 1: s, 9" and got["d:location:1"] == "Location 2: "


def test_chunks_are_made_once(spark):
    """A filter pushed below the projection that makes chunks would make each of them a second time."""
    from citeloom.operators.chunks import document_chunks

    plan = document_chunks(spark.createDataFrame([("d", "{}")], "document_id string, json string"))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter " in line]
    assert filters and max(map(len, filters)) < 1000


def test_tables_of_cases_are_not_sent_to_the_driver(spark):
    from citeloom.operators import change_cases as CC

    one, two = (CC.cut(spark.range(5).select(F.col("id").alias("case_id"), F.col("id").alias(c))) for c in "xy")
    met = one.join(two.where("y > 1").groupBy("case_id").agg(F.max("y").alias("y")), "case_id", "left")
    assert met.count() == 5 and "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
