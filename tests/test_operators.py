"""Scenarios of single operators on tiny tables."""

from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.functions import vector as V
from citeloom.operators import evidence as E
from citeloom.operators import ordered as O
from citeloom.operators import spans as S
from citeloom.operators import trees as R
from citeloom.sources.store import Store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def model_hash(s):
    a, b, units = 0x811C9DC5, 0x45D9F3B, s.encode("utf-16-be")
    for i in range(len(units) // 2):
        c = units[2 * i] << 8 | units[2 * i + 1]
        a = ((a ^ c) * 0x01000193) & 0xFFFFFFFF
        b = ((b ^ (c + i)) * 0x27D4EB2D) & 0xFFFFFFFF
    return f"{a:08x}{b:08x}"


def test_stable_hash_over_utf16_units(spark):
    for s in ("", "abc", "é ü 日本", "a😀b"):
        assert one(spark, T.stable_hash(F.lit(s))) == model_hash(s)


def test_white_space_as_browsers_have_it(spark):
    assert one(spark, T.normalize_ws(F.lit("  a  \n b "))) == "a b"


def test_dates_run_over_and_two_digits_are_this_century(spark):
    assert one(spark, T.us_date_millis(F.lit("02/31/24"))) == 1709337600000  # 2 March 2024
    assert one(spark, T.us_date_millis(F.lit("13/01/2024"))) is None


def test_grounding_of_values(spark):
    assert one(spark, T.grounded(F.lit("Limit $1,000,000"), F.lit("limit of 1000000 applies")))
    assert not one(spark, T.grounded(F.lit("GL-10022"), F.lit("GL-10023")))
    assert one(spark, T.grounded(F.lit("no numbers"), F.lit("")))


def test_cosine_of_zero_vector_is_zero(spark):
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_pack_keeps_limit_or_stands_alone(spark):
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate([10, 10, 90, 200, 5])], "doc string, pos long, n long")
    got = {r.pos: r.chunk for r in S.pack(df, "doc", "pos", "n", most=100).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3}


def test_dropped_parent_takes_later_children_along_once(spark):
    df = spark.createDataFrame([(1, None, 1, "Page 1 of 2"), (2, 1, 2, "kept?"), (3, 2, 3, "grandchild"), (4, None, 4, " ")], "id long, parent long, pos long, text string")
    assert sorted(r.id for r in S.drop_boilerplate(df, "id", "parent", "pos", "text").collect()) == [3]


def test_runs_merge_on_cues(spark):
    df = spark.createDataFrame([("d", 1, 1, "Coverage for"), ("d", 2, 1, "Damage."), ("d", 3, 1, "and more"), ("d", 4, 2, "other page")], "doc string, pos int, page int, text string")
    assert [r.text for r in S.merge_runs(df, "doc", "pos", "page", "text").orderBy("run").collect()] == ["Coverage for Damage.", "and more", "other page"]


def test_first_wins_is_stable_under_repetition(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "pos int, k string")
    once = S.first_wins(df, ["k"], "pos")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, S.first_wins(once, ["k"], "pos").collect())) == [(1, "a"), (3, "b")]


def test_intervals_and_pages(spark):
    df = spark.createDataFrame([("d", 1, 2), ("d", 3, 3), ("d", 6, 9), ("d", 7, 8)], "doc string, a int, b int")
    assert sorted((r.start, r.stop, r.n) for r in O.coalesce_intervals(df, "doc", "a", "b").collect()) == [(1, 3, 2), (6, 9, 2)]
    pages = spark.createDataFrame([("d", p) for p in (5, 1, 2, 3, 3)], "doc string, p int")
    assert O.page_ranges(pages, "doc", "p").first().pages == "1-3, 5"


def test_paths_are_unique_and_orphans_are_roots(spark):
    nodes = spark.createDataFrame([("a", None, 2), ("b", "a", 1), ("c", "a", 0), ("x", "gone", 1)], "id string, parent_id string, ord long")
    got = {r.id: r.path for r in R.paths(nodes).collect()}
    assert got["c"] == got["a"] + ".1" and got["b"] == got["a"] + ".2" and len(set(got.values())) == 4 and "." not in got["x"]


def test_quoted_evidence_rules(spark):
    items = spark.createDataFrame([(1, "q", None, None), (2, "q", 9, None), (3, "Nope", 5, None), (4, "Deductible  IS", 5, None), (5, " ", None, None)], "item_id int, quote string, source_id int, cited string")
    sources = spark.createDataFrame([(5, "the deductible is\n5")], "id int, body string")
    assert {r.item_id: r.code for r in E.quoted_issues(items, sources).collect()} == {1: "missing_citation", 2: "unknown_source", 3: "quote_not_found"}


def test_first_matching_answer_decides_even_if_blank(spark):
    q = spark.createDataFrame([(1, "p1"), (2, "p2")], "id int, path string")
    a = spark.createDataFrame([(1, 1, None, " "), (2, None, "p1", "late"), (3, None, "p2", "yes")], "pos int, question_id int, field_path string, text string")
    assert {r.id: r.status for r in E.first_answers(q, a).collect()} == {1: "open", 2: "answered"}


def test_store_upserts_and_deletes(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    make = lambda *rows: spark.createDataFrame(list(rows), "id string, document_id string, text string")
    store.create("spans", make(("1", "a", "x"), ("2", "b", "y"), ("3", "c", "z")))
    store.upsert("spans", make(("1", "a", "new"), ("4", "a", "more")))
    assert [r.text for r in store.by_document("spans", "a").collect()] == ["new", "more"]
    store.delete_document("spans", "b")
    assert sorted(r.id for r in store.read("spans").collect()) == ["1", "3", "4"]


def test_ingest_upserts_new_files(spark, tmp_path):
    from citeloom.streaming.ingest import ingest

    rows = spark.createDataFrame([("1", "a", "x")], "id string, document_id string, text string")
    store = Store(spark, str(tmp_path / "store"), buckets=2)
    store.create("spans", rows)
    spark.createDataFrame([("1", "a", "new")], rows.schema).write.parquet(str(tmp_path / "in"))
    ingest(spark, str(tmp_path / "in"), rows.schema, store, "spans", str(tmp_path / "ck")).awaitTermination()
    assert [r.text for r in store.by_document("spans", "a").collect()] == ["new"]


def test_change_impacts_modes_and_lines(spark):
    from citeloom.operators import changes as C

    items = spark.createDataFrame(
        [(1, "a", "limit_change", "1", None, "2", ["s2", "s1"], ["s1"]), (1, "b", "renewal_submission_update", None, "3", "4", None, None), (2, "a", "cancellation", None, None, None, ["s1"], []), (3, "a", "certificate_endorsement_request", None, None, None, ["gone"], [])],
        "case_id int, item_id string, kind string, before_value string, requested_value string, after_value string, source_span_ids array<string>, source_ids array<string>",
    )
    sources = spark.createDataFrame([(1, "s1", "F9", "x"), (1, "s2", None, "A"), (2, "s1", "", "x")], "case_id int, source_id string, form_number string, label string")
    made = C.impacts(items, sources)
    got = {(r.case_id, r.item_id): (r.requested_value, r.endorsement_required, r.approval_required, r.forms, r.source_span_ids) for r in made.collect()}
    assert got == {(1, "a"): ("2", True, True, ["A", "F9"], ["s1", "s2"]), (1, "b"): ("3", False, True, [], []), (2, "a"): (None, True, True, [], ["s1"]), (3, "a"): (None, True, False, [], ["gone"])}
    cases = spark.createDataFrame(
        [(1, "auto", "raise it", False, False, False), (2, None, "cancel if cheaper", False, False, False), (3, None, None, None, None, None), (4, "hybrid", "", False, False, False), (5, "auto", "", True, False, False)],
        "case_id int, requested string, request_text string, blocking boolean, conflicting boolean, unclear boolean",
    )
    assert {r.case_id: r.mode for r in C.execution_modes(cases, made).collect()} == {1: "market_eval", 2: "hybrid", 3: "deterministic_tree", 4: "hybrid", 5: "hybrid"}
    lines = spark.createDataFrame([(0, "GL", ["X"], ["P"]), (1, "UN", ["X"], ["P"]), (2, None, ["X", "Y"], ["P"]), (3, None, [], ["UN", "P"]), (4, None, None, ["P", "Q"])], "i int, e string, c array<string>, p array<string>")
    assert {r.i: r.l for r in lines.select("i", C.line_of_coverage(F.col("e"), F.col("c"), F.col("p")).alias("l")).collect()} == {0: "GL", 1: "X", 2: None, 3: "P", 4: None}


def test_nodes_out_of_reach_become_roots_in_order(spark):
    make = lambda *rows: {r.id: r.path for r in R.paths(spark.createDataFrame(list(rows), "id string, parent_id string, ord long")).collect()}
    # three nodes below the root come first; an orphan is then number 4, the cycle's first node number 6
    assert make(("r", None, 0), ("a", "r", 1), ("b", "a", 2), ("o", "gone", 3), ("p", "o", 4), ("x", "y", 5), ("y", "x", 6)) == {"r": "1", "a": "1.1", "b": "1.1.1", "o": "4", "p": "4.1", "x": "6", "y": "6.1"}
    # a node that comes before the cycle it hangs from is a root of its own
    assert make(("t", "x", 0), ("x", "y", 1), ("y", "x", 2)) == {"t": "1", "x": "2", "y": "2.2"}  # places count all siblings
    assert {r.id for r in R.ancestors(spark.createDataFrame([("x", "y"), ("y", "x"), ("t", "x")], "id string, parent_id string"), spark.createDataFrame([("t",)], "id string")).collect()} == {"t", "x", "y"}


def test_even_sample_of_one_and_many(spark):
    items = F.array(*map(F.lit, range(10)))
    assert one(spark, O.even_sample(items, 1)) == [0] and one(spark, O.even_sample(items, 3)) == [0, 5, 9] and one(spark, O.even_sample(items, 20)) == list(range(10))


def test_first_of_sources_that_share_an_id_counts(spark):
    items = spark.createDataFrame([(1, "here", 5, None)], "item_id int, quote string, source_id int, cited string")
    sources = spark.createDataFrame([(5, "is here", 0), (5, "nothing", 1)], "id int, body string, pos int")
    assert E.quoted_issues(items, sources).count() == 0
    assert E.quoted_issues(items, sources.withColumn("pos", -F.col("pos"))).count() == 1


def test_precedence_needs_both_values(spark):
    df = spark.createDataFrame([("k", 1, "a", None), ("k", 2, None, "5"), ("k", 3, " a ", ""), ("k", 4, "b", None)], "k string, r int, v string, d string")
    assert [r.r for r in E.precedence_conflicts(df, ["k"], [F.col("r")], "v", "d").collect()] == [4]


def test_a_percent_sign_needs_a_word_after_it(spark):
    assert not one(spark, T.states_claim(F.lit("rate is 5% of it"))) and one(spark, T.states_claim(F.lit("rate is 5%x"))) and one(spark, T.states_claim(F.lit("5 percent")))


def test_boilerplate_rules(spark):
    c = lambda t, unit=None: one(spark, S.clean(F.lit(t), F.lit(unit)))
    assert c("Column 1: AB-CD 12 34 | Page 1 of 2") is None and c("Specimen policy — for testing only") is None and c("THIS IS A CLAIMS-MADE AND REPORTED POLICY. PLEASE READ IT CAREFULLY.") is None
    assert c("short | Page 1 of 9", "table_row") is None and c("short | Page 1 of 9", "text") == "short |"
    assert c("Limit AB-CD 12 34 | Page 3 of 9 applies") == "Limit applies" and c("  a \n b ") == "a b" and c(" ") is None


def test_runs_keep_ids_pages_units_and_titles(spark):
    rows = [("d", 1, 1, "Coverage for", "s1", "text", None), ("d", 2, 1, "damage", "s2", "text", None), ("d", 3, 1, "to all", "s3", "text", "title"), ("d", 4, 1, "and more", "s4", "table_row", None)]
    df = spark.createDataFrame(rows, "doc string, pos int, page int, text string, id string, unit string, element string").withColumn("stop", F.col("page") + F.col("pos"))
    got = S.merge_runs(df, "doc", "pos", "page", "text", key="id", unit="unit", element="element", stop="stop").orderBy("run").collect()
    assert [(r.ids, r.text, r.page_end) for r in got] == [(["s1", "s2"], "Coverage for damage", 3), (["s3"], "to all", 4), (["s4"], "and more", 5)]


def test_overlaps_at_edges_of_buckets(spark):
    df = spark.createDataFrame([("k", 1, 9, "a"), ("k", 9, 30, "b"), ("k", 31, 31, "c"), ("j", 1, 99, "d")], "k string, a int, b int, n string")
    got = sorted((r.n, r.r_n) for r in O.overlaps(df, df, "k", "a", "b", 10).collect())
    assert got == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "c"), ("d", "d")]


def test_intervals_within_bounds_with_reasons(spark):
    df = spark.createDataFrame([("d", -3, 2, ["x"], "r1"), ("d", 3, 4, ["y", "x"], "r2"), ("d", 8, 20, [], "r1")], "d string, a int, b int, ids array<string>, why string")
    got = O.coalesce_intervals(df, "d", "a", "b", bounds=spark.createDataFrame([("d", 1, 9)], "d string, low int, high int"), lists=("ids",), texts=("why",)).orderBy("start").collect()
    assert [(r.start, r.stop, r.ids, r.why) for r in got] == [(1, 4, ["x", "y"], "r1; r2"), (8, 9, [], "r1")]


def test_conflicting_sources_compare_signatures(spark):
    rows = [(1, "limit $1,000 and 5%", "cov", None, None), (1, "5% of 1000... $1,000", "cov", None, None), (2, "$5", "cov", "F1", None), (2, "$6", "cov", "F1", None), (2, "$7", "cov", "F2", None), (3, "no numbers", None, None, "L"), (3, "$1", None, None, "L")]
    df = spark.createDataFrame(rows, "case_id int, text string, field_path string, form_number string, label string")
    got = {(r.case_id, r.key): r.n_signatures for r in E.conflicting_sources(df, "case_id").collect()}
    assert got.get((2, "cov:f1")) == 2 and (3, "l") not in got and (2, "cov:f2") not in got


def test_rows_of_equal_place_are_always_the_same(spark):
    df = spark.createDataFrame([(1, "a", x) for x in "pqrst"], "pos int, k string, v string")
    assert len({S.first_wins(df.repartition(n), ["k"], "pos").first().v for n in (1, 2, 5)}) == 1


def test_store_replaces_by_id(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    make = lambda *rows: spark.createDataFrame(list(rows), "id string, document_id string, text string")
    store.create("spans", make(("1", "a", "x"), ("2", "b", "y")))
    store.upsert("spans", make(("1", "zzz", "moved"), ("5", "q", "p"), ("5", "q", "r")))
    rows = sorted(tuple(r) for r in store.read("spans").collect())
    assert [r[:2] for r in rows] == [("1", "zzz"), ("2", "b"), ("5", "q")] and store.get("spans", "1").first().text == "moved"
    store.delete_document("spans", "b")
    store.delete_document("spans", "nothing")
    assert sorted(r.id for r in store.read("spans").collect()) == ["1", "5"]
    store.append("spans", make(("9", "b", "n")))
    for bad in (make(("9", "c", "n")), make(("7", "c", "n"), ("7", "d", "n"))):
        try:
            store.append("spans", bad)
            raise AssertionError("an id twice")
        except ValueError:
            pass
    store.create("chunks", make(("k", "D", "t"), ("l", "E", "t")))
    docs = spark.createDataFrame([("D", "body")], "id string, body string")
    store.save_document(docs)
    assert store.read("chunks").count() == 2
    store.save_document(docs.withColumn("body", F.lit("new")), cascade=True)
    assert [r.body for r in store.get("documents", "D").collect()] == ["new"] and [r.id for r in store.read("chunks").collect()] == ["l"]
    assert store.save_section(make(("s", "D", "t"))) and not store.save_section(spark.createDataFrame([("s",)], "id string"))
    store.delete_source("zzz")
    assert sorted(r.id for r in store.read("spans").collect()) == ["5", "9"] and store.by_document("spans", "none").count() == 0


def test_store_keeps_rows_without_a_document_and_columns_of_an_empty_table(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=1)
    rows = spark.createDataFrame([("1", "d1", "x"), ("2", None, "y"), ("3", "d2", "z")], "id string, document_id string, text string")
    store.create("spans", rows)
    store.delete_document("spans", "d1")
    assert sorted((r.id, r.document_id) for r in store.read("spans").collect()) == [("2", None), ("3", "d2")]
    store.upsert("spans", spark.createDataFrame([("2", "d3", "moved")], rows.schema))
    store.delete_documents("spans", spark.createDataFrame([("d2",), ("d3",), (None,), ("d2",)], "document_id string"))
    assert store.read("spans").count() == 0 and store.read("spans").columns == ["id", "document_id", "text"] and store.by_document("spans", "d1").count() == 0
    store.upsert("spans", rows)
    assert store.read("spans").count() == 3
    plan = store.by_document("spans", "d2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_store_embeds_what_it_writes(spark, tmp_path):
    import time

    def embed(text):
        if text == "slow":
            time.sleep(3)
        return [float(len(text)), 1.0] if text != "bad" else [1.0, "no number"]

    from citeloom.sources.embed import embedded

    rows = spark.createDataFrame([("1", "a", "xyz"), ("2", "a", "bad"), ("3", "b", None), ("4", "b", "")], "id string, document_id string, text string")
    store = Store(spark, str(tmp_path), buckets=2, embed=embed)
    assert store.create("spans", rows) == {"rows": 4, "failed": 2}
    assert {r.id: r.embedding for r in store.read("spans").collect()} == {"1": [3.0, 1.0], "2": None, "3": None, "4": [0.0, 1.0]}
    assert store.upsert("spans", spark.createDataFrame([("2", "a", "fine")], rows.schema)) == {"rows": 1, "failed": 0}
    assert store.append("spans", spark.createDataFrame([("9", "c", "12345")], rows.schema)) == {"rows": 1, "failed": 0}
    assert {r.id: r.embedding for r in store.read("spans").collect()}["2"] == [4.0, 1.0] and store.get("spans", "9").first().embedding == [5.0, 1.0]
    slow = spark.createDataFrame([(str(i), "a", "slow" if i == 2 else "x") for i in range(9)], rows.schema).coalesce(1)
    got = {r.id: r.embedding for r in embedded(slow, embed, seconds=0.5).collect()}
    assert got.pop("2") is None and set(map(tuple, got.values())) == {(1.0, 1.0)}


def plain_paths(nodes):
    """Numbers of one document's nodes(id, parent, ord), in order: children of roots, then what no root reaches."""
    under = {}
    for n in sorted(nodes, key=lambda n: (n[2], n[0])):
        under.setdefault(n[1], []).append(n)
    out = {}

    def visit(node, path):
        if node[0] not in out:
            out[node[0]] = path
            for i, child in enumerate(under.get(node[0], [])):
                visit(child, f"{path}.{i + 1}")

    for i, root in enumerate(under.get(None, [])):
        visit(root, str(i + 1))
    for n in sorted(nodes, key=lambda n: (n[2], n[0])):
        if n[0] not in out:
            visit(n, str(len(out) + 1))
    return out


def test_paths_of_orphans_and_cycles_are_numbered_within_a_document(spark):
    import random

    rng = random.Random(1)
    docs = {"A": [("a1", None, 1), ("a2", "a1", 1), ("a3", "a1", 2), ("a4", "gone", 1)], "B": [("b1", None, 1), ("b2", "none", 1), ("b3", "b2", 1)], "C": [("c1", "c2", 1), ("c2", "c1", 2), ("c3", "c2", 1)], None: [("n1", "x", 1), ("n2", None, 2)]}
    for d in "DEF":
        docs[d] = [(f"{d}{i}", rng.choice([None, "lost", *[f"{d}{j}" for j in range(12)]]), rng.randrange(3)) for i in range(12)]
    rows = [(i, p, o, d) for d, nodes in docs.items() for i, p, o in nodes]
    df = spark.createDataFrame(rows, "id string, parent_id string, ord long, document_id string")
    got = {r.id: r.path for r in R.paths(df, by="document_id").collect()}
    assert got == {k: v for nodes in docs.values() for k, v in plain_paths(nodes).items()} and got["a4"] == "4" and got["b3"] == "2.1"


def test_names_of_queries_are_their_own():
    from citeloom.plans.queries import QUERIES, query

    def claim_detector(spark, sf):
        return None

    before = dict(QUERIES)
    try:
        query(None)(claim_detector)
        raise AssertionError("a name twice")
    except ValueError:
        assert QUERIES == before and {"profile_lines", "profile_line_sources"} <= set(QUERIES)


#: Codes of an extraction's review and how grave each is.
CODES = {"record_missing_source_span": "blocking", "definitions_mapped_but_empty": "warning", "covered_reasons_mapped_but_empty": "warning", "endorsement_missing_form_number": "blocking", "endorsement_form_missing_from_inventory": "warning", "generic_form_row_as_coverage": "blocking", "deductible_row_as_coverage_limit": "blocking", "coverage_missing_page_number": "warning", "coverage_missing_section_ref": "warning", "coverage_missing_original_content": "warning", "coverage_form_missing_from_inventory": "warning", "coverage_precedence_conflict": "warning", "exclusion_missing_page_number": "warning", "exclusion_toc_artifact": "blocking", "condition_missing_page_number": "warning", "condition_toc_artifact": "blocking", "definition_missing_content": "warning", "definition_missing_page_number": "warning", "covered_reason_missing_content": "warning", "covered_reason_missing_page_number": "warning", "section_short_fragment": "warning"}


def test_extraction_review_codes(spark):
    from citeloom.operators import review

    schema = "doc_id string, seq int, kind string, name string, form_number string, page int, section string, original string, limit string, deductible string, n_spans int, page_end int, type string"
    rows = [
        ("d", 1, "coverages", "Auto Coverage Form", "F1", None, " ", None, "1", None, 0, None, None), ("d", 2, "coverages", "Wind deductible", "F2", 1, "Declarations", "wind deductible 5", "5", None, 1, None, None),
        ("d", 3, "coverages", "Fire", "F2", 1, "Coverage Form", "limit 5", "5", None, 1, None, None), ("d", 4, "coverages", "FIRE", "f2", 2, "Schedule", "limit 6", "6", None, 1, None, None), ("d", 5, "endorsements", "E", " ", 1, None, "x", None, None, 1, None, None),
        ("d", 6, "endorsements", "E", "F9", 1, None, "x", None, None, 1, None, None), ("d", 7, "exclusions", "X", None, None, None, "Exclusions .....12", None, None, 1, None, None), ("d", 8, "conditions", "X", None, None, None, "1. Of Cancelling ...3", None, None, 1, None, None),
        ("d", 9, "sections", "S", None, 3, None, "short", None, None, 1, 3, "definition"), ("d", 10, "sections", "S", None, 3, None, "short", None, None, 1, 4, "covered_reason"), ("e", 1, "definitions", "T", None, None, None, " ", None, None, 1, None, None),
        ("e", 2, "coveredReasons", "T", None, None, None, None, None, None, 1, None, None), ("e", 3, "definitions", " ", None, 1, None, "", None, None, 0, None, None), ("e", 4, "definitions", "1. Of ...3", None, 1, None, "Terms .....12", None, None, 1, None, None), ("f", 1, "sections", "S", None, 3, None, "long " * 40, None, None, 1, None, None),
    ]
    records = spark.createDataFrame(rows, schema)
    mapped = spark.createDataFrame([("d", "definitions"), ("f", "definitions"), ("f", "coveredReasons"), ("f", "exclusions")], "doc_id string, kind string")
    forms = spark.createDataFrame([("d", " F2 ")], "doc_id string, form_number string")
    got = [(r.doc_id, r.seq, r.code) for r in review.extraction_review(records, mapped, forms).collect()]
    found = review.extraction_review(records, mapped, forms).select("code", "severity").distinct().collect()
    assert {r.code: r.severity for r in found} == CODES and len(found) == len(CODES)
    assert sorted(got, key=str) == sorted([("d", 1, c) for c in ("record_missing_source_span", "generic_form_row_as_coverage", "coverage_missing_page_number", "coverage_missing_section_ref", "coverage_missing_original_content", "coverage_form_missing_from_inventory")]
        + [("d", 2, "deductible_row_as_coverage_limit"), ("d", 3, "coverage_precedence_conflict"), ("d", 4, "coverage_form_missing_from_inventory"), ("d", 5, "endorsement_missing_form_number"), ("d", 6, "endorsement_form_missing_from_inventory"), ("d", 7, "exclusion_missing_page_number"), ("d", 7, "exclusion_toc_artifact"), ("d", 8, "condition_missing_page_number"), ("d", 8, "condition_toc_artifact"), ("d", 9, "section_short_fragment")]
        + [("e", 1, "definition_missing_content"), ("e", 1, "definition_missing_page_number"), ("e", 2, "covered_reason_missing_content"), ("e", 2, "covered_reason_missing_page_number"), ("e", 3, "definition_missing_content")]
        + [("f", None, "definitions_mapped_but_empty"), ("f", None, "covered_reasons_mapped_but_empty")], key=str)
    assert review.extraction_review(records, sources=False).where("code = 'record_missing_source_span'").count() == 0
    assert {r.doc_id: r.status for r in review.status(review.extraction_review(records, mapped), records, "doc_id").collect()} == {"d": "failed", "e": "warning", "f": "warning"}


def test_documents_by_json(spark):
    from citeloom.sources.store import list_templates, search_documents

    df = spark.createDataFrame([("policy", '{"carrier":"Acme Co","insuredName":"Bo","policyNumber":"7"}', "open", "Tea"), ("quote", '{"carrier":"X","quoteNumber":"9"}', "done", "Coffee")], "kind string, body string, status string, title string")
    assert search_documents(df, kind="policy", carrier="acme", holder="b", number="7", json="body").count() == 1
    assert search_documents(df, quote="9", json="body").first().kind == "quote" and search_documents(df).count() == 2
    assert list_templates(df, status="open", title="te").count() == 1


def test_recovered_coverages_are_merged_in_order(spark):
    from citeloom.operators import recovery as V

    t = lambda label, value: ("limit", label, value, None)
    c = lambda seq, rec, name, form, first, limit, *terms: ("d", seq, rec, name, None, form, None, None, first, first, limit, None, list(terms))
    rows = [c(0, False, "Wind & Hail", "F1", 1, None, t("A", "1")), c(0, True, "wind and hail", None, 2, "5", t("a", "1"), t("A", "2"), t("B", "1")), c(1, True, "Flood", None, 9, None, t("A", "1")), c(2, True, "FLOOD", None, 10, "7", t("A", "3")), c(3, True, "Flood", None, 40, None)]
    got = [(r.name, r.limit, r.n_terms, r.n_found, r.conflicts) for r in V.merge_recovered(spark.createDataFrame(rows, V.FACT)).orderBy("seq").collect()]
    assert got == [("Wind & Hail", "5", 3, 2, 1), ("Flood", "7", 2, 2, 1), ("Flood", None, 0, 0, 0)]


def test_nested_endorsements_collapse(spark):
    from citeloom.operators import sourcetree as ST

    rows = [("r", None, "document", None, 0), ("a", "r", "endorsement", "e1", 1), ("p", "a", "page", None, 2), ("b", "p", "endorsement", "e1", 3), ("c", "b", "endorsement", "e1", 4), ("x", "c", "text", None, 5), ("o", "a", "endorsement", "e2", 6)]
    df = spark.createDataFrame([(*r, [f"s{r[0]}"], r[4] + 1, r[4] + 1) for r in rows], "id string, parent_id string, kind string, key string, ord int, source_span_ids array<string>, page_start int, page_end int")
    got = {r.id: r for r in ST.collapse_nested(df).collect()}
    assert set(got) == {"r", "a", "p", "x", "o"} and got["x"].parent_id == "a" and got["a"].source_span_ids == ["sa", "sb", "sc"] and got["a"].page_end == 5


def test_groups_of_runs_and_continuations(spark):
    from citeloom.operators import sourcetree as ST

    rows = [("r", None, "document", 0), ("p1", "r", "page", 1), ("p2", "r", "page", 2), ("p3", "r", "page", 3), ("p4", "r", "page", 4)]
    df = spark.createDataFrame([("d", *r, [r[0]], r[3], r[3]) for r in rows], "document_id string, id string, parent_id string, kind string, ord int, source_span_ids array<string>, page_start int, page_end int")
    run = ST.first_run(df, F.col("id") == "p2", F.col("id") == "p4")
    out = {r.id: r for r in ST.group_run(run, "form", "Policy Form").collect()}
    new = next(r for r in out.values() if r.kind == "form")
    assert new.parent_id == "r" and out["p2"].parent_id == out["p3"].parent_id == new.id and out["p4"].parent_id == "r" and new.source_span_ids == ["p2", "p3"] and (new.page_start, new.page_end) == (2, 3)
    kids = spark.createDataFrame([("g", "r", "page_group", 1.0, "endorsements", False), ("e", "g", "endorsement", 2.0, None, True), ("c", "g", "page", 3.0, None, False), ("b", "g", "page", 1.5, None, False)], "id string, parent_id string, kind string, ord double, role string, starts boolean")
    assert {r.id: r.parent_id for r in ST.nest_continuations(kids).collect()} == {"g": "r", "e": "g", "c": "e", "b": "g"}
    roots = spark.createDataFrame([("r", None, "document", 0.0, None, 1), ("e", "r", "page_group", 1.0, "endorsements", 1), ("x", "r", "page", 2.0, None, 2), ("n", "r", "page_group", 3.0, "notices", 9), ("d", "r", "form", 4.0, "declarations", 9)], "id string, parent_id string, kind string, ord double, role string, page_start int")
    assert [r.id for r in ST.root_order(roots).where("id <> 'r'").orderBy("ord").collect()] == ["n", "d", "x", "e"]


def test_endorsement_cues(spark):
    from citeloom.operators import sourcetree as ST

    s = lambda *x: [one(spark, f(*(F.lit(v) for v in x))) for f in (ST.endorsement_start, ST.endorsement_continues)]
    assert s("Page 1", "ENDORSEMENT NO. 4 changes", "") == [True, False] and s("Page 2", "all other terms and conditions", "") == [False, True] and s("Page 3", "plain", "") == [False, False]
    assert one(spark, ST.endorsement_number(F.lit("see XY-END 0012 here"))) == "12" and one(spark, ST.organizer_title(F.lit("Endorsement no. 7 Wind"), F.lit("endorsement"))) == "Endorsement No. 7"
