"""What a source tree's pages are: notices, declarations, the policy form, endorsements, and sections that run over pages.

nodes are those of sourcetree.build(): id, document_id, parent_id, kind, title, description, text_excerpt, source_span_ids, page_start,
page_end, ord, marked. Siblings stand in the order of (ord, id). Every pass is a few windows over siblings; passes that build
on each other are written in between (cut), so that a plan stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import cut
from . import source as S
from . import sourcetree as ST
from . import trees

B = T.B

#: Fixed patterns, all regardless of case.
PAGE_HEADINGS = [
    r"IMPORTANT NOTICE\s+[—-]\s+HOW TO REPORT A CLAIM",
    r"PRIVACY NOTICE TO POLICYHOLDERS",
    r"OFAC ADVISORY NOTICE",
    r"TERRORISM RISK INSURANCE ACT\s*\(TRIA\)\s*DISCLOSURE AND REJECTION",
    r"DECLARATIONS PAGE",
    r"TECHNOLOGY ERRORS?\s*&\s*OMISSIONS AND CYBER LIABILITY INSURANCE POLICY",
    r"TRADE OR ECONOMIC SANCTIONS LIMITATION",
    r"FORMS? AND ENDORSEMENTS",
]
SCHEDULE_ITEM = rf"{B}item\s+\d+\.?\s*(?:named insured|policy number|policy period|renewal|form of business|coverage parts?|limits?|premium|extended reporting|producer|forms? and endorsements?){B}"
SCHEDULE_TEXT = rf"{SCHEDULE_ITEM}|{B}forms? and endorsements attached at inception{B}|{B}coverage parts?,?\s+limits? of liability,?\s+deductibles?,?\s+and retroactive dates{B}|{B}annual premium\s*\(all coverage parts?\)|{B}erp option{B}|{B}producer{B}[\s\S]{{0,240}}{B}license{B}"
NOTICE = rf"{B}(?:specimen policy|policy jacket|important notice|privacy notice|ofac advisory|terrorism risk insurance act|tria|trade or economic sanctions|economic sanctions limitation|signature|countersignature|how to report a claim){B}"
NO_DECLARATION = rf"{B}(?:important notice|privacy notice|ofac advisory|terrorism risk insurance act|how to report a claim){B}"
DECLARATION_WORDS = rf"{B}(?:item\s+\d+\.|coverage part|limits?,?\s+sub-limits?|each claim limit|aggregate limit|retroactive date|self-insured retention|premium|payment plan|producer|broker|forms? and endorsements?|attached at inception|extended reporting period|discovery period){B}"
DECLARATION_LINKS = rf"{B}(?:these declarations|policy form|[A-Z]{{2,}}-END\s+\d{{3}}|endorsement\s+(?:no\.?|number|#)?\s*\d+){B}"
FORM_SECTION = rf"{B}section\s+[IVX0-9]+\s*[—-]\s*(?:insuring agreements?|definitions?|exclusions?|conditions?){B}|{B}form\s+[A-Z]{{2,}}-[A-Z0-9-]+\s+\d{{2}}\s+\d{{2}}{B}"
FORM_WORDS = rf"{B}(?:insuring agreement|definitions?|exclusions?|conditions?|claim means|insured means|wrongful act means|limits of liability|notice of claim|cancellation by|action against the company){B}"
NO_HEADING = r"^page\s+\d+\z|^table\s+\d+\z|^(?:document|text|header row|row\s+\d+)\z|^(?:northwoods continental insurance company|specimen policy|for testing only)\z|^technology errors?\s*&\s*omissions and cyber liability insurance policy\z"
HEADING = rf"^(?:SECTION|PART|ARTICLE|SCHEDULE){B}|^Item\s+\d+[.:]|^Coverage\s+Part{B}|^Endorsement\s+(?:No\.?|Number|#)\s+"
SENTENCE = rf"{B}(?:is|are|was|were|will|shall|may|must|means|includes|provided|subject|available|attached|remain|constitutes){B}"
SCHEDULE_TITLE = rf"^schedule{B}|{B}(?:forms? and endorsements?|coverage parts?|limits?|premium|declarations?){B}"


def _has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def _any(*flags: Column) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def marks(nodes: DataFrame) -> DataFrame:
    """nodes with text and what they look like: administrative, declares, declares_on, forms, forms_on, endorses."""
    title, excerpt = T.normalize_ws(F.coalesce("title", F.lit(""))), T.normalize_ws(F.coalesce("text_excerpt", F.lit("")))
    rows = nodes.withColumn("text", T.normalize_ws(F.concat_ws(" ", "title", "description", "text_excerpt")))
    text = F.col("text")
    rows = rows.withColumn("administrative", ~_has(text, SCHEDULE_TEXT) & _has(text, NOTICE))
    declares = ~_has(text, NO_DECLARATION) & _any(_has(title, r"^declarations?\z"), _has(text, rf"{B}declarations?\s+(?:page|schedule|section){B}"), _has(excerpt, rf"^declarations?{B}"))
    rows = rows.withColumn("declares", declares)
    read = _has(text, rf"{B}technology errors?\s*&?\s*omissions{B}") & _has(text, rf"{B}please read this entire policy carefully{B}")
    forms = ~F.col("administrative") & ~F.col("declares") & _any(_has(title, rf"{B}policy form{B}"), _has(excerpt, rf"^policy\s+form{B}"), read, _has(text, FORM_SECTION))
    rows = rows.withColumn("forms", forms)
    endorses = F.coalesce(ST.endorsement_start(F.coalesce("title", F.lit("")), F.col("text_excerpt"), F.col("description")), F.lit(False))
    return rows.withColumns({"declares_on": F.col("declares") | _has(text, DECLARATION_WORDS) | _has(text, DECLARATION_LINKS), "forms_on": F.col("forms") | _has(text, FORM_WORDS), "endorses": endorses})


def endorsement_title(text: Column) -> Column:
    """'Endorsement No. n' by the number that a text gives with 'no.', or by an END code."""
    said = F.regexp_extract(text, rf"(?i){B}endorsement\s+(?:no\.?|number|#)\s*([A-Z0-9][A-Z0-9.-]*){B}", 1)
    coded = F.regexp_extract(text, rf"(?i){B}(?:[A-Z]{{2,}}-)?END\s+0*([0-9]{{1,4}}){B}", 1)
    number = F.try_element_at(F.filter(F.array(said, coded), lambda x: x != ""), F.lit(1))
    return F.concat(F.lit("Endorsement No. "), F.upper(number))


def page_range(pages: Column) -> Column:
    """'page 3' or 'pages 1-3, 5' of an array of pages; null if there are none."""
    p = F.array_sort(F.array_distinct(F.filter(pages, lambda x: x.isNotNull())))

    def said(p: Column) -> Column:
        first = F.filter(p, lambda x, i: (i == 0) | (F.try_element_at(p, i) != x - 1))
        last = F.filter(p, lambda x, i: F.coalesce(F.try_element_at(p, i + 2) != x + 1, F.lit(True)))
        runs = F.transform(F.arrays_zip(first.alias("a"), last.alias("z")), lambda r: F.when(r["a"] == r["z"], r["a"].cast("string")).otherwise(F.concat_ws("-", r["a"], r["z"])))
        return F.when(F.size(p) == 1, F.concat(F.lit("page "), F.element_at(p, 1))).when(F.size(p) > 1, F.concat(F.lit("pages "), F.array_join(runs, ", ")))

    return T.let(p, said)


def _pages_of() -> Column:
    return F.when(F.col("page_start").isNotNull(), F.sequence(F.col("page_start"), F.greatest("page_start", F.coalesce("page_end", "page_start"))))


def with_pages(description: Column, pages: Column) -> Column:
    """A description, followed by its pages unless it names them."""
    said = page_range(pages)
    return T.let(F.struct(description.alias("d"), said.alias("p")), lambda x: F.when(x["p"].isNull() | F.contains(F.lower(x["d"]), x["p"]), x["d"]).otherwise(F.concat_ws("; ", x["d"], x["p"])))


def named_pages(nodes: DataFrame) -> DataFrame:
    """Pages without a title of their own take that of a known heading in their text; pages that begin something take its kind or title."""
    text = T.normalize_ws(F.concat_ws(" ", "text_excerpt", "description"))
    top = F.regexp_replace(text, r"(?i)^page\s+\d+\s*(?:\|\s*page\s*\|\s*page\s+\d+\s*\|?)?", "").substr(1, 700)
    found = lambda t: F.try_element_at(F.filter(F.array(*(F.regexp_extract(t, f"(?i){B}{p}" + (B if p[-1].isalpha() or p.endswith("?") else ""), 0) for p in PAGE_HEADINGS)), lambda x: x != ""), F.lit(1))
    bare = (F.col("kind") == "page") & F.col("title").rlike(r"(?i)^page\s+\d+\z")
    rows = nodes.withColumn("title", F.when(bare, T.let(T.let(top, found), lambda t: F.coalesce(ST.organizer_title(t, F.lit("page")), F.col("title")))).otherwise(F.col("title")))
    m = marks(rows)
    page, name = F.col("kind") == "page", endorsement_title(F.col("text"))
    starts = page & F.col("endorses") & name.isNotNull()
    titled = F.when(starts, name).when(page & F.col("declares"), "Declarations").when(page & F.col("forms"), "Policy Form")
    said = F.when(starts, F.concat_ws(" | ", name, F.lit("endorsement"), F.when(F.col("page_start") > 0, F.concat(F.lit("page "), F.col("page_start"))))).otherwise(T.normalize_ws(F.concat_ws(" ", "description", titled)))
    changed = m.withColumns({"title": F.coalesce(titled, "title"), "description": F.when(titled.isNotNull(), said).otherwise(F.col("description")), "kind": F.when(starts, "endorsement").otherwise(F.col("kind"))})
    return changed.select(*nodes.columns)


def _under_root(nodes: DataFrame) -> DataFrame:
    """The root's children with their place (from 1)."""
    roots = nodes.where("kind = 'document'").select(F.col("id").alias("_r"))
    rows = nodes.where("kind <> 'document'").join(roots, F.col("parent_id") == F.col("_r")).drop("_r")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("parent_id").orderBy("ord", "id")))


def _moved(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """moves(id, into): what gets another parent stands just behind its old place."""
    to = moves.select(F.col("id").alias("_m"), F.col("into").alias("_into"))
    rows = nodes.join(to, F.col("id") == F.col("_m"), "left")
    here = F.col("_m").isNotNull()
    return rows.withColumns({"parent_id": F.when(here, F.col("_into")).otherwise(F.col("parent_id")), "ord": F.when(here, F.col("ord") + 0.001).otherwise(F.col("ord")).cast("double")}).select(*nodes.columns)


def page_groups(nodes: DataFrame) -> DataFrame:
    """Of the root's children: those before the declarations (else before the first that begins a part) are notices; declarations and the policy form run from
    their first page until one that doesn't go on. A run whose first is a group already goes under that one; what two runs claim is the later one's."""
    nodes = cut(nodes.withColumn("ord", F.col("ord").cast("double")))
    rows = cut(marks(_under_root(nodes)))
    every = Window.partitionBy("parent_id")
    first = lambda c: F.min(F.when(c, F.col("k"))).over(every)
    d, f, e, k = F.col("declares"), F.col("forms"), F.col("endorses"), F.col("k")
    rows = rows.withColumns({"_d": first(d), "_f": first(f), "_c": first(d | f | e)})
    form_stop = ((k > F.col("_f")) & e) | F.col("administrative") | d | (~((k > F.col("_f")) & (F.col("kind") == "page")) & ~F.col("forms_on"))
    rows = rows.withColumns({"_dz": first((k >= F.col("_d")) & (((k > F.col("_d")) & (f | e)) | ~F.col("declares_on"))), "_fz": first((k >= F.col("_f")) & form_stop)})
    in_run = lambda a, z: (k >= F.col(a)) & (F.col(z).isNull() | (k < F.col(z)))
    run = lambda c, name: F.when(c, F.lit(name))
    runs = F.array_compact(F.array(run(k < F.coalesce("_d", "_c"), "notices"), run(in_run("_d", "_dz"), "declarations"), run(in_run("_f", "_fz"), "form")))
    old = F.when((k == F.col("_d")) & (F.col("kind") == "page_group") & (F.col("title") == "Declarations"), "declarations").when((k == F.col("_f")) & F.col("kind").isin("form", "page_group") & (F.col("title") == "Policy Form"), "form")
    rows = cut(rows.withColumns({"_runs": runs, "_old": old}).select(*nodes.columns, "k", "_runs", "_old").withColumn("run", F.explode("_runs")))
    kind = F.when(F.col("run") == "form", "form").otherwise("page_group")
    title = F.when(F.col("run") == "notices", "Notices and Jacket").when(F.col("run") == "form", "Policy Form").otherwise("Declarations")
    said = F.when(F.col("run") == "notices", "Policy jacket, notices, and administrative pages grouped by source order").when(F.col("run") == "form", "Policy form pages grouped by source order").otherwise("Declarations pages and schedules grouped by source order")
    kids = F.sort_array(F.collect_list(F.struct("k", "id", F.coalesce(F.nullif("text_excerpt", F.lit("")), "description").alias("t"), "source_span_ids", _pages_of().alias("p"))))
    made = rows.groupBy("document_id", "parent_id", "run").agg(kids.alias("l"), F.max(F.when(F.col("_old") == F.col("run"), F.col("id"))).alias("old"), F.min("page_start").alias("page_start"), F.max(F.coalesce("page_end", "page_start")).alias("page_end"), F.min("ord").alias("ord"))
    made = made.withColumns({"kind": kind, "title": title})
    ids = F.transform("l", lambda x: x["id"])
    pages = F.flatten(F.filter(F.transform("l", lambda x: x["p"]), lambda p: p.isNotNull()))
    made = cut(made.withColumns({"id": F.coalesce("old", ST.group_id(F.col("document_id").cast("string"), F.col("kind"), F.col("title"), ids)), "description": with_pages(said, pages)}))
    text = F.substring(F.array_join(F.filter(F.transform("l", lambda x: x["t"]), lambda t: t != ""), "\n\n"), 1, 1600)
    spans = F.array_distinct(F.flatten(F.transform("l", lambda x: x["source_span_ids"])))
    new = made.where("old IS NULL").withColumns({"text_excerpt": text, "source_span_ids": spans})
    rank = F.when(F.col("run") == "form", 2).when(F.col("run") == "declarations", 1).otherwise(0)
    to = rows.select("id", "parent_id", "run").join(made.select(F.col("parent_id").alias("_p"), F.col("run").alias("_run"), F.col("id").alias("into")), (F.col("parent_id") == F.col("_p")) & (F.col("run") == F.col("_run"))).where("id <> into")
    moves = to.groupBy("id").agg(F.max_by("into", rank).alias("into"))
    return _moved(nodes, moves).unionByName(new.select(*(c for c in nodes.columns if c in new.columns)), allowMissingColumns=True)


def _is_endorsement_group() -> Column:
    return (F.col("kind") == "page_group") & F.col("title").rlike(rf"(?i)^endorsements?{B}")


def _is_notices() -> Column:
    return (F.col("kind") == "page_group") & F.col("title").rlike(r"(?i)^notices?\s+and\s+jacket\z")


def endorsement_groups(nodes: DataFrame) -> DataFrame:
    """Nodes that begin an endorsement become one, endorsements that don't become pages; the root's endorsements, with pages after the first that go on, go under one group."""
    nodes = nodes.withColumn("ord", F.col("ord").cast("double"))
    group = _is_endorsement_group()
    m = marks(nodes)
    free = (F.col("kind") != "document") & ~group
    name = F.when(free & F.col("endorses"), endorsement_title(F.col("text")))
    fallen = free & name.isNull() & (F.col("kind") == "endorsement")
    page = F.when(F.col("page_start") > 0, F.concat(F.lit("Page "), F.col("page_start"))).otherwise(T.normalize_ws("title"))
    said = F.concat_ws(" | ", name, F.lit("endorsement"), F.when(F.col("page_start") > 0, F.concat(F.lit("page "), F.col("page_start"))))
    changed = {"title": F.when(group, "Endorsements").when(fallen, page).otherwise(F.coalesce(name, "title")), "description": F.when(name.isNotNull(), said).otherwise(F.col("description")), "kind": F.when(fallen, "page").when(name.isNotNull(), "endorsement").otherwise(F.col("kind"))}
    nodes = cut(m.withColumns(changed).select(*nodes.columns))
    rows = _under_root(nodes).withColumn("_g", _is_endorsement_group())
    every = Window.partitionBy("parent_id")
    own = (F.col("kind") == "endorsement") & ~F.col("_g")
    rows = rows.withColumns({"_first": F.min(F.when(own, F.col("k"))).over(every), "_old": F.max_by(F.when(F.col("_g"), F.col("id")), F.when(F.col("_g"), F.col("k"))).over(every)})
    goes_on = ST.endorsement_continues(F.coalesce("title", F.lit("")), F.col("text_excerpt"), F.col("description"))
    kids = cut(rows.where(own | ((F.col("kind") == "page") & (F.col("k") > F.col("_first")) & goes_on)))
    l = F.sort_array(F.collect_list(F.struct("k", "source_span_ids", _pages_of().alias("p"))))
    made = kids.groupBy("document_id", "parent_id").agg(l.alias("l"), F.max("_old").alias("old"), F.min("page_start").alias("page_start"), F.max(F.coalesce("page_end", "page_start")).alias("page_end"), F.min(F.when(F.col("kind") == "endorsement", F.col("ord"))).alias("ord"))
    new_id = F.concat_ws(":", T.id_part(F.col("document_id").cast("string")), F.lit("source_node:page_group:endorsements"), T.id_part("parent_id").substr(1, 48))
    spans = F.array_distinct(F.flatten(F.transform("l", lambda x: x["source_span_ids"])))
    pages = F.flatten(F.filter(F.transform("l", lambda x: x["p"]), lambda p: p.isNotNull()))
    made = cut(made.withColumns({"id": F.coalesce("old", new_id), "kind": F.lit("page_group"), "title": F.lit("Endorsements"), "source_span_ids": spans, "description": with_pages(F.lit("Endorsement forms grouped by source order"), pages)}))
    moved = _moved(nodes, kids.join(made.select(F.col("parent_id").alias("_p"), F.col("id").alias("into")), F.col("parent_id") == F.col("_p")).select("id", "into"))
    grown = made.where("old IS NOT NULL").select(F.col("id").alias("_i"), F.col("page_start").alias("_a"), F.col("page_end").alias("_z"), F.col("ord").alias("_o"), F.col("source_span_ids").alias("_s"))
    moved = moved.join(grown, F.col("id") == F.col("_i"), "left")
    moved = moved.withColumns({"page_start": F.least("page_start", "_a"), "page_end": F.greatest("page_end", "_z"), "ord": F.coalesce("_o", "ord"), "source_span_ids": F.when(F.col("_i").isNotNull() & (F.size("source_span_ids") == 0), F.col("_s")).otherwise(F.col("source_span_ids"))}).select(*nodes.columns)
    new = made.where("old IS NULL")
    return moved.unionByName(new.select(*(c for c in nodes.columns if c in new.columns)), allowMissingColumns=True)


def outermost(gone: DataFrame) -> DataFrame:
    """gone(_g, _outer): what goes, and into what; with what that goes into at last. By pointer doubling: after k rounds a row has skipped 2**k of them."""
    now = cut(gone)
    for _ in range(32):
        onward = now.select(F.col("_g").alias("_n"), F.col("_outer").alias("_far"))
        rows = now.join(onward, F.col("_outer") == F.col("_n"), "left")
        if rows.where("_far IS NOT NULL").isEmpty():
            return now
        now = cut(rows.select("_g", F.coalesce("_far", "_outer").alias("_outer")))
    raise ValueError("forms within each other go round")


def plain_forms(nodes: DataFrame) -> DataFrame:
    """Declarations within a policy form go up beside it; the first policy form within one goes, and its children become the outer one's. Of forms within each other, however deep, the outermost takes all."""
    forms = nodes.where("kind = 'form' AND title = 'Policy Form'").select(F.col("id").alias("_f"), F.col("parent_id").alias("_up"))
    rows = nodes.join(forms, F.col("parent_id") == F.col("_f"), "left")
    inner = F.col("_f").isNotNull() & F.col("kind").isin("form", "page_group") & (F.col("title") == "Policy Form")
    rows = cut(rows.withColumn("_n", F.when(inner, F.row_number().over(Window.partitionBy("_f", inner).orderBy("ord", "id")))))
    gone = rows.where("_n = 1").select(F.col("id").alias("_g"), F.col("_f").alias("_outer"))
    gone = outermost(gone)
    up = F.col("_f").isNotNull() & (F.col("kind") == "page_group") & (F.col("title") == "Declarations")
    rows = rows.where("_n IS NULL OR _n > 1").withColumn("parent_id", F.when(up, F.col("_up")).otherwise(F.col("parent_id")))
    rows = rows.join(gone, F.col("parent_id") == F.col("_g"), "left")
    return rows.withColumn("parent_id", F.coalesce("_outer", "parent_id")).select(*nodes.columns)


def merge_notices(nodes: DataFrame) -> DataFrame:
    """Administrative pages among the root's children go under its first group of notices."""
    rows = cut(marks(_under_root(nodes)))
    first = rows.where(_is_notices()).groupBy(F.col("parent_id").alias("_p")).agg(F.min_by("id", "k").alias("into"))
    to = rows.where("kind = 'page' AND administrative").join(first, F.col("parent_id") == F.col("_p")).select(F.col("id").alias("_i"), "into")
    return nodes.join(to, F.col("id") == F.col("_i"), "left").withColumn("parent_id", F.coalesce("into", "parent_id")).select(*nodes.columns)


def section_heading(text: Column, container_title: Column, container_kind: Column) -> Column:
    """The title of a section if a title heads one: of a numbered form, or mostly in capitals and no sentence; null otherwise."""
    own = (text.rlike(r"(?i)^declarations(?:\s+page)?\z") & container_title.rlike(r"(?i)^declarations\z")) | (text.rlike(r"(?i)^policy\s+form\z") & container_title.rlike(r"(?i)^policy\s+form\z")) | (text.rlike(r"(?i)^endorsement\s+(?:no\.?|number|#)") & (container_kind == "endorsement"))
    reject = (text == "") | (F.length(text) > 160) | _has(text, NO_HEADING) | F.coalesce(own, F.lit(False)) | (_has(text, rf"{B}policyholders?{B}") & (F.length(text) < 40)) | (F.size(F.split(text, r"\s+")) > 18)
    upper, lower = F.length(F.regexp_replace(text, "[^A-Z]", "")), F.length(F.regexp_replace(text, "[^a-z]", ""))
    loud = (upper > 0) & (upper >= lower * 1.5) & ~text.rlike(r"[.;:]\s+\S|[.;:]\z") & ~(_has(text, SENTENCE) & text.rlike("[a-z]"))
    return F.when(~reject & (_has(text, HEADING) | loud), ST.organizer_title(text, F.lit("text")))


def title_sections(nodes: DataFrame, most_depth: int = 64) -> DataFrame:
    """Within a form, group or endorsement, a title on any of its pages heads what follows it, over pages, up to the next; it needs a child or a follower. Of containers within each other the outermost counts."""
    held = nodes.where(F.col("kind").isin("form", "page_group", "endorsement") & ~_is_notices() & ~_is_endorsement_group()).select(F.col("id").alias("_c"))
    up = cut(nodes.select(F.col("id").alias("_id"), F.col("parent_id").alias("_up")).join(held, F.col("_id") == F.col("_c"), "left"))
    level = nodes.where("kind = 'page'").select("id", F.col("parent_id").alias("at"), F.lit(None).cast("string").alias("container"))
    done = None
    for _ in range(most_depth):
        level = cut(level.join(up, F.col("at") == F.col("_id"), "left").select("id", F.col("_up").alias("at"), F.coalesce("_c", "container").alias("container")))
        ended = level.where("at IS NULL AND container IS NOT NULL").select("id", "container")
        done = ended if done is None else done.unionByName(ended)
        level = level.where("at IS NOT NULL")
        if level.isEmpty():
            break
    about = nodes.select(F.col("id").alias("_ci"), F.col("title").alias("_ct"), F.col("kind").alias("_ck"))
    pages = done.withColumnRenamed("id", "_page").join(about, F.col("container") == F.col("_ci"))
    rows = nodes.where("kind NOT IN ('table_row', 'table_cell')").join(pages, F.col("parent_id") == F.col("_page"))
    kids = nodes.where("kind NOT IN ('table_row', 'table_cell')").groupBy(F.col("parent_id").alias("_kp")).agg(F.flatten(F.collect_list(_pages_of())).alias("_kpages"))
    rows = rows.join(kids, F.col("id") == F.col("_kp"), "left")
    text = T.normalize_ws(F.coalesce(F.nullif("title", F.lit("")), "text_excerpt", F.lit("")))
    head = F.when((F.col("kind") == "text") & F.coalesce("marked", F.lit(False)), section_heading(text, F.col("_ct"), F.col("_ck")))
    w = Window.partitionBy("container").orderBy(F.coalesce(F.col("page_start"), F.lit(S.LATE)), "ord", "id")
    rows = rows.withColumn("_head", head)
    next_ = F.lead(F.col("_head").isNull()).over(w)
    rows = rows.withColumn("_head", F.when(F.col("_kp").isNotNull() | F.coalesce(next_, F.lit(False)), F.col("_head")))
    over = F.last(F.when(F.col("_head").isNotNull(), F.col("id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = cut(rows.select(F.col("id").alias("_i"), "_head", "container", over.alias("_over"), "_kpages"))
    x = nodes.join(rows, F.col("id") == F.col("_i"), "left")
    h = F.col("_head")
    pages = F.concat(F.coalesce(_pages_of(), F.array().cast("array<int>")), F.coalesce("_kpages", F.array().cast("array<int>")))
    changed = {
        "parent_id": F.when(h.isNotNull(), F.col("container")).otherwise(F.coalesce("_over", "parent_id")),
        "kind": F.when(h.isNotNull(), F.when(_has(h, SCHEDULE_TITLE), "schedule").otherwise("section")).otherwise(F.col("kind")),
        "title": F.coalesce(h, "title"),
        "description": F.when(h.isNotNull(), with_pages(F.concat(h, F.lit(" section")), pages)).otherwise(F.col("description")),
    }
    return x.withColumns(changed).select(*nodes.columns)


def _roles(nodes: DataFrame) -> DataFrame:
    m = marks(nodes)
    role = F.when(_is_notices(), "notices").when(F.col("title") == "Declarations", "declarations").when(F.col("title") == "Policy Form", "form").when(_is_endorsement_group(), "endorsements").when(F.col("administrative"), "administrative")
    return m.withColumns({"role": role, "starts": F.col("endorses") & endorsement_title(F.col("text")).isNotNull()}).select(*nodes.columns, "role", "starts")


def hierarchy(nodes: DataFrame) -> DataFrame:
    """The passes after grouping, in their order: forms, continuations, notices, sections, evidence twice, the root's order."""
    columns = nodes.columns
    nodes = cut(plain_forms(nodes))
    nodes = cut(ST.nest_continuations(_roles(nodes)).select(*columns))
    nodes = cut(title_sections(merge_notices(nodes)))
    nodes = cut(ST.roll_up(cut(ST.roll_up(nodes))))
    return cut(ST.root_order(_roles(nodes)).select(*columns))


def organized_tree(nodes: DataFrame) -> DataFrame:
    """All passes over a source tree's nodes, with paths."""
    nodes = nodes.drop("path")
    nodes = hierarchy(cut(endorsement_groups(page_groups(named_pages(nodes)))))
    key = F.coalesce(F.lower(endorsement_title(T.normalize_ws(F.concat_ws(" ", "title", "description", "text_excerpt")))), F.nullif(F.lower(T.normalize_ws("title")), F.lit("")))
    nodes = cut(ST.collapse_nested(nodes.withColumn("key", key)).drop("key"))
    return nodes.join(trees.paths(nodes, by="document_id"), "id")
