"""The tree of a document's spans: root, pages, tables, rows, cells and texts, with titles over what follows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import cut
from . import source as S
from . import trees


def node_id(document: Column, kind: Column, parts: Column) -> Column:
    return F.concat_ws(":", T.id_part(document.cast("string")), F.lit("source_node"), kind, T.stable_hash(T.json_string(parts.cast("string"))).substr(1, 12))


def shorten(text: Column, most: int) -> Column:
    """Normalised text, cut at `most` characters with three dots."""
    return T.let(T.normalize_ws(text), lambda t: F.when(F.length(t) > most, F.concat(F.rtrim(t.substr(1, most)), F.lit("..."))).otherwise(t))


def describe(title: Column, kind: Column, page: Column, form: Column, text: Column) -> Column:
    """Title, kind, page, form and the text's first 1,200 characters, those that are there, between bars."""
    said = lambda word, c: F.when(c.isNotNull() & ~c.cast("string").isin("", "0"), F.concat(F.lit(word), c.cast("string")))
    return F.concat_ws(" | ", F.nullif(title, F.lit("")), F.replace(kind, F.lit("_"), F.lit(" ")), said("page ", page), said("form ", form), F.nullif(shorten(text, 1200), F.lit("")))


def node_kind(spans: DataFrame) -> Column:
    """By the span's unit; of section candidates by their words (fixed values)."""
    unit = S.unit(spans)
    element = F.coalesce(S.meta(spans, "elementType"), S.meta(spans, "sourceUnit"), S.has(spans, "source_unit"))
    low = F.lower("text")
    known = F.when(unit.isin("page", "table", "table_row", "table_cell", "section"), unit).when(unit == "key_value", "schedule")
    words = F.when(low.rlike("endorsement"), "endorsement").when(low.rlike("schedule|declarations?"), "schedule").when(low.rlike("clause|condition|exclusion|definition"), "clause").otherwise("section")
    return F.coalesce(known, F.when(element == "section_candidate", words), F.lit("text"))


def is_title(text: Column) -> Column:
    """Whether a span marked as a title heads what follows: short, and of a numbered form or mostly in capitals without being a sentence (fixed patterns)."""
    shape = text.rlike(rf"^(?:SECTION|PART|SCHEDULE|ARTICLE){T.B}|^Section\s+[IVX0-9]+(?:\.[A-Z])?\s*[—:-]|^[A-Z]\.\s|{T.B}[IVX]+\.\s") | text.rlike(r"(?i)^Item\s+\d+[.:]|^Endorsement\s+(?:No\.?|Number|#)\s+")
    upper, lower = F.length(F.regexp_replace(text, "[^A-Z]", "")), F.length(F.regexp_replace(text, "[^a-z]", ""))
    sentence = text.rlike(rf"(?i){T.B}(?:is|are|was|were|will|shall|may|must|means|includes|provided|subject|available|attached|remain|constitutes){T.B}") & text.rlike("[a-z]")
    loud = (upper > 0) & (upper >= lower * 1.6) & ~sentence & ~text.rlike(r"[.;:]\s+\S|[.;:]\z")
    return (text != "") & (F.length(text) <= 140) & (F.size(F.split(text, " ")) <= 14) & (shape | loud)


def build(spans: DataFrame) -> DataFrame:
    """Nodes of every document's tree: id, document_id, parent_id, kind, title, description, text_excerpt, source_span_ids, page_start, page_end, ord, marked (as a title), metadata_unit.

    Spans are taken in tree_order(). A page's node is made at its first span, a table's at its first row or cell; ord
    counts nodes as they are made. A cell stands under its row if that came before it, else under its table.
    """
    rows = spans.withColumns({"page_start": S.page_start(spans), "_end": S.page_end(spans), "kind": node_kind(spans), "_table": S.table_of(spans), "_row": S.row_of(spans), "_marked": (S.meta(spans, "elementType") == "title") | (S.meta(spans, "sourceUnit") == "title"), "_header": S.has(spans, "is_header", "boolean"), "_ri": S.has(spans, "row_index", "int"), "_cn": S.has(spans, "column_name"), "_form": S.has(spans, "form_number"), "_section": S.has(spans, "section_id")})
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("document_id").orderBy(*S.tree_order(spans))))
    in_table, paged = F.col("kind").isin("table_row", "table_cell"), F.coalesce(F.col("page_start") > 0, F.lit(False))
    first = lambda *by: F.row_number().over(Window.partitionBy("document_id", *by).orderBy("k")) == 1
    rows = rows.withColumns({"_np": (paged & first("page_start")).cast("int"), "_it": in_table, "_own": (F.col("kind") != "page").cast("int")})
    rows = rows.withColumn("_nt", (F.col("_it") & (F.col("_table").isNull() | first("_it", "_table"))).cast("int"))
    before = Window.partitionBy("document_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum(F.col("_np") + F.col("_nt") + F.col("_own")).over(before), F.lit(0)) + 1)
    rows = rows.withColumn("_tn", F.sum("_nt").over(Window.partitionBy("document_id").orderBy("k")))
    rows = rows.withColumn("_table", F.when(F.col("_it"), F.coalesce("_table", F.concat_ws(":", "document_id", F.concat(F.lit("p"), F.coalesce(F.col("page_start").cast("string"), F.lit("na"))), F.lit("table"), (F.col("_at") + F.col("_np")).cast("string")))))
    doc = F.col("document_id")
    root, page = node_id(doc, F.lit("document"), doc), F.when(paged, node_id(doc, F.lit("page"), F.col("page_start")))
    table, own = F.when(F.col("_it"), node_id(doc, F.lit("table"), F.col("_table"))), node_id(doc, F.col("kind"), F.col("id"))
    rows = cut(rows.withColumns({"_root": root, "_page": page, "_tid": table, "_nid": own}))  # hashes are taken once

    made = lambda df, **c: df.select(*(c[n].alias(n) for n in ("id", "document_id", "parent_id", "kind", "title", "description", "text_excerpt", "source_span_ids", "page_start", "page_end", "ord", "marked")))
    null, no, doc = F.lit(None).cast("string"), F.lit(False), F.col("document_id")
    l = rows.groupBy("document_id", "_root").agg(F.sort_array(F.collect_list(F.struct("k", "id"))).alias("l"), F.min_by("page_start", F.when(F.col("page_start").isNotNull(), F.col("k"))).alias("a"), F.max_by("_end", F.when(F.col("_end").isNotNull(), F.col("k"))).alias("z"))
    out = made(l, id=F.col("_root"), document_id=doc, parent_id=null, kind=F.lit("document"), title=F.lit("Document"), description=F.lit("Document root for source-native policy hierarchy"), text_excerpt=null, source_span_ids=F.transform(F.slice("l", 1, 200), lambda x: x["id"]), page_start=F.col("a"), page_end=F.col("z"), ord=F.lit(0).cast("long"), marked=no)
    shown = rows.where(S.unit(spans) == "page").groupBy(F.col("_page").alias("_pp")).agg(F.min_by(F.struct("id", "text"), "k").alias("s"))
    p = rows.where("_np = 1").join(shown, F.col("_page") == F.col("_pp"), "left")
    name = F.concat(F.lit("Page "), F.col("page_start"))
    out = out.unionByName(made(p, id=F.col("_page"), document_id=doc, parent_id=F.col("_root"), kind=F.lit("page"), title=name, description=F.when(F.col("s").isNull(), name).otherwise(describe(name, F.lit("page"), F.col("page_start"), null, F.col("s.text"))), text_excerpt=shorten(F.col("s.text"), 1600), source_span_ids=F.when(F.col("s").isNull(), F.array().cast("array<string>")).otherwise(F.array("s.id")), page_start=F.col("page_start"), page_end=F.col("page_start"), ord=F.col("_at"), marked=no))
    t = rows.where("_nt = 1")
    out = out.unionByName(made(t, id=F.col("_tid"), document_id=doc, parent_id=F.coalesce("_page", "_root"), kind=F.lit("table"), title=F.concat(F.lit("Table "), F.col("_tn")), description=F.concat(F.lit("Table on page "), F.coalesce(F.col("page_start").cast("string"), F.lit("unknown")), F.lit(" for source rows and cells")), text_excerpt=null, source_span_ids=F.array().cast("array<string>"), page_start=F.col("page_start"), page_end=F.col("_end"), ord=F.col("_at") + F.col("_np"), marked=no))
    held = rows.where("kind = 'table_row'").select(F.col("document_id").alias("_rd"), F.col("id").alias("_rs"), F.col("_nid").alias("_rn"), F.col("k").alias("_rk"))
    x = rows.where("_own = 1").join(held, (F.col("kind") == "table_cell") & (F.col("document_id") == F.col("_rd")) & (F.col("_row") == F.col("_rs")) & (F.col("_rk") < F.col("k")), "left")
    is_row = F.col("kind") == "table_row"
    parent = F.when(is_row, F.col("_tid")).when(F.col("kind") == "table_cell", F.coalesce("_rn", "_tid")).otherwise(F.coalesce("_page", "_root"))
    title = F.when(is_row, F.when(F.col("_header"), "Header row").otherwise(F.concat(F.lit("Row "), F.coalesce("_ri", F.lit(0)) + 1))).otherwise(F.coalesce("_section", "_form", F.when(F.col("kind") == "table_cell", F.col("_cn")), F.initcap(F.replace("kind", F.lit("_"), F.lit(" ")))))
    text = describe(F.when(is_row, F.lit("Table row")).otherwise(F.col("title")), F.col("kind"), F.col("page_start"), F.when(~is_row, F.col("_form")), F.col("text"))
    x = x.withColumn("title", title).withColumn("description", text)
    return out.unionByName(made(x, id=F.col("_nid"), document_id=doc, parent_id=parent, kind=F.col("kind"), title=F.col("title"), description=F.col("description"), text_excerpt=shorten(F.col("text"), 1600), source_span_ids=F.array("id"), page_start=F.col("page_start"), page_end=F.col("_end"), ord=F.col("_at") + F.col("_np") + F.col("_nt"), marked=F.coalesce("_marked", no)))


def title_blocks(nodes: DataFrame) -> DataFrame:
    """On each page what follows a title, up to the next, goes under it, and the title takes its evidence: text, spans and pages. A title that nothing follows stays as it is."""
    text = T.normalize_ws(F.coalesce("text_excerpt", "title"))
    pages = nodes.where("kind = 'page'").select(F.col("id").alias("_pid"))
    rows = nodes.join(pages, F.col("parent_id") == F.col("_pid"), "left")
    inside = F.col("_pid").isNotNull() & ~F.col("kind").isin("table_row", "table_cell")
    rows = rows.withColumn("_title", inside & (F.col("kind") == "text") & F.col("marked") & is_title(text))
    w = Window.partitionBy("_pid").orderBy("ord", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = cut(rows.withColumn("_over", F.when(inside, F.last(F.when(F.col("_title"), F.col("id")), ignorenulls=True).over(w))))
    held = rows.where("_over IS NOT NULL").groupBy(F.col("_over").alias("_o")).agg(F.count("*").alias("_n"), F.sort_array(F.collect_list(F.struct("ord", "id", "text_excerpt", "source_span_ids"))).alias("l"), F.min("page_start").alias("_a"), F.max(F.coalesce("page_end", "page_start")).alias("_z")).where("_n > 1")
    rows = rows.join(held.select("_o", "l", "_a", "_z"), F.col("id") == F.col("_o"), "left")
    whole = F.array_join(F.filter(F.transform("l", lambda x: x["text_excerpt"]), lambda t: t != ""), "\n\n")
    head = F.col("_o").isNotNull()
    name = shorten(F.coalesce("text_excerpt", "title"), 120)
    changed = {
        "parent_id": F.when(F.col("_over").isNotNull() & (F.col("_over") != F.col("id")), F.col("_over")).otherwise(F.col("parent_id")),
        "title": F.when(head, name).otherwise(F.col("title")),
        "description": F.when(head, describe(name, F.lit("text"), F.col("page_start"), F.lit(None).cast("string"), whole)).otherwise(F.col("description")),
        "text_excerpt": F.when(head, F.substring(whole, 1, 1600)).otherwise(F.col("text_excerpt")),
        "source_span_ids": F.when(head, F.array_distinct(F.flatten(F.transform("l", lambda x: x["source_span_ids"])))).otherwise(F.col("source_span_ids")),
        "page_start": F.when(head, F.coalesce("_a", "page_start")).otherwise(F.col("page_start")),
        "page_end": F.when(head, F.coalesce("_z", "page_end")).otherwise(F.col("page_end")),
    }
    return rows.withColumns(changed).select(*nodes.columns)


def source_tree(spans: DataFrame) -> DataFrame:
    """The whole tree with paths."""
    nodes = cut(title_blocks(build(spans)))
    return nodes.join(trees.paths(nodes, by="document_id"), "id")


def roll_up(nodes: DataFrame) -> DataFrame:
    """Containers take their children's evidence, one level: spans, pages, least ord, text. Endorsements, pages, tables, rows, cells and texts keep their own text and spans beside."""
    own = F.col("kind").isin("endorsement", "page", "table", "table_row", "table_cell", "text")
    kids = nodes.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("_p")).agg(F.sort_array(F.collect_list(F.struct("ord", "id", F.coalesce("text_excerpt", "description").alias("t"), "source_span_ids"))).alias("l"), F.min("page_start").alias("_a"), F.max(F.coalesce("page_end", "page_start")).alias("_z"), F.min("ord").alias("_o"))
    rows = nodes.join(kids, F.col("id") == F.col("_p"), "left")
    here = F.col("_p").isNotNull()
    spans = F.flatten(F.transform("l", lambda x: x["source_span_ids"]))
    text = F.nullif(F.substring(F.array_join(F.filter(F.transform("l", lambda x: x["t"]), lambda t: t != ""), "\n\n"), 1, 1600), F.lit(""))
    changed = {
        "source_span_ids": F.when(here, F.array_distinct(F.when(own, F.concat("source_span_ids", spans)).otherwise(spans))).otherwise(F.col("source_span_ids")),
        "page_start": F.when(here, F.coalesce(F.when(own, F.least("page_start", "_a")).otherwise(F.col("_a")), "page_start")).otherwise(F.col("page_start")),
        "page_end": F.when(here, F.coalesce(F.when(own, F.greatest(F.coalesce("page_end", "page_start"), "_z")).otherwise(F.col("_z")), "page_end")).otherwise(F.col("page_end")),
        "ord": F.least("ord", "_o"),
        "text_excerpt": F.when(here & ~own, F.coalesce(text, "text_excerpt")).otherwise(F.col("text_excerpt")),
    }
    return rows.withColumns(changed).select(*nodes.columns)


def root_order(nodes: DataFrame) -> DataFrame:
    """The root's children by what they are (fixed ranks): notices, administrative notices, declarations, policy form, others, endorsements; then page, ord, id. nodes(.., role): notices, administrative, declarations, form, endorsements or null."""
    roots = nodes.where("kind = 'document'").select(F.col("id").alias("_r"))
    rows = nodes.join(roots, F.col("parent_id") == F.col("_r"), "left")
    rank = F.when(F.col("role") == "notices", 0.0).when(F.col("role") == "administrative", 0.5).when(F.col("role") == "declarations", 1.0).when(F.col("role") == "form", 2.0).when(F.col("role") == "endorsements", 3.0).otherwise(2.5)
    place = F.row_number().over(Window.partitionBy("_r").orderBy(rank, F.coalesce(F.col("page_start"), F.lit(S.LATE)), "ord", "id"))
    return rows.withColumn("ord", F.when(F.col("_r").isNotNull(), place).otherwise(F.col("ord")).cast("double")).select(*nodes.columns)


def nest_continuations(nodes: DataFrame) -> DataFrame:
    """Pages that follow an endorsement within a group of endorsements go under it. nodes(.., role, starts): role endorsements marks groups, starts marks endorsements that begin one."""
    groups = nodes.where("role = 'endorsements'").select(F.col("id").alias("_g"))
    rows = nodes.join(groups, F.col("parent_id") == F.col("_g"), "left")
    w = Window.partitionBy("_g").orderBy("ord", "id").rowsBetween(Window.unboundedPreceding, 0)
    now = F.last(F.when((F.col("kind") == "endorsement") & F.col("starts"), F.col("id")), ignorenulls=True).over(w)
    rows = rows.withColumn("_now", F.when(F.col("_g").isNotNull(), now))
    moved = (F.col("kind") == "page") & F.col("_now").isNotNull()
    return rows.withColumn("parent_id", F.when(moved, F.col("_now")).otherwise(F.col("parent_id"))).select(*nodes.columns)


def group_id(document: Column, kind: Column, title: Column, children: Column) -> Column:
    """A group's id, of its title and its children's ids."""
    return F.concat_ws(":", T.id_part(document), F.lit("source_node"), kind, F.lower(T.id_part(title)).substr(1, 48), T.id_part(F.array_join(children, "_")).substr(1, 80))


#: Fixed patterns: what begins or continues an endorsement.
_NUMBER = r"(?:no\.?|number|#)"


def endorsement_number(text: Column) -> Column:
    """The number by which a text names an endorsement, upper case; null without one."""
    said = F.regexp_extract(text, rf"(?i){T.B}endorsement\s+{_NUMBER}?\s*([A-Z0-9][A-Z0-9.-]*){T.B}", 1)
    coded = F.regexp_extract(text, rf"(?i){T.B}(?:[A-Z]{{2,}}-)?END\s+0*([0-9]{{1,4}}){T.B}", 1)
    return F.upper(F.coalesce(F.nullif(said, F.lit("")), F.nullif(coded, F.lit(""))))


def endorsement_start(title: Column, excerpt: Column, description: Column) -> Column:
    body = T.normalize_ws(F.concat_ws(" ", excerpt, description))
    changes = rf"(?i){T.B}this endorsement changes the policy{T.B}"
    headed = rf"(?i)^endorsement\s+{_NUMBER}\s*[A-Z0-9][A-Z0-9.-]*{T.B}"
    told = lambda b: (b.substr(1, 260).rlike(changes) & endorsement_number(b.substr(1, 260)).isNotNull()) | b.substr(1, 260).rlike(rf"(?i)^(?:[A-Z]{{2,}}-)?END\s+0*[0-9]{{1,4}}{T.B}") | b.substr(1, 260).rlike(headed) | (T.normalize_ws(title).rlike(headed) & b.rlike(changes))
    return T.let(body, told)


def endorsement_continues(title: Column, excerpt: Column, description: Column) -> Column:
    text = T.normalize_ws(F.concat_ws(" ", title, description, excerpt))
    on = text.rlike(rf"(?i){T.B}endorsement{T.B}|{T.B}all\s+other\s+terms\s+and\s+conditions{T.B}") | title.rlike(rf"(?i){T.B}continuation{T.B}")
    return ~endorsement_start(title, excerpt, description) & on


def organizer_title(title: Column, kind: Column) -> Column:
    """Titles of groups in their plain form (fixed names)."""
    t = T.normalize_ws(title)
    number = F.regexp_extract(t, rf"(?i)^endorsement\s+{_NUMBER}?\s*([A-Z0-9][A-Z0-9.-]*){T.B}", 1)
    return F.when(t.rlike(rf"(?i)^declarations{T.B}"), "Declarations").when(t.rlike(rf"(?i)^policy\s+form{T.B}"), "Policy Form").when(t.rlike(rf"(?i)^definitions{T.B}"), "Definitions").when((kind == "page_group") & t.rlike(rf"(?i)^endorsements?{T.B}"), "Endorsements").when(number != "", F.concat(F.lit("Endorsement No. "), number)).otherwise(t)


def first_run(nodes: DataFrame, starts: Column, stops: Column) -> DataFrame:
    """Of each parent's children in order, the run from the first that starts to before the next that stops, as column in_run."""
    w = Window.partitionBy("parent_id").orderBy("ord", "id")
    rows = nodes.withColumns({"_k": F.row_number().over(w), "_s": F.coalesce(starts, F.lit(False)), "_e": F.coalesce(stops, F.lit(False))})
    every = Window.partitionBy("parent_id")
    rows = rows.withColumn("_first", F.min(F.when(F.col("_s"), F.col("_k"))).over(every))
    rows = rows.withColumn("_last", F.min(F.when(F.col("_e") & (F.col("_k") > F.col("_first")), F.col("_k"))).over(every))
    inside = (F.col("_k") >= F.col("_first")) & (F.col("_last").isNull() | (F.col("_k") < F.col("_last")))
    return rows.withColumn("in_run", F.coalesce(inside, F.lit(False))).drop("_k", "_s", "_e", "_first", "_last")


def group_run(nodes: DataFrame, kind: str, title: str) -> DataFrame:
    """first_run()'s rows become the children of a new node of their parent, with their pages, spans and least ord."""
    runs = nodes.where("in_run").groupBy("document_id", "parent_id").agg(F.sort_array(F.collect_list(F.struct("ord", "id", "source_span_ids"))).alias("l"), F.min("page_start").alias("page_start"), F.max(F.coalesce("page_end", "page_start")).alias("page_end"), F.min("ord").alias("ord"))
    ids = F.transform("l", lambda x: x["id"])
    new = runs.withColumn("id", group_id(F.col("document_id").cast("string"), F.lit(kind), F.lit(title), ids))
    moved = nodes.join(new.select(F.col("parent_id").alias("_p"), F.col("id").alias("_new")), F.col("in_run") & F.col("parent_id").eqNullSafe(F.col("_p")), "left")
    moved = moved.withColumn("parent_id", F.coalesce("_new", "parent_id")).drop("_p", "_new", "in_run")
    made = new.select("id", "document_id", "parent_id", F.lit(kind).alias("kind"), F.lit(title).alias("title"), F.lit(title).alias("description"), F.lit(None).cast("string").alias("text_excerpt"), F.array_distinct(F.flatten(F.transform("l", lambda x: x["source_span_ids"]))).alias("source_span_ids"), "page_start", "page_end", "ord")
    return moved.unionByName(made, allowMissingColumns=True)


def collapse_nested(nodes: DataFrame, most_depth: int = 64) -> DataFrame:
    """An endorsement below another of the same title goes: its children and its evidence go to the nearest such one. nodes(.., key): the title's key."""
    rows = nodes.where("kind = 'endorsement' AND key IS NOT NULL")
    up = cut(nodes.select(F.col("id").alias("_id"), F.col("parent_id").alias("_up"), F.when(F.col("kind") == "endorsement", F.col("key")).alias("_key")))
    level = rows.select("id", "key", F.col("parent_id").alias("at"))
    found = None
    for _ in range(most_depth):
        level = cut(level.join(up, F.col("at") == F.col("_id")).select("id", "key", "at", "_up", F.coalesce(F.col("_key") == F.col("key"), F.lit(False)).alias("hit")))
        if level.isEmpty():
            break
        hits = level.where("hit").select("id", F.col("at").alias("into"))
        found = hits if found is None else found.unionByName(hits)
        level = level.where("NOT hit AND _up IS NOT NULL").select("id", "key", F.col("_up").alias("at"))
    if found is None:
        return nodes
    found = cut(found)
    # what goes may go into one that goes itself: the nearest that stays takes it
    for _ in range(most_depth):
        next_ = found.select(F.col("id").alias("_i"), F.col("into").alias("_n"))
        again = cut(found.join(next_, F.col("into") == F.col("_i"), "left").select("id", F.coalesce("_n", "into").alias("into"), F.col("_n").isNotNull().alias("more")))
        found = again.drop("more")
        if again.where("more").isEmpty():
            break
    gone = found.select(F.col("id").alias("_g"), F.col("into").alias("_into"))
    taken = nodes.join(gone, F.col("id") == F.col("_g")).groupBy(F.col("_into").alias("_t")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id", "source_span_ids"))), lambda x: x["source_span_ids"])).alias("_more"), F.min("page_start").alias("_a"), F.max(F.coalesce("page_end", "page_start")).alias("_z"))
    stay = nodes.join(gone.select("_g"), F.col("id") == F.col("_g"), "left_anti").join(gone.select(F.col("_g").alias("_old"), F.col("_into").alias("_new")), F.col("parent_id") == F.col("_old"), "left").join(taken, F.col("id") == F.col("_t"), "left")
    changed = {"parent_id": F.coalesce("_new", "parent_id"), "source_span_ids": F.when(F.col("_t").isNotNull(), F.array_distinct(F.concat("source_span_ids", "_more"))).otherwise(F.col("source_span_ids")), "page_start": F.least("page_start", "_a"), "page_end": F.greatest("page_end", "_z")}
    return stay.withColumns(changed).select(*nodes.columns)
