"""Recovery of coverage: pages and regions to look at, evidence in batches, candidates held against what they cite, and their merge into a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import source as S
from .ordered import even_sample
from .spans import pack

#: Pages looked at together, pages of a region, characters of a batch and beside each entry, of an entry; kinds that give context and how many.
PAGES, REGION, BATCH, BESIDE, ENTRY = 32, 4, 42_000, 260, 1400
CONTEXT, MOST_CONTEXT = ("page_group", "form", "endorsement", "section", "schedule", "table"), 12
REFUSED = r"declined|excluded|not covered|not selected|optional\s*[-:]?\s*no"
PRICES = r"premium|tax|fee|surcharge|assessment|rating basis|exposure|insured value"


def document_pages(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """document_id, page: every page in a span's range, and those where nodes(document_id, page_start, page_end) begin or end."""
    a, z = S.page_start(spans, True), F.coalesce(S.page_end(spans, True), S.page_start(spans, True))
    ranged = spans.where((a > 0) & (z >= a)).select("document_id", F.explode(F.sequence(a, z)).alias("page"))
    ends = nodes.select("document_id", F.explode(F.array("page_start", "page_end")).alias("page")).where("page > 0")
    return ranged.unionByName(ends).distinct()


def page_layout(spans: DataFrame) -> DataFrame:
    """document_id, page, tables, rows, cells, units (how many spans of each unit)."""
    rows = spans.withColumns({"page": F.explode(F.sequence(S.page_start(spans, True), S.page_end(spans, True))), "_u": F.coalesce(S.has(spans, "source_unit"), S.meta(spans, "sourceUnit"), F.lit("unknown")), "_t": S.table_of(spans)})
    units = rows.groupBy("document_id", "page", "_u").agg(F.count("*").alias("n"), F.collect_set("_t").alias("t"))  # a page's tables
    out = units.groupBy("document_id", "page").agg(F.size(F.array_distinct(F.flatten(F.collect_list("t")))).alias("tables"), F.coalesce(F.sum(F.when(F.col("_u") == "table_row", F.col("n"))), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("_u") == "table_cell", F.col("n"))), F.lit(0)).alias("cells"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("_u", "n")))).alias("units"))
    return out


def page_sketch(spans: DataFrame, nodes: DataFrame, most_nodes: int = 20, most_texts: int = 18) -> DataFrame:
    """page_layout() with forms (of its spans, each once, in their order), structure (id, kind, title, path and first six spans of nodes on the page) and samples (span id, unit, table and the first 280 characters of texts), of both an even sample. For the pages that have spans."""
    a, z = S.page_start(spans, True), F.coalesce(S.page_end(spans, True), S.page_start(spans, True))
    on = spans.where((a > 0) & (z >= a)).withColumns({"page": F.explode(F.sequence(a, z)), "_c": F.coalesce(S.has(spans, "char_start", "long"), F.lit(S.LATE)), "_text": T.normalize_ws(F.col("text")), "_unit": S.unit(spans), "_table": S.table_of(spans), "_form": S.has(spans, "form_number")})
    row = F.struct("_c", "id", "_form", "_unit", "_table", F.substring("_text", 1, 280).alias("text"))
    held = on.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(row)).alias("l"))  # a page's spans
    forms = F.array_distinct(F.filter(F.transform("l", lambda x: x["_form"]), lambda f: F.trim(f) != ""))
    texts = F.transform(F.filter("l", lambda x: x["text"] != ""), lambda x: F.struct(x["id"].alias("span_id"), x["_unit"].alias("unit"), x["_table"].alias("table"), x["text"].alias("text")))
    held = held.select(F.col("document_id").alias("_d"), F.col("page").alias("_p"), forms.alias("forms"), texts.alias("texts"))
    first, last = F.col("page_start"), F.coalesce("page_end", "page_start")
    some = nodes.where((F.col("kind") != "document") & (first > 0) & (last >= first)).withColumn("page", F.explode(F.sequence(first, last)))
    node = F.struct("ord", "id", "kind", "title", "path", F.slice("source_span_ids", 1, 6).alias("source_span_ids"))
    tree = some.groupBy(F.col("document_id").alias("_e"), F.col("page").alias("_n")).agg(F.array_sort(F.collect_list(node)).alias("s"))  # a page's nodes
    rows = page_layout(spans).join(held, F.col("document_id").eqNullSafe(F.col("_d")) & (F.col("page") == F.col("_p"))).join(tree, F.col("document_id").eqNullSafe(F.col("_e")) & (F.col("page") == F.col("_n")), "left")
    structure = F.transform("s", lambda x: x.dropFields("ord"))
    return rows.select("document_id", "page", "tables", "rows", "cells", "units", "forms", even_sample(structure, most_nodes).alias("structure"), even_sample(F.col("texts"), most_texts).alias("samples"))


def page_batches(pages: DataFrame, size: int = PAGES) -> DataFrame:
    """document_id, page, batch: pages in order, `size` together."""
    return pages.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("document_id").orderBy("page")) - 1) / size))


def split_regions(regions: DataFrame, size: int = REGION) -> DataFrame:
    """Regions(document_id, start, stop) cut into pieces of `size` pages at most."""
    rows = regions.withColumn("_p", F.explode(F.sequence("start", "stop", F.lit(size))))
    return rows.withColumns({"stop": F.least("stop", F.col("_p") + size - 1), "start": F.col("_p")}).drop("_p")


def region_evidence(regions: DataFrame, spans: DataFrame) -> DataFrame:
    """region_id, seq, part, span_id, text: a region's spans in order, in pieces of 1,400 characters."""
    a, z = S.page_start(spans, True), S.page_end(spans, True)
    rows = spans.select(F.col("document_id").alias("_d"), F.col("id").alias("span_id"), F.coalesce(a, z).alias("_a"), F.coalesce(z, a).alias("_z"), S.has(spans, "char_start", "long").alias("_c"), T.normalize_ws(F.col("text")).alias("_t")).where("_t <> ''")
    # ranges meet in the first stretch of REGION pages that both touch, so a document's rows are spread over its pages
    low, high = (lambda x, y: F.floor(F.least(x, y) / REGION)), (lambda x, y: F.floor(F.greatest(x, y) / REGION))
    rows = rows.withColumns({"_s": low("_a", "_z"), "_b": F.explode(F.sequence(low("_a", "_z"), high("_a", "_z")))})
    held = regions.withColumns({"_rs": low("start", "stop"), "_rb": F.explode(F.sequence(low("start", "stop"), high("start", "stop")))})
    on = (F.col("document_id") == F.col("_d")) & (F.col("_rb") == F.col("_b")) & (F.col("_b") == F.greatest("_s", "_rs")) & (F.col("_a") <= F.col("stop")) & (F.col("_z") >= F.col("start"))
    found = held.join(rows, on)
    seq = F.row_number().over(Window.partitionBy("region_id").orderBy("_a", F.coalesce(F.col("_c"), F.lit(S.LATE)), "span_id"))
    found = found.withColumn("seq", seq).withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.length("_t") / ENTRY).cast("int") - 1)))
    return found.select("region_id", "seq", "part", "span_id", F.substr("_t", F.col("part") * ENTRY + 1, F.lit(ENTRY)).alias("text"))


def evidence_batches(entries: DataFrame, most: int = BATCH, beside: int = BESIDE) -> DataFrame:
    """entries with batch: as many in order as fit `most` characters, each with `beside` more."""
    rows = entries.withColumns({"_k": F.row_number().over(Window.partitionBy("region_id").orderBy("seq", "part")), "_n": F.length("text")})
    places = pack(rows, "region_id", "_k", "_n", most, 0, beside).select(F.col("region_id").alias("_r"), F.col("pos").alias("_p"), F.col("chunk").alias("batch"))
    return rows.join(places, (F.col("region_id") == F.col("_r")) & (F.col("_k") == F.col("_p"))).drop("_k", "_n", "_r", "_p")


def batched_evidence(regions: DataFrame, spans: DataFrame, most: int = BATCH, beside: int = BESIDE) -> DataFrame:
    """evidence_batches() of region_evidence(): region_id, seq, part, span_id, text, batch. Regions of the same pages of a document have the same evidence: it is put in order and in batches once for all of them."""
    named = regions.select("region_id", F.struct("document_id", "start", "stop").alias("_place"))
    places = named.select(F.col("_place").alias("region_id")).distinct().select("region_id", "region_id.*")
    rows = evidence_batches(region_evidence(places, spans), most, beside).withColumnRenamed("region_id", "_at")
    return named.join(rows, F.col("_place") == F.col("_at")).select("region_id", "seq", "part", "span_id", "text", "batch")


def prior_context(regions: DataFrame, nodes: DataFrame) -> DataFrame:
    """region_id, node_id, place: of the structural nodes that begin at or before a region, the newest twelve. Nodes are first reduced to the newest twelve of each of a document's pages, so a region meets twelve a page at most."""
    some = nodes.where(F.col("kind").isin(*CONTEXT)).select("document_id", F.col("id").alias("node_id"), F.coalesce("page_start", F.lit(0)).alias("_p"), "ord")
    newest = Window.partitionBy("document_id", "_p").orderBy(F.desc("ord"), "node_id")
    some = some.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= MOST_CONTEXT).drop("_k")
    rows = regions.join(some.withColumnRenamed("document_id", "_d"), (F.col("document_id") == F.col("_d")) & (F.col("_p") <= F.col("start")))
    place = F.row_number().over(Window.partitionBy("region_id").orderBy(F.desc("_p"), F.desc("ord"), "node_id"))
    return rows.withColumn("place", place).where(F.col("place") <= MOST_CONTEXT).select("region_id", "node_id", "place")


def header_spans(regions: DataFrame, spans: DataFrame) -> DataFrame:
    """region_id, span_id of table heads on the region's first page and the two before it."""
    head = F.coalesce(S.has(spans, "is_header", "boolean"), F.lit(False)) | (F.coalesce(S.has(spans, "column_name"), F.lit("")) != "") | S.meta(spans, "isHeader").eqNullSafe("true")
    rows = spans.where(head).select(F.col("document_id").alias("_d"), F.col("id").alias("span_id"), S.page_start(spans, True).alias("_p"))
    return regions.join(rows, (F.col("document_id") == F.col("_d")) & F.col("_p").between(F.greatest(F.lit(1), F.col("start") - 2), F.col("start"))).select("region_id", "span_id")


def validate_candidates(facts: DataFrame, nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """facts(fact_id, document_id, values, node_ids, span_ids) with known_nodes, known_spans and valid: some id is known, and the known spans' texts hold every number and identifier of the values."""
    of = lambda df, ids, known, extra: facts.select("fact_id", F.col("document_id").alias("_fd"), F.posexplode(F.array_distinct(ids)).alias("_i", "_id")).join(df.select(F.col("document_id").alias("_d"), F.col("id").alias("_k"), *extra), (F.col("_fd") == F.col("_d")) & (F.col("_id") == F.col("_k"))).groupBy(F.col("fact_id").alias(f"_{known}")).agg(F.sort_array(F.collect_list(F.struct("_i", "_id", *(["text"] if extra else [])))).alias(known))
    n, s = of(nodes, "node_ids", "n", []), of(spans, "span_ids", "s", ["text"])
    rows = facts.join(n, F.col("fact_id") == F.col("_n"), "left").join(s, F.col("fact_id") == F.col("_s"), "left")
    ids = lambda c: F.coalesce(F.transform(c, lambda x: x["_id"]), F.array().cast("array<string>"))
    text = F.coalesce(F.array_join(F.transform("s", lambda x: x["text"]), " "), F.lit(""))
    held = T.let(text, lambda t: F.forall("values", lambda v: T.grounded(v, t)))
    rows = rows.withColumns({"known_nodes": ids("n"), "known_spans": ids("s"), "_held": F.coalesce(held, F.lit(True))})
    return rows.withColumn("valid", ((F.size("known_nodes") > 0) | (F.size("known_spans") > 0)) & F.col("_held")).drop("_n", "_s", "n", "s", "_held")


def rejected(validated: DataFrame) -> DataFrame:
    """document_id, n: how many facts their citations don't hold."""
    return validated.groupBy("document_id").agg(F.count_if(~F.col("valid")).alias("n"))


def no_coverage(name: Column, has_terms: Column) -> Column:
    """Rows that aren't active coverage: refused ones, and prices without a limit or deductible."""
    return name.rlike(rf"(?i){T.B}(?:{REFUSED}){T.B}") | (name.rlike(rf"(?i){T.B}(?:{PRICES}){T.B}") & ~has_terms)


def label(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def term_identity(kind: Column, name: Column, value: Column, applies: Column) -> Column:
    return F.concat_ws("|", kind, label(name), label(value), label(applies))


def span_pages(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """fact_id, first, last page of the spans that facts(fact_id, span_ids) cite."""
    rows = facts.select("fact_id", F.explode("span_ids").alias("_id")).join(spans.select(F.col("id").alias("_s"), S.page_start(spans, True).alias("_a"), S.page_end(spans, True).alias("_z")), F.col("_id") == F.col("_s"))
    return rows.groupBy("fact_id").agg(F.least(F.min("_a"), F.min("_z")).alias("first"), F.greatest(F.max("_a"), F.max("_z")).alias("last"))


def same_scope(p: str, r: str) -> Column:
    """Whether coverages of equal label are of one scope: lines, forms and sections don't differ where both are named, endorsements are named in both or neither and don't differ, and pages are at most one apart. p, r: prefixes of the columns line, form, section, endorsement, first, last."""
    said = lambda x, c: label(F.col(f"{x}{c}"))
    line = F.coalesce(F.col(f"{p}line") == F.col(f"{r}line"), F.lit(True))
    agree = lambda c: (said(p, c) == "") | (said(r, c) == "") | (said(p, c) == said(r, c))
    both = (said(p, "endorsement") == "") == (said(r, "endorsement") == "")
    near = F.coalesce((F.col(f"{p}first") <= F.col(f"{r}last") + 1) & (F.col(f"{r}first") <= F.col(f"{p}last") + 1), F.lit(True))
    return line & agree("form") & agree("section") & agree("endorsement") & both & near


def match_scope(primary: DataFrame, found: DataFrame) -> DataFrame:
    """found(document_id, seq, name, ..) with match: seq of the first of primary, in order, of the same name and scope. Rows of equal name and scope match the same, so scopes are held against each other, not rows."""
    scope = {"document_id": F.col("document_id"), "key": label(F.col("name")), "line": F.col("line"), **{c: label(F.col(c)) for c in ("form", "section", "endorsement")}, "first": F.col("first"), "last": F.col("last")}
    of = lambda x: [v.alias(f"{x}{c}") for c, v in scope.items()]
    p = primary.groupBy(*of("p_")).agg(F.min("seq").alias("_seq"))
    rows = found.select(*of("r_")).distinct().join(p, (F.col("r_document_id") == F.col("p_document_id")) & (F.col("r_key") == F.col("p_key")) & same_scope("p_", "r_"))
    first = rows.groupBy(*(f"r_{c}" for c in scope)).agg(F.min("_seq").alias("match"))
    on = [v.eqNullSafe(F.col(f"r_{c}")) for c, v in scope.items()]
    return found.join(first, on, "left").drop(*(f"r_{c}" for c in scope))


#: A coverage of a profile as the merge takes it; a term's value conflicts with another of its kind, label and scope.
FACT = "document_id string, seq int, recovered boolean, name string, line string, form string, section string, endorsement string, first int, last int, limit string, deductible string, terms array<struct<kind:string,label:string,value:string,applies:string>>"


_TERM = "struct<kind string, label string, value string, applies string, scope string, said string>"
_HELD = f"struct<at struct<recovered boolean, seq int>, name string, line string, form string, section string, endorsement string, first int, last int, limit string, deductible string, terms array<{_TERM}>, n_found int, conflicts int, form_said string, section_said string>"
_FILLED = ("limit", "deductible", "form", "section", "endorsement")


def _of_one_scope(a: Column, b: Column) -> Column:
    """same_scope() of two coverages of equal name and endorsement that are held as structs, with labels as they were made. What is cheap is asked first."""
    agree = lambda c: (a[c] == "") | (b[c] == "") | (a[c] == b[c])
    line = (F.coalesce(a["line"], F.lit("")) == "") | (F.coalesce(b["line"], F.lit("")) == "") | (a["line"] == b["line"])
    near = F.coalesce((a["first"] <= b["last"] + 1) & (b["first"] <= a["last"] + 1), F.lit(True))
    return near & agree("form_said") & agree("section_said") & line


def _joined(held: Column, new: Column) -> Column:
    """A coverage with a recovered one merged in: what it lacks is filled, terms it doesn't have come after its own, and those that conflict are counted."""
    def add(s: Column, t: Column) -> Column:
        near = F.filter(s["terms"], lambda x: x["scope"] == t["scope"])
        known = F.exists(near, lambda x: x["said"] == t["said"])
        more = F.struct(F.concat(s["terms"], F.array(t)).alias("terms"), (s["found"] + 1).alias("found"), (s["conflicts"] + F.when(F.size(near) > 0, 1).otherwise(0)).alias("conflicts"))
        return F.when(known, s).otherwise(more)

    start = F.struct(held["terms"].alias("terms"), F.lit(0).alias("found"), F.lit(0).alias("conflicts"))
    terms = T.let(F.aggregate(new["terms"], start, add), lambda s: F.struct(s["terms"].alias("terms"), (held["n_found"] + s["found"]).alias("n_found"), (held["conflicts"] + s["conflicts"]).alias("conflicts")))
    own = {"at": held["at"], "name": held["name"], "line": held["line"], **{c: F.coalesce(held[c], new[c]) for c in _FILLED}, "first": F.least(held["first"], new["first"]), "last": F.greatest(held["last"], new["last"])}
    told = [F.when(held[c].isNull(), new[f"{c}_said"]).otherwise(held[f"{c}_said"]).alias(f"{c}_said") for c in ("form", "section")]
    order = [x.split(" ")[0] for x in ("at", "name", "line", "form", "section", "endorsement", "first", "last", "limit", "deductible")]
    return T.let(terms, lambda t: F.struct(*(own[c].alias(c) for c in order), *(t[c].alias(c) for c in ("terms", "n_found", "conflicts")), *told)).cast(_HELD)


def merge_recovered(facts: DataFrame) -> DataFrame:
    """Coverages of each document (FACT) with recovered ones merged in, in order: each goes to the first of the same scope, also to one added before it, else is added. Empty values are filled, new terms appended; terms that conflict are kept and counted. A coverage spans the pages of all that went into it.

    An ordered fold over the recovered facts of one document, name and endorsement, for only these can be of one scope: an
    aggregate over a sorted array whose state is the coverages held so far, which begins with those there were. Labels are made once.
    """
    terms = F.transform(F.coalesce("terms", F.array().cast("array<struct<kind:string,label:string,value:string,applies:string>>")), lambda t: F.struct(t["kind"].alias("kind"), t["label"].alias("label"), t["value"].alias("value"), t["applies"].alias("applies"), F.concat_ws("|", F.coalesce(t["kind"], F.lit("")), label(t["label"]), label(t["applies"])).alias("scope"), label(t["value"]).alias("said")))
    fact = F.struct(F.struct("recovered", "seq").alias("at"), "name", "line", "form", "section", "endorsement", "first", "last", "limit", "deductible", terms.alias("terms"), F.when(F.col("recovered"), F.size(terms)).otherwise(0).alias("n_found"), F.lit(0).alias("conflicts"), label(F.col("form")).alias("form_said"), label(F.col("section")).alias("section_said")).cast(_HELD)
    rows = facts.select("document_id", label(F.col("name")).alias("key"), label(F.col("endorsement")).alias("backed"), fact.alias("f"))
    rows = rows.groupBy("document_id", "key", "backed").agg(F.array_sort(F.collect_list("f")).alias("l"))

    def step(state: Column, r: Column) -> Column:
        first = lambda held: F.array_position(F.transform(held, lambda x: _of_one_scope(x, r)), True).cast("int")
        # the first ones span the more pages the more went into them, so most places are among them: all are asked only if none of these is one
        place = T.let(first(F.slice(state, 1, 16)), lambda p: F.when(p > 0, p).otherwise(first(state)))
        put = lambda p: F.concat(F.slice(state, 1, p - 1), F.array(T.let(F.element_at(state, p), lambda x: _joined(x, r))), F.slice(state, p + 1, F.size(state)))
        return T.let(place, lambda p: F.when(p == 0, F.concat(state, F.array(r))).otherwise(put(p)))

    again = lambda x: F.coalesce(x["at"]["recovered"], F.lit(False))
    held = rows.select("document_id", F.explode(F.aggregate(F.filter("l", again), F.filter("l", lambda x: ~again(x)), step)).alias("c")).select("document_id", "c.*")
    place = (F.row_number().over(Window.partitionBy("document_id").orderBy("at.recovered", "at.seq", "name")) - 1).alias("seq")
    return held.select("document_id", place, "name", "line", "form", "section", "endorsement", "limit", "deductible", F.size("terms").alias("n_terms"), "n_found", "conflicts", F.transform("terms", lambda t: F.struct(*(t[c].alias(c) for c in ("kind", "label", "value", "applies")))).alias("terms"), "first", "last")


def append_unique(rows: DataFrame, more: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """rows, all of them, and of more, in the order of pos, the first of each key that rows doesn't have."""
    new = more.join(rows.select(*keys).distinct(), keys, "left_anti")
    w = Window.partitionBy(*keys).orderBy(pos)
    return rows.unionByName(new.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k"))
