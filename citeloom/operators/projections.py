"""Small forms of nodes, coverages, sections and profiles, as prompts and later steps take them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut

MOST_IDS, MOST_SPANS, MOST_TEXT = 12, 8, 700
#: Characters of a node's text in the cleanup's packet, by kind.
CLEANUP_TEXT = {"page": 260, "page_group": 260, "table_row": 520, "table_cell": 520}
CLEANUP_OTHER = 360


def compact_ids(ids: Column, most: int = MOST_IDS) -> Column:
    return F.slice(F.array_distinct(F.coalesce(ids, F.array().cast("array<string>"))), 1, most)


def compact_nodes(nodes: DataFrame, cleanup: bool = False) -> DataFrame:
    """id, kind, title, path, page_start, page_end, source_span_ids (first 8), text (excerpt, else description; cut)."""
    most = F.lit(MOST_TEXT)
    if cleanup:
        sizes = F.create_map(*(F.lit(x) for kv in CLEANUP_TEXT.items() for x in kv))
        most = F.coalesce(F.try_element_at(sizes, F.col("kind")), F.lit(CLEANUP_OTHER))
    text = F.substring(F.coalesce("text_excerpt", "description"), F.lit(1), most)
    return nodes.select("id", "kind", "title", "path", "page_start", "page_end", F.slice("source_span_ids", 1, MOST_SPANS).alias("source_span_ids"), text.alias("text"))


def outline(nodes: DataFrame) -> DataFrame:
    """A tree's nodes but its root as rows of an outline: parent_id is null for the first level, place counts siblings from 1."""
    roots = nodes.where("kind = 'document'").select(F.col("id").alias("_r"))
    rows = nodes.where("kind <> 'document'").join(roots, F.col("parent_id") == F.col("_r"), "left")
    place = F.row_number().over(Window.partitionBy("document_id", "parent_id").orderBy("ord", "id"))
    hash_ = F.nullif(F.array_join("source_span_ids", ":"), F.lit(""))
    return rows.select("document_id", "id", F.when(F.col("_r").isNull(), F.col("parent_id")).alias("parent_id"), place.alias("place"), "title", F.col("kind").alias("type"), F.col("kind").alias("label"), "page_start", "page_end", F.col("text_excerpt").alias("excerpt"), "source_span_ids", hash_.alias("source_text_hash"))


def nested_outline(nodes: DataFrame, most_depth: int = 64) -> DataFrame:
    """document_id, outline: the tree of outline() as one JSON text, a list of nodes with their children; what a node doesn't have is left out of it.

    Folded from the deepest level up: a level's nodes take their children's texts by one join and are written, so that
    no task holds more than one node's own outline. Nodes that no root reaches aren't in it.
    """
    rows = cut(outline(nodes))
    own = F.struct("id", "title", "type", "label", F.col("page_start").alias("pageStart"), F.col("page_end").alias("pageEnd"), "excerpt", F.col("excerpt").alias("content"), F.col("source_span_ids").alias("sourceSpanIds"), F.col("source_text_hash").alias("sourceTextHash"), F.array("type").alias("interpretationLabels"))
    rows = rows.select("document_id", "id", "parent_id", "place", F.to_json(own).alias("own"))
    levels = [cut(rows.where("parent_id IS NULL"))]
    while not levels[-1].isEmpty():
        if len(levels) > most_depth:
            raise ValueError(f"deeper than {most_depth} levels")
        above = levels[-1].select(F.col("id").alias("_up"), F.col("document_id").alias("_d"))
        levels.append(cut(rows.join(above, (F.col("parent_id") == F.col("_up")) & F.col("document_id").eqNullSafe(F.col("_d"))).select(rows.columns)))
    told = None  # document_id, parent_id and the texts of its children
    for level in reversed(levels):
        if told is not None:
            t = told.select(F.col("document_id").alias("_d"), F.col("parent_id").alias("_p"), "children")
            level = level.join(t, (F.col("id") == F.col("_p")) & F.col("document_id").eqNullSafe(F.col("_d")), "left").withColumn("children", F.coalesce("children", F.lit("")))
        else:
            level = level.withColumn("children", F.lit(""))
        whole = F.concat(F.left("own", F.length("own") - 1), F.lit(',"children":['), "children", F.lit("]}"))
        told = level.groupBy("document_id", "parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", whole.alias("t")))), lambda x: x["t"]), ",").alias("children"))
        told = cut(told)
    return told.select("document_id", F.concat(F.lit("["), "children", F.lit("]")).alias("outline"))


def said(*parts: Column) -> Column:
    """Parts that say something, between spaces."""
    return F.array_join(F.filter(F.array(*(p.cast("string") for p in parts)), lambda t: t != ""), " ")


def node_text(kind: Column, title: Column, description: Column, excerpt: Column) -> Column:
    return said(kind, title, description, excerpt)


def coverage_text(coverage: Column) -> Column:
    """What a coverage and its terms say, for matching: coverage has limits, an array of terms."""
    own = [coverage[k] for k in ("name", "line_of_business", "coverage_code", "limit", "deductible", "premium", "retroactive_date", "section_ref", "endorsement_number")]
    return said(*own, F.array_join(F.transform(coverage["limits"], lambda t: said(t["kind"], t["label"], t["value"], t["applies_to"])), " "))


def names_a_term(text: Column, terms: Column) -> Column:
    """Whether a node's text holds one of a coverage's terms of five characters or more."""
    return F.exists(terms, lambda t: (F.length(t) >= 5) & F.contains(F.lower(text), t))


def chosen_entries(coverages: Column, indexes: Column) -> Column:
    """Entries of an array by index (from 0), in order, each once; all without indexes, none for an index that isn't there."""
    entry = lambda i: F.struct(i.cast("int").alias("index"), F.get(coverages, i.cast("int")).alias("coverage"))
    every = F.transform(coverages, lambda c, i: F.struct(i.cast("int").alias("index"), c.alias("coverage")))
    some = F.filter(F.transform(F.array_sort(F.array_distinct(indexes)), entry), lambda e: (e["index"] >= 0) & (e["index"] < F.size(coverages)))
    return F.when(indexes.isNull(), every).otherwise(some)


def lines_of_profile(json: Column) -> Column:
    """A profile's lines of business; those under an older name where it has no new ones at all. Entries that aren't texts go."""
    m = F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>")
    v = F.when(F.map_contains_key(m, F.lit("linesOfBusiness")), F.try_element_at(m, F.lit("linesOfBusiness"))).otherwise(F.try_element_at(m, F.lit("policyTypes")))
    texts = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    return F.transform(texts, lambda x: F.try_variant_get(x, "$", "string"))


COVERED = r"covered cause|covered reason|covered peril|named peril|insuring agreement"


def _derived(sections: DataFrame, wanted: Column, **own: Column) -> DataFrame:
    rows = sections.where(wanted & (F.trim("content") != ""))
    return rows.select("document_id", *(c.alias(n) for n, c in own.items()), F.col("page_start").alias("page_number"), "form_number", "form_title", F.col("section_number").alias("section_ref"), F.substring("content", 1, 500).alias("original_content"))


def derived_reasons(sections: DataFrame) -> DataFrame:
    """Covered reasons of documents without any, from sections(document_id, type, title, content, coverage_name, form_title, form_number, section_number, page_start) that tell what is covered."""
    wanted = (F.lower("type") == "covered_reason") | F.lower("title").rlike(COVERED)
    return _derived(sections, F.coalesce(wanted, F.lit(False)), coverage_name=F.coalesce("coverage_name", "form_title", "title", F.lit("Covered Reasons")), title=F.col("title"), content=F.col("content"))


def derived_definitions(sections: DataFrame) -> DataFrame:
    """Definitions of documents without any, from their sections of that type."""
    return _derived(sections, F.lower("type") == "definition", term=F.coalesce("title", F.lit("Definitions")), definition=F.col("content"))
