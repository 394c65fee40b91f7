"""Spans of documents that a layout parser has read: JSON of items (texts, tables, key values, pictures), groups and a body that refers to them.

documents(document_id, json). Items come in the order in which the body reaches them first, depth first; if it reaches none,
texts, tables and key values come as they stand. An item that is given twice under one reference counts as its last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import cut
from . import source as S
from .chunks import _fields, _list, _text

FAMILIES = [("texts", ("texts",)), ("tables", ("tables",)), ("key_values", ("key_value_items", "keyValueItems")), ("pictures", ("pictures",))]
BASE = {"texts": "#/texts", "tables": "#/tables", "key_values": "#/key_value_items", "pictures": "#/pictures", "groups": "#/groups"}


def is_parsed_input(json: Column) -> Column:
    """Whether an input wraps such a document."""
    m = F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>")
    return F.coalesce((_at(m, "kind") == "docling_document") & F.try_variant_get(F.try_element_at(m, F.lit("document")), "$", "map<string,variant>").isNotNull(), F.lit(False))


def _get(m: Column, *keys: str) -> Column:
    return F.coalesce(*(F.try_element_at(m, F.lit(k)) for k in keys))


def _at(m: Column, *keys: str) -> Column:
    return _text(_get(m, *keys))


def first_number(m: Column, *keys: str) -> Column:
    """The first of these fields that is a number."""
    one = lambda v: F.when(~F.schema_of_variant(v).isin("STRING", "BOOLEAN", "VOID") & ~F.schema_of_variant(v).rlike("^(?:ARRAY|OBJECT)"), F.try_variant_get(v, "$", "double"))
    return F.coalesce(*(one(F.try_element_at(m, F.lit(k))) for k in keys))


def first_string(m: Column, *keys: str) -> Column:
    """The first of these fields that is a text and not blank, trimmed."""
    one = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.nullif(_trimmed(_text(v)), F.lit("")))
    return F.coalesce(*(one(F.try_element_at(m, F.lit(k))) for k in keys))


def _trimmed(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+\z", "")


def unit_of_label(label: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    return F.when(low.contains("table"), "table").when(low.contains("key"), "key_value").when(low.contains("section") | low.contains("header"), "section").otherwise("text")


def cells(data: Column) -> Column:
    """Of a table's data its cells that have text: row, col, text."""
    m = _fields(data)
    cell = lambda v: T.let(_fields(v), lambda c: F.struct(F.coalesce(first_number(c, "start_row_offset", "row_header", "row", "rowIndex"), F.lit(0.0)).cast("int").alias("row"), F.coalesce(first_number(c, "start_col_offset", "col", "colIndex"), F.lit(0.0)).cast("int").alias("col"), first_string(c, "text", "orig", "content").alias("text")))
    return F.filter(F.transform(_list(_get(m, "table_cells", "tableCells")), cell), lambda c: c["text"].isNotNull())


def grid(found: Column) -> Column:
    """Cells as rows of texts; the last of those in one place counts. Cells are put in order once, and each row takes the stretch of its own; those at negative places are in none."""
    placed = F.filter(F.transform(found, lambda c, i: F.struct(c["row"].alias("row"), i.alias("i"), c["col"].alias("col"), c["text"].alias("text"))), lambda c: (c["row"] >= 0) & (c["col"] >= 0))
    at = lambda s, i: F.element_at(s, i)["row"]

    def row(held: Column, width: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), width), lambda i: F.coalesce(F.try_element_at(F.filter(held, lambda c: c["col"] == i), F.lit(-1))["text"], F.lit("")))

    def rows(s: Column, heads: Column, width: Column) -> Column:
        def one(head: Column, k: Column) -> Column:
            own = F.slice(s, head, F.coalesce(F.try_element_at(heads, k + 2), F.size(s) + 1) - head)
            before = F.when(k == 0, -1).otherwise(at(s, F.greatest(head - 1, F.lit(1))))  # rows between without cells are blank
            return T.let(own, lambda held: F.concat(F.array_repeat(F.array_repeat(F.lit(""), width + 1), at(s, head) - before - 1), F.array(row(held, width))))

        return F.flatten(F.transform(heads, one))

    starts = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (at(s, i) != at(s, F.greatest(i - 1, F.lit(1)))))
    made = lambda s: T.let(starts(s), lambda heads: T.let(F.array_max(F.transform(s, lambda c: c["col"])), lambda width: rows(s, heads, width)))
    return T.let(F.sort_array(placed), lambda s: F.when(F.size(s) > 0, made(s)))


def _joined(values: Column) -> Column:
    return F.array_join(F.filter(values, lambda t: t != ""), " | ")


def markdown(rows: Column) -> Column:
    """A table's text: a single row as it is, more as a markdown table whose first row is the head."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.transform(rows[0], lambda _: F.lit("---"))
    return F.when(F.size(rows) == 1, _joined(rows[0])).otherwise(F.array_join(F.transform(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))), line), "\n"))


def row_text(row: Column, head: Column, at: Column) -> Column:
    """A row with its columns' heads; the head alone, and a table of one row, without."""
    said = F.zip_with(row, head, lambda v, h: F.when(v == "", "").when(h != "", F.concat_ws(": ", h, v)).otherwise(v))
    return F.when(at == 0, _joined(row)).otherwise(_joined(said))


def items(documents: DataFrame) -> DataFrame:
    """document_id, ref, pos (place if the body reaches nothing), label, children, and what an item says: fields m."""
    doc = documents.select("document_id", F.try_variant_get(F.try_parse_json("json"), "$", "map<string,variant>").alias("d")).where("d IS NOT NULL")

    def family(n: int, name: str, keys: tuple[str, ...]) -> Column:
        return F.transform(_list(_get(F.col("d"), *keys)), lambda v, i: F.struct(F.lit(n).alias("family"), i.alias("i"), F.lit(BASE[name]).alias("base"), v.alias("v")))

    every = F.concat(*(family(n, *f) for n, f in enumerate(FAMILIES)))
    rows = doc.select("document_id", F.posexplode(every).alias("pos", "x")).select("document_id", "pos", "x.family", _fields(F.col("x.v")).alias("m"), F.concat_ws("/", "x.base", "x.i").alias("own"))
    rows = rows.withColumn("ref", F.coalesce(_at(F.col("m"), "self_ref", "selfRef"), "own")).drop("own")
    last = F.row_number().over(Window.partitionBy("document_id", "ref").orderBy(F.desc("pos"))) == 1
    return rows.withColumn("_last", last).withColumn("pos", F.min("pos").over(Window.partitionBy("document_id", "ref"))).where("_last").drop("_last")


def _children(m: Column) -> Column:
    """References to children, as texts or objects."""
    return F.transform(_list(F.try_element_at(m, F.lit("children"))), lambda c: T.let(_fields(c), lambda x: _at(x, "$ref", "ref", "")))


def body_order(documents: DataFrame, found: DataFrame, most_depth: int = 64) -> DataFrame:
    """document_id, ref, path: the first way from the body to each item. Each level of the body is one join; deeper than most_depth is an error, as a cycle would be."""
    doc = documents.select("document_id", F.try_variant_get(F.try_parse_json("json"), "$", "map<string,variant>").alias("d")).where("d IS NOT NULL")
    groups = doc.select("document_id", F.posexplode(_list(_get(F.col("d"), "groups"))).alias("i", "v")).select("document_id", "i", _fields(F.col("v")).alias("m"))
    groups = groups.select("document_id", F.coalesce(_at(F.col("m"), "self_ref", "selfRef"), F.concat_ws("/", F.lit(BASE["groups"]), "i")).alias("ref"), _children(F.col("m")).alias("kids"), F.col("i").alias("_i"))
    groups = groups.groupBy("document_id", "ref").agg(F.max_by("kids", "_i").alias("kids"))
    own = found.select("document_id", "ref", _children(F.col("m")).alias("kids"))
    nodes = own.unionByName(groups.join(own.select("document_id", "ref"), ["document_id", "ref"], "left_anti"))
    edges = cut(nodes.select("document_id", F.col("ref").alias("up"), F.posexplode("kids").alias("at", "ref")).where("ref IS NOT NULL"))
    level = cut(doc.select("document_id", F.posexplode(_children(_fields(_get(F.col("d"), "body")))).alias("at", "ref")).where("ref IS NOT NULL").groupBy("document_id", "ref").agg(F.array(F.min("at")).alias("path")))
    out = level
    for _ in range(most_depth):
        level = level.select("document_id", F.col("ref").alias("up"), "path").join(edges, ["document_id", "up"]).select("document_id", "ref", F.concat("path", F.array("at")).alias("path"))
        level = cut(level.groupBy("document_id", "ref").agg(F.min("path").alias("path")))
        if level.isEmpty():
            return out.groupBy("document_id", "ref").agg(F.min("path").alias("path"))
        out = out.unionByName(level)
    raise ValueError(f"a body deeper than {most_depth} levels")


def units(documents: DataFrame) -> DataFrame:
    """document_id, i (from 0, in order), ref, label, text, page_start, page_end, bboxes, rows (of a table, else null): items that say something."""
    found = cut(items(documents))
    ways = body_order(documents, found)
    rows = found.join(ways, ["document_id", "ref"], "left")
    rows = rows.withColumn("_any", F.max(F.col("path").isNotNull()).over(Window.partitionBy("document_id")))
    rows = rows.where("path IS NOT NULL OR (NOT _any AND family < 3)").withColumn("path", F.coalesce("path", F.array("pos")))
    m = F.col("m")
    rows = rows.withColumn("said", first_string(m, "text", "orig")).withColumn("rows", F.when(F.col("said").isNull(), T.let(cells(_get(m, "data")), grid)))
    rows = rows.withColumn("text", F.coalesce("said", _trimmed(markdown(F.col("rows"))))).where("text <> ''")
    prov = F.transform(_list(_get(m, "prov")), lambda v: _fields(v))
    page = lambda p: first_number(p, "page_no", "pageNo", "page").cast("int")

    def box(p: Column) -> Column:
        def made(b: Column) -> Column:
            x, y = first_number(b, "x", "l", "left"), first_number(b, "y", "t", "top")
            return F.struct(page(p).alias("page"), x.alias("x"), y.alias("y"), F.coalesce(first_number(b, "width"), first_number(b, "r", "right") - x).alias("width"), F.coalesce(first_number(b, "height"), first_number(b, "b", "bottom") - y).alias("height"))

        return T.let(_fields(_get(p, "bbox")), made)

    pages = F.filter(F.transform(prov, page), lambda p: p > 0)
    whole = lambda b: (b["page"] != 0) & b["x"].isNotNull() & b["y"].isNotNull() & b["width"].isNotNull() & b["height"].isNotNull()
    label = F.when(F.schema_of_variant(_get(m, "label")) == "STRING", _at(m, "label"))
    rows = rows.select("document_id", "ref", "path", label.alias("label"), "text", F.array_min(pages).alias("page_start"), F.array_max(pages).alias("page_end"), F.filter(F.transform(prov, box), whole).alias("bboxes"), "rows")
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("document_id").orderBy("path")) - 1).drop("path")


def parsed_spans(found: DataFrame, source_kind: str = "policy_pdf") -> DataFrame:
    """units() -> their spans: id, document_id, pos, text, text_hash, kind, source_kind, source_unit, section_id, page_start, page_end, bboxes, parent_span_id, table_id, table_span_id, row_span_id, row_index, column_index, column_name, is_header, metadata.

    A table gives a span, and one for each of its rows and cells that say something."""
    null = lambda kind: F.lit(None).cast(kind)
    table = F.col("rows").isNotNull()
    base = {"source_kind": F.lit(source_kind), "section_id": F.col("label"), "table_id": F.when(table, F.concat("ref", F.lit(":table")))}
    top = found.withColumns({**base, "source_unit": F.when(table, "table").otherwise(unit_of_label(F.col("label"))), "pos": F.col("i").cast("long") * 1000, "parent_span_id": null("string"), "table_span_id": null("string"), "row_span_id": null("string"), "row_index": null("int"), "column_index": null("int"), "column_name": null("string"), "is_header": null("boolean")})
    top = cut(S.build_spans(top, F.col("pos")))
    # a line takes its own row and the head along, not the table
    whole, many = F.lit(None).cast(top.schema["rows"].dataType), F.size("rows") > 1
    held = top.where("rows IS NOT NULL").select(*(c for c in top.columns if c not in ("row_index", "rows")), F.col("rows")[0].alias("_head"), many.alias("_many"), F.posexplode("rows").alias("row_index", "_row")).withColumn("rows", whole)
    headed = F.col("_many") & (F.col("row_index") == 0)
    held = held.withColumns({"text": row_text(F.col("_row"), F.col("_head"), F.col("row_index")), "parent_span_id": F.col("id"), "table_span_id": F.col("id"), "source_unit": F.lit("table_row"), "is_header": headed, "pos": F.col("i").cast("long") * 1000 + 1 + F.col("row_index")}).where("text <> ''")
    lines = cut(S.build_spans(held, F.col("pos")).select(*top.columns, "_row", "_head", "_many"))
    cell = lines.select(*(c for c in lines.columns if c not in ("column_index", "text")), F.posexplode("_row").alias("column_index", "text")).where("text <> ''")
    name = F.when(F.col("_many"), F.nullif(F.try_element_at("_head", F.col("column_index") + 1), F.lit("")))
    cell = cell.withColumns({"row_span_id": F.col("id"), "parent_span_id": F.col("id"), "source_unit": F.lit("table_cell"), "column_name": name, "pos": F.col("i").cast("long") * 1000 + 100 + F.col("row_index") * 100 + F.col("column_index")})
    out = top.unionByName(lines.select(*top.columns)).unionByName(S.build_spans(cell, F.col("pos")).select(*top.columns))
    inside = F.col("parent_span_id").isNotNull()
    told = {"sourceSystem": F.lit("docling"), "sourceUnit": F.when(inside | F.col("rows").isNotNull(), F.col("source_unit")).otherwise("docling_item"), "doclingRef": F.col("ref"), "doclingLabel": F.nullif("label", F.lit("")), "tableId": F.when(inside, F.col("table_id")), "tableSpanId": F.col("table_span_id"), "rowSpanId": F.col("row_span_id"), "rowIndex": F.col("row_index").cast("string"), "columnIndex": F.col("column_index").cast("string"), "columnName": F.col("column_name"), "isHeader": F.col("is_header").cast("string")}
    metadata = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in told.items())), lambda e: e["value"].isNotNull()))
    return out.withColumns({"metadata": metadata, "kind": F.lit("plain_text")}).drop("rows", "ref", "label", "i")


def parsed_text(documents: DataFrame, found: DataFrame) -> DataFrame:
    """document_id, page_count, text: units by page (without one: the first; beyond the last: the last), each page under 'Page n'."""
    m = F.try_variant_get(F.try_parse_json("json"), "$", "map<string,variant>")
    pages = _get(m, "pages")
    keys = F.map_keys(F.try_variant_get(pages, "$", "map<string,variant>"))
    listed = F.size(F.try_variant_get(pages, "$", "array<variant>"))
    most = F.array_max(F.filter(F.transform(keys, lambda k: k.try_cast("int")), lambda n: n > 0))
    given = F.when(listed >= 0, listed).when(keys.isNotNull(), F.coalesce(most, F.size(keys)))
    seen = found.groupBy("document_id").agg(F.max(F.greatest("page_start", "page_end")).alias("_seen"))
    doc = documents.select("document_id", given.alias("_given")).join(seen, "document_id", "left")
    doc = cut(doc.select("document_id", F.greatest(F.lit(1), F.coalesce("_given", "_seen", F.lit(1))).cast("int").alias("page_count")))
    at = F.greatest(F.lit(1), F.least(F.coalesce("page_start", F.lit(1)), "page_count"))
    rows = found.join(doc, "document_id").groupBy("document_id", at.alias("p")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n\n").alias("t"))
    said = F.concat(F.lit("Page "), F.col("p"), F.lit("\n"), _trimmed(F.col("t"))).alias("t")
    whole = rows.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", said))), lambda x: x["t"]), "\n\n").alias("text"))
    return doc.join(whole, "document_id", "left").select("document_id", "page_count", F.coalesce("text", F.lit("")).alias("text"))
