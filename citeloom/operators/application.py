"""Applications: ids of fields, the graph of questions, what to ask next, answers, backfills and packets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import review as R

#: Words of fields that are worth a search in documents; how many are, and when none is.
SOUGHT = ("carrier", "policy", "premium", "limit", "deductible", "insured", "address", "revenue", "payroll", "effective", "expiration", "coverage", "class code", "fein", "entity")
MOST_SOUGHT, LOW_SHARE, MOST_ASKED = 5, 0.6, 8


def part(text: Column) -> Column:
    """A piece of an id: lower case, underscores for what isn't a letter or digit; 'unknown' if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "_"), r"^_+|_+\z", "")
    return F.when(bare == "", "unknown").otherwise(bare)


def _page(page: Column) -> Column:
    return F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit("p"), page.cast("string"))).otherwise("pna")


def anchor_id(section: Column, label: Column, page: Column, form_name: Column) -> Column:
    p, s, l = _page(page), part(section), part(label)
    return F.concat_ws(":", F.lit("app_field_anchor"), p, s, l, T.short_hash(F.concat_ws("|", p, s, l, part(form_name))))


def field_id(section: Column, label: Column, kind: Column, page: Column, form_name: Column, anchor: Column) -> Column:
    p, s, l = _page(page), part(section), part(label)
    return F.concat_ws(":", F.lit("app_field"), p, s, l, T.short_hash(F.concat_ws("|", p, s, l, part(kind), F.coalesce(form_name, F.lit("")), anchor)))


def normalise_fields(fields: DataFrame) -> DataFrame:
    """fields(app_id, pos, section, label, field_type, page, form_name, value) with id (the nth of an id gets ':n'), anchor_id and validation."""
    anchor = anchor_id(*(F.col(c) for c in ("section", "label", "page", "form_name")))
    rows = fields.withColumn("anchor_id", anchor)
    rows = rows.withColumn("_base", field_id(*(F.col(c) for c in ("section", "label", "field_type", "page", "form_name", "anchor_id"))))
    n = F.row_number().over(Window.partitionBy("app_id", "_base").orderBy("pos"))
    rows = rows.withColumns({"id": F.when(n > 1, F.concat_ws(":", "_base", n)).otherwise(F.col("_base")), "validation": F.when(F.coalesce(F.col("value"), F.lit("")) != "", "needs_review").otherwise("missing")})
    return rows.drop("_base")


def context_key(section: Column, label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.concat_ws(".", section, label))), "[^a-z0-9]+", "_"), r"^_+|_+\z", "")


def _node(*parts: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws(":", *parts)), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")
    return F.when(bare == "", "node").otherwise(bare)


def question_graph(fields: DataFrame) -> DataFrame:
    """Nodes of each application's questions: app_id, id, parent_id, node_type, ord, label, field_id, field_path. A group for each section, in the order of its first field; below it its fields."""
    section = _node(F.lit("section"), F.col("section"))
    rows = fields.withColumns({"_s": section, "_i": F.row_number().over(Window.partitionBy("app_id").orderBy("pos")) - 1})
    groups = rows.groupBy("app_id", "_s").agg(F.min("_i").alias("_f"), F.min_by("section", "_i").alias("label"))
    groups = groups.withColumn("ord", F.row_number().over(Window.partitionBy("app_id").orderBy("_f")) - 1)
    null = F.lit(None).cast("string")
    out = groups.select("app_id", F.col("_s").alias("id"), null.alias("parent_id"), F.lit("group").alias("node_type"), "ord", "label", null.alias("field_id"), null.alias("field_path"))
    key = F.coalesce(F.col("anchor_id"), _node(F.lit("field"), F.col("section"), F.coalesce(F.nullif(F.col("id"), F.lit("")), "label")))
    kids = rows.select("app_id", key.alias("id"), F.col("_s").alias("parent_id"), F.when(F.col("field_type") == "table", "table").otherwise("question").alias("node_type"), F.col("_i").alias("ord"), "label", F.col("id").alias("field_id"), F.concat_ws(".", "section", "id").alias("field_path"))
    return out.unionByName(kids)


def flatten_graph(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The questions and tables of a graph in the order of its paths(id, path): app_id, pos, field_id, label."""
    rows = nodes.where("node_type <> 'group' AND field_id IS NOT NULL").join(paths, "id")
    key = F.transform(F.split("path", r"\."), lambda x: x.cast("int"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("app_id").orderBy(key, "id"))).select("app_id", "pos", "field_id", "label")


def meets(op: Column, expected: Column, value: Column) -> Column:
    """Whether an answer (null: none) meets a condition; without an operator it has to be equal. expected: an array."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    wanted, v = F.transform(F.coalesce(expected, F.array().cast("array<string>")), low), low(value)
    one = F.coalesce(F.try_element_at(wanted, F.lit(1)), F.lit(""))
    return F.when(op == "exists", v != "").when(op == "not_equals", v != one).when(op == "in", F.array_contains(wanted, v)).when(op == "not_in", ~F.array_contains(wanted, v)).otherwise(v == one)


def active(fields: DataFrame, conditions: DataFrame) -> DataFrame:
    """fields(app_id, id, value, depends_on, when_value) whose own condition and whose node's conditions(app_id, field_id, depends_on, op, expected) are met. Conditions of nodes without a field don't count."""
    said = fields.where(F.trim("value") != "").groupBy("app_id", "id").agg(F.max_by("value", "pos").alias("v"))
    answer = lambda n: said.select(F.col("app_id").alias(f"_a{n}"), F.col("id").alias(f"_i{n}"), F.col("v").alias(f"_v{n}"))
    of_node = conditions.where("field_id IS NOT NULL").select(F.col("app_id").alias("_ca"), F.col("field_id").alias("_cf"), F.col("depends_on").alias("_cd"), "op", "expected")
    rows = fields.join(answer(1), (F.col("app_id") == F.col("_a1")) & (F.col("depends_on") == F.col("_i1")), "left")
    rows = rows.join(of_node, (F.col("app_id") == F.col("_ca")) & (F.col("id") == F.col("_cf")), "left").join(answer(2), (F.col("app_id") == F.col("_a2")) & (F.col("_cd") == F.col("_i2")), "left")
    own = F.col("depends_on").isNull() | meets(F.lit("equals"), F.array("when_value"), F.col("_v1"))
    return rows.where(own & (F.col("_cd").isNull() | meets(F.col("op"), F.col("expected"), F.col("_v2")))).select(*fields.columns)


def unfilled() -> Column:
    return F.coalesce(F.trim("value") == "", F.lit(True))


def next_questions(active_fields: DataFrame, batches: DataFrame, most: int = MOST_ASKED) -> DataFrame:
    """app_id, id, place: the active fields without a value that come next, those of the current batch(app_id, id) alone if it has any."""
    rows = active_fields.where(F.coalesce(F.col("value"), F.lit("")) == "").join(batches.select(F.col("app_id").alias("_a"), F.col("id").alias("_i")).distinct(), (F.col("app_id") == F.col("_a")) & (F.col("id") == F.col("_i")), "left").withColumn("_now", F.col("_i").isNotNull())
    rows = rows.withColumn("_any", F.max("_now").over(Window.partitionBy("app_id"))).where("_now OR NOT _any")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("app_id").orderBy("pos"))).where(F.col("place") <= most).select("app_id", "id", "place")


def search_fields(fields: DataFrame) -> DataFrame:
    """app_id, id, place: unfilled fields worth a search in documents, five at most; none where more than five are unfilled and more than 0.6 of these aren't worth it."""
    words = F.lower(F.concat_ws(" ", "section", "label"))
    worth = F.col("required") | reduce(lambda a, b: a | b, (F.contains(words, F.lit(w)) for w in SOUGHT))
    rows = fields.where(unfilled()).withColumn("_w", F.coalesce(worth, F.lit(False)))
    every = Window.partitionBy("app_id")
    rows = rows.withColumns({"_n": F.count("*").over(every), "_k": F.sum(F.col("_w").cast("int")).over(every)}).where("_w")
    rows = rows.where((F.col("_n") <= MOST_SOUGHT) | (1 - F.col("_k") / F.col("_n") <= LOW_SHARE))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("app_id").orderBy("pos"))).where(F.col("place") <= MOST_SOUGHT).select("app_id", "id", "place")


def plan(fields: DataFrame, has: DataFrame) -> DataFrame:
    """app_id, n_unfilled, run_backfill, run_context, run_batching. has(app_id, backfill, n_context)."""
    rows = fields.groupBy("app_id").agg(F.count_if(unfilled()).alias("n_unfilled")).join(has, "app_id")
    some = F.col("n_unfilled") > 0
    return rows.select("app_id", "n_unfilled", (F.col("backfill") & some).alias("run_backfill"), ((F.col("n_context") > 0) & some).alias("run_context"), some.alias("run_batching"))


def reply_plan(replies: DataFrame) -> DataFrame:
    """replies(app_id, has_answers, intent, question, n_lookups, has_documents, n_current, n_current_unfilled, n_next_unfilled) -> what a reply leads to."""
    current, more = F.col("n_current") > 0, F.col("n_next_unfilled") > 0
    return replies.select("app_id", (F.col("has_answers") & current).alias("parse_answers"), ((F.col("n_lookups") > 0) & F.col("has_documents")).alias("run_lookup"), ((F.coalesce("question", F.lit("")) != "") & F.col("intent").isin("question", "mixed")).alias("answer_question"), ((current & (F.col("n_current_unfilled") == 0)) | (~current & more)).alias("advance_batch"), more.alias("next_email"))


def apply_answers(fields: DataFrame, answers: DataFrame) -> DataFrame:
    """fields with the last of answers(app_id, pos, field_id, value, source, confidence) to each; its source is the user and it is confirmed unless it says otherwise."""
    last = answers.groupBy(F.col("app_id").alias("_a"), F.col("field_id").alias("_f")).agg(F.max_by(F.struct("value", "source", "confidence"), "pos").alias("_x"))
    rows = fields.join(last, (F.col("app_id") == F.col("_a")) & (F.col("id") == F.col("_f")), "left")
    had = F.col("_x").isNotNull()
    return rows.withColumns({"value": F.when(had, F.col("_x.value")).otherwise(F.col("value")), "source": F.when(had, F.coalesce("_x.source", F.lit("user"))).otherwise(F.col("source")), "confidence": F.when(had, F.coalesce("_x.confidence", F.lit("confirmed"))).otherwise(F.col("confidence"))}).drop("_a", "_f", "_x")


def backfill(fields: DataFrame, prior: DataFrame, least: float = 0.8) -> DataFrame:
    """Empty fields take the first of prior(app_id, pos, field_id, value, source, relevance) above `least`."""
    first = prior.where(F.col("relevance") > least).groupBy(F.col("app_id").alias("_a"), F.col("field_id").alias("_f")).agg(F.min_by(F.struct("value", "source"), "pos").alias("_x"))
    rows = fields.join(first, (F.col("app_id") == F.col("_a")) & (F.col("id") == F.col("_f")), "left")
    take = unfilled() & F.col("_x").isNotNull()
    return rows.withColumns({"value": F.when(take, F.col("_x.value")).otherwise(F.col("value")), "source": F.when(take, F.col("_x.source")).otherwise(F.col("source"))}).drop("_a", "_f", "_x")


def memory_fill(fields: DataFrame, chunks: DataFrame) -> DataFrame:
    """Empty fields take the value of the first of chunks(app_id, pos, value, field_id, label) that has one and names the field or its label (an absent name fits). Of chunks of equal names the first alone meets fields, and of fields of equal names one stands for all: ids may repeat."""
    c = chunks.where(F.trim("value") != "").select(F.col("app_id").alias("_a"), F.col("pos").alias("_p"), F.col("value").alias("_v"), F.nullif(F.col("field_id"), F.lit("")).alias("_f"), F.nullif(F.lower(F.trim("label")), F.lit("")).alias("_l")).where("_f IS NOT NULL OR _l IS NOT NULL")
    c = c.groupBy("_a", "_f", "_l").agg(F.min("_p").alias("_p"), F.min_by("_v", "_p").alias("_v"))
    low = F.lower(F.trim("label"))
    empty = fields.where(unfilled()).select("app_id", "id", low.alias("label")).distinct()
    by_id = empty.join(c, (F.col("app_id") == F.col("_a")) & (F.col("id") == F.col("_f"))).where(F.col("_l").isNull() | (F.col("_l") == F.col("label")))
    by_label = empty.join(c.where("_f IS NULL"), (F.col("app_id") == F.col("_a")) & (F.col("label") == F.col("_l")))
    first = by_id.unionByName(by_label).groupBy(F.col("app_id").alias("_ba"), F.col("id").alias("_bi"), F.col("label").alias("_bl")).agg(F.min_by("_v", "_p").alias("_x"))
    rows = fields.join(first, (F.col("app_id") == F.col("_ba")) & (F.col("id") == F.col("_bi")) & low.eqNullSafe(F.col("_bl")), "left")
    return rows.withColumn("value", F.when(unfilled(), F.coalesce("_x", "value")).otherwise(F.col("value"))).drop("_ba", "_bi", "_bl", "_x")


def context_proposals(active_fields: DataFrame) -> DataFrame:
    """app_id, id, field_id, key, value, category, source of filled active fields that aren't of low or no confidence."""
    rows = active_fields.where((F.coalesce(F.col("value"), F.lit("")) != "") & (F.coalesce(F.col("confidence"), F.lit("")) != "") & (F.col("confidence") != "low"))
    return rows.select("app_id", F.concat_ws(":", "app_id", "id", F.lit("context")).alias("id"), F.col("id").alias("field_id"), context_key(F.col("section"), F.col("label")).alias("key"), "value", F.col("section").alias("category"), F.when(F.col("source").startswith("lookup:"), "lookup").otherwise("application").alias("source"))


def packets(fields: DataFrame, active_fields: DataFrame) -> DataFrame:
    """app_id, n_answers, n_missing (required active fields without a value), status: draft with blocking issues or missing fields, else broker_ready; gate: failed, warning or passed, failed also for missing fields."""
    had = F.coalesce(F.col("value"), F.lit("")) != ""
    counts = active_fields.groupBy(F.col("app_id").alias("_a")).agg(F.count_if(had).alias("n"), F.count_if(F.col("required") & ~had).alias("m"))
    gates = R.status(R.application_review(fields), fields, "app_id")
    rows = gates.join(counts, F.col("app_id") == F.col("_a"), "left")
    m = F.coalesce("m", F.lit(0))
    return rows.select("app_id", F.coalesce("n", F.lit(0)).alias("n_answers"), m.alias("n_missing"), F.when((F.col("status") == "failed") | (m > 0), "draft").otherwise("broker_ready").alias("status"), F.when(m > 0, "failed").otherwise(F.col("status")).alias("gate"))
