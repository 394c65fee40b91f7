"""Cleaning of a profile: which nodes to look at, decisions on rows and terms, and what is shown of limits after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import cut

#: Kinds of terms, their scopes, and what a value says itself; scores of nodes and how many are taken.
PRIMARY = ("each_claim_limit", "each_occurrence_limit", "each_loss_limit", "aggregate_limit")
SCOPES = {"each_claim_limit": "Each Claim", "each_occurrence_limit": "Each Occurrence", "each_loss_limit": "Each Loss", "aggregate_limit": "Aggregate", "sublimit": "Sub-Limit"}
SAYS = r"each|aggregate|occurrence|claim|loss|proceeding|policy|sublimit|sub-limit"
CITED, ABOVE, STEP, BESIDE, BELOW, NAMED = 1000, 940, 30, 850, 760, 600
MOST_NODES, NEAR, MOST_BELOW = 90, 4, 24


def clean_value(text: Column) -> Column:
    """A value without a dangling slash or marks at its ends; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\s+/\s*\z", ""), r"\s+", " ")
    return F.nullif(F.trim(F.regexp_replace(bare, r"^[\s:;#-]+|[\s;,.]+\z", "")), F.lit(""))


def _said(t: Column) -> Column:
    return F.lower(F.concat_ws(" ", t["kind"], t["label"], t["value"]))


def _names(t: Column, words: str) -> Column:
    return _said(t).rlike(rf"{T.B}(?:{words}){T.B}")


def is_limit(t: Column) -> Column:
    return t["kind"].isin(*PRIMARY, "sublimit") | ((t["kind"] == "other") & _names(t, "limit|aggregate|claim|occurrence|loss|proceeding"))


def shown(t: Column) -> Column:
    """A limit term as it is shown: its value, with its label or scope behind it unless the value says it."""
    name = F.regexp_replace(clean_value(t["label"]), r"(?i)\s+Limit\z", "")
    scope = F.element_at(F.create_map(*(F.lit(x) for kv in SCOPES.items() for x in kv)), t["kind"])
    name = F.when(name.isNotNull() & ~name.rlike(r"(?i)^(?:limit|amount|value)\z"), name).otherwise(scope)
    value = clean_value(t["value"])
    return F.when(value.rlike(rf"(?i){T.B}(?:{SAYS}){T.B}") | name.isNull(), value).otherwise(F.concat_ws(" ", value, name))


def derived(terms: Column) -> Column:
    """limit, deductible, premium and retroactive date of an array of terms(kind, label, value): the main limits shown between slashes, and the first value of each of the others."""
    first = lambda kinds, words: F.try_element_at(F.transform(F.filter(terms, lambda t: t["kind"].isin(*kinds) | _names(t, words)), lambda t: t["value"]), F.lit(1))
    main = F.filter(terms, lambda t: t["kind"].isin(*PRIMARY))
    chosen = F.when(F.size(main) > 0, main).otherwise(F.filter(terms, is_limit))
    limit = F.nullif(F.array_join(F.array_distinct(F.array_compact(F.transform(chosen, shown))), " / "), F.lit(""))
    return F.struct(limit.alias("limit"), first(("deductible", "retention"), "deductible|retention|sir").alias("deductible"), first(("premium",), "premium").alias("premium"), first(("retroactive_date",), "retroactive").alias("retroactive_date"))


def use_terms(current: Column, by_terms: Column) -> Column:
    """Whether the limit of the terms replaces the one there is: none, one that ends in a slash or names no scope, or a single one where the terms have several."""
    now = clean_value(current)
    return now.isNull() | ~now.rlike(rf"(?i){T.B}(?:{SAYS}){T.B}") | (~F.contains(now, F.lit("/")) & F.contains(by_terms, F.lit("/")))


def apply_terms(coverages: DataFrame, decisions: DataFrame) -> DataFrame:
    """coverages(group, idx, limit, terms: array of kind, label, value) after decisions(group, idx, term, pos, action, kind, label, value): the last on each term counts; drop removes, update sets what it gives. Limits are told anew where terms changed; coverages without a decision stay."""
    last = decisions.groupBy(F.col("group").alias("_g"), F.col("idx").alias("_i"), F.col("term").alias("_t")).agg(F.max_by(F.struct("action", "kind", "label", "value"), "pos").alias("_d"))
    per = last.groupBy("_g", "_i").agg(F.map_from_entries(F.collect_list(F.struct("_t", "_d"))).alias("_m"))  # a coverage's terms
    rows = coverages.join(per, (F.col("group") == F.col("_g")) & (F.col("idx") == F.col("_i")), "left")
    told = lambda t, i: F.struct(F.try_element_at("_m", i).alias("d"), t.alias("t"))
    kept = F.filter(F.transform("terms", told), lambda x: x["d"].isNull() | (x["d"]["action"] != "drop"))
    pick = lambda x, c: F.when(x["d"]["action"] == "update", F.coalesce(x["d"][c], x["t"][c])).otherwise(x["t"][c]).alias(c)
    terms = F.when(F.col("_m").isNull(), F.col("terms")).otherwise(F.transform(kept, lambda x: F.struct(pick(x, "kind"), pick(x, "label"), pick(x, "value"))))
    rows = rows.withColumn("terms", terms)
    return rows.withColumn("limit", T.let(derived(F.col("terms")), lambda d: F.when(F.col("_m").isNotNull() & d["limit"].isNotNull() & use_terms(F.col("limit"), d["limit"]), d["limit"]).otherwise(F.col("limit")))).drop("_g", "_i", "_m")


def select_nodes(nodes: DataFrame, cited: DataFrame, terms: DataFrame, keyword: str, most_depth: int = 64) -> DataFrame:
    """document_id, id, score, place of the 90 nodes of each document that its coverages are best checked against.

    nodes(document_id, id, parent_id, kind, ord, page_start, page_end, text), cited(document_id, id), terms(document_id,
    term: lower case). Cited nodes score highest, then those above them, those beside them, those below any of these,
    and those of the same pages that hold a keyword or a term of five letters or more. The root is left out.
    """
    some = cut(nodes.where("kind <> 'document'"))
    hit = some.join(cited.select(F.col("document_id").alias("_d"), F.col("id").alias("_c")).distinct(), (F.col("document_id") == F.col("_d")) & (F.col("id") == F.col("_c"))).drop("_d", "_c")
    score = lambda df, s: df.select("document_id", "id", s.alias("score"))
    found = score(hit, F.lit(CITED))
    up = some.select(F.col("id").alias("_id"), F.col("parent_id").alias("_up"))
    level = cut(hit.select("document_id", F.col("parent_id").alias("id")).distinct())
    for k in range(most_depth):
        level = cut(level.join(up, F.col("id") == F.col("_id")).select("document_id", "id", F.col("_up")))
        if level.isEmpty():
            break
        found = found.unionByName(score(level, F.lit(ABOVE - STEP * k)))
        level = level.select("document_id", F.col("_up").alias("id")).distinct()
    # a node stands in one stretch of places, a cited one in those that its neighbours may be in
    stretch = lambda at: F.floor(at / (2 * NEAR))
    kin = hit.select(F.col("parent_id").alias("_p"), F.col("ord").alias("_o"), F.explode(F.sequence(stretch(F.col("ord") - NEAR), stretch(F.col("ord") + NEAR))).alias("_b"))
    beside = some.join(kin, (F.col("parent_id") == F.col("_p")) & (stretch(F.col("ord")) == F.col("_b")) & (F.abs(F.col("ord") - F.col("_o")) <= NEAR))
    found = cut(found.unionByName(score(beside, (F.lit(BESIDE) - F.abs(F.col("ord") - F.col("_o"))).cast("int"))).groupBy("document_id", "id").agg(F.max("score").alias("score")))
    child = F.row_number().over(Window.partitionBy("parent_id").orderBy("ord", "id"))
    below = some.withColumn("_k", child).where(F.col("_k") <= MOST_BELOW).join(found.select(F.col("id").alias("_f")), F.col("parent_id") == F.col("_f"))
    pages = hit.select(F.col("document_id").alias("_d"), F.explode(F.array("page_start", "page_end")).alias("_pg")).where("_pg > 0").distinct()
    words = terms.where(F.length("term") >= 5).groupBy(F.col("document_id").alias("_td")).agg(F.collect_set("term").alias("_w"))  # a profile's words
    paged = some.join(pages, (F.col("document_id") == F.col("_d")) & (F.col("page_start") == F.col("_pg"))).join(words, F.col("document_id") == F.col("_td"), "left")
    named = paged.where(F.col("text").rlike(keyword) | T.let(F.lower("text"), lambda t: F.exists(F.coalesce("_w", F.array().cast("array<string>")), lambda w: F.contains(t, w))))
    every = found.unionByName(score(below, F.lit(BELOW))).unionByName(score(named, F.lit(NAMED))).groupBy("document_id", "id").agg(F.max("score").alias("score"))
    rows = every.join(some.select(F.col("id").alias("_id"), F.coalesce(F.col("page_start").cast("long"), F.lit(2**53 - 1)).alias("_p"), "ord"), F.col("id") == F.col("_id"))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("score"), "_p", "ord", "id"))).where(F.col("_k") <= MOST_NODES)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("_p", "ord", "id"))).select("document_id", "id", "score", "place")


def total_cost(text: Column) -> Column:
    """A total as a number: digits and points alone count."""
    return F.regexp_replace(text, r"[^0-9.]", "").try_cast("double")


def first_facts(facts: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Facts, of those with equal keys the first; ids count as sets in their order."""
    w = Window.partitionBy(*(F.array_join(F.array_distinct(k), "\u0001") if dict(facts.dtypes)[k].startswith("array") else F.col(k) for k in keys)).orderBy(pos)
    return facts.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def union_ids(facts: DataFrame, group: str, pos: str, ids: str) -> DataFrame:
    """group, ids: all ids of its facts, each once, in the order in which they come first."""
    return facts.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(pos, ids))).alias("l")).select(group, F.array_distinct(F.flatten(F.transform("l", lambda x: x[ids]))).alias(ids))
