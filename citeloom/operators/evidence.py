"""Evidence: joins of citations and sources, validation issues, conflicts, gates, proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def order_key(cols: list[str]):
    """Ties in relevance: these columns joined by bars, absent ones empty."""
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))


def quoted_issues(items: DataFrame, sources: DataFrame) -> DataFrame:
    """items(item_id, quote, source_id, cited) against sources(id, body[, pos]): item_id, code of the first rule broken; severity blocking. Of sources that share an id the first counts (by pos, else by text)."""
    sources = sources.groupBy("id").agg(F.min_by("body", "pos").alias("body") if "pos" in sources.columns else F.min("body").alias("body"))
    low = lambda c: F.lower(T.normalize_ws(c))
    rows = items.where(F.trim("quote") != "").join(sources, F.col("source_id") == F.col("id"), "left")
    cited = F.when(F.trim("cited") == "", F.col("quote")).otherwise(F.coalesce("cited", "quote"))
    held = F.contains(low(F.col("body")), low(cited)) & F.contains(low(F.col("body")), low(F.col("quote")))
    code = F.when(F.col("source_id").isNull(), "missing_citation").when(F.col("id").isNull(), "unknown_source").when(~held, "quote_not_found")
    return rows.select("item_id", code.alias("code"), F.lit("blocking").alias("severity")).where("code IS NOT NULL")


def gate(issues: DataFrame, group: str, severity: str = "severity") -> DataFrame:
    """group, status: failed with a blocking issue, else warning with a warning, else passed; and counts."""
    has = lambda v: F.count_if(F.col(severity) == v)
    rows = issues.groupBy(group).agg(has("blocking").alias("n_blocking"), has("warning").alias("n_warning"), has("info").alias("n_info"))
    return rows.withColumn("status", F.when(F.col("n_blocking") > 0, "failed").when(F.col("n_warning") > 0, "warning").otherwise("passed"))


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of more than one distinct value, with the values in order."""
    return df.select(key, value).distinct().groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("v")).where(F.size("v") > 1).select(key, F.size("v").alias("n_values"), F.array_join("v", "|").alias("signature"))


def conflicting_sources(sources: DataFrame, case: str) -> DataFrame:
    """sources(case, text, field_path, form_number, label): keys (field and form, else label) whose sources name unlike sets of amounts and dates: case, key, n_signatures. Sources without a key or such values don't count."""
    key = F.when(F.col("field_path").isNotNull(), F.concat_ws(":", "field_path", F.coalesce("form_number", F.lit("default")))).otherwise(F.col("label"))
    rows = sources.select(case, F.lower(T.normalize_ws(key)).alias("key"), F.array_join(F.array_sort(T.comparable_values(F.col("text"))), "|").alias("s")).where("key <> '' AND s <> ''")
    return rows.groupBy(case, "key").agg(F.count_distinct("s").alias("n_signatures")).where("n_signatures > 1")


def section_precedence(section):
    """How much a source's section weighs (fixed words and ranks): declarations and schedules 4, endorsements 3, additional coverages 2, forms 1, others 0."""
    low = F.lower(F.coalesce(section, F.lit("")))
    return F.when(F.contains(low, F.lit("declaration")) | F.contains(low, F.lit("schedule")), 4).when(F.contains(low, F.lit("endorsement")), 3).when(F.contains(low, F.lit("additional coverages")), 2).when(F.contains(low, F.lit("coverage form")) | F.contains(low, F.lit("policy form")), 1).otherwise(0)


def precedence_conflicts(df: DataFrame, keys: list[str], rank: list, *values: str) -> DataFrame:
    """Rows that differ from the row of highest precedence of their key in one of the values, where both have one (not null, not blank): with ruling, the higher row's first value."""
    w = Window.partitionBy(*keys).orderBy(*rank)
    rows = df.withColumns({f"_r{i}": F.first(v).over(w) for i, v in enumerate(values)}).withColumn("_k", F.row_number().over(w))
    said = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    unlike = F.lit(False)
    for i, v in enumerate(values):
        unlike |= (said(v) != "") & (said(f"_r{i}") != "") & (said(v) != said(f"_r{i}"))
    rows = rows.where((F.col("_k") > 1) & unlike).withColumn("ruling", F.col("_r0"))
    return rows.drop("_k", *(f"_r{i}" for i in range(len(values))))


def best_proposal(df: DataFrame, group: str) -> DataFrame:
    """df(group, id, grounding, completeness, consistency, determinism, risk, cost): the highest weighted total of each group, ties by id."""
    total = 3 * F.col("grounding") + 2 * F.col("completeness") + 3 * F.col("consistency") + F.col("determinism") + F.col("risk") + F.col("cost")
    scored = df.withColumn("total", total)
    return scored.groupBy(group).agg(F.min_by(F.struct("id", "total"), F.struct((-F.col("total")), "id")).alias("b")).select(group, "b.id", "b.total")


def eligible_proposals(proposals: DataFrame, issues: DataFrame) -> DataFrame:
    """proposals(id, ..) without those that issues(id, code, severity) block for a citation that is missing, unknown or not as quoted."""
    bars = issues.where((F.col("severity") == "blocking") & F.col("code").isin("missing_citation", "unknown_source", "quote_not_found"))
    return proposals.join(bars.select("id"), "id", "left_anti")


def unique_codes(table: DataFrame, code: str, description: str) -> DataFrame:
    """Normalised descriptions that stand for one code only."""
    norm = T.squeeze(F.col(description))
    return table.select(norm.alias("norm"), code).groupBy("norm").agg(F.min(code).alias("code"), F.count_distinct(code).alias("n")).where("n = 1").select("norm", "code")


def apply_decisions(items: DataFrame, decisions: DataFrame, group: str) -> DataFrame:
    """items(group, idx, value) with decisions(group, idx, pos, action, value): the last decision for a place counts; drop removes, update sets the value if given, places that no decision names stay."""
    last = decisions.groupBy(F.col(group).alias("_g"), F.col("idx").alias("_i")).agg(F.max_by(F.struct("action", "value"), F.struct("pos", "action", "value")).alias("d"))
    rows = items.join(last, (F.col(group) == F.col("_g")) & (F.col("idx") == F.col("_i")), "left").where("d IS NULL OR d.action <> 'drop'")
    return rows.select(group, "idx", F.when(F.col("d.action") == "update", F.coalesce("d.value", "value")).otherwise(F.col("value")).alias("value"))


def merge_facts(base: DataFrame, candidate: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """key, value, origin: the candidate's value if at least one of the ids it cites is known, else the base's. candidate(key.., value, ids), known(id)."""
    cited = candidate.select(*key, F.col("value").alias("_v"), F.explode("ids").alias("_id")).join(known, F.col("_id") == F.col("id"), "left_semi").select(*key, "_v").distinct()
    rows = base.join(cited, key, "full")
    return rows.select(*key, F.coalesce("_v", "value").alias("value"), F.when(F.col("_v").isNotNull(), "candidate").otherwise("base").alias("origin"))


def missing_citations(citations: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    return citations.join(evidence.select(key).distinct(), key, "left_anti")


def first_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """questions(id, path), answers(pos, question_id, field_path, text): each question with the first answer to its id or path; a blank one leaves it open."""
    by_id = answers.join(questions.select("id"), F.col("question_id") == F.col("id")).select("id", "pos", "text")
    by_path = answers.join(questions.select("id", "path"), F.col("field_path") == F.col("path")).select("id", "pos", "text")
    first = by_id.unionByName(by_path).groupBy(F.col("id").alias("_q")).agg(F.min_by("text", "pos").alias("answer"))
    rows = questions.join(first, F.col("id") == F.col("_q"), "left").drop("_q")
    return rows.withColumn("status", F.when(F.trim(F.coalesce("answer", F.lit(""))) != "", "answered").otherwise("open"))


def active_fields(fields: DataFrame, answers: DataFrame) -> DataFrame:
    """fields(id, depends_on, op, expected): those whose condition the answers(field, value) meet; none is always met, null answers are empty."""
    rows = fields.join(answers.select(F.col("field").alias("_f"), F.lower(F.trim("value")).alias("_v")), F.col("depends_on") == F.col("_f"), "left")
    v, e = F.coalesce("_v", F.lit("")), F.lower(F.trim("expected"))
    inside = F.array_contains(F.transform(F.split(e, ","), lambda x: F.trim(x)), v)
    met = F.when(F.col("depends_on").isNull(), True).when(F.col("op") == "equals", v == e).when(F.col("op") == "not_equals", v != e).when(F.col("op") == "in", inside).when(F.col("op") == "not_in", ~inside).when(F.col("op") == "exists", v != "").otherwise(True)
    return rows.where(met).select("id")


def page_scores(df: DataFrame, doc: str, page: str, text: str, weights: list[tuple[str, int]], least: int = 18, most: int = 12) -> DataFrame:
    """doc, page, score of pages whose summed positive scores reach `least`, the best `most` of each doc."""
    score = F.lit(0)
    for pattern, weight in weights:
        score = score + F.when(F.col(text).rlike(pattern), weight).otherwise(0)
    sums = df.withColumn("_s", score).where("_s > 0").groupBy(doc, page).agg(F.sum("_s").alias("score")).where(F.col("score") >= least)
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("score"), page))).where(F.col("rank") <= most)
