"""Two versions of profiles compared: facts and coverages that were cited in the first and aren't in the second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The facts that count.
CRITICAL = ("policyNumber", "namedInsured", "insurer", "effectiveDate", "expirationDate")


def bare(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^a-zA-Z0-9]", ""))


def _cited(*ids: str) -> Column:
    some = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x != "")
    return F.coalesce(some(ids[0]) | some(ids[1]), F.lit(False))


def fact_regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, field, message for critical facts(id, field, value, span_ids, node_ids) that were cited before and are missing, uncited or changed."""
    sound = lambda df: df.where(F.col("field").isin(*CRITICAL) & (F.trim("value") != "") & _cited("span_ids", "node_ids"))
    a = sound(before).select("id", "field", bare(F.col("value")).alias("_a"))
    b = sound(after).select(F.col("id").alias("_i"), F.col("field").alias("_f"), bare(F.col("value")).alias("_b"))
    rows = a.join(b, (F.col("id") == F.col("_i")) & (F.col("field") == F.col("_f")), "left").where(F.col("_b").isNull() | (F.col("_a") != F.col("_b")))
    return rows.select("id", "field", F.when(F.col("_b").isNull(), "missing cited value").otherwise("value changed").alias("message"))


def coverage_regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, seq, name of coverages(id, seq, name, code, span_ids, node_ids) that were cited before and match none cited after: by a span, a node, the code or the name. Four joins on equal keys, no pair of all."""
    a, b = before.where(_cited("span_ids", "node_ids")), after.where(_cited("span_ids", "node_ids"))
    keyed = lambda df: (
        df.select("id", *(["seq"] if "seq" in df.columns else []), F.explode(F.array_distinct(F.concat(
            F.transform(F.coalesce("span_ids", F.array().cast("array<string>")), lambda x: F.concat(F.lit("s:"), x)),
            F.transform(F.coalesce("node_ids", F.array().cast("array<string>")), lambda x: F.concat(F.lit("n:"), x)),
            F.filter(F.array(F.concat(F.lit("c:"), bare(F.col("code"))), F.concat(F.lit("w:"), bare(F.col("name")))), lambda x: F.length(x) > 2),
        ))).alias("k"))
    )
    met = keyed(a).join(keyed(b).select("id", "k").distinct(), ["id", "k"], "left_semi").select("id", "seq").distinct()
    return a.join(met, ["id", "seq"], "left_anti").select("id", "seq", F.coalesce("code", "name").alias("name"))


def compare(ids: DataFrame, facts: DataFrame, coverages: DataFrame) -> DataFrame:
    """id, n_facts, n_coverages, passed for every id of the corpus."""
    n = lambda df, name: df.groupBy(F.col("id").alias(f"_{name}")).agg(F.count("*").alias(name))
    rows = ids.select("id").join(n(facts, "n_facts"), F.col("id") == F.col("_n_facts"), "left").join(n(coverages, "n_coverages"), F.col("id") == F.col("_n_coverages"), "left")
    rows = rows.select("id", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("n_coverages", F.lit(0)).alias("n_coverages"))
    return rows.withColumn("passed", (F.col("n_facts") == 0) & (F.col("n_coverages") == 0))


def corpus(compared: DataFrame) -> DataFrame:
    """One row: counts, and passed if there is a fixture and none failed."""
    rows = compared.agg(F.count("*").alias("fixtures"), F.count_if("passed").alias("n_passed"), F.coalesce(F.sum("n_facts"), F.lit(0)).alias("n_facts"), F.coalesce(F.sum("n_coverages"), F.lit(0)).alias("n_coverages"))
    return rows.withColumn("passed", (F.col("fixtures") > 0) & (F.col("n_passed") == F.col("fixtures")))
