"""How many tokens a model call may give out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positive(c: Column) -> Column:
    return F.when(c > 0, F.floor(c))


def tokens_of(n_bytes: Column) -> Column:
    return F.ceil(positive(n_bytes) / 4)


def resolve(long_list: Column, hint: Column, constrained: Column, task: Column, long_lists: Column, least: Column, model_most: Column, hard: Column, provider: Column, input_bytes: Column, schema_bytes: Column, items: Column, input_most: Column) -> Column:
    """preferred, max_tokens, capped_by_model, capped_hard, risk (that the output is cut: low, medium or high) and input_near_limit.

    Preferred is the first that is given of the constraint, the task's and, for long lists, the model's long-list
    capability, and the hint (4,096); not below `least`, not above the model's and the hard or the provider's limit.
    """
    hinted = F.coalesce(positive(hint), F.lit(4096))
    preferred = F.coalesce(positive(constrained), positive(task), F.when(long_list, positive(long_lists)), hinted)
    wanted = F.greatest(preferred, F.coalesce(positive(least), preferred))
    held = F.least(wanted, F.coalesce(positive(model_most), wanted))
    limit = F.coalesce(positive(hard), positive(provider))
    final = F.least(held, F.coalesce(limit, held))
    floor = F.greatest(F.ceil(F.coalesce(tokens_of(schema_bytes), F.lit(0)) * 1.5), F.coalesce(positive(items), F.lit(0)) * F.when(long_list, 90).otherwise(45), F.floor(hinted * 0.75))
    no = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(preferred.alias("preferred"), final.alias("max_tokens"), no(wanted > positive(model_most)).alias("capped_by_model"), no(held > limit).alias("capped_hard"), F.when(final < floor * 0.65, "high").when(final < floor, "medium").otherwise("low").alias("risk"), no(tokens_of(input_bytes) > positive(input_most) * 0.9).alias("input_near_limit"))


def usage_totals(calls: DataFrame, *keys: str) -> DataFrame:
    """Totals of model calls(input_tokens, output_tokens, duration_ms; null where a call didn't report), of each key if there are any: calls, with_usage, without_usage, input_tokens, output_tokens, duration_ms."""
    told = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.count_if(told).alias("with_usage"), F.count_if(~told).alias("without_usage"), *map(total, ("input_tokens", "output_tokens", "duration_ms")))
