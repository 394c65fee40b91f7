"""Operators over ordered rows: neighbours, runs, intervals, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_n(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group, numbered in order from 1."""
    rows = df.withColumn("_back", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("_back") <= n)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order))).drop("_back")


def coalesce_intervals(df: DataFrame, group: str, start: str, stop: str, gap: int = 1, bounds: DataFrame | None = None, lists: tuple[str, ...] = (), texts: tuple[str, ...] = ()) -> DataFrame:
    """Intervals that overlap or are at most `gap` apart become one: group, start, stop, n. bounds(group, low, high): intervals are first held within. lists: array columns whose distinct items are kept in order; texts: columns whose distinct values are joined by '; '."""
    if bounds is not None:
        df = df.join(bounds, group)
        low = F.greatest("low", F.least("high", start))
        df = df.withColumns({start: low, stop: F.greatest(low, F.least("high", stop))}).drop("low", "high")
    w = Window.partitionBy(group).orderBy(start, stop)
    seen = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.coalesce(F.col(start) > seen + gap, F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(w))
    kept = F.sort_array(F.collect_list(F.struct(F.col(start).alias("a"), F.col(stop).alias("b"), *lists, *texts))).alias("_l")
    rows = rows.groupBy(group, "_island").agg(F.min(start).alias("start"), F.max(stop).alias("stop"), F.count("*").alias("n"), *([kept] if lists or texts else []))
    for c in lists:
        rows = rows.withColumn(c, F.array_distinct(F.flatten(F.transform("_l", lambda x: F.coalesce(x[c], F.array().cast(df.schema[c].dataType))))))
    for c in texts:
        rows = rows.withColumn(c, F.array_join(F.array_distinct(F.filter(F.transform("_l", lambda x: x[c]), lambda t: t != "")), "; "))
    return rows.drop("_island", "_l")


def page_ranges(df: DataFrame, group: str, page: str) -> DataFrame:
    """Numbers as '1-3, 5'."""
    pages = df.select(group, page).distinct()
    runs = pages.withColumn("_k", F.col(page) - F.row_number().over(Window.partitionBy(group).orderBy(page))).groupBy(group, "_k").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    rows = runs.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("a", text.alias("t")))).alias("l"))
    return rows.select(group, F.array_join(F.transform("l", lambda x: x["t"]), ", ").alias("pages"))


def preceding(df: DataFrame, group: str, order: list[str], is_context, is_target, n: int) -> DataFrame:
    """For each target row, the n nearest context rows before it, nearest first. Context rows are numbered along their group; a target takes the numbers before its own: the join makes n rows a target at most, whatever the group's size."""
    w = Window.partitionBy(group).orderBy(*order)
    context, target = F.coalesce(is_context, F.lit(False)), F.coalesce(is_target, F.lit(False))
    rows = df.withColumns({"_c": context, "_t": target}).withColumn("_n", F.sum(F.col("_c").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = rows.where("_c").select(F.col(group).alias("_g"), F.col("_n").alias("_at"), F.struct(*order).alias("_o"))
    last = F.col("_n") - F.col("_c").cast("int")
    asked = rows.where("_t").withColumn("_id", F.struct(*order)).withColumn("_want", F.explode_outer(F.when(last > 0, F.sequence(last, F.greatest(last - (n - 1), F.lit(1)), F.lit(-1)))))
    found = asked.join(held, (F.col(group) == F.col("_g")) & (F.col("_want") == F.col("_at")), "left")
    grouped = found.groupBy(*df.columns).agg(F.sort_array(F.collect_list(F.struct("_at", "_o")), asc=False).alias("_l"))
    return grouped.select(*df.columns, F.transform(F.filter("_l", lambda x: x["_at"].isNotNull()), lambda x: x["_o"]).alias("context"))


def neighbours(df: DataFrame, group: str, order: list[str], anchor, width: int) -> DataFrame:
    """Rows within `width` places of an anchor row of their group."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-width, width)
    return df.withColumn("_near", F.max(anchor.cast("int")).over(w)).where("_near = 1").drop("_near")


def title_blocks(df: DataFrame, group: str, order: str, is_title) -> DataFrame:
    """Each row with the place of the title it stands under (null before the first)."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("title_at", F.last(F.when(is_title, F.col(order)), ignorenulls=True).over(w))


def duplicate_suffixes(df: DataFrame, base: str, order: str) -> DataFrame:
    """The nth row (n from 2) of a base id gets ':n'."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return df.withColumn("id", F.when(n > 1, F.concat_ws(":", base, n)).otherwise(F.col(base)))


def even_sample(items, limit: int):
    """Of an array at most `limit` items, evenly spread, first and last included; the first alone if the limit is one or less."""
    n = F.size(items)
    if limit <= 1:
        return F.slice(items, 1, 1)
    at = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.floor(i * (n - 1) / F.lit(limit - 1) + F.lit(0.5)).cast("int"))
    return F.when(n <= limit, items).otherwise(F.transform(at, lambda i: F.element_at(items, i + 1)))


def overlaps(left: DataFrame, right: DataFrame, key: str, start: str, stop: str, width: int) -> DataFrame:
    """Pairs of rows of equal key whose ranges [start, stop] overlap, ends included: the columns of both, those of right with an r_ before them.

    Each range stands in every bucket of `width` that it touches, and a pair is made only in the first bucket that both
    touch. So a key with many rows is split along its ranges, and no pair is made twice or lost at a bucket's edge.
    """
    own = lambda c: F.explode(F.sequence(F.floor(F.col(c[0]) / width), F.floor(F.col(c[1]) / width)))
    l = left.withColumn("_b", own((start, stop)))
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    r = r.withColumn("_rb", own((f"r_{start}", f"r_{stop}")))
    on = (F.col(key) == F.col(f"r_{key}")) & (F.col("_b") == F.col("_rb")) & (F.col(start) <= F.col(f"r_{stop}")) & (F.col(stop) >= F.col(f"r_{start}"))
    first = F.col("_b") == F.greatest(F.floor(F.col(start) / width), F.floor(F.col(f"r_{start}") / width))
    return l.join(r, on & first).drop("_b", "_rb")


def top_k(df: DataFrame, group: str | None, order: list, k: int) -> DataFrame:
    """The first k rows, of each group if there is one; ranks from 1. Without a group no task meets more than k rows of each other task."""
    if group is None:
        return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
