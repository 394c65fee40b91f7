"""Trees as adjacency lists (id, parent_id, ord): paths, ancestors, rollups of one level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut


def _descend(rows: DataFrame, level: DataFrame, most_depth: int) -> DataFrame:
    """level(id, path) with all below it, by rows(id, up, place): each level is written once and joined once."""
    rows, level = cut(rows), cut(level)
    out = level
    for _ in range(most_depth):
        level = cut(rows.join(level.withColumnRenamed("id", "_up"), F.col("up") == F.col("_up")).select("id", F.concat_ws(".", "path", "place").alias("path")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"deeper than {most_depth} levels")


def paths(nodes: DataFrame, most_depth: int = 200, by: str | None = None) -> DataFrame:
    """id, path: places among siblings (by ord, id) from the root, joined by dots. by: a column (the document) in which nodes are numbered for themselves; without it the table is one tree.

    nodes(id, parent_id, ord). Roots are the nodes without a parent. Nodes that no root reaches, as a parent above them
    is unknown or in a cycle, come after these in the order of (ord, id): each that isn't below an earlier one of them
    becomes a root, whose number is that of the document's nodes numbered before it, plus one; a cycle is cut where it was entered.
    """
    whole = nodes.select("id", "ord", F.col("parent_id").alias("up"), (F.col(by) if by else F.lit(0)).alias("doc"))
    place = F.row_number().over(Window.partitionBy("up", "doc").orderBy("ord", "id"))
    rows = cut(whole.withColumn("place", place.cast("string")))
    out = _descend(rows.select("id", "up", "place"), rows.where("up IS NULL").select("id", F.col("place").alias("path")), most_depth)
    left = cut(rows.join(out.select("id"), "id", "left_anti"))
    if left.isEmpty():
        return out
    left = cut(left.withColumn("idx", F.row_number().over(Window.partitionBy("doc").orderBy("ord", "id"))))
    roots = _first_of_line(left)
    below = left.join(roots.select(F.col("id").alias("_r")), F.col("id") == F.col("_r"), "left").select("id", F.when(F.col("_r").isNull(), F.col("up")).alias("up"), "place")
    found = _descend(below, roots.select("id", F.col("idx").cast("string").alias("path")), most_depth)
    found = found.join(left.select(F.col("id").alias("_i"), "doc"), F.col("id") == F.col("_i")).withColumn("top", F.substring_index("path", ".", 1).cast("int"))
    # in a document: what roots reach, then one tree after the other
    sizes = found.groupBy("doc", "top").agg(F.count("*").alias("_n"))
    reached = rows.groupBy(F.col("doc").alias("_d")).agg(F.count("*").alias("_all")).join(left.groupBy(F.col("doc").alias("_e")).agg(F.count("*").alias("_left")), F.col("_d").eqNullSafe(F.col("_e")))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("doc").orderBy("top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = sizes.withColumn("_b", before).join(reached, F.col("doc").eqNullSafe(F.col("_d"))).select(F.col("doc").alias("_of"), F.col("top").alias("_t"), (F.col("_b") + F.col("_all") - F.col("_left") + 1).cast("string").alias("_no"))
    more = found.join(numbers, F.col("doc").eqNullSafe(F.col("_of")) & (F.col("top") == F.col("_t")))
    return out.unionByName(more.select("id", F.concat("_no", F.expr("substring(path, length(cast(top AS string)) + 1)")).alias("path")))


def _first_of_line(left: DataFrame) -> DataFrame:
    """Those of left(id, up, idx) that have a smaller idx than every other above them (all of one document). By pointer doubling: after k rounds a node knows the smallest of the 2**k nodes above it."""
    known = left.select(F.col("id").alias("_k"), F.col("idx").alias("_x"))
    now = cut(left.join(known, F.col("up") == F.col("_k"), "left").select("id", "idx", F.col("_k").alias("at"), F.col("_x").alias("low")))
    for _ in range(max(1, now.count().bit_length())):
        other = now.select(F.col("id").alias("_i"), F.col("at").alias("_a"), F.col("low").alias("_l"))
        now = cut(now.join(other, F.col("at") == F.col("_i"), "left").select("id", "idx", F.col("_a").alias("at"), F.least("low", "_l").alias("low")))
    return now.where("low IS NULL OR low >= idx").select("id", "idx")


def ancestors(nodes: DataFrame, chosen: DataFrame, most_depth: int = 200) -> DataFrame:
    """ids of the chosen nodes and all above them. Each level is written once; what was seen isn't gone up from again, so cycles end."""
    up = cut(nodes.where("parent_id IS NOT NULL").select(F.col("id").alias("_id"), "parent_id"))
    level = out = cut(chosen.select("id").distinct())
    for _ in range(most_depth):
        level = level.join(up, F.col("id") == F.col("_id")).select(F.col("parent_id").alias("id")).distinct()
        level = cut(level.join(out, "id", "left_anti"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"deeper than {most_depth} levels")


def rollup_once(nodes: DataFrame, values: dict) -> DataFrame:
    """Parents with aggregates of their own children: one level, as a pass lifts evidence by one."""
    return nodes.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(*(f.alias(k) for k, f in values.items()))
