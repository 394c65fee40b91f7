"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone.

Targets. The sources, by code point with null last, have the weights in turn and share a budget of words by them. A
source gets at most `most` times its own size; what it can't take the others share by weight. The level at which
that ends is found without repetition: with sources in ascending order of limit / weight, the first one whose limit
is above what the remaining budget gives it by weight, and all after it, take that level times their weight.

Sampling. Every document of a source has the same expected copies, target / size of the source. Documents are put in
order, expected copies are summed up along it, one offset for each source is added, and a document is taken once for
every whole number its stretch crosses. Documents stand by size within classes of sizes (two leading digits), so
that documents of like size share the whole numbers and the words taken come near the target.

The sum runs over chunks: (source, class of sizes, one of 64 buckets of the id's digest). Chunks are counted, the
counts summed up along a source (at most some 25,000 chunks for a source, however many documents), and places within
a chunk numbered; no source, however large, meets in one task.

Defined results: null text counts as empty, null source is a source of its own and the last; empty documents are taken
like others and count no words; rows repeated wholly are in a set order only up to their being equal; an empty table
gives an empty one; input columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MADE = ("size", "source_size", "target", "copies", "taken")
WORD = r"[^\x20\x09-\x0D]+"


def digits(value: Column, n: int) -> Column:
    """The first n hexadecimal digits of the MD5 digest, as a number."""
    return F.conv(F.substring(F.md5(value), 1, n), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(source, source_size), one row a source -> with weight and target."""
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    full = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole)
    place = F.row_number().over(full)  # sources that tie are filled in the order in which their limits are summed up
    level = (F.lit(float(budget)) * total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = sizes.withColumn("weight", weight).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    rows = rows.withColumns({"level": level, "place": place}).withColumn("open", F.col("limit") > F.col("level") * F.col("weight"))
    first = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(whole)["level"]
    return rows.withColumn("first", first).withColumn("target", F.least(F.col("limit"), F.coalesce(F.col("first") * F.col("weight"), F.col("limit")))).drop("limit", "level", "place", "open", "first")


def mix(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0, seed: int = 7, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """Columns of df but text, with size, source_size, target, copies and taken: one row for each row of df."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rest = [c for c in df.columns if c not in (*MADE, text)]
    rows = df.select(*rest, size.alias("size"))
    coarse = F.col("size") - F.col("size") % F.pow(F.lit(10.0), F.greatest(F.length(F.col("size").cast("string")) - 2, F.lit(0))).cast("long")
    rows = rows.withColumns({"_class": coarse, "_bucket": digits(F.coalesce(F.col(key).cast("string"), F.lit("")), 2) % 64, "_source": F.col(source)})
    rows = written(rows, "mix")  # the texts are read once; what follows reads numbers
    chunks = rows.groupBy("_source", "_class", "_bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    sizes = chunks.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size"))
    goal = targets(sizes, weights, budget, most).select(F.col("source").alias("_s"), "source_size", "target")
    along = Window.partitionBy("_source").orderBy("_class", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_before", F.coalesce(F.sum("n").over(along), F.lit(0))).join(goal, F.col("_source").eqNullSafe(F.col("_s")))
    chunks = chunks.select(F.col("_source").alias("_cs"), F.col("_class").alias("_cc"), F.col("_bucket").alias("_cb"), "_before", "source_size", "target")
    inside = Window.partitionBy("_source", "_class", "_bucket").orderBy("size", F.col(key).asc_nulls_last())
    rows = rows.withColumn("_place", F.row_number().over(inside))
    same = F.col("_source").eqNullSafe(F.col("_cs")) & (F.col("_class") == F.col("_cc")) & (F.col("_bucket") == F.col("_cb"))
    rows = rows.join(chunks, same)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = digits(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("null"))), 5) / F.lit(float(1 << 20))
    place = F.col("_before") + F.col("_place")
    copies = F.floor(offset + place * each) - F.floor(offset + (place - 1) * each)
    rows = rows.withColumn("copies", F.least(copies, F.ceil(each)).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.select(*rest, *MADE)


def emit(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """The mix itself: each row of df as often as it is taken, df's columns only. Rows are told apart by their place in a written table, so those that share a key (or have none) are each taken as often as their own share says."""
    rows = written(df.withColumn("_place_of", F.monotonically_increasing_id()), "mix-rows")  # numbers that stay, as the table is written
    taken = mix(rows.select("_place_of", key, text, source), text=text, source=source, key=key, **how)
    taken = taken.where("copies > 0").select(F.col("_place_of").alias("_taken"), F.col("copies").alias("_copies"))
    rows = rows.join(taken, F.col("_place_of") == F.col("_taken"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*df.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
c AS (SELECT *, size - size % (10 ** greatest(length(size::VARCHAR) - 2, 0))::BIGINT AS cls, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2))::BIGINT % 64 AS b FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2.0::DOUBLE * source_size AS lim FROM s),
l AS (SELECT *, source_size::DOUBLE / weight AS ratio, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(lim) OVER f, 0.0)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER f, 0))::DOUBLE AS lvl
  FROM w WINDOW f AS (ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, least(lim, coalesce((SELECT lvl FROM l WHERE lim > lvl * weight ORDER BY ratio, source ASC NULLS LAST LIMIT 1) * weight, lim)) AS target FROM l),
r AS (SELECT doc_id, c.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
  row_number() OVER (PARTITION BY c.source ORDER BY cls, b, size, doc_id NULLS LAST) AS k,
  ('0x' || substr(md5('7:' || coalesce('s' || c.source, 'null')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u
  FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, source_size, target, least(floor(u + k * e) - floor(u + (k - 1) * e), ceil(e))::BIGINT AS copies, (least(floor(u + k * e) - floor(u + (k - 1) * e), ceil(e)) * size)::BIGINT AS taken
FROM r
"""
