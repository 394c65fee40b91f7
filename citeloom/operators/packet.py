"""The evidence that a profile is projected from: scores of spans and pages, anchors, their neighbours, and the packet in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import source as S

#: What speaks for a span, and by how much; \b stands for a boundary of ASCII words. The second of each says whether capitals count.
STREET = r"\b\d{1,6}\s+[A-Z0-9][^\n,]{1,80}\b(?:street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln|way|court|ct|highway|hwy)\b"
TOWN = r"\b[A-Za-z][A-Za-z .'-]+,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?\b"
SUMS = r"\$[\d,.]+|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|[0-9]{1,2}\s+[A-Za-z]{3,9}\s+[0-9]{4}"
ITEM = r"\bitem\s+\d+\.?\s*(?:named insured|policy number|policy period|renewal|form of business|coverage parts?|premium|extended reporting|producer|forms? and endorsements?)\b"
PLACES = r"\b(mailing address|business address|address|managing general (?:agent|underwriter)|mga|administrator|description of operations|operations description|nature of business|business description)\b"
SPAN_WEIGHTS = (
    (r"\b(policy\s*(number|period|term)|effective date|expiration date|expiry date|named insured|insurer|carrier|security|broker|producer|premium|total due)\b", False, 12),
    (PLACES, False, 12),
    (STREET, False, 10),
    (TOWN, True, 10),
    (r"\b(coverage part|limit(?:s)? of liability|deductible|retention|retroactive date|aggregate|sublimit|sub-limit|each claim|each loss|each occurrence|coinsurance)\b", False, 14),
    (r"\bendorsement\s+(?:no\.?|number|#)?\s*[A-Z0-9]|forms? and endorsements?|attached at inception|schedule\b", False, 8),
    (ITEM, False, 10),
    (SUMS, True, 3),
)
PAGE_WEIGHTS = (
    (r"\bdeclarations?\s+(page|schedule)?\b", False, 24),
    (r"\bitem\s+\d+\.?\s*(?:named insured|policy number|policy period|coverage parts?|limits?|premium|producer|forms? and endorsements?)\b", False, 20),
    (r"\bcoverage parts?,?\s+limits? of liability,?\s+deductibles?,?\s+and retroactive dates\b", False, 24),
    (r"\b(policy\s*(number|period|term)|effective date|expiration date|expiry date|named insured|insurer|carrier|security)\b", False, 12),
    (r"\b(premium|total due|tax|fee|producer|broker)\b", False, 10),
    (r"\b(mailing address|business address|managing general (?:agent|underwriter)|mga|administrator|description of operations|operations description|nature of business|business description)\b", False, 16),
    (r"\b(endorsement\s+(?:no\.?|number|#)?\s*[A-Z0-9]|attached at inception|forms? and endorsements?)\b", False, 8),
    (r"\b(definitions?|exclusions?|conditions?|duties in the event|action against|cancellation by)\b", False, -12),
)
LEAST, PAGES, ANCHOR, WIDE, SURE, LONG = 18, 12, 8, 24, 30, 3000
SCHEDULE = (
    r"\bitem\s+\d+\.?\s*(?:named insured|policy number|policy period|renewal|form of business|coverage parts?|limits?|premium|extended reporting|producer|forms? and endorsements?)\b",
    r"\bforms? and endorsements attached at inception\b",
    r"\bcoverage parts?,?\s+limits? of liability,?\s+deductibles?,?\s+and retroactive dates\b",
    r"\bannual premium\s*\(all coverage parts?\)",
    r"\berp option\b",
    r"\bproducer\b[\s\S]{0,240}\blicense\b",
)
PAGE_ANCHOR = r"\b(declarations?|named insured|policy number|policy period|effective date|expiration date|premium|total due|producer|mailing address|mga|administrator|description of operations|nature of business|business description)\b"
ANCHORS = (
    (ITEM, False),
    (r"\b(policy\s*(number|period)|effective date|expiration date|expiry date|named insured|insurer|carrier|broker|producer|premium|total due)\b", False),
    (PLACES, False),
    (STREET, False),
    (TOWN, True),
    (r"\b(coverage part|forms? and endorsements?|attached at inception|endorsement\s+(?:no\.?|number|#)?\s*[A-Z0-9])\b", False),
    (SUMS, True),
)
#: Kinds of nodes that a prompt always takes, words by which it takes others, and how many of them.
PROMPT_KINDS = ("page_group", "form", "endorsement", "schedule", "table", "table_row", "table_cell")
PROMPT_WORDS = r"\b(policy\s*(number|period|program)|product\s*(code|name)|plan\s*name|named insured|insurer|carrier|broker|producer|managing general (?:agent|underwriter)|mga|administrator|mailing address|description of operations|operations description|nature of business|business description|premium|coverage|limit|liability|deductible|retention|retroactive|aggregate|sublimit|sub-limit|endorsement)\b"
PROMPT_NODES = 420


def holds(text: Column, pattern: str, exact: bool = False) -> Column:
    return text.rlike(("" if exact else "(?i)") + pattern.replace(r"\b", T.B))


def _sum(text: Column, weights) -> Column:
    total = F.lit(0)
    for pattern, exact, weight in weights:
        total = total + F.when(holds(text, pattern, exact), weight).otherwise(0)
    return total


def span_score(spans: DataFrame) -> Column:
    """How much a span says of the policy; its unit counts too."""
    own, element = S.has(spans, "source_unit"), S.meta(spans, "elementType")
    said = T.normalize_ws(F.concat_ws(" ", "text", S.has(spans, "form_number"), own, element, S.meta(spans, "sourceUnit")))
    unit = F.when(own.isin("table_row", "table"), 5).otherwise(0) + F.when(element == "title", 4).otherwise(0) - F.when(own == "page", 3).otherwise(0)
    return T.let(said, lambda t: F.when(t == "", 0).otherwise(unit + _sum(t, SPAN_WEIGHTS)))


def page_scores(spans: DataFrame) -> DataFrame:
    """document_id, page, score, rank of the pages whose spans' scores, where above 0, sum up to 18 or more: the best twelve."""
    said = T.normalize_ws(F.concat_ws(" ", "text", S.has(spans, "form_number"), S.unit(spans)))
    score = T.let(said, lambda t: F.when(t == "", 0).otherwise(F.greatest(F.lit(0), F.col("_s")) + _sum(t, PAGE_WEIGHTS)))
    rows = spans.withColumns({"page": S.page_start(spans), "_s": span_score(spans)}).where("page IS NOT NULL").select("document_id", "page", score.alias("_v"))
    sums = rows.where("_v > 0").groupBy("document_id", "page").agg(F.sum("_v").alias("score")).where(F.col("score") >= LEAST)
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("score"), "page"))).where(F.col("rank") <= PAGES)


def is_anchor(spans: DataFrame) -> Column:
    """Whether evidence is taken around a span: tables and rows always, cells never, others by their words."""
    unit = S.unit(spans)
    said = T.normalize_ws(F.concat_ws(" ", "text", S.has(spans, "form_number")))
    of_page = lambda t: holds(t, "|".join(f"(?:{p})" for p in SCHEDULE)) | holds(t, PAGE_ANCHOR)
    other = lambda t: holds(t, "|".join(f"(?:{p})" for p, exact in ANCHORS if not exact)) | holds(t, "|".join(f"(?:{p})" for p, exact in ANCHORS if exact), True)
    return F.coalesce(F.when(unit == "table_cell", False).when(unit.isin("table", "table_row"), True).otherwise(T.let(said, lambda t: F.when(t == "", False).when(unit == "page", of_page(t)).otherwise(other(t)))), F.lit(False))


def evidence(spans: DataFrame) -> DataFrame:
    """document_id, span_id, page, text, place: the anchors that score 8 or more on the chosen pages (or 30 anywhere), with one neighbour on each side on their page, or two from 24 on, and the spans of their tables; each text of a page once, details before pages, cells left out."""
    w = Window.partitionBy("document_id").orderBy(F.coalesce(S.page_start(spans), F.lit(S.LATE)), F.coalesce(S.has(spans, "char_start", "long"), F.lit(S.LATE)), "id")
    rows = spans.withColumns({"_page": S.page_start(spans), "_score": span_score(spans), "_is": is_anchor(spans), "_unit": S.unit(spans), "_table": S.table_of(spans), "_own": S.has(spans, "source_unit"), "_text": T.normalize_ws(F.col("text")), "_i": F.row_number().over(w)})
    chosen = page_scores(spans).select(F.col("document_id").alias("_cd"), F.col("page").alias("_cp"))
    rows = rows.join(chosen, (F.col("document_id") == F.col("_cd")) & (F.col("_page") == F.col("_cp")), "left")
    any_ = F.max(F.col("_cp").isNotNull()).over(Window.partitionBy("document_id"))
    rows = rows.withColumn("_in", ~any_ | F.col("_page").isNull() | F.col("_cp").isNotNull() | (F.col("_score") >= SURE))
    rows = rows.withColumn("_anchor", F.col("_is") & (F.col("_score") >= ANCHOR) & F.col("_in"))
    by_page = Window.partitionBy("document_id", "_page").orderBy("_i")
    near = F.max((F.col("_anchor")).cast("int")).over(by_page.rowsBetween(-1, 1)) == 1
    wide = F.max((F.col("_anchor") & (F.col("_score") >= WIDE)).cast("int")).over(by_page.rowsBetween(-2, 2)) == 1
    of_table = F.max((F.col("_anchor") & (F.col("_unit") != "table_cell")).cast("int")).over(Window.partitionBy("document_id", "_table")) == 1
    short = (F.col("_text") != "") & (F.length("_text") <= LONG)
    cell = F.coalesce(F.col("_unit") == "table_cell", F.lit(False))
    rows = rows.withColumn("_take", short & ~cell & ((F.col("_in") & (near | wide)) | (F.col("_table").isNotNull() & of_table))).where("_take")
    once = F.row_number().over(Window.partitionBy("document_id", "_page", F.lower("_text").substr(1, 240)).orderBy("_i"))
    rows = rows.withColumn("_k", once).where("_k = 1")
    paged = F.coalesce(F.col("_unit") == "page", F.lit(False))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy(paged, "_i")))
    return rows.select("document_id", F.col("id").alias("span_id"), F.col("_page").alias("page"), F.col("_text").substr(F.lit(1), F.when(F.col("_own") == "page", 900).otherwise(700)).alias("text"), "place")


def prompt_nodes(nodes: DataFrame) -> DataFrame:
    """document_id, id, place of the first 420 nodes of each document that a prompt takes: of certain kinds, or by their words."""
    said = F.concat_ws(" ", "title", "path", "description", "text_excerpt")
    rows = nodes.where((F.col("kind") != "document") & (F.col("kind").isin(*PROMPT_KINDS) | holds(said, PROMPT_WORDS)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("ord", "id"))).where(F.col("place") <= PROMPT_NODES).select("document_id", "id", "place")
