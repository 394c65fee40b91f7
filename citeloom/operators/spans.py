"""Source spans: building, cleaning, merging and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def windows(df: DataFrame, key: str, text: str, most: int = 4000, overlap: int = 0) -> DataFrame:
    """Fixed windows of texts: key, idx, start, text. The last one ends where the text does."""
    step = most - min(max(overlap, 0), most - 1)
    n = F.length(text)
    count = F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil((n - F.lit(most)) / F.lit(step)) + 1)).cast("int")
    rows = df.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("_t"), F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))).alias("idx"))
    return rows.select(key, "idx", (F.col("idx") * step).alias("start"), F.col("_t").substr(F.col("idx") * step + 1, F.lit(most)).alias("text"))


#: Words that head a section of a page.
HEADING = rf"(?i)^(?:SECTION|COVERAGE|EXCLUSION|EXCLUSIONS|CONDITION|CONDITIONS|ENDORSEMENT|ENDORSEMENTS|DEFINITION|DEFINITIONS|DECLARATIONS?|SCHEDULE|FORM)(?![A-Za-z0-9_])"


def sections(df: DataFrame, key: str, text: str, heading: str = HEADING, least: int = 120) -> DataFrame:
    """Lines under a heading line, from it to the next: key, section (from 1), title (its first 120 characters), n_lines, text (one line), form_number. Lines before the first heading and sections of fewer than `least` characters are left out. Lines never leave their row: no shuffle."""
    lines = F.split(F.col(text), r"\r?\n")
    heads = lambda l: F.filter(F.sequence(F.lit(1), F.size(l)), lambda i: F.trim(F.element_at(l, i)).rlike(heading))

    def cut(l, h):
        stop = lambda k: F.coalesce(F.try_element_at(h, k + 2), F.size(l) + 1)
        return F.transform(h, lambda at, k: F.struct((k + 1).alias("section"), F.element_at(l, at).alias("head"), F.slice(l, at, stop(k) - at).alias("l")))

    found = T.let(lines, lambda l: T.let(heads(l), lambda h: F.when(F.size(h) > 0, cut(l, h))))
    rows = df.where(F.col(text).isNotNull()).select(F.col(key), F.explode(found).alias("s"))
    made = T.normalize_ws(F.array_join("s.l", "\n"))
    rows = rows.select(key, F.col("s.section").alias("section"), T.normalize_ws(F.col("s.head")).substr(1, 120).alias("title"), F.size("s.l").alias("n_lines"), F.element_at(F.array(made), 1).alias("text"))
    return rows.where(F.length("text") >= least).withColumn("form_number", T.form_number(F.col("text")))


#: What marks pages, forms, specimens and claims-made policies.
_FORM, _PAGE = r"[A-Z]{2,}(?:-[A-Z0-9]{2,})+\s+\d{2}\s+\d{2}", r"Page\s+\d+\s+of\s+\d+"
_SPECIMEN = r"SPECIMEN POLICY\s+[-\u2014]\s+FOR TESTING ONLY"
_CLAIMS_MADE = r"THIS IS A CLAIMS-MADE AND REPORTED POLICY\.? PLEASE READ IT CAREFULLY\.?"
_COLUMN = rf"{T.B}Column\s+\d+:\s*"


def boilerplate(cleaned, unit=None):
    """Whether normalised text only marks a page, a form or a specimen; of table rows also a short cell before a page mark."""
    whole = rf"(?i)^(?:{_SPECIMEN}|{_PAGE}|{_FORM}|{_FORM}\s*\|\s*{_PAGE})\z"
    row = rf"(?i)^[^|]{{0,40}}\|\s*{_PAGE}\z"
    told = lambda t: t.rlike(whole) if unit is None else t.rlike(whole) | (F.coalesce(unit == "table_row", F.lit(False)) & t.rlike(row))
    bare = F.when(cleaned.ilike("%column%"), T.normalize_ws(F.regexp_replace(cleaned, f"(?i){_COLUMN}", ""))).otherwise(cleaned)
    # all of these end with a digit, with ONLY, or with a column mark that is taken out: most texts need no pattern
    return F.when(F.right(cleaned, F.lit(1)).rlike("[0-9yY:]"), T.let(bare, told)).otherwise(F.lit(False))


def clean(text, unit=None):
    """A span's text without boilerplate, normalised; null if nothing else is in it."""
    inline = rf"(?i){T.B}(?:Column\s+\d+:\s*)?{_FORM}\s+(?:\|\s*)?(?:Column\s+\d+:\s*)?{_PAGE}{T.B}|{T.B}{_SPECIMEN}{T.B}|{T.B}{_PAGE}{T.B}"
    strip = lambda t: F.when(t.ilike("%page%of%") | t.ilike("%specimen%"), T.normalize_ws(F.regexp_replace(t, inline, " "))).otherwise(t)
    line = lambda t: boilerplate(t) | (t.ilike("%claims-made%") & t.rlike(rf"(?i)^{_CLAIMS_MADE}\z"))
    rest = lambda t: T.let(strip(t), lambda u: F.when((u != "") & ~line(u), u))
    # most texts hold none of these words and end as no mark does: they are kept as they are, without any pattern
    plain = lambda t: ~F.right(t, F.lit(1)).rlike("[0-9yY:]") & T.let(F.lower(t), lambda low: ~(F.contains(low, F.lit("page")) | F.contains(low, F.lit("specimen")) | F.contains(low, F.lit("claims-made"))))
    return T.let(T.normalize_ws(text), lambda t: F.when((t != "") & plain(t), t).when((t != "") & ~boilerplate(t, unit), rest(t)))


def drop_boilerplate(df: DataFrame, key: str, parent: str, pos: str, text: str, unit: str | None = None) -> DataFrame:
    """Spans with cleaned text. Empty and boilerplate spans go, and spans whose parent went earlier in the input (one level, as children that go so aren't parents of a further drop)."""
    cleaned = df.withColumn(text, clean(F.col(text), F.col(unit) if unit else None))
    parents = cleaned.where(F.col(text).isNull()).select(F.col(key).alias("_p"), F.col(pos).alias("_at"))
    return cleaned.where(F.col(text).isNotNull()).join(parents, (F.col(parent) == F.col("_p")) & (F.col("_at") < F.col(pos)), "left_anti")


def merge_runs(df: DataFrame, doc: str, pos: str, page: str, text: str, key: str | None = None, unit: str | None = None, element: str | None = None, stop: str | None = None) -> DataFrame:
    """Consecutive texts of a page that read on become one: doc, run, n_spans, text, and, if asked for, ids (of key), page and page_end.

    Whether one reads on shows at the end of the one before and at its own start. unit: only spans whose unit is text
    are joined; element: titles never are. Empty texts are left out.
    """
    w = Window.partitionBy(doc).orderBy(pos)
    rows = df.withColumn("_t", T.normalize_ws(F.col(text))).where("_t <> ''")
    left = F.lag("_t").over(w)
    closed = left.rlike(r"[:.;!?)]\z")
    heading = F.col("_t").rlike(rf"^(?:[A-Z][A-Z0-9 &/(),.-]{{8,}}|Item\s+\d+|Section\s+\d+|Part\s+[A-Z]{T.B})")
    open_end = left.rlike(rf"(?i){T.B}(?:a|an|and|any|as|at|by|for|from|in|into|may|must|of|or|that|the|this|to|with|within|you|your)\z")
    on = left.isNotNull() & F.lag(page).over(w).eqNullSafe(F.col(page)) & ~closed & ~heading & (F.col("_t").rlike(r"^[a-z(]") | open_end)
    if unit:
        on &= (F.lag(unit).over(w) == "text") & (F.col(unit) == "text")
    if element:
        title = F.coalesce(F.col(element) == "title", F.lit(False))
        on &= ~title & ~F.lag(title).over(w)
    rows = rows.withColumn("_new", (~F.coalesce(on, F.lit(False))).cast("int")).withColumn("run", F.sum("_new").over(w))
    held = [F.col(pos).alias("pos"), F.col("_t").alias("t"), F.col(page).alias("page")]
    held += [F.col(key).alias("id")] if key else []
    held += [F.coalesce(stop, page).alias("stop")] if stop else []
    grouped = rows.groupBy(doc, "run").agg(F.sort_array(F.collect_list(F.struct(*held))).alias("l"))
    more = [F.transform("l", lambda x: x["id"]).alias("ids")] if key else []
    more += [F.col("l")[0]["page"].alias("page"), F.element_at("l", -1)["stop"].alias("page_end")] if stop else []
    return grouped.select(doc, "run", F.size("l").alias("n_spans"), F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("text"), *more)


def _ties(df: DataFrame, pos: str):
    """pos, then a hash of the row: rows of equal pos have an order that stays (maps aside, which have none)."""
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.struct(F.col(pos).alias("p"), F.xxhash64(*plain).alias("h"))


def first_wins(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The earliest row of each key; of equal places always the same. Aggregates before it shuffles, so a key with many rows is no burden."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), _ties(df, pos)).alias("_r"))
    return best.select("_r.*")


def last_wins(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), _ties(df, pos)).alias("_r"))
    return best.select("_r.*")


def pack(df: DataFrame, doc: str, pos: str, length: str, most: int = 6000, joint: int = 2, extra: int = 0) -> DataFrame:
    """Greedy packing in order: doc, pos, chunk (from 0). A chunk ends where the next piece and a joint would make it longer than `most`; a longer piece stands alone. extra: what each piece takes beside its length.

    A document's pieces meet as places and lengths (16 bytes each); the fold keeps only where chunks begin.
    """
    start = F.struct(F.lit(0).cast("long").alias("size"), F.array().cast("array<bigint>").alias("begin"))

    def step(s, x):
        fits = (F.size(s["begin"]) > 0) & (s["size"] + x["n"] + joint <= most)
        return F.struct(F.when(fits, s["size"] + x["n"] + joint).otherwise(x["n"]).alias("size"), F.when(fits, s["begin"]).otherwise(F.concat(s["begin"], F.array(x["pos"]))).alias("begin"))

    piece = F.struct(F.col(pos).cast("long").alias("pos"), (F.col(length).cast("long") + extra).alias("n"))
    begins = df.groupBy(doc).agg(F.sort_array(F.collect_list(piece)).alias("l")).select(doc, F.posexplode(F.aggregate("l", start, step, lambda s: s["begin"])).alias("chunk", "_b"))
    begins = begins.select(F.col(doc).alias("_d"), "chunk", "_b")
    rows = df.select(F.col(doc), F.col(pos).cast("long").alias("pos"))
    marks = rows.withColumn("chunk", F.lit(None).cast("int")).unionByName(begins.select(F.col("_d").alias(doc), F.col("_b").alias("pos"), "chunk"))
    w = Window.partitionBy(doc).orderBy("pos", F.col("chunk").isNull())
    return marks.withColumn("c", F.max("chunk").over(w)).where("chunk IS NULL").select(doc, "pos", F.col("c").alias("chunk"))


def merge_metadata(df: DataFrame, group: str, pos: str, metadata: str, own: dict[str, str] | None = None) -> DataFrame:
    """Per group and key: the values joined by commas, in order. own: {key: column} whose last value that isn't null or empty replaces what was joined."""
    rows = df.select(group, pos, F.explode(metadata).alias("key", "value")).where("value IS NOT NULL")
    rows = rows.groupBy(group, "key").agg(F.sort_array(F.collect_list(F.struct(pos, "value"))).alias("l"))
    rows = rows.select(group, "key", F.array_join(F.transform("l", lambda x: x["value"]), ",").alias("value"))
    if not own:
        return rows
    last = df.groupBy(group).agg(*(F.max_by(c, F.when(F.col(c) != "", F.col(pos))).alias(k) for k, c in own.items()))
    last = last.select(F.col(group).alias("_g"), F.explode(F.create_map(*(x for k in own for x in (F.lit(k), F.col(k))))).alias("_k", "_v")).where("_v <> ''")
    both = rows.join(last, (F.col(group) == F.col("_g")) & (F.col("key") == F.col("_k")), "full")
    return both.select(F.coalesce(group, "_g").alias(group), F.coalesce("key", "_k").alias("key"), F.coalesce("_v", "value").alias("value"))
