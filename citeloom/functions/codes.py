"""Codes: lines of business by name and by text, coverage codes by description. Code tables are given as data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: What text names which line of business. Several may apply. Last the words, in small letters, one of which any match holds: most texts hold none.
LINES = (
    ("CGL", r"\b(?:commercial\s+)?general\s+liability\b|\bcgl\b", "general cgl"),
    ("PROP", r"\bcommercial\s+property\b|\bproperty\s+insurance\b", "property"),
    ("PROP", r"\bproperty\b", "property"),
    ("AUTOB", r"\bcommercial\s+auto(?:mobile)?\b|\bbusiness\s+auto(?:mobile)?\b|\bauto(?:mobile)?\s+physical\s+damage\b", "auto"),
    ("AUTOB", r"\b(?:hired\s+(?:and\s+)?)?non[-\s]?owned\s+auto\b", "auto"),
    ("WORK", r"\bworkers['’]?\s+comp(?:ensation)?\b", "workers"),
    ("UMBRC", r"\bcommercial\s+umbrella\b|\bumbrella\s+liability\b", "umbrella"),
    ("EXLIA", r"\bexcess\s+liability\b", "excess"),
    ("PL", r"\bprofessional\s+liability\b", "professional"),
    ("EO", r"\berrors?\s*(?:and|&)\s*omissions?\b|\be&o\b", "omission e&o"),
    ("CYBER", r"\bcyber\b|\bnetwork\s+security\b|\bprivacy\s+liability\b", "cyber network privacy"),
    ("EPLI", r"\bemployment\s+practices?\s+liability\b|\bepli\b", "employment epli"),
    ("DO", r"\bdirectors?\s*(?:and|&)\s*officers?\b|\bd&o\b", "director d&o"),
    ("FIDUC", r"\bfiduciary\s+liability\b", "fiduciary"),
    ("CRIME", r"\bburglary\b", "burglary"),
    ("CRIM", r"\bcrime\b|\bemployee\s+dishonesty\b", "crime employee"),
    ("FIDTY", r"\bfidelity\b", "fidelity"),
    ("INMRC", r"\binland\s+marine\b|\bmotor\s+truck\s+cargo\b|\bcargo\s+legal\s+liability\b", "inland cargo"),
    ("INMRC", r"\bbuilders?\s+risk\b", "builder"),
    ("OLIB", r"\bpollution\s+liability\b|\benvironmental\s+liability\b", "pollution environmental"),
    ("COMR", r"\bocean\s+marine\b", "ocean"),
    ("SURE", r"\bsurety\b", "surety"),
    ("OLIB", r"\bproduct\s+liability\b|\bproducts?\s+completed\s+operations\b", "product"),
    ("BOP", r"\bbusiness\s*owners?\s+policy\b|\bbop\b", "business bop"),
    ("MGMLI", r"\bmanagement\s+liability\b", "management"),
    ("HOME", r"\bhomeowners?\s*(?:ho[-\s]?[35])?\b|\bho[-\s]?[35]\b", "ho"),
    ("HOME", r"\brenters?\b|\bho[-\s]?4\b", "renter ho"),
    ("HOME", r"\bcondo(?:minium)?\b|\bho[-\s]?6\b", "condo ho"),
    ("DFIRE", r"\bdwelling\s+fire\b", "dwelling"),
    ("MHOME", r"\bmobile\s+home\b|\bmanufactured\s+home\b", "mobile manufactured"),
    ("AUTOP", r"\bpersonal\s+auto\b", "personal"),
    ("UMBRP", r"\bpersonal\s+umbrella\b", "personal"),
    ("FLOOD", r"\bflood\b", "flood"),
    ("EQ", r"\bearthquake\b", "earthquake"),
    ("INMRP", r"\bpersonal\s+(?:articles|inland\s+marine)\b", "personal"),
    ("BOAT", r"\bwatercraft\b|\bboat\s+insurance\b", "watercraft boat"),
    ("RECV", r"\brecreational\s+vehicle\b|\brv\s+insurance\b", "recreational rv"),
    ("CFRM", r"\bfarm\b|\branch\b", "farm ranch"),
    ("TRVL", r"\btravel\s+(?:insurance|delay|disruption|expenses?)\b|\btrip\s+(?:cancellation|interruption|delay)\b", "travel trip"),
    ("TECH", r"\btechnology\s+(?:insurance|errors?\s*(?:and|&)\s*omissions?)\b", "technology"),
    ("MEDIA", r"\bmedia\s+(?:professional|liability)\b", "media"),
    ("UN", r"\blife\s+insurance\b|\bterm\s+life\b|\bwhole\s+life\b|\buniversal\s+life\b", "life"),
    ("DISAB", r"\bcritical\s+illness\b|\bdisability\s+insurance\b|\btotal\s+disability\b", "critical disability"),
    ("UN", r"\blong[-\s]?term\s+care\b|\bpet\s+insurance\b|\bidentity\s+theft\b|\btitle\s+insurance\b", "long pet identity title"),
)


def lines_of_text(text: Column) -> Column:
    """The codes whose words a text holds, each once, in the order of the rules. Rules are unrolled, in one pass over the rows; a pattern is tried only on texts that hold one of its words."""
    plain = T.normalize_ws(F.coalesce(text, F.lit("")))
    holds = lambda low, words: reduce(lambda x, y: x | y, (F.contains(low, F.lit(w)) for w in words.split()))
    rule = lambda t, low, code, p, words: F.when(holds(low, words) & t.rlike("(?i)" + p.replace(r"\b", T.B)), code)
    found = lambda t, low: F.array_distinct(F.array_compact(F.array(*(rule(t, low, *r) for r in LINES))))
    return T.let(plain, lambda t: T.let(F.lower(t), lambda low: found(t, low)))


def specific(codes: Column) -> Column:
    """Codes without UN."""
    return F.array_distinct(F.filter(codes, lambda c: c != "UN"))


def code_key(text: Column) -> Column:
    """How names of lines are compared."""
    bare = F.regexp_replace(F.replace(F.lower(F.trim(text)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "_")
    return F.regexp_replace(F.regexp_replace(bare, r"^_+|_+\z", ""), "_+", "_")


def resolve_lines(df: DataFrame, key: str, values: str, labels: DataFrame, legacy: DataFrame, old: DataFrame) -> DataFrame:
    """key, codes of df(key, values: an array of names or codes): each by the first that fits of labels(code, label), by code or by label, legacy(name, codes), the code in capitals, old(code, now); else UN. UN is left out if there is another. Whether a table is small enough to be broadcast is for the planner to tell."""
    rows = df.select(key, F.posexplode_outer(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v) != "")).alias("_i", "_v")).withColumns({"_t": F.trim("_v"), "_k": code_key(F.col("_v")), "_u": F.upper(F.trim("_v"))})
    small = lambda t, **c: t.select(*(F.col(v).alias(n) for n, v in c.items()))
    by_label = labels.groupBy(code_key(F.col("label")).alias("_lk")).agg(F.max_by("code", "code").alias("_lc"))
    rows = rows.join(small(labels, _c1="code"), F.col("_t") == F.col("_c1"), "left").join(by_label, F.col("_k") == F.col("_lk"), "left").join(small(legacy, _gk="name", _gc="codes"), F.col("_k") == F.col("_gk"), "left").join(small(labels, _c2="code"), F.col("_u") == F.col("_c2"), "left").join(small(old, _ok="code", _oc="now"), F.col("_u") == F.col("_ok"), "left")
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    rows = rows.withColumn("_x", F.coalesce(one("_c1"), one("_lc"), "_gc", one("_c2"), one("_oc"), F.array(F.lit("UN"))))
    all_ = rows.groupBy(key).agg(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda x: x["_x"]))).alias("codes"))
    return all_.select(key, F.when(F.size(specific(F.col("codes"))) > 0, specific(F.col("codes"))).otherwise(F.array(F.lit("UN"))).alias("codes"))


def resolve_profile(inferred: Column, hinted: Column, existing: Column) -> Column:
    """lines and source of a profile: what its coverages tell (six at most), else its own hint, else the lines there were, if they are specific."""
    told = lambda c: F.size(specific(c)) > 0
    made = lambda c, source: F.struct(c.alias("lines"), F.lit(source).alias("source"))
    return F.when(told(inferred), made(F.slice(inferred, 1, 6), "coverage")).when(told(hinted), made(hinted, "profile_hint")).when(told(existing), made(existing, "existing_hint")).otherwise(made(hinted, "default"))


def description_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(F.trim(text)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def resolve_coverage(df: DataFrame, code: str, description: str, table: DataFrame) -> DataFrame:
    """df with resolved: its code, in capitals, if table(code, description) has it; else the one code of its description, if there is only one."""
    known = table.select(F.col("code").alias("_kc")).distinct()
    one = table.groupBy(description_key(F.col("description")).alias("_dk")).agg(F.min("code").alias("_dc"), F.count_distinct("code").alias("_n")).where("_n = 1")
    rows = df.withColumns({"_u": F.upper(F.trim(code)), "_d": description_key(F.col(description))})
    rows = rows.join(known, F.col("_u") == F.col("_kc"), "left").join(one, F.col("_d") == F.col("_dk"), "left")
    return rows.withColumn("resolved", F.coalesce("_kc", "_dc")).drop("_u", "_d", "_kc", "_dk", "_dc", "_n")


def line_label(df: DataFrame, value: str, labels: DataFrame) -> DataFrame:
    """df with label: the label of its code, else the value made readable; and whether the value is a code."""
    rows = df.join(labels.select(F.col("code").alias("_c"), F.col("label").alias("_l")), F.trim(value) == F.col("_c"), "left")
    return rows.withColumns({"is_code": F.col("_c").isNotNull(), "label": F.coalesce("_l", T.title_case(F.trim(value)))}).drop("_c", "_l")
