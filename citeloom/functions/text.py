"""Scalar functions over text, as column expressions that stay within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers' regular expressions have it (fixed values): Java's \s lacks the Unicode spaces.
WS = r"[\t\n\x0B\f\r    -     　﻿]"
#: Word boundaries over ASCII alone, since Java's \b counts accented letters as word characters.
B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


#: The same without the plain space.
ODD_WS = WS.replace("\\r ", "\\r", 1)
#: Both as cheap classes: Java asks every part of WS for every character, so two ranges that most characters are in are asked first.
_LONG, _ODD = rf"[[^!-~\u00a1-\u167f]&&{WS}]", rf"[[^ -~\u00a1-\u167f]&&{ODD_WS}]"
#: The characters of WS themselves, for trimming.
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, use) -> Column:
    """use(value), where value is evaluated once however often it is used: the optimizer doesn't paste it into a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize_ws(text: Column) -> Column:
    """Runs of white space become one space; none at the ends. Single spaces are left as they are."""
    return F.trim(F.regexp_replace(text, f" {_LONG}+|{_ODD}{_LONG}*", " "))


def code_units(text: Column) -> Column:
    """UTF-16 code units: characters beyond the basic plane become two."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    pair = lambda p: F.array((F.lit(0xD800) + F.floor((p - 0x10000) / 1024)).cast("int"), (F.lit(0xDC00) + (p - 0x10000) % 1024).cast("int"))
    return F.flatten(F.transform(points, lambda p: F.when(p > 0xFFFF, pair(p)).otherwise(F.array(p))))


def json_string(text: Column) -> Column:
    """The text as a JSON string literal."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), text, F.lit('"'))


def _rolling(units: Column, seed: int, factor: int, with_index: bool) -> Column:
    indexed = F.transform(units, lambda u, i: (u + i if with_index else u).cast("long"))
    return F.aggregate(indexed, F.lit(seed).cast("long"), lambda h, u: h.bitwiseXOR(u).bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(factor) % F.lit(1 << 32))


#: Fixed values of the stable hash's two halves.
SEEDS, FACTORS = (0x811C9DC5, 0x45D9F3B), (0x01000193, 0x27D4EB2D)


def stable_hash(canonical: Column) -> Column:
    """Two 32-bit multiplicative hashes over UTF-16 units of a canonical (JSON) string, as 16 hex digits. Seeds and factors are fixed values."""
    units = code_units(canonical)
    halves = _rolling(units, SEEDS[0], FACTORS[0], False), _rolling(units, SEEDS[1], FACTORS[1], True)
    return F.concat(*(F.lower(F.lpad(F.hex(h), 8, "0")) for h in halves))


def case_hash(canonical: Column) -> Column:
    """Two 32-bit multiplicative hashes as stable_hash(), with another seed and factor for the second (fixed values); its state is held signed, as the product of unsigned halves wouldn't fit 64 bits."""
    signed = lambda x: F.when(x >= (1 << 31), x - (1 << 32)).otherwise(x)
    units = F.transform(code_units(canonical), lambda u, i: (u + i).cast("long"))
    step = lambda h, u: signed(F.pmod(signed(h.bitwiseXOR(u).bitwiseAND(F.lit(0xFFFFFFFF))) * F.lit(0x85EBCA6B - (1 << 32)), F.lit(1 << 32)))
    second = F.pmod(F.aggregate(units, F.lit(0x9E3779B9 - (1 << 32)).cast("long"), step), F.lit(1 << 32))
    first = _rolling(code_units(canonical), 0x811C9DC5, 0x01000193, False)
    return F.concat(*(F.lower(F.lpad(F.hex(h), 8, "0")) for h in (first, second)))


def short_hash(text: Column) -> Column:
    """One 32-bit hash (offset basis and prime are fixed values), 8 hex digits."""
    return F.lower(F.lpad(F.hex(_rolling(code_units(text), 0x811C9DC5, 0x01000193, False)), 8, "0"))


def text_hash(text: Column) -> Column:
    return stable_hash(json_string(normalize_ws(text)))


def title_case(text: Column) -> Column:
    """Underscores and hyphens become spaces and each word's first letter a capital; the other letters stay."""
    words = F.split(F.regexp_replace(text, "[_-]+", " "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " ")


def id_part(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9_.:-]", "_")


def tokens(text: Column) -> Column:
    """Distinct lower-case terms of two characters or more, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9$.,%-]+"), lambda t: F.length(t) >= 2))


def lexical_relevance(text: Column, terms: Column) -> Column:
    """Share of the terms that the text holds somewhere."""
    share = lambda low: F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.size(terms)
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), let(F.lower(text), share)))


def amount(text: Column) -> Column:
    """The first dollar amount, else the first percentage, as a number."""
    dollars, percent = F.regexp_extract(text, r"\$\s*([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)\s*%", 1)
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("double")
    return F.when(dollars != "", number(dollars)).when(percent != "", number(percent))


def us_date_millis(text: Column) -> Column:
    """MM/DD/YY or MM/DD/YYYY at UTC midnight, in ms; two-digit years are 20xx and days run over into the next month."""

    def made(p: Column) -> Column:
        month, day, year = (F.element_at(p, i).cast("int") for i in (1, 2, 3))
        first = F.make_date(F.when(year < 100, year + 2000).otherwise(year), month, F.lit(1))
        return F.when(month.between(1, 12) & day.between(1, 31), F.unix_date(F.date_add(first, day - 1)).cast("long") * 86_400_000)

    parts = lambda t: F.when(t.rlike(r"^\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})\z"), F.split(t, "/"))
    return let(text, lambda t: let(parts(t), made))


def form_number(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?<![A-Za-z0-9_])([A-Z]{2,8} \d{2,5}(?: \d{2,4})?)(?![A-Za-z0-9_])", 1)
    return F.when(found != "", found)


def numeric_tokens(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d[\d,./:%-]*)"), 1), lambda t: F.regexp_replace(F.regexp_replace(t, r"^0+(?=\d)", ""), "[^0-9A-Za-z]", ""))
    return F.filter(found, lambda t: F.length(t) >= 2)


def identifier_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(rf"{B}((?=[A-Za-z0-9-]*\d)[A-Za-z0-9-]{{5,}}){B}"), 1)
    return F.transform(found, squeeze)


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def grounded(value: Column, evidence: Column) -> Column:
    """Whether the evidence holds every number and identifier of the value; true if there is none."""
    checkable, held = F.array_distinct(F.concat(numeric_tokens(value), identifier_tokens(value))), squeeze(evidence)
    return value.isNull() | (value == "") | F.forall(checkable, lambda t: F.contains(held, squeeze(t)))


def comparable_values(text: Column) -> Column:
    """Money, percentages and numbers without signs, then dates; distinct."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(rf"(\$?{B}\d{{1,3}}(?:,\d{{3}})*(?:\.\d+)?{B}%?)"), 1), lambda t: F.regexp_replace(t, r"[$,%\s]", ""))
    dates = F.regexp_extract_all(text, F.lit(rf"{B}(\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}){B}"), 1)
    return F.filter(F.array_union(numbers, dates), lambda t: t != "")


def states_claim(text: Column) -> Column:
    """Whether the text names an amount, a span of time, a date or a contractual term. A percent sign counts only where a word character follows, as the boundary after it has it."""
    number = rf"[$€£]{WS}?\d|{B}\d{{1,3}}(?:,\d{{3}})*(?:\.\d+)?{WS}?(?:%|percent|days?|months?|years?){B}"
    date = rf"{B}\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}{B}|{B}\d{{4}}-\d{{2}}-\d{{2}}{B}"
    month = rf"(?i){B}(?:january|february|march|april|may|june|july|august|september|october|november|december){WS}+\d{{1,2}},?{WS}+\d{{4}}{B}"
    terms = rf"{B}(?:shall|must|required|subject to|excluded|exclusion|condition|endorsement|deductible|limit|premium|retention){B}"
    return text.rlike(number) | text.rlike(date) | text.rlike(month) | F.lower(text).rlike(terms)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4)


def strip_fences(text: Column) -> Column:
    """A reply without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)^```(?:json)?\s*\n?", ""), r"\n?```\s*\z", "")


def id_list(text: Column) -> Column:
    """Ids given as a JSON list or between commas; none where the list can't be read."""
    t = F.trim(F.coalesce(text, F.lit("")))
    plain = F.filter(F.transform(F.split(t, ","), lambda x: F.trim(x)), lambda x: x != "")
    none = F.array().cast("array<string>")
    return F.when(t.startswith("["), F.coalesce(F.filter(F.from_json(t, "array<string>"), lambda x: x.isNotNull()), none)).otherwise(plain)


def schedule_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def schedule_value(values: Column, labels: tuple[str, ...]) -> Column:
    """Of an array of (label, value) the value of the first of `labels` that one is called, or that one's label holds."""
    keyed = F.filter(F.transform(values, lambda v: F.struct(schedule_key(v["label"]).alias("k"), v["value"].alias("v"))), lambda x: x["v"] != "")

    def called(name: str) -> Column:
        exact, near = F.filter(keyed, lambda x: x["k"] == name), F.filter(keyed, lambda x: F.contains(x["k"], F.lit(name)))
        return F.coalesce(F.try_element_at(exact, F.lit(-1))["v"], F.try_element_at(near, F.lit(1))["v"])

    return F.coalesce(*map(called, labels))


#: Kinds of entities, and other names of theirs and of parties' roles.
ENTITIES = ("corporation", "llc", "partnership", "sole_proprietor", "joint_venture", "trust", "nonprofit", "municipality", "individual", "married_couple", "other")
ENTITY_NAMES = {"inc": "corporation", "incorporated": "corporation", "c_corporation": "corporation", "s_corporation": "corporation", "limited_liability_company": "llc", "non_profit": "nonprofit"}
ROLE_NAMES = {"namedinsured": "named_insured", "insured": "named_insured", "managing_general_agent": "mga", "managing_general_underwriter": "mga", "third_party_administrator": "administrator"}


def entity_type(text: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(F.lower(normalize_ws(text)), "[^a-z0-9]+", "_"), r"^_+|_+\z", "")
    known = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ENTITY_NAMES.items() for x in kv)), key), key)
    return F.when(known.isin(*ENTITIES), known)


def party_role(text: Column) -> Column:
    key = F.regexp_replace(F.lower(text), r"[\s-]+", "_")
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ROLE_NAMES.items() for x in kv)), key), key)


def covered_reason(title: Column, kind: Column) -> Column:
    """Whether a section tells what is covered (fixed words)."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return (F.lower(F.coalesce(kind, F.lit(""))) == "covered_reason") | low.rlike("covered (?:cause|reason|peril)")
