"""Chunks of validated documents: one row for each fact that can be searched.

A document is JSON of any shape. A family says where its items lie and how one reads; families are unrolled into plain
expressions when the plan is built, a table of documents is scanned once and nothing is shuffled.

A line is a template, or a bare key whose label follows from it (yearBuilt: 'Year Built: ...'). In a template {key} wants a
value that counts (not missing, '', 0 or false), {key!} one that isn't missing; a line without such a value is left out. <...>
around a key makes it and the text beside it optional. {a|b} takes the first that counts, {a~Word} falls back to 'Word n', ^key is
of the item above, {} is an item that is plain text, {key:how} says how: yesno, address, titles, or what joins a list. 'each key:
template' gives a line for each element, 'each *:' for each text of an object.

Keys of an object come in order of their names. A line whose value is missing is left out, also where it is expected. A text
that isn't a JSON object gives no chunk.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACT, PLACE = "structured_fact", "navigation"


@dataclass(frozen=True)
class Family:
    """suffix of the id ({i}, {j}: positions; {n}: running number of the supplement), chunk type, where the items lie (a.b: within each a; '': the document itself),
    lines and metadata (name=key, name='text' or a key); evidence: kind, if it is told; only: type of document ('!policy': any other); needs: a list that must not be empty;
    least: lines that must be there; rank: place among the supplement's families."""

    suffix: str
    type: str
    over: str
    lines: str
    metadata: str
    evidence: str = FACT
    only: str = ""
    needs: str = ""
    least: int = 0
    rank: int = 0


SOURCE = "sourceSpanIds=sourceSpanIds:, sourceTextHash documentNodeId"
PARTY = "relationship\nscope\nAddress: {address:address}"

#: Labels, keys, ids and metadata names of chunks.
FAMILIES = [
    Family("carrier_info:0", "carrier_info", "", """Carrier: {carrier!}
Legal Name: {carrierLegalName}
NAIC: {carrierNaicNumber}
AM Best: {carrierAmBestRating}
Admitted Status: {carrierAdmittedStatus}
MGA: {mga}
underwriter
Broker: {brokerAgency}
Broker Contact: {brokerContactName}
Broker License: {brokerLicenseNumber}
Program: {programName}
Prior Policy: {priorPolicyNumber}
Renewal: {isRenewal!:yesno}
Package: {isPackage!:yesno}
security
Lines of Business: {linesOfBusiness:, }""", "carrier"),
    Family("declaration:summary", "declaration", "", "Policy Summary: {summary}", "", least=1),
    Family("declaration:policy_details", "declaration", "", """Policy Number: {policyNumber!}
Effective Date: {effectiveDate!}
expirationDate
Term Type: {policyTermType}
effectiveTime
nextReviewDate""", "policyNumber effectiveDate expirationDate", only="policy"),
    Family("declaration:quote_details", "declaration", "", "Quote Number: {quoteNumber!}\nproposedEffectiveDate\nproposedExpirationDate\nquoteExpirationDate", "quoteNumber", only="!policy"),
    Family("party:insurer", "party", "insurer", """Insurer: {legalName!}
NAIC: {naicNumber}
AM Best Rating: {amBestRating}
AM Best Number: {amBestNumber}
admittedStatus
State of Domicile: {stateOfDomicile}""", "partyRole='insurer' partyName=legalName"),
    Family("party:producer", "party", "producer", """Producer/Broker: {agencyName!}
Contact: {contactName}
License: {licenseNumber}
phone
email
Address: {address:address}""", "partyRole='producer' partyName=agencyName"),
    Family("named_insured:0", "named_insured", "", """Insured: {insuredName!}
DBA: {insuredDba}
Entity Type: {insuredEntityType}
FEIN: {insuredFein}
SIC: {insuredSicCode}
NAICS: {insuredNaicsCode}
Address: {insuredAddress:address}""", "insuredName"),
    Family("named_insured:{i+1}", "named_insured", "additionalNamedInsureds", "Additional Named Insured: {name!}\nAddress: {address:address}\nrelationship", "insuredName=name role='additional_named_insured'"),
    Family("coverage:{i}", "coverage", "coverages", """Coverage: {name!}
Limit: {limit!}
Limit Type: {limitValueType}
deductible
Deductible Type: {deductibleValueType}
Source: {originalContent}""", "coverageName=name limit limitValueType deductible deductibleValueType formNumber pageNumber sectionRef"),
    Family("coverage:enriched:{i}", "coverage", "enrichedCoverages", """Coverage: {name!}
Code: {coverageCode}
Limit: {limit!}
limitType
deductible
deductibleType
SIR: {sir}
sublimit
coinsurance
valuation
territory
trigger
retroactiveDate
Included: {included:flag}
premium
Source: {originalContent}""", "coverageName=name coverageCode limit deductible formNumber pageNumber included"),
    Family("coverage:limit_schedule", "coverage", "limits", """Limit Schedule
perOccurrence
generalAggregate
Products/Completed Ops Aggregate: {productsCompletedOpsAggregate}
Personal & Advertising Injury: {personalAdvertisingInjury}
eachEmployee
fireDamage
medicalExpense
combinedSingleLimit
bodilyInjuryPerPerson
bodilyInjuryPerAccident
propertyDamage
Umbrella Each Occurrence: {eachOccurrenceUmbrella}
umbrellaAggregate
umbrellaRetention
Statutory: {statutory:yesno}
each employersLiability: Employers Liability — Each Accident: {eachAccident!}, Disease Policy Limit: {diseasePolicyLimit!}, Disease Each Employee: {diseaseEachEmployee!}
defenseCostTreatment""", "coverageName='limit_schedule'"),
    Family("coverage:sublimit:{j}", "coverage", "limits.sublimits", "Sublimit: {name!}\nLimit: {limit!}\nappliesTo\ndeductible", "coverageName=name limit"),
    Family("coverage:shared_limit:{j}", "coverage", "limits.sharedLimits", "Shared Limit: {description!}\nLimit: {limit!}\nCoverage Parts: {coverageParts!:, }", "coverageName=description limit"),
    Family("coverage:deductible_schedule", "coverage", "deductibles", """Deductible Schedule
perClaim
perOccurrence
Aggregate: {aggregateDeductible}
Self-Insured Retention: {selfInsuredRetention}
Corridor: {corridorDeductible}
waitingPeriod
appliesTo""", "coverageName='deductible_schedule'", least=2),
    Family("coverage:claims_made_details", "coverage", "", """coverageForm
retroactiveDate
each extendedReportingPeriod: Extended Reporting Period (Basic): {basicDays} days
each extendedReportingPeriod: Extended Reporting Period (Supplemental): {supplementalYears} years
each extendedReportingPeriod: Extended Reporting Period Premium: {supplementalPremium}""", "coverageName='claims_made_details'", least=1),
    Family("declaration:form:{i}", "declaration", "formInventory", "Form: {formNumber!}\ntitle\nType: {formType!}\nEdition: {editionDate}\nPages: {pageStart}<-{pageEnd}>", "formNumber formType documentNodeId sourceSpanIds=sourceSpanIds:,"),
    Family("endorsement:{i}", "endorsement", "endorsements", """Endorsement: {title!}
Form: {formNumber}
Edition: {editionDate}
Type: {endorsementType!}
effectiveDate
Affected Coverage Parts: {affectedCoverageParts:, }
Key Terms: {keyTerms:; }
premiumImpact
excerpt""", f"endorsementType formNumber pageStart pageEnd {SOURCE}", least=1),
    Family("exclusion:{i}", "exclusion", "exclusions", "Exclusion: {name!}\n{content!}", "formNumber pageNumber documentNodeId sourceSpanIds=sourceSpanIds:,"),
    Family("condition:{i}", "condition", "conditions", "Condition: {name!}\nType: {conditionType!}\n{content!}\neach keyValues: {key!}: {value!}", "conditionName=name conditionType pageNumber documentNodeId sourceSpanIds=sourceSpanIds:,"),
    Family("definition:{i}", "definition", "definitions", "Definition: {term|name|title~Definition}\n{definition|content|text|meaning}\nSource: {originalContent|source}", f"term=term|name|title~Definition formNumber formTitle pageNumber sectionRef=sectionRef|sectionTitle {SOURCE}"),
    Family("covered_reason:{i}", "covered_reason", "coveredReasons|covered_reasons", """Coverage: {coverageName|coverage|coveragePart}
Reason Number: {reasonNumber|number}
Covered Reason: {title|name|reason|peril|cause~Covered_Reason}
{content|description|text|coverageGrant}
Source: {originalContent|source}""", f"coverageName=coverageName|coverage|coveragePart reasonNumber=reasonNumber|number title=title|name|reason|peril|cause~Covered_Reason formNumber formTitle pageNumber sectionRef=sectionRef|sectionTitle {SOURCE}"),
    Family("covered_reason:{i}:condition:{j}", "covered_reason", "coveredReasons|covered_reasons.conditions", """Coverage: {^coverageName|^coverage|^coveragePart}
Reason Number: {^reasonNumber|^number}
Covered Reason Condition: {^title|^name|^reason|^peril|^cause~Covered_Reason}
{}""", "coverageName=^coverageName|^coverage|^coveragePart reasonNumber=^reasonNumber|^number title=^title|^name|^reason|^peril|^cause~Covered_Reason conditionIndex=#j formNumber=^formNumber formTitle=^formTitle pageNumber=^pageNumber sectionRef=^sectionRef|^sectionTitle"),
    Family("declaration:0", "declaration", "declarations", "Declarations\neach *: ", "formType declarationLine=line", least=2),
    Family("section:{i}", "section", "sections", """Section: {title!}
Type: {type!}
sectionNumber
Pages: {pageStart!}<-{pageEnd}>
excerpt
Subsections: {subsections:titles}""", f"sectionType=type sectionNumber pageStart pageEnd hasSubsections=subsections:some {SOURCE}", PLACE),
    Family("section:{i}:sub:{j}", "section", "sections.subsections", "Section: {^title!} > {title!}\nsectionNumber\nPage: {pageNumber}\nexcerpt", f"sectionType=^type parentSection=^title sectionNumber pageNumber {SOURCE}", PLACE),
    Family("section:outline:{i}", "section", "documentOutline", """Document Outline: {title|originalTitle~Document_Node}
Label: {label|type}
Pages: {pageStart!}<-{pageEnd!}>
{excerpt|content}
Children: {children:titles}""", f"documentNodeId=id sectionType=type|label pageStart pageEnd {SOURCE.replace(' documentNodeId', '')}", PLACE),
    Family("location:{i}", "location", "locations", """Location {number!}: {address!:address}
description
occupancy
Construction: {constructionType}
yearBuilt
squareFootage
protectionClass
Sprinklered: {sprinklered!:yesno}
Alarm: {alarmType}
buildingValue
contentsValue
businessIncomeValue""", "locationNumber=number occupancy constructionType", ""),
    Family("vehicle:{i}", "vehicle", "vehicles", """Vehicle {number!}: {year!} {make!} {model!}
VIN: {vin!}
Type: {vehicleType}
costNew
statedValue
garageLocation
radius
each coverages: {type!}: <Limit {limit}, ><Ded {deductible}, >{included:inout}""", "vehicleNumber=number vehicleYear=year vehicleMake=make vehicleModel=model vin", ""),
    Family("classification:{i}", "classification", "classifications", "Classification: {code!} — {description!}\nPremium Basis: {premiumBasis!}\nbasisAmount\nrate\npremium\nLocation: {locationNumber}", "classCode=code classDescription=description locationNumber", ""),
    Family("party:additional_insured:{i}", "party", "additionalInsureds", f"Additional Insured: {{name!}}\nRole: {{role!}}\n{PARTY}", "partyRole='additional_insured' partyName=name", ""),
    Family("party:loss_payee:{i}", "party", "lossPayees", f"Loss Payee: {{name!}}\n{PARTY}", "partyRole='loss_payee' partyName=name", ""),
    Family("party:mortgage_holder:{i}", "party", "mortgageHolders", f"Mortgage Holder: {{name!}}\n{PARTY}", "partyRole='mortgage_holder' partyName=name", ""),
    Family("premium:0", "premium", "", "premium\ntotalCost\nminimumPremium\ndepositPremium\nauditType", "premium", "", needs="premium"),
    Family("financial:taxes_fees", "financial", "", "each taxesAndFees: <[{type}] >{name!}: {amount!}<\\n  {description}>", "financialCategory='taxes_fees'", "", least=1),
    Family("financial:payment_plan", "financial", "paymentPlan", "Payment Plan:\neach installments: {dueDate!}: {amount!}< ({description})>\nfinanceCharge", "financialCategory='payment_plan'", "", needs="installments"),
    Family("financial:location_premium:{i}", "financial", "premiumByLocation", "Location {locationNumber!} Premium: {premium!}\ndescription", "financialCategory='location_premium' locationNumber", ""),
    Family("financial:rating_basis", "financial", "", "each ratingBasis: Rating Basis: {type!}< | Amount: {amount}>< | Description: {description}>", "financialCategory='rating_basis'", "", least=1),
    Family("loss_history:summary", "loss_history", "lossSummary", "Loss Summary\nperiod\nTotal Claims: {totalClaims!}\ntotalIncurred\ntotalPaid\ntotalReserved\nlossRatio", "lossHistoryCategory='summary'", ""),
    Family("loss_history:claim:{i}", "loss_history", "individualClaims", "Claim: {dateOfLoss!}\nClaim #: {claimNumber}\nDescription: {description!}\nStatus: {status!}\nclaimant\ncoverageLine\npaid\nreserved\nincurred", "lossHistoryCategory='claim' claimNumber claimStatus=status dateOfLoss", ""),
    Family("loss_history:experience_mod", "loss_history", "experienceMod", "Experience Modification Factor: {factor!}\neffectiveDate\nstate", "lossHistoryCategory='experience_mod'", ""),
    Family("subjectivity:{i}", "subjectivity", "enrichedSubjectivities|subjectivities", "Subjectivity: {description!}\ncategory\ndueDate\nstatus", "category status", "", "quote"),
    Family("underwriting_condition:{i}", "underwriting_condition", "enrichedUnderwritingConditions|underwritingConditions", "Underwriting Condition: {description!}\ncategory", "", "", "quote"),
    Family("financial:premium_breakdown", "financial", "", "each premiumBreakdown: {line!}: {amount!}", "financialCategory='premium_breakdown'", "", "quote", least=1),
    Family("financial:binding_authority", "financial", "bindingAuthority", "Binding Authority\nauthorizedBy\nmethod\nexpiration\neach conditions: Condition: {}", "financialCategory='binding_authority'", "", "quote"),
    Family("underwriting_condition:warranty:{i}", "underwriting_condition", "warrantyRequirements", "Warranty Requirement: {}", "conditionCategory='warranty'", "", "quote"),
    Family("underwriting_condition:loss_control:{i}", "underwriting_condition", "lossControlRecommendations", "Loss Control Recommendation: {}", "conditionCategory='loss_control'", "", "quote"),
    Family("supplementary:{n}", "supplementary", "", "each claimsContacts: Claims Contact: {name|phone|email|hours:bar}", "supplementaryCategory='claims_contacts'", "", least=1),
    Family("supplementary:{n}", "supplementary", "", "each regulatoryContacts: Regulatory Contact: {name|phone|email:bar}", "supplementaryCategory='regulatory_contacts'", "", least=1, rank=1),
    Family("supplementary:{n}", "supplementary", "", "each thirdPartyAdministrators: TPA: {name|phone|email:bar}", "supplementaryCategory='third_party_administrators'", "", least=1, rank=2),
    Family("supplementary:{n}", "supplementary", "", "Cancellation Notice Days: {cancellationNoticeDays!}\nNonrenewal Notice Days: {nonrenewalNoticeDays!}", "supplementaryCategory='notice_periods'", "", least=1, rank=3),
    Family("supplementary:{n+i}", "supplementary", "supplementaryFacts", "<Subject: {subject} | >{key!}: {value!}< | Context: {context}>", "supplementaryCategory='auxiliary_fact' factKey=key factSubject=subject", "", rank=4),
]
SUPPLEMENT = ["claimsContacts", "regulatoryContacts", "thirdPartyAdministrators"]  # lists that each take a number of the supplement
NOTICES = ["cancellationNoticeDays", "nonrenewalNoticeDays"]  # together they take the next

OPTIONAL, COUNTS, THERE = 0, 1, 2
TOKEN = re.compile(r"<([^<>{}]*)\{([^{}]*)\}([^<>{}]*)>|\{([^{}]*)\}")


def label(key: str) -> str:
    return " ".join(w[:1].upper() + w[1:] for w in re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+", key))


def _piece(said: str, pre: str = "", post: str = "", need: int | None = None) -> tuple:
    said, _, how = said.partition(":")
    said, _, fall = said.partition("~")
    there = said.endswith("!")
    return pre, said.removesuffix("!").split("|"), how, (OPTIONAL if need == OPTIONAL else THERE if there else COUNTS), fall.replace("_", " "), post


def _line(said: str) -> tuple:
    each = ""
    if said.startswith("each "):
        each, _, said = said[5:].partition(": ")
    elif re.fullmatch(r"[a-z]\w*", said):
        said = f"{label(said)}: {{{said}}}"
    said, at, pieces = said.replace("\\n", "\n"), 0, []
    for m in TOKEN.finditer(said):
        lead = said[at : m.start()]
        if m.group(4) is not None:
            pieces.append(_piece(m.group(4), lead))
        else:
            if lead:
                pieces.append((lead, [], "", OPTIONAL, "", ""))
            pieces.append(_piece(m.group(2), m.group(1), m.group(3), OPTIONAL))
        at = m.end()
    return each, pieces, said[at:]


def _metadata(said: str) -> list[tuple]:
    found = []
    for name, _, key in (x.partition("=") for x in re.split(r" (?=\w)", said) if x):
        piece = (key.strip("'"), [], "", OPTIONAL, "", "") if key.startswith("'") else _piece(f"{key or name}")
        found.append((name, piece))
    return found


def _fields(v: Column) -> Column:
    """A variant's fields; one that isn't an object is its own field ''."""
    return F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.when(v.isNotNull(), F.create_map(F.lit(""), v)))


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _list(v: Column) -> Column:
    """A list's elements; anything else is a list of one."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull() & ~F.is_variant_null(v), F.array(v)), F.array().cast("array<variant>"))


def _records(v: Column) -> Column:
    """The fields of a list's elements, without those that say nothing."""
    return F.filter(F.transform(_list(v), _fields), lambda m: F.coalesce(~F.map_contains_key(m, F.lit("")) | (F.trim(_text(F.try_element_at(m, F.lit("")))) != ""), F.lit(False)))


def _told(v: Column) -> Column:
    return F.filter(F.transform(_list(v), _text), lambda t: F.trim(t) != "")


# What follows is written as SQL text: a family has hundreds of expressions, and building them one by one from Python takes longer than running them.


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _object(x: str) -> str:
    return f"(try_variant_get({x}, '$', 'struct<_:string>') IS NOT NULL)"


def _fields_of(x: str, keys, kind: str = "variant") -> str:
    """An object's fields of these names, each null where it is missing: read in one go, as Spark throws an exception within for each missing field that a path asks for."""
    return f"try_variant_get({x}, '$', 'struct<{', '.join(f'`{k}`:{kind}' for k in sorted(keys) or ['_'])}>')"


def _listed(v: str) -> str:
    return f"coalesce(try_variant_get({v}, '$', 'array<variant>'), CASE WHEN {v} IS NOT NULL AND NOT is_variant_null({v}) THEN array({v}) END, CAST(array() AS array<variant>))"


def _spoken(v: str) -> str:
    """A list's elements, without those that say nothing."""
    return f"filter({_listed(v)}, r -> coalesce({_object('r')} OR trim(try_variant_get(r, '$', 'string')) <> '', false))"


def _texts(v: str) -> str:
    return f"filter(transform({_listed(v)}, t -> try_variant_get(t, '$', 'string')), t -> trim(t) <> '')"


@dataclass(frozen=True)
class Item:
    """What a family reads: the item, its fields and those of the one above it, and positions, by the names of their columns; keys: the fields that were asked for."""

    x: str
    fields: str
    above: str = ""
    i: str = "0"
    j: str = "0"
    keys: set = field(default_factory=set)
    keys_above: set = field(default_factory=set)

    def get(self, key: str, kind: str = "variant") -> str:
        """A field of the item, of the one above (^), or '': the item if it isn't an object."""
        if not key:
            return f"IF({_object(self.x)}, NULL, try_variant_get({self.x}, '$', '{kind}'))"
        of, name, keys = (self.above, key[1:], self.keys_above) if key.startswith("^") else (self.fields, key, self.keys)
        keys.add(name)
        found = f"{of}.`{name}`" if of else "CAST(NULL AS variant)"
        return found if kind == "variant" else f"try_variant_get({found}, '$', '{kind}')"

    def counted(self, key: str) -> str:
        """A field's text if it counts, else null."""
        s = self.get(key, "string")
        return f"CASE WHEN {s} NOT IN ('', '[]', '0', 'false') THEN {s} WHEN {s} IN ('0', 'false') AND schema_of_variant({self.get(key)}) = 'STRING' THEN {s} END"

    def counts(self, key: str) -> str:
        return f"({self.counted(key)}) IS NOT NULL"

    def value(self, piece: tuple) -> str:
        """What a piece says: null if nothing."""
        _, keys, how, need, fall, _ = piece
        there = (lambda k: f"{self.get(k)} IS NOT NULL") if need == THERE else self.counts
        if keys == ["#j"]:
            said = f"CAST({self.j} AS string)"
        elif how in ("flag", "inout"):
            yes, no = ("Yes", "No") if how == "flag" else ("Included", "Excluded")
            said = f"IF({' OR '.join(map(self.counts, keys))}, '{yes}', '{no}')"
        elif how == "bar":
            said = f"concat_ws(' | ', {', '.join(map(self.counted, keys))})"
        elif how == "":
            said = f"coalesce({', '.join(self.get(k, 'string') if need == THERE else self.counted(k) for k in keys)})"
        else:
            said = f"coalesce({', '.join(f'CASE WHEN {there(k)} THEN {self._how(k, how)} END' for k in keys)})"
        return f"coalesce({said}, concat_ws(' ', {_lit(fall)}, {self.i} + 1))" if fall else said

    def _how(self, key: str, how: str) -> str:
        v = self.get(key)
        if how == "yesno":
            return f"IF({self.counts(key)}, 'Yes', 'No')"
        if how == "some":
            return "'true'"
        if how == "address":
            parts = ("street1", "street2", "city", "state", "zip", "country")
            told = ", ".join(f"nullif(a.`{k}`, '')" for k in parts)
            return f"element_at(transform(array({_fields_of(v, parts, 'string')}), a -> concat_ws(', ', {told})), 1)"
        if how == "titles":
            titles = _fields_of("c", ("title", "originalTitle"), "string")
            return f"array_join(transform({_spoken(v)}, (c, n) -> coalesce({titles}.title, {titles}.originalTitle, concat('Child ', n + 1))), ', ')"
        return f"array_join({_texts(v)}, {_lit(how)})"

    def said(self, pieces: list[tuple], tail: str) -> str:
        """A line; null if a value that it needs is missing, or if it says nothing."""
        parts, sure = [], bool(tail)
        for piece in pieces:
            pre, keys, _, need, _, post = piece
            if not keys:
                parts.append(_lit(pre))
                sure |= bool(pre)
                continue
            around = [_lit(pre)] * bool(pre) + [self.value(piece)] + [_lit(post)] * bool(post)
            told = f"concat({', '.join(around)})"
            parts.append(f"coalesce({told}, '')" if need == OPTIONAL else told)
            sure |= need != OPTIONAL and bool(pre or post)
        line = f"concat({', '.join(parts + [_lit(tail)] * bool(tail))})"
        return line if sure else f"IF({line} <> '', {line}, NULL)"

    def line(self, each: str, pieces: list[tuple], tail: str) -> str:
        if not each:
            return self.said(pieces, tail)
        if each == "*":
            text = "try_variant_get(e.value, '$', 'string')"
            many = f"transform(filter(map_entries(try_variant_get({self.x}, '$', 'map<string,variant>')), e -> schema_of_variant(e.value) = 'STRING' AND {text} <> ''), e -> concat(e.key, ': ', {text}))"
        else:
            one = Item("y.v", "y.f", self.fields, self.i, self.j, keys_above=self.keys)
            told = one.said(pieces, tail)
            many = f"filter(transform(transform({_spoken(self.get(each))}, v -> struct(v AS v, {_fields_of('v', one.keys)} AS f)), y -> {told}), t -> t IS NOT NULL)"
        return f"nullif(array_join({many}, '\\n'), '')"


def _chunk(f: Family, item: Item) -> str:
    """An item's chunk: suffix of its id, type, text and entries of its metadata, empty ones too; null if it gives none."""
    lines = [item.line(*_line(x)) for x in f.lines.split("\n")]
    number = f"size(filter(slice(_told, 1, {f.rank}), t -> t))" if f.rank else "0"
    suffix = _lit(f.suffix)
    for name, value in (("{i}", item.i), ("{i+1}", f"{item.i} + 1"), ("{j}", item.j), ("{n}", number), ("{n+i}", f"{number} + {item.i}")):
        if name in f.suffix:
            suffix = f"replace({suffix}, '{name}', CAST({value} AS string))"
    told = [(name, item.value((*p[:3], COUNTS if len(p[1]) > 1 else THERE, *p[4:])) if p[1] else _lit(p[0])) for name, p in _metadata(f.metadata)]
    told += [("evidenceKind", _lit(f.evidence)), ("documentType", "_type"), ("linesOfBusiness", "_lob")]
    metadata = "array({})".format(", ".join(f"struct('{k}' AS key, CAST({v} AS string) AS value)" for k, v in told))
    made = f"struct({suffix} AS suffix, '{f.type}' AS type, concat_ws('\\n', {', '.join(lines)}) AS text, {metadata} AS metadata)"
    conditions = ([item.counts(f.needs)] if f.needs else []) + ([f"{' + '.join(f'int(({x}) IS NOT NULL)' for x in lines)} >= {f.least}"] if f.least else [])
    if f.only:
        conditions.append("NOT _type <=> 'policy'" if f.only == "!policy" else f"_type <=> {_lit(f.only)}")
    return f"IF({' AND '.join(conditions)}, {made}, NULL)" if conditions else made


def document_chunks(documents: DataFrame, families: list[Family] = FAMILIES) -> DataFrame:
    """documents(document_id, json) -> id, document_id, type, text, metadata (a map of strings; empty values are left out).

    Families of whole documents are told in the document's row, those of items in a row for each item.
    """
    top, within = Item("_v", "_vf"), Item("_x", "_xf", "_af", "_i", "_j")
    found = ", ".join([f"size({_spoken(top.get(k))}) > 0" for k in SUPPLEMENT] + [f"coalesce({', '.join(map(top.get, NOTICES))}) IS NOT NULL"])
    said = (f"{top.get('type', 'string')} AS _type", f"array_join({_texts(top.get('linesOfBusiness'))}, ',') AS _lob", f"array({found}) AS _told")
    shape = "struct<f:int,i:int,j:int,x:variant,above:variant>"
    made = "struct<suffix:string,type:string,text:string,metadata:array<struct<key:string,value:string>>>"
    item = lambda n, i, j, x, above: f"struct({n} AS f, int({i}) AS i, int({j}) AS j, {x} AS x, CAST({above} AS variant) AS above)"
    whole, items, cases = [], [], []
    for n, f in enumerate(families):
        if not f.over:
            whole.append(_chunk(f, top))
            continue
        outer, _, inner = f.over.partition(".")
        over = _spoken(f"coalesce({', '.join(map(top.get, outer.split('|')))})")
        inside = f"transform({_spoken(_fields_of('o', [inner]) + f'.`{inner}`')}, (x, j) -> {item(n, 'i', 'j', 'x', 'o')})"
        items.append(f"flatten(transform({over}, (o, i) -> {inside}))" if inner else f"transform({over}, (x, i) -> {item(n, 'i', 0, 'x', 'NULL')})")
        cases.append(f"WHEN {n} THEN {_chunk(f, within)}")
    done = f"array({', '.join(f'struct({c} AS done, CAST(NULL AS {shape}) AS item)' for c in whole or [f'CAST(NULL AS {made})'])})"
    todo = f"transform(concat(CAST(array() AS array<{shape}>), {', '.join(items)}), t -> struct(CAST(NULL AS {made}) AS done, t AS item))" if items else f"CAST(array() AS array<struct<done:{made},item:{shape}>>)"
    # What is filtered or exploded is made in a projection of its own, compiled and once: a filter after a projection would make it a second time, a generator without compiling it.
    doc = documents.select("document_id", F.array(F.try_parse_json("json")).alias("_vs")).selectExpr("document_id", "explode_outer(_vs) AS _v").where(_object("_v")).selectExpr("document_id", "_v", f"{_fields_of('_v', top.keys)} AS _vf")
    doc = doc.selectExpr("document_id", "_v", "_vf", *said)
    rows = doc.selectExpr("document_id", "_type", "_lob", "_told", f"concat({done}, {todo}) AS _rs").selectExpr("document_id", "_type", "_lob", "_told", "explode_outer(_rs) AS _r")
    rows = rows.selectExpr("document_id", "_type", "_lob", "_told", "_r.done AS _done", *(f"_r.item.{c} AS _{c}" for c in ("f", "i", "j", "x", "above")))
    rows = rows.selectExpr("document_id", "_type", "_lob", "_told", "_done", "_f", "_i", "_j", "_x", f"{_fields_of('_x', within.keys)} AS _xf", f"{_fields_of('_above', within.keys_above)} AS _af")
    rows = rows.selectExpr("document_id", f"array(coalesce(_done, CASE _f {' '.join(cases)} END)) AS _cs" if cases else "array(_done) AS _cs")
    rows = rows.selectExpr("document_id", "explode_outer(_cs) AS _c").where("_c IS NOT NULL")
    return rows.selectExpr("concat_ws(':', document_id, _c.suffix) AS id", "document_id", "_c.type", "_c.text", "map_from_entries(filter(_c.metadata, e -> e.value <> '')) AS metadata")
