"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust a score.

DataFrame functions only. The patterns use possessive loops and look-behinds where those match the same spans as the plain
forms: so no text, however long, makes them recurse or rescan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import fresh, table

#: Order of the kinds where spans begin at one place; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "phone_local")
BASE = 4
#: Length of an account number by country (ISO 13616).
IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_BY_COUNTRY = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+(?![A-Za-z0-9])" for n, c in IBAN.items())
#: A span starts where the last one ended, or not within a run of its own characters.
PATTERNS = {
    "email": r"(?=[A-Za-z0-9._%+-])(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # only whole chains of 14 to 19 digits: shorter and longer ones are dropped anyway
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # by the country's length, whatever words follow; else the longest run. Takes one letter, so a failed number hides none behind it
    "iban": rf"(?=[A-Z])(?<![A-Za-z0-9])(?=({_BY_COUNTRY}|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+(?![A-Za-z0-9])))[A-Z]",
    "phone_local": r"(?=[(0-9])(?<![0-9A-Za-z+().-])(?<![0-9+)]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
#: Kinds whose value is the pattern's first group, looked ahead at, of which the pattern takes one character.
AHEAD = ("iban",)
#: A cheap sign without which a kind can't occur.
SIGNS = {"email": "@", "phone": "+"}
#: Score of a proposal before context, words nearby that raise it, and by how much.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "phone_local": 0.3}
CONTEXT = {
    "email": r"\b(e-?mail|mail|contact)\b",
    "ip": r"\b(ip|host|server|address)\b",
    "card": r"\b(card|visa|credit|debit|payment|mastercard)\b",
    "phone": r"\b(phone|tel|telephone|call|mobile|fax|tel[eé]fono|telefon|t[eé]l[eé]phone)\b",
    "iban": r"\b(iban|bank|account|konto|cuenta|compte)\b",
    "phone_local": r"\b(phone|tel|telephone|call|mobile|fax|tel[eé]fono|telefon|t[eé]l[eé]phone)\b",
}
RAISE, ACCEPT, WINDOW = 0.3, 0.5, 40


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Luhn's sum over the digits of a short text."""
    d = F.reverse(_digits(value))
    doubled = lambda i: F.substring(d, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.when(doubled(i) > 9, doubled(i) - 9).otherwise(doubled(i))), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """ISO 7064 mod 97-10 as account numbers use it: the first four characters move to the end, letters count from 10."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


def _spans(kind: str, hits: Column, pieces: Column) -> Column:
    """Confirmed spans in code points: the pieces between the hits tell where each begins."""
    k = KINDS.index(kind)
    pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(hits)).alias("p"), hits.alias("h"), F.slice(pieces, F.lit(2), F.size(hits)).alias("q"))
    empty = F.expr("CAST(array() AS array<struct<s:bigint,k:int,e:bigint,v:string,near:string>>)")
    none = F.expr("CAST(array() AS array<array<struct<s:bigint,k:int,e:bigint,v:string,near:string>>>)")
    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("full"), empty.alias("run"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["p"])
        end = start + F.length(x["h"])
        taken, after = (start + 1, F.length(x["h"])) if kind in AHEAD else (end, F.lit(1))
        near = F.concat(F.substring(x["p"], -WINDOW, WINDOW), F.lit(" "), F.substring(x["q"], after, F.lit(WINDOW // 2)))
        run = F.array_append(a["run"], F.struct(start.alias("s"), F.lit(k).alias("k"), end.alias("e"), x["h"].alias("v"), near.alias("near")))
        # short runs: appending to one array would copy it for each of its spans
        closed = F.struct(taken.alias("at"), F.array_append(a["full"], run).alias("full"), empty.alias("run"))
        return F.when(F.size(a["run"]) >= 127, closed).otherwise(F.struct(taken.alias("at"), a["full"].alias("full"), run.alias("run")))

    spans = F.aggregate(pairs, zero, step, lambda a: F.flatten(F.array_append(a["full"], a["run"])))
    return F.filter(spans, lambda x: _confirmed(kind, x["v"]))


def _scored(x: Column) -> Column:
    """The nearby words are those between the span and its neighbours of the same kind: no walk over the whole text a span."""
    near = F.lower(x["near"])
    score = F.lit(None).cast("double")
    for k, kind in enumerate(KINDS):
        score = F.when(x["k"] == k, F.lit(PRIOR[kind]) + F.when(near.rlike(CONTEXT[kind]), F.lit(RAISE)).otherwise(F.lit(0.0))).otherwise(score)
    return F.least(F.lit(1.0), score)


def find(docs: DataFrame, into: str = "findings") -> DataFrame:
    """docs with `findings`, or under another name: array of (kind, start, end, score, base, value) by start, then kind; offsets
    are code points, end exclusive.

    A null or empty text has none; very long texts are searched whole. Base kinds always stay; others need a score of at least
    0.5 and must not overlap a base span. Repeated rows are searched each for itself; an empty table gives an empty result. All
    columns of docs are kept, whatever their names, but one of the name of the findings.
    """
    docs = docs.drop(into)
    spans = fresh(docs, "_spans")
    h, q = ({k: fresh(docs, f"_{w}_{k}") for k in KINDS} for w in ("hits", "pieces"))
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.expr("CAST(array() AS array<string>)")
    hits = {}
    for kind, pattern in PATTERNS.items():
        sign = F.contains(text, F.lit(SIGNS[kind])) if kind in SIGNS else text.rlike("[0-9]")
        hits[h[kind]] = F.when(sign, F.regexp_extract_all(text, F.lit(pattern), F.lit(int(kind in AHEAD)))).otherwise(none)
    out = docs.withColumns(hits)
    out = out.withColumns({q[k]: F.when(F.size(h[k]) > 0, F.split(text, p, -1)).otherwise(none) for k, p in PATTERNS.items()})
    every = F.concat(*[_spans(k, F.col(h[k]), F.col(q[k])) for k in KINDS])
    found = sum((F.size(h[k]) for k in KINDS[1:]), F.size(h[KINDS[0]]))
    out = out.withColumn(spans, F.when(found > 0, F.array_sort(every)))
    base = F.filter(spans, lambda x: x["k"] < BASE)
    label = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["k"] + 1)
    full = F.transform(spans, lambda x: F.struct(label(x).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), _scored(x).alias("score"), (x["k"] < BASE).alias("base"), x["v"].alias("value")))
    keep = lambda x: x["base"] | ((x["score"] >= ACCEPT) & ~F.exists(base, lambda b: (b["s"] < x["end"]) & (x["start"] < b["e"])))
    nothing = F.expr("CAST(array() AS array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean,value:string>>)")
    return out.withColumn(into, F.coalesce(F.filter(full, keep), nothing)).drop(spans, *h.values(), *q.values())


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs, each found value replaced by its kind in square brackets; a null text stays null, as do all other columns what they
    are, whatever their names. Very long texts, repeated rows and empty tables are as in `find`."""
    findings = fresh(docs, "findings")
    text = F.coalesce(F.col("text"), F.lit(""))
    piece = lambda a, x: F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(x["start"] >= a["at"], F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]"))).otherwise(a["out"]).alias("out"))
    done = F.aggregate(findings, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), piece, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return find(docs, findings).withColumn("text", F.when(F.size(findings) > 0, done).otherwise(F.col("text"))).drop(findings)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("findings", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:BASE]], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"))
