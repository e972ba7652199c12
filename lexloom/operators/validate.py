"""Validation of extracted JSON against the statement model.

A schema tells the fields of each class; a check walks the parsed JSON with the lenient rules of the model: strings are stripped,
whole numbers may come as text, float or boolean, either name of a field is taken, further keys are ignored. Tables are checked by the
same rules compiled to expressions (`compiled`). Cross-field rules are plain column expressions over typed statements.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.config import ENUMS


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # str, int, an enum, or a class
    required: bool = False
    many: bool = False
    least: int = 0
    nullable: bool = False
    other: str = ""  # second name


def _id(name: str) -> Field:
    return Field(name, "str", other="".join(f"_{c.lower()}" if c.isupper() else c for c in name))


def _text(name: str, required: bool = True, nullable: bool = False) -> Field:
    return Field(name, "str", required, nullable=nullable, other="".join(f"_{c.lower()}" if c.isupper() else c for c in name))


def _one(name: str, kind: str, other: str = "") -> Field:
    return Field(name, kind, True, other=other or "".join(f"_{c.lower()}" if c.isupper() else c for c in name))


def _many(name: str, kind: str, least: int = 1, other: str = "") -> Field:
    return Field(name, kind, least > 0, True, least, other=other or "".join(f"_{c.lower()}" if c.isupper() else c for c in name))


# What the ids of each class begin with.
ID_PREFIX = {
    "Jurisdiction": "jur", "Regulation": "reg", "Actor": "act", "PersonalData": "dat", "ProcessingActivity": "prc", "DataTransfer": "xfr", "Purpose": "pur", "LegalBasis": "lb", "Constraint": "con", "Right": "rig",
    "RetentionPolicy": "ret", "ConsentWithdrawal": "wdr", "PolicyStatement": "stmt", "PrivacyPolicy": "pol",
}
SOURCE = Field("source_clause", "str", other="sourceClause")
CLASSES: dict[str, list[Field]] = {
    "Jurisdiction": [_id("jurisdictionId"), _text("name"), _text("description", False)],
    "Regulation": [_id("regulationId"), _text("name"), _text("version", False), _text("description", False), _many("jurisdiction", "Jurisdiction")],
    "Actor": [_id("actorId"), _text("name"), _one("role", "ActorRole")],
    "PersonalData": [_id("dataId"), _text("description"), _text("source"), _one("category", "PersonalDataCategory"), _one("sensitivity", "SensitivityLevel"), _one("identifiability", "Identifiability")],
    "ProcessingActivity": [_id("activityId"), _text("description"), _one("action", "ProcessingAction"), _text("riskAssessmentReference", False, True), _many("dataProcessed", "PersonalData")],
    "DataTransfer": [_id("transferId"), _one("mechanism", "TransferMechanism"), _text("adequacyDecisionRef", False, True), _many("destinationJurisdiction", "Jurisdiction"), _many("dataTransferred", "PersonalData")],
    "Purpose": [_id("purposeId"), _text("description"), _one("category", "PurposeCategory")],
    "LegalBasis": [_id("basisId"), _one("type", "LegalBasisType"), _text("evidence"), _many("jurisdiction", "Jurisdiction")],
    "Constraint": [_id("constraintId"), _one("type", "ConstraintType"), _text("expression"), _text("enforcementLevel")],
    "Right": [_id("rightId"), _one("type", "RightType"), _text("triggerCondition"), _text("fulfillmentProcess")],
    "RetentionPolicy": [_id("retentionId"), _one("duration", "int"), _one("unit", "RetentionUnit"), _one("trigger", "RetentionTrigger"), _text("basisArticle", False, True)],
    "ConsentWithdrawal": [_id("withdrawalId"), _many("channel", "WithdrawalChannel"), _text("deadline"), _text("effectOnPriorProcessing")],
    "PolicyStatement": [
        _id("statementId"), _text("description"), _one("actor", "Actor"), _many("purposes", "Purpose"), _one("processingActivity", "ProcessingActivity"), _one("legalBasis", "LegalBasis"), _many("governingRegulations", "Regulation"),
        _many("constraints", "Constraint"), _many("rightImpacted", "Right", other="rights_impacted"), _many("retentionPolicies", "RetentionPolicy", 0), _many("dataTransfers", "DataTransfer", 0), _many("consentWithdrawal", "ConsentWithdrawal", 0),
    ],
    "PrivacyPolicy": [_id("policyId"), _text("version"), _one("validFrom", "int"), _one("validTo", "int"), _many("statements", "PolicyStatement")],
}


@dataclass(frozen=True)
class Model:
    """Classes and vocabularies that statements are checked against; rules of a class are conditions over its fields in SQL, with the
    field that is at fault and what is said of it."""

    classes: dict[str, list[Field]]
    enums: dict[str, list[str]]
    rules: dict[str, tuple[tuple[str, str, str], ...]]

    def fields(self, name: str) -> list[Field]:
        own = self.classes[name]
        return own if any(f.name == SOURCE.name for f in own) else [*own, SOURCE]

    def ddl(self, name: str) -> str:
        """The class as a Spark type."""
        parts = []
        for f in self.fields(name):
            kind = "string" if f.kind == "str" or f.kind in self.enums else "bigint" if f.kind == "int" else self.ddl(f.kind)
            parts.append(f"{f.name}: " + (f"array<{kind}>" if f.many else kind))
        return f"struct<{', '.join(parts)}>"


RULES = {"DataTransfer": (("{mechanism} = 'AdequacyDecision' AND coalesce({adequacyDecisionRef}, '') = ''", "adequacyDecisionRef", "needed with AdequacyDecision"),)}
MODEL = Model(CLASSES, ENUMS, RULES)


def ddl(name: str) -> str:
    return MODEL.ddl(name)


def new_id(name: str, at: list[str], seed: str) -> str:
    """The id of an object that was given none: the same for the same place of the same seed, however often it is computed."""
    return f"{ID_PREFIX[name]}_{hashlib.sha1('|'.join([seed, name, *at]).encode()).hexdigest()[:8]}"


def _value(kind: str, x, at: list[str], errors: list[str], seed: str):
    loc = ".".join(at)
    if kind in CLASSES:
        return checked(kind, x, at, errors, seed)
    if kind == "int":
        if isinstance(x, bool):
            return int(x)
        if isinstance(x, int) or isinstance(x, float) and x.is_integer():
            return int(x)
        if isinstance(x, str):
            try:
                return int(x.strip())
            except ValueError:
                pass
        errors.append(f"{loc}: not a whole number")
        return None
    if not isinstance(x, str):
        errors.append(f"{loc}: not a string")
        return None
    if kind in ENUMS:
        if x not in ENUMS[kind]:
            errors.append(f"{loc}: not one of {', '.join(ENUMS[kind])}")
        return x
    return x.strip()


def checked(name: str, x, at: list[str], errors: list[str], seed: str = "") -> dict | None:
    """The value with fields by their first names; what is wrong goes to errors as location and message. Ids that are left out are made
    up from the seed and the place."""
    if not isinstance(x, dict):
        errors.append(f"{'.'.join(at) or name}: not an object")
        return None
    out = {}
    for f in [*CLASSES[name], SOURCE]:
        key = f.name if f.name in x else f.other if f.other in x else None
        here = [*at, f.name]
        if key is None:
            if f.required:
                errors.append(f"{'.'.join(here)}: missing")
            out[f.name] = [] if f.many else None if f.nullable else new_id(name, at, seed) if f is CLASSES[name][0] and f.name.endswith("Id") else ""
            continue
        v = x[key]
        if v is None and f.nullable:
            out[f.name] = None
        elif f.many:
            if not isinstance(v, list):
                errors.append(f"{'.'.join(here)}: not a list")
                continue
            if len(v) < f.least:
                errors.append(f"{'.'.join(here)}: at least {f.least} needed")
            out[f.name] = [_value(f.kind, y, [*here, str(i)], errors, seed) for i, y in enumerate(v)]
        else:
            out[f.name] = _value(f.kind, v, here, errors, seed)
    if name == "DataTransfer" and out.get("mechanism") == "AdequacyDecision" and not out.get("adequacyDecisionRef"):
        errors.append(f"{'.'.join([*at, 'adequacyDecisionRef'])}: needed with AdequacyDecision")
    return out


def validate_json(name: str, raw: str | None, seed: str | None = None) -> tuple[str | None, list[str]]:
    """(normalised JSON or None, errors); JSON that does not parse or is no object is an error. The seed of new ids is the JSON itself
    unless one is given."""
    try:
        value = json.loads(raw or "")
    except ValueError:
        return None, [f"{name}: not JSON"]
    return validated(name, value, (raw or "") if seed is None else seed)


def validated(name: str, value, seed: str) -> tuple[str | None, list[str]]:
    """The same for JSON that is parsed already."""
    errors: list[str] = []
    out = checked(name, value, [], errors, seed)
    return (None if errors else json.dumps(out)), errors


def _in(x: Column, values: list[str]) -> Column:
    return F.coalesce(x.isin(values), F.lit(False))


def risk_warning(activity: Column) -> Column:
    """Transfer or sharing of highly sensitive data without a risk assessment."""
    sensitive = F.coalesce(F.exists(activity["dataProcessed"], lambda d: d["sensitivity"].isin("High", "SpecialCategory")), F.lit(False))
    return _in(activity["action"], ["Transfer", "Share"]) & sensitive & (F.coalesce(activity["riskAssessmentReference"], F.lit("")) == "")


def adequacy_error(transfer: Column) -> Column:
    return (transfer["mechanism"] == "AdequacyDecision") & (F.coalesce(transfer["adequacyDecisionRef"], F.lit("")) == "")


def jurisdiction_error(statement: Column) -> Column:
    return F.coalesce(F.exists(statement["governingRegulations"], lambda r: F.coalesce(F.size(r["jurisdiction"]), F.lit(0)) < 1), F.lit(False))


def withdrawal_warning(statement: Column) -> Column:
    return (statement["legalBasis"]["type"] == "Consent") & (F.coalesce(F.size(statement["consentWithdrawal"]), F.lit(0)) < 1)


def empty_policy_error(policy: Column) -> Column:
    return F.coalesce(F.size(policy["statements"]), F.lit(0)) < 1


def statement_rules(df: DataFrame, stmt: str = "stmt") -> DataFrame:
    """df with `warnings` and `rule_errors` of the typed statement."""
    s = F.col(stmt)
    said = lambda cond, text: F.when(cond, F.lit(text))
    transfers = F.coalesce(F.exists(s["dataTransfers"], adequacy_error), F.lit(False))
    return df.withColumns({
        "warnings": F.array_compact(F.array(said(risk_warning(s["processingActivity"]), "risk assessment missing"), said(withdrawal_warning(s), "consent without withdrawal"))),
        "rule_errors": F.array_compact(F.array(said(jurisdiction_error(s), "regulation without jurisdiction"), said(transfers, "adequacy decision without reference"))),
    })
