"""The statement model as JSON: packages of classes, with attributes and associations by multiplicity, and of enumerations."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import SparkSession

from lexloom.config import ENUMS
from lexloom.operators.validate import CLASSES, RULES, SOURCE, Field, Model
from lexloom.sources.shared import filesystem

PLAIN = {"string": "str", "int": "int", "long": "int"}


def dumped(name: str = "policy") -> str:
    """The model of this package."""

    def shown(f: Field) -> dict:
        kind = {"str": "string"}.get(f.kind, f.kind)
        return {"target" if f.kind in CLASSES else "type": kind, "multiplicity": ("1" if f.least or f.required else "0") + "..*" if f.many else "0..1" if f.nullable else "1"}

    classes = {c: {"attributes": {f.name: shown(f) for f in fields if f.kind not in CLASSES}, "associations": {f.name: shown(f) | {"navigable": True} for f in fields if f.kind in CLASSES}} for c, fields in CLASSES.items()}
    return json.dumps({"project": name, "metamodel": name, "packages": {"Model": {"classes": classes}, "Vocabularies": {"enumerations": ENUMS}}}, indent=2)


def parsed(text: str) -> tuple[dict[str, list[Field]], dict[str, list[str]]]:
    """(classes, enumerations) of a model: navigable fields only; a field that refers to nothing known is refused."""
    packages = json.loads(text)["packages"].values()
    enums = {n: list(v if isinstance(v, list) else v.get("literals", v.get("values", v))) for p in packages for n, v in p.get("enumerations", {}).items()}
    found = {n: c for p in packages for n, c in p.get("classes", {}).items()}
    classes = {}
    for name, c in found.items():
        fields = []
        for f, x in {**c.get("attributes", {}), **{k: v for k, v in c.get("associations", {}).items() if v.get("navigable", True)}}.items():
            kind = PLAIN.get(x.get("type", ""), x.get("type") or x.get("target"))
            if kind not in ("str", "int") and kind not in enums and kind not in found:
                raise ValueError(f"{name}.{f} refers to {kind}, which the model does not have")
            low, _, high = x.get("multiplicity", "1").partition("..")
            fields.append(Field(f, kind, low != "0", high == "*", int(low) if high == "*" else 0, low == "0" and high == "1"))
        classes[name] = fields
    return classes, enums


def model(text: str) -> Model:
    """The model as the validator, the types, the files of statements and the Ecore file take it: a field has the second name that those
    of this package have, ids may be left out, and the field of a class of this package is as strict as there. Rules are those of the
    classes by name: constraints in the text are kept beside them by `constraints`, not read."""
    classes, enums = parsed(text)
    out = {}
    for name, fields in classes.items():
        ours = {f.name: f for f in CLASSES.get(name, [])}
        snake = lambda n: "".join(f"_{c.lower()}" if c.isupper() else c for c in n)
        out[name] = [ours.get(f.name) if f.name in ours and (ours[f.name].kind, ours[f.name].many) == (f.kind, f.many) else replace(f, required=f.required and not (i == 0 and f.name.endswith("Id")), other=snake(f.name)) for i, f in enumerate(fields)]
    return Model(out, enums, {n: r for n, r in RULES.items() if n in out and {"mechanism", "adequacyDecisionRef"} <= {f.name for f in out[n]}})


def constraints(text: str) -> dict[str, dict[str, dict]]:
    """By class and name: severity (error, unless it is said to be a warning), expression and message."""
    found = {n: c for p in json.loads(text)["packages"].values() for n, c in p.get("classes", {}).items()}
    plain = lambda x: {"severity": "error", "expression": x, "message": ""} if isinstance(x, str) else {"severity": x.get("severity", "error"), "expression": x["expression"], "message": x.get("message", "")}
    return {n: {k: plain(x) for k, x in c["constraints"].items()} for n, c in found.items() if c.get("constraints")}


def read(spark: SparkSession, path: str) -> tuple[dict[str, list[Field]], dict[str, list[str]]]:
    """From whatever store the path is in."""
    fs, at = filesystem(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    return parsed("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def differences(classes: dict[str, list[Field]], enums: dict[str, list[str]]) -> list[str]:
    """How a model that was read differs from the one that statements are validated with: fields, kinds, whether there may be several,
    and values."""
    out = [f"{n}: class missing" for n in CLASSES if n not in classes] + [f"{n}: class unknown" for n in classes if n not in CLASSES]
    for n, fields in CLASSES.items():
        theirs = {f.name: f for f in classes.get(n, [])}
        for f in fields if n in classes else ():
            other = theirs.pop(f.name, None) or theirs.pop({"purposes": "purpose"}.get(f.name, ""), None)
            if other is None:
                out.append(f"{n}.{f.name}: field missing")
            elif (other.kind, other.many) != (f.kind, f.many):
                out.append(f"{n}.{f.name}: {other.kind}{' list' if other.many else ''} instead of {f.kind}{' list' if f.many else ''}")
        out += [f"{n}.{x}: field unknown" for x in theirs if x != SOURCE.name]
    for n, values in ENUMS.items():
        if sorted(enums.get(n, [])) != sorted(values):
            out.append(f"{n}: values {sorted(set(enums.get(n, [])) ^ set(values))}")
    return out
