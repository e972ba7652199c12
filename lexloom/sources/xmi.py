"""Statements as XMI documents and the model as Ecore, with the standard library."""

from __future__ import annotations

import json
import uuid
import xml.etree.ElementTree as ET
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.validate import MODEL, Model
from lexloom.sources.shared import filesystem

NS = "http://example.org/lexloom/policy"
XMI = "http://www.omg.org/XMI"


def slug(ref: Column) -> Column:
    return F.btrim(F.regexp_replace(ref, r"(?U)[^\w]+", "_"), F.lit("_"))


def _fill(at: ET.Element, name: str, value: dict, model: Model) -> None:
    for f in model.classes[name]:
        v = value.get(f.name, value.get(f.other))
        if v is None or v == "" or v == []:
            continue
        known = model.enums.get(f.kind)
        if f.kind in model.classes:
            for x in v if isinstance(v, list) else [v]:
                _fill(ET.SubElement(at, f.name), f.kind, x, model)
        elif f.many:
            for x in v:
                if known is None or x in known:
                    ET.SubElement(at, f.name).text = str(x)
        elif known is None or v in known:
            at.set(f.name, str(v))


def to_xmi(name: str, raw: str, model: Model = MODEL) -> str:
    """Contained objects as elements, plain fields as attributes; nulls, unknown keys and unknown enum values are left out."""
    ET.register_namespace("xmi", XMI)
    ET.register_namespace("policy", NS)
    root = ET.Element(f"{{{NS}}}{name}", {f"{{{XMI}}}version": "2.0"})
    _fill(root, name, json.loads(raw), model)
    return ET.tostring(root, encoding="unicode")


def statements_xmi(statements: DataFrame, name: str = "PolicyStatement", model: Model = MODEL) -> DataFrame:
    """(law, file, xmi) of statements (law, article_ref, statement_json), a row each."""

    @F.udf("string", useArrow=True)
    def run(raw: str) -> str:
        return to_xmi(name, raw, model)

    return statements.select("law", F.concat(F.lower("law"), F.lit("_"), slug(F.col("article_ref")), F.lit(".xmi")).alias("file"), run("statement_json").alias("xmi"))


def write_statements(statements: DataFrame, folder: str, name: str = "PolicyStatement", model: Model = MODEL) -> int:
    """A file LAW_ARTICLE.xmi of each statement in the folder, in whatever store that is; returns how many. Of statements of one file
    name the last id stays.

    Tasks write the files beside the folder's own, each task's when it is done with all of its; when the job is, they are moved to
    their names. The driver sees names only, and a job that fails leaves the folder as it was.
    """
    spark = statements.sparkSession
    file = F.concat(F.lower("law"), F.lit("_"), slug(F.col("article_ref")))
    last = statements.groupBy(file.alias("_file")).agg(F.max_by(F.struct("law", "article_ref", "statement_json"), "statement_id").alias("s")).select("s.*")
    beside = f"{folder.rstrip('/')}/_{uuid.uuid4().hex}"
    fs, at = filesystem(spark, beside)
    n = 0
    try:
        statements_xmi(last, name, model).select("file", "xmi").write.partitionBy("file").text(beside)
        for part in fs.listStatus(at):
            if part.isDirectory():
                file = unquote(part.getPath().getName().partition("=")[2])
                (own,) = [x.getPath() for x in fs.listStatus(part.getPath()) if x.getPath().getName().startswith("part-")]
                _, place = filesystem(spark, f"{folder.rstrip('/')}/{file}")
                fs.delete(place, False)
                if not fs.rename(own, place):
                    raise OSError(f"{own} could not be moved to {place}")
                n += 1
    finally:
        fs.delete(at, True)
    return n


def put(spark: SparkSession, path: str, text: str) -> None:
    fs, at = filesystem(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_ecore(spark: SparkSession, path: str, model: Model = MODEL) -> None:
    put(spark, path, ecore(model))


def ecore(model: Model = MODEL) -> str:
    """The model as one flat package: an enumeration for each vocabulary, a class for each class, all references contained."""
    E = "http://www.eclipse.org/emf/2002/Ecore"
    ET.register_namespace("ecore", E)
    xsi = "{http://www.w3.org/2001/XMLSchema-instance}type"
    root = ET.Element(f"{{{E}}}EPackage", {"name": "policy", "nsURI": NS, "nsPrefix": "policy"})
    for name, values in model.enums.items():
        at = ET.SubElement(root, "eClassifiers", {xsi: "ecore:EEnum", "name": name})
        for i, v in enumerate(values):
            ET.SubElement(at, "eLiterals", {"name": v, "value": str(i)})
    for name, fields in model.classes.items():
        at = ET.SubElement(root, "eClassifiers", {xsi: "ecore:EClass", "name": name})
        for f in fields:
            plain = f.kind in ("str", "int")
            kind = "ecore:EReference" if f.kind in model.classes else "ecore:EAttribute"
            target = f"ecore:EDataType {E}#//{'EString' if f.kind == 'str' else 'ELong'}" if plain else f"#//{f.kind}"
            extra = {"containment": "true"} if f.kind in model.classes else {}
            ET.SubElement(at, "eStructuralFeatures", {xsi: kind, "name": f.name, "eType": target, "lowerBound": str(int(f.required)), "upperBound": "-1" if f.many else "1", **extra})
    return ET.tostring(root, encoding="unicode")
