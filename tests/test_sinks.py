"""Files of statements written by tasks, and a model read at run time through validation, types, XMI and Ecore."""

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from lexloom.operators import compiled
from lexloom.sources import metamodel, xmi

ROWS = "law string, article_ref string, statement_id string, statement_json string"


def statements(spark, *rows):
    return spark.createDataFrame([(law, ref, i, json.dumps({"description": d})) for law, ref, i, d in rows], ROWS).repartition(3)


def test_files_of_statements(spark, tmp_path):
    (tmp_path / "gdpr_Article_1.xmi").write_text("old")
    df = statements(spark, ("GDPR", "Article 1", "a", "one"), ("GDPR", "Article 1", "b", "later"), ("GDPR", "Article-1", "c", "same file"), ("LGPD", "Art. 2º (x=y)", "d", "zwei\nZeilen"), *[("X", f"n{i}", "e", str(i)) for i in range(40)])
    assert xmi.write_statements(df, str(tmp_path)) == 42
    found = {p.name: ET.fromstring(p.read_text()).get("description") for p in tmp_path.glob("*.xmi")}
    assert len(found) == 42 and found["gdpr_Article_1.xmi"] == "same file" and found["lgpd_Art_2º_x_y.xmi"] == "zwei\nZeilen" and found["x_n7.xmi"] == "7"
    assert not list(tmp_path.glob("_*")) and xmi.write_statements(df.limit(0), str(tmp_path / "none")) == 0


def test_a_job_that_fails_leaves_the_folder_as_it_was(spark, tmp_path):
    (tmp_path / "x_n1.xmi").write_text("old")
    df = statements(spark, *[("X", f"n{i}", "e", str(i)) for i in range(30)])
    bad = df.withColumn("statement_json", F.when(F.col("article_ref") == "n29", "broken").otherwise(F.col("statement_json")))
    with pytest.raises(Exception, match="JSON|Expecting"):
        xmi.write_statements(bad, str(tmp_path))
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["x_n1.xmi"] and (tmp_path / "x_n1.xmi").read_text() == "old"


def test_a_model_read_from_a_file(spark, tmp_path):
    own = json.loads(metamodel.dumped())
    classes = own["packages"]["Model"]["classes"]
    classes["Audit"] = {
        "attributes": {"auditId": {"type": "string", "multiplicity": "1"}, "level": {"type": "AuditLevel", "multiplicity": "1"}, "daysLeft": {"type": "int", "multiplicity": "1"}},
        "associations": {"purposes": {"target": "Purpose", "multiplicity": "1..*", "navigable": True}, "back": {"target": "Actor", "multiplicity": "1", "navigable": False}},
        "constraints": {"c1": "self.daysLeft > 0", "c2": {"severity": "warning", "expression": "self.level = AuditLevel::External", "message": "said"}},
    }
    own["packages"]["Vocabularies"]["enumerations"]["AuditLevel"] = ["Internal", "External"]
    text = json.dumps(own)
    m = metamodel.model(text)
    good = {"level": "External", "days_left": 3, "purposes": [{"description": "d", "category": "Research"}]}
    rows = spark.createDataFrame([(1, "Audit", json.dumps(good)), (2, "Audit", json.dumps(good | {"level": "None"})), (3, "DataTransfer", '{"mechanism": "AdequacyDecision", "destinationJurisdiction": [{"name": "X"}], "dataTransferred": []}')], "i int, concept string, json_str string")
    out = {r["i"]: r for r in compiled.validate(rows, model=m).collect()}
    assert out[1]["valid"] and out[2]["errors"] == ["level: not one of Internal, External"]
    assert out[3]["errors"] == ["dataTransferred: at least 1 needed", "adequacyDecisionRef: needed with AdequacyDecision"]
    typed = spark.createDataFrame([(out[1]["normal"],)], "j string").select(F.from_json("j", m.ddl("Audit")).alias("a")).first()["a"]
    assert (typed["daysLeft"], typed["purposes"][0]["category"]) == (3, "Research")
    root = ET.fromstring(xmi.to_xmi("Audit", out[1]["normal"], m))
    assert root.get("daysLeft") == "3" and root.get("level") == "External" and root[0].get("category") == "Research"
    assert 'name="Audit"' in xmi.ecore(m) and 'name="Audit"' not in xmi.ecore() and 'name="back"' not in xmi.ecore(m)
    assert metamodel.constraints(text)["Audit"] == {"c1": {"severity": "error", "expression": "self.daysLeft > 0", "message": ""}, "c2": {"severity": "warning", "expression": "self.level = AuditLevel::External", "message": "said"}}
    assert metamodel.model(metamodel.dumped()).classes == {n: f for n, f in compiled.MODEL.classes.items()}
