"""Validation within the plan against validation row by row: what is wrong, where, and the statement in order."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexloom.config import ENUMS
from lexloom.operators import compiled
from lexloom.operators.validate import CLASSES, MODEL, Field, Model, validate_json

ODD = ["", " ", "null", "3", '"x"', "[]", "{}", "not json", '{"a": 1} x', '{"a": 1}, {"b": 2}', '{"a": 1}],[{}', "[1, ]", "{", '{"name": "é\\u00e9"}', "  {}  "]


def value_of(rnd, f, depth):
    """Mostly right, now and then not."""
    if rnd.random() < 0.06:
        return rnd.choice([None, 3, 3.5, "", "zz", True, [], {}, [None], "Email", -1.0])

    def one():
        if f.kind in CLASSES:
            return object_of(rnd, f.kind, depth + 1)
        if f.kind == "int":
            return rnd.choice([1, 0, -7, 3.0, 2e0, "12", " 5 ", "+4", "1_000", "", "x", "1.0", True, False, 2.5])
        if f.kind in ENUMS:
            return rnd.choice(ENUMS[f.kind] * 3 + [ENUMS[f.kind][0].lower(), " " + ENUMS[f.kind][0]])
        return rnd.choice(["text", "  blanks   around\x1c", "", "quote ' and \\ and \"", "zwei\nZeilen", "日本"])

    return [one() for _ in range(rnd.randrange(0, 3))] if f.many else one()


def object_of(rnd, name, depth=0):
    out = {"further": 1} if rnd.random() < 0.2 else {}
    for f in CLASSES[name]:
        if rnd.random() < 0.93:
            out[f.other if f.other and rnd.random() < 0.2 else f.name] = value_of(rnd, f, depth)
    return out


def clean(rnd, name):
    """An object with nothing wrong in it."""
    def one(f):
        if f.kind in CLASSES:
            return clean(rnd, f.kind)
        return rnd.randrange(9) if f.kind == "int" else rnd.choice([v for v in ENUMS[f.kind] if v != "AdequacyDecision"]) if f.kind in ENUMS else " some text "

    return {f.name: [one(f) for _ in range(max(1, f.least))] if f.many else one(f) for f in CLASSES[name] if f.required or rnd.random() < 0.5}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = [(c, raw) for c in ("Purpose", "PolicyStatement", "Unknown") for raw in ODD] + [("Purpose", None), (None, "{}")]
    for name in CLASSES:
        out += [(name, json.dumps(object_of(rnd, name))) for _ in range(25)] + [(name, json.dumps(clean(rnd, name))) for _ in range(6)]
    return out


def test_expressions_judge_as_plain_python_does(spark, rows):
    df = spark.createDataFrame([(i, c, r) for i, (c, r) in enumerate(rows)], "i int, concept string, json_str string")
    out = compiled.validate(df)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    valid = 0
    for r in out.collect():
        concept, raw = rows[r["i"]]
        normal, errors = validate_json(concept, raw) if concept in CLASSES else (None, [f"{'null' if concept is None else concept}: unknown class"])
        assert r["errors"] == errors, raw
        assert r["valid"] == (not errors) and (normal is None) == (r["normal"] is None)
        if normal:
            valid += 1
            assert json.loads(r["normal"]) == json.loads(normal), raw
    assert valid > 60


def test_a_key_twice_is_no_json(spark):
    df = spark.createDataFrame([("Purpose", '{"description": "a", "description": "b", "category": "Research"}')], "concept string, json_str string")
    assert compiled.validate(df).first()["errors"] == ["Purpose: not JSON"]


def test_columns_of_any_name_and_empty_tables(spark):
    df = spark.createDataFrame([("Purpose", '{"description": "a", "category": "Research"}', 1, "x")], "concept string, json_str string, v0 int, r string")
    assert compiled.validate(df).columns == [*df.columns, "valid", "normal", "errors"] and compiled.validate(df).first()["valid"]
    assert compiled.validate(df.limit(0), names=["Purpose"]).count() == 0


def test_a_model_with_one_class_more(spark):
    more = Model(
        CLASSES | {"Audit": [Field("auditId", "str"), Field("level", "AuditLevel", True), Field("purposes", "Purpose", True, True, 1), Field("days", "int", True)]},
        ENUMS | {"AuditLevel": ["Internal", "External"]},
        MODEL.rules | {"Audit": (("{level} = 'External' AND {days} < 30", "days", "at least 30 for an external one"),)},
    )
    good = {"level": "Internal", "purposes": [{"description": "d", "category": "Research"}], "days": 3}
    rows = [("Audit", json.dumps(x)) for x in (good, good | {"level": "External"}, good | {"purposes": []}, {})]
    out = compiled.validate(spark.createDataFrame(rows, "concept string, json_str string").coalesce(1), model=more).collect()
    assert [r["errors"] for r in out] == [[], ["days: at least 30 for an external one"], ["purposes: at least 1 needed"], ["level: missing", "purposes: missing", "days: missing"]]
    typed = spark.createDataFrame([(out[0]["normal"],)], "j string").select(F.from_json("j", more.ddl("Audit")).alias("a")).first()["a"]
    assert typed["days"] == 3 and typed["auditId"].startswith("aud_") and typed["purposes"][0]["category"] == "Research"
