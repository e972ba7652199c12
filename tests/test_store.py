"""Versioned stores: a version is there as a whole or not at all, of two writers the second starts again, laws of any name."""

import json

import pytest
from pyspark.sql import functions as F

from lexloom.operators import store
from lexloom.operators.validate import ddl
from lexloom.sources.versions import Conflict, Versions

ROWS = "law string, chunk_id string, text string, seq long"


def make(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def held(s):
    return sorted((r["law"], r["chunk_id"], r["text"]) for r in s.read().collect())


class Died(Exception):
    pass


@pytest.mark.parametrize("replace", [False, True])
def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch, replace):
    s = store.ParquetStore(spark, str(tmp_path / "t"))
    s.ingest(make(spark, ("A", "1", "old", 0), ("B", "2", "old", 1)))
    before = held(s)

    def die(*_):
        raise Died

    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", die)
        with pytest.raises(Died):
            s.ingest(make(spark, ("B", "1", "new", 2), ("C", "3", "new", 3)), replace=replace)
    assert held(s) == before and s.versions.latest() == 1
    assert s.ingest(make(spark, ("B", "1", "new", 2), ("C", "3", "new", 3)), replace=replace) == (2 if replace else 1)
    assert held(s) == ([("B", "1", "new"), ("B", "2", "old"), ("C", "3", "new")] if replace else [*before, ("C", "3", "new")])
    # the part of the writer that died, and with replace that which nothing is left of
    live = set(s.versions.manifest(2)["live"])
    assert s.versions.vacuum() == len(list((tmp_path / "t").glob("part=*"))) or {p.name[5:] for p in (tmp_path / "t").glob("part=*")} == live
    assert held(s)


@pytest.mark.parametrize("replace", [False, True])
def test_two_writers_at_a_time(spark, tmp_path, monkeypatch, replace):
    path = str(tmp_path / "t")
    one, two = store.ParquetStore(spark, path), store.ParquetStore(spark, path)
    one.ingest(make(spark, ("A", "0", "first", 0)))
    commit, seen = Versions.commit, []

    def late(self, after, manifest):
        if not seen:  # another writer comes in between
            seen.append(after)
            assert two.ingest(make(spark, ("A", "1", "two", 1), ("B", "2", "two", 2)), replace=replace) == 2
        return commit(self, after, manifest)

    monkeypatch.setattr(Versions, "commit", late)
    assert one.ingest(make(spark, ("A", "1", "one", 1), ("C", "3", "one", 3)), replace=replace) == (2 if replace else 1)
    assert held(one) == [("A", "0", "first"), ("A", "1", "one" if replace else "two"), ("B", "2", "two"), ("C", "3", "one")]
    assert one.versions.numbers() == [1, 2, 3]


def test_conflicts_are_told_at_last(spark, tmp_path, monkeypatch):
    v = Versions(spark, str(tmp_path / "t"), "law")
    v.commit(0, {"schema": None, "live": {}})
    with pytest.raises(Conflict):
        v.commit(0, {"schema": None, "live": {}})
    monkeypatch.setattr(Versions, "commit", lambda *_: (_ for _ in ()).throw(Conflict()))
    with pytest.raises(Conflict):
        v.update(lambda manifest, old: (manifest, 1), tries=3)


def test_versions_before_and_laws_of_any_name(spark, tmp_path):
    s = store.ParquetStore(spark, str(tmp_path / "t"))
    assert not s.exists()
    with pytest.raises(FileNotFoundError):
        s.read()
    odd = ["a b", "x/y", "50%", "ÄÖ=1", "[z]", "007", "q?*"]
    s.ingest(make(spark, *[(law, str(i), "one", i) for i, law in enumerate(odd)]))
    assert s.ingest(make(spark, ("x/y", "0", "two", 9), ("ÄÖ=1", "3", "two", 9), ("007", "7", "two", 9)), replace=True) == 3
    want = {str(i): (law, "one") for i, law in enumerate(odd)} | {"0": ("x/y", "two"), "3": ("ÄÖ=1", "two"), "7": ("007", "two")}
    assert {r["chunk_id"]: (r["law"], r["text"]) for r in s.read().collect()} == want
    assert {r["text"] for r in s.read(1).collect()} == {"one"} and s.read(1).count() == len(odd)
    with pytest.raises(FileNotFoundError):
        s.read(9)
    s.versions.vacuum()
    assert {r["chunk_id"]: (r["law"], r["text"]) for r in s.read().collect()} == want and s.versions.numbers() == [2]
    assert s.ingest(make(spark, ("x/y", "0", "three", 1)).limit(0)) == 0 and s.versions.numbers() == [2]


def test_columns_of_the_store_stay(spark, tmp_path):
    s = store.ParquetStore(spark, str(tmp_path / "t"))
    s.ingest(make(spark, ("A", "1", "x", 0)))
    s.ingest(make(spark, ("A", "2", "y", 1)).drop("text").withColumn("extra", F.lit(1)))
    assert s.read().columns == ["law", "chunk_id", "text", "seq", "ingested_at"] and held(s)[1] == ("A", "2", None)


def test_of_statements_of_one_id_the_last_article_stays(spark, tmp_path):
    raw = json.dumps({"statementId": "same", "description": "d"})
    rows = spark.createDataFrame([("B", "Art 1", raw), ("A", "Art 2", raw), ("B", "Art 3", raw), ("A", "Art 9", raw)], "law string, article_ref string, statement_json string").repartition(4)
    typed = rows.withColumn("stmt", F.from_json("statement_json", ddl("PolicyStatement")))
    s = store.StatementStore(spark, str(tmp_path / "s"))
    assert s.store_many(typed) == 1
    assert [(r["law"], r["article_ref"]) for r in s.read().collect()] == [("B", "Art 3")] and "_seq" not in s.read().columns
