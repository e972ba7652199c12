"""Results that are asked for in an order come in it; roundings of the JSON report."""

import json

from pyspark.sql import functions as F

from lexloom.operators import store
from lexloom.operators.gaps import coverage
from lexloom.plans import queries as q
from lexloom.plans.report import Report

SF = "/root/testdata/sf0.001"


def test_statements_and_laws_come_in_order(spark):
    rows = q.statements(spark, SF).withColumn("article_ref", F.md5(F.monotonically_increasing_id().cast("string"))).repartition(5)
    law = rows.groupBy("law").count().orderBy(F.desc("count")).first()["law"]
    refs = [r["article_ref"] for r in store.statements_for_law(rows, law.lower()).collect()]
    assert refs == sorted(refs) and len(refs) == rows.filter(F.col("law") == law).count() > 5
    names = [r["law"] for r in store.laws(rows).collect()]
    assert names == sorted(set(names)) and len(names) > 5
    found = store.articles(rows.select("law", "article_ref", F.lit("article").alias("level"), F.array().cast("array<string>").alias("concept_tags")), law)
    assert [r["article_ref"] for r in found.collect()] == refs


def test_rates_of_the_report_are_rounded(spark):
    """The two rates of their own to three places, as Spark rounds them; those in the matrix as they are."""
    rows = q.statements(spark, SF)
    told = json.loads(Report(rows).json())
    cov = coverage(rows)
    for name, flag in (("retention_rates", "has_retention"), ("dpia_rates", "has_dpia")):
        want = {r["law"]: r["x"] for r in cov.select("law", F.bround(F.col(flag) / F.col("total"), 3).alias("x")).collect()}
        assert told[name] == want and len(want) > 5
    assert any(x != round(x, 3) for row in told["coverage_matrix"].values() for x in row.values() if isinstance(x, float))
