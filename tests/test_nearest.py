"""Top-k by blocks against plain Python: ties, lengths, vectors that are nothing, ids of any type."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import tfidf


def cosine(a, b):
    if a is None or b is None or None in a or None in b or len(a) != len(b) or not any(a) or not any(b):
        return 0.0
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b))


@pytest.mark.parametrize("text_ids", [False, True])
@pytest.mark.parametrize(("k", "least"), [(3, -1.0), (500, -1.0), (5, 0.4), (None, 0.4)])
def test_nearest_equals_plain_python(spark, monkeypatch, text_ids, k, least):
    monkeypatch.setattr(tfidf, "PACKED", 32)
    rnd = random.Random(5)
    vectors = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(150)]
    vectors += [vectors[3]] * 40 + [[0.0] * 6, None, [], [1.0, None, 2.0, 0.0, 0.0, 0.0], [1.0, 2.0], [3.0, 1.0], [1e200, 0.0]]
    name = (lambda i: f"id{i:03}") if text_ids else (lambda i: i)
    kind = "string" if text_ids else "long"
    rows = spark.createDataFrame([(name(i), v) for i, v in enumerate(vectors)], f"id {kind}, vector array<double>").repartition(3)
    asked = [3, 7, 150, 190, 191, 192, 194]
    queries = spark.createDataFrame([(name(i), vectors[i]) for i in asked], f"qid {kind}, vector array<double>")
    got = tfidf.nearest(rows, queries, k, least).collect()
    want = {}
    for q in asked:
        scored = sorted((-round(cosine(vectors[q], v), 9), name(i)) for i, v in enumerate(vectors) if cosine(vectors[q], v) >= least - 1e-12)
        want[name(q)] = [(i, -s) for s, i in (scored[:k] if k else scored)]
    for q, own in want.items():
        mine = sorted((r["rk"] if k else 0, -round(r["score"], 9), r["id"]) for r in got if r["qid"] == q)
        assert [(i, -s) for _, s, i in mine] == own


def test_a_pair_of_blocks_gives_few_rows(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "PACKED", 100)
    rows = spark.range(1000).coalesce(1).select("id", F.array(*[F.rand(i) for i in range(4)]).alias("vector"))
    pairs = tfidf.packed(rows, "id", "x").crossJoin(tfidf.packed(rows.filter("id < 5").withColumnRenamed("id", "qid"), "qid", "q"))
    assert pairs.count() == 10 and pairs.mapInArrow(tfidf.scoring(3, -1.0), "qid long, id long, score double").count() == 10 * 5 * 3


def test_no_rows_and_no_queries(spark):
    rows = spark.createDataFrame([(1, [1.0])], "id long, vector array<float>")
    queries = rows.withColumnRenamed("id", "qid")
    assert tfidf.nearest(rows.limit(0), queries).count() == 0 and tfidf.nearest(rows, queries.limit(0)).count() == 0
    assert np.isclose(tfidf.nearest(rows, queries).first()["score"], 1)
