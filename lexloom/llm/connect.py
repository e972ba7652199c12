"""Connected components by alternating large and small stars, with pre-contraction inside partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import checkpointed


#: So few edges that one task can hold them: they are finished there, which spares the rounds.
FEW = 100_000
#: Vertices of a partition's forest that are held at once; more edges start a new one.
HELD = 500_000


def _forest(batches):
    """Spanning star forests of one partition's edges, HELD vertices each or few more: at most one row a vertex and forest, however
    many edges there are."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    def stars():
        out = [(v, root(v)) for v in list(parent)]
        parent.clear()
        for at in range(0, len(out), 50_000):
            part = np.array(out[at : at + 50_000], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= HELD:
            yield from stars()
    yield from stars()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component_id): the smallest id reachable, for every id that has an edge to another one.

    Rows with a null end and loops are no edges; repeated edges count once; no edges give an empty result. Every round is two
    shuffles of at most one row a vertex and edge and is checkpointed; the number of rounds grows with the logarithm of the
    longest path, and ends where FEW edges are left or nothing changes.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = e.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").mapInArrow(_forest, "u long, v long").distinct()
    state = None
    e = checkpointed(e)
    while True:
        seen = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] <= FEW and seen != state:
            e = checkpointed(e.repartition(1).mapInArrow(_forest, "u long, v long").filter("u <> v"))
            state = seen
        if seen == state or not seen["n"]:
            return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
        state = seen
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
