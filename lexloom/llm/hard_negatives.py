"""Hard negatives by dual-tree search: a tree over the candidates and one over the anchors, pairs of nodes ruled out by inner-product bounds.

Both trees are cut by the same planes, fitted on a bounded sample, and hold every row: a node's radius is the greatest distance of a row
in it to the node's centre, so what the planes are changes the time only. From the roots down, a pair of nodes is kept while the interval
of inner products that centres, radii and lengths allow meets what an anchor below still asks for; a level is two joins. What is left
are pairs of blocks, in which small leaves are ruled out in the same way and the rest is scored in exact integers.

An ask is an interval of scores and a number of best rows in it. Each search first looks into a block of the anchor's own cell: the
worst of as many rows as are asked for raises the interval's lower end for the trees.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import carry, shared_table, table

#: Rows and components that the planes are fitted on, at most; levels of planes from them, twice at most (of rows, then of residuals).
SAMPLE, COMPONENTS, DEPTH = 20_000, 1 << 22, 12
#: Candidates and anchors to a block, about, and to a leaf inside one; levels of planes between two levels of node pairs.
HELD, ASKING, LEAF, FAN = 4096, 1024, 128, 4
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Squared lengths from here on don't fit 64-bit scores.
MOST = float(1 << 62)
LONG = (1 << 63) - 1
PAIR = "row long, ask int, id long, other long, score long"


@dataclass
class Planes:
    """Node n has the children 2n and 2n + 1, from 1; its mean is that of the sample's rows in it, or else its parent's."""

    depth: int
    normal: np.ndarray
    cut: np.ndarray
    mean: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, depth: int) -> Planes:
        dims = x.shape[1]
        out = cls(depth, np.zeros((1 << depth, dims)), np.zeros(1 << depth), np.zeros((2 << depth, dims)))
        held = {1: np.arange(len(x))}
        for node in range(1, 2 << depth):
            at = held.pop(node)
            rows = x[at]
            out.mean[node] = rows.mean(0) if len(at) else out.mean[node >> 1]
            if node < 1 << depth:
                if len(at) > 1:
                    # from a row far from the middle to one far from it
                    a = rows[((rows - out.mean[node]) ** 2).sum(1).argmax()]
                    out.normal[node] = rows[((rows - a) ** 2).sum(1).argmax()] - a
                    out.cut[node] = np.median(rows @ out.normal[node])
                right = rows @ out.normal[node] > out.cut[node]
                held[2 * node], held[2 * node + 1] = at[~right], at[right]
        return out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + ((x * self.normal[node]).sum(1) > self.cut[node])
        return node


@dataclass
class Tree:
    """Planes over the rows, below them planes over what the means of the leaves leave of them; levels: depths of node pairs."""

    first: Planes
    second: Planes
    levels: list[int]

    @classmethod
    def fit(cls, x: np.ndarray, depth: int) -> Tree:
        own = min(depth, DEPTH, int(log2(max(1, len(x) // 8) or 1)))
        first = Planes.fit(x, own)
        second = Planes.fit(x - first.mean[first.leaves(x)], min(depth - own, own))
        depth = own + second.depth
        return cls(first, second, list(range(depth % FAN, depth + 1, FAN)))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = self.first.leaves(x)
        inner = self.second.leaves(x - self.first.mean[node]) if self.second.depth else np.ones(len(x), np.int64)
        return (node << self.second.depth) | (inner - (1 << self.second.depth))

    def centre(self, node: np.ndarray, depth: int) -> np.ndarray:
        """The centres of nodes at this depth, numbered as `leaves` and their parents are."""
        below = depth - self.first.depth
        if below <= 0:
            return self.first.mean[node]
        return self.first.mean[node >> below] + self.second.mean[(node & ((1 << below) - 1)) | (1 << below)]


def _interval(dot, ra, la, rb, lb, na, nb):
    """Bounds of the inner products of rows within ra of a centre of length la, and no longer than na, with others."""
    far = ra * lb + rb * la + ra * rb
    least, most = np.maximum(dot - far, -na * nb), np.minimum(dot + far, na * nb)
    slack = 1 + 1e-9 * (np.abs(dot) + far)
    return least - slack, most + slack


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; by way of doubles where these hold every sum on the way exactly."""
    long = np.sqrt((a.astype(np.float64) ** 2).sum(1).max(initial=0)) * np.sqrt((b.astype(np.float64) ** 2).sum(1).max(initial=0))
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if long < 2.0**52 else a @ b.T


def _blocks(placed: DataFrame, size: int, carried) -> DataFrame:
    """(node, block, n, norm, far, ids, labels, rows, v): rows of one cell, about `size` of them, sorted into small leaves. far holds
    the greatest distance to the centre of each level; norm is the greatest length. A cell of more rows is several blocks."""
    parts = placed.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    dealt = placed.join(parts, "node").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        tree: Tree = carried()
        v = np.frombuffer(b"".join(rows["v"]), np.int64).reshape(len(rows), -1)
        x = v.astype(np.float64)
        bottom = tree.levels[-1]
        far = [float(np.sqrt(((x - tree.centre(np.array([key[0] >> (bottom - d)]), d)) ** 2).sum(1).max())) for d in tree.levels]
        order = np.argsort(Planes.fit(x, max(0, ceil(log2(len(x) / LEAF)))).leaves(x), kind="stable")
        held = lambda c: rows[c].to_numpy()[order].astype(np.int64).tobytes()
        return pd.DataFrame({"node": [key[0]], "block": [(key[0] << 24) + key[1]], "n": [len(x)], "norm": [float(np.sqrt((x**2).sum(1).max()))], "far": [far], "ids": [held("id")], "labels": [held("label")], "rows": [held("row")], "v": [v[order].tobytes()]})

    out = dealt.groupBy("node", "part").applyInPandas(pack, "node long, block long, n long, norm double, far array<double>, ids binary, labels binary, rows binary, v binary")
    return shared_table(placed.sparkSession, out, "blocks")


def _score(same: bool, k: int):
    def run(batches):
        for batch in batches:
            for pair in batch.to_pylist():
                a, b = ({c: np.frombuffer(pair[f"{s}_{c}"], np.int64) for c in ("ids", "labels", "rows", "v")} for s in "ab")
                a["v"], b["v"] = a["v"].reshape(len(a["rows"]), -1), b["v"].reshape(len(b["rows"]), -1)
                yield _best(a, b, pair["asks"], same, k)

    return run


def _leaves(v: np.ndarray) -> list[tuple]:
    """(from, centre, radius, its length, greatest length) of each run of LEAF rows."""
    out = []
    for at in range(0, len(v), LEAF):
        x = v[at : at + LEAF].astype(np.float64)
        c = x.mean(0)
        out.append((at, c, np.sqrt(((x - c) ** 2).sum(1).max()), np.sqrt((c**2).sum()), np.sqrt((x**2).sum(1).max())))
    return out


def _best(a: dict, b: dict, asks: list[dict], same: bool, k: int) -> pa.RecordBatch:
    """The k best rows of block b for each ask of block a, ties by id and row."""
    place = {r: i for i, r in enumerate(a["rows"].tolist())}
    of: dict[int, list] = {}
    for x in asks:
        of.setdefault(place[x["row"]], []).append(x)
    leaves = _leaves(b["v"])
    _, cb, rb, lb, nb = (np.array(c) for c in zip(*leaves))
    out: list[list] = [[], [], [], [], []]
    for at, ca, ra, la, na in _leaves(a["v"]):
        mine = [i for i in range(at, min(at + LEAF, len(a["rows"]))) if i in of]
        if not mine:
            continue
        low, high = min(x["lo"] for i in mine for x in of[i]), max(x["hi"] for i in mine for x in of[i])
        least, most = _interval(cb @ ca, ra, la, rb, lb, na, nb)
        open_ = np.flatnonzero((most >= low) & (least <= high))
        if not len(open_):
            continue
        at_b = np.concatenate([np.arange(leaves[j][0], min(leaves[j][0] + LEAF, len(b["rows"]))) for j in open_])
        scores = _exact(a["v"][mine], b["v"][at_b])
        ids, labels, rows = (b[c][at_b] for c in ("ids", "labels", "rows"))
        for i, s in zip(mine, scores):
            fits = ((labels == a["labels"][i]) == same) & (rows != a["rows"][i])
            for x in of[i]:
                j = np.flatnonzero(fits & (s >= x["lo"]) & (s <= x["hi"]))
                if len(j) > k:
                    j = j[s[j] >= np.partition(s[j], len(j) - k)[len(j) - k]]
                j = j[np.lexsort((rows[j], ids[j], -s[j]))[:k]]
                for column, y in zip(out, (np.full(len(j), x["row"]), np.full(len(j), x["ask"], np.int32), ids[j], rows[j], s[j])):
                    column.append(y)
    columns = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out]
    return pa.RecordBatch.from_arrays([columns[0], columns[1].cast(pa.int32()), *columns[2:]], ["row", "ask", "id", "other", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("row", "ask").orderBy(F.desc("score"), "id", "other"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k)


class _Trees:
    """Blocks of anchors and candidates, and searches over them."""

    def __init__(self, placed: DataFrame, carried, tree: Tree):
        self.levels, self.carried, self.spark = tree.levels, carried, placed.sparkSession
        self.anchors, self.candidates = _blocks(placed.filter("anchor"), ASKING, carried), _blocks(placed, HELD, carried)
        self.bottom = tree.levels[-1]

    def _nodes(self, blocks: DataFrame, level: int, side: str, *more: Column) -> DataFrame:
        """The nodes of a level: `side`, its parent, radius and greatest length."""
        node = F.shiftright("node", self.bottom - self.levels[level])
        out = blocks.groupBy(node.alias(side)).agg(F.max(F.get("far", F.lit(level))).alias(f"r{side}"), F.max("norm").alias(f"n{side}"), *more)
        return out.withColumn(f"p{side}", F.shiftright(side, self.levels[level] - self.levels[level - 1] if level else 0))

    def _open(self, pairs: DataFrame, level: int) -> DataFrame:
        """The pairs whose interval meets that of the asks."""
        carried, depth = self.carried, self.levels[level]

        @F.pandas_udf("boolean")
        def open_(a: pd.Series, b: pd.Series, ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
            tree: Tree = carried()
            ca, cb = tree.centre(a.to_numpy(), depth), tree.centre(b.to_numpy(), depth)
            length = lambda c: np.sqrt((c**2).sum(1))
            least, most = _interval((ca * cb).sum(1), ra.to_numpy(), length(ca), rb.to_numpy(), length(cb), na.to_numpy(), nb.to_numpy())
            return pd.Series((most >= lo.to_numpy().astype(np.float64)) & (least <= hi.to_numpy().astype(np.float64)))

        return pairs.filter(open_("a", "b", "ra", "rb", "na", "nb", "lo", "hi"))

    def _scored(self, pairs: DataFrame, asks: DataFrame, same: bool, k: int, what: str) -> DataFrame:
        """pairs (x, y) of blocks."""
        columns = ("ids", "labels", "rows", "v")
        held = lambda df, key, side: df.select(F.col("block").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        of = asks.groupBy(F.col("block").alias("x")).agg(F.collect_list(F.struct("row", "ask", "lo", "hi")).alias("asks"))
        rows = pairs.join(of, "x").join(held(self.anchors, "x", "a"), "x").join(held(self.candidates, "y", "b"), "y").drop("x", "y")
        return shared_table(self.spark, rows.mapInArrow(_score(same, k), PAIR), what)

    def search(self, asks: DataFrame, same: bool, k: int) -> DataFrame:
        """(row, ask, id, other, score, rank): the k best candidates of each ask (row, block, ask, lo, hi), of the anchor's label or of
        others, never the anchor's own row."""
        first = self.candidates.groupBy("node").agg(F.min("block").alias("y"))
        near = shared_table(self.spark, self.anchors.select("node", F.col("block").alias("x")).join(first, "node").select("x", "y"), "near")
        seeds = self._scored(near, asks, same, k, "seeds")
        worst = seeds.groupBy("row", "ask").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("worst")).filter(F.col("c") == k).drop("c")
        asks = asks.join(worst, ["row", "ask"], "left").select("row", "block", "ask", F.greatest("lo", F.coalesce("worst", "lo")).alias("lo"), "hi")
        asks = shared_table(self.spark, asks, "asks")
        ends = asks.groupBy("block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        asking = self.anchors.select("node", "block", "far", "norm").join(ends, "block")
        pairs = None
        for level in range(len(self.levels)):
            a = self._nodes(asking, level, "a", F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            b = self._nodes(self.candidates, level, "b")
            if pairs is None:  # a few nodes of each tree
                pairs = a.crossJoin(b)
            else:
                pairs = pairs.select(F.col("a").alias("pa"), F.col("b").alias("pb")).join(a, "pa").join(b, "pb")
            pairs = shared_table(self.spark, self._open(pairs, level).select("a", "b"), "pairs")
        last = F.get("far", F.lit(len(self.levels) - 1))
        a = asking.select(F.col("node").alias("a"), F.col("block").alias("x"), last.alias("ra"), F.col("norm").alias("na"), "lo", "hi")
        b = self.candidates.select(F.col("node").alias("b"), F.col("block").alias("y"), last.alias("rb"), F.col("norm").alias("nb"))
        left = self._open(pairs.join(a, "a").join(b, "b"), len(self.levels) - 1).select("x", "y").join(near, ["x", "y"], "left_anti")
        return shared_table(self.spark, _ranked(seeds.unionByName(self._scored(left, asks, same, k, "found")), k), "best")


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (id long, label long, v array<long>, anchor).

    Of each anchor the first `positives` other rows of its label by inner product are its positives; for each of these come the first
    `negatives` rows of another label whose score is `low` to `high` per cent of the positive's. Higher scores come first, ties by the
    smaller id. All rows are candidates, whatever they are else.

    Rows with a null id, label, vector or component take no part, nor do those whose squared length reaches 2 ** 62, as their scores
    would leave 64 bits. Shorter vectors count as filled up with zeros. Rows that share an id are rows of their own: each is compared
    with the others, and an anchor is only never its own partner. Positives of scores below 0 have no negatives. No anchors, no rows
    or one label only give an empty result; other columns are not looked at.
    """
    spark = rows.sparkSession
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull())
    length = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    usable = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull()).filter(F.coalesce(whole, F.lit(False)))
    usable = usable.filter(length < MOST).select("id", "label", "v", F.coalesce("anchor", F.lit(False)).alias("anchor"))
    staged = shared_table(spark, usable.withColumn("row", F.monotonically_increasing_id()), "vectors")
    seen = staged.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    dims = max(1, seen["dims"] or 1)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not seen["n"]:
        return spark.createDataFrame([], empty)

    def filled(vectors) -> np.ndarray:
        out = np.zeros((len(vectors), dims), np.int64)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    sample = staged.select("row", "v").orderBy(F.xxhash64("row"), "row").limit(max(1, min(SAMPLE, COMPONENTS // dims))).toPandas()
    tree = Tree.fit(filled(sample["v"]).astype(np.float64), max(0, ceil(log2(seen["n"] / HELD))))
    carried = carry(spark, tree)

    def assign(batches):
        for pdf in batches:
            v = filled(pdf.pop("v"))
            yield pdf.assign(v=[x.tobytes() for x in v], node=carried().leaves(v.astype(np.float64)))

    placed = shared_table(spark, staged.select("row", "id", "label", "anchor", "v").mapInPandas(assign, "row long, id long, label long, anchor boolean, v binary, node long"), "placed")
    trees = _Trees(placed, carried, tree)
    place = trees.anchors.mapInArrow(_rows_of, "row long, block long")
    whole = place.select("row", "block", F.lit(0).alias("ask"), F.lit(-LONG - 1).alias("lo"), F.lit(LONG).alias("hi"))
    near = trees.search(whole, True, positives).select("row", F.col("rank").alias("ask"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # per cent of a score without leaving 64 bits: of its hundreds, and of what is left
    rest = F.pmod("positive_score", F.lit(100))
    hundreds = F.expr("(positive_score - pmod(positive_score, 100)) div 100")
    bands = near.withColumn("lo", hundreds * low + F.ceil(rest * low / 100)).withColumn("hi", hundreds * high + F.floor(rest * high / 100))
    found = trees.search(bands.filter("lo <= hi").join(place, "row").select("row", "block", "ask", "lo", "hi"), False, negatives)
    out = found.select("row", "ask", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(near, ["row", "ask"])
    out = out.join(placed.select("row", F.col("id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _rows_of(batches):
    for batch in batches:
        rows = [np.frombuffer(x, np.int64) for x in batch.column(batch.schema.get_field_index("rows")).to_pylist()]
        if rows:
            blocks = batch.column(batch.schema.get_field_index("block")).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.repeat(blocks, [len(x) for x in rows]))], ["row", "block"])


def quantised(vectors: DataFrame) -> DataFrame:
    """Rows of vectors (vec_id, embedding, label) for `hard_negatives`: components as floor(256 * x); where vec_id is divisible by 7 the
    label is the next of ten; anchors are the ids divisible by 100. A vector with a null or non-finite component is null."""
    x = F.transform("embedding", lambda c: c.cast("double") * 256)
    fine = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > 2.0**62))
    label = F.col("label").cast("long")
    return vectors.select(
        F.col("vec_id").cast("long").alias("id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.when(fine, F.transform(x, lambda c: F.floor(c))).alias("v"), (F.col("vec_id") % 100 == 0).alias("anchor"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(quantised(table(spark, sf_dir, "embeddings")))


ORACLE_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, b.r, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1] * z[2], 0))), 0)::BIGINT AS score
  FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT ar, anchor_id, vec_id AS positive_id, r, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) <= 5),
n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY ar, p.r ORDER BY score DESC, vec_id, s.r) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (ar, anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
