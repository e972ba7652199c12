"""Embedding near-duplicates by product quantisation: coarse inverted lists, residual codes, table look-ups, exact rerank.

Centroids and code books are fitted on a bounded sample; every vector is indexed. A vector asks every list that may hold a link of
it by a margin that follows from the distance of a link: no number of lists is fixed, so where many vectors lie close together all
their lists are asked. Look-up distances are taken with the error of the code they come from, so quantisation drops no link; the
rerank is exact. Only the margin can lose links: SURE deviations of a direction taken at random; `sure=inf` asks every list that an
exact bound leaves, which loses none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import carry, discard, shared_table, table
from lexloom.llm.connect import components

#: Vectors that the index is fitted on, at most; vectors to a list on average; centroids of a level at most.
SAMPLE, LIST, MOST = 20_000, 512, 1024
#: Rows of a list that meet at once: those it holds, and those that ask it. Longer lists are dealt out in blocks of each.
HELD, ASKING = 4096, 16_384
#: Deviations allowed for.
SURE = 2.5
#: For rounding, where bounds are compared; the rerank decides.
SLACK = 1e-4
SUBSPACES, CODES = 8, 256


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows."""
    return np.maximum(0, (x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T)


def _near(x: np.ndarray, c: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and which others are near: a vector within `reach` of x is nearest to centroid c only if the
    squared distance of x to c is no more than 2 * reach * |c - own| beyond that to its own, as the difference of squared distances
    to two points is linear. By a random direction it is a normal deviate of that over the root of the dimensions."""
    d = _squares(x, c)
    own = d.argmin(1)
    between = np.sqrt(_squares(c, c))[own]
    near = d - d[np.arange(len(x)), own][:, None] <= 2 * margin[:, None] * between + SLACK
    near[np.arange(len(x)), own] = True
    return own, near


@dataclass
class Index:
    """Lists are numbered coarse * len(fine) + fine: centroids of the vectors, then of what is left to them."""

    coarse: np.ndarray
    fine: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def lists(self, x: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The own list of each row, and (row, list) of those that it asks, its own among them."""
        own, near = _near(x, self.coarse, margin)
        row, coarse = np.nonzero(near)
        if len(self.fine) == 1:
            return own, row, coarse
        home = np.empty(len(x), np.int64)
        rows, found = [], []
        for at in range(0, len(row), 4096):
            r, c = row[at : at + 4096], coarse[at : at + 4096]
            first, inner = _near(x[r] - self.coarse[c], self.fine, margin[r])
            mine = own[r] == c
            home[r[mine]] = c[mine] * len(self.fine) + first[mine]
            i, j = np.nonzero(inner)
            rows.append(r[i]), found.append(c[i] * len(self.fine) + j)
        return home, np.concatenate(rows), np.concatenate(found)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what the codes miss."""
        residual = x - self.centre(lists)
        codes, missed = np.empty((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = residual[:, self.cuts[m] : self.cuts[m + 1]]
            codes[:, m] = ((book**2).sum(1) - 2 * part @ book.T).argmin(1)
            missed += ((part - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(missed)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def fit(sample: np.ndarray, lists: int, seed: int = 5) -> Index:
    """lists: about so many, as far as the sample has centroids to give."""
    rng = np.random.default_rng(seed)
    coarse = _means(sample, min(lists, MOST), rng)
    dims = sample.shape[1]
    subspaces = min(SUBSPACES, dims)
    cuts = [dims * m // subspaces for m in range(subspaces + 1)]
    residual = sample - coarse[_squares(sample, coarse).argmin(1)]
    second = min(MOST, -(-lists // len(coarse)))
    fine = _means(residual, second, rng) if second > 1 else np.zeros((1, dims))
    residual -= fine[_squares(residual, fine).argmin(1)]
    return Index(coarse, fine, [_means(residual[:, a:b], CODES, rng, 5) for a, b in zip(cuts, cuts[1:])], cuts)


def _unit(vectors: pd.Series, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, shorter ones filled up with zeros, and how many components each has. Scaled first: no square of a
    large or small component leaves the range."""
    sizes = np.array([len(v) for v in vectors], np.int64)
    x = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        x[i, : sizes[i]] = v
    x /= np.abs(x).max(1, initial=0, keepdims=True)
    return x / np.sqrt((x**2).sum(1))[:, None], sizes


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label, a star forest, with i[k] and j[k] in one star."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def links(vectors: DataFrame, at_least: float = 0.9, sure: float = SURE) -> DataFrame:
    """(id, linked, root) of the distinct vectors (id long, v, members long), none of them zero.

    A link is a pair of them of one length with cosine >= at_least. linked is the number of members of an id's links, root an id
    in its component: an id has one row for each meeting of a list that holds a link of its, to be summed and joined, and no row
    stands for a single pair. Each pair is counted in one meeting: in the list that comes later, asked from the one before, or in
    the earlier one where only that is asked. Nulls, zeros and repeated vectors are the caller's to take out; vectors at the threshold
    exactly are linked; fewer than two vectors give no rows; other columns are not looked at.
    """
    spark = vectors.sparkSession
    seen = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    n, dims = seen["n"], seen["dims"]
    if n < 2:
        return spark.createDataFrame([], "id long, linked long, root long")
    picked = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    carried = carry(spark, fit(_unit(picked["v"], dims)[0], max(1, n // LIST)))
    reach = float(np.sqrt(max(0, 2 - 2 * at_least)))

    def assign(batches):
        for whole in batches:
            for at in range(0, len(whole), 2048):
                pdf, own = whole.iloc[at : at + 2048], carried()
                x, sizes = _unit(pdf["v"], dims)
                lists, row, asked = own.lists(x, reach * np.minimum(1, sure / np.sqrt(sizes)))
                codes, missed = own.encode(x, lists)
                order = np.lexsort((asked, row))
                probes = np.split(asked[order], np.searchsorted(row[order], np.arange(1, len(x))))
                yield pd.DataFrame({"list": lists, "id": pdf["id"].to_numpy(), "x": [v.tobytes() for v in x], "size": sizes, "members": pdf["members"].to_numpy(), "code": [c.tobytes() for c in codes], "missed": missed, "probes": probes})

    indexed = shared_table(spark, vectors.select("id", "v", "members").mapInPandas(assign, "list long, id long, x binary, size long, members long, code binary, missed double, probes array<long>"), "index")
    asks = indexed.select("id", "x", "size", "members", F.col("list").alias("own"), F.explode("probes").alias("list"))
    # how many blocks a list is dealt out in
    count = asks.groupBy("list").agg(F.count(F.lit(1)).alias("asking")).join(indexed.groupBy("list").agg(F.count(F.lit(1)).alias("held")), "list")
    blocks = count.select("list", F.ceil(F.col("held") / HELD).cast("int").alias("parts"), F.ceil(F.col("asking") / ASKING).cast("int").alias("turns"))
    salt = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("code", "binary"), ("missed", "double"), ("probes", "array<long>"))]
    held = indexed.join(blocks, "list").select("list", salt("parts").alias("part"), every("turns").alias("turn"), F.lit(None).cast("long").alias("own"), "id", "x", "size", "members", "code", "missed", "probes")
    asking = asks.join(blocks, "list").select("list", every("parts").alias("part"), salt("turns").alias("turn"), "own", "id", "x", "size", "members", *none)

    def search(key, rows: pd.DataFrame) -> pd.DataFrame:
        model: Index = carried()
        here = rows["own"].isna().to_numpy()
        y, q = rows[here], rows[~here]
        unit = lambda r: np.frombuffer(b"".join(r["x"]), np.float64).reshape(len(r), -1)
        ids = np.concatenate([q["id"].to_numpy(), y["id"].to_numpy()])
        members = np.concatenate([q["members"].to_numpy(), y["members"].to_numpy()])
        label, linked = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        xq, xy, start = unit(q), unit(y), len(q)
        codes = np.frombuffer(b"".join(y["code"]), np.uint8).reshape(len(y), -1).astype(np.intp)
        middle = model.centre(np.array([key[0]]))
        decoded = middle + np.hstack([book[codes[:, m]] for m, book in enumerate(model.books)])
        limit = (reach + y["missed"].to_numpy() + SLACK) ** 2
        # |q - y|^2 <= limit for the decoded y, as q.y >= least
        least = ((1 + (decoded**2).sum(1) - limit) / 2 - SLACK).astype(np.float32)
        own, size_q, size_y, probes = q["own"].to_numpy().astype(np.int64), q["size"].to_numpy(), y["size"].to_numpy(), y["probes"].to_numpy()
        for at in range(0, len(q), 256):
            part = xq[at : at + 256]
            dot = np.repeat((part @ middle.T).astype(np.float32), len(y), axis=1)
            for m, book in enumerate(model.books):
                dot += np.take((part[:, model.cuts[m] : model.cuts[m + 1]] @ book.T).astype(np.float32), codes[:, m], axis=1)
            i, j = np.nonzero(dot >= least)
            ok = np.concatenate([(part[i[c : c + 100_000]] * xy[j[c : c + 100_000]]).sum(1) >= at_least for c in range(0, len(i), 100_000)] or [np.zeros(0, bool)])
            i, j = i[ok] + at, j[ok]
            # a list is asked from itself in both directions, from another in one or two
            once = np.where(own[i] == key[0], ids[i] < ids[start + j], own[i] < key[0]) & (size_q[i] == size_y[j])
            late = np.flatnonzero((own[i] > key[0]) & (size_q[i] == size_y[j]))
            if len(late):
                once[late] = [own[a] not in probes[b] for a, b in zip(i[late], j[late])]
            i, j = i[once], j[once] + start
            np.add.at(linked, i, members[j]), np.add.at(linked, j, members[i])
            label = _joined(label, i, j)
        some = linked > 0
        return pd.DataFrame({"id": ids[some], "linked": linked[some], "root": ids[label[some]]})

    out = shared_table(spark, held.unionByName(asking).groupBy("list", "part", "turn").applyInPandas(search, "id long, linked long, root long"), "links")
    discard(indexed)
    return out


def near_duplicates(rows: DataFrame, at_least: float = 0.9, sure: float = SURE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of rows (vec_id, embedding).

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing, as do rows with a null id;
    vectors of different lengths don't link with each other. Components are read in their own type (others than float as double)
    and compared in double precision, at any magnitude. Equal vectors form a class and never meet in pairs: a link between classes
    counts for all their members. Rows that share an id count their own vector's links and are one vertex. An empty table gives an
    empty result; other columns are not looked at.
    """
    spark = rows.sparkSession
    own = rows.schema["embedding"].dataType
    kind = "array<float>" if isinstance(own, T.ArrayType) and isinstance(own.elementType, T.FloatType) else "array<double>"
    every = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    every = every.withColumn("fine", F.coalesce(fine, F.lit(False)))
    usable = every.filter("fine")
    classes = usable.groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("members"))
    classes = shared_table(spark, classes.select(F.monotonically_increasing_id().alias("id"), "v", "least", "members"), "vectors")
    member = shared_table(spark, usable.join(classes, "v").select("vec_id", "id", "least", "members"), "members")
    found = links(classes.select("id", "v", "members"), at_least, sure)
    weight = found.groupBy("id").agg(F.sum("linked").alias("linked"))
    # one id on several vectors: their classes are one vertex
    several = member.groupBy("vec_id").agg(F.min("id").alias("root"), F.max("id").alias("most")).filter("root <> most").select("vec_id", "root")
    several = member.join(several, "vec_id").select("id", "root").filter("id <> root")
    found = components(found.select("id", "root").unionByName(several), "id", "root")
    named = found.join(classes.select("id", "least"), "id")
    named = named.join(named.groupBy("component_id").agg(F.min("least").alias("label")), "component_id").select("id", "label")
    out = member.join(weight, "id", "left").join(named, "id", "left")
    out = out.select("vec_id", (F.coalesce("linked", F.lit(0)) + F.col("members") - 1).cast("long").alias("n_links"), F.coalesce("label", "least").alias("component_id"))
    out = out.unionByName(every.filter("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
