"""Benchmark decontamination: size-partitioned MinHash containment search, confirmed by exact shingle containment.

An item's sketch is the bottom-k MinHash of its shingles, with a k that goes with its size: a document that holds four fifths of an
item lacks at most `slack` of its shingles, so of a sketch of slack + FOUND it holds FOUND at least, however long the document is.
The search looks the document's shingles up in the sketches and loses no item. Documents are partitioned by size, and the sketch of an
item stands in those partitions only that can hold enough of it: the size is part of the key that documents and sketches meet by.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import shared_table, table

SHINGLE, PERCENT = 5, 80
#: Of a sketch so many have to be found, or all that an item of few shingles must have.
FOUND = 6
#: The last partition by size: that of 2 ** 31 windows and more.
LAST = 31
#: Bytes of the item tables that are broadcast at most, ROW for each row besides its text; larger ones are joined by shuffle.
BROADCAST_BYTES, ROW = 32 << 20, 80


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda x: x != "")


def _windows(size: int, of, kind: str) -> Column:
    """of(position) for each window of `size` words."""
    n = F.size("_w")
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), of)).otherwise(F.expr(f"CAST(array() AS array<{kind}>)"))


def _hashes(size: int) -> Column:
    return _windows(size, lambda i: F.xxhash64(F.lit(size), *[F.get("_w", i + j) for j in range(size)]), "bigint")


def _strings(size: int) -> Column:
    return _windows(size, lambda i: F.concat_ws(" ", *[F.get("_w", i + j) for j in range(size)]), "string")


def _labelled(size: int) -> Column:
    return F.transform(_strings(size), lambda s: F.struct(F.lit(size).alias("_k"), s.alias("shingle")))


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item, n_found, containment) of each document that holds 80 % of an item's five-word shingles or more.

    Words are lower-cased and split at white space; an item of fewer than five words is one shingle. Null and empty texts hold
    nothing and are held by nothing, as are rows with null ids. What rows that share an id hold adds up, however small each is. Very long texts are searched whole; items of equal text are found alike, each under its id; an
    item at the threshold exactly is held. Empty tables give an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    words = items.filter("item_id IS NOT NULL").select("item_id", _words("text").alias("_w")).filter(F.size("_w") > 0).withColumn("_k", F.least(F.size("_w"), F.lit(SHINGLE)))
    per_size = None
    for k in range(1, SHINGLE + 1):
        own = words.filter(F.col("_k") == k).select("item_id", "_k", F.explode(_strings(k)).alias("shingle"))
        per_size = own if per_size is None else per_size.unionByName(own)
    shingles = shared_table(spark, per_size.distinct(), "items")
    sizes = [r["_k"] for r in shingles.select("_k").distinct().collect()]
    total = shingles.agg(F.coalesce(F.sum(F.octet_length("shingle") + ROW), F.lit(0)).alias("bytes")).first()["bytes"]
    n_item = shingles.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    # distinct hashes: shingles that share one, if any do, are found together, so no more are lacking than of the shingles
    sketches = _item_hashes(shingles).groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("s")).join(n_item, "item_id")
    least = F.ceil(F.col("n_item") * PERCENT / 100 - 1e-9)
    slack = (F.col("n_item") - least).cast("int")
    # the partitions, by the power of two of the number of shingles, whose documents are large enough
    enough = F.floor(F.log2(least)).cast("int")
    sketches = sketches.select("item_id", slack.alias("slack"), enough.alias("least_part"), F.slice("s", F.lit(1), slack + FOUND).alias("s"))
    sketches = sketches.select("item_id", (F.size("s") - F.col("slack")).cast("long").alias("need"), "least_part", F.explode("s").alias("h"))

    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    split = docs.select("doc_id", _words("text").alias("_w"))
    every = F.concat(*[_hashes(k) for k in sizes]) if sizes else F.expr("CAST(array() AS array<bigint>)")
    part = F.floor(F.log2(F.greatest(F.size("_w") * F.lit(max(1, len(sizes))), F.lit(1)))).cast("int")
    # what rows that share an id hold adds up, so none of them is too small: they are in the last partition
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select("doc_id", F.lit(LAST).alias("_part"))
    shared = shared_table(spark, shared, "shared")
    placed = split.join(_small(shared, shared.count() * ROW), "doc_id", "left").select("doc_id", F.coalesce("_part", part).alias("part"), "_w")
    looked_up = placed.select("doc_id", "part", F.explode(every).alias("h"))
    # each partition is asked for the items that it can hold only
    asked = sketches.withColumn("part", F.explode(F.sequence(F.greatest("least_part", F.lit(0)), F.lit(LAST)))).drop("least_part")
    hits = looked_up.join(_small(asked, total * (LAST + 1)), ["part", "h"])
    candidates = hits.groupBy("doc_id", "item_id", "need").agg(F.countDistinct("h").alias("found")).filter("found >= need").select("doc_id", "item_id")
    candidates = shared_table(spark, candidates, "candidates")

    again = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", _words("text").alias("_w"))
    texts = F.concat(*[_labelled(k) for k in sizes]) if sizes else F.expr("CAST(array() AS array<struct<_k:int,shingle:string>>)")
    held = again.select("doc_id", F.explode(texts).alias("x")).select("doc_id", "x._k", "x.shingle")
    exact = held.join(_small(shingles, total), ["_k", "shingle"]).join(candidates, ["doc_id", "item_id"], "left_semi")
    exact = exact.groupBy("doc_id", "item_id").agg(F.countDistinct("shingle").alias("n_found")).join(_small(n_item, total), "item_id")
    exact = exact.filter(F.col("n_found") * 100 >= F.col("n_item") * PERCENT)
    return exact.select("doc_id", "item_id", "n_item", "n_found", (F.col("n_found") / F.col("n_item")).alias("containment"))


def _item_hashes(shingles: DataFrame) -> DataFrame:
    """The same hashes of an item's shingles as a document's windows get."""
    w = shingles.withColumn("_w", F.split("shingle", " "))
    h = F.lit(None).cast("long")
    for k in range(1, SHINGLE + 1):
        h = F.when(F.col("_k") == k, F.xxhash64(F.lit(k), *[F.get("_w", F.lit(j)) for j in range(k)])).otherwise(h)
    return w.select("item_id", h.alias("h"))


def op10_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda p: array_to_string(w[p : p + least(len(w), 5) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
z AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY 1),
t AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p : p + k - 1], ' '))) AS g FROM d, (SELECT DISTINCT k FROM s) WHERE len(w) >= k),
f AS (SELECT doc_id, item_id, count(DISTINCT t.g) AS n_found FROM t JOIN s USING (k, g) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_found, n_found / n_item AS containment FROM f JOIN z USING (item_id) WHERE n_found * 100 >= n_item * 80
"""
