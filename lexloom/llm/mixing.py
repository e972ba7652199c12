"""Mixing sources to target weights: hash-random keys, a sort by ranges within each source, distributed prefix sums, exact budgets.

Targets are found as water is filled: the sources of least cap a unit of weight reach their caps first, and what they leave is shared
by weight among the others. In random order each source then gives its words up to its budget: whole rounds of all its documents
first, then those whose words lie before the cut, and of the document on the cut the words before it. DataFrame functions only.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import fresh, shared_table, table

WORD = r"[^\x20\x09-\x0D]+"
#: A piece of text for each word, with the white space after it.
BOUNDARY = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"
#: By place among the sources in code-point order, repeating; and how often a source is taken at most.
WEIGHTS, MOST, SEED = (1, 2, 3), 3, 13


def prefix_sums(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with a column for each of `sums`: its sum over the rows of the same `by` that come earlier in `order`.

    The rows are dealt out by ranges of (by, order) and written; a range adds up its own rows and gets what the ranges before it hold
    from one row a range and group. So a group of any size is spread over as many ranges as it needs, if `order` tells its rows apart;
    rows that it does not tell apart are ordered anyhow. `by` and `order` hold no nulls. The table written is `lexloom_path`.
    """
    spark = rows.sparkSession
    part = fresh(rows, "_part")
    at = {name: fresh(rows, f"_before_{name}") for name in sums}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = shared_table(spark, rows.repartitionByRange(n, *by, *order).withColumn(part, F.spark_partition_id()), "ranges")
    held = ranged.groupBy(part, *by).agg(*[F.sum(c).alias(at[name]) for name, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(part, *by, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in at.values()])
    own = Window.partitionBy(part, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumns({name: F.coalesce(F.sum(c).over(own), F.lit(0)) for name, c in sums.items()}).join(held, [part, *by])
    out = placed.select(*rows.columns, *[(F.col(name) + F.col(c)).alias(name) for name, c in at.items()])
    out.lexloom_path = ranged.lexloom_path
    return out


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(absent, name, source_size, target, budget) of sizes (absent, name, source_size), a row a source: absent marks that without name.

    Sources weigh `weights` in turn, by code point, the absent one last. Targets add up to all sizes, as far as `most` times each size
    allows; budget is the target without its fraction. A source of size 0 has target 0.
    """
    one = shared_table(sizes.sparkSession, sizes.withColumn("one", F.lit(1)), "sources")
    counted = prefix_sums(one, ["one"], ["absent", "name"], {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    big = lambda c: c.cast("decimal(19,0)")
    capped = counted.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    capped = shared_table(sizes.sparkSession, capped.withColumn("level", big(F.col("cap")) * F.expr(f"{lcm(*weights)} div weight")), "capped")
    filled = prefix_sums(capped, ["one"], ["level", "absent", "name"], {"caps": F.col("cap"), "weighed": F.col("weight")})
    total = capped.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all"))
    full = big(F.col("cap")) * big(F.col("all") - F.col("weighed")) <= big(F.col("total") - F.col("caps")) * big(F.col("weight"))
    filled = shared_table(sizes.sparkSession, filled.crossJoin(total).withColumn("full", full), "filled")
    left = filled.agg((F.first("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0))).alias("left"), (F.first("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))), F.lit(0))).alias("of"))
    share = filled.crossJoin(left).withColumn("part", big(F.col("left")) * big(F.col("weight"))).withColumn("of", big(F.col("of")))
    return share.select(
        "absent", "name", "source_size",
        F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("part").cast("double") / F.col("of").cast("double")).alias("target"),
        F.when(F.col("full"), F.col("cap")).otherwise(F.expr("CASE WHEN of > 0 THEN part div of END")).alias("budget"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Every row of docs (doc_id, text, source) with size, source_size, target and taken: its words, those of its source, how many of
    these the mix is to have, and how many of the row's own it takes.

    Words are separated by ASCII white space. The taken words of a source add up to its target without the fraction, exactly; a row
    is taken `most` times at most. Null and empty texts have size 0 and are taken 0 times; a null source is one of its own, the last;
    very long texts are rows like any other. Which rows are taken goes by hashes of doc_id, text and seed, so reruns agree; rows that
    repeat one stand next to each other and are taken in any order. An empty table gives an empty result. Columns of docs named like
    those added are replaced, others kept, whatever their names.

    Sizes and keys are shuffled, texts are not: whole rows are written once and then joined to what is taken of them.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "source_size", "target", "taken")
    row, keep = fresh(docs, "_row"), docs.columns
    staged = shared_table(spark, docs.withColumn(row, F.monotonically_increasing_id()), "mix")
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary")), 1, 16)
    slim = staged.select(F.col(row).alias("row"), F.col("source").isNull().alias("absent"), F.coalesce("source", F.lit("")).alias("name"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"))
    slim = shared_table(spark, slim, "sizes")
    wanted = shared_table(spark, targets(slim.groupBy("absent", "name").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    placed = prefix_sums(slim, ["absent", "name"], ["key", "row"], {"before": F.col("size")}).join(wanted, ["absent", "name"])
    whole = F.expr("CASE WHEN source_size > 0 THEN budget div source_size ELSE 0L END")
    rest = F.col("budget") - whole * F.col("source_size") - F.col("before")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    placed = placed.select(F.col("row").alias(row), "size", "source_size", "target", taken.cast("long").alias("taken"))
    return staged.join(placed, row).select(*keep, "size", "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    parts = F.split(text, BOUNDARY)
    lead = F.when(F.get(parts, F.lit(0)).rlike(WORD), 0).otherwise(1)
    return F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), (n + lead).cast("int")), ""), r"[\x20\x09-\x0D]+\z", "")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: the columns of docs and `copy`, from 1, a row for each time a row of docs is taken; of a row that the cut of its
    source falls into, the last copy ends there. Rows of which nothing is taken have no copy. Otherwise as in `mix`."""
    taken = mix(docs.drop("copy"), weights, most, seed).filter("taken > 0")
    copies = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    return copies.withColumn("text", F.when(words < F.col("size"), first_words(F.col("text"), words)).otherwise(F.col("text"))).drop("size", "source_size", "target", "taken")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source IS NULL AS absent, coalesce(source, '') AS name, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 16) AS key
  FROM documents),
s AS (SELECT absent, name, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY absent, name) - 1) % 3 + 1 AS weight FROM d GROUP BY absent, name),
c AS (SELECT *, {MOST} * source_size AS cap, {MOST} * source_size * 6 // weight AS level FROM s),
p AS (
  SELECT *, coalesce(sum(cap) OVER w, 0)::HUGEINT AS caps, coalesce(sum(weight) OVER w, 0)::HUGEINT AS weighed, (SELECT sum(source_size) FROM s)::HUGEINT AS total, (SELECT sum(weight) FROM s)::HUGEINT AS every
  FROM c WINDOW w AS (ORDER BY level, absent, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap::HUGEINT * (every - weighed) <= (total - caps) * weight AS filled FROM p),
r AS (SELECT any_value(total) - coalesce(sum(cap) FILTER (filled), 0)::HUGEINT AS rest, any_value(every) - coalesce(sum(weight) FILTER (filled), 0)::HUGEINT AS parts FROM f),
t AS (
  SELECT absent, name, source_size, CASE WHEN filled THEN cap::DOUBLE ELSE (rest * weight)::DOUBLE / parts::DOUBLE END AS target,
    (CASE WHEN filled THEN cap ELSE rest * weight // parts END)::BIGINT AS budget FROM f, r),
b AS (SELECT doc_id, absent, name, size, coalesce(sum(size) OVER (PARTITION BY absent, name ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d),
x AS (SELECT doc_id, size, source_size, target, budget, before, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM b JOIN t USING (absent, name))
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, budget - whole * source_size - before)))::BIGINT AS taken FROM x
"""
