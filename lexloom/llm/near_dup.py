"""MinHash near-duplicates by tensored banding: table keys are pairs from two small collections of minhashes.

Each collection holds SIDE keys of two minhashes; the SIDE * SIDE tables are keyed by a pair, one key from each. So 4 * SIDE
minhashes do the work of 4 * SIDE * SIDE. A pair of similarity 0.8 misses all tables with a chance of 2 * 0.36 ** SIDE.

Pairs are taken from the buckets in two steps, neither of which makes all pairs of a bucket. First each set meets the most central
set of its buckets, which joins large groups at one pair a set; and again, as far as components still share buckets. Then the sets of buckets that still hold several components meet
where a filter on their rarest shingles, which is exact, can't rule a link out, and only across components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.llm.common import U64, column_bytes, discard, forget, mix64, runs, shared_table, shingle_hashes, slices, table, word_hashes
from lexloom.llm.connect import components

SIDE = 9
_N = 4 * SIDE
#: Rounds of pairs with the sets that lead the buckets, as long as they find links; in each but the first, pairs of a set and leaders
#: of a bucket.
ROUNDS, PICKS, LEADERS = 4, 4, 8
#: Sets that differ in size by less than this factor share a size class of the filter.
WIDTH = 1.03


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text; the whole sequence where there are fewer words; none without words."""
    words, counts = word_hashes(texts)
    out, at = [], 0
    for n in counts.tolist():
        own = words[at : at + n]
        at += n
        out.append(np.unique(shingle_hashes(own, min(k, n))) if n else np.zeros(0, U64))
    return out


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minhashes, a row for each non-empty set."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.zeros((0, _N), U64)
    flat, first = np.concatenate(full), np.concatenate(([0], np.cumsum([len(s) for s in full])[:-1]))
    seeds = mix64(np.arange(1, 2 * _N + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    out = np.empty((len(full), _N), U64)
    with np.errstate(over="ignore"):
        for i in range(_N):
            h = (flat ^ seeds[2 * i]) * (seeds[2 * i + 1] | U64(1))
            out[:, i] = np.minimum.reduceat(h ^ (h >> U64(32)), first)
    return out


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, hash, n, set, sig): a hash of the text, size and 128-bit digest of its shingle set, and its minhashes (none for an
    empty set)."""

    def run(batches):
        forget()
        for batch in slices(batches):
            sizes, digest, rows = [], [], []
            for texts in runs(column_bytes(batch, "text")):
                sets = shingle_sets(texts, k)
                sig, at = _signatures(sets), 0
                for s in sets:
                    sizes.append(len(s))
                    with np.errstate(over="ignore"):
                        digest.append(mix64(s ^ U64(0xA5A5)).sum(dtype=U64).tobytes() + np.bitwise_xor.reduce(mix64(s * U64(3)), initial=U64(0)).tobytes())
                    rows.append(sig[at].tobytes() if len(s) else None)
                    at += bool(len(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()), pa.array(rows, pa.binary())], ["doc_id", "hash", "n", "set", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "doc_id long, hash long, n long, set binary, sig binary")


def _table_keys(batches):
    """(key, id): the tensored table keys of each signature."""
    for batch in slices(batches, 4096):
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=U64).reshape(-1, _N)
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            side = [mix64(sig[:, i] * U64(31) + mix64(sig[:, i + 1])) for i in range(0, _N, 2)]
            for i in range(SIDE):
                for j in range(SIDE):
                    key = mix64(side[i] * U64(7) + mix64(side[SIDE + j]) + U64(i * SIDE + j))
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(ids)], ["key", "id"])


def _shared_keys(keys: DataFrame) -> DataFrame:
    """(key, id, members) of the buckets that hold several ids; counts are combined before they are shuffled."""
    found = keys.groupBy("key").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("members"), F.max("id").alias("most_id")).filter("members > 1")
    found = shared_table(keys.sparkSession, found, "buckets")
    pairs = found.filter("members = 2").select("key", F.explode(F.array("least_id", "most_id")).alias("id"), "members")
    return pairs.unionByName(keys.join(found.filter("members > 2").select("key", "members"), "key").select("key", "id", "members"))


def _mixed(keys: DataFrame, found: DataFrame) -> DataFrame:
    """keys (key, id, weight, ...) with the component c of each id and its size, of the buckets that hold several components."""
    sizes = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("size"))
    at = keys.select("key", "id", "weight").join(found.join(sizes, "component_id"), "id", "left")
    at = at.select("key", "id", "weight", F.coalesce("component_id", "id").alias("c"), F.coalesce("size", F.lit(1)).alias("size"))
    several = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
    return shared_table(keys.sparkSession, at.join(several, "key"), "mixed")


def _stars(at: DataFrame, met: DataFrame | None, picks: int, leaders: int) -> DataFrame:
    """(a, b): for each id of a mixed bucket, of the ids that lead its buckets and are of another component, so many that lead most of
    them; pairs that have met are left out.

    A bucket is led by the most central ids of its largest component, which most of what may be linked to it at all is linked to; and by
    that of the next component.
    """
    at = at.withColumn("r", F.struct("size", "weight"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("size"), F.desc("weight"), "id"))
    first = at.withColumn("k", place).filter(F.col("k") <= leaders)
    top = first.filter("k = 1").select("key", F.col("c").alias("c1"))
    next_ = at.join(top, "key").filter("c <> c1").groupBy("key").agg(F.max(F.struct("r", "id", "c")).alias("x")).select("key", "x.r", "x.id", "x.c")
    lead = first.select("key", "r", "id", "c").unionByName(next_).select("key", F.col("r").alias("rb"), F.col("id").alias("b"), F.col("c").alias("cb"))
    often = at.join(lead, "key").filter("c <> cb").groupBy("id", "b").agg(F.count(F.lit(1)).alias("n"), F.max("rb").alias("r"))
    if met is not None:
        known = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        often = often.join(known.select(F.col("a").alias("id"), "b"), ["id", "b"], "left_anti")
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), F.desc("r"), "b"))
    picked = often.withColumn("k", best).filter(F.col("k") <= picks)
    return picked.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()


def _shingles_of(docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """(id, n, shingles array<long>) of the classes reps (id, doc_id, hash): read again from the text of one row each."""

    def run(batches):
        for batch in slices(batches):
            at = 0
            for texts in runs(column_bytes(batch, "text")):
                sets = shingle_sets(texts, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "n", "shingles"])
                at += len(texts)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    texts = texts.join(reps.select("id", "doc_id", "hash"), ["doc_id", "hash"]).select("id", "text")
    return texts.mapInArrow(run, "id long, n long, shingles array<long>").dropDuplicates(["id"])  # repeated rows


def _least_overlap(a: Column, b: Column, percent: int) -> Column:
    """The least number of shared shingles that links sets of these sizes."""
    return F.ceil((a + b) * F.lit(percent) / F.lit(100 + percent) - 1e-9)


def verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, by their full sets in held (id, n, shingles)."""
    left = held.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = held.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    near = pairs.join(left, "a").join(right, "b").filter(sizes)
    return near.filter(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _across(rest: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of rest (id, c) of different c that a filter on rare shingles can't rule out; no link is among the others.

    With the shingles of both sets in one order, the rarest first, sets that share `need` or more have their first shared one no
    later than size - need in either. So a set is looked up by the shingles at its start only, the fewer the nearer the sizes: the
    smaller set of a pair under its size class, the larger under each class that a partner may have.
    """
    spark = rest.sparkSession
    rows = shared_table(spark, held.join(rest, "id").select("id", "c", "n", F.explode("shingles").alias("t")), "rest")
    often = rows.groupBy("t").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    own = Window.partitionBy("id")
    # shingles of one set only come first and meet nothing: they count, but need no row
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("f", "t")) - 1
    placed = rows.join(often, "t").withColumn("at", place)
    least = F.ceil(F.col("n") * percent / 100 - 1e-9)
    size_class = lambda n: F.floor(F.log(n.cast("double")) / F.lit(float(np.log(WIDTH)))).cast("int")
    placed = shared_table(spark, placed.filter(F.col("at") <= F.col("n") - _least_overlap(least, F.col("n"), percent)), "starts")
    small = placed.filter(F.col("at") <= F.col("n") - _least_overlap(F.col("n"), F.col("n"), percent))
    small = small.select(F.xxhash64("t", size_class(F.col("n"))).alias("key"), F.col("id").alias("a"), F.col("c").alias("ca"), F.col("at").alias("i"), F.col("n").alias("na"))
    large = placed.withColumn("s", F.explode(F.sequence(size_class(least), size_class(F.col("n")))))
    lowest = F.greatest(least, F.floor(F.pow(F.lit(WIDTH), F.col("s"))) - 1)
    large = large.filter(F.col("at") <= F.col("n") - _least_overlap(lowest, F.col("n"), percent))
    large = large.select(F.xxhash64("t", "s").alias("key"), F.col("id").alias("b"), F.col("c").alias("cb"), F.col("at").alias("j"), F.col("n").alias("nb"))
    # components first: members of one component never meet, however many there are; then the side of fewer members, so that a large
    # component is laid beside a small one only where the sizes and places fit
    sides = small.groupBy("key", "ca").agg(F.count(F.lit(1)).alias("ma")).join(large.groupBy("key", "cb").agg(F.count(F.lit(1)).alias("mb")), "key")
    meet = shared_table(spark, sides.filter("ca <> cb"), "meet")
    need = _least_overlap(F.col("na"), F.col("nb"), percent)
    fits = (F.col("na") <= F.col("nb")) & (F.col("na") - F.col("i") >= need) & (F.col("nb") - F.col("j") >= need)

    def met(pairs: DataFrame, one: DataFrame, c1: str, other: DataFrame, c2: str) -> DataFrame:
        one = pairs.select("key", "ca", "cb").join(one, ["key", c1]).alias("m")
        return one.join(other.alias("y"), (F.col("m.key") == F.col("y.key")) & (F.col(f"m.{c2}") == F.col(f"y.{c2}")) & fits).select("a", "b")

    found = met(meet.filter("ma <= mb"), small, "ca", large, "cb").unionByName(met(meet.filter("ma > mb"), large, "cb", small, "ca"))
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    out = shared_table(spark, found, "across")
    discard(rows, placed, meet)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text); similarity 100 * |A & B| >= percent * |A | B|.

    Null, empty and blank texts have no shingles and link with nothing. Rows of equal sets form a class, and only classes are
    compared, so copies never meet in pairs. Rows that share an id count as one vertex, whose links are those of all its texts; a
    row with a null id is a component of its own (null). Very long texts are read whole. An empty table gives an empty result;
    other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = shared_table(spark, sketch(docs, k), "sketches")
    full = rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("set").agg(F.min(F.struct("doc_id", "hash")).alias("r"), F.first("sig").alias("sig"))
    classes = shared_table(spark, classes.select(F.monotonically_increasing_id().alias("id"), "set", "r.doc_id", "r.hash", "sig"), "classes")
    member = shared_table(spark, full.select("set", "doc_id").join(classes.select("set", "id", F.col("doc_id").alias("least")), "set").select("doc_id", "id", "least").distinct(), "members")

    keys = _shared_keys(classes.select("id", "sig").mapInArrow(_table_keys, "key long, id long"))
    keys = shared_table(spark, keys, "keys")
    central = keys.groupBy("id").agg(F.sum("members").alias("weight"))
    weighted = shared_table(spark, keys.join(central, "id").select("key", "id", "weight"), "keys")
    held = shared_table(spark, _shingles_of(docs, classes.join(central, "id", "left_semi"), k), "shingles")
    # one id on several texts: its classes are one vertex
    several = member.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("most")).filter("b <> most").select("doc_id", "b")
    links = member.join(several, "doc_id").select(F.col("id").alias("a"), "b").filter("a <> b")
    found, met, mixed = components(links, "a", "b"), None, weighted
    for n in range(ROUNDS):
        mixed = _mixed(mixed, found)  # buckets of one component stay so
        pairs = shared_table(spark, _stars(mixed, met, *((PICKS, LEADERS) if n else (1, 1))), "stars")
        new = shared_table(spark, verified(pairs, held, percent), "links")
        if new.isEmpty():
            break
        links, met = links.unionByName(new), pairs if met is None else met.unionByName(pairs)
        found = components(links, "a", "b")
    rest = _mixed(mixed, found).select("id", "c").distinct()
    late = shared_table(spark, verified(_across(rest, held, percent), held, percent), "links")
    final = found if late.isEmpty() else components(links.unionByName(late), "a", "b")
    discard(keys, weighted, held)

    # the smallest id of a component is that of its classes
    named = final.join(classes.select("id", "doc_id"), "id")
    named = named.join(named.groupBy("component_id").agg(F.min("doc_id").alias("label")), "component_id").select("id", "label")
    label = member.join(named, "id", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "least")).alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(label, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=2, percent=80)


#: All pairs of distinct sets that share a shingle, then the closure of the links.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s
  FROM words),
classes AS (SELECT s, min(doc_id) AS id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT id, n, unnest(s) AS g FROM classes),
pairs AS (
  SELECT x.id AS a, y.id AS b, count(*) AS common, any_value(x.n) AS na, any_value(y.n) AS nb
  FROM items x JOIN items y ON x.g = y.g AND x.id < y.id WHERE least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 80 GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 80 * (na + nb - common)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS other FROM edges UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other),
least_of AS (SELECT id, min(other) AS c FROM reach GROUP BY id)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(l.c, k.id, d.doc_id) AS component_id, d.doc_id = coalesce(l.c, k.id, d.doc_id) AS kept
FROM sets d LEFT JOIN classes k ON d.s = k.s AND len(d.s) > 0 LEFT JOIN least_of l ON l.id = k.id
"""
