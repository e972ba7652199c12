"""TF-IDF vectors of one and two words per law, and cosine top-k, as joins over sparse rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.config import CONCEPT_QUERIES, MAX_TERMS, TOP_K
from lexloom.functions.fold import fold
from lexloom.functions.text import let
from lexloom.sources.shared import shared_table

#: Accented Latin letters and what is left of them without the accent, for SQL; `fold` has all.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def terms(text: Column) -> Column:
    """Words of two characters or more, lower-cased and without accents, then pairs of neighbours."""
    found = F.regexp_extract_all(fold(F.lower(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    pair = lambda a, b: F.concat(a, F.lit(" "), b)
    return let(found, lambda w: F.when(F.size(w) > 1, F.concat(w, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), pair))).otherwise(w))


def counts(chunks: DataFrame) -> DataFrame:
    """(law, chunk_id, term, tf). Terms are counted within the row of their chunk, from their sorted array: no shuffle. chunk_id is a
    key; rows that repeat one are chunks of their own here."""
    rows = chunks.select("law", "chunk_id", F.sort_array(terms(F.col("text"))).alias("s")).filter(F.size("s") > 0)
    first = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    rows = rows.withColumn("i", first)
    after = F.concat(F.slice("i", F.lit(2), F.greatest(F.size("i") - 1, F.lit(0))), F.array(F.size("s")))
    runs = F.zip_with("i", after, lambda a, b: F.struct(F.get("s", a).alias("term"), (b - a).cast("long").alias("tf")))
    return rows.select("law", "chunk_id", F.inline(runs))


#: Parts by hash that the terms of a law are ranked in first; cells that its pairs of words are counted in first.
PARTS, CELLS = 256, 1 << 18


def ranked(counted: DataFrame, k: int) -> DataFrame:
    """Of counted (law, term, ctf, ...) the k most frequent terms of each law, ties by term. Terms are ranked within parts of their law
    first, and only the first k of each part with those of the others: Spark itself limits no group of more than 1,000 rows."""
    kept = counted.withColumn("_p", F.pmod(F.xxhash64("term"), F.lit(PARTS)))
    for keys in (["law", "_p"], ["law"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ctf"), "term"))
        kept = kept.withColumn("_k", rank).filter(F.col("_k") <= k)
    return kept.drop("_p", "_k")


def cell(term: Column) -> Column:
    """Of a law and a term, as one number; two laws that share some only let through more."""
    return F.shiftleft(F.xxhash64("law"), 18) + F.pmod(F.xxhash64(term), F.lit(CELLS))


def likely(chunks: DataFrame, max_terms: int = MAX_TERMS) -> tuple[DataFrame, DataFrame]:
    """(law, least) and (cell): what a term has to reach to be among the max_terms most frequent of its law, and the cells of all terms
    that can. Words are counted one by one: the last of the first max_terms of them is reached by whatever comes before it. Pairs of
    words, of which most occur once, are counted by cell, and none occurs more often than its cell. Laws of fewer words have no row."""
    single = ~F.contains("term", F.lit(" "))
    found = chunks.select("law", F.explode(terms(F.col("text"))).alias("term"))
    keys = F.when(single, F.col("term")).alias("term"), F.when(~single, cell(F.col("term"))).alias("cell")
    counted = shared_table(chunks.sparkSession, found.select("law", *keys).groupBy("law", "term", "cell").agg(F.count(F.lit(1)).alias("ctf")), "cells")
    words = ranked(counted.filter("term IS NOT NULL").select("law", "term", "ctf"), max_terms)
    least = words.groupBy("law").agg(F.count(F.lit(1)).alias("n"), F.min("ctf").alias("least")).filter((F.col("n") == max_terms) & (F.col("least") > 1))
    least = shared_table(chunks.sparkSession, least.select("law", "least"), "least")
    reached = counted.join(least, "law").filter("ctf >= least").select(F.coalesce("cell", cell(F.col("term"))).alias("cell"))
    return least, shared_table(chunks.sparkSession, reached.distinct(), "likely")


def fit(chunks: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """(law, term, ctf, df, idf): the most frequent terms of each law; ties by term. Chunks are read twice: for the cells of the terms that
    can be among them, then to count these. Every occurrence and, beside it, every term of a chunk once are counted in one aggregation,
    combined before its shuffle."""
    n = chunks.groupBy("law").agg(F.count(F.lit(1)).alias("n"))
    least, reached = likely(chunks, max_terms)
    found = chunks.join(least, "law", "left").select("law", "least", terms(F.col("text")).alias("t"))
    both = found.select("law", "least", F.posexplode(F.array("t", F.array_distinct("t"))).alias("once", "t")).select("law", "least", "once", F.explode("t").alias("term"))
    both = both.withColumn("cell", cell(F.col("term"))).join(reached.withColumn("_in", F.lit(True)), "cell", "left").filter("_in OR least IS NULL")
    vocabulary = both.groupBy("law", "term").agg(F.count_if(F.col("once") == 0).alias("ctf"), F.count_if(F.col("once") == 1).alias("df"))
    return ranked(vocabulary, max_terms).join(n, "law").select("law", "term", "ctf", "df", (F.log((F.lit(1) + F.col("n")) / (F.lit(1) + F.col("df"))) + 1).alias("idf"))


def fitted(chunks: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """The vocabulary as a table that was written once: what reads it is planned with its true size, so it is broadcast if small."""
    return shared_table(chunks.sparkSession, fit(chunks, max_terms), "vocabulary")


def save(vocabulary: DataFrame, path: str) -> None:
    """Replaces the laws that the vocabulary holds and leaves those of others."""
    vocabulary.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("law").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A saved vocabulary, to be used without another fit."""
    return spark.read.schema("term string, ctf long, df long, idf double, law string").parquet(path).select("law", "term", "ctf", "df", "idf")


def sparse(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(law, chunk_id, concept_tags, norm, vector array<struct<term,w>>) of chunks (law, chunk_id, concept_tags, text), a row each; without
    a known term the vector is null. Texts are dealt out by chunk first, so that terms need no shuffle of their own."""
    dealt = chunks.select("law", "chunk_id", "concept_tags", "text").repartition("law", "chunk_id")
    found = dealt.select("law", "chunk_id", F.explode(terms(F.col("text"))).alias("term"))
    known = found.join(vocabulary.select("law", "term", "idf"), ["law", "term"])
    tf = known.groupBy("law", "chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("idf").alias("idf"))
    w = tf.withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    vector = w.groupBy("law", "chunk_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.array_sort(F.collect_list(F.struct("term", "w"))).alias("vector"))
    return chunks.select("law", "chunk_id", "concept_tags").join(vector, ["law", "chunk_id"], "left")


def queries_table(spark: SparkSession, queries: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((CONCEPT_QUERIES if queries is None else queries).items()), "concept string, query string")


def asked(concepts: DataFrame, queries: DataFrame) -> DataFrame:
    """(concept, query): the query text of each concept, or else its name."""
    return concepts.select("concept").distinct().join(queries, "concept", "left").select("concept", F.coalesce("query", "concept").alias("query"))


def vectors(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(law, chunk_id, term, w) of length one."""
    return exploded(sparse(chunks, vocabulary))


def exploded(rows: DataFrame) -> DataFrame:
    """(law, chunk_id, term, w) of rows as `sparse` has them."""
    return rows.select("law", "chunk_id", "norm", F.explode("vector").alias("x")).select("law", "chunk_id", "x.term", (F.col("x.w") / F.col("norm")).alias("w"))


def retrieve(chunks: DataFrame, queries: DataFrame, top_k: int = TOP_K, min_score: float = 0.0, max_terms: int = MAX_TERMS, tagged: bool = True, vocabulary: DataFrame | None = None) -> DataFrame:
    """(law, concept, chunk_id, score, rk) for all laws and queries (concept, query) at once. Only chunks that carry the concept's
    tag are candidates; ties go by chunk_id; candidates without a common term score 0.

    Chunks are read for the vocabulary, unless one is given, and for their vectors; `Postings` keeps these. With tags, those with one
    that is asked for are found first, and only they get vectors. Of the candidates that score 0 only as many as could be wanted are made.
    """
    vocabulary = fitted(chunks, max_terms) if vocabulary is None else vocabulary
    q = shared_table(chunks.sparkSession, query_weights(queries, vocabulary), "asked")
    rows = chunks if "concept_tags" in chunks.columns else chunks.withColumn("concept_tags", F.lit(None).cast("array<string>"))
    own = carriers(rows, queries) if tagged else rows
    if tagged:
        rows = rows.join(own, ["law", "chunk_id"], "left_semi")
    sums = vectors(rows, vocabulary).join(q, ["law", "term"]).groupBy("law", "concept", "chunk_id").agg(F.sum(F.col("q") * F.col("w")).alias("score"))
    return best(tagged_only(sums, own) if tagged else sums, own, queries, top_k, min_score, tagged)


def carriers(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(law, chunk_id, concept_tags) of the chunks with a tag that is a concept of queries, written once."""
    every = queries.agg(F.collect_set("concept").alias("every"))  # one row
    rows = chunks.select("law", "chunk_id", "concept_tags").crossJoin(F.broadcast(every)).filter(F.arrays_overlap("concept_tags", "every"))
    return shared_table(chunks.sparkSession, rows.drop("every"), "carriers")


def query_weights(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(law, concept, term, q): the vectors of queries (concept, query) by each law's vocabulary, of length one."""
    counted = queries.select("concept", F.explode(terms(F.col("query"))).alias("term")).groupBy("concept", "term").agg(F.count(F.lit(1)).alias("tf"))
    w = counted.join(vocabulary.select("law", "term", "idf"), "term").withColumn("qw", (1 + F.log("tf")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(Window.partitionBy("law", "concept")))
    return w.select("law", "concept", "term", (F.col("qw") / length).alias("q"))


def tagged_only(scored: DataFrame, chunks: DataFrame) -> DataFrame:
    """Those of scored (law, concept, chunk_id, score) whose chunk carries the concept's tag."""
    tags = chunks.select("law", "chunk_id", F.explode("concept_tags").alias("concept")).distinct()
    return scored.join(tags, ["law", "concept", "chunk_id"], "left_semi")


def best(scored: DataFrame, chunks: DataFrame, queries: DataFrame, top_k: int, min_score: float, tagged: bool) -> DataFrame:
    """(law, concept, chunk_id, score, rk): the best of scored, which are candidates with a common term, and of those without one, which
    score 0; of these only as many as could be wanted are made."""
    scored = scored.filter(F.col("score") >= min_score)
    if min_score <= 0:
        every = queries.agg(F.array_sort(F.collect_set("concept")).alias("every"))  # one row
        tags = F.array_intersect("concept_tags", "every") if tagged else F.col("every")
        cand = chunks.select("law", "chunk_id", *(["concept_tags"] if tagged else [])).crossJoin(F.broadcast(every)).select("law", "chunk_id", F.explode(tags).alias("concept"))
        place = F.row_number().over(Window.partitionBy("law", "concept").orderBy("chunk_id"))
        first = _top(scored, top_k).select("law", "concept", "chunk_id")
        rest = cand.withColumn("_k", place).filter(F.col("_k") <= 2 * top_k).drop("_k").join(first, ["law", "concept", "chunk_id"], "left_anti")
        scored = _top(scored, top_k).drop("rk").unionByName(rest.distinct().withColumn("score", F.lit(0.0)))
    return _top(scored, top_k)


def _top(scored: DataFrame, k: int) -> DataFrame:
    """Scores that differ by the order of summation only are ties."""
    rank = F.row_number().over(Window.partitionBy("law", "concept").orderBy(F.desc(F.round("score", 12)), "chunk_id"))
    return scored.withColumn("rk", rank).filter(F.col("rk") <= k)


NOTHING = "[No relevant text found for {concept} in {law}]"


def prompt_texts(hits: DataFrame, chunks: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """(law, concept, prompt): the retrieved passages in order, each under its source. Hits, which are few, are written first and joined
    at their true size: texts stay where they are."""
    rows = shared_table(chunks.sparkSession, hits, "hits").join(chunks.select("law", "chunk_id", "article_ref", "text"), ["law", "chunk_id"])
    shown = F.format_string("[Source: %s | %s | score=%.3f]\n%s", "law", "article_ref", "score", "text")
    grouped = rows.groupBy("law", "concept").agg(F.array_sort(F.collect_list(F.struct("rk", shown.alias("t")))).alias("p"))
    return grouped.select("law", "concept", F.array_join(F.transform("p", lambda x: x["t"]), separator).alias("prompt"))


def nearest(rows: DataFrame, queries: DataFrame, top_k: int | None = TOP_K, min_score: float = -1.0) -> DataFrame:
    """(qid, id, score, rk) of rows (id, vector) for each of a stated set of queries (qid, vector), by cosine; ties go by id. Without
    top_k all that reach min_score, unranked.

    Blocks of rows meet blocks of queries, and a pair of blocks gives top_k rows a query at most, which are ranked together. A vector of
    length 0, null, or with a null component scores 0 with all, as do vectors of different lengths.
    """
    rows, queries = rows.select("id", "vector"), queries.select("qid", "vector")
    left, right = packed(rows, "id", "x"), shared_table(rows.sparkSession, packed(queries, "qid", "q"), "queries")
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    found = left.crossJoin(right).mapInArrow(scoring(top_k, min_score), schema)
    if top_k is None:
        return found
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return found.withColumn("rk", rank).filter(F.col("rk") <= top_k)


#: Vectors to a block.
PACKED = 2048


def packed(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(ids, vectors) of rows (key, vector), PACKED or fewer to a row: vectors of length one as doubles, one after the other with its
    number of components before it; -1 where there is nothing to compare."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PACKED):
                part = batch.slice(at, PACKED)
                out = []
                for v in part.column(1).to_pylist():
                    x = np.array([0.0] if v is None or None in v else v, np.float64)
                    length = np.sqrt((x * x).sum())
                    out.append(np.concatenate(([len(x)], x / length)) if len(x) and np.isfinite(length) and length > 0 else np.array([-1.0]))
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([np.concatenate(out).tobytes()])], [f"{name}_ids", f"{name}_vectors"])

    kind = T.ArrayType(rows.schema[key].dataType)
    return rows.select(key, "vector").mapInArrow(run, T.StructType([T.StructField(f"{name}_ids", kind), T.StructField(f"{name}_vectors", T.BinaryType())]))


def scoring(top_k: int | None, min_score: float):
    """From pairs of blocks to (qid, id, score): products of whole blocks, and of each query the best."""

    def unpacked(raw: bytes) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By number of components, the places of the vectors and these."""
        flat, at, found = np.frombuffer(raw, np.float64), 0, {}
        n = 0
        while at < len(flat):
            size = int(flat[at])
            found.setdefault(size, []).append((n, at + 1))
            at += 1 + max(0, size)
            n += 1
        return {size: (np.array([i for i, _ in own]), np.stack([flat[a : a + max(0, size)] for _, a in own])) for size, own in found.items()} | {None: n}

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                pair = {c: batch.column(batch.schema.get_field_index(c))[k] for c in batch.schema.names}
                x, q = unpacked(pair["x_vectors"].as_py()), unpacked(pair["q_vectors"].as_py())
                scores = np.zeros((q.pop(None), x.pop(None)))
                for size in q.keys() & x.keys() - {-1}:
                    # a pair's sum is taken in one order, wherever it stands: equal vectors score equally
                    scores[np.ix_(q[size][0], x[size][0])] = np.einsum("ij,kj->ik", q[size][1], x[size][1])
                ids, qids = pair["x_ids"].values, pair["q_ids"].values
                order = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable") if top_k else None
                at, own = [], []
                for i, s in enumerate(scores):
                    j = np.flatnonzero(s >= min_score)
                    if top_k and len(j) > top_k:
                        j = j[s[j] >= np.partition(s[j], len(j) - top_k)[len(j) - top_k]]
                        j = j[np.lexsort((order[j], -s[j]))[:top_k]]
                    at.append(j), own.append(np.full(len(j), i))
                at, own = np.concatenate(at or [np.zeros(0, np.int64)]), np.concatenate(own or [np.zeros(0, np.int64)])
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(own)), ids.take(pa.array(at)), pa.array(scores[own, at])], ["qid", "id", "score"])

    return run


def cosine(a: Column, b: Column) -> Column:
    """Of two dense arrays, in double precision; 0 where a length is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
