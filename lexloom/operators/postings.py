"""Vectors stored with chunks as they come in, and an inverted index of them whose blocks know the most that they can add to a score.

An ingest writes, for chunks that are not there yet, their sparse vectors by a fitted vocabulary, and their postings: of each term the
chunks that hold it, the greatest weights first, in blocks. Both are parts of one version. A question reads the blocks of the terms
that it asks for; the first block of each gives a score that the last of the best is known to reach, and of the others only those are
opened whose own best, with the best of all other terms, reaches it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.config import TOP_K
from lexloom.operators import tfidf
from lexloom.sources.shared import discard, shared_table
from lexloom.sources.versions import Versions

#: Postings to a block; chunks of a law to a shard, about, whose postings are put in order together.
BLOCK, SHARD = 128, 100_000
#: Terms up to which their names are handed to the scan of the blocks.
NAMED = 2000


def blocks(vectors: DataFrame) -> DataFrame:
    """(law, term, shard, block, top, entries) of vectors (law, chunk_id, norm, vector): no task sees more of a term than one shard of a
    law holds of it. Shards are counted first, a row a law, and broadcast: a join that brought a law together would keep it so."""
    parts = vectors.groupBy("law").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("parts"))
    rows = vectors.join(F.broadcast(parts), "law").withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.col("parts")))
    rows = rows.select("law", "shard", "chunk_id", "norm", F.explode("vector").alias("x")).select("law", "shard", "chunk_id", "x.term", (F.col("x.w") / F.col("norm")).alias("w"))
    order = Window.partitionBy("law", "term", "shard").orderBy(F.desc("w"), "chunk_id")
    rows = rows.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("int"))
    return rows.groupBy("law", "term", "shard", "block").agg(F.max("w").alias("top"), F.collect_list(F.struct("chunk_id", "w")).alias("entries"))


def dealt(blocks: DataFrame) -> DataFrame:
    """Blocks as they are stored: a task writes of a law at least a 64th of the terms of one shard, in order."""
    return blocks.repartition("law", "shard", F.pmod(F.xxhash64("term"), F.lit(64))).sortWithinPartitions("law", "term", "block")


class Postings:
    """The index in a folder, of any number of ingests."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path, "law")

    def add(self, chunks: DataFrame, vocabulary: DataFrame) -> int:
        """Embeds and indexes the chunks (law, chunk_id, text, concept_tags if any) that are not there yet; returns how many. Their
        weights are those of the vocabulary given, whatever others were added with."""
        return self.versions.update(lambda manifest, _: self._added(manifest, chunks, vocabulary))

    def _added(self, manifest: dict, chunks: DataFrame, vocabulary: DataFrame):
        known = self._vectors(manifest)
        if known is not None:
            chunks = chunks.join(known.select("law", "chunk_id"), ["law", "chunk_id"], "left_anti")
        if "concept_tags" not in chunks.columns:
            chunks = chunks.withColumn("concept_tags", F.lit(None).cast("array<string>"))
        new = shared_table(self.spark, tfidf.sparse(chunks, vocabulary), "vectors")
        try:
            n = new.count()
            if not n:
                return None
            own = dealt(blocks(new))
            parts = {"vectors": (new, manifest.get("more", {}).get("vectors")), "blocks": (own, manifest if manifest["schema"] else None)}
            out = {}
            for name, (rows, before) in parts.items():
                part, folders = self.versions.add(rows)
                out[name] = {"schema": before["schema"] if before else rows.schema.jsonValue(), "live": (before["live"] if before else {}) | {part: folders}}
            return out["blocks"] | {"more": {"vectors": out["vectors"]}}, n
        finally:
            discard(new)

    def _vectors(self, manifest: dict) -> DataFrame | None:
        more = manifest.get("more", {}).get("vectors")
        return self.versions.rows(more) if more else None

    def exists(self) -> bool:
        return self.versions.latest() > 0

    def vectors(self) -> DataFrame:
        """(law, chunk_id, concept_tags, norm, vector array<struct<term,w>>), a row a chunk; w is still to be divided by norm."""
        found = self._vectors(self.versions.manifest(self.versions.latest()))
        if found is None:
            raise FileNotFoundError(f"{self.versions.path} holds no vectors yet")
        return found

    def merged(self) -> int:
        """Rewrites the postings of all ingests as those of one, with blocks of full length; returns the number of chunks."""

        def change(manifest: dict, _):
            vectors = self._vectors(manifest)
            part, folders = self.versions.add(dealt(blocks(vectors)))
            return manifest | {"live": {part: folders}}, vectors.count()

        return self.versions.update(change)

    def asked(self, queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
        """(law, concept, term, q, shard, block, top, entries): the blocks of the terms of queries (concept, query), read once; q is the
        term's weight in the query's vector of length one."""
        q = shared_table(self.spark, tfidf.query_weights(queries, vocabulary), "asked")
        names = [r["term"] for r in q.select("term").distinct().limit(NAMED + 1).collect()]
        stored = self.versions.read()
        if len(names) <= NAMED:
            stored = stored.filter(F.col("term").isin(names))
        return shared_table(self.spark, stored.join(q, ["law", "term"]).select("law", "concept", "term", "q", "shard", "block", "top", "entries"), "blocks")

    @staticmethod
    def opened(asked: DataFrame, reached: DataFrame) -> DataFrame:
        """The blocks of which a chunk may score `least` or more, as reached (law, concept, least) has it; unknown: all. What a block's
        top has to reach is a row a term that is asked for, written first: so the blocks themselves need not be brought together."""
        best = asked.groupBy("law", "concept", "term").agg((F.max("top") * F.first("q")).alias("most"))
        total = best.groupBy("law", "concept").agg(F.sum("most").alias("total"))
        bounds = shared_table(asked.sparkSession, best.join(total, ["law", "concept"]).join(reached, ["law", "concept"], "left"), "bounds")
        rows = asked.join(bounds, ["law", "concept", "term"])
        bound = F.col("total") - F.col("most") + F.col("q") * F.col("top")
        return rows.filter(F.col("least").isNull() | (bound >= F.col("least") - 1e-9)).drop("most", "total", "least")

    @staticmethod
    def _sums(opened: DataFrame) -> DataFrame:
        rows = opened.select("law", "concept", "q", F.explode("entries").alias("x"))
        return rows.groupBy("law", "concept", "x.chunk_id").agg(F.sum(F.col("q") * F.col("x.w")).alias("score"))

    def retrieve(self, queries: DataFrame, vocabulary: DataFrame, top_k: int = TOP_K, min_score: float = 0.0, tagged: bool = True) -> DataFrame:
        """(law, concept, chunk_id, score, rk), as `tfidf.retrieve` of the chunks that were added; none of their texts is read."""
        asked = self.asked(queries, vocabulary)
        chunks = self.vectors().select("law", "chunk_id", "concept_tags")
        own = lambda sums: tfidf.tagged_only(sums, chunks) if tagged else sums
        # what the first blocks give a chunk is no more than its score
        first = own(self._sums(asked.filter("block = 0"))).groupBy("law", "concept").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
        reached = first.select("law", "concept", F.get("s", F.lit(top_k - 1)).alias("least"))
        reached = reached.select("law", "concept", F.greatest("least", F.lit(min_score) if min_score > 0 else F.lit(None).cast("double")).alias("least"))
        return tfidf.best(own(self._sums(self.opened(asked, reached))), chunks, queries, top_k, min_score, tagged)
