"""Single questions to stored chunks: the passages of a law that are nearest to a concept."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.config import CONCEPT_QUERIES, MAX_CHUNK, MAX_TERMS, MIN_CHUNK, TOP_K
from lexloom.operators import store as st
from lexloom.operators import tfidf
from lexloom.operators.chunking import chunk
from lexloom.operators.postings import Postings
from lexloom.sources.laws import read_laws
from lexloom.sources.shared import filesystem


class Embedder(Protocol):
    def fit(self, chunks: DataFrame) -> Embedder: ...

    def laws(self) -> list[str] | None:
        """Those it can be asked for; None: any."""

    def nearest(self, chunks: DataFrame, law: str, concept: str, query: str, top_k: int, min_score: float) -> DataFrame:
        """(chunk_id, score, rk) of chunks, all of one law and candidates already."""


class TfIdfEmbedder:
    """Terms of one and two words, a vocabulary for each law."""

    def __init__(self, vocabulary: DataFrame | None = None, max_terms: int = MAX_TERMS):
        self.vocabulary, self.max_terms = vocabulary, max_terms
        self._laws: list[str] | None = None

    def fit(self, chunks: DataFrame) -> TfIdfEmbedder:
        self.vocabulary, self._laws = tfidf.fitted(chunks, self.max_terms), None
        return self

    def save(self, path: str) -> None:
        tfidf.save(self.vocabulary, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfIdfEmbedder:
        return cls(tfidf.load(spark, path))

    def laws(self) -> list[str]:
        if self._laws is None:
            self._laws = sorted(r["law"] for r in self.vocabulary.select("law").distinct().collect()) if self.vocabulary is not None else []
        return self._laws

    def embed(self, texts: DataFrame) -> DataFrame:
        """(law, chunk_id, term, w) of texts (law, chunk_id, text); a text without a known term has no rows."""
        return tfidf.vectors(texts.select("law", "chunk_id", F.lit(None).cast("array<string>").alias("concept_tags"), "text"), self.vocabulary)

    def nearest(self, chunks: DataFrame, law: str, concept: str, query: str, top_k: int, min_score: float) -> DataFrame:
        queries = tfidf.queries_table(chunks.sparkSession, {concept: query})
        found = tfidf.retrieve(chunks, queries, top_k, min_score, tagged=False, vocabulary=self.vocabulary.filter(F.col("law") == law))
        return found.select("chunk_id", "score", "rk")


class ModelEmbedder:
    """Dense vectors of a function from texts to vectors, which is called with `batch` texts at a time in Arrow batches."""

    def __init__(self, encode: Callable[[list[str]], list[list[float]]], batch: int = 32):
        self.encode, self.batch = encode, batch

    def fit(self, chunks: DataFrame) -> ModelEmbedder:
        return self

    def laws(self) -> None:
        return None

    def embed(self, texts: DataFrame) -> DataFrame:
        """texts with `vector`."""
        encode, batch = self.encode, self.batch

        @F.pandas_udf("array<double>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in parts:
                own = s.tolist()
                yield pd.Series([[float(x) for x in v] for at in range(0, len(own), batch) for v in encode(own[at : at + batch])])

        return texts.withColumn("vector", run("text"))

    def nearest(self, chunks: DataFrame, law: str, concept: str, query: str, top_k: int, min_score: float) -> DataFrame:
        asked = self.encode([query])[0]
        queries = chunks.sparkSession.createDataFrame([(concept, [float(x) for x in asked])], "qid string, vector array<double>")
        rows = (chunks if "vector" in chunks.columns else self.embed(chunks)).select(F.col("chunk_id").alias("id"), "vector")
        return tfidf.nearest(rows, F.broadcast(queries), top_k, min_score).select(F.col("id").alias("chunk_id"), "score", "rk")


class StoredEmbedder(TfIdfEmbedder):
    """The same, of chunks whose vectors and postings were stored as they came in: no text is read for a question."""

    def __init__(self, vocabulary: DataFrame, postings: Postings):
        super().__init__(vocabulary)
        self.postings = postings

    def nearest(self, chunks: DataFrame, law: str, concept: str, query: str, top_k: int, min_score: float) -> DataFrame:
        queries = tfidf.queries_table(chunks.sparkSession, {concept: query})
        found = self.postings.retrieve(queries, self.vocabulary.filter(F.col("law") == law), top_k, min_score)
        return found.filter(F.col("law") == law).select("chunk_id", "score", "rk")


class Retriever:
    """Chunks are read once for all questions of a `with` block, and dropped at its end."""

    def __init__(self, chunks: DataFrame, embedder: Embedder):
        self.chunks, self.embedder = chunks.persist(), embedder

    def __enter__(self) -> Retriever:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.chunks.unpersist()

    def stats(self) -> dict[str, int]:
        return {r["law"] or "": r["n"] for r in st.stats(self.chunks).collect()}

    def retrieve(self, concept: str, law: str, top_k: int = TOP_K, query_text: str | None = None, min_score: float = 0.0) -> DataFrame:
        """The best chunks of the law that carry the concept's tag, with score and rk. Without a text the concept's own query is
        asked, or else its name. A law that the embedder wasn't fitted for is a KeyError."""
        law = law.upper()
        known = self.embedder.laws()
        if known is not None and law not in known:
            raise KeyError(f"no vocabulary for {law}; there is one for {', '.join(known) or 'no law'}")
        own = st.by_concept(self.chunks, concept, law)
        hits = self.embedder.nearest(own, law, concept, query_text or CONCEPT_QUERIES.get(concept, concept), top_k, min_score)
        return own.join(hits, "chunk_id").orderBy("rk")

    def retrieve_for_prompt(self, concept: str, law: str, top_k: int = TOP_K, separator: str = "\n\n---\n\n") -> str:
        """The passages under their sources, or a note that there are none: top_k rows on the driver."""
        hits = self.retrieve(concept, law, top_k).withColumn("concept", F.lit(concept))
        found = tfidf.prompt_texts(hits.select("law", "concept", "chunk_id", "score", "rk"), self.chunks, separator).first()
        return found["prompt"] if found else tfidf.NOTHING.format(concept=concept, law=law)


def fitted_embedder(chunks: DataFrame, path: str, refit: bool = False) -> TfIdfEmbedder:
    """The vocabulary saved at path for all laws of the chunks; those it lacks, or all with refit, are fitted and saved first."""
    spark = chunks.sparkSession
    fs, at = filesystem(spark, path)
    missing = chunks
    if fs.exists(at) and not refit:
        missing = chunks.join(F.broadcast(tfidf.load(spark, path).select("law").distinct()), "law", "left_anti")  # a row a law
    if not missing.isEmpty():
        TfIdfEmbedder().fit(missing).save(path)
    return TfIdfEmbedder.load(spark, path)


def index_of(chunks: str) -> str:
    """Where the vectors and postings of a store of chunks stand: beside it."""
    return f"{chunks.rstrip('/')}-index"


def ingest_file(spark: SparkSession, path: str, law: str, chunks: str, vocabulary: str, min_chars: int = MIN_CHUNK, max_chars: int = MAX_CHUNK) -> dict:
    """One law file into the store of chunks, and its chunks' vectors and postings beside them, by the saved vocabulary, which is reused
    if it has the law. What is there already stays, so a run that broke off is made good by the next."""
    store = st.ParquetStore(spark, chunks)
    n = store.ingest(chunk(read_laws(spark, {law.upper(): path}), min_chars, max_chars, [law]))
    own = store.read().filter(F.col("law") == law.upper())
    embedder = fitted_embedder(own, vocabulary)
    embedded = Postings(spark, index_of(chunks)).add(own, embedder.vocabulary)
    return {"law": law.upper(), "new_chunks": n, "chunks": own.count(), "embedded": embedded, "store": chunks, "vocabulary": vocabulary}


def retriever_from_files(spark: SparkSession, laws: dict[str, str], chunks: str, vocabulary: str) -> Retriever:
    for law, path in laws.items():
        ingest_file(spark, path, law, chunks, vocabulary)
    return Retriever(st.ParquetStore(spark, chunks).read(), StoredEmbedder(tfidf.load(spark, vocabulary), Postings(spark, index_of(chunks))))
